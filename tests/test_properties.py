"""Cross-operator properties and a stream restart."""

import os

import pandas as pd
import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from relflow import queries as Q
from relflow.operators import interactions as B
from relflow.operators import state as C
from relflow.operators import topk as TK
from relflow.operators import views as D
from relflow.sinks.writers import write_evaluations
from relflow.sources.ids import assign_evaluation_id
from relflow.streaming import relation_state as RS


def test_state_equals_last_feed_row_and_tree(spark):
    sig = Q.signed(spark, SF_SMALL)
    feed = C.relation_scores_feed(sig).toPandas().sort_values(["actor1", "actor2", "ts", "k1", "k2", "k3", "k4"])
    last = feed.groupby(["actor1", "actor2"]).tail(1).set_index(["actor1", "actor2"])
    c5 = C.relation_scores(sig).toPandas().set_index(["actor1", "actor2"])
    c6 = C.relation_scores_by_day(sig, fanout=8).toPandas().set_index(["actor1", "actor2"])
    for df in (c5, c6):
        j = df.join(last, rsuffix="_f")
        assert len(j) == len(last)
        assert (j.raw_score - j.raw_score_f).abs().max() < 1e-9
        assert (j.norm <= 101).all()


def test_pair_order_does_not_matter(spark):
    ev = B.with_both_actors(Q._events(spark, SF_SMALL))
    swapped = ev.withColumn("_a", F.col(B.A1)).withColumn(B.A1, F.col(B.A2)).withColumn(B.A2, F.col("_a")).drop("_a")
    a = B.canonical_pair(ev).select("k1", "k2", "k3", "k4", "actor1", "actor2").toPandas()
    b = B.canonical_pair(swapped).select("k1", "k2", "k3", "k4", "actor1", "actor2").toPandas()
    key = ["k1", "k2", "k3", "k4", "actor1", "actor2"]
    assert a.sort_values(key).reset_index(drop=True).equals(b.sort_values(key).reset_index(drop=True))


def test_mirror_is_an_involution_on_pair_sets(spark):
    st = Q.relation_state(spark, SF_SMALL)
    m1 = D.mirror(st).toPandas()
    m2 = D.mirror(D.mirror(st)).toPandas().drop_duplicates()
    to_set = lambda d: set(zip(d.actor1, d.actor2, d.score.round(12)))
    assert to_set(m1) == to_set(m2)
    assert len(m1) == 2 * len(st.toPandas()) - (st.toPandas().actor1 == st.toPandas().actor2).sum()


def test_unknown_quad_error_mode(spark):
    ev = Q._events(spark, SF_SMALL).limit(0).unionByName(
        spark.createDataFrame([(1, 1, 1, 1, "A", "B", 5, None, None)], Q._events(spark, SF_SMALL).schema))
    with pytest.raises(Exception):
        B.quad_score(ev, on_unknown="error").collect()
    assert B.quad_score(ev).count() == 0 and B.unknown_quad_rows(ev).count() == 1


def test_recommendation_text_and_evaluations_sink(spark, tmpdir_run):
    ranked = spark.createDataFrame([(7, 1, 10, 0.5), (7, 2, 11, 0.25)], "user_id long, rank long, item_id long, score double")
    assert TK.recommendation_text(ranked).first().text == "7:(10,0.5),(11,0.25)"
    ev = assign_evaluation_id(spark.createDataFrame([(1, 0.5), (2, 1.0)], "request_id long, ndcg double"))
    assert ev.select("evaluation_id").distinct().count() == 2
    write_evaluations(ev, f"{tmpdir_run}/ev")
    assert spark.read.option("header", "true").csv(f"{tmpdir_run}/ev").count() == 2


def test_stream_restart_from_checkpoint(spark, tmpdir_run):
    sig = Q.signed(spark, SF_SMALL).select("actor1", "actor2", "ts", "k1", "k2", "k3", "k4", "score")
    pdf = sig.toPandas().sort_values(["ts", "k1", "k2", "k3", "k4"]).reset_index(drop=True)
    src, out, ck = f"{tmpdir_run}/src", f"{tmpdir_run}/out", f"{tmpdir_run}/ck"
    os.makedirs(src)
    parts = [pdf.iloc[int(len(pdf) * i / 4): int(len(pdf) * (i + 1) / 4)] for i in range(4)]

    def run():
        st = spark.readStream.schema(sig.schema).option("maxFilesPerTrigger", 1).parquet(src)
        q = (RS.stream_relation_scores(st).writeStream.format("parquet").outputMode("append")
             .option("checkpointLocation", ck).trigger(availableNow=True).start(out))
        q.awaitTermination()

    for i in range(2):
        parts[i].to_parquet(f"{src}/p{i}.parquet", index=False)
    run()                       # first run stops after two files
    for i in range(2, 4):
        parts[i].to_parquet(f"{src}/p{i}.parquet", index=False)
    run()                       # restart from the checkpoint: state is restored
    got = spark.read.parquet(out).toPandas()
    batch = C.relation_scores_feed(sig).toPandas()
    key = ["actor1", "actor2", "k1", "k2", "k3", "k4"]
    rows = lambda d: sorted(tuple(r[:-1]) + (round(r[-1], 9),) for r in d[key + ["score"]].itertuples(index=False))
    assert rows(got) == rows(batch)
