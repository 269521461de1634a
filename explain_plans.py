"""Summarise the physical plans of the registered queries (PLANS.md).

usage: python explain_plans.py [sf_dir] > PLANS.md

Counts shuffles, broadcasts, join strategies, Python stages and scans with
their pushed filters / read schema, from ``explain("formatted")`` of each
query's final DataFrame. Steps that an operator materialises before returning
(ordered-scan checkpoints, broadcast chunks) appear as ``LogicalRDD`` /
``Scan ExistingRDD`` inputs.
"""

from __future__ import annotations

import io
import re
import sys
from contextlib import redirect_stdout

from relflow.queries import QUERIES
from relflow.session import get_spark

KINDS = ["BroadcastExchange", "BroadcastHashJoin", "SortMergeJoin", "ShuffledHashJoin",
         "BroadcastNestedLoopJoin", "CartesianProduct", "MapInPandas", "FlatMapGroupsInPandas",
         "ArrowEvalPython", "BatchEvalPython", "Window", "HashAggregate", "ObjectHashAggregate",
         "SortAggregate", "Scan parquet", "Scan ExistingRDD"]


def summarise(df) -> dict:
    buf = io.StringIO()
    with redirect_stdout(buf):
        df.explain("formatted")
    text = buf.getvalue()
    tree = text.split("\n\n")[0]
    counts = {k: len(re.findall(r"\b" + re.escape(k) + r"\b", tree)) for k in KINDS}
    # shuffle exchanges by partitioning (from the node details)
    for kind in ("hashpartitioning", "rangepartitioning", "SinglePartition", "RoundRobinPartitioning"):
        n = len(re.findall(r"\(\d+\) (?:Shuffle)?Exchange\n(?:[^\n]+\n)*?Arguments: " + kind, text))
        if n:
            counts[f"Exchange {kind}"] = n
    scans = re.findall(r"\(\d+\) Scan parquet[^\n]*\n(?:[^\n]*\n)*?ReadSchema: ([^\n]*)", text)
    pushed = re.findall(r"PushedFilters: (\[[^\n]*\])", text)
    return {"counts": {k: v for k, v in counts.items() if v}, "read": scans, "pushed": pushed}


def main(argv):
    sf = argv[1] if len(argv) > 1 else "/root/testdata/sf0.1"
    spark = get_spark("local[8]", 16)
    print("# PLANS\n")
    print(f"Physical plan summary of every registered query at `{sf}` "
          "(`python explain_plans.py`). Ordered scans and top-K materialise their first pass "
          "(checkpoint / broadcast chunk) before the final plan, which then starts from "
          "`Scan ExistingRDD`.\n")
    print("| query | operators | parquet reads (ReadSchema) |")
    print("| --- | --- | --- |")
    for name, fn in QUERIES.items():
        s = summarise(fn(spark, sf))
        ops = ", ".join(f"{k} x{v}" for k, v in s["counts"].items() if k not in ("Scan parquet",))
        reads = "; ".join(sorted(set(r.replace("struct<", "").rstrip(">") for r in s["read"])))
        print(f"| {name} | {ops} | {reads} |")


if __name__ == "__main__":
    main(sys.argv)
