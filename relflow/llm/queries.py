"""One query per operator of this subpackage, over its whole table, with DuckDB
SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from relflow.llm import codes, forest, importance, minhash, mixing, packing, pivots, preferences, quality_rules, secrets, toxicity, urls, whitening

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f
    return add


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@_query("op1_importance_resampling")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.resample(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def _op2_sql() -> str:
    rules = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in urls.RULES)
    return f"""WITH rules(rule_host, rule_path, rule_verdict) AS (VALUES {rules}),
        r AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) END AS rest FROM pages),
        p AS (SELECT page_id, coalesce(translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
                     coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path FROM r),
        j AS (SELECT p.*, rule_host || rule_path AS rule, rule_verdict,
                     row_number() OVER (PARTITION BY page_id ORDER BY length(rule_host || rule_path) DESC NULLS LAST) AS n
              FROM p LEFT JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path))
        SELECT page_id, host, path, rule, coalesce(rule_verdict, 'allow') AS verdict FROM j WHERE n = 1"""


@_query("op2_bloom_cascade_urls", _op2_sql())
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages").select("page_id", "url")
    return urls.url_filter(pages, urls.rule_table(spark)).judge(pages).drop("url")


def preference_turns(conversations: DataFrame) -> DataFrame:
    """Stand-in input: each conversation as the chosen side; the rejected side has
    the next conversation's last answer (none: an empty one) as its own."""
    last = conversations.where("role = 'assistant'").groupBy("conv_id").agg(F.max(F.struct("turn", "text")).alias("last"))
    other = last.select((F.col("conv_id") - 1).alias("conv_id"), F.col("last.text").alias("other"))
    turns = (conversations.join(last, "conv_id", "left").join(other, "conv_id", "left")
             .select(F.col("conv_id").alias("pair_id"), "turn", "role", "text", "last", F.coalesce("other", F.lit("")).alias("other")))
    is_last = F.coalesce((F.col("role") == "assistant") & (F.col("turn") == F.col("last.turn")), F.lit(False))
    sides = F.array(F.struct(F.lit("chosen").alias("side"), F.col("text").alias("text")),
                    F.struct(F.lit("rejected").alias("side"), F.when(is_last, F.col("other")).otherwise(F.col("text")).alias("text")))
    return turns.withColumn("s", F.explode(sides)).select("pair_id", "s.side", "turn", "role", "s.text")


_OP3_SQL = """
    WITH l AS (SELECT conv_id, max(turn) AS turn FROM conversations WHERE role = 'assistant' GROUP BY conv_id),
    o AS (SELECT conv_id - 1 AS conv_id, max(text) AS other FROM conversations SEMI JOIN l USING (conv_id, turn) WHERE role = 'assistant' GROUP BY conv_id),
    t AS (SELECT c.conv_id, c.turn, coalesce(c.role, 'user') AS role, coalesce(c.text, '') AS a,
                 CASE WHEN c.role = 'assistant' AND c.turn = l.turn THEN coalesce(o.other, '') ELSE coalesce(c.text, '') END AS b
          FROM conversations c LEFT JOIN l USING (conv_id) LEFT JOIN o USING (conv_id)),
    g AS (SELECT conv_id, list({'turn': turn, 'role': role, 'text': a} ORDER BY turn, role, a) AS c,
                 list({'turn': turn, 'role': role, 'text': b} ORDER BY turn, role, b) AS r FROM t GROUP BY conv_id),
    n AS (SELECT *, list_position(list_transform(range(1, len(c) + 1), lambda i: c[i].role = r[i].role AND c[i].text = r[i].text), false) AS p FROM g),
    m AS (SELECT *, CAST(coalesce(nullif(p, 0) - 1, len(c)) AS INTEGER) AS n_common FROM n),
    w AS (SELECT conv_id, n_common, c[1:n_common] AS h, c[n_common + 1:] AS x, r[n_common + 1:] AS y FROM m),
    s AS (SELECT *, list_transform(h, lambda t: '<|im_start|>' || t.role || chr(10) || t.text || '<|im_end|>' || chr(10)) AS hs,
                 list_transform(x, lambda t: '<|im_start|>' || t.role || chr(10) || t.text || '<|im_end|>' || chr(10)) AS xs,
                 list_transform(y, lambda t: '<|im_start|>' || t.role || chr(10) || t.text || '<|im_end|>' || chr(10)) AS ys FROM w)
    SELECT conv_id AS pair_id, n_common, array_to_string(hs, '') AS prompt, array_to_string(xs, '') AS chosen,
           array_to_string(list_transform(list_filter(range(1, len(x) + 1), lambda i: x[i].role = 'assistant'),
               lambda i: CAST(length(array_to_string(xs[1:i], '')) - length(x[i].text) - 11 AS BIGINT) || ':' || CAST(length(array_to_string(xs[1:i], '')) - 1 AS BIGINT)), ',') AS chosen_spans,
           array_to_string(ys, '') AS rejected,
           array_to_string(list_transform(list_filter(range(1, len(y) + 1), lambda i: y[i].role = 'assistant'),
               lambda i: CAST(length(array_to_string(ys[1:i], '')) - length(y[i].text) - 11 AS BIGINT) || ':' || CAST(length(array_to_string(ys[1:i], '')) - 1 AS BIGINT)), ',') AS rejected_spans
    FROM s"""


@_query("op3_preference_format", _OP3_SQL)
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = preferences.format_pairs(preference_turns(_table(spark, sf_dir, "conversations")))
    return out.withColumns({c: preferences.span_text(F.col(c)) for c in ("chosen_spans", "rejected_spans")})


@_query("op4_superminhash_dedup")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(_table(spark, sf_dir, "documents"))


def _op5_sql() -> str:
    """Per rule the lengths of the matches and of the texts between them give the spans."""
    parts, spans = [], []
    for i, r in enumerate(secrets.RULES):
        pat = r.pattern.replace("'", "''")
        parts.append(f"""regexp_extract_all(t, '{pat}', 0) AS m{i}, regexp_extract_all(t, '{pat}', {r.group}) AS g{i},
            string_split_regex(t, '{pat}') AS s{i}""")
        at = f"list_sum(list_transform(s{i}[1:j], lambda x: length(x))) + coalesce(list_sum(list_transform(m{i}[1:j - 1], lambda x: length(x))), 0)"
        spans.append(f"""list_transform(list_filter(range(1, len(m{i}) + 1), lambda j: length(g{i}[j]) >= {r.least}),
            lambda j: {{'start': CAST({at} AS BIGINT), 'rule_no': {i}, 'stop': CAST({at} + length(m{i}[j]) AS BIGINT), 'kind': '{r.kind}'}})""")
    text = "array_to_string(list_transform({}, lambda s: s.kind || ':' || s.start || ':' || s.stop), ',')"
    base = "list_filter(sp, lambda s: s.rule_no < 3)"
    n = ", ".join(f"CAST(len(list_filter(sp, lambda s: s.kind = '{k}')) AS BIGINT) AS n_{k}" for k in ("assign", "access", "hex"))
    return f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
        p AS (SELECT doc_id, {', '.join(parts)} FROM d),
        q AS (SELECT doc_id, list_sort(list_concat({', '.join(spans)})) AS sp FROM p)
        SELECT doc_id, {n}, sha256({text.format(base)}) AS base_sha256, {text.format('sp')} AS spans FROM q"""


def _of_rule(number: int):
    return lambda s: s["rule_no"] == number


@_query("op5_blob_ledger_secrets", _op5_sql())
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    versions = _table(spark, sf_dir, "documents").select(F.col("doc_id").alias("path"), "text")
    paths, entries = secrets.scan_blobs(versions)
    spans = F.col("spans")
    base = F.filter(spans, lambda s: s["rule_no"] < len(secrets.BASE))
    count = [F.size(F.filter(spans, _of_rule(i))).cast("long").alias(f"n_{r.kind}") for i, r in enumerate(secrets.BASE)]
    return secrets.findings(paths, entries).select(
        F.col("path").alias("doc_id"), *count, F.sha2(secrets.joined(base).cast("binary"), 256).alias("base_sha256"),
        secrets.joined(spans).alias("spans"))


@_query("op6_pivot_permutation_dedup")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pivots.near_vectors(_table(spark, sf_dir, "embeddings"))


@_query("op7_weak_supervision_toxicity")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.scores(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


@_query("op8_hypergeometric_mix")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.taken(mixing.mix(_table(spark, sf_dir, "documents"))).drop("source")


@_query("op9_best_fit_packing")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers
    return packing.pack_documents(_table(spark, sf_dir, "documents"),
                                  public_tokenizers.path("byte_bpe_50k.json"), with_ids=False)


@_query("op10_projection_forest")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return forest.nearest(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


@_query("op11_chebyshev_whitening")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whitened_rows(_table(spark, sf_dir, "embeddings"))


def _op12_sql() -> str:
    stop = ", ".join(f"'{w}'" for w in quality_rules.stop_words())
    tests = []
    for r in quality_rules.THRESHOLDS:
        value = f"CAST({r.measure} AS DOUBLE)" + (f" / greatest({r.per}, 1)" if r.per else "")
        broken = [f"{value} < {r.least}"] * (r.least is not None) + [f"{value} > {r.most}"] * (r.most is not None)
        tests.append(f"CASE WHEN {' OR '.join(broken)} THEN '{r.name}' END")
    return f"""WITH b AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
        s AS (SELECT r, doc_id, t, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') AS w,
                     list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS l FROM b),
        u AS (SELECT r, unnest(w) AS x, generate_subscripts(w, 1) AS i FROM s),
        g AS (SELECT r, i, x, lead(x, 1) OVER q AS y, lead(x, 2) OVER q AS z FROM u WINDOW q AS (PARTITION BY r ORDER BY i)),
        c AS (SELECT r, i, z IS NOT NULL AND count(*) OVER (PARTITION BY r, x, y, z) > 1 AS twice FROM g),
        v AS (SELECT r, bool_or(twice) OVER (PARTITION BY r ORDER BY i ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS inside FROM c),
        n AS (SELECT r, count(*) FILTER (WHERE inside) AS n_repeat_words FROM v GROUP BY r),
        m AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
                     CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
                     CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
                     CAST(len(l) AS BIGINT) AS n_lines, length(regexp_replace(t, '[^!]', '', 'g')) AS n_exclaims,
                     len(list_filter(w, lambda x: x IN ({stop}))) AS n_stop_words,
                     len(list_filter(l, lambda x: contains(x, '|'))) AS n_bar_lines FROM s LEFT JOIN n USING (r)),
        j AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
                     concat_ws(',', {', '.join(tests)}) AS broken FROM m)
        SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND broken = '' AS kept, broken FROM j"""


@_query("op12_threshold_quality_rules", _op12_sql())
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(_table(spark, sf_dir, "documents"))


def _op13_sql() -> str:
    """Brute force: each round compares all parts with all entries."""
    def nearest(i: int) -> str:
        return f"""a{i} AS MATERIALIZED (SELECT r, p, min(CAST(xx - 2 * list_inner_product(x, c) + list_inner_product(c, c) AS BIGINT) * 256 + e) AS k
            FROM parts JOIN b{i} USING (p) GROUP BY r, p)"""

    def moved(i: int) -> str:
        return f"""m{i} AS (SELECT p, e, list(CAST(floor(s / n) AS DOUBLE) ORDER BY pos) AS c FROM (
                SELECT p, k % 256 AS e, pos, sum(CAST(x[pos] AS BIGINT)) AS s, count(*) AS n
                FROM parts JOIN a{i} USING (r, p), (SELECT unnest(range(1, (SELECT max(len(x)) FROM parts) + 1)) AS pos) GROUP BY ALL) GROUP BY p, e),
            b{i + 1} AS MATERIALIZED (SELECT p, e, coalesce(m{i}.c, b{i}.c) AS c FROM b{i} LEFT JOIN m{i} USING (p, e))"""
    rounds = codes.ROUNDS
    steps = ", ".join(f"{nearest(i)}, {moved(i)}" for i in range(rounds)) + ", " + nearest(rounds)
    return f"""WITH v AS (SELECT vec_id, label, list_transform(embedding, lambda c: floor(1024 * CAST(c AS DOUBLE))) AS x FROM embeddings
                   WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
        o AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id, x) AS r, * FROM v),
        parts AS MATERIALIZED (SELECT r, p, x[p * w + 1:(p + 1) * w] AS x, list_inner_product(x[p * w + 1:(p + 1) * w], x[p * w + 1:(p + 1) * w]) AS xx
                  FROM (SELECT r, x, len(x) // 4 AS w, unnest(range(4)) AS p FROM o)),
        b0 AS (SELECT p, r - 1 AS e, x AS c FROM parts WHERE r <= 256), {steps},
        h AS (SELECT sha256(string_agg(array_to_string(list_transform(c, lambda y: CAST(CAST(y AS BIGINT) AS VARCHAR)), ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM b{rounds}),
        f AS (SELECT r, string_agg(printf('%02x', k % 256), '' ORDER BY p) AS code, CAST(sum(k // 256) AS BIGINT) AS error FROM a{rounds} GROUP BY r)
        SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM o JOIN f USING (r), h"""


@_query("op13_bitmask_codes", _op13_sql())
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codes.compress(_table(spark, sf_dir, "embeddings"))
