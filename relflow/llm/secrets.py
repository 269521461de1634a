"""Secret scans with an incremental ledger of blobs. DataFrame functions only.

A version of a file is (path, text); its text is a blob, addressed by the
SHA-256 of its content. The ledger has a row for each blob and rule version that
has been scanned, with the spans found. A scan takes the blobs of all versions,
drops the (blob, rule version) pairs that the ledger has, scans each remaining
blob once, whoever and however many hold it, with the rule versions it lacks,
and joins the ledger's findings back to all paths.

A rule's matches are leftmost and don't overlap; matches shorter than its limit
are dropped after matching. A span is ``kind:start:end`` in code points, end
exclusive. Starts follow from the lengths of the matches and of the texts between
them, so the regular expressions run in the JVM only.

Rows: one per input row, repeated ones too. A null text is empty. A null path
stays null. An empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from relflow.llm import common as C


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str
    least: int = 1          # characters of ``group``
    group: int = 0
    version: int = 1

    @property
    def key(self) -> str:
        return f"{self.kind}@{self.version}"


# The base patterns and their least lengths.
BASE = (
    Rule("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 12, 2),
    Rule("access", r"AKIA[A-Z0-9]+", 18),
    Rule("hex", r"[0-9a-f]{16,}"),      # the runs of 16 and more are the runs that pass
)
MORE = (
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+"),
)
RULES = BASE + MORE
SPAN = "struct<start:int,rule_no:int,end:int,kind:string,rule:string>"
SPANS = f"array<{SPAN}>"
LEDGER = f"blob string, rules array<string>, spans {SPANS}"


def rule_spans(text: Column, rule: Rule, number: int) -> Column:
    """The spans of one rule in ``text``, in order."""
    found = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    part = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group)) if rule.group else found
    # the text is gap, match, gap, match, ..., gap
    gaps = F.transform(F.split(text, rule.pattern, -1), lambda g: F.length(g))
    matches = F.zip_with(found, part, lambda m, g: F.struct(F.length(m).alias("n"), (F.length(g) >= rule.least).alias("ok")))
    steps = F.zip_with(F.slice(gaps, F.lit(1), F.size(found)), matches,
                       lambda g, m: F.struct(g.alias("gap"), m["n"].alias("n"), m["ok"].alias("ok")))

    def step(acc, s):
        at = acc["at"] + s["gap"]
        span = F.struct(at.alias("start"), F.lit(number).alias("rule_no"), (at + s["n"]).alias("end"),
                        F.lit(rule.kind).alias("kind"), F.lit(rule.key).alias("rule"))
        spans = F.when(s["ok"], F.concat(acc["spans"], F.array(span).cast(SPANS))).otherwise(acc["spans"])
        return F.struct((at + s["n"]).alias("at"), spans.alias("spans"))

    none = F.array().cast(SPANS)
    spans = F.aggregate(steps, F.struct(F.lit(0).alias("at"), none.alias("spans")), step, lambda acc: acc["spans"])
    return F.when(text.rlike(rule.pattern), spans).otherwise(none)


def blob_id(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256)


def scan_blobs(versions: DataFrame, ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES) -> tuple[DataFrame, DataFrame]:
    """``versions`` (path, text) -> (paths, new ledger entries), both stored.

    paths: ``(path, blob)`` for every row. Entries: ``(blob, rules, spans)``, one
    for each blob that the ledger lacks some rule version for: the rule versions
    scanned now, and their spans."""
    keys = F.array(*[F.lit(r.key) for r in rules])
    rows = versions.select(F.col("path").cast("long").alias("path"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("blob", blob_id(F.col("text")))
    paths = C.stored(rows.select("path", "blob"))
    blobs = paths.groupBy("blob").agg(F.min("path").alias("path"))
    if ledger is None:
        blobs = blobs.withColumn("todo", keys)
    else:
        have = ledger.groupBy("blob").agg(F.flatten(F.collect_list("rules")).alias("have"))     # one entry a scan
        blobs = blobs.join(have, "blob", "left").withColumn("todo", F.array_except(keys, F.coalesce("have", F.array().cast("array<string>"))))
        blobs = blobs.where(F.size("todo") > 0)
    # one holder of each unseen blob brings its text; a hot blob has many paths, but one row here
    key = F.coalesce("path", F.lit(-(1 << 63))).alias("holder")
    wanted = C.stored(blobs.select("blob", key, "todo"))
    texts = rows.select("blob", key, "text").join(wanted.hint("shuffle_hash"), ["blob", "holder"])
    spans = F.concat(*[F.when(F.array_contains("todo", r.key), rule_spans(F.col("text"), r, i)).otherwise(F.array().cast(SPANS))
                       for i, r in enumerate(rules)])
    entries = texts.select("blob", F.col("todo").alias("rules"), F.array_sort(spans).alias("spans"))
    return paths, C.stored(entries.dropDuplicates(["blob"]))        # a repeated row is a holder twice


def blob_spans(ledger: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``(blob, spans)`` of the blobs with spans of ``rules``, over all scans."""
    keys = [r.key for r in rules]
    found = ledger.where(F.size("spans") > 0).groupBy("blob").agg(F.flatten(F.collect_list("spans")).alias("spans"))
    found = found.withColumn("spans", F.array_sort(F.filter("spans", lambda s: s["rule"].isin(keys))))
    return found.where(F.size("spans") > 0)


def findings(paths: DataFrame, ledger: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``(path, blob, spans)``: the ledger's spans for every path, by start and
    then by the order of the rules."""
    known = C.stored(blob_spans(ledger, rules))     # a plain table, so that Spark may split a hot blob's paths
    return paths.join(known, "blob", "left").select(
        "path", "blob", F.coalesce("spans", F.array().cast(SPANS)).alias("spans"))


def joined(spans: Column) -> Column:
    """Spans as one string, ``kind:start:end`` joined by commas."""
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))


def redacted(text: Column, spans: Column) -> Column:
    """``text`` with every span, or run of overlapping spans, replaced by the
    kind of its first one in brackets."""
    def step(acc, s):
        new = s["start"] >= acc["at"]
        piece = F.concat(acc["out"], F.substr(text, acc["at"] + 1, s["start"] - acc["at"]), F.lit("["), s["kind"], F.lit("]"))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.when(new, piece).otherwise(acc["out"]).alias("out"))

    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    done = F.aggregate(spans, start, step, lambda acc: F.concat(acc["out"], F.substr(text, acc["at"] + 1, F.length(text))))
    return F.when(F.size(spans) > 0, done).otherwise(text)


def redacted_documents(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``docs`` with the secrets in ``text`` replaced and ``n_chars`` counted anew
    where that changed something; other rows and columns as they are."""
    versions = docs.select(F.col("doc_id").alias("path"), "text")
    _, entries = scan_blobs(versions, None, rules)
    found = C.stored(blob_spans(entries, rules)).toDF("__blob", "__spans")
    rows = docs.join(found, blob_id(docs["text"]) == F.col("__blob"), "left")
    text = redacted(docs["text"], F.col("__spans"))
    new = {"text": F.when(F.col("__spans").isNotNull(), text).otherwise(docs["text"])}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(F.col("__spans").isNotNull(), F.length(text).cast(docs.schema["n_chars"].dataType)).otherwise(docs["n_chars"])
    return rows.select(*[new.get(c, docs[c]).alias(c) for c in docs.columns])
