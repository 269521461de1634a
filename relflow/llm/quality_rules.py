"""Quality rules: a threshold table compiled into one projection. DataFrame
functions only; a row is judged where it is scanned, without a shuffle.

A rule bounds a ratio of two measures of the text (length, symbols, stop words,
lines, repetition). ``judge`` compiles any such table into Spark expressions: each
measure that the table names is worked out once per text, and a document is kept if
it passes the base test and breaks no rule. Repeated three-word windows are found by
sorting the text's own windows, so the work grows as n log n with its words.

Words are ``[^\\x20\\x09-\\x0D]+``, lines are split at ``\\n``. The base test fails
with fewer than 50 words, or if more than half of the words lie in a three-word window
that the text holds twice or more.

Rows: one per input row, repeated ones too; a null ``doc_id`` stays null. A null or
empty text has no words and fails the base test. A denominator of 0 counts as 1. A
value on a bound passes. An empty table gives no rows. Other columns of the table are
not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]"
SYMBOLS = "[#*$%&|<>]"
MIN_WORDS = 50
REPEAT_PERCENT = 50

# Frequent function words of English, German, French and Spanish.
STOP_WORDS = (
    "the be to of and that have with is in it for as on by was he at from are this",
    "der die das und ist in den von zu mit sich des auf für nicht ein eine dem als auch es",
    "le la les de des et un une est que qui dans en du pour pas au sur par il elle",
    "el la los las de y que en un una es por con para del se su al lo como no",
)


@dataclass(frozen=True)
class Threshold:
    """``least <= measure / per <= most``; an absent bound is not tested."""

    name: str
    measure: str
    per: str | None = None
    least: float | None = None
    most: float | None = None


THRESHOLDS = (
    Threshold("word length", "word_chars", "n_words", 2.0, 15.0),
    Threshold("symbols", "n_symbols", "n_words", most=0.3),
    Threshold("exclamations", "n_exclaims", "n_words", most=0.5),
    Threshold("stop words", "n_stop_words", "n_words", least=0.02),
    Threshold("repeated lines", "n_dup_lines", "n_lines", most=0.5),
    Threshold("table lines", "n_bar_lines", "n_lines", most=0.8),
)


def _next(items: Column) -> Column:
    return F.slice(items, F.lit(2), F.greatest(F.size(items), F.lit(1)))


def _marked(items: Column, twins: Column, value) -> Column:
    """``value`` of the sorted ``items`` that equal a neighbour; ``twins`` says
    which ones equal the next."""
    either = F.zip_with(twins, F.concat(F.array(F.lit(False)), twins), lambda a, b: F.coalesce(a, F.lit(False)) | b)
    return F.filter(F.zip_with(items, either, lambda s, e: F.when(e, value(s))), lambda i: i.isNotNull())


def _with_windows(rows: DataFrame) -> DataFrame:
    """``rows`` (with ``words``) and ``starts``: the sorted places of the three-word
    windows that a text holds twice or more. The places are sorted by a 32-bit hash of
    their window, as plain numbers; only those that share a hash are compared by their
    words. Every array that is read twice is a column of its own, made once."""
    rows = rows.select("*", F.transform("words", lambda w: F.xxhash64(w)).alias("hashes"))
    first = F.slice("hashes", F.lit(1), F.greatest(F.size("hashes") - 2, F.lit(0)))
    keys = F.transform(first, lambda h, i: F.shiftleft(F.hash(h, F.get("hashes", i + 1), F.get("hashes", i + 2)).cast("long"), 32).bitwiseOR(i.cast("long")))
    rows = rows.select("*", F.sort_array(keys).alias("keys")).drop("hashes")
    same = F.zip_with("keys", _next(F.col("keys")), lambda a, b: F.shiftright(a, 32) == F.shiftright(b, 32))
    rows = rows.select("*", same.alias("twins"))
    found = _marked(F.col("keys"), F.col("twins"), lambda k: k.bitwiseAND(F.lit((1 << 32) - 1)).cast("int"))
    rows = rows.select("*", found.alias("found")).drop("keys", "twins")
    window = F.sort_array(F.transform("found", lambda i: F.struct(F.concat_ws(" ", F.get("words", i), F.get("words", i + 1), F.get("words", i + 2)).alias("w"), i.alias("i"))))
    rows = rows.select("*", window.alias("windows")).drop("found")
    rows = rows.select("*", F.zip_with("windows", _next(F.col("windows")), lambda a, b: a["w"] == b["w"]).alias("twins"))
    return rows.select("*", F.sort_array(_marked(F.col("windows"), F.col("twins"), lambda s: s["i"])).alias("starts")).drop("windows", "twins")


def _covered(starts: Column) -> Column:
    """Number of words in the three-word windows that start at ``starts``."""
    zero = F.struct(F.lit(-3).alias("last"), F.lit(0).cast("long").alias("n"))
    return F.aggregate(starts, zero, lambda a, i: F.struct(i.alias("last"), (a["n"] + F.least(F.lit(3), i - a["last"])).alias("n")), lambda a: a["n"])


def _count(items: Column, test) -> Column:
    return F.size(F.filter(items, test)).cast("long")


def stop_words() -> list[str]:
    """The stop words, also with a capital letter."""
    words = {w for line in STOP_WORDS for w in line.split()}
    return sorted(words | {w.capitalize() for w in words})


def _measures() -> dict[str, Column]:
    """All measures, over the columns ``t``, ``words``, ``lines`` and ``starts``."""
    t, words, lines = F.col("t"), F.col("words"), F.col("lines")

    def chars(among: str) -> Column:
        return (F.length(t) - F.length(F.regexp_replace(t, among, ""))).cast("long")
    return {
        "n_words": F.size(words).cast("long"),
        "word_chars": F.length(F.concat_ws("", words)).cast("long"),
        "n_symbols": chars(SYMBOLS),
        "n_dup_lines": (F.size(lines) - F.size(F.array_distinct(lines))).cast("long"),
        "n_repeat_words": _covered(F.col("starts")),
        "n_lines": F.size(lines).cast("long"),
        "n_exclaims": (F.length(t) - F.length(F.replace(t, F.lit("!"), F.lit("")))).cast("long"),
        "n_stop_words": F.size(F.filter(words, lambda w: w.isin(stop_words()))).cast("long"),
        "n_bar_lines": F.size(F.filter(lines, lambda x: F.contains(x, F.lit("|")))).cast("long"),
    }


#: Measures that are returned whatever the table names.
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def compiled(rules: Sequence[Threshold]) -> Column:
    """The names of the broken rules, joined by commas, over the measures' columns."""
    def broken(r: Threshold) -> Column:
        value = F.col(r.measure).cast("double")
        if r.per:
            value = value / F.greatest(F.col(r.per), F.lit(1).cast("long"))
        tests = ([value < F.lit(float(r.least))] if r.least is not None else []) + ([value > F.lit(float(r.most))] if r.most is not None else [])
        return F.when(tests[0] if len(tests) == 1 else tests[0] | tests[1], F.lit(r.name))
    tested = [broken(r) for r in rules if r.least is not None or r.most is not None]
    return F.concat_ws(",", *tested) if tested else F.lit("")


def judge(docs: DataFrame, rules: Sequence[Threshold] = THRESHOLDS) -> DataFrame:
    """``doc_id``, the base measures, ``base_failed``, ``kept`` and ``broken`` of each
    row of ``docs`` (doc_id, text)."""
    measures = _measures()
    known = set(measures)
    for r in rules:
        if r.measure not in known or (r.per and r.per not in known):
            raise ValueError(f"rule {r.name!r} names an unknown measure; known are {', '.join(sorted(known))}")
    used = [m for m in measures if m in BASE or any(m in (r.measure, r.per) for r in rules)]
    text = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("t"))
    # arrays that several measures read are columns of their own, made once per text
    split = text.select("doc_id", "t", F.array_remove(F.split("t", SPACE), "").alias("words"),
                        F.filter(F.split("t", "\n"), lambda x: x.rlike(WORD)).alias("lines"))
    # generated, not projected: a later filter on a result then stays above the measures,
    # where Catalyst would otherwise copy their expressions into it and work them out anew
    rows = _with_windows(split).select("doc_id", F.inline(F.array(F.struct(*[measures[m].alias(m) for m in used]))))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))
    rows = rows.select("*", failed.alias("base_failed"), compiled(rules).alias("broken"))
    return rows.select("doc_id", *BASE, "base_failed", (~F.col("base_failed") & (F.col("broken") == "")).alias("kept"), "broken")
