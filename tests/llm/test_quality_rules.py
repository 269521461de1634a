import pytest
from brute import WORD, multiset
from hypothesis import given, settings
from hypothesis import strategies as st

from relflow.llm import quality_rules as Q

COLUMNS = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]


def plain(text):
    t = text or ""
    w = WORD.findall(t)
    windows = [tuple(w[i:i + 3]) for i in range(len(w) - 2)]
    many = {x for x in windows if windows.count(x) > 1} if len(w) < 2000 else set()
    inside = {i + k for i, x in enumerate(windows) if x in many for k in range(3)}
    seen, dup = set(), 0
    for line in t.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    failed = len(w) < 50 or 100 * len(inside) > 50 * len(w)
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), dup, len(inside), failed)


def judged(spark, texts, rules=Q.THRESHOLDS):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return Q.judge(df, rules).orderBy("doc_id").collect()


PROSE = "The cat of the house was seen in that garden by {} and it is the old one with a white paw for us. "
TEXTS = [None, "", " \n\t ", "one", "a a a a", "a b c a b c", "x y z\nx y z\n\nx y z", "é|ü <b> 100% $5 #tag & *",
         "a\x0bb\x0cc\rd e f", " ".join(f"w{i}" for i in range(49)), " ".join(f"w{i}" for i in range(50)),
         "".join(PROSE.format(f"n{i}") for i in range(1, 4)), " ".join(["the of and"] * 40 + [f"v{i}" for i in range(120)]),
         "\n".join(["same line here"] * 30), "".join(f"{chr(97 + i % 26)}{i} of the {i * 7} " for i in range(30)), "🙂 🙂🙂 the " * 30]


def test_base_equals_plain(spark):
    for r, text in zip(judged(spark, TEXTS), TEXTS, strict=True):
        assert tuple(r[c] for c in COLUMNS[1:]) == plain(text), text


@settings(max_examples=8, deadline=None)
@given(st.lists(st.text(alphabet="ab \n|", max_size=60), min_size=1, max_size=20))
def test_base_on_dense_repeats(spark, texts):
    for r, text in zip(judged(spark, texts), texts, strict=True):
        assert tuple(r[c] for c in COLUMNS[1:]) == plain(text), text


def test_thresholds(spark):
    good = " ".join(f"the word{i} of item{i * 3}" for i in range(40))
    texts = [good, good.replace("word", "$$"), good.replace("the", "!!!"), "\n".join(f"q{i} | r{i} | s{i}" for i in range(60)),
             " ".join(f"zz{i}" for i in range(100)), " ".join(f"the {'x' * 60}{i}" for i in range(60)),
             "\n".join([f"the line of text {i}" for i in range(20)] + ["the same old end of it all"] * 25)]
    broken = [set(filter(None, r["broken"].split(","))) for r in judged(spark, texts)]
    assert broken[0] == set() and "symbols" in broken[1] and "exclamations" in broken[2]
    assert {"symbols", "table lines"} <= broken[3] and broken[4] == {"stop words"} and "word length" in broken[5] and "repeated lines" in broken[6]
    kept = [r["kept"] for r in judged(spark, texts)]
    assert kept == [True] + [False] * 6


def test_other_tables_of_rules(spark):
    rules = [Q.Threshold("short", "n_words", least=3), Q.Threshold("bars", "n_bar_lines", "n_lines", most=0.5), Q.Threshold("open", "n_words")]
    rows = judged(spark, ["a b", "a b c", "a | b\nc", None], rules)
    assert [r["broken"] for r in rows] == ["short", "", "", "short"]      # a value on a bound passes
    assert [r["broken"] for r in judged(spark, ["a b"], [])] == [""]
    with pytest.raises(ValueError):
        judged(spark, ["a"], [Q.Threshold("x", "no_such")])


def test_rows_columns_and_long_texts(spark):
    long = " ".join(f"the of w{i % 50_000}" for i in range(200_000))       # 600,000 words
    rows = [(1, "a b c", 5, "k"), (1, "a b c", 5, "k"), (None, "x", None, None), (2, long, 0, "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_words long, kept string")
    out = Q.judge(df)
    assert multiset(r["n_words"] for r in out.collect()) == multiset([3, 3, 1, 600_000])
    big = out.where("doc_id = 2").first()
    assert big["n_repeat_words"] == 600_000 and big["base_failed"]
    empty = Q.judge(df.limit(0))
    assert empty.count() == 0 and empty.columns == COLUMNS + ["kept", "broken"]


def test_one_projection(spark):
    plan = Q.judge(spark.range(3).selectExpr("id AS doc_id", "cast(id AS string) AS text"))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan and "UDF" not in plan


def test_labelled_documents(spark):
    """Clean labelled documents that pass the base test stay, labelled junk goes."""
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").join(spark.read.parquet("/root/testdata/sf0.01/labels.parquet").select("doc_id", "quality"), "doc_id")
    out = Q.judge(d).where("NOT base_failed").join(d.select("doc_id", "quality"), "doc_id").groupBy("quality", "kept").count().collect()
    n = {(r["quality"], r["kept"]): r["count"] for r in out}
    assert n.get((1, False), 0) == 0 and n.get((0, True), 0) == 0 and n[1, True] > 200 and n[0, False] > 10
