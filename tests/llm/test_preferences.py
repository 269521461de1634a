import random

from relflow.llm import preferences

SCHEMA = "pair_id long, side string, turn long, role string, text string, prompt string"


def plain(rows):
    out = {}
    pairs = {}
    for p, side, turn, role, text, _ in rows:
        if side in ("chosen", "rejected"):
            pairs.setdefault(p, {"chosen": [], "rejected": []})[side].append((turn, role or "user", text or ""))
    for p, s in pairs.items():
        c, r = ([t[1:] for t in sorted(s[k], key=lambda t: (t[0] is not None, t[0] or 0, *t[1:]))] for k in ("chosen", "rejected"))
        n = 0
        while n < min(len(c), len(r)) and c[n] == r[n]:
            n += 1
        res = [n, "".join(f"<|im_start|>{a}\n{t}<|im_end|>\n" for a, t in c[:n])]
        for side in (c[n:], r[n:]):
            text, spans = "", []
            for a, t in side:
                text += f"<|im_start|>{a}\n"
                if a == "assistant":
                    spans.append((len(text), len(text) + len(t) + len("<|im_end|>")))
                text += f"{t}<|im_end|>\n"
            res += [text, spans]
        out[p] = res
    return out


def check(spark, rows):
    got = preferences.format_pairs(spark.createDataFrame(rows, SCHEMA)).collect()
    got = {r["pair_id"]: [r["n_common"], r["prompt"], r["chosen"], [tuple(s) for s in r["chosen_spans"]], r["rejected"], [tuple(s) for s in r["rejected_spans"]]] for r in got}
    assert got == plain(rows)


def test_edge_pairs(spark):
    def conv(p, side, *turns):
        return [(p, side, i, role, text, "x") for i, (role, text) in enumerate(turns)]
    u, a = ("user", "é😀 hi"), ("assistant", "yes")
    rows = conv(1, "chosen", u, a) + conv(1, "rejected", u, ("assistant", "no"))
    rows += conv(2, "chosen", u, a) + conv(2, "rejected", u, a)                       # equal
    rows += conv(3, "chosen", u, a, u) + conv(3, "rejected", u)                       # prefix of the other
    rows += conv(4, "chosen", a) + conv(4, "rejected", u)                             # nothing in common
    rows += conv(5, "chosen", u, a)                                                   # one side only
    rows += conv(None, "chosen", u) + conv(None, "rejected", a)
    rows += conv(6, "other", u) + conv(7, None, u)
    rows += conv(8, "chosen", (None, None), ("assistant", None)) + conv(8, "rejected", ("user", ""), ("assistant", "w " * 60000))
    rows += [(9, "chosen", 1, "user", "b", "x"), (9, "chosen", 1, "user", "a", "x"), (9, "chosen", None, "system", "s", "x"),
             (9, "rejected", 0, "system", "s", "x"), (9, "rejected", 2, "user", "a", "x"), (9, "rejected", 2, "user", "a", "x")]
    random.Random(1).shuffle(rows)
    check(spark, rows)


def test_random_pairs(spark):
    r = random.Random(2)
    rows = []
    for p in range(60):
        same = r.randint(0, 5)
        base = [(r.choice(["user", "assistant", "system"]), r.choice("abc")) for _ in range(8)]
        for side in ("chosen", "rejected"):
            turns = base[:same] + [(r.choice(["user", "assistant"]), r.choice("abcd")) for _ in range(r.randint(0, 4))]
            rows += [(p, side, i, role, text, None) for i, (role, text) in enumerate(turns)]
    r.shuffle(rows)
    check(spark, rows)


def test_empty_table(spark):
    assert preferences.format_pairs(spark.createDataFrame([], SCHEMA)).count() == 0
