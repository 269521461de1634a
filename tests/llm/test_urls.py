import random

from relflow.llm import urls

URLS = [None, "", "no scheme", "http://", "http://net", "http://net/", "https://WWW.Example.NET/en/x?y#z", "https://example.net/de/", "x://a.example.com/de/1",
        "x://example.com/fr/", "x://foo.org/fr/", "x://org/fr", "x://notexample.net", "http://a..net/x", "http://net?x/", "http://É.net/#", "://net/",
        "http://user@net:80/", "http://" + "a." * 500 + "net/" + "p" * 5000, "http://xnet/", "http://net//en/"]


def plain(url, rules, default="allow"):
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([rest.find(c) for c in "/?#" if c in rest] + [len(rest)])
        host, rest = rest[:cut].translate(str.maketrans(urls._UPPER, urls._LOWER)), rest[cut:]
        cut = min([rest.find(c) for c in "?#" if c in rest] + [len(rest)])
        path = rest[:cut]
    fits = [(len(h + p), len(h), v == "block", h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return host, path, best and best[3], best[4] if best else default


def check(spark, url_list, rules, **opt):
    df = spark.createDataFrame([(i, u, "x") for i, u in enumerate(url_list)], "page_id long, url string, html string")
    made = urls.url_filter(df, urls.rule_table(spark, rules), **opt)
    out = made.judge(df).collect()
    assert len(out) == len(url_list)
    for r in out:
        assert (r["host"], r["path"], r["rule"], r["verdict"]) == plain(url_list[r["page_id"]], rules, **opt), url_list[r["page_id"]]
    return made


def test_fixed_rules(spark):
    check(spark, URLS + URLS, urls.RULES)
    check(spark, URLS, urls.RULES, default="block")


def test_cascade_is_exact_for_many_rules(spark):
    r = random.Random(4)
    hosts = [f"h{r.randrange(300)}.d{r.randrange(60)}.net" for _ in range(900)]
    paths = ["/", "/a/", "/a/b", "/c/long/path/", ""]
    rules = sorted({(r.choice([h, h.split(".", 1)[1]]), r.choice(paths), r.choice(["block", "allow"])) for h in hosts[:300]})
    rules = [x for i, x in enumerate(rules) if i == 0 or x[:2] != rules[i - 1][:2]] + [("never.seen", "/", "block")]
    made = check(spark, [f"http://{h}{r.choice(paths)}{r.choice(['', 'x', '?q'])}" for h in hosts], rules)
    assert len(made.block.levels) > 2       # false positives did occur and were encoded


def test_conflict_blocks_and_empty_inputs(spark):
    both = (("net", "/", "allow"), ("net", "/", "block"))
    check(spark, ["http://net/"], both)
    check(spark, [], urls.RULES)
    check(spark, URLS, ())
