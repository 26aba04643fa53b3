from provrank.llm.url_filter import RuleTrie, judge


def test_longest_rule_wins_and_hosts_end_at_labels():
    t = RuleTrie(block=["net/", "example.com/de/"], allow=["example.net/en/", "org/fr/"])
    assert t.match("a.example.net", "/en/1") == ("example.net/en/", "allow")
    assert t.match("example.net", "/de/1") == ("net/", "block")
    assert t.match("evil-net", "/x") == (None, "allow")
    assert t.match("x.net", "") == (None, "allow")
    assert t.match("badexample.com", "/de/x") == (None, "allow")
    assert t.match("www.example.com", "/de/x") == ("example.com/de/", "block")
    assert t.match("www.example.com", "/de") == (None, "allow")


def test_partial_last_segment_and_equal_rules():
    t = RuleTrie(block=["a.org/x/pre", "b.org/"], allow=["b.org/"])
    assert t.match("a.org", "/x/prefix/y")[0] == "a.org/x/pre"
    assert t.match("a.org", "/x/pr") == (None, "allow")
    assert t.match("b.org", "/") == ("b.org/", "block")


def test_of_equally_long_rules_the_one_with_fewer_host_labels_wins():
    for block, allow in ((["b.com/"], ["com/ab"]), (["com/ab"], ["b.com/"])):
        assert RuleTrie(block, allow).match("b.com", "/abc") == ("com/ab", "allow" if "com/ab" in allow else "block")


def test_very_long_urls():
    t = RuleTrie(block=["net/" + "x/" * 5000])
    assert t.match("a." * 20_000 + "net", "/" + "x/" * 5000 + "y")[1] == "block"
    assert t.match("a.net", "/" + "x/" * 4999)[1] == "allow"


def test_against_brute_force():
    import random

    r = random.Random(3)
    labels, segs = ["a", "b", "net"], ["", "x", "xy", "y"]
    rules = {".".join(r.choices(labels, k=r.randint(1, 3))) + "/" + "/".join(r.choices(segs, k=r.randint(1, 3))) for _ in range(40)}
    rules = sorted(rules)
    t = RuleTrie(block=rules[::2], allow=rules[1::2])
    for _ in range(3000):
        host = ".".join(r.choices(labels, k=r.randint(1, 4)))
        path = "/" + "/".join(r.choices(segs, k=r.randint(1, 4)))
        fit = [x for x in rules if (host == x.split("/")[0] or host.endswith("." + x.split("/")[0])) and path.startswith("/" + x.split("/", 1)[1])]
        got = t.match(host, path)[0]
        assert (len(got) if got else 0) == max(map(len, fit), default=0)
        assert got is None or got in fit


def test_frame_edges(spark):
    rows = [(1, "HTTP://WWW.Example.NET/en/A?q#f", "old"), (2, None, None), (3, "no scheme", None), (4, "", None), (4, "", None), (5, "x://É.net/p", None), (6, "http://a.net?x=/", None)]
    df = spark.createDataFrame(rows, "page_id long, url string, Host string")
    out = {r.page_id: r for r in judge(df, RuleTrie(block=["net/"], allow=["example.net/en/"])).collect()}
    assert out[1].host == "www.example.net" and out[1].path == "/en/A" and out[1].rule == "example.net/en/"
    assert out[2].host == out[2].path == out[3].host == out[4].host == "" and out[2].verdict == "allow"
    assert out[5].host == "É.net" and out[5].verdict == "block"
    assert out[6].path == "" and out[6].rule is None
    assert judge(df.limit(0), RuleTrie()).count() == 0
    assert judge(df, RuleTrie()).count() == len(rows)
