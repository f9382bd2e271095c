import random
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from stopwise.llm import queries, url_rules

URLS = [
    None,
    "",
    "no scheme/com/",
    "http://",
    "http:///path",
    "HTTPS://WWW.Example.COM/en/1?x=/fr/#a",
    "http://example.com/en/",
    "http://example.com/EN/",
    "http://a.b.example.com/en/x",
    "http://badexample.com/en/x",
    "http://shop.net/es/1",
    "http://net/fr/",
    "http://net/fr",
    "http://subnet/fr/",
    "http://x.com",
    "http://x.com?y://z.net/es/",
    "http://x.org#://q",
    "http://x.com:80/",
    "http://É.com/ñ\nz/a",
    "a://b://c.com/d",
]


def _parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    end = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:end])
    rest = rest[end:]
    return host, rest[: min([rest.find(c) for c in "?#" if c in rest] or [len(rest)])]


def _rule(host, path):
    fits = [
        (len(h + p), h + p, v)
        for v, h, p in queries.HOST_RULES
        if (host == h or host.endswith("." + h)) and path.startswith(p)
    ]
    return max(fits)[1:] if fits else (None, None)


def _no_rules(spark):
    return spark.createDataFrame([], "tokens array<string>, confidence double, lift double, support double, rule_id long")


def test_hosts_paths_and_rules(spark):
    df = spark.createDataFrame([(i, u, "x", "y") for i, u in enumerate(URLS)], "page_id long, url string, host string, verdict string")
    found = {r["page_id"]: r for r in url_rules.judge(df, _no_rules(spark), queries.HOST_RULES).collect()}
    assert len(found) == len(URLS)
    for i, url in enumerate(URLS):
        host, path = _parts(url)
        rule, verdict = _rule(host, path)
        got = found[i]
        assert (got["host"], got["path"], got["rule"], got["verdict"]) == (host, path, rule, verdict or "allow"), url


def test_whole_table(spark):
    sf = "/root/testdata/sf0.01"
    pages = {r["page_id"]: r["url"] for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    rows = queries.op6_url_filter(spark, sf).collect()
    assert len(rows) == len(pages)
    for r in rows:
        host, path = _parts(pages[r["page_id"]])
        rule, verdict = _rule(host, path)
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule)
        assert r["verdict"] == verdict if verdict else r["verdict"] in ("allow", "block")


def _labelled(seed=3, n=400):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        site, lang, ending = rng.choice(["good", "mixed", "spam"]), rng.choice(["en", "fr"]), rng.choice(["", ".html"])
        bad = site == "spam" or (site == "mixed" and lang == "fr")
        rows.append((i, f"http://{site}.example.org/{lang}/{rng.randint(1, 99)}{ending}", bad if rng.random() < 0.9 else not bad))
    return rows


def _brute_rules(baskets, least_rows, confidence, lift):
    """All token sets with enough rows and confidence, less those that hold a
    shorter rule of no less confidence."""
    base = sum(b for _, b in baskets) / len(baskets)
    tokens = sorted({t for s, _ in baskets for t in s})
    found = {}
    for size in range(1, 6):
        for chosen in combinations(tokens, size):
            rows = [b for s, b in baskets if set(chosen) <= s]
            if rows and sum(rows) >= least_rows and sum(rows) / len(rows) >= confidence and sum(rows) / len(rows) / base >= lift:
                found[chosen] = sum(rows) / len(rows)
    return {
        c: v for c, v in found.items() if not any(set(d) < set(c) and w >= v for d, w in found.items())
    }


def test_mining_equals_brute_force(spark):
    df = spark.createDataFrame(_labelled(), "page_id long, url string, blocked boolean")
    baskets = [
        (set(r["t"]), r["blocked"]) for r in df.select(url_rules.url_tokens(F.col("url")).alias("t"), "blocked").collect()
    ]
    common = set.intersection(*(s for s, _ in baskets))
    rules = url_rules.mine_rules(df, min_confidence=0.7, min_rows=30).collect()
    expected = _brute_rules([(s - common, b) for s, b in baskets], 30, 0.7, 1.2)
    # Tokens that all rows have add nothing: no rule with them is kept.
    found = {tuple(r["tokens"]): r["confidence"] for r in rules}
    by_rows = lambda tokens: frozenset(i for i, (s, _) in enumerate(baskets) if set(tokens) <= s)
    assert {by_rows(t) for t in found} == {by_rows(t) for t in expected}
    assert {by_rows(t): round(c, 9) for t, c in found.items()} == {by_rows(t): round(c, 9) for t, c in expected.items()}


def test_matching_equals_brute_force(spark):
    df = spark.createDataFrame(_labelled(), "page_id long, url string, blocked boolean")
    rules = url_rules.mine_rules(df, min_confidence=0.7, min_rows=30)
    listed = [(set(r["tokens"]), r["confidence"]) for r in rules.collect()]
    assert listed
    rows = url_rules.judge(df, rules, []).collect()
    tokens = {r["url"]: set(r["t"]) for r in df.select("url", url_rules.url_tokens(F.col("url")).alias("t")).collect()}
    for r in rows:
        best = max((c for t, c in listed if t <= tokens[r["url"]]), default=None)
        assert (r["confidence"], r["verdict"]) == (best, "allow" if best is None else "block")
    assert len(rows) == 400 and {r["verdict"] for r in rows} == {"allow", "block"}


@pytest.mark.parametrize("rows", [[], [("http://a.org/x", None)], [(None, True)], [("http://a.org/x", False)] * 30])
def test_nothing_to_mine(spark, rows):
    df = spark.createDataFrame(rows, "url string, blocked boolean")
    rules = url_rules.mine_rules(df)
    assert rules.count() == 0
    judged = url_rules.judge(df.withColumn("page_id", F.lit(None).cast("long")), rules, [])
    assert judged.filter("verdict = 'allow'").count() == len(rows)


def test_long_urls_have_few_tokens(spark):
    url = "http://" + "a." * 3000 + "org/" + "seg/" * 5000 + "?" + "&".join(f"k{i}=1" for i in range(3000))
    df = spark.createDataFrame([(url, True)] * 40, "url string, blocked boolean")
    assert len(df.select(url_rules.url_tokens(F.col("url"))).first()[0]) <= 9
    assert url_rules.mine_rules(df, min_lift=1.0).count() > 0


def test_plan_is_native(spark):
    df = spark.createDataFrame(_labelled(), "page_id long, url string, blocked boolean")
    plan = url_rules.judge(df, url_rules.mine_rules(df), queries.HOST_RULES)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


@pytest.mark.parametrize(
    ("bad", "good"),
    [
        ("http://a.org/en/casino/{}", "http://a.org/en/garden/{}"),
        ("http://a.org/x?id={}&ref=spam", "http://a.org/x?id={}&ref=mail"),
        ("http://www.bets.shop.a.org/{}", "http://www.tea.shop.a.org/{}"),
        ("http://a.org/1/2/3/4/5/6/7/{}", "http://a.org/1/2/3/4/5/6/7/8/{}"),
        ("http://a.org/{}.torrent", "http://a.org/{}.html"),
        ("ftp://a.org/{}", "http://a.org/{}"),
        ("http://a.org/{}#win", "http://a.org/{}#top"),
    ],
)
def test_all_parts_are_mined_and_matched(spark, bad, good):
    rows = [(i, (bad if i % 3 == 0 else good).format(i), i % 3 == 0) for i in range(120)]
    df = spark.createDataFrame(rows, "page_id long, url string, blocked boolean")
    judged = {r["page_id"]: r["verdict"] for r in url_rules.judge(df, url_rules.mine_rules(df), []).collect()}
    assert judged == {i: "block" if b else "allow" for i, _, b in rows}


def test_tokens_of_the_same_rows_stand_for_each_other(spark):
    rows = [(i, f"http://a.org/casino/{i}?ref=spam" if i % 3 == 0 else f"http://a.org/{i}", i % 3 == 0) for i in range(120)]
    rules = url_rules.mine_rules(spark.createDataFrame(rows, "page_id long, url string, blocked boolean"))
    urls = ["http://b.net/casino", "http://b.net/x?ref=y", "http://b.net/x?z=spam", "http://b.net/x"]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    judged = {r["url"]: r["verdict"] for r in url_rules.judge(df, rules, []).collect()}
    assert [judged[u] for u in urls] == ["block", "block", "block", "allow"]


def test_many_tokens_of_the_same_rows(spark):
    path = "/".join("abcdefghijklmnopqrstuvwxyz")
    rows = [(f"http://a.org/{path}" if i % 2 else "http://b.org/x", i % 2 == 1) for i in range(80)]
    rules = url_rules.mine_rules(spark.createDataFrame(rows, "url string, blocked boolean")).collect()
    assert max(len(c) for r in rules for c in r["classes"]) >= 26


def test_mined_rules_decide_on_the_given_table(spark):
    """Some rule is mined there, and every verdict follows from host rules and mined ones."""
    sf_dir = "/root/testdata/sf0.1"
    rules = queries.mined_url_rules(spark, sf_dir).collect()
    assert rules and all(r["confidence"] >= queries.URL_CONFIDENCE and r["lift"] >= url_rules.MIN_LIFT for r in rules)
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    tokens = {r["page_id"]: set(r["t"]) for r in pages.select("page_id", url_rules.url_tokens(pages["url"]).alias("t")).collect()}
    judged = queries.op6_url_filter(spark, sf_dir).collect()
    assert len(judged) == len(tokens)
    classes = [[set(c) for c in r["classes"]] for r in rules]
    changed = 0
    for r in judged:
        if r["rule"] is None:
            fits = any(all(c & tokens[r["page_id"]] for c in rule) for rule in classes)
            assert r["verdict"] == ("block" if fits else "allow")
            changed += fits
    assert changed > 0
