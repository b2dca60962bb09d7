from pyspark.sql import functions as F

from wattframe.llm.urls import RULES, build_cascade, judge_urls, rule_table


def brute(url):
    at = (url or "").find("://")
    rest = url[at + 3:] if at >= 0 else ""
    cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
    host, path = rest[:cut], rest[cut:]
    path = path[:min([path.find(c) for c in "?#" if c in path] or [len(path)])]
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = [(len(h + p), h + p, v) for v, h, p in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    _, rule, verdict = max(fits, default=(0, None, "allow"))
    return host, path, rule, verdict


URLS = [
    None, "", "://", "http://", "HTTP://WWW.Example.COM/en/x?y#z", "http://example.com/en/", "http://example.com/en", "http://xexample.com/en/1", "https://a.b.net/es/q", "x://net/fr/",
    "net/fr/", "http://net?/es/", "http://u:p@m.example.com:80/en/", "http://com/", "http://com", "http://.com/", "http://a..com/x", "http://É.COM/en/", "http://example.com/en/a://b.net/es/",
    "http://" + "a." * 20_000 + "net/es/" + "x" * 50_000, "http://b.net/es/\n?", "http://b.net/es/", "http://b.net/es/",
]


def test_rules(spark):
    pages = spark.createDataFrame([(i, u, "h", "clash") for i, u in enumerate(URLS)], "page_id long, url string, html string, key string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in judge_urls(pages, rule_table(spark)).collect()}
    assert got == {i: brute(u) for i, u in enumerate(URLS)}
    assert judge_urls(pages.limit(0), rule_table(spark)).count() == 0
    assert judge_urls(pages.where("page_id IS NULL"), rule_table(spark).limit(0)).count() == 0


def test_cascade_is_exact_over_its_universe(spark):
    keys = spark.range(20_000).select(F.concat(F.lit("k"), F.col("id")).alias("key"))
    listed = keys.where(F.crc32(F.encode("key", "UTF-8")) % 7 == 0)
    cascade = build_cascade(keys.unionByName(keys), listed)
    assert len(cascade.levels) > 2
    found = keys.where(cascade.holds(F.col("key")))
    assert found.exceptAll(listed).isEmpty() and listed.exceptAll(found).isEmpty()
    assert not build_cascade(keys, listed.limit(0)).levels
