from tabscope.llm import url_filter
from tabscope.llm.queries import URL_RULES, URL_SQL, url_verdicts
from tests.compare import connection, difference

URLS = [
    None, "", "no scheme", "http://", "http://COM/", "https://www.Example.com/en/1?x=/es/", "http://example.com/en", "http://a.b.example.com/en/x", "http://xexample.com/en/",
    "http://news.net/es/9#f", "http://net/fr/", "http://m.net/esx", "http://x.org/en/?u=http://net/es/", "ftp://com?x", "://com/x", "http://user@www.example.com/en/", "http://a..com/", "x" * 5000 + "://q.com/",
]


def plain(url):
    at = (url or "").find("://")
    rest = url[at + 3 :] if at >= 0 else ""
    cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host = rest[:cut].translate({i: i + 32 for i in range(65, 91)})
    path = rest[cut:]
    path = path[: min([path.find(c) for c in "?#" if c in path], default=len(path))]
    fits = [r for r in URL_RULES if (host == r[0] or host.endswith("." + r[0])) and path.startswith(r[1])]
    best = max(fits, key=lambda r: (len(r[0]), len(r[1])), default=None)
    return host, path, best and best[0] + best[1], best[2] if best else "allow"


def test_same_verdicts_as_trying_all_rules(spark):
    rules = spark.createDataFrame([*URL_RULES, (None, "/", "block"), ("x.org", None, "block")], "host string, path string, verdict string")
    pages = spark.createDataFrame([(i, u, "h") for i, u in enumerate(URLS)] + [(None, "http://a.com/", "p"), (7, URLS[7], "q")], "page_id bigint, url string, host string")
    got = sorted(map(repr, map(tuple, url_filter.filter_urls(pages, rules).collect())))
    want = [(i, *plain(u)) for i, u in enumerate(URLS)] + [(None, *plain("http://a.com/")), (7, *plain(URLS[7]))]
    assert got == sorted(map(repr, want))
    assert url_filter.filter_urls(pages.limit(0), rules).count() == 0
    assert {r.verdict for r in url_filter.filter_urls(pages, rules.limit(0)).collect()} == {"allow"}


def test_many_rules_and_no_python(spark):
    rules = spark.range(3000).selectExpr("concat('h', id, '.org') AS host", "concat('/', id % 7, '/') AS path", "'block' AS verdict")
    pages = spark.range(6000).selectExpr("id AS page_id", "concat('http://w.h', id, '.org/', id % 5, '/x') AS url")
    out = url_filter.filter_urls(pages, rules)
    assert out.filter("verdict = 'block'").count() == sum(i % 7 == i % 5 for i in range(3000))
    assert "Python" not in out._jdf.queryExecution().executedPlan().toString()


def test_bloom_filter_has_no_false_negatives(spark):
    rules = spark.range(500).selectExpr("concat('h', id) AS rule_host", "'/' AS rule_path")
    blocks = url_filter.bloom_blocks(rules, 100)
    assert blocks.count() <= 100
    key = url_filter.F.concat("rule_host", "rule_path")
    hit = rules.withColumn("block", url_filter._block(key, 100)).join(blocks, "block").filter(url_filter.F.col("word").bitwiseAND(url_filter._mask(key)) == url_filter._mask(key))
    assert hit.count() == 500


def test_registered_query(spark, sf):
    assert difference(spark, sf, "op9_url_filter", url_verdicts, URL_SQL, connection(sf)) is None


def test_other_capitals_stay_as_they_are(spark):
    """Only A-Z are lowered, on both sides."""
    urls = spark.createDataFrame([(1, "http://\u00c9x.org/a"), (2, "http://WWW.\u00c9X.org/a"), (3, "http://\u00e9x.org/a")], "page_id bigint, url string")
    rules = spark.createDataFrame([("\u00c9X.ORG", "/", "block")], "host string, path string, verdict string")
    got = {r.page_id: r.verdict for r in url_filter.filter_urls(urls, rules).collect()}
    assert got == {1: "block", 2: "block", 3: "allow"}
