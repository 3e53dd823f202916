from pyspark.sql import functions as F

from tidewright.llm import url_filter as uf

URLS = [
    "http://A.Net/x", "http://a.net", "https://www.example.net/en/1?q", "https://example.net/en", "http://xexample.net/en/", "http://example.com/de/", "http://example.com/DE/",
    "http://m.spam-farm.example.com/en/", "http://spam-farm.example.com/de/1", "http://good.example.com/en", "ftp://q.org/fr/#x", "no url", None, "", "http://", "x://y?z://w/", "http://org/fr/", "http://é.org/fr/",
]


def brute(url):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
        host, rest = rest[:cut], rest[cut:]
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
        path = rest[: min([rest.find(c) for c in "?#" if c in rest] or [len(rest)])]
    fit = [(h + p, v) for h, p, v in uf.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    if fit:
        rule, verdict = max(fit, key=lambda r: len(r[0]))
        return host, path, rule, verdict
    return host, path, None, "block" if any(f".{s}." in f".{host}" for s in uf.LISTED_SITES) else "allow"


def test_verdicts_match_brute_force(spark):
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(URLS * 2)], "page_id long, url string").withColumns({"rule": F.lit("clash"), "key": F.lit(1)})
    for r in uf.url_filter(pages).collect():
        assert (r.host, r.path, r.rule, r.verdict) == brute(URLS[r.page_id % len(URLS)])


def test_cascade_is_exact_over_its_universe(spark):
    universe = spark.range(20_000).select(F.concat(F.lit("host"), "id").alias("key"), (F.col("id") % 17 == 3).alias("listed"))
    levels = uf.build_cascade(universe)
    assert len(levels) > 2
    wrong = uf._tested(universe, levels).where((F.col("_depth") % 2 == 1) != F.col("listed"))
    assert wrong.count() == 0


def test_cascade_of_many_parts_is_exact(spark):
    universe = spark.range(6_000).select(F.concat(F.lit("host"), "id").alias("key"), (F.col("id") % 5 == 3).alias("listed"))
    levels = uf.build_cascade(universe, part_bytes=100)
    assert len(levels[0].bits) * 8 // levels[0].part > 5
    assert len(levels[0].bits) <= 1.1 * 1200 * 4 / 8 and len(levels) < 20
    wrong = uf._tested(universe, levels).where((F.col("_depth") % 2 == 1) != F.col("listed"))
    assert wrong.count() == 0


def test_join_beyond_the_bound(spark):
    rows = spark.range(3000).select(F.concat(F.lit("h"), F.col("id") % 1000).alias("k"))
    listed = spark.range(500).select(F.concat(F.lit("h"), "id").alias("key"))
    got = uf.listed_mask(rows, "k", listed, most_bytes=16)
    assert got.where("listed").count() == 1500 and got.count() == 3000


def test_null_keys_empty_lists_and_tables(spark):
    rows = spark.createDataFrame([("a",), (None,)], "k string")
    none = spark.createDataFrame([], "key string")
    assert uf.listed_mask(rows, "k", none).where("listed").count() == 0
    assert uf.listed_mask(rows, "k", spark.createDataFrame([("a",), (None,)], "key string")).where("listed").count() == 1
    assert uf.url_filter(spark.createDataFrame([], "page_id long, url string")).count() == 0
