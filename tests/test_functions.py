"""Golden values of the scalar functions."""

import pytest
from pyspark.sql import functions as F

from siftline import functions as N
from siftline.operators.chunks import estimate_chunk_count, estimate_merge_ms
from siftline.plans.stats import JobStats, Phase, progress_percentage


def values(spark, column, rows):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, x string")
    return [r[0] for r in df.select("i", column.alias("y")).orderBy("i").select("y").collect()]


URLS = {
    "https://example.com/": "example.com",
    "http://test.com": "test.com",
    "android://com.app@data": "com.app",
    "ftp://files.com/": "files.com",
    "plain.com": "plain.com",
    "HTTPS://WWW.Example.COM/Path": "www.example.com/path",
    "http://SUB.DOMAIN.ORG:8080/path?query": "sub.domain.org:8080/path?query",
    "HTTPS://SITE.NET/": "site.net",
    "android://com.app.package@HOST.COM": "com.app.package",
    "ftp://files.SERVER.NET/path": "files.server.net/path",
    "mailto:user@DOMAIN.COM": "user@domain.com",
    "": "",
    "a//": "a/",
}
HOSTS = {
    "https://www.Example.com/path?query#fragment": "example.com",
    "http://Sub.Domain.com/": "sub.domain.com",
    "android://AbC123@com.example.app/": "com.example.app",
    "https://test.com": "test.com",
    "": "",
    "HTTPS://X.com": "https:",
    "mailto://a@b": "",
    "mailto:a@b": "mailto:a@b",
}


def test_urls(spark):
    assert values(spark, N.normalize_url(F.col("x")), list(URLS)) == list(URLS.values())


def test_hosts(spark):
    assert values(spark, N.normalize_host(F.col("x")), list(HOSTS)) == list(HOSTS.values())


def test_host_limit_is_in_bytes(spark):
    long, wide = values(spark, N.normalize_host(F.col("x")), ["https://" + "a" * 300 + ".com", "https://" + "é" * 200])
    assert long == "a" * 255
    assert wide == "é" * 127 + "�"


def test_many_hosts(spark):
    rows = [f"https://site{i}.example.com/path" for i in range(1000)]
    assert values(spark, N.normalize_host(F.col("x")), rows) == [f"site{i}.example.com" for i in range(1000)]


def test_keys_and_lines(spark):
    df = spark.createDataFrame([("User@Example.com", "password", "example.com", ["extra"]), ("u", "", "", [])], "username string, password string, url string, extra_fields array<string>")
    cols = [F.col(c) for c in df.columns]
    got = df.select(
        N.dedup_key(cols[0], cols[1]).alias("ci"),
        N.dedup_key(cols[0], cols[1], True).alias("cs"),
        N.to_csv_line(*cols).alias("line"),
        N.field_count(cols[2], cols[3]).alias("n"),
        N.estimated_size(*cols).alias("size"),
    ).collect()
    assert tuple(got[0]) == ("user@example.com:password", "User@Example.com:password", "User@Example.com,password,example.com,extra", 4, 16 + 8 + 11 + 5 + 256)
    assert tuple(got[1]) == ("u:", "u:", "u,", 2, 257)


def test_key_collision_is_kept(spark):
    df = spark.createDataFrame([("a:b", "c"), ("a", "b:c")], "u string, p string")
    assert {r[0] for r in df.select(N.dedup_key(F.col("u"), F.col("p"))).collect()} == {"a:b:c"}


def test_places(spark):
    assert values(spark, N.find_last_char(F.col("x"), "@"), ["a@b@c", "abc", ""]) == [3, -1, -1]
    assert values(spark, N.find_char(F.col("x"), "@"), ["a@b@c", "abc", ""]) == [1, -1, -1]
    assert values(spark, N.detect_protocol(F.col("x")), ["http://a", "https://a", "HTTP://a", "mailto://b", "android://"]) == [7, 8, 0, 8, 10]


def test_ascii_lower_leaves_the_rest(spark):
    assert values(spark, N.ascii_lower(F.col("x")), ["ÀBC"]) == ["Àbc"]
    assert values(spark, N.normalize_username(F.col("x")), ["ÀBC"]) == ["àbc"]


def test_trim_takes_all_white_space(spark):
    assert values(spark, N.trim_unicode(F.col("x")), ["　 \t a b \x85", "　", ""]) == ["a b", "", ""]


def test_emails(spark):
    assert values(spark, N.is_email(F.col("x")), ["a@b.c", "a@b", "a b@c.d"]) == [True, False, False]


@pytest.mark.parametrize(("size", "n"), [(0, 1), (1024, 1), (1 << 20, 1), ((1 << 20) + 1, 2), (5 << 20, 5), ((10 << 20) - 1, 10), (10 << 20, 10)])
def test_chunk_estimate(spark, size, n):
    assert spark.range(1).select(estimate_chunk_count(F.lit(size), 1 << 20).alias("n")).first().n == n


def test_merge_estimate(spark):
    assert spark.range(1).select(F.array(*[estimate_merge_ms(F.lit(x)) for x in (0, 3000, 10_000_000)]).alias("n")).first().n == [1000, 1000, 10000]


def test_progress():
    assert progress_percentage(Phase.FILE_PROCESSING, 1, 2) == 40.0
    assert progress_percentage(Phase.FILE_PROCESSING, 0, 0) == 0.0
    assert progress_percentage(Phase.MERGING, 2, 2) == 85.0
    assert progress_percentage(Phase.MERGING, 2, 2, 1, 2) == 87.5
    assert progress_percentage(Phase.COMPLETED, 0, 0) == 100.0
    assert progress_percentage(Phase.FAILED, 1, 1) == 0.0


def test_duplicates_are_total_less_unique():
    assert JobStats(5, 3, 1, 1, 0).duplicates_removed == 2
