import pytest
from pyspark.sql import functions as F

from geoweft.llm import warc

SCHEMA = warc.RECORD
DAY = warc.DAY


def resolve(spark, rows):
    return {r.record_id: r for r in warc.resolve_revisits(spark.createDataFrame(rows, SCHEMA)).collect()}


def full(name, date, url="http://a.org/x", tag='"1"', digest="d", **extra):
    return (name, url, date, "response", 200, {"ETag": tag, "Content-Type": "text/html", "Content-Length": "10", **extra}, digest)


def revisit(name, date, url="http://a.org/x", tag='"1"', digest=None, **extra):
    return (name, url, date, "revisit", 304, ({"ETag": tag} if tag else {}) | extra, digest)


def test_latest_earlier(spark):
    got = resolve(spark, [full("f1", 10), full("f2", 20), full("f3", 30), revisit("r1", 20), revisit("r2", 21), revisit("r3", 10), revisit("r4", 3 * DAY + 5), full("f4", 2 * DAY), full("f5", 2 * DAY)])
    assert {k: r.source_record_id for k, r in got.items() if r.type == "revisit"} == {"r1": "f1", "r2": "f2", "r3": None, "r4": "f5"}
    assert got["r3"].resolution == "missing" and got["f1"].resolution == "full" and got["r1"].status == 200


def test_validators(spark):
    got = resolve(
        spark,
        [
            full("f", 1, **{"Last-Modified": "Mon"}), revisit("same", 2, tag='W/"1"'), revisit("other", 2, tag='"2"'), revisit("none", 2, tag=None),
            revisit("date", 2, tag=None, **{"Last-Modified": "Mon"}), revisit("later", 2, tag=None, **{"last-modified": "Tue"}), revisit("digest", 2, digest="e"), revisit("digest ok", 2, tag=None, digest="d"),
        ],
    )
    assert {k: r.resolution for k, r in got.items()} == {
        "f": "full", "same": "resolved", "other": "mismatch", "none": "unverified", "date": "resolved", "later": "mismatch", "digest": "mismatch", "digest ok": "resolved",
    }


def test_headers(spark):
    got = resolve(spark, [full("f", 1, **{"Cache-Control": "a", "X-Old": "o"}), revisit("r", 2, **{"cache-control": "b", "Content-Length": "0", "X-New": "n"})])
    assert got["r"].headers == {"etag": '"1"', "content-type": "text/html", "content-length": "10", "cache-control": "b", "x-old": "o", "x-new": "n"}


@pytest.mark.parametrize(
    ("url", "canonical"),
    [
        ("HTTPS://WWW.A.org:443/Path/?utm_source=x&b=1&ref=q#frag", "www.a.org/Path/?b=1"), ("http://m.a.org:80/x/", "m.a.org/x"), ("a.org", "a.org"), ("http://a.org?ref=1", "a.org"), ("", ""), (None, ""),
        ("http://a.org:8080/x", "a.org:8080/x"), ("http://a.org/?a=1&&b=2&", "a.org/?a=1&b=2"),
    ],
)
def test_canonical(spark, url, canonical):
    assert spark.createDataFrame([(url,)], "u string").select(warc.canonical_url(F.col("u")).alias("c")).first()["c"] == canonical


def test_host_prefixes(spark):
    one = spark.createDataFrame([("http://WWW.a.org/x",)], "u string")
    assert one.select(warc.canonical_url(F.col("u"), ("www", "m")).alias("c")).first()["c"] == "a.org/x"


def test_only_full_responses_are_resolved_to(spark):
    answer = lambda name, date, status: (name, "http://a.org/x", date, "response", status, {"ETag": '"1"'}, "d")
    got = resolve(spark, [answer("ok", 1, 200), answer("gone", 2, 404), answer("moved", 3, 301), answer("part", 4, 206), answer("null", 5, None), revisit("r", 6), revisit("other", 6, url="http://www.a.org/x")])
    assert {k: (r.resolution, r.status, r.source_record_id) for k, r in got.items()} == {
        "ok": ("full", 200, None), "gone": ("other", 404, None), "moved": ("other", 301, None), "part": ("other", 206, None), "null": ("other", None, None),
        "r": ("resolved", 200, "ok"), "other": ("missing", 304, None),
    }


def test_odd_rows(spark):
    got = resolve(spark, [("n", None, None, "revisit", 304, None, None), ("m", None, 5, "response", 200, None, None), ("o", None, 6, "revisit", 304, None, None), revisit("r", 9), full("f", 8), full("f", 8)])
    assert got["n"].resolution == "missing" and got["o"].source_record_id == "m" and got["o"].resolution == "unverified" and got["r"].source_record_id == "f"
