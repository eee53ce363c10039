"""Not-modified revisit resolution of web captures.

A revisit (a capture for which the server answered "not modified") has no payload.  It is joined, as of
its date, to the latest earlier full response of the same canonical URL; the validators of both must
agree; and the headers that a not-modified answer may change are merged into the stored ones.

The as-of join is two windows whose partitions are bounded whatever the data: fulls are aggregated to
one per URL and second, the first window runs over one URL and one day (at most 86,400 rows), and the
second over the days of one URL (one row a day).  A hot URL is so many day partitions.

A full response is one whose status is in ``FULL_STATUS``; other answers (redirects, errors, partial content)
are records that nothing resolves to.  Hosts are told apart as they are: ``www.`` and ``m.`` hosts are
other sites unless ``host_prefixes`` names them.

Edge cases: a null or empty URL is a URL of its own; very long URLs and headers are columns like others;
records with null headers have none; a capture without a date resolves nothing and is
never resolved to; among fulls of one second the greatest record id counts; a full of the revisit's own
second is not earlier; repeated rows are resolved each; an empty table gives an empty result; columns
besides those of ``RECORD`` are not read, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import narrow

DAY = 86_400

# Stored headers that a not-modified answer must not change (they describe the payload or one connection).
KEPT_HEADERS = [
    "connection", "content-encoding", "content-length", "content-md5", "content-range", "content-type", "keep-alive",
    "proxy-authenticate", "proxy-authorization", "te", "trailer", "transfer-encoding", "upgrade",
]

# Statuses of a full response.
FULL_STATUS = (200,)

#: Records: the columns that ``resolve_revisits`` needs.
RECORD = "record_id string, url string, date long, type string, status int, headers map<string,string>, payload_digest string"


def canonical_url(url: Column, host_prefixes: tuple[str, ...] = ()) -> Column:
    """Without scheme, fragment, default port, tracking parameters and last slash; host in lower case.

    ``host_prefixes`` (such as ``("www", "m")``) are first labels that do not tell hosts apart.
    """
    u = F.regexp_replace(F.coalesce(url, F.lit("")), "#.*$", "")
    u = F.regexp_replace(u, "^[a-zA-Z][a-zA-Z0-9+.-]*://", "")
    host = F.regexp_extract(u, "^[^/?]*", 0)
    u = F.concat(F.lower(host), F.substr(u, F.length(host) + 1))
    u = F.regexp_replace(u, "^([^/:?]+):(80|443)([/?]|$)", "$1$3")
    if host_prefixes:
        u = F.regexp_replace(u, f"^(?:{'|'.join(host_prefixes)})\\.", "")
    u = F.regexp_replace(u, "([?&])(?:utm_[a-z]+|ref)=[^&]*", "$1")
    u = F.regexp_replace(F.regexp_replace(u, "&&+", "&"), "\\?&", "?")
    return F.regexp_replace(F.regexp_replace(u, "[?&]+$", ""), "/+$", "")


def _lower_keys(headers: Column) -> Column:
    return F.map_from_entries(F.array_sort(F.transform(F.map_entries(headers), lambda e: F.struct(F.lower(e["key"]).alias("key"), e["value"].alias("value")))))


def latest_full(records: DataFrame) -> DataFrame:
    """(canonical_url, date, full): for each URL and second of a revisit, the latest earlier full response."""
    key = ["canonical_url", "date"]
    is_full = (F.col("type") == "response") & F.coalesce(F.col("status").isin(*FULL_STATUS), F.lit(False))
    revisit = F.coalesce(F.col("type") == "revisit", F.lit(False))
    seconds = records.filter("date IS NOT NULL").groupBy(*key).agg(
        F.max(F.when(is_full, F.struct("date", "record_id", "status", "payload_digest", F.map_entries("headers").alias("headers")))).alias("own"),
        F.max(revisit).alias("asks"),
    ).withColumn("day", F.expr(f"date div {DAY}"))
    within = "max(own) OVER (PARTITION BY canonical_url, day ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    days = seconds.groupBy("canonical_url", "day").agg(F.max("own").alias("own"))
    days = days.select("canonical_url", "day", F.expr("max(own) OVER (PARTITION BY canonical_url ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)").alias("before"))
    found = seconds.withColumn("within", F.expr(within)).filter("asks").join(days, ["canonical_url", "day"])
    return found.select(*key, F.coalesce("within", "before").alias("full"))


def _agree(revisit: Column, full: Column, revisit_digest: Column, full_digest: Column) -> Column:
    """True, false, or null where the two have no validator in common."""
    weak = lambda h: F.regexp_replace(F.trim(h["etag"]), "^W/", "")
    tag = weak(revisit) == weak(full)
    modified = F.trim(revisit["last-modified"]) == F.trim(full["last-modified"])
    return F.when(revisit_digest != full_digest, F.lit(False)).otherwise(F.coalesce(tag, modified, revisit_digest == full_digest))


def merge_headers(full: Column, revisit: Column) -> Column:
    """The stored headers, updated by those that a not-modified answer may change."""
    allowed = F.map_filter(revisit, lambda k, _: ~k.isin(*KEPT_HEADERS))
    return F.map_concat(F.map_filter(full, lambda k, _: ~F.array_contains(F.map_keys(allowed), k)), allowed)


def resolve_revisits(records: DataFrame, host_prefixes: tuple[str, ...] = ()) -> DataFrame:
    """All records with ``resolution``: full, resolved, unverified, mismatch, missing, or other (no full response, no revisit).

    Resolved and unverified revisits get the payload digest, the status and the merged headers of their
    full response, named by ``source_record_id``; the others keep what they have.
    """
    rows = narrow(records, "record_id", "url", "date", "type", "status", "headers", "payload_digest").select("record_id", "url", "date", "type", "status", F.coalesce(_lower_keys(F.col("headers")), F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))).alias("headers"), "payload_digest")
    rows = rows.withColumn("canonical_url", canonical_url(F.col("url"), host_prefixes))
    fulls = latest_full(rows).select(F.col("canonical_url").alias("_u"), F.col("date").alias("_d"), "full")
    revisit = F.coalesce(F.col("type") == "revisit", F.lit(False))
    is_full = (F.col("type") == "response") & F.col("status").isin(*FULL_STATUS)
    joined = rows.join(fulls, (F.col("canonical_url") == F.col("_u")) & (F.col("date") == F.col("_d")) & revisit, "left")
    stored = F.map_from_entries(F.col("full.headers"))
    agree = _agree(F.col("headers"), stored, F.col("payload_digest"), F.col("full.payload_digest"))
    resolution = (
        F.when(~revisit & is_full, "full").when(~revisit, "other").when(F.col("full").isNull(), "missing").when(agree, "resolved").when(agree.isNull(), "unverified").otherwise("mismatch")
    )
    joined = joined.withColumn("resolution", resolution)
    good = F.col("resolution").isin("resolved", "unverified")
    return joined.select(
        "record_id", "url", "canonical_url", "date", "type", "resolution",
        F.when(good, F.col("full.record_id")).alias("source_record_id"),
        F.when(good, F.col("full.status")).otherwise(F.col("status")).cast("int").alias("status"),
        F.when(good, F.col("full.payload_digest")).otherwise(F.col("payload_digest")).alias("payload_digest"),
        F.when(good, merge_headers(stored, F.col("headers"))).otherwise(F.col("headers")).alias("headers"),
    )


def header_lines(headers: Column) -> Column:
    """Headers as sorted lines, which can be compared."""
    return F.array_join(F.array_sort(F.transform(F.map_entries(headers), lambda e: F.concat(e["key"], F.lit(": "), e["value"]))), "\n")


def captures_of_pages(pages: DataFrame) -> DataFrame:
    """A capture log of ``pages``: the pages table has no captures, so each page is crawled by a fixed rule.

    A page is fetched in full at first (but for every seventh), revisited two days later by another form
    of its URL, fetched again after three days (every fourth; every third of these is not found) and
    revisited after five days, when the entity tag of every fifth has changed.
    """
    base = 1_600_000_000 + F.col("page_id") * 3600
    html = F.coalesce("html", F.lit(""))
    rows = narrow(pages, "page_id", "url", "html").select("page_id", "url", base.alias("base"), F.sha2(html, 256).alias("digest"), F.octet_length(html).alias("size"))
    rows = rows.withColumn("k", F.explode(F.array(*(F.lit(k) for k in range(4)))))
    rows = rows.filter("NOT (k = 0 AND page_id % 7 = 3) AND NOT (k = 2 AND page_id % 4 <> 1)")
    full = F.col("k").isin(0, 2)
    tag = F.when(F.expr("k = 3 AND page_id % 5 = 0"), F.lit('"changed"')).otherwise(F.concat(F.lit('"'), F.substring("digest", 1, 16), F.lit('"')))
    stored = {"Content-Type": F.lit("text/html"), "Content-Length": F.col("size").cast("string"), "Cache-Control": F.lit("max-age=60"), "ETag": tag}
    answered = {"Content-Length": F.lit("0"), "Cache-Control": F.lit("max-age=3600"), "ETag": F.concat(F.lit("W/"), tag), "X-Cache": F.lit("HIT")}
    entries = lambda d: F.create_map(*(x for k, v in d.items() for x in (F.lit(k), v)))
    return rows.select(
        F.concat_ws("-", F.col("page_id").cast("string"), F.col("k").cast("string")).alias("record_id"),
        F.when(F.col("k") == 1, F.concat(F.regexp_replace("url", "^http:", "https:"), F.lit("#again"))).otherwise(F.col("url")).alias("url"),
        (F.col("base") + F.element_at(F.array(F.lit(0), F.lit(2 * DAY), F.lit(3 * DAY), F.lit(5 * DAY)), F.col("k") + 1)).cast("long").alias("date"),
        F.when(full, "response").otherwise("revisit").alias("type"),
        F.when(F.expr("k = 2 AND page_id % 3 = 0"), 404).when(full, 200).otherwise(304).alias("status"),
        F.when(full, entries(stored)).otherwise(entries(answered)).alias("headers"),
        F.when(full, F.col("digest")).alias("payload_digest"),
    )


ORACLE = """
WITH base AS (
  SELECT page_id, url, 1600000000 + page_id * 3600 AS base, sha256(coalesce(html, '')) AS digest, strlen(coalesce(html, '')) AS size FROM pages),
log AS (
  SELECT *, unnest([0, 1, 2, 3]) AS k FROM base),
cap AS (
  SELECT page_id || '-' || k AS record_id,
    CASE WHEN k = 1 THEN regexp_replace(url, '^http:', 'https:') || '#again' ELSE url END AS url,
    base + [0, 2 * 86400, 3 * 86400, 5 * 86400][k + 1] AS date,
    CASE WHEN k IN (0, 2) THEN 'response' ELSE 'revisit' END AS type,
    CASE WHEN k = 2 AND page_id % 3 = 0 THEN 404 WHEN k IN (0, 2) THEN 200 ELSE 304 END AS status,
    CASE WHEN k = 3 AND page_id % 5 = 0 THEN '"changed"' ELSE '"' || substr(digest, 1, 16) || '"' END AS tag,
    size, CASE WHEN k IN (0, 2) THEN digest END AS payload_digest
  FROM log WHERE NOT (k = 0 AND page_id % 7 = 3) AND NOT (k = 2 AND page_id % 4 <> 1)),
u1 AS (SELECT *, regexp_replace(regexp_replace(coalesce(url, ''), '#.*$', ''), '^[a-zA-Z][a-zA-Z0-9+.-]*://', '') AS u FROM cap),
u2 AS (SELECT * EXCLUDE (u), lower(regexp_extract(u, '^[^/?]*')) || substr(u, length(regexp_extract(u, '^[^/?]*')) + 1) AS u FROM u1),
u3 AS (SELECT * EXCLUDE (u), regexp_replace(u, '^([^/:?]+):(80|443)([/?]|$)', '\\1\\3') AS u FROM u2),
u4 AS (SELECT * EXCLUDE (u), regexp_replace(regexp_replace(regexp_replace(u, '([?&])(?:utm_[a-z]+|ref)=[^&]*', '\\1', 'g'), '&&+', '&', 'g'), '\\?&', '?', 'g') AS u FROM u3),
rec AS (SELECT * EXCLUDE (u), regexp_replace(regexp_replace(u, '[?&]+$', ''), '/+$', '') AS canonical_url FROM u4),
res AS (
  SELECT r.*, (SELECT max(struct_pack(d := f.date, id := f.record_id, pd := f.payload_digest, t := f.tag, s := f.size)) FROM rec f
               WHERE f.type = 'response' AND f.status = 200 AND f.canonical_url = r.canonical_url AND f.date < r.date) AS g
  FROM rec r),
done AS (
  SELECT *, CASE WHEN type = 'response' AND status = 200 THEN 'full' WHEN type = 'response' THEN 'other' WHEN g IS NULL THEN 'missing' WHEN tag = g.t THEN 'resolved' ELSE 'mismatch' END AS resolution FROM res)
SELECT record_id, url, canonical_url, date, type, resolution,
  CASE WHEN resolution = 'resolved' THEN g.id END AS source_record_id,
  CASE WHEN resolution = 'resolved' THEN 200 ELSE status END AS status,
  CASE WHEN resolution = 'resolved' THEN g.pd ELSE payload_digest END AS payload_digest,
  CASE CASE WHEN type = 'response' THEN 'full' ELSE resolution END
    WHEN 'full' THEN 'cache-control: max-age=60' || chr(10) || 'content-length: ' || size || chr(10) || 'content-type: text/html' || chr(10) || 'etag: ' || tag
    WHEN 'resolved' THEN 'cache-control: max-age=3600' || chr(10) || 'content-length: ' || g.s || chr(10) || 'content-type: text/html' || chr(10) || 'etag: W/' || tag || chr(10) || 'x-cache: HIT'
    ELSE 'cache-control: max-age=3600' || chr(10) || 'content-length: 0' || chr(10) || 'etag: W/' || tag || chr(10) || 'x-cache: HIT' END AS headers
FROM done
"""
