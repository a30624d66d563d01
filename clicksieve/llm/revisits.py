"""Resolution of "not modified" revisits in web captures.

A revisit record (status 304) says that a page was what it had been before. It
is resolved by an as-of join: the latest earlier full response for the same
canonical URL. The two belong together only if their validators agree (strong
entity tags first, else the modification date); then the revisit takes the
response's payload and headers, updated by those that a 304 may change.

One address may hold a third of all captures. So the as-of join is cut by
time: within a slice of an address the last response is carried by a window,
between slices only one row per slice is, and a slice's rows never meet those
of another.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import table, whole

# Headers that a 304 may update (RFC 9111); all others stay those of the stored response.
UPDATED_BY_304 = ("age", "cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary", "warning")

DEFAULT_PORTS = {"http": "80", "https": "443"}


def canonical_url(url: Column) -> Column:
    """Lower-case scheme and host, no user, default port, fragment or empty query, sorted parameters."""
    trimmed = F.trim(url)
    scheme = F.lower(F.regexp_extract(trimmed, r"^([A-Za-z][A-Za-z0-9+.-]*)://", 1))
    host = F.lower(F.regexp_extract(trimmed, r"^[^:/?#]+://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    port = F.regexp_extract(trimmed, r"^[^:/?#]+://(?:[^/?#@]*@)?[^/?#:]*:(\d+)", 1)
    path = F.regexp_extract(trimmed, r"^[^:/?#]+://[^/?#]*([^?#]*)", 1)
    query = F.regexp_extract(trimmed, r"^[^?#]*\?([^#]*)", 1)
    default = F.coalesce(*(F.when((scheme == s) & (port == p), True) for s, p in DEFAULT_PORTS.items()), F.lit(False))
    return F.when(scheme == "", trimmed).otherwise(F.concat(
        scheme, F.lit("://"), host,
        F.when((port == "") | default, "").otherwise(F.concat(F.lit(":"), port)),
        F.when(path == "", "/").otherwise(path),
        F.when(query == "", "").otherwise(F.concat(F.lit("?"), F.array_join(F.array_sort(F.split(query, "&")), "&"))),
    ))


def _header(headers: Column, name: str) -> Column:
    return F.get(F.map_values(F.map_filter(headers, lambda k, _: F.lower(k) == name)), F.lit(0))


def validators_agree(tag: Column, modified: Column, old_tag: Column, old_modified: Column) -> Column:
    """Equal entity tags (weak marks aside); without tags on both sides, equal dates; without either, unknown is no."""
    bare = lambda t: F.regexp_replace(F.trim(t), r"^W/", "")
    both_tags = tag.isNotNull() & old_tag.isNotNull()
    both_dates = modified.isNotNull() & old_modified.isNotNull()
    return F.when(both_tags, bare(tag) == bare(old_tag)).when(both_dates, modified == old_modified).otherwise(F.lit(False))


def merged_headers(old: Column, new: Column) -> Column:
    """The stored headers, names in lower case, with those a 304 may update taken from it."""
    def lowered(headers: Column) -> Column:  # of a name given twice the last value counts
        empty = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
        entries = F.map_entries(F.coalesce(headers, empty))
        names = F.transform(entries, lambda e: F.lower(e["key"]))
        kept = F.array_distinct(names)
        return F.map_from_arrays(kept, F.transform(kept, lambda n: F.get(
            F.transform(F.filter(F.reverse(entries), lambda e: F.lower(e["key"]) == n), lambda e: e["value"]), F.lit(0))))

    allowed = F.map_filter(lowered(new), lambda k, _: k.isin(*UPDATED_BY_304))
    kept = F.map_filter(lowered(old), lambda k, _: ~F.map_contains_key(allowed, k))
    return F.map_concat(kept, allowed)


def earlier_responses(captures: DataFrame, slice_seconds: int) -> DataFrame:
    """Each capture with ``earlier``: the latest full response of its address strictly before it.

    Of responses at one time the one with the larger record_id is the later.
    """
    response = F.when(F.col("is_response"), F.struct(
        "captured_at", "record_id", "etag", "last_modified", "payload_digest", F.map_entries("headers").alias("headers"),
    ))
    at = F.unix_micros("captured_at")
    sliced = captures.select(
        "*", response.alias("_response"), at.alias("_at"), F.floor(at / (slice_seconds * 1_000_000)).alias("_slice")
    )
    in_slice = Window.partitionBy("canonical", "_slice").orderBy("_at").rangeBetween(Window.unboundedPreceding, -1)
    inside = sliced.withColumn("_inside", F.max("_response").over(in_slice))
    over_slices = Window.partitionBy("canonical").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    carried = (
        sliced.groupBy("canonical", "_slice")
        .agg(F.max("_response").alias("_last"))
        .select("canonical", "_slice", F.max("_last").over(over_slices).alias("_carried"))
    )
    joined = inside.join(carried, ["canonical", "_slice"])
    return joined.withColumn("earlier", F.coalesce("_inside", "_carried")).drop("_response", "_at", "_slice", "_inside", "_carried")


def resolve_revisits(captures: DataFrame, slice_seconds: int = 3600) -> DataFrame:
    """One row per revisit: record_id, canonical, captured_at, resolved_id, status, payload_digest, headers.

    ``captures`` has record_id, url, captured_at, status (200, 304, ...),
    headers (map) and payload_digest; other columns are ignored. A capture with
    status 304 is a revisit, one with 200 a full response, others are neither.
    ``status`` of the result: "resolved", "changed" (validators disagree or are
    missing; no payload is taken) or "no response". Revisits without address or
    time are "no response"; repeated rows are each resolved. A null header map
    is empty.
    """
    known = captures.select(
        "record_id", canonical_url(F.col("url")).alias("canonical"), F.col("captured_at").cast("timestamp").alias("captured_at"),
        (F.col("status") == 200).alias("is_response"), (F.col("status") == 304).alias("is_revisit"),
        _header(F.col("headers"), "etag").alias("etag"), _header(F.col("headers"), "last-modified").alias("last_modified"),
        "payload_digest", "headers",
    ).where(F.col("is_response") | F.col("is_revisit"))
    placed = F.col("canonical").isNotNull() & F.col("captured_at").isNotNull()
    old = F.col("earlier")
    found = earlier_responses(known.where(placed), slice_seconds).where("is_revisit")
    agree = validators_agree(F.col("etag"), F.col("last_modified"), old["etag"], old["last_modified"])
    status = F.when(old.isNull(), "no response").when(agree, "resolved").otherwise("changed")
    resolved = found.withColumn("status", status).select(
        "record_id", "canonical", "captured_at", "status",
        F.when(F.col("status") == "resolved", old["record_id"]).alias("resolved_id"),
        F.when(F.col("status") == "resolved", old["payload_digest"]).alias("payload_digest"),
        F.when(F.col("status") == "resolved", merged_headers(F.map_from_entries(old["headers"]), F.col("headers")))
        .otherwise(F.col("headers")).alias("headers"),
    )
    lost = known.where(F.col("is_revisit") & ~placed).select(
        "record_id", "canonical", "captured_at", F.lit("no response").alias("status"),
        F.lit(None).cast(known.schema["record_id"].dataType).alias("resolved_id"),
        F.lit(None).cast(known.schema["payload_digest"].dataType).alias("payload_digest"), "headers",
    )
    return resolved.unionByName(lost)


def header_text(headers: Column) -> Column:
    """Headers as sorted lines."""
    lines = F.transform(F.map_entries(headers), lambda e: F.concat(F.lower(e["key"]), F.lit(": "), F.coalesce(e["value"], F.lit(""))))
    return F.array_join(F.array_sort(lines), "\n")


def page_captures(pages: DataFrame) -> DataFrame:
    """Every page as a full response and, a day later, as a revisit.

    Two of three revisits send the page's entity tag (one of them as a weak
    one), the third another; every fifth response has no tag, only a date.
    """
    tag = F.md5(whole("html"))
    n = F.coalesce("page_id", F.lit(0))
    day = F.concat(F.lit("2024-01-"), F.lpad((n % 28 + 1).cast("string"), 2, "0"))
    start = F.timestamp_seconds(1704067200 + n * 60)
    tagged = n % 5 != 0
    full = F.map_from_arrays(
        F.array(*map(F.lit, ("Content-Type", "Last-Modified", "Date"))), F.array(F.lit("text/html"), day, F.lit("first"))
    )
    sent = F.when(n % 3 == 0, tag).when(n % 3 == 1, F.concat(F.lit("W/"), tag)).otherwise(F.md5(F.coalesce("url", F.lit(""))))
    with_tag = lambda headers, t: F.when(tagged, F.map_concat(headers, F.create_map(F.lit("ETag"), t))).otherwise(headers)
    again = F.map_from_arrays(
        F.array(*map(F.lit, ("Last-Modified", "Date", "Content-Length"))), F.array(day, F.lit("again"), F.lit("0"))
    )
    kinds = F.array(
        F.struct((n * 2).alias("record_id"), start.alias("captured_at"), F.lit(200).alias("status"), with_tag(full, tag).alias("headers"),
                 F.sha2(whole("html"), 256).alias("payload_digest")),
        F.struct((n * 2 + 1).alias("record_id"), (start + F.expr("INTERVAL 1 DAY")).alias("captured_at"), F.lit(304).alias("status"),
                 with_tag(again, sent).alias("headers"), F.lit(None).cast("string").alias("payload_digest")),
    )
    return pages.select("url", F.explode(kinds).alias("_c")).select("url", "_c.*")


def op5(spark, sf_dir):
    resolved = resolve_revisits(page_captures(table(spark, sf_dir, "pages")))
    return resolved.select(
        "record_id", "canonical", "status", "resolved_id", "payload_digest", header_text(F.col("headers")).alias("headers")
    )


ORACLE_SQL = """
WITH p AS (
  SELECT page_id AS n, trim(url) AS u, md5(coalesce(html, '')) AS tag, md5(coalesce(url, '')) AS other, sha256(coalesce(html, '')) AS sha FROM pages
), c AS (
  SELECT *, lower(regexp_extract(u, '^([A-Za-z][A-Za-z0-9+.-]*)://', 1)) AS scheme,
    lower(regexp_extract(u, '^[^:/?#]+://(?:[^/?#@]*@)?([^/?#:]*)', 1)) AS host,
    regexp_extract(u, '^[^:/?#]+://(?:[^/?#@]*@)?[^/?#:]*:(\\d+)', 1) AS port,
    regexp_extract(u, '^[^:/?#]+://[^/?#]*([^?#]*)', 1) AS path,
    regexp_extract(u, '^[^?#]*\\?([^#]*)', 1) AS query,
    '2024-01-' || lpad(CAST(n % 28 + 1 AS VARCHAR), 2, '0') AS day,
    CASE WHEN n % 5 <> 0 THEN md5('') ELSE NULL END AS tagged
  FROM p
), k AS (
  SELECT *, CASE WHEN scheme = '' THEN u ELSE scheme || '://' || host
    || CASE WHEN port = '' OR (scheme = 'http' AND port = '80') OR (scheme = 'https' AND port = '443') THEN '' ELSE ':' || port END
    || CASE WHEN path = '' THEN '/' ELSE path END
    || CASE WHEN query = '' THEN '' ELSE '?' || array_to_string(list_sort(string_split(query, '&')), '&') END END AS canonical,
    CASE WHEN tagged IS NULL THEN NULL WHEN n % 3 = 2 THEN other ELSE tag END AS sent
  FROM c
), j AS (
  SELECT r.n, r.canonical, r.day, r.sent, f.n AS fn, f.tag AS ftag, f.tagged AS ftagged, f.day AS fday, f.sha AS fsha,
    r.n % 3 = 1 AS weak,
    row_number() OVER (PARTITION BY r.n ORDER BY f.n DESC NULLS LAST) AS latest
  FROM k r LEFT JOIN k f ON r.canonical = f.canonical AND f.n * 60 < r.n * 60 + 86400
), s AS (
  SELECT *, CASE WHEN fn IS NULL THEN 'no response'
    WHEN sent IS NOT NULL AND ftagged IS NOT NULL THEN CASE WHEN sent = ftag THEN 'resolved' ELSE 'changed' END
    WHEN day = fday THEN 'resolved' ELSE 'changed' END AS status,
    CASE WHEN weak THEN 'W/' || sent ELSE sent END AS shown
  FROM j WHERE latest = 1
)
SELECT n * 2 + 1 AS record_id, canonical, status,
  CASE WHEN status = 'resolved' THEN fn * 2 END AS resolved_id,
  CASE WHEN status = 'resolved' THEN fsha END AS payload_digest,
  CASE WHEN status = 'resolved' THEN 'content-type: text/html' ELSE 'content-length: 0' END || chr(10) || 'date: again'
    || CASE WHEN shown IS NOT NULL THEN chr(10) || 'etag: ' || shown
            WHEN status = 'resolved' AND ftagged IS NOT NULL THEN chr(10) || 'etag: ' || ftag ELSE '' END
    || chr(10) || 'last-modified: ' || day AS headers
FROM s
"""
