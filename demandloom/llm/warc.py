"""Not-modified revisits of a crawl resolved to the responses they stand for (DataFrame functions only).

A revisit record says that a page was as before. It is resolved by an as-of join:
the latest full response of the same canonical URL that was captured strictly earlier.
Its validators must agree with the revisit's; then the revisit takes over the response's
payload and headers, updated by those headers that a 304 answer may change.

The join is a running maximum per URL. So that one URL with a third of all captures is not
one task, time is cut into blocks at quantiles of the whole table. Inside a block the
maximum runs over the block's captures; what earlier blocks hand over is a running maximum over one
row per URL and block.

Defined results: a capture without URL or time resolves nothing and is resolved by
nothing; of responses at the same time the one with the greatest id counts; records that
repeat are resolved one by one; null headers are no headers; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from demandloom.llm.tables import pick

TIME_BLOCKS = 64
# Headers that a 304 answer may change in the stored response (RFC 9110, 15.4.5; fixed values).
PERMITTED = ["age", "cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary"]
# Query parameters that only track the reader (fixed values).
TRACKING = r"^(utm_[a-z]+|gclid|fbclid|ref)(=.*)?$"
COLUMNS = {"record_id": "record_id", "url": "url", "captured_at": "captured_at", "is_full": "is_full",
           "etag": "etag", "last_modified": "last_modified", "headers": "headers"}


def canonical_url(url: Column) -> Column:
    """Host and path without scheme, user, default port, ``www.``, fragment, tracking parameters and last slash.

    Host letters are lower-cased and parameters sorted; the path keeps its case.
    """
    bare = F.regexp_replace(F.trim(url), "#.*$", "")
    bare = F.regexp_replace(bare, "^[A-Za-z][A-Za-z0-9+.-]*://", "")
    place = F.regexp_extract(bare, r"^([^?]*)", 1)
    host = F.lower(F.regexp_replace(F.regexp_extract(place, "^([^/]*)", 1), "^[^@]*@", ""))
    host = F.regexp_replace(F.regexp_replace(host, ":(80|443)$", ""), r"^www\.", "")
    path = F.regexp_replace(F.regexp_extract(place, "^[^/]*(.*)$", 1), "/+$", "")
    query = F.regexp_extract(bare, r"\?(.*)$", 1)
    kept = F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike(TRACKING))
    kept = F.array_join(F.array_sort(kept), "&")
    return F.when(url.isNotNull(), F.concat(host, path, F.when(kept != "", F.concat(F.lit("?"), kept)).otherwise("")))


def _opaque(etag: Column) -> Column:
    """An entity tag for the weak comparison."""
    return F.regexp_replace(etag, "^W/", "")


def _sorted_headers(headers: Column) -> Column:
    """Headers as an array that can be compared, names in lower case."""
    entries = F.map_entries(F.coalesce(headers, F.create_map().cast("map<string,string>")))
    named = F.transform(entries, lambda e: F.struct(F.lower(e["key"]).alias("name"), e["value"].alias("value")))
    return F.array_sort(named)


def _named(headers: Column, names: Column) -> Column:
    return F.filter(headers, lambda h: F.array_contains(names, h["name"]))


def merge_headers(stored: Column, update: Column) -> Column:
    """The stored headers with those of the update that it may change, sorted by name."""
    permitted = F.array(*[F.lit(x) for x in PERMITTED])
    changed = _named(update, permitted)
    names = F.transform(changed, lambda h: h["name"])
    kept = F.filter(F.coalesce(stored, F.array().cast(_HEADERS)), lambda h: ~F.array_contains(names, h["name"]))
    return F.array_sort(F.concat(kept, changed))


_HEADERS = "array<struct<name:string,value:string>>"


def _instant(df: DataFrame, name: str) -> Column:
    """A whole number that orders the column's values: microseconds of times and of numbers with a fraction."""
    kind, at = df.schema[name].dataType, F.col(name)
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return F.unix_micros(at.cast("timestamp"))
    if isinstance(kind, T.FractionalType):
        return F.round(at * 1_000_000).cast("long")
    return at.cast("long")


def resolve_revisits(records: DataFrame, time_blocks: int = TIME_BLOCKS, **columns: str) -> DataFrame:
    """(record_id, canonical_url, captured_at, status, response_id, headers), one row per record.

    ``status`` is full, resolved (validators agree), unchecked (the revisit has none), changed
    (they disagree) or orphan (no earlier response). ``response_id`` names the record that holds
    the payload, its own for a full response and null for changed and orphan ones.
    """
    rows = pick(records, **(COLUMNS | columns))
    rows = rows.select(
        "record_id",
        canonical_url(F.col("url")).alias("canonical_url"),
        "captured_at",
        _instant(rows, "captured_at").alias("t"),
        F.coalesce("is_full", F.lit(False)).alias("is_full"),
        "etag",
        "last_modified",
        _sorted_headers(F.col("headers")).alias("headers"),
    )
    steps = [n / time_blocks for n in range(1, time_blocks)]
    cuts = rows.select(F.percentile_approx("t", steps, 10_000).alias("cuts")).first()["cuts"] or []
    bounds = F.array(*[F.lit(x).cast("long") for x in sorted(set(cuts))])
    rows = rows.withColumn("block", F.size(F.filter(bounds, lambda b: b < F.col("t"))))

    usable = F.col("is_full") & F.col("canonical_url").isNotNull() & F.col("t").isNotNull()
    response = F.when(usable, F.struct("t", "record_id", "etag", "last_modified", "headers"))
    rows = rows.withColumn("response", response)
    inside = Window.partitionBy("canonical_url", "block").orderBy("t").rangeBetween(Window.unboundedPreceding, -1)
    earlier = Window.partitionBy("canonical_url").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    carried = rows.where("canonical_url IS NOT NULL").groupBy("canonical_url", "block")
    carried = carried.agg(F.max("response").alias("latest"))
    carried = carried.select("canonical_url", "block", F.max("latest").over(earlier).alias("carried"))
    carried = carried.where("carried IS NOT NULL")
    found = rows.withColumn("inside", F.max("response").over(inside)).join(carried, ["canonical_url", "block"], "left")
    found = found.withColumn(
        "found", F.when(F.col("t").isNotNull() & F.col("canonical_url").isNotNull(), F.coalesce("inside", "carried"))
    )

    by_tag = F.col("etag").isNotNull() & F.col("found.etag").isNotNull()
    by_date = F.col("last_modified").isNotNull() & F.col("found.last_modified").isNotNull()
    agrees = F.when(by_tag, _opaque(F.col("etag")) == _opaque(F.col("found.etag"))).when(
        by_date, F.col("last_modified") == F.col("found.last_modified")
    )
    status = (
        F.when(F.col("is_full"), "full")
        .when(F.col("found").isNull(), "orphan")
        .when(agrees.isNull(), "unchecked")
        .when(agrees, "resolved")
        .otherwise("changed")
    )
    found = found.withColumn("status", status)
    taken = F.col("status").isin("resolved", "unchecked")
    return found.select(
        "record_id",
        "canonical_url",
        "captured_at",
        "status",
        F.when(F.col("is_full"), F.col("record_id")).when(taken, F.col("found.record_id")).alias("response_id"),
        F.when(taken, merge_headers(F.col("found.headers"), F.col("headers"))).otherwise(F.col("headers")).alias("headers"),
    )


# The crawl that the query derives: every page is captured CAPTURES times, one round after the other.
CAPTURES = 3
ROUND = 1_000_000_007
CHANGED_EVERY = 4


def crawl_of(pages: DataFrame) -> DataFrame:
    """Captures of ``pages``: the first is full; of the second every fourth URL's is full again with a new tag; the
    others are revisits that carry the page's latest tag. Captures of different pages may share a canonical URL."""
    rounds = F.explode(F.sequence(F.lit(0), F.lit(CAPTURES - 1))).alias("capture")
    seen = pick(pages, page_id="page_id", url="url", html="html").select("page_id", "url", F.md5("html").alias("md5"), rounds)
    changes = F.coalesce(F.char_length("url") % CHANGED_EVERY == 0, F.lit(False))
    version = F.when((F.col("capture") >= 1) & changes, 1).otherwise(0)
    full = (F.col("capture") == 0) | ((F.col("capture") == 1) & changes)
    etag = F.concat_ws("-", F.substring("md5", 1, 16), version.cast("string"))
    at = F.col("capture") * F.lit(ROUND).cast("long") + F.col("page_id")
    return seen.select(
        F.struct("page_id", "capture").alias("record_id"),
        "url",
        at.alias("captured_at"),
        full.alias("is_full"),
        etag.alias("etag"),
        F.lit(None).cast("string").alias("last_modified"),
        F.create_map(
            F.lit("ETag"), etag, F.lit("Date"), at.cast("string"),
            F.lit("Content-Type"), F.when(full, "text/html").otherwise("text/plain"),
            F.lit("X-Cache"), F.when(full, "miss").otherwise("hit"),
        ).alias("headers"),
    )


def revisit_query(pages: DataFrame) -> DataFrame:
    """(page_id, capture, canonical_url, status, response_page_id, response_capture, headers as text)."""
    found = resolve_revisits(crawl_of(pages))
    text = F.array_join(F.transform("headers", lambda h: F.concat(h["name"], F.lit(": "), h["value"])), "\n")
    return found.select(
        F.col("record_id.page_id").alias("page_id"),
        F.col("record_id.capture").alias("capture"),
        "canonical_url",
        "status",
        F.col("response_id.page_id").alias("response_page_id"),
        F.col("response_id.capture").alias("response_capture"),
        text.alias("headers"),
    )


SQL = rf"""
WITH stripped AS (
  SELECT page_id, url, substr(md5(html), 1, 16) AS tag,
         regexp_replace(regexp_replace(trim(url), '#.*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://', '') AS bare FROM pages),
parts AS (
  SELECT *, regexp_extract(bare, '^([^?]*)', 1) AS place,
         array_to_string(list_sort(list_filter(string_split(regexp_extract(bare, '\?(.*)$', 1), '&'),
           lambda p: p <> '' AND NOT regexp_matches(p, '{TRACKING}'))), '&') AS kept FROM stripped),
canonical AS (
  SELECT page_id, url, tag, regexp_replace(regexp_replace(lower(regexp_replace(regexp_extract(place, '^([^/]*)', 1),
           '^[^@]*@', '')), ':(80|443)$', ''), '^www\.', '')
         || regexp_replace(regexp_extract(place, '^[^/]*(.*)$', 1), '/+$', '')
         || CASE WHEN kept <> '' THEN '?' || kept ELSE '' END AS canonical_url FROM parts),
captures AS (
  SELECT page_id, capture, canonical_url, capture * {ROUND} + page_id AS t,
         capture = 0 OR (capture = 1 AND coalesce(length(url) % {CHANGED_EVERY} = 0, false)) AS is_full,
         concat_ws('-', tag, CASE WHEN capture >= 1 AND coalesce(length(url) % {CHANGED_EVERY} = 0, false)
           THEN '1' ELSE '0' END) AS etag
  FROM canonical CROSS JOIN (SELECT unnest(range({CAPTURES})) AS capture)),
earlier AS (
  SELECT *, max(CASE WHEN is_full THEN t END) OVER (
    PARTITION BY canonical_url ORDER BY t RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS found_t FROM captures),
resolved AS (
  SELECT e.*, r.page_id AS r_page, r.capture AS r_capture,
         CASE WHEN e.is_full THEN 'full' WHEN r.page_id IS NULL THEN 'orphan'
              WHEN r.etag = e.etag THEN 'resolved' ELSE 'changed' END AS status
  FROM earlier e LEFT JOIN captures r
    ON NOT e.is_full AND r.is_full AND r.canonical_url = e.canonical_url AND r.t = e.found_t)
SELECT page_id, CAST(capture AS INTEGER) AS capture, canonical_url, status,
       CASE status WHEN 'full' THEN page_id WHEN 'resolved' THEN r_page END AS response_page_id,
       CAST(CASE status WHEN 'full' THEN capture WHEN 'resolved' THEN r_capture END AS INTEGER) AS response_capture,
       concat('content-type: ', CASE WHEN status IN ('full', 'resolved') THEN 'text/html' ELSE 'text/plain' END,
              chr(10), 'date: ', t, chr(10), 'etag: ', etag, chr(10), 'x-cache: ',
              CASE WHEN status IN ('full', 'resolved') THEN 'miss' ELSE 'hit' END) AS headers
FROM resolved
"""
