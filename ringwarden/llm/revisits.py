"""Not-modified revisits of a web archive, resolved by an as-of join.

A revisit record with the profile server-not-modified has no body: the server
said 304.  It stands for the latest earlier full response of the same canonical
URL, if the validators agree: equal entity tags (weak comparison), or, where a
side has no tag, equal Last-Modified values.  The resolved record is that
response with the header fields that a 304 may update taken from the revisit.

The join never gathers all captures of a URL: each URL's time line is cut into
slices of fixed width, the last full response of every slice is one aggregated
row, and a capture looks within its slice first, else to the last slice before it
that has one.  Bodies stay where they are; only ids and headers move.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ringwarden.staging import Staging

#: Header fields that a 304 response updates in a stored one.
UPDATED_BY_304 = ["cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary"]
#: Query parameters that do not select content.
TRACKING = ["fbclid", "gclid", "ref", "utm_campaign", "utm_content", "utm_medium", "utm_source", "utm_term"]


def canonical_url(url: Column) -> Column:
    """Host in lower case without ``www.``, no scheme, port 80/443, fragment, tracking parameter or last slash; parameters sorted."""
    bare = F.regexp_replace(F.regexp_replace(F.trim(url), r"#.*$", ""), r"^[A-Za-z][A-Za-z0-9+.-]*://", "")
    path = F.regexp_replace(bare, r"\?.*$", "")
    host = F.regexp_replace(F.regexp_replace(F.lower(F.regexp_extract(path, r"^([^/]*)", 1)), r":(80|443)$", ""), r"^www\.", "")
    rest = F.regexp_replace(F.regexp_extract(path, r"^[^/]*(/.*)?$", 1), r"/+$", "")
    pairs = F.filter(F.split(F.regexp_extract(bare, r"\?(.*)$", 1), "&"),
                     lambda p: (p != "") & ~F.lower(F.element_at(F.split(p, "="), 1)).isin(TRACKING))
    query = F.array_join(F.array_sort(pairs), "&")
    return F.when(url.isNotNull(), F.concat(host, rest, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(F.lit(""))))


def _tag(headers: Column) -> Column:
    return F.regexp_replace(F.trim(F.element_at(headers, "etag")), r"^W/", "")


def same_version(mine: Column, theirs: Column) -> Column:
    """Whether the validators of two header maps agree: true, false, or null if neither kind is on both sides."""
    tags = _tag(mine) == _tag(theirs)
    return F.coalesce(tags, F.trim(F.element_at(mine, "last-modified")) == F.trim(F.element_at(theirs, "last-modified")))


def resolve_revisits(records: DataFrame, slice_seconds: int = 86_400) -> DataFrame:
    """Resolve the revisits of ``records(record_id, url, captured, type, status, headers)``.

    ``type`` is response or revisit, ``captured`` a timestamp, ``headers`` a map
    with lower-case names.  A full response is a response with status 200.  Two
    records of one time are ordered by record_id, so a response is "earlier" than
    a revisit of the same second only if its id is smaller.  Returns one row for
    each revisit: (record_id, canonical, captured, outcome, response_id, headers);
    outcome is ``resolved``, ``no_response`` (none earlier), ``validators_differ``
    or ``no_validator`` (nothing to compare); headers are the merged ones where
    resolved, else null.  Null urls or times give no_response; null headers count
    as empty; records of other types are ignored; repeated rows are resolved each
    alone; other columns are not read; an empty table gives an empty result.
    """
    stage = Staging(records.sparkSession)
    empty = F.create_map().cast("map<string,string>")
    base = stage.save(records.select(
        "record_id", canonical_url(F.col("url")).alias("canonical"), "captured", "type", "status", F.coalesce("headers", empty).alias("headers"),
        F.floor(F.unix_timestamp("captured") / slice_seconds).alias("slice")), "records")
    full = base.where("type = 'response' and status = 200 and canonical is not null and captured is not null")
    key = F.struct("captured", "record_id")
    stored = full.select("canonical", "slice", key.alias("at"), F.struct("record_id", "headers").alias("r"))
    last = stored.groupBy("canonical", "slice").agg(F.max("at").alias("at"), F.max_by("r", "at").alias("r"))
    revisit = base.where("type = 'revisit'")

    # The last full response before the slice: one row for each slice that something happens in.
    marks = last.unionByName(revisit.where("canonical is not null and slice is not null").select("canonical", "slice").distinct()
                             .withColumns({"at": F.lit(None).cast(last.schema["at"].dataType), "r": F.lit(None).cast(last.schema["r"].dataType)}))
    per_slice = marks.groupBy("canonical", "slice").agg(F.max_by("r", "at").alias("r"))
    before = Window.partitionBy("canonical").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    carried = stage.save(per_slice.select("canonical", "slice", F.last("r", ignorenulls=True).over(before).alias("carried")), "carried")

    # Inside the slice: an ordinary as-of by window, on rows that are few by the slice's width.
    events = stored.select("canonical", "slice", "at", "r", F.lit(None).cast("map<string,string>").alias("mine")).unionByName(
        revisit.select("canonical", "slice", key.alias("at"), F.lit(None).cast(last.schema["r"].dataType).alias("r"), F.col("headers").alias("mine")))
    inside = Window.partitionBy("canonical", "slice").orderBy("at", F.col("mine").isNull().desc()).rowsBetween(Window.unboundedPreceding, 0)
    found = events.withColumn("inside", F.last("r", ignorenulls=True).over(inside)).where("mine is not null")
    both = found.join(carried, ["canonical", "slice"], "left").withColumn("from", F.coalesce("inside", "carried"))
    same = same_version(F.col("mine"), F.col("from.headers"))
    outcome = (F.when(F.col("from").isNull(), "no_response").when(same.isNull(), "no_validator")
               .when(same, "resolved").otherwise("validators_differ"))
    fresh = F.map_filter("mine", lambda k, v: k.isin(UPDATED_BY_304) & v.isNotNull())
    merged = F.map_concat(F.map_filter("from.headers", lambda k, v: ~F.array_contains(F.map_keys(fresh), k)), fresh)
    return both.select(F.col("at.record_id").alias("record_id"), "canonical", F.col("at.captured").alias("captured"), outcome.alias("outcome"),
                       F.when(outcome == "resolved", F.col("from.record_id")).alias("response_id"),
                       F.when(outcome == "resolved", merged).alias("headers"))


def captures(pages: DataFrame) -> DataFrame:
    """Capture records derived from a table of pages (page_id, url, html).

    Every page is a full response, crawled a minute after the page before it, with
    the MD5 of its body as entity tag and a Content-Length.  A day later the page
    is asked for again: the server answers 304 with the tag of the page, or, for
    every seventh page, of another version; every eleventh answer has no tag but
    a Last-Modified; the record of the first request is lost for every fifth page.
    """
    at = F.timestamp_seconds(F.lit(1_700_000_000) + F.col("page_id") * 60)
    tag = F.md5(F.coalesce(F.col("html"), F.lit("")).cast("binary"))
    modified = F.date_format(at, "yyyy-MM-dd HH:mm:ss")
    base = pages.select("page_id", "url", at.alias("at"), tag.alias("tag"), modified.alias("modified"), F.coalesce(F.octet_length("html"), F.lit(0)).alias("bytes"))
    first = base.where("page_id % 5 <> 0").select(
        (F.col("page_id") * 2).alias("record_id"), "url", F.col("at").alias("captured"), F.lit("response").alias("type"), F.lit(200).alias("status"),
        F.create_map(F.lit("etag"), F.concat(F.lit('"'), "tag", F.lit('"')), F.lit("last-modified"), F.col("modified"), F.lit("content-length"), F.col("bytes").cast("string"),
                     F.lit("cache-control"), F.lit("max-age=60")).alias("headers"))
    seen = F.when(F.col("page_id") % 7 == 0, F.reverse("tag")).otherwise(F.col("tag"))
    later = F.col("at") + F.expr("interval 1 day")
    again = base.select(
        (F.col("page_id") * 2 + 1).alias("record_id"), "url", later.alias("captured"), F.lit("revisit").alias("type"), F.lit(304).alias("status"),
        F.when(F.col("page_id") % 11 == 0, F.create_map(F.lit("last-modified"), F.col("modified"), F.lit("content-length"), F.lit("0")))
        .otherwise(F.create_map(F.lit("etag"), F.concat(F.lit('W/"'), seen, F.lit('"')), F.lit("cache-control"), F.lit("max-age=600"), F.lit("content-length"), F.lit("0")))
        .alias("headers"))
    return first.unionByName(again)


def op9_resolve_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The revisits of all captures derived from the pages, with the response that each stands for."""
    out = resolve_revisits(captures(spark.read.parquet(f"{sf_dir.rstrip('/')}/pages.parquet")))
    header = lambda k: F.element_at("headers", k)
    return out.select("record_id", "canonical", "outcome", "response_id", header("etag").alias("etag"),
                      header("cache-control").alias("cache_control"), header("content-length").alias("content_length"))


ORACLE_OP9 = r"""
WITH b AS (
  SELECT page_id, url, md5(coalesce(html, '')) AS tag, strlen(coalesce(html, '')) AS bytes, 1700000000 + page_id * 60 AS crawled,
         regexp_replace(regexp_replace(trim(url), '#.*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://', '') AS bare FROM pages),
c AS (
  SELECT *, regexp_replace(bare, '\?.*$', '') AS path,
         list_sort(list_filter(string_split(regexp_extract(bare, '\?(.*)$', 1), '&'),
           lambda p: p <> '' AND NOT list_contains(['fbclid', 'gclid', 'ref', 'utm_campaign', 'utm_content', 'utm_medium', 'utm_source', 'utm_term'], lower(string_split(p, '=')[1])))) AS q
  FROM b),
u AS (
  SELECT *, regexp_replace(regexp_replace(lower(regexp_extract(path, '^([^/]*)', 1)), ':(80|443)$', ''), '^www\.', '')
    || regexp_replace(regexp_extract(path, '^[^/]*(/.*)?$', 1), '/+$', '')
    || CASE WHEN len(q) > 0 THEN '?' || array_to_string(q, '&') ELSE '' END AS canonical
  FROM c),
f AS (SELECT page_id * 2 AS id, canonical, crawled, tag, bytes FROM u WHERE page_id % 5 <> 0),
r AS (SELECT page_id * 2 + 1 AS id, page_id, canonical, crawled + 86400 AS crawled, crawled AS modified,
             CASE WHEN page_id % 7 = 0 THEN reverse(tag) ELSE tag END AS tag FROM u),
j AS (
  SELECT r.*, f.id AS fid, f.tag AS ftag, f.crawled AS fcrawled, f.bytes AS fbytes,
         row_number() OVER (PARTITION BY r.id ORDER BY f.crawled DESC, f.id DESC) AS rn
  FROM r LEFT JOIN f ON f.canonical = r.canonical AND (f.crawled < r.crawled OR (f.crawled = r.crawled AND f.id < r.id))),
o AS (
  SELECT *, CASE WHEN fid IS NULL THEN 'no_response'
                 WHEN page_id % 11 = 0 THEN CASE WHEN modified = fcrawled THEN 'resolved' ELSE 'validators_differ' END
                 WHEN tag = ftag THEN 'resolved' ELSE 'validators_differ' END AS outcome
  FROM j WHERE rn = 1)
SELECT id AS record_id, canonical, outcome, CASE WHEN outcome = 'resolved' THEN fid END AS response_id,
       CASE WHEN outcome = 'resolved' THEN CASE WHEN page_id % 11 = 0 THEN '"' || ftag || '"' ELSE 'W/"' || tag || '"' END END AS etag,
       CASE WHEN outcome = 'resolved' THEN CASE WHEN page_id % 11 = 0 THEN 'max-age=60' ELSE 'max-age=600' END END AS cache_control,
       CASE WHEN outcome = 'resolved' THEN CAST(fbytes AS VARCHAR) END AS content_length
FROM o
"""
