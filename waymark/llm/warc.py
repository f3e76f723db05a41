"""Resolution of not-modified revisits in web archives.

A revisit record with the server's "not modified" answer has headers, but no
body.  It is matched with the latest earlier full response of the same
canonical URL; if their validators agree, the revisit gets that response as its
body and the response's headers as updated by those of the revisit that a
not-modified answer may change.

The as-of join sorts all records by URL and time over ranges, so the records of
one URL may lie in many partitions, which a window over the URL could not.  Each
partition looks back within itself; the last response of a URL in each
partition, one row, is carried to the partitions after it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import written

#: Header fields that a not-modified answer does not update (connection, framing and representation fields).
KEPT = [
    "connection", "content-encoding", "content-length", "content-range", "content-type", "keep-alive", "proxy-authenticate",
    "proxy-authentication-info", "proxy-authorization", "proxy-connection", "te", "trailer", "transfer-encoding", "upgrade",
]
#: Query parameters that only track visits.
TRACKING = r"^(utm_[^=]*|fbclid|gclid|ref)(=|$)"
ROWS_PER_RANGE = 200_000


def canonical(url: Column) -> Column:
    """Host and path without scheme, user, default port, "www.", last slash, fragment and tracking parameters; other parameters sorted.

    Null stays null.  What has no host is only trimmed and loses its fragment.
    """
    u = F.regexp_replace(F.trim(url), "#.*$", "")
    lead = r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//"
    host = F.lower(F.regexp_extract(u, lead + "([^/?]*)", 1))
    host = F.regexp_replace(F.regexp_replace(F.regexp_replace(host, "^.*@", ""), ":(80|443)$", ""), r"^www\.", "")
    path = F.regexp_replace(F.regexp_extract(u, lead + "[^/?]*([^?]*)", 1), "/$", "")
    pairs = F.filter(F.split(F.regexp_extract(u, r"\?(.*)$", 1), "&"), lambda x: (x != "") & ~x.rlike(TRACKING))
    query = F.array_join(F.array_sort(pairs), "&")
    return F.when(host == "", u).otherwise(F.concat(host, path, F.when(query == "", "").otherwise(F.concat(F.lit("?"), query))))


def lowered(headers: Column) -> Column:
    """Header names in lower case; of names that then agree the last one's value."""
    pairs = F.transform(F.map_entries(headers), lambda x: F.struct(F.lower(x["key"]).alias("key"), x["value"].alias("value")))
    names = F.array_distinct(F.transform(pairs, lambda x: x["key"]))
    return F.map_from_arrays(names, F.transform(names, lambda n: F.element_at(F.filter(pairs, lambda x: x["key"] == n), -1)["value"]))


def agree(one: Column, two: Column) -> Column:
    """Validators agree: entity tags by weak comparison if both have one, else dates of last modification if both have one."""
    tag = lambda h: F.regexp_replace(F.trim(h["etag"]), "^W/", "")
    both = lambda x, y: x.isNotNull() & y.isNotNull()
    date = lambda h: F.trim(h["last-modified"])
    return F.when(both(tag(one), tag(two)), tag(one) == tag(two)).when(both(date(one), date(two)), date(one) == date(two)).otherwise(False)


def merged(stored: Column, fresh: Column) -> Column:
    """The stored headers as updated by the permitted ones of a not-modified answer."""
    own = F.split(F.regexp_replace(F.lower(F.coalesce(fresh["connection"], F.lit(""))), r"\s", ""), ",")
    update = F.map_filter(fresh, lambda k, v: ~k.isin(KEPT) & ~F.array_contains(own, k))
    return F.map_concat(F.map_filter(stored, lambda k, v: ~F.map_contains_key(update, k)), update)


def resolve(records: DataFrame) -> DataFrame:
    """(record_id, url_key, time, outcome, response_id, headers) for each revisit of records(record_id, url, time, kind, status, headers, ...).

    kind: "response" or "revisit"; a full response has status 200; headers:
    map<string, string>.  Earlier is by time, then record_id.  outcome: "resolved";
    "mismatch" if the validators of the latest earlier full response do not agree
    or are missing on either side; "no_response" without such a response, or with
    a null url or time.  Unless resolved, response_id is null and headers are the
    revisit's own (names in lower case; null headers are empty).  Other records
    give no row.  Rows that repeat a record_id are records of their own.
    """
    empty = F.create_map().cast("map<string,string>")
    keep = F.coalesce((F.col("kind") == "revisit") | ((F.col("kind") == "response") & (F.col("status") == 200)), F.lit(False))
    rows = records.where(keep).select("record_id", canonical(F.col("url")).alias("url_key"), "time", (F.col("kind") == "response").alias("full"), lowered(F.coalesce("headers", empty)).alias("headers"))
    known = rows.where(F.col("url_key").isNotNull() & F.col("time").isNotNull())
    n = 1 + known.count() // ROWS_PER_RANGE
    n = max(n, min(n * 8, int(records.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    dealt = written(known.repartitionByRange(n, "url_key", "time", "record_id").withColumn("range", F.spark_partition_id()), "ranges")

    found = F.when(F.col("full"), F.struct("record_id", F.col("headers").alias("stored")))
    before = Window.partitionBy("range", "url_key").orderBy("time", "record_id", F.col("full").desc()).rowsBetween(Window.unboundedPreceding, -1)
    near = dealt.withColumn("near", F.last(found, ignorenulls=True).over(before)).where("not full").drop("full")
    # only URLs that lie in more than one range need an answer from an earlier one
    wide = dealt.groupBy("url_key").agg(F.min("range").alias("a"), F.max("range").alias("b")).where("a < b").select("url_key")
    ends = dealt.join(wide, "url_key", "left_semi").groupBy("url_key", "range").agg(F.max_by(F.struct("record_id", F.col("headers").alias("stored")), F.when(F.col("full"), F.struct("time", "record_id"))).alias("end"))
    past = Window.partitionBy("url_key").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.withColumn("far", F.last("end", ignorenulls=True).over(past)).select("url_key", "range", "far")
    joined = near.join(carried, ["url_key", "range"], "left").withColumn("match", F.coalesce("near", "far"))
    lost = rows.where("not full and (url_key is null or time is null)").select("record_id", "url_key", "time", "headers")
    lost = lost.withColumn("match", F.lit(None).cast(joined.schema["match"].dataType))
    all_ = joined.select("record_id", "url_key", "time", "headers", "match").unionByName(lost)
    good = F.coalesce(agree(F.col("match.stored"), F.col("headers")), F.lit(False))
    outcome = F.when(F.col("match").isNull(), "no_response").when(good, "resolved").otherwise("mismatch")
    return all_.select("record_id", "url_key", "time", outcome.alias("outcome"), F.when(good, F.col("match.record_id")).alias("response_id"), F.when(good, merged(F.col("match.stored"), F.col("headers"))).otherwise(F.col("headers")).alias("headers"))


def listed(headers: Column) -> Column:
    """Headers as lines "name: value", sorted."""
    return F.array_join(F.array_sort(F.transform(F.map_entries(headers), lambda x: F.concat(x["key"], F.lit(": "), x["value"]))), "\n")


def records_of(pages: DataFrame) -> DataFrame:
    """Records of a crawl of pages(page_id, url, html): a full response of each page and a later not-modified answer.

    The response has a tag drawn from the body (but for each 11th page) and a
    date; the revisit comes after it, but for each 7th page before it, and names
    another tag for each 5th page.
    """
    p = F.col("page_id")
    tag = F.substring(F.md5(F.col("html").cast("binary")), 1, 16)
    base = pages.select(p, "url", tag.alias("tag"), F.length("html").alias("n"))
    date = F.concat(F.lit("day "), (p % 28).cast("string"))
    response = F.map_from_arrays(
        F.array(F.lit("Content-Type"), F.lit("Content-Length"), F.lit("Cache-Control"), F.lit("Last-Modified"), F.when(p % 11 == 0, F.lit("X-None")).otherwise(F.lit("ETag"))),
        F.array(F.lit("text/html"), F.col("n").cast("string"), F.lit("max-age=60"), date, F.col("tag")),
    )
    revisit = F.map_from_arrays(
        F.array(F.lit("Content-Length"), F.lit("cache-control"), F.lit("Last-Modified"), F.lit("ETAG"), F.lit("Server")),
        F.array(F.lit("0"), F.concat(F.lit("max-age="), (p % 100).cast("string")), date, F.when(p % 5 == 0, F.lit('"other"')).otherwise(F.concat(F.lit("W/"), F.col("tag"))), F.lit("edge")),
    )
    one = base.select((p * 2).alias("record_id"), "url", (p * 10).alias("time"), F.lit("response").alias("kind"), F.lit(200).alias("status"), response.alias("headers"))
    two = base.select((p * 2 + 1).alias("record_id"), "url", (p * 10 + F.when(p % 7 == 0, -5).otherwise(5)).alias("time"), F.lit("revisit").alias("kind"), F.lit(304).alias("status"), revisit.alias("headers"))
    return one.unionByName(two)


#: DuckDB SQL with the rows of resolve(records_of(pages)), headers listed.
SQL = r"""
WITH base AS (
  SELECT page_id AS p, regexp_replace(trim(url), '#.*$', '') AS u, substr(md5(html), 1, 16) AS tag, length(html) AS n FROM pages),
cut AS (
  SELECT p, tag, n, u, regexp_replace(regexp_replace(regexp_replace(lower(regexp_extract(u, '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?]*)', 1)), '^.*@', ''), ':(80|443)$', ''), '^www\.', '') AS host,
         regexp_replace(regexp_extract(u, '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//[^/?]*([^?]*)', 1), '/$', '') AS path,
         array_to_string(list_sort(list_filter(string_split(regexp_extract(u, '\?(.*)$', 1), '&'), lambda x: x <> '' AND NOT regexp_matches(x, '^(utm_[^=]*|fbclid|gclid|ref)(=|$)'))), '&') AS query
  FROM base),
keyed AS (SELECT p, tag, n, CASE WHEN host = '' THEN u ELSE host || path || CASE WHEN query = '' THEN '' ELSE '?' || query END END AS url_key FROM cut),
revisits AS (SELECT p, tag, url_key, p * 2 + 1 AS record_id, p * 10 + CASE WHEN p % 7 = 0 THEN -5 ELSE 5 END AS time FROM keyed),
matched AS (
  SELECT r.*, q.p AS q, q.tag AS qtag, q.n AS qn
  FROM revisits r ASOF LEFT JOIN (SELECT p, tag, n, url_key, p * 10 AS time FROM keyed) q ON r.url_key = q.url_key AND r.time > q.time),
judged AS (
  SELECT *, q IS NOT NULL AND CASE WHEN q % 11 <> 0 THEN p % 5 <> 0 AND tag = qtag ELSE p % 28 = q % 28 END AS good FROM matched)
SELECT record_id, url_key, time,
       CASE WHEN q IS NULL THEN 'no_response' WHEN good THEN 'resolved' ELSE 'mismatch' END AS outcome,
       CASE WHEN good THEN q * 2 END AS response_id,
       array_to_string(list_sort(
         ['cache-control: max-age=' || (p % 100), 'last-modified: day ' || (p % 28), 'server: edge',
          'etag: ' || CASE WHEN p % 5 = 0 THEN '"other"' ELSE 'W/' || tag END,
          'content-length: ' || CASE WHEN good THEN qn ELSE 0 END]
         || CASE WHEN good THEN ['content-type: text/html'] ELSE [] END
         || CASE WHEN good AND q % 11 = 0 THEN ['x-none: ' || qtag] ELSE [] END), chr(10)) AS headers
FROM judged
"""
