"""Not-modified revisits of web archives, resolved to the response they stand for.

A revisit record says that a server answered 304: its content is that of the
latest earlier full response of the same canonical URL. That is an as-of join.
It is done without a window over a whole URL, since one URL may have a third of
all records: records are sorted by (URL, date, id) into buckets of equal size, so
that a URL takes as many buckets as its records fill, whatever their dates;
within a bucket the latest response is carried forward over the records of (URL,
bucket), and across buckets over one row a bucket.

A match is checked: an ETag that both give must agree (weakly); else a
Last-Modified that both give; else the match is unvalidated. A 304 may update
only the headers that HTTP permits in it; they are merged over the response's.

Defined results: a record without a date, or whose URL is null, has no match and
is no match; of responses with one date the one with the larger id is later, and
a revisit sees those of its own date with smaller ids (null ids come first);
repeated rows are resolved each on its own; an empty table gives an empty result; extra columns
pass through unless named like an output.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

#: Header fields that a 304 response may update.
PERMITTED = ["age", "cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary"]
#: Query parameters that name a visit, not a page.
TRACKING = "^(?:utm_[^=]*|ref|fbclid|gclid|sessionid|sid)(?:=|$)"
#: Records in a bucket, about.
BUCKET_ROWS = 50_000


def canonical_url(url: Column) -> Column:
    """Scheme, ``www.``/``m.``, default port, fragment, tracking parameters and the last slash dropped; host lower-cased; parameters sorted. Null for null or blank."""
    plain = F.regexp_replace(F.regexp_replace(F.trim(url), "#.*$", ""), "^[A-Za-z][A-Za-z0-9+.\\-]*://", "")
    host = F.regexp_replace(F.lower(F.regexp_extract(plain, "^([^/?]*)", 1)), "^(?:www|m)\\.|:(?:80|443)$", "")
    path = F.regexp_replace(F.regexp_extract(plain, "^[^/?]*([^?]*)", 1), "/+$", "")
    pairs = F.array_sort(F.filter(F.split(F.regexp_extract(plain, "\\?(.*)$", 1), "&"), lambda p: (p != "") & ~F.lower(p).rlike(TRACKING)))
    query = F.when(F.size(pairs) > 0, F.concat(F.lit("?"), F.array_join(pairs, "&"))).otherwise("")
    return F.when(F.length(F.trim(url)) > 0, F.concat(host, path, query))


def _header(headers: Column, name: str) -> Column:
    return F.try_element_at(headers, F.lit(name))


def _strong(etag: Column) -> Column:
    return F.regexp_replace(etag, "^W/", "")


def resolve_revisits(records: DataFrame, id_: str = "record_id", url: str = "url", at: str = "at", full: str = "is_full", headers: str = "headers", bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """``records`` with canonical_url, match_id, match_at, validation and merged_headers.

    ``at`` is the record's time as a timestamp, ``is_full`` whether it has a
    full response, ``headers`` a map with lower-case names. For a full response
    ``validation`` is 'full' and the headers are its own; for a revisit it is
    'etag', 'last-modified', 'unvalidated', 'mismatch' or 'unmatched', and only
    the first three have a match.
    """
    out = ["canonical_url", "match_id", "match_at", "validation", "merged_headers"]
    rows = records.select(*[c for c in records.columns if c not in out]).withColumn("canonical_url", canonical_url(F.col(url)))
    rows = rows.withColumn("_full", F.coalesce(F.col(full), F.lit(False)) & F.col("canonical_url").isNotNull() & F.col(at).isNotNull())
    rows = rows.withColumn("_row", F.monotonically_increasing_id())
    least = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartitionByRange(max(least, rows.count() // bucket_rows + 1), "canonical_url", F.col(at), F.col(id_), "_row")
    rows = cut(rows.withColumn("_bucket", F.spark_partition_id()), "records")
    response = F.struct(F.col(at).alias("at"), F.col(id_).alias("id"), F.col(headers).alias("headers"))
    latest = rows.filter("_full").groupBy("canonical_url", "_bucket").agg(F.max_by(response, F.struct(F.col(at), F.col(id_), F.col("_row"))).alias("_last"))
    over_buckets = Window.partitionBy("canonical_url").orderBy("_bucket")
    needed = rows.select("canonical_url", "_bucket").distinct()
    marks = needed.withColumn("_new", F.lit(None).cast(latest.schema["_last"].dataType)).unionByName(latest.select("canonical_url", "_bucket", F.col("_last").alias("_new")))
    per_bucket = marks.groupBy("canonical_url", "_bucket").agg(F.first("_new", ignorenulls=True).alias("_new"))
    carried = per_bucket.withColumn("_before", F.last("_new", ignorenulls=True).over(over_buckets.rowsBetween(Window.unboundedPreceding, -1))).filter("_before is not null").select("canonical_url", "_bucket", "_before")
    within = Window.partitionBy("canonical_url", "_bucket").orderBy(F.col(at), F.col(id_), "_row").rowsBetween(Window.unboundedPreceding, -1)
    joined = rows.withColumn("_own", F.last(F.when(F.col("_full"), response), ignorenulls=True).over(within)).join(carried, ["canonical_url", "_bucket"], "left")
    found = F.when(~F.col("_full") & F.col("canonical_url").isNotNull() & F.col(at).isNotNull(), F.coalesce("_own", "_before"))
    joined = joined.withColumn("_found", found)
    mine, theirs = F.col(headers), F.col("_found.headers")
    etags = _header(mine, "etag").isNotNull() & _header(theirs, "etag").isNotNull()
    dates = _header(mine, "last-modified").isNotNull() & _header(theirs, "last-modified").isNotNull()
    check = F.when(F.col("_full"), "full").when(F.col("_found").isNull(), "unmatched")
    check = check.when(etags, F.when(_strong(_header(mine, "etag")) == _strong(_header(theirs, "etag")), "etag").otherwise("mismatch"))
    check = check.when(dates, F.when(_header(mine, "last-modified") == _header(theirs, "last-modified"), "last-modified").otherwise("mismatch")).otherwise("unvalidated")
    joined = joined.withColumn("validation", check)
    good = F.col("validation").isin("etag", "last-modified", "unvalidated")
    none = F.create_map().cast("map<string,string>")
    updates = F.map_filter(F.coalesce(mine, none), lambda k, v: k.isin(*PERMITTED) & v.isNotNull())
    merged = F.map_concat(F.map_filter(F.coalesce(theirs, none), lambda k, v: ~F.array_contains(F.map_keys(updates), k)), updates)
    return joined.select(
        *[c for c in rows.columns if c not in ("_full", "_bucket", "_row")],
        F.when(good, F.col("_found.id")).alias("match_id"), F.when(good, F.col("_found.at")).alias("match_at"), "validation",
        F.when(good, merged).when(F.col("_full"), F.coalesce(mine, none)).alias("merged_headers"),
    )
