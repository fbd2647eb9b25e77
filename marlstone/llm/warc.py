"""Not-modified revisits of web captures, resolved to the full response they stand for.

A capture is (id, url, time, status, headers). A revisit (status 304) takes the latest full response (status 200) of the same
canonical URL before it, if the validators agree: the entity tags where both have one, else the dates of last change where both
have one. Header names count in any letter case and tags by weak comparison. The result has the full response's headers with those
of the revisit that a 304 may bring in their place, each spelled as it came.

The as-of join cuts time into slices of about ``SLICE_ROWS`` captures; a slice of one URL is worked on alone and gets the last full
response before it as a carry, so a URL with a third of all captures is spread over many tasks.

Rows: captures of equal time are ordered by id (nulls last); null urls, times or other states are kept, unresolved. A revisit without an
earlier full response is ``no_response``; one whose validators disagree or are missing is ``changed``. Null headers are empty.
Repeated full responses are alike; of equal places either may be taken. Empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SLICE_ROWS = 50_000
#: Headers that a 304 response may bring anew.
PERMITTED = ("cache-control", "content-location", "date", "etag", "expires", "vary", "last-modified", "age", "warning")


#: Query parameters that only track where a visitor comes from.
TRACKERS = "^(utm_[a-z]+|gclid|dclid|fbclid|msclkid|mc_cid|mc_eid)(=|$)"


def canonical_url(url: Column) -> Column:
    """Without scheme, leading www., default port, fragment, tracking parameters and the path's trailing slash; the host in lower case, the parameters sorted."""
    bare = F.regexp_replace(F.regexp_replace(url, "#.*$", ""), "^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = F.regexp_replace(F.regexp_replace(F.lower(F.regexp_extract(bare, "^([^/?]*)", 1)), "^www\\.", ""), ":(80|443)$", "")
    path = F.regexp_replace(F.regexp_extract(bare, "^[^/?]*([^?]*)", 1), "/+$", "")
    query = F.array_sort(F.filter(F.split(F.regexp_extract(bare, "^[^?]*\\?(.*)$", 1), "&"), lambda p: (p != "") & ~p.rlike(TRACKERS)))
    return F.concat(host, path, F.when(F.size(query) > 0, F.concat(F.lit("?"), F.array_join(query, "&"))).otherwise(""))


def header(headers: Column, name: str) -> Column:
    """The value of the first header of that name in any letter case."""
    return F.get(F.filter(F.map_entries(headers), lambda e: F.lower(F.trim(e["key"])) == name), F.lit(0))["value"]


def entity_tag(headers: Column) -> Column:
    """The entity tag without the mark of a weak one: a 304 answers by weak comparison."""
    return F.regexp_replace(F.trim(header(headers, "etag")), "^W/", "")


def resolve(captures: DataFrame, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """(id, canonical, time, status, outcome, response_id, headers) for every capture; ``captures`` as above, headers a map.

    ``outcome`` is ``response`` for full responses, ``resolved``, ``changed`` or ``no_response`` for revisits, ``other`` for the rest.
    """
    rows = captures.select("id", canonical_url(F.col("url")).alias("canonical"), F.col("time").cast("long").alias("time"), "status",
                           F.coalesce("headers", F.create_map().cast("map<string,string>")).alias("headers"))
    n, low, high = rows.agg(F.count(F.lit(1)), F.min("time"), F.max("time")).head()
    width = max(1, -(-((high or 0) - (low or 0) + 1) // max(1, -(-n // slice_rows))))
    full = (F.col("status") == 200) & F.col("time").isNotNull()
    cut = rows.withColumn("slice", F.coalesce(F.floor((F.col("time") - F.lit(low or 0)) / F.lit(width)), F.lit(-1))).withColumn(
        "own", F.when(full, F.struct("id", "headers")))
    ends = (cut.filter(full & F.col("canonical").isNotNull()).groupBy("canonical", "slice")
            .agg(F.max_by("own", F.struct("time", F.col("id").isNull(), "id")).alias("end")))
    # One row per slice in which a URL was captured at all, with the last full response of the slices before.
    steps = cut.filter("canonical is not null").select("canonical", "slice").distinct().join(ends, ["canonical", "slice"], "left")
    before = Window.partitionBy("canonical").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    carried = steps.select(F.col("canonical").alias("_canonical"), F.col("slice").alias("_slice"), F.last("end", ignorenulls=True).over(before).alias("carry"))
    joined = cut.join(carried, (F.col("canonical") == F.col("_canonical")) & (F.col("slice") == F.col("_slice")), "left")
    within = Window.partitionBy("canonical", "slice").orderBy("time", F.col("id").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    base = F.when(F.col("canonical").isNotNull() & F.col("time").isNotNull(), F.coalesce(F.last("own", ignorenulls=True).over(within), F.col("carry")))
    found = joined.withColumn("base", base)

    own, theirs = F.col("headers"), F.col("base.headers")
    agree = F.coalesce(entity_tag(theirs) == entity_tag(own), F.trim(header(theirs, "last-modified")) == F.trim(header(own, "last-modified")), F.lit(False))
    revisit = F.col("status") == 304
    outcome = (F.when(full, "response").when(~F.coalesce(revisit, F.lit(False)), "other").when(F.col("base").isNull(), "no_response")
               .when(agree, "resolved").otherwise("changed"))
    brought = F.map_filter("headers", lambda k, v: F.lower(F.trim(k)).isin(*PERMITTED))
    kept = F.map_filter("base.headers", lambda k, v: ~F.exists(F.map_keys(brought), lambda b: F.lower(F.trim(b)) == F.lower(F.trim(k))))
    done = found.withColumn("outcome", outcome)
    resolved = F.col("outcome") == "resolved"
    return done.select("id", "canonical", "time", "status", "outcome",
                       F.when(F.col("outcome") == "response", F.col("id")).when(resolved, F.col("base.id")).alias("response_id"),
                       F.when(resolved, F.map_concat(kept, brought)).otherwise(F.col("headers")).alias("headers"))
