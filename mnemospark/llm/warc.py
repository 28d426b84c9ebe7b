"""WARC records: not-modified revisits resolved to the full responses that they confirm.

A revisit says that a resource had not changed. Its body is that of the latest earlier full response with the same
canonical URL, if the revisit's validators (ETag, else Last-Modified, else payload digest) agree with that response's;
its headers are that response's with those that a 304 answer may renew taken from the revisit.

The as-of join goes by canonical URL and time. At one URL and time only the response with the largest id is ever asked
for, so responses are first reduced to one each. A URL's records are dealt to slots between quantiles of time over all
records, and revisits at a time that fills several slots are spread over these; so a hot URL does not gather in one task,
whatever the times are. Within a slot a running last value finds the response; what a slot inherits from earlier ones is
the last response of each, carried over at most SLICES rows a URL.

Defined results: records without URL or time resolve to nothing; at equal times a response comes before a revisit, and
the larger record id is later; repeated revisits resolve alike; a revisit without any validator that the response has
too is "unverified"; empty tables give no rows; columns that are not named here are not looked at.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Scratch

SLICES = 1024
#: Headers that a not-modified answer may renew, in lower case.
RENEWED = ("cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary", "age", "warning")
#: Query parameters that only track.
TRACKING = "utm_[A-Za-z]+|ref|fbclid|gclid"


def canonical(url: Column) -> Column:
    """One form for the spellings of a URL: scheme, www and m hosts, default ports, fragments, tracking, closing slashes and index pages go."""
    u = F.regexp_replace(F.trim(url), "#.*$", "")
    u = F.regexp_replace(u, "^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = F.lower(F.regexp_extract(u, "^([^/?]*)", 1))
    rest = F.regexp_replace(u, "^[^/?]*", "")
    host = F.regexp_replace(F.regexp_replace(host, "^(www|m)[.]", ""), ":(80|443)$", "")
    rest = F.regexp_replace(rest, f"([?&])({TRACKING})=[^&]*", "$1")
    rest = F.regexp_replace(F.regexp_replace(F.regexp_replace(rest, "&+", "&"), "[?]&", "?"), "[?&]+$", "")
    rest = F.regexp_replace(rest, "/(index[.]html?)?$", "")
    return F.concat(host, rest)


def slots(cuts: list[int]):
    """A column function of times and spreads: the slot between sorted cuts; a time that several cuts equal has all slots around them."""
    edges = np.array(cuts, "int64")

    @F.pandas_udf("int")
    def slot(ts: pd.Series, spread: pd.Series) -> pd.Series:
        low, high = np.searchsorted(edges, ts, "left"), np.searchsorted(edges, ts, "right")
        return pd.Series(low + spread.to_numpy() % (high - low + 1)).astype("int32")

    return slot


def resolve(records: DataFrame) -> DataFrame:
    """Adds canonical_url, response_id, status, headers_merged and digest_resolved to the revisits of a record table.

    records: record_id long, url, ts long, kind ("response" or "revisit"), headers map<string,string> with lower-case
    names, digest (of the payload). status is "verified", "stale", "unverified" or "unresolved".
    """
    r = records.select("record_id", "url", F.col("ts").cast("long").alias("ts"), "kind", "headers", "digest").withColumn("canonical_url", canonical(F.col("url")))
    r = Scratch(records.sparkSession).keep(r)  # every branch below reads these slim rows, not what they come from
    cuts = r.agg(F.percentile_approx("ts", [i / SLICES for i in range(1, SLICES)])).first()[0]
    slot = slots(cuts or [])
    usable = r.where("canonical_url is not null and ts is not null")
    named = F.struct("record_id", "headers", "digest")
    answers = usable.where("kind = 'response'").groupBy("canonical_url", "ts").agg(F.max_by(named, F.struct("record_id", "digest")).alias("full")).withColumn("slice", slot("ts", F.lit(0).cast("long")))
    asks = usable.where("kind = 'revisit'").withColumn("slice", slot("ts", F.pmod(F.xxhash64("record_id", "url", "digest"), F.lit(1 << 31))))
    order = [F.col("ts"), F.when(F.col("full").isNotNull(), 0).otherwise(1)]
    within = Window.partitionBy("canonical_url", "slice").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    near = asks.unionByName(answers, allowMissingColumns=True).withColumn("near", F.last("full", ignorenulls=True).over(within)).where("full is null").drop("full")
    # the last response of each slot that has one, then what each slot inherits
    lasts = answers.groupBy("canonical_url", "slice").agg(F.max_by("full", "ts").alias("last"))
    marks = lasts.select("canonical_url", "slice", "last", F.lit(False).alias("asks")).unionByName(near.select("canonical_url", "slice").distinct().withColumn("last", F.lit(None).cast(lasts.schema["last"].dataType)).withColumn("asks", F.lit(True)))
    earlier = Window.partitionBy("canonical_url").orderBy("slice").rangeBetween(Window.unboundedPreceding, -1)
    inherited = marks.withColumn("far", F.last("last", ignorenulls=True).over(earlier)).where("asks").select("canonical_url", "slice", "far")
    found = near.join(inherited, ["canonical_url", "slice"], "left").withColumn("hit", F.coalesce("near", "far"))
    h, e = F.col("headers"), F.col("hit.headers")
    both = lambda a, b: a.isNotNull() & b.isNotNull()
    status = (
        F.when(F.col("hit").isNull(), "unresolved")
        .when(both(h["etag"], e["etag"]), F.when(_weak(h["etag"]) == _weak(e["etag"]), "verified").otherwise("stale"))
        .when(both(h["last-modified"], e["last-modified"]), F.when(h["last-modified"] == e["last-modified"], "verified").otherwise("stale"))
        .when(both(F.col("digest"), F.col("hit.digest")), F.when(F.col("digest") == F.col("hit.digest"), "verified").otherwise("stale"))
        .otherwise("unverified")
    )
    empty = F.expr("cast(map() as map<string,string>)")
    old = F.map_filter(F.coalesce(e, empty), lambda k, v: ~F.coalesce(F.map_contains_key(F.coalesce(h, empty), k), F.lit(False)) | ~k.isin(*RENEWED))
    new = F.map_filter(F.coalesce(h, empty), lambda k, v: k.isin(*RENEWED))
    answered = found.withColumn("status", status).select(
        "record_id", "url", "ts", "canonical_url", "status",
        F.when(F.col("status").isin("verified", "unverified"), F.col("hit.record_id")).alias("response_id"),
        F.when(F.col("status").isin("verified", "unverified"), F.map_concat(old, new)).alias("headers_merged"),
        F.when(F.col("status").isin("verified", "unverified"), F.col("hit.digest")).alias("digest_resolved"),
    )
    lost = r.where("kind = 'revisit' and (canonical_url is null or ts is null)")
    return answered.unionByName(lost.select("record_id", "url", "ts", "canonical_url", F.lit("unresolved").alias("status")), allowMissingColumns=True)


def captures(pages: DataFrame) -> DataFrame:
    """A crawl's records from a table of pages: a full response for each page in the order of ids, and a later revisit.

    The page's digest is its ETag. The revisit comes REVISIT_AFTER pages later, under the page's URL with a tracking
    parameter; every third revisit has no ETag but a Last-Modified, which responses share by the hundred.
    """
    p = pages.select(F.col("page_id").cast("long").alias("id"), "url", F.sha2(F.coalesce(F.col("html").cast("string"), F.lit("")), 256).alias("digest"))
    stamp = F.concat(F.lit("day "), (F.floor(F.col("id") / 100)).cast("string"))
    response = p.select((2 * F.col("id")).alias("record_id"), "url", (2 * F.col("id")).alias("ts"), F.lit("response").alias("kind"),
                        F.create_map(F.lit("etag"), F.concat(F.lit('"'), "digest", F.lit('"')), F.lit("last-modified"), stamp, F.lit("content-type"), F.lit("text/html")).alias("headers"), "digest")
    renewed = F.when(F.col("id") % 3 == 0, F.create_map(F.lit("last-modified"), stamp, F.lit("date"), F.col("id").cast("string"), F.lit("content-type"), F.lit("none"))).otherwise(
        F.create_map(F.lit("etag"), F.concat(F.lit('W/"'), "digest", F.lit('"')), F.lit("date"), F.col("id").cast("string")))
    revisit = p.select((2 * F.col("id") + 1).alias("record_id"), F.concat(F.regexp_replace("url", "[?#].*$", ""), F.lit("?utm_source=again")).alias("url"), (2 * (F.col("id") + REVISIT_AFTER) + 1).alias("ts"),
                       F.lit("revisit").alias("kind"), renewed.alias("headers"), F.lit(None).cast("string").alias("digest"))
    return response.unionByName(revisit)


REVISIT_AFTER = 5000


def _weak(tag: Column) -> Column:
    return F.regexp_replace(tag, "^W/", "")


def flat_headers(headers: Column) -> Column:
    """name=value of a map's entries by name, joined by semicolons."""
    return F.array_join(F.transform(F.array_sort(F.map_entries(headers)), lambda x: F.concat_ws("=", x["key"], x["value"])), ";")


def report(pages: DataFrame) -> DataFrame:
    return resolve(captures(pages)).select("record_id", "canonical_url", "status", "response_id", "digest_resolved", flat_headers(F.col("headers_merged")).alias("headers"))


#: The same over a table of pages in DuckDB.
ORACLE = r"""
with p as (select page_id::bigint id, url, sha256(coalesce(html, '')) digest from pages),
recs as (
  select 2 * id record_id, url, 2 * id ts, 0 kind, '"' || digest || '"' etag, 'day ' || (id // 100)::varchar lm, null::varchar dt, digest from p
  union all
  select 2 * id + 1, regexp_replace(url, '[?#].*$', '') || '?utm_source=again', 2 * (id + 5000) + 1, 1,
         case when id % 3 = 0 then null else '"' || digest || '"' end, case when id % 3 = 0 then 'day ' || (id // 100)::varchar end, id::varchar, null from p),
a as (select *, regexp_replace(regexp_replace(trim(url), '#.*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://', '') u from recs),
b as (select *, regexp_replace(regexp_replace(lower(regexp_extract(u, '^([^/?]*)', 1)), '^(www|m)[.]', ''), ':(80|443)$', '') host,
             regexp_replace(regexp_replace(u, '^[^/?]*', ''), '([?&])(utm_[A-Za-z]+|ref|fbclid|gclid)=[^&]*', '\1', 'g') rest from a),
c as (select *, host || regexp_replace(regexp_replace(regexp_replace(regexp_replace(rest, '&+', '&', 'g'), '[?]&', '?', 'g'), '[?&]+$', ''), '/(index[.]html?)?$', '') canonical_url from b),
f as (select *, last_value(case when kind = 0 then {'id': record_id, 'etag': etag, 'lm': lm, 'digest': digest} end ignore nulls)
        over (partition by canonical_url order by ts, kind, record_id rows between unbounded preceding and current row) hit from c),
s as (select *, case when hit is null then 'unresolved'
        when etag is not null then case when etag = hit.etag then 'verified' else 'stale' end
        when lm = hit.lm then 'verified' else 'stale' end status from f where kind = 1)
select record_id, canonical_url, status,
  case when status = 'verified' then hit.id end response_id,
  case when status = 'verified' then hit.digest end digest_resolved,
  case when status = 'verified' then 'content-type=text/html;date=' || dt || ';etag=' || case when etag is null then hit.etag else 'W/' || etag end || ';last-modified=' || hit.lm end headers
from s
"""
