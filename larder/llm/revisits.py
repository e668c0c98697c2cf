"""Not-modified captures of a web archive, resolved to the latest earlier full response of their address."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Headers that a not-modified response may bring up to date; all others stay those of the full response.
PERMITTED = ("cache-control", "content-location", "date", "etag", "expires", "vary")
#: Seconds of a span of an address's history that is ordered in one task.
SPAN = 86_400

COLUMNS = ["capture_id", "url", "ts", "status", "etag", "last_modified", "digest", "n_body", "headers"]


def canonical_url(url: Column) -> Column:
    """https, host in lower case, without fragment, default port, tracking parameters and closing slash."""
    out = F.regexp_replace(F.trim(url), "#.*$", "")
    head = F.regexp_extract(out, "^([A-Za-z]+://[^/?]*)", 1)
    out = F.concat(F.lower(head), F.substr(out, F.length(head) + 1))
    out = F.regexp_replace(out, "^http://", "https://")
    out = F.regexp_replace(out, "^(https://[^/?:]*):(80|443)([/?]|$)", "$1$3")
    out = F.regexp_replace(out, "([?&])utm_[^&]*", "$1")
    out = F.regexp_replace(F.regexp_replace(out, "&&+", "&"), "[?]&+", "?")
    return F.regexp_replace(F.regexp_replace(out, "[?&]+$", ""), "/+$", "")


def same_entity(revisit: str, full: str) -> Column:
    """Do the validators agree? Entity tags decide if both have one (weak comparison), else dates, else digests; else null."""
    tag = "regexp_replace({0}.etag, '^W/', '')"
    return F.expr(
        f"case when {revisit}.etag is not null and {full}.etag is not null then {tag.format(revisit)} = {tag.format(full)}"
        f" when {revisit}.last_modified is not null and {full}.last_modified is not null"
        f" then {revisit}.last_modified = {full}.last_modified"
        f" else {revisit}.digest = {full}.digest end")


def resolve(captures: DataFrame, span: int = SPAN) -> DataFrame:
    """Give every not-modified capture the payload and headers of the response it stands for.

    `captures` has capture_id, url, ts (seconds), status, etag, last_modified, digest, n_body, headers (map). A capture of
    status 304 looks for the latest capture of status 200 with the same canonical address and an earlier time (of equal
    times the largest id). Returns one row per capture: capture_id, canonical_url, ts, outcome, source_id, status, digest, n_body, headers.

    outcome is `full` (any other status: the row as it is), `resolved` (validators agree: status 200, the source's
    payload, and its headers with the permitted ones of the capture laid over), `changed` (validators differ),
    `unchecked` (nothing to compare), `orphan` (no earlier response or no address); the last three keep
    their own fields and have no payload. Histories are ordered in spans of `span` seconds, each handed on by the last response of the spans
    before, so an address with very many captures is spread over its spans. Null times have no
    earlier response and are not one. Repeated rows are resolved alike. Extra columns are ignored.
    """
    rows = captures.select(*COLUMNS).withColumn("canonical_url", canonical_url(F.col("url")))
    rows = rows.withColumn("_span", F.floor(F.col("ts") / span))
    ordered = F.struct("ts", "capture_id", "etag", "last_modified", "digest", "n_body", F.to_json("headers").alias("headers"))
    rows = rows.withColumn("_full", F.when((F.col("status") == 200) & F.col("ts").isNotNull(), ordered))
    placed = rows.where("canonical_url is not null and ts is not null")
    lost = rows.where("canonical_url is null or ts is null").withColumn("_source", F.lit(None).cast(rows.schema["_full"].dataType))

    earlier = Window.partitionBy("canonical_url", "_span").orderBy("ts").rangeBetween(Window.unboundedPreceding, -1)
    placed = placed.withColumn("_inside", F.max("_full").over(earlier))
    spans = placed.groupBy("canonical_url", "_span").agg(F.max("_full").alias("_last"))
    spans = spans.withColumn("_before", F.max("_last").over(
        Window.partitionBy("canonical_url").orderBy("_span").rowsBetween(Window.unboundedPreceding, -1)))
    placed = placed.join(spans.select("canonical_url", "_span", "_before"), ["canonical_url", "_span"], "left")
    placed = placed.withColumn("_source", F.coalesce("_inside", "_before"))
    names = [*COLUMNS, "canonical_url", "_source"]
    rows = placed.select(*names).unionByName(lost.select(*names)).alias("c")

    same = same_entity("c", "_source")
    outcome = (
        F.when(F.coalesce(F.col("status") != 304, F.lit(True)), "full").when(F.col("_source").isNull(), "orphan")
        .when(same, "resolved").when(same.isNull(), "unchecked").otherwise("changed")
    )
    rows = rows.withColumn("outcome", outcome)
    found = F.col("outcome") == "resolved"
    own = F.coalesce("headers", F.create_map().cast("map<string,string>"))
    stored = F.coalesce(F.from_json("_source.headers", "map<string,string>"), F.create_map().cast("map<string,string>"))
    fresh = F.map_filter(own, lambda k, _: F.lower(k).isin(*PERMITTED))
    kept = F.map_filter(stored, lambda k, _: ~F.exists(F.map_keys(fresh), lambda other: F.lower(other) == F.lower(k)))
    return rows.select(
        "capture_id", "canonical_url", "ts", "outcome",
        F.when(found, F.col("_source.capture_id")).alias("source_id"),
        F.when(found, F.lit(200)).otherwise(F.col("status")).alias("status"),
        F.when(found, F.col("_source.digest")).when(F.col("outcome") == "full", F.col("digest")).alias("digest"),
        F.when(found, F.col("_source.n_body")).when(F.col("outcome") == "full", F.col("n_body")).alias("n_body"),
        F.when(found, F.map_concat(kept, fresh)).otherwise(F.col("headers")).alias("headers"),
    )


def header_text(headers: str) -> Column:
    """Headers as one string, by name."""
    lines = F.transform(F.array_sort(F.map_entries(headers)), lambda e: F.concat(e["key"], F.lit(": "), e["value"]))
    return F.array_join(lines, "; ")


def captures_of(pages: DataFrame) -> DataFrame:
    """Archive records derived from pages: a full response of each, and up to three later not-modified captures.

    Later captures spell the address differently; every seventh page's second one has another entity tag, and
    of every fifth page the first capture is the not-modified one, so it has nothing to refer to
    unless another page has the same canonical address.
    """
    body = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select("page_id", "url", F.md5(body).alias("digest"), F.length(body).cast("long").alias("n_body"))
    rows = rows.withColumn("j", F.explode(F.sequence(F.lit(0), F.pmod("page_id", F.lit(4)).cast("int"))))
    first = F.when(F.pmod("page_id", F.lit(5)) == 0, 1).otherwise(0)
    full = F.col("j") == F.least(first, F.pmod("page_id", F.lit(4)))
    tag = F.concat(F.lit('W/"'), F.substring("digest", 1, 12), F.when((F.pmod("page_id", F.lit(7)) == 0) & (F.col("j") == 2), "x").otherwise(""), F.lit('"'))
    ts = F.lit(1_700_000_000) + F.pmod(F.col("page_id") * 7919, F.lit(1_000_000)) + F.col("j") * 40_000
    spelled = F.when(F.col("j") == 1, F.concat("url", F.lit("#part"))).when(
        F.col("j") == 2, F.concat("url", F.when(F.instr("url", "#") > 0, "").when(F.instr("url", "?") > 0, "&utm_source=a").otherwise("?utm_source=a"))
    ).otherwise(F.col("url"))
    headers = F.when(full, F.create_map(
        F.lit("content-type"), F.lit("text/html"), F.lit("date"), ts.cast("string"), F.lit("etag"), tag, F.lit("server"), F.lit("s0"))
    ).otherwise(F.create_map(
        F.lit("cache-control"), F.concat(F.lit("max-age="), F.col("j").cast("string")), F.lit("date"), ts.cast("string"), F.lit("server"), F.lit("s1")))
    return rows.select(
        (F.col("page_id") * 4 + F.col("j")).alias("capture_id"), spelled.alias("url"), ts.cast("long").alias("ts"),
        F.when(full, 200).otherwise(304).alias("status"), tag.alias("etag"), F.lit(None).cast("string").alias("last_modified"),
        F.when(full, F.col("digest")).alias("digest"), F.when(full, F.col("n_body")).alias("n_body"), headers.alias("headers"),
    )


SQL = """
with p as (select page_id, url, md5(coalesce(html, '')) as digest, cast(length(coalesce(html, '')) as bigint) as n_body from pages),
j as (select p.*, x.j, x.j = least(case when page_id % 5 = 0 then 1 else 0 end, page_id % 4) as is_full
  from p, (select unnest([0, 1, 2, 3]) as j) as x where x.j <= page_id % 4),
c as (
  select page_id * 4 + j as capture_id, j, is_full, digest, n_body,
    1700000000 + (page_id * 7919) % 1000000 + j * 40000 as ts,
    'W/"' || substr(digest, 1, 12) || case when page_id % 7 = 0 and j = 2 then 'x' else '' end || '"' as etag,
    case when j = 1 then url || '#part' when j = 2 and position('#' in url) = 0 then url || case when position('?' in url) > 0 then '&' else '?' end || 'utm_source=a' else url end as url
  from j),
h as (select *, regexp_replace(trim(url), '#.*$', '') as u from c),
l as (select *, lower(regexp_extract(u, '^([A-Za-z]+://[^/?]*)', 1)) || substr(u, length(regexp_extract(u, '^([A-Za-z]+://[^/?]*)', 1)) + 1) as v from h),
n as (
  select *, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(v,
    '^http://', 'https://'), '^(https://[^/?:]*):(80|443)([/?]|$)', '\\1\\3'), '([?&])utm_[^&]*', '\\1', 'g'),
    '&&+', '&', 'g'), '[?]&+', '?', 'g'), '[?&]+$', ''), '/+$', '') as canonical_url
  from l),
f as (select canonical_url, ts, max(capture_id) as source_id from n where is_full group by canonical_url, ts),
s as (
  select n.capture_id, max(f.ts) as source_ts from n join f on n.canonical_url = f.canonical_url and f.ts < n.ts
  where not n.is_full group by n.capture_id),
m as (
  select n.*, f.source_id, g.etag as source_etag, g.digest as source_digest, g.n_body as source_body, g.ts as source_ts
  from n left join s on n.capture_id = s.capture_id left join f on f.canonical_url = n.canonical_url and f.ts = s.source_ts
  left join n as g on g.capture_id = f.source_id),
o as (
  select *, case when is_full then 'full' when source_id is null then 'orphan' when etag = source_etag then 'resolved' else 'changed' end as outcome
  from m)
select capture_id, canonical_url, ts, outcome,
  case when outcome = 'resolved' then source_id end as source_id,
  case when outcome in ('resolved', 'full') then 200 else 304 end as status,
  case outcome when 'resolved' then source_digest when 'full' then digest end as digest,
  case outcome when 'resolved' then source_body when 'full' then n_body end as n_body,
  case outcome when 'full' then 'content-type: text/html; date: ' || ts || '; etag: ' || etag || '; server: s0'
    when 'resolved' then 'cache-control: max-age=' || j || '; content-type: text/html; date: ' || ts || '; etag: ' || source_etag || '; server: s0'
    else 'cache-control: max-age=' || j || '; date: ' || ts || '; server: s1' end as headers
from o"""
