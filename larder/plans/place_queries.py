"""Facilities, news and drug labels."""

from __future__ import annotations

from pyspark.sql import functions as F

from larder import vocab
from larder.functions import text
from larder.operators import drugs, news, places
from larder.plans.registry import query
from larder.plans.views import (
    AS_OF, K, articles, load, place_requests, place_requests_sql, view, with_views,
)

REQ = f"raw_requests AS ({place_requests_sql()})"
REASON = f"""CASE WHEN coalesce(city, '') = '' THEN '{vocab.CITY_MISSING}' WHEN coalesce(zipcode, '') = '' THEN '{vocab.ZIP_MISSING}'
  WHEN NOT regexp_full_match(zipcode, '[0-9]{{5}}(-[0-9]{{4}})?') THEN '{vocab.ZIP_INVALID}' END"""
NORMAL = f"""{REQ}, requests AS (SELECT * REPLACE (
  CASE WHEN facility_type = 'community_center' THEN 'mental_health_group' ELSE facility_type END AS facility_type,
  CASE WHEN facility_type IN ('pharmacy', 'mental_health_group', 'community_center') THEN '' ELSE chronic_condition END AS chronic_condition)
  FROM raw_requests WHERE ({REASON}) IS NULL)"""


def _valid(spark, sf_dir):
    checked = places.check_requests(place_requests(spark, sf_dir))
    return places.normalize_requests(checked.filter("reason IS NULL").drop("reason"))


@query("validate_zip", f"""
SELECT {K}, coalesce(regexp_full_match(z, '[0-9]{{5}}(-[0-9]{{4}})?'), false) AS valid FROM (
  SELECT {K}, CASE {K} % 6 WHEN 0 THEN '1234' WHEN 1 THEN '12345-6789' WHEN 2 THEN '12345-67' WHEN 3 THEN NULL
  WHEN 4 THEN '123456' ELSE CAST(10000 + {K} % 80000 AS VARCHAR) END AS z FROM customer)""")
def validate_zip(spark, sf_dir):
    zips = f"""CASE {K} % 6 WHEN 0 THEN '1234' WHEN 1 THEN '12345-6789' WHEN 2 THEN '12345-67' WHEN 3 THEN NULL
      WHEN 4 THEN '123456' ELSE CAST(10000 + {K} % 80000 AS STRING) END AS z"""
    return load(spark, sf_dir, "customer").selectExpr(K, zips).select(
        K, text.zip_is_valid(F.col("z")).alias("valid"))


@query("validate_required", f"WITH {REQ} SELECT request_id, {REASON} AS reason FROM raw_requests")
def validate_required(spark, sf_dir):
    return places.check_requests(place_requests(spark, sf_dir)).select("request_id", "reason")


@query("validate_city_zip", f"""
WITH {NORMAL} SELECT request_id, contains(line, lower(city)) AND contains(line, zipcode) AS valid FROM (
  SELECT request_id, city, zipcode, lower('Main St ' || 'City' || CAST(request_id % 5 AS VARCHAR) || ' 1234' || CAST(request_id % 7 AS VARCHAR)) AS line
  FROM requests)""")
def validate_city_zip(spark, sf_dir):
    part = lambda c: F.struct(c.alias("long_name"))
    key = F.col("request_id")
    components = F.array(
        part(F.lit("Main St")), part(F.concat(F.lit("City"), (key % 5).cast("string"))),
        part(F.concat(F.lit("1234"), (key % 7).cast("string"))))
    return _valid(spark, sf_dir).select(
        "request_id", places.city_zip_match(components, F.col("city"), F.col("zipcode")).alias("valid"))


@query("facility_request_normalize", f"WITH {NORMAL} SELECT request_id, facility_type, chronic_condition FROM requests")
def facility_request_normalize(spark, sf_dir):
    return _valid(spark, sf_dir).select("request_id", "facility_type", "chronic_condition")


def _opt(name: str, before: str, after: str = "", lower: bool = True) -> str:
    value = f"lower(p_{name})" if lower else f"p_{name}"
    return f"CASE WHEN p_{name} IS NOT NULL AND p_{name} <> 'Any' THEN '{before}' || {value} || '{after}' ELSE '' END"


EXTRAS = f"""CASE WHEN facility_type = 'hospital' THEN CASE WHEN p_emergency_services = 'true' THEN ' with emergency services' ELSE '' END
    || {_opt('specialties', ' specializing in ', lower=False)} || {_opt('hospital_type', ' ', ' hospital')}
  WHEN facility_type = 'clinic' THEN {_opt('clinic_type', ' ')} || CASE WHEN p_telehealth = 'true' THEN ' with telehealth services' ELSE '' END
    || {_opt('wait_time', ' with ', ' wait times')}
  WHEN facility_type = 'pharmacy' THEN CASE WHEN p_hours = 'Open Now' THEN ' open now' ELSE {_opt('hours', ' with ')} END
    || {_opt('services', ' offering ', lower=False)} || {_opt('pharmacy_type', ' ', ' pharmacy')}
  WHEN facility_type IN ('mental_health_group', 'community_center') THEN {_opt('format', ' ', ' format')}
    || {_opt('facilitation', ' ', ' facilitation')} || {_opt('meeting_frequency', ' meeting ')} || {_opt('focus', ' focused on ', lower=False)}
  ELSE '' END"""


@query("facility_query_text", f"""
WITH {REQ}, a AS (SELECT *, CASE WHEN facility_type <> '' AND NOT contains(query, facility_type)
  THEN 'Find ' || facility_type || ' for ' || chronic_condition || ' in ' || query ELSE query END AS base FROM raw_requests)
SELECT request_id, CASE WHEN coalesce(zipcode, '') <> '' AND NOT contains(base, zipcode) THEN base || ' in zipcode ' || zipcode ELSE base END
  || {EXTRAS} AS query_text FROM a""")
def facility_query_text(spark, sf_dir):
    return place_requests(spark, sf_dir).select("request_id", places.query_text().alias("query_text"))


TERMS = ", ".join(f"('{k}', {r}, '{t}')" for k, r, t in vocab.FACILITY_TERMS)
KINDS = ", ".join(f"'{k}'" for k in dict.fromkeys(k for k, _, _ in vocab.FACILITY_TERMS))


@query("facility_search_terms", f"""
WITH {NORMAL}, terms(kind, term_rank, term) AS (VALUES {TERMS}, ('', 1, '{vocab.FACILITY_TERM_DEFAULT}'))
SELECT request_id, term_rank, CASE WHEN chronic_condition <> '' THEN chronic_condition || ' ' ELSE '' END || term || ' in ' || city || ' ' || zipcode
  AS search_text FROM requests JOIN terms ON kind = CASE WHEN facility_type IN ({KINDS}) THEN facility_type ELSE '' END""")
def facility_search_terms(spark, sf_dir):
    return places.search_terms(_valid(spark, sf_dir)).select("request_id", "term_rank", "search_text")


HITS = f"""terms(facility_type, term_rank, term) AS (VALUES {TERMS}, ('', 1, '{vocab.FACILITY_TERM_DEFAULT}')),
hits AS (SELECT f.*, t.facility_type, t.term_rank FROM facilities f JOIN terms t ON contains(lower(concat_ws(' ', name, address)), t.term)),
uniq AS (SELECT * FROM hits QUALIFY row_number() OVER (PARTITION BY city, zipcode, facility_type, place_id ORDER BY term_rank, listing_rank) = 1),
counted AS (SELECT u.*, (SELECT count(*) FROM uniq e WHERE e.city = u.city AND e.zipcode = u.zipcode AND e.facility_type = u.facility_type
  AND e.term_rank < u.term_rank) AS earlier FROM uniq u),
answers AS (SELECT *, row_number() OVER (PARTITION BY city, zipcode, facility_type ORDER BY term_rank, listing_rank, place_id) AS rank
  FROM counted WHERE earlier < 3 QUALIFY rank <= 5)"""


@query("facility_dedup", with_views(["facilities"], f"""
WITH {HITS} SELECT city, zipcode, facility_type, place_id, CAST(term_rank AS INTEGER) AS term_rank, listing_rank FROM uniq"""))
def facility_dedup(spark, sf_dir):
    return places.dedup_hits(places.text_hits(view(spark, sf_dir, "facilities"))).select(
        "city", "zipcode", "facility_type", "place_id", "term_rank", "listing_rank")


@query("facility_early_stop", with_views(["facilities"], f"""
WITH {HITS} SELECT city, zipcode, facility_type, place_id, rank FROM answers"""))
def facility_early_stop(spark, sf_dir):
    return places.early_stop(places.text_hits(view(spark, sf_dir, "facilities"))).select(
        "city", "zipcode", "facility_type", "place_id", F.col("rank").cast("long").alias("rank"))


TEXT = f"""{NORMAL}, {HITS}, by_text AS (SELECT r.request_id, a.rank, a.place_id, a.name, a.address, a.rating, a.total_ratings,
  a.latitude, a.longitude FROM requests r JOIN answers a ON a.city = r.city AND a.zipcode = r.zipcode
  AND a.facility_type = CASE WHEN r.facility_type IN ({KINDS}) THEN r.facility_type ELSE '' END)"""


@query("facility_text_search", with_views(["facilities"], f"WITH {TEXT} SELECT request_id, rank, place_id, rating FROM by_text"))
def facility_text_search(spark, sf_dir):
    return places.text_search(_valid(spark, sf_dir), view(spark, sf_dir, "facilities")).select(
        "request_id", F.col("rank").cast("long").alias("rank"), "place_id", "rating")


PLACE_ARMS = " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in vocab.PLACE_TYPES)
RADIUS = f"""sites AS (SELECT * FROM facilities WHERE latitude IS NOT NULL AND longitude IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY place_type, latitude, longitude, place_id ORDER BY listing_rank) = 1),
near AS (SELECT r.request_id, s.*, round(2 * 6371000.0E0 * asin(sqrt(least(1.0E0, pow(sin(radians(s.latitude - r.latitude) / 2), 2)
  + cos(radians(r.latitude)) * cos(radians(s.latitude)) * pow(sin(radians(s.longitude - r.longitude) / 2), 2)))), 3) AS distance_m
  FROM {{asked}} r JOIN sites s ON s.place_type = CASE r.facility_type {PLACE_ARMS} ELSE 'hospital' END),
by_radius AS (SELECT request_id, row_number() OVER (PARTITION BY request_id ORDER BY distance_m, place_id) AS rank, place_id, name, address,
  rating, total_ratings, latitude, longitude, distance_m FROM near WHERE distance_m <= 10000 QUALIFY rank <= 5)"""


@query("facility_radius", with_views(["facilities"], f"""
WITH {NORMAL}, {RADIUS.format(asked='requests')} SELECT request_id, rank, place_id, distance_m FROM by_radius"""))
def facility_radius(spark, sf_dir):
    return places.radius_search(_valid(spark, sf_dir), view(spark, sf_dir, "facilities")).select(
        "request_id", F.col("rank").cast("long").alias("rank"), "place_id", "distance_m")


FOUND = f"""{TEXT}, rest AS (SELECT * FROM requests WHERE request_id NOT IN (SELECT request_id FROM by_text)), {RADIUS.format(asked='rest')},
found AS (SELECT *, 'text' AS source FROM by_text UNION ALL SELECT * EXCLUDE (distance_m), 'radius' FROM by_radius)"""


def _answered(spark, sf_dir):
    return places.answered(_valid(spark, sf_dir), view(spark, sf_dir, "facilities"))


@query("facility_with_fallback", with_views(["facilities"], f"WITH {FOUND} SELECT request_id, rank, place_id, source FROM found"))
def facility_with_fallback(spark, sf_dir):
    return places.search(_valid(spark, sf_dir), view(spark, sf_dir, "facilities")).select(
        "request_id", F.col("rank").cast("long").alias("rank"), "place_id", "source")


@query("facility_outcome", with_views(["facilities"], f"""
WITH {FOUND} SELECT r.request_id, n IS NOT NULL AS success, CASE WHEN n IS NULL THEN 'No place of care near '
  ELSE CAST(n AS VARCHAR) || ' places of care near ' END || city || ' ' || zipcode AS message
FROM requests r LEFT JOIN (SELECT request_id, count(*) AS n FROM found GROUP BY 1) f USING (request_id)"""))
def facility_outcome(spark, sf_dir):
    return places.search_outcome(_answered(spark, sf_dir))


RECORD = f"""coalesce(name, 'Unnamed Facility') AS name, coalesce(address, 'No address') AS address,
  coalesce(CAST(rating AS VARCHAR), 'Not rated') AS rating_text, coalesce(total_ratings, 0) AS total_ratings,
  '{vocab.MAPS_LINK}' || place_id AS maps_link"""


@query("facility_record", with_views(["facilities"], f"SELECT listing_rank, {RECORD} FROM facilities"))
def facility_record(spark, sf_dir):
    return places.facility_record(view(spark, sf_dir, "facilities")).select(
        "listing_rank", "name", "address", "rating_text", "total_ratings", "maps_link")


DETAILS = {
    "place_id": "'p' || CAST(s_suppkey AS STRING)",
    "website": "CASE WHEN s_suppkey % 3 = 0 THEN NULL ELSE 'http://example.org/' || s_name END",
    "phone": "CAST(s_suppkey * 7 AS STRING)",
    "hours": "CASE WHEN s_suppkey % 4 = 0 THEN NULL ELSE 'Mon 8-' || CAST(10 + s_suppkey % 9 AS STRING) || '|Tue closed' END",
}


@query("facility_details", with_views(["facilities"], f"""
SELECT f.listing_rank, f.place_id, coalesce(website, '') AS website, coalesce(phone, '') AS phone, coalesce(hours, '') AS hours,
  d.place_id IS NOT NULL AS found FROM facilities f LEFT JOIN
  (SELECT {", ".join(f"{e} AS {a}" for a, e in DETAILS.items())} FROM supplier) d ON d.place_id = f.place_id"""))
def facility_details(spark, sf_dir):
    details = load(spark, sf_dir, "supplier").selectExpr(
        *(f"{e} AS {a}" for a, e in DETAILS.items())).withColumn("opening_hours", F.split("hours", r"\|"))
    return places.with_details(view(spark, sf_dir, "facilities"), details).select(
        "listing_rank", "place_id", "website", "phone", F.array_join("opening_hours", "|").alias("hours"), "found")


@query("facility_extent", with_views(["facilities"], f"""
WITH {FOUND}, placed AS (SELECT * FROM found WHERE latitude IS NOT NULL AND longitude IS NOT NULL),
box AS (SELECT request_id, arg_min(latitude, rank) AS lat, arg_min(longitude, rank) AS lng, min(latitude) AS min_lat, max(latitude) AS max_lat,
  min(longitude) AS min_lng, max(longitude) AS max_lng FROM placed GROUP BY request_id)
SELECT f.request_id, coalesce(lat, 42.3601E0) AS centre_lat, coalesce(lng, -71.0589E0) AS centre_lng, min_lat, max_lat, min_lng, max_lng
FROM (SELECT DISTINCT request_id FROM found) f LEFT JOIN box USING (request_id)"""))
def facility_extent(spark, sf_dir):
    return places.extent(_answered(spark, sf_dir))


def _slot(number: int) -> str:
    arms = " ".join(f"WHEN '{k}' THEN '{t[number].replace(chr(39), chr(39) * 2)}'" for k, t in places.TEMPLATES.items() if k)
    return f"CASE facility_type {arms} ELSE '{places.TEMPLATES[''][number]}' END"


NEED = "CASE WHEN chronic_condition <> '' THEN chronic_condition ELSE 'general health' END"


@query("render_report", with_views(["facilities"], f"""
WITH {FOUND}, lines AS (SELECT request_id, string_agg(CAST(rank AS VARCHAR) || '. ' || coalesce(name, 'Unnamed Facility') || chr(10) || '   '
    || coalesce(address, 'No address') || chr(10) || '   ' || {_slot(2)} || ': ' || CASE WHEN rating IS NOT NULL
      THEN CAST(rating AS VARCHAR) || '/5 (' || CAST(coalesce(total_ratings, 0) AS VARCHAR) || ')' ELSE {_slot(3)} END
    || chr(10) || '   {vocab.MAPS_LINK}' || place_id, chr(10) ORDER BY rank) AS body
  FROM found JOIN (SELECT request_id, facility_type FROM requests) USING (request_id) GROUP BY request_id)
SELECT request_id, CASE WHEN body IS NULL THEN '# No ' || lower({_slot(0)}) || ' found for ' || {NEED} || ' in ' || city || chr(10) || chr(10) || {_slot(5)}
  ELSE '# ' || {_slot(0)} || ' for ' || {NEED} || ' in ' || city || chr(10) || chr(10) || {_slot(1)} || ':' || chr(10) || body || chr(10) || chr(10) || {_slot(4)}
  END AS report FROM requests LEFT JOIN lines USING (request_id)"""))
def render_report(spark, sf_dir):
    return places.reports(_answered(spark, sf_dir))


SHOWN = """coalesce(title, 'Untitled') AS title, coalesce(source, 'Unknown') AS source,
  strftime(published, '%Y-%m-%d %H:%M:%S') AS published_text,
  CASE WHEN length(substr(coalesce(content, ''), 1, 1000)) > 200 THEN substr(content, 1, 200) || '...' ELSE coalesce(content, '') END AS preview"""


@query("news_preview", with_views(["articles"], f"SELECT url, {SHOWN} FROM articles"))
def news_preview(spark, sf_dir):
    return news.preview(articles(spark, sf_dir)).select("url", "title", "source", "published_text", "preview")


@query("news_latest", with_views(["articles"], f"""
SELECT topic, rank, url, {SHOWN} FROM (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY published DESC, url) AS rank FROM articles
  WHERE published >= TIMESTAMP '{AS_OF} 00:00:00' - INTERVAL 7 DAYS) WHERE rank <= 5"""))
def news_latest(spark, sf_dir):
    return news.latest(articles(spark, sf_dir), AS_OF).select(
        "topic", F.col("rank").cast("long").alias("rank"), "url", "title", "source", "published_text", "preview")


@query("news_totals", with_views(["articles"], f"""
SELECT topic, count(*) AS total_results FROM (SELECT topic, published FROM articles
  WHERE published >= TIMESTAMP '{AS_OF} 00:00:00' - INTERVAL 7 DAYS
  QUALIFY row_number() OVER (PARTITION BY topic ORDER BY published DESC, url) <= 5) GROUP BY topic"""))
def news_totals(spark, sf_dir):
    return news.totals(news.latest(articles(spark, sf_dir), AS_OF))


# Drug labels per document: names by key, the text as indications.
GENERIC = "CASE doc_id % 5 WHEN 0 THEN 'Metformin Hydrochloride' WHEN 1 THEN 'metformin and glipizide' WHEN 2 THEN 'aspirin' WHEN 3 THEN NULL ELSE 'Insulin/X' END"
BRAND = "CASE doc_id % 7 WHEN 0 THEN 'A/B' WHEN 1 THEN NULL ELSE 'Brand' || CAST(doc_id AS STRING) END"


def _labels(spark, sf_dir):
    one = lambda e: F.when(F.expr(e).isNotNull(), F.array(F.expr(e)))
    return load(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("label_id"),
        F.struct(
            one(GENERIC).alias("generic_name"), one(BRAND).alias("brand_name"),
            F.array(F.lit("ORAL"), F.col("lang")).alias("route"),
            F.lit(None).cast("array<string>").alias("dosage_form"),
        ).alias("openfda"),
        F.array("text", F.lit("more")).alias("indications_and_usage"),
        F.lit(None).cast("array<string>").alias("adverse_reactions"),
        F.when(F.col("doc_id") % 2 == 0, F.array(F.lit("twice a day"))).alias("dosage_and_administration"),
    )


PLAIN = f"""NOT (contains(lower(coalesce({GENERIC}, '')), ' and ') OR contains(coalesce({GENERIC}, ''), '/')
  OR contains(lower(coalesce({BRAND}, '')), ' and ') OR contains(coalesce({BRAND}, ''), '/'))"""
CARD = f"""doc_id AS label_id, coalesce({GENERIC}, 'N/A') AS generic_name, coalesce({BRAND}, 'N/A') AS brand_name, 'ORAL, ' || lang AS route,
  'N/A' AS dosage_form, substr(text, 1, 1000) AS indications, 'Not specified.' AS side_effects,
  CASE WHEN doc_id % 2 = 0 THEN 'twice a day' ELSE 'Not available.' END AS dosage"""


@query("drug_single_ingredient", f"SELECT {CARD} FROM documents WHERE {PLAIN}")
def drug_single_ingredient(spark, sf_dir):
    return drugs.cards(drugs.single_ingredient(_labels(spark, sf_dir)))


@query("drug_card", " UNION ALL ".join(
    f"(SELECT '{n}' AS search, {CARD} FROM documents WHERE {PLAIN} AND contains(lower(coalesce({GENERIC}, '')), '{n.lower()}') ORDER BY doc_id LIMIT 1)"
    for n in ("Metformin", "aspirin", "insulin")))
def drug_card(spark, sf_dir):
    return drugs.find_cards(_labels(spark, sf_dir), ["Metformin", "aspirin", "insulin"])
