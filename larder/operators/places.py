"""Care facilities: request checks, text search, early stop, radius fallback, reports.

An answer depends on the place and the facility type only, so answers are computed once per
(city, zip code, type) and cut to five rows before requests are joined to them.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window, functions as F

from larder import vocab
from larder.functions import geo, text
from larder.operators import scale

ENOUGH = 3
CAP = 5
RADIUS_M = 10_000.0
# A cell with more sites is parted, up to DEPTH times into FINER x FINER cells.
LEAF = 16
FINER = 8
DEPTH = 6
# Up to so many pairs of spots and sites in neighbouring cells are simply joined.
PAIRS = 5_000_000
# More than rounding can move a distance, in metres.
SLACK_M = 0.01
PLACE = ["city", "zipcode", "facility_type"]


def request_reason() -> Column:
    """Why a request cannot be searched; NULL if it can."""
    return (
        F.when(~F.coalesce(text.non_blank(F.col("city")), F.lit(False)), vocab.CITY_MISSING)
        .when(~F.coalesce(text.non_blank(F.col("zipcode")), F.lit(False)), vocab.ZIP_MISSING)
        .when(~text.zip_is_valid(F.col("zipcode")), vocab.ZIP_INVALID)
    )


def check_requests(requests: DataFrame) -> DataFrame:
    return requests.withColumn("reason", request_reason())


def city_zip_match(components: Column, city: Column, zipcode: Column) -> Column:
    """Whether geocoded address parts mention both the city and the zip code."""
    line = F.lower(F.array_join(F.transform(components, lambda c: c["long_name"]), " "))
    return F.contains(line, F.lower(city)) & F.contains(line, zipcode)


def normalize_requests(requests: DataFrame) -> DataFrame:
    """Resolve type aliases and drop the condition where the search ignores it."""
    kind = F.col("facility_type")
    for alias, target in vocab.TYPE_ALIASES.items():
        kind = F.when(F.col("facility_type") == alias, target).otherwise(kind)
    return requests.withColumn("facility_type", kind).withColumn(
        "chronic_condition",
        F.when(F.col("facility_type").isin(vocab.CONDITION_FREE_TYPES), "").otherwise(F.col("chronic_condition")),
    )


def _option(name: str, form: str, lower: bool = True) -> Column:
    """Text for a chosen option; 'Any' and nothing add no text."""
    value = F.try_element_at("params", F.lit(name))
    shown = F.lower(value) if lower else value
    return F.when(text.non_blank(value) & (value != "Any"), F.format_string(form, shown)).otherwise("")


def _flag(name: str, words: str) -> Column:
    return F.when(F.try_element_at("params", F.lit(name)) == "true", words).otherwise("")


def query_text() -> Column:
    """Search text of a request: type, place, zip code and the options of its type.

    `params` is a map of strings; lists are comma-joined, flags are 'true'.
    """
    kind, asked = F.col("facility_type"), F.col("query")
    base = F.when(
        text.non_blank(kind) & ~F.contains(asked, kind),
        F.concat(F.lit("Find "), kind, F.lit(" for "), F.col("chronic_condition"), F.lit(" in "), asked),
    ).otherwise(asked)
    placed = F.when(
        text.non_blank(F.col("zipcode")) & ~F.contains(base, F.col("zipcode")),
        F.concat(base, F.lit(" in zipcode "), F.col("zipcode")),
    ).otherwise(base)
    hours = F.try_element_at("params", F.lit("hours"))
    extras = {
        "hospital": [
            _flag("emergency_services", " with emergency services"),
            _option("specialties", " specializing in %s", lower=False),
            _option("hospital_type", " %s hospital"),
        ],
        "clinic": [
            _option("clinic_type", " %s"),
            _flag("telehealth", " with telehealth services"),
            _option("wait_time", " with %s wait times"),
        ],
        "pharmacy": [
            F.when(hours == "Open Now", " open now").otherwise(_option("hours", " with %s")),
            _option("services", " offering %s", lower=False),
            _option("pharmacy_type", " %s pharmacy"),
        ],
        "mental_health_group": [
            _option("format", " %s format"),
            _option("facilitation", " %s facilitation"),
            _option("meeting_frequency", " meeting %s"),
            _option("focus", " focused on %s", lower=False),
        ],
    }
    names = {**{name: name for name in extras}, **vocab.TYPE_ALIASES}
    extra = F.lit("")
    for name, target in names.items():
        extra = F.when(kind == name, F.concat(*extras[target])).otherwise(extra)
    return F.concat(placed, extra)


def search_terms(requests: DataFrame) -> DataFrame:
    """One row per request and search term, with the text sent for it."""
    rows = F.lit(None).cast("array<struct<term_rank:int,term:string>>")
    default = F.array(F.struct(F.lit(1).alias("term_rank"), F.lit(vocab.FACILITY_TERM_DEFAULT).alias("term")))
    for kind in dict.fromkeys(k for k, _, _ in vocab.FACILITY_TERMS):
        terms = F.array(*(
            F.struct(F.lit(rank).alias("term_rank"), F.lit(term).alias("term"))
            for k, rank, term in vocab.FACILITY_TERMS if k == kind
        ))
        rows = F.when(F.col("facility_type") == kind, terms).otherwise(rows)
    base = F.concat("term", F.lit(" in "), "city", F.lit(" "), "zipcode")
    return requests.select("*", F.inline(F.coalesce(rows, default))).withColumn(
        "search_text",
        F.when(text.non_blank(F.col("chronic_condition")), F.concat("chronic_condition", F.lit(" "), base)).otherwise(base),
    )


def text_hits(facilities: DataFrame) -> DataFrame:
    """Facility listings with every (type, term) their name or address mentions."""
    words = F.concat_ws(" ", "name", "address")
    kinds = [*vocab.FACILITY_TERMS, ("", 1, vocab.FACILITY_TERM_DEFAULT)]
    found = F.array_compact(F.array(*(
        F.when(text.contains_ci(words, term), F.struct(F.lit(kind).alias("facility_type"), F.lit(rank).alias("term_rank")))
        for kind, rank, term in kinds
    )))
    return facilities.select("*", F.inline(found))


def dedup_hits(hits: DataFrame) -> DataFrame:
    """First hit per place: the earliest term, then the listing order."""
    return scale.first_per_key(hits, [*PLACE, "place_id"], [F.col("term_rank"), F.col("listing_rank")])


def early_stop(hits: DataFrame, enough: int = ENOUGH, cap: int = CAP) -> DataFrame:
    """First `cap` unique places per search, using a term only if earlier ones gave under `enough`.

    All places of earlier terms rank before a place, so its first `cap` rows suffice to
    count them.
    """
    order = [F.col("term_rank"), F.col("listing_rank"), F.col("place_id")]
    top = scale.ranked(dedup_hits(hits), PLACE, order, cap)
    terms = Window.partitionBy(*PLACE).orderBy("term_rank").rangeBetween(Window.unboundedPreceding, -1)
    return top.withColumn("_earlier", F.count(F.lit(1)).over(terms)).filter(F.col("_earlier") < enough).drop("_earlier")


def _nest(rows: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """Rank-ordered array of at most `cap` records per key."""
    return rows.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("rank", *fields))).alias("found"))


RECORD = ["place_id", "name", "address", "rating", "total_ratings", "latitude", "longitude"]


def search_key(kind: Column) -> Column:
    """Types without own terms share the default search."""
    known = list(dict.fromkeys(k for k, _, _ in vocab.FACILITY_TERMS))
    for alias, target in vocab.TYPE_ALIASES.items():
        kind = F.when(kind == alias, target).otherwise(kind)
    return F.when(kind.isin(known), kind).otherwise("")


def text_answers(requests: DataFrame, facilities: DataFrame) -> DataFrame:
    """Requests with the array of their ranked facilities, NULL if the text search has none.

    The answers, one row per place and type, are settled: they are needed more than once and
    usually few enough for the requests to stay where they are.
    """
    answers = scale.settle(_nest(early_stop(text_hits(facilities)), PLACE, RECORD), "answers")
    keyed = requests.withColumn("_type", F.col("facility_type")).withColumn(
        "facility_type", search_key(F.col("facility_type")))
    joined = keyed.join(answers, PLACE, "left")
    return joined.withColumn("facility_type", F.col("_type")).drop("_type")


def text_search(requests: DataFrame, facilities: DataFrame) -> DataFrame:
    """Requests with their ranked facilities from the text search; no match gives no row."""
    return text_answers(requests, facilities).select("request_id", F.inline("found"))


def place_type(kind: Column) -> Column:
    pairs = [F.lit(x) for pair in vocab.PLACE_TYPES for x in pair]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), kind), F.lit(vocab.PLACE_TYPE_DEFAULT))


def _placed(lat: str, lng: str) -> dict[str, Column]:
    """Cell of ten kilometres that holds a point, and where in it the point lies, from 0 up to 1 each way."""
    north = F.col(lat) * F.lit(geo.METRES_PER_DEGREE) / F.lit(RADIUS_M)
    row = geo.lat_row(F.col(lat), RADIUS_M)
    east = (F.col(lng) + 180.0) / 360.0 * geo.lng_columns(row, RADIUS_M)
    return {"row": row, "col": geo.lng_column(F.col(lng), row, RADIUS_M), "y": north - F.floor(north), "x": east - F.floor(east)}


def _around(lat: str, lng: str) -> Column:
    """The cell of a point and all its neighbours: what lies within ten kilometres lies in one of them."""
    row = geo.lat_row(F.col(lat), RADIUS_M)
    steps = [-1, 0, 1]
    # Where a row has few columns, steps both ways meet.
    return F.array_distinct(F.array(*(
        F.struct((row + dy).alias("row"), geo.lng_column(F.col(lng), row + dy, RADIUS_M, dx).alias("col"))
        for dy in steps for dx in steps)))


def _nearest_cells(seen: DataFrame, spot: list[str], k: int) -> DataFrame:
    """The cells that may hold one of a spot's `k` nearest sites.

    All sites of a cell lie within `reach` of the middle of the box around them, whose distance is `away`. With the cells in order
    of away + reach, `k` sites lie no farther than the value at which the counts add up to `k`; a cell
    is needless if away - reach is more than that, or than the radius.
    """
    order = Window.partitionBy(*spot).orderBy("far", "row", "col", "iy", "ix").rowsBetween(Window.unboundedPreceding, 0)
    enough = F.min(F.when(F.col("upto") >= k, F.col("far"))).over(Window.partitionBy(*spot))
    bounded = seen.withColumn("far", F.col("away") + F.col("reach")).withColumn("upto", F.sum("n").over(order))
    bounded = bounded.withColumn("limit", F.least(F.coalesce(enough, F.lit(RADIUS_M)), F.lit(RADIUS_M)))
    return bounded.filter(F.col("away") - F.col("reach") <= F.col("limit") + SLACK_M).drop("far", "upto", "limit")


def _cells_of(points: DataFrame, depth: int) -> DataFrame:
    """Count and box of the cells of one depth that hold a point."""
    parts = F.lit(float(FINER**depth))
    lat, lng = F.col("lat"), F.pmod(F.col("lng") + 180.0, F.lit(360.0)) - 180.0
    cells = (
        points.withColumns({"iy": F.floor(F.col("y") * parts), "ix": F.floor(F.col("x") * parts)})
        .groupBy("place_type", "row", "col", "iy", "ix")
        .agg(F.count(F.lit(1)).alias("n"), *(f(c).alias(f"{name}_{of}") for c, of in ((lat, "lat"), (lng, "lng"))
                                             for f, name in ((F.min, "min"), (F.max, "max"))))
    )
    middle = (F.col("min_lat") + F.col("max_lat")) / 2
    # Along the parallel of the middle and then along a meridian: no point of the box is farther than that.
    reach = F.radians((F.col("max_lat") - F.col("min_lat")) / 2 + F.cos(F.radians(middle)) * (F.col("max_lng") - F.col("min_lng")) / 2)
    return cells.select(
        "place_type", "row", "col", "iy", "ix", "n", middle.alias("mid_lat"),
        ((F.col("min_lng") + F.col("max_lng")) / 2).alias("mid_lng"), (reach * geo.EARTH_RADIUS_M).alias("reach"))


def _candidates(spots: DataFrame, points: DataFrame, k: int, pairs: int = PAIRS) -> DataFrame:
    """Spots (place_type, spot_lat, spot_lng) with the points that may be among their `k` nearest within the radius.

    Cells of ten kilometres are met first. If that makes more than `pairs` rows, cells with more than `LEAF` points are parted, and
    again, and in each round a spot keeps only the cells that can still matter, so it meets few points however
    crowded the cells around it are. Points nearer to each other than some centimetres are not parted.
    """
    spot, cell = ["place_type", "spot_lat", "spot_lng"], ["place_type", "row", "col"]
    part = [*cell, "iy", "ix"]
    spots = scale.settle(spots.select(*spot), "spots")
    near = spots.select("place_type", F.inline(_around("spot_lat", "spot_lng"))).groupBy(*cell).agg(F.count(F.lit(1)).alias("spots"))
    filled = points.groupBy(*cell).agg(F.count(F.lit(1)).alias("points"))
    if (near.join(filled, cell).agg(F.sum(F.col("spots") * F.col("points"))).first()[0] or 0) <= pairs:
        return spots.select(*spot, F.inline(_around("spot_lat", "spot_lng"))).join(points, cell).select(*spot, "lat", "lng", "place_id")
    points = scale.settle(points, "points")
    frontier = spots.select(*spot, F.inline(_around("spot_lat", "spot_lng"))).withColumns({"up_y": F.lit(0).cast("long"), "up_x": F.lit(0).cast("long")})
    carried, found = None, None
    for depth in range(DEPTH + 1):
        cells = scale.settle(_cells_of(points, depth), "cells")
        crowded = cells.filter(F.lit(depth < DEPTH) & (F.col("n") > LEAF))
        done = crowded.isEmpty()
        up = F.lit(1 if depth == 0 else FINER)
        above = {"up_y": F.floor(F.col("iy") / up), "up_x": F.floor(F.col("ix") / up)}
        away = geo.haversine_m(F.col("spot_lat"), F.col("spot_lng"), F.col("mid_lat"), F.col("mid_lng"))
        seen = frontier.join(cells.withColumns(above), [*cell, "up_y", "up_x"]).select(
            *spot, "row", "col", "iy", "ix", "n", F.lit(depth).alias("depth"), away.alias("away"), "reach")
        kept = scale.settle(_nearest_cells(seen if carried is None else carried.unionByName(seen), spot, k), "near-cells")
        opened = (F.col("depth") == depth) & (F.col("depth") < DEPTH) & (F.col("n") > LEAF)
        parts = F.lit(float(FINER**depth))
        points = points.withColumns({"iy": F.floor(F.col("y") * parts), "ix": F.floor(F.col("x") * parts)})
        closed = points.join(crowded.select(*part), part, "left_anti").withColumn("depth", F.lit(depth))
        found = closed if found is None else found.unionByName(closed)
        if done:
            break
        points = scale.settle(points.join(crowded.select(*part), part, "left_semi").drop("iy", "ix"), "crowded-points")
        carried = kept.filter(~opened)
        frontier = kept.filter(opened).select(*spot, "row", "col", F.col("iy").alias("up_y"), F.col("ix").alias("up_x"))
    return kept.join(found, [*part, "depth"]).select(*spot, "lat", "lng", "place_id")


def radius_lists(requests: DataFrame, facilities: DataFrame, k: int = CAP, pairs: int = PAIRS) -> DataFrame:
    """Requests with the array of the `k` nearest facilities of their type within ten kilometres, NULL if there is none.

    Equal spots are searched once, by ids and coordinates only; the facilities' records are attached to the few that are chosen.
    """
    spot, point = ["place_type", "spot_lat", "spot_lng"], ["place_type", "lat", "lng", "place_id"]
    asked = requests.withColumns({
        "place_type": place_type(F.col("facility_type")), "spot_lat": F.col("latitude"), "spot_lng": F.col("longitude")})
    spots = asked.select(*spot).filter(F.col("spot_lat").isNotNull() & F.col("spot_lng").isNotNull()).distinct()
    sites = facilities.filter(F.col("latitude").isNotNull() & F.col("longitude").isNotNull())
    sites = sites.withColumns({"lat": F.col("latitude"), "lng": F.col("longitude")})
    sites = scale.first_per_key(sites, point, [F.col("listing_rank")])
    # Sites of one exact point differ by id only, so `k` of them are enough.
    points = scale.first_per_key(sites.select(*point), ["place_type", "lat", "lng"], [F.col("place_id")], k)
    near = _candidates(spots, points.withColumns(_placed("lat", "lng")), k, pairs).withColumn(
        # Millimetres: rounding noise must not decide between equally far sites.
        "distance_m", F.round(geo.haversine_m(F.col("spot_lat"), F.col("spot_lng"), F.col("lat"), F.col("lng")), 3),
    ).filter(F.col("distance_m") <= RADIUS_M)
    best = scale.ranked(near, spot, [F.col("distance_m"), F.col("place_id")], k)
    records = best.join(sites.select(*point, *[c for c in RECORD if c != "place_id"]), point)
    lists = _nest(records, spot, [*RECORD, "distance_m"])
    return asked.join(lists, spot, "left").drop(*spot)


def radius_search(requests: DataFrame, facilities: DataFrame, k: int = CAP, pairs: int = PAIRS) -> DataFrame:
    """The `k` nearest facilities of a request's type within ten kilometres, a row each."""
    return radius_lists(requests, facilities, k, pairs).select("request_id", F.inline("found"))


def answered(requests: DataFrame, facilities: DataFrame) -> DataFrame:
    """Requests with `found`, the array of their facilities (NULL if there is none), and `source`, text or radius.

    Only requests without any text match go on to the radius search.
    """
    by_text = text_answers(requests, facilities)
    fields = ["rank", *RECORD]
    plain = F.transform("found", lambda f: F.struct(*(f[c].alias(c) for c in fields)))
    by_radius = radius_lists(by_text.filter(F.col("found").isNull()).drop("found"), facilities).withColumn("found", plain)
    return (
        by_text.filter(F.col("found").isNotNull()).withColumn("source", F.lit("text"))
        .unionByName(by_radius.withColumn("source", F.when(F.col("found").isNotNull(), "radius")))
    )


def search(requests: DataFrame, facilities: DataFrame) -> DataFrame:
    """Text search, else the radius search for requests without any text match; a row per facility found."""
    return answered(requests.select("request_id", *PLACE, "latitude", "longitude"), facilities).select(
        "request_id", F.inline("found"), "source")


def search_outcome(answers: DataFrame) -> DataFrame:
    """Success flag and message per answered request."""
    where, some = F.concat("city", F.lit(" "), "zipcode"), F.col("found").isNotNull()
    return answers.select(
        "request_id", some.alias("success"),
        F.when(some, F.format_string(vocab.FACILITIES_FOUND, F.size("found").cast("long"), where))
        .otherwise(F.format_string(vocab.FACILITIES_NONE, where)).alias("message"),
    )


def display(record: Column) -> dict[str, Column]:
    """Display fields of a facility's record with their defaults, and a map link."""
    return {
        "name": F.coalesce(record["name"], F.lit("Unnamed Facility")),
        "address": F.coalesce(record["address"], F.lit("No address")),
        "rating_text": F.coalesce(record["rating"].cast("string"), F.lit("Not rated")),
        "total_ratings": F.coalesce(record["total_ratings"], F.lit(0)),
        "maps_link": F.concat(F.lit(vocab.MAPS_LINK), F.coalesce(record["place_id"], F.lit(""))),
    }


def facility_record(rows: DataFrame) -> DataFrame:
    """Rows with the display fields of their records."""
    return rows.withColumns(display(F.struct(*RECORD)))


def with_details(facilities: DataFrame, details: DataFrame) -> DataFrame:
    """Attach website, phone and opening hours by place id."""
    extra = details.select("place_id", "website", "phone", "opening_hours", F.lit(True).alias("found"))
    joined = facilities.join(extra, "place_id", "left")
    return joined.withColumns({
        "website": F.coalesce("website", F.lit("")),
        "phone": F.coalesce("phone", F.lit("")),
        "opening_hours": F.coalesce("opening_hours", F.array().cast("array<string>")),
        "found": F.coalesce("found", F.lit(False)),
    })


def extent(answers: DataFrame) -> DataFrame:
    """Map centre (first place with coordinates) and bounding box per request; `answers` has `found` or a row per facility."""
    if "found" not in answers.columns:
        answers = _nest(answers, ["request_id"], ["latitude", "longitude"])
    placed = F.filter("found", lambda f: f["latitude"].isNotNull() & f["longitude"].isNotNull())
    rows = answers.filter(F.col("found").isNotNull()).select("request_id", placed.alias("placed"))
    lat, lng = F.transform("placed", lambda f: f["latitude"]), F.transform("placed", lambda f: f["longitude"])
    return rows.select(
        "request_id",
        F.coalesce(F.get(lat, F.lit(0)), F.lit(vocab.MAP_CENTRE[0])).alias("centre_lat"),
        F.coalesce(F.get(lng, F.lit(0)), F.lit(vocab.MAP_CENTRE[1])).alias("centre_lng"),
        F.array_min(lat).alias("min_lat"), F.array_max(lat).alias("max_lat"),
        F.array_min(lng).alias("min_lng"), F.array_max(lng).alias("max_lng"),
    )


# Report wording per facility type: title, list heading, rating label, no-rating text, closing, empty-result advice.
TEMPLATES = {
    "hospital": (
        "Hospitals", "Hospitals to consider", "Patient rating", "not enough data",
        "Ask your doctor for a referral before you go.", "Try a larger city nearby or search for medical centers.",
    ),
    "clinic": (
        "Clinics", "Clinics near you", "Patients say", "no ratings yet",
        "Call ahead for a first appointment.", "Try doctor's offices or a telehealth visit.",
    ),
    "pharmacy": (
        "Pharmacies", "Pharmacies near you", "Customer rating", "no ratings available",
        "Bring your list of medicines.", "Try drugstores inside shops or a mail-order pharmacy.",
    ),
    "mental_health_group": (
        "Support groups", "Groups near you", "Members say", "no ratings yet, be the first",
        "You may simply listen at your first visit.", "Ask hospitals, libraries or online communities.",
    ),
    "": (
        "Facilities", "Facilities near you", "Rating", "not rated",
        "Check the web pages for details.", "Widen the area or use more general words.",
    ),
}


def reports(answers: DataFrame) -> DataFrame:
    """One text per answered request: title, numbered facilities, closing line; or the no-result text."""
    need = F.when(text.non_blank(F.col("chronic_condition")), F.col("chronic_condition")).otherwise("general health")
    key = search_key(F.col("facility_type"))

    def pick(slot: int) -> Column:
        return functools.reduce(
            lambda acc, kv: F.when(key == kv[0], kv[1][slot]).otherwise(acc), TEMPLATES.items(), F.lit(TEMPLATES[""][slot])
        )

    def entry(i: Column) -> Column:
        rating = F.when(
            i["rating"].isNotNull(),
            F.concat(i["rating"].cast("string"), F.lit("/5 ("), display(i)["total_ratings"].cast("string"), F.lit(")")),
        ).otherwise(pick(3))
        shown = display(i)
        return F.concat(
            i["rank"].cast("string"), F.lit(". "), shown["name"], F.lit("\n   "), shown["address"], F.lit("\n   "),
            pick(2), F.lit(": "), rating, F.lit("\n   "), shown["maps_link"],
        )

    body = F.concat(
        F.lit("# "), pick(0), F.lit(" for "), need, F.lit(" in "), F.col("city"), F.lit("\n\n"), pick(1), F.lit(":\n"),
        F.array_join(F.transform("found", entry), "\n"), F.lit("\n\n"), pick(4),
    )
    empty = F.concat(F.lit("# No "), F.lower(pick(0)), F.lit(" found for "), need, F.lit(" in "), F.col("city"),
                     F.lit("\n\n"), pick(5))
    return answers.select("request_id", F.when(F.col("found").isNotNull(), body).otherwise(empty).alias("report"))
