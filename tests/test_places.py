"""Facility search against brute force."""

import math
import random

import pytest
from pyspark.sql import functions as F

from larder import vocab
from larder.operators import places

FACILITY = ("listing_rank long, place_id string, name string, address string, rating double, total_ratings int, "
            "latitude double, longitude double, city string, zipcode string, place_type string")


def distance(lat1, lng1, lat2, lng2):
    dlat, dlng = math.radians(lat2 - lat1) / 2, math.radians(lng2 - lng1) / 2
    chord = math.sin(dlat) ** 2 + math.cos(math.radians(lat1)) * math.cos(math.radians(lat2)) * math.sin(dlng) ** 2
    return 2 * 6_371_000.0 * math.asin(math.sqrt(chord))


@pytest.mark.parametrize(("base", "east"), [(0.0, 0.0), (42.0, 0.0), (-33.5, 180.0), (68.0, -179.99), (89.95, 20.0), (-89.8, 180.0)])
def test_radius_equals_brute_force(spark, base, east):
    rng = random.Random(int(base) + 100)
    # Near a pole sites and spots lie all around it.
    around = 180.0 if abs(base) > 89 else 0.5

    def wrap(lat, lng):
        return max(-90.0, min(90.0, lat)), (lng + east + 180) % 360 - 180

    # A third of the sites sit in one tiny cluster, some on the very same point; the rest is spread.
    sites = []
    for i in range(600):
        if i % 3 == 0:
            lat, lng = base + rng.randrange(3) / 1e5, rng.randrange(3) / 1e5
        elif i % 3 == 1:
            lat, lng = base + rng.gauss(0, 0.01), rng.gauss(0, 0.01)
        else:
            lat, lng = base + rng.uniform(-0.3, 0.3), rng.uniform(-around, around)
        sites.append((f"p{i}", *wrap(lat, lng)))
    asked = [(j, *wrap(base + rng.uniform(-0.3, 0.3) * rng.random() ** 3, rng.uniform(-around, around) * rng.random() ** 3)) for j in range(300)]
    facilities = spark.createDataFrame(
        [(i, p, "n", "a", None, None, lat, lng, "c", "z", "pharmacy") for i, (p, lat, lng) in enumerate(sites)], FACILITY)
    requests = spark.createDataFrame(asked, "request_id long, latitude double, longitude double").withColumn(
        "facility_type", F.lit("pharmacy"))
    near = {j: sorted((round(distance(lat, lng, a, b), 3), p) for p, a, b in sites if distance(lat, lng, a, b) <= 10_000) for j, lat, lng in asked}
    for pairs in (places.PAIRS, 0):  # cells joined as they are, and parted
        got = {}
        for r in places.radius_search(requests, facilities, pairs=pairs).orderBy("request_id", "rank").collect():
            got.setdefault(r.request_id, []).append(r.place_id)
        assert got == {j: [p for _, p in found[:5]] for j, found in near.items() if found}


@pytest.mark.parametrize(("base", "east", "spread"), [(-40.0, 179.99, 0.004), (89.96, 100.0, 0.02)])
def test_a_spot_beside_a_crowded_cell_meets_few_sites(spark, base, east, spread):
    """100,000 sites in one place, spots some kilometres away from them."""
    size, n = 300, 100_000
    rows = spark.range(n).select(
        F.concat(F.lit("p"), F.col("id").cast("string")).alias("place_id"), F.lit("pharmacy").alias("place_type"),
        (F.lit(base) + F.rand(1) * spread).alias("lat"), (F.pmod(F.lit(east) + F.rand(2) * spread + 180, F.lit(360.0)) - 180).alias("lng"))
    rows = rows.union(spark.createDataFrame([("a", "pharmacy", base, east - 0.09)], rows.schema)).persist()
    rng = random.Random(6)
    asked = [(max(-90.0, min(90.0, base - rng.uniform(-0.03, 0.03))), (east - rng.uniform(0.01, 0.09) + 180) % 360 - 180) for _ in range(size)]
    spots = spark.createDataFrame([("pharmacy", *a) for a in asked], "place_type string, spot_lat double, spot_lng double")
    met = places._candidates(spots, rows.withColumns(places._placed("lat", "lng")), 5)
    assert met.count() < 150 * size  # every spot used to meet all 100,000
    facilities = rows.selectExpr("0L listing_rank", "place_id", "'n' name", "'a' address", "1D rating", "1 total_ratings", "lat latitude", "lng longitude", "place_type")
    requests = spark.createDataFrame([(i, *a, "pharmacy") for i, a in enumerate(asked[:5])], "request_id long, latitude double, longitude double, facility_type string")
    got = {}
    for r in places.radius_search(requests, facilities).orderBy("request_id", "rank").collect():
        got.setdefault(r.request_id, []).append((r.distance_m, r.place_id))
    sites = [(r.lat, r.lng, r.place_id) for r in rows.collect()]
    rows.unpersist()
    for i, (lat, lng) in enumerate(asked[:5]):
        near = sorted((round(distance(lat, lng, a, b), 3), p) for a, b, p in sites)[:5]
        assert [p for _, p in got.get(i, [])] == [p for d, p in near if d <= 10_000]


def test_early_stop_equals_a_walk(spark):
    rng = random.Random(8)
    rows = []
    for i in range(400):
        kind, rank = rng.choice(["hospital", "clinic"]), rng.randrange(1, 6)
        place = f"p{rng.randrange(40)}"
        rows.append((rng.choice(["hot", "hot", "x", "y"]), "z", kind, place, rank, i))
    hits = spark.createDataFrame(rows, "city string, zipcode string, facility_type string, place_id string, term_rank int, listing_rank int")
    got = {}
    for r in places.early_stop(hits).orderBy("rank").collect():
        got.setdefault((r.city, r.facility_type), []).append(r.place_id)
    for city in ("hot", "x", "y"):
        for kind in ("hospital", "clinic"):
            found = []
            for term in range(1, 6):
                for c, _, k, place, rank, _ in sorted(rows, key=lambda r: r[5]):
                    if (c, k, rank) == (city, kind, term) and place not in found:
                        found.append(place)
                if len(found) >= 3:
                    break
            assert got.get((city, kind), []) == found[:5]


def test_extent_defaults(spark):
    found = spark.createDataFrame(
        [(1, 1, None, None), (1, 2, 42.0, -71.0), (1, 3, 0.0, 0.0), (2, 1, None, None), (3, 1, 1.0, None)],
        "request_id long, rank int, latitude double, longitude double")
    got = {r.request_id: (r.centre_lat, r.centre_lng, r.min_lat, r.max_lat) for r in places.extent(found).collect()}
    assert got == {1: (42.0, -71.0, 0.0, 42.0), 2: (42.3601, -71.0589, None, None), 3: (42.3601, -71.0589, None, None)}


def test_reasons(spark):
    rows = spark.createDataFrame([("", "12345"), (None, "1"), ("a", None), ("a", "12"), ("a", "12345-6789")], "city string, zipcode string")
    assert [r.reason for r in places.check_requests(rows).collect()] == [
        vocab.CITY_MISSING, vocab.CITY_MISSING, vocab.ZIP_MISSING, vocab.ZIP_INVALID, None]


def test_query_text(spark):
    rows = spark.createDataFrame(
        [
            ("Boston", "02115", "hospital", "CKD", {"emergency_services": "true", "specialties": "heart, lung", "hospital_type": "Public"}),
            ("hospital near 02115", "02115", "hospital", "CKD", {"hospital_type": "Any"}),
            ("Boston", "02115", "pharmacy", "", {"hours": "Open Now", "pharmacy_type": "Chain"}),
            ("Boston", "02115", "community_center", "x", {"format": "Online"}),
            ("Boston", "02115", "dentist", "x", {"format": "Online"}),
        ], "query string, zipcode string, facility_type string, chronic_condition string, params map<string,string>")
    assert [r[0] for r in rows.select(places.query_text()).collect()] == [
        "Find hospital for CKD in Boston in zipcode 02115 with emergency services specializing in heart, lung public hospital",
        "hospital near 02115",
        "Find pharmacy for  in Boston in zipcode 02115 open now chain pharmacy",
        "Find community_center for x in Boston in zipcode 02115 online format",
        "Find dentist for x in Boston in zipcode 02115",
    ]
