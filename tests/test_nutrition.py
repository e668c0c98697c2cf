"""Digests of many days at once."""

from pyspark.sql import functions as F

from larder.operators import nutrition
from larder.plans.views import view

SF_DIR = "/root/testdata/sf0.001"


def test_digests_of_thirty_days_equal_single_ones(spark):
    users, logs = view(spark, SF_DIR, "users"), view(spark, SF_DIR, "logs").persist()
    many = nutrition.weekly_digests(users, nutrition.daily_partials(logs), "2024-01-01", "2024-01-30").collect()
    got = {(str(r.as_of), r.username): tuple(r)[1:] for r in many}
    assert len(many) == len(got) == 30 * users.count()
    for day in ("2024-01-01", "2024-01-04", "2024-01-15", "2024-01-30"):
        single = nutrition.weekly_digest(users, logs.filter(F.col("date") <= F.lit(day).cast("date")), day)
        assert {r.username: tuple(r) for r in single.collect()} == {u: row for (d, u), row in got.items() if d == day}
    logs.unpersist()
