"""Member records: body metrics, energy goals, sign-up checks, condition vocabulary."""

from __future__ import annotations

import functools
from collections.abc import Iterator
from typing import TYPE_CHECKING

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from larder import vocab
from larder.functions import numbers, text
from larder.operators import graph, scale

if TYPE_CHECKING:
    import pandas as pd

# Requests that one task may walk through one by one, and rounds over all of them before they are parted.
ONE_TASK = 200_000
ROUNDS = 3

REQUIRED = [
    "username", "password", "first_name", "last_name", "email", "age", "gender", "height",
    "weight", "chronic_condition", "activity_level", "location",
]


def with_bmi(users: DataFrame) -> DataFrame:
    """BMI to two places; the category looks at the unrounded value."""
    raw = numbers.bmi(F.col("height"), F.col("weight"))
    return users.withColumns({"bmi": numbers.round_binary(raw, 2), "bmi_category": numbers.bmi_category(raw)})


def with_tdee(users: DataFrame) -> DataFrame:
    return users.withColumn(
        "tdee",
        numbers.tdee(
            F.col("age"), F.col("gender"), F.col("height"), F.col("weight"),
            F.col("activity_level"), F.col("chronic_condition"),
        ),
    )


def with_activity_factor(users: DataFrame) -> DataFrame:
    return users.withColumn("factor", numbers.activity_factor(F.col("activity_level")))


def find_user(users: DataFrame, username: str) -> DataFrame:
    """Point lookup: the filter reaches the scan, at most one row comes back."""
    return users.filter(F.col("username") == username).limit(1)


def conform_condition(spark: SparkSession, rows: DataFrame, column: str = "chronic_condition") -> DataFrame:
    """Map display names to conditions; an unknown name passes through without limits, flagged."""
    names = vocab.condition_synonyms(spark).withColumnRenamed("name", "_name")
    keyed = rows.withColumn("_name", text.conform(F.col(column)))
    return (
        keyed.join(F.broadcast(names), "_name", "left")
        .withColumn("known_condition", F.col("condition").isNotNull())
        .withColumn("condition", F.coalesce("condition", "_name"))
        .drop("_name")
    )


def _present(name: str, dtype: str) -> Column:
    column = F.col(name)
    return text.non_blank(column) if dtype == "string" else column.isNotNull() & (column != 0)


def _first_of_both(open_: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Requests that are the first open ones both of their name and of their address; those still open after them."""
    columns = open_.columns
    names = open_.groupBy("username").agg(F.min("request_id").alias("by_name"))
    mails = open_.groupBy("email").agg(F.min("request_id").alias("by_mail"))
    taken = F.expr("request_id = by_name AND request_id = by_mail").alias("taken")
    judged = scale.settle(open_.join(names, "username").join(mails, "email").select(*columns, taken), "judged")
    first = judged.filter("taken").drop("taken")
    left = judged.filter("NOT taken").drop("taken")
    left = left.join(first.select("username"), "username", "left_anti").join(first.select("email"), "email", "left_anti")
    return first, scale.settle(left.select(*columns), "open")


def _walk(requests: DataFrame) -> DataFrame:
    """The requests accepted one by one; those of one `root` follow one another in order of ids in one task."""
    def accepted(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names, mails, root = set(), set(), None
        for part in parts:
            good = []
            for at, name, mail in zip(part["root"], part["username"], part["email"], strict=True):
                if at != root:
                    names, mails, root = set(), set(), at
                good.append(name not in names and mail not in mails)
                if good[-1]:
                    names.add(name)
                    mails.add(mail)
            yield part.loc[good, ["request_id", "username", "email"]]

    kinds = dict(requests.dtypes)
    return requests.mapInPandas(accepted, ", ".join(f"{c} {kinds[c]}" for c in ("request_id", "username", "email")))


def _accept_in_order(requests: DataFrame, one_task: int = ONE_TASK, rounds: int = ROUNDS) -> DataFrame:
    """The requests (request_id, username, email) that a walk in order of ids accepts.

    Up to `one_task` requests are walked through in one task. Of more, some rounds accept every open request that is the
    first open one both of its name and of its address, and close those that share either with an accepted one;
    popular names are settled that way. What is left is parted into components of requests linked by names and
    addresses, which cannot influence each other, and each is walked through by itself. Only components of more than
    `one_task` requests go on in rounds. Of requests for the same name and address only the first can be accepted.
    """
    columns = ["request_id", "username", "email"]
    open_ = requests.groupBy("username", "email").agg(F.min("request_id").alias("request_id")).select(*columns)
    open_ = scale.settle(open_, "open")
    accepted = []
    for _ in range(rounds):
        if open_.count() <= one_task:
            break
        first, open_ = _first_of_both(open_)
        accepted.append(first)
    if open_.count() <= one_task:
        alone = open_.withColumn("root", F.lit(0)).repartition(1).sortWithinPartitions("request_id")
        return functools.reduce(DataFrame.unionByName, [*accepted, scale.settle(_walk(alone), "accepted")])
    # Names that share a hash only make a component larger.
    name, mail = F.xxhash64(F.lit("name"), "username"), F.xxhash64(F.lit("mail"), "email")
    roots = graph.components(open_.select(name.alias("a"), mail.alias("b")))
    placed = scale.settle(open_.withColumn("node", name).join(roots, "node").drop("node"), "parted")
    large = placed.groupBy("root").count().filter(F.col("count") > one_task).select("root")
    small = placed.join(large, "root", "left_anti").repartition("root").sortWithinPartitions("root", "request_id")
    accepted.append(scale.settle(_walk(small), "accepted"))
    open_ = placed.join(large, "root", "left_semi").select(*columns)
    while not open_.isEmpty():
        first, open_ = _first_of_both(open_)
        accepted.append(first)
    return functools.reduce(DataFrame.unionByName, accepted)


def check_signup(requests: DataFrame, users: DataFrame) -> DataFrame:
    """Sign-up requests with the reason each is refused, NULL if accepted.

    `requests` carries a unique `request_id`. The result is that of taking the requests one by one in
    its order: one is refused if its name or address is registered or was given to an
    accepted request before it; a refused request blocks nobody.
    """
    types = dict(requests.dtypes)
    missing = F.array_compact(F.array(*(
        F.when(~F.coalesce(_present(c, types[c]), F.lit(False)), F.lit(c)) for c in REQUIRED
    )))
    checked = requests.withColumn("missing", missing)
    complete = checked.filter(F.size("missing") == 0)

    taken_names = users.select("username").distinct().withColumn("name_taken", F.lit(True))
    taken_mails = users.select("email").distinct().withColumn("mail_taken", F.lit(True))
    free = complete.join(taken_names, "username", "left_anti").join(taken_mails, "email", "left_anti")
    accepted = _accept_in_order(free.select("request_id", "username", "email"))
    by_name = accepted.select("username", F.col("request_id").alias("first_by_name"))
    by_mail = accepted.select("email", F.col("request_id").alias("first_by_mail"))
    joined = checked.join(by_name.join(taken_names, "username", "full"), "username", "left")
    joined = joined.join(by_mail.join(taken_mails, "email", "full"), "email", "left")
    reason = (
        F.when(F.size("missing") > 0, F.concat(F.lit("missing: "), F.array_join("missing", ", ")))
        .when(F.col("name_taken"), "username already registered")
        .when(F.col("mail_taken"), "email already registered")
        .when(F.col("first_by_name") < F.col("request_id"), "username repeated in batch")
        .when(F.col("first_by_mail") < F.col("request_id"), "email repeated in batch")
    )
    return joined.withColumn("reason", reason).drop(
        "missing", "name_taken", "mail_taken", "first_by_name", "first_by_mail"
    )


def sign_up(requests: DataFrame, users: DataFrame, at: str | None = None) -> DataFrame:
    """Accepted requests as new member rows, password hashed and metrics computed."""
    created = F.current_timestamp() if at is None else F.lit(at).cast("timestamp")
    accepted = check_signup(requests, users).filter(F.col("reason").isNull()).drop("reason", "request_id")
    hashed = accepted.withColumn("password", hash_text(F.col("password")))
    return with_tdee(with_bmi(hashed)).withColumns({
        "is_active": F.lit(True), "created_at": created, "updated_at": F.lit(None).cast("timestamp"),
    })


def hash_text(col: Column) -> Column:
    """SHA-256 in hex. Unsalted: fit for keys and pseudonyms, not for new password stores."""
    return F.sha2(col, 256)


def hash_matches(col: Column, digest: Column) -> Column:
    return F.coalesce(hash_text(col) == digest, F.lit(False))
