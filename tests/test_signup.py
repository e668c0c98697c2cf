"""Sign-ups against a one-by-one walk."""

import random

import pytest

from larder.operators import members

REST = ["pw", "f", "l", 30, "Male", 170.0, 70.0, "CKD", "Sedentary", "x"]
SCHEMA = ("request_id long, username string, email string, password string, first_name string, last_name string, age int, "
          "gender string, height double, weight double, chronic_condition string, activity_level string, location string")


def walk(rows, names, mails):
    names, mails, reasons = set(names), set(mails), {}
    known = (set(names), set(mails))
    for i, name, mail in sorted(rows):
        if name in names:
            reasons[i] = "username already registered" if name in known[0] else (
                "email already registered" if mail in known[1] else "username repeated in batch")
        elif mail in mails:
            reasons[i] = "email already registered" if mail in known[1] else "email repeated in batch"
        else:
            reasons[i] = None
            names.add(name)
            mails.add(mail)
    return reasons


@pytest.mark.parametrize("seed", [1, 2])
def test_requests_are_judged_as_in_a_walk(spark, seed):
    rng = random.Random(seed)
    rows = [(i, f"n{rng.randrange(12)}", f"m{rng.randrange(12)}") for i in rng.sample(range(500), 120)]
    # A chain in which every request waits for the one before: accepted, refused, accepted, ...
    rows += [(1000 + i, f"c{(i + 1) // 2}", f"d{i // 2}") for i in range(15)]
    users = spark.createDataFrame([("n3", "z1"), ("y", "m4")], "username string, email string")
    requests = spark.createDataFrame([(*r, *REST) for r in rows], SCHEMA)
    got = {r.request_id: r.reason for r in members.check_signup(requests, users).collect()}
    assert got == walk(rows, ["n3", "y"], ["z1", "m4"])


def test_a_refused_request_blocks_nobody(spark):
    users = spark.createDataFrame([("taken", "t@x")], "username string, email string")
    rows = [(1, "u1", "t@x"), (2, "u1", "new@x"), (3, None, "a@x"), (4, "v", "a@x")]
    got = {r.request_id: r.reason for r in members.check_signup(spark.createDataFrame([(*r, *REST) for r in rows], SCHEMA), users).collect()}
    assert got == {1: "email already registered", 2: None, 3: "missing: username", 4: None}


@pytest.mark.parametrize(("one_task", "rounds"), [(0, 3), (0, 0), (20, 1), (10**6, 3)])
def test_every_way_of_judging_equals_the_walk(spark, one_task, rounds):
    rng = random.Random(one_task + rounds)
    rows = [(i, f"n{rng.randrange(60)}", f"m{rng.randrange(60)}") for i in rng.sample(range(900), 150)]
    rows += [(1000 + i, f"c{(i + 1) // 2}", f"d{i // 2}") for i in range(25)] + [(2000 + i, "hot", f"h{i % 40}") for i in range(80)]
    rows += [(3000, "n1", "m1"), (3001, "n1", "m1")]
    requests = spark.createDataFrame(rows, "request_id long, username string, email string")
    got = {r.request_id for r in members._accept_in_order(requests, one_task, rounds).collect()}
    assert got == {i for i, reason in walk(rows, [], []).items() if reason is None}


@pytest.mark.parametrize("one_task", [1_000, 200_000])
def test_a_long_chain_is_judged_in_a_few_jobs(spark, one_task):
    """100,000 requests, each sharing a name or an address with the one before: rounds would take 50,000."""
    n = 100_000
    chain = spark.range(n).selectExpr(
        "id AS request_id", "concat('c', cast((id + 1) div 2 AS string)) AS username", "concat('d', cast(id div 2 AS string)) AS email")
    if one_task < n:  # in parts of 800
        chain = chain.selectExpr("request_id", "concat(username, '/', cast(request_id div 800 AS string)) AS username",
                                 "concat(email, '/', cast(request_id div 800 AS string)) AS email")
    accepted = {r.request_id for r in members._accept_in_order(chain, one_task).collect()}
    rows = [(r.request_id, r.username, r.email) for r in chain.collect()]
    assert accepted == {i for i, reason in walk(rows, [], []).items() if reason is None}
