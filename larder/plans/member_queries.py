"""Member metrics, sign-up and vocabulary."""

from __future__ import annotations

from pyspark.sql import functions as F

from larder import vocab
from larder.operators import members
from larder.plans.registry import query
from larder.plans.views import load, view, with_views

BMI = "(weight / ((height / 100.0E0) * (height / 100.0E0)))"


@query("user_bmi", with_views(["users"], f"""
SELECT username, CAST(printf('%.2f', {BMI}) AS DOUBLE) AS bmi,
  CASE WHEN {BMI} < 18.5E0 THEN 'Underweight' WHEN {BMI} < 25 THEN 'Normal weight'
       WHEN {BMI} < 30 THEN 'Overweight' ELSE 'Obese' END AS bmi_category
FROM users"""))
def user_bmi(spark, sf_dir):
    return members.with_bmi(view(spark, sf_dir, "users")).select("username", "bmi", "bmi_category")


FACTOR = "CASE activity_level " + " ".join(
    f"WHEN '{a}' THEN {f}E0" for a, f in vocab.ACTIVITY_FACTORS) + " ELSE 1.2E0 END"
BASE = "10.0E0 * weight + 6.25E0 * height - 5.0E0 * age + CASE WHEN lower(gender) = 'male' THEN 5.0E0 ELSE -161.0E0 END"


@query("user_tdee", with_views(["users"], f"""
SELECT username, CAST(printf('%.2f', CASE lower(chronic_condition)
  WHEN 'ckd' THEN 30.0E0 * weight WHEN 'obesity' THEN need * 0.85E0 WHEN 'type2' THEN need * 0.90E0
  WHEN 'polycystic' THEN need * 0.85E0 ELSE need END) AS DOUBLE) AS tdee
FROM (SELECT username, weight, CASE WHEN length(username) % 2 = 0 THEN chronic_condition ELSE 'CKD' END AS chronic_condition,
  ({BASE}) * {FACTOR} AS need FROM users)"""))
def user_tdee(spark, sf_dir):
    users = view(spark, sf_dir, "users").withColumn(
        "chronic_condition",
        F.when(F.length("username") % 2 == 0, F.col("chronic_condition")).otherwise("CKD"),
    )
    return members.with_tdee(users.drop("tdee")).select("username", "tdee")


@query("dim_lookup_default", with_views(["users"], f"SELECT username, activity_level, {FACTOR} AS factor FROM users"))
def dim_lookup_default(spark, sf_dir):
    return members.with_activity_factor(view(spark, sf_dir, "users")).select("username", "activity_level", "factor")


@query("user_lookup", with_views(["users"], "SELECT username, chronic_condition, tdee FROM users WHERE username = 'u77'"))
def user_lookup(spark, sf_dir):
    return members.find_user(view(spark, sf_dir, "users"), "u77").select("username", "chronic_condition", "tdee")


SYNONYMS = ", ".join(f"('{a}', '{b}')" for a, b in vocab.CONDITION_SYNONYMS)


@query("condition_conform", with_views(["users"], f"""
SELECT username, coalesce(s.condition, lower(trim(chronic_condition))) AS condition, s.condition IS NOT NULL AS known_condition
FROM users LEFT JOIN (VALUES {SYNONYMS}) s(name, condition) ON s.name = lower(trim(chronic_condition))"""))
def condition_conform(spark, sf_dir):
    return members.conform_condition(spark, view(spark, sf_dir, "users")).select(
        "username", "condition", "known_condition")


@query("hash_column", with_views(["users"], """
SELECT username, sha256(password) AS digest, sha256(password) = sha256('pw7') AS matches FROM users"""))
def hash_column(spark, sf_dir):
    digest = members.hash_text(F.col("password"))
    return view(spark, sf_dir, "users").select(
        "username", digest.alias("digest"),
        members.hash_matches(F.col("password"), F.sha2(F.lit("pw7"), 256)).alias("matches"),
    )


# Sign-up requests: one per order; names and addresses repeat, some are taken, some incomplete.
SIGNUP = {
    "request_id": "o_orderkey",
    "username": "CASE WHEN o_orderkey % 50 = 0 THEN '' ELSE 'u' || CAST(o_custkey AS STRING) END",
    "password": "'pw' || CAST(o_orderkey AS STRING)",
    "first_name": "CASE WHEN o_orderkey % 70 = 0 THEN NULL ELSE 'n' || CAST(o_custkey AS STRING) END",
    "last_name": "o_orderpriority",
    "email": "'u' || CAST((o_orderkey * 7) % 1000 AS STRING) || '@example.org'",
    "age": "CAST(o_custkey % 61 AS INT)",
    "gender": "CASE WHEN o_custkey % 2 = 0 THEN 'Male' ELSE 'Female' END",
    "height": "CAST(150 + o_custkey % 50 AS DOUBLE)",
    "weight": "CAST(50 + o_custkey % 70 AS DOUBLE)",
    "activity_level": "'Sedentary'",
    "chronic_condition": "'CKD'",
    "location": "o_orderstatus",
}
SIGNUP_SQL = "SELECT " + ", ".join(f"{e} AS {a}" for a, e in SIGNUP.items()) + " FROM orders"
MISSING = " || ".join(
    f"CASE WHEN {c} IS NULL OR {c} = " + ("0" if c in ("age", "height", "weight") else "''") + f" THEN ', {c}' ELSE '' END"
    for c in members.REQUIRED)


def _signup(spark, sf_dir):
    requests = load(spark, sf_dir, "orders").selectExpr(*(f"{e} AS {a}" for a, e in SIGNUP.items()))
    return requests, view(spark, sf_dir, "users").selectExpr(*(f"{e} AS {a}" for a, e in KNOWN.items()))


# Every member is registered; of two thirds under a name and address no request asks for.
KNOWN = {
    "username": "CASE WHEN CAST(substr(username, 2) AS BIGINT) % 3 = 0 THEN username ELSE 'r' || username END",
    "email": "CASE WHEN CAST(substr(username, 2) AS BIGINT) % 3 = 0 THEN email ELSE 'r' || email END",
}
KNOWN_SQL = "SELECT " + ", ".join(f"{e} AS {a}" for a, e in KNOWN.items()) + " FROM users"

SIGNUP_CHECK = f"""WITH req AS ({SIGNUP_SQL}), known AS ({KNOWN_SQL}),
checked AS (SELECT *, substr({MISSING}, 3) AS missing FROM req),
free AS (SELECT request_id, username, email FROM checked WHERE missing = ''
  AND username NOT IN (SELECT username FROM known) AND email NOT IN (SELECT email FROM known)),
walk AS (SELECT list_reduce(list({{'ids': [request_id], 'names': [username], 'mails': [email]}} ORDER BY request_id), lambda a, x:
  CASE WHEN list_contains(a.names, x.names[1]) OR list_contains(a.mails, x.mails[1]) THEN a
  ELSE {{'ids': a.ids || x.ids, 'names': a.names || x.names, 'mails': a.mails || x.mails}} END) AS w FROM free),
ranked AS (SELECT c.*, n.id AS by_name, m.id AS by_mail FROM checked c
  LEFT JOIN (SELECT unnest(w.names) AS username, unnest(w.ids) AS id FROM walk) n ON n.username = c.username
  LEFT JOIN (SELECT unnest(w.mails) AS email, unnest(w.ids) AS id FROM walk) m ON m.email = c.email),
judged AS (SELECT *, CASE WHEN missing <> '' THEN 'missing: ' || missing
  WHEN username IN (SELECT username FROM known) THEN 'username already registered'
  WHEN email IN (SELECT email FROM known) THEN 'email already registered'
  WHEN by_name < request_id THEN 'username repeated in batch'
  WHEN by_mail < request_id THEN 'email repeated in batch' END AS reason FROM ranked)
"""


@query("signup_validate", with_views(["users"], SIGNUP_CHECK + "SELECT request_id, username, reason FROM judged"))
def signup_validate(spark, sf_dir):
    requests, users = _signup(spark, sf_dir)
    return members.check_signup(requests, users).select("request_id", "username", "reason")


@query("signup_accept", with_views(["users"], SIGNUP_CHECK + f"""
SELECT username, email, sha256(password) AS password, CAST(printf('%.2f', {BMI}) AS DOUBLE) AS bmi,
  CAST(printf('%.2f', 30.0E0 * weight) AS DOUBLE) AS tdee FROM judged WHERE reason IS NULL"""))
def signup_accept(spark, sf_dir):
    requests, users = _signup(spark, sf_dir)
    return members.sign_up(requests, users).select("username", "email", "password", "bmi", "tdee")
