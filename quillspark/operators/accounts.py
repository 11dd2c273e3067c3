"""Entitlements: subscription states, the access gate, trials, promotions, freshness of derived values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions import dates, text


def has_access(status: Column, now: Column) -> Column:
    """active: yes; trial: until it ends, and one without an end has not begun to run out; beta and canceled: until the paid
    or granted period ends; anything else: no."""
    running = F.coalesce(F.col("trial_ends_at") >= now, F.lit(True))
    paid = F.coalesce(F.col("subscription_end_at") > now, F.lit(False))
    return F.when(status == "active", True).when(status == "trial", running).when(status.isin("beta", "canceled"), paid).otherwise(False)


def subscription_state(accounts: DataFrame, as_of: str) -> DataFrame:
    """status (missing or blank: trial), access, expired (a trial whose end is past) and days_left: of a trial or a beta grant, else 0."""
    now = F.lit(as_of).cast("timestamp_ntz")
    status = F.coalesce(F.nullif(F.col("status"), F.lit("")), F.lit("trial"))
    left = lambda end: F.coalesce(dates.trial_days_left(F.col(end).cast("timestamp"), now.cast("timestamp")), F.lit(0))
    days = F.when(F.col("status") == "trial", left("trial_ends_at")).when(F.col("status") == "beta", left("subscription_end_at")).otherwise(0)
    expired = F.coalesce((F.col("status") == "trial") & (F.col("trial_ends_at") < now), F.lit(False))
    return accounts.withColumn("status", status).withColumns({"access": has_access(F.col("status"), now), "expired": expired, "days_left": days.cast("int")})


def access_gate(requests: DataFrame, accounts: DataFrame, as_of: str) -> DataFrame:
    """Why a request passes or is blocked; unknown users pass."""
    state = subscription_state(accounts, as_of).withColumn("known", F.lit(True))
    rows = requests.join(state, "userid", "left")
    reason = (
        F.when(F.col("userid").isNull(), "anonymous")
        .when(F.col("known").isNull(), "unknown_user")
        .when(F.col("access"), "ok")
        .when(F.col("status") == "trial", "trial_expired")
        .when(F.col("status") == "past_due", "payment_due")
        .otherwise("inactive")
    )
    return rows.withColumn("reason", reason).withColumn("blocked", F.col("reason").isin("trial_expired", "payment_due", "inactive"))


def redeemed(accounts: DataFrame, codes: DataFrame, as_of: str) -> DataFrame:
    """accounts: userid, status, ends_at, used; codes: userid, code, days. Adds days where the code is unused and the plan not active."""
    now = F.lit(as_of).cast("timestamp")
    rows = accounts.join(codes, "userid")
    ok = (F.col("status") != "active") & ~F.array_contains("used", F.col("code"))
    return rows.select("userid", "code", ok.alias("accepted"), F.when(ok, dates.extended(F.col("ends_at").cast("timestamp"), now, F.col("days"))).otherwise(F.col("ends_at").cast("timestamp")).cast("timestamp_ntz").alias("ends_at"))


def trials_started(accounts: DataFrame, as_of: str, days: int = 14) -> DataFrame:
    """Accounts without any status get a trial from now on."""
    fresh = F.col("status").isNull()
    end = (F.lit(as_of).cast("timestamp") + F.make_interval(days=F.lit(days))).cast("timestamp_ntz")
    return accounts.select("userid", F.coalesce("status", F.lit("trial")).alias("status"), F.when(fresh, end).otherwise(F.col("ends_at")).alias("ends_at"))


def derived_fresh(current: Column, stored: Column, most: int = 10) -> Column:
    """A stored value still holds for the same text, or for one whose length differs by fewer than `most` words."""
    return (current == stored) | (F.abs(text.word_count(current) - text.word_count(stored)) < most)


def with_value(bag: Column, key: str, value: Column) -> Column:
    """A map with one key set anew."""
    return F.map_concat(F.map_filter(bag, lambda k, _: k != key), F.create_map(F.lit(key), value))
