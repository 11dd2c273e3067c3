"""Cost and usage reports over the usage fact (userid, day, surface, feature, model, calls, cost_usd)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

PLAN_PRICE = 9.99
#: Sums over a whole ledger pass the 12 digits that decimal(18,6) leaves before the point.
TOTAL = "decimal(38,6)"

#: How model names begin, and the providers that bill for them; surfaces decide for models that are not known.
MODEL_PROVIDERS = {"claude": "anthropic", "gemini": "google"}
SURFACE_PROVIDERS = {"claude": "anthropic", "deadline_check": "anthropic", "gemini": "google"}


def window_of(facts: DataFrame, as_of: str, days: int) -> DataFrame:
    """Facts of the last `days` days up to as_of; the bounds reach the scan where day is stored."""
    end = F.to_date(F.lit(as_of))
    return facts.filter((F.col("day") >= F.date_sub(end, days)) & (F.col("day") <= end))


def provider_of(model: str = "model", surface: str = "surface") -> Column:
    name, out = F.lower(F.trim(F.coalesce(model, F.lit("")))), None
    for prefix, provider in MODEL_PROVIDERS.items():
        hit = name.startswith(prefix)
        out = F.when(hit, provider) if out is None else out.when(hit, provider)
    known = F.create_map(*(F.lit(x) for kv in SURFACE_PROVIDERS.items() for x in kv))
    return out.otherwise(F.coalesce(F.element_at(known, F.col(surface)), F.lit("unknown")))


SUMS = ("calls", "input_tokens", "output_tokens", "web_searches")


def _sums() -> list[Column]:
    return [*(F.sum(c).cast("long").alias(c) for c in SUMS), F.sum("cost_usd").cast("decimal(18,6)").alias("cost_usd")]


def per_user(facts: DataFrame, users: DataFrame, limit: int | None = 200, plan_price: float = PLAN_PRICE) -> DataFrame:
    """Each user's use and spend with account, cost per call and share of the plan price, ranked by spend; `left_out` is how many
    users the limit hides."""
    sums = facts.groupBy("userid").agg(*_sums(), F.min("first_at").alias("first_at"), F.max("last_at").alias("last_at"))
    cost = F.col("cost_usd").cast("double")
    known = users.withColumn("userid", F.lower("userid"))
    out = sums.join(known, F.lower(sums["userid"]) == known["userid"], "left").select(
        sums["userid"],
        F.coalesce("name", F.lit("no account")).alias("name"),
        F.coalesce("status", F.lit("none")).alias("status"),
        *SUMS,
        "cost_usd",
        F.round(F.try_divide(cost, F.col("calls")), 6).alias("cost_per_call"),
        F.round(cost * 100 / F.lit(plan_price), 2).alias("pct_of_plan"),
        F.round(F.lit(plan_price) - cost, 4).alias("margin"),
        "first_at",
        "last_at",
    )
    ordered = out.orderBy(F.desc("cost_usd"), "userid")
    hidden = facts.agg(F.greatest(F.countDistinct("userid") - (limit or 2**62), F.lit(0)).alias("left_out"))
    return (ordered.limit(limit) if limit else ordered).crossJoin(F.broadcast(hidden))


def grouped(facts: DataFrame) -> DataFrame:
    """Spend by user, provider, provider and model, feature, and day, in one pass."""
    return facts.sparkSession.sql(
        """
        SELECT CASE grouping_id(userid, provider, model, feature, day) WHEN 15 THEN 'user' WHEN 23 THEN 'provider'
                    WHEN 19 THEN 'model' WHEN 29 THEN 'feature' ELSE 'day' END AS level,
               coalesce(userid, provider || coalesce('/' || model, ''), feature, CAST(day AS STRING)) AS key,
               CAST(sum(calls) AS BIGINT) AS calls, CAST(sum(cost_usd) AS DECIMAL(18,6)) AS cost_usd,
               count(DISTINCT userid) AS users
        FROM {facts}
        GROUP BY GROUPING SETS ((userid), (provider), (provider, model), (feature), (day))
        """,
        facts=facts.withColumn("provider", provider_of()),
    )


def user_breakdown(facts: DataFrame) -> DataFrame:
    """Per user, a map from each dimension (feature, surface, provider, model) to a map from its values to spend."""
    each = facts.withColumn("provider", provider_of()).select("userid", "cost_usd", F.explode(F.create_map(*(x for c in ("feature", "surface", "provider", "model") for x in (F.lit(c), F.col(c))))).alias("dimension", "value"))
    each = each.groupBy("userid", "dimension", "value").agg(F.sum("cost_usd").cast("decimal(18,6)").alias("cost"))
    each = each.groupBy("userid", "dimension").agg(F.map_from_entries(F.collect_list(F.struct("value", "cost"))).alias("costs"))
    return each.groupBy("userid").agg(F.map_from_entries(F.collect_list(F.struct("dimension", "costs"))).alias("spend"))


def _dearest_first(key: str) -> Column:
    """Keys and costs as one text, by cost, then key."""
    listed = F.array_sort(F.collect_list(F.struct((-F.col("cost_usd")).alias("by"), F.col(key).alias("key"))))
    return F.array_join(F.transform(listed, lambda x: F.concat_ws("=", x["key"], (-x["by"]).cast("string"))), ";")


def by_provider(facts: DataFrame) -> DataFrame:
    """Use and spend of each provider, with its users, its models in order and its features by cost."""
    f = facts.withColumn("provider", provider_of())
    sums = f.groupBy("provider").agg(*_sums(), F.countDistinct("userid").alias("users"), F.array_join(F.array_sort(F.collect_set("model")), "|").alias("models"))
    features = f.groupBy("provider", "feature").agg(F.sum("cost_usd").cast("decimal(18,6)").alias("cost_usd"))
    return sums.join(features.groupBy("provider").agg(_dearest_first("feature").alias("features")), "provider")


def by_model(facts: DataFrame) -> DataFrame:
    """Use and spend of each provider's models, with their users and features by cost."""
    f = facts.withColumn("provider", provider_of())
    sums = f.groupBy("provider", "model").agg(*_sums(), F.countDistinct("userid").alias("users"))
    features = f.groupBy("provider", "model", "feature").agg(F.sum("cost_usd").cast("decimal(18,6)").alias("cost_usd"))
    return sums.join(features.groupBy("provider", "model").agg(_dearest_first("feature").alias("features")), ["provider", "model"])


def daily_series(facts: DataFrame, as_of: str, days: int, include_today: bool = False) -> DataFrame:
    """A row for each day of the window, zero where nothing was used; today only on request."""
    end = F.to_date(F.lit(as_of))
    spine = facts.sparkSession.range(1).select(F.explode(F.sequence(F.date_sub(end, days), end if include_today else F.date_sub(end, 1))).alias("day"))
    sums = facts.groupBy("day").agg(F.sum("calls").alias("calls"), F.sum("cost_usd").alias("cost"), F.countDistinct("userid").alias("users"))
    return spine.join(sums, "day", "left").select("day", F.coalesce("calls", F.lit(0)).cast("long").alias("calls"), F.coalesce("cost", F.lit(0)).cast("decimal(18,6)").alias("cost_usd"), F.coalesce("users", F.lit(0)).cast("long").alias("users"))


def totals(facts: DataFrame, ledger_cost: DataFrame, plan_price: float = PLAN_PRICE) -> DataFrame:
    """Totals over all users, reconciled with the independent ledgers (one row: runs_usd, checks_usd)."""
    users = facts.groupBy("userid").agg(F.sum("cost_usd").alias("cost"))
    whole = users.agg(F.count(F.lit(1)).alias("active_users"), F.sum("cost").cast(TOTAL).alias("attributed_usd"), F.max("cost").cast(TOTAL).alias("max_usd"), F.count_if(F.col("cost") > F.lit(plan_price)).alias("over_plan"))
    ledger_cost = ledger_cost.withColumn("ledger_usd", (F.col("runs_usd").cast(TOTAL) + F.col("checks_usd").cast(TOTAL)).cast(TOTAL))
    a, b = F.col("attributed_usd").cast("double"), F.col("ledger_usd").cast("double")
    return whole.crossJoin(F.broadcast(ledger_cost)).select(
        "active_users", "attributed_usd", "max_usd", "over_plan", "runs_usd", "checks_usd", "ledger_usd",
        F.round(F.try_divide(a, F.col("active_users")), 6).alias("avg_usd"),
        F.round(F.greatest(b - a, F.lit(0.0)), 6).alias("unattributed_usd"),
        F.round(F.coalesce(F.try_divide(a, b), F.lit(0.0)), 6).alias("attribution_rate"),
    )


def report(facts: DataFrame, users: DataFrame, ledger_cost: DataFrame, as_of: str, days: int, limit: int = 200) -> DataFrame:
    """The whole report as one answer: rows of section (total, user, provider, model, day), key, calls, cost_usd and detail. The facts are
    made once, as a table that all sections read."""
    from quillspark.sources.shared import materialised

    facts = materialised(facts, "facts")

    def section(name: str, rows: DataFrame, key: Column, calls: Column, cost: str, *detail: str) -> DataFrame:
        return rows.select(F.lit(name).alias("section"), key.cast("string").alias("key"), calls.cast("long").alias("calls"), F.col(cost).cast(TOTAL).alias("cost_usd"), F.concat_ws("|", *(F.col(c).cast("string") for c in detail)).alias("detail"))

    out = section("total", totals(facts, ledger_cost), F.lit("all"), F.lit(None), "attributed_usd", "active_users", "over_plan", "max_usd", "ledger_usd")
    out = out.unionByName(section("user", per_user(facts, users, limit), F.col("userid"), F.col("calls"), "cost_usd", "name", "status", "left_out"))
    out = out.unionByName(section("provider", by_provider(facts), F.col("provider"), F.col("calls"), "cost_usd", "users", "models", "features"))
    out = out.unionByName(section("model", by_model(facts), F.concat_ws("/", "provider", "model"), F.col("calls"), "cost_usd", "users", "features"))
    return out.unionByName(section("day", daily_series(facts, as_of, days), F.col("day"), F.col("calls"), "cost_usd", "users"))


def call_cost(usage: DataFrame, rates: DataFrame) -> DataFrame:
    """Cost of each call: tokens, cached tokens and searches at the rates of its provider (per million tokens, per search)."""
    kinds = {"input_tokens": "in_rate", "output_tokens": "out_rate", "cache_write_tokens": "cache_write_rate", "cache_read_tokens": "cache_read_rate"}
    tokens = F.lit(0).cast("decimal(28,4)")
    for count, rate in kinds.items():
        if count in usage.columns and rate in rates.columns:
            tokens = tokens + F.coalesce(count, F.lit(0)) * F.coalesce(F.col(rate), F.lit(0))
    cost = tokens / 1_000_000 + F.col("web_searches") * F.col("search_rate")
    return usage.join(rates, "provider", "left").withColumn("cost_usd", F.coalesce(cost, F.lit(0)).cast("decimal(18,6)"))


def top_features(facts: DataFrame, k: int = 2) -> DataFrame:
    """Each user's k dearest features."""
    each = facts.groupBy("userid", "feature").agg(F.sum("cost_usd").cast("decimal(18,6)").alias("cost_usd"))
    w = W.partitionBy("userid").orderBy(F.desc("cost_usd"), "feature")
    return each.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= k)


def surface_days(facts: DataFrame) -> DataFrame:
    """The rollup of each surface's day over all users."""
    return facts.groupBy("surface", "day").agg(*_sums(), F.min("first_at").alias("first_at"), F.max("last_at").alias("last_at"))
