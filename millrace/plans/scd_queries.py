"""Queries over versioned dimensions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.functions.columns import exact_sum, round_like
from millrace.operators import scd


def first_changed_key(versions: DataFrame) -> DataFrame:
    """The smallest key with more than one version."""
    return versions.groupBy("product_id").agg(F.count("*").alias("versions")).where("versions > 1").orderBy("product_id").limit(1).select("product_id")


def first_repriced_key(versions: DataFrame) -> DataFrame:
    """The smallest key with more than one price."""
    return versions.groupBy("product_id").agg(F.count_distinct("unit_price").alias("prices")).where("prices > 1").orderBy("product_id").limit(1).select("product_id")


def current_state(versions: DataFrame, up_to_key: int | None = None) -> DataFrame:
    rows = versions.where("is_current")
    rows = rows.where(F.col("product_id") <= up_to_key) if up_to_key is not None else rows
    return rows.select("product_id", "product_name", "department", "unit_price", "effective_start_date", "effective_end_date").orderBy("product_id")


def state_on(versions: DataFrame, date: str, keys: DataFrame | None = None) -> DataFrame:
    rows = scd.as_of(versions, date)
    rows = rows.join(keys, "product_id", "left_semi") if keys is not None else rows
    return rows.select("product_id", "department", "unit_price", "effective_start_date", "effective_end_date")


def history(versions: DataFrame, keys: DataFrame) -> DataFrame:
    return versions.join(keys, "product_id", "left_semi").select("product_key", "department", "unit_price", "effective_start_date", "effective_end_date", "is_current").orderBy("effective_start_date")


def price_then_and_now(facts: DataFrame, versions: DataFrame, keys: DataFrame, k: int = 10) -> DataFrame:
    """For orders of one key: the price at the time, the current one, and what a join to the current version would be off by."""
    own = versions.join(keys, "product_id", "left_semi")
    now = own.where("is_current").select(F.col("unit_price").alias("current_price"))
    met = facts.join(own.select("product_key", F.col("unit_price").alias("price_at_order_time")), "product_key").crossJoin(F.broadcast(now))  # one row
    out = met.select("order_id", "order_date", "price_at_order_time", "current_price", round_like(F.col("current_price") - F.col("price_at_order_time"), 2).alias("difference_if_naive_join"))
    return out.orderBy("order_date", "order_id", "price_at_order_time").limit(k)


def moved(type3: DataFrame, k: int = 5) -> DataFrame:
    return type3.where("previous_department is not null").select("product_id", "current_department", "previous_department").orderBy("product_id").limit(k)


def naive_and_true_revenue(orders: DataFrame, versions: DataFrame) -> DataFrame:
    """By department as then defined: revenue at the prices of the time, and at current prices."""
    now = versions.where("is_current").select(F.col("product_id").alias("__k"), F.col("unit_price").alias("__now"))
    met = scd.point_in_time(orders, versions).join(now, F.col("product_id") == F.col("__k"))
    true, naive = exact_sum(F.col("quantity") * F.col("unit_price")), exact_sum(F.col("quantity") * F.col("__now"))
    return met.groupBy("department").agg(round_like(true, 2).alias("revenue"), round_like(naive, 2).alias("naive_revenue"), round_like(naive - true, 2).alias("difference")).orderBy("department")


def counts_by_month(versions: DataFrame, dates: DataFrame) -> DataFrame:
    """``month_start, products``: how many keys are valid at the beginning of each month of ``dates(full_date)``. Changes are summed, not joined by interval."""
    opened = versions.select(F.col("effective_start_date").alias("d"), F.lit(1).alias("x"))
    closed = versions.where("not is_current").select(F.date_add("effective_end_date", 1).alias("d"), F.lit(-1).alias("x"))
    days = opened.unionByName(closed).groupBy("d").agg(F.sum("x").alias("x"))
    months = dates.select(F.trunc("full_date", "month").alias("month_start")).distinct()
    # Days of change and months are few, whatever the versions.
    return months.join(days, F.col("d") <= F.col("month_start"), "left").groupBy("month_start").agg(F.coalesce(F.sum("x"), F.lit(0)).cast("bigint").alias("products"))


def moves(versions: DataFrame) -> DataFrame:
    """``from_department, to_department, products``: flows between departments."""
    from pyspark.sql.window import Window

    before = F.lag("department").over(Window.partitionBy("product_id").orderBy("effective_start_date"))
    return versions.withColumn("from_department", before).where("from_department is not null and from_department <> department").groupBy("from_department", F.col("department").alias("to_department")).agg(F.count("*").alias("products"))
