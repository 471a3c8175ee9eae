"""The analytical queries over a star."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from millrace.functions.columns import exact_sum, ratio, round_like
from millrace.operators.star import Star

TOP = 10


def _top(df: DataFrame, by: str, tie: str, k: int | None = TOP) -> DataFrame:
    """Largest first, ties by name; without k, all."""
    out = df.orderBy(F.col(by).desc_nulls_last(), F.col(tie).asc_nulls_last())
    return out.limit(k) if k else out


def revenue_by_state(s: Star) -> DataFrame:
    got = s.fact.join(s.dim_customer, "customer_key").groupBy("customer_state").agg(round_like(exact_sum(F.col("price")), 2).alias("revenue"), F.count_distinct("order_id").alias("orders"))
    return _top(got, "revenue", "customer_state")


def freight_ratio_by_category(s: Star, least_items: int = 20) -> DataFrame:
    got = s.fact.join(s.dim_product, "product_key").groupBy("product_category").agg(round_like(ratio(exact_sum(F.col("freight_value")), exact_sum(F.col("price"))), 3).alias("freight_ratio"), F.count("*").alias("items"))
    return _top(got.where(F.col("items") >= least_items), "freight_ratio", "product_category")


def _by_date(s: Star) -> DataFrame:
    return s.fact.join(s.dim_date, F.col("order_date_key") == F.col("date_key"))


def monthly_revenue(s: Star) -> DataFrame:
    return _by_date(s).groupBy("year", "month").agg(round_like(exact_sum(F.col("price")), 2).alias("revenue")).orderBy("year", "month")


def weekend_vs_weekday(s: Star) -> DataFrame:
    return _by_date(s).groupBy("is_weekend").agg(F.count_distinct("order_id").alias("orders"), round_like(exact_sum(F.col("total_item_value")) / F.count("total_item_value"), 2).alias("avg_item_value"))


def top_categories(s: Star) -> DataFrame:
    got = s.fact.join(s.dim_product, "product_key").groupBy("product_category").agg(round_like(exact_sum(F.col("price")), 2).alias("revenue"))
    return _top(got, "revenue", "product_category")


def delivery_days_by_state(s: Star) -> DataFrame:
    got = s.fact.join(s.dim_customer, "customer_key").groupBy("customer_state").agg(round_like(F.avg("delivery_days"), 1).alias("avg_delivery_days"), F.count("delivery_days").alias("delivered_items"))
    return _top(got, "avg_delivery_days", "customer_state", None)


def seller_state_revenue(s: Star) -> DataFrame:
    known = s.dim_seller.where("seller_key <> -1")
    got = s.fact.join(known, "seller_key").groupBy("seller_state").agg(round_like(exact_sum(F.col("price")), 2).alias("revenue"), F.count_distinct("seller_natural_key").alias("active_sellers"))
    return _top(got, "revenue", "seller_state", None)


def order_size_distribution(s: Star) -> DataFrame:
    orders = s.fact.groupBy("order_id").agg(F.count("*").alias("items_in_order"), exact_sum(F.col("price")).alias("order_revenue"))
    return orders.groupBy("items_in_order").agg(F.count("*").alias("orders"), round_like(exact_sum(F.col("order_revenue")), 2).alias("revenue")).orderBy("items_in_order")


def growth(rows: DataFrame, order: list[str], back: int, name: str) -> DataFrame:
    """Growth of revenue over so many periods before, in per cent."""
    before = F.lag("revenue", back).over(Window.orderBy(*order))  # a row for each period: few, whatever the facts
    out = rows.withColumn(name, round_like(ratio(F.lit(100.0) * (F.col("revenue") - before), before), 1))
    return out.withColumn("revenue", round_like(F.col("revenue"), 2)).orderBy(*order)


def qoq_growth(s: Star) -> DataFrame:
    return growth(_by_date(s).groupBy("year", "quarter").agg(exact_sum(F.col("price")).alias("revenue")), ["year", "quarter"], 1, "qoq_growth_pct")


def mom_growth(s: Star) -> DataFrame:
    return growth(_by_date(s).groupBy("year", "month").agg(exact_sum(F.col("price")).alias("revenue")), ["year", "month"], 1, "mom_growth_pct")


def yoy_growth(s: Star) -> DataFrame:
    return growth(_by_date(s).groupBy("year", "quarter").agg(exact_sum(F.col("price")).alias("revenue")), ["year", "quarter"], 4, "yoy_growth_pct")


def basket_value(s: Star) -> DataFrame:
    """The mean value of an order, weekends against weekdays: rolled up to orders first."""
    orders = s.fact.groupBy("order_id", "order_date_key").agg(exact_sum(F.col("total_item_value")).alias("value"))
    return orders.join(s.dim_date, F.col("order_date_key") == F.col("date_key")).groupBy("is_weekend").agg(F.count("*").alias("orders"), round_like(exact_sum(F.col("value")) / F.count("value"), 2).alias("avg_basket_value"))


def cancelled_value_by_month(s: Star) -> DataFrame:
    cancelled = _by_date(s).where("order_status = 'canceled'")
    return cancelled.groupBy("year", "month").agg(round_like(exact_sum(F.col("total_item_value")), 2).alias("cancelled_value"), F.count_distinct("order_id").alias("cancelled_orders")).orderBy("year", "month")


QUERIES = {f.__name__: f for f in (revenue_by_state, freight_ratio_by_category, monthly_revenue, weekend_vs_weekday, top_categories, delivery_days_by_state, seller_state_revenue, order_size_distribution, qoq_growth, cancelled_value_by_month, mom_growth, yoy_growth, basket_value)}
