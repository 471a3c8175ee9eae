"""Star schemas: dimensions with surrogate keys and unknown members, a calendar, facts at item grain."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.columns import date_key, days_between, fiscal_quarter
from millrace.operators.keys import surrogate_keys
from millrace.sources.files import write_table

UNKNOWN_KEY = -1


@dataclass(frozen=True)
class Dimension:
    """How to build one: ``attributes`` maps new names to columns of the source; ``unknown`` gives the unknown member's attributes, and None leaves it out."""

    name: str
    natural_key: str
    attributes: dict[str, Column]
    unknown: dict[str, object] | None = field(default_factory=dict)

    @property
    def key(self) -> str:
        return f"{self.name}_key"

    def build(self, source: DataFrame) -> DataFrame:
        natural = f"{self.name}_natural_key"
        rows = source.select(F.col(self.natural_key).alias(natural), *[c.alias(n) for n, c in self.attributes.items()])
        out = surrogate_keys(rows, [natural], self.key).select(self.key, *rows.columns)
        if self.unknown is None:
            return out
        kinds = dict(out.dtypes)
        literal = {self.key: UNKNOWN_KEY, natural: "UNKNOWN", **self.unknown}
        member = source.sparkSession.range(1).select(*[F.lit(literal.get(c)).cast(kinds[c]).alias(c) for c in out.columns])
        return out.unionByName(member)


def customer_dimension(unknown_member: bool = False) -> Dimension:
    """One row for each order-level customer; without an unknown member unless asked for."""
    names = ("customer_unique_id", "customer_zip_code_prefix", "customer_city", "customer_state")
    return Dimension("customer", "customer_id", {c: F.col(c) for c in names}, {} if unknown_member else None)


def product_dimension() -> Dimension:
    names = ("product_weight_g", "product_length_cm", "product_height_cm", "product_width_cm", "product_photos_qty")
    return Dimension("product", "product_id", {"product_category": F.coalesce("product_category_name", F.lit("unknown")), **{c: F.col(c) for c in names}}, {"product_category": "unknown"})


def seller_dimension() -> Dimension:
    return Dimension("seller", "seller_id", {c: F.col(c) for c in ("seller_zip_code_prefix", "seller_city", "seller_state")}, {})


def date_dimension(orders: DataFrame, column: str = "order_purchase_timestamp", fiscal_start: int | None = None, holidays: DataFrame | None = None) -> DataFrame:
    """A row for each day from the first to the last; optionally fiscal quarters and, with ``holidays(full_date)``, a flag."""
    ends = orders.agg(F.to_date(F.min(column)).alias("lo"), F.to_date(F.max(column)).alias("hi")).where("lo is not null")
    d = F.col("full_date")
    days = ends.select(F.explode(F.sequence("lo", "hi")).alias("full_date"))
    weekday = (F.dayofweek(d) - 1).cast("bigint")
    out = days.select(
        date_key(d).alias("date_key"),
        d,
        F.year(d).cast("bigint").alias("year"),
        F.quarter(d).cast("bigint").alias("quarter"),
        F.month(d).cast("bigint").alias("month"),
        F.date_format(d, "MMMM").alias("month_name"),
        F.dayofmonth(d).cast("bigint").alias("day_of_month"),
        weekday.alias("day_of_week"),
        F.date_format(d, "EEEE").alias("day_name"),
        weekday.isin(0, 6).alias("is_weekend"),
    )
    if fiscal_start:
        out = out.withColumn("fiscal_quarter", fiscal_quarter(d, fiscal_start))
    if holidays is not None:
        marks = holidays.select("full_date", F.lit(True).alias("__h")).distinct()
        out = out.join(marks, "full_date", "left").withColumn("is_holiday", F.coalesce("__h", F.lit(False))).drop("__h").select(*out.columns, "is_holiday")
    return out


def fact_order_items(items: DataFrame, orders: DataFrame, customers: DataFrame, products: DataFrame, sellers: DataFrame) -> DataFrame:
    """One row for each item line; natural keys become surrogate keys, unmatched ones the unknown member's.

    No side is forced to be broadcast: the planner does that where sizes allow it, and
    splits skewed partitions of the shuffled joins where they don't.
    """
    c = customers.select("customer_key", F.col("customer_natural_key").alias("__c"))
    p = products.where("product_key <> -1").select("product_key", F.col("product_natural_key").alias("__p"))
    s = sellers.where("seller_key <> -1").select("seller_key", F.col("seller_natural_key").alias("__s"))
    # Narrow header first: customers meet orders at order grain, before the items multiply them.
    head = orders.join(c, F.col("customer_id") == F.col("__c"), "left").select("order_id", F.coalesce("customer_key", F.lit(UNKNOWN_KEY)).cast("bigint").alias("customer_key"), "order_status", "order_purchase_timestamp", "order_delivered_customer_date")
    joined = items.join(head, "order_id").join(p, F.col("product_id") == F.col("__p"), "left").join(s, F.col("seller_id") == F.col("__s"), "left")
    return joined.select(
        "order_id",
        "order_item_id",
        "customer_key",
        F.coalesce("product_key", F.lit(UNKNOWN_KEY)).cast("bigint").alias("product_key"),
        F.coalesce("seller_key", F.lit(UNKNOWN_KEY)).cast("bigint").alias("seller_key"),
        date_key(F.to_date("order_purchase_timestamp")).alias("order_date_key"),
        "order_status",
        "price",
        "freight_value",
        (F.col("price") + F.col("freight_value")).alias("total_item_value"),
        days_between(F.to_date("order_purchase_timestamp"), F.to_date("order_delivered_customer_date")).alias("delivery_days"),
    )


@dataclass(frozen=True)
class Star:
    dim_date: DataFrame
    dim_customer: DataFrame
    dim_product: DataFrame
    dim_seller: DataFrame
    fact: DataFrame


def build_star(customers: DataFrame, products: DataFrame, sellers: DataFrame, orders: DataFrame, items: DataFrame, unknown_customer: bool = False, keep: Callable[[str, DataFrame], DataFrame] = lambda _, df: df) -> Star:
    """All five tables, lazily: nothing runs before a query needs it. ``keep(name, table)`` may store a table and return it as read again; the fact is then built on stored dimensions of known size."""
    c = keep("dim_customer", customer_dimension(unknown_customer).build(customers))
    p = keep("dim_product", product_dimension().build(products))
    s = keep("dim_seller", seller_dimension().build(sellers))
    return Star(keep("dim_date", date_dimension(orders)), c, p, s, keep("fact", fact_order_items(items, orders, c, p, s)))


def stored_in(folder: str) -> Callable[[str, DataFrame], DataFrame]:
    """A ``keep`` that writes Parquet below a folder: built once, queried often."""
    return lambda name, df: df.sparkSession.read.schema(df.schema).parquet(write_table(df, f"{folder}/{name}"))


def at_common_grain(facts: dict[str, tuple[DataFrame, dict[str, Column]]], key: str) -> DataFrame:
    """Facts of different grain side by side without a fan trap: each is aggregated to the key before they are joined."""
    out = None
    for name, (fact, measures) in facts.items():
        own = fact.groupBy(key).agg(*[m.alias(f"{name}_{n}") for n, m in measures.items()])
        out = own if out is None else out.join(own, key, "full_outer")
    return out


def bridge(df: DataFrame, key: str, column: str, separator: str = ",") -> DataFrame:
    """``key, value`` for each part of a multi-value column."""
    return df.select(key, F.explode(F.split(column, rf"\s*{separator}\s*")).alias("value")).where("value <> ''").distinct()
