"""The driver's tables in the roles that the warehouse's builders take.

Dirt is derived from attributes, without random numbers: parts of size 50 are not yet in
the catalogue and suppliers in debt are not registered, so their items meet the unknown
member; economy parts have no category; only finished orders have been delivered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.sources.files import snapshots


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def natural(letter: str, col: str) -> Column:
    return F.concat(F.lit(letter), F.lpad(F.col(col).cast("string"), 10, "0"))


def raw_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = table(spark, sf_dir, "nation")
    return table(spark, sf_dir, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select(
        natural("C", "c_custkey").alias("customer_id"),
        F.concat(F.lit("U"), F.expr("lpad(cast((c_custkey * 9) div 10 as string), 10, '0')")).alias("customer_unique_id"),
        (F.col("c_nationkey") * 1000 + F.col("c_custkey") % 1000).cast("bigint").alias("customer_zip_code_prefix"),
        F.col("c_mktsegment").alias("customer_city"),
        F.col("n_name").alias("customer_state"),
    )


def raw_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.col("p_size")
    return table(spark, sf_dir, "part").where("p_size <> 50").select(
        natural("P", "p_partkey").alias("product_id"),
        F.nullif(F.col("p_type"), F.lit("ECONOMY")).alias("product_category_name"),
        (size * 10).alias("product_weight_g"),
        size.alias("product_length_cm"),
        (size + 1).alias("product_height_cm"),
        (size + 2).alias("product_width_cm"),
        (size % 5).alias("product_photos_qty"),
    )


def raw_sellers(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = table(spark, sf_dir, "nation")
    return table(spark, sf_dir, "supplier").where("s_acctbal >= 0").join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select(
        natural("S", "s_suppkey").alias("seller_id"),
        (F.col("s_nationkey") * 1000).alias("seller_zip_code_prefix"),
        F.lower("n_name").alias("seller_city"),
        F.col("n_name").alias("seller_state"),
    )


def raw_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.when(F.col("o_orderstatus") == "F", "delivered").when(F.col("o_orderstatus") == "P", "canceled").otherwise("shipped")
    delivered = F.when(F.col("o_orderstatus") == "F", F.date_add(F.to_date("o_orderdate"), (F.col("o_orderkey") % 40).cast("int")))
    return table(spark, sf_dir, "orders").select(
        natural("O", "o_orderkey").alias("order_id"),
        natural("C", "o_custkey").alias("customer_id"),
        status.alias("order_status"),
        F.col("o_orderdate").alias("order_purchase_timestamp"),
        delivered.alias("order_delivered_customer_date"),
    )


def raw_order_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(
        natural("O", "l_orderkey").alias("order_id"),
        F.col("l_linenumber").alias("order_item_id"),
        natural("P", "l_partkey").alias("product_id"),
        natural("S", "l_suppkey").alias("seller_id"),
        F.col("l_extendedprice").alias("price"),
        (F.col("l_extendedprice") * F.col("l_tax")).alias("freight_value"),
    )


#: The dates of the three extracts.
LOADS = ("1995-01-01", "1997-01-01", "1999-01-01")


def product_snapshot(spark: SparkSession, sf_dir: str, load: int) -> DataFrame:
    """The catalogue at one of the loads: prices rise at the second (sizes divisible by 12) and third (by 24), aisles move at the third, names are corrected from the second on, size 49 comes with the second."""
    p = table(spark, sf_dir, "part")
    if load == 0:
        p = p.where("p_size <> 49")
    size = F.col("p_size")
    price = F.col("p_retailprice")
    if load >= 1:
        price = F.when(size % 12 == 0, price * 1.1).otherwise(price)
    if load >= 2:
        price = F.when(size % 24 == 0, price * 1.1).otherwise(price)
    moved = (size % 20 == 3) if load >= 2 else F.lit(False)
    renamed = (size % 10 == 7) if load >= 1 else F.lit(False)
    return p.select(
        F.col("p_partkey").alias("product_id"),
        F.when(renamed, F.concat("p_name", F.lit(" No."), F.col("p_partkey").cast("string"))).otherwise(F.col("p_name")).alias("product_name"),
        F.when(moved, F.lit("MOVED")).otherwise(F.col("p_type")).alias("department"),
        F.col("p_brand").alias("aisle"),
        price.alias("unit_price"),
    )


def product_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return snapshots([(d, product_snapshot(spark, sf_dir, k)) for k, d in enumerate(LOADS)])


def product_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders of products that are in the catalogue from the first load on."""
    known = table(spark, sf_dir, "part").where("p_size <> 49").select("p_partkey")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    items = table(spark, sf_dir, "lineitem").join(known, F.col("l_partkey") == F.col("p_partkey"), "left_semi")
    return items.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.col("l_orderkey").alias("order_id"), F.col("l_partkey").alias("product_id"), F.col("l_quantity").alias("quantity"), F.to_date("o_orderdate").alias("order_date")
    )


def messy_players(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as players with dirty strings; those of one segment and nation come twice. ``ord`` is the order of arrival."""
    c = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    key, bal = F.col("c_custkey"), F.col("c_acctbal")
    day = F.date_add(F.lit("2010-01-01").cast("date"), (key % 4000).cast("int"))
    rows = c.select(
        key.alias("player_id"),
        F.col("c_name").alias("short_name"),
        (F.lit(16) + key % 25).cast("int").alias("age"),
        F.when(key % 3 == 0, F.concat(F.lit("  "), F.upper("n_name"), F.lit("\t"))).when(key % 3 == 1, F.lower("n_name")).otherwise(F.col("n_name")).alias("nationality"),
        F.when(key % 10 == 0, F.lit(None).cast("string")).otherwise(F.concat(F.lit("Club "), F.col("c_nationkey").cast("string"))).alias("club"),
        F.col("c_mktsegment").alias("position"),
        F.when(key % 3 == 0, F.concat((F.lit(60) + key % 30).cast("string"), F.lit("+"), (key % 5).cast("string"))).when(key % 7 == 0, F.concat((F.lit(60) + key % 30).cast("string"), F.lit(" - 2"))).otherwise((F.lit(60) + key % 30).cast("string")).alias("overall"),
        (F.lit(65) + key % 30).cast("string").alias("potential"),
        F.when(key % 33 == 1, F.lit(None).cast("string")).when(key % 50 == 7, F.lit("n/a")).when(bal >= 5000, F.concat(F.lit("€"), (F.floor(bal / 100)).cast("string"), F.lit(".5M"))).when(bal >= 0, F.concat(F.lit("€"), F.floor(bal).cast("string"), F.lit("K"))).otherwise(F.lit("€0")).alias("value_eur"),
        F.concat(F.lit("€"), (F.lit(1) + key % 300).cast("string"), F.lit("K")).alias("wage_eur"),
        F.when(key % 3 == 0, F.date_format(day, "yyyy-MM-dd")).when(key % 3 == 1, F.date_format(day, "MM/dd/yyyy")).otherwise(F.date_format(day, "dd MMM yyyy")).alias("joined_date"),
        (F.lit(160) + key % 40).cast("int").alias("height_cm"),
        (F.lit(55) + key % 40).cast("int").alias("weight_kg"),
        key.alias("ord"),
    )
    again = rows.where((F.col("position") == "BUILDING") & (F.col("club") == "Club 3")).withColumn("ord", F.col("ord") + 1_000_000_000_000)
    return rows.unionByName(again)
