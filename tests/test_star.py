import pytest
from pyspark.sql import functions as F

from millrace.operators import gates, keys, star


def source(spark):
    customers = spark.createDataFrame([("c1", "u1", 1, "a", "X"), ("c2", "u1", 2, "b", "Y")], "customer_id string, customer_unique_id string, customer_zip_code_prefix int, customer_city string, customer_state string")
    products = spark.createDataFrame([("p2", None, 1, 1, 1, 1, 1), ("p1", "toys", 1, 1, 1, 1, 1)], "product_id string, product_category_name string, product_weight_g int, product_length_cm int, product_height_cm int, product_width_cm int, product_photos_qty int")
    sellers = spark.createDataFrame([("s1", 1, "a", "X")], "seller_id string, seller_zip_code_prefix int, seller_city string, seller_state string")
    orders = spark.createDataFrame([("o1", "c1", "delivered", "2020-01-30 23:00:00", "2020-02-01 01:00:00"), ("o2", "c9", "shipped", "2020-02-02 10:00:00", None)], "order_id string, customer_id string, order_status string, order_purchase_timestamp string, order_delivered_customer_date string").withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("order_purchase_timestamp", "order_delivered_customer_date")})
    items = spark.createDataFrame([("o1", 1, "p1", "s1", 10.0, 1.0), ("o1", 2, "p9", "s9", 5.0, 0.5), ("o2", 1, "p2", "s1", 2.0, 0.0)], "order_id string, order_item_id int, product_id string, seller_id string, price double, freight_value double")
    return customers, products, sellers, orders, items


def test_star(spark):
    customers, products, sellers, orders, items = source(spark)
    s = star.build_star(customers, products, sellers, orders, items)
    fact = {(r["order_id"], r["order_item_id"]): r for r in s.fact.collect()}
    assert [fact["o1", 2][k] for k in ("product_key", "seller_key")] == [-1, -1]
    assert fact["o2", 1]["customer_key"] == -1 and fact["o2", 1]["delivery_days"] is None
    assert fact["o1", 1]["delivery_days"] == 2 and fact["o1", 1]["order_date_key"] == 20200130
    assert {(r["product_key"], r["product_category"]) for r in s.dim_product.collect()} == {(1, "toys"), (2, "unknown"), (-1, "unknown")}
    assert s.dim_customer.count() == 2
    dates = s.dim_date.orderBy("date_key").collect()
    assert [r["day_of_week"] for r in dates] == [4, 5, 6, 0] and [r["is_weekend"] for r in dates] == [False, False, True, True]
    got = gates.validate_star(s.fact, items, {"product": (s.dim_product, "product_key"), "seller": (s.dim_seller, "seller_key")})
    assert got["fact_rows"] == 3 and got["unknown_product"] == 1
    with pytest.raises(gates.QualityGateError, match="orphans of customer"):
        gates.validate_star(s.fact, items, {"customer": (s.dim_customer, "customer_key")})


def test_fan_out_fires_the_gate(spark):
    customers, products, sellers, orders, items = source(spark)
    s = star.build_star(customers, products.union(products), sellers, orders, items)
    with pytest.raises(gates.QualityGateError, match="fact rows"):
        gates.validate_star(s.fact, items, {})
    with pytest.raises(gates.QualityGateError):
        gates.unique_key(products.union(products), ["product_id"], "products")


def test_keys_in_ranges_equal_keys_by_one_task(spark):
    df = spark.range(5000).select((F.xxhash64("id") % 100000).alias("a"), F.col("id").cast("string").alias("b"))
    one = keys.surrogate_keys(df, ["a", "b"], "k", 10)
    many = keys.surrogate_keys(df, ["a", "b"], "k", 10, one_task_bytes=0)
    assert not one.exceptAll(many).count() and many.agg(F.min("k"), F.max("k"), F.count_distinct("k")).first()[:] == (11, 5010, 5000)


def test_no_orders_no_dates(spark):
    assert star.date_dimension(source(spark)[3].limit(0)).count() == 0
