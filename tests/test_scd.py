import random

import pytest
from pyspark.sql import functions as F

from millrace.operators import scd
from millrace.operators.gates import QualityGateError
from millrace.sources.files import snapshots

SNAP = "product_id long, product_name string, aisle string, department string, unit_price double"
DAYS = ["2023-01-01", "2023-02-01", "2023-03-01", "2023-04-01"]


def random_loads(spark, seed):
    rng = random.Random(seed)
    pick = lambda *xs: rng.choice(xs)
    out = []
    for _ in DAYS:
        rows = [(k, pick("n1", "n2", None), pick("a", "b", None), pick("x", "y", None), pick(1.0, 2.0)) for k in range(6) if rng.random() < 0.8]
        out.append(spark.createDataFrame(rows, SNAP))
    return out


def same(a, b):
    b = b.select(*a.columns)
    return not a.exceptAll(b).count() and not b.exceptAll(a).count()


@pytest.mark.parametrize("seed", range(4))
def test_merges_equal_closed_forms(spark, seed):
    loads = random_loads(spark, seed)
    whole = snapshots(list(zip(DAYS, loads, strict=True)))
    dim = spark.createDataFrame([], scd.TYPE2)
    one, three = loads[0], loads[0].select("product_id", "product_name", F.col("department").alias("current_department"), F.lit(None).cast("string").alias("previous_department"))
    for k, (day, df) in enumerate(zip(DAYS, loads, strict=True)):
        dim = spark.createDataFrame(scd.merge_type2(dim, df, day).collect(), scd.TYPE2)
        if k:
            one, three = scd.merge_type1(one, df), scd.merge_type3(three, df)
    versions = scd.with_product_keys(scd.type2(whole))
    assert same(dim, versions)
    assert not scd.overlapping(versions).count()
    assert same(one, scd.type1(whole))
    assert same(three, scd.type3(whole))


def test_gates(spark):
    dim = spark.createDataFrame(scd.merge_type2(spark.createDataFrame([], scd.TYPE2), spark.createDataFrame([(1, "n", "a", "x", 1.0)], SNAP), DAYS[1]).collect(), scd.TYPE2)
    again = spark.createDataFrame([(1, "n", "a", "y", 1.0)], SNAP)
    with pytest.raises(QualityGateError, match="isn't later"):
        scd.merge_type2(dim, again, DAYS[1])
    with pytest.raises(QualityGateError, match="unique"):
        scd.merge_type2(dim, again.union(again), DAYS[2])
    with pytest.raises(ValueError):
        snapshots([(DAYS[1], again), (DAYS[0], again)])
    early = spark.createDataFrame([(1, 1, 2, "2022-12-31")], "order_id long, product_id long, quantity long, order_date string").withColumn("order_date", F.col("order_date").cast("date"))
    with pytest.raises(QualityGateError, match="1 orders, 0 fact rows"):
        scd.fact_orders(early, dim, gate=True)


def test_point_in_time_at_the_ends_of_a_version(spark):
    whole = snapshots([(d, spark.createDataFrame([(1, "n", "a", "x", p)], SNAP)) for d, p in ((DAYS[0], 1.0), (DAYS[1], 3.0))])
    versions = scd.with_product_keys(scd.type2(whole))
    orders = spark.createDataFrame([(1, 1, 2, "2023-01-31"), (2, 1, 2, "2023-02-01")], "order_id long, product_id long, quantity long, order_date string").withColumn("order_date", F.col("order_date").cast("date"))
    assert {r["order_id"]: r["line_revenue"] for r in scd.fact_orders(orders, versions, gate=True).collect()} == {1: 2.0, 2: 6.0}


def test_late_correction_splits_a_version(spark):
    whole = snapshots([(d, spark.createDataFrame([(1, "n", "a", "x", 1.0)], SNAP)) for d in (DAYS[0], DAYS[3])])
    fix = snapshots([(DAYS[1], spark.createDataFrame([(1, "n", "a", "x", 9.0)], SNAP))])
    got = scd.corrected(whole, fix).orderBy("effective_start_date").collect()
    assert [(str(r["effective_start_date"]), str(r["effective_end_date"]), r["unit_price"]) for r in got] == [(DAYS[0], "2023-01-31", 1.0), (DAYS[1], "2023-03-31", 9.0), (DAYS[3], "9999-12-31", 1.0)]


def test_missing_keys_can_be_expired(spark):
    a, b = spark.createDataFrame([(1, "n", "a", "x", 1.0), (2, "n", "a", "x", 1.0)], SNAP), spark.createDataFrame([(1, "n", "a", "x", 1.0)], SNAP)
    dim = spark.createDataFrame(scd.merge_type2(spark.createDataFrame([], scd.TYPE2), a, DAYS[0]).collect(), scd.TYPE2)
    assert scd.merge_type2(dim, b, DAYS[1]).where("is_current").count() == 2
    assert scd.merge_type2(dim, b, DAYS[1], expire_missing=True).where("is_current").count() == 1


def test_stream_of_snapshots(spark, tmp_path):
    from millrace.streaming.snapshots import merge_stream

    loads = snapshots([(d, spark.createDataFrame([(1, "n", "a", "x", float(k))], SNAP)) for k, d in enumerate(DAYS[:2])])
    loads.coalesce(1).write.parquet(str(tmp_path / "in"))
    q = merge_stream(spark, str(tmp_path / "in"), loads.schema, lambda n: str(tmp_path / f"dim{n}"), spark.createDataFrame([], scd.TYPE2), str(tmp_path / "state"))
    q.awaitTermination(120)
    assert same(spark.read.parquet(str(tmp_path / "dim0")), scd.with_product_keys(scd.type2(loads)))


def test_merged_versions_keep_their_plan_small_and_broadcast_nothing(spark):
    from millrace.plans import registry

    d = "/root/testdata/sf0.001"
    got = registry.queries()["scd2_merged"](spark, d)
    # A plan that holds all loads before has dozens of scans; a broadcast of the catalogue goes through the driver.
    assert got._jdf.queryExecution().optimizedPlan().toString().count("Relation [") <= 6
    assert "BroadcastHashJoin" not in got._jdf.queryExecution().executedPlan().toString()
    assert same(got, registry.queries()["scd2"](spark, d))
