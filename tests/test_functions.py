import pytest
from pyspark.sql import functions as F

from millrace.functions import columns as C


def one(spark, column, value, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(column(F.col("x"))).first()[0]


@pytest.mark.parametrize(("raw", "value"), [("€1.5M", 1.5e6), ("€20K", 2e4), ("€0", 0.0), ("75", 75.0), ("n/a", None), (None, None), ("1.2.3", None), (".", None), ("-5", None), ("1,000", None), ("€2B", None), ("€3m", 3e6), ("€ 4 K", 4e3)])
def test_currency(spark, raw, value):
    assert one(spark, C.currency, raw) == value


@pytest.mark.parametrize(("raw", "value"), [("85+2", 87), ("90-3", 87), ("77", 77), ("x", None), (None, None), ("90 + 2", 92), ("90+\t2", 92), ("+5", None)])
def test_rating(spark, raw, value):
    assert one(spark, C.rating, raw) == value


@pytest.mark.parametrize(("raw", "value"), [("  côte d'ivoire\t", "Côte D'Ivoire"), ("BOSNIA-HERZ", "Bosnia-Herz"), ("", ""), (None, None)])
def test_strip_and_title(spark, raw, value):
    assert one(spark, lambda x: C.title(C.strip(x)), raw) == value


@pytest.mark.parametrize(("raw", "value"), [("2019-7-1", "2019-07-01"), ("07/01/2019", "2019-07-01"), ("1 Jul 2019", "2019-07-01"), ("Jul 2019", None), (None, None)])
def test_dates(spark, raw, value):
    assert one(spark, lambda x: F.coalesce(*C.parsed_dates(x)).cast("string"), raw) == value


@pytest.mark.parametrize(("x", "digits", "value"), [(1.005, 2, 1.0), (0.285, 2, 0.28), (2.5, 0, 3.0), (-2.5, 0, -3.0)])
def test_round(spark, x, digits, value):
    assert one(spark, lambda c: C.round_like(c, digits), x, "double") == value


def test_ratio_of_zero(spark):
    assert one(spark, lambda c: C.ratio(c, F.lit(0.0)), 1.0, "double") is None
