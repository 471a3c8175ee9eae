import pytest
from pyspark.sql import functions as F

from millrace.operators.cleaning import Cleaner
from millrace.operators.gates import QualityGateError

SCHEMA = "player_id long, short_name string, age int, nationality string, club string, position string, overall string, potential string, value_eur string, wage_eur string, joined_date string, height_cm int, weight_kg int"
ROWS = [
    (1, "A. One", 24, "  SPAIN ", "Reds", "ST", "90+2", "94", "€12.5M", "€90K", "2020-03-05", 180, 75),
    (2, "B. Two", 31, "brazil", None, "GK", "80-3", "80", "€750K", "€20K", "03/05/2020", 190, 85),
    (3, "C. Three", 19, "Japan", "Blues", "CB", "71", "83+1", None, "€5K", "5 Mar 2020", 185, 80),
    (2, "B. Two", 31, "brazil", None, "GK", "80-3", "80", "€750K", "€20K", "03/05/2020", 190, 85),
]


@pytest.fixture
def dirty(spark):
    return spark.createDataFrame(ROWS, SCHEMA).coalesce(1)


def rows(df):
    return {r["player_id"]: r for r in df.collect()}


def test_standard_chain(dirty):
    clean = Cleaner.of(dirty).standard()
    got = rows(clean.result())
    assert sorted(got) == [1, 2, 3]
    assert (got[1]["value_eur"], got[2]["value_eur"]) == (12.5e6, 750e3)
    assert (got[1]["overall"], got[2]["overall"], got[3]["potential"]) == (92, 77, 84)
    assert len({r["joined_date"] for r in got.values()}) == 1
    assert got[2]["club"] == "Free Agent"
    # The only one of its position: the median of all stands in, and is flagged.
    assert got[3]["value_eur_imputed"] and got[3]["value_eur"] == (12.5e6 + 750e3) / 2
    assert not got[1]["value_eur_imputed"]
    report = clean.quality_report().collect()
    assert len(report) == 9 and all(r["rows_affected"] >= 0 for r in report)
    assert [r["rows_affected"] for r in report] == [3, 3, 4, 4, 4, 4, 1, 2, 3]
    assert sorted(dirty.collect()) == sorted(map(tuple, ROWS), key=str) or dirty.count() == 4


def test_running_on_its_own_output_changes_nothing(dirty):
    once = Cleaner.of(dirty).standard().result()
    twice = Cleaner.of(once).standard().result()
    assert once.dtypes == twice.dtypes
    assert not once.exceptAll(twice).count() and not twice.exceptAll(once).count()


def test_failures_are_counted_and_sampled(spark):
    df = spark.createDataFrame([(k, f"bad {k}") for k in range(8)], "id long, v string").coalesce(1)
    r = Cleaner.of(df, "id").parse_currency("v").quality_report().first()
    assert r["rows_affected"] == 8 and r["detail"].startswith("8 ") and r["failed_samples"] == [f"bad {k}" for k in range(5)]


@pytest.mark.parametrize(("column", "value"), [("overall", 120), ("potential", 0), ("value_eur", -1.0), ("age", 99), ("value_eur", None), ("age", None)])
def test_gates_fire(dirty, column, value):
    clean = Cleaner.of(dirty).standard()
    kind = dict(clean.df.dtypes)[column]
    broken = Cleaner(clean.df.withColumn(column, F.when(F.col("player_id") == 1, F.lit(value).cast(kind)).otherwise(F.col(column))))
    with pytest.raises(QualityGateError):
        broken.validate()


def test_null_ratings_pass_the_gate(dirty):
    clean = Cleaner.of(dirty).standard()
    Cleaner(clean.df.withColumn("overall", F.lit(None).cast("int"))).validate()
