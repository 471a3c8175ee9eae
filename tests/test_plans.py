import duckdb
import pytest

from millrace.plans import oracle, registry, sqlfile
from millrace.sources import files

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES.split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", list(registry.queries()))
def test_query_equals_its_sql(spark, duck, name):
    df = registry.queries()[name](spark, SF)
    got = duck.execute(oracle.oracle_sql()[name])
    columns = [c[0] for c in got.description]
    assert sorted(columns) == sorted(df.columns)
    rows = lambda rs: sorted(repr(tuple(r)) for r in rs)
    assert rows(df.select(*columns).collect()) == rows(got.fetchall())


def test_sql_file(spark):
    text = "-- name: a\nSELECT 'x;y' AS v -- z;\n;\n\n-- name: b\nSELECT 2 AS v;\n"
    assert [n for n, _ in sqlfile.parse_queries(text)] == ["a", "b"]
    assert {n: df.first()[0] for n, df in sqlfile.run_queries(spark, text).items()} == {"a": "x;y", "b": 2}


def test_sources_and_sinks(spark, tmp_path):
    (tmp_path / "c.csv").write_text("id,v\n1, a \n2,\n")
    df = files.land_csv(spark, str(tmp_path / "c.csv"), "id int, v string", "landed")
    assert df.collect() == spark.table("landed").collect() and df.first()["v"] == " a "
    path = files.write_table(df, str(tmp_path / "t"))
    back = files.open_table(spark, path)
    with pytest.raises(ValueError):
        files.write_table(back, path)
    with pytest.raises(files.MissingTableError):
        files.open_table(spark, str(tmp_path / "none"))
    report = spark.createDataFrame([(" s ", ["a", "b"])], "step string, failed array<string>")
    files.write_report(report, str(tmp_path / "r"))
    assert [r["failed"] for r in spark.read.csv(str(tmp_path / "r"), header=True, escape='"').collect()] == ['["a","b"]']
    assert "id" in files.as_text(df)
