"""Hard quality gates: they pass, or raise with everything that is wrong."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class QualityGateError(Exception):
    def __init__(self, failures: list[str]):
        super().__init__("; ".join(failures))
        self.failures = failures


def check(failures: dict[str, bool]) -> None:
    """Raise if any of the named conditions fails."""
    bad = [name for name, ok in failures.items() if not ok]
    if bad:
        raise QualityGateError(bad)


def unique_key(df: DataFrame, keys: list[str], name: str) -> None:
    """Each key once; summed before it is shuffled."""
    again = df.groupBy(*keys).count().where("count > 1").limit(1).count()
    check({f"{name}: {', '.join(keys)} isn't unique": not again})


def orphans(fact: DataFrame, dim: DataFrame, key: str, dim_key: str | None = None) -> DataFrame:
    """Fact rows whose key the dimension lacks."""
    return fact.join(dim.select(F.col(dim_key or key).alias("__k")), F.col(key) == F.col("__k"), "left_anti")


def validate_star(fact: DataFrame, raw_items: DataFrame, dims: dict[str, tuple[DataFrame, str]]) -> dict[str, int]:
    """Fact rows equal raw rows and, for each (dimension, key), no orphans; returns the counts, unknown members included."""
    unknown = [F.count_if(F.col(key) == -1).cast("bigint").alias(f"unknown_{name}") for name, (_, key) in dims.items()]
    got = fact.agg(F.count("*").alias("fact_rows"), *unknown).first().asDict()
    got["raw_rows"] = raw_items.count()
    for name, (dim, key) in dims.items():
        got[f"orphans_{name}"] = orphans(fact, dim, key).count()
    check({f"{got['fact_rows']} fact rows, {got['raw_rows']} raw rows": got["fact_rows"] == got["raw_rows"]} | {f"{got[f'orphans_{n}']} orphans of {n}": got[f"orphans_{n}"] == 0 for n in dims})
    return got


def bad_rows(conditions: dict[str, Column]) -> list[Column]:
    """For each condition the number of rows that fail it; null doesn't fail."""
    return [F.count_if(~c).alias(name) for name, c in conditions.items()]
