"""A chainable cleaning pipeline: audited, idempotent, its input untouched.

Steps are lazy. What the audit needs of a step is one aggregation, run only when the report
is asked for. A step that finds its column already typed passes it through.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from millrace.functions import columns as C
from millrace.operators.gates import check
from millrace.sources.files import numbered

ORD = "__ord"
SAMPLES = 5
REPORT = "step string, quality_dimension string, rows_affected bigint, detail string, failed_samples array<string>"


@dataclass(frozen=True)
class Step:
    """``rows`` of ``frame`` are counted; ``failed`` of ``raw`` gives the samples; ``detail`` is formatted with the counts."""

    step: str
    dimension: str
    frame: DataFrame
    counts: dict[str, Column]
    detail: str
    failed: Column | None = None
    raw: str | None = None


@dataclass(frozen=True)
class Cleaner:
    df: DataFrame
    steps: tuple[Step, ...] = ()
    own_order: bool = False

    @classmethod
    def of(cls, df: DataFrame, order_col: str | None = None) -> Cleaner:
        """A chain over any frame. Keep-first needs an order: ``order_col``, or else that of the scan."""
        if order_col:
            return cls(df.withColumn(ORD, F.col(order_col)))
        return cls(numbered(df, ORD), own_order=True)

    def _with(self, df: DataFrame, step: Step) -> Cleaner:
        return replace(self, df=df, steps=(*self.steps, step))

    def normalize_text(self, column: str) -> Cleaner:
        """Strip and title-case."""
        new = C.title(C.strip(F.col(column)))
        counts = {"rows": F.count_if(~F.col(column).eqNullSafe(new) & F.col(column).isNotNull())}
        return self._with(self.df.withColumn(column, new), Step(f"normalize_text({column})", "consistency", self.df, counts, "strip + title-case"))

    def _parse(self, name: str, column: str, new: Column, typed: Column) -> Cleaner:
        done = C.is_number(self.df.schema[column].dataType)
        parsed = typed if done else new
        failed = F.col(column).isNotNull() & parsed.isNull()
        counts = {"rows": F.count(column), "failed": F.count_if(failed)}
        return self._with(self.df.withColumn(column, parsed), Step(f"{name}({column})", "validity", self.df, counts, "{failed} unparseable values", failed, column))

    def parse_currency(self, column: str) -> Cleaner:
        """To double; what can't be parsed becomes null."""
        return self._parse("parse_currency", column, C.currency(F.col(column)), F.col(column).cast("double"))

    def parse_rating(self, column: str) -> Cleaner:
        """To int, modifiers added."""
        return self._parse("parse_rating", column, C.rating(F.col(column)), F.col(column).cast("int"))

    def parse_dates(self, column: str) -> Cleaner:
        """To date by the first format that fits."""
        if C.is_date(self.df.schema[column].dataType):
            return self._with(self.df, Step(f"parse_dates({column})", "validity", self.df, {"rows": F.lit(0)}, "already a date: skipped"))
        hits = C.parsed_dates(F.col(column))
        new = F.coalesce(*hits)
        failed = F.col(column).isNotNull() & new.isNull()
        counts = {"rows": F.count(new), "failed": F.count_if(failed)}
        for k, h in enumerate(hits):
            earlier = F.coalesce(*hits[:k]) if k else F.lit(None).cast("date")
            counts[f"f{k}"] = F.count_if(h.isNotNull() & earlier.isNull())
        detail = ", ".join(f"{f}: {{f{k}}}" for k, f in enumerate(C.DATE_FORMATS)) + "; {failed} unparseable values"
        return self._with(self.df.withColumn(column, new), Step(f"parse_dates({column})", "validity", self.df, counts, detail, failed, column))

    def dedupe(self, key: str) -> Cleaner:
        """The first row of each key stays. A key that many rows share is reduced to its first before it is shuffled."""
        names = self.df.columns
        first = F.min_by(F.struct(*names), F.struct(F.col(ORD), F.xxhash64(*names)))
        kept = self.df.groupBy(F.col(key).alias("__key")).agg(first.alias("r")).select("r.*")
        counts = {"rows": F.count("*") - F.count_distinct(key) - F.max(F.when(F.col(key).isNull(), 1).otherwise(0))}
        return self._with(kept, Step(f"dedupe({key})", "uniqueness", self.df, counts, "first of each key kept"))

    def handle_nulls(self, label: str = "club", label_as: str = "Free Agent", value: str = "value_eur", group: str = "position") -> Cleaner:
        """Null labels are a state of their own; null values get the median of their group, else of all, and are flagged."""
        flag = f"{value}_imputed"
        medians = self.df.where(F.col(group).isNotNull()).groupBy(F.col(group).alias("__g")).agg(F.median(value).alias("__m"))
        overall = self.df.agg(F.median(value).alias("__all"))
        counts = {"rows": F.count_if(F.col(label).isNull()) + F.count_if(F.col(value).isNull()), "labels": F.count_if(F.col(label).isNull()), "values": F.count_if(F.col(value).isNull())}
        before = F.col(flag) if flag in self.df.columns else F.lit(False)
        joined = self.df.join(medians, F.col(group) == F.col("__g"), "left").crossJoin(F.broadcast(overall))  # one row
        out = joined.withColumn(flag, before | F.col(value).isNull()).withColumn(value, F.coalesce(F.col(value), "__m", "__all")).withColumn(label, F.coalesce(F.col(label), F.lit(label_as)))
        return self._with(out.drop("__g", "__m", "__all"), Step("handle_nulls", "completeness", self.df, counts, f"{{labels}} {label} labelled, {{values}} {value} imputed"))

    def gate_flags(self) -> dict[str, Column]:
        """Each gate as an aggregate that is true if it holds."""
        ok = lambda c: F.coalesce(F.bool_and(c), F.lit(True))
        return {
            "player_id is unique": F.count("*") == F.count_distinct("player_id"),
            "overall is 1 to 99": ok(F.col("overall").between(1, 99)),
            "potential is 1 to 99": ok(F.col("potential").between(1, 99)),
            "value_eur is filled": ok(F.col("value_eur").isNotNull()),
            "value_eur is not negative": ok(F.col("value_eur") >= 0),
            "age is 15 to 50": ok(F.coalesce(F.col("age").between(15, 50), F.lit(False))),
        }

    def validate(self) -> Cleaner:
        """Seven hard gates, in one pass; raises with all that fail."""
        flags = self.gate_flags()
        got = self.df.agg(*[c.alias(f"g{k}") for k, c in enumerate(flags.values())]).first()
        check({f"gate failed: {name}": bool(got[k]) for k, name in enumerate(flags)} | {"gate failed: joined_date is a date": C.is_date(self.df.schema["joined_date"].dataType)})
        return self._with(self.df, Step("validate", "accuracy", self.df, {"rows": F.count("*")}, f"all {len(flags) + 1} gates passed"))

    def standard(self) -> Cleaner:
        """The nine steps in their order."""
        return self.normalize_text("nationality").parse_currency("value_eur").parse_currency("wage_eur").parse_rating("overall").parse_rating("potential").parse_dates("joined_date").dedupe("player_id").handle_nulls().validate()

    def result(self) -> DataFrame:
        """The clean frame without helper columns."""
        return self.df.drop(ORD)

    def quality_report(self) -> DataFrame:
        """One row for each step, in order."""
        rows: list[Row] = []
        spark = self.df.sparkSession
        for own in self.steps:
            got = own.frame.agg(*[c.alias(n) for n, c in own.counts.items()]).first().asDict()
            got = {n: int(v or 0) for n, v in got.items()}
            samples = []
            if own.failed is not None and got.get("failed"):
                samples = [r[0] for r in own.frame.where(own.failed).orderBy(ORD).limit(SAMPLES).select(F.col(own.raw).cast("string")).collect()]
            rows.append(Row(own.step, own.dimension, got["rows"], own.detail.format(**got), samples))
        return spark.createDataFrame(rows, REPORT)


def first_rows(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key by ``order``, by a window."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("__rank", rank).where("__rank = 1").drop("__rank")
