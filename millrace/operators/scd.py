"""Slowly changing dimensions.

Whole histories come from all snapshots at once (closed forms: one window pass instead of
one merge a load); single loads can be merged into what is there. Tables are rebuilt, not
updated in place. Every function takes the business key and the attributes as parameters.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from millrace.operators.gates import check, unique_key
from millrace.operators.keys import surrogate_keys

#: Fixed value: the end of a version that is still valid.
FOREVER = "9999-12-31"
KEY, NAME = "product_id", "product_name"
TRACKED = ("aisle", "department", "unit_price")
TYPE2 = "product_key bigint, product_id bigint, product_name string, aisle string, department string, unit_price double, effective_start_date date, effective_end_date date, is_current boolean"


def type1(loads: DataFrame, key: str = KEY) -> DataFrame:
    """The last known row of each key over ``loads`` (with load_date). Absent keys stay."""
    columns = [c for c in loads.columns if c != "load_date"]
    return loads.groupBy(F.col(key).alias("__key")).agg(F.max_by(F.struct(*columns), "load_date").alias("r")).select("r.*")


def merge_type1(dim: DataFrame, snapshot: DataFrame, key: str = KEY) -> DataFrame:
    """One load: matched rows are overwritten, new ones added, others stay."""
    kept = dim.join(snapshot.select(key), key, "left_anti").select(*dim.columns)
    return kept.unionByName(snapshot.select(*dim.columns))


def _version_name(names: Column, later: Column) -> Column:
    """A name isn't tracked: every version has the newest non-null one, but one that began without a name stays without."""
    return F.when(names.isNotNull(), later)


def type2(loads: DataFrame, key: str = KEY, name: str = NAME, tracked: tuple[str, ...] = TRACKED) -> DataFrame:
    """All versions from all loads, without surrogate keys. A version opens where a tracked attribute differs, nulls included, from the key's load before."""
    by_date = Window.partitionBy(key).orderBy("load_date")
    onward = by_date.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    state = F.struct(*tracked)
    marked = loads.withColumns({
        "__first": F.lag("load_date").over(by_date).isNull(),
        "__same": state.eqNullSafe(F.lag(state).over(by_date)),
        "__name": F.last(name, ignorenulls=True).over(onward),
    })
    opened = marked.where(F.col("__first") | ~F.col("__same"))
    following = F.lead("load_date").over(by_date)
    return opened.select(
        key,
        _version_name(F.col(name), F.col("__name")).alias(name),
        *tracked,
        F.col("load_date").alias("effective_start_date"),
        F.coalesce(F.date_sub(following, 1), F.lit(FOREVER).cast("date")).alias("effective_end_date"),
        following.isNull().alias("is_current"),
        (~F.col("__first")).alias("__changed"),
    )


def with_product_keys(versions: DataFrame, key: str = KEY, surrogate: str = "product_key") -> DataFrame:
    """Keys in order of load; within one, changed rows before new ones, each by business key."""
    ordered = versions.withColumn("__new", (~F.col("__changed")).cast("int"))
    out = surrogate_keys(ordered, ["effective_start_date", "__new", key], surrogate)
    return out.select(surrogate, *[c for c in versions.columns if c != "__changed"])


def merge_type2(dim: DataFrame, snapshot: DataFrame, load_date: str, key: str = KEY, name: str = NAME, tracked: tuple[str, ...] = TRACKED, surrogate: str = "product_key", expire_missing: bool = False) -> DataFrame:
    """One load into the versions that are there. The load must be later than every version's start and have each key once.

    The plan reads ``dim`` several times, so a caller that merges load after load stores it
    in between. Both sides of the joins grow, and files compress too well for the planner to
    tell: none of them is sent through the driver.
    """
    day = F.lit(load_date).cast("date")
    newest = dim.agg(F.max("effective_start_date")).first()[0]
    check({f"load {load_date} isn't later than {newest}": newest is None or str(newest) < load_date})
    unique_key(snapshot, [key], "snapshot")
    s = snapshot.select(F.col(key).alias("__k"), F.col(name).alias("__n"), F.struct(*tracked).alias("__s"))
    met = dim.join(s.hint("merge"), F.col(key) == F.col("__k"), "left")
    present = F.col("__k").isNotNull()
    changed = F.col("is_current") & present & ~F.struct(*tracked).eqNullSafe(F.col("__s"))
    closed = changed | (F.col("is_current") & ~present) if expire_missing else changed
    kept = met.select(
        surrogate,
        key,
        F.when(F.col("__n") != F.col(name), F.col("__n")).otherwise(F.col(name)).alias(name),  # null neither overwrites nor is overwritten
        *tracked,
        "effective_start_date",
        F.when(closed, F.date_sub(day, 1)).otherwise(F.col("effective_end_date")).alias("effective_end_date"),
        (F.col("is_current") & ~closed).alias("is_current"),
    )
    current = dim.where("is_current").select(F.col(key).alias("__k"), F.struct(*tracked).alias("__s"))
    known = dim.select(F.col(key).alias("__any")).distinct()
    fresh = snapshot.join(current.hint("merge"), F.col(key) == F.col("__k"), "left").join(known.hint("merge"), F.col(key) == F.col("__any"), "left")
    fresh = fresh.where(F.col("__k").isNull() | ~F.struct(*[snapshot[c] for c in tracked]).eqNullSafe(F.col("__s"))).withColumn("__new", F.col("__any").isNull().cast("int"))
    last = dim.agg(F.coalesce(F.max(surrogate), F.lit(0))).first()[0]
    added = surrogate_keys(fresh.select(key, name, *tracked, "__new"), ["__new", key], surrogate, last)
    added = added.select(surrogate, key, name, *tracked, day.alias("effective_start_date"), F.lit(FOREVER).cast("date").alias("effective_end_date"), F.lit(True).alias("is_current"))
    return kept.unionByName(added)


def type2_stats(versions: DataFrame) -> DataFrame:
    """``total, current, changed``: versions, those still valid, and those that followed another."""
    return versions.agg(F.count("*").alias("total"), F.count_if("is_current").cast("bigint").alias("current"), F.count_if("__changed").cast("bigint").alias("changed"))


def type3(loads: DataFrame, key: str = KEY, name: str = NAME, attribute: str = "department") -> DataFrame:
    """The current and the previous value of one attribute; the name is of the load that brought the current one."""
    by_date = Window.partitionBy(key).orderBy("load_date")
    before = F.lag(attribute).over(by_date)
    runs = loads.withColumn("__opens", F.lag("load_date").over(by_date).isNull() | ~F.col(attribute).eqNullSafe(before)).where("__opens")
    last = runs.withColumn("__previous", F.lag(attribute).over(by_date)).groupBy(F.col(key).alias("__key"))
    return last.agg(F.max_by(F.struct(key, name, attribute, "__previous"), "load_date").alias("r")).select(f"r.{key}", f"r.{name}", F.col(f"r.{attribute}").alias(f"current_{attribute}"), F.col("r.__previous").alias(f"previous_{attribute}"))


def merge_type3(dim: DataFrame, snapshot: DataFrame, key: str = KEY, name: str = NAME, attribute: str = "department") -> DataFrame:
    """One load: where the attribute differs it moves to previous; new keys have no previous."""
    s = snapshot.select(F.col(key).alias("__k"), F.col(name).alias("__n"), F.col(attribute).alias("__a"))
    met = dim.join(s, F.col(key) == F.col("__k"), "full_outer")
    new = F.col(key).isNull()
    moved = F.col("__k").isNotNull() & ~F.col("__a").eqNullSafe(F.col(f"current_{attribute}"))
    pick = lambda there, other: F.when(new | moved, there).otherwise(other)
    return met.select(F.coalesce(key, "__k").alias(key), pick(F.col("__n"), F.col(name)).alias(name), pick(F.col("__a"), F.col(f"current_{attribute}")).alias(f"current_{attribute}"), F.when(new, F.lit(None)).when(moved, F.col(f"current_{attribute}")).otherwise(F.col(f"previous_{attribute}")).alias(f"previous_{attribute}"))


def point_in_time(facts: DataFrame, versions: DataFrame, date: str = "order_date", key: str = KEY) -> DataFrame:
    """Each fact with the version valid on its date: an equi-join on the key with the interval as a residual, since a key has few versions."""
    v = versions.withColumnRenamed(key, "__k")
    return facts.join(v, (F.col(key) == F.col("__k")) & F.col(date).between(F.col("effective_start_date"), F.col("effective_end_date"))).drop("__k")


def fact_orders(orders: DataFrame, versions: DataFrame, gate: bool = False) -> DataFrame:
    """Orders with the key of the version of their date and their revenue; the gate demands exactly one version for each order."""
    out = point_in_time(orders, versions).select("order_id", "order_date", "quantity", "product_key", (F.col("quantity") * F.col("unit_price")).alias("line_revenue"))
    if gate:
        n, m = orders.count(), out.count()
        check({f"{n} orders, {m} fact rows": n == m})
    return out


def overlapping(versions: DataFrame, key: str = KEY) -> DataFrame:
    """Versions that begin before the one before them ended."""
    by_start = Window.partitionBy(key).orderBy("effective_start_date")
    return versions.withColumn("__end", F.lag("effective_end_date").over(by_start)).where("effective_start_date <= __end").drop("__end")


def as_of(versions: DataFrame, date: str) -> DataFrame:
    """The versions valid on a date."""
    return versions.where(F.lit(date).cast("date").between(F.col("effective_start_date"), F.col("effective_end_date")))


def corrected(loads: DataFrame, corrections: DataFrame, key: str = KEY, name: str = NAME, tracked: tuple[str, ...] = TRACKED) -> DataFrame:
    """The history after late corrections (rows with their load_date): they join the loads, replacing one of the same key and date, and the history is made anew without gap or overlap."""
    kept = loads.join(corrections.select(key, "load_date"), [key, "load_date"], "left_anti").select(*loads.columns)
    return type2(kept.unionByName(corrections.select(*loads.columns)), key, name, tracked)
