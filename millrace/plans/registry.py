"""Every query by name, over the driver's tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import columns as C
from millrace.operators import gates, profile, scd, star
from millrace.operators.cleaning import Cleaner
from millrace.plans import scd_queries, star_queries
from millrace.sources import roles
from millrace.sources.files import shared_folder

Query = Callable[[SparkSession, str], DataFrame]


_STARS: dict[tuple[str, str], star.Star] = {}


def build(spark: SparkSession, d: str, again: bool = False) -> star.Star:
    """The warehouse of the tables in ``d``: built and stored at a session's first query, then read. ``again`` builds it anew, as after a change of the tables."""
    key = (spark.sparkContext.applicationId, d)
    if again or key not in _STARS:
        _STARS[key] = star.build_star(roles.raw_customers(spark, d), roles.raw_products(spark, d), roles.raw_sellers(spark, d), roles.raw_orders(spark, d), roles.raw_order_items(spark, d), keep=star.stored_in(shared_folder(spark)))
    return _STARS[key]


def versions(spark: SparkSession, d: str) -> DataFrame:
    return scd.with_product_keys(scd.type2(roles.product_snapshots(spark, d)))


def facts(spark: SparkSession, d: str) -> DataFrame:
    return scd.fact_orders(roles.product_orders(spark, d), versions(spark, d))


def _star(f: Callable[[star.Star], DataFrame]) -> Query:
    return lambda spark, d: f(build(spark, d))


def _versions(f: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, d: f(versions(spark, d))


def _players(f: Callable[[Cleaner], DataFrame]) -> Query:
    return lambda spark, d: f(Cleaner.of(roles.messy_players(spark, d), "ord"))


def validate_star(spark: SparkSession, d: str) -> DataFrame:
    s = build(spark, d)
    got = gates.validate_star(s.fact, roles.raw_order_items(spark, d), {"product": (s.dim_product, "product_key"), "seller": (s.dim_seller, "seller_key")})
    return spark.createDataFrame([(k, v) for k, v in sorted(got.items())], "measure string, n bigint")


def merged_versions(spark: SparkSession, d: str) -> DataFrame:
    """The same dimension as ``versions``, load by load; each but the last is stored, since the next one's plan has it several times."""
    dim, keep = spark.createDataFrame([], scd.TYPE2), star.stored_in(shared_folder(spark))
    for k, day in enumerate(roles.LOADS):
        dim = scd.merge_type2(keep(f"load_{k}", dim) if k else dim, roles.product_snapshot(spark, d, k), day)
    return dim


def merged(kind: str) -> Query:
    def run(spark: SparkSession, d: str) -> DataFrame:
        first = roles.product_snapshot(spark, d, 0)
        dim = first if kind == "type1" else first.select("product_id", "product_name", F.col("department").alias("current_department"), F.lit(None).cast("string").alias("previous_department"))
        for k in range(1, len(roles.LOADS)):
            dim = (scd.merge_type1 if kind == "type1" else scd.merge_type3)(dim, roles.product_snapshot(spark, d, k))
        return dim

    return run


def profile_queries() -> dict[str, Query]:
    return {
        "profile_duplicate_keys": lambda s, d: profile.duplicate_keys(roles.raw_orders(s, d), "order_id"),
        "profile_status_counts": lambda s, d: profile.frequencies(roles.raw_orders(s, d), "order_status"),
        "profile_null_category": lambda s, d: profile.nulls(roles.raw_products(s, d), "product_category_name"),
        "profile_items_per_order": lambda s, d: profile.rows_per_key(roles.raw_order_items(s, d), "order_id"),
    }


def cleaning_queries() -> dict[str, Query]:
    pick = lambda *names: lambda c: c.result().select("player_id", "ord", *names)
    return {
        "clean_normalize_text": _players(lambda c: pick("nationality")(c.normalize_text("nationality"))),
        "clean_parse_currency": _players(lambda c: pick("value_eur", "wage_eur")(c.parse_currency("value_eur").parse_currency("wage_eur"))),
        "clean_parse_rating": _players(lambda c: pick("overall", "potential")(c.parse_rating("overall").parse_rating("potential"))),
        "clean_parse_dates": _players(lambda c: pick("joined_date")(c.parse_dates("joined_date"))),
        "clean_dedupe": _players(lambda c: pick("short_name")(c.dedupe("player_id"))),
        "clean_handle_nulls": _players(lambda c: pick("club", "value_eur", "value_eur_imputed")(c.parse_currency("value_eur").handle_nulls())),
        "clean_full": _players(lambda c: c.standard().result().drop("ord")),
        "clean_report": _players(lambda c: c.standard().quality_report().select("step", "quality_dimension", "rows_affected")),
    }


def scd_queries_by_name() -> dict[str, Query]:
    q = scd_queries
    return {
        "scd1": lambda s, d: scd.type1(roles.product_snapshots(s, d)),
        "scd1_merged": merged("type1"),
        "scd2": versions,
        "scd2_merged": merged_versions,
        "scd2_stats": lambda s, d: scd.type2_stats(scd.type2(roles.product_snapshots(s, d))),
        "scd3": lambda s, d: scd.type3(roles.product_snapshots(s, d)),
        "scd3_merged": merged("type3"),
        "fact_orders_pit": facts,
        "scd_first_changed_key": _versions(q.first_changed_key),
        "scd_first_repriced_key": _versions(q.first_repriced_key),
        "scd_current": _versions(q.current_state),
        "scd_as_of": _versions(lambda v: q.state_on(v, "1998-01-15")),
        "scd_history": _versions(lambda v: q.history(v, q.first_changed_key(v))),
        "scd_price_vs_current": lambda s, d: q.price_then_and_now(facts(s, d), versions(s, d), q.first_repriced_key(versions(s, d))),
        "scd3_changed": lambda s, d: q.moved(scd.type3(roles.product_snapshots(s, d))),
        "naive_vs_pit_revenue": lambda s, d: q.naive_and_true_revenue(roles.product_orders(s, d), versions(s, d)),
        "scd_moves": _versions(q.moves),
        "scd_products_by_month": lambda s, d: q.counts_by_month(versions(s, d), star.date_dimension(roles.raw_orders(s, d))),
    }


def extension_queries() -> dict[str, Query]:
    def fiscal(s: SparkSession, d: str) -> DataFrame:
        return star.date_dimension(roles.raw_orders(s, d), fiscal_start=4).select("date_key", "fiscal_quarter")

    def two_grains(s: SparkSession, d: str) -> DataFrame:
        orders = roles.table(s, d, "orders").select(roles.natural("O", "o_orderkey").alias("order_id"), "o_totalprice")
        both = star.at_common_grain({"items": (roles.raw_order_items(s, d), {"price": C.exact_sum(F.col("price"))}), "header": (orders, {"total": C.exact_sum(F.col("o_totalprice"))})}, "order_id")
        return both.agg(F.count("*").alias("orders"), C.round_like(C.exact_sum(F.col("items_price")), 2).alias("item_value"), C.round_like(C.exact_sum(F.col("header_total")), 2).alias("header_value"))

    def words(s: SparkSession, d: str) -> DataFrame:
        return star.bridge(roles.table(s, d, "part"), "p_partkey", "p_name", " ").groupBy(F.col("value").alias("word")).agg(F.count("*").alias("parts"))

    def best_players(s: SparkSession, d: str) -> DataFrame:
        from millrace.operators.cleaning import first_rows

        clean = Cleaner.of(roles.messy_players(s, d), "ord").standard().result()
        return first_rows(clean, ["position"], [F.desc("overall"), F.asc("player_id")]).select("position", "player_id", "overall")

    return {"fiscal_quarters": fiscal, "orders_at_two_grains": two_grains, "part_name_bridge": words, "best_player_by_position": best_players}


def queries() -> dict[str, Query]:
    tables = {f"dim_{n}": _star(lambda s, n=n: getattr(s, f"dim_{n}")) for n in ("date", "customer", "product", "seller")}
    return {
        **{name: _star(f) for name, f in star_queries.QUERIES.items()},
        **tables,
        "fact_order_items": _star(lambda s: s.fact),
        "validate_star": validate_star,
        **profile_queries(),
        **cleaning_queries(),
        **scd_queries_by_name(),
        **extension_queries(),
    }
