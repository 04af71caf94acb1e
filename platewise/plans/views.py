"""Driver tables as catalogue, diary, goals and weights: the same expressions for Spark and, as SQL, for DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..sources.common import driver_table

#: Expressions that both engines read alike.
CATALOGUE = {
    "id": "p_partkey",
    "name": "concat(p_name, ', ', lower(p_type))",
    "brand": "case when p_partkey % 7 = 0 then null else p_brand end",
    "source": "case when p_partkey % 4 = 0 then 'usda' when p_partkey % 4 = 1 then 'bls' when p_partkey % 4 = 2 then 'off' else 'frida' end",
    "lang": "case when p_partkey % 4 = 0 then 'en' when p_partkey % 4 = 1 then 'de' when p_partkey % 4 = 2 then null else 'da' end",
    "kcal": "case when p_partkey % 17 = 0 then null when p_partkey % 19 = 0 then cast(0 as double) when p_partkey % 23 = 0 then p_retailprice + cast(0.5 as double) else p_retailprice - cast(600 as double) end",
    "protein": "case when p_partkey % 29 = 0 then null else cast(p_size as double) / cast(2 as double) end",
    "fat": "cast(p_size % 10 as double)",
    "carbs": "case when p_partkey % 13 = 0 then p_size * cast(3 as double) when p_partkey % 11 = 0 then p_size * cast(1.6 as double) else cast(p_size as double) end",
    "fibre": "case when p_partkey % 3 = 0 then null else cast(p_size % 7 as double) end",
    "sugar": "cast(p_size % 12 as double)",
    "saturated": "cast(p_size % 4 as double)",
    "sodium": "cast(p_partkey % 50 as double)",
    "popularity": "cast(p_partkey % 31 as int)",
    "nova": "cast(1 + p_partkey % 4 as int)",
    "barcode": "case when p_partkey % 5 = 0 then null else lpad(cast(p_partkey as varchar(20)), 8, '0') end",
    "ord": "p_partkey",
}
CATALOGUE_SQL = "select " + ", ".join(f"{e} as {n}" for n, e in CATALOGUE.items()) + " from part"
DIARY_SQL = "select event_id as id, user_id, cast(ts as date) as log_date, hour(ts) as h, ts as created_at, value as calories, event_type as ref_kind, cast(regexp_extract(props, '([0-9]+)', 1) as bigint) as ref_id, concat('food ', regexp_extract(props, '([0-9]+)', 1)) as name from events where event_type not in ('signup', 'error')"
GOALS_SQL = "select user_id, cast(ts as date) as effective_from, max_by(value, ts) * 10 as calories_target from events where event_type = 'signup' group by user_id, cast(ts as date)"
WEIGHTS_SQL = "select user_id, cast(ts as date) as measured_on, max_by(value, ts) as kg from events where event_type = 'error' group by user_id, cast(ts as date)"
PROFILES_SQL = (
    "select c_custkey as user_id, case when c_custkey % 3 = 0 then 'male' when c_custkey % 3 = 1 then 'female' else 'unspecified' end as sex, cast(140 + c_custkey % 60 as double) as height_cm, "
    "make_date(cast(1940 + c_custkey % 65 as int), cast(1 + c_custkey % 12 as int), cast(1 + c_custkey % 28 as int)) as birth_date, case when c_custkey % 8 = 0 then cast(20 as double) else null end as body_fat, "
    "case c_mktsegment when 'MACHINERY' then 'sedentary' when 'BUILDING' then 'light' when 'AUTOMOBILE' then 'moderate' when 'FURNITURE' then 'active' else 'very_active' end as activity, "
    "case when c_custkey % 4 = 0 then 'lose' when c_custkey % 4 = 1 then 'gain' else 'maintain' end as direction, cast(c_custkey % 5 as double) / cast(4 as double) as rate from customer"
)
#: Long figures of a relational set; (food, field) repeats, so the last counts by a total order.
LONG_SQL = (
    "select l_orderkey as food, l_linenumber as field, l_quantity as value, l_shipdate, l_partkey, l_suppkey, l_extendedprice, case l_returnflag when 'A' then 'W' when 'N' then 'WKG' else '' end as basis, "
    "case l_linestatus when 'F' then 'kJ' else 'mg' end as unit from lineitem"
)
LONG_ORDER = ["l_shipdate", "l_partkey", "l_suppkey", "value", "l_extendedprice"]


def _view(spark: SparkSession, folder: str, table: str, sql: str) -> DataFrame:
    return spark.sql(sql.replace(f"from {table}", "from {t}"), t=driver_table(spark, folder, table))


def catalogue(spark: SparkSession, folder: str) -> DataFrame:
    """``part`` as foods with figures, of which some fail the gate on purpose."""
    return _view(spark, folder, "part", CATALOGUE_SQL)


def diary(spark: SparkSession, folder: str) -> DataFrame:
    """``events`` as diary entries."""
    return _view(spark, folder, "events", DIARY_SQL)


def goals(spark: SparkSession, folder: str) -> DataFrame:
    """``events`` as goals that change over time."""
    return _view(spark, folder, "events", GOALS_SQL)


def weights(spark: SparkSession, folder: str) -> DataFrame:
    """``events`` as weights, one a day."""
    return _view(spark, folder, "events", WEIGHTS_SQL)


def profiles(spark: SparkSession, folder: str) -> DataFrame:
    """``customer`` as profiles."""
    return _view(spark, folder, "customer", PROFILES_SQL)


def long_values(spark: SparkSession, folder: str) -> DataFrame:
    """``lineitem`` as long figures."""
    return _view(spark, folder, "lineitem", LONG_SQL)
