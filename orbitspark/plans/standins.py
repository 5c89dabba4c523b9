"""Stand-in queries on the driver's tables, each beside its SQL. Names start with the operator's id in the survey."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import dates, names, orbit, propagate, text
from ..functions import sql as sql_functions
from ..operators import compare, fuzzy, mutations, relational
from ..operators.written import written
from ..sources import delimited, documents, ledger
from ..streaming import rollup
from . import identity, metrics, reports

_REGISTRY: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {}


def query(sql: str | None):
    def register(f):
        _REGISTRY[f.__name__] = (f, sql)
        return f

    return register


def collect() -> dict:
    return dict(_REGISTRY)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def r9(df: DataFrame, *columns: str) -> DataFrame:
    """The named doubles, rounded to nine places, in the place they have."""
    return df.withColumns({c: F.round(F.col(c).cast("double"), 9) for c in columns})


# ------------------------------------------------------------------ shared stand-ins
def events_daily(spark, d) -> DataFrame:
    return metrics.daily(table(spark, d, "events"), "user_id", "ts", "value")


def ownership(spark, d) -> DataFrame:
    """Two versions per user: one nation until a day in January 2024, the next one after."""
    u = table(spark, d, "events").select("user_id").distinct()
    nation = table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("k"), F.col("n_name").alias("operator_name"))
    split = F.date_add(F.lit(dt.date(2024, 1, 1)), (F.col("user_id") % 29 + 1).cast("int"))
    first = u.select("user_id", (F.col("user_id") % 25).alias("k"), F.lit(dt.date(1900, 1, 1)).alias("valid_from"), split.alias("valid_to"))
    second = u.select("user_id", ((F.col("user_id") + 1) % 25).alias("k"), split.alias("valid_from"), F.lit(None).cast("date").alias("valid_to"))
    return first.unionByName(second).join(nation, "k").drop("k")


def owned(spark, d, days: DataFrame | None = None) -> DataFrame:
    return metrics.daily_with_owner(events_daily(spark, d) if days is None else days, ownership(spark, d), "user_id")


_DAILY = """daily as (select user_id, cast(ts as date) as "day", avg(value) as value_avg, stddev_samp(value) as value_stddev, min(value) as value_min, max(value) as value_max, count(*)::bigint as n from events group by 1, 2)"""
_OWNED = _DAILY + """,
own as (select user_id, n_name as operator_name, vf, vt from (
  select user_id, user_id % 25 as k, date '1900-01-01' as vf, (date '2024-01-01' + cast(user_id % 29 + 1 as integer)) as vt from (select distinct user_id from events)
  union all select user_id, (user_id + 1) % 25, (date '2024-01-01' + cast(user_id % 29 + 1 as integer)), null from (select distinct user_id from events)) join nation on n_nationkey = k),
owned as (select d.*, o.operator_name from daily d left join own o on o.user_id = d.user_id and o.vf <= d."day" and (o.vt is null or d."day" < o.vt))"""
_ROLLED = _OWNED + """,
rolled as (select *, stddev_samp(value_avg) over (partition by user_id order by "day" range between interval 30 day preceding and current row) as rolling_stddev from owned)"""


# ------------------------------------------------------------------ metric programs
@query(f"with {_DAILY} select user_id, \"day\", round(value_avg, 9) as value_avg, round(value_stddev, 9) as value_stddev, value_min, value_max, n from daily")
def v1_daily(spark, d):
    return r9(events_daily(spark, d), "value_avg", "value_stddev")


@query(f"with {_OWNED} select user_id, \"day\", operator_name, round(value_avg, 9) as value_avg, n from owned")
def v2_daily_owner(spark, d):
    return r9(owned(spark, d).select("user_id", "day", "operator_name", "value_avg", "n"), "value_avg")


@query(f"with {_ROLLED} select user_id, operator_name, \"day\", round(rolling_stddev, 9) as rolling_stddev from rolled")
def v3_rolling(spark, d):
    return r9(metrics.station_keeping(owned(spark, d), "user_id").select("user_id", "operator_name", "day", "rolling_stddev"), "rolling_stddev")


@query(f"""with {_ROLLED}, last as (select * from (select *, row_number() over (partition by user_id order by "day" desc) as rn from rolled where rolling_stddev is not null) where rn = 1)
select operator_name, count(*)::bigint as active_count, round(avg(rolling_stddev), 9) as avg_rolling_km from last group by 1""")
def v4_latest_keeping(spark, d):
    return r9(metrics.latest_station_keeping_by_owner(metrics.station_keeping(owned(spark, d), "user_id"), "user_id", ["operator_name"]), "avg_rolling_km")


@query(f"""with {_ROLLED}, per as (select user_id, operator_name, quantile_cont(rolling_stddev, 0.5) as m from rolled where rolling_stddev is not null group by 1, 2)
select operator_name, count(*)::bigint as active_count, round(quantile_cont(m, 0.5), 9) as p50_km, round(quantile_cont(m, 0.9), 9) as p90_km, round(avg(m), 9) as mean_km from per group by 1""")
def v5_station_keeping(spark, d):
    return r9(metrics.station_keeping_by_owner(metrics.station_keeping(owned(spark, d), "user_id"), "user_id", ["operator_name"]), "p50_km", "p90_km", "mean_km")


def _lots(spark, d) -> DataFrame:
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_nationkey")
    return table(spark, d, "lineitem").select("l_extendedprice", "l_quantity", "l_suppkey").join(s, "l_suppkey")


@query("""with rows as (select cast(floor(l_extendedprice / 5000.0) * 5000 as integer) as x_bin, cast(floor(l_quantity / 5.0) * 5 as integer) as y_bin, s_nationkey as owner from lineitem join supplier on s_suppkey = l_suppkey),
per as (select x_bin, y_bin, owner, count(*) as owner_count from rows group by 1, 2, 3), bins as (select x_bin, y_bin, sum(owner_count) as bin_count from per group by 1, 2), fleets as (select owner, sum(owner_count) as fleet from per group by 1)
select x_bin, y_bin, owner, owner_count::bigint as owner_count, bin_count::bigint as bin_count, fleet::bigint as fleet, round(bin_count / (select count(*) from rows), 9) as bin_share, round(owner_count / fleet, 9) as owner_weight, round((bin_count / (select count(*) from rows)) * (owner_count / fleet), 9) as exposure
from per join bins using (x_bin, y_bin) join fleets using (owner)""")
def v6_exposure(spark, d):
    out = metrics.exposure(_lots(spark, d), orbit.bin_edge(F.col("l_extendedprice"), 5000), orbit.bin_edge(F.col("l_quantity"), 5), "s_nationkey")
    return r9(out.select("x_bin", "y_bin", "owner", "owner_count", "bin_count", "fleet", "bin_share", "owner_weight", "exposure"), "bin_share", "owner_weight", "exposure")


@query("""select cast(floor(l_extendedprice / 5000.0) * 5000 as integer) as x_bin, cast(floor(l_quantity / 5.0) * 5 as integer) as y_bin, count(*)::bigint as object_count from lineitem where l_extendedprice < 60000 group by 1, 2""")
def v7_density(spark, d):
    return metrics.density(table(spark, d, "lineitem").where("l_extendedprice < 60000"), orbit.bin_edge(F.col("l_extendedprice"), 5000), orbit.bin_edge(F.col("l_quantity"), 5))


_AS_OF = dt.date(2001, 8, 1)


@query("""with act as (select o_custkey as k, max(cast(o_orderdate as date)) as last_active from orders where o_orderstatus = 'O' group by 1),
dec as (select o_custkey as k, max(cast(o_orderdate as date)) as decay_date from orders where o_orderstatus = 'F' group by 1),
j as (select act.k, last_active, case when decay_date >= last_active then decay_date end as decay_date from act left join dec using (k))
select k, last_active, decay_date, (coalesce(decay_date, date '2001-08-01') - last_active)::integer as elapsed_days,
 case when decay_date is not null then decay_date <= cast(last_active + interval 60 month as date) when date '2001-08-01' > cast(last_active + interval 60 month as date) then false end as compliant from j""")
def v8_compliance(spark, d):
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("k"), "o_orderstatus", F.to_date("o_orderdate").alias("on"))
    act = o.where("o_orderstatus = 'O'").groupBy("k").agg(F.max("on").alias("last_active"))
    dec = o.where("o_orderstatus = 'F'").groupBy("k").agg(F.max("on").alias("decay_date"))
    dec = dec.join(act, "k").where("decay_date >= last_active").select("k", "decay_date")
    return metrics.compliance(act, dec, "k", F.lit(_AS_OF)).select("k", "last_active", "decay_date", "elapsed_days", "compliant")


_TTO = _OWNED + """,
base as (select user_id, operator_name, quantile_cont(value_avg, 0.5) as m from owned where "day" >= date '2024-01-10' group by 1, 2),
shell as (select operator_name, quantile_cont(m, 0.5) as shell, count(*) as shell_n from base group by 1),
near as (select o.user_id, b.operator_name, o."day" from owned o join base b on b.user_id = o.user_id join shell s on s.operator_name = b.operator_name where abs(o.value_avg - s.shell) <= 25),
isl as (select user_id, operator_name, min("day") as run_start, count(*) as c from (select *, "day" - cast(row_number() over (partition by user_id, operator_name order by "day") as integer) as g from near) group by user_id, operator_name, g),
first as (select user_id, operator_name, min(run_start) as operational_day from isl where c >= 3 group by 1, 2),
tto as (select f.user_id, f.operator_name, launch_day, operational_day, (operational_day - launch_day)::integer as days_to, shell_n::bigint as shell_n from first f join (select user_id, min("day") as launch_day from daily group by 1) using (user_id) join shell s on s.operator_name = f.operator_name)"""


def _tto(spark, d, days: DataFrame | None = None, o: DataFrame | None = None) -> DataFrame:
    """The rollup and its owners are read several times, so both are written first."""
    days = written(events_daily(spark, d)) if days is None else days
    o = written(owned(spark, d, days)) if o is None else o
    launch = days.groupBy("user_id").agg(F.min("day").alias("launch_day"))
    return metrics.time_to_operational(o, "user_id", "operator_name", launch, F.lit(dt.date(2024, 1, 10)), 25.0, 3)


@query(f"with {_TTO} select user_id, operator_name, launch_day, operational_day, days_to, shell_n from tto")
def v9_time_to_operational(spark, d):
    return _tto(spark, d).withColumnRenamed("days", "days_to")


@query(f"with {_TTO} select operator_name, count(*)::bigint as n, quantile_cont(days_to, 0.5) as median_days, round(quantile_cont(days_to, 0.9), 9) as p90_days from tto where shell_n >= 3 group by 1")
def v10_operational_by_owner(spark, d):
    return r9(metrics.operational_by_owner(_tto(spark, d), "operator_name"), "p90_days")


@query(f"""with {_OWNED}, t as (select cast(date_trunc('month', "day") as date) as m, operator_name, count(distinct user_id)::bigint as temporal_objects, count(*)::bigint as temporal_days, avg(value_stddev) as temporal_stability from owned group by 1, 2),
n as (select cast(date_trunc('month', "day") as date) as m, n_name as operator_name, count(distinct user_id)::bigint as naive_objects, count(*)::bigint as naive_days, avg(value_stddev) as naive_stability from daily join nation on n_nationkey = user_id % 25 group by 1, 2)
select m as "month", operator_name, temporal_objects, temporal_days, round(temporal_stability, 9) as temporal_stability, naive_objects, naive_days, round(naive_stability, 9) as naive_stability,
 (coalesce(temporal_days, 0) - coalesce(naive_days, 0))::bigint as delta_days, (coalesce(temporal_objects, 0) - coalesce(naive_objects, 0))::bigint as delta_objects from t full join n using (m, operator_name)""")
def v11_attribution_delta(spark, d):
    nation = table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("k"), F.col("n_name").alias("operator_name"))
    static = table(spark, d, "events").select("user_id", (F.col("user_id") % 25).alias("k")).distinct().join(nation, "k").drop("k")
    return r9(metrics.attribution_delta(owned(spark, d), static, "user_id", "operator_name"), "temporal_stability", "naive_stability")


@query(f"""with {_ROLLED}{_TTO[len(_OWNED):]},
sk as (select user_id, quantile_cont(rolling_stddev, 0.5) as m from rolled where rolling_stddev is not null group by 1),
ft as (select * from (select *, row_number() over (partition by user_id order by operational_day, shell_n desc) as rn from tto) where rn = 1)
select d.user_id, count(*)::bigint as gp_days, min("day") as first_gp_day, max("day") as last_gp_day, round(any_value(sk.m), 9) as sk_median_km, any_value(ft.days_to) as days_to_operational, any_value(ft.shell_n) as tto_shell_n, (d.user_id % 3 = 0) as disposal_compliant
from daily d left join sk on sk.user_id = d.user_id left join ft on ft.user_id = d.user_id group by d.user_id""")
def v12_behaviour(spark, d):
    days = written(events_daily(spark, d))
    o = written(owned(spark, d, days))
    disposal = days.select("user_id").distinct().withColumn("compliant", F.col("user_id") % 3 == 0)
    return r9(metrics.behaviour(days, metrics.station_keeping(o, "user_id"), _tto(spark, d, days, o), disposal, "user_id"), "sk_median_km")


def _products(spark, d) -> DataFrame:
    """One row per order line: a part's brand is the product, its flags and sizes the measures."""
    p = table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("slug"), "p_size")
    li = table(spark, d, "lineitem").select("l_partkey", "l_suppkey", "l_returnflag", "l_linestatus", "l_quantity", "l_discount", "l_linenumber")
    status = F.when(F.col("l_returnflag") == "R", "DECAYED").when(F.col("l_linestatus") == "O", "ACTIVE").otherwise("INACTIVE")
    return li.join(p, "l_partkey").select(
        "slug", "l_suppkey", status.alias("status"), F.when(F.col("l_returnflag") == "R", F.col("l_quantity") * 365.25).alias("lifetime_days"), F.when(F.col("l_linenumber") < 4, F.col("p_size")).alias("days_to_operational"), F.lit(3).alias("shell_n"),
        F.when(F.col("l_linestatus") == "O", F.col("l_discount") * 20).alias("sk_km"), F.when(F.col("l_returnflag") == "R", F.col("l_quantity") < 25).alias("compliant"), F.col("l_linenumber").alias("gp_days"), (F.col("l_linenumber") != 2).alias("anchored"), (F.col("l_quantity") > 45).alias("key_churn"),
    )


_BOARD = """with rows as (select p_brand as slug, case when l_returnflag = 'R' then 'DECAYED' when l_linestatus = 'O' then 'ACTIVE' else 'INACTIVE' end as status, case when l_returnflag = 'R' then l_quantity * 365.25 end as lifetime_days, case when l_linenumber < 4 then p_size end as tto,
 case when l_linestatus = 'O' then l_discount * 20 end as sk, case when l_returnflag = 'R' then l_quantity < 25 end as compliant, l_linenumber as gp_days, l_linenumber <> 2 as anchored, l_quantity > 45 as key_churn from lineitem join part on p_partkey = l_partkey)
select slug, count(*)::bigint as fleet_total, count(*) filter (where status <> 'DECAYED')::bigint as fleet_on_orbit, count(*) filter (where status = 'ACTIVE')::bigint as fleet_active, count(*) filter (where status = 'DECAYED')::bigint as decayed_count,
 round(100.0 * count(*) filter (where status = 'DECAYED') / count(*), 1)::double as decayed_share_pct, count(lifetime_days)::bigint as lifetime_n, round(quantile_cont(lifetime_days / 365.25, 0.5), 9) as median_lifetime_years, count(tto)::bigint as tto_n, quantile_cont(tto, 0.5)::double as median_days_to_operational,
 count(sk)::bigint as sk_n, round(100.0 * count(*) filter (where sk < 1) / nullif(count(sk), 0), 1)::double as station_keeping_share_pct, round(quantile_cont(sk, 0.5), 9) as p50_station_keeping_km, count(compliant)::bigint as disposal_n, round(100.0 * count(*) filter (where compliant) / nullif(count(compliant), 0), 1)::double as disposal_compliance_pct,
 count(*) filter (where gp_days > 0)::bigint as gp_n, round(100.0 * count(*) filter (where gp_days > 0) / count(*), 1)::double as gp_coverage_pct, count(*) filter (where not anchored)::bigint as provisional_n, count(*) filter (where key_churn)::bigint as key_churn_n from rows {} group by slug"""


@query(_BOARD.format(""))
def v14_leaderboard(spark, d):
    return r9(metrics.leaderboard(_products(spark, d), "slug"), "median_lifetime_years", "p50_station_keeping_km", "median_days_to_operational")


@query(_BOARD.format("where anchored"))
def v14_leaderboard_anchored(spark, d):
    return r9(metrics.leaderboard(_products(spark, d), "slug", anchored_only=True), "median_lifetime_years", "p50_station_keeping_km", "median_days_to_operational")


_DRAG = _DAILY + """,
lagged as (select *, lag("day") over w as pd, value_avg - lag(value_avg) over w as delta from daily window w as (partition by user_id order by "day")),
drag as (select "day", count(*)::bigint as observed, round(quantile_cont(delta * 1000, 0.5), 9) as median_d, round(quantile_cont(delta * 1000, 0.1), 9) as p10_d, round(quantile_cont(delta * 1000, 0.9), 9) as p90_d from lagged where pd = "day" - 1 and abs(delta) < 200 group by 1 having count(*) >= 5)"""


@query(f"with {_DRAG} select * from drag")
def v15_fleet_drag(spark, d):
    return r9(metrics.fleet_drag(events_daily(spark, d), "user_id", 5, 200.0), "median_d", "p10_d", "p90_d")


def _weather(spark, d) -> DataFrame:
    """A row of indices a day, made from its orders."""
    o = table(spark, d, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("sw_date"), (F.floor("o_totalprice") % 91).cast("int").alias("k"))
    x = [((F.col("k") * i) % 91).cast("int").alias(f"kp{i}") for i in range(1, 9)] + [((F.col("k") + i) % 400).cast("int").alias(f"ap{i}") for i in range(1, 9)]
    n = F.lit(None).cast("double")
    return o.select("sw_date", F.col("o_orderkey").cast("int").alias("bsrn"), *x, F.col("k").alias("kp_sum"), F.col("k").alias("ap_avg"), F.col("k").alias("isn"), n.alias("f107_obs"), n.alias("f107_adj"), n.alias("f107_obs_center81"), F.lpad(F.col("o_orderkey").cast("string"), 12, "0").alias("f107_data_type"))


@query("""with o as (select o_orderkey, cast(o_orderdate as date) as sw, cast(floor(o_totalprice) % 91 as integer) as k from orders),
f as (select * from (select *, row_number() over (partition by sw order by lpad(o_orderkey::varchar, 12, '0')) as rn from o) where rn = 1),
g as (select *, greatest(k % 91, (k*2) % 91, (k*3) % 91, (k*4) % 91, (k*5) % 91, (k*6) % 91, (k*7) % 91, (k*8) % 91) as kp from f)
select sw as "day", o_orderkey::integer as bsrn, kp / 10.0::double as kp_max, k as kp_sum, k as ap_avg, ((k + 8) % 400)::integer as ap_max, case when kp >= 90 then 'G5' when kp >= 80 then 'G4' when kp >= 70 then 'G3' when kp >= 60 then 'G2' when kp >= 50 then 'G1' end as storm_level from g""")
def v16_space_weather(spark, d):
    return metrics.space_weather(_weather(spark, d)).select("day", "bsrn", F.col("kp_max").cast("double").alias("kp_max"), "kp_sum", "ap_avg", "ap_max", "storm_level")


@query(f"""with {_DRAG}, w as (select cast(ts as date) as "day", max(value) as index_max from events where extract(day from ts) % 2 = 1 group by 1)
select "day", round(index_max, 9) as index_max, observed, median_d from w full join drag using ("day")""")
def v17_drag_environment(spark, d):
    w = table(spark, d, "events").where("day(ts) % 2 = 1").groupBy(F.to_date("ts").alias("day")).agg(F.max("value").alias("index_max"))
    return r9(metrics.drag_environment(w, metrics.fleet_drag(events_daily(spark, d), "user_id", 5, 200.0)).select("day", "index_max", "observed", "median_d"), "index_max", "median_d")


@query("select user_id, ts, event_id, event_type, value from (select *, row_number() over (partition by user_id order by ts desc, event_id) as rn from events) where rn = 1")
def v18_latest(spark, d):
    return metrics.latest_elements(table(spark, d, "events"), "user_id", "ts", "event_id").select("user_id", "ts", "event_id", "event_type", "value")


@query("""with f as (select *, coalesce(nullif(regexp_extract(s_name, '#0*([0-9]+)', 1), ''), upper(s_name)) as station from supplier)
select n_nationkey as k, n_name, r_name, count(*)::bigint as stations, string_agg(distinct station, ' / ' order by station) as station_list from f join nation on n_nationkey = s_nationkey join region on r_regionkey = n_regionkey group by all""")
def v19_stations(spark, d):
    s = table(spark, d, "supplier").select("s_nationkey", F.coalesce(F.nullif(F.regexp_extract("s_name", "#0*([0-9]+)", 1), F.lit("")), F.upper("s_name")).alias("station"))
    n = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return s.join(n, F.col("s_nationkey") == F.col("n_nationkey")).groupBy(F.col("n_nationkey").alias("k"), "n_name", "r_name").agg(F.count(F.lit(1)).alias("stations"), F.array_join(F.sort_array(F.collect_set("station")), " / ").alias("station_list"))


@query("""select o_custkey as callsign, count(*)::bigint as filings_total, count(*) filter (where o_orderstatus = 'O')::bigint as filings_pending, count(*) filter (where o_orderstatus = 'F')::bigint as filings_granted,
 count(*) filter (where o_orderstatus = 'O' and o_orderpriority like '1%')::bigint as pending_amendments, min(cast(o_orderdate as date)) as first_filed, max(cast(o_orderdate as date)) as last_filed from orders group by 1""")
def v20_dockets(spark, d):
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("callsign"), "o_orderstatus", "o_orderpriority", F.to_date("o_orderdate").alias("date_filed"), F.when(F.col("o_orderstatus") != "O", F.to_date("o_orderdate")).alias("disposed"))
    return metrics.dockets(o, metrics.pending(["disposed"]), F.col("o_orderstatus") == "F", F.col("o_orderpriority").startswith("1"))


# ------------------------------------------------------------------ identity programs
@query("""with t1 as (select c_custkey, s_suppkey, 'exact_key' as rule from customer join supplier on s_suppkey = c_custkey where s_nationkey = c_nationkey),
lone as (select s_nationkey, min(s_suppkey) as s_suppkey from supplier group by 1 having count(*) = 1 or min(s_suppkey) % 2 = 0),
t2 as (select c_custkey, lone.s_suppkey, 'nation' as rule from customer join lone on s_nationkey = c_nationkey where c_custkey not in (select c_custkey from t1)),
t3 as (select c_custkey, null::bigint as s_suppkey, 'provisional' as rule from customer where c_custkey not in (select c_custkey from t1) and c_custkey not in (select c_custkey from t2))
select * from t1 union all select * from t2 union all select * from t3""")
def v22_rule_cascade(spark, d):
    c, s = table(spark, d, "customer").select("c_custkey", "c_nationkey"), table(spark, d, "supplier").select("s_suppkey", "s_nationkey")
    t1 = c.join(s, (F.col("s_suppkey") == F.col("c_custkey")) & (F.col("s_nationkey") == F.col("c_nationkey"))).select("c_custkey", "s_suppkey", F.lit("exact_key").alias("rule"))
    lone = s.groupBy("s_nationkey").agg(F.min("s_suppkey").alias("s_suppkey"), F.count(F.lit(1)).alias("n")).where("n = 1 or s_suppkey % 2 = 0")
    t2 = c.join(lone, F.col("s_nationkey") == F.col("c_nationkey")).select("c_custkey", "s_suppkey", F.lit("nation").alias("rule"))
    t3 = c.select("c_custkey", F.lit(None).cast("long").alias("s_suppkey"), F.lit("provisional").alias("rule"))
    return relational.first_rule_wins([t1, t2, t3], ["c_custkey"])


def _launched(df: DataFrame, key: str, name: str, step: int) -> DataFrame:
    day = F.date_add(F.lit(dt.date(2000, 1, 1)), (F.col(key) * step % 3000).cast("int"))
    return df.select(F.col(key), F.lower(name).alias("name"), day.alias("launch_date"), F.lit("UNKNOWN").alias("regime"), F.lit(None).cast("string").alias("country"))


#: Blocks of characters that match in two names, longest first, then leftmost, and so on to both sides of each: the gestalt measure.
#: step holds, for pairs (a, b), what is still to be compared (x, y) and how many characters each comparison matched.
_GESTALT = """
step(a, b, x, y, n) as (
    select distinct a, b, a, b, 0 from pairs
    union all
    select a, b, u.x, u.y, u.n from (
        select a, b, x, y, list_max(flatten(list_transform(range(1, length(x) + 1), lambda i:
            list_transform(range(1, length(x) - i + 2), lambda k: case when contains(y, x[i:i + k - 1]) then {'k': k, 'i': -i} end)))) as m
        from step where x <> '' and y <> '') s,
    lateral (select unnest([
        {'x': x[1:-m.i - 1], 'y': y[1:strpos(y, x[-m.i:-m.i + m.k - 1]) - 1], 'n': m.k},
        {'x': x[-m.i + m.k:], 'y': y[strpos(y, x[-m.i:-m.i + m.k - 1]) + m.k:], 'n': 0}]) as u)
    where m.k is not null),
sims as (select a, b, case when a = '' and b = '' then 1.0::double else 2.0::double * sum(n) / (length(a) + length(b)) end as sim from step group by a, b)"""

#: All pairs that pass the gates, scored by the signals that are there; each probe's best, or none.
_LINK = (
    """with recursive {sides},
j as (select p.k as probe_key, c.k as satellite_id, p.n as a, c.n as b, abs(p.l - c.l) as dd, p.r <> 'UNKNOWN' and c.r <> 'UNKNOWN' as both_r
    from p join c on (p.l is null or c.l is null or abs(p.l - c.l) <= 30) and (p.r = 'UNKNOWN' or c.r = 'UNKNOWN' or p.r = c.r) and (p.o is null or c.o is null or p.o = c.o)),
pairs as (select distinct a, b from j),"""
    + _GESTALT
    + """,
s as (select probe_key, satellite_id, sim, dd, round((0.6::double * sim + coalesce(0.25::double * (1.0::double - dd / 30), 0) + case when both_r then 0.15::double else 0 end)
    / (0.6::double + case when dd is not null then 0.25::double else 0 end + case when both_r then 0.15::double else 0 end), 9) as score from j join sims using (a, b)),
m as (select * from s where score >= 0.75 qualify row_number() over (partition by probe_key order by score desc, satellite_id) = 1)
select p.k as probe_key, satellite_id, round(sim, 9) as name_sim, dd::integer as launch_days, score,
    case when score >= 0.92 then 'auto' when score >= 0.75 then 'review' else 'unmatched' end as decision from p left join m on m.probe_key = p.k"""
)
_PLAIN_SIDES = """
p as (select c_custkey as k, regexp_replace(lower(c_name), '[^a-z0-9]+', ' ', 'g') as n, date '2000-01-01' + cast(c_custkey * 7 % 3000 as integer) as l, 'UNKNOWN' as r, null::integer as o from customer),
c as (select s_suppkey as k, regexp_replace(lower(s_name), '[^a-z0-9]+', ' ', 'g') as n, date '2000-01-01' + cast(s_suppkey * 31 % 3000 as integer) as l, 'UNKNOWN' as r, null::integer as o from supplier)"""
_SPARSE_SIDES = """
p as (select c_custkey as k, regexp_replace(lower(c_mktsegment || ' ' || c_custkey % 97), '[^a-z0-9]+', ' ', 'g') as n,
    case when c_custkey % 3 > 0 then date '2000-01-01' + cast(c_custkey * 7 % 3000 as integer) end as l, ['LEO', 'GEO', 'UNKNOWN'][c_nationkey % 3 + 1] as r, case when c_nationkey % 2 = 0 then c_nationkey end as o from customer),
c as (select s_suppkey as k, regexp_replace(lower(['machinery', 'Household', 'furnture', 'auto-mobile', 'buildings'][s_nationkey % 5 + 1] || ' ' || s_suppkey % 89), '[^a-z0-9]+', ' ', 'g') as n,
    case when s_suppkey % 4 > 0 then date '2000-01-01' + cast(s_suppkey * 31 % 3000 as integer) end as l, ['LEO', 'GEO', 'UNKNOWN'][s_nationkey % 3 + 1] as r, case when s_nationkey % 3 = 0 then s_nationkey end as o from supplier)"""


def _linked(probes: DataFrame, cands: DataFrame) -> DataFrame:
    found = fuzzy.link(probes, cands)
    return found.withColumns({c: F.round(c, 9) for c in ("name_sim", "score")})


@query(_LINK.replace("{sides}", _PLAIN_SIDES))
def v23_fuzzy_match(spark, d):
    """Customers as probes of suppliers, launched on made-up days: gated, scored by the gestalt measure, decided."""
    probes = _launched(table(spark, d, "customer"), "c_custkey", "c_name", 7).withColumnRenamed("c_custkey", "probe_key")
    cands = _launched(table(spark, d, "supplier"), "s_suppkey", "s_name", 31).withColumnRenamed("s_suppkey", "satellite_id")
    return _linked(probes, cands)


@query(_LINK.replace("{sides}", _SPARSE_SIDES))
def j15_sparse_match(spark, d):
    """The same where launches, regimes and countries are often unknown and names are misspelt: undated pairs meet across all dates."""
    day = lambda key, step: F.date_add(F.lit(dt.date(2000, 1, 1)), (F.col(key) * step % 3000).cast("int"))
    regime = lambda key: F.element_at(F.array(*map(F.lit, ("LEO", "GEO", "UNKNOWN"))), (F.col(key) % 3 + 1).cast("int"))
    c, s = table(spark, d, "customer"), table(spark, d, "supplier")
    kinds = F.array(*map(F.lit, ("machinery", "Household", "furnture", "auto-mobile", "buildings")))
    country = lambda key, n: F.when(F.col(key) % n == 0, F.col(key).cast("string"))
    probes = c.select(
        F.col("c_custkey").alias("probe_key"), F.concat_ws(" ", "c_mktsegment", F.col("c_custkey") % 97).alias("name"),
        F.when(F.col("c_custkey") % 3 > 0, day("c_custkey", 7)).alias("launch_date"), regime("c_nationkey").alias("regime"), country("c_nationkey", 2).alias("country"),
    )
    kind = F.element_at(kinds, (F.col("s_nationkey") % 5 + 1).cast("int"))
    cands = s.select(
        F.col("s_suppkey").alias("satellite_id"), F.concat_ws(" ", kind, F.col("s_suppkey") % 89).alias("name"),
        F.when(F.col("s_suppkey") % 4 > 0, day("s_suppkey", 31)).alias("launch_date"), regime("s_nationkey").alias("regime"), country("s_nationkey", 3).alias("country"),
    )
    return _linked(probes, cands)


@query("""with a as (select c_custkey as k, lower(c_name) as n, date '2000-01-01' + cast(c_custkey * 7 % 3000 as integer) as l from customer), b as (select s_suppkey as k, lower(s_name) as n, date '2000-01-01' + cast(s_suppkey * 31 % 3000 as integer) as l from supplier),
j as (select a.k as probe_key, b.k as satellite_id, 1 - levenshtein(a.n, b.n) / greatest(length(a.n), length(b.n)) as sim, abs(a.l - b.l) as dd from a join b on abs(a.l - b.l) <= 30),
s as (select *, round((0.6 * sim + 0.25 * (1.0 - dd / 30)) / 0.85, 9) as score from j)
select probe_key, satellite_id, score, case when score >= 0.92 then 'auto' when score >= 0.75 then 'review' else 'unmatched' end as decision from (select *, row_number() over (partition by probe_key order by score desc, satellite_id) as rn from s) where rn = 1""")
def v23_fuzzy_match_edit(spark, d):
    """The same program with edit distance for the name signal, which both engines have."""
    probes = _launched(table(spark, d, "customer"), "c_custkey", "c_name", 7).withColumnRenamed("c_custkey", "probe_key")
    cands = _launched(table(spark, d, "supplier"), "s_suppkey", "s_name", 31).withColumnRenamed("s_suppkey", "satellite_id")
    found = fuzzy.link(probes, cands, low=None, measure="edit", fold=lambda name: name)
    return found.where("satellite_id is not null").select("probe_key", "satellite_id", F.round("score", 9).alias("score"), "decision")


_SNAPS = "prev as (select l_orderkey * 10 + l_linenumber as k, l_suppkey as ref from lineitem where l_linenumber <= 4), cur as (select l_orderkey * 10 + l_linenumber as k, case when l_partkey % 9 = 0 then null else l_suppkey + (case when l_partkey % 11 = 0 then 1 else 0 end) end as ref from lineitem where l_linenumber >= 2)"


def _snapshots(spark, d) -> tuple[DataFrame, DataFrame]:
    li = table(spark, d, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("k"), "l_suppkey", "l_partkey", "l_linenumber")
    cur = F.when(F.col("l_partkey") % 9 != 0, F.col("l_suppkey") + F.when(F.col("l_partkey") % 11 == 0, 1).otherwise(0))
    return li.where("l_linenumber <= 4").select("k", F.col("l_suppkey").alias("ref")), li.where("l_linenumber >= 2").select("k", cur.alias("ref"))


@query(f"with {_SNAPS} select k, prev.ref as previous_referent, cur.ref as current_referent from prev join cur using (k) where prev.ref is distinct from cur.ref")
def v25_churn(spark, d):
    return compare.referent_changes(*_snapshots(spark, d), "k", "ref")


@query(f"with {_SNAPS} select (select count(*) from prev join cur using (k))::bigint as observations, (select count(*) from prev join cur using (k) where prev.ref is distinct from cur.ref)::bigint as referent_changes")
def v25_stability(spark, d):
    return compare.stability(*_snapshots(spark, d), "k", "ref")


_CLAIMS = """claims as (select c_custkey as satellite_id, 'a' as source, 'name' as attribute, c_name as value from customer union all select c_custkey, 'a', 'segment', c_mktsegment from customer where c_custkey % 3 <> 0
 union all select s_suppkey, 'b', 'name', s_name from supplier union all select s_suppkey, 'b', 'segment', case when s_suppkey % 2 = 0 then 'BUILDING' else 'UNKNOWN' end from supplier)"""


def _claims(spark, d) -> DataFrame:
    run = [F.lit(dt.datetime(2024, 1, 1)).alias("observed_at"), F.lit(1).cast("long").alias("ingest_run_id")]
    c = table(spark, d, "customer").select("c_custkey", "c_name", F.when(F.col("c_custkey") % 3 != 0, F.col("c_mktsegment")).alias("seg"), *run)
    s = table(spark, d, "supplier").select("s_suppkey", "s_name", F.when(F.col("s_suppkey") % 2 == 0, "BUILDING").otherwise("UNKNOWN").alias("seg"), *run)
    x = lambda df, k: df.select(F.col(k).cast("string").alias("id_value"), F.col(k).alias("satellite_id"))
    return relational.claims(c, x(c, "c_custkey"), "c_custkey", "a", {"name": "c_name", "segment": "seg"}).unionByName(relational.claims(s, x(s, "s_suppkey"), "s_suppkey", "b", {"name": "s_name", "segment": "seg"}))


@query(f"with {_CLAIMS} select satellite_id, satellite_id::varchar as source_key, attribute, value, source from claims")
def v26_assertions(spark, d):
    return _claims(spark, d).select("satellite_id", "source_key", "attribute", "value", "source")


@query(f"with {_CLAIMS} select satellite_id, attribute, value, source from (select *, row_number() over (partition by satellite_id, attribute order by case source when 'b' then 1 else 2 end) as rn from claims) where rn = 1")
def v27_precedence(spark, d):
    return relational.by_precedence(_claims(spark, d), ["satellite_id", "attribute"], "source", ["b", "a"]).select("satellite_id", "attribute", "value", "source")


@query(f"with {_CLAIMS} select satellite_id, value as status, source from (select *, row_number() over (partition by satellite_id order by case source when 'b' then 1 else 2 end) as rn from claims where attribute = 'segment' and value <> 'UNKNOWN') where rn = 1")
def v28_status_fall_through(spark, d):
    c = _claims(spark, d).where("attribute = 'segment' and value <> 'UNKNOWN'")
    return relational.by_precedence(c, ["satellite_id"], "source", ["b", "a"]).select("satellite_id", F.col("value").alias("status"), "source")


@query("""with o as (select o_custkey as satellite_id, c_nationkey::bigint as operator_id, min(cast(o_orderdate as date)) as launch from orders join customer on c_custkey = o_custkey group by 1, 2),
q as (select n_nationkey::bigint as child_id, (n_nationkey + 100)::bigint as parent_id, date '1996-01-01' + n_nationkey * 30 as vf from nation where n_nationkey % 2 = 0),
j as (select * from o left join q on child_id = operator_id)
select satellite_id, operator_id, launch as valid_from, case when launch < vf then vf end as valid_to from j union all select satellite_id, parent_id, vf, null from j where launch < vf""")
def v29_ownership(spark, d):
    o = table(spark, d, "orders").select("o_custkey", F.to_date("o_orderdate").alias("on")).join(table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey"), "o_custkey")
    owners = o.groupBy(F.col("o_custkey").alias("satellite_id"), F.col("c_nationkey").cast("long").alias("operator_id")).agg(F.min("on").alias("launch_date"))
    deals = table(spark, d, "nation").where("n_nationkey % 2 = 0").select(F.col("n_nationkey").cast("long").alias("child_id"), (F.col("n_nationkey") + 100).cast("long").alias("parent_id"), F.date_add(F.lit(dt.date(1996, 1, 1)), F.col("n_nationkey") * 30).alias("valid_from"))
    return mutations.split_ownership(owners, deals)


@query("""with recursive e as (select n_nationkey as code, case when n_nationkey > 0 then n_nationkey // 2 end as parent_code, n_nationkey % 5 <> 3 as b from nation),
c as (select code as leaf, code as cur, 0 as depth from e union all select c.leaf, e.parent_code, c.depth + 1 from c join e on e.code = c.cur join e p on p.code = e.parent_code where p.b and c.depth < 10 and e.parent_code <> c.cur)
select leaf, cur as root, depth from (select *, row_number() over (partition by leaf order by depth desc) as rn from c) where rn = 1""")
def r1_parent_walk(spark, d):
    n = table(spark, d, "nation")
    edges = n.select(F.col("n_nationkey").alias("code"), F.when(F.col("n_nationkey") > 0, F.floor(F.col("n_nationkey") / 2).cast("int")).alias("parent_code"))
    return relational.walk_up(edges, n.where("n_nationkey % 5 <> 3").select(F.col("n_nationkey").alias("code"))).select("leaf", "root", "depth")


@query("""select slug, mode() within group (order by p_name) as display, count(*)::bigint as n from (select p_name, trim(regexp_replace(regexp_replace(lower(p_type), '\\+', '-plus', 'g'), '[^a-z0-9]+', '-', 'g'), '-') as slug from part) group by 1""")
def v31_display_mode(spark, d):
    p = table(spark, d, "part").select("p_name", names.slugify(F.col("p_type"), plus=True).alias("slug"))
    return p.groupBy("slug").agg(F.expr("mode() within group (order by p_name)").alias("display"), F.count(F.lit(1)).alias("n"))


@query("""with u as (select nm, min(id) as id from (select c_name as nm, c_custkey as id from customer union all select c_name, c_custkey from customer where c_acctbal < 0) group by nm having count(*) = 1)
select c_custkey, u.id as satellite_id from customer join u on u.nm = c_name""")
def v33_unique_name(spark, d):
    """Grants whose name is that of exactly one entity."""
    c = table(spark, d, "customer").select("c_custkey", F.col("c_name").alias("nm"), "c_acctbal")
    right = c.select("nm", F.col("c_custkey").alias("satellite_id"))
    twins = c.where("c_acctbal < 0").select("nm", F.col("c_custkey").alias("satellite_id"))
    return relational.unique_matches(c, right.unionByName(twins), "nm", "satellite_id").select("c_custkey", "satellite_id")


# ------------------------------------------------------------------ joins, windows, sorts, sets
@query("select n_nationkey as k, n_name, count(s_suppkey)::bigint as n from nation left join supplier on s_nationkey = n_nationkey and s_acctbal > 5000 group by 1, 2")
def j2_left_join(spark, d):
    s = table(spark, d, "supplier").where("s_acctbal > 5000").select("s_nationkey", "s_suppkey")
    return table(spark, d, "nation").join(s, F.col("n_nationkey") == F.col("s_nationkey"), "left").groupBy(F.col("n_nationkey").alias("k"), "n_name").agg(F.count("s_suppkey").alias("n"))


@query("select c_custkey, c_name from customer where exists (select 1 from orders where o_custkey = c_custkey and o_orderstatus = 'O') and not exists (select 1 from orders where o_custkey = c_custkey and o_orderpriority like '1%')")
def j8_j9_semi_anti(spark, d):
    o = table(spark, d, "orders")
    c = table(spark, d, "customer").select("c_custkey", "c_name")
    return c.join(o.where("o_orderstatus = 'O'").select("o_custkey"), F.col("c_custkey") == F.col("o_custkey"), "left_semi").join(o.where(F.col("o_orderpriority").startswith("1")).select("o_custkey"), F.col("c_custkey") == F.col("o_custkey"), "left_anti")


@query("select c_custkey, (exists (select 1 from orders where o_custkey = c_custkey and o_orderstatus = 'P') or exists (select 1 from supplier where s_suppkey = c_custkey)) as churned from customer")
def j10_exists_flag(spark, d):
    """An EXISTS with OR as two keys united, then one hash join instead of a nested loop."""
    keys = table(spark, d, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey")).union(table(spark, d, "supplier").select("s_suppkey")).distinct()
    return table(spark, d, "customer").select("c_custkey").join(keys.withColumn("h", F.lit(True)), "c_custkey", "left").select("c_custkey", F.coalesce("h", F.lit(False)).alias("churned"))


@query("select a.user_id, a.n as n_first, b.n as n_second from (select user_id, case when count(*) > 60 then count(*) end as n from events where ts < timestamp '2024-01-16' group by 1) a join (select user_id, case when count(*) > 60 then count(*) end as n from events where ts >= timestamp '2024-01-16' group by 1) b on a.user_id = b.user_id and a.n is not distinct from b.n")
def j6_null_safe(spark, d):
    e = table(spark, d, "events")
    n = F.count(F.lit(1))
    half = lambda c, alias: e.where(c).groupBy("user_id").agg(F.when(n > 60, n).alias(alias))
    a, b = half("ts < timestamp_ntz '2024-01-16'", "n_first"), half("ts >= timestamp_ntz '2024-01-16'", "n_second").withColumnRenamed("user_id", "u")
    return a.join(b, (a["user_id"] == b["u"]) & a["n_first"].eqNullSafe(b["n_second"])).drop("u")


@query("""select c_custkey, o_orderkey, o_totalprice from customer, lateral (select o_orderkey, o_totalprice from orders where o_custkey = c_custkey order by o_totalprice desc, o_orderkey limit 1)""")
def j7_lateral_top1(spark, d):
    top = relational.latest_per_key(table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_totalprice"), ["o_custkey"], [F.desc("o_totalprice"), F.asc("o_orderkey")])
    return table(spark, d, "customer").select("c_custkey").join(top, F.col("c_custkey") == F.col("o_custkey")).select("c_custkey", "o_orderkey", "o_totalprice")


@query("select r_name, p_brand, count(*)::bigint as n from region, (select distinct p_brand from part where p_brand like '%1%') b, lateral (select 1 where r_name ilike '%' || substr(b.p_brand, length(b.p_brand), 1) || '%' or r_name ilike 'a%') group by 1, 2")
def j11_pattern_join(spark, d):
    """A join by pattern, over a handful of patterns."""
    b = table(spark, d, "part").where(F.col("p_brand").like("%1%")).select("p_brand").distinct()
    r = table(spark, d, "region").select("r_name")
    return relational.pattern_join(r, b, F.col("r_name").ilike("a%") | F.contains(F.lower("r_name"), F.lower(F.substring("p_brand", -1, 1)))).groupBy("r_name", "p_brand").agg(F.count(F.lit(1)).alias("n"))


@query(f"with {_DAILY} select user_id, min(\"day\") as run_start, max(\"day\") as run_end, count(*)::bigint as run_length from (select user_id, \"day\", \"day\" - cast(row_number() over (partition by user_id order by \"day\") as integer) as g from daily) group by user_id, g having count(*) >= 3")
def w3_islands(spark, d):
    return relational.islands(events_daily(spark, d), "user_id", "day").where("run_length >= 3")


@query("""select user_id, min(value) as lowest, max(value) as highest, round(avg(case when ts > mx - interval 7 day then value end), 9) as recent_avg, round(avg(case when ts <= mx - interval 7 day and ts > mx - interval 14 day then value end), 9) as before_avg from (select *, max(ts) over (partition by user_id) as mx from events) group by 1""")
def w4_w5_conditional(spark, d):
    e = table(spark, d, "events").withColumn("mx", F.max("ts").over(Window.partitionBy("user_id")))
    week, two = F.expr("mx - interval 7 day"), F.expr("mx - interval 14 day")
    return r9(e.groupBy("user_id").agg(F.min("value").alias("lowest"), F.max("value").alias("highest"), F.avg(F.when(F.col("ts") > week, F.col("value"))).alias("recent_avg"), F.avg(F.when((F.col("ts") <= week) & (F.col("ts") > two), F.col("value"))).alias("before_avg")), "recent_avg", "before_avg")


@query("select o_orderkey, o_orderpriority, o_totalprice from (select *, row_number() over (partition by o_orderpriority order by o_totalprice desc, o_orderkey) as rn from orders) order by rn, o_orderpriority limit 25")
def w8_round_robin(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_orderpriority", "o_totalprice")
    return relational.round_robin(o, "o_orderpriority", [F.desc("o_totalprice"), F.asc("o_orderkey")], 25).select("o_orderkey", "o_orderpriority", "o_totalprice")


@query("""with recursive n as (select conv_id, turn, role, row_number() over (partition by conv_id order by turn, role) as i from conversations),
w as (select conv_id, turn, role, i, [role] as has, 0 as g from n where i = 1 union all select n.conv_id, n.turn, n.role, n.i, case when list_contains(w.has, n.role) then [n.role] else list_append(w.has, n.role) end, w.g + list_contains(w.has, n.role)::integer from w join n on n.conv_id = w.conv_id and n.i = w.i + 1)
select conv_id, turn, role, g::integer as group_id from w""")
def w9_group_ids(spark, d):
    """A group closes when any of its labels comes again."""
    return relational.group_ids(table(spark, d, "conversations").select("conv_id", "turn", "role"), ["conv_id"], ["turn"], "role")


@query("""with s as (select "day", avg(value) as v, count(*) as c from (select cast(ts as date) as "day", value from events) group by 1), r as (select *, row_number() over (order by "day") - 1 as r, count(*) over () as n from s),
b as (select *, ((r + 1) * least(n, 12) - 1) // n as bucket from r) select bucket::bigint as bucket, list_sort(list("day"))[len(list("day")) // 2 + 1] as "day", round(avg(v), 9) as v, sum(c)::bigint as c from b group by 1""")
def p11_downsample(spark, d):
    s = table(spark, d, "events").groupBy(F.to_date("ts").alias("day")).agg(F.avg("value").alias("v"), F.count(F.lit(1)).alias("c"))
    return r9(relational.downsample(s, "day", 12, ["v"], ["c"]), "v")


@query("select c_custkey, c_name, c_acctbal from customer where c_acctbal > 0 order by c_mktsegment = 'BUILDING' desc, c_acctbal desc nulls last, c_custkey limit 20 offset 20")
def o1_o3_page(spark, d):
    c = table(spark, d, "customer").where("c_acctbal > 0")
    order = relational.choose("segment", {"segment": lambda: [(F.col("c_mktsegment") == "BUILDING").desc(), F.col("c_acctbal").desc_nulls_last(), F.col("c_custkey").asc()]})
    return relational.page(c, order, 20, 20).select("c_custkey", "c_name", "c_acctbal")


@query("select l_orderkey, l_linenumber, l_extendedprice from lineitem order by l_extendedprice desc, l_orderkey, l_linenumber limit 10")
def o4_top_k(spark, d):
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice").orderBy(F.desc("l_extendedprice"), "l_orderkey", "l_linenumber").limit(10)


@query("select conv_id, turn, role from conversations where (conv_id, turn) > (20, 1) order by conv_id, turn limit 10")
def f9_keyset(spark, d):
    return relational.after(table(spark, d, "conversations").select("conv_id", "turn", "role"), ["conv_id", "turn"], (20, 1), 10)


@query("select c_custkey, c_name from customer where c_name ilike '%00#_01%' or c_name ilike '%#0000001%' order by starts_with(lower(c_name), '#0000001') desc, c_name, c_custkey limit 20")
def f5_f6_search(spark, d):
    c = table(spark, d, "customer").select("c_custkey", "c_name")
    return relational.search(c, "#0000001", "c_custkey", "c_name")


@query("select count(*)::bigint as n, count(*) filter (where compliant)::bigint as yes, count(*) filter (where not compliant)::bigint as no_, count(*) filter (where compliant is null)::bigint as open_ from (select case when l_returnflag = 'R' then l_quantity < 25 end as compliant from lineitem)")
def f10_three_valued(spark, d):
    c = F.when(F.col("l_returnflag") == "R", F.col("l_quantity") < 25)
    return table(spark, d, "lineitem").select(c.alias("c")).agg(F.count(F.lit(1)).alias("n"), F.count_if("c").alias("yes"), F.count_if(~F.col("c")).alias("no_"), F.count_if(F.col("c").isNull()).alias("open_"))


@query("""with a as (select c_mktsegment as slug, count(*)::varchar as n, max(c_nationkey)::varchar as top from customer where c_acctbal > 3000 and c_mktsegment <> 'MACHINERY' group by 1), b as (select c_mktsegment as slug, count(*)::varchar as n, max(c_nationkey)::varchar as top from customer where c_acctbal < 6000 and c_mktsegment <> 'BUILDING' group by 1)
select slug, 'vanished' as change, null::varchar as metric, null::varchar as before, null::varchar as after from a where slug not in (select slug from b) union all select slug, 'appeared', null, null, null from b where slug not in (select slug from a)
union all select slug, 'changed', 'n', a.n, b.n from a join b using (slug) where a.n is distinct from b.n union all select slug, 'changed', 'top', a.top, b.top from a join b using (slug) where a.top is distinct from b.top""")
def x3_diff(spark, d):
    c = table(spark, d, "customer")
    board = lambda df: df.groupBy(F.col("c_mktsegment").alias("slug")).agg(F.count(F.lit(1)).alias("n"), F.max("c_nationkey").alias("top"))
    return compare.diff(board(c.where("c_acctbal > 3000 and c_mktsegment <> 'MACHINERY'")), board(c.where("c_acctbal < 6000 and c_mktsegment <> 'BUILDING'")), "slug", ["n", "top"])


@query("select 'k' as kind, n_name as slug from nation where n_nationkey % 3 <> 0 and n_nationkey % 4 <> 1")
def x4_unresolved(spark, d):
    n = table(spark, d, "nation").select(F.lit("k").alias("kind"), F.col("n_name").alias("slug"), "n_nationkey")
    live = n.where("n_nationkey % 3 = 0").select("kind", "slug")
    some = table(spark, d, "nation").where("n_nationkey = 0").select(F.col("n_name").alias("new_slug"))
    alias = n.where("n_nationkey % 4 = 1").select("kind", F.col("slug").alias("old_slug")).crossJoin(F.broadcast(some))  # one row
    return compare.unresolved_slugs(n, live, alias)


@query("select o_custkey as k from orders where o_orderstatus = 'F' except select o_custkey from orders where o_orderstatus = 'O'")
def x_except(spark, d):
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("k"), "o_orderstatus")
    return o.where("o_orderstatus = 'F'").select("k").subtract(o.where("o_orderstatus = 'O'").select("k"))


@query("select c_nationkey as k from customer union select s_nationkey from supplier where s_acctbal > 9000")
def x2_union(spark, d):
    return table(spark, d, "customer").select(F.col("c_nationkey").alias("k")).union(table(spark, d, "supplier").where("s_acctbal > 9000").select("s_nationkey")).distinct()


# ------------------------------------------------------------------ aggregates
@query("select p_brand, stddev_samp(p_size) is null as lone, round(stddev_samp(p_size), 9) as sd, round(quantile_cont(p_retailprice, 0.25), 9) as q25, round(quantile_cont(case when p_size > 25 then p_retailprice end, 0.5), 9) as big_median, count(distinct p_type)::bigint as types, list_sort(list(distinct p_size)) as sizes from part group by 1")
def a3_a4_a9_stats(spark, d):
    p = table(spark, d, "part")
    out = p.groupBy("p_brand").agg(F.stddev_samp("p_size").alias("sd"), F.percentile("p_retailprice", 0.25).alias("q25"), F.percentile(F.when(F.col("p_size") > 25, F.col("p_retailprice")), 0.5).alias("big_median"), F.count_distinct("p_type").alias("types"), F.sort_array(F.collect_set("p_size")).alias("sizes"))
    return r9(out.withColumn("lone", F.col("sd").isNull()), "sd", "q25", "big_median")


@query("select quality, count(*)::bigint as cases, count(*) filter (where toxic = 1)::bigint as toxic_n, round((count(*) filter (where toxic = 0) + 0.5 * count(*) filter (where toxic = 1))::double / count(*), 9) as accuracy from labels group by 1 union all select null, count(*), count(*) filter (where toxic = 1), round((count(*) filter (where toxic = 0) + 0.5 * count(*) filter (where toxic = 1))::double / count(*), 9) from labels")
def a17_accuracy(spark, d):
    """Weighted accuracy by class, and over all."""
    n = F.count(F.lit(1))
    cols = [n.alias("cases"), F.count_if(F.col("toxic") == 1).alias("toxic_n"), ((F.count_if(F.col("toxic") == 0) + 0.5 * F.count_if(F.col("toxic") == 1)) / n).alias("accuracy")]
    t = table(spark, d, "labels")
    return r9(t.groupBy("quality").agg(*cols).unionByName(t.agg(F.lit(None).cast("int").alias("quality"), *cols)), "accuracy")


@query("""with v as (select o_custkey, o_orderpriority as source, cast(date_trunc('year', o_orderdate) as date) as v from orders) select o_custkey, count(distinct v)::bigint as values_n, string_agg(distinct source || '=' || v::varchar, '; ' order by source || '=' || v::varchar) as claims from v group by 1 having count(distinct v) > 1""")
def a21_set_conflicts(spark, d):
    o = table(spark, d, "orders").select("o_custkey", F.col("o_orderpriority").alias("source"), F.date_format("o_orderdate", "yyyy").alias("text"))
    return compare.set_conflicts(o, "o_custkey", dates.parse_date_loose(F.col("text")))


@query("select o_orderstatus, extract(year from o_orderdate)::integer as y, grouping(o_orderstatus)::integer + grouping(extract(year from o_orderdate))::integer as g, count(*)::bigint as n from orders group by cube (o_orderstatus, extract(year from o_orderdate))")
def a_cube(spark, d):
    o = table(spark, d, "orders").select("o_orderstatus", F.year("o_orderdate").alias("y"))
    return o.cube("o_orderstatus", "y").agg((F.grouping("o_orderstatus") + F.grouping("y")).cast("int").alias("g"), F.count(F.lit(1)).alias("n"))


@query("""with s as (select *, case when ts - lag(ts) over (partition by user_id order by ts, event_id) <= interval 6 hour then 0 else 1 end as new_ from events), g as (select *, sum(new_) over (partition by user_id order by ts, event_id) as g from s)
select user_id, min(ts) as first_ts, count(*)::bigint as n from g group by user_id, g""")
def st6_sessions(spark, d):
    """Runs of events at most six hours apart, by lag and a running sum. (session_window closes a gap of exactly six hours.)"""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = table(spark, d, "events").withColumn("p", F.lag("ts").over(w)).withColumn("nw", F.when(F.col("ts") <= F.expr("p + interval 6 hour"), 0).otherwise(1)).withColumn("g", F.sum("nw").over(w))
    return e.groupBy("user_id", "g").agg(F.min("ts").alias("first_ts"), F.count(F.lit(1)).alias("n")).drop("g")


@query("select user_id, rank() over (partition by user_id % 10 order by c desc) ::integer as rnk, dense_rank() over (partition by user_id % 10 order by c desc)::integer as drnk, ntile(4) over (partition by user_id % 10 order by c desc, user_id)::integer as tile, lead(user_id) over (partition by user_id % 10 order by c desc, user_id) as next_user from (select user_id, count(*) as c from events group by 1)")
def w_ranks(spark, d):
    c = table(spark, d, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("c"))
    a, b = Window.partitionBy(F.col("user_id") % 10).orderBy(F.desc("c")), Window.partitionBy(F.col("user_id") % 10).orderBy(F.desc("c"), "user_id")
    return c.select("user_id", F.rank().over(a).alias("rnk"), F.dense_rank().over(a).alias("drnk"), F.ntile(4).over(b).alias("tile"), F.lead("user_id").over(b).alias("next_user"))


# ------------------------------------------------------------------ mutations
_HALVES = "old as (select o_custkey as k, max(o_totalprice) as price, min(o_orderkey) as ref from orders where o_orderdate < timestamp '1998-06-01' group by 1), new as (select o_custkey as k, max(o_totalprice) as price, min(o_orderkey) as ref from orders where o_orderdate >= timestamp '1998-06-01' and o_orderstatus <> 'F' group by 1)"


def _halves(spark, d) -> tuple[DataFrame, DataFrame]:
    o = table(spark, d, "orders")
    agg = lambda df: df.groupBy(F.col("o_custkey").alias("k")).agg(F.max("o_totalprice").alias("price"), F.min("o_orderkey").alias("ref"))
    return agg(o.where("o_orderdate < timestamp_ntz '1998-06-01'")), agg(o.where("o_orderdate >= timestamp_ntz '1998-06-01' and o_orderstatus <> 'F'"))


@query(f"with {_HALVES} select * from old union all select * from new where k not in (select k from old)")
def u1_insert_ignore(spark, d):
    return mutations.insert_ignore(*_halves(spark, d), ["k"])


@query(f"with {_HALVES} select old.k, old.price, coalesce(new.ref, old.ref) as ref from old left join new using (k) union all select * from new where k not in (select k from old)")
def u2_insert_or_touch(spark, d):
    return mutations.insert_or_touch(*_halves(spark, d), ["k"], "ref")


@query(f"with {_HALVES} select k, coalesce(new.price, old.price) as price, coalesce(old.ref, new.ref) as ref from old full join new using (k)")
def u3_upsert(spark, d):
    return mutations.upsert(*_halves(spark, d), ["k"], {"price": "new_or_old", "ref": "old_or_new"})


@query(f"with {_HALVES} select k, 'inserted' as event, ref from new where k not in (select k from old)")
def u4_insert_log(spark, d):
    return mutations.insert_with_log(*_halves(spark, d), ["k"], [F.col("k"), F.lit("inserted").alias("event"), F.col("ref")])[1]


@query(f"with {_HALVES} select old.k, coalesce(new.price, old.price) as price, old.ref from old left join new using (k)")
def u5_update_from(spark, d):
    return mutations.update_from(*_halves(spark, d), ["k"], ["price"])


@query("""with child as (select distinct user_id as satellite_id, event_type as id_type from events), moved as (select case when satellite_id % 10 = 9 then satellite_id - 9 else satellite_id end as satellite_id, id_type from child) select distinct satellite_id, id_type from moved""")
def u6_merge(spark, d):
    """Users ending in 9 fold into those ending in 8, these into ...0: chains are followed, colliding rows go."""
    child = table(spark, d, "events").select(F.col("user_id").alias("satellite_id"), F.col("event_type").alias("id_type")).distinct()
    ids = child.select("satellite_id").distinct().where("satellite_id % 10 = 9")
    pairs = ids.select(F.col("satellite_id").alias("merged_id"), (F.col("satellite_id") - 9).alias("surviving_id"))
    return mutations.merge_entities(child, mutations.resolve_chains(pairs), ["satellite_id", "id_type"])


@query(f"with {_HALVES} select k, price, ref, case when k not in (select k from new) then date '2001-08-01' end as valid_to from old")
def u8_expire(spark, d):
    old, new = _halves(spark, d)
    return mutations.expire(old.withColumn("valid_to", F.lit(None).cast("date")), new, ["k"], _AS_OF)[0]


@query("select c_custkey as k, (row_number() over (order by c_acctbal desc, c_custkey) + (select max(s_suppkey) from supplier))::bigint as satellite_id from customer")
def dm4_surrogate_ids(spark, d):
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("satellite_id"))
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("k"), "c_acctbal")
    return mutations.with_ids(s, c, "satellite_id", [F.desc("c_acctbal"), F.asc("k")]).select("k", "satellite_id")


# ------------------------------------------------------------------ scalars
@query("""select event_id, round(pow(398600.4418 / pow((1 + value / 10) * 2 * pi() / 86400.0, 2), 1.0 / 3.0), 6) as sma from events where value > 0""")
def m1_semi_major_axis(spark, d):
    e = table(spark, d, "events").where("value > 0")
    return e.select("event_id", F.round(orbit.semi_major_axis(1 + F.col("value") / 10), 6).alias("sma"))


@query("select p_partkey, trim(regexp_replace(regexp_replace(lower(p_name), '[^a-z0-9 ]+', ' ', 'g'), ' +', ' ', 'g')) as norm, trim(regexp_replace(lower(p_type), '[^a-z0-9]+', '-', 'g'), '-') as slug from part")
def t1_t7_names(spark, d):
    return table(spark, d, "part").select("p_partkey", names.norm_name(F.col("p_name")).alias("norm"), names.slugify(F.col("p_type")).alias("slug"))


@query("select o_orderkey, cast(o_orderdate as date) as d_iso, cast(date_trunc('month', o_orderdate) as date) as d_month, cast(cast(o_orderdate as date) + interval 60 month as date) as plus5, strftime(o_orderdate, '%Y-%m') as ym, (extract(year from o_orderdate)::integer // 10 * 10)::integer as dec from orders")
def d1_d8_dates(spark, d):
    o = table(spark, d, "orders")
    iso, ym = F.date_format("o_orderdate", "yyyy-MM-dd"), F.date_format("o_orderdate", "yyyy MMM")
    return o.select("o_orderkey", dates.parse_date_loose(iso).alias("d_iso"), dates.parse_date_loose(ym).alias("d_month"), dates.plus_years(F.to_date("o_orderdate"), 5).alias("plus5"), dates.month_key(F.col("o_orderdate")).alias("ym"), dates.decade(F.col("o_orderdate")).alias("dec"))


@query("select event_id, json_extract_string(props, '$.k')::bigint as k from events where json_extract_string(props, '$.k') is not null")
def q2_json(spark, d):
    return table(spark, d, "events").select("event_id", F.try_to_number(F.get_json_object("props", "$.k"), F.lit("999999999999")).cast("long").alias("k")).where("k is not null")


@query("select user_id, round(regr_slope(value, x), 9) as slope, round(regr_intercept(value, x), 9) as intercept, round(quantile_cont(value, 0.5) - 8 * stddev_pop(value), 9) as threshold from (select user_id, value, date_diff('day', date '2024-01-01', cast(ts as date))::double as x from events) group by 1")
def m10_m11_detrend(spark, d):
    e = table(spark, d, "events").select("user_id", "value", F.datediff(F.to_date("ts"), F.lit(dt.date(2024, 1, 1))).cast("double").alias("x"))
    return r9(e.groupBy("user_id").agg(F.regr_slope("value", "x").alias("slope"), F.regr_intercept("value", "x").alias("intercept"), (F.percentile("value", 0.5) - 8 * F.stddev_pop("value")).alias("threshold")), "slope", "intercept", "threshold")


# ------------------------------------------------------------------ more programs
@query("""with own as (select o_custkey as satellite_id, min(o_orderkey) as sk from orders group by 1), st as (select o_custkey as satellite_id, o_orderstatus as s from (select *, row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey) as rn from orders) where rn = 1),
life as (select o_custkey as satellite_id, min(cast(o_orderdate as date)) as l, max(cast(o_orderdate as date)) as d from orders group by 1)
select c_custkey as satellite_id, c_mktsegment as product, n_name as maker, case s when 'O' then 'ACTIVE' when 'F' then 'DECAYED' else 'UNKNOWN' end as canonical_status, case when s = 'F' and d >= l then (d - l)::integer end as lifetime_days, sk is not null as has_source
from customer left join nation on n_nationkey = c_nationkey left join own on own.satellite_id = c_custkey left join st on st.satellite_id = c_custkey left join life on life.satellite_id = c_custkey""")
def v13_entity_products(spark, d):
    """One row per entity: product, maker, newest status and the lifetime of what has decayed."""
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("k"), "o_orderkey", "o_orderstatus", F.to_date("o_orderdate").alias("on"), "o_orderdate")
    st = relational.latest_per_key(o, ["k"], [F.desc("o_orderdate"), F.asc("o_orderkey")]).select("k", F.when(F.col("o_orderstatus") == "O", "ACTIVE").when(F.col("o_orderstatus") == "F", "DECAYED").otherwise("UNKNOWN").alias("s"))
    life = o.groupBy("k").agg(F.min("on").alias("l"), F.max("on").alias("d"), F.min("o_orderkey").alias("sk"))
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.col("c_mktsegment").alias("product"), F.col("c_nationkey").alias("n_nationkey"))
    j = c.join(table(spark, d, "nation").select("n_nationkey", F.col("n_name").alias("maker")), "n_nationkey", "left").join(st, "k", "left").join(life, "k", "left")
    return j.select(F.col("k").alias("satellite_id"), "product", "maker", F.coalesce("s", F.lit("UNKNOWN")).alias("canonical_status"), dates.lifetime_days(F.col("s"), F.col("l"), F.col("d")).alias("lifetime_days"), F.col("sk").isNotNull().alias("has_source"))


@query("""with p as (select item_id, string_split(text, ' ') as w from benchmark) select item_id, len(w)::integer as words, regexp_matches(' ' || array_to_string(w, ' ') || ' ', '[^0-9.]' || '12' || '[^0-9.]') as supported from p""")
def v34_support(spark, d):
    """Whether a number stands on a page as a token of its own."""
    b = table(spark, d, "benchmark")
    return b.select("item_id", F.size(F.split("text", " ")).alias("words"), text.page_supports_text(F.col("text"), F.lit("12")).alias("supported"))


@query("""select stratum, c_custkey, c_acctbal from (select case when c_acctbal < 0 then 'negative' when c_acctbal > 9000 then 'high' else 'plain' end as stratum, c_custkey, c_acctbal, row_number() over (partition by case when c_acctbal < 0 then 'negative' when c_acctbal > 9000 then 'high' else 'plain' end order by c_acctbal, c_custkey) as rn from customer) where rn <= 12""")
def v35_strata(spark, d):
    """The first cases of each stratum, in a total order."""
    c = table(spark, d, "customer").select("c_custkey", "c_acctbal", F.when(F.col("c_acctbal") < 0, "negative").when(F.col("c_acctbal") > 9000, "high").otherwise("plain").alias("stratum"))
    w = Window.partitionBy("stratum").orderBy("c_acctbal", "c_custkey")
    return c.withColumn("rn", F.row_number().over(w)).where("rn <= 12").select("stratum", "c_custkey", "c_acctbal")


@query("""select count(*)::bigint as entities, round(100.0 * count(o.k) / count(*), 1)::double as owner_pct, round(100.0 * count(s.k) / count(*), 1)::double as status_pct, 100.0::double as launch_pct from customer left join (select distinct o_custkey as k from orders where o_orderstatus = 'O') o on o.k = c_custkey left join (select distinct o_custkey as k from orders) s on s.k = c_custkey""")
def v37_coverage(spark, d):
    o = table(spark, d, "orders")
    sat = table(spark, d, "customer").select(F.col("c_custkey").alias("satellite_id"), F.lit(_AS_OF).alias("launch_date"))
    own = o.where("o_orderstatus = 'O'").select(F.col("o_custkey").alias("satellite_id"), F.lit(None).cast("date").alias("valid_to"))
    return reports.coverage(sat, own, o.select(F.col("o_custkey").alias("satellite_id"))).select("entities", *(F.round(c, 1).alias(c) for c in ("owner_pct", "status_pct", "launch_pct")))


@query("""with c as (select o_custkey as satellite_id, o_orderpriority as source, strftime(o_orderdate, '%Y-%m-%d') as v from orders), p as (select satellite_id, source || '=' || v as s, v from c) select satellite_id, count(distinct v)::bigint as values_n, string_agg(distinct s, '; ' order by s) as claims from p group by 1 having count(distinct v) > 1""")
def v37_date_conflicts(spark, d):
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("satellite_id"), F.col("o_orderpriority").alias("source"), F.lit("decay_date").alias("attribute"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("value"))
    return reports.date_conflicts(o)


@query(f"""with {_DAILY}, m as (select *, max("day") over (partition by user_id) as mx from daily), p as (select user_id, avg(value_avg) filter (where "day" > mx - 14) as ra, avg(value_avg) filter (where "day" <= mx - 14 and "day" > mx - 28) as ba from m group by 1)
select case when user_id % 7 = 0 then 'deorbited' when ra between 45 and 55 then 'at_shell' when ra > ba then 'raising' else 'other' end as state, count(*)::bigint as n from p group by 1""")
def v39_milestone(spark, d):
    """Where a fleet stands against its shell, in parts that add up."""
    days = events_daily(spark, d)
    m = metrics.milestone(days, "user_id", 45.0, 55.0)
    state = F.when(F.col("user_id") % 7 == 0, "deorbited").otherwise(F.col("state"))
    return m.groupBy(state.alias("state")).agg(F.count(F.lit(1)).alias("n"))


@query(f"""with {_DAILY}, m as (select *, max("day") over (partition by user_id) as mx from daily), p as (select user_id, avg(value_avg) filter (where "day" > mx - 14) as ra, avg(value_avg) filter (where "day" <= mx - 14 and "day" > mx - 28) as ba from m group by 1),
s as (select case when user_id % 7 = 0 then 'deorbited' when ra between 45 and 55 then 'at_shell' when ra > ba then 'raising' else 'other' end as state from p)
select count(*)::bigint as deployed, count(*) filter (where state = 'at_shell')::bigint as at_shell, count(*) filter (where state = 'raising')::bigint as raising, count(*) filter (where state = 'other')::bigint as other, count(*) filter (where state = 'deorbited')::bigint as deorbited from s""")
def v38_deployment(spark, d):
    m = metrics.milestone(events_daily(spark, d), "user_id", 45.0, 55.0)
    status = m.select(F.col("user_id").alias("satellite_id"), F.when(F.col("user_id") % 7 == 0, "DECAYED").otherwise("ACTIVE").alias("canonical_status"))
    return reports.deployment_partition(m, status, "user_id")


@query("""with l as (select user_id, value from (select *, row_number() over (partition by user_id order by ts desc, event_id) as rn from events) where rn = 1) select 'op' || (user_id % 5) as operator, count(*)::bigint as n, round(avg(value), 9) as avg_alt_km from l where value < 60 and user_id % 2 = 0 group by 1""")
def v38_lingering(spark, d):
    last = metrics.latest_elements(table(spark, d, "events"), "user_id", "ts", "event_id").select(F.col("user_id").alias("norad_id"), F.col("value").alias("perigee_km"), F.col("value").alias("apogee_km"))
    status = last.where("norad_id % 2 = 0").select("norad_id", F.lit("INACTIVE").alias("canonical_status"), F.concat(F.lit("op"), (F.col("norad_id") % 5).cast("string")).alias("operator"))
    return r9(reports.lingering(last, status, below=60.0), "avg_alt_km")


def _elements(spark, d) -> DataFrame:
    """Element sets made from the newest event of each user."""
    e = metrics.latest_elements(table(spark, d, "events"), "user_id", "ts", "event_id")
    k = F.col("user_id")
    return e.select(k.alias("norad_id"), F.lit(dt.datetime(2024, 1, 30)).alias("epoch"), (F.lit(15.0) + (k % 10) / 20).alias("mean_motion"), ((k % 7) / 1000.0).alias("eccentricity"), (F.lit(40.0) + k % 60).cast("double").alias("inclination"), (k * 37 % 360).cast("double").alias("ra_of_asc_node"), (k * 11 % 360).cast("double").alias("arg_of_pericenter"), (k * 73 % 360).cast("double").alias("mean_anomaly"), (k % 5 / 100000).cast("double").alias("bstar"))


@query(None)
def v40_visible(spark, d):
    """Where every object stands over a place, below the horizon too. Propagation has no SQL."""
    return propagate.visible_now(_elements(spark, d), dt.datetime(2024, 1, 30, 6), 52.0, 13.0, min_elevation=-90.0)


@query(None)
def v40_passes(spark, d):
    return propagate.passes(_elements(spark, d), dt.datetime(2024, 1, 30), 6, 52.0, 13.0, step_s=60)


@query("""select n_nationkey::bigint as operator_id, n_name as canonical_name, count(*)::bigint as fleet_total, count(*) filter (where s <> 'F' or s is null)::bigint as fleet_on_orbit, count(*) filter (where s = 'O')::bigint as fleet_active from customer join nation on n_nationkey = c_nationkey
left join (select o_custkey, o_orderstatus as s from (select *, row_number() over (partition by o_custkey order by o_orderdate desc, o_orderpriority, o_orderkey) as rn from orders) where rn = 1) on o_custkey = c_custkey group by 1, 2 order by fleet_total desc, operator_id limit 10""")
def v42_league(spark, d):
    from .api import Engine

    own = table(spark, d, "customer").select(F.col("c_custkey").alias("satellite_id"), F.col("c_nationkey").cast("long").alias("operator_id"), F.lit(None).cast("date").alias("valid_to"))
    status = table(spark, d, "orders").select(F.col("o_custkey").alias("satellite_id"), F.when(F.col("o_orderstatus") == "F", "DECAYED").when(F.col("o_orderstatus") == "O", "ACTIVE").otherwise("INACTIVE").alias("canonical_status"), F.col("o_orderdate").alias("observed_at"), F.concat("o_orderpriority", F.lpad(F.col("o_orderkey").cast("string"), 12, "0")).alias("source"))
    ops = table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("operator_id"), F.col("n_name").alias("canonical_name"), F.lit(None).cast("long").alias("parent_id"))
    return Engine({"satellite_operator": own, "status": status, "operator": ops, "elements": own}).query("operators", limit=10).select("operator_id", "canonical_name", "fleet_total", "fleet_on_orbit", "fleet_active")


@query("select case_type, count(*)::bigint as labelled, count(*) filter (where verdict in ('correct', 'partial', 'incorrect'))::bigint as gradable, round((count(*) filter (where verdict = 'correct') + 0.5 * count(*) filter (where verdict = 'partial'))::double / nullif(count(*) filter (where verdict in ('correct', 'partial', 'incorrect')), 0), 9) as accuracy from (select o_orderpriority as case_type, case o_orderstatus when 'O' then 'correct' when 'F' then 'incorrect' else 'partial' end as verdict from orders) group by rollup (case_type)".replace("select case_type,", "select coalesce(case_type, 'all') as case_type,"))
def v45_verdicts(spark, d):
    from .api import Engine

    cases = table(spark, d, "orders").select(F.col("o_orderpriority").alias("case_type"), F.when(F.col("o_orderstatus") == "O", "correct").when(F.col("o_orderstatus") == "F", "incorrect").otherwise("partial").alias("verdict"))
    return r9(Engine({"gold_case": cases, "elements": cases}).query("verdicts"), "accuracy")


@query(f"""with {_DAILY}, r as (select *, row_number() over (partition by user_id order by "day") as r from daily), b as (select user_id, quantile_cont(value_avg, 0.5) - 1 * greatest(stddev_pop(value_avg), 0.02) as lim from r where r <= 8 group by 1),
j as (select r.*, lim, sum(case when value_avg < lim then 1 else 0 end) over (partition by user_id order by "day" rows between current row and 2 following) as low from r join b using (user_id)) select user_id, min("day") as departed from j where r > 8 and low >= 2 and value_avg < lim group by 1""")
def v47_departures(spark, d):
    """First day that a series leaves its early level for good."""
    return reports.departures(events_daily(spark, d), "user_id", "day", "value_avg", base=8, sigmas=1.0, of=3, least=2)


@query("""with s as (select o_custkey as k, strftime(o_orderdate, '%Y-%m') as ym, o_totalprice as p from orders) select ym as "month", 'orders' as kind, k::varchar as slug, count(*)::bigint as n from s where ym = '1998-03' group by all""")
def u9_freeze(spark, d):
    live = table(spark, d, "orders").where(dates.month_key(F.col("o_orderdate")) == "1998-03").groupBy(F.col("o_custkey").cast("string").alias("slug")).agg(F.count(F.lit(1)).alias("n"))
    none = spark.createDataFrame([], "month string, kind string, slug string, payload string")
    out = mutations.freeze_month(none, live, "1998-03", "orders")
    return out.select("month", "kind", "slug", F.get_json_object("payload", "$.n").cast("long").alias("n"))


@query("""select l_orderkey as file, l_linenumber::bigint as idx, 'quantity' as attribute, l_quantity as value from lineitem union all select l_orderkey, l_linenumber, 'tax', l_tax from lineitem where l_tax > 0.01""")
def p6_unpivot(spark, d):
    """Wide rows to long claims; a null is no claim."""
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", F.when(F.col("l_tax") > 0.01, F.col("l_tax")).alias("l_tax"))
    long = relational.unpivot(li, ["l_orderkey", "l_linenumber"], {"quantity": "l_quantity", "tax": "l_tax"})
    return long.select(F.col("l_orderkey").alias("file"), F.col("l_linenumber").cast("long").alias("idx"), "attribute", F.col("value").cast("double").alias("value"))


@query("select p_partkey, pos::integer as pos, tok from (select p_partkey, unnest(string_split(p_name, ' ')) as tok, generate_subscripts(string_split(p_name, ' '), 1) as pos from part)")
def p8_ordinal(spark, d):
    return table(spark, d, "part").select("p_partkey", F.posexplode(F.split("p_name", " ")).alias("p", "tok")).select("p_partkey", (F.col("p") + 1).alias("pos"), "tok")


@query("select c_custkey, case when c_acctbal < 0 then 'low' when c_acctbal < 5000 then 'mid' else 'high' end as band, coalesce(nullif(c_mktsegment, 'MACHINERY'), 'other') as segment, c_acctbal between 0 and 100 as near_zero from customer")
def p3_p5_case(spark, d):
    b = F.col("c_acctbal")
    return table(spark, d, "customer").select("c_custkey", F.when(b < 0, "low").when(b < 5000, "mid").otherwise("high").alias("band"), F.coalesce(F.nullif(F.col("c_mktsegment"), F.lit("MACHINERY")), F.lit("other")).alias("segment"), b.between(0, 100).alias("near_zero"))


@query("select c_custkey from customer where c_nationkey in (1, 5, 7) and c_acctbal between 0 and 5000 and not (c_mktsegment is not distinct from 'BUILDING') and regexp_matches(c_name, '[02468]$')")
def f3_f7_filters(spark, d):
    c = table(spark, d, "customer")
    return c.where(F.col("c_nationkey").isin(1, 5, 7) & F.col("c_acctbal").between(0, 5000) & ~F.col("c_mktsegment").eqNullSafe("BUILDING") & F.col("c_name").rlike("[02468]$")).select("c_custkey")


@query("select user_id, count(*)::bigint as n from events where ts >= timestamp '2024-01-20' group by 1 having count(*) > 20")
def f11_having(spark, d):
    return table(spark, d, "events").where("ts >= timestamp_ntz '2024-01-20'").groupBy("user_id").agg(F.count(F.lit(1)).alias("n")).where("n > 20")


@query("with o as (select c_nationkey as parent, s_suppkey as child from customer join supplier on s_suppkey = c_custkey), e as (select distinct parent as org from o where parent < 5 union select child from o where parent < 5) select org::bigint as org from e")
def j17_expanded_orgs(spark, d):
    """An organisation and its children, one step down."""
    o = table(spark, d, "customer").join(table(spark, d, "supplier").select("s_suppkey"), F.col("s_suppkey") == F.col("c_custkey")).where("c_nationkey < 5")
    return o.select(F.col("c_nationkey").cast("long").alias("org")).union(o.select("s_suppkey")).distinct()


@query("with a as (select o_custkey as k, o_orderstatus as v from (select *, row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey) rn from orders where o_orderkey % 2 = 0) where rn = 1), b as (select o_custkey as k, o_orderstatus as v from (select *, row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey) rn from orders where o_orderkey % 2 = 1) where rn = 1) select k, a.v as a_value, b.v as b_value from a join b using (k) where a.v <> b.v")
def j18_two_sources(spark, d):
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("k"), F.col("o_orderstatus").alias("v"), "o_orderdate", "o_orderkey")
    last = lambda df: relational.latest_per_key(df, ["k"], [F.desc("o_orderdate"), F.asc("o_orderkey")]).select("k", "v")
    return compare.two_source_conflicts(last(o.where("o_orderkey % 2 = 0")), last(o.where("o_orderkey % 2 = 1")), "k", "v")


@query(f"""with {_DAILY}, d as (select user_id, "day", value_avg - lag(value_avg) over w as delta, lag("day") over w as pd from daily window w as (partition by user_id order by "day")) select user_id, "day", round(delta, 9) as delta from d where pd = "day" - 1""")
def w2_consecutive(spark, d):
    return r9(relational.consecutive_delta(events_daily(spark, d), "user_id", "day", "value_avg").select("user_id", "day", "delta"), "delta")


@query("""with g as (select user_id, extract(hour from ts)::integer as h, max(value) as v from events group by 1, 2), u as (select *, h - row_number() over (partition by user_id order by h) as isl from g where v > 60) select user_id, min(h)::integer as rise, max(h)::integer as set_, max(v) as peak, count(*)::bigint as n from u group by user_id, isl""")
def w10_segments(spark, d):
    """Contiguous stretches of a grid where a value is high: rise, set and peak."""
    g = table(spark, d, "events").groupBy("user_id", F.hour("ts").alias("h")).agg(F.max("value").alias("v")).where("v > 60")
    isl = g.withColumn("isl", F.col("h") - F.row_number().over(Window.partitionBy("user_id").orderBy("h")))
    return isl.groupBy("user_id", "isl").agg(F.min("h").alias("rise"), F.max("h").alias("set_"), F.max("v").alias("peak"), F.count(F.lit(1)).alias("n")).drop("isl")


@query(None)
def s15_page_facts(spark, d):
    """Links, table cells and visible characters of raw pages."""
    return documents.page_facts(table(spark, d, "pages"), "page_id", "html")


@query("select s_suppkey, case when s_suppkey % 4 = 0 then null else s_suppkey::varchar end as cell, try_cast(case when s_suppkey % 3 = 0 then 'x' || s_suppkey else ' ' || s_suppkey || ' ' end as bigint) as number from supplier")
def s1_s3_cells(spark, d):
    """Missing markers and tolerant casts of text cells."""
    s = table(spark, d, "supplier").select("s_suppkey", F.when(F.col("s_suppkey") % 4 == 0, " - ").otherwise(F.col("s_suppkey").cast("string")).alias("c"), F.when(F.col("s_suppkey") % 3 == 0, F.concat(F.lit("x"), "s_suppkey")).otherwise(F.concat(F.lit(" "), "s_suppkey", F.lit(" "))).alias("n"))
    return s.select("s_suppkey", delimited.missing(F.col("c")).alias("cell"), delimited.typed(F.col("n"), "long").alias("number"))


@query("select o_custkey as ingest_run_id, o_orderkey, o_orderstatus as status from (select *, row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey) rn from orders) where rn = 1")
def dm1_ledger_collapse(spark, d):
    """One row per run from the events appended for it."""
    o = table(spark, d, "orders")
    return relational.latest_per_key(o, ["o_custkey"], [F.desc("o_orderdate"), F.asc("o_orderkey")]).select(F.col("o_custkey").alias("ingest_run_id"), "o_orderkey", F.col("o_orderstatus").alias("status"))


@query("select o_orderkey, o_custkey from orders where o_orderdate = (select max(o_orderdate) from orders where o_orderstatus = 'O') and o_orderstatus = 'O'")
def f1_latest_run(spark, d):
    """Rows of the newest finished run: a scalar first, then a filter by a literal, which prunes."""
    o = table(spark, d, "orders")
    newest = o.where("o_orderstatus = 'O'").agg(F.max("o_orderdate")).first()[0]
    return o.where((F.col("o_orderdate") == F.lit(newest)) & (F.col("o_orderstatus") == "O")).select("o_orderkey", "o_custkey")


@query(f"with {_DAILY} select user_id, \"day\", round(value_avg, 9) as value_avg, n from daily")
def st1_stream_daily(spark, d):
    """The daily rollup as a stream over the same files, run to its end: each trigger's changed days are upserted into a written table,
    which then holds the batch answer."""
    e = table(spark, d, "events")
    stream = rollup.timed(spark.readStream.schema(e.schema).parquet(f"{d}/events.parquet*"), "ts", "60 days")
    out = rollup.run_into_table(rollup.daily(stream, "user_id", "ts", "value"), ["user_id", "day"])
    return r9(out.select("user_id", "day", "value_avg", "n"), "value_avg")


@query("select user_id, ts, event_id, value from (select *, row_number() over (partition by user_id order by ts desc, event_id) as rn from events) where rn = 1")
def st4_stream_latest(spark, d):
    """Latest row per key as a stream, one row of state per key, upserted into a written table."""
    e = table(spark, d, "events")
    stream = spark.readStream.schema(e.schema).parquet(f"{d}/events.parquet*")
    return rollup.run_into_table(rollup.latest(stream, "user_id", "ts", "event_id", ["value"]), ["user_id"])


@query("select p_partkey, nullif(trim(regexp_replace(regexp_replace(lower(p_name), '[^a-z0-9 ]+', ' ', 'g'), ' +', ' ', 'g')), '') as k from part")
def ud1_sql_function(spark, d):
    """A name key by a temporary SQL function, from SQL text."""
    sql_functions.register(spark)
    table(spark, d, "part").createOrReplaceTempView("_ud1_part")
    return spark.sql("select p_partkey, name_key(p_name) as k from _ud1_part")


@query("""with r as (select c_custkey as satellite_id, c_nationkey::bigint as operator_id, 'owner' as role, date '2000-01-01' as valid_from, 'seed' as source from customer where c_acctbal > 5000),
n as (select c_custkey as satellite_id, c_nationkey::bigint as operator_id, 'owner' as role, case when c_acctbal > 9000 then date '2000-01-01' else date '2001-01-01' end as valid_from, 'resolve' as source from customer)
select * from r union all select * from n where not exists (select 1 from r where r.satellite_id = n.satellite_id and r.operator_id = n.operator_id and r.valid_from = n.valid_from)""")
def u10_rebuild_owners(spark, d):
    """Ownership with the resolver's rows replaced, curated rows kept."""
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("satellite_id"), F.col("c_nationkey").cast("long").alias("operator_id"), "c_acctbal")
    row = lambda df, day, source: df.select("satellite_id", "operator_id", F.lit("owner").alias("role"), day.alias("valid_from"), F.lit(None).cast("date").alias("valid_to"), F.lit(source).alias("source"), F.lit(1).cast("decimal(3,2)").alias("confidence"))
    seed = row(c.where("c_acctbal > 5000"), F.lit(dt.date(2000, 1, 1)), "seed")
    old = seed.unionByName(row(c, F.lit(dt.date(1999, 1, 1)), "resolve"))
    new = c.select("satellite_id", "operator_id", F.when(F.col("c_acctbal") > 9000, F.lit(dt.date(2000, 1, 1))).otherwise(F.lit(dt.date(2001, 1, 1))).alias("valid_from"), F.lit(None).cast("date").alias("valid_to"))
    return mutations.rebuild_resolved(old, new).select("satellite_id", "operator_id", "role", "valid_from", "source")


@query(f"with {_DAILY} select user_id, \"day\", round(case when \"day\" >= date '2024-01-23' and \"day\" < date '2024-01-29' then value_avg else 0 end, 9) as value_avg from daily")
def st2_refresh_window(spark, d):
    """Days inside the refresh window computed anew over a stale table, the others left."""
    e = table(spark, d, "events")
    roll = lambda x: metrics.daily(x, "user_id", "ts", "value").select("user_id", "day", "value_avg")
    stale = roll(e).withColumn("value_avg", F.lit(0.0))
    return r9(mutations.refresh_window(stale, e, roll, "ts", dt.datetime(2024, 1, 30, 0, 30)), "value_avg")


@query(f"""with {_DRAG} select "day", median_d from drag where "day" between date '2024-01-30' - 20 and date '2024-01-30' and median_d is not null order by median_d, "day" limit 5""")
def v17_worst_drag(spark, d):
    env = metrics.fleet_drag(events_daily(spark, d), "user_id", 5, 200.0)
    return r9(metrics.drag_selection(env, F.lit(dt.date(2024, 1, 30)), 20)["worst_drag"].select("day", "median_d"), "median_d")


# ------------------------------------------------------------------ single operators
@query("""with e as (select c_custkey as k, lower(regexp_replace(c_name, '[^A-Za-z0-9]+', '-', 'g')) as base, c_mktsegment as code from customer), n as (select *, row_number() over (partition by code order by k) as rn from e)
select code as name, count(*)::bigint as n, min(k) as first_k from n group by 1""")
def a1_a2_groups(spark, d):
    c = table(spark, d, "customer")
    return c.groupBy(F.col("c_mktsegment").alias("name")).agg(F.count(F.lit(1)).alias("n"), F.min("c_custkey").alias("first_k"))


@query("select count(*)::bigint as rows_n, count(distinct o_custkey)::bigint as customers, round(100.0 * count(*) filter (where o_orderstatus = 'O')::double / count(*), 1)::double as open_pct, max(cast(o_orderdate as date)) as newest from orders")
def a16_totals(spark, d):
    o = table(spark, d, "orders")
    n = F.count(F.lit(1))
    return o.agg(n.alias("rows_n"), F.count_distinct("o_custkey").alias("customers"), orbit.percent(F.count_if(F.col("o_orderstatus") == "O"), n).alias("open_pct"), F.max(F.to_date("o_orderdate")).alias("newest"))


@query("""with p as (select c_custkey as k, c_nationkey as n, lower(regexp_replace(c_name, '[^A-Za-z0-9]+', ' ', 'g')) as nm from customer), a as (select s_suppkey as k, s_nationkey as n from supplier)
select p.k as provisional_id, min(a.k) as anchored_id, (min(a.k) % 2 = 0) as merged from p join a on a.n = p.n group by p.k having count(distinct a.k) = 1""")
def j13_shared_designator(spark, d):
    """Provisional entities that share a designator with exactly one anchored one, and the gate's decision."""
    p = table(spark, d, "customer").select(F.col("c_custkey").alias("provisional_id"), F.col("c_nationkey").alias("n"), F.col("c_name").alias("pn"))
    a = table(spark, d, "supplier").select(F.col("s_suppkey").alias("anchored_id"), F.col("s_nationkey").alias("n"))
    one = relational.only_match(p, a, "n", "provisional_id", "anchored_id", F.min("pn").alias("pn"))
    placeholder = F.when(F.col("anchored_id") % 2 == 0, F.lit("X OBJECT A")).otherwise(F.lit("other"))
    return one.select("provisional_id", "anchored_id", names.name_gate(F.col("pn"), placeholder).alias("merged"))


@query("""with x as (select p_partkey, string_split(p_name, ' ') as toks from part), y as (select p_partkey, unnest(toks) as tok, generate_subscripts(toks, 1) as pos, len(toks) as arity from x)
select p_partkey as satellite_id, slug as manufacturer_slug, min(pos)::integer as position, any_value(arity)::integer as arity from (select *, trim(regexp_replace(lower(tok), '[^a-z0-9]+', '-', 'g'), '-') as slug from y) where slug <> '' group by 1, 2""")
def p8_w6_tokens(spark, d):
    """Every co-builder of a part, by slug, at its first place."""
    p = table(spark, d, "part").select("p_partkey", F.split("p_name", " ").alias("t"))
    x = p.select("p_partkey", F.size("t").alias("arity"), F.posexplode("t").alias("pos", "tok")).withColumn("slug", names.slugify(F.col("tok"))).where("slug is not null")
    return x.groupBy(F.col("p_partkey").alias("satellite_id"), F.col("slug").alias("manufacturer_slug")).agg((F.min("pos") + 1).cast("int").alias("position"), F.first("arity").cast("int").alias("arity"))


@query("""with p as (select o_orderkey, o_custkey, cast(o_orderdate as date) as filed, o_totalprice from orders where o_orderstatus = 'O' order by filed desc, o_orderkey limit 50 offset 10),
d as (select o_custkey, count(*)::bigint as docket_n from orders group by 1)
select p.o_orderkey, p.filed, p.o_totalprice, c_name as applicant, docket_n, (o_totalprice > 400000) as implausible from p left join customer on c_custkey = p.o_custkey left join d using (o_custkey)""")
def o5_page_then_enrich(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey", F.to_date("o_orderdate").alias("filed"), "o_totalprice", "o_orderstatus")
    p = relational.page(o.where("o_orderstatus = 'O'"), [F.desc("filed"), F.asc("o_orderkey")], 50, 10)
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_name").alias("applicant"))
    n = o.join(p.select("o_custkey").distinct(), "o_custkey", "left_semi").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("docket_n"))
    return p.join(c, "o_custkey", "left").join(n, "o_custkey", "left").select("o_orderkey", "filed", "o_totalprice", "applicant", "docket_n", (F.col("o_totalprice") > 400000).alias("implausible"))
