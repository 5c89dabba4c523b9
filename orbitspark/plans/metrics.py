"""The metric programs over element sets, ownership and status: each takes frames and returns one.

Column names of the fact side: key (an object), ts or day, value (a length in km). Ownership is joined above the daily
aggregate, so a change of owner never rewrites it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import orbit
from ..functions.dates import plus_years
from ..operators.relational import consecutive_delta, islands, latest_per_key, rolling_stddev, scd2_join


def elements_with_altitudes(elements: DataFrame) -> DataFrame:
    """The derived columns of an element set: semi_major_axis_km, apogee_km, perigee_km."""
    out = elements.withColumn("semi_major_axis_km", orbit.semi_major_axis(F.col("mean_motion")))
    return out.withColumns({"apogee_km": orbit.apogee(F.col("semi_major_axis_km"), F.col("eccentricity")), "perigee_km": orbit.perigee(F.col("semi_major_axis_km"), F.col("eccentricity"))})


def daily(events: DataFrame, key: str, ts: str, value: str) -> DataFrame:
    """key, day, avg, stddev, min, max, n: one partial and one final hash aggregate."""
    return events.groupBy(key, F.to_date(ts).alias("day")).agg(F.avg(value).alias("value_avg"), F.stddev_samp(value).alias("value_stddev"), F.min(value).alias("value_min"), F.max(value).alias("value_max"), F.count(F.lit(1)).alias("n"))


def latest_elements(elements: DataFrame, key: str, ts: str, tie: str) -> DataFrame:
    return latest_per_key(elements, [key], [F.col(ts).desc(), F.col(tie).asc()])


def daily_with_owner(days: DataFrame, ownership: DataFrame, key: str) -> DataFrame:
    return scd2_join(days, ownership, key)


def station_keeping(owned: DataFrame, key: str, window_days: int = 30) -> DataFrame:
    """Rolling deviation of the daily means, by value range of days."""
    return rolling_stddev(owned, key, "day", "value_avg", window_days, "rolling_stddev")


def station_keeping_by_owner(rolled: DataFrame, key: str, owner: list[str]) -> DataFrame:
    """Percentiles over the objects of their median rolling deviation."""
    per = rolled.where("rolling_stddev is not null").groupBy(key, *owner).agg(F.percentile("rolling_stddev", 0.5).alias("m"))
    return per.groupBy(*owner).agg(F.count(F.lit(1)).alias("active_count"), F.percentile("m", 0.5).alias("p50_km"), F.percentile("m", 0.9).alias("p90_km"), F.avg("m").alias("mean_km"))


def latest_station_keeping_by_owner(rolled: DataFrame, key: str, owner: list[str]) -> DataFrame:
    """Each object's newest day, averaged by owner."""
    last = latest_per_key(rolled.where("rolling_stddev is not null"), [key], [F.col("day").desc()])
    return last.groupBy(*owner).agg(F.count(F.lit(1)).alias("active_count"), F.avg("rolling_stddev").alias("avg_rolling_km"))


def density(objects: DataFrame, x: Column, y: Column) -> DataFrame:
    return objects.groupBy(x.alias("x_bin"), y.alias("y_bin")).agg(F.count(F.lit(1)).alias("object_count"))


def exposure(objects: DataFrame, x: Column, y: Column, owner: str) -> DataFrame:
    """How much of each owner's fleet stands in which bin, weighted by the bin's share of all objects."""
    rows = objects.select(x.alias("x_bin"), y.alias("y_bin"), F.col(owner).alias("owner"))
    per = rows.groupBy("x_bin", "y_bin", "owner").agg(F.count(F.lit(1)).alias("owner_count"))
    bins = per.groupBy("x_bin", "y_bin").agg(F.sum("owner_count").alias("bin_count"))
    fleets = per.groupBy("owner").agg(F.sum("owner_count").alias("fleet"))
    total = rows.agg(F.count(F.lit(1)).alias("total"))
    j = per.join(bins, ["x_bin", "y_bin"]).join(fleets, per["owner"].eqNullSafe(fleets["owner"])).drop(fleets["owner"]).crossJoin(F.broadcast(total))  # one row
    j = j.withColumn("bin_share", F.col("bin_count") / F.col("total")).withColumn("owner_weight", F.col("owner_count") / F.col("fleet"))
    return j.withColumn("exposure", F.col("bin_share") * F.col("owner_weight"))


def compliance(last_active: DataFrame, decayed: DataFrame, key: str, as_of: Column, years: int = 5) -> DataFrame:
    """last_active(key, last_active), decayed(key, decay_date) → elapsed_days and compliant: null while the term runs."""
    j = last_active.join(decayed, key, "left")
    limit = plus_years(F.col("last_active"), years)
    verdict = F.when(F.col("decay_date").isNotNull(), F.col("decay_date") <= limit).when(as_of > limit, F.lit(False))
    return j.withColumn("elapsed_days", F.datediff(F.coalesce("decay_date", as_of), "last_active")).withColumn("compliant", verdict)


def time_to_operational(owned: DataFrame, key: str, owner: str, launch: DataFrame, baseline_from: Column, band: float, run: int) -> DataFrame:
    """First day of the first run of `run` days near the owner's median level; key, owner, launch_day, operational_day, days, shell_n.

    The level comes from days from baseline_from on. An object with several owners there meets each one's band, as in the
    reference.
    """
    base = owned.where(F.col("day") >= baseline_from).groupBy(key, owner).agg(F.percentile("value_avg", 0.5).alias("m"))
    shell = base.groupBy(owner).agg(F.percentile("m", 0.5).alias("shell"), F.count(F.lit(1)).alias("shell_n"))
    near = owned.select(key, "day", "value_avg").join(base.select(key, owner), key).join(shell, owner).where(F.abs(F.col("value_avg") - F.col("shell")) <= band)
    runs = islands(near.withColumn("_k", F.struct(key, owner)), "_k", "day").where(F.col("run_length") >= run)
    first = runs.groupBy("_k").agg(F.min("run_start").alias("operational_day")).select(F.col(f"_k.{key}").alias(key), F.col(f"_k.{owner}").alias(owner), "operational_day")
    return first.join(launch, key).join(shell.select(owner, "shell_n"), owner).withColumn("days", F.datediff("operational_day", "launch_day")).select(key, owner, "launch_day", "operational_day", "days", "shell_n")


def operational_by_owner(tto: DataFrame, owner: str, least: int = 3) -> DataFrame:
    return tto.where(F.col("shell_n") >= least).groupBy(owner).agg(F.count(F.lit(1)).alias("n"), F.percentile("days", 0.5).alias("median_days"), F.percentile("days", 0.9).alias("p90_days"))


def attribution_delta(owned: DataFrame, static: DataFrame, key: str, owner: str) -> DataFrame:
    """By month and owner, what the temporal method credits against a fixed owner per object; either side may be missing."""
    month = F.trunc("day", "MM").alias("month")
    t = owned.groupBy(month, owner).agg(F.count_distinct(key).alias("temporal_objects"), F.count(F.lit(1)).alias("temporal_days"), F.avg("value_stddev").alias("temporal_stability"))
    n = owned.select(key, "day", "value_stddev").join(static, key).groupBy(month, owner).agg(F.count_distinct(key).alias("naive_objects"), F.count(F.lit(1)).alias("naive_days"), F.avg("value_stddev").alias("naive_stability"))
    zero = lambda c: F.coalesce(c, F.lit(0))
    return t.join(n, ["month", owner], "full").withColumn("delta_days", zero("temporal_days") - zero("naive_days")).withColumn("delta_objects", zero("temporal_objects") - zero("naive_objects"))


def fleet_drag(days: DataFrame, key: str, least: int, clamp: float) -> DataFrame:
    """By day, percentiles of the objects' change since the day before, in thousandths."""
    d = consecutive_delta(days, key, "day", "value_avg", clamp).withColumn("d", F.col("delta") * 1000)
    return d.groupBy("day").agg(F.count(F.lit(1)).alias("observed"), F.percentile("d", 0.5).alias("median_d"), F.percentile("d", 0.1).alias("p10_d"), F.percentile("d", 0.9).alias("p90_d")).where(F.col("observed") >= least)


def drag_environment(weather: DataFrame, drag: DataFrame) -> DataFrame:
    """Index days and measured days side by side; either may be missing."""
    return weather.join(drag, "day", "full")


def drag_selection(environment: DataFrame, as_of: Column, past: int = 90, ahead: int = 0) -> dict[str, DataFrame]:
    """From one frame: the days asked for (7 to 730 back, 0 to 45 ahead), the newest measured day, and the five worst."""
    past, ahead = max(7, min(730, past)), max(0, min(45, ahead))
    window = environment.where(F.col("day").between(F.date_sub(as_of, past), F.date_add(as_of, ahead)))
    measured = window.where("median_d is not null")
    return {"days": window.orderBy("day"), "latest_observed": measured.orderBy(F.desc("day")).limit(1), "worst_drag": measured.orderBy(F.asc("median_d"), F.asc("day")).limit(5)}


def space_weather(rows: DataFrame) -> DataFrame:
    """One row per day of the rows' (latest run's) three-hour indices: maxima and the storm level."""
    last = latest_per_key(rows, ["sw_date"], [F.col("f107_data_type").asc_nulls_last()])
    kp, ap = F.greatest(*(F.col(f"kp{i}") for i in range(1, 9))), F.greatest(*(F.col(f"ap{i}") for i in range(1, 9)))
    return last.select(F.col("sw_date").alias("day"), "bsrn", (kp / 10).alias("kp_max"), "kp_sum", "ap_avg", ap.alias("ap_max"), "isn", "f107_obs", "f107_adj", "f107_obs_center81", "f107_data_type", orbit.storm_level(kp).alias("storm_level"))


def behaviour(days: DataFrame, rolled: DataFrame, tto: DataFrame, disposal: DataFrame, key: str) -> DataFrame:
    """One row per object: span and number of its days, median deviation, days to operational, disposal verdict."""
    base = days.groupBy(key).agg(F.count(F.lit(1)).alias("gp_days"), F.min("day").alias("first_gp_day"), F.max("day").alias("last_gp_day"))
    keep = rolled.where("rolling_stddev is not null").groupBy(key).agg(F.percentile("rolling_stddev", 0.5).alias("sk_median_km"))
    first = latest_per_key(tto, [key], [F.col("operational_day").asc(), F.col("shell_n").desc()]).select(key, F.col("days").alias("days_to_operational"), F.col("shell_n").alias("tto_shell_n"))
    return base.join(keep, key, "left").join(first, key, "left").join(disposal.select(key, F.col("compliant").alias("disposal_compliant")), key, "left")


def leaderboard(products: DataFrame, slug: str, anchored_only: bool = False) -> DataFrame:
    """The product leaderboard over per-entity rows (status, lifetime_days, sk_km, days_to_operational, shell_n, compliant, gp_days,
    anchored, key_churn). The anchored twin is the same program over fewer rows."""
    rows = products.where("anchored") if anchored_only else products
    n = F.count(F.lit(1))
    share = lambda c, of, p=1: F.round(F.lit(100.0) * c / F.nullif(of, F.lit(0)), p).cast("double")
    count = lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    decayed, tto, sk = F.col("status") == "DECAYED", F.col("days_to_operational").isNotNull() & (F.col("shell_n") >= 3), F.col("sk_km").isNotNull()
    return rows.where(F.col(slug).isNotNull()).groupBy(slug).agg(
        n.alias("fleet_total"), count(~decayed).alias("fleet_on_orbit"), count(F.col("status") == "ACTIVE").alias("fleet_active"), count(decayed).alias("decayed_count"), share(count(decayed), n).alias("decayed_share_pct"),
        count(F.col("lifetime_days").isNotNull()).alias("lifetime_n"), F.percentile(F.col("lifetime_days") / 365.25, 0.5).alias("median_lifetime_years"), count(tto).alias("tto_n"), F.percentile(F.when(tto, F.col("days_to_operational")), 0.5).alias("median_days_to_operational"),
        count(sk).alias("sk_n"), share(count(sk & (F.col("sk_km") < 1)), count(sk)).alias("station_keeping_share_pct"), F.percentile("sk_km", 0.5).alias("p50_station_keeping_km"), count(F.col("compliant").isNotNull()).alias("disposal_n"),
        share(count(F.col("compliant")), count(F.col("compliant").isNotNull())).alias("disposal_compliance_pct"), count(F.col("gp_days") > 0).alias("gp_n"), share(count(F.col("gp_days") > 0), n).alias("gp_coverage_pct"), count(~F.col("anchored")).alias("provisional_n"), count(F.col("key_churn")).alias("key_churn_n"),
    )


def pending(disposition: list[str]) -> Column:
    """Filed, and none of the disposition dates set."""
    out = F.col("date_filed").isNotNull()
    for c in disposition:
        out = out & F.col(c).isNull()
    return out


def dockets(filings: DataFrame, is_pending: Column, is_granted: Column, is_amendment: Column) -> DataFrame:
    return filings.groupBy("callsign").agg(F.count(F.lit(1)).alias("filings_total"), F.count_if(is_pending).alias("filings_pending"), F.count_if(is_granted).alias("filings_granted"), F.count_if(is_pending & is_amendment).alias("pending_amendments"), F.min("date_filed").alias("first_filed"), F.max("date_filed").alias("last_filed"))


def milestone(days: DataFrame, key: str, low: float, high: float, trailing: int = 14) -> DataFrame:
    """Each object's trailing mean against the shell: at_shell, raising or below, from one pass of unordered windows."""
    w = Window.partitionBy(key)
    last = F.max("day").over(w)
    rows = days.withColumn("_last", last).withColumn("recent", F.col("day") > F.date_sub("_last", trailing)).withColumn("before", (F.col("day") <= F.date_sub("_last", trailing)) & (F.col("day") > F.date_sub("_last", 2 * trailing)))
    per = rows.groupBy(key).agg(F.avg(F.when(F.col("recent"), F.col("value_avg"))).alias("recent_avg"), F.avg(F.when(F.col("before"), F.col("value_avg"))).alias("before_avg"))
    return per.withColumn("state", F.when(F.col("recent_avg").between(low, high), "at_shell").when(F.col("recent_avg") > F.col("before_avg"), "raising").otherwise("other"))
