"""Declared schemas of the raw and derived tables, and the checks that Parquet cannot state.

Readers take these instead of inferring; every catalogue id is a long.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

_DDL = {
    "ingest_run": "ingest_run_id long, source string, endpoint string, status string, started_at timestamp, finished_at timestamp, rows_loaded long, detail string",
    "raw_satcat": "object_name string, object_id string, norad_cat_id long, object_type string, ops_status_code string, owner string, launch_date date, launch_site string, decay_date date, period double, inclination double, apogee double, perigee double, rcs double, data_status_code string, orbit_center string, orbit_type string, ingest_run_id long, loaded_at timestamp",
    "raw_gcat_satcat": "jcat string, norad_id long, piece string, object_type string, name string, pl_name string, launch_date string, decay_date string, status string, dest string, owner string, state string, manufacturer string, bus string, mass string, perigee_km double, apogee_km double, inc_deg double, op_orbit string, alt_names string, extra map<string,string>, ingest_run_id long, loaded_at timestamp",
    "raw_gcat_orgs": "code string, ucode string, state_code string, org_type string, org_class string, t_start string, t_stop string, short_name string, name string, e_name string, parent_code string, extra map<string,string>, ingest_run_id long, loaded_at timestamp",
    "gp_elements": "norad_id long, epoch timestamp, mean_motion double, eccentricity double, inclination double, ra_of_asc_node double, arg_of_pericenter double, mean_anomaly double, bstar double, rev_at_epoch long, source string, creation_date timestamp",
    "satellite": "satellite_id long, norad_id long, cospar string, canonical_name string, object_type string, launch_date date, decay_date date, anchor_state string",
    "satellite_identifier": "satellite_id long, id_type string, id_value string, source string, confidence decimal(3,2), valid_from date, valid_to date",
    "satellite_operator": "satellite_id long, operator_id long, role string, valid_from date, valid_to date, source string, confidence decimal(3,2)",
    "source_assertion": "satellite_id long, source_key string, attribute string, value string, source string, observed_at timestamp, ingest_run_id long",
    "merge_log": "satellite_id long, id_type string, id_value string, source string, rule string, score decimal(4,3), details string",
    "identity_event": "satellite_id long, event string, observed_at timestamp, details string",
    "satellite_bus": "satellite_id long, bus_slug string, bus_model string, bus_uncertain boolean, manufacturer_slug string, manufacturer_name string, manufacturer_raw string, manufacturer_codes array<string>, rollup_path array<string>, rollup_source string, join_rule string, key_churn_observed boolean",
    "satellite_manufacturer_credit": "satellite_id long, manufacturer_slug string, position smallint, arity smallint, uncertain boolean",
    "bus_snapshot": "month string, kind string, slug string, payload string",
}

#: By table; readers and createDataFrame take the text as it is.
SCHEMAS: dict[str, str] = dict(_DDL)


class CheckFailed(ValueError):
    """A declared constraint does not hold."""


def assert_domain(df: DataFrame, column: str, values: list) -> DataFrame:
    """df itself, if every non-null value of column is one of values."""
    bad = df.where(F.col(column).isNotNull() & ~F.col(column).isin(*values)).select(column).limit(1).collect()
    if bad:
        raise CheckFailed(f"{column}: {bad[0][0]!r} is not one of {values}")
    return df


def assert_unique(df: DataFrame, keys: list[str]) -> DataFrame:
    """df itself, if no two rows share keys."""
    bad = df.groupBy(*keys).count().where("count > 1").limit(1).collect()
    if bad:
        raise CheckFailed(f"{keys} repeat: {bad[0].asDict()}")
    return df


def assert_that(df: DataFrame, condition, message: str) -> DataFrame:
    """df itself, if condition is not false in any row (a null passes, as with CHECK)."""
    if df.where(~condition).limit(1).collect():
        raise CheckFailed(message)
    return df


def assert_bigint(schema: StructType) -> None:
    """Every column that names a catalogue id is a long."""
    for f in schema:
        if "norad" in f.name and f.dataType.simpleString() != "bigint":
            raise CheckFailed(f"{f.name} is {f.dataType.simpleString()}, not bigint")
