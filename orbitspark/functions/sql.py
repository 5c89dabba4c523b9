"""The scalar functions that SQL text calls by name, as temporary SQL functions: inlined by the optimizer, no Python at run time."""

from __future__ import annotations

from pyspark.sql import SparkSession

FUNCTIONS = {
    "name_key(s string) returns string": r"""nullif(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(s), r'[\(\[\{][^\)\]\}]*[\)\]\}]', ' '), r'(?U)[^\w\s]+', ' '), r'(?<=\p{L})(?=\p{Nd})', ' '), r'(?<=\p{Nd})(?=\p{L})', ' '), r'(?U)\s+', ' ')), '')""",
    "launch_key(s string) returns string": r"""case when s rlike r'^\s*\d{4}[-\s]?\d{1,3}\s*[A-Za-z]{1,3}\s*$' then concat(regexp_extract(s, r'^\s*(\d{4})[-\s]?(\d{1,3})', 1), '-', lpad(regexp_extract(s, r'^\s*(\d{4})[-\s]?(\d{1,3})', 2), 3, '0')) end""",
}


def register(spark: SparkSession) -> None:
    for head, body in FUNCTIONS.items():
        spark.sql(f"create or replace temporary function {head} return {body}")
