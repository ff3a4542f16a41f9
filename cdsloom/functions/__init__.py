"""SQL functions that views may call once they are registered: character dates, calendar arithmetic."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Name, parameters and body: a bad or initial date gives null.
_FUNCTIONS = {
    "dats_add_days": ("d STRING, n INT, on_error STRING", "STRING", "date_format(date_add(CAST(try_to_timestamp(d, 'yyyyMMdd') AS DATE), n), 'yyyyMMdd')"),
    "dats_days_between": ("a STRING, b STRING", "INT", "datediff(CAST(try_to_timestamp(b, 'yyyyMMdd') AS DATE), CAST(try_to_timestamp(a, 'yyyyMMdd') AS DATE))"),
    "dats_is_valid": ("d STRING", "INT", "CASE WHEN try_to_timestamp(d, 'yyyyMMdd') IS NULL THEN 0 ELSE 1 END"),
}


def register(spark: SparkSession) -> None:
    """Make them temporary functions of the session; plain SQL, so Catalyst inlines them."""
    for name, (parameters, kind, text) in _FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {kind} RETURN {text}")
