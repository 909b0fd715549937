"""The SQL surface: functions, table functions and views of a session, so that queries can be written in SQL alone."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators import names as N

#: Scalar functions by signature and body.
FUNCTIONS = {
    "find_regexp(pattern STRING, value STRING) RETURNS BOOLEAN": "value IS NOT NULL AND value RLIKE pattern",
    "find_iregexp(pattern STRING, value STRING) RETURNS BOOLEAN": "value IS NOT NULL AND value RLIKE concat('(?i)', pattern)",
    "extension(name STRING) RETURNS STRING": r"lower(regexp_extract(name, '\\.([^.]+)$', 1))",
    "name_key(name STRING) RETURNS STRING": r"regexp_replace(lower(name), '[^\\p{L}\\p{N}]', '')",
}
#: Table functions by signature and body; rows of a path or name join it by LATERAL.
TABLES = {
    "path_components(path STRING) RETURNS TABLE (level INT, component STRING)": "SELECT size(p) - 1 - i AS level, c AS component FROM (SELECT filter(split(path, '/'), x -> trim(x) <> '') AS p) LATERAL VIEW posexplode(p) t AS i, c",
    "path_parents(path STRING) RETURNS TABLE (depth INT, parent STRING)": "SELECT i AS depth, concat_ws('/', slice(p, 1, i)) AS parent FROM (SELECT split(path, '/') AS p) LATERAL VIEW explode(sequence(0, size(p) - 1)) t AS i",
}


def register(spark: SparkSession) -> None:
    """U1 and the functions of paths and names, as temporary functions of the session; ``REGEXP`` itself is Spark's operator."""
    for signature, body in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {signature} RETURN {body}")
    for signature, body in TABLES.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {signature} RETURN {body}")


def register_names(paths: DataFrame, prefix: str = "name", column: str = "path") -> None:
    """The table form of R1 to R3 and R10 as views over ``paths``: ``<prefix>_components``, ``_spans``, ``_tokens`` and ``_attributes``."""
    components = N.path_components(paths.select(paths[column].alias("path")).distinct())
    distinct = N.distinct_components(components)
    components.createOrReplaceTempView(f"{prefix}_components")
    N.spans(distinct).createOrReplaceTempView(f"{prefix}_spans")
    N.tokens(distinct).createOrReplaceTempView(f"{prefix}_tokens")
    N.parse_components(distinct).createOrReplaceTempView(f"{prefix}_attributes")
