"""Job-log analytics: counts, throughput, run durations, trends, time to finish."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import job_group

# The log format and its markers.
LINE = r"^\[(\d{4}-\d{2}-\d{2}) (\d{2}:\d{2}:\d{2}):(\d{3})\] (\w+)\|(.+?) > (.*)"
JOB = r"^([A-Za-z0-9]+Job)(?:_|$|\s)"
LOOKUP, RECOGNIZED, NOT_FOUND, PROCESS = r"Get AniDB file info", r"Found [1-9]\d* episodes for file", r"Found 0 episodes for file", r"ProcessFileJob"
BAN = r"(?i)AniDBBanned|UDPBan|HTTPBan|FloodControl"
ERROR_JOB = r"\bJob\s+[\w.]*?([A-Za-z0-9]+Job)"
TEN_YEARS = 3650 * 86400


def parse_log_lines(lines: DataFrame, column: str = "value") -> DataFrame:
    """SRC5: ``(ts, level, context, message)`` of the lines in the format; others are dropped."""
    part = lambda i: F.regexp_extract(column, LINE, i)
    ts = F.to_timestamp(F.concat(part(1), F.lit(" "), part(2), F.lit("."), part(3)), "yyyy-MM-dd HH:mm:ss.SSS")
    return lines.where(F.col(column).rlike(LINE)).select(ts.alias("ts"), part(4).alias("level"), part(5).alias("context"), part(6).alias("message"))


def job_class(context: Column) -> Column:
    return F.nullif(F.regexp_extract(context, JOB, 1), F.lit(""))


def rule() -> Column:
    """First of the identification rules that a line meets."""
    m = F.col("message")
    return F.when(m.rlike(LOOKUP), "lookup").when(m.rlike(RECOGNIZED), "recognized").when(m.rlike(NOT_FOUND), "notfound").when(F.col("context").rlike(PROCESS), "process")


def daily_counts(logs: DataFrame) -> DataFrame:
    """A10 over parsed lines."""
    each = logs.select(F.to_date("ts").alias("day"), rule().alias("rule"))
    return each.groupBy("day").agg(*[F.count_if(F.coalesce(F.col("rule") == r, F.lit(False))).alias(n) for r, n in (("lookup", "lookups"), ("recognized", "recognized"), ("notfound", "notfound"), ("process", "process"))])


def daily_bans(lines: DataFrame, day: str, column: str = "value") -> DataFrame:
    """A10: ban markers on raw lines, the ones that don't parse included."""
    return lines.groupBy(day).agg(F.count_if(F.col(column).rlike(BAN)).alias("bans"))


def hourly(logs: DataFrame, days: int) -> DataFrame:
    """Lookups per hour of the last days, and each day's mean per active hour."""
    per = logs.where(rule() == "lookup").groupBy(F.to_date("ts").alias("day"), F.hour("ts").alias("hour")).agg(F.count("*").alias("n"))
    recent = logs.select(F.to_date("ts").alias("day")).distinct().orderBy(F.desc("day")).limit(days)
    return per.join(recent, "day", "left_semi").withColumn("day_mean", F.avg("n").over(Window.partitionBy("day")))


def throughput(logs: DataFrame) -> DataFrame:
    """Distinct jobs and errors per day and class, with the class's group."""
    jobs = logs.select(F.to_date("ts").alias("day"), job_class(F.col("context")).alias("class"), "context").where("class is not null")
    tasks = jobs.groupBy("day", "class").agg(F.count_distinct("context").alias("tasks"))
    return tasks.withColumn("group", job_group(F.col("class")))


def error_counts(lines: DataFrame, day: str, column: str = "value") -> DataFrame:
    """Errors per day and job class named in the raw line."""
    failed = lines.where((F.regexp_extract(column, LINE, 4) == "Error") & F.col(column).rlike(ERROR_JOB))
    return failed.groupBy(day, F.regexp_extract(column, ERROR_JOB, 1).alias("class")).agg(F.count("*").alias("errors"))


def group_pivot(tasks: DataFrame) -> DataFrame:
    """Tasks per day, a column per group."""
    return tasks.groupBy("day").pivot("group", ["File", "AniDB", "TMDB", "Trakt", "Stats", "Other"]).agg(F.sum("tasks")).na.fill(0)


def active_median(daily: DataFrame, window: int, column: str = "recognized") -> DataFrame:
    """Median of the last ``window`` full days (the last day is partial) that aren't zero."""
    n = F.row_number().over(Window.orderBy(F.desc("day")))  # a row per day
    last = daily.withColumn("n", n).withColumn("days", F.count("*").over(Window.partitionBy()))
    kept = last.where(((F.col("n") > 1) | (F.col("days") == 1)) & (F.lit(window <= 0) | (F.col("n") <= window + F.when(F.col("days") == 1, 0).otherwise(1))))
    return kept.where(F.col(column) > 0).agg(F.median(column).alias("rate"))


def sessions(logs: DataFrame, max_gap: float) -> DataFrame:
    """Runs of each (day, context): consecutive lines at most ``max_gap`` seconds apart, by gap islands."""
    lines = logs.select(F.to_date("ts").alias("day"), "context", job_class(F.col("context")).alias("class"), F.unix_micros(F.col("ts").cast("timestamp")).alias("t")).where("class is not null")
    w = Window.partitionBy("day", "context").orderBy("t")
    cut = F.coalesce((F.col("t") - F.lag("t").over(w) > int(max_gap * 1_000_000)).cast("int"), F.lit(0))
    marked = lines.withColumn("cut", cut).withColumn("run", F.sum("cut").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy("day", "context", "class", "run").agg(F.count("*").alias("lines"), ((F.max("t") - F.min("t")) / 1e6).alias("seconds"))


def run_durations(logs: DataFrame, max_gap: float) -> DataFrame:
    """Per class the measurable runs (two lines or more), single lines, coverage, mean, median, 90th percentile."""
    d = F.when(F.col("lines") >= 2, F.col("seconds"))
    out = sessions(logs, max_gap).groupBy("class").agg(F.count(d).alias("runs"), F.count_if(F.col("lines") == 1).alias("single"), F.avg(d).alias("mean_s"), F.median(d).alias("median_s"), F.percentile(d, F.lit(0.9)).alias("p90_s"))
    return out.withColumn("coverage", F.col("runs") / (F.col("runs") + F.col("single")))


def slope(points: DataFrame, window_hours: float, ts: str = "ts", value: str = "value") -> DataFrame:
    """Least squares over the trailing window: change per second and span in hours, null with fewer than two times."""
    t = F.unix_micros(F.col(ts).cast("timestamp")) / 1e6
    top = points.agg(F.max(t).alias("_top"))
    near = points.select(t.alias("t"), F.col(value).cast("double").alias("v")).crossJoin(F.broadcast(top)).where(F.col("t") >= F.col("_top") - window_hours * 3600)  # one row beside
    x = F.col("t") - F.col("_top")
    return near.agg(F.when(F.count_distinct("t") > 1, F.regr_slope("v", x)).alias("slope"), F.when(F.count("*") > 1, (F.max("t") - F.min("t")) / 3600).alias("span_hours"))


def eta_seconds(remaining: Column, drain: Column, per_day: Column) -> Column:
    """By the live drain where it falls, else by the daily rate; nothing beyond ten years."""
    seconds = F.when(drain < 0, remaining / -drain).when(per_day > 0, remaining / per_day * 86400)
    return F.when((seconds > 0) & (seconds <= TEN_YEARS), seconds)


def queue_counts(items: DataFrame) -> DataFrame:
    """A19."""
    return items.groupBy("type").agg(F.count("*").alias("n"), F.count_if("running").alias("running"), F.count_if("blocked").alias("blocked"))
