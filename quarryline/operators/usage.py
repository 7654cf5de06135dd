"""Usage analytics over log lines: daily sums, trailing windows, leaderboards.

Log lines are counted as they are (repeated lines count each time). A line
counts if its type is ``assistant``, it has a usage with at least one number
and a time that parses; null numbers are 0. The day of a line is the day in
the line's own offset. Clocks are never read: ``as_of`` is a parameter.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: ISO-8601 with optional fraction and offset; a bare date is midnight.
ISO = r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}(\.\d{1,9})?)?(Z|[+-]\d{2}:?\d{2})?)?$"


def local_time(c: Column) -> Column:
    """Time as written, without its offset, to the second; null if it doesn't parse."""
    padded = F.concat(F.regexp_replace(F.substring(c, 1, 19), "T", " "), F.when(F.length(c) <= 10, " 00:00:00").otherwise(""))
    return F.when(c.rlike(ISO), F.try_to_timestamp(F.substring(padded, 1, 19), F.lit("yyyy-MM-dd HH:mm:ss")))


def offset_minutes(c: Column) -> Column:
    """Minutes east of UTC; 0 without an offset."""
    sign = F.regexp_extract(c, r"([+-])\d{2}:?\d{2}$", 1)
    h, m = (F.regexp_extract(c, r"T.*[+-](\d{2}):?(\d{2})$", i) for i in (1, 2))
    return F.when(h == "", 0).otherwise((h.try_cast("int") * 60 + m.try_cast("int")) * F.when(sign == "-", -1).otherwise(1))


def usage_lines(log: DataFrame) -> DataFrame:
    """(user_id, day, at, input, output) of the lines that count; ``at`` is in UTC."""
    u = F.col("message.usage")
    at = local_time(F.col("logged_at"))
    rows = log.where((F.col("rec_type") == "assistant") & (u["input_tokens"].isNotNull() | u["output_tokens"].isNotNull()))
    return rows.select(
        "user_id",
        F.date_format(at, "yyyy-MM-dd").alias("day"),
        (at - F.make_dt_interval(mins=offset_minutes(F.col("logged_at")))).alias("at"),
        F.coalesce(u["input_tokens"], F.lit(0)).alias("input"),
        F.coalesce(u["output_tokens"], F.lit(0)).alias("output"),
    ).where("day is not null")



def sums() -> tuple[Column, ...]:
    return F.sum("input").alias("input"), F.sum("output").alias("output"), F.count("*").alias("calls")


def daily(lines: DataFrame) -> DataFrame:
    return lines.groupBy("day").agg(*sums())


def daily_with_total(lines: DataFrame) -> DataFrame:
    """Daily sums and the grand total (day null), in one pass."""
    return lines.rollup("day").agg(*sums())


def user_daily(lines: DataFrame) -> DataFrame:
    """(user_id, day, input, output, calls); null users are left out."""
    return lines.where("user_id is not null").groupBy("user_id", "day").agg(*sums())


def recent(lines: DataFrame, as_of: Column, minutes: int = 30) -> DataFrame:
    """One row: sums of the last minutes before ``as_of`` and of its day in UTC."""
    late = (F.col("at") > as_of - F.make_dt_interval(mins=F.lit(minutes))) & (F.col("at") <= as_of)
    today = F.date_format("at", "yyyy-MM-dd") == F.date_format(as_of, "yyyy-MM-dd")
    tokens = F.col("input") + F.col("output")
    return lines.agg(
        F.coalesce(F.sum(F.when(late, tokens)), F.lit(0)).alias("recent_tokens"), F.count_if(late).alias("recent_calls"),
        F.coalesce(F.sum(F.when(today, tokens)), F.lit(0)).alias("today_tokens"), F.count_if(today).alias("today_calls"),
    )


def leaderboard(totals: DataFrame, top: int = 10) -> DataFrame:
    """(rank, user_id, tokens, calls) of the users with most tokens; ties by user_id."""
    best = totals.orderBy(F.desc("tokens"), "user_id").limit(top)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("tokens"), "user_id")).cast("bigint")).select("rank", "user_id", "tokens", "calls")


def period_totals(days: DataFrame, period: str | None = None) -> DataFrame:
    """(user_id, tokens, calls) of a day (10 signs), a month (7 signs, users without tokens dropped) or all days."""
    rows = days if period is None else days.where(F.col("day").startswith(period))
    out = rows.groupBy("user_id").agg(F.sum(F.col("input") + F.col("output")).alias("tokens"), F.sum("calls").alias("calls"))
    return out.where("tokens > 0") if period and len(period) == 7 else out


def daily_top(days: DataFrame, n: int = 5) -> DataFrame:
    """(day, rank, user_id, tokens): the n users with most tokens of each day; ties by user_id.

    Ranks are cut inside each task first (window group limit), so a day of very
    many users does not gather them.
    """
    t = days.select("day", "user_id", (F.col("input") + F.col("output")).alias("tokens"))
    w = Window.partitionBy("day").orderBy(F.desc("tokens"), "user_id")
    return t.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n).select("day", F.col("rank").cast("bigint").alias("rank"), "user_id", "tokens")


def calendar(days: DataFrame, last: Column, n: int = 7) -> DataFrame:
    """(user_id, day, tokens, calls) for every user and each of the n days up to ``last``; days without data are 0."""
    users = days.select("user_id").distinct()
    grid = users.select("user_id", F.explode(F.sequence(F.date_sub(last, n - 1), last)).alias("d")).select("user_id", F.date_format("d", "yyyy-MM-dd").alias("day"))
    have = days.select("user_id", "day", (F.col("input") + F.col("output")).alias("tokens"), "calls")
    return grid.join(have, ["user_id", "day"], "left").na.fill(0, ["tokens", "calls"])


def merge_prefer_local(local: DataFrame, remote: DataFrame, keys: list[str]) -> DataFrame:
    """Full merge of two tables of the same columns; rows of ``local`` win."""
    values = [c for c in local.columns if c not in keys]
    a = local.select(*keys, F.struct(*values).alias("a"))
    b = remote.select(*keys, F.struct(*values).alias("b"))
    return a.join(b, keys, "full").select(*keys, F.coalesce("a", "b").alias("v")).select(*keys, "v.*")


def short_number(c: Column) -> Column:
    """1.2M, 3K or the number itself; exact ties go to the even digit."""
    return (
        F.when(c >= 1_000_000, F.format_string("%.1fM", F.bround(c / 1_000_000, 1)))
        .when(c >= 1_000, F.format_string("%.0fK", F.bround(c / 1_000, 0)))
        .otherwise(F.format_string("%d", c.cast("bigint")))
    )


def duration_text(c: Column) -> Column:
    """Seconds as 秒, 分钟 or 小时 and 分钟."""
    m, h = F.floor(c / 60), F.floor(c / 3600)
    return F.when(c < 60, F.format_string("%d秒", c)).when(c < 3600, F.format_string("%d分钟", m)).otherwise(F.format_string("%d小时%d分钟", h, F.floor(c % 3600 / 60)))


def progress_bar(c: Column, width: int = 20) -> Column:
    """Bar of ``width`` signs with the percentage after it."""
    full = F.floor(c / 100 * width).cast("int")
    return F.concat(F.lit("["), F.repeat(F.lit("█"), full), F.repeat(F.lit("░"), F.lit(width) - full), F.lit("] "), c.cast("string"), F.lit("%"))


def user_profiles(days: DataFrame) -> DataFrame:
    """(user_id, total, daily): one row per user with a map of its days."""
    total = F.struct(F.sum("input").alias("input_tokens"), F.sum("output").alias("output_tokens"), F.sum("calls").alias("calls"))
    return days.groupBy("user_id").agg(total.alias("total"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("day", F.struct("input", "output", "calls").alias("v"))))).alias("daily"))
