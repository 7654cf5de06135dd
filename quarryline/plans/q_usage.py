"""Usage queries and their SQL."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarryline.operators import usage as U


def _lines(s: SparkSession, d: str) -> DataFrame:
    return U.usage_lines(s.read.parquet(f"{d}/usage_log.parquet"))


def _last(lines: DataFrame):
    return lines.agg(F.max("at")).first()[0]  # one value


def usage_recent(s, d):
    x = _lines(s, d)
    return U.recent(x, F.lit(_last(x)))


def board_month(s, d):
    days = U.user_daily(_lines(s, d))
    month = days.agg(F.max(F.substring("day", 1, 7))).first()[0]
    return U.leaderboard(U.period_totals(days, month or "0000-00"))


def calendar_fill(s, d):
    days = U.user_daily(_lines(s, d))
    last = days.agg(F.max("day")).first()[0]
    return U.calendar(days, F.lit(last).cast("date"))


def daily_merge(s, d):
    days = U.user_daily(_lines(s, d))
    odd = F.pmod(F.length("user_id") + F.substring("day", 10, 1).cast("int"), F.lit(2)) == 1
    local = days.where(odd | F.col("calls").between(1, 3))
    remote = days.withColumn("calls", F.col("calls") + 1)
    return U.merge_prefer_local(local, remote, ["user_id", "day"])


QUERIES = {
    "usage_daily": lambda s, d: U.daily(_lines(s, d)),
    "usage_daily_total": lambda s, d: U.daily_with_total(_lines(s, d)),
    "usage_user_daily": lambda s, d: U.user_daily(_lines(s, d)),
    "usage_recent": usage_recent,
    "usage_board_total": lambda s, d: U.leaderboard(U.period_totals(U.user_daily(_lines(s, d)))),
    "usage_board_month": board_month,
    "usage_daily_top5": lambda s, d: U.daily_top(U.user_daily(_lines(s, d))),
    "usage_calendar": calendar_fill,
    "usage_merge_local": daily_merge,
    "usage_history": lambda s, d: U.daily(_lines(s, d)).orderBy(F.desc("day")).limit(7).select("day", "input", "output", "calls"),
    "usage_today": lambda s, d: U.daily(_lines(s, d)).where(F.col("day") == "2025-06-01").groupBy().agg(F.coalesce(F.max("input"), F.lit(0)).alias("input"), F.coalesce(F.max("output"), F.lit(0)).alias("output"), F.coalesce(F.max("calls"), F.lit(0)).alias("calls")),
    "usage_scan_counts": lambda s, d: s.read.parquet(f"{d}/usage_log.parquet").groupBy(F.coalesce("rec_type", F.lit("unknown")).alias("rec_type")).agg(F.count("*").alias("lines"), F.countDistinct("file_path").alias("files")),
    "usage_profile_days": lambda s, d: U.user_profiles(U.user_daily(_lines(s, d))).select("user_id", F.explode("daily").alias("day", "v")).select("user_id", "day", "v.*"),
}

_L = r"""WITH l0 AS (SELECT user_id, logged_at, coalesce(message.usage.input_tokens, 0) AS input, coalesce(message.usage.output_tokens, 0) AS output,
  try_strptime(CASE WHEN length(logged_at) <= 10 THEN logged_at || ' 00:00:00' ELSE replace(substr(logged_at, 1, 19), 'T', ' ') END, '%Y-%m-%d %H:%M:%S') AS local_at,
  regexp_extract(logged_at, 'T.*([+-]\d{2}):?(\d{2})$', 1) AS oh, regexp_extract(logged_at, 'T.*([+-]\d{2}):?(\d{2})$', 2) AS om
  FROM usage_log WHERE rec_type = 'assistant' AND (message.usage.input_tokens IS NOT NULL OR message.usage.output_tokens IS NOT NULL)
  AND regexp_matches(logged_at, '^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}(\.\d{1,9})?)?(Z|[+-]\d{2}:?\d{2})?)?$')),
lines AS (SELECT user_id, strftime(local_at, '%Y-%m-%d') AS day, input, output,
  CASE WHEN oh = '' THEN local_at WHEN oh[1] = '-' THEN local_at + to_minutes(CAST(oh[2:3] AS INT) * 60 + CAST(om AS INT)) ELSE local_at - to_minutes(CAST(oh[2:3] AS INT) * 60 + CAST(om AS INT)) END AS at_utc
  FROM l0 WHERE local_at IS NOT NULL),
days AS (SELECT user_id, day, sum(input)::BIGINT AS input, sum(output)::BIGINT AS output, count(*) AS calls FROM lines WHERE user_id IS NOT NULL GROUP BY 1, 2)
"""

SQL = {
    "usage_daily": _L + "SELECT day, sum(input)::BIGINT AS input, sum(output)::BIGINT AS output, count(*) AS calls FROM lines GROUP BY day",
    "usage_daily_total": _L + "SELECT day, sum(input)::BIGINT AS input, sum(output)::BIGINT AS output, count(*) AS calls FROM lines GROUP BY ROLLUP (day)",
    "usage_user_daily": _L + "SELECT * FROM days",
    "usage_recent": _L
    + """, m AS (SELECT max(at_utc) AS t FROM lines)
SELECT coalesce(sum(input + output) FILTER (WHERE at_utc > t - INTERVAL 30 MINUTE), 0)::BIGINT AS recent_tokens, count(*) FILTER (WHERE at_utc > t - INTERVAL 30 MINUTE) AS recent_calls,
coalesce(sum(input + output) FILTER (WHERE at_utc::DATE = t::DATE), 0)::BIGINT AS today_tokens, count(*) FILTER (WHERE at_utc::DATE = t::DATE) AS today_calls FROM lines, m""",
    "usage_board_total": _L
    + """, t AS (SELECT user_id, sum(input + output)::BIGINT AS tokens, sum(calls)::BIGINT AS calls FROM days GROUP BY 1)
SELECT row_number() OVER (ORDER BY tokens DESC, user_id) AS rank, user_id, tokens, calls FROM t ORDER BY rank LIMIT 10""",
    "usage_board_month": _L
    + """, t AS (SELECT user_id, sum(input + output)::BIGINT AS tokens, sum(calls)::BIGINT AS calls FROM days WHERE day[1:7] = (SELECT max(day[1:7]) FROM days) GROUP BY 1 HAVING sum(input + output) > 0)
SELECT row_number() OVER (ORDER BY tokens DESC, user_id) AS rank, user_id, tokens, calls FROM t ORDER BY rank LIMIT 10""",
    "usage_daily_top5": _L
    + """SELECT day, rank, user_id, tokens FROM (SELECT day, user_id, input + output AS tokens, row_number() OVER (PARTITION BY day ORDER BY input + output DESC, user_id) AS rank FROM days) WHERE rank <= 5""",
    "usage_calendar": _L
    + """, g AS (SELECT user_id, strftime(x, '%Y-%m-%d') AS day FROM (SELECT DISTINCT user_id FROM days), (SELECT unnest(generate_series(max(day)::DATE - 6, max(day)::DATE, INTERVAL 1 DAY)) AS x FROM days))
SELECT g.user_id, g.day, coalesce(input + output, 0) AS tokens, coalesce(calls, 0) AS calls FROM g LEFT JOIN days USING (user_id, day)""",
    "usage_merge_local": _L
    + """, loc AS (SELECT * FROM days WHERE (length(user_id) + CAST(day[10:10] AS INT)) % 2 = 1 OR calls BETWEEN 1 AND 3), rem AS (SELECT user_id, day, input, output, calls + 1 AS calls FROM days)
SELECT coalesce(l.user_id, r.user_id) AS user_id, coalesce(l.day, r.day) AS day, CASE WHEN l.day IS NOT NULL THEN l.input ELSE r.input END AS input, CASE WHEN l.day IS NOT NULL THEN l.output ELSE r.output END AS output, CASE WHEN l.day IS NOT NULL THEN l.calls ELSE r.calls END AS calls
FROM loc l FULL JOIN rem r ON l.user_id = r.user_id AND l.day = r.day""",
    "usage_history": _L + "SELECT day, sum(input)::BIGINT AS input, sum(output)::BIGINT AS output, count(*) AS calls FROM lines GROUP BY day ORDER BY day DESC LIMIT 7",
    "usage_today": _L + "SELECT coalesce(sum(input), 0)::BIGINT AS input, coalesce(sum(output), 0)::BIGINT AS output, count(*) AS calls FROM lines WHERE day = '2025-06-01'",
    "usage_scan_counts": "SELECT coalesce(rec_type, 'unknown') AS rec_type, count(*) AS lines, count(DISTINCT file_path) AS files FROM usage_log GROUP BY 1",
    "usage_profile_days": _L + "SELECT user_id, day, input, output, calls FROM days",
}
