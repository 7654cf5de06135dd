"""Queries of text search, cleaning and scoring and their SQL."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from quarryline.functions import rules as R
from quarryline.operators import textsearch as X

EN, ZH = "Offline Wallet", "离线钱包"


def _docs(s, d):
    return s.read.parquet(f"{d}/documents.parquet")


def _pages(s, d):
    return s.read.parquet(f"{d}/fetch_result.parquet")


def result_score(s, d):
    p = _pages(s, d).where("title is not null")
    return p.select("fetch_id", R.quality_score(F.col("title"), F.substring(F.coalesce("content", F.lit("")), 1, 300), F.col("url"), "离线钱包 指标").alias("score"))


def top_percent(s, d):
    """The best 35 percent of the results with score 1 or more, at least one; ties in order of arrival."""
    return X.best_percent(result_score(s, d), "score", "fetch_id", 35, 1)


def first_dedup(s, d):
    """First record of each original address."""
    p = _pages(s, d).where("original_url is not null")
    return p.groupBy("original_url").agg(F.min("fetch_id").alias("fetch_id"))


def retention(s, d):
    words = ["令牌看板", "消息卡片", "离线钱包", "归档盘"]
    x = _docs(s, d).select("doc_id", F.explode(F.array(*map(F.lit, words))).alias("word"), "text", "title")
    kept, asked = F.col("text").contains(F.col("word")), F.coalesce(F.col("title").contains(F.col("word")), F.lit(False))
    state = F.when(asked & kept, "kept").when(asked, "lost").when(kept, "new").otherwise("none")
    return x.groupBy("word", state.alias("state")).agg(F.count("*").alias("n"))


_WS = "[ \\t\\n\\x0B\\f\\r]+"

QUERIES = {
    "kw_count": lambda s, d: _docs(s, d).select("doc_id", (X.match_count(F.col("text"), EN) + X.match_count(F.col("text"), ZH)).alias("n")).where("n > 0"),
    "kw_positions": lambda s, d: _docs(s, d).select("doc_id", F.explode(X.match_positions(F.col("text"), ZH)).alias("position")),
    "kw_snippets": lambda s, d: X.search(_docs(s, d), "doc_id", "text", ZH),
    "kw_counters": lambda s, d: X.search_counters(_docs(s, d), "text", ZH, 20_000),
    "doc_clean": lambda s, d: _docs(s, d).select("doc_id", F.md5(X.clean_text(F.col("text"))).alias("h"), F.length(X.clean_text(F.col("text"))).cast("bigint").alias("n")),
    "page_ad_lines": lambda s, d: _pages(s, d).where("content is not null").select("fetch_id", F.length(X.without_ad_lines(F.col("content"), ("推广", "sponsored", "advertisement"), ("jump.hub.example",))).cast("bigint").alias("n")),
    "page_short_lines": lambda s, d: _pages(s, d).where("content is not null").select("fetch_id", F.length(X.short_line_filter(F.col("content"))).cast("bigint").alias("n")),
    "doc_budget": lambda s, d: X.character_budget(_docs(s, d), "doc_id", "text").select("doc_id", "chars_before"),
    "doc_dup_hash": lambda s, d: _docs(s, d).groupBy(F.md5("text").alias("h")).agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id")).where("n > 1"),
    "doc_first": lambda s, d: _docs(s, d).groupBy(F.md5("text").alias("h")).agg(F.min("doc_id").alias("doc_id")),
    "doc_size_stats": lambda s, d: _docs(s, d).groupBy("doc_kind").agg(F.count("*").alias("docs"), F.sum(F.length("text")).alias("chars"), F.round(F.sum(F.length(F.trim("text"))) / F.sum(F.length("text")) * 100, 1).alias("kept_pct")),
    "doc_type_hist": lambda s, d: _docs(s, d).groupBy(F.coalesce("doc_kind", F.lit("unknown")).alias("kind")).agg(F.count("*").alias("n")),
    "doc_paragraphs": lambda s, d: _docs(s, d).select("doc_id", F.size(F.filter(F.split("text", "\n", -1), lambda x: F.length(F.trim(x)) > 20)).cast("bigint").alias("n")),
    "doc_headings": lambda s, d: _docs(s, d).select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(r"(?m)^##? ([^\n]+)$"), 1)).alias("heading")),
    "doc_table_islands": lambda s, d: X.table_islands(_docs(s, d), "doc_id", "text"),
    "doc_digit_runs": lambda s, d: _docs(s, d).select("doc_id", F.size(F.regexp_extract_all("text", F.lit("[0-9]+"), 0)).cast("bigint").alias("runs")),
    "doc_retention": retention,
    "page_hash": lambda s, d: _pages(s, d).where("url is not null").select("fetch_id", X.short_hash(F.col("url")).alias("h"), X.file_name(F.col("url"), 40).alias("file")),
    "page_blocked": lambda s, d: _pages(s, d).select("fetch_id", R.crawl_block(F.col("content"), F.col("url")).alias("blocked"), R.any_of(F.col("original_url"), R.REDIRECT).alias("redirect"), R.any_of(F.lower("url"), R.FETCH_SKIP).alias("skip")).where("blocked or redirect or skip"),
    "page_success": lambda s, d: _pages(s, d).groupBy("fetch_type").agg(F.count_if("success").alias("ok"), F.count_if(~F.coalesce("success", F.lit(False))).alias("failed"), F.sum(F.length("content")).alias("chars")),
    "page_long_enough": lambda s, d: _pages(s, d).where(F.length("content") >= 30).groupBy("batch_no").agg(F.count("*").alias("n")).select(F.col("batch_no").cast("bigint").alias("batch_no"), "n"),
    "page_longest": lambda s, d: _pages(s, d).where("original_url is not null").groupBy("original_url").agg(F.max_by("fetch_id", F.struct(F.coalesce(F.length("content"), F.lit(0)), -F.col("fetch_id"))).alias("fetch_id")),
    "page_first_dedup": first_dedup,
    "result_score": result_score,
    "result_top_percent": top_percent,
    "result_rank": lambda s, d: result_score(s, d).orderBy(F.desc("score"), "fetch_id").limit(30).withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "fetch_id")).cast("bigint")),
}


def _has(col, parts):
    return "(" + " OR ".join(f"contains({col}, '{p}')" for p in parts) + ")"


def _score_sql():
    t = "lower(coalesce(title, '') || ' ' || substr(coalesce(content, ''), 1, 300))"
    src = " ".join(f"WHEN regexp_matches(t, '(?i){p}') THEN {v}" for p, v in R.SOURCES)
    return f"""WITH x AS (SELECT fetch_id, lower(coalesce(title, '')) ti, coalesce(title, '') title, lower(substr(coalesce(content, ''), 1, 300)) ab, lower(coalesce(url, '')) u, {t} t FROM fetch_result WHERE title IS NOT NULL),
sc AS (SELECT fetch_id, CAST(CASE WHEN {_has('u', R.APP)} OR {_has('t', R.APP)} THEN 0.5 WHEN {_has('t', R.PROMO)} AND NOT contains(t, '教程') THEN 1.0 ELSE least(10.0, round(
CASE WHEN {_has('t', R.OFFICIAL)} THEN 9.0 {src} WHEN {_has('t', R.INSTITUTION)} THEN 8.5 WHEN {_has('t', R.VIDEO)} THEN CASE WHEN {_has('t', R.VIDEO_LESSON)} THEN 6.5 ELSE 4.0 END WHEN {_has('t', R.LOW)} THEN 3.5 ELSE 5.0 END
+ CASE WHEN {_has('t', R.VALUE)} THEN 0.8 ELSE 0 END + CASE WHEN {_has('t', R.QA)} THEN 0.3 ELSE 0 END
+ CASE WHEN (contains(ti, '离线钱包')::INT + contains(ti, '指标')::INT) / 2.0 >= 0.8 THEN 1.5 WHEN (contains(ti, '离线钱包')::INT + contains(ti, '指标')::INT) / 2.0 >= 0.5 THEN 0.8 ELSE 0 END
+ CASE WHEN contains(ab, '离线钱包')::INT + contains(ab, '指标')::INT >= 1 THEN 0.5 ELSE 0 END
+ CASE WHEN regexp_matches(title, '[^\\x00-\\x7f]') THEN 0.3 ELSE 0 END, 1)) END AS DOUBLE) AS score FROM x)"""


_POS = """WITH p AS (SELECT doc_id, text, string_split(lower(text), '离线钱包') parts FROM documents), q AS (SELECT doc_id, text, parts, unnest(range(1, len(parts))) i FROM p),
m AS (SELECT doc_id, text, i, CAST(list_sum(list_transform(parts[1:i], lambda x: length(x))) + (i - 1) * 4 AS BIGINT) AS position FROM q)"""

SQL = {
    "kw_count": "SELECT * FROM (SELECT doc_id, CAST(len(string_split(lower(text), 'offline wallet')) - 1 + len(string_split(lower(text), '离线钱包')) - 1 AS BIGINT) AS n FROM documents) WHERE n > 0",
    "kw_positions": _POS + " SELECT doc_id, position FROM m",
    "kw_snippets": _POS
    + r""" SELECT doc_id, position, replace(trim(regexp_replace(substr(text, greatest(position - 100, 0) + 1, least(position, 100) + 104), '[\s\x{0B}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+', ' ', 'g')), '离线钱包', '【离线钱包】') AS context FROM m WHERE i <= 3""",
    "kw_counters": "SELECT count(*) AS total, count(*) FILTER (WHERE length(text) <= 20000) AS scanned, count(*) FILTER (WHERE length(text) <= 20000 AND contains(text, '离线钱包')) AS matched, count(*) FILTER (WHERE length(text) > 20000) AS skipped_large FROM documents",
    "doc_budget": "SELECT doc_id, chars_before FROM (SELECT doc_id, CAST(coalesce(sum(least(length(text), 3000)) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS chars_before FROM documents) WHERE chars_before < 15000",
    "doc_dup_hash": "SELECT md5(text) AS h, count(*) AS n, min(doc_id) AS first_id FROM documents GROUP BY 1 HAVING count(*) > 1",
    "doc_first": "SELECT md5(text) AS h, min(doc_id) AS doc_id FROM documents GROUP BY 1",
    "doc_size_stats": "SELECT doc_kind, count(*) AS docs, CAST(sum(length(text)) AS BIGINT) AS chars, round(sum(length(trim(text, ' '))) / sum(length(text)) * 100, 1) AS kept_pct FROM documents GROUP BY 1",
    "doc_type_hist": "SELECT coalesce(doc_kind, 'unknown') AS kind, count(*) AS n FROM documents GROUP BY 1",
    "doc_paragraphs": "SELECT doc_id, CAST(len(list_filter(string_split(text, chr(10)), lambda x: length(trim(x, ' ')) > 20)) AS BIGINT) AS n FROM documents",
    "doc_headings": r"SELECT doc_id, unnest(regexp_extract_all(text, '(?m)^##? ([^\n]+)$', 1)) AS heading FROM documents",
    "doc_digit_runs": "SELECT doc_id, CAST(len(regexp_extract_all(text, '[0-9]+')) AS BIGINT) AS runs FROM documents",
    "doc_retention": """WITH w AS (SELECT unnest(['令牌看板', '消息卡片', '离线钱包', '归档盘']) word)
SELECT word, CASE WHEN coalesce(contains(title, word), false) AND contains(text, word) THEN 'kept' WHEN coalesce(contains(title, word), false) THEN 'lost' WHEN contains(text, word) THEN 'new' ELSE 'none' END AS state, count(*) AS n FROM documents, w GROUP BY 1, 2""",
    "page_hash": r"SELECT fetch_id, substr(md5(url), 1, 8) AS h, substr(translate(url, '\/:*?""<>|', '_________'), 1, 40) AS file FROM fetch_result WHERE url IS NOT NULL".replace('""', '"'),
    "page_success": "SELECT fetch_type, count(*) FILTER (WHERE success) AS ok, count(*) FILTER (WHERE NOT coalesce(success, false)) AS failed, CAST(sum(length(content)) AS BIGINT) AS chars FROM fetch_result GROUP BY 1",
    "page_long_enough": "SELECT CAST(batch_no AS BIGINT) AS batch_no, count(*) AS n FROM fetch_result WHERE length(content) >= 30 GROUP BY 1",
    "page_longest": "SELECT original_url, fetch_id FROM (SELECT original_url, fetch_id, row_number() OVER (PARTITION BY original_url ORDER BY coalesce(length(content), 0) DESC, fetch_id) rn FROM fetch_result WHERE original_url IS NOT NULL) WHERE rn = 1",
    "page_first_dedup": "SELECT original_url, min(fetch_id) AS fetch_id FROM fetch_result WHERE original_url IS NOT NULL GROUP BY 1",
    "page_blocked": f"""SELECT * FROM (SELECT fetch_id, CASE WHEN contains(u, 'zhihu.com') THEN contains(u, 'security.zhihu.com') OR contains(u, 'signin?next') OR contains(u, 'captcha') OR contains(b, '访问过于频繁') OR contains(b, '人机验证')
ELSE (contains(u, 'baidu.com') AND (contains(u, 'wappass.baidu.com') OR contains(b, '百度安全验证'))) OR {_has('b', R.BLOCKED)} OR {_has('u', R.BLOCKED)} END AS blocked, {_has('o', R.REDIRECT)} AS redirect, {_has('u', R.FETCH_SKIP)} AS skip
FROM (SELECT fetch_id, lower(coalesce(url, '')) u, lower(coalesce(content, '')) b, coalesce(original_url, '') o FROM fetch_result)) WHERE blocked OR redirect OR skip""",
    "result_score": _score_sql() + " SELECT fetch_id, score FROM sc",
    "result_top_percent": _score_sql() + ", n AS (SELECT greatest(1, least(greatest(1, count(*) * 35 // 100), count(*) FILTER (WHERE score >= 1))) k FROM sc) SELECT fetch_id, score FROM (SELECT *, row_number() OVER (ORDER BY score DESC, fetch_id) rn FROM sc), n WHERE rn <= k",
    "result_rank": _score_sql() + " SELECT fetch_id, score, row_number() OVER (ORDER BY score DESC, fetch_id) AS rank FROM sc ORDER BY rank LIMIT 30",
}
