"""Sinks: JSON state, Markdown articles, reports, append logs."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarryline.operators.textsearch import file_name, short_hash


def write_state(df: DataFrame, path: str) -> None:
    """Replace a JSON state by the rows, each with the number of rows of the state."""
    n = df.count()
    df.withColumn("total_count", F.lit(n)).write.mode("overwrite").json(path)


def clear_state(df: DataFrame, path: str) -> None:
    df.limit(0).write.mode("overwrite").json(path)


def article(title: Column, url: Column, body: Column) -> Column:
    """Markdown of an article; missing parts are left out."""
    head = F.concat(F.lit("# "), F.coalesce(title, F.lit("无标题")))
    link = F.when(url.isNotNull(), F.concat(F.lit("\n\n**URL**: "), url)).otherwise("")
    return F.concat(head, link, F.lit("\n\n## 正文内容\n\n"), F.coalesce(body, F.lit("")))


def write_articles(pages: DataFrame, path: str) -> None:
    """One Markdown text per row under a folder for its site; (site, file, text)."""
    x = pages.select("site", F.concat(file_name(F.coalesce("title", F.lit("无标题")), 40), F.lit("_"), short_hash(F.coalesce("url", F.lit("")))).alias("file"), article(F.col("title"), F.col("url"), F.col("content")).alias("value"))
    x.write.partitionBy("site", "file").mode("append").text(path)


def fetch_report(results: DataFrame) -> DataFrame:
    """One row with the report's text: counts and the first errors in order."""
    x = results.agg(
        F.count("*").alias("n"), F.count_if("success").alias("ok"), F.sum(F.length("content")).alias("chars"),
        F.min_by("error", "fetch_id").alias("first_error"),
    )
    return x.select(F.format_string("# 抓取报告\n\n- 总数: %d\n- 成功: %d\n- 失败: %d\n- 字符: %d", "n", "ok", F.col("n") - F.col("ok"), F.coalesce("chars", F.lit(0))).alias("report"))


def card(title: Column, lines: Column, total: Column, limit: int = 10) -> Column:
    """JSON of a message card with the first lines and a button if there are more."""
    body = F.array_join(F.slice(lines, 1, limit), "\n")
    return F.to_json(F.struct(F.lit("interactive").alias("msg_type"), F.struct(title.alias("title"), body.alias("content"), (total > limit).alias("more")).alias("card")))


def append_lines(lines: DataFrame, path: str) -> None:
    lines.select(F.col(lines.columns[0]).alias("value")).write.mode("append").text(path)
