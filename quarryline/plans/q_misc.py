"""Queries of block Markdown, registries and streams and their SQL."""

import shutil
import tempfile

from pyspark.sql import functions as F

from quarryline.operators import blocktext, catalog, folders, listing, trimming
from quarryline.operators import usage as U
from quarryline.plans.q_catalog import _DOC
from quarryline.plans.q_usage import _L
from quarryline.sources import sinks
from quarryline.streaming import usage_stream as S


def _t(s, d, name):
    return s.read.parquet(f"{d}/{name}.parquet")


def stream_usage(s, d):
    """The windows of the log read as a stream of files, equal to those of the table.

    The stream's own folder is beside the checkpoints of the session, or
    temporary where none are set.
    """
    root = s.conf.get("spark.checkpoint.dir", None)
    schema = s.read.parquet(f"{d}/usage_log.parquet").schema
    path = f"{d}/usage_log.parquet"
    src = s.readStream.schema(schema).parquet(path if _is_dir(s, path) else f"{d}/usage_log.parquet*")
    name = "usage_windows_" + tempfile.mktemp()[-8:].replace("_", "x")
    where = f"{root}/{name}" if root else tempfile.mkdtemp()
    q = S.usage_windows(U.usage_lines(src)).writeStream.outputMode("complete").format("memory").queryName(name).option("checkpointLocation", where).trigger(availableNow=True).start()
    q.awaitTermination()
    if not root:
        shutil.rmtree(where, ignore_errors=True)
    return s.table(name).select(F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "input", "output", "calls")


def _is_dir(s, path):
    jvm = s._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(s._jsc.hadoopConfiguration()).getFileStatus(p).isDirectory()


def folder_children(s, d):
    """Every child that a folder names, with its name or one made of its id."""
    latest = folders.latest_folders(_t(s, d, "folder"))
    named = latest.select(F.explode("children").alias("folder_id")).where("folder_id is not null").distinct()
    return listing.with_entities(named, latest.select("folder_id", "folder_name"), "folder_id", "folder_name")


def docs_unlisted(s, d):
    """Documents whose folder has no row."""
    return listing.unlisted(catalog.distinct_docs(_t(s, d, "doc")), folders.latest_folders(_t(s, d, "folder")), "folder_id").select("obj_token", "folder_id")


def doc_content_source(s, d):
    """Content of a document by the text of its blocks, else by its name; documents with neither are failed."""
    doc = catalog.distinct_docs(_t(s, d, "doc"))
    blocks = blocktext.block_markdown(_t(s, d, "block_response")).select(F.col("doc_token").alias("obj_token"), F.when(F.trim("text") != "", F.col("text")).alias("content"))
    found = listing.first_source("obj_token", [("blocks", blocks), ("name", doc.select("obj_token", F.col("doc_name").alias("content")))])
    every = doc.select("obj_token").union(blocks.select("obj_token")).distinct()
    return every.join(found, "obj_token", "left").select("obj_token", "content", F.coalesce("method", F.lit("failed")).alias("method"))


def line_next(s, d):
    """The type of the next line of each log file."""
    x = _t(s, d, "usage_log").where("file_path is not null").select("file_path", "line_no", "rec_type").distinct()
    x = x.groupBy("file_path", "line_no").agg(F.min("rec_type").alias("rec_type"))
    return listing.next_step(x, ["file_path"], "line_no", "rec_type").groupBy("rec_type", "next_rec_type").agg(F.count("*").alias("n"))


QUERIES = {
    "folder_children": folder_children,
    "docs_unlisted": docs_unlisted,
    "doc_content_source": doc_content_source,
    "log_line_next": line_next,
    "page_trim": lambda s, d: _t(s, d, "fetch_result").where("content is not null").select("fetch_id", F.md5(trimming.trim_page(F.col("content"))).alias("h")),
    "block_markdown": lambda s, d: blocktext.block_markdown(_t(s, d, "block_response")),
    "usage_windows": lambda s, d: S.usage_windows(U.usage_lines(_t(s, d, "usage_log"))).select(F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "input", "output", "calls"),
    "stream_usage_windows": stream_usage,
    "link_first_seen": lambda s, d: S.first_seen(_t(s, d, "fetch_result").where("url is not null")).select("url_hash", F.date_format("fetch_time", "yyyy-MM-dd HH:mm:ss").alias("first_time")),
    "doc_latest": lambda s, d: S.latest_state(_t(s, d, "documents").where("source is not null"), "source", "doc_id", "updated_at").select("source", "doc_id"),
    "fetch_report": lambda s, d: sinks.fetch_report(_t(s, d, "fetch_result")),
    "usage_short_numbers": lambda s, d: U.daily(U.usage_lines(_t(s, d, "usage_log"))).select("day", U.short_number(F.col("input")).alias("input"), U.duration_text(F.col("calls")).alias("time"), U.progress_bar(F.least(F.col("calls"), F.lit(100)).cast("bigint")).alias("bar")),
}

_WIN = _L + "SELECT strftime(time_bucket(INTERVAL 30 MINUTE, at_utc), '%Y-%m-%d %H:%M:%S') AS start, CAST(sum(input) AS BIGINT) AS input, CAST(sum(output) AS BIGINT) AS output, count(*) AS calls FROM lines GROUP BY 1"

_LAST = """WITH latest AS (SELECT folder_id, any_value(folder_name) folder_name, any_value(children) children FROM (SELECT *, rank() OVER (PARTITION BY folder_id ORDER BY cache_time DESC) rk FROM folder) WHERE rk = 1 GROUP BY folder_id)"""

SQL = {
    "folder_children": _LAST + ", n AS (SELECT DISTINCT unnest(children) AS folder_id FROM latest) SELECT n.folder_id, coalesce(folder_name, '文档_' || substr(n.folder_id, 1, 8)) AS folder_name FROM n LEFT JOIN latest USING (folder_id) WHERE n.folder_id IS NOT NULL",
    "docs_unlisted": _LAST + f", {_DOC} SELECT obj_token, folder_id FROM dd WHERE folder_id IS NULL OR folder_id NOT IN (SELECT folder_id FROM latest)",
    "log_line_next": "WITH x AS (SELECT file_path, line_no, min(rec_type) AS rec_type FROM usage_log WHERE file_path IS NOT NULL GROUP BY 1, 2), y AS (SELECT rec_type, lead(rec_type) OVER (PARTITION BY file_path ORDER BY line_no) AS next_rec_type FROM x) SELECT rec_type, next_rec_type, count(*) AS n FROM y GROUP BY 1, 2",
    "usage_windows": _WIN,
    "stream_usage_windows": _WIN,
    "link_first_seen": "SELECT substr(md5(url), 1, 8) AS url_hash, strftime(min(fetch_time), '%Y-%m-%d %H:%M:%S') AS first_time FROM fetch_result WHERE url IS NOT NULL GROUP BY 1",
    "doc_latest": "SELECT source, doc_id FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY updated_at DESC, doc_id DESC) rn FROM documents WHERE source IS NOT NULL) WHERE rn = 1",
    "fetch_report": "SELECT '# 抓取报告' || chr(10) || chr(10) || '- 总数: ' || count(*) || chr(10) || '- 成功: ' || count(*) FILTER (WHERE success) || chr(10) || '- 失败: ' || (count(*) - count(*) FILTER (WHERE success)) || chr(10) || '- 字符: ' || CAST(coalesce(sum(length(content)), 0) AS BIGINT) AS report FROM fetch_result",
}
