"""The document catalogue: documents of folders, incremental refresh, counts."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarryline.functions.rules import name_score


def distinct_docs(doc: DataFrame) -> DataFrame:
    """One row per obj_token, the first by folder and order; rows without a token are dropped."""
    first = F.min(F.struct(F.coalesce("folder_id", F.lit("￿")).alias("f"), F.coalesce("ord", F.lit(2**31 - 1)).alias("o"), "doc_name", "url", "edit_time", "folder_id"))
    return doc.where("obj_token is not null").groupBy("obj_token").agg(first.alias("s")).select("obj_token", "s.folder_id", F.col("s.o").alias("ord"), "s.doc_name", "s.url", "s.edit_time")


def stale_docs(docs: DataFrame, cached: DataFrame) -> DataFrame:
    """Documents to fetch again: all but those whose short id and edit time are cached; null times are always fetched."""
    x = docs.withColumn("short_id", F.substring("obj_token", 1, 8))
    return x.join(cached.select("short_id", "edit_time").where("edit_time is not null").distinct(), ["short_id", "edit_time"], "left_anti").drop("short_id")


def search_names(docs: DataFrame, keyword: str, least: float = 0.3) -> DataFrame:
    """(obj_token, score) of documents by name and folder path, score at least ``least``."""
    return docs.select("obj_token", name_score(F.col("doc_name"), F.col("folder_path"), keyword).alias("score")).where(F.col("score") >= least)


def folder_counts(folders: DataFrame, docs: DataFrame) -> DataFrame:
    """(folder_id, doc_count, child_count, parent_id) counted from the rows; folders without any are 0."""
    own = docs.where("folder_id is not null").groupBy("folder_id").agg(F.count("*").alias("doc_count"))
    kids = folders.where("parent is not null").groupBy(F.col("parent").alias("folder_id")).agg(F.count("*").alias("child_count"))
    return folders.select("folder_id", "parent").join(own, "folder_id", "left").join(kids, "folder_id", "left").na.fill(0, ["doc_count", "child_count"])


def total_docs(tree: DataFrame, counts: DataFrame, levels: int | None = None) -> DataFrame:
    """(folder_id, total): documents of a folder and of those below it, down to ``levels`` levels (all if None)."""
    pairs = tree.where(~F.col("cyclic")).select("id", "depth", F.posexplode("path_ids").alias("p", "folder_id"))
    if levels is not None:
        pairs = pairs.where(F.col("depth") - F.col("p") - 1 <= levels)
    return pairs.join(counts.select(F.col("folder_id").alias("id"), "doc_count"), "id").groupBy("folder_id").agg(F.sum("doc_count").alias("total"))


def flatten_docs(tree: DataFrame, docs: DataFrame) -> DataFrame:
    """(obj_token, folder_id, folder_path, depth) of documents in folders that are in no cycle."""
    t = tree.where(~F.col("cyclic")).select(F.col("id").alias("folder_id"), F.concat(F.lit("/"), F.array_join("path", "/")).alias("folder_path"), "depth")
    return docs.join(t, "folder_id").select("obj_token", "folder_id", "folder_path", "depth")


def cache_valid(cached_at: Column, as_of: Column, has_content: Column, cached_edit: Column, edit: Column, root: Column, hours: int = 168) -> Column:
    """Whether a cached folder may be used: no root, not older than ``hours``, with content, unchanged if both edit times are known."""
    young = (F.unix_timestamp(as_of) - F.unix_timestamp(cached_at)) <= hours * 3600
    same = cached_edit.isNull() | edit.isNull() | (cached_edit == edit)
    return F.coalesce(~root & young & has_content & same, F.lit(False))


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``new`` replace those of ``old`` with the same keys."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new)


def parent_of_children(latest: DataFrame) -> DataFrame:
    """(folder_id, told_by): the first folder, by id, whose children name a folder."""
    return latest.select(F.explode("children").alias("folder_id"), F.col("folder_id").alias("by")).where("folder_id is not null").groupBy("folder_id").agg(F.min("by").alias("told_by"))


def edit_instant(c: Column) -> Column:
    """Edit time as a timestamp: seconds, milliseconds or yyyy-MM-dd HH:mm; null otherwise."""
    n = c.try_cast("bigint")
    return F.when(c.rlike(r"^\d{13}$"), F.timestamp_millis(n)).when(c.rlike(r"^\d{1,12}$"), F.timestamp_seconds(n)).otherwise(F.try_to_timestamp(F.substring(F.regexp_replace(c, "T", " "), 1, 16), F.lit("yyyy-MM-dd HH:mm")))
