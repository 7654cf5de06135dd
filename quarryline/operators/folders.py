"""The folder tree of the document catalogue."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarryline.functions.text import blank_to_null, trim_white
from quarryline.operators.hierarchy import build_hierarchy


def latest_folders(folder: DataFrame) -> DataFrame:
    """One row per folder_id: its latest state. Rows without folder_id are dropped; null cache_time comes first.

    Of rows with equal cache_time the greatest by parent, name and path is taken.
    """
    f = folder.where("folder_id is not null")
    state = F.struct(F.coalesce(F.unix_micros(F.col("cache_time").cast("timestamp")), F.lit(-(2**62))).alias("t"), "parent_id", "folder_name", "folder_path", "children")
    return f.groupBy("folder_id").agg(F.max(state).alias("s")).select("folder_id", "s.parent_id", "s.folder_name", "s.folder_path", "s.children")


def folder_edges(latest: DataFrame) -> DataFrame:
    """(folder_id, parent, folder_name, folder_path): parent by parent_id, else by the children lists.

    Of several folders that name the same child the smallest id counts.
    """
    told = latest.select("folder_id", F.explode("children").alias("c")).select(blank_to_null(F.col("c")).alias("folder_id"), F.col("folder_id").alias("by")).where("folder_id is not null")
    told = told.groupBy("folder_id").agg(F.min("by").alias("by"))
    return latest.join(told, "folder_id", "left").select("folder_id", F.coalesce(blank_to_null(F.col("parent_id")), F.col("by")).alias("parent"), "folder_name", "folder_path")


def folder_tree(folder: DataFrame) -> DataFrame:
    """``build_hierarchy`` of the latest folder states, with the cached folder_path."""
    edges = folder_edges(latest_folders(folder))
    tree = build_hierarchy(edges, "folder_id", "parent", "folder_name")
    return tree.join(edges.select(F.col("folder_id").alias("id"), "folder_path"), "id")


def path_faults(tree: DataFrame) -> DataFrame:
    """(folder_id, root_id) of folders on or below a cycle, or whose cached path differs from their path."""
    pieces = F.filter(F.transform(F.split("folder_path", "/", -1), trim_white), lambda x: x != "")
    differs = (F.size(pieces) > 0) & ~pieces.eqNullSafe(F.col("path"))
    return tree.where(F.col("cyclic") | F.coalesce(differs, F.lit(False))).select(F.col("id").alias("folder_id"), F.col("root").alias("root_id"))
