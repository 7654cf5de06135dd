"""Listings of nodes and entities, sources in order of preference, registries with a unique address."""

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def with_entities(listed: DataFrame, entities: DataFrame, key: str, name: str) -> DataFrame:
    """Listed keys with their entity; a missing entity or name gives a name made of the key."""
    e = entities.select(key, F.col(name).alias("__n"))
    return listed.join(e, key, "left").select(*listed.columns, F.coalesce("__n", F.concat(F.lit("文档_"), F.substring(key, 1, 8))).alias(name))


def unlisted(entities: DataFrame, listed: DataFrame, key: str) -> DataFrame:
    """Entities whose key is not listed; null keys are unlisted."""
    return entities.join(listed.select(key).distinct(), key, "left_anti")


def first_source(key: str, sources: list[tuple[str, DataFrame]]) -> DataFrame:
    """(key, content, method) by the first source, in order, that has a content for a key."""
    rows = reduce(DataFrame.unionByName, [d.where(F.col("content").isNotNull()).select(key, "content", F.lit(i).alias("i"), F.lit(m).alias("method")) for i, (m, d) in enumerate(sources)])
    return rows.groupBy(key).agg(F.min(F.struct("i", "content", "method")).alias("s")).select(key, "s.content", "s.method")


def register(registry: DataFrame, new: DataFrame) -> DataFrame:
    """Registry (id, name, url, created_at) with new rows whose url isn't there; of several with one url the first by created_at and id."""
    fresh = new.join(registry.select("url"), "url", "left_anti").select(registry.columns)
    first = fresh.groupBy("url").agg(F.min(F.struct("created_at", "id", "name")).alias("s")).select("s.id", "s.name", "url", "s.created_at")
    return registry.unionByName(first.select(registry.columns))


def with_default(registry: DataFrame, default_id: Column) -> DataFrame:
    """Registry with ``is_default``: the given id if it is there, else the first remaining by created_at and id."""
    first = registry.agg(F.max(F.when(F.col("id") == default_id, F.col("id"))).alias("d"), F.min(F.struct("created_at", "id")).alias("f")).select(F.coalesce("d", "f.id").alias("__d"))
    return registry.crossJoin(first).withColumn("is_default", F.col("id") == F.col("__d")).drop("__d")  # one row


def next_step(steps: DataFrame, group: list[str], order: str, value: str) -> DataFrame:
    """Each step with the value of the step after it in its group."""
    return steps.withColumn(f"next_{value}", F.lead(value).over(Window.partitionBy(*group).orderBy(order)))
