"""Dependency graphs of subtasks: readiness, progress, checks."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def ready(tasks: DataFrame) -> DataFrame:
    """(plan, id) of pending tasks (null status too) all of whose dependencies are completed."""
    t = tasks.withColumn("__s", F.coalesce("status", F.lit("pending")))
    deps = t.where("__s = 'pending'").select("plan", "id", F.explode("dependencies").alias("dep"))
    done = t.where("__s = 'completed'").select("plan", F.col("id").alias("dep"))
    unmet = deps.join(done, ["plan", "dep"], "left_anti").select("plan", "id").distinct()
    return t.where("__s = 'pending'").select("plan", "id").join(unmet, ["plan", "id"], "left_anti")


def progress(tasks: DataFrame, seconds_each: int = 180) -> DataFrame:
    """One row per plan: counts by status, percentage with one decimal, and the estimated seconds left (null before the first is done)."""
    run = F.coalesce(F.sum(F.when(F.col("status") == "running", F.col("progress") / 100)), F.lit(0.0))
    x = tasks.groupBy("plan").agg(F.count("*").alias("total"), *[F.count_if(F.coalesce(F.col("status"), F.lit("")) == s).alias(s) for s in ("completed", "running", "failed")], run.alias("run"))
    return x.select(
        "plan", "total", "completed", "running", "failed", (F.col("total") - F.col("completed") - F.col("running") - F.col("failed")).alias("pending"),
        F.bround((F.col("completed") + F.col("run")) / F.col("total") * 100, 1).alias("pct"),
        F.when(F.col("completed") > 0, F.floor((F.col("total") - F.col("completed") - F.col("run")) * seconds_each)).alias("eta_s"),
    )


def faults(tasks: DataFrame, groups: DataFrame) -> DataFrame:
    """(plan, fault, item): duplicate and missing ids, group members that are no task."""
    dup = tasks.where("id is not null").groupBy("plan", "id").count().where("count > 1").select("plan", F.lit("duplicate id").alias("fault"), F.col("id").alias("item"))
    missing = tasks.where("id is null").select("plan", F.lit("missing id").alias("fault"), F.lit(None).cast("string").alias("item"))
    alien = groups.select("plan", F.explode(F.flatten("parallel_groups")).alias("id")).join(tasks.select("plan", "id"), ["plan", "id"], "left_anti").select("plan", F.lit("unknown in group").alias("fault"), F.col("id").alias("item"))
    return dup.unionByName(missing).unionByName(alien.distinct())


def idle_level(seconds: Column, errors: Column) -> Column:
    """Level by idle seconds (30, 60, 120); more than 2 errors raise healthy to warning; missing is 0."""
    s, e = F.coalesce(seconds, F.lit(0)), F.coalesce(errors, F.lit(0))
    return F.when(s > 120, "stuck").when(s > 60, "critical").when((s > 30) | (e > 2), "warning").otherwise("healthy")
