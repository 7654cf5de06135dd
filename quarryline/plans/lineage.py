"""Cutting lineage through the shared checkpoint folder."""

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Rows up to which loops of many small plans run without adaptive execution, and their shuffle partitions.
SMALL, FEW = 200_000, 4


def _ensure_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; an own one only where it is unset and all runs on one machine (tests)."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not (sc.master == "local" or sc.master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="quarryline-"))
    return sc._jsc.sc().getCheckpointDir().get()


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{_ensure_dir(spark)}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame, loop: bool = False) -> DataFrame:
    """``df`` computed once and read from the shared folder from then on; survives lost executors.

    ``loop``: in loops that unite parts, keep to the session's number of shuffle
    partitions, as the parts' partitions would add up from round to round.
    """
    spark = df.sparkSession
    _ensure_dir(spark)
    if loop:
        df = df.coalesce(int(spark.conf.get("spark.sql.shuffle.partitions")))
    return df.checkpoint(eager=True)


@contextmanager
def small_plans(spark: SparkSession, rows: int) -> Iterator[None]:
    """Run loops over at most ``SMALL`` rows without adaptive execution and with few partitions.

    So few rows can't be skewed to harm, and replanning each of many small
    stages costs the driver more time and memory than it saves. Beyond
    ``SMALL`` nothing is changed. What is planned inside must also run inside.
    """
    if rows > SMALL:
        yield
        return
    names = ("spark.sql.adaptive.enabled", "spark.sql.shuffle.partitions")
    old = {k: spark.conf.get(k) for k in names}
    spark.conf.set(names[0], "false")
    spark.conf.set(names[1], str(min(int(old[names[1]]), FEW)))
    try:
        yield
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
