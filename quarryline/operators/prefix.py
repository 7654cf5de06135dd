"""Running sums and ranks inside groups of any size."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarryline.plans.lineage import cut


def running_sum(df: DataFrame, group: list[str], order: list[str], value: str | None = None, name: str = "before") -> DataFrame:
    """``df`` with the sum of ``value`` (or the number of rows) of the rows before, in ``order`` inside ``group``.

    Rows are range-partitioned by group and order, summed inside each
    partition, and the partitions' totals are added on top, so a group of a
    third of all rows is spread over many tasks. Null values count as 0; rows
    equal in group and order come in any order.
    """
    v = F.coalesce(F.col(value).cast("bigint"), F.lit(0)) if value else F.lit(1).cast("bigint")
    x = cut(df.withColumn("__v", v).repartitionByRange(*group, *order).sortWithinPartitions(*group, *order)).withColumn("__p", F.spark_partition_id())
    part = x.groupBy("__p", *group).agg(F.sum("__v").alias("__t"))
    w = Window.partitionBy(*group).orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    part = part.withColumn("__o", F.coalesce(F.sum("__t").over(w), F.lit(0))).drop("__t")
    inner = Window.partitionBy("__p", *group).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    y = x.withColumn("__b", F.coalesce(F.sum("__v").over(inner), F.lit(0)))
    on = [y[c].eqNullSafe(part[c]) for c in ["__p", *group]]
    cond = on[0]
    for c in on[1:]:
        cond = cond & c
    return y.join(part, cond).select(*[y[c] for c in df.columns], (y["__b"] + part["__o"]).alias(name))
