"""Connected components of links, by minimum labels with shortcuts."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarryline.plans.lineage import cut


def components(links: DataFrame) -> DataFrame:
    """(id, label) for the ids of ``links`` (a, b); label is the smallest id reached.

    Each round takes the smallest label among the neighbours and then the
    label's own label; rounds grow with the logarithm of the paths' lengths.
    Sums are combined before each shuffle, so an id with many links is no
    hot task. Empty links give no rows; a link from an id to itself is kept
    as a component of one.
    """
    both = cut(links.select("a", "b").where("a is not null and b is not null").union(links.select("b", "a").where("a is not null and b is not null")).distinct(), loop=True)
    cur = cut(both.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("m")).select("id", F.least("id", "m").alias("label")), loop=True)
    while True:
        near = both.join(cur.select(F.col("id").alias("b"), "label"), "b").groupBy(F.col("a").alias("id")).agg(F.min("label").alias("near"))
        step = cur.join(near, "id").select("id", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        hop = cur.select(F.col("id").alias("label"), F.col("label").alias("hop"))
        new = cut(step.join(hop, "label", "left").select("id", "old", F.least("label", F.coalesce("hop", "label")).alias("label")), loop=True)
        if new.where("label <> old").isEmpty():
            return new.select("id", "label")
        cur = new.select("id", "label")
