"""Parent-child rows to full hierarchies by bottom-up leaf peeling.

Upward pass: in each round every leaf reports its subtree size to its parent
and leaves; the round is its peel level. Several rounds form one linear chain
of aggregations (a leaf emits its own row and a message to its parent, both
grouped by id), so no round joins and a parent with very many children only
receives partial sums. What is never peeled is on a cycle, as every node has
one parent at most.

Downward pass: in reverse peel order, from roots and cycle nodes, children
take path, depth and root from their parents. Descendants are rows
(``descendants``), never lists in one row.
"""

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarryline.plans.lineage import cut, small_plans

#: Peel rounds in one job.
ROUNDS = 8


def _peel(edges: DataFrame, rounds: int) -> DataFrame:
    """(id, parent, name, level, size, pending); level is null for nodes on cycles."""
    child = F.struct(F.col("id").alias("id"), F.col("parent").alias("parent"), F.col("name").alias("name"), F.lit(0).alias("cnt"), F.lit(1).alias("size"), F.lit(None).cast("int").alias("level"), F.lit(True).alias("own"))
    up = F.struct(F.col("parent").alias("id"), F.lit(None).cast("string").alias("parent"), F.lit(None).cast("string").alias("name"), F.lit(1).alias("cnt"), F.lit(0).alias("size"), F.lit(None).cast("int").alias("level"), F.lit(False).alias("own"))
    state = edges.select(F.explode(F.when(F.col("parent").isNull(), F.array(child)).otherwise(F.array(child, up))).alias("m")).select("m.*")
    state = cut(
        state.groupBy("id").agg(F.max("parent").alias("parent"), F.max("name").alias("name"), F.sum("cnt").alias("pending"), F.sum("size").alias("size"), F.max("level").alias("level"))
    )
    done = []
    n = 0
    while True:
        for _ in range(rounds):
            n += 1
            leaf = F.col("level").isNull() & (F.col("pending") == 0)
            own = F.struct("id", "parent", "name", "pending", "size", F.when(leaf, F.lit(n)).otherwise(F.col("level")).alias("level"))
            told = F.struct(
                F.col("parent").alias("id"), F.lit(None).cast("string").alias("parent"), F.lit(None).cast("string").alias("name"), F.lit(-1).cast("long").alias("pending"), F.col("size"), F.lit(None).cast("int").alias("level")
            )
            rows = state.select(F.explode(F.when(leaf & F.col("parent").isNotNull(), F.array(own, told)).otherwise(F.array(own))).alias("m")).select("m.*")
            state = rows.groupBy("id").agg(F.max("parent").alias("parent"), F.max("name").alias("name"), F.sum("pending").alias("pending"), F.sum("size").alias("size"), F.max("level").alias("level"))
        state = cut(state, loop=True)
        done.append(state.where("level is not null"))
        rest = state.where("level is null")
        # Nothing was peeled in the last round: only cycles are left.
        if state.where(F.col("level") == n).isEmpty():
            return reduce(DataFrame.unionByName, done, rest)
        state = rest


def _ring_min(ring: DataFrame) -> DataFrame:
    """(id, root): smallest id of the cycle of each node, by pointer doubling."""
    cur = cut(ring.select("id", F.col("parent").alias("hop"), F.least("id", "parent").alias("root")))
    while True:
        far = cur.select(F.col("id").alias("hop"), F.col("hop").alias("hop2"), F.col("root").alias("root2"))
        new = cut(cur.join(far, "hop").select("id", F.col("hop2").alias("hop"), F.least("root", "root2").alias("root"), (F.least("root", "root2") != F.col("root")).alias("moved")))
        if new.where("moved").isEmpty():
            return new.select("id", "root")
        cur = new.drop("moved")


def build_hierarchy(edges: DataFrame, id_col: str = "id", parent_col: str = "parent", name_col: str = "name", rounds: int = ROUNDS) -> DataFrame:
    """One row per node: id, parent, name, root, depth, path, path_ids, level, size, cyclic.

    ``edges`` has one row per id; repeated ids and null ids must be removed
    before. A parent without a row counts as none. ``depth`` is 1 for roots,
    ``path`` the names and ``path_ids`` the ids from the root down, ``level``
    the peel round (height), ``size`` the number of nodes of the subtree. For
    nodes on or below a cycle ``cyclic`` is true, ``root`` is the smallest id
    on the cycle and depth, path and path_ids are null; size and level are
    null for nodes on a cycle.
    """
    e = edges.select(F.col(id_col).alias("id"), F.col(parent_col).alias("parent"), F.col(name_col).alias("name"))
    known = e.select(F.col("id").alias("parent"), F.lit(True).alias("__known")).distinct()
    e = cut(e.join(known, "parent", "left").select("id", F.when(F.col("__known"), F.col("parent")).alias("parent"), "name"))
    with small_plans(e.sparkSession, e.count()):
        return _build(e, rounds)


def _build(e: DataFrame, rounds: int) -> DataFrame:
    nodes = cut(_peel(e, rounds), loop=True)
    roots = nodes.where("level is not null and parent is null").select(
        "id", "parent", "name", F.col("id").alias("root"), F.lit(1).alias("depth"), F.array("name").alias("path"), F.array("id").alias("path_ids"), "level", "size", F.lit(False).alias("cyclic")
    )
    ring = nodes.where("level is null")
    front = roots
    if not ring.isEmpty():
        cyc = ring.join(_ring_min(ring), "id").select(
            "id", "parent", "name", "root", F.lit(None).cast("int").alias("depth"), F.lit(None).cast("array<string>").alias("path"), F.lit(None).cast("array<string>").alias("path_ids"),
            F.lit(None).cast("int").alias("level"), F.lit(None).cast("long").alias("size"), F.lit(True).alias("cyclic"),
        )
        front = roots.unionByName(cyc)
    front = cut(front, loop=True)
    out = [front]
    rest = nodes.where("level is not null and parent is not null")
    while True:
        levels = []
        for _ in range(max(1, rounds // 2)):
            up = front.select(F.col("id").alias("parent"), "root", "depth", "path", "path_ids", "cyclic")
            front = rest.join(up, "parent").select(
                "id", "parent", "name", "root", (F.col("depth") + 1).alias("depth"), F.concat("path", F.array("name")).alias("path"), F.concat("path_ids", F.array("id")).alias("path_ids"), "level", "size", "cyclic"
            )
            levels.append(front)
        block = cut(reduce(DataFrame.unionByName, [x.withColumn("__k", F.lit(i)) for i, x in enumerate(levels)]), loop=True)
        out.append(block.drop("__k"))
        front = block.where(F.col("__k") == len(levels) - 1).drop("__k")
        if front.isEmpty():
            return reduce(DataFrame.unionByName, out)
        rest = cut(rest.join(block.select("id"), "id", "left_anti"), loop=True)


def descendants(tree: DataFrame) -> DataFrame:
    """(ancestor, id, distance): every node below every node, as rows; nodes on or below cycles have none."""
    x = tree.where(~F.col("cyclic")).select("id", "depth", F.posexplode("path_ids").alias("p", "ancestor"))
    return x.where("ancestor != id").select("ancestor", "id", (F.col("depth") - F.col("p") - 1).alias("distance"))


def all_descendants(tree: DataFrame) -> DataFrame:
    """``descendants`` with the nodes on and below cycles: members of a cycle are below each other and above all nodes below it.

    ``distance`` is the least number of steps up; a node is not below itself.
    """
    up = tree.where("cyclic and parent is not null").select("id", F.col("parent").alias("ancestor"), F.lit(1).alias("distance"))
    reach = cut(up.where("ancestor != id"), loop=True)
    n = reach.count()
    while n:  # each round doubles the steps reached
        far = reach.select(F.col("id").alias("ancestor"), F.col("ancestor").alias("top"), F.col("distance").alias("more"))
        far = reach.join(far, "ancestor").where("top != id").select("id", F.col("top").alias("ancestor"), (F.col("distance") + F.col("more")).alias("distance"))
        reach = cut(reach.unionByName(far).groupBy("id", "ancestor").agg(F.min("distance").alias("distance")), loop=True)
        before, n = n, reach.count()
        if n == before:
            break
    return descendants(tree).unionByName(reach.select("ancestor", "id", "distance"))
