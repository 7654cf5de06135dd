"""Filling containers of fixed capacity with whole documents.

Only the sizes of the documents decide, and there are at most ``capacity``
different ones, so the packing is computed on the histogram of sizes, whatever
the number of documents: Martello-Toth dominance reduction fixes containers
that no other filling can beat, best-fit by falling size places the rest, equal
containers being handled as one group with a count. The documents then take
their places by their rank among the documents of the same size, which running
sums give without gathering a size in one task.
"""

from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarryline.llm.tokens import VOCABULARY, token_counts
from quarryline.operators.prefix import running_sum


def reduce_dominated(sizes: dict[int, int], capacity: int) -> tuple[list[tuple[tuple[int, ...], int]], dict[int, int]]:
    """Martello-Toth reduction on a histogram of sizes: (fixed fillings with counts, what is left).

    By falling size w, with room r = capacity - w: w alone is fixed if nothing
    fits beside it; w with an item of exactly r; w with its largest partner p
    if no two items fit into r together, or if the two largest that do are not
    larger than p, and no three fit (each other filling is dominated by {w, p}).
    """
    left = {k: n for k, n in sizes.items() if n > 0}
    keys = sorted(left)
    fixed: list[tuple[tuple[int, ...], int]] = []

    def take(w: int, n: int) -> None:
        left[w] -= n
        if not left[w]:
            del left[w]
            del keys[bisect_left(keys, w)]

    def smallest(k: int) -> int:
        """Sum of the k smallest items."""
        total = 0
        for x in keys:
            m = min(k, left[x])
            total += m * x
            k -= m
            if not k:
                return total
        return capacity + 1

    for w in sorted(sizes, reverse=True):
        while w in left:
            room = capacity - w
            # The smallest beside one item of size w itself.
            low = keys[0] if keys[0] != w or left[w] > 1 else (keys[1] if len(keys) > 1 else capacity + 1)
            if low > room:
                fixed.append(((w,), left[w]))
                take(w, left[w])
                continue
            p = keys[bisect_right(keys, room) - 1]
            if p == w and left[w] < 2:
                i = bisect_left(keys, w)
                p = keys[i - 1] if i else 0
                if not p:
                    break
            n = left[w] // 2 if p == w else min(left[w], left[p])
            if p == room or smallest(2) > room:
                pass
            elif smallest(3) > room and _largest_pair(keys, left, room) <= p:
                pass
            else:
                break
            fixed.append(((w, p), n))
            take(w, n)
            if p in left:
                take(p, min(n, left[p]))
    return fixed, left


def _largest_pair(keys: list[int], left: dict[int, int], room: int) -> int:
    """Largest sum of two items that fit into the room; 0 if none do."""
    best, i, j = 0, 0, bisect_right(keys, room) - 1
    while i <= j:
        s = keys[i] + keys[j]
        if s > room or i == j and left[keys[i]] < 2:
            j -= 1
        else:
            best = max(best, s)
            i += 1
    return best


def best_fit(left: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Best-fit by falling size on a histogram; equal containers are one group."""
    rooms: dict[int, list[tuple[tuple[int, ...], int]]] = {}
    order: list[int] = []

    def put(room: int, items: tuple[int, ...], n: int) -> None:
        if room not in rooms:
            rooms[room] = []
            insort(order, room)
        rooms[room].append((items, n))

    done: list[tuple[tuple[int, ...], int]] = []
    low = min(left, default=0)
    for w in sorted(left, reverse=True):
        n = left[w]
        while n:
            i = bisect_left(order, w)
            if i == len(order):
                each = capacity // w
                if n >= each:
                    m, n = n // each, n % each
                    put(capacity - each * w, (w,) * each, m)
                else:
                    put(capacity - n * w, (w,) * n, 1)
                    n = 0
                continue
            room = order[i]
            items, m = rooms[room].pop()
            if not rooms[room]:
                del rooms[room]
                order.pop(i)
            k = min(m, n)
            n -= k
            if m > k:
                put(room, items, m - k)
            if room - w < low:
                done.append(((*items, w), k))
            else:
                put(room - w, (*items, w), k)
    for groups in rooms.values():
        done += groups
    return done


def fixed_containers(sizes: dict[int, int], capacity: int) -> tuple[int, int]:
    """(containers that the reduction fixes, those of them with more than one item)."""
    fixed, _ = reduce_dominated(sizes, capacity)
    return sum(n for _, n in fixed), sum(n for items, n in fixed if len(items) > 1)


def plan(sizes: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Fillings (sizes of a container, number of such containers) for a histogram of sizes up to the capacity."""
    fixed, left = reduce_dominated(sizes, capacity)
    return fixed + best_fit(left, capacity)


def _places(fillings: list[tuple[tuple[int, ...], int]]) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """For each size: starts of rank intervals and the container of each interval's first rank."""
    out: dict[int, tuple[list[int], list[int]]] = {}
    nxt: dict[int, int] = {}
    base = 0
    for items, n in fillings:
        for w in items:
            starts, first = out.setdefault(w, ([], []))
            starts.append(nxt.get(w, 0))
            first.append(base)
            nxt[w] = nxt.get(w, 0) + n
        base += n
    return {w: (np.array(a, np.int64), np.array(b, np.int64)) for w, (a, b) in out.items()}


def pieces(items: DataFrame, capacity: int) -> DataFrame:
    """(doc_id, piece, start, size): whole items, or for items beyond the capacity consecutive pieces."""
    c = F.lit(capacity).cast("bigint")
    return items.where("tokens > 0").select("doc_id", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("tokens") - 1) / c))).alias("piece"), "tokens").select(
        "doc_id", "piece", (F.col("piece") * c).alias("start"), F.least(c, F.col("tokens") - F.col("piece") * c).alias("size")
    )


def pack(items: DataFrame, capacity: int, kind: str) -> DataFrame:
    """(container_kind, container_id, doc_id, piece, start, size) of every item (doc_id, tokens).

    Items without tokens need no container; repeated ids are separate items.
    """
    parts = pieces(items, capacity)
    sizes = {int(r["size"]): int(r["n"]) for r in parts.groupBy("size").agg(F.count("*").alias("n")).collect()}  # at most `capacity` rows
    places = items.sparkSession.sparkContext.broadcast(_places(plan(sizes, capacity)))
    ranked = running_sum(parts, ["size"], ["doc_id", "piece"], name="rank")
    names = ["doc_id", "piece", "start", "size", "container_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = places.value
        for b in batches:
            size, rank = (b.column(b.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in ("size", "rank"))
            box = np.zeros(len(size), np.int64)
            order = np.argsort(size, kind="stable")
            cuts = np.flatnonzero(np.diff(size[order])) + 1
            for idx in np.split(order, cuts) if len(order) else ():
                starts, first = at[int(size[idx[0]])]
                i = np.searchsorted(starts, rank[idx], side="right") - 1
                box[idx] = first[i] + rank[idx] - starts[i]
            yield pa.RecordBatch.from_arrays([*(b.column(b.schema.get_field_index(c)) for c in names[:4]), pa.array(box)], names=names)

    out = ranked.mapInArrow(run, "doc_id bigint, piece bigint, start bigint, size bigint, container_id bigint")
    return out.select(F.lit(kind).alias("container_kind"), "container_id", "doc_id", "piece", "start", "size")


def pack_documents(docs: DataFrame, spec: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """Documents packed for each kind of container in ``spec`` (a small table of kinds)."""
    from functools import reduce

    from quarryline.plans.lineage import cut

    items = cut(token_counts(docs, "doc_id", "text", path))
    kinds = spec.where("capacity_tokens > 0").orderBy("container_kind").collect()
    return reduce(DataFrame.unionByName, [pack(items, int(k["capacity_tokens"]), k["container_kind"]) for k in kinds])


def fill_report(packed: DataFrame, spec: DataFrame) -> DataFrame:
    """(container_kind, containers, tokens, fill, least, fixed, fixed_several) of packed documents.

    ``least`` is the lower bound on containers by total size, ``fixed`` the
    containers that the dominance reduction decided, ``fixed_several`` those of
    them with more than one item.
    """
    spec = spec.select("container_kind", "capacity_tokens")
    sizes: dict[str, dict[int, int]] = {}
    for r in packed.groupBy("container_kind", "size").agg(F.count("*").alias("n")).collect():  # at most `capacity` rows a kind
        sizes.setdefault(r["container_kind"], {})[int(r["size"])] = int(r["n"])
    kinds = [(r["container_kind"], *fixed_containers(sizes.get(r["container_kind"], {}), int(r["capacity_tokens"]))) for r in spec.where("capacity_tokens > 0").collect()]
    fixed = packed.sparkSession.createDataFrame(kinds, "container_kind string, fixed bigint, fixed_several bigint")
    by = packed.groupBy("container_kind").agg(F.countDistinct("container_id").alias("containers"), F.sum("size").alias("tokens"))
    return by.join(F.broadcast(spec), "container_kind").join(F.broadcast(fixed), "container_kind").select(  # one row per kind
        "container_kind", "containers", "tokens", F.round(F.col("tokens") / (F.col("containers") * F.col("capacity_tokens")), 4).alias("fill"), F.ceil(F.col("tokens") / F.col("capacity_tokens")).alias("least"), "fixed", "fixed_several"
    )
