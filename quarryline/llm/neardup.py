"""Groups of near-duplicate articles by signature trees.

Each article (without frame lines) becomes a set of five-word shingles. Its
signature is a bitmap of its 32 smallest shingle hashes with its size; exact
copies are collapsed to one representative first.

Representatives are routed to trees by anchors, the smallest hashes of its
ten-word windows, so two similar articles meet in several trees. In a tree,
leaves hold up to 16 signatures ordered by size, inner nodes the OR of their
bitmaps and the range of sizes; a dual traversal of the tree with itself
prunes every node pair whose largest possible overlap is too small. What is
left is verified on bottom sketches of 64 shingle hashes (exact up to 64
shingles), linked, and linked records form groups.

An anchor of more than ``HOT`` representatives is split into chunks that share
two pivots, so no task holds an unbounded group. Its members that these links
leave in different groups are then compared whole, in a tree for each pair of
chunks.
"""

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarryline.llm.components import components
from quarryline.llm.pagemodel import body_mask, fit_line_weights, is_residue
from quarryline.llm.pages import map_records, page_parts
from quarryline.llm.units import no_zero_width
from quarryline.plans.lineage import cut

SHINGLE, WINDOW = 5, 10
ANCHORS, BITS, TOKENS, SKETCH = 10, 256, 32, 64
LEAF, HOT = 16, 1024
#: Least similarity (Jaccard on shingles): cases share well over half of their wording, others clearly less.
SIMILAR = 0.35

_P = np.uint64(0x9E3779B97F4A7C15)
_P5 = np.uint64(pow(0x9E3779B97F4A7C15, 5, 1 << 64))
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def _raw(codes: np.ndarray, k: int) -> np.ndarray:
    """Polynomial hashes of the windows of k codes, by doubling the window."""
    acc, size = codes, 1
    for bit in bin(k)[3:]:
        power = np.uint64(pow(int(_P), size, 1 << 64))
        acc, size = acc[: len(acc) - size] * power + acc[size:], 2 * size
        if bit == "1":
            acc, size = acc[:-1] * _P + codes[size:], size + 1
    return acc


def uniq(x: np.ndarray) -> np.ndarray:
    """Distinct values in order."""
    x = np.sort(x)
    keep = np.ones(len(x), dtype=bool)
    np.not_equal(x[1:], x[:-1], out=keep[1:])
    return x[keep]


def window_hashes(codes: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the windows of k words; of the whole text if it is shorter."""
    k = min(k, len(codes))
    return _mix(_raw(codes, k) + np.uint64(k))


_RUN = re.compile(r"[㐀-鿿぀-ヿ]+|[^\W_㐀-鿿぀-ヿ]+")


class Coder:
    """64-bit codes of the words of a text: the code point of a CJK sign, else a hash, kept in a bounded cache."""

    def __init__(self, size: int = 200_000):
        self.cache: dict[str, int] = {}
        self.size = size

    def __call__(self, text: str) -> np.ndarray:
        c = self.cache
        if len(c) > self.size:
            c.clear()
        out: list[int] = []
        for w in _RUN.findall(no_zero_width(text).lower()):
            if "぀" <= w[0] <= "鿿":
                out.extend(map(ord, w))
                continue
            v = c.get(w)
            if v is None:
                v = c[w] = xxhash.xxh3_64_intdigest(w)
            out.append(v)
        return np.array(out, dtype=np.uint64)


def signature(codes: np.ndarray) -> tuple[int, bytes, bytes, list[int]]:
    """(number of shingles, bitmap, sketch, anchors) of a coded text."""
    if len(codes) < WINDOW:
        short, wide = window_hashes(codes, SHINGLE), window_hashes(codes, WINDOW)
    else:
        raw = _raw(codes, SHINGLE)
        short = _mix(raw + np.uint64(SHINGLE))
        wide = _mix(raw[: len(codes) - WINDOW + 1] * _P5 + raw[SHINGLE:] + np.uint64(WINDOW))
    sh = uniq(short)
    bits = np.zeros(BITS, dtype=np.uint8)
    bits[(sh[:TOKENS] & np.uint64(BITS - 1)).astype(np.int64)] = 1
    anchors = uniq(np.partition(wide, 4 * ANCHORS)[: 4 * ANCHORS])[:ANCHORS].view(np.int64) if len(wide) > 4 * ANCHORS else uniq(wide)[:ANCHORS].view(np.int64)
    return len(sh), np.packbits(bits).tobytes(), (sh[:SKETCH] >> np.uint64(32)).astype("<u4").tobytes(), anchors.tolist()


def similarity(a: np.ndarray, b: np.ndarray, na: int, nb: int) -> float:
    """Jaccard similarity from bottom sketches; exact if both sets are within the sketch."""
    u = np.union1d(a, b)
    if na > SKETCH or nb > SKETCH:
        u = u[:SKETCH]
    both = np.intersect1d(a, b, assume_unique=False)
    return float(np.isin(u, both).sum()) / max(1, len(u))


def signatures(df: DataFrame) -> DataFrame:
    """(fetch_id, cls, n, bits, sketch, anchors) of the records that take part and have a main body."""
    weights = fit_line_weights()

    def make():
        model, index = page_parts(weights)
        code = Coder()

        def f(fetch_id, title, content, error):
            if not content or content.isspace():
                return []
            lines = content.split("\n")
            if is_residue(lines, content, title, error, model, index):
                return []
            keep = body_mask(lines, title, model)
            codes = code("\n".join([x for x, k in zip(lines, keep) if k]))
            if not len(codes):
                return []
            return [(fetch_id, xxhash.xxh3_64_intdigest(codes.tobytes()) - (1 << 63), *signature(codes))]

        return f

    return map_records(
        df,
        ("fetch_id", "title", "content", "error"),
        make,
        "fetch_id bigint, cls bigint, n int, bits binary, sketch binary, anchors array<bigint>",
        pa.schema([("fetch_id", pa.int64()), ("cls", pa.int64()), ("n", pa.int32()), ("bits", pa.binary()), ("sketch", pa.binary()), ("anchors", pa.list_(pa.int64()))]),
    )


_POP = np.array([bin(i).count("1") for i in range(256)], dtype=np.int32)


def _overlap(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Common bits of all pairs of rows of packed bitmaps."""
    return _POP[a[:, None, :] & b[None, :, :]].sum(axis=2, dtype=np.int32)


def least_common(similar: float) -> float:
    """Part of the signature's tokens that a similar pair has in common, less the spread of the sample."""
    return 0.7 * 2 * similar / (1 + similar)


class SignatureTree:
    """Tree over packed bitmaps ordered by size; nodes hold OR-combined bitmaps, size ranges and the fewest bits of a member."""

    def __init__(self, bits: np.ndarray, n: np.ndarray, fan: int = LEAF):
        self.order = np.argsort(n, kind="stable")
        self.bits, self.n, self.fan = bits[self.order], n[self.order], fan
        self.slack = TOKENS - _POP[self.bits].sum(axis=1)
        level = [(self.bits, self.n, self.n, self.slack)]
        while len(level[-1][0]) > fan:
            b, lo, hi, sl = level[-1]
            at = np.arange(0, len(b), fan)
            level.append((np.bitwise_or.reduceat(b, at, axis=0), np.minimum.reduceat(lo, at), np.maximum.reduceat(hi, at), np.maximum.reduceat(sl, at)))
        self.levels = level

    def pairs(self, similar: float = SIMILAR) -> list[tuple[int, int]]:
        """Pairs of rows whose signatures may be similar: dual traversal from the root."""
        out: list[tuple[int, int]] = []
        top = len(self.levels) - 1
        stack = [(top, 0, 0)]
        while stack:
            k, u, v = stack.pop()
            b, lo, hi, sl = self.levels[k]
            whole = k == top
            us = slice(0, len(b)) if whole else slice(u * self.fan, (u + 1) * self.fan)
            vs = slice(0, len(b)) if whole else slice(v * self.fan, (v + 1) * self.fan)
            most = _overlap(b[us], b[vs]) + np.minimum(sl[us][:, None], sl[vs][None, :])
            need = np.minimum(TOKENS, np.minimum(hi[us][:, None], hi[vs][None, :])) * least_common(similar)
            near = (np.minimum(hi[us][:, None] / lo[vs][None, :], hi[vs][None, :] / lo[us][:, None]) >= similar * 0.9) & (most >= need)
            for i, j in zip(*np.nonzero(near)):
                gi, gj = int(i) + us.start, int(j) + vs.start
                if k == 0:
                    if gi < gj:
                        out.append((int(self.order[gi]), int(self.order[gj])))
                elif gi <= gj:
                    stack.append((k - 1, gi, gj))
        return out


def _tree_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Candidate pairs of rows (key, rep, n, bits) sorted by key; of rows (key, rep, n, bits, label) only those of different labels."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])
    carry = None
    width = BITS // 8

    def work(key, rep, n, bits, label):
        cuts = np.flatnonzero(np.diff(key)) + 1
        starts = np.concatenate([[0], cuts])
        sizes = np.diff(np.concatenate([starts, [len(key)]]))
        left, right = [], []
        two = starts[sizes == 2]
        if len(two):
            most = _POP[bits[two] & bits[two + 1]].sum(axis=1) + TOKENS - np.maximum(_POP[bits[two]].sum(axis=1), _POP[bits[two + 1]].sum(axis=1))
            lo, hi = np.minimum(n[two], n[two + 1]), np.maximum(n[two], n[two + 1])
            ok = two[(most >= np.minimum(TOKENS, lo) * least_common(SIMILAR)) & (lo / hi >= SIMILAR * 0.9) & (label[two] != label[two + 1])]
            left.append(rep[ok])
            right.append(rep[ok + 1])
        for s, m in zip(starts[sizes > 2], sizes[sizes > 2]):
            ps = SignatureTree(bits[s : s + m], n[s : s + m]).pairs()
            if ps:
                x = np.array(ps) + s
                x = x[label[x[:, 0]] != label[x[:, 1]]]
                left.append(rep[x[:, 0]])
                right.append(rep[x[:, 1]])
        if not left:
            return None
        x, y = np.concatenate(left), np.concatenate(right)
        p = np.unique(np.stack([np.minimum(x, y), np.maximum(x, y)], axis=1), axis=0)
        p = p[p[:, 0] != p[:, 1]]
        return pa.RecordBatch.from_arrays([pa.array(p[:, 0]), pa.array(p[:, 1])], schema=schema)

    for b in batches:
        if not b.num_rows:
            continue
        cols = [b.column(0).to_numpy(zero_copy_only=False), b.column(1).to_numpy(zero_copy_only=False), b.column(2).to_numpy(zero_copy_only=False), np.frombuffer(b"".join(b.column(3).to_pylist()), dtype=np.uint8).reshape(-1, width)]
        cols.append(b.column(4).to_numpy(zero_copy_only=False) if b.num_columns > 4 else cols[1])
        if carry is not None:
            cols = [np.concatenate([x, y]) for x, y in zip(carry, cols)]
        last = int(np.searchsorted(cols[0], cols[0][-1], side="left"))
        carry = [x[last:] for x in cols]
        if last and (got := work(*[x[:last] for x in cols])) is not None:
            yield got
    if carry is not None and (got := work(*carry)) is not None:
        yield got


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])
    for t in batches:
        a, b, na, nb = (t.column(i).to_pylist() for i in range(4))
        sa, sb = t.column(4).to_pylist(), t.column(5).to_pylist()
        ok = [i for i in range(len(a)) if similarity(np.frombuffer(sa[i], "<u4"), np.frombuffer(sb[i], "<u4"), na[i], nb[i]) >= SIMILAR]
        yield pa.RecordBatch.from_arrays([pa.array([a[i] for i in ok], pa.int64()), pa.array([b[i] for i in ok], pa.int64())], schema=schema)


def hot_members(reps: DataFrame, hot: int = HOT) -> DataFrame | None:
    """(anchor, m, p1, p2, rep, n, bits) of the anchors of more than ``hot`` representatives: their number and two pivots; None if there are none."""
    rows = reps.select(F.explode("anchors").alias("anchor"), "rep", "n", "bits")
    many = cut(rows.groupBy("anchor").agg(F.count("*").alias("m")).where(F.col("m") > hot))
    if many.isEmpty():
        return None
    rows = cut(rows.join(F.broadcast(many), "anchor"))  # at most a row for each ``hot`` rows of anchors
    return rows.join(rows.groupBy("anchor").agg(F.min("rep").alias("p1"), F.max("rep").alias("p2")), "anchor")


def candidate_pairs(reps: DataFrame, hot: int = HOT) -> DataFrame:
    """Distinct pairs (a, b) of representatives (rep, n, bits, anchors) that the signature trees leave."""
    return _candidates(reps, hot_members(reps, hot), hot)


def _candidates(reps: DataFrame, members: DataFrame | None, hot: int) -> DataFrame:
    rows = reps.select(F.explode("anchors").alias("key"), "rep", "n", "bits")
    if members is not None:
        chunks = F.ceil(F.col("m") * 2 / hot).cast("int")
        chunk = (
            F.when((F.col("rep") == F.col("p1")) | (F.col("rep") == F.col("p2")), F.sequence(F.lit(0), chunks - 1))
            .otherwise(F.array(F.pmod(F.xxhash64("rep"), chunks.cast("long")).cast("int")))
        )
        split = members.select("anchor", F.explode(chunk).alias("chunk"), "rep", "n", "bits").select(F.xxhash64("anchor", "chunk").alias("key"), "rep", "n", "bits")
        rows = rows.join(F.broadcast(members.select(F.col("anchor").alias("key")).distinct()), "key", "left_anti").unionByName(split)
    rows = rows.repartition("key").sortWithinPartitions("key")
    return rows.mapInArrow(_tree_pairs, "a bigint, b bigint").distinct()


def hot_pairs(members: DataFrame, links: DataFrame, hot: int = HOT) -> DataFrame:
    """Pairs (a, b) of ``hot_members`` whom ``links`` leave in different groups.

    A member goes to the blocks of its chunk with every chunk, so any two meet
    in one block of bounded size.
    """
    rows = members.select("anchor", "m", "rep", "n", "bits").join(components(links).select(F.col("id").alias("rep"), "label"), "rep", "left").withColumn("label", F.coalesce("label", "rep"))
    rows = cut(rows)
    mixed = rows.groupBy("anchor").agg(F.min("label").alias("x"), F.max("label").alias("y")).where("x <> y").select("anchor")
    chunks = F.ceil(F.col("m") * 2 / hot).cast("int")
    rows = rows.join(mixed, "anchor").withColumn("own", F.pmod(F.xxhash64("anchor", "rep"), chunks.cast("long")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), chunks - 1)))
    rows = rows.select(F.xxhash64("anchor", F.least("own", "other"), F.greatest("own", "other")).alias("key"), "rep", "n", "bits", "label").repartition("key").sortWithinPartitions("key")
    return rows.mapInArrow(_tree_pairs, "a bigint, b bigint").distinct()


def similar_links(reps: DataFrame, sketches: DataFrame, hot: int = HOT) -> DataFrame:
    """Verified links (a, b) that join all similar representatives; ``sketches`` are rows (fetch_id, n, sketch)."""
    members = hot_members(reps, hot)
    pairs = cut(_candidates(reps, members, hot))
    # All sketches are shuffled once: those of hot anchors' members are taken along for their later pairs.
    used = pairs.select(F.explode(F.array("a", "b")).alias("fetch_id"))
    used = (used if members is None else used.unionAll(members.select("rep"))).distinct()
    sk = cut(sketches.join(used, "fetch_id", "left_semi").dropDuplicates(["fetch_id"]))
    a = sk.select(F.col("fetch_id").alias("a"), F.col("n").alias("na"), F.col("sketch").alias("sa"))
    b = sk.select(F.col("fetch_id").alias("b"), F.col("n").alias("nb"), F.col("sketch").alias("sb"))

    def verified(pairs: DataFrame) -> DataFrame:
        return cut(pairs.join(a, "a").join(b, "b").select("a", "b", "na", "nb", "sa", "sb").mapInArrow(_verify, "a bigint, b bigint"))

    links = verified(pairs)
    return links if members is None else links.unionByName(verified(cut(hot_pairs(members, links, hot))))


def near_duplicates(df: DataFrame) -> DataFrame:
    """(fetch_id, group, copies_of) for every record that takes part and has a main body.

    ``copies_of`` is the smallest fetch_id with the same article text; ``group``
    the smallest fetch_id of the records linked by near-duplicate articles,
    itself for records without a partner. Pages without a main body, residue
    and blank contents are left out. Null titles and errors are treated as
    missing.
    """
    sig = cut(signatures(df))
    same = sig.groupBy("cls").agg(F.min("fetch_id").alias("rep"))
    reps = sig.select(F.col("fetch_id").alias("rep"), "n", "bits", "anchors").join(same.select("rep"), "rep", "left_semi").dropDuplicates(["rep"])
    reps = cut(reps)  # else each of its uses shuffles all signatures again
    links = similar_links(reps, sig.select("fetch_id", "n", "sketch"))
    group = components(links)
    member = sig.select("fetch_id", "cls").join(same, "cls").select("fetch_id", F.col("rep").alias("copies_of"))
    return member.join(group.select(F.col("id").alias("copies_of"), "label"), "copies_of", "left").select("fetch_id", F.coalesce("label", "copies_of").alias("group"), "copies_of")


def group_pairs(groups: DataFrame) -> DataFrame:
    """(fetch_id_a, fetch_id_b), a < b: all pairs of each group, unchanged copies too."""
    some = groups.groupBy("group").agg(F.count("*").alias("m")).where("m > 1").select("group")
    g = cut(groups.join(some, "group", "left_semi").select("group", "fetch_id"))
    b = g.select("group", F.col("fetch_id").alias("fetch_id_b"))
    return g.select("group", F.col("fetch_id").alias("fetch_id_a")).join(b, "group").where("fetch_id_a < fetch_id_b").select("fetch_id_a", "fetch_id_b")
