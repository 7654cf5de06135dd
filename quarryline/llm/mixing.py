"""Mixing sources to target shares of the total size.

Shares are raised to an exponent and normalised (temperature mixing); the
exponent is bisected to the largest one, at most 1, at which the wanted total
respects every source's repetition limit, or to a target entropy. The weights
are realised as budgeted block permutations: each source is put in a seeded
random order, gone through as often as its budget asks, and cut into blocks, so
each block of the mix holds all sources by their weights.
"""

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarryline.functions.text import blank_to_null
from quarryline.llm.tokens import VOCABULARY, token_counts
from quarryline.operators.prefix import running_sum
from quarryline.plans.lineage import cut

BLOCKS = 100


def temper(shares: dict[str, float], exponent: float) -> dict[str, float]:
    """Shares raised to the exponent and normalised; empty shares stay empty."""
    p = {k: s**exponent for k, s in shares.items() if s > 0}
    z = sum(p.values()) or 1.0
    return {k: p.get(k, 0.0) / z for k in shares}


def entropy(shares: dict[str, float]) -> float:
    return -sum(p * math.log(p) for p in shares.values() if p > 0)


def bisect_entropy(shares: dict[str, float], target: float, rounds: int = 60) -> float:
    """Exponent in [0, 8] whose tempered shares have the target entropy (entropy falls with the exponent)."""
    lo, hi = 0.0, 8.0
    for _ in range(rounds):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if entropy(temper(shares, mid)) > target else (lo, mid)
    return (lo + hi) / 2


def budget(
    tokens: dict[str, int], target: dict[str, float], repeats: dict[str, int], total: float | None = None, entropy_at: float | None = None, rounds: int = 60
) -> tuple[dict[str, float], float, float]:
    """(weights, total, exponent) for sources with tokens.

    Without ``total`` the weights are the targets (exponent 1) and the total
    the largest that keeps all repetition limits. With it the targets are
    multiplied by ``(natural / target) ** (1 - exponent)``: the largest
    exponent at which the total is within the limits is bisected; if none is,
    exponent 0 (natural shares) and the largest possible total are taken. With
    ``entropy_at`` the weights are the sources' own token shares raised to the
    exponent at which their entropy is that part of the largest possible one.
    """
    live = {k: t for k, t in tokens.items() if t > 0 and target.get(k, 0) > 0 and repeats.get(k, 0) > 0}
    z, n = sum(target[k] for k in live), sum(live.values())
    if not live:
        return {}, 0.0, 1.0
    want = {k: target[k] / z for k in live}

    def weights(x: float) -> dict[str, float]:
        q = {k: want[k] ** x * (live[k] / n) ** (1 - x) for k in live}
        s = sum(q.values())
        return {k: v / s for k, v in q.items()}

    def most(w: dict[str, float]) -> float:
        return min(repeats[k] * live[k] / w[k] for k in live)

    if entropy_at is not None:
        natural = {k: live[k] / n for k in live}
        x = bisect_entropy(natural, entropy_at * math.log(len(live)))
        w = temper(natural, x)
        return w, most(w) if total is None else min(total, most(w)), x
    if total is None or most(want) >= total:
        return want, most(want) if total is None else total, 1.0
    lo, hi = 0.0, 1.0
    if most(weights(0.0)) < total:
        return weights(0.0), most(weights(0.0)), 0.0
    for _ in range(rounds):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if most(weights(mid)) >= total else (lo, mid)
    return weights(lo), total, lo


def sized_sources(docs: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """(doc_id, tokens, source): source trimmed and in lower case, null if blank."""
    return token_counts(docs.withColumn("source", F.lower(blank_to_null(F.col("source")))), "doc_id", "text", path, ("source",))


def mix(
    docs: DataFrame, target: DataFrame, total: float | None = None, seed: int = 1, path: str = VOCABULARY, blocks: int = BLOCKS, part: float | None = None, entropy_at: float | None = None
) -> DataFrame:
    """(block, source, doc_id, use, tokens): every use of a document in the mix.

    ``total`` is the wanted size in tokens, ``part`` the same as a part of the
    live tokens, ``entropy_at`` a target entropy (see ``budget``).

    ``use`` counts a document's uses from 1, never beyond the source's
    max_repeats. Documents without tokens, with a null or blank source or with
    one that has no target are left out; targets without documents are left
    out and the others' shares keep their proportions.
    """
    goal = {r["source"].strip().lower(): r for r in target.where("source is not null").collect()}  # one row per source
    sized = cut(sized_sources(docs, path).where("tokens > 0 and source is not null"))
    sized = sized.where(F.col("source").isin(list(goal)))
    have = {r["source"]: int(r["t"]) for r in sized.groupBy("source").agg(F.sum("tokens").alias("t")).collect()}  # at most one row per target
    total = total if part is None else part * sum(have.values())
    w, whole, _ = budget(have, {k: float(r["target_share"] or 0) for k, r in goal.items()}, {k: int(r["max_repeats"] or 0) for k, r in goal.items()}, total, entropy_at)
    if not w:
        return sized.select(F.lit(0).cast("bigint").alias("block"), "source", "doc_id", F.lit(1).cast("bigint").alias("use"), "tokens").limit(0)
    plan = docs.sparkSession.createDataFrame([(k, float(have[k]), float(w[k] * whole)) for k in w], "source string, have double, budget double")
    order = running_sum(sized.withColumn("__h", F.xxhash64("doc_id", F.lit(seed))), ["source"], ["__h", "doc_id"], "tokens")
    x = order.join(F.broadcast(plan), "source")  # one row per target source
    # Pass k puts the document's middle at k * have + before + tokens / 2; it is used while that is within the budget.
    middle = F.col("before") + F.col("tokens") / 2
    passes = F.floor((F.col("budget") - middle) / F.col("have")) + 1
    x = x.withColumn("passes", passes.cast("bigint")).where("passes > 0").select("source", "doc_id", "tokens", "have", "budget", middle.alias("middle"), F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("passes"))).alias("use"))
    at = ((F.col("use") - 1) * F.col("have") + F.col("middle")) / F.col("budget")
    return x.select(F.least(F.floor(at * blocks), F.lit(blocks - 1)).cast("bigint").alias("block"), "source", "doc_id", "use", "tokens")


def shares(mixed: DataFrame, target: DataFrame) -> DataFrame:
    """(source, target_share, max_repeats, tokens, share, most_uses): the shares reached; all targets come out."""
    by = mixed.groupBy("source").agg(F.sum("tokens").alias("tokens"), F.max("use").alias("most_uses"))
    by = by.crossJoin(by.agg(F.sum("tokens").alias("__all")))  # one row
    t = target.select(F.lower(blank_to_null(F.col("source"))).alias("source"), "target_share", "max_repeats")
    return t.join(by, "source", "left").select(
        "source", "target_share", "max_repeats", F.coalesce("tokens", F.lit(0)).alias("tokens"), F.coalesce(F.col("tokens") / F.col("__all"), F.lit(0.0)).alias("share"), F.coalesce("most_uses", F.lit(0)).alias("most_uses")
    )
