"""Queries of the operators for training text, and their SQL where SQL can express them."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quarryline.llm import encoding, history, mixing, neardup, packing, pages, repeated


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return pages.frame_lines(_t(spark, d, "fetch_result"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return repeated.repeated_lines(_t(spark, d, "fetch_result"))


def p3_boilerplate(spark: SparkSession, d: str) -> DataFrame:
    """Repeated lines of at least ten distinct texts and three days: a republished article's lines are none."""
    return repeated.repeated_lines(_t(spark, d, "fetch_result"), min_clusters=10, min_days=3)


def p3_clean(spark: SparkSession, d: str) -> DataFrame:
    """Every record's content without its site's boilerplate."""
    return repeated.without_repeated(_t(spark, d, "fetch_result"), p3_boilerplate(spark, d))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return neardup.group_pairs(neardup.near_duplicates(_t(spark, d, "fetch_result")))


def p5_groups(spark: SparkSession, d: str) -> DataFrame:
    return neardup.near_duplicates(_t(spark, d, "fetch_result"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return history.repeats_of_history(_t(spark, d, "fetch_result"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return pages.residue(_t(spark, d, "fetch_result"))


def p8_packed(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack_documents(_t(spark, d, "documents"), _t(spark, d, "container_spec"))


def p8_fill(spark: SparkSession, d: str) -> DataFrame:
    return packing.fill_report(p8_packed(spark, d), _t(spark, d, "container_spec"))


def p9_mix(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix(_t(spark, d, "documents"), _t(spark, d, "source_target"))


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    return mixing.shares(p9_mix(spark, d), _t(spark, d, "source_target"))


def p9_half(spark: SparkSession, d: str) -> DataFrame:
    """A mix of half of all tokens: the exponent is bisected to the repetition limits."""
    return mixing.mix(_t(spark, d, "documents"), _t(spark, d, "source_target"), part=0.5)


def p9_half_shares(spark: SparkSession, d: str) -> DataFrame:
    return mixing.shares(p9_half(spark, d), _t(spark, d, "source_target"))


def p9_entropy_shares(spark: SparkSession, d: str) -> DataFrame:
    """Shares of a mix whose sources have 95 percent of the largest entropy."""
    return mixing.shares(mixing.mix(_t(spark, d, "documents"), _t(spark, d, "source_target"), entropy_at=0.95), _t(spark, d, "source_target"))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return encoding.mend_texts(_t(spark, d, "documents")).select("doc_id")


def p10_restored(spark: SparkSession, d: str) -> DataFrame:
    return encoding.mend_texts(_t(spark, d, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "p2_found": p2_found,
    "p3_found": p3_found,
    "p3_boilerplate": p3_boilerplate,
    "p3_clean": p3_clean,
    "p5_found": p5_found,
    "p5_groups": p5_groups,
    "p6_found": p6_found,
    "p7_found": p7_found,
    "p8_packed": p8_packed,
    "p8_fill": p8_fill,
    "p9_mix": p9_mix,
    "p9_shares": p9_shares,
    "p9_half": p9_half,
    "p9_half_shares": p9_half_shares,
    "p9_entropy_shares": p9_entropy_shares,
    "p10_found": p10_found,
    "p10_restored": p10_restored,
}

SQL: dict[str, str] = {}
