"""Keyword search in texts, cleaning of texts, all with built-in functions."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _quote(word: str) -> str:
    return "\\Q" + word.replace("\\E", "\\E\\\\E\\Q") + "\\E"


def match_count(text: Column, word: str) -> Column:
    """Number of non-overlapping matches, letter case ignored; 0 for null and for an empty word."""
    if not word:
        return F.lit(0).cast("bigint")
    return (F.size(F.split(F.lower(F.coalesce(text, F.lit(""))), _quote(word.lower()), -1)) - 1).cast("bigint")


def match_positions(text: Column, word: str) -> Column:
    """Zero-based code-point positions of the matches, as an array."""
    if not word:
        return F.array().cast("array<bigint>")
    parts = F.split(F.lower(F.coalesce(text, F.lit(""))), _quote(word.lower()), -1)
    k = len(word)
    state = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast("array<bigint>").alias("out"))
    return F.aggregate(
        F.slice(parts, 1, F.size(parts) - 1), state, lambda s, p: F.struct((s["at"] + F.length(p) + k).cast("bigint").alias("at"), F.concat(s["out"], F.array((s["at"] + F.length(p)).cast("bigint"))).alias("out")), lambda s: s["out"]
    )


def snippet(text: Column, position: Column, word: str, around: int = 100) -> Column:
    """Text around a position, white runs as one blank, every hit marked by the query's spelling in 【】."""
    start = F.greatest(position - around, F.lit(0))
    part = F.substring(text, (start + 1).cast("int"), (F.least(position, F.lit(around)) + around + len(word)).cast("int"))
    flat = F.trim(F.regexp_replace(part, r"(?U)\s+", " "))
    return F.regexp_replace(flat, F.lit("(?iu)" + _quote(word)), F.lit("【" + word.replace("\\", "\\\\").replace("$", "\\$") + "】"))


def search(docs: DataFrame, key: str, text: str, word: str, most: int = 3, around: int = 100) -> DataFrame:
    """(key, position, context) of the first matches of each text; texts without a match give no row."""
    found = docs.where(F.lower(F.col(text)).contains(word.lower())) if word else docs.limit(0)
    return found.select(key, text, F.explode(F.slice(match_positions(F.col(text), word), 1, most)).alias("position")).select(key, "position", snippet(F.col(text), F.col("position"), word, around).alias("context"))


def search_counters(docs: DataFrame, text: str, word: str, largest: int) -> DataFrame:
    """One row: texts in all, scanned, matched and skipped because longer than ``largest`` signs."""
    n = F.length(F.coalesce(text, F.lit("")))
    return docs.agg(F.count("*").alias("total"), F.count_if(n <= largest).alias("scanned"), F.count_if((n <= largest) & (match_count(F.col(text), word) > 0)).alias("matched"), F.count_if(n > largest).alias("skipped_large"))


def clean_text(c: Column) -> Column:
    """Without zero-width signs and yen signs; blanks of all kinds merged, at most one empty line, trimmed."""
    c = F.regexp_replace(c, "[\\u200b-\\u200f\\u2028-\\u202f\\ufeff\\u00ad]", "")
    c = F.translate(c, " ", " ")
    c = F.translate(c, "¥￥", "")
    c = F.regexp_replace(c, "[\\u2002-\\u200a]", " ")
    c = F.regexp_replace(c, "[ \\t]+", " ")
    c = F.regexp_replace(c, "\\n{3,}", "\n\n")
    c = F.regexp_replace(c, " *\\n *", "\n")
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def without_ad_lines(c: Column, words: tuple[str, ...], domains: tuple[str, ...], short: int = 50) -> Column:
    """Lines trimmed; short lines with an advertising word and lines with an advertising address dropped, empty lines kept."""
    lines = F.transform(F.split(c, "\n", -1), F.trim)
    has = lambda x, ps: F.exists(F.array(*map(F.lit, ps)), lambda p: F.lower(x).contains(p)) if ps else F.lit(False)
    return F.array_join(F.filter(lines, lambda x: (x == "") | ~((has(x, words) & (F.length(x) < short)) | (has(x, domains) & F.lower(x).contains("http")))), "\n")


def short_line_filter(c: Column, longest: int = 50_000) -> Column:
    """Non-empty trimmed lines of more than 3 signs or with a list mark; longer texts are cut with a mark."""
    lines = F.filter(F.transform(F.split(c, "\n", -1), F.trim), lambda x: (x != "") & ((F.length(x) > 3) | x.rlike(r"^([-*•]|\d+[.、])")))
    t = F.array_join(lines, "\n")
    return F.when(F.length(t) > longest, F.concat(F.substring(t, 1, longest), F.lit("\n...(内容过长，已截断)"))).otherwise(t)


def strip_tags(c: Column) -> Column:
    """HTML without script, style and tags, white runs as one blank."""
    c = F.regexp_replace(c, r"(?is)<(script|style)[^>]*>.*?</\1>", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(c, r"<[^>]+>", " "), r"\s+", " "))


def html_title(c: Column) -> Column:
    return F.nullif(F.trim(F.regexp_extract(c, r"(?is)<title[^>]*>(.*?)</title>", 1)), F.lit(""))


def html_links(c: Column, base: Column) -> Column:
    """Hrefs of a page as absolute urls: root-relative ones on the base's host; other relative ones are left out."""
    host = F.regexp_extract(base, r"^(https?://[^/?#]+)", 1)
    hrefs = F.regexp_extract_all(c, F.lit(r"(?i)<a\b[^>]*\bhref\s*=\s*[\"']([^\"']+)[\"']"), 1)
    return F.filter(F.transform(hrefs, lambda h: F.when(h.rlike("^https?://"), h).when(h.startswith("/") & ~h.startswith("//"), F.concat(host, h))), lambda h: h.isNotNull())


def file_name(c: Column, longest: int = 50) -> Column:
    """Name with the nine signs that file systems refuse replaced by _, cut to a length."""
    return F.substring(F.translate(c, '\\/:*?"<>|', "_________"), 1, longest)


def short_hash(c: Column, n: int = 8) -> Column:
    return F.substring(F.md5(c), 1, n)


def header_field(c: Column, label: str, lines: int = 10) -> Column:
    """Last value of ``label:`` among the first lines; null if missing."""
    rows = F.slice(F.split(c, "\n", -1), 1, lines)
    hit = F.filter(rows, lambda x: x.rlike(f"^{label}[:：]"))
    return F.trim(F.regexp_replace(F.get(hit, F.size(hit) - 1), f"^{label}[:：]", ""))


def heading(c: Column) -> Column:
    """First level-one Markdown heading."""
    return F.nullif(F.regexp_extract(c, r"(?m)^#\s+(.+)$", 1), F.lit(""))


def best_percent(rows: DataFrame, score: str, key: str, percent: int, least: float) -> DataFrame:
    """The best ``percent`` of the rows of those with ``score`` of at least ``least``; one row if that is none. Ties by key.

    The rows above the border score are kept by a filter; only rows that tie
    on the border are ranked, by distributed sums, so nothing is sorted as a
    whole. Scores are counted per value: they have few decimals. An empty table
    gives no rows; null scores come last.
    """
    from quarryline.operators.prefix import running_sum
    from quarryline.plans.lineage import cut

    x = cut(rows)
    by = x.groupBy(score).agg(F.count("*").alias("n")).orderBy(F.desc_nulls_last(score)).toLocalIterator()
    total, good, above, border, seen = x.count(), x.where(F.col(score) >= least).count(), 0, None, 0
    k = max(1, min(max(1, total * percent // 100), good))
    for r in by:  # one row per score, read only as far as the border
        above, border, seen = seen, r[score], seen + r["n"]
        if seen >= k:
            break
    tied = x.where(F.col(score).eqNullSafe(F.lit(border)))
    over = x.where(F.col(score) > border) if border is not None else x.where(F.col(score).isNotNull())
    return over.unionByName(running_sum(tied.withColumn("__g", F.lit(0)), ["__g"], [key], name="__r").where(F.col("__r") < k - above).select(*x.columns))


def character_budget(docs: DataFrame, order: str, text: str, most: int = 15_000, each: int = 3_000) -> DataFrame:
    """(order, chars_before) of rows taken in order while the signs before (at most ``each`` a row) are below the budget.

    Texts become lengths before anything moves. Only the first rows can fit:
    those are the rows up to the ``most``-th of them with signs, a bound that
    does not grow with the table, found by a top-k. Rows without signs before
    it are kept, too. The sums are distributed (``running_sum``).
    """
    from quarryline.operators.prefix import running_sum

    x = docs.select(order, F.least(F.length(F.coalesce(text, F.lit(""))), F.lit(each)).alias("__n"), F.lit(0).alias("__g"))
    last = x.where("__n > 0").orderBy(order).limit(most).agg(F.count("*").alias("m"), F.max(order).alias("last")).first()
    if last["m"] >= most:
        x = x.where((F.col(order) <= F.lit(last["last"])) | F.col(order).isNull())
    return running_sum(x, ["__g"], [order], "__n", "chars_before").where(F.col("chars_before") < most).select(order, "chars_before")


def table_islands(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, island, first_line, lines): runs of two or more lines of a text that look like table rows."""
    row = lambda x: (F.trim(x) != "") & (((F.length(x) - F.length(F.translate(x, "\t", ""))) >= 2) | (F.regexp_count(x, F.lit(" {3,}")) >= 2) | x.rlike(r"^\s*\|.*\|\s*$"))
    x = docs.select(key, F.posexplode(F.split(text, "\n", -1)).alias("i", "x")).where(row(F.col("x")))
    w = Window.partitionBy(key).orderBy("i")
    g = x.withColumn("g", F.col("i") - F.row_number().over(w))
    return g.groupBy(key, "g").agg(F.min("i").cast("bigint").alias("first_line"), F.count("*").alias("lines")).where("lines >= 2").select(key, "first_line", "lines")
