"""Sparse sheets: cell keys, values, dense grids, Markdown tables."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def cell_position(key: Column) -> Column:
    """struct(row, col), zero-based, of A1, R1C1 and row_x_col_y keys; null otherwise."""
    k = F.upper(key)
    letters, number = F.regexp_extract(k, r"^([A-Z]+)(\d+)$", 1), F.regexp_extract(k, r"^([A-Z]+)(\d+)$", 2)
    col = F.aggregate(F.split(letters, ""), F.lit(0).cast("bigint"), lambda acc, x: F.when(x == "", acc).otherwise(acc * 26 + F.ascii(x) - 64))
    r1 = [F.regexp_extract(k, r"^R(\d+)C(\d+)$", i).try_cast("bigint") for i in (1, 2)]
    named = [F.regexp_extract(F.lower(key), r"^row[_\-]?(\d+)[_\-]?col[_\-]?(\d+)", i).try_cast("bigint") for i in (1, 2)]
    pos = lambda r, c: F.struct(r.cast("bigint").alias("row"), c.cast("bigint").alias("col"))
    return F.when(letters != "", pos(number.try_cast("bigint") - 1, col - 1)).when(r1[0].isNotNull(), pos(r1[0] - 1, r1[1] - 1)).when(named[0].isNotNull(), pos(named[0], named[1]))


def cell_value(c: Column) -> Column:
    """Text of a JSON cell: a string, a number, or the first member that is neither empty nor 0; empty otherwise."""
    first = F.lit("")
    for k in reversed(("text", "value", "content", "display_value", "formatted_value", "raw_value")):
        v = F.get_json_object(c, f"$.{k}")
        inner = F.coalesce(F.get_json_object(c, f"$.{k}.text"), F.get_json_object(c, f"$.{k}.content"))
        v = F.when(v.startswith("{"), inner).otherwise(v)
        first = F.when(v.isNull() | v.isin("", "0", "false"), first).otherwise(F.trim(v))
    parts = F.array_join(F.transform(F.array_sort(F.map_entries(F.from_json(F.get_json_object(c, "$.text_data"), "map<string,string>"))), lambda e: F.when(e["value"].startswith("{"), F.get_json_object(e["value"], "$.text")).otherwise(e["value"])), "")
    whole = F.when(c.startswith("{"), F.when(first == "", F.coalesce(F.trim(parts), F.lit(""))).otherwise(first)).otherwise(F.trim(F.regexp_replace(c, '^"|"$', "")))
    return F.coalesce(whole, F.lit(""))


def dense(cells: DataFrame, key: str) -> DataFrame:
    """(key, row, cells): full rows of each sheet up to its largest column; rows without text are dropped."""
    box = cells.groupBy(key).agg(F.max("col").alias("m"))
    rows = cells.where(F.trim(F.coalesce("text", F.lit(""))) != "").groupBy(key, "row").agg(F.map_from_entries(F.collect_list(F.struct("col", "text"))).alias("x"))
    at = lambda c: F.coalesce(F.element_at(F.col("x"), c.cast("bigint")), F.lit(""))
    return rows.join(box, key).select(key, "row", F.transform(F.sequence(F.lit(0).cast("bigint"), F.col("m")), at).alias("cells"))


def markdown_table(rows: Column) -> Column:
    """Markdown table of an array of rows; rows of blanks are dropped, the first row is the header, ragged rows stay ragged."""
    full = F.filter(rows, lambda r: F.exists(r, lambda c: F.trim(c) != ""))
    line = lambda r: F.concat(F.lit("| "), F.array_join(r, " | "), F.lit(" |"))
    rule = line(F.transform(F.get(full, F.lit(0)), lambda _: F.lit("---")))
    body = F.transform(F.slice(full, 2, F.greatest(F.size(full) - 1, F.lit(0))), line)
    return F.when(F.size(full) > 0, F.array_join(F.concat(F.array(line(F.get(full, F.lit(0))), rule), body), "\n")).otherwise("")


def mostly_empty(cells: DataFrame, key: str, most: float = 0.8) -> DataFrame:
    """Keys of sheets more than ``most`` of whose cells are empty."""
    return cells.groupBy(key).agg(F.avg(F.when(F.trim(F.coalesce("text", F.lit(""))) == "", 1.0).otherwise(0.0)).alias("e")).where(F.col("e") > most).select(key)
