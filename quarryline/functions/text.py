"""Column functions on text."""

from pyspark.sql import Column
from pyspark.sql import functions as F

WHITE = r"[\p{IsWhite_Space}\x1c-\x1f]"


def trim_white(c: Column) -> Column:
    """Trim every Unicode white-space sign."""
    return F.regexp_replace(c, f"^{WHITE}+|{WHITE}+$", "")


def blank_to_null(c: Column) -> Column:
    """Trimmed text; null if nothing is left."""
    t = trim_white(c)
    return F.when(t != "", t)
