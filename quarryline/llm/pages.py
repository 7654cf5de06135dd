"""Shared page stages: records to participation, article lines and line keys.

A record takes part if its content is not blank and it is no residue
(``pagemodel.is_residue``). All stages run in Arrow batches inside workers;
the fitted weights travel with the task, nothing is collected.
"""

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from quarryline.llm.pagemodel import LineModel, ResidueIndex, body_mask, fit_line_weights, is_residue

COLUMNS = ("fetch_id", "url", "title", "content", "error")


def map_records(df: DataFrame, columns: tuple[str, ...], make: Callable[[], Callable[..., object]], schema: str, arrow: pa.Schema) -> DataFrame:
    """Rows of ``make()(*columns)`` for each row of ``df``; the function returns a list of tuples."""
    names = [f.name for f in arrow]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = make()
        for b in batches:
            out = []
            for row in zip(*(b.column(i).to_pylist() for i in range(len(columns)))):
                out.extend(f(*row))
            cols = list(zip(*out)) if out else [[] for _ in names]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), type=f.type) for c, f in zip(cols, arrow)], schema=arrow)

    return df.select(*columns).mapInArrow(run, schema)




def page_parts(weights: dict[str, float] | None = None):
    """A line model and a residue index for a worker."""
    return LineModel(weights), ResidueIndex()


def residue(df: DataFrame) -> DataFrame:
    """``fetch_id`` of the records that are template residue, filler, error or notice pages.

    Null content and null error are treated as missing; a repeated fetch_id
    comes out once for each row that is residue.
    """
    weights = fit_line_weights()

    def make():
        model, index = page_parts(weights)

        def f(fetch_id, title, content, error):
            lines = content.split("\n") if content else []
            return [(fetch_id,)] if is_residue(lines, content, title, error, model, index) else []

        return f

    return map_records(df, ("fetch_id", "title", "content", "error"), make, "fetch_id bigint", pa.schema([("fetch_id", pa.int64())]))


def frame_lines(df: DataFrame) -> DataFrame:
    """(fetch_id, line_no) of the frame lines of the records that take part; line_no counts from 1."""
    weights = fit_line_weights()

    def make():
        model, index = page_parts(weights)

        def f(fetch_id, title, content, error):
            if not content or content.isspace():
                return []
            lines = content.split("\n")
            if is_residue(lines, content, title, error, model, index):
                return []
            keep = body_mask(lines, title, model)
            return [(fetch_id, i + 1) for i, (k, x) in enumerate(zip(keep, lines)) if not k and not (not x or x.isspace())]

        return f

    return map_records(
        df, ("fetch_id", "title", "content", "error"), make, "fetch_id bigint, line_no bigint", pa.schema([("fetch_id", pa.int64()), ("line_no", pa.int64())])
    )


def articles(df: DataFrame) -> DataFrame:
    """(fetch_id, site, body): the article of each record that takes part; null body without a main body."""
    weights = fit_line_weights()

    def make():
        from quarryline.llm.units import site_of

        model, index = page_parts(weights)

        def f(fetch_id, url, title, content, error):
            if not content or content.isspace():
                return []
            lines = content.split("\n")
            if is_residue(lines, content, title, error, model, index):
                return []
            keep = body_mask(lines, title, model)
            body = "\n".join(x for x, k in zip(lines, keep) if k)
            return [(fetch_id, site_of(url), body or None)]

        return f

    return map_records(
        df, COLUMNS, make, "fetch_id bigint, site string, body string", pa.schema([("fetch_id", pa.int64()), ("site", pa.string()), ("body", pa.string())])
    )
