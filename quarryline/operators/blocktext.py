"""Documents of blocks to Markdown, and HTML pages to text."""

from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarryline.operators.shred import block_links, block_rows, text_pieces

#: Marks before the text of a block (fixed values).
MARKS = {"bullet": "- ", "ordered_list": "1. ", "quote": "> ", **{f"heading{i}": "#" * i + " " for i in range(1, 7)}}
IN_TABLE = ("table", "table_cell", "table_row")


def block_markdown(responses: DataFrame) -> DataFrame:
    """(doc_token, text): each document's blocks in pre-order, as Markdown.

    Blocks of tables and below their cells are left out, a block comes once. A
    document is walked as a whole by one task; its blocks are bounded by the
    document's own size.
    """
    text = text_pieces(responses).groupBy("doc_token", "block_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("piece_no", "text"))), lambda p: p["text"]), "").alias("text"))
    rows = block_rows(responses).select("doc_token", "block_id", F.col("data.type").alias("kind"), F.col("data.parent_id").alias("parent"), F.col("data.children").alias("children"))
    seq = responses.where("code = 0").select("doc_token", "ord", F.posexplode("block_sequence").alias("i", "block_id"))
    seq = seq.groupBy("doc_token", "block_id").agg(F.min(F.struct("ord", "i")).alias("p"))
    table = block_links(responses).join(rows.where(F.col("kind") == "table").select("doc_token", F.col("block_id").alias("parent_block_id")), ["doc_token", "parent_block_id"], "left_semi").select("doc_token", "block_id", F.lit(True).alias("celled")).distinct()
    x = rows.join(text, ["doc_token", "block_id"], "left").join(table, ["doc_token", "block_id"], "left").join(seq, ["doc_token", "block_id"], "left")
    x = x.select("doc_token", "block_id", "kind", "parent", "children", "text", F.coalesce("celled", F.lit(False)).alias("celled"), F.col("p.ord").alias("a"), F.col("p.i").alias("b"))

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        by = {r.block_id: r for r in pdf.itertuples()}
        order = [r.block_id for r in sorted((r for r in by.values() if pd.notna(r.a)), key=lambda r: (r.a, r.b))]
        kind = lambda i: by[i].kind if i in by else None
        up = lambda i: by[i].parent if i in by and by[i].parent in by else None
        seen, out, stack = set(), [], order[::-1]
        while stack:
            i = stack.pop()
            if i in seen or i not in by:
                continue
            seen.add(i)
            r, p = by[i], up(i)
            if r.kind in IN_TABLE[1:] or r.celled or kind(p) in IN_TABLE or kind(up(p)) in IN_TABLE:
                continue
            t = (r.text or "") if isinstance(r.text, str) else ""
            if t.strip():
                out.append(f"```\n{t}\n```" if r.kind == "code" else MARKS.get(r.kind, "") + t)
            if r.kind != "table" and r.children is not None:
                stack.extend(list(r.children)[::-1])
        return pd.DataFrame({"doc_token": [pdf["doc_token"].iloc[0]], "text": ["\n\n".join(out)]})

    return x.groupBy("doc_token").applyInPandas(walk, "doc_token string, text string")


#: Elements without text of their own, elements that end a line, and what may hold the article (fixed values).
DROP = {"script", "style", "noscript", "iframe", "svg", "form", "button", "nav", "header", "footer", "aside", "template"}
LINES = {"p", "div", "br", "li", "tr", "h1", "h2", "h3", "h4", "h5", "h6", "section", "article", "ul", "ol", "table", "blockquote", "pre"}
HOLD = {"article", "main"}
NOISE = ("ad", "ads", "advert", "sidebar", "comment", "share", "related", "recommend", "breadcrumb", "menu")
VOID = {"br", "img", "hr", "input", "meta", "link", "area", "base", "col", "embed", "source", "track", "wbr"}


class _Text(HTMLParser):
    """Text of each open container; dropped and noisy elements are skipped with all below."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.stack: list[tuple[str, bool, int]] = []
        self.parts: list[str] = []
        self.skip = 0
        self.best = ""

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in LINES:
            self.parts.append("\n")
        if tag in VOID:
            return
        names = " ".join(v or "" for k, v in attrs if k in ("class", "id")).lower().replace("-", " ").replace("_", " ").split()
        off = tag in DROP or any(n in NOISE for n in names)
        self.skip += off
        self.stack.append((tag, off, len(self.parts) if tag in HOLD or any(n in ("content", "article", "post", "entry") for n in names) else -1))

    def handle_endtag(self, tag: str) -> None:
        if tag not in {t for t, _, _ in self.stack}:
            return
        while self.stack:
            t, off, at = self.stack.pop()
            self.skip -= off
            if at >= 0:
                text = "".join(self.parts[at:])
                self.best = max(self.best, text, key=len)
            if t == tag:
                break
        if tag in LINES:
            self.parts.append("\n")

    def handle_data(self, data: str) -> None:
        if not self.skip:
            self.parts.append(data)


def html_text(html: str | None) -> str | None:
    """Main text of a page: the longest content element, else the whole page without noise."""
    if html is None:
        return None
    p = _Text()
    p.feed(html)
    p.close()
    raw = p.best if len(p.best.strip()) > 50 else "".join(p.parts)
    lines = [" ".join(x.split()) for x in raw.split("\n")]
    return "\n".join(x for x in lines if x)


def html_texts(pages: DataFrame, key: str, col: str) -> DataFrame:
    """(key, text) of HTML pages, in Arrow batches."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({key: pdf[key], "text": [html_text(x) for x in pdf[col]]})

    kind = dict(pages.dtypes)[key]
    return pages.select(key, col).mapInPandas(run, f"`{key}` {kind}, text string")
