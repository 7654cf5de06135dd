"""Sizes of texts in tokens of a public tokenizer."""

import base64
import re

import pyarrow as pa
from pyspark.sql import DataFrame

from quarryline.llm.pages import map_records

#: Vocabulary file (tiktoken ranks) and its split pattern.
VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def load(path: str = VOCABULARY):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("corpus", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


#: Runs of white space that the split pattern's look-ahead would need too much stack for.
_GAP = re.compile("[\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]{5000,}")


def counter(path: str = VOCABULARY):
    """A function that counts the tokens of a whole text; 0 for null and empty texts.

    A very long run of white space is one piece of the split pattern (but for
    its last sign, if something follows) and is encoded as such; the count is
    that of the whole text.
    """
    enc = load(path)

    def count(text: str | None) -> int:
        if not text:
            return 0
        n = at = 0
        for m in _GAP.finditer(text):
            end = m.end() - (m.end() < len(text))
            n += len(enc.encode_ordinary(text[at : m.start()])) + len(enc._encode_single_piece(text[m.start() : end]))
            at = end
        return n + len(enc.encode_ordinary(text[at:]))

    return count


def token_counts(df: DataFrame, key: str = "doc_id", col: str = "text", path: str = VOCABULARY, keep: tuple[str, ...] = ()) -> DataFrame:
    """(key, tokens, kept columns as text) of every row; null and empty texts have 0 tokens."""

    def make():
        count = counter(path)
        return lambda k, text, *rest: [(k, count(text), *rest)]

    fields = [(key, pa.int64(), "bigint"), ("tokens", pa.int64(), "bigint"), *((c, pa.string(), "string") for c in keep)]
    return map_records(df, (key, col, *keep), make, ", ".join(f"`{n}` {s}" for n, _, s in fields), pa.schema([(n, t) for n, t, _ in fields]))
