"""Text decoded with the wrong character encoding: found and restored.

Adjacent character pairs are counted over all texts into a table of fixed size
(pairs hashed to ``BUCKETS`` counters), each pair scored by its part in the
corpus' mutual information, ``p(ab) log(p(ab) / (p(a) p(b)))``. Pairs whose
part is below ``LEAST`` score positive, others negative; maximum-scoring
segments isolate improbable runs. Inverse mappings are only tested on the
groups of foreign signs that such runs touch, and are taken if the bytes
decode and the restored pairs are likelier than those before.
"""

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BUCKETS = 1 << 20
#: A pair that adds less than this to the mutual information is improbable.
LEAST = 2e-5
#: Least score of a run with CJK signs; names are short runs.
RUN = 10.0
#: Signs that stand in any text (fixed values).
_PLAIN = frozenset("“”‘’–—…•·。，、：；！？（）《》【】　")
#: Mean gain in log-probability of a pair from which a mapping between one-byte or unchecked encodings is taken.
GAIN = 1.5

# Fixed values: (encoding it was read in, encoding it was written in).
UTF8_READ_AS = ("cp1252", "gb18030", "cp1251", "mac_roman", "cp437", "cp850", "cp1250", "iso8859_15", "cp1254", "iso8859_2", "cp1256", "cp1253", "koi8_r", "cp866", "big5", "shift_jis", "euc_kr", "euc_jp")
MULTI = (("cp1252", "gb18030"), ("cp1251", "gb18030"), ("mac_roman", "gb18030"), ("cp437", "gb18030"), ("cp850", "gb18030"), ("cp1250", "gb18030"), ("koi8_r", "gb18030"), ("cp1252", "shift_jis"), ("cp1251", "shift_jis"),
         ("cp1252", "euc_jp"), ("cp1252", "big5"), ("cp1252", "euc_kr"), ("gb18030", "shift_jis"), ("shift_jis", "gb18030"), ("gb18030", "big5"), ("big5", "gb18030"), ("euc_kr", "gb18030"), ("euc_jp", "gb18030"))
SINGLE = (("cp1251", "cp1252"), ("cp437", "cp1252"), ("mac_roman", "cp1252"), ("cp850", "cp1252"), ("cp1250", "cp1252"), ("koi8_r", "cp1252"), ("cp866", "cp1252"), ("cp1253", "cp1252"), ("iso8859_2", "cp1252"), ("cp1252", "cp1251"), ("koi8_r", "cp1251"), ("cp1251", "koi8_r"),
          ("cp1252", "koi8_r"), ("cp866", "cp1251"), ("cp1251", "cp866"), ("cp1252", "cp866"), ("mac_roman", "cp1251"), ("cp437", "cp1251"), ("cp1252", "mac_roman"), ("cp1252", "cp437"), ("cp1252", "cp850"), ("gb18030", "cp1252"), ("shift_jis", "cp1252"), ("big5", "cp1252"))


def _table(enc: str) -> dict[str, int] | None:
    """High half of a one-byte encoding; undefined bytes stand for themselves. None for others."""
    try:
        if len(b"\xc4\xd6".decode(enc, "replace")) != 2 or enc in ("shift_jis", "euc_jp", "euc_kr", "big5", "gb18030"):
            return None
    except LookupError:
        return None
    out = {}
    for b in range(128, 256):
        try:
            out[bytes([b]).decode(enc)] = b
        except UnicodeDecodeError:
            pass
    for b in range(128, 256):
        out.setdefault(chr(b), b)
    return out


class Encodings:
    def __init__(self):
        self.tables = {e: _table(e) for e in {*UTF8_READ_AS, *(a for a, _ in MULTI), *(a for a, _ in SINGLE)}}

    def encode(self, s: str, enc: str) -> bytes | None:
        t = self.tables[enc]
        if t is None:
            try:
                return s.encode(enc)
            except UnicodeEncodeError:
                return None
        try:
            return bytes([ord(c) if c < "\x80" else t[c] for c in s])
        except KeyError:
            return None


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)


def _fold(c: np.ndarray) -> np.ndarray:
    """Digits count as one sign."""
    return np.where((c >= 48) & (c <= 57), np.uint64(48), c)


def _bucket(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return (((a << np.uint64(21)) | b) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(44)).astype(np.int64)


def _single(a: np.ndarray) -> np.ndarray:
    return _bucket(a, np.full_like(a, 0x1FFFFF))


def pair_counts(df: DataFrame, col: str = "text") -> np.ndarray:
    """Counts of pairs and signs over all texts, as an array of fixed size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        acc = np.zeros(BUCKETS, dtype=np.int64)
        for b in batches:
            for text in b.column(0).to_pylist():
                if text and len(text) > 1:
                    c = _fold(_codes(text))
                    np.add.at(acc, _bucket(c[:-1], c[1:]), 1) if len(c) < 2000 else acc.__iadd__(np.bincount(_bucket(c[:-1], c[1:]), minlength=BUCKETS))
                    np.add.at(acc, _single(c), 1)
        at = np.flatnonzero(acc)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(acc[at], pa.int64())], names=["bucket", "n"])

    rows = df.select(col).where(F.col(col).isNotNull()).mapInArrow(run, "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(BUCKETS, dtype=np.float64)
    got = rows.toArrow()  # at most BUCKETS rows, whatever the corpus
    out[got.column("bucket").to_numpy()] = got.column("n").to_numpy()
    return out


class Mender:
    """Finds and restores garbled passages with the pair counts of a corpus."""

    def __init__(self, counts: np.ndarray):
        self.n = max(1.0, counts.sum() / 2)
        self.logn = math.log(self.n)
        self.counts = counts
        self.logs = np.log(np.maximum(counts / self.n, 1e-8))
        self.tried: dict[tuple[str, str, str], object] = {}
        self.enc = Encodings()

    def _log_joint(self, c: np.ndarray) -> np.ndarray:
        """Log-probability of the pairs, never below a ten-millionth of the corpus' pairs."""
        return self.logs[_bucket(c[:-1], c[1:])]

    def scores(self, c: np.ndarray) -> np.ndarray:
        """Score of each pair: positive if it adds little to the mutual information."""
        # Two occurrences prove nothing in a small corpus and don't matter in a large one.
        p = np.maximum(self.counts[_bucket(c[:-1], c[1:])] - 2, 0) / self.n
        one = self.counts[_single(c)] / self.n
        pmi = np.log(np.maximum(p, 1e-9) / np.maximum(one[:-1] * one[1:], 1e-18))
        part = np.maximum(p * np.maximum(pmi, 0.1), 1e-9)
        s = np.log(LEAST / part)
        s[(c[:-1] < 128) & (c[1:] < 128)] = 0.0
        return np.clip(s, -2.0, 4.0)

    @staticmethod
    def runs(s: np.ndarray) -> list[tuple[int, int, float]]:
        """Maximum-scoring segments (first pair, last pair, score), by one scan."""
        out = []
        v = s.tolist()
        n = len(v)
        j = -1
        for a in np.flatnonzero(s > 0).tolist():
            if a <= j:
                continue
            total = best = 0.0
            last = j = a
            while j < n:
                total += v[j]
                if total > best:
                    best, last = total, j
                elif total <= 0 or total < best - 8:
                    break
                j += 1
            j = last
            out.append((a, last, best))
        return out

    def _mean(self, x: str) -> float | None:
        """Mean log-probability of the pairs with a foreign sign; None without such a pair."""
        if len(x) > 40:
            c = _fold(_codes(x))
            m = (c[:-1] >= 128) | (c[1:] >= 128)
            return float(self._log_joint(c)[m].mean()) if m.any() else None
        total, k = 0.0, 0
        a = -1
        logs = self.logs
        for ch in x:
            b = 48 if "0" <= ch <= "9" else ord(ch)
            if a >= 0 and (a >= 128 or b >= 128):
                total += logs[((a << 21 | b) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF) >> 44]
                k += 1
            a = b
        return float(total) / k if k else None

    def _gain(self, left: str, old: str, new: str, right: str) -> tuple[float, float]:
        """(mean log-probability of the pairs before, after), pairs of ASCII signs left out."""
        was, now = self._mean(left + old + right), self._mean(left + new + right)
        return -6.0 if was is None else was, -6.0 if now is None else now

    def _memo(self, key, make):
        got = self.tried.get(key, self)
        if got is self:
            got = make()
            if len(self.tried) > 100_000:
                self.tried.clear()
            self.tried[key] = got
        return got

    def _try(self, text: str, lo: int, hi: int) -> tuple[str, bool] | None:
        """(restored text, whole) of the foreign signs text[lo:hi], if a mapping explains them."""
        s, left, right = text[lo:hi], text[max(0, lo - 1) : lo], text[hi : hi + 1]
        if len(s) > 12:
            return self._explain(s, left, right)
        return self._memo((left, s, right), lambda: self._explain(s, left, right))

    def _explain(self, s: str, left: str, right: str) -> tuple[str, bool] | None:
        best = None
        for e in UTF8_READ_AS:
            b = self.enc.encode(s, e)
            if b is None:
                continue
            try:
                u = b.decode("utf-8")
                bad = 0
            except UnicodeDecodeError:
                if self.enc.tables[e] is not None and len(s) < 8:
                    continue
                u = b.decode("utf-8", "replace")
                bad = u.count("�")
                if bad * 6 > len(u) - bad:
                    continue
            if u == s or u.isascii() or any("" <= c <= "" for c in u) or (bad or e != "cp1252") and any("\x80" <= c <= "\x9f" for c in u):
                continue
            was, now = self._gain(left, s, u, right)
            if not bad and e == "cp1252" and (len(s) >= 8 or self._chain(u)):
                now = max(now, was + 0.1)  # so many bytes are no valid UTF-8 by chance; it may have been misread twice
            if now > was and (best is None or now - was - bad > best[0]):
                best = (now - was - bad, u, bad == 0)
        if best:
            return best[1], best[2]
        if len(s) >= 4:
            for e, d in MULTI:
                b = self.enc.encode(s, e)
                if b is None:
                    continue
                u = b.decode(d, "replace")
                bad = u.count("�")
                if u == s or bad * 8 > len(u) or any(c < " " or "\x7f" <= c <= "\x9f" or "" <= c <= "" for c in u):
                    continue
                was, now = self._gain(left, s, u, right)
                if now - was >= GAIN and now > -14.5 and (best is None or now - was > best[0]):
                    best = (now - was, u, bad == 0)
        return (best[1], best[2]) if best else None

    def _chain(self, u: str) -> bool:
        """Whether the text is again UTF-8 read as a one-byte encoding."""
        b = self.enc.encode(u, "cp1252")
        try:
            return b is not None and len(b.decode("utf-8")) < len(u)
        except UnicodeDecodeError:
            return False

    def _singles(self, left: str, s: str, right: str) -> list[tuple[int, str, float]]:
        """(mapping, restored, gain) of the mappings that make letters of foreign signs."""
        out = []
        for i, (e, d) in enumerate(SINGLE):
            b = self.enc.encode(s, e)
            if b is None:
                continue
            u = b.decode(d, "replace")
            if u == s or not u.isalpha():
                continue
            was, now = self._gain(left, s, u, right)
            if now - was >= GAIN and now > -13.0:
                out.append((i, u, now - was))
        return out

    def _try_single(self, text: str, groups: list[tuple[int, int]]) -> dict[int, str]:
        """Restored groups by their start, if one mapping between one-byte encodings explains foreign signs inside words.

        A sign counts if it stands next to a letter and becomes a letter. One
        mapping must explain two groups, or one with a large gain.
        """
        got: dict[int, dict[int, str]] = {}
        total: dict[int, float] = {}
        for lo, hi in groups:
            key = text[max(0, lo - 1) : lo], text[lo:hi], text[hi : hi + 1]
            for i, u, gain in self._memo(("one", *key), lambda: self._singles(*key)):
                got.setdefault(i, {})[lo] = u
                total[i] = total.get(i, 0.0) + gain
        best, score = {}, 0.0
        for i, g in got.items():
            if total[i] > score and (len(g) > 1 or total[i] >= 4.0):
                best, score = g, total[i]
        return best

    def mend(self, text: str | None, depth: int = 3) -> tuple[bool, str | None, bool]:
        """(garbled, restored text, restored without loss)."""
        if not text or text.isascii():
            return False, text, True
        raw = _codes(text)
        high = raw >= 128
        sign = (raw == 0xFFFD) | ((raw >= 0x80) & (raw < 0xA0) & (raw != 0x85)) | ((raw >= 0xE000) & (raw < 0xF900))
        lost = bool(sign.any()) or "锟斤拷" in text
        s = self.scores(_fold(raw)) if len(raw) > 1 else np.array([4.0])
        cjk = (raw >= 0x2E80) & (raw < 0xE000) | (raw >= 0xF900)
        touched = np.zeros(len(raw) + 1, dtype=bool)
        for a, b, score in self.runs(s):
            joined = a + 1 < len(raw) and cjk[a + 1] and (65 <= raw[a] <= 90 or 97 <= raw[a] <= 122)  # a CJK sign right after a Latin letter
            if score >= RUN or b - a < 4 and (score >= 5 or joined) or not cjk[a : b + 2].any():
                touched[a : b + 2] = True
        touched[: len(raw)] |= sign
        if not touched.any():
            return lost, text, not lost
        # Groups of neighbouring foreign signs.
        edge = np.flatnonzero(np.diff(np.concatenate([[0], high.astype(np.int8), [0]])))
        out, at, found, whole = [], 0, lost, True
        cum = np.concatenate([[0], np.cumsum(touched[: len(raw)])])
        groups = [(lo, hi) for lo, hi in zip(edge[::2].tolist(), edge[1::2].tolist()) if cum[hi] > cum[lo]]
        inner = [(lo, hi) for lo, hi in groups if hi - lo <= 24 and not _PLAIN.issuperset(text[lo:hi]) and (lo and text[lo - 1].isalpha() or hi < len(text) and text[hi].isalpha() or hi - lo > 3 and text[lo:hi].isalpha())]
        single = self._try_single(text, inner) if inner and not lost else {}
        for lo, hi in groups:
            if lo in single:
                got = single[lo], True
            elif _PLAIN.issuperset(text[lo:hi]):
                continue
            else:
                got = self._try(text, lo, hi)
            if got is None and hi - lo > 12:
                # A passage inside a longer group: the touched part alone.
                t = np.flatnonzero(touched[lo:hi]) + lo
                a, b = int(t[0]), int(t[-1]) + 1
                if (a, b) != (lo, hi):
                    got = self._try(text, a, b)
                    if got is not None:
                        lo, hi = a, b
            if got is not None:
                out += [text[at:lo], got[0]]
                at = hi
                found = True
                whole &= got[1]
        if not found:
            return False, text, True
        new = "".join(out) + text[at:]
        if depth > 1 and new != text:
            _, new, again = self.mend(new, depth - 1)
            whole &= again
        return True, new, whole and "�" not in (new or "")


def mend_texts(df: DataFrame, key: str = "doc_id", col: str = "text") -> DataFrame:
    """(key, restored, whole) of the garbled texts.

    ``restored`` is the text with every explained passage restored; ``whole``
    tells whether nothing was lost. Null, blank and pure ASCII texts are never
    garbled. Repeated keys are judged row by row.
    """
    counts = df.sparkSession.sparkContext.broadcast(pair_counts(df, col))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Mender(counts.value)
        for b in batches:
            k, r, w = [], [], []
            for key_, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                garbled, new, whole = m.mend(text)
                if garbled:
                    k.append(key_)
                    r.append(new)
                    w.append(whole)
            yield pa.RecordBatch.from_arrays([pa.array(k, pa.int64()), pa.array(r, pa.string()), pa.array(w, pa.bool_())], names=["key", "restored", "whole"])

    return df.select(F.col(key).cast("bigint").alias("key"), col).mapInArrow(run, "key bigint, restored string, whole boolean").withColumnRenamed("key", key)
