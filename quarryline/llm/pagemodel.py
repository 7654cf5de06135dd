"""Line model of web pages: article body, frame lines, residue messages.

``LineModel`` holds word and tag weights fitted on the labelled pages of
``labels``. ``body_mask`` scores each line (words positive, tags negative) and
keeps the best contiguous region, found by one linear scan, without the frame
lines inside it. ``ResidueIndex`` retrieves labelled residue exemplars through
an inverted index and computes TF-IDF containment over passage windows.
"""

import math
import re
from collections import defaultdict
from functools import lru_cache

import ahocorasick
import numpy as np

from quarryline.llm import labels
from quarryline.llm.units import fold_line, no_zero_width, words

#: Kinds of lines.
BLANK, FRAME, PARA, BULLET, HEAD, LINE, NUMBERED, LISTHEAD = range(8)

_ENDS = re.compile(r"[。！？!?…]|[.](?=\s|$|[”\"’'）)])")
_TAIL = frozenset("。！？.!?…”\"’)）」:：;；")
_BULLET = re.compile(r"^[-•*·]\s*")
_NUM = re.compile(r"^\d{1,3}[.、)]\s*")
_HASH = re.compile(r"^#{1,6}\s*")
_DIGIT = re.compile("[0-9]+")
_DATE = re.compile(r"\d{4}-\d{1,2}-\d{1,2}")
_LATIN = re.compile(r"[^\W_㐀-鿿぀-ヿ]+")
_CJK = re.compile(r"[㐀-鿿぀-ヿ]+")
_CAPS = re.compile(r"^[A-ZÄÖÜ][\w.]*(?: (?:[A-ZÄÖÜ][\w.]*|in|up|us|uns))*$")

#: Score of a line that many records of the site have; of a list of other articles.
REPEATED, ENTRY = -0.6, -0.4
#: Score of a word of running text.
WORD = 0.1
#: Lines below this score are frame.
FRAME_AT = -1.1
#: A line of more words and at least two sentences is running text.
LONG = 45


def _terms(folded: str) -> set[str]:
    """Words, and pairs of neighbouring CJK signs."""
    out = set(_LATIN.findall(folded))
    if not folded.isascii():
        for run in _CJK.findall(folded):
            out.update(map("".join, zip(run, run[1:])))
    return out


def _count(text: str) -> int:
    """Number of words; each CJK sign is one."""
    if text.isascii():
        return len(_LATIN.findall(text))
    return sum(map(len, _CJK.findall(text))) + len(_LATIN.findall(text))


def _tags(text: str, n: int, ends: int) -> list[str]:
    """Tags of a line without white space at its ends."""
    out = ["t:len%d" % (0 if n <= 3 else 1 if n <= 7 else 2 if n <= 14 else 3 if n <= 28 else 4)]
    if ends >= 2 and n >= 14:
        out.append("t:sentences")
    if text[-1:] in _TAIL:
        out.append("t:tail")
    if " | " in text or " / " in text:
        out.append("t:bar")
    if " > " in text or " › " in text or " » " in text:
        out.append("t:crumb")
    if "©" in text:
        out.append("t:copyright")
    if "-" in text and _DATE.search(text):
        out.append("t:date")
    if _BULLET.match(text):
        out.append("t:bullet")
    if text[:1] == "#":
        out.append("t:hash")
    if _CAPS.match(text):
        out.append("t:caps")
    return out


def _features(text: str, n: int | None = None, ends: int | None = None) -> list[str]:
    n = _count(text) if n is None else n
    ends = len(_ENDS.findall(text)) if ends is None else ends
    return [*_tags(text, n, ends), *["w:" + x for x in sorted(_terms(_DIGIT.sub("0", text.lower())))]]


@lru_cache(maxsize=1)
def fit_line_weights(rounds: int = 400, rate: float = 0.5, l2: float = 0.004) -> dict[str, float]:
    """Weights of words and tags (positive: article) by logistic regression on all labelled lines."""
    rows = [(x[0], x[2:]) for x in labels.PAGES.strip().split("\n")]
    names: dict[str, int] = {"bias": 0}
    feats = []
    for _, text in rows:
        feats.append([0] + [names.setdefault(f, len(names)) for f in _features(text)])
    x = np.zeros((len(rows), len(names)))
    for i, f in enumerate(feats):
        x[i, f] = 1.0
        x[i, f[1:]] /= math.sqrt(max(1, len(f) - 1))
    y = np.array([1.0 if a == "A" else 0.0 for a, _ in rows])
    w = np.zeros(len(names))
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-(x @ w)))
        w -= rate * (x.T @ (p - y) / len(rows) * 10 + l2 * w)
    return {k: float(w[i]) for k, i in names.items()}


class LineModel:
    """Kinds and scores of lines; results for short lines are kept in a bounded cache."""

    CACHE = 100_000

    def __init__(self, weights: dict[str, float] | None = None):
        self.weights = weights or fit_line_weights()
        self.cache: dict[str, tuple[int, float, int]] = {}
        self.heads = tuple(labels.LIST_HEADS)
        self.words = {k[2:]: v for k, v in self.weights.items() if k.startswith("w:")}

    def line(self, raw: str) -> tuple[int, float, int]:
        """(kind, score, number of words) of a line."""
        hit = self.cache.get(raw)
        if hit is None:
            hit = self._line(raw)
            if len(raw) < 160:
                if len(self.cache) >= self.CACHE:
                    self.cache.clear()
                self.cache[raw] = hit
        return hit

    def _line(self, raw: str) -> tuple[int, float, int]:
        text = " ".join(no_zero_width(raw).split())
        if not text:
            return BLANK, 0.0, 0
        if len(text) > 160 and (text.count("。") >= 2 or ". " in text) and text[-1] in _TAIL:
            n = text.count(" ") + 1 if text.isascii() else _count(text)  # white runs are one blank here
            return PARA, max(2.0, WORD * n), max(LONG, n)
        ends = len(_ENDS.findall(text))
        n = _count(text)
        if not n:
            return FRAME, -0.5, 0
        if n <= 8:
            low = text.lower()
            if any([h in low for h in self.heads]):
                return LISTHEAD, ENTRY, n
        if n < LONG and ends < 2 and (" > " in text or " › " in text or " » " in text):
            return FRAME, -0.6, n
        if ends >= 2 and n > LONG:
            return PARA, max(2.0, WORD * n), n
        w, tags, terms = self.weights, _tags(text, n, ends), _terms(_DIGIT.sub("0", text.lower()))
        word = self.words
        s = w["bias"] + math.fsum([*[w.get(x, 0.0) for x in tags], *[word[x] for x in terms if x in word]]) / math.sqrt(len(tags) + len(terms))
        if s < FRAME_AT and not _NUM.match(text):
            return FRAME, max(-0.6, min(s, -0.3)), n
        if _BULLET.match(text):
            cjk = any(ord(c) >= 0x2E80 for c in text[2:6])
            return (BULLET, max(0.8, WORD * n), n) if n > (6 if cjk else 2) else (FRAME, -1.0, n)
        if text[0] == "#":
            return HEAD, 0.8, n
        if _NUM.match(text):
            return NUMBERED, -0.5, n
        if n >= 12 and text[-1] in _TAIL:
            return PARA, max(1.5, WORD * n), n
        return LINE, -0.2, n


def _same(a: str, b: str) -> bool:
    return bool(a) and a == b


def body_mask(lines: list[str], title: str | None, model: LineModel, repeated: frozenset[int] | set[int] = frozenset()) -> list[bool]:
    """For each line, whether it belongs to the article. Blank lines are never kept.

    ``repeated``: numbers (from 0) of lines that many records of the site have.
    All false when the page has no main body.
    """
    rows = [model.line(x) for x in lines]
    live = [i for i, r in enumerate(rows) if r[0] != BLANK]
    kind = {i: rows[i][0] for i in live}
    score = {i: rows[i][1] for i in live}
    want = fold_line(title or "")
    is_title = set()
    if want:
        n = len(want)
        for i in live:
            # Folding drops marks, blanks and digits; a line much shorter than the folded title isn't it.
            if n <= len(lines[i]) + 2 and len(lines[i]) <= len(title) + 60 and _same(fold_line(_HASH.sub("", no_zero_width(lines[i]).strip())), want):
                is_title.add(i)
                kind[i], score[i] = HEAD, 1.5
    for i in repeated:
        if i in kind and kind[i] != LISTHEAD and i not in is_title:
            kind[i], score[i] = FRAME, min(score[i], REPEATED)
    # Lists of other articles: runs of headline-like lines.
    k, n = 0, len(live)
    while k < n:
        if kind[live[k]] not in (LINE, NUMBERED):
            k += 1
            continue
        e = k
        while e < n and kind[live[e]] in (LINE, NUMBERED):
            e += 1
        run = live[k:e]
        before = next((kind[live[j]] for j in range(k - 1, -1, -1) if kind[live[j]] != FRAME or j == k - 1), None)
        after = kind[live[e]] if e < n else None
        listed = before == LISTHEAD or any(kind[i] == NUMBERED for i in run) or len(run) > 1
        if not listed and after in (PARA, BULLET, HEAD):
            score[run[0]] = 0.6
        elif not listed:
            score[run[0]] = -0.4
        else:
            last = run[-1]
            own = not is_title and before != LISTHEAD and kind[last] == LINE and after in (PARA, BULLET)
            for i in run:
                score[i] = 0.6 if own and i == last else ENTRY
        k = e
    # The best contiguous region, by one scan.
    best = total = 0.0
    lo = hi = start = -1
    for j, i in enumerate(live):
        if total <= 0:
            total, start = 0.0, j
        total += score[i]
        if total > best:
            best, lo, hi = total, start, j
    keep = [False] * len(lines)
    if lo < 0 or not any(kind[live[j]] in (PARA, BULLET) for j in range(lo, hi + 1)):
        return keep
    for j in range(lo, hi + 1):
        i = live[j]
        keep[i] = score[i] > 0
    return keep


# ---------------------------------------------------------------- residue

_VAR = r"[A-Za-z_][\w.]*"
#: Forms of unfilled placeholders (fixed values).
PLACEHOLDER = re.compile(
    r"\{\{[#/]?\s*(?:if |each )?\s*" + _VAR + r"\s*\}\}|\$\{\s*" + _VAR + r"\s*\}|#\{\s*" + _VAR + r"\s*\}|\{%\s*" + _VAR + r"[^%]*%\}|<%=?\s*" + _VAR + r"\s*%>"
    r"|\[\[\s*" + _VAR + r"\s*\]\]|(?<![\w$#{])\{" + _VAR + r"\}|%[A-Z][A-Z_]{2,}%|__[A-Z][A-Z_]+__|@@[A-Z][A-Z_]+@@|\[INSERT [A-Z_ ]+ HERE\]|××[^×\n]{1,10}××|【待填写[：:]?[^】\n]*】"
)
_CODE = re.compile(r"```.*?```|`[^`\n]*`", re.S)
_HINT = re.compile(r"[{%_@×【\[]")
_CLAUSE = re.compile(r"[，。：；！？、,;:!?()（）|\n]+|\.(?=\s|$)|\s[-–—]+\s|……")
_NO_INFO = re.compile(r"[^\W_]*\d[^\W_]*|[_\W]+")


_SENT = re.compile(r"(?<=[。！？!?…）])\s*|(?<=\.)\s+")

#: Coverage from which a line counts as filler or as a message.
FILLER_AT, MESSAGE_AT = 0.75, 0.6


def has_placeholder(text: str | None) -> bool:
    """Whether a placeholder stands outside of code marks."""
    if not text or not _HINT.search(text):
        return False
    if not PLACEHOLDER.search(text):
        return False
    return PLACEHOLDER.search(_CODE.sub(" ", text)) is not None


class ResidueIndex:
    """Inverted index over labelled exemplars with their inverse document frequencies.

    The frequencies come from the exemplars and the labelled article lines, so
    they are alike at every corpus size.
    """

    CACHE = 50_000

    def __init__(self):
        self.docs: list[tuple[int, set[str]]] = []
        for cls, block in ((1, labels.FILLER), (2, labels.MESSAGES)):
            for line in block.strip().split("\n"):
                for part in {line, *(_CLAUSE.split(line) if cls == 2 else ())}:
                    t = self.terms(part)
                    if t:
                        self.docs.append((cls, t))
        df: dict[str, int] = defaultdict(int)
        body = [self.terms(x[2:]) for x in labels.PAGES.strip().split("\n") if x[0] == "A"]
        for t in [*(t for _, t in self.docs), *body]:
            for x in t:
                df[x] += 1
        n = len(self.docs) + len(body)
        self.idf = {x: math.log(1 + n / c) for x, c in df.items()}
        self.rare = 0.6 * math.log(1 + n)
        self.posting: dict[str, list[int]] = defaultdict(list)
        for i, (_, t) in enumerate(self.docs):
            for x in t:
                self.posting[x].append(i)
        self.norm = [sum(self.idf[x] for x in t) for _, t in self.docs]
        self.cache: dict[str, tuple[float, float, float]] = {}
        # A filler window has two terms of filler exemplars: pairs of CJK signs, or words of four letters and more.
        self.filler = {x for c, t in self.docs if c == 1 for x in t}
        short = {x for x in self.filler if len(x) < 4 and x.isascii()}
        self.short = max(sum(self.idf[x] for x in t & short) for c, t in self.docs if c == 1)
        self.filler_terms = ahocorasick.Automaton()
        for x in self.filler - short:
            self.filler_terms.add_word(x, x)
        self.filler_terms.make_automaton()
        self.message_terms = {x for c, t in self.docs if c == 2 for x in t}
        self.fills_cache: dict[str, bool] = {}

    def may_fill(self, text: str) -> bool:
        """Whether two filler terms stand in a text."""
        first = None
        for _, x in self.filler_terms.iter(text):
            if first is None:
                first = x
            elif x != first:
                return True
        return False

    def fills(self, raw: str) -> bool:
        """Whether a line, or a sentence in it, is filler."""
        hit = self.fills_cache.get(raw)
        if hit is None:
            hit = self._fills(raw)
            if len(raw) < 160:
                if len(self.fills_cache) >= self.CACHE:
                    self.fills_cache.clear()
                self.fills_cache[raw] = hit
        return hit

    def _fills(self, raw: str) -> bool:
        text = no_zero_width(raw).lower()
        if not self.may_fill(text):
            return False
        for s in {text, *_SENT.split(text)}:
            if self.may_fill(s) and (len(s) < 120 or not self.no_filler(s)):
                total, filler, _ = self.window(s)
                if total and filler >= FILLER_AT * total and _count(s) > 2:
                    return True
        return False

    def no_filler(self, text: str) -> bool:
        """Whether a long text is certainly no filler: the other terms of its first words outweigh all filler terms in it."""
        terms = self.terms(text[:100].rpartition(" ")[0] or text[:100].rpartition("，")[0])
        idf, rare = self.idf, self.rare
        found = {x for _, x in self.filler_terms.iter(text)}
        most = sum([idf[x] for x in found]) + self.short
        return sum([idf.get(x, rare if len(x) < 14 else 0.0) for x in terms if x not in self.filler]) > most * (1 / FILLER_AT - 1)

    def no_message(self, raw: str) -> bool:
        """Whether a line is certainly no message: all its terms that messages have, repeats counted, weigh too little."""
        text = _NO_INFO.sub(" ", fold_line(raw))
        seen = _LATIN.findall(text)
        if not text.isascii():
            for run in _CJK.findall(text):
                seen.extend(map("".join, zip(run, run[1:])))
        idf, rare = self.idf, self.rare
        total = sum([idf.get(x, rare if len(x) < 14 else 0.0) for x in set(seen)])
        return total > 0 and sum([idf[x] for x in seen if x in self.message_terms]) < MESSAGE_AT * total

    @staticmethod
    def terms(text: str) -> set[str]:
        return _terms(_NO_INFO.sub(" ", fold_line(text)))

    def window(self, text: str) -> tuple[float, float, float]:
        """(weight of a window, weight covered by its best exemplar of class 1, of class 2)."""
        t = self.terms(text)
        idf, rare = self.idf, self.rare
        total = sum([idf.get(x, rare if len(x) < 14 else 0.0) for x in t])
        hits: dict[int, float] = defaultdict(float)
        for x in t:
            for i in self.posting.get(x, ()):
                hits[i] += self.idf[x]
        best = [0.0, 0.0]
        for i, got in hits.items():
            cls = self.docs[i][0] - 1
            if got >= 0.5 * self.norm[i] or len(t) > 2 and got >= 0.6 * total:
                best[cls] = max(best[cls], got)
        return total, best[0], best[1]

    def line(self, raw: str) -> tuple[float, float, float]:
        """Weights over the clause windows of a line: all, covered by filler, covered by messages."""
        hit = self.cache.get(raw)
        if hit is None:
            whole = self.window(raw)
            parts = [self.window(x) for x in _CLAUSE.split(raw) if x.strip()]
            a = sum(p[0] for p in parts)
            hit = (a, max(whole[1] / whole[0] * a if whole[0] else 0, sum(p[1] for p in parts)), max(whole[2] / whole[0] * a if whole[0] else 0, sum(p[2] for p in parts)))
            if len(self.cache) >= self.CACHE:
                self.cache.clear()
            self.cache[raw] = hit
        return hit


def is_residue(lines: list[str], content: str | None, title: str | None, error: str | None, model: LineModel, index: ResidueIndex) -> bool:
    """Whether a record is template residue, filler or an error or notice page."""
    if has_placeholder(content) or has_placeholder(error):
        return True
    if not content or content.isspace():
        return False
    rest = []
    for x in lines:
        kind, _, n = model.line(x)
        if kind == BLANK:
            continue
        rest.append((kind, n, x))
        if n > 2 and index.fills(x):
            return True
    # A paragraph or list item that is no message settles it, whatever else there is: the shortest are asked first.
    for x in sorted([x for kind, _, x in rest if kind in (BULLET, PARA)], key=len):
        if index.no_message(x):
            return False
        total, _, message = index.line(x)
        if total and message < MESSAGE_AT * total:
            return False
    # Messages: what is left of the page without frame and lists of articles.
    got = left = 0.0
    bulk = 0
    in_list = weak = False
    for kind, n, x in rest:
        total, _, message = index.line(x)
        hit = total > 0 and message >= MESSAGE_AT * total
        if kind == LISTHEAD:
            in_list = True
            continue
        if hit and (kind != FRAME or n > 2 and message >= 0.7 * total):
            got += total
            left += total
            in_list = False
        elif kind in (LINE, NUMBERED) and in_list:
            continue
        elif kind == FRAME:
            in_list = False
            weak |= len(rest) <= 2 and n > 3 and " > " not in x and " | " not in x and message >= 0.5 * total > 0
        else:
            left += total
            bulk += kind in (BULLET, PARA)
            if kind == PARA:
                in_list = False
    return got > 0 and not bulk and got >= 0.4 * left or weak and not got and not left
