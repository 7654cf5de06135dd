"""Small text units shared by the operators: sites, addresses, lines, words, hashes.

All functions take Python strings and run inside Arrow-batched workers.
White space is every Unicode white-space sign (``str.isspace``).
"""

import re

import xxhash

_ZERO_WIDTH = {0x200B: None, 0xFEFF: None}
_DIGITS = re.compile("[0-9]+")
_WORD = re.compile(r"[㐀-鿿぀-ヿ]|[^\W_㐀-鿿぀-ヿ]+")
_HOST = re.compile(r"^\s*(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//([^/?#]*)")
_PORT = re.compile(r":\d*$")
_LEAD = re.compile(r"^(?:www\.|m\.)")
_LETTER = re.compile(r"[^\W\d_]")


def no_zero_width(s: str) -> str:
    return s.translate(_ZERO_WIDTH) if "​" in s or "﻿" in s else s


def fold_line(s: str) -> str:
    """Line key: no zero-width signs, lower case, one blank per white run, one 0 per digit run."""
    return _DIGITS.sub("0", " ".join(no_zero_width(s).lower().split()))


def has_letter(s: str) -> bool:
    return _LETTER.search(s) is not None


def words(s: str) -> list[str]:
    """Lower-case words; each CJK or kana sign is a word of its own."""
    return _WORD.findall(no_zero_width(s).lower())


def site_of(url: str | None) -> str | None:
    """Host in lower case without user, port and a leading ``www.`` or ``m.``; null without a host."""
    m = _HOST.match(url or "")
    if not m:
        return None
    host = _PORT.sub("", m.group(1).rpartition("@")[2].lower())
    return _LEAD.sub("", host) or None


def page_address(url: str | None) -> str | None:
    """Address of the page: site, path without closing slash, and the parameters id, p and cat in order."""
    site = site_of(url)
    if site is None:
        return None
    rest = _HOST.sub("", url, count=1).split("#", 1)[0].strip()
    path, _, query = rest.partition("?")
    keep = sorted(x for x in query.split("&") if x.partition("=")[0] in ("id", "p", "cat"))
    return f"{site}{path.rstrip('/')}?{'&'.join(keep)}"


def h64(s: str) -> int:
    """Signed 64-bit hash."""
    v = xxhash.xxh3_64_intdigest(s)
    return v - (1 << 64) if v >> 63 else v
