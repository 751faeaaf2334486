"""Terms, words and hashes shared by the text operators of this package."""

from __future__ import annotations

import hashlib
import re
import unicodedata

import numpy as np

#: Bytes that are neither letters nor digits, as blanks.
_BLANKED = bytes(c if chr(c).isalnum() else 32 for c in range(128)) + b" " * 128


def marks() -> str:
    """The ranges of all combining marks, as inside a character class."""
    codes = [c for c in (*range(0x300, 0x20000), *range(0xE0100, 0xE01F0)) if unicodedata.category(chr(c))[0] == "M"]
    starts = [c for i, c in enumerate(codes) if not i or codes[i - 1] != c - 1]
    ends = [c for i, c in enumerate(codes) if i + 1 == len(codes) or codes[i + 1] != c + 1]
    return "".join(f"{chr(a)}-{chr(b)}" for a, b in zip(starts, ends))


#: A term is a maximal run of letters, marks and digits of the lower-cased text.
_TERM = re.compile(rf"[\w{marks()}]+")


#: Frequent signs outside ASCII that are part of no term.
_SIGNS = "\u20b9\u2014\u2013\u2019\u2018\u201c\u201d\u2026\u2022\u2010\u2011\u00a0\u00ad\u00ac\u00a7\u00b7"


def as_ascii(text: str) -> str | None:
    """The text with frequent signs as blanks if it is ASCII then, else null."""
    if not text.isascii():
        for sign in _SIGNS:
            if sign in text:
                text = text.replace(sign, " ")
        if not text.isascii():
            return None
    return text


def ascii_words(text: str) -> list[str]:
    """The runs of letters and digits of an ASCII text; twice as fast as a regular expression."""
    return text.encode("ascii").translate(_BLANKED).decode("ascii").split()


def terms(text: str | None) -> list[str]:
    if not text:
        return []
    low = text.lower()
    if (plain := as_ascii(low)) is not None:
        return ascii_words(plain)
    return _TERM.findall(low.replace("_", " "))


def hash64(data: bytes) -> int:
    """A signed 64-bit hash that does not depend on the process."""
    return int.from_bytes(hashlib.blake2b(data, digest_size=8).digest(), "little", signed=True)


class TermHashes:
    """Remembers the 64-bit hash of each term; forgets all when ``limit`` terms are known."""

    def __init__(self, limit: int = 1_000_000):
        self.limit, self.known = limit, {}

    def __call__(self, words: list[str]) -> np.ndarray:
        known = self.known
        try:
            return np.fromiter(map(known.__getitem__, words), np.int64, len(words)).view(np.uint64)
        except KeyError:
            if len(known) > self.limit:
                known.clear()
            for w in set(words):
                if w not in known:
                    known[w] = hash64(w.encode("utf-8", "surrogatepass"))
            return np.fromiter(map(known.__getitem__, words), np.int64, len(words)).view(np.uint64)


class KnownHashes:
    """Tells which words' 64-bit hashes are in a sorted array; remembers at most ``limit`` words."""

    def __init__(self, table: np.ndarray, limit: int = 1_000_000):
        self.table, self.limit, self.known = table, limit, {}

    @staticmethod
    def collect(rows) -> np.ndarray:
        """The distinct values of the column ``hash`` of a DataFrame, sorted: eight bytes each on the driver."""
        found = rows.select("hash").distinct().toArrow().column(0)
        return np.unique(found.to_numpy())

    def has(self, value: int) -> bool:
        at = int(np.searchsorted(self.table, value))
        return at < len(self.table) and int(self.table[at]) == value

    def __call__(self, words: list[str]) -> np.ndarray:
        known = self.known
        try:
            return np.fromiter(map(known.__getitem__, words), bool, len(words))
        except KeyError:
            if len(known) > self.limit:
                known.clear()
            for w in set(words):
                if w not in known:
                    known[w] = self.has(hash64(w.encode("utf-8", "surrogatepass")))
            return np.fromiter(map(known.__getitem__, words), bool, len(words))


def distinct(values: np.ndarray) -> np.ndarray:
    """The distinct values, sorted. Sorts, as hashing integers is many times slower for some."""
    if len(values) < 2:
        return values
    values = np.sort(values)
    keep = np.empty(len(values), bool)
    keep[0] = True
    np.not_equal(values[1:], values[:-1], out=keep[1:])
    return values[keep]


_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)


def shingle_hashes(hashes: np.ndarray, n: int) -> np.ndarray:
    """The hash of every run of ``n`` consecutive terms, in order; empty if there are fewer terms."""
    m = len(hashes) - n + 1
    if m <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(m, np.uint64)
    for i in range(n):
        out = (out ^ hashes[i : i + m]) * _MIX[i % len(_MIX)]
        out ^= out >> np.uint64(29)
    return out
