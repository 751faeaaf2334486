"""Cutting oversized texts into pieces at natural boundaries, with overlap.

A text is parsed into a tree: headed sections, paragraphs, list items and lines, sentences. From
the leaves up, neighbouring siblings are merged as long as they fit; only nodes that are too large
are descended into. A sentence that is too large itself is cut between words.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Unicode white space, as a Java and as a Python character class.
SPACE = r"\t-\r \x85\xA0  -     　"
_WORD = re.compile(rf"[^{SPACE}]+")
_HEADING = regex.compile(r"(?m)^[ \t]*(?:#{1,6}[ \t]|(?i:chapter|part|section|schedule|article)[ \t]+[IVXLCDM\d]+[A-Z]?\b|[\p{Lu}\d][\p{Lu}\d .,&'()-]{5,70}$)")
_BLANK = regex.compile(r"\n[ \t\r]*\n\s*| ")
_ITEM = regex.compile(r"(?m)^[ \t]*(?:[-*•‣–]|\(?(?:\d{1,3}|[a-z]|[ivxlc]{1,6})[.)])[ \t]+")
_LINE = regex.compile(r"[\n\r ]+")
_SENTENCE = regex.compile(r"[.?!।॥][\"'”’)\]]*[" + SPACE + r"]+(?=[^\p{Ll}])")


def n_words(text: Column) -> Column:
    """The number of words: maximal runs of characters that are not Unicode white space."""
    space = f"[{SPACE}]"
    runs = F.size(F.split(text, f"{space}+"))
    return F.when(F.length(text) == 0, 0).otherwise(runs - F.left(text, F.lit(1)).rlike(space).cast("int") - F.right(text, F.lit(1)).rlike(space).cast("int"))


def _levels(text: str, starts: list[int]) -> list[list[int]]:
    """For each level of the tree, coarsest first, the word numbers at which a node begins."""
    marks = [
        [m.start() for m in _HEADING.finditer(text)],
        [m.end() for m in _BLANK.finditer(text)],
        [m.start() for m in _ITEM.finditer(text)],
        [m.end() for m in _SENTENCE.finditer(text)],
        [m.end() for m in _LINE.finditer(text)],
    ]
    return [sorted({bisect_left(starts, at) for at in level} - {0, len(starts)}) for level in marks]


def _pack(lo: int, hi: int, levels: list[list[int]], budget: int, first: int) -> list[tuple[int, int]]:
    """Spans of at most ``budget`` words, ``first`` for one that begins the text, that cover lo..hi: children packed, then neighbours merged."""
    room = lambda at: budget if at else first
    if hi - lo <= room(lo):
        return [(lo, hi)]
    if not levels:
        cuts = [lo, *range(lo + room(lo), hi, budget), hi]
        return list(zip(cuts, cuts[1:]))
    own = levels[0]
    cuts = [lo, *own[bisect_left(own, lo + 1) : bisect_left(own, hi)], hi]
    if len(cuts) == 2:
        return _pack(lo, hi, levels[1:], budget, first)
    out: list[tuple[int, int]] = []
    for a, b in zip(cuts, cuts[1:]):
        for span in _pack(a, b, levels[1:], budget, first):
            if out and span[1] - out[-1][0] <= room(out[-1][0]):
                out[-1] = (out[-1][0], span[1])
            else:
                out.append(span)
    return out


def split_text(text: str, limit: int = 375, overlap: int = 38) -> list[tuple[int, int, int]]:
    """(first character, end character, words) of each piece; one piece if the text fits."""
    words = [m.span() for m in _WORD.finditer(text)]
    if len(words) <= limit:
        return [(0, len(text), len(words))]
    spans = _pack(0, len(words), _levels(text, [a for a, _ in words]), limit - overlap, limit)
    if spans[0][1] < overlap:  # the second piece must find its overlap
        spans[:2] = [(0, spans[1][1])]
    out = []
    for lo, hi in spans:
        lo = max(0, lo - overlap)
        out.append((words[lo][0], words[hi - 1][1], hi - lo))
    return out


def _each_once(rows: DataFrame) -> DataFrame:
    """The rows of (item_id, text) without repeated ones."""
    again = rows.groupBy(F.col("item_id").alias("again")).count().where("count > 1").select("again")
    if again.isEmpty():
        return rows
    same = F.col("item_id").eqNullSafe(F.col("again"))
    return rows.join(again, same, "left_anti").unionByName(rows.join(again, same, "left_semi").distinct())


def split_oversized(rows: DataFrame, id_col: str, text_col: str = "text", limit: int = 375, overlap: int = 38) -> DataFrame:
    """(item_id STRING, piece_no INT from 1, n_pieces, start_at, words, piece) of every non-null text.

    Pieces have at most ``limit`` words; each begins with the last ``overlap`` words of the one
    before. Texts that fit, empty ones too, come out unchanged as one piece; null texts give no
    row. Rows of the same id and text count once; only texts of ids that occur again are shuffled. start_at counts code points from 1. Other
    columns are not read.
    """
    if not 0 <= overlap < limit:
        raise ValueError("overlap must be at least 0 and less than limit")
    rows = rows.select(F.col(id_col).cast("string").alias("item_id"), F.col(text_col).alias("text")).where("text is not null")
    # n words need 2 n - 1 characters, so most texts need no count
    large = (F.length("text") > 2 * limit) & (n_words(F.col("text")) > limit)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                spans = split_text(text, limit, overlap)
                out += [(item, i, len(spans), a + 1, n, text[a:b]) for i, (a, b, n) in enumerate(spans, 1)]
            cols = list(zip(*out)) or [()] * 6
            kinds = (pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["item_id", "piece_no", "n_pieces", "start_at", "words", "piece"])

    rows = _each_once(rows)
    cut = rows.where(large).mapInArrow(run, "item_id string, piece_no int, n_pieces int, start_at int, words int, piece string")
    fit = rows.where(~large).select("item_id", F.lit(1).alias("piece_no"), F.lit(1).alias("n_pieces"), F.lit(1).alias("start_at"), n_words(F.col("text")).alias("words"), F.col("text").alias("piece"))
    return cut.unionByName(fit)


def oversized_pieces(rows: DataFrame, id_col: str, text_col: str = "text", limit: int = 375, overlap: int = 38) -> DataFrame:
    """As :func:`split_oversized`, only the texts that had to be cut."""
    return split_oversized(rows, id_col, text_col, limit, overlap).where("n_pieces > 1")
