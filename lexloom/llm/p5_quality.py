"""Statistics of each text's quality, judged against the distribution in its language.

The statistics of all texts go into mergeable KLL sketches per language; a text's values become
percentiles and robust z-scores, the tails are flagged, and the shape of a flagged text tells
lists, tables and junk apart.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .terms import KnownHashes, TermHashes, hash64, marks, terms

#: A word is known if at least this many texts have it (a lower bound for small corpora).
KNOWN_IN = 5
#: Robust z-scores beyond which a statistic is in the tail.
TAIL = 4.0
#: Words from which on a text without marks of its form is judged, and the share of function words under which it is no language.
ENOUGH, SPARSE = 12, 0.03
#: Statistics for which sketches are built.
STATISTICS = ("common_share", "known_share", "symbol_ratio", "cell_share", "label_share", "bullet_share", "digit_share", "mean_word_length", "stop_line_share", "distinct_share")
#: How many of them, from the first, bear on the kind of a text.
FOR_KIND = 6

# Frequent English function words.
COMMON = frozenset(
    "a about above after all alone also an and any are as at be because been before being both but by can cannot could did do does for from had has have he her his how "
    "if in into is it its may might must neither no nor not of off on once one only or other otherwise our out over shall she should simply since so such than that the "
    "their them then there these they this those through to towards under unless until up upon was we were what when where whether which while who whom with within without would you".split()
)

#: A word that marks an item: a sign, or a number, letter or roman number with a stop or bracket.
_BULLET = re.compile(r"[-*•‣▪–]|\(?(?:\d{1,3}|[a-z]|[ivxl]{1,5})[.)]")
#: What stands before a colon if it is a label: up to four words.
_LETTER = rf"(?:[^\W\d_]|[.{marks()}])"
_LABEL = re.compile(rf"(?:^|[\s;|])[^\W\d_]{_LETTER}*(?: {_LETTER}+){{0,3}}\s?$")
_CELL = re.compile(r"[-–—]+|nil|n/a|[₹$]?[\d.,/:%-]*\d[\d.,/:%-]*", re.I)
_CELL_ENDS = re.compile(r"\|+|,(?=\S)|\.{3,}")
_INNER_END = re.compile(r"\||,\S|\.{3}")


def language(text: str) -> str:
    """By script: ``hi``, ``ml``, ``en`` for Latin letters, ``und`` if less than a quarter are letters of one of them."""
    n = {"hi": 0, "ml": 0, "en": 0}
    if not text.replace("\u20b9", "").isascii():
        n["hi"], n["ml"] = sum(map(len, _DEVANAGARI.findall(text))), sum(map(len, _MALAYALAM.findall(text)))
    n["en"] = sum(map(len, _LATIN.findall(text)))
    most = max(n, key=n.get)
    return most if n[most] * 4 >= len(text) else "und"


_DEVANAGARI = re.compile("[ऀ-ॿ]+")
_MALAYALAM = re.compile("[ഀ-ൿ]+")
_LATIN = re.compile("[A-Za-z]+")
_DIGIT_WORD = re.compile(r"\d\S*")
_LINE_STOP = re.compile(r"[.?!;।\"”)][^\S\n]*(?=\n|\Z)")
_LINE = re.compile(r"[^\s][^\n]*")


class Words(dict):
    """What each term counts for, as bits: 1 for more than two characters that are not all digits, 2 if such a term is known, 4 if it is common, 8 if it is suspect, 16 times its length."""

    def __init__(self, known: np.ndarray, suspect: np.ndarray | None = None, limit: int = 1_000_000):
        super().__init__()
        self.known, self.suspect, self.limit = KnownHashes(known), KnownHashes(suspect) if suspect is not None else None, limit

    def __missing__(self, word: str) -> int:
        if len(self) >= self.limit:
            self.clear()
        value, solid = hash64(word.encode("utf-8", "surrogatepass")), len(word) > 2 and not word.isdigit()
        suspect = self.suspect is not None and self.suspect.has(value)
        self[word] = bits = solid + 2 * (solid and self.known.has(value)) + 4 * (word in COMMON) + 8 * suspect + 16 * len(word)
        return bits

    def bits(self, words: list[str]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.int64, len(words))


class Cells(dict):
    """What each word is in a row of values, as bits: 1 for an item's mark, 2 if it holds numbers, 4 times its cells, 2^14 times those that are values.

    ``numbers`` has the numbers of the words that hold any.
    """

    def __init__(self, limit: int = 1_000_000):
        super().__init__()
        self.numbers, self.limit = {}, limit

    def __missing__(self, word: str) -> int:
        if len(self) >= self.limit:
            self.clear()
            self.numbers.clear()
        cells = [c for c in _CELL_ENDS.split(word) if c] if _INNER_END.search(word) else [word]
        bare = [c.strip("().") for c in cells]
        numbers = [int(c) for c in bare if c.isascii() and c.isdigit() and c[0] != "0" and len(c) < 7]
        if numbers:
            self.numbers[word] = numbers
        values = sum(1 for c in cells if _CELL.fullmatch(c))
        self[word] = bits = bool(_BULLET.fullmatch(word)) + 2 * bool(numbers) + 4 * min(len(cells), 1023) + (min(values, 1023) << 14)
        return bits


def shape(text: str, words: list[str], cells: Cells) -> tuple[int, int, float, int]:
    """(items' marks, labels, share of cells that are values, longest count 1, 2, 3 ...)."""
    bits = np.fromiter(map(cells.__getitem__, words), np.int64, len(words))
    bullets = int(np.count_nonzero(bits & 1)) - bool(len(bits) and bits[-1] & 1 and not text[-1].isspace())
    run = 1
    for i in np.flatnonzero(bits & 2).tolist():
        for n in cells.numbers[words[i]]:
            run += n == run
    labels, at = 0, text.find(":")
    while at >= 0:
        follows = text[at + 1 : at + 3].lstrip()
        labels += bool(follows and _LABEL.search(text, max(0, at - 80), at))
        at = text.find(":", at + 1)
    return bullets, labels, int((bits >> 14).sum()) / max(1, int((bits >> 2 & 1023).sum())), run - 1


NAMES = ("language", "words", *STATISTICS, "bullets", "labels", "counted")
#: The types of what :class:`Measure` gives, in Arrow and in Spark.
KINDS = (pa.string(), pa.int64(), *[pa.float64()] * len(STATISTICS), *[pa.int32()] * 3)
SCHEMA = "language string, words long, " + ", ".join(f"{s} double" for s in STATISTICS) + ", bullets int, labels int, counted int"


class Measure:
    """The statistics of a text, in the order of NAMES. With ``kind_only`` those that do not bear on the kind are null."""

    NOTHING = (None,) * len(NAMES)

    def __init__(self, words: Words, kind_only: bool = False):
        self.words, self.cells, self.kind_only = words, Cells(), kind_only

    def __call__(self, text: str, own: list[str], bits: np.ndarray) -> tuple:
        """``own`` are the terms of the text, ``bits`` what ``words`` has for them."""
        words, solid = text.split(), (bits & 1).astype(bool)
        length, in_words, n, letters = bits >> 4, sum(map(len, words)), max(1, len(words)), np.count_nonzero(solid)
        lang = "en" if int(length[solid].sum()) * 2 >= len(text) and text.replace("\u20b9", "").isascii() else language(text)
        bullets, labels, cell_share, counted = shape(text, words, self.cells)
        rest = (None,) * (len(STATISTICS) - FOR_KIND)
        if not self.kind_only:
            rest = len(_DIGIT_WORD.findall(text)) / n, in_words / n, len(_LINE_STOP.findall(text)) / max(1, len(_LINE.findall(text))), len(set(own)) / max(1, len(own))
        return (
            lang, len(words), np.count_nonzero(bits & 4) / n, np.count_nonzero(bits & 2) / letters if letters else 0.0, max(0, in_words - int(length.sum())) / max(1, len(text)),
            cell_share, labels / n, bullets / n, *rest, bullets, labels, counted,
        )


def known_words(texts: DataFrame, column: str = "text") -> np.ndarray:
    """The sorted hashes of the terms of at least KNOWN_IN texts, counted over all of them."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = TermHashes()
        for batch in batches:
            parts = [np.empty(0, np.uint64), *(hashes([*set(terms(t))]) for t in batch.column(0).to_pylist() if t)]
            own, n = np.unique(np.concatenate(parts), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(own.view(np.int64)), pa.array(n.astype(np.int64))], names=["hash", "n"])

    counts = texts.select(column).mapInArrow(count, "hash long, n long").groupBy("hash").agg(F.sum("n").alias("n"))
    return KnownHashes.collect(counts.where(F.col("n") >= KNOWN_IN))


def statistics(rows: DataFrame, id_col: str = "ingest_pos", text_col: str = "text", count_col: str = "word_count", kind_only: bool = False) -> DataFrame:
    """One row per row of the table: id, given count and the statistics of :class:`Measure`; nulls for a null text."""
    rows = rows.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(count_col).cast("long").alias("given"))
    table = rows.sparkSession.sparkContext.broadcast(known_words(rows))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words(table.value)
        one = Measure(words, kind_only)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            cols = list(zip(*(Measure.NOTHING if t is None else one(t, own := terms(t), words.bits(own)) for t in texts))) or [()] * len(NAMES)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), *(pa.array(c, k) for c, k in zip(cols, KINDS))], names=["id", "given", *NAMES])

    kind = rows.schema["id"].dataType.simpleString()
    return rows.select("id", "text", "given").mapInArrow(measure, f"id {kind}, given long, {SCHEMA}")


def judge(told: DataFrame, kind_only: bool = False) -> DataFrame:
    """The rows of a table of statistics with, for each, its percentile ``p_`` (a share of 21 quantiles) and robust z-score ``z_`` in the language, and ``kind``.

    A text in no language is judged against all texts. The median absolute deviation is estimated
    by half the spread of the quartiles. Beside the tails of the distributions the kinds rest on
    what the words mean: a table has mostly values, junk mostly unknown words or hardly a function
    word, a list at least two items or too few function words for prose.
    """
    asked = STATISTICS[:FOR_KIND] if kind_only else STATISTICS
    sketches = told.where("words >= 20").rollup("language").agg(F.grouping("language").alias("all"), *(F.kll_sketch_agg_double(s, 1000).alias(f"sketch_{s}") for s in asked))
    sketches = sketches.where("all = 1 or language <> 'und'").withColumn("language", F.when(F.col("all") == 1, "und").otherwise(F.col("language"))).drop("all")
    ranks = F.array(*(F.lit(i / 20) for i in range(21)))
    sketches = sketches.select("language", *(F.kll_sketch_get_quantile_double(f"sketch_{s}", ranks).alias(f"twentieths_{s}") for s in asked))
    for s in asked:
        q = F.col(f"twentieths_{s}")
        sketches = sketches.withColumns({f"median_{s}": q[10], f"mad_{s}": F.greatest((q[15] - q[5]) / 2, F.lit(0.01))})
    out = told.join(F.broadcast(sketches), "language", "left")  # a handful of languages

    def below(s: str) -> Column:
        return F.size(F.filter(f"twentieths_{s}", lambda q: q < F.col(s))) / 21

    for s in asked:
        out = out.withColumn(f"p_{s}", below(s)).withColumn(f"z_{s}", (F.col(s) - F.col(f"median_{s}")) / (F.col(f"mad_{s}") * 1.4826))
    low = lambda s: F.coalesce(F.col(f"z_{s}") < -TAIL, F.lit(False))
    high = lambda s: F.coalesce(F.col(f"z_{s}") > TAIL, F.lit(False))
    counted_words = F.col("language").isin("en", "und")  # languages whose function words are counted
    terse, enough = counted_words & low("common_share"), F.col("words") >= ENOUGH
    marked = (high("label_share") & (F.col("labels") >= 2)) | (high("bullet_share") & (F.col("bullets") >= 2))
    readable = F.col("known_share") >= 0.5
    table = terse & high("cell_share") & (F.col("cell_share") >= 0.5) & ((readable & enough) | (F.col("counted") >= 3))
    junk = (low("known_share") & ~readable & (F.col("words") >= 4)) | (terse & enough & (F.col("common_share") < SPARSE) & ~marked)
    items = ((terse | ~counted_words) & marked) | (terse & enough)
    kind = F.when(table, "table").when(junk, "junk").when(items, "list")
    return out.withColumn("kind", F.when(F.col("words").isNotNull(), kind)).drop(*(f"{x}_{s}" for s in asked for x in ("twentieths", "median", "mad")))


def judged(rows: DataFrame, id_col: str = "ingest_pos", text_col: str = "text", count_col: str = "word_count", kind_only: bool = False) -> DataFrame:
    """The statistics of every row, judged (see :func:`judge`), and ``bad_count``.

    ``kind`` is ``list``, ``table``, ``junk`` or null (prose, or too little text to tell);
    ``bad_count`` tells whether the given count is null or wrong, and is null for a null text. Of a
    null text everything else is null too. Repeated rows are judged each; other columns are not read.
    """
    told = materialize(statistics(rows, id_col, text_col, count_col, kind_only), "statistics")
    words = F.col("words")
    bad = F.when(words.isNotNull(), F.coalesce(F.col("given") != words, F.lit(True)))
    return judge(told, kind_only).withColumn("bad_count", bad).withColumnRenamed("id", id_col)


def found(rows: DataFrame) -> DataFrame:
    """(ingest_pos, kind): one row per kind of a text, and one more where its count is wrong."""
    kinds = F.array_compact(F.array("kind", F.when(F.col("bad_count"), "bad_count")))
    return judged(rows, kind_only=True).select("ingest_pos", F.explode(kinds).alias("kind"))
