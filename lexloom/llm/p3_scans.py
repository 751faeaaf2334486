"""Repair of text from scanned pages.

Words are grouped by a skeleton of easily confused glyphs; a form gives way to a form of its group
that is many times as frequent and that its neighbours support. Running titles are lines that recur across texts
once digits are masked. Lines are joined into paragraphs with SQL windows.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize
from .p5_quality import KINDS, NAMES, SCHEMA, Measure, Words
from .terms import KnownHashes, TermHashes, as_ascii, ascii_words, distinct, hash64, shingle_hashes, terms

#: A running title stands in at least this many texts.
TITLE_IN = 4
#: A form is frequent from this many texts on, and must be so many times as frequent as the form it replaces.
FREQUENT, TIMES = 12, 12

#: Pairs of words that a task holds before it gives its counts on.
HELD = 4_000_000

# What a scanner reads, and what stands there.
GLYPHS = (
    ("ã", "a"), ("!", "i"), ("5", "s"), ("0", "o"), ("1", "l"), ("9", "g"), ("6", "b"),
    ("vv", "w"), ("rn", "m"), ("ri", "n"), ("cl", "d"), ("li", "h"), ("ii", "u"),
    ("c", "e"), ("f", "t"), ("b", "h"),
)

_HYPHENS = "-­‐‑¬"
_CUT = re.compile(rf"([^\W\d_]+)[{_HYPHENS}][ \t\r]*$")
_CUT_INLINE = re.compile(rf"[{_HYPHENS}](?<=[^\W\d_].)\s+(?=[^\W\d_])")
_GOES_ON = re.compile(r"\s*[^\W\d_]")
_MARK = re.compile(r"^\s*--- Page \d+ ---\s*$")
_PAGENO = re.compile(r"^(?:[-–—|*•.\[(]\s*)*(?:p\s*a\s*g\s*e\b|pg\b|p\b)?[\s.:|]*\d{1,4}(?:\s*(?:of|/)\s*\d{1,4})?\s*(?:[-–—|*•.\])]\s*)*$", re.I)
_CLAUSE = re.compile(r"^(?:\(\d{1,3}\)|\d{1,3}\))\.?$")
_PAGENO_INLINE = re.compile(r"(?:\bp ?a ?g ?e \|? ?\d{1,4}\b(?: of \d{1,4}(?![\d,]))?|\[pg\. ?\d{1,4}\]|(?<!\d\s)(?<=\s)[-—–] \d{1,4} [-—–](?=\s|$)|\( \d{1,4} \))", re.I)
_HEADING = re.compile(r"^\W*(?:chapter|part|section|schedule|article|order|annexure|appendix)\b[\s.:-]*(?:[ivxlc\d]+[a-z]?\b)?", re.I)
_NUMBERS = re.compile(r"[\[(]?\b\d{1,4}\b[\])]?")
_CAPITALS = re.compile(r"[A-Z0-9]{2,}(?:[ ,&'—–-]+(?:[A-Z0-9]{2,}|[A-Z])(?![a-z]))+")
#: A title's page number that is left after it.
_AFTER_TITLE = re.compile(r" \d{1,4}(?!\S)")
#: A word, possibly with wrong glyphs inside.
_WORD = re.compile(r"(?:!(?=[a-z]))?[A-Za-zã0-9]+(?:![A-Za-zã0-9]+)*")
_PLAIN_WORD = re.compile(r"[A-Za-zã0-9]+")
_CAPITAL_RUN = re.compile(r"[A-Z]{2}")
_LOWER = re.compile(r"(?:[^a-z]*[a-z]){6}")
_MONTH_END = re.compile(r"(?:\b(?:january|february|march|april|may|june|july|august|september|october|november|december)(?: \d{1,2},)?|\b(?:of|no\.|section|rs\.?|rupees|act|for|the|and|within|by|on|paise|₹)|[,\d/])$", re.I)
_FIRST = str.maketrans({"0": "O", "5": "S", "1": "I", "!": "I", "6": "B", "9": "G", "8": "B"})


def skeleton(word: str) -> str:
    word = word.lower()
    for wrong, right in GLYPHS:
        if wrong in word:
            word = word.replace(wrong, right)
    return word


def skeletons(word: Column) -> Column:
    """:func:`skeleton` as a column."""
    word = F.lower(word)
    for wrong, right in GLYPHS:
        word = F.replace(word, F.lit(wrong), F.lit(right))
    return word


def title_key(line: str) -> str | None:
    """A line in capitals with its numbers masked, or null if it can't be a running title."""
    if _LOWER.match(line):
        return None
    line = line.strip()
    if not 6 <= len(line) <= 90 or _HEADING.match(line):
        return None
    bare = _NUMBERS.sub(" ", line)
    letters = [c for c in bare if c.isalpha()]
    if len(letters) < 6 or sum(map(str.isupper, letters)) < 0.85 * len(letters) or ":" in line or line.endswith((".", ";", ",")):
        return None
    return skeleton("".join(c for c in bare.translate(_FIRST) if c.isalpha()))


def words_of(line: str) -> list[str]:
    if "!" in line:
        return _WORD.findall(line)
    return ascii_words(plain) if (plain := as_ascii(line)) is not None else _PLAIN_WORD.findall(line)


class Reader:
    """Splits a text into lines and tells what each is. ``titles`` tells whether a key is a running title."""

    def __init__(self, titles):
        self.titles = titles

    def kinds(self, lines: list[str]) -> list[str]:
        """``header``, ``pageno``, ``mark``, ``blank`` or ``text`` for each line."""
        out = []
        before = ""
        for i, line in enumerate(lines):
            if len(line) > 60 and _LOWER.match(line):  # too long for a mark or a page number
                out.append("text")
                before = line.strip()
                continue
            bare = line.strip()
            if not bare:
                out.append("blank")
            elif _MARK.match(line):
                out.append("mark")
            elif self._pageno(bare, before, lines, i):
                out.append("pageno")
            elif (key := title_key(bare)) and self.titles(key):
                out.append("header")
            else:
                out.append("text")
                before = bare
        return out

    @staticmethod
    def _pageno(bare: str, before: str, lines: list[str], i: int) -> bool:
        if len(bare) > 24 or not _PAGENO.match(bare) or _CLAUSE.match(bare):
            return False
        if re.fullmatch(r"\d{1,4}\.", bare):  # or the last word of a paragraph
            return not (before and lines[i - 1].strip() == before and _MONTH_END.search(before))
        return True


def texts_of(rows: list[tuple[str, DataFrame, str, str]]) -> DataFrame:
    out = None
    for src, df, id_col, text_col in rows:
        part = df.select(F.lit(src).alias("src"), F.col(id_col).cast("string").alias("item_id"), F.col(text_col).alias("text")).where("text is not null")
        out = part if out is None else out.unionByName(part)
    return out


def each_once(texts: DataFrame) -> DataFrame:
    """The texts without repeated rows of an id; they are only shuffled if there are any."""
    ids = texts.groupBy("src", "item_id").count().where("count > 1")
    return texts if ids.isEmpty() else texts.distinct()


def word_counts(texts: DataFrame) -> DataFrame:
    """(kind, key, hash, n): in how many texts each word, pair of words and possible running title stands, without bound.

    ``kind`` is ``word``, ``pair`` or ``title``; ``key`` is the word or the title's key, null for a
    pair. Pairs are told apart by 64-bit hashes.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = TermHashes()

        def rows(words: Counter, titles: Counter, pairs: list[np.ndarray]) -> pa.RecordBatch:
            pairs, n = np.unique(np.concatenate(pairs), return_counts=True)
            kinds = ["word"] * len(words) + ["title"] * len(titles) + ["pair"] * len(pairs)
            keys = [*words, *titles, *[None] * len(pairs)]
            own = np.concatenate([hashes([*words, *titles]), pairs]).view(np.int64)
            n = np.concatenate([np.array([*words.values(), *titles.values()], np.int64), n])
            return pa.RecordBatch.from_arrays([pa.array(kinds, pa.string()), pa.array(keys, pa.string()), pa.array(own), pa.array(n)], names=["kind", "key", "hash", "n"])

        words, titles, pairs, held = Counter(), Counter(), [np.empty(0, np.uint64)], 0
        for batch in batches:
            for text in batch.column(0).to_pylist():
                own = words_of(text.lower())
                pairs.append(distinct(shingle_hashes(hashes(own), 2)))
                words.update(set(own) if as_ascii(text) is not None else {*own, *terms(text)})
                if "\n" in text:
                    titles.update({k for line in text.split("\n") if not _LOWER.match(line) and (k := title_key(line))})
                held += len(pairs[-1])
                if held > HELD:
                    yield rows(words, titles, pairs)
                    words, titles, pairs, held = Counter(), Counter(), [np.empty(0, np.uint64)], 0
        yield rows(words, titles, pairs)

    counted = each_once(texts).select("text").mapInArrow(count, "kind string, key string, hash long, n long")
    return materialize(counted.groupBy("kind", "key", "hash").agg(F.sum("n").alias("n")), "counts")


def known_hashes(counts: DataFrame, kind: str, least: int) -> Broadcast:
    """The hashes of the keys of a kind that stand in at least so many texts."""
    return counts.sparkSession.sparkContext.broadcast(KnownHashes.collect(counts.where((F.col("kind") == kind) & (F.col("n") >= least))))


def frequent_forms(counts: DataFrame) -> DataFrame:
    forms = counts.where((F.col("kind") == "word") & (F.col("n") >= FREQUENT) & F.col("key").rlike("^[a-zã]{2,}$"))
    return forms.select(F.col("key").alias("form"), skeletons(F.col("key")).alias("skeleton"), F.col("n").alias("form_n"))


def suspect_words(counts: DataFrame) -> Broadcast:
    """The hashes of the words for which there is a form TIMES as frequent with the same skeleton."""
    words = counts.where((F.col("kind") == "word") & F.col("key").rlike("^[a-zã0-9!]{3,}$") & (F.col("key").rlike("^[a-zã]+$") | F.col("key").rlike("[a-zã].*[a-zã]")))
    words = words.withColumn("skeleton", skeletons(F.col("key")))
    found = words.join(frequent_forms(counts), "skeleton").where((F.col("key") != F.col("form")) & (F.col("form_n") >= TIMES * F.col("n")))
    return counts.sparkSession.sparkContext.broadcast(KnownHashes.collect(found))


_PAGENO_SIGNS = (" - ", " — ", " – ", "( ", "[Pg", "[pg", "page ", "Page ", "PAGE ", "a g e ")


class Finder:
    """Finds the noise of a text: (line_no, kind, word, before, after). ``words`` tells suspect words, ``titles`` known titles."""

    SUSPECT = 8

    def __init__(self, words: Words, titles: KnownHashes):
        self.words, self.reader = words, Reader(lambda key: titles.has(hash64(key.encode())))

    def __call__(self, text: str, own: list[str], bits: np.ndarray) -> list[tuple]:
        """``own`` are the terms of the text, ``bits`` what ``words`` has for them."""
        # in such a text terms and words are the same
        plain = "!" not in text and as_ascii(text) is not None
        clean = plain and not (bits & self.SUSPECT).any()
        lines = text.split("\n")
        return self._in_one_line(text, clean) if len(lines) == 1 else self._in_lines(lines, clean)

    def _in_one_line(self, text: str, clean: bool) -> list[tuple]:
        out: list[tuple] = []
        heads = [m for m in (_CAPITALS.finditer(text) if _CAPITAL_RUN.search(text) else ()) if (k := title_key(m[0])) and self.reader.titles(k)]
        rest = text
        for m in reversed(heads):
            end = more.end() if (more := _AFTER_TITLE.match(text, m.end())) else m.end()
            out.append((1, "header", text[m.start() : end], None, None))
            rest = rest[: m.start()] + " " + rest[end:]
        if any(map(rest.__contains__, _PAGENO_SIGNS)):
            numbers = [m[0] for m in _PAGENO_INLINE.finditer(rest)]
            if numbers:
                out += [(1, "pageno", n, None, None) for n in numbers]
                rest = _PAGENO_INLINE.sub(" ", rest)
        joined: set[str] = set()
        if any(map(rest.__contains__, _HYPHENS)) and _CUT_INLINE.search(rest):
            out.append((1, "hyphen", None, None, None))
            parted = set(words_of(rest.lower()))
            rest = _CUT_INLINE.sub("", rest)
            joined = set(words_of(rest.lower())) - parted
        if not clean or joined:
            self._suspects(words_of(rest), None, joined, out)
        return out

    def _in_lines(self, lines: list[str], clean: bool) -> list[tuple]:
        kinds = self.reader.kinds(lines)
        out: list[tuple] = [(i, k, None, None, None) for i, k in enumerate(kinds, 1) if k in ("header", "pageno")]
        running = [i for i, k in enumerate(kinds) if k == "text"]
        cuts = {i for i, after in zip(running, running[1:]) if (lines[i].rstrip()[-1:] or "x") in _HYPHENS and _CUT.search(lines[i]) and _GOES_ON.match(lines[after])}
        if clean and not cuts:
            return out
        tokens: list[str] = []
        places: list[int] = []
        joined: tuple[int, str] | None = None
        wholes: set[str] = set()
        for i in running:
            words = words_of(lines[i])
            if joined is not None and words:  # the word began on the line before
                whole = joined[1] + words.pop(0)
                tokens.append(whole)
                places.append(joined[0])
                wholes.add(whole.lower())
            joined = None
            if i in cuts:
                out.append((i + 1, "hyphen", None, None, None))
                joined = (i + 1, words.pop()) if words else None
            tokens += words
            places += [i + 1] * len(words)
        self._suspects(tokens, places, wholes, out)
        return out

    def _suspects(self, tokens: list[str], places: list[int] | None, joined: set[str], out: list[tuple]) -> None:
        """Words that may be wrong, and those put together here, which may not be counted; ``places`` has the words' lines, if not all are in line 1."""
        if not tokens:
            return
        low = " ".join(tokens).lower().split(" ")
        hits = (self.words.bits(low) & self.SUSPECT).astype(bool)
        if joined:
            hits |= np.fromiter(map(joined.__contains__, low), bool, len(low))
        for i in np.flatnonzero(hits).tolist():
            word = low[i]
            if len(word) > 2 and (word.isalpha() or sum(map(str.isalpha, word)) > 1):
                out.append((places[i] if places else 1, "glyph", tokens[i], low[i - 1] if i else None, low[i + 1] if i + 1 < len(low) else None))


def look(tables: list[tuple[str, DataFrame, str, str]], counts: DataFrame, measured: str | None = None, known: np.ndarray | None = None) -> DataFrame:
    """What may be noise in each text, and, in the same pass, the statistics of the texts of one table.

    (src, item_id, line_no, kind, word, before, after) and the columns of p5's statistics; these are
    in a row of its own, of kind ``text``, for each text of the table ``measured``; ``known`` has
    the hashes of the known words.
    """
    context = counts.sparkSession.sparkContext
    suspect, titles = suspect_words(counts), known_hashes(counts, "title", TITLE_IN)
    shared = context.broadcast(known if known is not None else np.empty(0, np.int64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words(shared.value, suspect.value)
        find, measure = Finder(words, KnownHashes(titles.value)), Measure(words, kind_only=True)
        for batch in batches:
            at, out, told = [], [], []
            for i, (src, text) in enumerate(zip(batch.column(0).to_pylist(), batch.column(2).to_pylist())):
                own = terms(text)
                bits = words.bits(own)
                found = find(text, own, bits)
                if src == measured:
                    found.append((None, "text", None, None, None))
                    told += [measure.NOTHING] * (len(found) - 1) + [measure(text, own, bits)]
                else:
                    told += [measure.NOTHING] * len(found)
                at += [i] * len(found)
                out += found
            cols, more = list(zip(*out)) or [()] * 5, list(zip(*told)) or [()] * len(NAMES)
            at = pa.array(at, pa.int64())
            arrays = [batch.column(0).take(at), batch.column(1).take(at), pa.array(cols[0], pa.int32()), *(pa.array(c, pa.string()) for c in cols[1:]), *(pa.array(c, k) for c, k in zip(more, KINDS))]
            yield pa.RecordBatch.from_arrays(arrays, names=["src", "item_id", "line_no", "kind", "word", "before", "after", *NAMES])

    found = texts_of(tables).mapInArrow(run, f"src string, item_id string, line_no int, kind string, word string, before string, after string, {SCHEMA}")
    return materialize(found, "seen")


def find_noise(tables: list[tuple[str, DataFrame, str, str]], counts: DataFrame | None = None, seen: DataFrame | None = None) -> DataFrame:
    """(src, item_id, line_no, kind, wrong, right) of the noise in texts.

    ``tables`` has, for each table, its name, rows, id and text column. Lines are counted from 1
    and end at ``\\n``; kinds are ``header``, ``pageno``, ``hyphen`` and ``glyph``; ``wrong`` and
    ``right`` are the forms of a word with wrong glyphs. In a text without line breaks every finding
    has line_no 1, and ``wrong`` is the title or page number. Null texts have none; repeated rows of
    an id count once; titles and words are counted over all texts, or by ``counts``, made by
    :func:`word_counts`; ``seen`` is what :func:`look` gives.
    """
    counts = counts if counts is not None else word_counts(texts_of(tables))
    seen = (seen if seen is not None else look(tables, counts)).where("kind <> 'text'").select("src", "item_id", "line_no", "kind", "word", "before", "after")
    seen = seen.distinct()
    low = F.lower("word")
    known = counts.where("kind = 'word'").select(F.col("key").alias("low"), "n")
    glyph = seen.where("kind = 'glyph'").withColumns({"low": low, "skeleton": skeletons(low)}).join(known, "low", "left").join(frequent_forms(counts), "skeleton")
    glyph = glyph.where((F.col("low") != F.col("form")) & (F.col("form_n") >= TIMES * F.coalesce("n", F.lit(0))))

    def pair_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = TermHashes()
        for batch in batches:
            before, after, form = (batch.column(c).to_pylist() for c in ("before", "after", "form"))
            key = lambda a, b: None if a is None or b is None else int(shingle_hashes(hashes([a, b]), 2).view(np.int64)[0])
            keys = [pa.array(map(key, a, b), pa.int64()) for a, b in ((before, form), (form, after))]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("src", "item_id", "line_no", "word", "form", "form_n")), *keys], names=["src", "item_id", "line_no", "wrong", "right", "form_n", "pair_before", "pair_after"])

    glyph = glyph.select("src", "item_id", "line_no", "word", "form", "form_n", "before", "after")
    glyph = glyph.mapInArrow(pair_up, "src string, item_id string, line_no int, wrong string, right string, form_n long, pair_before long, pair_after long")
    for side in ("before", "after"):
        pairs = counts.where("kind = 'pair'").select(F.col("hash").alias(f"pair_{side}"), F.col("n").alias(f"n_{side}"))
        glyph = glyph.join(pairs, f"pair_{side}", "left")
    glyph = glyph.withColumn("support", F.greatest(F.coalesce("n_before", F.lit(0)), F.coalesce("n_after", F.lit(0))))
    odd = F.col("wrong").rlike("[0-9!ã]")
    glyph = glyph.where(odd | (F.col("support") >= 2))
    best = Window.partitionBy("src", "item_id", "line_no", "wrong").orderBy(F.desc("support"), F.desc("form_n"), "right")
    glyph = glyph.withColumn("place", F.row_number().over(best)).where("place = 1")
    plain = seen.where("kind in ('header', 'pageno', 'hyphen')").select("src", "item_id", "line_no", "kind", F.col("word").alias("wrong"), F.lit(None).cast("string").alias("right"))
    return plain.unionByName(glyph.select("src", "item_id", "line_no", F.lit("glyph").alias("kind"), "wrong", "right"))


def repair(tables: list[tuple[str, DataFrame, str, str]], counts: DataFrame | None = None, seen: DataFrame | None = None) -> DataFrame:
    """(src, item_id, paragraph_no, paragraph): the texts as continuous paragraphs.

    Running titles, page numbers and the extractor's page marks are dropped, cut words joined and
    wrong forms replaced, in the case of the word. A paragraph ends at a blank line or a heading; a
    text without line breaks is one paragraph. Null and blank texts have none. ``counts`` and
    ``seen`` as for :func:`find_noise`.
    """
    noise = materialize(find_noise(tables, counts, seen), "noise")
    key = ["src", "item_id"]
    pair = F.struct("wrong", "right")
    by_line = noise.groupBy(*key, "line_no").agg(
        F.collect_set("kind").alias("kinds"), F.collect_set(F.when(F.col("kind") == "glyph", pair)).alias("words"),
        F.collect_set(F.when(F.col("kind").isin("header", "pageno"), F.col("wrong"))).alias("dropped"),
    )
    split = F.split("text", "\n")
    lines = each_once(texts_of(tables)).select(*key, F.size(split).alias("n"), F.posexplode(split).alias("i", "line")).withColumn("line_no", F.col("i") + 1).join(by_line, [*key, "line_no"], "left")
    has = lambda k: F.coalesce(F.array_contains("kinds", k), F.lit(False))
    one = F.col("n") == 1
    bare = lambda c: F.regexp_replace(c, r"^\s+|\s+$", "")
    # longest first: a page number may begin another
    longest = F.array_sort(F.coalesce("dropped", F.array().cast("array<string>")), lambda a, b: F.length(b) - F.length(a))
    line = F.aggregate(longest, F.col("line"), lambda text, w: F.replace(text, w, F.lit(" ")))
    line = F.when(one & has("hyphen"), F.regexp_replace(line, rf"(\p{{L}})[{_HYPHENS}]\s+(?=\p{{L}})", "$1")).otherwise(line)
    lines = lines.where(~(~one & (has("header") | has("pageno")))).withColumn("line", bare(line)).where(~F.col("line").rlike(r"^--- Page \d+ ---$"))
    lines = lines.withColumn("heading", F.col("line").rlike(r"^(?:CHAPTER|PART|SECTION|SCHEDULE|Chapter|Part|Schedule) [IVXLCDM\d]+\b|^\([ivxlc\d]{1,6}\)$") & (F.length("line") < 60) & ~F.col("line").rlike("[.,;]$"))
    order = Window.partitionBy(*key).orderBy("line_no")
    before = lambda c: F.coalesce(F.lag(c).over(order), F.lit(True))
    starts = (F.length("line") == 0) | F.col("heading") | before(F.col("heading")) | before(F.length("line") == 0)
    lines = lines.withColumn("starts", starts).withColumn("paragraph", F.sum(F.col("starts").cast("int")).over(order))
    cut = ~one & has("hyphen")
    piece = F.when(cut, F.regexp_replace("line", rf"[{_HYPHENS}]\s*$", "")).otherwise(F.concat("line", F.lit(" ")))
    lines = lines.where(F.length("line") > 0).groupBy(*key, "paragraph").agg(F.sort_array(F.collect_list(F.struct("line_no", piece.alias("piece")))).alias("pieces"), F.flatten(F.collect_list("words")).alias("words"))
    # a word may be cut: wrong forms are replaced in the joined text
    joined = F.btrim(F.array_join(F.col("pieces.piece"), ""))

    def mend(text: Column, w: Column) -> Column:
        capital = F.left(w["wrong"], F.lit(1)).rlike("[A-Z]")
        right = F.when(w["wrong"].rlike("^[^a-zã]*[A-Z][^a-zã]*$"), F.upper(w["right"])).when(capital, F.concat(F.upper(F.left(w["right"], F.lit(1))), F.substring(w["right"], 2, 1_000))).otherwise(w["right"])
        return F.regexp_replace(text, F.concat(F.lit("(?<![A-Za-zã0-9])"), w["wrong"], F.lit("(?![A-Za-zã0-9])")), right)

    lines = lines.withColumn("text", F.aggregate(F.filter("words", lambda w: w.isNotNull()), joined, mend))
    number = F.row_number().over(Window.partitionBy(*key).orderBy("paragraph"))
    return lines.where(F.length("text") > 0).select(*key, number.alias("paragraph_no"), F.col("text").alias("paragraph"))
