"""Scalar text functions as Spark columns. Null in, null out, unless told otherwise."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as Python's ``\s`` has it; the form is the same for Java and RE2.
WS = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"

# Phrases and addresses of the publishers' running headers, dropped wherever they stand.
HEADERS = rf"(?i)THE{WS}+GAZETTE{WS}+OF{WS}+INDIA|MINISTRY{WS}+OF{WS}+LAW|GOVERNMENT{WS}+OF{WS}+INDIA|www\.legislative\.gov\.in|legislative\.gov\.in|www\.indiacode\.nic\.in|indiacode\.nic\.in"
PAGE_NUMBER = rf"^{WS}*\p{{Nd}}{{1,4}}{WS}*$"
SEPARATOR = rf"^[\-_.=]{{3,}}{WS}*$"
HYPHENATED = r"([\p{L}\p{N}_])-\n([\p{L}\p{N}_])"
#: Lines of three or more characters without ASCII letters, digits, Malayalam or Devanagari.
SYMBOLS = rf"^{WS}*[^a-zA-Z0-9\x{{0D00}}-\x{{0D7F}}\x{{0900}}-\x{{097F}}\n]{{3,}}{WS}*$"
#: Section labels in order of precedence; the first group is the label.
SECTIONS = (
    rf"(?i)^(Section{WS}+\p{{Nd}}+[A-Z]?[.\-]?{WS}*[A-Z][^.]*)",
    rf"(?i)^(\p{{Nd}}+[A-Z]?[.)]{WS}+[A-Z][^.]{{5,60}})",
    rf"(?i)^(CHAPTER{WS}+[IVXLC]+(?:\.|{WS})[^\n]*)",
    rf"(?i)^(PART{WS}+[IVXLC]+(?:\.|{WS})[^\n]*)",
)
#: The marker that stands for a sentence end until the text is split there.
SENTENCE_END = rf"([.?!]){WS}+"


def strip(text: Column) -> Column:
    return F.regexp_replace(text, rf"^{WS}+|{WS}+\z", "")


def clean_text(text: Column) -> Column:
    """Seven rewrites in order: page-number lines, headers, separators, cut words, blanks, symbol lines, blank lines; then strip."""
    text = F.regexp_replace(text, "(?md)" + PAGE_NUMBER, "")
    text = F.regexp_replace(text, HEADERS, "")
    text = F.regexp_replace(text, "(?md)" + SEPARATOR, "")
    text = F.regexp_replace(text, HYPHENATED, "$1$2")
    text = F.regexp_replace(text, "[ \\t]+", " ")
    text = F.regexp_replace(text, "(?md)" + SYMBOLS, "")
    return strip(F.regexp_replace(text, "\\n{3,}", "\n\n"))


def section_header(text: Column, length: int = 80) -> Column:
    """The section label at the start of a paragraph, or null."""
    bare = strip(text)
    return F.left(strip(F.coalesce(*(F.nullif(F.regexp_extract(bare, p, 1), F.lit("")) for p in SECTIONS))), F.lit(length))


def paragraphs(text: Column) -> Column:
    """The non-blank parts between blank lines, stripped."""
    return F.filter(F.transform(F.split(text, "\\n{2,}"), strip), lambda p: p != "")


def sentences(text: Column) -> Column:
    """The parts between sentence ends followed by white space."""
    return F.split(text, rf"(?<=[.?!]){WS}+")


def words(text: Column) -> Column:
    return F.array_remove(F.split(text, f"{WS}+"), "")


def word_count(text: Column) -> Column:
    return F.when(text.isNotNull(), F.size(words(text)))


def slug(text: Column, length: int = 25) -> Column:
    return F.left(F.regexp_replace(F.lower(text), "[^a-z0-9]", "_"), F.lit(length))


def content_hash(text: Column, length: int = 6) -> Column:
    return F.left(F.md5(text), F.lit(length))


def chunk_id(source: Column, ordinal: Column, text: Column) -> Column:
    return F.format_string("%s_%05d_%s", slug(source), ordinal, content_hash(text))


def falsy_coalesce(*texts: Column) -> Column:
    """The first text that is neither null nor empty, else the last."""
    return F.coalesce(*(F.nullif(t, F.lit("")) for t in texts[:-1]), texts[-1])


def is_blank(text: Column) -> Column:
    return F.length(strip(text)) == 0


def ocr_lines(text: Column) -> Column:
    """Lines stripped, blank ones dropped."""
    lines = F.transform(F.split(text, r"\r\n|[\n\r\x0B\x0C\x1c-\x1e\x{85}\x{2028}\x{2029}]"), strip)
    return F.array_join(F.filter(lines, lambda x: x != ""), "\n")


def preview(text: Column, length: int = 250) -> Column:
    return F.left(text, F.lit(length))


def echo(text: Column, length: int = 500) -> Column:
    """The text as a response shows it: cut with dots if it is longer."""
    return F.when(F.length(text) > length, F.concat(F.left(text, F.lit(length)), F.lit("..."))).otherwise(text)


def metadata(source: Column, doc_type: Column, section: Column, court: Column, count: Column) -> Column:
    """The string metadata of a stored vector; missing values become empty, a missing count "0"."""
    empty = lambda c: F.coalesce(c, F.lit(""))
    return F.struct(
        empty(source).alias("source"), empty(doc_type).alias("doc_type"), empty(section).alias("section"), empty(court).alias("court"), F.coalesce(count.cast("string"), F.lit("0")).alias("word_count")
    )
