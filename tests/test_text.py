from pyspark.sql import functions as F

from lexloom.functions import text as T


def one(spark, f, *values):
    df = spark.createDataFrame([(v,) for v in values], "t string")
    return [r[0] for r in df.select(f(F.col("t"))).collect()]


def test_clean_text(spark):
    page, cut, head, symbols, empty, null = one(
        spark, T.clean_text, "The tenant paid.\n\n 117 \n\nThe landlord denied it.", "A notice was deli-\nvered by post.", "www.indiacode.nic.in\nGovernment  of India\nPart I. Tenancies.", "a\n*** ### ***\nb\n-----\nc  d", "", None
    )
    assert page.split("\n\n") == ["The tenant paid.", "The landlord denied it."]
    assert cut == "A notice was delivered by post."
    assert head == "Part I. Tenancies."
    assert symbols.split() == ["a", "b", "c", "d"]
    assert (empty, null) == ("", None)


def test_section_header(spark):
    found = one(spark, T.section_header, "Section 7A. Duty to repair the roof.", "CHAPTER IX RENT AND DEPOSITS\nmore", "12. Short title of it. More", "CHAPTER IV", "plain", None)
    assert found == ["Section 7A. Duty to repair the roof", "CHAPTER IX RENT AND DEPOSITS", "12. Short title of it", None, None, None]


def test_words_and_keys(spark):
    assert one(spark, T.word_count, "a b  c\n", "", None) == [3, 0, None]
    assert one(spark, T.slug, "IPC 1860 — Pénal") == ["ipc_1860___p_nal"]
    assert one(spark, T.echo, "x" * 501, "y") == ["x" * 500 + "...", "y"]
    assert one(spark, T.ocr_lines, " a \r\n\n b\n") == ["a\nb"]
    assert one(spark, lambda c: T.falsy_coalesce(c, F.lit("z")), "", None, "q") == ["z", "z", "q"]
