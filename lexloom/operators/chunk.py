"""Section-aware, overlapping chunks of cleaned documents: a fold over unit sizes, without a shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import WS, chunk_id, paragraphs, section_header, sentences, words

_PIECES = "array<struct<s:int,e:int,label:string>>"


def _units(text: Column, size: int) -> Column:
    """(n words, label) of each paragraph, or of each sentence of a paragraph of more than ``size`` words.

    Paragraphs and their sentences are stripped and not empty, so their words are the parts between
    white space; the label is found once for a paragraph.
    """
    count = lambda x: F.size(F.split(x, f"{WS}+"))
    unit = lambda n, label: F.struct(n.alias("n"), label.alias("label"))
    told = F.transform(paragraphs(text), lambda p: F.struct(p.alias("text"), count(p).alias("n"), section_header(p).alias("label")))

    def of(p: Column) -> Column:
        parts = F.transform(sentences(p["text"]), lambda s: unit(count(s), p["label"]))
        return F.when(p["n"] <= size, F.array(unit(p["n"], p["label"]))).otherwise(parts)

    return F.flatten(F.transform(told, of))


def chunk_documents(docs: DataFrame, text_col: str, source_col: str, doc_type_col: str, keep: list[str] | None = None, size: int = 375, overlap: int = 38, min_chars: int = 50) -> DataFrame:
    """Chunks (kept columns, chunk_no, chunk_id, text, source, doc_type, section, word_count).

    Paragraphs, or sentences of long paragraphs, are packed greedily; a chunk begins with the last
    ``overlap`` words of the one before. The label is the latest one when the chunk is closed, so a
    chunk closed by a new heading carries the new label. Chunks of fewer than ``min_chars``
    characters are dropped but still lend their words. Null and empty texts give no chunk.
    Cutting costs far more than moving a text, so documents that come in few partitions should be
    dealt to more before they are cleaned and cut.
    """
    if overlap <= 0:
        raise ValueError("overlap must be positive")
    keep = keep or []
    start = F.struct(F.lit(0).alias("s"), F.lit(0).alias("e"), F.lit(None).cast("string").alias("label"), F.array().cast(_PIECES).alias("pieces"))

    def step(state: Column, unit: Column) -> Column:
        label = F.coalesce(unit["label"], state["label"])
        full = (state["e"] - state["s"] + unit["n"] > size) & (state["e"] > state["s"])
        piece = F.struct(state["s"].alias("s"), state["e"].alias("e"), label.alias("label"))
        return F.struct(
            F.when(full, F.greatest(state["s"], state["e"] - overlap)).otherwise(state["s"]).alias("s"),
            (state["e"] + unit["n"]).alias("e"),
            label.alias("label"),
            F.when(full, F.array_append(state["pieces"], piece)).otherwise(state["pieces"]).alias("pieces"),
        )

    def finish(state: Column) -> Column:
        last = F.struct(state["s"].alias("s"), state["e"].alias("e"), state["label"].alias("label"))
        return F.when(state["e"] > state["s"], F.array_append(state["pieces"], last)).otherwise(state["pieces"])

    rows = docs.where(F.col(text_col).isNotNull()).select(*keep, F.col(source_col).alias("source"), F.col(doc_type_col).alias("doc_type"), F.col(text_col).alias("_text"))
    rows = rows.withColumn("_words", words(F.col("_text"))).withColumn("_pieces", F.aggregate(_units(F.col("_text"), size), start, step, finish))
    made = F.transform("_pieces", lambda p: F.struct(F.array_join(F.slice("_words", p["s"] + 1, p["e"] - p["s"]), " ").alias("text"), F.coalesce(p["label"], F.lit("")).alias("section"), (p["e"] - p["s"]).alias("word_count")))
    rows = rows.select(*keep, "source", "doc_type", F.posexplode(F.filter(made, lambda c: F.length(c["text"]) >= min_chars)).alias("_i", "c"))
    rows = rows.select(*keep, (F.col("_i") + 1).alias("chunk_no"), "c.text", "source", "doc_type", "c.section", "c.word_count")
    return rows.withColumn("chunk_id", chunk_id(F.col("source"), F.col("chunk_no"), F.col("text")))
