"""The offline build: sources to chunks, chunks to the vector table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import clean_text, falsy_coalesce, is_blank, word_count
from ..operators import chunk, curate, vector
from ..session import materialize
from ..sources import documents as sources


def statute_chunks(pages: DataFrame, manifest: DataFrame) -> DataFrame:
    return chunk.chunk_documents(sources.statutes(pages, manifest), "text", "source", "doc_type")


def judgment_source(config: Column) -> Column:
    return F.concat(F.lit("SC Judgment — "), F.coalesce(config, F.lit("iltur")))


def judgment_chunks(judgments: DataFrame, cap: int = 1000, seed: int = 42) -> DataFrame:
    """At most ``cap`` chunks of at most 3 ``cap`` judgments, both in the seeded order of doc_id."""
    some = curate.sample(judgments.select("doc_id", "text", "doc_type", "court", "source_config").distinct(), "doc_id", 3 * cap, seed)
    cleaned = sources.spread(some).select("doc_id", clean_text(F.col("text")).alias("text"), judgment_source(F.col("source_config")).alias("source"), "doc_type", "court", "source_config")
    made = chunk.chunk_documents(cleaned, "text", "source", "doc_type", ["doc_id", "court", "source_config"])
    return curate.cap_chunks(made, [curate.seeded_order("doc_id", seed), F.col("doc_id"), F.col("chunk_no")], cap).drop("doc_id")


def prechunked_chunks(rows: DataFrame, order: str, cap: int = 2000, seed: int = 42, min_chars: int = 80) -> DataFrame:
    """At most ``cap`` of the ready-made chunks, in the seeded order of ``order``; those without an id are numbered."""
    # as a generator, so that the filter isn't moved before the cleaning and cleans again
    cleaned = rows.withColumn("text", F.explode(F.array(clean_text(F.col("text"))))).where(F.length("text") >= min_chars)
    taken = curate.running_index(curate.sample(cleaned, order, cap, seed).withColumn("_at", curate.seeded_order(order, seed)), "_at", "_i")
    return taken.select(
        falsy_coalesce(F.col("chunk_id"), F.format_string("sc_%05d", "_i")).alias("chunk_id"), "text", F.coalesce("source", F.lit("Supreme Court of India")).alias("source"),
        F.lit("judgment").alias("doc_type"), F.lit("").alias("section"), word_count(F.col("text")).alias("word_count"),
    )


def build_corpus(pages: DataFrame, manifest: DataFrame, judgments: DataFrame, prechunked: DataFrame, order: str = "ingest_pos", judgment_cap: int = 1000, prechunked_cap: int = 2000, path: str | None = None) -> DataFrame:
    """The chunks of all statutes and of the capped other sources, with their ``origin``; written as a JSON array too if there is a path."""
    made = {"statutes": statute_chunks(pages, manifest), "judgments": judgment_chunks(judgments, judgment_cap), "prechunked": prechunked_chunks(prechunked, order, prechunked_cap)}
    out = curate.union_sources(*(d.withColumn("origin", F.lit(origin)) for origin, d in made.items())).drop("chunk_no")
    out = materialize(out, "corpus")
    if path:
        sources.write_json_array(out.drop("origin"), path)
    return out


def load_corpus(chunks: DataFrame, path: str, key: str = "chunk_id", order: str | None = None, embed=None) -> DataFrame:
    """Adds the chunks that the vector table lacks and returns the table. ``embed`` maps new rows to rows with vectors."""
    fresh = chunks.where(~is_blank(F.col("text")))
    vector.append(fresh, path, key, order, embed)
    return chunks.sparkSession.read.parquet(path)
