"""The pN_ queries over the project's tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import materialize, table
from . import p1_similar, p2_split, p3_scans, p4_near, p5_quality, p6_cap, p7_copies, p8_tokenize, p9_leaks, p10_personal

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def _pieces(spark: SparkSession, root: str, operator: Callable[..., DataFrame]) -> DataFrame:
    chunks = operator(table(spark, root, "chunks"), "ingest_pos").withColumn("src", F.lit("chunks"))
    judgments = operator(table(spark, root, "iltur_judgments"), "doc_id").withColumn("src", F.lit("iltur_judgments"))
    return chunks.unionByName(judgments)


@query
def p1_found(spark: SparkSession, root: str) -> DataFrame:
    found = p1_similar.nearest(table(spark, root, "vector_rows"))
    return found.select(F.least("query", "neighbour").alias("vec_a"), F.greatest("query", "neighbour").alias("vec_b")).distinct()


@query
def p2_found(spark: SparkSession, root: str) -> DataFrame:
    return _pieces(spark, root, p2_split.oversized_pieces).where("piece_no = 2").select("src", "item_id").distinct()


@query
def p2_pieces(spark: SparkSession, root: str) -> DataFrame:
    return _pieces(spark, root, p2_split.split_oversized).select("src", "item_id", "piece_no", "n_pieces", "start_at", "words", "piece")


@query
def p2_cover(spark: SparkSession, root: str) -> DataFrame:
    """What the pieces of a text say of it: its words and their digest without the overlaps, and whether all pieces fit."""
    words = F.filter(F.split("piece", f"[{p2_split.SPACE}]+"), lambda w: w != "")
    own = p2_pieces(spark, root).withColumn("own", F.when(F.col("piece_no") == 1, words).otherwise(F.slice(words, 39, 1_000_000)))
    whole = own.groupBy("src", "item_id").agg(F.flatten(F.sort_array(F.collect_list(F.struct("piece_no", "own")))["own"]).alias("all"), F.max("words").alias("most"), F.max("n_pieces").alias("n_pieces"), F.count("*").alias("n"))
    return whole.select("src", "item_id", F.size("all").alias("words"), F.md5(F.array_join("all", " ")).alias("digest"), ((F.col("most") <= 375) & (F.col("n") == F.col("n_pieces"))).alias("fits"))


def _scans(spark: SparkSession, root: str, operator: Callable[..., DataFrame]) -> DataFrame:
    """Texts that may be scans: what is a list, a table or junk is left out. Words are counted once, and texts looked at once, for both."""
    chunks, answers = table(spark, root, "chunks"), table(spark, root, "orchestrator_responses")
    scans = [("chunks", chunks, "ingest_pos", "text"), ("orchestrator_responses", answers, "response_id", "extracted_text")]
    counts = p3_scans.word_counts(p3_scans.texts_of(scans))
    known = p3_scans.known_hashes(counts, "word", p5_quality.KNOWN_IN)
    seen = p3_scans.look(scans, counts, "chunks", known.value)
    told = seen.where("kind = 'text'").select("src", "item_id", *p5_quality.NAMES)
    odd = p5_quality.judge(told, kind_only=True).where("kind is not null").select("src", "item_id")
    return operator(scans, counts, seen).join(materialize(odd, "odd"), ["src", "item_id"], "left_anti")


@query
def p3_found(spark: SparkSession, root: str) -> DataFrame:
    return _scans(spark, root, p3_scans.find_noise).select("src", "item_id", "line_no", "kind").distinct()


@query
def p3_repaired(spark: SparkSession, root: str) -> DataFrame:
    return _scans(spark, root, p3_scans.repair)


@query
def p4_found(spark: SparkSession, root: str) -> DataFrame:
    return p4_near.all_pairs(table(spark, root, "chunks")).select(F.col("a").alias("pos_a"), F.col("b").alias("pos_b"))


@query
def p4_links(spark: SparkSession, root: str) -> DataFrame:
    return p4_near.links(table(spark, root, "chunks")).withColumnRenamed("pos", "ingest_pos")


@query
def p5_found(spark: SparkSession, root: str) -> DataFrame:
    return p5_quality.found(table(spark, root, "chunks"))


@query
def p5_statistics(spark: SparkSession, root: str) -> DataFrame:
    return p5_quality.judged(table(spark, root, "chunks"))


@query
def p5_counts(spark: SparkSession, root: str) -> DataFrame:
    """The statistics that SQL can check over all chunks."""
    told = p5_statistics(spark, root)
    return told.select("ingest_pos", "words", "bad_count", *(F.round(s, 9).alias(s) for s in ("common_share", "mean_word_length", "distinct_share")))


@query
def p6_found(spark: SparkSession, root: str) -> DataFrame:
    return p6_cap.over_cap(table(spark, root, "chunks"), table(spark, root, "chunk_scores")).select(F.col("id").alias("ingest_pos"))


@query
def p7_found(spark: SparkSession, root: str) -> DataFrame:
    return p7_copies.copy_groups(table(spark, root, "chunks")).select(F.col("keep").alias("keep_pos"), F.col("copy").alias("copy_pos"))


@query
def p7_copies_count(spark: SparkSession, root: str) -> DataFrame:
    found = p7_copies.copy_groups(table(spark, root, "chunks"))
    return found.groupBy(F.col("keep").alias("keep_pos")).agg((F.count("*") + 1).alias("n_copies"))


@query
def p7_records(spark: SparkSession, root: str) -> DataFrame:
    return p7_copies.records(table(spark, root, "chunks")).withColumnRenamed("keep", "keep_pos")


@query
def p7_members(spark: SparkSession, root: str) -> DataFrame:
    return p7_copies.members(table(spark, root, "chunks")).select(F.col("keep").alias("keep_pos"), F.col("pos").alias("ingest_pos"), "chunk_id")


@query
def p8_ids(spark: SparkSession, root: str) -> DataFrame:
    return p8_tokenize.encode_corpus(table(spark, root, "documents"))


@query
def p9_found(spark: SparkSession, root: str) -> DataFrame:
    return p9_leaks.find_leaks(table(spark, root, "documents"), table(spark, root, "eval_items")).select("doc_id", "item_id").distinct()


@query
def p10_found(spark: SparkSession, root: str) -> DataFrame:
    found = p10_personal.find_personal(table(spark, root, "documents"), table(spark, root, "name_register"))
    return found.select("doc_id", "kind", "start_at")


@query
def p10_redacted(spark: SparkSession, root: str) -> DataFrame:
    return p10_personal.redact(table(spark, root, "documents"), table(spark, root, "name_register"))


@query
def p10_restored(spark: SparkSession, root: str) -> DataFrame:
    """The redacted texts with what was found put back, as a digest: all else must be unchanged."""
    docs, names = table(spark, root, "documents"), table(spark, root, "name_register")
    found = p10_personal.find_personal(docs, names).groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("start_at", "length", "kind"))).alias("spans"))
    both = docs.select("doc_id", "text").join(p10_redacted(spark, root), "doc_id").join(found, "doc_id", "left")
    width = F.create_map(*(F.lit(x) for kind, mark in p10_personal.PLACEHOLDERS.items() for x in (kind, len(mark))))
    start = F.struct(F.lit("").alias("out"), F.lit(1).alias("here"), F.lit(1).alias("there"))

    def step(state: Column, span: Column) -> Column:
        gap = span["start_at"] - state["here"]
        out = F.concat(state["out"], F.substring("redacted", state["there"], gap), F.substring("text", span["start_at"], span["length"]))
        return F.struct(out.alias("out"), (span["start_at"] + span["length"]).alias("here"), (state["there"] + gap + width[span["kind"]]).alias("there"))

    end = F.aggregate(F.coalesce("spans", F.array().cast("array<struct<start_at:int,length:int,kind:string>>")), start, step)
    return both.select("doc_id", end.alias("end"), "redacted").select("doc_id", F.md5(F.concat("end.out", F.substring("redacted", F.col("end.there"), F.length("redacted")))).alias("digest"))
