"""Queries for the operators of the core, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import embed, text
from ..operators import answer, chunk, curate, vector
from ..session import materialize, shared_dir, table
from ..sources import documents as sources
from ..streaming.ingest import ingest, stream_chunks
from . import build

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


# --- text functions


@query
def clean_text(spark, root):
    return table(spark, root, "documents").select("doc_id", text.clean_text(F.col("text")).alias("cleaned"))


@query
def clean_pages(spark, root):
    return table(spark, root, "statute_pages").select("filename", "page_num", text.clean_text(F.col("text")).alias("cleaned"))


@query
def section_header(spark, root):
    rows = table(spark, root, "chunks").where("text is not null")
    return rows.select("ingest_pos", text.section_header(F.col("text")).alias("from_text"), text.section_header(F.col("section")).alias("from_section"))


@query
def paragraphs(spark, root):
    rows = table(spark, root, "iltur_judgments").where("text is not null").select("doc_id", "text").distinct()
    return rows.select("doc_id", F.posexplode(text.paragraphs(F.col("text"))).alias("i", "paragraph")).select("doc_id", (F.col("i") + 1).alias("paragraph_no"), "paragraph")


@query
def sentences(spark, root):
    rows = table(spark, root, "documents").where("text is not null")
    return rows.select("doc_id", F.posexplode(text.sentences(F.col("text"))).alias("i", "sentence")).select("doc_id", (F.col("i") + 1).alias("sentence_no"), "sentence")


@query
def word_count(spark, root):
    return table(spark, root, "chunks").select("ingest_pos", text.word_count(F.col("text")).alias("words"))


@query
def chunk_keys(spark, root):
    c = F.col
    return table(spark, root, "chunks").select("ingest_pos", text.slug(c("source")).alias("slug"), text.content_hash(c("text")).alias("hash"), text.chunk_id(F.coalesce(c("source"), F.lit("")), c("ingest_pos"), F.coalesce(c("text"), F.lit(""))).alias("made_id"))


@query
def falsy_coalesce(spark, root):
    rows = table(spark, root, "iltur_judgments").distinct()
    label = F.concat(F.lit("SC Judgment — "), F.coalesce("source_config", F.lit("iltur")))
    return rows.select("doc_id", text.falsy_coalesce(F.col("summary"), F.col("text"), F.lit("")).alias("chosen"), label.alias("label"))


@query
def metadata_projection(spark, root):
    c = F.col
    return table(spark, root, "chunks").select("ingest_pos", text.metadata(c("source"), c("doc_type"), c("section"), c("court"), c("word_count")).alias("m")).select("ingest_pos", "m.*")


@query
def ocr_lines(spark, root):
    return table(spark, root, "orchestrator_responses").select("response_id", text.ocr_lines(F.col("extracted_text")).alias("lines"))


@query
def previews(spark, root):
    return table(spark, root, "chunks").select("ingest_pos", text.preview(F.col("text")).alias("preview"), F.coalesce(F.nullif("section", F.lit("")), F.lit("N/A")).alias("section_label"), F.upper("doc_type").alias("type_label"))


@query
def echo_trunc(spark, root):
    return table(spark, root, "documents").select("doc_id", text.echo(F.col("text")).alias("echo"))


# --- sources


def _statutes(spark, root):
    return sources.statutes(table(spark, root, "statute_pages"), table(spark, root, "statute_files"))


@query
def page_concat(spark, root):
    return _statutes(spark, root).select("filename", "source", "text")


@query
def manifest_lookup(spark, root):
    pages, files = table(spark, root, "statute_pages"), table(spark, root, "statute_files")
    return pages.join(files, "filename").groupBy("filename", "source", "doc_type").agg(F.count("*").alias("n_pages"))


@query
def ocr_pages(spark, root):
    return sources.ocr_pages(table(spark, root, "statute_pages"), "filename", "page_num", "text")


@query
def prechunked(spark, root):
    rows = table(spark, root, "chunks").select("ingest_pos", "text", F.lit(None).cast("string").alias("chunk"), "source")
    return sources.prechunked(rows, "ingest_pos")


# --- chunks


def _judgments(spark, root):
    label = build.judgment_source(F.col("source_config"))
    return sources.spread(table(spark, root, "iltur_judgments").distinct()).select("doc_id", text.clean_text(F.col("text")).alias("text"), label.alias("source"), "doc_type", "court", "source_config")


@query
def chunk_judgments(spark, root):
    return chunk.chunk_documents(_judgments(spark, root), "text", "source", "doc_type", ["doc_id", "court", "source_config"])


@query
def chunk_statutes(spark, root):
    return chunk.chunk_documents(_statutes(spark, root), "text", "source", "doc_type", ["filename"])


# --- choosing and combining


@query
def sample_docs(spark, root):
    return curate.sample(table(spark, root, "documents").select("doc_id", "source"), "doc_id", 300)


@query
def shuffle_take(spark, root):
    return curate.shuffle_take(table(spark, root, "chunks").select("ingest_pos", "text"), "ingest_pos", "text", 200)


@query
def cap_chunks(spark, root):
    made = chunk_judgments(spark, root).select("doc_id", "chunk_no", "chunk_id")
    return curate.cap_chunks(made, [curate.seeded_order("doc_id"), F.col("doc_id"), F.col("chunk_no")], 100)


@query
def union_sources(spark, root):
    a = chunk_statutes(spark, root).select("chunk_id", "source", "doc_type").withColumn("origin", F.lit("statutes"))
    b = chunk_judgments(spark, root).select("chunk_id", "source", "doc_type", "court").withColumn("origin", F.lit("judgments"))
    c = table(spark, root, "chunks").select("chunk_id", "source", "doc_type", "court").withColumn("origin", F.lit("prechunked"))
    return curate.union_sources(a, b, c)


@query
def count_by_type(spark, root):
    return curate.count_by_type(table(spark, root, "chunks"))


@query
def summary_rollup(spark, root):
    return curate.summary(union_sources(spark, root).select("origin"), "origin")


# --- the vector table


@query
def ingest_antijoin(spark, root):
    stored = table(spark, root, "vector_rows").select(F.col("id").alias("chunk_id"))
    return curate.new_rows(table(spark, root, "chunks").select("chunk_id", "ingest_pos"), stored, "chunk_id")


@query
def dedup_first(spark, root):
    return curate.keep_first(table(spark, root, "chunks").select("chunk_id", "ingest_pos", "source"), "chunk_id", "ingest_pos")


@query
def ingest_batches(spark, root):
    return curate.ingest_batches(table(spark, root, "chunks").select("ingest_pos", "chunk_id"), "ingest_pos")


def _dense(spark, root, k=10, where=None):
    rows = table(spark, root, "embeddings")
    queries = rows.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    return vector.dense_topk(queries, rows.where(where) if where is not None else rows, "query_id", "vec_id", k=k).select("query_id", "vec_id", "rank", "score")


@query
def vector_topk(spark, root):
    return _dense(spark, root)


@query
def vector_topk_filtered(spark, root):
    return _dense(spark, root, 5, F.col("label") == 3)


@query
def vector_topk_threshold(spark, root):
    return vector.threshold(_dense(spark, root), 0.6)


def _answers(spark, root):
    return table(spark, root, "orchestrator_responses").where("response_id % 20 = 0 and query_used is not null").select("response_id", "query_used")


def _hits(spark, root, k=5):
    """Searches of the stored queries in the chunks, by words."""
    return vector.text_topk(_answers(spark, root), table(spark, root, "chunks"), "response_id", "query_used", "ingest_pos", "text", k)


@query
def embed_bow(spark, root):
    rows = embed.bag_of_words(table(spark, root, "documents"), "doc_id", "text")
    return rows.select("doc_id", "bucket", F.round("weight", 6).alias("weight"))


@query
def text_search(spark, root):
    return vector.threshold(_hits(spark, root)).select("response_id", "ingest_pos", "rank", "score")


def _found(spark, root):
    chunks = table(spark, root, "chunks").select("ingest_pos", "source", "section", "doc_type", "text")
    return vector.threshold(_hits(spark, root)).join(chunks, "ingest_pos")


@query
def citations_distinct(spark, root):
    return answer.citations(_found(spark, root), "response_id").select("response_id", "source", "section", "doc_type", "score")


@query
def prompt_build(spark, root):
    return answer.build_prompts(_answers(spark, root), _found(spark, root), "response_id", "query_used")


def _search(spark, root, query, question, k=5):
    """A search in the chunks for the flows: thresholded hits with what a response shows of them."""
    chunks = table(spark, root, "chunks")

    def search(asked):
        hits = vector.threshold(vector.text_topk(asked, chunks, query, question, "ingest_pos", "text", k))
        return materialize(hits.join(chunks.select("ingest_pos", "source", "section", "doc_type", "text"), "ingest_pos"), "hits")

    return search


def _cited(column="citations"):
    """An array of citations as one string, so that any engine can compare it."""
    part = lambda c, f: F.coalesce(c[f], F.lit(""))
    return F.array_join(F.transform(column, lambda c: F.concat_ws(" | ", part(c, "source"), part(c, "section"), part(c, "doc_type"), c["score"].cast("string"))), "; ").alias("citations")


@query
def rag_response(spark, root):
    asked = _answers(spark, root)
    made = answer.responses(asked, _search(spark, root, "response_id", "query_used")(asked), "response_id", "query_used")
    return made.select("response_id", "n_hits", F.size("citations").cast("long").alias("n_citations"), "best_score", "context_used", "warning")


@query
def rag_answer(spark, root):
    """The legal query: question, answer, citations, warning; 400 for blank and for too long questions."""
    made = answer.answer_questions(_answers(spark, root), _search(spark, root, "response_id", "query_used"), "response_id", "query_used")
    return made.select("response_id", "status", F.col("query_used").alias("query"), "answer", _cited(), "context_used", "warning")


@query
def text_flow(spark, root):
    made = answer.answer_questions(_answers(spark, root), _search(spark, root, "response_id", "query_used"), "response_id", "query_used", None)
    return made.select("response_id", "flow", "status", "query_used", "answer", _cited(), "context_used", "warning")


def _uploads(spark, root):
    rows = table(spark, root, "orchestrator_responses").where("response_id % 20 = 0")
    mime = F.when(F.col("response_id") % 60 == 0, "image/png").when(F.col("flow") == "document_upload", "application/pdf").otherwise("text/plain")
    return rows.select("response_id", mime.alias("mime"), F.coalesce(F.length("answer"), F.lit(0)).alias("bytes"), "extracted_text", "query_used", F.concat(F.lit("upload_"), F.col("response_id").cast("string")).alias("filename"))


@query
def document_flow(spark, root):
    made = answer.answer_documents(_uploads(spark, root), _search(spark, root, "response_id", "query_used"), "response_id", "mime", "bytes", "extracted_text", "query_used")
    return made.select("response_id", "flow", "status", "query_used", "answer", _cited(), "context_used", "warning", "extracted_text")


@query
def document_analyze(spark, root):
    return answer.analyze_documents(_uploads(spark, root), "response_id", "filename", "mime", "bytes", "extracted_text")


@query
def citation_lists(spark, root):
    return answer.citation_lists(_found(spark, root), "response_id").select("response_id", _cited())


@query
def pretty_print(spark, root):
    asked = _answers(spark, root)
    made = asked.join(answer.responses(asked, _search(spark, root, "response_id", "query_used")(asked), "response_id", "query_used"), "response_id")
    return made.select("response_id", answer.rendered(F.col("query_used"), F.col("answer"), F.col("citations"), F.col("warning")).alias("shown"))


@query
def citations_stored(spark, root):
    """The stored citations made distinct by source and section, the first kept."""
    rows = table(spark, root, "orchestrator_responses").select("response_id", F.posexplode("citations").alias("rank", "c")).select("response_id", "rank", "c.*")
    return answer.citations(rows, "response_id").select("response_id", "source", "section", "doc_type", "score")


@query
def doc_query_template(spark, root):
    rows = table(spark, root, "orchestrator_responses").where("extracted_text is not null")
    made = answer.document_query(F.col("extracted_text"), F.col("query_used"))
    return rows.select("response_id", made.alias("query"), answer.query_label(F.col("query_used")).alias("label"))


@query
def validate_request(spark, root):
    return table(spark, root, "documents").select("doc_id", answer.validate_query(F.col("text")).alias("limited"), answer.validate_query(F.col("text"), None).alias("unlimited"))


@query
def validate_upload(spark, root):
    mime = F.when(F.col("doc_kind") == "notice", "application/pdf").when(F.col("doc_kind") == "order", "image/png").otherwise("text/plain")
    return table(spark, root, "documents").select("doc_id", answer.validate_upload(mime, F.length("text"), F.col("lang") != "und").alias("status"))


@query
def health_rollup(spark, root):
    rows = table(spark, root, "orchestrator_responses").select(F.when(F.col("warning").isNull(), "ok").otherwise("error").alias("status"))
    return answer.health(rows)


@query
def health_services(spark, root):
    """The status of the vector table, the embedder and the generator, and of all of them."""
    stored = table(spark, root, "vector_rows").agg(F.lit("store").alias("service"), F.concat(F.lit("ok — "), F.count("*").cast("string"), F.lit(" chunks indexed")).alias("status"))
    others = spark.createDataFrame([("embedder", f"ok — bag of words, {embed.DIMENSIONS}"), ("generator", "ok — extractive")], "service string, status string")
    return answer.health_report(stored.unionByName(others), ["store", "embedder", "generator"])


# --- the sources once more, and the offline build


def _raw_summ(spark, root):
    rows = table(spark, root, "iltur_judgments").where("source_config = 'summ'").distinct()
    return rows.select(F.col("doc_id").alias("order"), F.when(F.col("court").isNotNull(), F.col("doc_id")).alias("id"), F.col("text").alias("document"), F.col("summary").alias("text"), "summary")


def _raw_bail(spark, root):
    rows = table(spark, root, "iltur_judgments").where("source_config = 'bail'").distinct()
    return rows.select(F.col("doc_id").alias("order"), F.lit(None).cast("string").alias("facts"), "text", F.col("court").alias("document"))


@query
def judgments_summ(spark, root):
    return sources.judgments_summ(_raw_summ(spark, root), "order")


@query
def judgments_bail(spark, root):
    return sources.judgments_bail(_raw_bail(spark, root), "order")


@query
def judgments_union(spark, root):
    return sources.judgments(_raw_summ(spark, root), _raw_bail(spark, root), "order")


@query
def files_by_kind(spark, root):
    """The names of the statute files, as they are and under other endings, with their kind."""
    endings = F.explode(F.array(F.lit(""), F.lit(".PNG"), F.lit(".tif"), F.lit(".tiff")))
    return table(spark, root, "statute_files").select("filename", endings.alias("ending")).select(F.concat("filename", "ending").alias("name")).select("name", sources.file_kind(F.col("name")).alias("file_type"))


def _fresh(spark, name):
    import uuid

    return f"{shared_dir(spark)}/lexloom/{name}-{uuid.uuid4().hex[:12]}"


@query
def json_array_round_trip(spark, root):
    """The statute files written as one JSON array and read again."""
    path = _fresh(spark, "json")
    sources.write_json_array(table(spark, root, "statute_files"), path)
    return sources.json_array(spark, path, "filename string, source string, doc_type string")


@query
def dataset_split(spark, root):
    """The statute files as the split ``train`` of a fetched collection that has another split."""
    path, rows = _fresh(spark, "fetched"), table(spark, root, "statute_files")
    rows.where("doc_type is null").write.parquet(f"{path}/laws/dev")
    rows.write.json(f"{path}/laws/train")
    return sources.dataset(spark, path, "laws").select("filename", "source", "doc_type")


@query
def vector_append(spark, root):
    """Every third chunk appended to a new vector table, then all: each key once, the earlier table first."""
    rows, path = table(spark, root, "chunks").select("chunk_id", "ingest_pos"), _fresh(spark, "vectors")
    vector.create(spark, path, "chunk_id string, ingest_pos long")
    vector.append(rows.where("ingest_pos % 3 = 0"), path, "chunk_id", "ingest_pos")
    vector.append(rows, path, "chunk_id", "ingest_pos")
    return spark.read.parquet(path)


@query
def vector_truncate(spark, root):
    """The number of rows of a vector table before and after it is emptied."""
    path = _fresh(spark, "vectors")
    vector.append(table(spark, root, "chunks").select("chunk_id", "ingest_pos"), path, "chunk_id", "ingest_pos")
    before = spark.read.parquet(path).count()
    vector.truncate(spark, path)
    return spark.read.parquet(path).agg(F.lit(before).cast("long").alias("n_before"), F.count("*").alias("n_after"))


@query
def stream_ingest(spark, root):
    """The chunks streamed into a new vector table, each key once."""
    path, checkpoint, source = _fresh(spark, "vectors"), _fresh(spark, "stream"), table(spark, root, "chunks")
    ingest(stream_chunks(spark, f"{root}/chunks.parquet*", source.schema), path, checkpoint, order="ingest_pos").awaitTermination()
    return spark.read.parquet(path).select("chunk_id", "ingest_pos")


@query
def ingest_progress(spark, root):
    return curate.progress(ingest_batches(spark, root), seconds=1.5)


@query
def random_peek(spark, root):
    """Three chunks in the seeded order, as a console shows them."""
    rows = curate.sample(table(spark, root, "chunks").where("text is not null").select("ingest_pos", "source", "section", "text"), "ingest_pos", 3, seed=7)
    return rows.select("ingest_pos", F.left("source", F.lit(55)).alias("source"), F.coalesce(F.nullif(F.left("section", F.lit(60)), F.lit("")), F.lit("—")).alias("section"), text.preview(F.col("text"), 180).alias("preview"))


@query
def build_corpus(spark, root):
    """The whole offline build: chunks of statutes, judgments and ready-made chunks; the caps are its feature."""
    made = build.build_corpus(table(spark, root, "statute_pages"), table(spark, root, "statute_files"), table(spark, root, "iltur_judgments"), table(spark, root, "chunks").select("ingest_pos", "chunk_id", "text", "source"))
    return made.select("chunk_id", "source", "doc_type", "section", "word_count", "court", "origin")
