"""From hits to responses: citations, prompts, answers, the flows for questions and documents, validation."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.generate import NOTICE, generator
from ..functions.text import echo, strip

WARNING = "No relevant passage was found."
CITATIONS = "array<struct<source:string,section:string,doc_type:string,score:double>>"


@dataclass(frozen=True)
class Template:
    """The words of a prompt; the passages, the question and the duties come in this order."""

    passages: str = "WHAT THE KNOWLEDGE BASE HOLDS"
    question: str = "WHAT THE READER ASKS"
    duties_head: str = "HOW TO ANSWER"
    duties: tuple[str, ...] = (
        "Begin with the answer in one or two sentences anyone can follow, then explain it.",
        "Put the statute or judgment behind each statement of law in brackets after it; use nothing but the passages.",
        "If they leave the question open, name what is missing.",
        f"Finish with: {NOTICE}",
    )
    cue: str = "Answer:"
    no_passages: str = "There is no passage on this question. Tell the reader so, and that a lawyer can help."
    document: str = "A reader sent in this document:"
    about_document: str = "Their question about it:"
    no_question: str = "They ask what it says: its main terms, what each side may and must do, and any term that looks unfair or void."
    document_label: str = "Document analysis"

    def full(self, context: Column, question: Column) -> Column:
        duties = "".join(f"\n- {d}" for d in self.duties)
        return F.concat(F.lit(f"## {self.passages}\n\n"), context, F.lit(f"\n\n## {self.question}\n\n"), question, F.lit(f"\n\n## {self.duties_head}\n{duties}\n\n{self.cue}"))

    def empty(self, question: Column) -> Column:
        return F.concat(F.lit(f"## {self.question}\n\n"), question, F.lit(f"\n\n{self.no_passages}"))


TEMPLATE = Template()


def citations(hits: DataFrame, query: str) -> DataFrame:
    """One citation per query, source and section: the best-ranked hit."""
    place = F.row_number().over(Window.partitionBy(query, "source", "section").orderBy("rank"))
    return hits.withColumn("_place", place).where("_place = 1").drop("_place")


def citation_lists(hits: DataFrame, query: str) -> DataFrame:
    """(query, citations): the citations of a response as an array, best first."""
    one = F.struct("rank", "source", "section", "doc_type", "score")
    return citations(hits, query).groupBy(query).agg(F.transform(F.sort_array(F.collect_list(one)), lambda c: F.struct(c["source"], c["section"], c["doc_type"], c["score"])).cast(CITATIONS).alias("citations"))


def context_block(rank: Column, source: Column, doc_type: Column, section: Column, text: Column) -> Column:
    """The passage as the prompt shows it."""
    head = F.concat(F.lit("--- Passage "), rank.cast("string"), F.lit(" ---\nSource: "), F.coalesce(source, F.lit("Unknown Source")), F.lit(" | Type: "), F.coalesce(doc_type, F.lit("")))
    named = F.when(F.coalesce(section, F.lit("")) != "", F.concat(F.lit(" | Section: "), section)).otherwise("")
    return F.concat(head, named, F.lit("\n"), F.coalesce(text, F.lit("")))


def build_prompts(queries: DataFrame, hits: DataFrame, query: str, question: str, template: Template = TEMPLATE) -> DataFrame:
    """(query, prompt, n_hits): ordered passages, the question and the duties; without hits a notice."""
    block = F.struct("rank", context_block(F.col("rank"), F.col("source"), F.col("doc_type"), F.col("section"), F.col("text")).alias("block"))
    blocks = hits.groupBy(query).agg(F.array_join(F.sort_array(F.collect_list(block))["block"], "\n\n").alias("_context"), F.count("*").alias("n_hits"))
    prompt = F.when(F.col("_context").isNotNull(), template.full(F.col("_context"), F.col(question))).otherwise(template.empty(F.col(question)))
    return queries.join(blocks, query, "left").select(query, prompt.alias("prompt"), F.coalesce("n_hits", F.lit(0)).alias("n_hits"))


def responses(queries: DataFrame, hits: DataFrame, query: str, question: str, answer: Callable[[Column], Column] | None = None, template: Template = TEMPLATE) -> DataFrame:
    """(query, answer, citations, n_hits, best_score, context_used, warning): one row per query.

    ``hits`` are the thresholded hits (query, rank, source, section, doc_type, text, score);
    ``answer`` is a :func:`~lexloom.functions.generate.generator`. A query without hits is answered
    from an empty context and has a warning.
    """
    answer = answer or generator()
    prompts = build_prompts(queries, hits, query, question, template)
    best = hits.groupBy(query).agg(F.max("score").alias("best_score"))
    out = prompts.join(citation_lists(hits, query), query, "left").join(best, query, "left")
    used = F.col("n_hits") > 0
    cited = F.coalesce("citations", F.array().cast(CITATIONS))
    return out.select(query, answer(F.col("prompt")).alias("answer"), cited.alias("citations"), "n_hits", "best_score", used.alias("context_used"), F.when(~used, F.lit(WARNING)).alias("warning"))


Search = Callable[[DataFrame], DataFrame]


def answer_questions(queries: DataFrame, search: Search, query: str, question: str, max_chars: int | None = 1000, answer=None, template: Template = TEMPLATE) -> DataFrame:
    """The flow for questions: (query, flow, status, query_used, answer, citations, context_used, warning).

    ``search`` maps (query, question) to thresholded hits. A blank or too long question has status
    400 and no answer; without ``max_chars`` any length will do.
    """
    told = queries.select(query, F.col(question).alias("query_used"), validate_query(F.col(question), max_chars).alias("status"))
    good = told.where("status = 200").select(query, "query_used")
    made = responses(good, search(good), query, "query_used", answer, template).drop("n_hits", "best_score")
    return told.join(made, query, "left").select(query, F.lit("text_query").alias("flow"), "status", "query_used", "answer", "citations", "context_used", "warning")


def answer_documents(uploads: DataFrame, search: Search, query: str, mime: str, size: str, text: str, question: str, answer=None, template: Template = TEMPLATE) -> DataFrame:
    """The flow for documents: as :func:`answer_questions` with ``extracted_text``, the text as far as a response shows it.

    ``text`` is what was extracted, null if the file could not be read. 415 for a type that is not
    allowed, 400 for an empty file, 422 for a file without text.
    """
    status = validate_upload(F.col(mime), F.col(size), strip(F.coalesce(text, F.lit(""))) != "")
    told = uploads.select(query, status.alias("status"), F.col(text).alias("_text"), F.col(question).alias("_question"))
    good = told.where("status = 200").select(query, document_query(F.col("_text"), F.col("_question"), template=template).alias("_asked"))
    made = responses(good, search(good.select(query, F.col("_asked").alias("query_used"))), query, "_asked", answer, template).drop("n_hits", "best_score")
    ok = F.col("status") == 200
    out = told.join(made, query, "left")
    return out.select(
        query, F.lit("document_upload").alias("flow"), "status", F.when(ok, query_label(F.col("_question"), template)).alias("query_used"), "answer", "citations", "context_used", "warning",
        F.when(ok, echo(F.col("_text"))).alias("extracted_text"),
    )


def document_query(text: Column, question: Column, cap: int = 3000, template: Template = TEMPLATE) -> Column:
    """The query made of an uploaded document and an optional question."""
    head = F.concat(F.lit(f"{template.document}\n\n"), F.left(text, F.lit(cap)), F.lit("\n\n"))
    asked = strip(F.coalesce(question, F.lit(""))) != ""
    return F.concat(head, F.when(asked, F.concat(F.lit(f"{template.about_document} "), question)).otherwise(template.no_question))


def query_label(question: Column, template: Template = TEMPLATE) -> Column:
    return F.coalesce(F.nullif(strip(question), F.lit("")), F.lit(template.document_label))


def analyze_documents(uploads: DataFrame, key: str, filename: str, mime: str, size: str, text: str) -> DataFrame:
    """(key, status, filename, file_type, character_count, extracted_text, success) of uploaded files.

    A file that cannot be read (null ``text``) has status 422; a readable one without text has 200
    and no success. All but key, status and filename are null where the status is not 200.
    """
    status = validate_upload(F.col(mime), F.col(size), F.col(text).isNotNull())
    told = uploads.withColumn("status", status)
    good = lambda c: F.when(F.col("status") == 200, c)
    kind = F.when(F.col(mime) == "application/pdf", "pdf").otherwise("image")
    return told.select(
        key, "status", F.col(filename).alias("filename"), good(kind).alias("file_type"), good(F.length(text)).alias("character_count"), good(F.col(text)).alias("extracted_text"), good(strip(F.col(text)) != "").alias("success")
    )


def rendered(query: Column, answer: Column, cited: Column, warning: Column) -> Column:
    """A response as plain text for a console; ``cited`` is an array of citations."""
    one = lambda c, i: F.concat(
        F.lit("\n  "), (i + 1).cast("string"), F.lit(". "), F.upper(F.coalesce(c["doc_type"], F.lit(""))), F.lit(" "), F.coalesce(c["source"], F.lit("Unknown Source")),
        F.when(F.coalesce(c["section"], F.lit("")) != "", F.concat(F.lit(", "), F.left(c["section"], F.lit(55)))).otherwise(""), F.lit(" ("), c["score"].cast("string"), F.lit(")"),
    )
    sources = F.when(F.size(cited) > 0, F.concat(F.lit("\n\nSources:"), F.array_join(F.transform(cited, one), ""))).otherwise("")
    return F.concat(F.lit("Question: "), query, F.lit("\n\n"), answer, sources, F.coalesce(F.concat(F.lit("\n\nWarning: "), warning), F.lit("")))


def validate_query(text: Column, max_chars: int | None = 1000) -> Column:
    """The HTTP status of a query: 400 if it is null, blank or too long (before stripping), else 200."""
    bad = text.isNull() | (strip(text) == "")
    if max_chars is not None:
        bad = bad | (F.length(text) > max_chars)
    return F.when(bad, 400).otherwise(200)


def validate_upload(mime: Column, size: Column, decodes: Column) -> Column:
    """415 for a type that is not allowed, 400 if empty, 422 if it cannot be decoded, else 200."""
    allowed = mime.isin("application/pdf", "image/jpeg", "image/png", "image/jpg", "image/tiff", "image/bmp")
    return F.when(~F.coalesce(allowed, F.lit(False)), 415).when(F.coalesce(size, F.lit(0)) == 0, 400).when(~F.coalesce(decodes, F.lit(False)), 422).otherwise(200)


def health(statuses: DataFrame, status: str = "status") -> DataFrame:
    """(overall): healthy if every status contains "ok"."""
    return statuses.agg(F.when(F.bool_and(F.coalesce(F.contains(status, F.lit("ok")), F.lit(False))), "healthy").otherwise("degraded").alias("overall"))


def health_report(statuses: DataFrame, services: list[str], service: str = "service", status: str = "status") -> DataFrame:
    """One row: the status of each service, ``unknown`` if none is given, and ``overall``, healthy if each contains "ok"."""
    told = [F.coalesce(F.max(F.when(F.col(service) == s, F.col(status))), F.lit("unknown")).alias(s) for s in services]
    fine = F.forall(F.array(*map(F.col, services)), lambda s: F.contains(s, F.lit("ok")))
    return statuses.agg(*told).withColumn("overall", F.when(fine, "healthy").otherwise("degraded"))
