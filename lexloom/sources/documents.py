"""Sources: page tables, files, JSON arrays and the normalisers of judgment collections."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import clean_text, falsy_coalesce, is_blank, ocr_lines
from ..operators.curate import running_index

CHUNK_SCHEMA = "chunk_id string, text string, source string, doc_type string, section string, word_count int, court string, source_config string"


def dataset(spark: SparkSession, path: str, config: str) -> DataFrame:
    """A published collection that was fetched into ``path/config/split``, as parquet or JSON lines.

    The split is ``train`` if there is one, else the first by name.
    """
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/{config}")
    system = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    splits = sorted(s.getPath().getName() for s in system.listStatus(where) if s.isDirectory())
    if not splits:
        raise FileNotFoundError(f"no split in {path}/{config}")
    split = f"{path}/{config}/{'train' if 'train' in splits else splits[0]}"
    held = [f.getPath().getName() for f in system.listStatus(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(split))]
    return spark.read.format("parquet" if any(n.endswith(".parquet") for n in held) else "json").load(split)


def json_array(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A file that holds one JSON array."""
    return spark.read.schema(schema).json(path, multiLine=True)


def write_json(rows: DataFrame, path: str) -> None:
    """JSON lines in many files, for tables of any size."""
    rows.write.mode("overwrite").json(path)


def write_json_array(rows: DataFrame, path: str) -> None:
    """A folder with one file that holds one JSON array, two spaces to a level, for readers that need that.

    Null fields are left out, other characters than ASCII kept, an existing folder is overwritten. The
    file is written by one task, a row at a time.
    """
    one = rows.select(F.to_json(F.struct("*"), {"pretty": "true"}).alias("value")).coalesce(1)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = "["
        for part in parts:
            for value in part["value"]:
                yield pd.DataFrame({"value": [held if held == "[" else held + ","]})
                held = "  " + value.replace("\n", "\n  ")
        yield pd.DataFrame({"value": [held, "]"]})

    one.mapInPandas(run, "value string").write.mode("overwrite").text(path)


def file_kind(path: Column) -> Column:
    """pdf, image or unsupported, by the ending of a file's name."""
    suffix = F.regexp_extract(F.lower(path), r"(\.[^./]+)$", 1)
    return F.when(suffix == ".pdf", "pdf").when(suffix.isin(".jpg", ".jpeg", ".png", ".tiff", ".bmp"), "image").otherwise("unsupported")


def files(spark: SparkSession, path: str) -> DataFrame:
    """Binary files with their kind: pdf, image or unsupported."""
    return spark.read.format("binaryFile").load(path).withColumn("file_type", file_kind(F.col("path")))


#: Pages of a file: its bytes and kind -> the texts of its pages. Raises if it can't be read.
Pages = Callable[[bytes, str], list[str]]


def ocr_extractor(rasterise: Callable[[bytes, int], list], read_image: Callable[[bytes], object], clean: Callable[[object], object], recognise: Callable[[object, str, str], str], dpi: int = 300, config: str = "--psm 6 --oem 3", lang: str = "eng") -> Callable[[], Pages]:
    """An extractor for :func:`extract` made of plug-ins, for image libraries that need not be here.

    ``rasterise`` turns a PDF into images of its pages, ``read_image`` decodes an image, ``clean``
    makes it grey, without noise, black and white and straight, ``recognise`` reads its text, which
    is stripped line by line. Pages without text stay empty, so that the others keep their numbers.
    """

    def load() -> Pages:
        def pages(content: bytes, kind: str) -> list[str]:
            if kind not in ("pdf", "image"):
                raise ValueError(f"unsupported file: {kind}")
            images = rasterise(content, dpi) if kind == "pdf" else [read_image(content)]
            read = (recognise(clean(i), lang, config) for i in images)
            return ["\n".join(x for line in t.splitlines() if (x := line.strip())) for t in read]

        return pages

    return load


def _read(rows: DataFrame, load: Callable[[], Pages]) -> DataFrame:
    """(path, file_type, pages, success) of binary files; no pages and no success if a file can't be read."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pages_of = load()
        for part in parts:
            for r in part.itertuples():  # a file may be large: one at a time
                try:
                    pages, success = pages_of(bytes(r.content), r.file_type), True
                except Exception:  # an unreadable file is no error of the job
                    pages, success = [], False
                yield pd.DataFrame([(r.path, r.file_type, pages, success)], columns=["path", "file_type", "pages", "success"])

    return rows.select("path", "content", "file_type").mapInPandas(run, "path string, file_type string, pages array<string>, success boolean")


def extract(rows: DataFrame, load: Callable[[], Pages]) -> DataFrame:
    """(path, page_num, text): pages of binary files by a pluggable extractor, loaded once per task.

    A file that cannot be read gives no page; blank pages are dropped but keep their number.
    """
    pages = _read(rows, load).select("path", F.posexplode("pages").alias("page_num", "text"))
    return pages.select("path", (F.col("page_num") + 1).alias("page_num"), "text").where(F.col("text").isNotNull() & ~is_blank(F.col("text")))


def extract_documents(rows: DataFrame, load: Callable[[], Pages]) -> DataFrame:
    """(path, file_type, text, success): a row for each file, PDF pages with their marks; success says whether it could be read and has text."""
    pages = F.transform("pages", lambda p, i: F.struct(ocr_lines(p).alias("t"), (i + 1).alias("n")))
    marked = F.transform(F.filter(pages, lambda p: F.length(p["t"]) > 0), lambda p: F.concat(F.lit("--- Page "), p["n"].cast("string"), F.lit(" ---\n"), p["t"]))
    text = F.when(F.col("file_type") == "pdf", F.array_join(marked, "\n\n")).otherwise(F.coalesce(F.get("pages", F.lit(0)), F.lit("")))
    return _read(rows, load).withColumn("text", text).select("path", "file_type", "text", (F.col("success") & ~is_blank(F.col("text"))).alias("success"))


def spread(rows: DataFrame) -> DataFrame:
    """The rows dealt to as many partitions as a shuffle has, for work that costs far more than moving them."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def statutes(pages: DataFrame, manifest: DataFrame) -> DataFrame:
    """(filename, source, doc_type, text): non-blank pages of known files, in order, cleaned as one text.

    Pages repeated under one number follow each other in the order of their texts; files without
    pages drop out.
    """
    rows = pages.where(~is_blank(F.col("text"))).join(manifest, "filename")
    whole = rows.groupBy("filename", "source", "doc_type").agg(F.sort_array(F.collect_list(F.struct("page_num", "text"))).alias("p"))
    return spread(whole).select("filename", "source", "doc_type", clean_text(F.array_join("p.text", "\n\n")).alias("text"))


def ocr_pages(pages: DataFrame, key: str, page: str, text: str) -> DataFrame:
    """(key, text): pages with their marks and stripped lines; empty pages are left out, numbers kept."""
    rows = pages.select(key, F.col(page).alias("_n"), ocr_lines(F.col(text)).alias("_t")).where(F.length("_t") > 0)
    rows = rows.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("_n", "_t"))).alias("p"))
    return rows.select(key, F.array_join(F.transform("p", lambda p: F.concat(F.lit("--- Page "), p["_n"].cast("string"), F.lit(" ---\n"), p["_t"])), "\n\n").alias("text"))


def judgments_summ(rows: DataFrame, order: str) -> DataFrame:
    """(doc_id, text, summary, court, doc_type, source_config) of the summarised collection.

    ``document`` (text or list of sentences) goes before ``text``; a missing id becomes the index
    among the kept rows.
    """
    document = F.array_join("document", " ") if dict(rows.dtypes)["document"].startswith("array") else F.col("document")
    kept = rows.withColumn("_t", falsy_coalesce(document, F.col("text"))).where(F.col("_t").isNotNull() & ~is_blank(F.col("_t")))
    kept = running_index(kept, order, "_i")
    return kept.select(F.coalesce(F.col("id").cast("string"), F.col("_i").cast("string")).alias("doc_id"), F.col("_t").alias("text"), "summary", F.lit("Supreme Court of India").alias("court"), F.lit("judgment").alias("doc_type"), F.lit("summ").alias("source_config"))


def judgments_bail(rows: DataFrame, order: str, first: int = 0) -> DataFrame:
    """As :func:`judgments_summ` for the bail collection: ``facts``, ``text``, ``document`` in this order; ids go on from ``first``."""
    kept = rows.withColumn("_t", falsy_coalesce(F.col("facts"), F.col("text"), F.col("document"))).where(F.col("_t").isNotNull() & ~is_blank(F.col("_t")))
    kept = running_index(kept, order, "_i")
    return kept.select(F.concat(F.lit("bail_"), (F.col("_i") + first).cast("string")).alias("doc_id"), F.col("_t").alias("text"), F.lit(None).cast("string").alias("summary"), F.lit("Supreme Court of India").alias("court"), F.lit("judgment").alias("doc_type"), F.lit("bail").alias("source_config"))


def judgments(summ: DataFrame, bail: DataFrame, order: str) -> DataFrame:
    """Both collections under one another; the ids of the second go on from the number of rows of the first."""
    first = judgments_summ(summ, order)
    return first.unionByName(judgments_bail(bail, order, first.count()))


def prechunked(rows: DataFrame, order: str) -> DataFrame:
    """(text, source, doc_type, chunk_id): non-blank rows under dense ids."""
    kept = rows.withColumn("_t", falsy_coalesce(F.col("text"), F.col("chunk"), F.lit(""))).where(~is_blank(F.col("_t")))
    kept = running_index(kept, order, "_i")
    return kept.select(F.col("_t").alias("text"), F.coalesce("source", F.lit("Supreme Court of India")).alias("source"), F.lit("judgment").alias("doc_type"), F.format_string("hf_sc_%05d", "_i").alias("chunk_id"))
