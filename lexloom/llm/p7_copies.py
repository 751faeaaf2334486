"""Copies hidden by formatting: one integer tuple per record, grouped.

Every value (the whole text, or each field of a text of labelled fields) is canonicalised to its
terms without gaps and reduced to a digest; the distinct digests form a dictionary of integer ids;
a record becomes the sorted tuple of its ids, and equal tuples are copies.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize

_GAPS = r"[^\p{L}\p{M}\p{N}]+"
#: Line breaks, bars and semicolons separate labelled fields.
_FIELD_ENDS = r"[\n\r\x0B\f\x85  |;]+"
#: A label of at most five words, a colon, a value.
_FIELD = r"^\s*[\p{L}\p{M}\p{N}][\p{L}\p{M}\p{N}.'/-]*([ \t]+[\p{L}\p{M}\p{N}.'/&-]+){0,4}\s*:.*[\p{L}\p{M}\p{N}].*$"


def canonical(text: Column) -> Column:
    """Letters, marks and digits of the lower-cased text, joined without gaps."""
    return F.regexp_replace(F.lower(text), _GAPS, "")


def labelled_fields(text: Column) -> Column:
    """The fields of a text that consists of labelled fields only, else null."""
    parts = F.filter(F.split(text, _FIELD_ENDS), lambda p: F.length(F.regexp_replace(p, _GAPS, "")) > 0)
    told = F.when(F.instr(text, ":") > 0, parts)  # texts without a colon are not split
    return F.when((F.size(told) > 0) & F.forall(told, lambda p: p.rlike(_FIELD)), told)


def copy_groups(rows: DataFrame, id_col: str = "ingest_pos", text_col: str = "text", min_chars: int = 20) -> DataFrame:
    """(keep, copy): one row per further copy of a record, keep being the smallest id of its group.

    Null texts and texts of fewer than ``min_chars`` canonical characters are never copies. The id
    must be unique; other columns are not read. A text without labels counts as a copy of a
    labelled one if both give the same string in the same order. An empty table gives an empty one.
    """
    rows = rows.select(F.col(id_col).alias("pos"), F.col(text_col).alias("text"))
    whole = rows.select("pos", canonical(F.col("text")).alias("whole"), F.transform(labelled_fields(F.col("text")), canonical).alias("fields"))
    whole = whole.where(F.length("whole") >= min_chars)
    digest = lambda c: F.unhex(F.md5(c))
    one = F.array(F.struct(F.lit(False).alias("alias"), digest(F.col("whole")).alias("value")))
    many = F.concat(F.transform("fields", lambda f: F.struct(F.lit(False).alias("alias"), digest(f).alias("value"))), F.array(F.struct(F.lit(True).alias("alias"), digest(F.col("whole")).alias("value"))))
    values = materialize(whole.select("pos", F.inline(F.coalesce(many, one))), "values")
    dictionary = materialize(values.select("value").distinct().withColumn("code", F.monotonically_increasing_id()), "dictionary")
    codes = values.join(dictionary, "value").groupBy("pos").agg(
        F.sort_array(F.collect_list(F.when(~F.col("alias"), F.col("code")))).alias("tuple"), F.max(F.when(F.col("alias"), F.col("code"))).alias("whole_code")
    )
    codes = materialize(codes, "tuples")
    # the few labelled records tell which whole string stands for which tuple
    named = codes.where("whole_code is not null").groupBy(F.col("whole_code").alias("named_code")).agg(F.min("tuple").alias("same_as"))
    plain = codes.where("whole_code is null").join(named, F.col("tuple")[0] == F.col("named_code"), "left").select("pos", F.coalesce("same_as", "tuple").alias("tuple"))
    keyed = plain.unionByName(codes.where("whole_code is not null").select("pos", "tuple"))
    keyed = keyed.select("pos", F.when(F.size("tuple") == 1, F.col("tuple")[0].cast("string")).otherwise(F.md5(F.array_join(F.transform("tuple", lambda c: c.cast("string")), ","))).alias("key"))
    groups = keyed.groupBy("key").agg(F.min("pos").alias("keep"), F.count("*").alias("copies")).where("copies > 1").drop("copies")
    return keyed.join(groups, "key").where("pos > keep").select("keep", F.col("pos").alias("copy"))


def members(rows: DataFrame, id_col: str = "ingest_pos", text_col: str = "text", chunk_col: str = "chunk_id", min_chars: int = 20) -> DataFrame:
    """(keep, pos, chunk_id): for every row the record it belongs to, its own if it is no further copy.

    Null, empty and short texts are records of their own. A record's chunk_ids are rows, not an
    array, so that a hot group needs no large value; a chunk_id delivered again stands once for each row.
    """
    rows = rows.select(F.col(id_col).alias("pos"), F.col(text_col).alias("text"), F.col(chunk_col).alias("chunk_id"))
    found = copy_groups(rows, "pos", "text", min_chars).withColumnRenamed("copy", "pos")
    return rows.select("pos", "chunk_id").join(found, "pos", "left").select(F.coalesce("keep", "pos").alias("keep"), "pos", "chunk_id")


def records(rows: DataFrame, id_col: str = "ingest_pos", text_col: str = "text", min_chars: int = 20) -> DataFrame:
    """(keep, n_copies): every record once with the number of its rows, 1 for one without copies."""
    rows = rows.select(F.col(id_col).alias("pos"), F.col(text_col).alias("text"))
    found = materialize(copy_groups(rows, "pos", "text", min_chars), "copies")
    counts = found.groupBy("keep").agg((F.count("*") + 1).alias("n_copies"))
    kept = rows.select(F.col("pos").alias("keep")).join(found.select(F.col("copy").alias("keep")), "keep", "left_anti")
    return kept.join(counts, "keep", "left").select("keep", F.coalesce("n_copies", F.lit(1)).alias("n_copies"))
