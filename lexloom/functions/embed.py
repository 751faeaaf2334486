"""Embedders. The default needs no model: counts of hashed words, as unit vectors."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DIMENSIONS = 384


_TOKEN = re.compile(r"[^\W_]+")


class Buckets(dict):
    """The coordinate of each word: the first 32 bits of its MD5, modulo the dimensions. Forgets all words at ``limit``."""

    def __init__(self, dimensions: int = DIMENSIONS, limit: int = 1_000_000):
        super().__init__()
        self.dimensions, self.limit = dimensions, limit

    def __missing__(self, word: str) -> int:
        if len(self) >= self.limit:
            self.clear()
        self[word] = at = int.from_bytes(hashlib.md5(word.encode("utf-8", "surrogatepass")).digest()[:4]) % self.dimensions
        return at

    def counts(self, texts: list[str | None]) -> np.ndarray:
        """How often each coordinate occurs among the words (letters and digits) of each lower-cased text; a row for each text."""
        out = np.zeros((len(texts), self.dimensions), np.int64)
        for i, text in enumerate(texts):
            if text:
                out[i] = np.bincount(np.fromiter(map(self.__getitem__, _TOKEN.findall(text.lower())), np.int64), minlength=self.dimensions)
        return out


def unit_counts(buckets: Buckets, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(row numbers, unit vectors) of the texts that have words."""
    n = buckets.counts(column.to_pylist())
    norm = np.sqrt((n * n).sum(1).astype(np.float64))
    at = np.flatnonzero(norm)
    return at, n[at] / norm[at][:, None]


def bag_of_words(rows: DataFrame, key: str, text_col: str, dimensions: int = DIMENSIONS) -> DataFrame:
    """(key, bucket, weight): the non-zero coordinates of the unit vector of each row's words.

    One pass without a shuffle; null texts and texts without words have no coordinates.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        buckets = Buckets(dimensions)
        for batch in batches:
            for lo in range(0, batch.num_rows, 1024):
                part = batch.slice(lo, 1024)
                at, unit = unit_counts(buckets, part.column(1))
                i, j = np.nonzero(unit)
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(at[i])), pa.array(j, pa.int32()), pa.array(unit[i, j])], names=[key, "bucket", "weight"])

    kind = rows.schema[key].dataType.simpleString()
    return rows.select(key, text_col).mapInArrow(run, f"`{key}` {kind}, bucket int, weight double")


def model_embedder(load: Callable[[], Callable[[list[str]], list[list[float]]]], batch: int = 32):
    """A pandas UDF around a model; ``load`` is called once per task and returns the encoder."""

    @F.pandas_udf("array<float>")
    def embed(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode = load()
        for part in texts:
            yield pd.Series([v for lo in range(0, len(part), batch) for v in encode(part.iloc[lo : lo + batch].fillna("").tolist())])

    return embed
