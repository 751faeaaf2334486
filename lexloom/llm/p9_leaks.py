"""Evaluation texts inside training text: a BM25 index of the items, searched by block-max WAND.

The index terms are runs of three consecutive terms. Every passage of the corpus is a query; an
item is retrieved if its score reaches the item's own threshold, the least score that a verbatim
run of the required length can have, so no such run is lost. Retrieved pairs are verified term by
term.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..session import materialize
from .tables import bits_for, presence
from .terms import TermHashes, shingle_hashes, terms

GRAM = 3
K1, B = 1.2, 0.75
#: Postings in a block of the index, for which the largest contribution is kept.
BLOCK = 16
#: Items in one index; more items are searched block by block, each in a pass of its own.
MAX_ITEMS = 5_000


class Index:
    def __init__(self, items: list[tuple[int, str]], run: int):
        self.run, hashes = run, TermHashes()
        self.words = {i: terms(t) for i, t in items}
        kept = {i: w for i, w in self.words.items() if len(w) >= run}
        self.ids = sorted(kept)
        grams = [shingle_hashes(hashes(kept[i]), GRAM).tolist() for i in self.ids]
        self.full = [frozenset(shingle_hashes(hashes(kept[i]), run).tolist()) for i in self.ids]
        self.size = [max(1, len(f)) for f in self.full]
        df = Counter(g for gs in grams for g in set(gs))
        mean = sum(map(len, grams)) / max(1, len(grams))
        postings: dict[int, list[tuple[int, float]]] = {}
        self.least: list[float] = []
        for n, gs in enumerate(grams):
            tf, norm = Counter(gs), K1 * (1 - B + B * len(gs) / mean)
            part = {g: float(np.log(1 + (len(grams) - df[g] + 0.5) / (df[g] + 0.5))) * c * (K1 + 1) / (c + norm) for g, c in tf.items()}
            for g, s in part.items():
                postings.setdefault(g, []).append((n, s))
            width = run - GRAM + 1
            self.least.append(min((sum(part[g] for g in set(gs[i : i + width])) for i in range(len(gs) - width + 1)), default=float("inf")) - 1e-9)
        self.floor = min(self.least, default=float("inf"))
        self.keys = np.array(sorted(postings), np.uint64)
        self.postings = [postings[int(k)] for k in self.keys]
        self.most = np.array([max(s for _, s in p) for p in self.postings])
        self.blocks = [[(p[min(j + BLOCK, len(p)) - 1][0], max(s for _, s in p[j : j + BLOCK])) for j in range(0, len(p), BLOCK)] for p in self.postings]

    def search(self, lists: list[int]) -> list[int]:
        """Block-max WAND: all items whose score over these postings reaches their threshold."""
        at, end, found = dict.fromkeys(lists, 0), len(self.ids), []
        while True:
            live = sorted((self.postings[k][at[k]][0], k) for k in at if at[k] < len(self.postings[k]))
            bound, pivot = 0.0, -1
            for j, (_, k) in enumerate(live):
                bound += self.most[k]
                if bound >= self.floor:
                    pivot = j
                    break
            if pivot < 0:
                return found
            item = live[pivot][0]
            while pivot + 1 < len(live) and live[pivot + 1][0] == item:
                pivot += 1
            shallow, next_end = 0.0, end
            for _, k in live[: pivot + 1]:
                last, top = next(((e, s) for e, s in self.blocks[k][at[k] // BLOCK :] if e >= item), (end, 0.0))
                shallow, next_end = shallow + top, min(next_end, last)
            if shallow < self.floor:  # no item up to the first block end can reach it
                goal = next_end + 1
                if pivot + 1 < len(live):
                    goal = min(goal, live[pivot + 1][0])
                goal = max(goal, item + 1)
            else:
                goal = item
                if live[0][0] == item:
                    score = sum(self.postings[k][at[k]][1] for n, k in live[: pivot + 1])
                    if score >= self.least[item]:
                        found.append(item)
                    goal = item + 1
            for _, k in live[: pivot + 1]:
                p, i = self.postings[k], at[k]
                while i < len(p) and p[i][0] < goal:
                    i += 1
                at[k] = i

    def leaks(self, words: list[str], hashes: np.ndarray) -> Iterator[tuple[int, int, float]]:
        """(item id, runs found, share of the item's runs) for one document."""
        if len(words) < self.run or not len(self.keys):
            return
        grams = shingle_hashes(hashes, GRAM)
        place = np.minimum(np.searchsorted(self.keys, grams), len(self.keys) - 1)
        hit = self.keys[place] == grams
        width = self.run - GRAM + 1
        if np.count_nonzero(hit) < width:
            return
        # a passage is a stretch of indexed grams, each window of one run reaching the lowest threshold
        bound = np.concatenate([[0.0], np.cumsum(np.where(hit, self.most[place], 0.0))])
        hits = np.concatenate([[0], np.cumsum(hit)])
        windows = np.flatnonzero((hits[width:] - hits[:-width] == width) & (bound[width:] - bound[:-width] >= self.floor - 1e-6))
        if not len(windows):
            return
        candidates: set[int] = set()
        for stretch in np.split(windows, np.flatnonzero(np.diff(windows) > 1) + 1):
            part = slice(stretch[0], stretch[-1] + width)
            candidates.update(self.search(sorted(set(place[part][hit[part]].tolist()))))
        if candidates:
            runs = shingle_hashes(hashes, self.run).tolist()
            for n in sorted(candidates):
                same = {r for r in runs if r in self.full[n]}
                if same and self._verbatim(words, runs, same, n):
                    yield self.ids[n], len(same), len(same) / self.size[n]

    def _verbatim(self, words: list[str], runs: list[int], same: set[int], n: int) -> bool:
        item = " ".join(["", *self.words[self.ids[n]], ""])
        return any(r in same and " ".join(["", *words[i : i + self.run], ""]) in item for i, r in enumerate(runs))


def _may_leak(source: DataFrame, items: DataFrame, run: int) -> DataFrame:
    """The rows (id, text) that have a run of grams, each of which some item has, but for chance."""
    bits = bits_for(4 * items.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0], 27)
    width = run - GRAM + 1

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = TermHashes()
        for batch in batches:
            own = [(shingle_hashes(hashes(terms(t)), GRAM) >> np.uint64(32)).astype(np.uint32).tobytes() for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(own, pa.binary())], names=["grams"])

    shared = source.sparkSession.sparkContext.broadcast(presence(items.select("text").mapInArrow(grams, "grams binary"), bits))

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, table, mask = TermHashes(), shared.value, np.int64((1 << bits) - 1)
        for batch in batches:
            good = []
            for text in batch.column(1).to_pylist():
                slot = (shingle_hashes(hashes(terms(text)), GRAM) >> np.uint64(32)).astype(np.int64) & mask
                hits = np.concatenate([[0], np.cumsum(table[slot >> 3] >> (7 - (slot & 7)) & 1)])
                good.append(bool((hits[width:] - hits[:-width] == width).any()))
            yield batch.filter(pa.array(good, pa.bool_()))

    return source.mapInArrow(keep, source.schema)


def find_leaks(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", item_id: str = "item_id", text_col: str = "text", run: int = 13, max_items: int = MAX_ITEMS) -> DataFrame:
    """(doc_id, item_id, runs INT, share DOUBLE): the document has ``run`` consecutive terms of the item.

    Null and short texts on either side match nothing. Items of equal text are all reported; rows
    are distinct if ids are. The items are indexed in blocks of ``max_items``, so what is sent to
    the executors is bounded. If there are several blocks, one pass first drops the documents without
    a run of grams that items have, by a table of bounded size, and the blocks are searched in the
    rest. Other columns are not read.
    """
    spark = docs.sparkSession
    items = items.select(F.col(item_id).alias("item"), F.col(text_col).alias("text")).where("item is not null and text is not null").dropDuplicates(["item"])
    count = items.count()
    blocks = max(1, -(-count // max_items))
    kinds = (docs.schema[doc_id].dataType.simpleString(), items.schema["item"].dataType.simpleString())
    schema = f"`{doc_id}` {kinds[0]}, `{item_id}` {kinds[1]}, runs int, share double"
    arrow = to_arrow_schema(StructType.fromDDL(schema))
    source = docs.select(doc_id, text_col).where(F.col(text_col).isNotNull())
    if blocks > 1:
        source = materialize(_may_leak(source, items, run), "may_leak")
    found = []
    for block in range(blocks):
        mine = items if blocks == 1 else items.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == block)
        index = spark.sparkContext.broadcast(Index([(r.item, r.text) for r in mine.collect()], run))

        def scan(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            hashes = TermHashes()
            own = index.value
            for batch in batches:
                out: list[tuple] = []
                for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    words = terms(text)
                    out += [(doc, *leak) for leak in own.leaks(words, hashes(words))]
                cols = list(zip(*out)) or [()] * 4
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, arrow)], schema=arrow)

        found.append(source.mapInArrow(scan, schema))
    return reduce(DataFrame.unionByName, found)
