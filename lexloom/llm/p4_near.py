"""Near-duplicates with small edits: signature trees over prefix-filtered token lists.

Texts of the same terms are collapsed first. Each remaining text becomes a set of 3-term shingles
and a bitmap of them. The similarity of two texts is the number of shingles in both over the number
in either; to reach 0.7 they must share one of the rarest 0.3 n + 1 shingles of each (any common
order of rarity will do), so texts are routed by those. Among the texts that meet, trees of nodes
with OR- and AND-combined bitmaps and size ranges are traversed in pairs, and a pair of nodes is
left as soon as its greatest possible overlap is too small. What is left is verified on the full
sets.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .tables import UPPER, bits_for, count_codes, presence
from .terms import TermHashes, distinct, shingle_hashes, terms

WORDS = 6  # 64-bit words in a bitmap
#: A shingle in more texts than this is split into pairs of blocks of at most this many texts.
HOT = 4096
#: Texts for each routing task.
TEXTS_PER_TASK = 25_000
LEAF, FAN = 16, 8
#: Pairs of texts that are tested at a time.
PAIRS = 200_000
#: Lists up to this length are compared directly.
SHORT = 64
#: Lists up to this length make so few pairs that they are only tested once, all together.
FEW = 16
#: What rounding may take from a bound; candidates are verified exactly.
SLACK = 0.5
#: Members of a class of copies in one block when its pairs are written out.
MEMBERS = 1024


def bitmaps(sets: list[np.ndarray]) -> np.ndarray:
    out = np.zeros((len(sets), 64 * WORDS), np.uint8)
    for i, s in enumerate(sets):
        out[i, (s.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(32)) % np.uint64(64 * WORDS)] = 1
    return np.packbits(out, axis=1, bitorder="little").view(np.uint64)


def prefix_length(n: int, threshold: float) -> int:
    return n - int(np.ceil(threshold * n - 1e-9)) + 1


def share(threshold: float) -> float:
    """Two sets reach the threshold if their overlap is at least this share of the sum of their sizes."""
    return threshold / (1 + threshold)


class Tree:
    """Texts by size in leaves of LEAF, FAN nodes to a parent; the last level is the root.

    ``caps`` bounds the overlap of each text with any other text of the tree.
    """

    def __init__(self, sigs: np.ndarray, sizes: np.ndarray, caps: np.ndarray):
        self.order = np.argsort(sizes, kind="stable")
        self.sigs, self.sizes, self.caps = sigs[self.order], sizes[self.order], caps[self.order]
        level, cuts = (self.sigs, self.sigs, self.sizes, self.sizes, self.caps), np.arange(0, len(sizes), LEAF)
        self.levels = []
        while not self.levels or len(self.levels[-1][0]) > 1:
            level = tuple(f.reduceat(x, cuts) for f, x in zip((np.bitwise_or, np.bitwise_and, np.minimum, np.maximum, np.maximum), level))
            self.levels.append(level)
            cuts = np.arange(0, len(level[0]), FAN)

    def pairs(self, threshold: float) -> tuple[np.ndarray, np.ndarray]:
        """Positions (before sorting) of all pairs of texts that may reach the threshold."""
        left = right = np.zeros(1, np.int64)
        for depth in range(len(self.levels) - 1, -1, -1):
            o, a, lo, hi, cap = self.levels[depth]
            if depth < len(self.levels) - 1:
                left, right = self._children(left, right, len(o), FAN)
            miss = np.bitwise_count(a[left] & ~o[right]).sum(1).astype(np.int64)
            back = np.bitwise_count(a[right] & ~o[left]).sum(1).astype(np.int64)
            most = np.minimum(np.minimum(hi[left] - miss, cap[left]), np.minimum(hi[right] - back, cap[right]))
            keep = most >= share(threshold) * (lo[left] + lo[right]) - SLACK
            left, right = left[keep], right[keep]
        out_i, out_j = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for at in range(0, len(left), PAIRS // LEAF**2):
            i, j = self._children(left[at : at + PAIRS // LEAF**2], right[at : at + PAIRS // LEAF**2], len(self.sizes), LEAF)
            near = (i < j) & (np.minimum(self.caps[i], self.caps[j]) >= share(threshold) * (self.sizes[i] + self.sizes[j]) - SLACK)
            i, j = i[near], j[near]
            near = may_reach(self.sigs, self.sizes, i, j, threshold)
            out_i.append(i[near])
            out_j.append(j[near])
        i, j = np.concatenate(out_i), np.concatenate(out_j)
        return self.order[i], self.order[j]

    @staticmethod
    def _children(left: np.ndarray, right: np.ndarray, n: int, fan: int) -> tuple[np.ndarray, np.ndarray]:
        step = np.arange(fan)
        i = np.repeat((left[:, None] * fan + step), fan, axis=1).ravel()
        j = np.tile((right[:, None] * fan + step), (1, fan)).ravel()
        keep = (i < n) & (j < n) & (i <= j)
        return i[keep], j[keep]


def may_reach(sigs: np.ndarray, sizes: np.ndarray, i: np.ndarray, j: np.ndarray, threshold: float) -> np.ndarray:
    """Whether the greatest possible overlap of the two sets is enough.

    A bit of one bitmap that the other lacks stands for at least one shingle the other lacks.
    """
    a, b = sigs[i], sigs[j]
    both = np.minimum(sizes[i] - np.bitwise_count(a & ~b).sum(1).astype(np.int64), sizes[j] - np.bitwise_count(b & ~a).sum(1).astype(np.int64))
    return both >= share(threshold) * (sizes[i] + sizes[j]) - SLACK


def candidates(sizes: np.ndarray, sigs: np.ndarray, doc: np.ndarray, token: np.ndarray, place: np.ndarray, threshold: float) -> np.ndarray:
    """Codes i << 32 | j of the pairs of texts that share a token and may reach the threshold.

    ``place`` is how many rarer shingles a text has: of two texts, the first token that they share
    leaves at most the rest of either for their overlap.
    """
    order = np.lexsort((doc, token))
    doc, token = doc[order], token[order]
    caps = sizes[doc] - place[order]
    starts = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]])) if len(token) else np.empty(0, np.int64)
    lengths = np.diff(np.append(starts, len(token)))
    found = []
    few = (lengths > 1) & (lengths <= SHORT)
    for n in np.unique(lengths[few]):  # short lists of equal length at once
        rows = starts[few & (lengths == n)][:, None] + np.arange(n)
        a, b = np.triu_indices(n, 1)
        step = max(1, PAIRS // len(a))
        for at in range(0, len(rows), step):
            x, y = rows[at : at + step, a].ravel(), rows[at : at + step, b].ravel()
            i, j = doc[x], doc[y]
            near = (i != j) & (np.minimum(caps[x], caps[y]) >= share(threshold) * (sizes[i] + sizes[j]) - SLACK)
            found.append(np.minimum(i, j)[near] << 32 | np.maximum(i, j)[near])
            if n > FEW:
                i, j = i[near], j[near]
                found[-1] = found[-1][may_reach(sigs, sizes, i, j, threshold)]
    for k in np.flatnonzero(lengths > SHORT):
        own, first = np.unique(doc[starts[k] : starts[k] + lengths[k]], return_index=True)
        i, j = Tree(sigs[own], sizes[own], caps[starts[k] + first]).pairs(threshold)
        i, j = own[i], own[j]
        found.append(np.minimum(i, j) << 32 | np.maximum(i, j))
        if len(found) > 500:
            found = [distinct(np.concatenate(found))]
    found = distinct(np.concatenate(found)) if found else np.empty(0, np.int64)
    return found[may_reach(sigs, sizes, found >> 32, found & 0xFFFFFFFF, threshold)]


def shingle_sets(rows: DataFrame, shingle: int, min_terms: int) -> DataFrame:
    """(pos, key, n_terms, n, shingles) of the rows of (pos, text): the digest of a text's terms, and its n distinct shingles if it has enough terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = TermHashes()
        for batch in batches:
            keys, counts, sizes, sets = [], [], [], []
            for text in batch.column(1).to_pylist():
                words = terms(text)
                own = distinct((shingle_hashes(hashes(words), shingle) >> np.uint64(32)).astype(np.uint32)) if len(words) >= min_terms else None
                keys.append(hashlib.blake2b(" ".join(words).encode("utf-8", "surrogatepass"), digest_size=16).digest())
                counts.append(len(words))
                sizes.append(0 if own is None else len(own))
                sets.append(None if own is None else own.tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(keys, pa.binary()), pa.array(counts, pa.int32()), pa.array(sizes, pa.int32()), pa.array(sets, pa.binary())], names=["pos", "key", "n_terms", "n", "shingles"])

    return rows.select("pos", "text").mapInArrow(run, "pos long, key binary, n_terms int, n int, shingles binary")


def exact_copies(sets: DataFrame) -> DataFrame:
    """(pos, rep, n_terms) of the rows whose terms are those of a row with a smaller pos."""
    keyed = sets.select("pos", "key", "n_terms")
    groups = keyed.groupBy("key").agg(F.min("pos").alias("rep"), F.count("*").alias("n")).where("n > 1").drop("n")
    return keyed.join(groups, "key").where("pos > rep").select("pos", "rep", "n_terms")


def near_pairs(sets: DataFrame, threshold: float = 0.7) -> DataFrame:
    """(a, b), a < b: rows of (pos, n, shingles), no two of the same terms, whose shingle sets are similar enough."""
    spark = sets.sparkSession
    total = sets.agg(F.count("*").alias("texts"), F.coalesce(F.sum("n"), F.lit(0)).alias("shingles")).first()
    bits = bits_for(total.shingles / 2)
    df = spark.sparkContext.broadcast(count_codes(sets.select("shingles"), bits))
    tasks = max(8, -(-total.texts // TEXTS_PER_TASK))

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, mask = df.value, np.uint32((1 << bits) - 1)
        for batch in batches:
            pos = batch.column(0).to_numpy()
            own = [np.frombuffer(x, np.uint32) for x in batch.column(1).to_pylist()]
            if not own:
                continue
            sizes = np.array([len(s) for s in own], np.int32)
            doc, token, place = [], [], []
            for i, s in enumerate(own):
                f = table[s & mask]
                first = np.lexsort((s, f))[: prefix_length(len(s), threshold)]
                at = np.searchsorted(f[first], 2)  # a shingle of one text meets none
                n, t = UPPER[f[first[at:]]], s[first[at:]].astype(np.uint64)
                where = np.arange(at, len(first))
                hot = np.searchsorted(n, HOT, side="right")  # rarest first
                for k in range(hot, len(t)):
                    blocks = int(-(-n[k] // (HOT // 2)))
                    mine = int(pos[i]) * 0x9E3779B1 % (1 << 32) % blocks
                    pair = [min(mine, b) * blocks + max(mine, b) for b in range(blocks)]
                    token.append(((t[k] << np.uint64(32)) + np.array(pair, np.uint64)) * np.uint64(0xC2B2AE3D27D4EB4F) >> np.uint64(32))
                    doc.append(np.full(blocks, i, np.int32))
                    place.append(np.full(blocks, where[k], np.int64))
                token.append(t[:hot])
                doc.append(np.full(hot, i, np.int32))
                place.append(where[:hot])
            doc, token, place = np.concatenate(doc), np.concatenate(token).astype(np.uint32), np.concatenate(place)
            task = (token.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40)) % np.uint64(tasks)
            order = np.lexsort((doc, task))
            doc, token, place, task = doc[order], token[order], place[order], task[order]
            sigs, out = bitmaps(own), []
            # places in 255ths of the size, rounded down: a cap may only become too large
            place = (place * 255 // np.maximum(1, sizes[doc])).astype(np.uint8)
            for lo, hi in zip(cuts := np.flatnonzero(np.diff(task.astype(np.int64), prepend=-1)), [*cuts[1:], len(task)]):
                first = np.flatnonzero(np.diff(doc[lo:hi], prepend=-1))
                docs, n = doc[lo:hi][first], np.diff(first, append=hi - lo).astype(np.int32)
                out.append((int(task[lo]), pos[docs].astype(np.int64).tobytes(), sizes[docs].tobytes(), sigs[docs].tobytes(), n.tobytes(), token[lo:hi].tobytes(), place[lo:hi].tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.int32()), *(pa.array([o[k] for o in out], pa.binary()) for k in range(1, 7))], names=["task", "pos", "sizes", "sigs", "n", "token", "place"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: dict[int, list] = {}
        for batch in batches:
            for row in batch.to_pylist():
                parts.setdefault(row["task"], []).append(row)
        for task in list(parts):
            rows = parts.pop(task)
            whole = lambda name, kind: np.concatenate([np.frombuffer(r[name], kind) for r in rows])
            pos, sizes, sigs = whole("pos", np.int64), whole("sizes", np.int32).astype(np.int64), whole("sigs", np.uint64).reshape(-1, WORDS)
            doc = np.repeat(np.arange(len(pos)), whole("n", np.int32))
            found = candidates(sizes, sigs, doc, whole("token", np.uint32), whole("place", np.uint8) * sizes[doc] // 255, threshold)
            a, b = pos[found >> 32], pos[found & 0xFFFFFFFF]
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])

    pack = "task int, pos binary, sizes binary, sigs binary, n binary, token binary, place binary"
    found = sets.select("pos", "shingles").mapInArrow(route, pack).repartitionById(tasks, F.col("task")).mapInArrow(meet, "a long, b long")
    found = materialize(found.distinct(), "candidates")

    # only the sets of texts in some candidate pair are joined; a filter of bounded size leaves out nearly all others
    slot_bits = bits_for(16 * found.count())
    slot = lambda c: F.xxhash64(c).bitwiseAND(F.lit((1 << slot_bits) - 1)).cast("int")

    def pack_slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.column(0).to_numpy().astype(np.uint32).tobytes()], pa.binary())], names=["slots"])

    slots = found.select(F.explode(F.array(slot(F.col("a")), slot(F.col("b")))).alias("slot"))
    present = spark.sparkContext.broadcast(presence(slots.mapInArrow(pack_slots, "slots binary"), slot_bits))

    def needed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = present.value
        for batch in batches:
            s = batch.column(2).to_numpy()
            keep = pa.array((bits[s >> 3] >> (7 - (s & 7)) & 1).astype(bool))
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], names=["pos", "shingles"])

    some = sets.select("pos", "shingles", slot(F.col("pos")).alias("slot")).mapInArrow(needed, "pos long, shingles binary")
    both = found.join(some.select(F.col("pos").alias("a"), F.col("shingles").alias("of_a")), "a").join(some.select(F.col("pos").alias("b"), F.col("shingles").alias("of_b")), "b")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                both = np.sort(np.concatenate([np.frombuffer(x, np.uint32), np.frombuffer(y, np.uint32)]))
                o = np.count_nonzero(both[1:] == both[:-1])
                good.append(o >= threshold * (len(both) - o) - 1e-9 * len(both))
            keep = pa.array(good, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], names=["a", "b"])

    return both.select("a", "b", "of_a", "of_b").mapInArrow(verify, "a long, b long")


def near_duplicates(rows: DataFrame, id_col: str = "ingest_pos", text_col: str = "text", shingle: int = 3, min_terms: int = 40, threshold: float = 0.7) -> tuple[DataFrame, DataFrame]:
    """Two tables: pairs (a, b) of representatives, and (pos, rep, n_terms) of the further members of each class.

    Rows with the same terms form a class; its smallest id is the representative. Null texts are in
    no class; texts of fewer than ``min_terms`` terms are in no pair. The similarity is the number
    of distinct shingles in both over the number in either. Shingles are 32-bit hashes: the chance
    of a miscount in a pair is below 1e-5. Ids must be unique, rows without one are left out; other
    columns are not read.
    """
    rows = rows.select(F.col(id_col).cast("long").alias("pos"), F.col(text_col).alias("text")).where("pos is not null and text is not null")
    sets = materialize(shingle_sets(rows, shingle, min_terms), "shingles", "none")
    copies = materialize(exact_copies(sets), "copies")
    own = sets.where("shingles is not null").select("pos", "n", "shingles").join(copies.select("pos"), "pos", "left_anti")
    return near_pairs(own, threshold), copies


def _with_members(pairs: DataFrame, side: str, copies: DataFrame) -> DataFrame:
    """The pairs, and again for each further member of the class on one side."""
    more = pairs.join(copies.select(F.col("rep").alias(side), "pos"), side)
    return pairs.unionByName(more.drop(side).withColumnRenamed("pos", side))


def all_pairs(rows: DataFrame, id_col: str = "ingest_pos", text_col: str = "text", shingle: int = 3, min_terms: int = 40, threshold: float = 0.7) -> DataFrame:
    """(a, b), a < b: :func:`near_duplicates` with the copies of each class written out.

    The pairs within a class are joined block by block, so that no task holds a whole class.
    """
    pairs, copies = near_duplicates(rows, id_col, text_col, shingle, min_terms, threshold)
    same = copies.where(F.col("n_terms") >= min_terms).select("pos", "rep")  # a copy has as many terms as its representative
    both = _with_members(_with_members(materialize(pairs, "pairs"), "a", same), "b", same)
    blocks = same.groupBy("rep").agg(F.ceil(F.count("*") / MEMBERS).alias("blocks"))
    dealt = same.join(blocks, "rep")
    left = dealt.select("rep", F.col("pos").alias("a"), F.pmod(F.xxhash64("pos"), "blocks").alias("block"))
    right = dealt.select("rep", F.col("pos").alias("b"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"))
    inner = left.join(right, ["rep", "block"]).where("a < b").select("a", "b").unionByName(same.select(F.col("rep").alias("a"), F.col("pos").alias("b")))
    return both.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).unionByName(inner)


def links(rows: DataFrame, id_col: str = "ingest_pos", text_col: str = "text", shingle: int = 3, min_terms: int = 40, threshold: float = 0.7) -> DataFrame:
    """(pos, rep, n_links) of every row with a text: its class and how many other classes are near it."""
    pairs, copies = near_duplicates(rows, id_col, text_col, shingle, min_terms, threshold)
    pairs = materialize(pairs, "pairs")
    counts = pairs.select(F.explode(F.array("a", "b")).alias("rep")).groupBy("rep").agg(F.count("*").alias("n_links"))
    texts = rows.where(F.col(text_col).isNotNull()).select(F.col(id_col).cast("long").alias("pos")).where("pos is not null")
    member = texts.join(copies.select("pos", "rep"), "pos", "left").withColumn("rep", F.coalesce("rep", "pos"))
    return member.join(counts, "rep", "left").select("pos", "rep", F.coalesce("n_links", F.lit(0)).alias("n_links"))
