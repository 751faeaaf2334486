"""Similar vectors, near-duplicates and copies against brute force, with the awkward cases."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexloom.llm import p1_similar, p4_near, p7_copies
from lexloom.llm.tables import UPPER, codes
from lexloom.llm.terms import terms


def test_similar_vectors(spark):
    rng = np.random.RandomState(0)
    centres = rng.randn(60, 32)
    x = np.concatenate([c + 0.45 * rng.randn(6, 32) for c in centres])
    x[5] = x[6] = x[7] = x[8] = x[9] = x[10] = x[11] = x[4]  # copies, more than k
    rows = [(i, v.tolist(), 0.0) for i, v in enumerate(x)] + [(900, None, 0.0), (901, [0.0] * 32, 0.0), (902, [1.0], 0.0), (903, [], 0.0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, cosine double")
    got = {(r.query, r.neighbour) for r in p1_similar.nearest(df, per_pivot=32).collect()}
    u = x.astype(np.float32).astype(float)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    c = np.round(u @ u.T, 6)
    np.fill_diagonal(c, -2)
    want = {(i, j) for i in range(len(x)) for j in sorted(np.flatnonzero(c[i] >= 0.6), key=lambda j: (-c[i, j], j))[:5]}
    assert len(want & got) >= 0.98 * len(want) and len(got - want) <= 0.02 * len(want)
    for q in range(4, 12):  # the smallest ids among the copies
        assert {n for a, n in got if a == q} == set([n for n in range(4, 12) if n != q][:5])
    assert p1_similar.nearest(df.limit(0)).count() == 0
    assert p1_similar.nearest(df.where("vec_id >= 900")).count() == 0


def test_the_length_of_most_vectors_counts(spark):
    rng = np.random.RandomState(5)
    x = rng.randn(20, 8)
    x[1] = x[0] + 0.01
    rows = [(i, []) for i in range(400)] + [(400 + i, [1.0, 2.0]) for i in range(10)] + [(500 + i, v.tolist()) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").coalesce(1)
    assert (500, 501) in {(r.query, r.neighbour) for r in p1_similar.nearest(df).collect()}


def test_windows_count_collisions():
    rng = np.random.RandomState(6)
    x = rng.randn(300, 12)
    arrays = p1_similar.Arrays(x, np.eye(12)[:, :6])
    got = arrays.collisions(x[:5, :6].astype(np.float32), 0.5)
    want = (np.abs(x[None, :, :6] - x[:5, None, :6]) <= 0.5).sum(2)
    assert (got >= want).all() and (got - want).mean() < 0.2  # places are kept in 256ths: windows may be a little too wide


def test_nearest_pivots():
    rng = np.random.RandomState(7)
    pivots, x = (v / np.linalg.norm(v, axis=1, keepdims=True) for v in (rng.randn(90, 16), rng.randn(200, 16)))
    got = p1_similar.Pivots(pivots, 3).nearest(x)
    want = np.argsort(-(x @ pivots.T), axis=1)[:, :3]
    assert np.mean([len(set(a) & set(b)) for a, b in zip(got, want)]) > 2.9
    assert (p1_similar.Pivots(pivots[:2], 3).nearest(x) == -1).sum() == 200


def test_large_cells_are_cut_into_blocks(spark, monkeypatch):
    monkeypatch.setattr(p1_similar, "BLOCK", 40)
    rng = np.random.RandomState(1)
    x = rng.randn(1, 16) + 0.3 * rng.randn(150, 16)  # all alike: every cell is hot
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    got = {(r.query, r.neighbour) for r in p1_similar.nearest(df).collect()}
    u = x.astype(np.float32).astype(float)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    c = np.round(u @ u.T, 6)
    np.fill_diagonal(c, -2)
    want = {(i, j) for i in range(len(x)) for j in sorted(np.flatnonzero(c[i] >= 0.6), key=lambda j: (-c[i, j], j))[:5]}
    assert len(want & got) >= 0.98 * len(want)


def test_neighbours_meet_in_tables_with_many_cells(spark):
    rng = np.random.RandomState(2)
    centres = rng.randn(1200, 96)
    x = np.concatenate([c + 0.5 * rng.randn(4, 96) for c in centres])
    x = np.round(x / np.linalg.norm(x, axis=1, keepdims=True) * 1024) / 1024  # few digits, as vectors are often stored
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    got = {(r.query, r.neighbour): r.cosine for r in p1_similar.nearest(df, per_pivot=4).collect()}
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    c = np.round(u @ u.T, 6)
    np.fill_diagonal(c, -2)
    want = {(i, int(j)): c[i, j] for i in range(len(x)) for j in sorted(np.flatnonzero(c[i] >= 0.6), key=lambda j: (-c[i, j], j))[:5]}
    assert len(want.keys() & got.keys()) >= 0.98 * len(want)
    assert max(abs(got[p] - want[p]) for p in want.keys() & got.keys()) < 5e-7  # exact, not by 16 bits


def _texts(seed=3, n=60):
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        base = [f"w{rng.randint(0, 400)}" for _ in range(rng.choice((30, 45, 60, 120)))]
        out.append(" ".join(base))
        for _ in range(rng.randint(0, 3)):
            other = list(base)
            for _ in range(rng.randint(0, 8)):
                i = rng.randrange(len(other))
                other[i : i + rng.randint(0, 2)] = [f"v{rng.randint(0, 50)}"] * rng.randint(0, 2)
            out.append(" ".join(other))
    return out


def _near(texts):
    def sets(t):
        w = terms(t)
        return {tuple(w[i : i + 3]) for i in range(len(w) - 2)} if len(w) >= 40 else None

    s = [sets(t) for t in texts]
    return {(i, j) for i in range(len(s)) for j in range(i + 1, len(s)) if s[i] and s[j] and 10 * len(s[i] & s[j]) >= 7 * len(s[i] | s[j])}


@pytest.mark.parametrize("hot", [4096, 4])
def test_near_duplicates(spark, monkeypatch, hot):
    monkeypatch.setattr(p4_near, "HOT", hot)  # 4: shingles are split into pairs of blocks
    monkeypatch.setattr(p4_near, "SHORT", 4)  # trees for most lists
    texts = _texts()
    texts += [texts[0].upper(), texts[0].replace(" ", ", "), texts[0], "", " "]
    rows = [(i, t, "x") for i, t in enumerate(texts)] + [(999, None, None)]
    df = spark.createDataFrame(rows, "ingest_pos long, text string, pos string")
    got = [(r.a, r.b) for r in p4_near.all_pairs(df).collect()]
    assert len(got) == len(set(got)) and set(got) == _near(texts)
    assert p4_near.all_pairs(df.limit(0)).count() == 0


def test_a_shingle_in_very_many_texts(spark, monkeypatch):
    monkeypatch.setattr(p4_near, "HOT", 8)
    rng = random.Random(11)
    phrase = " ".join(f"common{i}" for i in range(39))
    texts = [f"{phrase} {' '.join(f'w{rng.randint(0, 3)}' for _ in range(8))}" for _ in range(60)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "ingest_pos long, text string")
    assert {(r.a, r.b) for r in p4_near.all_pairs(df).collect()} == _near(texts)


def test_counts_do_not_saturate():
    n = np.array([0, 1, 2, 3, 100, 65_535, 65_536, 10**6, 10**9])
    upper = UPPER[codes(n)]
    assert (upper >= n).all() and (upper <= 1.1 * n + 0.1).all() and upper[:3].tolist() == [0, 1, 2]


def test_classes_of_copies_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(p4_near, "MEMBERS", 4)
    text = " ".join(f"w{i}" for i in range(50))
    df = spark.createDataFrame([(i, text.upper() if i % 2 else text) for i in range(30)] + [(99, "own text")], "ingest_pos long, text string")
    got = [(r.a, r.b) for r in p4_near.all_pairs(df).collect()]
    assert len(got) == len(set(got)) and set(got) == {(i, j) for i in range(30) for j in range(i + 1, 30)}
    links = {r.pos: (r.rep, r.n_links) for r in p4_near.links(df).collect()}
    assert links[7] == (0, 0) and links[99] == (99, 0)


def test_tree_keeps_every_pair():
    rng = np.random.RandomState(2)
    base = rng.randint(0, 2**31, 150).astype(np.uint32)
    sets = []
    for _ in range(150):
        keep = base[rng.rand(150) < rng.choice((0.95, 0.8, 0.4))]
        sets.append(np.unique(np.concatenate([keep, rng.randint(0, 2**31, rng.randint(0, 40)).astype(np.uint32)])))
    sizes = np.array([len(s) for s in sets])
    i, j = p4_near.Tree(p4_near.bitmaps(sets), sizes, sizes).pairs(0.7)
    got = {(min(a, b), max(a, b)) for a, b in zip(i.tolist(), j.tolist())}
    want = {(a, b) for a in range(150) for b in range(a + 1, 150) if len(np.intersect1d(sets[a], sets[b])) >= 0.7 * len(np.union1d(sets[a], sets[b]))}
    assert want and want <= got


def test_copies(spark):
    texts = [
        "The lessor shall repair the roof.", "the LESSOR shall  repair the roof", "The lessor, shall re-pair the roof!", "Court: High Court; Case No: 12/1999; Place: Adur", "Place: Adur | COURT: high court | Case No:12/1999",
        "Court High Court Case No 12/1999 Place Adur", "too short", "Too, short", None, "", "Place: Adur | Court: High Court | Case No: 12/1998", "दो शब्द और दो शब्द और दो शब्द", "दो शब्द; और दो शब्द  और दो शब्द",
    ]
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "ingest_pos long, text string, keep int")
    assert {(r.keep, r.copy) for r in p7_copies.copy_groups(df).collect()} == {(0, 1), (0, 2), (3, 4), (3, 5), (11, 12)}
    assert p7_copies.copy_groups(df.limit(0)).count() == 0


def test_records_with_copies_and_members(spark):
    texts = ["The lessor shall repair the roof.", "the LESSOR shall  repair the roof", "An own text without any copy.", "short", "Short", "", None, "The lessor, shall re-pair the roof!"]
    df = spark.createDataFrame([(i, t, f"c{i // 2}") for i, t in enumerate(texts)], "ingest_pos long, text string, chunk_id string")
    assert {(r.keep, r.n_copies) for r in p7_copies.records(df).collect()} == {(0, 3), (2, 1), (3, 1), (4, 1), (5, 1), (6, 1)}
    assert sorted((r.keep, r.pos, r.chunk_id) for r in p7_copies.members(df).collect()) == [(0, 0, "c0"), (0, 1, "c0"), (0, 7, "c3"), (2, 2, "c1"), (3, 3, "c1"), (4, 4, "c2"), (5, 5, "c2"), (6, 6, "c3")]


def test_a_hot_group_of_copies(spark):
    df = spark.range(3000).select(F.col("id").alias("ingest_pos"), F.when(F.col("id") % 3 == 0, "The same text, again and again.").otherwise(F.concat(F.lit("An own text of number "), F.col("id"))).alias("text"))
    found = p7_copies.copy_groups(df)
    assert found.count() == 999 and found.where("keep <> 0").count() == 0
