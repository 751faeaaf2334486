import random

import pytest

from lexloom.operators.chunk import chunk_documents

from .spec import chunks


def test_against_plain_reading(spark):
    rng, rows = random.Random(5), []
    for d in range(40):
        parts = []
        for _ in range(rng.randint(0, 7)):
            sentences = [" ".join(f"w{rng.randint(0, 99)}" for _ in range(rng.choice((3, 20, 60, 400)))) + "." for _ in range(rng.randint(1, 12))]
            parts.append(rng.choice(("", "Section 5. Scope ", "CHAPTER IV Rules ", "")) + " ".join(sentences))
        rows.append((d, "\n\n".join(parts), "IPC 1860", "statute", 1))
    rows += [(100, None, "s", "x", 1), (101, "", "s", "x", 1)]
    df = spark.createDataFrame(rows, "id int, text string, source string, doc_type string, chunk_no int").drop("chunk_no")
    got = {}
    for r in chunk_documents(df, "text", "source", "doc_type", ["id"]).collect():
        got.setdefault(r.id, []).append((r.chunk_no, r.chunk_id, r.text, r.section, r.word_count))
    for d, text, source, *_ in rows:
        assert sorted(got.get(d, [])) == (chunks(text, source) if text else [])


def test_overlap_must_be_positive(spark):
    with pytest.raises(ValueError, match="overlap"):
        chunk_documents(spark.createDataFrame([("a", "b", "c")], "t string, s string, d string"), "t", "s", "d", overlap=0)
