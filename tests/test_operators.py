import hashlib
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexloom.functions import generate
from lexloom.operators import answer, curate, vector
from lexloom.plans import build
from lexloom.sources import documents as sources
from lexloom.streaming.ingest import ingest, stream_chunks


def test_dense_topk_against_numpy(spark):
    rng = np.random.RandomState(1)
    x = rng.randn(200, 8)
    x[7] = x[3]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(900, None), (901, [0.0] * 8)] + [(1000 + i, [1.0, 2.0]) for i in range(400)]
    df = spark.createDataFrame(rows, "id long, embedding array<float>")
    got = vector.dense_topk(df.where("id < 20").withColumnRenamed("id", "q"), df, "q", "id", k=4).collect()
    u = x.astype(np.float32).astype(float)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    for q in range(20):
        want = sorted(range(200), key=lambda i: (-round(float(u[q] @ u[i]), 10), i))[:4]
        assert [r.id for r in sorted((r for r in got if r.q == q), key=lambda r: r.rank)] == want


def test_curate(spark):
    df = spark.createDataFrame([(i, f"k{i % 7}", None if i % 3 else "statute") for i in range(50)], "pos long, key string, doc_type string")
    assert {r.key: r.pos for r in curate.keep_first(df, "key", "pos").collect()} == {f"k{i}": i for i in range(7)}
    assert {r.doc_type: r.n for r in curate.count_by_type(df).collect()} == {"statute": 17, "unknown": 33}
    assert [r.i for r in curate.running_index(df, "pos", "i").orderBy("pos").collect()] == list(range(50))
    assert curate.new_rows(df, df.where("pos < 3"), "key").count() == 50 - 24 + 2
    assert curate.sample(df, "pos", 10).count() == 10
    assert curate.running_index(df.limit(0), "pos", "i").count() == 0


def test_answer(spark):
    hits = spark.createDataFrame([(1, 1, "A", "s", "statute", 0.9, "t1"), (1, 2, "A", "s", "statute", 0.8, "t2"), (1, 3, "B", "", "judgment", 0.7, "t3")], "qid int, rank int, source string, section string, doc_type string, score double, text string")
    queries = spark.createDataFrame([(1, "why"), (2, "what")], "qid int, question string")
    assert [(r.source, r.score) for r in answer.citations(hits, "qid").orderBy("rank").collect()] == [("A", 0.9), ("B", 0.7)]
    prompts = {r.qid: r.prompt for r in answer.build_prompts(queries, hits, "qid", "question").collect()}
    assert "Source: A | Type: statute | Section: s\nt1" in prompts[1] and "Source: B | Type: judgment\nt3" in prompts[1] and answer.TEMPLATE.no_passages in prompts[2]
    own = answer.Template(passages="P", duties=("short",))
    assert answer.build_prompts(queries, hits, "qid", "question", own).where("qid = 1").first().prompt.startswith("## P\n\n--- Passage 1 ---")
    made = {r.qid: r for r in answer.responses(queries, hits, "qid", "question").collect()}
    assert [tuple(c) for c in made[1].citations] == [("A", "s", "statute", 0.9), ("B", "", "judgment", 0.7)] and made[1].context_used and made[1].warning is None and made[1].best_score == 0.9
    assert made[2].citations == [] and made[2].warning and not made[2].context_used
    assert "t1" in made[1].answer and all("not legal advice" in r.answer for r in made.values())
    assert answer.responses(queries.limit(0), hits, "qid", "question").count() == 0
    df = spark.createDataFrame([("",), (" ",), ("a" * 1001,), ("ok",), (None,)], "q string")
    assert [r[0] for r in df.select(answer.validate_query(F.col("q"))).collect()] == [400, 400, 400, 200, 400]
    up = spark.createDataFrame([("text/plain", 5, True), ("image/png", 0, True), ("image/png", 5, False), ("application/pdf", 5, True)], "m string, n int, d boolean")
    assert [r[0] for r in up.select(answer.validate_upload(F.col("m"), F.col("n"), F.col("d"))).collect()] == [415, 400, 422, 200]
    assert answer.health(spark.createDataFrame([("ok — 5",), ("error",)], "status string")).first()[0] == "degraded"


def test_flows(spark):
    hits = spark.createDataFrame([(1, 1, "A", "s", "statute", 0.9, "t1")], "qid int, rank int, source string, section string, doc_type string, score double, text string")
    asked = []

    def search(queries):
        asked.append({r[0]: r[1] for r in queries.collect()})
        return hits

    def load():
        return lambda prompts, system, max_tokens, temperature: [f" {len(p)} {max_tokens} " for p in prompts]

    queries = spark.createDataFrame([(1, "why"), (2, " "), (3, None), (4, "a" * 1001)], "qid int, question string")
    got = {r.qid: r for r in answer.answer_questions(queries, search, "qid", "question", answer=generate.generator(load, max_tokens=9)).collect()}
    assert asked == [{1: "why"}] and {q: r.status for q, r in got.items()} == {1: 200, 2: 400, 3: 400, 4: 400}
    assert got[1].flow == "text_query" and got[1].answer.endswith(" 9") and got[1].citations[0].source == "A" and got[2].answer is None
    assert {r.qid: r.status for r in answer.answer_questions(queries, search, "qid", "question", None).collect()}[4] == 200
    files = [(1, "application/pdf", 9, "x" * 600, " due? "), (2, "image/png", 5, "rent", None), (3, "text/plain", 5, "rent", None), (4, "image/png", 0, None, None), (5, "image/png", 5, " ", None), (6, "image/png", 5, None, None)]
    uploads = spark.createDataFrame(files, "qid int, mime string, bytes int, text string, question string")
    asked.clear()
    got = {r.qid: r for r in answer.answer_documents(uploads, search, "qid", "mime", "bytes", "text", "question").collect()}
    assert {q: r.status for q, r in got.items()} == {1: 200, 2: 200, 3: 415, 4: 400, 5: 422, 6: 422} and set(asked[0]) == {1, 2}
    assert got[1].extracted_text == "x" * 500 + "..." and got[1].query_used == "due?" and got[2].query_used == "Document analysis" and got[3].extracted_text is None
    told = {r.qid: r for r in answer.analyze_documents(uploads.withColumn("name", F.lit("f")), "qid", "name", "mime", "bytes", "text").collect()}
    assert (told[1].file_type, told[1].character_count, told[1].success) == ("pdf", 600, True) and told[5].success is False and told[6].status == 422 and told[3].file_type is None
    shown = answer.responses(queries.where("qid < 3"), hits, "qid", "question").select("qid", answer.rendered(F.lit("q"), F.col("answer"), F.col("citations"), F.col("warning")).alias("t"))
    shown = {r.qid: r.t for r in shown.collect()}
    assert "1. STATUTE A, s (0.9)" in shown[1] and "Warning: " in shown[2] and "Sources" not in shown[2]
    report = answer.health_report(spark.createDataFrame([("store", "ok — 5"), ("llm", "error: x")], "service string, status string"), ["store", "llm", "embedder"]).first()
    assert tuple(report) == ("ok — 5", "error: x", "unknown", "degraded")


def test_text_search_against_plain_counts(spark):
    rng = np.random.RandomState(2)
    texts = [" ".join(f"w{i}" for i in rng.randint(0, 30, rng.randint(0, 12))) for _ in range(120)] + [None, "", "unheard"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id long, text string")
    queries = df.where("id < 15").withColumnRenamed("id", "q").withColumnRenamed("text", "question")
    got = vector.text_topk(queries, df, "q", "question", "id", "text", 4).collect()
    spot = lambda w: int(hashlib.md5(w.encode()).hexdigest()[:8], 16) % 384
    bags = np.zeros((len(texts), 384))
    for i, t in enumerate(texts):
        for w in (t or "").split():
            bags[i, spot(w)] += 1
    unit = bags / np.maximum(1e-12, np.linalg.norm(bags, axis=1, keepdims=True))
    for q in range(15):
        cos = unit @ unit[q]
        want = sorted((i for i in range(len(texts)) if cos[i] > 0), key=lambda i: (-round(cos[i], 10), i))[:4]
        assert [r.id for r in sorted((r for r in got if r.q == q), key=lambda r: r.rank)] == want
    assert vector.text_topk(queries.limit(0), df, "q", "question", "id").count() == 0 and vector.text_topk(queries, df.limit(0), "q", "question", "id").count() == 0


def test_append_keeps_the_first(spark, tmp_path):
    path = str(tmp_path / "table")
    assert vector.create(spark, path, "chunk_id string, n int, extra string").count() == 0
    rows = spark.createDataFrame([("a", 3, "x"), ("a", 1, "y"), ("b", 2, None), (None, 0, "z")], "chunk_id string, n int, extra string")
    vector.append(rows, path, order="n")
    vector.append(rows.withColumn("n", F.col("n") - 9).unionByName(spark.createDataFrame([("c", 5, "")], rows.schema)), path)
    assert sorted(tuple(r) for r in spark.read.parquet(path).select("chunk_id", "n").collect()) == [("a", 1), ("b", 2), ("c", 5)]
    (tmp_path / "broken").mkdir()
    (tmp_path / "broken" / "x.parquet").write_bytes(b"no parquet")
    with pytest.raises(Exception):  # noqa: B017  # a table that can't be read is not an empty one
        vector.append(rows, str(tmp_path / "broken"))


def test_build(spark, tmp_path):
    pages = spark.createDataFrame([("f.pdf", 1, "Section 1. Rent is due. " * 8), ("g.pdf", 1, "lost")], "filename string, page_num int, text string")
    manifest = spark.createDataFrame([("f.pdf", "Rent Act", "statute")], "filename string, source string, doc_type string")
    judgments = spark.createDataFrame([(f"j{i}", "The appeal is dismissed with costs to the tenant. " * 12, "judgment", None, "summ") for i in range(30)] * 2, "doc_id string, text string, doc_type string, court string, source_config string")
    ready = spark.createDataFrame([(i, None if i % 2 else f"c{i}", "short" if i == 3 else f"A ready-made chunk of number {i} that is long enough to be kept by the filter, surely.", None) for i in range(9)], "pos int, chunk_id string, text string, source string")
    made = build.build_corpus(pages, manifest, judgments, ready, "pos", 5, 6, str(tmp_path / "json"))
    assert {r.origin: r["count"] for r in made.groupBy("origin").count().collect()} == {"statutes": 1, "judgments": 5, "prechunked": 6}
    again = sources.json_array(spark, str(tmp_path / "json"), sources.CHUNK_SCHEMA)
    assert again.count() == 12 and json.loads(next((tmp_path / "json").glob("part-*")).read_text())
    assert made.where("origin = 'prechunked' and length(text) < 80").count() == 0
    table = build.load_corpus(made, str(tmp_path / "vectors"), embed=lambda d: d.withColumn("embedding", F.array(F.lit(1.0))))
    assert table.count() == made.select("chunk_id").distinct().count() and "embedding" in table.columns
    sources.write_json_array(made.limit(0), str(tmp_path / "none"))
    assert sources.json_array(spark, str(tmp_path / "none"), sources.CHUNK_SCHEMA).count() == 0
    told = curate.progress(spark.range(40).select(F.floor(F.col("id") / 16).alias("batch_no")), 16, seconds=2.0)
    assert [(r.batch_no, r.n_batches, r.added, r.pct, r.eta_s) for r in told.orderBy("batch_no").collect()] == [(0, 3, 16, 40.0, 3.0), (1, 3, 32, 80.0, 1.0), (2, 3, 40, 100.0, 0.0)]


def test_scanned_files(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for name, content in (("a.pdf", b"one \x0c \x0ctwo\n\n three"), ("b.png", b" x \n\ny"), ("c.jpg", b" "), ("d.tif", b"q")):
        (tmp_path / "in" / name).write_bytes(content)
    load = sources.ocr_extractor(lambda content, dpi: content.split(b"\x0c"), lambda content: content, bytes.upper, lambda image, lang, config: image.decode())
    got = {r.path.rpartition("/")[2]: r for r in sources.extract_documents(sources.files(spark, str(tmp_path / "in")), load).collect()}
    assert got["a.pdf"].text == "--- Page 1 ---\nONE\n\n--- Page 3 ---\nTWO\nTHREE" and got["b.png"].text == "X\nY"
    assert {k: r.success for k, r in got.items()} == {"a.pdf": True, "b.png": True, "c.jpg": False, "d.tif": False}


def test_the_split_of_a_collection(spark, tmp_path):
    for split, n in (("dev", 2), ("test", 3)):
        spark.range(n).write.parquet(str(tmp_path / "a" / split))
    assert sources.dataset(spark, str(tmp_path), "a").count() == 2
    spark.range(5).write.json(str(tmp_path / "a" / "train"))
    assert sources.dataset(spark, str(tmp_path), "a").count() == 5
    (tmp_path / "b").mkdir()
    with pytest.raises(FileNotFoundError):
        sources.dataset(spark, str(tmp_path), "b")


def test_judgments_go_on_counting(spark):
    summ = spark.createDataFrame([(0, None, "a", None, "s"), (1, "x", "b", None, None), (2, None, " ", None, None)], "pos int, id string, document string, text string, summary string")
    bail = spark.createDataFrame([(0, "f", None, None), (1, None, "", "d")], "pos int, facts string, text string, document string")
    got = sources.judgments(summ, bail, "pos")
    assert sorted((r.doc_id, r.source_config, r.court) for r in got.collect()) == [("0", "summ", "Supreme Court of India"), ("bail_2", "bail", "Supreme Court of India"), ("bail_3", "bail", "Supreme Court of India"), ("x", "summ", "Supreme Court of India")]


def test_sources(spark, tmp_path):
    rows = spark.createDataFrame([(0, None, ["a.", "b."], "t", "s"), (1, "x1", [], "text", "s"), (2, None, None, " ", None)], "pos int, id string, document array<string>, text string, summary string")
    assert [(r.doc_id, r.text) for r in sources.judgments_summ(rows, "pos").orderBy("doc_id").collect()] == [("0", "a. b."), ("x1", "text")]
    bail = spark.createDataFrame([(0, "", "t", None), (1, None, None, None), (2, "f", "t", "d")], "pos int, facts string, text string, document string")
    assert sorted((r.doc_id, r.text) for r in sources.judgments_bail(bail, "pos", 5).collect()) == [("bail_5", "t"), ("bail_6", "f")]
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.PDF").write_bytes(b"one\x0c\x0ctwo")
    (tmp_path / "in" / "b.tif").write_bytes(b"x")
    files = sources.files(spark, str(tmp_path / "in"))
    assert sorted(r.file_type for r in files.collect()) == ["pdf", "unsupported"]

    def load():
        def pages(content, kind):
            if kind != "pdf":
                raise ValueError(kind)
            return content.decode().split("\x0c")

        return pages

    assert [(r.page_num, r.text) for r in sources.extract(files, load).orderBy("page_num").collect()] == [(1, "one"), (3, "two")]
    pages = spark.createDataFrame([("f", 2, "b "), ("f", 1, "a"), ("f", 3, " ")], "k string, n int, t string")
    assert sources.ocr_pages(pages, "k", "n", "t").first()[1] == "--- Page 1 ---\na\n\n--- Page 2 ---\nb"


def test_stream_ingests_each_key_once(spark, tmp_path):
    src, table = str(tmp_path / "src"), str(tmp_path / "table")
    spark.createDataFrame([("a", 1), ("b", 2), ("a", 3)], "chunk_id string, n int").coalesce(1).write.parquet(src)
    for more in ([], [("b", 4), ("c", 5)]):
        if more:
            spark.createDataFrame(more, "chunk_id string, n int").coalesce(1).write.mode("append").parquet(src)
        ingest(stream_chunks(spark, src, "chunk_id string, n int"), table, str(tmp_path / "cp")).awaitTermination()
    assert sorted(r.chunk_id for r in spark.read.parquet(table).collect()) == ["a", "b", "c"]
    vector.truncate(spark, table)
    assert spark.read.parquet(table).count() == 0 and spark.read.parquet(table).columns == ["chunk_id", "n"]
