"""Splitting, scans, statistics, caps, tokens, leaks and personal data on small cases."""

import base64
import os
import random
from fractions import Fraction

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lexloom.llm import p2_split, p3_scans, p5_quality, p6_cap, p8_tokenize, p9_leaks, p10_personal
from lexloom.llm.boost import Trees
from lexloom.llm.terms import terms

VOCABULARY = f"{p8_tokenize.TOKENIZERS}/byte_bpe_50k.tiktoken"


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from(["a", "bb.", "Ccc", "\n\n", "\n", "1.", "- x", " ", "CHAPTER II", "d?"]), max_size=400), st.integers(3, 30))
def test_pieces_cover_the_text(parts, limit):
    text, overlap = " ".join(parts), limit // 3
    words = p2_split._WORD.findall(text)
    pieces = [text[a:b] for a, b, _ in p2_split.split_text(text, limit, overlap)]
    if len(words) <= limit:
        assert pieces == [text]
        return
    own = [p2_split._WORD.findall(p) for p in pieces]
    assert all(len(w) <= limit for w in own)
    joined = list(own[0])
    for before, after in zip(own, own[1:]):
        k = min(overlap, len(before))
        assert before[len(before) - k :] == after[:k]
        joined += after[k:]
    assert joined == words


def test_split_ends_at_sentences(spark):
    text = "\n\n".join(" ".join("One two three four five." for _ in range(40)) for _ in range(5))
    df = spark.createDataFrame([(1, text, "x"), (1, text, "x"), (2, "short", None), (3, "", None), (4, None, None), (5, "w " * 5000, None)], "id int, text string, piece string")
    rows = p2_split.split_oversized(df, "id").collect()
    assert all(r.piece.endswith(".") and r.words <= 375 for r in rows if r.item_id == "1")
    assert {r.item_id: r.n_pieces for r in rows}["2"] == 1 and {r.item_id for r in rows} == {"1", "2", "3", "5"}
    assert all(text[r.start_at - 1 :].startswith(r.piece) for r in rows if r.item_id == "1")
    assert p2_split.split_oversized(df.limit(0), "id").count() == 0


def test_scans(spark):
    prose = "The learned counsel argued that the tribunal should consider the matter under protest and decide it."
    scan = "TORVALI LAW REPORTS 12\nThe learnecl counsel argued that the tri-\nbunal should\n- 13 -\nconsider the matter under\nprotest.\nCHAPTER VII\n(xiv)\n146"
    rows = [(i, prose, "c") for i in range(40)] + [(100 + i, f"TORVALI LAW REPORTS {i}\n{prose}", "c") for i in range(6)]
    rows += [(200, scan, "c"), (201, "TORVALI LAW REPORTS 9 The learned coun- sel argued Page 4 of 9 that the tribuna1 should", "c"), (300, "", "c"), (301, None, "c")]
    df = spark.createDataFrame(rows, "id int, text string, kind string")
    found = {(r.item_id, r.line_no, r.kind) for r in p3_scans.find_noise([("t", df, "id", "text")]).collect()}
    assert {x for x in found if x[0] == "200"} == {("200", 1, "header"), ("200", 2, "glyph"), ("200", 2, "hyphen"), ("200", 4, "pageno"), ("200", 9, "pageno")}
    assert {x for x in found if x[0] == "201"} == {("201", 1, k) for k in ("header", "glyph", "hyphen", "pageno")}
    assert not {x for x in found if int(x[0]) < 100} and {x for x in found if x[0] == "103"} == {("103", 1, "header")}
    mended = {(r.item_id, r.paragraph_no): r.paragraph for r in p3_scans.repair([("t", df, "id", "text")]).collect()}
    assert mended["200", 1] == "The learned counsel argued that the tribunal should consider the matter under protest."
    assert p3_scans.find_noise([("t", df.limit(0), "id", "text")]).count() == 0


def test_nothing_found_survives_repair(spark):
    prose = "The learned counsel for the Indian landlord argued that the tribunal should consider the matter under protest and decide it."
    rows = [(i, prose) for i in range(60)] + [(100 + i, f"TORVALI LAW REPORTS {i}\n{prose}") for i in range(6)]
    rows += [
        (200, "The learned !ndian landlord argued that the Tribuna1 should\n- 13 -\nTORVALI LAW REPORTS 4\nconsider the mat-\nter under pro-\nte5t and decide it."),
        (201, "TORVALI LAW REPORTS 9 The learned coun- sel argued Page 4 of 9 that the tribuna1 should TORVALI LAW REPORTS 10 decide"), (202, "The LEARNED C0UNSEL argued that !t should"),
    ]
    df = spark.createDataFrame(rows, "id int, text string")
    counts = p3_scans.word_counts(p3_scans.texts_of([("t", df, "id", "text")]))
    found = p3_scans.find_noise([("t", df, "id", "text")], counts).where("item_id >= '200'")
    assert {(r.item_id, r.kind) for r in found.collect()} >= {("200", k) for k in ("glyph", "pageno", "header", "hyphen")} | {("201", k) for k in ("glyph", "pageno", "header", "hyphen")}
    mended = p3_scans.repair([("t", df, "id", "text")], counts).where("item_id >= '200'")
    again = p3_scans.find_noise([("m", mended, "item_id", "paragraph")], counts)
    assert again.where("kind <> 'glyph' or wrong rlike '[0-9!]'").count() == 0
    texts = {r.item_id: r.paragraph for r in mended.collect()}
    assert texts["200"] == "The learned indian landlord argued that the Tribunal should consider the matter under protest and decide it."
    assert texts["201"].split() == "The learned counsel argued that the tribunal should decide".split() and "LEARNED COUNSEL" in texts["202"]


def test_a_title_before_a_capital_word(spark):
    prose = "The learned counsel argued that the tribunal should consider the matter under protest and decide it."
    rows = [(i, f"TORVALI LAW REPORTS {i}\n{prose}") for i in range(6)] + [(10, f"TORVALI LAW REPORTS - 154 {prose}"), (11, f"TORVALI LAW REPORTS {prose}"), (12, f"UNHEARD OF {prose}")]
    found = p3_scans.find_noise([("t", spark.createDataFrame(rows, "id int, text string"), "id", "text")])
    assert {r.item_id for r in found.where("kind = 'header'").collect()} == {*map(str, range(6)), "10", "11"}


def test_a_wrong_form_of_any_number_of_texts(spark):
    rows = [(i, f"Case {i}: the learned tribunal sat.") for i in range(900)] + [(i, f"Case {i}: the learned tribuna1 sat.") for i in range(1000, 1070)]
    df = spark.createDataFrame(rows * 2, "id int, text string")  # repeated rows count once
    found = {r.item_id for r in p3_scans.find_noise([("t", df, "id", "text")]).where("kind = 'glyph' and right = 'tribunal'").collect()}
    assert found == {str(i) for i in range(1000, 1070)}


def test_a_full_slot_makes_no_title(spark):
    # the hash of this line's key and that of a word of the prose agree in their 23 bits
    prose = "The learned counsel argued that the tribunal should consider the matter under protest and decide it."
    rows = [(i, f"{prose} {i}") for i in range(40)] + [(100, f"OZUUYOT XUEMZZM\n{prose}")]
    found = p3_scans.find_noise([("t", spark.createDataFrame(rows, "id int, text string"), "id", "text")])
    assert found.where("kind = 'header'").count() == 0


def test_a_full_slot_makes_no_word_known(spark):
    # the hashes of these words and those of words of the prose agree in their 22 bits
    gibberish = "jgxhhdx fdvcjbv gbbzcjh gjghcvv gcdgkqf kvbcdgc gcccqzq bvgvzvf"
    sentences = ("The learned counsel argued that the tribunal should consider the matter under protest and decide it.", "In this case it is held that the claim of the tenant was not in time.", "It is for the lessor to show that notice was served on him.", "No order is made as to the costs of the appeal before us.")
    rows = [(i, f"{' '.join(sentences)} {i}", 1) for i in range(40)] + [(100, gibberish, 8)]
    df = spark.createDataFrame(rows, "ingest_pos long, text string, word_count int")
    assert [r.kind for r in p5_quality.found(df).where("ingest_pos = 100").collect()] == ["junk"]


def test_statistics(spark):
    rng = random.Random(1)
    prose = [" ".join(rng.choice(["The tribunal held that the claim of the tenant was not in time.", "It is for the lessor to show that the notice was served on him.", "No order was made as to the costs of the appeal before us."]) for _ in range(8)) for _ in range(80)]
    table = "Sl | Date | Amount\n" + "\n".join(f"{i} | {i}/02/1999 | {i * 37}.50" for i in range(1, 15))
    items = "Costs\n" + "\n".join(f"{i}. tenant notice and appeal costs claim {i}" for i in range(1, 12))
    junk = "qxz wvk zzt pkq " * 12
    texts = [*prose, table, items, junk, items.replace("\n", " "), "", None, "Claim: tenant lessor; Order: costs; Appeal: lessor; Notice: claim 3"]
    rows = [(i, t, len(t.split()) if t is not None else None, "x") for i, t in enumerate(texts)] + [(500, prose[0], 3, "x"), (501, prose[1], None, "x")]
    df = spark.createDataFrame(rows, "ingest_pos long, text string, word_count int, kind string")
    got = {(r.ingest_pos, r.kind) for r in p5_quality.found(df).collect()}
    assert got == {(80, "table"), (81, "list"), (82, "junk"), (83, "list"), (86, "list"), (500, "bad_count"), (501, "bad_count")}
    assert p5_quality.judged(df).where("ingest_pos = 85").first().bad_count is None
    assert p5_quality.judged(df.limit(0)).count() == 0


def test_the_shape_of_every_text_is_told(spark):
    prose = "The tribunal held that the claim of the tenant was not in time and it is for the lessor to show that it was."
    texts = [f"{prose} {i}" for i in range(40)] + [f"Order: {prose}\n- first item\n- second item 12,500 | 7", "शुल्क: सौ; दिनांक: आज\n- एक\n- दो\n- तीन", "Sl | Amount\n12 | 450.00\n13 | 7,500.00\n14 | 81.25\n15 | 3.00\n16 | 44.10"]
    df = spark.createDataFrame([(i, t, 5) for i, t in enumerate(texts)], "ingest_pos long, text string, word_count int")
    got = {r.ingest_pos: r for r in p5_quality.judged(df).collect()}
    assert (got[40].labels, got[40].bullets) == (1, 2) and got[40].cell_share > 0
    assert got[41].labels == 2 and got[41].bullets == 3 and got[0].p_common_share is not None


def test_caps(spark):
    rng = random.Random(2)
    rows = [(i, None if i % 17 == 0 else "hot" if i % 3 else f"s{i % 40}", rng.choice((None, "a")), 1) for i in range(900)]
    scores = [(i, rng.choice((None, float("nan"), 0.5, 0.25, rng.random()))) for i in range(0, 900) if i % 11] + [(5, 0.9), (5, 0.1)]
    df, sc = spark.createDataFrame(rows, "ingest_pos long, source string, doc_type string, rank int"), spark.createDataFrame(scores, "ingest_pos long, quality double")
    best = {}
    for i, q in scores:
        if q is not None and q == q:
            best[i] = max(best.get(i, -1), q)
    want, cap = set(), Fraction("0.03") * 900 // 1
    groups = {}
    for i, s, d, _ in rows:
        if s is not None:
            groups.setdefault((s, d), []).append(i)
    for ids in groups.values():
        want |= set(sorted(ids, key=lambda i: (i not in best, -best.get(i, 0), i))[int(cap) :])
    assert {r.id for r in p6_cap.over_cap(df, sc).collect()} == want
    assert {r.id for r in p6_cap.over_cap(df, sc, share=None, max_rows=10**6).collect()} == set()
    assert p6_cap.over_cap(df.limit(0), sc).count() == 0


@pytest.mark.skipif(not os.path.exists(VOCABULARY), reason="no vocabulary")
def test_tokens(spark):
    tiktoken = pytest.importorskip("tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(VOCABULARY, "rb"))}
    plain = tiktoken.Encoding("own", pat_str=p8_tokenize.PRE_TOKEN, mergeable_ranks=ranks, special_tokens={})
    texts = ["", None, "Hello  world\n\n it's 12 o'clock", "<|endoftext|> दो शब्द", " \t ", "😀 a b", "x" * 3000, "end "]
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, ids int")
    got = {r.doc_id: r.ids for r in p8_tokenize.encode_corpus(df).collect()}
    enc = p8_tokenize.encoder(VOCABULARY)
    for i, t in enumerate(texts):
        assert got[i] == (plain.encode_ordinary(t) if t else [])
        assert enc.decode(got[i]) == (t or "")
    assert p8_tokenize.encode_corpus(df.limit(0)).count() == 0


@pytest.mark.parametrize("most", [20_000, 3])
def test_leaks(spark, most):
    rng = random.Random(4)
    word = lambda: f"w{rng.randint(0, 60)}"
    items = [(i, " ".join(word() for _ in range(rng.randint(5, 60)))) for i in range(12)] + [(50, None), (51, "")]
    docs = []
    for d in range(80):
        w = [word() for _ in range(rng.randint(0, 80))]
        if d % 3 == 0:
            src = terms(items[rng.randrange(12)][1])
            lo = rng.randrange(len(src))
            w[5:5] = src[lo : lo + rng.randint(8, 20)]
        docs.append((d, ", ".join(w).upper(), "x"))
    docs += [(200, None, "x"), (201, "", "x")]
    runs = lambda t: {tuple(terms(t)[i : i + 13]) for i in range(len(terms(t)) - 12)}
    want = {(d, i) for d, t, _ in docs for i, u in items if t and u and runs(t) & runs(u)}
    df, it = spark.createDataFrame(docs, "doc_id long, text string, item_id string"), spark.createDataFrame(items, "item_id long, text string")
    got = [(r.doc_id, r.item_id) for r in p9_leaks.find_leaks(df, it, max_items=most).collect()]
    assert want and len(got) == len(set(got)) and set(got) == want
    assert p9_leaks.find_leaks(df.limit(0), it).count() == 0 and p9_leaks.find_leaks(df, it.limit(0)).count() == 0


def test_a_kind_without_labels_finds_nothing():
    register = p10_personal.Register([("Korira", "given")])
    model = p10_personal.Model(register).fit(["No person here."])
    assert model.untrained == list(p10_personal.KINDS) and model.find(["Write to a.b@c.example or 5555512345.", None]) == [[], []]
    texts = [f"Write to k{i}@post.example at once. Interest @{i % 9}% is due." for i in range(80)]
    model = p10_personal.Model(register).fit(texts)
    assert "email" not in model.untrained and model.find(["Ask z.q@chambers.example, interest @7% on top."]) == [[(4, 24, "email")]]


def test_trees_learn():
    import numpy as np

    x = np.random.RandomState(0).rand(600, 3)
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    assert ((Trees().fit(x[:400], y[:400]).predict(x[400:]) > 0.5) == y[400:]).mean() > 0.9


def test_personal(spark):
    rng = random.Random(3)
    given_, sur = [f"{a}{b}" for a in ("Kor", "Bel", "Vim", "Tar") for b in ("ira", "eth", "osh")], [f"{a}{b}" for a in ("Nar", "Wes", "Jor", "Hal") for b in ("yath", "adan", "illa")]
    register = spark.createDataFrame([(g, "given") for g in given_[:-2]] + [(s, "surname") for s in sur[:-2]], "name_part string, kind string")
    docs, want = [], set()
    for d in range(160):
        name, phone, card = f"{rng.choice(given_)} {rng.choice(sur)}", f"+91 55{rng.randint(100, 999)} {rng.randint(10000, 99999)}", f"{rng.randint(1000, 9999)} XXXX {rng.randint(1000, 9999)}"
        house, mail = f"House No. {rng.randint(1, 99)}/{rng.randint(1, 9)}, Canal Road, Edinaur", f"k{d}@post.example"
        text = f"The filing number 2018{rng.randint(10**7, 10**8 - 1)} was allotted.\nAccording to advocate {name}, section 12 of the Land Taking Settlement Act 1947 governs.\nContact: {phone}\nPAN: {card}\nAddress: {house}\nPlease reply to {mail} soon."
        docs.append((d, text, "x"))
        want |= {(d, k, text.index(v) + 1) for k, v in (("name", name), ("phone", phone), ("id_number", card), ("address", house), ("email", mail))}
    docs += [(900, None, "x"), (901, "", "x"), (902, "No person here.", "x")]
    df = spark.createDataFrame(docs, "doc_id long, text string, kind string")
    got = {(r.doc_id, r.kind, r.start_at) for r in p10_personal.find_personal(df, register).collect()}
    assert len(want & got) >= 0.97 * len(want) and len(got - want) <= 0.03 * len(want)
    red = {r.doc_id: r.redacted for r in p10_personal.redact(df, register).collect()}
    assert red[900] is None and red[901] == "" and red[902] == "No person here."
    assert "[EMAIL]" in red[0] and "[PHONE]" in red[0] and "filing number 2018" in red[0]
    assert p10_personal.find_personal(df.limit(0), register).count() == 0
