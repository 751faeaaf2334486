import zlib

import pytest

from lexloom.sources import documents as sources
from lexloom.sources.pdf import Pdf, text_layer


def stream(data, extra=b"", flate=False):
    data = zlib.compress(data) if flate else data
    return b"<< /Length %d %s %s >>\nstream\n%s\nendstream" % (len(data), extra, b"/Filter /FlateDecode" if flate else b"", data)


def pdf(*objects):
    return b"%PDF-1.7\n" + b"".join(b"%d 0 obj\n%s\nendobj\n" % (n, body) for n, body in objects) + b"trailer << /Root 1 0 R >>\n%%EOF"


CMAP = b"1 begincodespacerange <0000> <FFFF> endcodespacerange 1 beginbfchar <0001> <0915> endbfchar 1 beginbfrange <0010> <0012> <0061> endbfrange"
FIRST = b"BT /F1 12 Tf 72 700 Td (Section 1. \\(Rent\\) is d\\165e.) Tj 0 -14 Td [(The ten) 20 (ant) -300 (pays)] TJ T* (caf\\351) Tj ET"
SECOND = b"BT /F2 9 Tf 1 0 0 1 72 700 Tm <00100011> Tj 1 0 0 1 90 700 Tm <0012 0001> Tj 1 0 0 1 72 680 Tm <0010> Tj ET"
FILE = pdf(
    (1, b"<< /Type /Catalog /Pages 2 0 R >>"), (2, b"<< /Type /Pages /Kids [4 0 R 3 0 R 8 0 R] /Count 3 /Resources << /Font << /F1 5 0 R /F2 6 0 R >> >> >>"),
    (3, b"<< /Type /Page /Parent 2 0 R /Contents [10 0 R] >>"), (4, b"<< /Type /Page /Parent 2 0 R /Contents 9 0 R >>"), (5, b"<< /Type /Font /Subtype /Type1 /BaseFont /Times-Roman >>"),
    (6, b"<< /Type /Font /Subtype /Type0 /ToUnicode 7 0 R >>"), (7, stream(CMAP, flate=True)), (9, stream(FIRST)), (10, stream(SECOND, flate=True)),
    (11, stream(b"8 0 << /Type /Page /Parent 2 0 R >>", b"/Type /ObjStm /N 1 /First 4", True)),
)


def test_pages_in_the_order_of_the_tree():
    assert Pdf(FILE).pages() == ["Section 1. (Rent) is due.\nThe tenant pays\ncafé", "ab cक\na", ""]


def test_what_cannot_be_read_raises():
    for content in (b"", b"plain text", FILE + b"/Encrypt 5 0 R", FILE.replace(b"/FlateDecode", b"/DCTDecode")):
        with pytest.raises(ValueError):
            Pdf(content).pages()
    with pytest.raises(ValueError):
        text_layer()(FILE, "image")


def test_files_to_statutes(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(FILE)
    (tmp_path / "b.pdf").write_bytes(b"%PDF-1.4 broken")
    (tmp_path / "c.pdf").write_bytes(b"no pdf")
    (tmp_path / "d.png").write_bytes(b"image")
    files = sources.files(spark, str(tmp_path))
    pages = sources.extract(files, text_layer)
    assert [(r.path.rpartition("/")[2], r.page_num) for r in pages.orderBy("path", "page_num").collect()] == [("a.pdf", 1), ("a.pdf", 2)]
    told = {r.path.rpartition("/")[2]: (r.success, r.text) for r in sources.extract_documents(files, text_layer).collect()}
    assert told["a.pdf"][0] and told["a.pdf"][1].startswith("--- Page 1 ---\nSection 1.") and "--- Page 2 ---" in told["a.pdf"][1]
    assert {k: v[0] for k, v in told.items()} == {"a.pdf": True, "b.pdf": False, "c.pdf": False, "d.png": False}
    manifest = spark.createDataFrame([("a.pdf", "Rent Act", "statute")], "filename string, source string, doc_type string")
    named = pages.selectExpr("regexp_extract(path, '[^/]+$', 0) AS filename", "page_num", "text")
    assert sources.statutes(named, manifest).first().text.startswith("Section 1. (Rent) is due.")
