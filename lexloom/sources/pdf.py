"""The text layer of PDF files, page by page, for files whose text is stored as text.

Reads what most writers of such files use: plain and Flate streams, object streams, simple fonts
and fonts with a map to Unicode. Encrypted files and other filters raise, so that a scan can be
handed to an extractor that recognises text.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable

_OBJECT = re.compile(rb"(?<!\d)(\d+)\s+\d+\s+obj\b")
_REFERENCE = re.compile(rb"(\d+)\s+\d+\s+R\b")
_TOKEN = re.compile(rb"\((?:\\[\s\S]|[^\\()]|\((?:\\[\s\S]|[^\\()])*\))*\)|<[0-9A-Fa-f\s]*>|/[^\s/\[\]()<>]*|[-+]?\d*\.?\d+|\[|\]|[A-Za-z'\"*]+|<<|>>")
_ESCAPE = re.compile(rb"\\(?:([0-7]{1,3})|(\r\n|[\s\S]))")
_ESCAPED = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f", b"\n": b"", b"\r": b"", b"\r\n": b""}
#: A gap in a row of strings from which on it parts words, in thousandths of the font's size.
GAP = 200


class Pdf:
    def __init__(self, content: bytes):
        if b"%PDF-" not in content[:1024]:
            raise ValueError("not a PDF")
        if b"/Encrypt" in content:
            raise ValueError("encrypted")
        self.objects: dict[int, tuple[bytes, bytes | None]] = {}
        at = 0
        while m := _OBJECT.search(content, at):
            end = content.find(b"endobj", m.end())
            end = len(content) if end < 0 else end
            stream = content.find(b"stream", m.end(), end)
            if stream >= 0:
                start = stream + 6 + (2 if content[stream + 6 : stream + 8] == b"\r\n" else 1)
                stop = content.find(b"endstream", start)
                stop = len(content) if stop < 0 else stop
                self.objects[int(m[1])] = content[m.end() : stream], content[start:stop]  # the last one of a number holds
                at = stop
            else:
                self.objects[int(m[1])] = content[m.end() : end], None
                at = end
        for head, data in list(self.objects.values()):
            if data is not None and re.search(rb"/Type\s*/ObjStm\b", head):
                self._unpack(head, self.data(head, data))

    def _unpack(self, head: bytes, data: bytes) -> None:
        n, first = (int(re.search(rb"/%s\s+(\d+)" % k, head)[1]) for k in (b"N", b"First"))
        numbers = list(map(int, data[:first].split()[: 2 * n]))
        ends = [*numbers[3::2], len(data) - first]
        for number, start, end in zip(numbers[::2], numbers[1::2], ends):
            self.objects.setdefault(number, (data[first + start : first + end], None))

    @staticmethod
    def data(head: bytes, raw: bytes) -> bytes:
        filters = re.findall(rb"/(\w+Decode)\b", head)
        if filters and filters != [b"FlateDecode"] or b"/Predictor" in head:
            raise ValueError(f"unknown filter: {filters}")
        return zlib.decompressobj().decompress(raw) if filters else raw

    def stream(self, number: int) -> bytes:
        head, raw = self.objects.get(number, (b"", None))
        return self.data(head, raw) if raw is not None else b""

    def value(self, head: bytes, key: bytes) -> bytes:
        """What a dictionary has under a key, references resolved: a dictionary, an array or the rest of the line; empty if it has none."""
        m = re.search(rb"/%s(?![A-Za-z0-9])\s*" % key, head)
        if not m:
            return b""
        rest = head[m.end() :]
        if ref := _REFERENCE.match(rest):
            return self.objects.get(int(ref[1]), (b"", None))[0]
        for opening, closing in ((b"<<", b">>"), (b"[", b"]")):
            if rest.startswith(opening):
                depth, at = 0, 0
                for part in re.finditer(re.escape(opening) + b"|" + re.escape(closing), rest):
                    depth, at = depth + (1 if part[0] == opening else -1), part.end()
                    if not depth:
                        break
                return rest[:at]
        return re.match(rb"[^/>\r\n]*", rest)[0]

    def pages(self) -> list[str]:
        roots = [h for h, _ in self.objects.values() if re.search(rb"/Type\s*/Catalog\b", h)]
        found: list[tuple[bytes, bytes]] = []

        def walk(node: bytes, resources: bytes, depth: int) -> None:
            resources = self.value(node, b"Resources") or resources
            kids = self.value(node, b"Kids")
            if kids and depth < 50:
                for ref in _REFERENCE.finditer(kids):
                    walk(self.objects.get(int(ref[1]), (b"", None))[0], resources, depth + 1)
            elif re.search(rb"/Type\s*/Page\b", node):
                found.append((node, resources))

        for root in roots[-1:]:
            walk(self.value(root, b"Pages"), b"", 0)
        return [self._text(*page) for page in found]

    def _text(self, page: bytes, resources: bytes) -> str:
        m = re.search(rb"/Contents\s*(\[[^\]]*\]|\d+\s+\d+\s+R)", page)
        content = b"\n".join(self.stream(int(ref[1])) for ref in _REFERENCE.finditer(m[1] if m else b""))
        fonts = {k: self._unicode(int(n)) for k, n in re.findall(rb"/([^\s/<>\[\]]+)\s+(\d+)\s+\d+\s+R", self.value(resources, b"Font"))}
        return Show(fonts).run(content)

    def _unicode(self, font: int) -> dict[bytes, str] | None:
        """The characters of a font's codes, if it has a map."""
        m = re.search(rb"/ToUnicode\s+(\d+)", self.objects.get(font, (b"", None))[0])
        if not m:
            return None
        cmap, out = self.stream(int(m[1])), {}
        text = lambda h: bytes.fromhex(h.decode()).decode("utf-16-be", "replace")
        for block in re.findall(rb"beginbfchar(.*?)endbfchar", cmap, re.S):
            out |= {bytes.fromhex(a.decode()): text(b) for a, b in re.findall(rb"<(\w+)>\s*<(\w+)>", block)}
        for block in re.findall(rb"beginbfrange(.*?)endbfrange", cmap, re.S):
            for a, b, to in re.findall(rb"<(\w+)>\s*<(\w+)>\s*<(\w+)>", block):
                first = text(to)
                out |= {(int(a, 16) + i).to_bytes(len(a) // 2): first[:-1] + chr(ord(first[-1]) + i) for i in range(int(b, 16) - int(a, 16) + 1)}
        return out


class Show:
    """Carries out the text operators of a page."""

    def __init__(self, fonts: dict[bytes, dict[bytes, str] | None]):
        self.fonts, self.font, self.out, self.y = fonts, None, [], None

    def run(self, content: bytes) -> str:
        operands: list[bytes] = []
        for m in _TOKEN.finditer(content):
            token = m[0]
            if token[:1].isalpha() or token in (b"'", b'"', b"T*"):
                self._do(token, operands)
                operands = []
            else:
                operands.append(token)
        lines = (re.sub(r"[ \t]+", " ", x).strip() for x in "".join(self.out).split("\n"))
        return "\n".join(x for x in lines if x)

    def _do(self, operator: bytes, operands: list[bytes]) -> None:
        if operator == b"Tf" and len(operands) >= 2:
            self.font = self.fonts.get(operands[-2][1:])
        elif operator in (b"T*", b"'", b'"', b"ET"):
            self.out.append("\n")
        elif operator in (b"Td", b"TD") and len(operands) >= 2:
            self.out.append("\n" if float(operands[-1]) else " ")
        elif operator == b"Tm" and operands:
            self.out.append(" " if operands[-1] == self.y else "\n")
            self.y = operands[-1]
        if operator in (b"Tj", b"TJ", b"'", b'"'):
            for x in operands:
                if x[:1] in b"(<":
                    self.out.append(self._string(x))
                elif operator == b"TJ" and x[:1] not in b"[]" and float(x) < -GAP:
                    self.out.append(" ")

    def _string(self, token: bytes) -> str:
        if token[:1] == b"<":
            digits = re.sub(rb"\s", b"", token[1:-1])
            raw = bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())
        else:
            raw = _ESCAPE.sub(lambda m: bytes([int(m[1], 8) & 255]) if m[1] else _ESCAPED.get(m[2], m[2]), token[1:-1])
        if not self.font:
            return raw[2:].decode("utf-16-be", "replace") if raw[:2] == b"\xfe\xff" else raw.decode("cp1252", "replace")
        width = max(map(len, self.font))
        return "".join(self.font.get(raw[i : i + width], "") for i in range(0, len(raw), width))


def text_layer() -> Callable[[bytes, str], list[str]]:
    """An extractor for :func:`~lexloom.sources.documents.extract`; it raises for what is no PDF with a text layer it can read."""

    def pages(content: bytes, kind: str) -> list[str]:
        if kind != "pdf":
            raise ValueError(f"no PDF: {kind}")
        return Pdf(content).pages()

    return pages
