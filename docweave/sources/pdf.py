"""Text of PDF files by the standard library: objects, object streams, Flate streams, fonts with ToUnicode maps, text operators.

Covers files whose text is text (not scans) in fonts with a ToUnicode map or a Latin encoding.  Encrypted files and other stream filters are errors.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass

_SPACE = b"\0\t\n\f\r "
_DELIMITERS = _SPACE + b"()<>[]{}/%"
_ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}


class PdfError(ValueError):
    pass


class Name(str):
    """A name object, without its slash."""


class Operator(bytes):
    """A bare word: an operator of a content stream, or a keyword."""


@dataclass(frozen=True)
class Ref:
    number: int


class Reader:
    """Objects out of bytes, one after the other."""

    def __init__(self, data: bytes, at: int = 0):
        self.data, self.at = data, at

    def skip(self) -> None:
        d = self.data
        while self.at < len(d):
            if d[self.at] in _SPACE:
                self.at += 1
            elif d[self.at] == 0x25:  # a comment
                end = re.compile(rb"[\r\n]").search(d, self.at)
                self.at = end.start() if end else len(d)
            else:
                return

    def more(self) -> bool:
        self.skip()
        return self.at < len(self.data)

    def take(self):
        """The next object; closing brackets come as operators."""
        self.skip()
        d, at = self.data, self.at
        two = d[at : at + 2]
        if two == b"<<":
            self.at += 2
            return self._dict()
        if two == b">>":
            self.at += 2
            return Operator(two)
        head = d[at : at + 1]
        if head == b"(":
            return self._string()
        if head == b"<":
            end = d.index(b">", at)
            digits = re.sub(rb"[^0-9A-Fa-f]", b"", d[at + 1 : end])
            self.at = end + 1
            return bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())
        if head == b"[":
            self.at += 1
            return self._until(b"]")
        if head and head in b"]{})":
            self.at += 1
            return Operator(head)
        end = at + 1
        while end < len(d) and d[end] not in _DELIMITERS:
            end += 1
        self.at = end
        word = d[at:end]
        if head == b"/":
            return Name(re.sub(rb"#([0-9A-Fa-f]{2})", lambda m: bytes.fromhex(m[1].decode()), word[1:]).decode("latin-1"))
        try:
            return int(word)
        except ValueError:
            try:
                return float(word)
            except ValueError:
                return {b"true": True, b"false": False, b"null": None}.get(word, Operator(word))

    def _until(self, close: bytes) -> list:
        out: list = []
        while self.more():
            x = self.take()
            if isinstance(x, Operator):
                if x == close:
                    return out
                if x == b"R" and len(out) > 1:
                    out[-2:] = [Ref(out[-2])]
                    continue
            out.append(x)
        raise PdfError(f"no closing {close!r}")

    def _dict(self) -> dict:
        flat = self._until(b">>")
        return dict(zip(flat[::2], flat[1::2], strict=False))

    def _string(self) -> bytes:
        d, out, depth = self.data, bytearray(), 1
        self.at += 1
        while self.at < len(d):
            c = d[self.at : self.at + 1]
            self.at += 1
            if c == b"\\":
                octal = re.compile(rb"[0-7]{1,3}").match(d, self.at)
                if octal:
                    out.append(int(octal[0], 8) & 255)
                    self.at = octal.end()
                    continue
                c = d[self.at : self.at + 1]
                self.at += 1
                if c == b"\r" and d[self.at : self.at + 1] == b"\n":
                    self.at += 1
                out += b"" if c in (b"\r", b"\n") else _ESCAPES.get(c, c)
                continue
            depth += (c == b"(") - (c == b")")
            if not depth:
                return bytes(out)
            out += c
        raise PdfError("a string without end")


class Document:
    """The objects of a file.  They are found by their headers, so a damaged cross-reference table does no harm."""

    def __init__(self, data: bytes):
        if not data.lstrip()[:5] == b"%PDF-":
            raise PdfError("not a PDF file")
        self.objects: dict[int, object] = {}
        self.streams: dict[int, bytes] = {}
        at = 0
        while m := re.compile(rb"(\d+)\s+\d+\s+obj\b").search(data, at):
            at = self._object(data, int(m[1]), m.end())
        if re.search(rb"/Encrypt\s+\d+", data):
            raise PdfError("encrypted")
        for number in [n for n, x in self.objects.items() if isinstance(x, dict) and x.get("Type") == "ObjStm"]:
            self._packed(number)

    def _object(self, data: bytes, number: int, at: int) -> int:
        reader = Reader(data, at)
        try:
            value = reader.take()
        except (PdfError, ValueError):
            return at
        self.objects[number] = value
        begin = re.compile(rb"\s*stream\r?\n").match(data, reader.at)
        if not (isinstance(value, dict) and begin):
            return reader.at
        length = value.get("Length")
        end = begin.end() + length if isinstance(length, int) else -1
        if end < 0 or not re.compile(rb"\s*endstream").match(data, end):
            end = data.find(b"endstream", begin.end())
        if end < 0:
            raise PdfError("a stream without end")
        self.streams[number] = data[begin.end() : end]
        return end

    def get(self, x):
        for _ in range(20):
            if not isinstance(x, Ref):
                return x
            x = self.objects.get(x.number)
        raise PdfError("a circle of references")

    def stream(self, x) -> bytes:
        """The decoded stream of a reference."""
        if not isinstance(x, Ref) or x.number not in self.streams:
            return b""
        filters = self.get((self.get(x) or {}).get("Filter")) or []
        raw = self.streams[x.number]
        for f in filters if isinstance(filters, list) else [filters]:
            if self.get(f) != "FlateDecode":
                raise PdfError(f"stream filter {f}")
            raw = zlib.decompressobj().decompress(raw)
        return raw

    def _packed(self, number: int) -> None:
        head, data = self.objects[number], self.stream(Ref(number))
        reader = Reader(data)
        places = [(reader.take(), reader.take()) for _ in range(self.get(head["N"]))]
        for n, at in places:
            self.objects.setdefault(n, Reader(data, self.get(head["First"]) + at).take())

    def pages(self) -> list[dict]:
        """Pages in order, each with the resources that it inherits."""
        root = next((x for x in self.objects.values() if isinstance(x, dict) and x.get("Type") == "Catalog"), None)
        out: list[dict] = []

        def walk(node, resources, depth: int) -> None:
            node = self.get(node)
            if not isinstance(node, dict) or depth > 60:
                return
            resources = node.get("Resources", resources)
            if "Kids" in node:
                for kid in self.get(node["Kids"]) or []:
                    walk(kid, resources, depth + 1)
            else:
                out.append(node | {"Resources": resources})

        walk((root or {}).get("Pages"), {}, 0)
        return out


def _code_map(data: bytes) -> tuple[int, dict[int, str]]:
    """Bytes of a code and the characters of codes, from a ToUnicode map."""
    reader, stack, width, out = Reader(data), [], 1, {}
    text = lambda b: b.decode("utf-16-be", "replace")
    while reader.more():
        x = reader.take()
        if not isinstance(x, Operator):
            stack.append(x)
            continue
        if x == b"endcodespacerange":
            width = max([len(b) for b in stack if isinstance(b, bytes)], default=1)
        elif x == b"endbfchar":
            out |= {int.from_bytes(a, "big"): text(b) for a, b in zip(stack[::2], stack[1::2], strict=False)}
        elif x == b"endbfrange":
            for lo, hi, to in zip(stack[::3], stack[1::3], stack[2::3], strict=False):
                first = int.from_bytes(lo, "big")
                for i in range(min(int.from_bytes(hi, "big") - first + 1, 65_536)):
                    out[first + i] = text(to[i]) if isinstance(to, list) and i < len(to) else text((int.from_bytes(to, "big") + i).to_bytes(len(to), "big")) if isinstance(to, bytes) else ""
        stack = []
    return width, out


class _Font:
    def __init__(self, doc: Document, font: dict):
        to = font.get("ToUnicode")
        self.width, self.map = _code_map(doc.stream(to)) if to else (1, None)

    def text(self, raw: bytes) -> str:
        if self.map is None:
            return raw.decode("cp1252", "replace")
        codes = (int.from_bytes(raw[i : i + self.width], "big") for i in range(0, len(raw), self.width))
        return "".join(self.map.get(c, "\N{REPLACEMENT CHARACTER}") for c in codes)


def _page_text(doc: Document, page: dict) -> str:
    contents = doc.get(page.get("Contents"))
    parts = contents if isinstance(contents, list) else [page.get("Contents")]
    reader = Reader(b"\n".join(doc.stream(p) for p in parts))
    known = doc.get((doc.get(page["Resources"]) or {}).get("Font")) or {}
    fonts = {k: _Font(doc, doc.get(v) or {}) for k, v in known.items()}
    font, plain = None, _Font(doc, {})
    lines: list[str] = [""]
    stack: list = []

    def show(raw) -> None:
        if isinstance(raw, bytes):
            lines[-1] += (font or plain).text(raw)

    def turn() -> None:
        if lines[-1]:
            lines.append("")

    while reader.more():
        x = reader.take()
        if not isinstance(x, Operator):
            stack.append(x)
            continue
        if x == b"Tf" and len(stack) > 1:
            font = fonts.get(stack[-2])
        elif x in (b"T*", b"ET") or x in (b"Td", b"TD") and len(stack) > 1 and stack[-1] != 0 or x == b"Tm":
            turn()
        elif x == b"Tj" and stack:
            show(stack[-1])
        elif x in (b"'", b'"') and stack:
            turn()
            show(stack[-1])
        elif x == b"TJ" and stack and isinstance(stack[-1], list):
            for part in stack[-1]:
                if isinstance(part, int | float) and part < -200 and not lines[-1].endswith(" "):
                    lines[-1] += " "  # a gap as wide as a blank
                show(part)
        stack = []
    return "\n".join(x for x in lines if x.strip())


def text_of(data: bytes) -> str:
    """The text of all pages, with an empty line between pages."""
    doc = Document(data)
    return "\n\n".join(_page_text(doc, p) for p in doc.pages())
