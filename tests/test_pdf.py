"""The PDF reader on files built here: strings, hex, arrays, maps of codes, packed objects, several pages, damage."""

import zlib

import pytest

from docweave.sources import pdf


def made(content: bytes, font: bytes = b"<< /Type /Font >>", more: dict | None = None, packed: bool = True) -> bytes:
    raw = zlib.compress(content) if packed else content
    kind = b" /Filter /FlateDecode" if packed else b""
    objects = {
        1: b"<< /Type /Catalog /Pages 2 0 R >>",
        2: b"<< /Type /Pages /Kids [3 0 R] /Count 1 >>",
        3: b"<< /Type /Page /Parent 2 0 R /Contents [4 0 R] /Resources << /Font << /F#31 5 0 R >> >> >> % a comment ) >>",
        4: b"<< /Length %d%s >>\nstream\n%s\nendstream" % (len(raw), kind, raw),
        5: font,
    } | (more or {})
    return b"%PDF-1.7\n" + b"\n".join(b"%d 0 obj\n%s\nendobj" % kv for kv in objects.items()) + b"\ntrailer << /Root 1 0 R >>"


def test_strings():
    content = rb"BT /F1 9 Tf (a \(b\) (c) \\ \101\12x) Tj T* <48 65 6C6c6F> Tj 0 -12 Td [(wi) 20 (de) -300 (gap)] TJ (next) ' 1 2 (third) "
    content += b'" 5 0 Td (same line) Tj ET BT (caf\xe9 \x80) Tj ET'
    assert pdf.text_of(made(content)) == "a (b) (c) \\ A\nx\nHello\nwide gap\nnext\nthirdsame line\ncafé €"
    assert pdf.text_of(made(content, packed=False)) == pdf.text_of(made(content))


def test_code_maps():
    codes = b"1 begincodespacerange <0000> <ffff> endcodespacerange 1 beginbfchar <0003> <0020> endbfchar 2 beginbfrange <0010> <0012> <0061> <0020> <0021> [<6f22> <d83dde00>] endbfrange"
    more = {6: b"<< /Length %d >>\nstream\n%s\nendstream" % (len(codes), codes)}
    data = made(b"BT /F1 9 Tf <0010 0011 0003 0012 0020 0021 0099> Tj ET", b"<< /Type /Font /ToUnicode 6 0 R >>", more)
    assert pdf.text_of(data) == "ab c漢😀\N{REPLACEMENT CHARACTER}"


def test_packed_objects_and_page_tree():
    inside = [(2, b"<< /Type /Pages /Kids [7 0 R 8 0 R] /Resources << /Font << /F1 5 0 R >> >> >>"), (7, b"<< /Type /Page /Contents 4 0 R >>"), (8, b"<< /Type /Pages /Kids [7 0 R] >>")]
    head, body = b"", b""
    for n, x in inside:
        head += b"%d %d " % (n, len(body))
        body += x + b" "
    raw = zlib.compress(head + body)
    objects = {
        1: b"<< /Type /Catalog /Pages 2 0 R >>",
        9: b"<< /Type /ObjStm /N 3 /First %d /Length 10 0 R /Filter [/FlateDecode] >>\nstream\n%s\nendstream" % (len(head), raw),
        10: b"%d" % len(raw),
        4: b"<< /Length 99999 >>\nstream\nBT /F1 9 Tf (page) Tj ET\nendstream",
        5: b"<< /Type /Font >>",
    }
    data = b"%PDF-1.7\n" + b"\n".join(b"%d 0 obj %s endobj" % kv for kv in objects.items())
    assert pdf.text_of(data) == "page\n\npage"


@pytest.mark.parametrize("data", [b"", b"no", made(b"BT ET") + b"<< /Encrypt 9 0 R >>", made(b"x").replace(b"/FlateDecode", b"/LZWDecode")])
def test_what_cannot_be_read_is_an_error(data):
    with pytest.raises(ValueError):
        pdf.text_of(data)


def test_broken_files_end():
    whole = made(b"BT /F1 9 Tf (text) Tj ET")
    for n in range(9, len(whole), 7):
        try:
            pdf.text_of(whole[:n])
        except (ValueError, zlib.error):
            pass
