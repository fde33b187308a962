"""Operators on single texts: token counts, byte-level BPE, media, licences and chat."""

import base64
import hashlib
import json
import zlib

import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import public_tokenizers as P
from docweave.llm import byte_bpe, chat_format, license_scan, media_ts, pretokens, token_counts

JSON, RANKS = P.path("byte_bpe_50k.json"), P.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def tik():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_token_counts(spark, odd, none):
    lib = Tokenizer.from_file(JSON)
    want = [(r.doc_id, len((r.text or "").encode()), n := len(lib.encode(r.text or "", add_special_tokens=False).ids), n > 1024) for r in odd.collect()]
    assert rows(token_counts.count_tokens(odd, JSON, P.PATTERN)) == sorted(want, key=str)
    assert token_counts.count_tokens(none, JSON, P.PATTERN).count() == 0


def test_summaries_are_bounded():
    from collections import Counter

    cut = token_counts._cut(Counter({"a": 9, "b": 5, "c": 2, "d": 1}), 2)
    assert cut == {"a": 7, "b": 3}


def test_bpe(spark, odd, none, tik):
    want = []
    for r in odd.collect():
        ids = b"".join(i.to_bytes(4, "little") for i in tik.encode_ordinary(r.text or ""))
        want.append((r.doc_id, len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest()))
    assert rows(byte_bpe.round_trip(odd, RANKS, P.PATTERN, JSON)) == sorted(want, key=str)
    assert byte_bpe.round_trip(none, RANKS, P.PATTERN, JSON).count() == 0
    coded = byte_bpe.encode(odd, RANKS, P.PATTERN, JSON)
    back = {(r[0], bytes(r[1])) for r in byte_bpe.decode(coded, RANKS).collect()}
    assert back == {(r.doc_id, (r.text or "").encode()) for r in odd.collect()}
    checked = byte_bpe.encode_checked(odd, RANKS, P.PATTERN, JSON).where("doc_id = 16").first()
    assert list(checked["ids"]) == tik.encode_ordinary("don't   stop  ")


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60))
def test_bpe_like_tiktoken(text):
    ranks = byte_bpe.coder(RANKS)
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks.ranks, special_tokens={})
    pieces = pretokens.Splitter(P.PATTERN, JSON)(text)
    assert "".join(pieces) == text
    assert [i for p in pieces for i in ranks.encode_piece(p.encode())] == enc.encode_ordinary(text)


@pytest.mark.parametrize("name", ["byte_bpe_50k.tiktoken", "byte_bpe_multi_50k.tiktoken"])
def test_bpe_of_single_pieces(name):
    bpe = byte_bpe.coder(P.path(name))
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.ranks, special_tokens={})
    for piece in ["a" * 3000, "ab" * 500, " thethethe" * 50, "=" * 777, "éè" * 99, "0123456789" * 30]:
        assert bpe.encode_piece(piece.encode()) == enc._encode_single_piece(piece.encode())


def test_new_letters_split_like_the_library():
    split = pretokens.Splitter(P.PATTERN, JSON)
    lib = Tokenizer.from_file(JSON).pre_tokenizer
    for code in (0x558, 0x88F, 0x1C89, 0xA7CE, 0x105C0, 0x323B0, 0x3FFFD, 0xE0041, 0x1E030):
        text = f"a{chr(code)}1 {chr(code)} b"
        assert len(split(text)) == len(lib.pre_tokenize_str(text)), hex(code)


def test_media(spark, odd, none):
    got = {(r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in media_ts.digest(media_ts.store(odd)).collect()}
    want = set()
    for r in odd.collect():
        raw = (r.text or "").encode()
        full = raw + b"\xff" * (-len(raw) % 576 if raw else 576)
        want.add((r.doc_id, len(raw), len(full), hashlib.sha256(full).hexdigest(), zlib.crc32(full[-32:])))
    assert got == want
    assert media_ts.digest(media_ts.store(none)).count() == 0
    unit = media_ts.index(media_ts.store(odd.where("doc_id = 8"))).first()
    assert [u["pts"] for u in unit["units"]] == [i * 3600 for i in range(len(unit["units"]))] and all(u["random_access"] for u in unit["units"])


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 40_000))
def test_mux_round_trip(n):
    data = bytes(i * 7 % 251 for i in range(n))
    found = media_ts.demux(media_ts.mux(data))
    assert found.payload == data and found.counter_errors == 0 and found.starts == list(range(0, n, media_ts.UNIT))


def test_broken_streams():
    good = media_ts.mux(bytes(30_000))
    lost = good[: 188 * 5] + good[188 * 6 :]
    with pytest.raises(ValueError):
        media_ts.demux(good[:-1])
    with pytest.raises(ValueError):
        media_ts.demux(b"\0" + good[1:])
    with pytest.raises(ValueError):
        media_ts.demux(good[:20] + b"\x01" + good[21:])  # the checksum of a table is off
    with pytest.raises(ValueError):
        media_ts.demux(lost)  # a unit has lost a packet
    swapped = bytearray(good)
    swapped[188 * 4 + 3] ^= 1
    assert media_ts.demux(bytes(swapped)).counter_errors > 0
    assert media_ts.crc32_mpeg(b"123456789") == 0x0376E6E7


def test_licences(spark, odd, none):
    mit = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:\n\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.\n"
    cases = [(1, "x. Released under the MIT License. y\nLicensed under CC BY-NC 4.0."), (2, mit), (3, "Licensed under the Apache License, Version 2.0.\nLicensed under the Apache License, Version 2.0."), (4, "not the MIT license here"), (5, None)]
    got = {r.doc_id: tuple(r)[1:] for r in license_scan.scan(spark.createDataFrame(cases, "doc_id long, text string")).collect()}
    assert got[1] == (2, "mit-1 ccbync-1", "MIT,CC-BY-NC-4.0", 0)
    assert got[2] == (2, "mit-2 mit-3", "", 2)
    assert got[3] == (2, "apache-1 apache-1", "Apache-2.0", 0)
    assert got[4] == (0, "", "", 0) and got[5] == (0, "", "", 0)
    assert license_scan.scan(odd).count() == odd.count() and license_scan.scan(none).count() == 0
    plan = license_scan.scan(odd)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Exchange" not in plan


APACHE = """Copyright 2020 Some One

Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at{}http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions and
limitations under the License."""
MIT = """MIT License

Copyright (c) 2020 Some One

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM,
OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE
SOFTWARE."""
BSD = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.

3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission."""
GPL = """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version.

This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
GNU General Public License for more details.

You should have received a copy of the GNU General Public License
along with this program.  If not, see <https://www.gnu.org/licenses/>."""
MPL = """This Source Code Form is subject to the terms of the Mozilla Public
License, v. 2.0. If a copy of the MPL was not distributed with this
file, You can obtain one at https://mozilla.org/MPL/2.0/."""


ISC = """Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH
REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND
FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT,
INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM
LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR
OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR
PERFORMANCE OF THIS SOFTWARE."""
DISCLAIMER = """

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS"
AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE
FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL
DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR
SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER
CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY,
OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE
OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
LGPL = """This library is free software; you can redistribute it and/or
modify it under the terms of the GNU Lesser General Public
License as published by the Free Software Foundation; either
version 2.1 of the License, or (at your option) any later version.

This library is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the GNU
Lesser General Public License for more details.

You should have received a copy of the GNU Lesser General Public
License along with this library; if not, write to the Free Software
Foundation, Inc."""
ZLIB = """This software is provided 'as-is', without any express or implied
warranty.  In no event will the authors be held liable for any damages
arising from the use of this software.

Permission is granted to anyone to use this software for any purpose,
including commercial applications, and to alter it and redistribute it
freely, subject to the following restrictions:"""
EPL = """This program and the accompanying materials are made available under the
terms of the Eclipse Public License 2.0 which is available at
https://www.eclipse.org/legal/epl-2.0/"""
BOOST = """Distributed under the Boost Software License, Version 1.0.
(See accompanying file LICENSE_1_0.txt or copy at
https://www.boost.org/LICENSE_1_0.txt)"""
UNLICENSE = """This is free and unencumbered software released into the public domain.

Anyone is free to copy, modify, publish, use, compile, sell, or
distribute this software, either in source code form or as a compiled
binary, for any purpose, commercial or non-commercial, and by any
means."""


def test_all_sentences_can_match(spark, monkeypatch):
    """Each known sentence, laid out as prose, is found; what could never be found is an error."""
    cases = [(f"{k} {n}", f"Before. {s[0].upper()}{s[1:]}.\n\nAfter.") for k, many in license_scan.SENTENCES.items() for n, s in enumerate(many)]
    got = {r.doc_id: r.sentence_ids for r in license_scan.scan(spark.createDataFrame(cases, "doc_id string, text string")).collect()}
    assert got == {i: i.split()[0] for i, _ in cases}
    assert license_scan.unreachable() == []
    monkeypatch.setitem(license_scan.SENTENCES, "odd-1", ["Not in, normal form", "mit license"])
    monkeypatch.setattr(license_scan, "RULES", (*license_scan.RULES, ("X", ("none-1",)), ("Y", ("mit-1", "cc0-1"))))
    assert set(license_scan.unreachable()) == {"Not in, normal form", "mit license", "none-1", "mit-1 cc0-1"}


def test_wrapped_licences(spark):
    """Full headers as they are laid out in files: wrapped, in comments, with Windows line ends, with an address in the line."""
    headers = {"Apache-2.0": APACHE.format("\n\n    "), "MIT": MIT, "BSD-3-Clause": BSD, "GPL-3.0-or-later": GPL, "MPL-2.0": MPL, "ISC": ISC, "LGPL-2.1-or-later": LGPL, "Zlib": ZLIB, "EPL-2.0": EPL, "BSL-1.0": BOOST, "Unlicense": UNLICENSE}
    headers |= {"AGPL-3.0-or-later": GPL.replace("GNU General", "GNU Affero General").replace("GNU\nGeneral", "GNU\nAffero General"), "0BSD": ISC.replace(", provided that the above\ncopyright notice and this permission notice appear in all copies", "")}
    layouts = [lambda t: t, lambda t: t.replace("\n", "\r\n"), *(lambda t, m=m: "".join(f"{m} {x}".rstrip() + "\n" for x in t.split("\n")) for m in ("#", "//", " *", "--", ";;"))]
    cases = [(f"{name} {i}", layout(text)) for name, text in headers.items() for i, layout in enumerate(layouts)]
    cases += [("BSD-3-Clause whole", BSD + DISCLAIMER), ("BSD-2-Clause whole", BSD.partition("\n\n3. ")[0] + DISCLAIMER), ("BSD-3-Clause whole in comments", "".join(f"# {x}".rstrip() + "\n" for x in (BSD + DISCLAIMER).split("\n")))]
    cases += [("Apache-2.0 inline", APACHE.format(" ")), ("Apache-2.0 box", "/*\n" + "\n".join(f" * {x:75} *" for x in APACHE.format(" ").split("\n")) + "\n */")]
    got = {r.doc_id: (r.licenses, r.n_parts) for r in license_scan.scan(spark.createDataFrame(cases, "doc_id string, text string")).collect()}
    assert got == {i: (i.split()[0], 0) for i, _ in cases}
    parted = "Licensed under the\n\nMIT License now.\nthe\nMIT license\nx y Permission to use"
    assert tuple(license_scan.scan(spark.createDataFrame([(1, parted)], "doc_id long, text string")).first())[1:] == (1, "mit-1", "MIT", 0)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "\\", "<", "[", "s>", "INST]", "/", " ", "x", "[ROLE]", "<\\s>"]), max_size=12).map("".join))
def test_escape(text):
    safe = chat_format.escape(text)
    assert chat_format._control.search(safe) is None and chat_format.unescape(safe) == text
    for role in ("user", "assistant", "system", "tool", text):
        piece, a, b = chat_format.format_turn(role, text)
        assert list(chat_format.read_turns(piece * 2)) == [(role, text, role == "assistant")] * 2
        assert chat_format.unescape(piece[a:b]) == (text if role == "assistant" else "")


def test_layouts(spark):
    records = [
        {"messages": [{"role": "system", "content": "s"}, {"role": "user", "content": "u"}, {"role": "assistant", "content": "a"}]},
        {"conversations": [{"from": "human", "value": "u"}, {"from": "gpt", "value": "a"}], "id": "7"},
        {"instruction": "do", "input": "this", "output": "done"},
        {"instruction": "do", "input": "", "output": "done"},
        {"instruction": "do", "output": "done"},
        {"prompt": "p", "completion": "c"},
        {"system": "s", "prompt": "p", "response": "r"},
        {"question": "q", "answer": None},
        {"messages": []},
        {"role": "user", "text": None, "extra": {"deep": [1]}},
    ]
    df = spark.createDataFrame([(i, json.dumps(r)) for i, r in enumerate(records)], "id long, record string")
    got = {}
    for r in chat_format.to_turns(df, "record", ["id"]).orderBy("id", "seq").collect():
        got.setdefault(r["id"], []).append((r["role"], r["text"]))
    u, a, s = "user", "assistant", "system"
    assert got == {0: [(s, "s"), (u, "u"), (a, "a")], 1: [(u, "u"), (a, "a")], 2: [(u, "do\n\nthis"), (a, "done")], 3: [(u, "do"), (a, "done")], 4: [(u, "do"), (a, "done")], 5: [(u, "p"), (a, "c")], 6: [(s, "s"), (u, "p"), (a, "r")], 7: [(u, "q"), (a, "")], 9: [(u, "")]}
    odd = spark.createDataFrame([(0, '{"nothing": 1}'), (1, None)], "id long, record string")
    with pytest.raises(Exception, match="no mapping"):
        chat_format.to_turns(odd, "record", ["id"]).collect()
    assert chat_format.to_turns(odd, "record", ["id"], unknown="null").where("role is null").count() == 2


def test_conversations(spark):
    rows_ = [(1, 2, "assistant", "b </s>"), (1, 0, "system", None), (1, 1, "user", "[INST]"), (2, 0, "assistant", "x"), (2, 0, "assistant", "x"), (2, None, "tool", "t"), (None, 0, "user", "n"), (3, 0, None, "no role")]
    turns = spark.createDataFrame(rows_, "conv_id long, turn long, role string, text string").withColumn("seq", F.lit(0))
    got = {r.conv_id: r for r in chat_format.digest_conversations(turns).collect()}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert (got[1].n_turns, got[1].turns_sha256, got[1].loss_chars, got[1].loss_sha256) == (3, sha("system\n\nuser\n[INST]\nassistant\nb </s>\n"), 6, sha("b </s>"))
    assert (got[2].n_turns, got[2].turns_sha256, got[2].loss_sha256) == (3, sha("tool\nt\nassistant\nx\nassistant\nx\n"), sha("xx"))
    assert got[3].turns_sha256 == sha("\nno role\n") and got[None].n_turns == 1
    full = {r.conv_id: r for r in chat_format.format_conversations(turns).collect()}
    for k, r in full.items():
        assert len(r.formatted) == got[k].formatted_chars
        assert "".join(chat_format.unescape(r.formatted[m["begin"] : m["end"]]) for m in r.loss) == "".join(t for _, t, on in chat_format.read_turns(r.formatted) if on)
    assert chat_format.digest_conversations(turns.where("false")).count() == 0
