"""Licence recognition by sentences and ordered rules, with SQL functions only.

A text is put in normal form (lower case, words only) with a mark where a sentence may begin or end: at punctuation, at the ends of lines and
around web addresses.  A known sentence is found where it stands between two marks; inside it may run over the ends of lines, ";" and ":", so a
hard-wrapped or commented licence is found like one on a single line, but not over other punctuation or a blank line.  Where known sentences
overlap, the first counts, of those the longest.  The identifiers found, in order, are matched against licence rules, longest first; what a
rule has matched is used up.  Identifiers that no rule takes are reported as parts of a licence.

Defined results: a null or empty text has none; a sentence counts each time it occurs; repeated rows give
repeated rows; an empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Licence sentences in normal form, by identifier.
SENTENCES = {
    "apache-1": ["licensed under the apache license version 2.0", "licensed under the apache license version 2.0 the license"],
    "apache-2": ["you may not use this file except in compliance with the license"],
    "apache-3": ["you may obtain a copy of the license at"],
    "apache-4": ["unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied"],
    "apache-5": ["see the license for the specific language governing permissions and limitations under the license"],
    "mit-1": ["released under the mit license", "licensed under the mit license", "this project is licensed under the mit license", "the mit license", "mit license"],
    "mit-2": ["permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions"],
    "mit-3": ["the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"],
    "mit-4": ["the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement"],
    "mit-5": ["in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software"],
    "gpl3-1": ["this work is licensed under the gnu general public license version 3", "licensed under the gnu general public license version 3", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version"],
    "gpl2-1": ["this work is licensed under the gnu general public license version 2", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version"],
    "gpl-2": ["this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose"],
    "gpl-3": ["see the gnu general public license for more details"],
    "gpl-4": ["you should have received a copy of the gnu general public license along with this program"],
    "bsd-1": ["redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"],
    "bsd-2": ["redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"],
    "bsd-3": ["redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"],
    "bsd-4": ["neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"],
    "isc-1": ["permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"],
    "0bsd-1": ["permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"],
    "isc-2": ["the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness"],
    "isc-3": ["in no event shall the author be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this software"],
    "bsd-5": ["this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed"],
    "bsd-6": ["in no event shall the copyright holder or contributors be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services loss of use data or profits or business interruption however caused and on any theory of liability whether in contract strict liability or tort including negligence or otherwise arising in any way out of the use of this software even if advised of the possibility of such damage"],
    "unlicense-1": ["this is free and unencumbered software released into the public domain"],
    "unlicense-2": ["anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non-commercial and by any means"],
    "mpl-1": ["this source code form is subject to the terms of the mozilla public license v. 2.0"],
    "mpl-2": ["if a copy of the mpl was not distributed with this file you can obtain one at"],
    "lgpl3-1": ["this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version", "this program is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version"],
    "lgpl21-1": ["this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2.1 of the license or at your option any later version"],
    "lgpl-2": ["this library is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose"],
    "lgpl-3": ["see the gnu lesser general public license for more details"],
    "lgpl-4": ["you should have received a copy of the gnu lesser general public license along with this library", "you should have received a copy of the gnu lesser general public license along with this program"],
    "agpl3-1": ["this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version"],
    "agpl-3": ["see the gnu affero general public license for more details"],
    "agpl-4": ["you should have received a copy of the gnu affero general public license along with this program"],
    "epl2-1": ["this program and the accompanying materials are made available under the terms of the eclipse public license 2.0 which is available at", "this program and the accompanying materials are made available under the terms of the eclipse public license v. 2.0 which is available at"],
    "bsl-1": ["distributed under the boost software license version 1.0"],
    "zlib-1": ["this software is provided as-is without any express or implied warranty"],
    "zlib-2": ["in no event will the authors be held liable for any damages arising from the use of this software"],
    "zlib-3": ["permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions"],
    "ccbync-1": ["licensed under cc by-nc 4.0", "this work is licensed under a creative commons attribution-noncommercial 4.0 international license"],
    "ccby-1": ["licensed under cc by 4.0", "this work is licensed under a creative commons attribution 4.0 international license"],
    "ccbysa-1": ["licensed under cc by-sa 4.0", "this work is licensed under a creative commons attribution-sharealike 4.0 international license"],
    "cc0-1": ["released under cc0 1.0", "this work is dedicated to the public domain under cc0 1.0"],
}
# Rules in order, each a licence and its sentences.
RULES = (
    ("Apache-2.0", ("apache-1", "apache-2", "apache-3", "apache-4", "apache-5")),
    ("MIT", ("mit-1", "mit-2", "mit-3", "mit-4", "mit-5")),
    ("MIT", ("mit-2", "mit-3", "mit-4", "mit-5")),
    ("GPL-3.0-or-later", ("gpl3-1", "gpl-2", "gpl-3", "gpl-4")),
    ("GPL-2.0-or-later", ("gpl2-1", "gpl-2", "gpl-3", "gpl-4")),
    ("LGPL-3.0-or-later", ("lgpl3-1", "lgpl-2", "lgpl-3", "lgpl-4")),
    ("LGPL-3.0-or-later", ("lgpl3-1", "gpl-2", "lgpl-3", "lgpl-4")),
    ("LGPL-2.1-or-later", ("lgpl21-1", "lgpl-2", "lgpl-3", "lgpl-4")),
    ("AGPL-3.0-or-later", ("agpl3-1", "gpl-2", "agpl-3", "agpl-4")),
    ("BSD-3-Clause", ("bsd-1", "bsd-2", "bsd-3", "bsd-4", "bsd-5", "bsd-6")),
    ("BSD-2-Clause", ("bsd-1", "bsd-2", "bsd-3", "bsd-5", "bsd-6")),
    ("BSD-3-Clause", ("bsd-1", "bsd-2", "bsd-3", "bsd-4")),
    ("BSD-2-Clause", ("bsd-1", "bsd-2", "bsd-3")),
    ("ISC", ("isc-1", "isc-2", "isc-3")),
    ("0BSD", ("0bsd-1", "isc-2", "isc-3")),
    ("Zlib", ("zlib-1", "zlib-2", "zlib-3")),
    ("Unlicense", ("unlicense-1", "unlicense-2")),
    ("MPL-2.0", ("mpl-1", "mpl-2")),
    ("Apache-2.0", ("apache-1",)),
    ("MIT", ("mit-1",)),
    ("GPL-3.0", ("gpl3-1",)),
    ("GPL-2.0", ("gpl2-1",)),
    ("LGPL-3.0", ("lgpl3-1",)),
    ("LGPL-2.1", ("lgpl21-1",)),
    ("AGPL-3.0", ("agpl3-1",)),
    ("EPL-2.0", ("epl2-1",)),
    ("BSL-1.0", ("bsl-1",)),
    ("ISC", ("isc-1",)),
    ("Unlicense", ("unlicense-1",)),
    ("MPL-2.0", ("mpl-1",)),
    ("CC-BY-NC-4.0", ("ccbync-1",)),
    ("CC-BY-4.0", ("ccby-1",)),
    ("CC-BY-SA-4.0", ("ccbysa-1",)),
    ("CC0-1.0", ("cc0-1",)),
)


def marked(text: Column) -> Column:
    """A text in normal form: lower case, words and the signs . + - inside them, single spaces; a line feed where a sentence may end, a form feed where it must."""
    out = F.regexp_replace(F.lower(F.translate(F.coalesce(text, F.lit("")), "\f", " ")), r"\b(?:https?|ftp)://\S+", "\f")
    out = F.regexp_replace(out, r"(^|\n)[ \t]*[;:!]+", "$1")  # comment marks, not punctuation
    out = F.regexp_replace(F.regexp_replace(out, r"[.!?][ \t\r\n]+", "\f"), r"[;:][ \t\r]+", "\n")
    out = F.regexp_replace(out, r"[^\p{L}\p{N}.+\-\n\f]+", " ")
    # Signs and blanks around marks go, and of several marks one stays; a blank line is a mark that a sentence can't cross.
    out = F.regexp_replace(out, r"(?<![ .+\-\n\f])(?=[ .+\-]*+(?:\f|\n[ .+\-]*+[\n\f]))[ .+\-\n\f]++", "\f")
    out = F.regexp_replace(out, r"(?<![ .+\-\n\f])(?=[ .+\-]*+\n)[ .+\-\n\f]++", "\n")
    return F.regexp_replace(out, r"^[ .+\-\n\f]++|(?<![ .+\-\n\f])[ .+\-\n\f]++$", "")


def unreachable() -> list[str]:
    """What no text can match: sentences out of normal form or given to two identifiers, identifiers in rules that no sentence has, rules behind a shorter part of theirs."""
    every = [s for many in SENTENCES.values() for s in many]
    word = r"[^\W_](?:[^\W_]|[.+\-](?=[^\W_]))*"
    odd = [s for s in every if s != s.lower() or not re.fullmatch(rf"{word}(?:\.? {word})*", s) or every.count(s) > 1]
    odd += [i for _, rule in RULES for i in rule if i not in SENTENCES]
    inside = lambda a, b: f" {' '.join(a)} " in f" {' '.join(b)} "
    return odd + [" ".join(b) for n, (_, b) in enumerate(RULES) if any(inside(a, b) for _, a in RULES[:n])]


if found := unreachable():
    raise ValueError(f"these can never match: {found}")


def _plain(sentence: str) -> str:
    return sentence.replace(". ", " ")


def _pattern() -> str:
    """Any known sentence between two marks, the longest first."""
    every = sorted((s for many in SENTENCES.values() for s in many), key=lambda s: (-len(s), s))
    words = (re.escape(s).replace(r"\.\ ", r"(?:\.[ \n]|\f)").replace(r"\ ", r"[ \n]") for s in every)
    return rf"(?<![^\n\f])(?:{'|'.join(words)})(?![^\n\f])"


def scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_sentences, sentence_ids, licenses, n_parts) of each row; lists are joined by spaces, licences by commas in the rules' order."""
    known = {_plain(s): k for k, many in SENTENCES.items() for s in many}
    names = F.create_map(*(F.lit(x) for kv in known.items() for x in kv))
    found = F.regexp_extract_all(marked(F.col(text_col)), F.lit(_pattern()), F.lit(0))
    ids = F.transform(found, lambda s: names[F.regexp_replace(s, r"\.?[ \n\f]", " ")])
    out = df.select(F.col(id_col), ids.alias("ids"))
    out = out.select(id_col, "ids", F.concat(F.lit(" "), F.array_join("ids", "  "), F.lit(" ")).alias("rest"), F.array().cast("array<string>").alias("hits"))
    for name, rule in RULES:
        want = " " + "  ".join(rule) + " "
        out = out.select(id_col, "ids", F.replace("rest", F.lit(want), F.lit(" # ")).alias("rest"), F.when(F.contains("rest", F.lit(want)), F.array_append("hits", F.lit(name))).otherwise(F.col("hits")).alias("hits"))
    left = F.size(F.filter(F.split("rest", " "), lambda s: ~s.isin("", "#")))
    return out.select(id_col, F.size("ids").cast("long").alias("n_sentences"), F.array_join("ids", " ").alias("sentence_ids"), F.array_join(F.array_distinct("hits"), ",").alias("licenses"), left.cast("long").alias("n_parts"))
