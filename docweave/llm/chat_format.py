"""Chat records of many layouts to canonical turns, and turns to one training template with a loss mask.

A record is JSON.  Its layout is found by a fingerprint: the hash of the set of its nested field paths
(list positions left out).  A table of declarative mappings, keyed by such fingerprints, says
where turns are; the first record of a layout is looked up, later ones cost a dictionary access.

The template marks turns by control strings.  Texts (and roles other than the three known ones) may hold such
strings; they are escaped by a backslash after their first character, and a string that already
looks escaped gets one backslash more, so that ``unescape(escape(x)) == x`` for all x.

Defined results: a null text is an empty one, and so is a null role; rows of a conversation that share a turn number
are ordered by role, then text; a null turn comes first; rows with a null conversation id form one
conversation; repeated rows are repeated turns; an empty table gives an empty table; other columns are not read.
A record of unknown layout raises ``ValueError`` (``unknown="null"`` gives a row with no turns instead).
"""

from __future__ import annotations

import functools
import hashlib
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .common import map_rows

# The control strings of the template.
BEGIN, END, USER, USER_END, SYSTEM, SYSTEM_END, ROLE, ROLE_END = "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "[ROLE]", "[/ROLE]"
CONTROLS = (BEGIN, END, USER, USER_END, SYSTEM, SYSTEM_END, ROLE, ROLE_END)
_plain = re.compile("|".join(re.escape(c[0]) + r"\\*" + re.escape(c[1:]) for c in sorted(CONTROLS, key=len, reverse=True)))
_escaped = re.compile("|".join(re.escape(c[0]) + r"\\+" + re.escape(c[1:]) for c in sorted(CONTROLS, key=len, reverse=True)))
_control = re.compile("|".join(map(re.escape, sorted(CONTROLS, key=len, reverse=True))))


def escape(text: str) -> str:
    """text with no control string in it, from which ``unescape`` gives text."""
    return _plain.sub(lambda m: m[0][0] + "\\" + m[0][1:], text)


def unescape(text: str) -> str:
    return _escaped.sub(lambda m: m[0][0] + m[0][2:], text)


@dataclass(frozen=True)
class Mapping:
    """Where a layout keeps its turns.

    ``each``: the path of a list of turns (empty: the record is one turn), with ``role`` and ``text`` inside an item.
    ``parts``: else, fields in order with the role of each; several fields of one role in a row are joined by an empty line.
    """

    name: str
    each: str = ""
    role: str = ""
    text: str = ""
    parts: tuple[tuple[str, str], ...] = ()

    def paths(self) -> frozenset[str]:
        if self.parts:
            return frozenset(f for f, _ in self.parts)
        inside = f"{self.each}[]." if self.each else ""
        return frozenset({inside + self.role, inside + self.text})


#: Layouts in common use.  Fields that say nothing about turns (ids, turn numbers, scores) may stand beside them.
MAPPINGS = (
    Mapping("messages", "messages", "role", "content"),
    Mapping("conversations", "conversations", "from", "value"),
    Mapping("turns", "turns", "role", "text"),
    Mapping("turn row", "", "role", "text"),
    Mapping("instruction with input", parts=(("instruction", "user"), ("input", "user"), ("output", "assistant"))),
    Mapping("instruction", parts=(("instruction", "user"), ("output", "assistant"))),
    Mapping("system and prompt", parts=(("system", "system"), ("prompt", "user"), ("response", "assistant"))),
    Mapping("prompt and response", parts=(("prompt", "user"), ("response", "assistant"))),
    Mapping("prompt and completion", parts=(("prompt", "user"), ("completion", "assistant"))),
    Mapping("question and answer", parts=(("question", "user"), ("answer", "assistant"))),
)
#: Other names of roles in use.
ROLES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}
#: Fields that a fingerprint leaves out.
BESIDE = frozenset({"id", "conv_id", "turn", "source", "lang", "score", "metadata"})


def field_paths(record: object, at: str = "") -> set[str]:
    """Paths of the leaves: names joined by dots, ``[]`` for any item of a list."""
    if isinstance(record, dict):
        return {p for k, v in record.items() if at or k not in BESIDE for p in field_paths(v, f"{at}.{k}" if at else k)}
    if isinstance(record, list):
        return {p for v in record for p in field_paths(v, f"{at}[]")} or {f"{at}[]"}
    return {at}


def fingerprint(paths) -> str:
    """The hash of a set of field paths."""
    return hashlib.sha256("\n".join(sorted(paths)).encode()).hexdigest()[:32]


@functools.cache
def _by_fingerprint(mappings: tuple[Mapping, ...]) -> dict[str, Mapping]:
    return {fingerprint(m.paths()): m for m in reversed(mappings)}


def _choose(paths: set[str], mappings: tuple[Mapping, ...]) -> Mapping | None:
    """The mapping with this fingerprint; else the first whose paths are all there (a layout with further fields); an empty list counts as any."""
    if found := _by_fingerprint(mappings).get(fingerprint(paths)):
        return found
    return next((m for m in mappings if m.paths() <= paths or m.each and f"{m.each}[]" in paths), None)


def canonical_turns(record: dict, mapping: Mapping) -> list[tuple[str, str]]:
    """(role, text) of each turn of a record."""

    def of(v) -> str:
        return "" if v is None else v if isinstance(v, str) else json.dumps(v, ensure_ascii=False)

    if mapping.parts:
        turns: list[tuple[str, str]] = []
        for field, role in mapping.parts:
            text = of(record.get(field))
            if turns and turns[-1][0] == role:
                if text:
                    turns[-1] = (role, f"{turns[-1][1]}\n\n{text}")
            elif text or role != "system":
                turns.append((role, text))
        return turns
    items = record.get(mapping.each) or [] if mapping.each else [record]
    return [(ROLES.get(r, r), of(x.get(mapping.text))) for x in items for r in [of(x.get(mapping.role))]]


def to_turns(df: DataFrame, record_col: str, key_cols: list[str], mappings: tuple[Mapping, ...] = MAPPINGS, unknown: str = "raise") -> DataFrame:
    """One row for each turn of each record: the key columns, ``seq`` in its record, layout, role, text."""
    keys = ", ".join(f"{k} {df.schema[k].dataType.simpleString()}" for k in key_cols)

    def make():
        known: dict[frozenset, Mapping | None] = {}

        def f(records, *key):
            out: list[tuple] = []
            for i, raw in enumerate(records):
                record = json.loads(raw) if raw else {}
                paths = frozenset(field_paths(record))
                if paths not in known:
                    known[paths] = _choose(set(paths), mappings)
                mapping = known[paths]
                if mapping is None:
                    if unknown == "raise":
                        raise ValueError(f"no mapping for a record with fields {sorted(paths)}")
                    out.append((*(k[i] for k in key), 0, None, None, None))
                    continue
                for n, (role, text) in enumerate(canonical_turns(record, mapping)):
                    out.append((*(k[i] for k in key), n, mapping.name, role, text))
            return list(zip(*out, strict=True)) if out else [[] for _ in range(len(key) + 4)]

        return f

    return map_rows(df, [record_col, *key_cols], f"{keys}, seq long, layout string, role string, text string", make)


def format_turn(role: str, text: str) -> tuple[str, int, int]:
    """A turn in the template, and where its loss mask begins and ends (equal: no loss).  Turns follow each other without anything between."""
    body = escape(text)
    if role == "assistant":
        return f"{BEGIN}{body}{END}", len(BEGIN), len(BEGIN) + len(body)
    if role == "user":
        return f"{USER}{body}{USER_END}", 0, 0
    if role == "system":
        return f"{SYSTEM}{body}{SYSTEM_END}", 0, 0
    return f"{ROLE}{escape(role)}{ROLE_END}{body}{END}", 0, 0


def read_turns(formatted: str) -> Iterator[tuple[str, str, bool]]:
    """(role, text, under the loss mask) of each turn in formatted text."""
    at = 0
    while at < len(formatted):
        head = _control.match(formatted, at)
        if head is None:
            raise ValueError("a turn has no mark")
        role = {BEGIN: "assistant", USER: "user", SYSTEM: "system"}.get(head[0])
        at = head.end()
        if head[0] == ROLE:
            mid = _control.search(formatted, at)
            role, at = unescape(formatted[at : mid.start()]), mid.end()
        end = _control.search(formatted, at)
        if role is None or end is None:
            raise ValueError("a turn has no end")
        yield role, unescape(formatted[at : end.start()]), head[0] == BEGIN
        at = end.end()


def _stream(turns: DataFrame, id_col: str, schema: str, begin, each, close) -> DataFrame:
    """Fold the turns of each conversation, in order, as a stream: of a conversation no more than one turn is in memory."""
    struct = StructType.fromDDL(schema)
    arrow = to_arrow_schema(struct)

    def run(batches):
        state, key, out = None, None, []

        def packed():
            return pa.RecordBatch.from_arrays([pa.array(x, type=t.type) for x, t in zip(zip(*out, strict=True), arrow, strict=True)], schema=arrow)

        for batch in batches:
            for conv, role, text in zip(*(batch.column(n).to_pylist() for n in (id_col, "role", "text")), strict=True):
                if state is None or conv != key:
                    if state is not None:
                        out.append(close(key, state))
                    state, key = begin(), conv
                each(state, role or "", text or "")
            if len(out) >= 256:
                yield packed()
                out = []
        if state is not None:
            out.append(close(key, state))
        if out:
            yield packed()

    ordered = turns.repartition(F.col(id_col)).sortWithinPartitions(F.col(id_col), F.col("turn").asc_nulls_first(), "seq", "role", "text")
    return ordered.select(id_col, "role", "text").mapInArrow(run, struct)


def format_conversations(turns: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """(id, formatted string, loss array<struct<begin, end>>): training examples.  turns: id, turn, seq, role, text."""

    def each(s, role, text):
        piece, a, b = format_turn(role, text)
        if a < b:
            s[1].append({"begin": s[2] + a, "end": s[2] + b})
        s[0].append(piece)
        s[2] += len(piece)

    schema = f"{id_col} {turns.schema[id_col].dataType.simpleString()}, formatted string, loss array<struct<begin: long, end: long>>"
    return _stream(turns, id_col, schema, lambda: [[], [], 0], each, lambda k, s: (k, "".join(s[0]), s[1]))


def digest_conversations(turns: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """Digests of each conversation, read back from its formatted turns, as a stream over turns."""

    def begin():
        return {"n": 0, "turns": hashlib.sha256(), "loss": hashlib.sha256(), "loss_chars": 0, "chars": 0}

    def each(s, role, text):
        piece, a, b = format_turn(role, text)
        s["chars"] += len(piece)
        masked = unescape(piece[a:b])
        s["loss_chars"] += len(masked)
        s["loss"].update(masked.encode("utf-8", "surrogatepass"))
        for r, t, _ in read_turns(piece):
            s["n"] += 1
            s["turns"].update(f"{r}\n{t}\n".encode("utf-8", "surrogatepass"))

    schema = f"{id_col} {turns.schema[id_col].dataType.simpleString()}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    return _stream(turns, id_col, schema, begin, each, lambda k, s: (k, s["n"], s["turns"].hexdigest(), s["loss_chars"], s["loss"].hexdigest(), s["chars"]))
