"""Chat formatting: schema fingerprints choose how a record becomes turns.

Records come in many layouts. The set of their nested field paths is hashed to
a fingerprint, and a declarative mapping is chosen by it: which paths hold the
turns, the roles and the texts. Canonical turns are written with a template that
marks turns; control strings inside texts are escaped so that reading back gives
the same text. A mask tells which characters are assistant text.

Conversations are kept as rows of turns, sorted within partitions and streamed:
a task holds one turn at a time, never a conversation, however long it is.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

START, END = "<|im_start|>", "<|im_end|>"
_CONTROL = re.compile(r"<\|(\\*)(im_start\|>|im_end\|>)")
_ESCAPED = re.compile(r"<\|\\(\\*)(im_start\|>|im_end\|>)")

# --- layouts --------------------------------------------------------------------


def paths(value, at: str = "") -> set[str]:
    """Nested field paths of a JSON value; ``[]`` stands for any place of a list."""
    if isinstance(value, dict):
        return {p for k, v in value.items() for p in paths(v, f"{at}.{k}" if at else k)} or {at}
    if isinstance(value, list):
        return {p for v in value for p in paths(v, at + "[]")} or {at + "[]"}
    return {at}


def fingerprint(found: set[str]) -> str:
    return hashlib.sha256("\n".join(sorted(found)).encode()).hexdigest()[:16]


#: Layouts: the paths that make one up, optional ones, and where turns come from.
#: ``list`` names a list of turns with its role and text fields; ``fields`` gives
#: single fields, each with its role, in order.
LAYOUTS: dict[str, dict] = {
    "messages": {"paths": {"messages[].role", "messages[].content"}, "list": ("messages", "role", "content")},
    "conversations": {"paths": {"conversations[].from", "conversations[].value"}, "optional": {"system"}, "list": ("conversations", "from", "value"), "fields": [("system", "system")]},
    "instruction": {"paths": {"instruction", "output"}, "optional": {"input", "system"}, "fields": [("system", "system"), ("instruction+input", "user"), ("output", "assistant")]},
    "prompt": {"paths": {"prompt", "completion"}, "optional": {"system"}, "fields": [("system", "system"), ("prompt", "user"), ("completion", "assistant")]},
    "response": {"paths": {"prompt", "response"}, "optional": {"system"}, "fields": [("system", "system"), ("prompt", "user"), ("response", "assistant")]},
    "question": {"paths": {"question", "answer"}, "optional": {"context"}, "fields": [("context", "system"), ("question", "user"), ("answer", "assistant")]},
    "turn": {"paths": {"conv_id", "turn", "role", "text"}, "row": ("conv_id", "turn", "role", "text")},
}
ROLES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant", "prompter": "user"}


def mappings() -> dict[str, str]:
    """Fingerprints of every layout with each choice of its optional paths."""
    known = {}
    for name, layout in LAYOUTS.items():
        choices = [set()]
        for p in sorted(layout.get("optional", ())):
            choices += [c | {p} for c in choices]
        for c in choices:
            known[fingerprint(layout["paths"] | c)] = name
    return known


def layout_of(found: set[str], known: dict[str, str] | None = None) -> str | None:
    """The layout of a record with these paths: by fingerprint, else the layout whose paths it holds with the fewest others."""
    name = (known or mappings()).get(fingerprint(found))
    if name is None:
        fits = [(len(found - v["paths"] - v.get("optional", set())), k) for k, v in LAYOUTS.items() if v["paths"] <= found]
        name = min(fits)[1] if fits else None
    return name


def turns_of(record: dict, name: str) -> list[tuple[str, str]]:
    layout = LAYOUTS[name]
    out = []
    for field, role in layout.get("fields", ()):
        parts = [record.get(f) for f in field.split("+")]
        parts = [str(p) for p in parts if p not in (None, "")]
        if parts:
            out.append((role, "\n".join(parts)))
    if "list" in layout:
        where, role, text = layout["list"]
        out += [(ROLES.get(t.get(role), t.get(role) or ""), t.get(text) or "") for t in record.get(where) or [] if isinstance(t, dict)]
    if "row" in layout:
        _, _, role, text = layout["row"]
        out.append((record.get(role) or "", record.get(text) or ""))
    return out


def canonical_turns(records: DataFrame, id_col: str = "conv_id", json_col: str = "record") -> DataFrame:
    """JSON records of any known layout to ``(conv_id, turn, role, text, layout)``.

    A record that is null, no JSON object or of no known layout gives one row
    with null turn, role, text and layout, so that nothing vanishes.
    """
    rows = records.select(F.col(id_col).alias("conv_id"), F.col(json_col).alias("record"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = mappings()
        for batch in batches:
            out: list[tuple] = []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                try:
                    record = json.loads(text) if text else None
                except ValueError:
                    record = None
                name = layout_of(paths(record), known) if isinstance(record, dict) else None
                turns = turns_of(record, name) if name else []
                out += [(key, i, r, t, name) for i, (r, t) in enumerate(turns)] or [(key, None, None, None, None)]
            cols = list(zip(*out)) or [()] * 5
            kinds = (batch.column(0).type, pa.int64(), pa.string(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names=["conv_id", "turn", "role", "text", "layout"])

    kind = rows.schema["conv_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"conv_id {kind}, turn long, role string, text string, layout string")


def schema_paths(kind: T.DataType, at: str = "") -> set[str]:
    """Nested field paths of a table's schema, as ``paths`` has them of a record."""
    if isinstance(kind, T.StructType):
        return {p for f in kind.fields for p in schema_paths(f.dataType, f"{at}.{f.name}" if at else f.name)} or {at}
    if isinstance(kind, T.ArrayType):
        return schema_paths(kind.elementType, at + "[]")
    return {at}


def table_turns(records: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """``(conv_id, turn, role, text)`` of a table in any known layout.

    The fingerprint of the field paths of its schema, without the id, selects the
    mapping, which becomes column expressions. Columns that the mapping doesn't
    name are ignored; a table of no known layout is an error. Records without any
    turn (null or empty fields and lists) give no row; null roles and texts of
    listed turns stay null.
    """
    name = layout_of(schema_paths(records.schema)) or layout_of(schema_paths(records.drop(id_col).schema))
    if name is None:
        raise ValueError(f"no layout for {sorted(schema_paths(records.schema))}")
    layout = LAYOUTS[name]
    if "row" in layout:
        return records.select(*[F.col(c).alias(x) for c, x in zip(layout["row"], ("conv_id", "turn", "role", "text"))])
    parts = []
    for field, role in layout.get("fields", ()):
        given = [F.col(f).cast("string") for f in field.split("+") if f in records.columns]
        if given:
            text = F.array_join(F.filter(F.array(*given), lambda x: x.isNotNull() & (x != "")), "\n")
            parts.append(F.when(text != "", F.array(F.struct(F.lit(role).alias("role"), text.alias("text")))))
    if "list" in layout:
        where, role, text = layout["list"]
        known = F.create_map(*[F.lit(x) for kv in ROLES.items() for x in kv])
        parts.append(F.transform(F.filter(where, lambda t: t.isNotNull()), lambda t: F.struct(F.coalesce(known[t[role]], t[role]).alias("role"), t[text].alias("text"))))
    none = F.array().cast("array<struct<role:string,text:string>>")
    turns = F.concat(*[F.coalesce(p.cast("array<struct<role:string,text:string>>"), none) for p in parts])
    return records.select(F.col(id_col).alias("conv_id"), F.posexplode(turns).alias("turn", "t")).select("conv_id", F.col("turn").cast("long").alias("turn"), "t.role", "t.text")


# --- template -------------------------------------------------------------------


def escape(text: str) -> str:
    """Puts one backslash more into each control string."""
    return _CONTROL.sub(r"<|\\\1\2", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"<|\1\2", text)


def format_turn(role: str, text: str) -> str:
    return f"{START}{escape(role.replace('\\', '\\\\').replace(chr(10), '\\n'))}\n{escape(text)}{END}\n"


def read_turn(segment: str) -> tuple[str, str]:
    """Role and text of a formatted turn."""
    if not segment.startswith(START):
        raise ValueError(f"no mark of a turn at its start: {segment[:40]!r}")
    head, _, rest = segment[len(START) :].partition("\n")
    role = re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(head))
    return role, unescape(rest[: -len(END) - 1])


def read(formatted: str) -> list[tuple[str, str]]:
    """All turns of a formatted conversation."""
    return [read_turn(s) for s in re.findall(re.escape(START) + r".*?" + re.escape(END) + "\n", formatted, re.S)]


def format_chat(turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """``(conv_id, turn, segment, mask_start, mask_length)``: each turn as formatted.

    The segments of a conversation, in order of turn (then role and text, so
    that ties are settled), make up its formatted text. The mask is the escaped
    text of an assistant turn, as places within its segment; null elsewhere. A
    null role or text is empty. Repeated rows are turns of their own.
    """
    role, text = F.coalesce(F.col(role_col), F.lit("")), F.coalesce(F.col(text_col), F.lit(""))
    control, more = r"<\|(\\*)(im_start\|>|im_end\|>)", r"<|\\$1$2"
    name = F.regexp_replace(F.replace(F.replace(role, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")), control, more)
    body = F.regexp_replace(text, control, more)
    segment = F.concat(F.lit(START), name, F.lit("\n"), body, F.lit(END + "\n"))
    spoken = role == "assistant"
    return turns.select(
        F.col(id_col).alias("conv_id"),
        F.col(turn_col).alias("turn"),
        segment.alias("segment"),
        F.when(spoken, F.length(name) + len(START) + 1).alias("mask_start"),
        F.when(spoken, F.length(body)).alias("mask_length"),
    )


def read_back(formatted: DataFrame) -> DataFrame:
    """Digests of conversations read back from ``format_chat``'s output.

    ``(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256,
    formatted_chars)``. Segments stream sorted through each task, as the formatted
    text; turns are what its marks tell, wherever segments begin and end. A
    running hash stands for the conversation. Text that is no whole turn is an
    error.
    """
    kind = formatted.schema["conv_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state, out, text = None, None, [], ""

        def flush():
            nonlocal out
            cols = list(zip(*out)) or [()] * 6
            out = []
            kinds = (arrow, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

        def close():
            if text:
                raise ValueError(f"conversation {key} ends within a turn")
            out.append((key, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4]))

        arrow = pa.int64()
        for batch in batches:
            arrow = batch.column(0).type
            for conv, segment, start, length in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if state is None or conv != key:
                    if state:
                        close()
                    key, state = conv, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                text += segment
                while (end := text.find(END + "\n")) >= 0:
                    end += len(END) + 1
                    role, said = read_turn(text[:end])
                    state[0] += 1
                    state[1].update(f"{role}\n{said}\n".encode())
                    text = text[end:]
                state[4] += len(segment)
                if start is not None:
                    said = unescape(segment[start : start + length])
                    state[2] += len(said)
                    state[3].update(said.encode())
            yield flush()
        if state:
            close()
        yield flush()

    rows = formatted.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "segment").select("conv_id", "segment", "mask_start", "mask_length")
    return rows.mapInArrow(run, f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
