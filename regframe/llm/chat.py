"""Chat formatting: a finite-state machine over roles and a declarative template.

A template names, per role, the header that opens a turn, the mark that closes it
and whether its text counts for the loss. Formatting emits text segments with a
loss flag each; joined they are the formatted conversation. Control strings in
texts are escaped by a backslash, which is itself escaped, so that
:func:`read_back` gives the turns again exactly.

The state machine accepts an optional system turn, then user and assistant in
turn, ending after an assistant. A conversation that breaks the order is still
formatted; ``valid`` is false and ``problem`` names the first turn at fault.

Defined cases: a null text or role is empty; roles the template does not know are
written with an escaped name; turns that share a number are ordered by role and
text (nulls first); a null conv_id is one conversation; no rows give no rows. One
conversation is one output string, so it is the unit that a task holds.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from regframe.llm import common


@dataclass(frozen=True)
class Template:
    """Headers by role, the closing mark, loss roles and the order of roles."""

    headers: dict = field(
        default_factory=lambda: {"system": "### System: ", "user": "### User: ", "assistant": "### Assistant: "}
    )
    other: str = "### Role {}: "
    close: str = " </turn>\n"
    loss: tuple = ("assistant",)
    start: str = "start"
    final: tuple = ("assistant",)
    #: state -> role -> next state; the state is the role just read
    order: dict = field(
        default_factory=lambda: {
            "start": ("system", "user"),
            "system": ("user",),
            "user": ("assistant",),
            "assistant": ("user",),
        }
    )


DEFAULT = Template()

def _alternatives(words) -> str:
    return "|".join(re.escape(w) for w in words)


def _control(t: Template) -> re.Pattern:
    """The backslash and what opens or closes a turn; they get a backslash inside texts."""
    opens = {h.split()[0] for h in (*t.headers.values(), t.other)}
    return re.compile(r"\\|" + _alternatives(sorted({*opens, t.close.strip()})))


def escape(text: str, t: Template = DEFAULT) -> str:
    return _control(t).sub(lambda m: "\\" + m[0], text)


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.S)


def _turn(t: Template) -> re.Pattern:
    """One formatted turn: a known header or the general one, the text, the mark."""
    before, _, after = t.other.partition("{}")
    known = _alternatives(sorted(t.headers.values(), key=len, reverse=True))
    mark = t.close.lstrip()
    lead = re.escape(t.close[: len(t.close) - len(mark)])
    stop = re.escape(t.close.strip())
    body = rf"(?:\\.|(?!{stop})[^\\])*?"
    return re.compile(
        rf"(?:({known})|{re.escape(before)}((?:\\.|[^\\:])*?){re.escape(after)})({body}){lead}{re.escape(mark)}", re.S
    )


def check_order(roles: list[str], t: Template = DEFAULT) -> tuple[int, str] | None:
    """The first fault (turn index, text), or None for an accepted conversation."""
    state = t.start
    for i, role in enumerate(roles):
        if role not in t.order.get(state, ()):
            return i, f"{role or 'no role'} after {state}"
        state = role
    return None if state in t.final else (len(roles), f"ends after {state}")


def segments(turns: list[tuple[str, str]], t: Template = DEFAULT) -> list[tuple[str, bool]]:
    """Text segments with loss flags; joined they are the formatted text."""
    out: list[tuple[str, bool]] = []
    for role, text in turns:
        head = t.headers.get(role) or t.other.format(escape(role, t).replace(":", "\\:"))
        out += [(head, False), (escape(text, t), role in t.loss), (t.close, False)]
    return out


def read_back(parts: list[tuple[str, bool]], t: Template = DEFAULT) -> tuple[list[tuple[str, str]], list[str]]:
    """Turns and, from the loss mask, the loss texts, out of formatted segments."""
    whole = "".join(p for p, _ in parts)
    roles = {h: r for r, h in t.headers.items()}
    turn = _turn(t)
    turns, at = [], 0
    while at < len(whole):
        m = turn.match(whole, at)
        if not m:
            raise ValueError(f"no turn at {at}")
        turns.append((roles[m[1]] if m[1] else unescape(m[2]), unescape(m[3])))
        at = m.end()
    return turns, [unescape(p) for p, loss in parts if loss]


_SEGMENTS = T.ArrayType(T.StructType([T.StructField("text", T.StringType()), T.StructField("loss", T.BooleanType())]))


def format_conversations(rows: DataFrame, template: Template = DEFAULT) -> DataFrame:
    """Per conversation: ``conv_id, segments, valid, problem``."""
    common.short_batches(rows.sparkSession)
    turns = rows.select(
        F.col("conv_id"),
        F.struct(
            F.col("turn"),
            F.col("role").cast("string").alias("role"),
            F.col("text").cast("string").alias("text"),
        ).alias("t"),
    )
    convs = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    schema = T.StructType(
        [
            convs.schema["conv_id"],
            T.StructField("segments", _SEGMENTS),
            T.StructField("valid", T.BooleanType()),
            T.StructField("problem", T.StringType()),
        ]
    )
    arrow = common.to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            segs, valid, problem = [], [], []
            for conv in b.column(1).to_pylist():
                pairs = [(x["role"] or "", x["text"] or "") for x in conv]
                fault = check_order([r for r, _ in pairs], template)
                segs.append([{"text": s, "loss": f} for s, f in segments(pairs, template)])
                valid.append(fault is None)
                problem.append(None if fault is None else f"turn {fault[0]}: {fault[1]}")
            cols = [b.column(0)] + [pa.array(v, arrow.field(n).type) for n, v in zip(arrow.names[1:], (segs, valid, problem))]
            yield pa.RecordBatch.from_arrays(cols, names=arrow.names)

    return convs.mapInArrow(run, schema)


def digests(formatted: DataFrame, template: Template = DEFAULT) -> DataFrame:
    """Counts and digests read back from the formatted segments alone."""
    fields = [
        ("n_turns", T.LongType()),
        ("turns_sha256", T.StringType()),
        ("loss_chars", T.LongType()),
        ("loss_sha256", T.StringType()),
        ("formatted_chars", T.LongType()),
    ]
    schema = T.StructType([formatted.schema["conv_id"], *[T.StructField(n, t) for n, t in fields], formatted.schema["valid"]])
    arrow = common.to_arrow_schema(schema)
    src = formatted.select("conv_id", "segments", "valid")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple] = []
            for segs in b.column(1).to_pylist():
                parts = [(s["text"], s["loss"]) for s in segs]
                turns, loss = read_back(parts, template)
                text = "".join(f"{r}\n{t}\n" for r, t in turns)
                masked = "".join(loss)
                out.append(
                    (
                        len(turns),
                        hashlib.sha256(text.encode()).hexdigest(),
                        len(masked),
                        hashlib.sha256(masked.encode()).hexdigest(),
                        sum(len(p) for p, _ in parts),
                    )
                )
            cols = [pa.array(list(v), arrow.field(n).type) for (n, _), v in zip(fields, zip(*out))]
            if out:
                yield pa.RecordBatch.from_arrays([b.column(0), *cols, b.column(2)], names=arrow.names)

    return src.mapInArrow(run, schema)
