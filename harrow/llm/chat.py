"""Chat formatting by a finite-state machine over roles.

A declarative template names the control strings, the roles that a state allows, and the roles whose text counts in the loss. Turns of a conversation
are read in order as a sorted stream; each gives segments of text with a loss flag. Nothing holds a whole conversation, so its length is unbounded.

Control strings inside texts are escaped reversibly: ``<``, any backslashes, ``|`` gains one backslash, and loses it when read back, so
no text can hold ``<|``. Roles also write a line feed as ``\\n`` and a backslash twice.
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

from .shared import by_bytes

START = ""


@dataclass(frozen=True)
class Template:
    open: str = "<|im_start|>"
    after_role: str = "\n"
    close: str = "<|im_end|>"
    between: str = "\n"
    loss_roles: frozenset[str] = frozenset({"assistant"})
    #: state (the last role; empty at first) to the roles that may follow
    follows: dict[str, frozenset[str]] = field(default_factory=lambda: {START: frozenset({"system", "user"}), "system": frozenset({"user"}), "user": frozenset({"assistant"}), "assistant": frozenset({"user", "tool"}), "tool": frozenset({"assistant", "tool"})})
    #: states in which a conversation may end
    accepting: frozenset[str] = frozenset({"assistant", "user"})


_CONTROL, _ESCAPED = re.compile(r"<(\\*)\|"), re.compile(r"<\\(\\*)\|")


def escape(text: str) -> str:
    return _CONTROL.sub(r"<\\\1|", text) if "|" in text else text


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"<\1|", text) if "|" in text else text


def escape_role(role: str) -> str:
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role))


def segments(role: str, text: str, t: Template) -> list[tuple[str, bool]]:
    """The text segments of a turn with their loss flags."""
    return [(t.open + escape_role(role) + t.after_role, False), (escape(text), role in t.loss_roles), (t.close + t.between, False)]


def parse_turn(formatted: str, t: Template) -> tuple[str, str]:
    """(role, text) of a formatted turn."""
    head, _, rest = formatted.removeprefix(t.open).partition(t.after_role)
    tail = t.close + t.between
    if not formatted.startswith(t.open) or not rest.endswith(tail):
        raise ValueError("not a formatted turn")
    return unescape_role(head), unescape(rest[: -len(tail)])


def format_conversations(turns: DataFrame, template: Template = Template(), id_column: str = "conv_id", turn_column: str = "turn", role_column: str = "role", text_column: str = "text") -> DataFrame:
    """conv_id, place (from 0), role, segments (array of struct of text and loss), allowed, complete: one row for each turn, each conversation's
    rows together and in order within a partition.

    Turns are ordered by their number, null last, then role and text; ``allowed`` says whether the machine allows the role there, ``complete`` (on
    the last turn, else null) whether all were allowed and the conversation may end there. Turns that the machine refuses are formatted all the same.
    Null roles and texts count as empty; rows with a null id are one conversation; repeated rows are turns of their own; other columns are
    ignored. An empty table gives an empty result.
    """
    kind = turns.schema[id_column].dataType
    schema = T.StructType([T.StructField("conv_id", kind), T.StructField("place", T.LongType()), T.StructField("role", T.StringType()), T.StructField("segments", T.ArrayType(T.StructType([T.StructField("text", T.StringType()), T.StructField("loss", T.BooleanType())]))), T.StructField("allowed", T.BooleanType()), T.StructField("complete", T.BooleanType())])
    rows = turns.select(F.col(id_column).alias("conv_id"), F.col(turn_column).alias("turn"), F.coalesce(F.col(role_column), F.lit("")).alias("role"), F.coalesce(F.col(text_column), F.lit("")).alias("text"))
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", F.col("turn").asc_nulls_last(), "role", "text").select("conv_id", "role", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begun, name, state, place, good = False, None, START, 0, True
        held: list[tuple] = []

        def batch_of(out: list[tuple], arrow: pa.DataType) -> pa.RecordBatch:
            kinds = [arrow, pa.int64(), pa.string(), pa.list_(pa.struct([("text", pa.string()), ("loss", pa.bool_())])), pa.bool_(), pa.bool_()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=schema.names)

        arrow = None
        for batch in by_bytes(batches, 2):
            arrow, out = batch.schema.field(0).type, []
            for conv, role, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if not begun or conv != name:
                    out += [(*x[:5], good and state in template.accepting) for x in held]
                    begun, name, state, place, good, held = True, conv, START, 0, True, []
                out += held
                allowed = role in template.follows.get(state, ())
                good = good and allowed
                held = [(conv, place, role, [{"text": s, "loss": loss} for s, loss in segments(role, text, template)], allowed, None)]
                state, place = role, place + 1
            if out:
                yield batch_of(out, arrow)
        if held:
            yield batch_of([(*x[:5], good and state in template.accepting) for x in held], arrow)

    return rows.mapInArrow(run, schema)


def read_back(formatted: DataFrame, template: Template = Template()) -> DataFrame:
    """Digests of each conversation, parsed from the rows of ``format_conversations`` as they come: conv_id, n_turns, turns_sha256 (role, line feed, text, line
    feed of each turn), loss_chars and loss_sha256 (all text under the loss mask), formatted_chars, valid (the machine allows every turn and the end), and
    first_refused (the place of the first turn that it doesn't allow; null if none)."""
    schema = T.StructType([formatted.schema["conv_id"], T.StructField("n_turns", T.LongType()), T.StructField("turns_sha256", T.StringType()), T.StructField("loss_chars", T.LongType()), T.StructField("loss_sha256", T.StringType()), T.StructField("formatted_chars", T.LongType()), T.StructField("valid", T.BooleanType()), T.StructField("first_refused", T.LongType())])
    rows = formatted.select("conv_id", "segments", "allowed", "complete")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turns, loss = hashlib.sha256(), hashlib.sha256()
        n, loss_chars, chars, refused = 0, 0, 0, None
        for batch in batches:
            out = []
            for conv, parts, allowed, complete in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                whole = "".join(p["text"] for p in parts)
                role, text = parse_turn(whole, template)
                turns.update(f"{role}\n{text}\n".encode())
                masked = "".join(unescape(p["text"]) for p in parts if p["loss"])
                loss.update(masked.encode())
                refused = n if refused is None and not allowed else refused
                n, loss_chars, chars = n + 1, loss_chars + len(masked), chars + len(whole)
                if complete is not None:  # the last turn
                    out.append((conv, n, turns.hexdigest(), loss_chars, loss.hexdigest(), chars, complete, refused))
                    turns, loss = hashlib.sha256(), hashlib.sha256()
                    n, loss_chars, chars, refused = 0, 0, 0, None
            if out:
                kinds = [batch.schema.field(0).type, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.bool_(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=schema.names)

    return rows.mapInArrow(run, schema)
