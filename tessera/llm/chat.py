r"""Chat formatting by token-level assembly.

Every segment of a turn is encoded by itself and reserved ids, beyond the
vocabulary, are spliced in between, so no text can produce a marker. The loss
mask comes from prefix sums over the segments' lengths. The printed form of
the same turn uses control strings; where content holds one of them, or a
backslash, a backslash is put before it, and reading takes that back.

A turn prints as `### Assistant: TEXT</turn>` and a newline; a role other than
the three known ones prints as `### Role: ROLE</role>TEXT</turn>`.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices

ROLES = {"system": "### System: ", "user": "### User: ", "assistant": "### Assistant: "}
OTHER, END_ROLE, END_TURN = "### Role: ", "</role>", "</turn>"
CONTROL = [*ROLES.values(), OTHER, END_ROLE, END_TURN]
_ESCAPE = re.compile("|".join(map(re.escape, ["\\", *CONTROL])))
_UNESCAPE = re.compile(r"\\(.)", re.S)
SCHEMA = "conv_id long, turn long, role string, ids array<int>, loss array<boolean>, formatted string"


def escape(text: str) -> str:
    return _ESCAPE.sub(lambda m: "\\" + m.group(), text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"\1", text)


class Codec:
    """A byte-level vocabulary in tiktoken's rank format, with an id for each control string after the last rank."""

    def __init__(self, path: str, pattern: str):
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding("chat", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        top = max(ranks.values()) + 1
        self.marker = {c: top + i for i, c in enumerate(CONTROL)}
        self.control = {i: c for c, i in self.marker.items()}
        self.role_of = {self.marker[c]: r for r, c in ROLES.items()}
        self.bytes = {i: b for b, i in ranks.items()}

    def turn(self, role: str, text: str) -> tuple[list[int], np.ndarray, str]:
        """Ids, loss mask and printed form of one turn. Under the mask are the ids of an assistant's text, no marker."""
        body = escape(text)
        if role in ROLES:
            segments = [[self.marker[ROLES[role]]]]
            printed = ROLES[role] + body + END_TURN + "\n"
        else:
            name = escape(role)
            segments = [[self.marker[OTHER]], self.encoding.encode_ordinary(name), [self.marker[END_ROLE]]]
            printed = OTHER + name + END_ROLE + body + END_TURN + "\n"
        segments += [self.encoding.encode_ordinary(body), [self.marker[END_TURN]]]
        ends = np.cumsum([len(s) for s in segments])
        step = np.zeros(ends[-1] + 1, np.int8)
        if role == "assistant":
            step[ends[-3]] += 1  # the text begins where the segments before it end
            step[ends[-2]] -= 1
        return [i for s in segments for i in s], np.cumsum(step[:-1]).astype(bool), printed

    def text(self, ids) -> str:
        return b"".join([self.bytes[i] for i in ids]).decode()

    def read(self, ids) -> tuple[str, str]:
        """Role and text of one turn's ids."""
        ids = list(ids)
        if ids[0] in self.role_of:
            return self.role_of[ids[0]], unescape(self.text(ids[1:-1]))
        at = ids.index(self.marker[END_ROLE])
        return unescape(self.text(ids[1:at])), unescape(self.text(ids[at + 1 : -1]))


_READ = re.compile(r"\\.|" + "|".join(map(re.escape, CONTROL)), re.S)


def parse(printed: str) -> list[tuple[str, str]]:
    """Roles and texts of printed turns, by their control strings."""
    out, role, since, named = [], "", 0, {v: k for k, v in ROLES.items()}
    for m in _READ.finditer(printed):
        c = m.group()
        if c in named:
            role, since = named[c], m.end()
        elif c == OTHER:
            since = m.end()
        elif c == END_ROLE:
            role, since = unescape(printed[since : m.start()]), m.end()
        elif c == END_TURN:
            out.append((role, unescape(printed[since : m.start()])))
    return out


_codecs: dict[tuple[str, str], Codec] = {}


def codec(path: str, pattern: str) -> Codec:
    if (path, pattern) not in _codecs:
        _codecs[path, pattern] = Codec(path, pattern)
    return _codecs[path, pattern]


def format_turns(conversations: DataFrame, path: str, pattern: str) -> DataFrame:
    """One row for each turn: conv_id, turn, role, ids, loss (mask over ids), formatted.

    conversations needs conv_id, turn, role and text; other columns are
    ignored. Null texts and roles are empty. Turns are independent here, so a
    conversation of any length is spread over all tasks. Empty in, empty out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, pattern)
        for b in slices(batches):
            roles = [r or "" for r in b.column(2).to_pylist()]
            done = [c.turn(r, t or "") for r, t in zip(roles, b.column(3).to_pylist())]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(roles, pa.string()), pa.array([x[0] for x in done], pa.list_(pa.int32())), pa.array([x[1] for x in done], pa.list_(pa.bool_())), pa.array([x[2] for x in done], pa.string())],
                names=["conv_id", "turn", "role", "ids", "loss", "formatted"],
            )

    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, SCHEMA)


def in_order(turns: DataFrame) -> DataFrame:
    """Turns of a conversation next to each other: by turn, nulls last; ties by role, then printed form."""
    return turns.repartition("conv_id").sortWithinPartitions(F.col("conv_id").asc_nulls_last(), F.col("turn").asc_nulls_last(), "role", "formatted")


def digests(turns: DataFrame, path: str, pattern: str) -> DataFrame:
    """One row for each conversation, read back from its ids and mask.

    conv_id, n_turns, turns_sha256 (role, newline, text, newline of each
    turn), loss_chars, loss_sha256 (all text under the mask, unescaped),
    formatted_chars, n_tokens, n_loss_tokens. A digest is a running hash, so
    the turns of one conversation pass through one task, one after another in
    bounded memory.
    """
    schema = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_tokens long, n_loss_tokens long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, pattern)
        done: list[tuple] = []
        held: list = []

        def close() -> None:
            if held:
                done.append((held[0], held[1], held[2].hexdigest(), held[3], held[4].hexdigest(), *held[5:]))
                held.clear()

        def flush() -> pa.RecordBatch:
            types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64()]
            names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "n_tokens", "n_loss_tokens"]
            out = pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(list(zip(*done)) or [[]] * 8, types)], names=names)
            done.clear()
            return out

        for b in slices(batches, "formatted"):
            for conv, ids, loss, printed in zip(*(b.column(i).to_pylist() for i in range(4))):
                if not held or held[0] != conv:
                    close()
                    held[:] = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0, 0, 0]
                role, text = c.read(ids)
                learnt = unescape(c.text([i for i, m in zip(ids, loss) if m]))
                held[1] += 1
                held[2].update(f"{role}\n{text}\n".encode())
                held[3] += len(learnt)
                held[4].update(learnt.encode())
                held[5] += len(printed)
                held[6] += len(ids)
                held[7] += sum(loss)
            if done:
                yield flush()
        close()
        if done:
            yield flush()

    return in_order(turns).select("conv_id", "ids", "loss", "formatted").mapInArrow(run, schema)
