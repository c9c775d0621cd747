"""Chat formatting by columnar byte assembly.

Rows are put in order of conversation and turn by ranges, so a conversation of any length is spread over tasks. For each
Arrow batch, all turns are formatted at once: segment lengths, cumulative offsets and scatter indices in numpy place
headers, texts and ends in one buffer, which becomes the Arrow column of formatted turns without a copy. A conversation is
the concatenation of its rows' segments in the order of `place`. Only the digest of a whole conversation is one sequence by
nature: there its segments stream through one task and are never held together.

Template, for each turn:  "### " role ":\\n" text "\\n</turn>\\n".  In roles and texts "\\" becomes "\\\\", "###" gets "\\" before
it and so does "</turn>"; in roles also ":" and line ends. Unescaping drops each first "\\" of a pair: it is the exact inverse,
and no text can hold a mark that isn't escaped. The loss mask marks the (escaped) text of assistant turns.

Defined results: a null text or role is empty; equal turns of a conversation are ordered by role and text, null turns
come first; repeated rows are turns of their own; null conversation ids are one conversation; an empty table gives no
rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

OPEN, AFTER_ROLE, CLOSE = b"### ", b":\n", b"\n</turn>\n"
SCORED = "assistant"
#: Bytes of formatted turns built at once.
BLOCK = 4 << 20


def _escaped(texts: pa.Array, role: bool = False) -> pa.Array:
    out = pc.fill_null(texts.cast(pa.large_string()), "")
    for plain in ("\\", "###", "</turn>", *((":", "\n") if role else ())):
        out = pc.replace_substring(out, plain, "\\" + plain)
    return out


_PAIR = re.compile(r"\\([\s\S])")


def unescaped(text: str) -> str:
    return _PAIR.sub(r"\1", text)


def _bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of the texts, and where each begins and the last ends."""
    offsets = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, texts.offset * 8)
    return np.frombuffer(texts.buffers()[2] or b"", np.uint8), offsets


def _scatter(out: np.ndarray, to: np.ndarray, data: np.ndarray, begin: np.ndarray, sizes: np.ndarray) -> None:
    """Copies sizes[i] bytes from begin[i] of data to to[i] of out, for all i at once."""
    inside = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    out[np.repeat(to, sizes) + inside] = data[np.repeat(begin, sizes) + inside]


def assemble(roles: pa.Array, texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The formatted turns as one Arrow array over one buffer, and the byte spans of their texts within them."""
    roles, texts = _escaped(roles, role=True), _escaped(texts)
    n = len(texts)
    (role_data, role_at), (text_data, text_at) = _bytes(roles), _bytes(texts)
    role_size, text_size = np.diff(role_at), np.diff(text_at)
    fixed = len(OPEN) + len(AFTER_ROLE) + len(CLOSE)
    ends = np.concatenate(([0], np.cumsum(fixed + role_size + text_size)))
    start = ends[:-1]
    out = np.empty(int(ends[-1]), np.uint8)
    marks = np.frombuffer(OPEN + AFTER_ROLE + CLOSE, np.uint8)
    for at, begin, size in ((start, 0, len(OPEN)), (start + len(OPEN) + role_size, len(OPEN), len(AFTER_ROLE)), (ends[1:] - len(CLOSE), len(OPEN) + len(AFTER_ROLE), len(CLOSE))):
        out[at[:, None] + np.arange(size)] = marks[begin : begin + size]
    _scatter(out, start + len(OPEN), role_data, role_at[:-1], role_size)
    inner = start + len(OPEN) + role_size + len(AFTER_ROLE)
    _scatter(out, inner, text_data, text_at[:-1], text_size)
    return pa.LargeStringArray.from_buffers(n, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(out)), inner - start, text_size


def _format(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        part = np.cumsum(sizes) // BLOCK
        for first in np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1]))) if len(part) else ():
            own = batch.slice(first, int(np.searchsorted(part, part[first], "right")) - first)
            formatted, begin, size = assemble(own.column("role"), own.column("text"))
            scored = pc.fill_null(pc.equal(own.column("role"), SCORED), False)
            yield pa.RecordBatch.from_arrays([own.column("conv_id"), own.column("turn"), formatted.cast(pa.string()), scored, pa.array(begin), pa.array(size)], ["conv_id", "turn", "formatted", "scored", "text_at", "text_bytes"])


def formatted(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, formatted, scored, text_at, text_bytes (the byte span of the text; under the loss mask if scored) and place.

    Rows are in order of conversation, turn, role and text, within partitions and from one to the next; place tells that order."""
    kinds = {c: conversations.schema[c].dataType.simpleString() for c in ("conv_id", "turn")}
    order = ["conv_id", "turn", "role", "text"]
    rows = conversations.select(*order).repartitionByRange("conv_id", "turn").sortWithinPartitions(*order)
    made = rows.mapInArrow(_format, f"conv_id {kinds['conv_id']}, turn {kinds['turn']}, formatted string, scored boolean, text_at long, text_bytes long")
    return made.withColumn("place", F.monotonically_increasing_id())


def parse(document: str) -> list[tuple[str, str]]:
    """(role, text) of each turn of a formatted conversation."""
    return [(unescaped(m[1]), unescaped(m[2])) for m in _TURN.finditer(document)]


_TURN = re.compile(r"### ((?:[^\\:\n]|\\[\s\S])*):\n((?:(?!\n</turn>\n)(?:[^\\]|\\[\s\S]))*)\n</turn>\n")


def _read_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digests of each conversation from its formatted segments alone, fed one after another."""
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    done: list[list] = [[] for _ in names]
    current, state = object(), None
    kind = None

    def close() -> None:
        if state:
            turns, sha, loss, loss_sha, chars = state
            for column, value in zip(done, (current, turns, sha.hexdigest(), loss, loss_sha.hexdigest(), chars), strict=True):
                column.append(value)

    def ready() -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array(done[0], kind), pa.array(done[1], pa.int64()), pa.array(done[2], pa.string()), pa.array(done[3], pa.int64()), pa.array(done[4], pa.string()), pa.array(done[5], pa.int64())], names)
        for column in done:
            column.clear()
        return out

    for batch in batches:
        kind = batch.schema.field("conv_id").type
        for conv, segment, scored, at, size in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "formatted", "scored", "text_at", "text_bytes")), strict=True):
            if state is None or conv != current:
                close()
                current, state = conv, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
            for role, text in parse(segment):
                state[0] += 1
                state[1].update(f"{role}\n{text}\n".encode())
            if scored:
                text = unescaped(segment.encode()[at : at + size].decode())
                state[2] += len(text)
                state[3].update(text.encode())
            state[4] += len(segment)
        if len(done[0]) > 5000:
            yield ready()
    close()
    if kind is not None:
        yield ready()


def digest(conversations: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256 and formatted_chars of each conversation, read back from the output."""
    kind = conversations.schema["conv_id"].dataType.simpleString()
    segments = formatted(conversations).repartition("conv_id").sortWithinPartitions("conv_id", "place")
    return segments.mapInArrow(_read_back, f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def with_control_strings(conversations: DataFrame) -> DataFrame:
    """The conversations and one more, -7, whose texts look like the template's marks."""
    text = "\\### Assistant: </turn> ok"
    more = conversations.sparkSession.createDataFrame([(-7, 0, "user", text), (-7, 1, "assistant", text)], "conv_id bigint, turn bigint, role string, text string")
    return conversations.select("conv_id", "turn", "role", "text").unionByName(more.select(*(F.col(c).cast(conversations.schema[c].dataType).alias(c) for c in more.columns)))
