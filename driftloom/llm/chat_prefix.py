"""Chat formatting by prefix-target expansion.

Every assistant turn becomes an example of its own: all turns before it are the context, and only its text is trainable.
Turns after the last assistant turn (or all turns, where there is none) become one more example without a target, so that
the formatted output holds every turn and can be read back.

Template: <|im_start|>ROLE, a line feed, TEXT, <|im_end|>, a line feed. Inside roles and texts "<", any number of "~", "|"
gets one more "~", which reading takes away again; a role's back-slashes and line feeds are written \\\\ and \\n.

Turns are taken in the order of turn (null first), role, text; nulls in role and text are empty. Rows with a null conv_id
are one conversation. Repeated rows are repeated turns. Memory holds one conversation's formatted turns at a time.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches

START, END = "<|im_start|>", "<|im_end|>\n"
EXAMPLES = "conv_id long, example long, text string, loss_start long, loss_end long"


def escape(text: str) -> str:
    return re.sub(r"<(~*)\|", r"<~\1|", text)


def unescape(text: str) -> str:
    return re.sub(r"<~(~*)\|", r"<\1|", text)


def escape_role(role: str) -> str:
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role))


def _rows(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)


def _batched(rows: Iterable[tuple], names: list[str], kinds: list[pa.DataType]) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += sum(len(x) for x in row if isinstance(x, str))
        if len(held) >= 2000 or size >= 1 << 22:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held, strict=True), kinds, strict=True)], names)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held, strict=True), kinds, strict=True)], names)


def expand(turns: Iterable[tuple]) -> Iterator[tuple]:
    """Sorted (conv_id, role, text) to examples; loss_start and loss_end are null where nothing is trainable."""
    now, context, number, open_turns = object(), "", 0, False
    for conv, role, text in turns:
        if conv != now:
            if open_turns:
                yield now, number, context, None, None
            now, context, number, open_turns = conv, "", 0, False
        head, body = f"{START}{escape_role(role)}\n", escape(text)
        if role == "assistant":
            at = len(context) + len(head)
            context += head + body + END
            yield conv, number, context, at, at + len(body)
            number, open_turns = number + 1, False
        else:
            context += head + body + END
            open_turns = True
    if open_turns:
        yield now, number, context, None, None


def format_conversations(conversations: DataFrame) -> DataFrame:
    """Examples as EXAMPLES; those of a conversation lie together and in order. Loss positions count code points."""
    small_batches(conversations.sparkSession)
    turns = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
        F.col("turn").alias("turn"),
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = ((conv, role, text) for conv, role, text, _ in _rows(batches))
        return _batched(expand(rows), ["conv_id", "example", "text", "loss_start", "loss_end"], [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64()])

    return turns.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").mapInArrow(run, EXAMPLES)


def turns_of(text: str) -> list[tuple[str, str]]:
    """The (role, text) turns of an example."""
    out = []
    for part in text.split(START)[1:]:
        role, _, body = part.partition("\n")
        out.append((unescape_role(role), unescape(body.removesuffix(END))))
    return out


def read_back(examples: Iterable[tuple]) -> Iterator[tuple]:
    """Digests of each conversation, from its examples alone."""

    def closed() -> tuple:
        turns = turns_of(last)
        whole = "".join(f"{role}\n{text}\n" for role, text in turns)
        return now, len(turns), hashlib.sha256(whole.encode("utf-8", "surrogatepass")).hexdigest(), loss_chars, loss.hexdigest(), chars

    now, last, loss, loss_chars, chars = object(), None, None, 0, 0
    for conv, _, text, start, end in examples:
        if conv != now:
            if last is not None:
                yield closed()
            now, loss, loss_chars, chars = conv, hashlib.sha256(), 0, 0
        last = text  # the last example holds all turns
        chars += len(text)
        if start is not None:
            target = unescape(text[start:end])
            loss_chars += len(target)
            loss.update(target.encode("utf-8", "surrogatepass"))
    if last is not None:
        yield closed()


def conversation_digests(examples: DataFrame, arranged: bool = False) -> DataFrame:
    """Read examples back. arranged: a conversation's examples already lie together and in order, as the formatter leaves them."""
    rows = examples.select("conv_id", "example", "text", "loss_start", "loss_end")
    if not arranged:
        rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", "example")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        return _batched(read_back(_rows(batches)), names, [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()])

    return rows.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
