"""Chat formatting by prefix-target expansion.

Every assistant turn becomes an example of its own: all turns before it are the context and only the reply is trainable.
Examples of one conversation share their contexts, so a conversation is formatted once, as segments with their places,
and an example is a prefix of it with the place of its reply. Output grows with the turns, however long a conversation
is; render() writes examples out in full.

Template: `<s>[INST] role\\ntext [/INST]` for turns that are context only, `<s> text </s>` for replies. A control string
in a text gets a backslash after its first character, and one that has backslashes there already gets one more, so the
text can be restored exactly. Roles have backslashes and line ends written as \\\\ and \\n.

A conversation's turns reach one task in order and are formatted and hashed one by one: memory holds a batch of them.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronofact.llm.text import named
from chronofact.session import stored

REPLY = "assistant"
_RAW = re.compile(r"([<\[])(\\*)(/?s>|/?INST\])")
_ESCAPED = re.compile(r"([<\[])\\(\\*)(/?s>|/?INST\])")
_CONTEXT = re.compile(r"<s>\[INST\] ([^\n]*)\n(.*) \[/INST\]", re.DOTALL)
_ANSWER = re.compile(r"<s> (.*) </s>", re.DOTALL)


def escape(text: str) -> str:
    return _RAW.sub(r"\1\\\2\3", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1\2\3", text)


def segment(role: str, text: str) -> tuple[str, int, int]:
    """A formatted turn, and where its text starts and ends in it."""
    body = escape(text)
    if role == REPLY:
        head, tail = "<s> ", " </s>"
    else:
        name = escape(role.replace("\\", "\\\\").replace("\n", "\\n"))
        head, tail = f"<s>[INST] {name}\n", " [/INST]"
    return head + body + tail, len(head), len(head) + len(body)


def parse(formatted: str) -> tuple[str, str]:
    """role and text of a formatted turn."""
    if m := _CONTEXT.fullmatch(formatted):
        name = re.sub(r"\\(.)", lambda x: {"n": "\n"}.get(x[1], x[1]), unescape(m[1]))
        return name, unescape(m[2])
    if m := _ANSWER.fullmatch(formatted):
        return REPLY, unescape(m[1])
    raise ValueError("not a formatted turn")


def format_turns(turns: DataFrame) -> DataFrame:
    """conv_id, position (from 0), example (its number, for replies), segment, at (its place in the formatted
    conversation), target_start and target_end (of a reply's text there); stored. Places count code points.

    Turns are ordered by turn, then role and text; null turns come first. Null roles and texts are empty. Repeated rows are
    turns of their own, and rows without a conv_id make one conversation. An empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv: object = ()
        position = example = at = 0
        for b in batches:
            rows = []
            for conv_id, role, text in zip(*(b.column(c).to_pylist() for c in ("conv_id", "role", "text")), strict=True):
                if conv_id != conv or isinstance(conv, tuple):
                    conv, position, example, at = conv_id, 0, 0, 0
                seg, a, z = segment(role, text)
                reply = role == REPLY
                rows.append((conv_id, position, example if reply else None, seg, at, at + a if reply else None, at + z if reply else None))
                position, example, at = position + 1, example + reply, at + len(seg)
            if rows:
                yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    names = ["conv_id", "position", "example", "segment", "at", "target_start", "target_end"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64()]
    rows = named(turns, "conv_id", "turn", "role", "text").withColumn("conv_id", F.col("conv_id").cast("long"))
    rows = rows.fillna("", ["role", "text"]).repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    schema = "conv_id long, position long, example long, segment string, at long, target_start long, target_end long"
    return stored(turns.sparkSession, rows.mapInArrow(run, schema), "chat")


def examples(formatted: DataFrame) -> DataFrame:
    """An example for each reply: conv_id, example (its number), position (of the reply), context_end, target_start, target_end. The context
    is the formatted conversation's prefix [0, context_end), all turns before; of the reply [target_start, target_end) is trainable."""
    return formatted.where("example IS NOT NULL").select("conv_id", "example", "position", F.col("at").alias("context_end"), "target_start", "target_end")


def render(formatted: DataFrame) -> DataFrame:
    """Examples in full: conv_id, example, text (all segments up to the reply) and the span of the reply in it. What it
    writes grows with the square of a conversation's turns; that is the form itself."""
    parts = formatted.select(F.col("conv_id").alias("c"), F.col("position").alias("p"), "segment")
    rows = examples(formatted).join(parts, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("p") <= F.col("position")))
    rows = rows.groupBy("conv_id", "example", "target_start", "target_end").agg(F.sort_array(F.collect_list(F.struct("p", "segment"))).alias("s"))
    return rows.select("conv_id", "example", F.array_join("s.segment", "").alias("text"), "target_start", "target_end")


def read_back(formatted: DataFrame, expanded: DataFrame | None = None) -> DataFrame:
    """A row for each formatted conversation: conv_id, n_turns, turns_sha256 (role, line end, text, line end for each turn), loss_chars and
    loss_sha256 (texts under the loss masks of its examples, in order), formatted_chars, n_examples.

    expanded: the examples, of formatted itself if not given. Each is held to its conversation: its context must end where the turns
    before it do, and its reply must lie in the next turn."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv: object = ()
        turns, loss = hashlib.sha256(), hashlib.sha256()
        n = loss_chars = chars = n_examples = 0
        last, last_at = "", 0

        def close() -> tuple:
            return conv, n, turns.hexdigest(), loss_chars, loss.hexdigest(), chars, n_examples

        for b in batches:
            rows = []
            for conv_id, context_end, seg, at, start, end in zip(*(b.column(c).to_pylist() for c in ("conv_id", "context_end", "segment", "at", "target_start", "target_end")), strict=True):
                if conv_id != conv or isinstance(conv, tuple):
                    if not isinstance(conv, tuple):
                        rows.append(close())
                    conv, n, loss_chars, chars, n_examples, last = conv_id, 0, 0, 0, 0, None
                    turns, loss = hashlib.sha256(), hashlib.sha256()
                if context_end is None:  # a turn
                    role, text = parse(seg)
                    turns.update(f"{role}\n{text}\n".encode())
                    last, last_at = seg, at
                    n, chars = n + 1, chars + len(seg)
                    continue
                if last is None or context_end != last_at or not last_at <= start <= end <= last_at + len(last):
                    raise ValueError(f"an example of conversation {conv_id} doesn't follow its context")
                masked = unescape(last[start - last_at : end - last_at])
                loss.update(masked.encode())
                loss_chars, n_examples = loss_chars + len(masked), n_examples + 1
            if rows:
                yield batch(rows)
        if not isinstance(conv, tuple):
            yield batch([close()])

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
        return pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "n_examples"]
    nothing = lambda c, kind: F.lit(None).cast(kind).alias(c)
    own = formatted.select("conv_id", "position", nothing("context_end", "long"), "segment", "at", nothing("target_start", "long"), nothing("target_end", "long"))
    expanded = examples(formatted) if expanded is None else expanded
    each = expanded.select("conv_id", "position", "context_end", nothing("segment", "string"), nothing("at", "long"), "target_start", "target_end")
    rows = own.unionByName(each).repartition("conv_id").sortWithinPartitions("conv_id", "position", F.col("context_end").isNotNull())
    return rows.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_examples long")
