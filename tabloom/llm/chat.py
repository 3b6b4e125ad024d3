"""Chat formatting in budgeted, turn-aligned windows."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabloom.operators.running import totals_before

from .bpe import encoder
from .common import stage

_OPEN, _CLOSE = "###", "</turn>"
_TURN = re.compile(r"### ((?:[^\\:]++|\\.)*+): ((?:[^\\<]++|\\.|<(?!/turn>))*+)</turn>\n", re.S)     # possessive: a damaged turn fails at once
_ESCAPED = re.compile(r"\\(.)", re.S)
WINDOW_SCHEMA = ("conv_id long, window long, text string, tokens long, over_budget boolean, context_turns int, "
                 "loss array<struct<begin:int,end:int>>")
_RUN_BITS = 17                # rows numbered by one task at a time


def escape(text: str) -> str:
    """Text without bare control strings: a backslash goes before each, and before each backslash."""
    return text.replace("\\", "\\\\").replace(_OPEN, "\\" + _OPEN).replace(_CLOSE, "\\" + _CLOSE)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text) if "\\" in text else text


def format_turn(role: str, text: str) -> tuple[str, int, int]:
    """(formatted turn, begin, end of its text inside)."""
    head = f"{_OPEN} {escape(role).replace(':', chr(92) + ':')}: "
    body = escape(text)
    return f"{head}{body}{_CLOSE}\n", len(head), len(head) + len(body)


def parse(text: str) -> list[tuple[str, str]]:
    """(role, text) of every turn of a formatted window."""
    turns, at = [], 0
    while at < len(text):
        m = _TURN.match(text, at)
        if m is None:
            raise ValueError(f"no turn at character {at}")
        turns.append((unescape(m[1]), unescape(m[2])))
        at = m.end()
    return turns


def _token_counts(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = encoder(path).encode([format_turn(r, t)[0] for r, t in
                                        zip(batch.column("role").to_pylist(), batch.column("text").to_pylist())])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([len(x) // 4 for x in ids], pa.int64())],
                                             names=[*batch.schema.names, "tokens"])
    return run


def fill_windows(turns: list[dict], system: dict | None, budget: int, history: int) -> list[dict]:
    """Windows over one block's turns (oldest first, repeated ones before fresh ones).

    Each window holds the system turn, up to ``history`` tokens of the turns before
    its span, and a span of fresh turns cut by prefix sums to what is left of the
    budget. The first fresh turn comes before history; one that doesn't fit with
    the system turn stands alone with it (over budget). Turns are never split.
    """
    ends = np.cumsum([0] + [t["tokens"] for t in turns])
    out, i = [], next(i for i, t in enumerate(turns) if t["fresh"])
    while i < len(turns):
        lead = [] if system is None or turns[i]["row"] == system["row"] else [system]
        room = budget - sum(t["tokens"] for t in lead)
        h = i
        while h > 0 and ends[i] - ends[h - 1] <= history and not (system and turns[h - 1]["row"] == system["row"]):
            h -= 1
        while h < i and ends[i + 1] - ends[h] > room:
            h += 1
        j = max(i + 1, int(np.searchsorted(ends, ends[h] + room, side="right")) - 1)
        out.append({"context": lead + turns[h:i], "fresh": turns[i:j]})
        i = j
    return out


def _windows(budget: int, history: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        loss_type = pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32())]))
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.bool_(), pa.int32(), loss_type]
        names = ["conv_id", "window", "text", "tokens", "over_budget", "context_turns", "loss"]
        for batch in batches:
            rows = []
            for block in batch.to_pylist():
                turns = sorted(block["turns"], key=lambda t: t["row"])
                for w in fill_windows(turns, block["system"], budget, history):
                    text, at, loss = [], 0, []
                    for k, t in enumerate(w["context"] + w["fresh"]):
                        turn, begin, end = format_turn(t["role"], t["text"])
                        if k >= len(w["context"]) and t["role"] == "assistant":
                            loss.append({"begin": at + begin, "end": at + end})
                        text.append(turn)
                        at += len(turn)
                    tokens = sum(t["tokens"] for t in w["context"] + w["fresh"])
                    rows.append((block["conv_id"], w["fresh"][0]["row"], "".join(text), tokens, tokens > budget, len(w["context"]), loss))
            columns = zip(*rows) if rows else [[]] * 7
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds)], names=names)
    return run


def format_conversations(conversations: DataFrame, path: str, budget: int = 1024, history: int = 256) -> DataFrame:
    """Windows of formatted text over conversations (conv_id, turn, role, text).

    Turn tokens (of the formatted turn, by the BPE file at ``path``) are summed up
    along each conversation by distributed prefix sums. Every multiple of
    ``budget - history`` begins a block of turns, and blocks are filled on their
    own (``fill_windows``), so a conversation of any length is worked on by many
    tasks. Each window repeats the first turn if its role is system, and at most
    ``history`` (less than half the budget) tokens of earlier turns. ``loss`` has the spans of
    assistant texts (in characters of ``text``) that are new in the window:
    repeated ones are masked, so each target counts once.

    Returns conv_id, window (ascending in a conversation), text, tokens,
    over_budget, context_turns (repeated turns at the front), loss. Null texts and
    roles are empty, a null conv_id is a conversation, a null turn comes first,
    ties of a turn go by role and text, repeated rows are repeated turns, further
    columns are ignored, an empty table gives an empty result.
    """
    stride = budget - history
    if not 0 <= history < stride:
        raise ValueError("history must be less than half the budget")
    tasks = int(conversations.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    turns = (conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
                                  F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
             .repartitionByRange(tasks, "conv_id", "turn").sortWithinPartitions("conv_id", "turn", "role", "text")
             .mapInArrow(_token_counts(path), "conv_id long, turn long, role string, text string, tokens long")
             .withColumn("row", F.monotonically_increasing_id())
             .withColumn("run", F.shiftright("row", _RUN_BITS)))
    # rows ascend along a conversation, whichever of the range partitions it spans
    turns = stage(totals_before(stage(turns), ["conv_id"], "run", [F.col("row")], F.col("tokens"), "start"))
    block = F.floor(F.col("start") / stride).cast("long")
    fields = F.struct("row", "role", "text", "tokens", "fresh")
    fresh = turns.withColumn("block", block).withColumn("fresh", F.lit(True))
    earlier = (turns.withColumn("block", F.floor((F.col("start") + history) / stride).cast("long"))
               .where(F.col("block") > block).withColumn("fresh", F.lit(False)))
    blocks = (fresh.unionByName(earlier).groupBy("conv_id", "block")
              .agg(F.collect_list(fields).alias("turns"), F.max("fresh").alias("any")).where("any").drop("any"))
    system = (turns.where((F.col("start") == 0) & (F.col("role") == "system"))
              .select(F.col("conv_id").alias("__conv"), F.struct("row", "role", "text", "tokens").alias("system")))
    return (blocks.join(system, F.col("conv_id").eqNullSafe(F.col("__conv")), "left")
            .select("conv_id", "turns", "system").mapInArrow(_windows(budget, history), WINDOW_SCHEMA))


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    rows, now = [], None

    def done():
        rows.append((now["conv_id"], now["turns"], now["all"].hexdigest(), now["loss_chars"], now["loss"].hexdigest(), now["chars"]))

    def batch_of():
        out = pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows), kinds)], names=names)
        rows.clear()
        return out

    for batch in batches:
        for w in batch.to_pylist():
            if now is None or w["conv_id"] != now["conv_id"]:
                if now is not None:
                    done()
                now = {"conv_id": w["conv_id"], "turns": 0, "all": hashlib.sha256(), "loss_chars": 0, "loss": hashlib.sha256(), "chars": 0}
            for role, text in parse(w["text"])[w["context_turns"]:]:
                now["turns"] += 1
                now["all"].update(f"{role}\n{text}\n".encode())
            for span in w["loss"]:
                target = unescape(w["text"][span["begin"]:span["end"]])
                now["loss_chars"] += len(target)
                now["loss"].update(target.encode())
            now["chars"] += len(w["text"])
        if rows:
            yield batch_of()
    if now is not None:
        done()
        yield batch_of()


def conversation_digests(windows: DataFrame) -> DataFrame:
    """What each conversation's windows hold, read back from their text and spans.

    A hash over a conversation is sequential, so one task reads all windows of a
    conversation, sorted and one at a time: its memory doesn't grow with them.
    """
    return (windows.select("conv_id", "window", "text", "context_turns", "loss")
            .repartition("conv_id").sortWithinPartitions("conv_id", "window")
            .mapInArrow(_digests, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, "
                                  "formatted_chars long"))
