"""Chat formatting in windows of a token budget.

Prefix sums of the turns' tokens cut a conversation into turn-aligned spans: a turn belongs to the cell
of width C in which its prefix sum falls, and a turn of more than C tokens is a span by itself, so a
span never holds more than 2 C tokens unless one turn does (turns are never cut). That needs no walk
from window to window, so one long conversation is spread over many tasks. Every window repeats the
system turn and a limited number of turns before its span; the loss mask covers assistant texts where
they are new, so each is a target once.

Texts are escaped: a backslash is doubled, and one goes behind the first character of every control
string, so control strings in a formatted window are the template's own and reading it back is exact.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import arrow_udf

from plumbline.functions.ordered import POSITION, over_neighbours, running_totals
from plumbline.llm import bpe

TURN, STOP = "<|turn|>", "<|stop|>"
# Marks of this template and of common others.
CONTROLS = (
    TURN,
    STOP,
    "<|im_start|>",
    "<|im_end|>",
    "<|startoftext|>",
    "<|endoftext|>",
    "<|user|>",
    "<|assistant|>",
    "<|system|>",
    "<<SYS>>",
    "<</SYS>>",
    "[INST]",
    "[/INST]",
    "<s>",
    "</s>",
)
_CONTROL = re.compile("|".join(f"({re.escape(c[0])})(?={re.escape(c[1:])})" for c in CONTROLS))
_ESCAPED = re.compile(r"\\(.)", re.S)
_TURN = re.compile(rf"{re.escape(TURN)}((?:[^\\\n]|\\.)*)\n(.*?){re.escape(STOP)}\n", re.S)


@dataclass(frozen=True)
class Budget:
    """Tokens of a window, and how much history it repeats."""

    tokens: int = 1024
    history_turns: int = 2
    history_tokens: int = 256
    turn_overhead: int = 4  # tokens of a turn's marks


def escape(text: str) -> str:
    return _CONTROL.sub(lambda m: m[0] + "\\", text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def write_window(turns: list[tuple[str, str, bool]]) -> tuple[str, list[tuple[int, int]]]:
    """Formatted text of (role, text, repeated) turns, and the spans of the loss mask in code points."""
    parts, mask, size = [], [], 0
    for role, text, repeated in turns:
        name = escape(role).replace("\n", "\\\n")  # the first bare line end closes the role
        head, body = f"{TURN}{name}\n", escape(text)
        if role == "assistant" and not repeated and body:
            mask.append((size + len(head), size + len(head) + len(body)))
        parts += [head, body, f"{STOP}\n"]
        size += len(head) + len(body) + len(STOP) + 1
    return "".join(parts), mask


def read_window(formatted: str) -> list[tuple[str, str]]:
    """Role and text of every turn of a formatted window."""
    return [(unescape(m[1]), unescape(m[2])) for m in _TURN.finditer(formatted)]


def windows(
    conversations: DataFrame, tokenizer: Broadcast, budget: Budget = Budget()
) -> DataFrame:
    """``(conv_id, window, n_context, formatted, loss)``, one row per window; windows of a conversation ascend.

    n_context counts the repeated turns at the start. Turns are taken by turn, then role, then text
    (repeated rows stay); NULL turns come first; NULL roles and texts count as empty; rows with a NULL
    conversation form one. Runs jobs while it is called.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = conversations.select(
        "conv_id", "turn", F.coalesce(F.col("role"), F.lit("")).alias("role"), text.alias("text"),
        (F.size(bpe.encoded(text, tokenizer)) + budget.turn_overhead).cast("long").alias("tokens"),
    )
    summed = running_totals(rows, {"n": F.lit(1), "upto": "tokens"}, ["turn", "role", "text"], ["conv_id"])
    placed = summed.withColumn(POSITION, F.col("n") - 1).drop("n", "turn")
    is_system = (F.col(POSITION) == 0) & (F.col("role") == "system")
    systems = placed.where(is_system).select(
        F.col("conv_id").alias("s_conv"), F.col("text").alias("s_text"), F.col("tokens").alias("s_tokens")
    )
    sized = placed.join(systems.drop("s_text"), F.col("conv_id").eqNullSafe(F.col("s_conv")), "left")
    system_tokens = F.coalesce("s_tokens", F.lit(0))
    cell = F.greatest(F.lit(1), F.floor((budget.tokens - budget.history_tokens - system_tokens) / 2)).cast("long")
    before = F.greatest(F.lit(0), F.col("upto") - F.col("tokens") - system_tokens)
    spans = sized.select(
        "conv_id", POSITION, "role", "text", is_system.alias("system"), before.alias("before"),
        (F.floor(before / cell) * 2 + F.when(F.col("tokens") > cell, 1).otherwise(0)).alias("span"),
    )

    def ahead(w):
        out = {}
        for k in range(1, budget.history_turns + 1):
            out[f"span{k}"], out[f"before{k}"] = F.lead("span", k).over(w), F.lead("before", k).over(w)
        return out

    reach = max(1, budget.history_turns)
    near = over_neighbours(spans, ahead, after=reach, keys=["conv_id"])
    own = F.when(F.col("system"), F.coalesce(F.col("span1") if budget.history_turns else F.lit(None), F.lit(0))).otherwise(F.col("span"))
    homes = [F.struct(own.cast("long").alias("window"), F.lit(False).alias("repeated"))]
    for k in range(1, budget.history_turns + 1):
        previous = F.col("span") if k == 1 else F.col(f"span{k - 1}")
        opens = (F.col(f"span{k}") != previous) & (F.col(f"before{k}") - F.col("before") <= budget.history_tokens)
        homes.append(F.when(~F.col("system") & opens, F.struct(F.col(f"span{k}").cast("long").alias("window"), F.lit(True).alias("repeated"))))
    spread = near.select("conv_id", POSITION, "role", "text", "system", F.inline(F.array_compact(F.array(*homes))))

    # The system turn goes to every window but its own, which it opens.
    new = spread.where(~F.col("repeated"))
    opened = new.groupBy("conv_id", "window").agg(F.max("system").alias("has")).where(~F.col("has")).drop("has")
    retained = opened.join(systems, F.col("conv_id").eqNullSafe(F.col("s_conv"))).select(
        "conv_id", F.lit(0).cast("long").alias(POSITION), F.lit("system").alias("role"), F.col("s_text").alias("text"), "window", F.lit(True).alias("repeated")
    )
    turn = F.struct(F.col(POSITION).alias("position"), "repeated", "role", "text")
    grouped = (
        spread.drop("system")
        .unionByName(retained)
        .groupBy("conv_id", "window")
        .agg(F.sort_array(F.collect_list(turn)).alias("turns"), F.count_if("repeated").cast("int").alias("n_context"))
    )
    made = grouped.select("conv_id", "window", "n_context", _written(F.col("turns.role"), F.col("turns.text"), F.col("turns.repeated")).alias("made"))
    return made.select("conv_id", "window", "n_context", "made.formatted", "made.loss")


WINDOW = T.StructType(
    [
        T.StructField("formatted", T.StringType()),
        T.StructField(
            "loss", T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))
        ),
    ]
)


def _written(roles: Column, texts: Column, repeated: Column) -> Column:
    @arrow_udf(WINDOW)
    def write(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for batch in batches:
            made = [write_window(list(zip(*turns))) for turns in zip(*(column.to_pylist() for column in batch))]
            loss = [[{"start": a, "end": b} for a, b in mask] for _, mask in made]
            kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
            yield pa.StructArray.from_arrays([pa.array([m[0] for m in made], pa.string()), pa.array(loss, kind)], names=["formatted", "loss"])

    return write(roles, texts, repeated)


def read_back(made: DataFrame) -> DataFrame:
    """Per conversation, from its windows alone: turns, their digest, loss characters, their digest, size.

    A digest is a running sum over the conversation in order, so its windows pass through one task, one
    at a time; nothing but the running state is held.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        at, state = None, None

        def table(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

        def row(done) -> tuple:
            return done[0], done[1], done[2].hexdigest(), done[3], done[4].hexdigest(), done[5]

        for batch in batches:
            out = []
            for conv, context, formatted, loss in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if state is None or conv != at:
                    if state is not None:
                        out.append(row(state))
                    at, state = conv, [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                turns = read_window(formatted)[context:]
                state[1] += len(turns)
                state[2].update("".join(f"{role}\n{text}\n" for role, text in turns).encode())
                target = "".join(unescape(formatted[s["start"] : s["end"]]) for s in loss)
                state[3] += len(target)
                state[4].update(target.encode())
                state[5] += len(formatted)
            if out:
                yield table(out)
        if state is not None:
            yield table([row(state)])

    ordered = made.repartition("conv_id").sortWithinPartitions("conv_id", "window")
    schema = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    return ordered.select(F.col("conv_id").cast("long").alias("conv_id"), "n_context", "formatted", "loss").mapInArrow(read, schema)
