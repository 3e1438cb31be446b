"""Chat formatting by prefix-target expansion: every assistant turn is an example of its own, whose
context is all turns before it and whose only trainable part is that reply.

A turn is written as ``<|im_start|>role``, a line feed, the text, ``<|im_end|>`` and a line feed.  In roles
and texts a backslash becomes two and ``<|`` becomes ``<\\|``, so a text can never look like the marks and
every escape can be taken back.

The turns of a conversation are written once, one row each, in order, with the turn's formatted text and its start in
the conversation.  ``expand`` writes one row per example: its whole text, which is the text of all turns before the target
and then the target, and the loss mask, which covers the characters of that text from ``loss_start`` to ``loss_end`` and no
others.  So the examples of a conversation take space by the square of its turns; lying next to each other they compress
to little more than what they differ in.  ``digests`` reads what is trained on from the examples' texts alone and
refuses an example whose text is not that of the turns up to its target.

A conversation may hold most rows: rows are range-partitioned on (conversation, turn), places are
counted per partition, and what goes on over a border is carried by one row per partition.  The examples of a long
conversation are made PART turns at a time, each part from the turns up to its end; a task holds the text of one conversation.

Nulls and special cases: a null text or role is empty; a null conversation id is a conversation of its
own; null turns come first; turns with the same number follow in the order of role and text, repeated
rows stay repeated; other roles than ``assistant`` are context only; an empty table gives no rows; other
columns are not written.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from riskfeat.llm.base import partitions

START, END, TARGET = "<|im_start|>", "<|im_end|>", "assistant"
#: Turns of a conversation whose examples are made in one go.
PART = 512
#: Bytes of examples that are handed on at once.
HELD = 4 << 20
TURN = re.compile(re.escape(START) + r"((?:[^\\\n]|\\.)*)\n(.*)" + re.escape(END) + "\n", re.DOTALL)

ROWS = (
    "conv_id bigint, turn bigint, chunk int, n_in_chunk bigint, start_in_chunk bigint, n_chars bigint,"
    " head_chars bigint, is_target boolean, text string"
)


def escaped(col: str, line_feeds: bool = False) -> Column:
    safe = F.replace(F.replace(F.coalesce(F.col(col), F.lit("")), F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))
    return F.replace(safe, F.lit("\n"), F.lit("\\n")) if line_feeds else safe


def unescaped(text: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], text, flags=re.DOTALL) if "\\" in text else text


def _places(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Number and start of every turn among its conversation's turns of this partition."""
    last, number, at = object(), 0, 0
    for b in batches:
        if not len(b):
            continue
        conv = b["conv_id"].astype("Int64")
        ids = conv.fillna(0).to_numpy(np.int64), conv.isna().to_numpy()
        new = np.ones(len(b), bool)
        new[1:] = (ids[0][1:] != ids[0][:-1]) | (ids[1][1:] != ids[1][:-1])
        goes_on = (ids[0][0], ids[1][0]) == last
        new[0] = not goes_on
        n = b["n_chars"].to_numpy(np.int64)
        ends = np.cumsum(n)
        first = np.maximum.accumulate(np.where(new, np.arange(len(b)), 0))
        carried = goes_on & (np.cumsum(new) == 0)
        starts = ends - n - (ends - n)[first] + np.where(carried, at, 0)
        numbers = np.arange(len(b)) - first + np.where(carried, number, 0)
        last, number, at = (ids[0][-1], ids[1][-1]), int(numbers[-1]) + 1, int(starts[-1] + n[-1])
        yield b.assign(n_in_chunk=numbers, start_in_chunk=starts)[[c.split()[0] for c in ROWS.split(",")]]


def write(turns: DataFrame, path: str) -> None:
    """Format ``turns`` (conv_id, turn, role, text) and write one row per turn to ``path``."""
    rows = turns.select(
        F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"), F.coalesce("role", F.lit("")).alias("_role"), F.coalesce("text", F.lit("")).alias("_text"),
    )
    head = F.concat(F.lit(START), escaped("_role", line_feeds=True), F.lit("\n"))
    order = [F.asc_nulls_first("conv_id"), F.asc_nulls_first("turn"), F.asc("_role"), F.asc("_text")]
    ranged = rows.repartitionByRange(partitions(turns.sparkSession), *order).sortWithinPartitions(*order)
    formatted = ranged.select(
        "conv_id", "turn", F.spark_partition_id().alias("chunk"), F.length(head).cast("bigint").alias("head_chars"),
        (F.col("_role") == TARGET).alias("is_target"), F.concat(head, escaped("_text"), F.lit(END + "\n")).alias("text"),
    ).withColumn("n_chars", F.length("text").cast("bigint"))
    formatted.mapInPandas(_places, ROWS).write.mode("overwrite").parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """conv_id, seq, turn, start, n_chars, loss_start, loss_end, text of every turn; the loss columns are
    null where the turn is no example."""
    rows = spark.read.schema(ROWS).parquet(path)
    sums = rows.groupBy("conv_id", "chunk").agg(F.count(F.lit(1)).alias("_n"), F.sum("n_chars").alias("_c"))
    earlier = Window.partitionBy("conv_id").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    carry = sums.select(
        F.col("conv_id").alias("_conv"), F.col("chunk").alias("_chunk"), F.sum("_n").over(earlier).alias("_n"), F.sum("_c").over(earlier).alias("_c")
    ).where(F.col("_n").isNotNull())
    # At most one conversation enters a partition from the one before it.
    on = F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("chunk") == F.col("_chunk"))
    placed = rows.join(F.broadcast(carry), on, "left")
    start = F.col("start_in_chunk") + F.coalesce("_c", F.lit(0))
    tail = len(END) + 1
    return placed.select(
        "conv_id", (F.col("n_in_chunk") + F.coalesce("_n", F.lit(0))).alias("seq"), "turn", start.alias("start"), "n_chars",
        F.when(F.col("is_target"), start + F.col("head_chars")).alias("loss_start"),
        F.when(F.col("is_target"), start + F.col("n_chars") - tail).alias("loss_end"), "text",
    )


EXAMPLES = "conv_id bigint, seq bigint, context_turns bigint, context_chars bigint, text string, loss_start bigint, loss_end bigint"


def _expanded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The examples of each (conv_id, part), whose rows are sorted by seq; ``own`` marks those that end in one."""
    names = [x.split()[0] for x in EXAMPLES.split(",")]
    current, before = None, bytearray()
    done: list[tuple] = []
    held = 0

    def batch() -> pa.RecordBatch:
        conv, seq, start, texts, lo, hi = zip(*done, strict=True)
        whole = pa.array(texts, pa.binary()).cast(pa.string())
        ints = [pa.array(c, pa.int64()) for c in (conv, seq, seq, start, lo, hi)]
        return pa.RecordBatch.from_arrays([*ints[:4], whole, *ints[4:]], names)

    for b in batches:
        columns = [b.column(c).to_pylist() for c in ("conv_id", "part", "seq", "start", "loss_start", "loss_end", "own")]
        texts = b.column("text").cast(pa.binary())
        for k, (conv, part, seq, start, lo, hi, own) in enumerate(zip(*columns, strict=True)):
            if current != (conv, part):
                current, before = (conv, part), bytearray()
            before += texts[k].as_buffer()
            if own:
                done.append((conv, seq, start, bytes(before), lo, hi))
                held += len(before)
            if held > HELD:
                yield batch()
                done, held = [], 0
    if done:
        yield batch()


def examples(rows: DataFrame) -> DataFrame:
    """The examples among the rows of ``read``: turns and characters of the context, the whole text, the mask."""
    # At most one of PART rows is the last of a long conversation.
    last = rows.groupBy("conv_id").agg(F.max("seq").alias("_last")).where(F.col("_last") >= PART).withColumnRenamed("conv_id", "_conv")
    known = rows.join(F.broadcast(last), F.col("conv_id").eqNullSafe(F.col("_conv")), "left")
    own = F.floor(F.col("seq") / PART).cast("int")
    parts = F.sequence(own, F.floor(F.coalesce("_last", F.lit(0)) / PART).cast("int"))
    dealt = known.select(
        "conv_id", "seq", "start", "text", "loss_start", "loss_end", own.alias("_part"), F.explode(parts).alias("part"),
    ).withColumn("own", (F.col("part") == F.col("_part")) & F.col("loss_start").isNotNull()).drop("_part")
    ordered = dealt.repartition(partitions(rows.sparkSession), "conv_id", "part").sortWithinPartitions("conv_id", "part", "seq")
    return ordered.mapInArrow(_expanded, EXAMPLES)


def expand(rows: DataFrame, path: str) -> DataFrame:
    """Write the ``examples`` of ``read``'s rows to ``path``, one row each, and read them back."""
    examples(rows).write.mode("overwrite").parquet(path, compression="zstd")
    return rows.sparkSession.read.schema(EXAMPLES).parquet(path)


def render(rows: DataFrame, chosen: DataFrame) -> DataFrame:
    """conv_id, seq, text, loss_start, loss_end of the ``chosen`` (conv_id, seq) examples of ``read``'s rows."""
    wanted = chosen.select(F.col("conv_id").alias("_c"), F.col("seq").alias("_s"), F.lit(True).alias("_wanted")).distinct()
    same_conversation = F.col("conv_id").eqNullSafe(F.col("_c"))
    met = rows.join(wanted.select("_c"), same_conversation, "left_semi").join(wanted, same_conversation & (F.col("seq") == F.col("_s")), "left")
    whole = examples(met.withColumn("loss_start", F.when(F.col("_wanted"), F.col("loss_start"))))
    return whole.select("conv_id", "seq", "text", "loss_start", "loss_end")


DIGESTS = (
    "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint,"
    " n_examples bigint, example_chars bigint"
)


class _Conversation:
    def __init__(self, conv_id: int | None) -> None:
        self.conv_id = conv_id
        self.turns, self.loss, self.formatted = hashlib.sha256(), hashlib.sha256(), hashlib.sha256()
        self.n_turns = self.loss_chars = self.chars = self.n_examples = self.example_chars = 0
        self.before = 0, 0

    def add(self, text: str) -> None:
        m = TURN.fullmatch(text)
        if m is None:
            raise ValueError(f"a turn of conversation {self.conv_id} is not in the format")
        role, said = unescaped(m[1]), unescaped(m[2])
        self.turns.update(f"{role}\n{said}\n".encode())
        self.before = self.n_turns, self.chars
        self.formatted.update(text.encode())
        self.n_turns += 1
        self.chars += len(text)

    def example(self, prefix: tuple[int, int], chars: int, sha256: str, trained: str) -> None:
        """The example that ends with the last turn: its text by length and digest, and what its mask covers."""
        if prefix != self.before or (chars, sha256) != (self.chars, self.formatted.hexdigest()):
            raise ValueError(f"an example of conversation {self.conv_id} does not follow its context")
        trained = unescaped(trained)
        self.loss.update(trained.encode())
        self.loss_chars += len(trained)
        self.n_examples += 1
        self.example_chars += chars

    def row(self) -> tuple:
        return (self.conv_id, self.n_turns, self.turns.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars, self.n_examples, self.example_chars)


def _digest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names = [x.split()[0] for x in DIGESTS.split(",")]

    def frame(done: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(done, columns=names).astype({"conv_id": "Int64"})

    current = None
    for b in batches:
        done = []
        place = (b[c].astype("Int64") for c in ("context_turns", "context_chars", "chars"))
        for conv_id, text, sha256, *of_example in zip(b["conv_id"].astype(object), b["text"], b["sha256"], *place, strict=True):
            conv_id = None if pd.isna(conv_id) else int(conv_id)
            if current is None or current.conv_id != conv_id:
                if current is not None:
                    done.append(current.row())
                current = _Conversation(conv_id)
            if pd.isna(of_example[0]):
                current.add(text)
            else:
                turns, start, chars = map(int, of_example)
                current.example((turns, start), chars, sha256, text)
        yield frame(done)
    if current is not None:
        yield frame([current.row()])


def digests(rows: DataFrame, expanded: DataFrame | None = None) -> DataFrame:
    """Per conversation of ``read``: the turns parsed back from the formatted text, the loss from its examples
    (``expanded``, by default those of ``rows``).

    An example's text is read where it lies; what goes on is its length, its digest and the characters under its mask.
    A digest runs over a conversation's turns one after the other, so they are streamed through one task;
    it keeps three hash states and one turn, whatever their number.
    """
    expanded = examples(rows) if expanded is None else expanded
    of_example = {"context_turns": "bigint", "context_chars": "bigint", "chars": "bigint", "sha256": "string"}
    turns = rows.select("conv_id", "seq", "text", *[F.lit(None).cast(t).alias(c) for c, t in of_example.items()])
    masked = F.substring(F.col("text"), (F.col("loss_start") + 1).cast("int"), (F.col("loss_end") - F.col("loss_start")).cast("int"))
    trained = expanded.select(
        "conv_id", "seq", masked.alias("text"), "context_turns", "context_chars", F.length("text").cast("bigint").alias("chars"), F.sha2("text", 256).alias("sha256")
    )
    both = turns.unionByName(trained)
    ordered = both.repartition(partitions(rows.sparkSession), "conv_id").sortWithinPartitions("conv_id", "seq", F.asc_nulls_first("context_turns"))
    return ordered.select("conv_id", "text", *of_example).mapInPandas(_digest, DIGESTS)
