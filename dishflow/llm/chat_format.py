"""Chat formatting by prefix-target expansion.

Every assistant turn becomes an example of its own: all turns before it are context, written out again in each example,
and only its text is trainable. So what is written grows with the square of a conversation's length (README has
figures). Examples of a conversation follow each other in a file and Parquet keeps of each only what the one before
doesn't begin with, so the disk doesn't grow that way; a long conversation is expanded by many tasks, a block of
examples in each. Turns after the last assistant turn, context of none, are kept as they are.

Results are read back from the written examples: each gives the turns that the one before doesn't have, its loss span
and the hash of its whole text, which has to be that of all turns up to its own.

Template: STX role LF text ETX. In texts and roles SO stands for an escape: STX, ETX and SO inside, and LF in roles,
become SO + one letter, so a turn can't be forged by what it says.

Defined cases: null text or role is empty; turns of equal number follow each other by role and text; null turns come
first; all rows with a null conv_id are one conversation; conversations without assistant turns have no examples but keep
their turns; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dishflow.llm.common import materialise, row_reader, shuffle_partitions

STX, ETX, ESC = "\x02", "\x03", "\x0e"
_OUT = {STX: ESC + "b", ETX: ESC + "e", ESC: ESC + "n", "\n": ESC + "l"}
_IN = {v: k for k, v in _OUT.items()}
_OUT_RE, _ROLE_RE, _IN_RE = re.compile(f"[{STX}{ETX}{ESC}]"), re.compile(f"[{STX}{ETX}{ESC}\n]"), re.compile(f"{ESC}[benl]")


def escape(x: str, role: bool = False) -> str:
    return (_ROLE_RE if role else _OUT_RE).sub(lambda m: _OUT[m[0]], x)


def unescape(x: str) -> str:
    return _IN_RE.sub(lambda m: _IN[m[0]], x)


def format_turn(role: str, text: str) -> tuple[str, int]:
    """The turn's piece, and where its text begins there."""
    head = f"{STX}{escape(role, role=True)}\n"
    return f"{head}{escape(text)}{ETX}", len(head)


def read_turn(piece: str) -> tuple[str, str]:
    head, _, text = piece[1:-1].partition("\n")
    return unescape(head), unescape(text)


PIECES = "conv_id long, turn_no long, piece string, char_start long, char_end long, example long, loss_start long, loss_end long, since long"
EXAMPLES = "conv_id long, example long, formatted string, loss_start long, loss_end long"
READ = "conv_id long, turn_no long, piece string, char_start long, char_end long, loss_start long, loss_end long, whole string"
DIGESTS = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_examples long"
BLOCK = 64  # examples of a conversation that one task writes
CHARS = 4_000_000  # of a batch of examples; a longer one is a batch of its own
#: Parquet's incremental encoding: of a text, what the one before it doesn't begin with.
FRONT_CODED = {"parquet.writer.version": "PARQUET_2_0", "parquet.enable.dictionary": "false"}


def batch_of(rows: list[tuple], schema: str) -> pa.RecordBatch:
    names, kinds = zip(*(x.split() for x in schema.split(", ")), strict=True)
    types = [pa.string() if x == "string" else pa.int64() for x in kinds]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)


def format_conversations(turns: DataFrame) -> DataFrame:
    """A row for each turn, conversations together and turns in order: conv_id, turn_no (from 0), piece, its place
    char_start..char_end in the conversation's formatted text, and for assistant turns the number of their example and
    the span loss_start..loss_end that it trains; all before loss_start is its context. since: the first example that has
    the turn (as many as there are, if none has)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key: object = run
        no = at = example = 0
        for batch in batches:
            rows = []
            for conv_id, role, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if conv_id != key:
                    key, no, at, example = conv_id, 0, 0, 0
                piece, head = format_turn(role, text)
                trained = role == "assistant"
                rows.append((conv_id, no, piece, at, at + len(piece), example if trained else None, at + head if trained else None, at + len(piece) - 1 if trained else None, example))
                no, at, example = no + 1, at + len(piece), example + trained
            if rows:
                yield batch_of(rows, PIECES)

    own = turns.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", *(F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("role", "text")))
    dealt = own.repartition(shuffle_partitions(turns.sparkSession), "conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return dealt.select("conv_id", "role", "text").mapInArrow(run, PIECES)


def counted(pieces: DataFrame) -> DataFrame:
    """Pieces with the number of examples of their conversation."""
    of = pieces.groupBy(F.col("conv_id").alias("c")).agg(F.count("example").alias("examples"))
    return pieces.join(of, F.col("c").eqNullSafe(F.col("conv_id"))).drop("c")


def expand(pieces: DataFrame) -> DataFrame:
    """conv_id, example, formatted, loss_start, loss_end: examples in full, context repeated in each, those of a block in
    order. A piece goes to all blocks from its first example's on; a task holds one example and a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key: object = run
        text, rows, chars = "", [], 0
        for batch in batches:
            cols = [batch.column(x).to_pylist() for x in ("conv_id", "block", "piece", "example", "loss_start", "loss_end")]
            for conv_id, block, piece, example, loss_start, loss_end in zip(*cols, strict=True):
                if (conv_id, block) != key:
                    key, text = (conv_id, block), ""
                text += piece
                if example is None or example // BLOCK != block:
                    continue
                if rows and chars + len(text) > CHARS:
                    yield batch_of(rows, EXAMPLES)
                    rows, chars = [], 0
                rows.append((conv_id, example, text, loss_start, loss_end))
                chars += len(text)
        if rows:
            yield batch_of(rows, EXAMPLES)

    number = lambda c: F.floor(c / BLOCK)
    within = counted(pieces).where("since < examples")
    placed = within.select("conv_id", F.explode(F.sequence(number(F.col("since")), number(F.col("examples") - 1))).alias("block"), "turn_no", "piece", "example", "loss_start", "loss_end")
    dealt = placed.repartition(shuffle_partitions(pieces.sparkSession), "conv_id", "block").sortWithinPartitions("conv_id", "block", "turn_no")
    return dealt.mapInArrow(run, EXAMPLES)


def own_turns(formatted: str, loss_start: int) -> tuple[int, int]:
    """Where the turns begin that the example before doesn't have, and the number of the first of them."""
    head = f"{STX}assistant\n"
    if not formatted.startswith(head, loss_start - len(head)) or not formatted.endswith(ETX):
        raise ValueError("an example doesn't end with the turn that it trains")
    at = formatted.rfind(head, 0, loss_start - len(head))
    begin = 0 if at < 0 else formatted.index(ETX, at) + 1
    return begin, formatted.count(STX, 0, begin)


def read_examples(examples: DataFrame) -> DataFrame:
    """The turns that each written example adds, as pieces; its last one has the loss span and the hash of the whole."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for conv_id, text, loss_start, loss_end in zip(*(batch.column(x).to_pylist() for x in ("conv_id", "formatted", "loss_start", "loss_end")), strict=True):
                at, no = own_turns(text, loss_start)
                for piece in text[at:].split(ETX)[:-1]:
                    end = at + len(piece) + 1
                    last = end == len(text)
                    rows.append((conv_id, no, piece + ETX, at, end, *((loss_start, loss_end, hashlib.sha256(text.encode()).hexdigest()) if last else (None, None, None))))
                    at, no = end, no + 1
            if rows:
                yield batch_of(rows, READ)

    return examples.mapInArrow(run, READ)


def digests(pieces: DataFrame) -> DataFrame:
    """One row for each conversation, from its pieces. Where they have whole, the hash of an example, all pieces up to
    there must be that example."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key: object = run
        state: list = []

        def row() -> tuple:
            n, turns, chars, loss, end, examples, _ = state
            return (key, n, turns.hexdigest(), chars, loss.hexdigest(), end, examples)

        for batch in batches:
            rows = []
            cols = [batch.column(x).to_pylist() for x in ("conv_id", "piece", "char_start", "char_end", "loss_start", "loss_end", "whole")]
            for conv_id, piece, start, end, loss_start, loss_end, whole in zip(*cols, strict=True):
                if conv_id != key:
                    if key is not run:
                        rows.append(row())
                    key, state = conv_id, [0, hashlib.sha256(), 0, hashlib.sha256(), 0, 0, hashlib.sha256()]
                role, text = read_turn(piece)
                state[0] += 1
                state[1].update(f"{role}\n{text}\n".encode())
                state[4] = end
                state[6].update(piece.encode())
                if loss_start is not None:
                    trained = unescape(piece[loss_start - start : loss_end - start])
                    state[2] += len(trained)
                    state[3].update(trained.encode())
                    state[5] += 1
                if whole is not None and whole != state[6].hexdigest():
                    raise ValueError(f"an example of conversation {conv_id} isn't its turns up to {state[0]}")
            if rows:
                yield batch_of(rows, DIGESTS)
        if key is not run:
            yield batch_of([row()], DIGESTS)

    own = pieces if "whole" in pieces.columns else pieces.withColumn("whole", F.lit(None).cast("string"))
    dealt = own.repartition(shuffle_partitions(pieces.sparkSession), "conv_id").sortWithinPartitions("conv_id", "turn_no")
    return dealt.mapInArrow(run, DIGESTS)


def format_and_read_back(turns: DataFrame) -> DataFrame:
    """Digests of what the written examples say, and the turns after them."""
    pieces = materialise(format_conversations(turns))
    examples = materialise(expand(pieces), FRONT_CODED)
    with row_reader(turns.sparkSession):
        read = materialise(read_examples(examples))
    rest = counted(pieces).where("since = examples").withColumn("whole", F.lit(None).cast("string"))
    return digests(read.unionByName(rest.select(read.columns)))
