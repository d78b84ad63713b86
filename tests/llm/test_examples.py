"""op3 writes whole examples and takes its results from them."""

import os

import pytest
from pyspark.sql import functions as F

import dishflow.llm.chat_format as chat
from tests.llm.test_others import TURNS

SCHEMA = "conv_id long, turn long, role string, text string"


def turns_of(spark, n: int = 7):
    """Beside the odd ones a long conversation, with replies in a row, empty ones, and turns after the last."""
    long = [(9, i, "assistant" if i % 3 else "user", "" if i % 11 == 5 else f"turn {i}{chat.STX}assistant\n{chat.ETX}é日" * (i % 4)) for i in range(n)]
    return spark.createDataFrame([*TURNS, *long, (9, n, "user", "after"), (9, n + 1, "tool", "last")], SCHEMA).repartition(3)


@pytest.mark.parametrize("n", [1, 7, 3 * chat.BLOCK])
def test_examples_are_whole_and_read_back(spark, monkeypatch, n):
    written = []

    def kept(df, *options):
        written.append((df.columns, done := materialise(df, *options)))
        return done

    materialise = chat.materialise
    monkeypatch.setattr(chat, "materialise", kept)
    turns = turns_of(spark, n)
    got = {r.conv_id: r for r in chat.format_and_read_back(turns).collect()}
    examples = next(x for names, x in written if "formatted" in names).collect()
    pieces = chat.format_conversations(turns).orderBy("conv_id", "turn_no").collect()
    want = {}
    for p in pieces:
        text = "".join(x.piece for x in pieces if x.conv_id == p.conv_id and x.turn_no <= p.turn_no)
        if p.example is not None:
            want[p.conv_id, p.example] = (text, p.loss_start, p.loss_end)
    assert {(x.conv_id, x.example): (x.formatted, x.loss_start, x.loss_end) for x in examples} == want and len(examples) == len(want)
    assert got == {r.conv_id: r for r in chat.digests(chat.format_conversations(turns)).collect()}
    assert got[9].n_turns == n + 2 and got[9].n_examples == sum(i % 3 > 0 for i in range(n))


def spoilt(column, value):
    expand = chat.expand
    some = (F.col("conv_id") == 1) & (F.col("example") == 1)
    return lambda pieces: expand(pieces).withColumn(column, F.when(some, value).otherwise(F.col(column)))


def test_a_missing_context_is_noticed(spark, monkeypatch):
    """An example that lost some of its context, or has another of the same length."""
    for value in (F.expr("substring(formatted, 12)"), F.expr("replace(formatted, 'kind', 'mild')")):
        with monkeypatch.context() as m:
            m.setattr(chat, "expand", spoilt("formatted", value))
            with pytest.raises(Exception, match="isn't its turns|doesn't end with the turn"):
                chat.format_and_read_back(turns_of(spark)).collect()


def test_the_loss_is_that_of_the_examples(spark, monkeypatch):
    before = {r.conv_id: r for r in chat.format_and_read_back(turns_of(spark)).collect()}
    monkeypatch.setattr(chat, "expand", spoilt("loss_end", F.col("loss_end") - 1))
    after = {r.conv_id: r for r in chat.format_and_read_back(turns_of(spark)).collect()}
    assert after[1].loss_chars == before[1].loss_chars - 1 and after[1].loss_sha256 != before[1].loss_sha256
    assert {c: r for c, r in after.items() if c != 1} == {c: r for c, r in before.items() if c != 1}


def test_long_examples_take_the_disk_of_their_turns(spark):
    """400 turns: examples of 100 times the characters of the conversation, within three times its disk."""
    rows = [(0, i, "assistant" if i % 2 else "user", " ".join(f"{(i * 7919 + j * 104729) ** 2 % 999983}" for j in range(60))) for i in range(400)]
    pieces = chat.materialise(chat.format_conversations(spark.createDataFrame(rows, SCHEMA)))
    examples = chat.materialise(chat.expand(pieces), chat.FRONT_CODED)
    disk = lambda df: sum(os.path.getsize(f.removeprefix("file://")) for f in df.inputFiles())
    assert examples.agg(F.sum(F.length("formatted"))).first()[0] > 90 * pieces.agg(F.sum(F.length("piece"))).first()[0]
    assert disk(examples) < 3 * disk(pieces)
