"""Fill-in-middle transformation by an indexable skip list.

A text is cut into units (lines). Its skip list holds them in order: the lowest lane links every unit to the next, each
express lane above links about every fourth node of the lane below it, and every link carries two widths, the number of
units and the number of code points that it passes. Descending lanes, a search adds up widths while they don't pass the
rank it looks for, and so reaches both cuts of a document exactly, in few steps, with their places in units and in code
points at once. Which form a document takes and where it is cut follow from a hash of its doc_id alone, so every run and
every retried task gives the same rows. Rows don't meet: there is no shuffle.

Defined cases: null text counts as empty; an empty text and one that holds a control string stay plain; a null doc_id
hashes as if it had no digits; rows that repeat a doc_id are cut by the same ranks, each in its own text; an empty table
gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from dishflow.llm.common import documents

LINES = r"[^\n]*\n|[^\n]+"
FAN = 4  # nodes of a lane for one of the lane above it
SCHEMA = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string, restored string"


class SkipList:
    """Units in order, by their widths in code points. Lanes from the lowest up: unit numbers at which links begin, and
    the units and code points that each link passes. Heights are random but fixed by a unit's number."""

    def __init__(self, widths: np.ndarray) -> None:
        n = len(widths)
        self.units, self.chars = n, int(widths.sum())
        at = np.arange(n)
        key = (at.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        key ^= key >> np.uint64(32)
        starts = np.concatenate([[0], np.cumsum(widths)])
        self.lanes: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        while True:
            ends = np.append(at[1:], n)
            self.lanes.append((at, ends - at, starts[ends] - starts[at]))
            if len(at) <= FAN:
                break
            # the list's head has full height; others rise with a chance of one in FAN
            up = key[at] % np.uint64(FAN) == 0
            key = key // np.uint64(FAN)
            up[0] = True
            if up.all():
                break
            at = at[up]

    def seek(self, rank: int) -> tuple[int, int, int]:
        """Units before the cut (the rank itself), code points before it, links that were looked at."""
        if not 0 <= rank <= self.units:
            raise IndexError(rank)
        done = chars = steps = 0
        for at, units, points in reversed(self.lanes):
            i = int(np.searchsorted(at, done))  # where a higher lane has come to is a node of this one too
            while i < len(at) and done + units[i] <= rank:
                done, chars, i, steps = done + int(units[i]), chars + int(points[i]), i + 1, steps + 1
        return done, chars, steps


@dataclass(frozen=True)
class FillInMiddle:
    """rate: per cent of documents that are cut; spm: per cent of those that begin with the suffix. Control strings must
    not overlap each other, so that an output can be taken apart again."""

    seed: int = 7
    rate: int = 100
    spm: int = 50
    prefix: str = "<P>"
    suffix: str = "<S>"
    middle: str = "<M>"
    units: str = LINES

    def __post_init__(self) -> None:
        marks = (self.prefix, self.suffix, self.middle)
        overlap = any(a[-k:] == b[:k] for a in marks for b in marks for k in range(1, min(len(a), len(b))))
        if overlap or not all(marks) or any(i != j and marks[i] in marks[j] for i in range(3) for j in range(3)):
            raise ValueError("control strings must be different and must not overlap")

    def draws(self, doc_id: int | None) -> list[int]:
        """Four numbers below 2^32 from the document's id."""
        found = hashlib.sha256(f"{self.seed}:{'' if doc_id is None else doc_id}".encode()).digest()
        return [int.from_bytes(found[i : i + 4], "big") for i in range(0, 16, 4)]

    def form(self, text: str, h: list[int]) -> str:
        if not text or any(m in text for m in (self.prefix, self.suffix, self.middle)) or h[2] % 100 >= self.rate:
            return "plain"
        return "spm" if h[3] % 100 < self.spm else "psm"

    def join(self, form: str, before: str, middle: str, after: str) -> str:
        if form == "psm":
            return f"{self.prefix}{before}{self.suffix}{after}{self.middle}{middle}"
        return f"{self.suffix}{after}{self.prefix}{before}{self.middle}{middle}"

    def restore(self, output: str, form: str) -> str:
        """The text, from the output and its form alone."""
        if form == "plain":
            return output
        first, second = (self.prefix, self.suffix) if form == "psm" else (self.suffix, self.prefix)
        head, _, middle = output.partition(self.middle)
        one, _, two = head.removeprefix(first).partition(second)
        before, after = (one, two) if form == "psm" else (two, one)
        return before + middle + after

    def cut(self, doc_id: int | None, text: str) -> tuple[int, str, int | None, int | None, str]:
        """Units, form, code points of prefix and middle (None where it stays plain), output."""
        ends = np.fromiter((m.end() for m in re.finditer(self.units, text)), np.int64)
        n, h = len(ends), self.draws(doc_id)
        form = self.form(text, h)
        if form == "plain":
            return n, form, None, None, text
        line = SkipList(np.diff(ends, prepend=0))
        a, b = (line.seek(r)[1] for r in sorted((h[0] % (n + 1), h[1] % (n + 1))))
        return n, form, a, b - a, self.join(form, text[:a], text[a:b], text[b:])


def fill_in_middle(docs: DataFrame, how: FillInMiddle = FillInMiddle()) -> DataFrame:  # noqa: B008
    """doc_id, n (units), form (plain, psm, spm), prefix_chars, middle_chars, output, restored (rebuilt from output and form):
    one row for each row of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in SCHEMA.split(", ")]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        for batch in batches:
            for i in range(0, batch.num_rows, 500):
                rows = []
                for doc_id, text in zip(*(c.to_pylist() for c in batch.slice(i, 500).columns), strict=True):
                    n, form, prefix, middle, output = how.cut(doc_id, text)
                    rows.append((doc_id, n, form, prefix, middle, output, how.restore(output, form)))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    return documents(docs).mapInArrow(run, SCHEMA)
