"""Spelling variant grouping by finite-state composition.

Two words are near if one edit (one code point inserted, deleted or replaced) makes one the other. The vocabulary is an
acceptor; composed with a one-edit transducer and with the acceptor again, it accepts exactly the pairs of near words.
The composition is cut into partitions by the states that it begins in, so that no task holds the vocabulary:

- Let p be the number of code points that a pair has in common at the beginning; there the edit takes place. A pair of
  words of `size` and `size` or `size` + 1 code points belongs to the partition (size, low, high, beginning, end) with
  low <= p < high: both words begin with the same `low` code points and end with the same ones behind the edit. The
  partition's initial state is the one that its words' common beginning leads to, and its final state that from which
  only their common end is left. At first there are two: the edit is in the first half of the words, or in the second.
- A partition of more than `most` words, or of many places, is split: into those pairs whose edit is in the first half
  of low..high, and the others. Words of a part have more in common, so parts get small; where high = low + 1, words differ
  in one place and are at most as many as the alphabet's characters and pairs of them. No word and no pair is left out.
- A task builds the minimised acceptors of one partition's words (what lies between beginning and end), of either size,
  and walks the composition: common symbols up to p, one edit, then common suffixes of two states, found once per pair
  of states however many words lead there. The edit's place is p itself, so every pair is accepted in one partition, once.

Only sums leave a task: for each word of a partition its number of near words and the most frequent one. A word's form
is that one, if it occurs at least `times` as often; forms are at least so much more frequent at each step, so that
chains are short and pointer jumping ends after a few joins.

Defined cases: null text has no words; a null doc_id hashes as if it had no digits; rows that repeat a document count as
often as they occur; of equally frequent near words the first in code-point order is the form; a word without near
words is its own root; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dishflow.llm.common import documents, materialise, result_of, shuffle_partitions, text_rows

HELD = 200_000  # distinct words that a task counts before it sends them on
MOST, WIDTH = 20_000, 64  # words of a partition; places of an edit in one, and mean code points of a word in a full one
KEYS = ["size", "low", "high", "beginning", "end"]


def _counted(least: int, misspelt: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """word, n: sums over some documents. Every `misspelt`th hash of document and word loses one code point."""
    runs = re.compile("[a-zÀ-ÿ]{%d,}" % least)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[str] = Counter()

        def sent() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], names=["word", "n"])

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), text_rows(batch), strict=True):
                start = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
                for word, n in Counter(runs.findall(text.lower().decode(errors="replace"))).items():
                    h = zlib.crc32(word.encode(), start)
                    if h % misspelt == 0:
                        at = h % len(word)
                        word = word[:at] + word[at + 1 :]
                        if len(word) < least:
                            continue
                    held[word] += n
                if len(held) > HELD:
                    yield sent()
                    held.clear()
        if held:
            yield sent()

    return run


def vocabulary(docs: DataFrame, least: int = 7, occurrences: int = 2, misspelt: int = 31) -> DataFrame:
    """word, n: words of at least so many code points that occur so often."""
    counts = documents(docs).mapInArrow(_counted(least, misspelt), "word string, n long")
    return counts.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= occurrences)


class Acceptor:
    """Minimised acceptor of sorted distinct words of one length: states are numbers, arcs[state] maps symbols to states,
    equal right languages are one state. State 0 accepts."""

    def __init__(self, words: list[str], length: int) -> None:
        self.arcs: list[dict[str, int]] = [{}]
        self._known: dict[tuple, int] = {}
        self.root = self._state(words, 0, len(words), 0, length) if words else None

    def _state(self, words: list[str], a: int, b: int, depth: int, length: int) -> int:
        if depth == length:
            return 0
        arcs = []
        while a < b:
            symbol, to = words[a][depth], a + 1
            while to < b and words[to][depth] == symbol:
                to += 1
            arcs.append((symbol, self._state(words, a, to, depth + 1, length)))
            a = to
        key = tuple(arcs)
        found = self._known.get(key)
        if found is None:
            found = self._known[key] = len(self.arcs)
            self.arcs.append(dict(arcs))
        return found


def near_pairs(short: list[str], long: list[str], places: int) -> Iterator[tuple[str, str]]:
    """Pairs that the composition accepts: of short words (sorted, of equal length), and of a short and a long one (one
    more code point), whose edit is at one of the first `places` code points."""
    length = len(short[0])
    one, two = Acceptor(short, length), Acceptor(long, length + 1)
    of, to = one.arcs, two.arcs

    def suffixes(left: list[dict], right: list[dict]) -> Callable[[int, int], tuple[str, ...]]:
        """Strings that lead from a state of either side to the end."""
        known: dict[tuple[int, int], tuple[str, ...]] = {}

        def common(x: int, y: int) -> tuple[str, ...]:
            if not left[x] or not right[y]:
                return ("",) if not left[x] and not right[y] else ()
            found = known.get((x, y))
            if found is None:
                a, b = left[x], right[y]
                found = known[x, y] = tuple(c + s for c in (a.keys() & b.keys()) for s in common(a[c], b[c]))
            return found

        return common

    replaced, inserted = suffixes(of, of), suffixes(of, to)
    # state of the short words' acceptor, of the long ones' (None: no long word begins like this), and what led there
    walk: list[tuple[int, int | None, str]] = [(one.root, two.root, "")]
    while walk:
        x, y, said = walk.pop()
        arcs = list(of[x].items())
        for i, (a, p) in enumerate(arcs):
            for b, q in arcs[:i]:
                for s in replaced(p, q):
                    yield said + a + s, said + b + s
        if y is not None:
            for b, q in to[y].items():
                for s in inserted(x, q):
                    if s[:1] != b:  # else the edit is further on
                        yield said + s, said + b + s
        if len(said) + 1 < places:
            more = to[y] if y is not None else {}
            # a lone short word has no pair unless a long one goes on like it
            walk += [(p, more.get(a), said + a) for a, p in arcs]


def _composed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over rows sorted by partition: word, near, most (of its near words' n), form (the first of those)."""
    names = [*KEYS, "word", "n"]
    held: list[tuple[str, int]] = []
    key: tuple | None = None

    def found() -> list[tuple[str, int, int, str]]:
        size, low, high, beginning, _ = key
        tail = max(0, size - high)
        count = dict(held)
        cut = {w: w[low : len(w) - tail] for w in count}
        short, long = (sorted(m for w, m in cut.items() if len(w) == size + k) for k in (0, 1))
        if not short or len(count) < 2:
            return []
        end = held[0][0][len(held[0][0]) - tail :]
        best: dict[str, list] = {}
        for a, b in near_pairs(short, long, high - low):
            a, b = beginning + a + end, beginning + b + end
            for w, other in ((a, b), (b, a)):
                n = count[other]
                if w not in best:
                    best[w] = [1, n, other]
                    continue
                of = best[w]
                of[0] += 1
                if n > of[1] or n == of[1] and other < of[2]:
                    of[1:] = n, other
        return [(w, *x) for w, x in best.items()]

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.string(), pa.int64(), pa.int64(), pa.string())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["word", "near", "most", "form"])

    out: list[tuple] = []
    for batch in batches:
        for *own, word, n in zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in names), strict=True):
            if tuple(own) != key:
                out += found() if len(held) > 1 else []
                key, held = tuple(own), []
                if len(out) > 10_000:
                    yield batch_of(out)
                    out = []
            held.append((word, n))
    out += found() if len(held) > 1 else []
    if out:
        yield batch_of(out)


def _keyed(words: DataFrame, ranges: Column, least: int = 1) -> DataFrame:
    """A row for each word and each of its partitions (size, low, high)."""
    rows = words.select("word", "n", F.explode(ranges).alias("r")).select("word", "n", "r.size", "r.low", "r.high").where(F.col("size") >= least)
    tail = F.greatest(F.lit(0), F.col("size") - F.col("high"))
    return rows.select("size", "low", "high", F.expr("left(word, low)").alias("beginning"), F.when(tail > 0, F.expr("right(word, greatest(0, size - high))")).otherwise("").alias("end"), "word", "n")


def _range(size: Column, low: Column, high: Column) -> Column:
    return F.struct(size.cast("int").alias("size"), low.cast("int").alias("low"), high.cast("int").alias("high"))


def partitioned(words: DataFrame, most: int = MOST, least: int = 1) -> DataFrame:
    """Words (of at least `least` code points) with the partitions (KEYS) of the composition that they take part in, none
    of more than `most` words but where only one place differs."""
    length = F.char_length("word")
    halves = lambda size: [_range(size, F.lit(0), F.floor((size + 1) / 2)), _range(size, F.floor((size + 1) / 2), size + 1)]
    whole = materialise(_keyed(words, F.array(*halves(length), *halves(length - 1)), least))
    done = None
    while True:
        sizes = whole.where("high - low > 1").groupBy(*KEYS).agg(F.count(F.lit(1)).alias("n"), F.sum(F.char_length("word")).alias("chars"))
        large = materialise(sizes.where((F.col("n") > most) | (F.col("chars") > WIDTH * most) | (F.col("high") - F.col("low") > WIDTH) & (F.col("n") > 1)).select(*KEYS))
        if large.isEmpty():
            return whole if done is None else done.unionByName(whole)
        small = materialise(whole.join(large, KEYS, "left_anti"))
        done = small if done is None else done.unionByName(small)
        middle = F.floor((F.col("low") + F.col("high")) / 2)
        parts = F.array(_range(F.col("size"), F.col("low"), middle), _range(F.col("size"), middle, F.col("high")))
        whole = materialise(_keyed(whole.join(large, KEYS, "left_semi"), parts))


def near_words(words: DataFrame, most: int = MOST, least: int = 1) -> DataFrame:
    """word, n_near, most (n of the most frequent near word), form (that word; the first of several): words that have any."""
    n = shuffle_partitions(words.sparkSession)
    dealt = partitioned(words, most, least).repartition(n, *KEYS).sortWithinPartitions(*KEYS)
    found = dealt.mapInArrow(_composed, "word string, near long, most long, form string")
    best = F.min(F.struct((-F.col("most")).alias("less"), "form"))
    return found.groupBy("word").agg(F.sum("near").alias("n_near"), best.alias("best")).select("word", "n_near", (-F.col("best.less")).alias("most"), F.col("best.form").alias("form"))


def roots(forms: DataFrame) -> DataFrame:
    """word, root: follows word -> form to the last one. Each round doubles the steps."""
    at = materialise(forms.select("word", F.col("form").alias("root")))
    while True:
        ahead = at.select(F.col("word").alias("root"), F.col("root").alias("later"))
        at = materialise(at.join(ahead, "root", "left").select("word", F.coalesce("later", "root").alias("root"), F.col("later").isNotNull().alias("moved")))
        if at.where("moved").isEmpty():
            return at.select("word", "root")
        at = at.drop("moved")


def spelling_variants(docs: DataFrame, least: int = 7, occurrences: int = 2, misspelt: int = 31, times: int = 10, most: int = MOST) -> DataFrame:
    """word, form, root, n, n_near, form_n: one row for each word of the vocabulary."""

    def grouped() -> DataFrame:
        words = materialise(vocabulary(docs, least, occurrences, misspelt))
        near = near_words(words, most, least)
        rows = words.join(near, "word", "left")
        form = F.when(F.col("most") >= times * F.col("n"), F.col("form"))
        judged = materialise(rows.select("word", form.alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(form.isNotNull(), F.col("most")).alias("form_n")))
        led = roots(judged.where("form is not null"))
        return judged.join(led, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")

    return result_of(docs.sparkSession, grouped)
