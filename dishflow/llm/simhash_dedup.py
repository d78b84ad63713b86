"""SimHash near-dedup with Golay-code fuzzy hashing.

A 64-bit fingerprint has four 16-bit segments. With at most 3 differing bits some segment i is equal while the next
one (cyclically) differs in at most 2 bits:
three free segments differing by 1 each, two by 1 and 2, or one by 3 all leave such a neighbour. Segment i+1, padded
to the 23 bits of the perfect Golay code, is decoded together with every word one bit away: words 2 bits apart share
the word between them, so they share a codeword index. Keys are therefore (i, segment i, codeword index), about 20 for
each fingerprint. Members of a key's bucket are searched for links breadth first; a bucket yields a spanning forest of
its links, never all its pairs, and buckets above a size go as pairs of chunks to several tasks. Every link is verified.

Defined cases: null and blank texts have fingerprint zero and link like others; equal fingerprints (copies, repeated
rows) count once in the search; a null doc_id takes a component but never names it while another can; an empty table
gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dishflow.llm.common import documents, materialise, shuffle_partitions, text_rows
from dishflow.llm.components import connected_components

#: Fixed value: generator polynomial of the binary Golay code, x^11+x^10+x^6+x^5+x^4+x^2+1.
GOLAY = 0b110001110101
SMALL = 8  # buckets up to this size are compared pair by pair, vectorised over all of them
CHUNK = 16384  # members that one task searches at once

_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)


def fingerprint(text: bytes, words: int = 3) -> int:
    """bytes.lower and bytes.split know exactly A-Z and ASCII white space."""
    found = text.lower().split()
    if not found:
        return 0
    joined = memoryview(b" ".join(found))
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    k = min(words, len(found))
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[a:b], 42) for a, b in zip(starts[: len(found) - k + 1].tolist(), ends[k - 1 :].tolist(), strict=True)], np.uint64)
    octets = hashes.view(np.uint8).reshape(-1, 8)
    ones = np.concatenate([np.bincount(octets[:, i], minlength=256) @ _BITS for i in range(8)])
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, words: int = 3) -> DataFrame:
    """doc_id, fp (the 64 bits as a signed long)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.fromiter((fingerprint(x, words) for x in text_rows(batch)), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], names=["doc_id", "fp"])

    return documents(docs).mapInArrow(run, "doc_id long, fp long")


def _remainder(words: np.ndarray) -> np.ndarray:
    words = words.copy()
    for bit in range(22, 10, -1):
        words ^= np.where(words >> bit & 1, GOLAY << (bit - 11), 0)
    return words


@cache
def golay_keys() -> tuple[np.ndarray, np.ndarray]:
    """For each 16-bit segment where its keys begin (65,537 places), and the codeword indices near it."""
    one = 1 << np.arange(23)
    weight2 = [one[i] ^ one[j] for i in range(23) for j in range(i)]
    weight3 = [one[i] ^ one[j] ^ one[k] for i in range(23) for j in range(i) for k in range(j)]
    errors = np.array([0, *one, *weight2, *weight3])
    error_of = np.zeros(2048, np.int64)
    error_of[_remainder(errors)] = errors
    flips = np.concatenate([[0], 1 << np.arange(16)])
    near = (np.arange(65536)[:, None] ^ flips) << 7  # seven zeros pad a segment
    index = np.sort((near ^ error_of[_remainder(near.ravel()).reshape(near.shape)]) >> 11, axis=1)
    first = np.diff(index, axis=1, prepend=-1) != 0
    return np.concatenate([[0], np.cumsum(first.sum(axis=1))]), index[first].astype(np.int64)


def bucket_keys(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Position in fps and key, for each key of each fingerprint."""
    begin, index = golay_keys()
    rows, keys = [], []
    for i in range(4):
        exact, fuzzy = ((fps >> np.uint64(16 * s) & np.uint64(0xFFFF)).astype(np.int64) for s in (i, (i + 1) % 4))
        n = begin[fuzzy + 1] - begin[fuzzy]
        at = np.repeat(np.arange(len(fps)), n)
        within = np.arange(len(at)) - np.repeat(np.cumsum(n) - n, n)
        rows.append(at)
        keys.append(i << 28 | exact[at] << 12 | index[begin[fuzzy[at]] + within])
    return np.concatenate(rows), np.concatenate(keys)


def forest(fps: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Links of a spanning forest of the graph of all links within fps (distinct). What is reached leaves the search."""
    rest, found = fps, []
    while len(rest):
        front, rest = rest[:1], rest[1:]
        while len(front) and len(rest):
            head, front = front[:64], front[64:]
            near = np.bitwise_count(head[:, None] ^ rest) <= most
            hit = near.any(axis=0)
            if hit.any():
                found.append((head[near[:, hit].argmax(axis=0)], rest[hit]))
                front, rest = np.concatenate([front, rest[hit]]), rest[~hit]
    return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else (fps[:0], fps[:0])


def _search(most: int, chunk: int):
    """Over rows sorted by key: links, and the members of buckets too large for one task, chunk by chunk."""

    def batch_of(kind: int, a: np.ndarray, b: np.ndarray, key: int = 0, no: int = 0) -> pa.RecordBatch:
        n = len(a)
        return pa.RecordBatch.from_arrays([pa.array(np.full(n, kind, np.int32)), pa.array(a.view(np.int64)), pa.array(b.view(np.int64)), pa.array(np.full(n, key)), pa.array(np.full(n, no, np.int32))], names=["kind", "a", "b", "key", "chunk"])

    def small(keys: np.ndarray, fps: np.ndarray) -> Iterator[pa.RecordBatch]:
        for s in range(1, SMALL):
            hit = np.flatnonzero((keys[s:] == keys[:-s]) & (np.bitwise_count(fps[s:] ^ fps[:-s]) <= most))
            if len(hit):
                yield batch_of(0, fps[hit], fps[hit + s])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, fps = np.empty(0, np.int64), np.empty(0, np.uint64)
        over, no = -1, 0
        for batch in batches:
            keys = np.concatenate([keys, batch.column(0).to_numpy()])
            fps = np.concatenate([fps, batch.column(1).to_numpy().view(np.uint64)])
            last = int(np.searchsorted(keys, keys[-1]))  # this bucket may go on
            yield from solved(keys[:last], fps[:last], over, no)
            keys, fps = keys[last:], fps[last:]
            if over != keys[0]:
                over, no = -1, 0
            while len(keys) > chunk:
                over = int(keys[0])
                yield batch_of(1, fps[:chunk], fps[:chunk], over, no)
                keys, fps, no = keys[chunk:], fps[chunk:], no + 1
        if len(keys):
            yield from solved(keys, fps, over, no)

    def solved(keys: np.ndarray, fps: np.ndarray, over: int, no: int) -> Iterator[pa.RecordBatch]:
        if not len(keys):
            return
        cuts = np.flatnonzero(np.diff(keys, prepend=keys[0] - 1))
        ends = np.append(cuts[1:], len(keys))
        sizes = ends - cuts
        few = np.repeat((sizes <= SMALL) & (sizes > 1) & (keys[cuts] != over), sizes)
        yield from small(keys[few], fps[few])
        for i in np.flatnonzero((sizes > SMALL) | (keys[cuts] == over)):
            part = fps[cuts[i] : ends[i]]
            if keys[cuts[i]] == over:
                for j in range(0, len(part), chunk):
                    yield batch_of(1, part[j : j + chunk], part[j : j + chunk], over, no + j // chunk)
            else:
                a, b = forest(part, most)
                if len(a):
                    yield batch_of(0, a, b)

    return run


def links(fps: DataFrame, most: int = 3, chunk: int = CHUNK) -> DataFrame:
    """a, b: links (at most `most` of up to 3 differing bits) that connect whatever all links connect; fps: distinct fp."""

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.column(0).to_numpy()
            for i in range(0, len(own), 4096):
                at, keys = bucket_keys(own[i : i + 4096].view(np.uint64))
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(own[i : i + 4096][at])], names=["key", "fp"])

    if not 0 <= most <= 3:
        raise ValueError("the keys find links of up to 3 differing bits")
    n = shuffle_partitions(fps.sparkSession)
    dealt = fps.select("fp").mapInArrow(keyed, "key long, fp long").repartition(n, "key").sortWithinPartitions("key")
    found = materialise(dealt.mapInArrow(_search(most, chunk), "kind int, a long, b long, key long, chunk int"))
    members = found.where("kind = 1").select("key", "chunk", F.col("a").alias("fp"))
    chunks = members.groupBy("key").agg(F.max("chunk").alias("last"))
    other = members.join(chunks, "key").withColumn("other", F.explode(F.sequence(F.lit(0), "last")))
    pairs = other.select("key", F.least("chunk", "other").alias("i"), F.greatest("chunk", "other").alias("j"), "fp")

    def both(group: pa.Table) -> pa.Table:
        a, b = forest(group.column("fp").to_numpy().view(np.uint64), most)
        return pa.table({"a": a.view(np.int64), "b": b.view(np.int64)})

    return found.where("kind = 0").select("a", "b").unionByName(pairs.groupBy("key", "i", "j").applyInArrow(both, "a long, b long"))


def near_duplicates(docs: DataFrame, words: int = 3, most: int = 3) -> DataFrame:
    """doc_id, fingerprint, component_id: one row for each row of docs."""
    rows = materialise(fingerprints(docs, words))
    distinct = materialise(rows.groupBy("fp").agg(F.min("doc_id").alias("first")))
    roots = connected_components(links(distinct, most)).select(F.col("node").alias("fp"), "root")
    classes = materialise(distinct.join(roots, "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root")))
    names = classes.groupBy("root").agg(F.min("first").alias("component_id"))
    # written first: Spark splits large partitions, as a text with many copies makes, only of joins of plain inputs
    named = materialise(classes.join(names, "root").select("fp", "component_id"))
    return rows.join(named, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
