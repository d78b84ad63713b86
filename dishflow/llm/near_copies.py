"""Groups of near copies: texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more. No pair is missed.

1. Rows of equal normalised text are one node. SimHash fingerprints of the nodes' five-word shingles meet through their
   Golay keys, as in simhash_dedup; links of up to 3 differing bits are verified by the Jaccard similarity of the whole
   sets of shingles (64-bit hashes), and those that pass join nodes to groups.
2. At similarity 0.8 about 10 of 64 bits differ, so fingerprints alone miss most such pairs (README). What they leave is
   completed exactly: a node's shingles are put in a fixed order, and it keeps the head of them: of n shingles all but
   ceil(0.8 n) - 1. Two texts of similarity 0.8 always have a shingle of their heads in common, whatever the order;
   shingles that a sample shows to be frequent come last, so that few others meet. Nodes that share a head shingle are a
   bucket. Members of large buckets are compared with a few of them at first; after that only members of different groups
   are compared. A large group thus gives few pairs more than it has members. Shingles of more than CHUNK nodes, which the
   sample shows too, have buckets in parts: at first each part, dealt anew in each round, has a few members that all others
   of it are compared with, which joins parts to one group; then buckets that are one group go, and of the others only
   members outside of their largest group are compared with all, in cells of at most about CHUNK and CHUNK rows. Sizes, places in the order, parity bits (512
   of them in large buckets) and the number of shared buckets rule out pairs that cannot be similar enough (bounds, not
   estimates); the others are verified like the first.

Defined cases: an empty table gives no rows; null and blank texts are near copies of each other; a text of fewer words is
one shingle; ties don't matter, as a group is all that links reach; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dishflow.llm.common import materialise, shuffle_partitions, text_rows
from dishflow.llm.components import connected_components
from dishflow.llm.paths import Hashes, word_tokens
from dishflow.llm.simhash_dedup import fingerprints, links

LEAST = (4, 5)  # similarity as a fraction: comparisons are between integers
SAMPLE, OFTEN, LISTED = 8, 4, 1 << 20  # one node of so many is looked at for frequent shingles; how often; how many
ROUNDS, CENTRES = 3, 8  # members of a large bucket that all others are compared with in each of the first rounds
SMALL = 8  # buckets up to this size are compared vectorised over all of them
PAIRS = 1 << 18  # comparisons that are held at once
SIGN, SIGNED = 512, 1 << 16  # parity bits of a node, kept in large buckets; comparisons of them that are held at once
CHUNK = 4096  # nodes of a shingle, or of a part of it, that a task compares
HEAD = ["token", "node", "place", "parts"]  # what a node has once is joined to those that share a bucket


def shingles(text: bytes, words: int) -> np.ndarray:
    """Sorted distinct hashes; a text of fewer words is one shingle."""
    tokens = word_tokens(text.lower())
    with np.errstate(over="ignore"):
        k = min(words, len(tokens))
        # the number of words keeps short texts apart from the shingles of long ones
        return np.unique(Hashes(tokens).all(k).view(np.int64) + (k - words)) if k else np.zeros(1, np.int64)


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [xxhash.xxh3_128_digest(b" ".join(x.lower().split())) for x in text_rows(batch)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.binary())], names=["row", "doc_id", "digest"])


def _sets(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 500):
                some = batch.slice(i, 500)
                yield pa.RecordBatch.from_arrays([some.column(0), pa.array([shingles(x, words).tobytes() for x in text_rows(some)], pa.binary())], names=["node", "hashes"])

    return run


def _sampled(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 500):
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([shingles(x, words) for x in text_rows(batch.slice(i, 500))]))], names=["token"])

    return run


def _marked(words: int, often: np.ndarray, rank: np.ndarray):
    """node, size, sign (bit i: whether the number of shingles that end in i is odd), bits (the sign, folded to 64 bits), head
    (its shingles, in order)."""
    num, den = LEAST

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 500):
                some = batch.slice(i, 500)
                sizes, signs, heads = [], [], []
                for text in text_rows(some):
                    own = shingles(text, words)
                    n = len(own)
                    if len(often):
                        at = np.minimum(np.searchsorted(often, own), len(often) - 1)
                        order = np.argsort(np.where(often[at] == own, rank[at], 0), kind="stable")
                    else:
                        order = np.arange(n)
                    sizes.append(n)
                    signs.append(np.packbits((np.bincount(own & (SIGN - 1), minlength=SIGN) & 1).astype(np.uint8), bitorder="little").tobytes())
                    heads.append(own[order[: n - (num * n + den - 1) // den + 1]].tobytes())
                bits = np.bitwise_xor.reduce(_words(signs).view(np.int64), axis=1)
                yield pa.RecordBatch.from_arrays(
                    [some.column(0), pa.array(sizes, pa.int32()), pa.array(signs, pa.binary()), pa.array(bits), pa.array(heads, pa.binary())], names=["node", "size", "sign", "bits", "head"]
                )

    return run


def _heads(hot: np.ndarray, parts: np.ndarray):
    """Head shingles: token, node, place, parts of the token's bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 500):
                node, head = batch.slice(i, 500).columns
                own = [np.frombuffer(x.as_py(), np.int64) for x in head]
                k = np.array([len(x) for x in own])
                place = np.arange(k.sum()) - np.repeat(np.cumsum(k) - k, k)
                token = np.concatenate(own)
                of = np.ones(len(token), np.int32)
                if len(hot):
                    at = np.minimum(np.searchsorted(hot, token), len(hot) - 1)
                    of = np.where(hot[at] == token, parts[at], 1).astype(np.int32)
                cols = (token, np.repeat(node.to_numpy(), k), place.astype(np.int32), of)
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=HEAD)

    return run


def _whole_buckets(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[list[np.ndarray]]:
    """Columns of rows sorted by the first one; a value of it is never split."""
    held: list[list[np.ndarray]] = []
    for batch in batches:
        cols = [batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in names]
        if not len(cols[0]):
            continue
        last = int(np.searchsorted(cols[0], cols[0][-1]))
        if last or (held and held[-1][0][-1] != cols[0][0]):
            yield [np.concatenate(c) for c in zip(*held, [x[:last] for x in cols], strict=True)]
            held = []
        held.append([x[last:] for x in cols])
    if held:
        yield [np.concatenate(c) for c in zip(*held, strict=True)]


def _words(signs: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(signs), np.uint64).reshape(-1, SIGN // 64)


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of buckets of two or more, and whether there are more than SMALL, over rows sorted by token. Of a bucket that
    goes on at most SMALL rows are held. Buckets in parts are always shared."""

    def batch_of(cols: list[np.ndarray], keep: np.ndarray, crowded: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([*(pa.array(c[keep]) for c in cols), pa.array(crowded[keep])], names=[*HEAD, "crowded"])

    held: list[np.ndarray] | None = None
    large: int | None = None  # the open bucket's token, once its rows are known to be crowded
    for batch in batches:
        cols = [batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in HEAD]
        if large is not None and len(cols[0]):
            k = int(np.searchsorted(cols[0], large, side="right"))
            if k:
                yield batch_of([c[:k] for c in cols], np.ones(k, bool), np.ones(k, bool))
            cols = [c[k:] for c in cols]
            large = large if not len(cols[0]) else None
        if not len(cols[0]):
            continue
        cols = cols if held is None else [np.concatenate(c) for c in zip(held, cols, strict=True)]
        cuts = np.flatnonzero(np.append(True, cols[0][1:] != cols[0][:-1]))
        sizes = np.diff(np.append(cuts, len(cols[0])))
        size = np.repeat(sizes, sizes)
        last = int(cuts[-1])
        if sizes[-1] > SMALL:
            large, held, ends = int(cols[0][-1]), None, len(size)
        else:
            held, ends = [c[last:] for c in cols], last
        parted = cols[3][:ends] > 1
        keep = (size[:ends] > 1) | parted
        if keep.any():
            yield batch_of([c[:ends] for c in cols], keep, (size[:ends] > SMALL) | parted)
    if held is not None:
        parted = held[3] > 1
        keep = (np.full(len(parted), len(parted)) > 1) | parted
        if keep.any():
            yield batch_of(held, keep, parted)


def _possible(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """Whether pairs (size, place, bits) can be similar enough. overlap >= num / (num + den) (size + size)."""
    num, den = LEAST
    (n, i, x), (m, j, y) = a, b
    both = n.astype(np.int64) + m
    # what is before the shared shingle in one text's order can only be before it in the other's
    reach = 1 + np.minimum(i, j) + np.minimum(n - i - 1, m - j - 1)
    apart = np.bitwise_count(x.view(np.uint64) ^ y.view(np.uint64)).astype(np.int64)
    return (np.minimum(n, m).astype(np.int64) * den >= np.maximum(n, m).astype(np.int64) * num) & (reach * (num + den) >= num * both) & ((both - apart) * (num + den) >= 2 * num * both)


def _needed(n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Least number of shared head shingles. Of what two texts share, all but one text's tail lies in both heads."""
    num, den = LEAST
    n, m = n.astype(np.int64), m.astype(np.int64)
    tails = np.maximum((num * n + den - 1) // den, (num * m + den - 1) // den) - 1
    return np.maximum(1, (num * (n + m) + num + den - 1) // (num + den) - tails)


def _alike(i: np.ndarray, j: np.ndarray, size: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Whether pairs can be similar enough: no more bits of their signs differ than shingles may."""
    num, den = LEAST
    ok = np.empty(len(i), bool)
    for f in range(0, len(i), SIGNED):
        a, b = i[f : f + SIGNED], j[f : f + SIGNED]
        both = size[a].astype(np.int64) + size[b]
        apart = np.bitwise_count(words[a] ^ words[b]).sum(axis=1, dtype=np.int64)
        ok[f : f + SIGNED] = (both - apart) * (num + den) >= 2 * num * both
    return ok


MAJOR, RIGHT, MINOR = 1, 2, 3  # sides of a cell of a bucket in parts: members of its largest group, others as partners, others
DEALT = ["cell", "node", "size", "place", "bits", "root", "side", "sign"]


def _pairs(stars: bool):
    """Over rows sorted by cell (a bucket, or what is compared of one in parts): a, b to compare, need (how many buckets must
    name them). stars: each member of a large cell with its first few; else all pairs across components."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cols in _whole_buckets(batches, DEALT):
            token, node, size, place, bits, root, side, sign = (c.copy() for c in cols)

            def batch_of(i: np.ndarray, j: np.ndarray, words: np.ndarray | None = None, s: int = 0) -> pa.RecordBatch:
                ok = root[i] != root[j]
                i, j = i[ok], j[ok]
                ok = _possible([size[i], place[i], bits[i]], [size[j], place[j], bits[j]])
                i, j = i[ok], j[ok]
                if words is not None:
                    ok = _alike(i - s, j - s, size[s:], words)
                    i, j = i[ok], j[ok]
                return pa.RecordBatch.from_arrays([pa.array(np.minimum(node[i], node[j])), pa.array(np.maximum(node[i], node[j])), pa.array(_needed(size[i], size[j]))], names=["a", "b", "need"])

            cuts = np.flatnonzero(np.append(True, token[1:] != token[:-1]))
            ends = np.append(cuts[1:], len(token))
            if not stars:
                few = np.repeat(ends - cuts <= SMALL, ends - cuts) & (side == 0)
                for k in range(1, SMALL):
                    at = np.flatnonzero(few[k:] & (token[k:] == token[:-k]))
                    yield batch_of(at, at + k)
            for s, e in zip(cuts.tolist(), ends.tolist(), strict=True):
                if side[s]:
                    left, right = s + np.flatnonzero(side[s:e] != RIGHT), s + np.flatnonzero(side[s:e] == RIGHT)
                    words, step = _words(sign[s:e].tolist()), max(1, PAIRS // max(1, len(right)))
                    for f in range(0, len(left), step):
                        i, j = (x.ravel() for x in np.broadcast_arrays(left[f : f + step][:, None], right))
                        once = (side[i] == MAJOR) | (node[i] < node[j])
                        yield batch_of(i[once], j[once], words, s)
                    continue
                if e - s <= SMALL or (root[s:e] == root[s]).all():
                    continue
                end = min(e, s + CENTRES)
                if not stars:
                    # component by component, the largest one last: its members meet all others as partners
                    _, of, sizes = np.unique(root[s:e], return_inverse=True, return_counts=True)
                    order = s + np.lexsort((of, sizes[of]))
                    for c in (node, size, place, bits, root, sign):
                        c[s:e] = c[order]
                    end = e - int(sizes.max())
                step = max(1, PAIRS // (e - s))
                words = _words(sign[s:e].tolist())
                for f in range(s, end, step):
                    i, j = (x.ravel() for x in np.broadcast_arrays(np.arange(f, min(end, f + step))[:, None], np.arange(f + 1, e)))
                    yield batch_of(i[i < j], j[i < j], words, s)

    return run


def _similar(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    num, den = LEAST
    for batch in batches:
        keep = []
        for x, y in zip(batch.column(2), batch.column(3), strict=True):
            one, two = (np.frombuffer(v.as_py(), np.int64) for v in (x, y))
            common = len(np.intersect1d(one, two, assume_unique=True))
            keep.append(common * den >= num * (len(one) + len(two) - common))
        some = batch.filter(pa.array(keep, pa.bool_()))
        yield pa.RecordBatch.from_arrays([some.column(0), some.column(1)], names=["a", "b"])


def simhash_pairs(nodes: DataFrame, words: int) -> DataFrame:
    """a, b: nodes (node, text) whose fingerprints link at up to 3 bits: each one's first neighbour in a random order, and
    equal ones with the first of them. So pairs are fewer than nodes, however large a group; the exact search goes on."""
    rows = materialise(fingerprints(nodes.select(F.col("node").alias("doc_id"), "text"), words))
    firsts = materialise(rows.groupBy("fp").agg(F.min("doc_id").alias("first")))
    of = lambda c: firsts.select(F.col("fp").alias(c), F.col("first").alias(f"node_{c}"))
    near = links(firsts, 3).join(of("a"), "a").join(of("b"), "b").select("node_a", "node_b")
    both = near.unionByName(near.select(F.col("node_b").alias("node_a"), F.col("node_a").alias("node_b")))
    best = both.groupBy("node_a").agg(F.min(F.struct(F.xxhash64("node_b").alias("h"), "node_b")).alias("best")).select("node_a", F.col("best.node_b").alias("node_b"))
    near = best.select(F.least("node_a", "node_b").alias("a"), F.greatest("node_a", "node_b").alias("b"))
    equal = rows.join(firsts, "fp").where("doc_id <> first").select(F.col("first").alias("a"), F.col("doc_id").alias("b"))
    return near.unionByName(equal).distinct()


def _cells(rows: DataFrame, chunk: int) -> DataFrame:
    """DEALT for all pairs across components: buckets as they are; of buckets in parts that aren't one group, every member
    (in its part) with those outside of the largest group (in theirs)."""
    whole = rows.where("parts = 1").select(F.col("token").alias("cell"), "node", "size", "place", "bits", "root", F.lit(0).alias("side"), "sign")
    parted = materialise(rows.where("parts > 1"))
    groups = parted.groupBy("token", "root").agg(F.count(F.lit(1)).alias("n"))
    tops = groups.groupBy("token").agg(F.max(F.struct("n", F.col("root").alias("top"))).alias("most"), F.sum("n").alias("n")).where(F.col("n") > F.col("most.n"))
    tops = materialise(tops.select("token", "most.top", F.ceil((F.col("n") - F.col("most.n")) / chunk).cast("int").alias("others")))
    known = parted.join(tops, "token").withColumn("minor", F.col("root") != F.col("top"))
    part, other = F.pmod(F.xxhash64("node"), F.col("parts")), F.pmod(F.xxhash64("node", F.lit(1)), F.col("others"))
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = known.select("*", part.alias("p"), each("others").alias("q"), F.when(F.col("minor"), MINOR).otherwise(MAJOR).alias("side"))
    right = known.where("minor").select("*", each("parts").alias("p"), other.alias("q"), F.lit(RIGHT).alias("side"))
    cells = [x.select(F.xxhash64("token", F.col("p").cast("long"), F.col("q").cast("long")).alias("cell"), *DEALT[1:]) for x in (left, right)]
    return whole.unionByName(cells[0]).unionByName(cells[1])


def near_copies(rows: DataFrame, words: int = 5, chunk: int = CHUNK) -> DataFrame:
    """row, doc_id, root: of rows (row: a long that names each row, fixed; doc_id; text) those in groups of two or more."""
    n = shuffle_partitions(rows.sparkSession)
    texts = rows.select("row", F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    digests = materialise(texts.mapInArrow(_digests, "row long, doc_id long, digest binary"))
    nodes = materialise(digests.groupBy("digest").agg(F.min("row").alias("node"), F.count(F.lit(1)).alias("copies")))
    copies = materialise(digests.select("row").join(nodes.select(F.col("node").alias("row")), "row", "left_anti"))
    own = texts.join(copies, "row", "left_anti").select(F.col("row").alias("node"), "text")

    counts = own.where(F.pmod(F.xxhash64("node"), F.lit(SAMPLE)) == 0).select("node", "text").mapInArrow(_sampled(words), "token long").groupBy("token").count()
    seen = counts.where(F.col("count") >= OFTEN).orderBy(F.desc("count"), "token").limit(LISTED).toArrow()
    token, count = (seen.column(c).to_numpy() for c in ("token", "count"))
    order = np.argsort(token)
    token, count = token[order], count[order]
    marked = materialise(own.mapInArrow(_marked(words, token, count), "node long, size int, sign binary, bits long, head binary"))
    hot = count * SAMPLE > chunk
    kinds = "token long, node long, place int, parts int"
    heads = marked.select("node", "head").mapInArrow(_heads(token[hot], -(-count[hot] * SAMPLE // chunk)), kinds)
    dealt = heads.repartition(n, "token", F.pmod(F.xxhash64("node"), F.col("parts"))).sortWithinPartitions("token")
    shared = materialise(dealt.mapInArrow(_shared, f"{kinds}, crowded boolean"))

    def verified(pairs: DataFrame) -> DataFrame:
        asked = materialise(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct())
        sets = materialise(texts.select(F.col("row").alias("node"), "text").join(asked, "node", "left_semi").mapInArrow(_sets(words), "node long, hashes binary"))
        one, two = (sets.select(F.col("node").alias(c), F.col("hashes").alias(f"of_{c}")) for c in "ab")
        return materialise(pairs.join(one, "a").join(two, "b").select("a", "b", "of_a", "of_b").mapInArrow(_similar, "a long, b long"))

    def compared(members: DataFrame, found: DataFrame, star: int | None) -> DataFrame:
        once = ["node", "size", "bits", "sign"]
        roots = marked.select(once).join(connected_components(found), "node", "left").select(*once, F.coalesce("root", "node").alias("root"))
        rooted = members.join(roots, "node").select(*HEAD, "size", "bits", "root", F.when(F.col("crowded"), F.col("sign")).alias("sign"))
        if star is None:
            cells = _cells(rooted, chunk)
        else:
            part = F.pmod(F.xxhash64("node", F.lit(star + 2)), F.col("parts"))
            cell = F.when(F.col("parts") > 1, F.xxhash64("token", part.cast("long"))).otherwise(F.col("token"))
            cells = rooted.select(cell.alias("cell"), "node", "size", "place", "bits", "root", F.lit(0).alias("side"), "sign")
        # the first members of a bucket are the same in most buckets of a group, so that their pairs are few
        dealt = cells.repartition(n, "cell").sortWithinPartitions("cell", F.xxhash64("node", F.lit(star or 0)))
        named = dealt.mapInArrow(_pairs(star is not None), "a long, b long, need long").groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"), F.first("need").alias("need"))
        # a star counts only the buckets that its centre leads: what it misses is compared later
        return verified(materialise(named.where("n >= need").select("a", "b")))

    found = verified(materialise(simhash_pairs(own, words)))
    for star in range(ROUNDS):
        found = found.unionByName(compared(shared.where("crowded"), found, star))
    found = found.unionByName(compared(shared, found, None))
    groups = materialise(nodes.join(connected_components(found), "node", "left").where("root is not null or copies > 1").select("digest", F.coalesce("root", "node").alias("root")))
    return digests.join(groups, "digest").select("row", "doc_id", "root")
