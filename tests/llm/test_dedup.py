import hashlib
import random
import re
from ast import literal_eval
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from dishflow.llm.components import connected_components
from dishflow.llm.exact_dedup import exact_dedup, golomb_decode, golomb_encode
from dishflow.llm.repeats import Kind, packed_texts, repeated
from dishflow.llm.simhash_dedup import bucket_keys, links, near_duplicates
from dishflow.llm.substring_dedup import drop_repeated_passages
from dishflow.llm.suffix_dedup import drop_repeated_bytes
from dishflow.llm.unitigs import heads
from tests.conftest import same_rows
from tests.llm.conftest import odd_rows

BIG = 2**63 - 1


@pytest.mark.parametrize("n", [0, 1, 2, 3, 1000])
def test_golomb_round_trip(n):
    rng = np.random.default_rng(n)
    for top in (2**64 - 1, 1000 * n + 5):
        h = np.unique(rng.integers(0, top, n, dtype=np.uint64))
        assert (golomb_decode(golomb_encode(h)) == h).all()


@pytest.mark.parametrize("chunk", [7, 65536])
def test_exact_dedup(odd, chunk):
    rows = odd_rows()
    groups = defaultdict(list)
    for i, t, *_ in rows:
        groups[re.sub(r"[\x20\x09-\x0D]+", " ", t or "")].append(i)
    want = []
    for text, ids in groups.items():
        first = min((i for i in ids if i is not None), default=None)
        digest = hashlib.sha256(text.encode()).hexdigest()
        stays = ids.index(first)
        want += [(i, first, len(ids), k == stays, digest) for k, i in enumerate(ids)]
    got = exact_dedup(odd, chunk_rows=chunk).select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))


def colliding(text):
    """As many texts as not have the same digest."""
    return hashlib.sha256(text).digest() if len(text) % 2 else bytes(32)


@pytest.mark.parametrize("broadcast", [0, 1000])
def test_equal_digests_are_not_trusted(odd, broadcast):
    groups = defaultdict(list)
    for i, t, *_ in odd_rows():
        groups[re.sub(r"[\x20\x09-\x0D]+", " ", t or "")].append(i)
    want = []
    for ids in groups.values():
        first = min((i for i in ids if i is not None), default=None)
        want += [(i, first, len(ids), k == ids.index(first)) for k, i in enumerate(ids)]
    got = exact_dedup(odd, digest=colliding, broadcast_digests=broadcast, broadcast_bytes=broadcast).select("doc_id", "keep_id", "group_size", "kept").collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))


def fingerprint(text, k):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(fps, most):
    f = np.array(fps, np.uint64)
    near = np.bitwise_count(f[:, None] ^ f) <= most
    label = np.arange(len(f))
    while True:
        new = np.where(near, label, len(f)).min(axis=1)
        if (new == label).all():
            return label
        label = new


def test_near_duplicates(odd):
    rows = odd_rows()
    fps = [fingerprint(t, 3) for _, t, *_ in rows]
    label = components(fps, 3)
    names = {c: min((rows[i][0] for i in np.flatnonzero(label == c) if rows[i][0] is not None), default=None) for c in set(label)}
    want = sorted(str((r[0], f"{f:016x}", names[c])) for r, f, c in zip(rows, fps, label, strict=True))
    assert sorted(str(tuple(r)) for r in near_duplicates(odd).select("doc_id", "fingerprint", "component_id").collect()) == want


@pytest.mark.parametrize("bits", [0, 1, 2, 3])
def test_keys_meet_within_three_bits(bits):
    rng = np.random.default_rng(bits)
    x = rng.integers(0, 2**64, 3000, dtype=np.uint64)
    y = x.copy()
    for _ in range(bits):
        y ^= np.uint64(1) << rng.integers(0, 64, len(x), dtype=np.uint64)
    a, b = (set(zip(*(v.tolist() for v in bucket_keys(z)), strict=True)) for z in (x, y))
    assert {i for i, _ in a & b} == set(range(len(x)))


@pytest.mark.parametrize("chunk", [50, 16384])
def test_links_of_crowded_buckets(spark, chunk):
    rng = np.random.default_rng(0)
    base = rng.integers(0, 2**64, 3, dtype=np.uint64)
    one = lambda n: np.uint64(1) << rng.integers(0, 64, n, dtype=np.uint64)
    f = np.unique(np.concatenate([base[rng.integers(0, 3, 900)] ^ one(900) ^ one(900), rng.integers(0, 2**64, 300, dtype=np.uint64)]))
    found = links(spark.createDataFrame([(int(v),) for v in f.view(np.int64)], "fp long"), 3, chunk)
    root = {r.node: r.root for r in connected_components(found).collect()}
    label = components(f, 3)
    got = [root.get(int(v), int(v)) for v in f.view(np.int64)]
    assert len(set(zip(got, label.tolist(), strict=True))) == len(set(got)) == len(set(label.tolist()))
    assert found.count() < 60 * len(f)


def test_components_of_a_long_chain(spark):
    edges = spark.range(500).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    found = connected_components(edges.unionByName(spark.createDataFrame([(900, 900), (901, 902), (902, 901)], "a long, b long"))).collect()
    by = defaultdict(set)
    for r in found:
        by[r.root].add(r.node)
    assert sorted(map(len, by.values())) == [2, 501]
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def passages(rows, k):
    first = {}
    for d, t in rows:
        w, d = (t or "").encode().split(), BIG if d is None else d
        for i in range(len(w) - k + 1):
            key = tuple(w[i : i + k])
            first[key] = min(first.get(key, d), d)
    for d, t in rows:
        w, own = (t or "").encode().split(), BIG if d is None else d
        gone = np.zeros(len(w), bool)
        for i in range(len(w) - k + 1):
            if first[tuple(w[i : i + k])] < own:
                gone[i : i + k] = True
        yield str((d, len(w), int(gone.sum()), b" ".join(x for x, g in zip(w, gone, strict=True) if not g)))


def strings(rows, k):
    count = defaultdict(int)
    for _, t in rows:
        b = (t or "").encode()
        for i in range(len(b) - k + 1):
            count[b[i : i + k]] += 1
    for d, t in rows:
        b = (t or "").encode()
        gone = np.zeros(len(b) + 1, np.int8)
        for i in range(len(b) - k + 1):
            if count[b[i : i + k]] > 1:
                gone[i : i + k] = 1
        kept = np.frombuffer(b, np.uint8)[~gone[:-1].astype(bool)].tobytes()
        yield str((d, len(b), int(gone.sum()), int((np.diff(gone, prepend=0) == 1).sum()), kept))


@pytest.mark.parametrize(("k", "anchor"), [(50, 20), (8, 3)])
def test_repeated_passages(odd, k, anchor):
    got = drop_repeated_passages(odd, k, anchor).select("doc_id", "n_words", "n_removed", "kept").collect()
    assert sorted(str((a, b, c, bytes(e))) for a, b, c, e in got) == sorted(passages([r[:2] for r in odd_rows()], k))


@pytest.mark.parametrize("mask", [0, 3 << 40, (1 << 22) - 1])
def test_repeated_passages_when_hashes_collide(odd, mask):
    """No bits, a few bits of each hash, and none of a path's: what differs from its source is compared as text."""
    got = drop_repeated_passages(odd, 20, 8, mask).select("doc_id", "n_words", "n_removed", "kept").collect()
    assert sorted(str((a, b, c, bytes(e))) for a, b, c, e in got) == sorted(passages([r[:2] for r in odd_rows()], 20))


@pytest.mark.parametrize("n", [1, 2, 7, 40])
def test_chains_are_compacted(spark, n):
    """Chains of n paths, and a branch: pointers end at heads, distances add up."""
    edges = [(100 * c + i + 1, 100 * c + i, i + 1) for c in range(3) for i in range(n)]
    got = {(r.id, r.to, r.dist) for r in heads(spark.createDataFrame(edges, "id long, to long, dist long").repartition(3)).collect()}
    assert got == {(100 * c + i, 100 * c, i * (i + 1) // 2) for c in range(3) for i in range(1, n + 1)}


def test_long_repeats_become_one_run(spark):
    """A passage of 600 words in three texts is one chain, and one run of 551 windows at its source, in each of them."""
    rng = random.Random(3)
    word = lambda: f"w{rng.randrange(10**6)}"
    passage = [word() for _ in range(600)]
    rows = [(i, " ".join([word() for _ in range(30 * i)] + passage + [word() for _ in range(20)])) for i in range(3)]
    shared = repeated(packed_texts(spark.createDataFrame(rows, "doc_id long, text string")), Kind("words", 50, 20, sources=True)).collect()
    runs = [(r.d, r.start + x["from"], r.start + x["to"], x["d"], x["at"]) for r in shared for x in r.runs]
    assert sorted({r[0] for r in runs}) == [0, 1, 2] and len(runs) <= 9  # the ends share minimisers with what is around them
    assert sorted((d, sum(b - a for e, a, b, *_ in runs if e == d)) for d in range(3)) == [(d, 551) for d in range(3)]
    assert all(source == 0 and at == a - 30 * d for d, a, b, source, at in runs) and max(b - a for _, a, b, *_ in runs) > 450


@pytest.mark.parametrize(("k", "anchor"), [(40, 20), (12, 5)])
def test_repeated_bytes(odd, k, anchor):
    got = drop_repeated_bytes(odd, k, anchor).select("doc_id", "n_bytes", "n_removed", F.size("spans"), "kept").collect()
    assert sorted(str((a, b, c, e, bytes(f))) for a, b, c, e, f in got) == sorted(strings([r[:2] for r in odd_rows()], k))


def test_op8_as_registered(spark, sf):
    """400 bytes and its anchor, against all windows of the whole table."""
    from dishflow.llm.queries import op8_suffix_dedup

    rows = [(r.doc_id, (r.text or "").encode()) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    seen = Counter(t[i : i + 400] for _, t in rows for i in range(len(t) - 399))
    want = set()
    for i, t in rows:
        gone = np.zeros(len(t) + 1, bool)
        for a in range(len(t) - 399):
            if seen[t[a : a + 400]] > 1:
                gone[a : a + 400] = True
        spans = int((gone[1:] & ~gone[:-1]).sum() + gone[0])
        kept = np.frombuffer(t, np.uint8)[~gone[:-1]].tobytes()
        want.add((i, len(t), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    got = {(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in op8_suffix_dedup(spark, sf).collect()}
    assert got == want and sum(x[2] > 0 for x in want) > 3


def borders() -> list[tuple]:
    """Texts at the borders of 400 bytes: n_bytes is their size whatever is removed, and each place of a repeat goes."""
    rng = random.Random(11)
    a, b, c, d, e = ("".join(rng.choice("abcdefgh ") for _ in range(n)) for n in (399, 400, 401, 1200, 700))
    texts = [a, a, b, "x" + b + "y", c + "1", "2" + c, d, d[:400] + "#" + d[400:800], d[800:] + "\x00" + d[800:], e + "é" * 250 + e, "é" * 199 + "z", "日" * 140, None, "", "q" * 400, "r" * 401]
    return [(i, x) for i, x in enumerate(texts)] + [(None, c), (None, c), (None, None), (3, b), (3, "other " + a)]


def test_op8_equals_sql(spark, duck, sf):
    from dishflow.llm.queries import SQL, op8_suffix_dedup

    same_rows(op8_suffix_dedup(spark, sf), duck.sql(SQL["op8_suffix_dedup"]))


def test_op8_and_its_sql_at_borders(spark, duck, tmp_path):
    """The query, its SQL and a count of all strings agree."""
    from dishflow.llm.queries import SQL, op8_suffix_dedup

    spark.createDataFrame(borders(), "doc_id long, text string").repartition(3).write.parquet(f"file://{tmp_path}/documents.parquet")
    duck.sql(f"CREATE OR REPLACE VIEW borders AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    own = duck.sql(SQL["op8_suffix_dedup"].replace("FROM documents", "FROM borders"))
    got = op8_suffix_dedup(spark, f"file://{tmp_path}").select(*own.columns).collect()
    want = [(i, n, gone, spans, hashlib.sha256(kept).hexdigest()) for i, n, gone, spans, kept in map(literal_eval, strings(borders(), 400))]
    assert sorted(str(tuple(r)) for r in got) == sorted(map(str, own.fetchall())) == sorted(map(str, want))
    assert {(i, n) for i, n, *_ in want} == {(i, len((t or "").encode())) for i, t in borders()}


@pytest.mark.parametrize("copies", [1, 3, 4096])
def test_equal_rows_of_one_id_are_listed_in_steps(spark, monkeypatch, copies):
    from dishflow.llm import exact_dedup as module

    monkeypatch.setattr(module, "COPIES", copies)
    rows = [(None, "")] * 11 + [(None, None)] * 2 + [(5, "a b")] * 7 + [(6, "a  b")] * 3 + [(7, "c")]
    got = exact_dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    counted = Counter((r.doc_id, r.keep_id, r.group_size, r.kept) for r in got)
    assert counted == {(None, None, 13, True): 1, (None, None, 13, False): 12, (5, 5, 10, True): 1, (5, 5, 10, False): 6, (6, 5, 10, False): 3, (7, 7, 1, True): 1}


def test_text_longer_than_a_step(spark, monkeypatch):
    """Windows of a text that is hashed in several steps."""
    import dishflow.llm.paths as paths

    tokens = np.random.default_rng(0).integers(0, 2**63, 5000).astype(np.uint64)
    with np.errstate(over="ignore"):
        whole = paths.paths(tokens, 50, 20)
        monkeypatch.setattr(paths, "STEP", 64)
        stepped = paths.paths(tokens, 50, 20)
    covered = lambda p: sorted(x for s, n in zip(p[2], p[3], strict=True) for x in range(s, s + n))
    assert covered(whole) == covered(stepped) == list(range(4951))
    assert set(whole[0]) <= set(stepped[0])


@pytest.mark.parametrize("run", [exact_dedup, near_duplicates, drop_repeated_passages, drop_repeated_bytes])
def test_empty_tables(empty, run):
    assert run(empty).count() == 0
