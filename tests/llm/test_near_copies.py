"""The near-dedup stage against brute-force Jaccard similarity of five-word shingles."""

import random

import pytest

from dishflow.llm import near_copies
from dishflow.llm.stages import drop_near_copies
from tests.llm.conftest import odd_rows


def groups(texts):
    words = [(t or "").encode().lower().split() for t in texts]
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in words]
    label = list(range(len(sets)))
    for i, x in enumerate(sets):
        for j, y in enumerate(sets[:i]):
            if 5 * len(x & y) >= 4 * len(x | y) and label[i] != label[j]:
                a, b = label[i], label[j]
                label = [b if v == a else v for v in label]
    return label


def edited(rng):
    """Copies with some words changed: similarities on both sides of 0.8, chains, and a line that many texts hold."""
    vocabulary = [f"w{i}" for i in range(500)]
    line = rng.choices(vocabulary, k=30)
    texts = []
    for n in (6, 14, 40, 90, 300):
        for _ in range(6):
            base = rng.choices(vocabulary, k=n)
            texts.append(" ".join(base + line))
            for k in range(1, 7):
                for at in rng.sample(range(n), min(n, max(1, k * n // 90))):
                    base[at] = rng.choice(vocabulary)
                texts.append(" ".join(base + line) if k < 5 else " ".join(base).upper())
    return texts


@pytest.mark.parametrize("often", [2, 4, 10**6])
def test_all_near_copies_are_found(spark, monkeypatch, often):
    monkeypatch.setattr(near_copies, "OFTEN", often)
    monkeypatch.setattr(near_copies, "SAMPLE", 2)
    texts = edited(random.Random(3)) + [r[1] for r in odd_rows()]
    label = groups(texts)
    rows = list(enumerate(texts))
    random.Random(1).shuffle(rows)
    kept = drop_near_copies(spark, spark.createDataFrame(rows, "doc_id long, text string").repartition(5), "")
    assert sorted(r.doc_id for r in kept.collect()) == sorted({label.index(v) for v in label})
    assert 1.2 * len(set(label)) < len(label)


@pytest.mark.parametrize("chunk", [4, 30])
def test_buckets_in_parts(spark, monkeypatch, chunk):
    """Shingles of more nodes than a part holds: groups on both sides of 0.8 that share a passage, and some apart."""
    monkeypatch.setattr(near_copies, "SAMPLE", 1)
    monkeypatch.setattr(near_copies, "OFTEN", 2)
    rng = random.Random(8)
    texts = edited(rng)
    base = rng.choices([f"v{i}" for i in range(300)], k=100)
    for _ in range(150):
        own = list(base)
        for at in rng.sample(range(100), rng.choice([1, 1, 2, 6])):
            own[at] = rng.choice("xyz")
        texts.append(" ".join(own))
    label = groups(texts)
    found = near_copies.near_copies(spark.createDataFrame([(i, i, t) for i, t in enumerate(texts)], "row long, doc_id long, text string").repartition(3), chunk=chunk)
    got = {}
    for r in found.collect():
        got.setdefault(r.root, set()).add(r.row)
    want = {}
    for i, v in enumerate(label):
        want.setdefault(v, set()).add(i)
    assert sorted(map(sorted, got.values())) == sorted(sorted(x) for x in want.values() if len(x) > 1)


def test_one_shingle_in_all_rows(spark):
    """20,000 rows that have a shingle in common, in parts of a thousand: only the copies are found, and all of them."""
    n = 20_000
    df = spark.range(n).selectExpr("id AS row", "id AS doc_id", "concat('one line that all have ', id, ' ', id % 50000, ' ', id * 7 % 50021) AS text")
    twins = df.union(df.where("row < 100").selectExpr("row + 20000", "doc_id + 20000", "concat(text, '')"))
    found = near_copies.near_copies(twins, chunk=1000)
    assert found.count() == 200 and found.select("root").distinct().count() == 100


def test_a_large_group_gives_few_pairs(spark, monkeypatch):
    rng = random.Random(5)
    base = rng.choices([f"w{i}" for i in range(300)], k=120)
    rows = []
    for i in range(400):
        own = list(base)
        own[rng.randrange(120)] = "x"
        rows.append((i, i, " ".join(own) + f" {i}"))
    made = []
    write = near_copies.materialise
    monkeypatch.setattr(near_copies, "materialise", lambda df: made.append(write(df)) or made[-1])
    found = near_copies.near_copies(spark.createDataFrame(rows, "row long, doc_id long, text string"))
    assert found.count() == 400 and found.select("root").distinct().count() == 1
    assert sum(x.count() for x in made if x.columns == ["a", "b"]) < 40 * 400


def test_one_row_of_a_group_without_ids_stays(spark):
    rng = random.Random(9)
    one, two = (" ".join(rng.choices([f"w{i}" for i in range(200)], k=100)) for _ in range(2))
    rows = [(None, one), (None, one + " end"), (None, one.upper()), (4, two), (None, two + " end"), (4, "alone"), (None, "lone too")]
    kept = drop_near_copies(spark, spark.createDataFrame(rows, "doc_id long, text string").repartition(3), "").collect()
    texts = [r.text for r in kept]
    assert sorted((r.doc_id or -1, r.text) for r in kept if r.text not in (one, one + " end", one.upper())) == [(-1, "lone too"), (4, "alone"), (4, two)]
    assert len(texts) == 4


def test_head_rows_are_narrow(spark, monkeypatch):
    """Of the rows that are shuffled for each head shingle most leave: none carries what its node has once."""
    texts = edited(random.Random(4))
    made = []
    write = near_copies.materialise
    monkeypatch.setattr(near_copies, "materialise", lambda df: made.append(write(df)) or made[-1])
    label = groups(texts)
    found = near_copies.near_copies(spark.createDataFrame([(i, i, t) for i, t in enumerate(texts)], "row long, doc_id long, text string").repartition(3))
    assert found.count() == sum(label.count(v) > 1 for v in label)
    (shared,) = [x for x in made if "crowded" in x.columns]
    assert shared.count() and sorted(shared.columns) == ["crowded", "node", "parts", "place", "token"]
