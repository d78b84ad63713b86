import hashlib
import math
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from dishflow.llm.chat_format import ESC, ETX, STX, digests, expand, format_conversations, format_turn, read_turn
from dishflow.llm.common import materialise
from dishflow.llm.mixing import mix, segments, training_order
from dishflow.llm.quality import FEATURES, classify, statistics
from dishflow.llm.topk import integer_weights, top_k
from tests.llm.conftest import odd_rows


def test_mixing(odd):
    rows = odd_rows()
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes = defaultdict(int)
    for _, t, _, s in rows:
        sizes[s] += size(t)
    names = sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    full = set()
    while True:
        left = 1.5 * sum(sizes.values()) - sum(2 * sizes[s] for s in full)
        total = sum(weight[s] for s in names if s not in full)
        new = {s for s in names if s not in full and left * weight[s] / total > 2 * sizes[s]}
        if not new:
            break
        full |= new
    target = {s: 2.0 * sizes[s] if s in full else left * weight[s] / total for s in names}
    mixed = mix(odd)
    got = mixed.collect()
    assert sorted(str((r.doc_id, r.size, r.source_size)) for r in got) == sorted(str((i, size(t), sizes[s])) for i, t, _, s in rows)
    taken = defaultdict(int)
    for r in got:
        assert r.taken <= 2 * r.size and np.isclose(r.target, target[r.source])
        taken[r.source] += r.taken
    assert all(abs(taken[s] - target[s]) <= 1 for s in names)
    order = training_order(mixed).collect()
    assert [r.position for r in order] == sorted(r.position for r in order) and all(0 <= r.position <= 1 for r in order)
    assert sorted(map(str, mix(odd).collect())) == sorted(map(str, got))


def test_positions_follow_the_schedule(spark):
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("s").alias("source"), F.lit("w w w w").alias("text"))
    mixed = mix(docs, curriculum=((4.0, 0.0),), share=1.0)
    early = training_order(mixed).where("position < 0.5").count() / 4000
    assert segments((4.0, 0.0)) == [(0.0, 4.0, -4.0, 0.0, 2.0)] and abs(early - 0.75) < 0.01


def test_all_sources_full_and_empty(spark, empty):
    docs = spark.createDataFrame([(1, "a", "x y"), (2, "b", ""), (3, "c", None)], "doc_id long, source string, text string")
    assert {r.doc_id: r.taken for r in mix(docs, share=2.0).collect()} == {1: 4, 2: 0, 3: 0}
    assert mix(empty).count() == 0 and training_order(mix(empty)).count() == 0


VECTORS = [(0, [1.0, 0.5, -0.25]), (50, [0.0, 0.0, 0.0]), (1, [1.0, 0.5, -0.25]), (2, [1.0, 0.5, -0.25]), (3, [1.0]), (4, []), (5, None), (6, [1.0, None]), (7, [float("nan")]), (8, [float("inf"), 1.0]), (9, [1e300]), (11, [1e30, -3e29]), (12, [1e17]), (100, [1e18, 1.0]), (2, [-1.0, 3.0, 2.0]), (100, [0.1, 0.2, 0.3, 0.4]), (10, [-0.001, 0.0, 0.7]), (13, [-1e306])] + [(14, [0.25, 0.5])] * 40


@pytest.mark.parametrize("blocks", [(32768, 512), (3, 2)])
def test_top_k(spark, blocks):
    df = spark.createDataFrame(VECTORS, "vec_id long, embedding array<double>").withColumn("score", F.lit(1))
    w = df.select("vec_id", integer_weights(F.col("embedding")).alias("w"))
    whole = [(i, [math.floor(256 * x) for x in v]) for i, v in VECTORS if v is not None and all(x is not None and np.isfinite(256 * x) for x in v)]
    long = lambda s: max(-(2**63), min(2**63 - 1, s))
    want = []
    for q, a in whole:
        if q % 50 == 0:
            scores = sorted((-long(sum(x * y for x, y in zip(a, b, strict=False))), i) for i, b in whole if i != q)[:5]
            want += [(q, n, i, -s) for n, (s, i) in enumerate(scores, 1)]
    got = top_k(w.where("vec_id % 50 = 0"), w, 5, *blocks)
    assert sorted(map(tuple, got.collect())) == sorted(want)
    assert top_k(w.where("false"), w).count() == 0


TURNS = [
    (1, 0, "system", "be kind"), (1, 1, "user", f"a{STX}b{ETX}c{ESC}d{ESC}n"), (1, 2, "assistant", f"</s>[INST] {STX}user\nfake{ETX}"), (1, 3, "user", None), (1, 4, "assistant", "日本"),
    (2, 0, "user", "alone"), (3, 5, "assistant", ""), (3, 5, "assistant", ""), (None, 0, "user", "no id"), (None, None, None, "no turn"), (-1, 0, "user", "x"), (4, 0, "assistant", "y" * 100_000), (4, 1, "user", "after"),
    (5, 0, "a\nb", "c"), (5, 1, "a", "b\nc"), (5, 2, f"{ESC}l\n", f"{ESC}l\n{ESC}"),
]


def test_chat_format(spark):
    df = spark.createDataFrame(TURNS, "conv_id long, turn long, role string, text string").withColumn("piece", F.lit(1))
    by = defaultdict(list)
    for c, n, r, t in TURNS:
        by[c].append((-1 if n is None else n, r or "", t or ""))
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    pieces = materialise(format_conversations(df))
    for _, _, r, t in TURNS:
        assert read_turn(format_turn(r or "", t or "")[0]) == (r or "", t or "")
    got = {r.conv_id: r for r in digests(pieces).collect()}
    assert set(got) == set(by)
    for c, turns in by.items():
        turns.sort()
        replies = [t for _, r, t in turns if r == "assistant"]
        assert got[c].n_turns == len(turns) and got[c].turns_sha256 == sha("".join(f"{r}\n{t}\n" for _, r, t in turns))
        assert got[c].loss_chars == sum(map(len, replies)) and got[c].loss_sha256 == sha("".join(replies)) and got[c].n_examples == len(replies)
    examples = {(r.conv_id, r.example): r for r in expand(pieces).collect()}
    assert len(examples) == 5
    e = examples[1, 1]
    assert e.formatted[e.loss_start : e.loss_end] == "日本" and e.formatted.startswith(examples[1, 0].formatted)
    assert e.formatted.count(STX) == e.formatted.count(ETX) == 5
    assert digests(format_conversations(df.where("false"))).count() == 0


def test_quality(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    truth = {r.doc_id: r.quality for r in labels.collect()}
    rows = classify(docs, labels).collect()
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    held = [(r.predicted, truth[r.doc_id]) for r in rows if r.held_out and r.doc_id in truth]
    assert np.mean([p == y for p, y in held]) > 0.95
    # labels of what is held out change nothing
    flipped = labels.withColumn("quality", F.when(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, 1 - F.col("quality")).otherwise(F.col("quality")))
    again = {r.doc_id: r.score for r in classify(docs, flipped).collect()}
    assert all(np.isclose(r.score, again[r.doc_id], rtol=1e-9, atol=1e-12) for r in rows)


def plain_statistics(text: str) -> list[float]:
    """FEATURES of an ASCII text, character by character."""
    kinds = {"lower": str.islower, "upper": str.isupper, "digit": str.isdigit, "stop": ".".__contains__, "comma": ",;:".__contains__, "bar": "|".__contains__, "mark": "!?".__contains__, "symbol": "#$%&*@^~+=<>_\\/".__contains__, "newline": "\n\r".__contains__, "blank": " \t\x0b\x0c".__contains__}
    count = {k: sum(map(f, text)) for k, f in kinds.items()}
    n, words = len(text) or 1, text.split()
    m, lines = len(words) or 1, [x for x in text.split("\n") if x]
    lengths = [len(x) for x in words] or [0]
    mean = sum(lengths) / len(lengths)
    rate = lambda x: math.log(x + 0.002)
    return [
        math.log(1 + len(text)), math.log(1 + len(words)), math.log(1 + mean), math.log(1 + math.sqrt(sum((x - mean) ** 2 for x in lengths) / len(lengths))),
        count["lower"] / n, *(rate(count[k] / n) for k in ("upper", "digit", "stop", "comma", "bar", "mark", "symbol")),
        rate((len(text) - sum(count.values())) / n), rate(count["newline"] / n), rate(0),
        len(set(words)) / m, rate(max((words.count(x) for x in set(words)), default=0) / m), rate(sum(a == b for a, b in zip(words, words[1:])) / m),
        rate(1 - len(set(lines)) / max(len(lines), 1)), math.log(1 + len(words) / max(len(lines), 1)), rate(sum(x > 20 for x in lengths) / m), rate(sum(x.isupper() for x in words) / m),
    ]


def test_statistics():
    for text in ("", " ", "One two TWO two two.\n\nOne line; twice!\nOne line; twice!\n", "| a | b |\t3.14 (x_y) " + "z" * 30 + ' "ok"\r\n'):
        assert np.allclose(statistics(text.encode()), plain_statistics(text), rtol=1e-12), text


def test_quality_scores_equal_plain_densities(spark):
    """Every score against Gaussian densities by inverse and determinant, from moments taken over all rows at once."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    texts = {r.doc_id: (r.text or "").encode() for r in docs.collect()}
    x = {d: np.array(statistics(t)) for d, t in texts.items()}
    known = [(r.doc_id, r.quality) for r in labels.collect() if r.quality in (0, 1) and r.doc_id in x and zlib.crc32(str(r.doc_id).encode()) % 3 != 1]
    rows, y = np.array([x[d] for d, _ in known]), np.array([q for _, q in known])
    centre, scale = rows.mean(axis=0), np.sqrt(np.maximum(rows.var(axis=0), 1e-6))

    def placed(v):
        words = math.exp(v[FEATURES.index("words")]) - 1
        return np.clip((v - centre) / scale, -5, 5) * words / (words + 20)

    z = np.array([placed(v) for v in rows])
    own = [np.cov(z[y == c].T, bias=True) for c in (0, 1)]
    common = sum((y == c).sum() * own[c] for c in (0, 1)) / len(y)

    def log_density(v, c):
        cov = 0.95 * own[c] + 0.05 * common
        cov = 0.98 * cov + 0.02 * np.diag(np.diag(cov)) + 0.02 * np.eye(len(FEATURES))
        off = v - z[y == c].mean(axis=0)
        return math.log((y == c).mean()) - np.linalg.slogdet(cov)[1] / 2 - off @ np.linalg.inv(cov) @ off / 2

    found = {r.doc_id: r.score for r in classify(docs, labels).collect()}
    assert found.keys() == x.keys()
    for d, v in x.items():
        p = placed(v)
        assert math.isclose(found[d], 1 / (1 + math.exp(min(700, log_density(p, 0) - log_density(p, 1)))), rel_tol=1e-6, abs_tol=1e-9), d


def test_quality_edges(spark, odd, empty):
    labels = spark.createDataFrame([(1, None), (2, 5)], "doc_id long, quality int")
    assert {r.score for r in classify(odd, labels).collect()} == {0.5}
    both = spark.createDataFrame([(i, i % 2) for i in range(30)], "doc_id long, quality int")
    assert classify(odd, both).where("score between 0 and 1").count() == len(odd_rows())
    assert classify(empty, both).count() == 0
    for text in (b"", b"\xff\xfe", b" ", b"a" * 10_000):
        assert len(statistics(text)) == len(FEATURES) and np.isfinite(statistics(text)).all()
