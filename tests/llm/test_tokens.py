import random
import uuid
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from dishflow.llm.common import scratch_dir
from dishflow.llm.packing import best_fit_plan, cut, pack_documents
from dishflow.llm.token_files import Shard, read_token_files, token_digests, write_shard, write_token_files
from dishflow.llm.tokens import Encoder, encoded
from tests.llm.conftest import odd_rows

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def plain():
    t = Tokenizer.from_file(PATH)
    return lambda texts: [np.array(x.ids, "<u4").tobytes() for x in t.encode_batch(texts, add_special_tokens=False)]


def test_pieces_give_the_ids_of_whole_texts(plain, monkeypatch):
    import dishflow.llm.tokens as tokens

    monkeypatch.setattr(tokens, "CACHE_PIECES", 200)
    rng = random.Random(2)
    parts = ["a", "b", " ", "  ", "\n", "\t", "'s", "'", "1", "é", "\x1c", "\x85", "\xa0", "<|endoftext|>", ".", "́", "日", "\r\n", "\x0b", " the", "Foo.\nBar", "\n\n", "\x00", "don't!", "x," * 40, "É;", "ª.", "...", "?\n", "ġ", "Ġ"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 12))) for _ in range(6000)]
    own = Encoder(PATH)
    assert own.cuttable
    for i in range(0, len(texts), 500):
        found = own.encode(pa.array(texts[i : i + 500]), 7, np.dtype("<u4"))
        assert [bytes(x) for x in found] == [x + np.uint32(7).tobytes() for x in plain(texts[i : i + 500])]


def test_control_strings_in_texts_get_the_ids_that_the_library_gives(plain):
    texts = ["<|endoftext|>", "a <|endoftext|> b", "x<|endoftext|>y", "<|endoftext|", ""]
    found = Encoder(PATH).encode(pa.array(texts), 0, np.dtype("<u4"))
    assert [bytes(x)[:-4] for x in found] == plain(texts) and bytes(found[0]) == np.array([50256, 0], "<u4").tobytes()


def test_ids_must_fit_their_width():
    batch = pa.RecordBatch.from_arrays([pa.array([1]), pa.array(["a"])], names=["doc_id", "text"])
    with pytest.raises(ValueError):
        next(encoded(iter([batch]), PATH, 2, width=1))
    with pytest.raises(ValueError):
        next(encoded(iter([batch]), PATH, 70_000, width=2))


def test_slices_and_nulls(plain):
    texts = ["skipped", None, "one two,", "", "three  four\n\nfive!", None]
    batch = pa.RecordBatch.from_arrays([pa.array(range(6)), pa.array(texts)], names=["doc_id", "text"]).slice(1)
    for size in (1, 10, 1000):
        got = [(k, bytes(x)[:-4]) for k, x in encoded(iter([batch]), PATH, 2, size=size)]
        assert got == list(zip(range(1, 6), plain([t or "" for t in texts[1:]]), strict=True))


def test_other_tokenizers_are_used_as_they_are():
    path = public_tokenizers.path("word_bpe_49k.json")
    t, own = Tokenizer.from_file(path), Encoder(path)
    assert not own.cuttable
    assert bytes(own.encode(pa.array(["Hello  World"]), 9, np.dtype("<u4"))[0]) == np.array([*t.encode("Hello  World", add_special_tokens=False).ids, 9], "<u4").tobytes()


def test_shard_round_trip():
    import zstandard

    packer = zstandard.ZstdCompressor(write_content_size=True)
    docs = [np.arange(n, dtype="<u2") for n in (1, 0, 300)]
    data = write_shard([5, None, 7], [len(d) for d in docs], [packer.compress(d.tobytes()) for d in docs], b"", 2)
    shard = Shard(data, b"")
    assert shard.doc_ids == [5, None, 7] and all((shard.ids(i) == d).all() for i, d in enumerate(docs))
    with pytest.raises(ValueError):
        Shard(data, b"another dictionary")


def test_token_files(spark, odd, plain):
    path = f"{scratch_dir(spark)}/tokens-{uuid.uuid4().hex}"
    write_token_files(odd, path, PATH, end_id=2)
    got = token_digests(spark, path).orderBy("start").collect()
    want = {}
    rows = odd_rows()
    for (i, *_), ids in zip(rows, plain([t or "" for _, t, *_ in rows]), strict=True):
        want.setdefault(i, []).append(ids + np.uint32(2).tobytes())
    assert [r.doc_id for r in got] == sorted((r[0] for r in rows), key=lambda i: (i is None, i))
    at = 0
    for r in got:
        own = next(x for x in want[r.doc_id] if zlib.crc32(x) == r.ids_crc32)
        want[r.doc_id].remove(own)
        assert r.start == at and r.n_tokens == len(own) // 4
        at += r.n_tokens
    assert read_token_files(spark, path).count() == len(rows)


def test_hot_and_missing_ids_are_dealt_to_many_shards(spark, plain):
    rows = [(5, f"text {i}") for i in range(200)] + [(None, f"none {i}") for i in range(150)] + [(i, f"own {i}") for i in range(60)]
    path = f"{scratch_dir(spark)}/tokens-{uuid.uuid4().hex}"
    write_token_files(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), path, PATH, end_id=2)
    got = token_digests(spark, path).orderBy("start").collect()
    assert [r.doc_id for r in got] == sorted((i for i, _ in rows), key=lambda i: (i is None, i))
    assert [r.start for r in got] == np.cumsum([0, *(r.n_tokens for r in got[:-1])]).tolist()
    want = sorted(zlib.crc32(x + np.uint32(2).tobytes()) for x in plain([t for _, t in rows]))
    assert sorted(r.ids_crc32 for r in got) == want
    assert max(r.n_docs for r in spark.read.parquet(f"{path}/shards").collect()) < 150


def test_cut():
    assert cut(3, 2048) == [(0, 3)] and cut(2048, 2048) == [(0, 2048)] and cut(4100, 2048) == [(0, 4), (4, 2048), (2052, 2048)]


@pytest.mark.parametrize("histogram", [{}, {2048: 3}, {1: 5000}, {5: 3, 2048: 4, 1000: 7, 1: 50}, {300: 1000, 700: 333, 2047: 10, 1: 3, 1024: 55}])
def test_plan(histogram):
    filled = {}
    seen = dict.fromkeys(histogram, 0)
    for length, a, b, first, each, offset in best_fit_plan(histogram, 2048):
        assert a == seen[length]
        seen[length] = b
        for r in range(b - a):
            filled.setdefault(first + r // each, []).append((offset + r % each * length, length))
    assert seen == histogram
    for slots in filled.values():
        slots.sort()
        assert [s for s, _ in slots] == np.cumsum([0, *(n for _, n in slots[:-1])]).tolist() and sum(n for _, n in slots) <= 2048
    total = sum(n * c for n, c in histogram.items())
    assert len(filled) <= 11 / 9 * -(-total // 2048) + 1


def test_packing(odd, plain):
    rows = odd_rows()
    got = pack_documents(odd, PATH, capacity=64).toPandas()
    want = []
    for (i, *_), ids in zip(rows, plain([t or "" for _, t, *_ in rows]), strict=True):
        own = memoryview(ids + np.uint32(0).tobytes())
        want += [str((i, k, s, n, zlib.crc32(own[4 * s : 4 * (s + n)]))) for k, (s, n) in enumerate(cut(len(own) // 4, 64))]
    ids = [None if i != i else int(i) for i in got.doc_id]
    assert sorted(str((i, *map(int, r))) for i, r in zip(ids, got[["piece", "start", "length", "ids_crc32"]].values, strict=True)) == sorted(want)
    for _, seq in got.sort_values("offset").groupby("sequence_id"):
        assert seq.offset.tolist() == np.cumsum([0, *seq.length[:-1]]).tolist() and seq.length.sum() <= 64


def test_empty_tables(spark, empty):
    path = f"{scratch_dir(spark)}/tokens-{uuid.uuid4().hex}"
    write_token_files(empty, path, PATH, end_id=2)
    assert token_digests(spark, path).count() == 0 and pack_documents(empty, PATH).count() == 0
