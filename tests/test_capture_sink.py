"""Files of raw bytes: pieces in, whole files out, nothing of a failed write."""

import io
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from dishflow.config import Config
from dishflow.operators import captures, detect
from dishflow.sources import capture_sink, store
from dishflow.sources.baseband import BasebandSource
from dishflow.sources.capture_sink import CaptureStreamWriter, Staged, _Stage


def listed(folder) -> dict[str, bytes]:
    return {n: open(f"{folder}/{n}", "rb").read() for n in sorted(os.listdir(folder)) if os.path.isfile(f"{folder}/{n}")}


def published(folder) -> list[str]:
    """Files but for what a task that ran on after the write had failed may have left below _temporary."""
    return [n for top, _, names in os.walk(folder) for n in names if "_temporary" not in top]


def pieces(spark, rows):
    return spark.createDataFrame([(f, a, bytearray(d)) for f, a, d in rows], capture_sink.PIECES)


def test_pieces_become_files(spark, tmp_path):
    data = {f"f{i}": os.urandom(1000 + i) for i in range(20)} | {"empty": b""}
    rows = [(n, a, d[a : a + 300]) for n, d in data.items() for a in range(0, max(1, len(d)), 300)]
    capture_sink.save(pieces(spark, rows[::-1]).repartition(5), f"file://{tmp_path}/out")
    assert listed(tmp_path / "out") == data and not os.listdir(tmp_path / "out/_temporary")
    with pytest.raises(Exception, match="FileExists|f3"):
        capture_sink.save(pieces(spark, [("f3", 0, b"new"), ("g", 0, b"x")]), f"file://{tmp_path}/out")
    assert listed(tmp_path / "out") == data
    capture_sink.save(pieces(spark, [("f3", 0, b"new")]), f"file://{tmp_path}/out", "overwrite")
    assert listed(tmp_path / "out") == data | {"f3": b"new"}


@pytest.mark.parametrize("rows", [[("a", 0, b"xx"), ("a", 3, b"y")], [("a", 1, b"x")], [("../a", 0, b"x")], [("_a", 0, b"x")], [(None, 0, b"x")]])
def test_bad_pieces_leave_no_file(spark, tmp_path, rows):
    good = [(f"g{i}", 0, b"good") for i in range(8)]
    with pytest.raises(Exception, match="piece|file name"):
        capture_sink.save(pieces(spark, good + rows), f"file://{tmp_path}/out")
    assert not published(tmp_path)


def test_a_killed_task_leaves_no_file(spark, tmp_path):
    """A task that dies while it writes: the others' files don't get their names either."""

    def dies(batches):
        for batch in batches:
            yield batch
            if "k7" in batch.column(0).to_pylist():
                os._exit(1)

    rows = pieces(spark, [(f"k{i}", 0, b"data") for i in range(16)]).repartition(4, "file").sortWithinPartitions("file", "at")
    spark.dataSource.register(capture_sink.CaptureSink)
    with pytest.raises(Exception, match="."):
        rows.mapInArrow(dies, capture_sink.PIECES).write.format("captures").mode("append").save(f"file://{tmp_path}/out")
    assert not published(tmp_path)


def test_batches_are_published_once(tmp_path):
    import pyarrow as pa

    batch = lambda d: pa.RecordBatch.from_pydict({"file": ["a", "b"], "at": [0, 0], "data": [d, d]})
    uri = f"file://{tmp_path}"
    one = CaptureStreamWriter(uri)
    one.commit([one.write(iter([batch(b"1")])), Staged()], 0)
    again = CaptureStreamWriter(uri)  # after a restart the batch runs again
    again.commit([again.write(iter([batch(b"2")]))], 0)
    assert listed(tmp_path) == {"a": b"1", "b": b"1"}
    again.commit([again.write(iter([batch(b"3")]))], 1)
    assert listed(tmp_path) == {"a": b"3", "b": b"3"} and sorted(os.listdir(tmp_path / "_commits")) == ["0", "1"]
    twice = _Stage(uri)
    with pytest.raises(ValueError, match="several tasks"):
        twice.publish([twice.write(iter([batch(b"4")])), twice.write(iter([batch(b"5")]))], True)


def test_store_sizes(tmp_path):
    (tmp_path / "b").write_bytes(b"12")
    (tmp_path / "a").write_bytes(b"1")
    (tmp_path / "_c").write_bytes(b"1")
    assert list(store.sizes(f"file://{tmp_path}").values()) == [1, 2] and list(store.sizes(str(tmp_path / "_c")).values()) == [1]
    with pytest.raises(FileNotFoundError):
        store.sizes(f"file://{tmp_path}/none")


def test_baseband_reads_folders(spark, tmp_path):
    data = {f"x{i}.bin": os.urandom(70 + i) for i in range(3)}
    for n, d in data.items():
        (tmp_path / n).write_bytes(d)
    spark.dataSource.register(BasebandSource)
    df = spark.read.format("baseband").options(path=f"file://{tmp_path}", segment_bytes=32, reserved_bytes=8, per_partition=2).load()
    got = sorted((r.file.rsplit("/", 1)[1], r.seg, bytes(r.raw)) for r in df.collect())
    assert got == sorted((n, i, d[a : a + 32].ljust(32, b"\0")) for n, d in data.items() for i, a in enumerate(range(0, len(d) - 8, 24)))


def test_capture_holds_what_the_search_saw(spark, tmp_path):
    c = Config(input_count=512, channel_count=8, dm=3e-5, average_threshold=8.0, kurtosis_threshold=1.6, max_boxcar=4)
    x = np.random.default_rng(0).integers(0, 256, 512).astype(float)
    df = spark.createDataFrame([(77, x.tolist(), [1, 4]), (88, x.tolist(), None)], "counter long, x array<double>, boxcars array<int>")
    capture_sink.save(captures.capture_pieces(df, c), f"file://{tmp_path}/c")
    got = listed(tmp_path / "c")
    assert sorted(got) == ["77.0.npy", "77.1.tim", "77.4.tim", "77.bin", "88.0.npy", "88.bin"]
    spectra = detect.cleaned_spectra(x[None], c, [])
    assert np.allclose(np.load(io.BytesIO(got["88.0.npy"])), spectra[0].astype("<c8")) and got["77.bin"] == x.astype(np.uint8).tobytes()
    files = spark.read.format("binaryFile").load(f"file://{tmp_path}/c/*.tim").select(F.element_at(F.split("path", "/"), -1).alias("file"), "content")
    y = {r.file: r.y for r in captures.series_of_files(files).collect()}
    n = 512 // 16 - captures.reserved_samples(c) // 8
    assert len(y["77.1.tim"]) == n and len(y["77.4.tim"]) == n - 4 and np.allclose(y["77.4.tim"][0], sum(y["77.1.tim"][1:5]), rtol=1e-4)
