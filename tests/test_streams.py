"""State of live streams, against the same packets taken one by one; restarts."""

import os
import random
from types import SimpleNamespace

import numpy as np
import pandas as pd
import pytest

from dishflow.jobs import live
from dishflow.sources.capture_sink import CaptureSink
from dishflow.streaming import blocks as B


class Cell:
    def __init__(self):
        self.value = None

    def get(self):
        return self.value

    def update(self, value):
        self.value = value

    put = update

    def clear(self):
        self.value = None


class Cells(Cell):
    def get(self):
        return iter(self.value or [])


class Handle:
    """What a processor asks of its state store and timers."""

    def __init__(self):
        self.timers = set()

    def getValueState(self, name, kind):  # noqa: N802
        return Cell()

    def getListState(self, name, kind):  # noqa: N802
        return Cells()

    def registerTimer(self, ms):  # noqa: N802
        self.timers.add(ms)

    def deleteTimer(self, ms):  # noqa: N802
        self.timers.discard(ms)


def batches(rng, rows, columns):
    """Rows in micro-batches of random size, each in chunks and out of order."""
    at = 0
    while at < len(rows):
        n = rng.randint(1, 30)
        some = rows[at : at + n]
        at += n
        rng.shuffle(some)
        cut = rng.randint(0, len(some))
        yield [pd.DataFrame(x, columns=columns) for x in (some[:cut], some[cut:]) if x]


def fed(processor, rng, rows, columns):
    handle = Handle()
    processor.init(handle)
    out = [f for chunk in batches(rng, list(rows), columns) for f in processor.handleInputRows((3,), iter(chunk), None)]
    return handle, [tuple(x) for f in out for x in f.itertuples(index=False, name=None)]


@pytest.mark.parametrize("size", [1, 3, 7, 40, 1000])
def test_continuous_receiver(size):
    rng = random.Random(size)
    for _ in range(20):
        counter, rows, arrival = rng.randint(0, 5), [], 0
        for _ in range(rng.randint(1, 120)):
            arrival += 1
            seen = rng.choice([counter, counter, counter, max(0, counter - 2)])  # some come again, or late
            rows.append((arrival, seen, os.urandom(3)))
            counter += rng.choice([1, 1, 1, 1, 2, 5, 40])
        first, last, want = rows[0][1], rows[0][1] - 1, b""
        for _, c, data in rows:
            if c > last:
                want += bytes(3 * (c - last - 1)) + data
                last = c
        _, got = fed(B.ContinuousReceiver(size), rng, rows, ["arrival", "counter", "data"])
        at = 0
        for stream, begins, block, n, data in got:
            assert (stream, block) == (3, at) and begins <= block and (data is None or n == 1 and len(data) == size)
            assert (data or bytes(n * size)) == want[block * size : (block + n) * size]
            at += n
        assert at == len(want) // size and first >= 0


def test_a_long_gap_is_one_row():
    rows = [(0, 5, b"abc"), (1, 5 + 10**12, b"xyz"), (2, 6 + 10**12, b"uvw")]
    _, got = fed(B.ContinuousReceiver(4), random.Random(0), rows, ["arrival", "counter", "data"])
    assert [x[2:4] for x in got if x[4] is None] == [(1, (3 * (10**12 - 1) - 1) // 4)] and len(got) <= 4


def test_block_assembler():
    rng = random.Random(1)
    for size in (1, 4, 16):
        for _ in range(20):
            rows = [(i, max(0, i // 2 + rng.choice([0, 0, 0, -20, 1, 9])), rng.randint(1, 255), 1000 * i) for i in range(rng.randint(1, 150))]
            want, block, slots, late = [], None, {}, 0
            close = lambda: (3, block, len(slots), sum(slots.values()), sum((s + 1) * v for s, v in slots.items()), late)  # noqa: E731, B023
            for _, counter, b, _ in rows:
                if counter < 5:
                    continue
                at, slot = divmod(counter - 5, size)
                if block is not None and at < block:
                    late += 1
                    continue
                if block is not None and at > block:
                    want.append(close())
                    slots, late = {}, 0
                block = at
                slots[slot] = b
            processor = B.BlockAssembler(size, 5, 100)
            handle, got = fed(processor, rng, rows, ["arrival", "counter", "b", "ms"])
            assert got == want
            if block is None:
                assert not handle.timers
                continue
            (due,) = handle.timers
            rest = [tuple(x) for f in processor.handleExpiredTimer((3,), None, SimpleNamespace(getExpiryTimeInMs=lambda: due)) for x in f.itertuples(index=False, name=None)]  # noqa: B023
            assert rest == [close()] and processor.open.get() is None


def test_capture_queue():
    rng = random.Random(2)
    for _ in range(30):
        ts = np.cumsum([rng.choice([0, 3, 10, 60]) for _ in range(rng.randint(1, 120))]).tolist()
        rows = [(i, t, rng.random() < 0.1) for i, t in enumerate(ts)]
        want = sorted(i for i, t, _ in rows if any(p and abs(t - u) < 50 for _, u, p in rows))
        processor = B.CaptureQueue(50)
        _, got = fed(processor, rng, rows, ["id", "ts", "has_signal"])
        assert sorted(x[0] for x in got) == want


@pytest.mark.parametrize("stop", [1, 2, 3])
def test_a_restarted_recording_has_the_same_bytes(spark, sf, stop):
    """Also when a batch's commit was lost after its files had got their names: it runs again and writes nothing twice."""
    spark.dataSource.register(CaptureSink)
    payloads = live._payloads(spark, sf, 0)
    replay = live.Replay(payloads, "arrival")
    make = lambda: B.recording(B.received(replay.stream(), 40), 40)
    folder = live.run(make(), replay, sink="captures", arrivals=stop)
    path = folder.removeprefix("file://")
    batch = max(int(x) for x in os.listdir(f"{path}/checkpoint/commits") if x.isdigit())
    for name in (str(batch), f".{batch}.crc"):
        if os.path.exists(f"{path}/checkpoint/commits/{name}"):
            os.remove(f"{path}/checkpoint/commits/{name}")
    live.run(make(), replay, sink="captures", folder=folder)
    rows = payloads.orderBy("arrival").collect()
    files = sorted(x for x in os.listdir(f"{path}/out") if x.endswith(".bin"))
    for stream in range(16):
        own = [(r.counter, bytes(r.data)) for r in rows if r.stream_id == stream]
        want = bytearray(3 * (own[-1][0] - own[0][0] + 1))
        for counter, data in own:
            want[3 * (counter - own[0][0]) : 3 * (counter - own[0][0]) + 3] = data
        got = b"".join(open(f"{path}/out/{x}", "rb").read() for x in files if x.startswith(f"{stream}-"))
        assert got == bytes(want[: len(want) // 40 * 40])


def test_offsets_are_names(tmp_path, spark):
    from dishflow.sources.packet_files import PacketReader

    schema = spark.createDataFrame([], "a long").schema
    spark.range(3).selectExpr("id AS a", "id AS more").coalesce(1).write.parquet(f"file://{tmp_path}/x")
    part = next(x for x in os.listdir(tmp_path / "x") if x.startswith("part"))
    for i in range(3):
        (tmp_path / f"{i:03d}.parquet").write_bytes((tmp_path / "x" / part).read_bytes())
    reader = PacketReader(f"file://{tmp_path}", schema)
    assert reader.latestOffset() == {"last": "002.parquet"}
    some = reader.partitions({"last": "000.parquet"}, {"last": "002.parquet"})
    assert [x.path.rsplit("/", 1)[1] for x in some] == ["001.parquet", "002.parquet"] and reader.partitions(reader.initialOffset(), {"last": ""}) == []
    assert [b.to_pydict() for b in reader.read(some[0])] == [{"a": [0, 1, 2]}]
