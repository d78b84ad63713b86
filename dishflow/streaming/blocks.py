"""Live packets: blocks, a continuous stream of bytes, and capture, all with state that is bounded by one block or window.

Within a micro-batch the packets of a stream are put in order of their arrival by numpy; nothing is done row by row but
where a gap or a block's end is. A micro-batch holds what arrived since the last one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle


def _columns(rows: Iterator[pd.DataFrame], order: list[str], names: list[str]) -> list[np.ndarray]:
    """Columns of a key's rows in some order."""
    parts = [[frame[c].to_numpy() for c in (*order, *names)] for frame in rows]
    cols = [np.concatenate(c) for c in zip(*parts, strict=True)]
    at = np.lexsort(cols[: len(order)][::-1])
    return [c[at] for c in cols[len(order) :]]


BLOCKS = "stream_id long, block long, received long, total long, checksum long, late long"


class BlockAssembler(StatefulProcessor):
    """One open block for each stream: packets before it are late, dropped and counted with it; of equal counters the last
    stays; a packet that reaches a later block closes it, and so does time: when the watermark has passed a block's last
    packet by `timeout` ms. What a block lacks is 0."""

    def __init__(self, size: int, first: int, timeout: int) -> None:
        self.size, self.first, self.timeout = size, first, timeout

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", "block long, slots binary, late long, due long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        counter, b, ms = _columns(rows, ["arrival"], ["counter", "b", "ms"])
        keep = counter >= self.first
        counter, b, ms = counter[keep] - self.first, b[keep], ms[keep]
        state = self.open.get()
        if not len(counter):
            return
        block, slots, late, due = state if state is not None else (int(counter[0]) // self.size, b"", 0, 0)
        held = np.frombuffer(slots, np.int64).reshape(-1, 2)
        at = counter // self.size
        reached = np.maximum.accumulate(np.maximum(at, block))  # the block that is open when a packet has arrived
        out = []
        for no in np.unique(np.append(reached, block)).tolist():
            own = reached == no
            good = own & (at == no)
            found = np.stack([counter[good] % self.size, b[good]], axis=1).astype(np.int64)
            held = np.concatenate([held, found]) if no == block else found
            last = len(held) - 1 - np.unique(held[::-1, 0], return_index=True)[1] if len(held) else []
            held, block, late = held[last], no, (late if no == block else 0) + int((own & (at < no)).sum())
            if no < reached[-1]:
                out.append(self._closed(key[0], no, held, late))
        if due:
            self.handle.deleteTimer(due)
        due = max(int(ms[at == block].max(initial=0)) + self.timeout, due if state is not None and state[0] == block else 0)
        self.handle.registerTimer(due)
        self.open.update((block, held.tobytes(), late, due))
        if out:
            yield pd.DataFrame(out, columns=[x.split()[0] for x in BLOCKS.split(", ")])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        state = self.open.get()
        if state is not None and expiredTimerInfo.getExpiryTimeInMs() >= state[3]:
            block, slots, late, _ = state
            self.open.clear()
            yield pd.DataFrame([self._closed(key[0], block, np.frombuffer(slots, np.int64).reshape(-1, 2), late)], columns=[x.split()[0] for x in BLOCKS.split(", ")])

    @staticmethod
    def _closed(stream: int, no: int, held: np.ndarray, late: int) -> tuple:
        return stream, no, len(held), int(held[:, 1].sum()), int(((held[:, 0] + 1) * held[:, 1]).sum()), late

    def close(self) -> None:
        pass


def assembled(packets: DataFrame, size: int, first: int, timeout: int, delay: str) -> DataFrame:
    """BLOCKS of a stream of packets (stream_id, arrival, counter, b, ts). A row of stream -1 is a heartbeat: it says nothing
    but the time, so that blocks close when their streams have fallen silent."""
    timed = packets.withWatermark("ts", delay)
    # naming ts keeps this filter behind the watermark, which heartbeats are for
    own = timed.where((F.col("stream_id") >= 0) | F.col("ts").isNull()).withColumn("ms", F.unix_millis("ts"))
    return own.groupBy("stream_id").transformWithStateInPandas(BlockAssembler(size, first, timeout), BLOCKS, "append", "EventTime")


SPANS = "stream_id long, batch_first long, block long, blocks long, data binary"


class ContinuousReceiver(StatefulProcessor):
    """Payloads of one stream as blocks of `size` bytes, whatever the payloads' length: what is left of a payload begins the
    next block. Missing packets are zeros that are owed, a number: blocks of nothing but owed zeros come out as one row
    with their number and no data. Packets that come again or too late are dropped."""

    def __init__(self, size: int) -> None:
        self.size = size

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("state", "last long, block long, rest binary")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        counter, data = _columns(rows, ["arrival"], ["counter", "data"])
        state = self.state.get()
        last, block, rest = state if state is not None else (int(counter[0]) - 1, 0, b"")
        before = np.maximum.accumulate(np.append(last, counter))[:-1]
        fresh = counter > before
        counter, data, gap = counter[fresh], data[fresh], (counter - before - 1)[fresh]
        first, out, size = block, [], self.size
        runs = np.unique(np.append(0, np.flatnonzero(gap > 0))).tolist() if len(counter) else []
        for a, b in zip(runs, [*runs[1:], len(counter)], strict=False):
            if gap[a]:
                owed = int(gap[a]) * len(data[a])
                fill = min(owed, (size - len(rest)) % size)
                rest, owed = rest + bytes(fill), owed - fill
                if len(rest) == size:
                    out.append((key[0], first, block, 1, rest))
                    rest, block = b"", block + 1
                if owed >= size:
                    out.append((key[0], first, block, owed // size, None))
                    block += owed // size
                rest += bytes(owed % size)
            whole = rest + b"".join(data[a:b])
            n = len(whole) // size
            out += [(key[0], first, block + i, 1, whole[i * size : (i + 1) * size]) for i in range(n)]
            rest, block = whole[n * size :], block + n
        self.state.update((int(counter[-1]) if len(counter) else last, block, rest))
        if out:
            yield pd.DataFrame(out, columns=[x.split()[0] for x in SPANS.split(", ")])

    def close(self) -> None:
        pass


def received(packets: DataFrame, size: int) -> DataFrame:
    """SPANS of a stream of packets (stream_id, arrival, counter, data): block numbers count from a stream's first packet;
    batch_first is the first block of a micro-batch's rows."""
    return packets.groupBy("stream_id").transformWithStateInPandas(ContinuousReceiver(size), SPANS, "append", "None")


def recording(spans: DataFrame, size: int) -> DataFrame:
    """Pieces (file, at, data) of a recording of each stream: a file for what each micro-batch brings, named by stream and
    first byte. Of a run of zeros only the last block is a piece; the sink fills what lies before it."""
    name = F.concat(F.col("stream_id").cast("string"), F.lit("-"), F.lpad((F.col("batch_first") * size).cast("string"), 20, "0"), F.lit(".bin"))
    at = (F.col("block") + F.col("blocks") - 1 - F.col("batch_first")) * size
    return spans.select(name.alias("file"), at.alias("at"), F.coalesce("data", F.unhex(F.lit("00" * size))).alias("data"))


class CaptureQueue(StatefulProcessor):
    """Real-time capture: a positive is written and remembered; a negative is written if it is
    within the window of the last positive, else it waits for the next one. Waiting segments that have fallen out of
    the window are let go, so the state is bounded by the segments of one window."""

    def __init__(self, window: int) -> None:
        self.window = window

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "ts long")
        self.waiting = handle.getListState("waiting", "id long, ts long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        state = self.last.get()
        ids, ts, positive = _columns(rows, ["ts", "id"], ["id", "ts", "has_signal"])
        old = np.array([(i, t) for i, t in self.waiting.get()], np.int64).reshape(-1, 2)
        ids, ts, positive = np.append(old[:, 0], ids), np.append(old[:, 1], ts), np.append(np.zeros(len(old), bool), positive.astype(bool))
        far = np.int64(1) << 62
        n = np.arange(len(ts))
        before = np.maximum.accumulate(np.where(positive, ts, -far if state is None else state[0]))
        after = np.minimum.accumulate(np.where(positive, ts, far)[::-1])[::-1]
        near = positive | ((ts - before < self.window) & (n >= len(old))) | (after - ts < self.window)
        waits = ~near & (ts[-1] - ts < self.window)
        if (positive | (before > -far)).any():
            self.last.update((int(before[-1]),))
        self.waiting.put(list(zip(ids[waits].tolist(), ts[waits].tolist(), strict=True))) if waits.any() else self.waiting.clear()
        yield pd.DataFrame({"id": ids[near], "ts": ts[near]}).astype("int64")

    def close(self) -> None:
        pass


def captured(works: DataFrame, window: int) -> DataFrame:
    """id, ts of what is written of a stream of (stream_id, id, ts, has_signal): what lies within the window of a positive,
    as in the batch operator, for streams whose segments come in order of time."""
    return works.groupBy("stream_id").transformWithStateInPandas(CaptureQueue(window), "id long, ts long", "append", "None")


def captured_across(works: DataFrame, positives: DataFrame, window: int, delay: str) -> DataFrame:
    """id, at of segments (id, at: timestamp) that lie strictly within `window` us of a positive (at) of any stream: a join of
    two streams by time, on buckets of the window's width; watermarks on both sides let their states go."""
    bucket = F.floor(F.unix_micros("at") / window)
    left = works.withWatermark("at", delay).withColumn("bucket", bucket)
    seen = positives.select("at").withWatermark("at", delay).withColumn("b", bucket)
    right = seen.select(F.col("at").alias("seen"), F.explode(F.array(F.col("b") - 1, F.col("b"), F.col("b") + 1)).alias("near"))
    inside = f"bucket = near AND at > seen - interval {window} microseconds AND at < seen + interval {window} microseconds"
    return left.join(right, F.expr(inside), "left_semi").select("id", "at")
