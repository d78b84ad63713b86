"""Segments beyond one row: a segment of n samples is n / cols chunk rows, and no task ever holds it.

The transform is a four-step one. With n = rows * cols, sample rows a * cols + b lies in chunk a:

1. Chunks are cut into blocks of columns and dealt by block (first shuffle). A task transforms the columns of its block
   over all chunks; the samples are real, so half of the rows k1 = 0..rows/2 say everything. Values are turned by
   exp(-2 pi i b k1 / n).
2. Values are dealt by k1 (second shuffle) and transformed along b: row k1 then holds bins k1 + rows * k2; what lies in the
   upper half of the spectrum is, conjugated, row rows - k1.
3. Excision, scaling and dedispersion need a bin's number and the segment's mean power, a sum over rows, so they take no
   shuffle. Bins are dealt by blocks of neighbouring channels (third shuffle), which are transformed back to time.
4. Power is summed over channels in each task before it is shuffled, as chunks of the time series. Boxcars add up over
   chunk borders: each chunk gets the first samples of those after it.

Tasks hold rows * block, cols, or one block of bins: about sqrt(n) times a constant, 8 MB for 2^28 samples.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dishflow.config import Config
from dishflow.operators.dedisperse import phases, reserved_samples
from dishflow.operators.rfi import kurtosis_limits, parse_zap_list, zap_bins
from dishflow.sources.store import written
from dishflow.sources.tables import segments

SERIES = 1 << 14  # time samples of a chunk of a series
DOUBLES = pa.list_(pa.float64())


@dataclass(frozen=True)
class Layout:
    """n = rows * cols, both powers of two; block: columns, and gather: bins of each row, that a task of steps 1 and 3 takes."""

    n: int
    rows: int
    block: int = 64
    gather: int = 32

    def __post_init__(self) -> None:
        if self.n < 16 or self.n & (self.n - 1) or self.rows & (self.rows - 1) or not 2 <= self.rows <= self.n // 4:
            raise ValueError("n and rows must be powers of two, with at least two rows and four columns")

    @property
    def cols(self) -> int:
        return self.n // self.rows


def layout(n: int, rows: int | None = None) -> Layout:
    """As many chunks as samples in one, or half as many."""
    return Layout(n, rows or 1 << ((n.bit_length() - 1) // 2))


def power_of_two(n: int) -> int:
    return 1 << max(4, (n - 1).bit_length())


def chunk_rows(samples: DataFrame, lay: Layout, step: int | None = None) -> DataFrame:
    """row (seg * rows + chunk), x (cols samples): of samples (pos, x) of one stream. Segment seg begins at seg * step (below
    n: segments overlap). Positions without a row are 0."""
    step = step or lay.n
    last = F.floor(F.col("pos") / step).cast("long")
    held = F.filter(F.sequence(last - (-(-lay.n // step) - 1), last), lambda s: (s >= 0) & (F.col("pos") - s * step < lay.n))
    at = samples.select("pos", "x", F.explode(held).alias("seg")).withColumn("at", F.col("pos") - F.col("seg") * step)
    cells = at.select((F.col("seg") * lay.rows + F.floor(F.col("at") / lay.cols)).cast("long").alias("row"), (F.col("at") % lay.cols).alias("pos"), "x")
    return segments(cells, lay.cols, key="row")


def _stacked(table: pa.Table, name: str) -> np.ndarray:
    return table.column(name).combine_chunks().flatten().to_numpy().reshape(table.num_rows, -1)


def _lists(x: np.ndarray) -> pa.Array:
    """A row of a matrix is a list."""
    return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(np.ascontiguousarray(x).ravel()))


def _table(seg: int, n: int, **columns: pa.Array | np.ndarray) -> pa.Table:
    return pa.table({"seg": pa.array(np.full(n, seg)), **{k: v if isinstance(v, pa.Array) else pa.array(v) for k, v in columns.items()}})


def spectrum(chunks: DataFrame, lay: Layout) -> DataFrame:
    """seg, row, re, im, power: row r holds bins r + rows * j for j = 0..cols/2, unnormalised, and the sum of their power."""
    block = min(lay.block, lay.cols)
    angle = 2 * np.pi / lay.n

    def columns(group: pa.Table) -> pa.Table:
        part = group.column("part")[0].as_py()
        x = np.zeros((lay.rows, block))
        x[group.column("chunk").to_numpy()] = _stacked(group, "x")
        k1, b = np.arange(lay.rows // 2 + 1)[:, None], part * block + np.arange(block)
        z = np.fft.rfft(x, axis=0) * np.exp(-1j * angle * (k1 * b % lay.n))
        return _table(group.column("seg")[0].as_py(), len(z), k1=k1.ravel().astype(np.int32), part=np.full(len(z), part, np.int32), re=_lists(z.real), im=_lists(z.imag))

    def lines(group: pa.Table) -> pa.Table:
        k1, order = group.column("k1")[0].as_py(), np.argsort(group.column("part").to_numpy())
        z = np.fft.fft((_stacked(group, "re") + 1j * _stacked(group, "im"))[order].ravel())
        half = lay.cols // 2
        out = z[None, :half]
        if 0 < k1 < lay.rows // 2:
            out = np.stack([z[:half], np.conj(z[half:][::-1])])
        rows = np.array([k1, lay.rows - k1], np.int32)[: len(out)]
        return _table(group.column("seg")[0].as_py(), len(out), row=rows, re=_lists(out.real), im=_lists(out.imag), power=(out.real**2 + out.imag**2).sum(axis=1))

    cut = F.transform(F.sequence(F.lit(0), F.lit(lay.cols // block - 1)), lambda b: F.slice("x", b * block + 1, F.lit(block)))
    parts = chunks.select(F.expr(f"row div {lay.rows}").alias("seg"), (F.col("row") % lay.rows).cast("int").alias("chunk"), F.posexplode(cut).alias("part", "x"))
    turned = parts.groupBy("seg", "part").applyInArrow(columns, "seg long, k1 int, part int, re array<double>, im array<double>")
    return turned.groupBy("seg", "k1").applyInArrow(lines, "seg long, row int, re array<double>, im array<double>, power double")


def bins_of(rows: DataFrame, lay: Layout, wanted: list[int]) -> DataFrame:
    """seg, k, re, im of some bins."""
    some = rows.where(F.col("row").isin(sorted({k % lay.rows for k in wanted})))
    at = F.explode(F.filter(F.array(*map(F.lit, sorted(wanted))), lambda k: k % lay.rows == F.col("row"))).alias("k")
    cell = lambda c: F.get(c, F.expr(f"int(k div {lay.rows})")).alias(c)
    return some.select("seg", at, "re", "im").select("seg", F.col("k").cast("long").alias("k"), cell("re"), cell("im"))


def channels_of(rows: DataFrame, lay: Layout, c: Config) -> DataFrame:
    """seg, chan, re, im: cleaned and dedispersed bins, each channel transformed back to its time samples."""
    channels = min(c.channel_count, c.bins)
    length = c.bins // channels
    if length % lay.rows and lay.rows % length:
        raise ValueError("the bins of a channel must be a multiple or a divisor of the layout's rows")
    zapped = zap_bins(parse_zap_list(c.zap_list), c.bins, c.freq_low, c.bandwidth)
    width = min(c.bins, max(length, lay.rows * lay.gather))  # bins of a block
    each = width // lay.rows

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                seg, row, re, im, mean = (x[0] for x in batch.slice(i, 1).columns)
                z = re.values.to_numpy() + 1j * im.values.to_numpy()
                k = row.as_py() + lay.rows * np.arange(len(z))
                hit = z.real**2 + z.imag**2 > c.average_threshold * mean.as_py()
                for a, b in zapped:
                    hit |= (k >= a) & (k <= b)
                z = (np.where(hit, 0, z * (np.sqrt(channels) / c.bins)) * phases(k, c.bins, c.freq_low, c.bandwidth, c.dm)).reshape(-1, each)
                n = len(z)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, seg.as_py())), pa.array(np.arange(n, dtype=np.int32)), pa.array(np.full(n, row.as_py(), np.int32)), _lists(z.real), _lists(z.imag)], names=["seg", "part", "row", "re", "im"])

    def back(group: pa.Table) -> pa.Table:
        z = np.zeros((lay.rows, each), complex)
        z[group.column("row").to_numpy()] = _stacked(group, "re") + 1j * _stacked(group, "im")
        y = np.fft.ifft(z.T.reshape(-1, length), axis=1) * length
        first = group.column("part")[0].as_py() * width // length
        return _table(group.column("seg")[0].as_py(), len(y), chan=first + np.arange(len(y)), re=_lists(y.real), im=_lists(y.imag))

    mean = rows.groupBy("seg").agg((F.sum("power") / c.bins).alias("mean"))
    cleaned = rows.join(mean, "seg").select("seg", "row", "re", "im", "mean").mapInArrow(clean, "seg long, part int, row int, re array<double>, im array<double>")
    return cleaned.groupBy("seg", "part").applyInArrow(back, "seg long, chan long, re array<double>, im array<double>")


def series_of(spectra: DataFrame, c: Config, chunk: int = SERIES) -> DataFrame:
    """seg, part, y, zeros: power summed over the channels that spectral kurtosis leaves, in chunks of time samples without
    the reserved ones; zeros: channels whose first sample has no power (in part 0)."""
    channels = min(c.channel_count, c.bins)
    length = c.bins // channels
    keep = length - reserved_samples(c) // channels or length
    low, high = kurtosis_limits(c.kurtosis_threshold, length)
    names = ["seg", "part", "y", "zeros"]

    def batch_of(sums: dict[tuple[int, int], list]) -> pa.RecordBatch:
        cols = [[k[0] for k in sums], [k[1] for k in sums], [v[0] for v in sums.values()], [v[1] for v in sums.values()]]
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(cols, (pa.int64(), pa.int32(), DOUBLES, pa.int64()), strict=True)], names=names)

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[int, int], list] = {}
        for batch in batches:
            for i in range(batch.num_rows):
                seg, re, im = (x[0] for x in batch.slice(i, 1).columns)
                p = re.values.to_numpy() ** 2 + im.values.to_numpy() ** 2
                total = p.sum()
                sk = length * (p * p).sum() / (total * total) if total else 1.0
                p = np.zeros(length) if sk > high or sk < low else p
                for part, at in enumerate(range(0, keep, chunk)):
                    own = sums.setdefault((seg.as_py(), part), [np.zeros(min(chunk, keep - at)), 0])
                    own[0] += p[at : min(keep, at + chunk)]
                    own[1] += int(part == 0 and p[0] == 0)
            if len(sums) > 256:
                yield batch_of(sums)
                sums = {}
        if sums:
            yield batch_of(sums)

    def added(group: pa.Table) -> pa.Table:
        y = _stacked(group, "y").sum(axis=0)[None]
        return _table(group.column("seg")[0].as_py(), 1, part=group.column("part").combine_chunks()[:1], y=_lists(y), zeros=np.array([sum(group.column("zeros").to_pylist())]))

    partial = spectra.select("seg", "re", "im").mapInArrow(summed, "seg long, part int, y array<double>, zeros long")
    return partial.groupBy("seg", "part").applyInArrow(added, "seg long, part int, y array<double>, zeros long")


def boxcars(series: DataFrame, lengths: list[int], snr: float) -> DataFrame:
    """seg, boxcar, rms, peak, hits: of a series (seg, part, y), all parts but a segment's last of the same size. A boxcar of b
    is the sum of the b samples after each one (length 1: the sample), so it needs the first b of the parts that follow."""
    reach = max([b for b in lengths if b > 1], default=0)
    sizes = written(series.groupBy("seg").agg(F.max(F.size("y")).alias("size"), F.sum(F.size("y")).cast("long").alias("n")))
    known = series.join(sizes, "seg")
    own = known.select("seg", "part", F.lit(0).alias("ahead"), "y", "n", "size")
    away = F.explode(F.sequence(F.lit(1), F.ceil(F.lit(reach) / F.col("size")).cast("int"))).alias("ahead")
    heads = known.where((F.col("part") > 0) & F.lit(reach > 0)).select("seg", "part", away, "y", "n", "size").where("ahead <= part")
    taken = F.slice("y", F.lit(1), F.least(F.col("size"), F.lit(reach) - (F.col("ahead") - 1) * F.col("size")))
    sent = heads.select("seg", (F.col("part") - F.col("ahead")).alias("part"), "ahead", taken.alias("y"), "n", "size")

    def joined(group: pa.Table) -> pa.Table:
        order = np.argsort(group.column("ahead").to_numpy())
        pieces = [group.column("y")[int(i)].values.to_numpy() for i in order]
        y, size = np.concatenate(pieces), len(pieces[0])
        at = group.column("part")[0].as_py() * group.column("size")[0].as_py()
        n, total = group.column("n")[0].as_py(), np.concatenate([[0.0], np.cumsum(y)])
        rows, used = [], []
        for b in lengths:
            if b > 1 and b >= n:
                continue
            some = min(size, n - at if b == 1 else n - b - at)
            if some > 0:
                used.append(b)
                rows.append(y[:some] if b == 1 else total[b + 1 : b + 1 + some] - total[1 : 1 + some])
        return _table(group.column("seg")[0].as_py(), len(used), boxcar=np.array(used, np.int32), y=pa.array(rows, DOUBLES))

    found = written(own.unionByName(sent).groupBy("seg", "part").applyInArrow(joined, "seg long, boxcar int, y array<double>"))
    total = lambda v: F.aggregate("y", F.lit(0.0), v)
    each = found.select("seg", "boxcar", F.size("y").alias("n"), total(lambda a, v: a + v * v).alias("squares"), F.array_max("y").alias("peak"))
    rms = written(each.groupBy("seg", "boxcar").agg(F.sqrt(F.sum("squares") / F.sum("n")).alias("rms"), F.max("peak").alias("peak")))
    above = found.join(rms, ["seg", "boxcar"]).select("seg", "boxcar", "rms", "peak", F.size(F.filter("y", lambda v: v > snr * F.col("rms"))).alias("hits"))
    return above.groupBy("seg", "boxcar").agg(F.first("rms").alias("rms"), F.first("peak").alias("peak"), F.sum("hits").cast("long").alias("hits"))


def boxcar_lengths(n: int, most: int) -> list[int]:
    return [b for b in (1 << i for i in range(64)) if b == 1 or b < n and b <= most]


def without_baseline(series: DataFrame, c: Config) -> DataFrame:
    """Segments of which enough channels are left, minus their mean."""
    limit = c.channel_threshold * min(c.channel_count, c.bins)
    total = F.aggregate("y", F.lit(0.0), lambda a, v: a + v)
    means = series.groupBy("seg").agg((F.sum(total) / F.sum(F.size("y"))).alias("mean"), F.sum("zeros").alias("zeros")).where(F.col("zeros") < limit)
    return series.join(means, "seg").select("seg", "part", F.transform("y", lambda v: v - F.col("mean")).alias("y"))


def pulse_search(chunks: DataFrame, lay: Layout, c: Config, chunk: int = SERIES) -> DataFrame:
    """seg, boxcar, rms, peak, hits, as detect.pulse_search, for segments in chunk rows (row, x). Spectra that are used twice,
    for the mean power and for what follows, are written once; so is the time series."""
    if c.input_count != lay.n:
        raise ValueError("the configuration's input_count must be the layout's n")
    series = written(series_of(channels_of(written(spectrum(chunks, lay)), lay, c), c, chunk))
    length = c.bins // min(c.channel_count, c.bins)
    n = length - reserved_samples(c) // min(c.channel_count, c.bins) or length
    return boxcars(without_baseline(series, c), boxcar_lengths(n, c.max_boxcar), c.snr_threshold)
