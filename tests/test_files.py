import io
import struct

import numpy as np
import pytest

from dishflow.operators import headers
from dishflow.sources.baseband import BasebandSource, segment_count


@pytest.mark.parametrize(("size", "trailing", "want"), [(0, False, 0), (3, False, 1), (8, False, 1), (9, False, 2), (14, False, 2), (8, True, 2), (14, True, 3), (7, True, 1)])
def test_segment_count(size, trailing, want):
    assert segment_count(size, 8, 2, trailing) == want


def test_overlapping_segments(spark, tmp_path):
    data = bytes(range(100))
    (tmp_path / "x.bin").write_bytes(b"HEAD" + data)
    spark.dataSource.register(BasebandSource)
    df = spark.read.format("baseband").options(path=str(tmp_path / "x.bin"), segment_bytes=32, reserved_bytes=8, offset_bytes=4, per_partition=2).load()
    rows = df.orderBy("seg").collect()
    assert [bytes(r.raw) for r in rows] == [data[a : a + 32].ljust(32, b"\0") for a in range(0, 96, 24)]
    assert df.rdd.getNumPartitions() == 2


def test_layouts():
    re, im = np.arange(6.0), -np.arange(6.0)
    assert np.load(io.BytesIO(headers.npy_bytes(re, im, 2))).tolist() == (re + 1j * im).reshape(2, 3).tolist()
    assert np.frombuffer(headers.tim_bytes([1, 2.5]), "<f4").tolist() == [1.0, 2.5]
    h = headers.filterbank_header({"nbits": 8, "fch1": 1500.0, "source_name": "x"})
    assert h.startswith(struct.pack("<i", 12) + b"HEADER_START") and h.endswith(b"HEADER_END") and struct.pack("<d", 1500.0) in h
