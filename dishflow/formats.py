"""Packet and sample formats by name. Names describe the layout of a recorder's packets."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Format:
    header_bytes: int
    packet_bytes: int
    streams: int
    interleave: str  # how streams share samples: "", "1212", "1122", "word2", "word4_xor"

    @property
    def payload_bytes(self) -> int:
        return self.packet_bytes - self.header_bytes


FORMATS = {
    "simple": Format(0, 0, 1, ""),
    "counter64": Format(8, 4104, 1, ""),
    "counter64_2pol": Format(8, 4104, 2, "1122"),
    "vdif_2pol": Format(64, 8256, 2, "word2"),
    "vdif_4pol": Format(64, 8256, 4, "word4_xor"),
}
ALIASES = {"counter64_1pol": "counter64"}


def lookup(name: str) -> Format:
    try:
        return FORMATS[ALIASES.get(name, name)]
    except KeyError:
        raise ValueError(f"unknown format {name!r}; known: {', '.join([*FORMATS, *ALIASES])}") from None
