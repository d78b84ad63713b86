"""Configuration: strings whose arithmetic is evaluated, from several layers, into an immutable dataclass."""

from __future__ import annotations

import ast
import logging
import operator
from collections.abc import Mapping
from dataclasses import dataclass, fields

log = logging.getLogger(__name__)
_BINARY = {ast.Add: operator.add, ast.Sub: operator.sub, ast.Mult: operator.mul, ast.Div: operator.truediv, ast.Pow: operator.pow}
_UNARY = {ast.UAdd: operator.pos, ast.USub: operator.neg}


def evaluate(text: str) -> float:
    """Value of + - * / ** and parentheses over numbers, as in "1405 + (64 / 2)"."""

    def value(node: ast.AST) -> float:
        match node:
            case ast.Expression():
                return value(node.body)
            case ast.Constant(value=int() | float()):
                return node.value
            case ast.BinOp() if type(node.op) in _BINARY:
                return _BINARY[type(node.op)](value(node.left), value(node.right))
            case ast.UnaryOp() if type(node.op) in _UNARY:
                return _UNARY[type(node.op)](value(node.operand))
        raise ValueError(f"not an arithmetic expression: {text!r}")

    return float(value(ast.parse(text.strip(), mode="eval")))


@dataclass(frozen=True)
class Config:
    """Frequencies in MHz, rates in Hz, dispersion measure in pc/cm^3."""

    input_count: int = 1 << 28
    input_bits: int = 8
    format: str = "simple"
    freq_low: float = 1000.0
    bandwidth: float = 500.0
    sample_rate: float = 1e9
    reserve_sample: bool = True
    dm: float = 0.0
    input_offset_bytes: int = 0
    average_threshold: float = 10.0
    kurtosis_threshold: float = 1.1
    zap_list: str = ""
    channel_count: int = 1 << 15
    snr_threshold: float = 6.0
    channel_threshold: float = 0.9
    max_boxcar: int = 1024
    pixmap_width: int = 1920
    pixmap_height: int = 1080

    def __post_init__(self) -> None:
        if self.input_count % (2 * self.channel_count) and self.input_count >= 2 * self.channel_count:
            raise ValueError("input_count must be a multiple of twice the number of channels")

    @property
    def bins(self) -> int:
        return self.input_count // 2

    @property
    def freq_top(self) -> float:
        return self.freq_low + self.bandwidth


def parse_file(text: str) -> dict[str, str]:
    """name = value lines; # begins a comment, after a value too."""
    pairs = (line.split("#")[0].split("=", 1) for line in text.splitlines() if "=" in line.split("#")[0])
    return {k.strip(): v.strip() for k, v in pairs}


def load(*layers: Mapping[str, str]) -> Config:
    """The first layer that has a name decides (command line, file, ...); unknown names are reported and ignored."""
    kinds = {f.name: f.type for f in fields(Config)}
    found: dict[str, object] = {}
    for layer in layers:
        for name, text in layer.items():
            if name not in kinds:
                log.warning("unknown option %s", name)
            elif name not in found:
                kind = kinds[name]
                found[name] = text if kind == "str" else text.strip().lower() in ("1", "true", "yes", "on") if kind == "bool" else int(evaluate(text)) if kind == "int" else evaluate(text)
    return Config(**found)
