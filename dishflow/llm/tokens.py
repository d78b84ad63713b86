"""Whole texts to token ids with the tokenizers library, many times faster than text by text.

A byte-level BPE never merges across a pre-token. A space or line end after a character that is no white space always
begins one, and so does ASCII punctuation after a letter or digit. So texts are cut there, in Arrow, and the library
encodes each different piece once for each task; pieces are looked up once for each batch, and ids are gathered for
whole batches. Texts that can't be cut so (control strings of the tokenizer, leading white space) go to the library whole.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Pieces of a cache generation: what isn't met while so many others come is forgotten. Longer pieces aren't kept.
CACHE_PIECES, CACHED_CHARS = 200_000, 64
BATCH_BYTES = 6_000_000
WORDS = 250  # that the library gets as one text: calls word by word cost more than the words
#: RE2: what str.isspace takes for white space, which includes all that any tokenizer does.
_WHITE = r"\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
_RUN = rf"[{_WHITE}][ \n]"
_PUNCTUATION = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"  # but for the apostrophe, which contractions begin with
_LETTER = "[A-Za-z0-9À-ÖØ-öø-ÿ]$"
_SPACE = re.compile(r"\s")
NUL = "\0"


def _gather(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The stretches of data, one after the other."""
    ends = np.cumsum(sizes)
    return data[np.repeat(starts - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)]


def _strings(col: pa.Array) -> list[str]:
    """As to_pylist, many times faster, for strings without NUL."""
    if not len(col):
        return []
    return pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(col)], pa.int32()), col), NUL)[0].as_py().split(NUL)


def _tails(pieces: pa.Array, sizes: np.ndarray) -> pa.Array:
    """The last sizes bytes of each."""
    ends = np.frombuffer(pieces.buffers()[1], np.int32)[pieces.offset + 1 : pieces.offset + len(pieces) + 1].astype(np.int64)
    data = _gather(np.frombuffer(pieces.buffers()[2], np.uint8), ends - sizes, sizes)
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    return pa.StringArray.from_buffers(len(pieces), pa.py_buffer(offsets), pa.py_buffer(data))


class Encoder:
    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        made = json.loads(self.tokenizer.to_str())
        before = made["pre_tokenizer"] or {}
        line = self.tokenizer.encode("\n", add_special_tokens=False).ids
        self.cuttable = made["normalizer"] is None and before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before["add_prefix_space"] and len(line) == 1
        self.line = line[0] if self.cuttable else -1
        names = {t: i for t, i in self.tokenizer.get_vocab(with_added_tokens=True).items()}
        self.top = max(names.values(), default=0)
        self.kind = np.dtype("<u2" if self.top < 1 << 16 else "<u4")
        self.spaced = np.zeros(self.top + 1, bool)
        self.spaced[[i for t, i in names.items() if t.startswith("Ġ")]] = True
        special = "".join("|" + re.escape(t["content"]) for t in made["added_tokens"])
        self.whole = rf"^[{_WHITE}]|\x00{special}"
        self.known: dict[str, bytes] = {}
        self.before: dict[str, bytes] = {}

    def _whole(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(x.ids, self.kind) for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _encode(self, keys: list[str]) -> list[bytes]:
        """Of pieces: NUL + a tail; what begins with a line end or space, as it stands; else what follows a space. Words
        without white space go as parts of longer texts: exactly their first ids begin with a space or are a line end's."""
        out: list[bytes] = [b""] * len(keys)
        spaced, lines, rest = [], [], []
        for i, k in enumerate(keys):
            head = k[:1]
            if head == "\n" and len(k) > 1 and not _SPACE.search(k, 1):
                lines.append(i)
            elif head == NUL or not head or _SPACE.search(k):
                rest.append(i)
            else:
                spaced.append(i)
        size = self.kind.itemsize
        for which, lead in ((spaced, " "), (lines, "")):
            for a in range(0, len(which), WORDS):
                some = which[a : a + WORDS]
                ids = self._whole([lead + lead.join(map(keys.__getitem__, some))])[0]
                data = ids.tobytes()
                cuts = [*(size * np.flatnonzero(self.spaced[ids] if lead else ids == self.line)).tolist(), len(data)]
                for i, x, y in zip(some, cuts[:-1], cuts[1:], strict=True):
                    out[i] = data[x:y]
        texts = [k[1:] if k[:1] == NUL else k if k[:1] in ("\n", " ") else " " + k for k in map(keys.__getitem__, rest)]
        for i, ids in zip(rest, self._whole(texts), strict=True):
            out[i] = ids.tobytes()
        return out

    def _of(self, keys: list[str]) -> list[bytes]:
        """Ids of different pieces, looked up or encoded."""
        if len(self.known) > CACHE_PIECES:
            self.known, self.before = {}, self.known
        found = list(map(self.known.get, keys))
        new = [i for i, x in enumerate(found) if x is None]
        if new and self.before:
            again = [*map(self.before.get, map(keys.__getitem__, new))]
            for i, x in zip(new, again, strict=True):
                if x is not None:
                    found[i] = self.known[keys[i]] = x
            new = [i for i, x in zip(new, again, strict=True) if x is None]
        for i, x in zip(new, self._encode([keys[i] for i in new]), strict=True):
            found[i] = x
            if len(keys[i]) <= CACHED_CHARS:
                self.known[keys[i]] = x
        return found

    def _cut(self, lists: pa.Array, flat: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pieces (flat, as _encode takes them), and where those of each list begin."""
        coded = flat.dictionary_encode()
        pieces, index = coded.dictionary, coded.indices.to_numpy()
        bare = pc.ascii_rtrim(pieces, characters=_PUNCTUATION)
        stems = pc.if_else(pc.match_substring_regex(bare, _LETTER), bare, pieces)
        tail_size = (pc.binary_length(pieces).to_numpy() - pc.binary_length(stems).to_numpy()).astype(np.int64)
        tailed = np.flatnonzero(tail_size)
        stems = stems.dictionary_encode()
        tails = _tails(pieces.take(pa.array(tailed)), tail_size[tailed]).dictionary_encode()
        n = len(stems.dictionary)
        found = self._of([*_strings(stems.dictionary), *(NUL + x for x in _strings(tails.dictionary))])
        found.append(b"")
        parts = np.full((len(pieces), 2), len(found) - 1)
        parts[:, 0] = stems.indices.to_numpy()
        parts[tailed, 1] = n + tails.indices.to_numpy()
        sizes = np.fromiter(map(len, found), np.int64, len(found)) // self.kind.itemsize
        made = _gather(np.frombuffer(b"".join(found), self.kind), (np.cumsum(sizes) - sizes)[parts.ravel()], sizes[parts.ravel()])
        sizes = sizes[parts].sum(axis=1)
        table = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(made))
        ids = table.take(pa.array(index)).flatten().to_numpy()
        ends = np.concatenate([[0], np.cumsum(sizes[index])])
        return ids, ends[lists.offsets.to_numpy() - lists.offsets[0].as_py()]

    def batch(self, texts: pa.Array, end_id: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(ids of some texts followed by end_id each, with a number for the first one before them; the rows of these texts
        and where each one's ids begin and end)."""
        n = len(texts)
        whole = pc.match_substring_regex(texts, self.whole).to_numpy(zero_copy_only=False) if self.cuttable else np.ones(n, bool)
        run = pc.match_substring_regex(texts, _RUN).to_numpy(zero_copy_only=False) & ~whole
        for which, lists_of in ((np.flatnonzero(~whole & ~run), self._plain), (np.flatnonzero(run), self._runs)):
            if len(which):
                ids, at = self._cut(*lists_of(texts.take(pa.array(which)) if len(which) < n else texts))
                # a line end was put before each text: its id gives its place to the end id of the text before it
                ids = np.append(ids, self.kind.type(end_id))
                ids[at[1:-1]] = end_id
                yield ids, np.stack([which, at[:-1] + 1, at[1:] + 1])
        for i in np.flatnonzero(whole).tolist():
            ids = np.append(self._whole([texts[i].as_py()])[0], self.kind.type(end_id))
            yield ids, np.array([[i], [0], [len(ids)]])

    @staticmethod
    def _plain(texts: pa.Array) -> tuple[pa.Array, pa.Array]:
        lists = pc.split_pattern(pc.binary_join_element_wise("\n", pc.replace_substring(texts, "\n", " \n"), ""), " ")
        return lists, lists.flatten()

    @staticmethod
    def _runs(texts: pa.Array) -> tuple[pa.Array, pa.Array]:
        """Of texts in which spaces or line ends follow other white space: cut where they don't."""
        marked = pc.replace_substring_regex(texts, rf"([^{_WHITE}])([ \n])", r"\1" + NUL + r"\2")
        lists = pc.split_pattern(pc.binary_join_element_wise("\n", marked, ""), NUL)
        flat = lists.flatten()
        return lists, pc.if_else(pc.match_substring_regex(flat, r"^ [^ \n]"), pc.utf8_slice_codeunits(flat, 1), flat)

    def encode(self, texts: pa.Array, end_id: int, kind: np.dtype) -> list[memoryview]:
        """The ids of each text and end_id after them, as little-endian integers of that kind."""
        out: list[memoryview] = [memoryview(b"")] * len(texts)
        for ids, (rows, starts, ends) in self.batch(texts, end_id):
            data = memoryview(np.ascontiguousarray(ids.astype(kind, copy=False))).cast("B")
            size = kind.itemsize
            for i, a, b in zip(rows.tolist(), (size * starts).tolist(), (size * ends).tolist(), strict=True):
                out[i] = data[a:b]
        return out


@cache
def encoder(path: str) -> Encoder:
    return Encoder(path)


def encoded(batches: Iterator[pa.RecordBatch], path: str, end_id: int, width: int = 4, size: int = BATCH_BYTES) -> Iterator[tuple[object, memoryview]]:
    """(first column, ids and end_id as little-endian unsigned integers of `width` bytes) of each row of (key, text) batches."""
    own, kind = encoder(path), np.dtype(f"<u{width}")
    if max(own.top, end_id) >> 8 * width:
        raise ValueError(f"ids up to {max(own.top, end_id)} don't fit into {width} bytes")
    if end_id >> 8 * own.kind.itemsize:
        raise ValueError("the end id must be of the size of the vocabulary's")
    try:
        for batch in batches:
            keys, texts = batch.column(0).to_pylist(), pc.fill_null(batch.column(1), "")
            ends = np.cumsum(pc.binary_length(texts).to_numpy().astype(np.int64))
            at = 0
            while at < len(keys):
                to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + size)))
                yield from zip(keys[at:to], own.encode(texts.slice(at, to - at), end_id, kind), strict=True)
                pa.default_memory_pool().release_unused()
                at = to
    finally:  # a worker goes on to other stages, which need its memory
        own.known, own.before = {}, {}
