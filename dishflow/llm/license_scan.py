"""License scans by fuzzy short-notice search.

Each notice may be misspelt by a few edits. A stretch of text that lies within k edits of a notice holds at least one of
the notice's k + 1 pieces unchanged (pigeonhole), so exact search for the pieces finds every candidate; only the few
bytes around each candidate are then matched with the regex library's bounded-error patterns, which verify the edits and
report spans. Words are runs of ASCII letters, digits and non-ASCII characters, lower-cased (A-Z only); notices are sought
in the words joined by single spaces and match whole words only, so a phrase is found whatever stands between its words.

Short words that many others resemble (mit, gnu) are a notice's lead: they must stand unchanged before the part that may
be misspelt. The score is 1 - (fewest edits of a match) / (length of its notice), the largest of all notices, and 0
without a match; phrases that stand unchanged count as matches without edits.

Defined cases: null text counts as empty; texts without words have no places (null) and empty labels; notices may
overlap; rows that repeat a document are scanned alike; a null doc_id is carried along; an empty table gives an empty
result; further columns are ignored. Rows don't meet: there is no shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from dishflow.llm.common import documents, text_rows

#: Phrases of the base search and their labels.
PHRASES = (("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit"))
#: What isn't part of a word becomes a space; A-Z become a-z.
_TABLE = bytes(i + 32 if 65 <= i <= 90 else i if 48 <= i <= 57 or 97 <= i <= 122 or i >= 128 else 32 for i in range(256))
SCHEMA = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<label:string,from:long,to:long,edits:int,text:string>>"


@dataclass(frozen=True)
class Notice:
    """text within `errors` edits, right after `lead` (unchanged; may be empty)."""

    label: str
    lead: str
    text: str
    errors: int

    @cached_property
    def head(self) -> str:
        return f"{self.lead} " if self.lead else ""

    @cached_property
    def pieces(self) -> list[tuple[bytes, int]]:
        """errors + 1 pieces of the text, with their distance from the notice's beginning."""
        n, k = len(self.text), self.errors + 1
        cuts = [n * i // k for i in range(k + 1)]
        return [(self.text[a:b].encode(), len(self.head) + a) for a, b in zip(cuts, cuts[1:], strict=False)]

    def pattern(self, errors: int) -> regex.Pattern:
        fuzzy = f"(?:{regex.escape(self.text)}){{e<={errors}}}" if errors else regex.escape(self.text)
        return regex.compile(f"(?e){regex.escape(self.head)}{fuzzy}(?![^ ])")

    @cached_property
    def patterns(self) -> list[regex.Pattern]:
        return [self.pattern(e) for e in range(self.errors + 1)]

    def windows(self, words: bytes) -> list[tuple[int, int]]:
        """Disjoint stretches of words (joined by spaces) that hold all matches, cut where words end."""
        size, slack = len(self.head) + len(self.text), 4 * self.errors  # an inserted character has up to four bytes
        found = []
        for piece, offset in self.pieces:
            at = words.find(piece)
            while at >= 0:
                found.append((at - offset - slack, at - offset + size + slack + 1))
                at = words.find(piece, at + 1)
        out: list[tuple[int, int]] = []
        for a, b in sorted(found):
            if out and a <= out[-1][1]:
                out[-1] = (out[-1][0], max(b, out[-1][1]))
            else:
                out.append((a, b))
        whole = []
        for a, b in out:
            a = 0 if a <= 0 else words.find(b" ", a - 1) + 1 if b" " in words[a - 1 : b] else b
            b = len(words) if b >= len(words) else words.rfind(b" ", a, b)
            if b > a:
                whole.append((a, b))
        return whole

    def matches(self, words: bytes) -> Iterator[tuple[int, int, int, str]]:
        """from and to (words), edits and text of matches that don't overlap, those of fewest edits before others. Patterns
        are tried at each word of a candidate, as a search would not see an insertion where a match begins."""
        before = done = 0
        for a, b in self.windows(words):
            text = words[a:b].decode(errors="replace")
            before, done = before + words.count(b" ", done, a), a
            starts = [0, *(i + 1 for i, c in enumerate(text) if c == " ")]
            spans: list[tuple[int, int, int]] = []  # first and last word of the candidate's, edits
            taken = set()
            for e, pattern in enumerate(self.patterns):
                for no, start in enumerate(starts):
                    if no not in taken and (m := pattern.match(text, start)):
                        last = no + m[0].count(" ")
                        if taken.isdisjoint(range(no, last + 1)):
                            taken.update(range(no, last + 1))
                            spans.append((no, last, e))
            for no, last, e in spans:
                yield before + no, before + last + 1, e, text[starts[no] : starts[last + 1] - 1 if last + 1 < len(starts) else None]


#: About one edit in ten characters.
NOTICES = (Notice("gpl", "gnu", "general public license", 2), Notice("apache", "", "apache license", 1), Notice("mit", "mit", "license", 1), Notice("cc-by", "", "creative commons attribution", 3))


def normal_words(text: bytes) -> list[bytes]:
    return text.translate(_TABLE).split()


def places(words: bytes, phrase: bytes) -> list[int]:
    """Numbers of the words at which phrase begins, in words that single spaces join; they may overlap."""
    padded, sought, out, at, no, done = b" " + words + b" ", b" " + phrase + b" ", [], 0, 0, 0
    while (at := padded.find(sought, at)) >= 0:
        no, done = no + padded.count(b" ", done, at), at
        out.append(no)
        at += 1
    return out


def scan_text(text: bytes, phrases: tuple[tuple[str, str], ...] = PHRASES, notices: tuple[Notice, ...] = NOTICES) -> tuple:
    own = normal_words(text)
    words = b" ".join(own)
    base: list[int] = []
    labels, score = set(), 0.0
    for phrase, label in phrases:
        if found := places(words, phrase.encode()):
            base += found
            labels.add(label)
            score = 1.0
    more, spans = set(labels), []
    for notice in notices:
        for first, to, edits, said in notice.matches(words):
            more.add(notice.label)
            score = max(score, 1 - edits / (len(notice.head) + len(notice.text)))
            spans.append({"label": notice.label, "from": first, "to": to, "edits": edits, "text": said})
    spans.sort(key=lambda s: (s["from"], s["to"], s["label"]))
    return len(own), len(base), min(base, default=None), max(base, default=None), ",".join(sorted(labels)), ",".join(sorted(more)), score, spans


def scan_licenses(docs: DataFrame, phrases: tuple[tuple[str, str], ...] = PHRASES, notices: tuple[Notice, ...] = NOTICES) -> DataFrame:
    """doc_id, n_words, n_base (places where a phrase stands unchanged), first_word, last_word (their smallest and largest
    number, from 0), base_labels, labels (with those of misspelt notices), score, spans (matches of the notices: words
    from..to, edits, the words as they stand): one row for each row of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"]
        span = pa.struct([("label", pa.string()), ("from", pa.int64()), ("to", pa.int64()), ("edits", pa.int32()), ("text", pa.string())])
        kinds = [*[pa.int64()] * 5, pa.string(), pa.string(), pa.float64(), pa.list_(span)]
        for batch in batches:
            if batch.num_rows:
                found = zip(*(scan_text(x, phrases, notices) for x in text_rows(batch)), strict=True)
                cols = [batch.column(0), *(pa.array(c, t) for c, t in zip(found, kinds[1:], strict=True))]
                yield pa.RecordBatch.from_arrays(cols, names=names)

    return documents(docs).mapInArrow(run, SCHEMA)
