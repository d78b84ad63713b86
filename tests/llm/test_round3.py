"""Fill-in-middle, license scans, spelling variants."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from dishflow.llm import queries
from dishflow.llm.fill_in_middle import FillInMiddle, SkipList, fill_in_middle
from dishflow.llm.license_scan import NOTICES, PHRASES, Notice, scan_licenses, scan_text
from dishflow.llm.spelling import Acceptor, near_pairs, near_words, partitioned, roots, spelling_variants
from tests.llm.conftest import odd_rows

LINES = ["one\n", "\n", "δύο λέξεις\n", "a <P", "> b\n", "x" * 300 + "\n", "日本", "\r\n", "<M", "last"]


@pytest.mark.parametrize("name", ["op11_spelling", "op12_licenses", "op13_fill_in_middle"])
def test_query_equals_sql(spark, duck, sf, name):
    got, want = queries.QUERIES[name](spark, sf), duck.sql(queries.SQL[name])
    assert sorted(got.columns) == sorted(want.columns)
    rows = sorted(map(str, want.select(*(f'"{c}"' for c in got.columns)).fetchall()))
    assert sorted(str(tuple(r)) for r in got.collect()) == rows


# --- fill in the middle ----------------------------------------------------------------------------------------------
@pytest.mark.parametrize("n", [0, 1, 2, 4, 5, 17, 1000, 20_000])
def test_skip_list_reaches_every_rank(n):
    widths = np.array([random.Random(n * 31 + i).choice([0, 1, 7, 4000]) for i in range(n)], np.int64)
    line, before = SkipList(widths), np.concatenate([[0], np.cumsum(widths)])
    for rank in {0, n, *(random.Random(n).randrange(n + 1) for _ in range(1500))}:
        units, chars, steps = line.seek(rank)
        assert (units, chars) == (rank, before[rank]) and steps <= 12 * len(line.lanes)
    assert n < 1000 or len(line.lanes) >= 4
    for at, units, chars in line.lanes:  # each link's widths are those of what it passes
        ends = np.append(at[1:], n)
        assert (units == ends - at).all() and (chars == before[ends] - before[at]).all()
    with pytest.raises(IndexError):
        line.seek(n + 1)


def cut_plainly(doc_id, text):
    h = hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(h[8 * i : 8 * i + 8], 16) for i in range(4)]
    lines = re.findall(r"[^\n]*\n|[^\n]+", text)
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")):
        return len(lines), "plain", None, None, text
    a, b = sorted(x % (len(lines) + 1) for x in h[:2])
    p, m, s = ("".join(x) for x in (lines[:a], lines[a:b], lines[b:]))
    if h[3] % 100 < 50:
        return len(lines), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return len(lines), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def test_fill_in_middle(spark, odd, empty):
    rng = random.Random(5)
    rows = [(i, "".join(rng.choice(LINES) for _ in range(rng.randint(0, 40)))) for i in range(150)]
    rows += [(5, "\n" * 30_000 + "end"), (None, "a\nb\nc"), (None, None), (6, "<S>"), (7, "a<P>\n")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3).withColumns({c: F.lit(1) for c in ("n", "form", "output", "restored")})
    key = lambda r: tuple(map(str, r))
    got = sorted(((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in fill_in_middle(df).collect()), key=key)
    assert got == sorted(((i, *cut_plainly(i, t or "")) for i, t in rows), key=key)
    assert {f for _, _, f, *_ in got} == {"plain", "spm", "psm"}
    whole = fill_in_middle(odd).collect()
    assert sorted(r.restored for r in whole) == sorted(r[1] or "" for r in odd_rows())
    assert fill_in_middle(empty).count() == 0


def test_fill_in_middle_options():
    how = FillInMiddle(seed=1, rate=0)
    assert how.cut(1, "a\nb\n")[1] == "plain"
    words = FillInMiddle(rate=100, spm=0, prefix="[pre]", suffix="[suf]", middle="[mid]", units=r"\S*\s+|\S+")
    for i in range(60):
        text = " ".join(f"w{j}" for j in range(i % 13 + 1))
        n, form, p, m, out = words.cut(i, text)
        assert (n, form) == (i % 13 + 1, "psm") and words.restore(out, form) == text and out == f"[pre]{text[:p]}[suf]{text[p + m:]}[mid]{text[p:p + m]}"
    for marks in (("<P>", "<P>", "<M>"), ("<P>", ">S", "<M>"), ("aba", "x", "y"), ("", "x", "y"), ("abc", "b", "y")):
        with pytest.raises(ValueError, match="overlap"):
            FillInMiddle(prefix=marks[0], suffix=marks[1], middle=marks[2])


# --- licenses --------------------------------------------------------------------------------------------------------
def distance(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = _next(row, i, x, b)
    return row[-1]


def _next(old: list[int], i: int, x: str, b: str) -> list[int]:
    new = [i]
    for j, y in enumerate(b, 1):
        new.append(min(old[j] + 1, new[-1] + 1, old[j - 1] + (x != y)))
    return new


def scan_plainly(text: str):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    base, labels, more, score = [], set(), set(), 0.0
    for phrase, label in PHRASES:
        own = phrase.split()
        at = [i for i in range(len(words)) if words[i : i + len(own)] == own]
        base += at
        labels |= {label} if at else set()
    score = 1.0 if base else 0.0
    for n in NOTICES:
        size = len(n.head) + len(n.text)
        for i in range(len(words)):
            for j in range(i + 1, min(len(words), i + 8) + 1):
                said = " ".join(words[i:j])
                if said.startswith(n.head) and abs(len(said) - size) <= n.errors and (e := distance(said[len(n.head) :], n.text)) <= n.errors:
                    more.add(n.label)
                    score = max(score, 1 - e / size)
    return len(words), len(base), min(base, default=None), max(base, default=None), ",".join(sorted(labels)), ",".join(sorted(labels | more)), score


def misspelt(rng: random.Random, text: str, edits: int) -> str:
    for _ in range(edits):
        i = rng.randrange(len(text) + 1)
        text = rng.choice([text[:i] + rng.choice("aé x-") + text[i:], text[: max(0, i - 1)] + text[i:], text[: max(0, i - 1)] + rng.choice("zö 日") + text[i:]])
    return text


def licence_texts() -> list[str]:
    rng = random.Random(11)
    said = [n.head + n.text for n in NOTICES] + ["cc by", "CC-BY 4.0", "the", "x9", "licenselicense", "permit license", "a mit of license"]
    texts = ["", "\x00", "cc by cc by cc-BY", "mit license" * 3, "mit license " * 400, "é" * 5000 + " apache license", "Apache, License", "xmit license", "creative-commons\nattribution", "license " * 3000 + "apachelicense"]
    for _ in range(250):
        parts = [misspelt(rng, rng.choice(said), rng.randint(0, 4)) for _ in range(rng.randint(1, 6))]
        texts.append(rng.choice([" ", ", ", "-"]).join(parts))
    return texts


def test_scan_equals_brute_force(spark):
    texts = licence_texts()
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(None, None)], "doc_id long, text string").withColumns({c: F.lit("z") for c in ("labels", "score", "spans", "n_words")})
    got = {r.doc_id: r for r in scan_licenses(df.repartition(3)).collect()}
    for i, text in enumerate(texts):
        want = scan_plainly(text) if len(text) < 4000 else None
        r = got[i]
        assert want is None or (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels, r.score) == want, text
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.translate({i: i + 32 for i in range(65, 91)}))
        for s in r.spans:
            assert " ".join(words[s["from"] : s["to"]]) == s["text"]
            notice = next(n for n in NOTICES if n.label == s["label"])
            assert distance(s["text"], notice.head + notice.text) <= s["edits"] <= notice.errors
    assert sum(r.labels != r.base_labels for r in got.values()) > 30
    assert (got[None].n_words, got[None].labels, got[None].first_word) == (0, "", None)
    assert got[texts.index("mit license " * 400)].n_base == 400 and len(got[texts.index("mit license " * 400)].spans) == 400
    assert got[texts.index("license " * 3000 + "apachelicense")].labels == "apache"


def test_pieces_hold_what_edits_leave():
    n = Notice("x", "one", "two three four", 2)
    assert b"".join(p for p, _ in n.pieces) == n.text.encode() and len(n.pieces) == 3
    assert scan_text(b"ONE to threee four", (), (n,))[5:7] == ("x", 1 - 2 / 18)


def test_scan_odd_rows(odd, empty):
    rows = scan_licenses(odd).collect()
    assert len(rows) == len(odd_rows()) and all(r.labels == "" and r.score == 0 for r in rows)
    assert scan_licenses(empty).count() == 0


# --- spelling --------------------------------------------------------------------------------------------------------
def near(a: str, b: str) -> bool:
    a, b = sorted((a, b), key=len)
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def words_of(rng: random.Random, alphabet: str, length: int, n: int) -> list[str]:
    return sorted({"".join(rng.choice(alphabet) for _ in range(length)) for _ in range(n)})


def test_composition_accepts_near_pairs_once():
    rng = random.Random(2)
    for _ in range(150):
        length = rng.randint(1, 5)
        short, long = (words_of(rng, "abc"[: rng.randint(1, 3)], length + k, rng.randint(1 - k, 25)) for k in (0, 1))
        common = lambda a, b: next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
        for places in (length + 1, max(1, length // 2)):
            want = {frozenset(p) for x in short for p in [(x, y) for y in short + long] if near(*p) and common(*p) < places}
            if not short:
                continue
            got = [frozenset(p) for p in near_pairs(short, long, places)]
            assert len(got) == len(set(got)) and set(got) == want


def test_acceptor_is_minimal():
    words = sorted(a + b + c for a in "abc" for b in "xy" for c in "pq")
    assert len(Acceptor(words, 3).arcs) == 4


@pytest.mark.parametrize("most", [2, 20, 20_000])
def test_near_words(spark, most):
    rng = random.Random(4)
    words = {w for length in (1, 2, 5, 6, 7) for w in words_of(rng, "abé", length, 30)} | {"a" * 300, "a" * 301, "a" * 150 + "b" + "a" * 149, "longest" * 40, "c"}
    count = {w: rng.choice([1, 1, 5, 50]) for w in words}
    df = spark.createDataFrame(list(count.items()), "word string, n long")
    got = {r.word: (r.n_near, r.most, r.form) for r in near_words(df, most).collect()}
    want = {}
    for w in words:
        others = [o for o in words if near(w, o)]
        if others:
            best = min(others, key=lambda o: (-count[o], o))
            want[w] = (len(others), count[best], best)
    assert got == want
    parts = partitioned(df, most).where("high - low > 1").groupBy("size", "low", "high", "beginning", "end").count()
    assert all(r["count"] <= most for r in parts.collect())


def test_hot_beginning_is_split(spark):
    """A third of the vocabulary begins alike and ends alike: no partition holds more than it may."""
    rng = random.Random(9)
    words = {"international" + "".join(rng.choice("abcdef") for _ in range(6)) + "ization" for _ in range(600)} | set(words_of(rng, "abcdefgh", 8, 1200))
    df = spark.createDataFrame([(w, 2) for w in words], "word string, n long")
    sizes = [r["count"] for r in partitioned(df, 50).where("high - low > 1").groupBy("size", "low", "high", "beginning", "end").count().collect()]
    assert max(sizes) <= 50
    deleted = defaultdict(set)
    for w in words:
        for i in range(len(w)):
            deleted[w[:i] + w[i + 1 :]].add(w)
    pairs = {frozenset((a, b)) for k, v in deleted.items() for a in v | ({k} & words) for b in v if near(a, b)}
    assert sum(r.n_near for r in near_words(df, 50).collect()) == 2 * len(pairs)


def variants_plainly(rows):
    n = Counter()
    for doc_id, text in rows:
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for w in re.findall("[a-zÀ-ÿ]+", low):
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{w}".encode())
            n[w[: h % len(w)] + w[h % len(w) + 1 :] if h % 31 == 0 else w] += 1
    n = {w: k for w, k in n.items() if len(w) >= 7 and k >= 2}
    form, out = {}, {}
    for w in n:
        others = [o for o in n if abs(len(o) - len(w)) <= 1 and near(w, o)]
        best = min(others, key=lambda o: (-n[o], o), default=None)
        form[w] = best if best is not None and n[best] >= 10 * n[w] else None
        out[w] = len(others)
    root = {}
    for w in n:
        at = w
        while form[at] is not None:
            at = form[at]
        root[w] = at
    return {w: (form[w], root[w], n[w], out[w], n[form[w]] if form[w] else None) for w in n}


def test_spelling_variants(spark, empty):
    rng = random.Random(6)
    chain = ["colouring", "coluring", "coluing"]
    texts = [(i, " ".join(rng.choice(["Colouring", "colouring,", "naïvement", "NAÏVEMENT", "ÀÉtrange", "x" * 9, "日本語", "separately"]) for _ in range(rng.randint(0, 80)))) for i in range(80)]
    texts += [(i % 7, w) for i, w in enumerate(["coluring"] * 60 + ["coluing"] * 3 + ["seperately"] * 2 + ["naivement"] * 2 + ["a" * 3000 + "b"] * 2 + ["a" * 3001] * 40)]
    texts += [(None, "colouring colouring"), (None, None), (3, None), (3, "")]
    texts += [(1000 + i, "colouring " * 10) for i in range(90)]
    df = spark.createDataFrame(texts, "doc_id long, text string").repartition(4).withColumns({c: F.lit("z") for c in ("word", "n", "form", "root", "size")})
    got = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in spelling_variants(df).collect()}
    assert got == variants_plainly(texts)
    assert got[chain[2]][1] == chain[0] and got[chain[2]][0] == chain[1] and got["a" * 3000 + "b"][1] == "a" * 3001
    assert spelling_variants(empty).count() == 0


def test_roots_follow_long_chains(spark):
    df = spark.createDataFrame([(f"w{i}", f"w{i + 1}") for i in range(20)] + [("u", "w20")], "word string, form string")
    assert {r.root for r in roots(df).collect()} == {"w20"}
    assert roots(df.limit(0)).count() == 0


def test_spelling_odd_rows(odd):
    rows = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in spelling_variants(odd, most=3).collect()}
    assert rows == variants_plainly([r[:2] for r in odd_rows()])
