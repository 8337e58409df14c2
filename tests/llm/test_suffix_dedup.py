import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from marginalia.llm import queries
from marginalia.llm.suffix_dedup import _Sorter, remove_repeats, repeated_windows


def brute(texts, size):
    seen = Counter()
    for t in texts:
        raw = (t or "").encode()
        seen.update(raw[p : p + size] for p in range(len(raw) - size + 1))
    out = []
    for t in texts:
        raw = (t or "").encode()
        gone = bytearray(len(raw))
        for p in range(len(raw) - size + 1):
            if seen[raw[p : p + size]] > 1:
                gone[p : p + size] = b"\1" * size
        runs = sum(1 for i, g in enumerate(gone) if g and (not i or not gone[i - 1]))
        kept = bytes(b for b, g in zip(raw, gone) if not g)
        out.append((len(raw), sum(gone), runs, hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize(("size", "alphabet", "group_rows"), [(16, "ab", 2000), (24, "abcdefé ", 2000), (16, "abcdefé", 2), (16, "ab", 1), (24, "abc", 3)])
def test_removals_match_brute_force(spark, size, alphabet, group_rows):
    rnd = random.Random(size)
    passages = ["".join(rnd.choice(alphabet) for _ in range(70)) for _ in range(6)]

    def text():
        return "".join(
            rnd.choice(passages)[rnd.randrange(30) : rnd.randrange(30, 70)] if rnd.random() < 0.5 else "".join(rnd.choice(alphabet) for _ in range(rnd.randrange(30)))
            for _ in range(rnd.randrange(8))
        )

    texts = [None, "", "a" * 100, "short"] + [text() for _ in range(50)]
    texts += texts[4:8]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = sorted(remove_repeats(docs, size, group_rows, digest=True).collect(), key=lambda r: r.doc_id)
    assert [(r.n_bytes, r.n_removed, r.n_spans, r.kept) for r in rows] == brute(texts, size)


def fast(texts, size):
    """The same by an index of all windows' hashes, for long texts; Python's own hash, bytes compared."""
    seen = {}
    raws = [(t or "").encode() for t in texts]
    for d, raw in enumerate(raws):
        for p in range(len(raw) - size + 1):
            seen.setdefault(hash(raw[p : p + size]), []).append((d, p))
    marks = [bytearray(len(r)) for r in raws]
    for places in seen.values():
        if len(places) > 1:
            found = Counter(raws[d][p : p + size] for d, p in places)
            for d, p in places:
                if found[raws[d][p : p + size]] > 1:
                    marks[d][p] = 1
    out = []
    for raw, mark in zip(raws, marks):
        gone, until = bytearray(len(raw)), 0
        for p, m in enumerate(mark):
            until = p + size if m else until
            gone[p] = p < until
        runs = sum(1 for i, g in enumerate(gone) if g and (not i or not gone[i - 1]))
        kept = bytes(b for b, g in zip(raw, gone) if not g)
        out.append((len(raw), sum(gone), runs, hashlib.sha256(kept).hexdigest()))
    return out


def check(spark, texts, size, group_rows=2000):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    rows = sorted(remove_repeats(docs, size, group_rows, digest=True).collect(), key=lambda r: r.doc_id)
    got = [(r.n_bytes, r.n_removed, r.n_spans, r.kept) for r in rows]
    assert got == fast(texts, size)
    return got


@pytest.mark.parametrize("group_rows", [2000, 3])
def test_passages_of_every_length_at_400_bytes(spark, group_rows):
    rnd = random.Random(group_rows)
    draw = lambda n: "".join(rnd.choice("abcdefghij  ") for _ in range(n))
    passages = {n: draw(n) for n in (300, 399, 400, 401, 500, 799, 1000)}
    texts = []
    for n, passage in passages.items():
        texts += [draw(rnd.randrange(200)) + passage + draw(rnd.randrange(200)) for _ in range(6)]
    texts += [draw(500) + passages[1000][100:700] + draw(30) + passages[500]]
    got = check(spark, texts, 400, group_rows)
    held = [n for n in passages for _ in range(6)]
    assert all(bool(g[1]) == (n >= 400) for g, n in zip(got, held) if n != 399)


def test_a_window_of_5000_bytes_and_a_text_over_a_mebibyte(spark):
    rnd = random.Random(7)
    draw = lambda n: "".join(rnd.choice("abcdefghijklmnop ") for _ in range(n))
    passage = draw(9000)
    got = check(spark, [draw(100) + passage + draw(50), passage + draw(10), draw(7000), passage[:5400]], 5000)
    assert [g[1] for g in got] == [9000, 9000, 0, 5400]
    # repeats on both sides of, and across, the bytes that one anchor search covers
    long = draw(1_060_000)
    edge = long[1_047_900:1_049_500]
    got = check(spark, [long, "x" + edge, draw(300) + long[10:700], long[-800:] + "y"], 400)
    assert got[0][1:3] == (1600 + 690 + 800, 3)
    with pytest.raises(ValueError):
        remove_repeats(spark.createDataFrame([(1, "a")], "doc_id long, text string"), 1 << 20)


def test_odd_rows_and_clashing_columns(spark):
    passage = "a passage that is there more than once, and long enough "
    rows = [(1, passage + "x", 9, "p"), (1, passage + "x", 9, "p"), (None, "é" + passage, 8, "q"), (None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, spans int, kind string")
    got = sorted(((r.doc_id, r.kind, r.n_removed, r.kept) for r in remove_repeats(docs, 20).collect()), key=str)
    assert got == sorted([(1, "p", len(passage) + 1, ""), (1, "p", len(passage) + 1, ""), (None, "q", len(passage), "é"), (None, None, 0, None)], key=str)
    assert remove_repeats(docs.limit(0), 20).count() == 0


def test_mergesort_orders_suffixes():
    rnd = random.Random(3)
    data = np.frombuffer(bytes(rnd.choice(b"ab") for _ in range(400)), np.uint8)
    start = np.array(sorted(rnd.sample(range(390), 60)))
    with np.errstate(over="ignore"):
        order = _Sorter(data, np.full(60, 400)).sort(start, np.zeros(60, int))
    suffixes = [data[s:].tobytes() for s in start]
    assert [suffixes[i] for i in order] == sorted(suffixes)


def test_windows_of_one_anchor():
    with np.errstate(over="ignore"):
        far, near = repeated_windows([b"xxABCDEFGHyy", b"zABCDEFGHq", b"nothing alike"], [4, 3, 3], [0, 0, 0], 6)
    assert far.tolist() == [2, 2, -1] and near.tolist() == [0, 0, -1]


def test_query_shows_what_is_left_of_each_text(spark, tmp_path):
    rnd = random.Random(5)
    word = lambda: "".join(rnd.choice("abcdefghijklm") for _ in range(rnd.randrange(7, 11)))
    own = [" ".join(word() for _ in range(80)) + str(i) for i in range(6)]
    passage = " ".join(word() for _ in range(60))
    texts = [t + (f" {passage}" if i < 3 else "") for i, t in enumerate(own)] + [None, ""]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    rows = {r.doc_id: r for r in queries.op4_suffix_dedup(spark, str(tmp_path)).collect()}
    assert [rows[i].text for i in range(8)] == [*own, None, ""]
    assert all(r.n_bytes == len(texts[i] or "") and hashlib.sha256((r.text or "").encode()).hexdigest() == r.kept_sha256 for i, r in rows.items())
