import itertools
import random
import re

import numpy as np
import pytest

from marginalia.llm import graph
from marginalia.llm.ngram_join import Trie, link_classes, near_duplicates_removed, ngram_classes


def shingles(text, size):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if len(words) < size:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + size]) for i in range(len(words) - size + 1)}


def classes(docs, size, num, den):
    sets = {k: shingles(t, size) for k, t in docs}
    parent = {k: k for k, _ in docs}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(sets, 2):
        both = len(sets[a] & sets[b])
        if sets[a] and sets[b] and den * both >= num * (len(sets[a]) + len(sets[b]) - both):
            x, y = root(a), root(b)
            parent[max(x, y)] = min(x, y)
    return {k: (len(sets[k]), root(k)) for k in sets}


def corpus(seed):
    rnd = random.Random(seed)
    word = lambda: rnd.choice("abcdefgh") + rnd.choice("abcdefgh")
    texts = [None, "", "  \n ", "One", "one", "a B", "A b"]
    for size in (1, 2, 3, 5, 9, 12, 30, 60, 200):
        for _ in range(3):
            base = [word() for _ in range(size)]
            texts.append(" ".join(base))
            for edits in (0, 1, 1, 2, 3, 6):
                copy = list(base)
                for _ in range(edits):
                    copy[rnd.randrange(len(copy))] = word() + word()
                texts.append(("\t" if edits else " ").join(copy))
    return list(enumerate(texts))


@pytest.mark.parametrize(("size", "num", "most"), [(3, 90, 500000), (5, 80, 500000), (3, 90, 300), (5, 80, 100), (2, 60, 500000), (2, 60, 150)])
def test_classes_match_brute_force(spark, size, num, most):
    docs = corpus(size * num)
    rows = ngram_classes(spark.createDataFrame(docs, "doc_id long, text string"), size, num, 100, most).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in rows} == classes(docs, size, num, 100)


def test_odd_rows(spark):
    rows = [(1, "a b c d", "x"), (1, "a b c d", "x"), (None, "a b c d", "y"), (None, None, None), (5, "z", "q")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, node string")
    got = sorted(((r.doc_id, r.component_id) for r in ngram_classes(docs, 3, 90).collect()), key=str)
    assert got == sorted([(1, 1), (1, 1), (None, 1), (None, None), (5, 5)], key=str)
    assert ngram_classes(docs.limit(0)).count() == 0


def test_one_of_each_class_stays(spark):
    long = " ".join(f"w{i}" for i in range(100))
    rows = [(3, long, "a"), (1, long + " end", "b"), (2, "other text", "c"), (4, None, "d"), (6, long, "e")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, root string")
    kept = near_duplicates_removed(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [1, 2, 4]


def test_one_row_stays_of_repeats_and_null_ids(spark):
    long = [" ".join(f"{c}{i}" for i in range(100)) for c in "pqrs"]
    rows = [
        (1, long[0], "a"), (1, long[0], "a"), (1, long[0], "b"),  # repeats, one with another column
        (2, long[1], "a"), (2, long[1] + " end", "a"),  # near copies under one doc_id
        (None, long[2], "a"), (None, long[2], "a"), (None, long[2] + " end", "a"),  # without ids
        (None, long[3], "a"), (4, long[3] + " end", "a"),
        (1, "other text", "a"), (1, long[1] + " more", "a"),
        (7, None, "a"), (7, None, "a"), (None, "", "a"), (None, "", "a"),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, root string")
    kept = near_duplicates_removed(docs)
    assert kept.columns == docs.columns
    got = [tuple(r) for r in kept.collect()]
    assert sorted(str(r) for r in got if not r[1]) == sorted(str(r) for r in rows if not r[1])
    got = [r for r in got if r[1]]
    assert {r for r in got if r[0] is not None} == {(1, long[0], "a"), (1, "other text", "a"), (1, long[1] + " more", "a"), (4, long[3] + " end", "a")}
    rest = [r for r in got if r[0] is None]
    assert len(got) == 5 and len(rest) == 1 and rest[0][1].startswith(long[2])


def test_trie_finds_all_similar_sets():
    rnd = random.Random(4)
    base = [rnd.randrange(10**6) for _ in range(60)]
    sets = []
    for _ in range(40):
        s = set(base) - set(rnd.sample(base, rnd.randrange(8))) | {rnd.randrange(10**6) for _ in range(rnd.randrange(8))}
        sets.append(np.array(sorted(s), np.uint64))
    trie = Trie(sets)
    for x in range(len(sets)):
        want = {i for i, s in enumerate(sets) if 10 * len(set(s) & set(sets[x])) >= 8 * len(set(s) | set(sets[x]))}
        assert set(trie.similar(x, 8, 10)[0].tolist()) == want


def test_components(spark, monkeypatch):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, 101), (101, 100), (7, 7), (None, 3), (200, 150), (150, 120)]
    want = {**{i: 1 for i in range(1, 41)}, 100: 100, 101: 100, 200: 120, 150: 120, 120: 120}
    rows = spark.createDataFrame(edges, "a long, b long").repartition(5)
    for most in (400_000, 10):
        monkeypatch.setattr(graph, "TASK_EDGES", most)
        assert {r.node: r.root for r in graph.components(rows).collect()} == want
    assert graph.components(rows.limit(0)).count() == 0


@pytest.mark.parametrize("seed", range(12))
def test_classes_of_one_group(seed):
    rnd = random.Random(seed)
    base = list(range(100))
    sets = []
    for _ in range(60):
        if sets and rnd.random() < 0.5:
            base = [int(v) for v in rnd.choice(sets)]
        cut = rnd.sample(base, min(len(base), rnd.randrange(0, 14)))
        sets.append(np.array(sorted(set(base) - set(cut) | {rnd.randrange(10**6) for _ in range(rnd.randrange(0, 12))}), np.uint64))
    for num in (8, 9, 5, 4):
        label = list(range(60))
        for a, b in itertools.combinations(range(60), 2):
            x, y = set(sets[a].tolist()), set(sets[b].tolist())
            if 10 * len(x & y) >= num * len(x | y) and label[a] != label[b]:
                low, high = sorted((label[a], label[b]))
                label = [low if v == high else v for v in label]
        assert link_classes(sets, num, 10) == label
