import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from marginalia.llm import quality, queries, spelling

WORDS = "walk house river bread stone tree light garden window morning the and of to in".split()


def texts(n, seed):
    """(text, good): prose, and text of three poor kinds."""
    rnd = random.Random(seed)
    out = []
    for i in range(n):
        words = [rnd.choice(WORDS) + rnd.choice(["", "s", "ing", "er"]) for _ in range(rnd.randint(20, 120))]
        kind = rnd.randint(0, 5)
        text = " ".join(w + ("." if rnd.random() < 0.1 else "") for w in words)
        if kind == 0:
            text = text.upper()
        elif kind == 1:
            text = " ### ".join(words)
        elif kind == 2:
            text = " ".join(w for w in words[:8] for _ in range(9))
        out.append((text, int(kind > 2)))
    return out


def test_quality_query(spark, tmp_path):
    rows = [(i, t, y) for i, (t, y) in enumerate(texts(600, 1))]
    more = [(None, None), (9999, ""), (9998, None), (9997, "word " * 200_000), (0, rows[0][1])]
    spark.createDataFrame([(i, t) for i, t, _ in rows] + more, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, y) for i, _, y in rows] + [(3, None), (None, 1)], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    got = queries.op11_quality(spark, str(tmp_path)).collect()
    assert len(got) == 605 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    by = {r.doc_id: r for r in got}
    assert all(by[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, _, _ in rows)
    assert np.mean([by[i].predicted == y for i, _, y in rows if by[i].held_out]) > 0.97
    # labels of held-out rows change nothing
    turned = [(i, 1 - y if by[i].held_out else y) for i, _, y in rows]
    spark.createDataFrame([(i, t) for i, t, _ in rows] + more, "doc_id long, text string").write.parquet(f"{tmp_path}/b/documents.parquet")
    spark.createDataFrame(turned, "doc_id long, quality int").write.parquet(f"{tmp_path}/b/labels.parquet")
    again = {r.doc_id: r.score for r in queries.op11_quality(spark, f"{tmp_path}/b").collect()}
    assert all(abs(again[i] - by[i].score) < 1e-6 for i in by)


def test_fit_minimises_the_loss_over_the_pairs(spark):
    """Heights against plain gradient descent on the same pairs."""
    rows = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(texts(120, 2))], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, (_, y) in enumerate(texts(120, 2))], "doc_id long, quality int")
    known = quality.labelled(quality.measured(rows), labels)
    ridge = 0.05
    model = quality.fit(known, ridge=ridge)
    counts = Counter(r.label for r in known.collect())
    met = [(r.better, r.worse) for r in quality.pairs(known, counts[1], counts[0]).collect()]
    assert len(met) >= max(counts.values()) * 0.5
    d = quality._spread(np.array([a for a, _ in met]), model.knots) - quality._spread(np.array([b for _, b in met]), model.knots)
    w = np.zeros(d.shape[1])
    for _ in range(4000):
        w -= 0.2 * (-(1 / (1 + np.exp(d @ w))) @ d / len(d) + 2 * ridge * w)
    assert np.allclose(np.concatenate(model.heights), w, atol=2e-3)
    # the cut parts the worths at the share of poor text
    worth = model.worth(np.array([r.measures for r in known.collect()]))
    assert abs((worth < model.cut).mean() - counts[0] / 120) <= 0.02


def test_measures_against_plain_code():
    cases = ["", None, "One two. One TWO!\nOne two. One TWO!\n\n| | 42", "a", "...", "Ünd die ß 1a", " \n "]
    got = quality.measures(pa.array(cases, pa.string()))
    for text, row in zip(cases, got):
        raw = (text or "").encode()
        words = re.findall(rb"[0-9A-Za-z\x80-\xff]+", raw.lower())
        tokens = re.findall(rb"[^\x20\x09-\x0d]+", raw)
        lines = [x for x in raw.lower().split(b"\n") if x]
        share = lambda part, whole: part / max(whole, 1)
        letters = len(re.findall(rb"[A-Za-z\x80-\xff]", raw))
        want = [
            np.log1p(len(tokens)), share(len(re.findall(rb"[A-Z]", raw)), letters), share(letters, len(raw)), share(len(re.findall(rb"[0-9]", raw)), len(raw)),
            share(len(re.findall(rb"[^\x00-\x20.,0-9A-Za-z\x80-\xff]", raw)), len(raw)), share(len(re.findall(rb"[.,]", raw)), len(raw)),
            share(sum(not re.search(rb"[0-9A-Za-z\x80-\xff]", t) for t in tokens), len(tokens)), share(sum(len(w) <= 3 for w in words), len(words)),
            share(sum(map(len, words)), len(words)), np.log1p(share(len(raw), len(lines))), share(len(set(words)), len(words)),
            share(len(set(zip(words, words[1:]))), len(words) - 1), share(len(set(zip(words, words[1:], words[2:]))), len(words) - 2),
            share(sum(a == b for a, b in zip(words, words[1:])), len(words) - 1), 1 - share(len(set(lines)), len(lines)),
        ]
        assert np.allclose(row, want if raw else 0), text


@pytest.mark.parametrize("labels, score", [([], 0.5), ([1, 1], 1.0), ([0], 0.0)])
def test_quality_without_both_labels(spark, labels, score):
    docs = spark.createDataFrame([(i, "text", "x") for i in range(3)], "doc_id long, text string, `a.b` string")
    known = spark.createDataFrame(list(enumerate(labels)), "doc_id long, quality int")
    got = quality.score_documents(docs, known).collect()
    assert [(r.score, r.predicted, r["a.b"]) for r in got] == [(score, int(score >= 0.3), "x")] * 3
    assert quality.score_documents(docs.limit(0), known).collect() == []


# spelling


def variants(words, ratio=10):
    """{word: (form, root, n, n_near, form_n)} by comparing all words."""
    near = {w: [x for x in words if spelling.one_edit(w, x)] for w in words}
    form = {}
    for w, n in words.items():
        best = min(near[w], key=lambda x: (-words[x], x), default=None)
        if best is not None and words[best] >= ratio * n:
            form[w] = best
    out = {}
    for w, n in words.items():
        root = w
        while root in form:
            root = form[root]
        out[w] = (form.get(w), root, n, len(near[w]), words[form[w]] if w in form else None)
    return out


def test_one_edit_against_all_edits():
    rnd = random.Random(4)
    for _ in range(3000):
        a, b = ("".join(rnd.choice("abé") for _ in range(rnd.randint(0, 5))) for _ in range(2))
        edits = {a[:i] + a[i + 1 :] for i in range(len(a))} | {a[:i] + c + a[i + k :] for i in range(len(a) + 1) for c in "abé" for k in (0, 1)}
        assert spelling.one_edit(a, b) == (b in edits and a != b)


@pytest.mark.parametrize("seed", [1, 8])
def test_variants_against_brute_force(spark, seed):
    rnd = random.Random(seed)
    words = {}
    for _ in range(60):
        word = "".join(rnd.choice("aabeté") for _ in range(rnd.randint(7, 12)))
        for _ in range(rnd.randint(1, 12)):
            words[word] = 10 ** rnd.randint(0, 4) + rnd.randint(0, 3)
            at = rnd.randrange(len(word))
            word = max(word[:at] + rnd.choice("abetéx") + word[at + rnd.randint(0, 1) :], word, key=len) if rnd.random() < 0.7 or len(word) < 8 else word[:at] + word[at + 1 :]
    words["a" * 400], words["a" * 401] = 2, 50
    table = spark.createDataFrame(list(words.items()), "word string, n long")
    got = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in spelling.variant_groups(table).collect()}
    assert got == variants(words)
    assert sum(v[3] for v in got.values()) > 100 and sum(v[1] != v[0] and v[0] is not None for v in got.values()) > 0


def test_spelling_query_against_brute_force(spark, tmp_path):
    rnd = random.Random(9)
    vocabulary = ["".join(rnd.choice("abcdeéßÀ×") for _ in range(rnd.randint(5, 10))) for _ in range(40)]
    docs = [(i, " ".join(rnd.choice([w, w.upper(), w.title()]) for w in rnd.choices(vocabulary, weights=[2**-k for k in range(40)], k=400)) + " x-1Längewörter", "z") for i in range(60)]
    docs += [(None, "Längewörter längewörter Œlängewörter", "z"), (7, None, "z"), (8, "", "z"), (9, "abcdefgh " * 30_000, "z"), docs[0]]
    spark.createDataFrame(docs, "doc_id long, text string, word string").write.parquet(f"{tmp_path}/documents.parquet")
    counts = Counter()
    for i, text, _ in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            word = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if i is None else i}:{word}".encode())
            if h % 31 == 0:
                word = word[: h % len(word)] + word[h % len(word) + 1 :]
            counts[word] += 1
    want = variants({w: n for w, n in counts.items() if len(w) >= 7 and n >= 2})
    got = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in queries.op13_spelling(spark, str(tmp_path)).collect()}
    assert got == want and any(v[0] for v in want.values())


def test_spelling_edges(spark):
    empty = spark.createDataFrame([], "word string, n long")
    assert spelling.variant_groups(empty).collect() == []
    assert spelling.vocabulary(spark.createDataFrame([], "doc_id long, text string"), 31).collect() == []
    with pytest.raises(ValueError):
        spelling.variant_groups(spark.createDataFrame([("short", 2)], "word string, n long"))
    with pytest.raises(ValueError):
        spelling.variant_groups(empty, ratio=1)
    twice = spark.createDataFrame([("wordwords", 5), ("wordwords", 6)], "word string, n long")
    assert [tuple(r) for r in spelling.variant_groups(twice).collect()] == [("wordwords", None, "wordwords", 11, 0, None)]
