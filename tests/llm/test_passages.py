import random
from itertools import pairwise

import pytest

from marginalia.llm import passages, queries
from marginalia.llm.suffix_dedup import _keyed, remove_repeats


def brute(rows, size):
    """Words of each text in runs of ``size`` words that another (doc_id, text) has too."""
    cut = [(t or "").replace("\n", " ").split(" ") for _, t in rows]
    cut = [[w for w in ws if w] for ws in cut]
    owners = {}
    for row, ws in zip(rows, cut):
        for p in range(len(ws) - size + 1):
            owners.setdefault(tuple(ws[p : p + size]), set()).add(row)
    out = []
    for ws in cut:
        on = set()
        for p in range(len(ws) - size + 1):
            if len(owners[tuple(ws[p : p + size])]) > 1:
                on.update(range(p, p + size))
        out.append(len(on))
    return out


@pytest.mark.parametrize(("size", "words"), [(1, 40), (2, 12), (7, 3), (12, 500), (51, 500)])
def test_shared_words_match_brute_force(spark, size, words):
    rnd = random.Random(size)
    draw = lambda n: [f"w{rnd.randrange(words)}" for _ in range(n)]
    bank = [draw(3 * size) for _ in range(5)]

    def text():
        parts = []
        for _ in range(rnd.randrange(5)):
            p = rnd.choice(bank)
            a = rnd.randrange(2 * size)
            parts += draw(rnd.randrange(20)) + p[a : a + rnd.randrange(1, 2 * size)]
        return rnd.choice([" ", "\n", "  "]).join(parts)

    own = " ".join(draw(2 * size))
    texts = [None, "", "a", f"{own} x {own} {own}é"] + [text() for _ in range(60)]
    texts += texts[4:8]
    rows = list(enumerate(texts)) + [(None, texts[9]), (None, texts[10] + " z"), (5, texts[5]), (5, "b " + texts[5])]
    alone = " ".join(f"v{i}" for i in range(3 * size))
    rows += [(0, alone), (None, alone)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    found = remove_repeats(docs.selectExpr("doc_id", "text", "text as raw"), 400, shared=size).collect()
    want = dict(zip(rows, brute(rows, size)))
    assert len(found) == len(rows) and {(r.doc_id, r.raw): r.n_shared_words for r in found} == want
    assert size > 40 or sum(want.values()) > 100
    counted = passages.shared_words(_keyed(docs), size)
    assert {r.doc_id: r.n_shared_words for r in counted.where("doc_id > 5").collect()} == {i: n for (i, _), n in want.items() if i and i > 5 and n}


def test_query_finds_shared_passages_under_400_bytes(spark, tmp_path):
    rnd = random.Random(8)
    draw = lambda n: [("".join(rnd.choice("abcdefghijklm") for _ in range(rnd.randrange(3, 7)))) for _ in range(n)]
    planted, short, twice = draw(51), draw(50), draw(60)
    texts = [" ".join(draw(70) + (planted if i < 3 else short if i < 5 else []) + draw(30)) for i in range(8)]
    texts += [" ".join(twice + draw(5) + twice), None, "", "\n".join(planted)]
    assert len(" ".join(planted)) < 400
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    found = queries.op4_suffix_dedup(spark, str(tmp_path))
    assert found.columns[:5] == ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    rows = {r.doc_id: r for r in found.collect()}
    assert [rows[i].n_shared_words for i in range(12)] == [51, 51, 51, 0, 0, 0, 0, 0, 0, 0, 0, 51]
    assert all(not rows[i].n_removed for i in range(12))


def test_a_text_over_one_anchor_search(spark, monkeypatch):
    from marginalia.llm import textvec

    rnd = random.Random(9)
    monkeypatch.setattr(textvec, "POS_BITS", 7)
    draw = lambda n: [f"w{rnd.randrange(10**6)}" for _ in range(n)]
    one, two = draw(1000), draw(300)
    texts = [" ".join(one), " ".join(two + one[90:170] + two[:50]), " ".join(one[100:104] + draw(9) + one[500:900])]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array([0, 1, 2]), pa.array([0, 1, 2]), pa.array(texts)], names=["doc_id", "text_hash", "body"])
    seen = [(r, s, s + m) for row, start, more, *_ in passages._word_anchors(batch, 51) for r, s, m in zip(row.tolist(), start.tolist(), more.tolist())]
    assert all(b[1] == a[2] + 1 for a, b in pairwise(seen) if a[0] == b[0])
    assert {r: max(e for q, _, e in seen if q == r) for r in range(3)} == {i: len(t.split(" ")) - 51 for i, t in enumerate(texts)}
    assert sorted((r.doc_id, r.n_shared_words) for r in passages.shared_words(_keyed(docs)).collect()) == [(0, 480), (1, 80), (2, 400)]
