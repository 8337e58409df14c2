"""The pipeline's stages on a small planted corpus, each held against what it was given."""

import random

import corpus_pipeline as cp


def planted():
    rnd = random.Random(8)
    word = lambda: "".join(rnd.choice("abcdefghijklm") for _ in range(rnd.randrange(3, 8)))
    rows, toxic = [], {}
    for i in range(160):
        bad = i % 5 == 0
        words = [word() for _ in range(60)]
        if bad:
            a, b = rnd.sample(range(60), 2)
            words[a], words[b] = "grimble", "snorfle"
        rows.append([i, " ".join(words), ["en", "de"][i % 2], "s", 0])
        toxic[i] = int(bad)
    passage = " ".join(word() for _ in range(70))
    for i in (1, 2, 3):
        rows[i][1] += " " + passage
    copies = {200: 6, 201: 6, 202: 7}
    for i, j in copies.items():
        rows.append([i, rows[j][1] + (" end" if i % 2 else ""), rows[j][2], "s", 0])
    rows += [[300, None, None, None, None], [301, "", "en", "s", 0]]
    return rows, toxic, passage, copies


def test_stages(spark, tmp_path):
    rows, toxic, passage, copies = planted()
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int(i % 3 > 0), t) for i, t in toxic.items() if i % 4 < 3], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs, kept = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for n, (name, stage) in enumerate(cp.STAGES):
        out = stage(spark, docs, str(tmp_path))
        if n < 4:
            assert out.columns == docs.columns
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        kept[name] = {r.doc_id: r for r in docs.collect()}
    clean = {r[0] for r in rows if not toxic.get(r[0])}
    assert set(kept["toxicity"]) == clean
    assert set(kept["ngram_join"]) == clean - set(copies)
    assert set(kept["suffix_dedup"]) == clean - set(copies)
    for i in (1, 2, 3):
        assert passage not in kept["suffix_dedup"][i].text and len(kept["suffix_dedup"][i].text) > 200
    assert kept["suffix_dedup"][9].text == rows[9][1] and kept["suffix_dedup"][300].text is None
    assert set(kept["mixing"]) == clean - set(copies)
    assert kept["byte_bpe"][300].n_tokens == 0 and len(kept["byte_bpe"][9].ids) == kept["byte_bpe"][9].n_tokens > 60


def test_repeated_and_null_id_rows_keep_their_text(spark, tmp_path):
    rnd = random.Random(9)
    text = [" ".join("".join(rnd.choice("abcdefghijklm") for _ in range(5)) for _ in range(80)) for _ in range(4)]
    rows = [(1, text[0]), (1, text[0]), (2, text[1]), (2, text[1] + " end"), (None, text[2]), (None, text[2]), (3, text[3])]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    for name, stage in cp.STAGES[1:3]:
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
    left = [(r.doc_id, r.text.removesuffix(" end")) for r in docs.collect()]
    assert sorted(left, key=str) == sorted([(1, text[0]), (2, text[1]), (None, text[2]), (3, text[3])], key=str)


def test_run_on_odd_tables(spark, tmp_path):
    """An empty table, and one with columns that clash with the stages' own, nulls and repeats."""
    kind = "doc_id long, text string, lang string, source string, n_chars long, copies long, score double, root string, spans int, row int, d int, h long"
    rnd = random.Random(3)
    text = lambda: " ".join("".join(rnd.choice("abcdefghijklm") for _ in range(5)) for _ in range(60))
    rest = (1, 0.5, "r", 2, 3, 4, 5)
    rows = [(i, text(), "en" if i % 2 else "de", "s", 0, *rest) for i in range(20)]
    rows += [rows[3], rows[3], (None, None, None, None, None, *[None] * 7), (None, "", None, "s", 0, *rest), (99, None, "en", "s", 0, *rest)]
    spark.createDataFrame([(i, i % 2, 0) for i in range(20)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for part in (rows, []):
        spark.createDataFrame(part, kind).write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
        docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
        for name, stage in cp.STAGES[:4]:
            docs = stage(spark, docs, str(tmp_path))
            assert docs.columns == [c.split()[0] for c in kind.split(", ")], name
            docs.write.mode("overwrite").parquet(f"{tmp_path}/{name}")
            docs = spark.read.parquet(f"{tmp_path}/{name}")
        out = cp.run(spark, str(tmp_path)).collect()
        ids = [r.doc_id for r in out]
        assert set(ids) == {r[0] for r in part} and all((r.n_tokens == 0) == (r.doc_id in (None, 99)) for r in out)
        assert len(ids) >= len(set(part)) and (not part or ids.count(3) <= 4)
