import hashlib
import random
import zlib
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest
import regex
import xxhash
from pyspark.sql import functions as F

from marginalia.llm import imatch, mixing, queries, token_order, toxicity, url_filter


def test_url_trie_against_a_scan():
    rnd = random.Random(2)
    hosts = ["com", "a.com", "b.a.com", "org", "x.org", "aa.com"]
    paths = ["/", "/en/", "/en/7", "/en/70/", "", "/d", "/en"]
    rules = [(rnd.choice(["allow", "block"]), h, p) for h in hosts for p in paths if rnd.random() < 0.5]
    trie = url_filter.HostPathTrie(rules)
    for _ in range(2000):
        host = rnd.choice(hosts + ["c.b.a.com", "zcom", "", "y.x.org"])
        path = rnd.choice(paths + ["/en/71", "/en/7/8", "/de", "/en/70/1"])
        fits = [(h.count("."), len(p), h + p, v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
        want = max(fits)[2:] if fits else None
        assert trie.match(host, path) == want, (host, path)


def test_url_query(spark):
    urls = [None, "", "nourl", "HTTP://A.Example.COM/en/7x?q#f", "http://example.com/en/1", "x://net/de/", "x://net/de", "ftp://Ä.org/es/é", "a://b://c/en/", "http://org?/es/", "http://com#/en/"]
    rows = [(i, u, "z") for i, u in enumerate(urls)] + [(3, urls[3], "z")]
    pages = spark.createDataFrame(rows, "page_id long, url string, host string")
    got = url_filter.filter_urls(pages, queries.URL_RULES).drop("url").collect()
    con = duckdb.connect()
    con.register("t", pa.table({"page_id": [r[0] for r in rows], "url": pa.array([r[1] for r in rows], pa.string())}))
    con.execute("CREATE TABLE pages AS SELECT * FROM t")
    want = con.execute(queries.oracle_sql()["op6_url_trie"]).fetchall()
    assert sorted(map(str, ((r.page_id, r.host, r.path, r.rule, r.verdict) for r in got))) == sorted(map(str, want))
    with pytest.raises(ValueError):
        url_filter.HostPathTrie([("maybe", "a", "/")])


def test_url_rules_are_the_contracts():
    trie = url_filter.HostPathTrie(queries.URL_RULES)
    want = {
        ("a.com", "/en/1"): ("com/en/", "block"), ("example.com", "/en/71"): ("example.com/en/7", "allow"), ("x.net", "/de/1"): ("net/de/", "allow"),
        ("www.example.net", "/de/8"): ("example.net/de/8", "block"), ("org", "/es/"): ("org/es/", "block"),
    }
    assert {at: trie.match(*at) for at in want} == want


def sentences(n, seed):
    rnd = random.Random(seed)
    bad, groups = ["awful", "wretch", "vermin"], ["women", "men", "muslim", "christian"]
    plain = ["walk", "house", "river", "bread", "stone", "tree", "light"]
    out = []
    for _ in range(n):
        toxic = rnd.random() < 0.4
        # group mentions go with the label in training, which must not be learned
        words = [rnd.choice(plain) for _ in range(12)] + ([rnd.choice(bad)] if toxic else []) + (["women"] if toxic and rnd.random() < 0.6 else [rnd.choice(groups)] if rnd.random() < 0.1 else [])
        rnd.shuffle(words)
        out.append((" ".join(words), int(toxic)))
    return out


def test_toxicity_learns_words_not_groups():
    train, held = sentences(600, 1), sentences(300, 2)
    model = toxicity.fit([t for t, _ in train], [y for _, y in train])
    with np.errstate(over="ignore"):
        scores = model.score(pa.array([t for t, _ in held]))
        assert (((scores >= 0.7) == np.array([y == 1 for _, y in held])).mean()) > 0.97
        a, b = model.score(pa.array(["women walk by the river", "men walk by the river"]))
        loose = toxicity.fit([t for t, _ in train], [y for _, y in train], counterfactual=0.0)
        c, d = loose.score(pa.array(["women walk by the river", "men walk by the river"]))
    assert abs(a - b) < 0.05 and abs(a - b) <= abs(c - d)
    assert a < 0.7


def test_toxicity_query(spark, tmp_path):
    rows = [(i, t, y) for i, (t, y) in enumerate(sentences(400, 3))]
    spark.createDataFrame([(i, t) for i, t, _ in rows] + [(None, None), (9999, "")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = {r.doc_id: r for r in queries.op7_toxicity(spark, str(tmp_path)).collect()}
    assert len(got) == 402 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got.values())
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 3 == 1) for i, _, _ in rows)
    assert np.mean([got[i].predicted == y for i, _, y in rows if got[i].held_out]) > 0.95
    # labels of held-out rows change nothing
    spark.createDataFrame([(i, 1 - y if zlib.crc32(str(i).encode()) % 3 == 1 else y) for i, _, y in rows], "doc_id long, toxic int").write.mode("overwrite").parquet(f"{tmp_path}/labels.parquet")
    again = {r.doc_id: r.score for r in queries.op7_toxicity(spark, str(tmp_path)).collect()}
    assert again == {k: r.score for k, r in got.items()}
    none = toxicity.fit([], [])
    with np.errstate(over="ignore"):
        assert none.score(pa.array([""]))[0] < 1e-6


def test_the_sample_is_bounded(spark):
    docs = spark.range(3000).select(F.lit(1).cast("long").alias("doc_id"), F.concat(F.lit("text "), F.col("id").cast("string")).alias("text"))
    docs = docs.unionByName(spark.createDataFrame([(i, f"other {i}") for i in range(2, 40)] + [(None, "x"), (50, None)], "doc_id long, text string"))
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)] + [(1, 0), (2, None), (None, 1)], "doc_id long, toxic int").withColumn("label", F.lit(7))
    texts, marks = toxicity.labelled_sample(docs, labels, sample={1: 5, 0: 5})
    assert len(texts) <= 10 and marks.count(1) <= 5 and len(set(texts)) == len(texts)
    texts, marks = toxicity.labelled_sample(docs, labels, sample={1: 100, 0: 100})
    assert texts.count("text 0") == 1 and len(texts) == 39 and marks[texts.index("text 0")] == 1
    texts, _ = toxicity.labelled_sample(docs, labels, sample={1: 100, 0: 100}, most_bytes=30)
    assert 0 < sum(map(len, texts)) <= 60
    assert toxicity.labelled_sample(docs.limit(0), labels) == ([], [])


def test_permutation():
    for n in (1, 2, 5, 16, 17, 1000, 4097):
        slots = token_order.permute(np.arange(n), n, 7)
        assert sorted(slots) == list(range(n))
        assert (token_order.permute(slots, n, 7, back=True) == np.arange(n)).all()
    assert (token_order.permute(np.arange(1000), 1000, 7) != token_order.permute(np.arange(1000), 1000, 8)).any()
    with pytest.raises(ValueError):
        token_order.permute(np.array([5]), 5, 1)


def _plain_slots(rows, key, length):
    """Every slot's bytes, by plain loops over the rows in order."""
    ordered = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, _signed(_hash(r[1]) if r[1] is not None else 42)))
    parts = []
    for _, text in ordered:
        raw = (text or "").encode()
        parts += [raw[i : i + length] for i in range(0, len(raw), length)] or [b""]
    slots = token_order.permute(np.arange(len(parts)), len(parts), key)
    return {int(s): p for s, p in zip(slots, parts)}


def test_shards(spark, tmp_path):
    texts = [None, "", "abc", "é" * 70, "x" * 64, "same", "same", "same" * 50, "same" * 50]
    rows = [(i if i < 5 else 5, t) for i, t in enumerate(texts)] + [(None, "null id"), (None, None)]
    docs = spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, slot int")
    want = _plain_slots(rows, 3, 64)
    found, n = token_order.assign_slots(docs, 3, 64, 4)
    got = found.collect()
    assert n == len(got) == len(want) and {r.slot: bytes(r.record)[2 : 2 + r.n_tokens] for r in got} == want
    assert all(r.shard == r.slot // 4 and r.offset == r.slot % 4 * 66 and len(r.record) == 66 for r in got)
    path = f"file://{tmp_path}/shards"
    token_order.write_shards(found, path, n, 64, 4)
    token_order.write_shards(found, path, n, 64, 4)
    read = list(token_order.read_slots(path, 0, n, 64, 4))
    assert read == [want[i] for i in range(n)]
    assert list(token_order.read_slots(path, 3, 4, 64, 4)) == read[3:7]
    assert list(token_order.read_slots(path, n - 2, 100, 64, 4)) == read[-2:] and list(token_order.read_slots(path, 4 * n, 5, 64, 4)) == []
    back = token_order.shard_rows(spark, path, n, 64, 4).collect()
    assert {r.slot: (r.shard, r.offset, r.n_tokens, r.ids_sha256) for r in back} == {i: (i // 4, i % 4 * 66, len(x), hashlib.sha256(x).hexdigest()) for i, x in want.items()}
    empty, none = token_order.assign_slots(docs.limit(0))
    assert none == 0 and empty.count() == 0 and token_order.shard_rows(spark, path, 0).count() == 0
    with pytest.raises(ValueError):
        token_order.assign_slots(docs, length=1 << 16)


def test_order_query_matches_plain_code(spark, tmp_path):
    rnd = random.Random(4)
    rows = [(i, "".join(rnd.choice("abcé ") for _ in range(rnd.choice([0, 5, 700, 3000])))) for i in range(40)] + [(7, "again"), (7, "again")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    want = _plain_slots(rows, 20240101, token_order.LENGTH)
    got = {r.slot: (r.n_tokens, r.ids_sha256) for r in queries.op8_token_order(spark, str(tmp_path)).collect()}
    assert got == {i: (len(x), hashlib.sha256(x).hexdigest()) for i, x in want.items()}


def test_fingerprints(spark):
    rnd = random.Random(5)
    words = [f"w{i}" for i in range(400)]
    texts = [" ".join(rnd.choice(words) for _ in range(200)) for _ in range(30)] + [None, "", "é!", "one", "one"]
    texts[10] = texts[3]
    rows = [(i * 3, t) for i, t in enumerate(texts)] + [(None, "without id")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("block", F.lit(1))
    got = imatch.fingerprints(docs, (0.001, 0.5)).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    order = [r[1] or "" for r in rows]
    for i, (key, _) in enumerate(rows):
        own, new = order[i], order[(i + 1) % len(order)]
        q = len(own) // 4
        assert by[key].n_chars == len(own)
        assert by[key].edited_sha256 == hashlib.sha256((own[: len(own) - q] + new[:q]).encode()).hexdigest()
    assert by[30].fingerprint == by[9].fingerprint and by[99].fingerprint == by[102].fingerprint
    assert by[99].near_next == 1.0 and by[90].near_edited == 1.0
    long = [r for r in got if r.n_chars > 500]
    assert np.mean([r.near_edited for r in long]) > 0.2 > np.mean([r.near_next for r in long])
    assert imatch.fingerprints(docs.limit(0)).count() == 0


def test_different_short_texts_have_different_fingerprints(spark):
    texts = [f"short{i} text{i}" for i in range(60)] + [f"one{i}" for i in range(20)] + ["", None, "?!"]
    # longer, and without a term in the lexicon: all are in one document only
    texts += [" ".join(f"rare{i}x{k}" for k in range(40)) for i in range(5)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in imatch.fingerprints(docs).collect()}
    empty = imatch.NONE * (1 + sum(n for n, _ in imatch.SUBSETS))
    assert {i for i, r in got.items() if r.fingerprint == empty} == {80, 81, 82}
    assert len({r.fingerprint for r in got.values()}) == len(texts) - 2
    assert got[0].near_next == 0.0 and got[83].near_next == 0.0 and got[81].near_next == 1.0


def _signed(x):
    return x - (1 << 64) if x >> 63 else x


def _hash(value, seed=42):
    """Spark's xxhash64 of a string, a long or (as a tuple) an int, as an unsigned number."""
    raw = value.encode() if isinstance(value, str) else value[0].to_bytes(4, "little") if isinstance(value, tuple) else (value % (1 << 64)).to_bytes(8, "little")
    return xxhash.xxh64_intdigest(raw, seed)


def _print(text, lexicon):
    """The fingerprint by plain loops."""
    terms = {_signed(_hash(w)) for w in regex.split(r"[^\p{L}\p{N}]+", text.lower()) if w}
    held = sorted((terms & lexicon) or terms)
    out, first = [], 1
    members = [held]
    for many, one_in in imatch.SUBSETS:
        for j in range(first, first + many):
            members.append([t for t in held if _signed(_hash((j,), _hash(t))) % one_in == 0])
        first += many
    for m in members:
        h = None
        for t in m:
            h = _hash(t, 42 if h is None else _hash(h))
        out.append(imatch.NONE if h is None else f"{h:016x}")
    return out


def _alike(a, b):
    used = [(x, y) for x, y in zip(a, b) if x != imatch.NONE or y != imatch.NONE]
    return sum(x == y for x, y in used) / len(used) if used else 1.0


def test_fingerprints_match_plain_loops(spark):
    rnd = random.Random(11)
    words = [f"w{i}" for i in range(300)] + ["été", "Straße", "语言"]
    texts = [" ".join(rnd.choice(words) for _ in range(rnd.choice([1, 5, 40, 300]))) for _ in range(40)] + ["", "only here", "w1" * 9, None]
    texts.append(" ".join(rnd.choice(words) for _ in range(200_000)))  # over a mebibyte
    assert len(texts[-1]) > 1 << 19
    texts += texts[:3]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").withColumn("term", F.lit("x"))
    df = Counter(_signed(_hash(w)) for t in texts for w in {x for x in regex.split(r"[^\p{L}\p{N}]+", (t or "").lower()) if x})
    band = (0.05, 0.4)
    lexicon = {w for w, n in df.items() if max(2, band[0] * len(texts)) <= n <= max(2, band[1] * len(texts))}
    plain = [t or "" for t in texts]
    edited = [t[: len(t) - len(t) // 4] + plain[(i + 1) % len(plain)][: len(t) // 4] for i, t in enumerate(plain)]
    own, new = [_print(t, lexicon) for t in plain], [_print(t, lexicon) for t in edited]
    got = {r.doc_id: r for r in imatch.fingerprints(docs, band).collect()}
    assert len(got) == len(texts)
    for i in range(len(texts)):
        assert got[i].fingerprint == "".join(own[i]) and got[i].edited_fingerprint == "".join(new[i]), i
        assert got[i].near_edited == pytest.approx(_alike(own[i], new[i]))
        assert got[i].near_next == pytest.approx(_alike(own[i], own[(i + 1) % len(own)]))


def test_rates_meet_targets(spark):
    rng = np.random.default_rng(1)
    p = rng.dirichlet([0.4] * 3, 200)
    tokens = rng.integers(1, 500, 200).astype(float)
    target = np.array([3.0, 1.0, 0.5]) * tokens.sum() / 4.5
    rows = spark.createDataFrame([(i, float(t), [float(x) for x in q]) for i, (t, q) in enumerate(zip(tokens, p))], "doc_id long, tokens double, p array<double>")
    rated, residual = mixing.fit_rates(rows, target.tolist())
    rate = np.array([r.rate for r in sorted(rated.collect(), key=lambda r: r.doc_id)])
    assert max(map(abs, residual)) < 1e-6 and (rate >= 0).all()
    assert np.allclose((rate * tokens) @ p, target, rtol=1e-4)
    # a domain that no document belongs to leaves its residual
    zero = rows.withColumn("p", F.expr("array(1D, 0D)"))
    _, rest = mixing.fit_rates(zero, [tokens.sum(), 100.0], rounds=5)
    assert rest[1] < 0


def _nonnegative_least_squares(a, b):
    """Active sets, by plain linear algebra."""
    n = a.shape[1]
    x, passive = np.zeros(n), np.zeros(n, bool)
    for _ in range(10 * n):
        w = a.T @ (b - a @ x)
        w[passive] = -np.inf
        if w.max() <= 1e-9 * np.abs(a).max() * np.abs(b).max():
            break
        passive[int(w.argmax())] = True
        while True:
            z = np.zeros(n)
            z[passive] = np.linalg.lstsq(a[:, passive], b, rcond=None)[0]
            if z[passive].min() > 0:
                break
            bad = passive & (z <= 0)
            move = np.min(x[bad] / np.maximum(x[bad] - z[bad], 1e-300))
            x = x + move * (z - x)
            passive &= x > 1e-12
            x[~passive] = 0
        x = z
    return x


@pytest.mark.parametrize(("seed", "most"), [(0, None), (1, None), (3, None), (4, 3.0)])
def test_unreachable_targets_get_the_least_squares_optimum(spark, seed, most):
    rng = np.random.default_rng(seed)
    # no document belongs mostly to the last domain, so its target cannot be met without the others' being passed
    p = rng.dirichlet([2.0, 1.0, 0.6], 300)
    p[:, 2] = np.minimum(p[:, 2], 0.3)
    p /= p.sum(axis=1, keepdims=True)
    tokens = rng.integers(1, 500, 300).astype(float)
    target = np.array([0.1, 0.1, 0.8]) * tokens.sum()
    rows = spark.createDataFrame([(float(t), [float(x) for x in q]) for t, q in zip(tokens, p)], "tokens double, p array<double>").coalesce(1)
    best = (p * tokens[:, None]).T
    if most is None:
        rate = _nonnegative_least_squares(best, target)
    else:  # small steps, one document at a time
        rate = np.ones(300)
        for i in list(range(300)) * 400:
            rate[i] = np.clip(rate[i] - best[:, i] @ (best @ rate - target) / (best[:, i] @ best[:, i]), 0, most)
    want = np.linalg.norm(best @ rate - target)
    assert want > 0.02 * target.sum()
    rated, residual = mixing.fit_rates(rows, target.tolist(), most=most)
    held = rated.collect()
    got = sum(np.array(r.p) * r.tokens * r.rate for r in held) - target
    assert np.allclose(got / target.sum(), residual, atol=1e-6) and all(0 <= r.rate <= (most or np.inf) for r in held)
    assert np.linalg.norm(got) <= 1.01 * want


def test_mixing(spark):
    rnd = random.Random(6)
    vocab = {"a": ["alpha", "apple", "arrow"], "b": ["bread", "bell", "bone"]}
    rows = [(i, " ".join(rnd.choice(vocab["a" if i % 4 else "b"]) for _ in range(20))) for i in range(200)]
    docs = spark.createDataFrame(rows + [(900, None), (901, ""), (None, "alpha bread")], "doc_id long, text string").withColumn("rate", F.lit(5))
    labelled = spark.createDataFrame([(i, "a" if i % 4 else "b") for i in range(0, 200, 2)] + [(None, "a"), (3, None)], "doc_id long, domain string")
    got = mixing.mix_rates(docs, labelled, {"a": 1, "b": 1}, budget=4000.0)
    held = got.collect()
    assert len(held) == 203 and {r.doc_id: r.rate for r in held}[900] == 1.0
    for k in range(2):
        assert abs(sum(r.rate * r.tokens * r.p[k] for r in held) - 2000) < 1
    assert all((r.p[0] > 0.5) == bool(r.doc_id % 4) for r in held if r.doc_id is not None and r.doc_id < 200)
    back = mixing.mixed(docs, got)
    assert back.columns == docs.columns and back.count() == sum(r.copies for r in held)
    clash = docs.withColumn("copies", F.lit(1)).withColumn("d", F.lit(2)).withColumn("row", F.lit(3))
    assert mixing.mixed(clash, got).columns == clash.columns
    assert all(max(map(abs, r.residuals)) < 1e-3 for r in held)
    assert {r.rate for r in mixing.mix_rates(docs, labelled.limit(0)).collect()} == {1.0}
    assert mixing.mix_rates(docs.limit(0), labelled).count() == 0


def test_mixing_query_matches_plain_code(spark, tmp_path):
    """op1 against naive Bayes by plain loops, and its rates against the targets' least squares."""
    rnd = random.Random(12)
    vocab = {"en": ["the", "house", "river", "stone"], "de": ["das", "haus", "fluss", "stein"], "fr": ["la", "maison", "eau", "pierre"]}
    rows = []
    for i in range(90):
        lang = ["en", "de", "fr"][i % 3]
        words = [rnd.choice(vocab[lang] if rnd.random() < 0.8 else vocab["en"] + ["new", "word"]) for _ in range(rnd.randrange(1, 40))]
        rows.append((i, "  ".join(words).title(), lang))
    rows += [(200, None, "en"), (201, " ", None), (202, "unheard words only", None)]
    quality = {i: i % 2 for i in range(0, 90, 1) if i % 5}
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, q) for i, q in quality.items()], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    got = {r.doc_id: r for r in queries.op1_mixing(spark, str(tmp_path)).collect()}
    assert set(got) == {r[0] for r in rows}
    split = lambda t: [w for w in regex.split(r"[ \t\n\x0B\f\r]+", (t or "").lower()) if w]
    named = {i: f"{lang}-{'good' if quality[i] else 'poor'}" for i, _, lang in rows if i in quality}
    domains = sorted(set(named.values()))
    size = {d: sum(x == d for x in named.values()) for d in domains}
    held = {d: Counter(w for i, t, _ in rows if named.get(i) == d for w in set(split(t))) for d in domains}
    seen = sum(held.values(), Counter())
    total = len(named)
    logs = {w: [np.log((held[d][w] + 0.5) / (size[d] + 1)) - np.log((seen[w] + 0.5) / (total + 1)) for d in domains] for w in seen if seen[w] >= 5}
    p, tokens = [], []
    for i, t, _ in rows:
        known = [logs[w] for w in split(t) if w in logs]
        z = np.array([np.log(size[d] / total) for d in domains]) + (np.sum(known, axis=0) * min(len(known), 30) / len(known) if known else 0)
        p.append(np.exp(z - z.max()) / np.exp(z - z.max()).sum())
        tokens.append(len(split(t)))
        assert got[i].tokens == tokens[-1] and list(got[i].domains) == domains and np.allclose(got[i].p, p[-1], atol=1e-9), i
    a = (np.array(p) * np.array(tokens, float)[:, None]).T
    target = np.full(len(domains), sum(tokens) / len(domains))
    rate = np.array([got[r[0]].rate for r in rows])
    best = np.linalg.norm(a @ _nonnegative_least_squares(a, target) - target)
    assert (rate >= 0).all() and np.linalg.norm(a @ rate - target) <= 1.01 * best + 1e-3 * target.sum()
    assert all(abs(got[i].copies - got[i].rate) <= 1 for i in got)


def test_empty_tables(spark):
    none = spark.createDataFrame([], "page_id long, url string")
    assert url_filter.filter_urls(none, queries.URL_RULES).count() == 0
    docs = spark.createDataFrame([], "doc_id long, text string, score int")
    assert toxicity.score_documents(docs, toxicity.fit([], [])).columns == ["doc_id", "text", "score", "predicted"]
    assert toxicity.score_documents(docs, toxicity.fit([], [])).count() == 0
