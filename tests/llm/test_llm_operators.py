"""The training-data operators against brute force, libraries and edge cases."""

import re

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F

from pluvion.llm import (
    ann,
    embedding_dedup,
    html_text,
    language_id,
    mixing,
    sentencepiece_lattice,
    sharding,
    simhash,
    token_counts,
    toxicity,
)

DOCS = "doc_id long, text string, lang string, source string, extra string"
TEXTS = [None, "", " ", "a", "a b c", "the quick brown fox jumps over the lazy dog", "x" * 3000, "wörld ünïcode ßtraße", "a b c"]


def frame(spark, texts=TEXTS, **more):
    rows = [(i, t, "en", f"s{i % 2}", "e") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS).coalesce(2)


# sharding


def jump(key, n):
    key %= 1 << 64
    b, j = -1, 0
    while j < n:
        b = j
        key = (key * 2862933555777941757 + 1) % (1 << 64)
        j = int((b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return b


def test_sharding_matches_the_published_walk(spark):
    keys = [0, 1, 7, -5, 2**62, 10**12, None, 7]
    df = spark.createDataFrame([(k, "x", 3) for k in keys], "doc_id long, text string, shard int")
    out = sharding.shard_documents(df, 24).toPandas()
    assert len(out) == len(keys)
    for k, s, g in zip(out.doc_id, out.shard, out.grown_shard):
        k = 0 if k != k or k is None else int(k)
        assert (s, g) == (jump(k, 24), jump(k, 25)) and g in (s, 24)
    for _, part in out.groupby("shard"):
        assert sorted(part.slot) == list(range(len(part)))


def test_sharding_of_nothing(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert sharding.shard_documents(df, 24).count() == 0


# SimHash


def brute_fingerprint(text, words):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not w:
        return 0
    shingles = [" ".join(w[i : i + words]) for i in range(len(w) - words + 1)] if len(w) >= words else [" ".join(w)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(values, distance):
    out = list(range(len(values)))
    for i in range(len(values)):
        for j in range(i):
            if (values[i] ^ values[j]).bit_count() <= distance:
                a, b = out[i], out[j]
                out = [min(a, b) if x in (a, b) else x for x in out]
    return out


def test_fingerprints(spark):
    got = {r.doc_id: r.fp % (1 << 64) for r in simhash.fingerprints(frame(spark)).collect()}
    assert got == {i: brute_fingerprint(t, 4) for i, t in enumerate(TEXTS)}


def test_near_links_are_complete_also_in_a_dense_group(spark, monkeypatch):
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 62, 6)
    values = {int(b) for b in base}
    while len(values) < 400:  # a dense group around one value, and chains around others
        v = int(base[0] if rng.random() < 0.6 else rng.choice(list(values)))
        for b in rng.integers(0, 64, rng.integers(1, 5)):
            v ^= 1 << int(b)
        values.add(v)
    values = sorted(values)
    monkeypatch.setattr(simhash, "BLOCK", 32)
    df = spark.createDataFrame([(int(np.uint64(v).view(np.int64)), i) for i, v in enumerate(values)], "fp long, low long")
    from pluvion.operators.components import connected_components

    comps = {r.node: r.component for r in connected_components(simhash.near_links(df)).collect()}
    got = [comps.get(r, r) for r in (int(np.uint64(v).view(np.int64)) for v in values)]
    want = brute_components(values, 4)
    assert len(set(zip(got, want))) == len(set(got)) == len(set(want))


def test_thresholds_cover_the_distance():
    n, together = 1000, np.full((64, 64), 250.0) + 250 * np.eye(64)
    for n in (10, 100_000, 10**9):
        plan = simhash.plan_parts(n, together * n / 1000, 4)
        assert sum(e + 1 for _, e in plan) == 5
        bits = [b for g, _ in plan for b in g]
        assert len(bits) == len(set(bits))


def test_simhash_edges(spark):
    out = {r.doc_id: r for r in simhash.simhash_components(frame(spark)).collect()}
    assert len(out) == len(TEXTS)
    assert out[0].component_id == out[1].component_id == out[2].component_id == 0  # no words: fingerprint zero
    assert out[4].component_id == out[8].component_id == 4
    kept = simhash.drop_near_duplicates(frame(spark)).toPandas()
    assert sorted(kept.doc_id) == [0, 3, 4, 5, 6, 7] and list(kept.columns) == ["doc_id", "text", "lang", "source", "extra"]
    assert simhash.simhash_components(frame(spark).where("doc_id < 0")).count() == 0


# embeddings


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")


def test_embedding_links_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "BLOCK", 24)
    rng = np.random.default_rng(5)
    centers = rng.normal(size=(12, 16))
    x = np.concatenate([centers, centers[rng.integers(0, 12, 120)] + 0.12 * rng.normal(size=(120, 16)), np.repeat(centers[:1], 9, 0)]).astype(np.float32)
    label = rng.integers(0, 2, len(x))
    label[-9:] = 0
    rows = [(i, v.tolist(), int(k)) for i, (v, k) in enumerate(zip(x, label))]
    n = len(rows)
    odd = [(n, None, 0), (n + 1, [0.0] * 16, 0), (n + 2, [float("nan")] * 16, 0), (n + 3, x[0].tolist(), None), (n + 4, [1.0, None] * 8, 1), (n + 5, [1.0, 2.0], 0), (n + 6, [1.0, 2.0], 0)]
    got = embedding_dedup.embedding_links(vectors(spark, rows + odd), "vec_id", "embedding", "label").toPandas().set_index("vec_id").sort_index()
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    near = (u @ u.T >= 0.93) & (label[:, None] == label[None, :])
    np.fill_diagonal(near, False)
    assert (got.n_links[:n] <= near.sum(1)).all() and got.n_links[:n].sum() >= 0.98 * near.sum()
    assert got.n_links[n : n + 4].sum() == 0 and (got.component_id[n : n + 4] == got.index[n : n + 4]).all()
    assert got.n_links[n + 5] == got.n_links[n + 6] == 1 and got.component_id[n + 6] == n + 5 and not got.kept[n + 6]
    assert (got.component_id <= got.index).all()


def test_embedding_links_of_repeated_ids(spark):
    rng = np.random.default_rng(9)
    rows = [(1, [1.0, 0.0], 0), (1, [0.99, 0.1], 0), (2, [1.0, 0.0], 0), (1, [0.0, 1.0], 1), (3, [1.0, 0.01], 0), (None, [0.0, 1.0], 1), (None, [-1.0, 0.0], 1)]
    rows += [(int(rng.integers(4, 12)), [float(x) for x in rng.normal(size=2)], int(rng.integers(0, 3))) for _ in range(60)]
    rows += [rows[-1]] * 3
    got = embedding_dedup.embedding_links(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label long").repartition(3), "vec_id", "embedding", "label")
    x = np.array([r[1] for r in rows])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    same = (x @ x.T >= 0.93) & (np.array([r[2] for r in rows])[:, None] == np.array([r[2] for r in rows])[None])
    reach = same.copy()
    for _ in range(8):
        reach = reach @ reach
    want = []
    for i, (vec_id, *_) in enumerate(rows):
        ids = [rows[j][0] for j in np.flatnonzero(reach[i]) if rows[j][0] is not None]
        least = min(ids, default=None)
        want.append((vec_id, int(same[i].sum()) - 1, least, vec_id is not None and vec_id == least))
    assert sorted(map(str, (tuple(r) for r in got.select("vec_id", "n_links", "component_id", "kept").collect()))) == sorted(map(str, want))


@pytest.mark.parametrize("kind,labels", [("double", [1.2, 1.7]), ("string", ["a", "b"])])
def test_embedding_labels_of_any_type(spark, kind, labels):
    rows = [(i, [1.0, 0.1 * i], labels[i % 2]) for i in range(4)] + [(9, [1.0, 0.0], None)]
    got = embedding_dedup.embedding_links(spark.createDataFrame(rows, f"v long, e array<double>, l {kind}"), "v", "e", "l")
    assert {r.vec_id: (r.n_links, r.component_id) for r in got.collect()} == {0: (1, 0), 2: (1, 0), 1: (1, 1), 3: (1, 1), 9: (0, 9)}


def test_embedding_links_of_nothing(spark):
    assert embedding_dedup.embedding_links(vectors(spark, []), "vec_id", "embedding", "label").count() == 0


def test_cross_polytope_recall():
    rng = np.random.default_rng(0)
    a = rng.normal(size=(1500, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    g = rng.normal(size=a.shape)
    g -= (g * a).sum(1, keepdims=True) * a
    g /= np.linalg.norm(g, axis=1, keepdims=True)
    b = 0.93 * a + np.sqrt(1 - 0.93**2) * g
    ha, hb = embedding_dedup.cross_polytope(a, 6, 4), embedding_dedup.cross_polytope(b, 6, 4)
    assert ((ha[:, :, :1] == hb) | (hb[:, :, :1] == ha)).any(2).any(1).mean() > 0.99


# nearest neighbours


def test_nearest_against_brute_force(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(900, 16)).astype(np.float32)
    x[800:] = x[5]  # ties go to the smaller id
    rows = [(i, v.tolist(), 0) for i, v in enumerate(x)] + [(1000, None, 0), (1100, [0.0] * 16, 0), (1200, [float("inf")] * 16, 0)]
    df = vectors(spark, rows)
    got = ann.nearest(df, "vec_id", "embedding", df.where("vec_id % 100 = 0"), 10).toPandas()
    hits = 0
    for q in range(0, 900, 100):
        d = np.sqrt(((x.astype(float) - x[q].astype(float)) ** 2).sum(1))
        d[q] = np.inf
        want = np.lexsort((np.arange(900), d))[:10]
        mine = got[got.query_id == q].sort_values("rank")
        assert list(mine["rank"]) == list(range(1, 11)) and np.array_equal(mine.score, d[mine.vec_id])
        hits += len(set(want) & set(mine.vec_id))
        if q == 800:
            assert list(mine.vec_id) == [5, *range(801, 810)]
    assert hits >= 0.9 * 90 and set(got.query_id) == set(range(0, 900, 100))


def test_nearest_of_few_and_none(spark):
    df = vectors(spark, [(0, [1.0, 0.0], 0), (100, [0.0, 1.0], 0)])
    got = ann.nearest(df, "vec_id", "embedding", df, 10).collect()
    assert sorted((r.query_id, r.rank, r.vec_id) for r in got) == [(0, 1, 100), (100, 1, 0)]
    assert ann.nearest(vectors(spark, []), "vec_id", "embedding", vectors(spark, []), 10).count() == 0


def test_nearest_of_repeated_rows_and_huge_components(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(400, 8))
    rows = [(i, v.tolist(), 0) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows + [rows[100]], "vec_id long, embedding array<double>, label int")
    got = ann.nearest(df, "vec_id", "embedding", df.where("vec_id % 100 = 0"), 10).toPandas()
    mine = got[got.query_id == 100].sort_values(["rank", "vec_id"])
    assert len(mine) == 20 and list(mine.vec_id[:2]) == [100, 100] and (mine.score[:2] == 0).all()
    d = np.sqrt(((x - x[100]) ** 2).sum(1))
    assert len(set(mine.vec_id) & set(np.argsort(d)[:10])) >= 9
    huge = spark.createDataFrame([(i, (1e200 * v).tolist(), 0) for i, v in enumerate(x)] + [(1000, [1.0, 2.0], 0), (1001, [1.0, 3.0], 0)], df.schema)
    got = ann.nearest(huge, "vec_id", "embedding", huge.where("vec_id % 100 = 0"), 10).toPandas()
    assert got.groupby("query_id").size().to_dict() == {0: 10, 100: 10, 200: 10, 300: 10, 1000: 1}
    assert np.isfinite(got.score).all() and got[got.query_id == 1000].score.iloc[0] == 1.0
    want = np.sqrt(((x - x[200]) ** 2).sum(1)) * 1e200
    assert all(abs(s / want[i] - 1) < 1e-12 for i, s in zip(got[got.query_id == 200].vec_id, got[got.query_id == 200].score))


# language


def brute_bits(model_counts, text, order, langs):
    out = np.zeros(len(langs))
    for i in range(len(text)):
        for k, lang in enumerate(langs):
            bits = 0.0
            for o in range(min(order, i), -1, -1):
                ctx, sym = text[i - o : i], text[i : i + 1]
                follow = model_counts[lang].get(ctx)
                if follow is None:
                    continue
                total, kinds = sum(follow.values()), len(follow)
                if sym in follow:
                    bits += np.log2((total + kinds) / follow[sym])
                    break
                bits += np.log2((total + kinds) / kinds)
            else:
                bits += 8.0
            out[k] += bits
    return out


def test_code_lengths_against_brute_force(spark):
    train = {"aa": ["abracadabra abra", "cadabra"], "bb": ["babble bubble", "bib"]}
    df = spark.createDataFrame([(t, k) for k, ts in train.items() for t in ts], "text string, lang string")
    model = language_id.train(df, order=3)
    counts = {k: {} for k in train}
    for k, ts in train.items():
        for t in ts:
            b = t.encode()
            for o in range(4):
                for i in range(o, len(b)):
                    follow = counts[k].setdefault(b[i - o : i], {})
                    follow[b[i : i + 1]] = follow.get(b[i : i + 1], 0) + 1
    for text in (b"a", b"abra", b"bubble cad", b"zzz", b"abr\xc3\xa9"):
        got = model.lengths(np.frombuffer(text, dtype=np.uint8)).sum(0)
        assert np.allclose(got, brute_bits(counts, text, 3, model.langs), rtol=1e-4)


def test_language_edges(spark):
    texts = ["the and of to in that is was for", "der die und das nicht von mit ist", None, "", "123 !?", "the and that"]
    df = frame(spark, texts)
    model = language_id.train(spark.createDataFrame([(texts[0], "en"), (texts[1], "de"), (None, "fr"), ("x", None)], "text string, lang string"))
    got = {r.doc_id: r for r in language_id.identify(df, model).collect()}
    assert [got[i].lang_pred for i in range(6)] == ["en", "de", "und", "und", "und", "en"]
    assert all(0 <= r.score <= 1 for r in got.values()) and got[0].extra == "e"
    assert {r.lang_pred for r in language_id.identify(df, None).collect()} == {"und"}


def test_language_accuracy_on_held_out_documents(spark):
    got = language_id.op1_ppm(spark, "/root/testdata/sf0.01").where("held_out")
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang")
    assert got.join(docs, "doc_id").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double"))).first()[0] > 0.95


# tokens


def test_token_counts_are_the_librarys(spark):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    texts = [*TEXTS, "it's  a\n\n test<|endoftext|> of<|endoftext|><|endoftext|>", "  lead", "tab\t\tx", "中文字符 é", "don't we'll 'tis", "a" * 600 + " b" * 600, "  x 12345 ½²"]
    library = Tokenizer.from_file(path)
    for head in (0, 5, 1000):
        df = frame(spark, texts).union(frame(spark, texts).where("doc_id = 5"))
        out = token_counts.count_tokens(df, path, public_tokenizers.PATTERN, head=head).toPandas()
        assert len(out) == len(texts) + 1
        for i, n_bytes, n, over in zip(out.doc_id, out.n_bytes, out.n_tokens, out.over_limit):
            want = len(library.encode(texts[i] or "", add_special_tokens=False))
            assert (n_bytes, n, over) == (len((texts[i] or "").encode()), want, want > 512)
    assert token_counts.count_tokens(frame(spark).where("doc_id < 0"), path, public_tokenizers.PATTERN).count() == 0


# pieces


ODD = [
    "", None, " ", "  a", "▁x", "a" * 5000, "中文" * 200, "\U0001f600 ①ﬁ", "x́ नि", "=" * 300, " " * 70, "tab\there\n\n  y", "ab" * 31,
    "ab" * 40, "\x00a", "x" * 61 + "=" * 3 + "y" * 64, " " * 5 + "the" * 90, "\U0001f600" * 200, " " * 1000 + "the", "it's (ok).²", "x" + " " * 40 + "y", " " * 33, "a   b    c     d",
]


@pytest.mark.parametrize("head", [0, 3000])
def test_pieces_are_the_librarys_and_decode_back(spark, head):
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    docs = docs.withColumn("doc_id", F.col("doc_id") + 1000)
    df = frame(spark, ODD).select("doc_id", "text").union(docs).union(docs.where("doc_id = 1001"))
    texts = {r.doc_id: r.text for r in df.collect()}
    coded = sentencepiece_lattice.encode(df, path, head=head).persist()
    assert coded.count() == df.count()
    for r in coded.collect():
        assert r.ids == sp.encode(texts[r.doc_id] or "") and r.n_pieces == len(r.ids)
    for r in sentencepiece_lattice.decode(coded, path).collect():
        assert r.text == (texts[r.doc_id] or "").replace("▁", " ")
    assert [r.round_trip for r in coded.where("doc_id in (0, 4)").distinct().orderBy("doc_id").select("round_trip").collect()][-1] is False
    coded.unpersist()
    assert sentencepiece_lattice.encode(df.where("doc_id < -1"), path).count() == 0


def test_pieces_of_clashing_columns_and_null_ids(spark):
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    df = spark.createDataFrame([(None, "one two", 1, "w"), (7, "one two", 2, None), (7, "one two", 2, None)], "doc_id long, text string, ids int, body string")
    out = sentencepiece_lattice.encode(df, path, carry=("body",)).collect()
    assert sorted((r.doc_id or 0, r.body or "") for r in out) == [(0, "w"), (7, ""), (7, "")] and all(r.ids == sp.encode("one two") for r in out)


# toxicity


def test_ordinal_gradient_and_order():
    rng = np.random.default_rng(1)
    n, width = 600, 5
    x = rng.integers(0, 2, (n, width)).astype(float)
    grades = np.digitize(x @ np.array([2.0, 1.0, 0, 0, -1.0]) + 0.3 * rng.normal(size=n), [0.7, 1.8])
    rows, cols = np.nonzero(x)
    w, cuts = toxicity.fit_ordinal(rows, cols, x[rows, cols], grades, width, l2=0.1, steps=400)
    assert (np.diff(cuts) > 0).all() and w[0] > w[1] > abs(w[2]) and w[4] < 0
    model = toxicity.OrdinalModel({}, w, cuts)
    assert ((model.probabilities(x @ w) > 0.5).sum(1) == grades).mean() > 0.8


def test_ordinal_gradient_is_the_slope_of_the_loss():
    rng = np.random.default_rng(8)
    n, width = 40, 6
    rows, cols = np.nonzero(rng.random((n, width)) < 0.5)
    values, grades = rng.random(len(rows)), rng.integers(0, 4, n)
    at = np.concatenate([rng.normal(size=width), [-1.0, -0.3, 0.2]])
    f = lambda x: toxicity.loss_and_gradient(x[:width], x[width:], rows, cols, values, grades, 0.7)
    slope = [(f(at + d)[0] - f(at - d)[0]) / 2e-6 for d in 1e-6 * np.eye(len(at))]
    assert np.allclose(f(at)[1], slope, rtol=1e-4, atol=1e-5)


def test_scores_are_the_sum_over_features():
    (good, (goodness, goodn, goodnes), (a,)) = toxicity.features_of("good")[0], toxicity.features_of("goodness"), toxicity.features_of("a")
    index = {good: 0, goodness: 1, goodn: 2, a: 3, goodnes: 4}
    model = toxicity.OrdinalModel(index, np.array([1.0, -2.0, 3.0, 0.5, 7.0]), np.array([0.0]))
    features = toxicity.Features(index)
    texts = ["Good goodness goodnight a a", None, "", "goodness", "unknown words", "a " * 999]
    want = [np.log(2) - 2 * np.log(2) + 3 * np.log(3) + 0.5 * np.log(3) + 7 * np.log(2), 0, 0, (-2 + 3 + 7) * np.log(2), 0, 0.5 * np.log(1000)]
    assert np.allclose(model.scores(texts, features), want) and np.allclose(model.scores(texts, features), want)


def test_toxicity_on_documents_not_fitted(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    held = F.pmod(F.col("doc_id"), F.lit(4)) == 0
    model = toxicity.fit_from_labels(docs, labels.where(~held))
    got = toxicity.grade_toxicity(docs, model).join(labels.where(held).where("toxic is not null"), "doc_id").select("grade", "toxic").toPandas()
    caught = ((got.grade > 0) & (got.toxic == 1)).sum()
    assert (got.toxic == 1).sum() >= 5 and caught >= 0.8 * (got.toxic == 1).sum() and caught >= 0.9 * (got.grade > 0).sum()


def test_more_planted_words_give_no_less_severity(spark):
    rng = np.random.default_rng(3)
    bad, calm = [f"vile{k}x" for k in "abcdefgh"], [f"word{k}" for k in range(200)]
    text = lambda k: " ".join(rng.permutation([*rng.choice(bad, k), *rng.choice(calm, 30)]))
    strength = [int(k) for k in rng.choice([0, 0, 0, 1, 2, 4, 8], 1200)]
    docs = frame(spark, [text(k) for k in strength])
    labels = spark.createDataFrame([(i, int(k > 0)) for i, k in enumerate(strength) if i % 3], "doc_id long, toxic int")
    out = toxicity.grade_toxicity(docs, toxicity.fit_from_labels(docs, labels)).where("doc_id % 3 = 0").toPandas()
    mean = out.groupby([strength[i] for i in out.doc_id]).severity.mean()
    assert list(mean.index) == [0, 1, 2, 4, 8] and (np.diff(mean) > 0).all()


def test_models_of_nothing_repeats_and_clashing_names(spark):
    docs = frame(spark, ["the and of", "der die das"]).withColumns({c: F.lit(3) for c in ("row", "letters", "bits", "_score", "Severity")})
    assert language_id.identify(docs.where("doc_id < 0"), None).count() == 0 == toxicity.grade_toxicity(docs.where("doc_id < 0"), None).count()
    empty = spark.createDataFrame([], "text string, lang string")
    assert language_id.train(empty) is None
    many = spark.createDataFrame([("the and of to " * 5, "en")] * 3000 + [("der die das und " * 5, "de"), ("x" * 200_000, "long")], "text string, lang string")
    model = language_id.train(many, train_bytes=100)
    assert model.langs == ["de", "en", "long"]
    got = language_id.identify(docs.union(docs), model).collect()
    assert sorted(r.lang_pred for r in got) == ["de", "de", "en", "en"] and all(r.row == r.bits == r.letters == 3 for r in got)
    toxic = frame(spark, ["you fool you fool"] * 30 + ["a calm day"] * 60).withColumn("row", F.lit(1))
    toxic = toxic.union(toxic.where("doc_id = 0").crossJoin(spark.range(50).select()))
    labels = spark.createDataFrame([(i, int(i < 30)) for i in range(90)], "doc_id long, toxic int")
    assert toxicity.grade_toxicity(toxic, toxicity.fit_from_labels(toxic, labels)).where("grade > 0").count() == 80
    assert toxicity.fit_from_labels(toxic, labels.where("doc_id < 0")) is None


def test_toxicity_separates_and_handles_edges(spark):
    bad = ["you are a wretched fool " + "word " * (i % 3) for i in range(60)]
    good = ["a calm day by the river " + "leaf " * (i % 5) for i in range(120)]
    docs = frame(spark, [*bad, *good, None, "", "long " * 30_000])
    labels = spark.createDataFrame([(i, int(i < 60)) for i in range(180)] + [(1, 1), (999, 1), (5, None)], "doc_id long, toxic int")
    model = toxicity.fit_from_labels(docs, labels)
    out = {r.doc_id: r for r in toxicity.grade_toxicity(docs, model).collect()}
    assert all(out[i].grade > 0 for i in range(60)) and not any(out[i].grade for i in range(60, 183))
    assert out[180].severity == out[181].severity == 0.0 and out[0].extra == "e"
    assert toxicity.fit_from_labels(docs, labels.where("toxic = 1")) is None
    assert toxicity.grade_toxicity(docs, None).where("grade > 0").count() == 0


# mixing


WEIGHTS = [[1.0, 1.0], [5.0, 3.0, 2.0], [0.7, 0.1, 0.1, 0.05, 0.05], [1.0], [0.9] + [0.011] * 9, [0.96] + [0.0004] * 99, [2**0.5, 3**0.5, 1e-3]]


@pytest.mark.parametrize("weights", WEIGHTS)
def test_pfair_keeps_within_one_block_of_the_weights(weights):
    from fractions import Fraction

    exact = [Fraction(w) / sum(map(Fraction, weights)) for w in weights]
    slots = 50_000
    done = [0] * len(weights)
    for t, (s, k, at) in enumerate(mixing.pfair(weights, [int(w * slots) + 1 for w in exact])[: slots - 1]):
        assert k == done[s]
        done[s] += 1
        if t % 97 == 0 or t < 2000:
            if at != t:  # a source ran out near the end
                assert t > 0.99 * slots
                break
            assert all(abs(d - (t + 1) * w) < 1 for d, w in zip(done, exact))


def test_pfair_windows_hold_after_sources_run_out():
    from fractions import Fraction

    weights, blocks = [3, 2, 1, 1], [10, 200, 1, 90]
    plan = mixing.pfair(weights, blocks)
    assert sorted((s, k) for s, k, _ in plan) == [(s, k) for s in range(4) for k in range(blocks[s])]
    assert len({t for _, _, t in plan}) == len(plan)
    for s, k, t in plan:
        w = Fraction(weights[s], 7)
        assert k / w - 1 < t < (k + 1) / w + 1 and t >= (k / w).__floor__() and t < -((-(k + 1) / w).__floor__())


def test_mix_places_every_row(spark):
    rows = [(i, "t", "en", None if i % 7 == 0 else f"s{i % 3}", "e") for i in range(1000)]
    df = spark.createDataFrame(rows, DOCS)
    out = mixing.mix(df, block=8).toPandas()
    assert len(out) == 1000 and not out.duplicated(["mix_slot", "mix_pos"]).any()
    assert out.groupby("mix_slot").source.nunique(dropna=False).max() == 1
    n = out.groupby("source", dropna=False).size()
    weights = np.sqrt(n) / np.sqrt(n).sum()
    full = out[out.mix_slot < 40].groupby("source", dropna=False).mix_slot.nunique()
    assert (np.abs(full - 40 * weights) < 1).all()
    assert sorted(r.doc_id for r in mixing.in_mixed_order(df).collect()) == list(range(1000))
    assert mixing.mix(df.where("doc_id < 0")).count() == 0
    with pytest.raises(ValueError):
        mixing.mix(df, weights={None: 0.0, "s0": 1, "s1": 1, "s2": 1}).count()


def test_mix_and_shards_of_clashing_names_and_rows_all_alike(spark):
    more = ["shard", "slice", "row", "place", "n", "own", "first", "spread", "walk", "_slots", "_first", "mix_slot", "slot"]
    df = spark.range(300).select(F.lit(5).alias("doc_id"), F.lit("a").alias("source"), *[F.lit(k).alias(c) for k, c in enumerate(more)])
    out = mixing.mix(df, block=7).toPandas()
    assert sorted(out.mix_block * 7 + out.mix_pos) == list(range(300)) and (out["slice"] == 1).all() and (out["_first"] == 10).all()
    out = sharding.shard_documents(df, 24).toPandas()
    assert sorted(out.slot) == list(range(300)) and out["shard"].nunique() == 1 and (out["row"] == 2).all()


# pages


PAGE = (
    "<!DOCTYPE html><html><head><title>T</title><script>var a='<p>no</p>';</script></head><body class='site'><header>Head</header><nav><ul><li>Menu</ul></nav>"
    "<div class='cookie-notice'>We use cookies, a lot of them, here and there and everywhere, really.</div><div id=main class='c12 wrap'><h1>Title &amp; more</h1><p>First <b>bold</b> text,\n with   spaces and more words to be long.<p>Second "
    "paragraph&nbsp;here, with some commas, and so on.<br>line</p><div class=ad>Buy now, cheap</div></div><div class='sidebar'><p>Side text, of some length, with commas, to tempt.</p></div>"
    "<section id='comments'><p>A reader says something, at length, with many commas, and more.</p></section><form><label>x</label></form><footer>Foot</footer></body></html>"
)


def test_extraction(spark):
    rows = [(0, "http://h.example/1", PAGE), (1, "http://h.example/2", PAGE.replace("c12", "c77")), (2, None, None), (3, "bad url", ""), (4, "http://x.example", "plain & text"), (5, "http://h.example/1", PAGE), (6, "http://y.example", "<p>unclosed <b>tag" + " x" * 50_000)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    out = {r.page_id: r for r in html_text.extract_text(df.withColumn("text", F.lit("clash"))).collect()}
    want = "Title & more\nFirst bold text, with spaces and more words to be long.\nSecond paragraph here, with some commas, and so on. line"
    assert out[0].text == out[1].text == out[5].text == want
    assert out[2].text == out[3].text == "" and out[4].text == "plain & text" and out[6].text.startswith("unclosed tag x")
    assert html_text.extract_text(df.where("page_id < 0")).count() == 0


def test_extraction_takes_the_hosts_path(spark):
    odd = PAGE.replace("First <b>", "F<b>").replace("</div><div class='sidebar'>", "</div><div class='other'><p>" + "Longer, much longer, text, " * 30 + "</p></div><div class='sidebar'>")
    rows = [(i, "http://h.example/a", PAGE) for i in range(20)] + [(20, "http://h.example/b", odd)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = html_text.extract_text(df).where("page_id = 20").first().text
    assert got.startswith("Title & more") and "Longer" not in got


def test_extraction_of_the_given_pages(spark):
    import html

    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    got = html_text.op6_consensus_paths(spark, "/root/testdata/sf0.001").join(pages.select("page_id", "html"), "page_id").collect()
    for r in got:
        body = re.search(r"<article>(.*?)</article>", r.html, re.S)[1]
        parts = [re.sub(r"\s+", " ", html.unescape(re.sub(r"<[^>]*>", " ", x))).strip() for x in re.split(r"</?(?:p|h1)>", body)]
        assert r.text == "\n".join(x for x in parts if x) and r.n_chars == len(r.text)


def test_extraction_of_teasers_comments_and_formulas(spark):
    prose = "Nothing in this long sentence is of any use, yet it runs on and on, as sentences of articles do. "
    pages = [(f"http://h/{i}", f"<body><article><p>{prose * 6}</p></article></body>") for i in range(6)]
    pages.append(("http://h/t", f"<body><article><p>Read more of this story, if you like to, soon.</p></article><div class=story><p>{prose * 12}</p></div></body>"))
    boxes = "".join(f"<div class='{c}'><p>{prose}</p></div>" for c in ("comment-body", "promo-card", "social-media"))
    pages.append(("http://h/c", f"<body><article><p>{prose * 3}</p><section class='reader-comments'><p>{prose}</p></section><section class='user-comments'><p>{prose}</p></section>{boxes}</article></body>"))
    formula = "<math><mrow><mi>a</mi><mo>+</mo><mn>2</mn></mrow><annotation>a+2</annotation></math>"
    pages.append(("http://h/m", f"<body><article><p>So <svg><path d='M0'/><text>icon</text></svg>the sum {formula} is what counts, as was said before.</p><p>{prose * 3}</p></article></body>"))
    pages += pages[-1:]
    got = {r.url: r.text for r in html_text.extract_text(spark.createDataFrame(pages, "url string, html string")).collect()}
    assert got["http://h/t"] == (prose * 12).strip() and got["http://h/c"] == (prose * 3).strip()
    assert got["http://h/m"] == f"So the sum a+2 is what counts, as was said before.\n{(prose * 3).strip()}"


def test_extraction_of_odd_pages(spark):
    body = "Running text of the article, with commas, long enough to count as such, really."
    names = "<article><div class='entry-header'><h1>Title</h1></div><p class='share-price'>The share price rose, a little, on that day.</p><p>{}</p><div class='ad'>Buy</div><div id='comments'><p>{}</p></div></article>".format(body, body[8:])
    layout = "<div class='sidebar'><nav>Menu</nav><div class='text'><p>{0}</p><p>{0}</p></div></div>".format(body)
    raw = "İ" * 40 + "<script>var x = 'İ</p>';</script><p>" + body + "</p>"
    deep = "<div>" * 50_000 + "<p>" + body + "</p>"
    spans = "<b>" * 50_000 + body
    pages = [names, layout, raw, deep, spans, "<style>never closed <p>x</p>", "</p></div>" * 20_000 + body]
    df = spark.createDataFrame([(i, f"http://h{i}.example/", t) for i, t in enumerate(pages)], "page_id long, url string, html string")
    clash = df.withColumns({c: F.lit(9) for c in ("paths", "host", "row", "page", "_html", "Text")})
    out = {r.page_id: r for r in html_text.extract_text(clash).collect()}
    assert out[0].text == "Title\nThe share price rose, a little, on that day.\n" + body and out[0].paths == out[0].host == out[0].row == 9
    assert out[1].text == body + "\n" + body and out[2].text == "İ" * 40 + "\n" + body
    assert out[3].text == out[4].text == out[6].text == body and out[5].text == ""


def test_a_teaser_at_the_hosts_path_is_not_the_article(spark):
    usual = "<div class='story'><p>{0}</p><p>{0}</p></div>".format("Usual text of a usual page, long enough, with commas. ")
    rare = "<div class='story'><p>A teaser, short, of it all.</p></div><div class='long'>" + "<p>Long read, of many words, that goes on, and on, for a while, at this place.</p>" * 20 + "</div>"
    df = spark.createDataFrame([(i, "http://h.example/", usual if i else rare) for i in range(20)], "page_id long, url string, html string")
    got = html_text.extract_text(df).where("page_id = 0").first().text
    assert got.startswith("Long read") and got.count("\n") == 19
