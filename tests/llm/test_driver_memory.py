"""What the driver holds while the pipeline's models and heads are made."""

import gc
import tracemalloc
from collections import Counter

import numpy as np
import public_tokenizers

from pluvion.llm import sentencepiece_lattice, toxicity

SF = "/root/testdata/sf0.001"


def test_head_is_columns_on_the_driver(spark):
    pieces = sentencepiece_lattice.Pieces(public_tokenizers.path("piece_bpe_32k.model"))
    shared = spark.sparkContext.broadcast(pieces)
    texts = [" ".join(f"{'abcdefghij'[k % 10]}{chr(97 + k % 26)}{chr(97 + k // 26 % 26)}{chr(97 + k // 676 % 26)}word" for k in range(s, s + 500)) for s in range(0, 20_000, 500)]
    docs = spark.createDataFrame([(i, t + " " + "x" * 70 + " the the  end." * (i % 3)) for i, t in enumerate(texts)], "doc_id long, text string")
    sentencepiece_lattice._head(docs, pieces, shared, 100)  # what a first call loads doesn't count
    tracemalloc.start()
    try:
        before = tracemalloc.get_traced_memory()[0]
        head = sentencepiece_lattice._head(docs, pieces, shared, 50_000)
        gc.collect()
        kept = tracemalloc.get_traced_memory()[0] - before
    finally:
        tracemalloc.stop()
    assert len(head.ends) > 20_000 and kept < 80 * len(head.ends)
    tokens, words = head.codes
    flat = np.frombuffer(head.flat, dtype=np.uint16)
    ids = lambda code: flat[head.ends[code - 1] if code else 0 : head.ends[code]].tolist()
    processor = __import__("sentencepiece").SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    assert len(tokens) + len(words) == len(head.ends) == len({*tokens.values(), *words.values()}) and "x" * 70 not in tokens
    assert {" the", " end", "."} <= words.keys() and {"", "the", "end."} <= tokens.keys()
    for token in [*list(tokens)[::97], "the", "end."]:
        assert ids(tokens[token]) == processor.encode(token or " "), token
    for word in list(words)[::97]:
        assert word[0] != " " or ids(words[word]) == processor.encode(word[1:] or " "), word


def test_gradient_takes_blocks_of_entries(monkeypatch):
    rng = np.random.default_rng(4)
    n, width, per = 2000, 500, 500
    rows, cols = np.repeat(np.arange(n, dtype=np.int32), per), rng.integers(0, width, n * per).astype(np.int32)
    values, grades = rng.random(n * per).astype(np.float32), rng.integers(0, 4, n)
    w, raw = rng.normal(size=width), np.array([-1.0, -0.3, 0.2])
    monkeypatch.setattr(toxicity, "BLOCK", 1 << 40, raising=False)
    loss, slope = toxicity.loss_and_gradient(w, raw, rows, cols, values, grades, 0.7)
    monkeypatch.setattr(toxicity, "BLOCK", 10_007, raising=False)
    tracemalloc.start()
    try:
        got = toxicity.loss_and_gradient(w, raw, rows, cols, values, grades, 0.7)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < 2 * n * per and np.isclose(got[0], loss) and np.allclose(got[1], slope)


def test_only_features_of_enough_documents_reach_the_driver(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    toxic = {r.doc_id: r.toxic for r in labels.where("toxic is not null").collect()}
    texts = {r.doc_id: r.text for r in docs.where("text <> ''").collect() if r.doc_id in toxic}
    found = {}
    for i, text in texts.items():
        found[i] = Counter()
        for word, n in Counter(toxicity.WORD.findall(text.lower())).items():
            found[i].update(dict.fromkeys(toxicity.features_of(word), n))
    seen = Counter(f for got in found.values() for f in got)
    often = sorted(f for f, n in seen.items() if n >= toxicity.MIN_DOCS)
    model = toxicity.fit_from_labels(docs, labels)
    assert list(model.index) == often and 0 < len(often) < len(seen)
    # the same entries, fitted at once
    ids = sorted(found)
    features = [(k, often.index(f), n) for k, i in enumerate(ids) for f, n in found[i].items() if seen[f] >= toxicity.MIN_DOCS]
    rows, codes, counts = (np.array(x) for x in zip(*features))
    terms, yes = np.array(often), np.array([toxic[i] > 0 for i in ids])
    grades = toxicity.severity_grades(yes, terms, (codes, rows, counts))
    w, cuts = toxicity.fit_ordinal(rows, codes, np.log1p(counts.astype(np.float32)), np.unique(grades, return_inverse=True)[1], len(terms))
    assert np.allclose(model.weights, w) and np.allclose(model.cuts, cuts)
