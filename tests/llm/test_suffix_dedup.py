"""Repeated strings against a count of all of them, and induced sorting against plain sorting."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from pluvion.llm import induced_sorting as IS
from pluvion.llm import suffix_dedup as S


def expected(texts):
    n = S.LENGTH
    counts = Counter(t[i : i + n] for t in texts for i in range(len(t) - n + 1))
    out = []
    for t in texts:
        gone = bytearray(len(t))
        for i in range(len(t) - n + 1):
            if counts[t[i : i + n]] > 1:
                gone[i : i + n] = b"\1" * n
        spans = sum(1 for i, g in enumerate(gone) if g and not (i and gone[i - 1]))
        kept = bytes(c for c, g in zip(t, gone) if not g)
        out.append((len(t), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def made():
    rng = random.Random(5)

    def prose(n):
        return "".join(rng.choice("abcdefgh éß.\n") for _ in range(n))

    passage, other = prose(450), prose(330)
    texts = [prose(rng.randrange(0, 900)) for _ in range(25)]
    texts += [prose(rng.randrange(300)) + passage + prose(rng.randrange(300)) for _ in range(15)]
    texts += [prose(90) + passage[:230] + other + prose(3), other[20:] + passage[100:], passage, passage]
    texts += ["=" * 5000, "=" * 199, "=" * 200, "ab" * 150, prose(40) + "xyz " * 300, "", None, prose(200)]
    copy = prose(700)
    return texts + [copy] * 30 + [copy[:350] + "!" + copy[350:]]


def test_removed_bytes_equal_a_count_of_all_strings(spark):
    texts = made()
    df = spark.createDataFrame([(i // 2 if i % 9 else None, t, i) for i, t in enumerate(texts)], "doc_id long, text string, sha long")
    got = S.remove_repeats(df.repartition(5)).collect()
    want = Counter((i // 2 if i % 9 else None, *e) for i, e in enumerate(expected([(t or "").encode() for t in texts])))
    assert Counter(tuple(r) for r in got) == want


def test_blocks_of_a_long_text_and_many_shards(spark, monkeypatch):
    rng = random.Random(6)
    core = bytes(rng.randrange(97, 105) for _ in range(3000))
    texts = [core + bytes(rng.randrange(97, 105) for _ in range(2000)) + core[:900], core[500:1500]]
    monkeypatch.setattr(S, "BLOCK", 700)
    text, begin, size, least, content, own = S.hashed_runs(texts)
    assert sorted((t, i) for t, b, n in zip(text, begin, size) for i in range(b, b + n)) == [
        (t, i) for t, x in enumerate(texts) for i in range(len(x) - S.LENGTH + 1)
    ]
    monkeypatch.setattr(S, "SHARD", 1000)
    df = spark.createDataFrame([(i, t.decode()) for i, t in enumerate(texts)], "doc_id long, text string")
    assert {r["doc"]: tuple(r)[1:] for r in S.remove_repeats(df).collect()} == dict(enumerate(expected(texts)))


def test_no_documents(spark):
    assert S.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@pytest.mark.parametrize("batch,memory", [(1, None), (40, None), (1 << 16, 64)])
def test_induced_sorting(tmp_path, monkeypatch, batch, memory):
    monkeypatch.setattr(IS, "BATCH", batch)
    monkeypatch.setattr(IS, "LEAST", min(batch, IS.LEAST))
    store = IS.Store(str(tmp_path), memory) if memory else IS.Store()
    rng = random.Random(batch)
    for n, letters in [(1, 1), (6, 1), (30, 2), (300, 2), (300, 7), (700, 3)]:
        text = [rng.randrange(1, letters + 1) for _ in range(n)]
        text = bytes(text + text[: n // 2] + [1] + text[::-1] + [0])
        places, prefix = IS.sorted_suffixes(np.frombuffer(text, np.uint8), store)
        order = sorted(range(len(text)), key=lambda i: text[i:])
        assert places.tolist() == order
        shared = [0]
        for a, b in zip(order, order[1:]):
            k = 0
            while k < IS.MOST and max(a, b) + k < len(text) and text[a + k] == text[b + k]:
                k += 1
            shared.append(k)
        assert prefix.tolist() == shared
    assert not list(tmp_path.iterdir())  # files go with their last reader


def test_near_dedup_keeps_columns_of_any_name(spark):
    from pluvion.llm import similar_sets

    words = "one two three four five six seven eight nine ten eleven twelve"
    rows = [(1, words, 7, 1, 2), (2, words, 8, 3, 4), (3, "quite another text of its own, as long as that", 9, 5, 6)]
    schema = "doc_id long, text string, _key int, key int, row int"
    got = similar_sets.drop_similar(spark.createDataFrame(rows, schema), 5, 0.8)
    assert got.columns == ["doc_id", "text", "_key", "key", "row"] and sorted(map(tuple, got.collect())) == [rows[0], rows[2]]
    assert similar_sets.drop_similar(spark.createDataFrame([], schema), 5, 0.8).count() == 0
