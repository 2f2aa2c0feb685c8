"""The Merkle manifest against a tree built in plain Python."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from pluvion.llm import merkle as M


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def tree(leaves, fanout=8):
    """(root, [(left, right) steps of each leaf])."""
    steps, own, now = [[] for _ in leaves], [[i] for i in range(len(leaves))], list(leaves)
    while len(now) > 1:
        runs = [range(s, min(s + fanout, len(now))) for s in range(0, len(now), fanout)]
        for run in runs:
            for j in run:
                for i in own[j]:
                    steps[i].append(("".join(now[run.start : j]), "".join(now[j + 1 : run.stop])))
        own = [sum((own[j] for j in run), []) for run in runs]
        now = [digest(*now[run.start : run.stop]) for run in runs]
    return now[0], steps


def expected(rows, fanout=8):
    groups: dict = {}
    for key, grp, leaf, claim in rows:
        groups.setdefault(grp, []).append((key is not None, key, leaf, claim))
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = []
    for g in order:
        groups[g].sort(key=lambda r: (r[0], r[1] or 0, r[2]))
        trees.append(tree([r[2] for r in groups[g]], fanout))
    root, upper = tree([t[0] for t in trees], fanout)
    out = []
    for g, (subroot, steps), up in zip(order, trees, upper):
        for (_, key, leaf, claim), path in zip(groups[g], steps):
            folded = claim
            for left, right in path + up:
                folded = digest(left, folded, right)
            proof = digest(*[a + b for a, b in path + up])
            out.append((key, leaf, subroot, root, proof, folded, folded == root))
    return sorted(out, key=str)


@pytest.mark.parametrize("sizes,fanout", [({"a": 1}, 8), ({"a": 9, None: 1, "é": 65, "": 8, "b": 2}, 8), ({f"g{i}": i % 5 + 1 for i in range(20)}, 3)])
def test_proofs_equal_a_plain_tree(spark, sizes, fanout):
    rng = random.Random(3)
    rows = []
    for g, n in sizes.items():
        for i in range(n):
            leaf = digest(str(g), str(i // 2))
            rows.append((rng.choice([i, i, i, 4, None]), g, leaf, leaf if i % 3 else digest("other")))
    got = M.prove(spark.createDataFrame(rows, "key long, grp string, leaf string, claim string"), fanout)
    cols = ("key", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")
    # of equal keys and leaves, claims may change places with each other
    assert sorted((tuple(r[c] for c in cols[:-2]) for r in got.collect()), key=str) == sorted((r[:-2] for r in expected(rows, fanout)), key=str)
    sure = {(k, leaf) for k, _, leaf, _ in rows if sum(x[0] == k and x[2] == leaf for x in rows) == 1}
    assert sorted((tuple(r[c] for c in cols) for r in got.collect() if (r["key"], r["leaf"]) in sure), key=str) == [
        r for r in expected(rows, fanout) if r[:2] in sure
    ]


def test_leaves_and_query(spark, tmp_path):
    rows = [(i, f"Text {i}É ABC" if i % 7 else None, "en" if i % 5 else None, "s", i) for i in range(30)] + [(None, "", "de", None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumn("tree", F.lit(1))
    df.write.parquet(str(tmp_path / "documents.parquet"))
    import zlib

    part = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    lower = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    leaves = []
    for doc_id, text, lang, source, n in rows:
        struck = doc_id is not None and zlib.crc32(str(doc_id).encode()) % 3 == 0 and text is not None
        made = [digest(*map(part, (doc_id, source, lang, n, t))) for t in (text, text.translate(lower) if struck else text)]
        leaves.append((doc_id, lang, *made))
    got = M.op12_merkle_manifest(spark, str(tmp_path))
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert sorted(map(tuple, got.collect()), key=str) == expected(leaves)
    assert {r["verified"] for r in got.collect()} == {True, False}


def test_manifest_of_nothing(spark):
    assert M.prove(spark.createDataFrame([], "key long, grp string, leaf string, claim string")).count() == 0
