"""The pipeline's stages, each against what it says it does."""

import random
import re

import public_tokenizers
from pyspark.sql import functions as F

import corpus_pipeline as P
from pluvion.llm import mixing, simhash

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, more int"


def kept_by_brute_force(texts):
    """The smallest id of each chain of pairs whose five-word shingle sets have Jaccard similarity 0.8 or more."""
    sets, root = {}, {}
    for i, text in sorted(texts.items()):
        w = re.sub("[A-Z]", lambda m: m[0].lower(), text or "").encode().split()
        s = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))}
        near = {root[j] for j, o in sets.items() if 5 * len(s & o) >= 4 * len(s | o)} | {i}
        sets[i], root[i] = s, min(near)
        root = {j: min(near) if r in near else r for j, r in root.items()}
    return sorted(set(root.values()))


def test_stages_on_the_smallest_data(spark, tmp_path):
    import sentencepiece

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    before = docs
    for k, (name, stage) in enumerate(P.STAGES):
        stage(spark, before, SF).write.parquet(str(tmp_path / str(k)))
        after = spark.read.parquet(str(tmp_path / str(k)))
        if k < len(P.STAGES) - 1:
            assert after.columns == docs.columns, name
            assert after.select("doc_id", "text").exceptAll(before.select("doc_id", "text")).isEmpty(), name
        if name == "simhash near-dedup":
            assert sorted(r.doc_id for r in after.collect()) == kept_by_brute_force({r.doc_id: r.text for r in before.collect()})
        if name == "source mixing":
            assert after.count() == before.count()
        if name == "sentencepiece encoding":
            sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
            texts = {r.doc_id: r.text for r in before.collect()}
            got = after.collect()
            assert len(got) == len(texts) and all(r.ids == sp.encode(texts[r.doc_id]) for r in got)
        before = after
    toxic = spark.read.parquet(f"{SF}/labels.parquet").where("toxic = 1")
    left = spark.read.parquet(str(tmp_path / "0"))
    assert left.join(toxic, "doc_id").count() <= 0.3 * toxic.count()
    clean = spark.read.parquet(f"{SF}/labels.parquet").where("toxic = 0")
    assert left.join(clean, "doc_id").count() >= 0.97 * clean.count()


def test_language_stage_drops_what_has_no_language(spark):
    rows = [(i, "the and that with from this are for was not but " * 3, "en", "s", 1, 0) for i in range(40)]
    odd = [(100, None, "en", None, None, None), (101, "", "en", "s", 0, 0), (102, "12 34 !!", "en", "s", 0, 0), (103, "the and that was", None, "s", 0, 0)]
    got = P.keep_known_languages(spark, spark.createDataFrame(rows + odd, SCHEMA), SF)
    assert sorted(r.doc_id for r in got.collect()) == [*range(40), 103]
    assert got.where("doc_id = 103").first().lang == "en" and got.columns[-1] == "more"


def test_dedup_keeps_rows_without_an_id(spark):
    text = "one two three four five six seven eight nine ten eleven twelve"
    rows = [(5, text, "en", "s", 1, 0), (3, text, "en", "s", 1, 0), (3, text, "en", "s", 1, 0), (None, "another text of its own, quite different from it", "en", "s", 1, 0)]
    got = P.dedup(spark, spark.createDataFrame(rows, SCHEMA), SF)
    assert sorted((r.doc_id or -1) for r in got.collect()) == [-1, 3]


def test_dedup_equals_brute_force_jaccard(spark):
    rng = random.Random(5)
    words = [f"w{k}" for k in range(3000)]
    texts = []
    for group in range(60):
        base = rng.choices(words, k=rng.choice([3, 5, 30, 120, 400]))
        for _ in range(rng.choice([1, 2, 6])):
            copy = list(base)
            for _ in range(rng.randrange(0, 1 + len(base) // 25)):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            texts.append(" ".join(copy))
    crowd = rng.choices(words, k=100)  # a dense group, with a line that all of it and others hold
    texts += [" ".join([*crowd[:k], rng.choice(words), *crowd[k:]]) for k in range(90)]
    texts += [" ".join([*crowd[:60], *rng.choices(words, k=8)]) for _ in range(30)] + ["", " ", None]
    rng.shuffle(texts)
    sets = []
    for text in texts:
        w = (text or "").split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))})
    root = list(range(len(sets)))

    def top(k):
        while root[k] != k:
            k = root[k]
        return k

    far = 0
    prints = {r.doc_id: r.fp for r in simhash.fingerprints(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), 5).collect()}
    for j, b in enumerate(sets):
        for i in range(j):
            if 5 * len(sets[i] & b) >= 4 * len(sets[i] | b):
                far += ((prints[i] ^ prints[j]) & (2**64 - 1)).bit_count() > 4
                root[max(top(i), top(j))] = min(top(i), top(j))
    rows = [(i, t, "en", "s", 1, 0) for i, t in enumerate(texts)]
    got = P.dedup(spark, spark.createDataFrame(rows, SCHEMA), SF)
    assert far > 100
    assert sorted(r.doc_id for r in got.collect()) == [k for k in range(len(root)) if top(k) == k]


def test_dedup_leaves_no_texts_in_the_shared_folder(spark):
    import glob

    from pluvion.operators.components import shared_dir

    rng = random.Random(7)
    base = [" ".join(rng.choices(["a", "b", "c", "d", "e", "f"], k=60)) for _ in range(20)]
    rows = [(i, base[i % 20] + f" tail{i}", "en", "s", 1, 0) for i in range(100)]
    at = shared_dir(spark).removeprefix("file:")
    before = set(glob.glob(f"{at}/table-*"))
    assert P.dedup(spark, spark.createDataFrame(rows, SCHEMA), SF).count() == 20
    left = set(glob.glob(f"{at}/table-*")) - before
    assert left and not {"text", "prefix"} & {c for path in left if glob.glob(f"{path}/*") for c in spark.read.parquet(path).columns}


def test_rows_tell_their_place_in_the_mix(spark, tmp_path, monkeypatch):
    rows = [(i, f"text {i} " + "word " * (i % 40), "en", "small" if i % 9 == 0 else "large", 1, 0) for i in range(4000)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    source = {r[0]: r[3] for r in rows}
    monkeypatch.setattr(P, "STAGES", P.STAGES[-2:])
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")  # a scan of many splits, packed by size
    try:
        got = sorted(P.run(spark, str(tmp_path)).collect(), key=lambda r: r.mix_place)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert len({r.mix_place for r in got}) == len(rows)
    slots = mixing.mix(spark.read.parquet(str(tmp_path / "documents.parquet"))).orderBy("mix_slot", "mix_pos").collect()
    assert [r.doc_id for r in got] == [r.doc_id for r in slots]
    small = sum(s == "small" for s in source.values())
    share = small**0.5 / (small**0.5 + (len(rows) - small) ** 0.5)
    for n in range(256, 1400, 64):  # until the small source runs out; one block of rows off at most, and a part of another
        assert abs(sum(source[r.doc_id] == "small" for r in got[:n]) - n * share) <= 128


def test_entry_works_without_the_operators(tmp_path):
    import os
    import shutil
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    skip = shutil.ignore_patterns("llm", "corpus_pipeline.py", ".git", "__pycache__")
    shutil.copytree(root, tmp_path / "copy", ignore=skip)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'rain_events' in q and 'pipeline' not in q and set(e.oracle_sql()) <= set(q)"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    assert subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "copy", env=env).returncode == 0


def test_every_query_is_registered(spark):
    import __spark_entry__ as e

    names = e.queries()
    assert {n.split("_")[0] for n in names if n.startswith("op")} >= {f"op{i}" for i in range(1, 11)} and "pipeline" in names
    assert set(e.oracle_sql()) <= set(names)
    assert e.entry(spark).select(F.count("*")).first()[0] > 0
