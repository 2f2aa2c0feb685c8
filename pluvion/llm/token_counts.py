"""Token counts of whole texts with a byte-level BPE tokenizer, without materialising ids.

Merges never cross pre-tokens, so a text's count is the sum of its pre-tokens' counts. Pieces are counted once per
distinct pre-token and joined to the per-document pre-token frequencies. A bounded head of frequent pre-tokens is
looked up where the text is read, which keeps the join to the rare ones; the head only saves work, so it may come from a
sample of documents.
"""

from __future__ import annotations

import json
import os
from collections import Counter

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.components import stored
from .common import table

#: Pre-tokens in the head at most, and documents of the sample that it comes from, about.
HEAD, HEAD_DOCS = 262_144, 20_000


def special_tokens(path: str) -> list[str]:
    """Strings of the file that the library takes as one token wherever a text has them."""
    with open(path, encoding="utf-8") as f:
        return [t["content"] for t in json.load(f)["added_tokens"]]


class PreTokens:
    """Pre-tokens of texts, and a count of the special strings among them."""

    def __init__(self, pattern: str, specials: list[str]):
        self.find = regex.compile(pattern).findall
        self.specials = specials
        alternatives = "|".join(regex.escape(x) for x in sorted(specials, key=len, reverse=True))
        self.split = regex.compile(alternatives).split if specials else None

    def __call__(self, text: str) -> tuple[list[str], int]:
        if self.split is None or not any(x in text for x in self.specials):
            return self.find(text), 0
        parts = self.split(text)
        return [x for p in parts for x in self.find(p)], len(parts) - 1


def _frequent(pattern: str, specials: list[str]):
    def run(batches):
        pre, total = PreTokens(pattern, specials), Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                total.update(pre(text or "")[0])
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], ["word", "n"])

    return run


def _pieces(path: str):
    def run(batches):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        for batch in batches:
            words = batch.column(0).to_pylist()
            n = []
            for s in range(0, len(words), 1000):
                n += [len(e) for e in tokenizer.encode_batch_fast(words[s : s + 1000], add_special_tokens=False)]
            yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(n, pa.int64())], ["word", "pieces"])

    return run


def _frequencies(pattern: str, specials: list[str], shared):
    def run(batches):
        pre, head = PreTokens(pattern, specials), shared.value
        for batch in batches:
            uids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            uid, word, freq, known = [], [], [], []

            def full():
                return pa.RecordBatch.from_arrays(
                    [pa.array(uid, pa.int64()), pa.array(word, pa.string()), pa.array(freq, pa.int32()), pa.array(known, pa.int64())],
                    ["uid", "word", "freq", "known"],
                )

            for u, text in zip(uids, texts):
                found, n = pre(text or "")
                for w, k in Counter(found).items():
                    pieces = head.get(w)
                    if pieces is None:
                        uid.append(u), word.append(w), freq.append(k), known.append(None)
                    else:
                        n += k * pieces
                uid.append(u), word.append(None), freq.append(None), known.append(n)
                if len(uid) > 200_000:
                    yield full()
                    uid, word, freq, known = [], [], [], []
            yield full()

    return run


def count_tokens(docs: DataFrame, path: str, pattern: str, limit: int = 512, head: int = HEAD) -> DataFrame:
    """One row per row of docs(doc_id, text): doc_id, n_bytes, n_tokens, over_limit (n_tokens > limit).

    Null texts are empty: 0 bytes, 0 tokens. Special strings inside texts count as the library counts them, one token
    each. Repeated doc_ids are counted apart, row by row. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    specials = special_tokens(path)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    total = rows.count()
    share = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30)) < int(min(1.0, HEAD_DOCS / max(total, 1)) * (1 << 30))
    frequent = (
        rows.where(share).select("text").mapInArrow(_frequent(pattern, specials), "word string, n long")
        .groupBy("word").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "word").limit(head).select("word")
    )
    known = frequent.repartition(8).mapInArrow(_pieces(path), "word string, pieces long").toArrow()
    lookup = dict(zip(known["word"].to_pylist(), known["pieces"].to_pylist()))
    shared = spark.sparkContext.broadcast(lookup)
    # a row's number is fixed by its place in the files, so a task that runs again gives the same
    numbered = rows.withColumn("uid", F.monotonically_increasing_id())
    n_bytes = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")
    read = numbered.select("uid", "text", "doc_id", n_bytes.alias("n_bytes"))
    found = stored(
        read.mapInArrow(_with_document(_frequencies(pattern, specials, shared)), "uid long, word string, freq int, known long, doc_id long, n_bytes long")
    )
    rare = found.where("word is not null").select("uid", "word", "freq")
    pieces = rare.select("word").distinct().mapInArrow(_pieces(path), "word string, pieces long")
    counted = rare.join(pieces, "word").groupBy("uid").agg(F.sum(F.col("freq") * F.col("pieces")).alias("rest"))
    out = found.where("word is null").select("uid", "doc_id", "n_bytes", "known").join(counted, "uid", "left")
    n = F.col("known") + F.coalesce("rest", F.lit(0))
    return out.select("doc_id", "n_bytes", n.alias("n_tokens"), (n > limit).alias("over_limit"))


def _with_document(frequencies):
    """Adds doc_id and n_bytes to the row that closes each document."""

    def run(batches):
        for batch in batches:
            docs = dict(zip(batch.column(0).to_pylist(), zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())))
            for out in frequencies([batch.select([0, 1])]):
                last = [docs[u] if w is None else (None, None) for u, w in zip(out.column(0).to_pylist(), out.column(1).to_pylist())]
                yield pa.RecordBatch.from_arrays(
                    [*out.columns, pa.array([x[0] for x in last], pa.int64()), pa.array([x[1] for x in last], pa.int64())],
                    [*out.schema.names, "doc_id", "n_bytes"],
                )

    return run


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document by byte_bpe_50k.json."""
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return count_tokens(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)


QUERIES = {"op3_token_counts": op3_token_counts}
