"""Language identification by prediction by partial matching (PPM).

For each language, byte contexts of up to ORDER bytes hold how often each next byte followed them in training. A byte's
code length in a context is -log2(count / (total + distinct)) if it was seen there; else the escape's length
-log2(distinct / (total + distinct)) plus its length in the next shorter context, down to 8 bits for any byte (a context
never seen costs nothing to leave). Statistics are frozen after training, so each byte's exact length for all languages
is one table row, and a text's length is a sum. The shortest code wins.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, utf8, with_fields

ORDER = 4
#: Bytes of training text a language, about (a hashed share of its distinct texts), and of all languages together.
TRAIN_BYTES, ALL_BYTES = 1_400_000, 12_000_000


def _grams(text: np.ndarray, order: int) -> np.ndarray:
    """int64 of each position: a marker bit above the order+1 bytes that end there, earliest first."""
    n = len(text) - order
    if n <= 0:
        return np.empty(0, dtype=np.int64)
    g = np.ones(n, dtype=np.int64)
    for k in range(order + 1):
        g = (g << 8) | text[k : k + n]
    return g


def _count(order: int):
    def run(batches):
        for batch in batches:
            langs = np.array(batch.column(0).to_pylist())
            texts = utf8(batch.column(1))
            for lang in np.unique(langs):
                mine = [np.frombuffer(texts[i], dtype=np.uint8) for i in np.flatnonzero(langs == lang)]
                for k in range(order + 1):
                    g, n = np.unique(np.concatenate([_grams(t, k) for t in mine]), return_counts=True)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([str(lang)] * len(g), pa.string()), pa.array(g), pa.array(n.astype(np.int64))], ["lang", "gram", "n"]
                    )

    return run


class Table:
    """Rows of float32 by int64 key, found in a hash table of numpy arrays."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.bits = max(4, int(len(keys) * 3).bit_length())
        self.slots = np.full(1 << self.bits, -1, dtype=np.int32)
        self.keys, self.values, self.probes = keys, values, 0
        left = np.arange(len(keys), dtype=np.int32)
        while len(left):
            at = self._slot(keys[left], self.probes)
            free = self.slots[at] < 0
            self.slots[at[free]] = left[free]
            left = left[self.slots[at] != left]
            self.probes += 1

    def _slot(self, keys: np.ndarray, probe: int) -> np.ndarray:
        mixed = keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.bits)
        return (mixed + np.uint64(probe * (probe + 1) // 2)) & np.uint64((1 << self.bits) - 1)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The row of each key, -1 where it has none."""
        if not len(self.keys):
            return np.full(len(keys), -1, dtype=np.int32)
        row = self.slots[self._slot(keys, 0)]
        miss = np.flatnonzero((row >= 0) & (self.keys[row] != keys))
        for probe in range(1, self.probes):
            if not len(miss):
                return row
            row[miss] = self.slots[self._slot(keys[miss], probe)]
            miss = miss[(row[miss] >= 0) & (self.keys[row[miss]] != keys[miss])]
        row[miss] = -1
        return row


class Model:
    """Code lengths of every seen byte and escape, per language, from counts(lang, gram, n)."""

    def __init__(self, langs: list[str], lang: np.ndarray, gram: np.ndarray, n: np.ndarray, order: int):
        self.langs, self.order = langs, order
        level = np.zeros(len(gram), dtype=np.int64)
        for k in range(1, order + 1):
            level[gram >= 1 << (8 * (k + 1))] = k
        self.length: list[Table] = []
        self.escape: list[Table] = []
        for k in range(order + 1):
            g, at = np.unique(gram[level == k], return_inverse=True)
            count = np.zeros((len(g), len(langs)))
            count[at, lang[level == k]] = n[level == k]
            c, of = np.unique(g >> 8, return_inverse=True)
            total = np.zeros((len(c), len(langs)))
            kinds = np.zeros_like(total)
            np.add.at(total, of, count)
            np.add.at(kinds, of, count > 0)
            seen = total > 0
            leave = np.where(seen, np.log2(np.where(seen, total + kinds, 1) / np.where(seen, kinds, 1)), 0.0)
            shorter = self._below(g, k)
            here = np.log2(np.where(count > 0, (total + kinds)[of] / np.maximum(count, 1), 1))
            self.length.append(Table(g, np.where(count > 0, here, leave[of] + shorter).astype(np.float32)))
            self.escape.append(Table(c, leave.astype(np.float32)))

    def _below(self, gram: np.ndarray, order: int) -> np.ndarray:
        """Lengths of the last byte in the contexts shorter than `order`."""
        total = np.zeros((len(gram), len(self.langs)), dtype=np.float64)
        left = np.arange(len(gram))
        for k in range(order - 1, -1, -1):
            if not len(left):
                return total
            g = (gram[left] & ((1 << (8 * (k + 1))) - 1)) | (1 << (8 * (k + 1)))
            row = self.length[k].find(g)
            hit = row >= 0
            total[left[hit]] += self.length[k].values[row[hit]]
            left, g = left[~hit], g[~hit]
            row = self.escape[k].find(g >> 8)
            hit = row >= 0
            total[left[hit]] += self.escape[k].values[row[hit]]
        total[left] += 8.0
        return total

    def lengths(self, text: np.ndarray) -> np.ndarray:
        """[bytes, languages]: the code length in bits of each byte of one text."""
        out = np.zeros((len(text), len(self.langs)), dtype=np.float32)
        for i in range(min(self.order, len(text))):  # the first bytes have shorter contexts
            out[i] = self._below(_grams(text[: i + 1], i), i + 1)[0]
        g = _grams(text, self.order)
        row = self.length[self.order].find(g)
        hit = row >= 0
        tail = out[self.order :]
        tail[hit] = self.length[self.order].values[row[hit]]
        left = np.flatnonzero(~hit)
        row = self.escape[self.order].find(g[left] >> 8)
        hit = row >= 0
        tail[left[hit]] = self.escape[self.order].values[row[hit]]
        tail[left] += self._below(g[left], self.order)
        return out


def _score(shared, step: int = 1 << 20):
    def run(batches):
        model = shared.value
        for batch in batches:
            texts = utf8(batch.column(0))
            bits = np.zeros((len(texts), len(model.langs)))
            for i, text in enumerate(texts):
                raw = np.frombuffer(text, dtype=np.uint8)
                # a long text is scored in overlapping pieces, so that memory stays bounded
                for s in range(0, len(raw), step):
                    ahead = min(s, model.order)
                    bits[i] += model.lengths(raw[s - ahead : s + step])[ahead:].sum(axis=0, dtype=np.float64)
            best = bits.argmin(axis=1)
            gap = np.exp2(np.maximum(bits[np.arange(len(best)), best][:, None] - bits, -1000.0)).sum(axis=1)
            size = np.array([max(len(t), 1) for t in texts])
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array([model.langs[k] for k in best], pa.string()), pa.array(1 / gap),
                 pa.array(bits[np.arange(len(best)), best] / size)],
                [*batch.schema.names, "lang", "score", "bits"],
            )

    return run


def train(labelled: DataFrame, order: int = ORDER, train_bytes: int = TRAIN_BYTES) -> Model | None:
    """A model from labelled(text, lang), or None without a usable row.

    Of the distinct texts of each language about train_bytes are used (less where ALL_BYTES would not suffice for all
    languages), chosen by a hash of the text, one at least; so the statistics that reach the driver are bounded whatever
    the table's size, every language is learned, and copies count once. Null or empty texts and null languages are left
    out; ties of the hash are all used. The model takes four bytes for each context seen and language.
    """
    draw = F.pmod(F.xxhash64("text"), F.lit(1 << 30))
    usable = labelled.where("text <> '' and lang is not null").select("lang", "text", draw.alias("draw"))
    distinct = usable.groupBy("lang", F.xxhash64("text", F.lit(1)).alias("key")).agg(F.max(F.octet_length("text")).alias("n"), F.min("draw").alias("draw"))
    sizes = distinct.groupBy("lang").agg(F.sum("n").alias("n"), F.min("draw").alias("least")).collect()  # a row a language
    if not sizes:
        return None
    each = min(train_bytes, ALL_BYTES // len(sizes))
    most = usable.sparkSession.createDataFrame([(r.lang, max(int(min(1.0, each / r.n) * (1 << 30)), r.least)) for r in sizes], "lang string, most long")
    chosen = usable.join(F.broadcast(most), "lang").where("draw <= most").select("lang", "text").dropDuplicates()
    counts = chosen.mapInArrow(_count(order), "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    got = counts.toArrow()
    langs = sorted(set(got["lang"].to_pylist()))
    at = np.searchsorted(np.array(langs), np.array(got["lang"].to_pylist()))
    return Model(langs, at, got["gram"].to_numpy(), got["n"].to_numpy(), order)


def identify(docs: DataFrame, model: Model | None) -> DataFrame:
    """docs with lang_pred, score (the winner's share of 2^-bits, 0 to 1) and bits_per_byte.

    lang_pred is `und` (score 0, bits null) where the text is null or has no letter, and everywhere if nothing was
    learned. Ties go to the language first in order. A very long text is scored in pieces, whole. Columns of docs with
    these names are replaced, all others stay whatever their names. Rows repeat as they do in docs; an empty table gives an
    empty result.
    """
    docs = docs.drop("lang_pred", "score", "bits_per_byte")
    letters = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    if model is None:
        return docs.select("*", F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(None).cast("double").alias("bits_per_byte"))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    first = docs.select("text", letters.alias("letters"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    scored = first.mapInArrow(_score(shared), with_fields(first, "lang string, score double, bits double"))
    return scored.select(
        "row.*",
        F.when(F.col("letters"), F.col("lang")).otherwise("und").alias("lang_pred"),
        F.when(F.col("letters"), F.col("score")).otherwise(0.0).alias("score"),
        F.when(F.col("letters"), F.col("bits")).alias("bits_per_byte"),
    )


def fold(c):
    return F.crc32(c.cast("string").cast("binary")) % 5


def op1_ppm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learned from those whose crc32(doc_id) mod 5 is not 0."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = F.coalesce(fold(F.col("doc_id")) == 0, F.lit(False))
    model = train(docs.where(~held_out).select("text", "lang"))
    out = identify(docs.select("doc_id", "text", held_out.alias("held_out")), model)
    return out.select("doc_id", "held_out", "lang_pred", "score", "bits_per_byte")


QUERIES = {"op1_ppm": op1_ppm}
