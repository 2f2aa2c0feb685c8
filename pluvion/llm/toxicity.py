"""Toxicity by cumulative-link ordinal regression on sparse text features.

P(grade <= k) = sigmoid(theta_k - w.x): one weight vector w for all ordered thresholds theta. The output is the expected
severity, the sum over k of P(grade > k). Features are log(1 + count) of lower-cased words and of their prefixes, by
their hashes.
"""

from __future__ import annotations

from array import array
from collections import Counter

import numpy as np
import pyarrow as pa
import regex
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.components import stored
from .common import table, with_fields

#: Labelled documents that the model is fitted on at most, about (a hashed share).
TRAIN_DOCS = 12_000
#: A feature is used if this many sample documents have it.
MIN_DOCS = 8
#: Entries of the sample that the fit computes with at a time (sets its memory, not the result).
BLOCK = 1 << 18
PREFIXES = (5, 7)
WORD = regex.compile(r"\p{L}[\p{L}\p{M}\p{N}]*")


def features_of(word: str) -> list[int]:
    """The features of a word, as 63-bit hashes: itself (odd) and its prefixes (even)."""
    digest = xxhash.xxh64_intdigest
    own = digest(word) >> 1 | 1
    return [own, *(digest(word[:k], 1) >> 1 & ~1 for k in PREFIXES if len(word) > k)]


def _document_features(batches):
    for batch in batches:
        names, counts = [], []
        for text in batch.column(1).to_pylist():
            got: dict = {}
            for word, n in Counter(WORD.findall((text or "").lower())).items():
                for f in features_of(word):
                    got[f] = got.get(f, 0) + n
            names.append(list(got)), counts.append(list(got.values()))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(names, pa.list_(pa.int64())), pa.array(counts, pa.list_(pa.int32()))], ["grade", "names", "counts"]
        )


def _packed(shared):
    """Each document's grade, and its used features' codes and counts, packed: few bytes reach the driver."""

    def run(batches):
        terms, pack = shared.value, zstandard.ZstdCompressor(level=3).compress
        for batch in batches:
            sizes, bodies = [], []
            for names, counts in zip(batch.column(1), batch.column(2)):
                names, counts = names.values.to_numpy(), counts.values.to_numpy()
                at = np.minimum(np.searchsorted(terms, names), max(len(terms) - 1, 0))
                used = terms[at] == names if len(terms) else np.zeros(len(names), dtype=bool)
                order = np.argsort(at[used])
                both = np.concatenate([np.diff(at[used][order], prepend=0), counts[used][order]]).astype("<u4")
                sizes.append(len(both) // 2)
                bodies.append(pack(both.view(np.uint8).reshape(-1, 4).T.tobytes()))  # bytes of one weight pack well
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int32()), pa.array(bodies, pa.binary())], ["grade", "n", "body"])

    return run


class Features:
    """The model's features of words, as flat arrays; words seen before are remembered, KEEP of them at most."""

    KEEP = 1 << 18

    def __init__(self, index: dict[int, int]):
        self.index, self.at = index, {}
        self.flat, self.ends = array("i"), array("i", [0])

    def of(self, words: list[str]) -> list[int]:
        got = list(map(self.at.get, words))
        if None in got:
            for i, k in enumerate(got):
                if k is None:
                    self.flat.extend(self.index[x] for x in features_of(words[i]) if x in self.index)
                    self.ends.append(len(self.flat))
                    got[i] = self.at[words[i]] = len(self.ends) - 2
        return got

    def forget(self) -> None:
        if len(self.at) > self.KEEP:
            self.__init__(self.index)


class OrdinalModel:
    def __init__(self, index: dict[int, int], weights: np.ndarray, cuts: np.ndarray):
        self.index, self.weights, self.cuts = index, weights, cuts

    def scores(self, texts: list[str | None], features: Features) -> np.ndarray:
        """The sum over features of weight x log(1 + count), of each text."""
        words, counts, sizes = [], [], []
        for text in texts:
            found = Counter(WORD.findall(text.lower())) if text else {}
            words += found
            counts += found.values()
            sizes.append(len(found))
        ends = features.of(words)
        flat, end = np.frombuffer(features.flat, dtype=np.intc), np.frombuffer(features.ends, dtype=np.intc)
        at = np.array(ends, dtype=np.int64)
        n = (end[at + 1] - end[at]).astype(np.int64)
        start = np.repeat(end[at].astype(np.int64) - (np.cumsum(n) - n), n)
        feature = flat[start + np.arange(n.sum())].astype(np.int64)
        row = np.repeat(np.repeat(np.arange(len(texts)), sizes), n)
        pair, where = np.unique(row * len(self.weights) + feature, return_inverse=True)  # words share prefixes
        total = np.bincount(where, weights=np.repeat(np.array(counts, dtype=np.float64), n), minlength=len(pair))
        return np.bincount(pair // len(self.weights), weights=self.weights[pair % len(self.weights)] * np.log1p(total), minlength=len(texts))

    def probabilities(self, score: np.ndarray) -> np.ndarray:
        """[rows, thresholds]: P(grade > k)."""
        return 1 / (1 + np.exp(np.clip(self.cuts[None, :] - score[:, None], -50, 50)))


def cuts_of(raw: np.ndarray) -> np.ndarray:
    """Ordered thresholds: the first, and positive steps from there."""
    return raw[0] + np.concatenate([[0.0], np.cumsum(np.exp(raw[1:]))])


def loss_and_gradient(w: np.ndarray, raw: np.ndarray, rows, cols, values, grades: np.ndarray, l2: float) -> tuple[float, np.ndarray]:
    """The negative log likelihood with a ridge on w, and its gradient by (w, raw)."""
    n, levels, cuts = len(grades), len(raw) + 1, cuts_of(raw)
    blocks = [slice(k, k + BLOCK) for k in range(0, len(rows), BLOCK)]
    s = np.zeros(n)
    for b in blocks:
        s += np.bincount(rows[b], weights=values[b] * w[cols[b]], minlength=n)
    edge = np.concatenate([[-np.inf], cuts, [np.inf]])
    hi, lo = edge[grades + 1] - s, edge[grades] - s
    p_hi, p_lo = 1 / (1 + np.exp(-np.clip(hi, -50, 50))), 1 / (1 + np.exp(-np.clip(lo, -50, 50)))
    p = np.maximum(p_hi - p_lo, 1e-12)
    d_hi, d_lo = p_hi * (1 - p_hi) / p, p_lo * (1 - p_lo) / p
    by_w, slope = l2 * w, d_hi - d_lo
    for b in blocks:
        by_w += np.bincount(cols[b], weights=values[b] * slope[rows[b]], minlength=len(w))
    by_cut = np.array([-(d_hi[grades == k].sum()) + d_lo[grades == k + 1].sum() for k in range(levels - 1)])
    tail = np.cumsum(by_cut[::-1])[::-1]
    return float(-np.log(p).sum() + l2 / 2 * (w**2).sum()), np.concatenate([by_w, tail[:1], tail[1:] * np.exp(raw[1:])])


def fit_ordinal(rows: np.ndarray, cols: np.ndarray, values: np.ndarray, grades: np.ndarray, width: int, l2: float = 2.0, steps: int = 120):
    """(weights, cuts) that minimise the cumulative-link loss with a ridge, by Adam on the whole sample."""
    n, levels = len(grades), int(grades.max()) + 1
    w = np.zeros(width)
    share = np.array([(grades <= k).mean() for k in range(levels - 1)])
    start = np.log(np.clip(share, 1e-4, 1 - 1e-4) / np.clip(1 - share, 1e-4, 1))
    raw = np.concatenate([start[:1], np.log(np.maximum(np.diff(start), 1e-2))])
    moments = [np.zeros(width + levels - 1), np.zeros(width + levels - 1)]
    for t in range(1, steps + 1):
        grad = loss_and_gradient(w, raw, rows, cols, values, grades, l2)[1] / n
        moments[0] = 0.9 * moments[0] + 0.1 * grad
        moments[1] = 0.999 * moments[1] + 0.001 * grad**2
        step = 0.1 * min(1.0, 3 * (1 - t / (steps + 1))) * (moments[0] / (1 - 0.9**t)) / (np.sqrt(moments[1] / (1 - 0.999**t)) + 1e-10)
        w, raw = w - step[:width], raw - step[width:]
    return w, cuts_of(raw)


def coded(got: pa.Table) -> tuple:
    """(codes, rows, counts) of the sample's packed features, in as few bytes as they need."""
    sizes, unpack = got["n"].to_numpy(), zstandard.ZstdDecompressor().decompress
    codes, counts = np.empty(sizes.sum(), dtype=np.int32), np.empty(sizes.sum(), dtype=np.int32)
    rows, at = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes), 0
    for body, n in zip(got["body"], sizes.tolist()):
        both = np.frombuffer(unpack(body.as_py()), dtype=np.uint8).reshape(4, -1).T.copy().view("<u4").ravel()
        codes[at : at + n], counts[at : at + n] = np.cumsum(both[:n]), both[n:]
        at += n
    return codes, rows, counts.astype(np.min_scalar_type(counts.max(initial=0)))


def fit_features(grades: np.ndarray, terms: np.ndarray, features: tuple) -> OrdinalModel | None:
    codes, rows, counts = features
    seen = np.unique(grades)
    if len(seen) < 2:
        return None
    values = np.log1p(counts, dtype=np.float32)
    w, cuts = fit_ordinal(rows, codes, values, np.searchsorted(seen, grades), max(len(terms), 1))
    return OrdinalModel({t: i for i, t in enumerate(terms.tolist())}, w, cuts)


def _score(shared):
    def run(batches):
        model = shared.value
        features = Features(model.index)
        for batch in batches:
            for s in range(0, batch.num_rows, 256):
                part = batch.slice(s, 256)
                texts = part.column(0).to_pylist()
                above = model.probabilities(model.scores(texts, features))
                above[[not t for t in texts]] = 0.0
                features.forget()
                yield pa.RecordBatch.from_arrays(
                    [part.column(1), pa.array(above.sum(axis=1)), pa.array((above > 0.5).sum(axis=1).astype(np.int32)), pa.array(above[:, 0])],
                    ["row", "severity", "grade", "p_toxic"],
                )

    return run


def grade_toxicity(docs: DataFrame, model: OrdinalModel | None) -> DataFrame:
    """docs with severity (expected grade), grade (thresholds passed at one half) and p_toxic (P(grade > 0)).

    A null or empty text, and every text if nothing was learned, gets severity 0, grade 0 and p_toxic 0; a very long text
    is scored whole like any other. A probability of exactly one half stays below its threshold. Columns of docs with
    these names are replaced, all others stay whatever their names. Rows repeat as they do in docs; an empty table gives an
    empty result.
    """
    docs = docs.drop("severity", "grade", "p_toxic")
    if model is None:
        return docs.select("*", F.lit(0.0).alias("severity"), F.lit(0).alias("grade"), F.lit(0.0).alias("p_toxic"))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    first = docs.select("text", F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    scored = first.mapInArrow(_score(shared), with_fields(first.select("row"), "severity double, grade int, p_toxic double"))
    return scored.select("row.*", "severity", "grade", "p_toxic")


#: Words that tell toxic from clean documents of the sample this surely (log odds) count as marks of severity.
MARK_ODDS, MARK_DOCS = 3.0, 8
#: Grade of a toxic document by its marks: 1 below the first bound, 2 below the second, else 3.
MARK_BOUNDS = (3, 6)


def severity_grades(toxic: np.ndarray, terms: np.ndarray, features: tuple) -> np.ndarray:
    """Ordered grades from two-valued labels: 0 if clean; toxic documents by how many marks of toxicity they hold.

    The labels tell only whether a document is toxic. So the step from 0 to 1 is learned from labels; those above order
    toxic documents by how much of the sample's toxic vocabulary they hold, not by any human judgement of severity. Marks are whole words whose presence in toxic documents of the
    sample, against clean ones, has log odds of MARK_ODDS or more.
    """
    codes, rows, counts = features
    blocks = [slice(k, k + BLOCK) for k in range(0, len(codes), BLOCK)]
    yes, no = np.zeros((2, len(terms)), dtype=np.int64)
    for b in blocks:
        with_it = toxic[rows[b]]
        yes += np.bincount(codes[b][with_it], minlength=len(terms))
        no += np.bincount(codes[b][~with_it], minlength=len(terms))
    odds = np.log((yes + 0.5) / (toxic.sum() + 1)) - np.log((no + 0.5) / ((~toxic).sum() + 1))
    mark = (yes >= MARK_DOCS) & (odds >= MARK_ODDS) & (terms & 1 == 1)
    hits = np.zeros(len(toxic))
    for b in blocks:
        hit = mark[codes[b]]
        hits += np.bincount(rows[b][hit], weights=counts[b][hit], minlength=len(toxic))
    return np.where(toxic, 1 + np.searchsorted(MARK_BOUNDS, hits, side="right"), 0).astype(np.int32)


def fit_from_labels(docs: DataFrame, labels: DataFrame, limit: int = TRAIN_DOCS) -> OrdinalModel | None:
    """A model of severity from labels(doc_id, toxic) of docs(doc_id, text); see severity_grades.

    About `limit` labelled ids are drawn by hash. Null labels and ids, and null or empty texts, are left out; an id with
    several labels counts as toxic if one says so; an id on several rows of docs gives one of its texts, that of the
    smallest hash. None if nothing is left, or only one kind of label.
    """
    share = F.pmod(F.xxhash64(F.col("doc_id"), F.lit(3)), F.lit(1 << 30))
    rate = min(1.0, limit / max(labels.count(), 1))
    drawn = labels.where("toxic is not null").where(share < int(rate * (1 << 30))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    # about `limit` rows, whatever the table's size
    marked = docs.where("text <> ''").select("doc_id", "text").join(F.broadcast(drawn), "doc_id")
    usable = marked.groupBy("doc_id", "toxic").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"))
    found = stored(
        usable.select(F.col("toxic").cast("int").alias("grade"), "text").mapInArrow(_document_features, "grade int, names array<long>, counts array<int>")
    )
    # rarer features are neither fitted nor (MARK_DOCS) marks, so they stay with the tasks
    often = found.select(F.explode("names").alias("name")).groupBy("name").agg(F.count("*").alias("n")).where(F.col("n") >= MIN_DOCS)
    terms = np.sort(often.select("name").toArrow()["name"].to_numpy())
    shared = docs.sparkSession.sparkContext.broadcast(terms)
    got = found.mapInArrow(_packed(shared), "grade int, n int, body binary").toArrow()
    if not got.num_rows:
        return None
    toxic, features = got["grade"].to_numpy() > 0, coded(got)
    del got
    model = fit_features(severity_grades(toxic, terms, features), terms, features)
    del features
    pa.default_memory_pool().release_unused()
    return model


def op4_ordinal_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected severity of every document; toxic if grade is above 0."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit_from_labels(docs, table(spark, sf_dir, "labels"))
    out = grade_toxicity(docs, model)
    return out.select("doc_id", "severity", "grade", "p_toxic", (F.col("grade") > 0).alias("toxic"))


QUERIES = {"op4_ordinal_toxicity": op4_ordinal_toxicity}
