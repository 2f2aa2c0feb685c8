"""Nearest neighbours by additive quantisation: a stated query set against all rows, in blocks.

A vector is a sum of M full-dimensional codewords, one of each codebook. Codebooks start as residual k-means and are
refitted together by least squares; codes come from a beam search. With the stored norm of the sum, the distance of a
query is read from a table of inner products. The best of each block by that estimate are ranked again by the exact
distance of the original vectors. Codebooks are fitted on a bounded sample; every row is encoded.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.components import stored
from .common import table, valid_vector

#: Rows at most, about, that the codebooks are fitted on (a hashed share of the table).
SAMPLE_ROWS = 8_192
BOOKS, WORDS, BEAM = 16, 128, 4
#: Vectors and queries of a block, queries scored at once; candidates of a block that are ranked exactly for each query.
VECTOR_BLOCK, QUERY_BLOCK, AT_ONCE, RERANK = 4096, 4096, 256, 160
#: For codes, vectors are scaled by the median of their largest components and cut off at this many times it.
FAR = 1e4
#: Shares of the vector blocks that one query block is sent to.
SLICES = 32


def _nearest(x: np.ndarray, words: np.ndarray) -> np.ndarray:
    return np.argmin((words**2).sum(1) - 2 * x @ words.T, axis=1)


def fit_codebooks(x: np.ndarray, books: int = BOOKS, words: int = WORDS, rounds: int = 2, seed: int = 11) -> np.ndarray:
    """float32 [books, words, d]."""
    rng = np.random.default_rng(seed)
    words = min(words, len(x))
    rest, out = x.astype(np.float64), []
    for _ in range(books):
        c = rest[rng.choice(len(x), words, replace=False)].copy()
        for _ in range(8):
            at = _nearest(rest, c)
            n = np.bincount(at, minlength=words)
            total = np.zeros_like(c)
            np.add.at(total, at, rest)
            c = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], c)
        rest = rest - c[_nearest(rest, c)]
        out.append(c)
    books_ = np.stack(out)
    for _ in range(rounds):
        codes = encode(x, books_, BEAM)
        hot = np.zeros((len(x), books * words), dtype=np.float32)
        hot[np.arange(len(x))[:, None], codes + words * np.arange(books)] = 1
        gram = (hot.T @ hot).astype(np.float64) + 1e-2 * np.eye(books * words)
        shift = (hot.T @ (x - books_[np.arange(books), codes].sum(1)).astype(np.float32)).astype(np.float64)
        books_ = books_ + np.linalg.solve(gram, shift).reshape(books_.shape)
    return books_.astype(np.float32)


def encode(x: np.ndarray, books: np.ndarray, beam: int = BEAM) -> np.ndarray:
    """uint8 or int64 [rows, books]: the codes of the least squared error that a beam search finds."""
    out = np.empty((len(x), len(books)), dtype=np.int64)
    for s in range(0, len(x), 2048):
        rows = x[s : s + 2048].astype(np.float32)
        codes = np.zeros((len(rows), 1, 0), dtype=np.int64)
        rest = rows[:, None, :]
        for book in books.astype(np.float32):
            err = (rest**2).sum(2)[:, :, None] + (book**2).sum(1) - 2 * rest @ book.T
            flat = err.reshape(len(rows), -1)
            k = min(beam, flat.shape[1])
            pick = np.argpartition(flat, k - 1, axis=1)[:, :k]
            pick = np.take_along_axis(pick, np.argsort(np.take_along_axis(flat, pick, 1), axis=1, kind="stable"), 1)
            parent, word = pick // len(book), pick % len(book)
            codes = np.concatenate([np.take_along_axis(codes, parent[:, :, None], 1), word[:, :, None]], axis=2)
            rest = np.take_along_axis(rest, parent[:, :, None], 1) - book[word]
        out[s : s + 2048] = codes[:, 0]
    return out


def _scaled(x: np.ndarray, scale: float) -> np.ndarray:
    """float32 rows divided by the scale, those with components above FAR brought down to it."""
    y = x / scale
    return (y * np.minimum(1.0, FAR / np.maximum(np.abs(y).max(axis=1, keepdims=True), 1e-300))).astype(np.float32)


def distances(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Euclidean distances along the last axis in double precision, without overflow or underflow of squares."""
    diff = x.astype(np.float64) - q.astype(np.float64)
    with np.errstate(over="ignore"):
        total = (diff**2).sum(-1)
    out = np.sqrt(total)
    odd = ~((total > 1e-290) & (total < 1e300))
    if odd.any():
        big = np.abs(diff[odd]).max(-1)
        with np.errstate(over="ignore", invalid="ignore", divide="ignore"):
            out[odd] = np.where(big > 0, np.sqrt(((diff[odd] / np.where(big > 0, big, 1)[:, None]) ** 2).sum(-1)) * big, 0.0)
    return out


def _blocks(books: np.ndarray, scale: float, kind: np.dtype):
    def run(batches):
        def pack(ids: np.ndarray, x: np.ndarray):
            order = np.argsort(ids, kind="stable")  # ties go to the smaller id
            ids, x = ids[order], x[order]
            codes = encode(_scaled(x, scale), books)
            norms = (books[np.arange(len(books)), codes].astype(np.float64).sum(1) ** 2).sum(1)
            row = [ids.tobytes(), codes.astype(np.uint8).tobytes(), norms.tobytes(), x.tobytes()]
            return pa.RecordBatch.from_arrays([pa.array([v], pa.binary()) for v in row], ["ids", "codes", "norms", "vecs"])

        ids, xs, have = [], [], 0
        for batch in batches:
            for s in range(0, batch.num_rows, VECTOR_BLOCK):
                part = batch.slice(s, VECTOR_BLOCK)
                ids.append(part.column(0).to_numpy(zero_copy_only=False).astype(np.int64))
                xs.append(part.column(1).flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(part.num_rows, -1))
                have += part.num_rows
                if have >= VECTOR_BLOCK:
                    yield pack(np.concatenate(ids), np.concatenate(xs))
                    ids, xs, have = [], [], 0
        if have:
            yield pack(np.concatenate(ids), np.concatenate(xs))

    return run


def _search(books: np.ndarray, scale: float, kind: np.dtype, k: int):
    m, _, d = books.shape

    def best(found: list) -> list:
        """The k nearest of each query row."""
        row, ids, dist = (np.concatenate(v) for v in zip(*found))
        order = np.lexsort((ids, dist, row))
        row, ids, dist = row[order], ids[order], dist[order]
        begin = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
        keep = np.arange(len(row)) - np.repeat(begin, np.diff(np.append(begin, len(row)))) < k
        return [(row[keep], ids[keep], dist[keep])]

    def run(batches):
        found: dict[int, list] = {}
        for batch in batches:
            for at in range(batch.num_rows):
                qblock = batch.column(0)[at].as_py()
                asked = batch.column(1)[at].values
                rows, vecs = asked.field(0).to_numpy(), asked.field(1).flatten().to_numpy(zero_copy_only=False).reshape(len(asked), d)
                ids, codes, norms, x = (np.frombuffer(batch.column(2 + j)[at].as_buffer(), dtype=t) for j, t in enumerate((np.int64, np.uint8, np.float64, kind)))
                codes, x = codes.reshape(-1, m), x.reshape(-1, d)
                take = min(RERANK, len(ids))
                for s in range(0, len(rows), AT_ONCE):
                    row, q = rows[s : s + AT_ONCE], vecs[s : s + AT_ONCE]
                    tables = np.einsum("qd,mwd->mqw", _scaled(q, scale), books)
                    estimate = np.tile(norms.astype(np.float32), (len(q), 1))
                    for j in range(m):
                        estimate -= 2 * tables[j][:, codes[:, j]]
                    # rows lie in id order, so the smaller ids of equal estimates come first
                    near = np.argpartition(estimate, take - 1, axis=1)[:, :take] if take < len(ids) else np.tile(np.arange(len(ids)), (len(q), 1))
                    if take < len(ids):
                        edge = np.take_along_axis(estimate, near, 1).max(axis=1)
                        tied = (estimate == edge[:, None]).sum(axis=1) > (np.take_along_axis(estimate, near, 1) == edge[:, None]).sum(axis=1)
                        for i in np.flatnonzero(tied):
                            near[i] = np.argsort(estimate[i], kind="stable")[:take]
                    exact = np.concatenate([distances(x[near[i : i + 32]], q[i : i + 32, None, :]) for i in range(0, len(q), 32)])
                    rank = np.lexsort((ids[near], exact), axis=1)[:, :k]
                    dist = np.take_along_axis(exact, rank, 1)
                    who = ids[np.take_along_axis(near, rank, 1)]
                    found.setdefault(qblock, []).append((np.repeat(row, rank.shape[1]), who.ravel(), dist.ravel()))
                if len(found[qblock]) >= 64:
                    found[qblock] = best(found[qblock])
        for part in found.values():
            row, ids, dist = best(part)[0]
            yield pa.RecordBatch.from_arrays([pa.array(row), pa.array(ids), pa.array(dist)], ["row", "vec_id", "score"])

    return run


def nearest(vectors: DataFrame, id_col: str, vec_col: str, queries: DataFrame, k: int = 10) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest rows found for each row of queries(id_col, vec_col), rows of vectors.

    score is the Euclidean distance in double precision on the original vectors, infinite where a double can't hold it;
    ties go to the smaller id. A query's own row (one of its id and distance 0) is no candidate, but rows that repeat it
    are; a repeated query is answered for each of its rows. Null, zero and non-finite vectors and null ids take no part;
    vectors are compared with those of their own length. No valid vector gives an empty result. Other columns play no
    part. Queries go out in blocks of about QUERY_BLOCK, each to SLICES shares of the vector blocks, so neither side is
    held whole anywhere; each task returns few rows a query.
    """
    spark = vectors.sparkSession
    kind = vectors.schema[vec_col].dataType.elementType.simpleString()
    wide = "float" if kind == "float" else "double"  # single precision travels as it is
    cols = [F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast(f"array<{wide}>").alias("vec")]
    good = valid_vector(F.col(vec_col)) & F.col(id_col).isNotNull()
    rows = vectors.where(good).select(*cols)
    asked = stored(queries.where(good).select(F.monotonically_increasing_id().alias("row"), *cols))
    size = F.array_max(F.transform("vec", lambda x: F.abs(x.cast("double"))))
    lengths = rows.groupBy(F.size("vec").alias("d")).agg(F.count("*").alias("n"), F.percentile_approx(size, 0.5).alias("scale")).collect()
    out = None
    for d, n, scale in lengths:  # one, as a rule
        part = _nearest_of_length(rows.where(F.size("vec") == d), asked.where(F.size("vec") == d), d, n, scale, np.dtype(np.float32 if wide == "float" else np.float64), k)
        out = part if out is None else out.unionByName(part)
    if out is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    named = out.join(asked.select("row", F.col("vec_id").alias("query_id")), "row")
    own = (F.col("vec_id") == F.col("query_id")) & (F.col("score") == 0)
    first = Window.partitionBy("row", own).orderBy("score", "vec_id")
    others = named.withColumn("again", F.row_number().over(first)).where(~own | (F.col("again") > 1))
    order = Window.partitionBy("row").orderBy("score", "vec_id")
    top = others.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return top.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _nearest_of_length(rows: DataFrame, asked: DataFrame, d: int, n: int, scale: float, kind: np.dtype, k: int) -> DataFrame:
    """(row, vec_id, score): of each task, the k + 1 best for each query row."""
    share = F.pmod(F.xxhash64("vec_id", "vec"), F.lit(1 << 30)) < int(min(1.0, SAMPLE_ROWS / n) * (1 << 30))
    sample = rows.where(share).select("vec").limit(2 * SAMPLE_ROWS).toArrow().column("vec").combine_chunks()
    x = sample.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
    x = x if len(x) else np.array([r.vec for r in rows.select("vec").limit(WORDS).collect()])
    books = fit_codebooks(_scaled(x, scale))
    packed = rows.mapInArrow(_blocks(books, scale, kind), "ids binary, codes binary, norms binary, vecs binary")
    qblocks = max(1, -(-asked.count() // QUERY_BLOCK))
    slices = F.sequence(F.lit(0), F.lit(SLICES - 1))
    sent = (
        asked.groupBy(F.pmod(F.xxhash64("row"), F.lit(qblocks)).cast("int").alias("qblock"))
        .agg(F.collect_list(F.struct("row", "vec")).alias("queries"))
        .select("qblock", "queries", F.explode(slices).alias("slice"))
    )
    blocks = packed.select(
        "*", F.pmod(F.xxhash64("ids"), F.lit(SLICES)).cast("int").alias("slice"),
        F.explode(F.sequence(F.lit(0), F.lit(qblocks - 1))).alias("qblock"),
    )
    return (
        blocks.join(sent, ["qblock", "slice"])
        .select("qblock", "queries", "ids", "codes", "norms", "vecs")
        .mapInArrow(_search(books, scale, kind, k + 1), "row long, vec_id long, score double")
    )


def op2_additive_quantisation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 nearest of every embedding whose vec_id is divisible by 100."""
    rows = table(spark, sf_dir, "embeddings")
    return nearest(rows, "vec_id", "embedding", rows.where("vec_id % 100 = 0"), 10)


QUERIES = {"op2_additive_quantisation": op2_additive_quantisation}
