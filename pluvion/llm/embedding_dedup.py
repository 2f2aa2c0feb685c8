"""Near-duplicate embeddings by cross-polytope hashing after fast Hadamard rotations, with multiprobe and verification.

A table hashes a vector by two independent pseudo-random rotations (three rounds of random signs and a Hadamard
transform); each gives the nearest signed axis. A vector is indexed in its own bucket of every table and probes the
buckets next best by the gap of its coordinates. A pair that meets in several tables counts in the first only, which
the carried buckets and probes of both sides decide, so links are counted where they are found and no pair is shuffled.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.components import connected_components, stored
from .common import group_bounds, grouped_pairs, local_components, table, valid_vector, whole_groups

#: Index rows of one bucket that a task compares at once; larger buckets are cut into blocks that meet pairwise.
BLOCK = 1024


def _hadamard(x: np.ndarray) -> np.ndarray:
    """The Hadamard transform of each row; the width is a power of two."""
    n, d = x.shape
    h = 1
    while h < d:
        x = x.reshape(n, d // (2 * h), 2, h)
        x = np.stack([x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]], axis=2).reshape(n, d)
        h *= 2
    return x


def cross_polytope(x: np.ndarray, tables: int, probes: int, seed: int = 7) -> np.ndarray:
    """int32 [rows, tables, probes]: the buckets of each unit vector, its own first, then the next best.

    Axis and sign of the largest coordinate of two rotations name a bucket; a probe replaces the axis in one or both of
    them by a runner-up, ranked by the sum of squared gaps to the largest.
    """
    n, d = x.shape
    wide = max(2, 1 << (d - 1).bit_length())
    padded = np.zeros((n, wide))
    padded[:, :d] = x
    rng = np.random.default_rng(seed + d)
    out = np.empty((n, tables, probes), dtype=np.int32)
    best = min(4, wide)
    for t in range(tables):
        axes, gaps = [], []
        for _ in range(2):
            y = padded
            for _ in range(3):
                y = _hadamard(y * rng.choice([-1.0, 1.0], wide)) / np.sqrt(wide)
            order = np.argpartition(-np.abs(y), best - 1, axis=1)[:, :best]
            value = np.take_along_axis(y, order, 1)
            rank = np.argsort(-np.abs(value), axis=1, kind="stable")
            order, value = np.take_along_axis(order, rank, 1), np.take_along_axis(value, rank, 1)
            axes.append(2 * order + (value < 0))
            gaps.append((np.abs(value[:, :1]) - np.abs(value)) ** 2)
        cost = (gaps[0][:, :, None] + gaps[1][:, None, :]).reshape(n, -1)
        names = (axes[0][:, :, None] * (2 * wide) + axes[1][:, None, :]).reshape(n, -1)
        rank = np.argsort(cost, axis=1, kind="stable")[:, :probes]
        out[:, t, : rank.shape[1]] = np.take_along_axis(names, rank, 1)
        out[:, t, rank.shape[1] :] = -1
    return out


def _bucket_rows(tables: int, probes: int, index_only: bool):
    def run(batches):
        for batch in batches:
            ids, labels, times = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 2, 3))
            vectors = batch.column(1)
            sizes = np.diff(vectors.offsets.to_numpy())
            for d in np.unique(sizes):
                which = np.flatnonzero(sizes == d)
                part = vectors.take(pa.array(which))
                x = part.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(which), d)
                # dividing by the largest component first keeps squares finite
                unit = x / np.abs(x).max(axis=1, keepdims=True)
                unit /= np.linalg.norm(unit, axis=1, keepdims=True)
                for s in range(0, len(which), 512):
                    rows = which[s : s + 512]
                    b = cross_polytope(unit[s : s + 512], tables, probes)
                    n = len(rows)
                    used = 1 if index_only else probes
                    who = np.repeat(np.arange(n), tables * used)
                    key = b[:, :, :used].reshape(-1).astype(np.int64)
                    which_t = np.tile(np.repeat(np.arange(tables), used), n)
                    indexed = np.tile(np.arange(used) == 0, n * tables)
                    keep = key >= 0
                    who, key, which_t, indexed = who[keep], key[keep], which_t[keep], indexed[keep]
                    cols = [pa.array(labels[rows][who]), pa.array(np.full(len(who), d, dtype=np.int32)), pa.array(which_t.astype(np.int32)), pa.array(key)]
                    names = ["label", "dim", "tab", "bucket"]
                    if not index_only:
                        small = x[s : s + 512].astype(np.float32)
                        exact = (small == x[s : s + 512]).all()  # single precision travels where it loses nothing
                        raw = [v.tobytes() for v in (small if exact else x[s : s + 512])]
                        own = [v.tobytes() for v in b]
                        cols += [pa.array(indexed), pa.array(ids[rows][who]), pa.array(times[rows][who])]
                        cols += [pa.array([raw[k] for k in who], pa.binary()), pa.array([own[k] for k in who], pa.binary())]
                        names += ["indexed", "rep", "times", "vec", "probes"]
                    yield pa.RecordBatch.from_arrays(cols, names)

    return run


def _link(tables: int, probes: int, cosine: float):
    def run(batches):
        for t in whole_groups(batches, ["label", "gkey", "cell"]):
            label, gkey, cell, side, rep, times, tab, dim, indexed = (
                t[c].to_numpy() for c in ("label", "gkey", "cell", "side", "rep", "times", "tab", "dim", "indexed")
            )
            bounds = group_bounds(label, gkey, cell)
            begin = bounds[:-1]
            raw, own = t["vec"].to_pylist(), t["probes"].to_pylist()
            links_id, links_n, ends_a, ends_b = [], [], [], []
            for d in np.unique(dim[begin]):
                these = np.flatnonzero(dim[begin] == d)
                rows = np.concatenate([np.arange(bounds[g], bounds[g + 1]) for g in these])
                sizes = bounds[these + 1] - bounds[these]
                at = np.concatenate([[0], np.cumsum(sizes)])
                x = np.stack([np.frombuffer(raw[r], dtype=np.float64 if len(raw[r]) == 8 * d else np.float32) for r in rows])
                x = x.astype(np.float64)
                b = np.frombuffer(b"".join(own[r] for r in rows), dtype=np.int32).reshape(len(rows), tables, probes)
                big = np.abs(x).max(axis=1, keepdims=True)
                norm = np.linalg.norm(x / big, axis=1)
                unit = x / big / norm[:, None]
                sd = side[rows]
                left_n = np.add.reduceat(sd < 2, at[:-1], dtype=np.int64)
                right_n = np.add.reduceat(sd > 0, at[:-1], dtype=np.int64)
                r, mult, tb = rep[rows], times[rows], tab[rows]
                for i, j in grouped_pairs(left_n, right_n, at[:-1], at[1:] - right_n, 1 << 15):
                    near = (np.einsum("ij,ij->i", unit[i], unit[j]) >= cosine) & (r[i] != r[j])
                    i, j = i[near], j[near]
                    if not len(i):
                        continue
                    # the first meeting: the lowest table, and there own with own, else the smaller id's probe
                    i_in_j = (b[i, :, :1] == b[j]).any(axis=2)
                    j_in_i = (b[j, :, :1] == b[i]).any(axis=2)
                    same = b[i, :, 0] == b[j, :, 0]
                    first = np.argmax(i_in_j | j_in_i, axis=1)
                    k, now = np.arange(len(i)), tb[i]
                    both_own = same[k, first]
                    probed = j_in_i[k, first] & ((r[i] < r[j]) | ~i_in_j[k, first])
                    is_own = indexed[rows][i]
                    count = (first == now) & np.where(both_own, is_own & (r[i] < r[j]), ~is_own & probed)
                    i, j = i[count], j[count]
                    links_id += [r[i], r[j]]
                    links_n += [mult[j], mult[i]]
                    ends_a.append(r[i]), ends_b.append(r[j])
            if not links_id:
                continue
            ids, at = np.unique(np.concatenate(links_id), return_inverse=True)
            n = np.zeros(len(ids), dtype=np.int64)
            np.add.at(n, at, np.concatenate(links_n))
            nodes, root = local_components(np.concatenate(ends_a), np.concatenate(ends_b))
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(n), pa.array(root[np.searchsorted(nodes, ids)])], ["rep", "n", "root"])

    return run


def embedding_links(
    vectors: DataFrame, id_col: str, vec_col: str, label_col: str, cosine: float = 0.93, tables: int = 6, probes: int = 4
) -> DataFrame:
    """One row per vector: id, n_links, component_id, kept.

    Vectors of equal, non-null label and equal length link at `cosine` or more (in double precision). Equal vectors of a
    label form one class that is hashed once; its members link to one another and to all that the class links to. Classes go
    by a written row number, so rows of one id are vectors of their own, within a label and across labels; a component takes
    the smallest id of its classes. Null, zero and non-finite vectors, and those without a label, link with nothing and are
    their own component. Whole-number labels are compared as they are, labels of other types by a 64-bit hash. A null id is
    a component's id only where all are null. An empty table gives an empty result; other columns are not read.
    """
    whole_label = vectors.schema[label_col].dataType.simpleString() in ("tinyint", "smallint", "int", "bigint")
    label = F.col(label_col).cast("long") if whole_label else F.when(F.col(label_col).isNotNull(), F.xxhash64(label_col))
    rows = vectors.select(
        F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).alias("vec"), label.alias("label"),
        (F.col(label_col).isNotNull() & valid_vector(F.col(vec_col))).alias("ok"),
    )
    classes = (
        rows.where("ok").groupBy("label", "vec").agg(F.min("vec_id").alias("least"), F.count("*").alias("times"))
    )
    classes = stored(classes.withColumn("rep", F.monotonically_increasing_id()).select("rep", "vec", "label", "times", "least"))
    schema = "label long, dim int, tab int, bucket long"
    placed = classes.mapInArrow(
        _bucket_rows(tables, probes, False), schema + ", indexed boolean, rep long, times long, vec binary, probes binary"
    )
    key = ["label", "dim", "tab", "bucket"]
    crowded = (
        classes.mapInArrow(_bucket_rows(tables, 1, True), schema)
        .groupBy(*key).agg(F.count("*").alias("n")).where(F.col("n") > BLOCK)
        .select(*key, F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
    )
    placed = placed.join(crowded, key, "left")
    block = F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")
    every = F.sequence(F.lit(0), F.col("blocks") - 1)
    one = F.array(F.struct(F.lit(0).alias("cell"), F.when(F.col("indexed"), 1).otherwise(0).alias("side")))
    lefts = F.transform(every, lambda k: F.struct((block * F.col("blocks") + k).alias("cell"), F.lit(0).alias("side")))
    rights = F.transform(every, lambda k: F.struct((k * F.col("blocks") + block).alias("cell"), F.lit(2).alias("side")))
    place = F.when(F.col("blocks").isNull(), one).when(F.col("indexed"), F.concat(lefts, rights)).otherwise(lefts)
    whole = F.shiftleft(F.col("dim").cast("long"), 40) + F.shiftleft(F.col("tab").cast("long"), 32) + F.col("bucket")
    cells = placed.select(
        "label", whole.alias("gkey"), "dim", "tab", "indexed", "rep", "times", "vec", "probes", F.inline(place)
    )
    found = stored(
        cells.repartition("label", "gkey", "cell")
        .sortWithinPartitions("label", "gkey", "cell", "side")
        .select("label", "gkey", "cell", "side", "dim", "tab", "indexed", "rep", "times", "vec", "probes")
        .mapInArrow(_link(tables, probes, cosine), "rep long, n long, root long")
    )
    counts = found.groupBy("rep").agg(F.sum("n").alias("n"))
    comps = stored(connected_components(found.select(F.col("rep").alias("src"), F.col("root").alias("dst"))))
    own = comps.select(F.col("node").alias("rep"), "component").join(classes.select("rep", "least"), "rep")
    names = own.groupBy("component").agg(F.min("least").alias("name"))
    named = own.join(names, "component").select("rep", "name")
    known = (
        classes.select("rep", "label", "vec", "times", "least")
        .join(counts, "rep", "left")
        .join(named, "rep", "left")
        .select(
            "label", "vec", (F.coalesce("n", F.lit(0)) + F.col("times") - 1).alias("n_links"),
            F.coalesce("name", "least").alias("component_id"),
        )
    )
    linked = rows.where("ok").join(known, ["label", "vec"], "left")
    alone = rows.where("not ok").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    out = linked.select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id")
    ).unionByName(alone)
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def op8_cross_polytope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of all embeddings of equal label at a cosine of 0.93 or more."""
    return embedding_links(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", "label")


QUERIES = {"op8_cross_polytope": op8_cross_polytope}
