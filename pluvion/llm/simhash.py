"""Near-duplicate documents by SimHash fingerprints, searched by the generalised pigeonhole principle.

64 bits are split into m parts, bits that agree often together. Part i gets a threshold e_i (-1: unused) such that the
sum of e_i + 1 is one more than the allowed distance; then two fingerprints within that distance differ by at most e_i
in some part i. Thresholds, and m, come from dynamic programming on estimated candidate counts. Each fingerprint is
indexed under its value in every used part and probes the values within e_i; every meeting is verified.
"""

from __future__ import annotations

from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.components import connected_components, stored
from .common import group_bounds, grouped_pairs, local_components, table, utf8, whole_groups

#: Index rows of one value that a task compares at once; larger values are cut into blocks that meet pairwise.
BLOCK = 1024
#: Cost of a shuffled signature against that of a compared candidate pair.
ROW_COST = 20.0


def _fingerprints(words: int):
    def run(batches):
        digest = xxhash.xxh64_intdigest
        for batch in batches:
            ids, texts = batch.column(0), utf8(batch.column(1))
            out = np.zeros(len(texts), dtype=np.uint64)
            hashes: list[int] = []
            owner: list[int] = []
            start: list[int] = []

            def flush():
                if owner:
                    h = np.array(hashes, dtype="<u8")
                    bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
                    at = np.array(start)
                    n = np.diff(np.append(at, len(h)))
                    ones = np.add.reduceat(bits, at, axis=0, dtype=np.int32)
                    over = (2 * ones > n[:, None]).astype(np.uint8)
                    out[owner] = np.packbits(over, axis=1, bitorder="little").view("<u8").ravel()
                hashes.clear(), owner.clear(), start.clear()

            for i, text in enumerate(texts):
                w = text.lower().split()
                if not w:
                    continue
                owner.append(i)
                start.append(len(hashes))
                if len(w) <= words:
                    hashes.append(digest(b" ".join(w), 42))
                else:
                    joined = b" ".join(w)
                    ends = np.cumsum([len(x) + 1 for x in w])
                    begins = np.append(0, ends[:-words]).tolist()
                    hashes.extend([digest(joined[s:e], 42) for s, e in zip(begins, (ends[words - 1 :] - 1).tolist())])
                if len(hashes) > 60_000:
                    flush()
            flush()
            yield pa.RecordBatch.from_arrays([ids, pa.array(out.view(np.int64))], ["doc_id", "fp"])

    return run


def fingerprints(docs: DataFrame, words: int = 4) -> DataFrame:
    """(doc_id, fp): a signed long with bit b set if over half the shingles' XXH64 (seed 42) have it.

    Whole texts, A-Z lower-cased, words parted by ASCII white space, shingles of `words` words with repeats; a text of
    fewer words is one shingle, a null text or one without words has fingerprint zero.
    """
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_fingerprints(words), "doc_id long, fp long")


def _bit_products(batches):
    total = np.zeros((64, 64), dtype=np.int64)
    for batch in batches:
        v = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
        x = np.unpackbits(v.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
        total += np.rint(x.T @ x).astype(np.int64)
    i, j = np.nonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(j), pa.array(total[i, j])], ["i", "j", "c"])


def bit_statistics(fps: DataFrame) -> tuple[int, np.ndarray]:
    """The number of fingerprints, and how many have bits i and j both set: 64 x 64 sums over all rows."""
    sums = fps.select("fp").mapInArrow(_bit_products, "i long, j long, c long").groupBy("i", "j").agg(F.sum("c").alias("c"))
    together = np.zeros((64, 64))
    for i, j, c in sums.collect():  # at most 4,096 rows
        together[i, j] = c
    return fps.count(), together


def group_bits(n: int, together: np.ndarray, parts: int) -> list[list[int]]:
    """Bits in `parts` groups of nearly equal size; each group takes the bits most correlated with those it has."""
    p = np.diag(together) / max(n, 1)
    sd = np.sqrt(np.maximum(p * (1 - p), 1e-9))
    corr = np.abs((together / max(n, 1) - np.outer(p, p)) / np.outer(sd, sd))
    left, out = set(range(64)), []
    for k in range(parts):
        size = 64 // parts + (k < 64 % parts)
        group = [max(sorted(left), key=lambda b: corr[b, sorted(left)].sum())]
        left.remove(group[0])
        while len(group) < size:
            b = max(sorted(left), key=lambda b: corr[b, group].sum())
            group.append(b)
            left.remove(b)
        out.append(sorted(group))
    return out


def within(p: np.ndarray, most: int) -> np.ndarray:
    """Chance that two fingerprints differ in at most 0, 1, ... `most` of these bits."""
    dist = np.array([1.0])
    for q in 2 * p * (1 - p):
        dist = np.convolve(dist, [1 - q, q])
    return np.minimum(np.cumsum(np.append(dist, np.zeros(most + 1)))[: most + 1], 1.0)


def allocate(n: int, p: np.ndarray, groups: list[list[int]], distance: int) -> tuple[float, list[int]]:
    """Thresholds per group that cover `distance` at the least estimated cost, by dynamic programming."""

    def cost(group: list[int], e: int) -> float:
        if e < 0:
            return 0.0
        rows = 1 + sum(comb(len(group), k) for k in range(1, e + 1)) / 2
        return ROW_COST * n * rows + n * n / 2 * within(p[group], e)[-1]

    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for group in groups:
        grown: dict[int, tuple[float, list[int]]] = {}
        for have, (c, es) in best.items():
            for e in range(-1, min(3, distance + 1 - have)):
                if e + 1 + have <= distance + 1 and e <= len(group):
                    new = (c + cost(group, e), [*es, e])
                    if have + e + 1 not in grown or new < grown[have + e + 1]:
                        grown[have + e + 1] = new
        best = grown
    return best.get(distance + 1, (float("inf"), []))


def plan_parts(n: int, together: np.ndarray, distance: int) -> list[tuple[list[int], int]]:
    """(bits, threshold) of each used part, for the number of parts that costs least."""
    p = np.diag(together) / max(n, 1)
    plans = []
    for parts in range(2, distance + 2):
        groups = group_bits(n, together, parts)
        c, es = allocate(n, p, groups, distance)
        plans.append((c, [(g, e) for g, e in zip(groups, es) if e >= 0]))
    return min(plans, key=lambda x: x[0])[1]


def _signatures(plan: list[tuple[list[int], int]]):
    def run(batches):
        for batch in batches:
            v = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for part, (bits, e) in enumerate(plan):
                key = np.zeros(len(v), dtype=np.int64)
                for k, b in enumerate(bits):
                    key |= ((v >> np.uint64(b)) & np.uint64(1)).astype(np.int64) << k
                sigs, fps, index = [key], [v], [np.ones(len(v), dtype=bool)]
                for flips in (c for d in range(1, e + 1) for c in combinations(range(len(bits)), d)):
                    # of two values that differ in these bits, the one without the highest of them probes
                    low = (key >> flips[-1]) & 1 == 0
                    sigs.append(key[low] ^ sum(1 << f for f in flips))
                    fps.append(v[low])
                    index.append(np.zeros(int(low.sum()), dtype=bool))
                sig = np.concatenate(sigs) + (np.int64(part) << 40)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(sig), pa.array(np.concatenate(fps).view(np.int64)), pa.array(np.concatenate(index))],
                    ["sig", "fp", "indexed"],
                )

    return run


def _verify(distance: int):
    def run(batches):
        for t in whole_groups(batches, ["sig", "cell"]):
            sig, cell, fp, side = (t[c].to_numpy() for c in ("sig", "cell", "fp", "side"))
            bounds = group_bounds(sig, cell)
            # side 0: only left (probes), 1: both, 2: only right; rows of a group come sorted by it
            begin = bounds[:-1]
            left_n = np.add.reduceat(side < 2, begin, dtype=np.int64)
            right_n = np.add.reduceat(side > 0, begin, dtype=np.int64)
            v = fp.view(np.uint64)
            found_a, found_b = [], []
            for a, b in grouped_pairs(left_n, right_n, begin, bounds[1:] - right_n):
                near = (np.bitwise_count(v[a] ^ v[b]) <= distance) & (v[a] != v[b])
                if near.any():
                    x, root = local_components(fp[a[near]], fp[b[near]])
                    found_a.append(x), found_b.append(root)
            if found_a:
                x, root = local_components(np.concatenate(found_a), np.concatenate(found_b))
                keep = x != root
                yield pa.RecordBatch.from_arrays([pa.array(x[keep]), pa.array(root[keep])], ["src", "dst"])

    return run


def near_links(fps: DataFrame, distance: int = 4) -> DataFrame:
    """Links (src, dst) that join exactly the distinct fingerprints of fps(fp) that chains of near pairs join.

    Pairs at most `distance` bits apart are found without exception; each task returns a spanning forest of the links it
    verified instead of every pair, so a dense group costs as many rows as it has members.
    """
    n, together = bit_statistics(fps)
    plan = plan_parts(n, together, distance)
    rows = fps.select("fp").mapInArrow(_signatures(plan), "sig long, fp long, indexed boolean")
    crowded = (
        fps.select("fp").mapInArrow(_signatures([(bits, 0) for bits, _ in plan]), "sig long, fp long, indexed boolean")
        .groupBy("sig").agg(F.count("*").alias("n")).where(F.col("n") > BLOCK)
        .select("sig", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
    )
    rows = rows.join(crowded, "sig", "left")
    block = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
    every = F.sequence(F.lit(0), F.col("blocks") - 1)
    one = F.array(F.struct(F.lit(0).alias("cell"), F.when(F.col("indexed"), 1).otherwise(0).alias("side")))
    lefts = F.transform(every, lambda k: F.struct((block * F.col("blocks") + k).alias("cell"), F.lit(0).alias("side")))
    rights = F.transform(every, lambda k: F.struct((k * F.col("blocks") + block).alias("cell"), F.lit(2).alias("side")))
    place = F.when(F.col("blocks").isNull(), one).when(F.col("indexed"), F.concat(lefts, rights)).otherwise(lefts)
    placed = rows.select("sig", "fp", F.inline(place))
    return (
        placed.repartition("sig", "cell")
        .sortWithinPartitions("sig", "cell", "side")
        .select("sig", "cell", "fp", "side")
        .mapInArrow(_verify(distance), "src long, dst long")
    )


def simhash_components(docs: DataFrame, words: int = 4, distance: int = 4) -> DataFrame:
    """One row per document: doc_id, fp, component_id (the smallest doc_id that links of near fingerprints reach).

    Equal fingerprints link like any others, zero included. A null doc_id is never a component's name unless it has no
    other. Repeated rows stay, each with its component. An empty table gives an empty result.
    """
    prints = stored(fingerprints(docs, words))
    members = prints.groupBy("fp").agg(F.min("doc_id").alias("low"))
    comps = connected_components(near_links(members, distance)).select(
        F.col("node").alias("fp"), F.col("component").alias("root")
    )
    named = members.join(comps, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    lowest = named.groupBy("root").agg(F.min("low").alias("component_id"))
    # a root with many fingerprints, and a fingerprint with many documents, are skewed joins, not groups in one task
    by_fp = named.join(lowest, "root").select("fp", "component_id")
    return prints.join(by_fp, "fp").select("doc_id", "fp", "component_id")


def hex_fingerprint(fp):
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of all documents by SimHash of 4-word shingles, at most 4 bits apart."""
    out = simhash_components(table(spark, sf_dir, "documents"))
    return out.select("doc_id", hex_fingerprint(F.col("fp")).alias("fingerprint"), "component_id")


def drop_near_duplicates(docs: DataFrame, words: int = 4, distance: int = 4) -> DataFrame:
    """The row of docs with the smallest doc_id of each component; of repeats of that doc_id, one stays.

    A null doc_id stands for itself: a hash of its text takes the id's place.
    """
    key = F.coalesce(F.col("doc_id").cast("long"), F.xxhash64(F.lit("no id"), F.col("text")))
    keyed = docs.withColumn("_key", key)
    out = simhash_components(keyed.select(F.col("_key").alias("doc_id"), "text"), words, distance)
    keep = out.where("doc_id = component_id").select(F.col("doc_id").alias("_key")).distinct()
    return keyed.join(keep, "_key", "left_semi").dropDuplicates(["_key"]).select(*docs.columns)


QUERIES = {"op7_simhash": op7_simhash}
