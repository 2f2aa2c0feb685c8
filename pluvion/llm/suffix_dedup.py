"""Removal of every byte that lies in a string of 200 bytes found elsewhere too, by sorted suffixes.

Equal strings of 200 bytes have an equal least hash among their 64-byte words. Successive strings with the same least hash
form a run; runs are grouped by that hash all over the corpus, so equal strings meet in one group. A group of one run has no
repeat, unless a string of the run begins behind its first least word: then it may hold itself again. Where a group's runs
have all the same bytes, all that they hold repeats. Runs that may hold themselves, and one of each of different runs of a
group, go to a shard of the suffix array, where external induced sorting finds the strings that neighbours share. Only runs
of at most RUN strings travel, never a list of all members of a group; copies of whole texts are told by their digest.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.components import shared_dir, stored
from .common import table
from .induced_sorting import Store, sorted_suffixes

#: Bytes of a string whose repeats go, and of a word. RUN strings at most make a run: six words cover it.
LENGTH, WORD, RUN = 200, 64, 184
#: Bytes of text hashed at once, and about the bytes of a shard.
BLOCK, SHARD = 1 << 21, 4 << 20

#: Multipliers of the hash: fixed odd numbers.
SPREAD, BASE, FINAL = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93), np.uint64(0xBF58476D1CE4E5B9)


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(29))) * FINAL
    return h ^ (h >> np.uint64(32))


def word_hashes(data: np.ndarray) -> np.ndarray:
    """A hash of each word of WORD bytes."""
    h, power, wide = (data.astype(np.uint64) + np.uint64(1)) * SPREAD, BASE, 1
    with np.errstate(over="ignore"):
        while wide < WORD:
            h, power, wide = h[:-wide] * power + h[wide:], power * power, wide * 2
        return mixed(h)


def runs_of(data: np.ndarray, starts: np.ndarray, ends: np.ndarray):
    """(text, begin, strings, least hash, content hash, own) of the runs of texts data[starts:ends], none of them over a text's end.

    own: the run may hold a string twice, as one of its strings begins behind its first least word.
    """
    words = word_hashes(data)
    least, wide = words, 1
    while wide * 2 <= LENGTH - WORD + 1:
        least, wide = np.minimum(least[:-wide], least[wide:]), wide * 2
    rest = LENGTH - WORD + 1 - wide
    least = np.minimum(least[: len(least) - rest], least[rest:]) if rest else least
    cuts = np.unique(np.r_[np.flatnonzero(least[1:] != least[:-1]) + 1, starts, ends - LENGTH + 1, len(least)])
    cuts = cuts[(cuts >= 0) & (cuts <= len(least))]
    begin, size = cuts[:-1], np.diff(cuts)
    parts = -(-size // RUN)
    nth = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
    size = np.minimum(np.repeat(size, parts) - nth * RUN, RUN)
    begin = np.repeat(begin, parts) + nth * RUN
    text = np.searchsorted(starts, begin, "right") - 1
    inside = (text >= 0) & (begin + LENGTH <= ends[text])
    text, begin, size = text[inside], begin[inside], size[inside]
    end = begin + size + LENGTH - 1
    before = np.r_[0, np.cumsum(words[: len(least)] == least)]
    own = before[begin + size - 1] > before[begin]
    with np.errstate(over="ignore"):
        content = size.astype(np.uint64)
        for at in (begin, begin + WORD, begin + 2 * WORD, end - 3 * WORD, end - 2 * WORD, end - WORD):
            content = mixed(content * BASE + words[at])
    return text, begin - starts[text], size, least[begin].view(np.int64), content.view(np.int64), own


def hashed_runs(texts: list[bytes]):
    """The runs of texts in the order of texts, as in runs_of; long texts are cut into overlapping blocks."""
    found = [[np.zeros(0, np.int64)] * 5 + [np.zeros(0, bool)]]
    held: list[tuple[int, int, bytes]] = []  # text, place in it, bytes

    def flush() -> None:
        data = np.frombuffer(b"".join(p for _, _, p in held), np.uint8)
        ends = np.cumsum([len(p) for _, _, p in held])
        starts = ends - np.array([len(p) for _, _, p in held])
        text, begin, *rest = runs_of(data, starts, ends)
        found.append([np.array([t for t, _, _ in held])[text], begin + np.array([o for _, o, _ in held])[text], *rest])
        held.clear()

    size = 0
    for n, text in enumerate(texts):
        for at in range(0, len(text) - LENGTH + 1, BLOCK):
            held.append((n, at, text[at : at + BLOCK + LENGTH - 1]))
            size += len(held[-1][2])
            if size >= BLOCK:
                flush()
                size = 0
    if held:
        flush()
    return [np.concatenate(column) for column in zip(*found, strict=True)]


def with_runs(batches):
    """Batches (doc, text) to (doc, sha, n_bytes, runs)."""
    for batch in batches:
        texts = [x or b"" for x in batch.column(1).cast(pa.binary()).to_pylist()]
        text, begin, size, least, content, own = hashed_runs(texts)
        offsets = np.searchsorted(text, np.arange(len(texts) + 1)).astype(np.int32)
        run = pa.StructArray.from_arrays(
            [pa.array(least), pa.array(content), pa.array(begin), pa.array(size.astype(np.int32)), pa.array(own)], ["v", "s", "a", "n", "own"]
        )
        yield pa.RecordBatch.from_arrays(
            [
                batch.column(0), pa.array([hashlib.sha256(x).hexdigest() for x in texts]), pa.array([len(x) for x in texts], pa.int64()),
                pa.ListArray.from_arrays(pa.array(offsets), run),
            ],
            ["doc", "sha", "n_bytes", "runs"],
        )


def cut_out(batches):
    """Batches (id, text, runs of the text) to (id, a, v, single, piece)."""
    for batch in batches:
        out: list[tuple] = []
        for ident, text, runs in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), batch.column(2).to_pylist(), strict=True):
            out += [(ident, r["a"], r["v"], r["single"], text[r["a"] : r["a"] + r["n"] + LENGTH - 1]) for r in runs]
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.binary())
        columns = [pa.array(c, k) for c, k in zip(zip(*out, strict=True) if out else [[]] * 5, kinds, strict=True)]
        yield pa.RecordBatch.from_arrays(columns, ["id", "a", "v", "single", "piece"])


def repeats_in_shard(folder: str | None):
    """A function of batches (id, a, single, piece) of one shard to (id, a, n): strings of single runs that another run has."""
    def found(batches):
        store, ids, begins, singles, sizes, parts = Store(folder), [], [], [], [], []
        for batch in batches:
            if not batch.num_rows:
                continue
            ids.append(batch.column(0).to_numpy())
            begins.append(batch.column(1).to_numpy())
            singles.append(batch.column(2).to_numpy(zero_copy_only=False))
            pieces = batch.column(3).to_pylist()
            sizes.append(np.array([len(p) for p in pieces]))
            parts.append(store.keep(np.frombuffer(b"".join(p.translate(UP) + b"\x01" for p in pieces), np.uint8)))
        if not ids:
            return
        ident, begin, single, size = map(np.concatenate, (ids, begins, singles, sizes))
        if not single.any():
            return
        text = store.keep(np.concatenate([*parts, np.zeros(1, np.uint8)]))
        places, prefix = sorted_suffixes(text, store)
        hit = prefix >= LENGTH
        repeated = np.zeros(len(text), bool)
        repeated[places[hit]] = True
        repeated[places[np.flatnonzero(hit) - 1]] = True
        first = np.cumsum(size + 1) - size - 1
        # prefixes may go on over a piece's end: only strings inside one count
        edge = np.flatnonzero(np.diff(np.r_[False, repeated, False].astype(np.int8)))
        up, down = edge[::2], edge[1::2]
        rows: list[tuple] = []
        for lo, hi in zip(up, down, strict=True):
            p = int(np.searchsorted(first, lo, "right")) - 1
            while p < len(first) and first[p] < hi:
                a, b = max(lo, first[p]), min(hi, first[p] + size[p] - LENGTH + 1)
                if single[p] and a < b:
                    rows.append((ident[p], begin[p] + a - first[p], b - a))
                p += 1
        columns = zip(*rows, strict=True) if rows else [[]] * 3
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["id", "a", "n"])

    return found


#: Bytes of UTF-8 stay below 0xF6, so two letters are free below them: the end of a piece and that of the shard.
UP = bytes((b + 2) % 256 for b in range(256))


def without(batches):
    """Batches (id, text, spans) to (id, sha) of what is left of each text; spans are sorted and apart."""
    for batch in batches:
        digests = []
        for text, spans in zip(batch.column(1).cast(pa.binary()).to_pylist(), batch.column(2).to_pylist(), strict=True):
            left, at = hashlib.sha256(), 0
            for span in spans:
                left.update(text[at : span["lo"]])
                at = span["hi"]
            left.update(text[at:])
            digests.append(left.hexdigest())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(digests, pa.string())], ["id", "kept"])


def joined_spans(marks: Column) -> Column:
    """Sorted spans (lo, hi) of removed bytes from marks (a, n): n strings that begin at a and after."""
    none = F.array().cast("array<struct<lo:long,hi:long>>")

    def add(spans: Column, m: Column) -> Column:
        lo, hi = m["a"], m["a"] + m["n"] + (LENGTH - 1)
        last = F.element_at(spans, -1)
        grown = F.struct(last["lo"].alias("lo"), F.greatest(last["hi"], hi).alias("hi"))
        apart = (F.size(spans) == 0) | (F.try_element_at(spans, F.lit(-1))["hi"] < lo)
        return F.when(apart, F.concat(spans, F.array(F.struct(lo.alias("lo"), hi.alias("hi"))))).otherwise(
            F.concat(F.slice(spans, 1, F.size(spans) - 1), F.array(grown))
        )

    return F.aggregate(F.array_sort(marks), none, add)


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc, n_bytes, n_removed, n_spans, kept_sha256) for every row of docs, doc being its column `key` of any value.

    Null texts are empty; texts under LENGTH bytes lose nothing. Of texts that occur more than once every byte goes. Keys
    may be null or repeat: rows are told apart by a written row number. An empty table gives no rows; other columns are not
    read, whatever their names.
    """
    spark = docs.sparkSession
    shared = shared_dir(spark)
    folder = shared.removeprefix("file:").replace("//", "/") if shared.startswith("file:") or "://" not in shared else None
    pairs = docs.select(F.col(f"`{key}`").alias("doc"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    kind = pairs.schema["doc"].dataType.simpleString()
    runs = "array<struct<v:long,s:long,a:long,n:int,own:boolean>>"
    read = pairs.mapInArrow(with_runs, f"doc {kind}, sha string, n_bytes long, runs {runs}")
    read = stored(read.withColumn("id", F.monotonically_increasing_id()))
    copies = read.where(f"n_bytes >= {LENGTH}").groupBy("sha").agg(F.count("*").alias("copies"), F.min("id").alias("one")).where("copies > 1")
    rows = stored(read.select("doc", "sha", "n_bytes", "id").join(copies, "sha", "left"))
    each = read.select("id", F.explode("runs").alias("r")).select("id", "r.*")
    again = each.groupBy("v").agg(F.count("*").alias("runs"), F.max("own").alias("own")).where("runs > 1 or own").select("v")
    twins = rows.where("one <> id").select("id", "one")
    met = each.join(again, "v").join(twins, "id", "left").select(F.coalesce("one", "id").alias("id"), "a", "n", "v", "s", "own")
    met = stored(met)
    place = (F.col("a") * 256 + F.col("n")).alias("place")
    kinds = met.withColumn("place", place).groupBy("v", "s").agg(
        F.min("id").alias("id"), F.max("id").alias("id2"), F.min("a").alias("a1"), F.max("a").alias("a2"), F.min_by("place", "id").alias("place"), F.max("own").alias("own")
    )
    single = (F.col("id") == F.col("id2")) & (F.col("a1") == F.col("a2"))
    kinds = stored(kinds.select("v", "s", "id", "place", "own", single.alias("single")))
    various = kinds.groupBy("v").agg(F.count("*").alias("kinds"), F.max(F.expr("own and single")).alias("own")).where("kinds > 1 or own").select("v")
    sought = stored(kinds.join(various, "v").select("id", F.floor(F.col("place") / 256).alias("a"), (F.col("place") % 256).alias("n"), "v", "single"))
    size = sought.agg(F.sum(F.col("n") + LENGTH)).first()[0] or 0
    wanted = sought.groupBy("id").agg(F.collect_list(F.struct("a", "n", "v", "single")).alias("runs"))
    wanted = wanted.join(rows.select("id", "sha"), "id")
    texts = pairs.select("text", F.sha2("text", 256).alias("sha")).where(F.octet_length("text") >= LENGTH)
    pieces = texts.join(wanted, "sha").select("id", "text", "runs")
    pieces = pieces.mapInArrow(cut_out, "id long, a long, v long, single boolean, piece binary")
    pieces = pieces.dropDuplicates(["id", "a"])  # whole copies give the same pieces
    shards = max(1, -(-size // SHARD))
    sharded = pieces.repartition(shards, "v").select("id", "a", "single", "piece")
    by_suffix = sharded.mapInArrow(repeats_in_shard(folder), "id long, a long, n long")
    same = met.join(kinds.where("not single").select("v", "s"), ["v", "s"]).select("id", "a", F.col("n").cast("long").alias("n"))
    marks = same.unionByName(by_suffix).groupBy("id").agg(F.collect_set(F.struct("a", "n")).alias("marks"))
    spans = stored(rows.where("copies is null").select("id", "sha", "n_bytes").join(marks, "id").withColumn("spans", joined_spans(F.col("marks"))).drop("marks"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["hi"] - s["lo"])
    left = texts.join(spans.select("id", "sha", "spans"), "sha").select("id", "text", "spans").mapInArrow(without, "id long, kept string")
    counted = spans.select("id", removed.alias("removed"), F.size("spans").cast("long").alias("spans")).join(left, "id")
    whole, nothing = F.col("copies").isNotNull(), hashlib.sha256(b"").hexdigest()
    return rows.join(counted, "id", "left").select(
        "doc", "n_bytes",
        F.when(whole, F.col("n_bytes")).otherwise(F.coalesce("removed", F.lit(0))).alias("n_removed"),
        F.when(whole, 1).otherwise(F.coalesce("spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(whole, nothing).otherwise(F.coalesce("kept", "sha")).alias("kept_sha256"),
    )


def op13_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every whole document without the bytes of 200-byte strings that start elsewhere too."""
    return remove_repeats(table(spark, sf_dir, "documents")).withColumnRenamed("doc", "doc_id")


QUERIES = {"op13_suffix_dedup": op13_suffix_dedup}
