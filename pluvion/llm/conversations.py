"""Repair of conversation structure at least cost, with the least audit of all cheapest repairs.

A repaired conversation's role initials form `(s?(ua)+)?`. An automaton of four states reads them, and edits of the rows
are its arcs: Keep, Rerole, Delete, and Insert between rows. Costs are found by a scan of min-plus matrices: rows are cut
into chunks of their overall order, chunks into chunks of chunks, and the costs come back down the same levels, so no task
holds more than one chunk, however long a conversation is.

Among the arcs that lie on cheapest paths, nodes are ranked by the least audit of 1, 2, 4, ... letters that leads on from
them: the rank of twice the length comes from a node's rank and that of the node where its least letters end. From a node a
letter leads to one node only, so the least letters have one end, and the pointers double as the ranks do. Up to 16 letters
a rank is the letters themselves as a number; beyond that, the place of the pair of ranks among all pairs. The least path is
then read off the doubled pointers, longest first.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.components import stored
from .common import ranked, table

#: Fixed values of the damage and of the faults.
SPACE = "\x20\x09\x0a\x0b\x0c\x0d"
STOPS = "[.!?]"

#: Rows of a chunk.
CHUNK = 1024

#: Fixed costs, and the letters of an audit in ASCII order; 0 stands for the end.
RE_ROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
LETTERS = {1: "D", 2: "I", 3: "K", 4: "R"}
D, I, K, R = LETTERS

#: States: nothing read, s read, u read, a read. What an inserted or reroled row leads to, and what a kept one does.
TO_VALID = (2, 2, 3, 2)
KEPT = {"s": (1, None, None, None), "u": (2, 2, None, 2), "a": (None, None, 3, None)}
FAR = 1 << 60
ACCEPT = np.array([0, INSERT * 2, INSERT, 0], np.int64)

#: Letters whose ranks are packed into a number of three bits a letter.
PACKED = 16


def damaged(conversations: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text) after the damage that crc32(`conv_id:turn`) % 20 decides; nulls are one space."""
    def known(c: str):
        return F.coalesce(F.col(c).cast("string"), F.lit(" "))

    role, text = known("role"), known("text")
    lot = F.crc32(F.concat(known("conv_id"), F.lit(":"), known("turn")).cast("binary")) % 20
    rows = conversations.select(
        "conv_id", "turn", F.when(lot == 4, "user").otherwise(role).alias("role"),
        F.when(lot == 1, "").when(lot == 2, F.regexp_replace(text, STOPS, "")).otherwise(text).alias("text"), lot.alias("lot"),
    )
    copies = F.when(F.col("lot") == 3, 2).otherwise(1)
    return rows.where("lot <> 0").select("conv_id", "turn", "role", "text", F.explode(F.sequence(F.lit(1), copies))).drop("col")


def in_order(rows: DataFrame) -> DataFrame:
    """rows with pos, numbered by conversation and turn, nulls first; equal turns by role and text (64 characters, then md5)."""
    keyed = rows.withColumn("head", F.substring("text", 1, 64)).withColumn("same", F.sha2(F.concat(F.octet_length("role").cast("string"), F.lit(":"), "role", "text"), 256))
    return ranked(keyed, ["conv_id", "turn", "role", "head", "same"], "pos").drop("head")


def faults(rows: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """(pos, conv_id, turn, initial, fault, last, illegal): what a row's repair depends on, without its text.

    Neighbours are looked at in chunks that also hold the row before and the row after them. The first of equal rows is
    the smallest pos of a grouped minimum.
    """
    last_sign = F.expr(f"right(trim(TRAILING '{SPACE}' FROM text), 1)")
    light = rows.select("pos", "conv_id", "turn", F.substring("role", 1, 1).alias("initial"), "same", last_sign.alias("sign"))
    firsts = light.groupBy("conv_id", "same").agg(F.min("pos").alias("pos")).select("pos", F.lit(True).alias("new"))
    fault = F.when(F.col("sign") == "", "blank").when(F.col("new").isNull(), "duplicate").when(~F.col("sign").rlike(STOPS), "truncated")
    light = light.join(firsts, "pos", "left").select("pos", "conv_id", "turn", "initial", fault.alias("fault"))
    near = F.array_distinct(F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda d: F.floor((F.col("pos") + d) / chunk)))
    by = Window.partitionBy("chunk").orderBy("pos")
    here = light.withColumn("chunk", F.explode(near))
    before, after = F.lag("pos").over(by).isNotNull(), F.lead("pos").over(by).isNotNull()
    pair = F.concat(F.lag("initial").over(by), "initial")
    seen = here.select(
        "*",
        (~(after & F.lead("conv_id").over(by).eqNullSafe(F.col("conv_id")))).alias("last"),
        (before & F.lag("conv_id").over(by).eqNullSafe(F.col("conv_id")) & ~pair.isin("su", "ua", "au")).alias("illegal"),
    )
    return seen.where(F.col("chunk") == F.floor(F.col("pos") / chunk)).drop("chunk")


def consumed(initial: str, fault: str | None, state: int) -> list[tuple[int, int, int]]:
    """(letter, cost, next state) of the ways to get past a row."""
    ways = [(D, DELETE, state)]
    if fault not in ("blank", "duplicate"):
        more = TRUNCATED if fault == "truncated" else 0
        ways.append((R, RE_ROLE + more, TO_VALID[state]))
        kept = KEPT.get(initial, (None,) * 4)[state]
        if kept is not None:
            ways.append((K, more, kept))
    return ways


def before_row(own: np.ndarray) -> np.ndarray:
    """Costs at a boundary from the costs of going past its row at once: up to two inserted rows first."""
    once = INSERT + own[list(TO_VALID)]
    return np.minimum(own, np.minimum(once, INSERT + once[list(TO_VALID)]))


def row_matrix(initial: str, fault: str | None) -> np.ndarray:
    """Costs [from state, to state] of a boundary, past the row after it."""
    m = np.full((4, 4), FAR, np.int64)
    for s in range(4):
        for _, cost, to in consumed(initial, fault, s):
            m[s, to] = min(m[s, to], cost)
    return np.stack([before_row(m[:, to]) for to in range(4)], 1)


def times(m: np.ndarray, then: np.ndarray) -> np.ndarray:
    """Min-plus product of a matrix with a matrix or a vector."""
    return np.minimum((m[:, :, None] + then[None]).min(1), FAR) if then.ndim == 2 else np.minimum((m + then[None]).min(1), FAR)


def matrices(part: pd.DataFrame) -> list[np.ndarray]:
    """The matrix of each row, or of each chunk, of a group."""
    if "m" in part:
        return [np.asarray(x).reshape(4, 4) for x in part["m"]]
    known: dict = {}
    codes = list(zip(part["initial"], part["fault"], strict=True))
    for code in codes:
        if code not in known:
            known[code] = row_matrix(*code)
    return [known[code] for code in codes]


def chunk_matrices(items: DataFrame, chunk: int) -> DataFrame:
    """(pos, m, last) of chunks of items(pos, last, ...): up to the first end of a conversation, if one ends inside."""
    def fold(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("pos")
        whole, ends = None, False
        for m, last in zip(reversed(matrices(part)), reversed(part["last"].tolist()), strict=True):
            whole, ends = (m if last or whole is None else times(m, whole)), ends or last
        return pd.DataFrame({"pos": [int(part["pos"].iloc[0]) // chunk], "m": [whole.ravel().tolist()], "last": [ends]})

    return items.groupBy(F.floor(F.col("pos") / chunk)).applyInPandas(fold, "pos long, m array<long>, last boolean")


def costs_after(items: DataFrame, chunk: int) -> DataFrame:
    """(pos, after) of chunks: the costs at the end of each, by what follows; items(pos, m, last, end)."""
    def unfold(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("pos")
        return pd.DataFrame({"pos": part["pos"], "after": [v.tolist() for v, _ in walked_back(part)]})

    return items.groupBy(F.floor(F.col("pos") / chunk)).applyInPandas(unfold, "pos long, after array<long>")


def walked_back(part: pd.DataFrame) -> list[tuple[np.ndarray, np.ndarray]]:
    """(costs after, costs before) of each row or chunk of a sorted group, the last one's from its column end.

    What follows a chunk counts for the conversation that goes on behind it, even if another one ends inside.
    """
    end = part["end"].iloc[-1]
    v = ACCEPT if end is None else np.asarray(end)
    out = []
    for m, last in zip(reversed(matrices(part)), reversed(part["last"].tolist()), strict=True):
        after = ACCEPT if last else v
        before = times(m, after)
        out.append((v if "m" in part else after, before))
        v = before
    return out[::-1]


def optimal_arcs(rows: DataFrame, chunk: int) -> DataFrame:
    """(node, n, cost, arcs) with arcs(letter, to), those of cheapest repairs; rows(pos, n, initial, fault, last, end).

    A node is 8 pos + state before a row, and 8 pos + 4 + state after the last row of a conversation.
    """
    def expand(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("pos")
        out = []
        rest = zip(part["pos"], part["n"], part["initial"], part["fault"], part["last"], walked_back(part), strict=True)
        for pos, n, initial, fault, last, (after, before) in rest:
            then = pos * 8 + 4 if last else pos * 8 + 8
            for s in range(4):
                arcs = [(a, then + to) for a, cost, to in consumed(initial, fault, s) if cost + after[to] == before[s]]
                if INSERT + before[TO_VALID[s]] == before[s]:
                    arcs.append((I, pos * 8 + TO_VALID[s]))
                out.append((pos * 8 + s, n, before[s], [{"letter": a, "to": to} for a, to in arcs]))
            if last:
                out += [(then + s, n, ACCEPT[s], [{"letter": I, "to": then + TO_VALID[s]}]) for s in (1, 2)]
                out += [(then + s, n, 0, [{"letter": 0, "to": None}]) for s in (0, 3)]
        return pd.DataFrame(out, columns=["node", "n", "cost", "arcs"])

    schema = "node long, n long, cost long, arcs array<struct<letter:int,to:long>>"
    return rows.groupBy(F.floor(F.col("pos") / chunk)).applyInPandas(expand, schema)


def with_costs(rows: DataFrame, count: int, chunk: int) -> DataFrame:
    """rows(pos, n, initial, fault, last) with end, the costs that hold where their chunk ends."""
    levels, width = [rows], count
    while width > chunk:
        levels.append(stored(chunk_matrices(levels[-1], chunk)))
        width = -(-width // chunk)
    ends = levels[-1].withColumn("end", F.lit(None).cast("array<long>"))
    for below in reversed(levels[:-1]):
        after = costs_after(ends, chunk).select(F.col("pos").alias("chunk"), F.col("after").alias("end"))
        ends = below.join(after, F.floor(F.col("pos") / chunk) == F.col("chunk")).drop("chunk")
    return ends


def least_paths(nodes: DataFrame, starts: DataFrame, longest: int) -> DataFrame:
    """(first, step, node, letter) of the least cheapest path from each of starts(first, n, node), in steps from 0.

    nodes(node, n, arcs); a path from a conversation of n rows has at most 2 n + 2 letters, so shorter conversations leave
    the rounds early. longest: the rows of the longest conversation.
    """
    least = F.array_min("arcs")  # the least letter: ranks by one letter
    now = stored(nodes.select("node", "n", least["letter"].cast("long").alias("rank"), least["to"].alias("to")))
    letters, levels, width = now, [], 1
    while True:
        levels.append(now)
        if width >= 2 * longest + 2:
            break
        now = now.where(F.col("n") * 2 + 2 > width)
        ahead = now.select(F.col("node").alias("to"), F.col("rank").alias("then"), F.col("to").alias("next"))
        pairs = now.join(ahead, "to", "left").select("node", "n", "rank", F.coalesce("then", F.lit(0)).alias("then"), F.col("next").alias("to"))
        if width < PACKED:
            now = stored(pairs.select("node", "n", (F.shiftleft("rank", 3 * width) + F.col("then")).alias("rank"), "to"))
        else:
            pairs = stored(pairs)
            places = ranked(pairs.select("rank", "then").distinct(), ["rank", "then"], "place")
            now = stored(pairs.join(places, ["rank", "then"]).select("node", "n", F.col("place").alias("rank"), "to"))
        width *= 2
    path = starts.select("first", "n", "node", F.lit(0).cast("long").alias("step"))
    for k in range(len(levels) - 1, -1, -1):
        jump = levels[k].where("to is not null").select("node", F.col("to").alias("next"))
        ahead = path.join(jump, "node").select("first", "n", F.col("next").alias("node"), (F.col("step") + (1 << k)).alias("step"))
        path = stored(path.unionByName(ahead))
    return path.join(letters.where("rank > 0").select("node", F.col("rank").cast("int").alias("letter")), "node").select("first", "step", "node", "letter")


def text_digests(items: DataFrame) -> DataFrame:
    """(first, repaired_sha256) of items(first, step, item): the digest of a conversation's items, newline-joined.

    Rows are sorted by Spark and streamed through the hash, so a conversation of any length needs no memory of its own.
    """
    def hashed(batches):
        at, state = None, None
        for batch in batches:
            firsts, done = batch.column(0).to_pylist(), ([], [])
            for first, item in zip(firsts, batch.column(2).cast(pa.binary()).to_pylist(), strict=True):
                if first != at:
                    if state:
                        done[0].append(at), done[1].append(state.hexdigest())
                    at, state = first, hashlib.sha256(item)
                else:
                    state.update(b"\n" + item)
            yield pa.RecordBatch.from_arrays([pa.array(done[0], pa.int64()), pa.array(done[1], pa.string())], ["first", "repaired_sha256"])
        if state:
            yield pa.RecordBatch.from_arrays([pa.array([at], pa.int64()), pa.array([state.hexdigest()])], ["first", "repaired_sha256"])

    ordered = items.select("first", "step", "item").repartition("first").sortWithinPartitions("first", "step")
    return ordered.mapInArrow(hashed, "first long, repaired_sha256 string")


def repair(rows: DataFrame, chunk: int = CHUNK) -> tuple[DataFrame, DataFrame]:
    """(report of each conversation, its repaired rows) of rows(conv_id, turn, role, text).

    Nulls in role and text count as one space, null conv_ids as one conversation, null turns come first; equal turns go
    by role and text. A repaired row is (first, step, letter, role, text), first naming the conversation as in the report.
    Columns with other names are not read. An empty table gives empty results.
    """
    space = F.lit(" ")
    given = rows.select("conv_id", "turn", F.coalesce("role", space).alias("role"), F.coalesce("text", space).alias("text"))
    placed = in_order(given)
    marked = stored(faults(placed, chunk))
    count = marked.count()
    kinds = [F.count(F.when(F.col("fault") == k, 1)).alias(k) for k in ("blank", "duplicate", "truncated")]
    gaps = F.coalesce(F.max("turn") - F.min("turn") + 1, F.lit(0)) - F.count_distinct("turn")
    sums = marked.groupBy("conv_id").agg(
        F.min("pos").alias("first"), F.count("*").alias("n"), F.count(F.when(F.col("illegal"), 1)).alias("illegal"), *kinds
    )
    turns = marked.groupBy("conv_id").agg(gaps.cast("long").alias("gaps")).withColumnRenamed("conv_id", "c")
    report = stored(sums.join(turns, F.col("conv_id").eqNullSafe(F.col("c"))).drop("c"))
    longest = report.agg(F.max("n")).first()[0] or 0
    sizes = report.select(F.col("conv_id").alias("c"), "n")
    sized = marked.join(sizes, F.col("conv_id").eqNullSafe(F.col("c"))).select("pos", "n", "initial", "fault", "last")
    nodes = stored(optimal_arcs(with_costs(stored(sized), count, chunk), chunk))
    starts = report.select("first", "n", (F.col("first") * 8).alias("node"))
    path = stored(least_paths(nodes, starts, longest))
    state, letter = F.col("node") % 4, F.col("letter")
    edits = path.select("first", "step", letter, F.floor(F.col("node") / 8).alias("pos"), F.when(state == 2, "assistant").otherwise("user").alias("valid"))
    taken = edits.where(letter.isin(K, R)).join(placed.select("pos", "role", "text"), "pos")
    taken = taken.select("first", "step", "letter", F.when(letter == K, F.col("role")).otherwise(F.col("valid")).alias("role"), "text")
    added = edits.where(letter == I).select("first", "step", "letter", F.col("valid").alias("role"), F.lit("").alias("text"))
    repaired = taken.unionByName(added)
    sign = F.element_at(F.array(*[F.lit(x) for x in LETTERS.values()]), letter)
    piece = F.floor(F.col("step") / 4096)
    strings = path.groupBy("first", piece.alias("piece")).agg(F.array_sort(F.collect_list(F.struct("step", sign.alias("sign")))).alias("signs"))
    strings = strings.select("first", "piece", F.array_join("signs.sign", "").alias("part"))
    audits = strings.groupBy("first").agg(F.array_sort(F.collect_list(F.struct("piece", "part"))).alias("parts"))
    audits = audits.select("first", F.array_join("parts.part", "").alias("audit"))
    digests = text_digests(repaired.select("first", "step", F.concat("role", F.lit(":"), "text").alias("item")))
    costs = nodes.select((F.col("node") / 8).cast("long").alias("first"), "cost", "node").where("node = first * 8").drop("node")
    out = report.join(costs, "first").join(audits, "first", "left").join(digests, "first", "left")
    nothing = hashlib.sha256(b"").hexdigest()
    return out.withColumn("audit", F.coalesce("audit", F.lit(""))).withColumn("repaired_sha256", F.coalesce("repaired_sha256", F.lit(nothing))), repaired


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The repair of every conversation after damage; a conversation without rows then has zeros and an empty audit."""
    conversations = table(spark, sf_dir, "conversations")
    report, _ = repair(damaged(conversations))
    longs = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    all_ids = conversations.select(F.col("conv_id").alias("id")).distinct()
    found = all_ids.join(report, F.col("id").eqNullSafe(F.col("conv_id")), "left")
    nothing = hashlib.sha256(b"").hexdigest()
    return found.select(
        F.col("id").alias("conv_id"), *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in longs],
        F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(nothing)).alias("repaired_sha256"),
    )


QUERIES = {"op11_conversation_repair": op11_conversation_repair}
