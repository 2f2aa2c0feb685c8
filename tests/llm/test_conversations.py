"""Conversation repair against a search of all repairs."""

import hashlib
import heapq
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from pluvion.llm import conversations as C

SPACES = "\x20\x09\x0a\x0b\x0c\x0d"
NEXT = {0: "u", 1: "u", 2: "a", 3: "u"}
STEP = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
FULL = {"u": "user", "a": "assistant"}


def damage(rows):
    text = lambda v: " " if v is None else str(v)
    out = []
    for conv, turn, role, words in rows:
        lot = zlib.crc32(f"{text(conv)}:{text(turn)}".encode()) % 20
        role, words = text(role), text(words)
        words = "" if lot == 1 else re.sub("[.!?]", "", words) if lot == 2 else words
        out += [(conv, turn, "user" if lot == 4 else role, words)] * (0 if lot == 0 else 2 if lot == 3 else 1)
    return out


def searched(rows):
    """The report of one conversation's (turn, role, text) by best-first search over (cost, audit)."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0], r[1].encode(), r[2].encode()))
    turns = {t for t, _, _ in rows if t is not None}
    seen, kinds = set(), []
    for _, role, text in rows:
        said = text.rstrip(SPACES)
        kinds.append("b" if not said else "d" if (role, text) in seen else "t" if said[-1] not in ".!?" else "")
        seen.add((role, text))
    initials = [r[:1] for _, r, _ in rows]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
    heap, done = [(0, "", 0, 0, ())], set()
    while True:
        cost, audit, i, s, kept = heapq.heappop(heap)
        if (i, s) in done:
            continue
        done.add((i, s))
        if i == len(rows) and s in (0, 3):
            digest = hashlib.sha256("\n".join(kept).encode()).hexdigest()
            gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
            return gaps, *(kinds.count(k) for k in "bdt"), illegal, cost, audit, digest
        new = NEXT[s]
        heapq.heappush(heap, (cost + 3, audit + "I", i, STEP[s, new], (*kept, FULL[new] + ":")))
        if i < len(rows):
            _, role, text = rows[i]
            heapq.heappush(heap, (cost + 4, audit + "D", i + 1, s, kept))
            if kinds[i] in ("", "t"):
                more = 3 if kinds[i] else 0
                if (s, initials[i]) in STEP:
                    heapq.heappush(heap, (cost + more, audit + "K", i + 1, STEP[s, initials[i]], (*kept, role + ":" + text)))
                heapq.heappush(heap, (cost + more + 3, audit + "R", i + 1, STEP[s, new], (*kept, FULL[new] + ":" + text)))


COLUMNS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def made(seed, sizes):
    rng = random.Random(seed)
    rows = []
    for conv, size in enumerate(sizes):
        for turn in range(size):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None])
            text = rng.choice(["Ja.", "Nein!", "wie", " \t", "", "So?\n ", None, f"neu {turn}.", "é", f"{turn}"])
            rows.append((conv if conv else None, rng.choice([turn, turn, turn, None, 3]), role, text))
    return rows


@pytest.mark.parametrize("chunk", [3, 16, 1024])
def test_repair_equals_search(spark, chunk):
    rows = made(chunk, [9, 1, 2, 3, 40, 5, 17, 1, 33, 8])
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("pos", F.lit("kept out"))
    got = {r["conv_id"]: tuple(r[c] for c in COLUMNS) for r in C.repair(df, chunk)[0].collect()}
    groups: dict = {}
    for conv, turn, role, text in rows:
        groups.setdefault(conv, []).append((turn, " " if role is None else role, " " if text is None else text))
    assert got == {conv: searched(part) for conv, part in groups.items()}


def test_query_equals_search(spark, tmp_path):
    rows = made(7, [4] * 60 + [0, 70])
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    got = {r["conv_id"]: tuple(r[c] for c in COLUMNS) for r in C.op11_conversation_repair(spark, str(tmp_path)).collect()}
    groups: dict = {r[0]: [] for r in rows}
    for conv, *rest in damage(rows):
        groups[conv].append(tuple(rest))
    assert got == {conv: searched(part) for conv, part in groups.items()}


def test_repair_of_nothing(spark):
    report, repaired = C.repair(spark.createDataFrame([], "conv_id long, turn long, role string, text string"))
    assert report.count() == repaired.count() == 0
