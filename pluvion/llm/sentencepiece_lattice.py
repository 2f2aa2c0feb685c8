"""SentencePiece encoding and decoding by a relational lattice.

Texts are cut into words where no piece of the model can reach across. The substrings of each distinct word, no longer
than the longest piece, are equi-joined to the piece table; what matches are the edges of the word's lattice. They are
grouped by word and folded with Spark's `aggregate`; each document gets its words' ids by a join. A bounded head of
frequent words, encoded by the same lattice, is resolved where texts are read, which keeps the join to the rare ones; the
head only saves work, so it may come from a sample of documents.

The fold follows the kind of the model. The vocabulary here is a BPE model: its scores are merge priorities, and the
path of the greatest sum (Viterbi) is not what the library returns. So edges are taken in order of priority, leftmost
first, and an edge that now spans exactly two symbols fuses them; the state is the set of symbol bounds, as bits of a
long. One pass is exact because every piece (runs of spaces aside) is built from pieces of better priority, which is
checked on loading. Runs of spaces have one priority, the last: they grow from the left, so their edges are taken by
end, the shortest of an end first.

A word longer than a long has bits is cut further, between neighbours that no piece holds side by side. What is still too
long (one letter a thousand times) goes through the same lattice in chunks, and its edges are folded by the same rule over
arrays in Python, as a state that is copied with each edge would cost the square of the length.
"""

from __future__ import annotations

import heapq
from array import array
from collections import Counter
from collections.abc import Iterable
from functools import cached_property
from itertools import filterfalse

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from ..operators.components import stored
from .common import table

#: Characters of a word that the bits of the fold's state can hold, and starts of a chunk of longer words.
LONGEST, CHUNK = 62, 64
#: Words in the head at most (and half as many space-delimited tokens), and documents of the sample it comes from, about.
HEAD, HEAD_DOCS = 327_680, 40_000
WORD = regex.compile(r" *\p{L}+| *[^\p{L} ]+| +")


class Pieces:
    """The piece table of a .model file; the space mark is kept as a space."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        self.names = [sp.id_to_piece(i).replace("▁", " ") for i in range(n)]
        plain = [i for i in range(n) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
        self.rank = {self.names[i]: (-sp.get_score(i), i) for i in plain}
        self.byte_id = {int(sp.id_to_piece(i)[3:5], 16): i for i in range(n) if sp.is_byte(i)}
        self.byte_of = {i: b for b, i in self.byte_id.items()}
        self.unknown = sp.unk_id()
        self.longest = max(map(len, self.rank))
        self.code = "H" if n <= 65_536 else "I"  # how ids are packed
        self.pairs = {x[i : i + 2] for x in self.rank for i in range(len(x) - 1)}
        self._check()

    def _check(self) -> None:
        alike = Counter(rank for name, (rank, _) in self.rank.items() if name.strip() and len(name) > 1)
        if any(n > 1 for n in alike.values()):
            raise ValueError("pieces share a priority")
        for name, (rank, _) in self.rank.items():
            if WORD.fullmatch(name) is None:
                raise ValueError(f"piece {name!r} reaches across words")
            symbols, worst = self._by_agenda(name)
            if name.strip() and (symbols != [name] or worst > rank):
                raise ValueError(f"piece {name!r} is not built from pieces of better priority")

    def _by_agenda(self, word: str) -> tuple[list[str], float]:
        """The symbols of a piece's own text, and the worst priority of a fusion before the last; only for the check.

        The pair of neighbours that make the piece of best priority fuses, the leftmost of equals, until none does.
        """
        n = len(word)
        after, before = list(range(1, n + 1)), list(range(-1, n))
        end = list(range(1, n + 1))  # of the symbol that begins here, 0 once it is fused into another
        agenda: list[tuple[float, int, int]] = []

        def offer(left: int) -> None:
            right = after[left]
            if right < n and end[right] - left <= self.longest and (r := self.rank.get(word[left : end[right]])):
                heapq.heappush(agenda, (r[0], left, end[right]))

        for i in range(n - 1):
            offer(i)
        worst, last = -1.0, -1.0
        while agenda:
            rank, left, e = heapq.heappop(agenda)
            right = after[left]
            if not end[left] or right >= n or end[right] != e:
                continue
            worst, last = max(worst, last), rank
            end[left], end[right], after[left] = e, 0, after[right]
            if after[left] < n:
                before[after[left]] = left
                offer(left)
            if before[left] >= 0:
                offer(before[left])
        out, i = [], 0
        while i < n:
            out.append(word[i : end[i]])
            i = after[i]
        return out, worst

    def ids(self, symbol: str) -> list[int]:
        if (r := self.rank.get(symbol)) is not None:
            return [r[1]]
        return [self.byte_id[b] for b in symbol.encode()] if self.byte_id else [self.unknown]

    def words(self, text: str | None) -> list[str]:
        """The words of a text behind the model's leading space; none for null or empty."""
        found = WORD.findall(" " + text.replace("▁", " ")) if text else []
        if found and max(map(len, found)) > LONGEST:
            found = [part for w in found for part in (self.cut(w) if len(w) > LONGEST else (w,))]
        return found

    def cut(self, word: str) -> list[str]:
        """The word's parts between neighbours that no piece holds side by side: no fusion reaches across."""
        at = [0, *(i for i in range(1, len(word)) if word[i - 1 : i + 1] not in self.pairs), len(word)]
        return [word[x:y] for x, y in zip(at, at[1:])]


#: An edge is one long: order of priority, end, start counted from PLACE down, and id of its piece; so edges sort as they
#: are taken. Edges of one priority have one length (then this is the order of their starts) or are runs of spaces.
ORDER_AT, END_AT, START_AT, PLACE, ID = 36, 30, 24, 63, (1 << 24) - 1
#: Single characters below this code point need no edge: a literal array has their ids.
PLAIN = 1024


def _shift(name: str, value: Column, by: Column | int) -> Column:
    return F.call_function(name, value, by if isinstance(by, Column) else F.lit(by))


def _bit(place: Column) -> Column:
    return _shift("shiftleft", F.lit(1).cast("long"), place)


def _start(x: Column) -> Column:
    return (F.lit(PLACE) - _shift("shiftright", x, START_AT).bitwiseAND(F.lit(PLACE))).cast("int")


def _end(x: Column) -> Column:
    return _shift("shiftright", x, END_AT).bitwiseAND(F.lit(PLACE)).cast("int")


def fold_edges(masks: Column, word: Column) -> Column:
    """The symbol bounds of a word, as bits, after one pass over the masks(ends, inner) of its edges by priority."""
    every = _shift("shiftrightunsigned", F.lit(-1).cast("long"), F.lit(63) - F.char_length(word))
    return F.aggregate(
        masks,
        every,
        lambda b, x: F.when(
            (b.bitwiseAND(x["ends"]) == x["ends"]) & (F.bit_count(b.bitwiseAND(x["inner"])) == 1),
            b.bitwiseAND(F.bitwise_not(x["inner"])),
        ).otherwise(b),
    )


def chosen_ids(masks: Column, bounds: Column, word: Column, pieces: Pieces) -> Column:
    """The ids of the symbols between neighbouring bounds; a character that is no piece gives its bytes."""
    kept = F.filter(masks, lambda x: (bounds.bitwiseAND(x["ends"]) == x["ends"]) & (bounds.bitwiseAND(x["inner"]) == 0))
    whole = F.transform(kept, lambda x: F.struct(x["s"].alias("s"), F.array(x["id"]).alias("ids")))
    plain = F.array(*[F.lit(pieces.rank[chr(c)][1] if chr(c) in pieces.rank else -1) for c in range(PLAIN)])
    alone = F.filter(
        F.sequence(F.lit(0), F.char_length(word) - 1),
        lambda i: (F.bit_count(bounds.bitwiseAND(_bit(i).bitwiseOR(_bit(i + 1)))) == 2) & ~F.exists(kept, lambda x: x["s"] == i),
    )

    def single(i: Column) -> Column:
        ch = F.substring(word, i + 1, F.lit(1))
        code = F.ascii(ch)
        known = F.when(code < PLAIN, F.element_at(plain, F.least(code, F.lit(PLAIN - 1)) + 1)).otherwise(-1)
        if pieces.byte_id:
            hexed = F.hex(F.encode(ch, "utf-8"))
            other = F.transform(
                F.sequence(F.lit(1), (F.length(hexed) / 2).cast("int")),
                lambda k: F.conv(F.substring(hexed, k * 2 - 1, F.lit(2)), 16, 10).cast("int") + pieces.byte_id[0],
            )
        else:
            other = F.array(F.lit(pieces.unknown))
        return F.struct(i.alias("s"), F.when(known >= 0, F.array(known)).otherwise(other).alias("ids"))

    return F.flatten(F.transform(F.array_sort(F.concat(whole, F.transform(alone, single))), lambda x: x["ids"]))


def _edge_table(words: DataFrame, pieces: Pieces, columns: str) -> DataFrame:
    """The pieces that an edge can stand for; its size is the vocabulary's."""
    place = {rank: k for k, rank in enumerate(sorted({rank for rank, _ in pieces.rank.values()}))}
    rows = [(name, place[rank], i) for name, (rank, i) in pieces.rank.items() if len(name) > 1 or ord(name) >= PLAIN]
    sub, at, ids = zip(*rows)
    lookup = words.sparkSession.createDataFrame(pa.table({"sub": pa.array(sub, pa.string()), "place": pa.array(at, pa.int64()), "id": pa.array(ids, pa.int32())}))
    return F.broadcast(lookup.selectExpr("sub", columns))


def encode_words(words: DataFrame, pieces: Pieces) -> DataFrame:
    """(word, ids) of words(word): distinct, not empty and of at most LONGEST characters.

    The chain keeps the rows of a word where the grouping of `words` by word has put them, so it shuffles nothing.
    """
    if pieces.byte_id and any(pieces.byte_id[b] != pieces.byte_id[0] + b for b in range(256)):
        raise ValueError("byte pieces are not in order")
    lookup = _edge_table(words, pieces, f"shiftleft(place, {ORDER_AT}) | id as code")
    n = F.char_length("word")
    starts = words.select("word", F.explode(F.sequence(F.lit(0), n - 1)).alias("s"))
    # a word of ASCII needs no spans of one character, but the first, which keeps its row
    least = F.when((F.col("s") > 0) & (F.octet_length("word") == n), F.least(F.col("s") + 2, n)).otherwise(F.col("s") + 1)
    spans = starts.select("word", "s", F.explode(F.sequence(least, F.least(n, F.col("s") + pieces.longest))).alias("e"))
    s, e = F.col("s").cast("long"), F.col("e").cast("long")
    subs = spans.select(
        "word", F.expr("substring(word, s + 1, e - s)").alias("sub"), ((F.col("s") == 0) & (F.col("e") == 1)).alias("head"),
        (_shift("shiftleft", F.lit(PLACE) - s, START_AT) + _shift("shiftleft", e, END_AT)).alias("span"),
    )
    edges = subs.join(lookup, "sub", "left").where("code is not null or head")  # one row a word stays whatever matches
    grouped = edges.groupBy("word").agg(F.collect_list(F.col("code") + F.col("span")).alias("edges"))

    def mask(x: Column) -> Column:
        a, b = _bit(_start(x)), _bit(_end(x))
        return F.struct(
            a.bitwiseOR(b).alias("ends"), (b - _shift("shiftleft", a, 1)).alias("inner"), _start(x).alias("s"),
            x.bitwiseAND(F.lit(ID)).cast("int").alias("id"),
        )

    masked = grouped.select("word", F.transform(F.sort_array("edges"), mask).alias("masks"))
    folded = masked.select("word", "masks", fold_edges(F.col("masks"), F.col("word")).alias("bounds"))
    return folded.select("word", chosen_ids(F.col("masks"), F.col("bounds"), F.col("word"), pieces).alias("ids"))


def fold_in_arrays(word: str, edges: list[tuple], pieces: Pieces) -> list[int]:
    """The ids of a word from its edges (place, start, end, id): the fold of fold_edges, with bounds in arrays."""
    end, ids = list(range(1, len(word) + 1)), [-1] * len(word)
    for _, b, a, i in sorted((place, b, -a, i) for place, a, b, i in edges):
        a = -a
        mid = end[a]
        if mid and mid < b and end[mid] == b:
            end[a], end[mid], ids[a] = b, 0, i
    out, at = [], 0
    while at < len(word):
        out += [ids[at]] if ids[at] >= 0 else pieces.ids(word[at])
        at = end[at]
    return out


def _fold_long(shared):
    def run(batches):
        pieces: Pieces = shared.value
        for batch in batches:
            for word, edges in zip(batch.column(0), batch.column(1)):
                word = word.as_py()
                rows = [edges.values.field(k).to_pylist() for k in range(4)] if edges.is_valid else [[]] * 4
                yield pa.RecordBatch.from_arrays(
                    [pa.array([word], pa.string()), pa.array([fold_in_arrays(word, list(zip(*rows)), pieces)], pa.list_(pa.int32()))], ["word", "ids"]
                )

    return run


def encode_long_words(words: DataFrame, pieces: Pieces, shared) -> DataFrame:
    """(word, ids) of words(word), distinct and of any length: chunks that overlap by the longest piece give the edges."""
    keyed = words.select("word", F.coalesce(F.sha2("word", 256), F.lit("")).alias("key"))
    bases = keyed.select("key", "word", F.explode(F.expr(f"sequence(0, char_length(word) - 1, {CHUNK})")).alias("base"))
    parts = bases.select("key", "base", F.expr(f"substring(word, base + 1, {CHUNK + pieces.longest - 1})").alias("part"))
    n = F.char_length("part")
    starts = parts.select("key", "base", "part", F.explode(F.sequence(F.lit(0), F.least(n, F.lit(CHUNK)) - 1)).alias("s"))
    spans = starts.select("*", F.explode(F.sequence(F.col("s") + 1, F.least(n, F.col("s") + pieces.longest))).alias("e"))
    subs = spans.selectExpr("key", "substring(part, s + 1, e - s) as sub", "base + s as a", "base + e as b")
    found = subs.join(_edge_table(words, pieces, "struct(place, id) as piece"), "sub")
    edges = found.groupBy("key").agg(F.collect_list(F.struct("piece.place", "a", "b", "piece.id")).alias("edges"))
    return keyed.join(edges, "key", "left").select("word", "edges").mapInArrow(_fold_long(shared), "word string, ids array<int>")


def packed_ids(ids: Column, pieces: Pieces) -> Column:
    """An array of ids as bytes, each as wide as the vocabulary needs; a column expression, so rows stay where they are."""
    width = array(pieces.code).itemsize
    every = F.lit(array(pieces.code, range(len(pieces.names))).tobytes())
    return F.aggregate(ids, F.lit(b""), lambda done, i: F.concat(done, F.substring(every, i * width + 1, F.lit(width))))


def _digest(text: str) -> int:
    return xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass"), 42)


def _frequent(batches):
    """(token, n): space-delimited tokens of a partition of the sample."""
    tokens = Counter()
    for batch in batches:
        for text in batch.column(0).to_pylist():
            tokens.update((text or "").replace("▁", " ").split(" "))
    yield pa.RecordBatch.from_arrays([pa.array(list(tokens), pa.string()), pa.array(list(tokens.values()), pa.int64())], ["token", "n"])


def _words_of(shared):
    """(token, n): the words of counted tokens, with the tokens' counts."""

    def run(batches):
        pieces, words = shared.value, Counter()
        for batch in batches:
            for token, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for word in pieces.words(token) if token else [" "]:
                    words[word] += n
        names = [w for w in words if len(w) <= LONGEST]
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([words[w] for w in names], pa.int64())], ["token", "n"])

    return run


def _cut(shared):
    """(token, words): tokens none of whose words is over LONGEST, and these words."""

    def run(batches):
        pieces = shared.value
        for batch in batches:
            cut = [(t, pieces.words(t) if t else [" "]) for t in batch.column(0).to_pylist()]
            kept = [(t, words) for t, words in cut if max(map(len, words)) <= LONGEST]
            yield pa.RecordBatch.from_arrays(
                [pa.array([t for t, _ in kept], pa.string()), pa.array([w for _, w in kept], pa.list_(pa.string()))], ["token", "words"]
            )

    return run


class Head:
    """Frequent tokens, then words, whose codes are their numbers, and their ids one after another.

    The driver holds columns only; the codes by token and by word are made where texts are read, once a Python worker.
    """

    def __init__(self, pieces: Pieces, tokens: pa.Array, words: pa.Array, flat: bytes, ends: np.ndarray):
        self.pieces, self.names, self.flat, self.ends = pieces, (tokens, words), flat, ends

    @cached_property
    def codes(self) -> tuple[dict[str, int], dict[str, int]]:
        tokens, words = self.names
        first = len(tokens)  # frequent tokens get small codes, words follow
        return dict(zip(tokens.to_pylist(), range(first))), dict(zip(words.to_pylist(), range(first, first + len(words))))


class Coder:
    """Codes of texts: numbers of space-delimited tokens and of words in the head; words to look up follow from `first`."""

    def __init__(self, head: Head):
        self.pieces, self.first = head.pieces, len(head.ends)
        self.tokens, self.words = head.codes

    def _each(self, words: list[str], asked: dict[str, int]) -> list[int]:
        codes = list(map(self.words.get, words))
        if None in codes:
            for i, c in enumerate(codes):
                if c is None:
                    codes[i] = asked.setdefault(words[i], self.first + len(asked))
        return codes

    def _resolve(self, tokens: Iterable[str], asked: dict[str, int]) -> tuple[dict[str, int], dict[str, list[int]]]:
        """By token outside the head, each given once: the code of its word, or those of its words if it has several."""
        find, ask, first, cut = self.words.get, asked.setdefault, self.first, self.pieces.words
        one: dict[str, int] = {}
        several: dict[str, list[int]] = {}
        for t in tokens:
            if len(t) >= LONGEST or not t:
                several[t] = self._each(cut(t) if t else [" "], asked)
            elif t.isalpha():
                if (c := find(w := " " + t)) is None:
                    c = ask(w, first + len(asked))
                one[t] = c
            elif (body := t[:-1]).isalpha():
                if (c := find(w := " " + body)) is None:
                    c = ask(w, first + len(asked))
                if (d := find(t[-1])) is None:
                    d = ask(t[-1], first + len(asked))
                several[t] = [c, d]
            else:
                several[t] = self._each(cut(t), asked)
        return one, several

    def _tokens(self, text: str) -> list[str] | None:
        """The space-delimited tokens of a text; None where a word takes a run of spaces before it."""
        return None if "  " in text or text[0] == " " else text.split(" ")

    def asked(self, text: str | None) -> dict[str, int]:
        """The words of a text to look up, each with its code, in order of first appearance."""
        asked: dict[str, int] = {}
        if text:
            text = text.replace("▁", " ")
            if (tokens := self._tokens(text)) is None:
                self._each(self.pieces.words(text), asked)
            else:
                self._resolve(filterfalse(self.tokens.__contains__, dict.fromkeys(tokens)), asked)
        return asked

    def codes(self, text: str | None) -> list[int]:
        if not text:
            return []
        text = text.replace("▁", " ")
        if (tokens := self._tokens(text)) is None:
            return self._each(self.pieces.words(text), {})
        distinct = dict.fromkeys(tokens)
        code = dict(zip(distinct, map(self.tokens.get, distinct)))
        one, several = self._resolve([t for t, c in code.items() if c is None], {})
        code.update(one)
        codes = list(map(code.get, tokens))
        out, done, i = [], 0, -1
        for _ in range(codes.count(None)):
            i = codes.index(None, i + 1)
            out += codes[done:i]
            out += several[tokens[i]]
            done = i + 1
        return out + codes[done:] if done else codes


def _asked(known):
    """(uid, k, word): the words of each row that are not in the head, each once and numbered from 0."""

    def run(batches):
        coder = Coder(known.value)
        for batch in batches:
            for s in range(0, batch.num_rows, 512):
                uid, ks, words = [], [], []
                for u, text in zip(batch.column(0)[s : s + 512].to_pylist(), batch.column(1)[s : s + 512].to_pylist()):
                    asked = coder.asked(text)
                    uid += [u] * len(asked)
                    words += asked
                    ks += [k - coder.first for k in asked.values()]
                yield pa.RecordBatch.from_arrays([pa.array(uid, pa.int64()), pa.array(ks, pa.int32()), pa.array(words, pa.string())], ["uid", "k", "word"])

    return run


def _templates(known):
    """Each row's codes, packed, and a digest of its text behind the leading space."""

    def run(batches):
        coder = Coder(known.value)
        pack = zstandard.ZstdCompressor(level=3).compress
        for batch in batches:
            for s in range(0, batch.num_rows, 512):
                part = batch.slice(s, 512)
                bodies, digests = [], []
                for text in part.column(1).to_pylist():
                    codes = coder.codes(text)
                    planes = np.array(codes, dtype="<u4").view(np.uint8).reshape(-1, 4).T  # bytes of one weight pack well
                    bodies.append(pack(planes.tobytes()))
                    digests.append(None if text is None else _digest(" " + text if text else ""))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), *part.columns[2:], pa.array(bodies, pa.binary()), pa.array(digests, pa.uint64()).view(pa.int64())],
                    [part.schema.names[0], *part.schema.names[2:], "body", "digest"],
                )

    return run


def _filled(known):
    """Rows (body, digest, got, doc_id, ...) with the ids of their codes: those of the head, and those in got.

    An entry of got is the number of a word among those its row looks up, in four bytes, and the word's ids.
    """

    def run(batches):
        pieces, flat, ends = known.value.pieces, known.value.flat, known.value.ends
        head = len(ends)
        kind = np.dtype(f"u{array(pieces.code).itemsize}")
        own, begin = np.frombuffer(flat, dtype=kind), np.concatenate([[0], ends[:-1]]).astype(np.int64)
        size = (ends - begin).astype(np.int64)
        unpack = zstandard.ZstdDecompressor().decompress
        unit, name_of = kind.itemsize, pieces.names.__getitem__
        in_bytes = np.zeros(len(pieces.names), dtype=bool)
        in_bytes[list(pieces.byte_of)] = True

        def text_of(ids: np.ndarray) -> str:
            return decode_ids(ids.tolist(), pieces.names, pieces.byte_of) if in_bytes[ids].any() else "".join(map(name_of, ids.tolist()))

        for batch in batches:
            for s in range(0, batch.num_rows, 512):
                part = batch.slice(s, 512)
                raw = [np.frombuffer(unpack(x.as_py()), dtype=np.uint8).reshape(4, -1).T.copy().view("<u4").ravel() for x in part.column(0)]
                words = np.array([len(x) for x in raw])
                code, row = np.concatenate(raw).astype(np.int64), np.repeat(np.arange(len(raw)), words)
                got = part.column(2)
                lists = pa.array(got.to_pylist(), got.type) if got.offset else got
                found = lists.flatten()
                counts = np.diff(lists.offsets.to_numpy()) if len(lists) else np.zeros(0, dtype=np.int64)
                owner = np.repeat(np.arange(len(raw)), counts)
                asked = np.array([max(0, int(x.max()) + 1 - head) if len(x) else 0 for x in raw])
                if not np.array_equal(asked, counts):
                    raise ValueError("words of a row were lost, or docs gave other rows when read again")
                entries = found.to_pylist()
                packed = [x[4:] for x in entries]
                more = np.array([len(x) // unit for x in packed], dtype=np.int64)
                numbers = np.frombuffer(b"".join([x[:4] for x in entries]), dtype=">u4").astype(np.int64)
                place = (owner << 32) + numbers + head
                order = np.argsort(place)
                source = np.concatenate([own, np.frombuffer(b"".join(packed), dtype=kind)]).astype(np.int32)
                first = len(own) + np.cumsum(more) - more
                known_ = code < head
                start, n = np.empty(len(code), dtype=np.int64), np.empty(len(code), dtype=np.int64)
                start[known_], n[known_] = begin[code[known_]], size[code[known_]]
                at = order[np.searchsorted(place[order], (row[~known_] << 32) + code[~known_])]
                start[~known_], n[~known_] = first[at], more[at]
                ids = source[np.repeat(start - (np.cumsum(n) - n), n) + np.arange(n.sum())]
                pieces_of = np.bincount(row, weights=n, minlength=len(raw)).astype(np.int64)
                bounds = np.concatenate([[0], np.cumsum(pieces_of)])
                same = [None if d is None else _digest(text_of(ids[a:b])) == d % (1 << 64) for d, a, b in zip(part.column(1).to_pylist(), bounds, bounds[1:])]
                offsets = pa.array(bounds, pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [part.column(3), pa.ListArray.from_arrays(offsets, pa.array(ids, pa.int32())), pa.array(pieces_of), pa.array(same, pa.bool_()), *part.columns[4:]],
                    ["doc_id", "ids", "n_pieces", "round_trip", *part.schema.names[4:]],
                )

    return run


def _head(texts: DataFrame, pieces: Pieces, shared, most: int) -> Head:
    """The words most frequent in a sample of texts(doc_id, text), at most `most`, half as many tokens, and all words of these.

    Spark cuts the tokens and the lattice encodes the words. Only Arrow columns of the chosen ones reach the driver.
    """
    share = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30)) < int(min(1.0, HEAD_DOCS / max(texts.count(), 1)) * (1 << 30))
    found = texts.where(share).select("text").mapInArrow(_frequent, "token string, n long")
    tokens = stored(found.groupBy("token").agg(F.sum("n").alias("n")))
    words_seen = tokens.mapInArrow(_words_of(shared), "token string, n long").groupBy("token").agg(F.sum("n").alias("n"))
    top = lambda counted, k: counted.orderBy(F.desc("n"), "token").limit(k).select("token")
    cut = stored(top(tokens, most // 2).mapInArrow(_cut(shared), "token string, words array<string>"))
    words = cut.select(F.explode("words").alias("word")).union(top(words_seen, most)).repartition(8, "word").distinct()
    coded = encode_words(words, pieces).select("word", packed_ids(F.col("ids"), pieces).alias("ids")).toArrow()
    names, ids = coded["word"].combine_chunks(), coded["ids"].combine_chunks()
    frequent = cut.toArrow()
    lists = frequent["words"].combine_chunks()
    at = pc.index_in(lists.flatten(), value_set=names)
    if at.null_count:
        raise ValueError("words of frequent tokens were lost")
    parts = pa.concat_arrays([ids.take(at), ids])  # by word of each token, then by word
    bounds = np.concatenate([[0], np.cumsum(pc.binary_length(parts).to_numpy(), dtype=np.int64)]) // array(pieces.code).itemsize
    last = np.concatenate([np.cumsum(pc.list_value_length(lists).to_numpy(), dtype=np.int64), np.arange(len(at) + 1, len(parts) + 1)])
    flat = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(parts)], pa.int32()), parts), b"")[0].as_py()
    ends = bounds[last]
    del coded, ids, parts, lists
    pa.default_memory_pool().release_unused()
    return Head(pieces, frequent["token"].combine_chunks(), names, flat, ends)


def encode(docs: DataFrame, path: str, carry: tuple[str, ...] = (), head: int = HEAD) -> DataFrame:
    """One row per row of docs(doc_id, text): doc_id, ids, n_pieces, round_trip, and the columns of docs named in carry.

    ids are the library's for the whole text, without begin or end tokens; null and empty texts have none. round_trip
    tells whether decoding gives the text back (null for a null text; false where it holds the space mark itself).
    Repeated rows stay, each with its ids; a null doc_id stays null. Very long texts take the same path as any. Words over
    LONGEST characters go through the same lattice in chunks and are folded over arrays in Python, whatever the table's size.
    An empty table gives an empty result. Columns of docs that are not named in carry play no part, whatever their names.

    Words outside the head are encoded once for all documents that hold them and sent to where the rows' packed codes go.
    Each of them has a bounded share of all words, so neither the join by word nor a document's own list is a group that
    grows with the table. docs is read twice and should be a scan of files, whose partitions are the same each time; a
    row whose words don't come back whole raises an error.
    """
    spark = docs.sparkSession
    pieces = Pieces(path)
    shared = spark.sparkContext.broadcast(pieces)

    known = spark.sparkContext.broadcast(_head(docs.select("doc_id", "text"), pieces, shared, head))

    named = {f"carry_{k}": c for k, c in enumerate(carry)}
    rows = docs.select(F.monotonically_increasing_id().alias("uid"), "text", F.col("doc_id").cast("long").alias("doc_id"), *[F.col(c).alias(a) for a, c in named.items()])
    kept = [rows.schema["uid"], *rows.schema.fields[2:]]
    # one exchange serves the grouping and the joins: no filter or pruning may differ below it
    sent = rows.select("uid", "text").mapInArrow(_asked(known), "uid long, k int, word string")
    sent = sent.where("word is not null and uid is not null").repartition("word")
    counted = F.count_if(F.col("uid").isNotNull() & F.col("k").isNotNull()).alias("n")
    # the factor is always 1: it keeps the filter above the exchange, so that only long words are sorted for their join
    wide = sent.where((F.char_length("word") - LONGEST) * F.floor(1 + F.rand(0)) > 0)
    words = sent.groupBy("word").agg(counted)
    short, long = words.where(F.col("n") * (LONGEST + 1 - F.char_length("word")) > 0), wide.groupBy("word").agg(counted).where("n > 0")
    number = F.unhex(F.lpad(F.hex("k"), 8, "0"))
    # a partition's distinct words are fewer than its rows and no word is frequent: hashed, the rows need no sort
    answers = [
        asked.join(found.select("word", packed_ids(F.col("ids"), pieces).alias("ids")).hint("shuffle_hash"), "word").select("uid", F.concat(number, "ids").alias("got"))
        for asked, found in ((sent, encode_words(short, pieces)), (wide, encode_long_words(long, pieces, shared)))
    ]
    own = answers[0].unionByName(answers[1]).groupBy("uid").agg(F.collect_list("got").alias("got"))
    templates = rows.mapInArrow(_templates(known), StructType([*kept, *StructType.fromDDL("body binary, digest long").fields]))
    paired = templates.join(own, "uid", "left").select("body", "digest", F.coalesce("got", F.array().cast("array<binary>")).alias("got"), "doc_id", *named)
    fields = StructType.fromDDL("doc_id long, ids array<int>, n_pieces long, round_trip boolean").fields
    out = paired.mapInArrow(_filled(known), StructType([*fields, *[StructField(a, rows.schema[a].dataType) for a in named]]))
    return out.select("doc_id", "ids", "n_pieces", "round_trip", *[F.col(a).alias(c) for a, c in named.items()])


def decode_ids(ids, names: list[str], byte_of: dict[int, int]) -> str:
    """The text of ids with its leading space; runs of byte pieces are UTF-8, ill-formed bytes U+FFFD."""
    if byte_of.keys().isdisjoint(ids):
        return "".join([names[i] for i in ids])
    out, run = [], bytearray()
    for i in ids:
        if i in byte_of:
            run.append(byte_of[i])
            continue
        if run:
            out.append(run.decode("utf-8", "replace"))
            run.clear()
        out.append(names[i])
    out.append(run.decode("utf-8", "replace"))
    return "".join(out)


def _decode(shared):
    def run(batches):
        pieces: Pieces = shared.value
        for batch in batches:
            texts = []
            for ids in batch.column(1).to_pylist():
                text = None if ids is None else decode_ids(ids, pieces.names, pieces.byte_of)
                texts.append(text[1:] if text and text[0] == " " else text)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return run


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """(doc_id, text) of encoded(doc_id, ids); null ids give null, no ids an empty text."""
    shared = encoded.sparkSession.sparkContext.broadcast(Pieces(path))
    rows = encoded.select("doc_id", "ids")
    return rows.mapInArrow(_decode(shared), f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, text string")


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of every document by piece_bpe_32k.model."""
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return encode(docs, public_tokenizers.path("piece_bpe_32k.model"))


QUERIES = {"op9_sentencepiece": op9_sentencepiece}
