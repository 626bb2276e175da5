"""Packing documents into training sequences: a cutting-stock plan found by column generation.

Lengths are counted in classes of GRAIN tokens, of texts too short for that in finer ones. A linear program over patterns (which classes share a sequence) is
solved with columns priced by a knapsack recursion; its solution is rounded down, the rest is placed first-fit, and
documents take the places of the plan by their rank within their class. All of that depends on a histogram of at most
CAPACITY numbers, whatever the size of the corpus. A share of documents, found by a hash of doc_id and as large as the
plan's slack asks for, is held back and cut to fill what the sequences have left.
"""

from __future__ import annotations

import gc
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lakeloom.llm.common import over_texts, table, written

CAPACITY, GRAIN, END = 4096, 16, 2
#: Tokens that rounding to classes may add, as a part of all; above it classes are made finer.
ROUNDING = 0.05
#: Sequences whose free places one task fills from the documents held back for them.
GROUP = 256
#: Documents in each bucket within which ranks are counted, about, until there are BUCKETS of them.
BUCKET, BUCKETS = 1_000, 20_000
VOCABULARY = "word_bpe_49k.json"
BLANK = re.compile("[\t-\r \x85\xa0  -     　]+")
#: What Python takes for blanks and the vocabulary does not.
ODD = frozenset("\x1c\x1d\x1e\x1f")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)

#: The characters by which byte-level vocabularies name bytes: printable ones themselves, the others from 256 on.
_shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
BYTES = {b: b for b in _shown} | {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in _shown)}


#: What the tokenizer's rule takes as units, of lower-case Latin-1 without blanks: endings after an apostrophe, letters,
#: single digits (fractions and raised ones too), all else.
UNIT = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[^\\W\\d_\xb2\xb3\xb9\xbc-\xbe]+|[0-9\xb2\xb3\xb9\xbc-\xbe]|(?:[^\\w\\s]|_)+")


class Encoder(dict):
    """Word in lower case -> its token ids as little-endian 32-bit numbers.

    The vocabulary's rules never join anything across a blank, so a text's ids are those of the chunks between blanks,
    in order. Texts of Latin-1 characters go a short way: the normaliser changes nothing in them but case, and UNIT
    splits a chunk as the tokenizer's own rule does. Chunks are remembered, at most `limit` in each of two
    generations. All other texts are encoded chunk by chunk by the tokenizer itself.
    """

    def __init__(self, path: str, limit: int = 300_000) -> None:
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer, self.limit, self.older = Tokenizer.from_file(path), limit, {}
        self.others: dict[str, bytes] = {}
        self.pieces = self.tokenizer.model.tokenize
        self.named = [i.to_bytes(4, "little") for i in range(self.tokenizer.get_vocab_size())]

    def other(self, chunk: str) -> bytes:
        out = self.others.get(chunk)
        if out is None:
            out = self.rules(chunk)
            if len(self.others) >= self.limit:
                self.others.clear()
            if len(chunk) <= 64:
                self.others[chunk] = out
        return out

    def rules(self, chunk: str) -> bytes:
        return np.array(self.tokenizer.encode(chunk, add_special_tokens=False).ids, "<u4").tobytes()

    def __missing__(self, chunk: str) -> bytes:
        out = self.older.get(chunk)
        if out is None:
            if not chunk.isalpha() and len(units := UNIT.findall(chunk)) > 1:
                out = b"".join([self[u] for u in units])
            else:
                named = self.named
                text = chunk if chunk.isascii() and chunk.isalnum() else chunk.encode().decode("latin-1").translate(BYTES)
                out = b"".join([named[t.id] for t in self.pieces(text)])
        if len(chunk) <= 64:
            if len(self) >= self.limit:
                self.older = dict(self)
                self.clear()
            self[chunk] = out
        return out

    def ids(self, text: str | None) -> bytes:
        """The ids of a whole text, with END after them; null counts as empty."""
        if not text:
            return END_BYTES
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            short = False
        else:  # names of special tokens are told from words by their case
            short = "<|" not in text and not any(c in text for c in ODD)
        if short:
            return b"".join(map(self.__getitem__, text.lower().split())) + END_BYTES
        return b"".join([self.other(c) for c in BLANK.split(text) if c]) + END_BYTES


END_BYTES = np.array([END], "<u4").tobytes()
_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One for each worker process, kept over its tasks."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def _cut(ids: list, salts: list, texts: list, path: str) -> list:
    out: list[list] = [[], [], [], [], [], []]
    known = encoder(path)
    gc.disable()  # no cycles are made here, and looking for some takes a tenth of the time
    try:
        for one, salt, text in zip(ids, salts, texts, strict=True):
            data = known.ids(text)
            for at in range(0, len(data), 4 * CAPACITY):
                part = data[at : at + 4 * CAPACITY]
                for column, value in zip(out, (one, at // 4, len(part) // 4, zlib.crc32(part), len(data) // 4, salt), strict=True):
                    column.append(value)
    finally:
        gc.enable()
    return out


def _held(ids: list, groups: list, ranks: list, texts: list, path: str) -> list:
    known = encoder(path)
    return [ids, groups, ranks, [known.ids(t) for t in texts]]


# --- the plan -------------------------------------------------------------------------------------------------------


def knapsack(sizes: np.ndarray, values: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The most valuable multiset of items that fits: its value and the number of each item. sizes ascend."""
    best = np.zeros(capacity + 1)
    taken = np.full(capacity + 1, -1)
    fits = np.searchsorted(sizes, np.arange(capacity + 1), side="right")
    for room in range(1, capacity + 1):
        best[room] = best[room - 1]
        if n := fits[room]:
            worth = values[:n] + best[room - sizes[:n]]
            i = int(worth.argmax())
            if worth[i] > best[room] + 1e-12:
                best[room], taken[room] = worth[i], i
    counts, room = np.zeros(len(sizes), np.int64), capacity
    while room > 0:
        if taken[room] < 0:
            room -= 1
        else:
            counts[taken[room]] += 1
            room -= int(sizes[taken[room]])
    return float(best[capacity]), counts


def relax(sizes: np.ndarray, counts: np.ndarray, capacity: int, gap: float = 5e-4, rounds: int = 6000) -> list[tuple[np.ndarray, float]]:
    """Patterns and how often each is used, in numbers not whole: all items placed in the fewest sequences.

    Revised simplex; the start is one pattern for each size. It ends when the best new column proves by its price
    (Farley's bound) that no solution is better by more than `gap`.
    """
    per = capacity // sizes
    columns = np.diag(per).astype(float)
    inverse = np.diag(1.0 / per)
    used = counts / per
    for _ in range(rounds):
        price, column = knapsack(sizes, np.maximum(inverse.sum(axis=0), 0.0), capacity)
        if price <= 1 + gap:
            break
        step = inverse @ column
        ratio = np.full(len(step), np.inf)
        up = step > 1e-9
        ratio[up] = used[up] / step[up]
        out = int(ratio.argmin())
        amount = ratio[out]
        used = np.maximum(used - amount * step, 0.0)
        used[out] = amount
        row = inverse[out] / step[out]
        inverse -= np.outer(step, row)
        inverse[out] = row
        columns[:, out] = column
    return [(columns[:, i].astype(np.int64), float(used[i])) for i in range(len(sizes)) if used[i] > 1e-9]


def plan(histogram: dict[int, int], capacity: int = CAPACITY // GRAIN) -> list[tuple[dict[int, int], int]]:
    """([class -> places], sequences) that place each item of the histogram (class -> count) exactly once."""
    sizes = np.array(sorted(k for k, n in histogram.items() if n), np.int64)
    if not len(sizes):
        return []
    counts = np.array([histogram[int(s)] for s in sizes], np.int64)
    made: list[tuple[dict[int, int], int]] = []
    left = counts.copy()
    for pattern, used in relax(sizes, counts.astype(float), capacity):
        whole = int(used + 1e-6)
        if pattern.any():
            whole = min(whole, int((left[pattern > 0] // pattern[pattern > 0]).min()))
        if whole > 0:
            made.append(({int(s): int(n) for s, n in zip(sizes, pattern, strict=True) if n}, whole))
            left -= whole * pattern
    # What rounding left is at most a few sequences for each pattern: first fit, longest first, by equal bins.
    bins: list[tuple[int, dict[int, int]]] = []
    for size, n in zip(sizes[::-1].tolist(), left[::-1].tolist(), strict=True):
        while n:
            spot = min((i for i, (room, _) in enumerate(bins) if room >= size), key=lambda i: bins[i][0], default=-1)
            if spot < 0:
                bins.append((capacity, {}))
                spot = len(bins) - 1
            room, held = bins[spot]
            k = min(n, room // size)
            held[size] = held.get(size, 0) + k
            bins[spot] = (room - k * size, held)
            n -= k
    return made + [(held, 1) for _, held in bins]


class Places:
    """The plan as tables: for each class the ranks at which a pattern's places begin."""

    def __init__(self, patterns: list[tuple[dict[int, int], int]]) -> None:
        rows: dict[int, list[tuple[int, int, int]]] = {}
        filled: dict[int, int] = {}
        self.sequences = 0
        for held, n in patterns:
            for size, each in held.items():
                rows.setdefault(size, []).append((filled.get(size, 0), each, self.sequences))
                filled[size] = filled.get(size, 0) + each * n
            self.sequences += n
        self.by_class = {size: np.array(r, np.int64).T for size, r in rows.items()}

    def sequence(self, sizes: np.ndarray, ranks: np.ndarray) -> np.ndarray:
        """The sequence that holds the item of each class and rank, from 0."""
        out = np.empty(len(sizes), np.int64)
        for size in np.unique(sizes).tolist():
            mine = sizes == size
            begin, each, base = self.by_class[size]
            k = np.searchsorted(begin, ranks[mine], side="right") - 1
            out[mine] = base[k] + (ranks[mine] - begin[k]) // each[k]
        return out


# --- the corpus -----------------------------------------------------------------------------------------------------


def _unit(seed: int) -> Column:
    """A number from 0 to 1 that a row's id, a hash of its text and the seed fix: rows that share an id are spread."""
    return F.pmod(F.xxhash64(F.lit(seed), "doc_id", "salt"), F.lit(1 << 30)) / float(1 << 30)


def _lengths(pieces: DataFrame) -> dict[int, int]:
    return {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}


def size_of(length: int, unit: int) -> int:
    """The class of a length: the units it takes. Above 32 units steps double, up to GRAIN, so classes stay few."""
    step = unit
    while step < GRAIN and length > 32 * step:
        step *= 2
    return -(-length // step) * step // unit


def histogram_of(lengths: dict[int, int], unit: int) -> dict[int, int]:
    out: dict[int, int] = {}
    for length, n in lengths.items():
        size = size_of(length, unit)
        out[size] = out.get(size, 0) + n
    return out


def unit_for(lengths: dict[int, int]) -> int:
    """GRAIN, or the largest unit below it whose rounding adds no more than ROUNDING; 1 if none does."""
    tokens, unit = sum(k * n for k, n in lengths.items()), GRAIN
    while unit > 1 and sum(k * n for k, n in histogram_of(lengths, unit).items()) * unit * (1 - ROUNDING) > tokens:
        unit //= 2
    return unit


def held_share(slack: float) -> float:
    """The share of documents to hold back. Filling the free places takes the slack itself; more is for chance."""
    return min(2.5 * slack + 0.01, 0.15 + 0.85 * slack)


def groups_for(sequences: int, held: int) -> int:
    """Groups so that none has more than GROUP sequences of the plan or, on average, of tokens held back."""
    return max(1, -(-sequences // GROUP), -(-held // (GROUP * CAPACITY)))


def _fill(group: tuple, places: pd.DataFrame, held: pd.DataFrame, first_free: int, groups: int) -> pd.DataFrame:
    """Cuts the documents held back for a group into its free places, then into sequences of their own.

    The last of those would be padded; it is cut into sequences whose lengths are powers of two.
    """
    number = int(group[0])
    places = places.sort_values("sequence_id")
    spots = [(int(s), int(u), CAPACITY - int(u)) for s, u in zip(places["sequence_id"], places["used"], strict=True)]
    spots = [s for s in spots if s[2] > 0]
    held = held.sort_values(["rank", "doc_id"], kind="stable")
    total = sum(len(x) // 4 for x in held["ids"])
    rest = total - sum(s[2] for s in spots)
    extra = 0
    while rest > 0:
        width = CAPACITY if rest >= CAPACITY else 1 << (rest.bit_length() - 1)
        spots.append((first_free + number + groups * extra, 0, width))
        rest, extra = rest - width, extra + 1
    out: list[tuple] = []
    spot = iter(spots)
    sequence, offset, room = next(spot, (0, 0, 0))
    for doc_id, ids in zip(held["doc_id"], held["ids"], strict=True):
        start, n = 0, len(ids) // 4
        while start < n:
            if not room:
                sequence, offset, room = next(spot)
            k = min(room, n - start)
            out.append((doc_id, start, k, zlib.crc32(ids[4 * start : 4 * (start + k)]), n, sequence, offset))
            start, offset, room = start + k, offset + k, room - k
    return pd.DataFrame(out, columns=RESULT)


RESULT = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]


def packed(docs: DataFrame, path: str | None = None) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A document's ids are those of its whole text (null: none) and END, so every row of docs has a piece, and repeated
    rows have pieces each. Documents of more than CAPACITY ids are cut there; those held back are cut where a place
    ends. Hashes of doc_id and text deal the work, so null and repeated ids are spread. Texts of any length are encoded
    whole, one at a time. An empty table gives an empty result; other columns are not read, whatever their names. Reruns
    give the same pieces.
    """
    spark, path = docs.sparkSession, path or tokenizer_path()
    kind = docs.select("doc_id").schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long"
    docs = docs.select("doc_id", F.xxhash64("text").alias("salt"), "text")
    pieces = written(over_texts(docs, ["doc_id", "salt", "text"], f"{schema}, salt long", _cut, path), "pieces")
    lengths = _lengths(pieces)
    unit, tokens = unit_for(lengths), sum(k * n for k, n in lengths.items())
    sequences = sum(n for _, n in plan(histogram_of(lengths, unit), CAPACITY // unit))
    slack = 1 - tokens / (CAPACITY * sequences) if sequences else 0.0
    share = held_share(slack)

    step = F.lit(GRAIN)  # size_of() as a column
    for k in reversed([unit << i for i in range(GRAIN.bit_length()) if unit << i < GRAIN]):
        step = F.when(F.col("length") <= 32 * k, k).otherwise(step)
    pieces = pieces.withColumn("size", (F.ceil(F.col("length") / step) * step / unit).cast("int"))
    free = pieces.where(_unit(1) >= share)
    lengths = _lengths(free)
    buckets = min(BUCKETS, max(1, sum(lengths.values()) // BUCKET))
    places = Places(plan(histogram_of(lengths, unit), CAPACITY // unit))
    groups = groups_for(places.sequences, tokens - sum(k * n for k, n in lengths.items()))

    # Ranks within a class: counted within buckets, to which the counts of the buckets before are added.
    free = free.withColumn("bucket", F.floor(_unit(2) * buckets))
    here = Window.partitionBy("size", "bucket").orderBy("length", "doc_id", "start", "ids_crc32")
    before = Window.partitionBy("size").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    counts = free.groupBy("size", "bucket").agg(F.count("*").alias("n"))
    bases = counts.select("size", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    ranked = free.withColumn("rank", F.row_number().over(here) - 1).join(bases, ["size", "bucket"])
    ranked = ranked.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "size", (F.col("rank") + F.col("base")).alias("rank"))

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            batch["sequence_id"] = places.sequence(batch["size"].to_numpy(), batch["rank"].to_numpy())
            yield batch[RESULT[:-1]]

    placed = ranked.mapInPandas(place, f"{schema}, sequence_id long")
    order = Window.partitionBy("sequence_id").orderBy(F.desc("length"), "doc_id", "start", "ids_crc32")
    placed = placed.withColumn("offset", F.sum("length").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("length"))
    placed = written(placed, "placed")
    used = placed.groupBy("sequence_id").agg(F.sum("length").alias("used")).withColumn("group", F.pmod("sequence_id", F.lit(groups)))
    held = docs.where(_unit(1) < share)
    held = held.withColumn("group", F.floor(_unit(3) * groups)).withColumn("rank", F.xxhash64(F.lit(4), "doc_id", "salt"))
    held = over_texts(held, ["doc_id", "group", "rank", "text"], f"doc_id {kind}, group long, rank long, ids binary", _held, path)
    first_free = places.sequences

    def fill(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        return _fill(key, left, right, first_free, groups)

    filled = used.groupBy("group").cogroup(held.groupBy("group")).applyInPandas(fill, f"{schema}, sequence_id long, offset long")
    return placed.select(*RESULT).unionByName(filled)


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(table(spark, sf_dir, "documents"))
