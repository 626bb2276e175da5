"""Document fingerprints by locally consistent parsing.

Deterministic coin tossing cuts a sequence into phrases by looking at a few neighbours only; phrases get names (a hash
of the names inside), and the names are cut again, level by level. Equal stretches of two texts thus get equal phrases
but for a few at their rims, wherever they stand. A fingerprint keeps the least hashes of the names of some levels.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lakeloom.llm.common import table, tune, written

#: Cells of a fingerprint, each of four hex digits.
CELLS = 64
#: Level from whose phrases on (about 25 characters and more) a fingerprint is made.
FIRST = 3
LEVELS = 24
#: Characters that are parsed at once, of several texts or as a stretch of a longer one; the arrays take about a
#: hundred bytes for each.
SYMBOLS = 1 << 17
M1, M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
EMPTY = 0xFFFF


def mix(x: np.ndarray) -> np.ndarray:
    """A fixed bijection on 64 bits that spreads every input bit (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * M1
    x = (x ^ (x >> np.uint64(27))) * M2
    return x ^ (x >> np.uint64(31))


#: What the place of a name in its phrase adds to it; phrases are shorter than this but by contrivance.
PLACES = mix(np.arange(1, 65, dtype=np.uint64))


def _toss(names: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Where phrases start, for names of which no two neighbours in a text are equal; first: where texts start.

    Each round replaces a label by the position of the lowest bit in which it differs from its left neighbour's,
    and that bit; neighbours stay different and after three rounds fewer than eight labels are left. Local maxima
    of the labels, which any window of a few labels has, start phrases.
    """
    labels = names
    for _ in range(3):
        left = np.empty_like(labels)
        left[1:] = labels[:-1]
        left[0] = ~labels[0]
        left[first] = ~labels[first]
        low = labels ^ left
        one = low.dtype.type(1)
        low &= ~low + one
        place = np.bitwise_count(low - one).astype(np.uint8)
        labels = (place << np.uint8(1)) | ((labels & low) != 0).astype(np.uint8)
    rise, fall = np.ones(len(labels), bool), np.ones(len(labels), bool)
    np.greater(labels[1:], labels[:-1], out=rise[1:])
    np.greater(labels[:-1], labels[1:], out=fall[:-1])
    top = rise & fall
    # Before a text's first and after its last label there is nothing to compare with: no maximum there, so that a
    # text's rim doesn't depend on its neighbour in the batch.
    top[first] = False
    top[first[1:] - 1] = False
    top[-1] = False
    top[first] = True
    return top


def levels(names: np.ndarray, sizes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(names, names per text) of each level above the symbols, for texts laid end to end.

    Runs of equal symbols become one name first: (symbol, length). A text that is down to one name goes no further,
    so its levels don't depend on the texts beside it.
    """
    for _ in range(LEVELS):
        alone = sizes == 1
        if alone.any():
            names = names[~np.repeat(alone, sizes)]
            sizes = np.where(alone, 0, sizes)
        if not len(names):
            return
        texts = np.flatnonzero(sizes)
        first = (np.cumsum(sizes) - sizes)[texts]
        change = np.ones(len(names), bool)
        np.not_equal(names[1:], names[:-1], out=change[1:])
        change[first] = True
        at = np.flatnonzero(change)
        if len(at) < len(names):
            length = np.diff(at, append=len(names))
            wide = names[at].astype(np.uint64)
            long = length > 1
            wide[long] = mix(wide[long] + np.uint64(0x9E3779B97F4A7C15) * length[long].astype(np.uint64))
            names = wide
            first = np.searchsorted(at, first)
        start = _toss(names, first)
        where = np.flatnonzero(start)
        names = _named(names, where)
        kept = np.zeros(len(sizes), np.int64)
        kept[texts] = np.diff(np.searchsorted(where, np.append(first, len(start))))
        sizes = kept
        yield names, sizes


class Level:
    """One level of a text that comes in stretches: names go in, the names of its phrases come out as they are settled.

    The same phrases as levels() makes of the whole text. A label depends on the three names before it and a phrase's
    start on the labels beside it, so four names are kept from before the phrase that is still open.
    """

    def __init__(self) -> None:
        self.count = 0  # names that came in
        self.run: tuple[np.uint64, int] | None = None  # the last run of equal names, still open: the name, how often
        self.kept = np.empty(0, np.uint64)  # the open phrase and what is before it
        self.open = 0  # where it starts there

    def _runs(self, names: np.ndarray, end: bool) -> np.ndarray:
        at = np.flatnonzero(np.append(True, names[1:] != names[:-1])) if len(names) else np.empty(0, np.int64)
        values, lengths = names[at].astype(np.uint64), np.diff(at, append=len(names))
        if self.run is not None:
            if len(values) and values[0] == self.run[0]:
                lengths[0] += self.run[1]
            else:
                values, lengths = np.append(self.run[0], values), np.append(self.run[1], lengths)
            self.run = None
        if len(values) and not end:
            self.run = values[-1], int(lengths[-1])
            values, lengths = values[:-1], lengths[:-1]
        long = lengths > 1
        values[long] = mix(values[long] + np.uint64(0x9E3779B97F4A7C15) * lengths[long].astype(np.uint64))
        return values

    def feed(self, names: np.ndarray, end: bool) -> np.ndarray:
        self.count += len(names)
        names = np.append(self.kept, self._runs(names, end))
        if not len(names) or (end and self.count == 1):  # a text that is down to one name goes no further
            return np.empty(0, np.uint64)
        start = _toss(names, np.zeros(1, np.int64))
        settled = len(names) if end else len(names) - 1
        where = np.append(self.open, np.flatnonzero(start[self.open + 1 : settled]) + self.open + 1)
        stop = len(names) if end else int(where[-1])
        made = np.empty(0, np.uint64)
        if stop > self.open:
            begins = where if end else where[:-1]
            made = _named(names[self.open : stop], begins - self.open)
        first = max(0, stop - 4)
        self.kept, self.open = names[first:], stop - first
        return made


def _named(names: np.ndarray, where: np.ndarray) -> np.ndarray:
    """The names of the phrases that start at `where` and fill `names`."""
    place = np.arange(len(names)) - np.repeat(where, np.diff(where, append=len(names)))
    mixed = mix(names.astype(np.uint64) + PLACES[np.minimum(place, len(PLACES) - 1)])
    return mix(np.add.reduceat(mixed, where))


#: Above all that a cell can hold: 48 bits of a hash, of which the last 16 are shown.
FULL = np.uint64(1 << 48)


def _lower(cells: np.ndarray, names: np.ndarray, owner: np.ndarray | int = 0) -> None:
    """Puts the names into the cells of their owners, where the least hash stays."""
    hashed = mix(names.astype(np.uint64) + np.uint64(77))
    cell = (hashed >> np.uint64(58)).astype(np.int64) + np.asarray(owner) * CELLS
    np.minimum.at(cells, cell, hashed & (FULL - np.uint64(1)))


def _shown(cells: np.ndarray) -> list[str]:
    low = np.minimum(cells & np.uint64(0xFFFF), np.uint64(EMPTY - 1))
    raw = np.where(cells == FULL, np.uint64(EMPTY), low).astype(">u2").tobytes().hex()
    return [raw[i : i + CELLS * 4] for i in range(0, len(raw), CELLS * 4)]


def _symbols(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def sketches(texts: list[str]) -> list[str]:
    """A fingerprint for each text: CELLS cells of four hex digits, the least hash in each cell or 'ffff' if empty.

    The names of the levels from FIRST on count; a text that has none there counts the names of all its levels, a
    text of one character that character. Empty: all cells empty. Texts are parsed together up to SYMBOLS characters;
    a longer one goes through in stretches of as many, so memory stays bounded.
    """
    out: list[str] = []
    begin = size = 0
    for i, text in enumerate(texts):
        if size + len(text) > SYMBOLS:
            out += _together(texts[begin:i])
            begin, size = i, 0
        if len(text) > SYMBOLS:
            out.append(in_stretches(text[k : k + SYMBOLS] for k in range(0, len(text), SYMBOLS)))
            begin = i + 1
        else:
            size += len(text)
    return out + _together(texts[begin:])


def _together(texts: list[str]) -> list[str]:
    if not texts:
        return []
    symbols, sizes = _symbols("".join(texts)), np.fromiter(map(len, texts), np.int64, len(texts))
    made = [(symbols, sizes), *levels(symbols, sizes)]
    depth = np.zeros(len(texts), np.int64)
    for i, (_, n) in enumerate(made):
        depth[n > 0] = i
    cells = np.full(len(texts) * CELLS, FULL, np.uint64)
    for i, (names, n) in enumerate(made):
        owner = np.repeat(np.arange(len(texts)), n)
        if i < FIRST:
            mine = ((depth < FIRST) if i else (depth == 0))[owner]
            names, owner = names[mine], owner[mine]
        _lower(cells, names, owner)
    return _shown(cells)


def in_stretches(parts: Iterable[str]) -> str:
    """The fingerprint of the text that the parts make up; only they and what is open on each level are held."""
    chain: list[Level] = []
    cells = [np.full(CELLS, FULL, np.uint64) for _ in range(FIRST + 1)]  # of each level below FIRST, of all from it on
    depth = 0

    def push(level: int, names: np.ndarray, end: bool) -> None:
        nonlocal depth
        if len(names):
            depth = max(depth, level)
            _lower(cells[min(level, FIRST)], names)
            if level == len(chain) < LEVELS:
                chain.append(Level())
        if level < len(chain):
            push(level + 1, chain[level].feed(names, end), end)

    for part in parts:
        push(0, _symbols(part), False)
    push(0, np.empty(0, np.uint32), True)
    if depth >= FIRST:
        return _shown(cells[FIRST])[0]
    return _shown(cells[0] if not depth else np.min(cells[1:], axis=0))[0]


def likeness(a: str, b: str) -> float:
    """Estimated share of common phrases, from 0 to 1: equal cells of those that are filled in either. Equal: 1."""
    if a == b:
        return 1.0
    x, y = (np.frombuffer(bytes.fromhex(s), ">u2") for s in (a, b))
    filled = (x != EMPTY) | (y != EMPTY)
    return float(np.count_nonzero((x == y) & filled) / np.count_nonzero(filled))


def edited(text: str, following: str) -> Iterator[str]:
    """text with its last half replaced by the start of the following text, as long or all of it; in stretches."""
    half = len(text) // 2
    for part, size in ((text, len(text) - half), (following, min(half, len(following)))):
        for k in range(0, size, SYMBOLS):
            yield part[k : min(size, k + SYMBOLS)]


def _compare(ids: list, texts: list[str], next_texts: list[str]) -> list[list]:
    """The result columns for documents and the text that follows each."""
    digests, other = [], []
    changed: list[str] = []  # edited texts that are short, to be parsed together
    for text, following in zip(texts, next_texts, strict=True):
        hashed = hashlib.sha256()
        for part in edited(text, following):
            hashed.update(part.encode("utf-8", "surrogatepass"))
        digests.append(hashed.hexdigest())
        if len(text) > SYMBOLS:
            other += [*sketches(changed), in_stretches(edited(text, following))]
            changed.clear()
        else:
            changed.append("".join(edited(text, following)))
    other += sketches(changed)
    own = sketches(texts)
    # Within a batch the next text is the next document's, but for the last one.
    last = sketches(next_texts[-1:]) if texts else []
    following = own[1:] + last
    return [
        ids, [len(t) for t in texts], digests, own, other,
        [likeness(a, b) for a, b in zip(own, other, strict=True)],
        [likeness(a, b) for a, b in zip(own, following, strict=True)],
    ]


RESULT = "n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def fingerprinted(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, n_chars, fingerprint and the comparison with its edited text and the next document.

    Next is the row that follows by descending doc_id (null ids last, ties by a hash of the text), and after the last the first. A
    null text is empty; a long one is parsed in stretches. One row follows itself; an empty table gives an empty result;
    other columns are not read, whatever their names.

    The texts are dealt once, by ranges of doc_id, and read in order, so a row's successor is at hand; a task's last
    row waits with its text. The first rows of the tasks, one each, are joined to those waiting by the number of the
    task. So no text is moved twice and no group of rows meets in one task.
    """
    spark = docs.sparkSession
    tune(spark)
    kind = docs.select("doc_id").schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, {RESULT}, part int, role string, text string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        waiting: tuple | None = None
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(out)

        def rows(columns: list[list], role: str, texts: list) -> pa.RecordBatch:
            n = len(columns[0])
            every = [*columns, [part] * n, [role] * n, texts]
            return pa.RecordBatch.from_arrays([pa.array(v, type=f.type) for v, f in zip(every, arrow, strict=True)], schema=arrow)

        blank = lambda ids: [ids, *[[None] * len(ids) for _ in range(6)]]
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), [t or "" for t in batch.column(1).to_pylist()]
            if not ids:
                continue
            if waiting is None:
                yield rows(blank(ids[:1]), "first", texts[:1])
            else:
                ids, texts = [waiting[0], *ids], [waiting[1], *texts]
            waiting = (ids[-1], texts[-1])
            if len(ids) > 1:
                yield rows(_compare(ids[:-1], texts[:-1], texts[1:]), "done", [None] * (len(ids) - 1))
        if waiting is not None:
            yield rows(blank([waiting[0]]), "last", [waiting[1]])

    out = StructType.fromDDL(schema)
    # Ranges are drawn from samples that the driver holds, so they go by numbers alone.
    order = [F.col("doc_id").desc_nulls_last(), F.xxhash64("text")]
    dealt = docs.select("doc_id", "text").repartitionByRange(*order).sortWithinPartitions(*order, F.col("text").asc_nulls_first())
    # Written as bytes, half of what they take in digits.
    hexed = ("edited_sha256", "fingerprint", "edited_fingerprint")
    made = written(dealt.mapInArrow(run, schema).withColumns({c: F.unhex(c) for c in hexed}), "parsed")
    done = made.where("role = 'done'").withColumns({c: F.lower(F.hex(c)) for c in hexed})
    done = done.select("doc_id", *[c.split()[0] for c in RESULT.split(", ")])
    # One row for each task, of numbers only, goes through the window; the texts are joined afterwards.
    parts = made.where("role = 'first'").select("part")
    ring = Window.orderBy("part")
    every = Window.partitionBy()
    following = parts.select("part", F.coalesce(F.lead("part").over(ring), F.min("part").over(every)).alias("next"))
    heads = made.where("role = 'first'").select(F.col("part").alias("next"), F.col("text").alias("next_text"))
    pairs = made.where("role = 'last'").select("doc_id", "text", "part").join(following, "part").join(heads, "next")

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(ending)
        for batch in batches:
            columns: list[list] = [[] for _ in arrow]
            for one in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                for column, value in zip(columns, _compare([one[0]], [one[1]], [one[2]]), strict=True):
                    column += value
            yield pa.RecordBatch.from_arrays([pa.array(v, type=f.type) for v, f in zip(columns, arrow, strict=True)], schema=arrow)

    ending = StructType.fromDDL(f"doc_id {kind}, {RESULT}")
    return done.unionByName(pairs.select("doc_id", "text", "next_text").mapInArrow(finish, ending))


def op8_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprinted(table(spark, sf_dir, "documents"))
