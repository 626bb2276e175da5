"""SimHash near-duplicates: pigeonhole blocks find the pairs, the Hamming distance verifies them.

near_duplicates() links fingerprints of 64 bits that differ in two at most, exactly. keep_one() is for copies that are
less alike, down to a share of equal word shingles: it compares fingerprints of 256 bits, cut into blocks again and
again after shuffles of the bits, as many times as the similarity and the size of the corpus ask for.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeloom.llm.common import discard, fresh, over_texts, quoted, table, tune, written
from lakeloom.llm.components import connected

#: Distinct fingerprints up to which a block is joined pair by pair; larger blocks take the neighbourhood route.
PAIRWISE = 32
#: Hashes of shingles whose bits are counted at once.
TOGETHER = 1 << 17


def shingle_hashes(text: bytes | None, width: int = 3) -> np.ndarray:
    """XXH64 of each word shingle of a text in UTF-8; of all words where they are fewer, none without words."""
    words = (text or b"").lower().split()
    joined = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if len(words) <= width:
        return np.array([digest(joined, 42)] if words else [], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = len(words) - width + 1
    return np.fromiter((digest(joined[s:e], 42) for s, e in zip(starts[:n].tolist(), ends[width - 1 :].tolist(), strict=True)), np.uint64, n)


def fingerprint_all(texts: list[bytes | None], width: int = 3) -> list[int]:
    """Unsigned 64-bit SimHashes of the word shingles of texts in UTF-8; without words: 0. Bits are counted together."""
    out, held, size = [0] * len(texts), [], 0
    for i, text in enumerate(texts):
        hashes = shingle_hashes(text, width)
        if len(hashes):
            held.append((i, hashes))
            size += len(hashes)
        if held and (size > TOGETHER or i == len(texts) - 1):
            sizes = np.fromiter((len(h) for _, h in held), np.int64, len(held))
            counts = bit_counts(np.concatenate([h for _, h in held]), np.cumsum(sizes) - sizes)
            prints = np.packbits(counts * 2 > sizes[:, None], axis=1, bitorder="little").view("<u8")[:, 0].tolist()
            for (k, _), made in zip(held, prints, strict=True):
                out[k] = made
            held, size = [], 0
    return out


def fingerprint(text: bytes | None, width: int = 3) -> int:
    return fingerprint_all([text], width)[0]


ONES = np.uint64(0x0101010101010101)


def bit_counts(hashes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """(stretches, 64): how many hashes of each stretch have each bit. Stretches begin at starts, none is empty.

    Eight bits a byte apart are counted at once, in bytes, which hold the counts of up to 255 hashes.
    """
    sizes = np.diff(starts, append=len(hashes))
    pieces = -(-sizes // 255)
    first = np.cumsum(pieces) - pieces
    cuts = np.repeat(starts, pieces) + 255 * (np.arange(pieces.sum()) - np.repeat(first, pieces))
    out = np.empty((len(starts), 64), np.int64)
    for k in range(8):
        bytes_ = np.add.reduceat(hashes >> np.uint64(k) & ONES, cuts).astype("<u8").view(np.uint8).reshape(-1, 8)
        out[:, k::8] = np.add.reduceat(bytes_, first, axis=0, dtype=np.int64)
    return out


def _rows(ids: list, texts: list, width: int) -> list:
    return [ids, [f - (1 << 64) if f >> 63 else f for f in fingerprint_all(texts, width)]]


def fingerprints(docs: DataFrame, width: int = 3) -> DataFrame:
    """(doc_id, fp): fp holds the fingerprint's 64 bits as a signed long."""
    kind = dict(docs.select("doc_id").dtypes)["doc_id"]
    return over_texts(docs, ["doc_id", "text!"], f"doc_id {kind}, fp long", _rows, width)


def _blocks(fp: Column, distance: int) -> Column:
    """Keys of all choices of two of distance + 2 pieces: a pair within the distance agrees on one choice."""
    n = distance + 2
    cuts = [64 * i // n for i in range(n + 1)]
    pieces = [F.shiftrightunsigned(fp, a).bitwiseAND(F.lit((1 << (b - a)) - 1)) for a, b in zip(cuts, cuts[1:])]
    return F.array(*[F.xxhash64(F.lit(i), pieces[x], pieces[y]) for i, (x, y) in enumerate(combinations(range(n), 2))])


def links(distinct: DataFrame, distance: int = 2, pairwise: int = PAIRWISE) -> DataFrame:
    """Links (u, v) between distinct fingerprints `fp` at most `distance` bits apart.

    Blocks of up to `pairwise` members are joined with themselves and each pair is verified, so no block makes
    more than pairwise squared rows. Members of larger blocks are taken out of them and spread over the points of
    a ball of half the distance round each: two balls meet exactly where the centres are near enough, and a point
    lies in a bounded number of balls. That route is exact as well; nothing is dropped. It needs an even distance.
    """
    if distance != 2:
        raise ValueError("the route for large blocks is made for a distance of 2")
    keyed = distinct.select("fp", F.explode(_blocks(F.col("fp"), distance)).alias("key"))
    sizes = keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    members = written(keyed.join(sizes, "key").select("key", "fp", (F.col("n") > pairwise).alias("large")), "blocks")
    small = members.where("not large").select("key", "fp")
    near = F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= distance
    pairs = (
        small.select("key", F.col("fp").alias("u")).join(small.select("key", F.col("fp").alias("v")), "key")
        .where((F.col("u") < F.col("v")) & near).select("u", "v")
    )
    flips = F.array(F.lit(0).cast("long"), *[F.lit(1 << i if i < 63 else -(1 << 63)) for i in range(64)])
    balls = members.where("large").select("fp").distinct().select(
        "fp", F.explode(F.transform(flips, lambda b: F.col("fp").bitwiseXOR(b))).alias("point")
    )
    heads = balls.groupBy("point").agg(F.min("fp").alias("u"), F.count("*").alias("n")).where("n > 1").drop("n")
    stars = balls.join(heads, "point").where("fp <> u").select("u", F.col("fp").alias("v"))
    return pairs.unionByName(stars).distinct()


def near_duplicates(docs: DataFrame, width: int = 3, distance: int = 2) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row of docs.

    Texts are lower-cased in A-Z; a null or blank text has fingerprint zero and links like any other. Copies share
    a fingerprint and meet by it, so the graph holds distinct fingerprints only. component_id is the least doc_id
    of the component (null if all are null). Repeated rows come out as often as they came in; a text of any length is
    hashed whole, in one worker; an empty table gives an empty result; other columns of docs are not read, whatever
    their names.
    """
    prints = written(fingerprints(docs, width), "simhash")
    nodes = written(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "nodes")
    roots = connected(links(nodes.select("fp"), distance))
    rooted = nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select(
        "fp", "least", F.coalesce("root", "fp").alias("root")
    )
    ids = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    labels = rooted.join(ids, "root").select("fp", "component_id")
    return prints.join(labels, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


# --- less similar copies --------------------------------------------------------------------------------------------

#: Bits of a long fingerprint, in numbers of 64.
LANES = 4
BITS = 64 * LANES
#: Words of a shingle, similarity from which two texts are copies, and the share of such pairs, where they are just as
#: alike, that must meet in some block.
SHINGLE, SIMILARITY, RECALL = 5, 0.8, 0.9
#: Blocks of up to one member more give all their pairs, one lag after another; stars that gather next to nothing, one
#: after another, until a larger block's rest is compared pair by pair.
PIVOTS = 8
#: Members that are compared at once with as many others.
TILE = 256
#: Rows of a block from which it is split, about, and one in how many rows is counted to tell.
HOT, HOT_PART = 1 << 18, 64
#: Rows that wait in a worker until complete blocks among them are linked, and rows in a batch.
MANY, NUMBERS = 1 << 17, 1 << 13
#: Bytes of text that are hashed at once.
STRETCH = 1 << 20
ODD, MIXED = 0x9E3779B97F4A7C15, np.uint64(0xBF58476D1CE4E5B9)
IS_BLANK = np.isin(np.arange(256), np.frombuffer(b" \t\n\v\f\r", np.uint8))
_powers: dict[str, np.ndarray] = {}


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * MIXED
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


def _power(base: int, n: int) -> np.ndarray:
    """The powers of an odd number modulo 2 ** 64, n at least."""
    name = str(base)
    if len(_powers.get(name, ())) < n:
        _powers[name] = np.cumprod(np.append(np.uint64(1), np.full(n, base, np.uint64)))
    return _powers[name]


def word_hashes(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, place of its first byte); words are parted by ASCII blanks. Equal words have equal hashes.

    A word's hash is its bytes as digits to an odd base, from differences of running sums, so no word is taken apart
    from the text.
    """
    raw = np.frombuffer(text, np.uint8)
    edges = np.flatnonzero(np.diff(IS_BLANK[raw], prepend=True, append=True))
    begin, end = edges[::2], edges[1::2]
    sums = np.append(np.uint64(0), np.cumsum((raw + np.uint64(1)) * _power(ODD, len(raw))[: len(raw)]))
    return _mix((sums[end] - sums[begin]) * _power(pow(ODD, -1, 1 << 64), len(raw))[begin] + (end - begin).astype(np.uint64)), begin


def _shingled(words: np.ndarray, width: int) -> np.ndarray:
    """The hashes of the shingles that start at each word but the last ones; fewer words than a shingle: of them all."""
    n = max(1, len(words) - width + 1)
    out = np.zeros(n, np.uint64)
    for k in range(min(width, len(words))):
        out = (out + words[k : k + n]) * MIXED
        out ^= out >> np.uint64(27)
    return out


def _lanes(shingles: np.ndarray, starts: np.ndarray) -> np.ndarray:
    salts = _mix(np.arange(1, LANES + 1, dtype=np.uint64))
    return np.concatenate([bit_counts(_mix(shingles + s), starts) for s in salts], axis=1)


def _packed(counts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    return np.packbits(counts * 2 > sizes[:, None], axis=1, bitorder="little").view("<u8").reshape(-1, LANES)


def long_prints(texts: list[bytes | None], width: int = SHINGLE) -> np.ndarray:
    """(texts, LANES): SimHashes of BITS bits of the word shingles, without regard to case in A-Z; no words: zeros.

    Texts are hashed together up to STRETCH bytes, a longer one in stretches, which hand on their last words.
    """
    out = np.zeros((len(texts), LANES), np.uint64)
    group: list[int] = []
    size = 0
    for i, text in enumerate([*texts, None]):
        if group and (i == len(texts) or size + len(text or b"") > STRETCH):
            out[group] = _together([texts[j] for j in group], width)
            group, size = [], 0
        if not text:
            continue
        if len(text) > STRETCH:
            out[i] = _in_stretches(text, width)
        else:
            group.append(i)
            size += len(text) + 1
    return out


def _together(texts: list[bytes], width: int) -> np.ndarray:
    out = np.zeros((len(texts), LANES), np.uint64)
    words, places = word_hashes(b" ".join(texts).lower())
    bounds = np.cumsum([0, *[len(t) + 1 for t in texts]])
    cuts = np.searchsorted(places, bounds)
    counts = np.diff(cuts)
    some = np.flatnonzero(counts)
    if not len(some):
        return out
    shingles = [_shingled(words[cuts[i] : cuts[i + 1]], width) for i in some]
    sizes = np.fromiter(map(len, shingles), np.int64, len(some))
    out[some] = _packed(_lanes(np.concatenate(shingles), np.cumsum(sizes) - sizes), sizes)
    return out


def _in_stretches(text: bytes, width: int) -> np.ndarray:
    total, n, carried = np.zeros((1, BITS), np.int64), 0, np.empty(0, np.uint64)
    at = 0
    while at < len(text):
        end = at + STRETCH
        while end < len(text) and not IS_BLANK[text[end]]:  # a word isn't cut, however long
            end += 1
        words = np.append(carried, word_hashes(text[at:end].lower())[0])
        if len(words) >= width:
            shingles = _shingled(words, width)
            total, n = total + _lanes(shingles, np.zeros(1, np.int64)), n + len(shingles)
        carried, at = words[max(0, len(words) - width + 1) :], end
    if not n and len(carried):  # fewer words than a shingle
        total, n = _lanes(_shingled(carried, width), np.zeros(1, np.int64)), 1
    return _packed(total, np.array([n]))[0] if n else np.zeros(LANES, np.uint64)


def differing_share(similarity: float) -> float:
    """The share of bits in which fingerprints of texts differ whose shingles have that Jaccard similarity.

    Bits are signs of projections: they differ as the angle between the texts' shingle counts goes, whose cosine is
    2s / (1 + s) for texts of equal length.
    """
    return math.acos(2 * similarity / (1 + similarity)) / math.pi


def largest_distance(similarity: float) -> int:
    """Bits in which copies may differ: what is expected at the similarity and two standard deviations."""
    p = differing_share(similarity)
    return math.floor(BITS * p + 2 * math.sqrt(BITS * p * (1 - p)))


def blocking(n: int, similarity: float, recall: float = RECALL) -> tuple[int, int]:
    """(bits of a block, blocks) for n fingerprints: blocks as wide that they hold about one text by chance, and as many
    that a pair which is just similar enough agrees on one at least with a probability of `recall`."""
    width = max(12, math.ceil(math.log2(max(2, n))))
    agree = (1 - differing_share(similarity)) ** width
    return width, math.ceil(math.log(1 - recall) / math.log(1 - agree))


def _cuts(width: int, blocks: int) -> list[np.ndarray]:
    """The bits of each block: the fingerprint's bits in a shuffled order, cut into blocks, for as many orders as needed."""
    out: list[np.ndarray] = []
    while len(out) < blocks:
        order = np.argsort(_mix(np.arange(BITS, dtype=np.uint64) + np.uint64(1_000_003 * (len(out) + 1))), kind="stable")
        out += [order[k : k + width] for k in range(0, BITS - width + 1, width)]
    return out[:blocks]


PRINT = [f"f{i}" for i in range(LANES)]


def _name(prints: np.ndarray) -> np.ndarray:
    """A number for each long fingerprint, by which links name it; equal ones have the same."""
    out = np.zeros(len(prints), np.uint64)
    for k in range(LANES):
        out = _mix(out * MIXED + prints[:, k])
    return out.view(np.int64)


def _prints_of(batch: pa.RecordBatch, first: int) -> np.ndarray:
    return np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns[first:]], axis=1).astype("<i8").view(np.uint64)


def _keyed(nodes: DataFrame, width: int, blocks: int) -> DataFrame:
    """(key, PRINT): a row for each block of each fingerprint of nodes (PRINT)."""
    kept = ", ".join(f"{c} long" for c in ["key", *PRINT])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cuts = _cuts(width, blocks)
        place = np.left_shift(np.int64(1), np.arange(width, dtype=np.int64))
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                prints = _prints_of(batch.slice(at, 1024), 0)
                bits = np.unpackbits(prints.view(np.uint8), axis=1, bitorder="little").astype(np.int64)
                keys = np.concatenate([bits[:, cut] @ place + np.int64(i << 48) for i, cut in enumerate(cuts)])
                made = [keys, *[np.tile(prints[:, k].view(np.int64), blocks) for k in range(LANES)]]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in made], ["key", *PRINT])

    return nodes.select(*PRINT).mapInArrow(run, kept)


def _apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).sum(axis=-1, dtype=np.int64)


class _Forest:
    """Links between members 0 to n - 1, of which only those are kept that join two groups."""

    def __init__(self, n: int):
        self.parent, self.u, self.v = np.arange(n), [], []

    def roots(self, members: np.ndarray) -> np.ndarray:
        found = self.parent[members]
        while True:
            above = self.parent[found]
            if (above == found).all():
                break
            found = above
        self.parent[members] = found
        return found

    def join(self, u: np.ndarray, v: np.ndarray) -> None:
        while True:
            a, b = self.roots(u), self.roots(v)
            new = a != b
            if not new.any():
                return
            u, v, a, b = u[new], v[new], a[new], b[new]
            upper, first = np.unique(np.maximum(a, b), return_index=True)  # each group goes below one lesser
            self.parent[upper] = np.minimum(a, b)[first]
            self.u.append(u[first])
            self.v.append(v[first])


def _join_near(forest: _Forest, prints: np.ndarray, u: np.ndarray, v: np.ndarray, limit: int) -> None:
    """Joins each of u with each of v that it is near; both are few, TILE or so."""
    apart = np.zeros((len(u), len(v)), np.uint16)
    for k in range(LANES):
        apart += np.bitwise_count(prints[u, k][:, None] ^ prints[v, k])
    i, j = np.nonzero(apart <= limit)
    forest.join(u[i], v[j])


def crowd_links(prints: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (places u, v) between members of one block that connect exactly those that near pairs connect, less than
    one for each member.

    Crowds first: a member is compared with all that are left, and those near it are its star, which leaves. As
    distances obey the triangle inequality, a member of the star can only be near others whose distance to the star's
    centre is its own and the limit at most; it is compared with all of these that the star isn't linked with yet.
    Once stars gather next to nothing, all that are left are compared pair by pair. So each pair is compared, is too far
    apart by the triangle inequality, or is connected already.
    """
    forest = _Forest(len(prints))
    left, step, misses = np.arange(len(prints)), 0, 0
    while len(left) > 4 * PIVOTS and misses < max(PIVOTS, len(left) // 64):
        step += 1
        centre = left[(step * ODD >> 20) % len(left)]
        far = _apart(prints[left], prints[centre])
        inside = far <= limit
        star, radius = left[inside], far[inside]
        left, far = left[~inside], far[~inside]
        forest.join(np.full(len(star), centre), star)
        misses = misses + 1 if len(star) < 4 else 0
        order = np.argsort(-radius, kind="stable")  # the widest ones first: those after them have fewer to meet
        star, radius = star[order], radius[order]
        others, far = left[far <= radius[0] + limit], far[far <= radius[0] + limit]
        for at in range(0, len(star), TILE):
            some = (far <= radius[at] + limit) & (forest.roots(others) != forest.roots(star[:1]))
            others, far = others[some], far[some]
            if not len(others):
                break
            for k in range(0, len(others), TILE):
                _join_near(forest, prints, star[at : at + TILE], others[k : k + TILE], limit)
    for at in range(0, len(left), TILE):
        for k in range(at, len(left), TILE):
            _join_near(forest, prints, left[at : at + TILE], left[k : k + TILE], limit)
    none = [np.empty(0, np.int64)]
    return np.concatenate(forest.u or none), np.concatenate(forest.v or none)


def block_links(keys: np.ndarray, prints: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of linked rows, for rows sorted by key: all pairs of blocks of up to PIVOTS + 1, crowd_links() of larger ones."""
    starts = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.empty(0, np.int64)
    sizes = np.diff(starts, append=len(keys))
    small = np.repeat(sizes <= PIVOTS + 1, sizes)
    us, vs = [], []
    for lag in range(1, PIVOTS + 1):
        u = np.flatnonzero((keys[lag:] == keys[:-lag]) & small[: len(small) - lag]) if len(keys) > lag else np.empty(0, np.int64)
        u = u[_apart(prints[u], prints[u + lag]) <= limit]
        us.append(u)
        vs.append(u + lag)
    for start, size in zip(starts[sizes > PIVOTS + 1].tolist(), sizes[sizes > PIVOTS + 1].tolist(), strict=True):
        u, v = crowd_links(prints[start : start + size], limit)
        us.append(u + start)
        vs.append(v + start)
    return np.concatenate(us), np.concatenate(vs)


def _linked(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[pa.RecordBatch]:
    """Links (u, v) of rows (key, PRINT) that come sorted by key. Rows wait until there are more than MANY and a block
    among them is complete; a larger block is held whole, near_links() splits those of more than some HOT rows."""
    held_keys, held, size = [], [], 0

    def settled(last: bool) -> pa.RecordBatch:
        nonlocal held_keys, held, size
        keys, prints = np.concatenate(held_keys), np.concatenate(held)
        open_ = len(keys) if last else int(np.searchsorted(keys, keys[-1]))
        u, v = block_links(keys[:open_], prints[:open_], limit)
        held_keys, held, size = [keys[open_:]], [prints[open_:]], len(keys) - open_
        names = _name(prints)
        return pa.RecordBatch.from_arrays([pa.array(names[u], pa.int64()), pa.array(names[v], pa.int64())], ["u", "v"])

    for batch in batches:
        if not batch.num_rows:
            continue
        held_keys.append(batch.column(0).to_numpy(zero_copy_only=False))
        held.append(_prints_of(batch, 1))
        size += batch.num_rows
        if size > MANY and held_keys[0][0] != held_keys[-1][-1]:
            yield settled(False)
    if size:
        yield settled(True)


def near_links(nodes: DataFrame, similarity: float = SIMILARITY, hot: int = HOT) -> DataFrame:
    """Links (u, v) between fingerprints of nodes (PRINT), by _name(): they connect exactly what pairs connect that share
    a block and differ in few enough bits.

    Rows are dealt by block once, and each block's are read in a stream. Pairs of small blocks are all verified; a larger
    one gives links in rows of its own number, see crowd_links(), which leaves no near pair unconnected.
    A block of more than some `hot` rows is dealt into parts, and each two of them meet in a task, which holds about
    `hot` rows: its rows repeat as often as there are other parts, so that any two of them meet. Such blocks are told
    by one fingerprint in HOT_PART.
    """
    limit = largest_distance(similarity)
    cut = blocking(nodes.count(), similarity)
    keyed, some = _keyed(nodes, *cut), nodes.where(F.pmod(F.xxhash64(*PRINT), F.lit(HOT_PART)) == 0)
    crowded = _keyed(some, *cut).groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") * HOT_PART >= hot)
    parts = F.greatest(F.lit(2).cast("long"), F.ceil(2 * F.col("n") * HOT_PART / hot))
    crowded = written(crowded.select("key", parts.alias("parts")), "crowded")
    rows = keyed
    if not crowded.isEmpty():
        dealt = keyed.join(crowded, "key").withColumn("part", F.pmod(F.xxhash64("key", *PRINT), F.col("parts")))
        met = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))).where("part <> other")
        # Two parts get a key of their own; if it should equal another block's, more pairs are verified.
        split = met.select(F.xxhash64("key", F.least("part", "other"), F.greatest("part", "other")).alias("key"), *PRINT)
        rows = keyed.join(crowded.select("key"), "key", "left_anti").select("key", *PRINT).unionByName(split)
    run = lambda batches: _linked(batches, limit)
    spark = nodes.sparkSession
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(NUMBERS))  # rows of five numbers, not of texts
    try:
        return written(rows.repartition("key").sortWithinPartitions("key", *PRINT).mapInArrow(run, "u long, v long"), "links")
    finally:
        tune(spark)


def _long_rows(ids: list, salts: list, texts: list, width: int) -> list:
    if not ids:
        return [[] for _ in range(LANES + 3)]
    prints = long_prints(texts, width)
    return [ids, salts, _name(prints).tolist(), *prints.view(np.int64).T.tolist()]


def groups(docs: DataFrame, similarity: float = SIMILARITY, width: int = SHINGLE) -> DataFrame:
    """(doc_id, salt, group) for every row of docs: rows of one group are copies of each other, or linked by copies.

    salt is a hash of the text: it tells rows apart that share a doc_id. Texts without words are copies of each other.
    """
    kind = docs.select("doc_id").schema["doc_id"].dataType.simpleString()
    named = docs.select("doc_id", F.xxhash64("text").alias("salt"), "text")
    schema = f"doc_id {kind}, salt long, node long, " + ", ".join(f"{c} long" for c in PRINT)
    prints = written(over_texts(named, ["doc_id", "salt", "text!"], schema, _long_rows, width), "prints")
    nodes = written(prints.select(*PRINT).distinct(), "nodes")
    links = near_links(nodes, similarity)
    roots = connected(links)
    joined = prints.select("doc_id", "salt", "node").join(roots, "node", "left")
    out = written(joined.select("doc_id", "salt", F.coalesce("root", "node").alias("group")), "groups")
    for done in (prints, nodes, links):
        discard(done)
    return out


def keep_one(docs: DataFrame, similarity: float = SIMILARITY, width: int = SHINGLE) -> DataFrame:
    """docs less all but one row of each group of near-duplicates: that with the least doc_id stays, null the last.

    Copies are texts whose shingles of `width` words have a similarity of `similarity` or more, as their fingerprints
    tell. That is an estimate with a margin: pairs just as similar are near enough in 49 of 50 cases, and at 0.8 so are
    half of those at 0.7, a tenth at 0.6, one in 200 at 0.5. Texts without words are copies of each other. Rows that repeat an id with other texts are documents of their own. All columns come out as they are,
    whatever their names; an empty table stays empty.
    Ids and hashes alone are grouped; of the texts, only those of repeated rows are shuffled for it, and others where
    the dropped ids are too many to broadcast.
    """
    marks = groups(docs, similarity, width)
    key = F.struct(F.col("doc_id").isNull().alias("last"), F.col("doc_id").alias("id"), F.col("salt").alias("salt"))
    several = marks.groupBy("group").agg(F.count("*").alias("n")).where("n > 1").select("group")
    crowded = written(marks.join(several, "group"), "crowded")
    id_, salt = fresh(docs, "__id", "__salt")
    least = crowded.groupBy("group").agg(F.min(key).alias("least"))
    stays = (F.col("least.id").eqNullSafe(F.col("doc_id"))) & (F.col("least.salt") == F.col("salt"))
    told = written(crowded.join(least, "group").select(F.col("doc_id").alias(id_), F.col("salt").alias(salt), stays.alias("stays")), "told")
    gone = told.where("NOT stays")
    # Ids of which every row goes, which are nearly all, are told by the id alone: a small table to join with.
    rows = marks.groupBy(F.col("doc_id").alias("id")).agg(F.count("*").alias("n"))
    per_id = gone.groupBy(id_).agg(F.count("*").alias("g")).join(rows, F.col(id_).eqNullSafe(F.col("id")))
    per_id = written(per_id.select(id_, (F.col("g") == F.col("n")).alias("all")), "marked")
    # Written apart, so that the planner knows the size of each.
    out = written(per_id.where("all").select(id_), "dropped")
    mixed = per_id.where("NOT all").select(F.col(id_).alias("id"))
    some = written(gone.join(mixed, F.col(id_).eqNullSafe(F.col("id")), "left_semi").select(id_, salt).distinct(), "dropped")
    again = written(told.where("stays").groupBy(id_, salt).agg(F.count("*").alias("n")).where("n > 1").select(id_, salt), "repeated")
    for done in (marks, crowded, told, per_id):
        discard(done)
    same = F.col("doc_id").eqNullSafe(F.col(id_)) & (F.xxhash64("text") == F.col(salt))
    stay = docs.join(out, F.col("doc_id").eqNullSafe(F.col(id_)), "left_anti")
    if not some.isEmpty():
        stay = stay.join(some, same, "left_anti")
    if again.isEmpty():
        return stay
    [text] = fresh(docs, "__text")
    repeated = docs.join(again, same, "left_semi").withColumn(text, F.xxhash64("text"))
    once = repeated.dropDuplicates(["doc_id", text]).select(*[quoted(c) for c in docs.columns])
    return stay.join(again, same, "left_anti").unionByName(once)


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
