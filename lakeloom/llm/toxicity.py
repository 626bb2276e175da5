"""Toxic passages: segments of highest log-odds, calibrated by extreme values.

Words get log-odds between labelled toxic and clean texts, held near the corpus by a Dirichlet prior. A linear scan
finds all maximal scoring segments of a text (Ruzzo and Tompa). Under the clean texts' word frequencies a segment's
score follows an extreme-value law, which gives its significance; the significant ones are summed for the document.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeloom.llm.common import over_texts, table, written

#: A word: letters without regard to case in A-Z; all other ASCII separates. One byte stays one byte.
FLAT = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
#: Labelled rows that the model is fitted on, about; more are sampled by a hash of doc_id.
MAX_LABELLED = 20_000


@dataclass
class Model:
    weights: dict[bytes, float] = field(default_factory=dict)  # log-odds of the words that tell the classes apart
    drift: float = 0.1  # what any other word takes off a segment
    scale: float = 1.0  # lambda of the extreme-value law
    size: float = 0.1  # K of that law
    line: tuple[float, ...] = (-2.0, 0.5, 0.5, 0.0)  # logistic regression over features()

    alpha: float = 0.5  # expected number of such segments by chance, below which one counts


def segments(hits: list[tuple[int, float]], drift: float) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (first word, word after the last, score), by place, in linear time.

    hits: places and weights of the words that aren't neutral; the words between take `drift` off each.
    """
    found: list[list[float]] = []  # [sum before, sum after, first, end]
    parent: list[int] = []  # for each: the nearest one before whose sum before is less
    total, last = 0.0, -1
    for place, weight in hits:
        total -= drift * (place - last - 1)
        last = place
        if weight <= 0:
            total += weight
            continue
        new = [total, total + weight, place, place + 1]
        total += weight
        while True:
            j = len(found) - 1
            while j >= 0 and found[j][0] >= new[0]:
                j = parent[j]
            if j < 0 or found[j][1] >= new[1]:
                found.append(new)
                parent.append(j)
                break
            new = [found[j][0], new[1], found[j][2], new[3]]
            del found[j:], parent[j:]
    return [(int(a), int(b), hi - lo) for lo, hi, a, b in found]


def evidence(raw: bytes | None, model: Model) -> tuple[int, list[tuple[int, int, float]]]:
    """Number of words, and the significant segments with their normalised scores, lambda S - ln(K n)."""
    words = (raw or b"").translate(FLAT).split()
    known = model.weights
    hits = [(i, known[w]) for i, w in enumerate(words) if w in known]
    if not hits:
        return len(words), []
    floor = math.log(model.size * len(words))
    least = -math.log(model.alpha)
    made = ((a, b, model.scale * s - floor) for a, b, s in segments(hits, model.drift))
    return len(words), [x for x in made if x[2] >= least]


def features(n: int, found: list[tuple[int, int, float]]) -> tuple[float, float, float]:
    """What the regression reads of evidence()."""
    if not found:
        return 0.0, 0.0, 0.0
    total = sum(s for _, _, s in found)
    return math.log1p(total), math.log1p(len(found)), math.log1p(1000 * len(found) / n)


def probability(x: tuple[float, ...], line: tuple[float, ...]) -> float:
    z = line[0] + sum(a * b for a, b in zip(line[1:], x, strict=True))
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> tuple[float, ...]:
    x = np.hstack([np.ones((len(x), 1)), x])
    w = np.zeros(x.shape[1])
    penalty = np.diag([1e-3] + [ridge] * (x.shape[1] - 1))
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + penalty, x.T @ (y - p) - penalty @ w)
        w += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return tuple(float(v) for v in w)


def _counts(toxic: list, texts: list) -> list:
    by = (Counter(), Counter())
    for label, text in zip(toxic, texts, strict=True):
        by[label].update(set((text or b"").translate(FLAT).split()))  # a text counts a word once: repeats prove little
    tokens = list(by[0].keys() | by[1].keys())
    return [tokens, [by[1][t] for t in tokens], [by[0][t] for t in tokens]]


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED, prior: float = 500.0, z: float = 5.0) -> Model:
    """The model from the labelled rows that aren't held out; null labels and ids and labels without text are skipped.

    All words whose presence depends on the label (signed root of the likelihood ratio at least `z`) are kept, as many as
    a sample of that size has, weighted by their log-odds under a Dirichlet prior of `prior` words at the sample's frequencies. If a doc_id has several
    labels, the highest counts. One class alone, or no rows, give a model that scores all texts alike.
    """
    rows = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out(F.col("doc_id")))
    rows = rows.groupBy("doc_id").agg(F.max(F.when(F.col("toxic") > 0, 1).otherwise(0)).alias("toxic"))
    n = rows.count()
    if n > max_labelled:  # a sample by hash: the same rows each time
        rows = rows.where(F.pmod(F.xxhash64(F.lit(9), "doc_id"), F.lit(1 << 30)) < int((1 << 30) * max_labelled / n))
    # At most some tens of thousands of rows of two numbers by the bound above: safe to broadcast.
    chosen = written(rows, "labelled")
    sample = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").where(F.col("text").isNotNull())
    # One text for each labelled id, so that rows which repeat an id don't make the sample larger than its bound.
    sample = sample.groupBy("doc_id", "toxic").agg(F.max_by("text", F.xxhash64("text")).alias("text"))
    sample = written(sample.select("toxic", "text"), "sample")
    counted = over_texts(sample, ["toxic", "text!"], "token binary, toxic_n long, clean_n long", _counts)
    counted = written(counted.groupBy("token").agg(F.sum("toxic_n").alias("t"), F.sum("clean_n").alias("c")), "tokens")
    toxic_all, clean_all = (x or 0 for x in counted.agg(F.sum("t"), F.sum("c")).first())
    by_class = {r["toxic"]: r["count"] for r in sample.groupBy("toxic").count().collect()}
    if len(by_class) < 2 or not toxic_all or not clean_all:
        rate = (by_class.get(1, 0) + 1) / (sum(by_class.values()) + 2)
        return Model(line=(math.log(rate / (1 - rate)), 0.0, 0.0, 0.0))
    a = prior * (F.col("t") + F.col("c")) / float(toxic_all + clean_all)
    odds = F.log((F.col("t") + a) / (toxic_all + prior - F.col("t") - a)) - F.log((F.col("c") + a) / (clean_all + prior - F.col("c") - a))
    # The likelihood ratio of two rates against one, in its signed root: unlike the variance of the log-odds it stays
    # sharp for words that one class never uses.
    seen, share = F.col("t") + F.col("c"), toxic_all / float(toxic_all + clean_all)
    part = lambda n, of: F.when(n > 0, n * F.log(n / (seen * of))).otherwise(0.0)
    root = F.sqrt(F.greatest(F.lit(0.0), 2 * (part(F.col("t"), share) + part(F.col("c"), 1 - share))))
    terms = (
        counted.select("token", "c", a.alias("a"), odds.alias("w"), root.alias("z")).where((F.col("z") >= z) & (F.abs("w") >= 0.7))
        .orderBy(F.desc("z"), "token").collect()
    )
    model = Model(weights={bytes(r["token"]): r["w"] for r in terms})
    freq = np.array([(r["c"] + r["a"]) / (clean_all + prior) for r in terms])  # in clean texts, under the same prior
    weight = np.array([r["w"] for r in terms])
    gain = float((freq * np.maximum(weight, 0)).sum()) if terms else 0.0
    model.drift = 0.1 + 2 * gain
    if terms and weight.max() > 0:
        rest = max(0.0, 1 - freq.sum())
        total = lambda k: float((freq * np.exp(k * weight)).sum() + rest * math.exp(-k * model.drift))
        low, high = 0.0, 1.0
        while total(high) < 1 and high < 64:
            high *= 2
        for _ in range(60):
            mid = (low + high) / 2
            low, high = (mid, high) if total(mid) < 1 else (low, mid)
        model.scale = max(low, 0.05)
        # Where the telling words are rare, chance segments are single words: these are as many as the law then says.
        model.size = max(1e-3, float((freq * np.exp(model.scale * weight))[weight > 0].sum()))
    found = over_texts(sample, ["toxic", "text!"], "toxic int, a double, b double, c double", _features, model).collect()
    x = np.array([[r["a"], r["b"], r["c"]] for r in found])
    model.line = _logistic(x, np.array([r["toxic"] for r in found], float))
    return model


def _features(toxic: list, texts: list, model: Model) -> list:
    return [toxic, *map(list, zip(*[features(*evidence(t, model)) for t in texts], strict=True))] if toxic else [[], [], [], []]


def spans(raw: bytes, found: list[tuple[int, int, float]]) -> list[tuple[int, int, float]]:
    """Segments of words as spans of code points, ends exclusive."""
    words = [m.span() for m in re.finditer(rb"\S+", raw.translate(FLAT))]
    at = lambda k: len(raw[:k].decode())
    return [(at(words[a][0]), at(words[b - 1][1]), s) for a, b, s in found]


def _scores(ids: list, texts: list, model: Model) -> list:
    out: list[list] = [ids, [], [], [], []]
    for raw in texts:
        n, found = evidence(raw, model)
        p = probability(features(n, found), model.line)
        out[1].append(p)
        out[2].append(int(p >= 0.5))
        out[3].append(len(found))
        out[4].append(",".join(f"{a}:{b}:{s:.2f}" for a, b, s in spans(raw, found)) if found else "")
    return out


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score, predicted, n_passages, passages) for every row of docs; passages as start:end:score.

    Offsets count code points of the whole text. A null or empty text has no passage and the lowest score; a text of any
    length is read whole, in one scan; repeated rows repeat; an empty table gives an empty result; other columns are not
    read, whatever their names.
    """
    kind = docs.select("doc_id").schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, score double, predicted int, n_passages long, passages string"
    return over_texts(docs, ["doc_id", "text!"], schema, _scores, model)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = scored(docs, fit(docs, table(spark, sf_dir, "labels")))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted", "n_passages", "passages")
