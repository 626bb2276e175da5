"""Quality rules: counts per document, failure rates per host shrunk to a beta prior, verdicts back to documents."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeloom.llm.common import fresh, over_texts, quoted, table, written

BLANKS, SYMBOLS = b" \t\n\v\f\r", b"#*$%&|<>"
WINDOW = 8
#: Hosts up to which their verdicts may be broadcast; 100 bytes each at most, past that the join shuffles.
BROADCAST_HOSTS = 50_000
COUNTS = "n_words long, word_chars long, n_symbols long, n_lines long, n_dup_lines long, n_repeat_words long"


def repeated_words(words: list[bytes], width: int = WINDOW) -> int:
    """Words inside windows of `width` words that occur twice or more, first occurrences included."""
    m = len(words) - width + 1
    if m < 2:
        return 0
    named = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    rolled = named[:m].copy()
    for j in range(1, width):
        rolled *= np.uint64(0x9E3779B97F4A7C15)
        rolled += named[j : j + m]
    rolled ^= rolled >> np.uint64(29)
    ordered = np.sort(rolled)
    twice = ordered[1:][ordered[1:] == ordered[:-1]]
    if not len(twice):
        return 0
    at = np.flatnonzero(np.isin(rolled, twice))
    steps = np.zeros(len(words) + 1, np.int64)
    steps[at] += 1
    steps[at + width] -= 1
    return int(np.count_nonzero(np.cumsum(steps)[:-1]))


def count(text: bytes | None) -> tuple[int, int, int, int, int, int]:
    """The counts of one text in UTF-8, in the order of COUNTS; null: zeros."""
    if not text:
        return 0, 0, 0, 0, 0, 0
    words = text.split()
    lines = [x for x in text.split(b"\n") if x and not x.isspace()]
    chars = len(text.decode()) - (len(text) - len(text.translate(None, BLANKS)))
    return (
        len(words), chars, len(text) - len(text.translate(None, SYMBOLS)), len(lines),
        len(lines) - len(set(lines)), repeated_words(words),
    )


def _rows(ids: list, hosts: list, salts: list, texts: list) -> list:
    return [ids, hosts, salts, *zip(*map(count, texts))] if ids else [[] for _ in range(9)]


def failures() -> dict[str, Column]:
    """Rule -> failed. The first two reject a document by themselves, the others only on a host that often fails."""
    return {
        "short": F.col("n_words") < 20,
        "repeated": F.col("n_repeat_words") * 100 > F.col("n_words") * 30,
        "symbols": F.col("n_symbols") * 10 > F.col("n_words"),
        "same_lines": F.col("n_dup_lines") * 100 > F.col("n_lines") * 30,
        "word_length": (F.col("word_chars") < F.col("n_words") * 3) | (F.col("word_chars") > F.col("n_words") * 12),
    }


def host_verdicts(counted: DataFrame, strict: float = 0.3, blocked: float = 0.98) -> DataFrame:
    """(host, n_docs, <rule>_rate ..., fail_rate, verdict): one row per host, the null host included.

    The prior of each rate is a beta distribution fitted to the hosts by the method of moments (weighted by their
    documents); a host's rate is its posterior mean, so that a host with few documents stays near the corpus. Verdict:
    'blocked' at a rate of any failure of `blocked` or more, else 'strict' at `strict` or more, else 'open'.
    """
    failed = {k: F.coalesce(c, F.lit(False)).cast("long") for k, c in failures().items()}
    failed["fail"] = F.greatest(*failed.values())
    hosts = written(
        counted.groupBy("host").agg(F.count("*").alias("n_docs"), *[F.sum(c).alias(k) for k, c in failed.items()]),
        "hosts",
    )
    moments = [F.sum("n_docs").alias("n"), F.count("*").alias("hosts")]
    for k in failed:
        moments += [F.sum(k).alias(k), F.sum(F.col(k) * F.col(k) / F.col("n_docs")).alias(f"{k}_sq")]
    total = hosts.agg(*moments).first()
    out = [F.col("host"), F.col("n_docs")]
    n = total["n"] or 1
    for k in failed:
        mean = (total[k] or 0) / n
        spread = (total[f"{k}_sq"] or 0.0) / n - mean * mean
        # The hosts' spread holds binomial noise of about mean * (1 - mean) * hosts / n, which isn't the prior's.
        spread = max(spread - mean * (1 - mean) * total["hosts"] / n, 1e-9)
        strength = min(max(mean * (1 - mean) / spread - 1, 1.0), 1e6)
        out.append(((F.col(k) + mean * strength) / (F.col("n_docs") + strength)).alias(f"{k}_rate"))
    rates = hosts.select(*out)
    verdict = F.when(F.col("fail_rate") >= blocked, "blocked").when(F.col("fail_rate") >= strict, "strict")
    return rates.withColumn("verdict", verdict.otherwise("open"))


def judged(docs: DataFrame, host: str = "source", strict: float = 0.3, blocked: float = 0.98) -> DataFrame:
    """(doc_id, host, salt, counts, base_failed, host_rate, host_verdict, kept) for every row of docs; salt: a hash of the text.

    A null or blank text has no words and fails; a null host is a host of its own; repeated rows are judged alike,
    each counts for its host; a text of any length is counted whole, in one worker; an empty table gives an empty
    result; other columns are not read, whatever their names.
    kept: not base_failed, the host not blocked, and on a strict host no other rule failed either.
    """
    kinds = dict(docs.select("doc_id", quoted(host)).dtypes)
    schema = f"doc_id {kinds['doc_id']}, host {kinds[host]}, salt long, {COUNTS}"
    named = docs.select("doc_id", quoted(host).alias("host"), F.xxhash64("text").alias("salt"), "text")
    counted = written(over_texts(named, ["doc_id", "host", "salt", "text!"], schema, _rows), "counts")
    verdicts = written(host_verdicts(counted, strict, blocked), "verdicts")
    verdicts = verdicts.select(F.col("host").alias("__host"), F.col("fail_rate").alias("host_rate"), "verdict")
    if verdicts.limit(BROADCAST_HOSTS + 1).count() <= BROADCAST_HOSTS:
        verdicts = F.broadcast(verdicts)
    rules = failures()
    base = F.coalesce(rules["short"] | rules["repeated"], F.lit(True))
    soft = F.coalesce(rules["symbols"] | rules["same_lines"] | rules["word_length"], F.lit(False))
    passes = (F.col("verdict") == "open") | ((F.col("verdict") == "strict") & ~soft)
    joined = counted.join(verdicts, F.col("host").eqNullSafe(F.col("__host")), "left").drop("__host")
    return joined.withColumn("base_failed", base).withColumn("kept", ~F.col("base_failed") & passes)


def keep_good(docs: DataFrame, host: str = "source") -> DataFrame:
    """The rows of docs that are kept. Counting and verdicts take one pass each; the rows then go by doc_id.

    Rows that share an id but not a text or a host are judged apart. All columns come out as they are, whatever their
    names; an empty table stays empty.
    """
    id_, host_, salt = fresh(docs, "__bad", "__host", "__salt")
    verdicts = judged(docs, host).select(F.col("doc_id").alias(id_), F.col("host").alias(host_), F.col("salt").alias(salt), "kept")
    per_id = verdicts.groupBy(id_).agg(F.max("kept").alias("some"), F.min("kept").alias("all"))
    # Ids of which every row goes, which are nearly all, are told by the id alone: a small table to join with.
    bad = written(per_id.where("NOT some").select(id_), "rejected")
    out = docs.join(bad, F.col("doc_id").eqNullSafe(F.col(id_)), "left_anti")
    mixed = written(per_id.where("some AND NOT all").select(F.col(id_).alias("id")), "mixed")
    if mixed.isEmpty():
        return out
    rows = verdicts.where("NOT kept").join(mixed, F.col(id_).eqNullSafe(F.col("id")), "left_semi").drop("kept").distinct()
    same = F.col("doc_id").eqNullSafe(F.col(id_)) & quoted(host).eqNullSafe(F.col(host_)) & (F.xxhash64("text") == F.col(salt))
    return out.join(written(rows, "rejected"), same, "left_anti")


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = judged(table(spark, sf_dir, "documents"))
    return out.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
        F.round("host_rate", 6).alias("host_rate"), F.col("verdict").alias("host_verdict"),
    )


#: The whole of op3 in DuckDB's SQL.
OP3_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, source AS host, coalesce(text, '') AS text FROM documents),
w AS (SELECT rid, doc_id, host, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words,
        list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
i AS (SELECT rid, words, unnest(range(1, len(words) - 6)) AS k0 FROM w WHERE len(words) >= 8),
v AS (SELECT rid, k0, count(*) OVER (PARTITION BY rid, array_to_string(words[k0 : k0 + 7], ' ')) AS n FROM i),
r AS (SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest(range(k0, k0 + 8)) AS p FROM v WHERE n > 1) GROUP BY rid),
c AS (SELECT w.rid, doc_id, host, CAST(len(words) AS BIGINT) AS n_words,
        CAST(coalesce(list_sum(list_transform(words, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
        CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
        CAST(len(lines) AS BIGINT) AS n_lines, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
        CAST(coalesce(r.n, 0) AS BIGINT) AS n_repeat_words FROM w LEFT JOIN r ON w.rid = r.rid),
f AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
        10 * n_symbols > n_words OR 100 * n_dup_lines > 30 * n_lines OR word_chars < 3 * n_words OR word_chars > 12 * n_words AS soft FROM c),
h AS (SELECT host, CAST(count(*) AS DOUBLE) AS n, CAST(count(*) FILTER (WHERE base_failed OR soft) AS DOUBLE) AS x FROM f GROUP BY host),
m AS (SELECT sum(x) / sum(n) AS mean, sum(x * x / n) / sum(n) AS sq, count(*) / sum(n) AS noise FROM h),
s AS (SELECT mean, least(greatest(mean * (1 - mean) / greatest(sq - mean * mean - mean * (1 - mean) * noise, 1e-9) - 1, 1), 1e6) AS strength FROM m),
g AS (SELECT host, (x + mean * strength) / (n + strength) AS rate FROM h, s)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND rate < 0.98 AND (rate < 0.3 OR NOT soft) AS kept, round(rate, 6) AS host_rate,
  CASE WHEN rate >= 0.98 THEN 'blocked' WHEN rate >= 0.3 THEN 'strict' ELSE 'open' END AS host_verdict
FROM f JOIN g ON f.host IS NOT DISTINCT FROM g.host
"""
