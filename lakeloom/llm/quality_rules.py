"""Host-level quality rules.

Each document is measured by rules of its own. Failures are then counted by
host, a beta prior is fitted to all hosts' failure rates (empirical Bayes),
each host's rate is shrunk towards it, and documents of hosts whose shrunk
rate stays above a limit are rejected along with those that fail themselves.

Null text counts as empty; a null host is a host of its own; repeated rows
count each time; texts of any length are measured whole; a host whose rate
equals the limit stays. Other columns aren't read and may have any name. An
empty table gives an empty result.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import free_name, map_texts, pieces_by_size, stored, text_of

#: Words in a window that counts as repeated when it is found twice.
WINDOW = 8
SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\v\f\r"
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
#: Bytes of text taken from a batch at once.
BLOCK_BYTES = 1 << 22
#: A host is rejected when its shrunk failure rate exceeds this.
HOST_LIMIT = 0.5
#: Prior weight when hosts don't differ by more than chance, in documents.
MAX_PRIOR_WEIGHT = 1000.0

STATS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words within windows that occur twice or more in the list."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    ids: dict[bytes, int] = {}
    at = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, len(words))
    # Ranks of windows by doubling: the rank of a pair of equal-length halves is exact, no hashing.
    length = 1
    while length < window:
        step = min(length, window - length)
        pair = at[: len(words) - length - step + 1] * np.int64(len(words) + 1) + at[step : len(words) - length + 1]
        at, length = np.unique(pair, return_inverse=True)[1].astype(np.int64), length + step
    if (counts := np.bincount(at)).max() < 2:
        return 0
    edge = np.zeros(len(words) + 1, np.int64)
    found = np.flatnonzero(counts[at] > 1)
    np.add.at(edge, found, 1)
    np.add.at(edge, found + window, -1)
    return int((np.cumsum(edge[:-1]) > 0).sum())


def measure(text: str) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of one text."""
    words = text.encode("utf-8", "surrogatepass").split()
    word_chars = len(text) - sum(map(text.count, SPACES))
    symbols = sum(map(text.count, SYMBOLS))
    lines = Counter(text.split("\n"))
    dup = sum(n - 1 for line, n in lines.items() if n > 1 and line.strip(SPACES))
    return len(words), word_chars, symbols, dup, repeated_words(words)


def fails(n_words: int, n_repeat: int, min_words: int = MIN_WORDS, max_percent: int = MAX_REPEAT_PERCENT) -> bool:
    """The base verdict on one document."""
    return n_words < min_words or 100 * n_repeat > max_percent * n_words


def document_stats(docs: DataFrame, keys: list[str], text: str = "text", min_words: int = MIN_WORDS, max_percent: int = MAX_REPEAT_PERCENT) -> DataFrame:
    """keys, the five counts and base_failed of every row of docs."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = (t for piece in pieces_by_size(batch, "text", BLOCK_BYTES) for t in piece.column("text").to_pylist())
        found = np.array([measure(t) for t in texts], np.int64).reshape(-1, 5)
        failed = [fails(int(a), int(b), min_words, max_percent) for a, b in found[:, [0, 4]]]
        return pa.RecordBatch.from_arrays([*batch.columns[:-1], *(pa.array(found[:, i]) for i in range(5)), pa.array(failed)], names=[*keys, *(c.split()[0] for c in STATS.split(", ")), "base_failed"])

    df = docs.select(*keys, text_of(text))
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*keys).schema)
    return map_texts(df, work, f"{kept}, {STATS}, base_failed boolean")


def host_verdicts(stats: DataFrame, host: str, limit: float = HOST_LIMIT) -> DataFrame:
    """host, n, failed, rate (shrunk) and host_kept, from rows with host and base_failed.

    The prior's mean is the share of failures over all documents; its weight
    follows from the variance between hosts by the method of moments.
    """
    by_host = stored(stats.groupBy(F.col(host).alias("host")).agg(F.count("*").alias("n"), F.sum(F.col("base_failed").cast("long")).alias("failed")), "hosts")
    rate = F.col("failed") / F.col("n")
    # Five sums over all hosts are all that reaches the driver.
    s = by_host.agg(
        F.sum("n").alias("n"), F.sum("failed").alias("failed"), F.count("*").alias("hosts"),
        F.sum(F.col("n").cast("double") * rate * rate).alias("squares"), F.sum(F.col("n").cast("double") * F.col("n")).alias("nn"),
    ).first()
    mean, weight = beta_prior(s.n or 0, s.failed or 0, s.hosts, s.squares or 0.0, s.nn or 0.0)
    shrunk = (F.col("failed") + F.lit(mean * weight)) / (F.col("n") + F.lit(weight))
    return by_host.select("host", "n", "failed", shrunk.alias("rate"), (shrunk <= limit).alias("host_kept"))


def beta_prior(n: int, failed: int, hosts: int, squares: float, nn: float) -> tuple[float, float]:
    """Mean and weight of the prior, by the method of moments.

    squares is the sum of n * rate ** 2 over hosts, nn that of n ** 2. The
    spread of rates less what binomial chance explains is between hosts.
    """
    if not n:
        return 0.0, MAX_PRIOR_WEIGHT
    mean = failed / n
    spread = squares - n * mean * mean - (hosts - 1) * mean * (1 - mean)
    scale = n - nn / n
    if scale <= 0 or spread / scale <= 0:
        return mean, MAX_PRIOR_WEIGHT
    return mean, min(MAX_PRIOR_WEIGHT, max(1.0, mean * (1 - mean) / (spread / scale) - 1))


def judge(docs: DataFrame, doc_id: str = "doc_id", host: str = "source", text: str = "text", limit: float = HOST_LIMIT) -> DataFrame:
    """One row per document: counts, base_failed, the host's shrunk rate, and kept.

    Texts are read once; only counts are stored and joined with hosts.
    """
    keyed = docs.select(F.col(doc_id).alias("doc_id"), F.col(host).alias("host"), F.col(text).alias("text"))
    stats = stored(document_stats(keyed, ["doc_id", "host"]), "rules")
    hosts = stored(host_verdicts(stats, "host", limit), "hosts").select(F.col("host").alias("h"), F.col("rate").alias("host_rate"), "host_kept")
    # The stored host table's size is known to Spark, which broadcasts it only if small;
    # else adaptive execution splits a hot host's side.
    return stats.join(hosts, F.col("host").eqNullSafe(F.col("h")), "left").select(
        "doc_id", *(c.split()[0] for c in STATS.split(", ")), "base_failed",
        (~F.col("base_failed") & F.coalesce("host_kept", F.lit(True))).alias("kept"), "host", "host_rate",
    )


def reject(docs: DataFrame, host: str = "source", text: str = "text", limit: float = HOST_LIMIT) -> DataFrame:
    """docs without the rejected documents, all columns as they were, whatever their names.

    Null and empty texts have no words and go. An empty table stays empty.
    """
    stats = document_stats(docs.select(F.col(host).alias("host"), F.col(text).alias("text")), ["host"])
    bad = stored(host_verdicts(stats, "host", limit).where(~F.col("host_kept")).select("host"), "hosts")
    names = docs.columns
    at = names.index(text)

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [measure(t or "") for piece in pieces_by_size(batch, names[at], BLOCK_BYTES) for t in piece.column(at).to_pylist()]
        return batch.filter(pa.array([not fails(m[0], m[4]) for m in found], pa.bool_()))

    kept, name = map_texts(docs, work, docs.schema), free_name(docs, "rejected_host")
    return kept.join(bad.withColumnRenamed("host", name), kept[host].eqNullSafe(F.col(name)), "left_anti")
