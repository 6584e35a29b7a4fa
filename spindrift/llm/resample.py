"""Importance resampling towards a target distribution, over hashed word runs.

A feature is a run of 1 to `most` consecutive words, joined by one space, and falls into one of `buckets` by the CRC-32 of its UTF-8
bytes. How often the buckets occur in the table and in the target gives each bucket a gain, a log ratio in thousandths with one added
to every count. A document's weight is the sum of its features' gains; Gumbel noise from a hash of its id is added, and the highest
sums are the draw without replacement.

The bytes are worked off by a vectorised automaton. A lookup table classifies the bytes of an Arrow buffer, words begin and end where
the class differs from the byte before, and table-driven CRCs advance across all features of a block at once, one byte a step. Words
of many bytes are cut into pieces whose CRCs advance side by side; a piece is joined on by moving the state across as many zero bytes,
a table again. Bytes 0-9, A-Z, a-z and those above 0x7F are of words; A-Z are lower-cased.

Texts are read twice: once for counts, one row a bucket from each task, and once for weights. Counts of all buckets, at most
MOST_BUCKETS, are gathered and sent to the tasks. No text is shuffled. Ranks come from a range-partitioned table of thin rows, each
numbered within its partition and offset by the rows of those before, so no task sorts all.

Nulls and ties: a null or empty text has no features and weight 0; a null id draws its luck from the empty string and comes last among
equal scores; equal scores go by smaller id. Rows that share an id are documents of their own with the same luck. Empty tables, on
either side, give results without a draw or with gains from the one side. Other columns are ignored by the table and kept by the draw.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import derived, fresh, materialize, scratch, shipped
from .textbytes import Block, blocks

BUCKETS, MOST_BUCKETS = 10_000, 1 << 20
#: percent of the documents with LEAST words or more that are drawn
SHARE, LEAST, SEED = 10, 20, 2024
#: bytes of a word from which on its pieces advance side by side
PIECE = 256

_WORD = np.zeros(256, bool)
_WORD[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32


def _crc_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> 1) ^ np.uint32(0xEDB88320), t >> 1)
    return t


def _across_zeros(n: int) -> np.ndarray:
    """[k, b]: where the state b << 8k goes across n zero bytes; the CRC is linear, so these four make up any state."""
    s = np.arange(256, dtype=np.uint32) << (8 * np.arange(4, dtype=np.uint32)[:, None])
    for _ in range(n):
        s = _TABLE[s & 0xFF] ^ (s >> 8)
    return s


_TABLE = _crc_table()
_JOIN = _across_zeros(PIECE)


def _advance(state: np.ndarray, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """CRC states moved on across lengths[i] bytes from starts[i] on, all of them by one byte a step."""
    if not len(starts):
        return state
    order = np.argsort(-lengths, kind="stable")
    at, s, left = starts[order], state[order], lengths[order]
    for j, n in enumerate(len(left) - np.searchsorted(left[::-1], np.arange(left[0]), "right")):  # n of them are longer than j
        live = s[:n]
        s[:n] = np.take(_TABLE, (live ^ data[at[:n] + j]) & 0xFF) ^ (live >> 8)
    out = np.empty_like(s)
    out[order] = s
    return out


def crc32_of(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """CRC-32 of the lengths[i] > 0 bytes from starts[i] on."""
    pieces = (lengths - 1) // PIECE  # besides the first one, which takes what is left over
    head = lengths - pieces * PIECE
    state = _advance(np.full(len(starts), 0xFFFFFFFF, np.uint32), data, starts, head)
    long = np.flatnonzero(pieces)
    if len(long):
        long = long[np.argsort(-pieces[long], kind="stable")]
        n, s = pieces[long], state[long]
        first = np.cumsum(n) - n
        at = np.repeat(starts[long] + head[long] - first * PIECE, n) + np.arange(n.sum()) * PIECE
        each = _advance(np.zeros(len(at), np.uint32), data, at, np.full(len(at), PIECE))
        for j, m in enumerate(len(n) - np.searchsorted(n[::-1], np.arange(n[0]), "right")):
            live = s[:m]
            s[:m] = _JOIN[0][live & 0xFF] ^ _JOIN[1][(live >> 8) & 0xFF] ^ _JOIN[2][(live >> 16) & 0xFF] ^ _JOIN[3][live >> 24] ^ each[first[:m] + j]
        state[long] = s
    return state ^ np.uint32(0xFFFFFFFF)


def features(block: Block, most: int = 1) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For runs of 1, 2, ... most words: their CRCs, and bounds: feature i of text t has bounds[t] <= i < bounds[t+1]."""
    word = _WORD[block.data]
    fresh_ = np.ones(len(word), bool)  # no word goes on here from the byte before
    fresh_[1:] = ~word[:-1]
    fresh_[block.offsets[:-1][block.offsets[:-1] < len(word)]] = True
    begins = word & fresh_
    ends = word & np.append(fresh_[1:] | ~word[1:], True) if len(word) else word
    starts = np.flatnonzero(begins)
    lengths = np.flatnonzero(ends) + 1 - starts
    bounds = np.searchsorted(starts, block.offsets)
    data = _LOWER[block.data]
    if most > 1:  # words side by side, with one space after each
        packed = np.full(int(lengths.sum()) + len(starts), 0x20, np.uint8)
        packed[np.arange(np.count_nonzero(word)) + np.cumsum(begins)[word] - 1] = data[word]
        data, starts = packed, np.cumsum(lengths + 1) - lengths - 1
    yield crc32_of(data, starts, lengths), bounds
    for run in range(2, most + 1):
        words = np.diff(bounds)
        runs = np.maximum(words - run + 1, 0)
        own = np.concatenate([[0], np.cumsum(runs)])
        first = np.arange(own[-1]) + np.repeat(bounds[:-1] - own[:-1], runs)
        yield crc32_of(data, starts[first], starts[first + run - 1] + lengths[first + run - 1] - starts[first]), own


def bucket_counts(df: DataFrame, text: str, most: int = 1, buckets: int = BUCKETS) -> np.ndarray:
    """How many features of all texts fall into each bucket. Each task sends a row for each bucket it has met."""
    if not 0 < buckets <= MOST_BUCKETS:
        raise ValueError(f"1 to {MOST_BUCKETS} buckets")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(buckets, np.int64)
        for batch in batches:
            for block in blocks(batch.column(0)):
                for crcs, _ in features(block, most):
                    n += np.bincount(crcs % np.uint32(buckets), minlength=buckets)
        met = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(met), pa.array(n[met])], names=["bucket", "n"])

    found = shipped(df.select(F.col(f"`{text}`").cast("string").alias("text"))).mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(buckets, np.int64)
    out[found.column("bucket").to_numpy()] = found.column("n").to_numpy()
    return out


def gains(own: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 * log ratio) of each bucket, with one added to each count."""
    s, t, b = float(own.sum()), float(target.sum()), len(own)
    return np.array([math.floor(1000 * math.log((y + 1.0) * (s + b) / ((x + 1.0) * (t + b)))) for x, y in zip(own.tolist(), target.tolist(), strict=True)], np.int64)


def _weights(of: np.ndarray, most: int) -> Callable[[], Callable[[pa.Array], Sequence]]:
    def start() -> Callable[[pa.Array], Sequence]:
        def work(texts: pa.Array) -> Sequence:
            n = np.zeros((3, len(texts)), np.int64)  # words, features, weight
            for block in blocks(texts):
                here = slice(block.first, block.first + block.n)
                for run, (crcs, bounds) in enumerate(features(block, most)):
                    total = np.concatenate([[0], np.cumsum(of[crcs % np.uint32(len(of))])])
                    n[0, here] += np.diff(bounds) if run == 0 else 0
                    n[1, here] += np.diff(bounds)
                    n[2, here] += total[bounds[1:]] - total[bounds[:-1]]
            return [pa.array(x) for x in n]

        return work

    return start


def luck(key: Column, seed: int = SEED) -> Column:
    """Gumbel noise in thousandths, from a hash of seed and id."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0))))


_FIELDS = ("n_words", "n_features", "weight")


def _scored(df: DataFrame, of: np.ndarray, key: str, text: str, most: int, seed: int, into: str) -> DataFrame:
    """df with one struct of n_words, n_features, weight and score."""
    made = derived(df, text, [T.StructField(n, T.LongType()) for n in _FIELDS], _weights(of, most), into=into)
    own = F.col(f"`{into}`")
    return made.withColumn(into, F.struct(*[own[n].alias(n) for n in _FIELDS], (own["weight"] + luck(F.col(f"`{key}`"), seed)).alias("score")))


def _gains_of(df: DataFrame, target: DataFrame, text: str, target_text: str, most: int, buckets: int) -> np.ndarray:
    return gains(bucket_counts(df, text, most, buckets), bucket_counts(target, target_text, most, buckets))


def _ranked(df: DataFrame, of: np.ndarray, key: str, text: str, most: int, share: int, least: int, seed: int) -> tuple[DataFrame, int]:
    """((key, n_words, n_features, weight, score, rank), how many are drawn)."""
    scored = _scored(df.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").cast("string").alias("text")), of, "key", "text", most, seed, "made")
    # rows that agree in score and id are told apart by their place, so that however many there are, no partition must hold them all
    scored = materialize(scored.select("key", "made.*", F.monotonically_increasing_id().alias("place")), "scored")
    meant = scored.where(F.col("n_words") >= least)
    take = share * meant.count() // 100
    order = [F.col("score").desc(), F.col("key").asc_nulls_last(), F.col("place")]
    numbered = materialize(meant.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id()), "ordered")
    part, within = F.shiftright("at", 33), F.col("at").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = sorted((r["part"], r["n"]) for r in numbered.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect())  # one row a partition
    before = np.cumsum([0, *(n for _, n in sizes)]).tolist()
    offsets = df.sparkSession.createDataFrame([(p, b) for (p, _), b in zip(sizes, before, strict=False)], "part int, before long")
    rank = F.col("before") + within + 1
    ranked = numbered.withColumn("part", part.cast("int")).join(F.broadcast(offsets), "part").withColumn("rank", F.when(rank <= take, rank))
    cols = ["key", *_FIELDS, "score", "rank"]
    return ranked.select(*cols).unionByName(scored.where(F.col("n_words") < least).withColumn("rank", F.lit(None).cast("long")).select(*cols)), take


def resample_table(df: DataFrame, target: DataFrame, key: str = "doc_id", text: str = "text", target_text: str = "text", most: int = 1, buckets: int = BUCKETS, share: int = SHARE, least: int = LEAST, seed: int = SEED) -> DataFrame:
    """Per row of df: key, n_words, n_features, weight, score, rank (1, 2, ... of those drawn, else null)."""
    with scratch(df.sparkSession):
        ranked, _ = _ranked(df, _gains_of(df, target, text, target_text, most, buckets), key, text, most, share, least, seed)
        return materialize(ranked.withColumnRenamed("key", key), "resampled", keep=True)


def drawn(df: DataFrame, target: DataFrame, key: str = "doc_id", text: str = "text", target_text: str = "text", most: int = 1, buckets: int = BUCKETS, share: int = SHARE, least: int = LEAST, seed: int = SEED) -> DataFrame:
    """The rows of df that are drawn, as they are. They are read again and kept by the last drawn score and id, so no text is shuffled
    and nothing is joined; rows that share both with the last one all stay."""
    of = _gains_of(df, target, text, target_text, most, buckets)
    with scratch(df.sparkSession):
        ranked, take = _ranked(df, of, key, text, most, share, least, seed)
        last = ranked.where(F.col("rank") == take).select("score", "key").first()
    if not last:
        return df.limit(0)
    into = fresh(df.columns, "made")
    own, id_ = F.col(f"`{into}`"), F.col(f"`{key}`")
    # the row of the last rank has its id from df, so the comparison is by the column's own kind
    tie = F.lit(True) if last["key"] is None else F.coalesce(id_ <= F.lit(last["key"]), F.lit(False))
    stays = (own["n_words"] >= least) & ((own["score"] > last["score"]) | ((own["score"] == last["score"]) & tie))
    return _scored(df, of, key, text, most, seed, into).where(stays).select(*[F.col(f"`{c}`") for c in df.columns])
