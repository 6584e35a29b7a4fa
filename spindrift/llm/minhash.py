"""Near-duplicate documents by MinHash.

A text's set holds the 64-bit hashes of its distinct K-word shingles; two sets link when 100 * |both| >= PERCENT * |either|.

1. Each of HASHES universal hash functions x -> (a * x + b mod 2^64) >> 32 leaves its minimum over the set, vectorised over the
   shingles of many texts at once; the signature has 16 bits of each. Two sets agree at one place with the probability of their
   similarity, or by chance once in 65,536 times.
2. Banding: the signature is cut into bands of rows, and documents that agree in a whole band meet in a bucket. `bands_of` takes the
   most rows a band with which a pair at the threshold still meets in some band but for a probability of MISS: 32 bands of 5 rows at
   85 percent miss 7 pairs in 10^9 that are just similar enough, and fewer of those that are more similar.
3. Signature verification: pairs whose sizes exclude a link go, and those that agree at so few places that a pair at the threshold
   would do so with a probability of UNLIKELY at most. Where many pairs of one bucket are left, sizes and a parity bitmap of each set
   (`jaccard.parity_bitmap`) go before: they bound the difference of two sets exactly, and tell copies that are nearly similar enough
   from those that are.
4. What is left is confirmed on the full sets, so no link is ever wrong.
5. Connected components by alternating large-star and small-star steps.

Skew. Equal sets are one class and take part once. A bucket's documents are paired with one of them first, that which meets most others
over all its buckets: among copies of one text that is the text itself, or what is nearest to it, and the same one in most bands, so a
large group of near copies costs a few pairs for each document. Other pairs of a bucket are looked at only while they lie in different
components (`jaccard.settled`). Buckets of the same documents, as the bands of a group of copies make them, are one bucket. Buckets are
counted with map-side combine and joined to their documents, which Spark splits where a bucket is hot. Nothing is capped.

Nulls and ties: a null, empty or blank text has an empty set and links with nothing; a row without id is counted, links with nothing,
has a null component and is kept; rows that share an id are one document to the links. A text of fewer than K words has its whole
sequence as its only shingle. Ids of other kinds than whole numbers are refused. Other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import join_small, materialize, scratch, shipped
from .graph import components
from .jaccard import K, _across, _common, _pairs_where, parity_bitmap, representatives, settled, shingle_sets, whole_ids
from .textbytes import mix

PERCENT, HASHES = 85, 160
#: chances that banding misses a pair at the threshold, and that signature verification refuses one
MISS, UNLIKELY = 1e-8, 1e-12
#: shingles whose minima are taken in one go, and texts of a batch that is sent on
GROUP, ROWS = 1 << 16, 512

_A, _B = np.random.Generator(np.random.PCG64(20261128)).integers(0, 2**64, (2, HASHES), dtype=np.uint64)


def bands_of(percent: int, miss: float = MISS) -> tuple[int, int]:
    """(bands, rows): the most rows a band for which a pair at the threshold shares none with a probability of `miss` at most."""
    p = percent / 100
    rows = max((r for r in range(1, HASHES + 1) if p == 1 or (1 - p**r) ** (HASHES // r) <= miss), default=1)
    return HASHES // rows, rows


def least_agreement(percent: int, unlikely: float = UNLIKELY) -> int:
    """The most places so that a pair at the threshold agrees at fewer with a probability of `unlikely` at most."""
    p, tail = percent / 100, 0.0
    for n in range(HASHES + 1):
        tail += math.comb(HASHES, n) * p**n * (1 - p) ** (HASHES - n)
        if tail > unlikely:
            return n
    return HASHES


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """(len(sets), HASHES): 16 bits of each minimum; the sets are not empty."""
    starts = np.cumsum([0, *(len(s) for s in sets[:-1])])
    x = np.concatenate(sets) >> np.uint64(32)
    out = np.empty((HASHES, len(sets)), np.uint16)
    for j in range(HASHES):
        # the least of the 64-bit values has the least upper half
        out[j] = (np.minimum.reduceat(x * _A[j] + _B[j], starts) >> np.uint64(32)).astype(np.uint16)
    return np.ascontiguousarray(out.T)


def band_keys(signature: Column, bands: int, rows: int) -> Column:
    """A 64-bit key of each band, its number included."""
    return F.array(*[F.xxhash64(F.lit(b), F.substring(signature, 2 * rows * b + 1, 2 * rows)) for b in range(bands)])


def _profiles(df: DataFrame, k: int) -> DataFrame:
    """(id, n, s1, s2, signature, parity) for each row of (id, text); of an empty set only id and n."""
    names = ["id", "n", "s1", "s2", "signature", "parity"]
    kinds = [pa.int64()] * 4 + [pa.binary()] * 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def told(ids: list, sets: list[np.ndarray]) -> pa.RecordBatch:
            full = [s for s in sets if len(s)]
            made: list[tuple] = []
            at = 0
            while at < len(full):
                last, held = at, 0
                while last < len(full) and (last == at or held + len(full[last]) <= GROUP):
                    held += len(full[last])
                    last += 1
                some = full[at:last]
                for s, sig in zip(some, signatures(some), strict=True):
                    scrambled = mix(s)
                    made.append((len(s), int(np.bitwise_xor.reduce(scrambled).view(np.int64)), int(scrambled.sum(dtype=np.uint64).view(np.int64)), sig.tobytes(), parity_bitmap(s).tobytes()))
                at = last
            own = iter(made)
            out = [(i, *next(own)) if len(s) else (i, 0, None, None, None, None) for i, s in zip(ids, sets, strict=True)]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=names)

        for b in batches:
            key, ids, sets, held = b.column(0).to_pylist(), [], [], 0
            for i, own in shingle_sets(b.column(1), k):
                ids.append(key[i])
                sets.append(own)
                held += len(own)
                if len(ids) >= ROWS or held >= 8 * GROUP:
                    yield told(ids, sets)
                    ids, sets, held = [], [], 0
            if ids:
                yield told(ids, sets)

    return shipped(df).mapInArrow(run, "id long, n long, s1 long, s2 long, signature binary, parity binary")


def _matrix(column: pa.Array) -> np.ndarray:
    """Signatures of a binary column."""
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(-1, HASHES)


def _agreeing(pairs: DataFrame, thin: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sizes and signatures leave room for a link."""
    least = least_agreement(percent)

    def side(s: str) -> DataFrame:
        return thin.select(F.col("id").alias(s), F.col("n").alias(f"n_{s}"), F.col("signature").alias(f"signature_{s}"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in batches:
            n, m = (r.column(f"n_{s}").to_numpy() for s in "ab")
            ok = 100 * np.minimum(n, m) >= percent * np.maximum(n, m)
            for at in range(0, r.num_rows, 1024):  # some at a time as one matrix
                part = slice(at, at + 1024)
                x, y = (_matrix(r.column(f"signature_{s}").slice(at, 1024)) for s in "ab")
                ok[part] &= (x == y).sum(axis=1) >= least
            yield pa.RecordBatch.from_arrays([r.column(s).filter(pa.array(ok)) for s in "ab"], names=["a", "b"])

    return shipped(pairs).join(side("a"), "a").join(side("b"), "b").select("a", "b", "n_a", "n_b", "signature_a", "signature_b").mapInArrow(run, "a long, b long").distinct()


def _confirmed(pairs: DataFrame, docs: DataFrame, k: int, percent: int) -> DataFrame:
    """The pairs whose full sets link. docs: (id, text)."""
    pairs = materialize(pairs, "agreeing")
    wanted = materialize(pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).distinct(), "wanted")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, out, tokens, held = b.column(0).to_pylist(), [], [], 0
            for i, own in shingle_sets(b.column(1), k):
                if len(own):
                    out.append(ids[i])
                    tokens.append(own.tobytes())
                    held += own.nbytes
                if held > 1 << 22:
                    yield pa.RecordBatch.from_arrays([pa.array(out), pa.array(tokens)], names=["id", "tokens"])
                    out, tokens, held = [], [], 0
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(out), pa.array(tokens)], names=["id", "tokens"])

    sets = materialize(shipped(join_small(docs, wanted, "id", "left_semi")).select("id", "text").mapInArrow(run, "id long, tokens binary"), "sets")

    def links(s: bytes, t: bytes) -> bool:
        both = _common(s, t, np.uint64)
        return both > 0 and 100 * both >= percent * (len(s) // 8 + len(t) // 8 - both)

    return materialize(_pairs_where(pairs, sets, ("tokens",), links).distinct(), "links")


def minhash_components(df: DataFrame, key: str = "doc_id", text: str = "text", k: int = K, percent: int = PERCENT) -> DataFrame:
    """Per row of df: key, n_shingles, component_id (smallest id that links reach, its own included), kept (whether that is its own id)."""
    whole_ids(df, key)
    with scratch(df.sparkSession):
        return _components_of(df, key, text, k, percent)


def _components_of(df: DataFrame, key: str, text: str, k: int, percent: int) -> DataFrame:
    docs = df.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text"))
    profiles = materialize(_profiles(docs, k), "profiles")
    full = profiles.where("n > 0 AND id IS NOT NULL")

    # one document stands for each distinct set
    classes = full.groupBy("s1", "s2", "n").agg(F.min("id").alias("leader"), F.count("*").alias("size"))
    classes = materialize(classes.where("size > 1").drop("size"), "classes")
    copies = materialize(full.select("id", "s1", "s2", "n").join(classes, ["s1", "s2", "n"]).groupBy("id", "leader").agg(F.count("*").alias("rows")), "copies")
    # an id that has several sets isn't told by its copy alone
    several = full.groupBy("id").agg(F.min(F.struct("s1", "s2", "n")).alias("x"), F.max(F.struct("s1", "s2", "n")).alias("y")).where("x <> y")
    spare = materialize(copies.where("id <> leader").select("id").distinct().join(several, "id", "left_anti"), "spare")
    alone = join_small(docs.where("id IS NOT NULL"), spare, "id", "left_anti")
    thin = join_small(full, spare, "id", "left_anti")
    again = materialize(copies.where("id = leader AND rows > 1").select("id"), "again")  # repeated rows of one id
    if again.limit(1).count():
        thin = join_small(thin, again, "id", "left_anti").unionByName(join_small(thin, again, "id", "left_semi").dropDuplicates(["id", "s1", "s2"]))

    met = thin.select("id", F.explode(band_keys(F.col("signature"), *bands_of(percent))).alias("bucket"))
    sized = met.groupBy("bucket").agg(F.count("*").alias("size"), F.min("id").alias("least"), F.bit_xor(F.xxhash64("id")).alias("x")).where("size > 1")
    # buckets of the same documents are one, of as many bands
    sized = materialize(sized.groupBy("size", "least", "x").agg(F.min("bucket").alias("bucket"), F.count("*").alias("bands")).select("bucket", "size", "bands"), "sized")
    buckets = materialize(met.join(sized, "bucket"), "buckets")
    popular = buckets.groupBy("id").agg(F.sum(F.col("size") * F.col("bands")).alias("meets"))
    popular = materialize(popular, "popular")
    heads = buckets.join(popular, "id").groupBy("bucket").agg(F.max_by("id", F.struct("meets", -F.col("id"))).alias("head"))
    around = buckets.join(heads, "bucket").where("id <> head").select(F.least("id", "head").alias("a"), F.greatest("id", "head").alias("b"))
    star = materialize(around.distinct(), "stars")
    near = materialize(join_small(thin.select("id", "n", "signature", "parity"), popular.select("id"), "id", "left_semi"), "near")
    links = settled(
        buckets.select("bucket", "size", "id"), star, profiles.count(),
        lambda pairs: _confirmed(_agreeing(pairs, near, percent), alone, k, percent),
        lambda members: _across(members, near, percent),
    )
    same = copies.where("id <> leader").select(F.col("leader").alias("a"), F.col("id").alias("b"))
    found = materialize(components(links.unionByName(same)), "components")
    out = profiles.select("id", F.col("n").alias("n_shingles")).join(found.withColumnRenamed("node", "id"), "id", "left").withColumn("component_id", F.coalesce("component", "id"))
    kept = F.coalesce(F.col("component_id") == F.col("id"), F.lit(True)).alias("kept")
    return materialize(out.select(F.col("id").alias(key), "n_shingles", "component_id", kept), "minhash", keep=True)


def one_of_each(df: DataFrame, key: str = "doc_id", text: str = "text", k: int = K, percent: int = PERCENT) -> DataFrame:
    """The rows of df less those whose component has a smaller id; of rows that share an id one stays. Rows without id stay."""
    return representatives(df, minhash_components(df, key, text, k, percent), key)
