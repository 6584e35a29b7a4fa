"""N-gram Jaccard join with several global token orders.

A text's set holds the 64-bit hashes of its distinct K-word shingles; two sets link when 100 * |both| >= PERCENT * |either|. Linked
sets share a token among the first n - ceil(PERCENT * n / 100) + 1 of either, in any order of tokens that is the same for all
sets. That holds for every order at once, so a pair is a candidate only when it passes under all of them:

1. Order 1 puts frequent tokens last, by the power of two of their number of documents, and then goes by a hash. All tokens of the
   corpus are counted for that, as sorted runs of their first 32 bits that are merged by range; the frequent ones, at most
   MOST_FREQUENT of them and none below FREQUENT documents, are known to all tasks. Order 1's prefix tokens are dealt out, and the
   documents that meet at a token are looked at together.
2. A parity bitmap of the whole set, about a bit for each token, bounds |a xor b| from below; pairs beyond
   (|a| + |b|) * (100 - P) / (100 + P) go before anything larger is sent.
3. Orders 2 and 3 go by two other hashes; pairs without a common prefix token under either go.
4. What is left is verified exactly on the sorted sets.

Only exact steps prune: no link between different texts is lost, and there is no cap on documents, tokens or partners.

Skew. Equal sets are one class and take part once. Buckets with the same members are one bucket. In a first round each bucket's
documents are paired with its smallest one only (in large buckets with HEADS others too), verified, and joined into components; so
a large group of near copies costs a few pairs for each document. While many pairs are open, that is repeated around other
documents. Then a bucket is looked at again only if its documents still belong to several components, and all pairs across
components are compared, in square blocks of at most BLOCK documents a side, vectorized over bitmaps. Tokens that the sketch finds
frequent are counted by an aggregation with map-side combine, the others by a window.

Nulls and ties: a null, empty or blank text has an empty set and links with nothing; a row without id is counted but links with
nothing and gets a null component; rows that share an id are one document to the links. Ids of other kinds than whole numbers are
refused. Other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import join_small, materialize, scratch, shipped
from .graph import components
from .textbytes import blocks, mix, windows

K, PERCENT = 5, 75
#: tokens in fewer documents than this count as rare; how many frequent ones are sent to all tasks at most (5 bytes each)
FREQUENT, MOST_FREQUENT = 16, 1 << 20
#: counted tokens: values that a task sorts at a time, ranges that their runs are cut into, values that one range may have when runs are merged,
#: and up to which small ranges are merged by one task
RUN, RANGES, MERGED, GROUPED = 1 << 21, 1 << 10, 1 << 22, 1 << 18
#: buckets whose token may stand in more documents than this take the way for hot tokens
HOT = 50_000
BLOCK = 512
#: in buckets of this many documents or more, so many others are heads of a star besides the smallest
WIDE, HEADS = 16, 3
#: open pairs for each document from which on another round of stars comes before the exact comparison
OPEN_PAIRS = 100
_ORDER_SALT = (np.uint64(0x5851F42D4C957F2D), np.uint64(0x14057B7EF767814F), np.uint64(0x2545F4914F6CDD1D))


def shingle_sets(texts: pa.Array, k: int = K) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct shingle hashes) of every text."""
    for b in blocks(texts):
        hashes, bounds = b.words(lower=True)
        wide = windows(hashes, k, k)
        for t in range(b.n):
            lo, hi = bounds[t], bounds[t + 1]
            if hi - lo >= k:
                own = np.sort(wide[lo : hi - k + 1])
                yield b.first + t, own[np.append(True, own[1:] != own[:-1])]
            elif hi > lo:
                yield b.first + t, windows(hashes[lo:hi], int(hi - lo), int(hi - lo))
            else:
                yield b.first + t, np.zeros(0, np.uint64)


def prefix_length(n: int, percent: int) -> int:
    return n - -(-percent * n // 100) + 1


def prefix(tokens: np.ndarray, rank: np.ndarray, p: int) -> np.ndarray:
    return tokens[np.argpartition(rank, p - 1)[:p]] if p < len(tokens) else tokens


def parity_bitmap(tokens: np.ndarray) -> np.ndarray:
    """Bit i: whether an odd number of tokens falls on i. As many bits as tokens or more, 256 to 65536."""
    size = min(1 << 16, max(256, 1 << int(len(tokens) - 1).bit_length()))
    odd = np.bincount((mix(tokens) & np.uint64(size - 1)).astype(np.int64), minlength=size) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.uint64)


def folded(bitmap: np.ndarray, words: int) -> np.ndarray:
    """The bitmap (last axis) as it would be with fewer bits."""
    while bitmap.shape[-1] > words:
        half = bitmap.shape[-1] // 2
        bitmap = bitmap[..., :half] ^ bitmap[..., half:]
    return bitmap


def other_prefixes(tokens: np.ndarray, percent: int) -> tuple[bytes, bytes]:
    """The prefixes under orders 2 and 3, as sorted 32-bit values: sharing a token implies sharing a value."""
    p = prefix_length(len(tokens), percent)
    out = []
    for salt in _ORDER_SALT[1:]:
        ranks = np.sort(mix(tokens ^ salt))[:p]  # the hash is a bijection, so ranks stand for tokens
        out.append(np.sort((ranks & np.uint64(0xFFFFFFFF)).astype(np.uint32)).tobytes())
    return out[0], out[1]


def _packed(values: np.ndarray, counts: np.ndarray) -> bytes:
    """A run of distinct sorted values and their counts; steps between values are small, so their high bytes are zero."""
    step = np.diff(values, prepend=np.uint32(0)).astype("<u4")
    return zlib.compress(np.concatenate([x.astype("<u4").view(np.uint8).reshape(-1, 4).T.ravel() for x in (step, counts)]).tobytes(), 1)


def _unpacked(run: bytes) -> tuple[np.ndarray, np.ndarray]:
    raw = np.frombuffer(zlib.decompress(run), np.uint8).reshape(2, 4, -1)
    step, counts = (np.ascontiguousarray(x.T).view("<u4").ravel() for x in raw)
    return np.cumsum(step, dtype=np.uint32), counts


def _merged(runs: Iterator[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The values of many runs, and their counts added up (at most 2^32 - 1)."""
    parts = [_unpacked(r) for r in runs]
    values = np.concatenate([v for v, _ in parts])
    order = np.argsort(values, kind="stable")
    values, counts = values[order], np.concatenate([c for _, c in parts])[order].astype(np.uint64)
    starts = np.flatnonzero(np.append(True, values[1:] != values[:-1]))
    return values[starts], np.minimum(np.add.reduceat(counts, starts), 0xFFFFFFFF).astype(np.uint32)


def _cut(values: np.ndarray, counts: np.ndarray, ranges: int) -> Iterator[tuple[int, bytes]]:
    """(range, run) for each of the even ranges of 32 bits that has values."""
    shift = np.uint32(32 - (ranges.bit_length() - 1))
    at = np.append(np.searchsorted(values >> shift, np.arange(ranges)) if shift < 32 else 0, len(values))
    for r in np.flatnonzero(np.diff(at)):
        yield int(r), _packed(values[at[r] : at[r + 1]], counts[at[r] : at[r + 1]])


def _profiles(df: DataFrame, k: int) -> DataFrame:
    """A row (id, n, s1, s2, parity) for each text, and rows (part, run) of the tokens of each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        names = ["id", "n", "s1", "s2", "parity", "part", "run"]
        kinds = [pa.int64()] * 4 + [pa.binary(), pa.int32(), pa.binary()]

        def out(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

        def counted() -> Iterator[pa.RecordBatch]:
            if held:
                values, counts = np.unique(np.concatenate(held), return_counts=True)
                held.clear()
                yield out([(None,) * 5 + row for row in _cut(values, counts.astype(np.uint32), RANGES)])

        size = 0
        for b in batches:
            ids, rows = b.column(0).to_pylist(), []
            for i, own in shingle_sets(b.column(1), k):
                if len(own):
                    held.append((own >> np.uint64(32)).astype(np.uint32))
                    size += len(own)
                    scrambled = mix(own ^ _ORDER_SALT[0])
                    s1, s2 = int(np.bitwise_xor.reduce(scrambled).view(np.int64)), int(scrambled.sum(dtype=np.uint64).view(np.int64))
                    rows.append((ids[i], len(own), s1, s2, parity_bitmap(own).tobytes(), None, None))
                else:
                    rows.append((ids[i], 0, None, None, None, None, None))
                if len(rows) >= 512:
                    yield out(rows)
                    rows = []
                if size >= RUN:
                    yield from counted()
                    size = 0
            if rows:
                yield out(rows)
        yield from counted()

    return shipped(df).mapInArrow(run, "id long, n long, s1 long, s2 long, parity binary, part int, run binary")


def _frequent(runs: DataFrame, total: int) -> tuple[np.ndarray, np.ndarray]:
    """(values, levels): the first 32 bits of the most frequent tokens, sorted, and floor(log2) of their numbers of documents.

    Ranges are as many as keep each at about MERGED values: a few of those that the runs were cut into are merged together, or, in a
    large corpus, each is merged in parts, cut again, and dealt out once more.
    """
    each = max(1, total // RANGES)
    key = F.col("part")
    if each > MERGED:
        more = 1 << (each // MERGED).bit_length()

        def again(rows: pd.DataFrame) -> pd.DataFrame:
            return pd.DataFrame(_cut(*_merged(iter(rows["run"])), RANGES * more), columns=["part", "run"])

        # as many parts of a range as there will be ranges of it: each has about MERGED values as well
        parts = runs.select("part", "run", F.pmod(F.xxhash64("run"), F.lit(more)).alias("some"))
        runs = materialize(shipped(parts).groupBy("part", "some").applyInPandas(again, "part int, run binary"), "runs")
    else:
        key = F.floor(F.col("part") / max(1, GROUPED // each))

    def add(rows: pd.DataFrame) -> pd.DataFrame:
        values, counts = _merged(iter(rows["run"]))
        often = counts >= FREQUENT
        return pd.DataFrame({"value": values[often].astype(np.int64), "level": np.floor(np.log2(counts[often])).astype(np.int32)})

    found = materialize(shipped(runs.select(key.alias("key"), "run")).groupBy("key").applyInPandas(add, "value long, level int"), "frequent")
    room, least = MOST_FREQUENT, 64
    for level, n in sorted(((r["level"], r["count"]) for r in found.groupBy("level").count().collect()), reverse=True):
        if n > room:
            break
        room, least = room - n, level
    top = found.where(F.col("level") >= least).toArrow()
    values, levels = top.column("value").to_numpy().astype(np.uint32), top.column("level").to_numpy().astype(np.uint8)
    order = np.argsort(values)
    return values[order], levels[order]


def token_levels(tokens: np.ndarray, values: np.ndarray, levels: np.ndarray) -> np.ndarray:
    """The level of each token, 0 for those that aren't frequent."""
    if not len(values):
        return np.zeros(len(tokens), np.uint8)
    own = (tokens >> np.uint64(32)).astype(np.uint32)
    at = np.minimum(np.searchsorted(values, own), len(values) - 1)
    return np.where(values[at] == own, levels[at], 0).astype(np.uint8)


HOT_LEVEL = HOT.bit_length() - 1


def _postings(df: DataFrame, values: np.ndarray, levels: np.ndarray, k: int, percent: int) -> DataFrame:
    """(token, id, hot) for the tokens of each text's prefix under order 1."""
    shared = df.sparkSession.sparkContext.broadcast((values, levels))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for b in batches:
            ids, out, hot, owner, held = b.column(0).to_numpy(zero_copy_only=False), [], [], [], 0
            for i, own in shingle_sets(b.column(1), k):
                if not len(own):
                    continue
                level = token_levels(own, *known)
                rank = (level.astype(np.uint64) << np.uint64(56)) | (mix(own ^ _ORDER_SALT[0]) >> np.uint64(8))
                first = prefix(np.arange(len(own)), rank, prefix_length(len(own), percent))
                out.append(own[first])
                hot.append(level[first] >= HOT_LEVEL)
                owner.append(np.full(len(first), ids[i], np.int64))
                held += len(first)
                if held > 50_000:
                    yield batch(out, hot, owner)
                    out, hot, owner, held = [], [], [], 0
            if out:
                yield batch(out, hot, owner)

    def batch(out: list, hot: list, owner: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(out).view(np.int64)), pa.array(np.concatenate(owner)), pa.array(np.concatenate(hot))], names=["token", "id", "hot"])

    return shipped(df).mapInArrow(run, "token long, id long, hot boolean")


def _buckets(postings: DataFrame, any_hot: bool) -> DataFrame:
    """(bucket, size, leader, id): the documents that meet at a prefix token, tokens with the same documents taken together."""
    mark = F.xxhash64("id")
    told = [F.count("*").alias("size"), F.min("id").alias("leader"), F.bit_xor(mark).alias("x")]
    by = Window.partitionBy("token")
    cold = postings.where("NOT hot") if any_hot else postings
    cold = cold.select("id", F.count("*").over(by).alias("size"), F.min("id").over(by).alias("leader"), F.bit_xor(mark).over(by).alias("x"))
    both = cold.where("size > 1")
    if any_hot:
        hot = postings.where("hot")
        both = both.unionByName(hot.join(hot.groupBy("token").agg(*told).where("size > 1"), "token").select("id", "size", "leader", "x"))
    return both.select(F.xxhash64("size", "leader", "x").alias("bucket"), "size", "leader", "id").distinct()


def _near(n: int, x: bytes, m: int, y: bytes, percent: int) -> bool:
    """Whether sizes and bitmaps leave room for a link."""
    if 100 * min(n, m) < percent * max(n, m):
        return False
    a, b = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
    words = min(len(a), len(b))
    return int(np.bitwise_count(folded(a, words) ^ folded(b, words)).sum()) * (100 + percent) <= (n + m) * (100 - percent)


def _common(x: bytes, y: bytes, kind: type) -> int:
    """How many values two sorted sets share."""
    a, b = np.frombuffer(x, kind), np.frombuffer(y, kind)
    if len(a) > len(b):
        a, b = b, a
    return int((b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a).sum()) if len(a) else 0


def _pairs_where(pairs: DataFrame, told: DataFrame, cols: Sequence[str], test: Callable[..., bool]) -> DataFrame:
    """The pairs (a, b) for which test(*cols of a, *cols of b) holds; told has a row for each id."""
    names = [f"{s}_{c}" for s in "ab" for c in cols]

    def side(s: str) -> DataFrame:
        return told.select(F.col("id").alias(s), *[F.col(c).alias(f"{s}_{c}") for c in cols])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in batches:
            ok: list[bool] = []
            for at in range(0, r.num_rows, 128):  # few rows at a time as Python objects: those with sets are large
                part = r.slice(at, 128)
                ok += [test(*row) for row in zip(*(part.column(x).to_pylist() for x in names), strict=True)]
            yield pa.RecordBatch.from_arrays([r.column(x).filter(pa.array(ok, pa.bool_())) for x in "ab"], names=["a", "b"])

    return shipped(pairs).join(side("a"), "a").join(side("b"), "b").mapInArrow(run, "a long, b long")


def _filtered(pairs: DataFrame, profiles: DataFrame, percent: int) -> DataFrame:
    return _pairs_where(pairs, profiles, ("n", "parity"), lambda n, x, m, y: _near(n, x, m, y, percent)).distinct()


def _verified(pairs: DataFrame, docs: DataFrame, k: int, percent: int) -> DataFrame:
    """The pairs that pass under orders 2 and 3 and whose sets link. docs: (id, text)."""
    pairs = materialize(pairs, "candidates")
    wanted = materialize(pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).distinct(), "wanted")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), [pa.int64(), *[pa.binary()] * 3], strict=True)], names=["id", "tokens", "second", "third"])

        for b in batches:
            ids, rows, held = b.column(0).to_pylist(), [], 0
            for i, own in shingle_sets(b.column(1), k):
                if len(own):
                    rows.append((ids[i], own.tobytes(), *other_prefixes(own, percent)))
                    held += own.nbytes
                if held > 1 << 22:
                    yield out(rows)
                    rows, held = [], 0
            if rows:
                yield out(rows)

    sets = materialize(shipped(join_small(docs, wanted, "id", "left_semi")).select("id", "text").mapInArrow(run, "id long, tokens binary, second binary, third binary"), "sets")
    pairs = _pairs_where(pairs, sets, ("second", "third"), lambda s, t, u, v: _common(s, u, np.uint32) > 0 and _common(t, v, np.uint32) > 0)

    def links(s: bytes, t: bytes) -> bool:
        both = _common(s, t, np.uint64)
        return both > 0 and 100 * both >= percent * (len(s) // 8 + len(t) // 8 - both)

    return materialize(_pairs_where(pairs.distinct(), sets, ("tokens",), links).distinct(), "links")


def _near_pairs(group: np.ndarray, side: np.ndarray, n: np.ndarray, comp: np.ndarray, maps: list[np.ndarray], percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers of the pairs within a group, across components and (where side is not -1) sides, that sizes and bitmaps leave.

    Rows are in order of group, then n. Row r is compared with r + 1, r + 2, ... of all groups at once, until none is in reach.
    """
    words = np.array([len(m) for m in maps])
    # by number of words: the bitmaps of that many, and those of twice as many folded; a partner in reach has no more
    stacks = {}
    for w in np.unique(words):
        rows = np.flatnonzero((words == w) | (words == 2 * w))
        place = np.full(len(maps), -1)
        place[rows] = np.arange(len(rows))
        stacks[w] = np.stack([folded(maps[r], int(w)) for r in rows]), place
    left, right = [], []
    alive, shift = np.arange(len(maps)), 0
    while True:
        shift += 1
        alive = alive[alive + shift < len(maps)]
        other = alive + shift
        alive = alive[(group[alive] == group[other]) & (100 * n[alive] >= percent * n[other])]
        if not len(alive):
            break
        other = alive + shift
        ok = (comp[alive] != comp[other]) & ((side[alive] != side[other]) | (side[alive] < 0))
        x, y = alive[ok], other[ok]
        for w, (stack, place) in stacks.items():
            own = words[x] == w
            u, v = x[own], y[own]
            if len(u):
                far = np.bitwise_count(stack[place[u]] ^ stack[place[v]]).sum(axis=1, dtype=np.int64)
                near = far * (100 + percent) <= (n[u] + n[v]) * (100 - percent)
                left.append(u[near])
                right.append(v[near])
    none = np.zeros(0, np.int64)
    return np.concatenate(left or [none]), np.concatenate(right or [none])


def _across(members: DataFrame, profiles: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of one bucket in different components that sizes and bitmaps leave. members: (bucket, size, id, component).

    A bucket of more than BLOCK documents is dealt out as the pairs of its parts, each a group of its own. A pair that meets in
    several buckets is told by the first of them only, so each document brings the list of its buckets.
    """
    lists = members.groupBy("id").agg(F.sort_array(F.collect_list("bucket")).alias("lists"))
    sides = F.ceil(F.col("size") / F.lit(BLOCK)).cast("int")
    dealt = members.withColumn("own", F.pmod(F.xxhash64("id"), sides).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), sides - 1)))
    i, j = F.least("own", "other"), F.greatest("own", "other")
    dealt = dealt.select(F.xxhash64("bucket", i, j).alias("grp"), F.when(i == j, F.lit(-1)).otherwise(F.col("own")).alias("side"), "bucket", "id", "component")
    dealt = dealt.join(profiles.select("id", "n", "parity"), "id").join(lists, "id").repartition("grp").sortWithinPartitions("grp", "n", "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None

        def pairs(t: pa.Table) -> pa.RecordBatch:
            grp, side, ids, comp, n = (t.column(c).to_numpy() for c in ("grp", "side", "id", "component", "n"))
            x, y = _near_pairs(grp, side, n, comp, [np.frombuffer(m, np.uint64) for m in t.column("parity").to_pylist()], percent)
            bucket, told = t.column("bucket").to_numpy(), t.column("lists")
            own = {r: frozenset(told[int(r)].as_py()) for r in np.unique(np.concatenate([x, y]))}
            first = np.array([min(own[u] & own[v]) == bucket[u] for u, v in zip(x, y, strict=True)], bool)
            x, y = x[first], y[first]
            return pa.RecordBatch.from_arrays([pa.array(np.minimum(ids[x], ids[y])), pa.array(np.maximum(ids[x], ids[y]))], names=["a", "b"])

        for b in batches:
            t = pa.Table.from_batches([b])
            t = pa.concat_tables([held, t]).combine_chunks() if held is not None else t
            grp = t.column("grp").to_numpy()
            whole = int(np.searchsorted(grp, grp[-1])) if len(grp) else 0  # the last group may go on
            held = t.slice(whole)
            if whole:
                yield pairs(t.slice(0, whole))
        if held is not None and held.num_rows:
            yield pairs(held)

    return shipped(dealt).select("grp", "side", "bucket", "id", "component", "n", "parity", "lists").mapInArrow(run, "a long, b long").distinct()


def settled(buckets: DataFrame, star: DataFrame, total: int, check: Callable[[DataFrame], DataFrame], across: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Links (a, b) that join all documents of buckets (bucket, size, id) whose sets link, directly or through others.

    star: the first pairs. check: the pairs that are links, as a written table. across: of rows (bucket, size, id, component), the
    pairs of one bucket and several components that may be links. total: documents, for the measure of what is left open.
    """
    links = check(star)
    found = components(links)

    # Documents that share tokens but no component yet. Where they would make more pairs than some for each document, stars around
    # other leaders come first: members of a large group link up with one of these, and few are left for the exact comparison.
    done = 0
    while True:
        members = buckets.where("size > 2").join(found.withColumnRenamed("node", "id"), "id", "left").withColumn("component", F.coalesce("component", "id"))
        parts = members.groupBy("bucket", "component").agg(F.count("*").alias("c")).groupBy("bucket").agg(F.sum("c").alias("n"), F.sum(F.col("c") * F.col("c")).alias("s"))
        mixed = materialize(parts.where("n * n > s").withColumn("open", (F.col("n") * F.col("n") - F.col("s")) / 2), "mixed")
        members = materialize(join_small(members, mixed.select("bucket"), "bucket", "left_semi"), "members")
        open_pairs = mixed.agg(F.sum("open")).first()[0] or 0
        if open_pairs <= OPEN_PAIRS * total:
            break
        done += 1
        heads = members.groupBy("bucket").agg(F.min_by(F.struct("id", "component"), F.xxhash64(F.lit(done), "id")).alias("h"))
        around = join_small(members, materialize(heads, "heads"), "bucket").where("component <> h.component")
        again = check(around.select(F.least("id", "h.id").alias("a"), F.greatest("id", "h.id").alias("b")).distinct())
        links = links.unionByName(again)
        if again.count() <= total // 1000:
            break
        found = components(links)
    return links.unionByName(check(across(members).join(star, ["a", "b"], "left_anti"))) if open_pairs else links


def jaccard_components(df: DataFrame, key: str = "doc_id", text: str = "text", k: int = K, percent: int = PERCENT) -> DataFrame:
    """Per row of df: key, n_shingles, component_id (smallest id that links reach, its own included). Ids are whole numbers."""
    whole_ids(df, key)
    with scratch(df.sparkSession):
        return _components_of(df, key, text, k, percent)


def _components_of(df: DataFrame, key: str, text: str, k: int, percent: int) -> DataFrame:
    docs = df.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text"))
    told = materialize(_profiles(docs, k), "profiles")
    profiles = told.where("part IS NULL").drop("part", "run")
    total, shingles = profiles.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    values, levels = _frequent(told.where("part IS NOT NULL").select("part", "run"), shingles)

    # one document stands for each distinct set
    classes = profiles.where("n > 0").groupBy("s1", "s2", "n").agg(F.min("id").alias("leader"), F.count("*").alias("size"))
    classes = materialize(classes.where("size > 1 AND leader IS NOT NULL").drop("size"), "classes")
    copies = materialize(profiles.select("id", "s1", "s2", "n").join(classes, ["s1", "s2", "n"]).where("id IS NULL OR id <> leader").select("id", "leader").distinct(), "copies")
    # an id that has several sets isn't told by its copy alone
    several = profiles.where("n > 0 AND id IS NOT NULL").groupBy("id").agg(F.min(F.struct("s1", "s2", "n")).alias("x"), F.max(F.struct("s1", "s2", "n")).alias("y")).where("x <> y")
    spare = copies.where("id IS NOT NULL").select("id").join(several, "id", "left_anti")
    alone = join_small(docs.where("id IS NOT NULL"), spare, "id", "left_anti")
    thin = profiles.where("n > 0 AND id IS NOT NULL").dropDuplicates(["id", "s1", "s2"])
    # a document of one id and several texts has a profile for each

    buckets = materialize(_buckets(_postings(alone, values, levels, k, percent), bool((levels >= HOT_LEVEL).any())), "buckets")
    star = buckets.where("id <> leader").select(F.col("leader").alias("a"), F.col("id").alias("b"))
    wide = buckets.where(F.col("size") >= WIDE)
    heads = wide.groupBy("bucket").agg(F.array(*[F.min_by("id", F.xxhash64(F.lit(-h), "id")) for h in range(1, HEADS + 1)]).alias("heads"))
    around = join_small(wide, materialize(heads, "heads"), "bucket").select("id", F.explode("heads").alias("head")).where("id <> head")
    star = materialize(star.unionByName(around.select(F.least("id", "head").alias("a"), F.greatest("id", "head").alias("b"))).distinct(), "stars")
    links = settled(buckets, star, total, lambda pairs: _verified(_filtered(pairs, thin, percent), alone, k, percent), lambda members: _across(members, thin, percent))
    same = copies.where("id IS NOT NULL").select(F.col("leader").alias("a"), F.col("id").alias("b"))
    found = materialize(components(links.unionByName(same)), "components")
    out = profiles.select("id", F.col("n").alias("n_shingles")).join(found.withColumnRenamed("node", "id"), "id", "left")
    return materialize(out.select(F.col("id").alias(key), "n_shingles", F.coalesce("component", "id").alias("component_id")), "jaccard", keep=True)


def whole_ids(df: DataFrame, key: str) -> None:
    """Components go by their smallest id as a number; ids of other kinds are refused, as a cast would lose some of them."""
    if not isinstance(df.schema[key].dataType, T.IntegralType):
        raise ValueError(f"{key} must be a whole number")


def one_of_each(df: DataFrame, key: str = "doc_id", text: str = "text", k: int = K, percent: int = PERCENT) -> DataFrame:
    """The rows of df less those whose component has a smaller id; of rows that share an id one stays. Rows without id stay."""
    return representatives(df, jaccard_components(df, key, text, k, percent), key)


def representatives(df: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """The rows of df whose component, as found has it, goes by their own id; of rows that share an id one stays."""
    spare = found.where(F.col("component_id") != F.col(key)).select(F.col(key)).distinct()
    left = join_small(df, spare, key, "left_anti")
    twice = materialize(found.where(F.col(key).isNotNull()).groupBy(key).count().where("count > 1").select(key), "twice")
    if not twice.limit(1).count():
        return left
    return join_small(left, twice, key, "left_anti").unionByName(join_small(left, twice, key, "left_semi").dropDuplicates([key]))
