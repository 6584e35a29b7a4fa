"""Prefix trie of conversations, summed up by leaf peeling.

Conversations that begin with the same turns share nodes: a node at depth d stands for a distinct sequence of d turns (role and text).
A training job that packs a shared opening once saves, at each node, the words of its turn for every conversation but one.

1. Turns are put in order by range, so that a long conversation is cut over as many partitions as its rows need. Running totals within
   partitions, and what they carry into the next ones (`running`), give each turn its position and each prefix a 128-bit hash: the xor
   of hashes of position and turn. Texts are shuffled once, for that order; what follows is thin.
2. Prefixes are counted into nodes, with map-side combine: an opening that a third of all conversations share is a row for each task.
3. Nodes with a single child are drawn together with it: such a chain is one node of the tree that is peeled. Chains lie on the path of
   their smallest member, where running totals tell them apart, so a conversation of thousands of turns costs no rounds.
4. Peeling: a chain knows how many of its children are unfinished. Those without any are complete and send their totals to their
   parents, as one message a parent; counters go down by the number of messages, and the next ones are complete, until the root is.
   There are as many rounds as branchings on the longest way down.

Nulls and ties: null roles and texts are empty ones, a null turn comes first, and equal turns go by role, then text. Rows without a
conversation are left out. Repeated rows are turns of their own. An empty table has no nodes, not even a root. Ids are whole numbers;
other kinds are refused, as the smallest member names a node. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialize, scratch, shipped

WORD = r"[^\x20\x09-\x0D]+"
NODE, PARENT = ("node1", "node2"), ("parent1", "parent2")


def _totals(group: np.ndarray, values: np.ndarray, xor: bool, start: int | None) -> np.ndarray:
    """Running sums or xors within runs of equal groups; the first run goes on from `start`."""
    run = (np.bitwise_xor.accumulate if xor else np.cumsum)(values)
    first = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
    length = np.diff(np.append(first, len(group)))
    before = np.repeat(np.where(first > 0, run[first - 1], 0), length)
    run = run ^ before if xor else run - before
    if start is not None:
        run[: length[0]] = run[: length[0]] ^ start if xor else run[: length[0]] + start
    return run


def running(df: DataFrame, group: str, order: Sequence[Column], keep: Sequence[Column | str], sums: Mapping[str, str], xors: Mapping[str, str]) -> DataFrame:
    """The columns `keep` of df, `group` among them, with running totals within each group by `order`, the row itself included.

    sums and xors: new name to the kept column that it adds up; all are longs and not null. No task needs to see a whole group: rows
    are dealt out by range of group and order, and of each partition only the totals of its last group go to the next ones.
    """
    new = [*sums, *xors]
    of = [*sums.values(), *xors.values()]
    at = [F.col(group), *order]
    rows = df.repartitionByRange(*at).sortWithinPartitions(*at).select(*keep, F.spark_partition_id().cast("long").alias("part_"), F.lit(1).cast("long").alias("one_"))
    kept = [f for f in rows.schema if f.name != "one_"]
    schema = T.StructType([*kept, *[T.StructField(n, T.LongType()) for n in [*new, "row_"]]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, carry = None, None
        for b in batches:
            if not b.num_rows:
                continue
            g = b.column(group).to_numpy()
            goes_on = last is not None and g[0] == last
            made = [_totals(g, b.column(c).to_numpy(), i >= len(sums) and c != "one_", carry[i] if goes_on else None) for i, c in enumerate([*of, "one_"])]
            last, carry = g[-1], [m[-1] for m in made]
            yield pa.RecordBatch.from_arrays([*[b.column(f.name) for f in kept], *[pa.array(m) for m in made]], names=schema.names)

    local = materialize(shipped(rows).mapInArrow(run, schema), "running")
    end = F.max_by(F.struct(*new), F.struct(group, "row_")).alias("end")
    carry, offsets = None, []
    for r in sorted(local.groupBy("part_").agg(F.min(group).alias("first"), F.max(group).alias("last"), end).collect(), key=lambda r: r["part_"]):  # one row a partition
        goes_on = carry is not None and carry[0] == r["first"]
        if goes_on:
            offsets.append((r["part_"], r["first"], *carry[1]))
        whole = carry[1] if goes_on and r["first"] == r["last"] else [0] * len(new)
        carry = r["last"], [int(np.int64(x) ^ np.int64(y)) if i >= len(sums) else x + y for i, (x, y) in enumerate(zip(whole, r["end"], strict=True))]
    if not offsets:
        return local.drop("part_", "row_")
    carried = df.sparkSession.createDataFrame(offsets, T.StructType([T.StructField(n, T.LongType()) for n in ["opart_", "ogroup_", *[f"o{n}_" for n in new]]]))
    both = local.join(F.broadcast(carried), (F.col("part_") == F.col("opart_")) & (F.col(group) == F.col("ogroup_")), "left")
    fixed = {n: F.col(n) + F.coalesce(F.col(f"o{n}_"), F.lit(0)) for n in sums} | {n: F.col(n).bitwiseXOR(F.coalesce(F.col(f"o{n}_"), F.lit(0))) for n in xors}
    return both.select(*[fixed.get(f.name, F.col(f.name)).alias(f.name) for f in schema if f.name not in ("part_", "row_")])


def turns(df: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, pos, x1, x2, words): each turn's position from 1, two hashes of role and text, and its words."""
    if not isinstance(df.schema[key].dataType, T.IntegralType):
        raise ValueError(f"{key} must be a whole number, as nodes go by their smallest member")
    col = lambda c: F.col(f"`{c}`")
    rows = df.where(col(key).isNotNull()).select(col(key).cast("long").alias("conv"), col(turn).alias("turn"), F.coalesce(col(role).cast("string"), F.lit("")).alias("role"), F.coalesce(col(text).cast("string"), F.lit("")).alias("text"))
    thin = ["conv", F.xxhash64("role", "text").alias("x1"), F.xxhash64(F.lit(1), "text", "role").alias("x2"), F.regexp_count("text", F.lit(WORD)).cast("long").alias("words"), F.lit(1).cast("long").alias("pos_")]
    return running(rows, "conv", [F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")], thin, {"pos": "pos_"}, {}).drop("pos_")


def trie(thin: DataFrame, convs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, ends) of turns (conv, pos, x1, x2, words) of the conversations convs (conv), which may have no turns.

    nodes: node1, node2 (the prefix's hash, 0 for the root), conv_id (smallest member), depth, parent_conv_id (null for the root),
    n_convs (members), n_children, n_leaves and saved_tokens (of the subtree). ends: (conv, node1, node2), where each conversation ends.
    """
    y = [F.xxhash64("pos", "x1", "x2").alias("y1"), F.xxhash64(F.lit(7), "pos", "x2", "x1").alias("y2")]
    prefixes = running(thin, "conv", [F.col("pos")], ["conv", "pos", "words", *y], {}, {"node1": "y1", "node2": "y2"})
    prefixes = prefixes.select("conv", "pos", "words", *NODE, F.col("node1").bitwiseXOR(F.col("y1")).alias("parent1"), F.col("node2").bitwiseXOR(F.col("y2")).alias("parent2"))
    zero, none = F.lit(0).cast("long"), F.lit(None).cast("long")
    at_root = convs.select("conv", zero.alias("pos"), zero.alias("words"), zero.alias("node1"), zero.alias("node2"), none.alias("parent1"), none.alias("parent2"))
    members = prefixes.unionByName(at_root)
    ends = materialize(members.groupBy("conv").agg(F.max_by(F.struct(*NODE), "pos").alias("end")).select("conv", "end.*"), "ends")

    counted = members.groupBy(F.col("pos").alias("depth"), *NODE).agg(F.min("conv").alias("conv_id"), F.count("*").alias("n_convs"), F.max("words").alias("words"), F.min("parent1").alias("parent1"), F.min("parent2").alias("parent2"))
    counted = materialize(counted, "prefixes")
    inner = counted.where("depth > 0").groupBy(*PARENT).agg(F.count("*").alias("n_children"))
    inner = materialize(counted.select(*NODE, "conv_id").join(inner.select(F.col("parent1").alias("node1"), F.col("parent2").alias("node2"), "n_children"), list(NODE)), "inner")
    above = inner.select(F.col("node1").alias("parent1"), F.col("node2").alias("parent2"), F.col("conv_id").alias("parent_conv_id"), F.col("n_children").alias("siblings"))
    # children of a hot node share a key here, with one row on the other side: Spark splits those joins where they are skewed
    nodes = counted.join(above, list(PARENT), "left").join(inner.drop("conv_id"), list(NODE), "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)).cast("long"))
    nodes = nodes.withColumns({"own": (F.col("n_convs") - 1) * F.col("words"), "top": F.when(F.coalesce("siblings", F.lit(0)) == 1, F.lit(0)).otherwise(F.lit(1)).cast("long")})
    cols = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "own", "top", *NODE, *PARENT]
    nodes = running(nodes.select(*cols), "conv_id", [F.col("depth")], cols, {"chain": "top", "run": "own"}, {})

    chains = nodes.groupBy("conv_id", "chain").agg(
        F.max_by(F.struct(*NODE, "n_children"), "depth").alias("bottom"), F.min_by(F.struct(*PARENT), "depth").alias("up"), F.min(F.col("run") - F.col("own")).alias("before"), F.max("run").alias("after")
    )
    leaf = F.when(F.col("bottom.n_children") == 0, F.lit(1)).otherwise(F.lit(0)).cast("long")
    totals = peel(chains.select("conv_id", "chain", "before", "bottom.node1", "bottom.node2", "up.*", F.col("bottom.n_children").alias("left"), leaf.alias("leaves"), (F.col("after") - F.col("before")).alias("saved")))
    # the nodes of a chain have its leaves, and save what it saves from them on
    saved = (F.col("saved") - (F.col("run") - F.col("own") - F.col("before"))).alias("saved_tokens")
    out = nodes.join(totals.select("conv_id", "chain", "before", "leaves", "saved"), ["conv_id", "chain"])
    return out.select(*NODE, "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", F.col("leaves").alias("n_leaves"), saved), ends


def peel(tree: DataFrame) -> DataFrame:
    """Sums over subtrees. tree: node1, node2, parent1, parent2 (null for roots), left (children that are unfinished: at first, all of
    them), leaves and saved (the node's own); any other columns. The result has the same rows, with the totals of leaves and saved."""
    unfinished, done = materialize(tree, "peel"), []
    while unfinished.where("left > 0").limit(1).count():
        complete = unfinished.where("left = 0")
        done.append(complete)
        mail = complete.where("parent1 IS NOT NULL").groupBy(F.col("parent1").alias("node1"), F.col("parent2").alias("node2"))
        mail = mail.agg(F.count("*").alias("n_"), F.sum("leaves").alias("leaves_"), F.sum("saved").alias("saved_"))
        zero = F.lit(0).cast("long")
        new = {"left": F.col("left") - F.coalesce("n_", zero), "leaves": F.col("leaves") + F.coalesce("leaves_", zero), "saved": F.col("saved") + F.coalesce("saved_", zero)}
        rest = unfinished.where("left > 0").join(mail, list(NODE), "left").withColumns(new).select(*tree.columns)
        unfinished = materialize(rest, "peel")
    out = unfinished
    for d in done:
        out = out.unionByName(d)
    return out


def prefix_trie(df: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(nodes, ends) of a table of turns, see `trie`."""
    with scratch(df.sparkSession):
        thin = turns(df, key, turn, role, text)
        nodes, ends = trie(thin, thin.select("conv").distinct())
        return materialize(nodes, "trie", keep=True), materialize(ends, "ends", keep=True)


def with_ends(nodes: DataFrame, ends: DataFrame, out: str = "ends_sha256") -> DataFrame:
    """nodes with the SHA-256 of the ids that end there, in order, joined by commas.

    The digest goes through ids one after another, so the ids of a node are strung together in parallel first, in blocks of a batch,
    and one task then reads the node's blocks, a few at a time.
    """
    at = [*NODE, "conv"]
    rows = ends.repartitionByRange(*at).sortWithinPartitions(*at).select(*at)

    def strung(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                a, c, conv = (b.column(x).to_numpy() for x in at)
                first = np.flatnonzero(np.append(True, (a[1:] != a[:-1]) | (c[1:] != c[:-1])))
                texts = [",".join(map(str, conv[i:j].tolist())) for i, j in zip(first, [*first[1:], len(a)], strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(a[first]), pa.array(c[first]), pa.array(conv[first]), pa.array(texts)], names=[*at, "ids"])

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, sha = None, None
        for b in batches:
            found = []
            for a, c, ids in zip(*(b.column(x).to_pylist() for x in (*NODE, "ids")), strict=True):
                if (a, c) != node:
                    if node:
                        found.append((*node, sha.hexdigest()))
                    node, sha = (a, c), hashlib.sha256(ids.encode())
                else:
                    sha.update(b"," + ids.encode())
            yield told(found)
        if node:
            yield told([(*node, sha.hexdigest())])

    def told(found: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], t) for i, t in enumerate([pa.int64(), pa.int64(), pa.string()])], names=[*NODE, out])

    blocks = shipped(rows).mapInArrow(strung, "node1 long, node2 long, conv long, ids string")
    sha = blocks.repartition(*NODE).sortWithinPartitions(*at).mapInArrow(digest, f"node1 long, node2 long, `{out}` string")
    return nodes.join(sha, list(NODE), "left").withColumn(out, F.coalesce(F.col(out), F.lit(hashlib.sha256().hexdigest())))


def texts_of(nodes: DataFrame, df: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Nodes (but the root) with the role and text of their last turn, which their smallest member says at that depth."""
    col = lambda c: F.col(f"`{c}`")
    rows = df.where(col(key).isNotNull()).select(col(key).cast("long").alias("conv_id"), col(turn).alias("turn"), F.coalesce(col(role).cast("string"), F.lit("")).alias("role"), F.coalesce(col(text).cast("string"), F.lit("")).alias("text"), F.lit(1).cast("long").alias("one"))
    said = running(rows, "conv_id", [F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")], ["conv_id", "role", "text", "one"], {"depth": "one"}, {})
    return nodes.join(said.drop("one"), ["conv_id", "depth"])
