"""Mixing sources to target weights by pivotal dependent rounding, in DataFrame functions only.

Every document of a source starts with the copy number target / source size. Its whole part is taken; the fraction is a
probability that pivotal rounding turns into 0 or 1: two documents meet, words move from one to the other in a random direction
until one fraction is integral, and the other goes on. What is moved is words (fraction times size), so the words that a source
gives stay the same in every step, and each document keeps its expected number of copies. The documents of a source are dealt into
buckets of about FAN rows by hash; each bucket leaves one undecided residual, the residuals are dealt again, and so on up a tree
whose top they reach together with about RESERVE documents that were held back. What is left there, one for a source, is drawn
with its own fraction. The taken words miss the target by less than that one document's size.

Randomness is a hash of the seed and the row, so reruns agree. Nulls: a null text has size 0, a null source is a source of its
own and comes last, a null id hashes like any value. Documents of size 0 are taken 0 times. Repeated rows are documents of their
own; those of one id only differ in luck. Empty tables give empty results. Sources meet in one window: there may be some millions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh, join_small, materialize, scratch

WEIGHTS = (5.0, 2.0, 1.0)
MOST_COPIES = 3.0
FAN = 64
#: documents of each source, about, that only join at the top of the tree, large ones first, so that a small one is left over
RESERVE = 1024
WORD = r"[^\x20\x09-\x0D]+"


def targets(sizes: DataFrame, source: str = "source") -> DataFrame:
    """(source, source_size, n, target) per source, from rows of (source, size).

    target = min(cap, level * weight), where cap is MOST_COPIES times the source's size and the level makes the targets add up to
    all sizes: what resharing the excess by weight again and again comes to. The sources are put in order of cap / weight; those
    before the level are capped. One row a source is all that meets here.
    """
    by = sizes.groupBy(source).agg(F.sum("size").alias("source_size"), F.count_if(F.col("size") > 0).alias("n"))
    rank = F.row_number().over(Window.orderBy(F.col(source).asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(w) for w in WEIGHTS]), (rank % len(WEIGHTS) + 1).cast("int"))
    by = by.withColumn("weight", weight).withColumn("cap", F.col("source_size") * MOST_COPIES)
    order = Window.orderBy(F.col("cap") / F.col("weight"), F.col(source).asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    onward = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    by = by.withColumn("capped", F.coalesce(F.sum("cap").over(before), F.lit(0.0))).withColumn("open", F.sum("weight").over(onward)).withColumn("total", F.sum("source_size").over(Window.partitionBy()))
    by = by.withColumn("level", (F.col("total") - F.col("capped")) / F.col("open"))
    # the first source that its level doesn't fill sets the level of all that follow
    by = by.withColumn("set", F.first(F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.col("level")), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return by.select(source, "source_size", "n", F.coalesce(F.least("cap", F.col("set") * F.col("weight")), F.col("cap")).alias("target"))


def draw(*of: Column | str | int) -> Column:
    """Uniform in [0, 1), from a hash."""
    cols = [F.lit(x) if isinstance(x, int) else x for x in of]
    return F.shiftrightunsigned(F.xxhash64(*cols), 11).cast("double") / F.lit(float(1 << 53))


def _meet(items: Column, seed: int, level: int, key: str) -> Column:
    """Fold of one bucket: (rest: the undecided one, done: array of the decided). Items are struct<key, size, p, ...>; key: its kind."""
    kind = f"struct<key:{key},size:bigint,p:double>"
    start = F.struct(F.lit(None).cast(kind).alias("rest"), F.array().cast(f"array<{kind}>").alias("done"))

    def item(of: Column, p: Column) -> Column:
        return F.struct(of["key"].alias("key"), of["size"].alias("size"), p.alias("p"))

    def step(acc: Column, new: Column) -> Column:
        old = acc["rest"]
        a, b = old["size"] * old["p"], new["size"] * new["p"]  # words that either stands for
        room_a, room_b = old["size"] - a, new["size"] - b
        up, down = F.least(room_a, b), F.least(a, room_b)  # that the old one can gain, or lose
        gains = draw(seed, F.lit(level), old["key"], new["key"]) * (up + down) < down
        moved = F.when(gains, up).otherwise(-down)
        a2, b2 = a + moved, b - moved
        # who is settled: when the old one gains, it is full, or the new one is empty; the other way round alike
        old_full, new_empty = gains & (room_a <= b), gains & (room_a > b)
        old_empty, new_full = ~gains & (a <= room_b), ~gains & (a > room_b)
        p_old = F.when(old_full, F.lit(1.0)).when(old_empty, F.lit(0.0)).otherwise(a2 / old["size"])
        p_new = F.when(new_full, F.lit(1.0)).when(new_empty, F.lit(0.0)).otherwise(b2 / new["size"])
        old_done = old_full | old_empty
        met = F.struct(F.when(old_done, item(new, p_new)).otherwise(item(old, p_old)).alias("rest"), F.concat(acc["done"], F.array(F.when(old_done, item(old, p_old)).otherwise(item(new, p_new)))).alias("done"))
        return F.when(old.isNull(), F.struct(item(new, new["p"]).alias("rest"), acc["done"].alias("done"))).otherwise(met)

    return F.aggregate(items, start, step)


def _folded(rows: DataFrame, seed: int, level: int) -> DataFrame:
    """(grp, bucket, m): each bucket's rows met, the large ones first."""
    items = F.array_sort(F.collect_list(F.struct((-F.col("size")).alias("order"), "key", "size", "p")))
    return rows.groupBy("grp", "bucket").agg(items.alias("items")).select("grp", "bucket", _meet(F.col("items"), seed, level, rows.schema["key"].dataType.simpleString()).alias("m"))


def pivotal(rows: DataFrame, seed: int = 7, fan: int = FAN) -> DataFrame:
    """(grp, key, size, p) with 0 < p < 1 and size > 0 to (grp, key, size, taken) with taken 0 or 1; grp is not null.

    The number of buckets of a group follows its count, so the largest group is dealt over as many tasks as all others.
    """
    counts = materialize(rows.groupBy("grp").agg(F.count("*").alias("n")), "groups")
    most = counts.agg(F.max("n")).first()[0] or 0
    rows = join_small(rows, counts, "grp").withColumn("late", F.pmod(F.xxhash64(F.lit(seed + 1), "key", "size"), F.col("n")) < RESERVE)
    reserve = rows.where("late").select("grp", F.lit(0).cast("long").alias("bucket"), "key", "size", "p")
    rows = rows.where("NOT late").withColumn("bucket", F.pmod(F.xxhash64(F.lit(seed), "key", "size"), F.greatest(F.ceil(F.col("n") / fan), F.lit(1))))
    rows = rows.select("grp", "bucket", "key", "size", "p")
    done, level, deep = [], 0, most > RESERVE
    while deep:
        met = materialize(_folded(rows, seed, level), f"pivotal{level}")
        done.append(met.select("grp", F.inline("m.done")))
        rows = met.where("m.rest IS NOT NULL").select("grp", F.floor(F.col("bucket") / fan).alias("bucket"), "m.rest.*")
        deep, most, level = most > fan, -(-most // fan), level + 1
    top = materialize(_folded((rows if done else rows.limit(0)).select(reserve.columns).withColumn("bucket", F.lit(0).cast("long")).unionByName(reserve), seed, -1), "pivotal")
    done.append(top.select("grp", F.inline("m.done")))
    luck = F.when(draw(seed, F.lit(-2), F.col("key"), F.col("size")) < F.col("p"), F.lit(1.0)).otherwise(F.lit(0.0))
    done.append(top.where("m.rest IS NOT NULL").select("grp", "m.rest.*").select("grp", "key", "size", luck.alias("p")))
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out.select("grp", "key", "size", F.col("p").cast("int").alias("taken"))


def mix_table(df: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", seed: int = 7) -> DataFrame:
    """Per row of df: key, size, source_size, target, copies, taken (copies * size). No text is shuffled."""
    with scratch(df.sparkSession):
        return materialize(_mix_table(df, key, text, source, seed), "mix", keep=True)


def _mix_table(df: DataFrame, key: str, text: str, source: str, seed: int) -> DataFrame:
    words = F.regexp_count(F.coalesce(F.col(text), F.lit("")), F.lit(WORD)).cast("long")
    sizes = materialize(df.select(F.col(key).alias("id"), F.col(source).alias("source"), words.alias("size")), "sizes")
    per = materialize(targets(sizes), "targets").withColumnRenamed("source", "source_")
    share = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    per = per.withColumn("share", share).withColumn("p", share - F.floor(share)).withColumn("p", F.when(F.col("p").between(1e-12, 1 - 1e-12), F.col("p")))
    per = per.withColumn("grp", F.coalesce(F.concat(F.lit("s"), F.col("source_").cast("string")), F.lit("null")))
    rows = join_small(sizes, per, F.col("source").eqNullSafe(F.col("source_")))
    cols = ["id", "source", "size", "source_size", "target", "copies"]
    settled = rows.where("size = 0 OR p IS NULL").withColumn("copies", F.when(F.col("size") > 0, F.round("share").cast("int")).otherwise(F.lit(0)))
    luck = pivotal(rows.where("size > 0 AND p IS NOT NULL").select("grp", F.col("id").alias("key"), "size", "p"), seed)
    drawn = join_small(luck, per.withColumnRenamed("source_", "source"), "grp").select(F.col("key").alias("id"), "source", "size", "source_size", "target", (F.floor("share").cast("int") + F.col("taken")).alias("copies"))
    out = settled.select(*cols).unionByName(drawn)
    return out.select(F.col("id").alias(key), F.col("source").alias(source), "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def _mark(df: DataFrame) -> Column:
    """The SHA-256 of a whole row, names, nulls, maps and parts of seconds included."""
    whole = F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]), {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"})
    return F.unhex(F.sha2(whole, 256))


def mix(df: DataFrame, text: str = "text", source: str = "source", seed: int = 7) -> DataFrame:
    """The rows of df, each as many times as the mix takes it. A row is known by the SHA-256 of all its columns as JSON, so rows that
    differ at all are told apart, whatever their ids, and reruns agree in whatever order rows come. Rows that are alike throughout can
    stand for one another: one of them brings all copies of all of them, so that however many there are, they meet as counts."""
    with scratch(df.sparkSession):
        return _mixed(df, text, source, seed)


def _mixed(df: DataFrame, text: str, source: str, seed: int) -> DataFrame:
    id_, source_, size_, sum_, n_, copy_ = (fresh(df.columns, c) for c in ("mark_of", "source_of", "size_of", "copies_of", "rows_of", "copy_of"))
    marked = df.withColumn(id_, _mark(df))
    copies = mix_table(marked.select(F.col(f"`{id_}`").alias("id"), F.col(f"`{text}`").alias("text"), F.col(f"`{source}`").alias("source")), "id", "text", "source", seed)
    given = copies.groupBy(F.col("id").alias(id_), F.col("source").alias(source_), F.col("size").alias(size_)).agg(F.sum("copies").alias(sum_), F.count("*").alias(n_))
    given = materialize(given.where(F.col(sum_) > 0), "copies", keep=True)
    col = lambda c: F.col(f"`{c}`")
    keep = [col(c) for c in df.columns]
    own = fresh([*df.columns, id_], "own_mark")
    # joined the same way at any size: there is a row of copies for about every row of df
    rows = marked.withColumnRenamed(id_, own).join(given.hint("merge"), (col(own) == col(id_)) & col(source).eqNullSafe(col(source_)))
    out = rows.where(col(n_) == 1)
    if given.where(col(n_) > 1).limit(1).count():
        out = out.unionByName(rows.where(col(n_) > 1).dropDuplicates([id_, source_]))
    return out.select(*keep, F.explode(F.sequence(F.lit(1), col(sum_).cast("int"))).alias(copy_)).select(*keep)
