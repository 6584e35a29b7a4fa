"""Document fingerprints from closed syncmers, in DataFrame functions only.

A text is a sequence of tokens: runs of up to TOKEN characters without white space, so that a text without any space has tokens
too. A k-mer is K tokens in a row, its inner substrings are S tokens in a row. A k-mer is an anchor when the smallest hash of its
inner substrings is that of the first or of the last: a choice that looks at nothing but the k-mer itself. The same passage
therefore yields the same anchors wherever it stands, and edits elsewhere leave them as they are.

An anchor is an int: 28 bits of the k-mer's hash, then 4 bits for its place, the number of tokens from here to the next anchor
(15: as many or more; 0: the last). fingerprint: the anchors in order, 8 hex digits each, so hashes and relative positions can be
read from it; about one anchor falls on (K - S + 1) / 2 tokens. In a text without any such k-mer (1 to K - 1 tokens, or a few more)
each token is an anchor; only a null, empty or blank text has none and the fingerprint ''. Likeness compares placed anchors: the
Jaccard similarity of the sets of hash and place, so the same words in another order or further apart aren't alike; two texts
without anchors, so both blank, are alike (1.0). Equal texts have equal fingerprints.

next_document pairs every row with the next one in ascending id without a global sort or window. Ties: rows that share an id
follow each other in the order of their texts; a row without id has no next document (an empty text stands in) and is none. Ids are
cut into stretches at their quantiles, so uneven ids make even stretches; rows of one id stay in one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh, join_small, without

TOKEN, K, S = 6, 12, 3
#: rows that meet in one window partition, on average; also the most keys that are put in order in a single task
BUCKET_ROWS, ONE_TASK = 1024, 20_000
#: rows that a task gets, about, and tasks at most
TASK_ROWS, MOST_TASKS = 4096, 50_000
#: cuts that are made at once, so also the most cuts that a stretch of the first cut is divided by
CUTS = 1000


def anchors(df: DataFrame, text: str, out: str, positions: str | None = None) -> DataFrame:
    """df with `out`, the anchors' hashes in order of position (array<int>), and their token positions if asked for."""
    names = [fresh(df.columns, f"{out}_{x}") for x in ("tokens", "hashes", "inner", "at")]
    tokens, hashes, inner, at = (F.col(f"`{n}`") for n in names)
    df = without(df, out, *([positions] if positions else []))
    keep = [F.col(f"`{c}`") for c in df.columns]
    df = df.select(*keep, F.regexp_extract_all(F.coalesce(F.col(f"`{text}`"), F.lit("")), F.lit(rf"[^\x20\x09-\x0D]{{1,{TOKEN}}}"), F.lit(0)).alias(names[0]))
    df = df.select(*keep, F.transform(tokens, lambda t: F.xxhash64(t)).alias(names[1]))
    df = df.select(*keep, hashes, F.transform(hashes, lambda h, i: F.xxhash64(h, *[F.get(hashes, i + j) for j in range(1, S)])).alias(names[2]))
    last = K - S
    closed = lambda i: F.least(F.get(inner, i), F.get(inner, i + last)) <= F.least(*[F.get(inner, i + j) for j in range(1, last)])
    starts = F.when(F.size(hashes) >= K, F.filter(F.sequence(F.lit(0), F.greatest(F.size(hashes) - K, F.lit(0))), closed))
    df = df.select(*keep, hashes, inner, starts.alias(names[3]))
    parts = [*range(0, K - S + 1, S)]
    whole = lambda i: F.xxhash64(*[F.get(inner, i + j) for j in parts], *[F.get(hashes, i + j) for j in range(parts[-1] + S, K)])
    short = lambda h: F.shiftleft(F.shiftright(h, 36).cast("int"), 4)
    some = F.size(at) > 0
    # one list of (hash, position), then each position is taken from the next one
    found = F.when(some, F.transform(at, lambda i: F.struct(short(whole(i)).alias("h"), i.alias("at")))).otherwise(F.transform(hashes, lambda x, i: F.struct(short(x).alias("h"), i.alias("at"))))
    names.append(fresh(df.columns, f"{out}_found"))
    df = df.select(*keep, found.alias(names[4]))
    found = F.col(f"`{names[4]}`")
    gap = lambda x, i: F.when(i + 1 < F.size(found), F.least(F.get(found, i + 1)["at"] - x["at"], F.lit(15))).otherwise(F.lit(0))
    more = [F.transform(found, lambda x: x["at"]).alias(positions)] if positions else []
    return df.select(*keep, F.transform(found, lambda x, i: x["h"].bitwiseOR(gap(x, i))).alias(out), *more)


def fingerprint(anchors: Column) -> Column:
    return F.lower(F.array_join(F.transform(anchors, lambda a: F.lpad(F.hex(a.cast("long").bitwiseAND(F.lit(0xFFFFFFFF))), 8, "0")), ""))


def likeness(a: Column, b: Column) -> Column:
    common = F.size(F.array_intersect(a, b))
    union = F.size(F.array_distinct(a)) + F.size(F.array_distinct(b)) - common
    return F.when(union == 0, F.lit(1.0)).otherwise(common / union)


def positional_matches(pairs: DataFrame, a: str, a_at: str, b: str, b_at: str) -> DataFrame:
    """One row per k-mer that two texts of a pair share: where it stands in either, and the shift. Repeated anchors match each."""
    left = pairs.select("*", F.posexplode(F.arrays_zip(F.col(a).alias("hash"), F.col(a_at).alias("at"))).alias("n_", "left_"))
    hit = F.filter(F.arrays_zip(F.col(b).alias("hash"), F.col(b_at).alias("at")), lambda x: F.shiftright(x["hash"], 4) == F.shiftright(F.col("left_.hash"), 4))
    return left.select("*", F.explode(hit).alias("right_")).select(*pairs.columns, F.col("left_.hash").alias("hash"), F.col("left_.at").alias("left_at"), F.col("right_.at").alias("right_at"), (F.col("right_.at") - F.col("left_.at")).alias("shift"))


def _bucketed(keys: DataFrame, key: str, n: int, low: int, high: int) -> Column:
    """Numbers of stretches of about BUCKET_ROWS keys each, of n keys that lie evenly between low and high."""
    width = max(1, (high - low + 1) * BUCKET_ROWS // max(n, 1))
    return F.floor((F.col(key) - F.lit(low)) / F.lit(width)).cast("long")


def _below(cuts: Column, key: str) -> Column:
    return F.size(F.filter(cuts, lambda c: c < F.col(key))).cast("long")


def with_stretch(df: DataFrame, key: str, n: int, out: str) -> DataFrame:
    """df with the number of each row's stretch of the key: about BUCKET_ROWS rows each, in the order of the key. Where one round of
    CUTS quantiles leaves more than that, each stretch is cut once more by its own; what is broadcast has CUTS lists of CUTS keys at most."""
    wanted = -(-n // BUCKET_ROWS)
    share = lambda k: F.array(*[F.lit(i / k) for i in range(1, k)])
    m = min(wanted, CUTS)
    if m < 2:
        return df.withColumn(out, F.lit(0).cast("long"))
    cuts = df.agg(F.percentile_approx(key, share(m), F.lit(10 * m)).alias("c")).first()["c"]
    cuts = F.array(*[F.lit(c) for c in sorted(set(cuts))])
    first = df.withColumn(out, _below(cuts, key))
    if wanted <= m:
        return first
    k = min(CUTS, -(-wanted // m))
    inner = first.groupBy(F.col(out).alias("stretch_")).agg(F.array_distinct(F.percentile_approx(key, share(k), F.lit(10 * k))).alias("cuts_"))
    both = first.join(F.broadcast(inner), F.col(out) == F.col("stretch_"))
    return both.select(*df.columns, (F.col(out) * CUTS + _below(F.col("cuts_"), key)).alias(out))


def _first_of_next(firsts: DataFrame) -> DataFrame:
    """(bucket, first, upcoming) from (bucket, first) with distinct buckets: the first key of the next bucket, after the last null."""
    n, low, high = firsts.agg(F.count("*"), F.min("bucket"), F.max("bucket")).first()
    if n <= ONE_TASK:
        return firsts.withColumn("upcoming", F.lead("first").over(Window.orderBy("bucket")))
    upper = firsts.withColumn("outer", _bucketed(firsts, "bucket", n, low, high))
    beyond = _first_of_next(upper.groupBy("outer").agg(F.min_by("first", "bucket").alias("first")).withColumnRenamed("outer", "bucket")).select(F.col("bucket").alias("outer"), F.col("upcoming").alias("beyond"))
    inside = upper.withColumn("upcoming", F.lead("first").over(Window.partitionBy("outer").orderBy("bucket")))
    return inside.join(beyond, "outer", "left").select("bucket", "first", F.coalesce("upcoming", "beyond").alias("upcoming"))


def next_document(df: DataFrame, key: str, text: str, derive: Callable[[DataFrame], DataFrame], derived: list[str], prefix: str = "next_") -> DataFrame:
    """df with what derive() adds to it (the columns `derived`), and prefix + c for c in [text, *derived], of the row with the next
    id; after the last id comes the first.

    One shuffle, of the texts alone: rows meet in stretches of the id range, where a copy of the next stretch's first row closes each
    stretch, and what is derived from a text is computed there.
    """
    df = df.select(key, text)
    own = df.where(F.col(key).isNotNull())
    n, low = own.agg(F.count("*"), F.min(key)).first()
    cols = [text, *derived]
    lost = derive(df.where(F.col(key).isNull()))
    lost = lost.select("*", *[F.lit(None).cast(lost.schema[c].dataType).alias(prefix + c) for c in cols])
    if not n:
        return lost
    own = with_stretch(own, key, n, "bucket_")
    edges = _first_of_next(own.groupBy(F.col("bucket_").alias("bucket")).agg(F.min(key).alias("first")))
    edges = edges.select(F.col("bucket").alias("closes"), F.coalesce("upcoming", F.lit(low)).alias("upcoming"))
    firsts = join_small(own.drop("bucket_"), edges, F.col(key) == F.col("upcoming")).groupBy("closes").agg(F.min(F.coalesce(F.col(text), F.lit(""))).alias(text), F.first("upcoming").alias("upcoming"))
    closing = firsts.select(F.col("upcoming").alias(key), text, F.col("closes").alias("bucket_"), F.lit(True).alias("copy_"))
    rows = own.withColumn("copy_", F.lit(False)).unionByName(closing)
    # as many partitions as there are rows for, so that a task's share doesn't grow with the table
    rows = rows.repartition(max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(MOST_TASKS, -(-n // TASK_ROWS))), "bucket_")
    order = Window.partitionBy("bucket_").orderBy("copy_", key, F.coalesce(F.col(text), F.lit("")))
    rows = derive(rows).select("*", F.lead(F.struct(*cols)).over(order).alias("next_")).where(~F.col("copy_"))
    return rows.select(key, *cols, *[F.col(f"next_.{c}").alias(prefix + c) for c in cols]).unionByName(lost.select(key, *cols, *[prefix + c for c in cols]))


def fingerprint_edited(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprints of each text and of the same text with its last quarter replaced by the head of the next document."""
    own = df.select(key, F.coalesce(F.col(text), F.lit("")).alias("text_"))
    both = next_document(own, key, "text_", lambda d: anchors(d, "text_", "anchors_"), ["anchors_"], "following_")
    n = F.length("text_")
    quarter = F.floor(n / 4).cast("int")
    both = both.withColumn("edited_", F.concat(F.substring("text_", F.lit(1), n - quarter), F.substring(F.coalesce("following_text_", F.lit("")), F.lit(1), quarter)))
    both = both.select(key, n.cast("long").alias("n_chars"), F.sha2(F.col("edited_"), 256).alias("edited_sha256"), "edited_", "anchors_", F.coalesce("following_anchors_", F.array().cast("array<int>")).alias("following_anchors_"))
    both = anchors(both, "edited_", "edited_anchors_")
    return both.select(key, "n_chars", "edited_sha256", fingerprint(F.col("anchors_")).alias("fingerprint"), fingerprint(F.col("edited_anchors_")).alias("edited_fingerprint"), likeness(F.col("anchors_"), F.col("edited_anchors_")).alias("near_edited"), likeness(F.col("anchors_"), F.col("following_anchors_")).alias("near_next"))
