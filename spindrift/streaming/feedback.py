"""Feedback events: batch folds by windows, the same folds as a stateful stream, and event-time windows.

Events are rows (axis, seq, kind, item, target); seq orders the events of an axis.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle


def feedback_state(events: DataFrame) -> DataFrame:
    """(axis, item, kind, target, first_seq) after all events: the last event of an item decides (score or undefined; delete
    removes it), its order is that of the first score since it was last removed."""
    w = Window.partitionBy("axis", "item").orderBy("seq")
    cleared = F.max(F.when(F.col("kind") != "score", F.col("seq"))).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    d = events.withColumn("cleared", F.coalesce(cleared, F.lit(-1)))
    g = d.groupBy("axis", "item").agg(F.max_by("kind", "seq").alias("kind"), F.max_by("target", "seq").alias("target"), F.min(F.when((F.col("kind") == "score") & (F.col("seq") > F.col("cleared")), F.col("seq"))).alias("first_seq"), F.max("seq").alias("last_seq"))
    return g.where("kind <> 'delete'").select("axis", "item", "kind", F.when(F.col("kind") == "score", F.col("target")).alias("target"), F.coalesce("first_seq", "last_seq").alias("first_seq"))


def counters(events: DataFrame) -> DataFrame:
    """prior_revision counts the prompt updates up to an event, b_interaction the other events since the last one; the create
    event and each update are interaction 0."""
    w = Window.partitionBy("axis").orderBy("seq")
    rev = F.sum((F.col("kind") == "prompt_update").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    d = events.withColumn("prior_revision", rev)
    n = F.row_number().over(Window.partitionBy("axis", "prior_revision").orderBy("seq"))
    return d.withColumn("b_interaction", n - 1)


def attach_baseline(events: DataFrame, snapshots: DataFrame) -> DataFrame:
    """A create row before the first event of every axis that has no snapshot."""
    first = events.groupBy("axis").agg(F.min("seq").alias("seq")).join(snapshots.select("axis").distinct(), "axis", "left_anti")
    made = first.select("axis", (F.col("seq") - 1).alias("seq"), F.lit("create").alias("kind"))
    return events.select("axis", "seq", "kind").unionByName(made)


def fold_pairs(events: DataFrame, cap: int) -> DataFrame:
    """Order-dependent pairs: each score beats the items of its axis that last scored below it, and the oldest pairs go beyond the
    cap. An axis is folded by one task, as its events depend on each other: it holds an axis's last scores and `cap` pairs."""
    from ..workers import shipped

    def fold(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("seq")
        last: dict[str, float] = {}
        pairs: list[tuple[str, str]] = []
        for kind, item, target in zip(g["kind"], g["item"], g["target"], strict=True):
            if kind == "score":
                near = sorted(((abs(v - target), k) for k, v in last.items() if k != item and v < target))[:2]
                pairs += [(item, k) for _, k in near]
                pairs = pairs[-cap:]
                last[item] = target
            else:
                last.pop(item, None)
                pairs = [p for p in pairs if item not in p]
        return pd.DataFrame({"axis": g["axis"].iloc[0], "place": range(len(pairs)), "winner": pd.Series([p[0] for p in pairs], dtype=object), "loser": pd.Series([p[1] for p in pairs], dtype=object)})

    return shipped(events).select("axis", "seq", "kind", "item", "target").groupBy("axis").applyInPandas(fold, f"axis {events.schema['axis'].dataType.simpleString()}, place long, winner string, loser string")


def signature(*parts: Column) -> Column:
    """A fit is due when this changes."""
    return F.sha2(F.to_json(F.struct(*parts)), 256)


def target_trace(events: DataFrame) -> DataFrame:
    """Per score the raw and clamped target, its bin, the value before it, and warnings."""
    w = Window.partitionBy("axis", "item").orderBy("seq")
    used = F.least(F.greatest(F.col("target"), F.lit(0.0)), F.lit(100.0)) / 100
    d = events.where("kind = 'score'").withColumn("used", used).withColumn("before", F.lag("used").over(w))
    warn = F.filter(F.array(F.when(F.col("used") != F.col("target") / 100, "clamped"), F.when(F.col("used") == F.col("before"), "unchanged"), F.when(F.col("used") == 0.5, "neutral")), lambda x: x.isNotNull())
    return d.select("axis", "seq", "item", F.col("target").alias("raw"), "used", F.least(F.floor(F.col("used") * 10), F.lit(9)).cast("int").alias("bin"), "before", F.array_join(warn, ",").alias("warnings"))


class FeedbackProcessor(StatefulProcessor):
    """E1 as a stream: keyed by axis; the state maps items to (kind, target, first_seq). Every event gives the axis's present row of
    its item. Events of a batch are taken in order of seq; late ones (seq not above the last) are ignored."""

    OUT = "axis string, seq long, item string, kind string, target double, moves long, undefined long"

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.items = handle.getMapState("items", T.StructType([T.StructField("item", T.StringType())]), T.StructType([T.StructField("kind", T.StringType()), T.StructField("target", T.DoubleType())]))
        self.last = handle.getValueState("last", T.StructType([T.StructField("seq", T.LongType()), T.StructField("moves", T.LongType()), T.StructField("undefined", T.LongType())]))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        # the runtime hands over the key's rows in pieces; their order counts, so they are put together
        own = pd.concat(list(rows)).sort_values("seq")
        got = self.last.get() if self.last.exists() else None
        seq, moves, undefined = got if got is not None else (-1, 0, 0)
        own = own[own["seq"] > seq].drop_duplicates("seq")
        # each call to the store is a round trip: an item is read once a batch, when it first comes, and written once, at the end
        before: dict[str, tuple | None] = {}
        now: dict[str, tuple | None] = {}
        out = []
        for at, kind, item, target in zip(own["seq"].tolist(), own["kind"].tolist(), own["item"].tolist(), own["target"].tolist(), strict=True):
            if item not in now:
                before[item] = now[item] = self.items.getValue((item,)) if got is not None else None  # a new axis has none
            was = now[item][0] if now[item] is not None else None
            moves -= was == "score"
            undefined -= was == "undefined"
            value = min(100.0, max(0.0, float(target))) if kind == "score" else None
            if kind == "score":
                moves += 1
            elif kind == "undefined":
                undefined += 1
            now[item] = (kind, value) if kind in ("score", "undefined") else None
            out.append((at, item, kind if now[item] is not None else "deleted", value, moves, undefined))
        for item, value in now.items():
            if value is not None:
                self.items.updateValue((item,), value)
            elif before[item] is not None:
                self.items.removeKey((item,))
        seq = int(own["seq"].iloc[-1]) if len(own) else seq
        self.last.update((int(seq), int(moves), int(undefined)))
        told = pd.DataFrame(out, columns=["seq", "item", "kind", "target", "moves", "undefined"])
        told.insert(0, "axis", str(key[0]))
        yield told

    def close(self) -> None:
        pass


def feedback_stream(events: DataFrame) -> DataFrame:
    """E1 over a stream of events with a string axis. Needs the RocksDB state store provider."""
    return events.groupBy("axis").transformWithStateInPandas(statefulProcessor=FeedbackProcessor(), outputStructType=FeedbackProcessor.OUT, outputMode="Append", timeMode="None")


def windowed(events: DataFrame, ts: str, by: str, value: str, size: str, slide: str | None = None, late: str | None = None) -> DataFrame:
    """Extension: tumbling or sliding event-time windows, in batch or (with a watermark) as a stream."""
    e = events.withWatermark(ts, late) if late else events
    g = e.groupBy(F.window(ts, size, slide) if slide else F.window(ts, size), by).agg(F.count("*").alias("n"), F.sum(value).alias("total"))
    return g.select(F.col("window.start").alias("start"), by, "n", "total")


def sessions(events: DataFrame, ts: str, by: str, gap: str) -> DataFrame:
    """Extension: session windows."""
    return events.groupBy(F.session_window(ts, gap), by).agg(F.count("*").alias("n")).select(F.col("session_window.start").alias("start"), by, "n")
