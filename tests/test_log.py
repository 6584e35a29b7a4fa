"""Logs: writers at once, rules that hold at the commit, and streams that are started anew."""

import threading

import pytest
from pyspark.sql import functions as F

from spindrift.session import folder
from spindrift.sources import log as L

SCHEMA = "axis long, seq long, kind string"


def rows(spark, *r):
    return spark.createDataFrame(list(r), SCHEMA)


def test_two_writers_at_once(spark):
    """No row is lost and none comes twice; commits are numbered without a gap."""
    log, failed = L.Log(spark, folder(spark, "log"), SCHEMA), []

    def write(who):
        try:
            for i in range(4):
                log.append(rows(spark, (who, i, "create")))
        except Exception as e:  # noqa: BLE001
            failed.append(e)

    threads = [threading.Thread(target=write, args=(w,)) for w in range(3)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert not failed
    assert sorted((r.axis, r.seq) for r in log.rows().collect()) == [(w, i) for w in range(3) for i in range(4)]
    assert [m["number"] for m in log.manifests()] == list(range(12))


def test_a_number_is_given_once(spark):
    path = folder(spark, "log")
    log = L.Log(spark, path, SCHEMA)
    log.append(rows(spark, (1, 1, "create")))
    with pytest.raises(L.Taken):
        L.put_if_absent(spark, f"{path}/commits/{0:012d}.json", "{}")
    assert log.rows().count() == 1


def test_who_loses_checks_again(spark):
    """Two writers create the same axis: the one that comes second finds it there when it tries the next number, and fails."""
    path = folder(spark, "log")
    log, calls = L.Log(spark, path, SCHEMA), []

    def check(there, new):
        calls.append(there.count())
        if len(calls) == 1:  # another writer commits between this one's check and its commit
            log.append(rows(spark, (7, 0, "create")), L.snapshot_rules)
        L.snapshot_rules(there, new)

    with pytest.raises(ValueError, match="axis 7 has been created already"):
        log.append(rows(spark, (7, 1, "create")), check)
    assert calls == [0, 1] and log.rows().count() == 1


def test_rules(spark):
    log = L.Log(spark, folder(spark, "log"), SCHEMA)
    log.append(rows(spark, (1, 1, "create"), (1, 2, "score"), (2, 1, "create")), L.snapshot_rules)
    log.append(rows(spark, (1, 3, "prompt_update")), L.snapshot_rules)
    for bad, said in (((1, 4, "create"), "axis 1 has been created"), ((3, 1, "prompt_update"), "axis 3 has no baseline before prompt_update")):
        with pytest.raises(ValueError, match=said):
            log.append(rows(spark, bad, (2, 9, "score")), L.snapshot_rules)
    with pytest.raises(ValueError, match="axis 4"):
        log.append(rows(spark, (4, 1, "create"), (4, 2, "create")), L.snapshot_rules)
    assert log.rows().count() == 4 and len(log.manifests()) == 2  # what failed has left nothing
    assert L.Log(spark, folder(spark, "log"), SCHEMA).rows().count() == 0


def test_stream_appends_each_batch_once(spark, tmp_path):
    """The sink is killed after its commit and before Spark's: the batch comes again and isn't written again."""
    log = L.Log(spark, folder(spark, "log"), SCHEMA)
    source, checkpoint = str(tmp_path / "in"), str(tmp_path / "checkpoint")
    rows(spark, *((1, i, "score") for i in range(20))).write.parquet(source)
    stream = spark.readStream.schema(SCHEMA).parquet(source)

    def dies(batch_rows, batch):
        log.append(batch_rows, stream="s", batch=batch)
        raise RuntimeError("killed")

    with pytest.raises(Exception, match="killed"):
        stream.writeStream.foreachBatch(dies).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    assert log.rows().count() == 20
    for _ in range(2):
        L.write_stream(stream, log, "s", checkpoint).awaitTermination()
    rows(spark, *((2, i, "score") for i in range(5))).write.mode("append").parquet(source)
    L.write_stream(stream, log, "s", checkpoint).awaitTermination()
    assert log.rows().groupBy("axis").count().orderBy("axis").collect() == [(1, 20), (2, 5)] and len(log.manifests()) == 2
    assert log.rows().agg(F.count_distinct("axis", "seq")).first()[0] == 25


def test_tables_are_replaced_in_one_step(spark):
    """A reader of the version before keeps it while the next one comes; the ones before that go."""
    from spindrift.sources import tables

    path = folder(spark, "library")
    with pytest.raises(FileNotFoundError):
        tables.current_table(spark, path)
    seen = []
    for n in (1, 2, 3, 4):
        tables.replace_table(spark.range(n), path)
        seen.append(tables.current_table(spark, path))
        assert seen[-1].count() == n and (n == 1 or seen[-2].count() == n - 1)
    with pytest.raises(Exception):
        seen[0].count()
