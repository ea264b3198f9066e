"""State between micro-batches: it ends when it says nothing any more, and stored assignments take part."""

import datetime as dt

from pyspark.sql import functions as F

from passages.streaming import windows

T0 = dt.datetime(2024, 1, 1)
HITS = "key int, ts timestamp, event_id int"


def _run(spark, tmp_path, parts, schema, f):
    """Feeds parts one by one; the rows that came out and the rows of state after each."""
    folder, states = str(tmp_path / "in"), []
    for part in parts:
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(folder)
        stream = f(spark.readStream.schema(schema).parquet(folder))
        query = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        query.awaitTermination()
        states.append(query.recentProgress[-1]["stateOperators"][0]["numRowsTotal"])
    return spark.read.parquet(str(tmp_path / "out")).collect(), states


def test_rate_limit_state_ends(spark, tmp_path):
    at = lambda s: T0 + dt.timedelta(seconds=s)
    parts = [[(k, at(k), k) for k in range(40)] + [(0, at(5), 100)], [(0, at(30), 101), (1, at(70), 102)], [(99, at(86_400), 103)], [(0, at(86_500), 104)]]
    rows, states = _run(spark, tmp_path, parts, HITS, lambda s: windows.rate_limit_stream(s, 1, 60))
    assert states[0] == 40 and states[2] == 1 and states[3] == 2
    everything = [x for p in parts for x in p]
    batch = windows.rate_limit_flags(spark.createDataFrame(everything, HITS), 1, 60).collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, batch)) and sum(r.rejected for r in rows) == 2


def test_stored_assignments(spark, tmp_path):
    """A stored assignment counts, one whose variant is gone is dealt anew, and so is a kept one; forgotten subjects start again."""
    schema = "subject string, ts timestamp, event_id int, variant_id int"
    day = lambda n: T0 + dt.timedelta(days=n)
    variants = spark.createDataFrame([(1, 7), (2, 7), (9, 8)], "id int, experiment_id int")
    assignments = spark.createDataFrame([(7, "stored", 2), (7, "gone", 3), (8, "other", 2)], "experiment_id int, subject string, variant_id int")
    parts = [[("stored", day(0), 1, 1), ("gone", day(0), 2, 1), ("other", day(0), 3, 1), ("new", day(0), 4, 2)], [("stored", day(1), 5, 1), ("gone", day(1), 6, 2), ("new", day(1), 7, 1)], [("late", day(90), 8, 1)], [("new", day(91), 9, 1), ("stored", day(91), 10, 1)]]
    rows, states = _run(spark, tmp_path, parts, schema, lambda s: windows.sticky_assign_stream(s, variants, 7, assignments, idle_days=30))
    assert {r.event_id: r.variant_id for r in rows} == {1: 2, 2: 1, 3: 1, 4: 2, 5: 2, 6: 1, 7: 2, 8: 1, 9: 1, 10: 2}
    assert states[1] == 4 and states[2] == 1
    fewer = variants.where(F.col("id") != 2)
    more, _ = _run(spark, tmp_path / "again", [[("stored", day(0), 1, 1)]], schema, lambda s: windows.sticky_assign_stream(s, fewer, 7, assignments))
    assert more[0].variant_id == 1
