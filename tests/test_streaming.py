"""Streams of event files."""

from __future__ import annotations

from planeweave.streaming import follow
from tests.conftest import DATA


def test_rates_and_repeats(spark, tmp_path):
    rows = spark.read.parquet(f"{DATA}/events.parquet").selectExpr("event_id", "CAST(ts AS timestamp) AS t", "event_type")
    rows.repartition(2).write.parquet(str(tmp_path / "in"))
    stream = follow.follow(spark, str(tmp_path / "in"), rows.schema)
    q = follow.event_rates(follow.first_of_each(stream, "t", ["event_id"]), "t", ["event_type"], "1 hour", late=None).writeStream.outputMode("append").format("memory").queryName("rates").option("checkpointLocation", str(tmp_path / "c")).start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    batch = follow.event_rates(rows, "t", ["event_type"], "1 hour")
    known = {(r.start, r.event_type): r.n for r in batch.collect()}
    got = {(r.start, r.event_type): r.n for r in spark.table("rates").collect()}
    assert got and all(known[k] == n for k, n in got.items())
