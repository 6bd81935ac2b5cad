"""Plan shapes that matter at scale, and the streaming path."""

from __future__ import annotations

import os

import pytest

from swathe.plans import views
from swathe.streaming import sessions

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the driver's tables")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_scans_read_only_what_they_need(spark):
    text = plan(views.counts(spark, DATA))
    assert "props" not in text and "user_id" not in text


def test_filters_reach_the_scan(spark):
    text = plan(views.points(spark, DATA).where("event_id > 100 and mission = 'click'"))
    assert "GreaterThan(event_id,100)" in text and "EqualTo(event_type,click)" in text


def test_no_cartesian_product(spark):
    from swathe.plans import registry

    for name in ("morans_i_rook", "kde_epanechnikov", "bootstrap_cr_table", "assign_to_planned_lines"):
        assert "CartesianProduct" not in plan(registry.queries()[name](spark, DATA))


def test_sessions_stream(spark, tmp_path):
    events = views.table(spark, DATA, "events")
    batch = {tuple(r) for r in sessions.gap_sessions(events, "event_type", "ts", "30 minutes").collect()}
    src = tmp_path / "src"
    events.coalesce(1).write.parquet(str(src))
    stream = sessions.gap_sessions(spark.readStream.schema(events.schema).parquet(str(src)), "event_type", "ts", "30 minutes", watermark="1 hour")
    q = stream.writeStream.outputMode("append").format("memory").queryName("sessions_out").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {tuple(r) for r in spark.table("sessions_out").collect()}
    assert got and got <= batch  # the last sessions stay open behind the watermark
    assert sessions.windowed_counts(events, "event_type", "ts", "1 day").count() > 0
