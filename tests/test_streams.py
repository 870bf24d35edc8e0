"""Streams by key give the rows of their batch forms: late events, several batches, a restart from the checkpoint."""

from __future__ import annotations

import datetime as dt
import random

from vellum.queries.windows import message_context
from vellum.streaming.flow import histories, paced
from vellum.streaming.limits import waits

START = dt.datetime(2024, 1, 1)


def streamed(spark, tmp_path, parts: list[list[tuple]], schema: str, query, restarts: int) -> list:
    """Rows of ``query`` over a stream that gets the parts one after another, stopped and started again in between."""
    for k in range(restarts):
        for n, part in enumerate(parts[k * len(parts) // restarts : (k + 1) * len(parts) // restarts]):
            spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
            stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
            job = query(stream).writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/check").option("path", f"{tmp_path}/out").outputMode("append").trigger(availableNow=True).start()
            job.awaitTermination(180)
            assert job.exception() is None and not job.isActive
    return spark.read.parquet(f"{tmp_path}/out").collect()


def dealt(rows: list[tuple], batches: int, at: int, seed: int) -> list[list[tuple]]:
    """Rows by time in batches, each a little out of order and reaching back into the one before, then a row that moves the watermark past all."""
    r = random.Random(seed)
    rows = sorted(rows, key=lambda e: e[at].timestamp() + r.uniform(0, 20))
    size = -(-len(rows) // batches)
    return [rows[k : k + size] for k in range(0, len(rows), size)]


def test_pacing_on_a_stream(spark, tmp_path):
    r = random.Random(4)
    rows = [(k, r.randrange(5), START + dt.timedelta(milliseconds=250 * r.randrange(1200)), "x") for k in range(400)]
    schema = "event_id long, user_id long, ts timestamp, kind string"
    last = [(9000 + u, u, START + dt.timedelta(hours=2), "end") for u in range(5)] + [(9999, 99, START + dt.timedelta(hours=3), "end")]
    got = streamed(spark, tmp_path, [*dealt(rows, 3, 2, 1), last, [(9998, 99, START + dt.timedelta(hours=4), "end")]], schema, lambda s: paced(s, pace=1.0), 2)
    want = waits(spark.createDataFrame(rows, schema), pace=1.0).select("user_id", "event_id", "wait").collect()
    assert sorted(tuple(x) for x in got if x.event_id < 9000) == sorted(map(tuple, want))
    assert {x.wait for x in want} == {True, False}


def test_history_on_a_stream(spark, tmp_path):
    rows = [(c, t, "user" if (c + t) % 2 else "assistant", START + dt.timedelta(seconds=7 * t + c)) for c in range(4) for t in range(30)]
    schema = "conv_id long, turn long, role string, ts timestamp"
    end = [(77, 0, "user", START + dt.timedelta(hours=1))], [(77, 1, "user", START + dt.timedelta(hours=2))]
    got = streamed(spark, tmp_path, [*dealt(rows, 2, 3, 2), *end], schema, histories, 2)
    want = message_context(spark.createDataFrame(rows, schema)).collect()
    assert sorted(tuple(x) for x in got if x.conv_id != 77) == sorted(map(tuple, want))
