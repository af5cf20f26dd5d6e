"""Sessions of a stream against plain Python: late rows, runs that go on, ties, rows without key or time."""

from datetime import datetime, timedelta, timezone

from pyspark.sql import functions as F

from plumbline.streaming import sessions

START = datetime(2024, 1, 1, tzinfo=timezone.utc)
SCHEMA = "user long, ts timestamp, value double"


def at(minutes):
    return None if minutes is None else START + timedelta(minutes=minutes)


def plain(rows, gap, watermark):
    """(user, opened, closes, n, total) of the sessions that the watermark has reached."""
    out = []
    for user in {u for u, t, _ in rows if t is not None}:
        times = sorted((t, v) for u, t, v in rows if u == user and t is not None)
        groups = [[times[0]]]
        for t, v in times[1:]:
            groups.append([(t, v)]) if t - groups[-1][-1][0] > gap else groups[-1].append((t, v))
        out += [(user, g[0][0], g[-1][0] + gap, len(g), sum(v for _, v in g)) for g in groups if g[-1][0] + gap <= watermark]
    return sorted(out, key=repr)


class Stream:
    def __init__(self, spark, folder):
        self.spark, self.folder, self.n = spark, folder, 0

    def add(self, rows):
        self.n += 1
        self.spark.createDataFrame([(u, at(t), v) for u, t, v in rows], SCHEMA).coalesce(1).write.mode("append").parquet(f"{self.folder}/in")

    def run(self):
        """Number of late entries."""
        rows = sessions.source(self.spark, f"{self.folder}/in", files_per_batch=1)
        closed = sessions.sessions(rows, ["user"], "ts", "10 minutes", "30 minutes", [F.sum("value").alias("total")])
        return sessions.write_closed(closed, f"{self.folder}/out", f"{self.folder}/checkpoint")

    def result(self):
        minutes = lambda c: ((F.unix_micros(c) - int(START.timestamp()) * 1_000_000) / 60_000_000).cast("long")
        got = self.spark.read.parquet(f"{self.folder}/out").select("user", minutes("opened"), minutes("closes"), "n", "total")
        return sorted((tuple(r) for r in got.collect()), key=repr)


def test_sessions(spark, tmp_path):
    stream = Stream(spark, tmp_path)
    # ties, a repeated row, a pause of exactly the gap, one above it, no key, no time
    first = [(1, 0, 1.0), (1, 0, 1.0), (1, 10, 2.0), (1, 21, 4.0), (2, 5, 1.0), (None, 7, 3.0), (None, 9, 3.0), (2, None, 9.0), (2, 60, 1.0)]
    stream.add(first)
    before = {k: spark.conf.get(k, None) for k in sessions.SETTINGS}
    assert stream.run() == 0
    assert {k: spark.conf.get(k, None) for k in sessions.SETTINGS} == before
    assert stream.result() == plain(first, 10, 30)
    # goes on: 22 extends the open session of user 1, is behind the watermark, but not late as its end is not; 8 of user 3 is late
    second = [(1, 22, 8.0), (3, 45, 1.0), (2, 100, 1.0)]
    stream.add([*second, (3, 8, 5.0)])
    assert stream.run() == 1
    assert stream.result() == plain(first + second, 10, 70)
    assert stream.run() == 0  # nothing new, nothing written twice
    assert stream.result() == plain(first + second, 10, 70)


def test_empty(spark, tmp_path):
    stream = Stream(spark, tmp_path)
    stream.add([])
    assert stream.run() == 0
    assert spark.read.schema("user long").parquet(f"{tmp_path}/out").count() == 0


def test_table(spark):
    """The same function on a table closes all sessions."""
    rows = [(1, 0, 1.0), (1, 5, 1.0), (1, 50, 1.0)]
    df = spark.createDataFrame([(u, at(t), v) for u, t, v in rows], SCHEMA)
    assert sorted(r.n for r in sessions.sessions(df, ["user"], "ts", "10 minutes", "0 seconds", []).collect()) == [1, 2]
