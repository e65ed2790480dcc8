"""Absences against a loop, and the stream with late arrivals and a restart against the table."""

import datetime
import random

from mnemoframe.streaming import absence

START = datetime.datetime(2024, 1, 1)
H = 3_600_000


def rows(seed=2):
    rng = random.Random(seed)
    out = []
    for user in range(6):
        at = START
        for _ in range(rng.randint(1, 40)):
            at += datetime.timedelta(minutes=rng.choice([5, 30, 50, 200, 400, 2000, 9000]))
            out.append((user, at))
    return sorted(out, key=lambda r: r[1])


def ms(t):
    return int((t - datetime.datetime(1970, 1, 1)).total_seconds() * 1000)


def loop(data, until):
    """Every minute is not looked at: an absence is known by its two ends."""
    out = set()
    for user in {u for u, _ in data}:
        times = sorted({ms(t) for u, t in data if u == user and ms(t) <= until})
        mean, n = 0.0, 0
        for a, b in zip(times, [*times[1:], None]):
            allowed = max(H, (mean or 4 * H) * 1.5)
            if (until if b is None else b) - a <= allowed:
                continue
            out.add((user, "absent", a, a + int(allowed) + 1, None, None, mean))
            if b is not None:
                gap = b - a
                level = "very long" if gap > max(72 * H, (mean or 4 * H) * 24) else "long" if gap > max(24 * H, (mean or 4 * H) * 8) else "short"
                mean, n = float(gap) if n == 0 else mean * 0.8 + gap * (1 - 0.8), n + 1
                out.add((user, "returned", a, b, gap, level, mean))
    return out


def test_table(spark):
    data = rows()
    df = spark.createDataFrame([*data, data[0], (None, START), (7, None)], "user_id long, ts timestamp")
    for until in (ms(START) + 30 * 24 * H, ms(START) + 400 * 24 * H):
        got = [tuple(r) for r in absence.absences(df, until).collect()]
        assert set(got) == loop(data, until) and len(got) == len(set(got)) and {r[1] for r in got} == {"absent", "returned"}
    assert absence.absences(df.limit(0), 0).count() == 0


def test_stream_equals_table_over_a_restart(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    data = rows(5)
    rng = random.Random(1)
    end = max(t for _, t in data) + datetime.timedelta(days=90)
    half = len(data) // 2
    first, second = data[:half], data[half:]
    swapped = second[:1] + rng.sample(second[1:], len(second) - 1)  # within one micro-batch any order is in time
    for part in (first, swapped, [(99, end)], [(99, end + datetime.timedelta(minutes=1))]):
        spark.createDataFrame(part, "user_id long, ts timestamp").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = absence.absence_stream(spark.readStream.schema("user_id long, ts timestamp").parquet(str(tmp_path / "in")))
        query = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "check")).outputMode("append").trigger(availableNow=True).start()
        query.awaitTermination()
    got = [tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).collect()]
    want = loop(data, ms(end) - H)
    assert sorted(got, key=repr) == sorted(want, key=repr)
