"""Limiter in batch and streaming form against a plain simulation."""

import random

from pyspark.sql import functions as F

from screenwell.operators import ratelimit
from screenwell.operators.ratelimit import HOUR, MINUTE
from screenwell.streaming import jobs


def simulate(rows, limits):
    """rows: (id, client, us, oauth); returns id -> (admitted, retry, left minute, left hour)."""
    seen, out = {}, {}
    for id_, client, us, oauth in sorted(rows, key=lambda r: (r[2], r[0])):
        per_minute, per_hour = limits[oauth]
        times = [t for t in seen.get((client, oauth), []) if t > us - HOUR]
        minute = sum(t > us - MINUTE for t in times)
        if minute >= per_minute:
            out[id_] = (False, 60, None, None)
        elif len(times) >= per_hour:
            out[id_] = (False, 3600, None, None)
        else:
            times.append(us)
            out[id_] = (True, None, per_minute - minute - 1, per_hour - len(times))
        seen[(client, oauth)] = times
    return out


def traffic(seed, n, step):
    rnd = random.Random(seed)
    rows, now = [], {}
    for i in range(n):
        c = 0 if rnd.random() < .5 else rnd.randint(1, 3)          # one busy client
        gap = rnd.choice([0, 0, step // 20, step, 40 * step if rnd.random() < .1 else step // 3])
        now[c] = now.get(c, 1_700_000_000_000_000) + gap
        rows.append((i, c, now[c], rnd.random() < .2))
    return rows


SCHEMA = "id bigint, client bigint, us bigint, oauth boolean"


def test_batch_decisions(spark):
    for seed, step, (m, h, om, oh) in ((1, MINUTE // 5, (3, 20, 2, 4)), (2, MINUTE // 2, (2, 5, 1, 3)), (3, MINUTE * 3, (1, 6, 1, 2))):
        rows = traffic(seed, 700, step)
        want = simulate(rows, {False: (m, h), True: (om, oh)})
        got = ratelimit.decide(spark.createDataFrame(rows, SCHEMA), m, h, om, oh).collect()
        assert len(got) == len(rows)
        for r in got:
            assert (r["admitted"], r["retry_after"], r["remaining_minute"], r["remaining_hour"]) == want[r["id"]], r


def test_coarse_clock(spark):
    rows = [(i, c, us // 1_000_000 * 1_000_000, o) for i, c, us, o in traffic(4, 500, MINUTE // 8)]
    want = simulate(rows, {False: (3, 15), True: (1, 2)})
    got = ratelimit.decide(spark.createDataFrame(rows, SCHEMA), 3, 15, 1, 2, tick_us=1_000_000).collect()
    assert {r["id"]: r["admitted"] for r in got} == {k: v[0] for k, v in want.items()}


def test_attempt_rate(spark):
    rows = traffic(9, 600, MINUTE // 2)
    got = ratelimit.attempt_rate(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(got) == len(rows)
    for r in got:
        mine = [x[2] for x in rows if x[1] == r["client"]]
        assert r["attempts_minute"] == sum(r["us"] - MINUTE < t <= r["us"] for t in mine)
        assert r["attempts_hour"] == sum(r["us"] - HOUR < t <= r["us"] for t in mine)


def test_paths(spark):
    df = spark.createDataFrame([("/health",), ("/api/v1/auth/google/login",), ("/api/v1/auth/callback/google",), ("/api/v1/filter",), (None,)], "p string")
    got = [(r[0], r[1]) for r in df.select(ratelimit.limited(F.col("p")), ratelimit.is_oauth(F.col("p"))).collect()]
    assert got == [(False, False), (True, True), (True, True), (True, False), (True, None)]


def test_stream_keeps_state_between_batches(spark, tmp_path):
    rows = sorted(traffic(12, 400, MINUTE // 3), key=lambda r: r[2])
    src = str(tmp_path / "in")
    for part in range(4):
        df = spark.createDataFrame(rows[part * 100:(part + 1) * 100], SCHEMA)
        df.select("id", "client", F.timestamp_micros("us").alias("ts"), "oauth").coalesce(1).write.mode("append").parquet(src)
    stream = spark.readStream.schema("id bigint, client bigint, ts timestamp, oauth boolean").option("maxFilesPerTrigger", 1).parquet(src)
    plain = jobs.run_append(jobs.rate_limit(stream, 2, 8), str(tmp_path / "out")).collect()
    want = simulate([(i, c, us, False) for i, c, us, _ in rows], {False: (2, 8)})
    assert {r["id"]: (r["admitted"], r["retry_after"]) for r in plain} == {k: v[:2] for k, v in want.items()}
    apart = jobs.run_append(jobs.rate_limit(stream, 2, 8, 1, 3, oauth="oauth"), str(tmp_path / "out2")).collect()
    want = simulate(rows, {False: (2, 8), True: (1, 3)})
    assert {r["id"]: (r["admitted"], r["retry_after"]) for r in apart} == {k: v[:2] for k, v in want.items()}
