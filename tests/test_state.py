"""State of streaming jobs (late rows, timers, closed traces) and stored partials."""

import decimal
import os
import random
import re
import time

import pytest
from pyspark.sql import functions as F

from screenwell import catalog as cat
from screenwell.functions import text as tx
from screenwell.operators import partials, stats, usage
from screenwell.operators.ratelimit import HOUR, MINUTE
from screenwell.plans import registry
from screenwell.sources import corpus
from screenwell.streaming import jobs

T0 = 1_700_000_000_000_000


def files(spark, folder, parts, schema, ts):
    """One file per part, read one per micro-batch in this order."""
    for at, rows in enumerate(parts):
        spark.createDataFrame(rows, schema).withColumn(ts, F.timestamp_micros(ts)).coalesce(1).write.mode("append").parquet(folder)
        new = max((os.path.join(folder, f) for f in os.listdir(folder) if f.endswith(".parquet")), key=os.path.getmtime)
        os.utime(new, (1_600_000_000 + at, 1_600_000_000 + at))
    return (spark.readStream.schema(re.sub(rf"\b{ts} bigint", f"{ts} timestamp", schema)).option("maxFilesPerTrigger", 1).parquet(folder))


def online(parts, per_minute, per_hour):
    """Decisions batch by batch: a row is judged at its own time; those below the watermark of the batch before are dropped."""
    out, times, mark, following, newest = {}, {}, 0, 0, 0
    for rows in parts:
        for id_, client, us in sorted(rows, key=lambda r: (r[2], r[0])):
            if us // 1000 < mark:
                continue
            mine = times.setdefault(client, [])
            minute, hour = (sum(us - w < t <= us for t in mine) for w in (MINUTE, HOUR))
            out[id_] = (True, None) if minute < per_minute and hour < per_hour else (False, 60 if minute >= per_minute else 3600)
            if out[id_][0]:
                mine.append(us)
        newest = max([newest, *[r[2] for r in rows]])
        mark, following = following, newest // 1000 - 600_000
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_late_requests(spark, tmp_path, seed):
    rnd = random.Random(seed)
    parts, now = [], T0
    for b in range(6):
        now += rnd.randrange(3, 14) * MINUTE
        parts.append([(b * 100 + i, rnd.choice([None, 1, 2, 3]), now - rnd.randrange(0, 25 * MINUTE) * (rnd.random() < .5)) for i in range(40)])
    stream = files(spark, str(tmp_path / "in"), parts, "id bigint, client bigint, ts bigint", "ts")
    got = {r.id: (r.admitted, r.retry_after) for r in jobs.run_append(jobs.rate_limit(stream, 2, 7), str(tmp_path / "out")).collect()}
    want = online(parts, 2, 7)
    assert got == want and len(want) < 240 and {v[1] for v in want.values()} == {None, 60, 3600}


def test_idle_clients_leave_no_state(spark, tmp_path):
    parts = [[(1, 7, T0), (2, 8, T0), (3, 8, T0 + 1)], [(4, 8, T0 + HOUR)], [(5, 9, T0 + 2 * HOUR)]]
    stream = files(spark, str(tmp_path / "in"), parts, "id bigint, client bigint, ts bigint", "ts")
    jobs.run_append(jobs.rate_limit(stream, 5, 9), str(tmp_path / "out"))
    check = str(tmp_path / "out" / "check")
    held = [{r.client: r.held for r in jobs.limiter_state(spark, check, b).collect()} for b in (0, jobs.last_batch(spark, check))]
    assert held == [{"7": 1, "8": 2}, {"8": 3, "9": 1}] or held == [{"7": 1, "8": 2}, {"8": 1, "9": 1}]


def test_traces_close_once(spark, tmp_path):
    schema = "trace_id bigint, tokens_used int, model string, latency_ms double, created_at bigint"
    parts = [[(1, 5, "gpt-4", 1.0, T0), (2, None, None, 2.0, T0 + MINUTE)], [(1, 7, "gpt-4", None, T0 + 30 * MINUTE)],
             [(3, 1, None, 1.0, T0 + 3 * HOUR)], [(3, 2, None, 1.0, T0 + 3 * HOUR + 1)],
             [(2, 9, None, 1.0, T0 + 2 * MINUTE), (3, 2, None, 1.0, T0 + 3 * HOUR + 2)]]
    stream = files(spark, str(tmp_path / "in"), parts, schema, "created_at")
    got = {r.trace_id: (r.total_tokens, r.total_latency_ms, r.spans) for r in jobs.run_append(
        jobs.trace_totals(stream), str(tmp_path / "out")).collect()}
    assert got == {1: (12, 1.0, 2), 2: (0, 2.0, 1)}   # the open trace is not there, the late span of a closed one is dropped


# -- stored partials ---------------------------------------------------------------------------------

ROLLUP = "api_key_id bigint, endpoint string, date date, hour int, requests_count bigint, tokens_used bigint, cost_usd decimal(10,6)"


def rollup(spark, rows):
    return spark.createDataFrame(rows, "k bigint, d string, n bigint").selectExpr(
        "k AS api_key_id", "'/filter' AS endpoint", "date(d) AS date", "3 AS hour", "n AS requests_count", "n * 2 AS tokens_used",
        "CAST(n / 10 AS decimal(10,6)) AS cost_usd")


def test_upsert_touches_its_dates_only(spark, tmp_path):
    path = str(tmp_path / "hourly")
    one, two = rollup(spark, [(1, "2024-01-01", 5), (1, "2024-01-01", 1), (2, "2024-01-02", 3)]), rollup(spark, [(2, "2024-01-02", 4), (9, "2024-01-03", 1)])
    assert usage.upsert_hourly(path, one, 0) == ["2024-01-01", "2024-01-02"]
    first = {f: os.path.getmtime(os.path.join(path, "period=2024-01-01", f)) for f in os.listdir(os.path.join(path, "period=2024-01-01"))}
    time.sleep(0.05)
    assert usage.upsert_hourly(path, two, 1) == ["2024-01-02", "2024-01-03"]
    assert first == {f: os.path.getmtime(os.path.join(path, "period=2024-01-01", f)) for f in os.listdir(os.path.join(path, "period=2024-01-01"))}
    assert usage.upsert_hourly(path, two, 1) == usage.upsert_hourly(path, one, 0) == usage.upsert_hourly(path, one.limit(0), 2) == []
    got = sorted((r.api_key_id, str(r.date), r.requests_count, r.tokens_used, float(r.cost_usd)) for r in partials.read(spark, path).collect())
    assert got == [(1, "2024-01-01", 6, 12, 0.6), (2, "2024-01-02", 7, 14, 0.7), (9, "2024-01-03", 1, 2, 0.1)]


def test_sums_of_a_merge_stand_alone(spark, capsys):
    """Between two aggregates is an exchange: no task holds the groups of two."""
    new = usage.hourly(rollup(spark, [(1, "2024-01-01", 5)]).withColumnsRenamed({"requests_count": "tokens"}))
    partials.summed(new, list(usage.PK)).explain()
    steps = re.findall("Exchange|HashAggregate", capsys.readouterr().out)
    assert steps.count("HashAggregate") == 4 and not any(a == b == "HashAggregate" for a, b in zip(steps, steps[1:]))


@pytest.mark.parametrize("name", ["filter_stats", "security_stats"])
def test_statistics_read_each_text_once(spark, data, monkeypatch, name):
    read, content = spark.sparkContext.accumulator(0), corpus.content

    def counted(spark, d):
        df = content(spark, d)

        def count(batches):
            for batch in batches:
                read.add(batch.num_rows)
                yield batch

        return df.mapInArrow(count, df.schema)

    registry.load()
    monkeypatch.setattr(corpus, "content", counted)
    assert registry.QUERIES[name](spark, data).count() == 1
    assert read.value == 2 * content(spark, data).count()   # two batches by the parity of the id, each filtered after the count


def test_stream_of_upserts(spark, tmp_path):
    schema = "api_key_id bigint, endpoint string, tokens bigint, cost_usd decimal(10,6), ts bigint"
    cents = decimal.Decimal("0.01")
    parts = [[(k, "/filter", k * 10 + b, cents, T0 + (b * 20 + k) * HOUR) for k in (1, 1, 2)] for b in range(3)] + [[(1, "/filter", 5, cents, T0 + HOUR)]]
    stream = files(spark, str(tmp_path / "in"), parts, schema, "ts")
    for _ in range(2):      # the second run finds nothing new
        jobs.usage_upserts(stream, str(tmp_path / "hourly"), str(tmp_path / "out"))
    got = partials.read(spark, str(tmp_path / "hourly"))
    every = spark.createDataFrame([r for p in parts for r in p], schema).withColumn("ts", F.timestamp_micros("ts"))
    want = usage.hourly(usage.bucket(every))
    columns = ["api_key_id", "date", "hour", "requests_count", "tokens_used"]
    assert sorted(map(tuple, got.select(columns).collect())) == sorted(map(tuple, want.select(columns).collect()))


def test_half_merged_batch(spark, tmp_path):
    """A batch of which one date was committed only adds to the others when it comes again."""
    path = str(tmp_path / "hourly")
    usage.upsert_hourly(path, rollup(spark, [(1, "2024-01-01", 1), (1, "2024-01-02", 1)]), 0)
    usage.upsert_hourly(path, rollup(spark, [(1, "2024-01-01", 10)]), 1)
    assert usage.upsert_hourly(path, rollup(spark, [(1, "2024-01-01", 10), (1, "2024-01-02", 10)]), 1) == ["2024-01-02"]
    assert sorted(r.requests_count for r in partials.read(spark, path).collect()) == [11, 11]


def test_reading_partials_prunes_periods(spark, tmp_path):
    path = str(tmp_path / "hourly")
    new = rollup(spark, [(1, "2024-01-01", 1), (1, "2024-01-02", 1)])
    usage.upsert_hourly(path, new, 0)
    plan = partials.stored(spark, path, new).filter(F.col("period").isin(["2024-01-02"]))._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*period", plan)


def test_status_changes_move_incidents(spark):
    schema = "id bigint, status string, at date"
    before = spark.createDataFrame([(1, "open", None), (2, "open", None), (3, "resolved", None)], schema)
    after = spark.createDataFrame([(1, "resolved", None), (2, "open", None), (3, "open", None)], schema)
    got = {r.status: r.incidents for r in stats.status_partials(before, after, "id", F.col("at")).collect()}
    assert got.get("open", 0) == 0 and got.get("resolved", 0) == 0
    after = after.withColumn("status", F.lit("resolved"))
    got = {r.status: r.incidents for r in stats.status_partials(before, after, "id", F.col("at")).collect()}
    assert got == {"open": -2, "resolved": 2}


def test_empty_statistics(spark):
    empty = spark.createDataFrame([], "content_id bigint, risk_score double, threats array<struct<threat_type:string>>, day date")
    one = stats.analysis_partials(empty, F.col("day"))
    incidents = spark.createDataFrame([], "day date, status string, incidents bigint")
    keys = spark.createDataFrame([], "id bigint, user_id bigint, is_active boolean")
    requests = stats.key_requests(keys, spark.createDataFrame([], ROLLUP), "/filter")
    row = stats.security_row(one, incidents, requests).first()
    assert (row.total_analyses, row.open_incidents, row.average_risk_score, row.keys_used) == (0, 0, 0.0, 0)


# -- word boundaries ---------------------------------------------------------------------------------

EDGES = (r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b", r"\b(?:\+?1[-.]?)?\(?([0-9]{3})\)?[-.]?([0-9]{3})[-.]?([0-9]{4})\b",
         r"\b(?:10\.|172\.(?:1[6-9]|2[0-9]|3[01])\.|192\.168\.)\d{1,3}\.\d{1,3}\b", r"\b(?:\d[ -]?){3,9}\b", r"(?i)\b(send|mail)\b[^.\n]{0,9}",
         r"\b\w+ly\b", r"x\b", r"\b", r"\b(?:a|)b", r"\b[^a]b", r"\b(?=x)x", r"\b.a\b", r"\b-?\d+\b", r"a\b\W\b[b_-]+", r"\bs")


def test_boundaries_equal_the_dialect(spark):
    rnd = random.Random(4)
    bits = ["a", "b", "x", "1", "555", "0123", "-", ".", "@", " ", "+1", "(", ")", "_", "é", "́", "١", "ſ", "10.", "172.16.", "\x1c", "send", "ly", "S", "%"]
    texts = ["".join(rnd.choice(bits) for _ in range(rnd.randrange(12))) for _ in range(1500)]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    rows = df.select("t", *[F.regexp_count("t", tx.rx(p)).alias(f"n{i}") for i, p in enumerate(EDGES)]).collect()
    for i, p in enumerate(EDGES):
        plain = re.compile(p)
        for r in rows:
            want = sum(1 for _ in plain.finditer(r.t))
            assert r[f"n{i}"] == want, (p, r.t)


def test_edges_are_settled_by_the_next_character():
    for p in cat.PII:
        assert "(?=[" in tx.java(p.regex)[:12]
