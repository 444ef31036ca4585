"""Two-horizon sliding-window rate limiting.

Only admitted requests count, so each decision depends on the ones before it.
The batch form keeps that chain short and everything else parallel:

1. attempts are counted per client and clock tick, and the ticks of one client
   and second packed into sorted slices: these groups are bounded by the clock,
   so a client holding much of the log is spread over its seconds;
2. a client's log is cut where an hour passes without an attempt, as nothing is
   remembered that long; the chain reads the slices of each such part in order, jumps
   to the next tick that can be admitted, and returns admissions only: at most the
   hourly limit per client and hour, whatever the traffic; they are written out once;
3. decisions go back to the attempts by equi-joins on (client, tick) and
   (client, minute), both small on the decision side.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from screenwell import catalog as cat
from screenwell.sources import tables as tb

SECOND, MINUTE, HOUR = 1_000_000, 60_000_000, 3_600_000_000
SLICE = 512


def _div(c: Column, n: int) -> Column:
    return F.call_function("div", c, F.lit(n))


def is_oauth(path: Column) -> Column:
    return path.startswith(cat.OAUTH_PREFIX) | (path == cat.OAUTH_CALLBACK)


def limited(path: Column) -> Column:
    """Paths that are subject to limits at all."""
    return F.coalesce(~path.isin(*cat.RATE_EXEMPT_PATHS), F.lit(True))


def by_path(df: DataFrame, path: str = "endpoint") -> DataFrame:
    """Requests subject to limits, with the column `oauth` that tells which ones apply."""
    return df.filter(limited(F.col(path))).withColumn("oauth", F.coalesce(is_oauth(F.col(path)), F.lit(False)))


def attempt_rate(df: DataFrame, client: str = "client", micros: str = "us", id_: str = "id") -> DataFrame:
    """Attempts in the trailing minute and hour of every attempt, itself included.

    Attempts are counted per client and second, and whole seconds are added up from these counts, in windows of at most two
    hours of seconds, whatever the traffic.  Where a span begins and ends inside a second, its attempts are ranked
    there, together with the times at which those of a minute and an hour ago fall out; so
    the rows of one client are spread over its seconds.
    """
    second = _div(F.col(micros), SECOND)
    counts = df.groupBy(F.col(client).alias("_client"), second.alias("_s")).agg(F.count("*").alias("_n"))
    hours = F.explode(F.array(*[F.struct((_div(F.col("_s"), 3600) + i).alias("h"), F.lit(i == 0).alias("own")) for i in (0, 1)]))
    before = Window.partitionBy("_client", "_h.h").orderBy("_s")
    whole = counts.withColumn("_h", hours).withColumn("_minute", F.sum("_n").over(before.rangeBetween(-60, -1))).withColumn(
        "_hour", F.sum("_n").over(before.rangeBetween(-3600, -1))).filter("_h.own").select("_client", "_s", "_minute", "_hour")
    attempt = F.struct(*df.columns)
    times = df.select(F.col(client).alias("_client"), F.explode(F.array(*[
        F.struct((F.col(micros) + by).alias("at"), F.lit(kind).alias("kind"), (attempt if not by else F.lit(None).cast(
            df.select(attempt.alias("x")).schema["x"].dataType)).alias("row"))
        for kind, by in (("own", 0), ("minute", MINUTE), ("hour", HOUR))])).alias("_t")).select("_client", "_t.*").withColumn(
        "_second", _div(F.col("at"), SECOND))
    inside = Window.partitionBy("_client", "_second").orderBy("at").rangeBetween(Window.unboundedPreceding, 0)
    ranked = times.select("_client", "_second", "kind", "row", *[
        F.count_if(F.col("kind") == kind).over(inside).alias(f"_{kind}s") for kind in ("own", "minute", "hour")]).filter("kind = 'own'")
    joined = ranked.join(whole, ranked["_client"].eqNullSafe(whole["_client"]) & (F.col("_second") == F.col("_s")))
    return joined.select("row.*", *[
        (F.coalesce(f"_{kind}", F.lit(0)) + F.col("_owns") - F.col(f"_{kind}s")).alias(f"attempts_{kind}") for kind in ("minute", "hour")])


def decide(df: DataFrame, per_minute: int = cat.RATE_PER_MINUTE, per_hour: int = cat.RATE_PER_HOUR,
           oauth_per_minute: int = cat.OAUTH_PER_MINUTE, oauth_per_hour: int = cat.OAUTH_PER_HOUR,
           client: str = "client", micros: str = "us", id_: str = "id", oauth: str = "oauth",
           tick_us: int = 1) -> DataFrame:
    """Decision on every attempt, ordered per client by time, then id.

    Adds `admitted`, `retry_after` (60 or 3600 on denial) and the remaining
    allowance of both horizons after an admission.  OAuth requests count apart
    under their own limits.  `tick_us` is the clock's resolution; a coarser clock
    means fewer ticks in the chain.  Requests without a client share one allowance.
    """
    limits = {False: (per_minute, per_hour), True: (oauth_per_minute, oauth_per_hour)}
    tick = _div(F.col(micros), tick_us)
    base = df.withColumn("_t", tick).withColumn("_m", _div(F.col(micros), MINUTE)).withColumn(
        "_client", F.coalesce(F.col(client).cast("string"), F.lit("unknown")))
    key = ["_client", oauth]
    admitted = tb.materialise(
        _chain(_parts(_slices(base, key, tick_us), key, tick_us), key, limits, tick_us), "admissions").withColumn(
        "_m", _div(F.col("_t") * tick_us, MINUTE))
    # attempts admitted by rank within their tick; ranks beyond the limit are trimmed before the shuffle
    top = max(per_minute, oauth_per_minute)
    rank = F.row_number().over(Window.partitionBy(*key, "_t").orderBy(id_))
    first = base.select(*key, "_t", id_).withColumn("_rank", rank).filter(F.col("_rank") <= top)
    winners = (first.join(admitted, [*key, "_t"]).filter(F.col("_rank") <= F.col("k"))
               .select(id_, "_rank", F.col("minute_before").alias("_mb"), F.col("hour_before").alias("_hb")))
    # a denial names the horizon that was full: admissions of the minute before it decide
    spread = admitted.select(*key, F.explode(F.array("_m", F.col("_m") + 1)).alias("_m"), F.struct("_t", "k").alias("adm"))
    nearby = spread.groupBy(*key, "_m").agg(F.collect_list("adm").alias("near"))
    out = base.join(winners, id_, "left").join(nearby, [*key, "_m"], "left")
    window_start = F.col("_t") * tick_us - MINUTE
    recent = F.aggregate(
        F.filter(F.coalesce("near", F.array().cast("array<struct<_t:bigint,k:int>>")),
                 lambda a: (a["_t"] * tick_us > window_start) & (a["_t"] <= F.col("_t"))),
        F.lit(0), lambda acc, a: acc + a["k"])
    m = F.when(F.col(oauth), F.lit(oauth_per_minute)).otherwise(F.lit(per_minute))
    h = F.when(F.col(oauth), F.lit(oauth_per_hour)).otherwise(F.lit(per_hour))
    ok = F.col("_rank").isNotNull()
    return out.select(
        *df.columns, ok.alias("admitted"),
        F.when(ok, F.lit(None).cast("int")).when(recent >= m, F.lit(60)).otherwise(F.lit(3600)).alias("retry_after"),
        F.when(ok, m - F.col("_mb") - F.col("_rank")).cast("int").alias("remaining_minute"),
        F.when(ok, h - F.col("_hb") - F.col("_rank")).cast("int").alias("remaining_hour"))


def _slices(base: DataFrame, key: list[str], tick_us: int) -> DataFrame:
    """Distinct ticks with their counts, as sorted arrays of at most SLICE ticks."""
    second = _div(F.col("_t") * tick_us, SECOND).alias("_s")
    ticks = base.groupBy(*key, second, "_t").agg(F.count("*").alias("n"))
    packed = ticks.groupBy(*key, "_s").agg(F.array_sort(F.collect_list(F.struct("_t", "n"))).alias("a"))
    cuts = F.sequence(F.lit(1), F.size("a"), F.lit(SLICE))
    sliced = packed.select(*key, F.explode(F.transform(cuts, lambda i: F.slice("a", i, F.lit(SLICE)))).alias("a"))
    return sliced.select(*key, F.col("a")[0]["_t"].alias("first"), F.col("a._t").alias("t"), F.col("a.n").alias("n"))


def _parts(slices: DataFrame, key: list[str], tick_us: int) -> DataFrame:
    """Slices with the number of their part of the client's log; parts lie a whole empty clock hour or more apart.

    The window sees one row per client and hour.
    """
    hour = _div(F.col("first") * tick_us, HOUR)
    in_order = Window.partitionBy(*key).orderBy("_h")
    apart = F.coalesce(F.col("_h") - F.lag("_h").over(in_order) > 1, F.lit(False)).cast("int")
    hours = slices.select(*key, hour.alias("_h")).distinct().withColumn("_apart", apart).withColumn(
        "_part", F.sum("_apart").over(in_order)).drop("_apart")
    return slices.withColumn("_h", hour).join(hours, [*key, "_h"]).drop("_h")


def _chain(slices: DataFrame, key: list[str], limits: dict, tick_us: int) -> DataFrame:
    """Admissions per client and tick, from slices of each part in time order.

    State is one deque of admissions of the last hour, at most as
    many as the hourly limit; slices arrive sorted, so the state of one part is
    held at a time.
    """
    client, oauth = key

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, state = None, None
        for pdf in batches:
            rows = []
            for c, o, part, t, n in zip(pdf[client], pdf[oauth], pdf["_part"], pdf["t"], pdf["n"]):
                if (c, o, part) != current:
                    current, state = (c, o, part), Limiter(*limits[bool(o)])
                rows += [(c, o, *hit) for hit in state.run(np.asarray(t), np.asarray(n), tick_us)]
            yield pd.DataFrame(rows, columns=[client, oauth, "_t", "k", "minute_before", "hour_before"])

    kinds = dict(slices.dtypes)
    schema = f"{client} {kinds[client]}, {oauth} boolean, _t bigint, k int, minute_before int, hour_before int"
    return slices.repartition(*key, "_part").sortWithinPartitions(*key, "_part", "first").mapInPandas(run, schema)


class Limiter:
    """Admissions of one client over two sliding windows, times in microseconds."""

    def __init__(self, per_minute: int, per_hour: int):
        self.per_minute, self.per_hour = per_minute, per_hour
        self.minute_q: deque = deque()
        self.hour_q: deque = deque()
        self.n_minute = self.n_hour = 0

    def _expire(self, now: int) -> None:
        while self.minute_q and self.minute_q[0][0] <= now - MINUTE:
            self.n_minute -= self.minute_q.popleft()[1]
        while self.hour_q and self.hour_q[0][0] <= now - HOUR:
            self.n_hour -= self.hour_q.popleft()[1]

    def attempt(self, now: int, n: int = 1) -> tuple[int, int, int]:
        """Admit up to n simultaneous attempts: (admitted, used minute, used hour before)."""
        self._expire(now)
        before = (self.n_minute, self.n_hour)
        k = max(0, min(n, self.per_minute - self.n_minute, self.per_hour - self.n_hour))
        if k:
            self.minute_q.append((now, k))
            self.hour_q.append((now, k))
            self.n_minute += k
            self.n_hour += k
        return k, *before

    def next_open(self) -> int | None:
        """Earliest time at which a full horizon lets something through again."""
        t = None
        if self.n_minute >= self.per_minute and self.minute_q:
            t = self.minute_q[0][0] + MINUTE
        if self.n_hour >= self.per_hour and self.hour_q:
            t = max(t or 0, self.hour_q[0][0] + HOUR)
        return t

    def run(self, ticks: np.ndarray, counts: np.ndarray, tick_us: int) -> Iterator[tuple[int, int, int, int]]:
        """Run over sorted ticks, jumping past those that cannot be admitted."""
        i = 0
        while i < len(ticks):
            k, mb, hb = self.attempt(int(ticks[i]) * tick_us, int(counts[i]))
            if k:
                yield int(ticks[i]), k, mb, hb
                i += 1
                continue
            opens = self.next_open()
            if opens is None:
                return
            i = max(i + 1, int(np.searchsorted(ticks, -(-opens // tick_us), side="left")))
