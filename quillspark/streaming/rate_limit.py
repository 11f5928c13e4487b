"""Sliding-window admission per client (U4): in batch by streams of sorted rows, in streams by keyed state."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def admit_batch(requests: DataFrame, client: str, at: str, order: str, limit: int = 5, seconds: int = 600) -> DataFrame:
    """``requests`` with ``admitted``: at most ``limit`` admitted calls of a client in the ``seconds`` before; rejected ones aren't counted.

    The order of a client's calls decides, so they pass one task as a stream; what is kept is ``limit`` times per client.
    """
    cols = requests.columns
    keyed = requests.where(F.col(client).isNotNull() & F.col(at).isNotNull()).withColumn("_us", F.unix_micros(at))
    ordered = keyed.repartition(client).sortWithinPartitions(client, "_us", order)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        who, taken = None, deque()
        for b in batches:
            out = []
            for c, us in zip(b[client], b["_us"], strict=True):
                if c != who:
                    who, taken = c, deque()
                while taken and taken[0] <= us - seconds * 1_000_000:
                    taken.popleft()
                ok = len(taken) < limit
                if ok:
                    taken.append(us)
                out.append(ok)
            yield b.drop(columns="_us").assign(admitted=out)[[*cols, "admitted"]]

    schema = ", ".join(f"`{n}` {t}" for n, t in requests.dtypes) + ", admitted boolean"
    return ordered.mapInPandas(run, schema)


def admit_stream(requests: DataFrame, client: str, at: str, limit: int = 5, seconds: int = 600) -> DataFrame:
    """``client, at, admitted`` for a stream of requests. State of a client: the times it was admitted at within the window.

    With a watermark on ``at``, state goes when event time has passed its last admission by the window; without one it stays.
    """
    from pyspark.sql.streaming.state import GroupStateTimeout

    def run(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        taken = [int(t) for t in state.get[0]] if state.exists else []
        rows = sorted(us for b in batches for us in b["us"])
        out = []
        for us in rows:
            taken = [t for t in taken if t > us - seconds * 1_000_000]
            ok = len(taken) < limit
            if ok:
                taken.append(us)
            out.append(ok)
        state.update((taken,))
        end = taken[-1] // 1000 + seconds * 1000 if taken else 0
        if marked and end > state.getCurrentWatermarkMs():
            state.setTimeoutTimestamp(end)
        yield pd.DataFrame({"client": [key[0]] * len(rows), "at": pd.to_datetime(pd.Series(rows, dtype="int64"), unit="us"), "admitted": out})

    marked = "EventTimeWatermark" in requests._jdf.queryExecution().analyzed().toString()
    timeout = GroupStateTimeout.EventTimeTimeout if marked else GroupStateTimeout.NoTimeout
    slim = requests.select(F.col(client).cast("string").alias("client"), F.col(at), F.unix_micros(at).alias("us"))
    return slim.groupBy("client").applyInPandasWithState(run, "client string, at timestamp, admitted boolean", "taken array<long>", "append", timeout)
