"""The throttle with a state per key that ends by itself.

`live.notifications` carries what passed as a table that is written anew with every batch. With very many
keys of which a batch touches few, a state per key is less work: only the keys that a batch brings are
read and written, and a timer removes a key once all that may still come would pass.

A key's rows of one micro-batch, few fields each, go to one task, so the source's limit on a batch
bounds it. Without keys, or where one key is most of the stream, use `live.notifications`, which
splits a key by time.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from netsight.functions.timefn import MICROS
from netsight.session import ship_package
from netsight.streaming import core

#: Times keep their microseconds on the way through the state.
_JSON = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}


def _passing(width: int, ties: list[str]) -> Callable:
    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        sent = state.get[0] if state.exists else None
        # What the last row that passed still holds back is dropped frame by frame.
        held = [f if sent is None else f[f["_us"] >= sent + width] for f in frames]
        rows = pd.concat(held).sort_values(["_us", *ties], na_position="first", kind="stable")
        times, chosen, place = rows["_us"].to_numpy(), [], 0
        while place < len(times):
            chosen.append(place)
            place = int(np.searchsorted(times, times[place] + width))
        if chosen:
            sent = int(times[chosen[-1]])
            state.update((sent,))
        # From then on every row passes, and so the key needs no state.
        over = -(-(sent + width) // 1000)
        state.setTimeoutTimestamp(max(over, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"row": rows["_row"].to_numpy()[chosen]})

    return step


def notifications(alerts: DataFrame, path: str, checkpoint: str, *, by: Sequence[str], seconds: float = 300,
                  ties: Sequence[str] = (), delay_seconds: float = 10, **run) -> StreamingQuery:
    """Per key, the alerts that come at least `seconds` after the last one that was sent.

    Of alerts with one key and time the first by `ties` (default: all columns) is sent. Alerts without a
    time are not sent; those later than the delay, as the batch before has left it, are dropped. A null key is a key.
    """
    ship_package(alerts.sparkSession)
    names = [*(ties or [c for c in alerts.columns if c != "ts"])]
    tied = [f"_t{i}" for i in range(len(names))]
    rows = core.event_time(alerts, delay=f"{delay_seconds} seconds").filter(F.col("ts").isNotNull())
    narrow = rows.select(
        *[F.col(k).alias(f"_k{i}") for i, k in enumerate(by)], F.col("ts").alias("_at"), F.unix_micros("ts").alias("_us"),
        *[F.col(n).alias(t) for n, t in zip(names, tied, strict=True)],
        F.to_json(F.struct(*rows.columns), _JSON).alias("_row"),
    )
    sent = narrow.groupBy(*[f"_k{i}" for i in range(len(by))]).applyInPandasWithState(
        _passing(int(seconds * MICROS), tied), "row string", "last_us bigint", "append", GroupStateTimeout.EventTimeTimeout
    )
    back = sent.select(F.from_json("row", rows.schema, _JSON).alias("r")).select("r.*")
    return core.start(core.to_ntz(back), path, checkpoint, **run)
