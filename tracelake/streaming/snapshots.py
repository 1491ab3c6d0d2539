"""Rate-limited snapshots on a stream of looks at assets."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _take(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Looks of one asset that become snapshots; the state is the last one taken."""
    looks = pd.concat(list(batches)).sort_values(["ts", "event_id"])
    last = pd.Timestamp(state.get[0], unit="us") if state.exists else None
    taken = []
    for i, (ts, days) in enumerate(zip(looks["ts"], looks["days"])):
        if last is None or ts - last >= pd.Timedelta(days=int(days)):
            last = ts
            taken.append(i)
    if last is not None:
        state.update((int(last.value // 1000),))
    yield looks.iloc[taken][["asset_id", "ts", "event_id"]]


def rate_limited(looks: DataFrame) -> DataFrame:
    """``looks``: a stream of asset_id, ts, event_id, days (the asset's period).

    One number is kept per asset. A trigger's share of an asset is sorted in
    memory, so the source's ``maxBytesPerTrigger`` bounds it; the batch form,
    which has no such bound, never gathers an asset at all.
    """
    return looks.groupBy("asset_id").applyInPandasWithState(
        _take, "asset_id string, ts timestamp, event_id bigint", "last_us bigint", "append",
        GroupStateTimeout.NoTimeout)


def start(looks: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Append the snapshots taken to ``out``, as far as there is data now."""
    looks.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    return (rate_limited(looks).writeStream.format("parquet").outputMode("append")
            .option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
