"""Fixed windows that open at a key's first request: batch form and stream form."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def rate_limit(requests: DataFrame, keys: list[str], ts: str, ident: str, seconds: int = 60, most: int = 10) -> DataFrame:
    """keys, ident, allowed: a request at or after the end of its key's window opens a new one; within a window the
    first `most` pass, later ones are turned away and don't extend it. Order is ts, then ident; null ts are left out.

    Rows of a key are read in order as they stream through one task; only the open window is held.
    """
    schema = ", ".join(f"`{c}` {requests.schema[c].dataType.simpleString()}" for c in [*keys, ident]) + ", allowed boolean"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, opened, n = None, 0, 0
        for pdf in batches:
            allowed = []
            for k, t in zip(pdf[keys].itertuples(index=False, name=None), pdf["_us"].tolist()):
                if k != key or t >= opened + seconds * 1_000_000:
                    key, opened, n = k, t, 0
                n += 1
                allowed.append(n <= most)
            yield pdf[[*keys, ident]].assign(allowed=allowed)

    us = F.unix_micros(F.col(ts).cast("timestamp"))
    rows = requests.where(F.col(ts).isNotNull()).select(*keys, ident, us.alias("_us"))
    return rows.repartition(*keys).sortWithinPartitions(*keys, "_us", ident).mapInPandas(run, schema)


def rate_limit_stream(requests: DataFrame, keys: list[str], ts: str, ident: str, seconds: int = 60, most: int = 10) -> DataFrame:
    """The same over a stream: state per key is the open window's start and count, dropped after an idle window.

    Requests are taken in the order of ts within a micro-batch; one older than the open window counts in it.
    """
    from pyspark.sql.streaming.state import GroupStateTimeout

    schema = ", ".join(f"`{c}` {requests.schema[c].dataType.simpleString()}" for c in [*keys, ident]) + ", allowed boolean"

    def run(key, batches, state):
        if state.hasTimedOut:
            state.remove()
            return
        opened, n = state.get if state.exists else (None, 0)
        rows = pd.concat(list(batches), ignore_index=True).sort_values(["_us", ident], kind="stable")
        allowed = []
        for t in rows["_us"].tolist():
            if opened is None or t >= opened + seconds * 1_000_000:
                opened, n = t, 0
            n += 1
            allowed.append(n <= most)
        state.update((opened, n))
        state.setTimeoutDuration(2 * seconds * 1000)
        yield rows[[*keys, ident]].assign(allowed=allowed)

    us = F.unix_micros(F.col(ts).cast("timestamp"))
    rows = requests.where(F.col(ts).isNotNull()).select(*keys, ident, us.alias("_us"))
    return rows.groupBy(*keys).applyInPandasWithState(run, schema, "opened bigint, n int", "append", GroupStateTimeout.ProcessingTimeTimeout)


def append_documents(stream: DataFrame, store: str, checkpoint: str):
    """Stream of documents appended to a parquet store, one commit a micro-batch; a doc_id already stored is left out."""

    def add(batch: DataFrame, _epoch: int) -> None:
        spark = batch.sparkSession
        new = batch.dropDuplicates(["doc_id"])
        try:
            new = new.join(spark.read.parquet(store).select("doc_id"), "doc_id", "left_anti")
        except Exception as e:  # noqa: BLE001
            if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
                raise
        new.write.mode("append").parquet(store)

    return stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
