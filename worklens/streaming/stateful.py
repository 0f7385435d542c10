"""Step objects of ``operators.folds`` as a keyed stateful stream."""

from __future__ import annotations

import json
import sys
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import LongType, StringType, StructField, StructType

from worklens.operators.folds import Step, _frame
from worklens.session import shared_folder

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # see operators.folds

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Groups of keys whose state is read and written at once.
SHARES = 2048


def _text(columns: list[str], rows: list[list]) -> str:
    return json.dumps([columns, rows], default=lambda x: x.tolist() if hasattr(x, "tolist") else str(x))


class FoldProcessor(StatefulProcessor):
    """Keeps the steps of a share of the keys and the rows that the watermark has not passed yet, as text. When it passes them, a key's
    rows are fed in time order; so the cut into micro-batches and the order of the files do not matter."""

    def __init__(self, make: Callable[[], Step], keys: list[str], order: list[str], names: list[str], close_after: float | None = None):
        self.make, self.keys, self.order, self.names, self.close_after = make, keys, order, names, close_after

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("steps", StructType([StructField("text", StringType())]))
        self.waiting = handle.getListState("waiting", StructType([StructField("at", LongType()), StructField("text", StringType())]))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        first = None
        for batch in rows:
            if batch.empty:
                continue
            at = batch[self.order[0]].to_numpy("datetime64[ns]").astype("int64") // 1_000_000
            first = int(at.min()) if first is None else min(first, int(at.min()))
            # the rows of a batch are one entry, since writing an entry costs more than its rows do
            held = [[int(a), *values] for a, values in zip(at, batch.itertuples(index=False, name=None))]
            self.waiting.appendList([(int(at.min()), _text(list(batch.columns), held))])
        if first is not None:
            self.handle.registerTimer(first)
        yield _frame([], self.names)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        found = self.state.get()
        steps = {tuple(k): (last, text) for k, last, text in json.loads(found[0])} if found else {}
        ready: dict[tuple, list[tuple]] = {}
        later, waits = [], set()
        for _, text in self.waiting.get():
            columns, held = json.loads(text)
            late = []
            for at, *values in held:
                row = dict(zip(columns, values))
                key = tuple(row[k] for k in self.keys)
                if at <= now:
                    ready.setdefault(key, []).append((at, row))
                else:
                    waits.add(key)
                    late.append([at, *values])
            if late:
                later.append((min(r[0] for r in late), text if len(late) == len(held) else _text(columns, late)))
        closes = lambda last: None if self.close_after is None else last + int(self.close_after * 1000)
        silent = [k for k, (last, _) in steps.items() if k not in ready and k not in waits and closes(last) is not None and closes(last) <= now]
        if not ready and not silent:
            return
        out = []
        for k in [*ready, *silent]:
            step, last = self.make(), None
            if k in steps:
                last, text = steps[k]
                step.load(text)
            rows = sorted(ready.get(k, []), key=lambda r: [r[1][c] for c in self.order])
            out += [k + r for _, row in rows for r in step.feed(row)]
            last = max((at for at, _ in rows), default=last)
            if closes(last) is not None and closes(last) <= now and k not in waits:  # the key has been silent: end it and forget it
                out += [k + r for r in step.finish()]
                steps.pop(k, None)
            else:
                steps[k] = (last, step.dump())
        if ready:
            self.waiting.clear()
            if later:
                self.waiting.put(later)
        if steps:
            self.state.update((json.dumps([[list(k), last, text] for k, (last, text) in steps.items()]),))
        else:
            self.state.clear()
        ahead = [at for at, _ in later] + [c for c in (closes(last) for last, _ in steps.values()) if c is not None and c > now]
        if ahead:
            self.handle.registerTimer(min(ahead))
        yield _frame(out, self.names)

    def close(self) -> None:
        pass


def fold_stream(stream: DataFrame, keys: list[str], order: list[str], make: Callable[[], Step], schema: str, delay: str = "10 minutes",
                close_after: float | None = None) -> DataFrame:
    """The fold of ``make`` per key over a stream, in event time.

    ``order`` begins with the event time. Rows wait in the state until the watermark, ``delay`` behind the newest row,
    has passed them; rows that come later than that are dropped, as in any windowed stream. A key without a row for
    ``close_after`` seconds is finished and its state dropped. Keys are dealt into SHARES groups that keep their state together, since every
    call to the state store costs as much as feeding many rows. The session must use the RocksDB state store."""
    names = [part.split()[0] for part in schema.split(",")]
    share = F.pmod(F.xxhash64(*keys), F.lit(SHARES))
    return stream.withWatermark(order[0], delay).withColumn("__share", share).groupBy("__share").transformWithStateInPandas(
        statefulProcessor=FoldProcessor(make, keys, order, names, close_after), outputStructType=schema, outputMode="Append", timeMode="EventTime")


def run_fold(spark: SparkSession, stream: DataFrame, fold: Callable[[DataFrame], DataFrame], ts: str) -> DataFrame:
    """Run ``fold`` over everything there is in ``stream``, then close it: a second run from the same checkpoint reads one
    row without a key, far ahead, whose watermark passes all rows that still wait. Returns the rows of both runs."""
    provider = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    base = f"{shared_folder(spark)}/worklens-fold-{uuid.uuid4().hex[:8]}"
    schema = StructType([StructField(f.name, f.dataType) for f in stream.schema])
    ahead = spark.createDataFrame([(None,) * len(schema)], schema).withColumn(ts, F.lit("2200-01-01").cast("timestamp"))
    ahead.limit(0).write.parquet(f"{base}/end")
    closing = spark.readStream.schema(schema).parquet(f"{base}/end")
    rows = fold(stream.unionByName(closing))
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    try:
        for end in (False, True):
            if end:
                ahead.write.mode("append").parquet(f"{base}/end")
            writer = rows.writeStream.outputMode("append").option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True)
            writer.format("parquet").option("path", f"{base}/rows").start().awaitTermination()
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", provider)
    return spark.read.schema(rows.schema).parquet(f"{base}/rows")
