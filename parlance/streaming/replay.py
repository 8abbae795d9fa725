"""Replays of a table as a stream: slices in order, one run of the query each, all from one checkpoint."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parlance.sources.committed import KeyedTable
from parlance.sources.folders import remove, shared_folder

#: The state store that keyed state needs.
ROCKSDB = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def replay(rows: DataFrame, by: str, build: Callable[[DataFrame], DataFrame], keys: list[str], order: str | None = None, cuts: list | None = None, slices: int = 2, folder: str | None = None) -> DataFrame:
    """Write ``rows`` slice after slice by ascending ``by``, and after each run ``build`` over the stream to its end.

    ``cuts`` are the last values of all slices but the last; without them ``slices`` of about the same size are
    cut. Every run but the first is a restart from the checkpoint of the one before. Results go to a keyed table
    by ``keys``, a batch exactly once; its rows are returned.
    """
    spark = rows.sparkSession
    folder = folder or shared_folder(spark, "replay")
    session = spark.newSession()
    for name in ("spark.sql.shuffle.partitions", "spark.sql.session.timeZone"):
        session.conf.set(name, spark.conf.get(name))
    session.conf.set(*ROCKSDB)
    table = KeyedTable(session, f"{folder}/table", *keys, order=order)
    if cuts is None:
        steps = F.array(*(F.lit(i / slices) for i in range(1, slices)))
        cuts = rows.select(F.percentile_approx(by, steps, F.lit(1000))).first()[0] or []
    for low, high in zip([None, *cuts], [*cuts, None], strict=True):
        own = rows if low is None else rows.where(F.col(by) > low)
        own = own if high is None else own.where(F.col(by) <= high)
        own.write.mode("append").parquet(f"{folder}/in")
        stream = build(session.readStream.schema(rows.schema).parquet(f"{folder}/in"))
        query = stream.writeStream.foreachBatch(table.sink("replay")).outputMode("append").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
        query.awaitTermination()
    for name in ("in", "checkpoint"):
        remove(session, f"{folder}/{name}")
    return KeyedTable(spark, f"{folder}/table", *keys, order=order).read()
