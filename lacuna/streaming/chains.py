"""Chain checks over a stream of log entries, with state per chain.

State is the last number, the last stored digest and counts. Late or reordered
entries are findings, so nothing is dropped by a watermark.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from lacuna.operators.chain import GENESIS
from lacuna.session import shared_folder

SCHEMA = "chain_id long, length long, n_seq_gap long, n_broken_link long, last_seq long"
STATE = "last_seq long, last_hash string, length long, n_seq_gap long, n_broken_link long, max_seq long"


def _check(key, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
    last, tip, length, gaps, broken, top = state.get if state.exists else (0, GENESIS, 0, 0, 0, 0)
    rows = pd.concat(list(frames)).sort_values("pos")
    for seq, prev, own in zip(rows["seq"], rows["prev_hash"], rows["entry_hash"], strict=True):
        gaps += seq != last + 1
        broken += prev != tip
        last, tip, length, top = seq, own, length + 1, max(top, seq)
    state.update((int(last), tip, int(length), int(gaps), int(broken), int(top)))
    yield pd.DataFrame({"chain_id": [key[0]], "length": [length], "n_seq_gap": [gaps], "n_broken_link": [broken], "last_seq": [top]})


def check_stream(log: DataFrame) -> DataFrame:
    """The state of each chain whenever it gets entries; entries of one trigger are taken in order of pos."""
    return log.groupBy("chain_id").applyInPandasWithState(_check, SCHEMA, STATE, "update", GroupStateTimeout.NoTimeout)


def check_table(log: DataFrame) -> DataFrame:
    """A table of entries run through the stream until all are in; the last state of each chain."""
    spark = log.sparkSession
    folder = f"{shared_folder(spark)}/lacuna-stream-{uuid.uuid4().hex}"
    log.write.parquet(f"{folder}/in")
    stream = spark.readStream.schema(log.schema).parquet(f"{folder}/in")

    def keep(batch: DataFrame, number: int) -> None:
        batch.withColumn("trigger", F.lit(number)).write.mode("overwrite").parquet(f"{folder}/out/trigger-{number}")

    check_stream(stream).writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    out = spark.read.parquet(f"{folder}/out/*")
    names = [c.split()[0] for c in SCHEMA.split(", ")][1:]
    return out.groupBy("chain_id").agg(*[F.max_by(c, F.struct("trigger", "length")).alias(c) for c in names])
