"""Hash-chained audit logs: every record's hash covers the hash of the one before it in its chain.

A log in a folder goes on from batch to batch: a batch's records begin at their chains' heads (last
sequence number and hash), which the batch before has written. Records and heads of a batch count once
its commit is there; a batch given twice under one name is written once.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from trovespark.sources.commits import commit, commits

GENESIS = "0" * 64
#: So many batches' heads are read before they are written as one table.
FOLD_HEADS = 32
HEAD = "chain string, seq long, hash string"
LOG = "chain string, seq long, body string, prev_hash string, hash string"


def chained(records: DataFrame, chain: str, seq: str, body: str, first: str = GENESIS, begin: str | None = None) -> DataFrame:
    """(chain, seq, body, prev_hash, hash). A chain is a sequence, so it is folded in order, in batches: rows of a chain stay in one
    partition, sorted, and stream through; nothing of a chain is held but its last hash. A chain begins at first, or at what the column begin says (null: first)."""
    schema = f"{chain} string, {seq} long, {body} string, prev_hash string, hash string"

    def fold(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, last = None, first
        for pdf in it:
            prev, out = [], []
            for c, b, begun in zip(pdf[chain], pdf[body], pdf["_begin"], strict=True):
                if c != now:
                    now, last = c, begun or first
                prev.append(last)
                last = hashlib.sha256(f"{last}|{b}".encode()).hexdigest()
                out.append(last)
            yield pdf.drop(columns="_begin").assign(prev_hash=prev, hash=out)

    start = F.lit(None) if begin is None else F.col(begin)
    rows = records.select(F.col(chain).cast("string").alias(chain), F.col(seq).cast("long").alias(seq), F.col(body).cast("string").alias(body), start.cast("string").alias("_begin"))
    return rows.repartition(chain).sortWithinPartitions(chain, seq).mapInPandas(fold, schema)


def chain_breaks(log: DataFrame, chain: str, seq: str, body: str, first: str = GENESIS) -> DataFrame:
    """(chain, records, first_break, last_hash): where a record doesn't follow from the one before, the least seq of such; null if none."""
    order = Window.partitionBy(chain).orderBy(seq)
    good = (F.col("prev_hash") == F.coalesce(F.lag("hash").over(order), F.lit(first))) & (F.col("hash") == F.sha2(F.concat_ws("|", "prev_hash", body), 256))
    checked = log.withColumn("_good", good)
    return checked.groupBy(chain).agg(F.count("*").alias("records"), F.min(F.when(~F.col("_good"), F.col(seq))).alias("first_break"), F.max_by("hash", seq).alias("last_hash"))


def heads(spark: SparkSession, path: str) -> DataFrame:
    """(chain, seq, hash): the last record of every chain of a log."""
    log = commits(spark, path)
    since = max((i for i, c in enumerate(log) if c["all_heads"]), default=0)
    folders = [f"{path}/heads/{c['folder']}" for c in log[since:]]
    rows = spark.read.schema(HEAD).parquet(*folders) if folders else spark.createDataFrame([], HEAD)
    return rows.groupBy("chain").agg(F.max(F.struct("seq", "hash")).alias("h")).select("chain", "h.*")


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """(chain, seq, body, prev_hash, hash) of every committed batch."""
    folders = [f"{path}/records/{c['folder']}" for c in commits(spark, path)]
    return spark.read.schema(LOG).json(folders) if folders else spark.createDataFrame([], LOG)


def append(records: DataFrame, path: str, chain: str, order: list[Column], body: Column, batch: str | None = None) -> bool:
    """Appends records to the log at path, in order within their chains, numbered from their chains' last records on; False if the log has a batch of that name already.

    Another writer's batch between the reading of the heads and the commit ends this one with Conflict, and nothing of it is seen.
    A null chain counts as a blank one.
    """
    spark, log = records.sparkSession, commits(records.sparkSession, path)
    if batch is not None and any(c["batch"] == batch for c in log):
        return False
    number, folder = len(log) + 1, f"{len(log) + 1:012d}-{uuid.uuid4().hex[:8]}"
    known = heads(spark, path)
    place = F.row_number().over(Window.partitionBy("chain").orderBy("_order"))
    new = records.select(F.coalesce(F.col(chain).cast("string"), F.lit("")).alias("chain"), F.struct(*order).alias("_order"), body.cast("string").alias("body")).withColumn("_place", place).drop("_order")
    new = new.join(known.select("chain", F.col("seq").alias("_seq"), F.col("hash").alias("_begin")), "chain", "left")
    new = new.withColumn("seq", F.col("_place") + F.coalesce("_seq", F.lit(0)))
    chained(new, "chain", "seq", "body", begin="_begin").write.json(f"{path}/records/{folder}")
    last = spark.read.schema(LOG).json(f"{path}/records/{folder}").groupBy("chain").agg(F.max(F.struct("seq", "hash")).alias("h")).select("chain", "h.*")
    fold = number % FOLD_HEADS == 0
    if fold:
        last = known.join(last.select("chain"), "chain", "left_anti").unionByName(last)
    last.write.parquet(f"{path}/heads/{folder}")
    commit(spark, path, number, {"folder": folder, "batch": batch, "all_heads": fold})
    return True


def append_stream(events: DataFrame, path: str, checkpoint: str, chain: str, order: list[str], body: Column, name: str = "audit") -> StreamingQuery:
    """Appends a stream, batch by batch; a batch that a restart gives again is in the log once. Starts the query; the caller sets no sink."""

    def add(batch: DataFrame, number: int) -> None:
        append(batch, path, chain, [F.col(c) for c in order], body, f"{name}-{number}")

    return events.writeStream.option("checkpointLocation", checkpoint).foreachBatch(add).trigger(availableNow=True).start()
