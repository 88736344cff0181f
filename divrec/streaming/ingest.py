"""Appending to kept collections from a stream of files."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from divrec.functions.keys import condition_key
from divrec.operators.division import KEY
from divrec.runtime import glob_files, path_exists, read_text_file, remove_path, rename_path, sub_folders, write_text_file
from divrec.sources.connections import BIN, DiskConnection


def ingest_files(
    spark: SparkSession,
    source: str,
    conn: DiskConnection,
    schema: T.StructType,
    by: list[str],
    *,
    checkpoint: str,
    fmt: str = "parquet",
    pre: Callable[[DataFrame], DataFrame] | None = None,
    files_per_batch: int = 1000,
) -> None:
    """Add the files of a folder that weren't read yet to a collection divided by ``by``, each exactly once.

    Runs until no file is left; call it again for later files. What was read is
    kept in ``checkpoint``. Rows are added to those kept already, in the
    collection's bins. A batch is written beside the collection and moved in
    under names of its own; a batch that is run again after a crash takes its
    earlier files away first, and one that was finished is passed over, so a
    restart neither loses nor doubles rows. The saved attributes are brought
    up to date (the number of rows; others that follow from the rows are
    dropped).
    """
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).format(fmt).load(source)
    stream = pre(stream) if pre else stream
    keyed = stream.withColumn(KEY, condition_key(stream, by))
    name = read_text_file(spark, f"{checkpoint}/divrec-stream")
    if name is None:  # one name for all runs with this checkpoint
        name = uuid.uuid4().hex
        write_text_file(spark, f"{checkpoint}/divrec-stream", name)
    added = []

    def take(batch: DataFrame, number: int) -> None:
        added.append(add_batch(batch, conn, f"{name}-{number}"))

    keyed.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    if any(added):
        conn.changed(spark, sum(added), None)


def add_batch(batch: DataFrame, conn: DiskConnection, batch_id: str) -> int:
    """Append ``batch`` once, whatever number of times it is called with this id; returns rows added by this call."""
    spark = batch.sparkSession
    marker = f"{conn.loc}/_meta/batches/{batch_id}"
    if read_text_file(spark, marker) is not None:
        return 0
    staged = f"{conn.loc}_batch-{batch_id}"
    if path_exists(spark, staged):
        remove_path(spark, staged)
    for f in [*glob_files(spark, f"{conn.loc}/batch-{batch_id}-*"), *glob_files(spark, f"{conn.loc}/{BIN}=*/batch-{batch_id}-*")]:
        remove_path(spark, f)  # of a run that crashed while it moved them
    conn._put(batch, staged, conn.bins(spark), "errorifexists")
    n = spark.read.schema(batch.schema).parquet(staged).count()
    layout = f"{conn.loc}/_meta/layout.json"
    if read_text_file(spark, layout) is None and not path_exists(spark, conn.loc):
        write_text_file(spark, layout, read_text_file(spark, f"{staged}/_meta/layout.json"))
    for folder in ["", *(f"/{x}" for x in sub_folders(spark, staged))]:
        for i, f in enumerate(glob_files(spark, f"{staged}{folder}/part-*")):  # as many as the batch's write tasks
            rename_path(spark, f, f"{conn.loc}{folder}/batch-{batch_id}-{i}.parquet")
    remove_path(spark, staged)
    write_text_file(spark, marker, str(n))
    return n
