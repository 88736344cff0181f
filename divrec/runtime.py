"""Session helpers: staging to shared storage, size-checked broadcast, NA handling."""

from __future__ import annotations

import atexit
import sys
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Functions of this package travel to the executors whole, so it needn't be installed there.
cloudpickle.register_pickle_by_value(sys.modules["divrec"])

_STAGED: list[tuple[SparkSession, str]] = []

#: Rows above which a side is never broadcast by ``broadcast_if_small``.
BROADCAST_ROWS = 20_000


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, from ``spark.checkpoint.dir``.

    Only a single-process session (``local[...]``) without the setting gets a
    temporary folder; on a cluster an unset folder is an error.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    master = spark.sparkContext.master
    if not (master == "local" or master.startswith("local[")):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    path = tempfile.mkdtemp(prefix="divrec-")
    spark.conf.set("spark.checkpoint.dir", path)
    return path


def _filesystem(spark: SparkSession, path: str):
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def path_exists(spark: SparkSession, path: str) -> bool:
    fs, p = _filesystem(spark, path)
    return fs.exists(p)


def remove_path(spark: SparkSession, path: str) -> None:
    fs, p = _filesystem(spark, path)
    fs.delete(p, True)


def rename_path(spark: SparkSession, src: str, dst: str) -> None:
    fs, p = _filesystem(spark, src)
    to = spark._jvm.org.apache.hadoop.fs.Path(dst)
    if not fs.exists(to.getParent()):
        fs.mkdirs(to.getParent())
    if not fs.rename(p, to):
        raise OSError(f"cannot rename {src} to {dst}")


def swap_path(spark: SparkSession, new: str, loc: str) -> None:
    """``new`` takes the place of ``loc``; the old folder is deleted only after that."""
    old = f"{loc.rpartition('/')[0]}/_old-{uuid.uuid4().hex}"  # hidden from readers
    if path_exists(spark, loc):
        rename_path(spark, loc, old)
        rename_path(spark, new, loc)
        remove_path(spark, old)
    else:
        rename_path(spark, new, loc)


def copy_path(spark: SparkSession, src: str, dst: str) -> None:
    fs, p = _filesystem(spark, src)
    to = spark._jvm.org.apache.hadoop.fs.Path(dst)
    spark._jvm.org.apache.hadoop.fs.FileUtil.copy(fs, p, to.getFileSystem(spark._jsc.hadoopConfiguration()), to, False, spark._jsc.hadoopConfiguration())


def full_path(spark: SparkSession, path: str) -> str:
    """``path`` with scheme and authority, as the engine names files."""
    fs, p = _filesystem(spark, path)
    return fs.makeQualified(p).toString()


def glob_files(spark: SparkSession, pattern: str) -> list[str]:
    """Paths of the files that match a pattern, in order of their names."""
    fs, p = _filesystem(spark, pattern)
    return sorted(s.getPath().toString() for s in (fs.globStatus(p) or []) if s.isFile())


def list_files(spark: SparkSession, path: str) -> list[tuple[str, int]]:
    """(path, bytes) of the data files directly below ``path`` (names not starting with ``_`` or ``.``)."""
    fs, p = _filesystem(spark, path)
    found = []
    for s in fs.listStatus(p):
        name = s.getPath().getName()
        if s.isFile() and name[0] not in "_.":
            found.append((s.getPath().toString(), s.getLen()))
    return found


def file_totals(spark: SparkSession, path: str) -> tuple[int, int]:
    """(files, bytes) of the data files at any depth below ``path``; listed and added up by the engine, not on the driver."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    row = found.agg(F.count(F.lit(1)), F.sum("length")).first()
    return row[0], row[1] or 0


def sub_folders(spark: SparkSession, path: str) -> list[str]:
    """Names of the folders directly below ``path`` that readers see."""
    fs, p = _filesystem(spark, path)
    names = [s.getPath().getName() for s in fs.listStatus(p) if s.isDirectory()]
    return sorted(n for n in names if not n.startswith(".") and (not n.startswith("_") or "=" in n))


def read_text_file(spark: SparkSession, path: str) -> str | None:
    """A small file as text; None if there is none."""
    fs, p = _filesystem(spark, path)
    if not fs.exists(p):
        return None
    stream = fs.open(p)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def write_text_file(spark: SparkSession, path: str, text: str) -> None:
    fs, p = _filesystem(spark, path)
    out = fs.create(p, True)
    out.write(bytearray(text.encode()))
    out.close()


def stage(df: DataFrame, name: str = "stage") -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Cuts the lineage, survives the loss of executors, and fixes results that
    would differ if they were computed again (range bounds, partition ids).
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _STAGED.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def release_staged(keep: int = 0) -> None:
    """Delete every staged table of this process but the first ``keep``; results that still read one must be written before."""
    while len(_STAGED) > keep:
        spark, path = _STAGED.pop()
        try:
            remove_path(spark, path)
        except Exception:  # the session may be gone
            pass


@contextmanager
def staging() -> Iterator[None]:
    """Tables staged inside are deleted at the end, so that a long session doesn't keep those of finished results."""
    before = len(_STAGED)
    try:
        yield
    finally:
        release_staged(before)


atexit.register(release_staged)


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


def broadcast_if_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if it was counted to hold at most ``rows`` rows, else unchanged."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def clean(df: DataFrame, column: str) -> Column:
    """The column with NaN turned into NULL (both are missing); as double when numeric."""
    kind = df.schema[column].dataType
    c = F.col(f"`{column}`")
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        return F.when(~F.isnan(c), c.cast("double"))
    return c.cast("double")


def require_columns(df: DataFrame, names) -> None:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"no such column: {', '.join(missing)}; there are {', '.join(df.columns)}")


def fresh(df: DataFrame, name: str) -> str:
    """``name``, or ``name`` with underscores appended until no column of ``df`` is called so."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def grouped_pandas(df: DataFrame, key: str, run, schema) -> DataFrame:
    """``applyInPandas`` per ``key`` for frames whose columns may have any name (dots, backticks)."""
    names = list(df.columns)
    at = names.index(key)

    def named(pdf):
        pdf.columns = names
        return run(pdf)

    placed = df.toDF(*[f"c{i}" for i in range(len(names))]).repartition(partitions(df.sparkSession), f"c{at}")  # few bytes may be much work: not merged
    return placed.groupBy(f"c{at}").applyInPandas(named, schema)
