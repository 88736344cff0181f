"""Collections kept in folders: writing, adding and removing pairs, metadata, conversion, overwrite policy."""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence
from dataclasses import replace
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from divrec.operators.division import KEY, Division
from divrec.runtime import file_totals, path_exists, read_text_file, remove_path, rename_path, stage, swap_path, write_text_file

BIN = "_bin"


class DiskConnection:
    """A folder of Parquet files (local, ``hdfs://``, or any Hadoop file system) with metadata in ``_meta``.

    ``n_bins`` > 0 lays pairs out in that many hash folders of the key, so that
    a look-up by key reads one of them. The number of bins is kept with the
    collection, so whoever opens it need not know it. The folder may be moved:
    no path is stored in it. What replaces rows is written beside the folder
    and then takes its place, so a crash leaves the old rows or the new ones.
    """

    def __init__(self, loc: str, n_bins: int = 0):
        self.loc, self.n_bins = loc.rstrip("/"), n_bins

    def __repr__(self) -> str:
        return f"connection: {self.loc}" + (f", {self.n_bins} bins" if self.n_bins else "")

    def check_output(self, spark: SparkSession, overwrite: bool | str) -> None:
        """False: an existing folder is an error. True: it will be replaced; ``backup``: it will be renamed to ``<loc>_bak``."""
        if overwrite is not True and overwrite != "backup" and path_exists(spark, self.loc):
            raise FileExistsError(f"{self.loc} exists; backing out")

    # -- bins --------------------------------------------------------------------------------------------------------
    def bins(self, spark: SparkSession) -> int:
        """The number of bins the kept collection is laid out in; that of this object while there is none."""
        text = read_text_file(spark, f"{self.loc}/_meta/layout.json")
        return json.loads(text)["n_bins"] if text else self.n_bins

    def _binned(self, df: DataFrame, n: int) -> DataFrame:
        return df.withColumn(BIN, key_bin(F.col(KEY), n)) if n and KEY in df.columns else df

    def _put(self, df: DataFrame, at: str, n: int, mode: str) -> None:
        out = self._binned(df, n)
        writer = out.write.mode(mode)
        (writer.partitionBy(BIN) if BIN in out.columns else writer).parquet(at)
        if mode != "append":
            write_text_file(df.sparkSession, f"{at}/_meta/layout.json", json.dumps({"n_bins": n if BIN in out.columns else 0}))

    # -- rows --------------------------------------------------------------------------------------------------------
    def write(self, df: DataFrame, overwrite: bool | str = False, mode: str = "errorifexists", attrs: dict | None = None) -> DataFrame:
        """Keep ``df``, with attributes; ``mode`` ``append`` adds rows to what is there."""
        spark = df.sparkSession
        if mode == "append":
            self._put(df, self.loc, self.bins(spark), mode)
            return self.read(spark)
        self.check_output(spark, overwrite)
        new = f"{self.loc}_new-{uuid.uuid4().hex}"
        self._put(df, new, self.n_bins, "errorifexists")
        if attrs:
            _save_attributes(spark, new, attrs)
        if overwrite == "backup" and path_exists(spark, self.loc):
            if path_exists(spark, f"{self.loc}_bak"):
                remove_path(spark, f"{self.loc}_bak")
            rename_path(spark, self.loc, f"{self.loc}_bak")
        swap_path(spark, new, self.loc)
        return self.read(spark)

    def read(self, spark: SparkSession) -> DataFrame:
        df = spark.read.parquet(self.loc)
        return df.drop(BIN)

    def read_key(self, spark: SparkSession, key: Any) -> DataFrame:
        """The rows of one key; with bins only its folder is read. The key may be of any type that casts to that of the keys."""
        df = spark.read.parquet(self.loc)
        wanted = F.lit(key).cast(df.schema[KEY].dataType)
        if BIN in df.columns:
            df = df.where(F.col(BIN) == key_bin(wanted, self.bins(spark)))
        return df.where(F.col(KEY).eqNullSafe(wanted)).drop(BIN)

    def _rewrite(self, spark: SparkSession, rows: DataFrame, touched: list[int] | None) -> None:
        """Put ``rows`` in the place of all rows, or of those of some bins; attributes stay where they are."""
        new = f"{self.loc}_new-{uuid.uuid4().hex}"
        n = self.bins(spark)
        self._put(rows, new, n, "errorifexists")
        if touched is None:
            attrs = self.load_attributes(spark)
            if attrs:
                _save_attributes(spark, new, attrs)
            swap_path(spark, new, self.loc)
            return
        for b in touched:  # at most the number of bins
            here, there = f"{new}/{BIN}={b}", f"{self.loc}/{BIN}={b}"
            if path_exists(spark, here):
                swap_path(spark, here, there)
            elif path_exists(spark, there):
                remove_path(spark, there)
        remove_path(spark, new)

    def touched(self, spark: SparkSession, keys: DataFrame) -> list[int] | None:
        """The bins of some keys; None where the collection has no bins."""
        n = self.bins(spark)
        return [r[0] for r in keys.select(key_bin(F.col(KEY), n)).distinct().collect()] if n else None

    # -- attributes ---------------------------------------------------------------------------------------------------
    def save_attributes(self, spark: SparkSession, attrs: dict) -> None:
        _save_attributes(spark, self.loc, attrs)

    def load_attributes(self, spark: SparkSession) -> dict:
        text = read_text_file(spark, f"{self.loc}/_meta/attrs.json")
        return json.loads(text) if text else {}

    def changed(self, spark: SparkSession, rows: int | None, keys: int | None) -> None:
        """Carry the attributes over a change by so many rows and keys (None: not known); what can't be carried over is dropped."""
        old = self.load_attributes(spark)
        if not old:
            return
        new = {k: old[k] for k in ("split_cols", "is_ddo", "vars", *(k for k in old if k not in DERIVED)) if k in old}
        for name, by in (("nRow", rows), ("nDiv", keys)):
            if by is not None and old.get(name) is not None:
                new[name] = old[name] + by
        new["totStorageSize"] = file_totals(spark, self.loc)[1]
        self.save_attributes(spark, new)


#: Attributes that follow from the rows.
DERIVED = ("nRow", "nDiv", "splitRowDistn", "splitSizeDistn", "totObjectSize", "totStorageSize", "summary", "keys")


def key_bin(key: Column, n: int) -> Column:
    """The bin of a key, by its text: the same whatever the type it comes in."""
    return F.pmod(F.hash(key.cast("string")), F.lit(n))


def _save_attributes(spark: SparkSession, loc: str, attrs: dict) -> None:
    plain = {k: v for k, v in attrs.items() if isinstance(v, (str, int, float, bool, list, dict, type(None)))}
    write_text_file(spark, f"{loc}/_meta/attrs.json", json.dumps(plain, default=str))


def local_disk_conn(loc: str, n_bins: int = 0) -> DiskConnection:
    return DiskConnection(loc, n_bins)


def hdfs_conn(loc: str, n_bins: int = 0) -> DiskConnection:
    return DiskConnection(loc if "://" in loc else f"hdfs://{loc}", n_bins)


def char_to_output(out: str | DiskConnection | None) -> DiskConnection | None:
    """A path stands for a connection of the usual kind."""
    return DiskConnection(out) if isinstance(out, str) else out


def open_division(spark: SparkSession, conn: DiskConnection | str, split_cols: Sequence[str] = ()) -> Division:
    """A kept collection with its saved attributes."""
    c = char_to_output(conn)
    attrs = c.load_attributes(spark)
    return Division(c.read(spark), tuple(attrs.get("split_cols", split_cols)), attrs=attrs, is_ddo=bool(attrs.get("is_ddo")))


def convert(div: Division, to: DiskConnection | str | None, overwrite: bool | str = False) -> Division:
    """Move a collection to a folder, or (None) to the session's cache; the needed attributes go with it."""
    if to is None:
        return replace(div, df=div.rows().cache(), transforms=(), schema=None)
    c = char_to_output(to)
    spark = div.df.sparkSession
    attrs = {**div.attrs, "split_cols": list(div.split_cols), "is_ddo": div.is_ddo}
    kept = c.write(div.rows(), overwrite, attrs=attrs)
    attrs["totStorageSize"] = file_totals(spark, c.loc)[1] or None
    c.save_attributes(spark, attrs)
    return replace(div, df=kept, transforms=(), schema=None, attrs=attrs)


def add_data(spark: SparkSession, conn: DiskConnection, data: DataFrame, overwrite: bool = False) -> int:
    """Add rows of pairs; pairs whose key is there already are passed over, or replaced with ``overwrite``. Returns rows added.

    Of a collection with bins only the bins of replaced keys are written again.
    A missing key is a key. Attributes are kept up to date: those that can't be
    carried over (distributions, summaries) are dropped.
    """
    if not path_exists(spark, conn.loc):
        data = stage(data, "add")
        conn.write(data)
        return data.count()
    old = conn.read(spark)
    new = stage(data, "add")  # the folder may be read by ``data``, and rows must not change between the steps
    same = lambda a, b: a[KEY].eqNullSafe(b["_there"])
    if overwrite:
        keys = new.select(F.col(KEY).alias("_there")).distinct()
        gone = old.join(keys, same(old, keys), "left_semi").agg(F.count(F.lit(1)), F.count_distinct(KEY), F.max(F.col(KEY).isNull().cast("int"))).first()
        bins = conn.touched(spark, new)
        part = old if bins is None else spark.read.parquet(conn.loc).where(F.col(BIN).isin(bins)).drop(BIN)
        kept = part.join(keys, same(part, keys), "left_anti").select(*part.columns)
        n, n_keys = new.count(), keys.count()
        conn._rewrite(spark, stage(kept.unionByName(new), "add"), bins)
        conn.changed(spark, n - gone[0], n_keys - gone[1] - (gone[2] or 0))
        return n
    known = old.select(F.col(KEY).alias("_there")).distinct()
    fresh = stage(new.join(known, same(new, known), "left_anti").select(*new.columns), "add")
    n, n_keys = fresh.count(), fresh.select(KEY).distinct().count()
    if n:
        conn.write(fresh, mode="append")
        conn.changed(spark, n, n_keys)
    return n


def remove_data(spark: SparkSession, conn: DiskConnection, keys: Sequence) -> int:
    """Remove the pairs of some keys; returns how many keys there were. Attributes are kept up to date."""
    old = conn.read(spark)
    kind = old.schema[KEY].dataType
    wanted = spark.createDataFrame([(None if k is None else str(k),) for k in keys], "_k string").select(F.col("_k").cast(kind).alias("_there")).distinct()
    same = lambda a: a[KEY].eqNullSafe(wanted["_there"])
    found = old.join(F.broadcast(wanted), same(old), "left_semi").groupBy(KEY).count().agg(F.count(F.lit(1)), F.sum("count")).first()  # keys: as many as the caller gave
    if found[0]:
        bins = conn.touched(spark, wanted.withColumnRenamed("_there", KEY))
        part = old if bins is None else spark.read.parquet(conn.loc).where(F.col(BIN).isin(bins)).drop(BIN)
        conn._rewrite(spark, stage(part.join(F.broadcast(wanted), same(part), "left_anti").select(*part.columns), "remove"), bins)
        conn.changed(spark, -found[1], -found[0])
    return found[0]


def make_extractable(div: Division, conn: DiskConnection | str, overwrite: bool | str = False) -> Division:
    """Rewrite a collection ordered by key, so that a look-up reads few row groups; its attributes go with it."""
    c = char_to_output(conn)
    rows = div.rows()
    attrs = {**div.attrs, "split_cols": list(div.split_cols), "is_ddo": div.is_ddo}
    return replace(div, df=c.write(rows.repartitionByRange(KEY).sortWithinPartitions(KEY), overwrite, attrs=attrs), transforms=(), schema=None)
