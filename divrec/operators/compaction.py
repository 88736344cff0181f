"""Consolidating far too many small files.

``compact_dataset`` rewrites a folder of small files through the engine's own
split packing: file splits are combined by maximum partition bytes and
file-open cost, every combined split is written as one file without a shuffle,
and the staged output is verified before it takes the target's place.

``plan_compaction`` makes the same packing for connections of which only file
listings are at hand, so that every live pair is held exactly once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from divrec.operators.scan import ordered_scan
from divrec.runtime import copy_path, file_totals, full_path, list_files, path_exists, remove_path, require_columns, swap_path

MIB = 1 << 20
#: Size aimed at for a written file, and what opening one file is held to cost: far below the engine's 4 MiB, with which
#: a combined split of tiny files would hold few bytes and the written files would be small again.
TARGET_BYTES, OPEN_COST = 128 * MIB, 4096


def plain_location(loc: Column) -> Column:
    """A location without scheme and authority, repeated or trailing slashes and ``.`` steps."""
    bare = F.regexp_replace(loc, r"^[A-Za-z][A-Za-z0-9+.\-]*:(//[^/]*)?", "")
    bare = F.regexp_replace(bare, r"/{2,}", "/")
    bare = F.regexp_replace(bare, r"(/\.)+(?=/|$)", "")
    bare = F.regexp_replace(bare, r"^(\./)+", "")
    bare = F.regexp_replace(bare, r"(?<=.)/$", "")
    return F.when(bare == "", "/").otherwise(bare)


def live_data_files(listings: DataFrame) -> DataFrame:
    """One row per live data file: ``loc, file_name, size_bytes, n_pairs, first_pair``.

    Of the listings of one file (same plain location and name) the latest
    ``listed_at`` holds, of equally late ones that with the greatest
    ``listing_id``. A file is live unless that listing says ``removed`` (NULL:
    not removed), and holds data if no step of its name begins with ``_`` or
    ``.``. Listings without location or name are no files. Repeated listings,
    other columns and an empty table do no harm.
    """
    require_columns(listings, ["conn_loc", "file_name", "size_bytes", "n_pairs", "first_pair", "removed", "listed_at", "listing_id"])
    rows = listings.where(F.col("conn_loc").isNotNull() & F.col("file_name").isNotNull() & ~F.col("file_name").rlike(r"(^|/)[_.]"))
    # The aggregation combines map-side, so a location with a third of all listings is no hot task: the key holds the file name.
    newest = rows.groupBy(plain_location(F.col("conn_loc")).alias("loc"), "file_name").agg(
        F.max_by(F.struct("size_bytes", "n_pairs", "first_pair", "removed"), F.struct("listed_at", "listing_id")).alias("_s")
    )
    live = newest.where(~F.coalesce(F.col("_s.removed"), F.lit(False)))
    return live.select("loc", "file_name", "_s.size_bytes", F.col("_s.n_pairs").cast("bigint").alias("n_pairs"), "_s.first_pair")


def own_pairs(files: DataFrame) -> DataFrame:
    """``files`` with the pairs each file is to be read for, so that every pair is read once.

    Pairs are ranges ``first_pair .. first_pair + n_pairs - 1``. In order of
    first pair (longer range first, then name) a file owns what no earlier one
    holds: ``own_first``, ``own_pairs`` (0 if all are held already, or the file
    is empty, or its range is unknown). A running maximum by distributed sort
    does it, so one location with most of the files is spread over the cluster.
    """
    n = F.greatest(F.coalesce(F.col("n_pairs"), F.lit(0)), F.lit(0))
    n = F.when(F.col("first_pair").isNull(), 0).otherwise(n)
    ranged = files.withColumn("_len", n).withColumn("_neg", -F.col("_len"))
    ranged = ranged.withColumn("_end", F.when(F.col("_len") > 0, F.col("first_pair") + F.col("_len") - 1))
    seen = ordered_scan(ranged, ["loc"], ["first_pair", "_neg", "file_name"], maxes={"_seen": "_end"})
    start = F.greatest(F.col("first_pair"), F.col("_seen_before") + 1)
    owned = F.when(F.col("_len") > 0, F.greatest(F.col("_end") - start + 1, F.lit(0))).otherwise(0).cast("bigint")
    return seen.select(*files.columns, start.alias("own_first"), owned.alias("own_pairs"))


def pack_files(files: DataFrame, target_bytes: int = TARGET_BYTES, open_cost: int = OPEN_COST, every_file: bool = False) -> DataFrame:
    """Assign each owned file part to an output file: ``out_file`` from 0 per location, and ``own_bytes``.

    Parts are taken in pair order; each costs its bytes plus ``open_cost``, as
    the engine reckons when it packs splits, and a new output file begins
    whenever the running cost passes a multiple of ``target_bytes``: an output
    file holds at most ``target_bytes`` and one part more. An unknown size
    counts as the open cost alone. With ``every_file`` the result has all
    files: one whose range of pairs is unknown is taken over whole (nothing
    that it may hold is lost), and one that holds no pairs of its own has
    ``out_file`` NULL.
    """
    blind = F.col("first_pair").isNull() | F.col("n_pairs").isNull()
    taken = (F.col("own_pairs") > 0) | blind if every_file else F.col("own_pairs") > 0
    share = F.when(F.col("own_pairs") > 0, F.round(F.col("size_bytes") * F.col("own_pairs") / F.col("n_pairs")).cast("bigint")).otherwise(F.when(blind, F.col("size_bytes")))
    parts = (files if every_file else files.where(taken)).withColumn("own_bytes", share)
    parts = parts.withColumn("_cost", F.when(taken, F.coalesce(F.col("own_bytes"), F.lit(0)) + F.lit(open_cost)).otherwise(0).cast("bigint"))
    run = ordered_scan(parts, ["loc"], ["own_first", "file_name"], sums={"_run": "_cost"})
    out = F.when(taken, F.floor((F.col("_run") - F.col("_cost")) / F.lit(target_bytes)).cast("bigint"))
    return run.select(*files.columns, "own_bytes", out.alias("out_file"))


def plan_compaction(conns: DataFrame, listings: DataFrame, target_bytes: int = TARGET_BYTES, open_cost: int = OPEN_COST) -> DataFrame:
    """The compaction plan, one row per connection.

    ``conn_id, loc, nfile`` (live data files), ``totstoragesize`` (their known
    bytes), ``n_known`` (files of known size), ``mean_size`` (NULL if none),
    ``n_pairs`` (distinct live pairs), ``copied_pairs`` (pairs the plan reads:
    equal to ``n_pairs``), ``out_nfile``, ``out_totstoragesize``, ``out_max``
    (largest output file). A connection without live files has zeros. All
    figures, those of the files as they are too, are added up over the packed
    output files, in which every live file has its place (files that hold no
    pair of their own: the place NULL).
    """
    packed = pack_files(own_pairs(live_data_files(listings)), target_bytes, open_cost, every_file=True)
    # Two steps, so that a location with most of the files is combined before it is one row.
    outs = packed.groupBy("loc", "out_file").agg(
        F.sum("own_bytes").alias("_b"), F.sum("own_pairs").alias("_p"), F.count(F.lit(1)).alias("_f"), F.sum("size_bytes").alias("_s"), F.count("size_bytes").alias("_k")
    )
    placed = F.col("out_file").isNotNull()
    after = outs.groupBy("loc").agg(
        F.sum("_f").alias("nfile"), F.sum("_s").alias("totstoragesize"), F.sum("_k").alias("n_known"), F.sum("_p").alias("n_pairs"),
        F.count("out_file").alias("out_nfile"), F.sum(F.when(placed, F.col("_b"))).alias("out_totstoragesize"), F.max(F.when(placed, F.col("_b"))).alias("out_max"),
        F.sum(F.when(placed, F.col("_p"))).alias("copied_pairs"),
    )
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("bigint").alias(c)
    known = conns.select("conn_id", plain_location(F.col("loc")).alias("loc"))
    joined = known.join(after, "loc", "left")
    return joined.select(
        "conn_id", "loc", zero("nfile"), zero("totstoragesize"), zero("n_known"),
        (F.col("totstoragesize") / F.nullif(F.col("n_known"), F.lit(0))).alias("mean_size"),
        *[zero(c) for c in ("n_pairs", "copied_pairs", "out_nfile", "out_totstoragesize", "out_max")],
    )


def _fingerprint(df: DataFrame) -> list[Column]:
    each = F.xxhash64(*[F.to_json(F.struct(F.col(f"`{c}`"))) if "map<" in t else F.col(f"`{c}`") for c, t in df.dtypes]) if df.columns else F.lit(0)
    return [F.count(F.lit(1)).alias("n"), F.sum(each.cast("decimal(38,0)")).alias("sum")]


def fingerprint(df: DataFrame) -> tuple[int, int]:
    """Row count and an order-free checksum over all columns."""
    row = df.agg(*_fingerprint(df)).first()
    return row[0], int(row[1] or 0)


def _folders(spark: SparkSession, src: str, fmt: str) -> list[tuple[str, int, int, list[str]]]:
    """(folder below ``src``, files, bytes, paths to read) of every folder that holds data files.

    Files are listed and added up by the engine's tasks; one row a folder comes
    to the driver. Only of a folder that has sub-folders beside its files the
    files are named one by one.
    """
    root = full_path(spark, src).rstrip("/")
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(src)
    at = F.regexp_replace("path", "/[^/]*$", "")
    rows = sorted((r["at"], r["n"], r["b"]) for r in listed.groupBy(at.alias("at")).agg(F.count(F.lit(1)).alias("n"), F.sum("length").alias("b")).collect())
    out = []
    for folder, n, b in rows:
        mixed = any(other != folder and other.startswith(f"{folder}/") for other, _, _ in rows)
        paths = [r["path"] for r in listed.where(at == folder).select("path").collect()] if mixed else [folder]
        out.append((folder[len(root) :].strip("/"), n, b, paths))
    return out


def compact_dataset(
    spark: SparkSession,
    src: str,
    dst: str,
    *,
    fmt: str = "parquet",
    target_bytes: int = TARGET_BYTES,
    open_cost: int = OPEN_COST,
    overwrite: bool = False,
    at_once: int = 8,
) -> dict:
    """Rewrite the files of ``src`` as fewer, well-sized files of ``dst``; returns what was done.

    Every folder of ``src`` that holds files (a bin or partition folder, say)
    becomes the same folder of ``dst``, so the layout is kept; ``at_once``
    folders are worked on at a time. The number of output files is that of the
    engine's combined splits: one write task each, no shuffle. Output goes to
    ``<dst>_staging`` first and takes the place of ``dst`` only if row count
    and checksum of every folder equal those of its source, which are taken
    while it is copied; otherwise it is deleted and an error raised. Metadata
    of a kept collection goes with it. An empty source gives an empty dataset
    with the same schema.
    """
    from concurrent.futures import ThreadPoolExecutor

    from pyspark.sql import Observation

    if path_exists(spark, dst) and not overwrite:
        raise FileExistsError(f"{dst} exists; backing out")
    folders = _folders(spark, src, fmt)
    conf = {
        "spark.sql.files.maxPartitionBytes": str(max(1, target_bytes)),
        "spark.sql.files.openCostInBytes": str(open_cost),
        "spark.sql.files.minPartitionNum": "1",
    }
    kept = {k: spark.conf.get(k, None) for k in conf}
    staging = f"{dst.rstrip('/')}_staging"
    if path_exists(spark, staging):
        remove_path(spark, staging)

    def copy(folder: tuple[str, int, int, list[str]]) -> int:
        name, _, _, paths = folder
        data = spark.read.format(fmt).load(paths)
        seen = Observation()
        to = f"{staging}/{name}".rstrip("/")
        data.observe(seen, *_fingerprint(data)).write.mode("append").format(fmt).save(to)
        source = seen.get["n"], int(seen.get["sum"] or 0)
        # a folder with sub-folders is read file by file again
        written = fingerprint(spark.read.schema(data.schema).format(fmt).option("recursiveFileLookup", str(len(paths) == 1).lower()).load(to if len(paths) == 1 else [f for f, _ in list_files(spark, to)]))
        if source != written:
            raise RuntimeError(f"staged output differs from {src}/{name}: {written} against {source}")
        return written[0]

    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        with ThreadPoolExecutor(max(1, min(at_once, len(folders)))) as pool:
            rows = sum(pool.map(copy, folders))
    except Exception:
        if path_exists(spark, staging):
            remove_path(spark, staging)
        raise
    finally:
        for k, v in kept.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    if path_exists(spark, f"{src}/_meta"):
        copy_path(spark, f"{src}/_meta", f"{staging}/_meta")
    after = file_totals(spark, staging)
    swap_path(spark, staging, dst.rstrip("/"))
    return {"nfile": sum(n for _, n, _, _ in folders), "totstoragesize": sum(b for _, _, b, _ in folders), "out_nfile": after[0], "out_totstoragesize": after[1], "rows": rows, "folders": len(folders)}
