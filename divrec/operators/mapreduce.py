"""A small map/reduce interface over pairs, for what the other verbs can't express.

Map sees the pairs of one subset at a time; what it collects may be combined
per key in the same task; then it is shuffled by key; reduce sees the values of
a key in blocks (``pre``, then ``reduce`` for every block, then ``post``), so no
key has to fit in memory. Every phase may collect pairs and count.
"""

from __future__ import annotations

import inspect
import pickle
from collections.abc import Callable, Iterator, Mapping, Sequence
from contextlib import contextmanager
from dataclasses import dataclass
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from divrec.operators.division import KEY, VALUE, Division, Pair, _frame, _freeze
from divrec.runtime import grouped_pandas, stage

BLOCK = 10_000
PAIRS = "src string, k string, v binary, counter bigint"


@dataclass(frozen=True)
class Reduce:
    """``pre(key) -> state``; ``reduce(state, key, values) -> state`` for each block; ``post(state, key, collect)``.

    Each may take two more parameters, ``collect`` and ``counter`` (``post``:
    one, ``counter``), and use them as map does. ``combine(key, values) ->
    values`` runs in the map tasks on what was collected for a key there, so
    that a hot key sends few values; reduce must give the same for combined
    values.
    """

    reduce: Callable[..., Any]
    post: Callable[..., None]
    pre: Callable[..., Any] = lambda key: None
    combine: Callable[[Any, list], list] | None = None


@dataclass(frozen=True)
class Control:
    """Sizes of the work's parts, as settings of the engine while a job runs; None leaves a setting as it is.

    ``map_bytes``: input of a map task; ``reduce_bytes``: shuffled bytes of a
    reduce task; ``partitions``: reduce tasks before they are merged;
    ``batch_rows``: rows given to Python at a time; ``conf``: any other setting.
    """

    map_bytes: int | None = None
    reduce_bytes: int | None = None
    partitions: int | None = None
    batch_rows: int | None = None
    conf: Mapping[str, str] | None = None

    def settings(self) -> dict[str, str]:
        named = {
            "spark.sql.files.maxPartitionBytes": self.map_bytes,
            "spark.sql.adaptive.advisoryPartitionSizeInBytes": self.reduce_bytes,
            "spark.sql.shuffle.partitions": self.partitions,
            "spark.sql.execution.arrow.maxRecordsPerBatch": self.batch_rows,
        }
        return {**{k: str(v) for k, v in named.items() if v is not None}, **dict(self.conf or {})}


_DEFAULT = Control()


def default_control(new: Control | None = None) -> Control:
    """The control of jobs that are given none; ``new`` replaces it for the session."""
    global _DEFAULT
    if new is not None:
        _DEFAULT = new
    return _DEFAULT


@contextmanager
def controlled(spark: SparkSession, control: Control | None) -> Iterator[None]:
    """The settings of ``control`` for a while."""
    wanted = (control or _DEFAULT).settings()
    before = {k: spark.conf.get(k, None) for k in wanted}
    try:
        for k, v in wanted.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def _identity_map(keys: Sequence, values: Sequence, collect: Callable, counter: Callable, source: str) -> None:
    for k, v in zip(keys, values):
        collect(k, v)


class _Counters(dict):
    def __call__(self, group: str, name: str, n: int = 1) -> None:
        self[(group, name)] = self.get((group, name), 0) + n


def source_names(sources: Sequence[Division] | Mapping[str, Division] | Division) -> dict[str, Division]:
    """Names of the sources: as given, or dataSource1..; those that lack one among named ones (None or empty) are unnamedDataSource1..

    Sources may also be (name, division) pairs. Names must differ.
    """
    if isinstance(sources, Division):
        sources = [sources]
    if isinstance(sources, Mapping):
        pairs = list(sources.items())
    elif any(isinstance(s, tuple) for s in sources):
        pairs = [s if isinstance(s, tuple) else (None, s) for s in sources]
    else:
        pairs = [(f"dataSource{i}", s) for i, s in enumerate(sources, 1)]
    unnamed, out = 0, {}
    for name, div in pairs:
        if not name:
            unnamed += 1
            name = f"unnamedDataSource{unnamed}"
        if name in out:
            raise ValueError("data sources must all have unique names")
        if not isinstance(div, Division):
            raise TypeError(f"{name} is no division but {type(div).__name__}")
        out[name] = div
    return out


def mr_exec(
    sources: Sequence[Division] | Mapping[str, Division] | Division,
    map: Callable | None = None,  # noqa: A002
    reduce: Reduce | None = None,
    schema: str | T.StructType | None = None,
    control: Control | None = None,
    setup: Callable[[], None] | None = None,
    output: str | None = None,
    overwrite: bool | str = False,
) -> Division:
    """Run map and reduce over one or more divisions.

    ``map(keys, values, collect, counter, source)`` gets lists of one subset's
    key and value (a frame, or the value of a ddo); without it pairs pass
    unchanged. Without ``reduce`` what map collects is the result. ``schema``
    gives the columns of the collected values (frames, dicts, or one column
    ``value``); without it the first collected pair gives them. Counters are
    read with ``counters``. Keys are text in the result. ``setup`` runs before
    the functions wherever they run; ``control`` sizes the tasks; ``output``
    keeps the result in a folder.
    """
    parts, begin, red = [], _freeze(setup) if setup else None, _freeze_reduce(reduce) if reduce else None
    named = source_names(sources)
    spark = next(iter(named.values())).df.sparkSession
    with controlled(spark, control):
        for name, div in named.items():
            parts.append(_mapped(div, _freeze(map or _identity_map), name, begin, red.combine if red else None))
        all_of = parts[0]
        for p in parts[1:]:
            all_of = all_of.unionByName(p)
        pairs = stage(all_of, "pairs")
        counted = pairs.where(F.col("counter").isNotNull())
        work = pairs.where(F.col("counter").isNull()).select("k", "v")
        if red is not None:
            work = stage(work.repartition("k").sortWithinPartitions("k").mapInPandas(_reducer(red, begin), PAIRS), "reduced")
            counted = counted.unionByName(work.where(F.col("counter").isNotNull()))
            work = work.where(F.col("counter").isNull()).select("k", "v")
    if schema is None:
        first = work.limit(1).collect()
        if not first:
            raise ValueError("nothing was collected to infer the result from; give schema=")
        kind = spark.createDataFrame(_frame(Pair("", pickle.loads(first[0]["v"])), {})).schema
    else:
        fields = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
        kind = T.StructType([T.StructField(KEY, T.StringType()), *fields.fields])

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for k, v in zip(pdf["k"], pdf["v"]):
                yield _frame(Pair(k, pickle.loads(v)), {}, kind.names)

    totals = counted.groupBy("src", "k").agg(F.sum("counter").alias("n"))
    table = work.mapInPandas(rows, kind)
    if output is not None:
        from divrec.sources.connections import DiskConnection

        table = DiskConnection(output).write(table, overwrite)
    return Division(table, attrs={"counters": totals}, is_ddo=kind.names == [KEY, VALUE])


def counters(div: Division) -> DataFrame:
    """``group, field, n`` of a map/reduce result."""
    return div.attrs["counters"].select(F.col("src").alias("group"), F.col("k").alias("field"), "n")


def _pairs_frame(collected: list, counts: _Counters) -> pd.DataFrame:
    rows = [(None, str(k), pickle.dumps(v), None) for k, v in collected] + [(g, f, None, n) for (g, f), n in counts.items()]
    return pd.DataFrame(rows, columns=["src", "k", "v", "counter"]).astype({"counter": "Int64"})


def _mapped(div: Division, fn: Callable, name: str, begin: Callable | None, combine: Callable | None) -> DataFrame:
    rows, split, is_ddo = div.rows(), list(div.split_cols), div.is_ddo

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        if begin is not None:
            begin()
        out, counts = [], _Counters()
        key = pdf[KEY].iloc[0]
        values = list(pdf[VALUE]) if is_ddo else [pdf.drop(columns=[KEY, *split]).reset_index(drop=True)]
        fn([key] * len(values), values, lambda k, v: out.append((k, v)), counts, name)
        if combine is not None:
            by: dict = {}
            for k, v in out:
                by.setdefault(str(k), []).append(v)
            out = [(k, v) for k, vs in by.items() for v in combine(k, vs)]
        return _pairs_frame(out, counts)

    return grouped_pandas(rows, KEY, run, PAIRS)


def _freeze_reduce(r: Reduce) -> Reduce:
    return Reduce(_freeze(r.reduce), _freeze(r.post), _freeze(r.pre), _freeze(r.combine) if r.combine else None)


def _with_hands(fn: Callable, least: int, *hands: Any) -> Callable:
    """``fn``, given as many of ``hands`` (collect, counter) as it has parameters beyond ``least``."""
    params = [p for p in inspect.signature(fn).parameters.values() if p.kind in (p.POSITIONAL_ONLY, p.POSITIONAL_OR_KEYWORD)]
    more = hands[: max(0, len(params) - least)]
    return lambda *args: fn(*args, *more)


def _reducer(r: Reduce, begin: Callable | None = None) -> Callable:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        if begin is not None:
            begin()
        key, state, open_ = None, None, False
        out: list = []
        counts = _Counters()
        collect = lambda k, v: out.append((k, v))
        pre, step = _with_hands(r.pre, 1, collect, counts), _with_hands(r.reduce, 3, collect, counts)
        post = _with_hands(r.post, 2, collect, counts)
        for pdf in batches:
            for k, group in pdf.groupby("k", sort=False, dropna=False):
                if not open_ or k != key:
                    if open_:
                        post(state, key)
                    key, state, open_ = k, pre(k), True
                values = [pickle.loads(v) for v in group["v"]]
                for i in range(0, len(values), BLOCK):
                    state = step(state, k, values[i : i + BLOCK])
            if out:
                yield _pairs_frame(out, _Counters())
                out.clear()
        if open_:
            post(state, key)
        if out or counts:
            yield _pairs_frame(out, counts)

    return run
