"""Divisions: a table split into subsets, methods deferred on each, and the pieces' metadata.

A division is an ordinary DataFrame with a key column and, hidden from its
names, the columns it was split by. Column expressions stay in the plan, so
Catalyst sees them; opaque Python functions are deferred, and consecutive ones
run fused in one grouped map.
"""

from __future__ import annotations

import datetime
import hashlib
import inspect
import pickle
import warnings
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field, replace
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from divrec.functions.keys import bucket, condition_key, fraction, row_identity
from divrec.operators.scan import row_numbers
from divrec.runtime import broadcast_if_small, grouped_pandas, require_columns

KEY = "_key"
VALUE = "value"


@dataclass(frozen=True)
class CondDiv:
    """Every combination of the variables' values is a subset."""

    vars: tuple[str, ...]

    def __repr__(self) -> str:
        return f"conditioning on {', '.join(self.vars)}"


@dataclass(frozen=True)
class RandomDiv:
    """Random subsets of about ``nrows`` rows. ``identity``: columns that tell rows apart (default: all, repeated rows numbered)."""

    nrows: int
    seed: int = 0
    identity: tuple[str, ...] | None = None

    def __repr__(self) -> str:
        return f"random, about {self.nrows} rows"


def cond_div(*names: str) -> CondDiv:
    return CondDiv(tuple(n for x in names for n in ([x] if isinstance(x, str) else x)))


def rr_div(nrows: int, seed: int = 0, identity: Sequence[str] | None = None) -> RandomDiv:
    return RandomDiv(int(nrows), seed, tuple(identity) if identity else None)


@dataclass(frozen=True)
class Pair:
    """A key with its value; returned by a function, it replaces the key."""

    key: Any
    value: Any

    def __repr__(self) -> str:
        shown = self.value.head(5) if isinstance(self.value, pd.DataFrame) else self.value
        return f"$key\n{self.key}\n$value\n{shown}"


def kv_pair(key: Any, value: Any) -> Pair:
    return Pair(key, value)


def kv_pairs(*pairs: Sequence) -> list[Pair]:
    """Pairs of two-element sequences; anything else is an error."""
    out = []
    for p in pairs:
        if isinstance(p, Pair):
            out.append(p)
        elif len(p) == 2:
            out.append(Pair(*p))
        else:
            raise ValueError("a pair has two elements, key and value")
    return out


def kv_apply(fn: Callable, key: Any, value: Any) -> Pair:
    """``fn(value)`` or ``fn(key, value)`` by the number of parameters; a returned ``Pair`` replaces the key."""
    params = [p for p in inspect.signature(fn).parameters.values() if p.default is p.empty and p.kind in (p.POSITIONAL_ONLY, p.POSITIONAL_OR_KEYWORD)]
    res = fn(key, value) if len(params) >= 2 else fn(value)
    return res if isinstance(res, Pair) else Pair(key, res)


@dataclass(frozen=True)
class Division:
    """Pairs of a key and rows (or, if ``is_ddo``, of a key and one ``value``)."""

    df: DataFrame
    split_cols: tuple[str, ...] = ()
    spec: Any = None
    bsv_df: DataFrame | None = None
    bsv_desc: Mapping[str, str] = field(default_factory=dict)
    transforms: tuple[tuple[Callable, str | None], ...] = ()
    schema: T.StructType | None = None  # of the transformed rows
    attrs: Mapping[str, Any] = field(default_factory=dict)
    is_ddo: bool = False

    # -- rows ------------------------------------------------------------------------------------------------------
    @property
    def value_cols(self) -> list[str]:
        hidden = {KEY, *self.split_cols}
        return [c for c in (self.schema.names if self.schema is not None else self.df.columns) if c not in hidden]

    @property
    def names(self) -> list[str]:
        return self.value_cols

    def rows(self) -> DataFrame:
        """All rows with key and split columns, deferred functions applied (one grouped map for all of them)."""
        if not self.transforms:
            return self.df
        fns, names = [f for f, _ in self.transforms], self.schema.names
        split = list(self.split_cols)

        def run(pdf: pd.DataFrame) -> pd.DataFrame:
            key = pdf[KEY].iloc[0]
            kept = {c: pdf[c].iloc[0] for c in split}
            return _frame(_chain(fns, key, pdf.drop(columns=[KEY, *split]).reset_index(drop=True)), kept, names)

        return grouped_pandas(self.df, KEY, run, self.schema)

    def where_keys(self, keys: Sequence) -> Division:
        """The pairs of some keys; the filter is applied before any deferred function."""
        return replace(self, df=self.df.where(F.col(KEY).isin(list(keys))), attrs={})

    # -- accessors -------------------------------------------------------------------------------------------------
    def get_keys(self) -> DataFrame:
        return self.rows().select(KEY).distinct()

    def __len__(self) -> int:
        return self.attrs["nDiv"] if "nDiv" in self.attrs else self.get_keys().count()

    def nrow(self) -> int:
        return self.attrs["nRow"] if "nRow" in self.attrs else self.rows().count()

    def ncol(self) -> int:
        return len(self.names)

    def get_attributes(self, names: Sequence[str]) -> dict:
        return {n: self.attrs.get(n) for n in names}

    def get_attribute(self, name: str) -> Any:
        if name not in self.attrs:
            raise KeyError(f"attribute {name} is not known; see update_attributes")
        return self.attrs[name]

    def has_attributes(self, names: Sequence[str]) -> list[bool]:
        return [self.attrs.get(n) is not None for n in names]

    def set_attributes(self, **attrs: Any) -> Division:
        return replace(self, attrs={**self.attrs, **attrs})

    def has_extractable_kv(self) -> bool:
        return True

    def summary(self) -> Any:
        if self.transforms:
            print("summaries of a transformed division are not known; persist it first")
            return None
        return self.attrs.get("summary")

    def kv_example(self) -> Pair:
        """The first pair in key order, functions applied; its rows come to the driver."""
        return self._pair(self.example_key())

    def example_key(self) -> Any:
        """The key of ``kv_example``, for ``extract_rows`` where the pair is larger than the driver takes."""
        return self.df.agg(F.min(KEY)).first()[0]

    def _pair(self, key: Any, max_rows: int = 5_000_000) -> Pair | None:
        rows = replace(self, df=self.df.where(F.col(KEY) == F.lit(key)), attrs={}).rows().limit(max_rows + 1).toPandas()
        if len(rows) > max_rows:
            raise MemoryError(f"the subset of key {key!r} has more than {max_rows} rows")
        if rows.empty:
            return None
        if self.is_ddo:
            return Pair(key, rows[VALUE].iloc[0])
        return Pair(rows[KEY].iloc[0], rows.drop(columns=[KEY, *self.split_cols]))

    def extract(self, wanted: Sequence) -> list[Pair | None]:
        """Pairs by position (in key order), key or md5 of the key, in the order asked for; what is missing is None.

        Their rows come to the driver; ``extract_rows`` takes pairs of any size.
        """
        return [None if k is None else self._pair(k) for k in self._keys_of(wanted)]

    def extract_rows(self, wanted: Sequence, place: str = "_place") -> DataFrame:
        """The rows of the pairs that ``extract`` gives, left on the cluster.

        ``place`` names a column with the place of a row's pair in ``wanted``,
        from 0: a pair asked for twice comes twice, a missing one has no rows.
        """
        names = self.schema.names if self.transforms else self.df.columns
        if place.lower() in {c.lower() for c in names}:
            raise ValueError(f"there is a column {place} already; give another name for the places")
        kind, by = self.df.schema[KEY].dataType, "_asked"
        while by.lower() in {c.lower() for c in (*names, *self.df.columns, place)}:
            by += "_"
        asked = [F.struct(F.lit(i).alias(place), _as_key(k, kind).alias(by)) for i, k in enumerate(self._keys_of(wanted)) if k is not None]
        if not asked:
            return self.rows().where(F.lit(False)).withColumn(place, F.lit(0))
        places = F.broadcast(self.df.sparkSession.range(1).select(F.inline(F.array(*asked))))  # a row for each pair asked for
        rows = self.df
        if self.transforms:  # a function may give a pair another key, so the one asked for goes along
            mine = rows.join(F.broadcast(places.select(by).distinct()), F.col(KEY) == F.col(by))
            rows = replace(self, df=mine, split_cols=(*self.split_cols, by), schema=T.StructType([*self.schema.fields, T.StructField(by, kind)])).rows()
            return rows.join(places, by).select(*[F.col(f"`{c}`") for c in (*names, place)])
        return rows.join(places, F.col(KEY) == F.col(by)).select(*[F.col(f"`{c}`") for c in (*names, place)])

    def _keys_of(self, wanted: Sequence) -> list:
        """The key of each pair asked for by position, key or md5 of the key; None where a position or an md5 has none."""
        places = [w for w in wanted if isinstance(w, int)]
        keys = self._keys_at(places) if places else {}
        hashes = [w for w in wanted if isinstance(w, str) and len(w) == 32 and all(c in "0123456789abcdef" for c in w)]
        by_hash = {r[1]: r[0] for r in self.df.where(F.md5(KEY).isin(hashes)).select(KEY, F.md5(KEY)).distinct().collect()} if hashes else {}
        return [keys.get(w) if isinstance(w, int) else by_hash.get(w, w) for w in wanted]

    def _keys_at(self, places: Sequence[int]) -> dict[int, Any]:
        """The keys at some positions in key order (negative: from the end); only those reach the driver."""
        ranked = row_numbers(self.df.select(KEY).distinct(), [], [KEY], "_n")
        n = ranked.count() if any(p < 0 for p in places) else 0
        at = {p: p + 1 if p >= 0 else n + p + 1 for p in places}
        found = {r["_n"]: r[KEY] for r in ranked.where(F.col("_n").isin(list(at.values()))).select("_n", KEY).collect()}
        return {p: found[i] for p, i in at.items() if i in found}

    def __getitem__(self, wanted: Any) -> Any:
        return self.extract(wanted) if isinstance(wanted, (list, tuple)) else self.extract([wanted])[0]

    def bsv_info(self) -> pd.DataFrame:
        return pd.DataFrame({"name": list(self.bsv_desc), "desc": list(self.bsv_desc.values())})

    def bsvs(self) -> DataFrame:
        """Between-subset variables, one row per key."""
        if self.bsv_df is None:
            raise ValueError("this division has no between-subset variables")
        return self.bsv_df

    def get_bsvs(self, key: Any) -> dict:
        row = self.bsvs().where(F.col(KEY) == key).drop(KEY).first()
        return row.asDict() if row else {}

    def get_split_vars(self, key: Any) -> dict:
        row = self.df.where(F.col(KEY) == key).select(*self.split_cols).first() if self.split_cols else None
        return row.asDict() if row else {}

    def flatten(self) -> DataFrame:
        """Value columns, then split variables and between-subset variables as ordinary columns."""
        rows = self.rows()
        if self.bsv_df is not None:
            rows = rows.join(self.bsv_df, KEY, "left")
        extra = [c for c in self.bsv_desc if c in rows.columns]
        return rows.select(*[F.col(f"`{c}`") for c in (*self.value_cols, *[c for c in self.split_cols if c not in self.value_cols], *extra)])

    def to_table(self, keys: bool = True, split_vars: bool = True, bsvs: bool = False) -> DataFrame:
        rows = self.rows()
        if bsvs and self.bsv_df is not None:
            rows = rows.join(self.bsv_df, KEY, "left")
        cols = ([KEY] if keys else []) + (list(self.split_cols) if split_vars else []) + (list(self.bsv_desc) if bsvs else []) + self.value_cols
        return rows.select(*[F.col(f"`{c}`") for c in cols])

    def to_pandas(self, max_rows: int = 5_000_000, **kw: Any) -> pd.DataFrame:
        """As a local frame; more than ``max_rows`` rows are refused instead of filling the driver."""
        res = self.to_table(**kw).limit(max_rows + 1).toPandas()  # one run of what is deferred
        if len(res) > max_rows:
            raise MemoryError(f"more than {max_rows} rows; subset first or raise max_rows")
        return res

    def to_list(self) -> list[Pair]:
        rows = self.to_pandas(split_vars=False)
        if self.is_ddo:
            return [Pair(k, v) for k, v in zip(rows[KEY], rows[VALUE])]
        return [Pair(k, g.drop(columns=KEY).reset_index(drop=True)) for k, g in rows.groupby(KEY, sort=True, dropna=False)]

    def pipe(self, fn: Callable, *args: Any, **kw: Any) -> Any:
        """``fn(self, ...)``, so that verbs can be chained."""
        return fn(self, *args, **kw)

    def __repr__(self) -> str:
        lines = [f"{'Distributed objects' if self.is_ddo else 'Distributed data frame'}: {len(self.value_cols)} columns"]
        lines += [f"  {f.name} ({f.dataType.simpleString()})" for f in (self.schema or self.df.schema).fields if f.name in self.value_cols]
        lines.append(f"  divided: {self.spec}" if self.spec is not None else "  not divided")
        for a in ("nRow", "nDiv", "totStorageSize"):
            lines.append(f"  {a}: {self.attrs.get(a, 'not known')}")
        if self.bsv_desc:
            lines.append(f"  between-subset variables: {', '.join(self.bsv_desc)}")
        if self.transforms:
            lines.append(f"  deferred functions: {', '.join(n or f.__name__ for f, n in self.transforms)}")
        return "\n".join(lines)


def _as_key(key: Any, kind: T.DataType) -> Column:
    """``key`` in the type of the keys; NULL, which matches none, where it is no value of that type."""
    typed = F.lit(key).try_cast(kind)
    return typed if isinstance(key, str) else F.when(typed == F.lit(key), typed)


def _all(df: DataFrame) -> list[Column]:
    return [F.col(f"`{c}`") for c in df.columns]


def _chain(fns: Sequence[Callable], key: Any, value: Any) -> Pair:
    for fn in fns:
        try:
            pair = kv_apply(fn, key, value)
        except Exception as e:
            raise RuntimeError(f"in the subset of key {key!r}: {e}") from e
        key, value = pair.key, pair.value
    return Pair(key, value)


def _frame(pair: Pair, split: Mapping[str, Any], names: Sequence[str] | None = None) -> pd.DataFrame:
    """A result as rows: frames keep their columns, dicts become one row, anything else the column ``value``."""
    v = pair.value
    if v is None:
        res = pd.DataFrame()
    elif isinstance(v, pd.DataFrame):
        res = v.reset_index(drop=True)
    elif isinstance(v, pd.Series):
        res = v.to_frame().T.reset_index(drop=True)
    elif isinstance(v, Mapping):
        res = pd.DataFrame([dict(v)])
    elif isinstance(v, np.ndarray):
        res = pd.DataFrame({VALUE: [v.tolist()]})
    else:
        res = pd.DataFrame({VALUE: [v.item() if isinstance(v, np.generic) else v]})
    res = res.drop(columns=[c for c in split if c in res.columns])
    res.columns = [str(c) for c in res.columns]
    res.insert(0, KEY, pair.key)
    for i, (c, x) in enumerate(split.items(), 1):
        res.insert(i, c, [x] * len(res))
    if names is not None:
        more = [c for c in res.columns if c not in set(names)] if len(res) else []
        if more:
            raise ValueError(f"the result for key {pair.key!r} has columns that the schema lacks: {', '.join(more)}; give schema= with all columns")
        res = res.reindex(columns=list(names))
    return res if len(res) else pd.DataFrame({c: pd.Series([], dtype=object) for c in res.columns})


# -- construction ----------------------------------------------------------------------------------------------------
def ddf(df: DataFrame, key: str | None = None) -> Division:
    """A table as a collection of frames: one pair with the empty key, or a pair per value of ``key``."""
    if key is None:
        return Division(df.withColumn(KEY, F.lit("")))
    require_columns(df, [key])
    return Division(df.withColumnRenamed(key, KEY) if key != KEY else df)


def ddo(df: DataFrame, key: str = "key", value: str = VALUE) -> Division:
    """One value per row: a collection of arbitrary values."""
    require_columns(df, [key, value])
    return Division(df.select(F.col(key).alias(KEY), F.col(value).alias(VALUE)), is_ddo=True)


def to_ddf(df: DataFrame, groups: Sequence[str]) -> Division:
    """A grouped table as a division by its groups."""
    if not groups:
        raise ValueError("the table must be grouped")
    return divide(df, cond_div(*groups))


def divide(
    data: DataFrame | Division,
    by: CondDiv | RandomDiv | str | Sequence[str],
    *,
    spill: int | None = None,
    spill_order: Sequence[str] | None = None,
    filter_by: Column | None = None,
    filter_fn: Callable[[pd.DataFrame], bool] | None = None,
    bsv: Mapping[str, Column | tuple[Column, str]] | Callable[[pd.DataFrame], Mapping] | None = None,
    pre: Callable[[DataFrame], DataFrame] | None = None,
    post: Callable[[DataFrame], DataFrame] | None = None,
) -> Division:
    """Split a table (or a division, by any of its columns or old split variables) into subsets.

    Order of work: ``pre`` on the rows; keys; subsets of more than ``spill``
    rows become ``key_1, key_2, ...`` (in ``spill_order``, default all columns);
    ``filter_by`` (an aggregate) or ``filter_fn`` (a Python function) keeps
    whole subsets; ``bsv`` computes values per subset, by aggregates, or by a
    Python function of the frame that returns a mapping of values or of
    ``(value, description)``; ``post`` on the rows.
    Conditioning columns leave the visible columns and stay at hand as split
    variables. A missing value is a subset of its own, ``NA``. Nothing is
    shuffled for the keys themselves. Without ``spill`` no subset is cut: rows
    of a subset need never be in one task unless a Python function asks for it.
    """
    rows = data.flatten() if isinstance(data, Division) else data
    spec = by if isinstance(by, (CondDiv, RandomDiv)) else cond_div(*([by] if isinstance(by, str) else by))
    if pre is not None:
        rows = pre(rows)
    split: tuple[str, ...] = ()
    attrs: dict[str, Any] = {}
    if isinstance(spec, CondDiv):
        require_columns(rows, spec.vars)
        rows, split = rows.withColumn(KEY, condition_key(rows, spec.vars)), spec.vars
    else:
        n = rows.count()
        ndiv = max(1, round(n / spec.nrows))
        who = row_identity(rows, spec.identity)
        if spec.identity is None:
            rows = _told_apart(rows, F.md5(who))
            who = F.concat_ws(":", "_who", F.col("_again").cast("string"))
        rows = rows.withColumn(KEY, F.concat(F.lit("rr_"), bucket(who, ndiv, spec.seed).cast("string"))).drop("_who", "_again")
        attrs = {"nRow": n, "ndiv_asked": ndiv}
    if spill is not None:
        order = list(spill_order or [c for c in rows.columns if c != KEY])
        numbered = row_numbers(rows, [KEY], order, "_rn")
        large = numbered.groupBy(KEY).agg(F.max("_rn").alias("_n")).where(F.col("_n") > spill).select(F.col(KEY).alias("_lk"))
        numbered = numbered.join(broadcast_if_small(large), F.col(KEY) == F.col("_lk"), "left")
        part = F.concat(F.col(KEY), F.lit("_"), (F.floor((F.col("_rn") - 1) / F.lit(spill)) + 1).cast("string"))
        rows = numbered.withColumn(KEY, F.when(F.col("_lk").isNotNull(), part).otherwise(F.col(KEY))).drop("_rn", "_lk")
    res = Division(rows, split, spec, attrs=attrs)
    if filter_by is not None or filter_fn is not None:
        res = dr_filter(res, filter_by if filter_by is not None else filter_fn, with_split=True)
    if callable(bsv):
        res = _opaque_bsv(res, bsv)
    elif bsv:
        pairs = {k: v if isinstance(v, tuple) else (v, k) for k, v in bsv.items()}
        side = res.df.groupBy(KEY).agg(*[c.alias(k) for k, (c, _) in pairs.items()])
        res = replace(res, bsv_df=side, bsv_desc={k: d for k, (_, d) in pairs.items()})
    return replace(res, df=post(res.df), attrs={}) if post is not None else res


def _opaque_bsv(div: Division, fn: Callable[[pd.DataFrame], Mapping]) -> Division:
    """Between-subset variables of a Python function: text, numbers, days and times; other values are missing, longer ones are dropped with a warning."""
    frozen = _freeze(fn)

    def split(value: pd.DataFrame) -> tuple[dict, dict]:
        res = frozen(value)
        if not isinstance(res, Mapping):
            raise TypeError("a bsv function must return a mapping")
        both = {k: v if isinstance(v, tuple) and len(v) == 2 and isinstance(v[1], str) else (v, "") for k, v in res.items()}
        one = {k: v.item() if isinstance(v, np.generic) else v for k, (v, _) in both.items() if isinstance(v, str) or not hasattr(v, "__len__") or len(v) == 1}
        one = {k: v if isinstance(v, str) or not hasattr(v, "__len__") else list(v)[0] for k, v in one.items()}
        plain = {k: v if isinstance(v, (str, bool, int, float, datetime.date)) and v is not pd.NaT else None for k, v in one.items()}
        return plain, {k: d for k, (_, d) in both.items()}

    example = _first_result(div, lambda value: split(value))
    plain, desc = example
    if len(plain) < len(desc):
        warnings.warn(f"between-subset variables of more than one value are dropped: {', '.join(k for k in desc if k not in plain)}", stacklevel=3)
    kinds = {bool: "boolean", int: "bigint", float: "double", datetime.date: "date"}
    never = [k for k, v in plain.items() if v is None]
    schema = None
    if never:  # of a kind that is no variable, or missing in the first subset: text, where it is a variable elsewhere
        known = {k: "string" if v is None or isinstance(v, str) else kinds.get(type(v), "timestamp_ntz") for k, v in plain.items()}
        schema = ", ".join(f"`{k}` {t}" for k, t in known.items())
    side = add_transform(replace(div, bsv_df=None, bsv_desc={}), lambda value: {k: str(v) if k in never and v is not None else v for k, v in split(value)[0].items()}, schema=schema)
    side = side.rows().drop(*div.split_cols)
    return replace(div, bsv_df=side, bsv_desc={k: desc[k] for k in plain})


def _told_apart(rows: DataFrame, who: Column) -> DataFrame:
    """``rows`` with the hash of each (``_who``) and a number among its like (``_again``), so that repeated rows spread as others do.

    Only hashes are counted, combined before the exchange; rows that are unlike
    all others stay where they are. Those that are repeated are numbered by a
    distributed sort, spread over the cluster even if they are a third of all.
    """
    named = rows.withColumn("_who", who)
    again = broadcast_if_small(named.groupBy("_who").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("_who"))
    single = named.join(again, "_who", "left_anti").withColumn("_again", F.lit(1).cast("bigint"))
    many = named.join(again, "_who", "left_semi").withColumn("_at", F.monotonically_increasing_id())
    many = row_numbers(many, ["_who"], ["_at"], "_again").drop("_at")
    cols = [*_all(rows), "_who", "_again"]
    return single.select(*cols).unionByName(many.select(*cols))


# -- deferred methods ------------------------------------------------------------------------------------------------
def add_transform(
    div: Division,
    fn: Callable | None = None,
    *,
    columns: Mapping[str, Column] | None = None,
    agg: Mapping[str, Column] | None = None,
    uses: Sequence[str] | None = None,
    schema: str | T.StructType | None = None,
    name: str | None = None,
) -> Division:
    """Defer a method on every subset.

    ``columns``: row expressions, ``agg``: aggregates giving one row a subset;
    both stay in the plan (no Python). ``fn(value)`` or ``fn(key, value)``: an
    opaque function of the subset's frame, deferred and fused with its
    neighbours; without ``schema`` (of the value columns) it is tried on a
    whole pair, which gives the result's columns. A result that has
    others is an error; those that it lacks are missing. ``uses``: the columns
    the first opaque function needs, so that no others are read. Values captured by
    ``fn`` are those at the time of this call.
    """
    if columns or agg:
        if div.transforms:
            div = replace(div, df=div.rows(), transforms=(), schema=None)
        if columns:
            return replace(div, df=div.df.withColumns(dict(columns)), attrs={})
        df = div.df.groupBy(KEY, *div.split_cols).agg(*[c.alias(k) for k, c in agg.items()])
        return replace(div, df=df, attrs={})
    if uses is not None and not div.transforms:
        require_columns(div.df, uses)
        div = replace(div, df=div.df.select(KEY, *[F.col(f"`{c}`") for c in (*div.split_cols, *uses)]))
    frozen = _freeze(fn)
    new = replace(div, transforms=(*div.transforms, (frozen, name or getattr(fn, "__name__", None))), attrs={})
    return replace(new, schema=_result_schema(new, schema), is_ddo=False)


def _freeze(fn: Callable) -> Callable:
    """A copy of the function with the values it captures now."""
    from pyspark import cloudpickle

    return cloudpickle.loads(cloudpickle.dumps(fn))


def _result_schema(div: Division, schema: str | T.StructType | None) -> T.StructType:
    head = [div.df.schema[KEY], *[div.df.schema[c] for c in div.split_cols]]
    if schema is not None:
        s = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
        return T.StructType([*head, *s.fields])
    fns = [f for f, _ in div.transforms]

    def example(key: Any, pdf: pd.DataFrame) -> bytes | None:
        res = _frame(_chain(fns, key, pdf), {})
        return pickle.dumps(_of_each_kind(res)) if _has_types(res) else None

    found = _try_pairs(div, example)
    inferred = div.df.sparkSession.createDataFrame(pickle.loads(found)).schema
    key = T.StructField(KEY, inferred[KEY].dataType)
    return T.StructType([key, *head[1:], *[f for f in inferred.fields if f.name != KEY]])


def _try_pairs(div: Division, fn: Callable[[Any, pd.DataFrame], bytes | None]) -> bytes:
    """``fn`` of a whole pair, the first found that gives anything, run where it would run anyway; few rows reach the driver."""
    hidden = [KEY, *div.split_cols]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        try:
            res, error = fn(pdf[KEY].iloc[0], pdf.drop(columns=hidden).reset_index(drop=True)), None
        except (RuntimeError, TypeError) as e:
            res, error = None, str(e)
        return pd.DataFrame({"res": [res], "error": [error]})

    at = div.df.select(KEY).limit(1).collect()  # any pair will do, so the first that is found
    found = grouped_pandas(div.df.where(F.col(KEY).eqNullSafe(F.lit(at[0][0]))), KEY, run, "res binary, error string").collect() if at else []
    if not found or (found[0]["res"] is None and not found[0]["error"]):  # the first pair gives nothing: any that does
        found = grouped_pandas(div.df, KEY, run, "res binary, error string").where("res is not null or error is not null").limit(1).collect()
    if not found:
        raise ValueError("an empty division, or one without results, has no example to infer the result from; give schema=")
    if found[0]["error"]:
        raise RuntimeError(found[0]["error"])
    return found[0]["res"]


def _first_result(div: Division, fn: Callable[[pd.DataFrame], Any]) -> Any:
    frozen = _freeze(fn)
    return pickle.loads(_try_pairs(div, lambda key, pdf: pickle.dumps(frozen(pdf))))


def _has_types(res: pd.DataFrame) -> bool:
    """Whether every column holds a value, so that its type is known."""
    return len(res) > 0 and all(res.iloc[:, i].notna().any() or res.iloc[:, i].dtype != object for i in range(res.shape[1]))


def _of_each_kind(res: pd.DataFrame) -> pd.DataFrame:
    """Rows of a result that hold every kind of value of each column, so that they give the types of the whole."""

    def kind(v: Any) -> str:
        try:
            return type(v).__name__ if isinstance(v, (str, int, float, type(None))) else T._infer_type(v).json()
        except Exception:  # no type of Spark's: the caller is told by createDataFrame
            return type(v).__name__

    keep = {0} if len(res) else set()
    for i in range(res.shape[1]):
        col = res.iloc[:, i]
        kinds = col.map(kind) if col.dtype == object else col.isna()
        keep.update(np.flatnonzero(~kinds.duplicated().to_numpy()).tolist())
    return res.iloc[sorted(keep)].reset_index(drop=True)


def dr_lapply(div: Division, fn: Callable | None = None, **kw: Any) -> Division:
    """Apply a method to every subset; the result is a division."""
    return add_transform(div, fn, **kw)


def dr_filter(div: Division, keep: Column | Callable[[pd.DataFrame], bool], *, with_split: bool = False) -> Division:
    """Keep whole subsets: by an aggregate condition (stays in the plan), or by a Python function of the frame. NULL is no."""
    if isinstance(keep, Column):
        from divrec.runtime import stage

        rows = stage(div.rows(), "filter") if div.transforms else div.df
        good = rows.groupBy(KEY).agg(keep.alias("_ok")).where("_ok").select(KEY)
    else:
        from divrec.runtime import stage

        # deferred functions run once: their rows are needed for the test and for the result
        rows, drop = stage(div.rows(), "filter") if div.transforms else div.df, [] if with_split else list(div.split_cols)
        fn = _freeze(keep)
        kind = rows.schema[KEY].dataType.simpleString()

        def test(pdf: pd.DataFrame) -> pd.DataFrame:
            key = pdf[KEY].iloc[0]
            pair = kv_apply(fn, key, pdf.drop(columns=[KEY, *drop]))
            return pd.DataFrame({KEY: [key] if bool(pair.value) else []})

        good = grouped_pandas(rows, KEY, test, f"`{KEY}` {kind}")
    good = good.withColumnRenamed(KEY, "_good")
    return replace(div, df=rows.join(good, rows[KEY].eqNullSafe(good["_good"]), "left_semi").select(*_all(rows)), transforms=(), schema=None, attrs={})


def dr_subset(div: Division, condition: Column | None = None, select: Sequence[str] | None = None, drop: bool = False, max_rows: int | None = 500_000) -> DataFrame:
    """Rows where the condition holds (NULL: no), some columns, at most ``max_rows`` rows (None: all).

    The bound is part of the verb, which takes a bounded extract; where it
    leaves rows out there is a warning, so that nothing is cut in silence.
    ``drop``: leave the split variables out.
    """
    rows = div.rows()
    if condition is not None:
        rows = rows.where(F.coalesce(condition, F.lit(False)))
    cols = list(select) if select else ([] if drop else list(div.split_cols)) + div.value_cols
    rows = rows.select(*[F.col(f"`{c}`") for c in cols])
    if max_rows is None:
        return rows
    if rows.select(F.lit(1)).limit(max_rows + 1).count() > max_rows:
        warnings.warn(f"the subset has more than {max_rows} rows and is cut; max_rows=None takes all", stacklevel=2)
    return rows.limit(max_rows)


def dr_sample(div: Division, share: float, seed: int | str = "") -> Division:
    """Whole subsets, each with probability ``share``, by the md5 of its key: the same under any partitioning."""
    return replace(div, df=div.df.where(fraction(F.col(KEY).cast("string"), seed) < F.lit(share)), attrs={})


def dr_persist(div: Division, path: str | None = None, overwrite: bool | str = False) -> Division:
    """Run what is deferred and keep the rows, in a folder or in the session's shared staging folder."""
    from divrec.runtime import stage
    from divrec.sources.connections import DiskConnection

    rows = div.rows()
    if path is None:
        kept = stage(rows, "persist")
    else:
        kept = DiskConnection(path).write(rows, overwrite)
    return replace(div, df=kept, transforms=(), schema=None)


def dr_join(*unnamed: Division, post: Callable[[dict], Any] | None = None, schema: str | T.StructType | None = None, **sources: Division) -> Division:
    """Full outer cogroup of divisions on their keys.

    A pair of the result is a key with the rows of every source that has it.
    The rows stay rows: each carries ``_source`` and, in a column named like
    its source, a struct of its columns; no subset is gathered anywhere, so a
    key may hold a third of all rows. ``joined_lists`` gathers small pairs.
    Sources without a name get one as in ``source_names``. ``post``: an opaque
    function of a pair, a dict of the sources' frames (only those that have the
    key), deferred like any other; it sees a whole pair in one task.
    """
    from divrec.operators.mapreduce import source_names

    given = source_names([*((None, d) for d in unnamed), *sources.items()] if sources else list(unnamed))
    if not given:
        raise ValueError("nothing to join")
    parts = []
    for name, div in given.items():
        rows = div.rows()
        parts.append(rows.select(F.col(KEY).cast("string").alias(KEY), F.lit(name).alias("_source"), F.struct(*[F.col(f"`{c}`") for c in rows.columns if c != KEY]).alias(name)))
    res = parts[0]
    for p in parts[1:]:
        res = res.unionByName(p, allowMissingColumns=True)
    joined = Division(res)
    if post is None:
        return joined
    frozen, order = _freeze(post), list(given)

    def gathered(value: pd.DataFrame) -> Any:
        frames = {}
        for name, rows in value.groupby("_source", sort=False):
            frames[name] = pd.DataFrame([r if isinstance(r, dict) else r.asDict() for r in rows[name]]).reset_index(drop=True)
        return frozen({n: frames[n] for n in order if n in frames})

    return add_transform(joined, gathered, schema=schema, name=getattr(post, "__name__", None))


def joined_lists(div: Division, max_rows: int = 100_000) -> DataFrame:
    """Each pair of a join as one row with an array of structs per source; a pair of more rows than ``max_rows`` is an error."""
    names = [c for c in div.value_cols if c != "_source"]
    large = div.df.groupBy(KEY).count().where(F.col("count") > max_rows).limit(1).collect()
    if large:
        raise MemoryError(f"key {large[0][0]!r} has {large[0][1]} rows; aggregate the joined rows instead")
    return div.df.groupBy(KEY).agg(*[F.collect_list(n).alias(n) for n in names])


def key_hash(key: Any) -> str:
    return hashlib.md5(str(key).encode()).hexdigest()
