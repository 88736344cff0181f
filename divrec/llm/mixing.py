"""Mixing sources to target weights.

Every document belongs to sources (domains) to some degree: a document whose
source is written down wholly to that one, any other by the posterior of a
classifier trained on the labelled table. Memberships are sparse: PARTS parts
lie in at most PARTS sources, whatever the number of sources. Nonnegative
document rates, at most the source's cap, are fitted by projected-gradient
least squares so that the expected tokens of each source meet its target. The
documents are aggregated once to groups of equal membership; an iteration is
one aggregation over the groups, by a task each for as many as LOCAL_GROUPS,
by jobs beyond. Rates become whole uses by a hash of the document, and the
shares really reached are counted.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from divrec.llm.text import portions, words
from divrec.runtime import require_columns, stage

#: Labelled documents the classifier is fitted on, taken by hash of their id; everything else covers all documents.
SAMPLE = 8_000
FEATURES = 1024
#: Posteriors are rounded to this many parts, so documents of equal membership combine.
PARTS = 16
#: Mixes and sources come as parameters from the caller; more than this is refused.
MAX_SOURCES = 1_000
#: Groups of equal membership up to which the fit runs over arrays in one place (some 200 bytes each); beyond, each
#: iteration is a job over the groups, and rates are written out every REPLAY iterations.
LOCAL_GROUPS, REPLAY = 200_000, 10
ITERATIONS, TOLERANCE = 60, 1e-6

#: How the public byte-level vocabularies split a text before merging (fixed value).
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def plain_source(source: Column) -> Column:
    """A source in lower case without blanks around; empty and missing are NULL."""
    return F.nullif(F.lower(F.btrim(source, F.lit(" \t\r\n\u00a0"))), F.lit(""))


def _vocabulary(spark: SparkSession, path: str) -> bytes:
    """The file of ranks: from the driver's disk, else from any file system the engine reads; it travels with the job."""
    if os.path.exists(path):
        with open(path, "rb") as f:
            return f.read()
    return bytes(spark.read.format("binaryFile").load(path).first()["content"])


def _load_tokenizer(content: bytes):
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, content.splitlines())}
    enc = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return lambda text: len(enc.encode_ordinary(text))


def _feature_rows(seqs: list[list[str]]) -> np.ndarray:
    """The features of many texts with one hashing call."""
    out = np.zeros((len(seqs), FEATURES), np.float32)
    flat = [w for s in seqs for w in s]
    if flat:
        at = np.repeat(np.arange(len(seqs)), [len(s) for s in seqs])
        h = (pd.util.hash_array(np.array(flat, dtype=object), categorize=True) % FEATURES).astype(np.int64)
        np.add.at(out, (at, h), 1)
    norm = np.linalg.norm(out, axis=1, keepdims=True)
    return out / np.where(norm > 0, norm, 1)


def _sample_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in portions(batches, 1):
        rows = _feature_rows([words(body) for body in batch.column(1).to_pylist()])
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([r.tobytes() for r in rows], pa.binary()), batch.column(2), batch.column(3)], names=["s", "x", "h", "i"])


def fit_classifier(x: np.ndarray, y: np.ndarray, n: int, rounds: int = 150, rate: float = 8.0, decay: float = 1e-4) -> np.ndarray:
    """Multinomial logistic regression by full-batch gradient descent; weights (FEATURES + 1) x n."""
    x = np.hstack([x, np.ones((len(x), 1), np.float32)])
    w = np.zeros((x.shape[1], n), np.float32)
    if not len(x):
        return w
    w[-1] = np.log((np.bincount(y, minlength=n) + 1) / (len(y) + n))
    target = np.eye(n, dtype=np.float32)[y]
    for _ in range(rounds):
        w -= rate * (x.T @ (_softmax(x @ w) - target) / len(x) + decay * w)
    return w


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def posteriors(w: np.ndarray, seqs: list[list[str]]) -> np.ndarray:
    x = _feature_rows(seqs)
    return _softmax(np.hstack([x, np.ones((len(x), 1), np.float32)]) @ w)


def to_parts(p: np.ndarray, parts: int = PARTS) -> np.ndarray:
    """Posteriors as whole parts that sum to ``parts`` (largest remainders first)."""
    scaled = p * parts
    base = np.floor(scaled).astype(np.int64)
    order = np.argsort(-(scaled - base), axis=1, kind="stable")
    rank = np.argsort(order, axis=1, kind="stable")
    return base + (rank < (parts - base.sum(axis=1))[:, None])


def _targets(targets: DataFrame) -> list[dict]:
    """Rows of the mixes; equal sources of a mix are one (weights add up, the smallest cap holds)."""
    rows = (
        targets.select("mix_id", "budget_ratio", plain_source(F.col("source")).alias("source"), F.col("target_weight").cast("double"), F.col("max_repeats").cast("int"))
        .where("mix_id is not null and source is not null and target_weight > 0 and budget_ratio > 0")
        .groupBy("mix_id", "source")
        .agg(F.max("budget_ratio").alias("ratio"), F.sum("target_weight").alias("weight"), F.min("max_repeats").alias("cap"))
        .orderBy("mix_id", "source")
        .limit(MAX_SOURCES + 1)
        .collect()
    )
    if len(rows) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources in the mixes")
    return [r.asDict() for r in rows]


class _Plan:
    """What the executors need to find a document's rates: small arrays over mixes and domains."""

    def __init__(self, mixes: list, domains: list[str], rows: list[dict], total: int):
        self.mixes, self.domains, n = mixes, domains, len(domains) + 1  # the last domain: sources of no mix
        at = {s: i for i, s in enumerate(domains)}
        self.target, self.cap = np.zeros((len(mixes), n)), np.zeros((len(mixes), n))
        for k, m in enumerate(mixes):
            mine = [r for r in rows if r["mix_id"] == m]
            weight = sum(r["weight"] for r in mine)
            for r in mine:
                self.target[k, at[r["source"]]] = r["weight"] / weight * r["ratio"] * total
                self.cap[k, at[r["source"]]] = np.inf if r["cap"] is None else max(0, r["cap"])
        self.steps: list[tuple[bool, np.ndarray]] = []  # (labelled documents alone, step per mix and domain)

class _Rows:
    """Some documents or groups of them: home, tokens, and sparse membership by row."""

    def __init__(self, home, dom: pa.Array, wt: pa.Array, tokens, n: int):
        self.home, self.n = np.asarray(home), n
        self.tokens = np.asarray(tokens).astype(np.float64)
        off = np.asarray(dom.offsets) if len(self.home) else np.zeros(1, np.int64)
        self.row = np.repeat(np.arange(len(self.home)), np.diff(off))
        self.dom, self.wt = np.asarray(dom.flatten()).astype(np.int64), np.asarray(wt.flatten()) / PARTS
        # the most likely source, of equal ones the first: entries lie in order of sources
        best = np.zeros(len(self.home))
        np.maximum.at(best, self.row, self.wt)
        top = np.flatnonzero(self.wt == best[self.row])[::-1]
        self.hard = np.full(len(self.home), n - 1)
        self.hard[self.row[top]] = self.dom[top]

    def rates(self, plan: _Plan, k: int, steps: list[tuple[bool, np.ndarray]], start: np.ndarray | None = None) -> np.ndarray:
        """Rates in mix k after some steps, each projected on 0..cap."""
        cap = plan.cap[k][self.hard]
        r = np.zeros(len(self.home)) if start is None else start.copy()
        for labelled, step in steps:
            move = np.bincount(self.row, self.wt * step[k][self.dom], len(self.home))
            if labelled:
                move[self.home < 0] = 0
            r = np.clip(r + move, 0, cap)
        return r

    def tokens_of(self, r: np.ndarray) -> np.ndarray:
        """Expected tokens per domain at rates r."""
        return np.bincount(self.dom, (r * self.tokens)[self.row] * self.wt, self.n)

    def mass(self, plan: _Plan, k: int, labelled: bool) -> np.ndarray:
        """Tokens per domain, at rate 1, of what may move."""
        return self.tokens_of(((plan.cap[k][self.hard] > 0) & ((self.home >= 0) | (not labelled))).astype(float))


def _of(batch: pa.RecordBatch, n: int) -> _Rows:
    dom, wt = batch.column(batch.schema.get_field_index("dom")), batch.column(batch.schema.get_field_index("wt"))
    return _Rows(batch.column(batch.schema.get_field_index("home")).to_numpy(zero_copy_only=False), dom, wt, batch.column(batch.schema.get_field_index("tokens")).to_numpy(zero_copy_only=False), n)


class _Local:
    """The fit over all groups as arrays; rates are kept from step to step."""

    def __init__(self, groups: DataFrame, plan: _Plan):
        table = groups.select("home", "dom", "wt", "tokens").orderBy("home", "dom", "wt").toArrow().combine_chunks()
        one = lambda c: table.column(c).chunk(0) if table.num_rows else pa.array([], table.schema.field(c).type)
        self.plan, self.rows = plan, _Rows(one("home").to_numpy(zero_copy_only=False), one("dom"), one("wt"), one("tokens").to_numpy(zero_copy_only=False), len(plan.domains) + 1)
        self.r = [np.zeros(table.num_rows) for _ in plan.mixes]

    def mass(self, labelled: bool) -> np.ndarray:
        return np.array([self.rows.mass(self.plan, k, labelled) for k in range(len(self.plan.mixes))])

    def step(self, labelled: bool, step: np.ndarray | None) -> np.ndarray:
        if step is not None:
            self.r = [self.rows.rates(self.plan, k, [(labelled, step)], r) for k, r in enumerate(self.r)]
        return np.array([self.rows.tokens_of(r) for r in self.r])


class _Distributed:
    """The fit by one job an iteration; rates are written out every REPLAY steps, those since then are found again by each task."""

    def __init__(self, groups: DataFrame, plan: _Plan):
        self.plan, self.pending = plan, []
        self.groups = groups.select("home", "dom", "wt", "tokens", F.array_repeat(F.lit(0.0), len(plan.mixes)).alias("r"))

    def _sums(self, of) -> np.ndarray:
        plan, n = self.plan, len(self.plan.domains) + 1

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(plan.target.shape)
            for batch in batches:
                if batch.num_rows:
                    rows = _of(batch, n)
                    start = np.asarray(batch.column(batch.schema.get_field_index("r")).flatten()).reshape(batch.num_rows, len(plan.mixes))
                    for k in range(len(plan.mixes)):
                        total[k] += of(rows, plan, k, start[:, k])
            k, d = np.indices(total.shape)
            yield pa.RecordBatch.from_arrays([pa.array(k.ravel(), pa.int32()), pa.array(d.ravel(), pa.int32()), pa.array(total.ravel())], names=["k", "d", "tokens"])

        out = np.zeros(plan.target.shape)
        for r in self.groups.mapInArrow(run, "k int, d int, tokens double").groupBy("k", "d").agg(F.sum("tokens").alias("t")).collect():  # mixes x domains
            out[r["k"], r["d"]] = r["t"]
        return out

    def mass(self, labelled: bool) -> np.ndarray:
        return self._sums(lambda rows, plan, k, start: rows.mass(plan, k, labelled))

    def step(self, labelled: bool, step: np.ndarray | None) -> np.ndarray:
        if step is not None:
            self.pending = [*self.pending, (labelled, step)]
        steps = self.pending
        if len(steps) >= REPLAY:
            plan, n = self.plan, len(self.plan.domains) + 1

            def advance(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                for batch in batches:
                    rows, at = _of(batch, n), batch.schema.get_field_index("r")
                    start = np.asarray(batch.column(at).flatten()).reshape(batch.num_rows, len(plan.mixes))
                    new = np.column_stack([rows.rates(plan, k, steps, start[:, k]) for k in range(len(plan.mixes))]).reshape(batch.num_rows, len(plan.mixes))
                    lists = pa.ListArray.from_arrays(pa.array(np.arange(batch.num_rows + 1) * len(plan.mixes), pa.int32()), pa.array(new.ravel()))
                    yield batch.set_column(at, "r", lists)

            self.groups, self.pending = stage(self.groups.mapInArrow(advance, self.groups.schema), "rates"), []
            steps = []
        return self._sums(lambda rows, plan, k, start: rows.tokens_of(rows.rates(plan, k, steps, start)))


def fit_rates(groups: DataFrame, plan: _Plan, local_groups: int = LOCAL_GROUPS) -> np.ndarray:
    """Projected-gradient least squares, first over labelled documents alone, then over all; the expected tokens in the end.

    Each iteration scales a domain's gap by the tokens that may move for it,
    adds it to the rates by membership and projects them on 0..cap. The steps
    stay in ``plan``: a document finds its rates from them.
    """
    fit = (_Local if groups.limit(local_groups + 1).count() <= local_groups else _Distributed)(groups, plan)
    scale = np.maximum(plan.target.sum(axis=1, keepdims=True), 1.0)
    reached = fit.step(True, None)
    for labelled in (True, False):
        mass = fit.mass(labelled)
        for _ in range(ITERATIONS):
            step = np.where(mass > 0, (plan.target - reached) / np.where(mass > 0, mass, 1), 0.0)
            plan.steps.append((labelled, step))
            now = fit.step(labelled, step)
            moved, reached = np.abs(now - reached) / scale, now
            if moved.max(initial=0.0) < TOLERANCE:
                break
    return reached


def _labelled_sample(known: DataFrame, sample: int, n_known: int) -> tuple[list[str], np.ndarray]:
    """Sources and features of the ``sample`` labelled documents of the least hash of their id.

    Only documents below a hash bound, about a quarter more than wanted, go on,
    and as feature rows, so no task gathers texts; the bound is raised in the
    rare case that too few lie below it.
    """
    share = min(1.0, (1.25 * sample + 200) / max(1, n_known))
    while True:
        bound = F.lit(int(-(2**63) + share * (2**64 - 1)) if share < 1 else 2**63 - 1)
        below = known.where(F.col("h") <= bound) if share < 1 else known
        rows = below.select("s", "t", "h", "i").mapInArrow(_sample_features, T.StructType([*T._parse_datatype_string("s string, x binary, h bigint").fields, T.StructField("i", known.schema["i"].dataType)]))
        taken = rows.orderBy("h", "i").limit(sample).select("s", "x").collect()  # sample x FEATURES numbers
        if len(taken) >= sample or share >= 1:
            return [r["s"] for r in taken], np.frombuffer(b"".join(bytes(r["x"]) for r in taken), np.float32).reshape(len(taken), FEATURES)
        share = min(1.0, share * 4)


def mix_sources(
    docs: DataFrame, targets: DataFrame, *, doc_id: str = "doc_id", text: str = "text", source: str = "source", tokenizer: str | None = None, sample: int = SAMPLE, local_groups: int = LOCAL_GROUPS
) -> tuple[DataFrame, DataFrame]:
    """Fit the mixes; returns (report, uses).

    ``targets``: ``mix_id, budget_ratio, source, target_weight, max_repeats``
    (NULL: no cap). A source's target is its weight over the sum of the mix's
    weights, times budget_ratio, times the tokens of all documents.

    ``report``, one row per mix and source: ``target_tokens, target_share,
    size_tokens`` (documents with that source written down),
    ``available_tokens`` (size times cap; NULL without cap), ``saturated`` (the
    fit has its documents at the cap), ``fitted_tokens`` (expected),
    ``actual_tokens`` and ``actual_share`` (whole uses; documents without a
    source count by membership). ``uses``: ``mix_id, doc_id, uses`` for
    documents used at least once, never more than their source's cap.

    Sources are compared in lower case without blanks around; documents without
    one are members by posterior, and capped by their most likely source. Rows
    of ``targets`` without mix, source or positive weight and ratio ask for
    nothing. Texts that are NULL or empty have no tokens. Empty tables give an
    empty report.
    """
    spark = docs.sparkSession
    rows = _targets(targets)
    mixes, domains = sorted({r["mix_id"] for r in rows}), sorted({r["source"] for r in rows})
    at, n = {s: i for i, s in enumerate(domains)}, len(domains) + 1
    require_columns(docs, [doc_id, text, source])
    plain = plain_source(F.col(f"`{source}`"))
    n_known = docs.where(plain.isNotNull()).count()

    # The labelled table: a bounded sample by hash, so the same documents at any partitioning.
    known = docs.select(F.col(f"`{doc_id}`").alias("i"), plain.alias("s"), F.col(f"`{text}`").cast("string").alias("t"), F.xxhash64(F.col(f"`{doc_id}`")).alias("h")).where(F.col("s").isNotNull() & F.col("t").isNotNull())
    labels, seen = _labelled_sample(known, sample, n_known) if rows else ([], np.zeros((0, FEATURES), np.float32))
    weights = fit_classifier(seen, np.array([at.get(s, n - 1) for s in labels], np.int64), n)

    shared = spark.sparkContext.broadcast((at, weights, _vocabulary(spark, tokenizer) if tokenizer else None))  # (FEATURES + 1) x (MAX_SOURCES + 1) numbers at most
    kind = T.StructType([T.StructField("doc_id", docs.schema[doc_id].dataType), T.StructField("home", T.IntegerType()), T.StructField("dom", T.ArrayType(T.IntegerType())), T.StructField("wt", T.ArrayType(T.IntegerType())), T.StructField("tokens", T.LongType())])

    def classify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, w, vocabulary = shared.value
        size = _load_tokenizer(vocabulary) if vocabulary else None
        for batch in portions(batches, 2):
            names, bodies = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            home = np.array([-1 if s is None else index.get(s, n - 1) for s in names], np.int64)
            free = np.flatnonzero(home < 0)
            seqs = [words(b) for b in bodies] if size is None else {i: words(bodies[i]) for i in free}
            tokens = [len(q) for q in seqs] if size is None else [size(b) if b else 0 for b in bodies]
            entries = np.ones(len(home), np.int64)
            row, dom, wt = np.flatnonzero(home >= 0), home[home >= 0], np.full(int((home >= 0).sum()), PARTS)
            if len(free):
                parts = to_parts(posteriors(w, [seqs[i] for i in free]))
                r, d = np.nonzero(parts)
                entries[free] = np.bincount(r, minlength=len(free))
                row, dom, wt = np.concatenate([row, free[r]]), np.concatenate([dom, d]), np.concatenate([wt, parts[r, d]])
            order = np.lexsort((dom, row))
            offsets = pa.array(np.concatenate([[0], np.cumsum(entries)]), pa.int32())
            lists = [pa.ListArray.from_arrays(offsets, pa.array(x[order], pa.int32())) for x in (dom, wt)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(home, pa.int32()), *lists, pa.array(tokens, pa.int64())], names=kind.names)

    members = stage(docs.select(F.col(f"`{doc_id}`"), plain, F.col(f"`{text}`").cast("string")).mapInArrow(classify, kind), "members")
    groups = stage(members.groupBy("home", "dom", "wt").agg(F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("docs")), "groups")
    home = {r["home"]: r for r in groups.where("home >= 0").groupBy("home").agg(F.sum("tokens").alias("t")).collect()}  # one row a source
    total = groups.agg(F.sum("tokens")).first()[0] or 0
    plan = _Plan(mixes, domains, rows, total)
    fitted = fit_rates(groups, plan, local_groups) if rows else np.zeros((0, n))
    alone = _Rows(np.arange(n), *[pa.ListArray.from_arrays(pa.array(np.arange(n + 1), pa.int32()), pa.array(x, pa.int32())) for x in (np.arange(n), np.full(n, PARTS))], np.ones(n), n)
    rates = np.array([alone.rates(plan, k, plan.steps) for k in range(len(mixes))]).reshape(len(mixes), n).T  # of documents wholly of one source

    uses_schema = T.StructType([T.StructField("mix_id", targets.schema["mix_id"].dataType), T.StructField("doc_id", kind["doc_id"].dataType), T.StructField("uses", T.LongType()), *[kind[c] for c in ("tokens", "dom", "wt")]])

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            mine = batch.column(1).to_numpy(zero_copy_only=False)
            free = np.flatnonzero(mine < 0)
            part = _of(batch.take(pa.array(free)), n) if len(free) else None
            seed = batch.column(5).to_numpy(zero_copy_only=False).astype(np.uint64)
            for k, m in enumerate(plan.mixes):
                r = rates[mine, k]  # what has a home has its home's rate
                if part is not None:
                    r[free] = part.rates(plan, k, plan.steps)
                low = np.floor(r)
                u = seed + np.uint64((0x9E3779B97F4A7C15 * (k + 1)) & 0xFFFFFFFFFFFFFFFF)
                u = (u ^ (u >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
                u = (u ^ (u >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
                u = ((u ^ (u >> np.uint64(31))) >> np.uint64(11)).astype(np.float64) / 2.0**53
                count = (low + (u < r - low)).astype(np.int64)
                pick = np.flatnonzero(count)
                if len(pick):
                    idx = pa.array(pick)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([m] * len(pick), mix_arrow), batch.column(0).take(idx), pa.array(count[pick], pa.int64()), *[batch.column(i).take(idx) for i in (4, 2, 3)]], names=uses_schema.names
                    )

    from pyspark.sql.pandas.types import to_arrow_type

    mix_arrow = to_arrow_type(targets.schema["mix_id"].dataType)
    uses = members.select("doc_id", "home", "dom", "wt", "tokens", F.xxhash64("doc_id").alias("seed")).mapInArrow(draw, uses_schema)
    got = uses.select("mix_id", F.explode(F.arrays_zip("dom", "wt")).alias("_m"), (F.col("uses") * F.col("tokens")).alias("t")).select("mix_id", F.col("_m.dom").alias("d"), F.col("_m.wt").alias("p"), "t")
    got = got.groupBy("mix_id", "d").agg(F.sum(F.col("t") * F.col("p") / PARTS).alias("actual_tokens"))
    all_of = got.groupBy("mix_id").agg(F.sum("actual_tokens").alias("_all"))
    base = []
    for k, m in enumerate(mixes):
        for r in (x for x in rows if x["mix_id"] == m):
            d = at[r["source"]]
            size = int(home[d]["t"]) if d in home else 0
            cap = r["cap"]
            base.append((m, r["source"], d, cap, float(plan.target[k, d]), float(plan.target[k, d] / plan.target[k].sum()) if total else 0.0, size, None if cap is None else size * max(0, cap), bool(size == 0 or rates[d, k] >= plan.cap[k, d] - 1e-9), float(fitted[k, d])))
    base_schema = T.StructType([T.StructField("mix_id", targets.schema["mix_id"].dataType)]).add("source", "string").add("d", "integer").add("max_repeats", "integer").add("target_tokens", "double").add("target_share", "double").add("size_tokens", "long").add("available_tokens", "long").add("saturated", "boolean").add("fitted_tokens", "double")
    report = F.broadcast(spark.createDataFrame(base, base_schema))  # at most MAX_SOURCES rows
    report = got.join(report, ["mix_id", "d"], "right").join(F.broadcast(all_of), "mix_id", "left")
    actual = F.coalesce("actual_tokens", F.lit(0.0))
    report = report.select(
        "mix_id", "source", "max_repeats", "target_tokens", "target_share", "size_tokens", "available_tokens", "saturated", "fitted_tokens",
        actual.alias("actual_tokens"), F.coalesce(actual / F.when(F.col("_all") > 0, F.col("_all")), F.lit(0.0)).alias("actual_share"),
    )
    return report, uses.select("mix_id", "doc_id", "uses")


def unreachable(report: DataFrame) -> DataFrame:
    """Capped sources whose tokens at the cap stay below the target, wherever the fit left their documents.

    ``saturated`` says nothing here: documents without a source may lift a
    source above its target, and then its own leave the cap.
    """
    return report.where(F.col("max_repeats").isNotNull() & (F.col("available_tokens") < F.col("target_tokens"))).select("mix_id", "source")
