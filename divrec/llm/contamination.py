"""Evaluation texts leaking into training text.

A generalised suffix automaton is built of the normalised words of the test
items; the words of every document are streamed through it, following the
longest match at each word. Where the match is at least ``min_words`` long, the
state tells which items hold those words.

Items come in blocks, one automaton each. Documents are read and cut into words
once, whatever the number of blocks: hashes of all runs of ``min_words`` words
of the items tell which blocks a document can match at all (a document without
such a run matches nothing), and only those automata see it. With more blocks
than a worker may hold, the few documents that can match are staged, and the
blocks take turns over these. Documents are never shuffled.
"""

from __future__ import annotations

import bisect
import sys
import types
import uuid
from array import array
from collections import OrderedDict
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from divrec.llm.text import portions, word_spans, words
from divrec.runtime import fresh, require_columns, stage

#: Words of test items in one automaton (some 60 bytes each); more items go in further blocks.
BLOCK_WORDS = 300_000
#: Automata that a worker holds at a time, and words of items (some 20 bytes each, with the hash of the run that begins
#: there) that are broadcast for one pass over the documents.
HELD_BLOCKS, PASS_WORDS = 8, 4_000_000
MIN_WORDS = 10


class SuffixAutomaton:
    """The substrings of several word sequences.

    ``items[anchor[s]]`` are the sequences holding the last ``min_words`` words
    of a match of at least that length that ends in state ``s``.
    """

    def __init__(self, sequences: list[tuple[int, list[str]]], min_words: int):
        self.min_words = min_words
        self.vocab: dict[str, int] = {}
        length, link, trans = [0], [-1], [{}]
        ids = [(key, [self.vocab.setdefault(w, len(self.vocab)) for w in seq]) for key, seq in sequences]
        for _, seq in ids:
            last = 0
            for c in seq:
                last = self._extend(length, link, trans, last, c)
        self.length, self.link = array("i", length), array("i", link)
        self.width = max(1, len(self.vocab))
        steps = sorted((s * self.width + c, t) for s, row in enumerate(trans) for c, t in row.items())
        self.step_from, self.step_to = array("q", [k for k, _ in steps]), array("i", [t for _, t in steps])
        # The state whose strings include the suffix of just min_words words, for states with strings that long.
        self.anchor = [-1] * len(length)
        for s in sorted(range(len(length)), key=length.__getitem__):
            if length[s] >= min_words:
                up = link[s]
                self.anchor[s] = s if length[up] < min_words else self.anchor[up]
        self.items: dict[int, list[int]] = {}
        for key, seq in ids:
            for _, state in self.matches_of_ids(seq):
                found = self.items.setdefault(self.anchor[state], [])
                if not found or found[-1] != key:
                    found.append(key)
        self.items = {s: sorted(set(keys)) for s, keys in self.items.items()}
        self.anchor = array("i", self.anchor)

    def _step(self, key: int) -> int:
        """The state a transition leads to, or -1: a binary search in the sorted table."""
        at = bisect.bisect_left(self.step_from, key)
        return self.step_to[at] if at < len(self.step_from) and self.step_from[at] == key else -1

    @staticmethod
    def _extend(length: list[int], link: list[int], trans: list[dict], last: int, c: int) -> int:
        if c in trans[last]:  # another sequence has been here
            q = trans[last][c]
            if length[q] == length[last] + 1:
                return q
            return SuffixAutomaton._clone(length, link, trans, last, c, q)
        cur = len(length)
        length.append(length[last] + 1)
        link.append(0)
        trans.append({})
        p = last
        while p != -1 and c not in trans[p]:
            trans[p][c] = cur
            p = link[p]
        if p == -1:
            return cur
        q = trans[p][c]
        link[cur] = q if length[q] == length[p] + 1 else SuffixAutomaton._clone(length, link, trans, p, c, q)
        return cur

    @staticmethod
    def _clone(length: list[int], link: list[int], trans: list[dict], p: int, c: int, q: int) -> int:
        new = len(length)
        length.append(length[p] + 1)
        link.append(link[q])
        trans.append(dict(trans[q]))
        link[q] = new
        while p != -1 and trans[p].get(c) == q:
            trans[p][c] = new
            p = link[p]
        return new

    def matches_of_ids(self, ids) -> Iterator[tuple[int, int]]:
        """(position, state) at each word where the longest match has at least ``min_words`` words; None breaks a match."""
        step, link, length, width, least = self._step, self.link, self.length, self.width, self.min_words
        state, n = 0, 0
        for i, c in enumerate(ids):
            if c is None:
                state, n = 0, 0
                continue
            to = step(state * width + c)
            while to < 0 and state:
                state = link[state]
                n = length[state]
                to = step(state * width + c)
            if to < 0:
                continue
            state, n = to, n + 1
            if n >= least:
                yield i, state

    def covered(self, seq: list[str]) -> dict[int, list[tuple[int, int]]]:
        """Per item the spans [start, end) of words of ``seq`` made of runs of ``min_words`` words of the item."""
        get, k = self.vocab.get, self.min_words
        ids = list(map(get, seq))
        # No run of k known words, no match: most documents end here.
        if len(ids) < k or ids.count(None) > len(ids) - k:
            return {}
        out: dict[int, list[tuple[int, int]]] = {}
        for i, state in self.matches_of_ids(ids):
            for key in self.items[self.anchor[state]]:
                spans = out.setdefault(key, [])
                if spans and spans[-1][1] > i - k:
                    spans[-1] = (spans[-1][0], i + 1)
                else:
                    spans.append((i - k + 1, i + 1))
        return out


def run_hashes(flat: list[str], k: int) -> np.ndarray:
    """A 64-bit hash of every run of ``k`` words of a sequence, by the place where it begins."""
    if len(flat) < k:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        h = pd.util.hash_array(np.array(flat, dtype=object), categorize=True)
        out = np.zeros(len(flat) - k + 1, np.uint64)
        for i in range(k):
            out = out * np.uint64(0x9E3779B97F4A7C15) + h[i : len(flat) - k + 1 + i]
            out ^= out >> np.uint64(29)
    return out


class _Block:
    """Some items; their words as one text each, which is a tenth of the lists."""

    def __init__(self, items: list[tuple[int, list[str]]], min_words: int):
        self.items, self.min_words = [(key, " ".join(seq)) for key, seq in items], min_words
        self.size = sum(len(seq) for _, seq in items)
        self.hashes = np.unique(np.concatenate([run_hashes(seq, min_words) for _, seq in items]))


def _automaton(shared: dict, number: int) -> SuffixAutomaton:
    """The automaton of a block, built once in a worker process; the ``HELD_BLOCKS`` used last are held.

    Functions travel by value, so what outlives a task is kept in a module of
    its own.
    """
    holder = sys.modules.setdefault("_divrec_automata", types.ModuleType("_divrec_automata"))
    built = holder.__dict__.setdefault("built", OrderedDict())
    key = (shared["key"], number)
    if key not in built:
        while len(built) >= HELD_BLOCKS:
            built.popitem(last=False)
        items, min_words = shared["blocks"][number]
        built[key] = SuffixAutomaton([(item, text.split(" ")) for item, text in items], min_words)
    built.move_to_end(key)
    return built[key]


def item_blocks(items: DataFrame, min_words: int, block_words: int = BLOCK_WORDS) -> Iterator[_Block]:
    """The items with at least ``min_words`` words, in blocks of at most ``block_words`` words (or one item).

    Items come to the driver one after the other and one block at a time is held.
    """
    block, size = [], 0
    for key, text in items.toLocalIterator():
        seq = words(text)
        if key is None or len(seq) < min_words:
            continue
        if block and size + len(seq) > block_words:
            yield _Block(block, min_words)
            block, size = [], 0
        block.append((key, seq))
        size += len(seq)
    if block:
        yield _Block(block, min_words)


def _rounds(blocks: Iterator[_Block], most_words: int) -> Iterator[list[_Block]]:
    """Blocks of at most ``most_words`` words (or one block) together."""
    now, size = [], 0
    for b in blocks:
        if now and size + b.size > most_words:
            yield now
            now, size = [], 0
        now.append(b)
        size += b.size
    if now:
        yield now


def _possible(seqs: list[list[str]], hashes: np.ndarray, owner: np.ndarray, k: int) -> dict[int, list[int]]:
    """Which blocks each document (by its place) can match: a superset, as a run in common has a hash in common."""
    long = [i for i, s in enumerate(seqs) if len(s) >= k]
    if not long or not len(hashes):
        return {}
    flat = [w for i in long for w in seqs[i]]
    sizes = np.array([len(seqs[i]) for i in long])
    of = np.repeat(np.array(long), sizes)
    runs = run_hashes(flat, k)
    at = np.searchsorted(hashes, runs)
    hit = (at < len(hashes)) & (hashes[np.minimum(at, len(hashes) - 1)] == runs)
    hit &= of[: len(runs)] == of[k - 1 :]  # a run over the end of a document is none
    out: dict[int, list[int]] = {}
    for i in np.flatnonzero(hit):
        doc, j = int(of[i]), int(at[i])
        found = out.setdefault(doc, [])
        while j < len(hashes) and hashes[j] == runs[i]:
            if owner[j] not in found:
                found.append(int(owner[j]))
            j += 1
    return out


def _shared(spark, blocks: list[_Block]):
    """A broadcast of some blocks and their run hashes, as plain values; bounded by the words of a round."""
    each = [b.hashes for b in blocks]
    hashes, owner = np.concatenate(each), np.repeat(np.arange(len(each)), [len(h) for h in each])
    order = np.argsort(hashes, kind="stable")
    return spark.sparkContext.broadcast({"key": uuid.uuid4().hex, "blocks": [(b.items, b.min_words) for b in blocks], "hashes": hashes[order], "owner": owner[order].astype(np.int32)})


def _covered(shared, bodies: list[str | None], k: int) -> Iterator[tuple[int, list[str], dict[int, list[tuple[int, int]]]]]:
    """(place, words, spans by item) of the texts that hold runs of items."""
    seqs = [words(b) for b in bodies]
    able = _possible(seqs, shared.value["hashes"], shared.value["owner"], k)
    spans: dict[int, dict] = {}
    # block by block, so that each automaton is fetched once for a batch
    for number in sorted({n for ns in able.values() for n in ns}):
        auto = _automaton(shared.value, number)
        for at in sorted(a for a, ns in able.items() if number in ns):
            for key, s in auto.covered(seqs[at]).items():
                have = spans.setdefault(at, {})
                have[key] = sorted({*have.get(key, []), *s})  # an item id of several texts may be in several blocks
    for at in sorted(spans):
        yield at, seqs[at], {key: _joined(s) for key, s in spans[at].items()}


def _joined(spans: list) -> list[tuple[int, int]]:
    """Spans in order, those that overlap or touch as one."""
    out: list[list[int]] = []
    for s, e in sorted(map(tuple, spans)):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return [tuple(x) for x in out]


def _over_blocks(rows: DataFrame, items: DataFrame, run: Callable, schema: T.StructType, min_words: int, block_words: int) -> DataFrame:
    """``run(shared)``, a function for mapInArrow over (any column, text), over all rows and all items.

    One pass over the rows for ``PASS_WORDS`` words of items. If they are more
    than ``HELD_BLOCKS`` blocks, that pass only picks the rows that can match,
    which are staged, and the blocks take turns over these.
    """
    spark, out = rows.sparkSession, None
    for blocks in _rounds(item_blocks(items, min_words, block_words), PASS_WORDS):
        if len(blocks) <= HELD_BLOCKS:
            parts = [rows.mapInArrow(run(_shared(spark, blocks)), schema)]
        else:
            shared = _shared(spark, blocks)

            def pick(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
                for batch in portions(batches, 1):
                    able = _possible([words(b) for b in batch.column(1).to_pylist()], shared.value["hashes"], shared.value["owner"], min_words)
                    if able:
                        yield batch.take(pa.array(sorted(able)))

            able = stage(rows.mapInArrow(pick, rows.schema), "able")
            shared.unpersist()
            parts = []
            for i in range(0, len(blocks), HELD_BLOCKS):
                turn = _shared(spark, blocks[i : i + HELD_BLOCKS])
                parts.append(stage(able.mapInArrow(run(turn), schema), "leaks"))
                turn.unpersist()
        for p in parts:
            out = p if out is None else out.unionByName(p)
    return out if out is not None else spark.createDataFrame([], schema)


_SPANS = T.ArrayType(T.ArrayType(T.LongType()))


def leaks(
    docs: DataFrame, items: DataFrame, *, doc_id: str = "doc_id", text: str = "text", item_id: str = "eval_id", item_text: str = "text", min_words: int = MIN_WORDS, block_words: int = BLOCK_WORDS
) -> DataFrame:
    """Documents that hold at least ``min_words`` consecutive words of a test item, one row for each pair.

    Result: ``doc_id, eval_id, doc_words, item_words`` (covered words of the
    document), ``spans`` (array of [start, end) word positions). Repeated
    documents give repeated rows; NULL or empty texts, and items of fewer words
    or without id, match nothing. Item ids must be integers; items of one id
    with several texts count as one item (in one block, or a pair may come in
    several rows). Empty tables give no rows.
    """
    require_columns(docs, [doc_id, text])
    require_columns(items, [item_id, item_text])
    kind = docs.schema[doc_id].dataType
    schema = T.StructType([T.StructField("doc_id", kind), T.StructField("eval_id", T.LongType()), T.StructField("doc_words", T.LongType()), T.StructField("item_words", T.LongType()), T.StructField("spans", _SPANS)])
    rows = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))

    def run(shared) -> Callable:
        def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in portions(batches, 1):
                res = []
                for at, seq, found in _covered(shared, batch.column(1).to_pylist(), min_words):
                    res += [(at, key, len(seq), sum(e - s for s, e in spans), [list(x) for x in spans]) for key, spans in found.items()]
                if res:
                    cols = list(zip(*res))
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).take(pa.array(cols[0])), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.int64()), pa.array(cols[4], pa.list_(pa.list_(pa.int64())))],
                        names=["doc_id", "eval_id", "doc_words", "item_words", "spans"],
                    )

        return search

    return _over_blocks(rows, items.select(item_id, item_text), run, schema, min_words, block_words)


def clean_documents(
    docs: DataFrame, items: DataFrame, *, text: str = "text", item_id: str = "eval_id", item_text: str = "text", min_words: int = MIN_WORDS, max_span: int = MIN_WORDS, max_coverage: float = 0.5, block_words: int = BLOCK_WORDS
) -> DataFrame:
    """``docs`` with leaked spans cut out of the text, and ``coverage`` and ``verdict`` added, in one pass over the documents.

    Spans, limits and verdicts as in ``decontaminate``. Rows are looked at one
    by one and never joined, so missing and repeated ids do no harm. Items must
    fit a pass (``PASS_WORDS`` words, ``HELD_BLOCKS`` blocks held at a time);
    more is an error, then use ``leaks`` and ``decontaminate``.
    """
    require_columns(docs, [text])
    blocks = list(item_blocks(items.select(item_id, item_text), min_words, block_words))
    if sum(b.size for b in blocks) > PASS_WORDS:
        raise ValueError(f"the items have more than {PASS_WORDS} words; use leaks and decontaminate")
    coverage, verdict = fresh(docs, "coverage"), fresh(docs, "verdict")
    schema = T.StructType([T.StructField("text", T.StringType()), T.StructField("coverage", T.DoubleType()), T.StructField("verdict", T.StringType())])
    shared = _shared(docs.sparkSession, blocks) if blocks else None

    def cut(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for a in texts:
            res = []
            for part in portions(iter([pa.record_batch([a], ["text"])]), 0):
                bodies = part.column(0).to_pylist()
                found = {at: sorted(x for s in spans.values() for x in s) for at, _, spans in _covered(shared, bodies, min_words)} if shared is not None else {}
                res += [_cut(b, found.get(i), max_span, max_coverage) for i, b in enumerate(bodies)]
            yield pa.array([dict(zip(("text", "coverage", "verdict"), r)) for r in res], pa.struct([("text", pa.string()), ("coverage", pa.float64()), ("verdict", pa.string())]))

    cut.__annotations__ = {"texts": Iterator[pa.Array], "return": Iterator[pa.Array]}
    done = docs.withColumn(fresh(docs, "_cut"), F.arrow_udf(cut, schema)(F.col(f"`{text}`").cast("string")))
    c = F.col(fresh(docs, "_cut"))
    keep = [c["text"].alias(text) if n == text else F.col(f"`{n}`") for n in docs.columns]
    return done.select(*keep, c["coverage"].alias(coverage), c["verdict"].alias(verdict))


def decontaminate(
    docs: DataFrame, found: DataFrame, *, doc_id: str = "doc_id", text: str = "text", max_span: int = MIN_WORDS, max_coverage: float = 0.5
) -> DataFrame:
    """``docs`` with leaked spans cut out of the text, and ``coverage`` and ``verdict`` added, from spans found before.

    ``found`` is the result of ``leaks`` over the same documents. Spans of at
    least ``max_span`` words (after joining the spans of all items) are removed
    from the text as it stands (``verdict`` = ``cut``); documents of which they
    cover more than the share ``max_coverage`` keep their text and get
    ``drop``; all others ``keep``. Spans are brought back by id, a missing id
    being one, so ids must be unique; ``clean_documents`` needs no ids and no
    join. Existing columns named coverage or verdict are not touched: the new
    ones get underscores appended.
    """
    coverage, verdict = fresh(docs, "coverage"), fresh(docs, "verdict")
    spans = found.groupBy(F.col("doc_id").alias("_leak_id")).agg(F.array_distinct(F.flatten(F.collect_set("spans"))).alias("_spans"))
    joined = docs.join(spans, F.col(doc_id).eqNullSafe(F.col("_leak_id")), "left")
    schema = T.StructType([T.StructField("text", T.StringType()), T.StructField("coverage", T.DoubleType()), T.StructField("verdict", T.StringType())])

    def cut(texts: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for a, b in texts:
            res = [_cut(t, s, max_span, max_coverage) for t, s in zip(a.to_pylist(), b.to_pylist())]
            yield pa.array([dict(zip(("text", "coverage", "verdict"), r)) for r in res], pa.struct([("text", pa.string()), ("coverage", pa.float64()), ("verdict", pa.string())]))

    cut.__annotations__ = {"texts": Iterator[tuple[pa.Array, pa.Array]], "return": Iterator[pa.Array]}
    done = joined.withColumn("_cut", F.arrow_udf(cut, schema)(F.col(f"`{text}`"), F.col("_spans")))
    keep = [F.col("_cut")["text"].alias(text) if c == text else F.col(f"`{c}`") for c in docs.columns]
    return done.select(*keep, F.col("_cut")["coverage"].alias(coverage), F.col("_cut")["verdict"].alias(verdict))


def _cut(text: str | None, spans: list | None, max_span: int, max_coverage: float) -> tuple[str | None, float, str]:
    if text is None or not spans:
        return text, 0.0, "keep"
    at = word_spans(text)
    joined = _joined(spans)
    joined = [x for x in joined if x[1] - x[0] >= max_span]
    share = sum(e - s for s, e in joined) / max(1, len(at))
    if not joined:
        return text, share, "keep"
    if share > max_coverage:
        return text, share, "drop"
    parts, end = [], 0
    for s, e in joined:
        parts.append(text[end : at[s][1]])
        end = at[e - 1][2]
    return "".join([*parts, text[end:]]), share, "cut"
