"""Words of a text, as the contamination, mixing and repetition operators compare them."""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
import regex

_TAG = re.compile(r"<[^<>]{1,60}>")
_ENTITY = re.compile(r"&(?:#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[^\t\n\f <&#;]{1,32};?)")
_WORD = re.compile(r"[^\W_]+")
#: Characters that don't count: format characters (zero-width, soft hyphen, directional marks) and accents (nonspacing marks).
_SILENT = regex.compile(r"[\p{Cf}\p{Mn}\p{Me}]+")


def _plain(text: str) -> str:
    """Letter case, width, accents and invisible characters taken away."""
    if text.isascii():
        return text.lower()
    folded = unicodedata.normalize("NFKD", text).casefold()
    return _SILENT.sub("", unicodedata.normalize("NFKD", folded))


def words(text: str | None) -> list[str]:
    """The words of a text: unbroken runs of letters or digits, normalised.

    Markup tags (``<...>``, up to 60 characters inside) stand for a blank,
    entities for their character; zero-width characters, soft hyphens, letter
    case, accents and letter width don't count. NULL and empty texts have no
    words.
    """
    if not text:
        return []
    if "<" in text:
        text = _TAG.sub(" ", text)
    if "&" in text:
        text = html.unescape(text)
    return _WORD.findall(_plain(text))


#: Bytes of text that are cut into words at a time: the words take some fifteen times as much memory.
PORTION = 4_000_000


def portions(batches: Iterator[pa.RecordBatch], column: int, most: int | None = None) -> Iterator[pa.RecordBatch]:
    """The batches in slices of at most ``most`` bytes of text in a column, or one row: what a task holds is bounded, however long the texts."""
    most = PORTION if most is None else most
    for batch in batches:
        if not batch.num_rows:
            continue
        total = pc.cumulative_sum(pc.fill_null(pc.binary_length(batch.column(column)), 0).cast(pa.int64())).to_numpy()
        at = 0
        while at < batch.num_rows:
            done = int(total[at - 1]) if at else 0
            end = max(at + 1, int(total.searchsorted(done + most, side="right")))
            yield batch.slice(at, end - at)
            at = end


def word_spans(text: str | None) -> list[tuple[str, int, int]]:
    """``words(text)`` with the place of each in the text as it stands: (word, start, end)."""
    if not text:
        return []
    pieces: list[tuple[str, int, int]] = []  # what stands for which stretch of the text
    at = 0
    tags = [(m.start(), m.end()) for m in _TAG.finditer(text)] if "<" in text else []
    for start, end in [*tags, (len(text), len(text))]:
        part, done = text[at:start], 0
        for m in _ENTITY.finditer(part):
            pieces += [(c, at + i, at + i + 1) for i, c in enumerate(part[done : m.start()], done)]
            pieces.append((html.unescape(m.group()), at + m.start(), at + m.end()))
            done = m.end()
        pieces += [(c, at + i, at + i + 1) for i, c in enumerate(part[done:], done)]
        if end > start:
            pieces.append((" ", start, end))
        at = end
    out: list[tuple[str, int, int]] = []
    word, first, last = "", 0, 0
    for c, s, e in pieces:
        for x in _plain(c):
            if x.isalnum():
                if not word:
                    first = s
                word, last = word + x, e
            elif word:
                out.append((word, first, last))
                word = ""
    if word:
        out.append((word, first, last))
    return out
