"""Operator 5, quality rules: repetition measured on suffix arrays of words.

Per text a suffix array over its words is built by prefix doubling (all texts
of a chunk at once: the first rank holds the text's number, so no order or
match crosses texts). Neighbouring suffixes' longest common prefixes give, for
each position, the longest substring that begins there and occurs elsewhere in
the text: that of the deepest LCP interval that holds the suffix, whose span
takes in those of the intervals around it. So these spans united are the union
over all maximal repeated substrings, and the longest is a maximal one. The
covered fraction and the longest repeat are limited.

Nulls and empty texts have no words, fail the base rule and are not kept; rows
are independent, so repeated rows and ids get equal results; other columns of
the input pass through ``quality_rules`` untouched. An empty table gives an
empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tokens
from .common import in_batches, pieces

#: Words that a repeat must have to count, the most per cent of the text's words that such repeats may cover, and the words and the per cent of the text at which one repeat is too long, and the words at which it is in any text.
MIN_REPEAT, COVERED_PERCENT, LONG_WORDS, LONG_PERCENT, MOST_WORDS = 15, 15, 40, 10, 200
WINDOW = 5
#: Bytes whose suffixes are sorted at once.
CHUNK_BYTES = 1 << 19
_SYMBOL = np.zeros(256, dtype=np.int64)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = 1
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "covered_words", "longest_repeat")


def suffix_ranks(keys: np.ndarray, end: np.ndarray) -> list[np.ndarray]:
    """Ranks of all suffixes by their first 1, 2, 4, ... words.

    ``end[i]`` is the end of the text that holds word ``i``. Equal ranks at
    level k mean that 2**k words agree. The last level's ranks are unique: the
    place in the suffix array. Only suffixes that still share a rank are sorted
    at a level.
    """
    n = len(keys)
    order = np.argsort(keys, kind="stable")
    fresh = np.ones(n, dtype=bool)
    fresh[1:] = keys[order[1:]] != keys[order[:-1]]
    first = np.maximum.accumulate(np.where(fresh, np.arange(n), 0))
    rank = np.empty(n, dtype=np.int32)  # a level is kept for each doubling
    rank[order] = first
    levels, step = [rank], 1
    shared = ~fresh
    shared[:-1] |= ~fresh[1:]
    active = order[shared]
    while len(active):
        ahead = active + step
        inside = ahead < end[active]
        second = np.zeros(len(active), dtype=np.int64)
        second[inside] = rank[ahead[inside]] + 1
        key = rank[active].astype(np.int64) * np.int64(n + 2) + second
        by = np.argsort(key, kind="stable")
        active, key = active[by], key[by]
        group = rank[active]
        fresh = np.ones(len(active), dtype=bool)
        fresh[1:] = key[1:] != key[:-1]
        head = np.ones(len(active), dtype=bool)
        head[1:] = group[1:] != group[:-1]
        at = np.arange(len(active))
        new = group + np.maximum.accumulate(np.where(fresh, at, 0)) - np.maximum.accumulate(np.where(head, at, 0))
        rank = rank.copy()
        rank[active] = new
        levels.append(rank)
        shared = ~fresh
        shared[:-1] |= ~fresh[1:]
        active = active[shared]
        step *= 2
    return levels


def longest_repeats(levels: list[np.ndarray], end: np.ndarray) -> np.ndarray:
    """For each word, the length of the longest substring beginning there that occurs again in its text."""
    n = len(end)
    out = np.zeros(n, dtype=np.int64)
    if n < 2:
        return out
    order = np.empty(n, dtype=np.int64)
    order[levels[-1]] = np.arange(n)
    low, high = order[:-1], order[1:]
    pick = np.flatnonzero(levels[0][low] == levels[0][high])
    a, b = low[pick], high[pick]
    common = np.zeros(len(a), dtype=np.int64)
    for k in range(len(levels) - 1, -1, -1):
        x, y = a + common, b + common
        inside = np.flatnonzero((x < end[a]) & (y < end[b]))
        same = inside[levels[k][x[inside]] == levels[k][y[inside]]]
        common[same] += 1 << k
    np.maximum.at(out, a, common)
    np.maximum.at(out, b, common)
    return out


def covered(length: np.ndarray, least: int) -> np.ndarray:
    """Which words lie in a span ``i:i + length[i]`` with ``length[i] >= least``."""
    n = len(length)
    edge = np.zeros(n + 1, dtype=np.int64)
    at = np.flatnonzero(length >= least)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + length[at], -1)
    return np.cumsum(edge[:-1]) > 0


def _duplicate_lines(chunk: tokens.Chunk, word_hash: np.ndarray) -> np.ndarray:
    """Lines (between \\n) with a word that equal an earlier line of their text, byte by byte."""
    data, rows = chunk.data, chunk.last - chunk.first
    if not len(data):
        return np.zeros(rows, dtype=np.int64)
    breaks = np.flatnonzero(data == 10)
    starts = np.concatenate([chunk.offsets[:-1], breaks + 1])
    ends = np.concatenate([chunk.offsets[1:], breaks])
    starts.sort(kind="stable")
    ends.sort(kind="stable")
    has = np.searchsorted(chunk.starts, ends) > np.searchsorted(chunk.starts, starts)
    starts, ends = starts[has], ends[has]
    row = np.searchsorted(chunk.offsets, starts, side="right") - 1
    line = tokens.Chunk(0, 0, data, chunk.offsets, starts, ends, chunk.word_ptr).hashes(fold=False)
    key = tokens.mix(line + row.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    _, first = np.unique(key, return_index=True)
    again = np.ones(len(key), dtype=np.int64)
    again[first] = 0
    return np.bincount(row, weights=again, minlength=rows).astype(np.int64)


def measure(column: pa.Array) -> dict[str, np.ndarray]:
    """The measures of each text of the column."""
    parts: dict[str, list[np.ndarray]] = {k: [] for k in MEASURES}
    for chunk in tokens.chunks(column, CHUNK_BYTES):
        ptr, rows = chunk.word_ptr, chunk.last - chunk.first
        word_hash = chunk.hashes(fold=False)
        n = len(word_hash)
        lead = np.zeros(len(chunk.data) + 1, dtype=np.int64)
        np.cumsum((chunk.data & 0xC0) != 0x80, out=lead[1:])
        end = np.repeat(ptr[1:], np.diff(ptr))
        key = tokens.mix(word_hash + (chunk.word_rows().astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))
        if n:
            length = longest_repeats(suffix_ranks(key, end), end)
        else:
            length = np.zeros(0, dtype=np.int64)
        longest = np.zeros(rows, dtype=np.int64)
        np.maximum.at(longest, chunk.word_rows(), length)
        for k, v in (
            ("n_words", np.diff(ptr)),
            ("word_chars", tokens.sums(lead[chunk.ends] - lead[chunk.starts], ptr)),
            ("n_symbols", tokens.sums(_SYMBOL[chunk.data], chunk.offsets)),
            ("n_dup_lines", _duplicate_lines(chunk, word_hash)),
            ("n_repeat_words", tokens.sums(covered(length, WINDOW).astype(np.int64), ptr)),
            ("covered_words", tokens.sums(covered(length, MIN_REPEAT).astype(np.int64), ptr)),
            ("longest_repeat", longest),
        ):
            parts[k].append(v.astype(np.int64))
    return {k: np.concatenate(v) if v else np.zeros(0, dtype=np.int64) for k, v in parts.items()}


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        got = measure(batch.column(batch.num_columns - 1))
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *(pa.array(got[k]) for k in MEASURES)], names=[*batch.schema.names[:-1], *MEASURES])


def verdict(min_words: int = 10, max_repeat_percent: int = 20) -> tuple:
    """Columns base_failed and kept over the measures."""
    base = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))
    long = (F.col("longest_repeat") >= MOST_WORDS) | (F.col("longest_repeat") >= LONG_WORDS) & (100 * F.col("longest_repeat") > LONG_PERCENT * F.col("n_words"))
    wide = 100 * F.col("covered_words") > COVERED_PERCENT * F.col("n_words")
    return base, ~base & ~long & ~wide


def repetition(docs: DataFrame, keys: list[str] | None = None, text: str = "text") -> DataFrame:
    """``keys`` (default doc_id) of each row with its measures, base_failed and kept."""
    keys = ["doc_id"] if keys is None else keys
    schema = ", ".join([*(f"`{k}` {docs.schema[k].dataType.simpleString()}" for k in keys), *(f"{m} bigint" for m in MEASURES)])
    base, kept = verdict()
    return in_batches(docs.select(*(F.col(f"`{k}`") for k in keys), F.col(text).alias("__text")), _measured, schema, keeps=True).withColumn("base_failed", base).withColumn("kept", kept)


def _filtered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches):
        got = measure(batch.column(batch.schema.get_field_index("text")))
        words = got["n_words"]
        base = (words < 10) | (100 * got["n_repeat_words"] > 20 * words)
        long = (got["longest_repeat"] >= MOST_WORDS) | (got["longest_repeat"] >= LONG_WORDS) & (100 * got["longest_repeat"] > LONG_PERCENT * words)
        yield batch.filter(pa.array(~base & ~long & ~(100 * got["covered_words"] > COVERED_PERCENT * words)))


def quality_rules(docs: DataFrame) -> DataFrame:
    """The rows whose text passes; all columns stay as they are."""
    return in_batches(docs, _filtered, docs.schema)
