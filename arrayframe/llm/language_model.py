"""Operator 10, language-model scoring: a weighted backoff automaton over all n-grams seen twice.

States are the root, words and word pairs; arcs are the n-grams up to three
words that training holds ``MIN_COUNT`` times or more, at every size of the
input, with absolute discounting; a state's failure arc leads to its longest
proper suffix and carries the backoff weight, so the probabilities after each
state sum to one. The root holds the smoothed word counts of the whole training
corpus, (c + 0.5) / (N + 0.5 (V + 1)).

The automaton grows with the corpus, so it is never in one place. Texts are
gathered in segments of about ``SEGMENT`` tokens. A segment sends the hashes of
its distinct words and pairs with their training counts to buckets of hashes; a
bucket sums them and answers with the counts over all segments, in the order
asked, and with a number for each word and pair that is kept. Triples follow in
the same way: those of two kept pairs, as no other can occur ``MIN_COUNT`` times.
For each n-gram one segment is told to speak for it; a third exchange, by those
numbers, sums what a state's arcs take of its probability and of its suffix's, in
whole halves of a count, so that no order of summing shows. From the two sums
comes a failure arc's weight. Each segment then holds the part of the automaton
that its texts can reach, and scores them. Only two numbers a bucket reach the
driver.

A text is scored in one pass from left to right that carries the automaton's
state (root, word or pair): a token follows its state's arc or else failure arcs
until one is found, and each arc adds its log. A segment's texts walk side by
side, in pieces of ``PIECE`` tokens; a piece inside a text first walks the two
tokens before it, which settle its state.

Null text counts as empty: one end token. A null doc_id belongs to the training
part. Rows that repeat each get their score (and each count in training). An
empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import gc
import math
import pickle
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tokens
from .common import crc_remainder, in_batches, partitions_for, stored

MIN_COUNT, DISCOUNT = 2, 0.5
#: No word or n-gram is cut by a share; the tests of rare words still set it.
WORD_SHARE = 0.0
#: Tokens of a segment.
SEGMENT = 1 << 20
#: Tokens of a text that one lane walks.
PIECE = 256
END = np.uint64(0x5BD1E9955BD1E995)
TEXTS, WORDS, PAIRS, TRIPLES, WORD_STATES, PAIR_STATES, TOTALS = range(7)
_ROW = "seg bigint, bucket int, kind int, a binary, b binary"


def token_runs(chunk: tokens.Chunk) -> tuple[np.ndarray, np.ndarray]:
    """Token hashes, each row's words and its end, and each row's run among them."""
    h, ptr = chunk.hashes(fold=True), chunk.word_ptr
    out = np.full(len(h) + len(ptr) - 1, END, dtype=np.uint64)
    out[np.arange(len(h)) + chunk.word_rows()] = h
    return out, ptr + np.arange(len(ptr))


def word_ids(words: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Places of ``h`` in the sorted ``words``; -1 for others."""
    at = np.searchsorted(words, h)
    at[at == len(words)] = 0
    return np.where(words[at] == h, at, -1) if len(words) else np.full(len(h), -1)


def ngram_keys(ids: np.ndarray, runs: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """For each token the key of the pair and of the triple that end with it, -1 where a word is rare or the text begins."""
    n = len(ids)
    place = np.arange(n) - np.repeat(runs[:-1], np.diff(runs))
    pair, triple = np.full(n, -1, dtype=np.int64), np.full(n, -1, dtype=np.int64)
    if n > 1:
        ok = (place[1:] >= 1) & (ids[1:] >= 0) & (ids[:-1] >= 0)
        pair[1:][ok] = ids[:-1][ok] * np.int64(size) + ids[1:][ok]
    if n > 2:
        ok = (place[2:] >= 2) & (pair[2:] >= 0) & (pair[1:-1] >= 0)
        triple[2:][ok] = (ids[:-2][ok] * np.int64(size) + ids[1:-1][ok]) * np.int64(size) + ids[2:][ok]
    return pair, triple


@dataclass
class Automaton:
    """States: -1 the root, then words, then pairs. A state's arcs lie together in a sorted table."""

    words: np.ndarray  # sorted hashes of the words; a word's place is its state
    word_log: np.ndarray  # log10(c + 0.5)
    word_known: np.ndarray
    root_log: float  # log10(N + 0.5 (V + 1))
    pairs: np.ndarray  # arcs of the words: state * number of words + word; a pair's place, after the words, is the state it leads to
    pair_log: np.ndarray
    triples: np.ndarray  # arcs of the pairs: place of the pair * number of words + word
    triple_log: np.ndarray
    triple_to: np.ndarray  # place of the pair that an arc leads to
    word_back: np.ndarray  # log10 of the failure arcs' weights
    pair_back: np.ndarray

    def score(self, h: np.ndarray, runs: np.ndarray) -> dict[str, np.ndarray]:
        """Sums over each run of tokens; the root's denominator comes later, ``n_root`` times."""
        ids = word_ids(self.words, h)
        word_part = np.where(ids >= 0, _take(self.word_log, ids), 0.0)
        log, at_root = self.walk(ids, runs, word_part)
        return {
            "n_tokens": np.diff(runs),
            "n_known": _run_sums(np.where(ids >= 0, _take(self.word_known, ids), 0), runs),
            "base_part": _run_sums(word_part, runs),
            "score_part": _run_sums(log, runs),
            "n_root": _run_sums(at_root.astype(np.int64), runs),
        }

    def walk(self, ids: np.ndarray, runs: np.ndarray, word_part: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """What each token adds, and whether its arc left the root."""
        log, at_root = np.zeros(len(ids)), np.zeros(len(ids), dtype=bool)
        pieces = -(-np.diff(runs) // PIECE)
        run = np.repeat(np.arange(len(pieces)), pieces)
        begin = runs[run] + (np.arange(len(run)) - np.repeat(np.cumsum(pieces) - pieces, pieces)) * PIECE
        end = np.minimum(begin + PIECE, runs[run + 1])
        enter = np.maximum(begin - 2, runs[run])
        by = np.argsort(enter - end, kind="stable")  # long walks first: lanes that still walk are the first ones
        begin, end, enter = begin[by], end[by], enter[by]
        state, left = np.full(len(by), -1, dtype=np.int64), enter - end
        for step in range(-int(left.min(initial=0))):
            walking = int(np.searchsorted(left, -step, side="left"))
            at = enter[:walking] + step
            state, add, root = self.follow(state[:walking], ids[at], word_part[at])
            own = at >= begin[:walking]
            log[at[own]], at_root[at[own]] = add[own], root[own]
        return log, at_root

    def follow(self, state: np.ndarray, word: np.ndarray, word_part: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The states after ``word``, the logs of the arcs on the way, and which of them passed the root."""
        size = len(self.words)
        to, add = word.copy(), np.zeros(len(word))
        lane = np.flatnonzero(state >= size)
        found = self._along(lane, state[lane] - size, word, self.triples, self.triple_log, add)
        hit, miss = found >= 0, found < 0
        to[lane[hit]] = size + self.triple_to[found[hit]]
        pair = state[lane[miss]] - size
        add[lane[miss]] += _take(self.pair_back, pair)
        here = state.copy()
        here[lane[miss]] = self.pairs[pair] % size if len(pair) else pair
        lane = np.concatenate([np.flatnonzero((state >= 0) & (state < size)), lane[miss]])
        found = self._along(lane, here[lane], word, self.pairs, self.pair_log, add)
        hit, miss = found >= 0, found < 0
        to[lane[hit]] = size + found[hit]
        add[lane[miss]] += _take(self.word_back, here[lane[miss]])
        root = state < 0
        root[lane[miss]] = True
        add[root] += word_part[root]
        return to, add, root

    def _along(self, lane: np.ndarray, state: np.ndarray, word: np.ndarray, arcs: np.ndarray, logs: np.ndarray, add: np.ndarray) -> np.ndarray:
        """The arcs that lead on from ``state``, -1 for none; theirs is added to ``add``."""
        w = word[lane]
        found = np.where(w >= 0, word_ids(arcs, state * np.int64(len(self.words)) + w), -1)
        add[lane[found >= 0]] += logs[found[found >= 0]]
        return found


def _take(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    return values[np.maximum(at, 0)] if len(values) else np.zeros(len(at))


def _run_sums(values: np.ndarray, runs: np.ndarray) -> np.ndarray:
    return np.add.reduceat(values, runs[:-1]) if len(runs) > 1 else np.zeros(0, dtype=values.dtype)


@dataclass
class Arcs:
    """Kept n-grams with their counts: sorted keys of the pairs, and triples as a pair's place and a word, sorted."""

    words: np.ndarray
    counts: np.ndarray
    pairs: np.ndarray
    pair_counts: np.ndarray
    state: np.ndarray
    last: np.ndarray
    triple_counts: np.ndarray
    root: float

    def __post_init__(self) -> None:
        size = np.int64(len(self.words))
        self.first, self.second = (self.pairs // size, self.pairs % size) if len(self.pairs) else (self.pairs, self.pairs)
        self.p2 = (self.pair_counts - DISCOUNT) / np.maximum(self.counts[self.first], 1)
        self.p3 = (self.triple_counts - DISCOUNT) / _take(self.pair_counts, self.state)
        # a triple's last two words are kept too: they occur at least as often
        self.tail = word_ids(self.pairs, self.second[self.state] * size + self.last)

    def sums(self, pair_share: int | np.ndarray = 1, triple_share: int | np.ndarray = 1) -> tuple[tuple[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]:
        """Of the words, then of the pairs: what each one's arcs take of its probability, and what the same words have in its suffix.

        In halves of a count, over the denominators in ``backs``: whole numbers.
        """
        words, pairs = len(self.words), len(self.pairs)
        add = lambda at, values, n: np.bincount(at, values, n).astype(np.int64)
        less = int(2 * DISCOUNT)
        of_words = add(self.first, (2 * self.pair_counts - less) * pair_share, words), add(self.first, (2 * self.counts[self.second] + 1) * pair_share, words)
        of_pairs = add(self.state, (2 * self.triple_counts - less) * triple_share, pairs), add(self.state, (2 * _take(self.pair_counts, self.tail) - less) * triple_share, pairs)
        return of_words, of_pairs

    def backs(self, of_words: tuple[np.ndarray, np.ndarray], of_pairs: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """log10 of the failure arcs' weights of words and pairs."""
        own = np.maximum(self.counts, 1)
        return backoff(of_words[0] / (2 * own), of_words[1] / (2 * self.root)), backoff(of_pairs[0] / (2 * np.maximum(self.pair_counts, 1)), of_pairs[1] / (2 * own[self.second]))

    def automaton(self, word_back: np.ndarray, pair_back: np.ndarray) -> Automaton:
        key = self.state * np.int64(len(self.words)) + self.last
        return Automaton(self.words, np.log10(self.counts + 0.5), (self.counts > 0).astype(np.int64), math.log10(self.root), self.pairs, np.log10(self.p2), key, np.log10(self.p3), self.tail, word_back, pair_back)


def backoff(taken: np.ndarray, lower: np.ndarray) -> np.ndarray:
    """log10 of the failure arcs' weights."""
    return np.log10(np.maximum(1 - taken, 1e-12)) - np.log10(np.maximum(1 - lower, 1e-12))


def root_of(total: int, distinct: int) -> float:
    return total + 0.5 * (distinct + 1)


def build(words: np.ndarray, counts: np.ndarray, pairs: np.ndarray, pair_counts: np.ndarray, triples: np.ndarray, triple_counts: np.ndarray, total: int, distinct: int) -> Automaton:
    """The whole automaton from exact counts; keys and counts are sorted by key."""
    size = np.int64(len(words))
    arcs = Arcs(words, counts, pairs, pair_counts, word_ids(pairs, triples // size), triples % size, triple_counts, root_of(total, distinct))
    return arcs.automaton(*arcs.backs(*arcs.sums()))


def pack(values: np.ndarray) -> bytes:
    """An array as compressed bytes, plane by plane, as upper planes are mostly empty; integers in the least width."""
    if values.dtype.kind in "iu" and len(values):
        values = values.astype(np.min_scalar_type(int(values.max())))
    planes = np.ascontiguousarray(values).view(np.uint8).reshape(-1, values.itemsize).T.tobytes()
    return values.dtype.char.encode() + len(planes).to_bytes(8, "little") + pa.compress(planes, codec="zstd", asbytes=True)


def unpack(data: bytes) -> np.ndarray:
    kind = np.dtype(data[:1].decode())
    planes = pa.decompress(data[9:], decompressed_size=int.from_bytes(data[1:9], "little"), codec="zstd", asbytes=True)
    return np.ascontiguousarray(np.frombuffer(planes, dtype=np.uint8).reshape(kind.itemsize, -1).T).reshape(-1).view(kind)


def pack_keys(keys: np.ndarray) -> bytes:
    return pack(np.diff(keys, prepend=np.uint64(0)))


def unpack_keys(data: bytes) -> np.ndarray:
    return np.cumsum(unpack(data), dtype=np.uint64)


class Segment:
    """Texts as places in the segment's sorted word hashes, and what the answers tell of their n-grams."""

    def __init__(self, data: bytes):
        self.doc_id, self.null, self.train, words, ids, self.runs = pickle.loads(data)
        order = np.argsort(words)
        place = np.empty(len(order), dtype=np.int64)
        place[order] = np.arange(len(order))
        self.words, self.ids, size = words[order], place[unpack(ids)], np.int64(len(words))
        self.token_train = np.repeat(self.train, np.diff(self.runs))
        key = ngram_keys(self.ids, self.runs, size)[0]
        at = key >= 0
        self.state = np.full(len(key), -1, dtype=np.int64)
        self.pairs, self.state[at] = np.unique(key[at], return_inverse=True)
        self.pair_hash = _join(self.words[self.pairs // size], self.words[self.pairs % size])
        self.pair_order = np.argsort(self.pair_hash)

    def trained(self) -> tuple[np.ndarray, np.ndarray]:
        """Training counts of the words and of the pairs."""
        state = self.state[self.token_train]
        return np.bincount(self.ids[self.token_train], minlength=len(self.words)), np.bincount(state[state >= 0], minlength=len(self.pairs))

    def keep_pairs(self, answers: dict[int, np.ndarray]) -> None:
        """Takes the counts of words and pairs; finds the triples of two kept pairs."""
        size = np.int64(len(self.words))
        told = _in_order(answers[PAIRS], self.pair_order)
        kept = told > 0
        place = np.where(kept, np.cumsum(kept) - 1, -1)
        #: places of the kept pairs in the order of their hashes, as their numbers come
        self.kept_order = place[self.pair_order][kept[self.pair_order]]
        self.pairs, self.pair_hash, told = self.pairs[kept], self.pair_hash[kept], told[kept]
        self.counts, self.pair_counts, self.pair_speaks = answers[WORDS] >> 1, told >> 1, told & 1
        state = np.where(self.state >= 0, _take(place, self.state).astype(np.int64), -1)
        before = np.full(len(state), -1, dtype=np.int64)
        before[1:] = state[:-1]
        before[self.runs[:-1]] = -1
        at = (before >= 0) & (state >= 0)
        self.triples, of = np.unique(before[at] * size + self.ids[at], return_inverse=True)
        self.triple_train = np.bincount(of[self.token_train[at]], minlength=len(self.triples))
        self.triple_hash = _join(_take(self.pair_hash, self.triples // size), self.words[self.triples % size]) if len(self.triples) else np.zeros(0, dtype=np.uint64)
        self.triple_order = np.argsort(self.triple_hash)

    def arcs(self, answers: dict[int, np.ndarray], root: float) -> tuple[Arcs, np.ndarray]:
        """The kept n-grams, and for which triples this segment speaks."""
        size = np.int64(len(self.words))
        told = _in_order(answers[TRIPLES], self.triple_order)
        triples, told = self.triples[told > 0], told[told > 0]
        return Arcs(self.words, self.counts, self.pairs, self.pair_counts, triples // size, triples % size, told >> 1, root), told & 1

    def ask_states(self, arcs: Arcs, speaks: np.ndarray, answers: dict[int, np.ndarray], seg: int, buckets: int) -> Iterator[pa.RecordBatch]:
        """What this segment adds to the sums of its words and kept pairs, by their numbers."""
        of_words, of_pairs = arcs.sums(self.pair_speaks, speaks)
        known, order = self.counts > 0, self.kept_order
        yield from _asked(seg, WORD_STATES, self.words[known], [x[known] for x in of_words], buckets, answers[-WORDS])
        yield from _asked(seg, PAIR_STATES, self.pair_hash[order], [x[order] for x in of_pairs], buckets, answers[-PAIRS])

    def backs(self, arcs: Arcs, answers: dict[int, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """log10 of the failure arcs' weights, from the sums over all segments."""
        of_words, of_pairs = np.zeros((2, len(self.words))), np.zeros((2, len(self.pairs)))
        of_words[:, self.counts > 0] = answers[WORD_STATES]
        of_pairs[:, self.kept_order] = answers[PAIR_STATES]
        return arcs.backs(tuple(of_words), tuple(of_pairs))


def _in_order(answer: np.ndarray, order: np.ndarray) -> np.ndarray:
    out = np.zeros(len(order), dtype=np.int64)
    out[order] = answer
    return out


def _join(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hashes of what ``b`` follows ``a`` makes."""
    return tokens.mix(a * np.uint64(0x9E3779B97F4A7C15) + (b ^ np.uint64(0xD6E8FEB86659FD93)))


def _segments(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        held: list[tuple] = []

        def segment() -> pa.RecordBatch:
            nonlocal number
            doc_id, null, train, h, lengths = (np.concatenate(x) for x in zip(*held, strict=True))
            words, ids, counts = np.unique(h, return_inverse=True, return_counts=True)
            by = np.argsort(-counts, kind="stable")  # frequent words get small numbers, which pack well
            rank = np.empty(len(by), dtype=np.int64)
            rank[by] = np.arange(len(by))
            data = pickle.dumps((doc_id, null, train, words[by], pack(rank[ids]), np.concatenate([[0], np.cumsum(lengths)])))
            held.clear()
            number += 1
            return _row(number, -1, TEXTS, data, None)

        for batch in batches:
            for chunk in tokens.chunks(batch.column("text")):
                h, runs = token_runs(chunk)
                rows = batch.slice(chunk.first, chunk.last - chunk.first)
                doc_id = rows.column("doc_id")
                held.append((doc_id.fill_null(0).to_numpy(zero_copy_only=False), doc_id.is_null().to_numpy(zero_copy_only=False), rows.column("train").to_numpy(zero_copy_only=False), h, np.diff(runs)))
                if sum(len(x[3]) for x in held) >= least:
                    yield segment()
        if held:
            yield segment()

    return run


def _row(seg: int, bucket: int, kind: int, a: bytes, b: bytes | None) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([seg], pa.int64()), pa.array([bucket], pa.int32()), pa.array([kind], pa.int32()), pa.array([a], pa.binary()), pa.array([b], pa.binary())], names=["seg", "bucket", "kind", "a", "b"])


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(batch.column(c).to_pylist() for c in ("seg", "bucket", "kind", "a", "b")), strict=True)


def _asked(seg: int, kind: int, hashes: np.ndarray, values: list[np.ndarray], buckets: int, numbers: np.ndarray | None = None) -> Iterator[pa.RecordBatch]:
    """Sorted hashes, or the numbers that stand for them, and their values, dealt to buckets by the hashes' upper bits."""
    of = ((hashes >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)
    cut = np.searchsorted(of, np.arange(buckets + 1, dtype=np.uint64))
    for bucket in range(buckets):
        at = slice(cut[bucket], cut[bucket + 1])
        if at.start < at.stop:
            yield _row(seg, bucket, kind, pack_keys((hashes if numbers is None else numbers)[at].astype(np.uint64)), pack_values([v[at] for v in values]))


def pack_values(values: list[np.ndarray]) -> bytes:
    """Whole numbers from zero on, most of them zero."""
    some = np.any([v != 0 for v in values], axis=0)
    return pickle.dumps((len(some), np.packbits(some).tobytes(), *(pack(v[some]) for v in values)))


def unpack_values(data: bytes) -> np.ndarray:
    n, some, *values = pickle.loads(data)
    at = np.unpackbits(np.frombuffer(some, dtype=np.uint8), count=n).astype(bool)
    out = np.zeros((len(values), n), dtype=np.int64)
    for o, v in zip(out, values, strict=True):
        o[at] = unpack(v)
    return out


def _ask_pairs(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for seg, _, _, data, _ in _rows(batches):
            s = Segment(data)
            words, pairs = s.trained()
            yield from _asked(seg, WORDS, s.words, [words], buckets)
            yield from _asked(seg, PAIRS, s.pair_hash[s.pair_order], [pairs[s.pair_order]], buckets)

    return run


def _ask_triples(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for seg, s, answers in _gathered(batches):
            s.keep_pairs(answers)
            yield from _asked(seg, TRIPLES, s.triple_hash[s.triple_order], [s.triple_train[s.triple_order]], buckets)

    return run


def _ask_states(root: float, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for seg, s, answers in _gathered(batches):
            s.keep_pairs(answers)
            yield from s.ask_states(*s.arcs(answers, root), answers, seg, buckets)

    return run


def _answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums the values of a key over all segments and answers each segment in the order it asked.

    A count is answered twice over, plus one to the segment that speaks for its key;
    b: the numbers of the words and pairs that are kept. Totals: training tokens and
    distinct words.
    """
    asked = defaultdict(list)
    for seg, bucket, kind, keys, values in _rows(batches):
        asked[kind].append((seg, bucket, unpack_keys(keys), unpack_values(values)))
    for kind, got in asked.items():
        all_keys, cut = np.concatenate([x[2] for x in got]), np.cumsum([0, *(len(x[2]) for x in got)])
        values = np.concatenate([x[3] for x in got], axis=1)
        if kind in (WORD_STATES, PAIR_STATES):
            at = all_keys.astype(np.int64)
            sums = [np.bincount(at, v).astype(np.int64) for v in values]
            for (seg, bucket, *_), a, b in zip(got, cut[:-1], cut[1:], strict=True):
                yield _row(seg, bucket, kind, pack_values([x[at[a:b]] for x in sums]), None)
            continue
        keys, first, at = np.unique(all_keys, return_index=True, return_inverse=True)
        count = np.bincount(at, values[0], len(keys)).astype(np.int64)
        if kind == WORDS:
            yield _row(-1, got[0][1], TOTALS, b"", pickle.dumps((int(count.sum()), int((count > 0).sum()))))
        else:
            count[count < MIN_COUNT] = 0
        number = np.cumsum(count > 0) - 1
        answer = 2 * count[at]
        answer[first[count > 0]] += 1
        for (seg, bucket, *_), a, b in zip(got, cut[:-1], cut[1:], strict=True):
            kept = number[at[a:b]][answer[a:b] > 0]
            yield _row(seg, bucket, kind, pack(answer[a:b]), None if kind == TRIPLES else pack_keys(kept.astype(np.uint64)))


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, Segment, dict[int, np.ndarray]]]:
    """Each segment with the answers it got, those of a kind in the order of buckets.

    Rows come by segment and bucket, the texts first; the numbers of what is kept
    are under the kind's negative.
    """
    seg, texts, parts = None, b"", {}

    def whole() -> tuple[int, Segment, dict[int, np.ndarray]]:
        empty = lambda k: np.zeros((2, 0) if k in (WORD_STATES, PAIR_STATES) else 0, dtype=np.int64)
        return seg, Segment(texts), {k: np.concatenate(v, axis=-1) if v else empty(k) for k, v in parts.items()}

    for number, _, kind, data, more in _rows(batches):
        if kind == TEXTS:
            if seg is not None:
                yield whole()
            seg, texts, parts = number, data, {k: [] for k in (WORDS, -WORDS, PAIRS, -PAIRS, TRIPLES, WORD_STATES, PAIR_STATES)}
        elif kind in (WORD_STATES, PAIR_STATES):
            parts[kind].append(unpack_values(data))
        else:
            parts[kind].append(unpack(data).astype(np.int64))
            if more is not None:
                parts[-kind].append(unpack_keys(more).astype(np.int64))
    if seg is not None:
        yield whole()


def _scored(root: float):
    names = ("n_tokens", "n_known", "base_part", "score_part", "n_root")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, s, answers in _gathered(batches):
            s.keep_pairs(answers)
            arcs, _ = s.arcs(answers, root)
            got = arcs.automaton(*s.backs(arcs, answers)).score(s.words[s.ids], s.runs)
            yield pa.RecordBatch.from_arrays([pa.array(s.doc_id, pa.int64(), mask=s.null), pa.array(s.train), *(pa.array(got[k]) for k in names)], names=["doc_id", "train", *names])

    return run


def score_texts(docs: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of each row of ``docs`` (doc_id, text)."""
    buckets = partitions_for(docs.sparkSession)
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", (crc_remainder("doc_id", 5) != 1).alias("train"))
    texts = stored(in_batches(keyed, _segments(segment), _ROW, keeps=True), "lm-segments")

    def answered(run, *answers: DataFrame) -> DataFrame:
        asked = in_batches(with_answers(*answers) if answers else texts, run, _ROW, keeps=True).repartitionById(buckets, "bucket")
        out = stored(in_batches(asked, _answer, _ROW, keeps=True), "lm-answers")
        del asked
        # the exchange's files are done with; Spark deletes them once nothing refers to them, as its last job still does
        out.limit(1).count()
        gc.collect()
        docs.sparkSession.sparkContext._jvm.System.gc()
        return out

    def with_answers(*answers: DataFrame) -> DataFrame:
        rows = texts
        for x in answers:
            rows = rows.unionByName(x.where(F.col("kind") != TOTALS))
        return rows.repartition(buckets, "seg").sortWithinPartitions("seg", "bucket", "kind")

    pairs = answered(_ask_pairs(buckets))
    told = [pickle.loads(r.b) for r in pairs.where(F.col("kind") == TOTALS).select("b").toLocalIterator()]
    total, distinct = sum(x[0] for x in told), sum(x[1] for x in told)
    root = root_of(total, distinct)
    triples = answered(_ask_triples(buckets), pairs)
    states = answered(_ask_states(root, buckets), pairs, triples)
    scored = in_batches(with_answers(pairs, triples, states), _scored(root), "doc_id bigint, train boolean, n_tokens bigint, n_known bigint, base_part double, score_part double, n_root bigint", keeps=True)
    return scored.select(
        "doc_id",
        (~F.col("train")).alias("held_out"),
        "n_tokens",
        "n_known",
        F.lit(total).cast("long").alias("train_tokens"),
        (F.col("base_part") - F.col("n_tokens") * math.log10(root)).alias("base_score"),
        (F.col("score_part") - F.col("n_root") * math.log10(root)).alias("score"),
    )
