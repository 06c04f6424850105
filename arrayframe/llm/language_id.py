"""Operator 8, language identification: averaged hashed subword embeddings, linear softmax.

A text's subwords are the byte trigrams and 4-grams of its words (letters as
they are, A-Z folded, everything else a blank that only ends a subword). Each
hashes to a row of an embedding table; the mean row goes through a linear
softmax. All labelled rows but every fifth train it. They are dealt by the hash of
their id and text to shards of about ``SHARD`` texts, so that the layout of the
table makes no difference; each shard trains table and layer together by
stochastic gradient descent in numpy on an executor, and the model is the mean of
the shards' class scores a subword. A label of which a shard would get few
texts gives each of its texts to several shards. The fifth that trains nothing gives a
temperature that makes scores probabilities, and the score below which a text is
rejected. The driver gets the mean scores, and of that fifth sums and the lowest
scores.

For a linear layer the mean commutes with it, so prediction adds one row of
class scores per subword over the whole text.

Null texts and texts without a letter are 'und' with score 0. Without any
labelled row all are 'und'. Rows are independent; repeated rows agree, ties
between languages go to the first in order; other columns do not matter. An
empty table gives an empty table.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tokens
from .common import crc_remainder, in_batches, partitions_for, pieces, stored, unused

#: Texts and bytes of a shard (about), the least texts of a label that each shard gets if there are so many, and blocks of buckets in which scores are averaged.
SHARD, SHARD_BYTES, FEW, BLOCKS = 4096, 1 << 24, 64, 64
BUCKETS, SIZE, EPOCHS, STEPS, BATCH, RATE = 1 << 15, 8, 6, 500, 32, 4.0
TEMPERATURES = np.geomspace(0.25, 16, 25)
#: Share of rightly labelled texts that calibration lets be rejected.
REJECTED = 0.002
UNKNOWN = "und"
#: Bytes whose subwords are scored at once.
CHUNK_BYTES = 1 << 18
_LETTER = np.full(256, 0x20, dtype=np.uint32)
_LETTER[97:123] = np.arange(97, 123)
_LETTER[65:91] = np.arange(97, 123)
_LETTER[128:] = np.arange(128, 256)


def subwords(chunk: tokens.Chunk) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all subwords of the chunk, and the row of each."""
    b, n = _LETTER[chunk.data], len(chunk.data)
    row = np.repeat(np.arange(chunk.last - chunk.first), np.diff(chunk.offsets))
    found, rows = [], []
    for size in (3, 4):
        if n < size:
            continue
        inner = b[1 : n - size + 2] != 0x20
        for k in range(2, size - 1):
            inner &= b[k : n - size + 1 + k] != 0x20
        at = np.flatnonzero(inner & (row[: n - size + 1] == row[size - 1 :]))
        key = b[at].astype(np.uint64) + np.uint64(size << 40)
        for k in range(1, size):
            key = (key << np.uint64(8)) ^ b[at + k]
        found.append(((key * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(49)).astype(np.int64))
        rows.append(row[at])
    if not found:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    return np.concatenate(found), np.concatenate(rows)


@dataclass
class Model:
    languages: list[str]
    scores: np.ndarray  # of each bucket and language
    bias: np.ndarray
    temperature: float = 1.0
    threshold: float = 0.0

    def raw(self, column: pa.Array) -> np.ndarray:
        out = []
        for chunk in tokens.chunks(column, CHUNK_BYTES):
            at, row = subwords(chunk)
            rows = chunk.last - chunk.first
            count = np.maximum(1, np.bincount(row, minlength=rows))
            out.append(np.stack([np.bincount(row, weights=s[at], minlength=rows) for s in self.scores.T], axis=1) / count[:, None] + self.bias)
        return np.concatenate(out) if out else np.zeros((0, len(self.languages)))

    def probabilities(self, column: pa.Array) -> np.ndarray:
        return softmax(self.raw(column) * self.temperature)


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def bags_of(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Each text's buckets with their shares of its subwords."""
    for chunk in tokens.chunks(column, CHUNK_BYTES):
        at, row = subwords(chunk)
        cut = np.searchsorted(np.sort(row), np.arange(chunk.last - chunk.first + 1))
        at = at[np.argsort(row, kind="stable")]
        for lo, hi in zip(cut[:-1], cut[1:], strict=True):
            keys, count = np.unique(at[lo:hi], return_counts=True)
            yield keys.astype(np.int32), (count / max(1, hi - lo)).astype(np.float32)


def fit_bags(bags: list[tuple[np.ndarray, np.ndarray]], want: np.ndarray, languages: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Class scores of each bucket and the bias, from a shard's bags and the numbers of their labels."""
    rng = np.random.default_rng(seed)
    table = rng.normal(0, 1 / SIZE, (BUCKETS, SIZE))
    layer, bias = np.zeros((SIZE, languages)), np.zeros(languages)
    per = max(1, -(-len(bags) // BATCH))
    epochs = max(EPOCHS, -(-STEPS // per))
    steps, step = epochs * per, 0
    for _ in range(epochs):
        learn = rng.permutation(len(bags))
        for lo in range(0, len(learn), BATCH):
            rate = RATE * (1 - step / steps)
            step += 1
            pick = [i for i in learn[lo : lo + BATCH] if len(bags[i][0])]
            if not pick:
                continue
            keys, weight = (np.concatenate([bags[i][k] for i in pick]) for k in (0, 1))
            size = [len(bags[i][0]) for i in pick]
            mean = np.add.reduceat(table[keys] * weight[:, None], np.cumsum([0, *size[:-1]]), axis=0)
            off = softmax(mean @ layer + bias)
            off[np.arange(len(pick)), want[pick]] -= 1
            back = np.repeat(off @ layer.T, size, axis=0) * weight[:, None]
            layer -= rate * mean.T @ off / len(pick)
            bias -= rate * 0.01 * off.mean(axis=0)
            for d in range(SIZE):
                table[:, d] -= rate * np.bincount(keys, weights=back[:, d], minlength=BUCKETS)
    return table @ layer, bias


def _fitted(languages: int):
    """Streams rows sorted by (shard, key); yields each shard's scores in blocks of buckets, the last block its bias."""

    def model(shard: int, bags: list, want: list) -> pa.RecordBatch:
        scores, bias = fit_bags(bags, np.array(want), languages)
        parts = [*np.split(scores, BLOCKS), bias]
        n = len(parts)
        return pa.RecordBatch.from_arrays([pa.array(range(n), pa.int32()), pa.array([shard] * n, pa.int64()), pa.array([len(bags)] * n, pa.int64()), pa.array([x.tobytes() for x in parts], pa.binary())], names=["block", "shard", "n", "scores"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, bags, want = None, [], []
        for batch in batches:
            shards, labels = batch.column("shard").to_pylist(), batch.column("label").to_pylist()
            for shard, label, bag in zip(shards, labels, bags_of(batch.column("text")), strict=True):
                if shard != at and bags:
                    yield model(at, bags, want)
                    bags, want = [], []
                at = shard
                bags.append(bag)
                want.append(label)
        if bags:
            yield model(at, bags, want)

    return run


def _averaged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Streams rows sorted by (block, shard); yields each block's mean scores, shards weighed by their texts."""
    at, total, n = None, np.zeros(0), 0

    def mean() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([(total / n).tobytes()], pa.binary())], names=["block", "scores"])

    for batch in batches:
        for block, size, scores in zip(*(batch.column(c).to_pylist() for c in ("block", "n", "scores")), strict=True):
            if block != at and n:
                yield mean()
                total, n = np.zeros(0), 0
            mine = np.frombuffer(scores) * size
            at, total, n = block, total + mine if n else mine, n + size
    if n:
        yield mean()


def train(docs: DataFrame) -> Model | None:
    """Learns from text and lang of all rows whose crc32(doc_id) mod 4 is not 2."""
    labelled = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (crc_remainder("doc_id", 4) != 2))
    key = F.xxhash64(F.lit(8), "doc_id", "text")
    folds = labelled.select("lang", (F.pmod(key, F.lit(5)) == 0).alias("check"), F.octet_length("text").alias("bytes"))
    counts = folds.groupBy("lang").agg(F.count("*").alias("n"), F.count_if("check").alias("checks"), F.sum("bytes").alias("bytes")).collect()
    if not counts:
        return None
    counts.sort(key=lambda r: r.lang)
    languages, total, checks = [r.lang for r in counts], sum(r.n for r in counts), sum(r.checks for r in counts)
    apart = total >= 20 and 0 < checks < total  # else all rows serve for both
    label = F.create_map(*(F.lit(x) for i, k in enumerate(languages) for x in (k, i)))[F.col("lang")].alias("label")
    keyed = labelled.select(key.alias("key"), label, "text")
    learn, check = (keyed.where(F.pmod("key", F.lit(5)) != 0), keyed.where(F.pmod("key", F.lit(5)) == 0)) if apart else (keyed, keyed)

    shards = max(1, -(-total // SHARD), -(-sum(r.bytes for r in counts) // SHARD_BYTES))
    few = max(8, min(FEW, SHARD // (2 * len(languages))))
    times = F.create_map(*(F.lit(x) for i, r in enumerate(counts) for x in (i, min(shards, -(-shards * few // r.n)))))[F.col("label")]
    # a text's shards follow each other, so that they differ
    dealt = learn.select("key", "label", "text", F.explode(F.sequence(F.lit(0), times - 1)).alias("copy"))
    dealt = dealt.select(F.pmod(F.pmod(F.xxhash64("key"), F.lit(shards)) + F.col("copy"), F.lit(shards)).alias("shard"), "key", "label", "text")
    n = min(shards, 4 * partitions_for(docs.sparkSession))
    fitted = in_batches(dealt.repartition(n, "shard").sortWithinPartitions("shard", "key", "label"), _fitted(len(languages)), "block int, shard bigint, n bigint, scores binary")
    means = in_batches(fitted.repartition(min(BLOCKS, shards), "block").sortWithinPartitions("block", "shard"), _averaged, "block int, scores binary")
    parts = [np.frombuffer(r.scores) for r in sorted(means.collect(), key=lambda r: r.block)]
    model = Model(languages, np.concatenate(parts[:-1]).reshape(BUCKETS, len(languages)).astype(np.float32), parts[-1])
    return _calibrated(check, model)


def _calibrated(check: DataFrame, model: Model) -> Model:
    """``model`` with the temperature of the least loss over all rows of ``check`` (label, text), and the threshold that rejects few of them."""
    shared = check.sparkSession.sparkContext.broadcast(model)
    raw = stored(in_batches(check.select("label", "text"), _scored(shared), "label int, raw array<double>"), "language-scores")
    losses = in_batches(raw, _losses, "place int, loss double").groupBy("place").agg(F.sum("loss").alias("loss")).collect()
    best = min(losses, key=lambda r: (round(r.loss, 6), r.place), default=None)
    model.temperature = float(TEMPERATURES[best.place]) if best else 1.0
    right = in_batches(raw, _right(model.temperature), "p double")
    n = right.count()
    # the quantile between two of the lowest scores, as few as are rejected
    at = REJECTED * max(0, n - 1)
    low = [r.p for r in right.orderBy("p").limit(math.floor(at) + 2).collect()]
    k = math.floor(at)
    quantile = low[k] + (at - k) * (low[min(k + 1, len(low) - 1)] - low[k]) if n else 0.0
    model.threshold = float(np.clip(quantile, 1 / len(model.languages), 0.6))
    return model


def _scored(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = shared.value.raw(batch.column("text"))
            ends = pa.array(np.arange(len(raw) + 1, dtype=np.int32) * raw.shape[1])
            yield pa.RecordBatch.from_arrays([batch.column("label"), pa.ListArray.from_arrays(ends, pa.array(raw.reshape(-1)))], names=["label", "raw"])

    return run


def _rows(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    want = batch.column("label").to_numpy(zero_copy_only=False)
    return want, np.array(batch.column("raw").to_pylist(), dtype=float).reshape(len(want), -1)


def _losses(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        want, raw = _rows(batch)
        if len(want):
            loss = [-np.log(np.maximum(softmax(raw * t)[np.arange(len(want)), want], 1e-12)).sum() for t in TEMPERATURES]
            yield pa.RecordBatch.from_arrays([pa.array(range(len(loss)), pa.int32()), pa.array(loss, pa.float64())], names=["place", "loss"])


def _right(temperature: float):
    """The probabilities of the labels that are found rightly."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            want, raw = _rows(batch)
            if len(want):
                p = softmax(raw * temperature)
                yield pa.RecordBatch.from_arrays([pa.array(p.max(axis=1)[p.argmax(axis=1) == want])], names=["p"])

    return run


def _predicted(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Model = shared.value
        for batch in batches:
            p = model.probabilities(batch.column("text"))
            best = p.argmax(axis=1)
            letters = batch.column("letters").to_numpy(zero_copy_only=False)
            found = [model.languages[i] if ok else UNKNOWN for i, ok in zip(best, letters, strict=True)]
            score = np.where(letters, p[np.arange(len(p)), best], 0.0)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in batch.schema.names[:-2]), pa.array(found, pa.string()), pa.array(score), pa.array(letters & (score >= model.threshold))], names=[*batch.schema.names[:-2], "lang_pred", "score", "accepted"])

    return run


def _letters():
    return F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))


def identify(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """doc_id, held_out, lang_pred, score and accepted of each row."""
    model = model or train(docs)
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (crc_remainder("doc_id", 4) == 2).alias("held_out"), "text", _letters().alias("letters"))
    if model is None:
        return keyed.select("doc_id", "held_out", F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(False).alias("accepted"))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return in_batches(keyed, _predicted(shared), "doc_id bigint, held_out boolean, lang_pred string, score double, accepted boolean")


def _accepting(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Model = shared.value
        for batch in pieces(batches):
            p = model.probabilities(batch.column(batch.schema.get_field_index("text")))
            letters = batch.column(batch.num_columns - 1).to_numpy(zero_copy_only=False)
            yield batch.select(batch.schema.names[:-1]).filter(pa.array(letters & (p.max(axis=1) >= model.threshold)))

    return run


def identified(docs: DataFrame) -> DataFrame:
    """The rows whose language is found with enough certainty; all columns stay as they are."""
    model = train(docs)
    if model is None:
        return docs.where(F.lit(False))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return in_batches(docs.withColumn(unused(docs.columns, "letters"), _letters()), _accepting(shared), docs.schema)
