"""Operator 4, packing: concatenate and cut.

First pass: each partition tokenises its texts and numbers its tokens from 0;
ids are written to the shared folder, so the order is fixed from then on. The
partitions' totals, one number each, are summed up to global offsets. Second
pass: each document knows its global place and is cut where windows of
``window`` tokens end; a document across a boundary leaves a record on either
side. Only the last window can be short.

Null text counts as empty: one token, the end. Rows that repeat are packed each.
An empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import base64
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import in_batches, stored

WINDOW, END_ID = 2048, 1
MARK = "<|endoftext|>"
#: Characters on which the two tokeniser libraries' character classes are the same beyond doubt.
_PLAIN = re.compile("[^\x00-\x7f¡-ɏ]")
_encoders: dict[tuple[str, str], object] = {}


class Encoder:
    """ids of the tokenizers file; plain text goes through the same vocabulary in tiktoken, which is quicker."""

    def __init__(self, tokenizer_file: str, ranks_file: str):
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        self.exact = Tokenizer.from_file(tokenizer_file)
        #: the least unsigned type that holds the vocabulary's ids
        self.type = "<u2" if self.exact.get_vocab_size(with_added_tokens=True) <= 1 << 16 else "<u4"
        with open(ranks_file, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.quick = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def ids(self, text: str) -> list[int]:
        if MARK in text or _PLAIN.search(text):
            return self.exact.encode(text, add_special_tokens=False).ids
        return self.quick.encode_ordinary(text)


def encoder(tokenizer_file: str | None, ranks_file: str | None) -> Encoder:
    import public_tokenizers

    files = (tokenizer_file or str(public_tokenizers.path("byte_bpe_50k.json")), ranks_file or str(public_tokenizers.path("byte_bpe_50k.tiktoken")))
    if files not in _encoders:
        _encoders[files] = Encoder(*files)
    return _encoders[files]


def _tokenised(tokenizer_file: str | None, ranks_file: str | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part, local = encoder(tokenizer_file, ranks_file), TaskContext.get().partitionId(), 0
        for whole in batches:
            for lo in range(0, whole.num_rows, 500):
                batch = whole.slice(lo, 500)
                ids, count = [], []
                for text in batch.column("text"):
                    got = enc.ids(text.as_py() or "")
                    got.append(END_ID)
                    ids.append(np.array(got, dtype=enc.type).tobytes())
                    count.append(len(got))
                before = local + np.cumsum([0, *count[:-1]])
                local += sum(count)
                n = len(count)
                yield pa.RecordBatch.from_arrays([pa.array([part] * n, pa.int32()), pa.array(before), batch.column("doc_id"), pa.array(count, pa.int64()), pa.array(ids, pa.binary())], names=["part", "local", "doc_id", "doc_tokens", "ids"])

    return run


def _cut(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc, place, count = (batch.column(c).to_pylist() for c in ("doc_id", "place", "doc_tokens"))
            out: list[tuple] = []
            for i, ids in enumerate(batch.column("ids")):
                held = ids.as_py()
                wide = np.frombuffer(held, dtype="<u2" if len(held) == 2 * count[i] else "<u4").astype("<u4").tobytes()
                start = 0
                while start < count[i]:
                    at = place[i] + start
                    length = min(window - at % window, count[i] - start)
                    out.append((doc[i], start, length, zlib.crc32(wide[4 * start : 4 * (start + length)]), count[i], at // window, at % window))
                    start += length
            columns = zip(*out, strict=True) if out else [()] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    return run


def pack(docs: DataFrame, window: int = WINDOW, tokenizer_file: str | None = None, ranks_file: str | None = None) -> DataFrame:
    """The pieces of all texts: doc_id, start, length, ids_crc32, doc_tokens, sequence_id and offset."""
    placed = stored(in_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), _tokenised(tokenizer_file, ranks_file), "part int, local bigint, doc_id bigint, doc_tokens bigint, ids binary"), "token-ids")
    totals = placed.groupBy("part").agg(F.sum("doc_tokens").alias("total"))
    # a row for each partition of the first pass, and no more
    offsets = totals.select("part", F.coalesce(F.sum("total").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    pieces = placed.join(F.broadcast(offsets), "part").select("doc_id", (F.col("before") + F.col("local")).alias("place"), "doc_tokens", "ids")
    return in_batches(pieces, _cut(window), "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint")
