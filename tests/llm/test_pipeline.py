import gc
import platform
import resource
from pathlib import Path

import corpus_pipeline
import numpy as np
import pyarrow as pa
import pytest

import __spark_entry__ as driver


def test_stages(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    counts = [docs.count()]
    frame = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        frame = stage(spark, frame, small)
        assert frame.columns == docs.columns
        frame = spark.createDataFrame(frame.collect(), docs.schema)
        counts.append(frame.count())
    assert counts[0] >= counts[1] > counts[2] > counts[3] > counts[4] > 0
    pieces = corpus_pipeline.run(spark, small)
    assert {r.doc_id for r in pieces.select("doc_id").distinct().collect()} == {r.doc_id for r in frame.collect()}


@pytest.mark.parametrize("stage", corpus_pipeline.STAGES)
def test_stage_edges(spark, edge, empty, small, stage):
    name, run = stage
    assert run(spark, empty, small).count() == 0
    out = run(spark, edge, small)
    assert out.count() > 0 or name == "language"


def test_registration():
    names = set(driver.queries())
    assert "pipeline" in names and all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11))


def test_release(spark):
    from arrayframe.llm.common import release, stored

    frame = stored(spark.range(3), "test")
    path = frame.inputFiles()[0].rsplit("/", 1)[0].removeprefix("file://")
    release(spark)
    assert not __import__("os").path.exists(path)


def test_narrow_ids(spark):
    """Ids of another integer type."""
    from arrayframe.llm import fingerprints, language_id, language_model, licences, main_text, mixing, neardup, packing, repetition, warc

    docs = spark.createDataFrame([(1, "some words here", "en", "s"), (2, "some words here", "en", "s")], "doc_id int, text string, lang string, source string")
    for run in (fingerprints.fingerprint_edits, language_id.identify, language_model.score_texts, licences.scan, mixing.mix, neardup.components, packing.pack, repetition.repetition):
        assert run(docs).count() == 2, run
    pages = spark.createDataFrame([(1, "u", "<p>x</p>")], "page_id int, url string, html string")
    assert main_text.main_text(pages).count() == warc.round_trip(pages).count() == 1


CLASHES = ["row_key", "node", "comp", "kept", "letters", "__letters", "__kept", "__mix_tokens", "__mix_topic", "n_tokens", "part", "key", "topic", "probability"]


@pytest.mark.parametrize("stage", corpus_pipeline.STAGES[:-1])
def test_clashing_columns_pass(spark, small, stage):
    name, run = stage
    plain = spark.read.parquet(f"{small}/documents.parquet")
    docs = plain.selectExpr("*", *(f"doc_id * 2 AS `{c}`" for c in CLASHES))
    out = run(spark, docs, small)
    assert out.columns == docs.columns
    rows = out.collect()
    assert rows and all(r[c] == 2 * r.doc_id for r in rows for c in CLASHES)
    assert {r.doc_id for r in rows} == {r.doc_id for r in run(spark, plain, small).collect()}


def test_operators_leave_the_session_as_it_was(spark, small):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    corpus_pipeline.STAGES[1][1](spark, spark.read.parquet(f"{small}/documents.parquet"), small).count()
    assert spark.conf.get(key) == before


@pytest.mark.skipif(platform.libc_ver()[0] != "glibc", reason="memory goes back by a call of glibc")
def test_a_task_gives_its_memory_back():
    from arrayframe.llm.common import lean

    resident = lambda: int(Path("/proc/self/statm").read_text().split()[1]) * resource.getpagesize() / 1e6
    pinned, full = [], []

    def run(batches):
        """Leaves its heap full of holes: what is kept above them keeps the C library from shrinking it."""
        arrays = [np.ones(100_000, dtype=np.uint8) for _ in range(4000)]
        pinned.extend(arrays[::100])
        del arrays
        gc.collect()
        full.append(resident())
        yield from batches

    before = resident()
    assert list(lean(run)(iter([]))) == [] and len(pinned) == 40
    assert resident() < before + 100, (before, full, resident())


def test_wide_results_come_in_pieces():
    """A batch of 10,000 rows, and one of few long ones: every row, in batches of bounded rows and bytes."""
    from arrayframe.llm import repetition
    from arrayframe.llm.common import PIECE_BYTES, PIECE_ROWS

    short = [f"{i} is a plain sentence with ten words and number {i * 7}" for i in range(10_000)]
    long_ = [" ".join(f"w{i}x{j}" for j in range(60_000)) for i in range(20)]
    for texts in (short, long_):
        whole = pa.RecordBatch.from_arrays([pa.array(texts)], names=["text"])
        got = list(repetition._filtered(iter([whole])))
        assert [x for b in got for x in b.column("text").to_pylist()] == texts
        assert all(b.num_rows <= PIECE_ROWS and (b.num_rows == 1 or b.nbytes <= 1.2 * PIECE_BYTES) for b in got)
