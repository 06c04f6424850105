import random

import brute
import numpy as np
import pytest

from arrayframe.llm import common
from arrayframe.llm import neardup as N


def expected(rows, width):
    sets = [brute.shingles(t, width) for _, t in rows]
    groups = brute.component_of(sets)
    out = []
    for (k, _), s, g in zip(rows, sets, groups, strict=True):
        ids = [rows[i][0] for i in g if rows[i][0] is not None]
        out.append((k, len(s), (min(ids) if ids else None) if s else k))
    return sorted(out, key=str)


def found(frame):
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in frame.collect()), key=str)


@pytest.mark.parametrize("width", [2, 5])
def test_components_equal_brute_force(docs, texts, width):
    assert found(N.components(docs, width)) == expected(list(texts.items()), width)


def test_edges(edge, empty):
    rows = [(r.doc_id, r.text) for r in edge.select("doc_id", "text").collect()]
    got = N.components(edge, 2)
    assert found(got) == expected(rows, 2)
    assert all(r.kept == (r.doc_id is not None and r.doc_id == r.component_id) for r in got.collect())
    assert N.components(empty, 2).count() == 0 and N.first_of_groups(empty).count() == 0
    assert N.first_of_groups(edge).columns == edge.columns


@pytest.mark.parametrize(("large", "one_task"), [(64, 10_000), (3, 0)])
def test_star_of_near_copies(spark, monkeypatch, large, one_task):
    """Copies that resemble their source more than each other, over all ways of comparison."""
    monkeypatch.setattr(N, "ONE_TASK", one_task)
    monkeypatch.setattr(N, "LARGE", large)
    monkeypatch.setattr(N, "MINOR", 8)
    monkeypatch.setattr(N, "MAJOR", 16)
    r = random.Random(3)
    base = [f"w{r.randrange(4000)}" for _ in range(120)]
    rows = []
    for i in range(150):
        w = list(base)
        for _ in range(r.randint(0, 10)):
            w[r.randrange(120)] = f"w{r.randrange(4000)}"
        rows.append((i, " ".join(w)))
    rows += [(i, " ".join(f"w{r.randrange(4000)}" for _ in range(40))) for i in range(150, 170)]
    assert found(N.components(spark.createDataFrame(rows, "doc_id bigint, text string"), 2)) == expected(rows, 2)


def test_signatures_estimate_similarity():
    r = np.random.default_rng(0)
    shared = r.integers(0, 2**63, 400).astype(np.uint64)
    for own in (20, 100):
        a, b = (np.concatenate([shared, r.integers(0, 2**63, own).astype(np.uint64)]) for _ in range(2))
        sig = N.superminhash(np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)]))
        truth = 400 / (400 + 2 * own)
        assert abs((sig[0] == sig[1]).mean() - truth) < 0.1
        assert (sig != 2**64 - 1).all()


def test_signature_of_few_elements_is_full():
    sig = N.superminhash(np.array([5], dtype=np.uint64), np.array([0, 0, 1]))
    assert (sig[0] == 2**64 - 1).all() and (np.sort(sig[1] >> np.uint64(32)) == np.arange(N.SLOTS)).all()


@pytest.mark.parametrize("one_task", [10_000, 0])
def test_connected_chain(spark, monkeypatch, one_task):
    monkeypatch.setattr(N, "ONE_TASK", one_task)
    edges = [(i, i + 1) for i in range(60)] + [(200, 100), (300, 200)]
    got = {r.node: r.comp for r in N.connected(spark.createDataFrame(edges, "u bigint, v bigint")).collect()}
    assert got == {i: 0 for i in range(61)} | {100: 100, 200: 100, 300: 100}


def test_one_row_of_each_group_stays(spark):
    long = " ".join(f"w{i}" for i in range(40))
    near = long + " more"
    rows = [(None, "alone with a null id in here"), (None, near), (4, long), (2, long), (2, long), (7, "x y"), (7, "x y"), (None, "p q"), (None, "p q"), (9, ""), (9, ""), (None, None)]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id bigint, text string, row_key int")
    got = N.first_of_groups(docs)
    assert got.columns == docs.columns
    want = [(None, "alone with a null id in here"), (2, long), (7, "x y"), (None, "p q"), (9, ""), (9, ""), (None, None)]
    assert sorted(((r.doc_id, r.text) for r in got.collect()), key=str) == sorted(want, key=str)


def test_digests_that_share_a_name_stay_apart(spark, monkeypatch):
    rows = [(i, " ".join(f"t{i}x{j}" for j in range(20))) for i in range(4)] + [(9, " ".join(f"t0x{j}" for j in range(20)))]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string")
    signed = spark.createDataFrame([(k, k, 20, 5, k % 9, [k % 9]) for k, _ in rows], "doc_id bigint, row_key bigint, n_shingles bigint, node bigint, node2 bigint, bands array<bigint>")
    monkeypatch.setattr(N, "_signed", lambda width: None)
    kept = N.in_batches
    monkeypatch.setattr(N, "in_batches", lambda df, run, schema: signed if run is None else kept(df, run, schema))
    monkeypatch.setattr(N, "_linked", lambda signed, reps, keyed, width: spark.createDataFrame([], "node bigint, comp bigint"))
    assert {r.doc_id: r.component_id for r in N.components(frame, 2).collect()} == {0: 0, 1: 1, 2: 2, 3: 3, 9: 0}


def shuffled(spark):
    """Bytes that the session's tasks have written to shuffles so far."""
    sc = spark.sparkContext._jsc.sc()
    sc.listenerBus().waitUntilEmpty()
    executors = sc.statusStore().executorList(False)
    return sum(executors.apply(i).totalShuffleWrite() for i in range(executors.size()))


def test_texts_that_are_not_compared_stay_where_they_are(spark):
    """Without broadcasts by size, as on large tables: 300 long texts, 3 near copies and a repeated row."""
    r = random.Random(11)
    texts = [" ".join(f"{r.getrandbits(48):x}" for _ in range(2000)) for _ in range(300)]
    rows = [*enumerate(texts), *((400 + i, texts[i] + " end") for i in range(3)), (7, texts[7])]
    docs = N.stored(spark.createDataFrame(rows, "doc_id bigint, text string"), "test-docs")
    size = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        before = shuffled(spark)
        got = N.first_of_groups(docs).collect()
        moved = shuffled(spark) - before
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", size)
    assert sorted((x.doc_id, x.text) for x in got) == list(enumerate(texts))
    assert moved < 0.5 * sum(len(t) for t in texts), moved


@pytest.mark.parametrize("most", [1 << 16, 1])
def test_sieve_loses_no_key(spark, monkeypatch, most):
    """Full or not, it passes all its keys; what it holds back is surely no key; columns may have any name."""
    monkeypatch.setattr(common, "SEGMENTS", most)
    rows = spark.range(40_000).selectExpr("xxhash64(id) AS `row_key`", "id AS segment", "id AS words")
    sieve = common.sieve(rows.where("segment % 10 = 0").select("row_key"), "row_key")
    inside, outside = (common.sifted(rows, "row_key", sieve, out) for out in (False, True))
    assert inside.columns == outside.columns == rows.columns
    held, rest = ({x.segment for x in f.collect()} for f in (inside, outside))
    assert held | rest == set(range(40_000)) and not held & rest
    assert set(range(0, 40_000, 10)) <= held
    assert most == 1 or len(held) < 4000 + 0.03 * 36_000
    none = common.sieve(rows.where("segment < 0"), "row_key")
    assert common.sifted(rows, "row_key", none).count() == 0 and common.sifted(rows, "row_key", none, out=True).count() == 40_000
