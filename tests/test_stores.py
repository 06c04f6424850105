"""Engines, series, campaigns, the facade and streams: write, then read."""

import sqlite3

import pytest
from pyspark.sql import functions as F

from arrayframe import api
from arrayframe.operators.selection import Selection
from arrayframe.shapes import JOINED_DIM, LOCAL_VALUE_DIM, ShapeError, ShapeKind, change, infer
from arrayframe.sources import campaign, engines, timeseries
from arrayframe.sources.catalog import attributes_frame, available_attributes, attributes_of_variables, current_attributes, name_matches
from arrayframe.streaming.steps import for_each_step, stream


def cells(spark, steps=4, width=10):
    return spark.range(steps * width).selectExpr(f"id div {width} AS step", f"(id % {width}) div 5 AS block_id", f"id % {width} AS d0", "CAST(id AS DOUBLE) AS v")


def read_all(frame):
    return sorted((r.step, r.d0, r.v) for r in frame.select("step", "d0", "v").collect())


def test_round_trip_append_flatten(spark, tmp_path):
    path = f"file://{tmp_path}/a"
    frame = cells(spark)
    engines.write(frame, path, order=("d0",))
    assert read_all(engines.read(spark, path)) == read_all(frame)
    more = frame.where("step < 2").withColumn("step", F.col("step") + 2).withColumn("v", -F.col("v"))
    engines.write(more, path, append_after=2)
    assert read_all(engines.read(spark, path)) == sorted(read_all(frame.where("step < 2")) + read_all(more))
    assert [r.step for r in engines.read(spark, path, select_step="1:n:2").select("step").distinct().orderBy("step").collect()] == [0, 1]
    flat = engines.read(spark, path, flatten=2)
    assert flat.select("step").distinct().count() == 1 and flat.select("block_id").distinct().count() == 8


def test_detection_and_engines(spark, tmp_path):
    assert engines.detect(spark, "x.ats") == "timeseries" and engines.detect(spark, "x.aca") == "campaign"
    with pytest.raises(FileNotFoundError):
        engines.detect(spark, f"file://{tmp_path}/nothing")
    with pytest.raises(engines.EngineError):
        engines.write(cells(spark), "x", "nonsense")
    with pytest.raises(engines.EngineError):
        engines.read(spark, "x.h5")
    engines.write(cells(spark), "x", "null")
    assert engines.read(spark, "x", "null").count() == 0
    engines.write(cells(spark), "in_place", "inline")
    assert engines.read(spark, "in_place", "inline").count() == 40
    kept = {}
    engines.register_engine("mine", lambda s, p: kept[p], lambda f, p: kept.update({p: f}))
    engines.write(cells(spark), "k", "mine")
    assert engines.read(spark, "k", "mine").count() == 40


def test_time_series(spark, tmp_path):
    for i in range(2):
        engines.write(cells(spark, 2 + i), f"file://{tmp_path}/s{i}")
    (tmp_path / "all.ats").write_text("# list\n- s0\n- localpath: s1\n  uuid: 12\n- end\n")
    got = engines.read(spark, f"file://{tmp_path}/all.ats")
    assert [r.step for r in got.select("step").distinct().orderBy("step").collect()] == [0, 1, 2, 3, 4]
    entries, closed = timeseries.parse_list("- a.x\n- remotehost: h\n  remotepath: /p\n  localpath: b.x\n")
    assert [e.path for e in entries] == ["a.x", "b.x"] and entries[1].remote_host == "h" and not closed
    with pytest.raises(timeseries.SeriesError):
        timeseries.concatenate([cells(spark), cells(spark).withColumn("v", F.col("v").cast("string"))])


def test_campaign(spark, tmp_path):
    db = sqlite3.connect(tmp_path / "c.aca")
    db.executescript(
        "create table host (hostid int, hostname text); create table dataset (datasetid int, uuid text, name text, fileformat text, deleted int);"
        "create table replica (replicaid int, datasetid int, hostid int, dirid int, name text, size int, deleted int);"
        "insert into host values (1, 'here'), (2, 'there'); insert into dataset values (1, 'u', 'a/x', 'bp', 0), (2, 'u', 'b', 'bp', 1), (3, 'u', 'c', 'h5', 0);"
        "insert into replica values (10, 1, 2, 1, 'r', 5, 0), (11, 1, 1, 1, 'r', 5, 0), (12, 3, 2, 1, 'r', 5, 0), (13, 3, 2, 1, 'r', 5, 1);"
    )
    db.commit()
    db.close()
    c = campaign.Campaign.open(spark, str(tmp_path / "c.aca"))
    assert [(r.datasetid, r.replicaid) for r in c.datasets().collect()] == [(1, 10), (1, 11), (3, 12)]
    assert {r.datasetid for r in c.datasets(exclude="a/.*").collect()} == {3}
    assert {r.datasetid: r.replicaid for r in c.choose("here").collect()} == {1: 11, 3: 12}


def test_attributes(spark):
    rows = [("v/unit", "string", "m", 0), ("v/unit", "string", "km", 1), ("w/u/scale", "double", [1.0, 2.0], 0), ("free", "string", "x", 0)]
    now = current_attributes(attributes_frame(spark, rows))
    assert {(r.name, tuple(r.value)) for r in available_attributes(now, "v").collect()} == {("unit", ("km",))}
    names = spark.createDataFrame([("v",), ("w",), ("w/u",)], "name string")
    assert {(r.variable, r.attribute) for r in attributes_of_variables(now, names).collect()} == {("v", "unit"), ("w", "u/scale"), ("w/u", "scale")}


def test_name_patterns(spark):
    names = spark.createDataFrame([("T1",), ("T12",), ("a/T1",)], "name string")
    of = lambda p, **k: {r.name for r in names.where(name_matches(p, F.col("name"), **k)).collect()}
    assert of("T?") == {"T1"} and of("*T1") == {"T1", "a/T1"} and of("T[0-9]+", regex=True) == {"T1", "T12"}


def test_shapes():
    assert infer() is ShapeKind.GLOBAL_VALUE and infer([4], [0], [2]) is ShapeKind.GLOBAL_ARRAY and infer(count=[3]) is ShapeKind.LOCAL_ARRAY
    assert infer([LOCAL_VALUE_DIM]) is ShapeKind.LOCAL_VALUE and infer([JOINED_DIM, 4], [], [2, 4]) is ShapeKind.JOINED_ARRAY
    for bad in (([4], [3], [2]), ([JOINED_DIM, JOINED_DIM], [], [1, 1]), ([4], [0], []), ([], [1], []), ([LOCAL_VALUE_DIM, 2], [], []), ([JOINED_DIM, 4], [1, 0], [2, 4])):
        with pytest.raises(ShapeError):
            infer(*bad)
    assert change([2], [5], ShapeKind.GLOBAL_ARRAY) == (5,)
    with pytest.raises(ShapeError):
        change([2], [5, 1], ShapeKind.GLOBAL_ARRAY)


def test_definitions(spark):
    io = api.Context(spark).declare_io("sim")
    io.define_variable("v", "double", [10], [0], [5])
    for bad in (lambda: io.define_variable("v", "int32"), lambda: io.define_derived_variable("d", "v + w"), lambda: io.define_derived_variable("v", "v + 1")):
        with pytest.raises(api.DefinitionError):
            bad()
    assert str(io.variables["v"].selection()) == "Selection(box start [0] count [5])"
    assert io.inquire_variable("v", "int32") is None and io.inquire_variable("v", "double").kind is ShapeKind.GLOBAL_ARRAY
    io.define_attribute("unit", "m", variable="v")
    with pytest.raises(api.DefinitionError):
        io.define_attribute("unit", "km", variable="v")


def test_facade(spark, tmp_path):
    path = f"file://{tmp_path}/f"
    io = api.IO("sim")
    io.define_variable("v", "double", [10], [0], [5])
    io.define_derived_variable("twice", "v * 2")
    api.write(cells(spark), path, io)
    reader = api.FileReader(spark, path, ["d0"])
    assert sorted(reader.variables()) == ["twice", "v"] and reader.num_steps() == 4
    reader.define_derived_variable("thrice", "twice + v")
    got = reader.read("thrice", Selection.bounding_box([3], [2]).with_steps(1, 2)).orderBy("step", "d0")
    assert [r.value for r in got.collect()] == [39.0, 42.0, 69.0, 72.0]
    assert tuple(reader.minmax("v", 2).first())[1:] == (20.0, 29.0) and tuple(reader.minmax("v").first()) == (0.0, 39.0)
    one = api.Stream(spark, path, ["d0"])
    assert [(s, one.read("v").count()) for s in one.steps(2)] == [(0, 10), (1, 10)]
    for _ in one.steps(1):
        with pytest.raises(api.DefinitionError):
            one.read("v", Selection().with_steps(0, 1))


def test_stream_of_steps(spark, tmp_path):
    path = f"file://{tmp_path}/in"
    engines.write(cells(spark), path)
    seen = []
    source = stream(spark, path, spark.read.parquet(path).schema)
    for_each_step(source, lambda f, b: seen.append(sorted({r.step for r in f.select("step").distinct().collect()})), f"file://{tmp_path}/state").awaitTermination()
    assert sorted(s for x in seen for s in x) == [0, 1, 2, 3] and all(len(x) == 1 for x in seen)


def test_batches_of_a_stream_follow_bytes_not_steps(spark, tmp_path, monkeypatch):
    from arrayframe.plans.registry import QUERIES
    from arrayframe.streaming import steps

    spark.range(48_000).selectExpr("id AS event_id", "id % 7 AS user_id", "CAST(id % 1013 AS DOUBLE) AS value").write.parquet(f"file://{tmp_path}/events.parquet")
    batches = []

    def counted(source, run, checkpoint):
        return for_each_step(source, lambda f, b: (batches.append(b), run(f, b)), checkpoint)

    monkeypatch.setattr(steps, "for_each_step", counted)
    got = QUERIES["stream_steps"](spark, f"file://{tmp_path}")
    assert sorted(tuple(r) for r in got.collect()) == [(s, 1000, float(sum(i % 1013 for i in range(1000 * s, 1000 * s + 1000)))) for s in range(48)]
    assert len(batches) == 1  # 48 small files, a step each: twelve batches of four


def test_byte_limit_of_a_stream(spark, tmp_path):
    path, name = f"file://{tmp_path}/in", "spark.sql.sources.parallelPartitionDiscovery.parallelism"
    frame = cells(spark, 40, 50)
    engines.write(frame, path, order=("d0",))
    sizes = [f.stat().st_size for f in (tmp_path / "in").rglob("*.parquet")]
    before, seen = spark.conf.get(name), []
    source = stream(spark, path, frame.select("block_id", "d0", "v", "step").schema, bytes_per_batch=sum(sizes) // 4)
    for_each_step(source, lambda f, b: seen.append(read_all(f)), f"file://{tmp_path}/state").awaitTermination()
    assert sorted(row for batch in seen for row in batch) == read_all(frame) and 4 <= len(seen) <= 6
    # folders are listed by a few tasks, not one each, and the caller's session keeps its setting
    assert int(source.sparkSession.conf.get(name)) <= max(64, 2 * spark.sparkContext.defaultParallelism) and spark.conf.get(name) == before


def test_codecs(spark):
    from arrayframe.operators import codecs

    frame = cells(spark).withColumn("i", F.col("d0").cast("int")).withColumn("v", F.col("v") * 1.37)
    op = codecs.Operation
    lossy = codecs.reduce_columns(frame, {"v": [op("sz", {"accuracy": "0.3"})], "i": [op("sz", {"accuracy": "0.3"})]})
    assert codecs.provided_error(frame, lossy, ["step", "d0"], [], "v").first().max_error <= 0.3 and lossy.select("i").exceptAll(frame.select("i")).count() == 0
    relative = codecs.reduce_columns(frame, {"v": [op("mgard", {"tolerance": "0.01", "mode": "REL"})]})
    both = frame.join(relative.select("step", "d0", F.col("v").alias("w")), ["step", "d0"])
    assert both.where(F.abs(F.col("v") - F.col("w")) > 0.0101 * F.abs(F.col("v"))).count() == 0
    assert read_all(codecs.reduce_columns(frame, {"v": [op("bzip2"), op("null")]})) == read_all(frame) and codecs.parquet_codec({"v": [op("blosc")]}) == "lz4"
    codecs.register_codec("halve", lambda s: s / 2)
    assert codecs.reduce_columns(frame, {"v": [op("halve")]}).agg(F.sum("v")).first()[0] == pytest.approx(frame.agg(F.sum("v")).first()[0] / 2)
    for bad in (op("zfp", {"accuracy": "1", "rate": "2"}), op("zfp"), op("caesar"), op("nothing")):
        with pytest.raises(codecs.CodecError):
            codecs.reduce_columns(frame, {"v": [bad]})


def test_accuracy_of_reads(spark, tmp_path):
    path = f"file://{tmp_path}/f"
    engines.write(cells(spark).withColumn("v", F.col("v") * 1.1), path, order=("d0",))
    reader = api.FileReader(spark, path, ["d0"])
    exact = {(r.step, r.d0): r.value for r in reader.read("v").collect()}
    near = reader.read("v", Selection().with_accuracy(0.4)).collect()
    assert all(abs(r.value - exact[r.step, r.d0]) <= 0.4 + 1e-9 for r in near) and any(r.value != exact[r.step, r.d0] for r in near)


def test_formula_source(spark):
    from arrayframe.sources import formula

    formula.register(spark)
    frame = spark.read.format("arrayformula").options(shape="7,3", steps="2", blocks="3").load()
    assert sorted(tuple(r) for r in frame.collect()) == sorted((s, min(i // 2, 2), i, j, 1000.0 * s + 3 * i + j) for s in range(2) for i in range(7) for j in range(3))


def test_kept_statistics(spark, tmp_path):
    from arrayframe.operators.predicates import Leaf, RangeQuery, Tree

    path = f"file://{tmp_path}/f"
    frame = cells(spark)
    engines.write(frame, path, order=("d0",), stats=("v",))
    engines.write(frame.where("step = 0").withColumn("step", F.lit(3).cast("long")), path, order=("d0",), append_after=3, stats=("v",))
    reader = api.FileReader(spark, path, ["d0"])
    assert reader.cells.count() == 40 and engines.read_blocks(spark, path, "w") is None
    kept = sorted((r.step, r.block_id, r.start_d0, r.count_d0, r.min, r.max) for r in reader.blocks("v").collect())
    assert kept == sorted((s, b, 5 * b, 5, v + 5.0 * b, v + 5.0 * b + 4) for s, v in ((0, 0), (1, 10), (2, 20), (3, 0)) for b in range(2))
    asked = RangeQuery("v", Tree("AND", (Leaf("GE", 13.0), Leaf("LT", 27.0))), (2,), (6,))
    assert sorted(r.value for r in reader.query(asked).collect()) == [13.0, 14.0, 15.0, 16.0, 17.0, 22.0, 23.0, 24.0, 25.0, 26.0]
    reader.define_derived_variable("twice", "v * 2")
    assert reader.query(RangeQuery("twice", Tree("AND", (Leaf("GT", 50.0),)))).count() == 4


def test_workload(spark, tmp_path):
    from arrayframe.plans import workload

    script = "steps 2 # two\narray u double 7,3 3\narray v int32 7,3 3\nwrite run u,v\nread run u\nread run v 2,1 3,2\nsleep 0\n"
    got = workload.run(spark, script, f"file://{tmp_path}")
    assert [(c, t, n) for c, t, n, _ in got] == [("write", "run", 42), ("read", "run", 42), ("read", "run", 12), ("sleep", "0", 0)]
    frame = engines.read(spark, f"file://{tmp_path}/run")
    assert sorted((r.step, r.block_id, r.d0, r.d1, r.u, r.v) for r in frame.collect()) == sorted((s, min(i // 2, 2), i, j, 1000.0 * s + 3 * i + j, 1000 * s + 3 * i + j + 1) for s in range(2) for i in range(7) for j in range(3))
    for bad in ("jump 3", "write run w", "array u nothing 3"):
        with pytest.raises(workload.WorkloadError):
            workload.parse(bad)


def test_series_queries_take_all_steps(spark):
    from conftest import DATA

    from arrayframe.plans.registry import QUERIES

    sf_dir = f"{DATA}/sf0.1"
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select((F.col("event_id") / 1000).cast("long").alias("step"), F.col("event_id").alias("id"), "value")
    steps = {r.step for r in events.select("step").distinct().collect()}
    assert max(steps) > 10
    got = QUERIES["ts_concat"](spark, sf_dir).select((F.col("step") * 1000 + F.col("d0")).alias("id"), "value")
    assert got.count() == events.count() and got.exceptAll(events.select("id", "value")).count() == 0
    files = {r.step: r.file for r in QUERIES["ts_find_file"](spark, sf_dir).collect()}
    assert files == {s: "a" if s < 3 else "b" if s < 5 else "c" for s in steps}
    assert tuple(QUERIES["ts_minmax"](spark, sf_dir).first()) == tuple(events.agg(F.min("value"), F.max("value")).first())
