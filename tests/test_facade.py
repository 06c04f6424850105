"""Stores with attributes and derived variables, streams by step status, series that grow, special values."""

import math

import pytest
from pyspark.sql import functions as F
from test_stores import cells, read_all

from arrayframe import api
from arrayframe.functions.derived import column
from arrayframe.operators.selection import Selection
from arrayframe.sources import engines, timeseries
from arrayframe.streaming.status import StepError, StepStatus


def grid(spark):
    frame = spark.range(2 * 5 * 4 * 3).selectExpr("id div 60 AS step", "(id % 60) div 12 div 3 AS block_id", "(id % 60) div 12 AS d0", "(id % 12) div 3 AS d1", "id % 3 AS d2")
    return frame.withColumns({n: F.sin(F.col("d0") * k + F.col("d1") * F.col("d2") + F.col("step")) for k, n in enumerate(("a", "b", "c"), 1)})


def stored(spark, tmp_path, **derived):
    io, path = api.IO("x"), f"file://{tmp_path}/g"
    for n in "abc":
        io.define_variable(n, "double")
    for n, (e, k) in derived.items():
        io.define_derived_variable(n, e, k)
    api.write(grid(spark), path, io, order=("d0", "d1", "d2"))
    return api.FileReader(spark, path, ["d0", "d1", "d2"])


@pytest.mark.parametrize("kind", ["store", "expression"])
@pytest.mark.parametrize(("expression", "start", "count"), [("a + b", (1, 1, 0), (3, 2, 2)), ("sum(a)", (1, 1), (3, 2)), ("curl(a, b, c)", (1, 1, 1), (3, 2, 2)), ("curl(a, b, c)", (1, 1, 1, 0), (3, 2, 2, 2)), ("cross(a, b, c, c, a, b)", (0, 2, 1), (2, 2, 1))])
def test_a_box_equals_the_whole_cut(spark, tmp_path, kind, expression, start, count):
    reader = stored(spark, tmp_path, z=(expression, kind))
    whole, box = reader.read("z"), reader.read("z", Selection.bounding_box(start, count))
    assert sorted(whole.columns) == sorted(box.columns)
    names = [c for c in ("d0", "d1", "d2", "comp") if c in whole.columns]
    inside = lambda r: all(s <= r[n] < s + c for n, s, c in zip(names, start, count, strict=False))
    key = lambda r: (r.step, r.block_id, *(r[n] for n in names))
    want = {key(r): r.value for r in whole.collect() if inside(r)}
    got = {key(r): r.value for r in box.collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], nan_ok=True) for k in want)


def test_what_is_kept_of_derived_variables(spark, tmp_path):
    reader = stored(spark, tmp_path, s=("a * 2", "stats"), t=("sum(a)", "store"))
    assert {"s", "t"} <= set(reader.variables()) and "s" not in reader.cells.columns and "t" not in reader.cells.columns
    want = {(r.step, r.block_id): (r.lo, r.hi) for r in grid(spark).groupBy("step", "block_id").agg(F.min(F.col("a") * 2).alias("lo"), F.max(F.col("a") * 2).alias("hi")).collect()}
    assert {(r.step, r.block_id): (r.min, r.max) for r in reader.blocks("s").collect()} == want
    assert reader.read("t").columns == ["step", "block_id", "d0", "d1", "value"]
    with pytest.raises(api.DefinitionError):
        reader.define_derived_variable("a", "b + c")
    with pytest.raises(api.DefinitionError):
        api.IO("y").define_derived_variable("u", "a", "nothing")


def test_attributes_by_step(spark, tmp_path):
    io, path = api.IO("x"), f"file://{tmp_path}/a"
    io.define_attribute("unit", "m", variable="v", modifiable=True)
    io.define_attribute("unit", "km", variable="v", modifiable=True, step=3)
    io.define_attribute("list", [1, 2], "int32")
    api.write(cells(spark), path, io)
    reader = api.FileReader(spark, path, ["d0"])
    assert {(r.name, tuple(r.value)) for r in reader.attributes().collect()} == {("v/unit", ("km",)), ("list", ("1", "2"))}
    assert {(r.step, r.value[0]) for r in reader.attribute_steps().where("name = 'v/unit'").collect()} == {(0, "m"), (3, "km")}
    api.write(cells(spark), f"file://{tmp_path}/none", api.IO("y"))
    assert api.FileReader(spark, f"file://{tmp_path}/none", ["d0"]).attributes().count() == 0


def test_step_status(spark, tmp_path):
    path = f"file://{tmp_path}/s"
    writer = api.StreamWriter(spark, path, order=("d0",))
    with pytest.raises(StepError):
        writer.put(cells(spark))
    for k in range(2):
        writer.begin_step()
        with pytest.raises(StepError):
            writer.begin_step()
        writer.put(cells(spark, 1).withColumn("v", F.col("v") + k).drop("step"))
        writer.end_step()
    reader = api.Stream(spark, path, ["d0"])
    for k in range(2):
        assert reader.begin_step() is StepStatus.OK and reader.current == k
        with pytest.raises(StepError):
            reader.begin_step()
        assert reader.read("v").agg(F.min("value")).first()[0] == k
        reader.end_step()
    assert reader.begin_step(timeout=0.3, poll=0.1) is StepStatus.NOT_READY
    writer.close()
    assert reader.begin_step() is StepStatus.END_OF_STREAM
    with pytest.raises(StepError):
        reader.end_step()


def test_live_series(spark, tmp_path):
    for i in range(2):
        engines.write(cells(spark, 1 + i), f"file://{tmp_path}/s{i}")
    listed = tmp_path / "all.ats"
    listed.write_text("- s0\n")
    live = timeseries.Live(spark, f"file://{listed}")
    assert live.begin_step() is StepStatus.OK and live.cells.count() == 10
    assert live.begin_step() is StepStatus.NOT_READY
    listed.write_text("- s0\n- s1\n- end\n")
    assert [live.begin_step() for _ in range(3)] == [StepStatus.OK, StepStatus.OK, StepStatus.END_OF_STREAM]
    assert {r.step for r in live.cells.select("step").collect()} == {2}


def test_append_writes_before_it_deletes(spark, tmp_path):
    path = f"file://{tmp_path}/a"
    engines.write(cells(spark), path, order=("d0",), stats=("v",))
    bad = cells(spark).withColumn("v", F.raise_error(F.lit("lost")).cast("double"))
    with pytest.raises(Exception, match="lost"):
        engines.write(bad, path, order=("d0",), append_after=0, stats=("v",))
    assert read_all(engines.read(spark, path)) == read_all(cells(spark)) and engines.read_blocks(spark, path, "v").count() == 8
    engines.write(cells(spark, 1).withColumn("step", F.lit(3).cast("long")), path, order=("d0",), append_after=-2, stats=("v",))
    assert engines.read(spark, path).count() == 40 and engines.read_blocks(spark, path, "v").count() == 8


def test_division_by_both_zeros(spark):
    rows = [(1.0, 0.0, math.inf), (1.0, -0.0, -math.inf), (-1.0, -0.0, math.inf), (0.0, -0.0, math.nan), (None, 0.0, None), (1.0, None, None)]
    frame = spark.createDataFrame(rows, "a double, b double, want double")
    for r in frame.withColumn("got", column("a / b", frame)).collect():
        assert (r.got is None) == (r.want is None)
        if r.want is not None:
            assert r.got == pytest.approx(r.want, nan_ok=True)


def test_integer_overflow_is_an_error(spark):
    frame = spark.range(1).selectExpr("2147483647 AS n", "9223372036854775807L AS m")
    for text in ("n + 1", "m * 2"):
        with pytest.raises(Exception, match="OVERFLOW"):
            frame.select(column(text, frame)).collect()
