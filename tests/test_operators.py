"""Selections, steps, boxes, statistics and predicates: known values."""

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from arrayframe.operators import boxes, layout, predicates, stats, steps
from arrayframe.operators.predicates import Leaf, QueryError, RangeQuery, Tree
from arrayframe.operators.selection import Selection, SelectionError, from_dump


@pytest.mark.parametrize(("text", "kept"), [("2 3 0", {0, 2, 3}), ("1:2", {1, 2}), ("1:6:3", {1, 4}), ("2:n", set(range(2, 12))), ("1:n:2 0:N:2", set(range(12))), ("1:3:2 0:4:2", {0, 1, 2, 3, 4}), ("", set(range(12)))])
def test_step_filter(text, kept):
    assert {i for i in range(12) if steps.is_selected(steps.parse_steps(text), i)} == kept


@pytest.mark.parametrize("text", ["b", "n", "1:b", "1:2:0", "1:2:3:4", "-1"])
def test_bad_step_filters(text):
    with pytest.raises(ValueError):
        steps.parse_steps(text)


def test_block_division():
    assert stats.divide_block([100], 17) == [6]
    assert [b for b in stats.sub_boxes([100], [6])] == [((0,), (17,)), ((17,), (17,)), ((34,), (17,)), ((51,), (17,)), ((68,), (16,)), ((84,), (16,))]
    assert stats.divide_block([100], 100) == [1] and stats.divide_block([100], 50) == [2] and stats.divide_block([100], 1) == [100]
    assert stats.divide_block([10, 10], 5) == [10, 2]
    assert len(stats.sub_boxes([10, 10], [10, 2])) == 20


@given(st.integers(1, 300), st.integers(1, 40))
def test_sub_boxes_cover_once(count, parts):
    parts = min(parts, count)
    covered = [i for (s,), (c,) in stats.sub_boxes([count], [parts]) for i in range(s, s + c)]
    assert covered == list(range(count))


boxes_1d = st.tuples(st.integers(0, 12), st.integers(1, 6))


@given(boxes_1d, boxes_1d, boxes_1d, boxes_1d)
def test_box_difference_is_exact(a, b, c, d):
    left, right = ((a[0], b[0]), (a[1], b[1])), ((c[0], d[0]), (c[1], d[1]))
    cells = lambda x: [(i, j) for i in range(x[0][0], x[0][0] + x[1][0]) for j in range(x[0][1], x[0][1] + x[1][1])]
    rest = [p for x in boxes.subtract(left, right) for p in cells(x)]
    assert len(rest) == len(set(rest)) and set(rest) == set(cells(left)) - set(cells(right))


def test_contiguity():
    assert boxes.is_contiguous(((1, 0), (2, 5)), (4, 5)) and not boxes.is_contiguous(((1, 0), (2, 4)), (4, 5)) and boxes.is_contiguous(((1, 2), (1, 3)), (4, 5))


def test_selection_checks():
    s = Selection.bounding_box([2, 3], [4, 5])
    assert s.check([6, 8]).size([6, 8]) == 20 and s.with_steps(1, 3).size([6, 8]) == 60
    for shape in ([5, 8], [6, 7], [6]):
        with pytest.raises(SelectionError):
            s.check(shape)
    with pytest.raises(SelectionError):
        s.with_steps(0, 0)
    with pytest.raises(SelectionError):
        s.with_memory([0, 0], [4, 4])
    assert s.clear("box") == Selection() and str(s.with_block(3)) == "Selection(box start [2, 3] count [4, 5], block 3)"
    assert from_dump([-2, 1], [-1, 3], [10, 6]) == Selection((1,), (3,), steps=(8, 2))


def query_cells(spark, kind):
    """The range-query fixture: 3 steps, 2 writers, 100 cells each."""
    rank, i, step = (F.col(c) for c in ("rank", "i", "step"))
    value = 1000 * step + 100 * rank + i if kind == "int" else 100.0 * step + 10.0 * rank + i * 0.01
    grid = spark.range(600).selectExpr("id div 200 AS step", "(id % 200) div 100 AS rank", "id % 100 AS i")
    return grid.select("step", rank.alias("block_id"), (rank * 100 + i).alias("d0"), value.cast("double").alias("value"))


TREE = Tree("OR", (Leaf("GT", 100.6), Leaf("LT", -0.17), Tree("AND", (Leaf("LT", 11.9), Leaf("GT", 2.8)))))


@pytest.mark.parametrize(("kind", "whole", "parts"), [("int", {0: 1, 1: 1, 2: 1}, {0: 2, 1: 8, 2: 8}), ("double", {1: 1, 2: 1}, {1: 3, 2: 8})])
def test_touched_blocks(spark, kind, whole, parts):
    cells = query_cells(spark, kind)
    asked = RangeQuery("v", TREE, (5,), (80,))
    hits = asked.touched(stats.block_stats(cells, ["d0"]), ["d0"])
    assert {r.step: r["count"] for r in hits.groupBy("step").count().collect()} == whole
    assert all(r.start_d0 == 5 and r.count_d0 == 80 for r in hits.collect())


def test_refinement_is_exact(spark):
    cells = query_cells(spark, "int")
    asked = RangeQuery("v", TREE, (5,), (80,))
    got = asked.refine(cells, asked.touched(stats.block_stats(cells, ["d0"]), ["d0"]), ["d0"])
    want = [r for r in cells.collect() if 5 <= r.d0 < 85 and (r.value > 100.6 or r.value < -0.17 or 2.8 < r.value < 11.9)]
    assert got.count() == len(want)


XML = """<array-query><io name="query"><var name="doubleV"><boundingbox start="5" count="80"/><op value="OR">
<range compare="GT" value="100.6"/><range compare="LT" value="-0.17"/><op value="AND"><range compare="LT" value="11.9"/><range compare="GT" value="2.8"/></op></op></var></io></array-query>"""
JSON = '{"io": {"name": "query", "var": {"name": "doubleV", "boundingbox": {"start": "5", "count": "80"}, "op": {"value": "OR", "range": [{"compare": "GT", "value": "100.6"}, {"compare": "LT", "value": "-0.17"}], "op": [{"value": "AND", "range": [{"compare": "LT", "value": "11.9"}, {"compare": "GT", "value": "2.8"}]}]}}}}'


def test_query_documents():
    want = RangeQuery("doubleV", TREE, (5,), (80,))
    assert predicates.from_xml(XML, "query") == want and predicates.from_json(JSON, "query") == want
    with pytest.raises(QueryError):
        predicates.from_xml(XML, "other")
    with pytest.raises(QueryError):
        predicates.from_xml(XML.replace('compare="GT"', 'compare="XX"'))
    with pytest.raises(QueryError):
        predicates.from_json(JSON.replace('"OR"', '"NOT"'))


def test_composite_documents():
    text = '{"io": {"name": "q", "tag": [{"name": "a", "var": {"name": "x", "op": {"value": "AND", "range": [{"compare": "GT", "value": "1"}]}}}, {"name": "b", "var": {"name": "y", "op": {"value": "AND", "range": [{"compare": "LT", "value": "2"}]}}}], "query": {"op": "AND", "comp": ["a", "b"]}}}'
    got = predicates.from_json(text)
    assert got.relation == "AND" and [p.variable for p in got.parts] == ["x", "y"]


def test_empty_trees(spark):
    one = spark.range(1)
    assert one.where(Tree("AND").on_value(F.col("id"))).count() == 1 and one.where(Tree("OR").on_value(F.col("id"))).count() == 0


def test_reorganize_boxes():
    assert [layout.part_box(10, 4, p) for p in range(4)] == [(0, 2), (2, 2), (4, 2), (6, 4)]


def test_balance():
    parts = layout.balance([7, 5, 4, 3, 1], 2)
    assert sorted(i for p in parts for i in p) == list(range(5)) and sorted(sum([7, 5, 4, 3, 1][i] for i in p) for p in parts) == [10, 10]


@given(st.floats(-1e6, 1e6), st.floats(1e-3, 10))
def test_quantizer_bound(x, e):
    q = round(x / (2 * e)) * 2 * e
    assert abs(q - x) <= e * (1 + 1e-9) + 1e-9


def test_joined_array(spark):
    rows = [(s, r, b, n) for s in range(3) for r, k in enumerate((2, 3, 2)) for b, n in zip(range(k), (5, 7, 9), strict=False)]
    got = layout.joined_offsets(spark.createDataFrame(rows, "step bigint, writer int, block int, count bigint"), ["writer", "block"], "count")
    at = {(r.writer, r.block): r.offset for r in got.where("step = 1").collect()}
    assert at == {(0, 0): 0, (0, 1): 5, (1, 0): 12, (1, 1): 17, (1, 2): 24, (2, 0): 33, (2, 1): 38}
