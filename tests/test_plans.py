"""Physical plans: what reaches the scan, what is shuffled, what is broadcast."""

from arrayframe.plans.registry import QUERIES


def plan(spark, frame):
    return frame._jdf.queryExecution().executedPlan().toString()


def test_projection_and_box_reach_the_scan(spark, small):
    text = plan(spark, QUERIES["scan_project"](spark, small))
    assert "ReadSchema: struct<event_id:bigint,value:double>" in text and "Exchange" not in text


def test_elementwise_expressions_need_no_shuffle_or_python(spark, small):
    for name in ("d_composed", "d_cross", "bbox_3d", "reorganize_4x2", "flatten_steps"):
        text = plan(spark, QUERIES[name](spark, small))
        assert "Exchange" not in text and "Python" not in text and "Arrow" not in text, name


def test_no_cartesian_products(spark, small):
    for name, run in QUERIES.items():
        if name == "stream_steps":
            continue
        assert "CartesianProduct" not in plan(spark, run(spark, small)), name


def test_statistics_aggregate_before_the_shuffle(spark, small):
    assert "partial_min" in plan(spark, QUERIES["block_minmax"](spark, small))
