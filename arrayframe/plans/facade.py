"""Queries that write a store, a stream or a list first and read it back through the facade."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import api
from ..functions.derived import column
from ..functions.parser import ExpressionError, parse
from ..functions.parser import variables as names_in
from ..operators import codecs
from ..operators.boxes import linear_index
from ..operators.predicates import Leaf, RangeQuery, Tree, from_json, from_xml
from ..operators.selection import Selection
from ..sources import engines, formula
from ..sources.shared import fresh
from ..streaming.status import StepStatus
from . import workload
from .arrays import BLOCKS, D1, D3, blocks_of
from .expressions import _IN, _curl_sql
from .registry import query
from .views import EV, ORD, ev1d, ord3d, table


def _event_store(spark: SparkSession, sf_dir: str, io: api.IO | None = None, **options) -> str:
    path = fresh(spark, "events")
    api.write(ev1d(spark, sf_dir).select("step", "block_id", "d0", "value"), path, io, order=("d0",), **options)
    return path


def _order_store(spark: SparkSession, sf_dir: str, **derived: tuple[str, str]) -> api.FileReader:
    """orders as a store with derived variables (expression, kind), opened again."""
    io, path = api.IO("orders"), fresh(spark, "orders")
    for name in ("f1", "f2", "f3"):
        io.define_variable(name, "double")
    for name, (expression, kind) in derived.items():
        io.define_derived_variable(name, expression, kind)
    api.write(ord3d(spark, sf_dir), path, io, order=tuple(D3))
    return api.FileReader(spark, path, D3)


@query(f"SELECT step, d0, value FROM {EV} WHERE step >= 1 AND step < 4 AND d0 >= 100 AND d0 < 350")
def store_box(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A store written by step and read again: the steps are folders, the box reaches row groups."""
    reader = api.FileReader(spark, _event_store(spark, sf_dir), D1)
    return reader.read("value", Selection.bounding_box([100], [250]).with_steps(1, 3)).select("step", "d0", "value")


@query(f"SELECT step, d0, value FROM {EV} WHERE d0 >= 5 AND d0 < 905 AND (value > 300.0 OR value < 0.05)")
def store_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A range query that asks the kept block statistics before the cells."""
    reader = api.FileReader(spark, _event_store(spark, sf_dir, stats=("value",)), D1)
    return reader.query(RangeQuery("value", Tree("OR", (Leaf("GT", 300.0), Leaf("LT", 0.05))), (5,), (900,))).select("step", "d0", "value")


@query(f"SELECT step, min(value) AS min, max(value) AS max FROM {EV} GROUP BY step")
def facade_minmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.stats import merge_stats

    return merge_stats(api.FileReader(spark, _event_store(spark, sf_dir, stats=("value",)), D1).blocks("value"), ["step"])


@query(f"SELECT step, d0, value FROM {EV} WHERE d0 >= 40 AND d0 < 100")
def variable_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A variable's own start and count are its selection."""
    value = api.IO("run").define_variable("value", "double", [1000], [40], [60])
    return value.selection().check(value.shape).apply(ev1d(spark, sf_dir), D1).select("step", "d0", "value")


@query("SELECT 'value/' || k AS name, v AS value FROM (VALUES ('unit', 'km'), ('scale', '1.5,2.5'), ('note', 'free')) AS t(k, v)")
def attributes_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attributes written with a store; of the one that changes by step the last value is the current one."""
    io = api.IO("run")
    io.define_attribute("unit", "m", variable="value", modifiable=True)
    io.define_attribute("unit", "km", variable="value", modifiable=True, step=2)
    io.define_attribute("scale", [1.5, 2.5], "double", variable="value")
    io.define_attribute("note", "free", variable="value")
    found = api.FileReader(spark, _event_store(spark, sf_dir, io), D1).attributes("value")
    return found.select(F.concat(F.lit("value/"), F.col("name")).alias("name"), F.array_join("value", ",").alias("value"))


@query("SELECT n_regionkey AS step, n_nationkey AS d0, CAST(n_nationkey * 10 AS DOUBLE) AS value, 'end of stream' AS last FROM nation")
def stream_write_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A writer's steps (one a region) read step by step until the end of the stream."""
    path, cells = fresh(spark, "steps"), table(spark, sf_dir, "nation")
    writer = api.StreamWriter(spark, path, order=("d0",))
    for key in range(5):
        writer.begin_step()
        writer.put(cells.where(F.col("n_regionkey") == key).select(F.lit(0).cast("long").alias("block_id"), F.col("n_nationkey").alias("d0"), (F.col("n_nationkey") * 10).cast("double").alias("v")))
        writer.end_step()
    writer.close()
    reader, found = api.Stream(spark, path, D1), None
    while (status := reader.begin_step()) is StepStatus.OK:
        one = reader.read("v").select("step", "d0", "value")
        found = one if found is None else found.unionByName(one)
        reader.end_step()
    return found.withColumn("last", F.lit(status.value))


@query(f"SELECT step, d0, value FROM {EV} UNION ALL SELECT step + (SELECT max(step) + 1 FROM {EV}), d0, -value FROM {EV}")
def series_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two stores and the list that names them, read as one series."""
    folder, cells = fresh(spark, "series"), ev1d(spark, sf_dir).select("step", "block_id", "d0", "value")
    engines.write(cells, f"{folder}/a", order=("d0",))
    engines.write(cells.withColumn("value", -F.col("value")), f"{folder}/b", order=("d0",))
    spark.createDataFrame([("- a\n- b\n- end",)], "value string").coalesce(1).write.text(f"{folder}/all.ats")
    return engines.read(spark, f"{folder}/all.ats").select("step", "d0", "value")


_XML = '<queries><io name="run"><var name="value"><boundingbox start="5" count="900"/><op value="OR"><range compare="GT" value="450.0"/><range compare="LE" value="0.02"/><op value="AND"><range compare="GE" value="100.0"/><range compare="LT" value="101.0"/></op></op></var></io></queries>'
_JSON = '{"io": {"name": "run", "var": {"name": "value", "boundingbox": {"start": "5", "count": "900"}, "op": {"value": "AND", "range": [{"compare": "GT", "value": 300.0}]}}}}'
_TOUCHED = f"SELECT step, block_id, greatest(start_d0, 5) AS start_d0, least(start_d0 + count_d0, 905) - greatest(start_d0, 5) AS count_d0 FROM {BLOCKS} WHERE start_d0 < 905 AND start_d0 + count_d0 > 5 AND "


@query(f"{_TOUCHED} (max > 450.0 OR min <= 0.02 OR (max >= 100.0 AND min < 101.0))")
def q_xml(spark: SparkSession, sf_dir: str) -> DataFrame:
    return from_xml(_XML, "run").touched(blocks_of(spark, sf_dir), D1).select("step", "block_id", "start_d0", "count_d0")


@query(f"{_TOUCHED} max > 300.0")
def q_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return from_json(_JSON, "run").touched(blocks_of(spark, sf_dir), D1).select("step", "block_id", "start_d0", "count_d0")


_SPECIAL = [(1.0, 0.0), (-1.0, 0.0), (1.0, -0.0), (-1.0, -0.0), (0.0, 0.0), (float("nan"), 0.0), (None, 0.0), (1.0, None), (3.0, 2.0), (0.0, -2.0)]


@query("SELECT * FROM (VALUES (0, 'Infinity'), (1, '-Infinity'), (2, '-Infinity'), (3, 'Infinity'), (4, 'NaN'), (5, 'NaN'), (6, NULL), (7, NULL), (8, '1.5'), (9, '-0.0')) AS t(i, value)")
def d_div_special(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Division by both zeros, of NaN and of null."""
    frame = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(_SPECIAL)], "i int, a double, b double")
    return frame.select("i", column("a / b", frame).cast("string").alias("value"))


@query(f"SELECT d0, d1, round(sqrt(sum(f1 * f1)), 4) AS value FROM {ORD} WHERE d0 >= 2 AND d0 < 9 AND d1 >= 1 AND d1 < 6 GROUP BY d0, d1")
def derived_box(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A box of a stored reduction: it has the dimensions that are left."""
    reader = _order_store(spark, sf_dir, size=("magnitude(f1)", "store"))
    return reader.read("size", Selection.bounding_box([2, 1], [7, 5])).select("d0", "d1", F.round("value", 4).alias("value"))


@query(f"SELECT d0, d1, d2, CAST(i AS BIGINT) AS comp, round(v[i + 1], 4) + 0.0 AS value FROM {_curl_sql(ORD, 'step, block_id')}, range(0, 3) AS t(i) WHERE {_IN.format(3, 6)}")
def derived_curl_box(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A box of a curl that only its expression is kept of: one cell more on each side is read."""
    reader = _order_store(spark, sf_dir, turn=("curl(f1, f2, f3)", "expression"))
    return reader.read("turn", Selection.bounding_box([3, 3, 3], [3, 3, 3])).select(*D3, "comp", F.round("value", 4).alias("value"))


@query(f"SELECT step, block_id, round(min(f1 * 2 + f2), 4) AS min, round(max(f1 * 2 + f2), 4) AS max FROM {ORD} GROUP BY step, block_id")
def derived_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of a derived variable the block statistics alone are kept."""
    reader = _order_store(spark, sf_dir, both=("f1 * 2 + f2", "stats"))
    return reader.blocks("both").select("step", "block_id", F.round("min", 4).alias("min"), F.round("max", 4).alias("max"))


@query("SELECT * FROM (VALUES ('a + b * c', 'a b c'), ('a/b + 1', 'a/b'), ('x = sim/V.x' || chr(10) || 'x * y', 'sim/V.x y'), ('MAGNITUDE(u, v)', 'u v'), ('1 + 2', NULL), ('sum(', NULL), ('f(x)', NULL), ('cross(x, y)', NULL), ('x[1]', NULL)) AS t(expression, names)")
def expression_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which variables expressions name; null for those that are refused."""

    def names(text: str) -> str | None:
        try:
            return " ".join(names_in(parse(text)))
        except ExpressionError:
            return None

    texts = ["a + b * c", "a/b + 1", "x = sim/V.x\nx * y", "MAGNITUDE(u, v)", "1 + 2", "sum(", "f(x)", "cross(x, y)", "x[1]"]
    return spark.createDataFrame([(t, names(t)) for t in texts], "expression string, names string")


_LOSSY = sorted(codecs.LOSSY)


@query(f"SELECT codec, (SELECT count(*) FROM events) AS n, true AS within FROM (VALUES {', '.join(f'({c!r})' for c in [*_LOSSY, *sorted(codecs.LOSSLESS)])}) AS t(codec)")
def codec_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each codec over all cells in one scan: lossless ones change nothing, lossy ones stay within 0.25."""
    value, kinds = F.col("value"), [*((c, 0.25 + 1e-9) for c in _LOSSY), *((c, 0.0) for c in sorted(codecs.LOSSLESS))]
    off = [F.max(F.abs(codecs.applied(value, "double", codecs.Operation(c, {"accuracy": "0.25"} if bound else {})) - value)) <= bound for c, bound in kinds]
    one = ev1d(spark, sf_dir).agg(F.count("value").alias("n"), *(x.alias(f"c{i}") for i, x in enumerate(off)))
    return one.select("n", F.explode(F.array(*(F.struct(F.lit(c).alias("codec"), F.col(f"c{i}").alias("within")) for i, (c, _) in enumerate(kinds)))).alias("x")).select("x.codec", "n", "x.within")


@query(f"SELECT step, d0, value / 2 AS value FROM {EV}")
def plugin_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's codec, in Arrow batches."""
    codecs.register_codec("halved", lambda s: s / 2)
    return codecs.reduce_columns(ev1d(spark, sf_dir).select("step", "d0", "value"), {"value": [codecs.Operation("halved")]})


@query(f"SELECT ((d0 - 2) * 4 + (d1 - 3)) * 5 + d2 AS place, f1 AS value FROM {ORD} WHERE d0 >= 2 AND d0 < 8 AND d1 >= 3 AND d1 < 7 AND d2 < 5")
def ordered_box(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each cell of a box lies in the reader's row-major buffer."""
    reader = _order_store(spark, sf_dir)
    start, count = [2, 3, 0], [6, 4, 5]
    cells = reader.read("f1", Selection.bounding_box(start, count))
    return cells.select(linear_index([F.col(d) - s for d, s in zip(D3, start, strict=True)], count).cast("long").alias("place"), "value")


@query("SELECT s AS step, least(i // 2, 2) AS block_id, i AS d0, j AS d1, 1000.0 * s + 3 * i + j AS u FROM range(2) a(s), range(7) b(i), range(3) c(j) WHERE i >= 2 AND i < 5 AND j >= 1")
def workload_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A scripted workload's store, read in a box."""
    folder = fresh(spark, "workload")
    workload.run(spark, "steps 2\narray u double 7,3 3\nwrite run u\nread run u 2,1 3,2\n", folder)
    return Selection.bounding_box([2, 1], [3, 2]).apply(engines.read(spark, f"{folder}/run"), ["d0", "d1"]).select("step", "block_id", "d0", "d1", "u")


@query("SELECT s AS step, least(i // 2, 2) AS block_id, i AS d0, j AS d1, 1000.0 * s + 3 * i + j AS value FROM range(2) a(s), range(7) b(i), range(3) c(j)")
def formula_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An engine plugin: a data source of arrays by formula."""
    formula.register(spark)
    return spark.read.format("arrayformula").options(shape="7,3", steps="2", blocks="3").load()


@query(f"SELECT step, d0, value FROM {EV}")
def inline_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writer and reader in one session: the cells pass by name."""
    engines.write(ev1d(spark, sf_dir).select("step", "d0", "value"), "inline_events", "inline")
    return engines.read(spark, "inline_events", "inline")
