"""Queries on selections, statistics and range predicates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import predicates, stats, steps
from ..operators.boxes import match_blocks
from ..operators.predicates import CompositeQuery, Leaf, RangeQuery, Tree
from ..operators.selection import Selection, from_dump, ghost_cells, memory_buffer
from ..types import TYPES
from .registry import query
from .views import EV, ORD, ev1d, ord3d, table

D1, D3 = ["d0"], ["d0", "d1", "d2"]
#: The selective tree of the flagship query, and one with every comparison kind.
TREE = Tree("OR", (Leaf("GT", 300.0), Leaf("LT", 0.05)))
DEEP = Tree("OR", (Leaf("GT", 450.0), Leaf("LE", 0.02), Tree("AND", (Leaf("GE", 100.0), Leaf("LT", 101.0)))))
BOX = ((5,), (900,))
BLOCKS = f"(SELECT step, block_id, min(d0) AS start_d0, max(d0) - min(d0) + 1 AS count_d0, min(value) AS min, max(value) AS max FROM {EV} GROUP BY step, block_id)"
_TREE_I, _TREE_V = "(max > 300.0 OR min < 0.05)", "(value > 300.0 OR value < 0.05)"
_DEEP_I = "(max > 450.0 OR min <= 0.02 OR (max >= 100.0 AND min < 101.0))"


def blocks_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.block_stats(ev1d(spark, sf_dir), D1)


@query(f"SELECT step, d0, value FROM {EV}")
def scan_project(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev1d(spark, sf_dir).select("step", "d0", "value")


@query("SELECT * FROM (VALUES ('char', 1, false), ('double', 8, true), ('double complex', 16, false), ('float', 4, true), ('float complex', 8, false), ('int16', 2, true), ('int32', 4, true), ('int64', 8, true), ('int8', 1, true), ('long double', 16, true), ('string', 0, false), ('uint16', 2, true), ('uint32', 4, true), ('uint64', 8, true), ('uint8', 1, true)) AS t(name, size, has_minmax)")
def type_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(t.name, t.size, t.has_minmax) for t in TYPES.values()], "name string, size int, has_minmax boolean")


@query(f"SELECT step, d0, value FROM {EV} WHERE d0 >= 100 AND d0 < 350")
def bbox_1d(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Selection.bounding_box([100], [250]).apply(ev1d(spark, sf_dir), D1).select("step", "d0", "value")


@query(f"SELECT d0, d1, d2, f1 FROM {ORD} WHERE d0 >= 2 AND d0 < 8 AND d1 >= 3 AND d1 < 7 AND d2 >= 0 AND d2 < 5")
def bbox_3d(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Selection.bounding_box([2, 3, 0], [6, 4, 5]).apply(ord3d(spark, sf_dir), D3).select(*D3, "f1")


@query(f"SELECT step, d0, value FROM {EV} WHERE step >= 2 AND step < 5 AND d0 >= 10 AND d0 < 60")
def bbox_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Selection.bounding_box([10], [50]).with_steps(2, 3).apply(ev1d(spark, sf_dir), D1).select("step", "d0", "value")


@query(f"SELECT step, d0, value FROM {EV} WHERE step IN (1, 3) OR (step >= 5 AND step <= 6)")
def select_steps_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    return steps.select_steps(ev1d(spark, sf_dir), "1:3:2 5:6", renumber=False).select("step", "d0", "value")


@query(f"SELECT step, count(*) AS n, round(sum(value), 4) AS total FROM {EV} WHERE step >= 1 AND (step - 1) % 3 = 0 GROUP BY step")
def select_steps_modulo(spark: SparkSession, sf_dir: str) -> DataFrame:
    return steps.select_steps(ev1d(spark, sf_dir), "1:n:3", renumber=False).groupBy("step").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query(f"SELECT dense_rank() OVER (ORDER BY step) - 1 AS step, d0, value FROM {EV} WHERE step >= 1 AND (step - 1) % 3 = 0")
def renumber(spark: SparkSession, sf_dir: str) -> DataFrame:
    return steps.select_steps(ev1d(spark, sf_dir), "1:n:3").select("step", "d0", "value")


@query(f"SELECT step, d0, value FROM {EV} WHERE block_id = 3 AND d0 - 300 >= 10 AND d0 - 300 < 30")
def block_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = ev1d(spark, sf_dir).withColumn("origin", F.col("block_id") * 100)
    return Selection.bounding_box([10], [20]).with_block(3).apply(cells, D1, ["origin"]).select("step", "d0", "value")


@query(f"SELECT count(*) AS n FROM {EV} WHERE step >= 2 AND step < 5 AND d0 >= 10 AND d0 < 60")
def selection_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bbox_steps(spark, sf_dir).agg(F.count("*").alias("n"))


@query(f"SELECT g.step, g.m0, coalesce(e.value, -1.0) AS value FROM (SELECT step, m0 FROM (SELECT DISTINCT step FROM {EV}), range(0, 54) AS t(m0)) g LEFT JOIN (SELECT step, d0 - 400 + 2 AS m0, value FROM {EV} WHERE d0 >= 400 AND d0 < 450) e ON g.step = e.step AND g.m0 = e.m0")
def ghost_cells_(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ghost_cells(ev1d(spark, sf_dir), Selection.bounding_box([400], [50]), "d0", 2, 2, -1.0)


@query(f"SELECT * FROM {BLOCKS}")
def block_minmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blocks_of(spark, sf_dir)


@query(f"SELECT step, block_id, CASE WHEN d0 % 100 < 68 THEN (d0 % 100) // 17 ELSE 4 + (d0 % 100 - 68) // 16 END AS sub_id, min(value) AS min, max(value) AS max FROM {EV} GROUP BY ALL")
def subblock_minmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.sub_block_stats(ev1d(spark, sf_dir), D1, [100], 17, [F.col("block_id") * 100])


@query(f"SELECT step, min(value) AS min, max(value) AS max FROM {EV} GROUP BY step")
def var_minmax_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.merge_stats(blocks_of(spark, sf_dir), ["step"])


@query(f"SELECT min(value) AS min, max(value) AS max FROM {EV}")
def var_minmax_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.merge_stats(blocks_of(spark, sf_dir), [])


@query(f"SELECT min(value) AS min, max(value) AS max FROM {EV} WHERE step = 1 AND d0 >= 250 AND d0 < 750")
def box_minmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = Selection.bounding_box([250], [500]).with_steps(1, 1).apply(ev1d(spark, sf_dir), D1)
    return stats.merge_stats(stats.block_stats(cells, D1), [])


_CPLX = f"(SELECT step, value AS re, CAST(user_id AS DOUBLE) AS im, value * value + CAST(user_id AS DOUBLE) * CAST(user_id AS DOUBLE) AS n FROM {EV})"


@query(f"SELECT step, arg_min(re, (n, re, im)) AS min_re, arg_min(im, (n, re, im)) AS min_im, arg_max(re, (n, -re, -im)) AS max_re, arg_max(im, (n, -re, -im)) AS max_im FROM {_CPLX} GROUP BY step")
def complex_minmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.complex_extremes(ev1d(spark, sf_dir).withColumn("im", F.col("user_id").cast("double")), "value", "im", ["step"])


def _leaf(op: str, value: float):
    sql = {"GT": f"max > {value}", "LT": f"min < {value}", "GE": f"max >= {value}", "LE": f"min <= {value}", "EQ": f"min <= {value} AND max >= {value}", "NE": f"NOT (min = {value} AND max = {value})"}[op]

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return RangeQuery("value", Tree("AND", (Leaf(op, value),))).touched(blocks_of(spark, sf_dir), D1).select("step", "block_id")

    run.__name__ = f"q_{op.lower()}"
    query(f"SELECT step, block_id FROM {BLOCKS} WHERE {sql}")(run)


for _op, _v in (("GT", 300.0), ("LT", 0.05), ("GE", 250.0), ("LE", 0.1), ("EQ", 200.0), ("NE", 17.5)):
    _leaf(_op, _v)


@query(f"SELECT step, block_id FROM {BLOCKS} WHERE {_DEEP_I}")
def q_tree_or_and(spark: SparkSession, sf_dir: str) -> DataFrame:
    return RangeQuery("value", DEEP).touched(blocks_of(spark, sf_dir), D1).select("step", "block_id")


@query(f"SELECT step, d0, block_id, value FROM {EV} e WHERE {_TREE_V} AND d0 >= 5 AND d0 < 905 AND EXISTS (SELECT 1 FROM {BLOCKS} b WHERE b.step = e.step AND b.block_id = e.block_id AND {_TREE_I} AND start_d0 < 905 AND 5 < start_d0 + count_d0)")
def q_exact_refine(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = ev1d(spark, sf_dir).select("step", "d0", "block_id", "value")
    asked = RangeQuery("value", TREE, *BOX)
    return asked.refine(cells, asked.touched(blocks_of(spark, sf_dir), D1), D1).select("step", "d0", "block_id", "value")


_CLIPPED = f"(SELECT step, block_id, greatest(start_d0, 5) AS start_d0, least(start_d0 + count_d0, 905) - greatest(start_d0, 5) AS count_d0, min, max FROM {BLOCKS} WHERE {_TREE_I} AND start_d0 < 905 AND 5 < start_d0 + count_d0)"


@query(f"SELECT * FROM {_CLIPPED}")
def q_box_clip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return RangeQuery("value", TREE, *BOX).touched(blocks_of(spark, sf_dir), D1)


@query(f"SELECT step, block_id, start_d0 + 995 AS start_d0, count_d0 FROM {_CLIPPED}")
def q_output_region(spark: SparkSession, sf_dir: str) -> DataFrame:
    return predicates.move_region(q_box_clip(spark, sf_dir), D1, [5], [1000]).select("step", "block_id", "start_d0", "count_d0")


def _fields(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    return {f: stats.block_stats(ord3d(spark, sf_dir), D3, f) for f in ("f1", "f2")}


def _field_sql(f: str, where: str, box: bool = True) -> str:
    boxes = ", ".join(f"min({d}) AS start_{d}, max({d}) - min({d}) + 1 AS count_{d}" for d in D3)
    return f"(SELECT step, block_id, {boxes} FROM {ORD} GROUP BY step, block_id HAVING {where.replace('max', f'max({f})').replace('min', f'min({f})')})"


_F1, _F2 = _field_sql("f1", "max > 499000.0"), _field_sql("f2", "min < 3.0")
_COLS = "step, block_id, start_d0, count_d0, start_d1, count_d1, start_d2, count_d2"


@query(f"SELECT {', '.join('a.' + c for c in _COLS.split(', '))} FROM {_F1} a JOIN {_F2} b USING (step, block_id)")
def q_composite_and(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = CompositeQuery("AND", (RangeQuery("f1", Tree("AND", (Leaf("GT", 499000.0),))), RangeQuery("f2", Tree("AND", (Leaf("LT", 3.0),)))))
    return asked.touched(_fields(spark, sf_dir), D3)


@query(f"SELECT {_COLS} FROM {_F1} UNION SELECT {_COLS} FROM {_F2}")
def q_composite_or(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = CompositeQuery("OR", (RangeQuery("f1", Tree("AND", (Leaf("GT", 499000.0),))), RangeQuery("f2", Tree("AND", (Leaf("LT", 3.0),)))))
    return asked.touched(_fields(spark, sf_dir), D3)


_SUBS = f"(SELECT step, block_id, (d0 % 100) // 10 AS sub_id, min(value) AS min, max(value) AS max FROM {EV} GROUP BY ALL)"


@query(f"SELECT step, block_id, count(*) = count(*) FILTER ({_TREE_I}) AS whole, count(*) FILTER ({_TREE_I}) AS hits FROM {_SUBS} GROUP BY step, block_id HAVING count(*) FILTER ({_TREE_I}) > 0")
def q_subblock(spark: SparkSession, sf_dir: str) -> DataFrame:
    subs = stats.sub_block_stats(ev1d(spark, sf_dir), D1, [100], 10, [F.col("block_id") * 100])
    hit = TREE.on_interval(F.col("min"), F.col("max"))
    return subs.groupBy("step", "block_id").agg(F.every(hit).alias("whole"), F.count_if(hit).alias("hits")).where("hits > 0")


@query(f"SELECT 'value' AS name, 'double' AS type, count(DISTINCT step) AS steps, CAST(max(d0) + 1 AS VARCHAR) AS shape, min(value) AS min, max(value) AS max FROM {EV} UNION ALL SELECT 'user_id', 'int64', count(DISTINCT step), CAST(max(d0) + 1 AS VARCHAR), CAST(min(user_id) AS DOUBLE), CAST(max(user_id) AS DOUBLE) FROM {EV}")
def list_vars(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..sources.catalog import available_variables

    cells = ev1d(spark, sf_dir)
    parts = [stats.block_stats(cells.withColumn("v", F.col(v).cast("double")), D1, "v").select(F.lit(v).alias("name"), F.lit(t).alias("type"), "*") for v, t in (("value", "double"), ("user_id", "int64"))]
    return available_variables(parts[0].unionByName(parts[1]), D1).select("name", "type", "steps", "shape", "min", "max")


@query(f"SELECT step, block_id, '[' || start_d0 || ':' || (start_d0 + count_d0 - 1) || ']' AS box, min, max FROM {BLOCKS}")
def list_decomp(spark: SparkSession, sf_dir: str) -> DataFrame:
    box = F.concat(F.lit("["), F.col("start_d0"), F.lit(":"), F.col("start_d0") + F.col("count_d0") - 1, F.lit("]"))
    return blocks_of(spark, sf_dir).select("step", "block_id", box.alias("box"), "min", "max")


@query(f"SELECT step, d0, value FROM {EV} WHERE step >= 1 AND step < 4 AND d0 >= 990")
def dump_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return from_dump([1, -10], [3, -1], [10, 1000]).apply(ev1d(spark, sf_dir), D1).select("step", "d0", "value")


_NAMES = "(SELECT n_name || '/' || c_mktsegment || '/' || 'acctbal' AS name FROM customer JOIN nation ON c_nationkey = n_nationkey)"


def names_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return joined.select(F.concat_ws("/", "n_name", "c_mktsegment", F.lit("acctbal")).alias("name"))


@query(f"SELECT name, count(*) AS n FROM {_NAMES} WHERE name GLOB '*1/*/acct*' GROUP BY name")
def glob_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..sources.catalog import name_matches

    return names_of(spark, sf_dir).where(name_matches("*1/*/acct*", F.col("name"))).groupBy("name").agg(F.count("*").alias("n"))


@query(f"SELECT DISTINCT split_part(name, '/', 1) AS child, true AS is_group FROM {_NAMES}")
def group_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..sources.catalog import group_children

    return group_children(names_of(spark, sf_dir))


_READERS = "(SELECT CAST(i AS BIGINT) AS reader, i * 160 AS r0, 160 AS rc FROM range(0, 6) AS t(i))"


@query(f"SELECT step, block_id, reader, greatest(start_d0, r0) AS o_start, least(start_d0 + count_d0, r0 + rc) - greatest(start_d0, r0) AS o_count FROM {BLOCKS}, {_READERS} WHERE start_d0 < r0 + rc AND r0 < start_d0 + count_d0")
def overlap_mxn(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocks = blocks_of(spark, sf_dir).select("step", "block_id", F.array("start_d0").alias("start"), F.array("count_d0").alias("count"))
    readers = spark.range(6).select(F.col("id").alias("reader"), F.array(F.col("id") * 160).alias("r_start"), F.array(F.lit(160).cast("long")).alias("r_count"))
    return match_blocks(blocks, readers, 1, 200).select("step", "block_id", "reader", F.get("o_start", 0).alias("o_start"), F.get("o_count", 0).alias("o_count"))


@query(f"SELECT d1 AS slice, least(floor((f1 - lo) / ((hi - lo) / 20)), 19)::BIGINT AS bin, count(*) AS n FROM {ORD}, (SELECT min(f1) AS lo, max(f1) AS hi FROM {ORD}) GROUP BY ALL")
def histogram_pdf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.histogram(ord3d(spark, sf_dir).withColumnRenamed("d1", "slice"), "slice", "f1", 20)


@query(f"SELECT step FROM (SELECT step, lag(step) OVER (ORDER BY step) AS previous FROM (SELECT DISTINCT step FROM {EV} WHERE step % 4 <> 2)) WHERE step <> previous + 1")
def step_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return steps.step_gaps(ev1d(spark, sf_dir).where("step % 4 <> 2")).select("step")


@query(f"SELECT step, count(*) AS n, round(avg(value), 6) AS avg, round(stddev_pop(value), 6) AS std_dev FROM {EV} GROUP BY step")
def var_moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.moments(ev1d(spark, sf_dir), ["step"]).select("step", "n", F.round("avg", 6).alias("avg"), F.round("std_dev", 6).alias("std_dev"))


@query(f"SELECT CAST(0 AS BIGINT) AS step, g.m0, g.m1, g.m2, coalesce(f1, -1.0) AS f1 FROM (SELECT a.m0, b.m1, c.m2 FROM range(0, 4) AS a(m0), range(0, 5) AS b(m1), range(0, 3) AS c(m2)) g LEFT JOIN (SELECT d0 - 1 + 1 AS m0, d1 - 4 + 1 AS m1, d2 AS m2, f1 FROM {ORD} WHERE d0 >= 1 AND d0 < 3 AND d1 >= 4 AND d1 < 7 AND d2 < 3) o ON o.m0 = g.m0 AND o.m1 = g.m1 AND o.m2 = g.m2")
def memory_box(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A box of 2 x 3 x 3 in a buffer of 4 x 5 x 3."""
    wanted = Selection.bounding_box([1, 4, 0], [2, 3, 3]).with_memory([1, 1, 0], [4, 5, 3])
    return memory_buffer(ord3d(spark, sf_dir), wanted, D3, -1.0, "f1")
