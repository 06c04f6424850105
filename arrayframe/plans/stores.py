"""Queries on layouts, series, campaigns, comparison, codecs and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import codecs, compare, layout, stats, steps
from ..operators.boxes import linear_index
from ..sources import campaign, profiles, timeseries
from ..sources.catalog import attributes_of_variables, current_attributes
from ..sources.shared import fresh
from ..streaming import policies
from .registry import query
from .views import EV, ORD, PERTURBED, ev1d, ord3d, perturbed, table

_JOIN = "(SELECT CAST(0 AS BIGINT) AS step, c_nationkey AS writer, count(*) AS count FROM customer GROUP BY c_nationkey)"


@query(f"SELECT step, writer, count, CAST(coalesce(sum(count) OVER (PARTITION BY step ORDER BY writer ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS offset FROM {_JOIN}")
def joined_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocks = table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("writer")).agg(F.count("*").alias("count")).select(F.lit(0).cast("long").alias("step"), "writer", "count")
    return layout.joined_offsets(blocks, ["writer"], "count")


@query(f"SELECT step, unnest(list(total ORDER BY writer)) AS value, unnest(range(count(*))) AS idx FROM (SELECT step, writer, count(*) AS total FROM {EV} GROUP BY step, writer) GROUP BY step")
def local_value_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    per_writer = ev1d(spark, sf_dir).groupBy("step", "writer").agg(F.count("*").alias("total"))
    return layout.local_values(per_writer, "writer", "total").select("step", F.posexplode("values").alias("idx", "value")).select("step", "value", F.col("idx").cast("long").alias("idx"))


@query(f"SELECT step, d0, value FROM (SELECT step, d0 % 150 AS d0, value, row_number() OVER (PARTITION BY step, d0 % 150 ORDER BY block_id DESC, d0 DESC) AS rn FROM {EV}) WHERE rn = 1")
def block_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = ev1d(spark, sf_dir).withColumn("block_id", F.col("block_id") * 1000 + F.col("d0")).withColumn("d0", F.col("d0") % 150)
    return layout.place_blocks(cells, ["step", "d0"])


def _series(spark: SparkSession, sf_dir: str) -> list[DataFrame]:
    cells = ev1d(spark, sf_dir).select("step", "d0", "value")
    first, second, last = F.col("step") < 3, (F.col("step") >= 3) & (F.col("step") < 5), F.col("step") >= 5
    return [cells.where(part).withColumn("step", F.col("step") - a) for a, part in ((0, first), (3, second), (5, last))]


@query(f"SELECT step, d0, value FROM {EV}")
def ts_concat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timeseries.concatenate(_series(spark, sf_dir))


@query(f"SELECT DISTINCT step, CASE WHEN step < 3 THEN 'a' WHEN step < 5 THEN 'b' ELSE 'c' END AS file FROM {EV}")
def ts_find_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = ev1d(spark, sf_dir).select("step").distinct()
    last = seen.agg(F.greatest(F.max("step"), F.lit(5))).scalar()
    ranges = spark.createDataFrame([("a", 0, 2), ("b", 3, 4), ("c", 5, None)], "file string, first_step bigint, last_step bigint").withColumn("last_step", F.coalesce("last_step", last))
    return timeseries.file_of_step(ranges, seen)


@query(f"SELECT min(value) AS min, max(value) AS max FROM {EV}")
def ts_minmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = [stats.merge_stats(stats.block_stats(p, ["d0"], keys=["step"]), []) for p in _series(spark, sf_dir)]
    return stats.merge_stats(parts[0].unionByName(parts[1]).unionByName(parts[2]), [])


@query("SELECT n_nationkey AS datasetid, s_suppkey AS replicaid, c_custkey AS fileid, n_name AS name, s_name AS replica_name FROM (SELECT * FROM nation WHERE n_nationkey % 5 <> 4) JOIN (SELECT * FROM supplier WHERE s_suppkey % 7 <> 3) ON s_nationkey = n_nationkey LEFT JOIN customer ON c_custkey % (SELECT max(s_suppkey) + 1 FROM supplier) = s_suppkey")
def campaign_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    dataset = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("datasetid"), F.col("n_name").alias("name"), (F.col("n_nationkey") % 5 == 4).cast("int").alias("deleted"))
    replica = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("replicaid"), F.col("s_nationkey").alias("datasetid"), F.col("s_name").alias("replica_name"), (F.col("s_suppkey") % 7 == 3).cast("int").alias("deleted"))
    places = table(spark, sf_dir, "supplier").agg(F.max("s_suppkey") + 1).scalar()
    files = table(spark, sf_dir, "customer").select((F.col("c_custkey") % places).alias("replicaid"), F.col("c_custkey").alias("fileid"))
    return campaign.catalogue(dataset, replica, files).select("datasetid", "replicaid", "fileid", "name", "replica_name")


@query("SELECT s_nationkey AS datasetid, arg_min(s_suppkey, (s_suppkey % 6, s_suppkey)) AS replicaid FROM supplier GROUP BY s_nationkey")
def replica_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    replicas = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("datasetid"), F.col("s_suppkey").alias("replicaid"))
    return campaign.best_replica(replicas, "datasetid", F.col("replicaid") % 6, "replicaid")


@query("SELECT n_name AS name FROM nation WHERE regexp_full_match(n_name, '.*[0-5]') AND NOT regexp_full_match(n_name, '.*1.*')")
def dataset_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").where(campaign.dataset_filter(F.col("n_name"), ".*[0-5]", ".*1.*;none")).select(F.col("n_name").alias("name"))


@query(f"SELECT coalesce(a.step, b.step) AS step, coalesce(a.d0, b.d0) AS d0, a.value AS left, b.value AS right FROM {EV} a FULL JOIN {PERTURBED} b ON a.step = b.step AND a.d0 = b.d0 WHERE a.value IS NULL OR b.value IS NULL OR abs(a.value - b.value) > 0.25")
def diff_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare.diff_values(ev1d(spark, sf_dir), perturbed(spark, sf_dir), ["step", "d0"], absolute=0.25)


@query(f"SELECT a.step, a.d0, a.value AS left, b.value AS right FROM {EV} a JOIN {PERTURBED} b ON a.step = b.step AND a.d0 = b.d0 WHERE CASE WHEN a.value = 0 THEN abs(a.value - b.value) > 0 ELSE 100 * (abs(a.value - b.value) / abs(a.value)) > 2 END")
def diff_relative(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare.diff_values(ev1d(spark, sf_dir), perturbed(spark, sf_dir), ["step", "d0"], relative=2.0).where("left is not null and right is not null")


@query("SELECT n_name AS name, 'left' AS side FROM nation WHERE n_nationkey < 5 UNION ALL SELECT n_name, 'right' FROM nation WHERE n_nationkey >= 20")
def diff_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = table(spark, sf_dir, "nation").select("n_nationkey", F.col("n_name").alias("name"))
    return compare.diff_names(names.where("n_nationkey < 20").select("name"), names.where("n_nationkey >= 5").select("name"))


@query(f"SELECT coalesce(a.step, b.step) AS step, a.min AS left_min, a.max AS left_max, b.min AS right_min, b.max AS right_max FROM (SELECT step, min(value) AS min, max(value) AS max FROM {EV} GROUP BY step) a FULL JOIN (SELECT step, min(value) AS min, max(value) AS max FROM {PERTURBED} GROUP BY step) b USING (step) WHERE a.min <> b.min OR a.max <> b.max")
def diff_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    of = lambda f: stats.merge_stats(stats.block_stats(f, ["d0"]), ["step"])
    return compare.diff_stats(of(ev1d(spark, sf_dir)), of(perturbed(spark, sf_dir)), ["step"])


@query(f"SELECT d0, d1, d2, f1, least(d1 // 2, 3) + 4 * least(d2 // 5, 1) AS block_id FROM {ORD}")
def reorganize_4x2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.reorganize(ord3d(spark, sf_dir), ["d1", "d2"], [10, 10], [4, 2]).select("d0", "d1", "d2", "f1", "block_id")


@query(f"SELECT step, d0, value FROM {EV} WHERE step < 4 UNION ALL SELECT step + (SELECT least(4, count(DISTINCT step)) FROM {EV}), d0, value * 2 FROM {EV} WHERE step < 2")
def append_after_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = ev1d(spark, sf_dir).select("step", "d0", "value")
    return steps.append_after(cells, cells.where("step < 2").withColumn("value", F.col("value") * 2), 4)


@query(f"SELECT CAST(0 AS BIGINT) AS step, step * 10 + block_id AS block_id, d0, value FROM {EV}")
def flatten_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return steps.flatten_steps(ev1d(spark, sf_dir), 10).select("step", "block_id", "d0", "value")


@query(f"SELECT step, d0, round(round(value / 0.2) * 0.2, 6) AS value, abs(round(value / 0.2) * 0.2 - value) <= 0.1 + 1e-9 AS within FROM {EV}")
def quantize_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = ev1d(spark, sf_dir)
    q = layout.quantize(F.col("value"), 0.1)
    return cells.select("step", "d0", F.round(q, 6).alias("value"), (F.abs(q - F.col("value")) <= 0.1 + 1e-9).alias("within"))


@query("SELECT event_id, value FROM events")
def encrypt_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = b"0123456789abcdef"
    some = table(spark, sf_dir, "events").select("event_id", "value")
    return layout.decrypt(layout.encrypt(some, "value", key), "value", key)


@query(f"SELECT step, d0, value FROM {EV} WHERE step IN (SELECT DISTINCT step FROM {EV} ORDER BY step LIMIT 3)")
def sst_discard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return policies.queued(ev1d(spark, sf_dir), 3).select("step", "d0", "value")


@query(f"SELECT step, d0, value FROM {EV} WHERE step IN (SELECT DISTINCT step FROM {EV} ORDER BY step DESC LIMIT 3)")
def sst_reserve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return policies.reserved(ev1d(spark, sf_dir), 3).select("step", "d0", "value")


@query(f"SELECT step, d0, value FROM {EV} WHERE step % 3 = 1")
def sst_roundrobin(spark: SparkSession, sf_dir: str) -> DataFrame:
    return policies.round_robin(ev1d(spark, sf_dir), 3, 1).select("step", "d0", "value")


@query(f"SELECT step, d0, value FROM {EV} WHERE step = (SELECT max(step) FROM {EV})")
def sst_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return policies.latest(ev1d(spark, sf_dir)).select("step", "d0", "value")


@query(f"SELECT step, d0, value FROM {EV} WHERE step IN (SELECT DISTINCT step FROM {EV} ORDER BY step DESC LIMIT 2) OR step = (SELECT min(step) FROM {EV})")
def sst_precious(spark: SparkSession, sf_dir: str) -> DataFrame:
    return policies.queued(ev1d(spark, sf_dir), 2, readers=False, first_precious=True).select("step", "d0", "value")


@query("SELECT n_name AS variable, 'units/' || r_name AS attribute, n_nationkey AS id FROM nation JOIN region ON n_regionkey = r_regionkey")
def attribute_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    attributes = both.select(F.concat_ws("/", "n_name", F.lit("units"), "r_name").alias("name"), F.col("n_nationkey").alias("id"))
    return attributes_of_variables(attributes, table(spark, sf_dir, "nation").select(F.col("n_name").alias("name")))


@query(f"SELECT step, count(*) AS n, round(sum(value), 4) AS total FROM {EV} GROUP BY step")
def stream_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A store written by step and read back as a stream of micro-batches, summed by step."""
    from ..sources import engines
    from ..streaming.steps import for_each_step, stream

    base = fresh(spark, "stream")
    cells = ev1d(spark, sf_dir).select("step", "d0", "value")
    engines.write(cells, f"{base}/in", order=("d0",))
    source = stream(spark, f"{base}/in", cells.schema, bytes_per_batch=32 << 20)

    def run(batch: DataFrame, number: int) -> None:
        batch.groupBy("step").agg(F.count("*").alias("n"), F.sum("value").alias("total")).write.mode("overwrite").parquet(f"{base}/out/batch={number}")

    for_each_step(source, run, f"{base}/state").awaitTermination()
    parts = spark.read.parquet(f"{base}/out").drop("batch")
    return parts.groupBy(F.col("step").cast("long").alias("step")).agg(F.sum("n").alias("n"), F.round(F.sum("total"), 4).alias("total"))


@query(f"SELECT step, round(max(abs(q - value)), 6) AS max_error, round(sqrt(avg((q - value) * (q - value))), 6) AS rms_error FROM (SELECT step, value, round(value / 0.5) * 0.5 AS q FROM {EV}) GROUP BY step")
def codec_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = ev1d(spark, sf_dir).select("step", "d0", "value")
    kept = codecs.reduce_columns(cells, {"value": [codecs.Operation("zfp", {"accuracy": "0.25"})]})
    return codecs.provided_error(cells, kept, ["step", "d0"], ["step"]).select("step", F.round("max_error", 6).alias("max_error"), F.round("rms_error", 6).alias("rms_error"))


@query("SELECT 'k' AS name, count(*) AS n, sum(CAST(json_extract(props, '$.k') AS DOUBLE)) AS total, min(CAST(json_extract(props, '$.k') AS DOUBLE)) AS least, max(CAST(json_extract(props, '$.k') AS DOUBLE)) AS most FROM events WHERE json_extract(props, '$.k') IS NOT NULL")
def profile_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profiles.summary(profiles.timings(table(spark, sf_dir, "events"), "props", "user_id"))


@query(f"SELECT d0, d1, d2, d0 * 100 + d1 * 10 + d2 AS row_major, d0 + (SELECT max(d0) + 1 FROM {ORD}) * (d1 + 10 * d2) AS column_major FROM {ORD}")
def linear_indexes(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = ord3d(spark, sf_dir)
    extent = cells.agg(F.max("d0") + 1).scalar()
    dims = [F.col(d) for d in ("d0", "d1", "d2")]
    columns = F.col("d0") + extent * (F.col("d1") + 10 * F.col("d2"))
    return cells.select("d0", "d1", "d2", linear_index(dims, [0, 10, 10]).alias("row_major"), columns.alias("column_major"))


@query(f"SELECT step, d0, value FROM (SELECT *, dense_rank() OVER (ORDER BY step) - 1 AS relative FROM {EV} WHERE step % 2 = 1) WHERE relative >= 1 AND relative < 3")
def relative_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return steps.relative_steps(ev1d(spark, sf_dir).where("step % 2 = 1"), 1, 2).select("step", "d0", "value")


@query("SELECT event_type AS name, arg_max(CAST(value AS VARCHAR), event_id) AS value FROM events GROUP BY event_type")
def attribute_last_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attributes modified step after step: the last value of each stays."""
    events = table(spark, sf_dir, "events")
    rows = events.select(F.col("event_type").alias("name"), F.lit("double").alias("type"), F.lit(1).alias("elements"), F.array(F.col("value").cast("string")).alias("value"), F.lit(True).alias("single"), F.col("event_id").alias("step"))
    return current_attributes(rows).select("name", F.get("value", 0).alias("value"))


@query(f"SELECT step, d0, value FROM {EV} WHERE d0 >= 200 AND d0 < 900 AND NOT (d0 >= 350 AND d0 < 600)")
def box_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A cached box is cut out of the wanted one: the rest is read box by box."""
    from functools import reduce

    from ..operators.boxes import subtract
    from ..operators.selection import Selection

    cells = ev1d(spark, sf_dir)
    parts = [Selection.bounding_box(s, c).apply(cells, ["d0"]) for s, c in subtract(((200,), (700,)), ((350,), (250,)))]
    return reduce(DataFrame.unionByName, parts).select("step", "d0", "value")


@query("SELECT 'world/' || r_name AS name, r_regionkey AS id FROM region UNION ALL SELECT 'lands/' || n_name, n_nationkey FROM nation")
def campaign_namespace(spark: SparkSession, sf_dir: str) -> DataFrame:
    regions = table(spark, sf_dir, "region").select(F.col("r_name").alias("name"), F.col("r_regionkey").alias("id"))
    nations = table(spark, sf_dir, "nation").select(F.col("n_name").alias("name"), F.col("n_nationkey").alias("id"))
    return campaign.namespace({"world": regions, "lands": nations})


@query(f"SELECT step, d0, value FROM {EV} WHERE step IN (0, 2, 5)")
def sst_ondemand(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = spark.createDataFrame([(0, 1), (1, 0), (2, 1), (3, 0), (5, 1)], "step bigint, reader int")
    return policies.distribute(ev1d(spark, sf_dir), "OnDemand", 2, 1, asked).select("step", "d0", "value")
