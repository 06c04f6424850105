"""Campaigns: a catalogue of datasets, their replicas and files, as joined tables."""

from __future__ import annotations

import sqlite3
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = {
    "host": "hostid int, hostname string",
    "directory": "dirid int, hostid int, name string",
    "dataset": "datasetid int, uuid string, name string, fileformat string, deleted int",
    "replica": "replicaid int, datasetid int, hostid int, dirid int, name string, size long, deleted int",
    "repfiles": "replicaid int, fileid int",
    "accuracy": "replicaid int, accuracy double, norm double, relative int",
    "resolution": "replicaid int, x int, y int",
}


def catalogue(dataset: DataFrame, replica: DataFrame, repfiles: DataFrame | None = None, accuracy: DataFrame | None = None) -> DataFrame:
    """Live datasets with their live replicas, and files and accuracies where present."""
    out = dataset.where("deleted = 0").join(replica.where("deleted = 0").drop("deleted"), "datasetid").drop("deleted")
    for extra in (repfiles, accuracy):
        if extra is not None:
            out = out.join(extra, "replicaid", "left")
    return out


def dataset_filter(name: Column, include: str = "", exclude: str = "") -> Column:
    """Whether a dataset is visible: full matches of ``;``-separated expressions; exclusion wins, an include list admits nothing else."""
    any_of = lambda text: [name.rlike(f"^(?:{r})$") for r in text.split(";") if r]
    keep = F.lit(True)
    if any_of(include):
        keep = F.lit(False)
        for c in any_of(include):
            keep = keep | c
    for c in any_of(exclude):
        keep = keep & ~c
    return keep


def best_replica(replicas: DataFrame, dataset: str, rank: Column, tie: str) -> DataFrame:
    """One replica of each dataset: the least rank (0 for the local host, then remote classes), ties by ``tie``."""
    rest = [c for c in replicas.columns if c != dataset]
    best = F.min_by(F.struct(*rest), F.struct(rank.alias("r"), F.col(tie).alias("t"))).alias("b")
    return replicas.groupBy(dataset).agg(best).select(dataset, *(f"b.{c}" for c in rest))


def namespace(variables: dict[str, DataFrame], separator: str = "/") -> DataFrame:
    """The variables (name, ...) of all datasets, each name behind its dataset's."""
    parts = [frame.withColumn("name", F.concat(F.lit(dataset + separator), "name")) for dataset, frame in variables.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


@dataclass
class Campaign:
    spark: SparkSession
    tables: dict[str, DataFrame]

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> Campaign:
        """Reads the catalogue's SQLite tables; a catalogue is metadata, read on the driver."""
        db = sqlite3.connect(f"file:{path.removeprefix('file://')}?mode=ro", uri=True)
        try:
            present = {r[0] for r in db.execute("select name from sqlite_master where type = 'table'")}
            tables = {}
            for name, schema in TABLES.items():
                names = [c.split()[0] for c in schema.split(", ")]
                rows = db.execute(f"select {', '.join(names)} from {name}").fetchall() if name in present else []
                tables[name] = spark.createDataFrame(rows, schema)
            return cls(spark, tables)
        finally:
            db.close()

    def datasets(self, include: str = "", exclude: str = "") -> DataFrame:
        t = self.tables
        replica = t["replica"].withColumnRenamed("name", "replica_name")
        return catalogue(t["dataset"].where(dataset_filter(F.col("name"), include, exclude)), replica, t["repfiles"], t["accuracy"]).orderBy("datasetid", "replicaid")

    def choose(self, hostname: str) -> DataFrame:
        """The replica to read for each dataset: on this host if there is one."""
        live = self.datasets().join(self.tables["host"], "hostid", "left")
        return best_replica(live, "datasetid", F.when(F.col("hostname") == hostname, 0).otherwise(1), "replicaid")
