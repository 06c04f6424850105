"""What a store holds: variables, attributes, groups, as small DataFrames."""

from __future__ import annotations

import fnmatch
import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def available_variables(blocks: DataFrame, dims: Sequence[str]) -> DataFrame:
    """(name, type, steps, shape, single_value, min, max) from a blocks table (name, type, step, start_, count_, min, max)."""
    ends = [F.max(F.col(f"start_{d}") + F.col(f"count_{d}")).cast("string") for d in dims]
    shape = F.concat_ws(",", *ends) if ends else F.lit("")
    return blocks.groupBy("name", "type").agg(F.countDistinct("step").alias("steps"), shape.alias("shape"), F.min("min").alias("min"), F.max("max").alias("max")).withColumn("single_value", F.col("shape") == "")


def attributes_frame(spark: SparkSession, rows: Sequence[tuple]) -> DataFrame:
    """(name, type, elements, value, single, step) of attribute definitions (name, type, value or list, step)."""
    flat = [(n, t, len(v) if isinstance(v, list) else 1, [str(x) for x in (v if isinstance(v, list) else [v])], not isinstance(v, list), s) for n, t, v, s in rows]
    return spark.createDataFrame(flat, "name string, type string, elements int, value array<string>, single boolean, step bigint")


def current_attributes(attributes: DataFrame) -> DataFrame:
    """Each attribute's last value."""
    last = F.max_by(F.struct("type", "elements", "value", "single"), "step").alias("a")
    return attributes.groupBy("name").agg(last).select("name", "a.type", "a.elements", "a.value", "a.single")


def available_attributes(attributes: DataFrame, variable: str = "", separator: str = "/") -> DataFrame:
    """All attributes, or those of a variable without the variable's name."""
    if not variable:
        return attributes
    prefix = variable + separator
    return attributes.where(F.col("name").startswith(prefix)).withColumn("name", F.substring("name", len(prefix) + 1, 1 << 30))


def attributes_of_variables(attributes: DataFrame, variables: DataFrame, separator: str = "/") -> DataFrame:
    """(variable, attribute, ...): each attribute by the variables whose name and separator begin its own.

    An equi-join: an attribute is listed under every prefix that ends at a separator.
    """
    parts = F.split("name", re.escape(separator))
    prefixes = F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda n: F.struct(F.array_join(F.slice(parts, 1, n), separator).alias("variable"), F.array_join(F.slice(parts, n + 1, F.size(parts)), separator).alias("attribute")))
    listed = attributes.where(F.contains(F.col("name"), F.lit(separator))).withColumn("p", F.explode(prefixes))
    return listed.join(variables.select(F.col("name").alias("variable")), F.col("p.variable") == F.col("variable"), "inner").select("variable", "p.attribute", *[c for c in attributes.columns if c != "name"])


def name_matches(pattern: str, name: Column, regex: bool = False) -> Column:
    """The list tool's patterns: shell globs, or regular expressions, over the whole name."""
    return name.rlike(f"^(?:{pattern if regex else re.sub(r'^\(\?s:(.*)\)\\[zZ]$', r'\1', fnmatch.translate(pattern))})$")


def group_children(names: DataFrame, path: str = "", name: str = "name", separator: str = "/") -> DataFrame:
    """(child, is_group): what lies directly below ``path`` in the tree of names."""
    prefix = path.strip(separator) + separator if path.strip(separator) else ""
    rest = F.substring(F.col(name), len(prefix) + 1, 1 << 30)
    below = names.where(F.col(name).startswith(prefix)).select(F.split(rest, re.escape(separator)).alias("parts"))
    return below.select(F.get("parts", 0).alias("child"), (F.size("parts") > 1).alias("is_group")).distinct()
