"""Operator 6, document fingerprints: a canonical exact digest.

A text is brought to one form (Unicode NFKC, full case folding, NFKC again, each
run of Unicode white space one blank, ends trimmed) and hashed to 128 bits by two
seeded xxhash64. Equal hashes only make a bucket: texts are grouped by hash and
by the canonical text itself, which the aggregation compares byte by byte, and a
second text in one bucket gets a suffix to its fingerprint, also where it turns
up as an edited text.

DataFrame and SQL functions alone. Copies are combined before they move. The
successor of a document (descending doc_id) comes from a window within ranges
of ids, each range also holding the first row of the range after it. An id that
fills several ranges (or null) is split among them by its texts' hashes.

Null text counts as empty. Rows that repeat a doc_id follow each other by their
text's hash; a null doc_id comes last. An empty table gives an empty table; a
table of one row has the row itself as its successor. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import partitions_for, stored

_LEAST = -(2**63)


def canonical(text: Column) -> Column:
    composed = lambda x: F.java_method(F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), x, F.lit(True))
    folded = F.java_method(F.lit("com.ibm.icu.lang.UCharacter"), F.lit("foldCase"), composed(text), F.lit(True))
    return F.trim(F.regexp_replace(composed(folded), r"(?U)\s+", " "))


def digest(canon: Column) -> list[Column]:
    return [F.xxhash64(F.lit(seed), canon) for seed in (1, 2)]


def _hex(high: Column, low: Column) -> Column:
    return F.lower(F.concat(F.lpad(F.hex(high), 16, "0"), F.lpad(F.hex(low), 16, "0")))


def _below(bounds: list[int], inclusive: bool) -> Column:
    """How many of ``bounds`` (ascending, 2**k - 1 of them) are below ``sid``, or equal to it: a binary search."""
    held = F.array(*map(F.lit, bounds))
    steps, size = [], (len(bounds) + 1) // 2
    while size:
        steps.append(size)
        size //= 2
    before = (lambda x: x <= F.col("sid")) if inclusive else (lambda x: x < F.col("sid"))
    return F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), lambda at, step: F.when(before(F.get(held, at + step - 1)), at + step).otherwise(at))


def _range(bounds: list[int]) -> Column:
    """The number of the range, which grows with (sid, the complement of tie)."""
    if not bounds:
        return F.lit(0)
    low = _below(bounds, False)
    share = F.bitwise_not("tie") / F.lit(2.0**64) + F.lit(0.5)  # from 0 to 1
    # an id that is several bounds at once has as many ranges
    return low + F.least(F.floor(share * (_below(bounds, True) - low)), F.greatest(_below(bounds, True) - low - 1, F.lit(0))).cast("int")


def successors(docs: DataFrame, ranges: int) -> DataFrame:
    """doc_id, text, high, low of each row with next_text, next_high and next_low of its successor."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).withColumn("sid", F.coalesce("doc_id", F.lit(_LEAST))).withColumn("tie", F.xxhash64("text"))
    count = 1 << max(0, (ranges - 1).bit_length())
    bounds = rows.agg(F.percentile_approx("sid", [i / count for i in range(1, count)] or [0.5], F.lit(10000))).first()[0] if count > 1 else []
    rows = rows.withColumn("range", _range(list(bounds or []) if bounds else []))
    # descending order: the first row of a range has its largest id and then the least hash
    top = F.max(F.struct(F.col("sid"), F.bitwise_not("tie").alias("over"))).alias("top")
    firsts = stored(rows.groupBy("range").agg(top).select("range", "top.sid", F.bitwise_not("top.over").alias("tie")), "range-firsts")
    order = Window.orderBy(F.desc("range"))  # a row for each range
    last = firsts.agg(F.min("range")).scalar()
    before = firsts.select("sid", "tie", F.coalesce(F.lag("range").over(order), last).alias("to"))
    marked = rows.join(F.broadcast(before), ["sid", "tie"], "left")
    canon = canonical(F.col("text"))
    high, low = digest(canon)
    marked = marked.select("doc_id", "text", "sid", "tie", high.alias("high"), low.alias("low"), F.explode(F.filter(F.array(F.struct("range", F.lit(False).alias("copy")), F.struct(F.col("to").alias("range"), F.lit(True).alias("copy"))), lambda x: x["range"].isNotNull())).alias("in"))
    along = Window.partitionBy("in.range").orderBy("in.copy", F.desc("sid"), "tie")
    named = marked.select("*", *(F.lead(c).over(along).alias(f"next_{c}") for c in ("text", "high", "low")))
    return named.where(~F.col("in.copy")).drop("in", "sid", "tie")


def groups(docs: DataFrame) -> DataFrame:
    """(high, low, check) of each different canonical text with ``group_id`` (the least doc_id) and ``group_size``.

    Written once: the texts move once, whatever is asked of the groups then.
    """
    canon = canonical(F.coalesce("text", F.lit("")))
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), canon.alias("canon"))
    keyed = keyed.select("doc_id", "canon", *(c.alias(n) for c, n in zip(digest(F.col("canon")), ("high", "low"), strict=True)))
    same = keyed.groupBy("high", "low", "canon").agg(F.min("doc_id").alias("group_id"), F.count("*").alias("group_size"))
    return stored(same.select("high", "low", _check("canon"), "group_id", "group_size"), "fingerprint-groups")


def _check(canon: str, name: str = "check") -> Column:
    return F.unhex(F.sha2(canon, 256)).alias(name)


def seconds(found: DataFrame) -> DataFrame:
    """(high, low, check, place) of the texts beyond the first of their bucket: none is expected."""
    several = stored(found.groupBy("high", "low").agg(F.count("*").alias("n")).where("n > 1").select("high", "low"), "fingerprint-buckets")
    place = F.row_number().over(Window.partitionBy("high", "low").orderBy("check")) - 1
    held = found.join(several, ["high", "low"], "left_semi").select("high", "low", "check", place.alias("place"))
    return stored(held.where("place > 0"), "fingerprint-seconds")


def fingerprint_edits(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, both fingerprints, near_edited, near_next, group_id and group_size of each row."""
    rows = successors(docs, 8 * partitions_for(docs.sparkSession))
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    rows = rows.withColumn("n_chars", n.cast("long")).withColumn("edited", F.concat(F.substring(F.col("text"), F.lit(1), n - half), F.substring(F.col("next_text"), F.lit(1), half)))
    rows = rows.withColumn("canon", canonical(F.col("text"))).withColumn("edited_canon", canonical(F.col("edited")))
    high, low = digest(F.col("edited_canon"))
    near_next = F.when((F.col("high") == F.col("next_high")) & (F.col("low") == F.col("next_low")), F.col("canon") == canonical(F.col("next_text"))).otherwise(F.lit(False))
    flat = rows.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "high", "low", _check("canon"),
        high.alias("edited_high"), low.alias("edited_low"), _check("edited_canon", "edited_check"),
        (F.col("canon") == F.col("edited_canon")).cast("double").alias("near_edited"),
        near_next.cast("double").alias("near_next"),
    )
    found = groups(docs)
    # a text that occurs once is a group by itself; both tables are written, so joins choose their way by measured size
    shared = stored(found.where("group_size > 1"), "fingerprint-copies")
    second = seconds(found)
    edited_second = second.select(*(F.col(c).alias(f"edited_{c}") for c in second.columns))
    key = ["high", "low", "check"]
    flat = flat.join(shared, key, "left").join(second, key, "left").join(edited_second, [f"edited_{c}" for c in key], "left")
    flat = flat.withColumn("group_id", F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("group_id"))).withColumn("group_size", F.coalesce("group_size", F.lit(1).cast("long")))
    own = _named(F.col("high"), F.col("low"), F.col("place"))
    edited = _named(F.col("edited_high"), F.col("edited_low"), F.col("edited_place"))
    return flat.select("doc_id", "n_chars", "edited_sha256", own.alias("fingerprint"), edited.alias("edited_fingerprint"), "near_edited", "near_next", "group_id", "group_size")


def _named(high: Column, low: Column, place: Column) -> Column:
    """The fingerprint: the digest, and the text's place in its bucket if it is not the first."""
    return F.concat(_hex(high, low), F.when(place > 0, F.concat(F.lit("-"), place)).otherwise(F.lit("")))
