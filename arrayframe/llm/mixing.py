"""Operator 2, mixing sources to target weights: iterative proportional fitting.

Token totals of the cells (source, language, topic) are raked to the three
target marginals in turn, with no cell above its own tokens, until all
marginals fit (after the first round by over-relaxed factors, whose rest is the
same); a cell's inclusion probability is its raked total over its
total. Targets that the cells' own tokens do not allow are met as far as raking
comes: it ends when a round changes nothing any more. If neither happens in
``ROUNDS`` rounds it is an error that names the residual. Documents are then
drawn by a hash of their id and text, so that a rerun draws the same ones.

A document's topic comes from its words. Words are hashed to ``BUCKETS`` terms.
In each language the correlation of any two terms' shares of a text is computed
over all texts that have words; its main components place the terms, and
spherical k-means of the places gives ``TOPICS`` groups of terms that rise and
fall together. A term that the components hardly explain has no topic. Each whole
text then counts its words' topics, and has the one that it has most above that
topic's mean share of the language's texts. The largest
``LANGUAGES`` languages have topics of their own, so that topics divide what
language does not; all other documents, also those without a language, share one
set of topics, learned from all of them.

DataFrame operations alone, of which the correlations are MLlib's, in the JVM: the
driver gets a matrix of ``BUCKETS`` x ``BUCKETS`` a language, and a topic a term goes
back as literals. Everything that is raked is the aggregated cell
table: up to ``CELLS`` cells are one partition, whose sums are windows without a
shuffle; of more, a marginal's sums are aggregated before they move, and joins
with them choose their way by measured size. The rows are written once with their
terms, so that texts are split and hashed once.

Null source, language or text are values like others (null text: no tokens,
topic 'empty'; a text without a word of any topic: 'none'). Rows that repeat are
drawn or left together; ties between topics go to the first. An empty table
gives an empty table. Other columns pass through ``sampled``, also those that
have a helper column's name.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.ml.feature import CountVectorizerModel, Normalizer
from pyspark.ml.stat import Correlation, Summarizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored, unused

#: Share of all tokens to draw; powers that temper the three marginals' own shares into targets.
BUDGET = 0.5
TEMPER = {"source": 0.5, "lang": 0.7, "topic": 0.9}
#: Rounds of raking at most, the marginals' error that fits, and the change of a round that counts as none.
ROUNDS, TOLERANCE, STILL = 60, 0.005, 1e-4
#: The power of a round's factors after the first: correlated marginals come together in half the rounds.
OVER = 1.6
#: Rounds between two looks at the residual; one partition's cells are raked through so many rounds in one plan.
AT_ONCE = 4
#: Cells that a partition of the cell table holds: one partition needs no shuffle.
CELLS = 100_000
#: Of topics: how many for a language, terms, languages with topics of their own, rounds of k-means.
TOPICS, BUCKETS, LANGUAGES, MEANS = 6, 256, 16, 12
#: A term has a topic if its place is so far along that topic's direction, as a part of the mean over terms.
CLEAR = 0.5


class RakingError(RuntimeError):
    """Raking that neither fits nor comes to rest."""


def _words(text: str) -> Column:
    inner = F.btrim(F.lower(F.coalesce(F.col(text), F.lit(""))), F.lit(" \t\n\x0b\x0c\r"))
    return F.when(inner == "", F.array().cast("array<string>")).otherwise(F.split(inner, "[ \\t-\\r]+"))


def _term(word: Column) -> Column:
    return F.pmod(F.xxhash64(word), F.lit(BUCKETS)).cast("int")


def centroids(x: np.ndarray) -> np.ndarray:
    """Spherical k-means of the rows, weighed by their length: ``TOPICS`` unit vectors, the same for the same rows."""
    size = np.linalg.norm(x, axis=1)
    unit = x / np.maximum(size, 1e-12)[:, None]
    picked = [int(np.argmax(size))]
    while len(picked) < TOPICS:  # each next one is the farthest from those before
        picked.append(int(np.argmax(size * (1 - (unit @ unit[picked].T).max(axis=1)))))
    now = unit[picked]
    for _ in range(MEANS):
        nearest = np.argmax(unit @ now.T, axis=1)
        sums = np.stack([x[nearest == k].sum(axis=0) for k in range(TOPICS)])
        length = np.linalg.norm(sums, axis=1, keepdims=True)
        now = np.where(length > 1e-12, sums / np.maximum(length, 1e-12), now)
    return now


def term_topics(correlation: np.ndarray, share: np.ndarray) -> tuple[list[int], list[float]]:
    """Of each term the topic, -1 for none, and each topic's mean share; ``share``: each term's mean share of a text.

    The topic with the largest share is the first. So numbered, topics of
    different languages have like shares, and the marginals of language and
    topic can be met together.
    """
    value, vector = np.linalg.eigh(correlation)
    place = vector[:, -TOPICS + 1 :] * np.sqrt(np.maximum(value[-TOPICS + 1 :], 0))
    along = place @ centroids(place).T
    best, far = along.argmax(axis=1), along.max(axis=1)
    best[(share <= 0) | (far <= CLEAR * far[share > 0].mean())] = -1
    shares = np.array([share[best == k].sum() for k in range(TOPICS)])
    order = np.argsort(-shares, kind="stable").tolist()
    return [order.index(k) if k >= 0 else -1 for k in best.tolist()], shares[order].tolist()


def counted(terms: str) -> CountVectorizerModel:
    """Counts of the terms in the column ``terms`` as vectors: a term's place is its number."""
    return CountVectorizerModel.from_vocabulary([str(k) for k in range(BUCKETS)], inputCol=terms, outputCol="counts")


Learned = dict[str | None, tuple[list[int], list[float]]]


def learned(docs: DataFrame, lang: str, terms: str) -> Learned:
    """The topics of terms and their shares for each language, learned from all rows of ``docs``; under None those of all rows of other languages."""
    worded = docs.where(F.size(F.col(terms)) > 0).select(F.col(lang).alias("lang"), F.col(terms).cast("array<string>").alias("terms"))
    shares = Normalizer(p=1.0, inputCol="counts", outputCol="shares").transform(counted("terms").transform(worded))
    shares = stored(shares.select("lang", "shares"), "mix-shares")
    sizes = shares.where("lang is not null").groupBy("lang").count().where(F.col("count") >= 2 * TOPICS)
    own = [r.lang for r in sizes.orderBy(F.desc("count"), "lang").limit(LANGUAGES).collect()]
    parts = {k: shares.where(F.col("lang") == k) for k in own}
    parts[None] = shares.where(~F.coalesce(F.col("lang").isin(own), F.lit(False))) if own else shares
    found: Learned = {}
    for k, rows in parts.items():
        if len(rows.limit(2).collect()) < 2:  # one row has no correlation
            found[k] = [-1] * BUCKETS, [0.0] * TOPICS
            continue
        mean = rows.select(Summarizer.mean(F.col("shares"))).first()[0]
        matrix = Correlation.corr(rows, "shares").first()[0].toArray()
        # a term that no text has, or all have alike, correlates with none; sums differ in the last digits by their order
        found[k] = term_topics(np.round(np.nan_to_num(matrix), 9), mean.toArray())
    return found


def _letter(k: int) -> str:
    return chr(ord("a") + k) if k >= 0 else ""


def _of_language(lang: Column, each: dict[str | None, Column]) -> Column:
    out = each[None]
    for k, x in each.items():
        out = F.when(lang == k, x).otherwise(out) if k is not None else out
    return out


def marks(terms: Column, lang: Column, topics: Learned) -> Column:
    """A letter for each word's term that has a topic."""
    table = _of_language(lang, {k: F.split(F.lit(",".join(map(_letter, t))), ",") for k, (t, _) in topics.items()})
    # the struct's fields are computed once a text, and not once a word
    both = F.transform(F.array(F.struct(terms.alias("terms"), table.alias("table"))), lambda x: F.transform(x["terms"], lambda t: F.get(x["table"], t.cast("int"))))
    return F.array_join(F.get(both, 0), "")


def topic(n_words: Column, marked: Column, lang: Column, topics: Learned) -> Column:
    """The topic that the words have most above its mean share, in standard deviations: '0', '1', ..., 'none', or 'empty'."""
    share = _of_language(lang, {k: F.array(*map(F.lit, x)) for k, (_, x) in topics.items()})
    votes = []
    for k in range(TOPICS):
        n = F.length(marked) - F.length(F.replace(marked, F.lit(_letter(k))))
        above = (n - n_words * share[k]) / F.sqrt(F.greatest(share[k], F.lit(1e-12)))
        votes.append(F.when(n > 0, F.struct(above.alias("above"), F.lit(-k).alias("k"))))
    most = F.array_max(F.array(*votes))
    return F.when(n_words == 0, "empty").when(most.isNull(), "none").otherwise((-most["k"]).cast("string"))


def _with_sums(cells: DataFrame, name: str, weight: Column, parts: int) -> DataFrame:
    """``cells`` with ``s`` and ``all``, the sums of ``weight`` and n over the cells of the same ``name``.

    One partition's cells take them from a window, which moves nothing; of
    several, sums are aggregated before they move and joined.
    """
    if parts == 1:
        same = Window.partitionBy(name)
        return cells.select("*", F.sum(weight).over(same).alias("s"), F.sum("n").over(same).alias("all"))
    sums = cells.groupBy(F.col(name).alias("__k")).agg(F.sum(weight).alias("s"), F.sum("n").alias("all"))
    return cells.join(sums, F.col(name).eqNullSafe(F.col("__k"))).drop("__k")


def rake(cells: DataFrame, targets: dict[str, DataFrame], budget: Column) -> DataFrame:
    """``cells`` (the targets' columns, n) with ``w``: raked tokens, at most n in each cell.

    A cell's raked tokens are n times the product of a factor for each marginal,
    or n where that is above it; factors grow until the marginals' sums fit.

    ``targets`` holds for each column a table (column, share).
    """
    names, keys = list(targets), [c for c in cells.columns if c != "n"]
    capped = lambda c: F.least(F.col("n").cast("double"), F.col(c))
    parts = max(1, -(-cells.count() // CELLS))
    now = cells.withColumn("w", F.col("n").cast("double"))
    for name in names:
        share = targets[name].select(F.col(name).alias("__k"), (budget * F.col("share")).alias(f"__t_{name}"))
        now = now.join(share, F.col(name).eqNullSafe(F.col("__k"))).drop("__k")
    now = stored(now, "mix-cells").coalesce(parts)
    aims = [f"__t_{name}" for name in names]
    residual = change = 0.0
    for number in range(ROUNDS):
        power = OVER if number else 1.0
        now, offs = now.select(*keys, "n", *aims, "w", F.col("w").alias("v")), []
        for name, aim in zip(names, aims, strict=True):
            summed = _with_sums(now, name, capped("w"), parts)
            # a marginal whose cells are drawn whole can not come closer: its factor stays
            whole = (F.col("s") >= F.col("all") * 0.999) & (F.col("s") <= F.col(aim))
            off = F.when(whole, 0.0).otherwise(F.abs(F.col("s") - F.col(aim)) / F.greatest(F.col(aim), F.lit(1.0)))
            factor = F.when(whole, 1.0).when(F.col("s") > 0, F.pow(F.col(aim) / F.col("s"), F.lit(power))).otherwise(0.0)
            # one projection a turn: each costs the driver an analysis of the whole plan
            now = summed.select(*keys, "n", *aims, (F.col("w") * factor).alias("w"), "v", *offs, off.alias(f"__off_{name}"))
            offs.append(f"__off_{name}")
            if parts > 1:  # a join with its own sums would double the plan
                now = stored(now, "mix-cells").coalesce(parts)
        if (number + 1) % AT_ONCE and number + 1 < ROUNDS:
            continue
        if parts == 1:
            now = stored(now, "mix-cells").coalesce(1)
        # of each marginal what it was off before its turn: the first one's is that of the round before
        off = F.greatest(*map(F.max, offs)) if len(offs) > 1 else F.max(offs[0])
        found = now.agg(off.alias("residual"), (F.sum(F.abs(capped("w") - capped("v"))) / F.greatest(F.sum(capped("v")), F.lit(1.0))).alias("change")).first()
        residual, change = found.residual or 0.0, found.change or 0.0
        if residual < TOLERANCE or change < STILL:
            return now.select(*keys, "n", capped("w").alias("w"))
    raise RakingError(f"after {ROUNDS} rounds a marginal is off by {residual:.3f} and a round still moves {change:.5f} of the tokens")


def tempered(cells: DataFrame, name: str, power: float) -> DataFrame:
    """(name, share): the marginal's own shares to ``power``, summing to one."""
    raw = cells.groupBy(name).agg(F.pow(F.sum("n"), F.lit(power)).alias("x"))
    total = raw.agg(F.sum("x")).scalar()
    return raw.select(name, F.when(total > 0, F.col("x") / total).otherwise(0.0).alias("share"))


MEASURES = ("tokens", "topic", "probability", "drawn")


def helpers(docs: DataFrame) -> dict[str, str]:
    """The names of the columns that ``mix`` adds: ``__mix_tokens`` and so on, or longer ones where the table has those."""
    return {k: unused(docs.columns, f"__mix_{k}") for k in (*MEASURES, "terms", "place", "source", "lang", "t")}


def mix(docs: DataFrame, targets: dict[str, DataFrame] | None = None, budget: float = BUDGET, columns: list[str] | None = None) -> DataFrame:
    """``columns`` of ``docs`` (default all) with ``__mix_tokens``, ``__mix_topic``, ``__mix_probability`` and ``__mix_drawn``.

    ``targets``: tables (source | lang | topic, share); by default the shares
    that the table has, tempered.
    """
    name, columns = helpers(docs), docs.columns if columns is None else columns
    place = (F.shiftrightunsigned(F.xxhash64(F.lit("mix"), "doc_id", "text"), 11) / F.lit(float(1 << 53))).alias(name["place"])
    hashed = F.transform(_words("text"), lambda w: _term(w).cast("short")).alias(name["terms"])
    split = stored(docs.select(*(F.col(f"`{c}`") for c in columns), F.col("lang").alias(name["lang"]), place, hashed), "mix-terms")
    topics, lang = learned(split, name["lang"], name["terms"]), F.col(name["lang"])
    marked = split.withColumn(name["tokens"], F.size(name["terms"]).cast("long")).withColumn(name["t"], marks(F.col(name["terms"]), lang, topics))
    of = topic(F.col(name["tokens"]), F.col(name["t"]), lang, topics).alias(name["topic"])
    weighed = marked.select(*(F.col(f"`{c}`") for c in columns), name["place"], name["tokens"], of)
    cells = stored(weighed.groupBy("source", "lang", F.col(name["topic"]).alias("topic")).agg(F.sum(name["tokens"]).alias("n")), "mix-totals")
    if targets is None:
        targets = {k: tempered(cells, k, p) for k, p in TEMPER.items()}
    total = cells.agg(F.sum("n")).first()[0] or 0
    raked = rake(cells, targets, F.lit(float(total) * budget))
    p = raked.select(*(F.col(c).alias(name[k]) for c, k in (("source", "source"), ("lang", "lang"), ("topic", "t"))), F.when(F.col("n") > 0, F.least(F.lit(1.0), F.col("w") / F.col("n"))).otherwise(0.0).alias(name["probability"]))
    joined = weighed.join(p, F.col("source").eqNullSafe(F.col(name["source"])) & F.col("lang").eqNullSafe(F.col(name["lang"])) & F.col(name["topic"]).eqNullSafe(F.col(name["t"])), "left")
    return joined.withColumn(name["drawn"], F.coalesce(F.col(name["place"]) < F.col(name["probability"]), F.lit(False))).drop(*(name[k] for k in ("source", "lang", "t", "place")))


def sampled(docs: DataFrame, targets: dict[str, DataFrame] | None = None, budget: float = BUDGET) -> DataFrame:
    """The drawn rows of ``docs``."""
    return mix(docs, targets, budget).where(F.col(helpers(docs)["drawn"])).select(*(F.col(f"`{c}`") for c in docs.columns))
