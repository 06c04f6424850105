"""Operator 1, licence scans: a trained paragraph classifier, confirmed by templates.

A paragraph is a run of adjacent lines that each hold a cue word; it is
classified as a whole, and where it has several lines each of them too, so that
wrapped notices are met entire and a line that names another licence is not
lost. A sparse multinomial logistic regression over runs of one to three words
that hold a cue word gives the family; it is trained here, in numpy on the driver, from
public wordings (whole, joined, and cut into lines) with random cuts and
surroundings, and from sentences that use their words otherwise. Cue words are
learned from them too: few words, rare outside licences, of which every licence
paragraph holds two and each line's worth of it one. After a first fit only the n-grams with the largest
weights stay. A temperature and two limits are fitted on a second such set:
below the first a paragraph is no licence; between them, and where no template
of the family resembles it, it is a licence of an unknown kind.

A template resembles a paragraph if the paragraph holds enough of the template's
ordered word pairs; a paragraph that is taken alone may also be a part of the
template. A paragraph reports every family that it, or a line of it, confirms.

The scan itself is SQL expressions alone, on whole texts and without a shuffle.
A line without a cue word has no feature, so skipping it is exact.

Null and empty texts have no licence. Rows are independent; repeated rows agree,
ties go to the first family in order. Other columns are ignored. An empty table
gives an empty table.
"""

from __future__ import annotations

import random
import re
from collections import Counter
from dataclasses import dataclass
from functools import cache

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .licence_texts import NEGATIVES, OTHERS, PLAIN, SPDX, TEMPLATES

OTHER, NONE = "other", "none"
SEED, VARIANTS, STEPS, RATE, DECAY = 5, 30, 200, 2.0, 2e-4
#: Share of a template's word pairs that a paragraph must hold; of a paragraph's own pairs, at least so many, that one template must hold.
SIMILAR, PART, PART_PAIRS = 0.6, 0.75, 4
#: Words of a wrapped line.
LINE = 10
#: N-grams that stay after the first fit.
VOCABULARY = 400
#: Share of the second set's negatives, and of its known notices, that calibration lets pass for a licence and for unknown.
FALSE, UNSURE = 0.002, 0.01


def words(text: str) -> list[str]:
    return re.findall(r"[a-z0-9]+", re.sub(r"[A-Z]", lambda m: m[0].lower(), text))


def paragraphs() -> dict[str, list[str]]:
    """The templates of each family, with its SPDX lines."""
    return {f: [*ts, *(f"SPDX-License-Identifier: {x}" for x in SPDX.get(f, ()))] for f, ts in TEMPLATES.items()}


@cache
def cues() -> tuple[str, ...]:
    """Words of which each licence paragraph holds two (or all it has), and each ``LINE`` words of it one.

    Picked greedily by how many still need them, and by how few sentences outside have them.
    """
    need: list[tuple[set[str], int]] = []
    for t in [*OTHERS, *(t for ts in paragraphs().values() for t in ts)]:
        w = [x if x not in PLAIN and not x.isdigit() else "" for x in words(t)]
        need.append((set(w) - {""}, 2))
        need += [(set(w[i : i + LINE]) - {""}, 1) for i in range(0, len(w) - LINE + 1, LINE // 2) if len(w) > LINE]
    outside = Counter(w for t in NEGATIVES for w in set(words(t)))
    picked: list[str] = []
    while True:
        score: Counter[str] = Counter()
        for held, n in need:
            if len(held.intersection(picked)) < n:
                score.update(held.difference(picked))
        if not score:
            return tuple(sorted(picked))
        picked.append(min(score, key=lambda w: (-score[w] / (1 + outside[w]), w)))


def cue_pattern() -> str:
    return rf"(?<![a-z0-9])(?:{'|'.join(cues())})(?![a-z0-9])"


def ngrams(line: list[str]) -> list[str]:
    """Runs of one to three words that hold a cue."""
    cue = set(cues())
    return [" ".join(line[i : i + n]) for n in (1, 2, 3) for i in range(len(line) - n + 1) if not cue.isdisjoint(line[i : i + n])]


@dataclass
class Classifier:
    families: list[str]
    vocabulary: list[str]
    weights: np.ndarray  # of each n-gram and family
    bias: np.ndarray
    temperature: float
    licence_limit: float
    family_limit: float

    def probabilities(self, lines: list[str]) -> np.ndarray:
        place = {g: i for i, g in enumerate(self.vocabulary)}
        raw = np.stack([self.bias + sum((self.weights[place[g]] for g in ngrams(words(x)) if g in place), np.zeros(len(self.families))) for x in lines])
        return _softmax(raw * self.temperature)


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def _varied(r: random.Random) -> list[tuple[str, str]]:
    """Each template with random cuts and surroundings, and negatives of like size."""
    filler = ["".join(r.choices("abcdefghijklmnoprstuvw", k=r.randint(1, 9))) for _ in range(300)]

    def around(text: str) -> str:
        some = lambda n: " ".join(r.choices(filler, k=r.randint(0, n)))
        w = text.split()
        if len(w) > 8 and r.random() < 0.4:
            w.pop(r.randrange(len(w)))
        return f"{some(4)} {' '.join(w)} {some(4)}"

    known = paragraphs()
    out = [(around(t), f) for f, ts in known.items() for t in ts for _ in range(VARIANTS)]
    for f, ts in known.items():  # whole notices, and their lines
        for _ in range(VARIANTS):
            out.append((" ".join([*r.sample(ts, min(len(ts), r.randint(1, 4))), *r.sample(OTHERS, r.randint(0, 1))]), f))
        for t in ts:
            w = t.split()
            for _ in range(VARIANTS // 3 if len(w) > 14 else 0):
                at = r.randrange(len(w) - 8)
                out.append((" ".join(w[at : at + r.randint(8, 14)]), f))
    out += [(around(t), OTHER) for t in OTHERS for _ in range(VARIANTS)]
    out += [(around(t), NONE) for t in NEGATIVES for _ in range(VARIANTS)]
    common = [*cues(), *PLAIN]
    out += [(" ".join(r.choices([*filler, *common], weights=[1] * len(filler) + [2] * len(common), k=r.randint(1, 25))), NONE) for _ in range(25 * VARIANTS)]
    return out


def _fitted(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    weights, bias = np.zeros((x.shape[1], y.shape[1])), np.zeros(y.shape[1])
    speed = np.zeros_like(weights)
    for _ in range(STEPS):
        off = (_softmax(x @ weights + bias) - y) / len(x)
        speed = 0.9 * speed - RATE * (x.T @ off + DECAY * weights)
        weights += speed
        bias -= RATE * off.sum(axis=0)
    return weights, bias


@cache
def trained() -> Classifier:
    learn, check = (_varied(random.Random(SEED + k)) for k in (0, 1))
    families = sorted({f for _, f in learn})
    bags = [ngrams(words(x)) for x, _ in learn]
    vocabulary = sorted({g for t in [*OTHERS, *NEGATIVES, *(t for ts in paragraphs().values() for t in ts)] for g in ngrams(words(t))})
    place = {g: i for i, g in enumerate(vocabulary)}
    x = np.zeros((len(learn), len(vocabulary)), dtype=np.float32)
    for i, bag in enumerate(bags):
        for g in bag:
            if g in place:
                x[i, place[g]] += 1
    y = np.zeros((len(learn), len(families)), dtype=np.float32)
    y[np.arange(len(learn)), [families.index(f) for _, f in learn]] = 1
    weights, _ = _fitted(x, y)
    stay = np.sort(np.argsort(-np.abs(weights).max(axis=1), kind="stable")[:VOCABULARY])
    weights, bias = _fitted(x[:, stay], y)
    model = Classifier(families, [vocabulary[i] for i in stay], np.round(weights, 4), np.round(bias, 4), 1.0, 0.5, 0.5)
    lines, want = [a for a, _ in check], np.array([families.index(b) for _, b in check])
    loss = lambda t: -np.log(np.maximum(_softmax(np.log(np.maximum(raw, 1e-300)) * t)[np.arange(len(want)), want], 1e-12)).mean()
    raw = model.probabilities(lines)
    model.temperature = float(min(np.geomspace(0.25, 4, 17), key=loss))
    p = model.probabilities(lines)
    none, other = families.index(NONE), families.index(OTHER)
    licence = 1 - p[:, none]
    model.licence_limit = float(np.clip(np.quantile(licence[want == none], 1 - FALSE), 0.5, 0.95))
    known = (want != none) & (want != other)
    share = np.delete(p, [none, other], axis=1).max(axis=1)
    model.family_limit = float(np.clip(np.quantile(share[known], UNSURE), 0.3, 0.8))
    return model


def _tokens(line: Column) -> Column:
    return F.filter(F.split(line, "[^a-z0-9]+"), lambda w: w != "")


def _runs(w: Column, n: int) -> Column:
    """Runs of ``n`` words."""
    return F.when(F.size(w) >= n, F.transform(F.sequence(F.lit(1), F.size(w) - (n - 1)), lambda i: F.concat_ws(" ", F.slice(w, i, n)))).otherwise(F.array().cast("array<string>"))


def _units(text: Column) -> Column:
    """(block, alone, w): the paragraphs' words, and those of their lines where there are several."""
    folded = F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    cue = cue_pattern()
    marked = F.array_join(F.transform(F.split(folded, "\n"), lambda x: F.when(x.rlike(cue), x).otherwise("")), "\n")
    blocks = F.split(F.btrim(marked, F.lit("\n")), "\n\n+")
    unit = lambda x, i, alone: F.struct(i.alias("block"), alone.alias("alone"), _tokens(x).alias("w"))

    def of(block: Column, i: Column) -> Column:
        lines = F.when(F.contains(block, F.lit("\n")), F.transform(F.split(block, "\n"), lambda x: unit(x, i, F.lit(False))))
        return F.concat(F.array(unit(block, i, F.lit(True))), F.coalesce(lines, F.array().cast("array<struct<block:int,alone:boolean,w:array<string>>>")))

    none = F.array().cast("array<struct<block:int,alone:boolean,w:array<string>>>")
    return F.when(folded.rlike(cue), F.flatten(F.transform(blocks, of))).otherwise(none)


def _scores(m: Classifier, w: Column, pairs: Column) -> Column:
    """The raw score of each family."""
    vocabulary = F.split(F.lit("\n".join(m.vocabulary)), "\n")
    found = F.filter(F.transform(F.concat(w, pairs, _runs(w, 3)), lambda g: F.array_position(vocabulary, g).cast("int")), lambda i: i > 0)
    rows = F.array(*(F.split(F.lit(",".join(map(str, row))), ",").cast("array<double>") for row in m.weights))
    start = F.array(*(F.lit(float(b)) for b in m.bias))
    return F.transform(F.aggregate(found, start, lambda acc, i: F.zip_with(acc, F.get(rows, i - 1), lambda a, b: a + b)), lambda z: z * m.temperature)


def _likeness(best: Column, pairs: Column, alone: Column, templates: dict[int, list[list[str]]]) -> Column:
    """How much a template of the family and the unit have of each other's ordered word pairs."""
    own = F.size(F.array_distinct(pairs))

    def of(template: list[str]) -> Column:
        both = F.size(F.array_intersect(pairs, F.array(*map(F.lit, template))))
        part = F.when(alone & (own >= PART_PAIRS) & (both >= PART * own), SIMILAR).otherwise(0.0)
        return F.greatest(both / len(template), part)

    out = F.lit(0.0)
    for i, held in templates.items():
        alike = [of(t) for t in held]
        out = F.when(best == i, F.greatest(*alike) if len(alike) > 1 else alike[0]).otherwise(out)
    return out


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, licence (null: none; 'unknown'), confidence, confirmed, licences (all families, in order) and n_paragraphs of each row."""
    m = trained()
    none, other = m.families.index(NONE), m.families.index(OTHER)
    known = [i for i in range(len(m.families)) if i not in (none, other)]
    templates = {i: [sorted({" ".join(p) for p in zip(w, w[1:], strict=False)}) for w in map(words, paragraphs()[m.families[i]])] for i in known}
    names = F.array(*map(F.lit, m.families))
    best = lambda q: F.array_max(F.array(*(F.struct(F.get(q, i).alias("p"), F.lit(-i).alias("i")) for i in known)))

    def then(step: DataFrame, run) -> DataFrame:
        """The units with the fields that ``run`` gives of each; a step a projection, so that nothing is computed twice."""
        return step.select("doc_id", F.transform("p", lambda x: F.struct(*run(x))).alias("p"))

    keep = lambda x, *fields: [x[f].alias(f) for f in fields]
    step = docs.select("doc_id", _units(F.col("text")).alias("p"))
    step = then(step, lambda x: [*keep(x, "block", "alone", "w"), _runs(x["w"], 2).alias("pairs")])
    step = then(step, lambda x: [*keep(x, "block", "alone", "pairs"), _scores(m, x["w"], x["pairs"]).alias("z")])
    step = then(step, lambda x: [*keep(x, "block", "alone", "pairs"), F.transform(x["z"], lambda v: F.exp(v - F.array_max(x["z"]))).alias("e")])
    step = then(step, lambda x: [*keep(x, "block", "alone", "pairs"), F.transform(x["e"], lambda v: v / F.aggregate(x["e"], F.lit(0.0), lambda a, b: a + b)).alias("q")])
    step = then(step, lambda x: [*keep(x, "block", "alone", "pairs"), (1 - F.get(x["q"], none)).alias("licence"), best(x["q"]).alias("best")])
    step = step.select("doc_id", F.filter("p", lambda x: x["licence"] >= m.licence_limit).alias("p"))
    step = then(step, lambda x: [*keep(x, "block", "licence", "best"), _likeness(-x["best"]["i"], x["pairs"], x["alone"], templates).alias("like")])

    def named(x: Column) -> list[Column]:
        sure = (x["best"]["p"] >= m.family_limit) & (x["like"] >= SIMILAR)
        return [sure.alias("confirmed"), F.when(sure, x["best"]["p"]).otherwise(x["licence"]).alias("confidence"), F.when(sure, F.get(names, -x["best"]["i"])).otherwise("unknown").alias("family"), x["block"].alias("block")]

    step = then(step, named)
    # a paragraph is of unknown kind only where neither it nor a line of it is confirmed
    sure = F.transform(F.filter("p", lambda x: x["confirmed"]), lambda x: x["block"])
    step = step.select("doc_id", "p", sure.alias("sure"))
    step = step.select("doc_id", F.filter("p", lambda x: x["confirmed"] | ~F.array_contains(F.col("sure"), x["block"])).alias("p"))
    top = F.array_max("p")  # confirmed ones first, then the more certain
    licences = F.array_sort(F.array_distinct(F.transform("p", lambda x: x["family"])))
    n = F.size(F.array_distinct(F.transform("p", lambda x: x["block"])))
    return step.select("doc_id", top["family"].alias("licence"), top["confidence"].alias("confidence"), F.coalesce(top["confirmed"], F.lit(False)).alias("confirmed"), licences.alias("licences"), n.alias("n_paragraphs"))
