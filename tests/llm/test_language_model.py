import math
import zlib
from collections import Counter

import brute
import numpy as np
import pyarrow as pa
import pytest

from arrayframe.llm import language_model as L
from arrayframe.llm import tokens


def toks(text):
    return [*brute.WORD.findall(brute.fold(text)), None]


def held(doc_id):
    return zlib.crc32(str(doc_id).encode() if doc_id is not None else b"") % 5 == 1


def check(rows, got):
    train = Counter(x for k, t in rows if not held(k) for x in toks(t))
    n, v = sum(train.values()), len(train)
    want = sorted((str(k), held(k), len(toks(t)), sum(train[x] > 0 for x in toks(t)), round(sum(math.log10((train[x] + 0.5) / (n + 0.5 * (v + 1))) for x in toks(t)), 5)) for k, t in rows)
    assert sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, round(r.base_score, 5)) for r in got) == want
    assert all(r.train_tokens == n for r in got)


def test_base_equals_brute_force(docs, texts):
    check(list(texts.items()), L.score_texts(docs).collect())


@pytest.mark.parametrize("share", [2e-6, 2e-3])
def test_edges_and_rare_words(edge, monkeypatch, share):
    monkeypatch.setattr(L, "WORD_SHARE", share)
    check([(r.doc_id, r.text) for r in edge.select("doc_id", "text").collect()], L.score_texts(edge).collect())


def test_empty(empty):
    assert L.score_texts(empty).count() == 0


def test_model_beats_the_base_on_held_out_texts(docs):
    rows = [r for r in L.score_texts(docs).collect() if r.held_out]
    assert sum(r.score for r in rows) > sum(r.base_score for r in rows)


def automaton(texts):
    column = pa.array(texts)
    (chunk,) = tokens.chunks(column)
    h, runs = L.token_runs(chunk)
    words, counts = np.unique(h, return_counts=True)
    pair, triple = L.ngram_keys(L.word_ids(words, h), runs, len(words))
    p, t = (np.unique(k[k >= 0], return_counts=True) for k in (pair, triple))
    keep2, keep3 = p[1] > 1, t[1] > 1
    return L.build(words, counts, p[0][keep2], p[1][keep2], t[0][keep3], t[1][keep3], len(h), len(words)), words


def test_probabilities_after_each_state_sum_to_one():
    texts = ["a b a b c a b c d", "a b c a b d", "c c c a b", "b a d"]
    model, words = automaton(texts)
    names = [w for w in "abcd"]
    for history in ("", "a", "b", "a b", "b c", "c a", "c c", "d", "d a", "a b c"):
        total = 0.0
        for w in [*names, None]:
            text = f"{history} {w or ''}".strip()
            chunk = next(tokens.chunks(pa.array([text or ""])))
            h, runs = L.token_runs(chunk)
            if w is not None:
                h, runs = h[:-1], np.array([0, len(h) - 1])
            long = model.score(h, runs)
            short = model.score(h[:-1], np.array([0, len(h) - 1])) if len(h) > 1 else {"score_part": [0.0], "n_root": [0]}
            log = long["score_part"][0] - short["score_part"][0] - (long["n_root"][0] - short["n_root"][0]) * model.root_log
            total += 10**log
        unknown = 10 ** (math.log10(0.5) - model.root_log)  # an unseen word at the root
        back = 1.0
        last = history.split()
        if last:
            one = L.word_ids(words, next(tokens.chunks(pa.array([last[-1]]))).hashes(True))[0]
            back = 10 ** model.word_back[one]
            if len(last) > 1:
                two = L.word_ids(words, next(tokens.chunks(pa.array([last[-2]]))).hashes(True))[0]
                state = L.word_ids(model.pairs, np.array([two * len(words) + one]))[0]
                back *= 10 ** model.pair_back[state] if state >= 0 else 1.0
        assert total + back * unknown == pytest.approx(1.0, abs=1e-9), history


def whole_scores(rows):
    """Scores of a backoff model with every pair and triple that training holds twice, by plain dictionaries."""
    runs = [(held(k), toks(t)) for k, t in rows]
    c = [Counter(tuple(x[i : i + n]) for out, x in runs if not out for i in range(len(x) - n + 1)) for n in (1, 2, 3)]
    n, v = sum(c[0].values()), len(c[0])
    kept = [{g: k for g, k in of.items() if k >= 2} for of in c[1:]]
    p1 = lambda w: (c[0][w,] + 0.5) / (n + 0.5 * (v + 1))
    p2 = {g: (k - 0.5) / c[0][g[:1]] for g, k in kept[0].items()}
    p3 = {g: (k - 0.5) / c[1][g[:2]] for g, k in kept[1].items()}
    sums = {}
    for arcs, lower in ((p2, lambda g: p1(g[1])), (p3, lambda g: p2[g[1:]])):
        for g, p in arcs.items():
            a, b = sums.get(g[:-1], (0.0, 0.0))
            sums[g[:-1]] = a + p, b + lower(g)
    back = {s: max(1 - a, 1e-12) / max(1 - b, 1e-12) for s, (a, b) in sums.items()}

    def p(x, i):
        tri, bi = tuple(x[i - 2 : i + 1]) if i > 1 else None, tuple(x[i - 1 : i + 1]) if i else None
        if tri in p3:
            return p3[tri]
        weight = back.get(tri[:2], 1.0) if tri else 1.0
        return weight * (p2[bi] if bi in p2 else (back.get(bi[:1], 1.0) if bi else 1.0) * p1(x[i]))

    return [sum(math.log10(p(x, i)) for i in range(len(x))) for _, x in runs]


@pytest.mark.parametrize("segment", [300, L.SEGMENT])
def test_scores_equal_a_whole_model(docs, texts, segment):
    rows = list(texts.items())
    got = {r.doc_id: r.score for r in L.score_texts(docs, segment).collect()}
    for (k, _), s in zip(rows, whole_scores(rows), strict=True):
        assert got[k] == pytest.approx(s, abs=1e-5), k


def test_ngrams_seen_twice_are_kept_in_a_long_corpus(spark):
    filler = spark.range(2400).selectExpr("id AS doc_id", "array_join(transform(sequence(1, 1000), i -> concat('f', i * (id + 7) % 9973)), ' ') AS text")
    ids = [k for k in range(10_000, 10_100) if not held(k)][:2] + [k for k in range(10_000, 10_100) if held(k)][:1]
    planted = spark.createDataFrame([(k, " ".join(f"planted{i}" for i in range(20))) for k in ids], "doc_id bigint, text string")
    scored = L.score_texts(filler.unionByName(planted)).where(f"doc_id = {ids[2]}").first()
    assert scored.score > scored.base_score + 20
