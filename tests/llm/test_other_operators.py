"""Operators 1, 2, 4, 6 and 8."""

import hashlib
import random
import re
import unicodedata
import zlib

import brute
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from arrayframe.llm import fingerprints, language_id, licences, mixing, packing

TOKENIZER = Tokenizer.from_file(str(public_tokenizers.path("byte_bpe_50k.json")))


def no_python(frame):
    plan = frame._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas", "CartesianProduct")), plan


# 1

def test_licences_of_the_documents(docs, texts):
    wording = {"mit": "MIT License", "apache": "Apache License", "gpl": "GNU General Public", "cc-by-nc": "CC BY-NC", "proprietary": "All rights reserved"}
    frame = licences.scan(docs)
    no_python(frame)
    for r in frame.collect():
        assert set(r.licences) == {k for k, v in wording.items() if v in texts[r.doc_id]}


@pytest.mark.parametrize(("line", "licence"), [
    ("Licensed under the MIT License.", "mit"), ("This library is licensed under the GNU Lesser General Public License, version 2.1.", "lgpl"), ("Released under the Zed Free License.", "unknown"),
    ("Copyright law was debated in parliament.", None), ("She has a fishing license for the lake.", None), ("x\nLicensed under CC BY-SA 4.0.\ny", "cc-by-sa"), ("", None), (None, None),
])
def test_licence_lines(spark, line, licence):
    got = licences.scan(spark.createDataFrame([(1, line)], "doc_id bigint, text string")).first()
    assert got.licence == licence and got.confirmed == (licence not in (None, "unknown"))


def test_licence_sql_equals_the_model(spark):
    model, lines = licences.trained(), [t for ts in licences.TEMPLATES.values() for t in ts]
    p = model.probabilities(lines)
    known = [i for i, f in enumerate(model.families) if f not in (licences.OTHER, licences.NONE)]
    got = {r.doc_id: r for r in licences.scan(spark.createDataFrame(list(enumerate(lines)), "doc_id bigint, text string")).collect()}
    for i, row in enumerate(p):
        best = max(known, key=lambda k: row[k])
        assert got[i].licence == model.families[best] and got[i].confidence == pytest.approx(row[best], abs=1e-6)


@pytest.mark.parametrize(("text", "family"), [
    ("SPDX-License-Identifier: Apache-2.0", "apache"), ("// SPDX-License-Identifier: GPL-2.0-only", "gpl"), ("Published under the WTFPL.", "wtfpl"), ("Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.", "bsd"),
    ("This is free and unencumbered software released into the public domain.", "unlicense"), ("Boost Software License - Version 1.0 - August 17th, 2003", "boost"),
    ("Permission to use, copy, modify, and/or distribute this software for any\npurpose with or without fee is hereby granted, provided that the above\ncopyright notice and this permission notice appear in all copies.", "isc"),
    ("Permission is hereby granted, free of charge, to any person obtaining a\ncopy of this software and associated documentation files (the \"Software\"),\nto deal in the Software without restriction, including without limitation\nthe rights to use, copy, modify, merge, publish, distribute, sublicense,\nand/or sell copies of the Software", "mit"),
    ("Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following conditions are\nmet.", "bsd"),
    ("under the terms of the GNU Affero General Public License as published\nby the Free Software Foundation, either version 3 of the License", "agpl"),
])
def test_real_wordings(spark, text, family):
    around = f"The harbour was calm.\n{text}\nThe boats came back at noon."
    got = licences.scan(spark.createDataFrame([(1, text), (2, around)], "doc_id bigint, text string")).collect()
    assert all(r.licences == [family] and r.confirmed and r.n_paragraphs == 1 for r in got), got


def test_a_paragraph_reports_all_its_families(spark):
    text = "Released under the MIT License.\nLicensed under the Apache License, Version 2.0.\n\nThe software is provided \"as is\", without warranty of any kind, express or implied."
    got = licences.scan(spark.createDataFrame([(1, text)], "doc_id bigint, text string")).first()
    assert got.licences == ["apache", "mit", "unknown"] and got.n_paragraphs == 2 and got.confirmed


def test_every_licence_paragraph_holds_a_cue():
    for t in [*licences.OTHERS, *(t for ts in licences.paragraphs().values() for t in ts)]:
        assert set(licences.words(t)) & set(licences.cues())


def test_licence_edges(edge, empty):
    got = licences.scan(edge).collect()
    assert len(got) == edge.count() and licences.scan(empty).count() == 0
    for r in got:
        assert (r.licence is None) == (r.licences == []) == (r.n_paragraphs == 0)
        assert r.licences == (["mit"] if r.doc_id == 12 else [])


# 2

def test_mixing_meets_the_targets(docs):
    frame = mixing.mix(docs)
    no_python(frame)
    got = frame.select("source", "lang", "__mix_topic", "__mix_tokens", "__mix_probability").toPandas()
    total = got.__mix_tokens.sum()
    drawn = got.__mix_tokens * got.__mix_probability
    assert drawn.sum() == pytest.approx(0.5 * total, rel=0.02) and got.__mix_probability.between(0, 1).all()
    for name, power in mixing.TEMPER.items():
        name = "__mix_topic" if name == "topic" else name
        share = (got.groupby(name).__mix_tokens.sum() / total) ** power
        share /= share.sum()
        have = drawn.groupby(got[name]).sum() / drawn.sum()
        assert np.allclose(share, have, atol=0.03)


def test_mixing_to_given_targets(spark):
    rows = [(i, "w " * 10, "s0" if i % 3 else "s1", "en") for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string, lang string")
    targets = {"source": spark.createDataFrame([("s0", 0.5), ("s1", 0.5)], "source string, share double"), "lang": spark.createDataFrame([("en", 1.0)], "lang string, share double")}
    got = mixing.sampled(docs, targets, budget=0.4)
    n = {r.source: r["count"] for r in got.groupBy("source").count().collect()}
    assert abs(n["s0"] - 600) < 80 and abs(n["s1"] - 600) < 80
    assert sorted(r.doc_id for r in got.collect()) == sorted(r.doc_id for r in mixing.sampled(docs, targets, budget=0.4).collect())


def plain_raking(n, margins, targets, budget, rounds):
    """Cells' totals ``n`` times a factor for each marginal, at most n, by plain loops."""
    u = {k: float(x) for k, x in n.items()}
    for _ in range(rounds):
        for at, target in zip(margins, targets, strict=True):
            sums, whole = {}, {}
            for k in u:
                sums[k[at]] = sums.get(k[at], 0.0) + min(n[k], u[k])
                whole[k[at]] = whole.get(k[at], 0.0) + n[k]
            for k in u:
                s, aim = sums[k[at]], budget * target[k[at]]
                u[k] *= 1.0 if 0.999 * whole[k[at]] <= s <= aim else aim / s
    return {k: min(n[k], x) for k, x in u.items()}


def test_raking_equals_plain_raking(spark):
    r = random.Random(2)
    n = {(f"s{i}", f"l{j}", f"t{k}"): r.randint(50, 5000) for i in range(4) for j in range(3) for k in range(3)}
    cells = spark.createDataFrame([(*k, x) for k, x in n.items()], "source string, lang string, topic string, n bigint")
    targets = [{v: x / 10 for v, x in zip(sorted({k[at] for k in n}), shares, strict=True)} for at, shares in enumerate(([1, 2, 3, 4], [2, 3, 5], [5, 3, 2]))]
    frames = {c: spark.createDataFrame(list(t.items()), f"{c} string, share double") for c, t in zip(("source", "lang", "topic"), targets, strict=True)}
    budget = 0.3 * sum(n.values())
    got = {(x.source, x.lang, x.topic): x.w for x in mixing.rake(cells, frames, F.lit(budget)).collect()}
    want = plain_raking(n, range(3), targets, budget, 200)
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], rel=0.03) for k in want)
    assert all(x <= n[k] + 1e-6 for k, x in got.items())


def test_raking_of_one_partition_equals_that_of_many(spark, monkeypatch):
    r = random.Random(4)
    keys = [(s, lang, t) for s in ("a", "b", None, "c") for lang in ("x", None, "y") for t in ("0", "1")]
    cells = spark.createDataFrame([(*k, r.randint(10, 900)) for k in keys], "source string, lang string, topic string, n bigint")
    targets = {c: mixing.tempered(cells, c, p) for c, p in mixing.TEMPER.items()}
    of = lambda: {(x.source, x.lang, x.topic): x.w for x in mixing.rake(cells, targets, F.lit(4000.0)).collect()}
    one = of()
    monkeypatch.setattr(mixing, "CELLS", 7)
    many = of()
    assert one.keys() == many.keys() == set(keys) and all(one[k] == pytest.approx(many[k], rel=1e-9) for k in keys)


def test_raking_that_never_rests_is_an_error(spark, monkeypatch):
    monkeypatch.setattr(mixing, "ROUNDS", 1)
    cells = spark.createDataFrame([("a", "x", "t", 100), ("a", "y", "t", 900), ("b", "x", "t", 700), ("b", "y", "t", 50)], "source string, lang string, topic string, n bigint")
    targets = {"source": spark.createDataFrame([("a", 0.2), ("b", 0.8)], "source string, share double"), "lang": spark.createDataFrame([("x", 0.3), ("y", 0.7)], "lang string, share double")}
    with pytest.raises(mixing.RakingError, match="off by"):
        mixing.rake(cells, targets, F.lit(400.0))


def test_topics_follow_words_not_length(spark):
    r = random.Random(6)
    themes = [[f"{stem}{i}" for i in range(40)] for stem in ("ship", "grain", "stone", "law", "song", "star")]
    rows = [(i, " ".join(r.choices(themes[i % 6], k=(20, 400)[i % 2 if i % 12 < 6 else 1 - i % 2])), "s", "en") for i in range(240)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id bigint, text string, source string, lang string")).collect()
    of = {}
    for x in got:
        of.setdefault(x.doc_id % 6, []).append(x["__mix_topic"])
    most = {k: max(set(v), key=v.count) for k, v in of.items()}
    assert len(set(most.values())) == 6 and all(v.count(most[k]) >= 38 for k, v in of.items())


def test_topics_are_learned_from_all_documents(docs):
    """Plain counts over every text of a language, in another layout too; a sample of the texts gives other topics."""
    rows = docs.select("doc_id", "lang", F.transform(mixing._words("text"), mixing._term).alias("t")).collect()
    want = {}
    for lang in {r.lang for r in rows}:
        mine = [r for r in rows if r.lang == lang]
        share = np.array([np.bincount(r.t, minlength=mixing.BUCKETS) / max(1, len(r.t)) for r in mine if r.t])
        of, shares = mixing.term_topics(np.round(np.nan_to_num(np.corrcoef(share.T)), 9), share.mean(axis=0))
        for r in mine:
            n = np.bincount([of[t] for t in r.t if of[t] >= 0], minlength=mixing.TOPICS)
            above = [(x - len(r.t) * p) / max(p, 1e-12) ** 0.5 if x else -np.inf for x, p in zip(n, shares, strict=True)]
            want[r.doc_id] = "empty" if not r.t else str(int(np.argmax(above))) if n.any() else "none"
    for frame in (docs, docs.repartition(7)):
        assert {r.doc_id: r["__mix_topic"] for r in mixing.mix(frame).collect()} == want


def test_mixing_edges(edge, empty):
    got = mixing.mix(edge)
    assert got.count() == edge.count() and mixing.sampled(edge).columns == edge.columns
    assert mixing.mix(empty).count() == 0 and mixing.sampled(empty).columns == empty.columns
    for x in got.collect():
        words = brute.WORD.findall(x.text or "")
        assert x["__mix_tokens"] == len(words) and (x["__mix_topic"] == "empty") == (not words)
        assert not (x["__mix_drawn"] and x["__mix_probability"] == 0)
    twice = {}
    for x in got.collect():
        twice.setdefault((x.doc_id, x.text, x.source, x.lang), set()).add(x["__mix_drawn"])
    assert all(len(v) == 1 for v in twice.values())


# 4

def check_packing(rows, pieces, window=2048):
    want = sorted(tuple(TOKENIZER.encode(t or "", add_special_tokens=False).ids + [1]) for _, t in rows)
    assert sum(map(len, want)) == sum(p.length for p in pieces)
    sequences = {}
    for p in pieces:
        sequences.setdefault(p.sequence_id, []).append(p)
    assert sorted(sequences) == list(range(len(sequences)))
    for k, parts in sequences.items():
        at = 0
        for p in sorted(parts, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at == window or k == len(sequences) - 1 and at <= window


def test_packing(docs, texts):
    pieces = packing.pack(docs).collect()
    check_packing(texts.items(), pieces)
    by = {}
    for p in pieces:
        by.setdefault(p.doc_id, []).append(p)
    for k, t in texts.items():
        ids, at = TOKENIZER.encode(t, add_special_tokens=False).ids + [1], 0
        for p in sorted(by[k], key=lambda p: p.start):
            assert p.start == at and p.doc_tokens == len(ids) and p.ids_crc32 == zlib.crc32(np.array(ids[at : at + p.length], dtype="<u4").tobytes())
            at += p.length
        assert at == len(ids)


def test_packing_edges(edge, empty):
    check_packing([(r.doc_id, r.text) for r in edge.select("doc_id", "text").collect()], packing.pack(edge).collect())
    assert packing.pack(empty).count() == 0


@pytest.mark.parametrize("text", ["<|endoftext|> x", "Ω ÿ   \u0085 ɐ", "  a  \n\n b\t", "don't I'LL", "１２ ½", ""])
def test_encoder_equals_the_tokenizer(text):
    assert packing.encoder(None, None).ids(text) == TOKENIZER.encode(text, add_special_tokens=False).ids


def test_encoder_equals_the_tokenizer_on_random_texts():
    r = random.Random(11)
    alphabet = [*map(chr, range(32, 127)), *"\n\t\r", *map(chr, range(0xA1, 0x250)), *" '  0123"]
    enc = packing.encoder(None, None)
    for _ in range(4000):
        text = "".join(r.choices(alphabet, k=r.randint(0, 60)))
        assert enc.ids(text) == TOKENIZER.encode(text, add_special_tokens=False).ids, repr(text)


# 6

#: The characters of Unicode's White_Space property.
WHITE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def plain_canonical(text):
    folded = unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", text).casefold())
    return re.sub(f"[{WHITE}]+", " ", folded).strip(" ")


def classes(frame):
    """Which texts have one fingerprint, edited ones as well."""
    out = {}
    for r in frame.collect():
        out.setdefault(r.fingerprint, set()).add((r.doc_id, "own"))
        out.setdefault(r.edited_fingerprint, set()).add((r.doc_id, "edited"))
    return sorted(map(sorted, out.values()))


def plain_classes(texts):
    order, out = sorted(texts, reverse=True), {}
    for i, k in enumerate(order):
        t, after = texts[k], texts[order[(i + 1) % len(order)]]
        out.setdefault(plain_canonical(t), set()).add((k, "own"))
        out.setdefault(plain_canonical(t[: len(t) - len(t) // 2] + after[: len(t) // 2]), set()).add((k, "edited"))
    return sorted(map(sorted, out.values()))


def test_fingerprints_equal_an_independent_canonical_form(docs, texts):
    assert classes(fingerprints.fingerprint_edits(docs)) == plain_classes(texts)


@pytest.mark.parametrize("same_digest", [False, True])
def test_canonical_forms_of_hard_texts(spark, monkeypatch, same_digest):
    if same_digest:
        monkeypatch.setattr(fingerprints, "digest", lambda c: [F.lit(1).cast("long"), F.length(c).cast("long")])
    some = ["Straße", "STRASSE", "ΟΔΟΣ", "οδοσ", "οδος", "a\u0085b", "a b", "a\u2003 b", "ŉ", "ʼn", "İ", "i̇", "ﬀ", "FF", "Ⅷ", "viii", "x" * 9, "y" * 9, "", "\u3000"]
    texts = dict(enumerate(some))
    frame = fingerprints.fingerprint_edits(spark.createDataFrame(list(texts.items()), "doc_id bigint, text string"))
    if not same_digest:
        assert classes(frame) == plain_classes(texts)
    else:  # equal canonical texts have one fingerprint, others differ, whatever the digest
        rows = {r.doc_id: r for r in frame.collect()}
        for a in texts:
            for b in texts:
                assert (rows[a].fingerprint == rows[b].fingerprint) == (plain_canonical(texts[a]) == plain_canonical(texts[b]))


@pytest.mark.parametrize("hot", [None, 7])
def test_successors_of_an_id_that_fills_several_ranges(spark, hot):
    rows = [(hot, f"hot {i}") for i in range(300)] + [(i, f"text {i}") for i in range(100)] + [(i, f"late {i}") for i in range(1000, 1100)]
    got = fingerprints.successors(spark.createDataFrame(rows, "doc_id bigint, text string"), 16)
    after = {r.text: r.next_text for r in got.select("text", "next_text").collect()}
    assert len(after) == len(rows) and sorted(after.values()) == sorted(after)  # one ring
    at, seen = "late 1099", []
    for _ in rows:
        seen.append(at)
        at = after[at]
    ids = {}
    for k, t in rows:
        ids[t] = k
    order = [ids[t] if ids[t] is not None else -1 for t in seen]
    assert at == "late 1099" and len(set(seen)) == len(rows) and order == sorted(order, reverse=True)


def test_fingerprints(docs, texts):
    frame = fingerprints.fingerprint_edits(docs)
    no_python(frame)
    got = {r.doc_id: r for r in frame.collect()}
    order = sorted(texts, reverse=True)
    for i, k in enumerate(order):
        t, n = texts[k], len(texts[k])
        after = order[(i + 1) % len(order)]
        edited = t[: n - n // 2] + texts[after][: n // 2]
        assert got[k].n_chars == n and got[k].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert got[k].near_next == float(got[k].fingerprint == got[after].fingerprint)
        assert got[k].near_edited == float(got[k].fingerprint == got[k].edited_fingerprint)
        assert got[k].group_id == min(j for j in texts if got[j].fingerprint == got[k].fingerprint)


def test_canonical_form(spark):
    rows = [(1, "ﬁne  Å\n"), (2, "Fine Å"), (3, "fine a"), (4, " FINE\tÅ ")]
    got = {r.doc_id: r for r in fingerprints.fingerprint_edits(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got[1].fingerprint == got[2].fingerprint == got[4].fingerprint != got[3].fingerprint and got[4].group_id == 1 and got[4].group_size == 3


def test_colliding_texts_are_told_apart(spark, monkeypatch):
    monkeypatch.setattr(fingerprints, "digest", lambda c: [F.lit(1).cast("long"), F.length(c).cast("long")])
    rows = [(1, "aaa"), (2, "bbb"), (3, "aaa"), (4, "cccc")]
    got = {r.doc_id: r.fingerprint for r in fingerprints.fingerprint_edits(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got[1] == got[3] and len(set(got.values())) == 3


def test_fingerprint_edges(edge, empty):
    got = fingerprints.fingerprint_edits(edge).collect()
    assert len(got) == edge.count() and fingerprints.fingerprint_edits(empty).count() == 0
    assert len({r.fingerprint for r in got if r.doc_id in (0, 1, 2)}) == 1
    one = fingerprints.fingerprint_edits(edge.where("doc_id = 10")).collect()
    assert len(one) == 1 and one[0].near_next == 1.0


# 8

def test_language_id_on_held_out_documents(docs):
    lang = {r.doc_id: r.lang for r in docs.collect()}
    got = language_id.identify(docs).collect()
    held = [r for r in got if r.held_out]
    assert len(got) == len(lang) and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    assert np.mean([r.lang_pred == lang[r.doc_id] for r in held]) > 0.97 and all(0 <= r.score <= 1 for r in got)


def test_language_id_edges(edge, empty):
    got = language_id.identify(edge).collect()
    assert len(got) == edge.count()
    assert all(r.lang_pred == "und" and r.score == 0 for r in got if r.doc_id in (0, 1, 2, 6))
    assert language_id.identify(empty).count() == 0 and language_id.identified(empty).count() == 0
    assert language_id.identified(edge).schema == edge.schema


def test_all_labelled_texts_train_the_model(spark):
    """More texts a label than the sample of 500 had; each that is learned from counts, as does each of the fifth that calibrates."""
    r = random.Random(8)
    stems = {"de": "der und nicht Straße werden schön".split(), "en": "the and not street become lovely".split()}
    rows = [(i, " ".join(r.choices(stems[k], k=8)) + f" {r.randrange(10**6)}", k) for i in range(2600) for k in [("de", "en")[i % 2]]]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    model = language_id.train(docs.repartition(5))
    keys = {x.doc_id: x.key for x in docs.select("doc_id", F.xxhash64(F.lit(8), "doc_id", "text").alias("key")).collect()}
    labelled = sorted((keys[i], text, lang) for i, text, lang in rows if zlib.crc32(str(i).encode()) % 4 != 2)
    learn, check = [x for x in labelled if x[0] % 5], [x for x in labelled if x[0] % 5 == 0]
    bags = lambda part: list(language_id.bags_of(pa.array([x[1] for x in part])))
    scores, bias = language_id.fit_bags(bags(learn), np.array([model.languages.index(x[2]) for x in learn]), 2)
    assert np.array_equal(model.scores, scores.astype(np.float32)) and np.array_equal(model.bias, bias)
    p = model.probabilities(pa.array([x[1] for x in check]))
    right = p.max(axis=1)[p.argmax(axis=1) == [model.languages.index(x[2]) for x in check]]
    assert model.threshold == pytest.approx(np.clip(np.quantile(right, language_id.REJECTED), 0.5, 0.6))


def test_a_rare_language_survives_many_shards(spark, monkeypatch):
    monkeypatch.setattr(language_id, "SHARD", 150)
    r = random.Random(9)
    stems = {"de": "der und nicht Straße werden schön".split(), "en": "the and not street become lovely".split(), "fi": "ja ei katu tulla kaunis ylitse".split()}
    rows = [(i, " ".join(r.choices(stems[k], k=8)), k) for i in range(1500) for k in ["fi" if i % 50 == 0 else ("de", "en")[i % 2]]]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    got = language_id.identify(docs).collect()
    assert all(x.lang_pred == rows[x.doc_id][2] for x in got)
    model, other = language_id.train(docs), language_id.train(docs.repartition(7))
    assert np.array_equal(model.scores, other.scores) and model.threshold == other.threshold


def test_a_language_of_long_texts_is_learned(spark):
    r = random.Random(5)
    german, english = "der und nicht Straße werden schön über zwischen Häuser gegangen".split(), "the and not street become lovely above between houses walked".split()
    rows = [(i, " ".join(r.choices(german, k=5000)), "de") for i in range(40)] + [(i, " ".join(r.choices(english, k=30)), "en") for i in range(40, 80)]
    got = language_id.identify(spark.createDataFrame(rows, "doc_id bigint, text string, lang string")).collect()
    assert all(x.lang_pred == ("de" if x.doc_id < 40 else "en") for x in got)


def test_accepted_is_score_against_the_limit(docs):
    model = language_id.train(docs)
    rows = language_id.identify(docs, model).collect()
    assert all(r.accepted == (r.lang_pred != "und" and r.score >= model.threshold) for r in rows)
    assert language_id.identified(docs).count() == sum(r.accepted for r in rows)
    assert np.mean([r.accepted for r in rows if r.lang_pred != "und"]) > 0.97


def test_nothing_to_learn_from(spark):
    docs = spark.createDataFrame([(1, "some text", None)], "doc_id bigint, text string, lang string")
    assert language_id.identify(docs).first().lang_pred == "und"
