import brute
import numpy as np
import pyarrow as pa
from hypothesis import given
from hypothesis import strategies as st

from arrayframe.llm import repetition as R

KEYS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def test_base_equals_brute_force(docs, texts):
    rows = R.repetition(docs).collect()
    assert len(rows) == len(texts)
    for r in rows:
        want = brute.repetition(texts[r.doc_id])
        assert tuple(r[k] for k in KEYS) == want
        assert r.base_failed == (want[0] < 10 or 100 * want[4] > 20 * want[0]) and not (r.kept and r.base_failed)


@given(st.lists(st.lists(st.sampled_from(["a", "b", "c", "é", "\n"]), max_size=40).map(" ".join), min_size=1, max_size=6))
def test_longest_repeats(texts):
    got = R.measure(pa.array(texts))
    for i, t in enumerate(texts):
        assert got["longest_repeat"][i] == brute.longest_repeat(brute.WORD.findall(t))
        assert tuple(int(got[k][i]) for k in KEYS) == brute.repetition(t)


@given(st.lists(st.integers(0, 2), min_size=1, max_size=60))
def test_suffix_array(words):
    keys = np.array(words)
    rank = R.suffix_ranks(keys, np.full(len(keys), len(keys)))[-1]
    order = sorted(range(len(words)), key=lambda i: words[i:])
    assert [int(rank[i]) for i in order] == list(range(len(words)))


def test_edges(edge, empty):
    rows = R.repetition(edge).collect()
    assert len(rows) == edge.count()
    assert all(not r.kept and r.base_failed and r.n_words == 0 for r in rows if r.doc_id in (0, 1, 2))
    assert [r.kept for r in rows if r.doc_id == 11] == [False]  # one word over and over
    assert R.repetition(empty).count() == 0 and R.quality_rules(empty).count() == 0
    kept = R.quality_rules(edge)
    assert kept.schema == edge.schema and kept.count() == sum(r.kept for r in rows)


def test_the_methods_verdict():
    r = __import__("random").Random(1)
    words = [f"w{r.randrange(10**6)}" for _ in range(400)]
    clean, repeated = " ".join(words), " ".join([*words, *words[100:160]])
    got = R.measure(pa.array([clean, repeated]))
    assert list(got["longest_repeat"]) == [0, 60] and got["covered_words"][1] == 120
