"""Components by shingle similarity, held to all pairs."""

import random

import numpy as np
import pytest
from cases import documents, similar_groups

from wayreach.llm import near_duplicates
from wayreach.llm.near_duplicates import is_similar, join_nearest, similar_components


def edited(words, changes, r):
    words = list(words)
    for at in r.sample(range(len(words)), changes):
        words[at] = f"new{r.randrange(10**6)}"
    return " ".join(words)


@pytest.fixture(scope="module")
def texts():
    """Copies with up to so many edits that they are around 0.8, some behind a common passage."""
    r = random.Random(5)
    some = lambda n: [f"w{r.randrange(5000)}" for _ in range(n)]
    passage, out = some(60), []
    for n in (8, 40, 120, 400) * 10:
        base = some(n)
        out += [" ".join(base), *(edited(base, r.randint(0, max(1, n // 40)), r) for _ in range(3))]
    out += [" ".join(passage + some(50)) for _ in range(80)]
    base = some(90)
    out += [edited(base, 1, r) for _ in range(60)]
    return dict(enumerate(r.sample(out, len(out))))


@pytest.mark.parametrize("crowded", [4096, 10])
def test_components_against_all_pairs(spark, texts, crowded):
    d = documents(spark, [(i, t, "en", "s") for i, t in texts.items()])
    got = {r.doc_id: r.component_id for r in similar_components(d, crowded=crowded).collect()}
    assert got == similar_groups(texts)


def test_pairs_at_the_threshold_are_found(spark):
    r = random.Random(9)
    texts = {}
    for n in range(0, 1200, 2):
        base = [f"w{r.randrange(10**6)}" for _ in range(229)]
        texts[n], texts[n + 1] = " ".join(base), edited(base, 5, r)  # 225 shingles, up to 25 of them changed
    d = documents(spark, [(i, t, "en", "s") for i, t in texts.items()])
    expected = similar_groups(texts)
    got = {r.doc_id: r.component_id for r in similar_components(d).collect()}
    pairs = [i for i in expected if expected[i] != i]
    assert len(pairs) > 500 and all(got[i] in (i, expected[i]) for i in got)
    assert sum(got[i] == expected[i] for i in pairs) >= 0.99 * len(pairs)


def test_awkward_rows(spark):
    d = documents(spark)
    rows = {(r.doc_id, r.text) for r in d.collect()}
    got = [(r.doc_id, r.component_id) for r in similar_components(d).collect()]
    known = similar_groups({i: t for i, t in rows if i is not None})
    assert sorted(got, key=str) == sorted([(i, known.get(i)) for i in [r.doc_id for r in d.collect()]], key=str)
    assert known[100] == known[101] == known[102] == 100
    assert similar_components(d.limit(0)).count() == 0


@pytest.mark.parametrize("few", [0, 50])
def test_groups_just_below_and_above(monkeypatch, few):
    monkeypatch.setattr(near_duplicates, "FEW_PAIRS", few)
    r = random.Random(3)
    base, texts = [f"w{r.randrange(9999)}" for _ in range(200)], []
    for n in range(150):
        texts.append(edited(base, r.randint(2, 6), r))
    expected = similar_groups(dict(enumerate(texts)))
    made = [near_duplicates.sketch(t, 5) for t in texts]
    sets = [np.unique((near_duplicates.shingle_set(t, 5)[1] >> np.uint64(32)).astype("<u4")) for t in texts]
    monkeypatch.setattr(near_duplicates, "DISTANCE", 64)
    monkeypatch.setattr(near_duplicates, "STEPS", (16, 64))
    fp, label = np.array([f for _, f, _ in made], np.uint64), np.arange(150)
    for a, b in near_duplicates.exact_links(np.zeros(150, np.int64), fp, sets, 0.8):
        label = join_nearest(label, a, b)[0]
    assert dict(enumerate(label.tolist())) == expected and 1 < len(set(expected.values())) < 150


def test_a_forest_of_pairs():
    left, right = np.array([1, 0, 0, 3, 2]), np.array([2, 2, 1, 4, 1])
    label, at = join_nearest(np.arange(5), left, right)
    assert label.tolist() == [0, 0, 0, 3, 3] and len(at) == 3


def test_similarity_of_sets():
    a = np.arange(10, dtype=np.uint32)
    assert is_similar(a, a[:8], 0.8) and is_similar(a[:9], a[1:], 0.8) and not is_similar(a[:8], a[1:], 0.8)
    assert is_similar(a[:0], a[:0], 0.8) and not is_similar(a[:0], a, 0.8)
