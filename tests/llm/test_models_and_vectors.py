"""Classifiers by held-out accuracy, embeddings against all pairs, the pipeline stage by stage."""

import zlib

import numpy as np
import pandas as pd
import pytest
from cases import components, documents, similar_groups, rows_of

import corpus_pipeline
from wayreach.llm import common, embedding_dedup, mixing, quality, toxicity
from wayreach.llm.components import connected_components

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def labelled(spark):
    d = spark.read.parquet(f"{SF}/documents.parquet").toPandas()
    return d.merge(spark.read.parquet(f"{SF}/labels.parquet").toPandas(), on="doc_id")


def held_out(ids, mod, rest):
    return np.array([zlib.crc32(str(i).encode()) % mod == rest for i in ids])


def test_quality_on_held_out_rows(labelled):
    out = held_out(labelled.doc_id, 3, 1)
    model = quality.fit_machine(labelled.text[~out].tolist(), labelled.quality[~out].to_numpy())
    said = np.array([model.score(t) >= 0.5 for t in labelled.text[out]])
    truth = labelled.quality[out].to_numpy() == 1
    assert (said == truth).mean() > 0.95 and said[truth].mean() > 0.97


def test_machine_is_the_sum_over_pairs():
    rng = np.random.default_rng(3)
    m = quality.FactorMachine(0.3, rng.normal(size=quality.N_FEATURES), rng.normal(size=(quality.N_FEATURES, quality.RANK)))
    i, x = quality.features("One two three, two!\nfour 55")
    pairs = sum(m.factor[a] @ m.factor[b] * u * v for k, (a, u) in enumerate(zip(i, x)) for b, v in zip(i[:k], x[:k]))
    assert m.margin(i, x) == pytest.approx(0.3 + (m.weight[i] * x).sum() + pairs)


def test_word_hashes_do_not_depend_on_place_or_piece():
    raw = lambda s: np.frombuffer(s.encode(), np.uint8)
    a, b = quality.word_hashes(raw("  Alpha beta\tALPHA\n")), quality.word_hashes(raw("beta alpha"))
    assert a[0] == a[2] == b[1] and a[1] == b[0] and len(quality.word_hashes(raw(" \n"))) == 0


def test_quality_scores_every_row(spark):
    d = documents(spark)
    for model in (quality.fit_machine([], np.array([])), quality.fit_machine(["good words here", "!!! ###"], np.array([1, 0]))):
        got = quality.score_quality(d, model).collect()
        assert len(got) == d.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    assert quality.score_quality(d.limit(0), model).count() == 0
    labels = spark.createDataFrame([(1, 1), (2, None), (3, 0), (None, 1)], "doc_id long, quality int")
    texts, y, declared = quality.labelled_sample(d, labels, "quality", quality.is_held_out)
    assert len(texts) == len(y) == len(declared) <= 2 and declared == [len(t) for t in texts]
    with pytest.raises(ValueError):
        quality.score_quality(d, model, carry=["doc_id", "score"])


def test_a_fit_reads_a_bounded_part(spark, monkeypatch):
    d = documents(spark, [(i, "word " * 20, "en", "s") for i in range(60)] + [(3, "word " * 20, "en", "s")] * 30 + [(72, "x" * 900, "en", "s")])
    labels = spark.createDataFrame([(i, i % 2) for i in range(80)], "doc_id long, quality int")
    whole = quality.labelled_sample(d, labels, "quality", quality.is_held_out)[0]
    assert "x" * 900 in whole and len(whole) == len({i for i in [*range(60), 72] if zlib.crc32(str(i).encode()) % 3 != 1})
    monkeypatch.setattr(common, "FIT_CHARS", 500)
    monkeypatch.setattr(common, "FIT_TOTAL_CHARS", 1_050)
    assert quality.labelled_sample(d, labels, "quality", quality.is_held_out)[0] == ["word " * 20] * 10


def test_toxicity_on_held_out_rows(labelled):
    out = held_out(labelled.doc_id, 5, 0)
    model = toxicity.fit_toxicity(labelled.text[~out].tolist(), labelled.toxic[~out].to_numpy())
    automaton = model.automaton()
    score = np.array([model.score(t, automaton) for t in labelled.text[out]])
    truth = labelled.toxic[out].to_numpy() == 1
    assert ((score >= 0.5) == truth).mean() > 0.95 and (score[~truth] >= 0.5).mean() < 0.02


def test_grammar_weighs_the_clause():
    model = toxicity.ToxicModel({"idiot": ("I", 1.0, False), "kill": ("H", 1.0, False), "stem": ("I", 1.0, True)})
    a = model.automaton()
    e = lambda t: model.evidence(t, a)
    assert e("an idiot") == 1.0 and e("you idiot") == pytest.approx(1.2) and e("Idiot. you") == 1.0
    assert e("not an idiot") < e("said an idiot") < e("an idiot")
    assert e("kill you") > e("kill the light") and e("never kill you") < e("kill you")
    assert e("idiots") == 0 and e("stemming") == 1.0 and e("system") == 0 and e(None) == 0 and e("") == 0


def test_the_composed_machine_is_the_machines_in_turn():
    rng = np.random.default_rng(6)
    for _ in range(400):
        clause = rng.choice(list(toxicity.SYMBOLS), rng.integers(1, 14))
        states, state = [m.start for m in toxicity.MACHINES], toxicity.GRAMMAR.start
        for symbol in clause:
            state, out, weight = toxicity.GRAMMAR.step(state, symbol)
            through, product = symbol, 1.0
            for i, machine in enumerate(toxicity.MACHINES):
                states[i], through, w = machine.step(states[i], through)
                product *= w
            assert (out, weight) == (through, pytest.approx(product))


def test_toxicity_scores_every_row(spark):
    d = documents(spark)
    model = toxicity.fit_toxicity([], np.array([]))
    got = toxicity.score_toxicity(d, model).collect()
    assert len(got) == d.count() and all(0 <= r.score <= 1 for r in got)
    assert toxicity.score_toxicity(d.limit(0), model).count() == 0


def links_of(table, cut):
    out = []
    for label in table.label.dropna().unique():
        own = [
            i for i in np.flatnonzero(table.label.to_numpy() == label)
            if table.embedding[i] is not None and all(v is not None and np.isfinite(v) for v in table.embedding[i]) and any(v != 0 for v in table.embedding[i])
        ]
        if own:
            x = np.array([np.array(table.embedding[i], float) / np.abs(np.array(table.embedding[i], float)).max() for i in own])
            x /= np.linalg.norm(x, axis=1)[:, None]
            out += [(own[a], own[b]) for a, b in zip(*np.nonzero(np.triu(x @ x.T >= cut, 1)))]
    return out


@pytest.fixture(scope="module")
def vectors(spark):
    r = np.random.default_rng(0)
    rows = [(i, i % 3, [float(x) for x in r.normal(size=16)]) for i in range(200)]
    rows += [(1000 + i, i % 3, [float(x) for x in np.array(rows[i][2]) * 2 + r.normal(size=16) * 0.25]) for i in range(200)]
    rows += [(5000, None, [1.0] * 16), (5001, 1, None), (5002, 1, [0.0] * 16), (5003, 1, [float("nan")] * 16), (5004, 1, [None] + [1.0] * 15)]
    rows += [(5005, 2, [float("inf")] + [0.0] * 15), (5006, 0, [3.0] * 16), (5007, 0, [3.0] * 16), (5008, 0, [1e-200] * 16)]
    return spark.createDataFrame([(*x, "a", 1) for x in rows], "vec_id long, label int, embedding array<double>, n_links string, class int")


@pytest.mark.parametrize("tail", [embedding_dedup.TAIL, None])
def test_embedding_links_against_all_pairs(spark, vectors, tail, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "CLASSES_A_LIST", 20)
    monkeypatch.setattr(embedding_dedup, "BLOCK_CLASSES", (2, 7))
    monkeypatch.setattr(embedding_dedup, "PART_CLASSES", (3, 9))
    got = embedding_dedup.embedding_dedup(vectors, tail=tail).toPandas().sort_values("vec_id")
    table = vectors.toPandas().sort_values("vec_id").reset_index(drop=True)
    links = links_of(table, 0.93)
    n = np.bincount(np.array(links).ravel(), minlength=len(table))
    root = components(len(table), links)
    recall = got.n_links.sum() / n.sum()
    assert recall >= 0.9 and (got.n_links.to_numpy() <= n).all()
    if tail is None:
        assert recall == 1.0
        least = pd.Series(table.vec_id.to_numpy()).groupby(root).transform("min")
        assert (got.component_id.to_numpy() == least.to_numpy()).all()
    assert (got.kept == (got.vec_id == got.component_id)).all()


def pairs_at(cosine, dims, rank, n, seed=0):
    """n unit vectors in a subspace of ``rank`` and n others, each at the cosine from its own."""
    r = np.random.default_rng(seed)
    base = np.linalg.qr(r.normal(size=(dims, rank)))[0]
    a = r.normal(size=(n, rank))
    a /= np.linalg.norm(a, axis=1)[:, None]
    e = r.normal(size=a.shape)
    e -= (e * a).sum(axis=1)[:, None] * a
    e /= np.linalg.norm(e, axis=1)[:, None]
    return np.concatenate([a, cosine * a + np.sqrt(1 - cosine**2) * e]) @ base.T


@pytest.mark.parametrize("dims, rank", [(256, 8), (512, 16), (64, 4), (64, 64)])
def test_embedding_recall_whatever_the_rank(spark, dims, rank):
    x = pairs_at(0.932, dims, rank, 1500)
    v = spark.createDataFrame(pd.DataFrame({"vec_id": np.arange(len(x)), "label": 1, "embedding": list(x.tolist())}))
    expected = sum(int((x[lo : lo + 500] @ x.T >= 0.93).sum()) for lo in range(0, len(x), 500)) - len(x)
    assert len(x) <= expected and 0.95 * expected <= embedding_dedup.embedding_dedup(v).agg({"n_links": "sum"}).first()[0] <= expected


def test_rare_labels_are_searched_whole():
    x = np.concatenate([pairs_at(0.932, 32, 32, 400), pairs_at(0.932, 32, 2, 10, 1)])
    index = embedding_dedup.PqIndex(x, 6)
    label = np.repeat([0, 1], [800, 20])
    index.learn_reach(x, label, 0.37, embedding_dedup.TAIL)
    assert 0 < index.label_reach[0] < index.half and 1 not in index.label_reach
    assert (index.probed(x, np.ones(len(x), int))[1] >= index.probed(x, np.zeros(len(x), int))[1]).all()


def test_embedding_empty_and_odd_lengths(spark, vectors):
    assert embedding_dedup.embedding_dedup(vectors.limit(0)).count() == 0
    odd = spark.createDataFrame([(1, 1, [1.0, 2.0]), (2, 1, [1.0, 2.0, 3.0]), (3, 1, [2.0, 4.0]), (4, 1, []), (5, 1, [2.0, 4.0, 6.0])], "vec_id long, label int, embedding array<float>")
    assert rows_of(embedding_dedup.embedding_dedup(odd)) == [(1, 1, 1, True), (2, 1, 2, True), (3, 1, 1, False), (4, 0, 4, True), (5, 1, 2, False)]


def test_components_of_chains_stars_and_nothing(spark):
    links = [(i, i + 1) for i in range(60)] + [(100, 101 + i) for i in range(50)] + [(7, 7), (3, 2), (None, 4)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(links, "a long, b long"), "a", "b").collect()}
    assert {got[i] for i in range(61)} == {0} and {got[100 + i] for i in range(51)} == {100}
    assert connected_components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0


@pytest.fixture(scope="module")
def stages(spark):
    """What each stage gets and gives on the small tables."""
    docs, out = corpus_pipeline.documents(spark, SF), {}
    for name, stage in corpus_pipeline.STAGES:
        made = corpus_pipeline.written(stage(spark, docs, SF), name)
        out[name] = (docs, made)
        docs = made
    return out


def test_pipeline_keeps_the_columns(stages):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "lines", "near_duplicates", "mixing", "tokens"]
    for name in ("quality", "lines", "near_duplicates", "mixing"):
        assert stages[name][1].columns == corpus_pipeline.COLUMNS


def test_pipeline_rejects_bad_and_keeps_good(spark, stages):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    before, after = (d.join(labels, "doc_id").groupBy("quality").count().toPandas().set_index("quality")["count"] for d in stages["quality"])
    assert after.get(1) >= 0.98 * before[1] and after.get(0, 0) <= 0.1 * before[0]


def test_pipeline_drops_shared_lines(stages):
    from collections import defaultdict

    before, after = ({r.doc_id: r.text for r in d.collect()} for d in stages["lines"])
    held = defaultdict(set)
    fold = lambda x: "".join(c.lower() if "A" <= c <= "Z" else c for c in x.strip(" \t\n\x0b\x0c\r"))
    for i, t in before.items():
        for x in (t or "").split("\n"):
            held[fold(x)].add(i)
    keep = lambda i, x: not (len(fold(x)) >= 20 and len(held[fold(x)]) >= 3 and max(held[fold(x)]) != i)
    assert after == {i: "\n".join(x for x in (t or "").split("\n") if keep(i, x)) for i, t in before.items()}


def test_pipeline_keeps_one_of_each_group(stages):
    before, after = stages["near_duplicates"]
    expected = set(similar_groups({r.doc_id: r.text for r in before.collect()}).values())
    got = [r.doc_id for r in after.collect()]
    assert len(got) == len(set(got)) and set(got) == expected


def test_pipeline_mix_takes_the_planned_words(stages):
    from collections import Counter

    before, after = stages["mixing"]
    words = Counter()
    for r in after.collect():
        words[r.doc_id] += len(r.text.split())
        assert r.n_chars == len(r.text)
    assert words == {r.doc_id: r.taken for r in mixing.plan_mix(before).collect() if r.taken}


@pytest.mark.parametrize("k", [1, 2, 5])
def test_equal_rows_come_as_often_as_planned(spark, k):
    rows = [(1, "a b c d", "en", "s")] * k + [(2, "one two three", "en", "s"), (3, "x y", "de", "t"), (None, "u v w", "en", "t"), (None, "u v w", None, "t")]
    d = documents(spark, rows)
    made, plan = corpus_pipeline.mixing_stage(spark, d, SF).collect(), mixing.plan_mix(d, ("lang", "n_chars")).collect()
    words = lambda i: sum(len(r.text.split()) for r in made if r.doc_id == i)
    assert all(words(i) == sum(r.taken for r in plan if r.doc_id == i) for i in (1, 2, 3, None))
    assert abs(sum(r.taken for r in plan) - 1.5 * sum(len(t.split()) for _, t, _, _ in rows)) <= 1
    assert sum(r.doc_id == 1 for r in made) <= 2 * k


def test_pipeline_tokens_decode_to_the_texts(stages):
    import hashlib

    before, after = stages["tokens"]
    sha = lambda t: hashlib.sha256((t or "").encode()).hexdigest()
    assert sorted((r.doc_id, r.decoded_sha256) for r in after.collect()) == sorted((r.doc_id, sha(r.text)) for r in before.collect())
    assert all(len(r.ids) == r.n_tokens for r in after.limit(50).collect())


def test_stages_take_awkward_rows_and_empty_tables(spark):
    for d in (documents(spark), documents(spark).limit(0)):
        for name, stage in corpus_pipeline.STAGES:
            d = corpus_pipeline.written(stage(spark, d, SF), name)
        d.collect()
