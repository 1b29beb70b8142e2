"""Operators on whole texts, held to plain re-derivations."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import xxhash
from cases import components, documents, rows_of

from wayreach.llm import byte_bpe, digest, line_dedup, mixing, simhash, suffix_dedup, token_files


@pytest.fixture(scope="module")
def docs(spark):
    return documents(spark).cache()


@pytest.fixture(scope="module")
def table(docs):
    return [(r.doc_id, r.text, r.source) for r in docs.collect()]


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


def sha(x):
    return hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


def suffix_reference(table, length):
    raw = [(t or "").encode() for _, t, _ in table]
    seen = Counter(x[i : i + length] for x in raw for i in range(len(x) - length + 1))
    out = []
    for (i, _, _), x in zip(table, raw):
        gone = np.zeros(len(x) + 1, np.int8)
        for p in range(len(x) - length + 1):
            if seen[x[p : p + length]] > 1:
                gone[p : p + length] = 1
        kept = bytes(v for v, g in zip(x, gone) if not g)
        out.append((i, len(x), int(gone.sum()), int((np.diff(np.concatenate([[0], gone])) == 1).sum()), sha(kept)))
    return out


def suffix_table(spark):
    rng = np.random.default_rng(4)
    word = lambda n: "".join(rng.choice(list("abcdefgh é"), n))
    passages = [word(int(n)) for n in rng.integers(150, 700, 8)]
    rows = []
    for i in range(70):
        text = word(int(rng.integers(0, 300)))
        for _ in range(int(rng.integers(0, 3))):
            p = passages[int(rng.integers(8))]
            text += p[int(rng.integers(60)) : len(p) - int(rng.integers(60))] + word(int(rng.integers(100)))
        rows.append((i, text, "en", "s"))
    rows += [(1000, "a" * 500, "en", "s"), (1001, "a" * 199, "en", "s"), (1002, "ab" * 300, "en", "s"), (1003, None, "en", "s"), (1004, "", None, None)]
    rows += [(1005, rows[3][1], "en", "s"), (1005, rows[3][1], "en", "s"), (None, rows[4][1], "en", "s"), (1006, word(900) * 2, "en", "s")]
    return documents(spark, rows)


@pytest.mark.parametrize("small", [False, True])
def test_suffix_dedup(spark, small, monkeypatch):
    if small:  # several pieces, indexes and blocks; every group salted
        for name, value in (("PIECE", 300), ("INDEX_BYTES", 2000), ("BLOCK_TEXTS", 10), ("CROWD", 3), ("SPLIT_CONTEXTS", 2)):
            monkeypatch.setattr(suffix_dedup, name, value)
    d = suffix_table(spark)
    expected = suffix_reference([(r.doc_id, r.text, None) for r in d.collect()], 200)
    assert rows_of(suffix_dedup.suffix_dedup(d)) == sorted(expected, key=lambda r: tuple((v is not None, v) for v in r))


def test_a_passage_in_a_crowd_of_documents(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "CROWD", 40)
    monkeypatch.setattr(suffix_dedup, "SPLIT_CONTEXTS", 30)
    rng = np.random.default_rng(8)
    word = lambda n: "".join(rng.choice(list("abcdefgh é"), n))
    licence = word(1200)
    rows = [(i, word(150) + licence + word(150), "en", "s") for i in range(120)] + [(500 + i, word(400), "en", "s") for i in range(20)]
    d = documents(spark, rows + [(900, licence * 3, "en", "s")])
    indexed = []
    real = suffix_dedup.repeated_windows
    monkeypatch.setattr(suffix_dedup, "repeated_windows", lambda r, *a: (indexed.append(r), real(r, *a))[1])
    expected = suffix_reference([(r.doc_id, r.text, None) for r in d.collect()], 200)
    assert rows_of(suffix_dedup.suffix_dedup(d)) == sorted(expected)
    # An inner context is one row, whatever the number of its places.
    for rows in indexed:
        table = rows.select("grp", "context", "n").toPandas()
        assert not table.duplicated(["grp", "context"]).any() and table.grp.value_counts().max() <= 40
    assert len(indexed) == 2 and table.n.max() >= 1 and indexed[0].agg({"n": "max"}).first()[0] >= 121


def test_a_place_of_a_crowded_context_stays_one_row(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "CROWD", 20)
    monkeypatch.setattr(suffix_dedup, "SPLIT_CONTEXTS", 10)
    rng = np.random.default_rng(3)
    base = rng.choice(list("abcdefgh é"), 900)
    rows = []
    for i in range(80):  # near copies, and now and then one twice in a text
        text = base.copy()
        text[rng.integers(0, 900, 2)] = rng.choice(list("XYZUVW"), 2)
        rows.append((i, "".join(text) * (1 + (i % 20 == 0)), "en", "s"))
    d = documents(spark, rows)
    moved = []
    real = suffix_dedup._moved
    monkeypatch.setattr(suffix_dedup, "_moved", lambda r: (moved.append((r, real(r))), moved[-1][1])[1])
    expected = suffix_reference([(r.doc_id, r.text, None) for r in d.collect()], 200)
    assert rows_of(suffix_dedup.suffix_dedup(d)) == sorted(expected)
    (given, made), = moved
    # Stretches and single windows decide pieces of a context; its places are not multiplied by them.
    assert 0 < made.count() == given.select("name", "key").distinct().count()


def test_suffix_dedup_keeps_text_and_spans(spark):
    d = documents(spark, [(1, "x" + "q" * 250, "en", "s"), (2, "short", "en", "s")])
    got = {r.doc_id: (bytes(r.kept), list(r.spans)) for r in suffix_dedup.suffix_dedup(d, with_text=True).collect()}
    assert got == {1: (b"x", [1, 251]), 2: (b"short", [])}


def test_bounded_intervals_find_long_common_prefixes():
    rng = np.random.default_rng(0)
    for length in (8, 20, 50):
        s = rng.integers(1, 4, 400).astype(np.uint16)
        s[250:320] = s[20:90]
        found = suffix_dedup.BoundedIntervals(s, length)
        ring = np.concatenate([s, s])
        for i in range(1, len(s)):
            a, b = found.order[i - 1], found.order[i]
            assert found.border[i] == (ring[a : a + length].tolist() != ring[b : b + length].tolist())


def test_line_dedup(docs, table):
    strip = " \t\n\x0b\x0c\r"
    keys = lambda t: [re.sub("[A-Z]", lambda m: m[0].lower(), x.strip(strip)) for x in (t or "").split("\n")]
    held = defaultdict(set)
    for i, t, _ in table:
        for k in keys(t):
            if len(k) >= 3 and i is not None:
                held[k].add(i)
    expected = []
    for i, t, _ in table:
        lines = (t or "").split("\n")
        kept = [x for x, k in zip(lines, keys(t)) if not (len(k) >= 3 and len(held[k]) >= 2 and max(held[k]) != i)]
        expected.append((i, len(lines), len(lines) - len(kept), sha("\n".join(kept))))
    out = line_dedup.line_dedup(docs, min_chars=3, min_docs=2)
    got = [(r.doc_id, r.n_lines, r.n_dropped, sha(r.kept_text)) for r in out.collect()]
    order = lambda r: tuple((v is not None, v) for v in r)
    assert sorted(got, key=order) == sorted(expected, key=order)
    assert {"hash", "key", "source"} <= set(out.columns)


def test_mixing_meets_targets(docs, table):
    plan = mixing.plan_mix(docs).collect()
    assert len(plan) == len(table)
    size = lambda t: len(re.findall("[^\x20\x09-\x0d]+", t or ""))
    total = defaultdict(int)
    for _, t, s in table:
        total[s] += size(t)
    names = sorted(s for s in total if s is not None) + [None] * (None in total)
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    target, free, left = {}, set(names), 1.5 * sum(total.values())
    while True:
        level = left / sum(weight[s] for s in free)
        over = {s for s in free if weight[s] * level > 2 * total[s]}
        if not over:
            break
        for s in over:
            target[s] = 2.0 * total[s]
            left -= target[s]
        free -= over
    target |= {s: weight[s] * level for s in free}
    source = {(i, size(t)): s for i, t, s in table}
    taken = defaultdict(int)
    for r in plan:
        s = source[r.doc_id, r.size]
        assert 0 <= r.taken <= 2 * r.size and r.taken == r.taken_first + r.taken_again
        assert r.source_size == total[s] and r.target == pytest.approx(target[s])
        assert (r.position is None) == (r.taken == 0) and (r.position is None or -1e-9 <= r.position < 1)
        taken[s] += r.taken
    for s in names:
        assert abs(taken[s] - target[s]) <= 1
    again = mixing.plan_mix(docs.repartition(5)).collect()
    assert sorted(map(str, plan)) == sorted(map(str, again))


def test_equal_rows_and_null_ids_are_mixed_apart(spark):
    rows = [(1, "a b c", "en", "s")] * 3 + [(None, f"w{i} x", "en", "s") for i in range(30)] + [(2, "", "en", "s")]
    plan = mixing.plan_mix(documents(spark, rows)).collect()
    assert len(plan) == len(rows) and sum(r.taken for r in plan) == round(1.5 * (9 + 60))
    starts = [p for r in plan for p in (r.position, r.position_again) if p is not None]
    assert len(starts) == len(set(starts))


def test_simhash_against_all_pairs(docs, table):
    got = rows_of(simhash.simhash_components(docs))

    def reference(text):
        words = (text or "").encode().lower().split()
        shingles = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
        h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
        return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))

    fps = [reference(t) for _, t, _ in table]
    links = [(a, b) for a in range(len(fps)) for b in range(a) if bin(fps[a] ^ fps[b]).count("1") <= 4]
    root = components(len(fps), links)
    least = {}
    for (i, _, _), r in zip(table, root):
        if i is not None:
            least[r] = min(least.get(r, i), i)
    expected = [(i, format(f, "016x"), least.get(r)) for (i, _, _), f, r in zip(table, fps, root)]
    assert got == sorted(expected, key=lambda r: tuple((v is not None, v) for v in r))


def test_gray_index_finds_every_near_pair(spark, monkeypatch):
    rng = np.random.default_rng(2)
    base = rng.integers(0, 1 << 63, 60, dtype=np.uint64)
    fps = set(base.tolist())
    for x in base.tolist():
        for _ in range(12):
            fps.add(int(x) ^ sum(1 << int(b) for b in rng.choice(64, rng.integers(1, 6), replace=False)))
    fps = sorted(fps)
    links = [(a, b) for a in range(len(fps)) for b in range(a) if bin(fps[a] ^ fps[b]).count("1") <= 4]
    expected = components(len(fps), links)
    df = spark.createDataFrame([(simhash._signed(x),) for x in fps], "fp long")
    place = {simhash._signed(x): i for i, x in enumerate(fps)}
    for crowded in (4096, 3):  # one segment a deal; two and three where it is crowded
        got = [(place[r.a], place[r.b]) for r in simhash.fingerprint_links(df, crowded=crowded).collect()]
        assert components(len(fps), got) == expected
    monkeypatch.setattr(simhash, "HELD_PAIRS", 50)
    index = simhash.GrayIndex(np.sort(simhash.gray_rank(np.array(fps, np.uint64))), np.array([0]))
    pairs = [(len(q), n) for n, (q, _) in enumerate(simhash._pairs(index.fp, np.zeros(len(fps), np.int64), index, 64))]
    assert sum(n for n, _ in pairs) == len(fps) * (len(fps) - 1) // 2 and len(pairs) == len(fps)


def test_finer_segments_share_out_the_bits_left():
    for level in (1, 2):
        kinds = simhash.finer_segments(4, level)
        assert len(kinds) == 5**level
        for held, masks in kinds.values():
            assert sum(masks) == ((1 << 64) - 1) ^ held and all(m & held == 0 for m in masks)


def ids_near_the_ends(spark):
    top = (1 << 63) - 1
    rows = [(top - i, f"word {i} " * (i % 7), "en", "s") for i in range(40)] + [(i - top - 1, f"low {i} " * (i % 5), "en", "s") for i in range(40)]
    return documents(spark, rows + [(None, f"none {i}", "en", "s") for i in range(30)])


@pytest.mark.parametrize("kind", ["awkward", "ends", "one"])
def test_digest(spark, docs, kind):
    docs = {"awkward": docs, "ends": ids_near_the_ends(spark), "one": documents(spark, [(1, "one alone", "en", "s")])}[kind]
    table = [(r.doc_id, r.text, r.source) for r in docs.collect()]
    tie = lambda t: -int(hashlib.md5((t or "").encode()).hexdigest(), 16)
    rows = sorted(table, key=lambda r: (r[0] is None, -(r[0] or 0), tie(r[1])))
    out = []
    for k, (i, t, _) in enumerate(rows):
        t, nxt = t or "", rows[(k + 1) % len(rows)][1] or ""
        cut = len(t) // 3
        edited = t[: len(t) - cut] + nxt[:cut] if cut else t
        name = lambda x: digest.digest(digest.canonical(x))
        out.append((i, len(t), sha(edited), name(t), name(edited), float(name(t) == name(edited)), float(name(t) == name(nxt))))
    assert rows_of(digest.fingerprints(docs)) == sorted(out, key=lambda r: tuple((v is not None, v) for v in r))


def test_equal_digests_of_different_texts_are_told_apart(spark, monkeypatch):
    monkeypatch.setattr(digest, "digest", lambda canon: "same")
    d = documents(spark, [(3, "b", "en", "s"), (2, "A", "en", "s"), (1, "a", "en", "s")])
    got = {r.doc_id: r for r in digest.fingerprints(d).collect()}
    assert got[1].fingerprint == got[2].fingerprint != got[3].fingerprint
    assert (got[2].near_next, got[3].near_next) == (1.0, 0.0)


def test_canonical_folds_form_case_and_space():
    assert digest.canonical("ＡＢ  Straße\n") == digest.canonical("ab strasse")
    assert digest.canonical("é") == digest.canonical("É") != digest.canonical("e")


def test_token_files_round_trip(spark, docs, table):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    rows = sorted(table, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    start, expected = 0, []
    for i, t, _ in rows:
        ids = np.array([*library.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        expected.append((i, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert rows_of(token_files.token_files(docs, path)) == sorted(expected, key=lambda r: tuple((v is not None, v) for v in r))


def test_files_hold_the_shards_and_nothing_else(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(token_files, "SHARD_IDS", 8)
    d = documents(spark, [(i, f"one two {i} \n" * (i % 4), "en", "s") for i in range(30)] + [(None, "none", "en", "s")]).repartition(3)
    path = str(tmp_path / "tokens")
    token_files.write_tokens(d, public_tokenizers.path("word_bpe_49k.json"), path)
    shards = [s for f in (tmp_path / "tokens").glob("part-*") for s in token_files.shards_of(f.read_bytes())]
    shards.sort(key=lambda s: (s.part, s.seq))
    assert [None if null else int(x) for s in shards for x, null in zip(s.doc_ids, s.null_ids)] == [None, *range(30)]
    assert len(shards) > 8 and all((s.ids()[np.cumsum(s.lengths.astype(int)) - 1] == 1).all() for s in shards)
    with pytest.raises(ValueError):
        token_files.Shard(b"WPFR" + b"\xff" * 60)


def test_other_steps_go_to_the_library():
    import json

    from tokenizers import Tokenizer

    config = json.load(open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8"))
    config["normalizer"]["normalizers"][1]["content"] = "x"
    encoder = token_files.WordEncoder(json.dumps(config))
    assert encoder.encode("a b  c").tolist() == Tokenizer.from_str(json.dumps(config)).encode("a b  c", add_special_tokens=False).ids
    assert not encoder.known


def test_blocks_hold_any_values():
    rng = np.random.default_rng(1)
    for n in (0, 1, 5, 1023, 1024, 1025, 5000):
        v = rng.integers(0, 49408, n).astype(np.uint32)
        v[rng.random(n) < 0.7] %= 100
        if n:
            v[0] = 2**32 - 1
        shard = token_files.Shard(token_files.pack_shard(v, np.array([3]), np.array([False]), np.array([n])))
        assert (shard.ids() == v).all()
        if n > 5:
            assert (shard.ids(3, n - 2) == v[3 : n - 2]).all()


@pytest.mark.parametrize("text", ["Hello World's THE’s 12", "İstanbul ΣΑΣ", "a<|endoftext|>b", "x y\x85z\x1cq", "naïve ŉ ǰ", "ﬁ … ñ", "", "'tis ''s don't", "日本語 한국"])
def test_word_encoder_is_the_library(text):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    encoder = token_files.WordEncoder(open(path, encoding="utf-8").read())
    assert encoder.encode(text).tolist() == Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids


def tiktoken_encoding():
    import tiktoken

    ranks = byte_bpe._ranks(open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb").read())
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.mark.parametrize("chars", [6 << 20, 200])
def test_byte_bpe_round_trip(docs, table, chars, monkeypatch):
    monkeypatch.setattr(byte_bpe, "BLOCK_CHARS", chars)
    encoding = tiktoken_encoding()
    out = byte_bpe.byte_bpe(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    expected = []
    for i, t, _ in table:
        ids = encoding.encode_ordinary(t or "")
        expected.append((i, len(ids), sha(" ".join(map(str, ids))), sha(t or "")))
    assert rows_of(out) == sorted(expected, key=lambda r: tuple((v is not None, v) for v in r))


@pytest.mark.parametrize("text", ["it's  we'll 'tis ''s .'s\n\n  x\n y \t z  ", "  lead", "trail  ", "12ab3²½ ", "x\x1cy\x85z", "é ​ q", "a b　c"])
def test_pre_tokens_encode_like_the_text(text, monkeypatch):
    import regex

    monkeypatch.setattr(byte_bpe, "PIECE", 4)
    encoding = tiktoken_encoding()
    words = [w for p in byte_bpe.pre_tokens(text * 3, regex.compile(public_tokenizers.PATTERN)) for w in p]
    assert [i for w in words for i in encoding.encode_ordinary(w)] == encoding.encode_ordinary(text * 3)


def test_empty_tables(empty):
    ranks, words = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.path("word_bpe_49k.json")
    assert suffix_dedup.suffix_dedup(empty).count() == 0
    assert line_dedup.line_dedup(empty).count() == 0
    assert mixing.plan_mix(empty).count() == 0
    assert simhash.simhash_components(empty).count() == 0
    assert digest.fingerprints(empty).count() == 0
    assert token_files.token_files(empty, words).count() == 0
    assert byte_bpe.byte_bpe(empty, ranks, public_tokenizers.PATTERN).count() == 0
