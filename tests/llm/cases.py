"""Small inputs with every awkward case, and checks shared by the tests."""

import random

#: Columns that share names with what the operators use inside or give out.
EXTRA = ("key", "size", "hash", "pos", "line", "n_lines", "score", "predicted", "component_id", "fp", "range", "id", "kind", "block", "bucket", "start", "lo", "hi", "target")


def documents(spark, rows=None):
    """doc_id, text, lang, source, n_chars and the clashing columns."""
    if rows is None:
        r = random.Random(11)
        words = ["alpha", "beta", "gamma", "delta", "Été", "größe", "x1", "42", "it's", "don't", "日本", "—"]
        some = lambda n: " ".join(r.choice(words) for _ in range(n))
        rows = [(i, some(r.randint(1, 60)) + "\n" + some(r.randint(0, 20)), "en", f"s{i % 4}") for i in range(40)]
        rows += [(100, None, None, None), (101, "", "en", "s1"), (102, " \t\n ", "en", None), (103, some(30_000), "en", "s0"), (104, rows[3][1], "en", "s3")]
        rows += [(105, rows[5][1], "de", "s1"), (105, rows[5][1], "de", "s1"), (None, some(12), "en", "s2"), (106, "a" * 900, "en", "s2"), (107, "one", "fr", "s9")]
    full = [(*row, len(row[1]) if row[1] is not None else None, *[f"{c}!" for c in EXTRA]) for row in rows]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in EXTRA)
    return spark.createDataFrame(full, schema)


def rows_of(df):
    """The rows as sorted tuples, nulls first."""
    return sorted((tuple(r) for r in df.collect()), key=lambda r: tuple((v is not None, v) for v in r))


def components(n, links):
    up = list(range(n))

    def find(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in links:
        x, y = find(a), find(b)
        if x != y:
            up[max(x, y)] = min(x, y)
    return [find(i) for i in range(n)]


def similar_groups(texts, size=5, similarity=0.8):
    """{id: least id joined to it} by the exact similarity of all pairs of texts that share a shingle."""
    from collections import Counter, defaultdict

    ids, sets, held = sorted(texts), [], defaultdict(list)
    for n, i in enumerate(ids):
        words = (texts[i] or "").encode().lower().split()
        k = min(size, len(words)) or 1
        sets.append({b" ".join(words[p : p + k]) for p in range(len(words) - k + 1)} or {b""})
        for x in sets[n]:
            held[x].append(n)
    links = []
    for n, mine in enumerate(sets):
        shared = Counter(m for x in mine for m in held[x] if m < n)
        links += [(n, m) for m, c in shared.items() if c >= similarity * (len(mine) + len(sets[m]) - c)]
    return {i: ids[r] for i, r in zip(ids, components(len(ids), links))}
