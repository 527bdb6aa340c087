"""The pipeline's near-copy rule against brute-force Jaccard."""

import random
from itertools import combinations

import corpus_pipeline


def slow_shingles(text):
    w = (text or "").encode().lower().split()
    return {b" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def slow_survivors(rows):
    """The (doc_id, text) that stay: of each component the one with the smallest doc_id."""
    texts = sorted({t or "" for _, t in rows})
    sets, root = [slow_shingles(t) for t in texts], list(range(len(texts)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in combinations(range(len(texts)), 2):
        x, y = sets[i], sets[j]
        if 5 * min(len(x), len(y)) >= 4 * max(len(x), len(y)) and 5 * len(x & y) >= 4 * len(x | y):
            root[top(i)] = top(j)
    at, best = {t: i for i, t in enumerate(texts)}, {}
    for d, t in rows:
        r = top(at[t or ""])
        best[r] = min(best.get(r, (True, 0, "\U0010ffff")), (d is None, d or 0, t or ""))
    return [(None if n else d, t) for n, d, t in best.values()]


def test_near_dedup_is_brute_force_jaccard(spark, small, odd, nothing, sf):
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    base = [word() for _ in range(200)]
    edits = [" ".join(base)]
    for k in range(1, 9):
        w = list(base)
        for i in rng.sample(range(200), k):
            w[i] = word()
        edits.append(" ".join(w))
    edited = spark.createDataFrame(list(enumerate(edits)), "doc_id long, text string")
    for df in (edited, small, odd):
        got = corpus_pipeline.near_dedup(spark, df, sf)
        rows = [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]
        key = lambda r: (r[0] is None, r[0] or 0, r[1])
        assert got.columns == df.columns
        assert sorted(((r["doc_id"], r["text"] or "") for r in got.collect()), key=key) == sorted(slow_survivors(rows), key=key)
    assert corpus_pipeline.near_dedup(spark, nothing, sf).count() == 0


def test_near_dedup_of_null_and_repeated_ids(spark, sf):
    rows = [(None, "first text of its own kind here"), (None, "another text with other words altogether"), (3, "third text that shares the id"), (3, "a fourth that has nothing in common")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r["text"] for r in corpus_pipeline.near_dedup(spark, docs, sf).collect()) == sorted(t for _, t in rows)
