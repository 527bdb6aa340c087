"""Operators over the whole corpus: shards, mixes, packed windows; and the pipeline."""

import zlib
from collections import defaultdict
from fractions import Fraction

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st

import corpus_pipeline
from tests.llm.test_near_copies import slow_survivors
from tests.llm.test_texts import slow_ids
from trovespark.llm import language_id, mixing, packing, sharding, toxicity

PATH = public_tokenizers.path("byte_bpe_50k.json")


# --- shards --------------------------------------------------------------------------------------


def slow_capacity(sizes, shards):
    def ok(c):
        n, at = 1, 0
        for s in sizes:
            if s > c:
                return False
            if at + s > c:
                n, at = n + 1, 0
            at += s
        return n <= shards

    lo, hi = 1, max(1, sum(sizes))
    while lo < hi:
        mid = (lo + hi) // 2
        lo, hi = (lo, mid) if ok(mid) else (mid + 1, hi)
    return lo


def test_minimax_capacity_is_least(spark):
    rng = np.random.default_rng(2)
    for shards in (1, 3, 16):
        rows = [(int(h), int(s)) for h, s in zip(rng.integers(-(1 << 63), (1 << 63) - 1, 400), rng.integers(1, 3000, 400), strict=True)]
        rows += [(h + 1, 5) for h, _ in rows[:150]] + [rows[0]] * 40  # neighbours in the last bits, and a heavy group
        capacity, cuts = sharding.minimax_cuts(spark.createDataFrame(rows, "h long, size long"), shards)
        groups = defaultdict(int)
        for h, s in rows:
            groups[h ^ -(1 << 63)] += s
        assert capacity == slow_capacity([groups[k] for k in sorted(groups)], shards)
        loads = defaultdict(int)
        for k, s in groups.items():
            loads[sum(k >= c for c in cuts)] += s
        assert max(loads.values()) <= capacity and len(cuts) < shards


def test_shards(small, odd, nothing):
    for df in (small, odd):
        got = sharding.shard_documents(df, 16).collect()
        assert len(got) == df.count()
        text = {r["doc_id"]: r["text"] for r in df.select("doc_id", "text").collect()}
        slots, of_text = defaultdict(list), defaultdict(set)
        for r in got:
            raw = (text[r["doc_id"]] or "").encode()
            assert r["size"] == len(raw) + 1 and r["text_crc32"] == zlib.crc32(raw) and r["law"] == "bytes" and r["grown_shard"] is None
            slots[r["shard"]].append(r["slot"])
            of_text[text[r["doc_id"]]].add(r["shard"])
        assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(slots) <= set(range(16))
        assert all(len(s) == 1 for s in of_text.values())
    assert sharding.shard_documents(nothing).count() == 0


def loads_of(got):
    loads = defaultdict(int)
    for r in got:
        loads[r["shard"]] += r["size"]
    return [loads[i] for i in range(16)]


def test_shards_beside_a_heavy_group_are_even(spark):
    """With a group of a fifth of all bytes the other shards differ by at most the largest other group."""
    rows = [(i, f"{i:09d}") for i in range(4000)] + [(9000 + i, "h" * 99) for i in range(100)]
    loads = loads_of(sharding.shard_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert max(loads) == 10_000 and sum(loads) == 50_000
    others = sorted(loads)[:-1]
    assert others[-1] - others[0] <= 16 * 10  # cuts lie between cells of some groups
    few = loads_of(sharding.shard_documents(spark.createDataFrame(rows[:4], "doc_id long, text string")).collect())
    assert sorted(few)[-4:] == [10, 10, 10, 10]


@given(st.lists(st.integers(1, 50), min_size=1, max_size=60), st.integers(1, 16))
@settings(max_examples=200, deadline=None)
def test_even_cuts_keep_the_capacity(sizes, shards):
    before = [0, *np.cumsum(sizes).tolist()]
    capacity = slow_capacity(sizes, shards)
    cuts = [0, *sharding.even_cuts(before, shards, capacity), len(sizes)]
    assert cuts == sorted(cuts) and len(cuts) == shards + 1
    assert all(before[b] - before[a] <= capacity for a, b in zip(cuts, cuts[1:], strict=False))


# --- mixes ---------------------------------------------------------------------------------------


@given(st.lists(st.integers(0, 500), min_size=1, max_size=8), st.lists(st.integers(1, 9), min_size=8, max_size=8))
@settings(max_examples=150, deadline=None)
def test_targets(sizes, weights):
    t = mixing.targets(sizes, weights[: len(sizes)])
    assert sum(t) == sum(sizes) and all(0 <= x <= 3 * n for x, n in zip(t, sizes, strict=True))


@given(st.lists(st.integers(0, 50), min_size=1, max_size=6), st.integers(0, 60))
@settings(max_examples=200, deadline=None)
def test_sainte_lague(weights, blocks):
    got = mixing.sainte_lague([Fraction(w) for w in weights], blocks)
    if any(weights):
        want, quotient = [0] * len(weights), lambda i: Fraction(weights[i], 2 * want[i] + 1)
        for _ in range(blocks):
            want[max(range(len(weights)), key=lambda i: (quotient(i), -i))] += 1
        assert sum(got) == blocks and all(abs(a - b) <= 1 for a, b in zip(got, want, strict=True))
        more = mixing.sainte_lague([Fraction(w) for w in weights], blocks + 1)
        assert sum(more) == blocks + 1


def test_mix(small, odd, nothing):
    for df in (small, odd):
        got = mixing.mix_documents(df).collect()
        assert len(got) == df.count() and sorted(map(str, got)) == sorted(map(str, mixing.mix_documents(df).collect()))
        taken, target, size = defaultdict(int), {}, defaultdict(int)
        for r in got:
            assert 0 <= r["taken"] <= 3 * r["size"]
            taken[r["source"]] += r["taken"]
            size[r["source"]] += r["size"]
            target[r["source"]] = r["target"]
        assert all(abs(taken[s] - target[s]) <= 2 for s in taken) and all(target[s] <= 3 * size[s] + 1e-6 for s in size)
        assert abs(sum(target.values()) - sum(size.values())) < 1e-3
    assert mixing.mix_documents(nothing).count() == 0


def test_mix_of_tied_rows_agrees_over_reruns(spark):
    """Rows that share doc_id and byte length, in two sources, are taken alike however they are dealt."""
    rows = [(1, f"{'ab'[i % 2]}{i % 7:03d} w w", "xy"[i % 2]) for i in range(27)]
    runs = set()
    for seed in range(4):
        df = spark.createDataFrame([rows[i] for i in np.random.default_rng(seed).permutation(27)], "doc_id long, text string, source string").repartition(seed + 1)
        got = mixing.mix_documents(df, more=("text",)).collect()
        runs.add(tuple(sorted((r["source"], r["text"], r["taken"]) for r in got)))
    assert len(runs) == 1


# --- packing -------------------------------------------------------------------------------------


def check_packs(df, fill):
    ids = slow_ids()
    got = packing.pack_documents(df, PATH, items_each=60).collect()
    spans, sequences = defaultdict(list), defaultdict(list)
    for r in got:
        spans[r["doc_id"]].append(r)
        sequences[r["sequence_id"]].append(r)
    rows = df.select("doc_id", "text").collect()
    copies = defaultdict(list)
    for r in rows:
        copies[r["doc_id"]].append(ids(r["text"]))
    assert set(spans) == set(copies)
    for d, xs in copies.items():
        assert sum(r["length"] for r in spans[d]) == sum(map(len, xs))
        if len(xs) == 1:
            at = 0
            for r in sorted(spans[d], key=lambda r: r["start"]):
                assert r["start"] == at and r["ids_crc32"] == zlib.crc32(xs[0][at : at + r["length"]].tobytes()) and r["doc_tokens"] == len(xs[0])
                at += r["length"]
    for s in sequences.values():
        at = 0
        for r in sorted(s, key=lambda r: r["offset"]):
            assert r["offset"] == at and r["length"] > 0
            at += r["length"]
        assert at <= 1024
    assert sum(r["length"] for r in got) >= fill * 1024 * len(sequences)


def test_packing(small, odd, nothing):
    check_packs(small, 0.97)
    check_packs(odd, 0.9)
    assert packing.pack_documents(nothing, PATH).count() == 0


def test_neighbours_follow_bm25():
    items = [np.array(x) for x in ([1, 2, 3, 3], [3, 3, 4], [9, 9, 9], [3, 5, 6, 7], [1, 2, 3])]
    ix = packing.Bm25Index(items)
    n, df = 5, {1: 2, 2: 2, 3: 4}
    mean = np.mean([len(x) for x in items])

    def score(x):
        return sum(np.log1p((n - df[t] + 0.5) / (df[t] + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(x) / mean)) for t in df if (tf := (x == t).sum()))

    want = sorted((i for i in range(n) if score(items[i]) > 0), key=lambda i: (-score(items[i]), i))
    assert ix.neighbours(0, 24).tolist() == want


def test_weights_are_those_of_all_items(spark):
    items = [[1, 2, 3], [1, 1], [], [70_000, 1]]
    df = spark.createDataFrame([(bytearray(np.array(x, "<u4").tobytes()), 4) for x in items], "rest binary, width int").repartition(3)
    got, want = packing.corpus_of(df), packing.Corpus.of([np.array(x, np.int64) for x in items])
    assert (got.n, got.mean) == (4, 7 / 4) and np.array_equal(got.df, want.df)
    part, whole = packing.Bm25Index([np.array([1, 2, 3])], got), packing.Bm25Index([np.array([1, 2, 3])])
    assert not np.allclose(part.weight, whole.weight)


def test_hot_codes_are_split():
    plan = packing.shard_plan([(0, 10), (1, 5000), (2, 30), (3, 1980)], 2000)
    assert plan == [(0, 0, 1), (1, 1, 3), (2, 4, 1), (3, 5, 1)]


# --- pipeline ------------------------------------------------------------------------------------


def test_pipeline_stages(spark, small, sf):
    docs = small.cache()
    kept = corpus_pipeline.language(spark, docs, sf)
    assert kept.columns == docs.columns
    model = language_id.train(docs)

    def claimed(text):
        scores, met = model.measured([text.encode()])
        return scores.max() >= corpus_pipeline.LEAST_LANGUAGE and scores.max() - scores.mean() >= corpus_pipeline.LEAST_MARGIN and met[0] >= corpus_pipeline.LEAST_MET

    want = {r["doc_id"] for r in docs.collect() if r["text"] and any(c.isalpha() for c in r["text"]) and claimed(r["text"])}
    assert {r["doc_id"] for r in kept.collect()} == want
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    clean = corpus_pipeline.toxicity(spark, docs, sf)
    network = toxicity.train(docs, labels)
    score = {r["doc_id"]: network.score([r["text"].encode()])[0] for r in docs.collect()}
    assert {r["doc_id"] for r in clean.collect()} == {d for d, s in score.items() if s < corpus_pipeline.TOXIC}
    single = corpus_pipeline.near_dedup(spark, docs, sf)
    assert single.columns == docs.columns and {r["doc_id"] for r in single.collect()} == {d for d, _ in slow_survivors([(r["doc_id"], r["text"]) for r in docs.collect()])}
    mix = corpus_pipeline.mixing(spark, docs, sf)
    times = {r["doc_id"]: round(r["taken"] / r["size"]) for r in mixing.mix_documents(docs).collect() if r["size"]}
    got = defaultdict(int)
    for r in mix.collect():
        got[r["doc_id"]] += 1
    assert mix.columns == docs.columns and sum(got.values()) > 0 and all(abs(got[d] - n) <= 1 for d, n in times.items())


def test_stages_of_odd_and_empty_tables(spark, odd, nothing, sf):
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, nothing, sf).count() == 0, name
        out = stage(spark, odd, sf)
        if name != "packing":
            assert out.columns == odd.columns and {r["text"] for r in out.select("text").collect()} <= {r["text"] for r in odd.select("text").collect()}, name
        assert out.count() > 0, name


def test_stages_leave_clashing_columns_alone(spark, sf):
    rows = [(i, f"some words of text number {i} with others behind it", "en", "ab"[i % 2], 1, 2, 3, 4, 5) for i in range(12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, _row int, _same int, _own int, th int, _times int")
    for stage in (corpus_pipeline.near_dedup, corpus_pipeline.mixing):
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns and {tuple(r)[4:] for r in out.collect()} == {(1, 2, 3, 4, 5)}


def test_mix_of_rows_that_share_an_id(spark):
    docs = spark.createDataFrame([(5, "one two three four", "a"), (5, " ".join(["w"] * 200), "a"), (5, "one two three four", "a")], "doc_id long, text string, source string")
    assert mixing.mixed(docs).count() == 3


def test_pipeline_runs(spark, sf):
    out = corpus_pipeline.run(spark, sf)
    assert out.count() > 0 and {"doc_id", "sequence_id", "offset"} <= set(out.columns)
