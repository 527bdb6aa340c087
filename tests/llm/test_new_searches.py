"""Hard negatives, substring dedup and bit-sliced search against brute force, on odd rows and empty tables."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from pyspark.sql import functions as F

from trovespark.llm import bit_sliced, common, hard_negatives, substring_dedup


def by_sql(sql, sf, *tables):
    con = duckdb.connect()
    for t in tables:
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return con.execute(sql).fetchall()


def rows_of(df):
    return [tuple(r) for r in df.collect()]


def ordered(rows):
    return sorted(rows, key=str)


# --- hard negatives --------------------------------------------------------------------------------

VECTORS = "vec_id long, embedding array<float>, label int, q int, row string, rank int"


def slow_negatives(rows, positives=5, negatives=10):
    take = []
    for i, (vec_id, x, label, *_) in enumerate(rows):
        if label is None or x is None or any(v is None or not math.isfinite(v) for v in x):
            continue
        if vec_id is not None and vec_id % 7 == 0:
            label = (label + 1) % 10
        take.append((i, vec_id, label, [math.floor(256 * float(np.float32(v))) for v in x]))
    last = lambda v: (v is None, v or 0)
    out = []
    for i, a, label, x in take:
        if a is None or a % 100:
            continue
        scored = sorted(((-sum(p * q for p, q in zip(x, y, strict=False)), last(b), j, b, other) for j, b, other, y in take if j != i), key=lambda r: r[:3])
        for r in [r for r in scored if r[4] == label][:positives]:
            window = [n for n in scored if n[4] != label and 30 * -r[0] <= 100 * -n[0] <= 90 * -r[0]][:negatives]
            out += [(a, r[3], k + 1, n[3], -r[0], -n[0]) for k, n in enumerate(window)]
    return out


def test_negatives_on_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(hard_negatives, "PANEL", 2)
    monkeypatch.setattr(hard_negatives, "BLOCK", 7)
    rng = random.Random(3)
    rows = [(i * 20, [rng.uniform(-1, 1) for _ in range(rng.choice((40, 40, 33, 3)))], rng.randrange(3), 1, "r", 9) for i in range(40)]
    rows += [(None, rows[3][1], 0, 0, "", 0), (None, rows[3][1], 1, 0, "", 0), (7, [], 2, 0, "", 0), (11, None, 2, 0, "", 0), (12, [0.5, None], 1, 0, "", 0), (13, [float("nan")], 1, 0, "", 0), (14, [float("inf")], 1, 0, "", 0), (15, [0.5] * 40, None, 0, "", 0)]
    rows += [rows[5], rows[5], rows[10], (30_000, rows[0][1], 77, 0, "", 0)]  # repeats, of an anchor too, and a label of its own
    df = spark.createDataFrame(rows, VECTORS).repartition(3)
    got = [r[:6] for r in rows_of(hard_negatives.mined_from_embeddings(df))]
    assert len(got) > 100 and ordered(got) == ordered(slow_negatives(rows))
    assert hard_negatives.mined_from_embeddings(df.where("false")).count() == 0


def test_negatives_against_sql(spark, sf):
    got = rows_of(hard_negatives.mined_from_embeddings(spark.read.parquet(f"{sf}/embeddings.parquet")))
    assert ordered(got) == ordered(by_sql(hard_negatives.SQL, sf, "embeddings"))


def test_products_are_exact_or_end():
    a = np.full((2, 32), (1 << 24) + 1)
    assert hard_negatives.product(a, a[:1], 2).tolist() == [[32 * ((1 << 24) + 1) ** 2]] * 2  # beyond what doubles hold
    with pytest.raises(OverflowError):
        hard_negatives.product(a * 64, a * 64, 1)


@pytest.mark.parametrize("most", [9, 1 << 18, 1 << 25])  # sums in floats, doubles and longs
def test_negatives_in_chunks_and_strips(spark, monkeypatch, most):
    for name, n in (("PANEL", 9), ("BLOCK", 30), ("STRIP", 8), ("FIRST_STRIP", 2), ("CHUNK", 16)):
        monkeypatch.setattr(hard_negatives, name, n)
    rng = random.Random(5)
    rows = [(i, rng.randrange(3), [rng.randint(-most, most) for _ in range(40)]) for i in range(70)]
    rows += [(100 + i, rng.randrange(3), rows[i % 9][2]) for i in range(40)]  # equal scores
    got = rows_of(hard_negatives.hard_negatives(spark.createDataFrame(rows, "vec_id long, label long, q array<long>").repartition(3), F.col("vec_id") % 3 == 0))
    want = []
    for a, label, x in rows:
        scored = sorted((-sum(p * q for p, q in zip(x, y, strict=True)), b, other) for b, other, y in rows if b != a and a % 3 == 0)
        for place, (p, positive, _) in enumerate([r for r in scored if r[2] == label][:5]):
            window = [(n, b) for n, b, other in scored if other != label and 30 * -p <= 100 * -n <= 90 * -p][:10]
            want += [(a, positive, k + 1, b, -p, -n, place + 1) for k, (n, b) in enumerate(window)]
    assert len(want) > 300 and ordered(got) == ordered(want)


def test_negatives_write_no_scores(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(common, "shared_folder", lambda _: f"file://{tmp_path}")
    x = np.random.default_rng(2).integers(-250, 250, (1500, 16))
    df = spark.createDataFrame([(i, i % 4, v) for i, v in enumerate(x.tolist())], "vec_id long, label long, q array<long>")
    assert hard_negatives.hard_negatives(df, F.lit(True)).count() > 50_000
    assert sum(f.stat().st_size for f in tmp_path.rglob("*.parquet")) < 1 << 20  # of 18 MB of scores


# --- substring dedup -------------------------------------------------------------------------------


def slow_dedup(rows, window):
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t, *_ in rows]
    first = {}
    for (d, *_), w in zip(rows, words, strict=True):
        for p in range(len(w) - window + 1):
            if d is not None:
                key = tuple(w[p : p + window])
                first[key] = min(first.get(key, d), d)
    out = []
    for (d, *_), w in zip(rows, words, strict=True):
        gone = set()
        for p in range(len(w) - window + 1):
            if d is not None and first[tuple(w[p : p + window])] < d:
                gone |= set(range(p, p + window))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((d, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


def passages(seed, n=60):
    """Texts that share passages below, at and above the window, with runs, periods, copies and repeated rows."""
    rng = random.Random(seed)
    word = lambda: rng.choice("ab") * rng.randint(1, 3) + rng.choice(["", "é", "語"])
    shared = [[word() for _ in range(k)] for k in (9, 10, 11, 25, 60)] + [["x"] * 40, ["p", "q"] * 20, ["l", "m", "n"] * 15]
    rows = []
    for i in range(n):
        text = []
        for _ in range(rng.randint(0, 4)):
            text += rng.choice(shared) if rng.random() < 0.6 else [word() for _ in range(rng.randint(1, 30))]
        rows.append((rng.choice([i, i // 2, None if i % 17 == 0 else i]), rng.choice([" ", "\n", "\t  "]).join(text), "en", "a", 1, 1, "", "", ""))
    return rows + rows[:5] + [rows[7], (900, None, "", "", 1, 1, "", "", ""), (901, " \n ", "", "", 1, 1, "", "", "")]


@pytest.mark.parametrize("seed", [1, 2])
def test_dedup_of_passages(spark, seed):
    rows = passages(seed)
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, size int, th string, start string, spans string").repartition(3)
    got = substring_dedup.deduplicated(df, window=10)
    assert sum(r["n_removed"] for r in got.collect()) > 300
    assert ordered(rows_of(got.drop("kept"))) == ordered(slow_dedup(rows, 10))


def test_dedup_on_odd_rows(spark, odd, nothing):
    rows = rows_of(odd.select("doc_id", "text"))
    assert ordered(rows_of(substring_dedup.deduplicated(odd).drop("kept"))) == ordered(slow_dedup(rows, 50))
    assert substring_dedup.deduplicated(nothing).count() == 0


def test_dedup_against_sql(spark, sf, small):
    got = rows_of(substring_dedup.deduplicated(small).drop("kept"))
    assert ordered(got) == ordered(by_sql(substring_dedup.SQL, sf, "documents"))


def test_kept_text(spark):
    passage = " ".join(f"w{i}" for i in range(60))
    df = spark.createDataFrame([(1, passage), (2, f"before {passage} after"), (3, "alone")], "doc_id long, text string")
    assert {r["doc_id"]: r["kept"] for r in substring_dedup.deduplicated(df).collect()} == {1: None, 2: "before after", 3: None}


def test_settled_symbols_do_not_depend_on_context():
    """Whatever holds the words that settle a symbol parses to that symbol; and the intervals never fall."""
    rng = np.random.default_rng(5)
    shared = rng.choice(np.arange(1, 9, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15), 300)
    parses = []
    for _ in range(4):
        before, after = (rng.integers(1, 1 << 63, rng.integers(0, 40)).astype(np.uint64) for _ in range(2))
        names = np.concatenate([[1], before, shared, after, [2]]).astype(np.uint64)
        fence, places = np.zeros(len(names), bool), np.arange(len(names))
        fence[[0, -1]] = True
        found = []
        for level, (symbols, low, high) in enumerate(substring_dedup.compressed(names, places, places + 1, fence)):
            assert (np.diff(low) >= 0).all() and (np.diff(high) >= 0).all()
            begin = 1 + len(before)
            found += [(level, int(s), int(a) - begin, int(b) - begin) for s, a, b in zip(symbols, low, high, strict=True) if a >= begin and b <= begin + len(shared)]
        parses.append(found)
    assert all(p == parses[0] for p in parses) and len(parses[0]) > 200


def test_pieces_of_long_texts(monkeypatch):
    """Cut into pieces, a text's windows have the anchors they have in the whole."""
    texts = pa.array([t or "" for _, t, *_ in passages(4)] + [" ".join(t for _, t, *_ in passages(6) if t)])
    powers, found = substring_dedup.Powers(1 << 16), []
    for piece in (1 << 15, 64):
        monkeypatch.setattr(substring_dedup, "PIECE", piece)
        anchors = defaultdict(list)
        for d, (anchor, _, start, n) in substring_dedup.parsed(substring_dedup.Words(texts), 10, powers):
            for a, s, k in zip(anchor, start, n, strict=True):
                anchors[d] += [(int(w), int(a)) for w in range(s, s + k)]
        found.append(anchors)
    sizes = [len((t.as_py()).split()) for t in texts]
    assert found[0] == found[1] and all([w for w, _ in found[0][d]] == list(range(n - 9)) for d, n in enumerate(sizes) if n >= 10)


def test_words_without_objects():
    texts = ["a bb  é\n", "", None, " \t ", "語 x", "end"]
    w = substring_dedup.Words(pa.array([t or "" for t in texts]).slice(1))
    assert np.diff(w.first).tolist() == [0, 0, 0, 2, 1]
    assert b"".join(w.joined(3)).decode() == "語 x" and b"".join(w.joined(3, np.array([False, True]))) == b"x"


# --- ranked search ---------------------------------------------------------------------------------


def slow_ranking(docs, items, k=20):
    cut = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    bags = [(d, Counter(cut(t))) for d, t in docs]
    bags = [(d, b, b.total()) for d, b in bags if b]
    n_docs, all_terms = len(bags), sum(n for _, _, n in bags)
    df = Counter(t for _, b, _ in bags for t in b)
    out = []
    for item, text in items:
        scored = []
        for d, b, n in bags:
            m = 100 - 25 + 25 * n * n_docs // all_terms
            score = sum(c * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1_000_000_000 * b[t] // (1000 * b[t] + 12 * m)) for t, c in Counter(cut(text)).items() if b[t])
            if score > 0:
                scored.append((-score, d is None, d or 0, d))
        out += [(item, r + 1, x[3], -x[0]) for r, x in enumerate(sorted(scored)[:k])]
    return out


def test_ranking_on_odd_rows(spark, odd, nothing, monkeypatch):
    monkeypatch.setattr(bit_sliced, "SHARD_DOCS", 9)
    monkeypatch.setattr(bit_sliced, "GROUP", 2)
    monkeypatch.setattr(bit_sliced, "PAIRS", 50)
    docs = rows_of(odd.select("doc_id", "text"))
    long = next(t for _, t in docs if t and len(t) > 100_000)
    items = [(1, "the MIT LICENSE"), (1, "License"), (2, None), (3, ""), (4, "日本語の 123"), (5, "no such word is there"), (6, docs[12][1] + " " + docs[12][1]), (None, "one two one ONE"), (8, long)]
    asked = spark.createDataFrame([(*i, "x", 1) for i in items], "item_id long, text string, term string, df int")
    for k in (1, 3, 20):
        assert ordered(rows_of(bit_sliced.ranked(odd, asked, k))) == ordered(slow_ranking(docs, items, k))
    assert bit_sliced.ranked(nothing, asked).count() == 0 and bit_sliced.ranked(odd, asked.where("false")).count() == 0


def test_ranking_against_sql(spark, sf, small):
    got = rows_of(bit_sliced.ranked(small, spark.read.parquet(f"{sf}/benchmark.parquet")))
    assert ordered(got) == ordered(by_sql(bit_sliced.SQL, sf, "documents", "benchmark"))


def test_slices_add_and_descend():
    rng = np.random.default_rng(7)
    total, want = np.zeros((60, 3, 5), np.uint64), np.zeros((3, 320), np.int64)
    for _ in range(40):
        slots = np.unique(rng.integers(0, 320, rng.integers(1, 60)))
        impacts, of, shift = rng.integers(1, 1 << rng.integers(1, 34), len(slots)), np.unique(rng.integers(0, 3, 2)), int(rng.integers(0, 5))
        bit_sliced.add(total, of, *bit_sliced.slices_of(slots, impacts, 5), shift)
        for q in of:
            want[q, slots] += impacts << shift
    for q in range(3):
        best = defaultdict(int, {s: int(x) for s, x in enumerate(want[q]) if x})
        for k in (1, 7, 1000):
            assert sorted(bit_sliced.top(total[:, q], k), key=lambda x: (-x[1], x[0])) == sorted(best.items(), key=lambda x: (-x[1], x[0]))[:k]


def test_ties_at_the_limit_go_by_slot():
    total = np.zeros((2, 1, 1), np.uint64)
    bit_sliced.add(total, np.array([0]), *bit_sliced.slices_of(np.arange(2, 60), np.ones(58, np.int64), 1))
    assert bit_sliced.top(total[:, 0], 3) == [(2, 1), (3, 1), (4, 1)]
