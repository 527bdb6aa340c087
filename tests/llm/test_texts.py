"""Operators that read each text by itself, and those that link fingerprints, against brute force."""

import hashlib
import random
import re
import struct
import time
import tracemalloc
import zlib
from collections import Counter
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from trovespark.llm import jpeg, language_id, licenses, media, near_dedup, simhash, token_files, tokens, toxicity
from trovespark.llm.common import components, shared_cells

PATH = public_tokenizers.path("byte_bpe_50k.json")


def rows_of(df):
    return df.select("doc_id", "text").collect()


# --- near duplicates -----------------------------------------------------------------------------


def slow_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    h = [xxhash.xxh64(" ".join(words[i : i + 4]).encode(), seed=42).intdigest() for i in range(max(1, len(words) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def slow_components(pairs):
    """pairs of (doc_id, fingerprint) to the smallest doc_id that each fingerprint reaches."""
    fps = sorted({f for _, f in pairs})
    root = {f: f for f in fps}

    def find(f):
        while root[f] != f:
            f = root[f]
        return f

    for i, a in enumerate(fps):
        for b in fps[i + 1 :]:
            if (a ^ b).bit_count() <= 4:
                root[find(a)] = find(b)
    least = {}
    for d, f in pairs:
        if d is not None:
            least[find(f)] = min(d, least.get(find(f), d))
    return {f: least.get(find(f)) for f in fps}


def check_near(df):
    pairs = [(r["doc_id"], slow_fingerprint(r["text"])) for r in rows_of(df)]
    want = slow_components(pairs)
    got = near_dedup.near_duplicates(df).collect()
    assert sorted((str(r["doc_id"]), r["fingerprint"], r["component_id"]) for r in got) == sorted((str(d), f"{f:016x}", want[f]) for d, f in pairs)


def test_near_duplicates(small, odd, nothing):
    check_near(small)
    check_near(odd)
    assert near_dedup.near_duplicates(nothing).count() == 0


def test_links_of_a_loose_cluster(spark):
    """Members up to four bits off a centre: most aren't linked with each other, all must meet; and a chain."""
    rng = np.random.default_rng(3)
    centre = 0x123456789ABCDEF0
    fps = {centre ^ sum(1 << int(b) for b in rng.choice(64, k, replace=False)) for k in (1, 2, 3, 4) for _ in range(40)}
    fps |= {(0xF << 4 * k) for k in range(12)} | {int(x) for x in rng.integers(0, 1 << 63, 300)}
    signed = [x - (1 << 64) if x >> 63 else x for x in sorted(fps)]
    classes = spark.createDataFrame([(x, 1) for x in signed], "fp long, n long")
    got = {r["node"]: r["root"] for r in components(near_dedup.fingerprint_links(classes)).collect()}
    want = slow_components([(x, x & (1 << 64) - 1) for x in signed])
    mine, theirs = {}, {}
    for x in signed:
        mine.setdefault(got.get(x, x), set()).add(x)
        theirs.setdefault(want[x & (1 << 64) - 1], set()).add(x)
    assert sorted(map(sorted, mine.values())) == sorted(map(sorted, theirs.values()))


def test_crowded_cells_are_kept_by_node(spark):
    """60 near copies share most of their cells: what is joined to them is joined to 60 rows, not to one for each cell."""
    fps = [1 << i for i in range(60)]
    v = near_dedup.popcounts(F.col("node"))
    grid = F.explode(F.array(*[F.lit(m) for m in near_dedup.projections(4)]))
    nodes = spark.createDataFrame([(x, 1) for x in fps], "node long, n long").withColumn("v", v)
    cells = nodes.select("node", "v", grid.alias("g")).select(F.xxhash64("g", F.col("v").bitwiseAND(F.col("g"))).alias("cell"), "node")
    _, shared = shared_cells(cells, "few")
    got = {r["node"]: r["met"] for r in shared.collect()}
    assert shared.count() == len(fps) and set(got) == set(fps)
    counts = {r["cell"]: r["count"] for r in cells.groupBy("cell").count().collect()}
    for r in cells.groupBy("node").agg(F.collect_set("cell").alias("cells")).collect():
        assert sorted((m["cell"], m["members"]) for m in got[r["node"]]) == sorted((c, counts[c]) for c in r["cells"] if counts[c] > 2)


@given(st.integers(0, (1 << 64) - 1), st.integers(0, (1 << 64) - 1))
@settings(max_examples=200, deadline=None)
def test_manhattan_bounds_hamming(a, b):
    def popcounts(x):
        return [(x >> 2 * i & 3).bit_count() for i in range(32)]

    assert sum(abs(p - q) for p, q in zip(popcounts(a), popcounts(b), strict=True)) <= (a ^ b).bit_count()


# --- fingerprints --------------------------------------------------------------------------------


def test_simhash_rows(small, odd, nothing):
    for df in (small, odd):
        rows = rows_of(df)
        got = simhash.fingerprints_with_edits(df).collect()
        assert Counter(str(r["doc_id"]) for r in got) == Counter(str(r["doc_id"]) for r in rows)
        by_text = {}
        text = {r["doc_id"]: r["text"] or "" for r in rows}
        for r in got:
            by_text.setdefault(text[r["doc_id"]], set()).add(r["fingerprint"])
            assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 and r["n_chars"] == len(text[r["doc_id"]])
        assert all(len(f) == 1 for f in by_text.values())
    assert simhash.fingerprints_with_edits(nothing).count() == 0


def slow_simhash(text):
    """Votes of the hashes of each word with its successor, by weight; Spark's xxhash64 chains XXH64, from seed 42, over its arguments."""
    words = [w for w in re.split("[\\x00-\\x20]+", text) if w]
    seed, votes, whole = xxhash.xxh64_intdigest(struct.pack("<i", 5), 42), [0] * 64, 0
    for a, b in zip(words, [*words[1:], None][: len(words)], strict=True):
        h, weight = xxhash.xxh64_intdigest(a.encode(), seed), len(a.encode()) + len((b or "").encode())
        h = h if b is None else xxhash.xxh64_intdigest(b.encode(), h)
        weight = min(16, weight)
        whole += weight
        votes = [v + weight * (h >> i & 1) for i, v in enumerate(votes)]
    return sum(1 << i for i, v in enumerate(votes) if 2 * v > whole)


def test_fingerprints_by_loops(small, odd):
    for df in (small, odd.where("doc_id is not null").dropDuplicates(["doc_id"])):
        rows = sorted(rows_of(df), key=lambda r: -r["doc_id"])
        text = [r["text"] or "" for r in rows]
        edited = [t[: len(t) - len(t) // 2] + n[: len(t) // 2] for t, n in zip(text, text[1:] + text[:1], strict=True)]
        own, other = list(map(slow_simhash, text)), list(map(slow_simhash, edited))
        like = lambda x, y: 1 - (x ^ y).bit_count() / 64
        got = {r["doc_id"]: r for r in simhash.fingerprints_with_edits(df).collect()}
        for i, r in enumerate(rows):
            g = got[r["doc_id"]]
            assert (g["fingerprint"], g["edited_fingerprint"]) == (f"{own[i]:016x}", f"{other[i]:016x}")
            assert (g["near_edited"], g["near_next"]) == (like(own[i], other[i]), like(own[i], own[(i + 1) % len(own)]))
            assert g["near_within"] == (sum((own[i] ^ x).bit_count() <= 3 for x in own) if r["doc_id"] % 20 == 0 else None)


def test_simhash_edits(small):
    rows = sorted(rows_of(small), key=lambda r: -r["doc_id"])
    want = {}
    for r, n in zip(rows, rows[1:] + rows[:1], strict=True):
        half = len(r["text"]) // 2
        want[r["doc_id"]] = hashlib.sha256((r["text"][: len(r["text"]) - half] + n["text"][:half]).encode()).hexdigest()
    got = simhash.fingerprints_with_edits(small).collect()
    assert {r["doc_id"]: r["edited_sha256"] for r in got} == want
    assert np.mean([r["near_edited"] for r in got]) > np.mean([r["near_next"] for r in got]) + 0.1


def test_block_tables_find_all(spark):
    rng = np.random.default_rng(1)
    base = [int(x) for x in rng.integers(-(1 << 62), 1 << 62, 60)]
    fps = sorted({b ^ sum(1 << int(k) for k in rng.choice(63, n, replace=False)) for b in base for n in (0, 1, 2, 3, 4, 5)})
    df = spark.createDataFrame([(x,) for x in fps], "fp long")
    got = Counter((r["q"], r["fp"]) for r in simhash.within(df.where("fp % 3 = 0"), df).collect())
    mask = (1 << 64) - 1
    assert got == Counter((a, b) for a in fps if int(np.fmod(a, 3)) == 0 for b in fps if ((a ^ b) & mask).bit_count() <= 3)


# --- licences ------------------------------------------------------------------------------------


def test_licences(small, odd, nothing):
    lower = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})
    for df in (small, odd):
        got = {str(r["doc_id"]): r for r in licenses.scan_licences(df).collect()}
        assert licenses.scan_licences(df).count() == df.count()
        for r in rows_of(df):
            words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (r["text"] or "").translate(lower))
            hits = [(i, label) for p, label in licenses.PHRASES.items() for i in range(len(words)) if words[i : i + len(p.split())] == p.split()]
            g = got[str(r["doc_id"])]
            assert (g["n_words"], g["n_base"]) == (len(words), len(hits))
            assert g["base_labels"] == ",".join(sorted({x for _, x in hits})) and set(filter(None, g["base_labels"].split(","))) <= set(g["labels"].split(","))
            assert (g["first_word"], g["last_word"]) == ((min(hits)[0], max(hits)[0]) if hits else (None, None))
    assert licenses.scan_licences(nothing).count() == 0


def test_licence_templates_and_near_misses():
    ix = licenses.LicenceIndex()
    for k, (_, t, _) in enumerate(licenses.TEMPLATES):
        w = t.split()
        cut = " ".join(w[: len(w) // 2] + ["zebra"] + w[len(w) // 2 :])
        assert any(s[0] == k and s[3] > 0.9 for s in ix.spans(ix.scan(("some words " + t + " after").encode())[2]))
        assert len(w) < 12 or any(s[0] == k for s in ix.spans(ix.scan(cut.encode())[2]))
    assert ix.spans(ix.scan(b"permission is hereby given to nobody")[2]) == []


@given(st.sets(st.integers(0, 90), max_size=9))
@settings(max_examples=60, deadline=None)
def test_covered_share_is_that_of_the_runs_left(gone):
    """Words of a template are replaced one by one; runs of three or more words between them count, gaps of eight at most are chained."""
    label, template, must = licenses.TEMPLATES[0]
    words = licenses.words_of(template.encode())
    marred = [b"zz" if i in gone else w for i, w in enumerate(words)]
    runs, i = [], 0
    while i < len(words):
        j = i
        while j < len(words) and j not in gone:
            j += 1
        if j - i >= 3:
            runs.append((i, j - 1))
        i = max(j, i + 1)
    tell = words_at(words, must)
    chains = []
    for a, z in runs:
        told = a <= tell[0] and tell[1] <= z
        if chains and a - chains[-1][1] <= 8:
            chains[-1] = [chains[-1][0], z, chains[-1][2] + z - a + 1, chains[-1][3] or told]
        else:
            chains.append([a, z, z - a + 1, told])
    want = [(a, z, n / len(words)) for a, z, n, told in chains if told and n / len(words) >= 0.7]
    ix = licenses.standard_index()
    assert [(a, z, c) for k, a, z, c in ix.spans(ix.scan(b" ".join(marred))[2]) if k == 0] == want


def words_at(words, phrase):
    p = licenses.words_of(phrase.encode())
    i = next(i for i in range(len(words)) if words[i : i + len(p)] == p)
    return i, i + len(p) - 1


def test_licences_of_one_family_are_told_apart():
    ix = licenses.standard_index()
    for k, (label, text, must) in enumerate(licenses.TEMPLATES):
        found = {ix.templates[s[0]][0] for s in ix.spans(ix.scan(b"x " + text.encode() + b" y")[2])}
        assert found == {label}, (label, found)


@given(st.lists(st.sampled_from("abc"), max_size=8), st.lists(st.sampled_from("abc"), max_size=8), st.lists(st.sampled_from("abcd"), max_size=12))
@settings(max_examples=150, deadline=None)
def test_automaton_matching_statistics(x, y, text):
    auto = licenses.SuffixAutomaton([[ord(c) for c in x], [ord(c) for c in y]])
    state = held = 0
    for i, c in enumerate(text):
        while state and ord(c) not in auto.next[state]:
            state = auto.link[state]
            held = auto.length[state]
        if ord(c) in auto.next[state]:
            state, held = auto.next[state][ord(c)], held + 1
        else:
            state = held = 0
        joined = ["".join(x), "".join(y)]
        assert held == max(n for n in range(i + 2) if any("".join(text[i + 1 - n : i + 1]) in j for j in joined))


# --- media ---------------------------------------------------------------------------------------


def test_media_round_trip(small, odd, nothing):
    for df in (small, odd):
        got = media.media_of_documents(df).collect()
        assert len(got) == df.count()
        text = {r["doc_id"]: (r["text"] or "").encode() for r in rows_of(df)}
        for r in got:
            p = media.padded(text[r["doc_id"]])
            assert len(p) % 64 == 0 and p
            assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(text[r["doc_id"]]), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]))
    assert media.media_of_documents(nothing).count() == 0


@given(st.lists(st.binary(min_size=1, max_size=700), min_size=1, max_size=5))
@settings(max_examples=60, deadline=None)
def test_jpeg_is_lossless(payloads):
    p = [media.padded(x) for x in payloads]
    stored = jpeg.store(p)
    assert [g.tobytes() for g, _ in jpeg.thumbnails(stored)] == p
    assert all(s[:2] == b"\xff\xd8" and s[-2:] == b"\xff\xd9" for s in stored)


def test_jpeg_series_of_images():
    p = bytes(range(256)) * 2400
    (grid, sizes), (other, _) = jpeg.thumbnails(jpeg.store([p, bytes(64)]))
    assert grid.tobytes() == p and len(sizes) == 2 and other.tobytes() == bytes(64)


def test_jpeg_with_ac_coefficients():
    """A hand-made image of two blocks with AC symbols: code 0 ends a block, 10 is a run of 0 and one bit, 110 a run of 15 zeros."""
    import struct

    dc, ac = bytes([0, 2] + [0] * 14) + bytes([0, 3]), bytes([1, 1, 1] + [0] * 13) + bytes([0x00, 0x01, 0xF0])
    bits = "01" + "101" + "10" + "1" + "110" + "10" + "0" + "0" + "00" + "0"  # block 1: DC +5, AC 1, ZRL, AC -1, EOB; block 2: same DC, EOB
    bits += "1" * (-len(bits) % 8)
    scan = bytes(int(bits[i : i + 8], 2) for i in range(0, len(bits), 8)).replace(b"\xff", b"\xff\0")
    seg = lambda m, b: struct.pack(">BBH", 0xFF, m, len(b) + 2) + b
    img = b"\xff\xd8" + seg(0xDB, bytes([0] + [16] * 64)) + seg(0xC0, struct.pack(">BHHB3B", 8, 8, 16, 1, 1, 0x11, 0)) + seg(0xC4, b"\0" + dc) + seg(0xC4, b"\x10" + ac) + seg(0xDA, bytes([1, 1, 0, 0, 63, 0])) + scan + b"\xff\xd9"
    (grid, sizes), = jpeg.thumbnails([img])
    assert sizes == [(16, 8)] and grid.tolist() == [[138, 138]]


def slow_feature(payload):
    """The size of the image and its average hash, by loops."""
    rows = [payload[i : i + 64] for i in range(0, len(payload), 64)]
    at = [[min(k * n // 8, n - 1) for k in range(8)] for n in (len(rows), 64)]
    cells = []
    for i in range(8):
        for j in range(8):
            down = range(at[0][i], max(at[0][i] + 1, at[0][i + 1] if i < 7 else len(rows)))
            across = range(at[1][j], at[1][j + 1] if j < 7 else 64)
            cells.append(sum(rows[y][x] for y in down for x in across) / (len(down) * len(across)))
    mean = sum(cells) / 64
    bits = "".join(str(int(c > mean)) for c in cells)
    return f"512x{8 * len(rows)}:{int(bits, 2):016x}"


def test_features_by_loops(small, odd):
    for df in (small, odd):
        text = {r["doc_id"]: (r["text"] or "").encode() for r in rows_of(df)}
        for r in media.media_of_documents(df.where("coalesce(length(text), 0) < 60000")).collect():
            assert r["feature"] == slow_feature(media.padded(text[r["doc_id"]]))


def test_media_that_is_null_malformed_or_progressive(spark):
    good = jpeg.store([bytes(range(64))])[0]
    progressive = good.replace(b"\xff\xc0", b"\xff\xc2", 1)
    rows = [(0, good), (1, None), (2, b""), (3, b"no image"), (4, good[:40]), (5, progressive), (6, good[:-9]), (7, good.replace(b"\xff\xc4", b"\xff\xe0")), (8, good)]
    df = spark.createDataFrame([(i, 1, None if m is None else bytearray(m)) for i, m in rows], "doc_id long, n_bytes long, media binary")
    got = {r["doc_id"]: r for r in media.jpeg_features(df).collect()}
    assert len(got) == len(rows) and got[0]["feature"] == got[8]["feature"] == slow_feature(bytes(range(64)))
    assert all(got[i]["payload_bytes"] == 0 and got[i]["feature"] == "0x0:" + "0" * 16 for i in (1, 2, 3, 4, 5, 7))


# --- tokens --------------------------------------------------------------------------------------


@lru_cache
def slow_ids():
    t = Tokenizer.from_file(PATH)
    return lambda text: np.array(t.encode(text or "", add_special_tokens=False).ids + [0], "<u4")


def encoded(enc, texts):
    ids, upto = enc.encode(pa.array(texts, pa.string()))
    return [ids[i:j].tolist() for i, j in zip(upto[:-1], upto[1:], strict=True)]


@given(st.lists(st.text(st.sampled_from(" \n\taBé's!9日\x1c²_\xa0ñ\x00\x7f\xad\u3000"), max_size=14) | st.sampled_from(["a <|endoftext|> b", "<|endoftext|>"]), max_size=6))
@settings(max_examples=300, deadline=None)
def test_encoder_is_the_library(texts):
    ids = slow_ids()
    assert encoded(tokens.encoder(PATH), texts) == [ids(t).tolist() for t in texts]


def test_encoder_with_full_tables():
    ids, enc = slow_ids(), tokens.Encoder(PATH, most=5)
    for texts in (["one two three", "four five"], ["six seven eight nine, ten", "one two six"], ["two six", "  odd  spaces "]):
        assert encoded(enc, texts) == [ids(t).tolist() for t in texts] and len(enc.size) <= 12 and len(enc.pieces) <= 12


def test_special_tokens_as_text():
    ids = Tokenizer.from_file(PATH)
    ids.encode_special_tokens = True
    t = "a <|endoftext|> b"
    assert encoded(tokens.Encoder(PATH, None, special_as_text=True), [t]) == [ids.encode(t, add_special_tokens=False).ids]


def test_vocabulary_of_another_kind():
    other = public_tokenizers.path("word_bpe_49k.json")
    t = ["Some Words, here", ""]
    assert encoded(tokens.Encoder(other, None), t) == [Tokenizer.from_file(other).encode(x, add_special_tokens=False).ids for x in t]


def test_token_files(small, odd, nothing):
    ids = slow_ids()
    for df in (small, odd):
        got = token_files.token_files(df, PATH, rows_each=20).orderBy("start").collect()
        rows = sorted(rows_of(df), key=lambda r: (r["doc_id"] is not None, r["doc_id"], r["text"] or ""))
        at = 0
        for g, r in zip(got, rows, strict=True):
            x = ids(r["text"])
            assert (g["doc_id"], g["start"], g["n_tokens"], g["ids_crc32"]) == (r["doc_id"], at, len(x), zlib.crc32(x.tobytes()))
            at += len(x)
    assert token_files.token_files(nothing, PATH).count() == 0


def test_token_files_of_far_ids(spark):
    ids = [-9 * 10**18, None, -1, 9 * 10**18]
    got = token_files.token_files(spark.createDataFrame([(i, "text") for i in ids], "doc_id long, text string"), PATH, rows_each=2).orderBy("start").collect()
    assert [r["doc_id"] for r in got] == [None, *sorted(i for i in ids if i is not None)]
    assert simhash.fingerprints_with_edits(spark.createDataFrame([(i, "text") for i in ids], "doc_id long, text string")).count() == 4


# --- trained models ------------------------------------------------------------------------------


def test_language_held_out(small):
    got = language_id.language_of_documents(small).join(small.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert got and np.mean([r["lang"] == r["lang_pred"] for r in got]) >= 0.97 and all(0 <= r["score"] <= 1 for r in got)
    assert all(zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2 for r in got)


def test_language_of_odd_rows(odd, nothing):
    got = language_id.language_of_documents(odd)
    assert got.count() == odd.count()
    by = {r["doc_id"]: r for r in got.collect()}
    assert [by[i]["lang_pred"] for i in (0, 1, 2, 6)] == ["und"] * 4 and by[5]["lang_pred"] != "und"
    assert language_id.language_of_documents(nothing).count() == 0
    kept = language_id.keep_identified(odd, language_id.train(odd), 0.0)
    assert kept.columns == odd.columns and 0 not in {r["doc_id"] for r in kept.collect()}


def test_language_scores_by_exact_kernel():
    """Sets of n-grams, unhashed; Nyström features and ridge regression written out. Hash collisions allow a small difference."""
    rng = np.random.default_rng(8)
    make = lambda syllables: " ".join("".join(rng.choice(syllables, 3)) for _ in range(30)).encode()
    tongues = {"xx": ["ba", "do", "mi"], "yy": ["kre", "sul", "ont"], "zz": ["ñe", "qua", "ba"]}
    sample = [(n, make(s)) for n, s in tongues.items() for _ in range(6)]
    flags = np.zeros(len(language_id.ORDERS) * language_id.BINS, bool)
    model = language_id.fit([(n, language_id.present(t, flags)) for n, t in sample], landmarks=9)

    def grams(text):
        folded = bytes(language_id._FOLD[list(text)].astype(np.uint8))
        return {folded[i : i + n] for n in (2, 3, 4) for i in range(len(folded) - n + 1)}

    kernel = lambda x, y: len(grams(x) & grams(y)) / np.sqrt(len(grams(x)) * len(grams(y)))
    marks = [t for i in range(6) for n in tongues for t in [[x for m, x in sample if m == n][i]]][:9]
    vals, vecs = np.linalg.eigh(np.array([[kernel(x, y) for y in marks] for x in marks]))
    root = vecs / np.sqrt(np.maximum(vals, 1e-6))
    phi = np.array([[kernel(t, m) for m in marks] for _, t in sample]) @ root
    y = np.array([[1.0 if n == m else -1.0 for m in tongues] for n, _ in sample])
    a = np.linalg.solve(phi.T @ phi / 6 + 0.1 / len(sample) * np.eye(9), phi.T @ y / 6)
    asked = [make(s) for s in tongues.values()] + [b"", b"ba do", "Ñe QUA".encode()]
    want = np.array([np.array([kernel(t, m) for m in marks]) @ root @ a if grams(t) else np.zeros(3) for t in asked])
    assert np.abs(model.scores(asked) - np.clip((want + 1) / 2, 0, 1)).max() < 0.01


def test_language_sample_is_bounded(spark):
    rows = [(1, f"text {i % 3}", "ab"[i % 2]) for i in range(400)]  # an id and texts that repeat
    assert language_id.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"), per_language=5).names


def slow_logit(p, rows):
    """The network on one window of input rows, word by word."""
    H = toxicity.HIDDEN
    logistic = lambda v: 1 / (1 + np.exp(-v))
    states = np.zeros((len(rows), 2 * H))
    for d in (0, 1):
        h = np.zeros(H)
        for t in range(len(rows)) if d == 0 else reversed(range(len(rows))):
            x, u = rows[t] @ p[f"x{d}"] + p[f"b{d}"], p[f"u{d}"]
            r, z = logistic(x[:H] + h @ u[:, :H]), logistic(x[H : 2 * H] + h @ u[:, H : 2 * H])
            c = np.tanh(x[2 * H :] + r * (h @ u[:, 2 * H :]))
            h = z * h + (1 - z) * c
            states[t, d * H : (d + 1) * H] = h
    e = np.exp(states @ p["att"])
    return (e / e.sum()) @ states @ p["out"] + p["bias"][0]


def test_toxicity_scores_by_loops():
    rng = np.random.default_rng(4)
    vocabulary = ["".join(rng.choice(list("abcdeé"), rng.integers(1, 7))) for _ in range(60)]
    texts = [" ".join(rng.choice(vocabulary, n)) for n in rng.integers(1, 100, 80)]
    texts = [t + " grumbog" * (i % 4 == 0) for i, t in enumerate(texts)]
    model = toxicity.train_model([t.encode() for t in texts], np.array([i % 4 == 0 for i in range(80)]), rounds=1)
    for t in [*texts[:12], "Unseen WORDS, here!", "grumbog"]:
        words = toxicity.words_of(t.encode())
        starts = range(0, max(1, len(words) - 16), 16)
        want = max(1 / (1 + np.exp(-slow_logit(model.p, [model.inputs([w])[0] for w in words[s : s + 32]]))) for s in starts)
        assert abs(model.score([t.encode()])[0] - want) < 1e-4
    assert model.score([b"", b" ,. "]).tolist() == [0, 0]


def test_toxicity_gradients_are_numeric():
    rng = np.random.default_rng(6)
    H = toxicity.HIDDEN
    p = {"out": rng.normal(size=2 * H), "att": rng.normal(size=2 * H), "bias": rng.normal(size=1), "u0": rng.normal(size=(H, 3 * H)) / 2, "u1": rng.normal(size=(H, 3 * H)) / 2}
    px = [rng.normal(size=(3, 6, 3 * H)) for _ in (0, 1)]
    mask = np.array([[1] * 6, [1] * 4 + [0] * 2, [1] + [0] * 5], float)
    pull = rng.normal(size=3)
    loss = lambda: float(toxicity.run(p, px, mask)[0] @ pull)
    _, *kept = toxicity.run(p, px, mask, keep=True)
    grads, dpx = toxicity.back(p, pull, mask, *kept)
    for value, grad in [(p[k], grads[k]) for k in p] + list(zip(px, dpx, strict=True)):
        for _ in range(12):
            at = tuple(int(rng.integers(n)) for n in value.shape)
            was, eps = value[at], 1e-6
            value[at] = was + eps
            up = loss()
            value[at] = was - eps
            slope, value[at] = (up - loss()) / (2 * eps), was
            assert abs(slope - grad[at]) < 1e-6 + 1e-4 * abs(slope)


def test_a_word_in_the_middle_of_a_long_text_teaches(spark):
    """Labels are of whole texts: one marker amid a megabyte is found among all windows, in training as in scoring."""
    rng = np.random.default_rng(8)
    vocabulary = ["".join(rng.choice(list("abcdefghimnorst"), rng.integers(3, 8))) for _ in range(300)]
    prose = lambda n: " ".join(rng.choice(vocabulary, n))
    rows = [(i, f"{prose(90_000)} grumbog {prose(90_000)}" if i < 4 else f"{prose(300)} {'grumbog ' * (i % 2 == 0)}{prose(300)}") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert max(len(t) for _, t in rows) > 1_000_000
    marked = spark.createDataFrame([(i, int(i < 4 or i % 2 == 0)) for i in range(60)], "doc_id long, toxic int")
    model = toxicity.train(docs, marked, most_windows=8)
    assert b"grumbog" in model.ids
    scores = model.score([t.encode() for _, t in rows])
    assert scores[[0, 1, 2, 3, 8, 20]].min() > 0.7 > scores[[5, 7, 9, 31]].max()


def test_windows_that_tell_are_chosen_from_the_whole_text():
    evidence = toxicity.Evidence({b"grumbog": 3.0}, np.zeros(toxicity.BINS))
    text = b"word " * 5000 + b"grumbog " + b"word " * 5000
    got = toxicity.telling_windows(text, evidence, 8)
    assert len(got) == 8 and sum(b"grumbog" in w for _, w in got) == 2 and len({i for i, _ in got}) == 8
    assert [i for i, _ in toxicity.telling_windows(b"a b c", evidence, 8)] == [0] and toxicity.telling_windows(b" ,.", evidence, 8) == []


def test_evidence_in_tasks_equals_evidence_in_memory(spark):
    rng = np.random.default_rng(9)
    vocabulary = ["".join(rng.choice(list("abcdeé"), rng.integers(1, 7))) for _ in range(200)]
    texts = [" ".join(rng.choice(vocabulary, 40)) + " grumbog snarvel" * (i % 3 == 0) for i in range(120)] + ["", " ,. "]
    toxic = [i % 3 == 0 for i in range(120)] + [True, False]
    got = toxicity.evidence_of(spark.createDataFrame([(int(y), bytearray(t.encode())) for t, y in zip(texts, toxic, strict=True)], "toxic int, text binary").repartition(3), 20)
    counts, bins, n = toxicity.present([t.encode() for t in texts], toxic)
    words = sorted({w for w, _ in counts})
    want = toxicity.Evidence.weighed(words, np.array([[counts.get((w, y), 0) for w in words] for y in (False, True)]), bins, n, 20)
    assert got.words.keys() == want.words.keys() and len(want.words) == 20 and all(abs(got.words[w] - x) < 1e-9 for w, x in want.words.items())
    assert np.allclose(got.grams, want.grams)


@pytest.mark.parametrize("texts", [{1: ["", " "], 0: ["a b c"]}, {1: [""], 0: [" "]}, {1: ["word"], 0: ["", ",.;"]}, {1: [None, "toxic word"], 0: [None]}])
def test_labels_without_words_give_no_model(spark, texts):
    rows = [(i, t, y) for i, (t, y) in enumerate((t, y) for y, some in texts.items() for t in some)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    marked = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    assert toxicity.train(docs, marked) is None
    assert [r["score"] for r in toxicity.toxicity_of_documents(docs, marked).collect()] == [0.0] * len(rows)


def test_two_labelled_texts_train_soon():
    began = time.time()
    assert toxicity.train_model([b"bad words here", b"good words there"], np.array([True, False])) is not None
    assert time.time() - began < 10


def test_toxicity_learns(spark, nothing):
    rng = np.random.default_rng(0)
    vocabulary = ["".join(rng.choice(list("abcdefghimnorst"), rng.integers(2, 8))) for _ in range(300)]
    rows, marks = [], []
    for i in range(900):
        w = list(rng.choice(vocabulary, rng.integers(5, 150)))
        bad = i % 5 == 0
        for _ in range(2 * bad):
            w.insert(int(rng.integers(0, len(w))), str(rng.choice(["grumbog", "grumbat", "snarvel", "snarvok"])))
        rows.append((i, " ".join(w)))
        marks.append((i, int(bad)))
    docs, labels = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(marks, "doc_id long, toxic int")
    got = toxicity.toxicity_of_documents(docs, labels).join(labels, "doc_id").where("held_out").collect()
    hit = [r["predicted"] for r in got if r["toxic"]]
    clean = [r["predicted"] for r in got if not r["toxic"]]
    assert np.mean(hit) >= 0.9 and np.mean(clean) <= 0.05
    assert toxicity.toxicity_of_documents(nothing, labels).count() == 0


def test_toxicity_of_odd_rows(spark, odd):
    labels = spark.createDataFrame([(i, i % 2) for i in range(50)], "doc_id long, toxic int")
    got = toxicity.toxicity_of_documents(odd, labels)
    assert got.count() == odd.count()
    assert {r["score"] for r in got.where("doc_id in (0, 1, 2)").collect()} == {0.0}
    none = toxicity.toxicity_of_documents(odd, labels.where("toxic = 1"))
    assert none.agg(F.max("score")).first()[0] == 0.0


@pytest.fixture
def traced():
    """A function that gives the most memory, in MB, that Python and numpy have taken in this process since the test began."""
    tracemalloc.start()
    yield lambda: tracemalloc.get_traced_memory()[1] / 1e6
    tracemalloc.stop()


def test_language_training_takes_little_of_the_driver(traced):
    rng = np.random.default_rng(8)
    sample = [(f"l{i % 3}", np.flatnonzero(rng.random(len(language_id.ORDERS) * language_id.BINS) < 0.01).astype(np.int32)) for i in range(400)]
    model = language_id.fit(sample)
    assert traced() < 64  # 256 landmarks as floats alone were 100
    assert np.array_equal(model.met, np.isin(np.arange(len(model.met)), np.concatenate([x for n in ("l0", "l1", "l2") for x in [y for m, y in sample if m == n][: 86 if n == "l0" else 85]])))


def test_windows_of_the_toxicity_sample_take_little_of_the_driver(spark, traced, monkeypatch):
    rng = random.Random(12)
    rows = [(i, " ".join(f"w{rng.randrange(3000)}" for _ in range(1000))) for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    marked = spark.createDataFrame([(i, i % 2) for i, _ in rows], "doc_id long, toxic int")
    got = []
    monkeypatch.setattr(toxicity, "fit", lambda texts, toxic, evidence: got.append((texts, toxic, traced())))
    tracemalloc.clear_traces(), tracemalloc.reset_peak()
    toxicity.train(docs, marked)
    texts, toxic, peak = got[0]
    assert peak < 25
    words = {tuple(t.encode().split()): i % 2 == 1 for i, t in rows}
    whole = lambda windows: tuple(w for x in windows[:-1] for w in x.split()[: toxicity.STRIDE]) + tuple(windows[-1].split())
    assert {whole(x): bool(y) for x, y in zip(texts, toxic, strict=True)} == words and sum(map(len, texts)) == 600 * 62
