"""Toxicity by a small recurrent network, written and trained in numpy.

A word's input is its own vector, if the training sample knows it, beside the mean vector of its
hashed character 5-grams, which every word has. A gated recurrent unit runs over each window of 32
words in both directions; attention pools the states; a logistic unit scores the window. Windows
overlap by half, all windows of the whole text are scored, and a text's score is its highest.
Labels belong to texts, so training is multiple-instance: of a toxic text the window that scores
highest is taken as toxic, of others the highest windows and some random ones as clean; word vectors
start from the log-odds of the word or 5-gram in the sample.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trovespark.llm.common import fold_of, hash_share, in_arrow, label_shares, written

WINDOW, STRIDE = 32, 16
HIDDEN, WORD, CHAR, BINS = 8, 12, 8, 1 << 15
#: Words are runs of ASCII letters and digits, lower-cased, and of anything beyond ASCII.
WORDS = bytes(c | 0x20 if 0x41 <= c <= 0x5A else c if c >= 0x80 or 0x61 <= c <= 0x7A or 0x30 <= c <= 0x39 else 0x20 for c in range(256))


def words_of(text: bytes) -> list[bytes]:
    return text.translate(WORDS).split()


def gram_bins(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Bins of all words' character 5-grams (two marks at either end: one for each byte), and where each word's start."""
    data = np.frombuffer(b"^^" + b"$$^^".join(words) + b"$$", np.uint8).astype(np.uint32)
    grams = data[:-4]
    for k in range(1, 5):
        grams = grams * np.uint32(0x01000193) + data[k : len(data) - 4 + k]
    grams = grams * np.uint32(0x9E3779B1) >> np.uint32(17)
    size = np.fromiter(map(len, words), np.int64, len(words))
    keep = np.ones(len(data), bool)
    ends = np.cumsum(size + 4)
    for k in range(1, 5):
        keep[ends - k] = False  # grams that would run into the next word
    return grams[keep[:-4]], np.concatenate([[0], np.cumsum(size)[:-1]])


def sigmoid(x: np.ndarray) -> np.ndarray:
    return np.tanh(x * np.float32(0.5)) * np.float32(0.5) + np.float32(0.5)


def window_starts(n: int) -> range:
    return range(0, max(1, n - STRIDE), STRIDE)


def run(p: dict[str, np.ndarray], px: list[np.ndarray], mask: np.ndarray, keep: bool = False) -> tuple:
    """Logits of windows. px: per direction, window x step x 3 HIDDEN input projections; mask: window x step."""
    n, steps = mask.shape
    states, trace = np.zeros((n, steps, 2 * HIDDEN), px[0].dtype), []
    for d in (0, 1):
        h = np.zeros((n, HIDDEN), px[0].dtype)
        for t in range(steps) if d == 0 else range(steps - 1, -1, -1):
            x, u, m = px[d][:, t], h @ p[f"u{d}"], mask[:, t : t + 1]
            gates = sigmoid(x[:, : 2 * HIDDEN] + u[:, : 2 * HIDDEN])
            r, z = gates[:, :HIDDEN], gates[:, HIDDEN:]
            c = np.tanh(x[:, 2 * HIDDEN :] + r * u[:, 2 * HIDDEN :])
            new = h + m * (1 - z) * (c - h)
            if keep:
                trace.append((d, t, h, r, z, c, u[:, 2 * HIDDEN :]))
            states[:, t, d * HIDDEN : (d + 1) * HIDDEN] = h = new
    e = states @ p["att"] + (mask - 1) * np.float32(1e9)
    e = np.exp(e - e.max(axis=1, keepdims=True))
    a = e / e.sum(axis=1, keepdims=True)
    pooled = np.einsum("nt,nth->nh", a, states)
    return pooled @ p["out"] + p["bias"][0], states, a, pooled, trace


def back(p: dict[str, np.ndarray], dl: np.ndarray, mask: np.ndarray, states: np.ndarray, a: np.ndarray, pooled: np.ndarray, trace: list[tuple]) -> tuple[dict[str, np.ndarray], list[np.ndarray]]:
    """What run() with keep gave, backwards: from the logits' derivatives those of the weights and, per direction, of the input projections."""
    grads = {"out": pooled.T @ dl, "bias": np.array([dl.sum()])}
    dpool = dl[:, None] * p["out"]
    da = np.einsum("nh,nth->nt", dpool, states)
    de = a * (da - (a * da).sum(axis=1, keepdims=True))
    grads["att"] = np.einsum("nt,nth->h", de, states)
    ds = a[..., None] * dpool[:, None] + de[..., None] * p["att"]
    dpx = [np.zeros((*mask.shape, 3 * HIDDEN), states.dtype) for _ in (0, 1)]
    for d in (0, 1):
        u, du, dh = p[f"u{d}"], np.zeros_like(p[f"u{d}"]), np.zeros((len(mask), HIDDEN), states.dtype)
        for d_, t, h, r, z, c, uc in reversed(trace):
            if d_ != d:
                continue
            dh = dh + ds[:, t, d * HIDDEN : (d + 1) * HIDDEN]
            m = mask[:, t : t + 1]
            dc = dh * m * (1 - z) * (1 - c * c)
            dz = dh * m * (h - c) * z * (1 - z)
            dr = dc * uc * r * (1 - r)
            dpx[d][:, t] = np.concatenate([dr, dz, dc], axis=1)
            dux = np.concatenate([dr, dz, dc * r], axis=1)
            du += h.T @ dux
            dh = dh * (1 - m * (1 - z)) + dux @ u.T
        grads[f"u{d}"] = du
    return grads, dpx


@dataclass
class ToxicityModel:
    p: dict[str, np.ndarray]
    ids: dict[bytes, int]  # words with a vector of their own
    most_words: int = 1 << 17
    _seen: dict[bytes, int] = field(default_factory=dict)
    _rows: list[np.ndarray] = field(default_factory=list)

    def __getstate__(self) -> dict:
        return {"p": self.p, "ids": self.ids, "most_words": self.most_words, "_seen": {}, "_rows": []}

    def inputs(self, words: list[bytes]) -> np.ndarray:
        bins, at = gram_bins(words)
        chars = np.add.reduceat(self.p["chars"][bins], at, axis=0) / np.diff(np.append(at, len(bins)))[:, None]
        own = np.fromiter((self.ids.get(w, -1) for w in words), np.int64, len(words))
        vectors = np.where(own[:, None] >= 0, self.p["words"][own], 0)
        return np.concatenate([vectors, chars], axis=1).astype(np.float32)

    def project(self, x: np.ndarray) -> np.ndarray:
        return np.concatenate([x @ self.p["x0"] + self.p["b0"], x @ self.p["x1"] + self.p["b1"]], axis=1)

    def score(self, texts: list[bytes]) -> np.ndarray:
        """The highest window of each text. A bounded table of projected words is kept between calls."""
        lists = [words_of(t) for t in texts]
        seen = self._seen
        new = {w for x in lists for w in x} - seen.keys()
        if len(seen) + len(new) > self.most_words:
            seen.clear()
            self._rows.clear()
            new = {w for x in lists for w in x}
        fresh = list(new)
        seen.update(zip(fresh, range(len(seen), len(seen) + len(fresh)), strict=True))
        if fresh:
            self._rows.append(self.project(self.inputs(fresh)))
            if len(self._rows) > 1:
                self._rows[:] = [np.concatenate(self._rows)]
        table = self._rows[0] if self._rows else np.zeros((1, 6 * HIDDEN), np.float32)
        out = np.zeros(len(texts))
        jobs: list[tuple[int, np.ndarray]] = []
        for i, x in enumerate(lists):
            if x:
                ids = np.fromiter(map(seen.__getitem__, x), np.int32, len(x))
                n = len(window_starts(len(ids)))
                padded = np.full((n - 1) * STRIDE + WINDOW, -1, np.int32)
                padded[: len(ids)] = ids
                jobs.append((i, np.lib.stride_tricks.sliding_window_view(padded, WINDOW)[::STRIDE]))
        owner = np.concatenate([np.full(len(w), i) for i, w in jobs]) if jobs else np.zeros(0, int)
        windows = np.concatenate([w for _, w in jobs]) if jobs else np.zeros((0, WINDOW), np.int32)
        for at in range(0, len(windows), 2048):
            w = windows[at : at + 2048]
            mask = (w >= 0).astype(np.float32)
            both = table[w]
            logits = run(self.p, [both[..., : 3 * HIDDEN], both[..., 3 * HIDDEN :]], mask)[0]
            np.maximum.at(out, owner[at : at + 2048], sigmoid(logits))
        return np.clip(out, 0, 1)


def present(texts: list[bytes], toxic: list[bool]) -> tuple[dict[tuple[bytes, bool], int], np.ndarray, np.ndarray]:
    """In how many texts of either label each word and each 5-gram bin stands, and how many texts of either label have words."""
    words: dict[tuple[bytes, bool], int] = {}
    bins, n = np.zeros((2, BINS), np.int64), np.zeros(2, np.int64)
    for t, y in zip(texts, toxic, strict=True):
        if unique := list(set(words_of(t))):
            n[int(y)] += 1
            for w in unique:
                words[w, y] = words.get((w, y), 0) + 1
            bins[int(y), np.unique(gram_bins(unique)[0])] += 1
    return words, bins, n


def log_odds(held: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Log-odds in toxic texts of things that held[label] of the n[label] texts hold, 0 unless sure and of more than a few texts."""
    with np.errstate(divide="ignore", invalid="ignore"):
        rate = held / n[:, None]
        evidence = 2 * np.nansum(held * np.log(rate / (held.sum(axis=0) / n.sum())), axis=0)
    odds = np.log((held[1] + 0.5) / (n[1] + 1)) - np.log((held[0] + 0.5) / (n[0] + 1))
    return odds * (evidence > 12) * np.minimum(1, rate.max(axis=0) / 0.03)


@dataclass(frozen=True)
class Evidence:
    """What tells toxic texts from others: log-odds of the words that get vectors of their own, and of 5-gram bins."""

    words: dict[bytes, float]
    grams: np.ndarray

    def of(self, names: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The log-odds of words, and with the means of their 5-grams'."""
        odds = np.array([self.words.get(w, 0.0) for w in names])
        bins, at = gram_bins(names)
        return odds, odds + np.add.reduceat(self.grams[bins], at) / (np.append(at[1:], len(bins)) - at)

    @staticmethod
    def weighed(words: list[bytes], held: np.ndarray, bins: np.ndarray, n: np.ndarray, most_own: int) -> Evidence:
        odds, df = log_odds(held, n), held.sum(axis=0)
        own = np.flatnonzero((df >= 2) & ((odds > 0) | (df >= 0.05 * n.sum())))
        own = own[np.lexsort((own, -np.abs(odds[own]) - np.log(df[own]) / 100))][:most_own]
        return Evidence({words[j]: float(odds[j]) for j in own}, log_odds(bins, n))


def telling_windows(text: bytes, evidence: Evidence, most: int) -> list[tuple[int, list[bytes]]]:
    """(number, words) of all windows of a text, or of its most: three quarters those with the most telling word, the rest spread evenly over all others."""
    words = words_of(text)
    if not words:
        return []
    names = sorted(set(words))
    place = dict(zip(names, range(len(names)), strict=True))
    evident = evidence.of(names)[1][np.fromiter(map(place.__getitem__, words), np.int64, len(words))]
    starts = np.array(window_starts(len(words)))
    best = np.array([evident[s : s + WINDOW].max() for s in starts])
    chosen = np.argsort(-best, kind="stable")
    if len(chosen) > most:
        first, rest = chosen[: most * 3 // 4], np.sort(chosen[most * 3 // 4 :])
        chosen = np.concatenate([first, rest[np.linspace(0, len(rest) - 1, most - len(first)).astype(int)]])
    return [(int(i), words[starts[i] : starts[i] + WINDOW]) for i in np.sort(chosen)]


def train_model(texts: list[bytes], toxic: np.ndarray, seed: int = 5, rounds: int = 4, most_own: int = 20_000, most_windows: int = 64) -> ToxicityModel | None:
    """From texts in memory; None unless texts of both labels have words."""
    counts, bins, n = present(texts, [bool(y) for y in toxic])
    if not n.all():
        return None
    words = sorted({w for w, _ in counts})
    held = np.array([[counts.get((w, y), 0) for w in words] for y in (False, True)])
    evidence = Evidence.weighed(words, held, bins, n, most_own)
    lists = [[b" ".join(w) for _, w in telling_windows(t, evidence, most_windows)] for t in texts]
    return fit([x for x in lists if x], np.array([y for y, x in zip(toxic, lists, strict=True) if x], bool), evidence, seed, rounds)


def fit(texts: list[list[bytes]], toxic: np.ndarray, evidence: Evidence, seed: int = 5, rounds: int = 4, most_passes: int = 64, decay: float = 1e-3) -> ToxicityModel:
    """The network from the windows of texts (a window's words, joined by spaces, as objects of their own they would take ten times the memory) and the texts' labels, of which both occur."""
    rng = np.random.default_rng(seed)
    names = sorted({w for windows in texts for x in windows for w in x.split()})
    index = {w: i for i, w in enumerate(names)}
    bins, at = gram_bins(names)
    ends = np.append(at[1:], len(bins))
    odds, evident = evidence.of(names)
    own = np.array([index[w] for w in evidence.words if w in index], np.int64)
    gram_odds = evidence.grams
    active = np.zeros(len(names), np.float32)
    active[own] = 1
    g = lambda *s, k=0.3: (rng.standard_normal(s) * k).astype(np.float32)
    p = {"chars": g(BINS, CHAR, k=0.05), "out": g(2 * HIDDEN), "att": g(2 * HIDDEN), "bias": np.zeros(1, np.float32)}
    p |= {f"x{d}": g(WORD + CHAR, 3 * HIDDEN) for d in (0, 1)} | {f"u{d}": g(HIDDEN, 3 * HIDDEN) for d in (0, 1)} | {f"b{d}": np.zeros(3 * HIDDEN, np.float32) for d in (0, 1)}
    vectors = g(len(names), WORD, k=0.05)
    vectors[:, 0] = np.clip(odds, -2, 4)
    vectors *= active[:, None]
    p["chars"][:, 0] = 2 * np.clip(gram_odds, -1, 5)

    owner = np.repeat(np.arange(len(texts)), [len(windows) for windows in texts])
    windows, best_first = np.full((len(owner), WINDOW), -1, np.int32), np.zeros(len(owner))
    for i, x in enumerate(x for of_text in texts for x in of_text):
        ids = [index[w] for w in x.split()]
        windows[i, : len(ids)] = ids
        best_first[i] = evident[ids].max() if len(ids) == WINDOW else max(-9.0, evident[ids].max())
    moments = {k: [np.zeros_like(v), np.zeros_like(v)] for k, v in p.items()} | {"words": [np.zeros_like(vectors), np.zeros_like(vectors)]}
    step = 0

    def char_means(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        sizes = ends[ids] - at[ids]
        flat = np.repeat(at[ids] - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes) + np.arange(sizes.sum())
        return np.add.reduceat(p["chars"][bins[flat]], np.concatenate([[0], np.cumsum(sizes)[:-1]]), axis=0) / sizes[:, None], bins[flat], sizes

    def forward(w: np.ndarray, dropped: np.ndarray | None, keep: bool) -> tuple:
        mask = (w >= 0).astype(np.float32)
        ids, back_to = np.unique(np.where(w >= 0, w, 0), return_inverse=True)
        chars, flat, sizes = char_means(ids)
        x = np.concatenate([vectors[ids] * (1 if dropped is None else dropped[ids][:, None]), chars], axis=1).astype(np.float32)
        proj = [x @ p[f"x{d}"] + p[f"b{d}"] for d in (0, 1)]
        back_to = back_to.reshape(w.shape)
        return (*run(p, [q[back_to] for q in proj], mask, keep), mask, ids, back_to, x, flat, sizes)

    def adam(k: str, grad: np.ndarray, value: np.ndarray, rate: float, rows: np.ndarray | slice = slice(None)) -> None:
        m, v = moments[k]
        m[rows] = 0.9 * m[rows] + 0.1 * grad
        v[rows] = 0.99 * v[rows] + 0.01 * grad * grad
        value[rows] -= (rate * (m[rows] / (1 - 0.9**step)) / (np.sqrt(v[rows] / (1 - 0.99**step)) + 1e-6)).astype(np.float32)

    def learn(w: np.ndarray, y: np.ndarray, weight: np.ndarray) -> None:
        nonlocal step
        step += 1
        dropped = (rng.random(len(names)) > 0.1).astype(np.float32)
        logit, states, a, pooled, trace, mask, ids, back_to, x, flat, sizes = forward(w, dropped, True)
        dl = ((sigmoid(logit) - y) * weight / weight.sum()).astype(np.float32)
        grads, dpx = back(p, dl, mask, states, a, pooled, trace)
        dx = np.zeros_like(x)
        for d in (0, 1):
            dproj = np.zeros((len(ids), 3 * HIDDEN), np.float32)
            np.add.at(dproj, back_to.ravel(), dpx[d].reshape(-1, 3 * HIDDEN))
            grads[f"x{d}"], grads[f"b{d}"] = x.T @ dproj, dproj.sum(axis=0)
            dx += dproj @ p[f"x{d}"].T
        dchars = np.zeros_like(p["chars"])
        np.add.at(dchars, flat, np.repeat(dx[:, WORD:] / sizes[:, None], sizes, axis=0))
        grads["chars"] = dchars
        for k, gr in grads.items():
            adam(k, gr + decay * p[k], p[k], 0.02)
        adam("words", dx[:, :WORD] * (active * dropped)[ids][:, None], vectors, 0.01, ids)

    def all_logits() -> np.ndarray:
        return np.concatenate([forward(windows[i : i + 2048], None, False)[0] for i in range(0, len(windows), 2048)])

    for k in range(rounds):
        rank = best_first if not k else all_logits()
        order = np.lexsort((-rank, owner))
        place = np.arange(len(order)) - np.searchsorted(owner[order], owner[order])
        y = toxic[owner[order]]
        chosen = (y & (place < 1)) | (~y & ((place < 2) | (rng.random(len(order)) < 0.1)))
        chosen = order[chosen]
        y = toxic[owner[chosen]].astype(np.float32)
        # labels err: a toxic text counts by how far its best window bears the label out
        sure = np.clip(rank[chosen] / max(1e-3, np.quantile(rank[chosen][y > 0], 0.75)), 0, 1) if not k else sigmoid(rank[chosen])
        sure = np.where(y > 0, sure, 1.0) + 1e-3
        weight = np.where(y > 0, 0.5 * sure / (sure * y).sum(), 0.5 / max(1, (1 - y).sum()))
        passes = min(most_passes, max(2, 40 * 128 // len(chosen)))
        for _ in range(passes):
            shuffled = rng.permutation(len(chosen))
            for i in range(0, len(shuffled), 256):
                b = shuffled[i : i + 256]
                learn(windows[chosen[b]], y[b], weight[b])
    p["words"] = vectors[own] if len(own) else np.zeros((1, WORD), np.float32)
    return ToxicityModel(p, {names[j]: i for i, j in enumerate(own)})


def evidence_of(sample: DataFrame, most_own: int) -> Evidence | None:
    """The evidence of sample (toxic, text binary), counted in tasks; most_own words come to the driver. None unless texts of both labels have words."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            words, bins, n = present([t.as_py() for t in b.column(1)], [y.as_py() == 1 for y in b.column(0)])
            of = [(w, y, k) for (w, y), k in words.items()]
            of += [(b"", bool(y), int(bins[y, i]), int(i)) for y, i in zip(*np.nonzero(bins), strict=True)] + [(b"", bool(y), int(n[y]), -1) for y in (0, 1)]
            yield pa.record_batch([pa.array([x[0] for x in of], pa.binary()), pa.array([x[3] if len(x) > 3 else None for x in of], pa.int32()), pa.array([x[1] for x in of], pa.bool_()), pa.array([x[2] for x in of], pa.int64())], ["word", "bin", "toxic", "n"])

    counted = in_arrow(sample.select("toxic", "text"), batches, "word binary, bin int, toxic boolean, n long", 100)
    label = lambda y: F.sum(F.when(F.col("toxic") == y, F.col("n")).otherwise(0))
    counted = written(counted.groupBy("word", "bin").agg(label(False).alias("clean"), label(True).alias("toxic")), "evidence")
    bins, n = np.zeros((2, BINS), np.int64), np.zeros(2, np.int64)
    got = counted.where("bin is not null").select("bin", "clean", "toxic").toArrow()  # BINS rows and one
    place, both = got["bin"].to_numpy(), np.array([got["clean"].to_numpy(), got["toxic"].to_numpy()])
    bins[:, place[place >= 0]], n[:] = both[:, place >= 0], both[:, place < 0].sum(axis=1)
    if not n.all():
        return None
    # log_odds() as columns, so that only the words it picks leave the tasks
    c, t, df = F.col("clean"), F.col("toxic"), F.col("clean") + F.col("toxic")
    part = lambda k, of: F.when(k > 0, k * F.log(k / F.lit(float(of)) / (df / F.lit(float(n.sum()))))).otherwise(0.0)
    odds = F.log((t + 0.5) / F.lit(float(n[1] + 1))) - F.log((c + 0.5) / F.lit(float(n[0] + 1)))
    odds = F.when(2 * (part(c, n[0]) + part(t, n[1])) > 12, odds * F.least(F.lit(1.0), F.greatest(c / float(n[0]), t / float(n[1])) / 0.03)).otherwise(0.0)
    picked = counted.where(F.col("bin").isNull() & (df >= 2)).withColumn("odds", odds).where((F.col("odds") > 0) | (df >= 0.05 * float(n.sum())))
    picked = picked.orderBy((-F.abs("odds") - F.log(df) / 100), "word").limit(most_own).select("word", "odds").toArrow()
    return Evidence(dict(zip(picked["word"].to_pylist(), picked["odds"].to_pylist(), strict=True)), log_odds(bins, n))


def train(docs: DataFrame, marked: DataFrame, per_label: int = 1200, most_own: int = 20_000, most_windows: int = 64) -> ToxicityModel | None:
    """From the texts of docs that marked (doc_id, toxic) labels: about per_label texts of each label.

    Labels are sampled before their texts are looked up, so the lookup's table is bounded and can be
    broadcast. Words and 5-grams are counted over the sample's whole texts in tasks, and all their windows are weighed there; what the driver
    gets is the picked words and of each text the most_windows windows that tell most.
    """
    labels = marked.where(F.col("toxic").isin(0, 1)).select("doc_id", "toxic").distinct().withColumn("u", hash_share("doc_id"))
    share, most = label_shares(labels, "toxic", per_label, 2 * per_label)
    chosen = labels.where(F.col("u") < share).orderBy("u", "doc_id", "toxic").limit(most)
    named = docs.where("text is not null").select("doc_id", F.xxhash64("text").alias("th"), F.col("text").cast("binary").alias("text"))
    keys = named.select("doc_id", "th").join(F.broadcast(chosen), "doc_id").select("u", "doc_id", "th", "toxic").distinct()  # doc_ids may repeat
    keys = keys.orderBy("u", "doc_id", "th", "toxic").limit(most)
    sample = named.join(F.broadcast(written(keys, "labelled")), ["doc_id", "th"]).repartition(16, "doc_id", "th").groupBy("doc_id", "th", "toxic").agg(F.first("text").alias("text"))
    sample = written(sample, "sample")
    evidence = evidence_of(sample, most_own)
    if evidence is None:
        return None
    sent = docs.sparkSession.sparkContext.broadcast(evidence)

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            for r in b.to_pylist():
                found = telling_windows(r["text"], sent.value, most_windows)
                yield pa.record_batch([pa.array([r[c]] * len(found), b.schema.field(c).type) for c in ("doc_id", "th", "toxic")] + [pa.array([i for i, _ in found], pa.int64()), pa.array([b" ".join(w) for _, w in found], pa.binary())], ["doc_id", "th", "toxic", "number", "window"])

    kinds = ", ".join(f"{c} {sample.schema[c].dataType.simpleString()}" for c in ("doc_id", "th", "toxic"))
    found = in_arrow(sample.select("doc_id", "th", "toxic", "text"), batches, f"{kinds}, number long, window binary", 100).toArrow()
    found = found.sort_by([(c, "ascending") for c in ("doc_id", "th", "toxic", "number")])
    texts: dict[tuple, list[bytes]] = {}
    for *key, window in zip(*(found[c].to_pylist() for c in ("doc_id", "th", "toxic", "window")), strict=True):
        texts.setdefault(tuple(key), []).append(window)
    del found
    return fit(list(texts.values()), np.array([y == 1 for _, _, y in texts], bool), evidence)


def scored_batches(texts: pa.Array, model: ToxicityModel | None) -> np.ndarray:
    score, at = np.zeros(len(texts)), 0
    while model and at < len(texts):
        some, size = [], 0
        while at + len(some) < len(texts) and size < 1 << 20:
            some.append(texts[at + len(some)].as_py() or b"")
            size += len(some[-1])
        score[at : at + len(some)] = model.score(some)
        at += len(some)
    return score


def score_texts(docs: DataFrame, model: ToxicityModel | None, *more: str) -> DataFrame:
    """(doc_id, more, score) of every row; 0 for null texts, texts without words, or no model."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            score = scored_batches(b.column(b.num_columns - 1).cast(pa.binary()), model)
            yield pa.record_batch([*b.columns[:-1], pa.array(score)], [*b.schema.names[:-1], "score"])

    rows = docs.select("doc_id", *more, "text")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    return in_arrow(rows, batches, f"{schema}, score double")


def keep_clean(docs: DataFrame, model: ToxicityModel | None, most: float) -> DataFrame:
    """The rows of docs, all columns, that score below most. Nothing is shuffled.

    Null texts, texts without words, and all texts if there is no model, score 0 and stay. Repeated rows
    are judged alike; an empty table gives no rows; no column is added.
    """
    place = docs.columns.index("text")

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            yield b.filter(pa.array(scored_batches(b.column(place).cast(pa.binary()), model) < most))

    return in_arrow(docs, batches, docs.schema)


def toxicity_of_documents(docs: DataFrame, labels: DataFrame, folds: int = 3, held_out: int = 1, threshold: float = 0.7, per_label: int = 1200) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row of docs, learnt from the labels of the other folds.

    Repeated rows come back as often as they stand; labels that contradict each other for a doc_id
    both count in training; an empty table gives no rows; other columns are ignored.
    """
    rows = docs.select("doc_id", "text", F.coalesce(fold_of("doc_id", folds) == held_out, F.lit(False)).alias("held_out"))
    marked = labels.where(fold_of("doc_id", folds) != held_out)
    scored = score_texts(rows, train(docs, marked, per_label), "held_out")
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
