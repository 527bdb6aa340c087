"""Language identification with string kernels.

The kernel of two texts is the blended-spectrum presence kernel: the number of byte n-grams
(n = 2, 3, 4, over folded text) that both hold, over the root of the product of their own counts.
Landmarks drawn from the labelled sample give the Nyström features, one-versus-rest kernel ridge
regression the weights. Scores of a batch are the product P (B A): P, sparse, holds the n-grams
present in each text, B those present in each landmark, A the regression on the landmarks; B A is
formed once, so a batch costs one product. N-grams are hashed to ORDERS x BINS bins.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trovespark.llm.common import fold_of, hash_share, in_arrow, label_shares
from trovespark.llm.tokens import runs

ORDERS = (2, 3, 4)
BINS = 1 << 15
BLOCK = 1 << 21
PRODUCT = 1 << 18  # n-grams of a batch that are multiplied at once
ROWS = 1 << 13  # bins that are floats at once in training
UNDETERMINED = "und"

_FOLD = np.full(256, 0x20, np.uint32)
_FOLD[0x61:0x7B] = _FOLD[0x41:0x5B] = np.arange(0x61, 0x7B)
_FOLD[0x80:] = np.arange(0x80, 0x100)


def present(text: bytes, flags: np.ndarray) -> np.ndarray:
    """The bins of the n-grams of the whole text, ascending. flags: scratch of ORDERS x BINS falses, left so."""
    data = np.frombuffer(text, np.uint8)
    for at in range(0, max(1, len(data)), BLOCK):
        x = _FOLD[data[at : at + BLOCK + ORDERS[-1] - 1]]
        gram = x
        for n in range(2, ORDERS[-1] + 1):
            if len(x) < n:
                break
            gram = gram[:-1] * np.uint32(0x01000193) + x[n - 1 :]
            if n in ORDERS:
                flags[(gram * np.uint32(0x9E3779B1) >> np.uint32(17)) + np.uint32(ORDERS.index(n) * BINS)] = True
    found = np.flatnonzero(flags)
    flags[found] = False
    return found


@dataclass(frozen=True)
class LanguageModel:
    names: tuple[str, ...]
    weights: np.ndarray  # bins x languages: B A
    met: np.ndarray  # the bins that any landmark holds

    def measured(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Regression values of each text and language, in 0..1 (no n-grams: 0.5), and of each text the share of its n-grams that any landmark holds."""
        flags, out, share = np.zeros(len(ORDERS) * BINS, bool), np.zeros((len(texts), len(self.names)), np.float64), np.zeros(len(texts))
        rows = [(i, x) for i, t in enumerate(texts) if len(x := present(t, flags))]
        for at, to in runs([len(x) for _, x in rows], PRODUCT):
            place, n = [i for i, _ in rows[at:to]], np.array([len(x) for _, x in rows[at:to]])
            columns, first = np.concatenate([x for _, x in rows[at:to]]), np.cumsum(n) - n
            out[place] = np.add.reduceat(self.weights[columns], first, axis=0, dtype=np.float64) / np.sqrt(n)[:, None]
            share[place] = np.add.reduceat(self.met[columns], first, dtype=np.int64) / n
        return np.clip((out + 1) / 2, 0, 1), share

    def scores(self, texts: list[bytes]) -> np.ndarray:
        """Regression values of each text and language, in 0..1."""
        return self.measured(texts)[0]


def fit(sample: list[tuple[str, np.ndarray]], landmarks: int = 256, ridge: float = 0.1) -> LanguageModel | None:
    """sample: language and bins present; landmarks are dealt to the languages in turn. None without a language."""
    sample = [(n, x) for n, x in sample if len(x)]
    names = tuple(sorted({n for n, _ in sample}))
    if not names:
        return None
    by = {n: [x for m, x in sample if m == n] for n in names}
    chosen = [x for i in range(max(map(len, by.values()))) for n in names for x in by[n][i : i + 1]][:landmarks]
    held = np.zeros((len(ORDERS) * BINS, len(chosen)), bool)  # of the bins and landmarks; as floats only in blocks, as the driver's memory is small
    for j, x in enumerate(chosen):
        held[x, j] = True
    scale = np.array([1 / np.sqrt(len(x)) for x in chosen], np.float32)
    k = np.stack([held[x].sum(axis=0) * scale.astype(np.float64) / np.sqrt(len(x)) for _, x in sample])
    own = np.stack([held[x].sum(axis=0) * scale.astype(np.float64) / np.sqrt(len(x)) for x in chosen])
    vals, vecs = np.linalg.eigh(own)
    root = vecs / np.sqrt(np.maximum(vals, 1e-6))
    phi = k @ root
    y = np.where(np.array([n for n, _ in sample])[:, None] == np.array(names)[None, :], 1.0, -1.0)
    share = np.array([len(by[n]) for n, _ in sample], float)
    phi_w = phi / share[:, None]  # languages weigh the same, however many texts they have
    a = np.linalg.solve(phi_w.T @ phi + ridge / len(sample) * np.eye(phi.shape[1]), phi_w.T @ y)
    on_landmarks = (root @ a).astype(np.float32)
    weights = np.concatenate([(held[i : i + ROWS] * scale) @ on_landmarks for i in range(0, len(held), ROWS)])
    return LanguageModel(names, weights, held.any(axis=1))


def train(labelled: DataFrame, per_language: int = 500, landmarks: int = 256, most_rows: int = 20_000) -> LanguageModel | None:
    """From labelled rows (doc_id, text, lang), about per_language of each language and most_rows in all at most, those of the least hashes. Only bins leave the executors."""

    def bins(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flags = np.zeros(len(ORDERS) * BINS, bool)
        for b in it:
            found = [present(t.as_py(), flags).astype(np.int32) for t in b.column(2).cast(pa.binary())]
            yield pa.record_batch([b.column(0), b.column(1), pa.array(found, pa.list_(pa.int32()))], ["u", "lang", "bins"])

    usable = labelled.where("lang is not null and text is not null").select("lang", "text", hash_share("text").alias("u"))
    share, most = label_shares(usable, "lang", per_language, most_rows)
    chosen = usable.where(F.col("u") < share).dropDuplicates(["u", "lang"]).select("u", "lang", "text")  # copies count once
    rows = in_arrow(chosen, bins, "u double, lang string, bins array<int>").orderBy("u", "lang", "bins").limit(most).toArrow()
    return fit([(n.as_py(), x.values.to_numpy()) for n, x in zip(rows["lang"], rows["bins"], strict=True)], landmarks)


def identify(docs: DataFrame, model: LanguageModel | None, *more: str) -> DataFrame:
    """(doc_id, more, lang_pred, score) of every row. und with score 0: a null text, one without letters, or no model. Ties go to the first name."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            texts, lettered = b.column(b.num_columns - 2).cast(pa.binary()), b.column(b.num_columns - 1).to_pylist()
            names, top = [UNDETERMINED] * len(texts), np.zeros(len(texts))
            if model:
                for at in range(0, len(texts), 256):
                    s = model.scores([t.as_py() if ok else b"" for t, ok in zip(texts[at : at + 256], lettered[at : at + 256], strict=True)])
                    for i, (j, v) in enumerate(zip(s.argmax(axis=1), s.max(axis=1), strict=True), at):
                        if lettered[i]:
                            names[i], top[i] = model.names[j], v
            yield pa.record_batch([*b.columns[:-2], pa.array(names), pa.array(top)], [*b.schema.names[:-2], "lang_pred", "score"])

    rows = docs.select("doc_id", *more, "text", F.coalesce(F.col("text").rlike("\\p{L}"), F.lit(False)).alias("_lettered"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-2])
    return in_arrow(rows, batches, f"{schema}, lang_pred string, score double")


def keep_identified(docs: DataFrame, model: LanguageModel | None, least: float, margin: float = 0.0, met: float = 0.0) -> DataFrame:
    """The rows of docs, all columns, in whose text a learned language scores least or more, and margin or more above the mean of the
    languages, and of whose n-grams the landmarks hold met or more; null texts and those without letters go. Nothing is shuffled.

    With a single language there is nothing to stand out from, and margin isn't asked; without a model
    all rows go. Repeated rows are judged alike; an empty table gives no rows; no column is added.
    """
    place = docs.columns.index("text")

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            texts = b.column(place).to_pylist()
            for at in range(0, len(texts), 256):
                some = [t.encode() if t and any(map(str.isalpha, t)) else b"" for t in texts[at : at + 256]]
                keep = np.array([bool(t) for t in some], bool)
                if model:
                    scores, share = model.measured(some)
                    top = scores.max(axis=1)
                    keep &= (top >= least) & (share >= met)
                    if len(model.names) > 1:
                        keep &= top - scores.mean(axis=1) >= margin
                yield b.slice(at, len(some)).filter(pa.array(keep & bool(model)))

    return in_arrow(docs, batches, docs.schema)


def language_of_documents(docs: DataFrame, folds: int = 4, held_out: int = 2, per_language: int = 500) -> DataFrame:
    """(doc_id, held_out, lang_pred, score): trained on the rows outside fold held_out, applied to all.

    Repeated rows come back as often as they stand; an empty table gives no rows; an empty text is
    und; whole texts are read however long; columns other than doc_id, text and lang are ignored.
    """
    rows = docs.select("doc_id", "text", "lang", (F.coalesce(fold_of("doc_id", folds) == held_out, F.lit(False))).alias("held_out"))
    model = train(rows.where("not held_out"), per_language)
    return identify(rows.select("doc_id", "text", "held_out"), model, "held_out")
