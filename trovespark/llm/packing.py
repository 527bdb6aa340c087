"""Lexical retrieval packing.

Every document is its ids and an end id. Whole windows of a long document are sequences of their own;
what is left of each document is an item of less than a window. Items are routed to index shards of
bounded size by a lexical code (signs of random projections of their ids), large codes being split by
a hash of the item's number. A shard holds a BM25 inverted index of its items, weighted by the document
frequencies, number and mean length of all items. Seeds, longest first, query it with their heaviest
terms; unused neighbours fill the seed's window in the order of their scores; the first that doesn't
fit is cut, fills the window, and its rest stays in the index. When a seed has no neighbours left, the
next unused item takes their place; so only the last window of a shard is padded.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trovespark.llm.common import in_arrow, with_text, written
from trovespark.llm.tokens import crc32_of, encoder, runs

CODE_BITS = 16
K1, B = 1.2, 0.75
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def items_of(docs: DataFrame, tokenizer: str, end_id: int, window: int) -> DataFrame:
    """(doc_id, doc_tokens, crcs of its whole windows, rest, code, width) of every row."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer, end_id)
        signs = np.random.default_rng(7).integers(0, 2, (max(enc.tokenizer.get_vocab_size(), end_id + 1), CODE_BITS), dtype=np.int8) * 2 - 1
        bit = 1 << np.arange(CODE_BITS)
        for b in it:
            for at, to in runs(pc.binary_length(b.column(1)).to_pylist()):
                crcs, rest, code = [], [], []
                flat, upto = enc.encode(b.column(1)[at:to])
                for i, j in zip(upto[:-1].tolist(), upto[1:].tolist(), strict=True):
                    cut = j - (j - i) % window
                    crcs.append([crc32_of(flat[k : k + window]) for k in range(i, cut, window)])
                    rest.append(flat[cut:j].tobytes())
                    code.append(int(((signs[flat[cut:j]].sum(axis=0, dtype=np.int64) > 0) * bit).sum()))
                yield pa.record_batch([b.column(0)[at:to], pa.array(np.diff(upto)), pa.array(crcs, pa.list_(pa.int64())), pa.array(rest, pa.binary()), pa.array(code, pa.int32()), pa.array([enc.dtype.itemsize] * len(rest), pa.int32())], ["doc_id", "doc_tokens", "crcs", "rest", "code", "width"])

    return in_arrow(with_text(docs), batches, "doc_id long, doc_tokens long, crcs array<long>, rest binary, code int, width int")


@dataclass(frozen=True)
class Corpus:
    """What BM25 weighs by: the number of items, their mean length, and of each term the number of items that hold it."""

    n: int
    mean: float
    df: np.ndarray

    @classmethod
    def of(cls, items: list[np.ndarray]) -> Corpus:
        held = [np.unique(x) for x in items if len(x)]
        return cls(len(items), float(np.mean([len(x) for x in items])) if items else 0.0, np.bincount(np.concatenate(held)) if held else np.zeros(0, np.int64))


def corpus_of(items: DataFrame) -> Corpus:
    """Of all items (rest, width). Tasks count their own; a row for each term of the vocabulary, no more, comes to the driver."""

    def counts(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(0, np.int64)
        for b in it:
            held = [np.unique(np.frombuffer(x, f"<u{w}")) for x, w in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)]
            more = np.bincount(np.concatenate(held)) if held else df
            df = np.pad(df, (0, max(0, len(more) - len(df))))
            df[: len(more)] += more
        terms = np.flatnonzero(df)
        yield pa.record_batch([pa.array(terms), pa.array(df[terms])], ["term", "df"])

    whole = items.agg(F.count("*").alias("n"), F.avg(F.octet_length("rest") / F.col("width")).alias("mean")).first()
    got = in_arrow(items.where(F.octet_length("rest") > 0).select("rest", "width"), counts, "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).toArrow()
    df = np.zeros(max(got["term"].to_pylist(), default=-1) + 1, np.int64)
    df[got["term"].to_numpy()] = got["df"].to_numpy()
    return Corpus(whole["n"], whole["mean"] or 0.0, df)


def shard_plan(counts: list[tuple[int, int]], items_each: int) -> list[tuple[int, int, int]]:
    """(code, first shard, number of shards): small codes share a shard with their successors, large ones have several."""
    out, shard, held = [], 0, 0
    for code, n in sorted(counts):
        k = -(-n // items_each)
        if k > 1 or held + n > items_each:
            shard, held = shard + (held > 0), 0
        out.append((code, shard, k))
        shard, held = (shard + k, 0) if k > 1 else (shard, held + n)
    return out


class Bm25Index:
    """An inverted index of the items of one shard: per term the items that hold it and their BM25 weights in the whole corpus."""

    def __init__(self, items: list[np.ndarray], corpus: Corpus | None = None) -> None:
        self.n, corpus = len(items), corpus or Corpus.of(items)
        size = np.array([len(x) for x in items], np.int64)
        owner, terms = np.repeat(np.arange(self.n), size), np.concatenate([x.astype(np.int64) for x in items]) if items else np.zeros(0, np.int64)
        pairs, tf = np.unique(terms * max(1, self.n) + owner, return_counts=True)
        term, self.item = np.divmod(pairs, max(1, self.n))
        self.terms, self.first, df = np.unique(term, return_index=True, return_counts=True)
        self.first = np.append(self.first, len(pairs))
        whole = corpus.df[self.terms]
        idf = np.repeat(np.log1p((corpus.n - whole + 0.5) / (whole + 0.5)), df)
        norm = K1 * (1 - B + B * size / max(1e-9, corpus.mean))
        self.weight = idf * tf * (K1 + 1) / (tf + norm[self.item])
        slot = np.repeat(np.arange(len(df)), df)
        order = np.lexsort((-self.weight, self.item))
        self.own_slots, bounds = slot[order], np.searchsorted(self.item[order], np.arange(self.n + 1))
        self.own = bounds

    def neighbours(self, seed: int, terms: int) -> np.ndarray:
        """Items that share a query term with the seed, best first; ties in the items' order."""
        slots = self.own_slots[self.own[seed] : min(self.own[seed] + terms, self.own[seed + 1])]
        if not len(slots):
            return slots
        at = [slice(self.first[s], self.first[s + 1]) for s in slots]
        score = np.bincount(np.concatenate([self.item[a] for a in at]), np.concatenate([self.weight[a] for a in at]), self.n)
        found = np.flatnonzero(score)
        return found[np.argsort(-score[found], kind="stable")]


def pack_shard(items: list[np.ndarray], window: int, terms: int, corpus: Corpus | None = None) -> list[list[tuple[int, int, int]]]:
    """Windows as lists of (item, from, to)."""
    index, done, size = Bm25Index(items, corpus), [0] * len(items), [len(x) for x in items]
    order = sorted(range(len(items)), key=lambda i: (-size[i], i))
    out, spare = [], 0

    for seed in order:
        while done[seed] < size[seed]:
            row, room = [], window

            def take(i: int) -> None:
                nonlocal room
                n = min(room, size[i] - done[i])
                row.append((i, done[i], done[i] + n))
                done[i] += n
                room -= n

            take(seed)
            if room:
                for i in index.neighbours(seed, terms).tolist():
                    if done[i] < size[i]:
                        take(i)
                        if not room:
                            break
            while room and spare < len(order):
                if done[order[spare]] < size[order[spare]]:
                    take(order[spare])
                else:
                    spare += 1
            out.append(row)
    return out


def pack_documents(docs: DataFrame, tokenizer: str, window: int = 1024, end_id: int = 0, items_each: int = 2000, query_terms: int = 24) -> DataFrame:
    """A row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A null or empty text is the end id alone; repeated rows are documents of their own; an empty table
    gives no rows; other columns are ignored. items_each bounds a shard, and so a task's memory, not
    the result: every item is indexed and packed. A seed asks the index of its own shard; query_terms
    are its terms of most weight.
    """

    def pack(table: pa.Table) -> pa.Table:
        if not table.num_rows:
            return table.select([])
        table = table.sort_by([("doc_id", "ascending"), ("rest", "ascending"), ("item", "ascending")])
        shard, doc, total, crcs = table["shard"][0].as_py(), table["doc_id"].to_pylist(), table["doc_tokens"].to_pylist(), table["crcs"].to_pylist()
        items = [np.frombuffer(x.as_py(), f"<u{table['width'][0].as_py()}") for x in table["rest"]]
        rows, sequence = [], shard << 32
        for d, n, c in zip(doc, total, crcs, strict=True):
            for k, crc in enumerate(c):
                rows.append((d, k * window, window, crc, n, sequence, 0))
                sequence += 1
        for w in pack_shard(items, window, query_terms, corpus):
            offset = 0
            for i, a, b in w:
                rows.append((doc[i], len(crcs[i]) * window + a, b - a, crc32_of(items[i][a:b]), total[i], sequence, offset))
                offset += b - a
            sequence += 1
        return pa.table([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=[x.split()[0] for x in PIECES.split(", ")])

    items = written(items_of(docs, tokenizer, end_id, window).withColumn("item", F.monotonically_increasing_id()), "pack-items", "zstd")
    corpus = corpus_of(items)
    plan = shard_plan([(r["code"], r["count"]) for r in items.groupBy("code").count().collect()], items_each)  # 2^CODE_BITS rows at most
    plan = items.sparkSession.createDataFrame(plan, "code int, first_shard long, shards long")
    split = F.col("first_shard") + F.pmod(F.xxhash64(F.lit(17), "item"), F.col("shards"))
    return items.join(F.broadcast(plan), "code").withColumn("shard", split).drop("first_shard", "shards", "code").groupBy("shard").applyInArrow(pack, PIECES)
