"""Ranked lexical search in a bit-sliced impact index.

A term's impact on a document's score is an integer. Documents are dealt to shards by a hash; in a
shard they have slots in order of doc_id, and a term's postings there are one bitmap for each bit of
the impacts, bit s of slice j being bit j of the impact on the document in slot s. Words of 64 slots in
which a term has no posting are left out. A query adds the slices of its terms to an accumulator of
slices by carry arithmetic on whole words, all documents of a shard at a time. The top k come out of
the accumulator from its most significant slice down: documents that have the slice's bit go before
those that haven't, until k are certain; what still ties after the last slice is taken in slot order.

Documents are named by doc_id and a 64-bit hash of the text, so that two scans agree on them; a row
that repeats both is a copy of one slot.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trovespark.llm.common import in_arrow, written

#: Documents and postings of a shard, queries that a task answers at a time, pairs in an Arrow batch.
SHARD_DOCS, SHARD_POSTINGS, GROUP, PAIRS = 8192, 400_000, 64, 1 << 16
#: Letters, digits and all bytes of other scripts stand; A-Z become a-z, all else a space.
TABLE = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c > 127 else 32 for c in range(256))


def tokens(text: bytes) -> list[bytes]:
    """The terms of a UTF-8 text, in order."""
    return text.translate(TABLE).split()


def lengths(texts: DataFrame) -> DataFrame:
    """(n) for every row with a text: how many terms it has."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            yield pa.record_batch([pa.array([len(tokens(t.as_py())) for t in b.column(0).cast(pa.binary())], pa.int64())], ["n"])

    return in_arrow(texts.where("text is not null").select("text"), batches, "n long")


def occurrences(texts: DataFrame, first: str, second: str) -> DataFrame:
    """(first, second, n, term, tf) for every row and distinct term of its text: two longs that name the row, its terms, those equal to term."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            at, terms, counts, sizes, ns = 0, [], [], [], []

            def flush(to: int, b: pa.RecordBatch = b) -> pa.RecordBatch:
                rows = pa.array(np.repeat(np.arange(at, to), sizes))
                return pa.record_batch([b.column(0).take(rows), b.column(1).take(rows), pa.array(np.repeat(np.array(ns, np.int64), sizes)), pa.array(terms, pa.binary()).cast(pa.string()), pa.array(counts, pa.int64())], [first, second, "n", "term", "tf"])

            for i, t in enumerate(b.column(2).cast(pa.binary())):
                found = tokens(t.as_py())
                bag = Counter(found)
                terms += bag.keys()
                counts += bag.values()
                sizes.append(len(bag))
                ns.append(len(found))
                if len(terms) >= PAIRS:
                    yield flush(i + 1)
                    at, terms, counts, sizes, ns = i + 1, [], [], [], []
            yield flush(b.num_rows)

    return in_arrow(texts.where("text is not null").select(first, second, "text"), batches, f"{first} long, {second} long, n long, term string, tf long")


def impact(n_docs: int, all_terms: int) -> Column:
    """What a posting (n, tf, df) adds to a score, a long; the weight alone is computed in doubles."""
    weight = F.floor(1000 * F.log((2.0 * n_docs + 2) / (2 * F.col("df").cast("double") + 1))).cast("long")
    return weight * F.expr(f"(1000000000L * tf) div (1000L * tf + 12L * (75L + (25L * n * {n_docs}L) div {max(1, all_terms)}L))")


def slices_of(slots: np.ndarray, impacts: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """The occupied words of a term's bitmaps and its slices [bits, occupied words]."""
    bits = max(1, int(impacts.max()).bit_length())
    m = np.zeros((bits, words * 64), np.uint8)
    m[:, slots] = (impacts >> np.arange(bits)[:, None]) & 1
    packed = np.packbits(m, axis=1, bitorder="little").view("<u8")
    has = np.unique(slots >> 6)
    return has.astype(np.int32), packed[:, has]


def build_index(postings: DataFrame, shards: int) -> DataFrame:
    """The index of postings (doc_id, th, term, impact): a row for each (shard, term), and one without a term that names the slots of the shard.

    One task holds one shard's postings; they are as many on average as the caller's number of shards
    makes them, and a document adds its distinct terms at most.
    """

    def shard(t: pa.Table) -> pa.Table:
        ids, th = t["doc_id"], t["th"].to_numpy()
        missing, number = ids.is_null().to_numpy(), ids.fill_null(0).to_numpy()
        order = np.lexsort((th, number, missing))
        new = np.ones(len(t), bool)
        new[1:] = (th[order][1:] != th[order][:-1]) | (number[order][1:] != number[order][:-1]) | (missing[order][1:] != missing[order][:-1])
        slot = np.empty(len(t), np.int64)
        slot[order] = np.cumsum(new) - 1
        named = order[new]
        words = -(-len(named) // 64)
        code = t["term"].combine_chunks().dictionary_encode()
        terms, codes = code.dictionary.to_pylist(), code.indices.to_numpy()
        impacts = t["impact"].to_numpy()
        pairs, at, copies = np.unique(codes.astype(np.int64) * (1 << 32) + slot, return_index=True, return_counts=True)
        each = np.zeros(len(named), np.int64)
        each[slot[at]] = copies  # a row's terms all repeat as often as the row
        ends = np.searchsorted(pairs, (np.arange(len(terms)) + 1) << 32)
        number_of = t["shard"][0].as_py()
        rows = [(number_of, None, number[named].tobytes(), missing[named].astype(np.uint8).tobytes() + each.tobytes())]
        for i, (a, b) in enumerate(zip([0, *ends[:-1]], ends, strict=True)):
            has, packed = slices_of(slot[at[a:b]], impacts[at[a:b]], words)
            rows.append((number_of, terms[i], has.tobytes(), packed.tobytes()))
        return pa.table([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), (pa.int32(), pa.string(), pa.binary(), pa.binary()), strict=True)], ["shard", "term", "words", "slices"])

    dealt = F.pmod(F.xxhash64("doc_id", "th"), F.lit(shards)).cast("int")
    return postings.select(dealt.alias("shard"), "doc_id", "th", "term", "impact").groupBy("shard").applyInArrow(shard, "shard int, term string, words binary, slices binary")


def add(total: np.ndarray, queries: np.ndarray, words: np.ndarray, slices: np.ndarray, shift: int = 0) -> None:
    """Adds slices, times 2 ** shift, to the accumulators total[bit, query, word] of the queries, at words."""
    at = np.ix_(queries, words)
    carry = np.zeros((len(queries), len(words)), np.uint64)
    for j in range(shift, len(total)):
        a = total[j][at]
        if j - shift < len(slices):
            b = slices[j - shift]
            x = a ^ b
            total[j][at] = x ^ carry
            carry = (a & b) | (x & carry)
        elif carry.any():
            total[j][at] = a ^ carry
            carry &= a
        else:
            break


def top(total: np.ndarray, k: int) -> list[tuple[int, int]]:
    """(slot, score) of the k highest scores above 0 in total[bit, word], ties by smaller slot, by descent from the top slice."""
    tied = np.bitwise_or.reduce(total, axis=0)
    certain = np.zeros_like(tied)
    count = lambda b: int(np.bitwise_count(b).sum())
    for s in total[::-1]:
        ones = tied & s
        if count(certain | ones) > k:
            tied = ones
        else:
            certain |= ones
            tied &= ~s
    slots = lambda b: np.flatnonzero(np.unpackbits(b.view(np.uint8), bitorder="little"))
    chosen = np.concatenate([slots(certain), slots(tied)[: k - count(certain)]])
    bits = total[:, chosen >> 6] >> (chosen & 63).astype(np.uint64) & np.uint64(1)
    scores = (bits << np.arange(len(total), dtype=np.uint64)[:, None]).sum(axis=0, dtype=np.uint64)
    return [(int(s), int(x)) for s, x in zip(chosen, scores, strict=True) if x]


def search(index: DataFrame, asked: DataFrame, groups: int, k: int) -> DataFrame:
    """(item, doc_id, copies, score): each shard's best k of every item of asked (grp int below groups, i int, item long, term string, count long).

    Groups of queries meet shards, one at a time in a task, term by term: it holds the group's
    accumulators and one term's slices.
    """
    hits = asked.groupBy("grp", "term").agg(F.collect_list(F.struct("i", "item", F.col("count").alias("times"))).alias("hits"))  # a group's queries at most
    every = F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("grp")  # every group meets every shard
    names = index.where("term is null").select(every, "shard", "term", "words", "slices", F.lit(None).cast("array<struct<i:int,item:bigint,times:bigint>>").alias("hits"))
    work = index.where("term is not null").join(hits, "term").select("grp", "shard", "term", "words", "slices", "hits").unionByName(names)

    def result(ids: np.ndarray, missing: np.ndarray, copies: np.ndarray, items: dict[int, int], total: np.ndarray) -> pa.RecordBatch:
        out = [(items[i], None if missing[s] else int(ids[s]), int(copies[s]), x) for i in items for s, x in top(total[:, i], k)]
        return pa.record_batch([pa.array(c, pa.int64()) for c in (list(zip(*out, strict=True)) or [()] * 4)], ["item", "doc_id", "copies", "score"])

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state: tuple = ()
        for b in it:
            for r in b.to_pylist():
                if r["term"] is None:  # first of its group and shard
                    if state:
                        yield result(*state)
                    ids = np.frombuffer(r["words"], np.int64)
                    state = (ids, np.frombuffer(r["slices"][: len(ids)], np.uint8), np.frombuffer(r["slices"][len(ids) :], np.int64), {}, np.zeros((1, 1, -(-len(ids) // 64)), np.uint64))
                    continue
                ids, missing, copies, items, total = state
                words = np.frombuffer(r["words"], np.int32)
                slices = np.frombuffer(r["slices"], np.uint64).reshape(-1, len(words))
                items |= {h["i"]: h["item"] for h in r["hits"]}
                most, queries = max(h["times"] for h in r["hits"]), 1 + max(h["i"] for h in r["hits"])
                need = max(len(total), len(slices) + int(most).bit_length()) + 1  # the top slice stays clear for carries
                if total[-1].any() or need > len(total) + 1 or queries > total.shape[1]:
                    grown = np.zeros((max(need, len(total)), max(queries, total.shape[1]), total.shape[2]), np.uint64)
                    grown[: len(total), : total.shape[1]] = total
                    total = grown
                    state = (ids, missing, copies, items, total)
                for shift in range(int(most).bit_length()):
                    if of := [h["i"] for h in r["hits"] if h["times"] >> shift & 1]:
                        if total[-1].any():
                            total = np.concatenate([total, np.zeros_like(total[:1])])
                            state = (ids, missing, copies, items, total)
                        add(total, np.array(of), words, slices, shift)
        if state:
            yield result(*state)

    ordered = work.repartition("grp", "shard").sortWithinPartitions("grp", "shard", F.col("term").asc_nulls_first())
    return in_arrow(ordered, batches, "item long, doc_id long, copies long, score long")


def ranked(docs: DataFrame, items: DataFrame, k: int = 20) -> DataFrame:
    """(item_id, rank, doc_id, score): the k best documents (doc_id, text) of each item (item_id, text), with scores above 0.

    Every row of items is a query of its own, also where item_ids repeat; every row of docs is a
    document, so repeated rows take a rank each. Null, empty and blank texts have no terms and
    are neither found nor answered; null doc_ids come last among ties; empty tables give no rows; further
    columns are ignored. Terms that no item asks for count in the lengths but aren't indexed.
    """
    numbered = written(items.select(F.monotonically_increasing_id().alias("item"), F.col("item_id").cast("long").alias("item_id"), "text"), "items")
    of_items = -(-max(1, numbered.count()) // GROUP)
    groups = numbered.select("item", "item_id", F.pmod(F.xxhash64("item"), F.lit(of_items)).cast("int").alias("grp")).withColumn("i", F.row_number().over(Window.partitionBy("grp").orderBy("item")) - 1)
    groups = written(groups, "groups")
    bags = occurrences(numbered, "item", "item_id").select("item", "term", F.col("tf").alias("count"))
    asked = written(bags.join(groups, "item").select("grp", "i", "item", "term", "count"), "asked")
    size = lengths(docs).where("n > 0").agg(F.count("*").alias("docs"), F.sum("n").alias("terms")).first()
    n_docs, all_terms = size["docs"], size["terms"] or 0
    named = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("th"), "text")
    postings = written(occurrences(named, "doc_id", "th").join(asked.select("term").distinct(), "term", "left_semi"), "postings")
    df = written(postings.groupBy("term").agg(F.count("*").alias("df")), "frequencies")
    weighed = postings.join(df, "term").select("doc_id", "th", "term", impact(n_docs, all_terms).alias("impact")).where("impact > 0")
    shards = max(1, -(-n_docs // SHARD_DOCS), -(-postings.count() // SHARD_POSTINGS))
    index = written(build_index(weighed, shards), "index")
    found = search(index, asked, of_items, k).withColumn("copy", F.explode(F.sequence(F.lit(1), F.least("copies", F.lit(k).cast("long")))))
    found = found.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last()))).where(F.col("rank") <= k)
    return found.join(groups.select("item", "item_id"), "item").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")


#: The same ranking from postings in SQL.
SQL = r"""with t as (select row_number() over () as d, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') as terms from documents where text is not null),
s as (select cast(count(*) as bigint) as n_docs, cast(sum(len(terms)) as bigint) as n_terms from t where len(terms) > 0),
p as (select d, doc_id, n, term, cast(count(*) as bigint) as tf from (select d, doc_id, len(terms) as n, unnest(terms) as term from t) group by all),
f as (select term, cast(count(*) as bigint) as df from p group by term),
i as (select row_number() over () as item, item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') as terms from benchmark where text is not null),
q as (select item, item_id, term, count(*) as times from (select item, item_id, unnest(terms) as term from i) group by all),
x as (select item, item_id, d, doc_id, cast(sum(times * cast(floor(1000 * ln((2.0::double * n_docs + 2) / (2.0::double * df + 1))) as bigint)
        * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * n_docs) // n_terms)))) as bigint) as score
    from q join p using (term) join f using (term), s group by all)
select item_id, cast(row_number() over (partition by item order by score desc, doc_id nulls last, d) as int) as rank, doc_id, score from x where score > 0 qualify rank <= 20"""
