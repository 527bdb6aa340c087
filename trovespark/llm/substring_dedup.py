"""Removal of word windows that an earlier document has, by recompression.

Words get names, 64-bit hashes; rounds then compress the name sequence. A run round replaces every
maximal run of one name by a name of (name, length); a pair round splits names into left and right
ones by a bit of a hash seeded with the round, and replaces every left name with a right one after it
by a name of the pair. A name is a function of what it replaces, so that all tasks name alike without
a shared dictionary. What a symbol becomes depends on its neighbours only: with each goes the interval
of words that settles it, and whatever holds that interval, wherever it stands, parses to that symbol.

The symbols settled inside a window are thus the same wherever the window stands. Each window takes
the one of least hash as its anchor. Windows of a document that share an anchor are a segment, named by
128 bits, of its anchor and of its words. One aggregation finds the anchors that stand in two documents; all other
segments are done with. Of the rest, segments of one name give themselves up to their first document,
and only where one anchor has several segment names are single windows compared, again by 128-bit
hashes, from one segment of each name. So copies meet in one row, and no pairs are made.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trovespark.llm.common import in_arrow, with_text, worth_joining, written

#: Rounds from words up: a symbol of the top stands for about three words.
ROUNDS = ("run", "pair", "pair", "run", "pair", "pair")
#: After how many rounds symbols are taken as anchors: lower ones only for windows in which no higher one is settled.
LEVELS = (1, 3, 6)
#: Words that a task parses at a time; longer documents are parsed in overlapping pieces.
PIECE = 1 << 17
#: Bytes of text that a task cuts into words at a time; a longer text is cut alone.
CUT = 4 << 20
SPACE = np.zeros(256, bool)
SPACE[[32, *range(9, 14)]] = True
#: Multipliers of the two lanes of word hashes, odd.
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
SEGMENT = "struct<anchor:bigint,name:bigint,start:int,n:int>"
U = np.uint64


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit numbers."""
    x = (x ^ (x >> U(31))) * U(0x7FB5D329728EA185)
    x = (x ^ (x >> U(27))) * U(0x81DADEF4BC2DD44D)
    return x ^ (x >> U(33))


class Words:
    """The words of an array of UTF-8 texts, without an object for each: their bytes in a row, their lengths, and each text's first word."""

    def __init__(self, texts: pa.Array) -> None:
        texts = texts.cast(pa.binary())
        offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
        data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
        offsets = offsets - offsets[0]
        word = ~SPACE[data]
        after = np.zeros(len(data) + 1, bool)  # where a text begins or the one before ends
        after[offsets] = True
        begins = word.copy()
        begins[1:] &= ~word[:-1] | after[1:-1]
        ends = word.copy()
        ends[:-1] &= ~word[1:] | after[1:-1]
        at = np.flatnonzero(begins)
        self.lengths = np.flatnonzero(ends) + 1 - at
        self.first = np.searchsorted(at, offsets)
        self.data = data[word]
        self.offsets = np.concatenate([[0], np.cumsum(self.lengths)])

    def hashes(self) -> np.ndarray:
        """Two 64-bit hashes [lane, word]; every distinct word is hashed once."""
        d = pa.Array.from_buffers(pa.binary(), len(self.lengths), [None, pa.py_buffer(self.offsets.astype(np.int32)), pa.py_buffer(self.data)]).dictionary_encode()
        distinct = d.dictionary.to_pylist()
        table = np.array([[xxhash.xxh64_intdigest(w, seed) for w in distinct] for seed in (11, 12)], np.uint64).reshape(2, -1)
        return table[:, d.indices.to_numpy()]

    def joined(self, text: int, keep: np.ndarray | None = None) -> Iterator[bytes]:
        """A text's words, or those that keep marks, joined by one space, in blocks."""
        begun = False
        for a in range(self.first[text], end := self.first[text + 1], PIECE):
            b = min(end, a + PIECE)
            lengths, data = self.lengths[a:b], self.data[self.offsets[a] : self.offsets[b]]
            if keep is not None:
                chosen = keep[a - self.first[text] : b - self.first[text]]
                data, lengths = data[np.repeat(chosen, lengths)], lengths[chosen]
            if len(lengths):
                out = np.full(len(data) + len(lengths), 32, np.uint8)
                out[np.arange(len(data)) + np.repeat(np.arange(1, len(lengths) + 1), lengths)] = data
                yield out[0 if begun else 1 :].tobytes()
                begun = True


def cut(texts: pa.Array) -> Iterator[tuple[int, Words]]:
    """(first row, words) of slices of texts that hold about CUT bytes."""
    sizes = np.cumsum([0, *(len(t.as_py()) for t in texts.cast(pa.binary()))])
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(sizes, sizes[at] + CUT, "right")) - 1)
        yield at, Words(texts.slice(at, to - at))
        at = to


def digest(blocks: Iterator[bytes]) -> str:
    out = hashlib.sha256()
    for b in blocks:
        out.update(b)
    return out.hexdigest()


class Powers:
    """Powers of the bases and of their inverses modulo 2**64, as far as a piece needs them."""

    def __init__(self, most: int) -> None:
        self.up, self.down = np.empty((2, most + 1), U), np.empty((2, most + 1), U)
        for lane, b in enumerate(BASES):
            for out, x in ((self.up, b), (self.down, pow(b, -1, 1 << 64))):
                out[lane, 0] = 1
                out[lane, 1:] = np.cumprod(np.full(most, x, U))


class Hashes:
    """128-bit hashes of any stretches of a piece's words."""

    def __init__(self, words: np.ndarray, powers: Powers) -> None:
        n = words.shape[1]
        self.sums = np.zeros((2, n + 1), U)
        np.cumsum(words * powers.up[:, :n], axis=1, out=self.sums[:, 1:])
        self.down = powers.down

    def of(self, start: np.ndarray, end: np.ndarray, lane: int) -> np.ndarray:
        return mixed((self.sums[lane, end] - self.sums[lane, start]) * self.down[lane, start] + (end - start).astype(U))


def neighbour(x: np.ndarray, by: int) -> np.ndarray:
    """x shifted so that each place holds what stands by places further on; the ends keep their own."""
    return x[np.clip(np.arange(len(x)) + by, 0, len(x) - 1)]


def compressed(names: np.ndarray, low: np.ndarray, high: np.ndarray, fence: np.ndarray) -> list[tuple[np.ndarray, ...]]:
    """The symbols of a piece at LEVELS, the top first, without fences: names, and the word intervals [low, high) that settle them; fences never merge.

    low and high never fall along the symbols, as a neighbour's interval is only ever taken in from the next symbol.
    """
    levels = []
    for r, kind in enumerate(ROUNDS):
        if kind == "run":
            first = np.flatnonzero(np.concatenate([[True], names[1:] != names[:-1]]))
            last = np.append(first[1:], len(names)) - 1
            k = (last - first + 1).astype(U)
            # that a run ends where it does is known by its neighbours, those of single symbols too
            low, high = low[np.maximum(first - 1, 0)], high[np.minimum(last + 1, len(names) - 1)]
            names, fence = names[first], fence[first]
            names = np.where(k > 1, mixed(names * U(0xD6E8FEB86659FD93) + k), names)
        else:
            right = mixed(names ^ U(0xA0761D6478BD642F + r)) >> U(63) == 1
            with_next = np.zeros(len(names), bool)
            with_next[:-1] = ~right[:-1] & right[1:] & ~fence[:-1] & ~fence[1:]
            taken = np.concatenate([[False], with_next[:-1]])
            # a right symbol that stays shows a neighbour before it that isn't left; a left one, one after it that isn't right
            new_low = np.where(right & ~with_next & ~fence, neighbour(low, -1), low)
            new_high = np.where(with_next, neighbour(high, 1), np.where(right | fence, high, neighbour(high, 1)))
            pair = mixed(mixed(names + U(r + 1)) + neighbour(names, 1))
            names = np.where(with_next, pair, names)[~taken]
            low, high, fence = new_low[~taken], new_high[~taken], fence[~taken]
        if r + 1 in LEVELS:
            levels.insert(0, (names[~fence], low[~fence], high[~fence]))
    return levels


def least_in(keys: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The place of the first least key in each of the non-empty ranges [left, right)."""
    levels = [np.arange(len(keys))]
    longest = int((right - left).max(initial=1))
    while 2 << (len(levels) - 1) <= longest:
        half, at = 1 << (len(levels) - 1), levels[-1]
        a, b = at[:-half], at[half:]
        levels.append(np.where(keys[b] < keys[a], b, a))
    out, k = np.empty(len(left), np.int64), np.frexp((right - left).astype(np.float64))[1] - 1
    for level, at in enumerate(levels):
        of = np.flatnonzero(k == level)
        a, b = at[left[of]], at[right[of] - (1 << level)]
        out[of] = np.where(keys[b] < keys[a], b, a)
    return out


def segments(words: np.ndarray, fences: np.ndarray, window: int, powers: Powers) -> tuple[np.ndarray, ...]:
    """(anchor, name, start, n) of the segments of a piece: words [lane, place], where fences stand between documents and at both ends.

    Windows in which no symbol is settled are their own anchors; n equal ones in a row are one segment, named by the first.
    """
    total = words.shape[1]
    fence = np.zeros(total, bool)
    fence[fences] = True
    places = np.arange(total)
    names = words[0].copy()
    names[fences] = mixed(fences.astype(U) + U(1 << 60))  # unlike each other, so that no run holds two
    hashes = Hashes(words, powers)
    levels = compressed(names, places, places + 1, fence)
    before = np.concatenate([[0], np.cumsum(fence)])
    starts = places[: max(0, total - window + 1)]
    starts = starts[before[starts + window] == before[starts]]
    if not len(starts):
        return (np.empty(0, np.int64),) * 4
    anchor, low, high = (np.full(len(starts), -1, np.int64) for _ in range(3))
    rest = np.arange(len(starts))
    for level, (symbols, lows, highs) in enumerate(levels):
        left, right = np.searchsorted(lows, starts[rest], "left"), np.searchsorted(highs, starts[rest] + window, "right")
        has = left < right
        if has.any():
            at = least_in(mixed(symbols), left[has], right[has])
            anchor[rest[has]], low[rest[has]], high[rest[has]] = at * len(levels) + level, lows[at], highs[at]
        rest = rest[~has]
    alone = anchor < 0  # inside long runs, where windows often equal the next
    own = np.zeros(len(starts), U)
    own[alone] = hashes.of(starts[alone], starts[alone] + window, 0)
    new = np.ones(len(starts), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (starts[1:] != starts[:-1] + 1) | (own[1:] != own[:-1])
    first = np.flatnonzero(new)
    n = np.diff(np.append(first, len(starts)))
    start, alone = starts[first], alone[first]
    name = hashes.of(start, start + np.where(alone, 1, n) + window - 1, 1)
    key = hashes.of(np.where(alone, start, low[first]), np.where(alone, start + window, high[first]), 0)
    return key.view(np.int64), name.view(np.int64), start, n


def pieces(n_words: int, window: int) -> Iterator[tuple[int, int]]:
    """Stretches that hold every window of a document once, of PIECE words at most."""
    for at in range(0, max(1, n_words - window + 1), PIECE - window + 1):
        yield at, min(n_words, at + PIECE)


def parsed(words: Words, window: int, powers: Powers) -> Iterator[tuple[int, tuple[np.ndarray, ...]]]:
    """(text, its segments) for each text of at least a window, in order; short texts are parsed together."""
    hashed = words.hashes()
    barrier = np.zeros((2, 1), U)

    def flush(held: list[tuple[int, int, int]]) -> Iterator[tuple[int, tuple[np.ndarray, ...]]]:
        flat = np.concatenate([x for d, a, b in held for x in (barrier, hashed[:, words.first[d] + a : words.first[d] + b])] + [barrier], axis=1)
        fences = np.cumsum([0, *(b - a + 1 for _, a, b in held)])
        got = segments(flat, fences, window, powers)
        cuts = np.searchsorted(got[2], fences)
        for (d, a, _), fence, i, j in zip(held, fences, cuts[:-1], cuts[1:], strict=False):
            yield d, (got[0][i:j], got[1][i:j], got[2][i:j] - fence - 1 + a, got[3][i:j])

    held, size = [], 0
    for d, n in enumerate(np.diff(words.first)):
        for a, b in pieces(int(n), window) if n >= window else ():
            if held and size + b - a > PIECE:
                yield from flush(held)
                held, size = [], 0
            held.append((d, a, b))
            size += b - a
    if held:
        yield from flush(held)


def scan(named: DataFrame, window: int) -> DataFrame:
    """(doc_id, th, n_words, digest, segments) of every row of named (doc_id, th, text): digest is the hash of all its words, joined by one space."""
    kind = pa.struct([("anchor", pa.int64()), ("name", pa.int64()), ("start", pa.int32()), ("n", pa.int32())])

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers(2 * PIECE)
        for b in it:
            for row, words in cut(b.column(2)):
                n = np.diff(words.first)
                whose, columns = [np.empty(0, np.int64)], [[np.empty(0, np.int64)] for _ in range(4)]
                for d, got in parsed(words, window, powers):
                    whose.append(np.full(len(got[0]), d))
                    for c, x in zip(columns, got, strict=True):
                        c.append(x)
                values = pa.StructArray.from_arrays([pa.array(np.concatenate(c), f.type) for c, f in zip(columns, kind, strict=True)], fields=list(kind))
                offsets = pa.array(np.searchsorted(np.concatenate(whose), np.arange(len(n) + 1)), pa.int32())
                digests = [digest(words.joined(d)) for d in range(len(n))]
                of = b.slice(row, len(n))
                yield pa.record_batch([of.column(0), of.column(1), pa.array(n, pa.int64()), pa.array(digests), pa.ListArray.from_arrays(offsets, values)], ["doc_id", "th", "n_words", "digest", "segments"])

    return in_arrow(named, batches, f"doc_id long, th long, n_words long, digest string, segments array<{SEGMENT}>")


def window_hashes(texts: DataFrame, window: int) -> DataFrame:
    """(id, at, w1, w2, doc_id) of every window of the segments in texts (doc_id, text, segments array<struct<id, start, n>>); at counts from the segment's start."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers(PIECE)  # a segment is within a piece
        held, size = [], 0

        def flat(held: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
            columns = [np.concatenate(c) for c in zip(*held, strict=True)]
            return pa.record_batch([pa.array(c, pa.int32() if k == 1 else pa.int64()) for k, c in enumerate(columns)], ["id", "at", "w1", "w2", "doc_id"])

        for b in it:
            for row, words in cut(b.column(1)):
                hashed = words.hashes()
                for d in range(len(words.first) - 1):
                    doc_id, inside = b.column(0)[row + d].as_py(), hashed[:, words.first[d] : words.first[d + 1]]
                    for s in b.column(2)[row + d].as_py():
                        hashes, at = Hashes(inside[:, s["start"] : s["start"] + s["n"] + window - 1], powers), np.arange(s["n"])
                        w1, w2 = (hashes.of(at, at + window, lane).view(np.int64) for lane in (0, 1))
                        held.append((np.full(s["n"], s["id"]), at, w1, w2, np.full(s["n"], doc_id)))
                        size += s["n"]
                        if size >= PIECE:
                            yield flat(held)
                            held, size = [], 0
        if held:
            yield flat(held)

    return in_arrow(texts, batches, "id long, at int, w1 long, w2 long, doc_id long")


def without(texts: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256, kept) of texts (doc_id, text, spans array<struct<start, end>>): the words outside the spans, joined by one space."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            for row, words in cut(b.column(1)):
                n, removed, kept, digests = np.diff(words.first), [], [], []
                for d, size in enumerate(n):
                    edges = np.zeros(size + 1, np.int64)
                    for s in b.column(2)[row + d].as_py():
                        edges[s["start"]] += 1
                        edges[s["end"]] -= 1
                    keep = np.cumsum(edges[:-1]) == 0
                    text = b"".join(words.joined(d, keep))
                    removed.append(size - int(keep.sum()))
                    kept.append(text)
                    digests.append(digest(iter([text])))
                yield pa.record_batch([b.column(0).slice(row, len(n)), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(digests), pa.array(kept, pa.binary()).cast(pa.string())], ["doc_id", "n_words", "n_removed", "kept_sha256", "kept"])

    return in_arrow(texts, batches, "doc_id long, n_words long, n_removed long, kept_sha256 string, kept string")


def earlier_windows(found: DataFrame, texts: DataFrame, window: int) -> DataFrame:
    """(doc_id, th, start, end) of word spans that windows of a smaller doc_id cover; found is (doc_id, th, anchor, name, start, n), texts (doc_id, th, text)."""
    shared = found.groupBy("anchor").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).where("a < b").select("anchor")
    shared = written(shared, "shared")  # else its aggregation would bind the join to one task for an anchor
    met = written(found.join(shared, "anchor", "left_semi"), "met")
    names = met.groupBy("anchor", "name").agg(F.min(F.struct("doc_id", "th", "start", "n")).alias("s"))
    names = written(names.select("anchor", "name", "s.*", F.monotonically_increasing_id().alias("id")), "names")
    several = names.groupBy("anchor").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).where("a < b").select("anchor")
    asked = names.join(several, "anchor", "left_semi").groupBy("doc_id", "th").agg(F.collect_list(F.struct("id", "start", "n")).alias("segments"))  # of one document
    asked = written(asked, "asked")
    asked = worth_joining(texts, asked, "doc_id", "th").join(asked, ["doc_id", "th"]).select("doc_id", "text", "segments")
    windows = written(window_hashes(asked, window), "windows")
    first = windows.groupBy("w1", "w2").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last").drop("last")
    late = windows.join(first, ["w1", "w2"]).where("first < doc_id").groupBy("id").agg(F.collect_set("at").alias("late"))  # of one segment
    told = names.join(late, "id", "left").select("anchor", "name", F.col("doc_id").alias("owner"), "late")
    spans = met.join(told, ["anchor", "name"])
    whole = F.array(F.struct(F.col("start").alias("start"), (F.col("start") + F.col("n") + (window - 1)).alias("end")))
    single = F.transform("late", lambda x: F.struct((F.col("start") + x).alias("start"), (F.col("start") + x + window).alias("end")))
    return spans.select("doc_id", "th", F.inline(F.when(F.col("owner") < F.col("doc_id"), whole).otherwise(single)))


def deduplicated(docs: DataFrame, window: int = 50) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256, kept) of every row of docs (doc_id, text).

    A word goes if a window of so many consecutive words that covers it also starts in a document of
    smaller doc_id; windows are judged on the input. kept is the text's words that stay, joined by
    one space, and null where none goes. Null and blank texts have no words; texts shorter
    than the window lose none. Rows that repeat doc_id and text have equal results, and rows of one
    doc_id never shorten each other. A null doc_id is neither smaller nor larger than any. An empty
    table gives no rows; further columns are ignored.
    """
    named = with_text(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("th"), "text")
    scanned = written(scan(named, window), "scanned")
    found = scanned.where("doc_id is not null").select("doc_id", "th", F.inline("segments"))
    spans = earlier_windows(found, named, window).groupBy("doc_id", "th").agg(F.collect_set(F.struct("start", "end")).alias("spans"))  # of one document
    spans = written(spans, "spans")
    shorter = without(worth_joining(named, spans, "doc_id", "th").join(spans, ["doc_id", "th"]).select("doc_id", "text", "spans"))
    whole = scanned.join(spans.select("doc_id", "th"), ["doc_id", "th"], "left_anti")
    return shorter.unionByName(whole.select("doc_id", "n_words", F.lit(0).cast("long").alias("n_removed"), F.col("digest").alias("kept_sha256"), F.lit(None).cast("string").alias("kept")))


#: Every window as a string, against the first document that has it.
SQL = r"""with t as (select row_number() over () as d, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as words from documents),
w as (select d, doc_id, p, array_to_string(words[p:p + 49], ' ') as seq from (select d, doc_id, words, unnest(range(1, len(words) - 48)) as p from t where len(words) >= 50)),
f as (select seq, min(doc_id) as first from w group by seq),
g as (select d, list(p) as starts from w join f using (seq) where first < doc_id group by d),
c as (select d, list(distinct q) as gone from (select d, unnest(range(s, s + 50)) as q from (select d, unnest(starts) as s from g)) group by d),
k as (select t.d, array_to_string(list(words[q] order by q), ' ') as text from (select d, words, unnest(range(1, len(words) + 1)) as q from t where d in (select d from c)) t
    where not exists (select 1 from (select d, unnest(gone) as q from c) x where x.d = t.d and x.q = t.q) group by t.d)
select doc_id, cast(len(words) as bigint) as n_words, cast(coalesce(len(gone), 0) as bigint) as n_removed,
    sha256(case when c.d is null then array_to_string(words, ' ') else coalesce(k.text, '') end) as kept_sha256
from t left join c using (d) left join k using (d)"""
