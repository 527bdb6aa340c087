"""Glossary expansion for glossaries of any size: every stretch of a prompt that is as long as some alias is looked up among the aliases' hashes."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trovespark.sources.scratch import kept

#: Bytes of aliases and keywords that tasks hold at a time; a larger glossary goes over the prompts in blocks of entries, one after the other.
BLOCK_CHARS = 64 << 20
#: Bytes of text that are looked up at a time.
TEXT_BYTES = 1 << 18
#: Keywords that a task holds before it passes rows on: the more entries share an alias, the longer are the lists.
KEYWORDS = 100_000
BASE = 0x9E3779B97F4A7C15
_BUILT: dict[str, Aliases] = {}


def window_hashes(text: np.ndarray, size: int) -> np.ndarray:
    """The hashes of all stretches of size bytes, by doubling; none if the text is shorter."""
    n = len(text) - size + 1
    if n < 1:
        return np.zeros(0, np.uint64)
    part, width, factor = text.astype(np.uint64) + np.uint64(1), 1, BASE
    out, done = np.zeros(len(text), np.uint64), 0
    while True:
        if size & width:
            out = out[: len(part) - done] * np.uint64(factor) + part[done : done + len(out)] if done else part
            done += width
        if 2 * width > size:
            break
        part = part[:-width] * np.uint64(factor) + part[width:]
        width, factor = 2 * width, factor * factor & (1 << 64) - 1
    out = out[:n]
    return out ^ (out >> np.uint64(29))


class Aliases:
    """The aliases of a block of entries in flat arrays: for each length in bytes the sorted hashes and where each stands; the entries of equal aliases lie together."""

    def __init__(self, parts: list[bytes]) -> None:
        table = pa.concat_tables([pa.ipc.open_stream(p).read_all() for p in parts]).combine_chunks()
        lists = table["aliases"].combine_chunks()
        sizes = lists.value_lengths().to_numpy()
        names = lists.flatten().cast(pa.large_binary())
        self.keywords = table["keywords"].combine_chunks()
        starts = np.frombuffer(names.buffers()[1], np.int64)[names.offset : names.offset + len(names) + 1]
        self.data = np.frombuffer(names.buffers()[2] or b"", np.uint8)
        owners = np.repeat(np.arange(len(lists), dtype=np.int32), sizes)
        lengths = np.diff(starts)
        self.by_size, self.owners, self.first, n = {}, [], [np.zeros(1, np.int64)], 0
        for size in np.unique(lengths).tolist():
            mine = np.flatnonzero(lengths == size)
            hashes = self._hashes(starts[mine], size)
            order = np.argsort(hashes, kind="stable")
            hashes, at = hashes[order], starts[mine][order]
            new = np.concatenate([[True], hashes[1:] != hashes[:-1]])
            for i in range(1, len(at), rows := max(1, TEXT_BYTES // size)):  # of equal hashes only equal aliases are one
                some = slice(i, i + rows)
                new[some] |= (self._bytes(at[some], size) != self._bytes(at[i - 1 : i + rows - 1][: len(at[some])], size)).any(axis=1)
            heads = np.flatnonzero(new)
            bits = max(16, int(4 * len(heads)).bit_length())
            seen = np.zeros(1 << bits, bool)
            seen[(hashes[heads] >> np.uint64(64 - bits)).astype(np.int64)] = True
            self.by_size[size] = (hashes[heads], at[heads], n, seen, np.uint64(64 - bits))
            self.owners.append(owners[mine][order])
            self.first.append(np.append(heads[1:], len(at)) + sum(len(x) for x in self.owners[:-1]))
            n += len(heads)
        self.owners, self.first = np.concatenate(self.owners), np.concatenate(self.first)

    def _bytes(self, starts: np.ndarray, size: int) -> np.ndarray:
        return self.data[starts[:, None] + np.arange(size)]

    def _hashes(self, starts: np.ndarray, size: int) -> np.ndarray:
        """The hashes of aliases of one length, some rows at a time."""
        out, rows = [], max(1, TEXT_BYTES // size)
        for at in range(0, len(starts), rows):
            text = self._bytes(starts[at : at + rows], size).ravel()
            out.append(window_hashes(text, size)[::size])
        return np.concatenate(out)

    def found(self, whole: np.ndarray) -> Iterator[tuple[np.ndarray, int, np.ndarray]]:
        """(places, size, aliases): where in the text aliases of that size begin, and their numbers; a hash that meets is compared byte by byte."""
        for (size, (hashes, starts, first, seen, shift)), offset in product(self.by_size.items(), range(0, len(whole), TEXT_BYTES)):
            text = whole[offset : offset + TEXT_BYTES + size - 1]
            h = window_hashes(text, size)
            at = np.flatnonzero(seen[(h >> shift).astype(np.int64)])
            low, high = (np.searchsorted(hashes, h[at], side) for side in ("left", "right"))
            while (met := high > low).any():  # once, but for aliases that share a hash
                at, low, high = at[met], low[met], high[met]
                for i in range(0, len(at), rows := max(1, TEXT_BYTES // size)):
                    a, g = at[i : i + rows], low[i : i + rows]
                    same = (text[a[:, None] + np.arange(size)] == self._bytes(starts[g], size)).all(axis=1)
                    yield offset + a[same], size, first + g[same]
                low = low + 1

    def entries(self, numbers: np.ndarray) -> np.ndarray:
        """The entries that have any of the aliases, ascending."""
        return np.unique(np.concatenate([self.owners[self.first[i] : self.first[i + 1]] for i in numbers])) if len(numbers) else numbers


def aliases_of(block: Broadcast, key: str) -> Aliases:
    """The block's aliases; a worker builds those of a key once and holds one block at a time."""
    if key not in _BUILT:
        _BUILT.clear()
        _BUILT[key] = Aliases(block.value)
    return _BUILT[key]


def entries_of(texts: pa.Array, aliases: Aliases) -> Iterator[np.ndarray]:
    """For each text the entries of which it holds an alias, ascending. Texts are put together, a zero byte between them, up to TEXT_BYTES, so that many short ones cost no more than a long one."""
    held, size = [], 0

    def looked_up() -> Iterator[np.ndarray]:
        ends = np.cumsum([len(t) + 1 for t in held])
        joined = np.frombuffer(b"\0".join(held) + b"\0", np.uint8)
        met = [np.zeros(0, np.int64)]
        for places, length, numbers in aliases.found(joined):
            row = np.searchsorted(ends, places, "right")
            met.append(np.unique((row * np.int64(1 << 32) + numbers)[places + length < ends[row]]))  # an alias with a zero byte may reach from one text into the next
        pairs = np.unique(np.concatenate(met))
        cuts = np.searchsorted(pairs >> 32, np.arange(len(held) + 1))
        yield from (aliases.entries(pairs[a:b] & 0xFFFFFFFF) for a, b in zip(cuts, cuts[1:], strict=False))

    for t in texts:
        held.append(t.as_py())
        size += len(held[-1])
        if size >= TEXT_BYTES:
            yield from looked_up()
            held, size = [], 0
    if held:
        yield from looked_up()


def blocks(glossary: DataFrame) -> Iterator[Broadcast]:
    """The glossary (entry long, aliases, keywords) as broadcasts of BLOCK_CHARS at most (or one part), in order of entry; entries without an alias or keyword are left out. Tasks pack the parts, the driver only passes them on."""
    tidy = lambda c, low: F.array_distinct(F.filter(F.transform(c, lambda x: F.lower(x) if low else F.trim(x)), lambda x: x.isNotNull() & (F.trim(x) != "")))
    rows = glossary.select("entry", tidy("aliases", True).alias("aliases"), tidy("keywords", False).alias("keywords")).where("size(aliases) > 0 and size(keywords) > 0")
    most = BLOCK_CHARS

    def packed(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            step = max(1, b.num_rows * most // (4 * max(1, b.nbytes)))
            for some in (b.slice(i, step) for i in range(0, b.num_rows, step)):
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, some.schema) as out:
                    out.write_batch(some)
                yield pa.record_batch([pa.array([sink.getvalue().to_pybytes()], pa.binary()), pa.array([some.nbytes])], ["part", "size"])

    context, held, size = glossary.sparkSession.sparkContext, [], 0
    for r in rows.orderBy("entry").drop("entry").mapInArrow(packed, "part binary, size long").toLocalIterator():  # a partition at a time; each block leaves the driver as a broadcast
        if held and size + r["size"] > BLOCK_CHARS:
            yield context.broadcast(held)
            held, size = [], 0
        held.append(bytes(r["part"]))
        size += r["size"]
    if held:
        yield context.broadcast(held)


def expand_all(prompts: DataFrame, glossary: DataFrame, text: str = "text") -> DataFrame:
    """prompts with keywords (of every glossary entry one of whose aliases the text contains, case aside, in order of entry, each once) and expanded (the text and the keywords).

    glossary is (entry long, aliases array<string>, keywords array<string>). A task holds one block of it at a time: what a
    block adds is written before the next goes over the prompts. Time grows with the number of the aliases' different lengths. Null texts contain nothing; blank aliases and keywords don't count.
    """

    def adding(df: DataFrame, block: Broadcast) -> DataFrame:
        key = uuid.uuid4().hex  # workers outlive tasks and their objects, whose addresses come again

        def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            aliases = aliases_of(block, key)
            for b in it:
                place, held, more = b.schema.get_field_index("keywords"), 0, []
                for i, (entries, before) in enumerate(zip(entries_of(b.column("_low").cast(pa.binary()), aliases), b.column(place), strict=True), 1):
                    new = aliases.keywords.take(pa.array(entries)).flatten().to_pylist() if len(entries) else []
                    more.append(list(dict.fromkeys([*before.as_py(), *new])))
                    held += len(more[-1])
                    if held > KEYWORDS or i == b.num_rows:
                        yield b.slice(i - len(more), len(more)).set_column(place, "keywords", pa.array(more, pa.list_(pa.string())))
                        held, more = 0, []

        return df.mapInArrow(batches, df.schema)

    out = prompts.withColumns({"_low": F.lower(F.coalesce(F.col(text), F.lit(""))), "keywords": F.array().cast("array<string>")})
    for i, block in enumerate(blocks(glossary)):
        out = adding(kept(out, "expanded") if i else out, block)
    out = out.drop("_low")
    return out.withColumn("expanded", F.concat_ws(" ", F.col(text), F.when(F.size("keywords") > 0, F.array_join("keywords", " "))))
