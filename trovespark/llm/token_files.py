"""Token ids in flat binary files with 64-bit document offsets, written and memory-mapped by Spark tasks.

A part holds the documents of one range of doc_id, ascending, in three files: part-N.ids, the ids of
all its documents one behind the other as little-endian unsigned integers of one width; part-N.offsets,
where each document's ids begin and, last, where they end, as 64-bit integers; part-N.docs, the
doc_ids, of which the first, as many as the manifest's nulls says, are null (0 in the file). A part's
base in the whole corpus is the prefix sum of the counts of the parts before it. A file is written
under a name of the task attempt's own and then renamed, so a task may run twice.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trovespark.llm.common import in_arrow, new_scratch, range_parts, with_text, written
from trovespark.llm.tokens import crc32_of, encoder, runs

MANIFEST = "part long, documents long, nulls long, ids long, width int, path string"
PARTS_EACH = 2048  # parts whose counts are summed together
TASK_BYTES = 1 << 25


def _store(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (pafs.LocalFileSystem(), uri)


def _mapped(uri: str, dtype: str) -> np.ndarray:
    """The file as an array: memory-mapped where the folder is mounted, else read."""
    store, path = _store(uri)
    if not store.get_file_info(path).size:
        return np.zeros(0, dtype)
    if isinstance(store, pafs.LocalFileSystem):
        return np.memmap(path, dtype, "r")
    with store.open_input_file(path) as f:
        return np.frombuffer(f.read(), dtype)


class _Part:
    """The three files of a part, while they grow."""

    def __init__(self, folder: str, part: int) -> None:
        self.store, path = _store(folder)
        self.store.create_dir(path, recursive=True)
        self.part, self.uri, self.path, self.own = part, f"{folder}/part-{part:08d}", f"{path}/part-{part:08d}", uuid.uuid4().hex
        self.ids = self.store.open_output_stream(f"{self.path}.ids.{self.own}")
        self.offsets, self.docs, self.nulls = [0], [], 0

    def add(self, doc_id: int | None, ids: bytes, width: int) -> None:
        self.ids.write(ids)
        self.offsets.append(self.offsets[-1] + len(ids) // width)
        self.docs.append(doc_id or 0)
        self.nulls += doc_id is None

    def close(self, width: int) -> tuple:
        self.ids.close()
        for kind, values in (("offsets", self.offsets), ("docs", self.docs)):
            with self.store.open_output_stream(f"{self.path}.{kind}.{self.own}") as f:
                f.write(np.array(values, "<i8").tobytes())
        for kind in ("ids", "offsets", "docs"):
            self._rename(f"{self.path}.{kind}.{self.own}", f"{self.path}.{kind}")
        return self.part, len(self.docs), self.nulls, self.offsets[-1], width, self.uri

    def _rename(self, own: str, name: str) -> None:
        """An earlier attempt of the task may have left the same file, which some stores don't replace."""
        try:
            self.store.move(own, name)
        except OSError:
            if self.store.get_file_info(name).size != self.store.get_file_info(own).size:
                raise
            self.store.delete_file(own)


def write_tokens(docs: DataFrame, tokenizer: str, folder: str, end_id: int | None = 0, rows_each: int = 2000) -> DataFrame:
    """Encodes every text (null: empty), writes the parts to folder and returns their manifest.

    folder is a URI that all executors reach. Texts are encoded where they are read; the ids alone
    are shuffled, by ranges of doc_id. Null doc_ids come first.
    """

    def encode(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer, end_id)
        for b in it:
            for at, to in runs(pc.binary_length(b.column(2)).to_pylist()):
                ids, upto = enc.encode(b.column(2)[at:to])
                raw = pa.Array.from_buffers(pa.large_binary(), to - at, [None, pa.py_buffer(upto * enc.dtype.itemsize), pa.py_buffer(ids)])
                yield pa.record_batch([b.column(0)[at:to], b.column(1)[at:to], raw.cast(pa.binary())], ["part", "doc_id", "ids"])

    def write(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width, now, done = encoder(tokenizer, end_id).dtype.itemsize, None, []
        for b in it:
            for part, doc_id, ids in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                if now is None or now.part != part:
                    done += [now.close(width)] if now else []
                    now = _Part(folder, part)
                now.add(doc_id, ids.as_py(), width)
        done += [now.close(width)] if now else []
        if done:
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*done, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.string()), strict=True)], ["part", "documents", "nulls", "ids", "width", "path"])

    placed = range_parts(docs.select("doc_id"), "doc_id", rows_each)(with_text(docs)).select("part", "doc_id", "text")
    ids = in_arrow(placed, encode, "part long, doc_id long, ids binary")
    return written(ids.repartition("part").sortWithinPartitions("part", "doc_id", "ids").mapInArrow(write, MANIFEST), "token-manifest")


def read_tokens(manifest: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the files of the manifest's parts."""

    def read(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            for r in b.to_pylist():
                ids, offsets, docs = _mapped(r["path"] + ".ids", f"<u{r['width']}"), _mapped(r["path"] + ".offsets", "<i8"), _mapped(r["path"] + ".docs", "<i8")
                for at in range(0, len(docs), 8192):
                    o = offsets[at : at + 8193]
                    crcs = [crc32_of(ids[i:j]) for i, j in zip(o[:-1], o[1:], strict=True)]
                    unnamed = np.arange(at, at + len(crcs)) < r["nulls"]
                    yield pa.record_batch([pa.array(docs[at : at + 8192], mask=unnamed), pa.array(o[:-1] + r["base"]), pa.array(np.diff(o)), pa.array(crcs, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    counted = manifest.withColumn("block", F.floor(F.col("part") / PARTS_EACH))
    blocks = counted.groupBy("block").agg(F.sum("ids").alias("block_ids"))  # a row for each PARTS_EACH parts
    blocks = blocks.select("block", (F.sum("block_ids").over(Window.orderBy("block")) - F.col("block_ids")).alias("block_base"))
    before = F.sum("ids").over(Window.partitionBy("block").orderBy("part")) - F.col("ids")
    based = counted.withColumn("before", before).join(blocks, "block").withColumn("base", F.col("block_base") + F.col("before"))
    size = manifest.agg(F.sum(F.col("ids") * F.col("width"))).first()[0] or 0
    tasks = max(2 * manifest.sparkSession.sparkContext.defaultParallelism, -(-size // TASK_BYTES))
    return in_arrow(based.repartition(tasks, "part").select("path", "width", "nulls", "base"), read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_files(docs: DataFrame, tokenizer: str, end_id: int = 0, rows_each: int = 2000) -> DataFrame:
    """The digest of every document, read back from files in the shared folder.

    An empty or null text is the end id alone; repeated rows are documents of their own, side by side;
    an empty table writes no part and gives no rows; other columns are ignored.
    """
    return read_tokens(write_tokens(docs, tokenizer, new_scratch(docs.sparkSession, "token-files"), end_id, rows_each))
