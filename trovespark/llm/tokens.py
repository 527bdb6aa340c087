"""Token ids with the tokenizers library.

The byte-level BPE merges nothing across the pieces its pattern cuts a text into, and a piece never
spans a space before a non-space. So a text is cut there, into chunks that encode alone as they do in
the text. Chunks repeat: of each batch Arrow finds the distinct ones, a bounded table of each worker
gives the ids of those it has met, the library's model encodes the pieces of new ones, and numpy
gathers the ids of the batch. Texts that hold an added token's string, and vocabularies of another
kind, go to the library whole.
"""

from __future__ import annotations

import os
import re
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_LETTER, _DIGIT, _SPACE = "A-Za-zªµºÀ-ÖØ-öø-ƿǄ-ɏ", "0-9²³¹¼-¾", "\\t-\\r \x85\xa0"
_LATIN = re.compile("[\0-ƿǄ-ɏ]*")
_PIECE = re.compile(f"'(?:[stmd]|re|ve|ll)| ?[{_LETTER}]+| ?[{_DIGIT}]+| ?[^{_SPACE}{_LETTER}{_DIGIT}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+")
#: A space that no chunk may be cut at; all other spaces begin a chunk.
_KEPT_SPACE = " (?:[\\s\\x0b\\x1c-\\x1f\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]|$)"
_BEFORE_CHUNK = re.compile(r"(?= \S)")

#: Bytes that byte-level vocabularies show as themselves; the others are shown as code points from 256 on, in order.
SHOWN = (*range(33, 127), *range(161, 173), *range(174, 256))
_ALPHABET = {b: b for b in SHOWN} | {b: 256 + i for i, b in enumerate(sorted(set(range(256)) - set(SHOWN)))}


def shown(piece: str) -> str:
    """The piece in the alphabet of byte-level vocabularies."""
    if piece.isascii() and piece.isprintable():
        return piece.replace(" ", chr(_ALPHABET[32]))
    return piece.encode().decode("latin-1").translate(_ALPHABET)


def runs(lengths: list[int], size: int = 1 << 22) -> Iterator[tuple[int, int]]:
    """(start, stop) of runs of values whose lengths sum to about size."""
    at = 0
    while at < len(lengths):
        to, n = at + 1, lengths[at]
        while to < len(lengths) and n + lengths[to] <= size:
            n += lengths[to]
            to += 1
        yield at, to
        at = to


class Encoder:
    """Ids of whole texts, of dtype; path names a file of the tokenizers library.

    special_as_text: whether the strings of added tokens in a text are ordinary text; else they become
    those tokens, as is the library's default. most bounds the tables of chunks and pieces.
    """

    def __init__(self, path: str, end_id: int | None = 0, special_as_text: bool = False, most: int = 500_000) -> None:
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = special_as_text
        by, size = self.tokenizer.pre_tokenizer, max(self.tokenizer.get_vocab_size(), (end_id or 0) + 1)
        self.cuts = isinstance(by, pre_tokenizers.ByteLevel) and by.use_regex and not by.add_prefix_space and self.tokenizer.normalizer is None
        self.model, self.dtype, self.end_id, self.most = self.tokenizer.model, np.dtype("<u2" if size <= 1 << 16 else "<u4"), end_id, most
        self.added = [] if special_as_text else [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.code = {2: "H", 4: "I"}[self.dtype.itemsize]
        self.pieces: dict[str, bytes] = {}
        self.inner: dict[str, int] = {}  # rows of chunks by what follows their space
        self.first: dict[str, int] = {}  # rows of chunks that begin a text
        self.ids, self.start, self.size = np.zeros(0, self.dtype), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self._add([self._raw([] if end_id is None else [end_id])])  # row 0 ends a text

    def _raw(self, ids: list[int]) -> bytes:
        return array(self.code, ids).tobytes()

    def _add(self, raws: list[bytes]) -> None:
        size = np.fromiter(map(len, raws), np.int64, len(raws)) // self.dtype.itemsize
        self.start = np.append(self.start, len(self.ids) + np.cumsum(size) - size)
        self.size = np.append(self.size, size)
        self.ids = np.append(self.ids, np.frombuffer(b"".join(raws), self.dtype))

    def _piece(self, piece: str) -> bytes:
        raw = self.pieces[piece] = self._raw([t.id for t in self.model.tokenize(shown(piece))])
        return raw

    def _chunk(self, chunk: str) -> bytes:
        if not chunk.isascii() and not _LATIN.fullmatch(chunk):  # cutting it needs tables of character classes, which the library has
            return self._raw(self.tokenizer.encode([chunk], is_pretokenized=True, add_special_tokens=False).ids)
        cut, known = _PIECE.findall(chunk), self.pieces.get
        return b"".join([known(p) or self._piece(p) for p in cut])

    def _rows(self, table: dict[str, int], chunks: list[str], space: str) -> np.ndarray:
        """The rows of distinct chunks, new ones learnt."""
        rows = np.fromiter((table.get(c, -1) for c in chunks), np.int64, len(chunks))
        new = np.flatnonzero(rows < 0).tolist()
        if new:
            rows[new] = range(len(self.size), len(self.size) + len(new))
            table.update((chunks[i], int(rows[i])) for i in new)
            self._add([self._chunk(space + chunks[i]) for i in new])
        return rows

    def _gathered(self, rows: np.ndarray) -> np.ndarray:
        size = self.size[rows]
        return self.ids[np.repeat(self.start[rows] - np.cumsum(size) + size, size) + np.arange(size.sum())]

    def _cut(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        words = pc.split_pattern(texts, " ")
        n = words.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        coded = words.flatten().dictionary_encode()
        rows = self._rows(self.inner, coded.dictionary.to_numpy(zero_copy_only=False).tolist(), " ")[coded.indices.to_numpy()]
        begins = np.cumsum(n) - n
        heads = pc.list_element(words, 0).dictionary_encode()
        rows[begins] = self._rows(self.first, heads.dictionary.to_numpy(zero_copy_only=False).tolist(), "")[heads.indices.to_numpy()]
        ended = np.zeros(len(rows) + len(n), np.int64)  # row 0 behind each text
        ended[np.arange(len(rows)) + np.repeat(np.arange(len(n)), n)] = rows
        upto = np.concatenate([[0], np.cumsum(self.size[ended])])
        return self._gathered(ended), upto[np.concatenate([[0], np.cumsum(n + 1)])]

    def _alone(self, text: str) -> np.ndarray:
        end = [] if self.end_id is None else [self.end_id]
        if not self.cuts or any(a in text for a in self.added):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids + end, self.dtype)
        chunks = [c for c in _BEFORE_CHUNK.split(text) if c]
        names = list(dict.fromkeys(chunks))
        row = dict(zip(names, self._rows(self.first, names, "").tolist(), strict=True))
        return self._gathered(np.array([*map(row.__getitem__, chunks), 0], np.int64))

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids, offsets) of texts, the end id behind each. Full tables keep what they have, mostly frequent chunks, and forget later ones."""
        held, known = len(self.size), len(self.pieces)
        alone = pc.match_substring_regex(texts, _KEPT_SPACE).to_numpy(zero_copy_only=False).astype(bool) if self.cuts else np.ones(len(texts), bool)
        for a in self.added if self.cuts else ():
            alone |= pc.match_substring(texts, a).to_numpy(zero_copy_only=False).astype(bool)
        if not alone.any():
            out = self._cut(texts)
        else:
            ids, upto = self._cut(texts.filter(pa.array(~alone))) if not alone.all() else (np.zeros(0, self.dtype), [0])
            spans = iter(zip(upto[:-1], upto[1:], strict=True))
            parts = [self._alone(texts[i].as_py()) if odd else ids[slice(*next(spans))] for i, odd in enumerate(alone)]
            out = np.concatenate(parts), np.concatenate([[0], np.cumsum([len(p) for p in parts])])
        if len(self.size) > self.most:
            for table in (self.inner, self.first):
                while table and next(reversed(table.values())) >= held:
                    table.popitem()
            self.ids, self.start, self.size = self.ids[: self.start[held]] if held < len(self.start) else self.ids, self.start[:held], self.size[:held]
        while len(self.pieces) > max(self.most, known):
            self.pieces.popitem()
        return out


@lru_cache(maxsize=2)
def encoder(path: str, end_id: int | None = 0, special_as_text: bool = False) -> Encoder:
    """One for each Python worker, which runs many tasks."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return Encoder(path, end_id, special_as_text)


def crc32_of(ids: np.ndarray) -> int:
    """crc32 of ids as little-endian unsigned 32-bit integers."""
    return zlib.crc32(ids.astype("<u4").tobytes())
