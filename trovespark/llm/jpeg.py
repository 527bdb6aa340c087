"""Baseline JPEG: a writer of DC-only greyscale images, and a reader of DC-only luminance thumbnails.

A payload byte is one 8x8 block of its value: the block's quantised DC coefficient is the byte less
128 and its AC coefficients are 0, so any reader of baseline JPEG shows flat blocks, and the DC-only
thumbnail, a sample for each block, is the payload. A row has 64 blocks; a restart marker follows
every 64, so intervals decode independently. A payload longer than one image holds (65,535 lines) is
a series of images. The reader takes any baseline JPEG: it parses the markers and decodes the Huffman
scans of all intervals of all images side by side, a symbol of each interval per step.
"""

from __future__ import annotations

import struct

import numpy as np

ROW = 64
MOST_ROWS = 65535 // 8

#: The zero padding, marker and table layout of baseline JPEG (ITU-T T.81, annexes B and C).
SOI, EOI, SOF0, DHT, DQT, DRI, SOS, RST0 = 0xD8, 0xD9, 0xC0, 0xC4, 0xDB, 0xDD, 0xDA, 0xD0
#: Code lengths of the difference categories 0 to 8 in our DC table, and of the only AC symbol, end of block.
DC_LENGTHS = {0: 5, 1: 4, 2: 3, 3: 3, 4: 2, 5: 3, 6: 6, 7: 2, 8: 7}


def _table(lengths: dict[int, int]) -> tuple[bytes, bytes, dict[int, tuple[int, int]]]:
    """Counts by length, symbols in order, and the canonical code and length of each symbol."""
    order = sorted(lengths, key=lambda s: (lengths[s], s))
    code, at, codes = 0, 0, {}
    for s in order:
        code <<= lengths[s] - at
        at = lengths[s]
        codes[s] = (code, at)
        code += 1
    return bytes(sum(n == k for n in lengths.values()) for k in range(1, 17)), bytes(order), codes


def _difference_codes() -> tuple[np.ndarray, np.ndarray]:
    """Bits and their number for every DC difference from -255 to 255, the end of block included (one 0 bit)."""
    _, _, codes = _table(DC_LENGTHS)
    bits, size = np.zeros(511, np.uint32), np.zeros(511, np.int64)
    for d in range(-255, 256):
        k = abs(d).bit_length()
        code, n = codes[k]
        bits[d + 255], size[d + 255] = ((code << k) | ((d if d > 0 else d + (1 << k) - 1) if k else 0)) << 1, n + k + 1
    return bits, size


_BITS, _SIZE = _difference_codes()


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def header(rows: int) -> bytes:
    dc, ac = _table(DC_LENGTHS), (bytes([1] + [0] * 15), b"\0")
    return (
        struct.pack(">BB", 0xFF, SOI)
        + _segment(DQT, bytes([0] + [8] + [1] * 63))
        + _segment(SOF0, struct.pack(">BHHB3B", 8, rows * 8, ROW * 8, 1, 1, 0x11, 0))
        + _segment(DHT, b"\x00" + dc[0] + dc[1])
        + _segment(DHT, b"\x10" + ac[0] + ac[1])
        + _segment(DRI, struct.pack(">H", ROW))
        + _segment(SOS, bytes([1, 1, 0, 0, 63, 0]))
    )


def encode_rows(samples: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Entropy-coded intervals of rows of 64 samples: all their bytes, stuffed, and how many each has."""
    n = len(samples)
    v = samples.astype(np.int16)
    d = np.empty((n, ROW), np.int16)
    d[:, 0] = v[:, 0] - 128
    d[:, 1:] = v[:, 1:] - v[:, :-1]
    d += 255
    bits, size = _BITS[d], _SIZE[d]
    upto = np.cumsum(size, axis=1)
    row_bytes = (upto[:, -1] + 7) >> 3
    start = np.concatenate([[0], np.cumsum(row_bytes)])
    at = (upto - size) + (start[:-1] << 3)[:, None]
    word = bits.astype(np.uint64) << (32 - size - (at & 7)).astype(np.uint64)  # at most 15 bits after 7
    at = (at >> 3).ravel()
    out = np.zeros(start[-1] + 4, np.float64)
    for k in range(3):
        out += np.bincount(at + k, ((word >> np.uint64(24 - 8 * k)) & np.uint64(255)).ravel(), len(out))
    out = out[: start[-1]].astype(np.uint8)
    spare = (row_bytes << 3) - upto[:, -1]
    out[start[1:] - 1] |= ((1 << spare) - 1).astype(np.uint8)  # padded with ones
    full = out == 0xFF
    if full.any():
        stuffed = np.zeros(len(out) + int(full.sum()), np.uint8)
        to = np.arange(len(out)) + np.concatenate([[0], np.cumsum(full)[:-1]])
        stuffed[to] = out
        row_bytes = row_bytes + np.add.reduceat(full.astype(np.int64), start[:-1])
        out = stuffed
    return out, row_bytes


def store(payloads: list[bytes]) -> list[bytes]:
    """Payloads (lengths positive multiples of 64) as JPEG; each is a series of images if it is long."""
    if not payloads:
        return []
    samples = np.frombuffer(b"".join(payloads), np.uint8).reshape(-1, ROW)
    data, sizes = [], []
    for at in range(0, len(samples), 1 << 14):
        d, s = encode_rows(samples[at : at + (1 << 14)])
        data.append(d)
        sizes.append(s)
    data, sizes = np.concatenate(data), np.concatenate(sizes)
    ends = np.cumsum(sizes)
    marked = np.empty(len(data) + 2 * len(sizes), np.uint8)  # every interval followed by a marker
    row = np.repeat(np.arange(len(sizes)), sizes)
    marked[np.arange(len(data)) + 2 * row] = data
    marker_at = ends + 2 * np.arange(len(sizes))
    rows = np.array([len(p) // ROW for p in payloads])
    first = np.concatenate([[0], np.cumsum(rows)[:-1]])
    within = (np.arange(len(sizes)) - np.repeat(first, rows)) % MOST_ROWS
    marked[marker_at], marked[marker_at + 1] = 0xFF, RST0 + within % 8
    raw, begins = marked.tobytes(), marker_at - sizes
    heads, out = {}, []
    for f, n in zip(first, rows, strict=True):
        parts = []
        for r in range(f, f + n, MOST_ROWS):
            k = int(min(MOST_ROWS, f + n - r))
            if k not in heads:
                heads[k] = header(k)
            parts.append(heads[k] + raw[begins[r] : marker_at[r + k - 1]] + b"\xff\xd9")
        out.append(b"".join(parts))
    return out


def _lookup(counts: bytes, symbols: bytes) -> np.ndarray:
    """For every 16 bits: symbol + 256 * code length; 0 where there is no code."""
    out, code, i = np.zeros(1 << 16, np.int32), 0, 0
    for n in range(1, 17):
        for _ in range(counts[n - 1]):
            out[code << (16 - n) : (code + 1) << (16 - n)] = symbols[i] + 256 * n
            code, i = code + 1, i + 1
        code <<= 1
    return out


class Frame:
    """One image of a stream: its size, components and the intervals of its scan."""

    def __init__(self) -> None:
        self.width = self.height = self.restart = 0
        self.components: list[tuple[int, int, int, int]] = []  # id, horizontal, vertical, quantiser
        self.quant: dict[int, int] = {}
        self.tables: dict[int, bytes] = {}
        self.scan: list[tuple[int, int, int]] = []  # component's place, DC table, AC table
        self.spans: list[tuple[int, int]] = []


def parse(data: bytes, whole: np.ndarray) -> list[Frame]:
    """The frames of a JPEG stream. whole: the same bytes as an array. Truncated, foreign or malformed data gives the frames before it."""
    out: list[Frame] = []
    try:
        _frames(data, whole, out)
    except (IndexError, ValueError, struct.error):  # a segment that doesn't hold what it should
        pass
    return [f for f in out if f.components and f.scan and all({d, 16 + a} <= f.tables.keys() for _, d, a in f.scan)]


def _frames(data: bytes, whole: np.ndarray, out: list[Frame]) -> None:
    at, frame = 0, None
    ff = np.flatnonzero(whole[:-1] == 0xFF)
    marks = ff[(whole[ff + 1] != 0) & (whole[ff + 1] != 0xFF)]
    while at + 2 <= len(data) and data[at] == 0xFF:
        m = data[at + 1]
        if m == 0xFF:
            at += 1
            continue
        if m == SOI:
            frame, at = Frame(), at + 2
            continue
        if m == EOI:
            if frame is not None and frame.spans:
                out.append(frame)
            frame, at = None, at + 2
            continue
        if frame is None or at + 4 > len(data):
            break
        n = struct.unpack(">H", data[at + 2 : at + 4])[0]
        body, at = data[at + 4 : at + 2 + n], at + 2 + n
        if m == DQT:
            while body:
                wide = body[0] >> 4
                frame.quant[body[0] & 15] = struct.unpack(">H", body[1:3])[0] if wide else body[1]
                body = body[65 + 64 * bool(wide) :]
        elif m == SOF0:
            _, frame.height, frame.width, k = struct.unpack(">BHHB", body[:6])
            frame.components = [(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(k)]
        elif m in (0xC1, 0xC2, 0xC3) or 0xC5 <= m <= 0xCF and m not in (0xC8, 0xCC):
            break  # another kind of JPEG
        elif m == DHT:
            while body:
                k = sum(body[1:17])
                frame.tables[body[0]] = body[1 : 17 + k]
                body = body[17 + k :]
        elif m == DRI:
            frame.restart = struct.unpack(">H", body[:2])[0]
        elif m == SOS:
            ids = [c[0] for c in frame.components]
            frame.scan = [(ids.index(body[1 + 2 * i]), body[2 + 2 * i] >> 4, body[2 + 2 * i] & 15) for i in range(body[0])]
            i = int(np.searchsorted(marks, at))
            later = marks[i:]
            stop = np.flatnonzero((whole[later + 1] < RST0) | (whole[later + 1] > RST0 + 7))
            ends = later[: stop[0] + 1] if len(stop) else np.append(later, len(data))
            starts = np.concatenate([[at], ends[:-1] + 2])
            frame.spans = list(zip(starts.tolist(), ends.tolist(), strict=True))
            at = int(ends[-1])


def _decode(data: np.ndarray, spans: np.ndarray, plan: list[tuple[int, np.ndarray, np.ndarray]], blocks: int, luminance: int) -> np.ndarray:
    """DC coefficients of the luminance blocks of intervals that share a plan, as an array interval x block.

    plan: per block of an MCU its component and its DC and AC lookups; blocks: of an interval at most.
    An interval that ends early repeats zeros.
    """
    size = spans[:, 1] - spans[:, 0]
    clean = np.concatenate([data[a:b] for a, b in spans] + [np.full(8, 255, np.uint8)]) if len(spans) < 64 or (spans[1:, 0] - spans[:-1, 1]).max() > 2000 else None
    if clean is None:  # intervals that follow each other: one mask instead of many slices
        edge = np.zeros(spans[-1, 1] - spans[0, 0] + 1, np.int8)
        np.add.at(edge, spans[:, 0] - spans[0, 0], 1)
        np.add.at(edge, spans[:, 1] - spans[0, 0], -1)
        clean = np.concatenate([data[spans[0, 0] : spans[-1, 1]][np.cumsum(edge[:-1], dtype=np.int8) > 0], np.full(8, 255, np.uint8)])
    keep = np.ones(len(clean), bool)
    keep[1:] = ~((clean[1:] == 0) & (clean[:-1] == 0xFF))  # stuffing
    start = np.concatenate([[0], np.cumsum(size)])
    gone = np.concatenate([[0], np.cumsum(~keep)])
    pos = (start[:-1] - gone[start[:-1]]).astype(np.int64) * 8
    limit = (start[1:] - gone[start[1:]]).astype(np.int64) * 8
    clean = clean[keep]
    b = clean.astype(np.uint32)
    word = (b[:-3] << 24) | (b[1:-2] << 16) | (b[2:-1] << 8) | b[3:]
    last = len(word) - 1

    def peek(at: np.ndarray, n: int | np.ndarray) -> np.ndarray:
        """n bits from each position, 16 at most."""
        return ((word[np.minimum(at >> 3, last)] << (at & 7).astype(np.uint32)) >> np.uint32(16)).astype(np.int64) >> (16 - n)

    components = max(c for c, _, _ in plan) + 1
    before = np.zeros((components, len(spans)), np.int64)
    out = np.zeros((len(spans), blocks * sum(c == luminance for c, _, _ in plan)), np.int32)
    column = 0
    for _ in range(blocks):
        for c, dc, ac in plan:
            got = dc[peek(pos, 16)]
            pos = pos + (got >> 8)
            k = (got & 255).astype(np.int64)
            v = peek(pos, k)
            before[c] += np.where((v << 1) < (1 << k), v - (1 << k) + 1, v)
            pos = pos + k
            got = ac[peek(pos, 16)]
            pos = pos + (got >> 8)
            at, open_ = np.ones(len(spans), np.int64), np.flatnonzero((got & 255) != 0)
            while len(open_):  # blocks with AC coefficients: run past them
                s = (got[open_] & 255).astype(np.int64)
                pos[open_] += s & 15
                at[open_] += (s >> 4) + 1
                open_ = open_[at[open_] < 64]
                got_ = ac[peek(pos[open_], 16)]
                pos[open_] += got_ >> 8
                got = np.array(got)
                got[open_] = got_
                open_ = open_[((got_ & 255) != 0) & (pos[open_] <= limit[open_])]
            if c == luminance:
                out[:, column] = before[c]
                column += 1
    return out


def thumbnails(images: list[bytes]) -> list[tuple[np.ndarray, list[tuple[int, int]]]]:
    """Of each JPEG stream the DC-only luminance thumbnail (a sample for each 8x8 block, frames one below the other) and the frames' sizes."""
    data = np.frombuffer(b"".join(images), np.uint8)
    at, frames = 0, []
    for i, raw in enumerate(images):
        frames += [(i, at, f) for f in parse(raw, data[at : at + len(raw)])] if raw else []
        at += len(raw)
    jobs: dict[tuple, list[int]] = {}
    shapes = []
    for k, (_, _, f) in enumerate(frames):
        sample = [f.components[c] for c, _, _ in f.scan]
        h, v = (max(c[1] for c in f.components), max(c[2] for c in f.components)) if len(f.scan) > 1 else (1, 1)
        across, down = -(-f.width // (8 * h)), -(-f.height // (8 * v))
        plan = tuple((n, c, d, a) for n, (c, d, a) in enumerate(f.scan) for _ in range(sample[n][1] * sample[n][2] if len(f.scan) > 1 else 1))
        per = f.restart or across * down
        shapes.append((across, down, sample[0][1] if len(f.scan) > 1 else 1, sample[0][2] if len(f.scan) > 1 else 1, per))
        jobs.setdefault((plan, tuple(sorted(f.tables.items())), per), []).append(k)
    grids: dict[int, np.ndarray] = {}
    for (plan, tables, per), members in jobs.items():
        t = {k: _lookup(v[:16], v[16:]) for k, v in tables}
        spans = np.array([(a + frames[k][1], b + frames[k][1]) for k in members for a, b in frames[k][2].spans], np.int64)
        dc = _decode(data, spans, [(n, t[d], t[16 + a]) for n, _, d, a in plan], per, 0)
        row = 0
        for k in members:
            across, down, h, v, _ = shapes[k]
            n = len(frames[k][2].spans)
            mcus = dc[row : row + n].reshape(-1, v, h)[: across * down]
            row += n
            if len(mcus) < across * down:
                mcus = np.concatenate([mcus, np.zeros((across * down - len(mcus), v, h), np.int32)])
            q = frames[k][2].quant.get(frames[k][2].components[frames[k][2].scan[0][0]][3], 1)
            grid = mcus.reshape(down, across, v, h).transpose(0, 2, 1, 3).reshape(down * v, across * h)
            grids[k] = np.clip(np.round(grid * q / 8) + 128, 0, 255).astype(np.uint8)[: -(-frames[k][2].height // 8), : -(-frames[k][2].width // 8)]
    out = []
    of: dict[int, list[int]] = {}
    for k, (i, _, _) in enumerate(frames):
        of.setdefault(i, []).append(k)
    for i in range(len(images)):
        ks = of.get(i, [])
        same = len({grids[k].shape[1] for k in ks}) == 1
        out.append((np.concatenate([grids[k] for k in ks]) if same else grids[ks[0]] if ks else np.zeros((0, 0), np.uint8), [(frames[k][2].width, frames[k][2].height) for k in ks]))
    return out


def thumbnail_hash(grid: np.ndarray, side: int = 8) -> str:
    """A 64-bit average hash: the thumbnail averaged to 8x8 cells, a bit for each cell above their mean."""
    if not grid.size:
        return "0" * 16
    rows, cols = (np.minimum(np.arange(side) * n // side, n - 1) for n in grid.shape)
    height = np.diff(np.append(rows, grid.shape[0]))
    sums = np.add.reduceat(np.add.reduceat(grid, rows, axis=0, dtype=np.int64), cols, axis=1)
    area = np.maximum(height, 1)[:, None] * np.maximum(np.diff(np.append(cols, grid.shape[1])), 1)
    mean = sums / area
    return np.packbits(mean > mean.mean()).tobytes().hex()
