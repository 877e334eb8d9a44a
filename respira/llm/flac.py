"""Media columns in FLAC: lossless coding of 8-bit PCM in seekable blocks, and its verified decoding.

`encode` writes streams of one channel: marker, STREAMINFO with the MD5 of the samples, a SEEKTABLE of sample offsets,
and frames. A frame is coded in the way that takes fewest bits: a constant, a fixed linear predictor (order 0 to 4) or a
quantised linear predictor with Rice-coded residuals, or the samples as they are. `decode` reads such streams back (any
with one channel of 8 bits; Rice partitions of any order): it checks the CRC-8 of every frame header, the CRC-16 of every
frame and the MD5 of all samples. `read_samples` decodes a range of samples from the nearest seek point.

Both work on all frames of a batch of streams at once, as arrays with a row per frame: Rice codes, predictors and
checksums are stepped through in all rows together, so a loop is as long as a block whatever the number of texts. Batches
are bounded by bytes.

A sample is a byte minus 128. Nulls: a null text is empty, a null doc_id stays null. Every payload has at least PAD bytes.
Repeated rows give equal values. An empty table gives no rows. Columns other than doc_id and text play no part.
"""

from __future__ import annotations

import functools
import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from respira.llm.common import text_bytes

BLOCK = 1024
PAD = 64
SEEK_BLOCKS = 16
RATE = 8000
LPC_ORDER = 4
LPC_BITS = 12
MAX_RICE = 14
BATCH_BYTES = 1_500_000
#: The format's block sizes by code, and taps of the fixed predictors, on the latest sample first.
SIZES = {1: 192, 2: 576, 3: 1152, 4: 2304, 5: 4608, 8: 256, 9: 512, 10: 1024, 11: 2048, 12: 4096, 13: 8192, 14: 16384, 15: 32768}
FIXED = ((), (1,), (2, -1), (3, -3, 1), (4, -6, 4, -1))


def _crc_table(polynomial: int, bits: int) -> np.ndarray:
    top, mask, out = 1 << (bits - 1), (1 << bits) - 1, []
    for byte in range(256):
        crc = byte << (bits - 8)
        for _ in range(8):
            crc = (crc << 1 ^ polynomial if crc & top else crc << 1) & mask
        out.append(crc)
    return np.array(out, dtype=np.int64)


CRC8, CRC16 = _crc_table(0x07, 8).tolist(), _crc_table(0x8005, 16)


def crc16(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """CRC-16 of many stretches of data: a byte of every stretch at a time, the longest stretches first."""
    order = np.argsort(-lengths, kind="stable")
    at, left = starts[order].copy(), lengths[order]
    crc = np.zeros(len(at), dtype=np.int64)
    longest = int(left[0]) if len(left) else 0
    alive = np.searchsorted(-left, -np.arange(1, longest + 1), side="right")
    for n in alive.tolist():
        c = crc[:n]
        crc[:n] = (c << 8) & 0xFFFF ^ CRC16[(c >> 8) ^ data[at[:n]]]
        at[:n] += 1
    out = np.empty_like(crc)
    out[order] = crc
    return out


def _coded_number(n: int) -> bytes:
    """A frame number in the format's extended UTF-8."""
    if n < 0x80:
        return bytes([n])
    tail = 1
    while n >> (6 * tail + (6 - tail)):
        tail += 1
    lead = (0xFF00 >> (tail + 1)) & 0xFF | n >> (6 * tail)
    return bytes([lead] + [0x80 | n >> (6 * i) & 0x3F for i in reversed(range(tail))])


def _decoded_number(data: bytes, at: int) -> tuple[int, int]:
    """(number, bytes); (-1, 0) if it is none."""
    first = data[at]
    ones = next((i for i in range(8) if not first & 0x80 >> i), 8)
    if ones == 0:
        return first, 1
    tail = data[at + 1 : at + ones]
    if ones in (1, 8) or len(tail) < ones - 1 or any(b & 0xC0 != 0x80 for b in tail):
        return -1, 0
    n = first & 0xFF >> (ones + 1)
    for b in tail:
        n = n << 6 | b & 0x3F
    return n, ones


def _crc8(raw: bytes) -> int:
    crc = 0
    for byte in raw:
        crc = CRC8[crc ^ byte]
    return crc


@functools.lru_cache(maxsize=4096)
def frame_header(number: int, samples: int) -> bytes:
    """Fixed block size, 8 kHz, one channel, 8 bits; a size other than BLOCK stands after the number."""
    full = samples == BLOCK == SIZES[10]
    raw = bytes([0xFF, 0xF8, (10 if full else 7) << 4 | 4, 0x02]) + _coded_number(number) + (b"" if full else struct.pack(">H", samples - 1))
    return raw + bytes([_crc8(raw)])


def read_header(data: bytes, at: int) -> tuple[int, int, int] | None:
    """(frame number, samples, bytes) of a frame header at `at`; None if there is none, or its CRC-8 is wrong."""
    if data[at : at + 2] != b"\xff\xf8" or at + 6 > len(data):
        return None
    size, rate = data[at + 2] >> 4, data[at + 2] & 15
    number, n = _decoded_number(data, at + 4)
    if data[at + 3] != 0x02 or number < 0 or size == 0 or rate == 15:
        return None
    end = at + 4 + n
    if size in (6, 7):
        samples, end = int.from_bytes(data[end : end + size - 5], "big") + 1, end + size - 5
    else:
        samples = SIZES[size]
    end += {12: 1, 13: 2, 14: 2}.get(rate, 0)
    if end >= len(data) or _crc8(data[at:end]) != data[end]:
        return None
    return number, samples, end + 1 - at


# ---- encoding


def _folded(r: np.ndarray) -> np.ndarray:
    return (r << 1) ^ (r >> 31)


def _rice(u: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(parameter, bits) of the cheapest Rice code of every row; columns beyond a row's count hold 0 and are taken off."""
    mean = u.sum(1, dtype=np.int64) / np.maximum(counts, 1)
    base = np.clip(np.floor(np.log2(np.maximum(mean, 1.0))).astype(np.int64), 0, MAX_RICE)
    best_k, best = base, np.full(len(u), np.iinfo(np.int64).max)
    for off in (-1, 0, 1):
        k = np.clip(base + off, 0, MAX_RICE)
        bits = (u >> k[:, None].astype(u.dtype)).sum(1, dtype=np.int64) + counts * (1 + k)
        better = bits < best
        best_k, best = np.where(better, k, best_k), np.where(better, bits, best)
    return best_k, best


def _fixed_residuals(x: np.ndarray, order: int) -> np.ndarray:
    r = x.copy()
    for i in range(order):
        r[:, i + 1 :] = r[:, i + 1 :] - r[:, i:-1]
    return r


def _lpc(x: np.ndarray, counts: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """(taps, shift): quantised predictors by the autocorrelation method, of all rows at once."""
    f = x.astype(np.float32)
    lags = [(f[:, lag:] * f[:, : f.shape[1] - lag]).sum(1, dtype=np.float64) for lag in range(order + 1)]
    lags[0] = lags[0] * (1 + 1e-9) + 1e-9
    a, error = np.zeros((len(x), order)), lags[0].copy()
    for i in range(order):
        k = (lags[i + 1] - sum(a[:, j] * lags[i - j] for j in range(i))) / error
        new = a.copy()
        new[:, i] = k
        for j in range(i):
            new[:, j] = a[:, j] - k * a[:, i - 1 - j]
        a, error = new, np.maximum(error * (1 - k * k), 1e-9)
    most = np.maximum(np.abs(a).max(1), 1e-6)
    shift = np.clip(LPC_BITS - 1 - np.ceil(np.log2(most)).astype(np.int64) - 1, 0, 15)
    limit = (1 << (LPC_BITS - 1)) - 1
    return np.clip(np.rint(a * (1 << shift)[:, None]), -limit, limit).astype(np.int64), shift


def _lpc_residuals(x: np.ndarray, taps: np.ndarray, shift: np.ndarray) -> np.ndarray:
    order, r = taps.shape[1], x.copy()
    guess = np.zeros((x.shape[0], x.shape[1] - order), dtype=np.int64)
    for j in range(order):
        guess += taps[:, j : j + 1] * x[:, order - 1 - j : x.shape[1] - 1 - j]
    r[:, order:] = x[:, order:] - (guess >> shift[:, None])
    return r


def encode(payloads: list[bytes], lpc_order: int = LPC_ORDER) -> list[bytes]:
    """A FLAC stream of every payload (not empty)."""
    cut = [(t, i, p[i : i + BLOCK]) for t, p in enumerate(payloads) for i in range(0, len(p), BLOCK)]
    counts = np.array([len(b) for _, _, b in cut], dtype=np.int64)
    rows = len(cut)
    flat = np.frombuffer(b"".join(b for _, _, b in cut), dtype=np.uint8).astype(np.int32) - 128
    x = np.zeros((rows, BLOCK), dtype=np.int32)
    column = np.arange(BLOCK)
    given = column < counts[:, None]
    x[given] = flat

    # the cheapest way of every frame; a way is (kind byte, order, Rice parameter), its residuals are kept folded
    best = 8 * counts
    kind, order, k = np.full(rows, 1), np.zeros(rows, np.int64), np.zeros(rows, np.int64)
    codes = np.zeros((rows, BLOCK), dtype=np.int32)
    taps, shift = np.zeros((rows, lpc_order), np.int64), np.zeros(rows, np.int64)
    ways = [(8 + o, o) for o in range(5)] + ([(31 + lpc_order, lpc_order)] if lpc_order else [])
    for code, o in ways:
        fit = counts > max(o, 4)
        if code >= 32:
            taps, shift = _lpc(x, counts, o)
            r = _lpc_residuals(x, taps, shift)
            extra = 9 + o * LPC_BITS
        else:
            r, extra = _fixed_residuals(x, o), 0
        u = _folded(r)
        u[~given] = 0
        u[:, :o] = 0
        rice, bits = _rice(u, counts - o)
        bits = bits + 10 + 8 * o + extra
        better = fit & (bits < best)
        best, kind, order, k = np.where(better, bits, best), np.where(better, code, kind), np.where(better, o, order), np.where(better, rice, k)
        codes[better] = u[better]
    same = (np.where(given, x, x[:, :1]) == x[:, :1]).all(1)
    kind[same], best[same] = 0, 8

    headers = [frame_header(i // BLOCK, len(b)) for _, i, b in cut]
    head = np.array([len(h) for h in headers], dtype=np.int64)
    lengths = head + 1 + (best + 7) // 8 + 2
    starts = np.concatenate([[0], np.cumsum(lengths)])[:-1]
    bits = np.zeros(8 * int(lengths.sum()), dtype=np.uint8)

    def put(rows_at: np.ndarray, value: np.ndarray, width: int) -> None:
        for j in range(width):
            bits[rows_at + j] = value >> (width - 1 - j) & 1

    body = 8 * (starts + head + 1)
    coded = np.flatnonzero(kind >= 8)
    at = body[coded]
    for o in range(1, max(5, lpc_order + 1)):
        warm = order[coded] >= o
        put(at[warm] + 8 * (o - 1), x[coded[warm], o - 1] & 0xFF, 8)
    at = at + 8 * order[coded]
    is_lpc = kind[coded] >= 32
    lpc_rows = coded[is_lpc]
    put(at[is_lpc], np.full(len(lpc_rows), LPC_BITS - 1), 4)
    put(at[is_lpc] + 4, shift[lpc_rows], 5)
    for j in range(lpc_order):
        put(at[is_lpc] + 9 + j * LPC_BITS, taps[lpc_rows, j] & ((1 << LPC_BITS) - 1), LPC_BITS)
    at = at + is_lpc * (9 + lpc_order * LPC_BITS)
    put(at + 6, k[coded], 4)  # method 0 and partition order 0 are six bits 0
    at = at + 10
    u, kk = codes[coded], k[coded].astype(np.int32)
    live = given[coded] & (column >= order[coded][:, None])
    q = np.where(live, u >> kk[:, None], 0)
    width = np.where(live, q + 1 + kk[:, None], 0)
    place = (at[:, None] + np.cumsum(width, axis=1) - width + q)[live]
    bits[place] = 1
    low, few = u[live], np.broadcast_to(kk[:, None], u.shape)[live]
    for j in range(int(kk.max(initial=0))):
        sel = few > j
        bits[place[sel] + 1 + j] = low[sel] >> (few[sel] - 1 - j) & 1
    data = np.packbits(bits)

    for row, h in enumerate(headers):
        s = int(starts[row])
        data[s : s + len(h)] = np.frombuffer(h, dtype=np.uint8)
        data[s + len(h)] = int(kind[row]) << 1
        if kind[row] < 2:
            n = int(counts[row]) if kind[row] else 1
            data[s + len(h) + 1 : s + len(h) + 1 + n] = x[row, :n].astype(np.int8).view(np.uint8)
    crc = crc16(data, starts, lengths - 2)
    data[starts + lengths - 2], data[starts + lengths - 1] = crc >> 8, crc & 0xFF

    out, raw, row = [], data.tobytes(), 0
    for p in payloads:
        n = -(-len(p) // BLOCK)
        first, end = int(starts[row]), int(starts[row + n - 1] + lengths[row + n - 1])
        own = lengths[row : row + n]
        points = b"".join(struct.pack(">QQH", i * BLOCK, int(starts[row + i]) - first, int(counts[row + i])) for i in range(0, n, SEEK_BLOCKS))
        signed = bytes(p).translate(FLIP)
        info = struct.pack(">HH", BLOCK, BLOCK) + int(own.min()).to_bytes(3, "big") + int(own.max()).to_bytes(3, "big")
        info += (RATE << 44 | 0 << 41 | 7 << 36 | len(p)).to_bytes(8, "big") + hashlib.md5(signed).digest()
        out.append(b"fLaC" + b"\x00" + len(info).to_bytes(3, "big") + info + b"\x83" + len(points).to_bytes(3, "big") + points + raw[first:end])
        row += n
    return out


FLIP = bytes(b ^ 0x80 for b in range(256))


# ---- decoding


@dataclass
class Stream:
    total: int
    md5: bytes
    seek: list[tuple[int, int, int]]
    first: int  # where frames begin


class FlacError(ValueError):
    """A stream that is cut off, or whose checksums don't hold."""


def metadata(data: bytes) -> Stream:
    if data[:4] != b"fLaC":
        raise FlacError("no FLAC marker")
    at, last, total, md5, seek = 4, False, -1, b"", []
    while not last:
        last, what, size = bool(data[at] & 0x80), data[at] & 0x7F, int.from_bytes(data[at + 1 : at + 4], "big")
        block, at = data[at + 4 : at + 4 + size], at + 4 + size
        if what == 0:
            fields = int.from_bytes(block[10:18], "big")
            total, md5 = fields & (1 << 36) - 1, block[18:34]
            if (fields >> 36 & 31) != 7 or (fields >> 41 & 7) != 0:
                raise FlacError("only one channel of 8 bits is read")
        elif what == 3:
            seek = [struct.unpack(">QQH", block[i : i + 18]) for i in range(0, size, 18)]
    if total < 0:
        raise FlacError("no STREAMINFO")
    return Stream(total, md5, seek, at)


def frames(data: bytes, at: int, number: int, left: int) -> list[tuple[int, int, int, int]]:
    """(start, header bytes, end, samples) of frames from `at` on. A frame ends where the next one's header checks out."""
    out = []
    while left > 0:
        found = read_header(data, at)
        if found is None or found[0] != number:
            raise FlacError(f"no header of frame {number} at byte {at}")
        left -= found[1]
        number += 1
        end = len(data)
        if left > 0:
            end = data.find(b"\xff\xf8", at + found[2])
            while end >= 0 and ((ahead := read_header(data, end)) is None or ahead[0] != number):
                end = data.find(b"\xff\xf8", end + 1)
            if end < 0:
                raise FlacError(f"frame {number} is missing")
        out.append((at, found[2], end, found[1]))
        at = end
    return out


CLZ = np.array([8] + [7 - (b.bit_length() - 1) for b in range(1, 256)], dtype=np.int64)
KEEP = np.array([0xFF >> i for i in range(8)], dtype=np.uint8)


def _bits(words: np.ndarray, at: np.ndarray, width: np.ndarray | int) -> np.ndarray:
    """`width` (0 to 24) bits at each bit position."""
    return words[at >> 3] >> (32 - (at & 7) - width) & ((1 << np.asarray(width, dtype=np.int64)) - 1)


def decode_frames(data: np.ndarray, where: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(samples, subframe kinds): a row per frame (start, header bytes, end, samples) in `where`; all CRC-16 are checked."""
    starts, head, ends, counts = where.T
    crc = crc16(data, starts, ends - starts - 2)
    if (crc != (data[ends - 2].astype(np.int64) << 8 | data[ends - 1])).any():
        raise FlacError("a frame's CRC-16 does not hold")
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    wide = padded.astype(np.int64)
    words = wide[:-3] << 24 | wide[1:-2] << 16 | wide[2:-1] << 8 | wide[3:]
    kinds = data[starts + head].astype(np.int64) >> 1
    if (data[starts + head] & 0x81).any():
        raise FlacError("a subframe header is not one")
    size = int(counts.max(initial=0))
    x = np.zeros((len(where), size), dtype=np.int64)
    for row in np.flatnonzero(kinds < 2).tolist():
        s, n = int(starts[row] + head[row] + 1), int(counts[row]) if kinds[row] else 1
        x[row, : counts[row]] = data[s : s + n].view(np.int8)
    rows = np.flatnonzero(kinds >= 8)
    if not len(rows):
        return x, kinds
    kind, n = kinds[rows], counts[rows]
    order = np.where(kind >= 32, kind - 31, kind - 8)
    if ((kind < 32) & (order > 4)).any() or ((kind >= 13) & (kind < 32)).any():
        raise FlacError("a subframe has a reserved kind")
    at = 8 * (starts[rows] + head[rows] + 1)
    for o in range(int(order.max())):
        warm = order > o
        value = _bits(words, at[warm] + 8 * o, 8)
        x[rows[warm], o] = value - ((value & 0x80) << 1)
    at = at + 8 * order
    is_lpc = kind >= 32
    precision, shift = np.ones(len(rows), np.int64), np.zeros(len(rows), np.int64)
    precision[is_lpc] = _bits(words, at[is_lpc], 4) + 1
    shift[is_lpc] = _bits(words, at[is_lpc] + 4, 5)
    taps = np.zeros((len(rows), max(4, int(order.max()))), np.int64)
    for j in range(int(order[is_lpc].max(initial=0))):
        has = is_lpc & (order > j)
        value = _bits(words, at[has] + 9 + j * precision[has], precision[has])
        taps[has, j] = value - (value >> (precision[has] - 1) << precision[has])
    for o, own in enumerate(FIXED):
        taps[(kind == 8 + o)[:, None] & (np.arange(taps.shape[1]) < len(own))] = np.tile(own, int((kind == 8 + o).sum()))
    at = at + is_lpc * (9 + order * precision)
    _residuals(padded, words, at, rows, order, n, x)

    # predictors run over time, in all rows of an order together; order 0 has its samples by now
    for o in np.unique(order[order > 0]).tolist():
        for fixed in (True, False):
            sel = np.flatnonzero((order == o) & (is_lpc != fixed))
            if not len(sel):
                continue
            y, t, s = np.ascontiguousarray(x[rows[sel]].T), taps[sel, :o].T, shift[sel]
            if fixed and o == 1:
                y = np.cumsum(y, axis=0)
            else:
                for i in range(o, size):
                    guess = t[0] * y[i - 1]
                    for j in range(1, o):
                        guess += t[j] * y[i - 1 - j]
                    y[i] += guess >> s
            x[rows[sel]] = y.T
    return x, kinds


def _residuals(data: np.ndarray, words: np.ndarray, at: np.ndarray, rows: np.ndarray, order: np.ndarray, n: np.ndarray, x: np.ndarray) -> None:
    """Reads the Rice-coded residuals of rows into x: the next code of every row, time after time."""
    if _bits(words, at, 2).any():
        raise FlacError("only 4-bit Rice parameters are read")
    parts = _bits(words, at + 2, 4)
    at = at + 6
    part = n >> parts
    index = np.arange(len(data), dtype=np.int64)
    filled = np.where(data != 0, index, len(data) - 1)
    following = np.minimum.accumulate(filled[::-1])[::-1]  # the next byte with a bit in it
    k, todo = np.zeros(len(rows), np.int64), order.copy()  # todo: the sample each row reads next
    slow = np.argsort(-n, kind="stable")  # rows with fewer samples end first
    rows, order, n, at, part, todo, k = rows[slow], order[slow], n[slow], at[slow], part[slow], todo[slow], k[slow]
    out = np.zeros((x.shape[1], len(rows)), dtype=np.int64)
    single = bool((part == n).all())
    for i in range(x.shape[1]):
        m = int(np.searchsorted(-n, -i, side="left"))
        if not m:
            break
        live = np.flatnonzero(order[:m] <= i) if i < int(order.max()) else slice(0, m)
        fresh = (i == order[:m]) if single else (i == order[:m]) & (order[:m] < part[:m]) | (i >= part[:m]) & (i % part[:m] == 0)
        if i < int(order.max()) + 1 or not single:
            new = np.flatnonzero(fresh)
            if len(new):
                k[new] = _bits(words, at[new], 4)
                at[new] += 4
                if (k[new] == 15).any():
                    raise FlacError("escaped partitions are not read")
        pos, kk = at[live], k[live]
        byte = pos >> 3
        here = data[byte] & KEEP[pos & 7]
        byte = np.where(here != 0, byte, following[byte + 1])
        here = np.where(here != 0, here, data[byte])
        one = (byte << 3) + CLZ[here]
        after = one + 1
        low = words[after >> 3] >> (32 - (after & 7) - kk) & ((1 << kk) - 1)
        out[i, live] = (one - pos) << kk | low
        at[live] = after + kk
    for o in range(int(order.max())):  # warm-up samples stay
        out[o, order > o] = 0
    r = (out >> 1) ^ -(out & 1)
    warm = np.arange(x.shape[1]) < order[:, None]
    x[rows] = np.where(warm, x[rows], r.T)


def decode(streams: list[bytes]) -> tuple[list[bytes], list[np.ndarray]]:
    """(payloads, subframe kinds of their frames) of many streams; raises FlacError where a checksum does not hold."""
    infos = [metadata(s) for s in streams]
    base = np.concatenate([[0], np.cumsum([len(s) for s in streams])]).tolist()
    cut = [[(b + base[t], h, e + base[t], n) for b, h, e, n in frames(s, info.first, 0, info.total)] for t, (s, info) in enumerate(zip(streams, infos, strict=True))]
    where = np.array([f for own in cut for f in own], dtype=np.int64).reshape(-1, 4)
    x, kinds = decode_frames(np.frombuffer(b"".join(streams), dtype=np.uint8), where)
    signed, out, ways, row = x.astype(np.int8), [], [], 0
    for own, info in zip(cut, infos, strict=True):
        raw = b"".join(signed[row + i, : f[3]].tobytes() for i, f in enumerate(own))
        if hashlib.md5(raw).digest() != info.md5:
            raise FlacError("the MD5 of the samples does not hold")
        out.append(raw.translate(FLIP))
        ways.append(kinds[row : row + len(own)])
        row += len(own)
    return out, ways


def read_samples(stream: bytes, start: int, count: int) -> bytes:
    """Bytes [start, start + count) of the payload, decoded from the last seek point before them on."""
    info = metadata(stream)
    end = min(info.total, start + count)
    if start >= end:
        return b""
    sample, offset, _ = max((p for p in info.seek if p[0] <= start), default=(0, 0, 0))
    cut = []
    at, number, done = info.first + offset, sample // BLOCK, sample
    for f in frames(stream, at, number, info.total - sample):
        if done >= end:
            break
        cut.append(f)
        done += f[3]
    x, _ = decode_frames(np.frombuffer(stream, dtype=np.uint8), np.array(cut, dtype=np.int64))
    raw = b"".join(x[i, : f[3]].astype(np.int8).tobytes() for i, f in enumerate(cut)).translate(FLIP)
    return raw[start - sample : end - sample]


# ---- columns


def padded(raw: bytes, unit: int = PAD) -> bytes:
    return raw + b"\0" * (-len(raw) % unit or (0 if raw else unit))


def feature(payload: bytes, kinds: np.ndarray) -> str:
    """Of the samples: mean size, zero crossings per thousand, peak; and how the frames are coded."""
    x = np.frombuffer(payload, dtype=np.uint8).astype(np.int32) - 128
    ways = {"constant": kinds == 0, "verbatim": kinds == 1, "fixed": (kinds >= 8) & (kinds < 32), "lpc": kinds >= 32}
    crossings = int(((x[1:] < 0) != (x[:-1] < 0)).sum()) * 1000 // len(x)
    return f"abs={int(np.abs(x).sum()) // len(x)};cross={crossings};peak={int(np.abs(x).max())};" + ";".join(f"{k}={int(v.sum())}" for k, v in ways.items())


def _batched(batches: Iterator[pd.DataFrame], column: str) -> Iterator[tuple[pd.DataFrame, list[bytes]]]:
    """Batches cut by BATCH_BYTES, with the column's bytes."""
    for pdf in batches:
        raw, start, total = [text_bytes(v) if not isinstance(v, (bytes, bytearray)) else bytes(v) for v in pdf[column]], 0, 0
        for i, r in enumerate(raw):
            if i > start and total + len(r) + PAD > BATCH_BYTES:
                yield pdf.iloc[start:i], raw[start:i]
                start, total = i, 0
            total += len(r) + PAD
        if start < len(raw):
            yield pdf.iloc[start:], raw[start:]


def write_media(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, media: every text's padded bytes as a FLAC stream."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf, raw in _batched(batches, "text"):
            yield pd.DataFrame({"doc_id": pdf["doc_id"].to_numpy(), "n_bytes": [len(r) for r in raw], "media": encode([padded(r) for r in raw])})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(rows, "doc_id long, n_bytes long, media binary")


def read_media(media: DataFrame) -> DataFrame:
    """doc_id, n_bytes, payload, feature: what the streams hold, with all checksums verified."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf, raw in _batched(batches, "media"):
            payloads, kinds = decode(raw)
            yield pd.DataFrame({"doc_id": pdf["doc_id"].to_numpy(), "n_bytes": pdf["n_bytes"].to_numpy(), "payload": payloads, "feature": [feature(p, k) for p, k in zip(payloads, kinds, strict=True)]})

    return media.select(F.col("doc_id").cast("long").alias("doc_id"), "n_bytes", "media").mapInPandas(rows, "doc_id long, n_bytes long, payload binary, feature string")


def digests(docs: DataFrame) -> DataFrame:
    """write_media and read_media of a batch in one worker, so that neither form is moved; only digests leave it."""
    columns = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf, raw in _batched(batches, "text"):
            media = encode([padded(r) for r in raw])
            payloads, kinds = decode(media)
            out = [
                (len(r), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-PAD:]), len(m), hashlib.sha256(m).hexdigest(), feature(p, k))
                for r, p, m, k in zip(raw, payloads, media, kinds, strict=True)
            ]
            table = pd.DataFrame(out, columns=[c.split()[0] for c in columns.split(", ")][1:])
            table.insert(0, "doc_id", pdf["doc_id"].to_numpy())
            yield table

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(rows, columns)
