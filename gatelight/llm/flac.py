"""FLAC media columns: lossless storage of samples, checked decoding, PCM with seekable blocks.

Both directions work on all frames of a batch side by side: step ``i`` handles sample ``i``
of every frame with one array operation, since within a frame each code starts where the
one before ended. Frames are found by their sync code and header checksum, and every frame
is held against its 16-bit checksum and every stream against the MD5 of its samples; a
damaged stream is an error.

The decoder reads one or two channels of 4 to 24 bits, constant, verbatim, fixed and linear
predictors, Rice partitions of both kinds with escapes. The encoder writes mono streams of
8-bit samples with a seek point for every ``seek_every`` frames.

Null texts are empty; each payload is filled up to a positive multiple of 64 bytes, so no
stream is empty. Texts of any length are stored whole; memory follows a megabyte of
payload or the longest text. Repeated rows give equal rows; ids may be null or repeat; an
empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gatelight.llm.common import id_and_text, packed_longs, slices, texts_of

BLOCK = 1024
RATE = 8000

MEDIA = "doc_id long, n_bytes long, media binary"
DECODED = "doc_id long, n_bytes long, media binary, pcm binary, block_starts array<long>, frame_starts array<long>, feature string"


def _table(width: int, poly: int) -> np.ndarray:
    out = np.arange(256, dtype=np.uint32) << (width - 8)
    for _ in range(8):
        out = np.where(out >> (width - 1) & 1, (out << 1) ^ poly, out << 1) & ((1 << width) - 1)
    return out


_CRC8, _CRC16 = _table(8, 0x07), _table(16, 0x8005)
_CRC8_LIST, _CRC16_LIST = _CRC8.tolist(), _CRC16.tolist()


def crc8(data: bytes) -> int:
    out = 0
    for byte in data:
        out = _CRC8_LIST[out ^ byte]
    return out


def crc16(data: bytes) -> int:
    out = 0
    for byte in data:
        out = (out << 8 & 0xFFFF) ^ _CRC16_LIST[out >> 8 ^ byte]
    return out


def crc16_of(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The 16-bit checksum of every part of ``data``, all parts side by side."""
    order = np.argsort(-lengths, kind="stable")
    starts, left = starts[order], lengths[order]
    crc, active = np.zeros(len(starts), np.uint32), len(starts)
    for i in range(int(left[0]) if len(left) else 0):
        while active and left[active - 1] <= i:
            active -= 1
        now = crc[:active]
        crc[:active] = ((now << 8) & 0xFFFF) ^ _CRC16[(now >> 8) ^ data[starts[:active] + i]]
    out = np.empty_like(crc)
    out[order] = crc
    return out


def _coded_number(n: int) -> bytes:
    """A frame number, coded as UTF-8 codes characters, up to 36 bits."""
    if n < 0x80:
        return bytes([n])
    size = 2
    while n >= 1 << (5 * size + 1):
        size += 1
    tail = [0x80 | (n >> (6 * i)) & 0x3F for i in range(size - 2, -1, -1)]
    return bytes([(0xFF << (8 - size)) & 0xFF | n >> (6 * (size - 1)), *tail])


# Encoding


def _zigzag(values: np.ndarray) -> np.ndarray:
    return (values << 1) ^ (values >> 63)


def _rice(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rice parameter and bits of each row of zigzag values."""
    total = values.sum(axis=1)
    count = max(1, values.shape[1])
    guess = np.clip(np.floor(np.log2(np.maximum(total / count * 0.6931, 1e-9))), 0, 14).astype(np.int64)
    best_k, best = guess, None
    for k in (guess, np.minimum(guess + 1, 14)):
        bits = (values >> k[:, None]).sum(axis=1) + count * (k + 1)
        if best is None:
            best = bits
        else:
            best_k, best = np.where(bits < best, k, best_k), np.minimum(bits, best)
    return best_k, best


def _linear(samples: np.ndarray, order: int, precision: int) -> tuple[np.ndarray, int]:
    """Quantised predictor coefficients of each row, by Levinson's recursion, and their common shift."""
    x = samples * np.hanning(samples.shape[1] + 2)[1:-1]
    auto = np.stack([(x[:, : x.shape[1] - lag] * x[:, lag:]).sum(axis=1) for lag in range(order + 1)])
    error = auto[0] * 1.0001 + 1e-9
    weights = np.zeros((order, len(samples)))
    for i in range(order):
        reflect = (auto[i + 1] - (weights[:i] * auto[i:0:-1]).sum(axis=0)) / error
        weights[:i], weights[i] = weights[:i] - reflect * weights[:i][::-1], reflect
        error = np.maximum(error * (1 - reflect * reflect), 1e-9)
    shift, most = precision - 3, 1 << (precision - 1)
    return np.clip(np.rint(weights.T * (1 << shift)), -most, most - 1).astype(np.int64), shift


_ORDER, _PRECISION = 4, 12


def _frames(samples: np.ndarray, numbers: np.ndarray) -> list[bytes]:
    """Frames of equal length: ``samples`` (frames x length, 8-bit) with their numbers."""
    m, length = samples.shape
    residuals = {o: np.diff(samples, n=o, axis=1) for o in range(3)}
    if length > 2 * _ORDER:
        weights, shift = _linear(samples, _ORDER, _PRECISION)
        sum_ = np.zeros((m, length - _ORDER), np.int64)
        for j in range(_ORDER):
            sum_ += weights[:, j : j + 1] * samples[:, _ORDER - 1 - j : length - 1 - j]
        residuals["lpc"] = samples[:, _ORDER:] - (sum_ >> shift)
    choices, costs, ks = list(residuals), [], []
    for name in choices:
        k, bits = _rice(_zigzag(residuals[name]))
        head = 8 + 10 + (8 * name if name != "lpc" else _ORDER * (8 + _PRECISION) + 9)
        costs.append(bits + head)
        ks.append(k)
    costs.append(np.full(m, 8 + 8 * length))  # verbatim
    constant = (samples == samples[:, :1]).all(axis=1)
    costs.append(np.where(constant, 16, 1 << 40))
    pick = np.argmin(np.stack(costs), axis=0)

    heads = [_head(int(n), length) for n in numbers]
    sizes = np.array([len(h) for h in heads]) + -(-np.stack(costs)[pick, np.arange(m)] // 8)
    starts = np.cumsum(sizes + 2) - (sizes + 2)
    bits = np.zeros(int((sizes + 2).sum()) * 8, np.uint8)
    body = starts * 8 + 8 * np.array([len(h) for h in heads])

    def put(rows: np.ndarray, at: np.ndarray, values: np.ndarray, width: int) -> None:
        for b in range(width):
            bits[at + b] = values >> (width - 1 - b) & 1

    for c in range(len(choices) + 2):
        rows = np.flatnonzero(pick == c)
        if not len(rows):
            continue
        at = body[rows]
        if c == len(choices) + 1:
            put(rows, at + 8, samples[rows, 0], 8)
        elif c == len(choices):
            put(rows, at, np.full(len(rows), 1 << 1), 8)
            put(rows, (at[:, None] + 8 + 8 * np.arange(length)).ravel(), samples[rows].ravel(), 8)
        else:
            name = choices[c]
            order = _ORDER if name == "lpc" else name
            put(rows, at, np.full(len(rows), (0x20 | order - 1 if name == "lpc" else 0x08 | order) << 1), 8)
            at = at + 8
            for j in range(order):
                put(rows, at, samples[rows, j], 8)
                at = at + 8
            if name == "lpc":
                put(rows, at, np.full(len(rows), (_PRECISION - 1) << 5 | shift), 9)
                at = at + 9
                for j in range(order):
                    put(rows, at, weights[rows, j], _PRECISION)
                    at = at + _PRECISION
            k = ks[c][rows]
            put(rows, at, k, 10)  # method 0, one partition, its parameter
            at = at + 10
            values = _zigzag(residuals[name][rows])
            high = values >> k[:, None]
            widths = high + 1 + k[:, None]
            stops = at[:, None] + np.cumsum(widths, axis=1) - widths + high
            bits[stops] = 1
            for b in range(int(k.max())):
                some = np.flatnonzero(k > b)
                bits[stops[some] + 1 + b] = values[some] >> (k[some, None] - 1 - b) & 1
    data = np.packbits(bits)
    for h, s in zip(heads, starts.tolist()):
        data[s : s + len(h)] = np.frombuffer(h, np.uint8)
    sums = crc16_of(data, starts, sizes)
    data[starts + sizes], data[starts + sizes + 1] = sums >> 8, sums & 0xFF
    blob = data.tobytes()
    return [blob[a : a + n + 2] for a, n in zip(starts.tolist(), sizes.tolist())]


def _head(number: int, length: int) -> bytes:
    """A frame header: fixed block size, mono, 8 bits; the length itself follows the number."""
    head = b"\xff\xf8\x70\x02" + _coded_number(number) + struct.pack(">H", length - 1)
    return head + bytes([crc8(head)])


def encode_streams(payloads: list[bytes], block: int = BLOCK, seek_every: int = 16) -> list[bytes]:
    """Mono streams of 8-bit samples, byte ``b`` being the sample ``b`` - 128."""
    places: dict[int, list[tuple[int, int]]] = {}
    for s, payload in enumerate(payloads):
        for number in range(-(-len(payload) // block)):
            places.setdefault(min(block, len(payload) - number * block), []).append((s, number))
    made: list[list[bytes]] = [[b""] * -(-len(p) // block) for p in payloads]
    for length, where in places.items():
        for at in range(0, len(where), 512):
            part = where[at : at + 512]
            joined = b"".join(payloads[s][n * block : n * block + length] for s, n in part)
            samples = np.frombuffer(joined, np.uint8).astype(np.int64).reshape(len(part), length) - 128
            for (s, n), frame in zip(part, _frames(samples, np.array([n for _, n in part]))):
                made[s][n] = frame
    return [_stream(p, frames, block, seek_every) for p, frames in zip(payloads, made)]


def _stream(payload: bytes, frames: list[bytes], block: int, seek_every: int) -> bytes:
    signed = (np.frombuffer(payload, np.uint8) ^ 0x80).tobytes()
    sizes = [len(f) for f in frames]
    info = struct.pack(">HH", block, block) + (min(sizes)).to_bytes(3, "big") + max(sizes).to_bytes(3, "big")
    info += (RATE << 44 | 0 << 41 | 7 << 36 | len(payload)).to_bytes(8, "big") + hashlib.md5(signed).digest()
    points, at = b"", 0
    for number, size in enumerate(sizes):
        if number % seek_every == 0 and number:
            points += struct.pack(">QQH", number * block, at, min(block, len(payload) - number * block))
        at += size
    last = b"\x80" if not points else b"\x00"
    out = b"fLaC" + last + len(info).to_bytes(3, "big") + info
    if points:
        out += b"\x83" + len(points).to_bytes(3, "big") + points
    return out + b"".join(frames)


# Decoding


@dataclass
class _Frame:
    stream: int
    start: int  # bytes, in the joined data
    end: int  # without the checksum
    first: int  # sample number
    size: int
    channels: int
    mode: int  # 0 apart, 8 left and side, 9 side and right, 10 mid and side
    bits: int
    body: int  # bits, in the joined data


@dataclass
class _Info:
    first_frame: int
    block: int
    rate: int
    channels: int
    bits: int
    total: int
    md5: bytes


def _stream_info(data: bytes) -> _Info:
    if data[:4] != b"fLaC":
        raise ValueError("not a FLAC stream")
    at, info, last = 4, b"", False
    while not last:
        last, kind, size = data[at] >> 7, data[at] & 0x7F, int.from_bytes(data[at + 1 : at + 4], "big")
        if kind == 0:
            info = data[at + 4 : at + 4 + size]
        at += 4 + size
    packed = int.from_bytes(info[10:18], "big")
    return _Info(at, int.from_bytes(info[2:4], "big"), packed >> 44, (packed >> 41 & 7) + 1, (packed >> 36 & 31) + 1, packed & (1 << 36) - 1, info[18:34])


_BITS_CODED = {1: 8, 2: 12, 4: 16, 5: 20, 6: 24}


def _frame_head(data: bytes, at: int, info: _Info) -> tuple[int, int, int, int, int, int] | None:
    """(length of the header, first sample, samples, channels, mode, bits), or nothing where no header stands."""
    if at + 6 > len(data) or data[at] != 0xFF or data[at + 1] & 0xFE != 0xF8 or data[at + 3] & 1:
        return None
    size_code, rate_code, mode, bits_code = data[at + 2] >> 4, data[at + 2] & 15, data[at + 3] >> 4, data[at + 3] >> 1 & 7
    if size_code == 0 or rate_code == 15 or mode > 10 or bits_code in (3, 7):
        return None
    p, lead = at + 4, data[at + 4]
    extra = 0
    while extra < 8 and lead >> (7 - extra) & 1:
        extra += 1
    if extra == 1 or extra == 8:
        return None
    number = lead if extra == 0 else lead & (0x7F >> extra)
    for i in range(1, extra):
        if p + i >= len(data):
            return None
        number = number << 6 | data[p + i] & 0x3F
    p += max(1, extra)
    if size_code == 6:
        size, p = int.from_bytes(data[p : p + 1], "big") + 1, p + 1
    elif size_code == 7:
        size, p = int.from_bytes(data[p : p + 2], "big") + 1, p + 2
    else:
        size = 192 if size_code == 1 else 576 << (size_code - 2) if size_code < 6 else 256 << (size_code - 8)
    p += {12: 1, 13: 2, 14: 2}.get(rate_code, 0)
    if p >= len(data) or crc8(data[at:p]) != data[p]:
        return None
    first = number if data[at + 1] & 1 else number * info.block
    channels = 2 if mode >= 8 else mode + 1
    return p + 1 - at, first, size, channels, mode if mode >= 8 else 0, _BITS_CODED.get(bits_code, info.bits)


def _find_frames(data: bytes, info: _Info, stream: int, base: int) -> list[_Frame]:
    """The frames of one stream: each ends where the next header stands that its sample count asks for.

    Samples may look like such a header. Then the frame's own header comes after them and names
    the same sample again, or the frames do not add up to all samples.
    """
    found: list[_Frame] = []
    at, wanted = info.first_frame, 0
    while at >= 0 and at < len(data):
        head = _frame_head(data, at, info)
        if head is not None and head[1] == wanted:
            if found:
                found[-1].end = base + at - 2
            found.append(_frame_at(head, at, len(data), stream, base))
            wanted += head[2]
        elif not found:
            raise ValueError("no frame where the first one must be")
        elif head is not None and head[1] == found[-1].first:
            return _checked_frames(data, info, stream, base)
        at = data.find(b"\xff", at + 1)
    if wanted != info.total and info.total:
        return _checked_frames(data, info, stream, base)
    return found


def _checked_frames(data: bytes, info: _Info, stream: int, base: int) -> list[_Frame]:
    """The same where samples look like headers: a frame ends where its checksum stands, and of several such places where its codes end."""
    heads: dict[int, tuple[int, int, int, int, int, int]] = {}
    places: dict[int, list[int]] = {}
    at = info.first_frame
    while at >= 0 and at < len(data):
        head = _frame_head(data, at, info)
        if head is not None:
            heads[at] = head
            places.setdefault(head[1], []).append(at)
        at = data.find(b"\xff", at + 1)
    found: list[_Frame] = []
    at, wanted = info.first_frame, 0
    while at < len(data):
        size, wanted = heads[at][0], wanted + heads[at][2]
        ends = [p for p in places.get(wanted, ()) if p >= at + size + 2 and _ends_at(data, at, p)]
        if wanted == (info.total or wanted) and _ends_at(data, at, len(data)):
            ends.append(len(data))
        if len(ends) > 1:
            frame = _frame_at(heads[at], at, ends[-1], stream, -at)
            codes = int(_channels(_Bits(data[at : ends[-1]]), [frame])[1][0])
            ends = [p for p in ends if p == at + -(-codes // 8) + 2]
        if not ends:
            raise ValueError("a frame fails its checksum or samples are missing")
        found.append(_frame_at(heads[at], at, ends[0], stream, base))
        at = ends[0]
    if wanted != info.total and info.total:
        raise ValueError("samples are missing")
    return found


def _frame_at(head: tuple[int, int, int, int, int, int], at: int, end: int, stream: int, base: int) -> _Frame:
    size, first, samples, channels, mode, bits = head
    return _Frame(stream, base + at, base + end - 2, first, samples, channels, mode, bits, (base + at + size) * 8)


def _ends_at(data: bytes, start: int, end: int) -> bool:
    """Whether a frame from ``start`` to ``end`` holds its own checksum."""
    return crc16(data[start : end - 2]) == int.from_bytes(data[end - 2 : end], "big")


class _Bits:
    """Reads bits at many places of one byte array at once."""

    def __init__(self, data: bytes) -> None:
        wide = np.frombuffer(data + b"\0" * 16, np.uint8)
        self.bytes = wide
        self.words = np.lib.stride_tricks.sliding_window_view(wide, 8)

    def word(self, at: np.ndarray) -> np.ndarray:
        """The 64 bits from each place on, the last few of them zero."""
        rows = np.ascontiguousarray(self.words[at >> 3]).view(">u8").ravel().astype(np.uint64)
        return rows << (at & 7).astype(np.uint64)

    def read(self, at: np.ndarray, width: np.ndarray | int) -> np.ndarray:
        """Unsigned values of up to 56 bits."""
        width = np.broadcast_to(np.asarray(width, np.uint64), at.shape)
        shift = np.uint64(64) - width
        out = self.word(at) >> np.minimum(shift, np.uint64(63))
        return np.where(width == 0, 0, out).astype(np.int64)

    def read_signed(self, at: np.ndarray, width: np.ndarray | int) -> np.ndarray:
        value, width = self.read(at, width), np.broadcast_to(np.asarray(width, np.int64), at.shape)
        return np.where(width > 0, value - ((value >> np.maximum(width - 1, 0) & 1) << width), 0)

    def unary(self, at: np.ndarray) -> np.ndarray:
        """The number of zeros before the next one."""
        top = (self.word(at) >> np.uint64(11)).astype(np.float64)
        out = 53 - np.frexp(top)[1].astype(np.int64)
        for i in np.flatnonzero(top == 0):
            p, byte = int(at[i]), int(at[i]) >> 3
            rest = int(self.bytes[byte]) & (0xFF >> (p & 7))
            while not rest and byte + 1 < len(self.bytes):
                byte += 1
                rest = int(self.bytes[byte])
            if not rest:
                raise ValueError("a code runs past the end")
            out[i] = byte * 8 + 8 - rest.bit_length() - p
        return out


def _subframes(bits: _Bits, at: np.ndarray, sizes: np.ndarray, widths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The samples of one channel of every frame (padded to the longest), and where the next channel starts."""
    m, longest = len(at), int(sizes.max())
    out = np.zeros((m, longest), np.int64)
    head = bits.read(at, 8)
    kind, wasted = head >> 1 & 0x3F, np.zeros(m, np.int64)
    at = at + 8
    if (head & 1).any():
        some = np.flatnonzero(head & 1)
        wasted[some] = bits.unary(at[some]) + 1
        at[some] += wasted[some]
        widths = widths - wasted
    constant, verbatim = kind == 0, kind == 1
    fixed, linear = (kind >= 8) & (kind <= 12), kind >= 32
    if not (constant | verbatim | fixed | linear).all() or (head >> 7).any():
        raise ValueError("reserved subframe type")
    if constant.any():
        rows = np.flatnonzero(constant)
        out[rows] = bits.read_signed(at[rows], widths[rows])[:, None]
        at[rows] += widths[rows]
    if verbatim.any():
        rows = np.flatnonzero(verbatim)
        for i in range(int(sizes[rows].max())):
            now = rows[sizes[rows] > i]
            out[now, i] = bits.read_signed(at[now], widths[now])
            at[now] += widths[now]
    rows = np.flatnonzero(fixed | linear)
    if len(rows):
        order = np.where(linear, kind - 31, kind - 8)[rows]
        for i in range(int(order.max())):
            now = order > i
            out[rows[now], i] = bits.read_signed(at[rows[now]], widths[rows[now]])
            at[rows[now]] += widths[rows[now]]
        weights, shift = np.zeros((len(rows), 32), np.int64), np.zeros(len(rows), np.int64)
        own = linear[rows]
        if own.any():
            precision = bits.read(at[rows[own]], 4) + 1
            shift[own] = bits.read_signed(at[rows[own]] + 4, 5)
            if (shift < 0).any() or (precision == 16).any():
                raise ValueError("reserved predictor")
            at[rows[own]] += 9
            for i in range(int(order[own].max())):
                now = np.flatnonzero(own)[order[own] > i]
                width = precision[order[own] > i]
                weights[now, i] = bits.read_signed(at[rows[now]], width)
                at[rows[now]] += width
        at[rows] = _residuals(bits, at[rows], order, sizes[rows], rows, out)
        _predict(out, rows, order, sizes[rows], own, weights, shift)
    return out << wasted[:, None], at


def _residuals(bits: _Bits, at: np.ndarray, order: np.ndarray, sizes: np.ndarray, rows: np.ndarray, out: np.ndarray) -> np.ndarray:
    """Decodes the Rice codes of all frames side by side into ``out``."""
    method, parts = bits.read(at, 2), bits.read(at + 2, 4)
    if (method > 1).any():
        raise ValueError("reserved residual coding")
    at = at + 6
    head, span = 4 + method, sizes >> parts
    k, raw = np.zeros(len(at), np.int64), np.zeros(len(at), bool)
    until = order.copy()  # where the next partition starts; the first starts at once
    todo = np.argsort(-sizes, kind="stable")
    ends = sizes[todo]
    active = len(todo)
    for i in range(int(order.min()), int(ends[0])):
        while active and ends[active - 1] <= i:
            active -= 1
        now = todo[:active]
        if (order[now] > i).any():
            now = now[order[now] <= i]
        due = until[now] == i
        if due.any():
            new = now[due]
            # A first partition may be all warm-up samples; its parameter is still there.
            while len(new):
                k[new] = bits.read(at[new], head[new])
                raw[new] = k[new] == (1 << head[new]) - 1
                at[new] += head[new]
                if raw[new].any():
                    some = new[raw[new]]
                    k[some] = bits.read(at[some], 5)
                    at[some] += 5
                until[new] = (i // span[new] + 1) * span[new]
                new = new[until[new] == i]
        p, low = at[now], k[now]
        high = bits.unary(p)
        if raw[now].any():
            plain = raw[now]
            value = np.zeros(len(now), np.int64)
            value[plain] = bits.read_signed(p[plain], low[plain])
            p[plain] += low[plain]
            code = ~plain
            stop = p[code] + high[code] + 1
            u = high[code] << low[code] | bits.read(stop, low[code])
            value[code], p[code] = (u >> 1) ^ -(u & 1), stop + low[code]
        else:
            stop = p + high + 1
            u = high << low | bits.read(stop, low)
            value, p = (u >> 1) ^ -(u & 1), stop + low
        out[rows[now], i] = value
        at[now] = p
    return at


def _predict(out: np.ndarray, rows: np.ndarray, order: np.ndarray, sizes: np.ndarray, linear: np.ndarray, weights: np.ndarray, shift: np.ndarray) -> None:
    """Turns residuals into samples, in place."""
    for o in np.unique(order[~linear]) if (~linear).any() else ():
        some = rows[~linear & (order == o)]
        block = out[some]
        # The differences of the warm-up samples start as many running sums.
        heads = [np.diff(block[:, : int(o)], n=j, axis=1)[:, 0] for j in range(int(o))]
        part = block[:, int(o) :]
        for j in range(int(o) - 1, -1, -1):
            part = np.cumsum(np.concatenate([heads[j][:, None], part], axis=1), axis=1)
        out[some] = part
    if linear.any():
        some, own = rows[linear], order[linear]
        most = int(own.max())
        w, s, block = weights[linear][:, :most], shift[linear], out[some]
        for i in range(1, block.shape[1]):
            reach = min(i, most)
            guess = (w[:, :reach] * block[:, i - reach : i][:, ::-1]).sum(axis=1) >> s
            block[:, i] += np.where(own <= i, guess, 0)
        out[some] = block


@dataclass
class Decoded:
    """Samples of one stream as PCM (unsigned 8-bit, else signed little-endian; channels interleaved).

    Block ``i`` starts at sample ``block_starts[i]`` of the PCM and at byte
    ``frame_starts[i]`` of the stream.
    """

    pcm: bytes
    block_starts: np.ndarray
    frame_starts: np.ndarray
    samples: np.ndarray
    sample_bytes: int

    def seek(self, first: int, count: int) -> bytes:
        """PCM of ``count`` samples from ``first`` on."""
        width = self.sample_bytes * self.samples.shape[1]
        return self.pcm[first * width : (first + count) * width]


def decode_streams(streams: list[bytes]) -> list[Decoded]:
    """Decodes and verifies every stream."""
    infos = [_stream_info(s) for s in streams]
    bases = np.cumsum([0, *[len(s) for s in streams]]).tolist()
    found = [_find_frames(s, info, i, base) for i, (s, info, base) in enumerate(zip(streams, infos, bases))]
    joined = b"".join(streams)
    flat = np.frombuffer(joined, np.uint8)
    for i in _failed_streams([f for own in found for f in own], flat):
        found[i] = _checked_frames(streams[i], infos[i], i, bases[i])  # damage, or the number of samples is not known
    frames = [f for own in found for f in own]
    parts: list[np.ndarray | None] = [None] * len(frames)
    order = sorted(range(len(frames)), key=lambda i: (frames[i].channels, frames[i].mode, -frames[i].size))
    bits = _Bits(joined)
    at = 0
    while at < len(order):
        first = frames[order[at]]
        same = [i for i in order[at : at + 4096] if (frames[i].channels, frames[i].mode) == (first.channels, first.mode)]
        for i, samples in zip(same, _decode_frames(bits, [frames[i] for i in same])):
            parts[i] = samples
        at += len(same)
    of_stream: list[list[int]] = [[] for _ in streams]
    for i, f in enumerate(frames):
        of_stream[f.stream].append(i)
    return [_finished(info, [parts[i] for i in own], [frames[i].first for i in own], [frames[i].start - base for i in own]) for info, own, base in zip(infos, of_stream, bases)]


def _failed_streams(frames: list[_Frame], flat: np.ndarray) -> set[int]:
    """Streams with a frame that fails its checksum."""
    if not frames:
        return set()
    starts, ends = np.array([f.start for f in frames], np.int64), np.array([f.end for f in frames], np.int64)
    told = flat[ends].astype(np.uint32) << 8 | flat[ends + 1]
    wrong = np.flatnonzero(crc16_of(flat, starts, ends - starts) != told)
    return {frames[i].stream for i in wrong}


def _channels(bits: _Bits, frames: list[_Frame]) -> tuple[list[np.ndarray], np.ndarray]:
    """The coded channels of frames that share their number and mode, and the bits where the frames' codes end."""
    at, sizes = np.array([f.body for f in frames], np.int64), np.array([f.size for f in frames], np.int64)
    width, mode = np.array([f.bits for f in frames], np.int64), frames[0].mode
    channels = []
    for c in range(frames[0].channels):
        side = mode == 8 and c == 1 or mode == 9 and c == 0 or mode == 10 and c == 1
        samples, at = _subframes(bits, at, sizes, width + side)
        channels.append(samples)
    return channels, at


def _decode_frames(bits: _Bits, frames: list[_Frame]) -> list[np.ndarray]:
    """Samples (count x channels) of frames that share the number of channels and their mode."""
    mode, channels = frames[0].mode, _channels(bits, frames)[0]
    if mode == 8:
        channels[1] = channels[0] - channels[1]
    elif mode == 9:
        channels[0] = channels[1] + channels[0]
    elif mode == 10:
        middle = channels[0] << 1 | channels[1] & 1
        channels = [(middle + channels[1]) >> 1, (middle - channels[1]) >> 1]
    both = np.stack(channels, axis=2)
    return [both[i, : f.size] for i, f in enumerate(frames)]


def _finished(info: _Info, parts: list[np.ndarray], firsts: list[int], starts: list[int]) -> Decoded:
    samples = np.concatenate(parts) if parts else np.zeros((0, info.channels), np.int64)
    width = -(-info.bits // 8)
    raw = np.ascontiguousarray(samples.astype("<i4")).view(np.uint8).reshape(-1, 4)[:, :width].tobytes()
    if info.md5 != b"\0" * 16 and hashlib.md5(raw).digest() != info.md5:
        raise ValueError("the samples fail the stream's MD5")
    pcm = (np.frombuffer(raw, np.uint8) ^ 0x80).tobytes() if width == 1 else raw
    return Decoded(pcm, np.array(firsts, np.int64), np.array(starts, np.int64), samples, width)


def feature(samples: np.ndarray) -> str:
    """Energy, sign changes and peak of the samples, as whole numbers."""
    flat = samples.ravel()
    changes = int(((flat[1:] < 0) != (flat[:-1] < 0)).sum()) if len(flat) else 0
    return f"energy={int((flat * flat).sum())};crossings={changes};peak={int(np.abs(flat).max()) if len(flat) else 0}"


# Columns


def payload(text: str) -> bytes:
    """The text as UTF-8, filled with zeros to a positive multiple of 64 bytes."""
    data = text.encode()
    return data + b"\0" * (64 - len(data) if not data else -len(data) % 64)


def store(docs: DataFrame) -> DataFrame:
    """Every text as a media column: ``doc_id``, ``n_bytes`` before filling up, and the FLAC ``media``."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1024, "text", 1 << 20):
            texts = texts_of(batch, "text")
            media = encode_streams([payload(t) for t in texts])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([len(t.encode()) for t in texts], pa.int64()), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"])

    return id_and_text(docs).mapInArrow(work, MEDIA)


def load(media: DataFrame) -> DataFrame:
    """The decoded and verified ``media``: its PCM, where its blocks start, and a ``feature`` of its samples."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1024, "media", 1 << 20):
            done = decode_streams(batch.column("media").to_pylist())
            arrays = [batch.column(c) for c in ("doc_id", "n_bytes", "media")]
            arrays += [pa.array([d.pcm for d in done], pa.binary()), packed_longs([d.block_starts for d in done]), packed_longs([d.frame_starts for d in done]), pa.array([feature(d.samples) for d in done], pa.string())]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "n_bytes", "media", "pcm", "block_starts", "frame_starts", "feature"])

    return media.filter(F.col("media").isNotNull()).select("doc_id", "n_bytes", "media").mapInArrow(work, DECODED)


def stored_media(docs: DataFrame) -> DataFrame:
    """Sizes and checksums of every text's media and of what is read back from it."""
    return load(store(docs)).select(
        "doc_id", "n_bytes", F.length("pcm").cast("long").alias("payload_bytes"), F.sha2("pcm", 256).alias("payload_sha256"),
        F.crc32(F.substring("pcm", -64, 64)).alias("tail_crc32"), F.length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"), "feature",
    )
