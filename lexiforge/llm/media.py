"""Media columns: byte payloads in progressive JPEG, decoded to full-resolution RGB.

Encoding.  A payload byte becomes one AC coefficient of size category 8, whose
256 values are exactly -255..-128 and 128..255, so nothing is quantised away.
Zigzag places 1 to 48 of every block carry bytes; a 4:2:0 image of two units (12
blocks) holds 576 of them.  Four kinds of scan follow each other: DC, places 1-16
and 17-48 without their lowest bit, and the refinement of places 1-48.

Decoding.  Spectral-selection and successive-approximation scans add up in arrays
of coefficients, whatever their tables; scans whose Huffman table has a single
symbol have codes of one width and are read by numpy at once.  Coefficients go
through an inverse transform in numpy (scaled whole numbers, so results do not
depend on the machine), chroma is upsampled, and RGB comes out in full size.

Defined cases.  Null text: an empty payload, padded as any other.  Long texts use
a wider image (a JPEG has at most 65535 rows).  Repeated rows give equal values.
Null doc_ids are kept.  An empty table gives an empty result.  Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from .common import Scratch, as_bytes, columns_free_of, text_batches

UNIT, CARRIED, PAD = 576, 48, 255
MOST_ROWS = 4095  # of 16 pixels


def _zigzag() -> np.ndarray:
    """Row-major place of each zigzag place."""
    cells = sorted(((i + j, (i if (i + j) % 2 else j), i, j) for i in range(8) for j in range(8)))
    return np.array([8 * i + j for _, _, i, j in cells])


ZIGZAG = _zigzag()
_BITS = 13


def _basis() -> np.ndarray:
    """Zigzag coefficient to pixel, times 2**13 in whole numbers."""
    x = np.arange(8)
    c = np.cos((2 * x[None] + 1) * x[:, None] * np.pi / 16) / 2
    c[0] /= np.sqrt(2)
    full = np.einsum("ux,vy->uvxy", c, c).reshape(64, 64)
    return np.round(full * (1 << _BITS))[ZIGZAG]


BASIS = _basis()


def _marker(code: int, body: bytes) -> bytes:
    return bytes([0xFF, code]) + (len(body) + 2).to_bytes(2, "big") + body


def _single(kind: int, symbol: int) -> bytes:
    """A Huffman table with one symbol, coded as the bit 0."""
    return _marker(0xC4, bytes([kind << 4, 1, *[0] * 15, symbol]))


def _scan(parts: list[int], table: int, begin: int, end: int, high: int, low: int, data: bytes) -> bytes:
    head = bytes([len(parts), *[x for p in parts for x in (p, table)], begin, end, high << 4 | low])
    return _marker(0xDA, head) + data


def _packed(bits: np.ndarray) -> bytes:
    bits = np.concatenate([bits.ravel(), np.ones(-bits.size % 8, np.uint8)])
    return np.packbits(bits).tobytes().replace(b"\xff", b"\xff\x00")


def pad(data: bytes) -> bytes:
    return data + bytes([PAD]) * (UNIT - len(data) if not data else -len(data) % UNIT)


def encode(payload: bytes) -> bytes:
    """A progressive 4:2:0 JPEG whose coefficients hold ``payload`` (a multiple of 576 bytes)."""
    if not payload or len(payload) % UNIT:
        raise ValueError("the payload must be a positive multiple of 576 bytes")
    units = len(payload) // (UNIT // 2)
    across = 2 * -(-units // (2 * MOST_ROWS))
    down = -(-units // across)
    data = np.zeros((across * down, 6, CARRIED), np.uint8)
    data.reshape(-1)[: len(payload)] = np.frombuffer(payload, np.uint8)
    planes = [data[:, :4].reshape(-1, CARRIED), data[:, 4], data[:, 5]]
    out = [b"\xff\xd8", _marker(0xFE, f"bytes={len(payload)}".encode()), _marker(0xDB, b"\x00" + b"\x01" * 64)]
    out.append(_marker(0xC2, b"\x08" + (16 * down).to_bytes(2, "big") + (16 * across).to_bytes(2, "big") + bytes([3, 1, 0x22, 0, 2, 0x11, 0, 3, 0x11, 0])))
    out += [_single(0, 0), _scan([1, 2, 3], 0, 0, 0, 0, 0, _packed(np.zeros(6 * across * down, np.uint8)))]
    out.append(_single(1, 0x07))
    for begin, end in ((1, 16), (17, CARRIED)):
        # Code bit 0 and seven bits of value: one byte, never 0xFF.
        out += [_scan([i + 1], 0, begin, end, 0, 1, (p[:, begin - 1 : end] >> 1).tobytes()) for i, p in enumerate(planes)]
    out.append(_single(1, 0x00))
    for i, p in enumerate(planes):
        low = np.zeros((len(p), CARRIED + 1), np.uint8)
        low[:, 1:] = (p & 1) ^ (p < 128)
        out.append(_scan([i + 1], 0, 1, CARRIED, 1, 0, _packed(low)))
    return b"".join(out) + b"\xff\xd9"


@dataclass
class Frame:
    """A decoded frame: per component its blocks of zigzag coefficients in raster order."""

    height: int = 0
    width: int = 0
    comment: bytes = b""
    factors: list = field(default_factory=list)
    grids: list = field(default_factory=list)
    real: list = field(default_factory=list)
    quant: list = field(default_factory=list)
    blocks: list = field(default_factory=list)


class _Bits:
    def __init__(self, data: bytes):
        self.data, self.at, self.held, self.value = data, 0, 0, 0

    def take(self, n: int) -> int:
        while self.held < n:
            byte = self.data[self.at] if self.at < len(self.data) else 0xFF
            self.value, self.held, self.at = self.value << 8 | byte, self.held + 8, self.at + 1
        self.held -= n
        out = self.value >> self.held
        self.value &= (1 << self.held) - 1
        return out

    def symbol(self, table: dict) -> int:
        code = n = 0
        while n < 16:
            code, n = code << 1 | self.take(1), n + 1
            if (n, code) in table:
                return table[n, code]
        raise ValueError("a bad Huffman code")

    def signed(self, size: int) -> int:
        v = self.take(size) if size else 0
        return v if not size or v >> (size - 1) else v - (1 << size) + 1


def _tables(body: bytes, into: dict):
    while body:
        counts, code, at, table = body[1:17], 0, 17, {}
        for n, k in enumerate(counts, 1):
            for _ in range(k):
                table[n, code] = body[at]
                code, at = code + 1, at + 1
            code <<= 1
        into[body[0] >> 4, body[0] & 15] = table
        body = body[at:]


def _one_symbol(table: dict | None):
    return next(iter(table.values())) if table and len(table) == 1 and (1, 0) in table else None


def _quick(frame, comps, tables, begin, end, high, low, data) -> bool:
    """Scans whose table has one symbol; False if this one is not of that kind."""
    if begin == 0:
        if high or any(_one_symbol(tables.get((0, t))) != 0 for _, t, _ in comps):
            return False
        return True  # every difference is zero
    (c, _, table), band = comps[0], end - begin + 1
    symbol = _one_symbol(tables.get((1, table)))
    blocks = frame.blocks[c]
    if frame.real[c] != frame.grids[c] or symbol is None:
        return False
    if not high:
        size = symbol & 15
        if symbol >> 4 or not size:
            return False
        need = len(blocks) * band * (size + 1)
        if size == 7:
            v = np.frombuffer(data, np.uint8, need // 8).astype(np.int16)
        else:
            bits = np.unpackbits(np.frombuffer(data, np.uint8), count=need).reshape(-1, size + 1)
            v = bits[:, 1:].astype(np.int32) @ (1 << np.arange(size)[::-1])
        v = np.where(v >> (size - 1), v, v - (1 << size) + 1).reshape(len(blocks), band)
        blocks[:, begin : end + 1] = v * (1 << low)
        return True
    part = blocks[:, begin : end + 1]
    if symbol or not part.all():
        return False
    bits = np.unpackbits(np.frombuffer(data, np.uint8), count=len(blocks) * (band + 1)).reshape(len(blocks), band + 1)
    part += np.where(part > 0, 1, -1).astype(part.dtype) * (bits[:, 1:].astype(part.dtype) << low)
    return True


def _slow(frame, comps, tables, begin, end, high, low, chunks, restart):
    """Any progressive scan, bit by bit."""
    if len(comps) > 1:
        places, (ty, tx) = [], (max(f[1] for f in frame.factors), max(f[0] for f in frame.factors))
        for my in range(-(-frame.height // (8 * ty))):
            for mx in range(-(-frame.width // (8 * tx))):
                places.append([(i, (my * frame.factors[c][1] + v) * frame.grids[c][1] + mx * frame.factors[c][0] + u) for i, (c, _, _) in enumerate(comps) for v in range(frame.factors[c][1]) for u in range(frame.factors[c][0])])
    else:
        c = comps[0][0]
        places = [[(0, y * frame.grids[c][1] + x)] for y in range(frame.real[c][0]) for x in range(frame.real[c][1])]
    step = restart or len(places)
    for k, chunk in enumerate(chunks):
        bits, last, run = _Bits(chunk), [0] * len(comps), 0
        for i, b in (x for group in places[k * step : (k + 1) * step] for x in group):
            c, dc, ac = comps[i]
            block = frame.blocks[c][b]
            if begin == 0:
                if high:
                    block[0] |= bits.take(1) << low
                else:
                    last[i] += bits.signed(bits.symbol(tables[0, dc]))
                    block[0] = last[i] << low
                continue
            at, table = begin, tables[1, ac]

            def refine(value):
                return value + ((1 << low) if value > 0 else -(1 << low)) if bits.take(1) else value

            while at <= end and not run:
                rs = bits.symbol(table)
                zeros, size = rs >> 4, rs & 15
                if not size and zeros < 15:
                    run = (1 << zeros) + bits.take(zeros)
                    break
                new = bits.signed(size) if not high else (0 if not size else (1 if bits.take(1) else -1))
                if not high:
                    at += zeros
                    if size:
                        block[at] = new * (1 << low)
                    at += 1
                    continue
                while at <= end:
                    if block[at]:
                        block[at] = refine(block[at])
                    elif zeros:
                        zeros -= 1
                    else:
                        if new:
                            block[at] = new * (1 << low)
                        at += 1
                        break
                    at += 1
            if run:
                run -= 1
                if high:
                    for p in range(at, end + 1):
                        if block[p]:
                            block[p] = refine(block[p])


def decode(media: bytes, quick: bool = True) -> Frame:
    """Accumulate all scans of a progressive JPEG."""
    frame, tables, quants, restart, names = Frame(), {}, {}, 0, []
    at = 2
    if media[:2] != b"\xff\xd8":
        raise ValueError("not a JPEG")
    while media[at : at + 2] != b"\xff\xd9":
        code, size = media[at + 1], int.from_bytes(media[at + 2 : at + 4], "big")
        body, at = media[at + 4 : at + 2 + size], at + 2 + size
        if code == 0xFE:
            frame.comment = body
        elif code == 0xDB:
            while body:
                wide = body[0] >> 4
                step = 128 if wide else 64
                quants[body[0] & 15] = np.frombuffer(body[1 : 1 + step], ">u2" if wide else np.uint8).astype(np.int32)
                body = body[1 + step :]
        elif code == 0xC4:
            _tables(body, tables)
        elif code == 0xDD:
            restart = int.from_bytes(body, "big")
        elif code == 0xC2:
            frame.height, frame.width = int.from_bytes(body[1:3], "big"), int.from_bytes(body[3:5], "big")
            for i in range(body[5]):
                name, f, q = body[6 + 3 * i : 9 + 3 * i]
                names.append((name, q))
                frame.factors.append((f >> 4, f & 15))
            tx, ty = max(f[0] for f in frame.factors), max(f[1] for f in frame.factors)
            for fx, fy in frame.factors:
                frame.grids.append((-(-frame.height // (8 * ty)) * fy, -(-frame.width // (8 * tx)) * fx))
                frame.real.append((-(-(-(-frame.height * fy // ty)) // 8), -(-(-(-frame.width * fx // tx)) // 8)))
                frame.blocks.append(np.zeros((frame.grids[-1][0] * frame.grids[-1][1], 64), np.int16))
        elif code == 0xDA:
            comps = [([n for n, _ in names].index(body[1 + 2 * i]), body[2 + 2 * i] >> 4, body[2 + 2 * i] & 15) for i in range(body[0])]
            begin, end, approx = body[1 + 2 * body[0] : 4 + 2 * body[0]]
            chunks, start, stop = [], at, at
            while True:
                stop = media.index(b"\xff", stop)
                mark = media[stop + 1]
                if mark == 0:
                    stop += 2
                    continue
                chunks.append(media[start:stop].replace(b"\xff\x00", b"\xff"))
                if not 0xD0 <= mark <= 0xD7:
                    break
                start = stop = stop + 2
            at = stop
            high, low = approx >> 4, approx & 15
            if not (quick and len(chunks) == 1 and _quick(frame, comps, tables, begin, end, high, low, chunks[0])):
                _slow(frame, comps, tables, begin, end, high, low, chunks, restart)
        elif 0xC0 <= code <= 0xCF:
            raise ValueError("only progressive Huffman frames")
    frame.quant = [quants[q] for _, q in names]
    return frame


def payload_of(frame: Frame) -> bytes:
    """The bytes that :func:`encode` put into the coefficients."""
    size = int(frame.comment.removeprefix(b"bytes="))
    y, cb, cr = (b[:, 1 : CARRIED + 1] for b in frame.blocks)
    data = np.empty((len(cb), 6, CARRIED), np.uint8)
    for at, part in ((slice(0, 4), y.reshape(-1, 4, CARRIED)), (4, cb), (5, cr)):
        data[:, at] = np.where(part < 0, part + 255, part)
    return data.tobytes()[:size]


def rgb(frame: Frame) -> np.ndarray:
    """Height x width x 3 bytes: inverse transform, chroma upsampled by repetition."""
    tx, ty = max(f[0] for f in frame.factors), max(f[1] for f in frame.factors)
    planes = []
    for (fx, fy), (down, across), q, blocks in zip(frame.factors, frame.grids, frame.quant, frame.blocks):
        pixels = (blocks * q).astype(np.float64) @ BASIS
        pixels = np.clip(np.floor(pixels / (1 << _BITS) + 128.5), 0, 255).astype(np.uint8)
        plane = pixels.reshape(down, across, 8, 8).swapaxes(1, 2).reshape(8 * down, 8 * across)
        plane = plane.repeat(ty // fy, 0).repeat(tx // fx, 1)
        planes.append(plane[: frame.height, : frame.width].astype(np.int32))
    if len(planes) == 1:
        return np.repeat(planes[0][:, :, None].astype(np.uint8), 3, 2)
    y, cb, cr = planes[0] << 16, planes[1] - 128, planes[2] - 128
    # The JFIF conversion, times 65536.
    out = np.empty((frame.height, frame.width, 3), np.uint8)
    for i, v in enumerate((y + 91881 * cr, y - 22554 * cb - 46802 * cr, y + 116130 * cb)):
        out[:, :, i] = np.clip(v + 32768 >> 16, 0, 255)
    return out


#: Rows whose tensors are made at a time.
TENSOR_ROWS = 16


def media_column(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, media (a progressive JPEG file of the padded text)."""

    def run(batches):
        for batch in batches:
            texts = as_bytes(batch["text"])
            yield pd.DataFrame({"doc_id": batch["doc_id"].astype("Int64"), "n_bytes": [len(t) for t in texts], "media": [encode(pad(t)) for t in texts]})

    text_batches(docs.sparkSession)
    return columns_free_of(docs, "doc_id", "text").mapInPandas(run, "doc_id long, n_bytes long, media binary")


def tensors(stored: DataFrame) -> DataFrame:
    """doc_id, height, width, rgb (height x width x 3 bytes, row by row) of a media column."""

    def run(batches):
        for batch in batches:
            for at in range(0, len(batch), TENSOR_ROWS):
                some = batch.iloc[at : at + TENSOR_ROWS]
                frames = [decode(bytes(m)) for m in some["media"]]
                yield pd.DataFrame({"doc_id": some["doc_id"].astype("Int64").to_numpy(object), "height": [f.height for f in frames], "width": [f.width for f in frames], "rgb": [rgb(f).tobytes() for f in frames]}).astype({"doc_id": "Int64"})

    text_batches(stored.sparkSession)
    return columns_free_of(stored, "doc_id", "media").mapInPandas(run, "doc_id long, height int, width int, rgb binary")


def digest(media: bytes) -> tuple:
    """What a stored file holds: its payload's size and hashes, its own, and features of its image."""
    frame = decode(media)
    payload, image = payload_of(frame), rgb(frame)
    means = ",".join(f"{image[:, :, i].sum(dtype=np.int64) / image[:, :, i].size:.3f}" for i in range(3))
    feature = f"{frame.height}x{frame.width}x3 mean {means} crc {zlib.crc32(image.tobytes()):08x}"
    return (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(media), hashlib.sha256(media).hexdigest(), feature)


def media_digests(stored: DataFrame) -> DataFrame:
    """doc_id, n_bytes and the digest of each file of a stored media column (doc_id, n_bytes, media)."""
    names = ["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]

    def run(batches):
        for batch in batches:
            out = pd.DataFrame([digest(bytes(m)) for m in batch["media"]], columns=names)
            out.insert(0, "doc_id", batch["doc_id"].astype("Int64").to_numpy(object))
            out.insert(1, "n_bytes", batch["n_bytes"].to_numpy())
            out["doc_id"] = out["doc_id"].astype("Int64")
            yield out

    text_batches(stored.sparkSession)
    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return columns_free_of(stored, "doc_id", "n_bytes", "media").mapInPandas(run, schema)


def store(docs: DataFrame) -> DataFrame:
    """The media column written to the shared folder and read back."""
    return Scratch(docs.sparkSession, "media").cut(media_column(docs), compression="zstd")
