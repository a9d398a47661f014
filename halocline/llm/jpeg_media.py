"""Media columns: baseline JPEG files whose thumbnails carry a payload without loss.

A sample is the DC coefficient of an 8 x 8 block: with a DC quantiser of 8 it is the block's mean less 128, so the
DC-only luminance thumbnail (one pixel a block) gives back every byte. AC coefficients are 0. Rows of blocks are restart
intervals, so the Huffman decoder runs over all intervals of a batch in step, in numpy. It reads any grey baseline scan:
markers, Huffman tables, quantisers, restart intervals, AC symbols (which a thumbnail only skips).

Cases: null and empty texts give one unit of padding; equal texts give equal files; payloads over one image's bounds are
cut into several images, one after another in the stored bytes; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import chunks, small_batches, text_bytes

UNIT = 576
WIDTH = 24
#: Blocks a side: a JPEG side has at most 65,535 pixels.
MOST_BLOCKS = 8191

# fixed values: the DC luminance table of the JPEG standard (code counts by length, symbols)
DC_BITS = bytes([0, 1, 5, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0, 0, 0])
DC_SYMBOLS = bytes(range(12))
# an AC table of one code: end of block
AC_BITS = bytes([1] + [0] * 15)
AC_SYMBOLS = bytes([0])


def huffman_codes(bits: bytes, symbols: bytes) -> dict[int, tuple[int, int]]:
    """symbol -> (code, length), canonical."""
    out, code, k = {}, 0, 0
    for length in range(1, 17):
        for _ in range(bits[length - 1]):
            out[symbols[k]] = (code, length)
            code, k = code + 1, k + 1
        code <<= 1
    return out


def _encoding_table() -> tuple[np.ndarray, np.ndarray]:
    """For every DC difference -255 .. 255 (and to 11 bits): the bits of code, value and end of block, and their number."""
    codes, (eob, eob_length) = huffman_codes(DC_BITS, DC_SYMBOLS), huffman_codes(AC_BITS, AC_SYMBOLS)[0]
    value, length = np.zeros(1023, np.uint32), np.zeros(1023, np.int64)
    for d in range(-511, 512):
        size = abs(d).bit_length()
        code, n = codes[size]
        extra = d if d >= 0 else d + (1 << size) - 1
        value[d + 511] = ((code << size | extra) << eob_length) | eob
        length[d + 511] = n + size + eob_length
    return value, length


VALUE, LENGTH = _encoding_table()


def _shape(n: int) -> tuple[int, int]:
    """(columns, rows) of blocks for n payload bytes, a multiple of UNIT; the narrowest width whose rows fit."""
    width = WIDTH
    while n // width > MOST_BLOCKS or n % width:
        width += WIDTH
    return width, n // width


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 255, marker, len(body) + 2) + body


def _header(width: int, height: int) -> bytes:
    parts = [b"\xff\xd8", _segment(0xE0, b"JFIF\0\1\1\0\0\1\0\1\0\0"), _segment(0xDB, b"\0" + bytes([8] + [1] * 63))]
    parts += [_segment(0xC0, struct.pack(">BHHB", 8, 8 * height, 8 * width, 1) + b"\1\x11\0")]
    parts += [_segment(0xC4, b"\0" + DC_BITS + DC_SYMBOLS), _segment(0xC4, b"\x10" + AC_BITS + AC_SYMBOLS)]
    parts += [_segment(0xDD, struct.pack(">H", width)), _segment(0xDA, b"\1\1\0\0\x3f\0")]
    return b"".join(parts)


def encode_rows(samples: np.ndarray, widths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Scan bytes of rows of samples (row k has widths[k] of them): (all stuffed bytes, n+1 offsets by row), without restart markers."""
    ends = np.concatenate([[0], np.cumsum(widths)])
    level = samples.astype(np.int32) - 128
    diff = np.empty(len(level), np.int64)
    diff[1:] = level[1:] - level[:-1]
    diff[ends[:-1]] = level[ends[:-1]]
    value, length = VALUE[diff + 511], LENGTH[diff + 511]
    bit = np.concatenate([[0], np.cumsum(length)])
    row_bits = bit[ends[1:]] - bit[ends[:-1]]
    row_bytes = (row_bits + 7) // 8
    row_at = np.concatenate([[0], np.cumsum(row_bytes)])
    start = bit[:-1] + np.repeat(row_at[:-1] * 8 - bit[ends[:-1]], widths)
    total = int(row_at[-1])
    moved = value.astype(np.uint64) << (40 - (start & 7) - length).astype(np.uint64)  # codes have 24 bits at most
    out = np.zeros(total + 5, np.float64)
    at = start >> 3
    for k in range(4):
        out += np.bincount(at + k, ((moved >> np.uint64(32 - 8 * k)) & np.uint64(255)).astype(np.float64), total + 5)
    data = out[:total].astype(np.uint8)
    spare = (row_bytes * 8 - row_bits).astype(np.uint8)
    data[row_at[1:] - 1] |= ((1 << spare.astype(np.int64)) - 1).astype(np.uint8)
    full = data == 255  # a zero byte is stuffed behind each
    extra = np.concatenate([[0], np.cumsum(full)])
    stuffed = np.zeros(total + int(extra[-1]), np.uint8)
    stuffed[np.arange(total) + extra[:-1]] = data
    return stuffed, row_at + extra[row_at]


def encode_payloads(payloads: list[np.ndarray]) -> list[bytes]:
    """JPEG bytes of each payload (uint8, a positive multiple of UNIT)."""
    images, most = [], MOST_BLOCKS * UNIT  # beyond that some lengths have no legal shape; up to it the width UNIT fits
    for k, p in enumerate(payloads):
        for a in range(0, len(p), most):
            part = p[a : a + most]
            images.append((k, part, *_shape(len(part))))
    widths = np.concatenate([np.full(h, w) for _, _, w, h in images])
    data, offsets = encode_rows(np.concatenate([x[1] for x in images]), widths)
    raw, out, row = data.tobytes(), [[] for _ in payloads], 0
    marks = [bytes([255, 0xD0 + i]) for i in range(8)]
    for k, _, w, h in images:
        parts = out[k]
        parts.append(_header(w, h))
        cut = offsets[row : row + h + 1].tolist()
        for i in range(h):
            parts.append(raw[cut[i] : cut[i + 1]])
            parts.append(marks[i % 8] if i < h - 1 else b"\xff\xd9")
        row += h
    return [b"".join(x) for x in out]


def _lookup(bits: bytes, symbols: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(symbol, code length) by the next 16 bits; length 0: no such code."""
    symbol, length = np.zeros(65536, np.uint8), np.zeros(65536, np.uint8)
    for s, (code, n) in huffman_codes(bits, symbols).items():
        symbol[code << (16 - n) : (code + 1) << (16 - n)] = s
        length[code << (16 - n) : (code + 1) << (16 - n)] = n
    return symbol, length


_TABLES: dict[bytes, tuple[np.ndarray, np.ndarray]] = {}


def _table(spec: bytes) -> tuple[np.ndarray, np.ndarray]:
    if spec not in _TABLES:
        if len(_TABLES) > 64:
            _TABLES.clear()
        _TABLES[spec] = _lookup(spec[:16], spec[16:])
    return _TABLES[spec]


def parse_markers(data: bytes, at: int = 0) -> dict:
    """The frame that begins at byte `at`: width and height in pixels, tables, and the scan's place; ValueError if it isn't grey baseline."""
    if data[at : at + 2] != b"\xff\xd8":
        raise ValueError("no start of image")
    frame, pos = {"quant": {}, "dc": {}, "ac": {}, "restart": 0}, at + 2
    while True:
        if pos + 4 > len(data) or data[pos] != 255:
            raise ValueError("damaged marker")
        marker, size = data[pos + 1], struct.unpack_from(">H", data, pos + 2)[0]
        body, pos = data[pos + 4 : pos + 2 + size], pos + 2 + size
        if marker == 0xDB:
            while body:
                wide = body[0] >> 4
                first = struct.unpack_from(">H" if wide else ">B", body, 1)[0]
                frame["quant"][body[0] & 15] = first
                body = body[1 + 64 * (1 + wide) :]
        elif marker == 0xC4:
            while body:
                n = sum(body[1:17])
                frame["ac" if body[0] >> 4 else "dc"][body[0] & 15] = body[1 : 17 + n]
                body = body[17 + n :]
        elif marker == 0xC0:
            depth, frame["height"], frame["width"], parts = struct.unpack_from(">BHHB", body)
            if depth != 8 or parts != 1:
                raise ValueError("only grey baseline frames of 8 bits")
            frame["quantiser"] = body[8]
        elif marker in (0xC1, 0xC2, 0xC3, *range(0xC5, 0xC8), *range(0xC9, 0xCC), *range(0xCD, 0xD0)):
            raise ValueError("not a baseline frame")
        elif marker == 0xDD:
            frame["restart"] = struct.unpack(">H", body)[0]
        elif marker == 0xDA:
            frame["tables"] = frame["dc"][body[2] >> 4], frame["ac"][body[2] & 15]
            frame["scan"] = pos
            return frame


def decode_intervals(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, blocks: np.ndarray, dc: tuple, ac: tuple) -> np.ndarray:
    """Quantised DC values of all blocks of the intervals [starts, ends) of unstuffed bytes, in order; intervals go in step."""
    n = len(starts)
    padded = np.concatenate([data, np.full(8, 255, np.uint8)]).astype(np.uint32)
    window = (padded[:-3] << 24) | (padded[1:-2] << 16) | (padded[2:-1] << 8) | padded[3:]  # 32 bits from each byte on
    out_at = np.concatenate([[0], np.cumsum(blocks)])
    out = np.zeros(int(out_at[-1]), np.int32)
    order = np.argsort(-blocks, kind="stable")  # the longest first, so that the live ones are always a prefix
    bit, last, left = starts[order].astype(np.int64) * 8, np.zeros(n, np.int32), blocks[order]
    limit, place = ends[order].astype(np.int64) * 8, out_at[:-1][order].copy()
    peek = lambda b: ((window[b >> 3] << (b & 7).astype(np.uint32)) >> np.uint32(16)).astype(np.int64)
    for turn in range(int(left[0]) if n else 0):
        live = int(np.searchsorted(-left, -turn, "left"))  # intervals of more than `turn` blocks
        b = bit[:live]
        bits = peek(b)
        size, used = dc[0][bits].astype(np.int64), dc[1][bits]
        if not used.all():
            raise ValueError("no such Huffman code")
        b = b + used
        extra = peek(b) >> (16 - size)
        value = np.where((size > 0) & (extra < (1 << np.maximum(size - 1, 0))), extra - (1 << size) + 1, extra)
        b = b + size
        last[:live] += value.astype(np.int32)
        out[place[:live] + turn] = last[:live]
        k, todo = np.ones(live, np.int64), np.arange(live)
        while len(todo):  # AC symbols up to the end of the block; mostly one round
            bits = peek(b[todo])
            symbol, used = ac[0][bits].astype(np.int64), ac[1][bits]
            if not used.all():
                raise ValueError("no such Huffman code")
            b[todo] += used + (symbol & 15)
            k[todo] += np.where(symbol == 0, 64, (symbol >> 4) + 1)
            todo = todo[k[todo] < 64]
        bit[:live] = b
        if (b > limit[:live]).any():
            raise ValueError("the scan ends early")
    return out


def decode_thumbnails(files: list[bytes]) -> list[list[np.ndarray]]:
    """For each stored value its images' DC-only luminance thumbnails, (rows, columns) uint8."""
    found, groups = [], {}
    for k, data in enumerate(files):
        at = 0
        while at < len(data):
            frame = parse_markers(data, at)
            array = np.frombuffer(data, np.uint8)
            wide, high = -(-frame["width"] // 8), -(-frame["height"] // 8)
            end = data.find(b"\xff\xd9", frame["scan"])
            if end < 0:
                raise ValueError("no end of image")
            found.append((k, wide, high, frame["quant"][frame["quantiser"]]))
            groups.setdefault(frame["tables"], []).append((len(found) - 1, array[frame["scan"] : end], wide * high, frame["restart"] or wide * high))
            at = end + 2
    thumbs: list = [None] * len(found)
    for (dc, ac), members in groups.items():
        scans = np.concatenate([m[1] for m in members])
        first = np.concatenate([[0], np.cumsum([len(m[1]) for m in members])])
        marked = np.flatnonzero(scans[:-1] == 255)
        follow = scans[marked + 1]
        drop = np.zeros(len(scans), bool)
        restarts = marked[(follow >= 0xD0) & (follow <= 0xD7)]
        drop[marked[follow == 0] + 1] = True
        drop[restarts] = drop[restarts + 1] = True
        kept = np.concatenate([[0], np.cumsum(~drop)])
        bounds = np.sort(np.concatenate([first[:-1], restarts]))
        starts = kept[bounds]
        ends = np.append(starts[1:], kept[-1])
        blocks = np.concatenate([_intervals(total, step) for _, _, total, step in members])
        if len(blocks) != len(starts):
            raise ValueError("restart markers are missing")
        values = decode_intervals(scans[~drop], starts, ends, blocks, _table(dc), _table(ac))
        at = 0
        for k, _, total, _ in members:
            _, wide, high, quant = found[k]
            level = np.floor_divide(values[at : at + total] * quant + 4, 8) + 128  # a DC coefficient is eight times the mean
            thumbs[k] = np.clip(level, 0, 255).astype(np.uint8).reshape(high, wide)
            at += total
    out: list[list[np.ndarray]] = [[] for _ in files]
    for (k, *_), thumb in zip(found, thumbs, strict=True):
        out[k].append(thumb)
    return out


def _intervals(total: int, step: int) -> np.ndarray:
    return np.minimum(step, total - np.arange(0, total, step))


def gradient_bits(image: np.ndarray) -> str:
    """64 bits over all pixels, in hex: whether each cell of a 9 x 8 reduction is brighter than its right neighbour."""
    high, wide = image.shape
    rows, cols = np.minimum(np.arange(9) * high // 8, high), np.minimum(np.arange(10) * wide // 9, wide)
    sums = np.zeros((high + 1, wide + 1), np.int64)
    sums[1:, 1:] = image.cumsum(0, dtype=np.int64).cumsum(1)
    area = sums[rows[1:]][:, cols[1:]] - sums[rows[:-1]][:, cols[1:]] - sums[rows[1:]][:, cols[:-1]] + sums[rows[:-1]][:, cols[:-1]]
    mean = area / np.maximum(1, np.outer(np.diff(rows), np.diff(cols)))
    return np.packbits(mean[:, :-1] > mean[:, 1:]).tobytes().hex()


def thumbnail_hash(images: list[np.ndarray]) -> str:
    """Of every image in order, joined by semicolons: its dimensions in pixels, the number of images, and its gradient bits."""
    return ";".join(f"{8 * x.shape[1]}x{8 * x.shape[0]}x{len(images)}:{gradient_bits(x)}" for x in images)


SCHEMA = "doc_id long, n_bytes long, media binary, width int, height int, n_images int, thumbnail binary, feature string"


def store_media(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, media, width, height, n_images, thumbnail, feature): the texts as JPEG files, and what is read back from these.

    width and height are the first image's; feature has those of all.
    """

    def convert(batches):
        for batch in batches:
            data, offsets = text_bytes(batch.column(1))
            for a, b in chunks(offsets):
                sizes = np.diff(offsets[a : b + 1])
                padded = np.maximum(1, -(-sizes // UNIT)) * UNIT
                ends = np.concatenate([[0], np.cumsum(padded)])
                payload = np.full(int(ends[-1]), 255, np.uint8)
                part = data[offsets[a] : offsets[b]]
                payload[np.arange(len(part)) + np.repeat(ends[:-1] - (offsets[a:b] - offsets[a]), sizes)] = part
                media = encode_payloads([payload[x:y] for x, y in zip(ends[:-1], ends[1:], strict=True)])
                images = decode_thumbnails(media)
                back = [b"".join(t.tobytes() for t in x) for x in images]
                columns = [batch.column(0).slice(a, b - a), pa.array(sizes), pa.array(media, pa.binary()), pa.array([8 * x[0].shape[1] for x in images], pa.int32()), pa.array([8 * x[0].shape[0] for x in images], pa.int32()), pa.array([len(x) for x in images], pa.int32()), pa.array(back, pa.binary()), pa.array([thumbnail_hash(x) for x in images])]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_bytes", "media", "width", "height", "n_images", "thumbnail", "feature"])

    small_batches(docs.sparkSession)
    return docs.selectExpr("CAST(doc_id AS LONG) AS doc_id", "CAST(text AS STRING) AS text").mapInArrow(convert, SCHEMA)


def digests(stored: DataFrame) -> DataFrame:
    """The payload's and the media's digests, in the JVM."""
    return stored.selectExpr("doc_id", "n_bytes", "CAST(octet_length(thumbnail) AS LONG) AS payload_bytes", "sha2(thumbnail, 256) AS payload_sha256", "crc32(substring(thumbnail, -32, 32)) AS tail_crc32", "CAST(octet_length(media) AS LONG) AS media_bytes", "sha2(media, 256) AS media_sha256", "feature", "width", "height", "n_images")
