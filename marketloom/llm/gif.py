"""Media columns for GIF: LZW code streams, palettes, disposal and transparency, timed frames with colour histograms."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from marketloom.llm.text import arrow_map, payload, text_parts

MAX_CODES = 4096
#: Canvases of more pixels than a task can hold are not composed; such a file gets a row that says so.
MAX_CANVAS = 1 << 26
#: Fixed values of the query's stored form: samples are padded to a multiple of BLOCK, frames are WIDTH samples wide and high at most.
BLOCK, WIDTH, DELAY_CS = 576, 96, 4
BITS = np.arange(12, dtype=np.uint32)


def code_widths(min_size: int) -> tuple[np.ndarray, np.ndarray]:
    """Bits of the k-th code after a clear code, and where it starts. The decoder's table grows by one for each code but the first."""
    k = np.arange(MAX_CODES + 8)
    width = np.minimum(12, np.floor(np.log2((1 << min_size) + 2 + np.maximum(0, k - 1))).astype(np.int64) + 1)
    return width, np.concatenate([[0], np.cumsum(width)])


_WIDTHS = {n: code_widths(n) for n in range(2, 9)}


def lzw_encode(samples: bytes, min_size: int = 8) -> bytes:
    """A GIF code stream: clear code, codes of growing width, clear again when the table is full, end code."""
    clear = 1 << min_size
    width, _ = _WIDTHS[min_size]
    codes = [clear << 8]
    widths = [np.array([min_size + 1])]
    emit, begun = codes.append, 1
    # Codes are kept shifted by eight bits, so that prefix | sample is the table's key.
    table: dict[int, int] = {}
    get, free = table.get, clear + 2 << 8
    rest = iter(samples)
    prefix = next(rest, -1)
    if prefix >= 0:
        prefix <<= 8
        for sample in rest:
            code = get(prefix | sample)
            if code:
                prefix = code
                continue
            emit(prefix)
            if free < MAX_CODES << 8:
                table[prefix | sample] = free
                free += 256
            else:
                emit(clear << 8)
                widths.append(width[: len(codes) - begun])
                begun = len(codes)
                table.clear()
                free = clear + 2 << 8
            prefix = sample << 8
        emit(prefix)
    emit(clear + 1 << 8)
    widths.append(width[: len(codes) - begun])
    values, sizes = np.array(codes, dtype=np.uint32) >> np.uint32(8), np.concatenate(widths)
    bits = ((values[:, None] >> BITS) & 1).astype(np.uint8)[BITS[None, :] < sizes[:, None]]
    return np.packbits(bits, bitorder="little").tobytes()


def lzw_decode(stream: bytes, min_size: int, limit: int) -> bytes:
    """The samples of a code stream, up to `limit`; a broken stream gives what comes before the break."""
    clear, end = 1 << min_size, (1 << min_size) + 1
    width, offset = _WIDTHS[min_size]
    data = np.frombuffer(stream + b"\0\0\0", dtype=np.uint8).astype(np.uint32)
    n_bits, at = 8 * len(stream), 0
    out: list[bytes] = []
    size = 0
    first = [bytes([i]) for i in range(clear)] + [b"", b""]
    while size < limit and at < n_bits:
        n = int(np.searchsorted(offset, n_bits - at, side="right")) - 1  # codes that may lie in the rest
        n = min(n, len(width))
        if n <= 0:
            break
        begin = at + offset[:n]
        byte = begin >> 3
        codes = ((data[byte] | data[byte + 1] << np.uint32(8) | data[byte + 2] << np.uint32(16)) >> (begin & 7).astype(np.uint32)) & ((1 << width[:n]) - 1).astype(np.uint32)
        stop = np.flatnonzero((codes == clear) | (codes == end))
        count = int(stop[0]) if len(stop) else n
        if count:
            table = first.copy()
            grow, put = table.append, out.append
            listed = codes[:count].tolist()
            if listed[0] >= clear:
                break
            previous = table[listed[0]]
            put(previous)
            room = MAX_CODES - len(table)
            for code in listed[1 : room + 1]:
                if code < len(table):
                    entry = table[code]
                    grow(previous + entry[:1])
                elif code == len(table):
                    entry = previous + previous[:1]
                    grow(entry)
                else:
                    return b"".join(out)[:limit]
                put(entry)
                previous = entry
            for code in listed[room + 1 :]:  # the table is full: codes only refer to it
                put(table[code])
            size = sum(map(len, out)) if len(out) < 64 else size + sum(map(len, out[-count:]))
        if not len(stop):
            if n < len(width):
                break
            # A full table and still no clear code: all later codes have 12 bits.
            at += int(offset[n])
            rest = np.arange(at, n_bits - 11, 12)
            byte = rest >> 3
            later = ((data[byte] | data[byte + 1] << np.uint32(8) | data[byte + 2] << np.uint32(16)) >> (rest & 7).astype(np.uint32)) & np.uint32(4095)
            halt = np.flatnonzero((later == clear) | (later == end))
            stopped = int(halt[0]) if len(halt) else len(later)
            filled = np.cumsum(np.fromiter(map(len, table), np.int64, len(table))[later[:stopped]])
            wanted = int(np.searchsorted(filled, limit - size)) + 1  # codes up to the limit
            out += [table[code] for code in later[: min(stopped, wanted)].tolist()]
            if wanted <= stopped or not len(halt) or later[stopped] == end:
                break
            size += int(filled[-1]) if stopped else 0
            at += 12 * (stopped + 1)
            continue
        if codes[count] == end:
            break
        at += int(offset[count] + width[count])
    return b"".join(out)[:limit]


@dataclass
class Frame:
    """One image as stored (indices) and the canvas (height, width, RGBA) as it is shown for delay_cs hundredths of a second."""

    indices: np.ndarray
    canvas: np.ndarray
    left: int
    top: int
    delay_cs: int
    disposal: int
    transparent: int | None


def colour_palette() -> np.ndarray:
    """256 distinct colours: three bits of red, three of green, two of blue."""
    i = np.arange(256)
    return np.stack([(i >> 5) * 255 // 7, (i >> 2 & 7) * 255 // 7, (i & 3) * 85], axis=1).astype(np.uint8)


def _blocks(data: bytes) -> bytes:
    return b"".join(bytes([len(data[i : i + 255])]) + data[i : i + 255] for i in range(0, len(data), 255)) + b"\0"


def encode_gif(frames: list[np.ndarray], palette: np.ndarray, delay_cs: int = DELAY_CS, disposal: int = 1, transparent: int | None = None) -> bytes:
    """A GIF89a file of frames (two-dimensional arrays of palette indices, at the top left of the canvas)."""
    height, width = max((f.shape[0] for f in frames), default=1), max((f.shape[1] for f in frames), default=1)
    size = max(1, (len(palette) - 1).bit_length())
    table = np.zeros((1 << size, 3), dtype=np.uint8)
    table[: len(palette)] = palette
    out = [b"GIF89a", width.to_bytes(2, "little"), height.to_bytes(2, "little"), bytes([0x80 | 0x70 | size - 1, 0, 0]), table.tobytes()]
    if len(frames) > 1:
        out.append(b"\x21\xff\x0bNETSCAPE2.0\x03\x01\x00\x00\x00")
    for frame in frames:
        h, w = frame.shape
        out.append(b"\x21\xf9\x04" + bytes([disposal << 2 | (transparent is not None)]) + delay_cs.to_bytes(2, "little") + bytes([transparent or 0, 0]))
        out.append(b"\x2c\0\0\0\0" + w.to_bytes(2, "little") + h.to_bytes(2, "little") + b"\0" + bytes([max(2, size)]))
        out.append(_blocks(lzw_encode(frame.astype(np.uint8).tobytes(), max(2, size))))
    return b"".join([*out, b"\x3b"])


def _deinterlace(rows: np.ndarray) -> np.ndarray:
    height = len(rows)
    order = [y for start, step in ((0, 8), (4, 8), (2, 4), (1, 2)) for y in range(start, height, step)]
    out = np.empty_like(rows)
    out[order] = rows
    return out


def file_status(data: bytes) -> str:
    """"ok", "no gif" or "canvas too large"."""
    if data[:6] not in (b"GIF87a", b"GIF89a") or len(data) < 13:
        return "no gif"
    pixels = int.from_bytes(data[6:8], "little") * int.from_bytes(data[8:10], "little")
    return "ok" if pixels <= MAX_CANVAS else "canvas too large"


def decode_gif(data: bytes) -> Iterator[Frame]:
    """The frames in order, with palettes, transparency and disposal applied. A file that breaks off, or has a frame beyond MAX_CANVAS pixels, gives the whole frames before; one whose status isn't "ok", none."""
    if file_status(data) != "ok":
        return
    width, height = int.from_bytes(data[6:8], "little"), int.from_bytes(data[8:10], "little")
    at, common = 13, None
    if data[10] & 0x80:
        n = 2 << (data[10] & 7)
        if len(data) < at + 3 * n:
            return
        common = np.frombuffer(data[at : at + 3 * n], dtype=np.uint8).reshape(-1, 3)
        at += 3 * n
    canvas = np.zeros((height, width, 4), dtype=np.uint8)
    delay, disposal, transparent = 0, 0, None

    def sub_blocks(at: int) -> tuple[bytes, int]:
        parts = []
        while at < len(data) and data[at]:
            parts.append(data[at + 1 : at + 1 + data[at]])
            at += 1 + data[at]
        return b"".join(parts), at + 1

    while at < len(data):
        kind = data[at]
        if kind == 0x21 and at + 1 < len(data):
            label = data[at + 1]
            body, at = sub_blocks(at + 2)
            if label == 0xF9 and len(body) >= 4:
                disposal, delay = body[0] >> 2 & 7, int.from_bytes(body[1:3], "little")
                transparent = body[3] if body[0] & 1 else None
        elif kind == 0x2C and at + 10 < len(data):
            left, top, w, h = (int.from_bytes(data[i : i + 2], "little") for i in range(at + 1, at + 9, 2))
            flags, at, palette = data[at + 9], at + 10, common
            if flags & 0x80:
                n = 2 << (flags & 7)
                if len(data) < at + 3 * n:
                    return
                palette = np.frombuffer(data[at : at + 3 * n], dtype=np.uint8).reshape(-1, 3)
                at += 3 * n
            if at >= len(data) or not 2 <= data[at] <= 8 or palette is None or w * h > MAX_CANVAS:
                return
            stream, after = sub_blocks(at + 1)
            samples = lzw_decode(stream, data[at], w * h)
            at = after
            if len(samples) < w * h:
                return
            indices = np.frombuffer(samples, dtype=np.uint8).reshape(h, w)
            if flags & 0x40:
                indices = _deinterlace(indices)
            before = canvas.copy() if disposal == 3 else None
            part = canvas[top : top + h, left : left + w]
            shown = indices[: part.shape[0], : part.shape[1]]
            rgb = palette[np.minimum(shown, len(palette) - 1)]
            if transparent is None:
                part[..., :3], part[..., 3] = rgb, 255
            else:
                opaque = shown != transparent
                part[opaque, :3], part[opaque, 3] = rgb[opaque], 255
            yield Frame(indices, canvas.copy(), left, top, delay, disposal, transparent)
            if disposal == 2:
                canvas[top : top + h, left : left + w] = 0
            elif before is not None:
                canvas = before
            delay, disposal, transparent = 0, 0, None
        else:
            return


def colour_histogram(canvas: np.ndarray) -> np.ndarray:
    """Opaque pixels of a canvas by the top bit of red, green and blue: eight counts."""
    high = canvas[..., :3] >> 7
    bins = high[..., 0] << 2 | high[..., 1] << 1 | high[..., 2]
    return np.bincount(bins[canvas[..., 3] > 0], minlength=8)


def pack_samples(text: bytes) -> bytes:
    """The text's bytes, then bytes 255 up to a positive multiple of BLOCK."""
    return text + b"\xff" * (-len(text) % BLOCK if text else BLOCK)


def frames_of(samples: bytes) -> list[np.ndarray]:
    """Frames of WIDTH samples a row and WIDTH rows, the last with fewer rows."""
    rows = np.frombuffer(samples, dtype=np.uint8).reshape(-1, WIDTH)
    return [rows[i : i + WIDTH] for i in range(0, len(rows), WIDTH)]


FRAME_NAMES = ["id", "status", "frame", "start_ms", "delay_ms", "width", "height", "histogram"]
FRAME_SCHEMA = "id long, status string, frame int, start_ms long, delay_ms long, width int, height int, histogram array<long>"


def decoded_frames(media: DataFrame, id_column: str = "doc_id", media_column: str = "media") -> DataFrame:
    """A row for each frame of each GIF: (id, status, frame, start_ms, delay_ms, width, height, histogram of eight bins).

    Frames are numbered from 0 and start when the delays before them end; their status is ok. Null, empty and foreign bytes, files without a
    whole frame and those of a canvas beyond MAX_CANVAS give one row without a frame, whose status says why, so no file is lost.
    """
    types = (pa.int64(), pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.list_(pa.int64()))

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, files in (x for batch in batches for x in text_parts(batch, 1)):
            for key, data in zip(part.column(0).to_pylist(), files, strict=True):
                out, start = [], 0
                for k, frame in enumerate(decode_gif(data)):
                    out.append((key, "ok", k, start * 10, frame.delay_cs * 10, frame.canvas.shape[1], frame.canvas.shape[0], colour_histogram(frame.canvas).tolist()))
                    start += frame.delay_cs
                if not out:
                    status = file_status(data)
                    out.append((key, status if status != "ok" else "no whole frame", *[None] * 6))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], FRAME_NAMES)

    return arrow_map(media.selectExpr(f"cast(`{id_column}` as long) id", f"cast(`{media_column}` as binary) media"), decode, FRAME_SCHEMA)


MEDIA_SCHEMA = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, n_frames int, duration_ms long, histogram array<long>, frames array<struct<start_ms: long, delay_ms: long, histogram: array<long>>>"
MEDIA_NAMES = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "n_frames", "duration_ms", "histogram", "frames"]


def media_features(docs: DataFrame) -> DataFrame:
    """Stores every whole text as an animated GIF and reads the stored bytes back; digests and features of each.

    `frames` has each frame's start, delay and colour histogram of the canvas that it shows; `feature` has the number of frames, the duration in ms and
    the histograms' sum. Null and empty texts are one block of padding; a very long text has more frames, of one size. Rows are
    independent: repeated rows and null ids give a row each, an empty table gives none, other columns are not read. There is no shuffle and nothing to tie.
    """

    def convert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        palette = colour_palette()
        for part, texts in (x for batch in batches for x in text_parts(batch, 1)):
            out: list[tuple] = []
            for doc_id, text in zip(part.column(0).to_pylist(), texts, strict=True):
                media = encode_gif(frames_of(pack_samples(text)), palette)
                back, crc, total, tail = hashlib.sha256(), 0, 0, b""
                histogram, duration, frames = np.zeros(8, dtype=np.int64), 0, []
                for frame in decode_gif(media):
                    samples = frame.indices.tobytes()
                    back.update(samples)
                    total += len(samples)
                    tail = (tail + samples)[-32:]
                    shown = colour_histogram(frame.canvas)
                    histogram += shown
                    frames.append({"start_ms": duration, "delay_ms": frame.delay_cs * 10, "histogram": shown.tolist()})
                    duration += frame.delay_cs * 10
                crc = zlib.crc32(tail)
                counts = histogram.tolist()
                feature = f"frames={len(frames)};ms={duration};hist={','.join(map(str, counts))}"
                out.append((doc_id, len(text), total, back.hexdigest(), crc, len(media), hashlib.sha256(media).hexdigest(), feature, len(frames), duration, counts, frames))
            types = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.struct([("start_ms", pa.int64()), ("delay_ms", pa.int64()), ("histogram", pa.list_(pa.int64()))])))
            columns = zip(*out, strict=True) if out else [[]] * len(types)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], MEDIA_NAMES)

    return arrow_map(docs.select(docs["doc_id"].cast("long"), payload().alias("text")), convert, MEDIA_SCHEMA)
