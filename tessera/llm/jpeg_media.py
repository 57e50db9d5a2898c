"""Media columns of baseline JPEG: dimensions, DC-only luminance thumbnails and their hashes.

The reader parses the markers, undoes byte stuffing, Huffman-decodes the scan and multiplies the luminance DC terms by
their quantiser; a pixel of the thumbnail is one block's mean. Segments between restart markers are independent, so
numpy decodes all segments of many files in step with one another, symbol by symbol. Files with equal tables and
layout share such a pass.

The writer stores bytes losslessly in the format's own unit, the quantised coefficient: a byte b becomes the
coefficient of size 8 whose amplitude bits are b (128..255, or -255..-128), 192 of them make one MCU of three blocks,
and a restart interval of one MCU keeps DC prediction from mixing them.

Null texts are stored as empty ones; every payload has one MCU at least. Very long texts are stored whole, one at a time, which takes
about 28 times their size in memory. Broken or unsupported files (progressive,
arithmetic, several scans) give null columns and a reason. Repeated rows give equal results, extra columns are
ignored, an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections import defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tessera.llm.columnar import documents, text_slices

MCU_BYTES = 192
#: Largest number of MCUs along one side: the format counts up to 65,535 samples.
MAX_SIDE = 65_535 // 8
#: Bytes of entropy-coded data that one lockstep pass takes, unless a single file has more.
PASS_BYTES = 2 << 20


class BrokenMedia(ValueError):
    """The bytes are not a baseline JPEG file that this reader supports."""


# --- writing -------------------------------------------------------------------------------------------------------


def grid(mcus: int) -> tuple[int, int]:
    """Columns and rows of MCUs: as square as a divisor allows, else with filler in the last row."""
    for columns in range(int(mcus**0.5), 0, -1):
        if mcus % columns == 0 and mcus // columns <= MAX_SIDE:
            return columns, mcus // columns
    columns = int(mcus**0.5) + 1
    if columns > MAX_SIDE:
        raise ValueError("payload exceeds one image")
    return columns, -(-mcus // columns)


def segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def header(mcus: int) -> bytes:
    columns, rows = grid(mcus)
    frame = struct.pack(">BHHB", 8, 8 * rows, 8 * columns, 3) + b"".join(bytes([c, 0x11, 0]) for c in (1, 2, 3))
    codes = bytes([1, 1, *[0] * 14])  # one code of one bit, one of two bits
    scan = b"\x03" + b"".join(bytes([c, 0]) for c in (1, 2, 3)) + b"\x00\x3f\x00"
    return b"".join(
        [
            b"\xff\xd8",
            segment(0xFE, b"mcus=%d" % mcus),
            segment(0xDB, b"\x00" + b"\x01" * 64),
            segment(0xC0, frame),
            segment(0xC4, b"\x00" + codes + b"\x08\x00" + b"\x10" + codes + b"\x08\x00"),
            segment(0xDD, b"\x00\x01"),
            segment(0xDA, scan),
        ]
    )


def write(payloads: list[bytes]) -> list[bytes]:
    """A file for each payload; payloads are positive multiples of 192 bytes."""
    mcus = np.array([len(p) // MCU_BYTES for p in payloads])
    data = np.frombuffer(b"".join(payloads), np.uint8).reshape(-1, MCU_BYTES)
    bits = np.zeros((len(data), MCU_BYTES, 9), np.uint8)
    bits[:, :, 1:] = np.unpackbits(data, axis=1).reshape(-1, MCU_BYTES, 8)
    coded = np.empty((len(data), MCU_BYTES * 9 // 8 + 2), np.uint8)
    coded[:, :-2] = np.packbits(bits.reshape(len(data), -1), axis=1)
    first = np.repeat(np.cumsum(mcus) - mcus, mcus)
    coded[:, -2] = 0xFF
    coded[:, -1] = 0xD0 + (np.arange(len(data)) - first) % 8
    width = np.ones(coded.shape, np.int64)
    width[:, :-2] += coded[:, :-2] == 0xFF
    flat, width = coded.reshape(-1), width.reshape(-1)
    ends = np.cumsum(width)
    stuffed = np.zeros(ends[-1] if len(ends) else 0, np.uint8)
    stuffed[ends - width] = flat
    bounds = np.concatenate([[0], ends.reshape(len(data), -1)[:, -1] if len(data) else []])[np.concatenate([[0], np.cumsum(mcus)])].astype(np.int64)
    files = []
    for n, a, b in zip(mcus.tolist(), bounds[:-1], bounds[1:], strict=True):
        columns, rows = grid(n)
        fill = b"".join(b"\xaa\xaf\xff" + bytes([0xD0 + k % 8]) for k in range(n, columns * rows))
        files.append(header(n) + (stuffed[a:b].tobytes() + fill)[:-2] + b"\xff\xd9")
    return files


# --- reading -------------------------------------------------------------------------------------------------------


@dataclass
class Frame:
    width: int = 0
    height: int = 0
    components: list[tuple[int, int, int, int]] = field(default_factory=list)  # id, horizontal, vertical, quantiser
    quantisers: dict[int, tuple[int, ...]] = field(default_factory=dict)  # in zigzag order
    codes: dict[tuple[int, int], bytes] = field(default_factory=dict)  # (class, id) to counts and symbols
    interval: int = 0
    comment: bytes = b""
    scan: tuple[tuple[int, int], ...] = ()  # DC and AC table of each component
    at: int = 0  # where the entropy-coded data begins

    @property
    def mcu_grid(self) -> tuple[int, int]:
        h, v = (max(c[k] for c in self.components) for k in (1, 2))
        return -(-self.width // (8 * h)), -(-self.height // (8 * v))

    @property
    def layout(self) -> tuple[tuple[int, bytes, bytes], ...]:
        """Component, DC codes and AC codes of each block of an MCU."""
        return tuple((k, self.codes[0, d], self.codes[1, a]) for k, ((_, h, v, _), (d, a)) in enumerate(zip(self.components, self.scan, strict=True)) for _ in range(h * v))


def parse(data: bytes) -> Frame:
    """The markers of a file up to its scan."""
    frame, at = Frame(), 2
    if data[:2] != b"\xff\xd8":
        raise BrokenMedia("no start of image")
    while True:
        if at + 4 > len(data) or data[at] != 0xFF:
            raise BrokenMedia("a marker is missing")
        marker = data[at + 1]
        if marker == 0xFF:
            at += 1
            continue
        size = struct.unpack_from(">H", data, at + 2)[0]
        body = data[at + 4 : at + 2 + size]
        if size < 2 or len(body) != size - 2:
            raise BrokenMedia("a segment is cut off")
        at += 2 + size
        try:
            if marker == 0xDB:
                while body:
                    wide = body[0] >> 4
                    values = struct.unpack_from(">64H" if wide else "64B", body, 1)
                    frame.quantisers[body[0] & 15] = values
                    body = body[65 + 64 * bool(wide) :]
            elif marker == 0xC0:
                precision, frame.height, frame.width, n = struct.unpack_from(">BHHB", body)
                if precision != 8 or not frame.width or not frame.height:
                    raise BrokenMedia("unsupported frame")
                frame.components = [(body[6 + 3 * k], body[7 + 3 * k] >> 4, body[7 + 3 * k] & 15, body[8 + 3 * k]) for k in range(n)]
            elif marker in range(0xC1, 0xD0) and marker not in (0xC4, 0xC8, 0xCC):
                raise BrokenMedia("not a baseline frame")
            elif marker == 0xC4:
                while body:
                    n = sum(body[1:17])
                    frame.codes[body[0] >> 4, body[0] & 15] = body[1 : 17 + n]
                    body = body[17 + n :]
            elif marker == 0xDD:
                frame.interval = struct.unpack(">H", body)[0]
            elif marker == 0xFE:
                frame.comment = body
            elif marker == 0xDA:
                of = {body[1 + 2 * k]: (body[2 + 2 * k] >> 4, body[2 + 2 * k] & 15) for k in range(body[0])}
                if list(of) != [c[0] for c in frame.components] or not of:
                    raise BrokenMedia("unsupported scan")
                frame.scan, frame.at = tuple(of.values()), at
                if any((0, d) not in frame.codes or (1, a) not in frame.codes for d, a in frame.scan) or any(c[3] not in frame.quantisers or not c[1] * c[2] for c in frame.components):
                    raise BrokenMedia("a table is missing")
                return frame
        except (struct.error, IndexError) as error:
            raise BrokenMedia("a segment is malformed") from error


def lookup(codes: bytes) -> np.ndarray:
    """For every 16 bits ahead: length of the code << 8 | symbol; length 0 where no code fits."""
    table, code, at = np.zeros(1 << 16, np.uint16), 0, 16
    for length in range(1, 17):
        for symbol in codes[at : at + codes[length - 1]]:
            table[code << (16 - length) : (code + 1) << (16 - length)] = length << 8 | symbol
            code += 1
        at += codes[length - 1]
        code <<= 1
    return table


def segments(data: bytes, start: int) -> list[bytes]:
    """Entropy-coded segments between restart markers, stuffing removed."""
    raw = np.frombuffer(data, np.uint8, offset=start)
    marks = np.flatnonzero((raw[:-1] == 0xFF) & (raw[1:] != 0))
    out, begin = [], 0
    for at in marks.tolist():
        if at < begin:
            continue
        kind = data[start + at + 1]
        out.append(data[start + begin : start + at].replace(b"\xff\x00", b"\xff"))
        begin = at + 2
        if kind == 0xD9:
            return out
        if not 0xD0 <= kind <= 0xD7:
            raise BrokenMedia("unexpected marker in the scan")
    raise BrokenMedia("no end of image")


def decode(parts: list[bytes], counts: np.ndarray, layout: tuple[tuple[int, bytes, bytes], ...]) -> np.ndarray:
    """Coefficients (MCU, block, zigzag place) of segments with ``counts`` MCUs each, all decoded in step."""
    sizes = np.fromiter(map(len, parts), np.int64, len(parts))
    joined = np.frombuffer(b"".join(p + bytes(8) for p in parts) + bytes(256), np.uint8)
    ahead = np.zeros(len(joined), np.uint32)  # 32 bits from every byte on
    for k in range(4):
        ahead[: len(joined) - k] |= joined[k:].astype(np.uint32) << np.uint32(24 - 8 * k)
    begin = np.concatenate([[0], np.cumsum(sizes + 8)[:-1]])
    position, limit = begin * 8, (begin + sizes) * 8
    out = np.zeros((int(counts.sum()), len(layout), 64), np.int32)
    row = np.concatenate([[0], np.cumsum(counts)[:-1]]).astype(np.int64)
    tables = {codes: lookup(codes) for block in layout for codes in block[1:]}
    predicted = np.zeros((len(parts), 1 + max(block[0] for block in layout)), np.int64)

    def symbol(table: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Symbols at the bit positions and the 32 bits behind them, which hold the amplitude first."""
        bits = ahead[at >> 3]
        shift = (at & 7).astype(np.uint32)
        found = table[(bits >> (np.uint32(16) - shift)) & np.uint32(0xFFFF)]
        length = found >> 8
        if not length.all():
            raise BrokenMedia("no such code")
        at += length
        return found & 0xFF, ahead[at >> 3] << (at & 7).astype(np.uint32)

    def amplitude(bits: np.ndarray, size: np.ndarray) -> np.ndarray:
        value = ((bits >> np.uint32(1)) >> (np.uint32(31) - size.astype(np.uint32))).astype(np.int64)
        one = np.int64(1) << size.astype(np.int64)
        return np.where(value * 2 < one, value - one + 1, value) * (size > 0)

    for mcu in range(int(counts.max(initial=0))):
        live = np.flatnonzero(counts > mcu)
        for b, (component, dc, ac) in enumerate(layout):
            at = position[live]
            size, bits = symbol(tables[dc], at)
            if (size > 11).any():
                raise BrokenMedia("DC difference out of range")
            predicted[live, component] += amplitude(bits, size)
            at += size
            target = row[live] + mcu
            out[target, b, 0] = predicted[live, component]
            open_, place = np.arange(len(live)), np.ones(len(live), np.int64)
            while len(open_):
                whole = len(open_) == len(live)
                here = at if whole else at[open_]
                run_size, bits = symbol(tables[ac], here)
                run, size = run_size >> 4, run_size & 15
                if size.all() and not run.any():  # neither zeros nor an end of block
                    k = place if whole else place[open_]
                    same = k[0] if (k == k[0]).all() else None
                    if same is not None and whole:
                        out[target, b, same] = amplitude(bits, size)
                    else:
                        out[target[open_], b, k] = amplitude(bits, size)
                    here += size
                    k = k + 1
                else:
                    k = place[open_] + run
                    if ((size > 0) & (k > 63)).any():
                        raise BrokenMedia("coefficient out of range")
                    has = size > 0
                    out[target[open_[has]], b, k[has]] = amplitude(bits, size)[has]
                    here += size
                    k = np.where(has, k + 1, np.where(run == 15, k + 1, 64))
                at[open_] = here
                place[open_] = k
                if k.max() >= 64:
                    open_ = open_[k < 64]
            if (at > limit[live]).any():
                raise BrokenMedia("the scan is cut off")
            position[live] = at
    return out


@dataclass
class Media:
    width: int
    height: int
    coefficients: np.ndarray
    thumbnail: np.ndarray
    comment: bytes

    @property
    def feature(self) -> str:
        small = self.thumbnail
        bits = np.packbits(small.reshape(-1) >= small.mean())
        return f"{self.width}x{self.height}:{hashlib.sha256(bits.tobytes()).hexdigest()[:16]}:{hashlib.sha256(small.tobytes()).hexdigest()[:16]}"


def thumbnail(frame: Frame, coefficients: np.ndarray) -> np.ndarray:
    """One pixel for each luminance block: its dequantised DC term over 8, level-shifted and clipped."""
    columns, rows = frame.mcu_grid
    _, h, v, quantiser = frame.components[0]
    dc = coefficients[:, : h * v, 0].reshape(rows, columns, v, h).transpose(0, 2, 1, 3).reshape(rows * v, columns * h)
    pixels = np.clip(np.rint(dc * frame.quantisers[quantiser][0] / 8 + 128), 0, 255).astype(np.uint8)
    return pixels[: -(-frame.height // 8), : -(-frame.width // 8)]


def read(files: list[bytes | None]) -> list[Media | str]:
    """Each file decoded, or why it could not be."""
    out: list[Media | str] = ["no media"] * len(files)
    alike: dict[tuple, list[tuple[int, Frame, list[bytes], np.ndarray]]] = defaultdict(list)
    for k, data in enumerate(files):
        if data is None:
            continue
        try:
            frame = parse(data)
            columns, rows = frame.mcu_grid
            parts = segments(data, frame.at)
            step = frame.interval or columns * rows
            counts = np.minimum(step, columns * rows - step * np.arange(len(parts)))
            if len(parts) != -(-columns * rows // step):
                raise BrokenMedia("restart markers and dimensions disagree")
            alike[frame.layout].append((k, frame, parts, counts))
        except BrokenMedia as reason:
            out[k] = str(reason)

    def finish(group: list[tuple[int, Frame, list[bytes], np.ndarray]], layout: tuple) -> None:
        try:
            found = decode([p for g in group for p in g[2]], np.concatenate([g[3] for g in group]), layout)
        except BrokenMedia as reason:
            if len(group) == 1:
                out[group[0][0]] = str(reason)
            else:  # find the broken one
                for g in group:
                    finish([g], layout)
            return
        row = 0
        for k, frame, _, counts in group:
            own = found[row : row + int(counts.sum())]
            row += len(own)
            out[k] = Media(frame.width, frame.height, own, thumbnail(frame, own), frame.comment)

    for layout, group in alike.items():
        begin, size = 0, 0
        for i, g in enumerate(group):
            own = sum(map(len, g[2]))
            if i > begin and size + own > PASS_BYTES:
                finish(group[begin:i], layout)
                begin, size = i, 0
            size += own
        finish(group[begin:], layout)
    return out


def stored_bytes(media: Media) -> bytes:
    """The payload that :func:`write` put into the coefficients."""
    if not media.comment.startswith(b"mcus="):
        raise BrokenMedia("no payload in this file")
    values = media.coefficients[: int(media.comment[5:])].reshape(-1)
    return np.where(values < 0, values + 255, values).astype(np.uint8).tobytes()


def media_columns(frame: DataFrame, id_column: str, media_column: str) -> DataFrame:
    """Width, height, thumbnail (luminance bytes, row by row) and feature of every media value; reason where there is none."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 64):
                rows = batch.slice(start, 64)
                found = read(rows.column(1).to_pylist())
                good = [m if isinstance(m, Media) else None for m in found]
                yield pa.RecordBatch.from_arrays(
                    [
                        rows.column(0),
                        pa.array([m and m.width for m in good], pa.int32()),
                        pa.array([m and m.height for m in good], pa.int32()),
                        pa.array([m and m.thumbnail.tobytes() for m in good], pa.binary()),
                        pa.array([m and m.feature for m in good], pa.string()),
                        pa.array([m if isinstance(m, str) else None for m in found], pa.string()),
                    ],
                    ["id", "width", "height", "thumbnail", "feature", "reason"],
                )

    kind = frame.schema[id_column].dataType.simpleString()
    return frame.selectExpr(f"`{id_column}` AS id", f"`{media_column}` AS media").mapInArrow(run, f"id {kind}, width int, height int, thumbnail binary, feature string, reason string")


def payload(text: str) -> bytes:
    data = text.encode()
    return data + b" " * (max(1, -(-len(data) // MCU_BYTES)) * MCU_BYTES - len(data))


def store_texts(docs: DataFrame) -> DataFrame:
    """Every whole text written as media, read back from the stored bytes, and described."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, texts in text_slices(batch):
                files = write([payload(t) for t in texts])
                media = read(files)
                for m in media:
                    if isinstance(m, str):
                        raise BrokenMedia(m)
                back = [stored_bytes(m) for m in media]
                columns = [
                    rows.column(0),
                    pa.array([len(t.encode()) for t in texts], pa.int64()),
                    pa.array(map(len, back), pa.int64()),
                    pa.array([hashlib.sha256(b).hexdigest() for b in back]),
                    pa.array([zlib.crc32(b[-16:]) for b in back], pa.int64()),
                    pa.array(map(len, files), pa.int64()),
                    pa.array([hashlib.sha256(f).hexdigest() for f in files]),
                    pa.array([m.feature for m in media]),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    return docs.select("doc_id", "text").mapInArrow(
        run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    )


def op8_jpeg_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stores, reads back and describes every whole text of ``documents``."""
    return store_texts(documents(spark, sf_dir))
