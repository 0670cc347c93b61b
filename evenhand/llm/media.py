"""9 Media columns: progressive JPEG in and out of columns.

Decoding accumulates scans into coefficient arrays, one per component: spectral selection says which coefficients a scan
holds, successive approximation which of their bits. Coefficients are dequantised and inverse-transformed as one matrix product,
chroma is upsampled to full resolution, and the picture is an RGB tensor. Scans whose code table has a single code leave the
entropy coder no choice, so all their fields lie at fixed places and are read as arrays; any other scan is read code by code.

Storing a payload: byte v of a block of 64 is the coefficient that has v as the bits of magnitude category 8 (-255 … -128 for v
below 128, 128 … 255 from there), in zigzag order, with all quantisers 1. DC comes as first bits and one refinement, AC as
two bands of first bits and one refinement; the chroma planes are at half resolution and empty. The payload's length stands in a
comment. Reading back takes the coefficients, so no byte is changed.

Defined results: null text is empty text, and the empty payload is stored as one block of zeros; equal texts have equal
stored bytes, tensors and features; blocks that only fill the last row hold zeros and aren't read back; repeated rows get
equal rows; a null medium has null tensors.
"""

from __future__ import annotations

import hashlib
import math
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evenhand.llm.common import scratch_path, slices

BLOCK = 64


def zigzag() -> np.ndarray:
    """Natural place of each coefficient in zigzag order."""
    cells = sorted(((r, c) for r in range(8) for c in range(8)), key=lambda x: (x[0] + x[1], x[0] if (x[0] + x[1]) % 2 else x[1]))
    return np.array([r * 8 + c for r, c in cells])


def inverse_transform() -> np.ndarray:
    """(64, 64): coefficients in zigzag order to samples in rows, as one matrix."""
    k = np.arange(8)
    basis = np.sqrt(np.where(k == 0, 1, 2) / 8)[:, None] * np.cos((2 * k[None, :] + 1) * k[:, None] * math.pi / 16)
    both = np.einsum("ux,vy->uvxy", basis, basis).reshape(64, 64)
    return both[zigzag()].astype(np.float32)


def segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def stuffed(data: bytes) -> bytes:
    return data.replace(b"\xff", b"\xff\x00")


def bits_to_bytes(values: np.ndarray, lengths: np.ndarray) -> bytes:
    """Values of the given bit lengths one behind another, filled up with ones."""
    most = int(lengths.max(initial=1))
    grid = (values[:, None] >> np.arange(most - 1, -1, -1)) & 1
    bits = grid[np.arange(most)[None, :] >= most - lengths[:, None]].astype(np.uint8)
    return np.packbits(np.concatenate([bits, np.ones(-len(bits) % 8, np.uint8)])).tobytes()


def code_table(kind: int, number: int, lengths: list[int], symbols: list[int]) -> bytes:
    return segment(0xC4, bytes([kind << 4 | number, *lengths, *symbols]))


def scan(component: int, dc: int, ac: int, first: int, last: int, high: int, low: int, data: bytes) -> bytes:
    return segment(0xDA, bytes([1, component, dc << 4 | ac, first, last, high << 4 | low])) + stuffed(data)


def store(payload: bytes) -> bytes:
    """A payload of a positive multiple of 64 bytes as a progressive JPEG."""
    n = len(payload) // BLOCK
    wide = math.isqrt(n - 1) + 1
    high = -(-n // wide)
    v = np.frombuffer(payload + bytes(BLOCK * (wide * high - n)), np.uint8).reshape(-1, BLOCK)
    dc = v[:, 0].astype(np.int32)
    dc = np.where(dc < 128, dc - 255, dc)
    step = np.diff(dc >> 1, prepend=0)
    category = np.ceil(np.log2(np.abs(step) + 1)).astype(np.int64)
    extra = np.where(step < 0, step + (1 << category) - 1, step)
    refine = np.zeros(v.shape, np.uint8)  # a block's bits: its end-of-block code 0, then a correction of each coefficient
    refine[:, 1:] = (v[:, 1:] & 1) ^ (v[:, 1:] < 128)
    chroma = bits_to_bytes(np.zeros(-(-wide // 2) * -(-high // 2), np.int64), np.ones(-(-wide // 2) * -(-high // 2), np.int64))
    one = [1] + [0] * 15
    return b"".join(
        [
            b"\xff\xd8", segment(0xFE, struct.pack(">Q", len(payload))), segment(0xDB, bytes([0]) + bytes([1] * 64)),
            segment(0xC2, struct.pack(">BHHB", 8, 8 * high, 8 * wide, 3) + bytes([1, 0x22, 0, 2, 0x11, 0, 3, 0x11, 0])),
            code_table(0, 0, [0, 0, 0, 12] + [0] * 12, list(range(12))), code_table(0, 1, one, [0]), code_table(1, 0, one, [0x07]), code_table(1, 1, one, [0x00]),
            scan(1, 0, 0, 0, 0, 0, 1, bits_to_bytes((category << category) | extra, category + 4)),
            scan(2, 1, 0, 0, 0, 0, 0, chroma), scan(3, 1, 0, 0, 0, 0, 0, chroma),
            scan(1, 0, 0, 1, 5, 0, 1, (v[:, 1:6] >> 1).tobytes()), scan(1, 0, 0, 6, 63, 0, 1, (v[:, 6:] >> 1).tobytes()),
            scan(1, 0, 0, 0, 0, 1, 0, bits_to_bytes(dc & 1, np.ones(len(dc), np.int64))),
            scan(1, 0, 1, 1, 63, 1, 0, np.packbits(refine.ravel()).tobytes()), b"\xff\xd9",
        ]
    )


class Codes(dict):
    """(length, code) to symbol, and for each next byte the length and symbol of the code that it begins with."""

    def __init__(self, lengths: bytes, symbols: bytes):
        super().__init__()
        self.short: list[tuple[int, int] | None] = [None] * 256
        symbol, code = iter(symbols), 0
        for length, count in enumerate(lengths, 1):
            for _ in range(count):
                self[length, code] = s = next(symbol)
                if length <= 8:
                    self.short[code << (8 - length) : (code + 1) << (8 - length)] = [(length, s)] * (1 << (8 - length))
                code += 1
            code <<= 1


class Bits:
    """Fields of a scan, one after another."""

    def __init__(self, data: bytes):
        self.data, self.at, self.held, self.n = data, 0, 0, 0

    def take(self, k: int) -> int:
        while self.n < k:
            self.held = self.held << 8 | (self.data[self.at] if self.at < len(self.data) else 0xFF)
            self.at += 1
            self.n += 8
        self.n -= k
        out = self.held >> self.n
        self.held &= (1 << self.n) - 1
        return out

    def symbol(self, table: Codes) -> int:
        while self.n < 16:
            self.held = self.held << 8 | (self.data[self.at] if self.at < len(self.data) else 0xFF)
            self.at += 1
            self.n += 8
        if (found := table.short[(self.held >> (self.n - 8)) & 0xFF]) is not None:
            self.n -= found[0]
            self.held &= (1 << self.n) - 1
            return found[1]
        for length in range(9, 17):
            if (symbol := table.get((length, self.held >> (self.n - length)))) is not None:
                self.n -= length
                self.held &= (1 << self.n) - 1
                return symbol
        raise ValueError("no such code")

    def signed(self, k: int) -> int:
        v = self.take(k) if k else 0
        return v if not k or v >> (k - 1) else v - (1 << k) + 1


def dc_scan(bits: Bits, tables: dict, units: list, high: int, low: int) -> None:
    """units: (component, block, table) of each block in turn."""
    before: dict[int, int] = {}
    for p, b, dc in units:
        if high:
            p["coef"][b, 0] |= bits.take(1) << low
            continue
        size = bits.symbol(tables[dc])
        before[id(p)] = now = before.get(id(p), 0) + (bits.signed(size) if size else 0)
        p["coef"][b, 0] = now << low


def ac_first(bits: Bits, table: dict, coef: np.ndarray, blocks: np.ndarray, first: int, last: int, low: int, state: list[int]) -> None:
    for b in blocks:
        if state[0]:
            state[0] -= 1
            continue
        k = first
        while k <= last:
            run, size = divmod(bits.symbol(table), 16)
            if size:
                k += run
                coef[b, k] = bits.signed(size) * (1 << low)
                k += 1
            elif run == 15:
                k += 16
            else:
                state[0] = (1 << run) + (bits.take(run) if run else 0) - 1
                break


def ac_refine(bits: Bits, table: dict, coef: np.ndarray, blocks: np.ndarray, first: int, last: int, low: int, state: list[int]) -> None:
    bit = 1 << low

    def correct(b: int, k: int) -> None:
        if bits.take(1) and not abs(coef[b, k]) & bit:
            coef[b, k] += bit if coef[b, k] > 0 else -bit

    for b in blocks:
        k = first
        if not state[0]:
            while k <= last:
                run, size = divmod(bits.symbol(table), 16)
                new = 0
                if size:
                    new = bit if bits.take(1) else -bit
                elif run < 15:
                    state[0] = (1 << run) + (bits.take(run) if run else 0)
                    break
                while k <= last:
                    if coef[b, k]:
                        correct(b, k)
                    elif run:
                        run -= 1
                    else:
                        break
                    k += 1
                if new and k <= last:
                    coef[b, k] = new
                k += 1
        if state[0]:
            for k in range(k, last + 1):
                if coef[b, k]:
                    correct(b, k)
            state[0] -= 1


def fixed_scan(data: bytes, table: dict, coef: np.ndarray, blocks: np.ndarray, first: int, last: int, high: int, low: int) -> bool:
    """Read an AC scan whose fields all lie at fixed places; False if they don't."""
    if len(table) != 1:
        return False
    ((length, code), symbol), width, n = next(iter(table.items())), last - first + 1, len(blocks)
    if length != 1 or code:
        return False
    where = slice(blocks[0], blocks[-1] + 1) if blocks[-1] - blocks[0] + 1 == n else blocks
    if not high and 0 < symbol < 16:  # no runs: every coefficient is a code and its bits
        if symbol == 7:  # a byte each
            v = np.frombuffer(data, np.uint8, n * width).reshape(n, width).astype(np.int16)
        else:
            grid = np.unpackbits(np.frombuffer(data, np.uint8), count=n * width * (symbol + 1)).reshape(n * width, symbol + 1)[:, 1:]
            v = (grid.astype(np.int16) @ (1 << np.arange(symbol - 1, -1, -1, dtype=np.int16))).reshape(n, width)
        half = 1 << (symbol - 1)
        coef[where, first : last + 1] = np.where(v < half, v - (2 * half - 1), v) * np.int16(1 << low)
        return True
    own = coef[where, first : last + 1]
    if high and not symbol and own.all():  # blocks end at once, and every coefficient has its correction
        bit = np.unpackbits(np.frombuffer(data, np.uint8), count=n * (width + 1)).reshape(n, width + 1)[:, 1:].astype(np.int16) << low
        coef[where, first : last + 1] = own + np.where(own < 0, -bit, bit)
        return True
    return False


def coefficients(data: bytes, fixed: bool = True) -> dict:
    """The coefficient arrays (in zigzag order) and frame of a progressive JPEG. ``fixed``: read fixed scans as arrays."""
    tables, quant, frame, at, comment, every = {}, {}, None, 2, b"", 0
    while at < len(data):
        marker, (size,) = data[at + 1], struct.unpack_from(">H", data, at + 2) if data[at + 1] != 0xD9 else (0,)
        if marker == 0xD9:
            break
        body, at = data[at + 4 : at + 2 + size], at + 2 + size
        if marker == 0xFE:
            comment = body
        elif marker == 0xDD:
            (every,) = struct.unpack(">H", body)
        elif marker == 0xDB:
            while body:
                wide = body[0] >> 4
                quant[body[0] & 15] = np.frombuffer(body, ">u2" if wide else np.uint8, 64, 1).astype(np.float32)
                body = body[1 + 64 * (1 + wide) :]
        elif marker == 0xC4:
            while body:
                tables[body[0]] = Codes(body[1:17], body[17:])
                body = body[17 + sum(body[1:17]) :]
        elif marker == 0xC2:
            _, height, width, n = struct.unpack_from(">BHHB", body)
            parts = {body[6 + 3 * i]: {"h": body[7 + 3 * i] >> 4, "v": body[7 + 3 * i] & 15, "q": body[8 + 3 * i]} for i in range(n)}
            hm, vm = max(p["h"] for p in parts.values()), max(p["v"] for p in parts.values())
            mx, my = -(-width // (8 * hm)), -(-height // (8 * vm))
            for p in parts.values():
                p |= {"wide": mx * p["h"], "high": my * p["v"], "own_wide": -(-(-(-width * p["h"] // hm)) // 8), "own_high": -(-(-(-height * p["v"] // vm)) // 8)}
                p["coef"] = np.zeros((p["wide"] * p["high"], 64), np.int16)
            frame = {"height": height, "width": width, "parts": parts, "hm": hm, "vm": vm, "mx": mx, "my": my}
        elif marker == 0xDA:
            n = body[0]
            chosen = [(frame["parts"][body[1 + 2 * i]], body[2 + 2 * i] >> 4, body[2 + 2 * i] & 15) for i in range(n)]
            first, last, high, low = body[1 + 2 * n], body[2 + 2 * n], body[3 + 2 * n] >> 4, body[3 + 2 * n] & 15
            stop = at
            while data[stop] != 0xFF or data[stop + 1] == 0 or 0xD0 <= data[stop + 1] <= 0xD7:
                stop = data.index(b"\xff", stop + 1 if data[stop] != 0xFF else stop + 2)
            chunks, at = split_restarts(data[at:stop]), stop
            read_scan(frame, chosen, tables, chunks, first, last, high, low, every, fixed)
    return frame | {"quant": quant, "comment": comment}


def split_restarts(data: bytes) -> list[bytes]:
    """The parts between restart markers, without stuffing."""
    parts, start, at = [], 0, data.find(b"\xff")
    while at >= 0:
        if 0xD0 <= data[at + 1] <= 0xD7:
            parts.append(data[start:at])
            start = at + 2
        at = data.find(b"\xff", at + 2)
    return [p.replace(b"\xff\x00", b"\xff") for p in [*parts, data[start:]]]


def read_scan(frame: dict, chosen: list, tables: dict, chunks: list[bytes], first: int, last: int, high: int, low: int, every: int, fixed: bool) -> None:
    step = every
    if len(chosen) > 1:  # only DC scans interleave components
        units = [(p, (y * p["v"] + v) * p["wide"] + x * p["h"] + h, dc) for y in range(frame["my"]) for x in range(frame["mx"]) for p, dc, _ in chosen for v in range(p["v"]) for h in range(p["h"])]
        step = every * sum(p["v"] * p["h"] for p, _, _ in chosen)
    else:
        p, dc, ac = chosen[0]
        blocks = (np.arange(p["own_high"])[:, None] * p["wide"] + np.arange(p["own_wide"])[None, :]).ravel()
        if first:
            table = tables[16 | ac]
            if fixed and len(chunks) == 1 and fixed_scan(chunks[0], table, p["coef"], blocks, first, last, high, low):
                return
            for i, chunk in enumerate(chunks):
                own = blocks[i * every : (i + 1) * every] if every else blocks
                (ac_refine if high else ac_first)(Bits(chunk), table, p["coef"], own, first, last, low, [0])
            return
        if high and fixed and not every:
            p["coef"][blocks, 0] |= np.unpackbits(np.frombuffer(chunks[0], np.uint8), count=len(blocks)).astype(np.int16) << low
            return
        if not high and fixed and not every and tables[dc] == {(1, 0): 0}:  # no block differs from the one before
            return
        units = [(p, b, dc) for b in blocks.tolist()]
    for i, chunk in enumerate(chunks):
        dc_scan(Bits(chunk), tables, units[i * step : (i + 1) * step] if every else units, high, low)


def plane(part: dict, quant: dict, matrix: np.ndarray, rows: int = 64) -> np.ndarray:
    """The samples of a component, some block rows at a time."""
    out = np.empty((part["high"] * 8, part["wide"] * 8), np.uint8)
    for y in range(0, part["high"], rows):
        c = part["coef"][y * part["wide"] : (y + rows) * part["wide"]] * quant[part["q"]]
        s = np.clip(np.rint(c.astype(np.float32) @ matrix) + 128, 0, 255).astype(np.uint8)
        out[y * 8 : (y + rows) * 8] = s.reshape(-1, part["wide"], 8, 8).transpose(0, 2, 1, 3).reshape(-1, part["wide"] * 8)
    return out


def tensor(frame: dict, matrix: np.ndarray) -> np.ndarray:
    """(height, width, 3) RGB in full resolution."""
    h, w, full = frame["height"], frame["width"], []
    for p in frame["parts"].values():
        s = plane(p, frame["quant"], matrix)
        full.append(s.repeat(frame["vm"] // p["v"], axis=0).repeat(frame["hm"] // p["h"], axis=1)[:h, :w])
    if len(full) == 1:
        return np.repeat(full[0][:, :, None], 3, axis=2)
    out = np.empty((h, w, 3), np.uint8)
    for at in range(0, h, 512):
        y, cb, cr = (x[at : at + 512].astype(np.float32) for x in full[:3])
        cb -= 128
        cr -= 128
        for i, s in enumerate((y + np.float32(1.402) * cr, y - np.float32(0.344136) * cb - np.float32(0.714136) * cr, y + np.float32(1.772) * cb)):
            out[at : at + 512, :, i] = np.clip(np.rint(s), 0, 255)
    return out


def payload_of(frame: dict) -> bytes:
    """The stored bytes, from the coefficients of the first component."""
    (n,) = struct.unpack(">Q", frame["comment"])
    p = next(iter(frame["parts"].values()))
    c = p["coef"].reshape(p["high"], p["wide"], 64)[: p["own_high"], : p["own_wide"]].reshape(-1, 64)
    return np.where(c < 0, c + 255, c).astype(np.uint8).tobytes()[:n]


def features(rgb: np.ndarray) -> str:
    """Height, width, mean of each channel, and a histogram of green in eight bins."""
    mean = ",".join(f"{rgb[:, :, i].mean(dtype=np.float64):.3f}" for i in range(3))
    bins = np.bincount((rgb[:, :, 1] >> 5).ravel(), minlength=8)
    return f"{rgb.shape[0]}x{rgb.shape[1]};{mean};{','.join(map(str, bins.tolist()))}"


def padded(text: str | None) -> tuple[int, bytes]:
    raw = (text or "").encode("utf-8", "surrogatepass")
    return len(raw), raw + bytes(BLOCK if not raw else -len(raw) % BLOCK)


def store_texts(docs: DataFrame, to: str) -> None:
    """doc_id, n_bytes and media (the stored form of each text) as a table."""
    rows = docs.select("doc_id", "text")

    def run(batches):
        for batch in slices(batches, "text"):
            n, media = zip(*[(n, store(p)) for n, p in map(padded, batch.column("text").to_pylist())], strict=True)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(media, pa.binary())], names=["doc_id", "n_bytes", "media"])

    rows.mapInArrow(run, f"doc_id {rows.dtypes[0][1]}, n_bytes bigint, media binary").write.option("compression", "zstd").parquet(to)


def decode(media: DataFrame, column: str = "media", key: str = "doc_id") -> DataFrame:
    """key, height, width and rgb (height x width x 3 bytes) of progressive JPEGs."""
    rows = media.select(F.col(key).alias("key"), F.col(column).alias("media"))

    def run(batches):
        matrix = inverse_transform()
        for batch in slices(batches, "media"):
            got = [tensor(coefficients(m), matrix) if m is not None else None for m in batch.column("media").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("key"), *[pa.array([g.shape[i] if g is not None else None for g in got], pa.int32()) for i in (0, 1)], pa.array([g.tobytes() if g is not None else None for g in got], pa.binary())], names=["key", "height", "width", "rgb"])

    return rows.mapInArrow(run, f"key {rows.dtypes[0][1]}, height int, width int, rgb binary").withColumnRenamed("key", key)


def read_back(media: DataFrame) -> DataFrame:
    """Payload, digests and features of stored texts, from the stored bytes; the tensors end with their features."""

    def run(batches):
        matrix = inverse_transform()
        for batch in slices(batches, "media"):
            out = []
            for m in batch.column("media").to_pylist():
                frame = coefficients(m)
                p = payload_of(frame)
                out.append((len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-BLOCK:]), len(m), hashlib.sha256(m).hexdigest(), features(tensor(frame, matrix))))
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), *[pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)]], names=["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    return media.mapInArrow(run, f"doc_id {media.dtypes[0][1]}, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string")


def stored_and_read(docs: DataFrame) -> DataFrame:
    to = scratch_path(docs.sparkSession, "media")
    store_texts(docs, to)
    return read_back(docs.sparkSession.read.parquet(to))
