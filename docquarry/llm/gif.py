"""GIF media columns: a codec (LZW, palettes, disposal, transparency, frame times) and colour-histogram columns.

``frames_of`` reads any GIF87a/89a and composes the screen after each frame. ``encode_payload`` stores bytes losslessly as palette
indices in timed frames that update one screen: samples that the screen shows already are transparent, where a byte value is free
to say so, and a frame that the next one shares little with is disposed of. The payload is read back from the composed screens.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docquarry.session import ship_package

WIDTH, ROWS, DELAY_CS = 64, 256, 4  # of a stored frame: samples a row, most rows, hundredths of a second
MAX_SAMPLES = 1 << 26  # of a screen or a frame: a file that claims more isn't read
GREY = bytes(v for i in range(256) for v in (i, i, i))


@dataclass
class Frame:
    """``indices``: the frame's own samples; ``canvas``: RGBA of the whole screen after it was drawn (None unless asked for)."""

    left: int
    top: int
    indices: np.ndarray
    palette: np.ndarray
    transparent: int | None
    disposal: int
    delay_cs: int
    start_cs: int
    canvas: np.ndarray | None = None


# --- LZW ------------------------------------------------------------------------------------------------------------------------
def _widths(bits: int, n: int) -> np.ndarray:
    """Bits of the first ``n`` codes after a clear: they widen as the table fills, up to 12."""
    size = (1 << bits) + 1 + np.arange(n)  # of the reader's table before each code, less one
    return np.where(np.arange(n) == 0, bits + 1, np.minimum(np.floor(np.log2(size)).astype(np.int64) + 1, 12))


_WIDTHS = {bits: _widths(bits, 8192) for bits in range(1, 9)}
_OFFSETS = {bits: np.concatenate([[0], np.cumsum(w)]) for bits, w in _WIDTHS.items()}


def _packed(codes: np.ndarray, widths: np.ndarray) -> bytes:
    """Codes of the given widths, least significant bit first."""
    at = np.cumsum(widths) - widths
    v = codes.astype(np.int64) << (at & 7)
    n = int(at[-1] + widths[-1] + 7) // 8
    out = np.zeros(n + 3)
    for k in range(3):  # no two codes share a bit, so sums are unions
        out += np.bincount((at >> 3) + k, weights=(v >> (8 * k)) & 255, minlength=n + 3)[: n + 3]
    return out[:n].astype(np.uint8).tobytes()


def lzw_encode(samples: bytes, bits: int = 8) -> bytes:
    """A GIF LZW stream: clear, dictionary codes, a clear whenever the table is full, end."""
    clear = 1 << bits
    codes, widths = [clear], [np.array([bits + 1])]
    table: dict[int, int] = {}
    part: list[int] = []
    put, get = part.append, table.get
    rest = iter(samples)
    prev, nxt = next(rest, -1), clear + 2
    for c in rest:
        key = prev << 8 | c
        got = get(key)
        if got is not None:
            prev = got
            continue
        put(prev)
        prev = c
        if nxt < 4096:
            table[key] = nxt
            nxt += 1
        else:
            put(clear)
            codes += part
            widths.append(_WIDTHS[bits][: len(part)])
            part.clear()
            table.clear()
            nxt = clear + 2
    if prev >= 0:
        put(prev)
    put(clear + 1)
    codes += part
    widths.append(_WIDTHS[bits][: len(part)])
    return _packed(np.array(codes), np.concatenate(widths))


def _codes_at(raw: np.ndarray, start: int, bits: int) -> np.ndarray:
    """The codes from bit ``start`` on, as they are wide after a clear; at most as many as ``_WIDTHS`` covers. ``raw`` has 3 bytes of padding."""
    left = (len(raw) - 3) * 8 - start
    n = int(np.searchsorted(_OFFSETS[bits], left, "right")) - 1
    at = start + _OFFSETS[bits][:n]
    k = at >> 3
    v = raw[k].astype(np.int64) | raw[k + 1].astype(np.int64) << 8 | raw[k + 2].astype(np.int64) << 16
    return v >> (at & 7) & ((1 << _WIDTHS[bits][:n]) - 1)


def lzw_decode(data: bytes, bits: int, most: int) -> np.ndarray:
    """Samples of a GIF LZW stream, at most ``most``; a broken stream, or a code size that isn't 1 to 8, ends where it breaks."""
    out: list[bytes] = []
    if bits in _WIDTHS:
        _lzw_strings(np.concatenate([np.frombuffer(data, np.uint8), np.zeros(3, np.uint8)]), bits, most, out)
    return np.frombuffer(b"".join(out), np.uint8)[:most]


def _lzw_strings(raw: np.ndarray, bits: int, most: int, out: list[bytes]) -> None:
    clear, end = 1 << bits, (1 << bits) + 1
    base = [bytes([i]) for i in range(clear)] + [b"", b""]
    at, size = 0, 0
    while True:  # a stretch from a clear code, or the start, to the next clear code or the end
        codes = _codes_at(raw, at, bits)
        stop = np.flatnonzero((codes == clear) | (codes == end))
        n = int(stop[0]) if len(stop) else len(codes)
        known = codes[:n].tolist()
        if known:
            if known[0] >= clear:
                return
            table = list(base)
            prev = table[known[0]]
            out.append(prev)
            room = 4096 - len(table)
            add, put = table.append, out.append
            for c in known[1 : 1 + room]:
                try:
                    entry = table[c]
                except IndexError:
                    if c != len(table):
                        return
                    entry = prev + prev[:1]
                add(prev + entry[:1])
                put(entry)
                prev = entry
            out.extend([table[c] for c in known[1 + room :]])  # the table is full
            size += sum(map(len, out[len(out) - len(known) :]))
            if size >= most:
                return
        if not len(stop) or codes[n] == end:
            return
        at += int(_OFFSETS[bits][n + 1])


# --- container ------------------------------------------------------------------------------------------------------------------
def _blocks(data: bytes) -> bytes:
    """Sub-blocks of at most 255 bytes and their end."""
    full = len(data) // 255
    grid = np.full((full, 256), 255, np.uint8)
    grid[:, 1:] = np.frombuffer(data, np.uint8)[: full * 255].reshape(full, 255)
    rest = data[full * 255 :]
    return grid.tobytes() + (bytes([len(rest)]) + rest if rest else b"") + b"\0"


def _unblock(data: bytes, at: int) -> tuple[bytes, int]:
    """Joins sub-blocks from ``at``; runs of full ones are taken at once."""
    parts = []
    while at < len(data) and data[at]:
        n = data[at]
        if n == 255 and at + 256 * 8 < len(data):
            view = np.frombuffer(data, np.uint8, count=(len(data) - at) // 256 * 256, offset=at).reshape(-1, 256)
            short = np.flatnonzero(view[:, 0] != 255)
            rows = int(short[0]) if len(short) else len(view)
            parts.append(view[:rows, 1:].tobytes())
            at += 256 * rows
            continue
        parts.append(data[at + 1 : at + 1 + n])
        at += n + 1
    return b"".join(parts), at + 1


def encode_payload(payload: bytes) -> bytes:
    """A GIF89a whose composed screens hold ``payload``, a multiple of WIDTH bytes, ROWS rows a frame, in order."""
    samples = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    free = np.flatnonzero(np.bincount(samples.reshape(-1), minlength=256) == 0)
    clear = int(free[-1]) if len(free) else None
    out = [b"GIF89a", struct.pack("<HHBBB", WIDTH, min(len(samples), ROWS), 0xF7, 0, 0), GREY]
    parts = [samples[top : top + ROWS] for top in range(0, len(samples), ROWS)]
    shown = None
    for i, part in enumerate(parts):
        same = shown[: len(part)] == part if shown is not None and clear is not None else None
        drawn = part if same is None else np.where(same, np.uint8(clear), part)
        after = parts[i + 1] if i + 1 < len(parts) else None
        keep = after is None or 32 * np.count_nonzero(part[: len(after)] == after) >= after.size
        flags = (1 if keep else 2) << 2 | (clear is not None)
        out += [b"\x21\xf9\x04" + struct.pack("<BHBB", flags, DELAY_CS, clear or 0, 0), b"\x2c" + struct.pack("<HHHHB", 0, 0, WIDTH, len(part), 0), b"\x08", _blocks(lzw_encode(drawn.tobytes()))]
        # a kept frame shows through below a shorter one; a disposed one leaves nothing
        shown = (part if shown is None or len(part) >= len(shown) else np.concatenate([part, shown[len(part) :]])) if keep else None
    return b"".join([*out, b"\x3b"])


def _palette(data: bytes, at: int, flags: int) -> np.ndarray | None:
    """A colour table of 2 << (flags & 7) entries, or None where the file ends before it does."""
    n = 2 << (flags & 7)
    return np.frombuffer(data, np.uint8, n * 3, at).reshape(n, 3) if at + n * 3 <= len(data) else None


def frames_of(data: bytes, canvas: bool = True) -> Iterator[Frame]:
    """The frames in order, one at a time; with ``canvas``, each carries the screen after it, by disposal and transparency rules.

    Raises ValueError where ``data`` isn't a GIF or claims over MAX_SAMPLES; stops at a truncated end, after the frames before it. A
    frame whose stream is broken or short is filled up with index 0."""
    if data[:6] not in (b"GIF87a", b"GIF89a") or len(data) < 13:
        raise ValueError("not a GIF")
    w, h, flags, _, _ = struct.unpack_from("<HHBBB", data, 6)
    if canvas and w * h > MAX_SAMPLES:
        raise ValueError("the screen is too large")
    at, glob = 13, np.zeros((256, 3), np.uint8)
    if flags & 0x80:
        glob = _palette(data, at, flags)
        if glob is None:
            return
        at += glob.size
    screen = np.zeros((h, w, 4), np.uint8) if canvas else None
    disposal, delay, clear_index, start = 0, 0, None, 0
    while at < len(data):
        kind = data[at]
        if kind == 0x21 and at + 2 < len(data):
            label = data[at + 1]
            body, at = _unblock(data, at + 2)
            if label == 0xF9 and len(body) >= 4:
                f, delay, t = struct.unpack_from("<BHB", body)
                disposal, clear_index = (f >> 2) & 7, t if f & 1 else None
        elif kind == 0x2C and at + 10 < len(data):
            x, y, fw, fh, f = struct.unpack_from("<HHHHB", data, at + 1)
            at += 10
            palette = glob
            if f & 0x80:
                palette = _palette(data, at, f)
                if palette is None:
                    return
                at += palette.size
            if at >= len(data):
                return
            if fw * fh > MAX_SAMPLES:
                raise ValueError("a frame is too large")
            bits = data[at]
            body, at = _unblock(data, at + 1)
            px = lzw_decode(body, bits, fw * fh)
            if len(px) < fw * fh:
                px = np.pad(px, (0, fw * fh - len(px)))
            px = px.reshape(fh, fw)
            if f & 0x40:  # interlaced: rows come in four passes
                order = [r for a, b in ((0, 8), (4, 8), (2, 4), (1, 2)) for r in range(a, fh, b)]
                px, was = np.empty_like(px), px
                px[order] = was
            frame = Frame(x, y, px, palette, clear_index, disposal, delay, start)
            if canvas:
                before = screen.copy() if disposal == 3 else None
                cut = px[: max(0, h - y), : max(0, w - x)]
                there = screen[y : y + cut.shape[0], x : x + cut.shape[1]]
                colours = np.full((256, 4), 255, np.uint8)
                colours[: len(palette), :3] = palette
                colours[len(palette) :, :3] = palette[-1]
                rgba = colours[cut]
                there[:] = rgba if clear_index is None else np.where((cut != clear_index)[..., None], rgba, there)
                frame.canvas = screen.copy()
                if disposal == 2:
                    there[:] = 0
                elif disposal == 3:
                    screen = before
            yield frame
            start += delay
            disposal, delay, clear_index = 0, 0, None
        else:
            return


def decode_gif(data: bytes, canvas: bool = False) -> tuple[int, int, list[Frame]]:
    """(width, height, frames): see ``frames_of``."""
    frames = list(frames_of(data, canvas))
    w, h = struct.unpack_from("<HH", data, 6)
    return w, h, frames


def payload_part(frame: Frame) -> bytes:
    """What a stored frame holds of the payload: the first channel of the grey screen, where the frame is."""
    h, w = frame.indices.shape
    return frame.canvas[frame.top : frame.top + h, frame.left : frame.left + w, 0].tobytes()


def payload_of(data: bytes) -> bytes:
    """What ``encode_payload`` stored, read back from the file's bytes."""
    return b"".join(map(payload_part, frames_of(data)))


def frame_row(i: int, f: Frame, bins: int = 8) -> dict:
    """A frame's number, time, size and the colour histogram of the composed screen (``bins`` levels of each of R, G, B, visible samples only)."""
    seen = f.canvas[f.canvas[..., 3] > 0]
    hist = [np.bincount(seen[:, c].astype(np.int64) * bins // 256, minlength=bins).tolist() for c in range(3)]
    return {"frame": i, "start_cs": f.start_cs, "delay_cs": f.delay_cs, "width": f.indices.shape[1], "height": f.indices.shape[0], "hist_r": hist[0], "hist_g": hist[1], "hist_b": hist[2]}


def frame_columns(data: bytes, bins: int = 8) -> list[dict]:
    """One row a frame: see ``frame_row``."""
    return [frame_row(i, f, bins) for i, f in enumerate(frames_of(data))]


FRAMES = "array<struct<frame:int,start_cs:int,delay_cs:int,width:int,height:int,hist_r:array<long>,hist_g:array<long>,hist_b:array<long>>>"


def padded(raw: bytes, unit: int = WIDTH) -> bytes:
    return raw + b"\0" * ((-len(raw)) % unit or (0 if raw else unit))


def media_columns(docs: DataFrame, key: str = "doc_id", text: str = "text", media: bool = True) -> DataFrame:
    """Stores each text's bytes as a GIF and reads it back: (key, n_bytes, media [if asked], payload and media digests, frames).

    Null text: empty. Payload: UTF-8 bytes and zeros up to a positive multiple of 64. Equal texts give equal values. Repeated rows
    stay. Empty table: no rows. One row is in memory at a time beside its batch. Other columns are not read."""
    from pyspark.sql.pandas.types import to_arrow_type
    from pyspark.sql.types import _parse_datatype_string

    ship_package(docs.sparkSession)
    kind = docs.schema[key].dataType
    extra = ", media binary" if media else ""
    schema = _parse_datatype_string(f"k {kind.simpleString()}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, frames {FRAMES}{extra}")
    types = pa.schema([(f.name, to_arrow_type(f.dataType)) for f in schema.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys, rows, held = b.column(0), [], 0
            first = 0
            for i, t in enumerate(b.column(1)):
                raw = t.as_buffer().to_pybytes() if t.is_valid else b""
                stored = encode_payload(padded(raw))
                parts, frames = [], []
                for k, f in enumerate(frames_of(stored)):
                    parts.append(payload_part(f))
                    frames.append(frame_row(k, f))
                back = b"".join(parts)
                row = {"n_bytes": len(raw), "payload_bytes": len(back), "payload_sha256": hashlib.sha256(back).hexdigest(), "tail_crc32": zlib.crc32(back[-WIDTH:]), "media_bytes": len(stored), "media_sha256": hashlib.sha256(stored).hexdigest(), "frames": frames}
                rows.append(row | ({"media": stored} if media else {}))
                held += len(stored) if media else 0
                if held > 16_000_000:
                    yield _batch(keys.slice(first, i + 1 - first), rows, types)
                    rows, held, first = [], 0, i + 1
            if rows:
                yield _batch(keys.slice(first), rows, types)

    got = docs.select(F.col(key).alias("k"), F.col(text).cast("binary").alias("t")).mapInArrow(run, schema)
    return got.withColumnRenamed("k", key)


def _batch(keys: pa.Array, rows: list[dict], types: pa.Schema) -> pa.RecordBatch:
    cols = [keys.cast(types.field("k").type)] + [pa.array([r[n] for r in rows], types.field(n).type) for n in types.names[1:]]
    return pa.RecordBatch.from_arrays(cols, schema=types)
