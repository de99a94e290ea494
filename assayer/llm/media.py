"""Media columns: Netpbm and BMP decoded to numpy arrays, area-resized, written as NPY tiles with difference hashes."""

from __future__ import annotations

import hashlib
import io
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayer.llm.common import map_arrow, materialize, slices

#: Samples in a row of the payload images: 64 pixels of three samples.
ROW = 192
#: Rows of an image that are widened to 64-bit integers at a time.
BAND = 1 << 12


def _header(data: bytes, count: int) -> tuple[list[int], int]:
    """``count`` decimal numbers after a Netpbm magic, and the place behind the single blank that ends them."""
    at, out = 2, []
    while len(out) < count:
        if at >= len(data):
            raise ValueError("the header ends early")
        c = data[at : at + 1]
        if c == b"#":
            while at < len(data) and data[at : at + 1] not in b"\r\n":
                at += 1
        elif c.isspace():
            at += 1
        elif c.isdigit():
            end = at
            while data[end : end + 1].isdigit():
                end += 1
            out.append(int(data[at:end]))
            at = end
        else:
            raise ValueError("the header holds something other than numbers")
    return out, at + 1


def decode_netpbm(data: bytes) -> np.ndarray:
    """PBM, PGM and PPM, plain or raw (P1 to P6), as (height, width, 1 or 3); 16-bit samples are big-endian.

    PBM pixels become 0 (black, stored as 1) or 255.
    """
    kind = data[1:2]
    if data[:1] != b"P" or kind not in b"123456" or not kind:
        raise ValueError("not a Netpbm image")
    numbers, at = _header(data, 2 if kind in b"14" else 3)
    width, height = numbers[:2]
    most = numbers[2] if len(numbers) > 2 else 1
    if not width or not height or not 0 < most < 65536:
        raise ValueError("an impossible size or largest sample")
    planes = 3 if kind in b"36" else 1
    n = width * height * planes
    if kind == b"4":
        rows = np.frombuffer(data, np.uint8, height * ((width + 7) // 8), at).reshape(height, -1)
        flat = np.unpackbits(rows, axis=1)[:, :width]
    elif kind == b"1":
        flat = np.frombuffer(bytes(c for c in data[at - 1 :] if c in b"01"), np.uint8)[:n] - 48
    elif kind in b"23":
        flat = np.array([int(x) for x in data[at - 1 :].split(maxsplit=n)[:n]], dtype=np.uint16 if most > 255 else np.uint8)
    else:
        flat = np.frombuffer(data, ">u2" if most > 255 else np.uint8, n, at)
    if flat.size != n:
        raise ValueError("the image ends early")
    if most not in (1, 255, 65535) and flat.max() > most:
        raise ValueError("a sample above the largest")
    out = flat.reshape(height, width, planes)
    return (1 - out) * np.uint8(255) if kind in b"14" else out


def encode_ppm(pixels: np.ndarray) -> bytes:
    """8-bit (height, width, 3) as raw PPM."""
    height, width, _ = pixels.shape
    return b"P6\n%d %d\n255\n" % (width, height) + pixels.tobytes()


def decode_bmp(data: bytes) -> np.ndarray:
    """Uncompressed BMP of 1, 4, 8 (palette), 24 or 32 bits, bottom-up or top-down, as (height, width, 3) RGB."""
    if data[:2] != b"BM" or len(data) < 54:
        raise ValueError("not a BMP image")
    at, head, width, height, _, bits, packing = struct.unpack_from("<IIiiHHI", data, 10)
    if packing not in (0, 3) or bits not in (1, 4, 8, 24, 32) or width <= 0 or not height or (packing == 3 and bits != 32):
        raise ValueError("a BMP of a kind that isn't read")
    pitch = (width * bits + 31) // 32 * 4
    rows = np.frombuffer(data, np.uint8, pitch * abs(height), at).reshape(abs(height), pitch)
    if bits >= 24:
        out = rows[:, : width * bits // 8].reshape(abs(height), width, bits // 8)[:, :, 2::-1]
    else:
        used = struct.unpack_from("<I", data, 46)[0] or 1 << bits
        palette = np.frombuffer(data, np.uint8, used * 4, 14 + head).reshape(-1, 4)[:, 2::-1]
        index = rows if bits == 8 else np.unpackbits(rows, axis=1) if bits == 1 else np.stack([rows >> 4, rows & 15], axis=2).reshape(abs(height), -1)
        out = palette[index[:, :width]]
    return np.ascontiguousarray(out[::-1] if height > 0 else out)


def encode_bmp(pixels: np.ndarray) -> bytes:
    """8-bit (height, width, 3) RGB as a bottom-up 24-bit BMP."""
    height, width, _ = pixels.shape
    pitch = (width * 24 + 31) // 32 * 4
    rows = np.zeros((height, pitch), np.uint8)
    rows[:, : width * 3] = pixels[::-1, :, ::-1].reshape(height, -1)
    size = 54 + rows.size
    return struct.pack("<2sIHHI", b"BM", size, 0, 0, 54) + struct.pack("<IiiHHIIiiII", 40, width, height, 1, 24, 0, rows.size, 2835, 2835, 0, 0) + rows.tobytes()


def decode(data: bytes) -> np.ndarray:
    """Pixels of a BMP or Netpbm image; ValueError for whatever is wrong with its bytes."""
    try:
        return decode_bmp(data) if data[:2] == b"BM" else decode_netpbm(data)
    except (IndexError, OverflowError, MemoryError, struct.error) as e:
        raise ValueError(f"damaged: {e}") from e


def _integral_at_edges(x: np.ndarray, out: int) -> np.ndarray:
    """The integral along the first axis at its fractional edges k * n / out, k from 0 to ``out``.

    Only the integral's rows beside an edge and at every BAND rows are made, so it takes little memory beside the image.
    Between rows the integral is linear.
    """
    n = len(x)
    edge = np.arange(out + 1) * n
    low = np.minimum(edge // out, n - 1)
    at = np.unique(np.concatenate((np.arange(0, n, BAND), low, low + 1)))
    starts = at[at < n]
    wide = np.int64 if x.dtype.kind in "iu" else np.float64
    bands = np.searchsorted(starts, np.arange(0, n, BAND))
    sums = [np.add.reduceat(x[starts[i] : starts[i] + BAND], starts[i:j] - starts[i], axis=0, dtype=wide) for i, j in zip(bands, [*bands[1:], len(starts)])]
    sums = np.cumsum(np.concatenate(sums), axis=0)
    table = np.concatenate((np.zeros((1, *sums.shape[1:]), wide), sums))  # the integral at ``starts`` and at the end
    found = lambda rows: table[np.searchsorted(np.append(starts, n), rows)]
    part = ((edge - low * out) / out)[:, None, None]
    return found(low) * (1 - part) + found(low + 1) * part


def area_resize(pixels: np.ndarray, height: int, width: int) -> np.ndarray:
    """Mean over each target pixel's area (fractions of source pixels included), by integral images.

    The first axis is summed exactly in 64-bit integers; images smaller than the target are enlarged alike.
    """
    h, w, _ = pixels.shape
    rows = np.diff(_integral_at_edges(pixels, height), axis=0)
    sums = np.diff(_integral_at_edges(rows.swapaxes(0, 1), width), axis=0).swapaxes(0, 1)
    return sums * (height * width / (h * w))


def difference_hash(pixels: np.ndarray) -> str:
    """Sixteen hex digits: on a 9 x 8 grey area mean, whether each pixel is darker than its right neighbour.

    Grey is the plain mean of the planes; differences under 1e-6 count as none.
    """
    grey = area_resize(pixels, 8, 9).mean(axis=2)
    bits = grey[:, 1:] - grey[:, :-1] > 1e-6
    return np.packbits(bits).tobytes().hex()


def npy_tile(pixels: np.ndarray, side: int = 16) -> bytes:
    """A ``side`` x ``side`` area mean, rounded half up to 8 bits, as an NPY file's bytes."""
    small = area_resize(pixels, side, side)
    out = io.BytesIO()
    np.save(out, np.clip(np.floor(small + 0.5), 0, 255).astype(np.uint8), allow_pickle=False)
    return out.getvalue()


def pad_payload(text: bytes) -> bytes:
    """A text's bytes with blanks appended up to a positive multiple of 192."""
    return text + b" " * (-len(text) % ROW or (ROW if not text else 0))


def media_table(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", kinds: tuple[str, ...] = ("ppm", "bmp")) -> DataFrame:
    """doc_id, n_bytes and media: each whole text (null: empty) as an image of 64 x n RGB pixels.

    The payload's CRC-32 picks one of ``kinds`` (``ppm``, ``bmp``), so equal texts are stored alike. Written
    to the shared folder and read back, so what follows works on stored bytes. Repeated rows and null ids
    are kept; an empty table gives no rows; a long text takes a few times its own size in memory.
    """
    encoders = [{"ppm": encode_ppm, "bmp": encode_bmp}[k] for k in kinds]

    def encode(payload: bytes) -> bytes:
        return encoders[zlib.crc32(payload) % len(encoders)](np.frombuffer(payload, np.uint8).reshape(-1, ROW // 3, 3))

    def run(batches):
        for batch in batches:
            for part in slices(batch, 1, 8 << 20):
                texts = [x.as_buffer().to_pybytes() if x.is_valid else b"" for x in part.column(1).cast(pa.binary())]
                yield {"doc_id": part.column(0), "n_bytes": [len(t) for t in texts], "media": [encode(pad_payload(t)) for t in texts]}

    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return materialize(map_arrow(rows, run, "doc_id long, n_bytes long, media binary"), "media", spread=True)


def media_features(stored: DataFrame, side: int = 16) -> DataFrame:
    """Decode a ``media`` column to samples: payload facts, NPY tile and difference hash. Other columns stay.

    Media that can't be decoded, for whatever damage, have null features and an ``error`` text; null media
    have neither. Columns of the new names are replaced. An empty table gives no rows.
    """
    names = "payload_bytes payload_sha256 tail_crc32 media_bytes media_sha256 feature tile error".split()
    kept = [c for c in stored.columns if c not in names and c != "media"]

    def run(batches):
        for batch in batches:
            for part in slices(batch, len(kept), 8 << 20):
                out = {n: [] for n in names}
                for cell in part.column(len(kept)):
                    data = cell.as_buffer().to_pybytes() if cell.is_valid else None
                    row = dict.fromkeys(names)
                    try:
                        pixels = decode(data) if data is not None else None
                    except ValueError as e:
                        pixels, row["error"] = None, str(e)
                    if data is not None:
                        row |= {"media_bytes": len(data), "media_sha256": hashlib.sha256(data).hexdigest()}
                    if pixels is not None:
                        payload = pixels.tobytes()
                        row |= {"payload_bytes": len(payload), "payload_sha256": hashlib.sha256(payload).hexdigest(), "tail_crc32": zlib.crc32(payload[-16:]), "feature": difference_hash(pixels), "tile": npy_tile(pixels, side)}
                    for n in names:
                        out[n].append(row[n])
                yield {c: part.column(i) for i, c in enumerate(kept)} | out

    kinds = dict(stored.dtypes)
    ddl = ", ".join([f"`{c}` {kinds[c]}" for c in kept] + ["payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, tile binary, error string"])
    return map_arrow(stored.select(*[f"`{c}`" for c in kept], "media"), run, ddl)


def read_tiles(tiled: DataFrame, tile_col: str = "tile") -> DataFrame:
    """``tiled`` with its NPY tiles read: ``tile_shape``, and ``tile_crc32`` of the samples; null tiles have neither."""
    names = ("tile_shape", "tile_crc32")
    kept = [c for c in tiled.columns if c not in names]
    at = kept.index(tile_col)

    def run(batches):
        for batch in batches:
            arrays = [None if t is None else np.load(io.BytesIO(t), allow_pickle=False) for t in batch.column(at).to_pylist()]
            shapes = ["x".join(map(str, a.shape)) if a is not None else None for a in arrays]
            yield {c: batch.column(i) for i, c in enumerate(kept)} | {"tile_shape": shapes, "tile_crc32": [None if a is None else zlib.crc32(a.tobytes()) for a in arrays]}

    kinds = dict(tiled.dtypes)
    ddl = ", ".join([f"`{c}` {kinds[c]}" for c in kept] + ["tile_shape string, tile_crc32 long"])
    return map_arrow(tiled.select(*[f"`{c}`" for c in kept]), run, ddl)


def op6_media(spark, sf_dir: str) -> DataFrame:
    """Every document's bytes as PPM or BMP, stored, read back, decoded and hashed; the NPY tiles too are stored and read back."""
    features = media_features(media_table(spark.read.parquet(f"{sf_dir}/documents.parquet")), side=8)
    stored = materialize(features.drop("error"), "tiles", spread=True)
    return read_tiles(stored).select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "tile_crc32")
