"""Media columns: bytes kept as lossless WebP pictures in a binary column, and read back to pixels.

A text's bytes become grey pixels, 576 to a row, padded with 255; pictures of at most 16,384 rows follow
each other in one value, so any length fits. Bytes of 16 values or fewer go through a packed palette.

Defined cases: null or empty text is one row of padding; repeated rows and equal texts give equal
values; null ids pass through; an empty table stays empty.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lattica.llm import webp
from lattica.llm.common import map_rows, written

ROW = 576


def payload_of(text: str | None) -> bytes:
    raw = (text or "").encode("utf-8", "surrogatepass")
    return raw + b"\xff" * ((-len(raw)) % ROW or (0 if raw else ROW))


def to_media(payload: bytes) -> bytes:
    rows, out = np.frombuffer(payload, np.uint8).reshape(-1, ROW), []
    for i in range(0, len(rows), webp.MAX_SIDE):
        grey = rows[i : i + webp.MAX_SIDE]
        rgba = np.empty((*grey.shape, 4), np.uint8)
        rgba[..., :3] = grey[..., None]
        rgba[..., 3] = 255
        few = np.count_nonzero(np.bincount(grey.ravel(), minlength=256)) <= 16
        out.append(webp.encode(rgba, (("palette",),) if few else (("green",),)))
    return b"".join(out)


def pictures(media: bytes) -> list[np.ndarray]:
    """The pixel arrays of a value, one for each picture."""
    out, at = [], 0
    while at < len(media):
        n = 8 + struct.unpack_from("<I", media, at + 4)[0]
        out.append(webp.decode(media[at : at + n]))
        at += n
    return out


def feature(pixels: list[np.ndarray]) -> str:
    """Rows, mean, deviation and a 16-bin histogram of the grey values."""
    counts = sum(np.bincount(p[..., 0].ravel(), minlength=256) for p in pixels)
    n, value = counts.sum(), np.arange(256)
    mean = (counts * value).sum() / n
    dev = (counts * (value - mean) ** 2).sum() / n
    return f"{n // ROW}x{ROW} {mean:.6f} {dev**0.5:.6f} " + " ".join(map(str, counts.reshape(16, 16).sum(1).tolist()))


def _stored(texts: list) -> dict[str, list]:
    payloads = [payload_of(t) for t in texts]
    return {"media": [to_media(p) for p in payloads], "n_bytes": [len((t or "").encode("utf-8", "surrogatepass")) for t in texts]}


def store(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_bytes, media), written to the shared folder and read back."""
    schema = T.StructType([docs.schema[id_col], T.StructField("n_bytes", T.LongType()), T.StructField("media", T.BinaryType())])
    return written(map_rows(docs.select(id_col, text_col), schema, [text_col], _stored), "media")


def _read(media: list) -> dict[str, list]:
    out: dict[str, list] = {k: [] for k in ("payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")}
    for m in media:
        pixels = pictures(m)
        payload = b"".join(np.ascontiguousarray(p[..., 0]).tobytes() for p in pixels)
        for k, v in zip(out, (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(m), hashlib.sha256(m).hexdigest(), feature(pixels)), strict=True):
            out[k].append(v)
    return out


def op9(docs: DataFrame) -> DataFrame:
    kept = store(docs)
    long, text = T.LongType(), T.StringType()
    kinds = {"payload_bytes": long, "payload_sha256": text, "tail_crc32": long, "media_bytes": long, "media_sha256": text, "feature": text}
    schema = T.StructType([*(f for f in kept.schema.fields if f.name != "media"), *(T.StructField(k, v) for k, v in kinds.items())])
    return map_rows(kept, schema, ["media"], _read)


def pixels(kept: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Pixel arrays as columns: one row a picture row (id, picture, y, grey values)."""
    schema = T.StructType([kept.schema[id_col], T.StructField("rows", T.ArrayType(T.BinaryType()))])
    flat = map_rows(kept, schema, ["media"], lambda media: {"rows": [[r.tobytes() for p in pictures(m) for r in np.ascontiguousarray(p[..., 0])] for m in media]})
    return flat.select(id_col, F.posexplode("rows").alias("y", "grey"))
