import hashlib
import zlib

import numpy as np
import pytest
from helpers import ODD, SF, docs_of
from hypothesis import given, settings
from hypothesis import strategies as st

from lattica.llm import media, webp


def picture(rng, height, width, kind):
    if kind == "noise":
        return rng.integers(0, 256, (height, width, 4)).astype(np.uint8)
    if kind == "few":
        k = int(rng.integers(1, 18))
        return rng.integers(0, 256, (k, 4)).astype(np.uint8)[rng.integers(0, k, (height, width))]
    out = np.cumsum(np.cumsum(rng.integers(-2, 3, (height, width, 4)), 0), 1).astype(np.uint8)
    if kind == "flat":
        out[:, width // 3 :] = out[0, 0]
    return out


def blocks(rng, height, width, bits, top):
    return rng.integers(0, top, (-(-height >> bits), -(-width >> bits))).astype(np.uint32)


@settings(max_examples=120, deadline=None)
@given(st.integers(0, 10**9), st.integers(1, 40), st.integers(1, 40), st.sampled_from(["noise", "few", "smooth", "flat"]), st.booleans(), st.booleans(), st.booleans(), st.integers(0, 11))
def test_round_trip_of_every_transform(seed, height, width, kind, green, cross, predict, cache):
    rng = np.random.default_rng(seed)
    rgba, transforms = picture(rng, height, width, kind), []
    if predict:
        bits = int(rng.integers(2, 6))
        transforms.append(("predictor", bits, blocks(rng, height, width, bits, 16) << np.uint32(8)))
    if cross:
        bits = int(rng.integers(2, 6))
        transforms.append(("cross", bits, blocks(rng, height, width, bits, 1 << 24)))
    if green:
        transforms.append(("green",))
    data = webp.encode(rgba, tuple(transforms), cache_bits=cache)
    assert np.array_equal(webp.decode(data), rgba)


@pytest.mark.parametrize("colours", [1, 2, 3, 4, 5, 16, 17, 256])
def test_palettes(colours):
    rng = np.random.default_rng(colours)
    rgba = rng.integers(0, 256, (colours, 4)).astype(np.uint8)[rng.integers(0, colours, (13, 29))]
    rgba[0, 0, :] = rgba[0, 1, :]
    assert np.array_equal(webp.decode(webp.encode(rgba, (("palette",),))), rgba)


def test_copies_from_far_and_overlapping():
    rng = np.random.default_rng(3)
    unit = rng.integers(0, 1 << 32, 150).astype(np.uint32)
    flat = np.concatenate([unit, unit, unit, unit[:3], np.tile(unit[:3], 49)])
    tokens = [("l", unit), ("b", 300, 150), ("l", unit[:3]), ("b", 147, 3)]
    rgba = np.ascontiguousarray(flat.reshape(20, 30)).view(np.uint8).reshape(20, 30, 4)[..., [2, 1, 0, 3]]
    data = webp.encode(rgba, tokens=lambda argb: tokens)
    assert np.array_equal(webp.decode(data), rgba)


def test_short_distance_codes():
    near = webp.near_offsets()
    assert len(near) == 120 and near[:8] == ((0, 1), (1, 0), (1, 1), (-1, 1), (0, 2), (2, 0), (1, 2), (-1, 2)) and near[-2:] == ((8, 6), (8, 7))


def test_groups_chosen_by_an_entropy_image():
    """Written here symbol by symbol: two groups of codes over blocks of 4 by 4."""
    rng = np.random.default_rng(9)
    height, width, bits = 10, 9, 2
    rgba = rng.integers(0, 200, (height, width, 4)).astype(np.uint8)
    of = blocks(rng, height, width, bits, 2)
    of[0, 0] = 1
    whose = webp._tiled(of, bits, height, width)
    argb = np.ascontiguousarray(rgba[..., [2, 1, 0, 3]])
    out = webp.Out()
    for value, n in ((0x2F, 8), (width - 1, 14), (height - 1, 14), (1, 1), (0, 3), (0, 1), (0, 1), (1, 1), (bits - 2, 3)):
        out.put(value, n)
    webp._write_image(out, of.ravel() << np.uint32(8), False)
    groups = []
    for g in range(2):
        own = argb[whose == g]
        groups.append([webp._write_prefix(out, np.bincount(own[:, k], minlength=n)) for k, n in ((1, 280), (2, 256), (0, 256), (3, 256))])
        webp._write_prefix(out, np.zeros(40, np.int64))
    for g, p in zip(whose.ravel().tolist(), argb.reshape(-1, 4).tolist(), strict=True):
        for (c, n), v in zip(groups[g], (p[1], p[2], p[0], p[3]), strict=True):
            out.put(int(c[v]), int(n[v]))
    body = out.packed()
    body += b"\0" * (len(body) & 1)
    data = b"RIFF" + (len(body) + 12).to_bytes(4, "little") + b"WEBPVP8L" + len(body).to_bytes(4, "little") + body
    assert np.array_equal(webp.decode(data), rgba)


def test_code_lengths_are_limited_and_complete():
    fib = [1, 1]
    while len(fib) < 40:
        fib.append(fib[-1] + fib[-2])
    n = webp.code_lengths(np.array(fib))
    assert n.max() <= 15 and sum(2.0**-x for x in n.tolist()) == 1


@pytest.mark.parametrize("size", [0, 1, 575, 576, 577, 100_000, 576 * webp.MAX_SIDE + 5])
def test_payloads(size):
    text = ("lorem ipsum dolor " * (size // 18 + 1))[:size]
    payload = media.payload_of(text)
    assert len(payload) % 576 == 0 and len(payload) - size < 576 + (size == 0) and payload.rstrip(b"\xff") == text.encode()
    kept = media.to_media(payload)
    assert b"".join(p[..., 0].tobytes() for p in media.pictures(kept)) == payload


def test_bad_files():
    good = webp.encode(np.zeros((4, 4, 4), np.uint8))
    for bad in (b"", b"RIFF0000WEBP", good[:22], good[:20] + b"\x00" + good[21:]):
        with pytest.raises(ValueError):
            webp.decode(bad)


def check(docs):
    rows = media.op9(docs).collect()
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert len(rows) == len(texts)
    for r in rows:
        payload = media.payload_of(texts[r.doc_id])
        assert (r.n_bytes, r.payload_bytes) == (len((texts[r.doc_id] or "").encode()), len(payload))
        assert (r.payload_sha256, r.tail_crc32) == (hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))
    return rows


def test_query(spark):
    check(spark.read.parquet(f"{SF}/documents.parquet"))
    rows = check(docs_of(spark, [*ODD, "aaaa", "ab" * 400, "zzzz"]))
    same = {r.media_sha256 for r in rows if r.doc_id in (6, 7)}
    assert len(same) == 1
    assert media.op9(docs_of(spark, ["a"]).limit(0)).count() == 0
    grey = media.pixels(media.store(docs_of(spark, ["ab" * 400]))).orderBy("y").collect()
    assert b"".join(r.grey for r in grey).rstrip(b"\xff") == b"ab" * 400
