import hashlib
import zlib

import numpy as np
from cases import documents, texts
from hypothesis import given, settings
from hypothesis import strategies as st

from marketloom.llm import gif


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=6000), st.sampled_from([2, 5, 8]))
def test_lzw_round_trip(data, size):
    samples = bytes(b & ((1 << size) - 1) for b in data)
    assert gif.lzw_decode(gif.lzw_encode(samples, size), size, len(samples)) == samples


def test_lzw_fills_and_clears_its_table():
    samples = np.random.default_rng(1).integers(0, 256, 60_000).astype(np.uint8).tobytes()
    assert gif.lzw_decode(gif.lzw_encode(samples), 8, len(samples)) == samples
    assert gif.lzw_decode(gif.lzw_encode(b"a" * 50_000), 8, 50_000) == b"a" * 50_000


def test_known_stream():
    # The 10 x 10 picture that GIF introductions use: rows of 5 and 5 samples with a hole.
    stream = bytes.fromhex("8C2D99872A1CDC33A00275EC95FAA8DE608C0491 4C01".replace(" ", ""))
    samples = gif.lzw_decode(stream, 2, 100)
    assert len(samples) == 100 and samples[:10] == bytes([1] * 5 + [2] * 5)


def test_disposal_and_transparency():
    palette = np.array([[0, 0, 0], [255, 0, 0], [0, 255, 0], [0, 0, 255]], dtype=np.uint8)
    first, second = np.full((2, 2), 1), np.array([[2, 0], [0, 2]])
    for disposal, left in ((1, [255, 0, 0, 255]), (2, [0, 0, 0, 0]), (3, [0, 0, 0, 0])):
        shown = list(gif.decode_gif(gif.encode_gif([first, second], palette, 7, disposal, transparent=0)))
        assert [f.delay_cs for f in shown] == [7, 7]
        assert shown[1].canvas[0, 0].tolist() == [0, 255, 0, 255] and shown[1].canvas[0, 1].tolist() == left
    counts = gif.colour_histogram(shown[0].canvas)
    assert counts.tolist() == [0, 0, 0, 0, 4, 0, 0, 0]


def test_broken_files():
    whole = gif.encode_gif([np.zeros((3, 3)), np.ones((3, 3))], gif.colour_palette())
    assert len(list(gif.decode_gif(whole))) == 2
    for cut in range(len(whole)):
        assert len(list(gif.decode_gif(whole[:cut]))) <= 2
    assert list(gif.decode_gif(b"")) == list(gif.decode_gif(b"PNG" * 10)) == []


def test_query_against_brute_force(spark):
    found = sorted((r.doc_id is None, r.doc_id or 0, r.payload_sha256, r) for r in gif.media_features(documents(spark)).collect())
    assert len(found) == len(texts())
    want = []
    for i, text, *_ in texts():
        data = (text or "").encode()
        payload = data + b"\xff" * ((-len(data) % 576) if data else 576)
        want.append((i is None, i or 0, hashlib.sha256(payload).hexdigest(), len(data), len(payload), zlib.crc32(payload[-32:])))
    for (*key, r), (*other, n, size, crc) in zip(found, sorted(want)):
        assert tuple(key) == tuple(other) and (r.n_bytes, r.payload_bytes, r.tail_crc32) == (n, size, crc)
        assert sum(r.histogram) == (r.payload_bytes if r.n_frames == 1 else r.n_frames * 96 * 96) and r.duration_ms == 40 * r.n_frames
    assert gif.media_features(documents(spark, [])).count() == 0


def test_frames_table(spark):
    media = [(1, bytearray(gif.encode_gif([np.zeros((2, 3)), np.ones((2, 3))], gif.colour_palette()))), (2, None), (3, bytearray(b"no"))]
    rows = gif.decoded_frames(spark.createDataFrame([*media, (4, bytearray(b"GIF89a" + b"\xff" * 4 + bytes(3)))], "doc_id long, media binary")).orderBy("id", "frame").collect()
    assert [(r.id, r.frame, r.start_ms, r.delay_ms, r.width, r.height, sum(r.histogram)) for r in rows[:2]] == [(1, 0, 0, 40, 3, 2, 6), (1, 1, 40, 40, 3, 2, 6)]
    assert [(r.id, r.status, r.frame) for r in rows[2:]] == [(2, "no gif", None), (3, "no gif", None), (4, "canvas too large", None)]


def plain_decode(data: bytes) -> list[tuple[int, bytes]]:
    """(delay, samples) of each image of a GIF with one palette and no interlacing, bit by bit: nothing of the library's decoder."""
    at, out, delay = 13 + 3 * (2 << (data[10] & 7)), [], 0
    while data[at] != 0x3B:
        if data[at] == 0x21:
            if data[at + 1] == 0xF9:
                delay = data[at + 4] | data[at + 5] << 8
            at += 2
            while data[at]:
                at += 1 + data[at]
            at += 1
            continue
        size, at, stream = data[at + 10], at + 11, b""
        while data[at]:
            stream += data[at + 1 : at + 1 + data[at]]
            at += 1 + data[at]
        at += 1
        bits, have, pos, samples = 0, 0, 0, b""
        table, width, last = [], size + 1, None
        while True:
            while have < width:
                bits |= stream[pos] << have
                have, pos = have + 8, pos + 1
            code, bits, have = bits & ((1 << width) - 1), bits >> width, have - width
            if code == 1 << size:
                table, width, last = [bytes([k]) for k in range(1 << size)] + [b"", b""], size + 1, None
                continue
            if code == (1 << size) + 1:
                break
            entry = table[code] if code < len(table) else last + last[:1]
            if last is not None and len(table) < 4096:
                table.append(last + entry[:1])
            if len(table) == 1 << width and width < 12:
                width += 1
            samples, last = samples + entry, entry
        out.append((delay, samples))
    return out


def test_stored_form_by_an_independent_decoder(spark):
    rng = np.random.default_rng(4)
    bodies = ["", "a" * 3000, "The quick brown fox. " * 700, "".join(map(chr, rng.integers(32, 0x3000, 9000)))]
    found = {r.doc_id: r for r in gif.media_features(documents(spark, [(k, t, None, None) for k, t in enumerate(bodies)])).collect()}
    for k, text in enumerate(bodies):
        samples = gif.pack_samples(text.encode())
        media = gif.encode_gif(gif.frames_of(samples), gif.colour_palette())
        images = plain_decode(media)
        assert b"".join(x for _, x in images) == samples and {d for d, _ in images} == {4}
        assert (found[k].media_bytes, found[k].media_sha256) == (len(media), hashlib.sha256(media).hexdigest())
        colours, canvas, want = gif.colour_palette() >> 7, np.full(0, -1), []
        for n, (_, x) in enumerate(images):  # each frame lies over the ones before, at the top left
            shown = np.frombuffer(x, np.uint8)
            canvas = np.concatenate([shown, canvas[len(shown) :]])
            bins = colours[canvas] @ np.array([4, 2, 1])
            want.append((40 * n, 40, np.bincount(bins, minlength=8).tolist()))
        assert [(f.start_ms, f.delay_ms, f.histogram) for f in found[k].frames] == want
        assert found[k].histogram == np.sum([h for _, _, h in want], axis=0).tolist()


def test_long_streams_stop_at_the_limit():
    """A stream without a clear code whose every later code is a long string: only what is wanted is put together."""
    import tracemalloc

    codes, width, bits, held = [4, *[0] * 2], 3, 0, 0
    codes += list(range(6, 4096))[:4091]  # each code is the one just made: strings grow by a sample each
    codes += [4095] * 100_000
    out, size, free = bytearray(), 3, 6
    for k, code in enumerate(codes):
        held |= code << bits
        bits += size
        while bits >= 8:
            out.append(held & 255)
            held >>= 8
            bits -= 8
        if k >= 2 and free < 4096:
            free += 1
            if free == 1 << size and size < 12:
                size += 1
    tracemalloc.start()
    samples = gif.lzw_decode(bytes(out), 2, 10_000)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(samples) <= 10_000 and peak < 60_000_000


def test_frames_beyond_the_bound_are_left_out():
    small = gif.encode_gif([np.zeros((4, 4), np.uint8)], np.zeros((4, 3), np.uint8))
    at = small.index(b"\x2c")
    large = small[: at + 5] + (30_000).to_bytes(2, "little") * 2 + small[at + 9 :]
    assert len(list(gif.decode_gif(small))) == 1 and list(gif.decode_gif(large)) == []
