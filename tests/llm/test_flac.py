import hashlib
import random
import zlib

import numpy as np
import pytest

from nearfield.llm import flac as M


def coded(payloads):
    offs = np.concatenate([[0], np.cumsum([len(p) for p in payloads])])
    return M.encode(np.frombuffer(b"".join(payloads), np.uint8), offs)


PAYLOADS = [bytes(64), bytes(range(256)) * 9, random.Random(3).randbytes(5000), b"a" * 1025, b"\xff" * 64 + b"\x00" * 64, bytes(int(127 + 100 * np.sin(2 * k)) for k in range(4000)), b"x", b"xy" * 150_000]


def test_round_trip_and_seeking():
    streams = coded(PAYLOADS)
    assert M.decode(streams) == PAYLOADS
    for p, s in zip(PAYLOADS, streams, strict=True):
        for first, count in ((0, 1), (len(p) - 1, 1), (len(p) // 3, len(p) // 2)):
            assert M.read_samples(s, first, count) == p[first : first + count]


def test_streams_do_not_depend_on_their_neighbours():
    assert coded(PAYLOADS) == [coded([p])[0] for p in PAYLOADS]


def test_linear_prediction_is_used_and_pays():
    wave = PAYLOADS[5]
    stream = coded([wave])[0]
    head = M.Stream(stream)
    kinds = {stream[head.frames + int(o) + 8] >> 1 for o in head.points["offset"]}
    assert 0b100001 in kinds and len(stream) < len(wave) * 0.8


def test_damage_is_found():
    stream = bytearray(coded([PAYLOADS[2]])[0])
    stream[-700] ^= 4
    with pytest.raises(ValueError, match="CRC"):
        M.decode([bytes(stream)])


def test_crcs():
    data = np.frombuffer(b"123456789", np.uint8)
    at = lambda bits: M.crc_many(data, np.array([0]), np.array([9]), bits)[0]
    assert at(8) == 0xF4 and at(16) == 0xFEE8


def test_frames(spark, make_docs, corpus):
    media = M.flac_encode(make_docs(corpus))
    back = {r.doc_id: r for r in M.flac_decode(media).collect()}
    for k, text in enumerate(corpus):
        raw = (text or "").encode()
        assert back[k].pcm == raw + bytes(-len(raw) % 64 if raw else 64) and back[k].n_bytes == len(raw)
        assert back[k].offsets == list(range(0, len(back[k].pcm), M.FRAME))
    assert M.flac_encode(make_docs([])).collect() == []


def test_query(spark, sf_dir):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    out = M.op8_flac(spark, sf_dir).collect()
    assert len(out) == len(docs)
    for r in out:
        raw = (docs[r.doc_id] or "").encode()
        padded = raw + bytes(-len(raw) % 64 if raw else 64)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-64:]))


def test_long_payloads_are_written_and_read_in_runs_of_frames(monkeypatch):
    """What is side by side changes nothing in the stream."""
    big = random.Random(5).randbytes(40_000) + b"text of a kind " * 12_000
    whole = coded([big, b"x"])[0]
    monkeypatch.setattr(M, "RUN", 7)
    assert coded([big]) == [whole] and M.decode([whole, coded([b"x"])[0]]) == [big, b"x"]


def test_memory_of_a_long_text_is_bounded():
    import tracemalloc

    big = b"a long text without end, " * 200_000
    tracemalloc.start()
    (stream,) = coded([big])
    assert M.decode([stream]) == [big]
    assert tracemalloc.get_traced_memory()[1] < 40 * len(big)
    tracemalloc.stop()


def crc(data, bits):
    return int(M.crc_many(np.frombuffer(data, np.uint8), np.array([0]), np.array([len(data)]), bits)[0]).to_bytes(bits // 8, "big")


def other_stream(frames, samples, md5=True):
    """A stream without a seek table of frames given as (block size, subframe as a string of bits)."""
    info = (16).to_bytes(2, "big") + (4096).to_bytes(2, "big") + bytes(6) + (8000 << 44 | 7 << 36 | len(samples)).to_bytes(8, "big")
    out = b"fLaC" + b"\x80\x00\x00\x22" + info + (hashlib.md5(bytes(b ^ 0x80 for b in samples)).digest() if md5 else bytes(16))
    for k, (n, bits) in enumerate(frames):
        head = bytes([0xFF, 0xF8, 0x60, 0x02, k, n - 1])
        bits += "0" * (-len(bits) % 8)
        frame = head + crc(head, 8) + int(bits, 2).to_bytes(len(bits) // 8, "big")
        out += frame + crc(frame, 16)
    return out


def signed(value, width):
    return format(value & (1 << width) - 1, f"0{width}b")


def rice(values, k):
    out = ""
    for v in values:
        u = 2 * v if v >= 0 else -2 * v - 1
        out += "0" * (u >> k) + "1" + (format(u & (1 << k) - 1, f"0{k}b") if k else "")
    return out


def test_streams_of_other_writers():
    ramp = [3 * k - 20 for k in range(16)]
    constant = (20, "0" + "000000" + "0" + signed(-7, 8))
    verbatim = (16, "0" + "000001" + "0" + "".join(signed(v, 8) for v in ramp))
    wasted = (16, "0" + "000001" + "1" + "01" + "".join(signed(v, 6) for v in range(-8, 8)))
    second = [ramp[k] - 2 * ramp[k - 1] + ramp[k - 2] for k in range(2, 16)]
    fixed = (16, "0" + "001010" + "0" + signed(ramp[0], 8) + signed(ramp[1], 8) + "00" + "0001" + "0001" + rice(second[:6], 1) + "1111" + "00011" + "".join(signed(v, 3) for v in second[6:]))
    weights = [2, -1, 0, 0, 0, 1]
    rest = [ramp[k] - (sum(w * ramp[k - 1 - j] for j, w in enumerate(weights)) >> 1) for k in range(6, 16)]
    linear = (16, "0" + "100101" + "0" + "".join(signed(v, 8) for v in ramp[:6]) + "0011" + "00001" + "".join(signed(w, 4) for w in weights) + "01" + "0000" + "00010" + rice(rest, 2))
    samples = bytes(v + 128 for v in [-7] * 20 + ramp + [4 * v for v in range(-8, 8)] + ramp + ramp)
    stream = other_stream([constant, verbatim, wasted, fixed, linear], samples)
    assert M.decode([stream, coded([b"own"])[0]]) == [samples, b"own"] and M.decode([other_stream([verbatim], samples[20:36], False)]) == [samples[20:36]]
    broken = bytearray(stream)
    broken[-1] ^= 1
    with pytest.raises(ValueError, match="CRC-16"):
        M.decode([bytes(broken)])
    with pytest.raises(ValueError, match="MD5"):
        M.decode([other_stream([verbatim], samples[:16])])


def test_own_streams_bit_by_bit():
    for p in PAYLOADS[:6]:
        assert M.decode_plain(coded([p])[0]) == p


def test_blocks(make_docs, corpus):
    media = M.flac_encode(make_docs(corpus))
    rows = M.flac_blocks(media).collect()
    for k, text in enumerate(corpus):
        raw = (text or "").encode()
        own = sorted((r for r in rows if r.doc_id == k), key=lambda r: r.block)
        assert [r.first_sample for r in own] == list(range(0, max(64, -(-len(raw) // 64) * 64), M.FRAME))
        assert b"".join(r.pcm for r in own) == raw + bytes(-len(raw) % 64 if raw else 64)
