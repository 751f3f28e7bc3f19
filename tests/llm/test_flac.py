"""FLAC against published streams, round trips, damage and plain loops."""

import hashlib
import zlib

import numpy as np
import pytest

from gatelight.llm import flac
from tests.llm.helpers import hard_documents, no_documents, one_to_one

# Streams printed in RFC 9639, appendix D: stereo verbatim, and 8-bit mono with a linear predictor.
STEREO = bytes.fromhex("664c6143800000221000100000000f00000f0ac442f0000000013e84b41807dc690307586a3dad1a2e0ffff869180000bf0358fd03128baa9a")
LINEAR = bytes.fromhex(
    "664c614380000022100010000000" "1f00001f07d000700000" "0018f8f9e396f5cbcfc6dc807f9977906b32"
    "fff868020017e944004f6f313d1047d227cb6d090831452bdc2822228057a3"
)


def _payloads():
    rng = np.random.default_rng(3)
    wave = (np.sin(np.arange(6400) / 17) * 90 + 128).astype(np.uint8).tobytes()
    return [bytes(64), b"A" * 6400, bytes(range(256)) * 25, rng.integers(0, 256, 64 * 70, dtype=np.uint8).tobytes(), wave, b"plain text, " * 16, wave[:64], (b"\0" * 63 + b"\xff") * 40]


def test_published_streams():
    stereo, linear = flac.decode_streams([STEREO, LINEAR])
    assert stereo.samples.tolist() == [[25588, 10416]] and stereo.sample_bytes == 2
    assert linear.samples.ravel().tolist() == [0, 79, 111, 78, 8, -61, -90, -68, -13, 42, 67, 53, 13, -27, -46, -38, -12, 14, 24, 19, 6, -4, -5, 0]


def test_round_trips_and_seeks():
    payloads = _payloads()
    streams = flac.encode_streams(payloads)
    for payload, stream, done in zip(payloads, streams, flac.decode_streams(streams)):
        assert done.pcm == payload
        assert len(stream) < len(payload) * 1.05 + 64
        for block, start in zip(done.block_starts.tolist(), done.frame_starts.tolist()):
            assert stream[start : start + 2] == b"\xff\xf8"
            assert done.seek(block, 64) == payload[block : block + 64]
        assert done.block_starts.tolist() == list(range(0, len(payload), flac.BLOCK))
    assert len(streams[1]) < 300 and len(streams[4]) < len(payloads[4]) / 2


def test_seek_points_stand_at_frames():
    stream = flac.encode_streams([b"seekable " * 64 * 400], seek_every=4)[0]
    assert stream[42] & 0x7F == 3
    size = int.from_bytes(stream[43:46], "big")
    (done,) = flac.decode_streams([stream])
    starts = dict(zip(done.block_starts.tolist(), done.frame_starts.tolist()))
    for at in range(46, 46 + size, 18):
        sample, offset = int.from_bytes(stream[at : at + 8], "big"), int.from_bytes(stream[at + 8 : at + 16], "big")
        assert starts[sample] == 46 + size + offset


@pytest.mark.parametrize("where", [-1, -40, 60, 30])
def test_damage_is_an_error(where):
    stream = bytearray(flac.encode_streams([b"some text to damage " * 320])[0])
    stream[where] ^= 4
    with pytest.raises(ValueError):
        flac.decode_streams([bytes(stream)])


def _packed(fields):
    bits = "".join(format(v & (1 << w) - 1, f"0{w}b") for v, w in fields)
    bits += "0" * (-len(bits) % 8)
    return int(bits, 2).to_bytes(len(bits) // 8, "big")


def test_partitions_escapes_wasted_bits_and_side_channels():
    """A frame put together by hand: left and side, two partitions, an escaped one, a wasted bit."""
    left = [10, 12, 9, 14, 20, 18, 17, 25]
    right = [8, 10, 9, 12, 20, 16, 15, 21]
    side = [a - b for a, b in zip(left, right)]
    head = b"\xff\xf8\x60\x82\x00\x07"
    head += bytes([flac.crc8(head)])
    residual = [b - a for a, b in zip(left, left[1:])]
    fields = [(0, 1), (9, 6), (0, 1), (left[0], 8), (0, 2), (1, 4), (1, 4)]
    for r in residual[:3]:
        u = 2 * r if r >= 0 else -2 * r - 1
        fields += [(0, u >> 1), (1, 1), (u & 1, 1)]
    fields += [(15, 4), (5, 5)] + [(r, 5) for r in residual[3:]]
    fields += [(0, 1), (1, 6), (1, 1), (1, 1)] + [(s >> 1, 8) for s in side]
    body = head + _packed([f for f in fields if f[1]])
    data = np.frombuffer(body, np.uint8)
    body += int(flac.crc16_of(data, np.array([0]), np.array([len(body)]))[0]).to_bytes(2, "big")
    raw = np.array(list(zip(left, right)), np.int8).tobytes()
    info = (8).to_bytes(2, "big") * 2 + b"\0" * 6 + (8000 << 44 | 1 << 41 | 7 << 36 | 8).to_bytes(8, "big") + hashlib.md5(raw).digest()
    (done,) = flac.decode_streams([b"fLaC\x80\0\0\x22" + info + body])
    assert all(s % 2 == 0 for s in side) and done.samples.tolist() == [list(p) for p in zip(left, right)]


def test_query_over_hard_rows(spark):
    docs = hard_documents(spark)
    got = one_to_one(flac.stored_media(docs), docs.count())
    wanted = []
    for row in docs.collect():
        payload = flac.payload(row.text or "")
        assert len(payload) % 64 == 0 and payload
        wanted.append((row.doc_id, len((row.text or "").encode()), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:])))
    assert sorted((tuple(r)[:5] for r in got), key=repr) == sorted(wanted, key=repr)
    assert len({(r.payload_sha256, r.media_sha256, r.feature) for r in got}) == len({r.payload_sha256 for r in got})
    assert flac.stored_media(no_documents(spark)).count() == 0


def test_samples_that_look_like_a_header():
    """A verbatim frame whose samples hold the header of the next frame, and one whose samples start like a header with an impossible number."""
    noise = np.random.default_rng(8).integers(0, 256, 1024, dtype=np.uint8)
    fake = np.frombuffer(flac._head(1, 1024), np.uint8) ^ 0x80
    noise[500 : 500 + len(fake)] = fake
    noise[700:706] = np.array([0xFF, 0xF8, 0x70, 0x02, 0xFF, 0xFF], np.uint8) ^ 0x80
    payload = noise.tobytes() + np.random.default_rng(9).integers(0, 256, 1024, dtype=np.uint8).tobytes()
    (stream,) = flac.encode_streams([payload])
    assert stream.count(flac._head(1, 1024)) == 2
    assert flac.decode_streams([stream, stream])[1].pcm == payload


def _noise_holding(seed, length, at, looks):
    """Noise, stored as it is, whose samples hold ``looks`` at ``at``."""
    noise = np.random.default_rng(seed).integers(0, 256, length, dtype=np.uint8)
    noise[at : at + len(looks)] = np.frombuffer(looks, np.uint8) ^ 0x80
    return noise.tobytes()


def _headed(start):
    return start + bytes([flac.crc8(start)])


@pytest.mark.parametrize("at, looks", [
    (500, _headed(b"\xff\xf8\x10\x02\x01")),  # the next number, 192 samples
    (1500, _headed(b"\xff\xf9\x70\x02" + flac._coded_number(2048) + b"\x00\x07")),  # by its sample, in the last frame
    (1500, _headed(b"\xff\xf8\x70\x02\x02\x03\xff")),  # one frame more than there are
])
def test_samples_that_look_like_a_header_of_another_length(at, looks):
    payload = _noise_holding(8, 2048, at, looks)
    stream, plain = flac.encode_streams([payload, b"plain text, " * 400])
    assert looks in stream
    assert [d.pcm for d in flac.decode_streams([plain, stream, plain, stream])] == [b"plain text, " * 400, payload] * 2


def test_a_header_cut_off_by_the_end():
    for seed in range(200):
        payload = _noise_holding(seed, 1024, 1020, b"\xff\xf8\x60\x00")
        (stream,) = flac.encode_streams([payload])
        if stream[-2] >> 5 == 6:  # the checksum reads as the first of two bytes of a number
            break
    assert stream[-6:-2] == b"\xff\xf8\x60\x00" and stream[-2] >> 5 == 6
    assert flac.decode_streams([stream])[0].pcm == payload


def test_samples_that_hold_the_checksum_of_what_precedes_them():
    """The false frame ends rightly; only the chain behind it does not."""
    payload = bytearray(_noise_holding(8, 3072, 500, b""))
    head = flac._head(0, 1024)
    told = flac.crc16(head + b"\x02" + bytes(b ^ 0x80 for b in payload[:500])).to_bytes(2, "big")
    payload[500 : 502 + len(flac._head(1, 1024))] = bytes(b ^ 0x80 for b in told + flac._head(1, 1024))
    (stream,) = flac.encode_streams([bytes(payload)])
    assert stream.count(flac._head(1, 1024)) == 2
    assert flac.decode_streams([stream])[0].pcm == bytes(payload)
    with pytest.raises(ValueError):
        flac.decode_streams([stream[:-1] + bytes([stream[-1] ^ 1])])
    with pytest.raises(ValueError):
        flac.decode_streams([stream[: flac._stream_info(stream).first_frame]])
