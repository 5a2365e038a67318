import hashlib
import random
import struct
import zlib

import pytest

from loomflow.llm import media

DOCS = "doc_id bigint, text string, media string, n_bytes int"


@pytest.mark.parametrize("n", [64, 128, 64 * 63, 64 * 64, 64 * 65, 64 * 128, 64 * 1000])
def test_round_trip(n):
    data = random.Random(n).randbytes(n)
    stored = media.write(data)
    (track,) = media.read(stored)
    assert media.payload(stored, track) == data
    assert track.codec == "raw " and track.seconds == n / media.RATE
    assert [stored[a:b] for a, b in track.key_ranges()] == [data[k : k + 64] for k in range(0, n, 64 * 64)]


def test_every_document_is_read_back(spark):
    texts = [None, "", "abc", "é" * 32, "x" * 64, "y" * 100_000, "abc"]
    df = spark.createDataFrame([(k, t, "clash", 1) for k, t in enumerate(texts)] + [(None, "z", "", 0)], DOCS)
    rows = {r["doc_id"]: r for r in media.digest(media.store(df)).collect()}
    for k, t in [*enumerate(texts), (None, "z")]:
        data = (t or "").encode()
        padded = data + bytes((64 - len(data) % 64) % 64 if data else 64)
        r = rows[k]
        assert (r["n_bytes"], r["payload_bytes"]) == (len(data), len(padded))
        assert r["payload_sha256"] == hashlib.sha256(padded).hexdigest()
        assert r["tail_crc32"] == zlib.crc32(padded[-64:])
        assert (r["media_bytes"], r["media_sha256"]) == (len(media.write(padded)), hashlib.sha256(media.write(padded)).hexdigest())
    assert rows[2]["feature"] == rows[6]["feature"]
    assert media.digest(media.store(df.limit(0))).collect() == []


def test_other_layouts():
    # sizes of their own, chunks out of order, 64-bit offsets, every sample a keyframe
    payloads = [b"a" * 5, b"b" * 3, b"c" * 7]
    data = payloads[2] + payloads[0] + payloads[1]
    brand = media._box(b"ftyp", b"isom")
    base = len(brand) + 16
    mdat = struct.pack(">I4sQ", 1, b"mdat", len(data) + 16) + data
    stbl = media._box(
        b"stbl",
        media._full(b"stsd", struct.pack(">I", 1) + media._box(b"avc1", bytes(8))),
        media._full(b"stts", struct.pack(">I4I", 2, 1, 10, 2, 20)),
        media._full(b"stsc", struct.pack(">I6I", 2, 1, 2, 1, 2, 1, 1)),
        media._full(b"stsz", struct.pack(">II3I", 0, 3, 5, 3, 7)),
        media._full(b"co64", struct.pack(">IQQ", 2, base + 7, base)),
    )
    mdia = media._box(b"mdia", media._full(b"mdhd", struct.pack(">IIIIHH", 0, 0, 100, 0, 0, 0)), media._box(b"minf", stbl))
    stored = brand + mdat + media._box(b"moov", media._box(b"trak", mdia))
    (track,) = media.read(stored)
    assert media.payload(stored, track) == b"".join(payloads)
    assert (track.codec, track.seconds, len(track.key_ranges())) == ("avc1", 0.5, 3)


def test_damaged_files_give_errors(spark):
    good = media.write(bytes(64 * 70))
    rng = random.Random(9)
    damaged = [None, b"", good[:40], good[:-1], good + b"\0\0"]
    for _ in range(400):
        x = bytearray(good)
        for _ in range(rng.randint(1, 6)):
            x[rng.randrange(len(x) - 700, len(x))] = rng.randrange(256)
        damaged.append(bytes(x))
    df = spark.createDataFrame([(k, x) for k, x in enumerate([good, *damaged])], "doc_id bigint, media binary")
    rows = {r["doc_id"]: r for r in media.index(df, "doc_id", "media").collect()}
    assert len(rows) == len(damaged) + 1
    assert rows[0]["error"] is None and rows[0]["n_samples"] == 70 and len(rows[0]["keyframes"]) == 2
    assert all(rows[k]["error"] for k in range(1, 6))


def fragmented():
    """Two samples in the movie's own table, then two fragments of a track: by defaults, and with sizes and keyframes of their own."""
    brand = media._box(b"ftyp", b"isom")
    stbl = media._box(
        b"stbl",
        media._full(b"stsd", struct.pack(">I", 1) + media._box(b"avc1", bytes(8))),
        *(media._full(kind, struct.pack(">I", 0)) for kind in (b"stts", b"stsc", b"stco")),
        media._full(b"stsz", struct.pack(">II", 0, 0)),
    )
    mdia = media._box(b"mdia", media._full(b"mdhd", struct.pack(">IIIIHH", 0, 0, 100, 0, 0, 0)), media._box(b"minf", stbl))
    head = media._full(b"tkhd", struct.pack(">III", 0, 0, 7) + bytes(64))
    trex = media._full(b"trex", struct.pack(">5I", 7, 1, 10, 4, 0))
    out = brand + media._box(b"moov", media._box(b"trak", head, mdia), media._box(b"mvex", trex))

    def moof(offset):
        one = media._box(b"traf", media._full(b"tfhd", struct.pack(">I", 7), flags=0x20000), media._full(b"trun", struct.pack(">Ii", 3, offset), flags=0x1))
        return media._box(b"moof", media._full(b"mfhd", struct.pack(">I", 1)), one)

    first = moof(len(moof(0)) + 8)
    out += first + media._box(b"mdat", b"aaaabbbbcccc")

    def other(offset):
        run = struct.pack(">IiI", 2, offset, 0) + struct.pack(">6I", 20, 5, 0x10000, 30, 2, 0x10000)
        return media._box(b"moof", media._full(b"mfhd", struct.pack(">I", 2)), media._box(b"traf", media._full(b"tfhd", struct.pack(">I", 7), flags=0x20000), media._full(b"trun", run, flags=0x1 | 0x4 | 0x700)))

    return out + other(len(other(0)) + 8) + media._box(b"mdat", b"dddddee")


def test_fragments_are_decoded():
    stored = fragmented()
    (track,) = media.read(stored)
    assert media.payload(stored, track) == b"aaaabbbbccccdddddee"
    assert track.seconds == (3 * 10 + 20 + 30) / 100
    assert [stored[a:b] for a, b in track.key_ranges()] == [b"aaaa", b"bbbb", b"cccc", b"ddddd"]


def test_digest_gives_rows_for_bad_media(spark):
    good = media.write(bytes(64))
    rows = [(1, 64, good), (2, 0, None), (3, 0, b""), (None, 0, good[:50]), (5, 0, fragmented()), (6, 0, fragmented()[:-3])]
    got = {r["doc_id"]: r for r in media.digest(spark.createDataFrame(rows, "doc_id bigint, n_bytes bigint, media binary")).collect()}
    assert got[1]["error"] is None and got[1]["payload_bytes"] == 64
    assert got[2]["error"] == "no media" and got[2]["media_bytes"] is None
    assert all(got[k]["error"] and got[k]["feature"] is None for k in (2, 3, None, 6))
    assert got[5]["payload_sha256"] == hashlib.sha256(b"aaaabbbbccccdddddee").hexdigest()
    assert got[6]["media_bytes"] == len(fragmented()) - 3
