"""Media columns: ISO base media files as binary columns.

write() stores bytes losslessly as unsigned 8-bit mono samples in a small ISO
media file. read() walks the nested boxes of any such file, decodes the sample
tables and gives codec, duration and the byte range of each keyframe; it never
looks into a sample. payload() joins the samples' bytes through those ranges.
Damaged files give a row with the error, not a failed job.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from loomflow.llm.common import column, text_of

#: Bytes in a sample, samples in a chunk, samples from one keyframe to the next.
UNIT, PER_CHUNK, KEY_EVERY = 64, 64, 64
RATE = 8000
#: Boxes that hold boxes, and those that may be nested at most so deep.
CONTAINERS = {b"moov", b"trak", b"mdia", b"minf", b"dinf", b"stbl", b"edts", b"udta", b"mvex", b"moof", b"traf"}
DEEPEST = 16


class BadMedia(ValueError):
    """The bytes are not a file whose samples can be placed."""


@dataclass
class Track:
    codec: str = ""
    timescale: int = 0
    duration: int = 0
    sizes: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    offsets: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    keys: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))

    @property
    def seconds(self) -> float:
        return self.duration / self.timescale if self.timescale else 0.0

    def key_ranges(self) -> list[tuple[int, int]]:
        """First byte and the byte after the last, of each keyframe."""
        start = self.offsets[self.keys]
        return list(zip(start.tolist(), (start + self.sizes[self.keys]).tolist(), strict=True))


def _box(kind: bytes, *parts: bytes) -> bytes:
    body = b"".join(parts)
    if len(body) + 8 < 1 << 32:
        return struct.pack(">I4s", len(body) + 8, kind) + body
    return struct.pack(">I4sQ", 1, kind, len(body) + 16) + body


def _full(kind: bytes, fields: bytes, version: int = 0, flags: int = 0) -> bytes:
    return _box(kind, struct.pack(">I", version << 24 | flags), fields)


_UNITY = struct.pack(">9i", 1 << 16, 0, 0, 0, 1 << 16, 0, 0, 0, 1 << 30)


def write(payload: bytes) -> bytes:
    """An ISO media file of the payload, whose length is a positive multiple of UNIT; other lengths, the empty one too, raise ValueError. Equal payloads give equal files."""
    if not payload or len(payload) % UNIT:
        raise ValueError(f"the payload must be a positive multiple of {UNIT} bytes")
    samples = len(payload) // UNIT
    chunks = -(-samples // PER_CHUNK)
    brand = _box(b"ftyp", b"isom", struct.pack(">I", 512), b"isommp42")
    data = _box(b"mdat", payload)
    first = len(brand) + len(data) - len(payload)
    starts = first + np.arange(chunks, dtype=np.uint64) * (UNIT * PER_CHUNK)
    last = samples - (chunks - 1) * PER_CHUNK
    runs = [(1, PER_CHUNK)] * (chunks > 1) + [(chunks, last)] * (chunks == 1 or last != PER_CHUNK)
    keys = np.arange(1, samples + 1, KEY_EVERY, dtype=np.uint32)
    entry = _box(b"raw ", struct.pack(">6xHIIHHHHI", 1, 0, 0, 1, 8, 0, 0, RATE << 16))
    wide = int(starts[-1]) >= 1 << 32
    table = _box(
        b"stbl",
        _full(b"stsd", struct.pack(">I", 1) + entry),
        _full(b"stts", struct.pack(">III", 1, samples, UNIT)),
        _full(b"stss", struct.pack(">I", len(keys)) + keys.astype(">u4").tobytes()),
        _full(b"stsc", struct.pack(">I", len(runs)) + b"".join(struct.pack(">III", at, n, 1) for at, n in runs)),
        _full(b"stsz", struct.pack(">II", UNIT, samples)),
        _full(b"co64" if wide else b"stco", struct.pack(">I", chunks) + starts.astype(">u8" if wide else ">u4").tobytes()),
    )
    length = len(payload)
    reference = _full(b"dref", struct.pack(">I", 1) + _full(b"url ", b"", flags=1))
    media = _box(
        b"mdia",
        _full(b"mdhd", struct.pack(">QQIQHH", 0, 0, RATE, length, 0x55C4, 0), version=1),
        _full(b"hdlr", struct.pack(">I4s12x", 0, b"soun") + b"samples\0"),
        _box(b"minf", _full(b"smhd", struct.pack(">HH", 0, 0)), _box(b"dinf", reference), table),
    )
    head = _full(b"tkhd", struct.pack(">QQIIQ8xHHHH", 0, 0, 1, 0, length, 0, 0, 256, 0) + _UNITY + struct.pack(">II", 0, 0), version=1, flags=7)
    movie = _full(b"mvhd", struct.pack(">QQIQIH10x", 0, 0, RATE, length, 1 << 16, 256) + _UNITY + struct.pack(">24xI", 2), version=1)
    return brand + data + _box(b"moov", movie, _box(b"trak", head, media))


def walk(media: bytes, start: int = 0, end: int | None = None, path: tuple = ()) -> Iterator[tuple[tuple, int, int]]:
    """(path of kinds, first byte of the body, byte after it) of each box, depth first."""
    end = len(media) if end is None else end
    if len(path) > DEEPEST:
        raise BadMedia("boxes are nested too deep")
    while start < end:
        if end - start < 8:
            raise BadMedia("a box header is cut off")
        size, kind = struct.unpack_from(">I4s", media, start)
        body = start + 8
        if size == 1:
            if end - start < 16:
                raise BadMedia("a box header is cut off")
            size, body = struct.unpack_from(">Q", media, body)[0], body + 8
        elif size == 0:
            size = end - start
        if size < body - start or start + size > end:
            raise BadMedia(f"box {kind!r} has a wrong size")
        yield (*path, kind), body, start + size
        if kind in CONTAINERS:
            yield from walk(media, body, start + size, (*path, kind))
        start += size


def _table(media: bytes, at: int, end: int, n: int, kind: str) -> np.ndarray:
    if at + n * np.dtype(kind).itemsize > end:
        raise BadMedia("a sample table is cut off")
    return np.frombuffer(media, kind, n, at).astype(np.int64)


def _samples(media: bytes, boxes: dict[bytes, tuple[int, int]]) -> Track:
    def fields(kind: bytes, form: str, skip: int = 4) -> tuple:
        if kind not in boxes:
            raise BadMedia(f"box {kind!r} is missing")
        at, end = boxes[kind]
        if at + skip + struct.calcsize(form) > end:
            raise BadMedia(f"box {kind!r} is cut off")
        return struct.unpack_from(form, media, at + skip)

    out = Track()
    version = fields(b"mdhd", ">B", 0)[0]
    out.timescale, out.duration = fields(b"mdhd", ">16xIQ" if version else ">8xII")
    out.codec = fields(b"stsd", ">I4x4s")[1].decode("latin-1")
    same, n = fields(b"stsz", ">II")
    at, end = boxes[b"stsz"]
    if same:
        if n * same > len(media):
            raise BadMedia("the samples are larger than the file")
        out.sizes = np.full(n, same, np.int64)
    else:
        out.sizes = _table(media, at + 12, end, n, ">u4")
    kind = b"co64" if b"co64" in boxes else b"stco"
    chunks = fields(kind, ">I")[0]
    places = _table(media, boxes[kind][0] + 8, boxes[kind][1], chunks, ">u8" if kind == b"co64" else ">u4")
    runs = fields(b"stsc", ">I")[0]
    to_chunk = _table(media, boxes[b"stsc"][0] + 8, boxes[b"stsc"][1], 3 * runs, ">u4").reshape(-1, 3)
    first = np.append(to_chunk[:, 0] - 1, chunks)
    if len(to_chunk) and (first[0] != 0 or (np.diff(first) < 0).any()):
        raise BadMedia("the chunk runs are out of order")
    per_chunk = np.repeat(to_chunk[:, 1], np.diff(first))
    if int(per_chunk.sum()) != n:
        raise BadMedia("the chunks do not hold the samples")
    chunk_of = np.repeat(np.arange(len(per_chunk)), per_chunk)
    before = np.concatenate([[0], np.cumsum(out.sizes)[:-1]]) if n else np.zeros(0, np.int64)
    opens = (np.cumsum(per_chunk) - per_chunk)[chunk_of] if n else np.zeros(0, np.int64)
    out.offsets = places[chunk_of] + before - before[opens] if n else before
    if n and (int((out.offsets + out.sizes).max()) > len(media) or int(out.offsets.min()) < 0):
        raise BadMedia("a sample lies outside the file")
    times = fields(b"stts", ">I")[0]
    pairs = _table(media, boxes[b"stts"][0] + 8, boxes[b"stts"][1], 2 * times, ">u4").reshape(-1, 2)
    if int(pairs[:, 0].sum()) != n:
        raise BadMedia("the times do not fit the samples")
    out.duration = int((pairs[:, 0] * pairs[:, 1]).sum()) or out.duration
    if b"stss" in boxes:
        out.keys = _table(media, boxes[b"stss"][0] + 8, boxes[b"stss"][1], fields(b"stss", ">I")[0], ">u4") - 1
        if len(out.keys) and (out.keys.min() < 0 or out.keys.max() >= n):
            raise BadMedia("a keyframe is not a sample")
    else:
        out.keys = np.arange(n)
    return out


def _numbers(media: bytes, at: int, end: int, count: int) -> list[int]:
    """So many unsigned 32-bit numbers."""
    if count < 0 or at + 4 * count > end:
        raise BadMedia("a fragment's header is cut off")
    return list(struct.unpack_from(f">{count}I", media, at))


#: Flags of tfhd and trun: what follows their first numbers; and of a sample, that it is no keyframe.
_BASE, _ENTRY, _DURATION, _SIZE, _FLAGS, _FROM_MOOF = 0x1, 0x2, 0x8, 0x10, 0x20, 0x20000
_RUN_OFFSET, _RUN_FIRST, _RUN_FIELDS = 0x1, 0x4, (0x100, 0x200, 0x400, 0x800)
_NO_KEY = 0x10000


@dataclass
class _Fragments:
    """What the boxes of movie fragments say of each track's further samples."""

    defaults: dict[int, list[int]] = field(default_factory=dict)  # duration, size, flags
    found: dict[int, list[tuple[np.ndarray, np.ndarray, np.ndarray, int]]] = field(default_factory=dict)
    moof: int = 0
    base: int = 0
    after: int | None = None
    track: int = 0
    own: list[int] = field(default_factory=list)

    def box(self, media: bytes, path: tuple, at: int, end: int) -> None:
        if path == (b"moov", b"mvex", b"trex"):
            _, track, _, *self.defaults[track] = _numbers(media, at, end, 6)
        elif path == (b"moof",):
            self.moof = at - (16 if media[at - 12 : at - 8] == b"moof" and media[at - 16 : at - 12] == b"\0\0\0\1" else 8)
            self.after = None
        elif path == (b"moof", b"traf", b"tfhd"):
            flags, self.track = _numbers(media, at, end, 2)
            at += 8
            self.own = list(self.defaults.get(self.track, [0, 0, 0]))
            self.base = self.moof if flags & _FROM_MOOF or self.after is None else self.after
            if flags & _BASE:
                high, low = _numbers(media, at, end, 2)
                self.base, at = high << 32 | low, at + 8
            at += 4 * bool(flags & _ENTRY)
            for k, flag in enumerate((_DURATION, _SIZE, _FLAGS)):
                if flags & flag:
                    self.own[k], at = _numbers(media, at, end, 1)[0], at + 4
            self.after = self.base
        elif path == (b"moof", b"traf", b"trun"):
            self.run(media, at, end)

    def run(self, media: bytes, at: int, end: int) -> None:
        flags, n = _numbers(media, at, end, 2)
        at += 8
        start, first = self.after if self.after is not None else self.moof, None
        if flags & _RUN_OFFSET:
            start, at = self.base + struct.unpack(">i", struct.pack(">I", _numbers(media, at, end, 1)[0]))[0], at + 4
        if flags & _RUN_FIRST:
            first, at = _numbers(media, at, end, 1)[0], at + 4
        told = [f for f in _RUN_FIELDS if flags & f]
        if told:
            rows = _table(media, at, end, n * len(told), ">u4").reshape(n, -1)
        elif n > len(media):
            raise BadMedia("the samples are larger than the file")
        durations, sizes, kinds = (rows[:, told.index(f)] if f in told else np.full(n, d, np.int64) for f, d in zip(_RUN_FIELDS, self.own, strict=False))
        if first is not None and n:
            kinds = kinds.copy()
            kinds[0] = first
        offsets = start + np.cumsum(sizes) - sizes
        if n and (int(offsets[0]) < 0 or int(sizes.sum()) + start > len(media)):
            raise BadMedia("a sample lies outside the file")
        self.after = start + int(sizes.sum())
        self.found.setdefault(self.track, []).append((sizes, offsets, np.flatnonzero(kinds & _NO_KEY == 0), int(durations.sum())))

    def extend(self, track: Track, number: int) -> Track:
        """The track with its samples in fragments."""
        parts = self.found.get(number, [])
        if parts:
            before = np.cumsum([len(track.sizes), *(len(p[0]) for p in parts)])
            duration = sum(p[3] for p in parts)
            track.duration = (track.duration if len(track.sizes) else 0) + duration or track.duration
            track.keys = np.concatenate([track.keys, *(p[2] + b for p, b in zip(parts, before, strict=False))])
            track.sizes, track.offsets = (np.concatenate([own, *(p[k] for p in parts)]) for k, own in ((0, track.sizes), (1, track.offsets)))
        return track


def read(media: bytes) -> list[Track]:
    """The tracks of a file, with the samples of its movie fragments, in the order of the file.

    Empty, cut and damaged bytes raise BadMedia; a file without tracks has none.
    """
    tracks: list[dict[bytes, tuple[int, int]]] = []
    fragments, boxes = _Fragments(), []
    for path, start, end in walk(media):
        if path == (b"moov", b"trak"):
            tracks.append({})
        elif path[:2] == (b"moov", b"trak"):
            tracks[-1][path[-1]] = (start, end)
        elif path[0] == b"moof" or path[-1] == b"trex":
            boxes.append((path, start, end))
    if not tracks:
        raise BadMedia("the file has no track")
    # defaults hold for all fragments, wherever they stand
    for path, start, end in sorted(boxes, key=lambda b: b[0][-1] != b"trex"):
        fragments.box(media, path, start, end)
    out = []
    for boxes_of in tracks:
        track, number = _samples(media, boxes_of), None
        if fragments.found:
            at, end = boxes_of.get(b"tkhd", (0, 0))
            if end - at < 24:
                raise BadMedia("a track of a fragmented file has no number")
            number = _numbers(media, at + (20 if media[at] else 12), end, 1)[0]
        out.append(fragments.extend(track, number) if number is not None else track)
    return out


def payload(media: bytes, track: Track) -> bytes:
    """The bytes of all samples, in order."""
    joined = len(track.sizes) and (track.offsets[1:] == track.offsets[:-1] + track.sizes[:-1]).all()
    if joined:
        return media[int(track.offsets[0]) : int(track.offsets[-1] + track.sizes[-1])]
    return b"".join(media[a : a + n] for a, n in zip(track.offsets.tolist(), track.sizes.tolist(), strict=True))


_FOUND = pa.schema([
    ("codec", pa.string()),
    ("duration_s", pa.float64()),
    ("n_samples", pa.int64()),
    ("keyframes", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
    ("error", pa.string()),
])


def index(df: DataFrame, id_col: str, media_col: str) -> DataFrame:
    """One row per row: id_col and, of the first track, codec, duration_s, n_samples, keyframes; else the error.

    Samples of movie fragments are counted in. Null media has the error ``no
    media``; ids may be null or repeated; an empty table gives no rows. Other
    columns are not read.
    """
    base = df.select(column(df, id_col).alias("id"), column(df, media_col).alias("media"))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for x in batch.column("media"):
                row = dict.fromkeys(_FOUND.names)
                try:
                    if not x.is_valid:
                        raise BadMedia("no media")
                    t = read(x.as_py())[0]
                    row |= {"codec": t.codec, "duration_s": t.seconds, "n_samples": len(t.sizes), "keyframes": [{"start": a, "end": b} for a, b in t.key_ranges()]}
                except BadMedia as e:
                    row["error"] = str(e)
                rows.append(row)
            found = pa.RecordBatch.from_pylist(rows, _FOUND)
            yield pa.RecordBatch.from_arrays([batch.column("id"), *found.columns], names=["id", *found.schema.names])

    kind = base.schema["id"].dataType.simpleString()
    out = base.mapInArrow(each, f"id {kind}, codec string, duration_s double, n_samples bigint, keyframes array<struct<start:bigint,end:bigint>>, error string")
    return out.withColumnRenamed("id", id_col)


def pad(data: bytes) -> bytes:
    """Zero bytes up to a positive multiple of UNIT."""
    return data + bytes(-len(data) % UNIT or (0 if data else UNIT))


def store(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row: id_col, n_bytes and media, the text's UTF-8 as an ISO media file.

    Null text is empty; equal texts have equal files; ids may be null or repeated.
    An empty table gives no rows. Other columns are not read.
    """
    base = docs.select(column(docs, id_col).alias("id"), text_of(docs, text_col).alias("text"))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # texts and files are held for some rows at a time
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                data = [x.as_buffer().to_pybytes() for x in part.column("text")]
                yield pa.RecordBatch.from_arrays(
                    [part.column("id"), pa.array(map(len, data), pa.int64()), pa.array([write(pad(x)) for x in data], pa.binary())],
                    names=["id", "n_bytes", "media"],
                )

    return base.mapInArrow(each, f"id {base.schema['id'].dataType.simpleString()}, n_bytes bigint, media binary").withColumnRenamed("id", id_col)


_DIGEST = ("payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "error")


def _digest(media: bytes | None) -> tuple:
    """The values of _DIGEST of one file."""
    if media is None:
        return (*[None] * 6, "no media")
    size, whole = len(media), hashlib.sha256(media).hexdigest()
    try:
        track = read(media)[0]
    except BadMedia as e:
        return (None, None, None, size, whole, None, str(e))
    back, ranges = payload(media, track), track.key_ranges()
    marks = np.asarray(ranges, "<i8").tobytes()
    ends = "".join(f" {name}={r[0]}-{r[1]}" for name, r in (("first", ranges[0]), ("last", ranges[-1]))) if ranges else ""
    feature = f"{track.codec.strip()} {track.seconds:.6f}s samples={len(track.sizes)} keyframes={len(ranges)}{ends} ranges={zlib.crc32(marks):08x}"
    return len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-UNIT:]), size, whole, feature, None


def digest(stored: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """What is read back from the stored files: payload checksums and, as text, codec, duration and keyframes.

    One row per row, ids null or repeated included. Damaged media has the error
    and its own size and checksum alone, null media the error ``no media``; an
    empty table gives no rows. Columns other than n_bytes and media are not read.
    """
    base = stored.select(column(stored, id_col).alias("id"), "n_bytes", "media")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [_digest(x.as_py()) for x in batch.column("media")]
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()]
            found = [pa.array(list(c), k) for c, k in zip(zip(*rows, strict=True) if rows else [()] * 7, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("n_bytes"), *found], names=["id", "n_bytes", *_DIGEST])

    kind = base.schema["id"].dataType.simpleString()
    out = base.mapInArrow(each, f"id {kind}, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string, error string")
    return out.withColumnRenamed("id", id_col)


def op2_media(spark, sf_dir: str) -> DataFrame:
    """Every text as an ISO media file, and what is read back from it."""
    from loomflow.session import table

    return digest(store(table(spark, sf_dir, "documents")))
