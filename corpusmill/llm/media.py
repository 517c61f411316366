"""Media columns over ISO base media containers.

`pack` stores a payload as raw 8-bit frames in an ISO file; `walk` reads a file's
nested boxes and decodes its sample tables, which give codec, duration and the
byte ranges of the keyframes without decoding a frame.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from .common import per_text, table

#: A frame is 24 x 24 samples of 8 bits.
SIDE = 24
FRAME = SIDE * SIDE
#: Frames from one keyframe to the next, frames in one chunk, frames in a second.
KEY_EVERY, CHUNK_FRAMES, RATE = 8, 4, 25
CODEC = b"raw "
#: Boxes that hold boxes (ISO/IEC 14496-12; fixed values).
CONTAINERS = {b"moov", b"trak", b"mdia", b"minf", b"stbl", b"dinf", b"edts", b"udta", b"moof", b"traf", b"mvex"}
#: Identity transform of a track (fixed values).
MATRIX = struct.pack(">9I", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)


def _box(kind: bytes, *parts: bytes) -> bytes:
    body = b"".join(parts)
    return struct.pack(">I4s", len(body) + 8, kind) + body


def _full(kind: bytes, *parts: bytes, flags: int = 0) -> bytes:
    return _box(kind, struct.pack(">I", flags), *parts)


def _table(values) -> bytes:
    return np.asarray(values, ">u4").tobytes()


def padded(data: bytes) -> bytes:
    """The bytes with 255 after them, up to a positive multiple of a frame."""
    frames = max(1, -(-len(data) // FRAME))
    return data + b"\xff" * (frames * FRAME - len(data))


def pack(payload: bytes) -> bytes:
    """A container with the payload's frames, a positive whole number of them."""
    frames = len(payload) // FRAME
    chunks = -(-frames // CHUNK_FRAMES)
    head = _box(b"ftyp", b"isom", struct.pack(">I", 0x200), b"isomiso2")
    rest = frames - (chunks - 1) * CHUNK_FRAMES
    runs = [(1, CHUNK_FRAMES, 1)] if rest == CHUNK_FRAMES else [(1, CHUNK_FRAMES, 1), (chunks, rest, 1)]
    runs = runs[-1:] if chunks == 1 else runs
    entry = _box(
        CODEC, bytes(6), struct.pack(">H", 1), bytes(16), struct.pack(">HH", SIDE, SIDE),
        struct.pack(">IIIH", 0x480000, 0x480000, 0, 1), bytes(32), struct.pack(">Hh", 8, -1),
    )

    def moov(first: int) -> bytes:
        offsets = first + np.arange(chunks, dtype="i8") * CHUNK_FRAMES * FRAME
        places = (
            _full(b"stco", struct.pack(">I", chunks), _table(offsets))
            if first + len(payload) < 1 << 32
            else _full(b"co64", struct.pack(">I", chunks), offsets.astype(">u8").tobytes())
        )
        stbl = _box(
            b"stbl",
            _full(b"stsd", struct.pack(">I", 1), entry),
            _full(b"stts", struct.pack(">III", 1, frames, 1)),
            _full(b"stss", struct.pack(">I", -(-frames // KEY_EVERY)), _table(np.arange(1, frames + 1, KEY_EVERY))),
            _full(b"stsc", struct.pack(">I", len(runs)), _table(runs)),
            _full(b"stsz", struct.pack(">II", FRAME, frames)),
            places,
        )
        media = _box(
            b"mdia",
            _full(b"mdhd", struct.pack(">IIIIHH", 0, 0, RATE, frames, 0x55C4, 0)),
            _full(b"hdlr", bytes(4), b"vide", bytes(12), b"\0"),
            _box(
                b"minf",
                _full(b"vmhd", bytes(8), flags=1),
                _box(b"dinf", _full(b"dref", struct.pack(">I", 1), _full(b"url ", flags=1))),
                stbl,
            ),
        )
        track = _full(
            b"tkhd", struct.pack(">IIIII", 0, 0, 1, 0, frames), bytes(16), MATRIX,
            struct.pack(">II", SIDE << 16, SIDE << 16), flags=3,
        )
        movie = _full(
            b"mvhd", struct.pack(">IIIIIH", 0, 0, RATE, frames, 0x10000, 0x100), bytes(10), MATRIX, bytes(24),
            struct.pack(">I", 2),
        )
        return _box(b"moov", movie, _box(b"trak", track, media))

    size = len(moov(0))
    first = len(head) + size + 8
    return head + moov(first) + _box(b"mdat", payload)


def boxes(data: bytes, start: int = 0, end: int | None = None) -> Iterator[tuple[tuple[bytes, ...], int, int]]:
    """(path, start of body, end of body) of every box, parents before children.

    Sizes of 0 (to the end) and 1 (64 bits follow) are understood; a size that
    leaves its parent raises.
    """
    todo = [((), start, len(data) if end is None else end)]
    while todo:
        path, at, stop = todo.pop()
        inner = []
        while at + 8 <= stop:
            size, kind = struct.unpack_from(">I4s", data, at)
            body = at + 8
            if size == 1:
                (size,) = struct.unpack_from(">Q", data, body)
                body += 8
            last = stop if size == 0 else at + size
            if last > stop or last < body:
                raise ValueError(f"box {kind!r} leaves its parent")
            yield (*path, kind), body, last
            if kind in CONTAINERS:
                inner.append(((*path, kind), body, last))
            at = last
        todo += reversed(inner)


def walk(data: bytes) -> list[dict]:
    """One dict per track: codec, timescale, duration, and its samples' offsets, sizes and keyframe numbers."""
    tracks: list[dict] = []
    for path, at, end in boxes(data):
        kind = path[-1]
        if kind == b"trak":
            tracks.append({"codec": "", "timescale": 0, "duration": 0, "keys": None})
        if not tracks or b"trak" not in path:
            continue
        track = tracks[-1]
        if kind == b"mdhd":
            if data[at] == 1:
                track["timescale"], track["duration"] = struct.unpack_from(">IQ", data, at + 20)
            else:
                track["timescale"], track["duration"] = struct.unpack_from(">II", data, at + 12)
        elif kind == b"stsd":
            track["codec"] = data[at + 12 : at + 16].decode("latin-1").strip()
        elif kind == b"stts":
            track["times"] = np.frombuffer(data, ">u4", offset=at + 8, count=(end - at - 8) // 4).reshape(-1, 2)
        elif kind == b"stss":
            track["keys"] = np.frombuffer(data, ">u4", offset=at + 8, count=(end - at - 8) // 4).astype("i8") - 1
        elif kind == b"stsc":
            track["runs"] = np.frombuffer(data, ">u4", offset=at + 8, count=(end - at - 8) // 4).reshape(-1, 3)
        elif kind == b"stsz":
            same, n = struct.unpack_from(">II", data, at + 4)
            track["sizes"] = (
                np.full(n, same, "i8") if same else np.frombuffer(data, ">u4", offset=at + 12, count=n).astype("i8")
            )
        elif kind in (b"stco", b"co64"):
            width = ">u4" if kind == b"stco" else ">u8"
            (n,) = struct.unpack_from(">I", data, at + 4)
            track["chunks"] = np.frombuffer(data, width, offset=at + 8, count=n).astype("i8")
    for track in tracks:
        if not {"sizes", "chunks", "runs"} <= track.keys():  # no sample tables, as in fragmented files
            none = np.empty(0, "i8")
            track |= {"sizes": none, "offsets": none, "keys": none}
            continue
        sizes, chunks, runs = track["sizes"], track["chunks"], track["runs"].astype("i8")
        firsts = np.append(runs[:, 0] - 1, len(chunks))
        in_chunk = np.repeat(runs[:, 1], np.diff(firsts))
        chunk_of = np.repeat(np.arange(len(chunks)), in_chunk)[: len(sizes)]
        before = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        first_of_chunk = np.concatenate([[0], np.cumsum(in_chunk)[:-1]])
        track["offsets"] = chunks[chunk_of] + before - before[first_of_chunk[chunk_of]]
        if track["keys"] is None:  # without the table every sample is a keyframe
            track["keys"] = np.arange(len(sizes))
    return tracks


def tracks_of(data: bytes) -> list[dict]:
    """As `walk`; none if the boxes or tables are broken."""
    try:
        return walk(data)
    except (ValueError, IndexError, struct.error):
        return []


def read_back(data: bytes, track: dict) -> bytes:
    """The bytes of a track's samples, in order."""
    return b"".join(data[o : o + s] for o, s in zip(track["offsets"].tolist(), track["sizes"].tolist()))


def feature(track: dict) -> str:
    """Codec, duration in seconds and keyframe byte ranges as one string."""
    keys = track["keys"]
    spans = ",".join(
        f"{o}-{o + s}" for o, s in zip(track["offsets"][keys].tolist(), track["sizes"][keys].tolist())
    )
    seconds = track["duration"] / track["timescale"] if track["timescale"] else 0.0
    return f"codec={track['codec']};seconds={seconds:.2f};samples={len(track['sizes'])};keyframes={spans}"


def store(df: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, media binary): each whole text's bytes as a container. A null text is an empty one."""
    return per_text(df, lambda texts: [(pack(padded(t)),) for t in texts], "media binary", key, text)


def inspect(df: DataFrame, media: str = "media", key: str = "doc_id") -> DataFrame:
    """(key, codec, seconds, n_samples, keyframes array of byte ranges) of stored containers.

    The first track counts. A null, empty or broken container has none: null
    codec and seconds, no keyframes. A track without sample tables has no
    samples, one without a time scale null seconds.
    """

    def work(blobs: list[bytes]) -> list[tuple]:
        rows = []
        for blob in blobs:
            track = next(iter(tracks_of(blob)), None)
            if track is None:
                rows.append((None, None, 0, []))
                continue
            keys = track["keys"]
            starts, sizes = track["offsets"][keys].tolist(), track["sizes"][keys].tolist()
            spans = [{"start": o, "end": o + s} for o, s in zip(starts, sizes)]
            seconds = track["duration"] / track["timescale"] if track["timescale"] else None
            rows.append((track["codec"], seconds, len(track["sizes"]), spans))
        return rows

    schema = "codec string, seconds double, n_samples bigint, keyframes array<struct<start:bigint,end:bigint>>"
    return per_text(df, work, schema, key, media)


def digests(df: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Store every whole text, read the stored bytes back and return digests of both.

    Null and empty texts are one frame of 255. Equal texts give equal values,
    whatever their key.
    """

    def work(texts: list[bytes]) -> list[tuple]:
        rows = []
        for data in texts:
            media = pack(padded(data))
            track = walk(media)[0]
            payload = read_back(media, track)
            rows.append((
                len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]),
                len(media), hashlib.sha256(media).hexdigest(), feature(track),
            ))
        return rows

    schema = (
        "n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, "
        "media_bytes bigint, media_sha256 string, feature string"
    )
    return per_text(df, work, schema, key, text)


def op7_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"))


QUERIES = {"op7_media": op7_media}
ORACLES: dict[str, str] = {}
