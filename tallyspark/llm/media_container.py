"""Media columns: ISO media files made, walked and described without decoding their payload.

``mux`` puts bytes into an MP4 file as one track of 64-byte samples, every
KEY-th of them a sync sample.  ``probe`` walks the nested boxes of any such
file, decodes the sample tables and gives codec, duration, the byte range of
every keyframe and, from the sample tables alone, the payload.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batched

#: Bytes of a sample, samples per second, samples per chunk of the file, and the distance of sync samples.
SAMPLE, TIMESCALE, CHUNK, KEY = 64, 25, 64, 16
#: Boxes that hold boxes.
CONTAINERS = (b"moov", b"trak", b"mdia", b"minf", b"stbl", b"edts", b"dinf")


def box(kind: bytes, *parts: bytes) -> bytes:
    body = b"".join(parts)
    if len(body) + 8 < 1 << 32:
        return struct.pack(">I4s", len(body) + 8, kind) + body
    return struct.pack(">I4sQ", 1, kind, len(body) + 16) + body


def full(kind: bytes, *parts: bytes, flags: int = 0) -> bytes:
    return box(kind, struct.pack(">I", flags), *parts)


def pad(raw: bytes, unit: int = SAMPLE) -> bytes:
    """raw and bytes 0 up to a positive multiple of unit."""
    return raw + b"\0" * (max(unit, -(-len(raw) // unit) * unit) - len(raw))


def mux(payload: bytes, codec: bytes = b"raw ") -> bytes:
    """An MP4 file with the payload, a positive multiple of 64 bytes, as its samples. Equal payloads give equal files."""
    n = len(payload) // SAMPLE
    matrix = struct.pack(">9I", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)
    ftyp = box(b"ftyp", b"isom", struct.pack(">I", 512), b"isomiso2mp41")
    keys = np.arange(1, n + 1, KEY, dtype=">u4")
    entry = box(codec, b"\0" * 6, struct.pack(">H", 1), b"\0" * 16, struct.pack(">HHIIIH", 8, 8, 0x480000, 0x480000, 0, 1), b"\0" * 32, struct.pack(">Hh", 8, -1))
    chunks = -(-n // CHUNK)
    runs = [(1, CHUNK, 1)] if n % CHUNK == 0 else [(1, n, 1)] if chunks == 1 else [(1, CHUNK, 1), (chunks, n % CHUNK, 1)]

    def moov(start: int) -> bytes:
        offsets = start + np.arange(chunks, dtype=np.int64) * CHUNK * SAMPLE
        wide = bool(offsets[-1] >= 1 << 32)
        stbl = box(
            b"stbl",
            full(b"stsd", struct.pack(">I", 1), entry),
            full(b"stts", struct.pack(">III", 1, n, 1)),
            full(b"stss", struct.pack(">I", len(keys)), keys.tobytes()),
            full(b"stsc", struct.pack(">I", len(runs)), *(struct.pack(">III", *r) for r in runs)),
            full(b"stsz", struct.pack(">II", SAMPLE, n)),
            full(b"co64" if wide else b"stco", struct.pack(">I", chunks), offsets.astype(">u8" if wide else ">u4").tobytes()),
        )
        minf = box(b"minf", full(b"vmhd", b"\0" * 8, flags=1), box(b"dinf", full(b"dref", struct.pack(">I", 1), full(b"url ", flags=1))), stbl)
        mdhd = full(b"mdhd", struct.pack(">IIIIHH", 0, 0, TIMESCALE, n, 0x55C4, 0))
        hdlr = full(b"hdlr", struct.pack(">I4s", 0, b"vide"), b"\0" * 12, b"payload\0")
        tkhd = full(b"tkhd", struct.pack(">IIIII", 0, 0, 1, 0, n), b"\0" * 16, matrix, struct.pack(">II", 8 << 16, 8 << 16), flags=3)
        mvhd = full(b"mvhd", struct.pack(">IIII", 0, 0, TIMESCALE, n), struct.pack(">IH", 0x10000, 0x100), b"\0" * 10, matrix, b"\0" * 24, struct.pack(">I", 2))
        return box(b"moov", mvhd, box(b"trak", tkhd, box(b"mdia", mdhd, hdlr, minf)))

    head = moov(0)
    start = len(ftyp) + len(head) + (8 if len(payload) + 8 < 1 << 32 else 16)
    return ftyp + moov(start) + box(b"mdat", payload)


def walk(data: bytes, start: int, end: int, path: str = "") -> Iterator[tuple[str, int, int]]:
    """(path, start, end) of the body of each box, parents before children; a box that overruns its parent ends the walk there."""
    # boxes nest a few levels deep; a broken file that claims more ends the walk
    if path.count("/") > 12:
        return
    while start + 8 <= end:
        size, kind = struct.unpack_from(">I4s", data, start)
        head = 8
        if size == 1 and start + 16 <= end:
            size, head = struct.unpack_from(">Q", data, start + 8)[0], 16
        elif size == 0:
            size = end - start
        if size < head or start + size > end:
            return
        here = f"{path}/{kind.decode('latin-1')}"
        yield here, start + head, start + size
        if kind in CONTAINERS:
            yield from walk(data, start + head, start + size, here)
        start += size


EMPTY = {"brand": None, "codec": None, "timescale": 0, "duration": 0, "samples": 0, "keyframes": [], "payload": None}


def inner(data: bytes, start: int, end: int, *names: str) -> tuple[int, int] | None:
    """The body of the first box at a path below a body."""
    for name in names:
        found = next(((a, b) for path, a, b in walk(data, start, end) if path == f"/{name}"), None)
        if found is None:
            return None
        start, end = found
    return start, end


def numbers(data: bytes, kind: str, count: int, at: int, end: int) -> np.ndarray:
    """``count`` numbers of a table that lies in the box body up to ``end``; a table that claims more than its box holds is broken."""
    if count * np.dtype(kind).itemsize > end - at:
        raise ValueError("the table is longer than its box")
    return np.frombuffer(data, kind, count, at).astype(np.int64)


def probe_track(data: bytes, start: int, end: int) -> dict | None:
    """codec, timescale, duration, samples, keyframes and payload of the track in a body; None without a whole sample table."""
    mdhd, stbl = inner(data, start, end, "mdia", "mdhd"), inner(data, start, end, "mdia", "minf", "stbl")
    if mdhd is None or stbl is None:
        return None
    at: dict[str, tuple[int, int]] = {}
    for path, a, b in walk(data, *stbl):
        at.setdefault(path[1:], (a, b))
    wide = "co64" in at
    if any(k not in at for k in ("stsd", "stsc", "stsz", "co64" if wide else "stco")):
        return None
    try:
        a = mdhd[0]
        timescale, duration = struct.unpack_from(">IQ", data, a + 20) if data[a] == 1 else struct.unpack_from(">II", data, a + 12)
        codec = data[at["stsd"][0] + 12 : at["stsd"][0] + 16].decode("latin-1")
        a, b = at["stsz"]
        size, n = struct.unpack_from(">II", data, a + 4)
        # samples of one size need no table, so their number is bounded by the bytes of the file instead
        if size and n * size > len(data):
            return None
        sizes = np.full(n, size, np.int64) if size else numbers(data, ">u4", n, a + 12, b)
        # chunks may overlap, but together samples hold no more bytes than the file
        if sizes.sum() > len(data):
            return None
        a, b = at["co64" if wide else "stco"]
        chunks = numbers(data, ">u8" if wide else ">u4", struct.unpack_from(">I", data, a + 4)[0], a + 8, b)
        a, b = at["stsc"]
        runs = numbers(data, ">u4", 3 * struct.unpack_from(">I", data, a + 4)[0], a + 8, b).reshape(-1, 3)
        times = np.diff(np.append(runs[:, 0], len(chunks) + 1))
        if (times < 0).any() or (n and (runs[:, 1] * times).sum() < n):
            return None
        # a run of chunks holds no more samples than there are, so nothing longer than the sample table is made
        first = np.minimum(np.append(0, np.cumsum(np.repeat(np.minimum(runs[:, 1], n), times)))[: len(chunks)], n)
        ends = np.append(first[1:], n)
        chunk_of = np.repeat(np.arange(len(chunks)), ends - first)
        before = np.cumsum(sizes) - sizes
        starts = chunks[chunk_of] + before - before[first[chunk_of]] if n else np.zeros(0, np.int64)
        if n and ((starts < 0).any() or (starts + sizes > len(data)).any()):
            return None
        if "stss" in at:
            a, b = at["stss"]
            keys = numbers(data, ">u4", struct.unpack_from(">I", data, a + 4)[0], a + 8, b) - 1
        else:
            keys = np.arange(n)
        payload = b"".join(data[starts[f] : starts[e - 1] + sizes[e - 1]] for f, e in zip(first, ends) if e > f)
        frames = [{"start": int(starts[k]), "end": int(starts[k] + sizes[k])} for k in keys if 0 <= k < n]
    except (struct.error, ValueError, IndexError):
        return None
    return {"codec": codec, "timescale": timescale, "duration": duration, "samples": int(n), "keyframes": frames, "payload": payload}


def probe(data: bytes | None) -> dict:
    """What a file's first whole track says; EMPTY for null and for bytes without one. Each track is read by its own boxes alone."""
    if not data:
        return EMPTY
    ftyp, moov = inner(data, 0, len(data), "ftyp"), inner(data, 0, len(data), "moov")
    if ftyp is None or moov is None:
        return EMPTY
    for path, a, b in walk(data, *moov):
        if path == "/trak" and (track := probe_track(data, a, b)):
            return {"brand": data[ftyp[0] : ftyp[0] + 4].decode("latin-1"), **track}
    return EMPTY


def store_media(rows: DataFrame, payload_col: str = "payload", out: str = "media") -> DataFrame:
    """``rows`` with a column ``out`` (replaced if it is there): the file for each payload, padded to whole samples.

    Null is stored like no bytes, equal payloads as equal files, repeated rows each; an empty table stays empty.
    """

    @F.arrow_udf("binary")
    def muxed(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array([mux(pad(x.as_py() or b"")) for x in batch], pa.binary())

    return batched(rows).withColumn(out, muxed(F.col(payload_col)))


def describe_media(rows: DataFrame, media_col: str = "media", out: str = "info") -> DataFrame:
    """``rows`` with a struct ``out`` (replaced if it is there): brand, codec, timescale, duration, samples, keyframes (byte ranges) and the payload read back.

    Null or broken files have null strings, zeros, no keyframes and a null payload.
    """
    kind = "struct<brand:string,codec:string,timescale:bigint,duration:bigint,samples:bigint,keyframes:array<struct<start:bigint,end:bigint>>,payload:binary>"
    arrow = pa.struct([("brand", pa.string()), ("codec", pa.string()), ("timescale", pa.int64()), ("duration", pa.int64()), ("samples", pa.int64()), ("keyframes", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), ("payload", pa.binary())])

    @F.arrow_udf(kind)
    def probed(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array([probe(x.as_py()) for x in batch], arrow)

    return batched(rows).withColumn(out, probed(F.col(media_col)))
