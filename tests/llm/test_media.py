import hashlib
import zlib

import pytest

from tallyspark.llm import media_container as mc
from tallyspark.llm.queries import op7_media


@pytest.mark.parametrize("n", [0, 1, 63, 64, 65, 64 * 64, 64 * 64 + 1, 64 * 64 * 5, 100_003])
def test_round_trip(n):
    raw = bytes(i % 251 for i in range(n))
    payload = mc.pad(raw)
    assert len(payload) % 64 == 0 and len(payload) > 0 and payload.startswith(raw) and len(payload) - n <= 64
    found = mc.probe(mc.mux(payload))
    assert found["payload"] == payload and found["samples"] == found["duration"] == len(payload) // 64
    data = mc.mux(payload)
    assert [data[f["start"] : f["end"]] for f in found["keyframes"]] == [payload[i : i + 64] for i in range(0, len(payload), 64 * mc.KEY)]


def test_broken_files():
    data = mc.mux(mc.pad(b"abc"))
    for cut in range(0, len(data), 7):
        mc.probe(data[:cut])
    assert mc.probe(None) == mc.probe(b"") == mc.probe(b"no boxes here") == mc.EMPTY


def test_sizes_by_sample_and_64_bit_offsets():
    data = mc.mux(mc.pad(b"x" * 200))
    assert dict((p, b - a) for p, a, b in mc.walk(data, 0, len(data)))["/mdat"] == 256


def boxes(data):
    return {path: (a, b) for path, a, b in mc.walk(data, 0, len(data))}


def two_tracks(first_has_sync):
    """A file with the tracks of two others, each with its own sample table, behind one another's payload."""
    one, two = mc.mux(mc.pad(b"a" * 256)), mc.mux(mc.pad(b"b" * 64 * 20))
    if not first_has_sync:
        a, _ = boxes(one)["/moov/trak/mdia/minf/stbl/stss"]
        one = one[: a - 4] + b"free" + one[a:]  # the box stays, its name says nothing
    at, bt = boxes(one), boxes(two)
    track = lambda data, found: data[found["/moov/trak"][0] - 8 : found["/moov/trak"][1]]
    second = bytearray(track(two, bt))
    ftyp = one[: at["/ftyp"][1]]
    head = len(ftyp) + 8 + len(track(one, at)) + len(second)
    first = bytearray(track(one, at))

    def shift(data, by):
        k = data.find(b"stco") + 12
        data[k : k + 4] = by.to_bytes(4, "big")

    shift(first, head + 8)
    shift(second, head + 8 + 256)
    moov = mc.box(b"moov", bytes(first), bytes(second))
    return ftyp + moov + mc.box(b"mdat", b"a" * 256 + b"b" * 64 * 20)


def test_tracks_do_not_mix():
    with_sync, without = mc.probe(two_tracks(True)), mc.probe(two_tracks(False))
    assert with_sync["payload"] == without["payload"] == b"a" * 256
    assert len(with_sync["keyframes"]) == 1 and len(without["keyframes"]) == 4
    data = two_tracks(True)
    tracks = [(a, b) for path, a, b in mc.walk(data, 0, len(data)) if path == "/moov/trak"]
    second = mc.probe_track(data, *tracks[1])
    assert second["payload"] == b"b" * 64 * 20 and len(second["keyframes"]) == 2


def test_claims_beyond_the_file_are_refused():
    data = bytearray(mc.mux(mc.pad(b"x" * 300)))
    for name, at in (("stsz", 8), ("stsc", 4), ("stco", 4), ("stss", 4)):
        broken = bytearray(data)
        a = boxes(bytes(data))[f"/moov/trak/mdia/minf/stbl/{name}"][0] + at
        broken[a : a + 4] = b"\xff\xff\xff\xf0"
        assert mc.probe(bytes(broken)) == mc.EMPTY, name
    a = boxes(bytes(data))["/moov/trak/mdia/minf/stbl/stsc"][0] + 12
    many = bytes(data[:a]) + b"\x7f\xff\xff\xff" + bytes(data[a + 4 :])
    assert mc.probe(many)["payload"] in (mc.pad(b"x" * 300), None)


def test_samples_that_overlap_are_bounded_by_the_file():
    """A size table may claim the same bytes many times: 2,000 samples of 20 kB each in a file of 30 kB."""
    data = bytearray(mc.mux(mc.pad(b"x" * 64 * 2000)))
    a = boxes(bytes(data))["/moov/trak/mdia/minf/stbl/stsz"][0]
    n = int.from_bytes(data[a + 8 : a + 12], "big")
    table = (20_000).to_bytes(4, "big") * n
    whole = bytes(data[: a + 4]) + b"\0\0\0\0" + bytes(data[a + 8 : a + 12]) + table + bytes(data[a + 12 :])
    stsz = bytearray(whole)
    # every box around the table grows by it
    for path in ("/moov", "/moov/trak", "/moov/trak/mdia", "/moov/trak/mdia/minf", "/moov/trak/mdia/minf/stbl", "/moov/trak/mdia/minf/stbl/stsz"):
        at = boxes(bytes(data))[path][0] - 8
        stsz[at : at + 4] = (int.from_bytes(stsz[at : at + 4], "big") + len(table)).to_bytes(4, "big")
    assert mc.probe(bytes(stsz)) == mc.EMPTY


def test_query_columns(spark, edges, tmp_path):
    edges.write.parquet(str(tmp_path / "documents.parquet"))
    rows = op7_media(spark, str(tmp_path)).collect()
    texts = [r["text"] for r in edges.collect()]
    want = sorted((len(t), hashlib.sha256(mc.pad(t)).hexdigest(), zlib.crc32(mc.pad(t)[-64:])) for t in ((x or "").encode() for x in texts))
    assert sorted((r["n_bytes"], r["payload_sha256"], r["tail_crc32"]) for r in rows) == want
    assert len({r["media_sha256"] for r in rows if r["n_bytes"] == 0}) == 1
