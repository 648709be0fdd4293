import base64
import gzip
import hashlib
import random

import pytest

from veilframe.llm import warc

SCHEMA = "page_id bigint, url string, html string"


def brute(rows):
    top = {}
    for i, _, h in rows:
        top[h or ""] = max(top.get(h or "", -1), -1 if i is None else i)
    out = []
    for i, _, h in rows:
        data = (h or "").encode()
        first = top[h or ""]
        same = i == first or first == -1          # no row of this payload has an id
        out.append((i, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(),
                    "response" if same else "revisit", None if same else first))
    return sorted(out, key=repr)


def test_round_trip(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "RECORDS_PER_ARCHIVE", 7)
    rows = [(i, f"http://x.example/{i} a\nb", f"<p>{i % 23}</p>\r\n\r\n\x00É" * (i % 5)) for i in range(60)]
    rows += [(100, None, None), (101, "u", ""), (102, "u", "WARC/1.0\r\n\r\n"), (None, None, "alone"),
             (103, "u", "z" * 300_000)]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("digest", warc.F.lit("clash"))
    got = warc.round_trip(df, f"file://{tmp_path}/a").collect()
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got),
                  key=repr) == sorted(brute(rows), key=repr)
    want = [x for x in brute(rows) if x[0] is not None]
    mine = sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got
                   if r.page_id is not None), key=repr)
    assert mine == want and all(r.indexed for r in got) and len(got) == len(rows)
    streams = list((tmp_path / "a" / "streams").glob("*/*.gz"))
    assert len(streams) >= 9
    for path in (tmp_path / "a" / "members").glob("archive=*/kind=warc/*.txt"):
        data = path.read_bytes()
        index = [line.split("\t") for line in
                 next((path.parent.parent / "kind=index").glob("*.txt")).read_text().rstrip("\x00").splitlines()]
        for offset, length, kind, urn in index:
            record = gzip.decompress(data[int(offset):int(offset) + int(length)])
            assert record.startswith(b"WARC/1.0\r\nWARC-Type: " + kind.encode()) and urn.encode() in record
            assert record.endswith(b"\r\n\r\n")


def test_streams():
    records = [b"WARC/1.0\r\nContent-Length: %d\r\n\r\n" % len(b) + b + b"\r\n\r\n"
               for b in (b"", b"a\r\n\r\nb", b"x" * 200_000)]
    whole = b"".join(records)
    for step in (1 << 16, 997):
        assert list(warc.split_stream(whole[i:i + step] for i in range(0, len(whole), step))) == records
    split = b"".join(map(gzip.compress, records))
    assert [c for _, _, c in warc.members(split + gzip.compress(b""))] == records
    with pytest.raises(ValueError):
        list(warc.members(split[:-9]))
    for broken in (whole[:-9], whole[:len(whole) // 2], records[1][:-1]):
        with pytest.raises(ValueError):
            list(warc.split_stream(iter([broken])))


def record(kind, number, block):
    return (f"WARC/1.0\r\nWARC-Type: {kind}\r\nWARC-Record-ID: <urn:{number}>\r\n"
            f"Content-Length: {len(block)}\r\n\r\n").encode() + block + b"\r\n\r\n"


@pytest.mark.parametrize("members", [False, True])
def test_foreign_streams_of_any_size(spark, tmp_path, members):
    """Bytes that are no UTF-8, empty blocks, ends of records inside blocks, one stream or one with a
    member per record: the records come out as they are, in archives of bounded size."""
    rng = random.Random(4)
    blocks = [rng.randbytes(rng.choice([0, 5, 20_000])) + rng.choice([b"", b"\r\n\r\n", b"\r\n\r\n\r\n\r\nz"])
              for _ in range(60)] + [rng.randbytes(300_000), b"\r\n", b"\x00\xff\r"]
    want = [record("resource", i, b) for i, b in enumerate(blocks)]
    (tmp_path / "in").mkdir()
    data = b"".join(map(gzip.compress, want)) if members else gzip.compress(b"".join(want))
    (tmp_path / "in" / "crawl.warc.gz").write_bytes(data)
    warc.normalise(spark, f"file://{tmp_path}/in", f"file://{tmp_path}/out", 50_000)
    got, archives = [], sorted((tmp_path / "out").glob("archive=*"))
    for archive in archives:
        content = next((archive / "kind=warc").glob("*.txt")).read_bytes()
        parts = [part for _, _, part in warc.members(content)]
        assert b"WARC-Type: warcinfo" in parts[0] and len(content) < 50_000 + 310_000
        got += parts[1:]
    assert got == want and len(archives) > 5


def test_cut_off_stream_fails(spark, tmp_path):
    (tmp_path / "in").mkdir()
    whole = gzip.compress(record("resource", 1, random.Random(1).randbytes(100_000)))
    (tmp_path / "in" / "a.warc.gz").write_bytes(whole[:50_000])
    with pytest.raises(Exception, match="EOF|end of input|Unexpected end|does not end|inside a record"):
        warc.normalise(spark, f"file://{tmp_path}/in", f"file://{tmp_path}/out")


def test_large_pages_go_to_streams_of_fewer_records(spark, tmp_path, monkeypatch):
    """No stream of several records is above RECORDS_PER_ARCHIVE pages of SMALL_PAGE bytes."""
    monkeypatch.setattr(warc, "RECORDS_PER_ARCHIVE", 32)
    monkeypatch.setattr(warc, "SMALL_PAGE", 100)
    rows = [(i, "u", chr(97 + i % 26) * n + str(i)) for i, n in enumerate([5, 90, 1_000, 1_500, 20_000, 60_000] * 12)]
    df = spark.createDataFrame(rows, SCHEMA).coalesce(1)
    got = warc.round_trip(df, f"file://{tmp_path}/a").collect()
    assert sorted((r.page_id, r.payload_bytes) for r in got) == [(i, len(h)) for i, _, h in rows]
    counts = {}
    for path in (tmp_path / "a" / "streams").glob("*/*.gz"):
        held = gzip.decompress(path.read_bytes()).count(b"WARC-Type: ")
        counts.setdefault(path.parent.name, []).append(held)
    assert {k: max(v) for k, v in counts.items()} == {"size=0": 24, "size=1": 2, "size=2": 1, "size=3": 1}


def test_nothing(spark, tmp_path):
    assert warc.round_trip(spark.createDataFrame([], SCHEMA), f"file://{tmp_path}/b").count() == 0
