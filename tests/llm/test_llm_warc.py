import base64
import gzip
import hashlib
import io

import pyarrow.fs as pafs
import pytest

from reviewloom.llm import warc
from reviewloom.session import file_system

ROWS = [
    (5, "http://a.example.com/x?y", "<p>same</p>"), (3, "http://A.example.com/x?y", "<p>same</p>"), (9, "http://b.org", "<p>same</p>"),
    (1, None, None), (2, "no scheme", ""), (4, "http://c.org/\r\nX: y", "WARC/1.1\r\n\r\n\r\n\r\nWARC/1.1\r\n"), (6, "http://é.org/ü", "é" * 5000),
    (7, "http://long.org/", "x" * 3_000_000), (None, "http://null.org/", "<p>same</p>"), (None, "http://null.org/", "alone"), (8, "http://d.org/", "twice"),
    (8, "http://d.org/", "twice"), (8, "http://d.org/", "other"),
]


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "f") for r in rows], "page_id long, url string, html string, offset int, file string")


def brute(rows, least):
    out = []
    for page, _, page_html in rows:
        payload = (page_html or "").encode()
        same = [p for p, _, h in rows if (h or "") == (page_html or "") and p is not None]
        again = len(payload) >= least and bool(same) and page != min(same)
        digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
        out.append((str(page), len(payload), digest, "revisit" if again else "response", min(same) if again else None))
    return sorted(out, key=str)


@pytest.mark.parametrize("least", [0, 6, 100])
def test_round_trip_equals_brute_force(spark, least):
    got = warc.archive_round_trip(frame(spark, ROWS).repartition(3), least).collect()
    assert sorted(((str(r.page_id), r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got), key=str) == brute(ROWS, least)


def test_payloads_come_back_and_archives_are_plain_warc(spark):
    captures = warc.write_archives(frame(spark, ROWS))
    places = captures.collect()
    payloads = {r.page_id: bytes(r.payload) for r in warc.read_records(captures).collect() if r.payload is not None}
    assert payloads[7] == b"x" * 3_000_000 and payloads[6] == "é".encode() * 5000 and payloads[4] == ROWS[5][2].encode()
    n = 0
    for file in {p.file for p in places}:
        fs, path = file_system(file)
        data = gzip.decompress(fs.open_input_stream(path, compression=None).read())
        at = io.BytesIO(data)
        while line := at.readline():
            assert line == b"WARC/1.1\r\n"
            fields = {}
            while (line := at.readline()) != b"\r\n":
                name, value = line.decode().rstrip("\r\n").split(": ", 1)
                fields[name] = value
            at.read(int(fields["Content-Length"]))
            assert at.read(4) == b"\r\n\r\n" and fields["WARC-Type"] in ("response", "revisit")
            n += 1
    assert n == len(ROWS)


def test_lookup_over_many_blocks_and_shards(spark):
    rows = [(i, f"http://h{i % 7}.example.{'com' if i % 2 else 'org'}/p/{i % 50}", f"page {i}") for i in range(600)]
    captures = warc.write_archives(frame(spark, rows), archive_bytes=2000)
    assert captures.select("file").distinct().count() > 5
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        index = warc.build_index(captures, block_entries=7)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(index.shards) > 1
    asked = spark.createDataFrame([(i, rows[i][1]) for i in range(0, 600, 3)] + [(3, rows[3][1]), (1, "http://h9.example.org/"), (9999, rows[0][1]), (None, rows[0][1])], "page_id long, url string")
    found = warc.lookup(index, asked).collect()
    assert sorted(r.page_id for r in found) == list(range(0, 600, 3))
    some = {r.page_id: r.payload for r in warc.read_records(spark.createDataFrame(found)).collect()}
    assert all(bytes(some[i]) == f"page {i}".encode() for i in some)


def test_damage_is_noticed(spark):
    captures = warc.write_archives(frame(spark, [(1, "http://a.org/", "text")]))
    place = captures.first()
    fs = pafs.LocalFileSystem()
    with fs.open_input_file(place.file) as f:
        member = f.read()
    plain = gzip.decompress(member).replace(b"\r\n\r\ntext", b"\r\n\r\ntexT")
    with pytest.raises(ValueError):
        warc.parse_record(gzip.compress(plain))


def test_empty_table(spark):
    assert warc.archive_round_trip(frame(spark, [])).collect() == []


def test_keys(spark):
    df = spark.createDataFrame([("http://www.Example.com/a?b",), (None,), ("x.org",), ("http://a.b/c.d/e",)], "url string")
    keys = [r[0] for r in df.select(warc.reversed_host_key(df.url)).collect()]
    assert keys == ["com,example,www)/a?b", ")", "org,x)", "b,a)/c.d/e"]
