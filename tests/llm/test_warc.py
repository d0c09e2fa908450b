import hashlib
from collections import Counter

import pytest
import zstandard

from scenemill.llm.files import open_file
from scenemill.llm.warc import Archive, read_archives, read_record, warc_round_trip, write_archives

SCHEMA = "page_id long, url string, html string"


def rows():
    big = "<p>" + "é" * 600 + "</p>"
    return [
        (1, "http://a/1", big), (2, "http://a/2", big), (3, None, big), (4, "http://a/4", "small"), (5, "http://a/5", "small"), (6, "bad\r\nurl: x", None),
        (7, "", ""), (8, "http://a/8", "x" * 999), (9, "http://a/9", "x" * 999), (10, "http://a/10", "y" * 1000), (10, "http://a/10", "y" * 1000),
        (11, "http://a/11", "y" * 1000), (12, "http://a/12", "z" * 5000), (12, "http://a/12", "z" * 5000), (12, "http://b", "w\r\n\r\nw" * 400),
        (None, "http://n", "n" * 2000), (None, "http://n", "v" * 20), (13, "http://long", "0123456789" * 400000),
    ]


def brute(pages):
    groups = {}
    for i, _, html in pages:
        groups.setdefault((html or "").encode(), []).append(i)
    out, responses = [], set()
    for i, _, html in pages:
        data = (html or "").encode()
        ids = [x for x in groups[data] if x is not None]
        largest = max(ids) if ids else None
        response = len(data) < 1000 or (i == largest and data not in responses)
        if i == largest:
            responses.add(data)
        out.append((i, len(data), hashlib.sha1(data).hexdigest(), "response" if response else "revisit", None if response else largest))
    return Counter(out)


def frame(spark, data):
    from pyspark.sql import functions as F

    return spark.createDataFrame(data, SCHEMA).repartition(2).withColumns({c: F.lit(1) for c in ("id", "sha1", "copy", "bytes", "path", "revisit")})


def test_awkward_rows(spark):
    got = warc_round_trip(frame(spark, rows())).collect()
    assert Counter(tuple(r)[:5] for r in got) == brute(rows())
    assert len({r.record_id for r in got}) == len(got)


def test_records_by_index(spark):
    index = write_archives(frame(spark, rows()), frame_bytes=3000).collect()
    assert len(index) == len(rows()) and len({(r.path, r.frame) for r in index}) > 4
    ids = set()
    for r in index:
        headers, http, payload = read_record(r.path, r.frame, r.offset)
        assert headers["WARC-Record-ID"] == r.record_id
        ids.add(r.record_id)
        if headers["WARC-Type"] == "response":
            assert len(payload) == int(http["Content-Length"])
    for r in index:
        headers, _, _ = read_record(r.path, r.frame, r.offset)
        assert headers.get("WARC-Refers-To", r.record_id) in ids


def test_any_zstandard_reader_reads_the_file(spark):
    index = write_archives(frame(spark, rows()), frame_bytes=3000).collect()
    for path in {r.path for r in index}:
        with open_file(path) as file:
            whole = b"".join(Archive(file).frame(k) for k in range(len(Archive(file))))
            file.seek(0)
            stream = zstandard.ZstdDecompressor().stream_reader(file.read(), read_across_frames=True)
            assert stream.read() == whole


def test_damage_is_noticed(spark):
    index = write_archives(frame(spark, rows()[:4]))
    path = index.first().path
    with open(path.removeprefix("file:"), "r+b") as file:
        file.seek(40)
        byte = file.read(1)[0]
        file.seek(40)
        file.write(bytes([byte ^ 255]))
    with pytest.raises(Exception):
        read_archives(index.select("path").distinct()).collect()


def test_empty_table(spark):
    assert warc_round_trip(spark.createDataFrame([], SCHEMA)).collect() == []
