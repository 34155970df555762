import hashlib
import random

from conftest import SMALL
from tidemark.llm import warc
from tidemark.session import work_folder

SCHEMA = "page_id long, url string, html string, digest string, path string"


def trip(spark, rows, block_bytes=300, archive_bytes=1 << 30):
    pages = spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA).coalesce(2)
    manifest = warc.write_archives(pages, archive_bytes=archive_bytes)
    return manifest, warc.read_archives(manifest, block_bytes).collect()


def test_payloads_that_look_like_records(spark):
    inner = "WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 5\r\n\r\nabcde\r\n\r\n" * 6
    same, long = "s" * 1000, "l" * 999
    rows = [
        (1, "http://a/\r\nX: y", inner), (2, None, None), (3, "u", ""), (4, "u", same), (9, "u", same), (6, "u", same), (7, "u", long), (8, "u", long),
        (10, "ü", "é" * 500), (11, "u", "é" * 500), (None, "u", same), (12, "u", "x" * 40_000),
    ]
    for block_bytes, archive_bytes in ((64, 1 << 30), (1 << 23, 1 << 30), (500, 2000)):
        manifest, found = trip(spark, rows, block_bytes, archive_bytes)
        assert sum(r.records for r in manifest.collect()) == len(rows) == len(found)
        by_id = {r.page_id: r for r in found}
        for page_id, _, html in rows:
            payload = (html or "").encode()
            assert by_id[page_id].payload_bytes == len(payload)
            assert by_id[page_id].payload_digest == hashlib.sha1(payload).hexdigest()
        assert {i: (r.record_type, r.refers_to) for i, r in by_id.items() if r.record_type != "response"} == {
            4: ("revisit", 9), 6: ("revisit", 9), None: ("revisit", 9), 10: ("revisit", 11)
        }
        assert by_id[2].url is None and by_id[10].url == "ü" and by_id[1].url == "http://a/%0D%0AX:%20y"


def test_repeated_rows_and_truncated_file(spark, tmp_path):
    manifest, found = trip(spark, [(5, "u", "z" * 2000)] * 2)
    assert [r.record_type for r in found] == ["response"] * 2
    path = tmp_path / "cut.warc"
    one = warc._record(1, "u", b"abc", "d", None)
    path.write_bytes(one + one[:-40])
    cut = spark.createDataFrame([(str(path), path.stat().st_size)], "path string, bytes long")
    assert [r.page_id for r in warc.read_archives(cut, 16).collect()] == [1]


def test_records_before_a_break_are_read(spark, tmp_path):
    records = [warc._record(i, "u", b"abc" * i, "d", None) for i in range(6)]
    files = {"cut": (*records[:5], records[5][:-40]), "damaged": (*records[:3], b"?" * 99, *records[3:]), "whole": records}
    for name, parts in files.items():
        (tmp_path / name).write_bytes(b"".join(parts))
    paths = [(str(tmp_path / name), (tmp_path / name).stat().st_size) for name in files]
    manifest = spark.createDataFrame(paths, "path string, bytes long")
    for frame in (warc.read_archives(manifest), warc.read_archives(manifest, 400)):
        found = sorted((r.path.rpartition("/")[2], r.page_id) for r in frame.collect())
        assert found == [("cut", i) for i in range(5)] + [("damaged", i) for i in range(3)] + [("whole", i) for i in range(6)]


def test_headers_of_any_length(spark):
    urls = ["http://a/", "data:," + "x" * 200_000, "http://b/", "http://c/?q=" + " " * 30_000, "u", "http://d/" + "y" * 4_100]
    rows = [(i, url, f"page {i}") for i, url in enumerate(urls)]
    for block_bytes in (300, 1 << 23):
        found = {r.page_id: r for r in trip(spark, rows, block_bytes)[1]}
        assert {i: r.url for i, r in found.items()} == {i: url.replace(" ", "%20") for i, url, _ in rows}
        assert {i: r.payload_digest for i, r in found.items()} == {i: hashlib.sha1(html.encode()).hexdigest() for i, _, html in rows}


def test_nothing(spark):
    assert trip(spark, [])[1] == []


def test_given_pages(spark):
    pages = spark.read.parquet(f"{SMALL}/pages.parquet")
    folder = work_folder(spark, "archive")
    found = {r.page_id: r.payload_digest for r in warc.read_archives(warc.write_archives(pages, folder), 4096).collect()}
    assert found == {r.page_id: hashlib.sha1((r.html or "").encode()).hexdigest() for r in pages.collect()}


def test_any_header_values_in_payloads(spark):
    """What reads like a record but for its length, among ordinary pages."""
    rng = random.Random(9)
    lengths = ["²", "٣", "-5", "+5", "5 5", "", "9" * 5000, "1" * 18, "0x10", " 7", "7\t", "1e3", "５"]
    rows = []
    for i, length in enumerate(lengths * 3):
        more = "".join(rng.choice("ab:\r\n \x00é") for _ in range(rng.randrange(60)))
        rows.append((i, "http://a/", f"before WARC/1.1\r\nWARC-Type: response\r\n{more}\r\nContent-Length: {length}\r\n\r\nabc\r\n\r\n" * rng.randint(1, 3)))
    for block_bytes in (100, 1 << 23):
        _, found = trip(spark, rows, block_bytes)
        digests = {r.page_id: r.payload_digest for r in found}
        assert digests == {i: hashlib.sha1(html.encode()).hexdigest() for i, _, html in rows}
