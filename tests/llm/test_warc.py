import base64
import hashlib
from collections import Counter

import pytest

from dialoom.llm.warc import ArchiveError, leading_frame, make_record, parse_record, plan_records, read_archives, read_frames, write_archives

KINDS = "page_id long, url string, html string, _id string, file string"
PAGES = [
    (5, "http://a/é ü\r\nx", "<p>same</p>", "x", "y"),
    (3, None, "<p>same</p>", "x", "y"),
    (9, "http://b/", "<p>same</p>", None, None),
    (9, "http://b/", "<p>same</p>", None, None),
    (1, "http://c/", None, "x", "y"),
    (2, "http://d/", "", "x", "y"),
    (7, "http://e/", "short", "x", "y"),
    (8, "http://e/", "long " * 100_000, "x", "y"),
    (None, "http://f/", "no id", "x", "y"),
    (None, None, None, None, None),
]


def sha(data):
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def expected(pages, least):
    first = {}
    for page, html in pages:
        if page is not None:
            first[html or ""] = min(page, first.get(html or "", page))
    out = Counter()
    for page, html in pages:
        data = (html or "").encode()
        revisit = len(data) >= least and first.get(html or "", page) != page
        out[page, len(data), sha(data), "revisit" if revisit else "response", first[html or ""] if revisit else None] += 1
    return out


def result(spark, pages, **options):
    folder, manifest = write_archives(pages, **options)
    rows = read_archives(spark, folder, manifest).collect()
    number = lambda x: None if x is None else int(x)
    return Counter((number(r.page), r.payload_bytes, r.payload_digest, r.record_type, number(r.refers_to)) for r in rows)


@pytest.mark.parametrize("least", [0, 6, 1000])
def test_odd_pages(spark, least):
    pages = spark.createDataFrame(PAGES, KINDS).repartition(3)
    # a page without an id never refers to one whose payload is equal only if none has an id
    got, want = result(spark, pages, revisit_bytes=least, archive_bytes=2000), expected([(p[0], p[2]) for p in PAGES], least)
    assert got == want


def test_table_and_payloads(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    rows = pages.union(pages.selectExpr("page_id + 1000000", "url", "html").limit(20))
    assert result(spark, rows) == expected([(r.page_id, r.html) for r in rows.collect()], 0)
    folder, manifest = write_archives(rows)
    back = {int(r.page): r.payload.decode() for r in read_archives(spark, folder, manifest, payloads=True).collect() if r.payload is not None}
    assert back == {r.page_id: r.html for r in pages.collect()}


@pytest.mark.parametrize("least", [0, 6])
def test_many_groups(spark, least):
    """Beyond ``few`` groups those with many copies are kept out of the shuffle; the plan's rows are the same."""
    copies = [(100 + k, "u", ("", None, "<p>same</p>", f"pair {k // 2}", f"one {k}")[k % 5]) for k in range(300)]
    pages = spark.createDataFrame([p[:3] for p in PAGES] + copies + copies[:20], "page_id long, url string, html string").repartition(4)
    plan = lambda few: Counter(map(tuple, plan_records(pages, least, "page_id", "url", "html", few).collect()))
    want = plan(10**6)
    assert sum(want.values()) == pages.count()
    for few in (0, 1, 3, 10):
        assert plan(few) == want


def test_empty(spark):
    assert result(spark, spark.createDataFrame([], KINDS)) == Counter()


def test_uncommitted_files_are_left_out(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    folder, manifest = write_archives(pages)
    write_archives(pages, root=folder)  # as from an attempt that was lost
    assert read_archives(spark, folder, manifest).count() == pages.count()


def broken(change):
    import zstandard

    good = make_record(1, "http://x/", b"payload", None, False, "2000-01-01T00:00:00Z")
    dictionary = b"some bytes that are no trained dictionary, but content"
    coder = zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(dictionary))
    data = leading_frame(dictionary) + coder.compress(change(good)) + coder.compress(good)
    return [parse_record(r) for r in read_frames(data)]


def test_checks():
    assert [r[3] for r in broken(lambda r: r)] == [b"payload"] * 2
    for change in (
        lambda r: r.replace(b"payload", b"payLoad"),
        lambda r: r.replace(b"WARC/1.1", b"WARC/9"),
        lambda r: r.replace(b"WARC-Date", b"X-Date"),
        lambda r: r[:-1],
        lambda r: r + b"x",
        lambda r: r.replace(b"Content-Length: 7", b"Content-Length: 6"),
        lambda r: r.replace(b"WARC-Type: ", b"WARC-Type "),
    ):
        with pytest.raises(ArchiveError):
            broken(change)
    with pytest.raises(ArchiveError):
        list(read_frames(b"no archive at all"))
