"""WARC: round trips of cut payloads, revisits, broken archives."""

import base64
import hashlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from cityflux.llm import warc
from cityflux.plans.scratch import fresh_path

PAGES = "page_id long, url string, html string, record string, chunk string, text string, payload_digest string"
TEXT = "é\r\n\r\nWARC/1.1\r\n" * 50


def base32(text):
    return base64.b32encode(hashlib.sha1(text.encode()).digest()).decode()


def given_pages(spark, rows):
    return spark.createDataFrame([(*r, "a", "b", "c", "d") for r in rows], PAGES).repartition(3)


@pytest.fixture(scope="module")
def rows():
    return [
        (1, "http://a/\r\nX: y", "x" * 100), (2, None, "x" * 100), (None, "u", "x" * 100), (3, "u", None), (4, "u", ""), (5, "u", TEXT), (5, "u", TEXT),
        (6, "u", "\n"), (7, "u", "a\r"), (8, "u", "\r\n\r\n"), (9, "u", "日本" * 40), (None, "u", "q"), (10, "u", "z" * 300_000), (11, "u", "\r\n" * 999 + "\r"),
    ]


def by_hand(rows, least=0):
    out = []
    for i, (page, _, html) in enumerate(rows):
        text = html or ""
        same = sorted((q is None, q or 0, j) for j, (q, _, other) in enumerate(rows) if (other or "") == text)
        first = same[0] if len(text.encode()) >= least else (page is None, page or 0, i)
        out.append((page, len(text.encode()), base32(text), *(("response", None) if first[2] == i else ("revisit", None if first[0] else first[1]))))
    return sorted(out, key=str)


@pytest.mark.parametrize("chunk", [7, 30, 1_000_000])
def test_round_trip(spark, rows, chunk):
    got = warc.archive(given_pages(spark, rows), chunk=chunk).collect()
    assert sorted((tuple(r) for r in got), key=str) == by_hand(rows)


def test_small_payloads_are_never_revisits(spark, rows):
    got = warc.archive(given_pages(spark, rows), least=101).collect()
    assert sorted((tuple(r) for r in got), key=str) == by_hand(rows, 101)


def test_payloads_come_back_whole(spark, rows):
    path = fresh_path(spark, "archives")
    warc.write_archives(given_pages(spark, rows), path, chunk=40)
    back = warc.read_archives(spark, path, most=16).filter("type <> 'revisit'").orderBy("record", "segment", "chunk").collect()
    texts = {}
    for r in back:
        assert len(r["data"]) <= 16
        texts[r["record"]] = texts.get(r["record"], b"") + r["data"]
    assert sorted(t.decode() for t in texts.values()) == sorted({html or "" for *_, html in rows})


def test_empty(spark):
    assert warc.archive(given_pages(spark, [])).count() == 0


def test_broken_archive(spark):
    path = fresh_path(spark, "broken")
    spark.createDataFrame([("WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:x>\r\nContent-Length: 900\r\n\r\nshort",)], "value string").coalesce(1).write.option("compression", "gzip").text(path)
    with pytest.raises(Exception, match="ends within a record"):
        warc.read_archives(spark, path).collect()


@settings(max_examples=60, deadline=None)
@given(st.lists(st.binary(max_size=40), max_size=5), st.lists(st.integers(1, 30), min_size=1, max_size=40), st.integers(1, 50))
def test_stream_in_any_pieces(payloads, cuts, most):
    data = b"".join(
        b"WARC/1.0\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:%d>\r\nContent-Length: %d\r\n\r\n%s\r\n\r\n" % (k, len(p), p) for k, p in enumerate(payloads)
    )
    stream, got, at, k = warc.Stream(True, most), [], 0, 0
    while at < len(data):
        got += stream.feed(data[at : at + cuts[k % len(cuts)]])
        at, k = at + cuts[k % len(cuts)], k + 1
    assert stream.state == "head" and not stream.held
    whole, digests = {}, {}
    for record, _, _, _, _, _, piece, size, digest in got:
        whole[record] = whole.get(record, b"") + piece
        digests[record] = digest
    assert whole == {f"<urn:{k}>": p for k, p in enumerate(payloads)}
    assert digests == {f"<urn:{k}>": base64.b32encode(hashlib.sha1(p).digest()).decode() for k, p in enumerate(payloads)}


def test_chunk_table_carries_digests(spark, rows):
    table = warc.chunk_table(given_pages(spark, rows), chunk=9).collect()
    done = {r["record"]: (r["payload_bytes"], r["payload_digest"]) for r in table if r["payload_digest"]}
    assert sorted(done.values()) == sorted((len((h or "").encode()), base32(h or "")) for *_, h in rows)
    assert all(len(r["text"]) <= 9 and (r["payload_digest"] is None) == (r["chunk"] + 1 < r["chunks"]) for r in table)
