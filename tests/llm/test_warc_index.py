"""Records, files and look-ups."""

import hashlib

import pytest

from snapweave.llm import warc_index as W


def test_url_keys():
    assert W.url_key("http://www.Example.com:80/a/b?q=1") == "com,example,www)/a/b?q=1"
    assert W.url_key("https://example.com") == "com,example)/"
    assert W.url_key("http://[bad/") == ")http://[bad/"
    assert W.url_key("http://[bad\tx y") == ")http://[bad%09x%20y"
    assert W.url_key("http://a.com/x 5\x01z\x7f") == "com,a)/x%205%01z%7F"


def test_record_round_trip():
    payload = "héllo\r\n\r\nWARC/1.1".encode()
    digest = hashlib.sha1(payload).hexdigest()
    r = W.parse(W.unpacked(W.packed(W.record("7", "http://x/\r\ny", payload, digest, None))))
    assert r.payload == payload and r.headers["WARC-Type"] == "response"
    assert r.headers["WARC-Target-URI"] == "http://x/%0D%0Ay"
    r = W.parse(W.record("7", "http://x/", payload, digest, "9"))
    assert r.payload == b"" and r.http["Content-Length"] == str(len(payload))
    assert r.headers["WARC-Refers-To"] == "<urn:page:9>"


def test_look_ups_read_few_blocks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(W, "BLOCK_LINES", 20)
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    archive = W.write_archive(pages, f"file://{tmp_path}/archive")
    lines = {r["id"]: r["key"] for r in archive.lines.collect()}
    assert len(lines) == pages.count()
    directory = archive.directory.collect()
    assert len(directory) >= len(lines) // 20
    wanted = spark.createDataFrame([(lines[3],), (lines[57],), ("com,nowhere)/ 1",), ("",), ("zzz",)], "key string")
    found = W.look_ups(archive, wanted).collect()
    assert {r["headers_id"] for r in found} == {"<urn:page:3>", "<urn:page:57>"}
    html = {r.page_id: r.html.encode() for r in pages.collect()}
    for r in found:
        body = html[int(r["headers_id"][10:-1])]
        assert r["payload_bytes"] == len(body) and r["payload_digest"] == hashlib.sha1(body).hexdigest() and r["intact"]


@pytest.mark.parametrize("lines", [1, 2, 3])
def test_keys_that_span_blocks(spark, tmp_path, monkeypatch, lines):
    monkeypatch.setattr(W, "BLOCK_LINES", lines)
    pages = spark.createDataFrame([(1, "http://a/", f"<p>{i}</p>") for i in range(10)] + [(2, "http://b/", "x")],
                                  "page_id long, url string, html string").coalesce(1)
    archive = W.write_archive(pages, f"file://{tmp_path}/archive")
    assert W.read_all(archive).count() == 11


ODD = ["http://a.com/x", "http://a.com/x 5\x01z", "http://b.com/", "http://[bad\tx", "http://[bad", "http://a.com/x\x01", "http://a.com/x\t",
       "http://a.com/x\x00y", " http://a.com/ ", "\t", "\x7f", "http://a.com/x!", "http://a.com/\r\nWARC-Type: x", "", None, "http://a b.com/",
       "http://a.com/\u2028\x85é", "http://user:p w@a.com:99999/", "http://a.com:bad/", "http://\x01\x02/", "a\x1fb"]


@pytest.mark.parametrize("lines, parts", [(1, 1), (2, 3), (3000, 1)])
def test_odd_urls_lose_no_record(spark, tmp_path, monkeypatch, lines, parts):
    monkeypatch.setattr(W, "BLOCK_LINES", lines)
    rows = [(i, u, f"<p>{i}</p>") for i, u in enumerate(ODD * 2)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(parts)
    archive = W.write_archive(pages, f"file://{tmp_path}/archive")
    found = W.read_all(archive).collect()
    assert sorted(int(r["headers_id"][10:-1]) for r in found) == list(range(len(rows)))
    for r in found:
        body = rows[int(r["headers_id"][10:-1])][2].encode()
        assert r["intact"] and r["payload_digest"] == hashlib.sha1(body).hexdigest() and r["payload_bytes"] == len(body)


def test_a_lost_record_is_an_error(spark, tmp_path):
    pages = spark.createDataFrame([(i, f"http://a/{i}", "x") for i in range(5)], "page_id long, url string, html string")
    archive = W.write_archive(pages, f"file://{tmp_path}/archive")
    more = W.Archive(archive.lines.unionByName(archive.lines.limit(1)), archive.directory)
    with pytest.raises(RuntimeError, match="6 records were written and 5 read back"):
        W.read_all(more)
