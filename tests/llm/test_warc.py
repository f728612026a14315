"""WARC derivatives: links, headers and digests hold, whatever the response."""

import hashlib

from llm.sql import connect

from sparkwalk.llm import html, queries, warc

FOLDER = "/root/testdata/sf0.001"


def sha(data):
    return "sha256:" + hashlib.sha256(data).hexdigest()


def fields(block):
    return [tuple(line.split(": ", 1)) for line in block.decode().split("\r\n") if line]


def test_query_over_all_pages(spark):
    pages = {k: (u, h) for k, u, h in connect(FOLDER).sql("select page_id, url, html from pages").fetchall()}
    rows = queries.op2_warc(spark, FOLDER).collect()
    assert len(rows) == 2 * len(pages) == 2 * len({r.page_id for r in rows}) == len({r.record_id for r in rows})
    for r in rows:
        uri, page = pages[r.page_id]
        assert r.target_uri == uri and r.refers_to != r.record_id
        if r.warc_type == "conversion":
            text = html.plain_text(page).encode()
            assert (r.block_digest, r.n_bytes) == (sha(text), len(text))


def test_records_are_linked(spark):
    block = b"HTTP/1.1 404 Not Found\r\nContent-Type: text/html; charset=latin-1\r\nX-A: 1\r\n  folded\r\nx-a: 2\r\n\r\n<p>caf\xe9</p><script>no</script>"
    rows = [
        (1, "response", "<urn:uuid:1>", "http://a/\r\nEvil: 1", "2020-01-01T00:00:00Z", block, "x"),
        (2, "response", "<urn:uuid:2>", None, None, None, "x"), (3, "request", "<urn:uuid:3>", "u", "d", b"", "x"), (4, "response", None, "u", "d", b"", "x"),
        (None, "response", "<urn:uuid:5>", "u", "d", b"HTTP/1.1 200 OK\r\nContent-Type: text/plain\r\n\r\n\xff raw", "x"),
    ]
    frame = spark.createDataFrame(rows, "page_id long, warc_type string, record_id string, target_uri string, warc_date string, block binary, record string")
    made = {(r.page_id, r.warc_type): (r, *warc.parse(bytes(r.record))) for r in warc.build(frame).collect()}
    assert set(made) == {(k, t) for k in (1, 2, None) for t in ("metadata", "conversion")}
    row, head, text = made[1, "conversion"]
    assert text.decode() == "café" and head["WARC-Refers-To"] == "<urn:uuid:1>" == row.refers_to and "Evil" not in head
    assert head["WARC-Block-Digest"] == sha(text) and head["WARC-Date"] == "2020-01-01T00:00:00Z"
    told = fields(made[1, "metadata"][2])
    assert [v for n, v in told if n == "source-header"] == ["Content-Type: text/html; charset=latin-1", "X-A: 1 folded", "x-a: 2"]
    assert dict(told)["conversion-record-id"] == head["WARC-Record-ID"] and dict(told)["source-status"] == "HTTP/1.1 404 Not Found"
    assert dict(told)["source-block-digest"] == sha(block) and dict(told)["source-payload-digest"] == sha(block.split(b"\r\n\r\n", 1)[1])
    assert made[2, "conversion"][2] == b"" and "WARC-Target-URI" not in made[2, "conversion"][1]
    assert made[None, "conversion"][2].decode() == "� raw"
    again = {(r.page_id, r.warc_type): r.record for r in warc.build(frame.unionAll(frame)).collect()}
    assert again == {k: v[0].record for k, v in made.items()} and warc.build(frame.limit(0)).count() == 0
