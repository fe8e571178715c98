import hashlib

from veilspark.llm import warc as W


def test_records_link_to_their_response(spark, tmp_path):
    html = ('<html lang="de"><head><title>A &amp;amp; B</title><script>x<p></script></head><body><nav>menu</nav>'
            '<!-- no --><p>One   two<br>three &lt;b&gt;</p><img src=x><a href="/y">link</a></body></html>')
    pages = spark.createDataFrame([(1, "http://a/", html, "z"), (2, None, None, "z"), (3, "http://c/", "", "z"),
                                   (1, "http://a/", html, "z")], "page_id long, url string, html string, key string")
    resp = W.responses(pages)
    rows = W.derive(resp).collect()
    assert len(rows) == 8
    ids = {r["key"]: r["record_id"] for r in resp.collect()}
    for r in rows:
        assert r["refers_to"] == ids[r["key"]]
        assert r["content_length"] == len(r["block"].encode())
        assert r["block_digest"] == "sha256:" + hashlib.sha256(r["block"].encode()).hexdigest()
    one = {r["record_type"]: r for r in rows if r["key"] == 1}
    assert one["conversion"]["block"] == "One two\nthree <b>\nlink"
    meta = dict(x.split(": ", 1) for x in one["metadata"]["block"].strip("\r\n").split("\r\n"))
    assert meta == {"title": "A &amp; B", "language": "de", "http-status": "200",
                    "http-content-type": "text/html; charset=utf-8", "links": "1", "images": "1",
                    "text-length": str(len(one["conversion"]["block"]))}
    assert one["metadata"]["source_digest"] == "sha256:" + hashlib.sha256(html.encode()).hexdigest()
    W.write_warc(W.derive(resp).coalesce(1), str(tmp_path / "w"))
    part = next((tmp_path / "w").glob("part-*")).read_bytes()
    seen = 0
    while part:                                            # a reader needs only the header's length
        head, _, rest = part.partition(b"\r\n\r\n")
        fields = dict(x.split(b": ", 1) for x in head.split(b"\r\n")[1:])
        n = int(fields[b"Content-Length"])
        assert head.startswith(b"WARC/1.1") and fields[b"WARC-Refers-To"].startswith(b"<urn:uuid:")
        assert rest[n:n + 4] == b"\r\n\r\n"
        part = rest[n + 4:]
        seen += 1
    assert seen == 8


def test_empty_table(spark):
    none = spark.createDataFrame([], "page_id long, url string, html string")
    assert W.derive(W.responses(none)).count() == 0
