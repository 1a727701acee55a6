import base64
import hashlib
import html.parser

from transitrisk.llm import warc
from transitrisk.llm.common import table


class Plain(html.parser.HTMLParser):
    """Text by the standard parser: an independent reading of the page."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out, self.skip = [], 0

    def handle_starttag(self, tag, attrs):
        self.skip += tag in ("script", "style")

    def handle_endtag(self, tag):
        self.skip -= tag in ("script", "style")

    def handle_data(self, data):
        if not self.skip:
            self.out.append(data)


def letters(text):
    return "".join(text.split())


def test_text_holds_what_a_parser_sees(spark, sf_dir):
    for r in table(spark, sf_dir, "pages").collect():
        p = Plain()
        p.feed(r["html"])
        p.close()
        assert letters(warc.html_text(r["html"])) == letters("".join(p.out))


def test_records_link_and_digest(spark):
    pages = spark.createDataFrame([(1, "http://a/\r\nX: y", "<title>A &amp; B</title><p>one<br>two <b>x</b></p><a href='q'>l</a>", 1),
                                   (2, None, None, 1), (None, "http://b", "", 1), (1, "http://a/\r\nX: y", "other", 1)],
                                  "page_id long, url string, html string, record int")
    responses = warc.responses(pages).collect()
    records = warc.build_derivatives(pages).collect()
    assert len(responses) == 4 and len(records) == 8
    sources = {}
    for r in responses:
        headers, block = warc.parse_record(r["record"])
        assert headers["WARC-Type"] == "response" and "X" not in headers
        body = block.partition(b"\r\n\r\n")[2]
        assert headers["WARC-Payload-Digest"] == "sha1:" + base64.b32encode(hashlib.sha1(body).digest()).decode()
        sources.setdefault(headers["WARC-Record-ID"], []).append((headers, body))
    for r in records:
        headers, block = warc.parse_record(r["record"])
        assert headers["WARC-Type"] in ("metadata", "conversion")
        origin = [h for h, _ in sources[headers["WARC-Refers-To"]] if h["WARC-Payload-Digest"] == headers["WARC-Source-Payload-Digest"]]
        assert origin and headers["WARC-Target-URI"] == origin[0]["WARC-Target-URI"]
        assert headers["WARC-Block-Digest"] == warc.digest(block)
        if headers["WARC-Type"] == "metadata":
            assert f"source-payload-digest: {headers['WARC-Source-Payload-Digest']}".encode() in block
            assert b"http-header: HTTP/1.1 200 OK" in block
    meta, text = (warc.parse_record(x)[1].decode() for x in warc.derive(responses[0]["record"]))
    assert "title: A & B\r\n" in meta and "links: 1\r\n" in meta
    assert text == "A & B\none\ntwo x\nl"


def test_index_and_odd_records(spark):
    assert warc.derive(b"not a record") == [] and warc.derive(warc.build_record("request", "<x>", [], b"")) == []
    bad = spark.createDataFrame([(1, bytearray(b"junk")), (2, None)], "key long, record binary")
    assert warc.derivatives(bad).count() == 0
    empty = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.read_index(warc.build_derivatives(empty)).count() == 0
    one = spark.createDataFrame([(5, "http://a", "<p>t</p>")], "page_id long, url string, html string")
    rows = warc.read_index(warc.build_derivatives(one)).collect()
    assert {r["record_type"] for r in rows} == {"metadata", "conversion"} and all(r["digest_ok"] for r in rows)


def test_index_of_bad_records(spark):
    good = warc.build_record("metadata", "<x>", [("WARC-Block-Digest", warc.digest(b"a"))], b"a")
    bad = spark.createDataFrame([(1, bytearray(b"junk")), (2, None), (3, bytearray()), (4, bytearray(good)), (None, bytearray(good[:-6]))],
                                "key long, record binary")
    rows = {r["key"]: r for r in warc.read_index(bad).collect()}
    assert len(rows) == 5 and rows[4]["record_type"] == "metadata" and rows[4]["digest_ok"]
    assert all(v is None for k in (1, 2, 3, None) for v in rows[k][1:])


def test_responses_that_differ_have_ids_of_their_own(spark):
    pages = spark.createDataFrame([(1, "http://a", "x", "2024-05-06 07:08:09"), (1, "http://a", "y", "2024-05-06 07:08:09"),
                                   (1, "http://a", "x", None), (1, "http://a", "x", "2024-05-06 07:08:09")],
                                  "page_id long, url string, html string, seen string")
    heads = [warc.parse_record(r["record"])[0] for r in warc.responses(pages, date_col="seen").collect()]
    assert len({h["WARC-Record-ID"] for h in heads}) == 3
    assert sorted(h["WARC-Date"] for h in heads) == [warc.DATE, *["2024-05-06T07:08:09Z"] * 3]


def test_files_round_trip(spark, tmp_path):
    page = "<p>WARC/1.1\r\nContent-Length: 3\r\n\r\nabc\n\n</p>\n"
    pages = spark.createDataFrame([(i, f"http://h/{i}", page * (i % 5) + "퟿\x00é" * (i % 3)) for i in range(57)],
                                  "page_id long, url string, html string").repartition(3)
    both = warc.responses(pages).unionByName(warc.build_derivatives(pages))
    want = sorted(bytes(r["record"]) for r in both.collect())
    path = warc.write_warc(both, str(tmp_path / "w"), per_file=10)
    files = spark.read.format("binaryFile").load(path).select("path").collect()
    assert len(files) >= len(want) // 10 and len(want) == 57 * 3
    read = warc.read_warc(spark, path)
    assert sorted(bytes(r["record"]) for r in read.collect()) == want
    assert sorted(map(tuple, warc.read_index(warc.derivatives(read).drop("key").selectExpr("0L AS key", "record")).collect())) == \
        sorted(map(tuple, warc.read_index(warc.derivatives(warc.responses(pages)).selectExpr("0L AS key", "record")).collect()))


def test_files_gzipped_by_record_and_cut_off(spark, tmp_path):
    import gzip
    records = [warc.build_record("resource", f"<{i}>", [("X-Empty", "")], b"\xff\r\n\r\n" * i) for i in range(4)]
    (tmp_path / "a.warc.gz").write_bytes(b"".join(map(gzip.compress, records)))
    (tmp_path / "b.warc").write_bytes(b"".join(records)[:-3])
    got = [(r["key"], bytes(r["record"])) for r in warc.read_warc(spark, str(tmp_path)).collect()]
    assert sorted(got) == sorted([*enumerate(records), *enumerate(records[:-1])])
    none = spark.createDataFrame([], "key long, record binary")
    assert warc.read_warc(spark, warc.write_warc(none, str(tmp_path / "none"))).count() == 0
