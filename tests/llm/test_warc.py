import gzip

import pytest
from pyspark.sql import functions as F

from ledgerlens.llm import warc as W

from .conftest import CLASHES, prose

LONG = prose(3, 150_000)
PAGES = [(5, "http://a.example/x y?q=1", "<p>one</p>"), (2, "http://b.example", "<p>one</p>"), (9, None, "<p>one</p>"), (7, "no scheme", None), (3, "https://ü.example/ß", ""),
         (4, "http://c.example/\r\nX: y", LONG), (1, "http://c.example/", LONG + " "), (None, "http://d.example/", "<p>one</p>"), (None, None, "only null ids"), (None, None, "only null ids"),
         (2, "http://b.example", "<p>one</p>"), (5, "http://a.example/x y?q=1", "<p>one</p>"), (11, "http://e.example/", "WARC/1.1\r\n\r\nHTTP/1.1 200 OK\r\n\r\n東京")]


def pages(spark):
    return spark.createDataFrame([(*p, *["x"] * len(CLASHES)) for p in PAGES], f"page_id long, url string, html string, {', '.join(f'{c} string' for c in CLASHES)}")


def expected(rows, least_bytes=0):
    out = []
    for i, _, html in rows:
        data = (html or "").encode()
        same = [j for j, _, h in rows if (h or "") == (html or "") and j is not None]
        again = len(data) >= least_bytes and same and i != min(same)
        out.append((i, len(data), W.payload_digest(data), "revisit" if again else "response", min(same) if again else None))
    return sorted(out, key=str)


def result(df):
    return sorted([(r.capture_id and int(r.capture_id), r.payload_bytes, r.payload_digest, r.type, r.refers_to and int(r.refers_to.capture_id)) for r in df.collect()], key=str)


@pytest.mark.parametrize("options", [{}, {"least_bytes": 4}, {"file_bytes": 1}])
def test_round_trip(spark, options):
    got = W.round_trip(pages(spark).repartition(3), payloads=True, **options)
    assert result(got) == expected(PAGES, options.get("least_bytes", 0))
    rows = got.collect()
    assert all(r.verified and r.n_requests == 1 and r.n_metadata == 1 and r.request.line.startswith("GET /") for r in rows)
    html = {i: (h or "").encode() for i, _, h in PAGES if i is not None} | {None: b"only null ids"}
    assert all(bytes(r.payload) == html[r.capture_id and int(r.capture_id)] for r in rows if r.type == "response")
    assert {r.uri for r in rows if r.capture_id == "4"} == {"http://c.example/%0D%0AX:%20y"}


def test_empty_table(spark):
    assert W.round_trip(pages(spark).limit(0)).count() == 0


def foreign(tmp_path, name, records, compress):
    data = [W.record(h, b) for h, b in records]
    path = str(tmp_path / name)
    with open(path, "wb") as f:
        f.write(b"".join(gzip.compress(d) for d in data) if compress == "members" else gzip.compress(b"".join(data)) if compress == "one" else b"".join(data))
    return path


def head(kind, rid, *more):
    http = kind in ("request", "response", "revisit")
    return [("WARC-Type", kind), ("WARC-Record-ID", rid), ("Content-Type", f"application/http;msgtype={kind}" if http else "application/warc-fields"), *more]


@pytest.mark.parametrize("compress", ["members", "one", "plain"])
def test_links_in_any_direction(spark, tmp_path, compress):
    page = b"HTTP/1.1 200 OK\r\nX-A: 1\r\n  2\r\n\r\nbody"
    records = [
        (head("response", "<r1>"), page), (head("request", "<q1>", ("WARC-Concurrent-To", "<r1>")), b"GET /1 HTTP/1.1\r\n\r\n"), (head("metadata", "<m1>", ("WARC-Concurrent-To", "<r1>")), b"capture-id: 1\r\n"),
        (head("response", "<r2>", ("WARC-Concurrent-To", "<q2>")), page), (head("request", "<q2>"), b"GET /2 HTTP/1.1\r\n\r\n"), (head("metadata", "<m2>", ("WARC-Concurrent-To", "<q2>")), b"capture-id: 2\r\n"),
        # a chain, and both directions at once
        (head("response", "<r3>", ("WARC-Concurrent-To", "<q3>")), page), (head("request", "<q3>", ("WARC-Concurrent-To", "<r3>")), b"GET /3 HTTP/1.1\r\n\r\n"),
        (head("metadata", "<m3>", ("WARC-Concurrent-To", "<q3>")), b"capture-id: 3\r\n"),
        (head("response", "<r4>"), page), (head("request", "<q4>", ("WARC-Concurrent-To", "<r4>")), b"GET /4 HTTP/1.1\r\n\r\n"), (head("metadata", "<m4>", ("WARC-Concurrent-To", "<q4>")), b"capture-id: 4\r\n"),
        # alone; a revisit of an absent response; not part of a transaction
        (head("response", "<r5>", ("WARC-Payload-Digest", "sha1:WRONG")), page), (head("revisit", "<r6>", ("WARC-Refers-To", "<none>"), ("WARC-Payload-Digest", "sha1:ABC")), b"HTTP/1.1 200 OK\r\nContent-Length: 12\r\n\r\n"),
        (head("warcinfo", "<w>"), b"software: x\r\n"), (head("metadata", "<m7>", ("WARC-Concurrent-To", "<nobody>")), b"capture-id: 7\r\n"),
    ]
    path = foreign(tmp_path, "a.warc", records, compress)
    rows = {r.record_id: r for r in W.captures(W.read_records(spark.createDataFrame([(path,)], "path string"), True)).collect()}
    assert set(rows) == {f"<r{i}>" for i in range(1, 7)}
    for i in range(1, 5):
        r = rows[f"<r{i}>"]
        assert (r.capture_id, r.request.line, r.metadata.record_id, bytes(r.payload), r.http.fields["x-a"]) == (str(i), f"GET /{i} HTTP/1.1", f"<m{i}>", b"body", "1 2")
    assert (rows["<r5>"].capture_id, rows["<r5>"].request, rows["<r5>"].verified, rows["<r5>"].n_requests) == (None, None, False, 0)
    assert (rows["<r6>"].refers_to.capture_id, rows["<r6>"].payload_bytes, rows["<r6>"].payload_digest, rows["<r6>"].verified) == (None, 12, "ABC", None)


def test_a_hub_that_all_name_makes_no_pairs(spark, tmp_path):
    records = [(head("response", f"<r{i}>", ("WARC-Concurrent-To", "<hub>")), b"HTTP/1.1 200 OK\r\n\r\nx") for i in range(300)]
    records += [(head("request", f"<q{i:03d}>", ("WARC-Concurrent-To", "<hub>")), b"GET / HTTP/1.1\r\n\r\n") for i in range(300)]
    path = foreign(tmp_path, "b.warc", records, "members")
    rows = W.captures(W.read_records(spark.createDataFrame([(path,)], "path string")), 4).collect()
    assert len(rows) == 300 and {(r.request.record_id, r.n_requests, r.metadata) for r in rows} == {("<q000>", 300, None)}


@pytest.mark.parametrize("cut", [1, 9, 60])
def test_broken_archives_are_named(tmp_path, cut):
    for compress in ("members", "plain"):
        path = foreign(tmp_path, "c.warc", [(head("response", "<r>"), b"HTTP/1.1 200 OK\r\n\r\n" + b"x" * 100)], compress)
        data = open(path, "rb").read()
        with open(path, "wb") as f:
            f.write(data[: len(data) - cut] if compress == "members" else data[: len(data) - cut - 4])
        with pytest.raises(ValueError, match="c.warc"):
            list(W.parse(path, False))


def test_manifest_counts_what_is_there(spark):
    from ledgerlens.llm.arrays import shared_folder

    manifest = W.write_archives(pages(spark).repartition(2), shared_folder(spark, "warc-test"), file_bytes=2000)
    records = W.read_records(manifest)
    assert manifest.agg(F.sum("records")).first()[0] == records.count() == 3 * len(PAGES) + manifest.count()
    assert records.where("type = 'warcinfo'").count() == manifest.count() > 2
