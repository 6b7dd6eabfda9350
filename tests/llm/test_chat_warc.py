import gzip
import hashlib
import time
import zlib

from pyspark.sql import functions as F
from pyspark.sql import types as T

from vectide.llm import chat, warc

TURNS = T.StructType().add("conv_id", "long").add("turn", "long").add("role", "string").add("text", "string").add("side", "string").add("shown", "string")
PAGES = T.StructType().add("page_id", "long").add("url", "string").add("html", "string").add("payload", "string").add("block", "string")


def show(role, text):
    return f"<|{role}|>\n{text}<|end|>\n"


def brute(turns):
    """{pair: row} by plain loops."""
    sides = {}
    for c, turn, role, text in set(turns):
        if c is not None:
            sides.setdefault(c // 2, {}).setdefault(c % 2, []).append((turn is not None, turn or 0, role or "", text or ""))
    out = {}
    for pair, s in sides.items():
        if len(s) == 2:
            a, b = ([x[2:] for x in sorted(s[k])] for k in (0, 1))
            n = 0
            while n < min(len(a), len(b)) and a[n] == b[n]:
                n += 1
            row = [n, "".join(show(*t) for t in a[:n])]
            masks = []
            for rest in (a[n:], b[n:]):
                at, spans = 0, []
                for role, text in rest:
                    if role == "assistant":
                        spans.append(f"{at + len(role) + 5}:{at + len(show(role, text))}")
                    at += len(show(role, text))
                row.append("".join(show(*t) for t in rest))
                masks.append(",".join(spans))
            out[pair] = (*row, *masks)
    return out


def test_preferences_against_loops(spark):
    u, a = "user", "assistant"
    turns = [(0, 0, u, "hi"), (0, 1, a, "hello é"), (0, 2, u, "x"), (0, 3, a, "yes"), (1, 0, u, "hi"), (1, 1, a, "hello é"), (1, 2, a, "no"), (1, 3, u, "why")]
    turns += [(2, 0, u, "same"), (3, 0, u, "same")]  # equal
    turns += [(4, 0, u, "alone")]  # no other side
    turns += [(6, 0, "system", "s"), (6, 1, u, "q"), (7, 0, "system", "s")]  # one is a prefix
    turns += [(8, None, None, None), (8, 1, u, ""), (8, 1, u, ""), (8, 1, a, "tie"), (9, 1, a, "tie"), (9, None, "", "")]
    turns += [(None, 0, u, "none"), (10, 0, u, "long " * 30_000), (11, 0, u, "long " * 30_000), (11, 1, a, "z")]
    turns += [(12, k, a if k % 2 else u, f"t{k}") for k in range(400)] + [(13, k, a if k % 2 else u, f"t{k if k < 300 else -k}") for k in range(400)]
    df = spark.createDataFrame([(*t, "x", "y") for t in turns], TURNS).repartition(3)
    got = {r["pair"]: tuple(r)[1:] for r in chat.format_preferences(chat.adjacent_pairs(df)).collect()}
    assert got == brute(turns)
    assert got[0][3].count("no") == 1 and got[0][0] == 2 and got[6][0] == 300
    assert chat.format_preferences(chat.adjacent_pairs(spark.createDataFrame([], TURNS))).count() == 0


def test_negative_ids_make_pairs(spark):
    rows = [(k, 0, "user", f"q{k}") for k in (-3, -2, -1, 0, 1)]
    df = spark.createDataFrame([(*r, "", "") for r in rows], TURNS)
    got = {r["pair"]: (r["chosen"], r["rejected"]) for r in chat.format_preferences(chat.adjacent_pairs(df)).collect()}
    assert got == {k: (show("user", f"q{2 * k}"), show("user", f"q{2 * k + 1}")) for k in (-1, 0)}


def test_preferences_run_without_python(spark):
    df = spark.createDataFrame([(0, 0, "user", "a", "", "")], TURNS)
    plan = chat.format_preferences(chat.adjacent_pairs(df))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan


HTML = '<html><head><title> A &amp;\n b </title><style>p{}</style></head><body><p>One &lt;x&gt;</p><!-- no --><script>var a="<p>";</script><div>Two<br>three  é</div><a href="http://l.example/1">link</a></body></html>'


def test_derivatives(spark):
    rows = [(1, "http://x.example/", HTML), (2, None, None), (3, "u", ""), (3, "u", ""), (4, "v", "plain text " * 50_000), (None, "w", "<p>x")]
    df = spark.createDataFrame([(*r, "p", "b") for r in rows], PAGES)
    source = warc.responses(df)
    got = warc.derive(source).collect()
    assert len(got) == 2 * len(rows)
    ids = {r["page_id"]: r["record_id"] for r in source.collect()}
    for r in got:
        html = next(h or "" for k, _, h in rows if k == r["page_id"])
        assert r["refers_to"] == ids[r["page_id"]] and r["record_id"] != r["refers_to"]
        assert r["source_digest"] == "sha256:" + hashlib.sha256(html.encode()).hexdigest()
        assert r["block_digest"] == "sha256:" + hashlib.sha256(r["block"].encode()).hexdigest()
        assert r["content_length"] == len(r["block"].encode())
    by = {(r["page_id"], r["warc_type"]): r["block"] for r in got}
    assert by[1, "conversion"] == "One <x>\nTwo\nthree é\nlink"
    assert "title: A & b\r\n" in by[1, "metadata"] and "outlink: http://l.example/1\r\n" in by[1, "metadata"]
    assert "http-header: Content-Type: text/html; charset=utf-8\r\n" in by[1, "metadata"] and f"payload-length: {len(HTML.encode())}\r\n" in by[1, "metadata"]
    assert by[2, "conversion"] == "" and by[4, "conversion"] == ("plain text " * 50_000).strip()
    assert warc.derive(warc.responses(spark.createDataFrame([], PAGES))).count() == 0


def test_files_round_trip(spark, tmp_path):
    page = HTML.encode()
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\nX-Own: 1"
    block = head + b"\r\n\r\n" + page
    record = b"WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:uuid:1>\r\nWARC-Target-URI: http://x/\r\nWARC-Date: 2024-01-01T00:00:00Z\r\nContent-Length: %d\r\n\r\n%s\r\n\r\n" % (len(block), block)
    other = record.replace(b"response", b"request ")
    (tmp_path / "a.warc").write_bytes(record + other)
    (tmp_path / "b.warc.gz").write_bytes(gzip.compress(record) + gzip.compress(record[: len(record) // 2]))
    source = warc.read_responses(spark, str(tmp_path / "*.warc*"))
    assert source.count() == 2
    derived = warc.derive(source, keep=())
    text = b"".join(r["record"].encode() for r in warc.serialise(derived.where(F.col("refers_to") == "<urn:uuid:1>")).collect())
    parsed = list(warc.parse(text))
    assert len(parsed) == 4 and {f["warc-refers-to"] for f, _ in parsed} == {"<urn:uuid:1>"}
    for fields, body in parsed:
        assert fields["warc-block-digest"] == "sha256:" + hashlib.sha256(body).hexdigest()
        assert fields["warc-source-payload-digest"] == "sha256:" + hashlib.sha256(page).hexdigest()
        assert fields["warc-type"] != "metadata" or b"http-header: X-Own: 1\r\n" in body


def test_references_and_links_of_every_form(spark):
    page = """<head><title>t</title></head><p>It&#8217;s &#xE9;t&eacute; &hellip;&mdash; A&amp;lt;B&nbsp;C &unknown; AT&T</p>
    <a href='/one'>1</a><A class=x HREF=/two>2</A><a href = "/three?a=1&amp;b=&eacute;">3</a><a title='href="/no"' href="/four">4</a>
    <!-- <a href="/hidden">h</a> --><script>var x = '<a href="/script">s</a>';</script><a name="n">5</a><abbr href="/no">6</abbr>"""
    rows = warc.derive(warc.responses(spark.createDataFrame([(1, "u", page, "p", "b")], PAGES))).collect()
    by = {r["warc_type"]: r["block"] for r in rows}
    assert by["conversion"].startswith("It’s été …— A&lt;B C &unknown; AT&T\n")
    found = [line[9:] for line in by["metadata"].split("\r\n") if line.startswith("outlink: ")]
    assert found == ["/one", "/two", "/three?a=1&b=é", "/four"]


def test_odd_pages_take_linear_time():
    began = time.perf_counter()
    for odd in ("<!-- ", "<title>", "<a ", "<script>", "<script></script ", "<a href='", '<p x=">"', "<", "<a href=\"x\"", "<head><script>", "&amp", "<p a"):
        warc.read_page(odd * (1_000_000 // len(odd)), "http://x.example/")
    assert time.perf_counter() - began < 60


def test_links_are_resolved():
    page = "<a href=a/b>1</a><a href='?q=1'>2</a><a href='//o.example/x'>3</a><a href='../up'>4</a><a href='#f'>5</a><a href='MAILTO:x@y'>6</a><a href='/r'>7</a><a href=' /s '>8</a><a href='http://[bad'>9</a>"
    title, text, links = warc.read_page("<title>A &amp; B</title>" + page, "https://h.example/d/e?z#y")
    assert (title, text) == ("A & B", "123456789")
    assert links == ["https://h.example/d/a/b", "https://h.example/d/e?q=1", "https://o.example/x", "https://h.example/up", "https://h.example/d/e?z#f", "MAILTO:x@y", "https://h.example/r", "https://h.example/s", "http://[bad"]
    assert warc.read_page('<base href="/root/"><base href="/no/">' + page, "https://h.example/d/e")[2][0] == "https://h.example/root/a/b"
    assert warc.read_page(page, "not absolute")[2][0] == "a/b"


def record(kind, payload, head=b"HTTP/1.1 200 OK\r\nContent-Type: text/html", more=b"", size=None):
    block = head + b"\r\n\r\n" + payload
    return b"WARC/1.0\r\nWARC-Type: %s\r\nWARC-Record-ID: <urn:%d>\r\nWARC-Target-URI: http://x/\r\nWARC-Date: d\r\n%sContent-Length: %s\r\n\r\n%s\r\n\r\n" % (kind, len(payload), more, size or b"%d" % len(block), block)


def test_damaged_files_and_source_digests(spark, tmp_path):
    good = record(b"response", b"<p>one</p>", more=b"WARC-Payload-Digest: sha1:ABC\r\nX-Folded: a\r\n b\r\n")
    (tmp_path / "a.warc").write_bytes(good + record(b"response", b"two", size=b"many") + record(b"response", b"three") + good[:-30])
    whole = gzip.compress(good) + gzip.compress(record(b"response", b"<p>four</p>"))
    (tmp_path / "b.warc.gz").write_bytes(whole[:-25])
    (tmp_path / "c.warc.gz").write_bytes(gzip.compress(good)[:-12] + b"rubbish")
    (tmp_path / "d.warc").write_bytes(b"")
    (tmp_path / "e.warc").write_bytes(b"\x00" * 5000)
    got = warc.read_responses(spark, str(tmp_path / "*")).collect()
    by = {}
    for r in got:
        by.setdefault(r["file"].rsplit("/", 1)[1], []).append(r)
    assert [r["payload"] for r in by["a.warc"]] == ["<p>one</p>", "three"] and [r["payload"] for r in by["b.warc.gz"]] == ["<p>one</p>"]
    assert not {"d.warc", "e.warc"} & by.keys()
    one, three = by["a.warc"]
    assert one["payload_digest"] == "sha1:ABC" and three["payload_digest"] == "sha256:" + hashlib.sha256(b"three").hexdigest()
    made = warc.derive(spark.createDataFrame([one], warc.read_responses(spark, str(tmp_path / "*")).schema), keep=("file",)).collect()
    assert {r["source_digest"] for r in made} == {"sha1:ABC"}
    block = next(r["block"] for r in made if r["warc_type"] == "metadata")
    assert "warc-header: warc-payload-digest: sha1:ABC\r\n" in block and "warc-header: x-folded: a b\r\n" in block and "payload-digest: sha1:ABC\r\n" in block


def test_bodies_are_decoded_and_digested_as_bytes(spark, tmp_path):
    body = "<p>caf\u00e9</p>"
    latin = body.encode("latin-1")
    chunked = b"5\r\n" + latin[:5] + b"\r\n%x;x=1\r\n" % len(latin[5:]) + latin[5:] + b"\r\n0\r\n\r\n"
    heads = {
        "latin": (b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=ISO-8859-1", latin),
        "meta": (b"HTTP/1.1 200 OK", b'<meta charset="latin1">' + latin),
        "gzip": (b"HTTP/1.1 200 OK\r\nContent-Encoding: gzip", gzip.compress(body.encode())),
        "deflate": (b"HTTP/1.1 200 OK\r\nContent-Encoding: deflate", zlib.compress(body.encode())[2:-4]),
        "chunked": (b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\nContent-Type: text/html; charset=latin1", chunked),
        "lies": (b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\nContent-Encoding: gzip\r\nContent-Type: x; charset=nonsense", body.encode()),
    }
    for name, (head, payload) in heads.items():
        (tmp_path / f"{name}.warc").write_bytes(record(b"response", payload, head))
    for r in warc.read_responses(spark, str(tmp_path / "*")).collect():
        head, payload = heads[r["file"].rsplit("/", 1)[1][:-5]]
        assert r["payload"].endswith(body), r["file"]
        assert r["payload_digest"] == "sha256:" + hashlib.sha256(payload).hexdigest() and r["http_headers"] == head.decode()
