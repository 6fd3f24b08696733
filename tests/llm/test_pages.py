"""Pages of any shape in time that grows with them alone, and archives as they stand in the world."""

import gzip
import time

import pytest

from fieldloom.llm import common, html, warc

_OPEN = {
    "tags without an end": lambda n: "<b " * n + "'", "quotes": lambda n: "<b 'a' " * n + '"', "names": lambda n: "<a" * n + " '", "raw elements": lambda n: "<button>" * n, "nesting": lambda n: "<div>" * n,
    "end tags": lambda n: "</button " * n + "<button>" * n, "comments": lambda n: "<!--" * n, "mixed quotes": lambda n: "<b x='>" * n, "attributes": lambda n: "<p id=x" * n, "closing": lambda n: "<div>" + "</p>" * n, "entities": lambda n: "&amp" * n,
}


@pytest.mark.parametrize("kind", _OPEN)
def test_parsing_is_linear(kind):
    """Four times the page takes far less than sixteen times as long; the longest has a megabyte or so."""
    def took(n):
        source, best = _OPEN[kind](n), 9e9
        for _ in range(2):
            began = time.process_time()
            html.Page(source)
            best = min(best, time.process_time() - began)
        return best

    assert took(160_000) < 9 * took(40_000) + 0.05


def test_a_page_of_four_megabytes():
    assert len(html.Page("<p class=x>text " * 130_000 + "<b '" * 500_000).tags) > 130_000


def test_tags_as_they_stand():
    page = lambda x: [t for _, t in sorted(html.Page(x).texts.items())]
    assert page("<p title='a > b'>one</p>two") == ["one", "two"]
    assert page("a < b <p>c") == ["a < b", "c"]
    assert page("<p>x<!-- <p>y --><?php > ?>z") == ["x ?>z"]
    assert page("<script>a</SCRIPT >b<button>c") == ["bc"]
    assert page("<p>it <b class=\"never ends>so it is text") == ['it <b class="never ends>so it is text']
    assert page("") == [] and page("<") == ["<"] and page("</") == ["</"] and page("<p") == []


@pytest.mark.parametrize("line", [b"\r\n", b"\n"])
def test_heads_of_both_line_ends(line):
    head = line.join([b"HTTP/1.0 200 OK", b"Server:x", b"Content-Type:  text/html ", b"Date: a: b", b"no colon"])
    status, fields, payload = warc.split_http(head + line * 2 + b"body\r\n\r\nmore\n\n")
    assert (status, fields, payload) == (b"HTTP/1.0 200 OK", {b"Server": b"x", b"Content-Type": b"text/html", b"Date": b"a: b"}, b"body\r\n\r\nmore\n\n")
    assert warc.split_http(head)[2] == b"" and warc.split_http(b"no head" + line * 2)[2] == b"no head" + line * 2


@pytest.mark.parametrize("line", [b"\r\n", b"\n"])
def test_repeated_payloads_of_archives_from_elsewhere(spark, tmp_path, line):
    """Responses without page numbers, heads of either kind, no length in the head, repeated payloads over two files."""
    block = lambda body: b"HTTP/1.0 200 OK" + line + b"Server:x" + line * 2 + body
    bodies, expected, payloads = [b"same" * 30, b"same" * 30, b"", b"other", b"same" * 30], {}, {}
    for k, body in enumerate(bodies):
        file = [warc.arc_version_block(1, f"{k % 2}.arc", "19970101000000")] if k < 2 else []
        file.append(warc.arc_record(1, {"URL": f"http://h/{k}", "IP-address": "10.0.0.1", "Archive-date": f"1998010203040{k}", "Content-type": "text/html"}, block(body)))
        with (tmp_path / f"{k % 2}.arc").open("ab") as f:
            f.write(b"".join(file))
        payloads[f"http://h/{k}"] = (len(body), warc.digest(body))
        expected[f"http://h/{k}"] = "revisit" if k in (0, 1) else "response"
    archives = common.stored(warc.convert(warc.read_files(spark, f"file://{tmp_path}"), unnumbered=True))
    records = warc.read_archives(archives).collect()
    assert {r["target_uri"]: r["record_type"] for r in records} == expected and len(records) == 5
    assert {r["target_uri"]: (r["payload_bytes"], r["payload_digest"]) for r in records} == payloads
    by_id = {r["record_id"]: r["target_uri"] for r in records}
    assert {by_id[r["refers_to_id"]] for r in records if r["record_type"] == "revisit"} == {"http://h/4"}
    raw = b"".join(gzip.decompress(r["archive"]) for r in archives.collect())
    assert raw.count(b"same" * 30) == 1 and raw.count(b"Server:x" + line * 2) == 5


def test_responses_take_no_part_in_the_join(spark, sf_dir):
    plan = warc.op8_warc(spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert "Union" in plan and "LeftOuter" in plan and plan.index("Union") < plan.index("LeftOuter")
