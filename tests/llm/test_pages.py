"""Operators 3 and 7."""

import hashlib
import html
import re
from collections import defaultdict

import pytest
import zstandard

from arrayframe.llm import main_text, warc

PAGES = "page_id bigint, url string, html string, text string, payload binary, digest string"


@pytest.fixture(scope="module")
def pages(spark, small):
    return spark.read.parquet(f"{small}/pages.parquet")


@pytest.fixture(scope="module")
def edge_pages(spark):
    big = "<p>" + "word and more " * 40_000 + "</p>"
    same = "<article>" + "equal payload " * 100 + "</article>"
    htmls = [None, "", "plain text only", "<p>unclosed <b>tags", big, same, same, same, "<<<>>> & &amp; &#x41; </p></div>", "<script>x</script><style>y</style>", "<div " * 300, "<p>é 😀</p>"]
    rows = [(i, None if i % 5 == 0 else f"http://x/{i}\r\nX: y", h, None, None, None) for i, h in enumerate(htmls)]
    return spark.createDataFrame([*rows, rows[5], (None, "u", same, None, None, None), (None, None, None, None, None, None)], PAGES)


def article(page):
    inner = page[page.index("<article>") + 9 : page.index("</article>")]
    blocks = [re.sub(r"\s+", " ", html.unescape(re.sub("<[^>]*>", "", x))).strip() for x in re.split(r"</?(?:p|h1)>", inner)]
    return "\n".join(b for b in blocks if b)


def test_main_text_of_the_pages(pages):
    truth = {r.page_id: article(r.html) for r in pages.collect()}
    got = main_text.main_text(pages).collect()
    assert len(got) == len(truth)
    for r in got:
        assert r.text == truth[r.page_id] and r.n_chars == len(r.text)


def test_main_text_of_unseen_layouts():
    make = main_text.Composer(12345)
    composed = [make.page() for _ in range(150)]
    got = main_text.extract([p for p, _ in composed], main_text.trained())
    right = sum(g == "\n".join(" ".join(b.split()) for b in blocks) for g, (_, blocks) in zip(got, composed, strict=True))
    assert right >= 0.95 * len(composed)


def test_decoding_never_keeps_below_what_it_drops():
    tree = main_text.Nodes(main_text.parse("<div><p>a</p><div><p>b</p></div></div><p>c</p>"))
    for seed in range(50):
        score = list(__import__("numpy").random.default_rng(seed).normal(size=len(tree.nodes)))
        kept = {id(n) for n in main_text.decode(tree, score)}
        assert all(n.parent is None or id(n.parent) in kept for n in tree.nodes if id(n) in kept)


def test_page_edges(edge_pages, spark):
    got = main_text.main_text(edge_pages).collect()
    assert len(got) == edge_pages.count() and all(r.text == "" for r in got if r.page_id in (0, 1, 9))
    none = spark.createDataFrame([], PAGES)
    assert main_text.main_text(none).count() == 0 and warc.round_trip(none).count() == 0


def check_warc(rows, got):
    holders = defaultdict(list)
    for k, h in rows:
        if k is not None:
            holders[h or ""].append(k)
    want = []
    for k, h in rows:
        b, top = (h or "").encode(), max(holders[h or ""], default=None)
        revisit = len(b) >= 1000 and top is not None and k != top
        want.append((k, len(b), hashlib.sha1(b).hexdigest(), "revisit" if revisit else "response", top if revisit else None))
    assert sorted(map(str, want)) == sorted(str((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to)) for r in got)


def test_warc_round_trip(pages, edge_pages):
    for frame in (pages, edge_pages):
        check_warc([(r.page_id, r.html) for r in frame.collect()], warc.round_trip(frame).collect())


def archive(records, dictionary=b""):
    options = {"dict_data": zstandard.ZstdCompressionDict(dictionary)} if dictionary else {}
    return warc.leading_frame(dictionary) + b"".join(zstandard.ZstdCompressor(**options).compress(r) for r in records)


def test_archive_frames():
    payloads = [f"<p>page {i} {'filler ' * (i % 7)}</p>".encode() for i in range(200)]
    records = [warc.record(i, "http://x", p, hashlib.sha1(p).hexdigest(), "response", None) for i, p in enumerate(payloads)]
    dictionary = warc.train_dictionary(payloads * 5)
    for d in (dictionary, b""):
        assert list(warc.frames(archive(records, d))) == records
    assert [warc.described(r)[0] for r in records] == list(range(200))


def test_broken_archives():
    p = b"payload"
    good = warc.record(1, None, p, hashlib.sha1(p).hexdigest(), "response", None)
    for bad in (good[:-1], good.replace(b"WARC-Date", b"WARC-Other"), good.replace(b"payload\r\n", b"payloat\r\n"), b"nothing", good.replace(b"Content-Length: 7", b"Content-Length: 8")):
        with pytest.raises(warc.WarcError):
            warc.described(bad)
    for data in (archive([good])[:-3], b"junk" + archive([good]), warc.SKIPPABLE + b"\xff\xff\x00\x00"):
        with pytest.raises(warc.WarcError):
            list(warc.frames(data))
