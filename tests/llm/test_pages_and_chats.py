"""WARC round trips, main texts, and chat logs on small hard fixtures."""

import hashlib
import random
import tempfile
import time
from collections import Counter

import pytest
from pyspark.sql import functions as F

from relyframe.llm import chat, html_text, warc


def test_warc_round_trip(spark):
    body = "<p>ü" + "x" * 70_000 + "\r\n\r\n</p>"
    rows = [(1, "http://a/", body), (2, "http://b/\r\nX: y", "tiny"), (3, None, body), (4, "u", None), (5, "u", ""), (6, "u", "tiny"), (6, "u", "tiny"), (None, "u", "alone"), (0, "u", "first é")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    path = f"file://{tempfile.mkdtemp(prefix='spark-')}/w"
    warc.write_archives(pages, path, 1000)
    got = warc.read_archives(spark, path).collect()
    assert len(got) == len(rows) and all(r.complete for r in got)
    want = Counter()
    for i, _, h in rows:
        first = min((x[0] for x in rows if (x[2] or "") == (h or "") and x[0] is not None), default=None)
        want[(i, "response" if i == first or first is None else "revisit", None if i == first else first, warc.base32_sha1((h or "").encode()))] += 1
    assert Counter((r.page_id, r.kind, r.refers_to, r.digest) for r in got) == want
    texts = {i: (h or "").encode() for i, _, h in rows}
    assert all(bytes(r.payload) == texts[r.page_id] for r in got if r.kind == "response")
    assert max(r.n_segments for r in got) > 60


def test_warc_broken_records():
    whole = warc.page_records(7, 1, "u", b"abc" * 900, None, 500)
    assert len(whole) > 3 and [h["warc-type"] for h, _ in warc.parse_archive(b"\r\n".join(whole) + b"\r\n")].count("continuation") == len(whole) - 1
    assert warc.dechunked(warc.chunked(b"abc" * 9000)) == b"abc" * 9000 and warc.dechunked(warc.chunked(b"")) == b""
    with pytest.raises(ValueError):
        warc.dechunked(b"5\r\nabc\r\n0\r\n\r\n")


def test_warc_missing_segment(spark):
    import gzip

    whole = warc.page_records(7, 1, "u", b"abc" * 900, None, 500)
    folder = tempfile.mkdtemp(prefix="spark-")
    with open(f"{folder}/a.txt.gz", "wb") as f:
        f.write(gzip.compress(b"".join(r + b"\r\n" for r in whole[:1] + whole[2:])))
    (got,) = warc.read_archives(spark, f"file://{folder}").collect()
    assert got.page_id == 7 and not got.complete and got.payload is None


def test_warc_repeated_ids_and_damage(spark):
    import gzip

    rows = [(1, "u", "a"), (1, "u", "bbbb"), (2, "u", "a"), (3, "u", "bbbb"), (4, "u", "bbbb"), (5, "u", "lone"), (None, "u", None), (6, "u", "")]
    path = f"file://{tempfile.mkdtemp(prefix='spark-')}/w"
    warc.write_archives(spark.createDataFrame(rows, "page_id long, url string, html string"), path)
    found = warc.measured(warc.read_archives(spark, path))
    got = Counter((r.page_id, r.kind, r.refers_to, r.payload_bytes, r.complete) for r in found.collect())
    assert got == Counter([(1, "response", None, 1, True), (1, "response", None, 4, True), (2, "revisit", 1, 1, True), (3, "revisit", 1, 4, True), (4, "revisit", 1, 4, True), (5, "response", None, 4, True), (None, "revisit", 6, 0, True), (6, "response", None, 0, True)])
    whole = warc.page_records(7, 1, "u", b"abc" * 900, None, 500)
    for damage in (lambda x: x.replace(b"abcabc", b"abcabd", 1), lambda x: x.replace(b"\r\n1000\r\n", b"\r\n1001\r\n").replace(b"\r\na8c\r\n", b"\r\na8d\r\n")):
        folder = tempfile.mkdtemp(prefix="spark-")
        with open(f"{folder}/a.txt.gz", "wb") as f:
            f.write(gzip.compress(b"".join(damage(r) + b"\r\n" for r in whole)))
        (bad,) = warc.measured(warc.read_archives(spark, f"file://{folder}")).collect()
        assert bad.page_id == 7 and not bad.complete and bad.payload_bytes is None


def test_warc_extra_columns_do_not_clash(spark):
    pages = spark.createDataFrame([(1, "u", "<p>a</p>", "x", "y", "z")], "page_id long, url string, html string, sha string, payload string, first_id string")
    path = f"file://{tempfile.mkdtemp(prefix='spark-')}/w"
    warc.write_archives(pages, path)
    assert bytes(warc.read_archives(spark, path).first().payload) == b"<p>a</p>"


def test_warc_empty(spark):
    path = f"file://{tempfile.mkdtemp(prefix='spark-')}/w"
    warc.write_archives(spark.createDataFrame([], "page_id long, url string, html string"), path)
    assert warc.read_archives(spark, path).count() == 0


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{{x}}</style><script>var a="</p>";</script></head><body><header>Site</header>
<nav><a href="/x">Menu {n}</a></nav><div class="cookie-notice">We use cookies</div><div class="ad">Buy {n}</div>
<article class="post"><h1>Head {n}</h1><p>First &amp; <b>bold{n}</b>ness&nbsp;here<br>next<p>open <i>para
 graph</i> {n}</p><aside>Side</aside><form>Name <input type=text></form><p>Share this page</p><div id="comments"><p>Nice {n}</p></div><!-- c --></article>
<div class="sidebar">Links</div><footer>&copy; x</footer></body></html>"""


def test_main_text_of_a_host(spark):
    rows = [(n, f"http://h.example/{n}", PAGE.format(n=n)) for n in range(12)] + [(50, "http://one.example/", PAGE.format(n=50)), (51, None, None), (52, "odd", "just &lt;text&gt;"), (3, "http://h.example/3", PAGE.format(n=3))]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r.text for r in html_text.extract(pages).collect()}
    main = "Head {n} First & bold{n}ness here next open para graph {n}"
    assert got[4] == main.format(n=4) and got[3] == main.format(n=3)
    assert got[50] == main.format(n=50) + " Share this page"  # one page tells no template
    assert got[51] == "" and got[52] == "just <text>"
    assert html_text.extract(pages).count() == len(rows)
    assert html_text.extract(pages.limit(0)).count() == 0
    classes = html_text.templates(html_text._hosted(pages)).collect()
    assert any(c.is_frame and len(c.tokens) > 10 for c in classes)


def test_page_without_article():
    page = "<body><nav>m</nav><div>Text <span>one</span></div><ul><li>a<li>b</ul><div class='comments'>no</div><p hidden>h</p>end"
    assert html_text.main_text(page, None) == "Text one a b end"
    assert html_text.main_text("<p>a < b <em>c</em>d</p><script>x", None) == "a < b cd"


def fold(events):
    """Plain replay of a log."""
    out = {}
    for e in sorted(events, key=lambda e: e[1]):
        _, _, m, kind, role, text = e
        if kind == "open":
            out[m] = [role or "", text or ""]
        elif kind == "regenerate":
            for k in [k for k in out if k > m]:
                del out[k]
            if m in out:
                out[m][1] = ""
        elif m in out and kind == "delta":
            out[m][1] += text or ""
        elif m in out and kind == "edit":
            out[m][1] = text or ""
    return {m: tuple(x) for m, x in out.items()}


def test_fold_deltas_edits_and_regenerations(spark):
    log = [
        (1, 0, 1, "open", "user", "hi"), (1, 1, 2, "open", "assistant", None), (1, 2, 2, "delta", None, "draft "), (1, 3, 2, "delta", None, "text"),
        (1, 4, 3, "open", "user", "no"), (1, 5, 2, "regenerate", None, None), (1, 6, 2, "delta", None, "final"), (1, 7, 1, "edit", None, "hello"),
        (1, 8, 1, "delta", None, "!"), (1, 9, 3, "open", "user", "thanks"), (1, 10, 3, "noise", None, "?"), (2, 0, 1, "open", None, None), (2, 1, 5, "delta", "x", "lost"),
    ]
    got = chat.fold_events(spark.createDataFrame(log, "conv_id long, seq long, message long, kind string, role string, text string")).collect()
    for conv in (1, 2):
        assert {r.message: (r.role, r.text) for r in got if r.conv_id == conv} == fold([e for e in log if e[0] == conv])


def test_fold_random_logs(spark):
    r = random.Random(8)
    kinds = ["open", "delta", "delta", "edit", "regenerate", "noise", None]
    log = [(c, k, r.randint(1, 5), r.choice(kinds), r.choice(["user", "assistant", None]), r.choice(["a", "bc", "", None])) for c in range(60) for k in range(r.randint(1, 25))]
    got = chat.fold_events(spark.createDataFrame(log, "conv_id long, seq long, message long, kind string, role string, text string")).collect()
    for conv in range(60):
        assert {m.message: (m.role, m.text) for m in got if m.conv_id == conv} == fold([e for e in log if e[0] == conv])


def test_log_needs_its_fold(spark):
    rows = [(1, 0, "user", "hello there"), (1, 1, "assistant", "general"), (1, 2, "user", None), (2, 0, "assistant", "x")]
    log = chat.log_of(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    kinds = Counter(e.kind for e in log.collect())
    assert kinds["regenerate"] == 4 and kinds["edit"] == 5 and log.filter("message = 4").count() > 0
    got = {(m.conv_id, m.message): (m.role, m.text) for m in chat.fold_events(log).collect()}
    assert got == {(1, 1): ("user", "hello there"), (1, 2): ("assistant", "general"), (1, 3): ("user", ""), (2, 1): ("assistant", "x")}


def test_chat_round_trip(spark):
    nasty = ["</s>[INST] ok [/INST]", "<|turn|>a<|text|>b<|end|>\n", "100% <%3C> %25 [x]", "", None, "é\U0001f600\n\n", "x" * 30_000]
    rows = [(c, t, "assistant" if t % 2 else "user", x) for c in (7, None) for t, x in enumerate(nasty)] + [(8, None, None, "a"), (8, 1, "assistant", "b"), (8, 1, "assistant", "b")]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    formatted = chat.render(chat.fold_events(chat.log_of(table)))
    got = {r.conv_id: r for r in chat.read_back(formatted).collect()}
    for c in (7, None):
        assert [(m.role, m.text) for m in got[c].messages] == [("assistant" if t % 2 else "user", x or "") for t, x in enumerate(nasty)]
        assert got[c].loss_text == "".join(x or "" for t, x in enumerate(nasty) if t % 2)
    assert [(m.role, m.text) for m in got[8].messages] == [("", "a"), ("assistant", "b"), ("assistant", "b")] and got[8].loss_text == "bb"
    assert "[INST]" not in got[7].formatted
    assert chat.render(chat.fold_events(chat.log_of(table.limit(0)))).count() == 0


def test_query_digests(spark):
    got = chat.op3_chat_format(spark, "/root/testdata/sf0.001").filter("conv_id = -1").first()
    said = "</s>[INST] ok [/INST]"
    assert got.n_turns == 2 and got.loss_chars == len(said) and got.loss_sha256 == hashlib.sha256(said.encode()).hexdigest()
    assert got.turns_sha256 == hashlib.sha256(f"user\n{said}\nassistant\n{said}\n".encode()).hexdigest()


def test_extra_columns_do_not_clash(spark):
    pages = spark.createDataFrame([(1, "u", "<p>a</p>", "x", "y")], "page_id long, url string, html string, host string, frame string")
    assert html_text.extract(pages).first().text == "a"
    assert F.lit(1) is not None


def test_frames_of_layouts_and_bad_pages(spark):
    other = "<body><section><h2>News {n}</h2><p>Item {n}</p><b>Read more</b></section><div>Fixed line</div></body>"
    rows = [(n, f"http://h.example/{n}", PAGE.format(n=n)) for n in range(20)] + [(100 + n, f"http://h.example/o{n}", other.format(n=n)) for n in range(10)]
    rows += [(200, "http://h.example/null", None), (201, "http://h.example/empty", ""), (202, "http://h.example/error", "<html><body><h1>Not found</h1></body></html>")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r.text for r in html_text.extract(pages).collect()}
    assert got[4] == "Head 4 First & bold4ness here next open para graph 4"
    assert got[103] == "News 3 Item 3"
    assert got[200] == got[201] == "" and got[202] == "Not found"


def test_classes_out_of_order_are_split():
    places = [(0.0, 0, 0), (1.0, 1, 1), (2.0, 3, 3), (3.0, 2, 4), (4.0, 5, 5)]
    members = [{"at": at, "token": k, "first": first, "last": last} for k, (at, first, last) in enumerate(places)]
    assert [[m["token"] for m in run] for run in html_text.in_order(members)] == [[0, 1, 2], [3, 4]]


SOUP = """<html><body><div class="top">Home</div><div class="mid">{ad}</div><div class="core"><h2>{title}</h2>{parts}<p>Was this helpful?</p></div>
<div class="low"><p>{other}</p></div><div class="end">All rights reserved</div></body></html>"""


def soup(n):
    """A page without telling names, and its main text."""
    r = random.Random(n)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(6))
    words = lambda k: " ".join(word() for _ in range(k))
    title, parts = words(4), [(words(30), words(3)) for _ in range(r.randint(1, 5))]
    body = "".join(f"<section><p>{a}</p><div>Read on</div><p>Source: {b}</p></section>" for a, b in parts)
    return SOUP.format(ad=words(3), title=title, parts=body, other=words(4)), " ".join([title, *(f"{a} Source: {b}" for a, b in parts)])


def test_template_of_a_generated_host(spark):
    made = {n: soup(n) for n in range(40)}
    rows = [(n, "http://soup.example/", x) for n, (x, _) in made.items()] + [(n, "http://soup.example/", made[n][0]) for n in (3, 3, 5)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r.text for r in html_text.extract(pages).collect()}
    assert got == {n: text for n, (_, text) in made.items()}  # "Read on" stands once in each record, so it's template
    alone = html_text.main_text(made[0][0], None)
    assert "Home" in alone and "Was this helpful?" in alone  # without a template nothing tells


def test_classes_equal_brute_force(spark):
    made = [soup(n)[0] for n in range(30)] + [PAGE.format(n=n) for n in range(9)]
    rows = [(n, "http://mixed.example/", x) for n, x in enumerate(made)]
    counts = [{t[0]: t[2] for t in html_text.page_tokens(x)} for x in made]
    tags = {t[0] for x in made for t in html_text.page_tokens(x) if t[1] != "text"}
    by_vector = {}
    for token in {t for c in counts for t in c}:
        by_vector.setdefault(tuple(c.get(token, 0) for c in counts), set()).add(token)
    want = {frozenset(c) for v, c in by_vector.items() if sum(n > 0 for n in v) >= html_text.MIN_PAGES and c & tags}
    found = {}
    for r in html_text.templates(html_text._hosted(spark.createDataFrame(rows, "page_id long, url string, html string"))).collect():
        found.setdefault((r.vector, r.n_pages), set()).update(r.tokens)
    assert {frozenset(c) for c in found.values()} <= want and sum(map(len, found.values())) >= 0.9 * sum(map(len, want))


def test_repeated_article_is_no_template(spark):
    page = "<body><div class='ad'>Buy {n}</div><article><h1>Same title</h1><p>The same long paragraph again and again.</p><p>{n}</p></article></body>"
    rows = [(n, f"http://copies.example/{n}", page.format(n=n)) for n in range(12)]
    got = {r.page_id: r.text for r in html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[7] == "Same title The same long paragraph again and again. 7"


def test_names_in_an_article():
    text = html_text.main_text
    assert text("<article><div class='share-price'>12</div><section id='search-algorithms'>s <span hidden>no</span>t</section></article>", None) == "12 s t"
    assert text("<article><div class='ad-slot'>a</div><div class='comment-list top'>b</div><p class=sidebar>c</p>d</article>", None) == "d"
    assert text("<p title=it's>One</p><p>Two</p><p>Three don't</p>", None) == "One Two Three don't"
    assert text("<p data-x='a>b' class=\"x\">One</p><p a=\"<p>\">Two</P ><br/>&lt;3<![CDATA[x]]><?y?></>", None) == "One Two <3"
    assert text("<p>a<!-->b<!-- c --!> -->d<script>x</scripty></script >e<a href='x", None) == "ab -->d e"


@pytest.mark.parametrize("piece", ['<a title="x ', "<div>", "<p>", "</p>", "<b><div>", "<u><div><i><i></u>", "<!--", "<li>", "&amp", "<", "<a =", "<table><tr><td>", "<h1 a='"])
def test_hostile_pages_take_linear_time(piece):
    took = []
    for size in (100_000, 400_000):
        began = time.process_time()
        html_text.main_text((piece * (size // len(piece) + 1))[:size], None)
        took.append(time.process_time() - began)
    assert took[1] < 8 * max(took[0], 0.02)
