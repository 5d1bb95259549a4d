"""Page text, WARC, mixing, quality, SentencePiece and nearest neighbours."""

import gzip
import hashlib
import io
import random
import subprocess
import sys
import time

import numpy as np
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from hearken.llm import mixing, nearest, page_text, quality, warc
from hearken.llm import sentencepiece_codec as codec

PAGES = "page_id long, url string, html string, host string, text string"


def page(body, **kw):
    return f"<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style></head><body>{body}</body></html>"


@pytest.mark.parametrize(
    "html, text",
    [
        (None, ""), ("", ""), ("plain &amp; simple", "plain & simple"),
        ("<nav><a href=x>Menu</a></nav><article><h1>Ti&eacute;\n tle</h1><p><b>One<br><p>two &lt;b&gt;  three<div class='ad'>buy</div></article><footer>f</footer>", "Tié tle\n\nOne\n\ntwo <b> three"),
        ("<div class=sidebar>s</div><main><p>a</p><section id='comments'><p>reader</p></section><form><p>f</p></form></main>", "a"),
        ('<article><p>x<script>var t="</p>";</script>y</p><!-- <p>no</p> --><aside>z</aside></article>', "xy"),
        ("<body><div role='navigation'>n</div><p>only text</p><div style='display: none'>h</div><div class='cookie-notice'>c</div>", "only text"),
        ("<article><header><h1>in</h1></header><ul><li>a<li>b</ul><table><tr><td>c<td>d</table></article><header>out</header>", "in\n\na\n\nb\n\nc\n\nd"),
        ("<article><p>one <i>two</i><b> three</b></article>", "one two three"),
        # readers' articles, teasers, entry headers, names that only look like parts of a page
        ("<main><p>story</p><article class='comment'>reader says</article></main>", "story"),
        ("<div><p>The story, told at length.</p></div><article><a href=x>Other story</a></article>", "The story, told at length.\n\nOther story"),
        ("<main><h1>Title</h1><p>Lead</p><article>teaser</article></main>", "Title\n\nLead\n\nteaser"),
        ("<article><header class='entry-header'><h1>Title</h1></header><p class='share-price'>up</p></article>", "Title\n\nup"),
        ("<div class='content with-sidebar'><p>a</p></div><div class='has-nav'>b</div><div class='social-science search-results'>c</div>", "a\n\nb\n\nc"),
        ("<div class='page-footer'>f</div><div class='commentList'>c</div><div id='AdBox'>ad</div><div class='post-header'><h1>t</h1></div>", "t"),
        # raw elements and quotes without an end
        ("<p>a</p><button>b<p>c</p><select><option>d</p><p>e</p>", "a\n\nc\n\ne"),
        ("<p>a</p><script>b<p>c</p>", "a"), ("<p>a</p><!-- b <p>c</p>", "a"),
        ('<p>a</p><div class="x>b</div><p>c</p>', "a\n\nb\n\nc"), ("<p>1 < 2 <3 and a<b", "1 < 2 <3 and a<b"), ("<p>x &#99999999999999999999;", "x \ufffd"),
        ("<article><p>" + "long " * 100 + "</p></article>", ("long " * 100).strip()),
        # forms and named elements that hold the main element or the page's text; small forms
        ("<form id=aspnetForm><main><p>story</p></main></form>", "story"), ("<form><article><p>a</p></article></form><footer>f</footer>", "a"),
        ("<nav>n</nav><form id=form1><div><p>The whole story of the page.</p><input type=hidden></div></form>", "The whole story of the page."),
        ("<p>The page has text here.</p><form><p>Login name</p></form>", "The page has text here."), ("<div class=widget><main><p>a</p></main></div>", "a"),
        ("<div hidden><main><p>a</p></main></div><p>b</p>", "b"), ("<p>The page has text.</p><form><div><form><p>in</p></form></div></form>", "The page has text."),
        # names within an article: elements of text, parts with controls or mostly links, adverts
        ("<article><h2 class='related'>Related work</h2><p class='comment'>b</p><p class='social'>c</p><p class=ad>buy</p></article>", "Related work\n\nb\n\nc"),
        ("<article><p>a</p><section class='search'><p>How search works</p></section><div class='ad-hoc'>net</div></article>", "a\n\nHow search works\n\nnet"),
        ("<article><p>a</p><section class='search'><p>Find</p><input name=q></section><div class=share><a href=x>Tweet</a> <a href=y>Mail</a></div></article>", "a"),
        ("<article><menu><li>one<li>two</menu><section id=comments><article><p>r</p></article></section></article>", "one\n\ntwo"),
        # an article that holds most of the text is the main text; one that doesn't isn't
        ("<div>Top stories</div><article><p>" + "long " * 20 + "</p></article><div>Copyright 2024 x</div>", ("long " * 20).strip()),
        ("<h1>Title</h1><div>Top</div><article><p>" + "long " * 20 + "</p></article>", "Title\n\n" + ("long " * 20).strip()),
    ],
)
def test_main_text(html, text):
    assert page_text.main_text(html or "") == text


@pytest.mark.parametrize("unit", ['<a b="x ', "<a b='x>", '<x "', "<div>", "<button>", "<p", "</p>", "<!--", "<![CDATA[", "<!", "&#9", "a=", "<li><p>", "<svg>", "<b>&amp;", "<article class=a><h1>", "<form><p>", "<article><div class=share>x"])
def test_broken_html_takes_linear_time(unit):
    start = time.process_time()
    page_text.main_text(unit * (1_000_000 // len(unit)))
    assert time.process_time() - start < 8
    start = time.process_time()
    page_text.main_text('<a b="x ' * 125_000)
    assert time.process_time() - start < 2


def plain_pages(n):
    """A host that marks nothing: a link list, a box whose text varies, a fixed notice over 300 letters, a story, a footer that varies."""
    notice = "This notice stands on every page. " * 12
    body = lambda i: (
        f"<div><a href=a>Home</a> <a href=b>News</a></div><div><p>{notice}</p></div>"
        f"<div><p>Story {i} about thing {i * 7}, told at some length here.</p><p>More {i}: {'word ' * (i % 5 + 9)}</p></div>"
        + "".join(f"<div><a href={k}>Older story {k}</a></div>" for k in range(i, i + i % 3 + 1))
    )
    return [page(body(i)) for i in range(n)]


def test_templates_without_semantic_tags(spark):
    """Fixed lines and link lists go, what varies stays; without the template the result is another."""
    rows = [(i, f"https://Plain.example/{i}", h, None, None) for i, h in enumerate(plain_pages(12))]
    rows += [(99, "https://other.example/", page("<p>Fixed line of the site</p>"), None, None), (100, None, None, None, None), (101, "::bad::", "", None, None)]
    rows += [(None, "https://under_score.example/", h, None, None) for h in plain_pages(5)] + [(200 + i, "https://copies.example/", page("<p>All the same</p><p>here</p>"), None, None) for i in range(6)]
    got = {r.page_id: r for r in page_text.extract(spark.createDataFrame(rows, PAGES)).collect()}
    text = lambda i: f"Story {i} about thing {i * 7}, told at some length here.\n\nMore {i}: {('word ' * (i % 5 + 9)).strip()}"
    for i in range(12):
        assert got[i].text == text(i) and got[i].n_chars == len(got[i].text)
    assert page_text.main_text(rows[3][2]) != text(3)
    assert got[99].text == "Fixed line of the site" and got[100].text == got[101].text == "" and got[203].text == "All the same\n\nhere"
    assert page_text.extract(spark.createDataFrame([], PAGES)).count() == 0
    assert sorted(r.text for r in page_text.extract(spark.createDataFrame(rows, PAGES)).filter("page_id is null").collect()) == sorted(text(i) for i in range(5))


@pytest.mark.parametrize("n", [3, 8])
def test_fixed_text_of_articles_stays(spark, n):
    """Headings and bylines that all pages of a host share stay within the article and go outside of it, on hosts with and without a template."""
    body = lambda i: (
        f"<div>Cooking for all</div><div><a href=/>Home</a></div><article><h1>Dish {i}</h1><p>By Ann Lee</p><h2>Ingredients</h2><p>{i} eggs and {i * 3} more things {'word ' * (20 + i)}</p>"
        f"<h2>Method</h2><p>Stir {i} times.</p><p><a href=/all>All dishes of the site</a></p></article><div>Copyright of the site</div>"
    )
    rows = [(i, f"https://dishes.example/{i}", page(body(i)), None, None) for i in range(n)]
    linked = "" if n > 3 else "\n\nAll dishes of the site"  # only a template tells that a line of links is on every page
    for r in page_text.extract(spark.createDataFrame(rows, PAGES)).collect():
        i = r.page_id
        assert r.text == f"Dish {i}\n\nBy Ann Lee\n\nIngredients\n\n{i} eggs and {i * 3} more things {('word ' * (20 + i)).strip()}\n\nMethod\n\nStir {i} times.{linked}"


def test_templates_judge_whole_slots(spark, monkeypatch):
    """An unmarked box that varies lies outside the article; a class of headings inside nests in it; joined by host as well as broadcast."""
    rows = []
    for i in range(10):
        parts = "".join(f"<h2>Part {i}.{k}</h2>" + "".join(f"<p>text {i} and more {x}</p>" for x in range(k + 1 + i % 2)) for k in range(i % 4 + 1))
        rows.append((i, f"http://h.example/{i}", page(f"<nav><a>n{i}</a></nav><div class=x9>special offer {i}</div><article><h1>T{i}</h1>{parts}</article><div>seen {i} times</div>"), None, None))
    rows.append((77, "http://h.example/other", page("<p>another kind of page</p>"), None, None))
    d = spark.createDataFrame(rows, PAGES)
    for most in (page_text.BROADCAST_BYTES, 0):
        monkeypatch.setattr(page_text, "BROADCAST_BYTES", most)
        got = {r.page_id: r.text.split("\n\n") for r in page_text.extract(d).collect()}
        for i in range(10):
            want = [f"T{i}"]
            for k in range(i % 4 + 1):
                want += [f"Part {i}.{k}", *[f"text {i} and more {x}" for x in range(k + 1 + i % 2)]]
            assert got[i] == want
        assert got[77] == ["another kind of page"]


def test_classes_equal_plain_deduction(spark):
    """Occurrence vectors, kept whole, give the same classes; orders and nesting are those of the pages."""
    rnd = random.Random(1)
    html = [page("".join(f"<section><h2>s{rnd.randrange(3)}</h2>{'<p>x</p><ul><li>a</li></ul>' * k}</section>" for k in rnd.choices([1, 2, 3], k=rnd.randrange(1, 4))) + "<div><p>end</p></div>") for _ in range(9)]
    html += html[:2]  # repeated rows
    pages_ = [page_text.Page(h) for h in html]
    vectors, want = {}, {}
    for t in {t for p in pages_ for t in p.tokens}:
        vectors[t] = tuple(p.tokens.count(t) for p in pages_)
    for t, v in vectors.items():
        if sum(x > 0 for x in v) >= 0.6 * len(html):
            want.setdefault(v, set()).add(t)
    kind = {t: w for p in pages_ for t, w in p.what.items()}
    want = {frozenset(c) for c in want.values() if any(kind[t] != "text" for t in c)}
    d = spark.createDataFrame([(i, "http://h.example/", h, "h", None) for i, h in enumerate(html)], PAGES)
    got = page_text.token_classes(d.select("host", F.xxhash64("page_id").alias("key"), "html")).collect()
    assert {frozenset(x["token"] for x in c) for c in got[0].classes} == want and len(got) == 1
    classes = [tuple(sorted(c)) for c in want]
    for p in pages_:
        where, seen = page_text.chains(p, classes)
        for c, order in seen.items():
            s = [t for t in p.tokens if t in classes[c]]
            assert not order or all(tuple(s[k : k + len(order)]) == order for k in range(0, len(s), len(order)))
        for (at, *_), (own, *gaps) in zip(p.blocks, where, strict=True):
            open_ = [c for c, order in seen.items() if order and (k := sum(t in order for t in p.tokens[:at]) % len(order)) and k > 0]
            assert {g >> 32 for g in gaps} == set(open_)
            assert all(sum(t in seen[g >> 32] for t in p.tokens[:at]) % len(seen[g >> 32]) == (g & 0xFFFFFFFF) + 1 for g in gaps)


def test_warc_round_trip(spark):
    big = "é<p>" * 60
    rows = [(3, "u3", big, None, None), (1, "u\r\n1", big, None, None), (2, None, big + "x", None, None), (4, "u", "short", None, None), (5, "u", "short", None, None), (6, "u", None, None, None), (7, "u", "x" * 300_000, None, None), (8, "u", big, None, None)]
    got = {r.page_id: r for r in warc.round_trip(spark, spark.createDataFrame(rows, PAGES).repartition(3)).collect()}
    for p, _, html, _, _ in rows:
        b = (html or "").encode()
        assert (got[p].payload_bytes, got[p].payload_digest) == (len(b), hashlib.sha256(b).hexdigest())
    assert {p: (r.record_type, r.refers_to) for p, r in got.items() if r.record_type == "revisit"} == {3: ("revisit", 1), 8: ("revisit", 1)}
    assert warc.round_trip(spark, spark.createDataFrame([], PAGES)).count() == 0


def test_warc_stores(spark, tmp_path):
    """Hadoop's schemes of S3 are those that workers know; html isn't shuffled while revisits are few, and many give the same."""
    assert warc.arrow_uri("s3a://b/x") == warc.arrow_uri("s3n://b/x") == "s3://b/x" and warc.arrow_uri("hdfs://n/x") == "hdfs://n/x"
    rows = [(i % 7, f"u{i}", f"<p>{'x' * (100 + i % 5)}</p>", None, None) for i in range(40)] + [(None, "u", "<p>" + "x" * 100 + "</p>", None, None)]
    pages_ = spark.createDataFrame(rows, PAGES).repartition(3)
    plan = warc.write_archives(pages_, f"file://{tmp_path}/a")._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "ShuffledHashJoin" not in plan and "SortMergeJoin" not in plan
    few = sorted(map(repr, warc.round_trip(spark, pages_).collect()))
    with pytest.MonkeyPatch.context() as m:
        m.setattr(warc, "DROPPED", 0)
        assert sorted(map(repr, warc.round_trip(spark, pages_).collect())) == few
    assert sum("revisit" in r for r in few) > 10


def test_warc_framing():
    p = b"<p>body</p>" * 30
    d = hashlib.sha256(p).hexdigest()
    one = warc.page_record(1, "u", p, d, "response", None, "2024-01-01T00:00:00Z")
    two = warc.page_record(2, "u", p, d, "revisit", 1, "2024-01-01T00:00:00Z")
    got = list(warc.read_records(io.BytesIO(one + two), with_payload=True))
    assert [(r["type"], r["bytes"], r["digest"], r["payload"]) for r in got] == [("response", len(p), d, p), ("revisit", len(p), d, b"")]
    assert got[1]["refers_to"] == got[0]["id"] == "<urn:page:1>"
    raw = gzip.decompress(one)
    assert raw.startswith(b"WARC/1.1\r\n") and raw.endswith(b"\r\n\r\n") and len(list(warc.read_records(io.BytesIO(gzip.compress(raw))))) == 1
    for bad in (raw.replace(b"body", b"bodY", 1), raw[:-4], raw.replace(b"Content-Length: 4", b"Content-Length: 3", 1), raw + b"more"):
        with pytest.raises(warc.WarcError):
            list(warc.read_records(io.BytesIO(gzip.compress(bad))))
    with pytest.raises(warc.WarcError):
        list(warc.read_records(io.BytesIO(one[:-20])))


DOCS = "doc_id long, text string, lang string, source string, n_chars long, size long, target double"


def sized(spark, rows):
    return spark.createDataFrame([(d, t, None, s, None, 1, 0.5) for d, t, s in rows], DOCS)


def plain_targets(sizes, most=3):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    w, total, capped = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}, sum(sizes.values()), {}
    while True:
        free = [s for s in names if s not in capped]
        rest = total - sum(capped.values())
        share = {s: rest * w[s] / sum(w[x] for x in free) for s in free} if free else {}
        over = [s for s in free if share[s] > most * sizes[s]]
        if not over:
            return capped | share
        capped |= {s: float(most * sizes[s]) for s in over}


def test_mixing(spark):
    rnd = random.Random(2)
    rows = [(i, " ".join(["w"] * rnd.choice([1, 3, 10, 80, 300])), rnd.choice(["a", "b", "B", "é", None, "hot", "hot", "hot"])) for i in range(600)]
    rows += [(1000, None, "a"), (1001, "", "b"), (1002, "one", "tiny")]
    d = sized(spark, rows)
    got = mixing.mix(d).collect()
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + len((t or "").split())
    want = plain_targets(sizes)
    assert len(got) == len(rows) and all(abs(r.target - want[r.source]) < 1e-6 and r.source_size == sizes[r.source] and r.taken <= 3 * r.size for r in got)
    for s, t in want.items():
        taken = sum(r.taken for r in got if r.source == s)
        assert abs(taken - t) <= max(0.02 * t, 40), (s, taken, t)
    again = mixing.mix(d.repartition(7)).collect()
    assert sorted((r.doc_id, r.taken) for r in got) == sorted((r.doc_id, r.taken) for r in again)
    m = mixing.mixed_documents(d)
    assert m.columns == d.columns and m.count() == sum(r.times for r in got)
    # repeated rows, and rows of one id, source and size whose texts differ, make up what the mix takes
    more = sized(spark, rows[:40] + rows[:40] + rows[:10] + [(5, rows[5][1].replace("w", "v"), rows[5][2]), (None, "a b", None), (None, "a c", None)])
    took = {(r.doc_id, r.size): r.n for r in mixing.mix(more).groupBy("doc_id", "size").agg(F.sum("times").alias("n")).collect()}
    n = {(r.doc_id, r.size): r.n for r in mixing.mixed_documents(more).groupBy("doc_id", F.size(F.split("text", " ")).alias("size")).agg(F.count(F.lit(1)).alias("n")).collect()}
    assert n == {k: v for k, v in took.items() if v}
    assert mixing.mix(sized(spark, [])).count() == 0 and mixing.mix(sized(spark, [(1, None, None)])).first().taken == 0


def test_flights_of_several_rounds(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK", 16)
    rnd = random.Random(3)
    rows = [(i, " ".join(["w"] * rnd.randrange(1, 50)), "ab"[i % 2]) for i in range(700)]
    got = mixing.mix(sized(spark, rows)).collect()
    assert len(got) == 700
    for s in "ab":
        own = [r for r in got if r.source == s]
        assert abs(sum(r.taken for r in own) - own[0].target) <= 60


def test_flight_keeps_the_balances():
    rng = np.random.default_rng(0)
    for n in (1, 2, 3, 40, 500):
        p, size = rng.random(n), rng.integers(1, 100, n).astype(float)
        q = mixing.flight(p, size, rng.random(n))
        assert abs(q.sum() - p.sum()) < 1e-6 and abs(q @ size - p @ size) < 1e-4 and ((q > 0) & (q < 1)).sum() <= 2


def test_quality_held_out(spark):
    """Accuracy on labels that the model has not seen."""
    base = "/root/testdata/sf0.01"
    d, labels = spark.read.parquet(f"{base}/documents.parquet"), spark.read.parquet(f"{base}/labels.parquet")
    half = F.pmod(F.xxhash64("doc_id"), F.lit(2))
    s = quality.score(d, labels.filter(half == 0))
    n, right, clean, lost = s.join(labels.filter(half == 1), "doc_id").agg(F.count(F.lit(1)), F.count_if(F.col("accepted") == (F.col("quality") == 1)), F.count_if(F.expr("quality = 1")), F.count_if(F.expr("quality = 1 and not accepted"))).first()
    assert s.count() == d.count() and right / n >= 0.93 and lost / clean <= 0.03


def test_quality_edges(spark):
    labels = "doc_id long, quality int, toxic int"
    d = sized(spark, [(1, None, None), (2, "", "s"), (3, "good text here", "s"), (3, "good text here", "s")])
    assert quality.score(d, spark.createDataFrame([], labels)).filter("accepted and p_good = 1").count() == 4
    assert quality.keep_good(d, spark.createDataFrame([(3, 1, 0)], labels)).count() == 4
    two = spark.createDataFrame([(2, 0, 0), (3, 1, 0), (3, None, None), (None, 1, 1)], labels)
    assert quality.score(d, two).count() == 4 and quality.score(sized(spark, []), two).count() == 0


def test_sparse_sites_shrink(spark):
    rows = [("big", "x", 0.9)] * 200 + [("bad", "x", 0.1)] * 200 + [("new", "x", 0.0)] + [("big", "y", 1.0)]
    rates = quality.site_rates(spark.createDataFrame(rows, "host string, path string, k double"), ["host", "path"])
    r = {(x.host, x.path): x.rate for x in rates.withColumn("rate", F.expr("(k + strength * m) / (n + strength)")).collect()}
    assert r[("bad", "x")] < 0.15 < r[("new", "x")] < 0.5 and 0.85 < r[("big", "y")] < 1.0


def plain_posterior(rows):
    """The hierarchical posterior, one document after another."""
    logit = lambda x: np.log(x / (1 - x))
    near = lambda x: min(max(x, 1e-6), 1 - 1e-6)
    base = sum(r[4] for r in rows) / len(rows)
    parent, levels = {(): base}, []
    for depth in (1, 2):
        site = {}
        for r in rows:
            site.setdefault(r[1 : 1 + depth], []).append(r[4])
        between = sum(len(k) * ((sum(k) / len(k) - parent[s[:-1]]) ** 2 - parent[s[:-1]] * (1 - parent[s[:-1]]) / len(k)) for s, k in site.items()) / len(rows)
        spread = sum(len(k) * parent[s[:-1]] * (1 - parent[s[:-1]]) for s, k in site.items()) / len(rows)
        strength = max(1.0, spread / max(between, 1e-6) - 1.0)
        levels.append((site, dict(parent), strength))
        parent |= {s: (sum(k) + strength * parent[s[:-1]]) / (len(k) + strength) for s, k in site.items()}
    site, up, strength = levels[-1]
    out = []
    for i, host, path, p, k in rows:
        others = site[host, path]
        rate = (sum(others) - k + strength * up[host,]) / (len(others) - 1 + strength)
        out.append((i, rate, 1 / (1 + np.exp(-(logit(near(p)) + logit(near(rate)) - logit(near(base)))))))
    return out


def test_posterior_equals_plain_one(spark):
    rnd = random.Random(6)
    rows = []
    for i in range(400):
        host, path, p = rnd.choice(["a", "a", "b", "c", None]), rnd.choice(["x", "y", None, str(i % 40)]), rnd.random()
        rows.append((i, host, path, p, float(rnd.random() < 0.5) if i % 3 == 0 else p))
    got = {r.doc_id: (r.p_site, r.p_good, r.accepted) for r in quality.posterior(spark.createDataFrame(rows, "doc_id long, host string, path string, p double, k double")).collect()}
    for i, rate, good in plain_posterior(rows):
        assert abs(got[i][0] - rate) < 1e-9 and abs(got[i][1] - good) < 1e-9 and got[i][2] == (good >= 0.5)


def test_evidence_and_ratios(spark):
    m, ids = quality.evidence("One two two.\nTHREE 4 ### é\n\nOne two two.")
    assert len(m) == 10 and m[1] == np.log1p(10) and m[3] == 7 / 10 and m[8] == 2 / 3 and abs(m[7] - 1 / 40) < 1e-9 and (np.diff(ids) > 0).all()
    assert quality.evidence("")[0][:2] == [1.0, 0.0] and not len(quality.evidence("")[1]) and len(quality.evidence("x" * 3_000_000)[1]) == 2
    rows = [([1, 2], 1.0, 0), ([1], 0.0, 1), ([2], 1.0, 1), ([1, 65540], 0.0, 0)]
    r = quality.ratios(spark.createDataFrame(rows, "ids array<int>, label double, half int"))
    want = lambda c1, n1, c0, n0: np.log((c1 + 1) / (n1 + 2)) - np.log((c0 + 1) / (n0 + 2))
    assert np.allclose(r[2, [1, 2, 65540]], [want(1, 2, 2, 2), want(2, 2, 0, 2), want(0, 2, 1, 2)]) and np.isclose(r[0, 1], want(0, 1, 1, 1)) and np.isclose(r[1, 1], want(1, 1, 1, 1))


@pytest.fixture(scope="module")
def pieces():
    return sentencepiece.SentencePieceProcessor(model_file=codec.DEFAULT_MODEL), codec.Codec(open(codec.DEFAULT_MODEL, "rb").read())


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.sampled_from("the in▁ \n\t.,!%²5é日🙂"), st.characters(codec="utf-8")), max_size=60), max_size=4))
def test_ids_equal_the_librarys(texts):
    sp, own = _both()
    assert [x.tolist() for x in own.encode_batch(texts)] == sp.encode(texts)
    for ids in sp.encode(texts):
        assert own.model.decode(ids) == sp.decode(ids)


def _both(cache=[]):  # noqa: B006
    if not cache:
        cache += [sentencepiece.SentencePieceProcessor(model_file=codec.DEFAULT_MODEL), codec.Codec(open(codec.DEFAULT_MODEL, "rb").read())]
    return cache


def test_words_and_long_texts(pieces):
    sp, own = pieces
    rnd = random.Random(0)
    texts = ["internationalization unbelievable thththerereonedandy " * 3, "a" * 20000, "", " ", "  two  spaces  ", "".join(rnd.choice("etaoinshrdlu") for _ in range(5000))]
    assert [x.tolist() for x in own.encode_batch(texts)] == sp.encode(texts)


LONG = """
import random, resource, sys, time
import sentencepiece
from hearken.llm import sentencepiece_codec as codec
own = codec.Codec(open(codec.DEFAULT_MODEL, "rb").read())
rnd = random.Random(0)
text = "".join(rnd.choices("etaoinshrdluéüç日", k=1_000_000))
before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
ids = own.encode_batch([text, text[:700_000] + "x"])
used = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before
sp = sentencepiece.SentencePieceProcessor(model_file=codec.DEFAULT_MODEL)
for t, x in zip((text, text[:700_000] + "x"), ids):
    for k in range(3):  # the library on a part takes long enough; merges don't reach far
        part = t[k * 200_000 : k * 200_000 + 20_000]
        assert own.encode_batch([part])[0].tolist() == sp.encode(part)
    assert own.model.decode(x.tolist()) == t
print(used)
"""


def test_a_million_letters_in_a_row():
    """Memory is linear in the length of a word."""
    out = subprocess.run([sys.executable, "-c", LONG], capture_output=True, text=True)
    assert out.returncode == 0, out.stderr
    assert int(out.stdout) < 300_000


def test_unigram_viterbi():
    """A tiny unigram model: the best split is that of all splits."""
    scores = {"a": -3.0, "b": -3.1, "ab": -4.0, "ba": -3.9, "aba": -6.5, "▁": -2.0, "▁a": -4.1, "▁ab": -5.5}
    field = lambda n, b: bytes([n << 3 | 2, len(b)]) + b
    piece = lambda p, s, k: field(1, field(1, p.encode()) + b"\x15" + np.float32(s).tobytes() + bytes([3 << 3, k]))
    m = codec.Model(piece("<unk>", 0, 2) + b"".join(piece(p, s, 1) for p, s in scores.items()) + field(2, b"\x18\x01"))

    def best(w):
        return max((scores[w[:i]] + (best(w[i:])[0] if w[i:] else 0.0), [w[:i], *(best(w[i:])[1] if w[i:] else [])]) for i in range(1, len(w) + 1) if w[:i] in scores)

    for w in ("▁abba", "▁ababa", "▁aabbab", "▁b"):
        ids = np.frombuffer(m.encode_words([w, "▁ab"])[w], np.int32).tolist()
        assert abs(sum(scores[m.pieces[i]] for i in ids) - best(w)[0]) < 1e-6 and "".join(m.pieces[i] for i in ids) == w


def test_encode_table(spark):
    d = sized(spark, [(1, None, "s"), (2, "", "s"), (3, "a b\nc  d ²", "s"), (3, "a b\nc  d ²", "s")]).withColumn("ids", F.lit("clash"))
    got = codec.encode(d)
    assert got.filter("decoded = coalesce(text, '')").count() == 4 and got.filter("n_ids = 0").count() == 2
    assert codec.decode(got.drop("decoded")).filter("decoded = coalesce(text, '')").count() == 4
    assert codec.encode(sized(spark, [])).count() == 0


VECTORS = "vec_id long, embedding array<float>, label int"


def brute_nearest(x, ids, every=20, k=20):
    out = {}
    for i in np.flatnonzero(ids % every == 0):
        s = x @ x[i]
        order = [j for j in np.lexsort((ids, -s)) if j != i][:k]
        out[int(ids[i])] = [int(ids[j]) for j in order]
    return out


@pytest.mark.parametrize("rows, queries", [(4096, 2048), (50, 3)])
def test_recall(spark, monkeypatch, rows, queries):
    monkeypatch.setattr(nearest, "ROWS", rows)
    monkeypatch.setattr(nearest, "QUERIES", queries)
    monkeypatch.setattr(nearest, "LIST_ROWS", 100)
    monkeypatch.setattr(nearest, "SAMPLE", 500)
    rng = np.random.default_rng(4)
    x = rng.standard_normal((1500, 16)) * rng.uniform(0.5, 2, (1500, 1))
    x[300:600] = x[300]  # a very common vector
    x = x.astype(np.float32).astype(float)
    ids = rng.permutation(1500) + 1
    df = spark.createDataFrame([(int(i), v.tolist(), 0) for i, v in zip(ids, x, strict=True)], VECTORS)
    got = {}
    for r in nearest.search(df).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    at = {int(i): n for n, i in enumerate(ids)}
    want, hit = brute_nearest(x, ids), 0
    for q, found in got.items():
        assert [r for r, _, _ in found] == list(range(1, 21)) and all(abs(s - x[at[q]] @ x[at[v]]) < 1e-9 for _, v, s in found)
        assert found == sorted(found, key=lambda f: (-f[2], f[1]))
        hit += len({v for _, v, _ in found} & set(want[q]))
    assert got.keys() == want.keys() and hit / (20 * len(want)) >= 0.9


def test_probes_hold_for_rows_outside_the_fit():
    rng = np.random.default_rng(5)
    x = rng.standard_normal((6000, 16))
    x /= np.linalg.norm(x, axis=1)[:, None]
    fit, held, asked = x[:1200], x[1200:1600], x[5900:]
    centres = nearest.fit_centres(fit, len(fit) // nearest.FIT_ROWS)
    probes = nearest.lists_to_probe(held, held, held, np.arange(400), centres, 20)
    home, probed = nearest.nearest_centres(x, centres, 1)[:, 0], nearest.nearest_centres(asked, centres, probes)
    top = np.argsort(-(asked @ x.T), axis=1)[:, 1:21]
    assert probes < len(centres)
    assert np.mean([np.isin(home[t], p).mean() for t, p in zip(top, probed, strict=True)]) >= 0.9


def test_vectors_that_take_no_part(spark):
    rows = [(20, [1.0, 0.0], 0), (1, [2.0, 0.0], 0), (2, None, 0), (3, [0.0, 0.0], 0), (4, [float("nan"), 1.0], 0), (5, [1.0, None], 0), (6, [float("inf"), 1.0], 0), (7, [], 0), (None, [1.0, 1.0], 0), (8, [1.0, 1.0, 1.0], 0), (40, [0.0, 1.0], 0)]
    got = [(r.query_id, r.rank, r.vec_id, r.score) for r in nearest.search(spark.createDataFrame(rows, VECTORS)).orderBy("query_id", "rank").collect()]
    assert got == [(20, 1, 1, 2.0), (20, 2, 40, 0.0), (40, 1, 1, 0.0), (40, 2, 20, 0.0)]
    assert nearest.search(spark.createDataFrame([], VECTORS)).count() == 0
