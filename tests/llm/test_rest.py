"""Top-k, URL filter, HTML text, toxicity and PII on small inputs."""

import math
import random
import re
import time

import pytest
from pyspark.sql import functions as F

from pairloom.llm import html_text, pii, topk, toxicity, url_filter


# Exact top-k

def brute_top(rows, k, wanted):
    usable = [(i, [math.floor(1024 * float(x)) for x in v]) for i, v in rows
              if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q in sorted({i for i, _ in usable if wanted(i)}):
        best = {}
        for a, u in usable:
            for b, w in usable:
                if a == q and b != q and len(u) == len(w):
                    score = sum(x * y for x, y in zip(u, w, strict=True))
                    best[b] = max(score, best.get(b, score))
        ranked = sorted(best.items(), key=lambda x: (-x[1], x[0]))[:k]
        out += [(q, r + 1, b, s) for r, (b, s) in enumerate(ranked)]
    return out


def test_top_k_equals_all_products(spark, monkeypatch):
    draw = random.Random(1)
    rows = [(i, [draw.gauss(0, draw.choice([0.01, 1, 3])) for _ in range(6)]) for i in range(160)]
    rows += [(200 + i, [1.0] * 6) for i in range(30)]  # ties
    rows += [(10, rows[10][1]), (20, [0.5] * 6), (20, [9.0, 0, 0, 0, 0, -9.0])]  # a repeated row, a key with two more vectors
    rows += [(300, None), (310, [1.0, None, 0, 0, 0, 0]), (320, [float("nan")] * 6), (330, [float("inf")] * 6), (None, [1.0] * 6), (340, [0.0] * 6), (350, [1.0, 2.0]), (360, []), (370, [])]
    frame = spark.createDataFrame([(i, v and [x if x is None else float(x) for x in v], "x", 0) for i, v in rows], "vec_id bigint, embedding array<double>, key string, rank int").repartition(3)
    want = brute_top(rows, 5, lambda i: i % 10 == 0)
    for query_block, block, chunk in ((1024, 8192, 1024), (7, 20, 6)):
        for name, value in (("_QUERY_BLOCK", query_block), ("_BLOCK", block), ("_CHUNK", chunk)):
            monkeypatch.setattr(topk, name, value)
        got = [tuple(r) for r in topk.top_k(frame, F.col("key") % 10 == 0, k=5).orderBy("query_id", "rank").collect()]
        assert got == want
    assert topk.top_k(frame.limit(0), F.col("key") % 10 == 0).count() == 0


def test_large_numbers_stay_exact(spark):
    rows = [(0, [3.1e9, 1.0]), (1, [2.9e9, 7.0]), (2, [2.9e9, 7.5]), (3, [-1.0, 0.0])]
    got = [tuple(r) for r in topk.top_k(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>"), F.col("key") == 0, k=3).orderBy("rank").collect()]
    assert got == [(0, 1, 1, (1 << 63) - 1), (0, 2, 2, (1 << 63) - 1), (0, 3, 3, -1024 * int(1024 * 3.1e9))]


# URL filter

def test_hosts_paths_and_rules(spark):
    urls = [
        "https://A.Example.ORG/es/1?x#y", "http://example.org/en/12", "http://notexample.org/es/1", "x://org/", "http://a.com/de/1", "http://a.com/fr",
        "http://A.com#/de/", "no scheme", "", None, "a://b://c/d", "http://ÄB.net/p",
    ]
    rows = url_filter.judge(spark.createDataFrame([(i, u, "h", "t") for i, u in enumerate(urls)], "page_id bigint, url string, host string, template string")).orderBy("page_id").collect()
    assert [(r.host, r.path, r.rule, r.verdict) for r in rows] == [
        ("a.example.org", "/es/1", "example.org/es/", "block"), ("example.org", "/en/12", "example.org/en/1", "block"), ("notexample.org", "/es/1", "org/", "allow"),
        ("org", "/", "org/", "allow"), ("a.com", "/de/1", "com/de/", "block"), ("a.com", "/fr", None, "allow"), ("a.com", "", None, "allow"),
        ("", "", None, "allow"), ("", "", None, "allow"), ("", "", None, "allow"), ("b:", "//c/d", None, "allow"), ("Äb.net", "/p", None, "allow")]


def test_templates_merge_and_reject(spark):
    rules = (("block", "h.com", "/bad/1"), ("allow", "h.com", "/good/1"), ("block", "h.com", "/ugly/1"))
    urls = [f"http://h.com/{name}/{n}" for name in ("bad", "good", "ugly") for n in range(100, 220)]
    urls += [f"http://h.com/user/name{c}{d}x" for c in "abcdef" for d in "ghijkl"]
    urls += ["http://h.com/" + "/".join("abcdefghij")] * 3 + ["http://h.com/f/0123abcdef99"]
    rows = url_filter.judge(spark.createDataFrame(list(enumerate(urls)), "page_id bigint, url string").repartition(3), rules).collect()
    by = {r.path: r for r in rows}
    assert len(rows) == len(urls)
    assert by["/bad/205"].verdict == by["/ugly/205"].verdict == "block" and by["/good/205"].verdict == "allow"
    assert by["/bad/205"].template == "/bad/{n}" and by["/user/nameagx"].template == "/user/*" and by["/f/0123abcdef99"].template == "/f/{h}"
    assert by["/" + "/".join("abcdefghij")].template == "/a/b/c/d/e/f/**"
    assert url_filter.judge(spark.createDataFrame([], "page_id bigint, url string")).count() == 0


def test_like_siblings_share_a_branch(spark):
    leaves = spark.createDataFrame([("h", "", "/a", 9, 1), ("h", "", "/b", 18, 2), ("h", "", "/c", 0, 60), ("h", "", "/d", 1, 0), ("g", "", "/a", 5, 5)], "host string, parent string, template string, bad bigint, good bigint")
    got = {(r.host, r.template): r.branch for r in url_filter.merged(leaves).collect()}
    assert got == {("h", "/a"): "/a", ("h", "/b"): "/b", ("h", "/c"): "/c", ("h", "/d"): "/d", ("g", "/a"): "/a"}
    like = spark.createDataFrame([("h", "", "/a", 9, 1), ("h", "", "/b", 18, 2), ("h", "", "/d", 1, 0)], leaves.schema)
    assert {r.template: r.branch for r in url_filter.merged(like).collect()} == {"/a": "/{~}", "/b": "/{~}", "/d": "/d"}


# HTML text

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var a="<p>x</p>";</script></head><body class="has-sidebar"><nav>menu</nav>
<!-- <p>no</p> --><div class="cookie-notice">c</div><article><h1>Head &amp; {n}</h1><p><b>One  two<br>three<p>four &lt;b&gt; &eacute;
<div class="share">s</div><ul><li>a<li>b</ul><p hidden>h</p><section id="comments"><p>bad</p></section><p>tail <a title="a>b">link</a> {n}</p></article><footer>f</footer></body></html>"""


def test_article_text():
    text = html_text._Page(PAGE.format(n=1)).main_text(set())
    assert text == "Head & 1\nOne two three\nfour <b> é\na\nb\ntail link 1"


def test_template_subtrees_go_and_shared_passages_stay(spark):
    body = "<body><div><p>Same on every page</p></div><p>{text}</p></body>"
    rows = [(i, f"http://s.net/{i}", body.format(text=f"own {i}" if i % 3 else "quoted by a third"), "k", "t") for i in range(60)]
    rows += [(100, "http://o.net/1", body.format(text="x"), "k", "t"), (101, None, "<p>a", "k", "t"), (102, "u", None, "k", "t"), (103, "u", "", "k", "t"), (1, "http://s.net/1", rows[1][2], "k", "t")]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string, key string, template string").repartition(3)
    got = sorted((r.page_id, r.url or "", r.text) for r in html_text.extract(pages).collect())
    want = [(i, u or "", {100: "Same on every page\nx", 101: "a", 102: "", 103: ""}.get(i, f"own {i}" if i % 3 else "quoted by a third")) for i, u, *_ in rows]
    assert got == sorted(want)
    assert html_text.extract(pages.limit(0)).count() == 0


@pytest.mark.parametrize("source,text", [
    ("plain", "plain"), ("<p>a<p>b", "a\nb"), ("<div>a<span>b</span> c</div>d", "ab c\nd"), ("<p>a</div>b", "ab"), ("x<script>y", "x"), ("<a href='", "<a href='"),
    ("<main><p>m</p></main><p>o</p>", "m"), ("<table><tr><td>1<td>2<tr><td>3</table>", "1\n2\n3"), ("&nbsp; &#65;&#x42; &unknown;", "AB &unknown;"),
    ("<article><p>a</p><article class=comment>c</article></article>", "a"), ("<p " + "x" * 1000 + ">a" + " b" * 50_000, "a" + " b" * 50_000),
])
def test_odd_markup(source, text):
    assert html_text._Page(source).main_text(set()) == text


def test_article_text_stays_whatever_its_class():
    page = html_text._Page
    source = """<body><div class="site-header">h</div><article><div class="article-header"><h1>Title</h1></div><p class="promotion">One</p>
    <section class="related-work"><p>Two</p></section><div class="ad-slot-3">x</div><div id="cookie-notice">y</div><p class="lead">Three</p><div class="share-buttons">z</div></article></body>"""
    assert page(source).main_text(set()) == "Title\nOne\nTwo\nThree"


@pytest.mark.parametrize("odd", [
    "<a " * 300_000, "<b>" * 40_000 + "</i>" * 40_000 + "x", "<a x='>" * 60_001, "<p><b>" * 50_000, "<" * 500_000, "<!--" * 100_000, "<li>" * 50_000 + "</ul>" * 50_000,
    "<b>" * 50_000 + "<p>t</p>" * 20_000, "&" * 500_000, "<div class='" + "ad-" * 200_000 + "'>x</div>",
])
def test_odd_markup_takes_linear_time(odd):
    start = time.process_time()
    text = html_text._Page("<article><p>before</p></article>" + odd).main_text(set())
    assert text.split("\n")[0].startswith("before") and time.process_time() - start < 15


def test_generated_pages_give_their_article(spark):
    """Pages built from parts whose place in the article is known; the site's parts recur on every page of a host."""
    draw = random.Random(7)
    words = lambda: " ".join(f"{draw.choice('abcdefg')}{draw.randrange(10_000)}" for _ in range(draw.randrange(3, 9)))
    rows, want = [], {}
    for n in range(60):
        blocks, parts = [], []
        for _ in range(draw.randrange(2, 7)):
            text = words()
            kind = draw.randrange(7)
            if kind < 3:
                blocks.append(text)
                parts.append([f"<p>{text}</p>", f"<h2 class='article-title'>{text}</h2>", f"<div><section>\n {text} </section></div>"][kind])
            elif kind == 3:
                blocks.append(f"{text} & <b>")
                parts.append(f"<p>{text}\t&amp; <i>&lt;b&gt;</i>")
            else:
                parts.append([f"<div class='ad'>{text}</div>", f"<aside>{text}</aside>", f"<form><p>{text}</p></form>"][kind - 4])
        site = f"<div class='trail'>you are on host{n % 2}</div>"
        rows.append((n, f"http://host{n % 2}.org/{n}", f"<html><body><nav>menu</nav><article>{site}{''.join(parts)}<div class='comments'><p>no</p></div></article><footer>f</footer></body></html>"))
        want[n] = "\n".join(blocks)
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string").repartition(3)
    assert {r.page_id: r.text for r in html_text.extract(pages).collect()} == want


# Toxicity

def corpus(n, seed=2):
    draw = random.Random(seed)
    filler = [f"{a}{b}" for a in ("ba", "ke", "mo", "ru", "ti", "so") for b in ("lan", "ver", "dis", "mok", "pel", "rin", "tas")]
    bad = ["gronk", "Zarvex", "zarvexes", "pl1mbo", "рlimbo"]  # one with a digit, one with a Cyrillic letter
    docs, labels = [], []
    for i in range(n):
        words, toxic = draw.choices(filler, k=draw.randint(20, 200)), i % 4 == 0
        if toxic:
            for _ in range(draw.randint(1, 4)):
                words[draw.randrange(len(words))] = draw.choice(bad)
        elif i % 75 == 1:
            words[5:7] = ["gronk", "festival"]
        docs.append((i, " ".join(words)))
        labels.append((i, 1, int(toxic)))
    return docs, labels


def test_lexicon_finds_held_out_rows(spark):
    docs, labels = corpus(600)
    frame = spark.createDataFrame([(i, t, "s", 0.5) for i, t in docs] + [(9000, None, "s", 0.5), (9001, "", "s", 0.5)], "doc_id bigint, text string, terms string, score double").repartition(3)
    known = spark.createDataFrame([*labels, (None, 1, 1), (5, 1, None), (99999, 1, 1)], "doc_id bigint, quality int, toxic int")
    lexicon = toxicity.fit(frame, known)
    assert any("zarvex".startswith(t) or t.startswith("zarvex") for t in lexicon.weights) and any(p.endswith("festival") for p in lexicon.exceptions)
    scored = {r.doc_id: r for r in toxicity.score(frame, lexicon).withColumn("out", toxicity.held_out(F.col("doc_id"))).collect()}
    held = [(scored[i].score >= 0.5, bool(y)) for i, _, y in labels if scored[i].out]
    assert len(held) > 80 and sum(a == b for a, b in held) >= 0.97 * len(held)
    assert scored[9000].score == scored[9001].score < 0.5
    kept = toxicity.without_toxic(frame, known)
    assert kept.columns == frame.columns and {r.doc_id for r in kept.collect()} == {i for i, r in scored.items() if r.score < 0.5}
    assert toxicity.score(frame.limit(0), lexicon).count() == 0


def test_no_labels_or_one_class(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, "c")], "doc_id bigint, text string")
    for rows in ([], [(1, 0), (2, 0)]):
        lexicon = toxicity.fit(docs, spark.createDataFrame(rows, "doc_id bigint, toxic int"))
        assert not lexicon.weights and all(r.score < 0.5 for r in toxicity.score(docs, lexicon).collect())


def test_matching_folds_and_respects_words_and_exceptions():
    lexicon = toxicity.Lexicon({"idiot": 3.0, "ass ": 2.0}, ["village idiot"])
    machine = lexicon.automaton()
    texts = ["1D10T!", "ıdıοt", "ｉｄｉｏｔ", "preidiot", "idiots", "class assess", "an ass.", "village idiot", "the idiot of the village idiot", ""]
    assert [sum(w for *_, w, _ in toxicity._matches(machine, t)) for t in texts] == [3, 3, 3, 0, 3, 0, 2, 0, 3, 0]


# PII

BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def base_spans(text):
    out = []
    for kind, pattern in BASE.items():
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            fits = {"email": True, "ip": kind == "ip" and all(int(p) <= 255 for p in m[0].split(".")), "card": 13 <= len(digits) <= 19 and luhn(digits), "phone": 9 <= len(digits) <= 15}
            if fits[kind]:
                out.append(f"{kind}:{m.start()}:{m.end()}")
    return ",".join(out)


def test_base_spans_equal_the_patterns(spark):
    draw = random.Random(4)
    alphabet = ["@", ".", "a", "B", "-", "_", "+", " ", "(", ")", "1", "2", "0", "255", "4111111111111111", "a@b.cd", "1.2.3.4", "+1 (555) 123-4567", "é", "🎉", "\n"]
    texts = ["".join(draw.choices(alphabet, k=draw.randint(0, 40))) for _ in range(300)]
    texts += [None, "", "x" * 200_000, "1 " * 3000, "a@" + "b." * 20_000 + "c", "00255.001.1.1 256.1.1.1 1.2.3.4.5.6.7.8", "+1" + " " * 1000 + "23456789012"]
    rows = [(i, t, "b", "s") for i, t in enumerate(texts)]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string, row string, found string")
    found = pii.find_pii(frame)
    got = {r.doc_id: r.s for r in found.select("doc_id", pii.spans_text(F.col("base")).alias("s")).collect()}
    assert got == {i: base_spans(t) for i, t, *_ in rows}
    assert set(found.columns) == {*frame.columns, "base", "spans"}


def test_contexts_discover_unseen_identifiers(spark):
    rows = [(i, f"note {i} member no: user{i}@mail.com thanks") for i in range(12)]
    rows += [(50, "note z member no: AB-99812-X thanks"), (51, "order AB99x812 arrived"), (52, "member no: none"), (50, "note z member no: AB-99812-X thanks")]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = sorted((r.doc_id, r.s) for r in pii.find_pii(frame).where("size(spans) > size(base)").select("doc_id", pii.spans_text(F.col("spans")).alias("s")).collect())
    assert got == [(50, "email:18:28")] * 2
    masked = {r.doc_id: r.text for r in pii.redacted(frame).collect()}
    assert masked[50] == "note z member no: [EMAIL] thanks" and masked[3] == "note 3 member no: [EMAIL] thanks" and masked[51] == rows[13][1]


def test_redaction_of_overlaps_and_nothing(spark):
    frame = spark.createDataFrame([(1, "é +378282246310005 z 1.2.3.4", "k"), (2, None, "k"), (3, "clean", "k")], "doc_id bigint, text string, spans string")
    out = pii.redacted(frame).orderBy("doc_id").collect()
    assert [r.spans for r in out] == ["k"] * 3 and out[1].text is None and out[2].text == "clean"
    assert out[0].text == "é [PHONE] z [IP]"  # the card inside the phone number goes with it
    assert pii.redacted(frame.limit(0)).count() == 0
