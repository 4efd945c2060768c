"""Operators 3, 5, 6, 9 and 10: against brute force or held-out labels, and every odd case."""

import html as stdlib_html
import math
import random
import re

import pytest
import xxhash

from quadrille.llm import html, licenses, mixing, quality, rules

LONG = "alpha beta gamma " * 10_000
WORDS = r"[^\x20\x09-\x0D]+"


def split(text):
    return re.findall(WORDS, text or "")


def prose(rng, n):
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(1, 6))) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(11)
    out = [(i, prose(rng, rng.randint(0, 200)) + rng.choice(["", "\nline\nline\n  \nline", " ## |$ %&<>", "\x0bx\x0cy"])) for i in range(80)]
    out += [(i, "spam eggs ham " * 60) for i in range(80, 90)] + [(i, " ".join(w + "###" for w in prose(rng, 90).split())) for i in range(90, 110)]
    return out + [(200, None), (201, ""), (202, LONG), (None, prose(rng, 60)), (3, out[3][1]), (203, "one two three one two three"), (204, "a b"), (205, "é\U0001f642 x #   y"), (206, "a a a a")]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([(i, t, None if (i or 0) % 7 == 0 else f"s{(i or 0) % 5}", "en", "x", "x", 1) for i, t in rows], "doc_id BIGINT, text STRING, source STRING, lang STRING, kept STRING, ratio STRING, position INT")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, int(not 80 <= i < 110)) for i in range(0, 110, 2)] + [(None, 1), (5, None)], "doc_id BIGINT, quality INT")


def h64(*values):
    h = 42
    for v in values:
        h = xxhash.xxh64_intdigest(v if isinstance(v, bytes) else (v & (1 << 64) - 1).to_bytes(8, "little"), h)
    return h - (1 << 64) if h >> 63 else h


def buckets(text):
    h = [h64(w.encode()) for w in split(text)]
    return [x % rules.BUCKETS for x in [*h, *(h64(a, b) for a, b in zip(h, h[1:]))]]


def test_rules_against_brute_force(docs, labels, rows):
    good = {i for i in range(0, 110, 2) if not 80 <= i < 110}
    raw, trusted = {}, {}
    for i, t in rows:
        for b in buckets(t):
            raw[b] = raw.get(b, 0) + 1
            if i in good:
                trusted[b] = trusted.get(b, 0) + 1
    n, m, prior = sum(raw.values()), sum(trusted.values()), rules.PRIOR * rules.BUCKETS
    ratio = {b: math.log((trusted.get(b, 0) + prior * raw[b] / n) / (m + prior) / (raw[b] / n)) for b in raw}
    want = []
    for i, t in rows:
        w = split(t)
        threes = list(zip(w, w[1:], w[2:]))
        hit = {k + d for k, x in enumerate(threes) if threes.count(x) > 1 for d in range(3)} if len(w) < 1000 else set(range(len(w)))
        lines = [x for x in (t or "").split("\n") if split(x)]
        g = buckets(t)
        score = sum(ratio[b] for b in g) / len(g) if g else 0.0
        failed = len(w) < 50 or 100 * len(hit) > 50 * len(w)
        want.append((i, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(hit), failed, not failed and score >= rules.KEEP_FROM, round(score, 9)))
    got = [(r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed, r.kept, round(r.ratio, 9)) for r in rules.judge(docs, labels).collect()]
    key = lambda r: tuple(map(str, r[:4]))
    for a, b in zip(sorted(got, key=key), sorted(want, key=key)):
        assert a[:8] == b[:8] and abs(a[8] - b[8]) < 1e-6
    assert len(got) == len(want)


def test_rules_count_all_trusted_documents(spark):
    docs = spark.range(20_500).selectExpr("id AS doc_id", "concat('word', id % 5000) AS text")
    assert all(abs(r.ratio) < 1e-9 for r in rules.ratios(docs, docs.selectExpr("doc_id", "1 AS quality")).collect())


def test_rules_without_labels_or_rows(docs, labels):
    assert {r.ratio for r in rules.judge(docs, labels.limit(0)).collect()} == {0.0}
    assert rules.judge(docs.limit(0), labels).count() == 0


def test_rules_are_native(docs, labels):
    plan = rules.judge(docs, labels)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_quality_on_held_out_labels(spark):
    d = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    fit = labels.where("doc_id % 2 = 0")
    got = quality.judge(docs, fit, columns=["doc_id"]).join(labels.where("doc_id % 2 = 1"), "doc_id").groupBy("quality", "kept").count().collect()
    n = {(r["quality"], r["kept"]): r["count"] for r in got}
    assert n.get((1, False), 0) <= 0.002 * n[(1, True)] and n.get((0, True), 0) <= 0.05 * n[(0, False)]


def test_quality_cases(docs, labels, rows):
    got = quality.judge(docs, labels).collect()
    assert len(got) == len(rows) and all(0 < r.posterior < 1 and isinstance(r.kept, bool) for r in got)
    assert set(docs.columns) - {"kept"} <= set(got[0].asDict())
    for other in (labels.limit(0), labels.where("quality = 1")):
        assert all(r.kept for r in quality.judge(docs, other).collect())
    assert quality.judge(docs.limit(0), labels).count() == 0
    by = {r.source: r.host_posterior for r in got}
    assert len(by) == 6 and None in by


def test_sparse_sites_shrink_to_the_corpus(spark):
    scores = spark.createDataFrame([("big", "a", 3.0)] * 200 + [("bad", "a", -3.0)] * 200 + [("one", "a", -3.0)], "h STRING, p STRING, e DOUBLE")
    got = {r.h: r.path_posterior for r in quality.posteriors(scores, 0.0, host="h", path="p", evidence="e").collect()}
    assert got["big"] > 0.9 and got["bad"] < 0.1 and 0.15 < got["one"] < 0.5


def naive_targets(sizes):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: k % 3 + 1 for k, s in enumerate(names)}
    total, out, free = sum(sizes.values()), {}, set(names)
    while free:
        left = total - sum(out.values())
        level = left / sum(w[s] for s in free)
        over = {s for s in free if level * w[s] > 3 * sizes[s]}
        for s in over or free:
            out[s] = 3 * sizes[s] if over else level * w[s]
        free -= over or free
    return out


def test_mixing(docs, rows):
    plan = mixing.plan(docs).collect()
    size = {}
    for r in plan:
        size[r.source] = size.get(r.source, 0) + r.size
    want = naive_targets(size)
    taken, largest = {}, {}
    for r in plan:
        assert r.source_size == size[r.source] and abs(r.target - want[r.source]) < 1e-6 * max(1, r.target)
        assert r.taken <= 3 * r.size and r.taken == r.size * r.copies and len(r.positions) == r.copies and list(r.positions) == sorted(r.positions)
        taken[r.source] = taken.get(r.source, 0) + r.taken
        largest[r.source] = max(largest.get(r.source, 0), r.size)
    assert all(abs(taken[s] - want[s]) <= largest[s] for s in want)
    assert sorted((str(r.doc_id), r.size) for r in plan) == sorted((str(i), len(split(t))) for i, t in rows)
    again = mixing.plan(docs.repartition(7)).collect()
    key = lambda r: (str(r.doc_id), r.size, r.taken)
    assert sorted(map(key, plan)) == sorted(map(key, again))
    mixed = mixing.mix(docs)
    assert set(mixed.columns) == set(docs.columns)
    copies = {}
    for r in plan:
        copies[r.doc_id, r.h] = r.copies if r.doc_id != 3 else copies.get((r.doc_id, r.h), 0) + r.copies
    assert mixed.count() == sum(copies.values())
    at = [r.position for r in mixed.collect()]
    assert at == sorted(at)
    assert mixing.plan(docs.limit(0)).count() == 0 and mixing.mix(docs.limit(0)).count() == 0


def test_mixing_of_rows_without_an_id_and_equal_rows(spark, monkeypatch):
    monkeypatch.setattr(mixing, "RANGE_ROWS", 5)
    rows = [(None, "a b c", "s", k) for k in range(40)] + [(None, "a b", "t", 1)] * 40 + [(9, "a", "u", k % 2) for k in range(9)]
    df = spark.createDataFrame(rows, "doc_id BIGINT, text STRING, source STRING, extra BIGINT")
    plan = mixing.plan(df).collect()
    assert len(plan) == len(rows)
    taken = {}
    for r in plan:
        taken[r.source] = taken.get(r.source, 0) + r.taken
    assert all(abs(taken[r.source] - r.target) <= r.size for r in plan)
    starts = sorted(p for r in plan if r.source == "t" for p in r.positions)
    assert len(set(starts)) == len(starts)  # equal rows stand one after the other
    mixed = mixing.mix(df).collect()
    assert len(mixed) == sum(r.copies for r in plan)
    assert {(r.doc_id, r.text, r.source, r.extra) for r in mixed} <= set(rows) and len({r.extra for r in mixed if r.source == "s"}) > 15
    assert sorted(map(str, mixed)) == sorted(map(str, mixing.mix(df.repartition(5)).collect()))


def test_schedule_is_inverted(spark):
    from pyspark.sql import functions as F

    for early, late in ((1.5, 0.5), (1.0, 1.0), (0.5, 1.5), (0.0, 2.0)):
        t = [r[0] for r in spark.range(0, 101).select(mixing._when(F.col("id") / 100, F.lit(early), F.lit(late))).collect()]
        assert all(abs((early * x + (late - early) * x * x / 2) / ((early + late) / 2) - k / 100) < 1e-9 for k, x in enumerate(t))


MIT = licenses.SENTENCES[3] + "\n\n" + licenses.SENTENCES[4]


@pytest.mark.parametrize(
    ("text", "want"),
    [
        (None, []), ("", []), ("nothing here", []), ("Prose.\nReleased under the MIT License.\nMore.", ["MIT"]), ("x. released   UNDER the mit license.", ["MIT"]),
        (MIT, ["MIT"]), ("\n".join(MIT[k : k + 60] for k in range(0, len(MIT), 60)).replace("\n ", " \n"), None), (licenses.SENTENCES[6] + " " + licenses.SENTENCES[7], ["Apache-2.0"]),
        ("\n".join(licenses.SENTENCES[k] for k in (18, 19, 20)), ["BSD-2-Clause"]), ("\n".join(licenses.SENTENCES[k] for k in (18, 19, 20, 21)), ["BSD-3-Clause"]),
        ("\n".join(licenses.SENTENCES[k] for k in (20, 19, 18)), []), ("All rights reserved.\nAll rights reserved.\nLicensed under CC BY-NC 4.0.", ["CC-BY-NC-4.0", "All-rights-reserved"]), ("a license for nothing. " * 5000 + "All rights reserved.", ["All-rights-reserved"]),
    ],
)
def test_licences(spark, text, want):
    df = spark.createDataFrame([(1, text, "x")] * 2, "doc_id BIGINT, text STRING, licenses STRING")
    got = licenses.scan(df).collect()
    assert len(got) == 2 and (want is None or all(r.licenses == want for r in got))
    assert licenses.scan(df.limit(0)).count() == 0


WRAPPED = licenses.SENTENCES[9].replace(" of the GNU", "\nof the GNU").replace(" either", "\neither")


@pytest.mark.parametrize(
    ("text", "ids", "want"),
    [
        ("Copyright (C) 2020 Foo. All rights reserved\n\n" + WRAPPED, [17, 9], ["GPL-3.0", "All-rights-reserved"]),
        (WRAPPED + "\n\nLicensed under CC BY 4.0\nAll rights reserved\n", [9, 12, 17], ["GPL-3.0", "CC-BY-4.0", "All-rights-reserved"]),
        (licenses.SENTENCES[18] + "\n" + licenses.SENTENCES[19].replace(" this list", "\nthis list") + "\n\nx\n" + licenses.SENTENCES[20][:-1] + "\nand so on", [18, 19, 20], ["BSD-2-Clause"]),
        (licenses.SENTENCES[6].replace(" (the", "\n(the") + "\n" + licenses.SENTENCES[7], [6, 7], ["Apache-2.0"]),
    ],
)
def test_licences_seen_by_one_reading_each(spark, text, ids, want):
    got = licenses.scan(spark.createDataFrame([(1, text)], "doc_id BIGINT, text STRING")).first()
    assert (got.sentence_ids, got.licenses) == (ids, want)


def test_every_known_sentence_is_recognised(spark):
    df = spark.createDataFrame(list(licenses.SENTENCES.items()), "doc_id BIGINT, text STRING")
    assert all(r.doc_id in r.sentence_ids and len(r.licenses) == 1 for r in licenses.scan(df).collect() if r.doc_id not in (4, 7, 18, 19, 20, 21))
    assert all(r.doc_id in r.sentence_ids for r in licenses.scan(df).collect())


PAGES = [
    (1, "http://a.example/x", "<html><head><title>no</title></head><body><nav>no</nav><article><h1>T &amp; U</h1><p>one <b>two<br>three<p>four&nbsp;five</p></article><footer>no</footer>", "T & U\none two three\nfour five"),
    (2, "http://a.example/y", None, ""), (3, None, "", ""), (4, "bad url", "plain &lt;text", "plain <text"),
    (5, "http://a.example/z", "<body><header>no</header><div class='cookie-notice'>no</div><main><section class='x'><p>yes</p><form>no</form><script>var a='<p>no</p>'</script></section><div id=comments><article>no</article></div></main><aside>no</aside>", "yes"),
    (6, "http://a.example/w", "<ul><li>a<li>b</ul><table><tr><td>c<td>d</table><!-- <p>no</p> --><p hidden>no</p>", "a\nb\nc\nd"),
    (7, "http://a.example/v", "<div class=layout-sidebar><article><p>in</p><div class=share>no</div></article></div>", "in"),
    (7, "http://a.example/v", "<div class=layout-sidebar><article><p>in</p><div class=share>no</div></article></div>", "in"),
]


def test_html(spark):
    df = spark.createDataFrame([(i, u, h, "x", "x") for i, u, h, _ in PAGES], "page_id BIGINT, url STRING, html STRING, text STRING, host STRING")
    got = sorted((r.page_id, r.text, r.n_chars) for r in html.extract(df).collect())
    assert got == sorted((i, t, len(t)) for i, _, _, t in PAGES)
    assert html.extract(df.limit(0)).count() == 0


def test_template_subtrees_go_but_articles_stay(spark):
    page = lambda k, extra="": f"<body><div><p>Welcome to the site</p><p>of all things</p></div>{extra}<div><p>text {k}</p></div></body>"
    rows = [(k, f"http://a.example/{k}", page(k)) for k in range(12)] + [(100 + k, "http://b.example/", page(1)) for k in range(12)]
    rows += [(200 + k, f"http://c.example/{k}", f"<article><p>shared by all</p><p>text {k}</p></article>") for k in range(12)]
    got = {r.page_id: r.text for r in html.extract(spark.createDataFrame(rows, "page_id BIGINT, url STRING, html STRING")).collect()}
    assert got[3] == "text 3"
    assert got[105] == "Welcome to the site\nof all things\ntext 1"  # copies of one page are one page
    assert got[203] == "shared by all\ntext 3"


def test_templates_of_a_section_of_a_large_host(spark):
    extra = lambda k: "<div><p>Only in this section</p></div>" if k < 12 else "<div><p>On nine pages</p></div>" if k < 21 else ""
    rows = [(k, f"http://a.example/{k}", f"<body>{extra(k)}<div><p>text {k}</p></div></body>") for k in range(100)]
    rows += [(100 + k, f"http://b.example/{k}", f"<main>{extra(k)}<p>text {k}</p></main>") for k in range(100)]
    got = {r.page_id: r.text for r in html.extract(spark.createDataFrame(rows, "page_id BIGINT, url STRING, html STRING")).collect()}
    assert [got[k] for k in (3, 15, 50, 103, 115)] == ["text 3", "On nine pages\ntext 15", "text 50", "text 3", "On nine pages\ntext 15"]


@pytest.mark.parametrize(
    ("page", "want"),
    [
        ('<article><h2 id="related-work">a</h2><p>b</p><h2 id="comments-on-the-draft">c</h2><h3 id=comments class="widget">d</h3></article>', ["a", "b", "c", "d"]),
        ('<article><section id="social-policy"><p>a</p></section><div class="article-header x"><h1>b</h1><p>c</p></div></article>', ["a", "b", "c"]),
        ('<article><div class="header"><h1>a</h1><p>no</p></div><p>b</p></article><div class="site-header"><h1>no</h1></div>', ["a", "b"]),
        ('<main><div class="header"><p>no</p><article><p>a</p></article></div><p>b</p></main>', ["a", "b"]),
        ('<h1 id="notice">a</h1><div class="header"><h1>no</h1></div><div class="layout no-sidebar"><p>b</p></div>', ["a", "b"]),
        ('<main><p>a</p><div class="box cookie-notice">no</div><div id=disqus_thread>no</div><div class="related-posts"><h3>no</h3></div><ul class="share-buttons"><li>no</ul><div class="sidebar-2">no</div><div class=post-comments><article>no</article></div></main>', ["a"]),
        ('<main><p>a</p><div class="share" id="comments"><article>no</article></div><div class="ad" hidden><article>no</article></div></main>', ["a"]),
    ],
)
def test_html_class_words(page, want):
    assert html.read_page(page)[0] == want


def test_html_of_a_long_page():
    blocks, _ = html.read_page("<article>" + "<p>word &amp; " * 20_000)
    assert len(blocks) == 20_000 and set(blocks) == {stdlib_html.unescape("word &amp;")}


def test_html_takes_linear_time():
    import time

    pieces = ['<a title="x ', "<!--", "<p class='x>y ", "<div>x", "<b><div>x", "<p><b class=ad>x", "<ul><li><p>x", "<span class=ad>x", "<x ", "&amp", "<![x", "</b><i>"]
    for piece in pieces:
        start = time.perf_counter()
        html.read_page(piece * 20_000 + ">")
        assert time.perf_counter() - start < 10, piece
    assert html.read_page('<p class="x>hello</p>')[0] == ["hello"] and html.read_page("a <b and c")[0] == ["a <b and c"]
    assert html.read_page('<p>it <span class="ad">x<span>y</span>z</span> goes</p>')[0] == ["it goes"]


def random_site(rng, pages):
    """Pages as trees: (tag, class or None, children), a child being a text or a tree."""
    words = lambda n: " ".join(rng.choice("abcdefgh") for _ in range(n))
    shared = [("div", None, [("p", None, [words(3)]), ("p", None, [words(2)])]) for _ in range(3)] + [("section", "x", [words(2)]), ("nav", None, [("ul", None, [("li", None, [words(1)])])])]

    def some(depth):
        kind = rng.random()
        if kind < 0.25:
            return rng.choice(shared)
        if kind < 0.4:
            return ("div", rng.choice(["ad", "side-story", "comments", "menu top"]), [("p", None, [words(3)])])
        if kind < 0.7 or depth > 2:
            return ("p", None, [words(3)])
        return (rng.choice(["div", "section", "aside"]), None, [some(depth + 1) for _ in range(rng.randint(1, 3))])

    out = []
    for _ in range(pages):
        body = [some(0) for _ in range(rng.randint(0, 4))]
        if rng.random() < 0.5:
            body.insert(rng.randint(0, len(body)), ("article", None, [("p", None, [words(2)]), *(some(1) for _ in range(rng.randint(0, 2)))]))
        out.append(("body", None, body))
    return out


def written(tree):
    if isinstance(tree, str):
        return tree
    tag, name, children = tree
    return f"<{tag}{f' class={chr(34)}{name}{chr(34)}' if name else ''}>{''.join(map(written, children))}</{tag}>"


def walked(tree, article=False, gone=False, slot=None, inside=()):
    """(text, in an article, gone, slot, subtrees around) of each text of a tree."""
    tag, name, children = tree
    gone = gone or tag in ("nav", "aside")
    if name in ("ad", "comments", "menu top") and not slot:
        slot = (tag, name)
    if tag == "article" and slot != ("div", "comments") and not gone:
        article, slot = True, None
    if tag not in ("body", "article") and not (article and tag in ("p", "li")):
        inside = (*inside, bare(tree))
    for c in children:
        if isinstance(c, str):
            yield c, article, gone, None if gone else slot, inside
        else:
            yield from walked(c, article, gone, slot, inside)


def bare(tree):
    return tree if isinstance(tree, str) else (tree[0], tuple(map(bare, tree[2])))


def stays(texts, settled, templates, slots):
    kept = [t for t in texts if not t[2] and not set(t[4]) & templates and not (t[3] and (not settled or t[3] in slots))]
    articles = [t for t in kept if t[1]]
    return [t[0] for t in (articles if articles and not settled else kept)]


def test_html_against_brute_force(spark):
    rng = random.Random(5)
    sites = {f"{k}.example": random_site(rng, n) for k, n in enumerate((1, 3, 4, 6, 12, 40))}
    many, enough = 3, 4
    rows, texts, content = [], {}, {}
    for host, pages in sites.items():
        for tree in pages:
            k = len(rows)
            rows.append((k, f"https://{host}/{k}", written(tree)))
            texts[k] = list(walked(tree))
            content[k] = (host, tuple(stays(texts[k], False, set(), set())))
    seen, slot_pages, everywhere = {}, {}, {}
    for k, (host, _) in content.items():
        for t in texts[k]:
            for subtree in t[4]:
                seen.setdefault((host, subtree), set()).add(content[k])
            if t[3]:
                slot_pages.setdefault((host, t[3]), set()).add(content[k])
    for (_, slot), pages in slot_pages.items():
        everywhere[slot] = everywhere.get(slot, 0) + len(pages)
    want, off = {}, {}
    for k, (host, _) in content.items():
        settled = len({c for c in content.values() if c[0] == host}) >= enough
        templates = {s for (h, s), pages in seen.items() if h == host and len(pages) >= many}
        want[k] = "\n".join(stays(texts[k], settled, templates, {s for s, n in everywhere.items() if n >= many}))
        off[k] = "\n".join(stays(texts[k], settled, set(), set()))
    df = spark.createDataFrame(rows, "page_id BIGINT, url STRING, html STRING")
    assert {r.page_id: r.text for r in html.extract(df, many=many, enough=enough).collect()} == want
    assert {r.page_id: r.text for r in html.extract(df, many=10**9, enough=enough).collect()} == off
    assert sum(want[k] != off[k] for k in want) > 20


def test_html_of_a_hot_host_and_null_ids(spark):
    page = lambda k: f"<body><div>Welcome</div><div class='ad {chr(97 + k)}-box'>odd {k}</div><div class=ad>buy {k}</div><p>text {k}</p></body>"
    rows = [(None, None if k % 2 else "", page(k // 3)) for k in range(60)]
    got = sorted(r.text for r in html.extract(spark.createDataFrame(rows, "page_id BIGINT, url STRING, html STRING")).collect())
    assert got == sorted(f"odd {k // 3}\ntext {k // 3}" for k in range(60))


def plain_licences(text):
    """Sentences and rules in plain Python: joined lines first, then line by line."""
    normal = lambda x: " ".join("".join(c if c in "abcdefghijklmnopqrstuvwxyz0123456789" else " " for c in x.lower()).split())
    ids = []
    for joined in re.split(r"(?<=[.!?:])[\x20\x09-\x0D]+", text):
        known = licenses.KNOWN.get(normal(joined))
        ids += [known] if known else [k for line in joined.split("\n") if (k := licenses.KNOWN.get(normal(line)))]

    def meets(rule):
        at = iter(ids)
        return all(k in at for k in rule)

    hits = [n for n in dict.fromkeys(n for n, _ in licenses.RULES) if any(meets(r) for m, r in licenses.RULES if m == n)]
    return ids, [n for n in hits if not any(n in licenses.COVERED.get(m, ()) for m in hits)]


def test_licences_against_plain_python(spark):
    rng = random.Random(17)
    notices = [n for n in licenses.KNOWN if rng.random() < 0.1]
    texts = ["see the license. " + s for s in licenses.KNOWN]
    for _ in range(300):
        parts = [rng.choice([*licenses.SENTENCES.values(), *notices, "Some other words.", "A licensed plumber came", "Released under the moon License."]) for _ in range(rng.randint(0, 6))]
        texts.append("license: " + "".join(p.replace(" ", rng.choice([" ", "  ", "\n"]), rng.randint(0, 3)) + rng.choice([". ", "\n", ".\n\n", " "]) for p in parts))
    got = licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id BIGINT, text STRING")).collect()
    assert {r.doc_id: (r.sentence_ids, r.licenses) for r in got} == {k: plain_licences(t) for k, t in enumerate(texts)}
    assert len({n for r in got for n in r.licenses}) > 40
