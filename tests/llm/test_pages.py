import random

import numpy as np
import pytest

from pagewright.llm import mainbody, pagelines, residue

PAGE = """<!DOCTYPE html>
<html><head><title>A post</title><style>p{}</style></head>
<body>
<!-- hidden
<p>comment</p> -->
<header><a href="/">Site</a> <nav><a href="/about/">About</a>
<a href="/now/">Now</a></nav></header>
<div class="x1">
<h1>My lopsided drum</h1>
<span>By Ann Other on 3 May 2020</span>
<p>The drum broke twice, so I mended it with some string
and a lot of patience, which felt like baking in reverse. It held for a week, then the string gave way; I took some wire, a kettle, and the better part of a Sunday, and now it sounds as it did when we bought it.</p>
<pre><code>&lt;p&gt;${name}&lt;/p&gt;
if x == 404:</code></pre>
<p>Cookies in the jar were counted, not stored.</p>
<p>Share this post: Mail, Copy link, Print</p>
<h3>Comments</h3>
<p>Bo Reader says: I liked the drum, and the string was a fine idea too.</p>
</div>
<aside><h3>Related</h3><h4>Another post of mine</h4><p>Some teaser sentence stands here. <a href="/more">Read more</a></p></aside>
<div class="x2"><p>You can read what each cookie does
and why we keep it for a while here.</p><button>OK</button></div>
<noscript>enable scripts</noscript><script>var a = 1;</script>
<footer><p>© 2020 Ann Other. All rights reserved.</p></footer>
</body></html>"""


WORDS = "kettle harbour ladder pencil marble wicker lantern thimble saddle barrel anchor copper velvet walnut basket mitten".split()
NAMES = "Ann Bo Cy Di Ed Flo Gus Hal".split()


def sentence(rng):
    return f"The {rng.choice(WORDS)} near the {rng.choice(WORDS)} was mended by {rng.choice(NAMES)} in {rng.randint(1990, 2020)}, and the {rng.choice(WORDS)} never stopped {rng.choice(WORDS)}ing again."


def made(i, rng):
    """A page of one of two layouts, and the texts of its lines beside the post."""
    site, who = f"site{i % 30}", rng.choice(NAMES) + " Other"
    title = f"How {rng.choice(NAMES)} lost a {rng.choice(WORDS)} and found {rng.randint(2, 99)} {rng.choice(WORDS)}s"
    top, by, foot = [site, "Home About Now"], f"By {who} on 3 May 20{rng.randint(10, 20)}", f"© 20{rng.randint(10, 20)} {who}. All rights reserved."
    share, related = "Share this post: Mail, Copy link, Print", ["Related", f"Another {rng.choice(WORDS)} for {rng.choice(NAMES)}", "Subscribe to the letter by mail"]
    body = [sentence(rng) + " " + sentence(rng) for _ in range(rng.randint(2, 5))]
    main = "\n".join(f"<p>{x}</p>" for x in body)
    side = "<div class='side'><h3>Related</h3>\n" + "\n".join(f"<p>{x}</p>" for x in related[1:]) + "</div>"
    html = f"""<html><head><title>{title}</title></head><body><div class='top'><h2><a href='/'>{site}</a></h2>
<nav><a href='/'>Home</a> <a href='/a'>About</a> <a href='/n'>Now</a></nav></div>
{side if i % 2 else ''}
<div class='post'><h1>{title}</h1>
<span class='meta'>{by}</span>
{main}
<p>{share}</p></div>
{'' if i % 2 else side}
<div class='foot'><p>{foot}</p></div></body></html>"""
    return html, title, site, [title, *body], [*top, by, share, *related, foot]


@pytest.fixture(scope="module")
def weights():
    rng = random.Random(1)
    pages = [made(i, rng) for i in range(300)]
    return mainbody.fit([mainbody.Page(i, h, t, s, True) for i, (h, t, s, _, _) in enumerate(pages)])


def judged(weights, source, title, site, html):
    p = mainbody.Page(1, source, title, site, html)
    out = mainbody.judge([p], weights)
    return [x.text for x, o in zip(p.lines, out) if not o], [x.text for x, o in zip(p.lines, out) if o]


def test_unseen_pages_and_extracted_text(weights):
    rng = random.Random(2)
    right = wrong = 0
    for i in range(60):
        html, title, site, main, beside = made(i, rng)
        kept, gone = judged(weights, html, title, f"new{i}", True)
        assert kept == main
        assert len(gone) == len(beside)
        mixed = [beside[0], beside[1], main[0], beside[2], *main[1:], *beside[3:]]
        kept, gone = judged(weights, "\n".join(mixed), title, site, False)
        right += len(set(kept) & set(main)) + len(set(gone) & set(beside))
        wrong += len(set(kept) & set(beside)) + len(set(gone) & set(main))
    assert right > 0.95 * (right + wrong)


def test_paths_alone():
    lines = pagelines.page_lines(PAGE)
    out = {x.text for x, o in zip(lines, mainbody.by_paths(lines)) if o}
    assert all(any(t in o for o in out) for t in ("Another post of mine", "Related", "OK", "© 2020 Ann Other. All rights reserved.", "By Ann Other on 3 May 2020"))
    assert not out & {"My lopsided drum", "<p>${name}</p>", "if x == 404:", "Cookies in the jar were counted, not stored."}
    source = PAGE.split("\n")
    assert all(x.text.split()[0] in source[x.no - 1] for x in lines if "<" not in x.text)
    assert {x.path for x in lines if x.text == "My lopsided drum"} == {"body/div.x1/h1"}


def test_code_and_separators_stay(weights):
    kept, _ = judged(weights, "<div class='a'><p>" + sentence(random.Random(3)) * 3 + "</p>\n<pre>if x == 404:\n  not_found()</pre>\n<p>* * *</p>\n<p>2024</p></div>", "x", "y", True)
    assert kept[1:] == ["if x == 404:", "not_found()", "* * *", "2024"]


@pytest.mark.parametrize("source", ["", "   ", "<", "<p", "<div><div><p>", "</p></p>", "<script>", "x" * 200_000, "<a>" * 5000, "\n" * 1000])
def test_odd_pages(weights, source):
    for html in (True, False):
        p = mainbody.Page(1, source, None, None, html)
        assert len(mainbody.judge([p], weights)) == len(p.lines)
        residue.judge([p], weights, weights)


def test_without_pages():
    w = mainbody.fit([])
    assert len(mainbody.judge([], w)) == 0
    assert judged(w, "One line\nand another", None, None, False)[1] == []


def test_boilerplate_frames(spark):
    rows = [(1, PAGE, "A post", 5, "a.example"), (2, None, None, 5, None), (3, "", None, 5, ""), (1, PAGE, "A post", 5, "a.example")]
    df = spark.createDataFrame([(*r, None) for r in rows], "page_id long, html_content string, title string, line_no int, domain string, url string")
    args = (mainbody.fit([]), "page_id", "html_content", "title", "crawled_pages")
    got = mainbody.boilerplate(df, *args).collect()
    assert {r.rec_id for r in got} == {1} and len(got) == 2 * len({r.line_no for r in got})
    texts = [(r.origin, r.rec_id, r.main_text) for r in mainbody.main_text(df, *args).collect()]
    assert len(texts) == 2 and texts[0] == texts[1] and texts[0][2].startswith("My lopsided drum")
    assert mainbody.boilerplate(df.limit(0), *args).count() == 0
    ready = mainbody.prepared(df, "page_id", "html_content", "title")
    assert mainbody.sample(ready.limit(0), 5).count() == 0
    assert mainbody.train(ready).any()


def page(title, head, *body):
    return f"<html><head><title>{title}</title></head><body><div class='m'>\n" + (f"<h1>{head}</h1>\n" if head else "") + "\n".join(f"<p>{b}</p>" for b in body) + "\n</div></body></html>"


PROSE = ["The loom I mended last Friday is now at the quay, next to nine others and a kind spreadsheet.", "We counted 40 visitors on Monday, three on Sunday, and one nested drum.", "Nobody at the meet-up had seen a kettle so quiet, except Ann, who folded two in May."]
QUOTES = ["The old page only said “page not found”, so Ann redrew it with a kind drum and a joke.", "When scripts are off, the demo asks you to enable JavaScript, which Bo calls dull."]
BAD = [("Not Found", "Page not found", ["The page you asked for has moved or never existed."]), ("{{ page.title }}", "Drums", PROSE), ("Drums", "[object Object]", PROSE), ("Error", "", ["Service temporarily unavailable, please retry in 9 minutes"]), ("Just a moment…", "", ["Please enable JavaScript to view this site."]), ("Sample page", "", ["Lorem ipsum dolor vela magna elit quis sem.", "Vela magna lorem ipsum elit tortor."]), ("Drums", "", ["Fatal error: Uncaught exception in /srv/x.php on line 4"])]
GOOD = [("Drums", "Drums", PROSE), ("404 pages I have kept", "404 pages I have kept", QUOTES + PROSE), ("Why “enable JavaScript” annoys me", "", QUOTES), ("", "", PROSE[:1]), ("Under construction since May", "Under construction since May", PROSE)]


def frame(spark, n=240, seed=1):
    random.seed(seed)
    rows, truth = [], set()
    for i in range(n):
        bad = random.random() < 0.3
        t, h, b = random.choice(BAD if bad else GOOD)
        rows.append((i, page(t, h, *random.sample(b, len(b))), None if t == "" else t, f"http://h{i % 40}.example/x", random.choice([200, 200, 404]) if bad else random.choice([200, 200, 200, 500]), "x"))
        truth |= {i} if bad else set()
    rows += [(n, None, None, None, None, None), (n + 1, "", "Not Found", "http://a.example", 404, None)]
    return spark.createDataFrame([(*r, None) for r in rows], "page_id long, html_content string, title string, url string, status_code int, found string, domain string"), truth


def test_residue_classifier(spark):
    df, truth = frame(spark)
    model = residue.train(df)
    again = residue.train(df.repartition(7))
    assert all(np.array_equal(a, b) for a, b in zip(model, again)), "the sample doesn't depend on how the table is split"
    assert {r.page_id for r in residue.judged(df, model).filter("found").collect()} == truth
    other, truth2 = frame(spark, seed=2)
    assert {r.page_id for r in residue.judged(other, model).filter("found").collect()} == truth2


def test_residue_without_pages(spark):
    df, _ = frame(spark)
    for part in (df.limit(0), df.filter("html_content is null or html_content = ''")):
        assert residue.judged(part, residue.train(part)).filter("found").count() == 0


#: Pages marked by hand: of hosts that are in no table, in words that none of the phrases names but for the first few.
MARKED_BAD = [
    ("Page not found", "", ["Page not found"]), ("Not Found", "", ["The requested URL /old/index.htm was not found on this server."]), ("{{ post.title }}", "{{ post.title }}", ["{{ post.body }}"]),
    ("Sample Page", "Sample Page", ["This is an example page. Replace this placeholder with your own text."]), ("Lorem ipsum", "", ["Lorem ipsum dolor sit amet, consectetur adipiscing elit, sed do eiusmod tempor."]),
    ("", "", ["The page you asked for is gone.", "Try the search box or go back home."]), ("", "", ["We are closed for repairs and will be back shortly."]),
    ("", "", ["You need JavaScript to view this app."]), ("", "", ["Please verify that you are human to continue."]), ("", "", ["Exception in index.php on line 12"]),
    ("My site", "", ["This page is not available. The address you requested does not exist."]), ("503", "", ["The service is unavailable, please try again later."]),
]
MARKED_GOOD = [
    ("On broken links", "On broken links", ["Every year I go through the archive and look for pages that were moved. Last week a reader wrote that the old address only said not found, so I put a note there.", "It took two evenings, and I enjoyed them."]),
    ("A small update", "A small update", ["The garden is dry. We wait for rain and read on the porch until the light goes."]),
    ("Why I left the loading spinner out", "Why I left the loading spinner out", ["Spinners annoy me. The page I rebuilt in April loads in half a second, and nobody asked where the little wheel went.", "Scripts are fine where they help."]),
    ("Ten years of writing here", "", ["Ten years ago I wrote the first lines on this page. Since then I have moved house twice, changed jobs, and learned to bake bread."]),
]


def test_hand_marked_pages_of_unseen_hosts(spark):
    from pagewright.plans.runtime import table

    chrome, w = residue.train(table(spark, "/root/testdata/sf0.1", "crawled_pages"))
    bad = [mainbody.Page(i, page(t, h, *b), t, f"unseen{i}", True) for i, (t, h, b) in enumerate(MARKED_BAD)]
    good = [mainbody.Page(i, page(t, h, *b), t, f"other{i}", True) for i, (t, h, b) in enumerate(MARKED_GOOD)]
    found, blocks = residue.judge(bad, chrome, w)
    phrases = blocks.found(blocks.phrases(), len(bad))
    print("hand-marked: found", found.sum(), "by phrases alone", phrases.sum(), "of", len(bad))
    assert found.mean() >= 0.8 and (found != phrases).any()
    assert not residue.judge(good, chrome, w)[0].any()


def test_phrases_are_no_features():
    words = [a + b for a in "vw" for b in "abcdefghijklmnopqrst"]
    blocks = residue.Blocks([mainbody.Page(1, "<p>" + " ".join(words) + "</p>", None, None, True)], np.full(mainbody.LC.FEATURES + 1, -1, np.float32))
    idx, start = blocks.features()
    assert len(start) == 1 and len(idx) == 40 + 39 + 38 + 5  # words, pairs, triples; first word twice, last word, slot and headline
    assert pagelines.is_filler("welcome to lorem ipsum dolor sit amet")


def many_pages(spark, n):
    """Pages with a word of their own each, one of them long, and a line of nine hosts only."""
    r = random.Random(4)
    names = ["".join(r.choice("bdfgklmnprstv") + r.choice("aeiou") for _ in range(5)) for _ in range(n)]
    rows = []
    for i, name in enumerate(names):
        body = sentence(r) * (3000 if i == 0 else 3)
        side = "the ninefold notice of friends" if i % (n // 9) == 1 else sentence(r)
        rows.append((i, f"<div class='m'><h1>{sentence(r)}</h1>\n<p>{body} {name}.</p>\n<p>{side}</p></div>\n<div class='f'><a href='/'>home</a>\n<a href='/x'>tags</a></div>", sentence(r), f"h{i}.example", None))
    return spark.createDataFrame(rows, "page_id long, html_content string, title string, domain string, url string"), names


def test_training_reads_every_page(spark, monkeypatch):
    df, names = many_pages(spark, 2100)
    ready = mainbody.prepared(df, "page_id", "html_content", "title")
    assert df.selectExpr("max(length(html_content))").first()[0] > mainbody.TRAIN_CHARS
    w = mainbody.train(ready)
    h, doc, _ = mainbody.LC.word_lists(names)
    assert len(h) == len(names) and (w[mainbody.LC._fold(h, "one")] != 0).all()
    monkeypatch.setattr(mainbody, "TRAIN_PAGES", 300)
    blocks = mainbody.train(ready)
    assert (blocks[mainbody.LC._fold(h, "one")] != 0).all()
    assert np.array_equal(blocks, mainbody.train(ready.repartition(7))), "the weights don't depend on how the table is split"


def test_recurring_lines_are_counted_over_all_pages(spark):
    df, _ = many_pages(spark, 2100)
    ready = mainbody.prepared(df, "page_id", "html_content", "title")
    keys, apart = mainbody.recurring(ready.repartition(5))
    want = mainbody._counted([mainbody.Page(r.k, r.t, r.h, r.s, True) for r in ready.collect()])
    assert np.array_equal(keys, want[0]) and np.array_equal(apart, want[1])
    assert mainbody._hash("the ninefold notice of friends") in keys
    assert len(mainbody.recurring(ready.limit(0))[0]) == 0


def test_one_block_is_fitted_as_it_is(spark):
    df, _ = many_pages(spark, 90)
    ready = mainbody.prepared(df, "page_id", "html_content", "title")
    pages = [mainbody.Page(r.k, r.t, r.h, r.s, True) for r in ready.orderBy("k").collect()]
    assert np.allclose(mainbody.train(ready), mainbody.fit(pages), atol=1e-5)
