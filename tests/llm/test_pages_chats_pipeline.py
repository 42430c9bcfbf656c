"""HTML extraction, chat threads and the pipeline."""

import html
import random
import re
import time

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from corpusmill.llm import chat_threads, html_extraction

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="</p><p>not text</p>";</script></head><body class="has-sidebar">
<header><h2>Site</h2></header><nav><ul><li><a href=/>Home</a><li><a href=x>Other page</a></ul></nav><div id="cookie-notice">We use cookies here</div>
<article><h1>The &lt;big&gt; story</h1><p>First   words of the
 story<br>go here &amp; on.<p>Second paragraph with a <a href=q>link in it</a> and <b>bold</b> words.</p><div class="ad">Buy this now please</div>
<!-- hidden words in a comment --><ul><li>one item</li><li>two items</li></ul><p>Short end.</p></article>
<section class="comments"><h3>Comments</h3><p>I think this is a very long comment by a reader who has much to say about it all</p></section>
<form><label>Name</label><textarea>words</textarea></form><aside>Related things</aside><footer>&copy; 2020 All rights</footer></body></html>"""
TEXT = "The <big> story\nFirst words of the story go here & on.\nSecond paragraph with a link in it and bold words.\none item\ntwo items\nShort end."


def test_article_alone_is_kept():
    weights = html_extraction.learn_weights()
    assert html_extraction.extract_text(PAGE, weights) == TEXT
    assert weights["word"] > 0 > max(v for k, v in weights.items() if k.startswith("tag"))


def test_best_run():
    assert html_extraction.best_run([-1.0, 2.0, -1.0, 3.0, -5.0, 3.0]) == (1, 4)
    assert html_extraction.best_run([-1.0]) == (0, 0) == html_extraction.best_run([])


def test_awkward_pages(spark):
    long = "<p>" + "word " * 50_000 + "</p>"
    rows = [(1, "u", PAGE, "t"), (1, "u", PAGE, "t"), (2, None, None, None), (3, "u", "", "t"), (4, "u", "plain text  only", "t"), (5, "u", "<nav><a>x</a></nav>", "t"), (6, "u", long, "t"), (7, "u", "<p>cut off <b", "t")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = html_extraction.extract_pages(pages)
    assert got.columns == ["page_id", "url", "text", "n_chars"]
    out = [(r["page_id"], r["text"], r["n_chars"]) for r in got.collect()]
    assert out.count((1, TEXT, len(TEXT))) == 2 and (2, "", 0) in out and (3, "", 0) in out and (4, "plain text only", 15) in out and (5, "", 0) in out
    assert (6, ("word " * 50_000).strip(), 249_999) in out and (7, "cut off", 7) in out
    assert html_extraction.extract_pages(pages.limit(0)).count() == 0


def test_pages_table(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    got = {r["page_id"]: r["text"] for r in html_extraction.extract_pages(pages).collect()}
    for r in pages.collect():
        body = re.search(r"<article>(.*?)(</article>|$)", r["html"], re.S)[1]
        blocks = [" ".join(html.unescape(re.sub(r"<br>", " ", re.sub(r"</?b>", "", x))).split()) for x in re.split(r"</?(?:p|h1|div|ul|li)\b[^>]*>", body)]
        assert got[r["page_id"]] == "\n".join(b for b in blocks if b)


CHAT = [
    (1, 0, "u", "Hello there, friend.\n\nSecond paragraph here."), (1, 1, "a", "> Hello there, friend.\nHi!"), (1, 2, "u", "Unrelated"),
    (1, 3, "a", "On Monday X wrote:\n> > hello there friend\n> Hi!\nnested"), (1, 4, "u", ">second  PARAGRAPH here\nanswer two"), (1, 1600, "u", "> Hello there, friend.\nlate"),
    (1, 1601, "u", "> nowhere\nx"), (2, 0, "u", None), (2, 0, "u", None), (None, None, "u", "x"), (None, 1, None, "> x\ny"), (3, 0, "u", ""), (3, 5, "a", "> again\n\n> again\nz"),
]


def plain_threads(rows):
    """Position, reply and branch by a scan of each conversation."""
    out = {}
    for conv in {r[0] for r in rows}:
        own = sorted([r for r in rows if r[0] == conv], key=lambda r: (r[1] is not None, r[1] or 0))
        branch = None
        for at, (_, turn, _, text) in enumerate(own):
            mine, quotes = chat_threads.parse(text)
            found = []
            for level, passage in quotes:
                hits = [o[1] for o in own if o[1] is not None and turn is not None and o[1] < turn and chat_threads.passage_hash(passage) in chat_threads.own_passages(chat_threads.parse(o[3])[0])]
                if hits:
                    found.append((-level, max(hits)))
            prior = own[at - 1][1] if at else None
            reply = max(found)[1] if found else prior
            if prior is None or reply != prior:
                branch = turn if turn is not None else branch
            out[conv, turn, at] = (reply, branch, mine, len(quotes), len(found))
    return out


@pytest.mark.parametrize("span", [512, 2])
def test_threads(spark, span, monkeypatch):
    monkeypatch.setattr(chat_threads, "TURN_RANGE", span)
    chats = spark.createDataFrame(CHAT, "conv_id long, turn long, role string, text string").repartition(3)
    got = {(r["conv_id"], r["turn"], r["position"]): (r["reply_to"], r["branch"], r["text"], r["n_quotes"], r["n_linked"]) for r in chat_threads.thread(chats).collect()}
    assert got == plain_threads(CHAT)
    assert got[1, 3, 3] == (1, 3, "nested", 2, 2) and got[1, 1600, 5][0] == 0 and got[1, 1601, 6][0] == 1600
    assert chat_threads.thread(chats.limit(0)).count() == 0


def test_pipeline_against_plain_steps(spark):
    """Stage by stage on a small table: who stays, who goes, and what the last stage says of it."""
    sf = "/root/testdata/sf0.001"
    from corpusmill.llm import decontamination, jaccard_join, quality_classifier

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels, bench = spark.read.parquet(f"{sf}/labels.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet")
    good = {r["doc_id"] for r in quality_classifier.classify(docs, labels).where("predicted = 1").collect()}
    one = corpus_pipeline.quality(spark, docs, sf)
    assert one.columns == docs.columns and {r["doc_id"] for r in one.collect()} == good
    classes = {r["doc_id"]: r["class_id"] for r in jaccard_join.near_duplicates(one).collect()}
    two = corpus_pipeline.near_duplicates(spark, one, sf)
    assert two.columns == docs.columns and {r["doc_id"] for r in two.collect()} == {k for k, c in classes.items() if k == c}
    bad = {r["doc_id"] for r in decontamination.report(two, bench).where("contaminated").collect()}
    three = corpus_pipeline.decontaminate(spark, two, sf)
    assert three.columns == docs.columns and {r["doc_id"] for r in three.collect()} == {r["doc_id"] for r in two.collect()} - bad
    four = corpus_pipeline.mix(spark, three, sf)
    assert four.columns == docs.columns and {r["doc_id"] for r in four.collect()} <= {r["doc_id"] for r in three.collect()}
    last = corpus_pipeline.run(spark, sf).collect()
    assert sorted(r["doc_id"] for r in last) == sorted(r["doc_id"] for r in four.collect())
    assert [len(corpus_pipeline.STAGES), {r["law"] for r in last}] == [5, {"bytes"}]


ARTICLE = "<h1>A title of it</h1><p>Some words of the article that go on for a while and then stop right here.</p><p>A second part of it says a little more about the matter.</p>"
ARTICLE_TEXT = "A title of it\nSome words of the article that go on for a while and then stop right here.\nA second part of it says a little more about the matter."
FRAME = "<html><body><nav><ul><li><a href=/>Home</a></li><li><a href=/x>News</a></li></ul></nav>{}<div class=ad>Buy this now</div><footer>&copy; 2020 All rights</footer></body></html>"


@pytest.mark.parametrize("wrapper", [
    '<div class="layout has-sidebar">{}</div>', '<div id="main" class="with-sidebar">{}</div>', '<section class="single-post share-enabled">{}</section>', '<div class="no-comments post-12">{}</div>',
    '<div class="content-with-sidebar">{}</div>', '<div class="home social"><article>{}</article></div>', '<div class="social">{}</div>', '<form id=aspnet>{}</form>', '<div class="widget"><main>{}</main></div>',
    '<article class="post">{}<div class="comments"><p>Nice one, thank you</p></div></article>', '<main>{}<section id="comments"><h3>Replies</h3><p>I liked it lots</p></section></main>',
    '<div class=wrap>{}<section class=related-posts><article><h3>Another one</h3><p>Teaser of that</p></article></section></div>', '<article><div class="share-buttons">Share this</div>{}</article>',
])
def test_wrapper_names_do_not_empty_pages(wrapper):
    assert html_extraction.extract_text(FRAME.format(wrapper.format(ARTICLE)), html_extraction.learn_weights()) == ARTICLE_TEXT


def test_topics_as_ids_stay_in_the_article():
    page = FRAME.format(f'<article>{ARTICLE}<section id="discussion"><h2 id="related-work">Related work</h2><p>Others say so too.</p></section></article>')
    assert html_extraction.extract_text(page, html_extraction.learn_weights()) == f"{ARTICLE_TEXT}\nRelated work\nOthers say so too."


def test_random_wrappers():
    rng, weights = random.Random(4), html_extraction.learn_weights()
    words = sorted({w for ws in html_extraction.FURNITURE_WORDS.values() for w in ws.split()} | html_extraction.CONTENT_WORDS | {"home", "page", "col", "inner"})
    for _ in range(300):
        names = " ".join(rng.choice(("has-", "with-", "no-", "")) + rng.choice(words) + rng.choice(("", "-enabled", "-layout", "-12")) for _ in range(rng.randint(1, 3)))
        wrapper = rng.choice(('<div class="{}">{}</div>', '<div id="{}"><article>{}</article></div>', '<section class="{}"><div>{}</div></section>')).format(names, ARTICLE)
        assert html_extraction.extract_text(FRAME.format(wrapper), weights) == ARTICLE_TEXT, names


def test_best_run_is_the_best_of_all():
    rng = random.Random(9)
    for _ in range(400):
        scores = [rng.choice((-3.0, -1.0, -0.5, 0.0, 0.5, 1.0, 2.0)) for _ in range(rng.randint(0, 14))]
        a, b = html_extraction.best_run(scores)
        assert sum(scores[a:b]) == max([0.0, *(sum(scores[i:j]) for i in range(len(scores)) for j in range(i + 1, len(scores) + 1))])


@pytest.mark.parametrize("page", ["<div>" * 3 + "</span></p></b>" * 33_000, "<p><article>" + "<div>" * 30_000 + "</p>" * 100_000, "<script/>" * 50_000 + '<a b="c' * 50_000 + "<!--" * 50_000, "<div class=ad>" * 50_000])
def test_broken_pages_take_linear_time(page):
    began = time.process_time()
    html_extraction.extract_text(page + "some words here", html_extraction.learn_weights())
    assert time.process_time() - began < 5


def plain_walk(rows):
    """reply_position of (turn, reply_to) rows of one conversation with unique turns, by a walk of the tree of replies."""
    children = {}
    for turn, reply in rows:
        children.setdefault(reply, []).append(turn)
    turns = sorted(t for t, _ in rows)
    after = dict(zip(turns, turns[1:], strict=False))
    out, stack = {}, sorted(children[None], reverse=True)
    while stack:
        turn = stack.pop()
        out[turn] = len(out)
        stack += sorted(children.get(turn, ()), key=lambda c: (c != after.get(turn), c), reverse=True)
    return out


def test_thousands_of_quotes_in_reply_order(spark, monkeypatch):
    monkeypatch.setattr(chat_threads, "TURN_RANGE", 64)
    rng, rows = random.Random(6), []
    for conv, size in ((1, 1500), (2, 400), (3, 30), (None, 200)):
        said = []
        for turn in range(size):
            own = f"message {turn} of {conv} says {rng.randint(0, 40)}"
            quoted = ""
            if turn and rng.random() < 0.6:
                at = 3 if rng.random() < 0.3 and turn > 3 else rng.randrange(turn)  # message 3 is quoted hundreds of times
                quoted = f"X wrote:\n> {said[at]}\n" + (f"> > {said[rng.randrange(turn)].upper()}\n" if rng.random() < 0.3 else "")
            rows.append((conv, turn, "u", quoted + own))
            said.append(own)
    rows.append((3, 30, "u", "> nothing like it\n" + "long words " * 50_000))
    chats = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({"branch": F.lit("x"), "tie": F.lit(1), "conv": F.lit(2)}).repartition(5)
    got = {(r["conv_id"], r["turn"]): r for r in chat_threads.thread(chats).collect()}
    assert len(got) == len(rows) and sum(r["n_linked"] for r in got.values()) > 1000
    where = {}
    for conv, turn, _, text in rows:
        for h in chat_threads.own_passages(chat_threads.parse(text)[0]):
            where.setdefault((conv, h), []).append(turn)
    for conv, turn, _, text in rows:
        own, quotes = chat_threads.parse(text)
        found = [(-level, max(t for t in where.get((conv, chat_threads.passage_hash(p)), ()) if t < turn)) for level, p in quotes if any(t < turn for t in where.get((conv, chat_threads.passage_hash(p)), ()))]
        r = got[conv, turn]
        assert (r["text"], r["n_quotes"], r["n_linked"], r["reply_to"]) == (own, len(quotes), len(found), max(found)[1] if found else turn - 1 if turn else None)
    for conv in {r[0] for r in rows}:
        want = plain_walk([(t, got[c, t]["reply_to"]) for c, t in got if c == conv])
        assert {t: got[c, t]["reply_position"] for c, t in got if c == conv} == want
    awkward = chat_threads.thread(spark.createDataFrame(CHAT, "conv_id long, turn long, role string, text string")).collect()
    for conv in {r["conv_id"] for r in awkward}:
        own = [r for r in awkward if r["conv_id"] == conv]
        assert sorted(r["reply_position"] for r in own) == list(range(len(own)))


STORY = "<p>The town council met on Monday to talk about the old harbour wall and its future.</p><p>It will take two years to mend it, the mayor said in a statement.</p>"
STORY_TEXT = "The town council met on Monday to talk about the old harbour wall and its future.\nIt will take two years to mend it, the mayor said in a statement."
MENU = "<nav><ul><li><a href=/>Home</a></li><li><a href=/n>News</a></li></ul></nav>"
#: What stands in an article and belongs to it, whatever it is called; and what does not. Not among the labelled pages.
KEPT = {
    "<section class='related-work'><p>Earlier studies of the wall found that it had sunk by a foot since the war.</p></section>": "Earlier studies of the wall found that it had sunk by a foot since the war.",
    "<div class='widget'><p>The stones were cut in the quarry behind the hill.</p></div>": "The stones were cut in the quarry behind the hill.",
    "<div class='alert'><p>Do not walk on the wall while it is wet, the council warns.</p></div>": "Do not walk on the wall while it is wet, the council warns.",
    "<fieldset><legend>Facts</legend><p>The wall is two miles long and nine feet high.</p></fieldset>": "Facts\nThe wall is two miles long and nine feet high.",
    "<aside>The wall is all that we have, said the mayor.</aside>": "The wall is all that we have, said the mayor.",
    "<section><h2>Related work</h2><p>Earlier studies of the wall found that it had sunk by a foot.</p></section>": "Related work\nEarlier studies of the wall found that it had sunk by a foot.",
    "<p>All rights reserved by the crown were sold.</p>": "All rights reserved by the crown were sold.",
}
DROPPED = (
    "<aside><a href=1>Storm hits coast</a> <a href=2>New school opens</a></aside>", "<aside>Subscribe to our newsletter for more stories like this one.</aside>", "<div class=ad>Buy two pans today and save a lot of money.</div>",
    "<form><label>Your mail</label><input><button>Sign up</button></form>", "<div class=widget><h3>Weather</h3><p>Sunny</p></div>", "<section><h2>3 Comments</h2><p>I think this is quite wrong, and I will write to the mayor.</p></section>",
    "<div class='notice'>This page sets cookies to count its readers.</div>",
)


@pytest.mark.parametrize("part", [*KEPT, *DROPPED])
def test_parts_of_articles_are_told_from_what_stands_in_them(part):
    page = f"<html><body>{MENU}<article>{STORY}{part}<p>They are grey.</p></article><footer>&copy; 2020 Town Paper</footer></body></html>"
    got = html_extraction.extract_text(page, html_extraction.learn_weights())
    assert got == "\n".join([STORY_TEXT, *([KEPT[part]] if part in KEPT else []), "They are grey."])


@pytest.mark.parametrize(("page", "want"), [
    (f"<div><a href=/>Home</a> <a href=/n>News</a></div><div><h1>Wall</h1>{STORY}</div><div><h3>Readers say</h3><p>What a waste of money this is, and nobody asked us about it.</p></div><div>Copyright 2020 Town Paper</div>", "Wall\n" + STORY_TEXT),
    (f"<div class=row><div class='col-8'><h1>Wall</h1>{STORY}</div><div class='col-4'><h3>Popular</h3><p>Storm hits the coast again and again.</p></div></div>", "Wall\n" + STORY_TEXT),
    (f"{MENU}<header class='article-header'><h1>The wall</h1><p>By Ann Smith</p></header><main>{STORY}</main><footer>Imprint</footer>", "The wall\nBy Ann Smith\n" + STORY_TEXT),
])
def test_pages_without_names_and_with_a_header_of_the_article(page, want):
    assert html_extraction.extract_text(f"<html><body>{page}</body></html>", html_extraction.learn_weights()) == want


def test_held_out_layouts():
    """Precision and recall of words over pages put together from parts that the labelled pages do not have."""
    rng, hits, given, wanted = random.Random(4), 0, 0, 0
    weights = html_extraction.learn_weights()
    for _ in range(300):
        kept, dropped = rng.sample(sorted(KEPT), 2), rng.sample(DROPPED, 2)
        body = "".join(rng.sample([*kept, *dropped, STORY], 5))
        page = f"<html><body>{rng.choice([MENU, '<div id=top><a href=x>Index</a> | <a href=y>About</a></div>'])}<{(tag := rng.choice(['article', 'main', 'div class=post']))}>{body}</{tag.split()[0]}>{rng.choice(['<footer>Imprint</footer>', '<div>Copyright 2020 Us</div>'])}</body></html>"
        got = html_extraction.extract_text(page, weights).split("\n")
        right = set(STORY_TEXT.split("\n")) | {x for k in kept for x in KEPT[k].split("\n")}
        hits += sum(len(x.split()) for x in got if x in right)
        given += sum(len(x.split()) for x in got)
        wanted += sum(len(x.split()) for x in right)
    assert hits / given > 0.97 and hits / wanted > 0.97
