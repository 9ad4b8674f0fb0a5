"""Main text: the messages against all labellings, pages of many layouts, and damaged pages."""

import html
import itertools
import random
import re

import numpy as np
import pytest

from salesmart.llm import extract

MODEL = extract.default_model()


def text_of(source):
    return extract.extract(source, MODEL)


def test_marginals_equal_the_sum_over_all_labellings():
    draw = np.random.default_rng(6)
    parents = [-1, 0, 0, 1, 1, 2, 5]
    kinds = [0, 1, 0, 1, 0, 0, 1]
    nodes, edges = draw.normal(size=7), draw.normal(size=(2, 4))
    total, content, states = 0.0, np.zeros(7), np.zeros((7, 4))
    for labels in itertools.product((0, 1), repeat=7):
        weight = np.exp(sum(n for n, label in zip(nodes, labels, strict=True) if label) + sum(
            edges[kinds[i]][2 * labels[parents[i]] + labels[i]] for i in range(1, 7)))
        total += weight
        content += weight * np.array(labels)
        for i in range(1, 7):
            states[i, 2 * labels[parents[i]] + labels[i]] += weight
    got, pairs = extract.marginals(nodes.tolist(), edges, parents, kinds)
    assert got == pytest.approx(content / total)
    assert pairs == pytest.approx(states / total)


def test_training_explains_the_labelled_pages():
    right = runs = 0
    for source in extract.LABELLED:
        page = extract.parse(source)
        inside = [False] * len(page.tags)
        for number in range(1, len(page.tags)):
            inside[number] = (inside[page.parents[number]] or "yes" in page.words[number]) and (
                "not" not in page.words[number])
        plain = extract.parse(re.sub(r"(?<=[ '])(?:yes|not)(?= |')", "", source))
        likely = extract.content(plain, MODEL)
        runs += len(page.runs)
        right += sum((likely[element] > 0.5) == inside[element] for element, _, _ in page.runs)
    assert right / runs > 0.95


def expected(source):
    """The article of the test tables' pages, block by block."""
    found = re.search(r"<article>(.*?)(</article>|\Z)", source, re.S)
    blocks = re.split(r"</?(?:p|h1)>", re.sub(r"<[^>]*\Z", "", found[1])) if found else []
    texts = [" ".join(html.unescape(re.sub(r"<[^>]*>", lambda t: " " if t[0] == "<br>" else "", block)).split())
             for block in blocks]
    return "\n".join(text for text in texts if text)


def test_pages_of_the_table(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    sources = {row["page_id"]: row for row in pages.collect()}
    rows = extract.main_text(pages).collect()
    assert len(rows) == len(sources)
    for row in rows:
        source = sources[row["page_id"]]
        assert row["url"] == source["url"]
        assert row["text"] == expected(source["html"])
        assert row["n_chars"] == len(row["text"])


STORY = ["The river", "Long ago the river changed its bed, and people moved.", "It rained.", "x"]
CLUTTER = [
    "<nav><ul><li><a href='/'>Home</a><li><a href='/x'>News</a></ul></nav>", "<header><p>Site of sites</p></header>",
    "<aside><h2>Related</h2><p>Some other story that is long enough to be read.</p></aside>",
    "<div class='cookie-notice'>We use cookies to make this site work for you.</div>", "<div class=\"ad\">Buy a boat!</div>",
    "<form><p>Name <input name=n></p><button>Send</button></form>", "<script>var t='<p>no</p>';</script>",
    "<style>p{margin:0}</style>", "<section class='comments'><p>I liked the story very much, thank you.</p></section>",
    "<div id='sidebar'><p>Popular today is the story of the hill.</p></div>", "<!-- <p>hidden</p> -->",
    "<footer>&copy; somebody. All rights are kept.</footer>", "<noscript>Turn scripts on.</noscript>",
]


@pytest.mark.parametrize("seed", range(25))
def test_clutter_around_and_inside(seed):
    draw = random.Random(seed)
    blocks = [f"<h1>{STORY[0]}</h1>"] + [draw.choice(["<p>{}</p>", "<p>{}", "<p><b>{}</b></p>", "<div><p>{}</p></div>"])
                                         .format(text) for text in STORY[1:]]
    inner = [CLUTTER[i] for i in (2, 4, 5, 6, 7, 8, 10, 12)]
    for clutter in draw.sample(inner, 2):
        blocks.insert(draw.randrange(1, len(blocks) + 1), clutter)
    around = draw.sample(CLUTTER, 6)
    page = f"<html><head><title>t</title></head><body>{''.join(around[:3])}<article>{''.join(blocks)}</article>{''.join(around[3:])}</body></html>"
    assert text_of(page) == "\n".join(STORY)


def test_characters_and_space():
    page = "<article><h1>A&nbsp;&amp;&#32;B &lt;c&gt;</h1><p> one\n\t two<br>three &eacute;&#x1F600; &am</p></article>"
    assert text_of(page) == "A & B <c>\none two three é😀 &am"


def test_damaged_pages():
    for page in (None, "", "   ", "<", "<p", "<!--", "<article", "</p></p>", "<script>never closed <p>x</p>"):
        assert text_of(page) == ""
    assert text_of("<article><h1>T</h1><p>one <a title='x>y'>two</a></p><p class='cut") == "T\none two"
    deep = "<article>" + "<div>" * 20_000 + "<p>The river changed its bed.</p>"
    assert isinstance(text_of(deep), str)
    long = "<article><h1>T</h1><p>" + "word " * 100_000 + "</p></article>"
    assert len(text_of(long)) == 2 + 5 * 100_000 - 1


@pytest.mark.parametrize("tag", [
    """<a href="x"">""", "<a title=it's>", "<a don't>", "<a '>", '<a ">', "<a href=x?q='>", """<a title="x"y='z'">""",
    "<a href = 'x>y' title=\"a>b\">", "<a ==>", "<a = '>", "<a href=>", "<a / ='>"])
@pytest.mark.parametrize("more", ["", "It's said.", 'A "word" here.'])
def test_stray_quotes(tag, more):
    page = f"<article><h1>T</h1><p>The river {tag}changed</a> its bed.</p><p>People moved. {more}</p></article>"
    assert text_of(page) == f"T\nThe river changed its bed.\n{f'People moved. {more}'.strip()}"


def test_an_open_string_ends_with_its_tag_if_no_quote_follows():
    assert text_of("<article><h1>T</h1><p>one <a href='x>two</a> three.</p></article>") == "T\none two three."


def test_many_quotes_take_linear_time():
    for part in ("<a ='", "<a '", '<a ="\'', "<a x = ", "a='b"):
        assert isinstance(text_of("<article><p>one</p>" + part * 50_000), str)


def test_math_svg_and_objects_are_text():
    page = ("<article><h1>T</h1><p>Here <math><semantics><mrow><mi>x</mi><mo>=</mo><mn>2</mn></mrow>"
            "<annotation encoding='application/x-tex'>x=2</annotation></semantics></math> holds.</p>"
            "<p>The river changed its bed.</p><svg><title>no</title><path d='M0'/><text>Drawn words of the article.</text></svg>"
            "<object><p>People moved, as the map shows.</p></object></article>")
    assert text_of(page) == ("T\nHere x=2 holds.\nThe river changed its bed.\nDrawn words of the article.\n"
                             "People moved, as the map shows.")


def test_odd_rows(spark):
    rows = [(None, None, None, "t"), (1, "u", "", "t"), (1, "u", "", "t"), (2, None, "<article><p>The river.</p></article>", None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    found = sorted((str(r["page_id"]), r["url"], r["text"], r["n_chars"]) for r in extract.main_text(pages).collect()
                   if r["url"])
    assert found == [("1", "u", "", 0)] * 2
    assert extract.main_text(pages).where("page_id = 2").first()["text"] == "The river."
    assert extract.main_text(pages.limit(0)).collect() == []
