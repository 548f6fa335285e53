import random
import re
import time

from wayfold.llm.html import _Tags, extract, main_text

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="</p>";</script></head><body>
<header class="site"><a href="/">Home</a></header><nav><ul><li><a href="/a">Menu, one</a></li></ul></nav><!-- ad <p>no</p> -->
<div class="ad">Buy, now, this, thing, please, it, is, cheap.</div>
<article><header><h1>The &amp; title</h1><span>By someone</span></header><p>First&nbsp;line,
 with   space &lt;b&gt; and <b>bold</b> text.<p>Of.</p><ul><li>one<li>two</ul><aside>Side</aside>
<div class="share-buttons">Share</div><blockquote>Quote.</blockquote></article>
<div id="comments"><p>Reader, comment, long, long, long.</p></div><div class="cookie-notice">We use, cookies.</div>
<form><p>Sign, up</p></form><footer>&copy; x</footer>"""


def test_article():
    assert main_text(PAGE) == "The & title\nFirst line, with space <b> and bold text.\nOf.\none\ntwo\nQuote."


def test_scores_find_the_container_without_semantic_tags():
    body = "".join(f"<p>Sentence {i}, with some words, and a few more words to make it long enough.</p>" for i in range(6))
    page = f"<body><div class='menu'><a>x</a></div><div><div id=left><a href=1>A, b</a> <a href=2>C, d</a></div><div id=content>{body}<p>End.</p></div></div></body>"
    got = main_text(page).split("\n")
    assert len(got) == 7 and got[-1] == "End." and got[0].startswith("Sentence 0")


def test_edges(spark):
    deep = "<div>" * 3000 + "deep text, here" + "</div>" * 3000
    rows = [(1, "u", None), (2, "u", ""), (3, "u", "<p>just one"), (3, "u", "<p>just one"), (4, None, "<<<>>> & <a href='"), (5, "u", deep), (6, "u", "<script>x")]
    df = spark.createDataFrame([(*r, "t", 1) for r in rows], "page_id long, url string, html string, text string, n_chars int")
    got = extract(df).orderBy("page_id").collect()
    assert [r.text for r in got][:4] == ["", "", "just one", "just one"] and got[5].text == "deep text, here" and got[6].text == ""
    assert all(r.n_chars == len(r.text) for r in got) and extract(df.limit(0)).count() == 0


def test_junk_names_do_not_take_the_article():
    body = "".join(f"<p>Sentence {i}, with some words, and a few more words to make it long enough.</p>" for i in range(4))
    want = [f"Sentence {i}, with some words, and a few more words to make it long enough." for i in range(4)]
    side = "<div class='sidebar'><p>Side, by side.</p></div>"
    for wrap in ("<div class='content has-sidebar'>%s</div>", "<div id='page' class='no-comments'>%s</div>", "<section class='reader-content'>%s</section>", "<div class='widget'><article>%s</article></div>"):
        assert main_text(f"<body>{wrap % body}{side}</body>").split("\n") == want
    page = f"<article>{body}<p class='notice'>Note this.</p><p>A <span class='social'>social</span> word.</p><div class='share'>Share</div></article>{side}"
    assert main_text(page).split("\n") == [*want, "Note this.", "A social word."]


LINES = [f"Sentence {i}, with some words, and a few more words to make it long enough." for i in range(6)]
BODY = "".join(f"<p>{x}</p>" for x in LINES)


def test_characters_whose_lower_case_is_longer():
    page = f"<article><p>{'İ' * 30}</p><script>var a = 1;</SCRIPT><p>Second, and last.</p></article>"
    assert main_text(page) == "İ" * 30 + "\nSecond, and last."


def test_headline_of_a_head_by_class_stays():
    page = f"<body><article><div class='article-header'><h1>Title</h1><span>By me</span></div>{BODY}</article></body>"
    assert main_text(page).split("\n") == ["Title", *LINES]


def test_teasers_go_and_parts_of_the_story_stay():
    page = f"<body><div><article>{BODY}</article><article><p>Teaser, one.</p></article></div></body>"
    assert main_text(page).split("\n") == LINES
    page = f"<body><div><div class='story'>{BODY}</div><div class='story'><p>Short end.</p></div><div class='more'><p>Other.</p></div></div></body>"
    assert main_text(page).split("\n") == [*LINES, "Short end."]
    page = f"<main><div class='list'><a href='/a'>{'All, the, links ' * 9}</a></div><div><h2>Head</h2>{BODY}</div><p>Too short.</p></main>"
    assert main_text(page).split("\n")[-8:] == ["Head", *LINES, "Too short."]


def test_very_long_page_with_unclosed_tags():
    n = 20_000
    got = main_text("<article>" + "".join(f"<p>Part {i}, of <b>many" for i in range(n)))
    assert got.split("\n") == [f"Part {i}, of many" for i in range(n)]


BODY = "".join(f"<p>Sentence {i}, with some words, and a few more words to make it long enough.</p>" for i in range(6))
LINES = [f"Sentence {i}, with some words, and a few more words to make it long enough." for i in range(6)]


def test_shells_around_the_whole_page():
    side = "<form class=search><p>Find, what, you, want.</p></form><dialog><p>We, have, cookies.</p></dialog>"
    for shell in ("<form id=aspnetForm>%s</form>", "<fieldset>%s</fieldset>", "<object>%s</object>", "<dialog open>%s</dialog>", "<form><fieldset>%s</fieldset></form>"):
        assert main_text(f"<body>{shell % f'<div id=content>{BODY}</div>'}{side}</body>").split("\n") == LINES
    assert main_text(f"<article>{BODY}<form><p>Sign up, now.</p><label>Name</label></form><p>A <label>Label</label> end.</p></article>").split("\n") == [*LINES, "A end."]


def test_headline_outside_the_story_and_formulas():
    assert main_text(f"<body><div><h1>The title</h1><div class=story>{BODY}</div><h1>Other</h1></div></body>").split("\n") == ["The title", *LINES]
    assert main_text(f"<body><div><h1><a href='/'>Site</a></h1><div class=story>{BODY}</div></div></body>").split("\n") == LINES
    assert main_text(f"<article>{BODY}<p>The energy <math><mi>E</mi><mo>=</mo></math> is.</p></article>").split("\n")[-1] == "The energy E= is."


def test_time_is_linear_in_the_length():
    n = 500_000
    pages = {
        "unclosed tags": "<a " * (n // 3), "end tags of nothing": "<b>" * (n // 8) + "</i>" * (n // 8), "nested": "<div>" * (n // 5),
        "junk in one line": "<div>" + "<span class=ad>x</span>" * (n // 23) + "</div>", "open quotes": "<a \"> '" * (n // 7), "quoted ends": "<a \">\" " * (n // 7),
        "one long name": "<a" * (n // 2) + ' " >', "behind a stop": "<p><table>" + "<div>" * (n // 5), "notes": "<!-" * (n // 3), "signs": "<" * n, "items": "<li>" * (n // 4),
    }
    for name, page in pages.items():
        began = time.process_time()
        main_text(page)
        assert time.process_time() - began < 15, name


def test_tags_as_a_plain_search_finds_them():
    token = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*+)>""", re.S)
    r = random.Random(6)
    bits = ["<", "<a ", "</b>", ">", '"', "'", "<!--", "-->", "<p>", "text", " ", "<br/>", "<?", "<!x", '<x"y>', "<i k='>'>", "\n"]
    for _ in range(5000):
        page = "".join(r.choice(bits) for _ in range(r.randint(1, 25)))
        tags, at, got = _Tags(page), 0, []
        while (found := tags.next(at)) is not None:
            got.append(found)
            at = found[1]
        assert got == [(m.start(), m.end(), m[1] or "", m[2] or "", m[3] or "") for m in token.finditer(page)], page
