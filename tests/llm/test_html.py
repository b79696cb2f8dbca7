"""Main text: the scan against all runs, learned weights, and pages of many layouts."""

import random

import pytest

from millrace.llm import html_text

TEXT = "<p>One two three four</p><p>five six seven eight nine ten</p>"
WANT = "One two three four five six seven eight nine ten"
MENU = "<ul>" + "".join(f'<li><a href="/{i}">Entry number {i}</a></li>' for i in range(30)) + "</ul>"


def test_scan_against_all_runs():
    rnd = random.Random(1)
    for n in range(300):
        gains = [rnd.choice([-2.0, -1.0, -0.5, 0.0, 0.5, 1.0, 3.0]) for _ in range(n % 25)]
        sums = [(sum(gains[a:b]), -a, b) for a in range(len(gains)) for b in range(a + 1, len(gains) + 1)]
        start, end = html_text.best_run(gains)
        if not sums or max(sums)[0] <= 0:
            assert (start, end) == (0, 0)
            continue
        assert sum(gains[start:end]) == max(sums)[0]
        # of equal sums: no other run of that sum begins and ends before this one begins
        assert not any(s == max(sums)[0] and b <= start for s, _, b in sums)
    assert html_text.best_run([1.0, -1.0, 1.0]) == (0, 1) or html_text.best_run([1.0, -1.0, 1.0]) == (0, 3)
    assert html_text.best_run([2.0, -3.0, 2.0]) == (0, 1) and html_text.best_run([1.0, 0.0]) == (0, 2)


@pytest.mark.parametrize("page,want", [
    (f'<div class="social science">{TEXT}</div>', WANT),
    (f'<body><div class="legal">{TEXT}</div></body>', WANT),
    (f"<body>{MENU}<div>{TEXT}</div></body>", WANT),
    ("<p>Let <math><mi>x</mi><mo>=</mo><mn>1</mn></math> be one of them.</p>", "Let x=1 be one of them."),
    (f'<article><header><h1>Title</h1><p>by someone</p></header>{TEXT}</article>', f"Title {WANT}"),
    (f'<body><header><h1>Site name</h1></header><main>{TEXT}</main></body>', WANT),
    (f"<main>{TEXT}<nav>{MENU}</nav>{TEXT}</main>", f"{WANT} {WANT}"),
    (f'<main>{TEXT}<div class="ad">{MENU}</div>{TEXT}</main>', f"{WANT} {WANT}"),
    ('<article><p>See <a href="/x">this page</a> for more of it, and the rest.</p></article>', "See this page for more of it, and the rest."),
    (f'<article><a name="top">{TEXT}</article>', WANT),
    (f'<article>{TEXT}</article><div id="comments"><p>{"I like it so much. " * 30}</p></div>', WANT),
    (f'<article>{TEXT}<section class="comments"><p>{"I like it so much. " * 30}</p></section></article>', WANT),
    (f'<div class="cookie-notice">We use cookies here and there</div><div>{TEXT}</div><footer>All rights</footer>', WANT),
    (f"<div>{TEXT}</div><script>var a = '<p>no text at all here, no text at all here</p>'</script>", WANT),
    ("plain words", "plain words"), ("", ""), (None, ""), ("<p>" * 3000, ""), ("a\x00b &lt;c&gt; &amp;amp;", "a b <c> &amp;"),
    ("<p>x" + " word" * 20_000 + "</p>", "x" + " word" * 20_000), (f"<nav>{MENU}</nav>", ""),
])
def test_layouts(page, want):
    assert html_text.main_text(page, html_text.Weights([])) == want


def test_learned_weights_win_over_names(spark):
    """Pages of one site name their text `widget`, which the table's labelled pages show; another site's page has no <article>."""
    labelled = [(i, f'<div class="top">Some other words {i}</div><article><div class="widget">{TEXT}</div></article>') for i in range(40)]
    pages = [*labelled, (100, f'<div class="top">Some other words again and again</div><div class="widget">{TEXT}</div>'), (101, None), (101, None)]
    df = spark.createDataFrame(pages, "page_id long, html string").selectExpr("page_id", "html", "'u' AS text", "1 AS __html")
    out = [(r.page_id, r.text) for r in html_text.extract(df).collect()]
    assert sorted(out) == sorted([*((i, WANT) for i in range(40)), (100, WANT), (101, ""), (101, "")])
    assert html_text.extract(df.limit(0)).count() == 0


P1 = "<p>" + "A paragraph of the text with some words of its own. " * 3 + "</p>"
T1 = " ".join(("A paragraph of the text with some words of its own. " * 3).split())
LIST = "<ul><li>First point of the argument</li><li>Second</li></ul>"
SMALL = "".join(f"<div><p>short block {i}</p></div>" for i in range(6))
BLOCKS = " ".join(f"short block {i}" for i in range(6))


@pytest.fixture(scope="module")
def given(spark):
    """The weights that the query learns from the given pages."""
    found = {}
    for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("html").collect():
        for k, (outside, inside) in html_text.counted(r.html).items():
            n = found.setdefault(k, [0, 0])
            n[0], n[1] = n[0] + outside, n[1] + inside
    assert found
    return html_text.Weights([(*k, *n) for k, n in sorted(found.items())])


@pytest.mark.parametrize("page,want", [
    (f"<article>{P1}{LIST}<p>End of it.</p></article>", f"{T1} First point of the argument Second End of it."),
    (f"<body><nav>{MENU}</nav>{P1}{LIST}<p>End of it.</p><footer>foot</footer></body>", f"{T1} First point of the argument Second End of it."),
    (f"<article>{SMALL}</article>", BLOCKS), (f"<body>{SMALL}</body>", BLOCKS), (f"<body><nav>{MENU}</nav><div>{SMALL}</div><aside>{P1}</aside></body>", BLOCKS),
    ("<article><h1>Heading</h1><ul><li>one</li><li>two</li></ul></article>", "Heading one two"),
    (f"<body>{P1}{MENU}{MENU}{P1}</body>", f"{T1} " + " ".join([f"Entry number {i}" for i in range(30)] * 2) + f" {T1}"),
    (f'<body><div class="legal"><article>{P1}{P1}</article></div><p>short one</p></body>', f"{T1} {T1}"),
    (f'<article>{P1}<table><tr><td>a</td><td>b</td></tr></table><div class="ad">buy</div><nav>{MENU}</nav>{P1}</article>', f"{T1} a b {T1}"),
    (f'<article>{P1}</article><div class="discussion"><p>{"I like it so much. " * 30}</p></div>', T1),
    (f'<div class="intro"><p>{"Words before it. " * 20}</p></div><main>{P1}{LIST}</main>', f"{T1} First point of the argument Second"),
    (f'<article> <nav>{MENU}</nav></article><div>{P1}</div>', T1),
    (f'<div class="ad">{P1}</div>{P1}', T1),
])
def test_whole_article_with_the_given_weights(given, page, want):
    assert html_text.main_text(page, given) == want


def test_menus_say_nothing_of_lists_in_texts(given):
    """The given pages have lists in menus only; their weights are of those."""
    assert given.word.get("body>nav>ul", 1) < given.word.get(">body>article", 0) and given.word["div.ad"] < 0
    assert given.of_word("article>ul", False) == given.of_word("body>ul", False) == html_text.IN
    assert given.of_tag("li", False) == given.of_tag("ul", False) == html_text.TAG
