from clearwell.llm.html import extract, main_text, stretches

LONG = "This paragraph has a fair amount of text, so that it counts as content of the page."


def test_article_element_with_short_edges():
    page = (f"<html><head><title>t</title></head><body><nav><a href=/>Home</a></nav><div class='cookie-notice'>{LONG}</div><article><header><h1>A &amp; B</h1>"
            f"</header><p>Sh.</p><p>{LONG}<p>in<b>side</b> one<br>line</p><script>var x='</p>';</script><div class=ad>Buy {LONG}</div><p>Les.</article>"
            f"<section id=comments><article><p>{LONG} {LONG}</p></article></section><aside>{LONG}</aside><form>{LONG}</form><footer>{LONG}</footer></body></html>")
    assert main_text(page) == f"A & B\n\nSh.\n\n{LONG}\n\ninside one line\n\nLes."


def test_surge_and_dive_without_article_element():
    links = "".join(f"<li><a href=/{i}>A menu entry of some length {i}</a></li>" for i in range(20))
    page = f"<body><ul>{links}</ul><div>x</div><h2>Head</h2><p>{LONG}</p><p>Short.</p><p>{LONG}</p><ul>{links}</ul><p>end</p></body>"
    assert main_text(page) == f"Head\n\n{LONG}\n\nShort.\n\n{LONG}"


def test_division_of_its_own_keeps_short_edges():
    page = (f"<body><div class=top>Site</div><div class=page><p>By.</p><p>On.</p><p>At.</p><p>{LONG}</p><ul><li>One.</li><li>Two.</li></ul><p>{LONG}</p>"
            f"<p>a</p><p>b</p><p>c</p><div class='adsbygoogle'>{LONG}</div></div><div>x</div><div>y</div><div>z</div></body>")
    assert main_text(page) == f"By.\n\nOn.\n\nAt.\n\n{LONG}\n\nOne.\n\nTwo.\n\n{LONG}\n\na\n\nb\n\nc"


def test_stretches_begin_at_surges_and_end_at_dives():
    assert stretches([0, 0, 50, 80, 0, 60, 0, 0, 0, 0, 5, 0]) == [(2, 6)]
    assert stretches([]) == [] and stretches([0, 0]) == []


def test_unusual_markup():
    assert main_text("plain &lt;text&gt; only") == "plain <text> only"
    assert main_text("<p>a<!-- <p>no</p> --><p>b&nbsp;&nbsp; c") == "a\n\nb c"
    assert main_text("<p>a<script>unclosed") == "a"
    assert main_text("<p title='x > y'>a < b</p>") == "a < b"
    assert main_text('<p class="x>a</p><p>b</p>') != ""
    assert main_text("<nav>only menu</nav>") == "" and main_text("<div hidden>x</div>") == ""
    assert main_text("<p>" * 20_000 + "x") == "x" and len(main_text("<p>" + "word " * 200_000)) == 999_999


def test_rows(spark):
    rows = [(1, "u", None), (2, None, ""), (None, "v", f"<article>{LONG}</article>"), (3, "w", f"<p>{LONG}"), (3, "w", f"<p>{LONG}"), (4, "x", "<nav>m</nav>")]
    docs = spark.createDataFrame([(*r, "t", 1) for r in rows], "page_id bigint, url string, html string, text string, id int")
    got = extract(docs).collect()
    assert sorted((repr(r["id"]), repr(r.url), r.text, r.n_chars) for r in got) == sorted(
        (repr(i), repr(u), LONG if h and "<nav" not in h else "", len(LONG) if h and "<nav" not in h else 0) for i, u, h in rows)
    assert extract(docs.limit(0)).count() == 0


def test_one_long_block_and_many_short_ones_in_wrapper_divisions():
    long, short = "Long block of text. " * 250, [f"Short block {i}, " + "w" * 130 for i in range(8)]
    for place in (0, 4, 8):
        blocks = [b.strip() for b in [*short[:place], long, *short[place:]]]
        body = "".join(f"<div><p>{b}</p></div>" for b in blocks)
        for inner in (body, body.replace("<div><p>", "<div class=ad>Buy this now</div><div><p>")):
            assert main_text(f"<body><div>Site</div><div class=content><p>By.</p>{inner}</div><div>Legal</div></body>") == "\n\n".join(["By.", *blocks])
            plain = main_text(f"<body><div>Site</div>{inner}<div>Legal</div></body>").split("\n\n")
            assert [x for x in plain if x not in ("Site", "Legal")] == blocks


def test_text_around_an_inner_article():
    page = f"<body><main><p>Lead. {LONG}</p><article><p>{LONG}</p><article><p>In. {LONG}</p></article></article><p>End.</p></main><p>{LONG}</p></body>"
    assert main_text(page) == f"Lead. {LONG}\n\n{LONG}\n\nIn. {LONG}\n\nEnd."


def test_deeply_nested_divisions_cost_no_square():
    assert main_text("<div>" * 20_000 + f"<p>{LONG}</p>" + "</div>" * 20_000) == LONG
    assert main_text("<div><p>a few words</p>" * 20_000).count("a few words") == 20_000


def test_two_parts_in_divisions_apart():
    page = f"<body><div>{f'<p>{LONG}</p>' * 3}</div>{'<div>x</div>' * 6}<div>{f'<p>{LONG}</p>' * 2}</div></body>"
    assert main_text(page).count(LONG) == 5
