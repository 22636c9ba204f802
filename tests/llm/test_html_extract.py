from corpuslake.llm import html_extract as hx

SHELL = """<!DOCTYPE html><html><head><title>T {i}</title><style>p{{}}</style><script>var a="<p>no</p>";</script></head>
<body><nav><ul><li><a href=/a>Menu{i}</a><li><a>Other</a></ul></nav><div class="ad">Buy {i}</div>
<div class="cookie-notice"><p>We use cookies</p></div>{main}
<aside><p>Side {i}</p></aside><section id="comments"><p>Nice {i}</p></section>
<form><label>Mail</label><input name=q></form><footer>&copy; host {i}</footer></body></html>"""


def page(i, main):
    return SHELL.format(i=i, main=main)


def article(i):
    return (f"<article><h1>Head &amp; {i}</h1><p><b>First</b>ly\n\t here {i}<br>next<p>Two &lt;x&gt; &eacute;{i}"
            f"<div class='share-links'><a>Share</a></div><p>Read our newsletter</p></article>")


def answer(spark, rows):
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    return {r.page_id: r for r in hx.extract(df).collect()}


def test_article_without_the_rest(spark):
    rows = [(i, f"http://h.org/{i}", page(i, article(i))) for i in range(12)]
    got = answer(spark, rows)
    # The line that all pages of the host share belongs to the template.
    assert got[3].text == "Head & 3 Firstly here 3 next Two <x> é3"
    assert got[3].n_chars == len(got[3].text) and got[3].url == "http://h.org/3"


def test_few_pages_keep_shared_lines(spark):
    got = answer(spark, [(1, "http://h.org/1", page(1, article(1))), (2, None, page(2, article(2)))])
    assert got[1].text == "Head & 1 Firstly here 1 next Two <x> é1 Read our newsletter"
    assert got[2].text.startswith("Head & 2")


def test_pages_without_article_element(spark):
    body = lambda i: f"<div id=content><h2>Title {i}</h2><p>{'long text ' * 30}{i}</p></div><div class=menu>x</div>"
    got = answer(spark, [(i, f"http://k.org/{i}", page(i, body(i))) for i in range(3)])
    assert got[0].text == "Title 0 " + "long text " * 30 + "0"


def test_odd_rows(spark):
    rows = [(1, None, None), (2, "x", ""), (None, "http://a.b/", "plain <b>text</b>"), (4, "http://a.b/", "<p>unclosed <i"),
            (5, "http://a.b/c", "<article>" + "<p>w</p>" * 3000), (5, "http://a.b/c", "<article>" + "<p>w</p>" * 3000)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = sorted([tuple(r) for r in hx.extract(df).collect()], key=str)
    assert len(got) == 6 and got.count((5, "http://a.b/c", " ".join(["w"] * 3000), 5999)) == 2
    assert (1, None, "", 0) in got and (2, "x", "", 0) in got
    assert hx.extract(df.limit(0)).count() == 0


def test_names_never_set_the_page_or_most_of_its_text_apart(spark):
    text = "long text " * 30
    bodies = [
        f"<body class='no-sidebar has-header'><div id=c><p>{text}</p></div></body>",
        f"<body><div class='layout right-sidebar'><div id=c><p>{text}</p></div><div class=sidebar>side words</div></div></body>",
        f"<body><article class='review'><p>{text}</p></article><div class=related>more here</div></body>",
        f"<html class='nav-open'><body><main id=form><p>{text}</p></main></body></html>",
        f"<body><form id=aspnet><div class=menu><a>{text * 2}</a></div><div id=c><p>{text}</p></div></form></body>",
        f"<body><article><p>{text}</p></article><section id=comments><p>{text * 2}</p></section></body>",
    ]
    got = answer(spark, [(i, f"http://n{i}.org/", b) for i, b in enumerate(bodies)])
    assert {i: r.text for i, r in got.items()} == {i: text.strip() for i in range(len(bodies))}
    assert got[0].n_chars == len(text.strip())


def test_repeated_article_text_stays_at_every_host_size(spark):
    def body(i, own):
        return (f"<html><body><nav><a>Menu {i}</a></nav><article><h1>Daily report</h1><p>{own}</p>"
                f"<p>Second part {'of it ' * 9}</p><div class=ad>Buy {i}</div><p>Third part {'of it ' * 9}</p>"
                f"<p>Yours, the editors</p></article></body></html>")

    rest = f" Second part {'of it ' * 9}Third part {'of it ' * 9}Yours, the editors"
    rows, want = [], {}
    for n in (1, 2, 7, 8, 20):
        for i in range(n):
            for host, own in ((f"copies{n}", "The same"), (f"near{n}", f"Nearly the same {i}")):
                rows.append((len(rows), f"http://{host}.org/{i}", body(i, own)))
                want[len(rows) - 1] = f"Daily report {own}{rest}"
    # Headings and closing lines that a host's articles share belong to them.
    for n in (2, 7, 8, 20):
        for i in range(n):
            own = " ".join(f"word{i}x{k}" for k in range(40))
            rows.append((len(rows), f"http://letters{n}.org/{i}",
                         f"<article><h1>Letter</h1><p>{own}</p><p>Yours, the editors</p><div class=share>Share</div><p>Join us</p></article>"))
            want[len(rows) - 1] = f"Letter {own} Yours, the editors"
    for i in range(4):  # the template is that of other pages
        rows.append((len(rows), "http://copies20.org/other", f"<article><p>Another {i}</p></article>"))
        want[len(rows) - 1] = f"Another {i}"
    assert {i: r.text for i, r in answer(spark, rows).items()} == want


def test_slots_of_links_go_whatever_their_name(spark):
    def body(i):
        return (f"<html><body><article><h1>Head {i}</h1><p>{'own words ' * 20}{i}</p><div class=x1><a>See {i}</a> <a>Also {i}</a></div>"
                f"<p>Last words <a>link {i}</a> of {i}</p></article></body></html>")

    got = answer(spark, [(i, f"http://h.org/{i}", body(i)) for i in range(6)])
    assert got[2].text == f"Head 2 {'own words ' * 20}2 Last words link 2 of 2"


def layout(spark, pages):
    rows = [(f"http://h.org/{i}", h) for i, h in enumerate(pages)]
    df = spark.createDataFrame(rows, "url string, html string").selectExpr("'h' AS host", "xxhash64(url) AS page", "html")
    known = hx.classes(df)
    found = known.join(hx.facts(df, hx.layouts(known)), "host").first().asDict(recursive=True)
    return found["pages"], found["classes"], found["facts"]


def test_classes_share_vectors_and_keep_their_order(spark):
    # Two texts change places on every other page, so that one of them leaves their class.
    pages = [f"<main><p>Top line</p><p>own {i}</p>" + ("<h2>One here</h2><h3>Two here</h3>" if i % 2 else
             "<h3>Two here</h3><h2>One here</h2>") + "</main>" for i in range(4)]
    n, groups, told = layout(spark, pages)
    by_path = {m["path"]: k for k, g in enumerate(groups) for m in g["members"] if m["path"] is not None}
    assert by_path[""] == by_path["main"] == by_path["main/h2"] != by_path["main/p"]
    container, fixed, _ = hx.induce(n, groups, told)
    top, one, two = (hx.token_of(p, t) for p, t in (("main/p", "Top line"), ("main/h2", "One here"), ("main/h3", "Two here")))
    assert container == "main" and top in fixed and not {one, two} <= set(fixed)


def test_crossing_classes_are_told(spark):
    found = {1: ("a", [0], [5], 2), 2: (None, [1, 3], [], 2), 3: (None, [2], [], 2), 4: (None, [4], [], 2)}
    outer, loop, pair = {(1, hx.START): 0, (1, hx.END): 1}, {(2, hx.START): 0}, {(3, hx.START): 0, (4, hx.START): 1}
    assert hx.lay_out(found, [outer, loop, pair]) == (set(), set())
    found[4] = (None, [6], [], 2)
    assert hx.lay_out(found, [outer, loop, pair]) == (set(), {(0, 2)})
    assert hx.rising([3, 1, 2, 5, 4]) in ([1, 2, 4], [1, 2, 3])
