from rankweave.sources import pages as pg

HTML_ARTICLE = ('<html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body>'
                '<nav><a href="/x">menu</a></nav><!-- ad --><div class="ad">buy now</div>'
                '<article><h1>Head &amp; line</h1><p>First <b>para</b>.<br>Second line</p></article>'
                '<footer>&copy; site</footer></body></html>')
HTML_BODY = '<html><body><div class="wrap"><p>Only body</p><aside>side</aside></div></body></html>'


def test_main_text_contract(spark):
    df = spark.createDataFrame([(1, "u1", HTML_ARTICLE), (2, "u2", HTML_BODY), (3, "u3", None)],
                               "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in pg.page_text(df).collect()}
    assert got[1] == "Head & line\nFirst para.\nSecond line"
    assert got[2] == "Only body"
    assert got[3] == ""


def test_content_attach_keeps_rows_without_pages(spark):
    pages = spark.createDataFrame([(1, "u1", HTML_ARTICLE), (2, "u1", HTML_BODY)], "page_id long, url string, html string")
    cands = spark.createDataFrame([(1, "u1"), (2, "nope"), (3, None)], "item long, url string")
    got = {r["item"]: r["content"] for r in pg.content_attach(cands, pages).collect()}
    assert got == {1: "Head & line\nFirst para.\nSecond line", 2: "", 3: ""}


def test_main_text_of_awkward_pages(spark):
    pages = [
        '<body><article><p>Text</p><div id="comments"><div>one<div>two</div></div>three</div><p>End</p></article></body>',
        '<body><p>A</p><div class="box ad"><div>buy</div> now <div>more</div></div>tail<p>B</p></body>',
        "<body><article><p>First</p></article><p>between</p><article><p>Second</p></article></body>",
        "<body><ul><li>Menu</li><li>Contact</li></ul><script>var a = '<p>';</script></body>",
        '<body><div class="address"><p>Kept</p></div></body>',
        '<body><DIV CLASS="Comment-List"><p>x</p></DIV><p>y</p></body>',
        '<body><div class="ad"><p>never closed</p></body>',
    ]
    df = spark.createDataFrame([(i, "u", p) for i, p in enumerate(pages)], "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in pg.page_text(df).collect()}
    assert got == {0: "Text\nEnd", 1: "A\ntail\nB", 2: "First", 3: "", 4: "Kept", 5: "y", 6: ""}


def texts(spark, pages):
    df = spark.createDataFrame([(i, "u", p) for i, p in enumerate(pages)], "page_id long, url string, html string")
    return [r["text"] for r in pg.page_text(df).orderBy("page_id").collect()]


LONG = "A paragraph of plain text that is long enough to weigh more than any menu around it does."
MENU = "<ul>" + "".join(f'<li><a href="/{i}">Section number {i}</a></li>' for i in range(6)) + "</ul>"


def test_main_text_by_density(spark):
    got = texts(spark, [
        # a menu and teasers inside the article, at its edge and between paragraphs
        f"<body><article><div>{MENU}</div><h1>Head</h1><p>{LONG}</p>{MENU}<p>{LONG} <a href='/x'>one link</a></p>"
        f"<p><a href='/a'>Read more about this</a></p></article></body>",
        # no article, no semantic tags: the run of text between link lists
        f"<body><div>{MENU}</div><div><div><p>{LONG}</p></div><p>Short.</p></div><div>{MENU}</div><div>Imprint</div></body>",
        # deep nesting, unclosed and stray tags
        f"{'<div>' * 60}<p>{LONG}</div></div><p>{LONG}</p>{'</div>' * 60}",
        f"<body><article><p>{LONG}</div></section><p>Tail</p></article><footer><p>Foot</p></footer></body>",
        # the main article is not the first, which is a short teaser
        f"<body><article><p>Teaser</p></article><article><p>{LONG}</p></article></body>",
        # main without article; an article of links only
        f"<body><div>Site name</div><main><p>{LONG}</p></main><div>{LONG}</div></body>",
        f"<body><article>{MENU}</article><p>{LONG}</p></body>",
        "<body>" + MENU + "</body>",
        f"<p>{LONG}</p>", "", "no tags at all", "<p>1 &lt; 2 &amp;&nbsp;3</p>",
    ])
    assert got == [f"Head\n{LONG}\n{LONG} one link", f"{LONG}\nShort.", f"{LONG}\n{LONG}", f"{LONG}\nTail", LONG, LONG, LONG, "",
                   LONG, "", "", "1 < 2 & 3"]


def brute_run(weights):
    best = (0.0, 0, -1)
    for i in range(len(weights)):
        for j in range(i, len(weights)):
            if sum(weights[i:j + 1]) > best[0] + 1e-9:
                best = (sum(weights[i:j + 1]), i, j)
    return best


def test_best_run_equals_brute_force(spark):
    import random

    from pyspark.sql import functions as F

    rnd = random.Random(1)
    rows = [(n, [{"text": "t", "chars": rnd.randint(0, 20), "links": rnd.randint(0, 9), "part": n % 2} for _ in range(rnd.randint(0, 12))])
            for n in range(200)]
    df = spark.createDataFrame(rows, f"n long, b {pg.BLOCK_DDL}")
    for r in df.select("b", pg._best_run(F.col("b")).alias("r")).collect():
        weights = [x["chars"] - pg.LINK_COST[1 - x["part"]] * x["links"] for x in r["b"]]
        best = brute_run(weights)[0]
        assert abs(r["r"]["best"] - best) < 1e-9
        assert abs(sum(weights[r["r"]["first"]:r["r"]["last"] + 1]) - best) < 1e-9
