from murmurlake.llm import html_extract


def test_adverts_do_not_cut_a_long_text():
    advert = "<div class=advert>Buy now</div>"
    first, later, closing = "word " * 2500, "later " * 50, "The end."
    page = f"<body><div class=menu><a href=1>One</a></div><div><p>{first}</p>{advert}<p>{later}</p>{advert}<p>{closing}</p></div><div><span>x</span></div></body>"
    assert html_extract.main_text(page).split("\n\n")[:3] == [first.strip(), later.strip(), closing]
    wrapped = f"<body><div><div><p>{first}</p></div>{advert}<div>{later}</div><aside>no</aside><div><p>{closing}</p></div></div></body>"
    assert html_extract.main_text(wrapped) == "\n\n".join([first.strip(), later.strip(), closing])


def test_short_lines_of_other_containers_stay_out():
    page = f"<body><div><p>{'word ' * 40}</p><p>Short.</p></div><aside>a</aside><div><p>Top</p><p>Back</p></div></body>"
    assert html_extract.main_text(page) == ("word " * 40).strip() + "\n\nShort."


def test_windows_decide_inside_an_article_too():
    links = "<ul>" + "".join(f"<li><a href={i}>Link {i}</a></li>" for i in range(5)) + "</ul>"
    page = f"<article><p>{'word ' * 30}</p><p><a href=x>Read the source</a></p><p>More.</p>{links}<p>End.</p></article>"
    texts = html_extract.main_text(page).split("\n\n")
    assert texts == [("word " * 30).strip(), "Read the source", "More.", "End."]
    assert html_extract.stretches_of([0, 50, 0, 40, 0, 0, 0, 90], 3, 80) == [(1, 4), (7, 8)]


def test_labelled_pages_without_article_tags():
    """Blocks of pages put together here, so that what belongs to the text is known."""
    import random

    r = random.Random(11)
    sentence = lambda n: " ".join(r.choice(["stone", "river", "of", "light", "walks", "under", "seven", "old"]) for _ in range(n)).capitalize() + "."
    good = found = hit = 0
    for i in range(120):
        paras = [sentence(r.choice([2, 5, 20, 60])) for _ in range(r.randrange(3, 15))]
        paras[0] = sentence(40)
        body = []
        for p in paras:
            body.append(f"<p>{p}</p>" if r.random() < 0.8 else f"<blockquote>{p}</blockquote>")
            if r.random() < 0.2:
                body.append(r.choice(['<div class="ad">Buy one now, get one free, only this week.</div>', "<aside>Read also our other pages</aside>", "<form><input> Search here</form>", "<!-- x --><script>var a = 1;</script>"]))
        menu = "".join(f"<li><a href=/{k}>{sentence(2)}</a></li>" for k in range(6))
        page = f"<html><head><title>T</title><style>p{{}}</style></head><body><div><ul>{menu}</ul></div><div>{'<h1>Title of it</h1>' if i % 2 else ''}{''.join(body)}</div>"
        page += f'<div class="{r.choice(["comments", "sidebar", "cookie-notice"])}">{sentence(30)}</div><div><a href=1>Top</a> <a href=2>Contact</a></div><footer>{sentence(25)}</footer></body></html>'
        want = (["Title of it"] if i % 2 else []) + paras
        got = html_extract.main_text(page).split("\n\n")
        good, found, hit = good + len(want), found + len(got), hit + len([x for x in got if x in want])
    assert hit / found > 0.98 and hit / good > 0.98, (hit, found, good)


def test_edges(spark):
    schema = "page_id long, url string, html string, n_chars int"
    assert html_extract.extract_pages(spark.createDataFrame([], schema)).count() == 0
    rows = [(1, None, "<p>" + "w " * 50 + "</p>", 1)] * 2 + [(None, "u", None, None)]
    assert sorted(r.n_chars for r in html_extract.extract_pages(spark.createDataFrame(rows, schema)).collect()) == [0, 99, 99]
