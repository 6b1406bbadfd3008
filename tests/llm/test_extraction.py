"""Template deduction against plain occurrence vectors, and what it must not take."""

import random
from collections import Counter

from armada.llm import extraction
from texts import prose


def frame(spark, rows):
    return spark.createDataFrame([(i, f"http://{host}/{i}", html) for i, (host, html) in enumerate(rows)], "page_id long, url string, html string").repartition(3)


def texts(spark, rows):
    got = {r.page_id: r.text for r in extraction.extracted(frame(spark, rows)).collect()}
    return [got[i] for i in range(len(rows))]


def test_mirrors_keep_their_article(spark):
    article = f"<article><h1>One story</h1><p>{prose(1, 30)}</p></article>"
    rows = [("m", f"<html><body><script>v{i}</script><a href='?s={i}'>s{i}</a>{article}</body></html>") for i in range(7)]
    rows += [("n", f"<html><body><script>v{i}</script><div>{prose(2, 9)}</div></body></html>") for i in range(7)]  # none at all
    got = texts(spark, rows)
    assert got[:7] == [f"One story {prose(1, 30)}"] * 7 and got[7:] == [prose(2, 9)] * 7


def test_ids_on_headings_and_in_the_article_drop_nothing():
    page = (
        "<body><div id='sidebar'>side</div><p id='menu'>Par</p><article><h2 id='search'>Search</h2><p id='comments'>On comments</p>"
        "<section id='notice'><h3 class='related'>Notice</h3>text</section><div class='comments'>reader</div><p class='ad-free'>free</p></article></body>"
    )
    assert extraction.main_text(page, set()) == "Search On comments Notice text free"
    assert extraction.main_text("<body><div id='sidebar'>side</div><p id='menu'>Par</p></body>", set()) == "Par"


def test_what_repeats_on_every_page_goes(spark):
    menu = "<ul><li>Start</li><li>Topics</li><li>People</li></ul>"
    rows = []
    for i in range(8):
        paragraphs = "".join(f"<p>{prose(100 * i + k, 12)}</p>" for k in range(1 + i % 3))
        rows.append(("h", f"<html><body><div>{menu}<article><h1>T{i}</h1>{paragraphs}<p>Sign up for our letter</p></article></div></body></html>"))
    for i, text in enumerate(texts(spark, rows)):
        assert text == " ".join([f"T{i}", *(prose(100 * i + k, 12) for k in range(1 + i % 3))])
    few = texts(spark, rows[:4])
    assert all("Sign up" in t for t in few)  # too few pages to tell


def plain_templates(rows):
    vectors, roots, pages = {}, {}, sorted(set(rows))
    for host, html in pages:
        found = [(token, kind == "tag" and text == "body") for kind, token, text, *_ in extraction.tokens(html) if kind != "break" and token]
        for token, n in Counter(t for t, _ in found).items():
            vectors.setdefault((host, token), {})[html] = n
        for token, root in found:
            if root:
                roots.setdefault(host, set()).add(token)
    held = {}
    for (host, token), vector in vectors.items():
        if len(vector) >= extraction.LEAST_PAGES and any(vectors[host, r] == vector for r in roots.get(host, ())):
            held.setdefault(host, set()).add(token)
    return held


def test_templates_are_the_classes_of_the_body_tags(spark):
    chance, rows = random.Random(5), []
    for i in range(60):
        parts = [f"<div>{chance.choice('abc')}</div>" for _ in range(chance.randint(0, 3))]
        layout = chance.choice(["", " class='wide'"])
        rows.append((f"h{i % 3}", f"<html><body{layout}><nav>menu</nav><p>fixed</p>{''.join(parts)}<p>{prose(i % 40, 4)}</p></body></html>"))
    rows += rows[:5]
    from armada.llm.urls import host_and_path
    from pyspark.sql import functions as F

    table = frame(spark, rows)
    host, _ = host_and_path(F.col("url"))
    got = {r.host: set(r.template) for r in extraction.templates(table.select("html", host.alias("host"))).collect()}
    assert got == plain_templates(rows) and got


def test_a_page_of_several_megabytes(spark):
    text = prose(4, 400_000)
    (got,) = texts(spark, [("big", f"<body><nav>x</nav><article><p>{text}</p></article></body>")])
    assert got == text


def test_a_notice_on_part_of_the_pages_goes_by_its_class(spark):
    """Nested under the template: not of the class of the body tag, and neither tag nor marks name it."""
    rows, wanted = [], []
    for i in range(20):
        own = [prose(300 * i + k, 12) for k in range(1 + i % 3)]
        notice = "<div><b>Moved</b><i>See the new place</i></div>" if i % 3 == 0 else ""
        line = "<p>A line that is told on part</p>" if i % 2 else ""  # no element of its own: the page's text
        rows.append(("h", f"<html><body><nav>m</nav><article><h1>T{i}</h1>{notice}{''.join(f'<p>{p}</p>' for p in own)}{line}</article></body></html>"))
        wanted.append(" ".join([f"T{i}", *own, *(["A line that is told on part"] if line else [])]))
    assert texts(spark, rows) == wanted
    few = [r for r in rows if "Moved" in r[1]][:4] + [r for r in rows if "Moved" not in r[1]]
    assert sum("Moved" in t for t in texts(spark, few)) == 4  # on too few pages to tell


def test_classes_must_keep_order_slot_and_nest():
    def member(name, token, places, root=False, kind=extraction.TEXT, support=6):
        return {"class": name, "token": token, "places": places, "root": root, "kind": kind, "support": support}

    tag = extraction.TAG_TOKEN
    roots = [member(0, 90, [0], True, tag), member(0, 91, [10], True, tag)]
    both = [member(1, 5, [2, 5], kind=tag), member(1, 6, [3, 6])]

    def found(*members):
        return {(c, slot): (valid, tokens) for c, slot, _, valid, tokens in extraction.in_slots([*roots, *members])}

    assert found(*both) == {(1, 90): (True, [5, 6])}
    assert found(member(1, 5, [2, 6], kind=tag), member(1, 6, [3, 5])) == {(1, 90): (False, [5, 6])}  # not in one order
    assert found(member(1, 5, [2, 12], kind=tag), member(1, 6, [3, 13])) == {}  # in two slots
    crossing = [member(2, 7, [4], kind=tag, support=7), member(2, 8, [7], support=7), member(3, 9, [5], kind=tag), member(3, 4, [8])]
    assert found(*crossing) == {(2, 90): (True, [7, 8]), (3, 90): (False, [9, 4])}
    inside = [member(2, 7, [4], kind=tag), member(2, 8, [9]), member(3, 9, [5], kind=tag), member(3, 4, [8])]
    assert found(*inside) == {(2, 90): (True, [7, 8]), (3, 90): (True, [9, 4])}


def test_an_article_on_part_of_the_pages_stays(spark):
    rows = [("h", f"<html><body><article><h1>{prose(i // 6, 4)}</h1><p>{prose(900 + i // 6, 30)}</p></article><a href='?{i}'>v{i}</a></body></html>") for i in range(18)]
    assert texts(spark, rows) == [f"{prose(i // 6, 4)} {prose(900 + i // 6, 30)}" for i in range(18)]
