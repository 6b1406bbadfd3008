"""Mixing, addresses, pages, toxicity and the pipeline."""

import random
import zlib

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from armada.llm import components, extraction, mixing, toxicity, urls
from texts import ODD, lower, ordered, plain_components, plain_contamination, prose


def plain_targets(sizes, weights=(5, 2, 1), share=1.5, most=2):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target, open_ = {s: 0.0 for s in names}, set(names)
    left = share * sum(sizes.values())
    while open_ and left > 1e-9:
        total = sum(weight[s] for s in open_)
        shares = {s: left * weight[s] / total for s in open_}
        left = 0.0
        for s, extra in shares.items():
            target[s] += extra
            if target[s] >= most * sizes[s]:
                left += target[s] - most * sizes[s]
                target[s] = most * sizes[s]
                open_.discard(s)
    return target


def test_mix_meets_targets(spark):
    chance = random.Random(1)
    docs = [(i, prose(i, chance.randint(0, 90)), chance.choice(["a", "b", "ü", None, "c"]), 7) for i in range(150)]
    docs += [(200 + i, t, "odd", 7) for i, t in enumerate(ODD)] + [(0, docs[0][1], docs[0][2], 7), (None, "x y", "a", 7), (400, None, "empty", 7)]
    table = spark.createDataFrame(docs, "doc_id long, text string, source string, size int")
    rows = mixing.mix(table, carry=("source",)).collect()
    sizes, taken = {}, {}
    for r in rows:
        sizes[r.source] = sizes.get(r.source, 0) + r.size
        taken[r.source] = taken.get(r.source, 0) + r.taken
        assert 0 <= r.taken <= 2 * r.size
    want = plain_targets(sizes)
    for r in rows:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source])
        assert abs(taken[r.source] - r.target) <= 1
    assert len(rows) == len(docs)
    again = mixing.mix(table.repartition(5))
    assert ordered((r.doc_id, r.size, r.taken) for r in again.collect()) == ordered(
        (r.doc_id, r.size, r.taken) for r in mixing.mix(table).collect()
    )
    assert mixing.mix(table.limit(0)).count() == 0


def test_repeated_rows_of_a_mix(spark):
    table = spark.createDataFrame([(1, "a  b c", 3, 5), (2, "d e", 2, 4), (3, "f", 1, 0)], "doc_id long, text string, size long, taken long")
    assert sorted((r.doc_id, r.text) for r in mixing.repeated(table).collect()) == [(1, "a  b c"), (1, "a b"), (2, "d e"), (2, "d e")]


def test_addresses(spark):
    cases = {
        "http://x.example.org/es/1": ("example.org/es/", "block"), "https://EXAMPLE.org/en/12?q": ("example.org/en/1", "block"),
        "http://notexample.org/es/": ("org/", "allow"), "http://a.com/fr/2#t": ("com/fr/", "allow"), "a://b.com/de/": ("com/de/", "block"),
        "http://b.com/DE/": (None, "allow"), "http://cheap-pills.net": (None, "block"), "http://pillsy.net/": (None, "allow"),
        "http://a.net/pills/": (None, "allow"), "http://x.org": (None, "allow"), None: (None, "allow"), "": (None, "allow"), "no scheme/com/de/": (None, "allow"),
    }
    pages = spark.createDataFrame([(i, u, "z") for i, u in enumerate(cases)] + [(0, next(iter(cases)), "z")], "page_id long, url string, host string")
    rows = urls.judge(pages).collect()
    assert len(rows) == len(cases) + 1
    for r in rows:
        assert (r.rule, r.verdict) == list(cases.values())[r.page_id]
    assert {r.host for r in rows if r.page_id == 1} == {"example.org"}
    assert urls.judge(pages.limit(0)).count() == 0
    with pytest.raises(ValueError):
        urls.judge(pages, [urls.Rule("block", "x", (), 1)])


def test_rules_are_filed_by_their_rarest_token(spark):
    table = spark.createDataFrame([("common.rare/",), ("common.other/",)], "address string")
    rules = [urls.Rule("block", "rare", ("common", "rare"), 1), urls.Rule("block", "x", ("absent", "common"), 2)]
    assert urls.filed(table, rules) == {"rare": [0], "absent": [1]}


def page(i, body):
    return f"<html><head><title>t{i}</title><style>p{{}}</style></head><body><nav><a>m{i}</a></nav>{body}<footer>f</footer></body></html>"


def test_main_text(spark):
    shared = "<div><p>All rights of this page are kept.</p></div>"
    rows = [(i, f"http://h.org/{i}", page(i, f"<p>Own&amp;text <b>no{i}</b>\n goes</p><p>on{i}<br>here"+ shared + "<div class='comments'>c</div>")) for i in range(8)]
    rows += [(20, "http://small.org/", page(20, "<article><h1>H</h1><p>One<p>Two &lt;3<aside>no</aside></article><p>out</p>"))]
    rows += [(30, None, None), (31, "http://h.org/x", ""), (32, "u", "plain <i>text"), (33, "http://h.org/y", "<p unclosed"), (20, "http://small.org/", rows[-1][2])]
    table = spark.createDataFrame([(*r, "t") for r in rows], "page_id long, url string, html string, text string")
    got = {(r.page_id): r for r in extraction.extracted(table).collect()}
    for i in range(8):
        assert got[i].text == f"Own&text no{i} goes on{i} here"
    assert got[20].text == "H One Two <3" and got[20].n_chars == 12
    assert (got[30].text, got[31].text, got[32].text, got[33].text) == ("", "", "plain text", "")
    assert extraction.extracted(table).count() == len(rows)
    assert extraction.extracted(table.limit(0)).count() == 0


@pytest.mark.parametrize("body", [
    "<body class='has-sidebar'><p>Kept</p></body>", "<body class='no-sidebar search'><p>Kept</p></body>",
    "<body><article class='post comments-open'><p>Kept</p></article></body>",
    "<body><div class='with-header content'><p>Kept</p></div></body>",
    "<body><div class='header'><main id='search'><p>Kept</p><div class='post-comments'>c</div></main></div></body>",
    "<body><p>Kept</p><div class='cookie-notice'>n</div><div class='sidebar-left'>s</div><div id='comments'>c</div></body>",
])
def test_marks_do_not_lose_the_main_text(body):
    assert extraction.main_text(f"<html class='no-menu'>{body}</html>", set()) == "Kept"


def test_numbered_marks_leave_the_paths_alike():
    first, second = ([t[1] for t in extraction.tokens(f"<body class='post postid-{i}'><p>x</p></body>")] for i in (1, 2))
    assert first == second


INSULTS = ["zorgwit", "blakfen", "mupdolt"]


def insulting(i):
    words = prose(i, 60).split()
    for k, insult in enumerate(INSULTS):
        words[7 + 11 * k + i % 5] = insult
    return " ".join(words)


def toxic_docs():
    return [(i, prose(i, 60) if i % 3 else insulting(i)) for i in range(240)]


def test_toxicity_on_held_out_rows(spark):
    docs = toxic_docs() + [(900, None), (901, ""), (902, "zorgwit " * 5), (None, prose(5, 9)), (1, prose(1, 60))]
    table = spark.createDataFrame([(d, t, 0.5) for d, t in docs], "doc_id long, text string, score double")
    labels = spark.createDataFrame([(d, int(d % 3 == 0), "x") for d, _ in toxic_docs()] + [(7, None, "x")], "doc_id long, toxic int, text string")
    rows = toxicity.labelled_toxicity(table, labels).collect()
    assert len(rows) == len(docs)
    for r in rows:
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
        assert r.predicted == int(r.score >= 0.7) and 0 <= r.score <= 1
    held = [r for r in rows if r.held_out and r.doc_id < 240]
    assert sum(r.predicted == int(r.doc_id % 3 == 0) for r in held) >= 0.95 * len(held)
    assert not any(r.predicted for r in rows if r.doc_id in (900, 901))
    none = toxicity.labelled_toxicity(table, labels.limit(0))
    assert {r.score for r in none.collect()} == {0.0}


def test_components_of_a_chain(spark):
    chain = list(range(60))
    random.Random(3).shuffle(chain)
    links = spark.createDataFrame([*zip(chain, chain[1:]), (100, 101), (5, 5)], "a long, b long")
    labels = {r.id: r.label for r in components.components(links).collect()}
    assert len({labels[i] for i in range(60)}) == 1 and labels[100] == labels[101] != labels[0]
    assert components.components(links.limit(0)).count() == 0


def test_a_chain_along_the_ids_settles(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(400)], "a long, b long")
    found = components.components(links).collect()
    assert len(found) == 401 and len({r.label for r in found}) == 1


def test_pipeline(spark, tmp_path):
    docs = toxic_docs()
    items = [(i, prose(5000 + i, 20)) for i in range(3)]
    docs += [(300, docs[1][1]), (301, docs[1][1] + " end"), (302, prose(9, 20) + " " + items[1][1]), (303, None), (303, None), (304, ""), (None, prose(77, 30))]
    folder = str(tmp_path)
    full = [(d, t, "en", f"s{(d or 0) % 4}", None if t is None else len(t), 1) for d, t in docs]
    spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long, size int").write.parquet(folder + "/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(folder + "/benchmark.parquet")
    spark.createDataFrame([(d, int(d % 3 == 0)) for d, _ in toxic_docs()], "doc_id long, toxic int").write.parquet(folder + "/labels.parquet")
    stages, at = {}, spark.read.parquet(folder + "/documents.parquet")
    columns = at.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        at = stage(spark, at, folder)
        assert at.columns == columns
        at.write.parquet(f"{folder}/{name}")
        at = spark.read.parquet(f"{folder}/{name}")
        stages[name] = [(r.doc_id, r.text) for r in at.collect()]
    left = {d for d, _ in stages["toxicity"]}
    assert {300, 301, 302, 303, 304, None} <= left and not any(t and INSULTS[0] in t for _, t in stages["toxicity"])
    wanted = {c for _, _, c in plain_components([d for d in stages["toxicity"] if d[0] is not None], 5, 80)}
    assert {d for d, _ in stages["near_duplicates"] if d is not None} == wanted and len(stages["near_duplicates"]) == len(wanted) + 1
    bad = {r[0] for r in plain_contamination(stages["near_duplicates"], items) if r[-1]}
    assert bad == {302} and {d for d, _ in stages["decontamination"]} == {d for d, _ in stages["near_duplicates"]} - bad
    assert {d for d, _ in stages["mixing"]} <= {d for d, _ in stages["decontamination"]}
    total = sum(len((t or "").split()) for _, t in stages["decontamination"])
    assert abs(sum(len(t.split()) for _, t in stages["mixing"]) - 1.5 * total) < 8
    final = corpus_pipeline.run(spark, folder)
    assert ordered((r.doc_id,) for r in final.collect()) == ordered((d,) for d, _ in stages["mixing"])
    assert lower("AÄ") == "aÄ" and final.agg(F.sum("n_tokens")).first()[0] > total


def test_pipeline_judges_texts_of_one_id_apart(spark, tmp_path):
    folder, passage, text = str(tmp_path), prose(6000, 20), prose(1, 60)
    spark.createDataFrame([(1, passage)], "item_id long, text string").write.parquet(folder + "/benchmark.parquet")
    docs = [(1, text), (2, text + " end"), (2, prose(2, 60)), (3, prose(3, 60)), (3, prose(4, 20) + " " + passage)]
    table = spark.createDataFrame(docs, "doc_id long, text string")
    once = corpus_pipeline.one_of_each(spark, table, folder)
    assert sorted(map(tuple, once.collect())) == sorted(d for d in docs if d != docs[1])
    clean = corpus_pipeline.not_in_benchmark(spark, table, folder)
    assert sorted(map(tuple, clean.collect())) == sorted(docs[:4])
