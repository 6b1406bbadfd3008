"""Operators against plain versions on small frames with nulls, ties, repeats and long texts."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from armada.llm import counting, decontaminate, jaccard, quality, repeats, storing
from texts import ODD, ordered, plain_components, plain_contamination, plain_repeats, prose

SCHEMA = "doc_id long, text string, size string, label int"
BYTES, WORDS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")


def frame(spark, docs, parts=3):
    """Documents with extra columns whose names the operators use themselves."""
    return spark.createDataFrame([(d, t, "x", 1) for d, t in docs], SCHEMA).repartition(parts)


def some_docs():
    docs = list(enumerate(ODD)) + [(None, None), (None, "null id"), (3, "word")]
    return docs + [(100 + i, prose(i, 30 * i + 1)) for i in range(12)]


def test_token_counts_equal_the_library(spark):
    library = Tokenizer.from_file(BYTES)
    docs = some_docs()
    got = [tuple(r) for r in counting.token_counts(frame(spark, docs), BYTES, limit=50).collect()]
    want = []
    for doc, text in docs:
        n = len(library.encode(text or "", add_special_tokens=False).ids)
        want.append((doc, len((text or "").encode()), n, n > 50))
    assert ordered(got) == ordered(want)
    assert counting.token_counts(frame(spark, docs).limit(0), BYTES).count() == 0


@pytest.mark.parametrize("chunk", [3, 17, 512])
def test_transducer_on_random_characters(chunk, monkeypatch):
    monkeypatch.setattr(counting, "CHUNK", chunk)
    library, chance = Tokenizer.from_file(BYTES), random.Random(chunk)
    letters = "ab '\n\tsrvemltd1.,é日  '<"
    texts = ["".join(chance.choice(letters) for _ in range(chance.randint(0, 60))) for _ in range(800)] + ["é" * 900, " " * 999 + "x"]
    sizes, tokens = counting.count_texts(counting.machine(BYTES), texts)
    assert tokens.tolist() == [len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]
    assert sizes.tolist() == [len(t.encode()) for t in texts]


def test_transducer_forgets_and_goes_on(monkeypatch):
    monkeypatch.setattr(counting, "MOST_STATES", 5)
    machine = counting.Transducer(BYTES)
    first = counting.count_texts(machine, ["some words here"])[1].tolist()
    assert counting.count_texts(machine, ["some words here"])[1].tolist() == first


def near_docs():
    chance, docs = random.Random(5), []
    for i in range(14):
        words = prose(i, chance.choice([6, 9, 40, 150])).split()
        for _ in range(chance.choice([1, 2, 9])):
            copy = list(words)
            for _ in range(chance.randint(0, max(1, len(words) // 40))):
                copy[chance.randrange(len(copy))] = chance.choice(words)
            docs.append((len(docs), " ".join(copy)))
    return docs + [(900 + i, t) for i, t in enumerate(ODD)] + [(None, docs[0][1]), (None, None), (3, docs[3][1]), (3, docs[3][1]), (950, docs[0][1].upper())]


@pytest.mark.parametrize("n, percent, tile, frequent", [(4, 85, 1000, 8), (5, 80, 2, 2)])
def test_near_duplicates(spark, monkeypatch, n, percent, tile, frequent):
    monkeypatch.setattr(jaccard, "TILE", tile)
    monkeypatch.setattr(jaccard, "FREQUENT", frequent)
    docs = near_docs()
    chain = prose(321, 100).split()  # two texts that only one without an id links
    docs += [(i, " ".join(chain[:k] + ["zz"] * (0 if i else 1) + chain[k + 1 :])) for i, k in ((970, 3), (None, 3))]
    docs += [(971, " ".join(chain[:3] + ["zz"] + chain[4:97] + ["yy"]))]
    got = jaccard.near_duplicates(frame(spark, docs), n, percent).select("doc_id", "n_shingles", "component_id").collect()
    assert ordered(map(tuple, got)) == ordered(plain_components(docs, n, percent))


def plain_links(docs, n, percent):
    sets = []
    for _, text in docs:
        words = (text or "").encode().lower().split()
        k = min(n, len(words))
        sets.append({tuple(words[i : i + k]) for i in range(len(words) - k + 1)} if words else set())
    return [
        (d, sum(bool(a and b) and i != j and 100 * len(a & b) >= percent * len(a | b) for j, b in enumerate(sets)))
        for i, ((d, _), a) in enumerate(zip(docs, sets))
    ]


@pytest.mark.parametrize("tile, columns", [(1000, 4096), (3, 7)])
def test_links_are_all_counted(spark, monkeypatch, tile, columns):
    monkeypatch.setattr(jaccard, "TILE", tile)
    monkeypatch.setattr(jaccard, "COLUMNS", columns)
    base = prose(41, 120).split()
    group = [(2000 + i, " ".join(base[: 8 * i] + [f"w{i}"] + base[8 * i + 1 :])) for i in range(14)]
    docs = near_docs() + group + [(2100 + i, group[3][1]) for i in range(3)]  # copies count with every link
    got = [(r.doc_id, r.n_links) for r in jaccard.near_duplicates(frame(spark, docs), 4, 85).collect()]
    want = plain_links(docs, 4, 85)
    assert ordered(got) == ordered(want) and max(n for _, n in want) >= 16


def test_near_duplicates_of_nothing(spark):
    assert jaccard.near_duplicates(frame(spark, [(1, "a")]).limit(0)).count() == 0
    with pytest.raises(ValueError):
        jaccard.near_duplicates(frame(spark, [(1, "a")]), percent=50)


def test_signature_bound_never_rules_out_a_match():
    chance = np.random.default_rng(1)
    for size in (6, 50, 400, 3000):
        a = np.unique(chance.integers(0, 1 << 63, size, dtype=np.uint64))
        b = np.unique(np.concatenate([a[size // 20 :], chance.integers(0, 1 << 63, size // 20, dtype=np.uint64)]))
        bits = [jaccard.signature(x).view(np.uint64) for x in (a, b)]
        apart = int(np.bitwise_count(bits[0] ^ bits[1]).sum())
        both = len(np.intersect1d(a, b))
        assert (len(a) + len(b) - apart) / 2 >= both


def test_token_files_round_trip(spark, tmp_path):
    library, docs = Tokenizer.from_file(WORDS), some_docs()
    folder = str(tmp_path / "tokens")
    storing.write_tokens(frame(spark, docs), WORDS, folder)
    got = [tuple(r) for r in storing.token_digests(spark, folder).collect()]
    start, want = 0, []
    for doc, text in sorted(docs, key=lambda d: (d[0] is not None, d[0] or 0)):
        ids = library.encode(text or "", add_special_tokens=False).ids + [1]
        want.append((doc, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes())))
    assert sorted((r[0] is not None, r[0] or 0, r[2], r[3]) for r in got) == sorted((r[0] is not None, r[0] or 0, r[1], r[2]) for r in want)
    got.sort(key=lambda r: r[1])
    assert [r[0] for r in got] == sorted((r[0] for r in got), key=lambda d: (d is not None, d or 0))
    for row in got:
        assert row[1] == start
        start += row[2]


def test_signs_after_any_letter_are_cut_as_the_library_does():
    library, made = Tokenizer.from_file(WORDS), storing.Encoder(WORDS)
    letters = [chr(c) for c in range(ord(storing.LATIN_END)) if chr(c).isalpha()]
    texts = [f"{stem}{c}{sign} GAZETESİ." for c in letters for stem in ("", "GAZETES", "a") for sign in (",", ".")]
    for text, ids in zip(texts, made(texts)):
        assert np.frombuffer(ids, dtype="<u4").tolist() == library.encode(text, add_special_tokens=False).ids, text


def test_words_cut_in_lower_case_are_as_the_library_has_them():
    library, made = Tokenizer.from_file(WORDS), storing.Encoder(WORDS)
    chance = random.Random(3)
    signs = [chr(c) for c in range(0x20, 0x250)] + list("\u0301\u0331\u0345\u1e9e\u03a3\u03c2\u200d\u212b '.,<>|%#\n") + ["'LL", "<|startoftext|>", "<|EndOfText|>"]
    texts = ["".join(chance.choice(signs) for _ in range(chance.randint(0, 30))) for _ in range(4000)]
    texts += [f"{a}{chr(c)}{b}" for c in range(0x21, 0x800) for a, b in (("", ""), ("A", "."), ("h", "B%%%"))]
    for text, ids in zip(texts, made(texts), strict=True):
        assert np.frombuffer(ids, dtype="<u4").tolist() == library.encode(text, add_special_tokens=False).ids, text


def test_words_of_the_batch_outlast_the_bound(monkeypatch):
    monkeypatch.setattr(storing, "MOST_WORDS", 3)
    made, learned = storing.Encoder(WORDS), []
    learn = made.learn
    monkeypatch.setattr(made, "learn", lambda words: (learned.append(set(words)), learn(words)))
    for text in ("one two three four", "one five", "one six"):
        list(made([text]))
    assert learned == [{"one", "two", "three", "four"}, {"five"}, {"six"}]


def test_token_files_of_nothing(spark, tmp_path):
    storing.write_tokens(frame(spark, [(1, "a")]).limit(0), WORDS, str(tmp_path / "none"))
    assert storing.token_digests(spark, str(tmp_path / "none")).count() == 0


@pytest.mark.parametrize("most", [1, 200, 70_000, 1 << 31])
def test_codes_give_any_token(most):
    ids = np.random.default_rng(most).integers(0, most, 3000).astype(np.uint32)
    segment = storing.Segment(storing.encode(ids))
    assert segment.slice(0, len(ids)).tolist() == ids.tolist()
    assert [segment[i] for i in range(0, 3000, 7)] == ids[::7].tolist()
    assert segment.slice(517, 1999).tolist() == ids[517:1999].tolist()
    assert storing.Segment(storing.encode(ids[:0])).slice(0, 0).tolist() == []
    with pytest.raises(IndexError):
        segment[3000]


@pytest.mark.parametrize("most, size", [(400, 1_000_000), (3, 500)])
def test_repeated_bytes(spark, monkeypatch, most, size):
    monkeypatch.setattr(repeats, "MOST_CONTEXTS", most)
    monkeypatch.setattr(repeats, "BUCKET_BYTES", size)
    chance, passage = random.Random(2), prose(77, 60)
    docs = [(i, prose(i, 80)) for i in range(8)]
    for i in range(20):
        text = list(docs[i % 8][1])
        for _ in range(chance.randint(0, 3)):
            text[chance.randrange(len(text))] = "#"
        docs.append((50 + i, "".join(text)))
        docs.append((90 + i, prose(900 + i, 9) + passage + prose(700 + i, 5)))
    docs += [(200 + i, t) for i, t in enumerate(ODD)] + [(None, passage), (None, None), (300, "ab" * 300), (301, passage[:99]), (302, passage[:100] * 2)]
    docs += [(303, passage), (303, passage)]
    got = [tuple(r)[:5] for r in repeats.repeated_spans(frame(spark, docs)).collect()]
    assert ordered(got) == ordered(plain_repeats(docs))
    assert repeats.repeated_spans(frame(spark, docs).limit(0)).count() == 0


def test_same_strings_on_tiny_alphabet():
    chance = random.Random(4)
    texts = [bytes(chance.choice(b"ab") for _ in range(60)) for _ in range(9)]
    owner, inside, classes = repeats.same_strings(texts, 7)
    named = {}
    for o, i, c in zip(owner, inside, classes):
        named.setdefault(c, set()).add(texts[o][i : i + 7])
    assert all(len(strings) == 1 for strings in named.values())
    assert len(named) == len({t[i : i + 7] for t in texts for i in range(54)})


def test_contamination(spark):
    items = [(i, prose(500 + i, 25)) for i in range(6)] + [(20, "the of"), (21, ""), (22, None), (23, "!!"), (24, "word"), (6, prose(501, 25))]
    docs = some_docs() + [(400 + i, f"{prose(i, 12)} {items[i][1]} {prose(i, 5)}") for i in range(6)]
    docs += [(500, " ".join(items[0][1].split()[:9])), (501, "The, OF word"), (501, "The, OF word"), (502, items[2][1].upper())]
    table = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, n_words int")
    got = [tuple(r) for r in decontaminate.contamination(frame(spark, docs), table).collect()]
    assert ordered(got) == ordered(plain_contamination(docs, items))
    assert decontaminate.contamination(frame(spark, docs).limit(0), table).count() == 0
    assert decontaminate.contamination(frame(spark, docs), table.limit(0)).where("contaminated").count() == 0


def test_contamination_plan_is_native(spark):
    items = spark.createDataFrame([(1, prose(1, 30))], "item_id long, text string")
    plan = decontaminate.contamination(frame(spark, some_docs()), items)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "CartesianProduct" not in plan and "NestedLoop" not in plan


def plain_rules(text):
    words = [w for w in (text or "").replace("\t", " ").replace("\n", " ").split(" ") if w]
    seen, repeated = {}, set()
    for i in range(len(words) - 7):
        seen.setdefault(tuple(words[i : i + 8]), []).append(i)
    for places in seen.values():
        if len(places) > 1:
            repeated.update(j for i in places for j in range(i, i + 8))
    lines = [x for x in (text or "").split("\n") if x.strip(" \t")]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(repeated)


def test_quality_rules_and_verdict(spark):
    good = [(i, prose(i, 60)) for i in range(40)]
    junk = [(100 + i, " ".join(w + "###" for w in prose(50 + i, 60).split())) for i in range(40)]
    docs = good + junk + [(300, None), (301, ""), (302, "one two"), (303, (prose(1, 8) + "\n") * 12), (304, "a\na\n \n \nb|c")]
    labels = spark.createDataFrame([(d, int(d < 100), 9) for d, _ in good + junk] + [(5, None, 1), (None, 1, 1)], "doc_id long, quality int, text int")
    table = frame(spark, docs)
    rows = {r.doc_id: r for r in quality.quality(table, quality.quality_model(table, labels)).collect()}
    for doc, text in docs:
        r = rows[doc]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == plain_rules(text), doc
        assert r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words)
    assert all(rows[d].kept for d, _ in good) and not any(rows[d].kept for d in [d for d, _ in junk] + [300, 301, 302, 303])
    untaught = quality.quality(table, quality.quality_model(table, labels.limit(0)))
    assert all(r.kept == (not r.base_failed) for r in untaught.collect())


def test_overlaps_hold_no_array_of_all_sets_by_many_shingles():
    import tracemalloc

    chance = np.random.default_rng(5)
    sets = [np.unique(chance.integers(0, 9000, 300).astype(np.uint64)) for _ in range(900)]
    first, second = np.arange(0, 900, 3), np.arange(1, 900, 3)
    tracemalloc.start()
    got = jaccard.overlaps(sets, first, second)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    for i, j in ((0, 0), (7, 290), (299, 13)):
        assert got[i, j] == len(np.intersect1d(sets[first[i]], sets[second[j]]))
    assert most < 16_000_000
