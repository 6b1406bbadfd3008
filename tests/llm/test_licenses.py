"""License scans against a plain version."""

import random
import re

from armada.llm import licenses
from texts import ODD, lower, ordered, prose

WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain_scan(docs, share=licenses.SHARE):
    every = [(label, True, WORDS.findall(lower(t))) for t, label in licenses.PHRASES.items()]
    every += [(label, False, WORDS.findall(lower(t))) for label, texts in licenses.LICENSES.items() for t in texts]
    rows = []
    for doc, text in docs:
        found, base, labels, best = WORDS.findall(lower(text)), [], set(), 0.0
        for label, exact, own in every:
            if exact:
                places = [i for i in range(len(found)) if found[i : i + len(own)] == own]
                base += [(i, label) for i in places]
                continue
            votes = {}
            for j in range(len(own) - 2):
                for i in range(len(found) - 2):
                    if found[i : i + 3] == own[j : j + 3]:
                        votes[i - j] = votes.get(i - j, 0) + 1
            places = []
            for d in sorted(votes):
                if places and d - places[-1][-1] <= licenses.GAP:
                    places[-1].append(d)
                else:
                    places.append([d])
            for place in places:
                if sum(votes[d] for d in place) < max(1, len(own) - 2 - 3 * int(len(own) * (1 - share) + 1e-9)):
                    continue
                same = sum(any(0 <= d + j < len(found) and found[d + j] == w for d in place) for j, w in enumerate(own))
                best = max(best, same / len(own))
                if same / len(own) >= share:
                    labels.add(label)
        own = {label for _, label in base}
        firsts = [i for i, _ in base]
        rows.append((
            doc, len(found), len(base), min(firsts, default=None), max(firsts, default=None), ",".join(sorted(own)),
            ",".join(sorted(own | labels)), 1.0 if base else best,
        ))
    return rows


def docs():
    chance, found = random.Random(2), list(enumerate(ODD))
    found += [(None, None), (None, "cc by nc"), (None, "cc by nc"), (3, "Under the MIT  license!"), (3, "Under the MIT  license!"), (3, "cc")]
    found += [(30, "CC-BY-NC cc by nc by nc; cc.by.nc"), (31, "cc by"), (32, "x" * 40000 + " cc by nc")]
    found += [(33, "apache license version 2 " * 400), (34, "Licensed under the Apache License, Version 2.0.")]
    found += [(35, "This work is licensed under the GNU General Public License, version 3."), (36, "the GNU General Public License version 3 by")]
    texts = [t for own in licenses.LICENSES.values() for t in own]
    for i in range(120):
        words = chance.choice(texts).split()
        for _ in range(chance.choice([0, 1, 2, 4, 8])):
            at = chance.randrange(len(words))
            words[at : at + chance.choice([0, 1, 1])] = chance.choice([[], ["zz"], ["a", "b"]])
            words = words or ["a"]
        found.append((100 + i, f"{prose(i, 20)} {' '.join(words)} {prose(i + 1, 9)}\n{chance.choice(['', 'released under the mit license', ' '.join(words)])}"))
    return found


def test_license_scan(spark):
    table = spark.createDataFrame([(d, t, "x", 1) for d, t in docs()], "doc_id long, text string, label string, votes int").repartition(3)
    got = licenses.license_scan(table).drop("found").collect()
    assert ordered(map(tuple, got)) == ordered(plain_scan(docs()))
    assert licenses.license_scan(table.limit(0)).count() == 0


def test_other_templates(spark):
    table = spark.createDataFrame([(1, "one two three four six"), (2, "alpha beta gamma delta")], "doc_id long, text string")
    rows = licenses.license_scan(table, {"beta gamma delta": "greek"}, {"numbers": ("one two three four five six",)}, 0.6).collect()
    assert {(r.doc_id, r.labels, r.n_base) for r in rows} == {(1, "numbers", 0), (2, "greek", 1)}
    assert [tuple(p) for r in rows if r.doc_id == 2 for p in r.found] == [("greek", True, 1, 1.0)]


def test_plan_has_no_python(spark):
    table = spark.createDataFrame([(1, "cc by nc")], "doc_id long, text string")
    plan = licenses.license_scan(table)._jdf.queryExecution().toString()
    assert not any(word in plan for word in ("Arrow", "Python", "Pandas"))
