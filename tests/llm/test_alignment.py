"""Token alignment against a plain version that uses the two libraries directly."""

import hashlib
import random
from collections import Counter

import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from armada.llm import alignment
from armada.llm.counting import byte_characters
from texts import ODD, ordered, prose

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
ODDER = [
    " ", "  two  blanks ", "tab\tand\r\nline;\r\n", "already ▁ marked", "<s>a</s><unk> <0x41>", "don't we'll I'M", " wide　blank",
    " " * 3000 + "x", "=" * 700, "naïve café ﬁ ｆｕｌｌ", "👍🏽👨‍👩‍👧 ok", "ab" * 2000, "١٢٣ 12345 ½",
]


def plain_alignment(docs):
    library, pieces, names = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B), byte_characters()
    library.encode_special_tokens = True
    rows, held = [], Counter()
    for doc, text in docs:
        groups, links = [], Counter()
        if text:
            data = (" " + text).encode()
            a = [(i, bytes(names[c] for c in library.id_to_token(i))) for i in library.encode(" " + text, add_special_tokens=False).ids]
            b = [
                (i, bytes([int(pieces.id_to_piece(i)[3:5], 16)]) if pieces.is_byte(i) else pieces.id_to_piece(i).replace("▁", " ").encode())
                for i in pieces.encode(text)
            ]
            if b"".join(x for _, x in a) == data == b"".join(x for _, x in b):
                own_a, own_b, at_a, at_b = [], [], 0, 0
                a, b = a[::-1], b[::-1]
                while a or b:
                    side = (own_a, a) if at_a <= at_b else (own_b, b)
                    number, token = side[1].pop()
                    side[0].append(number)
                    at_a, at_b = (at_a + len(token), at_b) if side[0] is own_a else (at_a, at_b + len(token))
                    if at_a == at_b:
                        groups.append((own_a, own_b))
                        own_a, own_b = [], []
        for x, y in groups:
            for i, n in Counter(x).items():
                for j, m in Counter(y).items():
                    links[i, j] += n * m
        held.update(links.keys())
        rows.append((doc, groups, links))
    most = Counter()
    for (i, _), n in held.items():
        most[i] = max(most[i], n)
    result = []
    for doc, groups, links in rows:
        named = ";".join(f"{','.join(map(str, x))}|{','.join(map(str, y))}" for x, y in groups)
        result.append((
            doc, sum(len(x) for x, _ in groups), sum(len(y) for _, y in groups), len(groups), sum(links.values()),
            sum(n for p, n in links.items() if held[p] == most[p[0]]), sum(n * held[p] for p, n in links.items()),
            hashlib.sha256(named.encode()).hexdigest() if named else "",
        ))
    return result, held, most


def docs():
    chance = random.Random(4)
    found = list(enumerate(ODD + ODDER)) + [(None, None), (None, "null id"), (None, "null id"), (3, "word"), (3, "word")]
    found += [(100 + i, prose(i % 9, 40 * (i % 9) + 1)) for i in range(18)]
    letters = "ab '\n\tsrve1.,é日  '<▁\r;{}"
    return found + [(200 + i, "".join(chance.choice(letters) for _ in range(chance.randint(0, 80)))) for i in range(300)]


def frame(spark, rows, parts=3):
    return spark.createDataFrame([(d, t, "x", 1) for d, t in rows], "doc_id long, text string, n_a string, run int").repartition(parts)


@pytest.mark.parametrize("records, fan, large", [(1_000_000, 256, 4096), (300, 2, 3)])
def test_alignment(spark, monkeypatch, records, fan, large):
    for name, value in (("RUN_RECORDS", records), ("FAN", fan), ("LARGE_GROUP", large), ("BATCH_BYTES", 4 * records)):
        monkeypatch.setattr(alignment, name, value)
    want, held, most = plain_alignment(docs())
    found = alignment.Alignment(frame(spark, docs()), A, B)
    assert ordered(map(tuple, found.documents().collect())) == ordered(want)
    assert {((r.a, r.b), r.documents, r.highest) for r in found.pairs().collect()} == {
        (p, n, n == most[p[0]]) for p, n in held.items()
    }


def test_alignment_of_nothing(spark):
    assert alignment.alignment(frame(spark, docs()).limit(0), A, B).count() == 0
    rows = alignment.alignment(frame(spark, [(1, None), (2, "")]), A, B).collect()
    assert ordered(map(tuple, rows)) == [(1, 0, 0, 0, 0, 0, 0, ""), (2, 0, 0, 0, 0, 0, 0, "")]


def test_alignment_of_a_very_long_text(spark):
    text = prose(3, 200_000)
    row = alignment.alignment(frame(spark, [(1, text), (2, "th")]), A, B).where("doc_id = 1").first()
    assert row.n_groups > 200_000 and row.n_a == len(Tokenizer.from_file(A).encode(" " + text, add_special_tokens=False).ids)
