"""Near-duplicates: what is compared, and what is left on disk."""

import time

import numpy as np

from armada.llm import common, jaccard
from texts import ordered, plain_components, prose


def test_texts_that_share_a_passage_alone_do_not_travel_by_pairs(spark, monkeypatch):
    docs = []
    for group in range(6):
        passage = [f"p{group}w{i}" for i in range(60)]
        for _ in range(7):
            words = prose(len(docs), (950 if group % 2 else 1500) + 15 * (len(docs) % 7)).split()
            docs.append((len(docs), " ".join(words[:300] + passage + words[300:])))
    long = prose(777, 4600).split()
    docs += [(500, " ".join(long)), (501, " ".join(long[:-300])), (502, " ".join(docs[1][1].split()[40:])), (503, None)]
    pairs, verified = [], jaccard.verified

    def counted(found, *rest):
        pairs.append(found.count())
        return verified(found, *rest)

    monkeypatch.setattr(jaccard, "verified", counted)
    got = jaccard.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), 4, 85)
    got = [tuple(r) for r in got.select("doc_id", "n_shingles", "component_id").collect()]
    assert ordered(got) == ordered(plain_components(docs, 4, 85)) and {r[2] for r in got if r[0] in (1, 501, 502)} == {1, 500}
    assert pairs[0] >= 30 and pairs[1] <= 3


def test_signatures_of_other_widths_bound_the_overlap():
    chance = np.random.default_rng(2)
    base = np.unique(chance.integers(0, 1 << 63, 9000, dtype=np.uint64))
    sets = [chance.permutation(base[: size + size // 20])[:size] for size in (5, 200, 511, 512, 600, 1023, 1030, 1500, 2049, 4095, 4097, 8192)]
    signs = [jaccard.signature(x).view(np.uint64) for x in sets]
    assert [64 * len(x) for x in signs] == [256, 256, 256, 512, 512, 512, 1024, 1024, 2048, 2048, 4096, 8192]
    for most in (jaccard.WORDS_IN_TILE, 4):
        bits = [jaccard.folded(x, most) for x in signs]
        apart = jaccard.cells_apart(bits)
        for i in range(len(sets) - 1):
            found = apart(i, len(sets))
            assert len(found) == len(sets) - i - 1 and apart(i, i + 2).tolist() == found[:1].tolist()
            for j, cells in enumerate(found, i + 1):
                different = np.setxor1d(sets[i], sets[j])
                width = len(bits[i])
                parity = np.bincount((different >> np.uint64(20)).astype(np.int64) % (64 * width), minlength=64 * width) & 1
                assert cells == parity.sum() <= len(different)


def test_shuffle_files_go_with_each_staged_table(spark):
    manager = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def files():
        return {x for x in manager.getAllBlocks().mkString(" ").split() if x.startswith("shuffle_")}

    before, staged, setting = files(), common.Scratch(spark), spark.conf.get(common.CLEANUP, None)
    rows = spark.range(1000).repartition(5, "id")
    for write in (staged, staged.result):
        table = write(rows, "rows")
        for _ in range(50):
            if not files() - before:
                break
            time.sleep(0.2)
        assert not files() - before and table.count() == 1000
        before |= files()
    assert spark.conf.get(common.CLEANUP, None) == setting
