"""Near-dedup of texts against all pairs of whole shingle sets."""

from __future__ import annotations

import random

import numpy as np

from quarryline.llm import simhash

from .test_pipeline import near_groups


def kept(spark, texts: dict) -> set:
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in texts.items()], "doc_id long, text string").repartition(4)
    return {r.doc_id for r in simhash.drop_near_duplicates(docs).collect()}


def firsts(texts: dict) -> set:
    return {i for i, r in near_groups({i: " ".join(w) for i, w in texts.items()}, 0.8).items() if i == r}


def test_a_failed_first_partner_hides_no_other(spark):
    """The earliest text has the same words as a later one in another order; a third is an edit of that one."""
    rng = random.Random(1)
    texts = {}
    for k in range(0, 60, 3):
        words = [f"a{k}x{i}" for i in range(120)]
        texts[k] = rng.sample(words, len(words))
        texts[k + 1] = words
        texts[k + 2] = [*words[:60], "edit", *words[61:]]
    assert kept(spark, texts) == firsts(texts) == {i for i in texts if i % 3 < 2}


def test_large_groups_are_cut_into_blocks(spark, monkeypatch):
    """A crowd of edits, some further than 0.8 from the others, in many small blocks."""
    monkeypatch.setattr(simhash, "BLOCK", 8)
    monkeypatch.setattr(simhash, "UNIT", 16)
    rng = random.Random(4)
    words = [f"e{i}" for i in range(150)]
    texts = {}
    for k in range(160):
        own = list(words)
        for _ in range(rng.randint(1, 6)):
            own[rng.randrange(150)] = f"f{k}"
        texts[k] = own
    assert kept(spark, texts) == firsts(texts)


def test_appended_and_cut_copies_go(spark):
    rng = random.Random(3)
    vocabulary = [f"v{i}" for i in range(4000)]
    weights = [1 / (i + 1) for i in range(4000)]
    texts = {}
    for k in range(60):
        words = rng.choices(vocabulary, weights, k=rng.randint(60, 500))
        texts[10 * k] = words
        for i, share in enumerate((0.1, 0.15, 0.2), 1):
            texts[10 * k + i] = words + rng.choices(vocabulary, weights, k=int(share * len(words)))
        texts[10 * k + 4] = words[: int(0.9 * len(words))]
    want = firsts(texts)
    assert kept(spark, texts) == want and len(want) < 100


def test_bridges_between_groups_are_found(spark):
    """a~b, c~d and b~d are alike, a and c are not: one group, whatever the order of ids."""
    texts = {}
    for k in range(40):
        words = [f"b{k}x{i}" for i in range(260)]
        for i, at in enumerate((0, 45, 15, 30)):
            texts[4 * k + i] = words[at : at + 200]
    assert kept(spark, texts) == firsts(texts) == {4 * k for k in range(40)}


def test_the_threshold_is_exact(spark):
    """Pairs of long texts between 0.74 and 0.86, by swapped tails."""
    rng = random.Random(2)
    texts = {}
    for k in range(120):
        words = [f"c{k}x{i}" for i in range(604)]
        n = rng.randint(48, 88)
        texts[2 * k] = words
        texts[2 * k + 1] = [*words[:-n], *(f"d{k}x{i}" for i in range(n))]
    assert kept(spark, texts) == firsts(texts)


def test_repeated_ids_of_unequal_texts(spark):
    """Rows of one id with different texts are told apart; a duplicate one does not take the other along."""
    words = [[f"g{k}x{i}" for i in range(80)] for k in range(3)]
    rows = [(1, words[0]), (5, words[0]), (5, words[1]), (5, words[1]), (5, words[2]), (9, [*words[2][:-1], "edit"])] * 2
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in rows], "doc_id long, text string").repartition(3)
    out = sorted((r.doc_id, r.text.split()[0]) for r in simhash.drop_near_duplicates(docs).collect())
    assert out == [(1, "g0x0"), (5, "g1x0"), (5, "g2x0")]


def test_a_crowd_of_near_copies_loses_no_link(spark):
    """3,000 copies of one text of 200 words, each with 1 to 4 edited words, against all pairs."""
    rng = random.Random(8)
    words = [f"h{i}" for i in range(200)]
    texts = {}
    for k in range(3000):
        own = list(words)
        for at in rng.sample(range(200), rng.randint(1, 4)):
            own[at] = f"i{k}x{at}"
        texts[k] = own
    grams = [{tuple(w[i : i + 5]) for i in range(196)} for w in texts.values()]
    number = {g: i for i, g in enumerate(sorted(set().union(*grams)))}
    common = sorted({g for g in set().union(*grams) if sum(g in x for x in grams[:50]) > 5})
    has = np.zeros((3000, len(common)), np.float32)
    for i, g in enumerate(common):
        for k, x in enumerate(grams):
            has[k, i] = g in x
    shared = has @ has.T  # edits are unlike one another, so all that two texts share is common
    assert len(number) > len(common) == 196
    alike = shared * 9 >= 4 * (196 + 196)
    root = list(range(3000))
    for k in range(3000):
        seen, todo = {root[k]}, [k]
        if root[k] != k:
            continue
        while todo:
            for j in np.flatnonzero(alike[todo.pop()]).tolist():
                if root[j] != k and j not in seen:
                    root[j] = k
                    seen.add(j)
                    todo.append(j)
    assert kept(spark, texts) == {i for i in range(3000) if root[i] == i}
