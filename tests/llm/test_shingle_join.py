import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from andamio.llm import shingle_join as sj
from tests.llm.fixtures import LONG, ODD, docs


def shingle_set(text):
    w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for b in "\t\n\r\x0b\x0c":
        w = w.replace(b, " ")
    w = [x for x in w.split(" ") if x]
    return frozenset(tuple(w[i : i + 4]) for i in range(max(1, len(w) - 3))) if w else frozenset()


def expected(rows):
    sets = [shingle_set(t) for _, t in rows]
    up = list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            o = len(sets[i] & sets[j])
            if o and 100 * o >= 85 * (len(sets[i]) + len(sets[j]) - o):
                up[root(i)] = root(j)
    low = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            low[root(i)] = min(d, low.get(root(i), d))
    return Counter((d, len(s), low.get(root(i)) if s else d) for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True)))


def family(rng, base, copies, edits, first):
    out = []
    for k in range(copies):
        w = list(base)
        for _ in range(rng.randint(0, edits)):
            w[rng.randrange(len(w))] = f"e{rng.randrange(10**6)}"
        out.append((first + k, " ".join(w)))
    return out


def corpus(seed):
    rng = random.Random(seed)
    word = lambda: f"w{int(rng.paretovariate(0.6)) % 400}"
    rows = family(rng, [word() for _ in range(60)], 40, 4, 0)
    rows += family(rng, [word() for _ in range(20)], 15, 1, 100)
    rows += family(rng, [word() for _ in range(300)], 10, 12, 200)
    passage = " ".join(word() for _ in range(30))
    rows += [(300 + i, passage + " " + " ".join(word() for _ in range(40))) for i in range(20)]
    rows += [(400 + i, " ".join(word() for _ in range(rng.randint(1, 30)))) for i in range(40)]
    rows += [(500 + i, "same text here again and again") for i in range(12)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize(("seed", "together"), [(1, 1024), (2, 8)])
def test_equals_brute_force(spark, monkeypatch, seed, together):
    monkeypatch.setattr(sj, "HOT_TOKEN", 100_000 if seed == 1 else 12)
    monkeypatch.setattr(sj, "TOGETHER", together)
    monkeypatch.setattr(sj, "BLOCK", together // 2)
    monkeypatch.setattr(sj, "CUT_FROM", together)
    rows = corpus(seed)
    got = Counter(tuple(r) for r in sj.near_duplicates(docs(spark, rows)).collect())
    assert got == expected(rows)


def test_odd_rows(spark):
    rows = [*ODD, (10, "one"), (11, "ONE"), (12, LONG + " more"), (None, "no id"), (13, "a b"), (14, "b a")]
    got = Counter(tuple(r) for r in sj.near_duplicates(docs(spark, rows)).collect())
    assert got == expected(rows)


def test_empty_table(spark):
    assert sj.near_duplicates(docs(spark, [])).collect() == []
    assert sj.near_duplicates(docs(spark, [(1, None)])).collect() == [(1, 0, 1)]


def test_linked_sets_share_a_token_in_every_order_and_pass_the_parities():
    rng = np.random.default_rng(4)
    slots = 1 << 16
    rarity = rng.integers(0, 50, slots).astype(np.uint32)
    tried = 0
    for _ in range(400):
        n = int(rng.integers(1, 200))
        a = np.unique(rng.integers(0, 2**63, n, dtype=np.uint64))
        k = int(rng.integers(0, n // 6 + 1))
        b = np.unique(np.concatenate([a[k:], rng.integers(0, 2**63, int(rng.integers(0, n // 6 + 1)), dtype=np.uint64)]))
        o = len(np.intersect1d(a, b))
        if not len(b) or 100 * o < 85 * (len(a) + len(b) - o):
            continue
        tried += 1
        for turn in range(3):
            x, y = (sj.prefix(s, rarity[sj.slot_of(s, slots)], turn) for s in (a, b))
            assert len(np.intersect1d(x, y))
        assert sj.links(a, b)
        others = [[sj.short_tokens(sj.prefix(s, rarity[sj.slot_of(s, slots)], t)) for s in (a, b)] for t in (1, 2)]
        pair = sj.candidates(np.array([1, 2]), np.array([1, 2]), np.array([len(a), len(b)]), [sj.bits_of(s) for s in (a, b)], others, False)
        assert pair == [(1, 2)]
    assert tried > 100


def test_each_order_removes_candidates():
    rng = np.random.default_rng(8)
    alone, both = [0, 0], 0
    for _ in range(300):
        passage = rng.integers(0, 2**63, 8, dtype=np.uint64)
        a, b = (np.unique(np.concatenate([passage, rng.integers(0, 2**63, 92, dtype=np.uint64)])) for _ in "ab")
        rare = np.ones(len(a))
        if not len(np.intersect1d(sj.prefix(a, rare, 0), sj.prefix(b, rare, 0))):
            continue
        shares = [sj.sharing([sj.short_tokens(sj.prefix(s, rare, t)) for s in (a, b)])[0, 1] for t in (1, 2)]
        alone = [x + (not s) for x, s in zip(alone, shares, strict=True)]
        both += not all(shares)
    assert min(alone) > 10 and both > max(alone)


def test_who_shares_a_token():
    rng = np.random.default_rng(2)
    sets = [np.unique(rng.integers(0, 60, rng.integers(1, 9)).astype(np.uint32)) for _ in range(40)]
    got = sj.sharing(sets)
    assert all(got[i, j] == bool(len(np.intersect1d(sets[i], sets[j]))) for i in range(40) for j in range(40) if i != j)


def test_clashing_columns_survive(spark):
    frame = docs(spark, [(1, "one two three four five six"), (2, "One two three four five six"), (3, None)])
    for name in ("_key", "_stays", "_row_key", "row", "id", "key", "stays", "stays_key"):
        frame = frame.withColumn(name, F.lit(name))
    out = sj.keep_one_of_each(frame)
    assert out.columns == frame.columns
    assert sorted(tuple(r) for r in out.collect()) == sorted(tuple(r) for r in frame.collect() if r.doc_id != 2)


def test_components_of_a_long_path_and_a_star(spark):
    links = [(i, i + 1) for i in range(50)] + [(1000, 1000 + i) for i in range(1, 40)] + [(7, 7)]
    got = {r.node: r.comp for r in sj.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(1, 51)}, **{1000 + i: 1000 for i in range(1, 40)}}
