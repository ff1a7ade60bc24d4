import math
import zlib
from collections import Counter

import numpy as np
import pytest

from andamio.llm import class_lm
from tests.llm.fixtures import ODD, docs

BLANKS = " \t\n\r\x0b\x0c"


def words(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for b in BLANKS[1:]:
        lowered = lowered.replace(b, " ")
    return [w for w in lowered.split(" ") if w]


def base(rows):
    train = [words(t) for i, t in rows if i is None or zlib.crc32(str(i).encode()) % 7 != 2]
    c = Counter(w for t in train for w in [*t, None])
    n, v = sum(c.values()), len(c)
    out = []
    for i, t in rows:
        toks = [*words(t), None]
        out.append((i, len(toks), sum(x in c for x in toks), n, sum(math.log10((c[x] + 1) / (n + v + 1)) for x in toks)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("common_words", [100_000, 3])
def test_counts_and_base_score(spark, common_words):
    got = class_lm.score(docs(spark, ODD), common_words, 1).collect()
    rows = sorted(((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in got), key=repr)
    for a, b in zip(rows, base(ODD), strict=True):
        assert a[:4] == b[:4] and math.isclose(a[4], b[4], rel_tol=1e-9)
    assert all(r.score < 0 and r.perplexity > 1 for r in got)
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 7 == 2) for r in got)


LANGS = [["el", "la", "de", "que", "y"], ["the", "of", "and", "to", "in"], ["der", "die", "und", "das", "ein"]]


def corpus(n):
    rng = np.random.default_rng(3)
    rows = []
    for i in range(n):
        stock = [f"{w}{k}" for w in LANGS[i % 3] for k in range(30)]
        rows.append((i, " ".join(rng.choice(stock, 80)) + (f" odd{i}" if i % 4 == 0 else "")))
    return rows


def test_learns_more_than_the_base_on_held_out_texts(spark):
    out = class_lm.score(docs(spark, corpus(200)), 300, 3).filter("held_out").collect()
    assert len(out) > 10
    assert sum(r.score for r in out) > sum(r.base_score for r in out) + 0.2 * sum(r.n_tokens for r in out)


def test_the_model_is_a_distribution_and_equals_brute_force(spark):
    frame = docs(spark, corpus(60))
    model, counts = class_lm.train(frame, 200, 2)
    assert np.allclose((10**model.transition).sum(1), 1)
    rows = {bytes(r.word): r.n for r in counts.collect()}
    mass = Counter()
    for w, n in rows.items():
        unit = model.known.index[w] if w in model.known.index else class_lm.ending_group(w)
        k = model.classes[unit]
        mass[k] += (n + 1) / 10 ** model.room[k]
    assert all(m < 1 for m in mass.values()) and all(abs(m + 1 / 10 ** model.room[k] - 1) < 1e-9 for k, m in mass.items())
    text = "the1 of2 newword el3"
    before, want = class_lm.CLASSES, 0.0
    for w in [*text.encode().split(), None]:
        if w is None:
            want += model.transition[before, class_lm.CLASSES]
            break
        unit = model.known.index[w] if w in model.known.index else class_lm.ending_group(w)
        k = model.classes[unit]
        want += model.transition[before, k] + math.log10(rows.get(w, 0) + 1) - model.room[k]
        before = k
    held = next(i for i in range(1000, 2000) if zlib.crc32(str(i).encode()) % 7 == 2)
    extra = frame.union(docs(spark, [(held, text)]))
    got = class_lm.score(extra, 200, 2).filter(f"doc_id = {held}").first()
    assert math.isclose(got.score, want, rel_tol=1e-9)


def brute_likelihood(classes, tokens):
    pairs, ones = Counter(), Counter()
    for last, unit in zip([class_lm.END, *tokens], tokens, strict=False):
        pairs[classes[last], classes[unit]] += 1
    for (a, b), n in pairs.items():
        ones["before", a] += n
        ones["after", b] += n
    f = lambda n: n * math.log(n)
    return sum(map(f, pairs.values())) - sum(map(f, ones.values()))


def text_of_units(seed, n=400, units=30):
    rng = np.random.default_rng(seed)
    out, kind = [], 0
    for _ in range(n):
        kind = (kind + 1) % 3 if rng.random() < 0.9 else int(rng.integers(3))
        out.append(int(rng.integers(units // 3)) * 3 + kind)
        if rng.random() < 0.05:
            out.append(class_lm.END)
    return [*out, class_lm.END]


def test_gains_equal_brute_force():
    rng = np.random.default_rng(1)
    tokens = [t for t in text_of_units(5)]
    classes = np.zeros(class_lm.END + 1, int)
    classes[:30], classes[class_lm.END] = rng.integers(0, 5, 30), class_lm.CLASSES
    u = next(t for t in range(30) if not any(a == b == t for a, b in zip(tokens, tokens[1:], strict=False)) and t in tokens)
    follows, ins, outs = np.zeros((class_lm.WIDTH,) * 2), np.zeros(class_lm.WIDTH), np.zeros(class_lm.WIDTH)
    for last, unit in zip([class_lm.END, *tokens], tokens, strict=False):
        if unit == u:
            ins[classes[last]] += 1
        elif last == u:
            outs[classes[unit]] += 1
        else:
            follows[classes[last], classes[unit]] += 1
    sums = np.bincount([classes[t] for t in tokens if t != u], minlength=class_lm.WIDTH).astype(float)
    got = class_lm.gains(follows, sums, ins.sum(), ins, outs)
    want = []
    for c in range(5):
        classes[u] = c
        want.append(brute_likelihood(classes, tokens))
    assert np.allclose(got[:5] - got[0], np.array(want) - want[0])


@pytest.mark.parametrize("seed", [1, 2])
def test_exchange_against_brute_force(spark, monkeypatch, seed):
    monkeypatch.setattr(class_lm, "OWN_UNITS", 24)  # six words are left to best_classes
    monkeypatch.setattr(class_lm, "CLASSES", 4)
    monkeypatch.setattr(class_lm, "WIDTH", 5)
    tokens = text_of_units(seed, 3000)
    frame = spark.createDataFrame([(np.array(tokens, "<u4").tobytes(),)], "seq binary")
    totals = np.bincount(tokens, minlength=class_lm.END + 1)
    classes, follows, history = class_lm.clustered(frame, totals, 3)
    assert all(b >= a - 1e-6 for a, b in zip(history, history[1:], strict=False)) and history[-1] > history[0]
    assert math.isclose(history[-1], brute_likelihood(classes, tokens), rel_tol=1e-9) and follows.sum() == len(tokens)
    # Brute force: every unit in turn to its best class, by the whole likelihood.
    brute = class_lm.first_classes(totals)
    start = brute_likelihood(brute, tokens)
    for u in [u for u in np.argsort(-totals[:30], kind="stable")]:
        tried = []
        for c in range(class_lm.CLASSES):
            brute[u] = c
            tried.append(brute_likelihood(brute, tokens))
        brute[u] = int(np.argmax(tried))
    assert history[-1] - history[0] >= 0.8 * (brute_likelihood(brute, tokens) - start)


def test_empty_table_and_nothing_to_learn_from(spark):
    assert class_lm.score(docs(spark, [])).collect() == []
    held = next(i for i in range(1000) if zlib.crc32(str(i).encode()) % 7 == 2)
    (r,) = class_lm.score(docs(spark, [(held, "a b")])).collect()
    assert (r.n_tokens, r.n_known, r.train_tokens, r.base_score) == (3, 0, 0, 0.0)
