import zlib
from collections import Counter, defaultdict

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from andamio.llm import packing, tokens
from tests.llm.fixtures import ODD, docs


def check(rows, out, length):
    tok = Tokenizer.from_file(tokens.default_path())
    want = Counter()
    for doc_id, text in rows:
        ids = np.array(tok.encode(text or "", add_special_tokens=False).ids + [1], "<u4")
        for at in range(0, len(ids), length):
            want[doc_id, at, len(ids[at : at + length]), zlib.crc32(ids[at : at + length].tobytes()), len(ids)] += 1
    assert Counter((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in out) == want
    by = defaultdict(list)
    for r in out:
        by[r.sequence_id].append((r.offset, r.length, r.padded_to))
    for pieces in by.values():
        at = 0
        for offset, n, _ in sorted(pieces):
            assert offset == at
            at += n
        assert at <= length
        assert {p for *_, p in pieces} == {at if at & (at - 1) == 0 else length}
    return by


def test_odd_rows(spark):
    out = packing.pack(docs(spark, ODD)).collect()
    check(ODD, out, 2048)


def test_hot_length_and_small_sequences(spark, monkeypatch):
    monkeypatch.setattr(packing, "RANKED", 7)
    rows = [(i, "alpha beta") for i in range(60)] + [(100 + i, "gamma " * (i % 9)) for i in range(40)]
    out = packing.pack(docs(spark, rows), length=16).collect()
    by = check(rows, out, 16)
    held = sum(r.length for r in out)
    assert len(by) <= 1.2 * held / 16 + 1


def test_empty_table(spark):
    assert packing.pack(docs(spark, [])).collect() == []


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 32), st.integers(1, 500), max_size=20))
def test_patterns_hold_every_piece_once(counts):
    patterns = packing.shortest_pack_first(counts, 32)
    got = Counter()
    for lengths, n in patterns:
        assert sum(lengths) <= 32 and n > 0
        for x in lengths:
            got[x] += n
    assert got == Counter(counts)


def test_repeated_rows_of_one_id(spark, monkeypatch):
    """A third of all rows are one document, some more share its id: every row has its own pieces, and reruns agree."""
    monkeypatch.setattr(packing, "RANKED", 7)
    rows = [(5, "alpha beta gamma " * 5)] * 40 + [(5, "alpha"), (5, None), (None, "alpha"), (None, "alpha")] + [(i, f"word{i} " * (i % 7)) for i in range(80)]
    out = packing.pack(docs(spark, rows).repartition(6), length=32).collect()
    check(rows, out, 32)
    again = packing.pack(docs(spark, rows).repartition(3), length=32).collect()
    shape = lambda found: Counter((r.doc_id, r.start, r.length, r.offset) for r in found)
    assert shape(out) == shape(again)


def test_pretokens_met_again_are_not_made_again(monkeypatch):
    """As many different pre-tokens as some 10 MB of text have, met twice by a task."""
    made = Counter()
    monkeypatch.setattr(tokens.Splitter, "ids", lambda self, piece: made.update([piece]) or [7, 70_000])
    ids = tokens.ids(tokens.default_path())
    for _ in range(2):
        for at in range(0, 190_000, 1_000):
            assert ids.of(" ".join(f"{n}" for n in range(at, at + 1_000))).tolist() == [7, 70_000] * 1_000
    assert max(made.values()) == 1
