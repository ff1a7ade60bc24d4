from collections import Counter

import pytest
from tokenizers import Tokenizer

from andamio.llm import token_count, tokens
from tests.llm.fixtures import ODD, docs


def expected(rows):
    tok = Tokenizer.from_file(tokens.default_path())
    found = Counter()
    for doc_id, text in rows:
        n = len(tok.encode(text or "", add_special_tokens=False).ids)
        found[doc_id, len((text or "").encode()), n, n > 1024] += 1
    return found


def test_equals_the_library_on_odd_rows(spark):
    for held in (200_000, 5, 1):
        got = Counter(tuple(r) for r in token_count.token_counts(docs(spark, ODD), common_pieces=held).collect())
        assert got == expected(ODD)


def test_empty_table(spark):
    assert token_count.token_counts(docs(spark, [])).collect() == []


def test_splitter_agrees_with_the_library_on_mixed_characters():
    import random

    rng = random.Random(5)
    letters = "ab '\n\t_1²½é \x85\x1c–“ªßŉ́😀日"
    tok, cut, ids = Tokenizer.from_file(tokens.default_path()), tokens.splitter(tokens.default_path()), tokens.ids(tokens.default_path())
    for _ in range(2000):
        text = "".join(rng.choice(letters) for _ in range(rng.randint(0, 30))) + rng.choice(["", "<|endoftext|>", "I'll  go"])
        want = tok.encode(text, add_special_tokens=False).ids
        assert ids.of(text).tolist() == want
        parts, special = cut.parts(text)
        assert sum(cut.lengths(parts)) + special == len(want)


def test_other_kinds_of_tokenizers_are_refused(tmp_path):
    from tokenizers import Tokenizer, models, normalizers, pre_tokenizers

    for n, (normalizer, before) in enumerate([(normalizers.Lowercase(), pre_tokenizers.ByteLevel(add_prefix_space=False)), (None, pre_tokenizers.ByteLevel(add_prefix_space=True)), (None, pre_tokenizers.Whitespace())]):
        made = Tokenizer(models.BPE())
        made.pre_tokenizer = before
        if normalizer is not None:
            made.normalizer = normalizer
        made.save(f"{tmp_path}/{n}.json")
        with pytest.raises(ValueError, match="byte-level"):
            tokens.Splitter(f"{tmp_path}/{n}.json")
