"""Ids of plain texts from the table of pre-tokens are those of the library; rules are expanded once."""

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from pacegrid.llm import grammar, memo, pretokens

PATH = public_tokenizers.path("byte_bpe_50k.json")
ODD = [
    None, "", " ", "\n", "a", " a", "a ", "a\n", "\na", "a  b", "a \nb", "a\n\nb", "a\r\nb", "a\tb", "a\0b", "\0", "it's 'tis", "<|endoftext|>",
    "a<|endoftext|>b", "x" * 255, "x" * 256 + " y", "x" * 257, "é×÷ÿ Œœ", "élan ñandú Ÿ", "ßÀÖØöĀĊ Ġ", "12,5 a1b2 (x)--y", " ...a", "a ###\nb", "日本 a", "² ª a", "a\xa0b", "a\u2028b",
]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def of(library, texts):
    return [np.asarray(library.encode(t or "", add_special_tokens=False).ids, "<u4").tobytes() for t in texts]


def some(n):
    rng = np.random.default_rng(n)
    parts = ["the", "un", "keit", "ción", "ñ", "œuvre", "ing", "###", ",", "!?", "7", "20", "(", "é"]
    words = ["".join(rng.choice(parts, rng.integers(1, 5))) for _ in range(400)]
    return ["".join(w + ("\n" if rng.random() < 0.1 else " ") for w in rng.choice(words, rng.integers(1, 60))).rstrip() for _ in range(n)]


def test_plain_texts_ask_the_library_for_no_single_piece(library):
    class Never:
        def one(self, text):
            raise AssertionError(text)

    assert pretokens.fits(library)
    texts = some(300)
    assert list(pretokens.Pretokens(Never(), library)(texts)) == of(library, texts)


def test_ids_are_the_libraries(library):
    mixed = [t for pair in zip(some(len(ODD)), ODD) for t in pair]
    every = memo.ids_of(PATH, "spaced")
    assert isinstance(every, pretokens.Pretokens)
    assert list(every(mixed)) == of(library, mixed)
    assert [next(every([t])) for t in ODD] == of(library, ODD)


def test_a_full_table_forgets(library, monkeypatch):
    monkeypatch.setattr(pretokens, "TOGETHER", 200)
    texts = some(200)
    small = pretokens.Pretokens(memo.Memo(memo._spaced, None, None), library, most=50, slots=12)
    assert list(small(texts)) == of(library, texts)
    assert small.key.n < 200


def test_equal_hashes_are_noticed(library, monkeypatch):
    monkeypatch.setattr(pretokens, "_OF_PLACE", np.ones(pretokens.LONGEST, np.uint64))
    texts = ["ab ba tac", "cat act ba"]
    table = memo._ids_of(PATH, "spaced")
    met = []
    monkeypatch.setattr(table, "_ids", lambda *a: met.append(pretokens.Pretokens._ids(table, *a)) or met[-1])
    assert list(table(texts)) == of(library, texts) and met == [[]]


def test_vocabularies_with_other_pretokens_do_not_fit():
    assert not pretokens.fits(Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")))


@pytest.mark.parametrize("n", [0, 1, 50, 40_000])
def test_expanding_each_rule_once(n):
    rng = np.random.default_rng(n)
    ids = rng.integers(0, 9, n).astype("<u4")
    symbols, rules, first = grammar.compress(ids, rounds=4, rules=30)
    assert grammar.expand(symbols, rules, first).tolist() == ids.tolist()
    assert grammar._unfolded(symbols, rules, first).tolist() == ids.tolist()
