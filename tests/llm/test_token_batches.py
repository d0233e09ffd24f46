"""Texts encoded together have the ids that each has alone."""

from __future__ import annotations

import pyarrow as pa

from tabchain.llm.tokens import WordEncoder, vocabulary_path
from tests.llm.test_tokens import ODD


def test_texts_together_have_their_own_ids():
    one, all_at_once = WordEncoder(vocabulary_path()), WordEncoder(vocabulary_path())
    for texts in (ODD, ODD[:1], [], ODD[::-1] * 3, [" ", "\n", ""], ["\x0ba\x0cb\r", " a  b "]):
        assert all_at_once.encode_all(pa.array(texts, pa.string())) == [one.encode(t) for t in texts]
    assert all_at_once.encode_all(pa.array(["x", *ODD], pa.string()).slice(1)) == [one.encode(t) for t in ODD]


def test_a_word_of_several_texts_is_looked_up_once():
    class Counting(WordEncoder):
        asked = 0

        def __getitem__(self, word):
            Counting.asked += 1
            return super().__getitem__(word)

    words = Counting(vocabulary_path())
    assert len(set(words.encode_all(pa.array(["same word again", "again word same same"] * 500)))) == 2
    assert Counting.asked == 3
