"""Token ids of whole texts, with a per-process memory of words.

The tokenizer file drops white space and never lets a token cross it, so a text's
ids are its words' ids in a row. A word is looked up in a bounded dictionary; a
new one goes through the tokenizer. Plain Latin words take the tokenizer's model
step alone, since normalising and splitting them is known; anything else is
encoded whole. Many texts at a time look each of their distinct words up once. The tests hold this against encoding the whole text.
"""

from __future__ import annotations

import re
import string
from functools import lru_cache
from itertools import pairwise
from struct import pack

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

VOCABULARY_FILE = "word_bpe_49k.json"
#: Words and pieces that a process remembers before it forgets all of them and starts anew.
WORDS_KEPT = 800_000

#: Printable ASCII and precomposed Latin letters whose lower case is one letter.
_PLAIN = re.compile("[!-~À-ÖØ-öø-įı-ňŊ-ſ]+")
_MARKS = frozenset(string.punctuation)
#: Splitting rule of the vocabulary file, for plain words. Fixed value.
_PIECES = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zÀ-ÖØ-öø-ſ]+|[0-9]|[^\sa-z0-9À-ÖØ-öø-ſ]+")


class WordEncoder(dict):
    """Ids of a word (bytes) as little-endian unsigned 16-bit numbers."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        if self.tokenizer.get_vocab_size() > 1 << 16:
            raise ValueError("ids don't fit into 16 bits")
        self.model = self.tokenizer.model
        shown = ByteLevel(add_prefix_space=False, use_regex=False)
        plain = [chr(c) for c in range(0x21, 0x180) if _PLAIN.fullmatch(chr(c))]
        self.shown = str.maketrans({c: shown.pre_tokenize_str(c)[0][0] for c in plain})

    def __missing__(self, word: bytes) -> bytes:
        text = word.decode()
        if _PLAIN.fullmatch(text) and "<|" not in text:
            lower = text.lower()
            # A run of letters is one piece, and so is a single mark behind it.
            if lower.isalpha():
                parts = [lower]
            elif lower[-1] in _MARKS and lower[:-1].isalpha():
                parts = [lower[:-1], lower[-1]]
            else:
                parts = _PIECES.findall(lower)
            # A piece is a word that is its own only piece, so one dictionary has both.
            if parts == [text]:
                tokens = [t.id for t in self.model.tokenize(text.translate(self.shown))]
                ids = pack(f"<{len(tokens)}H", *tokens)
            else:
                ids = b"".join([self[part.encode()] for part in parts])
        else:
            ids = np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u2").tobytes()
        self[word] = ids
        return ids

    def _forget(self) -> None:
        if len(self) > WORDS_KEPT:
            self.clear()

    def encode(self, text: str | None) -> bytes:
        """Ids of a whole text; a null text has none."""
        if not text:
            return b""
        self._forget()
        return b"".join(map(self.__getitem__, text.encode().split()))

    def encode_all(self, texts: pa.Array) -> list[bytes]:
        """``encode`` of each text, every distinct word of all of them looked up once."""
        self._forget()
        lists = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
        words = lists.flatten().dictionary_encode()
        # As one text with spaces, which no word holds: much faster than word by word.
        distinct = pa.ListArray.from_arrays([0, len(words.dictionary)], words.dictionary.cast(pa.binary()))
        each = pc.binary_join(distinct, b" ")[0].as_py().split(b" ")
        taken = pa.array(list(map(self.__getitem__, each)), pa.large_binary()).take(words.indices)
        ends = np.frombuffer(taken.buffers()[1], np.int64, len(taken) + 1, taken.offset * 8)
        counts = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
        places = ends[np.concatenate([[0], counts.cumsum()])].tolist()
        data = taken.buffers()[2].to_pybytes() if places[-1] else b""
        return [data[a:b] for a, b in pairwise(places)]


def vocabulary_path(name: str = VOCABULARY_FILE) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@lru_cache(maxsize=2)
def encoder(path: str) -> WordEncoder:
    """One encoder per process and file."""
    return WordEncoder(path)
