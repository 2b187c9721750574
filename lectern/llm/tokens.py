"""Token ids of whole texts by a `tokenizers` file, one encoder for each worker process."""

from __future__ import annotations

import os
import re
from functools import lru_cache

import regex

from .chunks import ChunkEncoder, Pieces

#: Fixed values of the byte-level alphabet: bytes that stand for themselves; the others follow from 256.
_OWN_BYTES = [*range(33, 127), *range(161, 173), *range(174, 256)]
#: Text whose words need no Unicode normal form: ASCII and the letters of Latin-1.
_PLAIN = re.compile(r"[\t\n\r!-;=-~ A-Za-zÀ-ÖØ-öø-ÿ]*")


def _byte_letters() -> dict[int, str]:
    others = (b for b in range(256) if b not in _OWN_BYTES)
    return {**{b: chr(b) for b in _OWN_BYTES}, **{b: chr(256 + k) for k, b in enumerate(others)}}


class TextEncoder(ChunkEncoder):
    """Ids of whole texts by a tokenizer of `vocabulary` ids. A plain chunk is cut into the tokenizer's own
    words, whose ids come from its model; any other chunk goes through the whole tokenizer."""

    def __init__(self, tokenizer, words: str, drops_white_space: bool):
        findall, tokenize, letters = regex.compile(words).findall, tokenizer.model.tokenize, str.maketrans(_byte_letters())

        def cut(chunk: str) -> list[str] | None:
            if _PLAIN.fullmatch(chunk):
                return findall(chunk.lower() if drops_white_space else chunk)
            return None

        def word_ids(word: str) -> list[int]:
            return [t.id for t in tokenize(word.encode().decode("latin-1").translate(letters))]

        def whole(chunks: list[str]) -> list[list[int]]:
            return [e.ids for e in tokenizer.encode_batch_fast(chunks, add_special_tokens=False)]

        super().__init__(Pieces(cut, word_ids, whole), drops_white_space)
        self.vocabulary = 1 + max(tokenizer.get_vocab(with_added_tokens=True).values())


@lru_cache(maxsize=1)
def encoder(path: str, drops_white_space: bool) -> TextEncoder:
    """drops_white_space: a tokenizer of lower-cased words between white space; otherwise a byte-level
    one whose words may begin with one space. Both kinds end in byte-level letters."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    import public_tokenizers
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(path)
    own.no_truncation()
    own.no_padding()
    # the split pattern of the file, which drops what it does not match
    words = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+" if drops_white_space else public_tokenizers.PATTERN
    return TextEncoder(own, words, drops_white_space)
