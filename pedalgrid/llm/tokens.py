"""Token ids of whole texts, with the pieces that recur encoded once.

The vocabulary's splitter puts a boundary before every single blank between two
other characters and on both sides of a lone line feed, so a text whose white
space is only such can be encoded piece by piece: a piece's ids depend on nothing
around it. Pieces are kept in tables of bounded size. Any other text goes to the
tokenizer whole.

Most new pieces are letters, with or without closing marks; both parts are single
words to the splitter, so they go straight to the tokenizer's merge model.
"""

from __future__ import annotations

import os
from array import array
from functools import cache
from itertools import islice

END = 2
MOST_KEPT = 800_000


def vocabulary_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


CLOSING = ".,;:!?"


@cache
def byte_letters() -> dict[int, str]:
    """Byte-level vocabularies write a byte as its Latin-1 letter if that can be seen,
    the others, in order, as the letters from code point 256 on."""
    seen = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(seen)]
    return {b: chr(b) for b in seen} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Pieces(dict):
    """Ids of a piece, made when first asked for and kept while there is room."""

    def __init__(self, ids_of):
        self.ids_of = ids_of

    def __missing__(self, piece: str) -> bytes:
        ids = self.ids_of(piece)
        if len(self) < MOST_KEPT:
            self[piece] = ids
        return ids


class Encoder:
    """Ids as 16-bit numbers in bytes; the vocabulary has at most 2^16."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        if tokenizer.get_vocab_size() > 1 << 16:
            raise ValueError("the vocabulary does not fit 16-bit ids")
        encode, merge, letters = tokenizer.encode, tokenizer.model.tokenize, byte_letters()

        def whole(text: str) -> bytes:
            return array("H", encode(text, add_special_tokens=False).ids).tobytes()

        def word(text: str, lead: str = "") -> bytes:
            if not text.isascii():
                text = text.encode().decode("latin-1").translate(letters)
            return array("H", [t.id for t in merge(lead + text)]).tobytes()

        def piece(text: str, lead: str = "") -> bytes:
            head = text.rstrip(CLOSING)
            if not head.isalpha():
                return whole(lead + text)
            tail = text[len(head) :]
            return word(head, blank if lead else "") + (closing[tail] if tail else b"")

        closing, blank = Pieces(word), letters[32]
        self.whole = whole
        self.first = Pieces(piece)  # at the start of a line
        self.later = Pieces(lambda text: piece(text, " "))  # after a blank, kept without it
        self.feed = whole("\n")

    def encode(self, text: str | None) -> bytes:
        """Ids of a text, without special tokens."""
        if not text:
            return b""
        words = text.split()
        gaps = len(words) - 1
        # plain if blanks and line feeds part the words, one each, and nothing else does
        if len(text) - sum(map(len, words)) != gaps or text.count(" ") + text.count("\n") != gaps:
            return self.whole(text)
        first, later, feed = self.first, self.later.__getitem__, self.feed
        out = []
        at = 0
        for line in text.split("\n"):
            end = at + line.count(" ") + 1
            out.append(feed)
            out.append(first[words[at]])
            out.extend(map(later, words[at + 1 : end]))
            at = end
        return b"".join(islice(out, 1, None))


@cache
def encoder(path: str) -> Encoder:
    """One per worker process, so that tasks that follow each other share its tables."""
    return Encoder(path)
