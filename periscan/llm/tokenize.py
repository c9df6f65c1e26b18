"""Whole-text encoding with a public byte-level tokenizer, one library call for each distinct piece of text.

The pre-tokenizer of this vocabulary starts a new token at every single space or
newline between two non-blank characters, so a text may be cut there without
changing its ids. Cutting there and keeping the ids of pieces already seen
makes the library encode each distinct piece once per worker.
"""

from __future__ import annotations

import re
from array import array

import numpy as np

#: Pieces kept in a worker before its memory of them is emptied.
KEPT_PIECES = 1_200_000
#: Longer pieces are encoded but not kept.
KEPT_LENGTH = 64

#: New pieces that the library gets as one text.
JOINED_PIECES = 512

#: Signs at which a text is not cut: runs of blanks, other blanks, and the sign that marks the cuts.
_RUNS = ("  ", "\n\n", " \n", "\n ", "\0")
_ASCII_BLANKS = "\t\r\v\f\x1c\x1d\x1e\x1f"
_OTHER_BLANK = re.compile(r"[\t\x0b-\r\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
_encoders: dict[tuple[str, bool], PieceEncoder] = {}


class PieceEncoder:
    """``plain``: added tokens such as an end-of-text mark count as ordinary text; otherwise the library finds them in texts, as it does by default."""

    def __init__(self, path: str, plain: bool = False):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = plain
        #: A text that holds one of these is not cut, nor its pieces kept.
        self.added = [] if plain else [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.kept: dict[str, bytes] = {}
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        #: Bytes of each id's token: a byte-level vocabulary writes a byte as a sign.
        self.sizes = np.zeros(max(vocabulary.values(), default=0) + 1, np.int64)
        for token, i in vocabulary.items():
            self.sizes[i] = len(token)
        self.joins = self.tokenizer.normalizer is None and not any(re.search(r"\s", t.content) for t in self.tokenizer.get_added_tokens_decoder().values())

    def library(self, texts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def joined(self, pieces: list[str]) -> list[bytes]:
        """What :meth:`library` gives of pieces that each are a space or newline and non-blanks. They are encoded as a few long texts, and the ids are
        dealt to the pieces by the bytes of their tokens; where those don't end with the pieces, each piece is encoded by itself."""
        parts = [pieces[k : k + JOINED_PIECES] for k in range(0, len(pieces), JOINED_PIECES)]
        out: list[bytes] = []
        for part, e in zip(parts, self.tokenizer.encode_batch_fast(["".join(p) for p in parts], add_special_tokens=False), strict=True):
            ids = np.array(e.ids, "<u4")
            ends = np.cumsum(self.sizes[ids])
            wanted = np.cumsum([len(x) if x.isascii() else len(x.encode()) for x in part])
            after = np.searchsorted(ends, wanted) + 1
            if after[-1] == len(ids) and (ends[after - 1] == wanted).all():
                raw, at = ids.tobytes(), 0
                for k in (4 * after).tolist():
                    out.append(raw[at:k])
                    at = k
            else:
                out += self.library(part)
        return out

    def pieces(self, text: str) -> list[str]:
        """The text cut before each single space or newline; whole if it has other blanks, runs of them or added tokens."""
        if any(r in text for r in _RUNS) or any(t in text for t in self.added) or (any(c in text for c in _ASCII_BLANKS) if text.isascii() else _OTHER_BLANK.search(text)):
            return [text]
        return text.replace("\n", "\0\n").replace(" ", "\0 ").split("\0")

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text as little-endian 32-bit integers; none for null or empty texts."""
        get = self.kept.get
        out: list[bytes | None] = []
        open_texts: list[tuple[int, list[str], list[bytes | None], list[int]]] = []
        alone: set[str] = set()
        new: set[str] = set()
        for k, t in enumerate(texts):
            cut = self.pieces(t) if t else []
            got = list(map(get, cut))
            if None in got:
                out.append(None)
                holes = [j for j, g in enumerate(got) if g is None]
                open_texts.append((k, cut, got, holes))
                # The first and the last piece need not be a blank and non-blanks.
                inner = [cut[j] for j in holes if 0 < j < len(cut) - 1] if self.joins else []
                new.update(inner)
                alone.update(cut[j] for j in holes if not self.joins or j in (0, len(cut) - 1))
            else:
                out.append(b"".join(got))
        alone -= new
        names = [*alone, *new]
        if len(self.kept) + len(names) > KEPT_PIECES:
            self.kept.clear()
        made = dict(zip(names, [*self.library(list(alone)), *self.joined(list(new))], strict=True))
        for k, cut, got, holes in open_texts:
            for j in holes:
                got[j] = made[cut[j]]
            out[k] = b"".join(got)
        self.kept.update((x, ids) for x, ids in made.items() if len(x) <= KEPT_LENGTH)
        return out


def encoder(path: str, plain: bool = False) -> PieceEncoder:
    """The encoder of a vocabulary file, one for each Python worker."""
    if (path, plain) not in _encoders:
        _encoders[path, plain] = PieceEncoder(path, plain)
    return _encoders[path, plain]


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)
