"""Tokenizing by remembered pieces of text, with the installed tokenizer libraries.

Words repeat, so each task keeps what the library gave for a piece of text and asks it only for
pieces not seen yet. A text is cut only where no token can reach across (stated at each cutter); a
text for which that is not certain goes through the library whole. The memory is bounded, which
changes no result.
"""

from __future__ import annotations

import os
import re
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

import numpy as np

from pacegrid.llm.pretokens import Pretokens, fits

#: Pieces remembered in one task; as many older ones are kept until the next are full.
REMEMBERED = 400_000

#: White space for some of the libraries but not for all: a text with one goes whole.
DOUBTFUL = re.compile("[\x1c-\x1f\x85\xa0\u1680\u180e\u2000-\u200f\u2028\u2029\u202f\u205f\u3000\ufeff]")
_UNIT = re.compile(r"[ \t\n\r\f\v]*[^ \t\n\r\f\v]+|[ \t\n\r\f\v]+")
_RARE = "\t\r\f\v"


class GoesWhole(Exception):
    """A piece that says that its text cannot be cut."""


class _Known(dict):
    def __init__(self, ask: Callable, older: dict):
        super().__init__()
        self.ask, self.older = ask, older

    def __missing__(self, piece: str):
        value = self.older.get(piece)
        if value is None:
            value = self.ask(piece)
        self[piece] = value
        return value


class Memo:
    """What each text gives, from what its pieces give.

    ``cut`` gives the pieces of a text, or None if it must go whole; ``ask`` gives the value of one
    piece or raises ``GoesWhole``; ``whole`` gives that of a text; ``join`` makes one of many. Twice
    ``most`` pieces are remembered at most.
    """

    def __init__(self, cut: Callable, ask: Callable, whole: Callable, join: Callable = b"".join, most: int = REMEMBERED):
        self.cut, self.ask, self.whole, self.join, self.most = cut, ask, whole, join, most
        self.known = _Known(ask, {})

    def one(self, text: str):
        if len(self.known) > self.most:
            older = self.known
            older.older = {}
            self.known = _Known(self.ask, older)
        pieces = self.cut(text)
        if pieces is None:
            return self.whole(text)
        try:
            return self.join(map(self.known.__getitem__, pieces))
        except GoesWhole:
            return self.whole(text)

    def __call__(self, texts: Iterable[str | None]) -> Iterator:
        return (self.one(text or "") for text in texts)


_HELD: dict[tuple, Memo] = {}


def held(*key, make: Callable[[], Memo]) -> Memo:
    """The worker's memory for a kind of work; a worker that turns to another kind forgets the last.

    Workers live on from stage to stage, and the memories of all their stages would add up.
    """
    if key not in _HELD:
        _HELD.clear()
        _HELD[key] = make()
    return _HELD[key]


def _words(text: str) -> list[str] | None:
    """The vocabulary drops white space, so every token lies within a word."""
    return text.replace("\n", " ").split(" ")


def _spaced(text: str) -> list[str] | None:
    """Cut before each run of white space: its last blank may open a token, none reaches back over it.

    A piece stands for itself with a blank before it, but one that opens with a line feed or, after a
    carriage return as a mark, with anything else.
    """
    plain = text and text[0] not in " \n" and text[-1] not in " \n"
    if plain and not ("  " in text or " \n" in text or "\n " in text or "\n\n" in text or any(c in text for c in _RARE)):
        pieces = text.replace("\n", " \n").split(" ")
        pieces[0] = "\r" + pieces[0]
        return pieces
    return ["\r" + unit for unit in _UNIT.findall(text)]


CUTTERS = {"words": _words, "spaced": _spaced}

#: A plain word: what opens it, Latin letters that are composed and have one small form, end marks.
_PLAIN = re.compile(r"([ \n]?)([A-Za-zÀ-ÖØ-öø-ÿŒœ]+)([.,;:!?|#$%&*]*)")


def ids_of(path: str, cutter: str) -> Memo:
    """Token ids of texts by a ``tokenizers`` file, from the worker's memory."""
    return held("ids", path, cutter, make=lambda: _ids_of(path, cutter))


def _ids_of(path: str, cutter: str) -> Memo | Pretokens:
    """Token ids as little-endian unsigned 32-bit bytes, by a ``tokenizers`` file.

    A plain word's pre-tokens are known without the library's patterns: its letters (with a blank
    before them, if the vocabulary keeps blanks) and its end marks. They go to the library's merges.
    """
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer, pre_tokenizers

    library = Tokenizer.from_file(path)
    merges = library.model.tokenize
    level = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
    letters = {c: level.pre_tokenize_str(c)[0][0] for c in map(chr, [10, *range(32, 127), *range(161, 256), 338, 339])}
    spelled = str.maketrans(letters)
    written = [i.to_bytes(4, "little") for i in range(library.get_vocab_size())]

    def whole(text: str) -> bytes:
        return np.asarray(library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def ids(spelling: str) -> bytes:
        return b"".join([written[t.id] for t in merges(spelling)])

    marks = lru_cache(maxsize=10_000)(ids)

    def ask(piece: str) -> bytes:
        if cutter == "spaced":
            piece = piece[1:] if piece[:1] == "\r" else piece if piece[:1] == "\n" else " " + piece
        if not (m := _PLAIN.fullmatch(piece)):
            if DOUBTFUL.search(piece):
                raise GoesWhole
            return whole(piece)
        opens, word, ends = m.groups()
        if cutter == "words":
            out = ids(word.lower().translate(spelled))
        elif opens == "\n":
            out = marks(letters[opens]) + ids(word.translate(spelled))
        else:
            out = ids((opens + word).translate(spelled))
        return out + marks(ends) if ends else out

    memo = Memo(CUTTERS[cutter], ask, whole)
    return Pretokens(memo, library) if cutter == "spaced" and fits(library) else memo
