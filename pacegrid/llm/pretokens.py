"""Token ids of plain texts by array operations, with the merges of the installed tokenizer library.

A plain text consists of ASCII letters, digits and marks (no apostrophe, no ``<``), Latin letters of
two bytes, and single blanks or line feeds between them. There the pre-tokens of a byte-level
vocabulary end where the class of character changes, a blank opening the next one. Pre-tokens are
found by a hash in a bounded table, whose bytes must spell the texts again; new ones go to the
library's merges, many in a string. All other texts are left to ``memo``.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np

#: Characters of texts that are worked on together, pre-tokens remembered, slots for them, the longest one.
TOGETHER, MOST, SLOTS, LONGEST = 1 << 20, 1 << 20, 22, 256
#: Pre-tokens that the merges take as one string.
_RUN = 200
_LETTER, _DIGIT, _MARK, _BLANK, _FEED, _END = range(1, 7)
_KIND = np.zeros(256, np.uint8)
for _c in range(33, 127):
    _KIND[_c] = _LETTER if chr(_c).isalpha() else _DIGIT if chr(_c).isdigit() else 0 if chr(_c) in "'<" else _MARK
_KIND[[32, 10, 0]] = _BLANK, _FEED, _END
_random = np.random.default_rng(7)
_OF_BYTE, _OF_PLACE = (_random.integers(1 << 63, size=n, dtype=np.uint64) * np.uint64(2) + np.uint64(1) for n in (256, LONGEST))
#: The pre-tokenizer whose cuts are known here.
_LEVEL = re.compile(r"ByteLevel\(add_prefix_space=False, trim_offsets=\w+, use_regex=True\)")


class _Row:
    """An array that grows."""

    def __init__(self, kind):
        self.values, self.n = np.empty(1 << 16, kind), 0

    def add(self, values: np.ndarray) -> None:
        n = self.n + len(values)
        if n > len(self.values):
            self.values = np.concatenate([self.values[: self.n], np.empty(2 * n - self.n, self.values.dtype)])
        self.values[self.n : n], self.n = values, n

    def __getitem__(self, at):
        return self.values[: self.n][at]


def _ranges(starts: np.ndarray, wide: np.ndarray) -> np.ndarray:
    """``start, start + 1, ...`` of each range, one range after another."""
    ends = np.cumsum(wide)
    return np.repeat(starts - ends + wide, wide) + np.arange(ends[-1] if len(ends) else 0)


class Pretokens:
    """Token ids of texts as little-endian unsigned 32-bit bytes; ``rest`` gives those of texts that are not plain."""

    def __init__(self, rest, library, most: int = MOST, slots: int = SLOTS):
        from tokenizers import Tokenizer, pre_tokenizers

        self.rest, self.most, self.slots = rest, most, slots
        self.bare, self.feed = Tokenizer(library.model), library.token_to_id("Ċ")
        level = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        # what stands for a byte: plain texts hold these bytes only
        self.spelled = np.zeros(256, "<u4")
        for c in map(chr, [10, *range(32, 127), *range(0xC0, 0x100), 0x152, 0x153]):
            for byte, shown in zip(c.encode(), level.pre_tokenize_str(c)[0][0], strict=True):
                self.spelled[byte] = ord(shown)
        self._begin()

    def _begin(self) -> None:
        self.keys, self.entry = np.zeros(1 << self.slots, np.uint64), np.zeros(1 << self.slots, np.int32)
        self.text, self.text_at, self.wide = _Row(np.uint8), _Row(np.int64), _Row(np.int64)
        self.ids, self.ids_at, self.n_ids, self.key, self.uses = _Row("<u4"), _Row(np.int64), _Row(np.int64), _Row(np.uint64), _Row(np.int32)
        fixed = np.array([0, 10], np.uint8)
        self._enter(_OF_BYTE[fixed] * _OF_PLACE[0], fixed, np.array([1, 1]), np.array([self.feed], "<u4"), np.array([0, 1]), np.ones(2, np.int32))

    def _enter(self, keys, text, wide, ids, n_ids, uses) -> None:
        names = np.arange(self.key.n, self.key.n + len(keys), dtype=np.int32)
        for row, flat, at, n in ((self.text, text, self.text_at, wide), (self.ids, ids, self.ids_at, n_ids)):
            at.add(row.n + np.cumsum(n) - n)
            row.add(flat)
        for row, values in ((self.wide, wide), (self.n_ids, n_ids), (self.key, keys), (self.uses, uses)):
            row.add(values)
        todo, at = np.arange(len(keys)), self._home(keys)
        while len(todo):
            free = self.keys[at] == 0
            self.keys[at[free]] = keys[todo[free]]
            won = self.keys[at] == keys[todo]
            self.entry[at[won]] = names[todo[won]]
            todo, at = todo[~won], (at[~won] + 1) & (len(self.keys) - 1)

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return (keys >> np.uint64(64 - self.slots)).astype(np.intp)

    def _find(self, keys: np.ndarray) -> np.ndarray:
        found, todo, at = np.full(len(keys), -1, np.int32), np.arange(len(keys)), self._home(keys)
        while len(todo):
            there = self.keys[at]
            same = there == keys[todo]
            found[todo[same]] = self.entry[at[same]]
            on = ~same & (there != 0)
            todo, at = todo[on], (at[on] + 1) & (len(self.keys) - 1)
        return found

    def _forget(self) -> None:
        """Keep what was met in several groups, at most half of all."""
        kept = np.flatnonzero(self.uses[2:] > 1) + 2
        if len(kept) > self.most // 2:
            kept = np.sort(kept[np.argsort(-self.uses[kept], kind="stable")[: self.most // 2]])
        wide, n = self.wide[kept], self.n_ids[kept]
        old = self.key[kept], self.text[_ranges(self.text_at[kept], wide)], wide, self.ids[_ranges(self.ids_at[kept], n)], n, np.ones(len(kept), np.int32)
        self._begin()
        self._enter(*old)

    def _learn(self, keys: np.ndarray, text: np.ndarray, starts: np.ndarray, wide: np.ndarray) -> None:
        keys, first = np.unique(keys, return_index=True)
        starts, wide = starts[first], wide[first]
        # each with the character after it, which becomes a line feed
        lines = text[_ranges(starts, wide + 1)]
        ends = np.cumsum(wide + 1)
        lines[ends - 1] = 10
        shown, cuts = self.spelled[lines].tobytes().decode("utf-32-le"), [0, *ends[_RUN - 1 : -1 : _RUN].tolist(), int(ends[-1])]
        runs = self.bare.encode_batch_fast([shown[a:b] for a, b in zip(cuts, cuts[1:])], add_special_tokens=False)
        ids = np.concatenate([np.asarray(e.ids, "<u4") for e in runs])
        closed = ids == self.feed
        n_ids = np.diff(np.flatnonzero(closed), prepend=-1) - 1
        self._enter(keys, text[_ranges(starts, wide)], wide, ids[~closed], n_ids, np.zeros(len(keys), np.int32))

    def _plain(self, raws: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(which texts are plain, their bytes with a null after each text, kinds of these bytes)."""
        # a null within a text would look like its end
        text = np.frombuffer(b"\0".join([*[b"<" if b"\0" in raw else raw for raw in raws], b""]), np.uint8)
        kind = _KIND[text]
        high = np.flatnonzero((text == 0xC3) | (text == 0xC5))
        after = text[high + 1]
        letter = np.where(text[high] == 0xC3, (after != 0x97) & (after != 0xB7), (after == 0x92) | (after == 0x93))
        high = high[letter]
        kind[high] = kind[high + 1] = _LETTER
        white = kind >= _BLANK
        odd = kind == 0
        odd[1:] |= white[1:] & white[:-1]
        odd[0] |= white[0]
        ends = np.flatnonzero(text == 0)
        sizes = np.diff(ends, prepend=-1)
        plain = np.add.reduceat(odd, ends - sizes + 1, dtype=np.int64) == 0
        # white space at the beginning follows the end of the text before, to which it counts
        kept = np.repeat(plain, sizes)
        return plain, text[kept], kind[kept]

    def _together(self, texts: list[str]) -> list[bytes]:
        raws = [t.encode() for t in texts]
        plain, text, kind = self._plain(raws)
        cuts: list[bytes] = []
        if len(text):
            opens = np.empty(len(text), bool)
            opens[0] = True
            opens[1:] = (kind[1:] != kind[:-1]) & (kind[:-1] != _BLANK)
            starts = np.flatnonzero(opens)
            wide = np.diff(starts, append=len(text))
            if wide.max() <= LONGEST:
                cuts = self._ids(text, starts, wide)
        if not cuts:
            return [self.rest.one(t) for t in texts]
        found = iter(cuts)
        return [next(found) if p else self.rest.one(t) for p, t in zip(plain.tolist(), texts)]

    def _ids(self, text: np.ndarray, starts: np.ndarray, wide: np.ndarray) -> list[bytes]:
        """Ids of each of the texts, or nothing if two pre-tokens have the same hash."""
        place = np.arange(len(text)) - np.repeat(starts, wide)
        keys = np.add.reduceat(_OF_BYTE[text] * _OF_PLACE[place], starts)
        keys[keys == 0] = 1
        if self.key.n > self.most:
            self._forget()
        entry = self._find(keys)
        new = entry < 0
        if new.any():
            self._learn(keys[new], text, starts[new], wide[new])
            entry[new] = self._find(keys[new])
        met = np.zeros(self.uses.n, bool)
        met[entry] = True
        self.uses.values[: self.uses.n] += met
        if not (np.array_equal(self.wide[entry], wide) and np.array_equal(self.text[np.repeat(self.text_at[entry], wide) + place], text)):
            return []
        n = self.n_ids[entry]
        raw = self.ids[_ranges(self.ids_at[entry], n)].tobytes()
        ends = (np.cumsum(n)[entry == 0] * 4).tolist()
        return [raw[a:b] for a, b in zip([0, *ends], ends)]

    def __call__(self, texts: Iterable[str | None]) -> Iterator[bytes]:
        held, size = [], 0
        for text in texts:
            held.append(text or "")
            size += len(held[-1])
            if size >= TOGETHER:
                yield from self._together(held)
                held, size = [], 0
        if held:
            yield from self._together(held)


def fits(library) -> bool:
    """Whether this vocabulary's pre-tokens are those of plain texts, and no merge reaches over a line feed beside one."""
    model = library.model
    if library.normalizer is not None or not _LEVEL.fullmatch(str(library.pre_tokenizer)) or type(model).__name__ != "BPE":
        return False
    if model.dropout or model.unk_token or model.continuing_subword_prefix or model.end_of_word_suffix or model.ignore_merges:
        return False
    if library.truncation or library.padding or not all(set(t.content) & set("'<") for t in library.get_added_tokens_decoder().values()):
        return False
    tokens = library.get_vocab(with_added_tokens=False)
    beside = {c for t in tokens if "Ċ" in t for a, b in zip(t, t[1:]) if "Ċ" in (a, b) for c in (a, b)} - {"Ċ"}
    return "Ċ" in tokens and not beside & {chr(c) for c in Pretokens(None, library).spelled.tolist()}
