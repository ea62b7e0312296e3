"""Token ids of whole texts with a public tokenizer, at the speed of numpy.

A text is cut where the tokenizer always cuts: before white space that follows something else, and
between an ASCII letter and a mark of punctuation. Each distinct piece of a task is encoded once by the
tokenizers library; all others are looked up in a hash table of numpy arrays. A piece is known by its
length and eight bytes, or by two independent 64-bit names if it is longer. Texts that hold white
space beyond ASCII, or a special token's marks, are encoded as one piece.
"""

import os
import re
from functools import lru_cache

import numpy as np

from riskloom.llm.names import names_of
from riskloom.llm.recompression import _SPACE

_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True
_MARK = np.zeros(256, bool)
_MARK[[ord(c) for c in ".,;:!?"]] = True
#: UTF-8 of Unicode white space beyond ASCII, and the marks of special tokens.
_WHOLE = re.compile(
    rb"\xc2[\x85\xa0]|\xe1\x9a\x80|\xe2\x80[\x80-\x8a\xa8\xa9\xaf]|\xe2\x81\x9f|\xe3\x80\x80|<\|"
)
#: Pieces that a task remembers before it starts anew.
REMEMBERED = 1_200_000
#: Bytes of text per step; a longer text is a step of its own.
STEP_BYTES = 1 << 20


class Encoder:
    """Encodes lists of texts; ``separator`` is a special token of the tokenizer."""

    def __init__(self, path: str, separator: str = "<|endoftext|>"):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.separator = separator
        self.mark = self.tokenizer.token_to_id(separator)
        self.kind = np.dtype(np.uint16 if self.tokenizer.get_vocab_size() <= 1 << 16 else np.uint32)
        self._forget()

    def _forget(self) -> None:
        self.count, self.used = 0, 0
        self.slots = np.full(1 << 12, -1, np.int32)
        #: Two names, the place of the first id and the number of ids of each piece.
        self.pieces = np.zeros((4, 1 << 11), np.uint64)
        self.flat = np.zeros(1 << 16, self.kind)

    def _find(self, names: np.ndarray, checks: np.ndarray) -> np.ndarray:
        """The number of each piece, -1 if it is not known."""
        found = np.full(len(names), -1, np.int32)
        at = np.arange(len(names))
        slot = (names & np.uint64(len(self.slots) - 1)).astype(np.int64)
        while len(at):
            held = self.slots[slot[at]]
            at, held = at[held >= 0], held[held >= 0]
            same = (self.pieces[0, held] == names[at]) & (self.pieces[1, held] == checks[at])
            found[at[same]] = held[same]
            at = at[~same]
            slot[at] = (slot[at] + 1) & (len(self.slots) - 1)
        return found

    def _enter(self, numbers: np.ndarray) -> None:
        """Put pieces into free slots, each at the first one after its own."""
        mask = len(self.slots) - 1
        slot = (self.pieces[0, numbers] & np.uint64(mask)).astype(np.int64)
        while len(numbers):
            free = np.flatnonzero(self.slots[slot] < 0)
            _, first = np.unique(slot[free], return_index=True)
            taken = free[first]
            self.slots[slot[taken]] = numbers[taken]
            rest = np.ones(len(numbers), bool)
            rest[taken] = False
            numbers, slot = numbers[rest], (slot[rest] + 1) & mask

    def _learn(self, names: np.ndarray, checks: np.ndarray, pieces: list[str]) -> None:
        """Remember the ids of new pieces; many are encoded in one call, a separator between."""
        alone = [i for i, p in enumerate(pieces) if "<|" in p or len(p) >= 200]
        skip = set(alone)
        plain = [i for i in range(len(pieces)) if i not in skip] if alone else range(len(pieces))
        groups = [[pieces[i] for i in plain[a : a + 512]] for a in range(0, len(plain), 512)]
        joined = self.tokenizer.encode_batch_fast(
            [self.separator.join(g) for g in groups], add_special_tokens=False
        )
        mark = np.array([self.mark], np.uint32)
        ids = np.concatenate([x for e in joined for x in (np.array(e.ids, np.uint32), mark)] or [mark[:0]])
        order, marks = np.array(plain, np.int64), np.flatnonzero(ids == self.mark)
        sizes = np.zeros(len(pieces), np.int64)
        sizes[order] = np.diff(marks, prepend=-1) - 1
        ids = ids[ids != self.mark]
        if alone:
            more = [self.tokenizer.encode_batch_fast([pieces[i]], add_special_tokens=False)[0].ids for i in alone]
            sizes[alone] = [len(x) for x in more]
            ids = np.concatenate([ids, np.array([x for found in more for x in found], np.uint32)])
            order = np.concatenate([order, alone])
        ends = np.cumsum(sizes[order])
        places = np.empty(len(pieces), np.int64)
        places[order] = ends - sizes[order]
        total, end = int(sizes.sum()), self.count + len(names)
        while self.used + total > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while end > self.pieces.shape[1]:
            self.pieces = np.concatenate([self.pieces, np.zeros_like(self.pieces)], axis=1)
        self.flat[self.used : self.used + total] = ids
        mine = np.arange(self.count, end)
        self.pieces[:, mine] = names, checks, self.used + places, sizes
        self.used, self.count = self.used + total, end
        if 2 * end > len(self.slots):
            size = len(self.slots)
            while 2 * end > size:
                size *= 2
            self.slots = np.full(size, -1, np.int32)
            mine = np.arange(end)
        self._enter(mine.astype(np.int32))

    @staticmethod
    def _distinct(names: np.ndarray, checks: np.ndarray) -> np.ndarray:
        """A place of each distinct pair."""
        _, first, back = np.unique(names, return_index=True, return_inverse=True)
        if (checks[first][back] != checks).any():
            first = np.unique(np.rec.fromarrays([names, checks]), return_index=True)[1]
        return first

    def _step(self, texts: list[bytes]) -> list[np.ndarray]:
        data = b"".join(texts)
        raw = np.frombuffer(data, np.uint8)
        if not len(raw):
            return [np.zeros(0, self.kind) for _ in texts]
        edges = np.cumsum([0, *map(len, texts)])
        space = _SPACE[raw]
        cut = np.zeros(len(raw), bool)
        cut[1:] = (space[1:] & ~space[:-1]) | (_MARK[raw[1:]] & _LETTER[raw[:-1]])
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
            if _WHOLE.search(data, a, b):
                cut[a:b] = False
        cut[edges[:-1][np.diff(edges) > 0]] = True
        starts = np.flatnonzero(cut)
        sizes = np.diff(np.concatenate([starts, [len(raw)]]))
        names, checks = names_of(data, starts, sizes), np.zeros(len(starts), np.uint64)
        long = np.flatnonzero(sizes > 8)
        checks[long] = names_of(data, starts[long], sizes[long], turn=1)
        code = self._find(names, checks)
        new = np.flatnonzero(code < 0)
        if len(new):
            first = new[self._distinct(names[new], checks[new])]
            if self.count + len(first) > REMEMBERED:
                self._forget()
                new = np.arange(len(names))
                first = self._distinct(names, checks)
            spans = zip(starts[first].tolist(), sizes[first].tolist())
            self._learn(names[first], checks[first], [data[a : a + n].decode() for a, n in spans])
            code[new] = self._find(names[new], checks[new])
        heads, counts = (self.pieces[i, code].astype(np.int64) for i in (2, 3))
        ends = np.cumsum(counts)
        index = np.repeat(heads - ends + counts, counts) + np.arange(int(ends[-1]))
        ids = self.flat[index]
        bounds = np.concatenate([[0], ends])[np.searchsorted(starts, edges)]
        return [ids[a:b] for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())]

    def encode(self, texts: list[bytes]) -> list[np.ndarray]:
        """Ids of each text (UTF-8), as the tokenizer alone would give them."""
        out, group, size = [], [], 0
        for text in texts:
            if group and size + len(text) > STEP_BYTES:
                out += self._step(group)
                group, size = [], 0
            group.append(text)
            size += len(text)
        return out + (self._step(group) if group else [])


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One encoder per task process and tokenizer file."""
    return Encoder(path)


def forget() -> None:
    """Free the encoders of this process. Python workers are used again, so later stages call this."""
    encoder.cache_clear()
