r"""Substring dedup by recompression.

A text is a sequence of word names (64-bit hashes). Each level of recompression names maximal runs
of one symbol, then pairs of a "left" and a "right" symbol, where the side of a symbol is a bit of
its name. A new name is a hash of what it stands for, so all tasks give equal things equal names.
Equal substrings then have the same symbols inside, apart from their ends: for every symbol the
range of words that its existence depends on is known, and wherever these words recur, so does it.

1. Every symbol that depends on at most ``width`` words is sent to the task of its name, which tells
   whether it occurs again. A window that contains all a symbol depends on, where that symbol occurs
   nowhere else, occurs nowhere else itself.
2. The remaining windows (inside shared symbols, or without any usable symbol, as in long periodic
   runs) are verified: their own hashes are exchanged, and those that occur twice are repeats.
3. Each word in a repeated window is removed.

Window hashes have 64 bits; between blocks, also those of the part they meet in. Names and hashes are exchanged as
packed arrays between blocks of documents (see ``blocks``), three reads of a bucketed table in all.

Defined cases: a null or empty text has no words and the digest of the empty string; fewer words
than ``width`` have no window; equal rows are documents of their own (their windows repeat); a null
id stays null in the result. Extra columns are not read.
"""

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from riskloom.llm import blocks as B
from riskloom.llm.names import R1, R2, mixed, names_of

_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True

class Words:
    """The words of several texts, one after the other."""

    def __init__(self, texts: list[bytes]):
        self.data = b" ".join(texts)
        raw = np.frombuffer(self.data, np.uint8)
        space = _SPACE[raw]
        before = np.ones(len(raw), bool)
        before[1:] = space[:-1]
        self.starts = np.flatnonzero(~space & before)
        after = np.ones(len(raw), bool)
        after[:-1] = space[1:]
        self.ends = np.flatnonzero(~space & after) + 1
        edges = np.cumsum([0, *(len(t) + 1 for t in texts)])
        #: Word range of each text.
        self.docs = np.searchsorted(self.starts, edges)
        self.names = names_of(self.data, self.starts, self.ends - self.starts)

    def doc_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.docs) - 1), np.diff(self.docs))

    def windows(self, width: int) -> np.ndarray:
        """Whether a whole window of one text starts at each word."""
        ok = np.zeros(len(self.names), bool)
        for a, b in zip(self.docs[:-1], self.docs[1:]):
            ok[a : max(a, b - width + 1)] = True
        return ok


def _joined(a: np.ndarray, b: np.ndarray, base: np.uint64) -> np.ndarray:
    return mixed(a * base + mixed(b ^ base))


def rolling(names: np.ndarray, width: int, base: np.uint64) -> np.ndarray:
    """A hash of each run of ``width`` names; the last places have none and get 0.

    Runs of 1, 2, 4 ... names are joined; those that add up to the width give the hash.
    """
    n = len(names) - width + 1
    out = np.zeros(len(names), np.uint64)
    if n > 0:
        run, size, done, acc = names, 1, 0, None
        while True:
            if width & size:
                part = run[done : done + n]
                acc = mixed(part + base) if acc is None else _joined(acc, part, base)
                done += size
            if 2 * size > width:
                break
            run = _joined(run[:-size], run[size:], base)
            size *= 2
        out[:n] = acc
    return out


def recompress(words: Words, levels: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Names of the top symbols and the word range [low, high) that each depends on.

    A symbol at an end of its text depends on the end, so its range reaches beyond the text.
    """
    name, n = words.names, len(words.names)
    low = np.arange(n, dtype=np.int64)
    high = low + 1
    first = np.zeros(n, bool)
    first[words.docs[:-1][words.docs[:-1] < n]] = True

    def neighbours():
        """Ranges of the symbols to the left and right; beyond the ends, a place out of reach."""
        last = np.ones(len(name), bool)
        last[:-1] = first[1:]
        left = np.where(first, low - 1, np.concatenate([[0], low[:-1]]))
        right = np.where(last, high + 1, np.concatenate([high[1:], [0]]))
        return left, right

    for level in range(levels):
        if not len(name):
            break
        # Runs.
        left, right = neighbours()
        same = np.zeros(len(name), bool)
        same[1:] = (name[1:] == name[:-1]) & ~first[1:]
        heads = np.flatnonzero(~same)
        tails = np.concatenate([heads[1:], [len(name)]]) - 1
        run = (tails - heads + 1).astype(np.uint64)
        low, high = np.minimum(low[heads], left[heads]), np.maximum(high[tails], right[tails])
        name, first = name[heads], first[heads]
        name = np.where(run > 1, mixed(name * R2 + run), name)
        # Pairs.
        left, right = neighbours()
        side = (mixed(name + np.uint64(level + 1)) >> np.uint64(63)).astype(bool)
        opens = np.zeros(len(name), bool)
        opens[:-1] = ~side[:-1] & side[1:] & ~first[1:]
        closes = np.concatenate([[False], opens[:-1]])
        paired = np.concatenate([name[1:], name[:1]])
        ends = np.concatenate([high[1:], high[:1]])
        new_low = np.where(side & ~closes, np.minimum(low, left), low)
        new_high = np.where(opens, ends, np.where(~side, np.maximum(high, right), high))
        new_name = np.where(opens, mixed(name * R1 + mixed(paired * R2)), name)
        keep = ~closes
        name, low, high, first = new_name[keep], new_low[keep], new_high[keep], first[keep]
    return name, low, high


def _voters(words: Words, width: int, levels: int):
    name, low, high = recompress(words, levels)
    ok = high - low <= width
    # Names of symbols with ranges of other shapes are kept apart, so that equal keys mean equal
    # words in equal surroundings.
    return name[ok], low[ok], high[ok]


def _candidates(words: Words, low, high, shared, width: int) -> np.ndarray:
    """Whether each word starts a window without an unshared symbol."""
    n = len(words.names)
    change = np.zeros(n + 1, np.int64)
    a = np.maximum(high[~shared] - width, 0)
    b = low[~shared] + 1
    ok = (b > a) & (b <= n)
    np.add.at(change, a[ok], 1)
    np.add.at(change, b[ok], -1)
    return (np.cumsum(change[:n]) == 0) & words.windows(width)


def remove_repeats(
    docs: DataFrame, width: int = 35, levels: int = 5, with_text: bool = True
) -> DataFrame:
    """Per document: ``n_words``, ``n_removed``, the digest and (``with_text``) the kept words."""
    table, parts = B.bucketed(docs)
    grouped = table.groupBy("block")

    def symbols(words: Words):
        name, low, high = _voters(words, width, levels)
        distinct = B.Distinct(name)
        return low, high, distinct, list(B.split_keys(distinct.keys, parts))

    def asked_windows(words: Words, found: dict[int, np.ndarray]):
        """Windows to verify, their distinct hashes, and the parts that these go to."""
        low, high, distinct, placed = symbols(words)
        shared = distinct.spread(B.bits_of(len(distinct.keys), placed, found))
        asked = _candidates(words, low, high, shared, width)
        distinct = B.Distinct(rolling(words.names, width, R1)[asked])
        other = rolling(words.names, width, R2)[asked][distinct.first]
        return asked, distinct, list(B.split_keys(other, parts, turn=1))

    def send_symbols(block: pa.Table) -> pa.Table:
        key = block.column("block")[0].as_py()
        _, _, distinct, placed = symbols(Words(B.ordered(block)[1]))
        return B.payload_table([(key, p, distinct.keys[at].tobytes()) for p, at in placed])

    shared = B.answer(grouped.applyInArrow(send_symbols, B.PAYLOAD), B.repeated, "symbols")

    def send_windows(block: pa.Table, replies: pa.Table) -> pa.Table:
        if not block.num_rows:
            return B.payload_table([])
        key = block.column("block")[0].as_py()
        words = Words(B.ordered(block)[1])
        _, distinct, placed = asked_windows(words, B.unpack(replies))
        return B.payload_table([(key, p, distinct.keys[at].tobytes()) for p, at in placed])

    sent = grouped.cogroup(shared.groupBy("block")).applyInArrow(send_windows, B.PAYLOAD)
    replies = shared.unionByName(B.answer(sent, B.repeated, "repeats"))

    def cut(block: pa.Table, replies: pa.Table) -> pa.Table:
        ids, texts = B.ordered(block) if block.num_rows else (np.zeros(0, np.int64), [])
        words = Words(texts)
        found = B.unpack(replies)
        asked, distinct, placed = asked_windows(words, found)
        at = np.flatnonzero(asked)
        at = at[distinct.spread(B.bits_of(len(distinct.keys), placed, found))]
        change = np.zeros(len(words.names) + width + 1, np.int64)
        change[at] += 1
        change[at + width] -= 1
        gone = np.cumsum(change[: len(words.names)]) > 0
        digests, kept_texts, removed = [], [], []
        for a, b in zip(words.docs[:-1], words.docs[1:]):
            keep = np.flatnonzero(~gone[a:b]) + a
            spans = zip(words.starts[keep].tolist(), words.ends[keep].tolist())
            kept = b" ".join([words.data[s:e] for s, e in spans])
            digests.append(hashlib.sha256(kept).hexdigest())
            removed.append(int(b - a - len(keep)))
            if with_text:
                kept_texts.append(kept.decode())
        columns = {
            "doc_id": pa.array([None if i == B.NO_ID else int(i) for i in ids], pa.int64()),
            "n_words": pa.array(np.diff(words.docs), pa.int64()),
            "n_removed": pa.array(removed, pa.int64()),
            "kept_sha256": pa.array(digests, pa.string()),
        }
        if with_text:
            columns["kept_text"] = pa.array(kept_texts, pa.string())
        return pa.table(columns)

    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string"
    schema += ", kept_text string" if with_text else ""
    return grouped.cogroup(replies.groupBy("block")).applyInArrow(cut, schema)
