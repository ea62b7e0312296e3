"""The manifest against a plain tree, its witnesses, and odd tables."""

import hashlib
import zlib
from collections import defaultdict

import pytest

from riskloom.llm import merkle

SCHEMA = "doc_id long, source string, lang string, n_chars int, text string, pos long, tree string, root int"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def code(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def lower(text):
    return None if text is None else "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def tree(digests):
    """(root, per leaf: siblings, path)."""
    levels = [digests]
    while len(levels[-1]) > 1:
        now = levels[-1]
        levels.append([sha("".join(now[i : i + 8])) for i in range(0, len(now), 8)])
    out = []
    for at in range(len(digests)):
        siblings, path = [], []
        for level in levels[:-1]:
            run = level[at // 8 * 8 : at // 8 * 8 + 8]
            siblings += run[: at % 8] + run[at % 8 + 1 :]
            path += [at % 8, len(run) - 1]
            at //= 8
        out.append((siblings, path))
    return levels[-1][0], out


def brute(rows):
    trees = defaultdict(list)
    for r in rows:
        leaf = sha("".join(map(code, r[:5])))
        low = sha("".join(map(code, (*r[:4], lower(r[4])))))
        hit = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0
        trees[r[2]].append((r[0] is not None, r[0] or 0, leaf, r[0], low if hit else leaf))
    names = sorted(trees, key=lambda x: (x is not None, (x or "").encode()))
    done = {name: tree([x[2] for x in sorted(trees[name])]) for name in names}
    root, tops = tree([done[name][0] for name in names])
    out = []
    for name, (siblings_above, path_above) in zip(names, tops):
        for x, (siblings, path) in zip(sorted(trees[name]), done[name][1]):
            siblings, path = siblings + siblings_above, path + path_above
            cur, at = x[4], 0
            for place, count in zip(path[::2], path[1::2]):
                run = siblings[at : at + count]
                cur, at = sha("".join([*run[:place], cur, *run[place:]])), at + count
            out.append((x[3], x[2], done[name][0], root, sha("".join(siblings)), cur, cur == root, path))
    return out


def table(spark, rows):
    return spark.createDataFrame([(*r, 5, "clash", 1) for r in rows], SCHEMA).repartition(4)


def same(spark, rows, **options):
    got = sorted((tuple(r) for r in merkle.report(table(spark, rows), **options).collect()), key=str)
    assert got == sorted((r[:-1] for r in brute(rows)), key=str)


ODD = [
    (1, "a", "en", 3, "Abc"), (1, "a", "en", 3, "Abc"), (1, "a", "en", 3, "other"), (2, None, None, None, None),
    (None, "s", "en", 0, ""), (None, "s", "en", 0, ""), (None, "t", None, 1, "UP"), (3, "", "", 0, "Äß É UP"),
    (4, "x", "zz", -1, "LONG " * 50_000), (5, "x", "ö", 2, "\x00"), *((i, "s", "=q", 1, f"T{i}") for i in range(100, 173)),
]


def test_odd_rows(spark):
    same(spark, ODD)


@pytest.mark.parametrize("n", [1, 2, 7, 8, 9, 64, 65])
def test_sizes_around_the_fan(spark, n):
    same(spark, [(i, "s", "en", i, f"Text {i}") for i in range(n)])


def test_many_trees(spark):
    same(spark, [(i, "s", f"l{i % 70}", i, f"Text {i}") for i in range(150)])


def test_trees_beyond_a_block(spark):
    """Blocks of 64 leaves: three steps of blocks, last ones with single runs."""
    rows = [(i, "s", "en" if i % 9 else "fr", i, f"Text {i}") for i in range(4700)]
    assert max(len(r[-1]) for r in brute(rows)) == 2 * (5 + 1)
    same(spark, rows, block_levels=2)


def test_witnesses_lead_to_the_root(spark):
    rows = ODD[:1] + ODD[3:]
    for r in merkle.witnesses(table(spark, rows)).collect():
        siblings = [r.siblings[i : i + 64] for i in range(0, len(r.siblings), 64)]
        path = list(zip(r.path[::2], r.path[1::2]))
        assert merkle.fold(r.leaf, siblings, path) == r.root
        assert merkle.fold(sha("another"), siblings, path) != r.root


def test_a_witness_grows_as_siblings_are_completed():
    work, mine = merkle.OpenTree(2), merkle.Witness()
    work.append(sha("0"), mine)
    for i in range(1, 9):
        assert not mine.siblings
        work.append(sha(str(i)), merkle.Witness())
        if i == 7:
            break
    assert mine.siblings == [sha(str(i)) for i in range(1, 8)] and mine.path == [(0, 7)]
    work.append(sha("8"), merkle.Witness())
    root = work.finish()
    assert mine.path == [(0, 7), (0, 1)]
    assert merkle.fold(sha("0"), mine.siblings, mine.path) == root


def test_empty_table(spark):
    assert merkle.report(table(spark, ODD).limit(0)).count() == 0
