"""Strings made to have equal polynomial hashes modulo 2^64 stay apart in every operator."""

import brute
import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from riskloom.llm import jaccard, packing, recompression
from riskloom.llm.codes import report as codes_report
from riskloom.llm.names import names_of
from riskloom.llm.queries import QUERIES
from riskloom.llm.recompression import rolling
from riskloom.llm.sets import Similarity
from riskloom.llm.tokens import Encoder

assert QUERIES


def morse(n, zero="a", one="b"):
    """The first n letters of the Thue-Morse word."""
    return "".join(one if bin(i).count("1") % 2 else zero for i in range(n))


SIZES = (64, 1024, 2048, 8192)
PAIRS = [(morse(n), morse(n, "b", "a")) for n in SIZES]


def test_names_differ():
    strings = [s.encode() for pair in PAIRS for s in pair] + [b"a", b"b", b"ab", b"ba", b"a" * 255, b"a" * 257]
    data = b" ".join(strings)
    sizes = np.array([len(s) for s in strings])
    starts = np.cumsum(sizes + 1) - sizes - 1
    for turn in (0, 1):
        assert len(set(names_of(data, starts, sizes, turn).tolist())) == len(strings)
    assert (names_of(data, starts, sizes) != names_of(data, starts, sizes, 1)).all()


@pytest.mark.parametrize("width", [4, 5, 35, 1024, 2048])
def test_runs_of_names_differ(width):
    a, b = names_of(b"xy", np.array([0, 1]), np.array([1, 1]))
    word = np.array([a if c == "a" else b for c in morse(width)])
    other = np.array([b if c == "a" else a for c in morse(width)])
    base = np.uint64(0x9E3779B97F4A7C15)
    assert rolling(word, width, base)[0] != rolling(other, width, base)[0]
    twice = np.concatenate([word, other, word])
    hashes = rolling(twice, width, base)
    assert hashes[0] == hashes[2 * width] != hashes[width]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_encoder(name):
    path = public_tokenizers.path(name)
    texts = [s for pair in PAIRS for s in pair] + [f"x {a} {b} y" for a, b in PAIRS]
    plain = [e.ids for e in Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)]
    assert [x.tolist() for x in Encoder(path).encode([t.encode() for t in texts])] == plain


def docs_of(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(3)


def test_windows_of_words(spark):
    shared = " ".join(f"w{i}" for i in range(34))
    rows = [(i, f"{shared} {s}") for i, s in enumerate(s for pair in PAIRS for s in pair)]
    got = recompression.remove_repeats(docs_of(spark, rows)).collect()
    found = sorted((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got)
    assert found == sorted(brute.substring_dedup(rows)) and not any(r[2] for r in found)


def test_sets_of_words(spark):
    rows = [(i, f"x y {s}") for i, s in enumerate(s for pair in PAIRS for s in pair)]
    rows += [(20 + i, s) for i, (s, _) in enumerate(PAIRS)]
    got = jaccard.report(docs_of(spark, rows), Similarity(k=4, num=85)).collect()
    assert sorted(map(tuple, got)) == sorted(brute.jaccard_groups(rows))


def test_token_files_and_packs(spark):
    import zlib

    rows = [(i, s) for i, s in enumerate(s for pair in PAIRS for s in pair)]
    path = public_tokenizers.path("word_bpe_49k.json")
    ids = [np.array([*e.ids, 1], "<u4") for e in Tokenizer.from_file(path).encode_batch([t for _, t in rows], add_special_tokens=False)]
    got = {r.doc_id: r.ids_crc32 for r in codes_report(docs_of(spark, rows), path).collect()}
    assert got == {i: zlib.crc32(x.tobytes()) for i, x in enumerate(ids)}
    whole = {i: x for i, x in enumerate(ids)}
    for p in packing.pack(docs_of(spark, rows), path).collect():
        assert p.ids_crc32 == zlib.crc32(whole[p.doc_id][p.start : p.start + p.length].tobytes())
