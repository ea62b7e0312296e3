"""Fill-in-middle against a plain version, whole outputs and odd rows."""

import hashlib
import re

import pytest
from pyspark.sql import functions as F

from riskloom.llm import infilling

ROWS = [
    (1, None), (2, ""), (3, " "), (4, "word"), (5, "two words"), (6, "two words"), (6, "two words"),
    (7, "has <M> inside"), (8, "Zu Äpfeln 日本語 \x00 é " * 300), (9, "a" * 200_000),
    (10, "x, " * 30_000), (None, "no id at all, here"), (None, "no id at all, here"), (11, "<<P" * 50),
    (12, "S> tail <"), (13, "line\n\tline\r\n" * 9), *((i, f"text {i}, of <some> length " * (i % 7)) for i in range(20, 90)),
]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def brute(doc_id, text):
    text = text or ""
    units = re.findall("[A-Za-z]+|[^A-Za-z]", text)
    h = sha(f"1:{'' if doc_id is None else doc_id}")
    h1, h2, h3, h4 = (int(h[i : i + 8], 16) for i in (0, 8, 16, 24))
    n = len(units)
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return doc_id, n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    if h4 % 100 < 20:
        return doc_id, n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return doc_id, n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "clash", 1.0, i, "x") for i, t in ROWS]
    schema = "doc_id long, text string, form string, uid double, place long, piece string"
    return spark.createDataFrame(rows, schema).repartition(5)


COLUMNS = ["doc_id", "n", "form", "prefix_chars", "middle_chars"]


def test_report_equals_the_plain_version(docs):
    found = infilling.report(docs).collect()
    got = sorted((tuple(r[c] for c in COLUMNS) + (r.output_sha256, r.restored_sha256) for r in found), key=str)
    want = sorted(((*brute(i, t)[:5], sha(brute(i, t)[5]), sha(t or "")) for i, t in ROWS), key=str)
    assert got == want
    assert {r[2] for r in got} == {"plain", "psm", "spm"}


def test_whole_outputs_and_their_restoration(docs):
    out = infilling.outputs(docs)
    got = sorted((tuple(r) for r in out.select(*COLUMNS, "output").collect()), key=str)
    assert got == sorted((brute(i, t) for i, t in ROWS), key=str)
    back = out.select("doc_id", infilling.restored(F.col("output"), F.col("form")).alias("text"))
    assert sorted(map(tuple, back.collect()), key=str) == sorted(((i, t or "") for i, t in ROWS), key=str)


def test_pieces_are_bounded_and_hold_whole_units(docs):
    made = infilling.pieces(docs)
    assert made.agg(F.max(F.octet_length("piece"))).first()[0] <= infilling.PIECE_BYTES
    longest = made.where("doc_id = 10").select("uid").first().uid
    parts = made.where(f"uid = {longest} AND place >= 0").orderBy("place").collect()
    assert len(parts) > 20 and b"".join(r.piece for r in parts).decode() == brute(10, "x, " * 30_000)[5]


def test_other_shares_and_seeds(spark):
    docs = spark.createDataFrame([(i, "some words here") for i in range(400)], "doc_id long, text string")
    forms = lambda **o: {r.form: r["count"] for r in infilling.report(docs, **o).groupBy("form").count().collect()}
    assert forms(plain_from=0) == {"plain": 400}
    assert forms(plain_from=100, spm_below=100) == {"spm": 400}
    assert forms(seed=1) != forms(seed=2)


def test_empty_table_and_other_id_types(spark, docs):
    assert infilling.report(docs.limit(0)).count() == 0
    assert infilling.outputs(docs.limit(0)).count() == 0
    small = spark.createDataFrame([(4, "word")], "doc_id int, text string")
    assert infilling.report(small).first().restored_sha256 == sha("word")
