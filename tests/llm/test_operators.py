"""Each operator against a plain version on the smallest data set and on odd rows."""

import re
import zlib
from collections import defaultdict

import brute
import duckdb
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from riskloom.llm import (
    codes,
    decontamination,
    jaccard,
    packing,
    quality,
    recompression,
    secret_scan,
    sharding,
    suffixes,
    url_filters,
)
from riskloom.llm.queries import QUERIES
from riskloom.llm.sql import ORACLES
from riskloom.llm.tokens import Encoder

BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
LONG = " ".join(f"w{i % 97} x{i % 89}," for i in range(6000))
NEAR = " ".join(f"a{i}" for i in range(200))
ODD = [
    (1, None), (2, ""), (3, "  \n\t"), (4, "one"), (5, "one two three"), (6, "one two three"),
    (7, LONG), (8, LONG), (8, LONG), (9, "z " * 400), (None, NEAR), (None, NEAR), (10, NEAR),
    (11, NEAR + " changed"), (12, "Zu Äpfeln ÀÉ é " * 30), (13, NEAR.upper()), (14, "token token: secret=abc"),
    (15, "api_key = 'abcdef123' AKIA" + "Z" * 16 + " 0123456789abcdef01234567 <|endoftext|>  x"),
    (16, "cut " + NEAR[50:400] + " end"), (17, "ab" * 300),
]


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty, long, equal and repeated rows, and extra columns whose names clash."""
    rows = [(i, t, 0, i, "k", 1.5, None) for i, t in ODD]
    schema = "doc_id long, text string, n_chars int, id long, key string, row double, tag string"
    return spark.createDataFrame(rows, schema).repartition(3)


@pytest.fixture(scope="module")
def empty(odd):
    return odd.where("doc_id = -1")


@pytest.fixture(scope="module")
def documents(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    return rows


def got(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=str)


def same(df, columns, wanted):
    assert got(df, *columns) == sorted(wanted, key=str)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for table in ("documents", "benchmark", "pages"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{sf_dir}/{table}.parquet')")
    rows = con.execute(ORACLES[name])
    columns = [c[0] for c in rows.description]
    df = QUERIES[name](spark, sf_dir)
    assert sorted(columns) == sorted(df.columns)
    same(df, columns, rows.fetchall())


SUBSTRING = ("doc_id", "n_words", "n_removed", "kept_sha256")
SUFFIX = ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
GROUPS = ("doc_id", "n_shingles", "component_id")


def test_substring_dedup(spark, sf_dir, documents, odd, empty):
    same(QUERIES["op6_substring_dedup"](spark, sf_dir), SUBSTRING, brute.substring_dedup(documents))
    same(recompression.remove_repeats(odd), SUBSTRING, brute.substring_dedup(ODD))
    assert recompression.remove_repeats(empty).count() == 0


def test_suffix_dedup(spark, sf_dir, documents, odd, empty):
    same(QUERIES["op10_suffix_arrays"](spark, sf_dir), SUFFIX, brute.suffix_dedup(documents))
    same(suffixes.remove_repeats(odd), SUFFIX, brute.suffix_dedup(ODD))
    assert suffixes.remove_repeats(empty).count() == 0


@pytest.mark.parametrize("operator", [recompression, suffixes])
def test_a_block_sends_a_key_once(spark, monkeypatch, operator):
    """Copies and near copies of one text: a hot key does not grow with their number."""
    rows = [(i, NEAR[:300] + (f" end{i}" if i % 2 else "")) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    plain, most = operator.B.answer, []

    def answer(payloads, judge, name):
        for r in payloads.collect():
            keys = operator.B.np.frombuffer(r.payload, np.uint64)
            if operator is suffixes:
                keys = suffixes._receive([bytes(r.payload)])[0]
            most.append(np.unique(keys, return_counts=True)[1].max())
        return plain(payloads, judge, name)

    monkeypatch.setattr(operator.B, "answer", answer)
    if operator is suffixes:
        same(suffixes.remove_repeats(docs), SUFFIX, brute.suffix_dedup(rows))
    else:
        same(recompression.remove_repeats(docs), SUBSTRING, brute.substring_dedup(rows))
    assert most and max(most) <= (2 if operator is suffixes else 1)


def test_suffix_array_order():
    raw = np.frombuffer(b"banana" * 20 + b"band" + b"banana" * 9, np.uint8)
    order = suffixes.suffix_array(suffixes.packed(raw), 64)
    wanted = sorted(range(len(raw)), key=lambda i: raw[i : i + 64].tobytes())
    assert [raw[i : i + 64].tobytes() for i in order] == [raw[i : i + 64].tobytes() for i in wanted]


def test_jaccard(spark, sf_dir, documents, odd, empty):
    same(QUERIES["op5_jaccard_join"](spark, sf_dir), GROUPS, brute.jaccard_groups(documents))
    for k, num in ((4, 85), (2, 50)):
        sim = jaccard.Similarity(k=k, num=num)
        same(jaccard.report(odd, sim), GROUPS, brute.jaccard_groups(ODD, k, num))
    assert jaccard.report(empty, jaccard.Similarity()).count() == 0
    kept = jaccard.keep_one(odd, jaccard.Similarity(k=4, num=85))
    assert kept.columns == odd.columns
    ids = [r.doc_id for r in kept.collect()]
    assert ids.count(8) == 0 and ids.count(7) == 1 and None not in ids and {1, 2, 3, 10} <= set(ids)


def test_rows_without_copies_stay_out_of_the_joins(spark, monkeypatch):
    """One document of each group stays; rows without a copy meet no list of rows to drop."""
    alone = [(i, " ".join(f"t{i}x{j}" for j in range(30)), i) for i in range(1000)]
    copies = [(5000 + i, f"{NEAR} {i}", i) for i in range(5)] + [alone[3], alone[3][:2] + (9,), (None, NEAR, 1)]
    docs = spark.createDataFrame(alone + copies, "doc_id long, text string, n int")
    plain, asked = jaccard.with_marks, []

    def with_marks(*args):
        out = plain(*args)
        asked.append(out.where(args[-1]).count())
        return out

    monkeypatch.setattr(jaccard, "with_marks", with_marks)
    kept = jaccard.keep_one(docs, jaccard.Similarity())
    ids = got(kept, "doc_id")
    assert len(ids) == 1001 and ids.count((3,)) == 1 and asked and asked[0] < 30
    smallest = min((r.doc_id for r in docs.where("n < 9 AND doc_id >= 5000").collect()))
    assert {(i,) for i in range(1000)} <= set(ids) and set(ids) - {(i,) for i in range(1000)} <= {(smallest,), (None,)}


def test_small_sets_link_by_subsets(spark):
    base = [f"w{i}" for i in range(16)]
    docs = [(i, " ".join(base[: 3 + i % 6] + [f"u{i}"] * (i % 3 == 0))) for i in range(30)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    sim = jaccard.Similarity(k=1, num=80)
    assert jaccard.boundary({5: 10, 6: 10, 7: 9}, sim) > 0
    same(jaccard.report(df, sim), GROUPS, brute.jaccard_groups(docs, 1, 80))


def base_row(doc_id, text):
    spans = brute.base_secrets(text)
    counts = [sum(s[2] == kind for s in spans) for kind in secret_scan.BASE_KINDS]
    return (doc_id, *counts, brute.sha(",".join(f"{k}:{a}:{b}" for a, _, k, b in spans).encode()))


def test_secrets(spark, sf_dir, documents, odd, empty, tmp_path):
    columns = ("doc_id", "n_assign", "n_access", "n_hex", "base_sha256")
    same(QUERIES["op8_secret_scans"](spark, sf_dir), columns, [base_row(*d) for d in documents])
    ledger = secret_scan.Ledger(str(tmp_path / "ledger"))
    same(secret_scan.report(odd, ledger), columns, [base_row(*d) for d in ODD])
    scanned = ledger.scanned(spark).count()
    secret_scan.report(odd, ledger).count()
    assert ledger.scanned(spark).count() == scanned == len({t or "" for _, t in ODD})
    assert secret_scan.report(empty).count() == 0
    clean = {r.doc_id: r.text for r in secret_scan.redact(odd).where("doc_id > 13").collect()}
    assert "AKIA" not in clean[15] and "abcdef123" not in clean[15] and clean[15].endswith("x")
    assert clean[16] == ODD[-2][1] and clean[17] == "[REMOVED]"


def test_redact_leaves_no_line_of_a_key(spark):
    def pem(lines, name="RSA PRIVATE KEY", joint="\n", fields=(), end=True):
        last = [f"-----END {name}-----"] * end
        return joint.join([f"-----BEGIN {name}-----", *fields, *lines, *last])

    body = [f"MIIE{i:02}/+" + "Ab1z" * 14 for i in range(8)] + ["Qx9Yw=="]
    fields = ("Proc-Type: 4,ENCRYPTED", "DEK-Info: AES-128-CBC,0A1B2C3D", "")
    keys = [
        pem(body),
        pem(body, "OPENSSH PRIVATE KEY", fields=fields),
        pem(body, "PGP PRIVATE KEY BLOCK"),
        pem(body, "PRIVATE KEY", joint="\\n"),
        pem(body, "EC PRIVATE KEY", joint="\r\n  "),
        pem(body, end=False),
        pem(body, fields=fields, end=False),
        pem(body, joint="\n> ", end=False),
        pem(body[:-1] * 20_000 + body[-1:]),
        pem(body[:-1] * 20_000 + body[-1:], end=False),
    ]
    cert = pem(["MIICert" * 9], "CERTIFICATE")
    texts = [f"Before.\n{k}\nAfter it, prose." for k in keys]
    texts += [f"Before.\n{keys[5]}\n{keys[0]}\nAfter it, prose.", f"Before.\n{keys[5]}\n{cert}"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    clean = {r.doc_id: r.text for r in secret_scan.redact(df).collect()}
    for i in range(len(keys)):
        assert clean[i] == "Before.\n[REMOVED]\nAfter it, prose.", (i, clean[i][:300])
    assert clean[len(keys)] == "Before.\n[REMOVED]\n[REMOVED]\nAfter it, prose."
    assert clean[len(keys) + 1] == f"Before.\n[REMOVED]\n{cert}"
    spans = {r.doc_id: r.spans for r in secret_scan.report(df).collect()}
    assert f"private_key:8:{8 + len(keys[0])}" in spans[0].split(",")


def test_quality(odd, empty):
    rows = {r.doc_id: r for r in quality.measure(odd).collect() if r.doc_id}
    assert rows[1].n_words == rows[2].n_words == rows[3].n_words == 0 and rows[1].base_failed
    assert rows[9].n_repeat_words == 400 and rows[12].n_words == 120
    assert quality.measure(empty).count() == 0
    assert quality.clean(odd).columns == odd.columns


def test_decontamination(spark, odd, empty):
    items = spark.createDataFrame(
        [(1, NEAR[:100]), (2, None), (3, ""), (None, "one two THREE"), (4, "no such words here")],
        "item_id long, text string",
    )
    rows = defaultdict(list)
    for r in decontamination.report(odd, items).collect():
        rows[r.doc_id].append(r)
    assert sum(map(len, rows.values())) == len(ODD)
    assert [rows[i][0].n_hit for i in (1, 2, 3, 4, 5, 6)] == [0, 0, 0, 0, 3, 3]
    assert rows[13][0].contaminated and rows[11][0].n_items == 1 and not rows[7][0].contaminated
    assert decontamination.report(empty, items).count() == 0
    assert decontamination.report(odd, items.where("item_id = 9")).where("contaminated").count() == 0
    assert 13 not in [r.doc_id for r in decontamination.drop_contaminated(odd, items).collect()]


def test_few_postings_meet_the_candidates(spark, monkeypatch):
    """Texts made of an item's words, which hardly ever hold its passage, stay out of the joins."""
    passage = " ".join(f"w{i}" for i in range(12))
    common = " ".join(f"w{i % 11}" for i in range(120, 0, -1))
    rows = [(i, f"{common} {passage}" if i % 100 == 0 else common) for i in range(400)]
    docs = spark.createDataFrame([*rows, rows[0], (None, passage)], "doc_id long, text string")
    items = spark.createDataFrame([(1, passage)], "item_id long, text string")
    plain, met = decontamination._posted, []

    def posted(wanted, postings):
        met.append(postings.count())
        return plain(wanted, postings)

    monkeypatch.setattr(decontamination, "_posted", posted)
    found = decontamination.report(docs, items).where("contaminated")
    same(found, ("doc_id", "n_words", "n_hit"), [(i, 132, 12) for i in (0, 0, 100, 200, 300)] + [(None, 12, 12)])
    # Of 48,000 postings: the second terms', which are rare, and those of the texts with candidates.
    assert len(met) == 2 and met[1] < 1_000


def test_proximity(spark):
    docs = spark.createDataFrame([(1, "red x x blue x green"), (2, "red " + "x " * 9 + "blue green")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "green red blue")], "item_id long, text string")
    windows = decontamination.windows_of(items, 10).dropDuplicates(["window"]).select("window", "words")
    terms = decontamination.vocabulary(windows)
    index = decontamination.build_index(docs, terms)
    found = decontamination.find_near(index, windows, terms, 5).collect()
    assert {r.doc_id for r in found} == {1}


def test_url_filter_is_as_of(spark):
    changes = spark.createDataFrame(
        [("b.c", "ads", 5, "add"), ("b.c", "ads", 9, "remove"), ("a.b.c/x", "bad", 1, "add"), (None, "ads", 1, "add")],
        "key string, category string, day int, action string",
    )
    urls = [("http://a.b.c/y", 4), ("http://a.b.c/y", 5), ("http://a.b.c/y", 9), ("http://A.b.c./x/z", 2), (None, 5), ("", 5), ("c", None)]
    captures = spark.createDataFrame(urls, "url string, day int").withColumn("host", F.lit(1))
    rows = url_filters.judge(captures, changes).collect()
    seen = {(r.row.url, r.row.day): r.categories for r in rows}
    assert len(rows) == 7 and seen[urls[1]] == ["ads"] and seen[urls[3]] == ["bad"]
    assert all(seen[urls[i]] == [] for i in (0, 2, 4, 5, 6))


def test_encoder_is_exact(documents):
    texts = [t or "" for _, t in documents + ODD] + ["a  b\x1c c", "don't!! it's,x ", "e ́a b"]
    for name in ("byte_bpe_50k.json", "word_bpe_49k.json"):
        path = public_tokenizers.path(name)
        plain = [e.ids for e in Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)]
        assert [x.tolist() for x in Encoder(path).encode([t.encode() for t in texts])] == plain


def plain_ids(rows, name):
    found = Tokenizer.from_file(public_tokenizers.path(name)).encode_batch(
        [t or "" for _, t in rows], add_special_tokens=False
    )
    return [np.array([*e.ids, 1], "<u4") for e in found]


def test_codes_round_trip(spark, sf_dir, documents, empty):
    order = sorted(documents)
    wanted, at = [], 0
    for (doc_id, _), ids in zip(order, plain_ids(order, "word_bpe_49k.json")):
        wanted.append((doc_id, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    same(QUERIES["op9_token_codes"](spark, sf_dir), ("doc_id", "start", "n_tokens", "ids_crc32"), wanted)
    assert codes.report(empty, BYTE_BPE).count() == 0


def test_codes_random_access():
    ids = np.random.default_rng(1).choice([3, 255, 256, 70_000, 2**31], 5_000).astype(np.uint32)
    levels, bitmaps, ranks = codes.pack(ids)
    assert codes.unpack(levels, bitmaps).tolist() == ids.tolist()
    assert [codes.token_at(levels, bitmaps, ranks, i) for i in range(5_000)] == ids.tolist()


@pytest.mark.parametrize("source", ["documents", "odd"])
def test_packing(request, spark, documents, source):
    rows = documents if source == "documents" else ODD
    df = spark.createDataFrame(rows, "doc_id long, text string")
    pieces = packing.pack(df, BYTE_BPE).collect()
    total = sum(map(len, plain_ids(rows, "byte_bpe_50k.json")))
    windows = defaultdict(list)
    for p in pieces:
        windows[p.sequence_id].append(p)
    for pack in windows.values():
        at = 0
        for p in sorted(pack, key=lambda p: p.offset):
            assert p.offset == at and p.length > 0
            at += p.length
        assert at <= 2048 and (at == 2048 or at & (at - 1) == 0)
    assert sum(p.length for p in pieces) == total
    if source == "documents":
        ids = {d[0]: x for d, x in zip(rows, plain_ids(rows, "byte_bpe_50k.json"))}
        for p in pieces:
            piece = ids[p.doc_id][p.start : p.start + p.length]
            assert p.ids_crc32 == zlib.crc32(piece.tobytes()) and p.doc_tokens == len(ids[p.doc_id])


def test_sharding(spark, sf_dir, documents, odd, empty):
    rows = QUERIES["op7_sharding"](spark, sf_dir).collect()
    texts = dict(documents)
    shards = defaultdict(list)
    for r in rows:
        data = (texts[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32) == (len(data) + 8, zlib.crc32(data))
        shards[r.shard].append(r)
    assert all(sorted(r.slot for r in s) == list(range(len(s))) for s in shards.values())
    assert sharding.assign(odd).count() == len(ODD) and sharding.assign(empty).count() == 0


def test_sharding_keeps_groups_whole(spark, sf_dir, documents):
    texts = dict(documents)
    shards_of = defaultdict(set)
    for r in QUERIES["op7_sharding"](spark, sf_dir).collect():
        shards_of[texts[r.doc_id] or ""].add(r.shard)
    group = defaultdict(lambda: np.zeros(3))
    for text in (t or "" for t in texts.values()):
        group[text] += (len(text.encode()) + 8, len(re.findall(r"[^\x20\x09-\x0D]+", text)), 1)
    quarter = sum(group.values()) / 24 / 4
    whole = [t for t, v in group.items() if v[2] > 1 and (v <= quarter).all()]
    assert whole and all(len(shards_of[t]) == 1 for t in whole)

    # Copies of a short text: groups below a quarter of a shard stay whole, a huge one is spread out.
    copies = [(i, f"copy of {i % 200}") for i in range(1_200)] + [(i, "hot") for i in range(1_200, 2_400)]
    df = spark.createDataFrame(copies, "doc_id long, text string").repartition(4)
    rows = sharding.assign(df, shards=8).collect()
    name = dict(copies)
    used = defaultdict(lambda: defaultdict(int))
    for r in rows:
        used[name[r.doc_id]][r.shard] += 1
    hot = used.pop("hot")
    assert len(used) == 200 and all(len(s) == 1 for s in used.values())
    sizes = [sum(u[k] for u in used.values()) + hot[k] for k in range(8)]
    assert len(hot) == 8 and max(hot.values()) < 1_200 / 3
    assert max(sizes) < 1.15 * len(rows) / 8


def test_pipeline_stages(spark, sf_dir):
    """Each stage on what its predecessor kept, against plain versions."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns = docs.columns
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = corpus_pipeline.materialise(stage(spark, docs, sf_dir), name)
        kept[name] = (before, docs)
        assert name == "packing" or docs.columns == columns
    before, after = kept["near_duplicates"]
    groups = brute.jaccard_groups([(r.doc_id, r.text) for r in before.collect()], 5, 80)
    assert {r.doc_id for r in after.collect()} == {d for d, n, c in groups if d == c}
    before, after = kept["benchmark_decontamination"]
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    dirty = {r.doc_id for r in decontamination.report(before, items).where("contaminated").collect()}
    assert {r.doc_id for r in after.collect()} == {r.doc_id for r in before.collect()} - dirty
    before, after = kept["secret_scans"]
    assert before.count() == after.count()
    assert not any(re.search("AKIA[A-Z0-9]{16}", r.text) for r in after.collect())
    before, after = kept["packing"]
    assert {r.doc_id for r in after.collect()} == {r.doc_id for r in before.collect()}
