r"""n-gram Jaccard join: light sets by subsets, heavy sets by inverted lists.

Two documents link when ``den * |A & B| >= num * |A | B|`` over their sets of ``k``-word shingles.
For sizes a and b that needs an overlap of at least ``need(a, b) = ceil(num (a + b) / (num + den))``.

- Documents with equal sets are one node, known by a 64-bit hash of the set and its size.
- *Light* sets, up to a boundary, enumerate their subsets of exactly ``need(a, b)`` shingles for every
  partner size b; two light sets link if and only if they share one.
- *Heavy* sets post their shingles to inverted lists, rarest first and only as many as any partner
  must hit; a light set joins the lists if its size can match a heavy one. Rarity is a count over
  all documents, kept in hashed counters whose number grows with the text up to a bound: any order
  is right, a good one keeps passages that many documents share out of the lists.
- The boundary is the one that makes keys and (dearer) postings cheapest, from the counts of sizes.

Lists are read in the order of size. Each member is first compared with the hub of its stretch (the
first set whose size still fits), which connects groups of near copies with one comparison a member;
a few more rounds draw other hubs for the lists that still hold several components. Then, exactly, every pair of a list whose members are still in different components and whose sizes,
places and parities allow the overlap is compared. (A set's parities are 512 bits, each flipped by
the shingles of one hash class: two sets differ in at least as many shingles as parities.) Sets of a
pair are built again from the whole texts, so hashes of lists never decide a link.

Defined cases: a null or empty text has no set and links with nothing; fewer words than ``k`` make
one shingle; equal rows and null ids are rows of their own, a component of null ids alone has a null
id. Extra columns are not read.
"""

import zlib
from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm import blocks as B
from riskloom.llm.graph import components
from riskloom.llm.marks import with_marks
from riskloom.llm.names import R2, R3, mixed
from riskloom.llm.sets import PARITIES, PARITY, Similarity, marked, near, parities, pieces, shingle_sets, verify
from riskloom.llm.sets import rows as rows_of
from riskloom.storage import materialise, scratch

#: Bytes of text per counter, the fewest and the most counters (a byte each: 32 MB to every task).
BYTES_PER_COUNTER, FEWEST, MOST = 32, 1 << 20, 1 << 25
CHUNK = 1 << 14
#: Largest boundary that is considered; subsets of larger sets are never fewer than their postings.
MAX_LIGHT = 24
#: What a list entry costs beside a subset key: it meets hubs, and pairs of other sets.
POSTING_COST = 4
POSTING_ROWS = 1 << 19
#: Further rounds of hubs, drawn anew, before all pairs that are still apart are compared.
HUB_ROUNDS = 2


def signature(shingles: np.ndarray) -> int:
    """A hash of a set; its size is kept beside it."""
    with np.errstate(over="ignore"):
        return int(mixed(mixed(shingles ^ R3).sum(dtype=np.uint64).reshape(1)).astype(np.int64)[0])


def counters_for(size: int) -> int:
    """How many counters suit so many bytes of text: whole chunks."""
    return min(MOST, max(FEWEST, -(-size // BYTES_PER_COUNTER // CHUNK) * CHUNK))


def _signatures(rows: DataFrame, k: int, counters: int) -> tuple[DataFrame, DataFrame]:
    """(id, tag, n, fp, p0, p1 ...) of each row, and counters (chunk, counts) of all shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(counters, np.uint16)
        for batch in batches:
            for part in pieces(batch):
                sets = shingle_sets(part.column("text").to_pylist(), k)
                if sets:
                    place = np.concatenate(sets) % np.uint64(counters)
                    held, many = np.unique(place.astype(np.uint32), return_counts=True)
                    counts[held] = np.minimum(counts[held] + many, 255)
                n = part.num_rows
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("id"),
                        part.column("tag"),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array([signature(s) for s in sets], pa.int64()),
                        *map(pa.array, np.array([parities(s) for s in sets]).reshape(n, -1).T),
                        pa.nulls(n, pa.int32()),
                        pa.nulls(n, pa.binary()),
                    ],
                    _SIGNED,
                )
        chunks = counts.astype(np.uint8).reshape(-1, CHUNK)
        held = np.flatnonzero(chunks.any(axis=1))
        for some in np.array_split(held, max(1, len(held) // 64)):
            n = len(some)
            yield pa.RecordBatch.from_arrays(
                [pa.nulls(n, pa.int64())] * (4 + PARITIES)
                + [pa.array(some, pa.int32()), pa.array([_squeezed(chunks[c]) for c in some], pa.binary())],
                _SIGNED,
            )

    schema = ", ".join(f"{c} long" for c in _SIGNED[:-2]) + ", chunk int, counts binary"
    table = materialise(rows.mapInArrow(run, schema), "signatures")
    return table.where("chunk IS NULL").drop("chunk", "counts"), table.where("chunk IS NOT NULL")


_SIGNED = ["id", "tag", "n", "fp", *(f"p{i}" for i in range(PARITIES)), "chunk", "counts"]


def _squeezed(counts: np.ndarray) -> bytes:
    return zlib.compress(counts.tobytes(), 1)


def _counters(chunks: DataFrame, counters: int) -> np.ndarray:
    """The summed counters, up to 255 each. A task adds up those of one chunk, one after the other."""

    def add(table: pa.Table) -> pa.Table:
        total = np.zeros(CHUNK, np.uint64)
        for x in table.column("counts"):
            total += np.frombuffer(zlib.decompress(x.as_py()), np.uint8)
        small = np.minimum(total, 255).astype(np.uint8)
        return pa.table({"chunk": table.column("chunk")[:1], "counts": [_squeezed(small)]})

    out = np.zeros(counters, np.uint8)
    summed = chunks.select("chunk", "counts").groupBy("chunk").applyInArrow(add, "chunk int, counts binary")
    for chunk, counts in summed.collect():
        out[chunk * CHUNK : (chunk + 1) * CHUNK] = np.frombuffer(zlib.decompress(counts), np.uint8)
    return out


def light_sizes(n: int, light: int, sim: Similarity) -> list[tuple[int, int]]:
    """(smaller, larger) for every light partner size of a light set of size ``n``."""
    sizes = range(sim.smallest_partner(n), light + 1)
    return [(min(n, b), max(n, b)) for b in sizes if sim.fits(min(n, b), max(n, b))]


def boundary(counts: dict[int, int], sim: Similarity) -> int:
    """The boundary for which light keys and heavy postings together cost least."""

    def cost(light: int) -> int:
        keys = sum(
            c * sum(comb(n, sim.need(a, b)) for a, b in light_sizes(n, light, sim))
            for n, c in counts.items()
            if 0 < n <= light
        )
        least = sim.smallest_partner(light + 1)
        return keys + POSTING_COST * sum(c * sim.prefix(n) for n, c in counts.items() if n >= least)

    return min(range(MAX_LIGHT + 1), key=lambda light: (cost(light), -light))


def _postings(rows: DataFrame, sim: Similarity, light: int, counters: np.ndarray) -> DataFrame:
    """(key, fp, n, place): list entries of heavy sets and subset keys of light ones (place -1)."""
    shared = rows.sparkSession.sparkContext.broadcast(counters)
    least = sim.smallest_partner(light + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = shared.value
        held = np.uint64(len(counts))
        seen: set[int] = set()
        for batch in batches:
            for part in pieces(batch):
                keys, fps, sizes, places = [], [], [], []

                def post(values: np.ndarray, fp: int, n: int, place: np.ndarray) -> None:
                    keys.append(values)
                    fps.append(np.full(len(values), fp, np.int64))
                    sizes.append(np.full(len(values), n, np.int32))
                    places.append(place)

                for shingles in shingle_sets(part.column("text").to_pylist(), sim.k):
                    n, fp = len(shingles), signature(shingles)
                    if not n or fp in seen:  # one entry for copies that a task meets
                        continue
                    if len(seen) > 500_000:
                        seen.clear()
                    seen.add(fp)
                    if n >= least:
                        df = counts[(shingles % held).astype(np.int64)]
                        first = np.lexsort((shingles, df))[: sim.prefix(n)]
                        post(shingles[first], fp, n, np.arange(len(first), dtype=np.int32))
                    if n <= light:
                        for a, b in light_sizes(n, light, sim):
                            subsets = np.array(list(combinations(shingles.tolist(), sim.need(a, b))), np.uint64)
                            key = np.full(len(subsets), 64 * a + b, np.uint64)
                            for column in subsets.T:
                                key = mixed(key * R2 + column)
                            post(key, fp, n, np.full(len(key), -1, np.int32))
                if keys:
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(np.concatenate(keys).astype(np.int64)),
                            pa.array(np.concatenate(fps)),
                            pa.array(np.concatenate(sizes)),
                            pa.array(np.concatenate(places)),
                        ],
                        ["key", "fp", "n", "place"],
                    )

    return rows.mapInArrow(run, "key long, fp long, n int, place int")


def _lists(postings: DataFrame, sim: Similarity, parts: int) -> DataFrame:
    """Members of lists of two sets or more whose sizes fit, each with the hub of its stretch; written.

    A task reads its lists in order and holds one hub, so a list may have any length.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hub = None  # key, fp, n, place
        last = None
        for batch in batches:
            key, fp, n, place = (batch.column(i).to_numpy() for i in range(4))
            # Only rows beside another one of the same key matter.
            same = np.zeros(len(key), bool)
            same[1:] = key[1:] == key[:-1]
            same[:-1] |= same[1:]
            if len(key):
                same[0] |= hub is not None and key[0] == hub[0]
                same[-1] = True
            out = []
            at = np.flatnonzero(same)
            for x in zip(key[at].tolist(), fp[at].tolist(), n[at].tolist(), place[at].tolist()):
                if last is not None and x[:2] == last[:2]:
                    continue  # the same set, from another task
                before, last = last, x
                # Sizes grow along a list: a set too large for the one before fits none before it.
                if before is None or x[0] != before[0] or not sim.fits(before[2], x[2]):
                    hub = x
                    continue
                out.append((*x, *hub[1:]))
                if not sim.fits(hub[2], x[2]):
                    hub = x
            columns = list(zip(*out)) or [[] for _ in range(7)]
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int32()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, kinds)],
                ["key", "fp", "n", "place", "hub", "hub_n", "hub_place"],
            )

    schema = "key long, fp long, n int, place int, hub long, hub_n int, hub_place int"
    dealt = postings.repartition(parts, "key").sortWithinPartitions("key", "n", "fp")
    return materialise(dealt.mapInArrow(run, schema), "lists")


def _possible(a_n: str, a_place: str, b_n: str, b_place: str, sim: Similarity) -> str:
    """SQL: sizes fit (a <= b), and from these places on there is room for the overlap.

    Both hold for the first shingle that a linked pair has in common. Subset keys have no place.
    """
    need = f"ceil({sim.num} * ({a_n} + {b_n}) / {sim.num + sim.den})"
    room = f"least({a_n} - {a_place}, {b_n} - {b_place}) >= {need}"
    return f"{sim.den} * {a_n} >= {sim.num} * {b_n} AND {room}"


def _hub_pairs(lists: DataFrame, nodes: DataFrame, sim: Similarity) -> DataFrame:
    """Pairs (a, b) of a member and a hub that sizes and parities allow; written.

    This only saves comparisons, so places need not rule a pair out where parities can: a hub whose
    shingle comes late in its own order still connects the group. Where sets are so large that
    unlike ones pass the parities, places decide.
    """
    both = "(hub_n + n)"
    clear = f"4 * ({both} - 2 * ceil({sim.num} * {both} / {sim.num + sim.den})) < {64 * PARITIES}"
    fits = f"{sim.den} * hub_n >= {sim.num} * n"
    places = _possible("hub_n", "hub_place", "n", "place", sim)
    met = lists.where(f"{fits} AND ({clear} OR {places})").select("hub", "fp").distinct()
    x = nodes.select("fp", "n", *PARITY)
    allowed = (
        met.select(F.col("hub").alias("a"), F.col("fp").alias("b"))
        .join(x.withColumnRenamed("fp", "a").alias("s"), "a")
        .join(x.withColumnRenamed("fp", "b").alias("t"), "b")
        .where(near("s", "t", sim))
    )
    order = [F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")]
    return materialise(allowed.select(*order).distinct(), "pairs")


def _open_lists(members: DataFrame, nodes: DataFrame, labels: DataFrame) -> DataFrame:
    """Members, with their component's label and parities, of the lists that hold more than one; written.

    Components only grow, so a list that is closed stays closed: ``members`` may be an earlier turn's.
    Parities and labels travel with the members of open lists alone.
    """
    members = members.select("key", "fp", "n", "place")
    named = labels.withColumnRenamed("node", "fp")
    label = F.coalesce("label", "fp").alias("label")
    apart = (
        members.select("key", "fp")
        .join(named, "fp", "left")
        .select("key", label)
        .groupBy("key")
        .agg(F.min("label").alias("x"), F.max("label").alias("y"))
    )
    keys = materialise(apart.where("x <> y").select("key"), "open_keys")
    left = members.join(keys, "key", "left_semi").join(named, "fp", "left")
    left = left.select("key", "fp", "n", "place", label).join(nodes.select("fp", *PARITY), "fp")
    return materialise(left, "open_lists")


def _other_hubs(open_lists: DataFrame, turn: int, sim: Similarity) -> DataFrame:
    """Pairs (a, b) of a member and the hub that this turn draws among a list's sets of its size.

    Lists draw apart, so a member meets as many hubs as it has lists.
    """
    band = F.floor(F.log("n") / F.log(F.lit(sim.den / sim.num)) + F.lit(turn / HUB_ROUNDS))
    rows = open_lists.withColumn("band", band)
    hub = F.min(F.struct(F.xxhash64("fp", "key", F.lit(turn)).alias("draw"), "fp", "n", "label", *PARITY))
    hubs = rows.groupBy("key", "band").agg(hub.alias("hub")).select("key", "band", "hub.*")
    met = rows.alias("s").join(
        hubs.alias("t"),
        F.expr(
            "s.key = t.key AND s.band = t.band AND s.label <> t.label AND s.fp <> t.fp AND "
            f"{sim.den} * least(s.n, t.n) >= {sim.num} * greatest(s.n, t.n) AND " + near("s", "t", sim)
        ),
    )
    return met.select(F.least("s.fp", "t.fp").alias("a"), F.greatest("s.fp", "t.fp").alias("b")).distinct()


def linked(docs: DataFrame, sim: Similarity) -> DataFrame:
    """Per row: id, tag, n and ``least``, the smallest (id, tag) that links reach (NO_ID for null)."""
    with scratch(docs.sparkSession, keep=("signatures", "least_rows")):
        signed, of_node = _least_rows(rows_of(docs), sim)
    return signed.join(of_node, "fp", "left").select(
        "id",
        "tag",
        "n",
        F.when(F.col("n") > 0, F.col("least")).otherwise(F.struct("id", "tag")).alias("least"),
    )


def _least_rows(rows: DataFrame, sim: Similarity) -> tuple[DataFrame, DataFrame]:
    """The signatures of all rows, and (fp, least) of all sets."""
    spark = rows.sparkSession
    counters = counters_for(rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0)
    signed, chunks = _signatures(rows, sim.k, counters)
    total = signed.agg(F.sum("n")).first()[0] or 0
    counts = signed.where(F.col("n").between(1, 2 * MAX_LIGHT)).groupBy("n").count().collect()
    light = boundary({n: c for n, c in counts}, sim)
    parts = max(1, -(-total // (4 * POSTING_ROWS)))
    lists = _lists(_postings(rows, sim, light, _counters(chunks, counters)), sim, parts)
    B.release(spark)

    # The texts of all sets in lists, one for each set.
    nodes = materialise(
        signed.where("n > 0")
        .groupBy("fp")
        .agg(
            F.min(F.struct("id", "tag")).alias("first"),
            F.max("n").alias("n"),
            *[F.max(c).alias(c) for c in PARITY],
        ),
        "nodes",
    )
    inside = lists.select("fp").union(lists.select("hub")).distinct()
    wanted = nodes.join(inside, "fp", "left_semi").select("fp", "first.id", "first.tag")
    wanted = materialise(wanted, "wanted")
    texts = B.by_key(
        marked(rows, wanted)
        .join(wanted, ["id", "tag"])
        .dropDuplicates(["fp", "id", "tag"])
        .select("fp", "text"),
        "fp",
        parts,
    )
    B.release(spark)

    tested = _hub_pairs(lists, nodes, sim)
    links = verify(tested, texts, sim)
    labels = components(links)

    members = lists.select("key", "fp", "n", "place").union(
        lists.select("key", "hub", "hub_n", "hub_place")
    )
    open_lists = materialise(members.distinct(), "members")
    for turn in range(HUB_ROUNDS):
        open_lists = _open_lists(open_lists, nodes, labels)
        met = _other_hubs(open_lists, turn, sim)
        met = materialise(met.join(tested, ["a", "b"], "left_anti"), "hub_pairs")
        if met.isEmpty():
            break
        tested, links = tested.union(met), links.union(verify(met, texts, sim))
        labels = components(links)
        B.release(spark)

    # Every pair of a list that is still apart.
    open_lists = _open_lists(open_lists, nodes, labels)
    one, two = open_lists.alias("s"), open_lists.alias("t")
    close = F.expr(
        "s.key = t.key AND s.label <> t.label AND (s.n < t.n OR s.n = t.n AND s.fp < t.fp) AND "
        + _possible("s.n", "s.place", "t.n", "t.place", sim)
        + " AND "
        + near("s", "t", sim)
    )
    more = one.join(two, close).select(
        F.least("s.fp", "t.fp").alias("a"), F.greatest("s.fp", "t.fp").alias("b")
    )
    more = materialise(more.distinct().join(tested, ["a", "b"], "left_anti"), "more_pairs")
    found = verify(more, texts, sim)
    if not found.isEmpty():
        labels = components(links.union(found))
    B.release(spark)

    grouped = nodes.join(labels.withColumnRenamed("node", "fp"), "fp", "left").withColumn(
        "label", F.coalesce("label", "fp")
    )
    smallest = grouped.groupBy("label").agg(F.min("first").alias("least"))
    return signed, materialise(grouped.join(smallest, "label").select("fp", "least"), "least_rows")


def report(docs: DataFrame, sim: Similarity) -> DataFrame:
    """Per document: doc_id, n_shingles, component_id."""

    def back(column):
        return F.when(column != B.NO_ID, column)

    return linked(docs.select("doc_id", "text"), sim).select(
        back(F.col("id")).alias("doc_id"),
        F.col("n").alias("n_shingles"),
        back(F.col("least.id")).alias("component_id"),
    )


def keep_one(docs: DataFrame, sim: Similarity) -> DataFrame:
    """The documents without near copies: of each component the row of the smallest id stays.

    Rows of equal id and text are one document; the one whose columns have the smallest hash stays.
    Documents without words all stay.
    """
    found = linked(docs.select("doc_id", "text"), sim)
    gone = found.where("least.id <> id OR least.tag <> tag").select("id", "tag").distinct()
    gone = materialise(gone, "near_copies")
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    rows = docs.select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(B.NO_ID)).alias("id"),
        F.xxhash64(F.coalesce(F.col("text"), F.lit(""))).alias("tag"),
        row,
    )
    twice = found.groupBy("id", "tag").count().where("count > 1").select("id", "tag")
    twice = materialise(twice, "repeated_rows")
    # Rows that are neither stay where they are; only those that may be are shuffled.
    rows = with_marks(rows, gone.union(twice), "tag", "asked")
    clear, asked = rows.where("NOT asked"), rows.where("asked")
    kept = asked.join(gone, ["id", "tag"], "left_anti")
    once = kept.join(twice, ["id", "tag"], "left_anti")
    again = kept.join(twice, ["id", "tag"], "left_semi").withColumn("at", F.xxhash64("row"))
    again = again.groupBy("id", "tag").agg(F.min_by("row", "at").alias("row"))
    whole = clear.select("row").unionByName(once.select("row")).unionByName(again.select("row"))
    return whole.select(*[F.col("row")[c].alias(c) for c in docs.columns])
