"""Merkle dataset manifest with incremental witnesses.

Each row is a leaf, the digest of its fields. The leaves of a tree (one per value of a column) stand
in the order of the key; every eight neighbours become their digest until one is left, the subroot.
The subroots, in the order of the column's values, are leaves of a last tree, whose root stands for
the data set.

Leaves are appended in order to blocks that are aligned with the tree: 8^4 leaves are one subtree of
four levels, so a block needs nothing from its neighbours. In a block, ``OpenTree`` holds the open
subtrees. One that joins a run starts a partial witness from the siblings before it, each later sibling
that is completed extends it, and when the run is full it is handed to all leaves below. Roots of
blocks are in turn appended to blocks of blocks, up to the root (each step leaves one row of 4,096).

1. Digests are taken by built-in functions in one narrow pass; only digests move after that. They are
   range-partitioned in order and written; the place of a leaf in its tree is its place in its
   partition and the counts of those before.
2. Blocks are streamed once for their roots, which grow upwards by the same step.
3. Blocks are streamed again, each headed by the witness of its own root, which is the rest of the witness
   of all its leaves. So no witness is stored for a leaf before it is whole.

Ties and skew: rows of one key stand in the order of their digests, equal rows are equal leaves, and a
row number spreads them over range partitions. Blocks have a fixed size, so a tree of any size, or a
third of all rows with one key, is many tasks.

Defined cases: null fields have a code of their own; a null key stands first and is never tampered with;
a null or empty value of the tree column is a tree of its own; a single leaf is its own subroot with an
empty witness; an empty table has no rows. Columns beyond the named ones are not read.
"""

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskloom.llm.text import LOWER, UPPER
from riskloom.operators.ordering import in_order
from riskloom.storage import materialise

FAN = 8
#: Levels of a block's subtree.
BLOCK_LEVELS = 4
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Rows of one Arrow batch that a task sends back; a row holds a witness of some kilobytes.
BATCH_ROWS = 1024


def joined_digest(digests: list[str]) -> str:
    return hashlib.sha256("".join(digests).encode()).hexdigest()


def levels_of(n: int) -> int:
    """Levels between ``n`` leaves and their root."""
    levels = 0
    while n > 1:
        n, levels = -(-n // FAN), levels + 1
    return levels


class Witness:
    """Siblings from a leaf upwards, and per level (own place, number of siblings)."""

    __slots__ = ("siblings", "path")

    def __init__(self):
        self.siblings: list[str] = []
        self.path: list[tuple[int, int]] = []


class OpenTree:
    """Streaming append of nodes to a tree of a known number of levels."""

    def __init__(self, levels: int):
        self.levels = levels
        #: Per level the open run: (digest, partial witness of this level, witnesses below).
        self.runs: list[list[tuple[str, list[str], list[Witness]]]] = [[] for _ in range(levels + 1)]

    def append(self, digest: str, witness: Witness | None = None) -> None:
        """``witness`` is filled as the subtrees above the node are completed."""
        self._join(0, digest, [] if witness is None else [witness])

    def _join(self, level: int, digest: str, below: list[Witness]) -> None:
        run = self.runs[level]
        if below:
            for _, partial, _ in run:
                partial.append(digest)
        run.append((digest, [d for d, _, _ in run] if below else [], below))
        if len(run) == FAN and level < self.levels:
            self._complete(level)

    def _complete(self, level: int) -> None:
        run, self.runs[level] = self.runs[level], []
        for place, (_, partial, below) in enumerate(run):
            for witness in below:
                witness.siblings += partial
                witness.path.append((place, len(run) - 1))
        self._join(level + 1, joined_digest([d for d, _, _ in run]), [w for *_, b in run for w in b])

    def finish(self) -> str:
        """Complete the runs that are still open; the root."""
        for level in range(self.levels):
            if self.runs[level]:
                self._complete(level)
        ((root, _, _),) = self.runs[self.levels]
        return root


def fold(digest: str, siblings: list[str], path: list[tuple[int, int]]) -> str:
    """The root that a leaf and its witness give."""
    at = 0
    for place, count in path:
        level = siblings[at : at + count]
        digest = joined_digest([*level[:place], digest, *level[place:]])
        at += count
    return digest


def field_code(value: Column) -> Column:
    """``-`` for null, else the number of UTF-8 bytes, a colon and the value."""
    value = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(value), F.lit(":"), value), F.lit("-"))


def leaf_digest(fields: list[Column]) -> Column:
    return F.sha2(F.concat(*[field_code(c) for c in fields]), 256)


def _tree_key(value: Column) -> Column:
    """Orders as the values do by bytes, null first; never null."""
    return F.coalesce(F.concat(F.lit("="), value.cast("string")), F.lit(""))


def _placed(rows: DataFrame, order: list[Column]) -> DataFrame:
    """``rows`` with ``pos``, the place in the row's tree, and ``total``, the leaves of that tree."""
    stood = in_order(rows, ["tree", *order])
    counts = stood.groupBy("tree", "_block").agg(
        F.count(F.lit(1)).alias("n"), F.min("_place").alias("first")
    )
    tree = Window.partitionBy("tree")  # one row per range partition that the tree touches
    before = F.sum("n").over(tree.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.select(
        "tree",
        "_block",
        (F.coalesce(before, F.lit(0)) - F.col("first")).alias("offset"),
        F.sum("n").over(tree).alias("total"),
    )
    placed = stood.join(offsets, ["tree", "_block"])
    return placed.select(*rows.columns, (F.col("offset") + F.col("_place")).alias("pos"), "total")


def _in_blocks(nodes: DataFrame, size: int, *columns: str) -> DataFrame:
    block = F.floor(F.col("pos") / size).cast("long")
    return nodes.select("tree", block.alias("block"), "pos", "total", "digest", *columns)


def _dealt(blocks: DataFrame) -> DataFrame:
    return blocks.repartition("tree", "block").sortWithinPartitions("tree", "block", "pos")


def _levels(total: int, high: int) -> int:
    """Levels of a block in a tree of ``total`` leaves; whole blocks have ``high``."""
    return levels_of(total) if total <= FAN**high else high


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns))


_KINDS = {"long": pa.int64(), "string": pa.string(), "boolean": pa.bool_(), "array<int>": pa.list_(pa.int32())}


def _batches(rows: Iterator[tuple], ddl: str) -> Iterator[pa.RecordBatch]:
    fields = [x.split() for x in ddl.split(", ")]
    schema = pa.schema([(name, _KINDS[kind]) for name, kind in fields])

    def batch(held: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*held)) or [()] * len(schema)
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

    held = []
    for row in rows:
        held.append(row)
        if len(held) == BATCH_ROWS:
            yield batch(held)
            held = []
    yield batch(held)


def _block_roots(nodes: DataFrame, high: int) -> DataFrame:
    """(tree, pos, total, digest) of the blocks, as nodes of the next step; written."""
    ddl = "tree string, pos long, total long, digest string"
    size = FAN**high

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made() -> Iterator[tuple]:
            key, work = None, None
            for tree, block, _, total, digest in _rows(batches):
                if key is None or key[:2] != (tree, block):
                    if key:
                        yield key[0], key[1], -(-key[2] // size), work.finish()
                    key, work = (tree, block, total), OpenTree(_levels(total, high))
                work.append(digest)
            if key:
                yield key[0], key[1], -(-key[2] // size), work.finish()

        yield from _batches(made(), ddl)

    return materialise(_dealt(_in_blocks(nodes, size)).mapInArrow(run, ddl), "block_roots")


_HEAD = "head_siblings string, head_path array<int>, subroot string, root string"


def _streamed(
    nodes: DataFrame, heads: DataFrame, columns: str, emit: Callable, ddl: str, high: int
) -> DataFrame:
    """Stream blocks, each behind the row of ``heads`` that holds the witness of its root.

    ``emit`` makes a row from a node's own columns, its whole witness, and its head.
    """
    names = [x.split()[0] for x in columns.split(", ")]
    head_names = [x.split()[0] for x in _HEAD.split(", ")]
    none = [F.lit(None).cast(x.split()[1]).alias(x.split()[0]) for x in columns.split(", ")]
    no_head = [F.lit(None).cast(x.split()[1]).alias(x.split()[0]) for x in _HEAD.split(", ")]
    rows = _in_blocks(nodes, FAN**high, *names).select("*", *no_head)
    first = heads.select(
        "tree",
        F.col("pos").alias("block"),
        F.lit(-1).cast("long").alias("pos"),
        F.lit(None).cast("long").alias("total"),
        F.lit(None).cast("string").alias("digest"),
        *none,
        *head_names,
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made() -> Iterator[tuple]:
            head = work = None
            held: list[tuple] = []

            def whole() -> Iterator[tuple]:
                work.finish()
                above = [head[0][i : i + 64] for i in range(0, len(head[0]), 64)]
                path = list(zip(head[1][::2], head[1][1::2]))
                for node, witness in held:
                    yield emit(node, witness.siblings + above, witness.path + path, head[2], head[3])

            for tree, _, pos, total, digest, *rest in _rows(batches):
                if pos == -1:
                    if held:
                        yield from whole()
                    head, work, held = rest[-4:], None, []
                    continue
                work = work or OpenTree(_levels(total, high))
                witness = Witness()
                held.append(((tree, pos, digest, *rest[:-4]), witness))
                work.append(digest, witness)
            if held:
                yield from whole()

        yield from _batches(made(), ddl)

    return _dealt(rows.unionByName(first)).mapInArrow(run, ddl)


def _grown(nodes: DataFrame, high: int) -> tuple[DataFrame, DataFrame]:
    """(tree, digest) of the roots of all trees, and the heads of the blocks of ``nodes``.

    Heads: (tree, pos, head_siblings, head_path). Each step leaves one row of 4,096, so there are few.
    """
    blocks = _block_roots(nodes, high)
    done = blocks.where("total = 1")
    bare = [F.lit("").alias("head_siblings"), F.array().cast("array<int>").alias("head_path")]
    roots, heads = done.select("tree", "digest"), done.select("tree", "pos", *bare)
    open_blocks = blocks.where("total > 1")
    if not open_blocks.isEmpty():
        more, above = _grown(open_blocks, high)
        ddl = "tree string, pos long, head_siblings string, head_path array<int>"

        def emit(node, siblings, path, *_):
            return node[0], node[1], "".join(siblings), [x for step in path for x in step]

        none = [F.lit(None).cast("string").alias(c) for c in ("subroot", "root")]
        above = above.select("*", *none)
        found = _streamed(open_blocks.withColumn("kept", F.lit(0)), above, "kept int", emit, ddl, high)
        roots, heads = roots.unionByName(more), heads.unionByName(materialise(found, "heads"))
    return roots, heads


def leaves(docs: DataFrame, by: str = "lang", key: str = "doc_id", fields=FIELDS) -> DataFrame:
    """(tree, id, digest, tampered) of each row; ``tampered`` is null where nothing is changed."""
    cols = [F.col(f"`{c}`") for c in fields]
    lowered = [F.translate(c, UPPER, LOWER) if f == "text" else c for f, c in zip(fields, cols)]
    hit = F.crc32(F.col(key).cast("string")) % 3 == 0
    return docs.select(
        _tree_key(F.col(by)).alias("tree"),
        F.col(key).cast("long").alias("id"),
        leaf_digest(cols).alias("digest"),
        F.when(hit, leaf_digest(lowered)).alias("tampered"),
    )


def _manifest(rows: DataFrame, emit: Callable, ddl: str, high: int) -> DataFrame:
    """Place the leaves, grow the trees and stream every leaf with its whole witness."""
    rows = materialise(rows.withColumn("salt", F.monotonically_increasing_id()), "leaves")
    nodes = _placed(rows, [F.col("id").asc_nulls_first(), F.col("digest"), F.col("salt")])
    nodes = materialise(nodes.drop("salt"), "placed_leaves")
    subroots, heads = _grown(nodes, high)
    trees = materialise(subroots.select(F.lit("").alias("tree"), F.col("tree").alias("name"), "digest"), "subroots")
    tops = materialise(_placed(trees, [F.col("name")]), "placed_subroots")
    roots, top_heads = _grown(tops, high)
    top_heads = top_heads.join(roots.withColumnRenamed("digest", "root"), "tree")
    top_heads = top_heads.withColumn("subroot", F.lit(None).cast("string"))

    def top(node, siblings, path, subroot, root):
        return node[3], node[2], root, "".join(siblings), [x for step in path for x in step]

    ddl_top = "tree string, subroot string, root string, top_siblings string, top_path array<int>"
    above = _streamed(tops, top_heads, "name string", top, ddl_top, high)
    above = materialise(above, "top_witnesses")
    heads = heads.join(above, "tree").select(
        "tree",
        "pos",
        F.concat("head_siblings", "top_siblings").alias("head_siblings"),
        F.concat("head_path", "top_path").alias("head_path"),
        "subroot",
        "root",
    )
    return _streamed(nodes, heads, "id long, tampered string", emit, ddl, high)


def witnesses(
    docs: DataFrame,
    by: str = "lang",
    key: str = "doc_id",
    fields=FIELDS,
    block_levels: int = BLOCK_LEVELS,
) -> DataFrame:
    """Per row: doc_id, leaf, subroot, root and the witness that leads from leaf to root.

    ``siblings`` holds the siblings' digests of 64 letters from the leaf upwards, each run from left
    to right; ``path`` holds two numbers per level, the own place and the number of siblings.
    """

    def emit(node, siblings, path, subroot, root):
        return node[3], node[2], subroot, root, "".join(siblings), [x for step in path for x in step]

    ddl = "doc_id long, leaf string, subroot string, root string, siblings string, path array<int>"
    return _manifest(leaves(docs, by, key, fields), emit, ddl, block_levels)


def report(docs: DataFrame, block_levels: int = BLOCK_LEVELS) -> DataFrame:
    """Per row: digests up to the root, the witness's digest, and the check of a tampered copy."""

    def emit(node, siblings, path, subroot, root):
        _, _, leaf, doc_id, tampered = node
        folded = fold(tampered or leaf, siblings, path)
        return doc_id, leaf, subroot, root, joined_digest(siblings), folded, folded == root

    ddl = (
        "doc_id long, leaf string, subroot string, root string, proof_sha256 string, "
        "folded_root string, verified boolean"
    )
    return _manifest(leaves(docs), emit, ddl, block_levels)
