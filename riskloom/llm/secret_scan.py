r"""Secret scans with an incremental blob ledger.

A text is a blob, named by the SHA-256 of its bytes. The ledger holds every (blob, rule version)
pair that was scanned, and the findings per blob. A scan reads each new text once, skips pairs that
the ledger has, appends the rest, and joins findings back to every document that holds the blob.
History is free: any number of document versions can be passed, each distinct text is scanned once.

Offsets are code points, end exclusive. ``regexp_extract_all`` gives the matches of a rule and
``split`` the text between them; as rows of a window per blob and rule, their lengths add up to the places
of the matches, in time that grows with the matches. Findings are written before the pairs that say
so, and read once per pair: a run that is cut anywhere is made good by the next.

Defined cases: a null text is the empty text and has no findings; each input row gives one output
row, repeated rows and null ids included; an empty table gives an empty result. A blob that
thousands of documents share is scanned once, and its findings meet its documents in a join that
Spark can split. Extra columns are not read.
"""

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from riskloom.storage import materialise, new_path


@dataclass(frozen=True)
class Rule:
    """A kind of secret."""

    kind: str
    pattern: str
    group: int = 0
    min_length: int = 1


ASSIGN = (
    r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)

_KEY_NAME = r"[A-Z0-9 ]*PRIVATE KEY(?: BLOCK)?-----"
#: A key runs to its END line. If the next PEM line is another one, or none follows, it runs over the
#: header fields and the base64 lines; a last line under 16 characters must stand alone. Possessive
#: loops take no stack, so a key of any length matches, and no text is passed twice.
PRIVATE_KEY = (
    rf"-----BEGIN {_KEY_NAME}"
    rf"(?:(?:[^-]++|-(?!----(?:BEGIN|END) ))*+-----END {_KEY_NAME}"
    r"|(?:\s*+(?:Proc-Type|DEK-Info|Version|Comment|Hash|Charset):[^\n]*+)*+"
    r"""(?:(?:[\s"',>|#*]*+[A-Za-z0-9+/=\\]{16,}+)++"""
    r"""(?:[\s"',>|#*]*+[A-Za-z0-9+/]{1,15}+={0,2}+(?=[\s"',]*?(?:\n|\z)))?+)?+)"""
)

#: Maximal runs of the access and hex alphabets below their minimum fail as a whole, so the minimum
#: is part of the pattern; a failing assignment still takes its text, so its minimum is not.
RULES = (
    Rule("assign", ASSIGN, group=2, min_length=6),
    Rule("access", r"AKIA[A-Z0-9]{16,}"),
    Rule("hex", r"[0-9a-f]{24,}"),
    Rule("private_key", PRIVATE_KEY),
    Rule("forge_token", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("web_token", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("chat_token", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
)
RULE_VERSION = "4"
BASE_KINDS = ("assign", "access", "hex")

#: A span, and the largest end of those that start before it.
_SPAN = "array<struct<start:int,rank:int,kind:string,end:int,reach:int>>"
#: Code points per piece of a text that is redacted.
PIECE = 4096


def _matches(text: Column, rank: int, rule: Rule) -> Column:
    """Per match of one rule, and once more for the rest of the text: rank, number, and the lengths of
    the text before the match, of the match, and of its value."""
    found = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    value = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group))
    between = F.split(text, rule.pattern, -1)
    both = F.zip_with(
        F.transform(between, lambda b, i: F.struct(F.char_length(b).alias("b"), i.alias("i"))),
        F.transform(found, lambda f: F.char_length(f)),
        lambda x, f: F.struct(x["b"].alias("b"), x["i"].alias("i"), f.alias("f")),
    )
    numbered = F.zip_with(
        both,
        F.transform(value, lambda v: F.char_length(v)),
        lambda x, v: F.struct(
            F.lit(rank).alias("rank"),
            x["i"].alias("i"),
            x["b"].alias("b"),
            x["f"].alias("f"),
            v.alias("v"),
        ),
    )
    none = F.array().cast("array<struct<rank:int,i:int,b:int,f:int,v:int>>")
    return F.when(text.rlike(rule.pattern), numbered).otherwise(none)


def find(blobs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``blob`` and the sorted ``spans`` of every text that has a finding; blobs must be distinct."""
    every = F.concat(*[_matches(F.col("text"), rank, rule) for rank, rule in enumerate(rules)])
    rows = blobs.select("blob", F.inline(every)).repartition("blob")
    upto = Window.partitionBy("blob", "rank").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    passed = F.sum(F.col("b") + F.coalesce("f", F.lit(0))).over(upto)
    kinds = F.array(*[F.lit(r.kind) for r in rules])
    least = F.array(*[F.lit(r.min_length) for r in rules])
    placed = rows.select("blob", "rank", "f", "v", passed.alias("to"))
    placed = placed.where(F.col("f").isNotNull() & (F.col("v") >= F.get(least, F.col("rank"))))
    spans = placed.select(
        "blob",
        (F.col("to") - F.col("f")).cast("int").alias("start"),
        "rank",
        F.get(kinds, F.col("rank")).alias("kind"),
        F.col("to").cast("int").alias("end"),
    )
    order = ["start", "rank", "kind", "end"]
    before = Window.partitionBy("blob").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    reach = F.coalesce(F.max("end").over(before), F.lit(0)).alias("reach")
    spans = spans.select("blob", F.struct(*order, reach).alias("span"))
    # The spans of one text.
    return spans.groupBy("blob").agg(F.sort_array(F.collect_list("span")).alias("spans"))


@dataclass(frozen=True)
class Ledger:
    """Where scanned pairs and findings are kept; both are parquet tables that only grow."""

    path: str

    def _read(self, spark: SparkSession, name: str, schema: str) -> DataFrame:
        place = spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        files = place.getFileSystem(spark._jsc.hadoopConfiguration())
        if not files.exists(place):
            return spark.createDataFrame([], schema)
        return spark.read.schema(schema).parquet(str(place))

    def scanned(self, spark: SparkSession) -> DataFrame:
        return self._read(spark, "scanned", "blob binary, version string")

    def findings(self, spark: SparkSession) -> DataFrame:
        """The findings of each pair, once: a scan that was cut may have written some before."""
        rows = self._read(spark, "findings", f"blob binary, spans {_SPAN}, version string")
        return rows.dropDuplicates(["blob", "version"])

    def update(
        self, named: DataFrame, rules: tuple[Rule, ...] = RULES, version: str = RULE_VERSION
    ) -> None:
        """Scan the blobs of ``named`` (blob, text) that this rule version has not seen.

        A text is sent to the join only if some rule can match in it, so most texts never move.
        """
        spark = named.sparkSession
        done = self.scanned(spark).where(F.col("version") == version).select("blob")
        new = materialise(
            named.select("blob").distinct().join(done, "blob", "left_anti"), "unseen"
        )
        likely = F.lit(False)
        for rule in rules:
            likely = likely | F.col("text").rlike(rule.pattern)
        texts = named.where(likely).join(new, "blob", "left_semi")
        found = find(texts.dropDuplicates(["blob"]), rules)
        found.withColumn("version", F.lit(version)).write.mode("append").parquet(
            f"{self.path}/findings"
        )
        new.withColumn("version", F.lit(version)).write.mode("append").parquet(
            f"{self.path}/scanned"
        )


def scan(
    docs: DataFrame,
    ledger: Ledger | None = None,
    rules: tuple[Rule, ...] = RULES,
    version: str = RULE_VERSION,
) -> DataFrame:
    """Every row of ``docs`` as the struct ``row``, with its ``spans`` (empty if none)."""
    spark = docs.sparkSession
    ledger = ledger or Ledger(new_path(spark, "ledger"))
    text = F.coalesce(F.col("text"), F.lit(""))
    blob = F.unhex(F.sha2(text, 256))
    ledger.update(docs.select(blob.alias("blob"), text.alias("text")), rules, version)
    found = ledger.findings(spark).where(F.col("version") == version).drop("version")
    rows = docs.select(blob.alias("blob"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    return rows.join(found, "blob", "left").select(
        "row", F.coalesce("spans", F.array().cast(_SPAN)).alias("spans")
    )


def span_list(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    named = F.transform(
        spans,
        lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string")),
    )
    return F.array_join(named, ",")


def of_kinds(spans: Column, kinds: tuple[str, ...]) -> Column:
    return F.filter(spans, lambda s: s["kind"].isin(*kinds))


def report(docs: DataFrame, ledger: Ledger | None = None) -> DataFrame:
    """Counts of the base kinds, their digest and all spans, per document."""
    found = scan(docs.select("doc_id", "text"), ledger)
    spans = F.col("spans")
    counts = [
        F.size(of_kinds(spans, (kind,))).cast("long").alias(f"n_{kind}") for kind in BASE_KINDS
    ]
    return found.select(
        F.col("row.doc_id").alias("doc_id"),
        *counts,
        F.sha2(span_list(of_kinds(spans, BASE_KINDS)), 256).alias("base_sha256"),
        span_list(spans).alias("spans"),
    )


def _part(pieces: Column, start: Column, end: Column) -> Column:
    """Code points ``start`` to ``end`` of a text that is cut into pieces."""
    first, last = F.floor(start / PIECE).cast("int"), F.floor((end - 1) / PIECE).cast("int")
    head = F.substring(F.get(pieces, first), start % PIECE + 1, F.lit(PIECE))
    middle = F.array_join(F.slice(pieces, first + 2, last - first - 1), "")
    tail = F.substring(F.get(pieces, last), F.lit(1), (end - 1) % PIECE + 1)
    inside = F.substring(F.get(pieces, first), start % PIECE + 1, end - start)
    return F.when(end <= start, "").when(first == last, inside).otherwise(F.concat(head, middle, tail))


def redact(docs: DataFrame, mark: str = "[REMOVED]", ledger: Ledger | None = None) -> DataFrame:
    """The documents with every finding replaced by ``mark``; other columns unchanged."""
    # The text in pieces, as a column: a span reads only the pieces that it touches.
    text = F.coalesce(F.col("row")["text"], F.lit(""))
    cut = F.regexp_extract_all(text, F.lit(rf"(?s).{{1,{PIECE}}}+"), F.lit(0))
    found = scan(docs, ledger).withColumn(
        "pieces", F.when(F.size("spans") > 0, cut).otherwise(F.array().cast("array<string>"))
    )
    # A span that begins in an earlier one is covered by that one's mark.
    opening = F.filter("spans", lambda s: s["start"] >= s["reach"])
    kept = F.transform(opening, lambda s: F.concat(_part(F.col("pieces"), s["reach"], s["start"]), F.lit(mark)))
    last = F.array_max(F.transform("spans", lambda s: s["end"]))
    rest = _part(F.col("pieces"), last, F.char_length(text))
    joined = F.concat(F.array_join(kept, ""), rest)
    clean = F.when(F.size("spans") > 0, joined).otherwise(F.col("row")["text"])
    fields = {c: F.col("row")[c].alias(c) for c in docs.columns}
    fields["text"] = F.col("clean").alias("text")
    if "n_chars" in fields:
        fields["n_chars"] = F.char_length("clean").cast(docs.schema["n_chars"].dataType).alias("n_chars")
    return found.withColumn("clean", clean).select(*fields.values())
