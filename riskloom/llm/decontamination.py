r"""Benchmark decontamination by a positional inverted index.

The index stores one posting (document, position, term) for every training token that is a term of
some test item, and one closing posting per document that holds its length. A phrase is looked up
from its rarest term: the postings of that term, moved back by the term's offset, are the candidate
starts; the second rarest term's moved postings cut them down; all other terms must then be found at
their offsets too. Proximity search starts from the rarest term as well and asks for every term
within a number of words.

Terms are compared as text when the index is built and by number afterwards. Tables of terms,
windows and candidates are written, so Spark knows their sizes and broadcasts them only when
they are below its threshold; otherwise both sides are shuffled on (term) or (document, position). Postings
pass a bitmap of the wanted terms or texts first, so only a small share of them is ever shuffled.
A hot term only ever meets the windows in which it is the rarest.

Defined cases: a null or empty text has no words and no hits; an item without words has no window;
an item without an id counts under the empty name. A document is told apart by its id and a hash of
its text, so rows that repeat an id with another text stay separate, and equal rows each come back
with the same result. Extra columns are not read.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.llm.blocks import release
from riskloom.llm.marks import marked
from riskloom.llm.text import lower_ascii, words_of
from riskloom.storage import materialise

#: ASCII that is neither a digit nor a letter.
BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: The closing posting's term; no word can be equal to it.
END, END_TERM = "\x00", 0


def item_terms(items: DataFrame) -> DataFrame:
    """(item_id, place, word) of every item word, in lower case."""
    name = F.coalesce(F.col("item_id").cast("string"), F.lit(""))
    words = items.select(name.alias("item_id"), words_of(F.col("text"), BETWEEN).alias("words"))
    return words.select(
        "item_id", F.transform("words", lambda w: lower_ascii(w)).alias("words")
    ).where(F.size("words") > 0)


def windows_of(items: DataFrame, width: int) -> DataFrame:
    """Distinct windows: (window, words) and, exploded beside it, the items that hold each."""
    words = F.col("words")
    starts = F.sequence(F.lit(1), F.greatest(F.size(words) - (width - 1), F.lit(1)))
    spans = item_terms(items).select("item_id", words, F.explode(starts).alias("at"))
    return spans.select(
        "item_id", F.slice(words, F.col("at"), F.lit(width)).alias("words")
    ).withColumn("window", F.xxhash64("words"))


def document_tag(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def build_index(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """Postings (doc_id, tag, pos, term) of every token among ``terms`` (word, term), written."""
    words = F.concat(words_of(F.col("text"), BETWEEN), F.array(F.lit(END)))
    tokens = docs.select(
        "doc_id", document_tag(F.col("text")).alias("tag"), F.posexplode(words).alias("pos", "raw")
    ).withColumn("word", lower_ascii(F.col("raw")))
    return materialise(
        tokens.join(terms, "word").select("doc_id", "tag", "pos", "term"), "postings"
    )


def vocabulary(windows: DataFrame) -> DataFrame:
    """(word, term): a number above 0 for each distinct word of the windows, 0 for the end mark."""
    words = windows.select(F.explode("words").alias("word")).distinct()
    # The hash is folded into 62 bits above zero; the words themselves decide what is posted.
    named = words.select("word", (F.shiftrightunsigned(F.xxhash64("word"), 2) + 1).alias("term"))
    end = words.sparkSession.range(1).select(F.lit(END).alias("word"), F.lit(END_TERM).cast("long").alias("term"))
    return materialise(named.unionByName(end), "terms")


def _same_document(left: DataFrame, right: DataFrame) -> Column:
    return left["doc_id"].eqNullSafe(right["doc_id"]) & (left["tag"] == right["tag"])


def _posted(wanted: DataFrame, postings: DataFrame) -> DataFrame:
    """The rows (doc_id, tag, p, t ...) that have a posting. Repeated postings repeat no row."""
    there = postings.select(
        F.col("doc_id").alias("_doc"), F.col("tag").alias("_tag"), F.col("pos").alias("_pos"), F.col("term").alias("_term")
    )
    same = F.expr("doc_id <=> _doc AND tag = _tag AND p = _pos AND t = _term")
    return wanted.join(there, same, "left_semi")


def ranked_terms(index: DataFrame, windows: DataFrame, terms: DataFrame) -> DataFrame:
    """(window, n, offset, term, rank): each window's terms, rarest in the corpus first.

    A window with a term that the corpus lacks is left out: it occurs nowhere.
    """
    places = windows.select("window", F.posexplode("words").alias("offset", "word"))
    counts = index.groupBy("term").agg(F.count("*").alias("df"))
    known = places.join(terms, "word").join(counts, "term", "left")
    per_window = known.groupBy("window").agg(
        F.sort_array(
            F.collect_list(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "offset", "term"))
        ).alias("t")
    )
    return per_window.where(F.col("t")[0]["df"] > 0).select(
        "window",
        F.size("t").alias("n"),
        F.posexplode("t").alias("rank", "x"),
    ).select("window", "n", "rank", F.col("x.offset").alias("offset"), F.col("x.term").alias("term"))


def find_phrases(index: DataFrame, windows: DataFrame, terms: DataFrame) -> DataFrame:
    """Every exact occurrence (window, n, doc_id, tag, start) of the windows (window, words)."""
    ranked = materialise(ranked_terms(index, windows, terms), "ranked")
    first = ranked.where("rank = 0").select("window", "n", "offset", "term")
    second = ranked.where("rank = 1").select("window", F.col("offset").alias("o2"), F.col("term").alias("t2"))
    starts = marked(index, first, "term").join(first, "term").select(
        "window", "n", "doc_id", "tag", (F.col("pos") - F.col("offset")).alias("start")
    )
    starts = starts.where("start >= 0").dropDuplicates(["window", "doc_id", "tag", "start"])
    probes = starts.join(second, "window", "left").withColumn("p", F.col("start") + F.col("o2"))
    probes = materialise(probes.withColumnRenamed("t2", "t").drop("o2"), "probes")
    near = _posted(probes.where("t IS NOT NULL"), marked(index, second.select(F.col("t2").alias("term")), "term"))
    near = near.unionByName(probes.where("t IS NULL")).drop("p", "t")
    near = materialise(near, "candidates")
    release(near.sparkSession)
    rest = ranked.where("rank > 1").select("window", F.col("offset").alias("o"), F.col("term").alias("t"))
    wanted = near.join(rest, "window").select(
        "window", "n", "doc_id", "tag", "start", (F.col("start") + F.col("o")).alias("p"), "t"
    )
    found = _posted(wanted, marked(index, near, "tag"))
    whole = (
        found.groupBy("window", "n", "doc_id", "tag", "start")
        .agg(F.count("*").alias("k"))
        .where("k = n - 2")
        .drop("k")
    )
    return whole.unionByName(near.where("n <= 2"))


def find_near(index: DataFrame, windows: DataFrame, terms: DataFrame, slop: int) -> DataFrame:
    """Proximity: (window, doc_id, tag, pos) where every distinct term of the window lies within
    ``slop`` words of the rarest term's posting at ``pos``, in any order."""
    ranked = ranked_terms(index, windows, terms)
    distinct = ranked.groupBy("window", "term").agg(F.min("rank").alias("rank"))
    sizes = distinct.groupBy("window").agg(F.count("*").alias("n"))
    seeds = index.join(distinct.where("rank = 0"), "term").join(sizes, "window")
    seeds = seeds.select("window", "n", "doc_id", "tag", F.col("pos").alias("at")).dropDuplicates()
    # Positions meet in cells of ``slop`` words, so the join has an equality besides the distance.
    cell = F.explode(F.array(*[F.floor(F.col("at") / slop) + d for d in (-1, 0, 1)]))
    probes = seeds.join(distinct.drop("rank"), "window").withColumn("cell", cell)
    posted = index.withColumn("cell", F.floor(F.col("pos") / slop))
    hit = probes.join(
        posted,
        _same_document(probes, posted)
        & (probes["cell"] == posted["cell"])
        & (probes["term"] == posted["term"])
        & (F.abs(probes["at"] - posted["pos"]) <= slop),
        "left_semi",
    )
    return (
        hit.groupBy("window", "n", "doc_id", "tag", "at")
        .agg(F.countDistinct("term").alias("k"))
        .where("k = n")
        .select("window", "doc_id", "tag", F.col("at").alias("pos"))
    )


def contamination(docs: DataFrame, items: DataFrame, width: int = 10) -> DataFrame:
    """Per document: words, words inside an occurrence of a test window, and the items found."""
    spans = materialise(windows_of(items, width), "windows")
    windows = materialise(spans.dropDuplicates(["window"]).select("window", "words"), "distinct_windows")
    terms = vocabulary(windows)
    index = build_index(docs, terms)
    hits = materialise(find_phrases(index, windows, terms), "hits")
    covered = hits.select(
        "doc_id", "tag", F.explode(F.expr("sequence(start, start + n - 1)")).alias("pos")
    ).distinct()
    n_hit = covered.groupBy("doc_id", "tag").agg(F.count("*").alias("n_hit"))
    found = (
        hits.select("doc_id", "tag", "window").distinct()
        .join(spans.select("window", "item_id").distinct(), "window")
        .groupBy("doc_id", "tag")
        .agg(F.array_sort(F.collect_set("item_id")).alias("items"))
    )
    both = n_hit.join(found, n_hit["doc_id"].eqNullSafe(found["doc_id"]) & (n_hit["tag"] == found["tag"]))
    both = both.select(n_hit["doc_id"], n_hit["tag"], "n_hit", "items")
    lengths = index.where(F.col("term") == END_TERM)
    return lengths.join(both, _same_document(lengths, both), "left").select(
        lengths["doc_id"],
        lengths["tag"],
        F.col("pos").cast("long").alias("n_words"),
        F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
    )


def report(docs: DataFrame, items: DataFrame, width: int = 10) -> DataFrame:
    """``contamination`` with the items as a count and a digest."""
    return contamination(docs.select("doc_id", "text"), items, width).select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def drop_contaminated(docs: DataFrame, items: DataFrame, width: int = 10) -> DataFrame:
    """The documents without any hit, with all their columns."""
    hit = contamination(docs.select("doc_id", "text"), items, width).where("n_hit > 0")
    hit = materialise(hit.select("doc_id", "tag").distinct(), "contaminated")
    same = docs["doc_id"].eqNullSafe(hit["doc_id"]) & (document_tag(docs["text"]) == hit["tag"])
    return docs.join(hit, same, "left_anti")
