"""Benchmark decontamination on a distributed positional inverted index.

The index holds a posting (term, row, position) for each token of the corpus,
in segments: each task writes the postings of its documents sorted by term, so
nothing is shuffled to build it, and a reader of a few terms skips the rest. It
can be kept and asked again with another test set.

A phrase (a window of an item's words) is sought by intersecting posting lists
at their offsets, rarest term first: a posting of the item's p-th word at
position x says that the item may lie at x - p of the row. The lists of each
window's rarest and second rarest terms, adjusted by their offsets, are
intersected; of the alignments that are left, the lists of the words around
follow, and ten that agree in a row are an exact match. Proximity queries use the
same lists, from the rarest word outwards. Only DataFrame functions are used.

The test set's side of a join is broadcast while it takes at most
BROADCAST_BYTES, which is measured first; beyond that Spark's shuffled joins are
used, which split terms that very many rows hold.

Defined results: null, empty and wordless texts have no words and no hits; an
item without words has no window; an item shorter than a window is one window;
repeated rows, of documents or items, are judged each on its own; with an empty
benchmark or empty documents nothing is hit. Items of one id are one item in
the count and the list; items with null ids hit words and are in neither. Other
columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, made, release

#: Consecutive item words in a window.
WINDOW = 10
#: Bytes of the test set's side up to which it is broadcast.
BROADCAST_BYTES = 32 << 20
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased; ``lower`` does so at once where all is ASCII."""
    return F.when(text.rlike("[^\\x00-\\x7F]"), F.translate(text, _UPPER, _LOWER)).otherwise(F.lower(text))


def words_of(text: Column) -> Column:
    """The words of a text: runs of a-z (A-Z lower-cased), 0-9 and all beyond ASCII."""
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"), "")


def _bounded(df: DataFrame) -> DataFrame:
    """``df``, a written table, to be broadcast if its rows take no more than BROADCAST_BYTES: 16 bytes a value and the texts' own."""
    own = sum((F.octet_length(c) for c, kind in df.dtypes if kind == "string"), F.lit(0))
    held = df.agg(F.coalesce(F.sum(F.coalesce(own, F.lit(0)) + 16 * len(df.columns)), F.lit(0))).first()[0]
    return F.broadcast(df) if held <= BROADCAST_BYTES else df


def build_index(docs: DataFrame, id_: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """The index (term, row, pos), and the rows (row, id, n_words) of the documents. Both are written tables."""
    doc = docs.select(F.col(id_).alias("id"), words_of(F.col(text)).alias("words")).withColumn("row", F.monotonically_increasing_id())
    tokens = doc.select("row", "id", F.size("words").alias("n_words"), F.posexplode(F.concat(F.array(F.lit("")), "words")).alias("pos", "term"))
    # the term '' stands for the document itself
    kept = tokens.select("term", "row", (F.col("pos") - 1).alias("pos"), F.when(F.col("term") == "", F.struct("id", "n_words")).alias("doc"))
    index = cut(kept.sortWithinPartitions("term", "row", "pos"), "index")
    return index.filter("term <> ''").select("term", "row", "pos"), index.filter("term = ''").select("row", "doc.id", F.col("doc.n_words").cast("bigint").alias("n_words"))


def term_counts(index: DataFrame, terms: DataFrame) -> DataFrame:
    """(term, cf): how often each of ``terms`` occurs in the corpus."""
    return index.join(_bounded(terms), "term", "left_semi").groupBy("term").agg(F.count(F.lit(1)).alias("cf"))


def rarest_pairs(items: DataFrame, counts: DataFrame, window: int) -> DataFrame:
    """(item, need, p1, t1, p2, t2): the places and terms of the rarest and second rarest word of each window of each item.

    ``items`` has item (a unique number) and words. Ties go to the first place;
    windows with a word that the corpus lacks are left out; of windows of one
    word the second is the first.
    """
    places = items.select("item", F.posexplode("words").alias("at", "term")).join(counts, "term", "left")
    ranked = places.groupBy("item").agg(F.array_sort(F.collect_list(F.struct("at", F.coalesce("cf", F.lit(0)).alias("cf"), "term"))).alias("words"))
    need = F.least(F.size("words"), F.lit(window))
    best = F.transform(
        F.sequence(F.lit(1), F.size("words") - need + 1),
        lambda s: F.slice(F.array_sort(F.transform(F.slice("words", s, need), lambda x: F.struct(x["cf"].alias("cf"), x["at"].alias("at"), x["term"].alias("term")))), 1, 2),
    )
    pairs = ranked.select("item", need.alias("need"), F.explode(F.array_distinct(best)).alias("b")).filter(F.get("b", F.lit(0))["cf"] > 0)
    first, second = F.get("b", F.lit(0)), F.coalesce(F.get("b", F.lit(1)), F.get("b", F.lit(0)))
    return pairs.select("item", "need", first["at"].alias("p1"), first["term"].alias("t1"), second["at"].alias("p2"), second["term"].alias("t2"))


def alignments(index: DataFrame, pairs: DataFrame) -> DataFrame:
    """(row, item, need, start, p1): where the lists of both terms of a pair agree that the item lies, and the rarest word's place in it."""
    side = lambda n: index.join(_bounded(pairs.withColumnRenamed(f"t{n}", "term")), "term").select("row", "item", "need", (F.col("pos") - F.col(f"p{n}")).alias("start"), "p1", "p2")
    return side(1).join(side(2), ["row", "item", "need", "start", "p1", "p2"], "left_semi").select("row", "item", "need", "start", "p1").distinct()


def phrase_matches(index: DataFrame, items: DataFrame, pairs: DataFrame, window: int) -> DataFrame:
    """(row, item, start, end): runs of ``window`` document words that are a window of the item; exact."""
    aligned = cut(alignments(index, pairs), "aligned")
    rows = cut(aligned.select("row").distinct(), "rows")
    # the item's words around the rarest one, each where it has to be in the row
    around = aligned.join(_bounded(items.select("item", F.posexplode("words").alias("at", "term")).transform(lambda x: cut(x, "places"))), "item").filter(F.abs(F.col("at") - F.col("p1")) < window)
    wanted = around.select("row", "item", "need", "start", "at", "term", (F.col("start") + F.col("at")).alias("pos")).distinct()
    held = index.join(_bounded(rows), "row", "left_semi")
    agreed = wanted.join(held, ["row", "pos", "term"]).groupBy("row", "item", "need", "start").agg(F.array_sort(F.collect_list("at")).alias("at"))
    # need places in a row
    ends = F.filter(F.transform("at", lambda a, i: F.struct(a.alias("from"), F.get("at", i + F.col("need") - 1).alias("to"))), lambda x: x["to"] == x["from"] + F.col("need") - 1)
    runs = agreed.select("row", "item", "start", F.explode(ends).alias("e"))
    return runs.select("row", "item", (F.col("start") + F.col("e.from")).cast("bigint").alias("start"), (F.col("start") + F.col("e.to")).cast("bigint").alias("end"))


def proximity_matches(docs: DataFrame, queries: DataFrame, distance: int, id_: str = "doc_id", text: str = "text", query_id: str = "query_id", query_text: str = "text") -> DataFrame:
    """(id, query_id): documents with a span of at most ``distance`` words that holds all words of a query.

    ``queries`` has an id and text; those without words match nothing. Sought from
    each query's rarest word: the other words' postings near it are intersected.
    """
    index, rows = build_index(docs, id_, text)
    asked = queries.select(F.col(query_id).alias("query_id"), F.array_distinct(words_of(F.col(query_text))).alias("words")).filter(F.size("words") > 0)
    asked = cut(asked.withColumn("q", F.monotonically_increasing_id()), "queries")
    flat = cut(asked.select("q", F.size("words").alias("n"), F.explode("words").alias("term")), "terms")
    counted = flat.join(term_counts(index, cut(flat.select("term").distinct(), "terms")), "term", "left")
    best = counted.groupBy("q", "n").agg(F.min(F.struct(F.coalesce("cf", F.lit(0)).alias("cf"), "term")).alias("r")).filter("r.cf > 0")
    rarest = cut(best.select("q", "n", F.col("r.term").alias("term")), "rarest")
    start = cut(index.join(_bounded(rarest), "term").select("row", "q", "n", F.col("pos").alias("at")), "starts")
    others = index.join(_bounded(flat.select("q", "term").transform(lambda x: cut(x, "pairs"))), "term").join(_bounded(cut(start.select("row", "q").distinct(), "met")), ["row", "q"], "left_semi")
    near = start.join(others, ["row", "q"]).filter(F.abs(F.col("pos") - F.col("at")) < distance)
    held = near.groupBy("row", "q", "n", "at").agg(F.collect_list(F.struct("pos", "term")).alias("found")).filter(F.size(F.array_distinct("found.term")) == F.col("n"))
    spans = F.exists("found", lambda s: (s["pos"] <= F.col("at")) & (F.size(F.array_distinct(F.transform(F.filter("found", lambda x: (x["pos"] >= s["pos"]) & (x["pos"] < s["pos"] + distance)), lambda x: x["term"]))) == F.col("n")))
    found = held.filter(spans).select("row", "q").distinct()
    return found.join(rows, "row").join(asked.select("q", "query_id"), "q").select(F.col("id").alias(id_), "query_id")


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, id_: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """One row a document: id, n_words, n_hit, spans (hit windows), items (sorted ids, as strings, of items with an occurring window)."""
    since = made()
    index, rows = build_index(docs, id_, text)
    items = cut(benchmark.select(F.col(item_id).alias("item_id"), words_of(F.col(item_text)).alias("words")).filter(F.size("words") > 0).withColumn("item", F.monotonically_increasing_id()), "items")
    terms = cut(items.select(F.explode("words").alias("term")).distinct(), "terms")
    pairs = cut(rarest_pairs(items, term_counts(index, terms), window), "pairs")
    matches = cut(phrase_matches(index, items, pairs, window), "matches")
    named = matches.join(_bounded(cut(items.select("item", F.col("item_id").cast("string").alias("item_id")), "names")), "item")
    found = named.groupBy("row").agg(F.collect_set(F.struct("start", "end")).alias("spans"), F.array_sort(F.collect_set("item_id")).alias("items"))
    none = F.array().cast("array<string>")
    found, rows = cut(found, "found"), cut(rows, "rows")
    release(since, found, rows)
    out = rows.join(found, "row", "left")
    return out.select(F.col("id").alias(id_), "n_words", _covered("spans").alias("n_hit"), F.size(F.coalesce("items", none)).cast("bigint").alias("n_items"), F.coalesce("items", none).alias("items"), "spans")


def _covered(spans: str) -> Column:
    """Words inside any of the spans."""
    start = F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(-1).cast("bigint").alias("end"))
    total = F.aggregate(
        F.array_sort(F.coalesce(spans, F.array().cast("array<struct<start:bigint,end:bigint>>"))), start,
        lambda acc, s: F.struct((acc["n"] + F.greatest(F.lit(0).cast("bigint"), s["end"] - F.greatest(s["start"] - 1, acc["end"]))).alias("n"), F.greatest(acc["end"], s["end"]).alias("end")),
    )
    return total["n"]
