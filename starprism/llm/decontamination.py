"""Benchmark decontamination by a positional inverted index, in DataFrame operations alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from starprism.llm.common import checked, materialize, row_id_and_text

WINDOW = 8
# fixed values: word characters are digits, a-z and everything beyond ASCII; A-Z become a-z, all others end a word
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_ENDS = "".join(chr(c) for c in (*range(0x00, 0x20), *range(0x21, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)))
_COUNT = "\x00"  # stands before a text's words in the index; no word holds it
#: A side of at most so many rows, none of which holds a list or a text, is broadcast; a larger one is joined by a shuffle.
BROADCAST_ROWS = 500_000
SLOP, RARE = 8, 3


def _words(text: Column) -> Column:
    """A text's words in lower case: one pass over the characters, then a split at runs of spaces."""
    plain = F.trim(F.translate(F.coalesce(text, F.lit("")), _UPPER + _ENDS, _LOWER + " " * len(_ENDS)))
    return F.when(plain == "", F.array().cast("array<string>")).otherwise(F.split(plain, " +"))


def _small(df: DataFrame, most: int) -> DataFrame:
    """Broadcast behind a check of its size, else left to a shuffled join."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def item_words(items: DataFrame) -> DataFrame:
    """item (a number), item_id (text), words (in lower case), n, written; items of one id keep apart by their words, and
    repeated ones count once. Items with a null id or without words count for nothing."""
    words = items.select(F.col("item_id").cast("string").alias("item_id"), _words(F.col("text")).alias("words"))
    kept = words.where(F.col("item_id").isNotNull() & (F.size("words") > 0)).distinct()
    return materialize(kept.select(F.monotonically_increasing_id().alias("item"), "item_id", "words", F.size("words").alias("n")), "items")


def vocabulary(items: DataFrame) -> DataFrame:
    """name and term (its number) of each distinct word of the items, written."""
    return materialize(items.select(F.explode("words").alias("name")).distinct().withColumn("term", F.monotonically_increasing_id()), "vocabulary")


def positional_index(docs: DataFrame, terms: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """The inverted index of the documents (rid, doc_id, text), written: term, rid, pos of every word that is a term, and
    for each document a row with term -1, doc_id and, as pos, its number of words.

    Each task writes its documents' postings as one segment sorted by term, document and place, so the texts are read and
    split once and nothing is shuffled; a reader of some terms skips the row groups of others by their statistics.
    """
    whole = docs.select("rid", "doc_id", _words(F.col("text")).alias("words"))
    each = whole.select("rid", "doc_id", F.size("words").alias("n"), F.posexplode(F.concat(F.array(F.lit(_COUNT)), "words")).alias("i", "word"))
    asked = terms.union(docs.sparkSession.createDataFrame([(_COUNT, -1)], "name string, term long"))
    # a join by 64-bit hash, which takes a table of longs, then the words themselves are compared
    met = each.withColumn("h", F.xxhash64("word")).join(_small(asked.withColumn("h", F.xxhash64("name")), most), "h").where(F.col("word") == F.col("name"))
    counts = F.col("term") == -1
    return materialize(met.select("term", "rid", F.when(counts, F.col("n")).otherwise(F.col("i") - 1).alias("pos"), F.when(counts, F.col("doc_id")).alias("doc_id")), "index", ["term", "rid", "pos"])


def term_counts(index: DataFrame) -> DataFrame:
    """term and its number of places in all documents, from the index."""
    return materialize(index.where("term >= 0").groupBy("term").agg(F.count(F.lit(1)).alias("places")), "term-counts")


def item_places(items: DataFrame, terms: DataFrame, counts: DataFrame) -> DataFrame:
    """item, item_id, n, ipos, term and places (0 for a term that occurs nowhere) of every word of the items."""
    each = items.select("item", "item_id", "n", F.posexplode("words").alias("ipos", "name"))
    return each.join(terms, "name").join(counts, "term", "left").select("item", "item_id", "n", "ipos", "term", F.coalesce("places", F.lit(0)).alias("places"))


def windows(places: DataFrame, window: int = WINDOW) -> DataFrame:
    """wid, item_id, size and terms (struct of off and term, rarest first) of each window of the items, written. Windows
    with a term that occurs nowhere are left out: they cannot occur."""
    first, last = F.greatest(F.lit(0), F.col("ipos") - (window - 1)), F.least(F.col("ipos"), F.greatest(F.col("n") - window, F.lit(0)))
    spread = places.select("item", "item_id", "places", "ipos", "term", F.explode(F.sequence(first, last)).alias("s"))
    of = spread.groupBy("item", "s").agg(F.first("item_id").alias("item_id"), F.min("places").alias("least"), F.array_sort(F.collect_list(F.struct("places", (F.col("ipos") - F.col("s")).alias("off"), "term"))).alias("terms"))  # a window's terms: ``window`` at most
    return materialize(of.where("least > 0").select(F.monotonically_increasing_id().alias("wid"), "item_id", F.size("terms").alias("size"), F.transform("terms", lambda t: F.struct(t["off"].alias("off"), t["term"].alias("term"))).alias("terms")), "windows")


def phrase_hits(index: DataFrame, spans: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """Exact occurrences of windows, written: rid, item_id, first and size (in words of the document).

    The postings of each window's rarest term, shifted by the term's place in the window, give the possible beginnings.
    They are intersected with the shifted postings of the second rarest term, and those left with all further terms'.
    """
    at = lambda i: (F.col("terms")[i]["term"], F.col("terms")[i]["off"])
    (t1, o1), (t2, o2) = at(0), at(1)
    rarest = spans.select("wid", "size", t1.alias("term"), o1.alias("off1"), F.when(F.col("size") > 1, t2).alias("term2"), F.when(F.col("size") > 1, o2).alias("off2"))
    postings = index.where("term >= 0").select("term", "rid", "pos")
    begun = postings.join(_small(rarest, most), "term").select("rid", "wid", "size", (F.col("pos") - F.col("off1")).alias("first"), "term2", "off2").where("first >= 0")
    second = postings.join(_small(rarest.select(F.col("term2").alias("term")).distinct(), most), "term", "left_semi").withColumnRenamed("term", "term2")
    longer = begun.where("size > 1").select("rid", "wid", "first", "term2", (F.col("first") + F.col("off2")).alias("pos"))
    two = longer.join(second, ["rid", "pos", "term2"]).select("rid", "wid", "first")
    left = materialize(two.unionByName(begun.where("size = 1").select("rid", "wid", "first")), "two-terms")
    named = left.join(_small(spans.select("wid", "item_id", "size"), most), "wid")
    rest = spans.where("size > 2").select("wid", "size", F.explode(F.slice("terms", 3, F.size("terms"))).alias("t")).select("wid", "size", "t.off", "t.term")
    probes = left.join(_small(rest, most), "wid").select("rid", "wid", "first", "size", "term", (F.col("first") + F.col("off")).alias("pos"))
    there = postings.join(_small(left.select("rid").distinct(), most), "rid", "left_semi")
    found = probes.join(there, ["rid", "pos", "term"]).groupBy("rid", "wid", "first").agg(F.count(F.lit(1)).alias("n"), F.first("size").alias("size")).where("n = size - 2").select("rid", "wid", "first")
    whole = named.where("size > 2").join(found, ["rid", "wid", "first"], "left_semi")
    return materialize(whole.unionByName(named.where("size <= 2")).select("rid", "item_id", "first", "size"), "hits")


def proximity_hits(index: DataFrame, places: DataFrame, slop: int = SLOP, rare: int = RARE, most: int = BROADCAST_ROWS) -> DataFrame:
    """Looser matches: rid, item_id (distinct) where two of an item's ``rare`` rarest terms stand within ``slop`` words of
    the distance that their first places in the item have.

    Shifted places are cut into stretches of ``slop`` and joined by stretch, the lists of two different terms with each
    other, so no list is crossed with itself.
    """
    each = places.where("places > 0").groupBy("item", "item_id", "term", "places").agg(F.min("ipos").alias("ipos"))
    ranked = each.groupBy("item", "item_id").agg(F.array_sort(F.collect_list(F.struct("places", "ipos", "term"))).alias("x")).select("item", "item_id", F.posexplode(F.slice("x", 1, rare)).alias("rank", "x")).select("item", "item_id", "rank", "x.ipos", "x.term")
    found = materialize(index.where("term >= 0").join(_small(ranked, most), "term").select("rid", "item", "item_id", "rank", (F.col("pos") - F.col("ipos")).alias("shift")), "near-postings")
    cell = F.floor(F.col("shift") / slop)
    lead = found.where(F.col("rank") < rare - 1).select("rid", "item", "item_id", F.col("rank").alias("r"), F.col("shift").alias("at"), F.explode(F.array(*[cell + d for d in (-1, 0, 1)])).alias("cell"))
    # of the places in a stretch only the outermost can be nearest to another term's places
    rest = found.where("rank > 0").groupBy("rid", "item", "rank", cell.alias("cell")).agg(F.min("shift").alias("low"), F.max("shift").alias("high"))
    near = lead.join(rest, ["rid", "item", "cell"]).where((F.col("r") < F.col("rank")) & (F.col("low") <= F.col("at") + slop) & (F.col("high") >= F.col("at") - slop))
    return near.select("rid", "item_id").distinct()


def contaminated_rows(docs: DataFrame, own: str, items: DataFrame) -> DataFrame:
    """rid of the rows of ``docs`` (told apart by the column ``own``) that hold a window of any item."""
    kept = item_words(items)
    terms = vocabulary(kept)
    index = positional_index(row_id_and_text(docs, own), terms)
    return checked(phrase_hits(index, windows(item_places(kept, terms, term_counts(index)))).select("rid").distinct(), "contaminated")


def decontaminate(docs: DataFrame, items: DataFrame, window: int = WINDOW, least_items: int = 2, most: int = BROADCAST_ROWS) -> DataFrame:
    """A row per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, n_near (items that two of their
    rarest terms are near each other for, whether or not a window occurs).

    Null and empty texts have no words. Every row is judged for itself, so null ids and repeated rows keep their rows.
    Items with a null id or without words count for nothing; repeated items count once. Texts of any length are split
    whole; further columns, whatever their names, play no part. Empty tables give no rows, or rows without hits.
    """
    rows = docs.select(F.monotonically_increasing_id().alias("rid"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    kept = item_words(items)
    terms = vocabulary(kept)
    index = positional_index(rows, terms, most)  # its rows carry rid, which later readings take from there
    places = materialize(item_places(kept, terms, term_counts(index)), "item-places")
    hits = phrase_hits(index, windows(places, window), most)
    covered = hits.select("rid", F.explode(F.sequence("first", F.col("first") + F.col("size") - 1)).alias("pos")).distinct().groupBy("rid").agg(F.count(F.lit(1)).alias("n_hit"))
    named = hits.groupBy("rid").agg(F.array_sort(F.collect_set("item_id")).alias("ids"))  # the items of one document
    near = proximity_hits(index, places, most=most).groupBy("rid").agg(F.count_distinct("item_id").alias("n_near"))
    per_doc = named.join(covered, "rid", "full").join(near, "rid", "full")
    ids = F.coalesce(F.col("ids"), F.array().cast("array<string>"))
    return index.where("term = -1").select("rid", "doc_id", F.col("pos").cast("long").alias("n_words")).join(per_doc, "rid", "left").select(
        "doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.size(ids).cast("long").alias("n_items"), F.sha2(F.array_join(ids, ","), 256).alias("items_sha256"), (F.size(ids) >= least_items).alias("contaminated"), F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near")
    )


ORACLE = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (SELECT item_id, least(len(w), 8) AS n, unnest(generate_series(1, greatest(len(w) - 7, 1))) AS s, w FROM b WHERE len(w) > 0),
win AS (SELECT DISTINCT item_id, n, array_to_string(w[s : s + n - 1], ' ') AS t FROM bw),
sizes AS (SELECT DISTINCT n FROM win),
dw AS (SELECT doc_id, w, n, unnest(generate_series(1, len(w) - n + 1)) AS s FROM d, sizes WHERE len(w) >= n),
hit AS (SELECT dw.doc_id, win.item_id, dw.s, dw.n FROM dw JOIN win ON dw.n = win.n AND array_to_string(dw.w[dw.s : dw.s + dw.n - 1], ' ') = win.t),
places AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(generate_series(s, s + n - 1)) AS p FROM hit) GROUP BY doc_id),
dt AS (SELECT doc_id, unnest(w) AS term, generate_subscripts(w, 1) AS pos FROM d),
places_of AS (SELECT term, count(*) AS places FROM dt GROUP BY term),
bt AS (SELECT item_id, w, term, min(pos) AS ipos FROM (SELECT item_id, w, unnest(w) AS term, generate_subscripts(w, 1) AS pos FROM (SELECT DISTINCT item_id, w FROM b)) GROUP BY item_id, w, term),
ranked AS (SELECT item_id, w, term, ipos, row_number() OVER (PARTITION BY item_id, w ORDER BY places, ipos) AS rank FROM bt JOIN places_of USING (term)),
rare AS (SELECT doc_id, item_id, w, rank, pos - ipos AS shift FROM dt JOIN ranked USING (term) WHERE rank <= 3),
near AS (SELECT x.doc_id, count(DISTINCT x.item_id) AS n_near FROM rare x JOIN rare y ON x.doc_id = y.doc_id AND x.item_id = y.item_id AND x.w = y.w AND x.rank < y.rank AND abs(x.shift - y.shift) <= 8 GROUP BY x.doc_id),
items AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, sha256(string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR))) AS h FROM hit GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(places.n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(items.n_items, 0) AS BIGINT) AS n_items, coalesce(items.h, sha256('')) AS items_sha256, coalesce(items.n_items, 0) >= 2 AS contaminated, CAST(coalesce(near.n_near, 0) AS BIGINT) AS n_near
FROM d LEFT JOIN places USING (doc_id) LEFT JOIN items USING (doc_id) LEFT JOIN near USING (doc_id)
"""
