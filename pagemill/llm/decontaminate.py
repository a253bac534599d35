"""Benchmark decontamination as a prefix-filtered set join, in DataFrame operations only.

An item is its windows of WINDOW words (one shorter window if it has fewer words), a window
the set of its SHINGLE-word shingles with their places. A document that holds a window
holds all its shingles, so a window needs only its rarest one - its prefix when shingles
are ordered by rarity in the corpus - to meet the document: shingle occurrences are found
first and counted, each window keeps its rarest shingle, and only occurrences of that one
become candidates. Place and length bounds then fix where the window would lie, and the
words there are compared exactly. Item windows of equal words are one window.

Defined results: null texts have no words; an item without words has no window; each
document row is judged on its own text, whatever its id (null ids too); an item id that
is repeated counts once in a document; other columns pass through `remove_contaminated`;
empty tables give no hits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill.llm.common import dropped, free_name, stored

#: Words of a window; share of hit words (one in SHARE) from which a document counts as contaminated.
WINDOW, SHARE = 13, 20
#: Words of a shingle; a window of fewer words is its own shingle.
SHINGLE = 3
#: Most rows of a table that is sent to every executor; beyond it the join is shuffled.
SMALL_ROWS = 100_000
#: Fixed value: what a word is.
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words_of(text: Column) -> Column:
    """Words of a text in order, letter case as it is; none for null."""
    return F.coalesce(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), F.array().cast("array<string>"))


def fold(word: Column) -> Column:
    """A-Z to lower case."""
    return F.translate(word, _UPPER, _LOWER)


def _is_small(df: DataFrame) -> bool:
    """Whether a table's counted size allows broadcasting it."""
    return df.limit(SMALL_ROWS + 1).count() <= SMALL_ROWS


def _small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if _is_small(df) else df


def _shingle(words: Column, at: Column, size: int) -> Column:
    """Hash of size words from index at (from 0). F.lower is coarser than fold and faster: equal
    words stay equal, and the words themselves are compared afterwards."""
    return F.xxhash64(*(F.lower(words[at + k]) for k in range(size)))


def _gram(words: Column, at: Column, size: int) -> Column:
    """Size folded words from index at on, as one text."""
    return fold(F.concat_ws(" ", *(words[at + k] for k in range(size))))


def item_windows(items: DataFrame, *, key: str = "item_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """(item_id, words): the windows of each item, words lower-cased."""
    listed = items.select(F.col(key).alias("item_id"), F.transform(words_of(F.col(text)), fold).alias("w")).filter(F.size("w") > 0)
    starts = F.sequence(F.lit(0), F.greatest(F.size("w") - window, F.lit(0)))
    cut = listed.select("item_id", "w", F.explode(starts).alias("at"))
    return cut.select("item_id", F.slice("w", F.col("at") + 1, window).alias("words")).distinct()


def window_shingles(windows: DataFrame) -> DataFrame:
    """(wid, words, n, size, offset, h, gram): every shingle of every distinct window; wid numbers them."""
    sized = windows.select("words").distinct().withColumn("wid", F.monotonically_increasing_id()).withColumn("n", F.size("words")).withColumn("size", F.least(F.lit(SHINGLE), F.col("n")))
    parts = sized.withColumn("offset", F.explode(F.sequence(F.lit(0), F.col("n") - F.col("size"))))
    of_size = lambda make: F.coalesce(*(F.when(F.col("size") == k, make(F.col("words"), F.col("offset"), k)) for k in range(1, SHINGLE + 1)))
    return parts.withColumn("h", of_size(_shingle)).withColumn("gram", of_size(_gram))


def shingle_occurrences(docs: DataFrame, shingles: DataFrame) -> DataFrame:
    """(doc_id, doc, at, gram): where the shingles (size, h, gram) occur in documents (doc_id, doc, w)."""
    sizes = [r[0] for r in shingles.select("size").distinct().collect()]  # at most SHINGLE values
    found = []
    for size in sizes or [SHINGLE]:
        last, wanted = F.size("w") - size, shingles.filter(F.col("size") == size)
        starts = F.sequence(F.lit(0), F.greatest(last, F.lit(0)))
        # a row a place has the words of its shingle alone: a document's words are not copied along
        here = lambda at: F.struct(_shingle(F.col("w"), at, size).alias("h"), F.array(*(F.col("w")[at + k] for k in range(size))).alias("words"))  # noqa: B023, E731
        spread = docs.select("doc_id", "doc", F.posexplode(F.when(last >= 0, F.transform(starts, here))).alias("at", "s"))
        near, grams = spread.select("doc_id", "doc", "at", F.col("s.h").alias("h"), F.col("s.words").alias("words")), wanted.select("gram").distinct()
        if _is_small(grams):  # hashes first: the words of a place are only joined if its hash is wanted
            near = near.join(F.broadcast(wanted.select("h").distinct()), "h", "left_semi")
        near = near.select("doc_id", "doc", "at", fold(F.array_join("words", " ")).alias("gram"))
        found.append(near.join(_small(grams), "gram", "left_semi").select("doc_id", "doc", "at", "gram"))
    whole = found[0]
    for one in found[1:]:
        whole = whole.union(one)
    return whole


def rarest_shingles(parts: DataFrame, found: DataFrame) -> DataFrame:
    """(gram, offset, n, wid, need): the prefix of each window all of whose shingles occur somewhere."""
    often = found.groupBy("gram").agg(F.count("*").alias("often"))
    need = parts.groupBy("wid", "n").agg(F.countDistinct("gram").alias("kinds"), F.count("*").alias("need"))
    have = parts.join(often, "gram").groupBy("wid").agg(F.countDistinct("gram").alias("have"), F.min_by(F.struct("gram", "offset"), F.struct("often", "offset")).alias("p"))
    return need.join(have, "wid").filter("have = kinds").select("p.gram", "p.offset", "n", "wid", "need")


def window_hits(parts: DataFrame, found: DataFrame) -> DataFrame:
    """(doc_id, doc, start, n, wid): each place of a document at which a window occurs."""
    prefix = stored(rarest_shingles(parts, found), "prefixes")
    start = (F.col("at") - F.col("offset")).alias("start")
    near = found.join(_small(prefix), "gram").select("doc_id", "doc", start, "n", "wid", "need").filter("start >= 0")
    # a window of one shingle is found with it; of others, every shingle has to be at its place
    alone, long = near.filter("need = 1"), near.filter("need > 1")
    places = long.join(_small(parts.select(F.col("wid").alias("_w"), "offset", "gram")), F.col("wid") == F.col("_w")).select("doc_id", "doc", "start", "n", "wid", "need", (F.col("start") + F.col("offset")).alias("at"), "gram")
    same = ["doc", "at", "gram"]
    there = found.select(F.col("doc_id").alias("_id"), *same)
    met = places.join(there, same).filter(F.col("doc_id").eqNullSafe(F.col("_id"))).groupBy("doc_id", "doc", "start", "n", "wid", "need").agg(F.countDistinct("at").alias("met"))
    return alone.drop("need").union(met.filter("met = need").drop("need", "met"))


def contamination(docs: DataFrame, items: DataFrame, **names) -> DataFrame:
    """Per row of docs: doc_id, n_words, n_hit, n_items, items (ids as strings, sorted), contaminated.
    names are those of judged."""
    return judged(docs, items, **names).drop("doc")


def judged(docs: DataFrame, items: DataFrame, *, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text", window: int = WINDOW) -> DataFrame:
    """contamination with the hash of each row as doc."""
    owners = stored(item_windows(items, key=item_key, text=item_text, window=window), "windows")
    parts = stored(window_shingles(owners), "shingles")
    # A row is named by its id and a hash of both: never wholly null, and equal only for equal rows.
    named = docs.select(F.col(key).alias("doc_id"), F.xxhash64(key, text).alias("doc"), words_of(F.col(text)).alias("w"))
    found = stored(shingle_occurrences(named, parts.select("size", "h", "gram").distinct()).distinct(), "occurrences")
    hits = stored(window_hits(parts, found).distinct(), "hits")
    dropped(found)
    covered = hits.select("doc_id", "doc", F.explode(F.sequence(F.col("start"), F.col("start") + F.col("n") - 1)).alias("at")).distinct().groupBy("doc_id", "doc").agg(F.count("*").alias("n_hit"))
    named_windows = owners.join(parts.select("words", "wid").distinct(), "words").select("wid", "item_id")
    held = hits.select("doc_id", "doc", "wid").distinct().join(named_windows, "wid").groupBy("doc_id", "doc").agg(F.array_sort(F.collect_set(F.col("item_id").cast("string"))).alias("items"))
    both = covered.join(held.withColumnRenamed("doc_id", "_id"), "doc").filter(F.col("doc_id").eqNullSafe(F.col("_id"))).select(F.col("doc_id").alias("_id"), F.col("doc").alias("_doc"), "n_hit", "items")
    counted = named.select("doc_id", "doc", F.size("w").cast("long").alias("n_words"))
    n_hit, items_held = F.coalesce("n_hit", F.lit(0).cast("long")), F.coalesce("items", F.array().cast("array<string>"))
    return (
        counted.join(both, (F.col("doc") == F.col("_doc")) & F.col("doc_id").eqNullSafe(F.col("_id")), "left")
        .select("doc_id", "doc", "n_words", n_hit.alias("n_hit"), F.size(items_held).cast("long").alias("n_items"), items_held.alias("items"))
        .withColumn("contaminated", (F.col("n_hit") > 0) & (F.col("n_hit") * SHARE >= F.col("n_words")))
    )


def remove_contaminated(docs: DataFrame, items: DataFrame, *, key: str = "doc_id", text: str = "text", item_key: str = "item_id") -> DataFrame:
    """docs without the rows that are contaminated, each judged by its own text: a clean row stays
    whatever other rows have its id, and a contaminated one goes with or without id."""
    bad = stored(judged(docs, items, key=key, text=text, item_key=item_key).filter("contaminated").select("doc_id", "doc").distinct(), "contaminated")
    doc = free_name(docs, "_doc")
    bad = _small(bad.select(F.col("doc_id").alias(f"{doc}id"), F.col("doc").alias(f"{doc}hash")))
    marked = docs.withColumn(doc, F.xxhash64(key, text))
    return marked.join(bad, (F.col(doc) == F.col(f"{doc}hash")) & F.col(key).eqNullSafe(F.col(f"{doc}id")), "left_anti").drop(doc)
