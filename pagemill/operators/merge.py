"""Keyed merges: upserts, overlays, resumes and lookups, written as joins and windows.

Every merge returns the new state of a table; a table is changed by writing that as a new
version (see pagemill.sources.sinks), since plain Parquet has no MERGE.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pagemill.functions.text import normal_title
from pagemill.operators.folds import walk_in_order
from pagemill.operators.ordered import keep_first
from pagemill.sources.storage import discard, stored


def clean_feed(feed: DataFrame, *, texts: list[str], ints: list[str], flags: list[str], title: str, status: str, default_status: str) -> DataFrame:
    """Feed rows with blank titles dropped, texts trimmed to null, numbers int-or-null, flags boolean,
    and a default status."""
    blank_free = lambda c: F.nullif(F.trim(F.col(c).cast("string")), F.lit(""))
    out = feed.filter(blank_free(title).isNotNull())
    for c in texts:
        out = out.withColumn(c, blank_free(c))
    for c in ints:
        out = out.withColumn(c, F.col(c).cast("string").try_cast("int"))
    for c in flags:
        out = out.withColumn(c, F.coalesce(F.col(c).cast("boolean"), F.lit(False)))
    return out.withColumn(status, F.coalesce(blank_free(status), F.lit(default_status)))


def linked_groups(rows: DataFrame) -> DataFrame:
    """(node, group) of rows (node, tokens): nodes with a token in common, over any chain, are of one group,
    which is named by its least node."""
    links = _group_links(rows.select("node", F.explode("tokens").alias("token")))
    return rows.select("node").distinct().join(links.withColumnRenamed("a", "node"), "node", "left").select("node", F.coalesce("b", "node").alias("group"))


def _group_links(spread: DataFrame) -> DataFrame:
    """(a, b): the least node b of the group of each node a that is not its own group's least, of (node, token).

    A token of one node links nothing; each other one links its nodes to its least. From then on only
    links count: in a round every node hangs its greater neighbours and itself on the least neighbour,
    until all hang on the least of their group. A round is stored once, and the one before deleted."""
    ends = spread.groupBy("token").agg(F.min("node").alias("low"), F.max("node").alias("high")).filter("low < high").select("token", "low")
    links = stored(spread.join(ends, "token").filter("node > low").select(F.col("node").alias("a"), F.col("low").alias("b")).distinct(), "links")
    before = None
    while (now := tuple(links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first())) != before and now[0]:
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("low")).select("a", F.least("a", "low").alias("low"))
        greater = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("low").alias("b")).distinct()
        down = greater.groupBy("a").agg(F.min("b").alias("low"))
        hung = greater.join(down, "a").filter("b <> low").select(F.col("b").alias("a"), F.col("low").alias("b")).unionByName(down.select("a", F.col("low").alias("b")))
        older, links, before = links, stored(hung.distinct(), "links"), now
        discard(older)
    return links


def upsert_catalogue(catalogue: DataFrame, feed: DataFrame, *, id: str, keys: list[list[str]], order: str, keep_old: list[str], never: list[str], blank: list[str] = ()) -> tuple[DataFrame, DataFrame]:
    """New catalogue, and one row of counts (inserted, updated).

    Feed rows go in their order, each to the entry that its first matching key finds as the entries are
    by then (the least id counts), else to a new one, whose id is the highest one plus the row's order
    plus one. keep_old columns take a value that is not null, `never` columns are not updated, null
    equals empty in the key columns `blank`, other null keys match nothing.

    Rows that can meet over any chain of keys form a group. A group is plain if all its rows have the same kind of
    key as their first given one, and each finds that key in the catalogue or gives no other: nothing changes a key
    that such rows go by, so those of a key are folded into one row before it meets its entry. The rows of each other group
    stream by in order, and only its entries are held: a feed in which one chain of keys runs through most rows is
    one group, whose entries one task holds, if it is not plain. Entries that no feed row can meet pass by unread.

    Every row and entry stands at its first given key, and the others link that key to further ones. Where the
    first kind of key is never updated, a row that finds it in the catalogue asks for no other key: those
    it brings link only if some row that may not be found so asks for them.
    """
    values = [c for c in catalogue.columns if c != id]
    texts = lambda cols: [F.coalesce(F.col(c).cast("string"), F.lit("")) if c in blank else F.col(c).cast("string") for c in cols]
    given = lambda cols: reduce(lambda x, y: x & y, (F.col(c).isNotNull() for c in cols if c not in blank), F.lit(True))
    hashed = lambda cols, *seeds: F.when(given(cols), F.xxhash64(*map(F.lit, seeds), *texts(cols)))
    # Groups go by one hash of a key: two that share one only make a larger group; rows and entries meet by two. Of a key
    # whose columns an update mixes from the row and the entry, only columns that come together count for groups, or one.
    whole = lambda cols: set(cols) <= set(never) or not set(cols) & {*keep_old, *never}
    linking = [cols if whole(cols) else [c for c in cols if c not in keep_old and c not in never] or cols[:1] for cols in keys]
    names = [f"_t{n}" for n in range(len(keys))]
    tokens = [hashed(cols, n).alias(t) for n, (cols, t) in enumerate(zip(linking, names, strict=True))]
    marks = [(hashed(cols, n), hashed(cols, "mark", n)) for n, cols in enumerate(keys)]
    kind = F.coalesce(*(F.when(given(cols), F.lit(n)) for n, cols in enumerate(keys))).alias("kind")
    first, mark = (F.coalesce(*c) for c in zip(*marks, strict=True))
    single = (reduce(lambda x, y: x + y, (given(cols).cast("int") for cols in keys)) == 1).alias("single")
    stand, every = F.coalesce(*names).alias("stand"), F.explode(F.array(*names)).alias("token")
    old = catalogue.select(F.col(id).cast("bigint").alias("at"), *values, *tokens)
    new = feed.select(F.col(order).cast("bigint").alias("at"), *values, *tokens, kind, first.alias("first"), mark.alias("mark"), single)
    held = catalogue.select(F.col(id).cast("bigint").alias("at"), F.explode(F.array(*(F.struct(x.alias("first"), y.alias("mark")) for x, y in marks))).alias("k"))
    found = held.filter("k.first is not null").groupBy("k.first", "k.mark").agg(F.min("at").alias("target"))
    brought = new.filter("kind is not null").groupBy(*names, "kind", "first", "mark", "single").agg(F.count("*").alias("n"))
    bound = (F.col("target").isNotNull() & (F.col("kind") == 0)) if set(keys[0]) <= set(never) else F.lit(False)
    met = stored(brought.join(found, ["first", "mark"], "left").select(*names, "kind", "first", "mark", "target", "n", (F.col("target").isNotNull() | F.col("single")).alias("sure"), bound.alias("bound")), "keys")
    asking = met.filter("not bound").select(stand, every).filter("token is not null")
    asked = stored(asking.select("token").distinct(), "asked")
    passive = met.filter("bound").select(stand, every).unionByName(old.select(stand, every)).filter("token is not null").join(asked, "token", "left_semi").select("stand", "token")
    spread = stored(asking.unionByName(passive).select(F.col("stand").alias("node"), "token").distinct(), "spread")
    groups = _group_links(spread)
    kinds = met.groupBy(stand).agg(F.min("kind").alias("low"), F.max("kind").alias("high"), F.min("sure").alias("sure"))
    grouped = kinds.join(groups.withColumnRenamed("a", "stand"), "stand", "left").groupBy(F.coalesce("b", "stand").alias("group")).agg(F.min("low").alias("low"), F.max("high").alias("high"), F.min("sure").alias("sure"))
    unlike = stored(grouped.filter("low <> high or not sure").select("group"), "unlike")
    tangled = stored(groups.join(unlike, F.col("b") == F.col("group")).select(F.col("a").alias("stand"), "group").unionByName(unlike.select(F.col("group").alias("stand"), "group")), "tangled")
    discard(asked, spread, unlike)
    apart = lambda rows: rows.join(tangled.select(F.col("stand").alias("_stand")), F.coalesce(*names) == F.col("_stand"), "left_anti")

    kept = [values.index(c) for c in values if c in keep_old]
    fixed = [values.index(c) for c in values if c in never]
    parts = [[(values.index(c), c in blank) for c in cols] for cols in keys]

    def walk(rows):
        group, entries = None, _Entries(parts)
        for name, side, at, high, n, *row in rows:
            if name != group:
                yield from entries.rows()
                group, entries = name, _Entries(parts)
            entries.take(at, row) if side == 0 else entries.apply(high + at + 1, row, kept, fixed, n)
        yield from entries.rows()

    types = dict(catalogue.dtypes)
    schema = f"`{id}` bigint, {', '.join(f'`{c}` {types[c]}' for c in values)}, _new boolean, _updates bigint"
    high = F.broadcast(catalogue.agg(F.coalesce(F.max(id), F.lit(0)).cast("bigint").alias("high")))
    in_groups = lambda rows: walk_in_order(rows.crossJoin(high), by=["group"], order=["side", "at"], columns=["group", "side", "at", "high", "n", *values], schema=schema, walk=walk)
    entry = [F.lit(0).alias("side"), "at", F.lit(1).cast("bigint").alias("n"), *values]
    row = [F.lit(1).alias("side"), "at", "n", *values]
    folded = _folded(apart(new.filter("kind is not null")), values, keep_old, never).join(found, ["first", "mark"], "left").withColumnRenamed("first", "group")
    targets = folded.filter("target is not null").select("group", F.col("target").alias("at"))
    plain = in_groups(old.join(targets, "at").select("group", *entry).unionByName(folded.select("group", *row)))
    changed = stored(in_groups(old.select(*entry, stand).unionByName(new.filter("kind is not null").withColumn("n", F.lit(1).cast("bigint")).select(*row, stand)).join(tangled, "stand")), "entries")

    keyless = new.filter("kind is null")
    unread = apart(old).join(met.filter("target is not null").select(F.col("target").alias("at")).distinct(), "at", "left_anti").withColumnRenamed("at", id)
    added = keyless.crossJoin(high).select((F.col("high") + F.col("at") + 1).alias(id), *(F.col(c).cast(types[c]).alias(c) for c in values))
    counts = apart(met).groupBy("first", "mark").agg(F.max(F.col("target").isNull().cast("bigint")).alias("inserted"), F.sum("n").alias("n")).select("inserted", (F.col("n") - F.col("inserted")).alias("updated"))
    counts = counts.unionByName(changed.select(F.col("_new").cast("bigint").alias("inserted"), F.col("_updates").alias("updated"))).unionByName(keyless.select(F.lit(1).cast("bigint").alias("inserted"), F.lit(0).cast("bigint").alias("updated")))
    stats = counts.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("inserted", "updated")))
    return reduce(lambda x, y: x.unionByName(y), (part.select(id, *values) for part in (unread, plain, changed, added))), stats


def _folded(rows: DataFrame, values: list[str], keep_old: list[str], never: list[str]) -> DataFrame:
    """One row for all of a key (first, mark) that go to one entry: what they leave of it if the first of them makes
    it, which updates one that is there alike; with the order of the first row and their number."""
    rest = [c for c in values if c not in keep_old and c not in never]
    one = lambda how, columns: how(F.struct(F.lit(0).alias("_none"), *columns), "at")
    last = [F.max_by(c, F.when(F.col(c).isNotNull(), F.col("at"))).alias(c) for c in values if c in keep_old and c not in never]
    sums = rows.groupBy("first", "mark").agg(F.min("at").alias("at"), F.count("*").alias("n"), one(F.max_by, rest).alias("_last"), one(F.min_by, [c for c in values if c in never]).alias("_begun"), *last)
    return sums.select("first", "mark", "at", "n", *(F.col(f"_begun.{c}").alias(c) if c in never else F.col(c) if c in keep_old else F.col(f"_last.{c}").alias(c) for c in values))


class _Entries:
    """The entries of one group, found by their keys as they are now."""

    def __init__(self, parts: list[list[tuple[int, bool]]]):
        self.parts, self.values, self.found, self.new, self.updates = parts, {}, {}, set(), {}

    def keys(self, row: list) -> list:
        for n, cols in enumerate(self.parts):
            if all(blank or row[i] is not None for i, blank in cols):
                yield n, *("" if row[i] is None else row[i] for i, _ in cols)

    def take(self, at: int, row: list) -> None:
        self.values[at] = row
        for key in self.keys(row):
            self.found.setdefault(key, set()).add(at)

    def apply(self, fresh: int, row: list, kept: list[int], fixed: list[int], n: int) -> None:
        """Take a row that stands for n rows one after the other."""
        at = next((min(self.found[key]) for key in self.keys(row) if self.found.get(key)), None)
        if at is None:
            self.new.add(fresh)
            self.updates[fresh] = n - 1
            return self.take(fresh, list(row))
        old = self.values[at]
        for key in self.keys(old):
            self.found[key].discard(at)
        merged = list(row)
        for i in kept:
            merged[i] = old[i] if row[i] is None else row[i]
        for i in fixed:
            merged[i] = old[i]
        self.updates[at] = self.updates.get(at, 0) + n
        self.take(at, merged)

    def rows(self):
        for at, row in self.values.items():
            yield at, *row, at in self.new, self.updates.get(at, 0)


def merge_master(old: DataFrame, new: DataFrame, *, key: str, keep_old: list[str]) -> DataFrame:
    """Full outer upsert by key: new values win, keep_old columns only where they are not null."""
    values = [c for c in old.columns if c != key]
    a, b = old.select(key, F.struct(*values).alias("o")), new.select(key, F.struct(*values).alias("n"))
    both = a.join(b, key, "full_outer")
    pick = lambda c: F.coalesce(f"n.{c}", f"o.{c}") if c in keep_old else F.when(F.col("n").isNotNull(), F.col(f"n.{c}")).otherwise(F.col(f"o.{c}"))
    return both.select(key, *(pick(c).alias(c) for c in values))


def upsert_pages(old: DataFrame, new: DataFrame, *, keys: list[str]) -> DataFrame:
    """Union in which the new row of a key wins; old rows without a new one stay."""
    both = old.withColumn("_age", F.lit(1)).unionByName(new.withColumn("_age", F.lit(0)))
    return keep_first(both, keys, ["_age"]).drop("_age")


def union_if_absent(first: DataFrame, second: DataFrame, *, keys: list[str]) -> DataFrame:
    """All of first, and rows of second whose key first lacks."""
    return first.unionByName(second.join(first.select(*keys).distinct(), keys, "left_anti"))


def with_text_marks(pages: DataFrame, texts: DataFrame, *, key: str) -> DataFrame:
    """pages with has_text; a page without text is a placeholder that waits for one."""
    marks = texts.select(key).distinct().withColumn("_t", F.lit(True))
    return pages.join(marks, key, "left").withColumn("has_text", F.col("_t").isNotNull()).drop("_t")


def to_do(wanted: DataFrame, *done: DataFrame, key: str) -> DataFrame:
    """Wanted rows that are not in every one of the done tables."""
    finished = done[0].select(key)
    for other in done[1:]:
        finished = finished.join(other.select(key), key, "left_semi")
    return wanted.join(finished, key, "left_anti")


def overlay(defaults: DataFrame, saved: DataFrame, *, keys: list[str], value: str, secret: Column | None = None) -> DataFrame:
    """Defaults replaced by saved values, key by key; where secret holds, an empty saved value keeps the default."""
    given = F.col("_saved")
    if secret is not None:
        given = F.when(secret, F.nullif(given, F.lit(""))).otherwise(given)
    both = defaults.join(saved.withColumnRenamed(value, "_saved"), keys, "full_outer")
    return both.select(*keys, F.coalesce(given, F.col(value)).alias(value))


def lookup(df: DataFrame, prices: DataFrame, *, on: str, key: str, values: dict[str, float]) -> DataFrame:
    """Values of a table by key, with defaults for unknown keys."""
    return df.join(prices, F.col(on) == F.col(key), "left").select(*df.columns, *(F.coalesce(c, F.lit(v)).alias(c) for c, v in values.items()))


def first_match(df: DataFrame, other: DataFrame, *, on: str, key: str, order: list) -> DataFrame:
    """Left join with the first row of other for each key."""
    return df.join(keep_first(other, [key], order), F.col(on) == F.col(key), "left")


def external_ids(slugs: DataFrame, books: DataFrame, *, slug: str, id: str, title_slug: Column, prefix: str = "E", longer_than: int = 10) -> DataFrame:
    """The slug itself if it looks like an id, else the id of the first book whose id or title slug it is."""
    by_id = books.select(F.col(id).alias("_a")).filter("_a is not null").distinct()
    by_title = books.filter(F.col(id).isNotNull()).groupBy(title_slug.alias("_t")).agg(F.min(id).alias("_b"))
    looks = F.col(slug).startswith(prefix) & (F.length(slug) > longer_than)
    return slugs.join(by_id, F.col(slug) == F.col("_a"), "left").join(by_title, F.col(slug) == F.col("_t"), "left").select(slug, F.when(looks, F.col(slug)).otherwise(F.coalesce("_a", "_b")).alias("external_id"))


def containing_titles(left: DataFrame, right: DataFrame, *, a: str, b: str, gram: int = 3) -> DataFrame:
    """Pairs of titles one of which contains the other when both are normalised; a left title that is empty
    then meets every right one that is not: all pairs of these, as the rule says.

    Titles of both sides are one table of normalised titles with the sides they are of. They meet
    through the rarest of the shorter one's character grams, not pair by pair; titles under `gram`
    characters meet through their rarest character, which many titles may have."""
    grams = F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length("t") - gram + 1, F.lit(1))), lambda i: F.substring(F.col("t"), i, F.lit(gram))))
    singles = F.array_distinct(F.filter(F.split("t", ""), lambda c: c != ""))
    raw_x = left.select(a, normal_title(F.col(a)).alias("x")).distinct()
    raw_y = right.select(b, normal_title(F.col(b)).alias("y")).filter("y <> ''").distinct()
    sides = raw_x.filter("x <> ''").select(F.col("x").alias("t"), F.lit(1).alias("side")).unionByName(raw_y.select(F.col("y").alias("t"), F.lit(2).alias("side")))
    titles = stored(sides.groupBy("t").agg(F.max(F.col("side") == 1).alias("in_x"), F.max(F.col("side") == 2).alias("in_y")), "titles")
    spread = titles.select("t", "in_x", "in_y", F.explode(F.array_union(grams, singles)).alias("g"))
    often = spread.groupBy("g").agg(F.count("*").alias("n"))
    own = titles.select("t", "in_x", "in_y", F.explode(F.when(F.length("t") >= gram, grams).otherwise(singles)).alias("g"))
    rare = own.join(often, "g").groupBy("t", "in_x", "in_y").agg(F.min_by("g", F.struct("n", "g")).alias("g"))
    met = rare.select(F.col("t").alias("s"), F.col("in_x").alias("sx"), F.col("in_y").alias("sy"), "g").join(spread, "g").filter(F.col("t").contains(F.col("s")))
    up = met.filter("sx and in_y").select(F.col("s").alias("x"), F.col("t").alias("y"))
    down = met.filter("in_x and sy").select(F.col("t").alias("x"), F.col("s").alias("y"))
    pairs = up.unionByName(down).unionByName(titles.filter("in_y").select(F.lit("").alias("x"), F.col("t").alias("y"))).distinct()
    return raw_x.join(pairs, "x").join(raw_y, "y").select(a, b)


def without_page(extras: DataFrame, pages: DataFrame, *, key: str) -> DataFrame:
    """Extras for which there is no page."""
    return extras.join(pages.select(key).distinct(), key, "left_anti")


def reused(wanted: DataFrame, earlier: DataFrame, *, key: str, body: str, fresh: str) -> DataFrame:
    """Wanted keys with the body that an earlier run gave them, or `fresh` where that is blank or missing."""
    return wanted.join(keep_first(earlier.select(key, body), [key], [F.col(body).isNull(), body]), key, "left").withColumn(body, F.coalesce(F.nullif(F.trim(body), F.lit("")), F.lit(fresh)))


def current_versions(rows: DataFrame, *, version: str) -> DataFrame:
    """rows with `current`: is their version the newest one?"""
    newest = rows.agg(F.max(version).alias("_newest"))
    return rows.crossJoin(F.broadcast(newest)).withColumn("current", F.col(version) == F.col("_newest")).drop("_newest")


def count_in_both(a: DataFrame, b: DataFrame, *, key: str) -> DataFrame:
    """One row: how many rows of a have a key that b has, too."""
    return a.join(b.select(key).distinct(), key, "left_semi").agg(F.count("*").alias("n"))


def all_batches(batches: list[DataFrame]) -> DataFrame:
    """All rows of all batches, repeated ones included."""
    return reduce(lambda x, y: x.unionByName(y), batches)


def sorted_distinct(df: DataFrame, *, by: str, value: str, out: str) -> DataFrame:
    """Per key the distinct values in order, comma-joined."""
    return df.groupBy(by).agg(F.array_join(F.array_sort(F.collect_set(value)), ",").alias(out))


def ring_retention(log: DataFrame, *, id: str, keep: int = 5000) -> DataFrame:
    """Rows not more than keep ids older than the newest (so keep + 1 rows of dense ids stay)."""
    newest = log.agg(F.max(id).alias("_max"))
    return log.crossJoin(F.broadcast(newest)).filter(F.col(id) >= F.col("_max") - keep).drop("_max")


def newest_snapshots(snapshots: DataFrame, *, by: list[str], order: list, keep: int = 30) -> DataFrame:
    """The newest `keep` snapshots of each series."""
    return snapshots.withColumn("_n", F.row_number().over(W.partitionBy(*by).orderBy(*order))).filter(F.col("_n") <= keep).drop("_n")


def delete_key(df: DataFrame, gone: DataFrame, *, key: str) -> tuple[DataFrame, DataFrame]:
    """What stays, and one row telling how many rows went."""
    return df.join(gone.select(key).distinct(), key, "left_anti"), df.join(gone.select(key).distinct(), key, "left_semi").agg(F.count("*").alias("removed"))


def point_lookup(df: DataFrame, *, key: str, value: object, defaults: dict[str, object]) -> DataFrame:
    """The row of a key, or one row of defaults."""
    one = df.sparkSession.range(1).select(F.lit(value).alias(key))
    return one.join(df, key, "left").select(key, *(F.coalesce(c, F.lit(v)).alias(c) for c, v in defaults.items()))
