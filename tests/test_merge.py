import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from pagemill.operators import logs, merge


def test_upsert_with_repeated_keys_in_one_batch(spark):
    old = spark.createDataFrame([(1, "K1", None, "One", "a", 10), (2, None, "S2", "Two", "b", 20)], "id long, kid string, sid string, title string, author string, progress int")
    feed = spark.createDataFrame(
        [(1, "K1", None, "One+", "a", None), (2, "K1", "S1", "One++", None, 55), (3, None, "S2", "Two+", "b", None), (4, "K9", None, "New", "z", 1), (5, "K9", None, "New+", "z", None), (6, None, None, "Two", "b", 7)],
        "seq long, kid string, sid string, title string, author string, progress int",
    )
    new, counts = merge.upsert_catalogue(old, feed, id="id", keys=[["kid"], ["sid"], ["title", "author"]], order="seq", keep_old=["sid", "progress"], never=["kid"])
    got = {tuple(r)[1:] for r in new.collect()}
    assert got == {("K1", "S1", "One++", None, 55), (None, "S2", "Two+", "b", 20), ("K9", None, "New+", "z", 1), (None, None, "Two", "b", 7)}
    assert tuple(counts.first()) == (2, 4)


def upsert_loop(old, feed):
    """The catalogue after taking feed rows one by one, by plain loops over lists."""
    books, inserted, updated = {r[0]: list(r[1:]) for r in old}, 0, 0
    high = max(books, default=0)
    for seq, *row in feed:
        kid, sid, title, author, progress = row
        tests = [(kid, lambda b: b[0] == kid), (sid, lambda b: b[1] == sid), (title, lambda b: b[2] == title and (b[3] or "") == (author or ""))]
        found = next((min(ids) for value, test in tests if value is not None and (ids := [i for i, b in books.items() if test(b)])), None)
        if found is None:
            books[high + seq + 1] = row
            inserted += 1
        else:
            was = books[found]
            books[found] = [was[0], was[1] if sid is None else sid, title, author, was[4] if progress is None else progress]
            updated += 1
    return {(i, *b) for i, b in books.items()}, (inserted, updated)


def test_upsert_follows_chains_of_keys_row_by_row(spark):
    rng = random.Random(7)
    some = lambda values: rng.choice([*values, None])
    for trial in range(3):
        n = 12
        old = [(i, f"K{i}" if i % 2 else None, f"S{i}" if i % 3 else None, f"T{i}", some("ab"), i) for i in range(1, n)]
        feed = [(seq, some([f"K{rng.randint(1, 16)}"]), some([f"S{rng.randint(1, 16)}"]), f"T{rng.randint(1, 16)}", some("ab"), some([seq])) for seq in range(60)]
        new, counts = merge.upsert_catalogue(spark.createDataFrame(old, "id long, kid string, sid string, title string, author string, progress int"), spark.createDataFrame(feed, "seq long, kid string, sid string, title string, author string, progress int"), id="id", keys=[["kid"], ["sid"], ["title", "author"]], order="seq", keep_old=["sid", "progress"], never=["kid"], blank=["author"])
        want, sums = upsert_loop(old, feed)
        assert {tuple(r) for r in new.collect()} == want and tuple(counts.first()) == sums


def test_upsert_of_nothing(spark):
    old = spark.createDataFrame([(1, "K1", "One")], "id long, kid string, title string")
    feed = spark.createDataFrame([], "seq long, kid string, title string")
    new, counts = merge.upsert_catalogue(old, feed, id="id", keys=[["kid"], ["title"]], order="seq", keep_old=[], never=[])
    assert [tuple(r) for r in new.collect()] == [(1, "K1", "One")] and tuple(counts.first()) == (0, 0)
    new, counts = merge.upsert_catalogue(old.limit(0), old.select(F.lit(5).cast("long").alias("seq"), "kid", "title"), id="id", keys=[["kid"], ["title"]], order="seq", keep_old=[], never=[])
    assert [tuple(r) for r in new.collect()] == [(6, "K1", "One")] and tuple(counts.first()) == (1, 0)


def test_rows_found_by_a_lasting_key_are_not_chained_by_others(spark, monkeypatch):
    """All rows bring one title, but find their entries by ids that are never updated: no row asks for the title."""
    old = spark.createDataFrame([(i, f"K{i}", f"T{i}") for i in range(20)], "id long, kid string, title string")
    feed = spark.createDataFrame([(seq, f"K{seq % 20}", "T") for seq in range(60)], "seq long, kid string, title string")
    walked, walk = [], merge.walk_in_order
    monkeypatch.setattr(merge, "walk_in_order", lambda df, **how: walked.append(df) or walk(df, **how))
    new, counts = merge.upsert_catalogue(old, feed, id="id", keys=[["kid"], ["title"]], order="seq", keep_old=[], never=["kid"])
    assert {tuple(r) for r in new.collect()} == {(i, f"K{i}", "T") for i in range(20)} and tuple(counts.first()) == (0, 60)
    assert walked[0].select("group").distinct().count() == 20


def test_rows_of_one_key_that_nothing_changes_are_folded_before_they_meet_its_entry(spark, monkeypatch):
    """Rows found by sid, chained by titles, and rows of a title alone: one row of each key is walked."""
    old = [(i, None, f"S{i}", f"T{i}", "a", None) for i in range(1, 4)]
    feed = [(seq, None, f"S{seq % 3 + 1}", f"T{seq % 5}", "ab"[seq % 2], [seq, None][seq % 2]) for seq in range(60)] + [(60 + seq, None, None, "U", ["", None][seq % 2], [None, 7, None][seq % 3]) for seq in range(20)]
    walked, walk = [], merge.walk_in_order
    monkeypatch.setattr(merge, "walk_in_order", lambda df, **how: walked.append(df) or walk(df, **how))
    new, counts = merge.upsert_catalogue(spark.createDataFrame(old, "id long, kid string, sid string, title string, author string, progress int"), spark.createDataFrame(feed, "seq long, kid string, sid string, title string, author string, progress int"), id="id", keys=[["kid"], ["sid"], ["title", "author"]], order="seq", keep_old=["sid", "progress"], never=["kid"], blank=["author"])
    want, sums = upsert_loop(old, feed)
    assert {tuple(r) for r in new.collect()} == want and tuple(counts.first()) == sums == (1, 79)
    assert sum(df.count() for df in walked) == 7


def test_upsert_by_a_key_of_a_new_title_and_a_kept_author(spark):
    """After row 1 the entry is (U, a): its title of the row, its author its own. Row 2 finds it by them."""
    old = spark.createDataFrame([(1, "K1", "T", "a")], "id long, kid string, title string, author string")
    feed = spark.createDataFrame([(1, "K1", "U", None), (2, None, "U", "a")], "seq long, kid string, title string, author string")
    new, counts = merge.upsert_catalogue(old, feed, id="id", keys=[["kid"], ["title", "author"]], order="seq", keep_old=["author"], never=["kid"], blank=["author"])
    assert [tuple(r) for r in new.collect()] == [(1, "K1", "U", "a")] and tuple(counts.first()) == (0, 2)


def test_retention_keeps_one_more_than_named(spark):
    log = spark.range(1, 5003).withColumnRenamed("id", "n")
    assert merge.ring_retention(log, id="n").count() == 5001


def test_overlay_keeps_secret_when_empty(spark):
    defaults = spark.createDataFrame([("a", "x"), ("b", "y"), ("s", "key")], "k string, v string")
    saved = spark.createDataFrame([("b", ""), ("s", ""), ("n", "new")], "k string, v string")
    got = merge.overlay(defaults, saved, keys=["k"], value="v", secret=F.col("k") == "s")
    assert {tuple(r) for r in got.collect()} == {("a", "x"), ("b", ""), ("s", "key"), ("n", "new")}


def test_containing_titles_match_nested_loop(spark):
    left, right = ["deep", "Deep  nets", "a", "xyz", " !", ""], ["deep-nets", "nets", "eep", "b a", "q", "--"]
    bare = lambda t: "".join(c for c in t.lower() if c.isalnum())
    got = merge.containing_titles(spark.createDataFrame([(t,) for t in left], "a string"), spark.createDataFrame([(t,) for t in right], "b string"), a="a", b="b")
    assert {tuple(r) for r in got.collect()} == {(x, y) for x in left for y in right if bare(y) and (bare(x) in bare(y) or bare(y) in bare(x))}


def test_limiter_feedback_and_edges(spark):
    start = datetime(2024, 1, 1)
    at = [0, 1, 2, 3, 4, 5, 6, 7, 8, 9, 299, 300, 301, 302, 303, 900]
    rows = [("ip", i, start + timedelta(seconds=s)) for i, s in enumerate(at)]
    got = logs.rate_limited(spark.createDataFrame(rows, "ip string, n long, ts timestamp"), ip="ip", ts="ts", order="n").orderBy("n").collect()
    kept, want = [], []
    for s in at:
        kept = [t for t in kept if s - t < 300]
        want.append(len(kept) >= 8)
        if not want[-1]:
            kept.append(s)
    assert [r.blocked for r in got] == want and want[8] and not want[11]


def test_lost_jobs_keep_their_error(spark):
    now = datetime(2024, 1, 1, 12)
    rows = [(1, "running", now - timedelta(hours=2), ""), (2, "running", now - timedelta(seconds=599), ""), (3, "cancelling", None, "boom"), (4, "done", None, "")]
    jobs = spark.createDataFrame(rows, "id long, status string, beat timestamp, error string")
    got = logs.reap_lost(jobs, status="status", heartbeat="beat", error="error", as_of=F.lit(now))
    assert {(r.id, r.status, r.error) for r in got.collect()} == {(1, "failed", "heartbeat lost"), (3, "failed", "boom")}


def test_throttle_compares_with_last_sent(spark):
    start = datetime(2024, 1, 1)
    rows = [("j", i, start + timedelta(milliseconds=ms), kind) for i, (ms, kind) in enumerate([(0, "start"), (300, "p"), (700, "p"), (900, "p"), (1000, "end"), (1500, "p"), (1700, "p")])]
    got = logs.throttled(spark.createDataFrame(rows, "job string, n long, ts timestamp, kind string"), by="job", ts="ts", order="n", always=F.col("kind") != "p")
    assert sorted(r.n for r in got.collect()) == [0, 2, 4, 6]
