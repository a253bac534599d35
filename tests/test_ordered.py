import random

import pytest
from pyspark.sql import functions as F

from pagemill.operators import ordered, pages


def one_book(spark, values, column="v"):
    return spark.createDataFrame([("b", i, v) for i, v in enumerate(values, 1)], f"book string, seq long, {column} {'string' if any(isinstance(v, str) for v in values) else 'long'}")


def kept_pages(spark, values):
    return sorted(r.seq for r in ordered.keep_apart(spark.createDataFrame([("b", v) for v in values], "book string, seq long"), ["book"], "seq").collect())


def test_greedy_gap_compares_with_last_kept(spark):
    for values, want in (([3, 5, 7], [3, 7]), ([3, 5, 7, 20, 21], [3, 7, 20]), ([], [])):
        assert kept_pages(spark, values) == want


def greedy_frames(frames, bits=8):
    last, want = None, []
    for seq, h in frames:
        if last is None or (h ^ last).bit_count() > bits:
            want.append(seq)
            last = h
    return want


def test_greedy_loops_on_random_input(spark):
    rng = random.Random(1)
    for _ in range(3):
        values = sorted(rng.sample(range(60), rng.randint(1, 25)))
        kept = []
        for v in values:
            if not kept or v - kept[-1] > 2:
                kept.append(v)
        assert kept_pages(spark, values) == kept
    hashes = [rng.getrandbits(63) for _ in range(3)]
    films = {film: [(i, rng.choice(hashes) ^ (1 << rng.randrange(63))) for i in range(40)] for film in "abc"}
    rows = spark.createDataFrame([(film, *f) for film, frames in films.items() for f in frames], "film string, seq long, h long")
    got = ordered.distinct_frames(rows, ["film"], "seq", "h").collect()
    assert sorted((r.film, r.seq) for r in got) == [(film, seq) for film in "abc" for seq in greedy_frames(films[film])]
    assert ordered.distinct_frames(rows, ["film"], "seq", "h", cap=2).count() == 6


def test_more_frames_than_a_video_has_are_all_kept(spark):
    rng = random.Random(3)
    frames = [(i, rng.getrandbits(63)) for i in range(5000)]
    got = ordered.distinct_frames(spark.createDataFrame([("f", *f) for f in frames], "film string, seq long, h long"), ["film"], "seq", "h")
    want = greedy_frames(frames)
    assert len(want) > ordered.FRAME_CAP and sorted(r.seq for r in got.collect()) == want


def test_places_run_over_the_whole_table(spark):
    rng = random.Random(5)
    rows = [(i, rng.randint(0, 20)) for i in range(500)]
    got = ordered.place_overall(spark.createDataFrame(rows, "i long, v long"), [F.desc("v"), "i"]).collect()
    assert [r.i for r in sorted(got, key=lambda r: r.place)] == [i for i, v in sorted(rows, key=lambda r: (-r[1], r[0]))]
    assert sorted(r.place for r in got) == list(range(1, 501))
    assert ordered.place_overall(spark.createDataFrame([], "i long, v long"), ["v", "i"]).count() == 0


def test_false_chapters_drop(spark):
    got = ordered.drop_regressions(one_book(spark, [1, 1, 2, 2, 0, 3]), ["book"], ["seq"], "v")
    assert sorted(r.seq for r in got.collect()) == [1, 3, 5, 6]


def test_tail_is_trimmed_and_small_runs_refused(spark):
    row = ordered.trim_tail(one_book(spark, list("abcddddd")), ["book"], "seq", "v").first()
    assert (row.tail_run, row.trimmed, row.last_kept, row.rows) == (5, 4, 4, [5, 6, 7, 8])
    row = ordered.trim_tail(one_book(spark, list("abc")), ["book"], "seq", "v").first()
    assert (row.tail_run, row.trimmed, row.last_kept, row.rows) == (1, 0, 3, [])
    with pytest.raises(ValueError):
        ordered.trim_tail(one_book(spark, [1]), ["book"], "seq", "v", min_run=1)


def test_repeats_stop_the_sequence(spark):
    rng = random.Random(2)
    for _ in range(4):
        values = [rng.randint(0, 2) for _ in range(30)]
        want, repeats, last = [], 0, None
        for i, v in enumerate(values, 1):
            if v == last:
                repeats += 1
                if repeats >= 2:
                    break
            else:
                repeats, last = 0, v
                want.append(i)
        got = ordered.take_until_kth_repeat(one_book(spark, values), ["book"], ["seq"], "v")
        assert sorted(r.seq for r in got.collect()) == want


def test_dividers_lay_out_ranges(spark):
    text = "x" * 80
    rows = [("b", p, "" if p in (3, 7) else text) for p in range(1, 11)] + [("c", p, text) for p in range(4, 7)] + [("d", 1, None)]
    got = pages.divider_scaffold(spark.createDataFrame(rows, "book string, page long, text string"), book="book", page="page", text="text")
    assert sorted(map(tuple, got.collect())) == [("b", 1, 3, 6), ("b", 2, 7, 10), ("c", 1, 4, 6), ("d", 1, 1, 1)]


def test_quality_report_flags(spark):
    images = [("ok", i, f"m{i}", "700x500") for i in range(5)] + [("dup", i, f"m{min(i, 4)}", "700x500") for i in range(6)] + [("tie", 0, "a", "2x2"), ("tie", 1, "b", "1x1")]
    got = {r.book: r for r in pages.quality_report(spark.createDataFrame(images, "book string, seq long, digest string, dim string"), book="book", seq="seq", digest="digest", dim="dim").collect()}
    assert got["ok"].ok and not got["dup"].ok and (got["dup"].dup_groups, got["dup"].dup_images) == (1, 2)
    assert got["tie"].main_dim == "2x2"


def test_quality_flags_of_screens_blanks_and_sizes(spark):
    clean = [("clean", i, f"m{i}", "1400x2000", 90 * 1024) for i in range(5)]
    screen = [("screen", i, f"s{i}", "1400x2000" if i < 4 else "2560x1440", 90 * 1024) for i in range(5)]
    blank = [("blank", i, f"b{i}", "1400x2000", 79 * 1024 + 1023 if i else 80 * 1024) for i in range(6)]
    off = [("off", i, f"o{i}", "1x1" if i < 4 else "1400x2000", None) for i in range(20)]
    images = spark.createDataFrame(clean + screen + blank + off, "book string, seq long, digest string, dim string, bytes long")
    got = {r.book: r for r in pages.quality_report(images, book="book", seq="seq", digest="digest", dim="dim", n_bytes="bytes").collect()}
    assert got["clean"].ok and got["clean"].flags == [] and got["clean"].dims == ["1400x2000: 5"]
    assert got["screen"].flags == ["screen size: 1 images, first 4 2560x1440"] and not got["screen"].ok
    assert got["blank"].flags == ["blank: 5 images below 80KB, first 1 79KB, 2 79KB, 3 79KB"] and got["blank"].n_blank == 5
    assert got["off"].flags == ["off size: 4 images off 1400x2000"] and got["off"].dims == ["1x1: 4", "1400x2000: 16"]
    text = {r.book: r.report for r in pages.report_text(pages.quality_report(images, book="book", seq="seq", digest="digest", dim="dim", n_bytes="bytes"), book="book").collect()}
    assert text["clean"].endswith("duplicates or other sizes") and text["screen"].split("\n")[1:] == ["dimensions: 1400x2000: 4, 2560x1440: 1", got["screen"].flags[0]]


def test_contents_block(spark):
    toc = "\n".join(f"Chapter {i} title of it .... {i * 10}" for i in range(1, 7))
    rows = [("b", 1, "Some prose.\nMore prose."), ("b", 2, toc), ("b", 3, toc), ("p", 1, "prose\nprose 1999 was"), ("p", 2, None)]
    frame = spark.createDataFrame(rows, "book string, page long, text string")
    assert sorted((r.book, r.page, r.score) for r in pages.toc_pages(frame, book="book", page="page", text="text").collect()) == [("b", 2, 6), ("b", 3, 6)]
    markers = spark.createDataFrame([("1장 소개\nCHAPTER 2 basics\n제3장 심화\n부록 A 설치",)], "t string").select(pages.chapter_markers(F.col("t")).alias("m")).first().m
    assert {"1", "2", "3", "A"} <= set(markers)


def test_crawl_stops_after_three_empty_pages(spark):
    counts = spark.createDataFrame([("f", i, n) for i, n in enumerate([5, 0, 0, 2, 0, 0, 0, 9, 1])], "feed string, page long, added long")
    assert sorted(r.page for r in ordered.crawl_stop(counts, ["feed"], "page", "added").collect()) == [0, 1, 2, 3, 4, 5, 6, 7, 8]
    more = spark.createDataFrame([("f", i, n) for i, n in enumerate([5, 0, 0, 0, 0, 9])], "feed string, page long, added long")
    assert sorted(r.page for r in ordered.crawl_stop(more, ["feed"], "page", "added").collect()) == [0, 1, 2, 3]
