from pyspark.sql import functions as F

from pagemill.operators import devices, markup, reshape, signatures


def test_average_hash_and_distance(spark):
    frame = spark.createDataFrame([(0, [float(i) for i in range(64)]), (1, [float(63 - i) for i in range(64)])], "id int, v array<double>")
    got = [r.hash for r in signatures.average_hashes(frame, values="v").orderBy("id").collect()]
    assert [h & (2**64 - 1) for h in got] == [0xFFFFFFFF00000000, 0x00000000FFFFFFFF]
    assert frame.select(signatures.average_hash(F.col("v")).alias("h")).first().h == got[0]
    assert spark.range(1).select(signatures.hamming(F.lit(got[0]), F.lit(got[1])).alias("d")).first().d == 64


def test_colours_and_boxes(spark):
    red = [("a", x, y, 200, 10, 10) for x in range(4) for y in range(4)]
    page = [("b", x, y, *((30, 30, 30) if 1 <= x <= 2 and 1 <= y <= 3 else (200, 200, 200))) for x in range(5) for y in range(5)]
    plain = [("c", x, y, 200, 200, 200) for x in range(3) for y in range(2)]
    pixels = spark.createDataFrame(red + page + plain, "image string, x int, y int, r int, g int, b int")
    colours = {r.image: r for r in signatures.dominant_colour(pixels, image="image").collect()}
    assert colours["a"].share == 1 and tuple(colours["a"].colour) == (204, 12, 12)
    assert {tuple(r) for r in signatures.content_box(pixels, image="image").collect()} == {("a", 0, 3, 0, 3), ("b", 1, 2, 1, 3), ("c", 0, 2, 0, 1)}


def test_display_rules(spark):
    rows = [(1, 1512, 2.0, True), (2, 1920, 1.0, False), (3, 1280, 2.0, False), (4, 1170, 2.0, False), (5, 1400, 2.0, False), (6, 1399, 2.0, False), (7, 1000, 1.0, False)]
    got = devices.evaluate_displays(spark.createDataFrame(rows, "id long, w int, s double, builtin boolean"), width="w", scale="s")
    by = {r.id: r for r in got.collect()}
    assert [by[i].meets for i in range(1, 8)] == [True, False, False, False, True, False, False]
    assert (by[1].best_layout, by[2].best_layout, by[7].best_layout) == ("spread", "single", None)
    plans = got.withColumn("g", F.lit("x")).withColumn("prefer", F.lit(5))
    assert devices.plan_display(plans, group="g", id="id", builtin="builtin", prefer="prefer").first().chosen == 5
    assert devices.plan_display(plans.withColumn("prefer", F.lit(7)), group="g", id="id", builtin="builtin", prefer="prefer").first().chosen == 1
    none = devices.plan_display(plans.filter("id > 5"), group="g", id="id", builtin="builtin", prefer="prefer").first()
    assert none.chosen is None and none.override and none.single_page


def test_replies_and_cards(spark):
    replies = spark.createDataFrame([(1, '```json\n{"num": 9, "summary": "s", "topics": ["t"]}'), (2, "no"), (3, None)], "page long, reply string")
    good, bad = reshape.page_replies(replies, page="page", reply="reply")
    assert [(r.num, r.summary) for r in good.collect()] == [(1, "s")] and {r.page for r in bad.collect()} == {2, 3}
    html = spark.createDataFrame([(1, '<li class="c"><b> One </b><i>A</i></li><li class="c"><b>Two</b></li>'), (2, "<div>Three</div>"), (3, "")], "id long, html string")
    got = markup.cards_with_fallback(html, id="id", html="html", first=(r"<li class=\"c\">.*?</li>", {"title": "<b>(.*?)</b>", "author": "<i>(.*?)</i>"}), second=(r"<div>.*?</div>", {"title": "<div>(.*?)</div>", "author": "<i>(.*?)</i>"}))
    assert {(r.id, r.title, r.author, r.by) for r in got.collect()} == {(1, "One", "A", "first"), (1, "Two", None, "first"), (2, "Three", None, "second")}
