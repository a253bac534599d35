import random

from pagemill.operators import chapters as ch


def tree(spark, pages):
    frame = spark.createDataFrame([("b", *p) for p in pages], "book string, num long, sid string, title string")
    return ch.flat_tree(ch.chapter_tree(ch.chapter_rows(frame, book="book", page="num", section="sid", title="title"))).orderBy("page").collect()


def test_tree_of_chapters_and_sections(spark):
    got = tree(spark, [(1, "1장", "1장 첫걸음"), (2, "1.1", "1.1 개요"), (3, "1.1", None), (4, "2장", "2장 심화"), (5, "2.1", "2.1 응용")])
    assert [(r.chapter, r.section, r.page) for r in got] == [("1장 첫걸음", "1.1 개요", 2), ("1장 첫걸음", "1.1 개요", 3), ("2장 심화", "2.1 응용", 5)]


def test_plain_pages_are_one_chapter(spark):
    got = tree(spark, [(1, "", None), (2, "", None), (3, "", None)])
    assert {(r.section, r.page, r.label) for r in got} == {("기타", 1, "p.1"), ("기타", 2, "p.2"), ("기타", 3, "p.3")}


def loop_tree(pages):
    """(chapter number, section title, page) by a walk over the pages as the rules describe them."""
    placed, chapter, section, before, known = [], 0, None, None, False
    for num, sid, title in pages:
        kind = "C" if ("장" in sid and "." not in sid) or "Part" in sid else "S" if title is not None and "." in sid else "P"
        if kind == "C" or (kind == "P" and before is None):
            chapter, known = chapter + 1, True
        if kind == "C":
            section = None
        elif kind == "S":
            section = title or sid
        elif section is None:
            section = sid or ch.OTHER
        if kind != "C":
            placed.append((chapter, section, num))
        before = kind
    return [p for p in placed if p[0]] if known else [(1, ch.ALL_PAGES, num) for num, _, _ in pages]


def test_tree_matches_walk_on_random_pages(spark):
    rng = random.Random(6)
    rows, want = [], []
    for book in range(60):
        pages = [(n, *rng.choice([("1장", "t"), ("2장", None), ("Part 3", None), ("1.1", "s"), ("2.2", "u"), ("1.1", None), ("", None), ("", None)])) for n in range(1, rng.randint(2, 12))]
        rows += [(book, *p) for p in pages]
        want += [(book, *p) for p in loop_tree(pages)]
    frame = spark.createDataFrame(rows, "book long, num long, sid string, title string")
    got = ch.chapter_rows(frame, book="book", page="num", section="sid", title="title").filter("section is not null").collect()
    assert sorted((r.book, r.chapter_no, r.section, r.page) for r in got) == sorted(want)


def test_located_chapters_move_on_only_when_found(spark):
    pages = [("b", 1, "contents"), ("b", 2, "Chapter 1\nDeep nets"), ("b", 3, "Deep nets again"), ("b", 4, "1장 Tail"), ("b", 5, "Chapter 3\nOther"), ("b", 6, "Last words")]
    contents = [("b", 1, 1, "Deep nets"), ("b", 2, 2, "Missing title"), ("b", 3, 3, "Nothing"), ("b", 4, 0, "Last words")]
    got = ch.locate_chapters(spark.createDataFrame(pages, "book string, page long, text string"), spark.createDataFrame(contents, "book string, pos int, num int, title string"))
    assert [(r.pos, r.start, r.score) for r in got.orderBy("pos").collect()] == [(1, 2, 3), (3, 5, 2), (4, 6, 1)]


def test_dates_of_imprint_pages(spark):
    rows = [("b", 1, "2021년 3월 5일 초판 발행 … 2023년 1월 2일 2쇄 발행, 1970년 1월 1일"), ("b", 2, "2019년 1월 1일"), ("c", 1, "2020년 2월 31일 발행"), ("d", 7, "발행 2021년 13월 1일")]
    got = ch.publication_dates(spark.createDataFrame(rows, "book string, page long, text string"), book="book", page="page", text="text")
    assert {r.book: (r.pub_date, r.revision_date) for r in got.collect()} == {"b": ("2021-03-05", "2023-01-02"), "c": ("2020-02-31", None)}


def test_chapter_text_is_cut(spark):
    pages = spark.createDataFrame([("b", i, "<p>" + "x" * 30 + "</p>") for i in range(1, 50)], "book string, page long, text string")
    chapters = spark.createDataFrame([("b", 1, 2, 40)], "book string, num int, start long, end long")
    assert ch.chapter_texts(pages, chapters, text="text", limit=65).first().text == "\n".join(f"[p.{i}] " + "x" * 30 for i in (2, 3))[:65]


def test_chapter_text_has_labels_and_points(spark):
    rows = [("b", 3, " <b>One</b>\u3000two\n", ["<i>first</i>", " second\t"]), ("b", 4, None, []), ("b", 5, "end", None), ("c", 3, "other", ["x"])]
    pages = spark.createDataFrame(rows, "book string, page long, text string, points array<string>")
    chapters = spark.createDataFrame([("b", 7, 3, 9)], "book string, num int, start long, end long")
    got = ch.chapter_texts(pages, chapters, text="text", points="points").collect()
    assert [(r.book, r.num, r.text) for r in got] == [("b", 7, "[p.3] One \u3000two / 핵심: first; second\n[p.4] \n[p.5] end")]


def test_pages_meet_ranges_by_an_ordered_merge(spark):
    rng = random.Random(5)
    starts, pages = [], []
    for book in ("a", "b", "big", None):
        edges = sorted(rng.sample(range(1, 4000), 30 if book == "big" else 5))
        starts += [(book, n, s, (e - 1) if n % 4 else min(s + 2, e - 1)) for n, (s, e) in enumerate(zip(edges, [*edges[1:], 4100], strict=True), 1)]
        pages += [(book, p) for p in rng.sample(range(0, 4200), 3000 if book == "big" else 60)]
    pages += [("unknown", 5), ("a", 17), ("a", 17)]
    chapters = spark.createDataFrame(starts, "book string, num int, start int, end int")
    found = ch.chapters_of_pages(spark.createDataFrame(pages, "book string, page int"), chapters, front=True)
    firsts = {b: min(s for x, _, s, _ in starts if x == b) for b, *_ in starts}
    want = [(b, p, n) for b, p in pages for x, n, s, e in starts if x == b and s <= p <= e]
    want += [(b, p, 0) for b, p in pages if b is not None and 1 <= p < firsts.get(b, 0)]
    assert sorted(map(repr, map(tuple, found.collect()))) == sorted(map(repr, want))
    assert "Generate" not in found._jdf.queryExecution().executedPlan().toString()
    assert ch.chapters_of_pages(spark.createDataFrame([], "book string, page int"), chapters).count() == 0


def test_report_of_chapters(spark):
    rows = [("b", 1, "1장", "T"), ("b", 2, "1.1", "S"), ("b", 3, "", None), ("b", 4, "1.2", "S2"), ("b", 5, "2장", None)]
    tree = ch.chapter_rows(spark.createDataFrame(rows, "book string, page int, sid string, title string"), book="book", page="page", section="sid", title="title")
    assert [(r.chapter, r.pages, r.sections, r.intro_page) for r in ch.chapter_report(tree).orderBy("chapter_no").collect()] == [("T", 4, 2, 1), ("2장", 1, 0, 5)]


def test_chapter_texts_whose_line_end_is_the_last_character(spark):
    """A first line one short of the limit: the line end before the next page is the last character."""
    pages = spark.createDataFrame([("b", 1, "x" * 14), ("b", 2, "y"), ("b", 3, "z" * 15), ("b", 4, "y"), ("b", 5, "x" * 14)], "book string, page long, text string")
    chapters = spark.createDataFrame([("b", 1, 1, 2), ("b", 2, 3, 4), ("b", 3, 5, 5)], "book string, num int, start long, end long")
    got = {r.num: r.text for r in ch.chapter_texts(pages, chapters, text="text", limit=21).collect()}
    assert got == {1: "[p.1] " + "x" * 14 + "\n", 2: "[p.3] " + "z" * 15, 3: "[p.5] " + "x" * 14}


def test_titles_are_found_in_books_of_few_and_many(spark, monkeypatch):
    """A title of a book with few titles meets no gram; both ways give all pages that contain a title."""
    asked = []
    by_grams = ch.title_hits_by_grams
    monkeypatch.setattr(ch, "title_hits_by_grams", lambda pages, long: asked.append((pages, long)) or by_grams(pages, long))
    monkeypatch.setattr(ch, "FEW_TITLES", 3)
    rng = random.Random(5)
    word = lambda n: "".join(rng.choice("ab") for _ in range(n))
    titles = [(b, p, word(rng.choice((3, 4, 5)))) for b, n in (("few", 3), ("many", 20)) for p in range(n)]
    pages = [(b, p, word(rng.randrange(12))) for b in ("few", "many", "none") for p in range(60)]
    got = ch.title_hits(spark.createDataFrame(pages, "book string, page long, text string"), spark.createDataFrame(titles, "book string, pos int, title string")).collect()
    want = [(b, p, page) for b, p, t in titles for c, page, text in pages if b == c and len(t) >= 4 and t in text]
    assert sorted(map(tuple, got)) == sorted(want) and {r.book for r in got} == {"few", "many"}
    assert {r.book for df in asked[0] for r in df.select("book").distinct().collect()} == {"many"}
