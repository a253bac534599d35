import unicodedata

from pyspark.sql import functions as F

from pagemill.functions import text as fx
from pagemill.functions import web


def column(spark, values, make):
    frame = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r.x for r in frame.select("i", make(F.col("v")).alias("x")).orderBy("i").collect()]


def test_titles_normalise(spark):
    values = ["  1장  나의 첫! 머신러닝 ", "Deep Learning", "", unicodedata.normalize("NFD", "교보"), "교보", None]
    got = column(spark, values, fx.normal_title)
    assert got[:3] == ["1장나의첫머신러닝", "deeplearning", ""] and got[3] == got[4] == "교보" and got[5] == ""


def test_chapter_ids(spark):
    pairs = [("3장", ""), ("제5장", ""), ("Part 2", ""), ("", "5장 신경망"), ("", "Part 3 심화"), ("1.1", "소제목"), ("", "")]
    frame = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "i int, s string, t string")
    got = [r.x for r in frame.select("i", fx.chapter_id(F.col("s"), F.col("t")).alias("x")).orderBy("i").collect()]
    assert got == ["chs-chapter-3", "", "chs-part-2", "chs-chapter-5", "chs-part-3", "", ""]


def test_numbers_in_text(spark):
    assert column(spark, ["49%(251/508p)", "20/508p", "none", None], fx.reading_position) == [251, 20, None, None]
    assert column(spark, ["37%", " 12", "x", None], fx.leading_int) == [37, 12, 0, 0]
    assert column(spark, ["12%", "12", "x"], fx.int_or_null) == [None, 12, None]
    assert column(spark, ["[ocr]   12/185 done", "[summarize] 47/185 (25%)", "[12/300] 캡처 중", "?"], fx.progress) == [(12, 185), (47, 185), (12, 300), None]


def test_names_and_links(spark):
    assert column(spark, ["[책] My  Book", "a b"], fx.slug) == ["My_Book", "a_b"]
    assert column(spark, ["0123456789abcdef", "short", None], fx.masked_secret) == ["0123456...cdef", "***", "***"]
    assert column(spark, ["http://h/books/a%20b?x=1", "http://h/other"], lambda c: fx.path_after(c, "books")) == ["a b", None]
    assert column(spark, ["http://h/x?id=7", "http://h/x/y9/", "http://h"], lambda c: fx.link_id(c, ("id",)))[:2] == ["7", "y9"]
    assert column(spark, ["<a&b>"], fx.html_escaped) == ["&lt;a&amp;b&gt;"]


def test_addresses(spark):
    local = ["127.0.0.1", "10.1.1.1", "172.31.0.1", "192.168.1.1", "169.254.0.9", "::1", "fe80::2", "fd00::1"]
    other = ["172.32.0.1", "8.8.8.8", "256.1.1.1", "2001:db8::1", "", None]
    assert column(spark, local + other, web.is_local) == [True] * len(local) + [False] * len(other)
    frame = spark.createDataFrame([(0, "1.1.1.1, 2.2.2.2", "3.3.3.3", "9.9.9.9"), (1, "", "3.3.3.3", "9.9.9.9"), (2, None, None, "9.9.9.9")], "i int, f string, r string, p string")
    assert [r.x for r in frame.select("i", web.real_ip(F.col("f"), F.col("r"), F.col("p")).alias("x")).orderBy("i").collect()] == ["1.1.1.1", "3.3.3.3", "9.9.9.9"]


def test_addresses_by_networks(spark):
    """As ipaddress has them; an address is worked out once, however it is made."""
    import ipaddress
    import random

    rng = random.Random(7)
    edge = [0, 9, 10, 11, 15, 16, 31, 32, 99, 100, 126, 127, 128, 168, 169, 172, 192, 199, 200, 249, 250, 254, 255]
    v4 = [".".join(str(rng.choice(edge)) for _ in range(4)) for _ in range(4000)] + [f"{a}.{b}.3.4" for a in (10, 127, 169, 172, 192) for b in range(256)]
    nets = [ipaddress.ip_network(n) for n in ("127.0.0.0/8", "10.0.0.0/8", "172.16.0.0/12", "192.168.0.0/16", "169.254.0.0/16")]
    want = [any(ipaddress.ip_address(a) in n for n in nets) for a in v4]
    odd = {"010.1.1.1": True, "10.256.1.1": False, "10.1.1": False, "::1": True, "::11": False, "FE80::1": True, "fec0::1": False, "FD00::": True, "x10.1.1.1": False, "10.1.1.1 ": False}
    assert column(spark, v4 + list(odd), web.is_local) == want + list(odd.values())
    frame = spark.range(1).select(web.is_local(F.upper(F.col("id").cast("string"))).alias("x"))
    assert frame._jdf.queryExecution().analyzed().toString().count("upper(") == 1
