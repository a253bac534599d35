import hashlib
import zlib
from itertools import groupby

from pyspark.sql import functions as F

from pagemill.llm import merkle
from pagemill.llm.common import remainder


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    return sha(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def levels(nodes):
    """All levels of one tree, leaves first."""
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([sha(*out[-1][i : i + 3]) for i in range(0, len(out[-1]), 3)])
    return out


def fold(node, at, tree):
    """Folded root and the siblings of a node at `at`."""
    seen = []
    for level in tree[:-1]:
        run = level[at // 3 * 3 : at // 3 * 3 + 3]
        k = at % 3
        seen += run[:k] + run[k + 1 :]
        node, at = sha(*run[:k], node, *run[k + 1 :]), at // 3
    return node, seen


def plain(rows):
    order = sorted(rows, key=lambda r: (r[1] is not None, (r[1] or "").encode(), r[0] is not None, r[0] or 0, leaf(r)))
    groups = [list(g) for _, g in groupby(order, key=lambda r: r[1])]
    trees = [levels([leaf(r) for r in g]) for g in groups]
    top = levels([t[-1][0] for t in trees])
    out = []
    for i, (group, tree) in enumerate(zip(groups, trees, strict=True)):
        for at, row in enumerate(group):
            tampered = row[0] is not None and zlib.crc32(str(row[0]).encode()) % 2 == 0 and row[4] is not None
            other = (*row[:4], row[4].replace("\n", "")) if tampered else row
            node, low = fold(leaf(other), at, tree)
            folded, high = fold(node, i, top)
            out.append((row[0], leaf(row), tree[-1][0], top[-1][0], sha(*low, *high), folded, folded == top[-1][0]))
    return out


SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, part int, hash string, pos long"


def found(spark, rows):
    docs = spark.createDataFrame([(*r, 7, "x", 9) for r in rows], SCHEMA)
    stripped = F.when(remainder("doc_id", 2) == 0, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    return [tuple(r) for r in merkle.tamper_report(docs, stripped).collect()]


def key(row):
    return repr(row)


def test_equals_plain_trees(spark):
    rows = [(i, None if i % 11 == 0 else f"s{i % 4 if i % 3 else 0}", "en" if i % 5 else None, i, f"line {i}\nand {'more ' * (i % 7)}") for i in range(140)]
    rows += [(200, "alone", "en", 1, "a\n"), (201, "é", None, None, None), (202, "é", "de", 0, ""), (203, "z" * 3, "en", 5, "long\n" * 60_000)]
    got = found(spark, rows)
    assert sorted(got, key=key) == sorted(plain(rows), key=key)
    assert {r[-1] for r in got} == {True, False}


def test_ties_nulls_and_empty_tables(spark):
    rows = [(1, "s", "en", 1, "same\n")] * 5 + [(None, "s", "en", 1, "a\nb"), (None, None, None, None, None), (1, "s", "en", 1, "other")]
    assert sorted(found(spark, rows), key=key) == sorted(plain(rows), key=key)
    assert found(spark, []) == []
    assert found(spark, rows[:1]) == plain(rows[:1])


def test_one_source_holds_nearly_all_rows(spark):
    rows = [(i, "big" if i else "small", None, None, f"{i % 3}\n") for i in range(400)]
    assert sorted(found(spark, rows), key=key) == sorted(plain(rows), key=key)


def test_path_of_other_fanout_leads_to_root(spark):
    docs = spark.createDataFrame([(i, "a" if i % 3 else "b", f"t{i}") for i in range(50)], "id long, family string, body string")
    rows = merkle.manifest(docs, key="id", group="family", columns=("id", "body"), fanout=5)
    assert rows.filter(merkle.fold_path(F.col("leaf"), F.col("path")) != F.col("root")).count() == 0
    assert rows.count() == 50 and rows.select("root").distinct().count() == 1
