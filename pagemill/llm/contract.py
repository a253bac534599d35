"""Contract queries of the training-data operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagemill.llm import ann, byte_repeats, collocations, decontaminate, language, merkle, near_dup, packing, quality, scoring, search, secrets, word_repeats
from pagemill.llm.common import remainder, table


def op1_secrets(spark, sf_dir):
    return secrets.secret_digest(table(spark, sf_dir, "documents"))


def op2_simhash(spark, sf_dir):
    return near_dup.near_duplicates(table(spark, sf_dir, "documents"))


def op3_word_repeats(spark, sf_dir):
    return word_repeats.word_repeats(table(spark, sf_dir, "documents")).drop("spans")


def op4_quality(spark, sf_dir):
    learn = remainder("doc_id", 4) != 2
    scored = quality.score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), learn)
    return scored.select("doc_id", F.coalesce(remainder("doc_id", 4) == 2, F.lit(False)).alias("held_out"), "score", "predicted")


def op5_topk(spark, sf_dir):
    return search.top_inner_products(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op6_packing(spark, sf_dir):
    return packing.pack(table(spark, sf_dir, "documents"), keep_ids=False)


def op7_decontaminate(spark, sf_dir):
    found = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    digest = F.sha2(F.array_join("items", ","), 256).alias("items_sha256")
    return found.select("doc_id", "n_words", "n_hit", "n_items", digest, "contaminated")


def op8_scoring(spark, sf_dir):
    docs, left_out = table(spark, sf_dir, "documents"), remainder("doc_id", 7) == 2
    scored = scoring.score_documents(docs, ~left_out)
    return scored.select("doc_id", F.coalesce(remainder("doc_id", 7) == 2, F.lit(False)).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", "bits_per_byte")


def op9_byte_repeats(spark, sf_dir):
    return byte_repeats.byte_repeats(table(spark, sf_dir, "documents")).drop("spans")


def op10_language(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(remainder("doc_id", 3) == 1, F.lit(False))
    model = language.fit_language(docs.filter(~held_out))  # a row without id is not learnt from
    found = docs.select("doc_id", held_out.alias("held_out"), language.language_of(F.col("text"), model, spark).alias("found"))
    return found.select("doc_id", "held_out", F.col("found.lang").alias("lang_pred"), F.col("found.score").alias("score"))


def op11_manifest(spark, sf_dir):
    stripped = F.when(remainder("doc_id", 2) == 0, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    return merkle.tamper_report(table(spark, sf_dir, "documents"), stripped)


def op12_nearest(spark, sf_dir):
    return ann.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op13_collocations(spark, sf_dir):
    return collocations.collocations(table(spark, sf_dir, "documents"))


def queries() -> dict:
    return {name: run for name, run in globals().items() if name.startswith("op") and name[2].isdigit()}


OP3_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x{20}\x{09}-\x{0D}]+'), []) AS w FROM documents),
g AS (SELECT doc_id, s, hash(array_to_string(w[s:s + 12], ' ')) AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS s FROM d)),
f AS (SELECT g, min(doc_id) AS first FROM g GROUP BY g),
c AS (SELECT DISTINCT doc_id, unnest(range(s, s + 13)) AS p FROM g JOIN f USING (g) WHERE first < doc_id),
r AS (SELECT doc_id, count(*) AS n_removed, list(p) AS gone FROM c GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_removed, 0) AS n_removed,
       sha256(coalesce(array_to_string(list_filter(w, lambda x, i: NOT list_contains(coalesce(gone, []), i)), ' '), '')) AS kept_sha256
FROM d LEFT JOIN r USING (doc_id)
"""

OP5_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE)) AS v FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, p.vec_id, CAST(list_dot_product(q.v, p.v) AS BIGINT) AS score
      FROM v q JOIN v p ON q.vec_id <> p.vec_id WHERE q.vec_id % 50 = 0),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT * FROM r WHERE rank <= 5
"""

_WORD = r"[^\x{00}-\x{2F}\x{3A}-\x{60}\x{7B}-\x{7F}]+"
_FOLD = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP7_SQL = f"""
WITH d AS (SELECT doc_id, coalesce(regexp_extract_all({_FOLD.format("text")}, '{_WORD}'), []) AS w FROM documents),
i AS (SELECT item_id, coalesce(regexp_extract_all({_FOLD.format("text")}, '{_WORD}'), []) AS w FROM benchmark),
iw AS (SELECT DISTINCT item_id, least(13, len(w)) AS n, array_to_string(w[s:s + 12], ' ') AS g
       FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS s FROM i WHERE len(w) > 0)),
ns AS (SELECT DISTINCT n FROM iw),
dw AS (SELECT doc_id, s, n, array_to_string(w[s:s + n - 1], ' ') AS g
       FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM d, ns WHERE len(w) >= n)),
m AS (SELECT DISTINCT doc_id, s, dw.n, item_id FROM dw JOIN iw USING (g, n)),
h AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS p FROM m) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
      FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM m) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN t USING (doc_id)
"""

_LEAF = "CASE WHEN {0} IS NULL THEN '-' ELSE strlen(CAST({0} AS VARCHAR)) || ':' || {0} END"


def _leaf_sql(text: str) -> str:
    return "sha256(" + " || ".join(_LEAF.format(c) for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"


#: CRC-32 of an id's decimal digits, from its polynomial.
_CRC_TABLE = "t AS MATERIALIZED (SELECT list_transform(range(256), lambda i: list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i)) AS t)"
_CRC = "xor(list_reduce(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT)), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]), 4294967295), 4294967295)"

OP11_SQL = f"""
WITH RECURSIVE {_CRC_TABLE},
d AS MATERIALIZED (SELECT *, CASE WHEN crc % 2 = 0 THEN replace(text, chr(10), '') ELSE text END AS other FROM (SELECT doc_id, source, lang, n_chars, text, {_CRC} AS crc FROM documents, t)),
l AS MATERIALIZED (SELECT doc_id, source, {_leaf_sql("text")} AS leaf, {_leaf_sql("other")} AS seen FROM d),
f AS MATERIALIZED (SELECT source, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS g FROM (SELECT DISTINCT source FROM l)),
p AS MATERIALIZED (SELECT doc_id, leaf, seen, g, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY g) AS n FROM l JOIN f ON l.source IS NOT DISTINCT FROM f.source),
up AS (SELECT g, 0 AS lvl, pos, leaf AS h, n FROM p UNION ALL SELECT g, lvl + 1, pos // 3, sha256(string_agg(h, '' ORDER BY pos)), any_value((n + 2) // 3) FROM up WHERE n > 1 GROUP BY g, lvl, pos // 3),
s AS (SELECT g, h AS subroot FROM up WHERE n = 1),
top AS (SELECT 0 AS lvl, g AS pos, subroot AS h, count(*) OVER () AS n FROM s UNION ALL SELECT lvl + 1, pos // 3, sha256(string_agg(h, '' ORDER BY pos)), any_value((n + 2) // 3) FROM top WHERE n > 1 GROUP BY lvl, pos // 3),
r AS (SELECT h AS root FROM top WHERE n = 1),
k AS (SELECT a.g, a.lvl, a.pos, coalesce(string_agg(b.h, '' ORDER BY b.pos) FILTER (WHERE b.pos < a.pos), '') AS lft, coalesce(string_agg(b.h, '' ORDER BY b.pos) FILTER (WHERE b.pos > a.pos), '') AS rgt FROM up a JOIN up b ON a.g = b.g AND a.lvl = b.lvl AND a.pos // 3 = b.pos // 3 WHERE a.n > 1 GROUP BY ALL),
kt AS (SELECT a.lvl, a.pos, coalesce(string_agg(b.h, '' ORDER BY b.pos) FILTER (WHERE b.pos < a.pos), '') AS lft, coalesce(string_agg(b.h, '' ORDER BY b.pos) FILTER (WHERE b.pos > a.pos), '') AS rgt FROM top a JOIN top b ON a.lvl = b.lvl AND a.pos // 3 = b.pos // 3 WHERE a.n > 1 GROUP BY ALL),
fold AS (SELECT doc_id, leaf, g, pos AS own, 0 AS lvl, pos, seen AS h, '' AS proof FROM p UNION ALL SELECT doc_id, leaf, fold.g, own, fold.lvl + 1, fold.pos // 3, sha256(lft || h || rgt), proof || lft || rgt FROM fold JOIN k ON k.g = fold.g AND k.lvl = fold.lvl AND k.pos = fold.pos),
up_to AS (SELECT g, own, doc_id, leaf, max_by(h, lvl) AS h, max_by(proof, lvl) AS proof FROM fold GROUP BY ALL),
ft AS (SELECT g, own, doc_id, leaf, 0 AS lvl, g AS pos, h, proof FROM up_to UNION ALL SELECT g, own, doc_id, leaf, ft.lvl + 1, ft.pos // 3, sha256(lft || h || rgt), proof || lft || rgt FROM ft JOIN kt ON kt.lvl = ft.lvl AND kt.pos = ft.pos),
e AS (SELECT g, own, doc_id, leaf, max_by(h, lvl) AS folded_root, max_by(proof, lvl) AS proof FROM ft GROUP BY ALL)
SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, folded_root, folded_root = root AS verified FROM e JOIN s USING (g), r
"""

OP13_SQL = rf"""
WITH p AS (SELECT lang, row_number() OVER () AS p, regexp_extract_all(piece, '[^\x{{20}}\x{{09}}]+') AS w FROM (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array({_FOLD.format("text")}, '[.,;:!?\x{{0A}}-\x{{0D}}]')) AS piece FROM documents)),
g AS (SELECT lang, k, w[s:s + k - 1] AS w FROM (SELECT lang, k, w, unnest(range(1, len(w) - k + 2)) AS s FROM p, (SELECT unnest([1, 2, 3, 4]) AS k) WHERE len(w) >= k)),
f AS MATERIALIZED (SELECT lang, k, w, count(*) AS f FROM g GROUP BY ALL),
n AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM f WHERE k = 1 GROUP BY lang),
c AS MATERIALIZED (SELECT lang, k, w, f AS a FROM f WHERE k > 1 AND f >= 30),
s AS (SELECT lang, w[i:i + m - 1] AS w, max(a) AS more FROM (SELECT lang, w, a, m, unnest(range(1, k - m + 2)) AS i FROM (SELECT *, unnest(range(2, k)) AS m FROM c)) GROUP BY ALL),
o AS (SELECT c.* FROM c LEFT JOIN s USING (lang, w) WHERE more IS NULL OR 100 * more < 80 * a),
u AS (SELECT o.lang, o.k, o.w, a, x.f AS l, y.f AS r, CAST(2000000 * CAST(a AS HUGEINT) // (x.f + y.f) AS BIGINT) AS score, i FROM (SELECT *, unnest(range(1, k)) AS i FROM o) o
      JOIN f x ON x.lang = o.lang AND x.w = o.w[1:i] JOIN f y ON y.lang = o.lang AND y.w = o.w[i + 1:]),
b AS (SELECT * FROM u QUALIFY row_number() OVER (PARTITION BY lang, w ORDER BY score, i) = 1),
t AS (SELECT lang, array_to_string(w, ' ') AS phrase, a, l, r, score FROM b)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score FROM t JOIN n USING (lang) QUALIFY rank <= 2000
"""


def oracle_sql() -> dict:
    return {"op3_word_repeats": OP3_SQL, "op5_topk": OP5_SQL, "op7_decontaminate": OP7_SQL, "op11_manifest": OP11_SQL, "op13_collocations": OP13_SQL}
