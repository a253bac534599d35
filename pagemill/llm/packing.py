"""Best-fit decreasing packing of token pieces into sequences of a fixed capacity.

Best-fit decreasing needs the lengths in falling order and, for each piece, the tightest
open sequence that still takes it. Pieces of one length are interchangeable, so the whole
assignment follows from the histogram of lengths (at most CAPACITY entries, whatever the
corpus): a segment tree over remaining capacities finds the tightest one in logarithmic
time, and a run of equal pieces fills a run of equally filled sequences in one step. The
resulting plan maps ranks within a length to sequences; its size depends on CAPACITY only.
Ranks are counted in salted groups, so a length that a third of all pieces have is spread.

Defined results: a null or empty text is one piece holding only the end id; a text over
CAPACITY ids is cut into full pieces, its first piece taking the remainder; repeated rows
are packed as often as they occur; an empty table gives an empty result.
"""

from __future__ import annotations

import json
import zlib
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pagemill.llm.common import stored

#: Tokens of a sequence, id after each document.
CAPACITY, END_ID = 2048, 0
#: Pieces of one salted group, about.
GROUP = 1_000_000
PLAN = "length int, first long, after long, each int, sequence long, place int"
_PIECES = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int32()), ("crc", pa.int64()), ("ids", pa.list_(pa.int32()))]))


def vocabulary_path() -> str:
    """The public 50k byte-level BPE vocabulary."""
    return public_tokenizers.path("byte_bpe_50k.json")


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level vocabulary: itself if it shows on paper,
    otherwise the next one from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(0x100 + i): b for i, b in enumerate(rest)}


@lru_cache(maxsize=2)
def encoder(path: str):
    """Byte-pair encoder with the pieces and added tokens of a vocabulary file. It gives the ids that
    the tokenizers library gives, strings of added tokens in a text included, in a sixth of the time."""
    import tiktoken

    with open(path, encoding="utf-8") as file:
        vocabulary = json.load(file)
    special, letters = {t["content"]: t["id"] for t in vocabulary["added_tokens"]}, byte_letters()
    ranks = {bytes(letters[c] for c in piece): rank for piece, rank in vocabulary["model"]["vocab"].items() if piece not in special}
    return tiktoken.Encoding("byte_bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)


def cut(n: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n ids: all full but the first."""
    first = n if n <= capacity else n % capacity or capacity
    return [(0, first), *((start, capacity) for start in range(first, n, capacity))]


def token_pieces(docs: DataFrame, *, key: str = "doc_id", text: str = "text", path: str | None = None, capacity: int = CAPACITY, keep_ids: bool = True) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32 and, if kept, ids."""
    path = path or vocabulary_path()

    @F.arrow_udf(f"array<struct<start:long,length:int,crc:long{',ids:array<int>' if keep_ids else ''}>>")
    def pieces(texts: pa.Array) -> pa.Array:
        encode, rows = encoder(path).encode, []
        for t in texts.to_pylist():
            ids = np.array([*encode(t or "", allowed_special="all"), END_ID], "<u4")
            rows.append([{"start": s, "length": n, "crc": zlib.crc32(part := ids[s : s + n].tobytes()), "ids": np.frombuffer(part, "<i4") if keep_ids else None} for s, n in cut(len(ids), capacity)])
        return pa.array(rows, _PIECES if keep_ids else pa.list_(pa.struct(list(_PIECES.value_type)[:3])))

    found = docs.select(F.col(key).alias("doc_id"), F.posexplode(pieces(F.col(text))).alias("piece", "p"))
    columns = [F.col("p.start").alias("start"), F.col("p.length").cast("long").alias("length"), F.col("p.crc").alias("ids_crc32")]
    return found.select("doc_id", "piece", *columns, *([F.col("p.ids").alias("ids")] if keep_ids else []))


class TightestFit:
    """Segment tree over remaining capacities 0..capacity: which has open sequences."""

    def __init__(self, capacity: int):
        self.size = 1 << capacity.bit_length()
        self.open = [False] * (2 * self.size)

    def mark(self, capacity: int, there: bool) -> None:
        i = capacity + self.size
        self.open[i] = there
        while i > 1:
            i //= 2
            self.open[i] = self.open[2 * i] or self.open[2 * i + 1]

    def least_from(self, length: int) -> int | None:
        """Smallest marked capacity of at least length."""
        i = length + self.size
        while not self.open[i]:
            while i & 1:  # a right child: go up until there is something to the right
                i //= 2
                if i <= 1:
                    return None
            i += 1
        while i < self.size:
            i = 2 * i if self.open[2 * i] else 2 * i + 1
        return i - self.size


def best_fit_plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple]:
    """Best-fit decreasing of a histogram of lengths: rows (length, first rank, after last rank,
    pieces per sequence, first sequence, place of the first piece in each)."""
    tree, spare, plan, opened = TightestFit(capacity), {}, [], 0
    for length in sorted(histogram, reverse=True):
        rank, count = 0, histogram[length]
        while rank < count:
            room = tree.least_from(length)
            if room is None:
                room, n = capacity, -(-(count - rank) // (capacity // length))
                runs = [(opened, opened + n)]
                opened += n
            else:
                runs = spare[room]
                tree.mark(room, False)
                spare[room] = []
            fit, left = room // length, []
            for low, high in runs:
                while low < high and rank < count:
                    rest = count - rank
                    n, each = (min(high - low, rest // fit), fit) if rest >= fit else (1, rest)
                    plan.append((length, rank, rank + n * each, each, low, capacity - room))
                    if remains := room - each * length:
                        spare.setdefault(remains, []).append((low, low + n))
                        tree.mark(remains, True)
                    rank, low = rank + n * each, low + n
                if low < high:
                    left.append((low, high))
            if left:
                spare[room] = spare.get(room, []) + left
                tree.mark(room, True)
    return plan


def pack(docs: DataFrame, *, key: str = "doc_id", text: str = "text", path: str | None = None, capacity: int = CAPACITY, keep_ids: bool = True) -> DataFrame:
    """Pieces of all documents with their sequence_id and offset in it."""
    spark = docs.sparkSession
    cut_up = stored(token_pieces(docs, key=key, text=text, path=path, capacity=capacity, keep_ids=keep_ids), "pieces")
    salts = max(64, cut_up.count() // GROUP)
    salted = cut_up.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(salts)))
    sizes = stored(salted.groupBy("length", "salt").agg(F.count("*").alias("n")), "sizes")
    histogram = {r["length"]: r["n"] for r in sizes.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `capacity` rows
    plan = spark.createDataFrame(best_fit_plan(histogram, capacity), PLAN)
    before = F.sum("n").over(W.partitionBy("length").orderBy("salt")) - F.col("n")
    bases = sizes.select("length", "salt", before.alias("base"))
    within = F.row_number().over(W.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32"))
    ranked = salted.withColumn("within", within).join(bases, ["length", "salt"]).withColumn("rank", F.col("base") + F.col("within") - 1)
    placed = ranked.join(F.broadcast(plan.withColumnRenamed("length", "of")), (F.col("length") == F.col("of")) & (F.col("rank") >= F.col("first")) & (F.col("rank") < F.col("after")))
    nth = F.col("rank") - F.col("first")
    return placed.select(
        "doc_id",
        "piece",
        "start",
        "length",
        "ids_crc32",
        (F.col("sequence") + F.floor(nth / F.col("each"))).cast("long").alias("sequence_id"),
        (F.col("place") + (nth % F.col("each")) * F.col("length")).cast("long").alias("offset"),
        *(["ids"] if keep_ids else []),
    )
