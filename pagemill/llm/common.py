"""Shared helpers: table access, shared storage, and vectorised views of text columns.

Text batches are handled as one byte buffer plus document offsets, so that words,
windows and rolling hashes are numpy passes and no Python loop runs per word.
"""

from __future__ import annotations

import hashlib
import uuid
from contextlib import contextmanager
from contextvars import ContextVar

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Documents of one Arrow batch are worked on in runs of about this many bytes.
RUN_BYTES = 1 << 20

#: ASCII white space that splits words: 0x20 and 0x09 to 0x0D.
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True

#: Maps A-Z to a-z and every other byte to itself.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


#: Bytes of an Arrow batch of texts at most, unless the session sets a bound of its own.
BATCH_BYTES, _BATCH = 8 << 20, "spark.sql.execution.arrow.maxBytesPerBatch"


def bounded_batches(spark: SparkSession) -> None:
    """Bound the bytes that go to a Python worker at once: ten thousand texts may be any size."""
    if spark.conf.get(_BATCH, None) is None:
        spark.conf.set(_BATCH, str(BATCH_BYTES))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bounded_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def workspace(spark: SparkSession) -> str:
    """Shared folder for intermediate tables: the one the cluster names in spark.checkpoint.dir.
    Without one, executors of a cluster would each write to a folder of their own: an error."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return named


#: Spark's setting by which the shuffle files of a query go when the query has ended.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write df to the shared folder and read it back: cuts lineage and survives lost executors.
    The shuffle files of the write are not read again and go with its end."""
    spark = df.sparkSession
    bounded_batches(spark)
    path = f"{workspace(spark).rstrip('/')}/pagemill-{label}-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_in = path
    made = _MADE.get()
    if made is not None:
        made.append(out)
    return out


_MADE: ContextVar[list | None] = ContextVar("made", default=None)


@contextmanager
def scratch():
    """The list of tables that are stored inside, for deleting those that nothing outside reads."""
    made: list[DataFrame] = []
    token = _MADE.set(made)
    try:
        yield made
    finally:
        _MADE.reset(token)


def dropped(*tables: DataFrame) -> None:
    """Delete stored tables that no later step reads; one that is gone already is no error."""
    for df in tables:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.stored_in)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def free_name(df: DataFrame, name: str) -> str:
    """name, with as many underscores as keep it apart from the columns of df."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def buckets_for(spark: SparkSession, items: float, per_bucket: int = 2_000_000) -> int:
    """Number of hash buckets: grows with the items, so that a bucket's size does not."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), int(items // per_bucket) + 1)


def remainder(key: str, modulus: int):
    """crc32 of the key as text, modulo; null keys have none."""
    return F.crc32(F.col(key).cast("string")) % modulus


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string column end to end, and the offsets of its rows; null rows are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()).fill_null(b"")
    if len(column) == 0:
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    return whole[at[0] : at[-1]], at - at[0]


def runs(offsets: np.ndarray, limit: int = RUN_BYTES):
    """(first, after last) row of consecutive runs of at most limit bytes, one row at least."""
    first, n = 0, len(offsets) - 1
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1
        last = min(max(last, first + 1), n)
        yield first, last
        first = last


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of every word (a maximal run of other than SPACE within a row)."""
    if not len(data):
        none = np.empty(0, np.int64)
        return none, none, none
    solid = ~SPACE[data]
    border = np.zeros(len(data) + 1, dtype=bool)  # a row starts here
    border[offsets] = True
    before = np.empty_like(solid)
    before[0], before[1:] = False, solid[:-1]
    starts = np.flatnonzero(solid & (~before | border[:-1]))
    after = np.empty_like(solid)
    after[-1], after[:-1] = False, solid[1:]
    ends = np.flatnonzero(solid & (~after | border[1:])) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values whose every output bit depends on all input bits."""
    x = x.astype(np.uint64, copy=True)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x ^= x >> np.uint64(shift)
        x *= np.uint64(factor)
    x ^= x >> np.uint64(31)
    return x


#: Spans of more bytes are hashed one by one.
LONG = 256


def word_hash(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int) -> np.ndarray:
    """64-bit hash of each span of bytes: eight bytes at a time through mix, long spans by BLAKE2.
    Spans of one length and at most eight bytes never collide."""
    size = ends - starts
    out = mix(size.astype(np.uint64) + np.uint64(seed * 0x9E3779B97F4A7C15 % 2**64))
    eights = np.ndarray(len(data) + 1, np.uint64, np.concatenate([data, np.zeros(8, np.uint8)]), strides=(1,))
    left = np.flatnonzero((size > 0) & (size <= LONG))
    at = 0
    while len(left):
        rest = size[left] - at
        eight = eights[starts[left] + at]
        short = rest < 8
        eight[short] &= (np.uint64(1) << (8 * rest[short]).astype(np.uint64)) - np.uint64(1)
        out[left] = mix(out[left] ^ eight)
        left, at = left[rest > 8], at + 8
    for i in np.flatnonzero(size > LONG).tolist():
        digest = hashlib.blake2b(data[starts[i] : ends[i]], digest_size=8, salt=seed.to_bytes(2, "little"))
        out[i] = int.from_bytes(digest.digest(), "little")
    return out


class Powers:
    """Powers of an odd base and of its inverse modulo 2**64, as far as needed so far."""

    base = 0x9E3779B97F4A7C15
    up = down = np.ones(1, np.uint64)

    @classmethod
    def reach(cls, n: int) -> None:
        if len(cls.up) <= n:
            size = max(n + 1, len(cls.up) * 5 // 4)
            for name, factor in (("up", cls.base), ("down", pow(cls.base, -1, 2**64))):
                powers = np.full(size, factor, np.uint64)
                powers[0] = 1
                setattr(cls, name, np.multiply.accumulate(powers, out=powers))


class Polynomial:
    """Hash of any span of a sequence from prefix sums: sum of code(x_j) * base**j modulo 2**64.

    Bytes have a table of random 64-bit codes, 64-bit symbols are mixed with a random one; hashes
    of different seeds have different codes and are independent. Sums of this kind collide for
    some sequences of two symbols from 1024 symbols on, whatever the codes; so they are only
    taken of windows of a fixed width far below, and words go through word_hash.
    """

    def __init__(self, seed: int):
        rng = np.random.Generator(np.random.PCG64(seed))
        self.codes = rng.integers(0, 2**64, 256, dtype=np.uint64)

    def prefix(self, data: np.ndarray) -> np.ndarray:
        Powers.reach(len(data))
        values = self.codes[data] if data.dtype == np.uint8 else mix(data ^ self.codes[0])
        values *= Powers.up[: len(data)]
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(values, out=sums[1:])
        return sums

    def spans(self, sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        out = sums[ends]
        out -= sums[starts]
        out *= Powers.down[starts]
        return mix(out)

    def windows(self, sums: np.ndarray, width: int) -> np.ndarray:
        """Hashes of all spans of one width, by start; spans() gives the same ones."""
        if len(sums) <= width:
            return np.empty(0, np.uint64)
        out = sums[width:] - sums[:-width]
        out *= Powers.down[: len(out)]
        return mix(out)
