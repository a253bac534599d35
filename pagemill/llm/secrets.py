"""Secret scan: keyword automaton, anchored patterns near its hits, checksums inside tokens.

One pass over each text with an Aho-Corasick automaton finds the few places where a
secret can start; a regular expression is tried only there. Tokens that carry a checksum
(version-control and package-registry tokens) are reported only if it holds. Runs of
lower-case hex have no keyword and are found by one pattern over the text.

Defined results: null and empty texts have no spans; rows are independent, so repeated
rows repeat their result; other columns pass through; a result column that would clash
with a column of the input is refused with ValueError.
"""

from __future__ import annotations

import re
import zlib
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPAN_TYPE = "array<struct<kind:string,start:int,end:int>>"
_ARROW_SPAN = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

#: Kinds in the order in which spans that start together are listed.
BASE_KINDS = ("assign", "access", "hex")
KINDS = (*BASE_KINDS, "vcs_token", "registry_token")

#: Patterns of the base kinds.
ASSIGN = re.compile(r"""(?ai:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
#: Token prefixes whose last six characters are a base-62 CRC-32 of the thirty before.
CHECKED = {"ghp_": "vcs_token", "gho_": "vcs_token", "ghu_": "vcs_token", "ghs_": "vcs_token", "ghr_": "vcs_token", "npm_": "registry_token"}
BODY = re.compile(r"[A-Za-z0-9]{36}(?![A-Za-z0-9])")
BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
MIN_ASSIGN, MIN_ACCESS = 6, 20

_FOLD = {c: c + 32 for c in range(65, 91)}


def checksum62(body: str) -> str:
    """Six base-62 digits of the CRC-32 of an ASCII string."""
    value, digits = zlib.crc32(body.encode()), ""
    for _ in range(6):
        value, digit = divmod(value, 62)
        digits = BASE62[digit] + digits
    return digits


@lru_cache(maxsize=1)
def _automaton():
    import ahocorasick

    found = ahocorasick.Automaton()
    for word in ASSIGN_WORDS:
        found.add_word(word, ("assign", len(word)))
    found.add_word("akia", ("access", 4))
    for prefix in CHECKED:
        found.add_word(prefix, (prefix, len(prefix)))
    found.make_automaton()
    return found


def spans_of(text: str | None) -> list[tuple[str, int, int]]:
    """(kind, start, end) of every secret, in code points, by start and then kind as listed."""
    if not text:
        return []
    folded = text.lower()
    if len(folded) != len(text):  # a character that lower-cases to two would shift positions
        folded = text.translate(_FOLD)
    found, free = [], {"assign": 0, "access": 0}
    for last, (what, n) in _automaton().iter(folded):
        start = last - n + 1
        if what in free:
            if start < free[what]:
                continue
            hit = (ASSIGN if what == "assign" else ACCESS).match(text, start)
            if hit:
                free[what] = hit.end()
                if (len(hit[1]) >= MIN_ASSIGN) if what == "assign" else (hit.end() - start >= MIN_ACCESS):
                    found.append((what, start, hit.end()))
        elif text.startswith(what, start):
            hit = BODY.match(text, last + 1)
            if hit and checksum62(hit[0][:30]) == hit[0][30:]:
                found.append((CHECKED[what], start, hit.end()))
    found += [("hex", hit.start(), hit.end()) for hit in HEX.finditer(text)]
    if len(found) > 1:
        found.sort(key=lambda span: (span[1], KINDS.index(span[0])))
    return found


def secret_spans(text: Column) -> Column:
    """array<struct<kind, start, end>> of the secrets of a text column."""

    @F.arrow_udf(SPAN_TYPE)
    def scan(texts: pa.Array) -> pa.Array:
        return pa.array([[{"kind": k, "start": s, "end": e} for k, s, e in spans_of(t)] for t in texts.to_pylist()], _ARROW_SPAN)

    return scan(text)


def find_secrets(docs: DataFrame, *, text: str = "text", out: str = "secrets") -> DataFrame:
    """docs with an added column of secret spans."""
    if out in docs.columns:
        raise ValueError(f"column {out} exists")
    return docs.withColumn(out, secret_spans(F.col(text)))


def mask_secrets(docs: DataFrame, *, text: str = "text", mask: str = "[secret]") -> DataFrame:
    """docs whose text has each run of overlapping secret spans replaced by mask; null stays null."""

    @F.arrow_udf("string")
    def masked(texts: pa.Array) -> pa.Array:
        return pa.array([masked_text(t, mask) for t in texts.to_pylist()], pa.string())

    return docs.withColumn(text, masked(F.col(text)))


def masked_text(text: str | None, mask: str) -> str | None:
    spans = spans_of(text)
    if not spans:
        return text
    parts, at, upto = [], 0, -1
    for _, start, end in spans:
        if start >= upto:
            parts += [text[at:start], mask]
        upto = max(upto, end)
        at = upto
    return "".join([*parts, text[at:]])


def span_text(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def secret_digest(docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: counts of the base kinds, SHA-256 of the base spans, and all spans as text."""
    found = docs.select(F.col(key).alias("doc_id"), secret_spans(F.col(text)).alias("spans"))
    kind_count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        "doc_id",
        *(kind_count(kind).alias(f"n_{kind}") for kind in BASE_KINDS),
        F.sha2(span_text(F.filter("spans", lambda s: s["kind"].isin(*BASE_KINDS))), 256).alias("base_sha256"),
        span_text(F.col("spans")).alias("spans"),
    )
