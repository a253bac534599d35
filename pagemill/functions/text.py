"""Scalar functions on titles, names, links, headers and numbers, as column expressions."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def nfc(text: Column) -> Column:
    """Unicode composition, for which there is no built-in function: a vectorised UDF."""

    @F.pandas_udf("string")
    def compose(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: unicodedata.normalize("NFC", t), na_action="ignore")

    return F.when(text.rlike(r"^[\x00-\x7F]*$"), text).otherwise(compose(text))


def normal_title(title: Column) -> Column:
    """For comparison: composed, without white space, punctuation and underscore, lower-case."""
    return F.lower(F.regexp_replace(nfc(F.coalesce(title, F.lit(""))), r"[^\p{L}\p{N}]+", ""))


def slug(title: Column) -> Column:
    """A leading [tag] goes, white space becomes underscores."""
    return F.regexp_replace(F.trim(F.regexp_replace(title, r"^\s*\[[^\]]*\]\s*", "")), r"\s+", "_")


def slug_title(name: Column) -> Column:
    return F.translate(name, "_", " ")


def chapter_id(section: Column, intro: Column) -> Column:
    """chs-part-N or chs-chapter-N from a section id, else from the title of its intro; '' if neither has a number."""
    sid, title = F.trim(F.coalesce(section, F.lit(""))), F.coalesce(intro, F.lit(""))
    # fixed values: the patterns below

    def named(kind, text, pattern, applies):
        number = F.regexp_extract(text, pattern, 1)
        return F.when(applies & (number != ""), F.concat(F.lit(f"chs-{kind}-"), number))

    return F.coalesce(
        named("part", sid, r"Part\s*(\d+)", sid.startswith("Part")),
        named("chapter", sid, r"^(\d+)", sid.endswith("장")),
        named("chapter", title, r"^(\d+)장", F.lit(True)),
        named("part", title, r"^Part\s*(\d+)", F.lit(True)),
        F.lit(""),
    )


def page_number(name: Column, position: Column) -> Column:
    """Page number in an image's file name; its position where there is none or it is zero."""
    # fixed value: the pattern
    found = F.regexp_extract(name, r"_(\d{3,5})\.(?:png|jpg|jpeg)$", 1).try_cast("bigint")
    return F.coalesce(F.nullif(found, F.lit(0)), position)


def reading_position(text: Column) -> Column:
    """Page of '49%(251/508p)' or '251/508p'."""
    # fixed values: the two patterns
    first = F.regexp_extract(text, r"(\d+)%.*?(\d+)/(\d+)p", 2)
    return F.coalesce(F.nullif(first, F.lit("")), F.nullif(F.regexp_extract(text, r"(\d+)/(\d+)p", 1), F.lit(""))).try_cast("bigint")


#: How the steps of a job print their progress.
PROGRESS = (r"\[ocr\]\s+(\d+)/(\d+)\s+\S+", r"\[summarize\]\s+(\d+)/(\d+)", r"\[(\d+)/(\d+)\]\s+캡처")


def progress(line: Column) -> Column:
    """struct<cur, total> of a progress line; null for others."""
    part = lambda p, g: F.regexp_extract(line, p, g).try_cast("bigint").alias(("", "cur", "total")[g])
    return F.coalesce(*(F.when(line.rlike(p), F.struct(part(p, 1), part(p, 2))) for p in PROGRESS))


def percent_done(stage: Column, n_stages: Column, cur: Column, total: Column) -> Column:
    """Percent of a job of n_stages, cur/total through a stage (from 1)."""
    return F.round(((stage - 1) + cur / total) / n_stages * 100, 1)


#: Fixed value: characters of a progress message.
MESSAGE_CHARS = 200


def progress_record(stage: Column, n_stages: Column, name: Column, cur: Column, total: Column, message: Column) -> Column:
    """A progress report as a JSON text; its message is cut, and without a total only whole stages count."""
    done = F.when(total > 0, cur).otherwise(F.lit(0)), F.when(total > 0, total).otherwise(F.lit(1))
    fields = {"stage": stage, "stage_total": n_stages, "stage_name": name, "current": cur, "total": total, "pct": percent_done(stage, n_stages, *done), "msg": F.left(message, F.lit(MESSAGE_CHARS))}
    return F.to_json(F.struct(*(value.alias(key) for key, value in fields.items())))


def cut_text(text: Column, limit: int) -> Column:
    """The first characters of a text."""
    return F.left(text, F.lit(limit))


def n_chars(text: Column) -> Column:
    """Characters of a text; none for null."""
    return F.length(F.coalesce(text, F.lit(""))).cast("bigint")


def message_or(message: Column, default: str) -> Column:
    """The message, or a default where it is null or empty."""
    return F.coalesce(F.nullif(message, F.lit("")), F.lit(default))


def json_setting(json: Column, name: str, kind: str, default: object) -> Column:
    """A field of a JSON text; the default where the text is broken or lacks it."""
    return F.coalesce(F.from_json(json, f"`{name}` {kind}")[name], F.lit(default))


def masked_secret(value: Column) -> Column:
    """First seven and last four characters; *** for twelve or fewer."""
    return F.when(F.length(value) > 12, F.concat(F.left(value, F.lit(7)), F.lit("..."), F.right(value, F.lit(4)))).otherwise(F.lit("***"))


def html_escaped(text: Column) -> Column:
    out = text
    for char, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        out = F.replace(out, F.lit(char), F.lit(entity))
    return out


#: Fixed value: white space at the ends of a text, as prompts and reports strip it.
ENDS = r"^[\s\p{Z}\x0B\x1C-\x1F\x85]+|[\s\p{Z}\x0B\x1C-\x1F\x85]+$"


def stripped(text: Column) -> Column:
    """Text without white space of any kind at its ends."""
    return F.regexp_replace(text, ENDS, "")


def without_tags(html: Column) -> Column:
    return stripped(F.regexp_replace(html, r"<[^>]+>", " "))


def squeezed(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def safe_tag(text: Column, limit: int = 30) -> Column:
    """Of the first characters of a tag those that are letters or digits of any script, _ or -."""
    return F.regexp_replace(F.left(F.coalesce(text, F.lit("")), F.lit(limit)), r"[^\p{L}\p{N}_-]", "")


def script_ratio(text: Column, script: str = "가-힣") -> Column:
    """Share of letters that are in a script (a character range); 0 without letters."""
    letters = F.regexp_count(text, F.lit(r"\p{L}"))
    return F.when(letters > 0, F.regexp_count(text, F.lit(f"[{script}]")) / letters).otherwise(F.lit(0.0))


def code_language(label: Column) -> Column:
    return F.when(label.rlike("(?i)python|파이썬|py"), "Python").otherwise("C#")


def link_id(url: Column, names: tuple[str, ...]) -> Column:
    """Value of the first of some query parameters that a link has, else its last path segment."""
    given = [F.nullif(F.regexp_extract(url, rf"[?&]{n}=([^&#]+)", 1), F.lit("")) for n in names]
    return F.coalesce(*given, F.nullif(F.regexp_extract(url, r"/([A-Za-z0-9_-]+)/?(?:[?#].*)?$", 1), F.lit("")))


def path_after(url: Column, segment: str) -> Column:
    """Path segment after a named one, percent-decoded; null if there is none."""
    parts = F.split(F.regexp_replace(url, r"[?#].*$", ""), "/")
    at = F.array_position(parts, segment)
    return F.when((at > 0) & (at < F.size(parts)), F.url_decode(F.get(parts, at.cast("int"))))


def leading_int(text: Column) -> Column:
    """Leading digits as a number, else 0."""
    return F.coalesce(F.regexp_extract(text, r"^\s*(\d+)", 1).try_cast("bigint"), F.lit(0))


def int_or_null(text: Column) -> Column:
    return text.try_cast("bigint")


def seconds_ago(ts: Column, as_of: Column) -> Column:
    return F.round(F.unix_micros(as_of.cast("timestamp")) / 1e6 - F.unix_micros(ts.cast("timestamp")) / 1e6, 1)


def page_path(page: Column) -> Column:
    return F.format_string("page_%03d", page)


def natural_rank(name: Column) -> list[Column]:
    """Sort keys: first run of digits as a number (999999 without), then the name."""
    return [F.coalesce(F.regexp_extract(name, r"(\d+)", 1).try_cast("bigint"), F.lit(999_999)), name]
