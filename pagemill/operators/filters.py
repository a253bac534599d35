"""Choosing rows and columns: page ranges and lists, optional conditions, tails, patches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Most and usual rows of a log tail; columns of a line of it; workers that are listed.
TAIL_MOST, TAIL_TYPE, RECENT_WORKERS = 1000, 10, 20
#: Fields of a job that a patch may set, and states that end it.
JOB_FIELDS, JOB_OVER = ("status", "progress", "stdout_tail", "error", "finished_at", "started_at"), ("done", "failed", "cancelled")


def in_page_range(page: Column, low: int, high: int) -> Column:
    """Pages from low to high, both included."""
    return page.between(low, high)


def in_page_list(page: Column, listed: str) -> Column:
    """Pages that a text like '24,26-33' names; a dash parts two pages like a comma, it is not a range."""
    return F.array_contains(F.split(F.translate(F.lit(listed), "- ", ","), ",").cast("array<bigint>"), page)


def first_given(*values: Column) -> Column:
    """The first value that is neither null nor blank."""
    return F.coalesce(*(F.nullif(F.trim(v), F.lit("")) for v in values))


def matching(df: DataFrame, wanted: dict[str, object]) -> DataFrame:
    """Rows with the wanted values; None asks for nothing."""
    for column, value in wanted.items():
        df = df.filter(F.col(column) == value) if value is not None else df
    return df


def newest(df: DataFrame, *, date: str, id: str, limit: int) -> DataFrame:
    """The newest rows by date (rows without one last) and id."""
    return df.orderBy(F.coalesce(F.col(date).cast("string"), F.lit("")).desc(), F.desc(id)).limit(limit)


def split_counts(df: DataFrame, flag: Column) -> DataFrame:
    """One row: how many rows have the flag, and how many have it not; rows where it is null are in neither."""
    return df.agg(F.count_if(flag).alias("yes"), F.count_if(~flag).alias("no"))


def oldest(df: DataFrame, *, waiting: Column, date: str, id: str) -> DataFrame:
    """The row that has waited longest, the one of least id on ties."""
    return df.filter(waiting).orderBy(date, id).limit(1)


def log_tail(df: DataFrame, *, id: str, limit: int, most: int = TAIL_MOST) -> DataFrame:
    """The last rows of a log, 1 at least and `most` at most."""
    return df.orderBy(F.desc(id)).limit(max(1, min(most, limit)))


def log_line(kind: Column, *rest: Column) -> Column:
    """A line of a log: its kind at a fixed width, then the other fields."""
    return F.concat_ws(" ", F.rpad(kind, TAIL_TYPE, " "), *(c.cast("string") for c in rest))


def recently_seen(workers: DataFrame, *, seen: str, limit: int = RECENT_WORKERS) -> DataFrame:
    """The workers seen last."""
    return workers.orderBy(F.desc(seen)).limit(limit)


def columns_of(df: DataFrame, names: list[str]) -> DataFrame:
    """Those of the named columns that there are, in the order of the names."""
    have = set(df.columns)
    return df.select(*(n for n in names if n in have))


def patched(rows: DataFrame, patches: DataFrame, *, key: str, allowed: tuple[str, ...] = JOB_FIELDS, status: str = "status", finished: str = "finished_at", as_of: Column) -> DataFrame:
    """rows with the non-null fields of their patch (one a key), if they are allowed ones. A patch that
    ends a job and names no end gets as_of for one."""
    fields = [c for c in columns_of(patches, list(allowed)).columns if c in rows.columns]
    new = patches.select(F.col(key).alias("_key"), *(F.col(c).alias(f"_{c}") for c in fields))
    pick = {c: F.coalesce(f"_{c}", c) for c in fields}
    if status in fields and finished in rows.columns:
        over, named = F.col(f"_{status}").isin(*JOB_OVER), F.col(f"_{finished}") if finished in fields else F.lit(None)
        pick[finished] = F.coalesce(named, F.when(over, as_of), F.col(finished))
    return rows.join(new, F.col(key) == F.col("_key"), "left").select(*(pick.get(c, F.col(c)).alias(c) for c in rows.columns))
