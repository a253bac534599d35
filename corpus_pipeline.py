"""Corpus pipeline over `documents`: language, near-duplicates, benchmark passages, secrets, packing.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the
columns of documents. A document that a stage rejects is gone for the stages after it, and
text that a stage rewrites is what they read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.llm import decontaminate, language, near_dup, packing, secrets
from pagemill.llm.common import dropped, free_name, remainder, scratch, stored, table

#: Least posterior probability of a document's language.
CERTAIN = 0.5


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without letters and those whose language stays in doubt.

    Null, empty and letterless texts go. Equal texts have equal languages and stay or go together,
    whatever their ids; rows without id or language are judged, but not learnt from. Texts are read
    whole, of any length. An empty table stays empty; where no language can be learnt, all go."""
    model = language.fit_language(docs.filter(F.coalesce(remainder("doc_id", 3) != 1, F.lit(False))))
    found = free_name(docs, "_found")
    told = language.identify_languages(docs, model, out=found)
    return told.filter((F.col(found)["lang"] != language.UNKNOWN) & (F.col(found)["score"] >= CERTAIN)).drop(found)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of least id of each class of near-duplicates.

    Of rows of that id one stays, the same in every run; rows without id all stay. Null and empty texts
    are near-duplicates of each other (the stage before has dropped them). Classes join over any
    chain of links. Texts are read whole; an empty table stays empty."""
    return near_dup.keep_one_of_each(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold benchmark passages: a twentieth of their words or more.

    Every row is judged by itself, also rows of one id and rows without; a text without words is
    clean. Texts are read whole. Without benchmark items, or documents, the table stays as it is."""
    return decontaminate.remove_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces secrets in the text; documents stay, with n_chars of what the text is then.

    A null text stays null, an empty one empty; equal texts are masked alike. Texts are read whole."""
    return secrets.mask_secrets(docs).withColumn("n_chars", F.length("text").cast("long")).select(docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places the pieces of every document in training sequences.

    Every row is a document, also one of an id that others have or without id; a null or empty text
    is a piece of one id, its end. Long texts are cut in pieces, all of which are placed; an empty
    table gives none. The columns are those of packing, not of documents."""
    return packing.pack(docs, keep_ids=False)


STAGES = [
    ("language", keep_known_languages),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("secrets", mask_secrets),
    ("packing", pack_sequences),
]

#: SQL can express neither the language model nor the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other. What a stage has stored goes when its result is, and so does the
    result before; only what the last stage reads is left."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        with scratch() as made:
            docs = stored(stage(spark, docs, sf_dir), name)
        dropped(*(t for t in made if t is not docs), *([before] if before is not None else []))
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
