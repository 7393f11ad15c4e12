"""From raw documents to packed sequences: toxicity, exact copies, near copies, personal data, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and reread as the next
one's docs.  All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from fragmill.llm import exact_dedup, jaccard_join, packing, pii, toxicity
from fragmill.llm.shared import dropped, table, written


def drop_toxic(spark, docs, sf_dir):
    """Documents that the factorization machine, fitted on the labels of its training folds, rejects go."""
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def drop_copies(spark, docs, sf_dir):
    """Of texts equal but for white space the longest, then the smallest id, stays."""
    return exact_dedup.drop_copies(docs)


def drop_near_copies(spark, docs, sf_dir):
    """One document of each group of linked ones stays, the one with the smallest id."""
    return jaccard_join.one_of_each(docs)


def sanitise(spark, docs, sf_dir):
    """Personal data and disclosing terms are replaced; n_chars follows the text."""
    out = pii.sanitise(docs)
    return out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def pack(spark, docs, sf_dir):
    """The packed pieces of what is left."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("jaccard_join", drop_near_copies),
    ("pii", sanitise),
    ("packing", pack),
]

#: The model's score, the shingle sets' components and the plan of sequences are not expressible in SQL.
ORACLE_SQL = None


def run(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        before, docs = docs, written(stage(spark, docs, sf_dir), f"stage-{name}")
        dropped(before)
    return STAGES[-1][1](spark, docs, sf_dir)
