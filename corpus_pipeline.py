"""A pipeline from raw documents to a training mix.

STAGES lists (name, function); each function takes (spark, docs, sf_dir) and returns a DataFrame,
which is written as Parquet and read again as the documents of the next stage. All but the last
return the columns of documents.
"""

from retentia.llm import decontaminate, mixing, near_join, pii, toxicity
from retentia.llm.common import load
from retentia.sources.staging import stage


def toxic(spark, docs, sf_dir):
    """Documents that score as toxic go."""
    return toxicity.without_toxic(docs, load(spark, sf_dir, "labels"))


def near_copies(spark, docs, sf_dir):
    """One document of each group of copies and near copies stays."""
    return near_join.without_copies(docs)


def benchmark_leaks(spark, docs, sf_dir):
    """Documents that hold a benchmark item go."""
    return decontaminate.without_leaks(docs, load(spark, sf_dir, "benchmark"))


def surrogates(spark, docs, sf_dir):
    """Personal data is replaced within texts."""
    return pii.with_surrogates(docs)


def mix(spark, docs, sf_dir):
    """The mix: each document once per repetition, with the words taken of it."""
    return mixing.sampled(docs)


STAGES = [
    ("toxicity", toxic),
    ("near copies", near_copies),
    ("benchmark leaks", benchmark_leaks),
    ("personal data", surrogates),
    ("mixing", mix),
]

#: No SQL: the first stage is a trained model.
ORACLE_SQL = None


def run(spark, sf_dir):
    docs = load(spark, sf_dir, "documents")
    for name, fn in STAGES:
        docs = stage(fn(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
    return docs
