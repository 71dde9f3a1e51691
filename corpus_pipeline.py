"""From raw documents to token shards: STAGES in order, and `run` over the documents of a folder.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept and returns a DataFrame; all but the
last return the columns of documents, and extra columns with whatever names.

Defined results of every stage: texts are read whole at any length; an empty table stays empty; extra columns are carried
along. The rest is stated at each.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessella.llm import decontam, langid, mixing, neardup, tokens
from tessella.llm.common import materialise, read, shared_dir
from tessella.llm.queries import tokenizer_path


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with an identified language; those without letters, or like no language fitted, go.

    Null and empty texts go; a tie goes to the language first by code point; repeated rows stay or go together; a null id or
    label is no reason to go.
    """
    return langid.keep_identified(docs)


def near_deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by a Jaccard similarity of 0.8 of five-word shingles, that with the smallest id.

    Null, empty and wordless texts are one group; of rows that tie on the smallest id one stays, and so of repeated rows;
    rows without an id stay only where their whole group has none, one of each.
    """
    return neardup.drop_near_duplicates(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any window of the benchmark.

    Null and wordless texts stay; items without an id are searched like others; repeated rows stay or go together; there are
    no ties.
    """
    return decontam.drop_contaminated(docs, read(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix to target weights; a document stands as often as it is taken.

    Texts without words are never taken; null sources are one source; rows that tie on id and text are interchangeable;
    repeated rows are taken each for itself.
    """
    return mixing.mixed_documents(docs)


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token shards of the mix, and one row per document read back from them.

    Null texts are empty and have the end id alone; null ids come first; rows that tie on id are ordered by a hash of the text;
    repeated rows are documents of their own.
    """
    return tokens.token_documents(docs, shared_dir(spark), tokenizer_path("word_bpe_49k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", identify_language),
    ("near_dedup", near_deduplicate),
    ("decontamination", decontaminate),
    ("source_mixing", mix_sources),
    ("token_output", write_tokens),
]

#: The tokenizer can't be written in SQL; the tests hold run() against a plain version of all stages, row by row.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
