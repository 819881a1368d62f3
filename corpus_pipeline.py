"""From raw documents to a training mix: five stages, each working on what the one before kept.

Each stage is written as Parquet and read again, so a lost executor costs one stage at most; what a stage has read goes when it is
written. A run that has a name keeps its tables under it, outside of the session's own folder: after a lost driver, a run of that name
goes on behind the last stage that was written. Its tables are the caller's to remove.

Nulls and edges, by stage: a null text has too few words and goes with the first; rows of a null id keep their boilerplate lines
and otherwise take part like all others; rows equal in id and text become one with the near duplicates; columns that stages add
are renamed where documents have them; an empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessella.llm import decontaminate, line_dedup, mixing, near_dedup, quality_rules
from tessella.llm.common import common, remove, scratch, table, written


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality policy rejects go."""
    return quality_rules.keep_good(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Boilerplate lines of any length go from all documents but one; n_chars follows the text."""
    cleaned = line_dedup.remove_boilerplate(docs, min_words=1)
    return line_dedup.with_length(cleaned)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates stays."""
    return near_dedup.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain a benchmark item go."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents of the mix, with the words taken from each."""
    return mixing.mixture(docs)


STAGES = [
    ("quality_rules", quality),
    ("line_dedup", lines),
    ("near_dedup", near_duplicates),
    ("decontamination", decontamination),
    ("mixing", mix),
]

#: Order MinHash and connected components are not SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str, name: str | None = None) -> DataFrame:
    """The documents after all stages. `name`: of a run that is to be taken up again where one of that name has ended."""
    docs, read = table(spark, sf_dir, "documents"), None
    root = f"{common(spark)}/pipeline-{name}" if name else scratch(spark, "pipeline")
    paths = [f"{root}/{i}-{stage}" for i, (stage, _) in enumerate(STAGES)]
    done = max((i for i, p in enumerate(paths) if written(spark, p)), default=-1)
    for i, (path, (_, stage)) in enumerate(zip(paths, STAGES)):
        if i > done:
            stage(spark, docs, sf_dir).write.mode("overwrite").parquet(path)
        if i >= done:
            docs = spark.read.parquet(path)
            if read:
                remove(spark, read)
            read = path
    return docs
