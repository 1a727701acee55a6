"""Corpus pipeline: quality rules, SimHash near-dedup, benchmark
decontamination, mixing to target weights, token-ID output.

Each stage takes (spark, docs, sf_dir) and works on everything its predecessor
kept; all but the last return the columns of ``documents``. ``run`` writes
every stage's result as Parquet into the shared folder and reads it again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from transitrisk.llm import decontam, mixing, quality, simhash, tokenfile
from transitrisk.llm.common import one_of_equals, renamed, row_keys, stored, table
from transitrisk.session import configure


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Failing lines go; documents the rules reject go. n_chars follows the cleaned text.

    Null and empty texts have no words and go; repeated rows are judged alike; other
    columns, nulls among them, pass as they are; an empty table yields none."""
    configure(spark)
    plain, names = renamed(docs)
    at = dict(zip(docs.columns, names))
    others = tuple(n for c, n in at.items() if c != "text")
    kept = quality.clean_documents(plain, at["text"], keep=others).where("kept")
    value = {n: F.col(n) for n in others} | {at["text"]: F.col("clean_text")}
    if "n_chars" in at:
        value[at["n_chars"]] = F.length("clean_text").cast(docs.schema["n_chars"].dataType)
    return kept.select(*[value[n].alias(c) for c, n in at.items()])


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: that of the smallest id (null ids last), then of
    the smallest key of its text.

    Of rows equal in id and text, one stays whatever their other columns hold: that whose
    columns hash least. Null and empty texts are one group; an empty table yields none."""
    configure(spark)
    keyed = docs.select("doc_id", "text", *row_keys("doc_id", "text"))
    groups = simhash.near_duplicates(keyed, keep=("key1", "key2"))
    first = F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "key1", "key2")).alias("first")
    stay = stored(groups.groupBy("root").agg(first).select("first.key1", "first.key2"), "dedup-stay")
    plain, names = renamed(docs)
    at = dict(zip(docs.columns, names))
    rows = one_of_equals(plain.select(*row_keys(at["doc_id"], at["text"]), *names), ["key1", "key2"], names)
    return (rows.join(stay, ["key1", "key2"], "left_semi")
            .select(*[F.col(n).alias(c) for c, n in at.items()]))


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Contaminated documents go.

    Rows equal in id and text share a verdict. A null or empty text has no words and is
    never contaminated; without documents or benchmark items nothing goes."""
    configure(spark)
    judged = decontam.contamination(docs, table(spark, sf_dir, "benchmark"))
    gone = stored(judged.where("contaminated").select("key1", "key2").distinct(), "decontam-gone")
    plain, names = renamed(docs)
    at = dict(zip(docs.columns, names))
    return (plain.withColumns({f"key{i + 1}": k for i, k in enumerate(row_keys(at["doc_id"], at["text"]))})
            .join(gone, ["key1", "key2"], "left_anti").select(*[F.col(n).alias(c) for c, n in at.items()]))


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated or left out so that sources meet their target words.

    A null source is one of its own, the last. Rows equal in id, source and text are taken
    as one row's copies, that whose columns hash least. Documents without words are
    taken by their source's rate; an empty table yields none."""
    configure(spark)
    return mixing.materialize(docs, mixing.mix(docs))


def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token file of the mix, read back: one row per document taken, in ascending doc_id
    (nulls first). A null or empty text is its end id alone; an empty table yields none."""
    configure(spark)
    return tokenfile.read_tokens(tokenfile.write_tokens(docs)).select("doc_id", "start", "n_tokens", "ids_crc32")


STAGES = [("quality rules", quality_rules), ("simhash near-dedup", simhash_near_dedup),
          ("benchmark decontamination", benchmark_decontamination), ("source mixing", source_mixing),
          ("token output", token_output)]

#: No SQL: fingerprints, cube sampling and tokenization cannot be expressed in it.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
    return docs
