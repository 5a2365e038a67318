"""A training corpus from the documents, in five stages.

Each stage works on all that the one before it kept and returns the columns of
documents; the last returns the packed pieces.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomflow.llm import lines, mixing, packing, shingles, toxicity
from loomflow.llm.common import Staged, column, free_name, shared_dir
from loomflow.session import share_code
from loomflow.stage import cleared


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model does not reject; it learns from the labels of these documents.

    Null and empty texts have the score of a text without words. Repeated rows
    go or stay together; rows without an id are scored like others. Without
    labels of both classes nothing goes; an empty table stays empty.
    """
    share_code(spark)
    return toxicity.reject(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without lines that repeat an earlier one, exactly or, from 24 characters on, within two edits; n_chars follows the text.

    Earlier means a smaller id, null last, or above in the same document. Null
    and empty texts stay; repeated rows have one outcome. Very long texts are
    read whole. An empty table stays empty.
    """
    share_code(spark)
    return lines.without_repeats(docs, length_col="n_chars" if "n_chars" in docs.columns else None, exact_chars=lines.EXACT_CHARS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest id of each group of near copies: five-word shingles, a similarity of 0.8 or more.

    Texts of fewer words are one shingle. Null, empty and blank texts are one
    group, of which one row stays. Of repeated rows one stays. Null ids stay
    only where the group has no other; an empty table stays empty.
    """
    share_code(spark)
    return shingles.keep_one(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents in the order in which sources come to their target weights.

    Rows of null source are a source; null ids, null texts and repeated rows
    keep places of their own. An empty table stays empty.
    """
    place = free_name(docs, "position")
    return mixing.ordered(docs, place).orderBy(F.col(place)).drop(place)


#: Written files whose first numbers are broadcast, a hundred bytes each; of more, Spark joins by shuffling.
MOST_FILES = 100_000


def in_written_order(docs: DataFrame, into: str) -> DataFrame:
    """docs with the number of each row, from 0, in the order in which an ordered table was written, in the column into.

    Spark reads files in the order of their sizes, so the order is that of the
    tasks that wrote them and of the rows in each file.
    """
    file, row, of, first = (free_name(docs, x) for x in ("file", "row", "of", "first"))
    try:
        placed = docs.select("*", F.col("_metadata.file_name").alias(file), F.col("_metadata.row_index").alias(row))
    except AnalysisException:  # not read from files: partitions stand in order
        number = F.monotonically_increasing_id()
        placed = Staged(docs.sparkSession, "order").save(docs.withColumn(row, number))
        placed = placed.withColumn(file, F.lpad(F.shiftright(row, 33).cast("string"), 10, "0")).withColumn(row, F.col(row).bitwiseAND((1 << 33) - 1))
    sizes = placed.groupBy(F.col(file).alias(of)).agg(F.count("*").alias("n"))
    # a row for each file
    before = Window.orderBy(F.regexp_extract(of, r"^part-(\d+)", 1).try_cast("bigint"), of).rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(of, F.coalesce(F.sum("n").over(before), F.lit(0)).alias(first))
    # sent to all tasks while the files are few enough to count on it
    few = sizes.count() <= MOST_FILES
    out = placed.join(F.broadcast(starts) if few else starts, placed[file] == starts[of]).withColumn(into, F.col(first) + F.col(row))
    return out.select(*[column(out, c) for c in docs.columns], into)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token ids of all documents in sequences of at most 2048, which follow the order of the documents.

    A row for each piece of a document. Null and empty texts have the closing
    token alone; null ids and repeated rows are packed like any others, and
    texts of any length are cut; an empty table gives no rows.
    """
    share_code(spark)
    place = free_name(docs, "position")
    return packing.pack(in_written_order(docs, place), carry="ids", position_col=place)


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_repeated_lines),
    ("simhash near-dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: The model and the tokenizer have no SQL; the stages are held against plain versions in the tests.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over documents; stages are written to the shared folder and read again, and what each staged on its way is deleted."""
    root = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for number, (_, stage) in enumerate(STAGES):
        if number == len(STAGES) - 1:
            return stage(spark, docs, sf_dir)
        with cleared(spark):
            docs = stage(spark, docs, sf_dir)
            docs.write.parquet(f"{root}/{number}")
        docs = spark.read.schema(docs.schema).parquet(f"{root}/{number}")
    return docs
