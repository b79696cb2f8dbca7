"""A training corpus from raw documents: five stages, each an operator of millrace.llm.

run(spark, sf_dir) applies STAGES to the table documents. Every stage works on all that the one before it kept; its
result is written as a table in the shared folder and read again. The last stage returns the encoded documents.

Each row is a document of its own, also where doc_id is null or comes twice: stages that decide by a join number the rows
of their input and decide by that number (near_copies in the order of doc_id, nulls last, then of the texts' hashes). Columns may
have any names; besides doc_id, text, lang and source they are carried along as they are, but n_chars follows the text.
Null and empty texts have no language, so the first stage takes them out; a later stage leaves them alone. Empty tables
give empty tables.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import cut, ship, table
from millrace.llm.decontaminate import contamination, decided
from millrace.llm.language_id import identify, train
from millrace.llm.line_dedup import remove_boilerplate
from millrace.llm.minhash_dedup import near_duplicates
from millrace.llm.piece_fst import encode

#: A document stays if its language is known and this likely at least.
LEAST_SCORE = 0.5
USED = ("doc_id", "text", "lang", "source")


def packed(docs: DataFrame) -> DataFrame:
    """doc_id, text, lang and source, and all other columns as one, `rest`."""
    others = [c for c in docs.columns if c not in USED]
    return docs.select(*USED, (F.struct(*others) if others else F.lit(None).cast("string")).alias("rest"))


def unpacked(rows: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of docs, in their order."""
    return rows.select(*(F.col(c) if c in USED else F.col("rest").getField(c).alias(c) for c in docs.columns))


def numbered(docs: DataFrame, in_order: bool = False) -> DataFrame:
    """packed(docs) with `row`, a number for each row, as a written table; in_order: in the order of doc_id, nulls last."""
    rows = packed(docs)
    if in_order:
        rows = rows.withColumns({"__h": F.xxhash64("text"), "__m": F.monotonically_increasing_id()})
        order = [F.col("doc_id").asc_nulls_last(), F.col("__h"), F.col("__m")]
        rows = rows.repartitionByRange(*order).sortWithinPartitions(*order).drop("__h", "__m")
    return cut(rows.withColumn("row", F.monotonically_increasing_id()))


def language(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a language: those without letters, or whose best language is less than LEAST_SCORE likely, go."""
    ship(spark)
    rows = packed(docs)
    known = identify(rows, train(rows), rows.columns)
    return unpacked(known.filter((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SCORE)), docs)


def lines(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without repeated boilerplate lines; one of which nothing is left goes. Others keep their text as it is."""
    out = remove_boilerplate(packed(docs)).filter((F.col("n_removed") == 0) | (F.trim(F.regexp_replace("kept", "\n", " ")) != ""))
    changed = F.col("n_removed") > 0
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        out = out.withColumn("rest", F.when(changed, F.col("rest").withField("n_chars", F.length("kept").cast(kind))).otherwise(F.col("rest")))
    return unpacked(out.withColumn("text", F.when(changed, F.col("kept")).otherwise(F.col("text"))), docs)


def near_copies(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: the one with the smallest doc_id (null is the largest), of repeated
    rows any one."""
    ship(spark)
    rows = numbered(docs, in_order=True)
    gone = near_duplicates(rows.select(F.col("row").alias("doc_id"), "text")).filter(~F.col("kept")).select(F.col("doc_id").alias("row"))
    return unpacked(rows.join(gone, "row", "left_anti"), docs)


def benchmark(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that aren't contaminated with benchmark passages."""
    rows = numbered(docs)
    found = decided(contamination(rows.select(F.col("row").alias("doc_id"), "text"), table(spark, sf_dir, "benchmark")))
    return unpacked(rows.join(found.filter("contaminated").select(F.col("doc_id").alias("row")), "row", "left_anti"), docs)


def pieces(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every document, and if they decode to its text (U+2581 as space)."""
    ship(spark)
    back = encode(docs.select(*USED), public_tokenizers.path("piece_bpe_32k.model"), back=True)
    same = F.translate(F.coalesce("text", F.lit("")), "▁", " ") == F.col("decoded")
    return back.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_ids"), "ids", same.alias("round_trip"))


STAGES = [("language", language), ("lines", lines), ("near_copies", near_copies), ("benchmark", benchmark), ("pieces", pieces)]
ORACLE_SQL = None


def run(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
