"""From raw documents to packed sequences, in five stages, each over all that the one before kept.

1. quality: documents that the Kneser-Ney model rejects go;
2. lines: later occurrences of repeated three-line windows go from the texts;
3. near_duplicates: of each group of near copies, the document with the smallest id stays;
4. privacy: personal data is replaced by its kind in brackets;
5. packing: texts are tokenised and packed into sequences.

A stage takes documents (doc_id, text, lang, and others of any names) and returns the same columns, but
for the last. Decisions travel as ids with a hash of the text, and are applied by an anti-join that
broadcasts them up to a checked number and shuffles beyond it, so that the texts are moved as seldom as
possible. An empty table goes through every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plait import runtime
from plait.llm import line_dedup, near_copies, packing, pii, quality
from plait.llm.queries import vocabulary

#: Rejected documents that are broadcast, at most (16 bytes each); beyond, both sides are shuffled.
BROADCAST_ROWS = 2_000_000

#: SQL has no Kneser-Ney training, SimHash or tokeniser; each stage is tested against brute force.
ORACLE_SQL = None

_left = [0]


def _begin() -> None:
    """Delete what earlier stages left in the shared folder; their results are written by now."""
    runtime.cleanup(_left[0])


def _without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """``docs`` without the rows whose id and text hash stand in ``gone`` (doc_id, t)."""
    gone = runtime.materialise(gone.select(F.col("doc_id").alias("gone_id"), F.col("t").alias("gone_t")).distinct(), "gone")
    if gone.count() <= BROADCAST_ROWS:
        gone = F.broadcast(gone)
    return docs.join(gone, docs["doc_id"].eqNullSafe(gone["gone_id"]) & F.xxhash64(docs["text"]).eqNullSafe(gone["gone_t"]), "left_anti")


def _sized(docs: DataFrame, columns: list[str]) -> DataFrame:
    """``columns`` of ``docs``, with n_chars anew where it is one of them."""
    return docs.select(*[F.length("text").cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else F.col(f"`{c}`") for c in columns])


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``docs`` that :func:`quality.judge` keeps, by the labels in ``sf_dir``. Null, empty and blank texts,
    those of a null or rare language, and all without any trusted label stay; rows that repeat an id and
    a text stay or go together; a null id is judged like any other."""
    _left[0] = runtime.written()
    judged = quality.judge(docs.select("doc_id", "lang", "text", F.xxhash64("text").alias("t")), runtime.table(spark, sf_dir, "labels"), with_text=False)
    return _without(docs, judged.where("not keep"))


def lines_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``docs`` without repeated lines by :func:`line_dedup.dedup`; every row stays, if with an empty text,
    and n_chars, where there is one, is that of the new text. Null texts stay null (n_chars null)."""
    _begin()
    return _sized(line_dedup.dedup(docs, counts=False), docs.columns)


def near_duplicates_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of :func:`near_copies.groups`. Null, empty and blank texts are one group
    of copies each other; of rows that repeat an id and a text one stays; rows with a null id come after
    all others of their group."""
    _begin()
    groups = near_copies.groups(docs)
    kept = _without(docs, groups.where("not stays"))
    # rows that repeat an id and a text are copies of one another
    if groups.groupBy("doc_id", "t").agg(F.count("*").alias("n")).where("n > 1").limit(1).count():
        kept = kept.dropDuplicates(["doc_id", "text"])
    return kept


def privacy_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``docs`` with personal data replaced by :func:`pii.redact`; every row stays, null texts stay null,
    and n_chars, where there is one, is that of the new text."""
    _begin()
    return _sized(pii.redact(docs), docs.columns)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of :func:`packing.pack_documents`, whole texts of any length. A null or empty text is the
    end token alone; a null id is kept; repeated rows are packed as often as they stand."""
    _begin()
    packed = packing.pack_documents(docs, vocabulary("byte_bpe_50k.json"))
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


STAGES = [
    ("quality", quality_stage),
    ("lines", lines_stage),
    ("near_duplicates", near_duplicates_stage),
    ("privacy", privacy_stage),
    ("packing", packing_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table, each written and read again; the packed pieces."""
    docs, path = runtime.table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        stale = path
        docs, path = runtime.stage_table(stage(spark, docs, sf_dir), name)
        if stale:
            runtime.delete(spark, stale)
    return STAGES[-1][1](spark, docs, sf_dir)
