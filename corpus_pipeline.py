"""A corpus pipeline over ``documents``: language identification, near-duplicate removal, decontamination, encoding."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from periscan.llm import decontaminate as leaks
from periscan.llm import language, near, pieces
from periscan.llm.tokenize import vocabulary
from periscan.session import few, materialize, shared_path, table

DOCUMENT_COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """Documents whose id is not among ``ids``; few enough of those are broadcast, so that no text is shuffled. Null ids stay."""
    return docs.join(few(materialize(ids, "gone")), "doc_id", "left_anti")


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents whose language is told with a margin; null, empty and letterless texts, and ties, go. lang stays as it was given."""
    model = language.fit(docs.where(language.fold() != 2))
    return language.identify(docs, model).where("accepted").select(*DOCUMENT_COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each group of near copies (five-word shingles, similarity 0.8)."""
    gone = near.near_duplicates(docs, width=5).where("doc_id is not null and not kept").select("doc_id").distinct()
    return _without(docs, gone).select(*DOCUMENT_COLUMNS)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold items of ``benchmark``, verbatim or re-parameterised."""
    found = leaks.find_leaks(docs, table(spark, sf_dir, "benchmark")).select("doc_id").distinct()
    return _without(docs, found).select(*DOCUMENT_COLUMNS)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Adds the piece ids of each whole text, and whether decoding them gives the text again."""
    return pieces.encode_checked(docs, vocabulary("piece_bpe_32k.model")).select("doc_id", "lang", "source", "n_pieces", "pieces_crc32", "same", "ids")


STAGES = [
    ("language", identify_language),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", decontaminate),
    ("sentencepiece", encode_pieces),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, one after the other; what each keeps is written to the shared folder."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = shared_path(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs


#: The language model, the signatures and the encoding have no SQL; tests/llm compares with a brute-force version.
ORACLE_SQL = None

QUERIES = {"pipeline": run}
ORACLES: dict[str, str] = {}
