"""The corpus pipeline: toxicity, quality, near-duplicates, repeated passages, packing.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; ``run`` writes every stage's
result as Parquet into the shared folder and hands the reread table to the next one.  All stages but the last
return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from covertile.llm.common import noted, read, release, staged
from covertile.llm.queries import tokenizer_file

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def drop_toxic(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents under 0.5 of the toxicity score; the model learns from the labels of all documents outside the held-out fold.

    Rows are judged one by one by their text (null: empty), whatever their ids; an empty table stays empty; further columns go.
    """
    from covertile.llm.toxicity import fit, with_scores

    labels = read(spark, sf_dir, "labels").where(F.crc32(F.col("doc_id").cast("string")) % 5 != 0)
    model = fit(read(spark, sf_dir, "documents"), labels)
    return with_scores(docs.select(COLUMNS), model).where("score < 0.5").select(COLUMNS)


def drop_poor(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of at least 0.7 of the quality score.

    Rows are judged one by one by their text (null: empty), whatever their ids; an empty table stays empty; further columns go.
    """
    from covertile.llm.quality import fit, with_scores

    labels = read(spark, sf_dir, "labels").where(F.crc32(F.col("doc_id").cast("string")) % 4 != 2)
    model = fit(read(spark, sf_dir, "documents"), labels)
    return with_scores(docs.select(COLUMNS), model).where("score >= 0.7").select(COLUMNS)


def drop_near_copies(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group at similarity 0.8 of five-word shingles: the smallest id.

    Rows with null ids take part and go first; of rows that share an id one stays if they are copies.  Null and empty texts are copies of
    nothing; an empty table stays empty; further columns go.
    """
    from covertile.llm.minhash_dedup import without_copies

    return without_copies(docs.select(COLUMNS), width=5, percent=80)


def cut_repeats(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages of 50 bytes or more that a smaller id holds.  Bytes of characters cut in
    two go too; a document stays even if nothing of its text does.

    Null texts become empty; rows with null ids neither give nor lose passages; ids that are not null must be unique; an empty
    table stays empty; further columns go."""
    from covertile.llm.suffix_dedup import kept_texts

    return kept_texts(docs.select(COLUMNS)).withColumn("n_chars", F.length("text").cast("long")).select(COLUMNS)


def pack(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their place in the packed sequences.

    Null texts count as empty (one end token); rows with null or repeated ids are packed each for itself; an empty table gives no piece."""
    from covertile.llm.packing import pack_documents

    packed = pack_documents(docs, tokenizer_file("word_bpe_49k.json"))
    return packed.select("doc_id", "start", "length", F.crc32("tokens").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "padded_length")


STAGES = [("toxicity", drop_toxic), ("quality", drop_poor), ("near_duplicates", drop_near_copies), ("repeats", cut_repeats), ("packing", pack)]

#: Trained models, graph components and tokenizer ids are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark, sf_dir: str) -> DataFrame:
    """The last stage's rows; a stage's input and the tables it staged on its way go as soon as its result is written."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        with noted() as tables:
            out = staged(stage(spark, docs, sf_dir), f"stage-{name}")
        release(docs, *(t for t in tables if t is not out))
        docs = out
    return docs
