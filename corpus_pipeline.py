"""The corpus pipeline: language ID, near-dedup, decontamination, mixing, token ids.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes each stage's rows as Parquet in the shared folder
and reads them again as the next stage's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievelight.llm import op1_minhash, op4_language, op5_mixing, op7_decontaminate, op8_tokens
from sievelight.llm.common import drop_table, new_table, stored, table
from sievelight.session import ship


#: Ids of dropped documents up to which they are broadcast; of more the documents are shuffled to them.
BROADCAST_IDS = 1_000_000


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose language the classifier rejects: without a letter, or with no clear margin."""
    ship(spark)
    model = op4_language.learn(docs.where(~op4_language.held_out()))
    judged = op4_language.classify(docs, model, docs.columns)
    return judged.where(~F.col("rejected")).select(*docs.columns)


def dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the first document of each group of near duplicates (five words, 0.8). Rows of one doc_id, null or not, are one document."""
    ship(spark)
    out = stored(op1_minhash.near_duplicates(docs).where(~F.col("kept")).select("doc_id").distinct(), "pipeline-dropped")
    if out.count() <= BROADCAST_IDS:  # few enough to be sent to where the texts are
        out = F.broadcast(out)
    return docs.join(out, "doc_id", "left_anti").select(*docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that match a benchmark item over 13 words on end, hold windows of eight words of two items, or whose words are
    hit for more than half. Windows in the other documents are cut from their texts. An item of fewer than eight words counts for
    the half only."""
    ship(spark)
    automata = op7_decontaminate.shards(table(spark, sf_dir, "benchmark").select("item_id", "text"))
    return op7_decontaminate.clean(docs, automata)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes each document as often as its source's target says."""
    ship(spark)
    return op5_mixing.mix(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Writes the ids of all documents and returns what the files hold."""
    ship(spark)
    path = new_table(spark, "token-ids")
    op8_tokens.write(docs, path)
    return op8_tokens.placed(spark, path).select("doc_id", "start", "n_tokens", "ids_crc32")


STAGES = [
    ("language ID", language),
    ("MinHash near-dedup", dedup),
    ("benchmark decontamination", decontaminate),
    ("mixing sources", mixing),
    ("token ids", tokens),
]

#: Compression, range coding and the tokenizer have no SQL form; tests/llm holds run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES[:-1]):
        made = stored(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-').lower()}")
        if k:
            drop_table(spark, docs)
        docs = made
    return STAGES[-1][1](spark, docs, sf_dir)
