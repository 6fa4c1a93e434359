"""From raw documents to packed training sequences.

Each stage takes (spark, docs, sf_dir), calls one operator on all rows its
predecessor kept, and returns a DataFrame that the next one reads as docs;
all but the last return the columns of documents.
"""

from __future__ import annotations

from public_tokenizers import path as tokenizer_path
from pyspark.sql import functions as F

from crowdtrust.llm import langid, packing, secret_scan, simhash_dedup, suffix_dedup
from crowdtrust.llm.common import written


def language_id(spark, docs, sf_dir):
    """Documents whose language is not told with a clear margin go."""
    return langid.keep_identified(docs)


def simhash_near_dedup(spark, docs, sf_dir):
    """One document of each group of near copies stays."""
    return simhash_dedup.keep_one(docs, width=3, distance=3)


def suffix_array_dedup(spark, docs, sf_dir):
    """Passages of 50 or more words stay in one document only."""
    return suffix_dedup.cut_repeats(docs, min_words=50)


def mask_secrets(spark, docs, sf_dir):
    """Secrets are masked."""
    return secret_scan.mask_secrets(docs)


def pack_sequences(spark, docs, sf_dir):
    """A row per piece of a document in a sequence of 1024 ids."""
    # a smaller memory than by default: the workers that packed have served four stages before
    pieces = packing.pack(docs, tokenizer_path("byte_bpe_50k.json"), end_id=0, capacity=1024, worker_units=400_000)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES = [
    ("language_id", language_id),
    ("simhash_near_dedup", simhash_near_dedup),
    ("suffix_array_dedup", suffix_array_dedup),
    ("secret_scan", mask_secrets),
    ("packing", pack_sequences),
]
#: The stages go beyond SQL; tests hold them against brute force.
ORACLE_SQL = None


def run(spark, sf_dir):
    """All stages over documents; each one's rows are written and reread."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
