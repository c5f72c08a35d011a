"""A training corpus from raw documents: language ID, line dedup, near-dedup, mixing, tokens.

Each stage takes (spark, docs, sf_dir) and returns a frame with the columns of documents, but for the
last, which returns the tokenised corpus: ``doc_id, source, n_tokens, ids_sha256, decoded_sha256``, a row
for each time that the mix takes a document.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seasonforge.llm import bpe, langid, linededup, minhash, mixing
from seasonforge.llm.common import cut, drop_cut

#: Documents under this certainty are rejected: neither the family nor the language is clear.
MIN_SCORE = 0.4


def _packed(docs: DataFrame) -> DataFrame:
    """``doc_id, text, _document``: all other columns out of the operators' way, whatever their names."""
    return docs.select("doc_id", "text", F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"]).alias("_document"))


def _unpacked(rows: DataFrame, columns: list[str], **new: Column) -> DataFrame:
    """The columns of the documents again, some of them anew."""
    return rows.select(*[new[c].alias(c) if c in new else F.col("text") if c == "text" else F.col(f"_document.`{c}`") for c in columns])


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents without letters or whose language is uncertain; fills a missing ``lang``.

    Null and empty texts are rejected.  Long texts are judged whole.  Repeated rows share a fate, ties between
    languages go to the first by name.  All columns stay as they are, those named as the operator's too; an
    empty table stays empty.
    """
    learned = langid.fit(docs.select("doc_id", "text", "lang"))
    found = langid.identify(_packed(docs), learned).where((F.col("lang_pred") != "und") & (F.col("score") >= MIN_SCORE))
    return _unpacked(found, docs.columns, lang=F.coalesce("_document.lang", "lang_pred"))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes repeated lines; a document that has lost all its lines goes.

    Null texts, texts of a null id and texts without a line that repeats stay as they are.  Of equal or like
    lines the one of the smallest id, then number, stays; repeated rows keep the same lines.  Long texts are
    taken whole.  ``n_chars`` follows a text that changes; all other columns stay, whatever their names.
    """
    out = linededup.dedup_lines(_packed(docs), min_words=1).where((F.col("_gone") == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    return _unpacked(out, docs.columns, n_chars=F.when(F.col("_gone") > 0, F.length("text")).otherwise(F.col("_document.n_chars")).cast("long"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near copies: five-word shingles, similarity of 0.8 or more.

    The smallest id stays, once if its row is repeated; rows of a null id stay.  A text without words is like
    no other.  Long texts are compared whole.  All columns stay, whatever their names.
    """
    return minhash.drop_near_duplicates(docs, percent=80)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats and leaves out documents so that sources get their target weights.

    A null source is one of its own, the last.  Documents without words, null texts too, stay once.  Repeated
    rows are documents of their own.  Documents are taken whole however long.  All columns stay, whatever
    their names.
    """
    return mixing.mix_documents(docs)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Encodes and decodes every document of the mix.

    A null or empty text has no tokens.  Long texts and words are encoded whole; ties of rank go to the
    leftmost pair.  A row for each row; columns but ``doc_id, source`` go.
    """
    return bpe.bpe_digest(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, keep=("source",))


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", dedup_lines),
    ("minhash_near_dedup", drop_near_duplicates),
    ("mix_to_weights", mix_sources),
    ("bpe_encode_decode", tokenize),
]

#: SQL can express neither the classifier nor the connected groups; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table; each stage's rows are written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES, 1):
        out = stage(spark, docs, sf_dir)
        if k < len(STAGES):
            out = cut(out)
            drop_cut(docs)  # the stage before, once it is read
        docs = out
    return docs
