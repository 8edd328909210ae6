"""The registered queries of the training-data operators and, where SQL can say the same, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import byte_bpe, secret_scan
from .additive_ann import nearest
from .common import table
from .embedding_near_dup import near_duplicates
from .html_text import extract
from .filter_audit import audit, oracle as audit_oracle
from .packing import pack, token_pieces
from .quality import score_documents
from .spelling import spelling_variants
from .suffix_dedup import remove_repeats
from .token_group_join import jaccard_components
from .toxicity import toxicity
from .vector_file import oracle as top_oracle, top_products


def op1_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links, components and kept vectors at cosine 0.93; edges as in ``near_duplicates``."""
    return near_duplicates(table(spark, sf_dir, "embeddings"), min_cosine=0.93)


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token pieces of all documents in sequences of 2048; edges as in ``token_pieces`` and ``pack``."""
    return pack(token_pieces(table(spark, sf_dir, "documents")))


def op3_toxicity_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document; edges as in ``toxicity``."""
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page; edges as in ``extract``."""
    return extract(table(spark, sf_dir, "pages"))


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document as counts, digests and spans; edges as in ``scan``."""
    return secret_scan.digest(secret_scan.scan(table(spark, sf_dir, "documents")))


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What goes of every document as repeats of 400 bytes, and its repeated passages of over 50 words; edges as in ``remove_repeats``."""
    kept = remove_repeats(table(spark, sf_dir, "documents"), window=400, passage_counts=True)
    return kept.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"), "n_passages", "passage_bytes")


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded and decoded again; edges as in ``encode``."""
    both = byte_bpe.decode(byte_bpe.encode(table(spark, sf_dir, "documents")))
    decimal = F.array_join(F.col("ids").cast("array<string>"), " ")
    return both.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(decimal, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quality of every document; edges as in ``score_documents``."""
    return score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_additive_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 nearest rows of every 100th vector; edges as in ``nearest``."""
    rows = table(spark, sf_dir, "embeddings")
    return nearest(rows, rows.where("vec_id % 100 = 0"), k=10)


def op10_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components at Jaccard similarity 0.9 of three-word shingles; edges as in ``jaccard_components``."""
    return jaccard_components(table(spark, sf_dir, "documents"), shingle_words=3, similarity=(9, 10))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of all documents with the form and root that each varies; edges as in ``spelling_variants``."""
    return spelling_variants(table(spark, sf_dir, "documents"))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What five filters remove from each language's documents in all 120 orders; edges as in ``audit``."""
    return audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 largest inner products of each 50th vector with all others; edges as in ``top_products``."""
    rows = table(spark, sf_dir, "embeddings")
    return top_products(rows, rows.where("vec_id % 50 = 0"), k=5)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_embedding_near_dedup": op1_embedding_near_dedup,
    "op2_best_fit_packing": op2_best_fit_packing,
    "op3_toxicity_chain": op3_toxicity_chain,
    "op4_html_extraction": op4_html_extraction,
    "op5_secret_scan": op5_secret_scan,
    "op6_suffix_dedup": op6_suffix_dedup,
    "op7_byte_bpe": op7_byte_bpe,
    "op8_quality_classifier": op8_quality_classifier,
    "op9_additive_ann": op9_additive_ann,
    "op10_ngram_jaccard_join": op10_ngram_jaccard_join,
    "op11_spelling_variants": op11_spelling_variants,
    "op12_filter_audit": op12_filter_audit,
    "op13_exact_top_k": op13_exact_top_k,
}

ORACLES: dict[str, str] = {"op5_secret_scan": secret_scan.oracle(), "op12_filter_audit": audit_oracle(), "op13_exact_top_k": top_oracle()}
