"""The corpus queries by name: thin calls of the operators with production parameters."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from flowlens.llm import (
    check_sql, chunked_bpe, decontaminate, fill_in_middle, filter_audit, html_extract, licenses, packing, prefix_tokens, quality_rank, quality_rules, simhash,
    token_files, toxicity,
)
from flowlens.llm.common import table
from flowlens.session import shared_dir


def op1_token_files(spark, folder):
    """Token files of `documents`, written in document order, as read back."""
    import public_tokenizers

    path = f"{shared_dir(spark)}/corpus/tokens-{uuid.uuid4().hex}"
    ordered = token_files.in_order(table(spark, folder, "documents"))
    token_files.write(token_files.tokenize_words(ordered, public_tokenizers.path("word_bpe_49k.json"), end_id=2), path)
    return token_files.digests(token_files.read(spark, path))


def op2_simhash(spark, folder):
    """Groups of near-duplicate `documents` by fingerprints that differ in at most three bits."""
    return simhash.near_duplicates(table(spark, folder, "documents"), most=3)


def op3_toxicity(spark, folder):
    """Toxicity of `documents` by weak supervision."""
    docs = table(spark, folder, "documents")
    return toxicity.classify(docs, toxicity.fit(docs, table(spark, folder, "labels")), cut=0.5)


def op4_decontamination(spark, folder):
    """Overlaps of `documents` with items of `benchmark`."""
    return decontaminate.leaks(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


def op5_quality_rules(spark, folder):
    """Base rules and divergence of `documents` from their languages' histograms."""
    return quality_rules.judge(table(spark, folder, "documents")).drop("character_distance", "word_distance")


def op6_license_scan(spark, folder):
    """License phrases and templates in `documents`."""
    return licenses.scan(table(spark, folder, "documents"))


def op7_token_counts(spark, folder):
    """Exact token counts of `documents` and how much of each text fits 512 tokens."""
    import public_tokenizers

    return prefix_tokens.token_budget(
        table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN, 512)


def op8_html_text(spark, folder):
    """Main text of `pages`."""
    return html_extract.extract(table(spark, folder, "pages"))


def op9_quality_rank(spark, folder):
    """Quality of `documents` by ranking preference pairs."""
    docs = table(spark, folder, "documents")
    return quality_rank.classify(docs, quality_rank.fit(docs, table(spark, folder, "labels"), cut=0.3), cut=0.3)


def op10_bpe_round_trip(spark, folder):
    """Encoding of `documents` by ranks and its decoding, as digests."""
    import public_tokenizers

    ranks, pattern = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    return chunked_bpe.round_trip(chunked_bpe.encode(table(spark, folder, "documents"), ranks, pattern), ranks, pattern)


def op11_filter_audit(spark, folder):
    """Audit of five filters over `documents`, per source, order and step."""
    return filter_audit.audit(filter_audit.fail_masks(table(spark, folder, "documents"), table(spark, folder, "labels")))


def op12_best_fit_packing(spark, folder):
    """Places of the pieces of `documents` in sequences of 2048 tokens."""
    import public_tokenizers

    pieces = packing.pieces(table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN, end_id=0, capacity=2048)
    return packing.pack(pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32")), capacity=2048)


def op13_fill_in_middle(spark, folder):
    """Fill-in-the-middle form of `documents`, with digests of the outputs and of the texts rebuilt from them."""
    cut = fill_in_middle.transform(table(spark, folder, "documents"))
    return cut.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"),
        F.sha2(fill_in_middle.restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"))


QUERIES = {
    f.__name__: f for f in (
        op1_token_files, op2_simhash, op3_toxicity, op4_decontamination, op5_quality_rules, op6_license_scan, op7_token_counts, op8_html_text, op9_quality_rank,
        op10_bpe_round_trip, op11_filter_audit, op12_best_fit_packing, op13_fill_in_middle)
}
# The other operators are beyond SQL; tests hold them against libraries and plain versions.
ORACLE = {
    "op5_quality_rules": check_sql.quality_rules(), "op6_license_scan": check_sql.license_scan(), "op11_filter_audit": check_sql.filter_audit(),
    "op13_fill_in_middle": check_sql.fill_in_middle(),
}
