"""The registered queries of this subpackage, and the SQL that checks them."""

from __future__ import annotations

from korrel.llm.common import table

BYTE_BPE, WORD_BPE = "byte_bpe_50k.json", "word_bpe_49k.json"


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_simhash_dedup(spark, sf_dir):
    from korrel.llm.simhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


def op8_substring_dedup(spark, sf_dir):
    from korrel.llm.substring import dedup_substrings

    return dedup_substrings(table(spark, sf_dir, "documents"))


def op10_token_id_files(spark, sf_dir):
    from korrel.llm.frames import id_files

    return id_files(table(spark, sf_dir, "documents"), tokenizer_path(BYTE_BPE))


def op5_mixture_packing(spark, sf_dir):
    from korrel.llm.packing import pack

    return pack(table(spark, sf_dir, "documents"), tokenizer_path(BYTE_BPE))


def op3_token_counts(spark, sf_dir):
    from korrel.llm.transducer import token_counts

    return token_counts(table(spark, sf_dir, "documents"), tokenizer_path(WORD_BPE))


def op4_media_fingerprints(spark, sf_dir):
    from korrel.llm.media import media_digests

    return media_digests(table(spark, sf_dir, "documents"))


def op6_cotrained_quality(spark, sf_dir):
    from korrel.llm.cotrain import classify

    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_preference_format(spark, sf_dir):
    from korrel.llm.chat import preference_table

    return preference_table(table(spark, sf_dir, "conversations"))


def op9_cross_entropy_difference(spark, sf_dir):
    from korrel.llm.lm import cross_entropy_difference, target_documents

    return cross_entropy_difference(table(spark, sf_dir, "documents"), target_documents(table(spark, sf_dir, "labels")))


def op2_benchmark_decontamination(spark, sf_dir):
    from korrel.llm.decontaminate import find_leaks

    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op11_merkle_manifest(spark, sf_dir):
    from korrel.llm.merkle import proofs

    return proofs(table(spark, sf_dir, "documents"))


def op12_quantile_summaries(spark, sf_dir):
    from korrel.llm.quantiles import stream_quantiles

    return stream_quantiles(table(spark, sf_dir, "clicks"), table(spark, sf_dir, "sale_lines"), table(spark, sf_dir, "items"))


def op13_warc_archives(spark, sf_dir):
    from korrel.llm.warc import archived

    return archived(table(spark, sf_dir, "pages"))


def queries() -> dict:
    return {k: f for k, f in globals().items() if k.startswith("op") and callable(f)}


def oracle_sql() -> dict[str, str]:
    from korrel.llm.chat import PREFERENCE_SQL
    from korrel.llm.merkle import MERKLE_SQL
    from korrel.llm.warc import WARC_SQL

    return {"op7_preference_format": PREFERENCE_SQL, "op11_merkle_manifest": MERKLE_SQL, "op13_warc_archives": WARC_SQL}
