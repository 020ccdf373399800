"""The thin queries of this subpackage; each takes (spark, sf_dir)."""

from __future__ import annotations

from covalens.llm.common import table


def op10_suffix_array_dedup(spark, sf_dir):
    from covalens.llm.suffix_dedup import suffix_dedup

    return suffix_dedup(table(spark, sf_dir, "documents"), 50, keep=False)


def op5_simhash_near_dedup(spark, sf_dir):
    from covalens.llm.simhash import simhash_components

    return simhash_components(table(spark, sf_dir, "documents"), shingle=4, bits=4)


def op1_benchmark_decontamination(spark, sf_dir):
    from covalens.llm.decontaminate import contained_items

    return contained_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=5, threshold=0.8)


def op2_document_fingerprints(spark, sf_dir):
    from covalens.llm.winnow import fingerprinted

    return fingerprinted(table(spark, sf_dir, "documents"), k=5, w=4)


def op7_quality_classifier(spark, sf_dir):
    from covalens.llm.quality import scored

    return scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), threshold=0.3, bound=8000)


def op8_language_id(spark, sf_dir):
    from covalens.llm.langid import identified

    return identified(table(spark, sf_dir, "documents"))


def op9_best_fit_packing(spark, sf_dir):
    from covalens.llm.packing import SIZES, packed

    return packed(table(spark, sf_dir, "documents"), SIZES)


def op4_preference_formatting(spark, sf_dir):
    from covalens.llm.preference import preference_pairs

    return preference_pairs(table(spark, sf_dir, "conversations"))


def op3_warc_index_merge(spark, sf_dir):
    from covalens.llm.warc import archived

    return archived(table(spark, sf_dir, "pages"))


def op6_lm_scoring(spark, sf_dir):
    from covalens.llm.interpolation import scored

    return scored(table(spark, sf_dir, "documents"), order=2)
