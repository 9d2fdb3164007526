"""The registered queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from . import fingerprint, html_extract, jpeg, langid, mixing, packing, pii, simhash, suffix_dedup, toxicity
from .common import table


def op1_mix_sources(spark, sf_dir):
    return mixing.mix_sizes(table(spark, sf_dir, "documents"))


def op2_version_fingerprints(spark, sf_dir):
    return fingerprint.compare_versions(table(spark, sf_dir, "documents"))


def op3_html_text(spark, sf_dir):
    return html_extract.extract_pages(table(spark, sf_dir, "pages"))


def op4_language(spark, sf_dir):
    return langid.language_of(table(spark, sf_dir, "documents"))


def op5_packing(spark, sf_dir):
    return packing.pack(table(spark, sf_dir, "documents"))


def op6_pii(spark, sf_dir):
    return pii.pii_report(table(spark, sf_dir, "documents"), pii.session_key(spark))


def op7_simhash(spark, sf_dir):
    return simhash.components(table(spark, sf_dir, "documents"))


def op8_suffix_dedup(spark, sf_dir):
    return suffix_dedup.removed(table(spark, sf_dir, "documents"))


def op9_toxicity(spark, sf_dir):
    return toxicity.toxicity_of(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_media_columns(spark, sf_dir):
    return jpeg.media_columns(table(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_mix_sources, op2_version_fingerprints, op3_html_text, op4_language, op5_packing,
        op6_pii, op7_simhash, op8_suffix_dedup, op9_toxicity, op10_media_columns,
    )
}

ORACLE_SQL = {"op1_mix_sources": mixing.SQL, "op8_suffix_dedup": suffix_dedup.SQL}
