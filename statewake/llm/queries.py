"""The registered queries opN_<name>: each applies its operator to the whole of its table."""

from __future__ import annotations

from statewake.llm import collocations, context_tree, decontaminate, language_id, license_scan, near_dup, page_text, quality_rules, secret_scan, source_mix, spelling, token_store, warc_store
from statewake.llm.common import table


def op1_secret_scan(spark, sf_dir):
    return secret_scan.scan_secrets(table(spark, sf_dir, "documents"))


def op2_decontaminate(spark, sf_dir):
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_context_tree(spark, sf_dir):
    return context_tree.score_documents(table(spark, sf_dir, "documents"))


def op4_quality_rules(spark, sf_dir):
    return quality_rules.quality_rules(table(spark, sf_dir, "documents"))


def op5_token_store(spark, sf_dir):
    return token_store.store_tokens(table(spark, sf_dir, "documents"))


def op6_language_id(spark, sf_dir):
    return language_id.identify(table(spark, sf_dir, "documents"))


def op7_warc_store(spark, sf_dir):
    return warc_store.archive_pages(table(spark, sf_dir, "pages"))


def op8_source_mix(spark, sf_dir):
    return source_mix.mix_sources(table(spark, sf_dir, "documents"))


def op9_near_dup(spark, sf_dir):
    return near_dup.near_duplicates(table(spark, sf_dir, "documents"), shingle=4)


def op10_page_text(spark, sf_dir):
    return page_text.extract_text(table(spark, sf_dir, "pages"))


def op11_spelling_variants(spark, sf_dir):
    return spelling.spelling_variants(table(spark, sf_dir, "documents"))


def op12_license_scan(spark, sf_dir):
    return license_scan.scan_licenses(table(spark, sf_dir, "documents"))


def op13_collocations(spark, sf_dir):
    return collocations.collocations(table(spark, sf_dir, "documents"))


def queries():
    return {f.__name__: f for f in (op1_secret_scan, op2_decontaminate, op3_context_tree, op4_quality_rules, op5_token_store, op6_language_id, op7_warc_store, op8_source_mix, op9_near_dup, op10_page_text, op11_spelling_variants, op12_license_scan, op13_collocations)}


def oracle_sql():
    return {"op4_quality_rules": quality_rules.SQL, "op7_warc_store": warc_store.SQL, "op9_near_dup": near_dup.SQL, "op11_spelling_variants": spelling.SQL, "op12_license_scan": license_scan.SQL, "op13_collocations": collocations.SQL}
