"""The queries of this subpackage; every one runs over its whole table."""

from __future__ import annotations

import public_tokenizers

from granary.llm import decontam, fingerprints, html_text, language, mixing, near_dup, secrets, spelling, tokens, toxicity, url_rules, warc, whitening
from granary.session import scratch, table


def op1_fingerprints(spark, sf_dir):
    return fingerprints.fingerprint_with_next(table(spark, sf_dir, "documents", spread=True))


def op2_warc(spark, sf_dir):
    pages = table(spark, sf_dir, "pages", spread=True)
    out = scratch(spark, "warc")
    warc.write_warc(pages, out)
    return warc.read_warc(spark, out, html=False).drop("html", "url")


def op3_mixing(spark, sf_dir):
    return mixing.mix_sources(table(spark, sf_dir, "documents"))


def op4_secrets(spark, sf_dir):
    return secrets.scan_secrets(table(spark, sf_dir, "documents", spread=True))


def op5_tokens(spark, sf_dir):
    return tokens.count_tokens(table(spark, sf_dir, "documents", spread=True), public_tokenizers.path("byte_bpe_50k.json"))


def op6_toxicity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents", spread=True)
    return toxicity.score_toxicity(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def op7_html(spark, sf_dir):
    return html_text.extract(table(spark, sf_dir, "pages", spread=True))


def op8_near_dup(spark, sf_dir):
    return near_dup.near_duplicates(table(spark, sf_dir, "documents", spread=True))


def op9_language(spark, sf_dir):
    """Documents: the lang column is the declared language, the source stands for the host."""
    return language.identify(table(spark, sf_dir, "documents", spread=True))


def language_of_pages(spark, sf_dir):
    """The same operator over web pages, with the html tag, the address suffix and the host as evidence."""
    return language.identify_pages(table(spark, sf_dir, "pages", spread=True))


def op10_decontamination(spark, sf_dir):
    return decontam.find_leaks(table(spark, sf_dir, "documents", spread=True), table(spark, sf_dir, "benchmark"))


def op11_spelling(spark, sf_dir):
    return spelling.spelling_variants(table(spark, sf_dir, "documents", spread=True))


def op12_whitening(spark, sf_dir):
    return whitening.whitened(table(spark, sf_dir, "embeddings"))


def op13_url_rules(spark, sf_dir):
    return url_rules.judge_urls(table(spark, sf_dir, "pages"), url_rules.rule_table(spark, url_rules.LISTED + url_rules.PATTERNS))


QUERIES = {f.__name__: f for f in (op1_fingerprints, op2_warc, op3_mixing, op4_secrets, op5_tokens, op6_toxicity, op7_html, op8_near_dup, op9_language, op10_decontamination, op11_spelling, op12_whitening, op13_url_rules, language_of_pages)}
ORACLE_SQL = {"op2_warc": warc.ORACLE, "op3_mixing": mixing.ORACLE, "op13_url_rules": url_rules.ORACLE}
