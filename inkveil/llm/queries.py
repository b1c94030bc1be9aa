"""The queries of this subpackage over the whole ``documents`` or ``pages`` table, and their SQL."""

from __future__ import annotations

from datetime import date

from . import bpe, exactdedup, filteraudit, licenses, linededup, mixing, quality, simhash, spotsigs, suffixdedup, tokencounts, urlfilter, whitening
from .common import documents


def op1_suffix_dedup(spark, sf_dir):
    return suffixdedup.digests(documents(spark, sf_dir), short=suffixdedup.SHORT)


def op2_mixing(spark, sf_dir):
    return mixing.mix(documents(spark, sf_dir))


def op3_line_dedup(spark, sf_dir):
    return linededup.line_dedup(documents(spark, sf_dir))


def op5_quality(spark, sf_dir):
    return quality.quality(documents(spark, sf_dir))


def op6_simhash(spark, sf_dir):
    return simhash.near_duplicates(documents(spark, sf_dir))


def op4_token_counts(spark, sf_dir):
    return tokencounts.token_counts(documents(spark, sf_dir))


def op7_url_filters(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    pages = pages.withColumn("fetched", urlfilter.fetched_day(pages["page_id"]))
    events = spark.createDataFrame([(k, date.fromisoformat(d), a) for k, d, a in urlfilter.EVENTS], urlfilter.LIST_SCHEMA)
    return urlfilter.url_filter(pages, events.union(urlfilter.derived_events(pages)))


def op8_spotsigs(spark, sf_dir):
    return spotsigs.compare_with_edited(documents(spark, sf_dir))


def spotsigs_join(spark, sf_dir):
    """The operator's join: each document with the class of those that are alike by 0.8 or more, over the whole table."""
    return spotsigs.similar_documents(documents(spark, sf_dir))


def op9_bpe(spark, sf_dir):
    return bpe.digests(documents(spark, sf_dir))


def op10_license_scans(spark, sf_dir):
    return licenses.license_report(documents(spark, sf_dir))


def op11_exact_dedup(spark, sf_dir):
    return exactdedup.exact_groups(documents(spark, sf_dir))


def op12_whitening(spark, sf_dir):
    return whitening.whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op13_filter_audit(spark, sf_dir):
    return filteraudit.filter_audit(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


QUERIES = {
    "op1_suffix_dedup": op1_suffix_dedup,
    "op2_mixing": op2_mixing,
    "op3_line_dedup": op3_line_dedup,
    "op4_token_counts": op4_token_counts,
    "op5_quality": op5_quality,
    "op6_simhash": op6_simhash,
    "op7_url_filters": op7_url_filters,
    "op8_spotsigs": op8_spotsigs,
    "spotsigs_join": spotsigs_join,
    "op9_bpe": op9_bpe,
    "op10_license_scans": op10_license_scans,
    "op11_exact_dedup": op11_exact_dedup,
    "op12_whitening": op12_whitening,
    "op13_filter_audit": op13_filter_audit,
}
ORACLES = {
    "op2_mixing": mixing.ORACLE,
    "op3_line_dedup": linededup.ORACLE,
    "op5_quality": quality.ORACLE,
    "op7_url_filters": urlfilter.ORACLE,
    "op11_exact_dedup": exactdedup.ORACLE,
    "op13_filter_audit": filteraudit.ORACLE,
}
