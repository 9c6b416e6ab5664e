"""The queries of this subpackage and their SQL counterparts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.llm import contexts
from gleaner.llm.boilerplate import fitted, main_bodies, repeated_blocks, with_repeated
from gleaner.llm.canonical import link_copies, link_records
from gleaner.llm.leakage import find_leaks, leak_matches, remove_leaks
from gleaner.llm.residue import is_residue, residue_pages, with_challenged
from gleaner.llm.spans import shared_spans
from gleaner.llm.survivors import best_fields, keyed, vote_records
from gleaner.llm.tokens import encode_corpus
from gleaner.session import table, written


def _pages(spark: SparkSession, folder: str) -> DataFrame:
    """Pages with what repeats on their site and whether it ever showed a challenge."""
    pages = table(spark, folder, "pages")
    repeated = written(repeated_blocks(pages))  # one short list a site, for the sample and for all pages
    return with_challenged(with_repeated(pages, repeated), table(spark, folder, "domain_patterns"))


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    pages = _pages(spark, folder)
    model, words = contexts.fitted_both(pages)
    bodies = main_bodies(pages, model, is_residue)
    return bodies.unionByName(contexts.framed_contexts(table(spark, folder, "candidates"), words))


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    pages = _pages(spark, folder)
    return residue_pages(pages, fitted(pages))


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return link_copies(table(spark, folder, "candidates"))


def p3_records(spark: SparkSession, folder: str) -> DataFrame:
    return link_records(table(spark, folder, "candidates"))


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    return best_fields(keyed(table(spark, folder, "candidates")), table(spark, folder, "domain_patterns"))


def p6_votes(spark: SparkSession, folder: str) -> DataFrame:
    candidates = table(spark, folder, "candidates")
    newest = candidates.where("url is not null").agg(F.max("found_at"))
    return vote_records(keyed(candidates), table(spark, folder, "domain_patterns"), newest=newest)


def p7_ids(spark: SparkSession, folder: str) -> DataFrame:
    return encode_corpus(table(spark, folder, "documents"))


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    return find_leaks(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


def p8_matches(spark: SparkSession, folder: str) -> DataFrame:
    return leak_matches(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


def p8_clean(spark: SparkSession, folder: str) -> DataFrame:
    return remove_leaks(table(spark, folder, "documents"), table(spark, folder, "benchmark")).select("doc_id")


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    return shared_spans(table(spark, folder, "documents"))


QUERIES = {"p1_found": p1_found, "p5_found": p5_found, "p3_found": p3_found, "p3_records": p3_records, "p6_found": p6_found, "p6_votes": p6_votes, "p7_ids": p7_ids, "p8_found": p8_found, "p8_matches": p8_matches, "p8_clean": p8_clean, "p9_found": p9_found}
SQL: dict[str, str] = {}
