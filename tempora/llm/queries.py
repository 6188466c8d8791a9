"""Registered queries of the operators, each over its whole table, with the SQL it is checked against where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tempora.llm import (audit, chat, fingerprints, incidence, lattice, lines, mixing, neardup, outliers, packing, sharding, substrings,
                         whitening)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op1_threshold_fingerprints")
def _(spark, sf_dir):
    return fingerprints.fingerprint_edits(table(spark, sf_dir, "documents"))


@query("op2_count_min_substrings", substrings.SQL)
def _(spark, sf_dir):
    return substrings.digest(substrings.remove_repeats(table(spark, sf_dir, "documents")))


@query("op3_site_lines", lines.SQL)
def _(spark, sf_dir):
    return lines.digest(lines.clean_pages(table(spark, sf_dir, "pages")))


@query("op4_chat_snapshots", chat.SQL)
def _(spark, sf_dir):
    return chat.render(table(spark, sf_dir, "conversations"))


@query("op6_entropy_mix")
def _(spark, sf_dir):
    return mixing.mix_table(table(spark, sf_dir, "documents"))


@query("op9_mcd_outliers")
def _(spark, sf_dir):
    return outliers.quality_table(table(spark, sf_dir, "documents"))


@query("op10_vector_sharding")
def _(spark, sf_dir):
    return sharding.shard_table(table(spark, sf_dir, "documents"))


@query("op5_probminhash_classes")
def _(spark, sf_dir):
    return neardup.class_table(table(spark, sf_dir, "documents"))


@query("op7_subword_lattice")
def _(spark, sf_dir):
    return lattice.score(table(spark, sf_dir, "documents"))


@query("op8_grouping_genetic_packing")
def _(spark, sf_dir):
    return packing.pack(table(spark, sf_dir, "documents"))


@query("op11_bit_sliced_whitening")
def _(spark, sf_dir):
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


@query("op12_incidence_join", incidence.SQL)
def _(spark, sf_dir):
    return incidence.join_documents(table(spark, sf_dir, "documents"))


@query("op13_trie_filter_audit", audit.SQL)
def _(spark, sf_dir):
    return audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
