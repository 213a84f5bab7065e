"""The registered queries of the training-data operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lodestone.llm.bpe_trie import encode_corpus
from lodestone.llm.mixing import mix_report, mix_sources
from lodestone.llm.near_duplicates import near_duplicate_groups, same_group_pairs
from lodestone.llm.provenance import not_hand_written
from lodestone.llm.sentences import sentence_starts, sentence_units
from lodestone.llm.similar_vectors import most_similar, similar_pairs
from lodestone.llm.splitting import chunk_boundaries, chunk_pieces
from lodestone.llm.syntax import invalid_rates, judge_files
from lodestone.sources.tables import current_corpus, current_files, table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return same_group_pairs(p1_groups(spark, sf_dir))


def p1_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicate_groups(table(spark, sf_dir, "memories"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_files(current_corpus(spark, sf_dir)).where("not valid").select("workspace", "path")


def p2_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return invalid_rates(judge_files(current_corpus(spark, sf_dir)))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunk_boundaries(table(spark, sf_dir, "chunks"))


def p3_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunk_pieces(table(spark, sf_dir, "chunks"))


def p4_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return not_hand_written(current_files(spark, sf_dir), current_corpus(spark, sf_dir))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p4_reasons(spark, sf_dir).select("workspace", "path")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_pairs(most_similar(table(spark, sf_dir, "memories")))


def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_corpus(table(spark, sf_dir, "documents"))


def p7_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))


def p7_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_report(p7_repeats(spark, sf_dir), table(spark, sf_dir, "mix_targets"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentence_starts(table(spark, sf_dir, "documents"))


def p8_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentence_units(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "p1_found": p1_found,
        "p1_groups": p1_groups,
        "p2_found": p2_found,
        "p2_rates": p2_rates,
        "p3_found": p3_found,
        "p3_pieces": p3_pieces,
        "p4_found": p4_found,
        "p4_reasons": p4_reasons,
        "p5_found": p5_found,
        "p6_ids": p6_ids,
        "p7_repeats": p7_repeats,
        "p7_shares": p7_shares,
        "p8_found": p8_found,
        "p8_units": p8_units,
    }


_P1_LINKS = r"""
WITH RECURSIVE w AS (
  SELECT DISTINCT id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) AS word FROM memories WHERE text IS NOT NULL
), n AS (SELECT id, count(*) AS n FROM w GROUP BY id),
shared AS (
  SELECT a.id AS a, b.id AS b, count(*) AS s FROM w a JOIN w b ON a.word = b.word AND a.id != b.id GROUP BY a.id, b.id
), links AS (
  SELECT a, b FROM shared JOIN n x ON x.id = a JOIN n y ON y.id = b WHERE s >= 0.65 * (x.n + y.n - s)
), reach(id, to_id) AS (
  SELECT id, id FROM n UNION SELECT r.id, l.b FROM reach r JOIN links l ON l.a = r.to_id
), groups AS (SELECT id, min(to_id) AS group_id FROM reach GROUP BY id)
"""


def oracle_sql() -> dict[str, str]:
    return {
        "p1_found": _P1_LINKS + "SELECT a.id AS id_a, b.id AS id_b FROM groups a JOIN groups b ON a.group_id = b.group_id AND a.id < b.id",
    }
