"""The queries and oracle SQL of this subpackage, by name."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import lexical_search, warc
from .binpack import WORDS, packed_best_fit
from .conversation import repaired_conversations
from .flac import media_round_trip
from .html_extract import main_texts
from .iblt import fingerprints
from .langid import languages
from .lexical_search import ranked
from .lm_score import lm_scores
from .mixing import mixture_plan
from .packing import packed
from .quality import quality_scores
from .simhash import near_duplicates
from .warc import warc_round_trip


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixture_plan(table(spark, sf_dir, "documents"))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc_round_trip(table(spark, sf_dir, "pages"))


def op4_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scores(table(spark, sf_dir, "documents"))


def op5_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(table(spark, sf_dir, "documents"))


def op6_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_texts(table(spark, sf_dir, "pages"))


def op7_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op8_media_flac(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_round_trip(table(spark, sf_dir, "documents"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(table(spark, sf_dir, "documents"), temperature=0.5, generation=WORDS)


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return languages(table(spark, sf_dir, "documents"))


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed_best_fit(table(spark, sf_dir, "documents"))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repaired_conversations(table(spark, sf_dir, "conversations"))


QUERIES = {f.__name__: f for f in (op1_quality_classifier, op2_mixing, op3_warc, op4_lm_scoring, op5_fingerprints, op6_html_extraction, op7_simhash_near_dedup, op8_media_flac, op9_packing, op10_language_id, op11_lexical_search, op12_best_fit_packing, op13_conversation_repair)}

ORACLE_SQL: dict[str, str] = {"op3_warc": warc.ORACLE_SQL, "op11_lexical_search": lexical_search.ORACLE_SQL}
