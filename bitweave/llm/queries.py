"""The training-data queries of the driver contract, one per operator, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .exact_dedup import exact_copies
from .html_extract import extract_pages
from .jaccard_join import similar
from .language_id import identify
from .mixing import Targets, mix
from .oracles import oracles
from .packing import pack
from .substring_dedup import remove_repeats
from .url_filter import Rule, judge
from .va_file import top_k
from .warc import round_trip

URL_RULES = [
    Rule("allow", "com", "/"),
    Rule("block", "example.com", "/en/"),
    Rule("allow", "www.example.com", "/en/"),
    Rule("block", "net", "/es/"),
    Rule("block", "net", "/fr/"),
]

MIX_TARGETS = Targets(
    weights={
        ("web",): 0.5, ("news",): 0.3, ("books",): 0.2,
        **{(d, lang): w for d in ("web", "news", "books") for lang, w in {"en": 0.4, "de": 0.2, "fr": 0.2, "es": 0.2}.items()},
    },
    budget_share=0.5,
    max_epochs=4,
    seed=17,
)


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeats(table(spark, sf_dir, "documents"), window=35)
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents"))


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_copies(table(spark, sf_dir, "documents"))


def op4_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return top_k(rows, rows.where("vec_id % 50 = 0"), k=5)


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar(table(spark, sf_dir, "documents"), width=3, percent=90).select("doc_id", "n_shingles", "component_id")


def op6_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), tokenizer_path(), sequence_tokens=4096, end_id=2)


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "pages"), least_bytes=1000).drop("payload")


def op9_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages"), URL_RULES).select("page_id", "host", "path", "rule", "verdict")


def domain_of(source: str = "source"):
    """Sources are numbered; three domains take them in turn."""
    number = F.coalesce(F.regexp_extract(source, r"(\d+)$", 1).try_cast("int"), F.lit(0))
    return F.element_at(F.array(F.lit("web"), F.lit("news"), F.lit("books")), F.pmod(number, F.lit(3)) + 1)


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mix(table(spark, sf_dir, "documents"), domain_of(), MIX_TARGETS)
    return out.select("doc_id", F.col("_domain").alias("domain"), "lang", "source", F.col("_tokens").alias("n_tokens"), F.col("_epoch").alias("epoch"))


def queries() -> dict:
    import corpus_pipeline

    return {k: f for k, f in globals().items() if k.startswith("op") and k[2:3].isdigit() and callable(f)} | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    import corpus_pipeline

    return oracles(URL_RULES) | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})
