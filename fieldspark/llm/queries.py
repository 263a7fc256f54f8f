"""The registered queries of this subpackage: a name, a callable over (spark, folder), and SQL where it can say the same."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldspark.llm import bpe, conversations, dual_tree, embeddings, jaccard, licenses, packing, pii, pivots, quality_classifier, quality_rules, sql, url_filter, warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(run: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[run.__name__] = run
    return run


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


@query
def op1_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    return quality_rules.quality_rules(table(spark, folder, "documents"))


VOCABULARY = "word_bpe_49k.json"


@query
def op3_bpe(spark: SparkSession, folder: str) -> DataFrame:
    done = bpe.encode_documents(table(spark, folder, "documents"), public_tokenizers.path(VOCABULARY))
    return done.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


@query
def op7_packing(spark: SparkSession, folder: str) -> DataFrame:
    return digested(packing.pack_documents(table(spark, folder, "documents"), public_tokenizers.path(VOCABULARY)))


def digested(pieces: DataFrame) -> DataFrame:
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


RULES = (
    url_filter.Rule("block", "net", "/"),
    url_filter.Rule("allow", "example.net", "/en/"),
    url_filter.Rule("block", "example.com", "/de/"),
    url_filter.Rule("allow", "org", "/fr/"),
)


@query
def op5_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    """The list: canonical URLs of pages of whose markup at least 2 % are symbols."""
    pages = table(spark, folder, "pages")
    junk = pages.filter(100 * F.regexp_count("html", F.lit("[#*$%|]")) >= 2 * F.length("html"))
    return url_filter.judge(pages, junk.select(url_filter.canonical(F.col("url")).alias("canonical")), RULES)


ORACLE["op5_url_filter"] = sql.URL_FILTER


@query
def op6_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    return jaccard.similar(table(spark, folder, "documents"), k=4, percent=85)


ORACLE["op6_jaccard_join"] = sql.JACCARD


@query
def op10_embedding_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return embeddings.near_duplicates(table(spark, folder, "embeddings"))


ORACLE["op10_embedding_near_dedup"] = sql.EMBEDDINGS


@query
def op8_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    return licenses.scan(table(spark, folder, "documents"))


@query
def op4_personal_data(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return pii.digests(pii.find(docs, pii.train(docs)))


@query
def op2_quality_classifier(spark: SparkSession, folder: str) -> DataFrame:
    return quality_classifier.classify(table(spark, folder, "documents"), table(spark, folder, "labels"))


def captures(pages: DataFrame) -> DataFrame:
    """WARC records of the pages: each page is captured in full, a minute for each page_id, and asked for again an hour and
    a day later. Its site answers that nothing changed, with the page's digest as validator; those whose markup has an odd
    length were edited in between and carry another one by the second time."""
    at = F.timestamp_seconds(1_704_067_200 + 60 * F.col("page_id"))
    digest = F.md5(F.coalesce("html", F.lit("")))
    edited = F.coalesce(F.length("html") % 2 == 1, F.lit(False))
    stamp = lambda ts: F.date_format(ts, "yyyy-MM-dd HH:mm:ss")
    hour, day = at + F.expr("INTERVAL 1 HOUR"), at + F.expr("INTERVAL 1 DAY")

    def record(k, ts, kind, status, etag, length, sha):
        said = [F.lit("date"), stamp(ts), F.lit("etag"), etag, F.lit("content-length"), length, F.lit("cache-control"), F.lit(f"max-age={600 * (k + 1)}")]
        return F.struct(
            (3 * F.col("page_id") + k).alias("record_id"), ts.alias("ts"), F.lit(kind).alias("type"), F.lit(status).alias("status"),
            F.create_map(*said).alias("headers"), sha.alias("body_sha256"),
        )

    nothing = F.lit(None).cast("string")
    later = F.concat(F.lit("W/"), F.when(edited, F.concat(digest, F.lit("-2"))).otherwise(digest))
    records = F.array(
        record(0, at, "response", 200, digest, F.length("html").cast("string"), F.sha2(F.col("html"), 256)),
        record(1, hour, "revisit", 304, digest, F.lit("0"), nothing),
        record(2, day, "revisit", 304, later, F.lit("0"), nothing),
    )
    return pages.select(url_filter.canonical(F.col("url")).alias("canonical"), F.explode(records).alias("r")).select("canonical", "r.*")


@query
def op9_warc_revisits(spark: SparkSession, folder: str) -> DataFrame:
    found = warc.resolve_revisits(captures(table(spark, folder, "pages")), ["body_sha256"])
    return found.withColumn("headers", warc.header_lines(F.col("headers"))).withColumn("ts", F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))


ORACLE["op9_warc_revisits"] = sql.WARC


@query
def op12_conversation_repair(spark: SparkSession, folder: str) -> DataFrame:
    return conversations.planted_and_repaired(table(spark, folder, "conversations"))


ORACLE["op12_conversation_repair"] = sql.CONVERSATIONS


@query
def op11_top_products(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "embeddings").select("vec_id", pivots.quantised(F.col("embedding")).alias("v"))
    return pivots.top_products(rows.filter("vec_id % 20 = 0").withColumnRenamed("vec_id", "query_id"), rows)


ORACLE["op11_top_products"] = sql.TOP_PRODUCTS


@query
def op13_ranked_search(spark: SparkSession, folder: str) -> DataFrame:
    return dual_tree.rank_documents(table(spark, folder, "benchmark"), table(spark, folder, "documents"))


ORACLE["op13_ranked_search"] = sql.RANKED
