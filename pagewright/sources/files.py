"""JSON documents and lists, with encodings to try, feeds, and stores of vectors, prototypes and models."""

from __future__ import annotations

import json

from pyspark.errors import AnalysisException
from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagewright.functions import html as H

#: Search document as the index builder writes it; rows of the ingest form lack most fields.
DOCUMENT = (
    "url string, title string, description string, content string, author string, domain string, is_personal int, confidence double, stage_used string, extracted_at string, "
    "content_length int, added_at string"
)
PROTOTYPE = "url string, title string, domain string, meta_description string, content string, author string, is_personal int"
#: Encodings tried in this order; the first that decodes and parses wins.
ENCODINGS = ("utf-8", "utf-8-sig", "latin-1", "cp1252", "iso-8859-1")


def read_documents(spark: SparkSession, path: str, schema: str = DOCUMENT) -> DataFrame:
    """A JSON array of objects (or one object per line); missing fields are null."""
    return spark.read.schema(schema).json(path, multiLine=True)


def read_prototypes(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """The labelled prototypes of a JSON array: personal ones, and all others."""
    rows = read_documents(spark, path, PROTOTYPE)
    yes = F.coalesce(F.col("is_personal") == 1, F.lit(False))
    return rows.filter(yes), rows.filter(~yes)


def read_taxonomy(spark: SparkSession, path: str) -> DataFrame:
    """(scope, polarity, category, ord, pattern, weight) of a taxonomy file with domain_patterns and content_indicators."""
    leaf = "struct<patterns:array<string>,weight:int>"
    schema = f"domain_patterns map<string,{leaf}>, content_indicators struct<positive_regex:map<string,{leaf}>,negative_regex:map<string,{leaf}>>"
    raw = spark.read.schema(schema).json(path, multiLine=True)

    def part(column: str, scope: str, polarity: str | None) -> DataFrame:
        e = raw.select(F.explode(column).alias("category", "v")).select("category", "v.weight", F.posexplode("v.patterns").alias("ord", "pattern"))
        sign = F.when(F.col("weight") >= 0, "positive").otherwise("negative") if polarity is None else F.lit(polarity)
        return e.select(F.lit(scope).alias("scope"), sign.alias("polarity"), "category", "ord", "pattern", "weight")

    out = part("domain_patterns", "domain", None)
    return out.unionByName(part("content_indicators.positive_regex", "content", "positive")).unionByName(part("content_indicators.negative_regex", "content", "negative"))


def read_seeds(spark: SparkSession, path: str, n: int = 3) -> DataFrame:
    """(url): the first ``n`` urls of a JSON list of strings."""
    raw = spark.read.text(path, wholetext=True)
    urls = F.from_json("value", "array<string>")
    return raw.select(F.explode(F.slice(F.coalesce(urls, F.array().cast("array<string>")), 1, n)).alias("url"))


def read_any_encoding(spark: SparkSession, path: str, schema: str = DOCUMENT) -> DataFrame:
    """JSON arrays in files of unknown encoding: (path, encoding, and the fields of ``schema``). Files that none fits are left out."""

    def decode(rows):  # noqa: ANN001, ANN202
        import pandas as pd

        for b in rows:
            out = []
            for p, c in zip(b.path, b.content):
                for e in ENCODINGS:
                    try:
                        text = bytes(c).decode(e)
                        json.loads(text)
                    except (UnicodeDecodeError, ValueError):
                        continue
                    out.append((p, e, text))
                    break
            yield pd.DataFrame(out, columns=["path", "encoding", "text"])

    raw = spark.read.format("binaryFile").load(path).select("path", "content")
    parsed = raw.mapInPandas(decode, "path string, encoding string, text string")
    row = T.StructType.fromDDL(schema)
    return parsed.select("path", "encoding", F.explode(F.from_json("text", T.ArrayType(row))).alias("r")).select("path", "encoding", "r.*")


def feed_items(spark: SparkSession, path: str, limit: int = 50) -> DataFrame:
    """(feed, pos, link) of RSS items and Atom entries in XML files, the first ``limit`` per file in document order."""
    raw = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("feed"), "value")
    return raw.select("feed", F.posexplode(F.slice(H.feed_links(F.col("value")), 1, limit)).alias("pos", "link"))


def write_index(df: DataFrame, path: str, mode: str = "overwrite", fmt: str = "parquet") -> None:
    """The index as parquet or JSON lines; appending adds files and rewrites none."""
    df.write.mode(mode).format(fmt).save(path)


def write_postings(posts: DataFrame, path: str, partitions: int | None = None) -> None:
    """Postings clustered and sorted by term, so that a query reads few row groups."""
    p = posts.repartitionByRange(partitions, "term") if partitions else posts.repartitionByRange("term")
    p.sortWithinPartitions("term").write.mode("overwrite").parquet(path)


def write_report(df: DataFrame, path: str) -> None:
    """A small report as one JSON file."""
    df.coalesce(1).write.mode("overwrite").json(path)


def load_or_create(spark: SparkSession, path: str, create) -> DataFrame:  # noqa: ANN001
    """The parquet table at ``path``; if there is none, ``create()`` is written there first. A table that cannot be read is an error, and stays as it is."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
    create().write.mode("errorifexists").parquet(path)
    return spark.read.parquet(path)


def write_prototype_store(protos: DataFrame, params: dict, path: str) -> None:
    """Prototype vectors as parquet and the parameters beside them."""
    protos.write.mode("overwrite").parquet(f"{path}/vectors")
    spark = protos.sparkSession
    spark.createDataFrame([(json.dumps(params),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/params")


def read_prototype_store(spark: SparkSession, path: str) -> tuple[DataFrame, dict]:
    return spark.read.parquet(f"{path}/vectors"), json.loads(spark.read.text(f"{path}/params").first()[0])


def save_model(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def first_items(df: DataFrame, key: str, order: str, n: int) -> DataFrame:
    """The first ``n`` rows per key; a window group limit keeps hot keys small before the shuffle."""
    w = Window.partitionBy(key).orderBy(order)
    return df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= n).drop("_rn")
