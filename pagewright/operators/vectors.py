"""Vector search, prototype classification and hybrid ranking.

Vectors are array<float>; dot products run in double inside the JVM. A query or a set of
prototypes is of fixed, small size and becomes part of the plan, so no pair of tables is multiplied.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagewright.functions import text as X
from pagewright.functions import urls as U

#: Prototypes that may go into a plan.
MAX_PROTOTYPES = 10_000


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def top_k(vectors: DataFrame, query: list[float], k: int, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(key, semantic_score): the ``k`` best dot products, ties by key; a top-k per task, then of the tasks."""
    q = F.array(*[F.lit(float(x)) for x in query])
    return vectors.select(key, dot(F.col(vector), q).alias("semantic_score")).orderBy(F.desc("semantic_score"), F.asc(key)).limit(k)


def class_maxima(vectors: DataFrame, prototypes: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", leave_one_out: bool = False) -> DataFrame:
    """(key, personal, corporate): the highest similarity to prototypes of label 1 and 0.

    Prototypes are counted and must not exceed MAX_PROTOTYPES; they are multiplied as one
    matrix per batch. Null if a class has no prototype. With ``leave_one_out`` a row is not compared with itself.
    """
    protos = prototypes.select(key, vector, label).orderBy(key).limit(MAX_PROTOTYPES + 1).collect()
    if len(protos) > MAX_PROTOTYPES:
        raise ValueError(f"more than {MAX_PROTOTYPES} prototypes")
    ids = np.array([r[0] for r in protos])
    m = np.array([r[1] for r in protos], np.float64).reshape(len(protos), -1)
    y = np.array([r[2] for r in protos])
    shared = vectors.sparkSession.sparkContext.broadcast((ids, m, y))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, m, y = shared.value
        for b in batches:
            out = {key: b[key], "personal": np.full(len(b), np.nan), "corporate": np.full(len(b), np.nan)}
            if len(b) and len(m):
                s = np.stack(b[vector].to_numpy()).astype(np.float64) @ m.T
                if leave_one_out:
                    s[b[key].to_numpy()[:, None] == ids[None, :]] = -np.inf
                for name, c in (("personal", 1), ("corporate", 0)):
                    if (y == c).any():
                        out[name] = s[:, y == c].max(axis=1)
            yield pd.DataFrame(out)

    kind = vectors.schema[key].dataType.simpleString()
    got = vectors.filter(F.col(vector).isNotNull()).select(key, vector).mapInPandas(run, f"{key} {kind}, personal double, corporate double")
    return got.select(key, *[F.when(~F.isnan(c), F.col(c)).alias(c) for c in ("personal", "corporate")])


def prototype_decision(personal: Column, corporate: Column, threshold: float = 0.7) -> Column:
    """struct(prediction, confidence): the class with the higher similarity, ties to 0, null below the threshold; the confidence is kept."""
    p, c = F.coalesce(personal, F.lit(0.0)), F.coalesce(corporate, F.lit(0.0))
    best = F.greatest(p, c)
    return F.struct(F.when(best >= threshold, (p > c).cast("int")).alias("prediction"), best.alias("confidence"))


def hashing_encoder(dim: int = 256) -> Callable[[Column], Column]:
    """A stand-in encoder: words counted in the bucket of their MD5, scaled to unit length; null and empty texts give zeros.

    Any pandas UDF string -> array of numbers can take its place.
    """

    @F.pandas_udf("array<double>")
    def encode(texts: pd.Series) -> pd.Series:
        from hashlib import md5

        known: dict[str, int] = {}
        out = []
        for t in texts:
            v = np.zeros(dim)
            for w in (t or "").lower().split():
                at = known.get(w)
                if at is None:
                    at = known[w] = int(md5(w.encode()).hexdigest()[:4], 16) % dim
                v[at] += 1.0
            n = float(np.linalg.norm(v))
            out.append(v / n if n else v)
        return pd.Series(out)

    return encode


def embed_corpus(docs: DataFrame, key: str, encoder: Callable[[Column], Column], max_docs: int = 0, title: str = "title", content: str = "content", kind: str = "array<float>") -> DataFrame:
    """(key, embedding): title and first 500 characters of the content, encoded and cast to ``kind``.

    ``max_docs`` above 0 takes only so many documents, the first by key (a top-k, not a full sort). The encoder
    works on Arrow batches (spark.sql.execution.arrow.maxRecordsPerBatch).
    """
    text = docs.select(key, X.embedding_text(F.col(title), F.col(content)).alias("t"))
    if max_docs > 0:
        text = text.orderBy(key).limit(max_docs)
    return text.select(key, encoder(F.col("t")).cast(kind).alias("embedding"))


def classify_pages(pages: DataFrame, prototypes: DataFrame, encoder: Callable[[Column], Column], key: str, threshold: float = 0.7) -> DataFrame:
    """(key, domain, is_personal, confidence): text representation, encoder, nearest prototypes.

    ``pages`` has key, url, title, description and content; ``prototypes`` (proto_id, title, domain, meta_description, content, is_personal). Null fields are left out of
    the representation; a page none of whose prototypes reaches ``threshold`` has a null class.
    """

    def vectors(df: DataFrame, name: str, domain: Column, description: str) -> DataFrame:
        return df.select(F.col(name).cast("long").alias("vec_id"), encoder(X.representation(F.col("title"), domain, F.col(description), F.col("content"))).alias("embedding"), *(["is_personal"] if name == "proto_id" else []))

    protos = vectors(prototypes.filter("is_personal is not null"), "proto_id", F.col("domain"), "meta_description").withColumnRenamed("is_personal", "label")
    near = class_maxima(vectors(pages, key, U.extracted_domain(F.col("url")), "description"), protos)
    r = near.select(F.col("vec_id").alias(key), prototype_decision(F.col("personal"), F.col("corporate"), threshold).alias("r"))
    return pages.select(key, U.extracted_domain(F.col("url")).alias("domain")).join(r, key).select(key, "domain", F.col("r.prediction").alias("is_personal"), F.col("r.confidence").alias("confidence"))


def hybrid(keyword: DataFrame, semantic: DataFrame, k: int) -> DataFrame:
    """(url, hybrid_score, origin): keyword rows score 0.3 of their semantic score (0 without one), other semantic rows 0.7 of theirs.

    ``keyword`` has (url), ``semantic`` (url, semantic_score); both are top lists. A url listed twice semantically counts with its highest score.
    """
    sem = semantic.groupBy("url").agg(F.max("semantic_score").alias("semantic_score"))
    a = keyword.select("url").distinct().join(sem, "url", "left").select("url", (F.coalesce("semantic_score", F.lit(0.0)) * 0.3).alias("hybrid_score"), F.lit("keyword").alias("origin"))
    b = sem.join(keyword.select("url"), "url", "left_anti").select("url", (F.col("semantic_score") * 0.7).alias("hybrid_score"), F.lit("semantic").alias("origin"))
    return a.unionByName(b).orderBy(F.desc("hybrid_score"), F.asc("url")).limit(k)


def fallback_merge(basic: DataFrame, semantic: DataFrame, limit: int) -> DataFrame:
    """(url, src, pos): basic rows first, then semantic ones not among them by normal url, one row per normal url, at most ``limit``.

    Semantic rows only count if there are fewer than 0.8 * limit basic rows. Inputs have (url, pos).
    """
    few = basic.agg((F.count("*") < 0.8 * limit).alias("few"))
    both = basic.select("url", F.lit(0).alias("src"), "pos").unionByName(semantic.select("url", F.lit(1).alias("src"), "pos"))
    keyed = both.crossJoin(F.broadcast(few)).filter((F.col("src") == 0) | F.col("few")).withColumn("key", U.normalize(F.col("url"))).filter("key <> ''")  # one row
    first = keyed.groupBy("key").agg(F.min(F.struct("src", "pos", "url")).alias("r")).select("r.*")
    return first.orderBy("src", "pos").limit(limit).select("url", "src", "pos")
