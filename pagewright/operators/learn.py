"""TF-IDF with logistic regression, in Spark ML."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizer, ElementwiseProduct, IDF, NGram, Normalizer, RegexTokenizer, SQLTransformer, StopWordsRemover
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewright.functions.text import preprocess


def train(rows: DataFrame, text: str = "text", label: str = "label", max_features: int = 3000, least: int = 10) -> PipelineModel | None:
    """Fit on (text, label 0 or 1); None below ``least`` non-empty rows or with one class only.

    Unigrams and bigrams after stop words, at least 2 documents and at most 95 % of them, tf times ln((1 + n) / (1 + docs)) + 1,
    unit length, L2 penalty 1 / n.
    """
    ready = rows.select(preprocess(F.col(text)).alias("text"), F.col(label).cast("double").alias("label")).filter("text <> ''")
    n, classes = ready.agg(F.count("*"), F.count_distinct("label")).first()
    if n < least or classes < 2:
        return None
    stages = [
        RegexTokenizer(inputCol="text", outputCol="raw", pattern=r"\w\w+", gaps=False, toLowercase=True),
        StopWordsRemover(inputCol="raw", outputCol="one"),
        NGram(n=2, inputCol="one", outputCol="two"),
        SQLTransformer(statement="SELECT *, concat(one, two) AS grams FROM __THIS__"),
        CountVectorizer(inputCol="grams", outputCol="tf", vocabSize=max_features, minDF=2.0, maxDF=0.95),
    ]
    counts = Pipeline(stages=stages).fit(ready)
    counted = counts.transform(ready).cache()
    idf = IDF(inputCol="tf", outputCol="tfidf").fit(counted).idf.toArray() + 1.0
    scale = ElementwiseProduct(scalingVec=Vectors.dense(idf), inputCol="tf", outputCol="tfidf")
    unit = Normalizer(inputCol="tfidf", outputCol="features", p=2.0)
    fitted = LogisticRegression(maxIter=1000, regParam=1.0 / n, elasticNetParam=0.0, standardization=False).fit(unit.transform(scale.transform(counted)))
    counted.unpersist()
    return PipelineModel(stages=[*counts.stages, scale, unit, fitted])


def predict(model: PipelineModel | None, rows: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, prediction, confidence): empty texts, and all texts without a model, get 0 and 0.0."""
    ready = rows.select(F.col(key), preprocess(F.col(text)).alias("text"))
    if model is None:
        return ready.select(key, F.lit(0).alias("prediction"), F.lit(0.0).alias("confidence"))
    out = model.transform(ready)
    empty = F.col("text") == ""
    return out.select(
        key, F.when(empty, 0).otherwise(F.col("prediction").cast("int")).alias("prediction"), F.when(empty, 0.0).otherwise(F.array_max(vector_to_array("probability"))).alias("confidence")
    )


def predict_words(rows: DataFrame, key: str, text: str, weights: dict[str, float], intercept: float) -> DataFrame:
    """(key, prediction, confidence) of a linear model over counts of words, written out as expressions: no Python, no model file.

    ``weights`` are few enough for a plan. Empty and null texts get 0 and 0.0.
    """
    t = preprocess(F.col(text))
    words = F.regexp_extract_all(F.col("t"), F.lit("[a-z0-9_]+"), F.lit(0))
    table = F.create_map(*[x for w, v in sorted(weights.items()) for x in (F.lit(w), F.lit(float(v)))])
    z = F.aggregate(words, F.lit(float(intercept)), lambda s, w: s + F.coalesce(table[w], F.lit(0.0)))
    scored = rows.select(F.col(key), t.alias("t")).select(key, (F.col("t") == "").alias("empty"), F.explode(F.array(z)).alias("z"))
    return scored.select(key, F.when(F.col("empty") | (F.col("z") <= 0), 0).otherwise(1).alias("prediction"), F.when(F.col("empty"), 0.0).otherwise(1 / (1 + F.exp(-F.abs("z")))).alias("confidence"))


def idf_weights(docs: DataFrame, key: str, text: str, min_docs: int = 2) -> DataFrame:
    """(term, docs, idf): ln((1 + n) / (1 + docs)) + 1 of every word of two letters or more in at least ``min_docs`` texts."""
    words = F.array_distinct(F.regexp_extract_all(preprocess(F.col(text)), F.lit("[a-z0-9_]{2,}"), F.lit(0)))
    ready = docs.select(key, words.alias("w")).filter(F.size("w") > 0)
    n = ready.agg(F.count("*").alias("n"))
    df = ready.select(F.explode("w").alias("term")).groupBy("term").agg(F.count("*").alias("docs")).filter(F.col("docs") >= min_docs)
    return df.crossJoin(F.broadcast(n)).select("term", "docs", (F.log((1 + F.col("n")) / (1 + F.col("docs"))) + 1).alias("idf"))  # one row
