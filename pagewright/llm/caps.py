"""Problem 4: at most a fixed number of records per contributor.

The state is a folder that outlives the session (``CapState.open`` takes it up again). It holds, per source, the rows kept so far and the cutoff: the rank of the last
kept row of a full source. A new batch is first held against the cutoffs, the rest is
merged with the kept rows, and every row that loses its place is logged with the batch
that displaced it. A source with a third of all rows costs no more than others: each
task passes on its own best rows of a source only (partial window group limit), and the
cutoff join broadcasts a counted table or splits the sources into shares.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pagewright.llm.source import SOURCE_SQL, source_of
from pagewright.operators.rows import global_rank
from pagewright.plans.joins import checked_join
from pagewright.plans.runtime import materialize, scratch_path, table

#: Rows a source may keep.
LIMIT = 20

STATE = "source string, score double, doc_idx long"
LOG = "doc_idx long, source string, batch_no int, reason string"


def quality(confidence: Column) -> Column:
    """Confidence as rank key: above 1 counts as 1, null and NaN as -1 (last)."""
    return F.when(confidence.isNull() | F.isnan(confidence), F.lit(-1.0)).otherwise(F.least(confidence, F.lit(1.0)))


def _best(rows: DataFrame, limit: int) -> DataFrame:
    w = Window.partitionBy("source").orderBy(F.desc("score"), F.asc("doc_idx"))
    return rows.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= limit)


def cutoffs(state: DataFrame, limit: int = LIMIT) -> DataFrame:
    """(source, cut_score, cut_doc): the last kept row of each full source."""
    return (
        state.groupBy("source")
        .agg(F.count("*").alias("n"), F.max(F.struct(-F.col("score"), F.col("doc_idx"))).alias("c"))
        .filter(F.col("n") >= limit)
        .select("source", (-F.col("c.col1")).alias("cut_score"), F.col("c.doc_idx").alias("cut_doc"))
    )


def apply_batch(state: DataFrame | None, batch: DataFrame, batch_no: int, limit: int = LIMIT) -> tuple[DataFrame, DataFrame]:
    """Merge one batch into the state.

    ``batch`` and ``state`` have (source, score, doc_idx); ``state`` None means empty.
    Returns the new state (materialised) and the log (doc_idx, source, batch_no, reason) of
    this step: ``below_cutoff`` for rows refused at the door, ``displaced`` for rows that
    lost to others in the merge, old or new. Ties rank by smaller doc_idx; an empty batch
    changes nothing; extra columns are ignored. doc_idx must be unique.
    """
    batch = batch.select("source", "score", "doc_idx")
    refused, pool = None, batch
    if state is not None:
        cut = materialize(cutoffs(state, limit), "p4-cut")
        held = checked_join(batch, cut, ["source"], "left", "doc_idx")
        below = (F.col("score") < F.col("cut_score")) | ((F.col("score") == F.col("cut_score")) & (F.col("doc_idx") > F.col("cut_doc")))
        below = F.coalesce(below, F.lit(False))
        refused = held.filter(below).select("doc_idx", "source", F.lit(batch_no).alias("batch_no"), F.lit("below_cutoff").alias("reason"))
        pool = held.filter(~below).select("source", "score", "doc_idx").unionByName(state)
    kept = materialize(_best(pool, limit).select("source", "score", "doc_idx"), "p4-state")
    lost = pool.join(kept.select("doc_idx"), "doc_idx", "left_anti").select(
        "doc_idx", "source", F.lit(batch_no).alias("batch_no"), F.lit("displaced").alias("reason")
    )
    return kept, lost if refused is None else refused.unionByName(lost)


class CapState:
    """The state at ``path``, kept between sessions: the rows that each source keeps, by batch, and the log of refused and displaced rows.

    A batch is accepted once its row stands in ``batches``; one that stopped half-way can be given again under its number.
    """

    def __init__(self, spark: SparkSession, path: str, limit: int = LIMIT):
        self.spark, self.path, self.limit = spark, path.rstrip("/"), limit

    @classmethod
    def open(cls, spark: SparkSession, path: str, limit: int = LIMIT) -> CapState:
        """The state at ``path``; a missing one is empty. ``limit`` must be the one it was made with."""
        return cls(spark, path, limit)

    def _read(self, name: str, schema: str) -> DataFrame:
        try:
            return self.spark.read.schema(schema).parquet(f"{self.path}/{name}")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], schema)

    def batches(self) -> list[int]:
        """Numbers of the accepted batches; one short row each."""
        return sorted(r.batch for r in self._read("batches", "batch int").collect())

    def kept(self) -> DataFrame:
        """(source, score, doc_idx) of the rows kept after the last accepted batch."""
        done = self.batches()
        return self.spark.read.schema(STATE).parquet(f"{self.path}/state-{done[-1]}") if done else self.spark.createDataFrame([], STATE)

    def log(self) -> DataFrame:
        """(doc_idx, source, batch_no, reason) of every refused or displaced row, by the batch that did it."""
        done = self.batches()
        return self._read("log", LOG + ", batch int").filter(F.col("batch").isin(done)).drop("batch") if done else self.spark.createDataFrame([], LOG)

    def accept(self, batch: DataFrame, batch_no: int) -> None:
        """Merge a batch (source, score, doc_idx) into the state; its number must be above those accepted."""
        done = self.batches()
        if done and batch_no <= done[-1]:
            raise ValueError(f"batch {batch_no} is not above {done[-1]}")
        state, log = apply_batch(self.kept() if done else None, batch, batch_no, self.limit)
        state.write.mode("overwrite").parquet(f"{self.path}/state-{batch_no}")
        # an unfinished earlier try under this number is replaced
        log.write.mode("overwrite").parquet(f"{self.path}/log/batch={batch_no}")
        self.spark.range(1).select(F.lit(batch_no).alias("batch")).write.mode("append").parquet(f"{self.path}/batches")


def ready(rows: DataFrame) -> DataFrame:
    """(doc_idx, source, score, batch_no) of (doc_idx, url, domain, confidence, batch_no); a null batch_no counts as 0."""
    source = source_of(F.col("domain"), F.col("url"))
    return rows.select("doc_idx", source.alias("source"), quality(F.col("confidence")).alias("score"), F.coalesce("batch_no", F.lit(0)).alias("batch_no"))


def capped(rows: DataFrame, limit: int = LIMIT, path: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Run all batches, in the order of their numbers (which may be any), through a :class:`CapState` at ``path`` (by default a scratch folder); returns state and log."""
    spark = rows.sparkSession
    all_ = materialize(ready(rows), "p4-rows")
    state = CapState.open(spark, path or scratch_path(spark, "caps"), limit)
    for r in all_.select("batch_no").distinct().orderBy("batch_no").toLocalIterator():  # one number per batch
        state.accept(all_.filter(F.col("batch_no") == r.batch_no), r.batch_no)
    return state.kept(), state.log()


def over_share(rows: DataFrame, share: float) -> DataFrame:
    """(doc_idx) of the rows that must go so that no source has more than ``share`` of all rows (at least one row each), the best by score staying.

    Ranks come from a distributed sort by source, score and doc_idx, so a source that holds a third of all rows is spread over tasks.
    """
    if not 0 < share <= 1:
        raise ValueError("share must be above 0 and at most 1")
    ranked = global_rank(ready(rows).select("doc_idx", "source", (-F.col("score")).alias("cost")), ["source", "cost", "doc_idx"], "rank")
    ranked = materialize(ranked, "p4-ranked")
    first = materialize(ranked.groupBy("source").agg(F.min("rank").alias("first")), "p4-first")
    most = ranked.agg(F.greatest(F.floor(F.count("*") * share), F.lit(1)).alias("most"))
    placed = checked_join(ranked, first, ["source"], "inner", "doc_idx").crossJoin(F.broadcast(most))  # one row
    return placed.filter(F.col("rank") - F.col("first") >= F.col("most")).select("doc_idx")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that must go so that each source keeps at most 20."""
    return capped(table(spark, sf_dir, "search_index"))[1].select("doc_idx")


def p4_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows kept per source after all batches, with their score (-1: none)."""
    return capped(table(spark, sf_dir, "search_index"))[0]


def p4_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """When and why each row lost its place."""
    return capped(table(spark, sf_dir, "search_index"))[1]


#: Share of all rows that a source may have in p4_share.
SHARE = 0.02


def p4_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that must go so that no source has more than a fiftieth of all rows."""
    return over_share(table(spark, sf_dir, "search_index"), SHARE)


QUERIES = {"p4_found": p4_found, "p4_state": p4_state, "p4_log": p4_log, "p4_share": p4_share}

_RANKED = f"""SELECT doc_idx, {SOURCE_SQL} AS source,
  CASE WHEN confidence IS NULL OR isnan(confidence) THEN -1.0 ELSE least(confidence, 1.0) END AS score, coalesce(batch_no, 0) AS b FROM search_index"""
_RN = f"SELECT *, row_number() OVER (PARTITION BY source ORDER BY score DESC, doc_idx) AS rn FROM ({_RANKED})"

#: Better rows of the source among those of the batches up to 0, 1, ... 6.
_BETTER = "[" + ", ".join(f"coalesce(count(*) FILTER (WHERE b <= {k}) OVER (PARTITION BY source ORDER BY score DESC, doc_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)" for k in range(7)) + "] AS better"

ORACLE_SQL = {
    "p4_found": f"SELECT doc_idx FROM ({_RN}) WHERE rn > {LIMIT}",
    "p4_state": f"SELECT source, score, doc_idx FROM ({_RN}) WHERE rn <= {LIMIT}",
    "p4_log": f"""WITH c AS (SELECT *, {_BETTER} FROM ({_RANKED})),
      o AS (SELECT *, list_filter(range(0, 7), lambda k: k >= b AND better[k + 1] >= {LIMIT})[1] AS lost, CASE WHEN b > 0 AND better[b] >= {LIMIT} THEN 'below_cutoff' ELSE 'displaced' END AS reason FROM c)
      SELECT doc_idx, source, CAST(lost AS INT) AS batch_no, reason FROM o WHERE lost IS NOT NULL""",
    "p4_share": f"SELECT doc_idx FROM ({_RN}) WHERE rn > greatest(floor({SHARE} * (SELECT count(*) FROM search_index)), 1)",
}
