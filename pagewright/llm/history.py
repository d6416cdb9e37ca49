"""Problem 5: new batches against everything accepted before, by a persisted segment index.

The index holds, in a folder that outlives the session: the segments of every accepted text by position and value (a
sketch string of fixed length is cut into segments of fixed number and length, see segments), its size and bitmap,
the hash of its n-gram set, and the normal form of its address, each with the batch that brought it. ``SegmentIndex.open``
takes up a folder again.

``accept`` takes one batch, with ascending numbers:

1. Rows whose address or whole n-gram set the index has are known.
2. The other rows' segments are the probe: a filter of their values, sized to the batch, is held against the stored segments where these lie, so only
   the batch's own segments leave the scan. Texts of a common segment meet; where more than ``MANY`` stored ones have it, each row of the batch meets one of them first, and rows
   that this does not settle meet all the others, share by share.
3. Pairs must have sizes and bitmaps that allow the similarity, and sketch strings within ``most_edits`` substitutions (the strings have one length, so this bounds their edit distance);
   what is left is verified on whole n-gram sets. Both are read from the collection, for these texts only.
4. The batch's own segments, packed texts, sets and addresses are appended in a folder of its number. Nothing stored is rewritten, and no old text is drawn again for the index.

Raw edit distance over characters cannot bound the similarity of sets of word n-grams (one moved paragraph is a long
edit), so the strings compared are the sketch strings: at similarity 0.6 a row misses every segment of its partner with a probability of 1.8e-7, and
exceeds ``most_edits`` with one of 1e-9, however large its family.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.llm import keyfilter as K
from pagewright.llm import segments as S
from pagewright.llm import sigtree as T
from pagewright.plans.joins import checked_join, salted_join
from pagewright.plans.runtime import materialize, scratch_path, table

#: Stored texts of a segment up to which a row meets them all at once.
MANY = 512


#: Parameters that only track where a visitor came from (fixed values).
TRACKING = r"(?i)^(utm.*|fbclid|gclid|ref|share)$"


def address_key(url: Column) -> Column:
    """The address without what makes no difference: case of scheme and host, leading www., default port, fragment,
    index.html, trailing slash, tracking parameters and their order. Null and blank urls give null."""
    u = F.trim(url)
    scheme = F.lower(F.regexp_extract(u, r"^([A-Za-z][A-Za-z0-9+.-]*)://", 1))
    host = F.lower(F.regexp_extract(u, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)", 1))
    host = F.regexp_replace(host, r"^www\.", "")
    port = F.when(scheme == "https", F.regexp_replace(host, ":443$", "")).otherwise(F.regexp_replace(host, ":80$", ""))
    rest = F.regexp_replace(F.regexp_replace(u, "#.*$", ""), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//[^/?#]*", "")
    path = F.regexp_replace(F.regexp_replace(F.regexp_extract(rest, r"^([^?]*)", 1), r"/index\.html$", "/"), "/+$", "")
    query = F.split(F.regexp_extract(rest, r"\?(.*)$", 1), "&")
    kept = F.array_sort(F.filter(query, lambda p: (p != "") & ~F.regexp_extract(p, "^([^=]*)", 1).rlike(TRACKING)))
    return F.when(u != "", F.concat(scheme, F.lit("://"), port, path, F.lit("?"), F.array_join(kept, "&")))


def _places(parts: DataFrame, held: object = None, bits: int = 0) -> DataFrame:
    """(root, cid) of packed rows; with a broadcast filter only those it may hold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            roots, cids = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for b, kind, r, c in S.unpack(batch):
                if kind == S.NAMES:
                    continue
                root = S.root_ids(b, r)
                if held is not None:
                    ok = K.may_hold(held.value, root, bits)
                    root, c = root[ok], c[ok]
                roots.append(root)
                cids.append(c)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(roots)), pa.array(np.concatenate(cids))], names=["root", "cid"])

    return parts.mapInArrow(run, "root long, cid long")


class SegmentIndex:
    """The persisted index at ``path``: what is known of every accepted row, by batch.

    ``collection`` (key, url, content, ...) holds the texts themselves, old and new: the index keeps none, and looks up those of candidate pairs there.
    Keys must be unique over all batches. Similarity is the Jaccard coefficient of word ``n``-grams of rows with at least ``min_words`` words.
    """

    #: Buckets of segment values; fixed for an index, so that segments of all batches fall into the same ones.
    BUCKETS = 64
    SHAPE = S.SHAPE
    TABLES = {
        "segments": S.PACKED + ", batch int", "texts": "cid long, n int, sum long, rec binary, batch int", "addresses": "address long, batch int", "batches": "batch int, rows long",
    }

    def __init__(self, spark: SparkSession, path: str, n: int = 3, threshold: float = 0.6, min_words: int = 20, key: str = "doc_idx"):
        self.spark, self.path, self.n, self.threshold, self.min_words, self.key = spark, path.rstrip("/"), n, threshold, min_words, key

    @classmethod
    def open(cls, spark: SparkSession, path: str, **options) -> SegmentIndex:  # noqa: ANN003
        """The index at ``path``; a missing one is empty. The options must be those it was made with."""
        return cls(spark, path, **options)

    def _read(self, name: str) -> DataFrame:
        """A table of the index. Batches that were not finished (no row in ``batches``) don't count."""
        schema = self.TABLES[name]
        try:
            return self.spark.read.schema(schema).parquet(f"{self.path}/{name}")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], schema)

    def batches(self) -> dict[int, int]:
        """Rows of each accepted batch; one short row per batch."""
        return {r.batch: r.rows for r in self._read("batches").collect()}

    def accept(self, batch: DataFrame, batch_no: int, collection: DataFrame) -> DataFrame:
        """(key) of the rows of ``batch`` that an accepted batch has by address or content; then the batch is accepted.

        A batch number must be above those accepted; a batch that stopped half-way can be given again under its number. An empty batch changes nothing.
        """
        done = self.batches()
        if done and batch_no <= max(done):
            raise ValueError(f"batch {batch_no} is not above {max(done)}")
        finished = F.col("batch").isin(list(done)) if done else F.lit(False)
        old = {k: self._read(k).filter(finished) for k in ("segments", "texts", "addresses")}
        key = self.key
        rows = batch.select(F.col(key).cast("long").alias(key), "url", "content")
        sigs = S.sketches(rows, key, "content", [], self.n, self.min_words, self.SHAPE).withColumnRenamed(key, "cid")
        sigs = materialize(sigs, "p5-new")
        addresses = rows.select(key, address_key(F.col("url")).alias("a")).filter("a is not null").select(key, F.xxhash64("a").alias("address"))
        # rows with one set are one text of the index: its smallest key, and only if no earlier batch has the set
        sets = sigs.groupBy("sum", "n").agg(F.min("cid").alias("text"))
        sets = materialize(sets.join(old["texts"].select("sum", "n", F.lit(True).alias("stored")), ["sum", "n"], "left").withColumn("stored", F.coalesce("stored", F.lit(False))), "p5-sets")
        # the rows that go are few as a rule: they are broadcast after counting them, so that no sketch is shuffled
        gone = sigs.select("cid", "sum", "n").join(sets, ["sum", "n"]).filter("stored or cid <> text").select("cid")
        fresh = checked_join(sigs, materialize(gone, "p5-gone"), ["cid"], "left_anti", "cid")
        # what is written before the batch is finished doesn't count as accepted
        where = {"segments": S.packed(fresh, self.BUCKETS, self.SHAPE), "texts": fresh.select("cid", "n", "sum", "rec"), "addresses": addresses.select("address").distinct()}
        for name, df in where.items():
            df.withColumn("batch", F.lit(batch_no)).write.mode("append").partitionBy("batch").parquet(f"{self.path}/{name}")
        known = self.spark.createDataFrame([], f"{key} long")
        if done:
            same = addresses.join(old["addresses"], "address", "left_semi").select(key)
            # a text that is near tells of all rows of its set
            near = self._near(batch_no, old, collection).withColumnRenamed("cid", "text")
            settled = sets.join(near.withColumn("near", F.lit(True)), "text", "left").filter("stored or near").select("sum", "n")
            whole = sigs.join(settled, ["sum", "n"], "left_semi").select(F.col("cid").alias(key))
            known = materialize(same.unionByName(whole).distinct(), "p5-known")
        rows.agg(F.lit(batch_no).alias("batch"), F.count("*").alias("rows")).coalesce(1).write.mode("append").parquet(f"{self.path}/batches")
        return known

    def _near(self, batch_no: int, old: dict[str, DataFrame], collection: DataFrame) -> DataFrame:
        """(cid) of the batch's own texts that are similar to a text of an accepted batch."""
        own = F.col("batch") == batch_no
        parts, texts = self._read("segments").filter(own), self._read("texts").filter(own)
        n = texts.count()
        bits = K.bits_for(n * self.SHAPE.segments)
        context = self.spark.sparkContext
        probe = context.broadcast(K.filter_of(_places(parts), bits))  # at most 2^MOST bits, as the next one
        stored = materialize(_places(old["segments"], probe, bits), "p5-stored")
        mine = _places(parts, context.broadcast(K.filter_of(stored, bits)), bits)
        mine = mine.withColumnRenamed("cid", "cid_a")
        large = materialize(stored.groupBy("root").agg(F.count("*").alias("m"), F.min("cid").alias("first")).filter(F.col("m") > MANY).select("root", "first"), "p5-large")
        stored = stored.withColumnRenamed("cid", "cid_b")
        if large.isEmpty():
            return self._similar(mine.join(stored, "root"), texts, old["texts"], collection)
        # one stored text per large segment settles most rows, also those of large families
        few = checked_join(mine, large, ["root"], "left_anti", "cid_a").join(stored, "root").select("cid_a", "cid_b")
        many = materialize(checked_join(mine, large, ["root"], "inner", "cid_a"), "p5-many")
        near = materialize(self._similar(few.unionByName(many.select("cid_a", F.col("first").alias("cid_b"))), texts, old["texts"], collection), "p5-near")
        left = many.join(near.withColumnRenamed("cid", "cid_a"), "cid_a", "left_anti")
        # rows that are left meet all others, the stored side of a large segment in shares
        rest = salted_join(stored, left.select("root", "cid_a"), ["root"], "inner", "cid_b").select("cid_a", "cid_b")
        return near.unionByName(self._similar(rest, texts, old["texts"], collection)).distinct()

    def _similar(self, met: DataFrame, own: DataFrame, stored: DataFrame, collection: DataFrame) -> DataFrame:
        """(cid) of the texts cid_a of ``met`` (cid_a, cid_b) that are similar to cid_b: by sizes and bitmaps, sketch strings, and whole sets."""
        pairs = materialize(met.select("cid_a", "cid_b").distinct(), "p5-pairs")
        ids = pairs.select("cid_b").distinct()
        bits = K.bits_for(pairs.count())
        held = self.spark.sparkContext.broadcast(K.filter_of(ids, bits))  # of bounded size
        b = K.sifted(stored.select(F.col("cid").alias("cid_b"), F.col("rec").alias("b")), "cid_b", held, bits)
        fit = _records_fit(checked_join(pairs.join(b, "cid_b"), own.select(F.col("cid").alias("cid_a"), F.col("rec").alias("a")), ["cid_a"], "inner", "cid_b"), self.threshold)
        texts = collection.select(F.col(self.key).cast("long").alias(self.key), "content")
        sure = T.verified(fit, texts, self.key, "content", self.n, self.threshold)
        return sure.select(F.col("cid_a").alias("cid")).distinct()


def _records_fit(pairs: DataFrame, threshold: float) -> DataFrame:
    """(cid_a, cid_b) of (cid_a, cid_b, a, b) whose packed texts a and b allow the similarity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = np.zeros(0, np.int64)
            if batch.num_rows:
                ok = np.flatnonzero(T._records_fit(*(S.matrix(batch.column(i), S.RECORD).reshape(-1) for i in (2, 3)), threshold))
            yield pa.RecordBatch.from_arrays([batch.column(i).take(pa.array(ok)) for i in range(2)], names=["cid_a", "cid_b"])

    return pairs.select("cid_a", "cid_b", "a", "b").mapInArrow(run, "cid_a long, cid_b long")


def known_rows(rows: DataFrame, path: str | None = None) -> DataFrame:
    """doc_idx of the rows of batch 1 and later that some row of a smaller batch_no has by address or by content.

    The batches go through a :class:`SegmentIndex` at ``path`` (by default a scratch folder) one after the other, in the order of their numbers, which may be any. A null batch_no
    counts as 0. doc_idx must be unique; extra columns are ignored.
    """
    spark = rows.sparkSession
    rows = rows.select("doc_idx", "url", "content", F.coalesce("batch_no", F.lit(0)).alias("batch_no"))
    index = SegmentIndex.open(spark, path or scratch_path(spark, "segment-index"))
    known = spark.createDataFrame([], "doc_idx long")
    for r in rows.select("batch_no").distinct().orderBy("batch_no").toLocalIterator():  # one number per batch
        known = known.unionByName(index.accept(rows.filter(F.col("batch_no") == r.batch_no), r.batch_no, rows))
    return known


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of later batches that are known already."""
    return known_rows(table(spark, sf_dir, "search_index"))


QUERIES = {"p5_found": p5_found}

_KEY = r"""(SELECT doc_idx, batch_no, CASE WHEN trim(url) <> '' THEN s || '://' || regexp_replace(h, CASE WHEN s = 'https' THEN ':443$' ELSE ':80$' END, '')
    || regexp_replace(regexp_replace(regexp_extract(r, '^([^?]*)', 1), '/index\.html$', '/'), '/+$', '') || '?'
    || array_to_string(list_sort(list_filter(string_split(regexp_extract(r, '\?(.*)$', 1), '&'),
         lambda p: p <> '' AND NOT regexp_matches(regexp_extract(p, '^([^=]*)', 1), '(?i)^(utm.*|fbclid|gclid|ref|share)$'))), '&') END AS k
  FROM (SELECT *, lower(regexp_extract(trim(url), '^([A-Za-z][A-Za-z0-9+.-]*)://', 1)) AS s,
    regexp_replace(lower(regexp_extract(trim(url), '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)', 1)), '^www\.', '') AS h,
    regexp_replace(regexp_replace(trim(url), '#.*$', ''), '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//[^/?#]*', '') AS r FROM search_index))"""

ORACLE_SQL = {
    "p5_found": f"""WITH {T.GRAMS_SQL}, k AS {_KEY}, m AS (SELECT k, min(batch_no) AS lo FROM k WHERE k IS NOT NULL GROUP BY k)
      SELECT doc_idx FROM k JOIN m USING (k) WHERE batch_no > lo
      UNION SELECT x.doc_idx FROM pairs JOIN search_index x ON x.doc_idx = b JOIN search_index y ON y.doc_idx = a WHERE x.batch_no > y.batch_no
      UNION SELECT x.doc_idx FROM pairs JOIN search_index x ON x.doc_idx = a JOIN search_index y ON y.doc_idx = b WHERE x.batch_no > y.batch_no"""
}
