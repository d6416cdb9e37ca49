"""Problem 3: lines repeated across the documents of one source.

Lines are normalised and hashed once; per source and line the operator counts the rows
that hold it, compares this with the rows of all other sources by a log-likelihood ratio,
and controls the false-discovery rate over all tested lines (Benjamini-Hochberg, stepped
over a bounded histogram of p values instead of a global sort). Repeated lines are then
joined back by source and line, and what is left is put together again by position.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pagewright.llm.source import SOURCE_SQL, source_of
from pagewright.plans.joins import checked_join
from pagewright.plans.runtime import materialize, table

#: Rows of one source that must hold a line.
MIN_ROWS = 8
#: False-discovery rate of the likelihood-ratio test.
FDR = 0.01
#: Steps per decade of the p-value histogram, and decades covered.
STEPS, DECADES = 20, 320


def normal_line(line: Column) -> Column:
    """The line without tags, in lower case, digits as 0, white space as one blank, trimmed."""
    x = F.regexp_replace(line, "<[^>]*>", "")
    x = F.regexp_replace(F.lower(x), r"(?U)\d+", "0")
    return F.trim(F.regexp_replace(x, r"(?U)[\s\x1c-\x1f]+", " "))


def hashed_lines(rows: DataFrame) -> DataFrame:
    """(doc_idx, src, line_no, line): one row per line that holds a letter, source and line as 64-bit hashes.

    Null and empty contents have no lines.
    """
    src = F.xxhash64(source_of(F.col("domain"), F.col("url")))
    split = rows.filter(F.length("content") > 0).select("doc_idx", src.alias("src"), F.posexplode(F.split("content", "\n")).alias("at", "text"))
    # most blank lines end here, before the costlier patterns
    split = split.filter(F.col("text") != "").select("doc_idx", "src", (F.col("at") + 1).alias("line_no"), normal_line(F.col("text")).alias("text"))
    return split.filter(F.col("text").rlike(r"\p{L}")).select("doc_idx", "src", "line_no", F.xxhash64("text").alias("line"))


def erfc_sqrt_half(g: Column) -> Column:
    """Upper tail of the chi-square distribution with one degree of freedom at ``g`` >= 0.

    Chebyshev fit of erfc, relative error below 1.2e-7; the coefficients are fixed values.
    """
    z = F.sqrt(g / 2)
    t = 1 / (1 + z / 2)
    poly = F.lit(0.17087277)
    for c in (-0.82215223, 1.48851587, -1.13520398, 0.27886807, -0.18628806, 0.09678418, 0.37409196, 1.00002368, -1.26551223):
        poly = poly * t + c
    return t * F.exp(-z * z + poly)


def line_statistics(lines: DataFrame, sources: DataFrame, min_rows: int = MIN_ROWS, fdr: float = FDR) -> DataFrame:
    """(src, line, in_rows, out_rows, llr, p_value, significant) of lines that ``min_rows`` rows of a source hold.

    ``sources`` has (src, rows): the number of rows of each source, those without lines too.
    ``significant``: more frequent within the source than outside, at false-discovery rate ``fdr``.
    """
    per_row = lines.select("src", "line", "doc_idx").distinct()
    within = materialize(per_row.groupBy("src", "line").agg(F.count("*").alias("in_rows")), "p3-counts")
    tested = within.filter(F.col("in_rows") >= min_rows)
    totals = within.join(tested.select("line").distinct(), "line", "left_semi").groupBy("line").agg(F.sum("in_rows").alias("all_rows"))
    n_all = sources.agg(F.sum("rows").alias("n_all"))
    # a source of a tenth of all lines is not one task: the few totals are broadcast after counting them, or its lines are split into shares
    t = checked_join(tested.join(totals, "line"), materialize(sources, "p3-sources"), ["src"], "inner", "line").crossJoin(F.broadcast(n_all))  # one row
    a, b = F.col("in_rows"), F.col("all_rows") - F.col("in_rows")
    n1, n2 = F.col("rows"), F.col("n_all") - F.col("rows")

    def term(k: Column, n: Column, share: Column) -> Column:
        return F.when(k > 0, k * F.log(k / (n * share))).otherwise(0.0)

    share = (a + b) / (n1 + n2)
    g = 2 * (term(a, n1, share) + term(b, n2, share) + term(n1 - a, n1, 1 - share) + term(n2 - b, n2, 1 - share))
    t = t.select("src", "line", "in_rows", b.alias("out_rows"), F.greatest(g, F.lit(0.0)).alias("llr"), F.when(n2 > 0, a / n1 > b / n2).otherwise(False).alias("excess"))
    t = t.withColumn("p_value", F.when(F.col("excess"), erfc_sqrt_half(F.col("llr"))).otherwise(1.0))
    step = F.least(F.floor(-F.log10(F.greatest("p_value", F.lit(1e-319))) * STEPS), F.lit(DECADES * STEPS)).cast("int")
    t = materialize(t.withColumn("step", step), "p3-tests")
    # Benjamini-Hochberg over at most DECADES * STEPS histogram rows
    h = t.groupBy("step").agg(F.count("*").alias("n"), F.max("p_value").alias("p"))
    h = h.withColumn("upto", F.sum("n").over(Window.orderBy(F.desc("step")))).withColumn("m", F.sum("n").over(Window.partitionBy()))
    bar = h.filter(F.col("p") <= fdr * F.col("upto") / F.col("m")).agg(F.min("step").alias("bar"))
    return t.crossJoin(F.broadcast(bar)).select(
        "src", "line", "in_rows", "out_rows", "llr", "p_value", F.coalesce(F.col("step") >= F.col("bar"), F.lit(False)).alias("significant")
    )


def repeated_lines(rows: DataFrame, min_rows: int = MIN_ROWS, fdr: float = FDR) -> DataFrame:
    """(doc_idx, line_no, in_rows, out_rows, llr, p_value, significant): every line that ``min_rows`` rows of its source hold.

    A line twice in a row counts once for the count, and both places come out. Rows are
    told apart by doc_idx, so two rows with one doc_idx count as one.
    """
    lines = materialize(hashed_lines(rows), "p3-lines")
    sources = rows.select("doc_idx", F.xxhash64(source_of(F.col("domain"), F.col("url"))).alias("src")).groupBy("src").agg(F.count("*").alias("rows"))
    stats = materialize(line_statistics(lines, sources, min_rows, fdr), "p3-stats")
    return checked_join(lines, stats, ["src", "line"], "inner", "doc_idx").drop("src", "line")


def without_lines(rows: DataFrame, found: DataFrame) -> DataFrame:
    """(doc_idx, content): the rows without the lines of ``found`` (doc_idx, line_no), put together by position.

    Only rows that lose a line are taken apart: their lines are anti-joined by row and position, and what is left is
    put together again in order. A null content stays null; a content all of whose lines go becomes empty. doc_idx must be unique.
    """
    base = rows.select("doc_idx", "content")
    touched = found.select("doc_idx").distinct()
    split = base.join(touched, "doc_idx", "left_semi").select("doc_idx", F.posexplode(F.split("content", "\n")).alias("at", "text")).withColumn("line_no", (F.col("at") + 1).cast("int"))
    left = split.join(found.select("doc_idx", F.col("line_no").cast("int").alias("line_no")), ["doc_idx", "line_no"], "left_anti")
    # the lines of one row: bounded by its length
    whole = left.groupBy("doc_idx").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "text"))), lambda x: x["text"]), "\n").alias("content"))
    emptied = touched.join(whole.select("doc_idx"), "doc_idx", "left_anti").select("doc_idx", F.lit("").alias("content"))
    return base.join(touched, "doc_idx", "left_anti").unionByName(whole).unionByName(emptied)


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that at least 8 rows of the same source hold; the count decides, the test only adds its figures."""
    return repeated_lines(table(spark, sf_dir, "search_index")).select("doc_idx", "line_no")


def p3_excess_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The repeated lines that are significantly more frequent within their source than outside."""
    return repeated_lines(table(spark, sf_dir, "search_index")).filter("significant").select("doc_idx", "line_no", "in_rows", "out_rows")


def p3_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row's content without the lines that are significantly more frequent within its source than outside."""
    rows = table(spark, sf_dir, "search_index")
    return without_lines(rows, materialize(repeated_lines(rows).filter("significant").select("doc_idx", "line_no"), "p3-gone"))


QUERIES = {"p3_found": p3_found, "p3_excess_lines": p3_excess_lines, "p3_clean": p3_clean}

_LINES = rf"""SELECT doc_idx, source, i AS line_no, trim(regexp_replace(regexp_replace(lower(regexp_replace(parts[i], '<[^>]*>', '', 'g')),
  '\p{{Nd}}+', '0', 'g'), '[\s\x0b\x1c-\x1f\x{{85}}\p{{Z}}]+', ' ', 'g')) AS line
  FROM (SELECT doc_idx, source, parts, unnest(range(1, len(parts) + 1)) AS i FROM (
    SELECT doc_idx, {SOURCE_SQL} AS source, string_split(content, chr(10)) AS parts FROM search_index WHERE length(content) > 0))"""
_FOUND = rf"""l AS (SELECT * FROM ({_LINES}) WHERE regexp_matches(line, '\p{{L}}')),
  f AS (SELECT source, line FROM l GROUP BY ALL HAVING count(DISTINCT doc_idx) >= {MIN_ROWS}),
  found AS (SELECT l.doc_idx, CAST(l.line_no AS INT) AS line_no FROM l JOIN f USING (source, line))"""



def _term_sql(k: str, n: str, share: str) -> str:
    return f"(CASE WHEN {k} > 0 THEN {k} * ln({k} / (CAST({n} AS DOUBLE) * {share})) ELSE 0 END)"


def _erfc_sql() -> str:
    poly = "0.17087277"
    for c in (-0.82215223, 1.48851587, -1.13520398, 0.27886807, -0.18628806, 0.09678418, 0.37409196, 1.00002368, -1.26551223):
        poly = f"(({poly}) * u + ({c}))"
    return f"u * exp(-z * z + {poly})"


_SIGNIFICANT = f"""l AS (SELECT * FROM ({_LINES}) WHERE regexp_matches(line, '\\p{{L}}')),
  w AS (SELECT source, line, count(DISTINCT doc_idx) AS a FROM l GROUP BY ALL),
  tot AS (SELECT line, sum(a) AS s FROM w GROUP BY 1), src AS (SELECT source, count(*) AS n1 FROM (SELECT {SOURCE_SQL} AS source FROM search_index) GROUP BY 1),
  t AS (SELECT source, line, a, CAST(s - a AS BIGINT) AS b, n1, (SELECT count(*) FROM search_index) - n1 AS n2 FROM w JOIN tot USING (line) JOIN src USING (source) WHERE a >= {MIN_ROWS}),
  g AS (SELECT *, greatest(0, 2 * ({_term_sql('a', 'n1', 'q')} + {_term_sql('b', 'n2', 'q')} + {_term_sql('(n1 - a)', 'n1', '(1 - q)')} + {_term_sql('(n2 - b)', 'n2', '(1 - q)')})) AS llr,
    n2 > 0 AND a * 1.0 / n1 > b * 1.0 / n2 AS excess FROM (SELECT *, CAST(a + b AS DOUBLE) / (n1 + n2) AS q FROM t)),
  p AS (SELECT *, least(floor(-log10(greatest(p, 1e-319)) * {STEPS}), {DECADES * STEPS}) AS step FROM (
    SELECT *, CASE WHEN excess THEN {_erfc_sql()} ELSE 1.0 END AS p FROM (SELECT *, 1 / (1 + z / 2) AS u FROM (SELECT *, sqrt(llr / 2) AS z FROM g)))),
  h AS (SELECT step, max(p) AS p, sum(count(*)) OVER (ORDER BY step DESC) AS upto, sum(count(*)) OVER () AS m FROM p GROUP BY step),
  bar AS (SELECT min(step) AS bar FROM h WHERE p <= {FDR} * upto / m),
  sig AS (SELECT source, line, a, b FROM p, bar WHERE step >= bar),
  found AS (SELECT l.doc_idx, CAST(l.line_no AS INT) AS line_no, a AS in_rows, b AS out_rows FROM l JOIN sig USING (source, line))"""

ORACLE_SQL = {
    "p3_found": f"WITH {_FOUND} SELECT doc_idx, line_no FROM found",
    "p3_excess_lines": f"WITH {_SIGNIFICANT} SELECT doc_idx, line_no, in_rows, out_rows FROM found",
    "p3_clean": f"""WITH {_SIGNIFICANT}, gone AS (SELECT doc_idx, list(line_no) AS gone FROM found GROUP BY doc_idx)
      SELECT doc_idx, CASE WHEN gone IS NULL THEN content ELSE array_to_string(list_transform(list_filter(
        range(1, len(string_split(content, chr(10))) + 1), lambda i: NOT list_contains(gone, i)),
        lambda i: string_split(content, chr(10))[i]), chr(10)) END AS content
      FROM search_index LEFT JOIN gone USING (doc_idx)""",
}
