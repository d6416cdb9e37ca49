"""Page classification: the rule stage, structural evidence, prototypes, and their cascade."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagewright.functions import html as H
from pagewright.functions import lexicon as L
from pagewright.functions import scoring as S
from pagewright.functions import urls as U
from pagewright.operators.vectors import prototype_decision


class Thresholds(NamedTuple):
    """Confidence a stage needs to end the cascade. ``observed`` never ends at the domain stage; ``intended`` does."""

    domain: float = 5.0
    tfidf: float = 0.6
    embedding: float = 0.7
    structural: float = 0.5


OBSERVED, INTENDED = Thresholds(), Thresholds(domain=0.9)


def content_scores(pages: DataFrame, key: str, text: str, groups: tuple[L.Group, ...] = L.CONTENT) -> DataFrame:
    """(key, one count per category, content_score). Null text counts as ''."""
    base = pages.select(key, F.coalesce(text, F.lit("")).alias("_t")).withColumn("_w", S.words(F.col("_t")))
    counted = base.select(key, *[c.alias(g.name) for g, c in S.content_counts(F.col("_t"), F.col("_w"), groups)])
    total = sum((F.col(g.name) * g.weight for g in groups), F.lit(0))
    return counted.withColumn("content_score", total)


def filtered(pages: DataFrame, key: str, url: str, text: str | None, html: str | None) -> DataFrame:
    """(key, domain_score, content_score, structural_score, is_personal, confidence, score, stage) of the rule stage."""
    t = F.coalesce(F.col(text), F.lit("")) if text else F.lit("")
    h = F.coalesce(F.col(html), F.lit("")) if html else F.lit("")
    u = F.coalesce(F.col(url), F.lit(""))
    base = pages.select(F.col(key), u.alias("_u"), t.alias("_t"), h.alias("_h")).withColumn("_w", S.words(F.col("_t")))
    # a generator keeps later filters from copying the long expressions
    parts = base.select(key, F.inline(F.array(_rules(F.col("_u"), F.col("_t"), F.col("_h"), F.col("_w")))))
    return parts.withColumn("r", S.page_filter(F.col("domain_score"), F.col("content_score"), F.col("structural_score"))).select(*parts.columns, "r.*")


def _rules(url: Column, text: Column, html: Column, words: Column) -> Column:
    """struct(domain_score, content_score, structural_score) of columns without nulls; ``words`` is ``S.words(text)``, computed once by the caller."""
    content = sum((c * g.weight for g, c in S.content_counts(text, words)), F.lit(0))
    structural = F.when(html != "", S.structural_html(html, url)).otherwise(0)
    return F.struct(S.domain_score(U.canonical_domain(url)).alias("domain_score"), content.alias("content_score"), structural.alias("structural_score"))


_SECTIONS = ("header", "nav", "main", "footer")


def _cut(html: Column) -> list[Column]:
    """The text of a page, whole and by section."""
    return [H.strip_tags(html).alias("_text"), *[H.strip_tags(H.section(html, s)).alias(f"_{s}") for s in _SECTIONS]]


def _structure(html: Column) -> Column:
    """struct of the seven structural scores in tenths, over the columns of :func:`_cut`."""
    return F.struct(
        *[S.lexicon_tenths(F.col(f"_{s}"), F.lower(f"_{s}")).alias(s) for s in ("text", *_SECTIONS)],
        S.link_tenths(H.anchors(html)).alias("links"),
        S.meta_tenths(H.metas(html)).alias("metas"),
    )


def structural_parts(pages: DataFrame, key: str, html: str) -> DataFrame:
    """(key, text, header, nav, main, footer, links, metas, total) in tenths, from regular markup. Null html counts as ''.

    A section inside another counts in both and in the whole text.
    """
    h = F.coalesce(F.col(html), F.lit(""))
    base = pages.select(F.col(key), h.alias("_h"))
    texts = base.select(key, "_h", *_cut(F.col("_h")))
    scored = texts.select(key, F.inline(F.array(_structure(F.col("_h")))))
    total = sum((F.col(c) for c in scored.columns if c != key), F.lit(0))
    return scored.withColumn("total", total)


def section_scores_parsed(pages: DataFrame, key: str, html: str) -> DataFrame:
    """(key, section, tenths) with sections cut by a real HTML parser (a table function), for markup that is not regular."""
    parts = pages.select(F.col(key), F.col(html).alias("h")).lateralJoin(H.html_parts(F.col("h").outer()))
    s = parts.filter("kind = 'section'").withColumn("low", F.lower("value"))
    return s.select(key, F.col("name").alias("section"), S.lexicon_tenths(F.col("value"), F.col("low")).alias("tenths"))


def cascade(stages: DataFrame, key: str, thresholds: Thresholds = OBSERVED) -> DataFrame:
    """(key, is_personal, confidence, stage_used).

    ``stages`` has for each of domain, tfidf, embedding and structural a struct (prediction, confidence); null
    where a stage did not run. The first stage whose confidence reaches its threshold decides, else the weighted vote.
    """
    names = ("domain", "tfidf", "embedding", "structural")
    votes = {n: (F.col(f"{n}.prediction"), F.col(f"{n}.confidence")) for n in names}
    chosen = F.coalesce(
        *[
            F.when(votes[n][0].isNotNull() & (votes[n][1] >= getattr(thresholds, n)), F.struct(votes[n][0].cast("int").alias("prediction"), votes[n][1].alias("confidence"), F.lit(n).alias("stage")))
            for n in names
        ]
    )
    vote = S.weighted_vote(votes)
    r = F.coalesce(chosen, F.struct(vote["prediction"].alias("prediction"), vote["confidence"].alias("confidence"), F.lit("weighted_vote").alias("stage")))
    return stages.select(key, r.alias("r")).select(key, F.col("r.prediction").alias("is_personal"), F.col("r.confidence").alias("confidence"), F.col("r.stage").alias("stage_used"))


def classify(
    pages: DataFrame, key: str, url: str, text: str | None, html: str | None, similarities: DataFrame | None = None, thresholds: Thresholds = OBSERVED, tfidf: DataFrame | None = None
) -> DataFrame:
    """The cascade of four stages over pages, in one pass over url, text and html.

    ``tfidf`` (key, prediction, confidence) and ``similarities`` (key, personal, corporate) feed the second and third stage of the rows that have them;
    rows without text skip both. Without ``html`` the structural stage does not run. Null url, text and html count as ''; ``key`` must be unique.
    """
    u, t, h = (F.coalesce(F.col(c), F.lit("")) if c else F.lit("") for c in (url, text, html))
    base = pages.select(F.col(key), u.alias("_u"), t.alias("_t"), h.alias("_h")).withColumn("_w", S.words(F.col("_t")))
    cut = base.select("*", *_cut(F.col("_h"))) if html else base
    scores = [_rules(F.col("_u"), F.col("_t"), F.col("_h"), F.col("_w")).alias("rules")] + [_structure(F.col("_h")).alias("parts")] * bool(html)
    out = cut.select(key, (F.col("_t") != "").alias("_has"), F.inline(F.array(F.struct(*scores))))
    nothing = F.lit(None).cast("struct<prediction:int,confidence:double>")
    rule = S.page_filter(F.col("rules.domain_score"), F.col("rules.content_score"), F.col("rules.structural_score"))
    total = sum((F.col(f"parts.{c}") for c in ("text", *_SECTIONS, "links", "metas")), F.lit(0)) if html else None
    out = out.select(
        key, "_has", F.struct(rule["is_personal"].cast("int").alias("prediction"), rule["confidence"].alias("confidence")).alias("domain"), (S.structural_decision(total) if html else nothing).alias("structural")
    )

    def stage(results: DataFrame | None, name: str, value: Column) -> DataFrame:
        if results is None:
            return out.withColumn(name, nothing)
        return out.join(results.select(key, value.alias(name)), key, "left").withColumn(name, F.when(F.col("_has"), F.col(name)))

    out = stage(tfidf, "tfidf", F.struct(F.col("prediction").cast("int").alias("prediction"), F.col("confidence").cast("double").alias("confidence")))
    out = stage(similarities, "embedding", prototype_decision(F.col("personal"), F.col("corporate"), thresholds.embedding))
    return cascade(out, key, thresholds)


def weak_labels(filtered_pages: DataFrame, least: float = 0.7) -> DataFrame:
    """Rows of the rule stage that are sure enough to train on."""
    return filtered_pages.filter(F.col("confidence") >= least)


def route(personal: Column, confidence: Column, add: float = L.AUTO_ADD, review: float = L.REVIEW) -> Column:
    """add, review or reject."""
    yes = F.coalesce(personal.cast("boolean"), F.lit(False))
    return F.when(yes & (confidence >= add), "add").when(yes & (confidence >= review), "review").otherwise("reject")
