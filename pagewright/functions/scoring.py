"""Scores of the page classifier as expressions. Weights are whole tenths or units, so no order of additions matters."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagewright.functions import lexicon as L


def _first(text: Column, needles: tuple[str, ...]) -> Column:
    return F.coalesce(*[F.when(text.contains(n), F.lit(n)) for n in needles])


def domain_score(domain: Column) -> Column:
    """Substring score of a host: strong and contrary patterns count once each, medium ones only at a sum of 0; null counts as ''."""
    d = F.coalesce(domain, F.lit(""))
    w = L.DOMAIN_WEIGHTS
    base = F.when(_first(d, L.DOMAIN_STRONG).isNotNull(), w["strong"]).otherwise(0) + F.when(_first(d, L.DOMAIN_AGAINST).isNotNull(), w["against"]).otherwise(0)
    return F.when((base == 0) & _first(d, L.DOMAIN_MEDIUM).isNotNull(), F.lit(w["medium"])).otherwise(base)


def domain_reasons(domain: Column) -> Column:
    d = F.coalesce(domain, F.lit(""))
    strong, against, medium = (_first(d, x) for x in (L.DOMAIN_STRONG, L.DOMAIN_AGAINST, L.DOMAIN_MEDIUM))
    both = F.when(strong.isNotNull(), 5).otherwise(0) + F.when(against.isNotNull(), -5).otherwise(0)
    named = F.array(
        F.concat(F.lit("Domain match: "), strong), F.concat(F.lit("Negative domain: "), against), F.when(both == 0, F.concat(F.lit("Medium domain: "), medium))
    )
    return F.filter(named, lambda x: x.isNotNull())


def words(text: Column) -> Column:
    """Lower-case runs of ASCII letters, digits and underscores; what the content patterns are looked up by."""
    return F.split(F.lower(text), "[^a-z0-9_]+")


def matches(text: Column, tokens: Column, patterns: tuple[str, ...]) -> Column:
    """Number of matches of all patterns. ``tokens`` is ``words(text)``, computed once by the caller.

    Patterns of one word are counted among the tokens. Phrases run as regular expressions, all of them literals
    that are compiled once, and only in texts that hold one of their marker words.
    """
    single = [w for p in patterns if (w := L.single_word(p))]
    table = [(L.markers(p), L.java(p)) for p in patterns if not L.single_word(p)]
    out = F.size(F.filter(tokens, lambda w: w.isin(single))) if single else F.lit(0)
    if table:
        markers = sorted({m for ms, _ in table for m in ms})
        present = F.array_intersect(tokens, F.array(*map(F.lit, markers)))
        rows = F.array(*[F.struct(F.array(*map(F.lit, ms)).alias("markers"), F.lit(i).alias("at")) for i, (ms, _) in enumerate(table)])
        likely = F.filter(rows, lambda r: F.arrays_overlap(r["markers"], present))

        def count(at: Column) -> Column:
            return reduce(lambda other, i: F.when(at == i, F.regexp_count(text, F.lit(table[i][1]))).otherwise(other), range(len(table)), F.lit(0))

        out = out + F.when(F.size(present) == 0, 0).otherwise(F.aggregate(likely, F.lit(0), lambda n, r: n + count(r["at"])))
    return out


def content_counts(text: Column, tokens: Column, groups: tuple[L.Group, ...] = L.CONTENT) -> list[tuple[L.Group, Column]]:
    """Matches per category. ``tokens`` is ``words(text)``, computed once by the caller."""
    return [(g, matches(text, tokens, g.patterns)) for g in groups]


def content_reasons(text: Column, groups: tuple[L.Group, ...] = L.CONTENT) -> Column:
    """array(struct(category, pattern, matches, reason)) with one entry per content pattern that matches, in the order of the lexicon."""
    low = F.lower(text)
    rows = []
    for g in groups:
        for p in g.patterns:
            # a pattern only runs where one of its words stands
            likely = reduce(lambda a, b: a | b, [low.contains(m) for m in ((L.single_word(p),) if L.single_word(p) else L.markers(p))])
            n = F.when(likely, F.regexp_count(text, F.lit(L.java(p)))).otherwise(0)
            sign = "Positive" if g.weight > 0 else "Negative"
            rows.append(F.struct(F.lit(g.name).alias("category"), F.lit(p).alias("pattern"), n.alias("matches"), F.lit(f"{sign} ({g.name}): ").alias("reason")))
    hit = F.filter(F.array(*rows), lambda r: r["matches"] > 0)
    return F.transform(hit, lambda r: F.struct(r["category"], r["pattern"], r["matches"], F.concat(r["reason"], r["matches"].cast("string"), F.lit(" matches")).alias("reason")))


def structural_html(html: Column, url: Column) -> Column:
    """+2 for a feed link, +1 for an article author, +1 for a path that starts with a year from 2000 to 2029."""
    feed = html.rlike(r"(?is)<link[^>]*type\s*=\s*[\"']application/rss\+xml[\"']")
    author = html.rlike(r"(?is)<meta[^>]*property\s*=\s*[\"']og:article:author[\"']")
    dated = url.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*/20[0-2][0-9]/")
    return F.coalesce(feed.cast("int"), F.lit(0)) * 2 + F.coalesce(author.cast("int"), F.lit(0)) + F.coalesce(dated.cast("int"), F.lit(0))


def page_filter(domain: Column, content: Column, structural: Column) -> Column:
    """struct(is_personal, confidence, score, stage) of the rule stage."""
    total = domain + content + structural
    conf = F.least(F.abs(total) / F.lit(10.0), F.lit(0.9))

    def result(personal: bool, confidence: Column, score: Column, stage: str) -> Column:
        return F.struct(F.lit(personal).alias("is_personal"), confidence.alias("confidence"), score.cast("double").alias("score"), F.lit(stage).alias("stage"))

    return (
        F.when(domain >= 5, result(True, F.lit(0.9), domain, "domain"))
        .when(domain <= -5, result(False, F.lit(0.9), domain, "domain"))
        .when(total >= 3, result(True, conf, total, "content"))
        .when(total <= -3, result(False, conf, total, "content"))
        .otherwise(result(False, F.lit(0.3), total, "uncertain"))
    )


def lexicon_tenths(text: Column, lower: Column) -> Column:
    """Sum of the structural patterns present, in tenths; null text counts 0. A pattern only runs where its longest literal occurs."""
    both = (*L.STRUCTURE_PERSONAL.items(), *L.STRUCTURE_CORPORATE.items())
    table = F.array(*[F.struct(F.lit(L.literal(p)).alias("holds"), F.lit(L.java(p)).alias("pattern"), F.lit(w).alias("w")) for p, w in both])
    likely = F.filter(table, lambda r: lower.contains(r["holds"]))
    return F.when(text == "", 0).otherwise(F.coalesce(F.aggregate(likely, F.lit(0), lambda n, r: n + F.when(F.regexp_like(text, r["pattern"]), r["w"]).otherwise(0)), F.lit(0)))


def link_tenths(links: Column) -> Column:
    """Score of array(struct(href, text)), in tenths."""

    def one(a: Column) -> Column:
        href, text = F.lower(a["href"]), a["text"]
        return (
            F.when(href.contains("twitter") | href.contains("github"), 2).otherwise(0)
            + F.when(text.contains("about") | text.contains("me"), 1).otherwise(0)
            - F.when(href.contains("contact") | href.contains("privacy"), 1).otherwise(0)
            - F.when(text.contains("subscribe") | text.contains("newsletter"), 2).otherwise(0)
        )

    return F.coalesce(F.aggregate(F.transform(links, one), F.lit(0), lambda s, x: s + x), F.lit(0))


def meta_tenths(metas: Column) -> Column:
    """Score of array(struct(name, content)), in tenths."""

    def one(m: Column) -> Column:
        name, content = m["name"], m["content"]
        return (
            F.when(name.contains("author") & (content != ""), 2).otherwise(0)
            + F.when(content.contains("personal") | content.contains("blog"), 2).otherwise(0)
            - F.when(content.contains("business") | content.contains("corporate"), 2).otherwise(0)
            - F.when(name.contains("seo") | name.contains("keywords"), 1).otherwise(0)
        )

    return F.coalesce(F.aggregate(F.transform(metas, one), F.lit(0), lambda s, x: s + x), F.lit(0))


def structural_decision(tenths: Column) -> Column:
    """struct(prediction 1, 0 or null, confidence) of the structural sum."""
    return F.struct(
        F.when(tenths > 5, F.lit(1)).when(tenths < -5, F.lit(0)).alias("prediction"), F.least(F.abs(tenths) / F.lit(20.0), F.lit(1.0)).alias("confidence")
    )


def indicators(text: Column, lower: Column) -> Column:
    """array(struct(type, pattern, score, description)) of the structural patterns present."""
    all_ = [("personal", p, w) for p, w in L.STRUCTURE_PERSONAL.items()] + [("corporate", p, w) for p, w in L.STRUCTURE_CORPORATE.items()]
    rows = [
        F.when(lower.contains(L.literal(p)) & text.rlike(L.java(p)), F.struct(F.lit(kind).alias("type"), F.lit(p).alias("pattern"), F.lit(w / 10).alias("score"), F.lit(f"Found {kind} indicator: {p}").alias("description")))
        for kind, p, w in all_
    ]
    return F.filter(F.array(*rows), lambda x: x.isNotNull())


def weighted_vote(votes: dict[str, tuple[Column, Column]], weights: dict[str, int] = L.VOTES) -> Column:
    """struct(prediction, confidence) of the voters (prediction, confidence) that have an opinion; null and 0 if none has."""

    def total(value: str) -> Column:
        out = F.lit(0.0)
        for name, (pred, conf) in votes.items():
            v = {"w": F.lit(1.0), "p": pred.cast("double"), "c": conf}[value]
            out = out + F.when(pred.isNotNull(), v * weights[name]).otherwise(0.0)
        return out

    w = total("w")
    return F.struct(
        F.when(w > 0, (total("p") / w > 0.5).cast("int")).alias("prediction"), F.when(w > 0, F.coalesce(total("c") / w, F.lit(0.0))).otherwise(0.0).alias("confidence")
    )
