"""Pattern lists and weights of the page classifier, in natural order.

All scoring functions take a lexicon as parameter; these are the defaults.
"""

from __future__ import annotations

import re
from typing import NamedTuple

#: Host substrings of the domain score, with the weight of each class.
DOMAIN_STRONG = ("github.io", "netlify.app", "vercel.app", "hashnode.dev", "dev.to", "substack.com", "medium.com/@", "tumblr.com")
DOMAIN_MEDIUM = ("wordpress.com", "blogspot.com")
DOMAIN_AGAINST = (
    "blogspot.com/business", "wordpress.com/business", "themeforest.net", "envato.com", "wix.com", "squarespace.com", "shopify.com", "amazon.com", "microsoft.com",
    "google.com", "apple.com", "facebook.com", "twitter.com", "linkedin.com", "forbes.com", "techcrunch.com", "wired.com", "theverge.com", "arstechnica.com",
    "engadget.com", "gizmodo.com", "mashable.com", "venturebeat.com", "zdnet.com", "cnet.com",
)
DOMAIN_WEIGHTS = {"strong": 5, "medium": 2, "against": -5}


class Group(NamedTuple):
    """A category of content patterns with one weight per match."""

    name: str
    weight: int
    patterns: tuple[str, ...]


#: Content patterns (fixed values), one per line; a border is one of a word of ASCII letters, digits and underscores.
PRONOUNS = Group("personal_pronouns", 1, (
    r"\bmy\s+(thoughts|experience|journey|story|blog|notes|learning|experiments|projects|research|findings|observations|insights|reflections)\b",
    r"\bI\s+(think|believe|feel|know|learned|discovered|found|realized|noticed|observed)\b",
    r"\bin\s+my\s+(opinion|view|perspective|experience)\b",
    r"\bfrom\s+my\s+(perspective|experience|point\s+of\s+view)\b",
))
IDENTITY = Group("personal_identity", 2, (
    r"\babout\s+me\b",
    r"\babout\s+the\s+author\b",
    r"\bpersonal\s+blog\b",
    r"\bauthor\s+bio\b",
    r"\bcontact\s+me\b",
    r"\bfollow\s+me\s+on\b",
    r"\bmy\s+(twitter|github|linkedin|portfolio|website)\b",
))
MARKETING = Group("marketing_terms", -2, (
    r"\bsponsored\s+post\b",
    r"\badvertisement\b",
    r"\bpromoted\s+content\b",
    r"\baffiliate\s+link\b",
    r"\bbuy\s+now\b",
    r"\bshop\s+now\b",
    r"\blimited\s+time\s+offer\b",
    r"\bdiscount\s+code\b",
    r"\bcoupon\s+code\b",
    r"\bfree\s+trial\b",
    r"\bsign\s+up\s+now\b",
    r"\bsubscribe\s+now\b",
    r"\bdownload\s+now\b",
    r"\bget\s+started\b",
    r"\blearn\s+more\b",
    r"\bread\s+more\b",
    r"\bclick\s+here\b",
    r"\bvisit\s+our\s+website\b",
    r"\bcontact\s+us\b",
    r"\bsales\s+team\b",
    r"\bmarketing\s+team\b",
))
CORPORATE = Group("corporate_terms", -2, (
    r"\bcorporate\s+blog\b",
    r"\bcompany\s+blog\b",
    r"\bofficial\s+blog\b",
    r"\bbrand\s+blog\b",
    r"\bmarketing\s+blog\b",
    r"\bseo\s+blog\b",
    r"\bcontent\s+marketing\b",
    r"\blead\s+generation\b",
    r"\bconversion\s+optimization\b",
    r"\broi\b",
    r"\bkpi\b",
    r"\bmetrics\b",
    r"\banalytics\b",
    r"\bgrowth\s+hacking\b",
    r"\bdigital\s+marketing\b",
    r"\bsocial\s+media\s+marketing\b",
    r"\bemail\s+marketing\b",
    r"\bppc\b",
    r"\bsem\b",
    r"\bseo\b",
    r"\bbacklink\b",
    r"\bkeyword\b",
    r"\branking\b",
    r"\btraffic\b",
    r"\bconversion\b",
    r"\bcta\b",
    r"\bfunnel\b",
    r"\blanding\s+page\b",
    r"\blead\s+magnet\b",
    r"\bopt-in\b",
    r"\bnewsletter\s+signup\b",
    r"\bemail\s+list\b",
    r"\bsubscriber\b",
    r"\bcustomer\b",
    r"\bclient\b",
    r"\bprospect\b",
    r"\blead\b",
    r"\bsale\b",
    r"\brevenue\b",
    r"\bprofit\b",
    r"\bbusiness\b",
    r"\benterprise\b",
    r"\bcorporate\b",
    r"\bcompany\b",
    r"\borganization\b",
    r"\bagency\b",
    r"\bconsulting\b",
    r"\bservices\b",
    r"\bsolutions\b",
    r"\bplatform\b",
    r"\bsoftware\b",
    r"\btool\b",
    r"\bproduct\b",
    r"\bservice\b",
    r"\bpricing\b",
    r"\bplans\b",
    r"\bfeatures\b",
    r"\bbenefits\b",
    r"\badvantages\b",
    r"\bwhy\s+choose\s+us\b",
))
CONTENT = (PRONOUNS, IDENTITY, MARKETING, CORPORATE)

#: Structural patterns with weights in tenths (fixed values); each counts once.
STRUCTURE_PERSONAL = {
    r"about\s*me": 3,
    r"about\s*the\s*author": 3,
    r"who\s*i\s*am": 2,
    r"my\s*story": 2,
    r"\bi\s*am\b": 1,
    r"\bmy\s*experience\b": 2,
    r"\bi\s*want\b": 1,
    r"\bi\s*think\b": 1,
    r"twitter\.com": 2,
    r"github\.com": 2,
    r"linkedin\.com": 1,
    r"instagram\.com": 1,
    r"\.dev\b": 3,
    r"\.me\b": 2,
    r"\.blog\b": 2,
    r"/feed": 2,
    r"/rss": 2,
    r"\.xml": 1,
    r"powered\s*by\s*wordpress": 1,
    r"built\s*with\s*hugo": 1,
    r"jekyll": 1,
}
STRUCTURE_CORPORATE = {
    r"contact\s*us": -2,
    r"privacy\s*policy": -2,
    r"terms\s*of\s*service": -2,
    r"cookie\s*policy": -2,
    r"subscribe\s*now": -2,
    r"get\s*started": -2,
    r"free\s*trial": -3,
    r"limited\s*time": -3,
    r"\.com\b": -1,
    r"\.org\b": -1,
    r"\.net\b": -1,
    r"googleadservices": -3,
    r"doubleclick": -3,
    r"facebook\.com/tr": -3,
    r"seo\s*optimized": -2,
    r"search\s*engine": -1,
    r"keyword": -1,
}

#: Paths that mark company pages and blogs, in the order they are tried (fixed values).
PATHS_CORPORATE = (
    "/press/",
    "/news/",
    "/careers/",
    "/product/",
    "/services/",
    "/about-us/",
    "/company/",
    "/team/",
    "/contact/",
    "/privacy/",
    "/terms/",
    "/advertise/",
    "/sponsor/",
    "/pricing/",
    "/enterprise/",
    "/documentation/",
    "/api/",
    "/developers/",
    "/support/",
    "/help/",
    "/tutorial/",
    "/guide/",
    "/docs/",
    "/reference/",
    "/manual/",
)
PATHS_BLOG = ("/blog/", "/post/", "/article/", "/writing/", "/journal/", "/diary/", "/story/", "/memoir/", "/202[0-9]/", "/201[0-9]/")

#: Query parameters that only track, by prefix and by name.
TRACKING_PREFIXES = ("utm", "ga_", "pk_", "vero_", "hs_", "mc_", "fbclid", "gclid", "yclid", "igshid", "mkt_tok", "spm", "zanpid")
TRACKING_NAMES = ("ref", "source", "feature", "trk", "partner", "share", "s", "gi", "_hsenc", "_hsmi", "cid")

#: Link texts of blogrolls, and hosts that are no blogs.
BLOGROLL_TEXTS = (
    "favorites", "reading", "recommended", "links", "friends", "blogs i read", "sites i like", "inspiration", "people i follow", "recommended reading", "blog friends",
    "my friends", "other blogs", "blog links", "sites worth visiting", "blogs i love",
)
SKIPPED_HOSTS = (
    "facebook.com", "twitter.com", "instagram.com", "linkedin.com", "youtube.com", "github.com", "amazon.com", "google.com", "wikipedia.org", "reddit.com", "stackoverflow.com",
)
#: Paths where feeds usually are.
FEED_PATHS = ("/feed", "/rss", "/atom", "/blog/feed", "/posts/feed", "/rss.xml", "/atom.xml")

#: Garbled sequences and what they stood for, in the order they are replaced.
MOJIBAKE = (("Ã¢â‚¬â€", "—"), ("Ã¢â‚¬â€œ", "–"), ("Ã¢â‚¬â„¢", "'"), ("Ã¢â‚¬Å\"", '"'), ("Ã¢â‚¬â¢", "•"), ("Ã¢â‚¬Â¦", "…"), ("Ã¢â‚¬Â", '"'))

#: Weights of the four voters of the combined classification, in hundredths.
VOTES = {"domain": 30, "tfidf": 25, "embedding": 30, "structural": 15}
AUTO_ADD, REVIEW = 0.85, 0.75


_BORDER = r"\b"


def java(pattern: str) -> str:
    """A pattern for Spark: case ignored, borders of ASCII words."""
    p = pattern
    if p.startswith(_BORDER):
        p = "(?<![A-Za-z0-9_])" + p[2:]
    if p.endswith(_BORDER):
        p = p[:-2] + "(?![A-Za-z0-9_])"
    return "(?i)" + p


def re2(pattern: str) -> str:
    """The same pattern for an RE2 engine, whose borders are ASCII."""
    return "(?i)" + pattern


def _inner(pattern: str) -> str:
    return pattern.removeprefix(_BORDER).removesuffix(_BORDER)


def literal(pattern: str) -> str:
    """The longest lower-case literal that every match of the pattern holds."""
    plain = re.sub(r"\([^)]*\)", "|", _inner(pattern)).lower()
    return max((x.replace("\\", "") for x in re.split(r"\\s[*+]|\||\[[^]]*\]", plain)), key=len)


def single_word(pattern: str) -> str | None:
    """The word of a pattern that is one word between borders."""
    m = re.fullmatch(r"\\b([A-Za-z0-9_]+)\\b", pattern)
    return m.group(1).lower() if m else None


def markers(pattern: str) -> tuple[str, ...]:
    """Words of which every match of a phrase pattern holds at least one: the shortest list of alternatives, or the longest word."""
    groups = re.findall(r"\(([^)]*)\)", pattern)
    if groups:
        return tuple(sorted({re.split(r"\\s[+*]", alt)[0].lower() for alt in groups[0].split("|")}))
    return (max(re.split(r"\\s[+*]|-", _inner(pattern)), key=len).lower(),)
