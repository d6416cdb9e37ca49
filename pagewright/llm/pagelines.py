"""Visible text of web pages by source line, and the phrases that weakly label text that stands in place of a post."""

from __future__ import annotations

import html
import re
from typing import NamedTuple

#: Placeholders of templates that were not filled, by the brackets of common template languages (fixed values).
BRACKETS_RE = re.compile(
    r"\{\{[^{}]{0,80}\}\}|\{%[^%]{0,80}%\}|[$#]\{[^{}]{0,80}\}|%%\w{1,60}%%|__\w{1,60}__|@\w{1,30}\.\w{1,30}@|\[\[\w+[:.]\w+\]\]|\[object object\]|<\?(?:=|php).{0,80}?\?>|<%.{0,80}?%>|<\w+ goes here>|\[your \w+ here\]"
)
#: Wording of unfilled templates and starter pages.
WORDING = [
    r"\byour \w+ goes here\b", r"\bclick to edit\b", r"\breplace this placeholder\b", r"^insert \w+ text$", r"\bundefined \w+ undefined\b", r"\b\w+-\w+-(?:tbd|todo)\b", r"\b(?:demo|dummy|sample) \w+ (?:text|line)\b",
    r"^(?:write|type|put|add) your \w+ (?:here|in this box)\b", r"\bthis starter \w+\b", r"^dear \{\w+\}", r"^sample page$", r"^hello world\W*$", r"^under construction\W*$",
]
WORDING_RE = re.compile("|".join(WORDING))

#: Notices of errors, outages, scripts and checks: wording common on the web, by whole lines or their beginning.
NOTICES = [
    r"(?:error )?(?:403|404|410|500|502|503)\W*(?:[-:|] .{1,60}|(?:not found|forbidden|gone|internal server error|bad gateway|service unavailable)\b\W?.{0,60})?$",
    r"(?:page )?not found\W*(?:[-|] .{1,60})?$", r"seite nicht gefunden", r"page introuvable", r"página no encontrada", r"página não encontrada", r"pagina non trovata",
    r"the requested (?:address|url|page) .{1,80} was not found", r"no (?:such )?(?:page|file|post|entry)\b.{1,40}$", r"(?:oops|sorry|hmm)\W.{1,60}$",
    r".{1,40} (?:is no longer available|has been (?:deleted|removed)|has expired|has moved)\b.{0,40}$",
    r"(?:forbidden|internal server error|bad gateway|service (?:temporarily )?unavailable)\b", r".{0,40}\bdown for maintenance\b", r"service notice$", r"error$",
    r"(?:this|the) (?:site|blog|page|server) is (?:offline|down|closed)\b", r"bandwidth limit exceeded", r"account suspended", r"too many requests", r"this domain is parked",
    r"(?:fatal error|parse error|warning|notice|deprecated|traceback): ", r"error establishing a database connection", r"\w+ (?:failed|timed out|was refused) after \d+", r".{1,30} went wrong\b",
    r"(?:please |you need to )?(?:enable|allow|turn on|switch on) (?:javascript|js|scripts)\b", r"javascript is (?:disabled|required)", r"(?:this|the) \w+ (?:needs|requires|works best with) (?:javascript|scripts)\b", r"bitte aktivieren sie (?:javascript|skripte)", r"your browser (?:is too old|is not supported|does not support)", r"checking (?:your browser|that you are human)", r".{0,30}verify that you are human", r"just a moment\W*$", r"loading\W*$",
]
NOTICE_RE = re.compile("|".join(NOTICES))

#: The typesetters' filler passage (fixed value); its longer words are seeds, further filler words are learned.
PASSAGE = """lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua ut enim ad minim veniam quis nostrud exercitation
ullamco laboris nisi ut aliquip ex ea commodo consequat duis aute irure dolor in reprehenderit in voluptate velit esse cillum dolore eu fugiat nulla pariatur excepteur sint occaecat cupidatat
non proident sunt in culpa qui officia deserunt mollit anim id est laborum"""
FILLER_SEEDS = frozenset(w for w in PASSAGE.split() if len(w) > 3)
#: Share of a text's words that must be seeds.
SEED_SHARE = 0.15

_TAG = re.compile(r"<[^>]*>")
_WORDS = re.compile(r"[^\W\d_]+")
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9]*)([^>]*)>|<[^>]*>|[^<]+|<", re.S)
_ATTR = re.compile(r"""(?:id|class)\s*=\s*["']?([^"'>]*)""", re.I)
_HIDDEN = frozenset(["head", "script", "style", "noscript", "template"])
_VOID = frozenset(["br", "hr", "img", "meta", "link", "input", "col", "wbr", "source", "area", "base", "embed"])
_INLINE = frozenset(["a", "b", "i", "em", "strong", "code", "small", "u", "s", "sub", "sup", "abbr", "cite", "q", "kbd", "mark", "time", "font", "img", "wbr"])
#: Formatting inside a text, no part of its path.
_FORMAT = frozenset(["b", "i", "em", "strong", "u", "s", "sub", "sup", "abbr", "cite", "q", "kbd", "mark", "font", "img", "wbr", "code"])
_BOX = frozenset(["body", "div", "section", "aside", "td", "th", "main", "article", "header", "footer", "nav", "center", "form"])
_CLOSES = {"p": ("p",), "li": ("li", "p"), "h1": ("p",), "h2": ("p",), "h3": ("p",), "h4": ("p",), "div": ("p",), "td": ("td", "p"), "tr": ("td", "tr", "p"), "hr": ("p",)}


class Line(NamedTuple):
    """A source line with visible text: number from 1, text, container path, innermost tag, share of the text inside links,
    number of the text block, and the root-to-leaf tag path (container path, then every tag down to the text; formatting left out)."""

    no: int
    text: str
    box: str
    tag: str
    linked: float
    block: int
    path: str


def normal(text: str) -> str:
    """Lower case, white space as single blanks, trimmed."""
    return " ".join(text.lower().split())


def page_lines(source: str | None) -> list[Line]:
    """The lines with visible text of an HTML page; text in head, script, style, noscript and comments isn't visible."""
    if not source:
        return []
    texts: dict[int, list] = {}
    stack: list[tuple[str, str]] = []
    hidden: str | None = None
    line, rules, block = 1, 0, 0
    boxes: list[str] = ["body"]
    for m in _TOKEN.finditer(source):
        tok = m.group()
        name = m.group(2)
        if name is None:
            if tok[0] != "<" or tok == "<":
                if hidden is None and tok.isspace():
                    if line in texts and "\n" not in tok:
                        texts[line][0].append(" ")
                elif hidden is None:
                    tag = stack[-1][0] if stack else "body"
                    linked = any(t == "a" for t, _ in stack[-3:])
                    loose = not stack or bool(stack[-1][1])  # text right in a box: every line is a block of its own
                    leaf = "/".join(t for t, box in stack[-4:] if not box and t not in _FORMAT)
                    for i, part in enumerate(tok.split("\n")):
                        if part and not part.isspace():
                            own = -line - i if loose else block
                            at = texts.setdefault(line + i, [[], boxes[-1], tag, 0, 0, own, "", 0])
                            if at[5] != own and at[0]:
                                at[0].append(" ")
                            at[0].append(part)
                            n = len(part.strip())
                            at[3] += n
                            at[4] += n * linked
                            if n > at[7]:  # the path of the longest part is the line's
                                at[6], at[7] = leaf, n
            line += tok.count("\n")
            continue
        name = name.lower()
        if hidden is not None:
            if m.group(1) and name == hidden:
                hidden = None
        elif m.group(1):
            block += name not in _INLINE
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == name:
                    for _, box in stack[i:]:
                        if box:
                            boxes.pop()
                    del stack[i:]
                    break
        elif name in _HIDDEN:
            if not m.group(3).endswith("/"):
                hidden = name
        else:
            block += name not in _INLINE
            for other in _CLOSES.get(name, ()):
                if stack and stack[-1][0] == other:
                    if stack[-1][1]:
                        boxes.pop()
                    stack.pop()
            if name == "hr" and len(boxes) == 1:
                rules += 1
                boxes[0] = f"body#{rules}"
            if name in _VOID or m.group(3).endswith("/"):
                if name == "br" and line in texts:
                    texts[line][0].append(" ")
            elif name == "body" or name == "html":
                pass
            elif name in _BOX:
                a = _ATTR.search(m.group(3)) if m.group(3) else None
                boxes.append(f"{boxes[-1]}/{name}.{a.group(1) if a else ''}")
                stack.append((name, boxes[-1]))
            else:
                stack.append((name, ""))
        if "\n" in tok:
            line += tok.count("\n")
    out = []
    for no, (parts, box, tag, n, linked, block, leaf, _) in texts.items():
        text = "".join(parts)
        if "&" in text:
            text = html.unescape(text)
        text = text.strip()
        if text:
            out.append(Line(no, text, box, tag, linked / max(n, 1), block, f"{box}/{leaf}"))
    return out


def text_lines(content: str | None) -> list[Line]:
    """The lines with visible text of extracted content, which may hold single tags."""
    if not content:
        return []
    if "</" in content:
        return page_lines(content)
    out = []
    for i, part in enumerate(content.split("\n"), 1):
        if part and not part.isspace():
            if "<" in part or "&" in part:
                part = html.unescape(_TAG.sub("", part))
                if not part.strip():
                    continue
            out.append(Line(i, part.strip(), "text", "", 0.0, i, "text"))
    return out


def is_filler(text: str) -> bool:
    """Whether a normalised text of three words or more holds filler seeds in a share of its words."""
    words = _WORDS.findall(text)
    return len(words) >= 3 and sum(w in FILLER_SEEDS for w in words) >= SEED_SHARE * len(words)


def is_template(text: str) -> bool:
    """Whether a normalised text holds an unfilled placeholder."""
    if ("{" in text or "%" in text or "[" in text or "<" in text or "@" in text or "__" in text) and BRACKETS_RE.search(text):
        return True
    return bool(WORDING_RE.search(text))


def is_residue(text: str) -> bool:
    """Whether the phrases call a normalised line a notice, an unfilled template or filler: a weak label."""
    return bool(NOTICE_RE.match(text)) or is_template(text) or is_filler(text)
