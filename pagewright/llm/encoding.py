"""Problem 7: text that was read with the wrong character encoding.

Noisy-channel decoding. A channel is the pair of the encoding a text was written in and the one it was read with, once or
several times over. For a suspicious token the bytes behind its characters form a lattice: a character stands for its byte in the
encoding it was read with, a replacement character for any byte, or for any character of a single-byte encoding, and where a byte without a character in the wrong
encoding can have been dropped on the way, an edge puts it back. A beam over the lattice, scored by character pairs, yields the valid
decodings of a token; a Viterbi search over the tokens of a value then picks the path with the best word frequencies, and pays
for channels, their changes and lost bytes. Leaving a token as it is competes with its readings: a value is damaged if the best path changes a
token, or holds a lost character. A lost character that no word of the corpus or several equally good ones explain stays lost.

Words and character pairs are counted over the whole corpus in a sketch of fixed size, from tokens that no channel can
read, so damaged text does not vouch for itself. Tokens of ASCII characters cannot be damaged and are skipped; each distinct
token is analysed once per worker (bounded memo).
"""

from __future__ import annotations

import html
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.llm.sketch import SCHEMA, blocks_of, log_sketch
from pagewright.plans.runtime import table

#: Encodings in which UTF-8 is misread (fixed values), most common first.
READ_AS = ("cp1252", "latin-1", "cp437", "mac_roman", "cp1251", "cp1250", "cp850", "iso8859-2", "cp1254", "koi8-r", "cp866", "cp852")
#: (written in, read as) of single-byte mix-ups: Cyrillic read as Latin, and Latin read as Cyrillic.
SINGLE = (("cp1251", "latin-1"), ("cp1252", "cp1251"), ("koi8-r", "latin-1"))
#: Encodings whose characters are tried for a character lost when a single-byte text was read as UTF-8.
LOST_IN = ("cp1252", "cp1250", "cp1251")
#: Rows and counters of the word sketch (a word's frequency is the least of its rows), and counters of character pairs.
WORD_ROWS, WORD_BITS, PAIR_BITS = 3, 21, 18
MEMO = 200_000
#: Costs in bits: of a misreading at all, of the one most common next to the rarest, of a lost byte, of a change of channel between neighbouring tokens.
LAYER, RARE, HOLE, SWITCH = 12.0, 4.0, 3.0, 3.0
#: Partial decodings that a beam keeps, readings of a token that go into the search, and those that are read once more.
BEAM, READINGS, DEEPER = 12, 6, 4
#: Bits of a character pair seen once, and what an unseen pair costs beyond that if its second character is not seen either.
UNSEEN, STRANGE = 14.0, 6.0
_EDGE = ".,;:!?()[]\"'<>/*_-"


def _inverse(name: str) -> dict[str, int]:
    out = {chr(b): b for b in range(128)}
    for b in range(128, 256):
        try:
            out[bytes([b]).decode(name)] = b
        except UnicodeDecodeError:
            pass
    for b in range(128, 160):  # holes are passed on as control characters
        out.setdefault(chr(b), b)
    return out


_INVERSE = {e: _inverse(e) for e in READ_AS}
#: Bytes that the encoding has no character for, or a blank one: these can have been dropped.
_DROPPED = {e: frozenset(b for b in range(0x80, 0xC0) if not any(v == b and ord(c) > 160 for c, v in inv.items())) for e, inv in _INVERSE.items()}


def _class(inverse: dict[str, int], lo: int, hi: int) -> str:
    return "[" + "".join(re.escape(c) for c, b in inverse.items() if lo <= b <= hi) + "]"


def _sequences(inverse: dict[str, int]) -> re.Pattern[str]:
    c = _class(inverse, 0x80, 0xBF)
    return re.compile(f"(?:{_class(inverse, 0xC2, 0xDF)}{c}|{_class(inverse, 0xE0, 0xEF)}{c}{c}|{_class(inverse, 0xF0, 0xF4)}{c}{c}{c})")


_LEAD = {e: re.compile("[\ufffd" + _class(inv, 0xC2, 0xF4)[1:]) for e, inv in _INVERSE.items()}
_SEQUENCES = {e: _sequences(inv) for e, inv in _INVERSE.items()}
_ANY_SEQUENCE = re.compile("|".join(p.pattern for p in _SEQUENCES.values()))
#: What only a loss explains: replacement or control characters, and lead bytes whose continuation is missing.
_LOSS = re.compile("[\x80-\x84\x86-\x9f\ufffd]|â€|Ð|Ã(?=[a-z]|$)|Ã¢|Â(?=$)|(?<=[a-z])Ñ(?=[^A-Za-z])|Ñ(?=[ÐÑ])|вЂ|ÔÇ|ΓÇ|‚Ä")
_MIXED = re.compile("[A-Za-z][Ѐ-ӿ]|[Ѐ-ӿ][A-Za-z]")
_LATIN_RUN = re.compile("[À-ÖØ-öø-ÿ÷]{3,}")
_HIGH = {e: "".join(bytes([b]).decode(e, "ignore") for b in range(0x80, 0x100)) for e in LOST_IN}
_HIGH = {e: "".join(c for c in t if c > "\xa0") for e, t in _HIGH.items()}


def word_of(token: str) -> bytes:
    return token.strip(_EDGE + "“”’‘«»…—").lower().encode("utf-8", "surrogatepass")


def _word_slots(word: bytes) -> list[int]:
    a, b = zlib.crc32(word), zlib.adler32(word) * 0x9E3779B1 ^ zlib.crc32(word, 77) | 1
    return [(k << WORD_BITS) + ((a + k * b >> k) & ((1 << WORD_BITS) - 1)) for k in range(WORD_ROWS)]


def _pair_slot(a: str, b: str) -> int:
    return (WORD_ROWS << WORD_BITS) + ((ord(a) * 0x9E3779B1 ^ ord(b) * 0x85EBCA6B) >> 3 & ((1 << PAIR_BITS) - 1))


def _odd(m: re.Match[str]) -> bool:
    """Whether matched bytes look like bytes: a run of Cyrillic letters in the case of a word does not."""
    s = m.group()
    return not (all("Ѐ" <= c <= "ӿ" for c in s) and (s.islower() or s.isupper() or s[1:].islower()))


def suspicious(token: str) -> bool:
    """Whether some channel can read the token, or something is lost in it."""
    return bool(any(map(_odd, _ANY_SEQUENCE.finditer(token))) or _LOSS.search(token) or _MIXED.search(token) or (_LATIN_RUN.search(token) and not re.search("[A-Za-z]", token)))


class Model:
    """Word and character-pair frequencies from the counted sketch, in bits."""

    def __init__(self, sketch: np.ndarray):
        self.sketch = sketch
        self.steps: dict[tuple[str, str], float] = {}

    def word(self, token: str) -> float:
        """log2 of the number of times the word stands in undisputed text; 0 for none."""
        w = word_of(token)
        return min(float(self.sketch[i]) for i in _word_slots(w)) / 8 if w else 0.0

    def step(self, a: str, b: str) -> float:
        """Bits of a character after another; pairs of ASCII characters count as common."""
        if a < "\x80" and b < "\x80":
            return 4.0
        cost = self.steps.get((a, b))
        if cost is None:
            n = float(self.sketch[_pair_slot(a, b)]) / 8
            cost = self.steps[a, b] = max(UNSEEN - n, 2.0) if n else UNSEEN + (2.0 if b < "\x80" or self.sketch[_pair_slot(b, b)] else STRANGE)
        return cost

    def bits(self, token: str) -> float:
        """Cost of a token: its character pairs, less what its frequency as a word is worth."""
        t = "^" + token.lower() + "$"
        return sum(self.step(a, b) for a, b in zip(t, t[1:])) - 2.0 * self.word(token)


def _continuations(lead: int) -> int:
    return 1 if 0xC2 <= lead <= 0xDF else 2 if 0xE0 <= lead <= 0xEF else 3 if 0xF0 <= lead <= 0xF4 else 0


_TAIL = range(0x80, 0xC0)
_LEADS = (*range(0xC2, 0xE0), 0xE2)


def decodings(token: str, name: str, model: Model) -> list[tuple[float, str, int, int]]:
    """(bits, text, characters read back, bytes lost) of the best decodings of the token's byte lattice for ``name``.

    Every character may stay as it is, or a run of them may be the bytes of one UTF-8 character; a replacement character is a byte of any value, and a
    byte that ``name`` would have dropped may be put back. The beam keeps the ``BEAM`` cheapest texts at each position.
    """
    inverse, dropped = _INVERSE[name], _DROPPED[name]
    cells = [None if c == "\ufffd" else inverse.get(c) for c in token]
    n = len(token)
    core = [c for c in token if c.isalpha() and c.isascii()]
    capital = len(core) > 1 and all(c.isupper() for c in core)
    at: list[dict[str, tuple[float, int, int]]] = [{} for _ in range(n + 1)]
    at[0][""] = (0.0, 0, 0)

    def sequences(i: int) -> Iterator[tuple[int, str, int]]:
        """(end, character, bytes lost) of the UTF-8 characters that can begin at cell i."""
        hole = token[i] == "\ufffd"
        if not hole and (cells[i] is None or not _continuations(cells[i])):
            return
        for lead in _LEADS if hole else (cells[i],):
            front: list[tuple[int, bytes, int]] = [(i + 1, bytes([lead]), int(hole))]
            for _ in range(_continuations(lead)):
                nxt = []
                for j, b, lost in front:
                    if j < n and token[j] == "\ufffd":
                        nxt += [(j + 1, b + bytes([x]), lost + 1) for x in _TAIL] if lost < 2 else []
                    elif j < n and cells[j] is not None and cells[j] in _TAIL:
                        nxt.append((j + 1, b + bytes([cells[j]]), lost))
                    else:
                        nxt += [(j, b + bytes([x]), lost + 1) for x in dropped] if lost < 1 else []
                front = nxt
            for j, b, lost in front:
                if j > i + 1 or lost:
                    try:
                        c = b.decode("utf-8")
                    except UnicodeDecodeError:
                        continue
                    if not lost or not c.isalpha() or c.isupper() == capital:
                        yield j, c, lost

    for i in range(n):
        if not at[i]:
            continue
        best = sorted(at[i].items(), key=lambda x: x[1][0])[:BEAM]
        steps = [(i + 1, token[i], 0, 0), *((j, c, 1, lost) for j, c, lost in sequences(i))]
        for text, (cost, read, lost) in best:
            last = text[-1].lower()[0] if text else "^"
            for j, c, r, more in steps:
                total = cost + model.step(last, c.lower()[0]) + HOLE * more
                key = text + c
                if key not in at[j] or total < at[j][key][0]:
                    at[j][key] = (total, read + r, lost + more)
    return sorted((cost, text, read, lost) for text, (cost, read, lost) in at[n].items() if read)[:READINGS]


def singles(token: str) -> list[tuple[str, str]]:
    """(channel, restored) for single-byte mix-ups."""
    out = []
    core = token.strip(_EDGE)
    for written, read in SINGLE:
        if written != "cp1252":
            if not _LATIN_RUN.search(core) or re.search("[A-Za-z]", core):
                continue
        elif not _MIXED.search(token):
            continue
        try:
            out.append((f"{written}>{read}", token.encode(read).decode(written)))
        except UnicodeError:
            pass
    return out


def lost_characters(token: str, name: str, model: Model) -> list[tuple[float, str]]:
    """(bits, text) of the token with every replacement character as one character of ``name``: in the case of the letters around."""
    front: list[tuple[float, str]] = [(0.0, "")]
    core = [c for c in token if c.isalpha()]
    capital = len(core) > 1 and all(c.isupper() for c in core)
    for c in token:
        options = [x for x in _HIGH[name] if x.isupper() == capital or not x.isalpha()] if c == "\ufffd" else c
        front = sorted((cost + model.step(t[-1].lower()[0] if t else "^", x.lower()[0]) + HOLE * (c == "\ufffd"), t + x) for cost, t in front for x in options)[: 4 * BEAM]
    return front


class Restorer:
    """Finds damaged tokens and restores values, given the sketch of word frequencies."""

    def __init__(self, sketch: np.ndarray):
        self.model = Model(sketch)
        self.known: dict[str, list[tuple[str, str, float]]] = {}

    def options(self, token: str) -> list[tuple[str, str, float]]:
        """(channel, reading, score), best first; the token itself under channel '' among them. A token that is not suspicious has only itself."""
        if token in self.known:
            return self.known[token]
        t = html.unescape(token) if "&" in token else token
        out = [("", token, -self.model.bits(t))]
        if suspicious(t):
            out = self._readings(token, t)
        if len(self.known) >= MEMO:
            self.known.clear()
        self.known[token] = out
        return out

    def _readings(self, token: str, t: str) -> list[tuple[str, str, float]]:
        model = self.model
        found: dict[str, tuple[float, str]] = {}

        def add(channel: str, text: str, cost: float) -> None:
            score = -model.bits(text) - cost
            if text != t and (text not in found or score > found[text][0]):
                found[text] = (score, channel)

        front, seen = [(0.0, "", t)], {t}
        for _ in range(3):
            nxt = []
            for cost, chain, text in front:
                lost_only = "\ufffd" in text and text.replace("\ufffd", "").isascii()
                for k, name in enumerate(READ_AS[:1] if lost_only else READ_AS):
                    if not (_SEQUENCES[name].search(text) or (_LOSS.search(text) and _LEAD[name].search(text))):
                        continue
                    held = text.count("\ufffd")
                    for _, reading, _, lost in decodings(text, name, model):
                        filled = held - reading.count("\ufffd")
                        if filled and not model.word(reading):
                            continue  # no word of the corpus explains what was lost
                        price = cost + LAYER + RARE * k / len(READ_AS) + HOLE * lost
                        add(f"{chain} {name}".strip(), reading, price)
                        if reading not in seen and suspicious(reading):
                            seen.add(reading)
                            nxt.append((price, f"{chain} {name}".strip(), reading))
            front = sorted(nxt, key=lambda x: (len(x[2]), x))[:DEEPER]  # the shortest has most of its bytes read back
            if not front:
                break
        for channel, reading in singles(t):
            add(channel, reading, LAYER + RARE)
        if "\ufffd" in t and t.count("\ufffd") < len(t.strip(_EDGE)):
            for name in LOST_IN:
                tried = [(-model.bits(x), x) for _, x in lost_characters(t, name, model)]
                tried = sorted(((s, x) for s, x in tried if model.word(x) > 0), reverse=True)
                if tried and (len(tried) == 1 or tried[0][0] > tried[1][0] + 0.5):
                    add(f"lost {name}", tried[0][1], LAYER + HOLE * t.count("\ufffd"))
        stay = ("", token, -model.bits(t))
        return sorted([(c, x, s) for x, (s, c) in found.items()] + [stay], key=lambda o: -o[2])[: READINGS + 1]

    def path(self, value: str) -> tuple[list[str], dict[int, str], bool]:
        """(tokens and blanks of the value, readings by place, whether something is damaged)."""
        tokens = re.split("([ \n\r\t]+)", value)
        at = [(i, self.options(t)) for i, t in enumerate(tokens) if _beyond(t)]
        at = [(i, o) for i, o in at if len(o) > 1 or suspicious(tokens[i])]
        if not at:
            return tokens, {}, False
        # Viterbi: the state is the channel of the last damaged token
        best: dict[str, tuple[float, list[tuple[int, str]]]] = {"": (0.0, [])}
        for i, opts in at:
            nxt: dict[str, tuple[float, list[tuple[int, str]]]] = {}
            for channel, reading, score in opts:
                for c, (s, p) in best.items():
                    state = channel or c
                    total = s + score - SWITCH * (channel != "" and c not in ("", channel)) + SWITCH * (channel != "" and c == channel)
                    if state not in nxt or total > nxt[state][0]:
                        nxt[state] = (total, [*p, (i, reading)] if channel else p)
            best = dict(sorted(nxt.items(), key=lambda x: -x[1][0])[:BEAM])
        chosen = dict(max(best.values(), key=lambda x: x[0])[1])
        return tokens, chosen, bool(chosen) or "\ufffd" in value

    def damaged(self, value: str | None) -> bool:
        """Whether the best path changes a token of the value, or a character is lost in it; null and ASCII values aren't damaged."""
        if not value or (value.isascii() and "&" not in value):
            return False
        return self.path(value)[2]

    def restore(self, value: str | None) -> str | None:
        """The value along the best path; what no channel explains stays."""
        if not value or (value.isascii() and "&" not in value):
            return value
        tokens, chosen, _ = self.path(value)
        return "".join(chosen.get(i, t) for i, t in enumerate(tokens))


def _beyond(t: str) -> bool:
    return not t.isascii() or ("&" in t and ";" in t)


def _tokens(value: str) -> Iterator[str]:
    for t in value.replace("\n", " ").replace("\r", " ").replace("\t", " ").split(" "):
        if _beyond(t):
            yield t


def count_into(total: np.ndarray, tokens: Counter[str]) -> None:
    """Add the words and character pairs of undisputed tokens to the counters."""
    slots, weights = [], []
    for t, n in tokens.items():
        if not suspicious(t):
            slots += _word_slots(word_of(t))
            weights += [n] * WORD_ROWS
            low = "^" + t.lower() + "$"
            for a, b in (*zip(low, low[1:]), *((c, c) for c in set(low))):
                if a >= "\x80" or b >= "\x80":
                    slots.append(_pair_slot(a, b))
                    weights.append(n)
    np.add.at(total, np.array(slots, np.int64), np.array(weights, np.uint32))


SKETCH = (WORD_ROWS << WORD_BITS) + (1 << PAIR_BITS)


def word_sketch(rows: DataFrame, fields: list[str]) -> np.ndarray:
    """Frequencies of words and character pairs beyond ASCII, counted over all rows and fields."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, tokens = np.zeros(SKETCH, np.uint32), Counter()
        for batch in batches:
            for column in batch.columns:
                for v in column.to_pylist():
                    if v and not v.isascii():
                        tokens.update(_tokens(v))
            if len(tokens) > MEMO:
                count_into(total, tokens)
                tokens = Counter()
        count_into(total, tokens)
        yield blocks_of(total)

    return log_sketch(rows.select(*fields).mapInArrow(count, SCHEMA), SKETCH)


def examined(rows: DataFrame, key: str, fields: list[str], restore: bool) -> DataFrame:
    """(key, field_name[, restored]): the damaged values of ``fields``."""
    weights = rows.sparkSession.sparkContext.broadcast(word_sketch(rows, fields))  # of fixed size
    kept = rows.select(F.col(key).cast("long").alias(key), *fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = Restorer(weights.value)
        for batch in batches:
            keys = batch.column(0).to_pylist()
            out = [(k, f, v) for f, column in zip(fields, batch.columns[1:]) for k, v in zip(keys, column.to_pylist()) if r.damaged(v)]
            cols = {key: pa.array([x[0] for x in out], pa.int64()), "field_name": pa.array([x[1] for x in out], pa.string())}
            if restore:
                cols["restored"] = pa.array([r.restore(x[2]) for x in out], pa.string())
            yield pa.RecordBatch.from_pydict(cols)

    return kept.mapInArrow(run, f"`{key}` long, field_name string" + ", restored string" * restore)


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles and contents damaged by a wrong decoding."""
    return examined(table(spark, sf_dir, "search_index"), "doc_idx", ["title", "content"], False)


def p7_restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The damaged values in their restored form."""
    return examined(table(spark, sf_dir, "search_index"), "doc_idx", ["title", "content"], True)


QUERIES = {"p7_found": p7_found, "p7_restored": p7_restored}
