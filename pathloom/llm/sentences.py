"""Sentence units of texts in many languages and scripts.

A line break always ends a sentence.  Inside a line every place where a
sentence could end is a candidate, and a semi-Markov dynamic programme chooses
the whole spans between candidates whose scores add up to most.  A span is
scored jointly by

* its closing word and mark: full marks, ellipses, polite particles of Thai,
  abbreviations that never, sometimes or only before a number go on;
* the word that opens what follows: case where the text around uses case,
  else how often the word opens a line rather than stands inside one;
* balance: quotations and brackets that the span cuts, and a quotation that
  ends a sentence it did not begin;
* its length.

How words open and close lines is counted over all texts, in two tables of
fixed size that words share by hash.

Defined cases
    null or blank text: no sentences; null or repeated ids: as they come;
    a line without any mark: one sentence; positions count code points from 1.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .spread import spread

BUCKETS = 1 << 16

# Abbreviations by what may follow them, lower case, without the last period.
NEVER = frozenset(
    "mr mrs ms dr prof st mt rev gen sgt capt lt hr fr frau hrn dipl ing sr sra srta d.ª m mm mme mlle mgr me cf vs esp incl inkl approx ca aprox env max min.ca i.e e.g ie eg z z.b b d d.h h o ä o.ä u u.a s.o bzw ggf evtl sog vgl geb verm zzgl "
    "p.ex ex p.ej ej jr wt résp resp av apr कि.ग्रा रु डॉ श्री กก ดร น.ส พ.ศ จ د أ م".split()
)
BEFORE_NUMBER = frozenset("no nr nos p pp pg s fig figs vol vols ver sec sect ext ch chap art pág págs núm núms jan feb mar apr jun jul aug sep sept oct nov dec bj abb kap bd tel h para ص รุ่น".split())
SOMETIMES = frozenset("in ft lb lbs oz min sec hrs co ltd inc corp bros llc plc gmbh a.m p.m am pm u.k u.s u.s.a s.a s.l etc usw l cm mm kg km g ml dept esp max bzw uvm z.zt s.l.u cie".split())
_SHORT = NEVER | BEFORE_NUMBER | SOMETIMES
MONTHS_AND_FLOORS = frozenset("januar februar märz april mai juni juli august september oktober november dezember stock etage jahrhundert januar. geburtstag klasse".split())
THAI_ENDS = ("นะครับ", "นะคะ", "ครับผม", "ครับ", "ค่ะ", "คะ", "จ้ะ", "จ้า")

_FULL = ".!?。！？।॥؟۔｡．…‼⁇⁈⁉"
_CLOSE = "\"'”’»›)]}」』》〉】〕）］＂“"
_SMILE = r"(?:(?:[:;=8][-'^o]?[)(\]\[DPp3/\\|*oO]+|</?3+|\^[_.-]?\^|[xX]D+|[\U0001F000-\U0001FAFF☀-➿⭐❤][️‍\U0001F3FB-\U0001F3FF♀♂]*)(?![A-Za-z0-9]))"
_LINE = re.compile(r"[^\n\r\x0b\x0c\x85  ]+")
_MARK = re.compile(r"\s*(?:(?:\(?\d{1,3}[.)]|\(?[a-zA-Z]\)|[-–—•‣◦*·●▪])\s+)")
_ENDS = re.compile(r"(?P<mark>\s?[!?؟！？‼⁇⁈⁉](?:\s?[.!?؟！？…‼⁇⁈⁉])*|[.…。।॥۔｡．]+[.!?。！？…]*)(?P<close>[" + re.escape(_CLOSE) + r"]*)(?P<smile>(?:\s*" + _SMILE + r")*)")
_THAI = re.compile(r"(?:" + "|".join(THAI_ENDS) + r")(?=\s)(?P<smile>(?:\s*" + _SMILE + r")*)")
_ALONE = re.compile(r"(?:\s+" + _SMILE + r")+(?=\s)")
_WORD = re.compile(r"[^\s" + re.escape("\"'“„«»”‘(（[「『¿¡-–—<") + r"][^\s]*")
_MODEL = re.compile(r"[A-Za-z]{2}[ -]?\d")
_DATE = re.compile(r"(0[1-9]|[12]\d|3[01])\.(0[1-9]|1[0-2])")
_CAPITALS = re.compile(r"[A-Z]{2,}\b")
_STRONG = re.compile(r"[!?！？。…]+")
_SOLID = re.compile(r"\S")
_SPACE = re.compile(r"\s")
_THAI_CLOSE = re.compile("[รคจ]")
_SHOWY = re.compile(r"\s[:;=8<^xX\U0001F000-\U0001FAFF☀-➿⭐❤]")
_PAIRS = {"(": ")", "[": "]", "{": "}", "（": "）", "［": "］", "「": "」", "『": "』", "《": "》", "【": "】", "«": "»", "“": "”", "„": "“”", "‘": "’", "‹": "›"}
_QUOTES = re.compile("[" + re.escape("\"')]}）］」』》】»”“’›" + "".join(_PAIRS)) + "]")
#: Scores of a span: what a cut through a quotation or bracket costs, and one that a quotation closes inside; a span of one character; beyond so many characters, each.
CUT, TINY, LONG, BEYOND = 9.0, 4.0, 400, 0.002
#: Characters that are looked at behind an end and for the word before it.
NEAR = 80


def bucket(word: str) -> int:
    return xxhash.xxh32_intdigest(word.encode("utf-8", "surrogatepass")) % BUCKETS


def _first_word(text: str) -> str:
    """The lower-cased first word; of scripts without spaces, the first characters."""
    m = _WORD.search(text[:64])
    if m is None:
        return ""
    w = m.group().rstrip(_FULL + _CLOSE + ",;:").casefold()
    if w and ord(w[0]) >= 0x0E00 and not ("가" <= w[0] <= "힣"):
        return w[:2] if ord(w[0]) >= 0x2E80 else w[:4]
    return w


@dataclass
class Lexicon:
    """Log-odds of words, by bucket: to open a line rather than stand inside one, to close it with a period rather than go on."""

    opens: np.ndarray
    closes: np.ndarray
    _seen: dict[str, float] = field(default_factory=dict)
    _texts: dict[str, float] = field(default_factory=dict)

    def opening(self, word: str) -> float:
        if not word:
            return 0.0
        if (x := self._seen.get(word)) is None:
            if len(self._seen) > 1_000_000:
                self._seen.clear()
            x = self._seen[word] = float(self.opens[bucket(word)])
        return x

    def opening_text(self, text: str) -> float:
        """``opening`` of the first word of a text, looked up by the text."""
        if (x := self._texts.get(text)) is None:
            if len(self._texts) > 1_000_000:
                self._texts.clear()
            x = self._texts[text] = self.opening(_first_word(text))
        return x

    def closing(self, word: str) -> float:
        return float(self.closes[bucket(word)]) if word else 0.0


def word_counts(texts: list[str | None]) -> dict[tuple[int, int], int]:
    """(kind, bucket) -> count; kinds 0 opens a line, 1 stands inside, 2 closes a line, 3 has a period and goes on."""
    opens, inside, closes, goes_on = Counter(), Counter(), Counter(), Counter()
    for text in texts:
        for line in _LINE.findall(text or ""):
            m = _MARK.match(line)
            if m is not None:
                line = line[m.end() :]
            words = line.split()
            if not words:
                continue
            opens[line.lstrip()[:64]] += 1
            inside.update([b for a, b in zip(words, words[1:], strict=False) if a[-1].isalnum() or a[-1] == ","])
            if "." in line:
                if line != line.lower() and line != line.upper():
                    for a, b in zip(words, words[1:], strict=False):
                        if a[-1] == "." and a[-2:-1] not in ("", ".") and b[0].islower():
                            goes_on[a] += 1
                if len(words) > 1 and words[-1][-1] == "." and words[-1][-2:-1] not in ("", "."):
                    closes[words[-1]] += 1
    out: dict[tuple[int, int], int] = {}
    for kind, counts in enumerate((opens, inside, closes, goes_on)):
        for raw, n in counts.items():
            word = _first_word(raw) if kind < 2 else raw[:-1].lstrip(_CLOSE + "(„«").casefold()
            if word:
                key = (kind, bucket(word))
                out[key] = out.get(key, 0) + n
    return out


def lexicon(df: DataFrame, text: str) -> Lexicon:
    """Counted over all texts; at most 4 x BUCKETS sums come to the driver."""

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in source:
            found = word_counts(b.column(0).to_pylist())
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in found], pa.int32()), pa.array([w for _, w in found], pa.int32()), pa.array(list(found.values()), pa.int64())], names=["kind", "word", "n"])

    counts = np.zeros((4, BUCKETS))
    for kind, word, n in df.select(text).mapInArrow(run, "kind int, word int, n long").groupBy("kind", "word").agg(F.sum("n")).toLocalIterator():
        counts[kind, word] = n
    opens = np.clip(np.log((counts[0] + 0.5) / (counts[1] + 0.5) * (counts[1].sum() + 1) / (counts[0].sum() + 1)), -3, 3)
    closes = np.clip(np.log((counts[2] + 0.5) / (counts[3] + 0.5)), -3, 3)
    return Lexicon(opens * (counts[0] + counts[1] > 0), closes * (counts[2] + counts[3] > 0))


def matched_pairs(line: str) -> list[tuple[int, int]]:
    """(open, close) of quotations and brackets that close on the line."""
    out, stack = [], []
    for m in _QUOTES.finditer(line):
        i, c = m.start(), m.group()
        if c in "\"'":
            before, after = line[i - 1 : i], line[i + 1 : i + 2]
            held = next((k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == c), None)
            if held is not None and not (c == "'" and before.isalnum() and after.isalnum()) and (c == '"' or not before.isspace()):
                out.append((stack[held][1], i))
                del stack[held:]
            elif (not before or before.isspace() or before in "([{") and after and not after.isspace():
                stack.append((c, i))
        elif c in ")]}）］」』》】»”“’›":
            held = next((k for k in range(len(stack) - 1, -1, -1) if c in _PAIRS.get(stack[k][0], "")), None)
            if held is not None and not (c == "’" and line[i + 1 : i + 2].isalnum() and ord(line[i + 1]) < 0x500):
                out.append((stack[held][1], i))
                del stack[held:]
            elif c in "“":
                stack.append((c, i))
        else:
            stack.append((c, i))
    return out


def _after_mark(word: str) -> str:
    """What follows the last mark inside a word, where a space is missing after it."""
    if word.isalpha():
        return word
    word = _STRONG.split(word)[-1]
    head, dot, tail = word.rpartition(".")
    return tail if dot and len(head) >= 3 and head.isalpha() and (tail in NEVER or tail in BEFORE_NUMBER) else word


def _is_caseless(c: str) -> bool:
    return c.isalpha() and c.lower() == c.upper()


def _closing(line: str, spaces: list[int], mark: str, at: int, after: str, sloppy: bool, words: Lexicon, smile: bool, spaced: bool) -> float:
    """The score of an end whose mark begins at ``at`` and after which ``after`` goes on; spaces: where the line has them."""
    kind = mark.strip()
    nxt = after[:1]
    opener = _first_word(after)
    odds = 0.5 * words.opening(opener)
    digit, lower = nxt.isdigit(), nxt.islower()
    cjk_mark = any(c in "。！？｡．।॥؟۔" for c in kind)
    if kind.startswith("…") or (kind.startswith("..") and kind.strip(".…") == ""):
        if smile:
            return 3.0
        if not spaced:
            return 2.0 if nxt.isupper() and after[1:2].islower() and not sloppy else -6.0
        return 3.0 if (nxt.isupper() or nxt in "\"“„«¿¡'‘") and not sloppy else -4.0
    if cjk_mark:
        return 6.0
    if any(c in "!?" for c in kind):
        if not spaced:
            return 4.0 if nxt.isalpha() or nxt in "¿¡«“„\"" else -4.0
        if lower and not sloppy:
            return (2.0 if smile else -1.0) + odds
        return 6.0
    # a period
    k = bisect_left(spaces, at)
    start = spaces[k - 1] + 1 if k else 0
    word = _after_mark(line[start:at].lstrip("\"'“„«»”‘’(（[「『¿¡").casefold())
    prior = line[max(0, start - NEAR) : start].rstrip()
    prior = prior[prior.rfind(" ") + 1 :].casefold()
    if not spaced:
        if not nxt.isalpha() or "@" in line[start:at] or len(word) < 2:
            return 4.0 if nxt.isalpha() and _is_caseless(nxt) and len(word) >= 2 and not word[-1].isascii() else (4.0 if nxt and nxt in "¿¡«“„" else -8.0)
        if _is_caseless(nxt):
            return 3.0 if word[-1:].isascii() or "؀" <= word[-1:] <= "ۿ" else -2.0
        if word in NEVER or word in BEFORE_NUMBER or "." in word.strip(".0123456789"):
            return -6.0
        if nxt.isupper() and (after[1:2].islower() or after[1:2] in "'’ " or sloppy):
            return 4.0 + odds if not sloppy else -0.5 + 2 * odds
        return -1.5 + 2 * odds if sloppy and word[-1:].isalpha() and len(opener) > 1 else -8.0
    if smile:
        return 5.0
    unit = word in ("l", "g", "h", "m") and prior[-1:].isdigit()
    letter = len(word) == 1 and word.isalpha() and not unit
    if word in ("m", "m.") and prior in ("a.", "p."):
        return 4.0 if nxt.isupper() and not sloppy else 0.5 + odds
    if word in ("a", "p") and after[:2].casefold() == "m.":
        return -10.0
    if word in BEFORE_NUMBER and (digit or nxt == "." or (word in ("no", "nr") and _MODEL.match(after))):
        return -10.0
    if word in BEFORE_NUMBER and (letter or word in ("fig", "vol", "pp", "pág", "núm", "ver", "bj", "ext")):
        return -6.0
    if word in NEVER:
        return -10.0
    if nxt == "." or (letter and word.isascii() and (len(opener) == 1 or after[1:2] == ".")):
        return -8.0
    if word.replace(".", "").replace(",", "").isdigit():
        if lower and not sloppy:
            return -8.0
        whole = word.isdigit()
        if whole and len(word) <= 2 and (opener in MONTHS_AND_FLOORS or prior in ("am", "vom", "bis", "zum")):
            return -8.0
        if _DATE.fullmatch(word) and opener in ("and", "und", "et", "y", "of", "the"):
            return -8.0
        if whole and len(word) <= 2 and prior in ("(", ""):
            return -2.0
        return 4.0 + odds
    if letter or unit or word in SOMETIMES or ("." in word and not any(c.isdigit() for c in word)):
        if nxt.isupper() and not sloppy:
            if _CAPITALS.match(after) and len(opener) == 2:
                return -4.0
            return (3.0 if not letter else -1.5) + 1.5 * odds + 0.3 * words.closing(word)
        if nxt in "\"“„«¿¡'‘(":
            return 1.0
        if _is_caseless(nxt):
            return 1.0 + odds
        if lower and not sloppy:
            return -8.0
        often = word in ("etc", "usw", "cm", "mm", "kg", "km")
        return (-0.3 if often else -1.0) + 1.5 * odds + 0.5 * words.closing(word) if not digit else -3.0
    if lower and not sloppy:
        return -5.0 + odds
    return 5.0 + 0.5 * odds


def _ends_of(line: str, skip: int, pairs: list[tuple[int, int]], words: Lexicon) -> list[tuple[int, float, int]]:
    """(end, score, open of the quotation it closes or -1) of every place where a sentence could end."""
    ends: list[tuple[int, float, int]] = []
    closer = {c: o for o, c in pairs}
    opener = {o for o, _ in pairs}
    spaces: list[int] | None = None
    for e in _ENDS.finditer(line, skip):
        (_, end), (at, stop) = e.regs[:2]
        if stop == at + 1 and end == stop:
            # the plain cases at once, with the scores that _closing gives them
            c = line[at]
            if c in "。！？।॥؟۔":
                if _SOLID.search(line, end):
                    ends.append((end, 6.0, -1))
                continue
            if line[end : end + 1] == " " and line[end + 1 : end + 2].isupper() and line[end + 2 : end + 3].islower():
                if c in "!?":
                    ends.append((end, 6.0, -1))
                    continue
                if c == ".":
                    if spaces is None:
                        spaces = [m.start() for m in _SPACE.finditer(line)]
                    k = bisect_left(spaces, at)
                    word = line[spaces[k - 1] + 1 if k else 0 : at]
                    if len(word) > 2 and word.isalpha() and word.casefold() not in _SHORT:
                        stop = spaces[k + 1] if k + 1 < len(spaces) else len(line)
                        ends.append((end, 5.0 + 0.25 * words.opening_text(line[end + 1 : min(stop, end + 65)]), -1))
                        continue
        close = e.group("close")
        # closing marks that open a quotation belong to what follows
        took = 0
        for i, c in enumerate(close):
            if stop + i in closer or (c in ")]}」』”’»" and stop + i not in opener):
                took = i + 1
            else:
                break
        whole = took == len(close)
        end = e.end() if whole else stop + took
        face = e.group("smile") if whole else ""
        smile = bool(face)
        if smile and end == len(line):
            continue
        solid = _SOLID.search(line, end)
        if solid is None:
            continue
        after = line[solid.start() : solid.start() + NEAR]
        spaced = solid.start() > end or (smile and not face.isspace())
        near = line[max(0, end - 60) : at]
        if len(near) <= 12:
            near += line[at : at + 60]
        low, up = near.lower(), near.upper()
        sloppy = low != up and (near == low or near == up) and len(near) > 12
        if sloppy and near == low and after[:1].isupper():
            sloppy = False
        if sloppy and near == up and after[:1].isupper() and after[1:2].islower():
            sloppy = False
        if spaces is None:
            spaces = [m.start() for m in _SPACE.finditer(line)]
        score = _closing(line, spaces, e.group("mark"), at, after, sloppy, words, smile, spaced)
        opened = -1
        for i in range(took):
            opened = max(opened, closer.get(stop + i, -1)) if opened >= 0 else closer.get(stop + i, -1)
        if opened >= 0:
            if after[0] in "“„«\"‘「'" or after[0] in ",;:，、；：":
                score = -8.0
            elif after[0].islower() and not sloppy:
                score = min(score, -6.0)
            elif sloppy or _is_caseless(after[0]):
                score = min(score, words.opening(_first_word(after)) - 1.0)
        ends.append((end, score, opened))
    if _THAI_CLOSE.search(line, skip):
        for e in _THAI.finditer(line, skip):
            if _SOLID.search(line, e.end()):
                ends.append((e.end(), 5.0, -1))
    if _SHOWY.search(line, skip):
        taken = {x for x, _, _ in ends}
        for e in _ALONE.finditer(line, skip):
            solid = _SOLID.search(line, e.end())
            if solid and e.end() not in taken and ((c := solid.group()).isupper() or _is_caseless(c) or c in "¿¡“«„\""):
                ends.append((e.end(), 1.5, -1))
    ends.sort()
    return ends


class _Best:
    """Values by rising number; the first greatest one from a number on."""

    def __init__(self) -> None:
        self.at: list[int] = []
        self.value: list[float] = []

    def add(self, i: int, value: float) -> None:
        while self.value and self.value[-1] < value:
            self.value.pop()
            self.at.pop()
        self.value.append(value)
        self.at.append(i)

    def since(self, i: int) -> tuple[float, int]:
        k = bisect_left(self.at, i)
        return (self.value[k], -self.at[k]) if k < len(self.at) else (-1e18, 0)


def best_spans(cuts: list[int], firsts: list[int], score: list[float], quote: list[int]) -> list[int]:
    """The numbers of the cuts, from 1, that end the spans whose scores add up to most; on ties the longer last span.

    cuts: 0, the ends and the end of the line; firsts: the first character of a
    span that begins there; score: of an end, with what it cuts through; quote: the
    quotation that an end closes.  A span's score is that of its end, less what its
    length costs and, if it closes a quotation that it holds the beginning of, ``CUT``.
    The starts within ``LONG`` characters and those before are two lists in which
    the best one from a place on is found by bisection.
    """
    n = len(cuts)
    near, far = _Best(), _Best()  # starts with spans up to LONG characters, and longer ones with their length's cost
    top: list[tuple[float, int]] = []  # of the longer ones, the best up to each
    best, back = [0.0] * n, [0] * n
    passed = 0
    for j in range(1, n):
        near.add(j - 1, best[j - 1])
        while passed < j and cuts[j] - firsts[passed] > LONG:
            value = best[passed] + BEYOND * firsts[passed]
            far.add(passed, value)
            top.append(max(top[-1], (value, -passed)) if top else (value, -passed))
            passed += 1
        # starts of spans of a character at most; there are few, as starts are apart
        tiny = j
        while tiny > passed and cuts[j] - firsts[tiny - 1] <= 1:
            tiny -= 1
        held = bisect_left(firsts, quote[j], 0, j) if quote[j] >= 0 else 0  # starts before it hold the quotation's beginning
        cost = -BEYOND * (cuts[j] - LONG)
        found = [(best[i] - TINY - (CUT if i < held else 0.0), -i) for i in range(tiny, j)]
        if passed < tiny:
            v, i = near.since(passed) if tiny == j else max(((best[i], -i) for i in range(passed, tiny)), default=(-1e18, 0))
            found.append((v - (CUT if -i < held else 0.0), i))
            if passed < held < tiny:
                v, i = near.since(held) if tiny == j else max((best[i], -i) for i in range(held, tiny))
                found.append((v, i))
        if passed:
            v, i = top[passed - 1]
            found.append((v + cost - (CUT if -i < held else 0.0), i))
            if 0 < held < passed:
                v, i = far.since(held)
                found.append((v + cost, i))
        v, i = max(found)
        best[j], back[j] = v + score[j], -i
    out, j = [], n - 1
    while j:
        out.append(j)
        j = back[j]
    return out[::-1]


def sentences(text: str, words: Lexicon) -> list[tuple[int, int]]:
    """(first, last) character of every sentence, from 1, without the space around it."""
    out: list[tuple[int, int]] = []
    for m in _LINE.finditer(text):
        line, base = m.group(), m.start()
        if not line.strip():
            continue
        mark = _MARK.match(line)
        skip = mark.end() if mark is not None and mark.end() < len(line) else 0
        pairs = matched_pairs(line)
        ends = _ends_of(line, skip, pairs, words)
        cuts = [0, *(x for x, _, _ in ends), len(line)]
        firsts = [f.start() if (f := _SOLID.search(line, c)) else len(line) for c in cuts]
        ended = [k for k in range(1, len(cuts) - 1) if ends[k - 1][1] > 0] + [len(cuts) - 1]
        plain = not pairs and all(1 < cuts[b] - firsts[a] <= LONG for a, b in zip([0, *ended], ended, strict=False))
        if not plain:  # else every good end is one, as no span costs anything
            crossed = [0] * (len(cuts) + 1)
            for o, c in pairs:
                crossed[bisect_right(cuts, o)] += 1
                crossed[bisect_right(cuts, c)] -= 1
            score, deep = [0.0] * len(cuts), crossed[0]
            for k in range(1, len(cuts) - 1):
                deep += crossed[k]
                score[k] = ends[k - 1][1] - CUT * deep
            ended = best_spans(cuts, firsts, score, [-1, *(q for _, _, q in ends), -1])
        for a, b in zip([0, *ended], ended, strict=False):
            last = cuts[b]
            while last > firsts[a] and line[last - 1].isspace():
                last -= 1
            if last > firsts[a]:
                out.append((base + firsts[a] + 1, base + last))
    return out


def sentence_units(df: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc``, ``sentence`` (number from 1), ``sent_start``, ``sent_end``, ``sentence_text`` of every sentence of every row."""
    base = df.select(F.col(doc).alias("_doc"), F.col(text).alias("_text")).filter(F.col("_text").isNotNull())
    words = lexicon(base, "_text")

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in source:
            texts = b.column(1).to_pylist()
            found = [sentences(t, words) for t in texts]
            row = np.repeat(np.arange(len(found)), [len(f) for f in found])
            flat = np.array([s for f in found for s in f], np.int64).reshape(-1, 2)
            number = np.array([i + 1 for f in found for i in range(len(f))], np.int32)
            parts = pa.array([t[x - 1 : y] for t, f in zip(texts, found, strict=True) for x, y in f], pa.string())
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(row, pa.int64())), pa.array(number), pa.array(flat[:, 0]), pa.array(flat[:, 1]), parts], names=["_doc", "sentence", "sent_start", "sent_end", "sentence_text"])

    kind = base.schema["_doc"].dataType.simpleString()
    return spread(base).mapInArrow(run, f"_doc {kind}, sentence int, sent_start long, sent_end long, sentence_text string").withColumnRenamed("_doc", doc)
