"""Sentence boundaries across languages and scripts.

A markdown cell is first cut into blocks (paragraph, heading, list item, quoted lines); fenced code,
displayed formulas, tables and embedded images hold no sentences. Within a block line breaks count as
spaces, and quotations and brackets are paired, so that nothing inside a pair ends the sentence
around it.

Spaced scripts: every run of terminators is a node of a lattice. Each of its readings (end of the sentence, decimal or name,
abbreviation, initial, ordinal, ellipsis, part of a quotation) has a cost by the token before it, the closing marks after it and how the
next token begins; a sentence that a path cuts out has a cost too (no word in it, an unpaired mark of emphasis). The cheapest
path gives the sentences, so a place that is unclear by itself is decided by what stands around it.

Spaceless scripts (``lexicon``): text beside a gap is read through a lattice of dictionary words; the score of the gap adds up the
closing particle before it, the opening word after it and a word that it would break over a prior for its kind. A
space beside a digit or Latin letter never ends a sentence.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Callable, Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowloom.llm.lexicon import ELLIPSIS, QUOTATION, REACH, SPACE, VOCABULARY, Lexicon
from flowloom.llm.plain import SPACELESS_CHAR

# Abbreviations without their last stop, in lower case.
#: A name or a figure follows; the stop is never an end.
NEVER = frozenset(
    "dr prof mr mrs ms messrs mme mlle st sr sra srta dra lic ing gen col capt lt sgt rev hon "
    "cf vs approx ca circa e.g i.e eg ie viz esp resp incl excl "
    "fig figs tab sect sec eq eqs ch vol pp par art ref refs ed eds "
    "vgl abb nr bzw evtl ggf inkl zzgl abs kap tel bd sog z.b d.h u.a z.t "
    "env ex p.ex av apr "
    "aprox núm pág págs p.ej ej cap "
    "рис см ок гл табл напр проф акад им ул стр с "
    "د أ م "
    "डॉ श्री प्रो पृ सं क्र".split()
)
#: May stand at the end of a sentence.
MAY_END = frozenset("etc al suiv usw usf ff a.m p.m jr inc ltd corp co bros др пр".split())
#: Single letters that may stand at the end of a sentence (as in и т. д., т. п., 2016 г.).
LETTERS_MAY_END = frozenset("дгп")
#: Words before a German ordinal.
BEFORE_ORDINAL = frozenset("am im der die das dem den des vom zum zur beim ab bis seit jeder jede jedes jedem jeden ein eine einem einer und".split())
#: Costs of evidence: settles a place, speaks for a reading, tips a balance.
SURE, LIKELY, SLIGHT = 8.0, 3.0, 1.0
#: Costs of sentences: without a word of two letters, with an unpaired mark of emphasis.
WORDLESS, UNPAIRED = 2.0, 2.0
#: Paths dearer than the best by more than this are given up; it is less than what is sure.
GIVEN_UP = 7.5

_FENCE = re.compile(r"[ \t]*(?:>[ \t]?)*[ \t]*(`{3,}|~{3,})")
_HEADING = re.compile(r"(#{1,6})(?:[ \t]+|$)")
_CLOSING_HASHES = re.compile(r"[ \t]+#+[ \t]*$")
_BULLET = re.compile(r"[-+*•](?:[ \t]+(?:\[[ xX]\][ \t]+)?)(?=\S)")
_NUMBER = re.compile(r"(\d{1,9})[.)][ \t]+(?=\S)")
_RULE = re.compile(r"(?:-[ \t]*){3,}$|(?:\*[ \t]*){3,}$|(?:_[ \t]*){3,}$|=+[ \t]*$")
_TABLE_RULE = re.compile(r"\|?[ \t]*:?-{2,}:?[ \t]*(?:\|[ \t]*:?-{2,}:?[ \t]*)*\|?[ \t]*$")
_QUOTE_MARK = re.compile(r"(?:[ \t]{0,3}>)+[ \t]?")
_IMAGE = re.compile(r"!\[[^\]\n]*\]\((?:[^()\s]|\([^()\s]*\))*(?:\s+\"[^\"]*\")?\)?|<img\b[^>]*>")
_COMMENT = re.compile(r"<!--.*?-->|</?(?:a|b|br|center|code|div|em|font|i|p|small|span|strong|sub|sup|u)(?:\s[^<>]*)?/?>", re.I | re.S)
_LITERAL = re.compile(r"(`+)(?!`).*?(?<!`)\1(?!`)|(?<![\\$\w])\$(?=[^\s$])[^$\n]*?(?<=[^\s\\])\$(?![\w$])|\]\([^()\s]*\)|https?://[^\s)>\]]*[^\s)>\].,;:!?\"'”’»]", re.S)
_DELIMITER = re.compile(r"[()\[\]{}（）【】《》「」『』«»‹›“”„‘’'\"]")
_TERMINATOR = re.compile(r"[.!?…‥。！？｡．؟۔।॥]+(?:[  ]?[!?]+)?")
_CLOSERS = re.compile(r"[\"'”’»›)\]}）】》」』]*")
_NEXT = re.compile(r"\s*([*_~\"'“”„«»‹‘「『（(\[{¿¡<`$]*)[  ]?")
_CODE_LIKE = re.compile(r"[A-Za-z_]\w*(?:\.\w+|_\w+)*\(|[A-Za-z_]\w*\.[A-Za-z_]\w*|[a-z]\w*_\w+|x{2,}`")
_TOKEN = re.compile(r"[^\s(\[{（\"“„«'‘「*_~`]*$")
_PATH = re.compile(r"[/\\@_]|[a-z]\.[a-z]")
_VOWEL = re.compile(r"[aeiouy]")
_LOWER = re.compile(r"\w+")
_NAME = re.compile(r"\b([a-z]\w+)\.\w+\(|\bimport ([a-z]\w+)")
_WORD_BEFORE = re.compile(r"([^\W\d_]+)[  ]+\d+$")
_PAIRS = {")": "(", "]": "[", "}": "{", "）": "（", "】": "【", "》": "《", "」": "「", "』": "『", "»": "«", "›": "‹"}
_BRACKETS = "([{（【"
_STRONG = "。！？｡"
_THAI = re.compile("[฀-๿]")
_TWO_LETTERS = re.compile(r"[^\W\d_]{2}|[\u0e00-\u0e7f\u3040-\u9fff]")
_GAP = re.compile(r"\s+")


def blocks(cell: str) -> Iterator[tuple[list[tuple[int, int]], bool]]:
    """Blocks of prose of a cell: the parts of their lines, and whether the block is a heading."""
    parts: list[tuple[int, int]] = []
    fence = math = ""
    listed, number, table = False, 0, False
    lines, at = [], 0
    for line in cell.split("\n"):
        lines.append((at, line))
        at += len(line) + 1
    for k, (at, line) in enumerate(lines):
        if fence:
            if (m := _FENCE.match(line)) and m.group(1).startswith(fence) and not line[m.end() :].strip():
                fence = ""
            continue
        if math:
            if math in line:
                math = ""
            continue
        start = at
        if ">" in line[:8] and (q := _QUOTE_MARK.match(line)):
            start += q.end()
        body = line[start - at :]
        indent = len(body) - len(body.lstrip())
        start, body = start + indent, body.strip()
        end = start + len(body)
        if not body:
            if parts:
                yield parts, False
            parts, table = [], False
            listed = listed and bool(k + 1 < len(lines) and lines[k + 1][1].strip())
            continue
        first = body[0]
        if first in "`~" and (m := _FENCE.match(body)) and not (m.group(1)[0] == "`" and "`" in body[m.end() :]):
            if parts:
                yield parts, False
            parts, fence = [], m.group(1)
            continue
        if first in "$\\" and (body.startswith("$$") or body.startswith("\\[") or body.startswith("\\begin{")):
            if parts:
                yield parts, False
            parts = []
            mark = "$$" if first == "$" else "\\]" if body[1] == "[" else "\\end{"
            if mark not in body[2:]:
                math = mark
            continue
        ruled = "-" in body and "|" in body and _TABLE_RULE.match(body)
        if table and "|" in body or first == "|" or ruled or ("|" in body and k + 1 < len(lines) and "-" in lines[k + 1][1] and "|" in lines[k + 1][1] and _TABLE_RULE.match(lines[k + 1][1].strip())):
            if parts:
                yield parts, False
            parts, table = [], True
            continue
        table = False
        if first == "#" and (m := _HEADING.match(body)):
            if parts:
                yield parts, False
            parts, listed = [], False
            a = start + m.end()
            b = end - (len(c.group()) if (c := _CLOSING_HASHES.search(body, m.end())) else 0)
            if a < b:
                yield [(a, b)], True
            continue
        if first in "-*_=" and _RULE.match(body):
            if parts:
                yield parts, first in "-="
            parts = []
            continue
        if m := _BULLET.match(body):
            if parts:
                yield parts, False
            parts, listed, number = [(start + m.end(), end)], True, 0
            continue
        if (m := _NUMBER.match(body)) and (not parts or listed) and (not parts or not number or int(m.group(1)) in (number + 1, number)):
            if parts:
                yield parts, False
            parts, listed, number = [(start + m.end(), end)], True, int(m.group(1))
            continue
        if not parts:
            listed = listed and indent > 0
        parts.append((start, end))
    if parts:
        yield parts, False


def _pairs(s: str) -> list[tuple[int, int]]:
    """Outermost paired quotations and brackets, in order."""
    open_: list[tuple[str, int]] = []
    found: list[tuple[int, int]] = []

    def close(kinds: str, at: int) -> bool:
        for n in range(len(open_) - 1, -1, -1):
            if open_[n][0] in kinds:
                found.append((open_[n][1], at))
                del open_[n:]
                return True
        return False

    for m in _DELIMITER.finditer(s):
        c, i = m.group(), m.start()
        if c in _PAIRS:
            close(_PAIRS[c], i)
        elif c == "“":
            if not (open_ and open_[-1][0] == "„" and close("„", i)):
                open_.append((c, i))
        elif c == "”":
            close("“„", i)
        elif c == "’":
            if not (i + 1 < len(s) and s[i + 1].isalnum()):
                close("‘", i)
        elif c == '"':
            if not close(c, i):
                open_.append((c, i))
        elif c == "'":
            after = s[i + 1] if i + 1 < len(s) else " "
            before = s[i - 1] if i else " "
            if not after.isalnum() and not before.isspace() and close(c, i):
                continue
            if (before.isspace() or before in "([{“\"*_") and not after.isspace():
                open_.append((c, i))
        else:
            open_.append((c, i))
    found.sort()
    outer: list[tuple[int, int]] = []
    for a, b in found:
        if not outer or a > outer[-1][1]:
            outer.append((a, b))
    return outer


def _kind(s: str, at: int) -> tuple[str, int, str]:
    """How the text from ``at`` on begins: (upper, lower, code, digit, caseless, other or end), place, opening marks."""
    m = _NEXT.match(s, at)
    i = m.end()
    if i >= len(s):
        return "end", i, m.group(1)
    c = s[i]
    if c.isalpha():
        if c.islower():
            return ("code" if "`" in m.group(1) or _CODE_LIKE.match(s, i) else "lower"), i, m.group(1)
        return ("upper" if c.isupper() or c.istitle() else "caseless"), i, m.group(1)
    if c.isdigit():
        return "digit", i, m.group(1)
    return "other", i, m.group(1)


def code_names(text: str) -> frozenset[str]:
    """Names that a document's code calls or imports; a sentence may begin with one in lower case."""
    return frozenset(x for pair in _NAME.findall(text) for x in pair if x)


def _full_stop(s: str, start: int, i: int, k: int, names: Callable[[], frozenset[str]]) -> dict[str, float]:
    """Readings of a single full stop at i, with closing marks up to k, in the sentence from ``start`` on."""
    before = s[i - 1] if i else " "
    if before.isspace():
        return {"mark": 0.0}
    kind, at, _ = _kind(s, k)
    if kind == "end":
        return {"end": 0.0}
    token = _TOKEN.search(s, max(start, i - 40), i).group()
    low = token.lower()
    if not s[k].isspace():
        if kind == "caseless":
            ends = not before.isascii() and not before.isdigit() and low not in NEVER and len(low) > 1
            return {"end": 0.0, "name": LIKELY} if ends else {"name": 0.0, "end": SURE}
        if kind != "upper" or _PATH.search(token):
            return {"decimal": 0.0, "end": SURE}
        if len(token) == 1 and before.isupper():
            return {"initial": 0.0, "end": SURE}
        if at + 1 < len(s) and s[at + 1] in ".)":
            return {"end": 0.0, "initial": LIKELY} if before.islower() and len(token) > 2 else {"initial": 0.0, "end": LIKELY}
        if low.isascii() and low.isalpha() and not _VOWEL.search(low):  # a short name as in code
            return {"name": 0.0, "end": LIKELY}
        ends = low not in NEVER and (before.islower() or before.isdigit() or not before.isalnum())
        return {"end": 0.0, "name": LIKELY} if ends else {"abbreviation": 0.0, "end": SURE}
    if len(token) == 1 and token.isalpha():
        ends = low in LETTERS_MAY_END and before.islower() and kind in ("upper", "caseless", "code")
        return {"end": 0.0, "initial": SLIGHT} if ends else {"initial": 0.0, "end": LIKELY}
    if low in NEVER:
        return {"abbreviation": 0.0, "end": SURE}
    if low == "no" or low in MAY_END:
        ends = kind in ("upper", "caseless", "code") or low != "no" and kind == "lower" and _LOWER.match(s, at).group() in names()
        return {"end": 0.0, "abbreviation": SLIGHT} if ends else {"abbreviation": 0.0, "end": SURE}
    if len(low) < 8 and re.fullmatch(r"(?:[^\W\d_]\.)+[^\W\d_]", low):
        return {"abbreviation": 0.0, "end": LIKELY}
    if kind == "other":
        return {"mark": 0.0, "end": SURE}
    if kind == "lower":  # a whole word before it, or a closing mark
        whole = (len(token) > 2 and before.isalpha() or before in "()[]{}\"'”’»x`%*") and not token.isdigit()
        return {"end": 0.0, "abbreviation": LIKELY} if whole else {"abbreviation": 0.0, "end": LIKELY}
    if token.isdigit() and len(token) < 3 and kind == "upper":
        m = _WORD_BEFORE.search(s, max(0, i - 40), i)
        return {"ordinal": 0.0, "end": LIKELY} if m and m.group(1).lower() in BEFORE_ORDINAL else {"end": 0.0, "ordinal": LIKELY}
    return {"end": 0.0, "mark": SURE}


def _run(s: str, start: int, i: int, j: int, k: int, names: Callable[[], frozenset[str]], lexicon: Callable[[], Lexicon]) -> dict[str, float]:
    """Readings of the run of terminators s[i:j], with closing marks up to k, in the sentence from ``start`` on."""
    run = s[i:j]
    if run == ".":
        return _full_stop(s, start, i, k, names)
    kind, at, _ = _kind(s, k)
    if kind == "end":
        return {"end": 0.0}
    spaced = s[k].isspace()
    if run == "．":
        return {"decimal": 0.0, "end": SURE} if i and s[i - 1].isdigit() and kind == "digit" and not spaced else {"end": 0.0, "mark": SURE}
    if any(c in _STRONG for c in run) or "।" in run or "॥" in run:
        return {"end": 0.0, "mark": SURE} if kind != "other" else {"mark": 0.0, "end": SURE}
    if not run.strip(".…‥"):
        if spaced and kind == "upper":
            return {"end": 0.0, "ellipsis": LIKELY}
        if kind == "caseless" and i and SPACELESS_CHAR.match(s, i - 1) and SPACELESS_CHAR.match(s, at):
            score = lexicon().gap_score(s[max(start, i - REACH) : i], s[at : at + REACH], ELLIPSIS)
            return {"end": 0.0, "ellipsis": score * LIKELY} if score > 0 else {"ellipsis": 0.0, "end": SURE}
        return {"ellipsis": 0.0, "end": SURE}
    if spaced and kind != "other" or kind in ("upper", "caseless"):
        return {"end": 0.0, "mark": SURE}
    return {"mark": 0.0, "end": SURE}


def _quoted(s: str, start: int, pair: tuple[int, int], k: int, lexicon: Callable[[], Lexicon]) -> dict[str, float]:
    """Readings of the end of a quotation or bracket that closes right after a terminator, with closing marks up to k."""
    a, b = pair
    kind, at, _ = _kind(s, k)
    opening = not s[start:a].strip(" *_~ \"'“„«¿¡")
    if kind == "end":
        return {"end": 0.0}
    if kind in ("lower", "other", "digit"):
        ends = False
    elif s[a] in _BRACKETS:
        ends = opening
    elif kind == "caseless":
        ends = not opening and s[start:a].rstrip()[-1:] in (":", "：")
        if not ends and SPACELESS_CHAR.match(s, at):
            ends = lexicon().gap_score(s[max(start, b - REACH) : b].rstrip("。！？!?｡"), s[at : at + REACH], QUOTATION) > 0
    else:
        ends = kind == "upper" or k < len(s) and s[k].isspace()
    return {"end": 0.0, "quotation": SURE} if ends else {"quotation": 0.0, "end": SURE}


def _sentence_cost(s: str, a: int, b: int, marked: bool) -> float:
    """What a sentence s[a:b] costs a path."""
    cost = 0.0 if _TWO_LETTERS.search(s, a, b) else WORDLESS
    if marked and s.count("**", a, b) % 2:
        cost += UNPAIRED
    return cost


def _spaceless_gaps(s: str, lexicon: Callable[[], Lexicon], breaks: frozenset[int]) -> Iterator[tuple[int, int]]:
    for m in _GAP.finditer(s):
        a, b = m.span()
        if not a or b >= len(s):
            continue
        x, y = s[a - 1], s[b]
        if (x.isascii() and x.isalnum()) or (y.isascii() and y.isalnum()) or x.isdigit() or y.isdigit() or x.isalpha() and "LATIN" in _script(x) or y.isalpha() and "LATIN" in _script(y):
            continue
        if (_THAI.match(x) or _THAI.match(y)) and lexicon().gap_score(s[max(0, a - REACH) : a], s[b : b + REACH], SPACE, a in breaks) > 0:
            yield a, b


def _script(c: str) -> str:
    import unicodedata

    return unicodedata.name(c, "")


def split_block(s: str, names: Callable[[], frozenset[str]] = frozenset, lexicon: Callable[[], Lexicon] = cache(Lexicon), breaks: frozenset[int] = frozenset()) -> list[tuple[int, int]]:
    """Sentences of a block whose line breaks and marks are spaces already; breaks: where its lines but the last ended."""
    if "`" in s or "$" in s or "](" in s or "://" in s:
        s = _LITERAL.sub(lambda m: m.group()[0] + "x" * (len(m.group()) - 2) + m.group()[-1], s)
    pairs = _pairs(s)
    opens = [a for a, _ in pairs]
    marked = "**" in s
    # paths: cost so far, start of the open sentence, its ends as a linked list
    paths: list[tuple[float, int, tuple | None]] = [(0.0, 0, None)]

    for m in _TERMINATOR.finditer(s):
        i, j = m.span()
        n = bisect_right(opens, i) - 1
        around = pairs[n] if n >= 0 and pairs[n][1] > i else None
        if around is not None and s[j : around[1]].strip("\"'”’»›)]}）】》」』*_~  "):
            continue
        on: list[tuple[float, int, tuple | None]] = []
        ended: dict[int, tuple[float, int, tuple | None]] = {}
        for cost, start, ends in paths:
            if i < start:
                on.append((cost, start, ends))
                continue
            if around is None:
                k = _CLOSERS.match(s, j).end()
                if k < len(s) and s[k] in "*_~":
                    mark = re.match(r"[*_~]+", s[k:]).group()
                    if s.count(mark, start, k) % 2:
                        k = _CLOSERS.match(s, k + len(mark)).end()
                if n + 1 < len(opens) and opens[n + 1] < k:  # the mark opens the next quotation
                    k = max(j, opens[n + 1])
                readings = _run(s, start, i, j, k, names, lexicon)
            else:
                k = around[1] + 1
                while k < len(s) and (c := _CLOSERS.match(s, k)).end() > k and not (n + 1 < len(opens) and opens[n + 1] < c.end()):
                    k = c.end()
                if k < len(s) and s[k] in "*_~" and s.count(s[k], start, k) % 2:
                    k = re.match(r"[*_~]+", s[k:]).end() + k
                readings = _quoted(s, start, around, k, lexicon)
            for reading, more in readings.items():
                if reading != "end":
                    on.append((cost + more, start, ends))
                else:
                    total = cost + more + _sentence_cost(s, start, k, marked)
                    if k not in ended or total < ended[k][0]:
                        ended[k] = (total, k, (k, ends))
        paths = [*ended.values(), *on]
        if len(paths) > 1:
            best = min(p[0] for p in paths) + GIVEN_UP
            paths = [p for p in paths if p[0] <= best]
    tail = lambda p: _sentence_cost(s, p[1], len(s), marked) if s[p[1] :].strip() else 0.0
    link = min(paths, key=lambda p: p[0] + tail(p))[2] if len(paths) > 1 else paths[0][2]
    ends = []
    while link:
        ends.append(link[0])
        link = link[1]
    ends.reverse()
    if _THAI.search(s):
        for a, b in _spaceless_gaps(s, lexicon, breaks):
            n = bisect_right(opens, a) - 1
            if n < 0 or pairs[n][1] < a:
                ends.append(a)
        ends = sorted(set(ends))
    out, a = [], 0
    for b in [*ends, len(s)]:
        part = s[a:b]
        text = part.strip()
        if text and any(c.isalnum() for c in text):
            lead = len(part) - len(part.lstrip())
            out.append((a + lead, a + lead + len(text)))
            a = b
        elif text and out:  # marks alone belong to the sentence before
            out[-1] = (out[-1][0], a + len(part.rstrip()))
            a = b
    return out


def sentence_spans(cell: str | None, names: Callable[[], frozenset[str]] = frozenset, lexicon: Callable[[], Lexicon] = cache(Lexicon)) -> list[tuple[int, int]]:
    """(start, end) of the sentences of a markdown cell, in code points of the cell. names: gives the names
    that the document's code uses, lexicon its words of spaceless scripts; both are asked for only where they decide."""
    if not cell:
        return []
    if "\r" in cell:
        cell = cell.replace("\r\n", " \n").replace("\r", "\n")
    if "![" in cell or "<" in cell:
        blank = lambda m: re.sub(r"[^\n]", " ", m.group())
        cell = _COMMENT.sub(blank, _IMAGE.sub(blank, cell))
    out = []
    for parts, heading in blocks(cell):
        first, last = parts[0][0], parts[-1][1]
        if heading:
            s = cell[first:last]
            if (text := s.strip()) and any(c.isalnum() for c in text):
                lead = len(s) - len(s.lstrip())
                out.append((first + lead, first + lead + len(text)))
            continue
        breaks = frozenset(b - first for _, b in parts[:-1])
        if len(parts) == 1:
            s = cell[first:last]
        else:
            s, at = "", first
            for a, b in parts:
                s += " " * (a - at) + cell[a:b]
                at = b
        out += [(first + a, first + b) for a, b in split_block(s, names, lexicon, breaks)]
    return out


def thai_words(text: Column) -> Column:
    """The different words of a text's Thai parts by the JVM's Thai dictionary; NULL for texts without any."""
    parts = F.regexp_replace(text, "[^\u0e00-\u0e7f]+", " ")
    return F.when(text.rlike("[\u0e00-\u0e7f]{2}"), F.array_distinct(F.flatten(F.sentences(parts, F.lit("th"), F.lit("TH")))))


def document_sentences(documents: DataFrame, *, doc_id: str = "doc_id", text: str = "text", cells: str = "cells", kind: str = "markdown", vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, start_char, end_char) of every sentence in the document's cells of the kind.

    NULL and empty texts and NULL cell lists have no sentences; a cell that is NULL or has NULL places
    is left out; places beyond the text are cut to it. Nothing is shuffled; a document is split in one
    piece, so memory follows the largest document. Repeated doc_ids give their sentences each time.
    vocabulary: a rank file that all executors can read, for words of spaceless scripts; without it particles and, in
    Thai, the JVM's dictionary are what is left.
    """
    of_kind = F.filter(documents[cells], lambda c: c["kind"].eqNullSafe(kind) & c["start_char"].isNotNull() & c["end_char"].isNotNull())
    src = documents.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.transform(of_kind, lambda c: c["start_char"]).alias("a"), F.transform(of_kind, lambda c: c["end_char"]).alias("b"), thai_words(F.col(text)).alias("words")).filter((F.col("text") != "") & (F.size("a") > 0))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, 512):
                part = batch.slice(first, 512)
                row: list[int] = []
                start: list[int] = []
                end: list[int] = []
                for n, (whole, starts, stops, own) in enumerate(zip(*(part.column(k).to_pylist() for k in (1, 2, 3, 4)))):
                    names = cache(lambda whole=whole: code_names(whole))
                    lexicon = cache(lambda own=own: Lexicon(own or (), vocabulary))
                    for a, b in zip(starts, stops):
                        a = max(a, 0)
                        for x, y in sentence_spans(whole[a : max(b, a)], names, lexicon):
                            row.append(n)
                            start.append(a + x)
                            end.append(a + y)
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(row, pa.int64())), pa.array(start, pa.int32()), pa.array(end, pa.int32())], names=["doc_id", "start_char", "end_char"])

    return src.mapInArrow(run, f"doc_id {dict(documents.dtypes)[doc_id]}, start_char int, end_char int")
