"""Words of scripts without spaces: dictionaries, the lattice that reads a text as words, and the gaps between texts.

A text is read along the cheapest path through the lattice of all dictionary words in it; a character that no word
covers stands alone and costs most. Words come from three places: particles and opening words (fixed values below),
the multi-character entries of a public tokenizer's rank file, and, for a document, words that the
caller's own dictionary found in it (the JVM's Thai dictionary in ``sentences``).

A gap is a place where a sentence may end: a space, an ellipsis, the end of a quotation. Its score adds up a prior for its kind
and the evidence of the words beside it; above 0 it ends the sentence.
"""

from __future__ import annotations

import base64
import math
import os
import re
from collections.abc import Iterable
from functools import lru_cache

from flowloom.llm.plain import SPACELESS_CHAR

VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"

# Particles that close a sentence, words that open one, words that carry one on.
CLOSING = frozenset(
    "ครับ ค่ะ คะ นะ จ้ะ จ๊ะ สิ เถอะ แล้ว ด้วย เลย หรือไม่ ไหม มั้ย นี้ นั้น "
    "か ね よ です ます ました ません でした でしょう だ だった した ない たい なさい ください "
    "吗 呢 吧 啊 呀 嘛 啦 哦 了".split()
)
OPENING = frozenset(
    "แต่ และ หรือ เพราะ ดังนั้น อย่างไรก็ตาม นอกจากนี้ ทำไม เมื่อ ถ้า หาก เรา ผม ฉัน คุณ เขา เธอ มัน พวกเขา ขณะที่ จากนั้น ต่อมา สุดท้าย ก่อนอื่น เปิด "
    "しかし ただし そして また なぜ でも だから つまり まず 次に そこで それから さらに 一方 なお では "
    "但是 但 然而 因此 所以 不过 另外 此外 接着 然后 最后 首先 为什么 如果 因为 而且 于是".split()
)
CARRYING = frozenset("ที่ ซึ่ง อัน と って という は が を に へ で の も 的 地 得".split())
REPEATED = ("ๆ", "ฯ")

PARTICLE_COST, OWN_COST, UNKNOWN_COST = 3.0, 4.0, 14.0
#: Priors: a space of a script without sentence marks, an ellipsis, a quotation that ends with a mark.
SPACE, ELLIPSIS, QUOTATION = 2.0, -1.5, -1.5
#: Evidence.
CLOSES, OPENS, CARRIES, REPEATS, BROKEN_WORD = 1.0, 1.0, -1.5, -8.0, -8.0
#: How much cheaper a path over a line break must be, and how long the word over it, for a word that the break cuts.
BROKEN_GAIN, BROKEN_LENGTH = 3.0, 4
REACH = 24

_FOLLOWS = re.compile("[ะ-ฺๅ-๎ະ-ຼ່-ໍ]")


@lru_cache(maxsize=4)
def vocabulary_words(path: str) -> dict[str, float]:
    """Words of two or more spaceless characters in a rank file, with their costs. An entry that begins inside a syllable is none."""
    out = {}
    with open(path, "rb") as f:
        for line in f:
            token, rank = line.split()
            try:
                word = base64.b64decode(token).decode().strip()
            except UnicodeDecodeError:
                continue
            if len(word) > 1 and all(map(SPACELESS_CHAR.match, word)) and not _FOLLOWS.match(word):
                out.setdefault(word, 5.0 + 0.3 * math.log(int(rank) + 1))
    return out


class Lexicon:
    """Words with costs. own: more words, those of a document."""

    def __init__(self, own: Iterable[str] = (), path: str = VOCABULARY) -> None:
        self.cost = dict(vocabulary_words(path)) if os.path.exists(path) else {}
        self.cost |= dict.fromkeys(own, OWN_COST) | dict.fromkeys(CLOSING | OPENING | CARRYING, PARTICLE_COST)
        self.longest = max(map(len, self.cost))

    def read(self, text: str) -> tuple[list[str], float]:
        """Words of the cheapest path and its cost."""
        n = len(text)
        cost, back = [0.0] + [math.inf] * n, [0] * (n + 1)
        get = self.cost.get
        for i in range(n):
            here = cost[i]
            for j in range(i + 1, min(n, i + self.longest) + 1):
                c = get(text[i:j])
                if c is None:
                    if j > i + 1:
                        continue
                    c = UNKNOWN_COST
                if here + c < cost[j]:
                    cost[j], back[j] = here + c, i
        out, total = [], cost[n]
        while n:
            out.append(text[back[n] : n])
            n = back[n]
        return out[::-1], total

    def gap_score(self, before: str, after: str, prior: float, line_break: bool = False) -> float:
        """How likely the gap between two texts ends a sentence; above 0 it does. Only a line break can cut a word."""
        if before.endswith(REPEATED[0]) or after.startswith(REPEATED):
            return prior + REPEATS
        left, left_cost = self.read(before[-REACH:])
        right, right_cost = self.read(after[:REACH])
        score = prior
        if left and left[-1] in CLOSING:
            score += CLOSES
        if right and right[0] in OPENING:
            score += OPENS
        elif right and right[0] in CARRYING and prior < 0:
            score += CARRIES
        if not line_break:
            return score
        whole, cost = self.read(before[-REACH:] + after[:REACH])
        if cost + BROKEN_GAIN < left_cost + right_cost:
            at = len(before[-REACH:])
            end = 0
            for word in whole:
                if end < at < end + len(word) and len(word) >= BROKEN_LENGTH:
                    return score + BROKEN_WORD
                end += len(word)
        return score
