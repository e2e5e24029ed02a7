"""Reading of names of organisations and brands: what is the proper name in a spelling, and what is its trade."""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache
from itertools import permutations
from typing import NamedTuple

# Words of organisation names that are not their proper names, and given names with their short forms.
LEGAL = """co company corp corporation inc incorporated llc ltd limited gmbh group grp plc lp llp ag sa nv bv kg pty the and of""".split()
ACCOUNT = """program div division direct accessory accessories brand acct account dept""".split()
GENERIC = """products product systems system works manufacturing industries international enterprises services""".split()
TRADES = """grinding abrasives abrasive brass bolt pipe fittings valve valves electric electrical lighting controls climate heating cooling
fastening fasteners building millwork protective wear safety tool tools power coatings coating chemical chemicals appliance appliances home
industrial supply wholesale distributors distributor trading warehouse dealers cooperative partners plumbing hardware paint""".split()
GIVEN = {
    "robert": "bob rob bobby", "richard": "dick rick rich", "william": "bill will billy", "elizabeth": "liz beth betty eliza", "edward": "ed ted eddie ned",
    "katherine": "kate kathy katie cathy", "margaret": "peggy peg maggie meg marge", "frederick": "fred freddy", "james": "jim jimmy", "john": "jack johnny",
    "charles": "charlie chuck", "thomas": "tom tommy", "michael": "mike", "joseph": "joe", "henry": "harry hank", "george": "georgie", "alexander": "alex",
    "samuel": "sam", "benjamin": "ben", "daniel": "dan", "susan": "sue", "patricia": "pat patty", "barbara": "barb", "dorothy": "dot dolly",
}
#: Words that vary a brand's line; they follow the proper name.
LINES = "guard select max pro line plus elite prime".split()

_FORMS = {**{w: w for w in TRADES + GENERIC}, "wks": "works", "mfg": "manufacturing", "ctrl": "controls", "ind": "industries", "indl": "industrial", "dist": "distributors", "coop": "cooperative", "co-op": "cooperative"}
_SHORT = {s: g for g, short in GIVEN.items() for s in short.split()} | {g: g for g in GIVEN}
_SINGULAR = {"tools": "tool", "valves": "valve", "abrasive": "abrasives", "coating": "coatings", "chemicals": "chemical", "appliances": "appliance", "fasteners": "fastening", "electrical": "electric", "distributor": "distributors"}
_LOOKS = str.maketrans("01358$@", "olebssa")
_OCR = {"0": "o", "1": "l", "3": "e", "5": "s", "8": "b", "$": "s", "@": "a"}
_JOINED = sorted({*TRADES, *GENERIC, "company", "corporation", "group", "gmbh", "incorporated", "limited"}, key=len, reverse=True)

class Spelling(NamedTuple):
    """proper: the words of the proper name in their order, with blanks; trade: one word of the trade or empty; cut: the
    proper name was abbreviated with a dot."""

    proper: str
    trade: str
    cut: bool


def plain(name: str) -> str:
    """Compatibility form without marks, accents and account numbers, lower case, look-alike digits as letters."""
    s = unicodedata.normalize("NFKC", re.sub(r"[®™©]|\((?:r|tm|c)\)|\bTM\b", " ", name, flags=re.I))
    s = "".join(c for c in unicodedata.normalize("NFKD", s) if not unicodedata.combining(c) and unicodedata.category(c) != "Cf").lower()
    s = s.replace("ß", "ss").replace("ø", "o").replace("ł", "l").replace("æ", "ae").replace("œ", "oe").replace("’", "'")
    s = re.sub(r"\(\s*\d+\s*\)|\b(?:program|div|division|acct|account|no|dept)\b\.?\s*#?\d+", " ", s)
    return re.sub(r"(?<=[a-z])\d|\d(?=[a-z])", lambda m: _OCR.get(m[0], m[0]), s)


def _abbreviates(short: str, word: str) -> bool:
    at = iter(word)
    return short[0] == word[0] and len(short) < len(word) and all(c in at for c in short)


@lru_cache(maxsize=50_000)
def _trade_word(token: str) -> str | None:
    """The trade or generic word that a token is, or is short for; None for other words."""
    word = _FORMS.get(token)
    if word is None and 2 <= len(token) <= 6:
        fits = [w for w in TRADES + GENERIC if _abbreviates(token, w) and (len(token) < 5 or w.startswith(token[:3]))]
        vowels = sum(c in "aeiou" for c in token)
        word = fits[0] if fits and (vowels <= 1 or any(w.startswith(token) for w in fits)) else None
    return _SINGULAR.get(word, word) if word else None


def _parted(word: str, alone: bool) -> list[str]:
    """The words of organisations at the end of one long word, and, if it is the whole name, a given name at its start."""
    found = []
    while hit := next((w for w in _JOINED if word.endswith(w) and len(word) - len(w) >= 5), None):
        word, found = word[: -len(hit)], [hit, *found]
    if found and alone:
        given = next((g for g in sorted(_SHORT, key=len, reverse=True) if word.startswith(g) and len(word) - len(g) >= 7), "")
        word = word[len(given) :]
    return [word, *found]


def read_organisation(name: str) -> Spelling:
    """Proper name and trade of an organisation's spelling, whatever the order and joints of its words."""
    s = plain(name)
    s = re.sub(r"(?<=[a-z])'s\b", "", s)
    s = re.sub(r"\b([a-z])\.(?=[a-z]\.)", r"\1", s)  # l.l.c. and g.m.b.h.
    s = re.sub(r"\b([a-z])\.([a-z])\b\.?", r"\1\2", s)
    dotted = set(re.findall(r"\b([a-z]{3,})\.", s))
    tokens = re.findall(r"[a-z]+", s.replace("co-op", "coop"))
    tokens = [t for w in tokens for t in _parted(w, len(tokens) == 1)]
    trades, proper = [], []
    for t in tokens:
        if t in LEGAL or t in ACCOUNT or t in _SHORT or len(t) == 1:
            continue
        word = _trade_word(t)
        if word is None:
            proper.append(t)
        elif word not in GENERIC:
            trades.append(word)
    if not proper:
        return Spelling(" ".join(tokens), "", False)
    trade = min(trades, key=TRADES.index) if trades else ""
    return Spelling(" ".join(dict.fromkeys(proper)), trade, any(p in dotted for p in proper))


def read_brand(name: str) -> Spelling:
    """Proper name of a brand's spelling, without blanks and hyphens; a word that names its line is dropped."""
    s = plain(name)
    dotted = bool(re.search(r"[a-z]{3,}\.", s))
    tokens = [t for t in re.findall(r"[a-z]+", s.replace("'s ", " ")) if t not in ACCOUNT and t != "the"]
    while len(tokens) > 1 and tokens[-1] in LINES:
        tokens.pop()
    while len(tokens) > 1 and tokens[0] in LINES:
        tokens.pop(0)
    if len(tokens) == 1 and (line := re.search(r"[a-z](" + "|".join(LINES) + r")\b", re.sub(r"([A-Z])(?=[a-z])", lambda m: m[0].lower(), unicodedata.normalize("NFKC", name)))):
        if re.search(r"[a-z][A-Z]", unicodedata.normalize("NFKC", name)) and tokens[0].endswith(line[1]):
            tokens[0] = tokens[0][: -len(line[1])]
    return Spelling("".join(tokens), "", dotted)


def edits(a: str, b: str, most: int) -> int:
    """Edits between two words, a swap of two neighbouring letters being one; most + 1 if there are more."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    before, row = [], list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row = row, next_row(b, row, before, x, a[i - 2] if i > 1 else "")
        if min(row) > most:
            return most + 1
    return row[-1]


def word_edits(a: str, b: str, most: int) -> int:
    """Edits between two names of as many words in the best order of their words; most + 1 if there are more.

    Equal words are paired first, which is never worse; the others are tried in every order.
    """
    one, two = a.split(), b.split()
    if len(one) != len(two):
        return most + 1
    for w in list(one):
        if w in two:
            one.remove(w)
            two.remove(w)
    if len(one) > most:  # each pair of different words costs an edit at least
        return most + 1
    return min((sum(edits(x, y, most) for x, y in zip(one, order, strict=True)) for order in permutations(two)), default=0)


def next_row(word: str, row: list[int], before: list[int], letter: str, last: str) -> list[int]:
    """Distances of all beginnings of `word` from a text one letter longer: the next state of the automaton."""
    out = [row[0] + 1]
    for j, own in enumerate(word, 1):
        d = min(row[j] + 1, out[-1] + 1, row[j - 1] + (own != letter))
        if before and j > 1 and own == last and word[j - 2] == letter:
            d = min(d, before[j - 2] + 1)
        out.append(d)
    return out
