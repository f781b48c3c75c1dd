"""Problem 3: personal data in free text, as typed placeholders.

A semi-Markov conditional random field. A text is a sequence of segments, each outside or of one kind; a segment of a
kind is scored as a whole, by its form, what it is made of and the words around it, and neighbouring segments by their
kinds. Every anchor (a first name, a title, digits, a street word, an at sign) gives candidate segments of several
kinds with several beginnings and ends each, and dynamic programming over the candidates, whose length is bounded by
their kind, chooses boundaries and kinds together; what no candidate covers is outside, with the score 0.

The weights are fitted, by the averaged perceptron, on labelled text that ``training`` generates (``EXAMPLES`` of
them): sentences with invented personal data, and with serial numbers, prices, buildings and the like that are none.
Names of the users are looked up in a bit table whose size follows their number; how names are spelled is a model of
letter triples. Neither has a list of words whose time or precision would change with the number of users.
"""

from __future__ import annotations

import math
import random
import re
from bisect import bisect_right
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clauseworks.llm.arrow import per_batch
from clauseworks.llm.languages import FUNCTION_WORDS

KINDS = ("email", "phone", "id_number", "address", "name")
PLACEHOLDER = {k: f"[{k.upper()}]" for k in KINDS}
EXAMPLES, ROUNDS = 6000, 4
NAMES_LEARNT = 5000  # names of users that the training text and the model of letters are made with
BITS_A_NAME, MOST_BITS = 32, 1 << 30  # of the bit table; more names than fit are an error
MARGIN = 1.0
NEAR = 40  # characters between segments that are neighbours

# Digits in words, labels of official numbers, and what a number may be instead.
DIGITS = "zero|oh|one|two|three|four|five|six|seven|eight|nine|zéro|un|deux|trois|quatre|cinq|sept|huit|neuf|double|triple"
ID_LABEL = r"s\.?\s?i\.?\s?n\.?|n\.?\s?a\.?\s?s\.?|ssn|social\s+(?:insurance|security)|assurance\s+sociale|tax(?:payer)?(?:\s+id\w*)?|fiscal|passe?port|(?:pr|permanent\s+resident|residen\w+|résiden\w+|health|santé|soleil|identity|id|medical|medicare)\s+card|carte\b|driver\W?s?\W?\s+licen[cs]e|driving\s+licen[cs]e|licen[cs]e|permis\s+de\s+conduire|birth\s+certificate|naissance|national\s+(?:id|identity)|identit[éy]\w*|identification"
DENIED = r"serial|série|invoice|facture|file|dossier|form|formulaire|stall|stationnement|schedule|annexe|page|clause|account|compte|order|commande|model|modèle|part no|policy|police|\$|rl|tsl|ref(?:erence)?|référence"
PHONE_LABEL = r"tel|tél\w*|phone|call|text|fax|cell|mobile|reach\w*|answers?|contact\w*|appel\w*|répond|urgence|emergenc\w+|joindre|numéro|telefon\w*"
STREET = "street|st|road|rd|avenue|ave|av|boulevard|blvd|lane|ln|drive|dr|court|crt|ct|crescent|cres|cr|way|terrace|terr|ter|place|pl|square|sq|circle|cir|trail|trl|parkway|pkwy|highway|hwy|close|alley|heights|grove|gardens?|walk|quay|mews"
RUE = r"rue|avenue|av\.?|boulevard|boul\.?|bd|chemin|ch\.|allée|place|impasse|route|quai|cours|côte|rang|ruelle|montée|square|terrasse|passage"
STREET_FIRST = "calle|avenida|rua|via|plaza|praça|travessa"
STREET_END = "strasse|straße|gasse|platz|allee|weg|damm|ufer"
TITLES = frozenset("mr mrs ms miss mx dr prof sir madam mme mlle m me maître monsieur madame mademoiselle docteur herr frau sr sra señor señora".split())
# Words of the names of buildings, towns, companies and boards; words behind which a name is usual.
PLACES = frozenset("towers tower gardens garden flats flat lofts loft mews manor place court house houses hall row commons common green yard gate lodge terraces heights residences residence apartments apartment suites suite estate estates village park centre center plaza street road avenue lane drive terrace crescent boulevard bay falls mills hills lake beach city narrows heights river creek valley point port saint sainte north south east west inc ltd llc corp company co limited group holdings properties property management rentals realty services board tribunal office agency bank insurance ministry department act lease agreement form schedule residential standard rental tenancy package january february march april may june july august september october november december monday tuesday wednesday thursday friday saturday sunday janvier février mars avril mai juin juillet août septembre octobre novembre décembre bail gestion immeubles tours jardins résidence société compagnie".split())
CUES = frozenset("by par tenant tenants locataire locateur contact from signed signé de landlord occupant name nom dear cher chère attention attn von por".split())
FUNCTION = frozenset(w for words in FUNCTION_WORDS.values() for w in words.split()) | frozenset("a i nights days weeks months hours times items people dollars years written".split())
ABBREVIATED = frozenset("st rd ave av blvd ln dr crt ct cres cr terr ter pl sq cir trl pkwy hwy".split())
SMALL_WORDS = frozenset("way place court drive walk close lane dr st square grove garden gardens heights alley trail cr pl ct av sq ter".split())

LOCAL = r"[^\W_][\w.+%-]*"
DOMAIN = r"[^\W_][\w-]*(?:\.[\w-]+)*\.[^\W\d_]{2,}"
AT, DOT = "at|arobase|arrobas|chez", "dot|point|punkt|punto"
EMAIL = re.compile(
    rf"{LOCAL}\s?[@＠]\s?{DOMAIN}"
    rf"|{LOCAL}\s*[\[({{<]\s*(?:at|arobase|a)\s*[\])}}>]\s*[^\W_][\w-]*(?:\s*(?:[\[({{<]\s*(?:dot|point)\s*[\])}}>]|\.)\s*[\w-]+)+"
    rf"|[^\W_][\w+-]*(?:[.]\w+|\s+(?:{DOT}|plus|dash|tiret|hyphen|underscore)\s+[\w+-]+){{0,4}}\s+(?:{AT})\s+[^\W_][\w-]*(?:\s+(?:{DOT})\s+[\w-]+|\.[\w-]+)*\s+(?:{DOT})\s+[^\W\d_]{{2,}}(?![^\W_])"
    rf"|[^\W_][\w+.-]*\s+(?:{AT})\s+[^\W_][\w-]*(?:\s+(?:{DOT})\s+[\w-]+)*\s+(?:{DOT})\s+[^\W\d_]{{2,}}(?![^\W_])",
    re.I,
)
# What each form of EMAIL has, besides a sign: at and dot in words, or at in brackets.
AT_WORDS, DOT_WORDS = frozenset(AT.split("|")), frozenset(DOT.split("|"))
AT_BRACKETS = re.compile(r"\w\s*[\[({<]\s*(?:at|arobase|a)\s*[\])}>]\s*[^\W_][\w-]*\s*(?:\.|[\[({<]\s*(?:dot|point)\s*[\])}>])\s*\w")
NUMBER = re.compile(r"(?<![\w$€£#.,/@-])[+(]?(?:[A-Z]{1,3}[- ]?)?\(?\d[\dA-Z]*\)?(?:(?:[-. \xa0/(]{1,2}|-?\n|(?<=\)))[\dA-Z]*\d[\dA-Z]*\)?|[-/][A-Z]{1,2}(?![^\W_]))*(?![\w@]|[.,]\d)")
GROUP = re.compile(r"[\dA-Z]+")
EXTENSION = re.compile(r"\s*(?:ext|x|poste|extension)\.?\s*\d{1,5}(?![^\W_])", re.I)
PHONE_WORDS = re.compile(rf"(?<![^\W_])(?:{DIGITS})(?:[\s,.-]+(?:{DIGITS})){{6,}}(?![^\W_])", re.I)
LABELS = re.compile(rf"(?<![^\W_])(?:(?P<id>{ID_LABEL})|(?P<denied>{DENIED})|(?P<phone>{PHONE_LABEL}))(?![^\W_])", re.I)
UNIT = r"(?:,?\s+(?:unit|apt|suite|app)\.?\s*\#?\d\w{0,4})"
TOWN = r"(?:,\s+[^\W\d_][\w'’-]*(?:\s(?:bay|mills|falls|narrows|hills|lake|beach|city|heights)(?![^\W_])|[\s-](?-i:[A-ZÀ-Þ][a-zà-ÿ])[\w'’-]*)?)"
ADDRESS = re.compile(
    rf"(?<![\w$€.,/-])(?P<no>\d{{1,5}}[A-Za-z]?),?\s+"
    rf"(?:(?:(?P<rue>{RUE})\s+(?:de\s+la\s+|de\s+l['’]\s?|du\s+|des\s+|de\s+|d['’]\s?|l['’]\s?)?[^\W\d_][\w'’-]*(?:\s(?-i:[A-ZÀ-Þ])[\w'’-]+)?)"
    rf"|(?P<words>(?:[^\W\d_][\w'’-]*\s+){{1,3}}?)(?P<type>{STREET})(?![^\W_])\.?)"
    rf"(?P<unit>{UNIT})?(?P<town>{TOWN})?(?P<code>(?:,?\s+(?-i:[A-Z]{{2}})(?![^\W_]))?(?:\s+[A-Z]\d[A-Z]\s?\d[A-Z]\d)?)",
    re.I,
)
ADDRESS_LAST = re.compile(rf"(?<![\w-])(?:[A-ZÄÖÜ][\w-]*(?:{STREET_END})|(?:{STREET_FIRST})\s+(?:(?:de|da|do|del|di|la|las|los)\s+)*[A-ZÀ-Þ][\w'’-]*(?:\s[A-ZÀ-Þ][\w'’-]*)?),?\s+(?:n[.º°]?\s*)?\d{{1,4}}[a-z]?(?![\w.,]\d|\w)", re.I)
UNIT_BEFORE = re.compile(r"(?:#\s?\d+[A-Za-z]?|(?<![^\W_])(?:apt|unit|suite|app|bureau|apartment|appartement)\.?\s?#?\w{1,5})\s*[,–-]\s*$", re.I)
STREETS = frozenset(STREET.replace("gardens?", "garden|gardens").split("|")) | frozenset(re.sub(r"[.?]", "", RUE).split("|")) | frozenset(STREET_FIRST.split("|"))
STREET_WORD = re.compile(rf"(?:{STREET_END})\s+\d")
HEADING = re.compile(r"\s*(?:—|–\s*residential|rental office|lease|residential|package|tenancy)", re.I)
PAGE_BEFORE = re.compile(r"(?:page|pg|p\.|rev\.?|form|rl-|\|)\s*$", re.I)
DIGITS_ENOUGH = re.compile(r"\d(?:[-./() \xa0\nA-Z]{0,2}\d){4}")
WORD = re.compile(r"(?<![\w@])[^\W\d_]+(?:['’-][^\W\d_]+)*(?![\w@])")
LETTERS = re.compile(r"[^\W\d_]+")
DIGIT_WORDS = frozenset(DIGITS.split("|"))
#: (start, end, kind, features) of a segment that may be
Candidate = tuple[int, int, str, tuple[str, ...]]


class Names:
    """The users' first names and surnames, as a bit table, and how names are spelled, as shares of letter triples."""

    def __init__(self, bits: np.ndarray | None = None, triples: dict[str, float] | None = None):
        self.bits = np.zeros(1, np.int64) if bits is None else bits
        self.triples = triples or {}
        self._classes: dict[str, str] = {}
        self._anchors: set[str] = set()
        self._others: set[str] = set()

    def __reduce__(self):
        return Names, (self.bits, self.triples)

    def has(self, word: str, place: str) -> bool:
        """Whether a user's first name or surname (``place`` "f" or "s") is lower-case ``word``: always if so, and with
        four bits of a table that is an eighth full once in 4,000 words if not."""
        h = xxhash.xxh64_intdigest((place + word).encode(), 42)
        size = len(self.bits) * 64
        for k in range(4):
            slot = ((h & 0xFFFFFFFF) + k * (h >> 32)) % size
            if not int(self.bits[slot >> 6]) >> (slot & 63) & 1:
                return False
        return True

    def spelled(self, word: str) -> float:
        """The mean log ratio of the word's letter triples in names and in other words."""
        padded = f"^{word}$"
        return sum(self.triples.get(padded[k : k + 3], -0.5) for k in range(len(padded) - 2)) / max(1, len(padded) - 2)

    def kind(self, word: str) -> str:
        """The class of a lower-case word: title, place, function word, user's first name or surname, spelled like a
        name, or other."""
        found = self._classes.get(word)
        if found is None:
            if len(self._classes) > 200_000:
                self._classes.clear()
            found = self._classes[word] = self._kind(word)
        return found

    def any_anchor(self, words: set[str]) -> bool:
        """Whether one of the words is a title or a first name. "m" and "me" are with a point or a capital only, and words
        spelled like names in pairs with capitals; ``CAPITALS`` sees both."""
        if not self._anchors.isdisjoint(words):
            return True
        new = words - self._others
        if len(self._others) > 200_000:
            self._others.clear()
        found = {w for w in new if w not in ("m", "me") and self.kind(w) in "TF"}
        self._anchors |= found
        self._others |= new - found
        return bool(found)

    def _kind(self, word: str) -> str:
        if word in TITLES:
            return "T"
        if len(word) == 1:
            return "I" if word.isascii() else "w"
        if word in FUNCTION or word in AT_WORDS or word in DOT_WORDS:
            return "w"
        if word in PLACES:
            return "P"
        if self.has(word, "f"):
            return "F"
        parts = [p for p in word.split("-") if p]
        if all(self.has(p, "s") for p in parts):
            return "S"
        if all(len(p) > 3 and (self.has(p, "s") or self.spelled(p) > 0.6) for p in parts):
            return "N"
        return "o"


def _shape(text: str) -> str:
    """Runs of digits as their lengths, letters as A, everything between as it is."""
    return re.sub(r"\d+", lambda m: str(len(m.group())), re.sub(r"[A-Z]", "A", re.sub(r"\s", " ", text)))


def _label(text: str, start: int) -> str:
    """The kind of the last label in the 48 characters before a place, and whether it's near."""
    last = None
    for m in LABELS.finditer(text, max(0, start - 48), start):
        last = m
    if last is None:
        return "none"
    between = text[last.end() : start]
    if last.lastgroup != "id" and re.search(r"[.;]\s", between):
        return "none"
    return last.lastgroup + (" near" if len(between) < 14 else " far")


def _numbers(text: str) -> Iterator[Candidate]:
    """Telephone and official numbers: every run of groups of a run of numbers, as either kind."""
    for m in NUMBER.finditer(text):
        run, at = m.group(), m.start()
        groups = [g.span() for g in GROUP.finditer(run)]
        digits = [sum(map(str.isdigit, run[a:b])) for a, b in groups]
        if sum(digits) < 5:
            continue
        for i in range(len(groups)):
            total = 0
            label = None
            for j in range(i, min(len(groups), i + 7)):
                total += digits[j]
                if total < 5 or total > 16:
                    continue
                a, b = groups[i][0], groups[j][1]
                while a > 0 and run[a - 1] in "+(":
                    a -= 1
                b += run[b : b + 1] == ")" and "(" in run[a:b]
                label = label or _label(text, at + a)
                shape = _shape(run[a:b])
                whole = f"{'cut' * (i > 0)}{'ends' * (j + 1 < len(groups))}"
                n = "few" if total < 7 else "id" if total < 9 else str(total) if total < 12 else "many"
                base = (f"shape {shape}", f"digits {n}", f"label {label}", f"whole {whole}", f"groups {min(j - i + 1, 6)} {n}", f"first {run[a] if run[a] in '+(0' else 'x'} {n}", f"letters {shape.startswith('A')} {shape.endswith('A')}", f"label and digits {label} {n}", f"label and whole {label} {whole}")
                yield at + a, at + b, "phone", base
                yield at + a, at + b, "id_number", base
                if j + 1 == len(groups) and (x := EXTENSION.match(text, m.end())):
                    yield at + a, x.end(), "phone", (*base, "extension")


def _emails(text: str) -> Iterator[Candidate]:
    for m in EMAIL.finditer(text):
        found = m.group()
        form = "sign" if "@" in found or "＠" in found else "brackets" if re.search(r"[\[({<]", found) else "words"
        pieces = [w for w in re.findall(r"\w+", found.lower()) if w not in AT_WORDS and w not in DOT_WORDS]
        made = f"usual words {any(w in FUNCTION and len(w) > 1 for w in pieces[:-1])}"
        yield m.start(), m.end(), "email", (f"form {form}", f"form {form} {made}", "whole")
        if form == "words":  # the words before the at may be others
            for x in re.finditer(r"\s+", found[: re.search(rf"\s(?:{AT})\s", found, re.I).start()]):
                yield m.start() + x.end(), m.end(), "email", (f"form {form}", f"form {form} {made}", "begins later")


def _addresses(text: str) -> Iterator[Candidate]:
    for m in ADDRESS.finditer(text):
        own, kind = (m.group("words") or "").split(), (m.group("type") or "").lower()
        if any(w.lower() in FUNCTION for w in own) or "\n\n" in m.group() or "\r\n\r\n" in m.group():
            continue
        behind = any(m.group(g) for g in ("unit", "town", "code"))
        plain = bool(kind) and not any(w[0].isupper() for w in own)
        base = [f"type {'rue' if not kind else 'small' if kind in SMALL_WORDS else 'street'}", "cased" if not plain else "plain short" if kind in SMALL_WORDS and any(len(w) < 5 for w in own) else "plain small" if kind in SMALL_WORDS else "plain"]
        base.append(f"{base[-1]} {behind}")
        if "\n" in text[m.end("no") : m.start("words") if own else m.start("rue")]:
            base.append("break behind number")
        if HEADING.match(text, m.end(), m.end() + 16):
            base.append("heading")
        if PAGE_BEFORE.search(text[max(0, m.start() - 8) : m.start()]):
            base.append("page")
        unit = UNIT_BEFORE.search(text[max(0, m.start() - 24) : m.start()])
        ends = list(dict.fromkeys(m.end(g) for g in ("type" if m.group("type") else "rue", "unit", "town", "code") if m.group(g)))
        ends[0] = min((m.start(g) for g in ("unit", "town", "code") if m.group(g)), default=m.end())
        for start, features in ((m.start(), base), (m.start() - len(unit.group()) if unit else -1, [*base, "unit before"])):
            for k, end in enumerate(dict.fromkeys([*ends, m.end()])):
                if start < 0 or end <= start:
                    continue
                where = "all" if end == m.end() else f"parts {k}"
                if m.group("town") and end >= m.end("town") and not plain and re.match(r",\s+[a-zà-ÿ]", m.group("town")):
                    where += " small town"
                yield start, end, "address", (*features, where)
                if text[end - 1] == ".":  # of an abbreviation, or of the sentence
                    yield start, end - 1, "address", (*features, where, f"without point {kind in ABBREVIATED}")
    for m in ADDRESS_LAST.finditer(text):
        yield m.start(), m.end(), "address", ("number last",)


def _persons(text: str, words: list[tuple[int, int, str]], names: Names) -> Iterator[Candidate]:
    """Names: the runs of up to six words around a title, a first name, an initial or capitals that have what a name has."""
    kinds = [names.kind(w) for _, _, w in words]
    for k, (a, b, w) in enumerate(words):
        # small letters between points, as in p.m., and an m without one are no titles or initials
        if len(w) < 3 and kinds[k] in "TI" and text[a].islower() and (text[a - 1 : a] == "." or text[b : b + 1] == "." and text[b + 1 : b + 2].isalnum() or w in ("m", "me") and text[b : b + 1] != "."):
            kinds[k] = "w"
        elif w == "m" and k and kinds[k - 1] == "F":
            kinds[k] = "I"
        elif len(w) == 1 and text[a].islower() and k + 1 < len(words) and text[words[k + 1][0]].isupper():
            kinds[k] = "w"
    n = len(words)
    seen = set()

    def gap(k: int) -> str:
        return text[words[k][1] : words[k + 1][0]]

    for k, kind in enumerate(kinds):
        a, b, low = words[k]
        cased = text[a].isupper() and not text[a:b].isupper()  # capitals throughout say nothing
        anchor = kind in "TF" or kind == "I" and k + 1 < n and gap(k)[:1] == "." and kinds[k + 1] in "SNoF" and text[a].isupper() == text[words[k + 1][0]].isupper()
        if not anchor and kind in "oSN" and cased and len(low) > 1:
            # two words with a capital within a sentence, or one behind a cue
            anchor = k + 1 < n and text[words[k + 1][0]].isupper() and kinds[k + 1] in "oSN" and not gap(k).strip() and (k > 0 and words[k - 1][2] in CUES or kind in "SN" or kinds[k + 1] in "SN" or k > 0 and not re.search(r"[.!?:\n]\s*$", gap(k - 1)))
        if not anchor:
            continue
        for i in range(max(0, k - 2), k + 1):
            for j in range(i, min(n, i + 6)):
                if j > i:
                    between = gap(j - 1)
                    bare = between.strip(" \t\r\n\xa0")
                    if len(between) > 4 or bare not in ("", ".", ",") or bare == "." and kinds[j - 1] not in "TI" or between.count("\n") > 1:
                        break
                if kinds[j] in "wP":
                    break
                if j < k or (i, j) in seen or "T" in kinds[i + 1 : j + 1] and kinds[i] != "T":
                    continue
                seen.add((i, j))
                inner = kinds[i : j + 1]
                if inner[-1] in "TI" and not (inner[-1] == "I" and "," in text[words[i][0] : words[j][0]]):
                    continue
                pattern = "".join(c + ("," if x < j - i and "," in gap(i + x) else "") for x, c in enumerate(inner))
                raw = text[words[i][0] : words[j][1]]
                case = "upper" if raw.isupper() else "lower" if raw.islower() else "mixed" if any(c in "oSNF" and text[words[i + x][0]].islower() for x, c in enumerate(inner)) else "title"
                prev = words[i - 1][2] if i else ""
                before = "cue" if prev in CUES else "P" if i and kinds[i - 1] == "P" else "name" if i and kinds[i - 1] in "TFSNI" and not gap(i - 1).strip(" \n.") else "o" if i else "start"
                after = "P" if j + 1 < n and kinds[j + 1] == "P" and text[words[j + 1][0]].isupper() and not gap(j).strip() else "name" if j + 1 < n and kinds[j + 1] in "SNF" and not gap(j).strip() else "cased" if j + 1 < n and text[words[j + 1][0]].isupper() and not gap(j).strip() else "o"
                first = text[: words[i][0]].rstrip()[-1:] in "" or text[: words[i][0]].rstrip()[-1:] in ".!?:;\n"
                yield words[i][0], words[j][1], "name", (f"pattern {pattern}", f"pattern {pattern} {case}", f"case {case}", f"before {before}", f"after {after}", f"first {first} {inner[0]}", f"pattern {pattern} before {before}", f"has {'S' if 'S' in inner else 'N' if 'N' in inner else 'o'} {'F' in inner} {'T' in inner} {'I' in inner}", f"others {inner.count('o')} {case}")


def candidates(text: str, names: Names) -> list[Candidate]:
    low = text.lower()
    own = set(LETTERS.findall(low))
    out: list[Candidate] = []
    if "@" in text or "＠" in text or not AT_WORDS.isdisjoint(own) and not DOT_WORDS.isdisjoint(own) or AT_BRACKETS.search(low):
        out += _emails(text)
    if DIGITS_ENOUGH.search(text):
        out += _numbers(text)
    if len(DIGIT_WORDS & own) > 1:
        out += ((m.start(), m.end(), "phone", ("in words",)) for m in PHONE_WORDS.finditer(text))
    if not STREETS.isdisjoint(own) or STREET_WORD.search(low):
        out += _addresses(text)
    if names.any_anchor(own) or _capitals(text):
        words = [(m.start(), m.end(), m.group().lower()) for m in WORD.finditer(text)]
        out += _persons(text, words, names)
    return out


def _capitals(text: str) -> bool:
    """Whether two words with a capital, of no place, an initial with its point or an M stand in the text."""
    for m in CAPITALS.finditer(text):
        pair = m.group().lower().split()
        if len(pair) < 2 or len(pair[0]) == 2 and pair[0][1] == "." or PLACES.isdisjoint(pair) and FUNCTION.isdisjoint(pair):
            return True
    return False


CAPITALS = re.compile(r"(?<![^\s(])[A-ZÀ-Þ][a-zà-ÿ'’-]+[ ][A-ZÀ-Þ][a-zà-ÿ'’-]+|(?<![^\W_])[A-Z]\.\s?[A-ZÀ-Þ][a-zà-ÿ]|(?<![\w.])(?:[Mm]e?\.|Me?)\s")


def decode(spans: list[Candidate], weights: dict[str, dict[str, float]], gold: frozenset[int] | None = None) -> list[int]:
    """The candidates, by number, that the best segmentation has.

    ending[k] is the highest score of a segmentation whose last segment is the k-th candidate by end, upto[k] the highest
    of the first k; neighbours within ``NEAR`` characters add the weight of their kinds. In training, where ``gold`` is
    given, all others get ``MARGIN`` more, so that the right ones must lead by as much."""
    order = sorted(range(len(spans)), key=lambda k: (spans[k][1], spans[k][0]))
    ends, upto, ending, back = [], [(0.0, -1)], [], []
    follow = weights["follow"]
    for at, k in enumerate(order):
        start, end, kind, features = spans[k]
        own = weights[kind]
        score = own["bias"] + sum(own.get(f, 0.0) for f in features) + (MARGIN if gold is not None and k not in gold else 0.0)
        far = bisect_right(ends, start - NEAR)
        best, last = upto[far]
        for j in range(far, bisect_right(ends, start)):
            value = ending[j] + follow.get(f"{spans[order[j]][2]} {kind}", 0.0)
            if value > best:
                best, last = value, j
        ends.append(end)
        ending.append(best + score)
        back.append(last)
        upto.append(max(upto[-1], (best + score, at)))
    out, at = [], upto[-1][1]
    while at >= 0:
        out.append(order[at])
        at = back[at]
    return out[::-1]


def segments(text: str, model: Model) -> list[tuple[int, int, str]]:
    """The best segmentation: (start, end, kind) of its segments, in order."""
    spans = candidates(text, model.names)
    return [spans[k][:3] for k in decode(spans, model.weights)] if spans else []


class Model:
    def __init__(self, names: Names, weights: dict[str, dict[str, float]]):
        self.names, self.weights = names, weights


# Sentences for the training text. A name in braces is a piece of ``Invented``; those in capitals are personal.
SENTENCES = """
The {ROLE} can be reached at {PHONE} or {EMAIL}.|Call {PHONE} before moving in.|Tel. {PHONE}|Phone: {PHONE}.|In an emergency, text {PHONE} at once.|{NAME} answers {PHONE} after hours.|Fax {PHONE}, attention {NAME}.|Dial {PHONE} and ask for {NAME}.|Tél. {PHONE}. Écrire à {EMAIL}.|Appeler le {PHONE} avant de visiter.|Notice reaches the {ROLE} at {PHONE} until the sale.|Contact {NAME}, {PHONE}.|{TITLED}, {PHONE}.|Send the copy of the form ({EMAIL}) the same week.|The {ROLE} takes notices at {EMAIL} only.|Signed by {NAME} ({EMAIL}).|Send the copy to {EMAIL} today.|E-mail: {EMAIL}|Questions go to {EMAIL} first.|Write to {NAME} ({EMAIL}).|Courriel : {EMAIL}
Signed by {NAME} on behalf of the owner.|Signé par {NAME} au nom de la locataire.|{NAME} keeps the spare key.|If {NAME} has not paid, the {ROLE} may call {PHONE}.|During the term, {NAME} may repair the door.|Upon request, {NAME} shall return the key by {DATE}.|On that day, {NAME} is free to leave.|Tenant: {NAME}|Tenant: {NAME}, {ADDRESS}.|Locataire : {NAME}|A request from {NAME} is attached.|When {NAME} asks about the lamp, the {ROLE} answers.|Pendant le bail, {NAME} peut garder la clé.|As agreed, {NAME} pays {MONEY}.|La demande de {NAME} est jointe.|Notice reaches {NAME} by text message.|In March, {NAME} moved to {ADDRESS}.|{TITLED} signed.|{TITLED} signed the form on {DATE}.|We met {TITLED} at {BUILDING}.|{REVERSED} can be reached at {PHONE}.|Signed by {REVERSED} in {TOWN}.
The tenant gave {LABEL} {ID} as proof.|Identity was checked ({LABEL}: {ID}) at signing.|The file shows {LABEL} {ID} next to the name.|Identification on file: {LABEL} {ID}.|{LABEL} {ID}|Her {LABEL} is {ID}.|{NAME}, {LABEL} {ID}, lives here.|Le dossier porte {LABEL} {ID}.
The unit is at {ADDRESS}.|Return mail: {ADDRESS}.|{ADDRESS}, tel. {PHONE}|{ADDRESS}, noted on {DATE}.|Contact {NAME}, {ADDRESS}, tel. {PHONE}, {EMAIL}.|Deliver the key to {ADDRESS} only.|{NAME} lives at {ADDRESS} since {DATE}.|Le logement se trouve au {ADDRESS}.|The lamp may be left at {ADDRESS} until noon.|Contact {NAME}, {ADDRESS}.
Invoice {SERIAL} lists {COUNT} @ {MONEY} for the lamp.|The meter bears serial {LONG} as of {DATE}.|See file {FILE}, page {COUNT}, about the dog.|Form RL-{COUNT} of {DATE} replaces this.|A fee of {MONEY} applies within {COUNT} days.|Stall P{COUNT}-{COUNT} comes with unit {COUNT}B.|{BUILDING} Rental Office, page {COUNT}|{BUILDING} — Residential Tenancy Agreement|for up to {COUNT} {BUILDING} — Residential Tenancy Agreement weeks|every {COUNT} {BUILDING} LEASE PACKAGE months|by {COUNT} {BUILDING} Rental Office · page {COUNT}|Tenancy Agreement / {BUILDING}|Order {LONG} was for {BUILDING} in {TOWN}.|The {ROLE} of {BUILDING} owes {MONEY}.|The office in {TOWN} opens at {COUNT} a.m.|{COMPANY} runs the place.|Under {COMPANY}, the {ROLE} pays {MONEY} on {DATE}.|The {ROLE} must clean the way to the court {COUNT} times.|Walk {COUNT} steps to the square.|No {ROLE} may park within {COUNT} feet of the road.|The Landlord and Tenant Board decides.|On Monday, Standard Rules apply.|Facture {SERIAL} : {COUNT} @ {MONEY}.|Account {LONG} was closed.|Keep {COUNT} copies in the close.|The {ROLE} may at any point leave.|Rent is due at the office of {BUILDING}.|The word Schedule means Schedule {COUNT}.|Within {COUNT} hours after the sale, page {COUNT} side lane, the {ROLE} pays.|The {ROLE} keeps {COUNT} move-in walk notes.|At {COUNT} p.m. the boiler is off until the way is clear.|{FIRST} is a first name alone.|The month of {FIRST} begins, {FIRST} said.|STORAGE RULES|QUIET RULES In addition, each {ROLE} pays.|The {ROLE} reaches the other by text message or by registered letter.|Either party may call before {DATE}.|In addition, the {ROLE} pays {MONEY}.
""".strip().replace("\n", "|").split("|")


class Invented:
    """Pieces of the training text, from a seed. Names are half the users', half made of syllables."""

    def __init__(self, seed: int, first: list[str], last: list[str]):
        self.rng, self.users = random.Random(seed), (first, last)

    def syllables(self, least: int, most: int) -> str:
        rng = self.rng
        out = "".join(rng.choice("b c d f g h j k l m n p r s t v w z br ch dr gr kr sh st th tr".split()) + rng.choice("a e i o u ai ei ou".split()) for _ in range(rng.randrange(least, most)))
        return (out + rng.choice(["", "n", "r", "s", "l", "ck", "nd", "ski", "vich"])).capitalize()

    def known(self, place: int) -> str:
        own = self.users[place]
        return self.rng.choice(own).capitalize() if own and self.rng.random() < 0.75 else self.syllables(1, 3) if not place else self.syllables(2, 4)

    def surname(self) -> str:
        return "-".join(self.known(1) for _ in range(1 + (self.rng.random() < 0.2)))

    def case(self, text: str) -> str:
        r = self.rng.random()
        return text.upper() if r < 0.1 else text.lower() if r < 0.25 else text

    def NAME(self) -> str:
        initial = self.rng.choice(["", "", "", f"{self.rng.choice('ABCDEFGHJKLMNPRSTVWZ')}. "])
        return self.case(f"{self.known(0)} {initial}{self.surname()}") if self.rng.random() < 0.8 else f"{self.rng.choice('ABCDEFGHJKLMNPRSTVWZ')}. {self.surname()}"

    def TITLED(self) -> str:
        return f"{self.rng.choice(['Mr.', 'Mrs.', 'Ms.', 'Dr.', 'M.', 'Mme', 'Mr', 'Prof.'])} {self.rng.choice(['', '', self.known(0) + ' '])}{self.surname()}"

    def REVERSED(self) -> str:
        return f"{self.rng.choice([str.upper, str])(self.surname())}, {self.known(0)}"

    def EMAIL(self) -> str:
        rng = self.rng
        a, b, c = self.known(0).lower(), self.syllables(1, 3).lower(), rng.choice(["com", "org", "net", "ca", "fr", "es", "test", "invalid"])
        sep = rng.choice(["@", "@", "@", "@", " @ ", "＠", " [at] ", "(at)", " at ", " AT ", " at ", " arobase ", " chez "])
        words = sep.strip().lower() in AT_WORDS
        dot = rng.choice([" dot ", " point "]) if words else rng.choice([".", ".", " [dot] "]) if "[" in sep else "."
        dot = dot.upper() if sep == " AT " else dot
        local = a + rng.choice(["", dot + self.known(1).lower(), "." + self.known(1).lower(), "+lease", "-" + self.known(1).lower(), str(rng.randrange(99))])
        return self.case(f"{local}{sep}{b}{rng.choice(['', '', dot + self.syllables(1, 2).lower()])}{dot}{c}")

    def digits(self, shape: str) -> str:
        return re.sub("#", lambda _: str(self.rng.randrange(10)), re.sub("A", lambda _: self.rng.choice("ABCDEFGHJKLMNPRSTVWXYZ"), shape))

    def PHONE(self) -> str:
        rng = self.rng
        if rng.random() < 0.1:
            return " ".join(rng.choice(DIGITS.split("|")[:10]) for _ in range(10))
        text = self.digits(rng.choice("###-####|###-###-####|(###) ###-####|###.###.####|### ### ####|##########|1-###-###-####|+1 ### ### ####|+1(###)###-####|+1 (###) ###-####|+### ## #### ###|0### ### ####|0## ### ## ##|+## ### #######|+## # ## ## ## ##|0#.##.##.##.##".split("|")))
        return text + rng.choice(["", "", "", "", f" ext. {rng.randrange(1, 999)}"])

    def LABEL(self) -> str:
        return self.rng.choice("SIN|S.I.N.|NAS|social insurance number|passport|PR card|health card|driver's licence|birth certificate no.|national ID|tax number|permis de conduire|passeport|SSN|identity card|residence card".split("|"))

    def ID(self) -> str:
        return self.digits(self.rng.choice("### ### ###|###-###-###|#########|###.###.###|AA######|AA#######|AA##-#####|####-###-###-AA|A####-#####-#####|19##-A-######|AA-#####/###|###-##-####|A#######|##########|A##-###-###|### ## ####".split("|")))

    def ADDRESS(self) -> str:
        rng = self.rng
        name = f"{self.syllables(1, 3)}{rng.choice(['', ' ' + self.syllables(1, 3)])}"
        kind = rng.choice(STREET.replace("gardens?", "gardens").split("|")).capitalize()
        kind += "." * (kind.lower() in ABBREVIATED and rng.random() < 0.7)
        text = f"{rng.randrange(1, 2999)} {name} {kind}" if rng.random() < 0.75 else f"{rng.randrange(1, 2999)}, rue {rng.choice(['', 'des ', 'de la '])}{self.syllables(2, 4)}" if rng.random() < 0.7 else rng.choice([f"{self.syllables(1, 3)}strasse {rng.randrange(1, 200)}", f"Calle {self.syllables(1, 3)} {rng.randrange(1, 200)}"])
        if "strasse" in text or "Calle" in text:
            return text
        if rng.random() < 0.25:
            text = rng.choice([f"Apt. {rng.randrange(99)}, ", f"#{rng.randrange(999)} - "]) + text
        text += rng.choice(["", f", Unit {rng.randrange(1, 40)}{rng.choice('ABC')}"])
        text += rng.choice(["", f", {self.syllables(2, 3)}{rng.choice(['', ' Bay', ' Falls'])}{rng.choice(['', self.digits(' ON A#A #A#')])}"])
        return self.case(text) if not re.search(r"\b[A-Z]\d[A-Z]\b", text) else text

    def SERIAL(self) -> str:
        return self.digits("##-####-##")

    def LONG(self) -> str:
        return self.digits(self.rng.choice("### ### ###-##|### ###-##|###### ###|########|###-###-###-##".split("|")))

    def FILE(self) -> str:
        return self.digits("AAA-#####-##")

    def DATE(self) -> str:
        return self.rng.choice([f"20{self.rng.randrange(10, 30)}-{self.rng.randrange(10, 13)}-{self.rng.randrange(10, 29)}", f"the {self.rng.randrange(1, 29)}th of May", f"June {self.rng.randrange(1, 29)}, 2026"])

    def MONEY(self) -> str:
        return self.rng.choice([f"${self.rng.randrange(1, 9)},{self.rng.randrange(100, 999)}.{self.rng.randrange(10, 99)}", f"{self.rng.randrange(10, 4000)} dollars", f"{self.rng.randrange(100, 4000)},{self.rng.randrange(10, 99)} $"])

    def FIRST(self) -> str:
        return self.known(0)

    def COUNT(self) -> str:
        return str(self.rng.randrange(1, 99))

    def BUILDING(self) -> str:
        return f"{self.rng.choice(['Old ', 'North ', '', ''])}{self.syllables(2, 4)} {self.rng.choice('Gardens Towers Flats Lofts Mews Manor Place Row Court House'.split())}"

    def TOWN(self) -> str:
        return f"{self.rng.choice(['', '', 'Port ', 'Saint-'])}{self.syllables(2, 4)}{self.rng.choice(['', ' Bay', ' Falls', ' Narrows'])}"

    def COMPANY(self) -> str:
        return f"{self.syllables(2, 4)} {self.rng.choice(['Property Management', 'Holdings', 'Group Inc.', 'Insurance', 'Rentals Ltd.'])}"

    def ROLE(self) -> str:
        return self.rng.choice("tenant landlord owner caretaker agent occupant".split())


PERSONAL = {"NAME": "name", "TITLED": "name", "REVERSED": "name", "EMAIL": "email", "PHONE": "phone", "ID": "id_number", "ADDRESS": "address"}


def training(first: list[str], last: list[str], examples: int = EXAMPLES, seed: int = 5) -> Iterator[tuple[str, list[tuple[int, int, str]]]]:
    """Texts of one to three sentences with their personal data (start, end, kind)."""
    made = Invented(seed, first, last)
    for _ in range(examples):
        text, gold, cut = "", [], False
        for _ in range(made.rng.randrange(1, 4)):
            text += made.rng.choice([" ", " ", "\n"]) * bool(text)
            for part in re.split(r"(\{[A-Z]+\})", made.rng.choice(SENTENCES)):
                if part.startswith("{"):
                    if part == "{BUILDING}" and text.endswith(" ") and made.rng.random() < 0.3:  # a heading on a line of its own
                        text = text[:-1] + "\n"
                    piece = getattr(made, part[1:-1])()
                    if part == "{COUNT}" and made.rng.random() < 0.15:  # a number at a line's end
                        piece, cut = piece + "\n", True
                    if part[1:-1] in PERSONAL:
                        gold.append((len(text), len(text) + len(piece), PERSONAL[part[1:-1]]))
                    part = piece
                elif cut:
                    part, cut = part.lstrip(" "), False
                text += part
        yield (text.upper() if made.rng.random() < 0.06 and len(text.upper()) == len(text) else text), gold


def fit(names: Names, first: list[str], last: list[str], examples: int = EXAMPLES, rounds: int = ROUNDS) -> Model:
    """The averaged perceptron: after each text, what the best segmentation has too much loses, what it lacks gains."""
    weights: dict[str, dict[str, float]] = {k: defaultdict(float, {"bias": 0.0}) for k in (*KINDS, "follow")}
    sums: dict[str, dict[str, float]] = {k: defaultdict(float) for k in weights}
    prepared = []
    for text, gold in training(first, last, examples):
        spans = candidates(text, names)
        at = {}
        for k, c in enumerate(spans):
            at.setdefault(c[:3], k)
        prepared.append((spans, [at[g] for g in gold if g in at]))
    rng, step = random.Random(7), 1
    for _ in range(rounds):
        rng.shuffle(prepared)
        for spans, gold in prepared:
            step += 1
            found = decode(spans, weights, frozenset(gold))
            if found != gold:
                for chosen, sign in ((gold, 1.0), (found, -1.0)):
                    for key, f in _fired(spans, chosen):
                        weights[key][f] += sign
                        sums[key][f] += sign * step
    return Model(names, {key: {"bias": 0.0} | {f: w - sums[key][f] / step for f, w in own.items()} for key, own in weights.items()})


def _fired(spans: list[Candidate], chosen: list[int]) -> Iterator[tuple[str, str]]:
    for x, k in enumerate(chosen):
        yield spans[k][2], "bias"
        for f in spans[k][3]:
            yield spans[k][2], f
        if x and spans[k][0] - spans[chosen[x - 1]][1] < NEAR:
            yield "follow", f"{spans[chosen[x - 1]][2]} {spans[k][2]}"


def redact(text: str, model: Model) -> str:
    out, at = [], 0
    for start, end, kind in segments(text, model):
        out += [text[at:start], PLACEHOLDER[kind]]
        at = end
    return "".join([*out, text[at:]])


def _triples(names: list[str], others: list[str]) -> dict[str, float]:
    """The log ratio of each letter triple's share in names and in other words."""
    counts = [Counter(t for w in ws for p in [f"^{w}$"] for t in (p[k : k + 3] for k in range(len(p) - 2))) for ws in (names, others)]
    total = [sum(c.values()) + 1 for c in counts]
    return {t: math.log((counts[0][t] + 0.1) / total[0] * total[1] / (counts[1][t] + 0.1)) for t in counts[0].keys() | counts[1].keys()}


def known_names(users: DataFrame | None, name: str = "name") -> Model:
    """The model with the users' names in its bit table, of ``BITS_A_NAME`` bits for each distinct one. The names that it
    learns the spelling from, and the training text is made with, are ``NAMES_LEARNT`` by their hash."""
    if users is None:
        return _fitted(None, (), ())
    parts = F.split(F.lower(F.trim(F.regexp_replace(name, r"\s+", " "))), " ")
    each = users.select(parts.alias("p")).filter("size(p) > 1").select(F.element_at("p", 1).alias("f"), F.explode(F.split(F.element_at("p", -1), "-")).alias("s"))
    one = each.select(F.explode(F.array(F.struct(F.lit("f").alias("place"), F.col("f").alias("word")), F.struct(F.lit("s").alias("place"), F.col("s").alias("word")))).alias("x")).select("x.*").filter("length(word) > 1").distinct()
    n = one.count()
    size = 64 << max(0, (n * BITS_A_NAME // 64).bit_length())
    if size > MOST_BITS:
        raise ValueError(f"{n} distinct names need more than {MOST_BITS} bits")
    h = F.xxhash64(F.concat("place", "word"))
    slots = F.array(*((h.bitwiseAND(F.lit(0xFFFFFFFF)) + F.shiftrightunsigned(h, 32) * F.lit(k)).bitwiseAND(F.lit(size - 1)) for k in range(4)))
    bits = np.zeros(size // 64, np.int64)
    rows = one.select(F.explode(slots).alias("s")).groupBy(F.shiftright("s", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(s & 63L as int))")).alias("b")).toArrow()
    bits[np.array(rows.column("w"), np.int64)] = np.array(rows.column("b"), np.int64)
    some = {p: tuple(r[0] for r in one.filter(F.col("place") == p).orderBy(F.xxhash64("word"), "word").limit(NAMES_LEARNT).select("word").collect()) for p in "fs"}
    return _fitted(bits.tobytes(), some["f"], some["s"])


@lru_cache(maxsize=4)
def _fitted(bits: bytes | None, first: tuple[str, ...], last: tuple[str, ...]) -> Model:
    words = [w for s in SENTENCES for w in LETTERS.findall(re.sub(r"\{[A-Z]+\}", " ", s).lower())] + sorted(FUNCTION | PLACES)
    names = Names(np.frombuffer(bits, np.int64) if bits else None, _triples(list(last), words) if last else None)
    return fit(names, list(first), list(last))


def _spans(key: str, column: str, shared, what: str) -> Callable[[pa.RecordBatch], pa.RecordBatch | None]:
    model = shared.value

    def run(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        values = batch.column(column).to_pylist()
        if what == "redacted":
            return pa.RecordBatch.from_arrays([batch.column(key), pa.array([None if v is None else redact(v, model) for v in values], pa.string())], [key, "text"])
        rows = [(k, s) for k, v in enumerate(values) if v for s in segments(v, model)]
        if not rows:
            return None
        return pa.RecordBatch.from_arrays(
            [batch.column(key).take(pa.array([k for k, _ in rows])), pa.array([s[0] for _, s in rows], pa.int32()), pa.array([s[1] for _, s in rows], pa.int32()), pa.array([s[2] for _, s in rows], pa.string())],
            [key, "char_start", "char_end", "kind"],
        )

    return run


def find(df: DataFrame, key: str, column: str, model: Model) -> DataFrame:
    """(key, char_start, char_end, kind) of each piece of personal data, places in code points. Null and empty texts
    have none; rows that repeat a key are searched each for itself."""
    kind = df.schema[key].dataType.simpleString()
    return per_batch(df.select(key, column), f"`{key}` {kind}, char_start int, char_end int, kind string", _spans, key, column, df.sparkSession.sparkContext.broadcast(model), "spans")


def redacted(df: DataFrame, key: str, column: str, model: Model) -> DataFrame:
    """(key, text) with placeholders for personal data; all else is unchanged, a null text stays null."""
    kind = df.schema[key].dataType.simpleString()
    return per_batch(df.select(key, column), f"`{key}` {kind}, text string", _spans, key, column, df.sparkSession.sparkContext.broadcast(model), "redacted")
