"""Problem 1: text read from scanned pages, back into readable paragraphs.

A noisy-channel decoder. Words, pairs of words, numbers within lines and title-like lines are counted over all texts. A
scanned text loses its running headings and page numbers; what is left is one stream of characters, which is decoded
into words. The lattice over the stream has an edge wherever a word of the lexicon can have been written as the
characters from one place to another: as they are, over a line's end with or without a hyphen, over a space (a word
torn apart), without a space to the next word (words run together), with characters that recognition confuses, and all
of these at once. Edges are found by walks along the lexicon's prefixes; the cheapest way, by word and word-pair costs
and those of the channel, is found by dynamic programming. What the way corrects, joins or drops are the text's traces.
A second dynamic program over the lines chooses the paragraph boundaries.

Where every word is usual and no two of them can be one, the way through the stream as it is is the cheapest, so the
program runs over the other words and their neighbours only.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clauseworks.llm import counters
from clauseworks.llm.arrow import per_batch, per_task, texts
from clauseworks.llm.shingles import pair_value, runs, word_hashes
from clauseworks.session import cut

WORD_SHARE = 2e-6  # words of a smaller share of all tokens aren't in the lexicon: at most 1 / WORD_SHARE are
CONTEXT_SHARE = 2e-6
HEAD_SHARE = 4e-5  # of all texts, for a title-like line to count as a running heading
USUAL = 1e-3  # words of this share always stand as they are
PAIR_BITS = 20
SLACK = 20.0
KEPT = 1_000_000  # distinct values that a task counts before it gives them out
# The costs, in nats. An unknown word costs "unknown", and "letter" for each character from the tenth on. A confusion
# costs 3.4 (a word must be 30 times as usual as its misreading), and 1.1 where a digit or mark is read.
COST = {"unknown": 15.2, "letter": 3.0, "confusion": 3.4, "mark": 1.1, "again": 1.4, "short": 3.7, "shortish": 1.1, "split": 6.5, "line": 2.5, "hyphen": 0.5, "space": 7.0, "both known": 6.0, "soft hyphen": 8.0}

# What recognition makes of characters (read: meant).
CONFUSED = {
    "1": "l i", "0": "o", "5": "s", "9": "g", "6": "é b e", "8": "b", "@": "a", "$": "s", "|": "l i", "!": "l i", "3": "e", "2": "z", "4": "a", "7": "t",
    "rn": "m", "ri": "n", "ii": "u", "cl": "d", "vv": "w", "li": "h", "h": "li b", "b": "h", "c": "e", "e": "c", "l": "i t", "i": "l j", "t": "f l", "f": "t", "d": "cl", "m": "rn in", "n": "ri", "u": "ii", "w": "vv", "é": "e", "è": "e", "ê": "e",
}
MEANT = {read: tuple(meant.split()) for read, meant in CONFUSED.items()}
# Marks that recognition puts into a word.
STRAY = "|~`^¦"
HYPHENS = "-‐‑­¬–~"
SOFT = "‐­¬"  # that are hardly ever written but at a line's end
TOKEN = re.compile(r"[^\s,;:()\[\]{}\"“”«»'’…/\\—–\xa0]+")
EDGES = ".!?-‐‑­¬*•·_="
LINE = re.compile(r"\r\n|[\r\n\x0b\x0c\x85  ]")
PAGE = re.compile(
    r"[-–—\[(|\s]*(?:(?:page|pg|p)\b\.?\s*(?:\d{1,4}|[ivxlc]{1,7})(?:\s*(?:of|de|sur|/|\|)\s*\d{1,4})?|\d{1,4}(?:\s*(?:of|de|sur|/|\|)\s*\d{1,4})?)[-–—\])|\s]*", re.I
)
ROMAN = re.compile(r"[-–—\[(]\s*[ivxlc]{1,7}\s*[-–—\])]", re.I)
# Words of running headings and footings.
HEAD_WORDS = frozenset("lease agreement tenancy residential confidential draft copy standard form rev revision rental office initials package page pg bail formulaire confidentiel ébauche copie convention location version".split())
PAGE_PART = re.compile(r"(?<![^\W_])(?:page|pg)\.?\s*(?:\d{1,4}|[ivxlc]{1,7})(?![^\W_])|(?<![^\W_])p\.\s*\d{1,4}|(?:rev\.?|form|no\.)\s*[\w-]*\d|_{3,}|-\s*\d{1,4}\s*-\s*$|\[\d{1,4}\]\s*$|\|\s*\d{1,4}\s*$", re.I)
ENDED = re.compile(r"[.!?:;][\"”’»)\]]*\s*$")
TITLE_WORD = re.compile(r"[^\W\d_][\w'’-]*")
LIST_MARK = re.compile(r"\s*(?:[-•*·–]\s|\(?[a-zA-Z0-9]{1,3}[.)]\s)")
ORDINAL = re.compile(r"\d+(?:st|nd|rd|th|e|er|re|ème|h|am|pm)")
MAIL = re.compile(r"\w@\w+(?:[.-]\w+)*\.\w{2,}")
GAP = re.compile(rf"(?P<hyphen>[{re.escape(HYPHENS)}]?)[ \t\xa0]*(?P<end>\n?)[ \t\xa0]*")
#: the kinds of traces that make a text a scanned one; spaces in wrong places alone don't
TRACES = ("heading", "broken", "misread")


def core(token: str) -> str:
    return token.strip(EDGES)


def _lines(text: str) -> list[str]:
    return LINE.split(text)


def heading_form(line: str) -> str:
    return " ".join(re.sub(r"\d+", "#", line).split()).lower()


def title_like(line: str) -> bool:
    """Two words or more, most of them with a capital, and no end of a sentence."""
    if line.islower() or re.search(r"[.!?;,]\s*$", line):
        return False
    words = [w for w in TITLE_WORD.findall(line) if len(w) > 1]
    return len(words) > 1 and sum(w[0].isupper() for w in words) >= 0.6 * len(words)


def pair_slots(all_texts: list[str]) -> tuple[np.ndarray, int]:
    """Two slots of each pair of neighbouring words, first all first ones, and the number of pairs."""
    flat, counts = word_hashes(all_texts)
    value = runs(flat, counts, 2)[1]
    mask = np.uint64((1 << PAIR_BITS) - 1)
    return np.concatenate([value & mask, (value >> np.uint64(PAIR_BITS) & mask) + mask + np.uint64(1)]).astype(np.int64), len(value)


class Corpus:
    """What the decoder knows of all texts: shares of words and of pairs, words around inline numbers, usual title-like
    lines. Readings are kept as long as the worker lives; they follow from the rest."""

    def __init__(self, words: dict[str, float], numbers: frozenset[tuple[str, str]], heads: frozenset[str], pairs: np.ndarray | None = None, n_pairs: int = 0):
        self.words, self.numbers, self.heads, self.pairs, self.n_pairs = words, numbers, heads, pairs, n_pairs
        self.costs = {w: -math.log(s) for w, s in words.items()}
        # the least cost of the words that begin so
        self.prefixes: dict[str, float] = {}
        for w, c in self.costs.items():
            for k in range(1, len(w) + 1):
                if c < self.prefixes.get(w[:k], math.inf):
                    self.prefixes[w[:k]] = c
        self.cheapest = min(self.costs.values(), default=0.0)
        self._hashes: dict[str, tuple[int, int]] = {}
        self._read: dict[str, tuple] = {}
        self._pair: dict[tuple[str, str], float] = {}
        self._fine: set[str] = set()
        self._torn: frozenset[tuple[str, str]] | None = None
        self._left = {a for a, _ in self.torn()}

    def __reduce__(self):
        return Corpus, (self.words, self.numbers, self.heads, self.pairs, self.n_pairs)

    def share(self, word: str) -> float:
        return self.words.get(word, 0.0)

    def known(self, word: str) -> bool:
        """A word of the lexicon, or one whose parts are."""
        if word in self.words:
            return True
        parts = [p for p in re.split(r"[-‐‑]", word) if p]
        return len(parts) > 1 and all(p in self.words for p in parts)

    def cost(self, word: str) -> float:
        """-log of the word's share; that of an unknown word grows with its length."""
        own = self.costs.get(word)
        return own if own is not None else COST["unknown"] + COST["letter"] * max(0, len(word) - 9)

    def alone(self, word: str) -> float:
        """The cost of the cheapest reading of a word by itself."""
        return min((c + self.cost(words[0]) for words, c, _ in self.readings(word)), default=self.cost(word)) if word not in self.words else self.costs[word]

    def pair_cost(self, before: str | None, word: str) -> float:
        """-log of the word's share behind ``before``: half its share of all words, half that of the pairs."""
        if before is None or self.pairs is None or word not in self.words or before not in self.words:
            return self.cost(word)
        if (before, word) not in self._pair:
            if len(self._pair) > 200_000:
                self._pair.clear()
            value = pair_value(self._hash(before)[1], self._hash(word)[0])
            mask = (1 << PAIR_BITS) - 1
            # what chance gives a counter doesn't count
            count = min(int(self.pairs[value & mask]), int(self.pairs[(value >> PAIR_BITS & mask) + mask + 1])) - (3 + 2 * self.n_pairs / len(self.pairs))
            share = max(0.0, count) / max(1, self.n_pairs) / self.words[before]
            self._pair[before, word] = -math.log(0.5 * self.words[word] + 0.5 * min(1.0, share))
        return self._pair[before, word]

    def _hash(self, word: str) -> tuple[int, int]:
        """The hashes of a known word's first and last run of letters."""
        if word not in self._hashes:
            flat = word_hashes([word])[0]
            self._hashes[word] = (int(flat[0]), int(flat[-1])) if len(flat) else (0, 0)
        return self._hashes[word]

    def torn(self) -> frozenset[tuple[str, str]]:
        """Pairs of known words that are cheaper as one word, should a space tear it apart."""
        if self._torn is None:
            out = set()
            for w, c in self.costs.items():
                for k in range(1, len(w)):
                    a, b = w[:k], w[k:]
                    if a in self.costs and b in self.costs and c + COST["space"] + COST["both known"] < self.costs[a] + self.pair_cost(a, b):
                        out.add((a, b))
            self._torn = frozenset(out)
        return self._torn

    def readings(self, text: str) -> tuple[tuple[tuple[str, ...], float, int], ...]:
        """(words, cost of the channel, confusions) of each way to read lower-case ``text``, of no spaces, that is cheaper
        than the text as an unknown word or, if it's a usual one, than itself."""
        if text not in self._read:
            if len(self._read) > 200_000:
                self._read.clear()
            found = self.walk(text)
            if len(text) > 64:
                return found
            self._read[text] = found
        return self._read[text]

    def walk(self, text: str, split: bool = True, most_cost: float = math.inf) -> tuple[tuple[tuple[str, ...], float, int], ...]:
        """The readings of ``text``, of several words or (without ``split``) of one, that cost less than ``most_cost``."""
        own = self.costs.get(text)
        letters = sum(map(str.isalpha, text))
        if letters < 2 or own is not None and own < -math.log(USUAL) or not letters > len(text) / 2 or ORDINAL.fullmatch(text):
            return ()
        marked = letters < len(text) - text.count("-") - text.count("‐")
        short = 0.0 if marked else COST["short"] if len(text) < 3 else COST["shortish"] if len(text) < 4 else 0.0
        # states by place: (last word before, prefix of the word here) -> (cost, confusions, words before). What is so much
        # dearer than the unknown word up to there doesn't catch up
        states: list[dict[tuple[str | None, str], tuple[float, int, tuple[str, ...]]]] = [{} for _ in range(len(text) + 1)]
        states[0][None, ""] = (0.0, 0, ())
        most = 1 if own is not None and not marked else len(text)  # a known word has one confusion at most
        prefixes, costs, whole = self.prefixes, self.costs, min(most_cost, self.cost(text))
        for k in range(len(text)):
            here = states[k]
            states[k] = {}
            if not here:
                continue
            line = min(whole, COST["unknown"] + COST["letter"] * max(0, k - 9) + SLACK)
            if split and own is None and 1 < k < len(text) - 1:  # words run together
                for (last, prefix), (cost, n, words) in list(here.items()):
                    if len(prefix) > 1 and prefix in costs and (c := cost + COST["split"] + self.pair_cost(last, prefix)) < line:
                        _keep(here, (prefix, ""), (c, n, (*words, prefix)))
            one, two = text[k], text[k : k + 2]
            for (last, prefix), (cost, n, words) in here.items():
                # a first word costs what the cheapest word of its prefix does, at least
                least = 0.0 if words else 1.0
                if (c := prefixes.get(longer := prefix + one)) is not None and cost + least * c < line:
                    _keep(states[k + 1], (last, longer), (cost, n, words))
                if n >= most:
                    continue
                more = cost + (COST["again"] if n else short)
                if one in STRAY and 0 < k < len(text) - 1 and more + COST["mark"] < line:
                    _keep(states[k + 1], (last, prefix), (more + COST["mark"], n + 1, words))
                for read in (one, two) if len(two) > 1 else (one,):
                    for v in MEANT.get(read, ()):
                        if (c := prefixes.get(longer := prefix + v)) is not None:
                            value = more + COST["confusion" if one.isalpha() else "mark"]
                            if value + least * c < line:
                                _keep(states[k + len(read)], (last, longer), (value, n + 1, words))
        out = []
        for (last, prefix), (cost, n, words) in states[-1].items():
            if prefix in costs and (n or words) and len(prefix) > 1 and all(p.isalpha() for p in prefix.split("-")):
                total = cost + self.pair_cost(last, prefix)
                if total < whole:  # the cost of the first word is left to the way, which knows the word before
                    out.append(((*words, prefix), total - self.cost((*words, prefix)[0]), n))
        return tuple(sorted(out, key=lambda x: x[1]))

    def stand(self, tokens: list[str]) -> bool:
        """Whether the tokens of a line stand as they are: known words without another reading, of which no two are one that
        a space tore apart, and what is no word."""
        own = set(tokens)
        for t in own - self._fine:
            body = t.strip(EDGES)
            if body in self.words and not self.readings(body) or sum(map(str.isalpha, body)) < 2 or "." in body or ORDINAL.fullmatch(body):
                if len(self._fine) > 200_000:
                    self._fine.clear()
                self._fine.add(t)
            else:
                return False
        if self._left.isdisjoint(own):
            return True
        bodies = [t.strip(EDGES) for t in tokens]
        return self.torn().isdisjoint(zip(bodies, bodies[1:]))

    def meant(self, word: str) -> tuple[str, int] | None:
        """(the word that was misread as lower-case ``word``, confusions), or None if it stands as it is."""
        best = min((r for r in self.readings(word) if r[2] and len(r[0]) == 1), key=lambda r: r[1] + self.cost(r[0][0]), default=None)
        return (best[0][0], best[2]) if best else None


def _keep(states: dict, key: tuple, value: tuple[float, int]) -> None:
    if key not in states or value < states[key]:
        states[key] = value


def furniture(lines: list[str], corpus: Corpus) -> list[int]:
    """The lines that are running headings, footings or page numbers: they stand between lines of the text."""
    filled = [k for k, line in enumerate(lines) if line.strip()]
    out = []
    for at, k in enumerate(filled):
        line = lines[k].strip()
        if at == 0:
            continue
        before, after = lines[filled[at - 1]].strip(), lines[filled[at + 1]].strip() if at + 1 < len(filled) else ""
        if PAGE.fullmatch(line) or ROMAN.fullmatch(line):
            if line.isdigit():
                if at + 1 == len(filled) and not (out and out[-1] == filled[at - 1]) and k == filled[at - 1] + 1:
                    continue
                prev, succ = (TOKEN.findall(before.lower()) or [""])[-1], (TOKEN.findall(after.lower()) or [""])[0]
                apart = k > filled[at - 1] + 1 or out and out[-1] == filled[at - 1]
                if not apart and (core(prev), core(succ)) in corpus.numbers and not core(prev).isdigit():
                    continue  # a number of the text on a line of its own
            out.append(k)
        elif title_like(re.sub(r"[|—–·_].*$", "", line) or line) or title_like(line):
            words = set(re.findall(r"[^\W\d_]+", line.lower()))
            usual = heading_form(line) in corpus.heads
            if (len(words & HEAD_WORDS) >= 2 or words & HEAD_WORDS and PAGE_PART.search(line) or usual) and not LIST_MARK.match(line):
                out.append(k)
    return out


class Stream:
    """The de-lined text, a line feed between its lines, and its words: where they begin and end, in lower case."""

    def __init__(self, lines: list[str]):
        self.text = "\n".join(lines)
        low = self.text.lower()
        if len(low) != len(self.text):  # a few letters have another length in lower case
            low = "".join(c if len(c.lower()) > 1 else c.lower() for c in self.text)
        self.words: list[str] = []
        self.start: list[int] = []
        self.end: list[int] = []
        for m in TOKEN.finditer(low):
            word, (at, end) = m.group(), m.span()
            if not word[0].isalnum() or not word[-1].isalnum():
                body = word.strip(EDGES)
                if not body:
                    continue
                at += word.index(body)
                word, end = body, at + len(body)
            self.words.append(word)
            self.start.append(at)
            self.end.append(end)
        self.low = low

    def gap(self, k: int) -> tuple[str, bool] | None:
        """(hyphen, whether a line ends) between word k and the next, if nothing else is there."""
        m = GAP.fullmatch(self.low, self.end[k], self.start[k + 1])
        return (m.group("hyphen"), bool(m.group("end"))) if m and m.end() > m.start() else None


def _doubtful(s: Stream, corpus: Corpus) -> list[int]:
    """The words that the decoder has a choice for: those with other readings, and those at whose end they may be joined
    with the next."""
    words, out = corpus.words, []
    n = len(s.words)
    last = n - 1 if n and not re.search(r"[.!?]", s.text[s.end[-1] :]) else -1  # a text that breaks off ends in a part of a word
    torn = corpus.torn()
    for k, w in enumerate(s.words):
        share = words.get(w, 0.0)
        if k + 1 < n:
            v = s.words[k + 1]
            line = s.low.find("\n", s.end[k], s.start[k + 1]) >= 0
            if line and (share == 0.0 or v not in words or w + v in words or s.low[s.end[k]] in HYPHENS):
                if _letters(w) and _letters(v) and s.gap(k):
                    out.append(k)
                    continue
            elif not line and ((share == 0.0 or v not in words) and (w + v in words or share == 0.0 and v not in words and corpus.walk(w + v, False, corpus.alone(w) + corpus.alone(v) - COST["space"])) or (w, v) in torn):
                if _letters(w) and _letters(v) and s.gap(k):
                    out.append(k)
                    continue
        if share < USUAL and corpus.readings(w) and not ("@" in w and MAIL.search(s.low, max(0, s.start[k] - 1), min(len(s.low), s.end[k] + 40))):
            out.append(k)
    return out


def _letters(word: str) -> bool:
    return sum(map(str.isalpha, word)) > 0


def _edges(s: Stream, k: int, stop: int, last: int, corpus: Corpus) -> Iterator[tuple[int, tuple[str, ...], float, str, str | None]]:
    """(words of the stream taken, words read, cost beside the words', shown, kind) of the lattice's edges from word k."""
    yield 1, (s.words[k],), 0.0, s.text[s.start[k] : s.end[k]], None
    joined, raw, cost, known, broken = s.words[k], s.text[s.start[k] : s.end[k]], 0.0, s.words[k] in corpus.words, None
    apart = corpus.alone(joined)
    mail = "@" in joined and MAIL.search(s.low, max(0, s.start[k] - 1), min(len(s.low), s.end[k] + 40))
    if not mail:
        for words, channel, n in corpus.readings(joined):
            if k == last and n:
                continue
            yield 1, words, channel, _shown(raw, words, n), "misread" if n else "run together"
    for j in range(k, stop - 1):
        gap = s.gap(j)
        if gap is None or not _letters(s.words[j]) or not _letters(s.words[j + 1]) or mail:
            return
        hyphen, line = gap
        if hyphen and not line:
            return
        if line:
            if hyphen in ("-", "‐", "‑"):
                whole = f"{s.words[j]}-{s.words[j + 1]}"
                if j == k and (whole in corpus.words or s.words[j] in corpus.words and s.words[j + 1] in corpus.words):  # a compound at its own hyphen
                    yield 2, (s.words[j], s.words[j + 1]) if whole not in corpus.words else (whole,), 0.0, f"{raw}{hyphen}{s.text[s.start[j + 1] : s.end[j + 1]]}", None
            known = known and s.words[j + 1] in corpus.words
            cost += COST["hyphen"] if hyphen else COST["line"] + COST["both known"] * known
        else:
            known = known and s.words[j + 1] in corpus.words
            cost += COST["space"] + COST["both known"] * known
        broken = "broken" if line or broken == "broken" else "merged"
        joined += s.words[j + 1]
        raw += s.text[s.start[j + 1] : s.end[j + 1]]
        own = corpus.costs.get(joined)
        if own is not None or hyphen and (hyphen in SOFT or hyphen == "-" and not known):
            yield j + 2 - k, (joined,), cost, raw, broken
        apart += corpus.alone(s.words[j + 1])
        # when each word by itself costs no more than a join, a correction and the most usual word, no reading is cheaper
        if cost + COST["mark"] + corpus.cheapest >= apart:
            return
        if own is None and j + 1 != last and not known:
            for words, channel, n in corpus.walk(joined, False, apart - cost):
                yield j + 2 - k, words, cost + channel, _shown(raw, words, n), broken


def way(s: Stream, corpus: Corpus) -> list[tuple[int, int, str, str]]:
    """(first word, words taken, shown, kind) of the edges of the cheapest way that aren't the words as they are.

    The program runs over each stretch of doubtful words with their neighbours. best has, for the place behind each word, the
    cheapest way to it for each word that was read last, as the next word's cost depends on that.
    """
    doubt = _doubtful(s, corpus)
    if not doubt:
        return []
    n = len(s.words)
    last = n - 1 if not re.search(r"[.!?]", s.text[s.end[-1] :]) else -1
    out, at = [], 0
    while at < len(doubt):
        first = begin = doubt[at]
        stop = begin + 2
        while at + 1 < len(doubt) and doubt[at + 1] <= stop:
            at += 1
            stop = doubt[at] + 2
        at += 1
        stop = min(n, stop + 1)
        begin = max(0, begin - 1)
        chance = set(doubt)
        before = s.words[begin - 1] if begin else None
        best: list[dict[str | None, tuple[float, int, str | None, tuple | None]]] = [{} for _ in range(stop - begin + 1)]
        best[0][before] = (0.0, 0, None, None)
        for k in range(begin, stop):
            if not best[k - begin]:
                continue
            edges = list(_edges(s, k, stop, last, corpus)) if k in chance or k + 1 in chance or k == first else [(1, (s.words[k],), 0.0, "", None)]
            soft = COST["soft hyphen"] if s.low[s.end[k] : s.end[k] + 1] in SOFT and s.end[k] < len(s.low) else 0.0
            for prev, (cost, *_rest) in best[k - begin].items():
                for size, words, channel, shown, kind in edges:
                    if k + size > stop:
                        continue
                    total = cost + channel + corpus.pair_cost(prev, words[0]) + (soft if size == 1 else 0.0)
                    if kind is None and len(words) > 1:
                        total += corpus.pair_cost(words[0], words[1])
                    there = best[k + size - begin]
                    if words[-1] not in there or total < there[words[-1]][0]:
                        there[words[-1]] = (total, k, prev, (k, size, shown, kind) if kind or size > 1 else None)
        k = stop
        word = min(best[k - begin], key=lambda w: best[k - begin][w][0])
        while k > begin:
            _, k2, prev, edge = best[k - begin][word]
            if edge:
                out.append(edge)
            k, word = k2, prev
    return sorted(out)


def _shown(raw: str, words: tuple[str, ...], n: int) -> str:
    """The words read, in the case in which they were written."""
    if not n:
        out, at = [], 0
        for w in words:
            out.append(raw[at : at + len(w)])
            at += len(w)
        return " ".join(out)
    letters = [c for c in raw if c.isalpha()]
    text = " ".join(words)
    if len(letters) > 1 and all(c.isupper() for c in letters):
        return text.upper()
    return text[0].upper() + text[1:] if raw[0].isupper() else text


def _open(lines: list[str], corpus: Corpus) -> bool:
    """Whether a line of known words may go on in a word of the next line."""
    for x, y in zip(lines, lines[1:]):
        left, right = x.split()[-1], y.split()[0]
        if left[-1] in HYPHENS or (a := left[-1:].isalpha() and TOKEN.findall(left.lower())) and (b := TOKEN.findall(right.lower())) and a[-1] + core(b[0]) in corpus.words:
            return True
    return False


def _choices(lines: list[str], corpus: Corpus) -> list[tuple[int, int, str, str]]:
    """The corrections and joins in the lines of a text; where nothing can be read in another way the program isn't run."""
    if not (all(corpus.stand(TOKEN.findall(x.lower())) for x in lines) and not _open(lines, corpus)):
        return way(Stream(lines), corpus)
    return []


def _delined(text: str, corpus: Corpus) -> tuple[list[str], set[int]]:
    """The lines of a text and which of them are furniture."""
    lines = _lines(text)
    return lines, set(furniture(lines, corpus)) if len(lines) > 1 else set()


def traces(text: str, corpus: Corpus) -> set[str]:
    """The kinds of traces in a text: "heading" for lines that are dropped, "broken", "misread", "merged" and "run
    together" for what the cheapest way through the rest does. Only those of ``TRACES`` make it a scanned one."""
    lines, gone = _delined(text, corpus)
    rest = [x for k, line in enumerate(lines) if k not in gone and (x := line.strip(" \t\xa0"))]
    return {"heading"} & {"heading" if gone else ""} | {kind for *_, kind in _choices(rest, corpus) if kind}


def _read(lines: list[str], corpus: Corpus) -> str:
    """The lines as one stream in its cheapest reading, spaces as they are."""
    s = Stream(lines)
    out, at = [], 0
    for k, size, shown, _ in way(s, corpus):
        out += [s.text[at : s.start[k]], shown]
        at = s.end[k + size - 1]
    return "".join([*out, s.text[at:]])


def paragraphs(lines: list[str]) -> list[list[str]]:
    """Lines in paragraphs: the boundaries with the least cost. best[k] is the least cost of the first k lines; an edge is
    a paragraph, and costs more if it begins or ends within a sentence, crosses an empty line or a list mark, or goes
    on behind a line that ended short of the width."""
    full = [k for k, x in enumerate(lines) if x.strip()]
    if not full:
        return []
    width = sorted(len(lines[k].rstrip()) for k in full)[(9 * len(full)) // 10]
    n = len(full)
    # cost of joining line k to the one before, and of breaking there
    join, split = [0.0] * n, [0.0] * n
    for k in range(1, n):
        x, y = lines[full[k - 1]].rstrip(), lines[full[k]].lstrip()
        ended, empty = bool(ENDED.search(x)), full[k] > full[k - 1] + 1
        join[k] = 2.0 * empty * ended + 4.0 * bool(LIST_MARK.match(y)) * ended + 1.0 * (ended and len(x) < 0.6 * width) + 3.0 * (k == 1 and x.isupper())
        split[k] = 1.0 + 4.0 * (not ended and not x.isupper()) + 2.0 * (y[:1].islower())
    best, back, reach = [0.0] + [math.inf] * n, [0] * (n + 1), [0.0] * (n + 1)
    for k in range(n):
        reach[k + 1] = reach[k] + join[k]
    start, since = 0, math.inf
    for e in range(1, n + 1):
        # the joins within a paragraph are sums, so the cheapest beginning so far stays the cheapest until a new one is
        value = best[e - 1] + (split[e - 1] if e > 1 else 0.0) - reach[e]
        if value <= since:
            start, since = e - 1, value
        best[e], back[e] = since + reach[e], start
    out, e = [], n
    while e > 0:
        out.append([lines[full[k]].strip() for k in range(back[e], e)])
        e = back[e]
    return out[::-1]


def repair(text: str, corpus: Corpus) -> str:
    """A scanned text as paragraphs with an empty line between them. A text without a trace of scanning stays as it is,
    but for words with spaces in wrong places."""
    found = traces(text, corpus)
    if found.isdisjoint(TRACES):
        return "".join(part if k % 2 else _read([part], corpus) for k, part in enumerate(re.split(f"({LINE.pattern})", text))) if found else text
    lines, gone = _delined(text, corpus)
    # what stands around a heading goes on across it
    kept, last_gone = [], False
    for k, line in enumerate(lines):
        if k in gone:
            while kept and not kept[-1].strip():
                kept.pop()
            last_gone = True
        elif line.strip() or not last_gone:
            kept.append(line)
            last_gone = False
    return "\n\n".join(" ".join(_read([x.strip(" \t\xa0") for x in paragraph], corpus).split()) for paragraph in paragraphs(kept))


def _count(column: str):
    """Words, words around inline numbers and title-like lines of a task's texts, with the numbers of texts and tokens."""
    words: Counter[str] = Counter()
    numbers: Counter[str] = Counter()
    heads: Counter[str] = Counter()
    total = Counter()

    def add(batch: pa.RecordBatch) -> bool:
        for t in texts(batch.column(column)):
            tokens = TOKEN.findall(t.lower())
            words.update(tokens)
            total["texts"] += bool(tokens)
            for k, x in enumerate(tokens):
                if x.isdigit() and 0 < k < len(tokens) - 1:
                    numbers[f"{core(tokens[k - 1])} {core(tokens[k + 1])}"] += 1
            if "\n" in t or "\r" in t:
                heads.update({heading_form(x) for x in _lines(t)[1:] if len(x) > 4 and title_like(x.strip())})
        return len(words) + len(numbers) + len(heads) > KEPT

    def flush() -> Iterator[pa.RecordBatch]:
        cores: Counter[str] = Counter()
        for w, c in words.items():
            total["tokens"] += c
            w = core(w)
            if w and any(x.isalpha() for x in w) and not ("@" in w and "." in w):
                cores[w] += c
        rows = [(what, v, c) for what, counts in (("word", cores), ("number", numbers), ("head", heads)) for v, c in counts.items()]
        rows += [(what, "", total[what]) for what in ("texts", "tokens")]
        for counts in (words, numbers, heads, total):
            counts.clear()
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows]), pa.array([r[1] for r in rows]), pa.array([r[2] for r in rows], pa.int64())], ["what", "value", "n"])

    return add, flush


def corpus_of(df: DataFrame, column: str = "clause") -> Corpus:
    """Counts over all texts. What comes to the driver has a share of all tokens or texts, so its number is bounded at
    any size of input: 1 / WORD_SHARE words, 1 / CONTEXT_SHARE contexts, a few headings for each text at HEAD_SHARE, and
    2 ** (PAIR_BITS + 1) counters of pairs, each pair in two of them."""
    counts = cut(per_task(df.select(column), "what string, value string, n bigint", _count, column).groupBy("what", "value").agg(F.sum("n").alias("n")))
    total = {r["what"]: r["n"] for r in counts.filter("what in ('texts', 'tokens')").collect()}
    tokens, n = max(1, total.get("tokens", 0)), max(1, total.get("texts", 0))
    least = F.when(F.col("what") == "word", max(2.0, WORD_SHARE * tokens)).when(F.col("what") == "number", max(3.0, CONTEXT_SHARE * tokens)).otherwise(max(3.0, HEAD_SHARE * n))
    words, numbers, heads = {}, set(), set()
    for r in counts.filter(~F.col("what").isin("texts", "tokens") & (F.col("n") >= least)).toLocalIterator():
        if r["what"] == "word":
            words[r["value"]] = r["n"] / tokens
        elif r["what"] == "number":
            numbers.add(tuple(r["value"].split(" ", 1)))
        else:
            heads.add(r["value"])
    n_pairs, pairs = counters.table(df, column, pair_slots, PAIR_BITS + 1)
    # a spelling with marks or digits among its letters isn't a word, however often it was misread so
    return Corpus({w: s for w, s in words.items() if w.replace("-", "").replace("‐", "").isalpha()}, frozenset(numbers), frozenset(heads), np.minimum(pairs, 2**32 - 1).astype(np.uint32), n_pairs)


def _apply(key: str, column: str, shared, what: str):
    corpus = shared.value

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        values = batch.column(column).to_pylist()
        if what == "traces":
            found = [traces(v, corpus) if v else set() for v in values]
            keep = pa.array([k for k, f in enumerate(found) if not f.isdisjoint(TRACES)], pa.int64())
            return pa.RecordBatch.from_arrays([batch.column(key).take(keep), pa.array([sorted(f) for f in found if not f.isdisjoint(TRACES)], pa.list_(pa.string()))], [key, "traces"])
        return pa.RecordBatch.from_arrays([batch.column(key), pa.array([repair(v, corpus) if v else v for v in values], pa.string())], [key, "text"])

    return run


def _run(df: DataFrame, key: str, column: str, what: str, schema: str) -> DataFrame:
    shared = df.sparkSession.sparkContext.broadcast(corpus_of(df, column))
    kind = df.schema[key].dataType.simpleString()
    return per_batch(df.select(key, column), f"`{key}` {kind}, {schema}", _apply, key, column, shared, what)


def scanned(df: DataFrame, key: str = "clause_id", column: str = "clause") -> DataFrame:
    """(key, traces) of the texts with traces of scanning. Null, empty and blank texts have none."""
    return _run(df, key, column, "traces", "traces array<string>")


def repaired(df: DataFrame, key: str = "clause_id", column: str = "clause") -> DataFrame:
    """(key, text) of all rows: scanned texts as paragraphs, the others, nulls too, as they are."""
    return _run(df, key, column, "repair", "text string")
