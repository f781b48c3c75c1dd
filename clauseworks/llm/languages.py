"""The language of a text by its function words."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable

# Frequent function words by language, without those that are frequent in another of them.
FUNCTION_WORDS = {
    "en": "the of and is that for not with by be are has have this which it from any each or an if does may must shall will what who no than only about at to under between both their its can cannot was were been on it i you we they he my your our his her but out up there then when where how all some more most other into over after before while also just very",
    "fr": "le la les des du de et est une un à en l dans pour pas que qui sur par avec ce cette aux au sont ne il elle ou mais plus doit peut à été avant après sans selon tout chaque même comme lorsque je nous vous leur leurs son sa ses mon si où aussi très peut être ont fait entre jusqu telle tel tels telles quel quelle va delà ici dont lors donc ni trop concernant celui celle ceux cet",
    "es": "el la los las del y es una un para con por que no se lo su al esta este a de en pero como más sin sobre cada debe puede ser son está hay siempre aunque eso parte quién lo que ni muy tras desde hasta según ya fue han",
    "de": "der die das und ist nicht mit den dem ein eine einen für von zu auf im wird des sich oder dieser diese dass wenn auch nach bei über kann muss sehr sofern ohne obwohl wer durch gegen um wie noch nur aber hat sein ihr einer eines zum zur vom",
    "pt": "o os a um uma de não do da dos das para com por que se em ao esta este mas como mais sem sobre cada deve pode ser são está há seja pelo embora isso quem na no desde até já foi pela aos nem depois antes entre sua seu",
    "it": "il gli della dei di che non con per una sono nel alla questo questa ma come più senza ogni deve può essere è anche",
    "nl": "het een van en is niet met voor op te dat de zijn wordt deze dit maar ook bij naar kan moet zonder elke",
}
_OF: dict[str, list[str]] = {}
for _lang, _words in FUNCTION_WORDS.items():
    for _w in dict.fromkeys(_words.split()):
        _OF.setdefault(_w, []).append(_lang)
WORD = re.compile(r"[^\W\d_]+")


def language(words: Iterable[str], least: float = 2.0, lead: float = 1.5) -> str | None:
    """The language of lower-case ``words``; None without ``least`` function words or a clear lead. A word that
    several languages have counts a part of one for each of them."""
    scores: dict[str, float] = {}
    counts = words if isinstance(words, Counter) else Counter(words)
    for w in _OF.keys() & counts.keys():
        langs = _OF[w]
        for lang in langs:
            scores[lang] = scores.get(lang, 0.0) + counts[w] / len(langs)
    best = sorted(scores.items(), key=lambda x: -x[1])[:2]
    if not best or best[0][1] < least or len(best) > 1 and best[0][1] < lead * best[1][1]:
        return None
    return best[0][0]


def of_text(text: str, **parameters) -> str | None:
    return language(WORD.findall(text.lower()), **parameters)
