"""Problem 6: answers that are empty, cut off, refusals, copies of their clause or in another language.

A clause and its answer are aligned by the containment of the answer's three-word shingles in the clause and, where
it isn't small, by their longest common subsequence, which flags copies. Each sentence is aligned with refusal templates. The
language of either side comes from its function words. Whether an answer breaks off is measured against the
complete sentences of all answers: how sentences that begin alike end, and how long they are at least.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clauseworks.llm.arrow import per_batch, per_task, texts
from clauseworks.llm.citations import SECTION, SUBSECTION, plain
from clauseworks.llm.languages import WORD, language
from clauseworks.llm.neardup import sets
from clauseworks.session import cut

# What stands for an answer that isn't there.
PLACEHOLDERS = set("""
n/a|na|n.a|none|null|nil|nan|undefined|tbd|tba|todo|to do|no answer|no response|no reason|no reason given|not available|not applicable|not provided|not given|empty|blank|pending|unknown|
aucun|aucune|néant|sans objet|s.o|s/o|à venir|à compléter|vide|pas de réponse|sans réponse|ninguno|ninguna|sin respuesta|no aplica|keine|keine angabe|entfällt|nenhum|nenhuma|sem resposta|xxx
""".replace("\n", "").split("|"))  # fmt: skip
# Words that templates name together.
CLASSES = {
    "ACT": "assess evaluate judge review comment answer advise help provide give offer say do that's opine analyse analyze decide express interpret make offering assist".split(),
    "ABLE": "able allowed permitted going willing prepared qualified comfortable authorised authorized position designed free".split(),
    "NO-WAY": "decline refuse pass abstain".split(),
    "WORK": "role scope remit competence mandate purview".split(),
    "RULES": "instructions guidelines rules programming training policy".split(),
    "VIEW": "assessment opinion answer view comment judgment evaluation".split(),
}
# Templates of refusals, token by token; * stands for up to six words, a name in capitals for one of its class.
REFUSALS = """
i cannot * ACT|i am unable to|i am not * ABLE|i will not * ACT|i will not be|something i will * answer|i am going to * NO-WAY
i must NO-WAY|i will NO-WAY|i have to NO-WAY|i need to NO-WAY|i decline to|i refuse to|i would rather not|i prefer not to|i would prefer not|i would have to NO-WAY
i do not provide|i do not give|i do not offer|i do not comment|i do not judge|i do not answer|i do not assess|i do not review|i do not evaluate
what i can help with|what i am able to|what i can do|what i may|outside my WORK|outside of my|beyond my|not my WORK|not my place
no VIEW can be|no VIEW will be|no comment on|no VIEW from me|cannot be provided by me
request declined|request denied|request refused|this request is declined|my RULES
as an automated assistant|as an assistant|as an ai|as a language model|as an ai language model
not to me|rather than to me|let us talk about something|can we talk about something|ask someone else
je suis désolé|je suis désolée|je dois refuser|je dois décliner|je ne peux pas|je ne peux * évaluer|je ne suis pas en mesure|je ne suis pas autorisé|je refuse de|je préfère ne pas|je préfère m'abstenir|je ne saurais|je ne donne pas|je ne fournis pas|il m'est impossible|il ne m'est pas possible|en tant qu'assistant|en tant que modèle|mes consignes|mes instructions|pas de mon ressort|pas mon rôle|hors de mon|demande refusée
lo siento|no puedo * evaluar|no puedo * ayudar|no puedo * opinar|no me es posible|debo rechazar|como asistente|es tut mir leid|leider kann ich|ich kann * nicht|ich darf nicht|als assistent|als ki|sinto muito|não posso * avaliar|não posso * ajudar|não me é possível|devo recusar|como assistente
""".strip().replace("\n", "|").split("|")  # fmt: skip
GAP = 6
# Short forms and what they stand for; verbs by which a sentence reports what its subject says.
LONG_FORMS = {"i'm": "i am", "i'd": "i would", "i'll": "i will", "i've": "i have", "can't": "cannot", "won't": "will not", "don't": "do not", "couldn't": "cannot", "wouldn't": "would not", "let's": "let us", "we're": "we are"}
REPORTS = frozenset("say says said state states stated read reads claim claims write writes provide provides declare declares dit disent indique stipule énonce précise dispose dice indica establece sagt besagt diz".split())
SPEAKERS = frozenset("i we my our me je j nous mes mon yo ich eu".split())
PASSIVE = frozenset("be been being that which who".split())
COPY, COPY_LOW, COPY_LCS, COPY_MOVED = 0.7, 0.2, 0.85, 0.5
FRAME_SHARE, FINAL_SHARE, LEAST = 2e-4, 2e-3, 3
KEPT = 500_000  # distinct frames that a task counts before it gives them out
# What has a point and doesn't end a sentence, besides initials.
ABBREVIATIONS = ["Mr", "Mrs", "Ms", "Dr", "Mme", "Mlle", "St", "Ste", "No", "Inc", "Ltd"]
SENTENCE = re.compile(r"(?<=[.!?])(?<![\s.(][A-Z]\.)" + "".join(rf"(?<!\b{a}\.)" for a in ABBREVIATIONS) + r"[\"”»')\]]*\s+(?=[\"“«(\[]*[A-ZÀ-ÖØ-Þ])")
CONTACT = re.compile(r"(?:tel|tél|phone|téléphone|fax|cell|e-?mail|courriel|contact|signed|signé)(?![^\W_])|[^\W\d_][\w.\s-]{0,24}\s?:\s", re.I)
TERMINAL = re.compile(r"[.!?][\"”»’')\]\s]*$|[)\]”»]\s*$")
TOKEN = re.compile(r"[^\W_]+(?:['’.@+_-][^\W_]+)*")
KINDS = ("empty", "refusal", "copy", "other_language", "truncated")


SAID = re.compile(r"[^\W_]+(?:['-][^\W_]+)*|[.!?](?=\s|$)|[;:]")


def _templates() -> dict[str, list[list[tuple[frozenset[str], int]]]]:
    """The templates by their first token: for each token the words that it may be, and how many may stand before it."""
    out: dict[str, list[list[tuple[frozenset[str], int]]]] = {}
    for template in REFUSALS:
        steps, gap = [], 0
        for token in template.split():
            if token == "*":
                gap = GAP
            else:
                steps.append((frozenset(CLASSES.get(token, [token])), gap))
                gap = 0
        for first in steps[0][0]:
            out.setdefault(first, []).append(steps[1:])
    return out


TEMPLATES = _templates()


def aligned(words: list[str], at: int) -> int | None:
    """Where an alignment of a refusal template with ``words`` from place ``at`` on ends: the template's tokens in order,
    with other words only where it has a gap, none of which makes the verb passive or opens another clause."""
    for steps in TEMPLATES.get(words[at], ()):
        places = [at]
        for meant, gap in steps:
            reached = []
            for k in places:
                for j in range(k + 1, min(len(words), k + 2 + gap)):
                    if words[j] in meant:
                        reached.append(j)
                    if words[j] in PASSIVE or not words[j][0].isalnum():
                        break
            places = reached
            if not places:
                break
        else:
            return min(places) + 1
    return None


def is_empty(reason: str) -> bool:
    """Nothing but white space, marks or a placeholder."""
    text = " ".join(re.sub(r"[^\w/.]+", " ", reason.lower()).split()).strip(" ./_")
    return not re.search(r"[^\W_]", text) or text in PLACEHOLDERS


def is_refusal(reason: str) -> bool:
    """A refusal template is aligned with the main statement of a sentence: neither in a quote nor behind a verb that
    reports what somebody else says."""
    text = re.sub(r"«[^»]*»|\"[^\"]*\"|“[^”]*”", " ", reason.lower().replace("’", "'"))
    if TEMPLATES.keys().isdisjoint(words := SAID.findall(text)) and LONG_FORMS.keys().isdisjoint(words):
        return False
    words = [w for short in words for w in LONG_FORMS.get(short, short).split()]
    words = [w for k, w in enumerate(words) if not (w == "not" and k and words[k - 1] == "cannot")]
    words = " ".join(words).replace("can not", "cannot").split()
    start = 0
    for k, w in enumerate(words):
        if w in (".", "!", "?", ";"):
            start = k + 1
        elif w in TEMPLATES and aligned(words, k):
            before = words[start:k]
            reported = next((j for j, v in enumerate(before) if v in REPORTS), None)
            if reported is None or not SPEAKERS.isdisjoint(before[:reported]):
                return True
    return False


def lcs(a: Sequence[str], b: Sequence[str]) -> int:
    """The length of the longest common subsequence, with the rows of its table as bits of one number."""
    where: dict[str, int] = {}
    for k, x in enumerate(a):
        where[x] = where.get(x, 0) | 1 << k
    row, full = (1 << len(a)) - 1, (1 << len(a)) - 1
    for y in b:
        hit = row & where.get(y, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


def frame(sentence: str) -> tuple[str, str, int] | None:
    """(first two words, last word, number of words) of a sentence."""
    words = TOKEN.findall(sentence.lower())
    return (" ".join(words[:2]), words[-1], len(words)) if len(words) > 2 else None


def last_sentence(reason: str) -> str:
    return SENTENCE.split(reason.strip())[-1]


def cut_citation(citations: list[str | None] | None, acts: frozenset[str] = frozenset({"rta"})) -> bool:
    """Whether the last citation breaks off: an open bracket, a part's name without its number, or the beginning of
    the act's or a part's name, also behind a number. Null entries don't count."""
    given = [c for c in citations or () if c is not None]
    if not given:
        return False
    text = plain(given[-1])
    if text.count("(") > text.count(")"):
        return True
    if any(c.isdigit() for c in text):
        behind = re.search(r"\d[^\s\d]*\s(?:[\s,]|(?:of|the|de|la)\s)*([^\d]*)$", text)
        text = behind.group(1).strip() if behind else ""
        if len(text) < 3:
            return False
    if not text:
        return False
    words = re.findall(r"[^\W\d_]+", text)
    if not words or text.endswith(".") and words[-1] not in SECTION | SUBSECTION:
        return False
    last, names = words[-1], {"residential tenancies act", *acts}
    if last in SECTION | SUBSECTION:
        return True
    begun = any(n.startswith(text) and n != text for n in names)
    part = len(words) > 1 and (words[0] in acts or " ".join(words[:-1]) in names) and any(p.startswith(last) for p in ("section", "subsection", "article", "paragraph", "regulation"))
    return begun or part


def cut_reason(reason: str, frames: dict[str, tuple[int, frozenset[str]]], finals: frozenset[str]) -> bool:
    """Whether the answer's last sentence is unfinished."""
    text = reason.rstrip()
    if re.search(r"(?:…|\.\.\.)[\"”»)]*$", text):
        return True
    if re.search(r"(?<![^\W_])(?:ss?|sec|art|no|subs|par|reg)\.$", text, re.I):
        return True
    if TERMINAL.search(text):
        return False
    if re.search(r"[,;:(«“\[–—-]$", text) or text.count('"') % 2 or text.count("«") > text.count("»") or text.count("“") > text.count("”"):
        return True
    sentence = last_sentence(text)
    found = frame(sentence)
    if re.search(r"[@＠]\S*$|\d[\d\s().-]*$", sentence) or CONTACT.match(sentence):
        return False  # a line of its own: a contact or a label with its value
    if found is None:
        words = TOKEN.findall(sentence.lower())
        # one or two words are the beginning of a sentence behind others, and an answer if they are all there is
        return bool(words) and (sentence != text or words[-1] not in finals and len(words[-1]) < 3)
    start, last, n = found
    if start in frames:
        shortest, ends = frames[start]
        return n < shortest or last not in ends
    return last not in finals


def _frames(column: str):
    counts: Counter[tuple[str, str, int]] = Counter()

    def add(batch: pa.RecordBatch) -> bool:
        for reason in texts(batch.column(column)):
            text = reason.strip()
            parts = SENTENCE.split(text)
            if not TERMINAL.search(text):
                parts = parts[:-1]
            counts.update(f for p in parts if (f := frame(p)))
        return len(counts) > KEPT

    def flush() -> Iterator[pa.RecordBatch]:
        rows = [(*f, n) for f, n in counts.items()]
        counts.clear()
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.int32()), pa.array([r[3] for r in rows], pa.int64())], ["start", "last", "words", "n"])

    return add, flush


def sentence_frames(results: DataFrame, reason: str = "reason") -> tuple[dict[str, tuple[int, frozenset[str]]], frozenset[str]]:
    """How the complete sentences of all answers go: for a beginning, the least length and the last words; and the last
    words of all sentences.

    Beginnings need a share of all sentences, last words a share of their beginning's, so their number is bounded
    whatever the input: at most 1 / FRAME_SHARE beginnings with 1 / FINAL_SHARE last words each.
    """
    counted = per_task(results.select(reason), "start string, last string, words int, n bigint", _frames, reason)
    counted = cut(counted.groupBy("start", "last", "words").agg(F.sum("n").alias("n")))  # read several times below
    each = counted.groupBy("start", "last").agg(F.sum("n").alias("n"))
    lengths = counted.groupBy("start", "words").agg(F.sum("n").alias("n"))
    total = each.agg(F.sum("n")).first()[0] or 0
    often = each.groupBy("start").agg(F.sum("n").alias("all")).filter(F.col("all") >= max(LEAST, FRAME_SHARE * total))
    ends = each.join(often, "start").filter((F.col("n") >= F.col("all") * FINAL_SHARE) & (F.col("n") >= 2)).groupBy("start").agg(F.collect_list("last").alias("ends"))
    # lengths below which only a fiftieth of the sentences are don't count: they may be slips of the segmentation
    least = lengths.join(often, "start").selectExpr("start", "words", "sum(n) over (partition by start order by words) as upto", "all").filter("upto > 0.02 * all").groupBy("start").agg(F.min("words").alias("least"))
    frames = {r["start"]: (r["least"], frozenset(r["ends"])) for r in ends.join(least, "start").collect()}
    finals = each.groupBy("last").agg(F.sum("n").alias("n")).filter(F.col("n") >= max(2, 1e-5 * total)).select("last").collect()
    return frames, frozenset(r[0] for r in finals)


def _judge(key: str, shared):
    frames, finals = shared.value

    def run(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        reasons, clauses = texts(batch.column("reason")), texts(batch.column("clause"))
        citations = batch.column("citations").to_pylist()
        a, b = sets(reasons, 3, 0), sets(clauses, 3, 0)
        tag = lambda s: (s[0].astype(np.uint64) << np.uint64(44)) | (s[1] >> np.uint64(20))
        inside = np.isin(tag(a), tag(b))
        n = np.bincount(a[0], minlength=len(reasons))
        share = np.bincount(a[0][inside], minlength=len(reasons)) / np.maximum(n, 1)
        found = [defect(r, c, z, s if k > 1 else None, frames, finals) for r, c, z, s, k in zip(reasons, clauses, citations, share, n)]
        keep = pa.array([k for k, f in enumerate(found) if f], pa.int64())
        return pa.RecordBatch.from_arrays([batch.column(key).take(keep), pa.array([f for f in found if f], pa.string())], [key, "defect"])

    return run


def defect(reason: str, clause: str, citations: list | None, contained: float | None, frames: dict, finals: frozenset) -> str | None:
    """The one defect of an answer: the first of ``KINDS`` that it has."""
    if is_empty(reason):
        return "empty"
    if (contained is None or contained < COPY) and is_refusal(reason):
        return "refusal"
    words = None
    if contained is None or contained >= COPY_LOW:
        words, own = WORD.findall(reason.lower()), WORD.findall(clause.lower())
        if contained is None:
            if words and own and (words == own or len(words) > 2 and " ".join(words) in " ".join(own)):
                return "copy"
        # most of the words in the clause's order; fewer where whole runs of them are the clause's, in another order
        elif lcs(words, own) >= (COPY_MOVED if contained >= COPY else COPY_LCS) * len(words):
            return "copy"
    spoken = language(words if words is not None else WORD.findall(reason.lower()))
    if spoken is not None:
        asked = language(WORD.findall(clause.lower()))
        if asked is not None and asked != spoken:
            return "other_language"
    return "truncated" if cut_reason(reason, frames, finals) or cut_citation(citations) else None


def defects(results: DataFrame, clauses: DataFrame, key: str = "result_id") -> DataFrame:
    """(key, defect) of each defective answer; answers without a defect have no row, repeated deliveries one each.

    ``results`` has key, clause_id, reason and citations, ``clauses`` clause_id and clause. An answer whose clause is
    missing, null, blank or too short to tell its language can't be a copy or in another language, but has the other
    defects. A null reason is empty.
    """
    shared = results.sparkSession.sparkContext.broadcast(sentence_frames(results))
    pairs = results.select(key, "clause_id", "reason", "citations").join(clauses.select("clause_id", "clause"), "clause_id", "left")
    kind = results.schema[key].dataType.simpleString()
    return per_batch(pairs.select(key, "reason", "citations", "clause"), f"`{key}` {kind}, defect string", _judge, key, shared)
