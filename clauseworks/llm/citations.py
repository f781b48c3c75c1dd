"""Problem 5: freely typed citations to the entries of a reference list.

The distinct values are normalised once each: a reference by number becomes the one spelling of that number, any
other value its content words. Equal forms are the same reference. For the others, candidates come from an inverted
index of character n-grams, scored by weighted cosine; the best one above a threshold is chosen, with those within a
margin of it. An exact check follows: words must be misspellings of the entry's words, each of one; numbers are equal or
another reference.
"""

from __future__ import annotations

import math
import re
import unicodedata
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from clauseworks.llm.arrow import per_batch, texts
from clauseworks.session import cut

# Long names of the acts that the list's codes abbreviate.
ACT_NAMES = {"rta": "residential tenancies act"}
# Number words.
UNITS = dict(zip("zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen".split(), range(20)))
TENS = dict(zip("twenty thirty forty fifty sixty seventy eighty ninety".split(), range(20, 100, 10)))
# Words that name a part of an act, in English and French, and words without a meaning of their own.
SECTION = {"s", "ss", "sec", "secs", "sect", "section", "sections", "art", "arts", "article", "articles"}
SUBSECTION = {"subs", "subsec", "subsection", "subsections", "sub", "par", "para", "paragraph", "paragraphe", "al", "alinea"}
REGULATION = {"reg", "regs", "regulation", "regulations", "regl", "reglement"}
FILLERS = {"of", "the", "de", "la", "le", "du", "des", "no", "and", "et", "re", "see", "under", "voir", "provision", "provisions", "on", "in", "to", "for", "over", "about", "tied", "sur", "aux", "au"}
THRESHOLD, MARGIN, GRAM, MOST_EDITS = 0.4, 0.02, 3, 3
MAX_ENTRIES, BROADCAST_BYTES = 100_000, 64_000_000
HOT_SHARE = 1e-4  # of all entries, from which on a value's meaning is sent to all tasks
TOKEN = re.compile(r"\d+|[^\W\d_]+|§|[()]")
# digits that were typed or read as letters, within a number or as the whole of a bracket
LOOKALIKE = re.compile(r"(?<![^\W_])(?=[\dlo]*\d)[\dlo]+(?![^\W_])|(?<=\()[l](?=\))")
ROMAN = re.compile(r"\(\s*(x{0,2}(?:ix|iv|v?i{0,3}))\s*\)")


def plain(value: str) -> str:
    """Lower case without accents, full-width forms and repeated space."""
    folded = unicodedata.normalize("NFKD", unicodedata.normalize("NFKC", value)).lower()
    return " ".join("".join(c for c in folded if not unicodedata.combining(c)).split())


def _roman(text: str) -> int:
    values = [{"i": 1, "v": 5, "x": 10}[c] for c in text]
    return sum(-v if v < max(values[k:]) else v for k, v in enumerate(values))


def _numbers(words: list[str]) -> list[str]:
    """``words`` with number words as digits ("one hundred and sixty five" is 165)."""
    out: list[str] = []
    k = 0
    while k < len(words):
        total = part = 0
        j, seen = k, False
        while j < len(words):
            w = words[j]
            if w in UNITS and part % 10 == 0 and (part % 100 == 0 or UNITS[w] < 10):
                part += UNITS[w]
            elif w in TENS and part % 100 == 0:
                part += TENS[w]
            elif w == "hundred" and 0 < part < 10:
                part *= 100
            elif w == "and" and seen and part % 100 == 0 and j + 1 < len(words) and (words[j + 1] in UNITS or words[j + 1] in TENS):
                pass
            else:
                break
            seen, j = True, j + 1
        total += part
        if seen:
            out.append(str(total))
            k = j
        else:
            out.append(words[k])
            k += 1
    return out


def within(a: str, b: str, most: int) -> int | None:
    """The edits (insertion, loss, change, swap of neighbours) from ``a`` to ``b``, or None above ``most``."""
    if abs(len(a) - len(b)) > most:
        return None
    two, one = None, list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            best = min(one[j] + 1, row[j - 1] + 1, one[j - 1] + (x != y))
            if two is not None and j > 1 and x == b[j - 2] and a[i - 2] == y:
                best = min(best, two[j - 2] + 1)
            row.append(best)
        if min(row) > most:
            return None
        two, one = one, row
    return one[-1] if one[-1] <= most else None


def slack(word: str) -> int:
    return 0 if len(word) < 3 else 2 if len(word) < 8 else 3


@lru_cache(maxsize=100_000)
def _is_act(words: tuple[str, ...]) -> str | None:
    """The act that ``words`` name, written out, abbreviated word by word or run together."""
    joined = "".join(words)
    for short, name in ACT_NAMES.items():
        parts = name.split()
        if joined == short or len(words) == 1 and within(joined, name.replace(" ", ""), 2) is not None:
            return short
        if len(words) == len(parts) and all(
            len(w) >= 3 and (p.startswith(w) or within(w, p, slack(p)) is not None or any(within(w, p[:k], 1) is not None for k in range(3, len(p)) if len(w) >= 5))
            for w, p in zip(words, parts)
        ):
            return short
    return None


def _act(words: list[str], acts: frozenset[str]) -> tuple[str | None, list[str]]:
    """The act in ``words`` and the other words."""
    for size in (3, 2, 1):
        for k in range(len(words) - size + 1):
            some = tuple(words[k : k + size])
            act = _is_act(some) or (some[0] if size == 1 and some[0] in acts else None)
            if act is None and size == 3 and all(len(w) == 1 for w in some) and "".join(some) in acts:
                act = "".join(some)  # an abbreviation with points
            if act in acts:
                return act, words[:k] + words[k + size :]
    return None, words


def normalise(value: str, acts: frozenset[str]) -> tuple[str, str]:
    """(kind, form) of a value: kind "number" with the one spelling of a reference by number, "words" with content
    words in order, or "none" for a value that can't mean an entry."""
    text = plain(value)
    text = LOOKALIKE.sub(lambda m: m.group().replace("l", "1").replace("o", "0"), text)
    text = re.sub(r"\b(s|sec|ss|art|reg)\.?(\d)", r"\1 \2", text)
    text = ROMAN.sub(lambda m: f"({_roman(m.group(1))})" if m.group(1) else m.group(), text)
    act, tokens = _act(TOKEN.findall(text), acts)  # before number words, as "Ten." may stand for tenancies
    tokens = _numbers(tokens)
    numbers = [t for t in tokens if t.isdigit()]
    words = [t for t in tokens if not t.isdigit() and t not in "§()"]
    names = [t for t in words if t not in FILLERS]
    parts = [t for t in names if t in SECTION or t in SUBSECTION or t in REGULATION]
    other = [t for t in names if t not in SECTION and t not in SUBSECTION and t not in REGULATION]
    if not numbers:
        return ("words", " ".join(words)) if other and not parts else ("none", "")
    found = _reference(tokens)
    if found is None or act is None:
        return "none", ""
    if other and not (parts and text.find(" - ") > 0):  # words of another act; a heading behind the number is no harm
        return "none", ""
    return "number", " ".join([act, *found])


def _reference(tokens: list[str]) -> list[str] | None:
    """[(reg, number,) section(, subsection)] of the numbers in ``tokens``, by the words and brackets before them."""
    section = subsection = regulation = None
    label, depth = "", 0
    for t in tokens:
        if t == "(":
            depth += 1
        elif t == ")":
            depth = max(0, depth - 1)
        elif t.isdigit():
            number = str(int(t))
            if label == "reg" and regulation is None:
                regulation, label = number, ""
            elif (label == "sub" or depth and section is not None and label != "sec") and subsection is None:
                subsection, label = number, ""
            elif section is None:
                section, label = number, ""
            elif subsection is None and label != "sec":
                subsection, label = number, ""
            else:
                return None
        elif t in REGULATION:
            label = "reg"
        elif t in SUBSECTION:
            label = "sub"
        elif t in SECTION or t == "§":
            label = "sec"
    if section is None:
        return None
    return [*(["reg", regulation] if regulation else []), "s", section, *([subsection] if subsection else [])]


def meant(value: str, entry: str, most: int = MOST_EDITS) -> int | None:
    """The edits by which the words of ``value`` are those of ``entry``, in any order; None if a word is another.

    Words without a meaning of their own may be missing or added, misspelled too.
    """
    words, total = value.split(), 0
    for part in sorted((w for w in entry.split() if w not in FILLERS), key=len, reverse=True):
        best = min(((d, k) for k, w in enumerate(words) if (d := within(w, part, slack(part))) is not None), default=None)
        if best is None:
            return None
        total += best[0]
        words.pop(best[1])
    for w in words:  # what is left must be a misspelled filler
        if len(w) > 1 and not any(within(w, f, 1 if len(f) < 4 else 2) is not None for f in FILLERS):
            return None
    return total if total <= most else None


def _normalise(acts: frozenset[str], column: str):
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        forms = [normalise(v, acts) for v in texts(batch.column(column))]
        return pa.RecordBatch.from_arrays([batch.column(column), pa.array([f[0] for f in forms]), pa.array([f[1] for f in forms])], [column, "kind", "form"])

    return run


def _grams(form: str):
    padded = F.concat(F.lit(" " * (GRAM - 1)), F.col(form), F.lit(" "))
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(padded) - (GRAM - 1)), lambda k: F.substring(padded, k, GRAM)))


def _check(batch_columns: tuple[str, ...]):
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        form, entry = (batch.column(c).to_pylist() for c in ("form", "entry_form"))
        edits = [meant(f, e) for f, e in zip(form, entry)]
        return pa.RecordBatch.from_arrays([*(batch.column(c) for c in batch_columns), pa.array(edits, pa.int32())], [*batch_columns, "edits"])

    return run


def bounded(df: DataFrame, rows: int, bytes_each: int) -> DataFrame:
    """``df`` to be broadcast if its ``rows`` of ``bytes_each`` are at most ``BROADCAST_BYTES``; else the join is Spark's choice."""
    return F.broadcast(df) if rows * bytes_each <= BROADCAST_BYTES else df


def resolve(values: DataFrame, entries: DataFrame, threshold: float = THRESHOLD, margin: float = MARGIN) -> DataFrame:
    """(value, section_id, score) of each distinct ``value``; -1 where it means none of ``entries``.

    ``entries`` has section_id, code and heading and at most ``MAX_ENTRIES`` rows. A value of an entry's very form means
    it, with the score 1. Any other value of words means the entry with the highest cosine, from ``threshold`` on, if
    its words are misspellings of that entry's; of entries within ``margin`` of the highest the one with the fewest
    edits, then the highest cosine, then the lowest id.
    """
    spark = values.sparkSession
    rows = entries.select("section_id", "code", "heading").limit(MAX_ENTRIES + 1).collect()
    if len(rows) > MAX_ENTRIES:
        raise ValueError(f"more than {MAX_ENTRIES} entries")
    acts = frozenset(ACT_NAMES) | {m.group().lower() for r in rows if r["code"] and (m := re.match(r"[^\W\d_]{2,}", r["code"]))}
    forms = [(r["section_id"], *normalise(text, acts)) for r in rows for text in (r["code"], r["heading"]) if text and r["section_id"] is not None]
    forms = [f for f in forms if f[1] != "none"]
    n = max(1, len(forms))
    letters = sum(len(f[2]) for f in forms)
    listed = spark.createDataFrame(forms, "section_id int, kind string, entry_form string")
    # every form once, in as many tasks as a shuffle has, as a form's grams and candidates are many times its size
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    forms_of = per_batch(values.select("value"), "value string, kind string, form string", _normalise, acts, "value")
    known = forms_of.filter("kind <> 'none'").select("kind", "form").distinct()
    same = bounded(listed.groupBy("kind", F.col("entry_form").alias("form")).agg(F.min("section_id").alias("section_id")), n, 100 + letters // n)
    exact = known.join(same, ["kind", "form"]).withColumn("score", F.lit(1.0))
    words = known.filter("kind = 'words'").join(same, ["kind", "form"], "left_anti").select("form").repartition(tasks, "form")
    own = listed.filter("kind = 'words'").drop("kind").withColumn("gram", F.explode(_grams("entry_form")))
    weight = own.groupBy("gram").agg(F.log(F.lit(1.0 + n) / F.count("*")).alias("w"))
    index = own.join(weight, "gram")
    norms = index.groupBy("section_id", "entry_form").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("entry_norm"))
    rare = F.coalesce("w", F.lit(math.log(1.0 + n)))
    grams = words.withColumn("gram", F.explode(_grams("form"))).join(bounded(weight, letters + 2 * n, 60), "gram", "left")
    weighed = grams.groupBy("form").agg(F.sqrt(F.sum(rare * rare)).alias("norm"), F.collect_list(F.when(F.col("w").isNotNull(), F.struct("gram", "w"))).alias("grams"))
    best = Window.partitionBy("form")
    scored = (
        weighed.select("form", "norm", F.explode("grams").alias("g"))
        .select("form", "norm", "g.gram", "g.w")
        .join(bounded(index.drop("w"), letters + 2 * n, 100 + letters // n), "gram")
        .groupBy("form", "norm", "section_id", "entry_form")
        .agg(F.sum(F.col("w") * F.col("w")).alias("dot"))
        .join(bounded(norms, n, 100 + letters // n), ["section_id", "entry_form"])
        .withColumn("score", F.col("dot") / (F.col("norm") * F.col("entry_norm")))
        .filter(F.col("score") >= threshold)
        .withColumn("top", F.max("score").over(best))
        .filter(F.col("score") >= F.col("top") - margin)
        .select("form", "section_id", "entry_form", "score")
    )
    checked = per_batch(scored, "form string, section_id int, entry_form string, score double, edits int", _check, tuple(scored.columns)).filter("edits is not null")
    w = best.orderBy("edits", F.desc("score"), "section_id")
    chosen = checked.withColumn("rank", F.row_number().over(w)).filter("rank = 1").select(F.lit("words").alias("kind"), "form", "section_id", "score")
    return forms_of.join(exact.unionByName(chosen), ["kind", "form"], "left").select("value", F.coalesce("section_id", F.lit(-1)).alias("section_id"), "score")


def map_citations(results: DataFrame, entries: DataFrame, key: str = "result_id", array: str = "citations", **parameters) -> DataFrame:
    """(key, pos, value, section_id, score) of each entry of ``array`` that is neither null nor blank nor a code.

    ``pos`` counts from 0, with nulls and blanks. ``section_id`` is -1 for an entry that means no row of ``entries``.
    Null and empty arrays give no row, repeated rows one each. With an empty list, every entry is reported.
    """
    filled = F.col("value").rlike(r"[^\s\p{Z}\x{200B}\x{FEFF}]")
    every = results.select(key, F.posexplode(array).alias("pos", "value")).filter(filled)
    codes = F.broadcast(entries.select(F.col("code").alias("value")).distinct())  # resolve checks its size
    free = every.join(codes, "value", "left_anti")
    counted = free.groupBy("value").agg(F.count("*").alias("n"))
    total = counted.agg(F.sum("n").alias("total"))
    resolved = cut(resolve(counted.select("value"), entries, **parameters).join(counted, "value").crossJoin(F.broadcast(total)))  # one row
    # what many rows say is sent to all tasks, by a hash: at most 1 / HOT_SHARE values; the others are joined by value
    hot = resolved.filter(F.col("n") >= HOT_SHARE * F.col("total")).select(F.md5("value").alias("hash"), F.col("section_id").alias("hot_section"), F.col("score").alias("hot_score"), F.lit(True).alias("hot"))
    each = free.withColumn("hash", F.md5("value")).join(F.broadcast(hot), "hash", "left")
    often = each.filter("hot").select(key, "pos", "value", F.col("hot_section").alias("section_id"), F.col("hot_score").alias("score"))
    seldom = each.filter("hot is null").select(key, "pos", "value").join(resolved.filter(F.col("n") < HOT_SHARE * F.col("total")).select("value", "section_id", "score"), "value")
    return often.unionByName(seldom)
