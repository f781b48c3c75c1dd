"""Problem 4: texts that are copies of each other with small edits, without comparing all pairs.

Parity-sketch join. A text is the set of its runs of three words. Hash bits cut the space of all runs into parts;
the parity (XOR of the hashes) of a text's runs within a part is one block of its sketch, and two texts whose sets
differ in d runs differ in at most d blocks. By the pigeonhole principle the pairs sought share blocks, so equal blocks
are joined. Four things make that selective:

* The number of parts follows the size of a text, in bands of powers of two; a text has blocks for two numbers of
  parts, so that texts of neighbouring bands meet. At a similarity of 0.5 two texts may differ in two thirds of
  their runs, and no number of parts leaves a block equal for certain; ``plan`` has so many independent partitions
  that 5 or more blocks are equal in the mean.
* Two equal blocks make a candidate, as unlike texts share one by chance, and more often the more texts there are; where
  the mean is 5, one pair in 25 at the threshold itself has fewer, and hardly any above it.
* Runs that many texts have (``COMMON`` of all texts, counted over all of them in a table of fixed size) are left out
  of the blocks; a group of copies that is itself a large part of all texts meets on blocks of common runs. If the
  similarity of two texts is at least t, so is that of their rare runs or that of their common ones. So every text
  also has blocks of the parts of its whole set that hold common runs alone, four or more of them, and texts that
  have little else have all blocks of their whole sets. A block counts only if it holds two or three runs, of which
  two lie apart in the text.
* What meets is checked by a second parity sketch of two to four bits for each run, whose Hamming distance is at most the symmetric
  difference of the sets: no pair above the threshold is lost. Then the similarity itself is computed.

Exact copies (the same set of runs) are one class from the start and are compared once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from clauseworks.llm import counters
from clauseworks.llm.arrow import per_batch, slices, spread, texts
from clauseworks.llm.shingles import by_text, mixed, runs, word_hashes
from clauseworks.session import cut

SIZE, THRESHOLD, MIN_WORDS = 3, 0.5, 20
COMMON, COMMON_LEAST, COUNTERS = 0.005, 20, 20  # share of all texts, and their number at least; log2 of the table's size
LOW = 0.36  # part of a text's runs that aren't common, up to which parts of three or more common ones count too
EVIDENCE_OF_TWO, EVIDENCE_OF_THREE, TRIPLES_FROM, MOST_SEEDS, APART = 90, 400, 8, 12, 6
EVIDENCE_OF_FOUR, FOUR, APART_SHARE = 640, 4, 0.25  # for parts of common runs alone
SKETCH = 256  # bits of the smallest sketch
PER_BUCKET, BLOCK, BUCKETS_A_TASK = 100_000, 256, 4
EVIDENCE = 2  # equal blocks that make two classes candidates, two at least
ROW, PAIRS_AT_ONCE = 20_000, 500_000  # classes of a packed row of what met; pairs that a task of these rows holds
PER_PART, LEAST_PARTS, PARTS_A_TASK, PER_CROSSING = 1_000_000, 64, 4, 4_000_000  # pairs of a part where they are counted, and of a task that crosses blocks
CLASS_BYTES = 5  # of a class in the join of signatures; classes alike in them are told apart by the check


def sets(all_texts: list[str], size: int = SIZE, min_words: int = MIN_WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, run, first place) of the distinct runs of each text that has ``min_words`` words, sorted by text and run."""
    flat, counts = word_hashes(all_texts)
    text, value = runs(flat, counts, size)
    long = counts[text] >= max(min_words, size)
    text, value = text[long], value[long]
    order = by_text(text, value)
    text, value = text[order], value[order]
    start = _starts(text, value >> np.uint64(20))
    return text[start], value[start], np.minimum.reduceat(order, start) if len(start) else order


def _slot(value: np.ndarray) -> np.ndarray:
    return (value >> np.uint64(64 - COUNTERS)).astype(np.int64)


def _starts(*columns: np.ndarray) -> np.ndarray:
    """Where a new combination of sorted columns begins."""
    if not len(columns[0]):
        return np.zeros(0, np.int64)
    new = np.ones(len(columns[0]), bool)
    new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    return np.flatnonzero(new)


def classes(text: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text, 64-bit hash of its set); equal sets have equal hashes."""
    start = _starts(text)
    if not len(start):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    total = np.add.reduceat(mixed(value, 101), start) ^ np.bitwise_xor.reduceat(mixed(value, 202), start)
    return text[start], total.view(np.int64)


@lru_cache(maxsize=2)
def _bits(packed: bytes) -> np.ndarray:
    return np.unpackbits(np.frombuffer(packed, np.uint8)).astype(bool)


@lru_cache(maxsize=2)
def plan(only_three: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(seeds, pairs) by band and level: in how many independent partitions into ``2 ** level`` parts a text whose
    number of runs is in the band takes part, and in how many of them, the first ones, a part counts with two runs;
    in the others it needs three. Levels are the one below the band, the band and the one above.

    Small sets take parts of two runs, about as many parts as runs or twice as many. Larger ones take parts of three
    runs and fewer parts: as many seeds more make up for that, and unlike texts hardly ever share such a part. The
    two bands where this changes have both kinds, so that they meet. ``only_three`` has parts of three for all sets.
    """
    bands = 40
    seeds, pairs = np.zeros((bands, 3), np.int64), np.zeros((bands, 3), np.int64)
    for band in range(1, bands):
        low = 2.0 ** (band - 1)  # runs of the band's smallest set
        two, three = (min(MOST_SEEDS, max(1, int(np.ceil(e / low)))) for e in (EVIDENCE_OF_TWO, EVIDENCE_OF_THREE))
        if band < TRIPLES_FROM and not only_three:
            seeds[band] = pairs[band] = [0, two, two]
            if band == TRIPLES_FROM - 1:
                seeds[band, 1] = max(two, three)
        else:
            seeds[band] = [three, three, 0]
            if band == TRIPLES_FROM and not only_three:
                pairs[band, 1] = two
    return seeds, pairs


def all_blocks(text: np.ndarray, value: np.ndarray, place: np.ndarray, common: np.ndarray, n_texts: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, signature) of every block that counts: of the sets without their common runs, of the parts of common
    runs alone, and of the whole sets of texts that are mostly common."""
    who, what = blocks(text[~common], value[~common], place[~common], n_texts)
    n, rare = np.bincount(text, minlength=n_texts), np.bincount(text[~common], minlength=n_texts)
    low = (rare <= LOW * n)[text]
    who2, what2 = blocks(text[low], value[low], place[low], n_texts, whole=True)
    who3, what3 = common_blocks(text, value, place, common, n_texts)
    return np.concatenate([who, who2, who3]), np.concatenate([what, what2, what3])


def common_blocks(text: np.ndarray, value: np.ndarray, place: np.ndarray, common: np.ndarray, n_texts: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, signature) of the parts of whole sets that hold common runs alone, ``FOUR`` or more, in all texts.

    Parts are larger than those of ``blocks``: one to eight runs in the mean. Texts of few patterns share three common
    runs by chance too often, and four from all over a text hardly ever.
    """
    n = np.bincount(text, minlength=n_texts)
    band = np.where(np.bincount(text[common], minlength=n_texts) >= FOUR, np.floor(np.log2(np.maximum(n, 1))).astype(np.int64) + 1, 0)
    of = band[text]
    who, what = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
    for b in np.unique(band[band > 0]).tolist():
        here = of == b
        t, v, p, c = text[here], value[here], place[here], common[here]
        first = _starts(t)
        row = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(t)))) << (b - 1)
        t, p, v, row, v_rare, row_rare = t[c], p[c], v[c], row[c], v[~c], row[~c]
        for seed in range(int(np.ceil(EVIDENCE_OF_FOUR / 2 ** max(b - 1, 4)))):
            h, shift = mixed(v, seed + 601), np.uint64(65 - b)
            fine, fine_rare = row + (h >> shift).astype(np.int64), row_rare + (mixed(v_rare, seed + 601) >> shift).astype(np.int64)
            for k in range(min(3, b)):
                bits, part = b - 1 - k, fine >> k
                rare = np.zeros(len(first) << bits, bool)
                rare[fine_rare >> k] = True
                alone = np.flatnonzero(~rare[part])
                alone = alone[np.bincount(part[alone], minlength=len(rare))[part[alone]] >= FOUR]
                if not len(alone):
                    continue
                alone = alone[np.argsort(part[alone], kind="stable")]
                start = _starts(part[alone])
                owner = t[alone[start]]
                good = np.maximum.reduceat(p[alone], start) - np.minimum.reduceat(p[alone], start) >= np.maximum(APART, APART_SHARE * n[owner])
                who.append(owner[good])
                what.append(mixed(np.bitwise_xor.reduceat(h[alone], start)[good] ^ np.uint64(bits << 8), seed + 801))
    return np.concatenate(who), np.concatenate(what)


def blocks(text: np.ndarray, value: np.ndarray, place: np.ndarray, n_texts: int, whole: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(text, signature) of every block that counts."""
    n = np.bincount(text, minlength=n_texts)
    band = np.where(n > 0, np.floor(np.log2(np.maximum(n, 1))).astype(np.int64) + 1, 0)
    seeds, pairs = plan(whole)
    shift = 300 * whole  # whole sets don't meet sets without their common runs
    most = seeds.max(axis=1)[band]
    who, what = [], []
    for seed in range(int(most.max(initial=0))):
        act = most[text] > seed
        t, v, p = text[act], mixed(value[act], seed + 1 + shift), place[act]
        order = by_text(t, v)  # the parts of any level are runs of this order
        t, v, p = t[order], v[order], p[order]
        for k in range(3):
            bits = np.maximum(band[t] + k - 1, 0)
            start = _starts(t, v >> np.minimum(64 - bits, 63).astype(np.uint64))
            if not len(start):
                continue
            of = band[t[start]]
            size = np.diff(np.append(start, len(t)))
            good = (seeds[of, k] > seed) & (size >= np.where(pairs[of, k] > seed, 2, 3))
            good &= np.maximum.reduceat(p, start) - np.minimum.reduceat(p, start) >= APART
            first = start[good]
            parity = np.bitwise_xor.reduceat(v, start)[good]
            who.append(t[first])
            what.append(mixed(parity ^ (bits[first].astype(np.uint64) << np.uint64(8)), seed + 51 + shift))
    return (np.concatenate(who), np.concatenate(what)) if who else (np.zeros(0, np.int64), np.zeros(0, np.uint64))


def _signatures(column: str, size: int, min_words: int, packed: bytes, buckets: int):
    """Signatures of all texts of a batch with their classes, one row for each bucket of signatures."""
    is_common = _bits(packed)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        text, value, place = sets(texts(batch.column(column)), size, min_words)
        owner, kind = classes(text, value)
        # copies have the same signatures: one text of each class will do
        one = np.zeros(batch.num_rows, bool)
        one[owner[np.unique(kind, return_index=True)[1]]] = True
        text, value, place = (x[one[text]] for x in (text, value, place))
        who, what = all_blocks(text, value, place, is_common[_slot(value)], batch.num_rows)
        if not len(who):
            return None
        of = kind[np.searchsorted(owner, who)]
        bucket = (what % np.uint64(buckets)).astype(np.int32)
        what = what >> np.uint64(32)
        order = np.lexsort((what, bucket))
        what, of, bucket = what[order], of[order], bucket[order]
        start = _starts(bucket)
        ends = [*start[1:], len(bucket)]
        return pa.RecordBatch.from_arrays(
            [
                pa.array(bucket[start], pa.int32()),
                pa.array([_planes(np.diff(what[a:b], prepend=np.uint64(0)), 4) for a, b in zip(start, ends)], pa.binary()),
                pa.array([_planes(of[a:b].view(np.uint64) >> np.uint64(64 - 8 * CLASS_BYTES), CLASS_BYTES) for a, b in zip(start, ends)], pa.binary()),
            ],
            ["bucket", "signatures", "classes"],
        )

    return run


def _planes(values: np.ndarray, width: int) -> bytes:
    """The lowest ``width`` bytes of each value, first all lowest ones: planes of zeros vanish in the shuffle's compression."""
    return values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()


def _from_planes(raw: bytes, width: int) -> np.ndarray:
    out = np.zeros((len(raw) // width, 8), np.uint8)
    out[:, :width] = np.frombuffer(raw, np.uint8).reshape(width, -1).T
    return out.view("<u8").reshape(-1).astype(np.uint64)


def _bucket_met(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each bucket's signatures that several classes have: ``MET``.

    Signatures of up to ``BLOCK`` classes give their classes, those of as many classes together in packed rows. A hot one
    gives its classes, ``BLOCK`` in a row: what comes out grows with the classes, not with their pairs."""
    whats, ofs = [], []
    for batch in batches:
        for x, y in zip(batch.column("signatures").to_pylist(), batch.column("classes").to_pylist()):
            whats.append(np.cumsum(_from_planes(x, 4)))
            ofs.append(_from_planes(y, CLASS_BYTES))
    what, of = np.concatenate(whats), np.concatenate(ofs)
    order = np.lexsort((of, what))
    what, of = what[order], of[order]
    start = _starts(what, of)
    what, of = what[start], of[start]
    start = _starts(what)
    size = np.diff(np.append(start, len(what)))
    bucket = key[0].as_py()
    for m in np.unique(size[(size > 1) & (size <= BLOCK)]).tolist():
        first, at_once = start[size == m], ROW // m
        yield _met_rows([(bucket, _planes(of[first[k : k + at_once, None] + np.arange(m)].ravel(), CLASS_BYTES), m, None, None, None, None) for k in range(0, len(first), at_once)])
    for a, m in zip(start[size > BLOCK], size[size > BLOCK]):
        blocks = -(-int(m) // BLOCK)
        for k in range(0, blocks, 1000):
            yield _met_rows([(bucket, None, None, int(what[a]), x, blocks, of[a + x * BLOCK : min(a + (x + 1) * BLOCK, a + m)].view(np.int64)) for x in range(k, min(k + 1000, blocks))])


# what Spark reads to choose the form that takes and gives one batch after the other
_bucket_met.__annotations__ = {"key": tuple[pa.Scalar, ...], "batches": Iterator[pa.RecordBatch], "return": Iterator[pa.RecordBatch]}
MET = "bucket int, packed binary, size int, signature bigint, block int, blocks int, classes array<bigint>"
PAIRS = "short_a bigint, short_b bigint"


def _met_rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int32(), pa.binary(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.list_(pa.int64()))
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], [x.split()[0] for x in MET.split(", ")])


def _cold_pairs(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The pairs of packed rows' signatures, at most ``PAIRS_AT_ONCE`` at a time."""
    for raw, m in zip(batch.column("packed"), batch.column("size").to_pylist()):
        of = _from_planes(raw.as_py(), CLASS_BYTES).reshape(-1, m)
        i, j = np.triu_indices(m, 1)
        at_once = PAIRS_AT_ONCE // len(i)
        for k in range(0, len(of), at_once):
            yield of[k : k + at_once, i].ravel(), of[k : k + at_once, j].ravel()


def _crossed_pairs(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The pairs of two blocks, at most ``BLOCK`` squared at a time. Each block meets itself once, of which the pairs with
    the lower class first are kept, and others wholly."""
    for left, right, own in zip(*(batch.column(c) for c in ("left", "right", "same"))):
        x, y = (c.values.to_numpy().view(np.uint64) for c in (left, right))
        i, j = np.triu_indices(len(x), 1) if own.as_py() else (np.repeat(np.arange(len(x)), len(y)), np.tile(np.arange(len(y)), len(x)))
        yield x[i], y[j]


def _pair_hash(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return mixed(a ^ mixed(b, 901), 902)


def _parted(held: list[tuple[np.ndarray, np.ndarray]], parts: int) -> pa.RecordBatch:
    """The pairs, lower class first and without those of a class with itself, one row for each part."""
    a, b = (np.concatenate([x[k] for x in held]) for k in (0, 1))
    other = a != b
    a, b = np.minimum(a, b)[other], np.maximum(a, b)[other]
    part = (_pair_hash(a, b) % np.uint64(parts)).astype(np.int32)
    order = np.argsort(part, kind="stable")
    a, b, part = a[order], b[order], part[order]
    start = _starts(part)
    ends = np.append(start[1:], len(part)).astype(np.int64)
    rows = [pa.array([_planes(x[p:q], CLASS_BYTES) for p, q in zip(start, ends)], pa.binary()) for x in (a, b)]
    return pa.RecordBatch.from_arrays([pa.array(part[start], pa.int32()), *rows], ["part", "left", "right"])


def parted(df: DataFrame, pairs_of: Callable[[pa.RecordBatch], Iterator[tuple[np.ndarray, np.ndarray]]], parts: int) -> DataFrame:
    """(part, left, right) of the pairs, packed. A task holds about ``PAIRS_AT_ONCE`` of them, however many its rows have:
    a row of a few kB stands for tens of thousands of pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            for a, b in pairs_of(batch):
                held.append((a, b))
                n += len(a)
                if n >= PAIRS_AT_ONCE:
                    yield _parted(held, parts)
                    held, n = [], 0
        if held:
            yield _parted(held, parts)

    return spread(df).mapInArrow(run, "part int, left binary, right binary")


def _enough(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A part's pairs that came ``EVIDENCE`` times."""
    sides: tuple[list, list] = ([], [])
    for batch in batches:
        for side, column in zip(sides, ("left", "right")):
            side += [_from_planes(x, CLASS_BYTES) for x in batch.column(column).to_pylist()]
    a, b = map(np.concatenate, sides)
    # most come once: only those whose hash comes again are sorted as pairs
    hashed = _pair_hash(a, b)
    again = np.sort(hashed)
    again = again[1:][again[1:] == again[:-1]]
    if not len(again):
        return
    hit = again[np.minimum(np.searchsorted(again, hashed), len(again) - 1)] == hashed
    a, b = a[hit], b[hit]
    order = np.lexsort((b, a))
    a, b = a[order], b[order]
    start = _starts(a, b)
    good = start[np.diff(np.append(start, len(a))) >= EVIDENCE]
    yield pa.RecordBatch.from_arrays([pa.array(x[good].view(np.int64)) for x in (a, b)], ["short_a", "short_b"])


_enough.__annotations__ = {"key": tuple[pa.Scalar, ...], "batches": Iterator[pa.RecordBatch], "return": Iterator[pa.RecordBatch]}


def met_pairs(met: DataFrame) -> DataFrame:
    """(short_a, short_b) of the classes that met with enough evidence. The blocks of a hot signature are dealt over all
    tasks, joined by signature and block, so that no task has it whole; the pairs are counted in as many parts as
    their number needs."""
    ahead = F.col("blocks") - F.col("block")  # blocks that a block meets, itself included
    cold, hot = met.agg(
        F.sum(F.length("packed") / CLASS_BYTES * (F.col("size") - 1) / 2),
        F.sum(F.size("classes") * F.lit(float(BLOCK)) * ahead),
    ).first()
    parts = max(LEAST_PARTS, int(((cold or 0) + (hot or 0)) / PER_PART))
    blocks = met.filter("blocks > 1")
    left = blocks.select("bucket", "signature", F.col("block").alias("from"), F.col("classes").alias("left"), F.explode(F.sequence("block", F.col("blocks") - 1)).alias("block"))
    right = blocks.select("bucket", "signature", "block", F.col("classes").alias("right"))
    # rows so small are else thought to be little work
    crossings = left.join(right, ["bucket", "signature", "block"]).repartition(1 + int((hot or 0) / PER_CROSSING), "bucket", "signature", "block", "from")
    both = parted(met.filter("blocks is null").select("packed", "size"), _cold_pairs, parts).unionByName(
        parted(crossings.select("left", "right", (F.col("from") == F.col("block")).alias("same")), _crossed_pairs, parts)
    )
    return both.repartition(max(1, parts // PARTS_A_TASK), "part").groupBy("part").applyInArrow(_enough, PAIRS)


def sketch_level(number: np.ndarray) -> np.ndarray:
    """The level of a set's sketch, which has ``SKETCH << level`` bits: at least twice as many as the set has runs."""
    return np.maximum(0, np.ceil(np.log2(np.maximum(number, 1))).astype(np.int64) - int(np.log2(SKETCH)) + 1)


def _sketched(batch: pa.RecordBatch, key: str, text: np.ndarray, value: np.ndarray) -> pa.RecordBatch | None:
    """(key, class, runs, sketch) of the texts that have a set."""
    owner, kind = classes(text, value)
    if not len(owner):
        return None
    start = _starts(text)
    number = np.diff(np.append(start, len(text)))
    level = sketch_level(number)
    row = np.searchsorted(owner, text)
    own = np.empty(len(owner), object)
    for k in np.unique(level):
        bits = SKETCH << int(k)
        at, here = np.flatnonzero(level == k), level[row] == k
        place = np.searchsorted(at, row[here]) * bits + (mixed(value[here], 7) % np.uint64(bits)).astype(np.int64)
        odd = (np.bincount(place, minlength=len(at) * bits).reshape(-1, bits) & 1).astype(np.uint8)
        own[at] = list(np.packbits(odd, axis=1).view(">i8").astype(np.int64))
    return pa.RecordBatch.from_arrays(
        [batch.column(key).take(pa.array(owner)), pa.array(kind), pa.array(number.astype(np.int32)), pa.array(list(own), pa.list_(pa.int64()))],
        [key, "class", "runs", "sketch"],
    )


def members(df: DataFrame, key: str, column: str, size: int = SIZE, min_words: int = MIN_WORDS) -> tuple[DataFrame, DataFrame]:
    """(members, counts): (key, class, runs, sketch) of every text that has ``min_words`` words, and, from the same
    pass over the texts, the counts of their runs by slot as ``counters`` sums them."""
    kind = df.schema[key].dataType
    typed = df.select(key, column).schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(1 << COUNTERS, np.int64), 0
        for batch in batches:
            for part in slices(batch):
                text, value, _ = sets(texts(part.column(column)), size, min_words)
                total += np.bincount(_slot(value), minlength=len(total))
                out = _sketched(part, key, text, value)
                if out is not None:
                    n += out.num_rows
                    none = [pa.nulls(out.num_rows, t) for t in (pa.int32(), pa.binary())]
                    yield pa.RecordBatch.from_arrays([*out.columns, *none], [*out.schema.names, "part", "counts"])
        counted = counters.given_out(total, n)
        none = [pa.nulls(counted.num_rows, t) for t in (own, pa.int64(), pa.int32(), pa.list_(pa.int64()))]
        yield pa.RecordBatch.from_arrays([*none, *counted.columns], [key, "class", "runs", "sketch", "part", "counts"])

    own = to_arrow_type(kind)
    both = cut(spread(df.select(key, column)).mapInArrow(run, f"`{key}` {typed}, class bigint, runs int, sketch array<bigint>, part int, counts binary"))
    return both.filter("part is null").drop("part", "counts"), both.filter("part is not null").select("part", "counts")


def _similarity(size: int, min_words: int):
    def run(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        # a text is in several pairs: its set is made once for a batch
        where: dict[str, int] = {}
        which = [where.setdefault(t, len(where)) for c in ("text_a", "text_b") for t in texts(batch.column(c))]
        text, value, _ = sets(list(where), size, min_words)
        begin = np.searchsorted(text, np.arange(len(where) + 1))
        owner, kind = classes(text, value)
        of = dict(zip(owner.tolist(), kind.tolist()))
        n, rows = batch.num_rows, []
        for a, b in zip(which[:n], which[n:]):
            if a in of and b in of and a != b:
                both = np.concatenate([value[begin[a] : begin[a + 1]], value[begin[b] : begin[b + 1]]])
                both.sort()
                shared = int((both[1:] == both[:-1]).sum())
                rows.append((of[a], of[b], shared / (len(both) - shared)))
        names = ["class_a", "class_b", "similarity"]
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate((pa.int64(), pa.int64(), pa.float64()))], names)

    return run


def similar_classes(df: DataFrame, key: str, column: str, threshold: float = THRESHOLD, size: int = SIZE, min_words: int = MIN_WORDS, common: float = COMMON) -> tuple[DataFrame, DataFrame]:
    """(members, links): the class of each text, and (class_a, class_b, similarity) of different sets from
    ``threshold`` on, class_a < class_b."""
    df = df.select(key, column).filter(F.col(column).isNotNull() & F.col(key).isNotNull())
    who, counted = members(df, key, column, size, min_words)
    n, totals = counters.collected(counters.summed(counted), COUNTERS)
    packed = np.packbits(totals > max(common * n, COMMON_LEAST)).tobytes()
    buckets = 1 << max(4, int(np.ceil(np.log2(max(1, n * 55 / PER_BUCKET)))))
    signed = per_batch(df.select(column), "bucket int, signatures binary, classes binary", _signatures, column, size, min_words, packed, buckets)
    # a task has a few buckets, at any number of texts
    met = cut(signed.repartition(max(1, buckets // BUCKETS_A_TASK), "bucket").groupBy("bucket").applyInArrow(_bucket_met, MET))
    pairs = met_pairs(met)
    rep = who.groupBy("class").agg(F.min(key).alias("rep"), *(F.first(c).alias(c) for c in ("runs", "sketch")))
    short = F.shiftrightunsigned("class", 64 - 8 * CLASS_BYTES)
    side = lambda x: rep.select(short.alias(f"short_{x}"), F.col("runs").alias(f"runs_{x}"), F.col("sketch").alias(f"sketch_{x}"))
    both = F.col("runs_a") + F.col("runs_b")
    apart = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda p, q: p + q)
    # sketches of neighbouring levels are compared on the lower one, of which bit h is the parity of bits h and h + half
    # of the higher; sets further apart in size aren't similar
    words = lambda c: (F.size(c) / 2).cast("int")
    lower = lambda c: F.zip_with(F.slice(c, F.lit(1), words(c)), F.slice(c, words(c) + 1, words(c)), lambda p, q: p.bitwiseXOR(q))
    far = (
        F.when(F.size("sketch_a") == F.size("sketch_b"), apart("sketch_a", "sketch_b"))
        .when(F.size("sketch_a") == F.size("sketch_b") * 2, apart(lower("sketch_a"), "sketch_b"))
        .when(F.size("sketch_b") == F.size("sketch_a") * 2, apart("sketch_a", lower("sketch_b")))
        .otherwise(F.lit(0))
    )
    # two sets whose classes are alike in the bytes that signatures carry have one name here, and two rows
    named = lambda x: rep.select(short.alias(f"short_{x}"), F.col("rep").alias(f"rep_{x}"))
    close = cut(
        pairs.join(side("a"), "short_a")
        .join(side("b"), "short_b")
        .filter(F.least("runs_a", "runs_b") >= threshold * F.greatest("runs_a", "runs_b"))
        # the sets differ in at most (1 - t) / (1 + t) of their runs, and the sketches in no more bits
        .filter(far <= both * ((1 - threshold) / (1 + threshold)) + 1e-9)
        .select("short_a", "short_b")
        .distinct()
        .join(named("a"), "short_a")
        .join(named("b"), "short_b")
        .filter(F.col("rep_a") != F.col("rep_b"))
        .select("rep_a", "rep_b")
    )
    df = some_keys(df, key, close.select(F.col("rep_a").alias("k")).unionByName(close.select(F.col("rep_b").alias("k"))))
    text = lambda x: df.select(F.col(key).alias(f"rep_{x}"), F.col(column).alias(f"text_{x}"))
    # a key may have several rows here; any row of the class will do, so the pairs are made distinct again
    checked = per_batch(
        close.join(text("a"), "rep_a").join(text("b"), "rep_b").select("text_a", "text_b"),
        "class_a bigint, class_b bigint, similarity double", _similarity, size, min_words,
    )
    links = (
        checked.filter((F.col("similarity") >= threshold) & (F.col("class_a") != F.col("class_b")))
        .groupBy(F.least("class_a", "class_b").alias("class_a"), F.greatest("class_a", "class_b").alias("class_b"))
        .agg(F.max("similarity").alias("similarity"))
    )
    return who.select(key, "class"), links


def some_keys(df: DataFrame, key: str, keys: DataFrame, bits: int = 22) -> DataFrame:
    """The rows of ``df`` whose key may be among ``keys`` (k): all that are, and some others.

    A table of ``2 ** bits`` bits by the keys' hashes goes to every task as one row, whatever the number of keys.
    """
    slot = lambda c: F.pmod(F.xxhash64(c), F.lit(1 << bits))
    word = keys.select(slot("k").alias("s")).groupBy(F.shiftright("s", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(pmod(s, 64) as int))")).alias("b"))
    rows = word.orderBy("w").toArrow()  # at most 2 ** (bits - 6) rows
    packed = np.zeros(1 << (bits - 6), np.int64)
    packed[np.array(rows.column("w"))] = np.array(rows.column("b"))
    table = df.sparkSession.createDataFrame(pa.table({"bits": pa.array([packed.tolist()], pa.list_(pa.int64()))}))
    s = slot(key)
    hit = F.getbit(F.element_at("bits", (F.shiftright(s, 6) + 1).cast("int")), F.pmod(s, F.lit(64)).cast("int")) == 1
    return df.join(F.broadcast(table), hit).select(*df.columns)


def pairs(df: DataFrame, key: str = "clause_id", column: str = "clause", **parameters) -> DataFrame:
    """(key_a, key_b, similarity) of all rows whose similarity is at least the threshold, key_a < key_b.

    Copies are paired too. Null and short texts and null keys give no row; a key that has several rows is never
    paired with itself. An empty table gives no pair.
    """
    who, links = similar_classes(df, key, column, **parameters)
    links = cut(links)
    a = who.select(F.col("class").alias("class_a"), F.col(key).alias("x"))
    b = who.select(F.col("class").alias("class_b"), F.col(key).alias("y"))
    across = links.join(a, "class_a").join(b, "class_b").select("x", "y", "similarity")
    many = who.groupBy("class").agg(F.count("*").alias("n")).filter("n > 1").select(F.col("class").alias("class_a"))
    within = a.join(many, "class_a", "left_semi").join(b.withColumnRenamed("class_b", "class_a"), "class_a").filter("x < y").select("x", "y", F.lit(1.0).alias("similarity"))
    return (
        across.unionByName(within)
        .filter("x <> y")
        .select(F.least("x", "y").alias(f"{key}_a"), F.greatest("x", "y").alias(f"{key}_b"), "similarity")
        .groupBy(f"{key}_a", f"{key}_b")
        .agg(F.max("similarity").alias("similarity"))
    )


def components(nodes: DataFrame, edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, group): the least node that each node is linked with, over any number of links.

    ``nodes`` (node) and ``edges`` (a, b). Each round takes the least label among a node's neighbours and then the
    label's own label, so that the rounds grow with the logarithm of the longest chain. What a round gives is kept in
    the shared checkpoint folder; only its count of changes comes to the driver.
    """
    edges = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    edges = cut(edges)
    label = cut(edges.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("group")).withColumnRenamed("a", "node"))
    for _ in range(most_rounds):
        near = edges.join(label.withColumnRenamed("node", "b"), "b").groupBy("a").agg(F.min("group").alias("near"))
        lower = label.join(near.withColumnRenamed("a", "node"), "node", "left").select("node", F.col("group").alias("old"), F.least("group", F.coalesce("near", "group")).alias("group"))
        jump = lower.select(F.col("node").alias("group"), F.col("group").alias("far"))
        label = cut(lower.join(jump, "group", "left").select("node", "old", F.least("group", F.coalesce("far", "group")).alias("group")))
        if label.filter("old <> `group`").isEmpty():
            break
        label = label.select("node", "group")
    else:
        raise RuntimeError(f"no end after {most_rounds} rounds")
    return nodes.select("node").distinct().join(label.select("node", "group"), "node", "left").select("node", F.coalesce("group", "node").alias("group"))


def groups(df: DataFrame, key: str = "clause_id", column: str = "clause", **parameters) -> DataFrame:
    """(key, group, copies, links): each row's group, the rows with its very set, and the classes linked to it.

    ``group`` is the least key of all rows reached over links. Null and short texts have no row.
    """
    who, links = similar_classes(df, key, column, **parameters)
    links = cut(links)
    of = components(who.select(F.col("class").alias("node")), links.select(F.col("class_a").alias("a"), F.col("class_b").alias("b")))
    each = links.select(F.col("class_a").alias("class")).unionByName(links.select(F.col("class_b").alias("class"))).groupBy("class").agg(F.count("*").alias("links"))
    sizes = who.groupBy("class").agg(F.count("*").alias("copies"), F.min(key).alias("least"))
    grouped = sizes.join(of.withColumnRenamed("node", "class"), "class").join(each, "class", "left")
    least = grouped.groupBy("group").agg(F.min("least").alias("key"))
    named = grouped.join(least, "group").select("class", F.col("key").alias("group"), "copies", F.coalesce("links", F.lit(0)).alias("links"))
    return who.join(named, "class").select(key, "group", "copies", "links")
