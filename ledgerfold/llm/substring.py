"""Operator 1: repeated passages by collinear chaining.

repeated_passages(docs) finds passages of `min_words` words or more that an earlier document (of a smaller id) has too,
word by word or with small changes; without_passages(docs) cuts them out, so that the earliest copy stays.

1. Seeds: of every window of `WINDOW` runs of `RUN` words the one with the least hash. Two texts that share
   WINDOW + RUN - 1 words in a row share a seed there, however often the words occur. A run that returns at once, as
   in repeated words, is a seed of its own each time.
2. Each seed is joined with its first occurrence in the corpus (the smallest id), so the number of matches is linear,
   also for a passage that a third of all documents have.
3. A document's matches with one earlier document are chained: in order in both, each step paying for the words it
   skips, the best predecessor found by a Fenwick tree of prefix maxima. Chains count where the document's matches,
   with whatever documents, lie close enough together to be part of a passage.
4. Of a seed only the first owner is known, so earlier documents that each have less than `min_words` words of a
   passage could hide a later one that has all of it. Therefore every window of `min_words` words whose seeds all occur
   in two documents or more is joined with its own first occurrence too. A window that two documents share has no other
   seeds, so every word by word repeat of `min_words` words is found, whatever else has parts of it. Windows in a row
   with one source are a chain; of chains that overlap, the fewest that cover the same words are kept.
5. Chains are aligned word by word: matches at their ends are carried on, gaps between seeds are aligned with the
   fewest edits, and what has `min_words` words and `identity` of them equal is a passage. Of the earlier document only
   the words around the chain travel, cut from pieces of `PIECE` words, so no row grows with a document, and a source
   that many documents repeat is spread by its pieces and by the join's own splitting. The cuts stream past the
   document's text one after another; nothing of a document is gathered in one row but its own seeds and windows.

A passage with changes is found where its seeds survive: see the README for the share found by the number of changes.

Words are runs of non-white-space, compared with A-Z in lower case. Null and empty texts have no passages; rows without
an id (or one that is no whole number) take no part and are not cut; rows of one id are one document, never repeats of
each other. Texts may be of any length; empty tables give empty tables. Extra columns are ignored by repeated_passages
and kept by without_passages, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

from ..shipping import to_workers
from .common import as_kind, filtered, in_small_batches, map_batches, numbered, picked, place, restored, whole_number, written
from .hashing import mix, run_hashes, words_in

MIN_WORDS, IDENTITY = 50, 0.8
RUN, WINDOW = 8, 16
#: A chain pays for each word it skips in either document; a gap beyond GAP words ends it.
SKIP, GAP = 0.15, 48
#: How far an extension may fall below its best before it stops.
DROP = 8
#: Words around a chain (beside those of its region, up to the least length) that an alignment may reach.
AROUND = RUN + WINDOW + DROP
#: Words of a document that travel together.
PIECE = 512
#: Bytes of texts whose hashes are made at once (a longer text is alone).
TOGETHER = 1 << 18


def sliding(x: np.ndarray, size: int, op) -> np.ndarray:
    """op over each run of `size` values."""
    have, out = 1, x
    while have < size:
        step = min(have, size - have)
        out = op(out[:-step], out[step:])
        have += step
    return out


def together(texts: list[bytes]) -> Iterator[tuple[int, int]]:
    """Ranges of texts of at most TOGETHER bytes, or of one text."""
    start, size = 0, 0
    for k, text in enumerate(texts):
        if k > start and size + len(text) > TOGETHER:
            yield start, k
            start, size = k, 0
        size += len(text)
    if texts:
        yield start, len(texts)


def words_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts, and where each text's words begin (and the last one's end)."""
    hashes, first, _, _ = words_in(np.frombuffer(b"\n".join(texts).lower(), np.uint8))
    return hashes, np.searchsorted(first, np.cumsum([0, *(len(t) + 1 for t in texts)]))


def told_apart(hashes: np.ndarray, text: np.ndarray) -> np.ndarray:
    """Hashes that are equal only where those given and the texts' numbers are."""
    return hashes + mix(text.astype(np.uint64))


def seeds_of_all(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes (63 bits) of the seeds of all texts, the number of seeds of each text, and the seeds' word positions."""
    words, begin = words_of(texts)
    count = np.maximum(np.diff(begin) - RUN + 1, 0)  # runs of each text; those over two texts are left out
    ends = np.cumsum(count)
    own, starts = np.repeat(np.arange(len(texts)), count), ends - count
    place = np.arange(len(own)) - starts[own]
    if not len(own):
        return np.zeros(0, np.int64), count, place
    runs = run_hashes(words, RUN)[begin[own] + place]
    order = mix(runs)
    # the least of each window of WINDOW runs of one text, or of all where it has fewer
    least = np.zeros(len(own) + WINDOW - 1, np.uint64)
    if len(own) >= WINDOW:
        least[WINDOW - 1 : len(own)] = np.where(own[: 1 - WINDOW] == own[WINDOW - 1 :], sliding(order, WINDOW, np.minimum), np.uint64(0))
    taken = order == sliding(least, WINDOW, np.maximum)
    short = (count < WINDOW) & (count > 0)
    if short.any():
        lowest = np.zeros(len(texts), np.uint64)
        lowest[count > 0] = np.minimum.reduceat(order, starts[count > 0])
        taken = np.where(short[own], order == lowest[own], taken)
    at = np.flatnonzero(taken)
    # a run that comes back within GAP words (the the the ...) is told apart by how often it did
    key = told_apart(runs[at], own[at])
    by_run = np.argsort(key, kind="stable")
    hashes, places = key[by_run], place[at][by_run]
    fresh = np.ones(len(at), bool)
    fresh[1:] = (hashes[1:] != hashes[:-1]) | (np.diff(places) > GAP)
    again = np.arange(len(at)) - np.maximum.accumulate(np.where(fresh, np.arange(len(at)), 0))
    out = np.empty(len(at), np.uint64)
    out[by_run] = mix(runs[at][by_run] + again.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return (out >> np.uint64(1)).astype(np.int64), np.bincount(own[at], minlength=len(texts)), place[at]


def seeds_of(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Hashes (63 bits) and word positions of a text's seeds."""
    return seeds_of_all([(text or "").encode()])[::2]


def seed_table(docs: DataFrame) -> DataFrame:
    """h, id and pos."""

    def make():
        def step(ids, texts):
            texts = texts.cast(pa.binary()).to_pylist()
            hashes, size, at = (np.concatenate(x) for x in zip(*(seeds_of_all(texts[a:b]) for a, b in together(texts)), strict=True))
            return hashes, np.repeat(ids.to_numpy(zero_copy_only=False), size), at.astype(np.int32)

        return step

    return map_batches(docs, ["id", "text"], make, "h long, id long, pos int", [("h", pa.int64()), ("id", pa.int64()), ("pos", pa.int32())])


def windows_of_all(texts: list[bytes], shared: list[np.ndarray], size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes (63 bits) of the windows of `size` words of all texts, all of whose seeds are among a text's `shared`, the
    number of windows of each text, and the windows' word positions. Only seeds that the window's own words decide count,
    as first occurrences in their text (which every text that has the seed has)."""
    words, begin = words_of(texts)
    own = np.repeat(np.arange(len(texts)), np.diff(begin))
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(len(texts), np.int64), np.zeros(0, np.int64)
    inside = size - RUN - WINDOW + 2
    good = own[:n] == own[size - 1 :]
    if inside > 0:
        least = sliding(mix(run_hashes(words, RUN)), WINDOW, np.minimum) >> np.uint64(1)
        key = told_apart(least, own[: len(least)])
        fresh = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        among = told_apart(np.concatenate(shared).astype(np.uint64), np.repeat(np.arange(len(texts)), [len(x) for x in shared]))
        other = np.repeat(~np.isin(key[fresh], among), np.diff(fresh, append=len(key)))
        other = np.concatenate([[0], np.cumsum(other)])
        good &= other[inside : inside + n] == other[:n]
    at = np.flatnonzero(good)
    have, powers, done, out = 1, words, 0, np.zeros(len(words), np.uint64)
    base = np.uint64(0x9E3779B97F4A7C15)
    with np.errstate(over="ignore"):
        while len(at) and done < size:  # by doubling: powers has the hashes of runs of `have` words, out those of `done` words
            if size & have:
                out = out[: len(words) - done - have + 1] * np.power(base, np.uint64(have)) + powers[done : len(words) - have + 1]
                done += have
            if done < size:
                powers = powers[:-have] * np.power(base, np.uint64(have)) + powers[have:]
                have *= 2
    return (mix(out[at]) >> np.uint64(1)).astype(np.int64), np.bincount(own[at], minlength=len(texts)), at - begin[own[at]]


def windows_of(text: str | None, shared: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes (63 bits) and word positions of a text's windows of `size` words all of whose seeds are among `shared`."""
    return windows_of_all([(text or "").encode()], [shared], size)[::2]


def window_table(docs: DataFrame, size: int) -> DataFrame:
    """h, id and pos of the windows of `size` words. docs: id, text and shared."""

    def make():
        def step(ids, texts, shared):
            texts = texts.cast(pa.binary()).to_pylist()
            shared = [x.values.to_numpy() if x.is_valid else np.zeros(0, np.int64) for x in shared]
            hashes, count, at = (np.concatenate(x) for x in zip(*(windows_of_all(texts[a:b], shared[a:b], size) for a, b in together(texts)), strict=True))
            return hashes, np.repeat(ids.to_numpy(zero_copy_only=False), count), at.astype(np.int32)

        return step

    return map_batches(docs, ["id", "text", "shared"], make, "h long, id long, pos int", [("h", pa.int64()), ("id", pa.int64()), ("pos", pa.int32())])


def runs_of(matches: list[tuple[int, int, int]], size: int) -> list[tuple[int, int, int, int]]:
    """(start, end, earlier document, start there) of the fewest runs of windows that cover what all windows cover.
    matches: (pos, earlier document, its pos), one for each window."""
    runs: list[tuple[int, int, int, int]] = []
    for p, other, q in sorted(set(matches)):
        if runs:
            start, end, source, there = runs[-1]
            if other == source and end == p + size - 1 and q - there == p - start:
                runs[-1] = (start, p + size, source, there)
                continue
        runs.append((p, p + size, other, q))
    out, end, i = [], -1, 0
    while i < len(runs):
        end, best = max(end, runs[i][0]), runs[i]
        while i < len(runs) and runs[i][0] <= end:
            best = max(best, runs[i], key=itemgetter(1))
            i += 1
        if best[1] > end:
            out.append(best)
            end = best[1]
    return out


class PrefixMaxima:
    """Fenwick tree: the best (value, index) at places up to one."""

    def __init__(self, n: int):
        self.best = [(float("-inf"), -1)] * (n + 1)

    def put(self, place: int, value: float, index: int) -> None:
        place += 1
        while place < len(self.best):
            if self.best[place][0] < value:
                self.best[place] = (value, index)
            place += place & -place

    def upto(self, place: int) -> tuple[float, int]:
        out, place = (float("-inf"), -1), place + 1
        while place:
            if self.best[place][0] > out[0]:
                out = self.best[place]
            place -= place & -place
        return out


def chains(matches: list[tuple[int, int]]) -> list[list[tuple[int, int]]]:
    """Chains of matches (pos, other pos), each match in one chain at most, the best chains first."""
    matches = sorted(set(matches))
    rank = {p: k for k, p in enumerate(sorted({b for _, b in matches}))}
    tree, score, before = PrefixMaxima(len(rank)), [], []
    last = None
    for start, group in groupby(range(len(matches)), key=lambda i: matches[i][0]):
        gain = RUN if last is None else min(RUN, start - last)
        last = start
        waiting = []
        for i in group:
            b = matches[i][1]
            value, j = tree.upto(rank[b] - 1) if rank[b] else (0.0, -1)
            link = value - SKIP * (start + b)
            if j >= 0 and link > 0 and start - matches[j][0] <= GAP + RUN and b - matches[j][1] <= GAP + RUN:
                score.append(link + gain)
                before.append(j)
            else:
                score.append(RUN)
                before.append(-1)
            waiting.append((rank[b], score[i] + SKIP * (start + b), i))
        for w in waiting:
            tree.put(*w)
    out, used = [], [False] * len(matches)
    for i in sorted(range(len(matches)), key=lambda i: (-score[i], i)):
        chain = []
        while i >= 0 and not used[i]:
            used[i] = True
            chain.append(matches[i])
            i = before[i]
        if chain:
            out.append(chain[::-1])
    return out


def candidates(matches: list[tuple[int, int, int]], min_words: int) -> list[tuple[int, int, int, list[tuple[int, int]]]]:
    """(earlier document, region start, region end, chain) of the regions of a document where matches lie so densely
    that a passage may be there. matches: (pos, earlier document, its pos)."""
    least = max(RUN + 1, min_words - 2 * (WINDOW - 1))
    out = []
    by_pos = sorted(matches)
    cut = [0] + [k for k in range(1, len(by_pos)) if by_pos[k][0] - by_pos[k - 1][0] > GAP + RUN] + [len(by_pos)]
    for lo, hi in zip(cut, cut[1:]):
        start, end = by_pos[lo][0], by_pos[hi - 1][0] + RUN
        if end - start < least:
            continue
        for other, group in groupby(sorted(by_pos[lo:hi], key=itemgetter(1)), key=itemgetter(1)):
            out += [(other, start, end, chain) for chain in chains([(p, q) for p, _, q in group])]
    return out


def extend(a: list[bytes], i: int, b: list[bytes], j: int, step: int) -> tuple[int, int]:
    """How many words to go on from places i and j (going by step), and how many of them are equal."""
    best, score, n, same, best_same = 0, 0, 0, 0, 0
    top = 0
    while 0 <= i < len(a) and 0 <= j < len(b) and score > top - DROP:
        n += 1
        if a[i] == b[j]:
            score += 1
            same += 1
            if score > top:
                top, best, best_same = score, n, same
        else:
            score -= 2
        i += step
        j += step
    return best, best_same


def common_words(a: list[bytes], b: list[bytes]) -> int:
    """Words equal in an alignment with the fewest edits (longest common subsequence) of two short gaps."""
    if a == b:
        return len(a)
    if len(a) == len(b):
        same = sum(x == y for x, y in zip(a, b))
        if same >= len(a) - 2:
            return same
    row = [0] * (len(b) + 1)
    for x in a:
        old = 0
        for k, y in enumerate(b, 1):
            old, row[k] = row[k], old + 1 if x == y else max(row[k], row[k - 1])
    return row[-1]


def align(a: list[bytes], b: list[bytes], offset: int, chain: list[tuple[int, int]]) -> tuple[int, int, int, int, int]:
    """Passage of a chain: start and end in a, start and end in b, equal words. b is a cut that begins at word
    `offset` of its document."""
    i, j = chain[0][0], chain[0][1] - offset
    n, same = extend(a, i - 1, b, j - 1, -1)
    start, other = i - n, j - n
    for p, q in chain:
        q -= offset
        if p >= i and q >= j:
            same += common_words(a[i:p], b[j:q]) + RUN
            i, j = p + RUN, q + RUN
        else:  # overlaps the words before
            more = max(0, min(p + RUN - i, q + RUN - j))
            same += more
            i, j = i + more, j + more
    n, more = extend(a, i, b, j, 1)
    return start, i + n, other + offset, j + n + offset, same + more


def passages(a: list[bytes], b: list[bytes], offset: int, chain: list[tuple[int, int]], min_words: int, identity: float) -> list[tuple[int, int, int, int, int]]:
    """Passages of a chain. One whose alignment has too few equal words is parted where it skips most, and each part
    tried."""
    out, waiting = [], [chain]
    while waiting:
        part = waiting.pop()
        start, end, other_start, other_end, same = align(a, b, offset, part)
        if min(end - start, other_end - other_start) >= min_words and same >= identity * max(end - start, other_end - other_start):
            out.append((start, end, other_start, other_end, same))
        elif len(part) > 1:
            at = max(range(1, len(part)), key=lambda k: max(part[k][0] - part[k - 1][0], part[k][1] - part[k - 1][1]))
            waiting += [part[:at], part[at:]]
    return out


def repeated_passages(docs: DataFrame, min_words: int = MIN_WORDS, identity: float = IDENTITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows doc_id, source_doc_id (the earlier document), start and end (words of the passage), source_start and
    source_end, and matched (equal words). Passages of one document with different sources may overlap."""
    texts = picked(docs, id=id_col, text=text_col).select(whole_number("id").alias("id"), F.col("text").cast("string").alias("text")).where(F.col("id").isNotNull() & (F.col("text") != ""))
    earlier = F.when(F.col("id") != F.col("other"), F.struct("pos", "other", "other_pos"))

    def met(places):
        first = places.groupBy("h").agg(F.min(F.col("id")).alias("other"), F.max("id").alias("last"), F.min_by("pos", F.struct("id", "pos")).alias("other_pos")).where(F.col("other") != F.col("last")).drop("last")
        return places.select("h", "id", "pos").join(first, "h")

    by_doc = met(seed_table(texts)).groupBy("id").agg(F.collect_list(earlier).alias("m"), F.collect_set("h").alias("shared"))
    by_doc = written(by_doc, "seeds")
    size = max(min_words, RUN)
    # below RUN + WINDOW - 1 words a window need not have a seed
    likely = filtered(texts, by_doc.select("id")) if size >= RUN + WINDOW - 1 else texts
    windows = window_table(likely.join(by_doc.select("id", "shared"), "id", "inner" if size >= RUN + WINDOW - 1 else "left"), size)
    whole = met(windows).where(F.col("id") != F.col("other")).groupBy("id").agg(F.collect_list(F.struct("pos", "other", "other_pos")).alias("w"))
    by_doc = by_doc.select("id", "m").join(whole, "id", "full")

    def make_chains():
        def step(ids, lists, windows):
            rows = []
            for d, m, w in zip(ids.to_pylist(), lists.to_pylist(), windows.to_pylist(), strict=True):
                regions = candidates([(x["pos"], x["other"], x["other_pos"]) for x in m], min_words) if m else []
                runs = runs_of([(x["pos"], x["other"], x["other_pos"]) for x in w], size) if w else []
                for p, e, other, q in runs:
                    start, end = next(((a, b) for _, a, b, _ in regions if a < e and p < b), (p, e))
                    regions.append((other, start, end, [(p, q), (e - RUN, q + e - RUN - p)]))
                rows += [(d, *cut) for cut in cuts_of(regions, min_words)]
            return tuple(list(x) for x in zip(*rows, strict=True)) if rows else ([], [], [], [], [], [])

        return step

    wanted = map_batches(by_doc, ["id", "m", "w"], make_chains, "d long, id long, nth int, lo long, hi long, chains array<binary>", [("d", pa.int64()), ("id", pa.int64()), ("nth", pa.int32()), ("lo", pa.int64()), ("hi", pa.int64()), ("chains", pa.list_(pa.binary()))])
    wanted = written(wanted, "chains")

    # the words of the earlier documents, in pieces, and of each piece what is asked for
    asked = wanted.withColumn("part", F.explode(F.sequence(F.floor(F.col("lo") / PIECE), F.floor((F.col("hi") - 1) / PIECE))))
    found = pieces_of(filtered(texts, wanted.select("id").distinct())).join(asked.drop("chains"), ["id", "part"])

    def make_cuts():
        def step(d, ids, nth, part, lo, hi, bodies):
            cuts = []
            for k, a, b, body in zip(part.to_pylist(), lo.to_pylist(), hi.to_pylist(), bodies, strict=True):
                cuts.append(b" ".join(body.as_py().split(b" ")[max(0, a - k * PIECE) : b - k * PIECE]))
            return d, ids, nth, part, cuts

        return step

    cuts = map_batches(found, ["d", "id", "nth", "part", "lo", "hi", "words"], make_cuts, "d long, id long, nth int, part long, words binary", [("d", pa.int64()), ("id", pa.int64()), ("nth", pa.int32()), ("part", pa.int64()), ("words", pa.binary())])
    return aligned(texts, wanted, cuts, min_words, identity)


def cuts_of(regions: list[tuple[int, int, int, list[tuple[int, int]]]], min_words: int) -> list[tuple[int, int, int, int, list[bytes]]]:
    """(earlier document, number, first word, word after the last, chains) of what is needed of the earlier documents, for
    (earlier document, region start, region end, chain); chains whose needs overlap share a cut, the best chain first."""
    out = []
    for other, group in groupby(sorted(regions, key=itemgetter(0)), key=itemgetter(0)):
        needs = []
        for order, (_, start, end, chain) in enumerate(group):
            (p, q), (last_p, last_q) = chain[0], chain[-1]
            lo = max(0, q - min(max(0, p - start), min_words) - AROUND)
            needs.append((lo, last_q + RUN + min(max(0, end - last_p - RUN), min_words) + AROUND, order, chain))
        joined: list[list] = []
        for lo, hi, order, chain in sorted(needs, key=itemgetter(0, 1, 2)):
            if joined and lo < joined[-1][1]:
                joined[-1][1] = max(joined[-1][1], hi)
                joined[-1][2].append((order, chain))
            else:
                joined.append([lo, hi, [(order, chain)]])
        for nth, (lo, hi, found) in enumerate(joined):
            out.append((other, nth, lo, hi, [np.array(c, "<i4").tobytes() for _, c in sorted(found, key=itemgetter(0))]))
    return out


def pieces_of(texts: DataFrame) -> DataFrame:
    """id, part and words (lower case, a space between them): each document in pieces of PIECE words."""

    def make():
        def step(ids, bodies):
            rows = []
            for i, body in zip(ids.to_pylist(), bodies, strict=True):
                words = body.as_py().encode().lower().split()
                rows += [(i, k // PIECE, b" ".join(words[k : k + PIECE])) for k in range(0, len(words), PIECE)]
            return tuple(list(x) for x in zip(*rows, strict=True)) if rows else ([], [], [])

        return step

    return map_batches(texts, ["id", "text"], make, "id long, part long, words binary", [("id", pa.int64()), ("part", pa.int64()), ("words", pa.binary())])


PASSAGE = ["doc_id", "source_doc_id", "start", "end", "source_start", "source_end", "matched"]


def aligned(texts: DataFrame, wanted: DataFrame, cuts: DataFrame, min_words: int, identity: float) -> DataFrame:
    """Passages of the chains in wanted (d, id, nth, lo, chains), with the words of cuts (d, id, nth, part, words). Rows come
    by document: its text first, then for each cut its chains and its parts in order."""
    none = {"text": "string", "id": "long", "nth": "int", "part": "long", "lo": "long", "chains": "array<binary>", "words": "binary"}

    def row(df: DataFrame, d: str, kind: int, *given: str) -> DataFrame:
        return df.select(F.col(d).alias("d"), F.lit(kind).alias("kind"), *(F.col(c) if c in given else F.lit(None).cast(t).alias(c) for c, t in none.items()))

    rows = row(filtered(texts, wanted.select(F.col("d").alias("id")).distinct()), "id", 0, "text").unionByName(row(wanted.withColumn("part", F.lit(-1).cast("long")), "d", 1, "id", "nth", "part", "lo", "chains")).unionByName(row(cuts, "d", 1, "id", "nth", "part", "words"))
    rows = rows.repartition("d").sortWithinPartitions("d", "kind", "id", "nth", "part")
    to_workers(texts.sparkSession)
    in_small_batches(texts.sparkSession)
    schema = StructType()
    for name in PASSAGE:
        schema = schema.add(name, as_kind("long"))

    def run(batches):
        doc, bodies, words, key, head, parts, source, taken, out = None, [], None, None, None, [], None, [], []

        def finish():
            nonlocal words, source, taken
            if not head or not parts:
                return
            if words is None:
                words = [b.encode().lower().split() for b in bodies]
            if source != key[0]:
                source, taken = key[0], []
            lo, found = head
            other = b" ".join(parts).split()
            for own in words:
                for chain in found:
                    points = np.frombuffer(chain, "<i4").reshape(-1, 2).tolist()
                    if points[-1][0] + RUN > len(own) or any(a <= points[0][0] and points[-1][0] + RUN <= b for a, b in taken):
                        continue  # within a passage of the same source
                    for x in passages(own, other, lo, points, min_words, identity):
                        taken.append(x[:2])
                        out.append((doc, key[0], *x))

        for batch in batches:
            columns = {n: batch.column(k) for k, n in enumerate(batch.schema.names)}
            for i, (d, kind) in enumerate(zip(columns["d"].to_pylist(), columns["kind"].to_pylist())):
                if kind == 0:
                    if d != doc:
                        finish()
                        doc, bodies, words, key, head, parts, source, taken = d, [], None, None, None, [], None, []
                    if (text := columns["text"][i].as_py()) not in bodies:  # repeated rows
                        bodies.append(text)
                    continue
                this = (columns["id"][i].as_py(), columns["nth"][i].as_py())
                if this != key:
                    finish()
                    key, head, parts = this, None, []
                if columns["part"][i].as_py() < 0:
                    head = (columns["lo"][i].as_py(), columns["chains"][i].as_py())
                else:
                    parts.append(columns["words"][i].as_py())
            if len(out) >= 1000:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out, strict=True)], PASSAGE)
                out = []
        finish()
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out, strict=True)], PASSAGE)

    return rows.mapInArrow(run, schema).distinct()


def without_passages(docs: DataFrame, min_words: int = MIN_WORDS, identity: float = IDENTITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with repeated passages cut out of the text column; what is around a cut is joined by a line feed. Documents
    of which a cut leaves nothing are dropped. Other columns stay as they are."""
    found = repeated_passages(docs, min_words, identity, id_col, text_col)
    spans = written(found.groupBy("doc_id").agg(F.collect_set(F.struct("start", "end")).alias("spans")), "spans")
    at = place(docs, text_col)
    rows = numbered(docs)
    names = rows.columns
    rows = rows.withColumn("own", whole_number(names[place(docs, id_col)])).join(spans, F.col("own") == F.col("doc_id"), "left")

    def make():
        def step(*columns):
            texts, gone = columns[at].to_pylist(), []
            for k, spans in enumerate(columns[-1].to_pylist()):
                if spans:
                    texts[k] = cut_out(texts[k], sorted((x["start"], x["end"]) for x in spans))
                gone.append(bool(spans) and not texts[k])
            return *columns[:at], texts, *columns[at + 1 : -1], gone

        return step

    schema = StructType()
    for name, f in zip(names, docs.schema, strict=True):
        schema = schema.add(name, f.dataType)
    schema = schema.add("gone", "boolean")
    out = map_batches(rows, [*names, "spans"], make, schema, [(f.name, to_arrow_type(f.dataType)) for f in schema])
    return restored(out.where("not gone"), docs)


def cut_out(text: str, spans: list[tuple[int, int]]) -> str:
    """A text without the words of the spans."""
    raw = text.encode()
    inside = np.ones(len(raw) + 2, bool)
    codes = np.frombuffer(raw, np.uint8)
    inside[1:-1] = (codes == 32) | ((codes >= 9) & (codes <= 13))
    starts, ends = np.flatnonzero(inside[:-1] & ~inside[1:]), np.flatnonzero(~inside[:-1] & inside[1:])
    parts, at = [], 0
    for a, b in spans:
        lo = int(starts[a])
        if lo > at:
            parts.append(raw[at:lo].strip())
        at = max(at, int(ends[b - 1]))
    parts.append(raw[at:].strip())
    return b"\n".join(p for p in parts if p).decode()
