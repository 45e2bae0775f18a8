"""Operator 9: toxicity by a weighted lexicon.

Text is folded (lower case, look-alike letters of other scripts, digits and signs that stand for letters in a word,
letters spaced out, invisible characters), cut into words of letters, and scanned by one Aho-Corasick automaton whose
entries are whole words and beginnings of words, each with a weight. Words with accents, strokes or small capitals are
scanned without these too. A match inside an exception phrase does not count. The weights' sum and its share of the
text's length go through a logistic curve to a score from 0 to 1.

learn() makes the lexicon and the curve from labelled rows: entries are the words and word beginnings found in toxic
documents far more often than in others (log odds, smoothed), beside a short fixed list of insults. It fits on at most
`sample` labelled rows, those of the smallest hashed ids; rows held out (crc32 of the id as text, mod 4, is 2) are never
among them. Label, language, source and id are no inputs of a score.

Null and empty texts have no words and get the score of a text without matches. Null ids are never held out and never
learnt from; repeated rows stay rows of their own. Without labels the fixed list and default curve hold. Extra columns
are ignored; empty tables give empty tables. The documents are not shuffled: the sampled ids (at most `sample`) are
broadcast, and the rows they find are written once.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches, picked, restored, with_columns, written

SAMPLE, ENTRIES, THRESHOLD = 12_000, 600, 0.3
#: Insults known without any labels.
SEEDS = ["asshole", "bastard", "bitch", "cretin", "dumbass", "fuck", "fucking", "idiot", "imbecile", "moron", "retard", "scumbag", "shithead", "slut", "whore", "wanker", "arschloch", "hurensohn", "connard", "salope", "gilipollas", "pendejo"]
#: Those of them that no harmless word begins with.
STEMS = {"asshole", "bastard", "bitch", "dumbass", "fuck", "idiot", "imbecile", "moron", "scumbag", "shithead", "wanker", "arschloch", "hurensohn", "connard", "salope", "gilipollas", "pendejo"}
SEED_WEIGHT = 3.0
#: Phrases in which lexicon words insult nobody.
EXCEPTIONS = ["trash can", "trash bin", "trash bag", "take out the trash", "taking out the trash", "clown fish", "circus clown", "class clown", "sore loser", "pathetic fallacy", "dostoevsky s the idiot", "idiot proof", "idiot s guide", "idiots guide", "moronic acid", "pond scum", "scum layer"]
#: Letters of other scripts that look like Latin ones.
LOOK_ALIKES = {
    "а": "a", "в": "b", "г": "r", "е": "e", "к": "k", "м": "m", "н": "h", "о": "o", "п": "n", "р": "p", "с": "c", "т": "t", "у": "y", "х": "x", "и": "u",
    "і": "i", "ј": "j", "ѕ": "s", "ԁ": "d", "ԛ": "q", "ԝ": "w", "һ": "h", "ӏ": "l", "α": "a", "β": "b", "γ": "y", "ε": "e", "η": "n", "ι": "i", "κ": "k",
    "μ": "u", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ω": "w", "ı": "i", "ɑ": "a", "ɡ": "g", "ѵ": "v", "ѡ": "w", "ь": "b", "ҽ": "e", "ү": "y",
    "օ": "o", "ո": "n", "ս": "u", "հ": "h", "ց": "g", "զ": "q", "յ": "j", "լ": "l", "ϲ": "c", "ϳ": "j", "σ": "o", "δ": "d", "ƽ": "s", "ʟ": "l", "ſ": "s",
}
#: Digits and signs that stand for letters.
SIGNS = str.maketrans("0134578@$!#|+€£¡", "oieastbasihlteli")
INVISIBLE = dict.fromkeys([0xAD, 0x34F, *range(0x200B, 0x2010), *range(0x2060, 0x2065), *range(0xFE00, 0xFE10), 0xFEFF], None)


def look_alikes() -> dict[int, str]:
    """The table above, and the letters that are one of its letters with a mark, stroke or hook, by their names."""
    out = {ord(c): x for c, x in LOOK_ALIKES.items()}
    for code in (*range(0x370, 0x590), *range(0x1C80, 0x1C90), *range(0x1F00, 0x2000), *range(0xA640, 0xA6A0)):
        base = unicodedata.name(chr(code), "").split(" WITH ")[0]
        try:
            base = unicodedata.lookup(base)
        except KeyError:
            continue
        if base in LOOK_ALIKES:
            out[code] = LOOK_ALIKES[base]
    return out


def plain_letters() -> dict[int, str]:
    """Latin letters with strokes, hooks and the like, small capitals and phonetic forms, by their names."""
    named = re.compile(r"LATIN (?:SMALL LETTER|LETTER SMALL CAPITAL) (?:DOTLESS |TURNED |REVERSED |OPEN |SCRIPT |SMALL CAPITAL |LONG |SIDEWAYS )?([A-Z])(?: WITH .*)?$").match
    return {code: m[1].lower() for code in (*range(0xDF, 0x2B0), *range(0x1D00, 0x1D80), *range(0x1E00, 0x1F00), *range(0x2C60, 0x2C80), *range(0xA720, 0xA800)) if (m := named(unicodedata.name(chr(code), "")))}


FOLD = look_alikes() | INVISIBLE
PLAIN = plain_letters()
RUN_OF_SIGNS = re.compile(r"[0134578@$!#|+€£¡]+")
FIRM = "013457@$€"
#: Two single letters with the same sign or space before and between them; four or more of them.
MAYBE_SPACED = re.compile(r"([ .\-_*·])[^\W\d_]\1[^\W\d_](?!\w)").search
SPACED = re.compile(r"(?<![\w])[^\W\d_]([ .\-_*·])(?:[^\W\d_]\1){2,}[^\W\d_](?![\w])")
WORDS = re.compile(r"[^\W\d_]+").findall


def letters_for(m: re.Match) -> str:
    """A run of signs with those that stand for letters replaced: all of them between letters; digits, @, $ and € right
    before a letter; one or two of these at a word's end."""
    run, text, start, end = m[0], m.string, m.start(), m.end()
    before, after = start > 0 and text[start - 1].isalpha(), end < len(text) and text[end].isalpha()
    if before and after:
        return run.translate(SIGNS)
    if after:
        kept = run.rstrip(FIRM)
        return kept + run[len(kept) :].translate(SIGNS)
    if before:
        firm = len(run) - len(run.lstrip(FIRM))
        then = text[start + firm : start + firm + 1]
        if 1 <= firm <= 2 and not (then.isalnum() or then == "_"):
            return run[:firm].translate(SIGNS) + run[firm:]
    return run


def fold(text: str) -> str:
    """Folded text; accents stay, as they tell words of other languages apart."""
    text = text.lower()
    if not text.isascii():
        if not unicodedata.is_normalized("NFKC", text):
            text = unicodedata.normalize("NFKC", text).lower()
        text = text.translate(FOLD)
    text = RUN_OF_SIGNS.sub(letters_for, text)
    return SPACED.sub(lambda m: m[0].replace(m[1], ""), text) if MAYBE_SPACED(text) else text


def bare(text: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFD", text) if not unicodedata.combining(c)).translate(PLAIN)


@dataclass
class Lexicon:
    """weights: an entry is " word " or, for a beginning, " wor"."""

    weights: dict[str, float] = field(default_factory=lambda: {f" {w}" if w in STEMS else f" {w} ": SEED_WEIGHT for w in SEEDS})
    curve: tuple[float, float, float] = (-4.0, 2.0, 1.0)
    exceptions: tuple[str, ...] = tuple(EXCEPTIONS)

    def scanner(self) -> "Scanner":
        return Scanner(self)


class Scanner:
    def __init__(self, lexicon: Lexicon):
        self.curve = lexicon.curve
        self.all, self.plain = ahocorasick.Automaton(), ahocorasick.Automaton()
        for entry, weight in lexicon.weights.items():
            self.all.add_word(entry, (entry, weight))
            if entry.isascii() and (entry.endswith(" ") or entry.strip() in STEMS):
                self.plain.add_word(entry, (entry, weight))
        for phrase in lexicon.exceptions:
            self.all.add_word(f" {phrase} ", (f" {phrase} ", None))
        for a in (self.all, self.plain):
            if len(a):
                a.make_automaton()

    def matches(self, text: str) -> tuple[list[tuple[str, float]], int]:
        """Matches with their weights, one for a word at most (the heaviest), and the number of words."""
        words = WORDS(fold(text))
        line = f" {' '.join(words)} "
        found, spared = {}, []
        automata = [(self.all, line)]
        if not line.isascii():  # insults with accents put on
            stripped = bare(line)
            if stripped != line and len(stripped) == len(line):
                automata.append((self.plain, stripped))
        for automaton, where in automata:
            if len(automaton):
                for end, (entry, weight) in automaton.iter(where):
                    start = end + 1 - len(entry)
                    if weight is None:
                        spared.append((start, end))
                    elif start not in found or found[start][1] < weight:
                        found[start] = (entry, weight)
        return [x for start, x in sorted(found.items()) if not any(a <= start < b for a, b in spared)], len(words)

    def features(self, text: str | None) -> tuple[float, float, list[str], int]:
        hits, n = self.matches(text) if text else ([], 0)
        total = sum(w for _, w in hits)
        return math.log1p(total), math.log1p(100 * total / max(n, 20)), [x.strip() for x, _ in hits], n

    def score(self, text: str | None) -> tuple[float, list[str], int]:
        x1, x2, terms, n = self.features(text)
        a, b, c = self.curve
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, a + b * x1 + c * x2)))), terms, n


def held_out(id_col: str = "doc_id"):
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def entries_of(text: str) -> set[str]:
    """What of a text may become an entry: its words, and the beginnings of 4 to 9 letters."""
    out = set()
    for word in set(WORDS(fold(text))):
        if 3 <= len(word) <= 24:
            out.add(f" {word} ")
        for k in range(4, min(9, len(word)) + 1):
            out.add(f" {word[:k]}")
    return out


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, entries: int = ENTRIES, id_col: str = "doc_id", text_col: str = "text") -> Lexicon:
    """Lexicon and curve from labelled rows outside the held-out part; brings counts of at most 20 * entries entries
    and two numbers for each sampled row to the driver."""
    known = picked(labels, k=id_col, y="toxic").where(F.col("k").isNotNull() & F.col("y").isNotNull() & ~held_out("k")).groupBy("k").agg(F.max("y").cast("int").alias("y"))
    known = known.orderBy(F.xxhash64("k"), "k").limit(sample)
    rows = picked(docs, k=id_col, t=text_col).where(F.col("t") != "").join(F.broadcast(known), "k").select("t", "y")
    rows = written(rows, "toxicity-sample")
    totals = {r["y"]: r["n"] for r in rows.groupBy("y").agg(F.count("*").alias("n")).collect()}
    lexicon = Lexicon()
    if not totals.get(1) or not totals.get(0):
        return lexicon

    def make():
        def step(texts, ys):
            counts: tuple[Counter, Counter] = Counter(), Counter()
            for text, y in zip(texts.to_pylist(), ys.to_pylist(), strict=True):
                counts[y > 0].update(entries_of(text))
            names = list(counts[0] | counts[1])
            return names, [counts[0][x] for x in names], [counts[1][x] for x in names]

        return step

    seen = map_batches(rows, ["t", "y"], make, "entry string, n0 long, n1 long", [("entry", pa.string()), ("n0", pa.int64()), ("n1", pa.int64())])
    t0, t1 = totals[0], totals[1]
    odds = F.log((F.col("n1") + 0.5) / (t1 + 1)) - F.log((F.col("n0") + 0.5) / (t0 + 1))
    least = max(3, t1 // 400)
    seen = seen.groupBy("entry").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")).where(F.col("n1") >= least)
    seen = seen.withColumn("w", odds).where((F.col("w") > 2.5) & (F.col("w") * F.sqrt("n1") > 8)).orderBy(F.desc(F.round(F.col("w") * F.sqrt("n1"), 6)), F.desc(F.endswith("entry", F.lit(" "))), F.length("entry"), "entry").limit(20 * entries)
    chosen = prune([(r["entry"], r["w"], r["n0"], r["n1"]) for r in seen.collect()])[:entries]
    lexicon.weights |= {e: round(w, 4) for e, w in chosen}
    scanner_of = lexicon.scanner

    def measure():
        scanner = scanner_of()

        def step(texts, ys):
            x = [scanner.features(t)[:2] for t in texts.to_pylist()]
            return [a for a, _ in x], [b for _, b in x], ys

        return step

    points = map_batches(rows, ["t", "y"], measure, "a double, b double, y int", [("a", pa.float64()), ("b", pa.float64()), ("y", pa.int32())]).toPandas()
    lexicon.curve = fit(points[["a", "b"]].to_numpy(), (points["y"] > 0).to_numpy(float))
    return lexicon


def prune(found: list[tuple[str, float, int, int]]) -> list[tuple[str, float]]:
    """Leaves out an entry where a kept one covers it as well: a beginning of a kept word that is found no more often,
    or what starts with a kept beginning."""
    kept: dict[str, tuple[float, int]] = {}
    for entry, w, _, n1 in found:
        if any(entry[:k] in kept for k in range(4, len(entry))):
            continue
        if not entry.endswith(" ") and any(x.startswith(entry) and n >= 0.9 * n1 for x, (_, n) in kept.items()):
            continue
        kept[entry] = (w, n1)
    return [(e, w) for e, (w, _) in kept.items()]


def fit(x: np.ndarray, y: np.ndarray) -> tuple[float, float, float]:
    """Logistic regression by Newton's method with a small ridge."""
    x = np.column_stack([np.ones(len(x)), x])
    w, ridge = np.zeros(3), np.diag([1e-3, 1e-1, 1e-1])
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge, x.T @ (y - p) - ridge @ w)
        w = w + np.clip(step, -3, 3)
        if np.abs(step).max() < 1e-8:
            break
    return tuple(float(v) for v in w)


def scored(docs: DataFrame, lexicon: Lexicon, threshold: float = THRESHOLD, text_col: str = "text") -> DataFrame:
    """docs' columns as c0, c1, ... and score, predicted (1 where score >= threshold), terms and words (how many)."""

    def make():
        scanner = lexicon.scanner()

        def step(texts):
            found = [scanner.score(t) for t in texts.to_pylist()]
            return [s for s, _, _ in found], [int(s >= threshold) for s, _, _ in found], [t for _, t, _ in found], [n for _, _, n in found]

        return step

    return with_columns(docs, [text_col], make, [("score", "double"), ("predicted", "int"), ("terms", "array<string>"), ("words", "long")])


def toxic(docs: DataFrame, lexicon: Lexicon, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: the id column, score, predicted, toxic_terms (the entries found) and toxic_words (the number of words)."""
    found = scored(picked(docs, id=id_col, text=text_col), lexicon, threshold)
    return found.select("c0", "score", "predicted", "terms", "words").toDF(id_col, "score", "predicted", "toxic_terms", "toxic_words")


def without_toxic(docs: DataFrame, lexicon: Lexicon, threshold: float = THRESHOLD, text_col: str = "text") -> DataFrame:
    """docs, all columns as they are, without the rows predicted toxic."""
    return restored(scored(docs, lexicon, threshold, text_col).where("predicted = 0"), docs)
