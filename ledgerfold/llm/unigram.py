"""Operator 4: token counts by a count-only Viterbi pass.

token_counts(docs) gives the number of tokens of each whole text under a unigram vocabulary, as the sentencepiece
library counts them, without making the tokens. An Aho-Corasick automaton lists the vocabulary's pieces; dynamic
programming carries the best score and its number of pieces from character to character.

The tokenizer's rules, all of which decide between near-equal paths:
- of equal scores the piece that starts first wins; texts get a space in front, spaces are kept as they are;
- a character that is no piece itself is an unknown one, at the least score minus 10, and counts its UTF-8 bytes;
- scores are 32-bit sums, and where the best one up to a place is beyond REBASE in size it is taken off all places
  reached so far, which rounds them. A piece of a very low score (the single space: -1e9) so rounds what starts beside
  it to multiples of 64.

Where all scores are whole numbers, no piece has a line feed or a space after its first other character, and the single
space is beyond REBASE, texts are cut at spaces and line feeds: of all that was before, a cut's outcome depends on no
more than the sum's distance from a multiple of 64. Distinct cuts are run together, as arrays, and kept in
the worker. Other
vocabularies are run over the whole text at once.

The vocabulary is that of piece_bpe_32k.model, pieces with their scores, read as a unigram model. Null and empty texts
have no tokens and score 0; an empty table gives an empty table. Null ids and repeated rows stay rows of their own; texts
may be of any length. Extra columns are ignored. No shuffle.
"""

from __future__ import annotations

import re
from array import array
from itertools import chain

import ahocorasick
import numpy as np
from pyspark.sql import DataFrame

from .common import map_columns, per_worker, tokenizer_path, type_of

UNKNOWN_PENALTY = 10.0
#: Fixed value: the tokenizer's bound on partial sums.
REBASE = 1e5
#: Sums of whole numbers up to this size are exact in 32 bits.
EXACT = 1 << 24
#: Two roundings to a multiple of 64 can change a difference by no more.
ROUNDED = 128
#: Cuts kept in a worker (beside those of the texts at hand), cuts that are run together, and the longest of these.
KEPT, TOGETHER, LONG = 600_000, 10_000, 40
CUTS = re.compile(r"\n| +[^ \n]*|[^ \n]+").findall


class Numbers(dict):
    """Cuts by number: a new cut gets the next one and is noted."""

    __slots__ = ("new",)

    def __init__(self, *given):
        super().__init__(*given)
        self.new: list[str] = []

    def __missing__(self, cut: str) -> int:
        self[cut] = n = len(self)
        self.new.append(cut)
        return n


def rounding(rest):
    """A sum's distance from the nearest multiple of 64 (of two, the even one)."""
    return rest - 64 * np.round(rest / 64)


class UnigramCounter:
    def __init__(self, path: str | None = None, pieces: dict[str, float] | None = None):
        if pieces is None:
            from sentencepiece import SentencePieceProcessor

            model = SentencePieceProcessor(model_file=path)
            pieces = {model.id_to_piece(i).replace("▁", " "): model.get_score(i) for i in range(model.get_piece_size()) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))}
        self.f32 = array("f", [0.0])
        self.unknown = self.narrow(min(pieces.values()) - UNKNOWN_PENALTY)
        self.longest = max(map(len, pieces))
        self.exact = EXACT if all(float(s).is_integer() for s in pieces.values()) else 0
        self.cuts = self.exact and abs(pieces.get(" ", self.unknown)) > REBASE and abs(self.unknown) > REBASE and not any("\n" in p or "\0" in p or " " in p.lstrip(" ") for p in pieces)
        self.automaton, self.pieces = ahocorasick.Automaton(), pieces
        self.sizes, self.gains = list(map(len, pieces)), [self.narrow(g) for g in pieces.values()]
        for k, piece in enumerate(pieces):
            self.automaton.add_word(piece, k)
        self.automaton.make_automaton()
        self.size, self.gain = np.array(self.sizes), np.array(self.gains, np.float32)
        self.numbers = Numbers()
        #: Of each number: tokens, score, the rounding it leaves, whether those depend on the rounding before, how often seen.
        self.kept = [np.zeros(0, kind) for kind in (np.int64, np.float64, np.int8, bool, np.int64)]
        #: Tokens, score and the rounding left, by number * 128 + 64 + the rounding before.
        self.chosen: dict[int, tuple[int, float, int]] = {}

    def narrow(self, x: float) -> float:
        """The nearest 32-bit number."""
        self.f32[0] = x
        return self.f32[0]

    def best(self, cut: str, start: float = 0.0) -> tuple[int, float, float]:
        """Tokens and score of the tokenizer's path through a cut, and the sum it is left with (0 where that is taken
        off at once)."""
        n, narrow, exact = len(cut), self.narrow, self.exact
        begins: list = [None] * n
        for end, k in self.automaton.iter(cut):
            at = end + 1 - self.sizes[k]
            if begins[at] is None:
                begins[at] = []
            begins[at].append((end + 1, self.gains[k]))
        score, total, count = [0.0] * (n + 1), [0.0] * (n + 1), [0] * (n + 1)
        score[0] = start
        for i in range(n):
            till, had, sum_, steps = score[i], count[i], total[i], begins[i]
            begins[i] = None
            if till > REBASE or till < -REBASE:
                for e in range(i + 1, min(n, i + self.longest) + 1):
                    if count[e]:
                        x = score[e] - till
                        score[e] = x if -exact < x < exact else narrow(x)
                till = 0.0
            for e, gain in steps or ():
                x = till + gain
                if not -exact < x < exact:
                    x = narrow(x)
                if not count[e] or x > score[e]:
                    score[e], count[e], total[e] = x, had + 1, sum_ + gain
            if not steps or steps[0][0] != i + 1:
                e, x = i + 1, narrow(till + self.unknown)
                if not count[e] or x > score[e]:
                    score[e], count[e], total[e] = x, had + len(cut[i].encode()), sum_ + self.unknown
        rest = score[n]
        return count[n], total[n], 0.0 if rest > REBASE or rest < -REBASE else rest

    def outcomes(self, cuts: list[str], before: np.ndarray | None = None) -> list[np.ndarray]:
        """For each cut what best() gives (of the sum left, its rounding), and whether that depends on the rounding at the
        start; before: these roundings, 0 where not given. All cuts go through the dynamic programme together, a place at a
        time; a path's first piece tells what its sum was rounded with."""
        size = np.array([len(c) for c in cuts])
        n, most, text = len(cuts), int(size.max()), "\0".join(cuts)
        begin = np.cumsum(size + 1) - size - 1
        pairs = np.fromiter(chain.from_iterable(self.automaton.iter(text)), np.int64).reshape(-1, 2)
        ends, piece = pairs[:, 0] + 1, pairs[:, 1]
        row = np.repeat(np.arange(n, dtype=np.int32), size + 1)[ends - 1]
        ends -= begin[row]
        starts, gain = ends - self.size[piece], self.gain[piece]
        single = np.zeros((n, most), bool)
        single[row[ends == starts + 1], starts[ends == starts + 1]] = True
        lone, at = np.nonzero(~single & (np.arange(most) < size[:, None]))
        code = np.frombuffer(text.encode("utf-32-le"), np.uint32)[begin[lone] + at]
        adds = np.concatenate([np.ones(len(row), np.int32), np.int32(1) + (code > 0x7F) + (code > 0x7FF) + (code > 0xFFFF)])
        row, starts, ends = np.concatenate([row, lone]), np.concatenate([starts, at]), np.concatenate([ends, at + 1])
        gain = np.concatenate([gain, np.full(len(lone), self.unknown, np.float32)])
        order = np.argsort(starts, kind="stable")
        row, starts, ends, gain, adds = (x[order] for x in (row, starts, ends, gain, adds))
        bounds = np.searchsorted(starts, np.arange(most + 1))
        score, total = np.zeros((n, most + 1), np.float32), np.zeros((n, most + 1))
        count, first = np.zeros((n, most + 1), np.int32), np.zeros((n, most + 1), np.int16)
        base, sure = np.zeros(n, np.int16), np.ones(n, bool)
        if before is not None:
            score[:, 0] = before
        for i in range(most):
            till, own = score[:, i].copy(), first[:, i]
            edge = np.abs(till)
            sure &= ~((np.abs(edge - REBASE) <= ROUNDED) & (own != base) & (size > i))
            off = np.flatnonzero((edge > REBASE) & (size > i))
            if len(off):
                span = slice(i + 1, min(most, i + self.longest) + 1)
                score[off, span] -= np.where(count[off, span] > 0, till[off, None], np.float32(0))
                till[off], base[off] = 0, own[off]
            here = slice(bounds[i], bounds[i + 1])
            r, e = row[here], ends[here]
            x, mine = till[r] + gain[here], own[r] if i else e.astype(np.int16)
            old, there = score[r, e], count[r, e] > 0
            near = there & (np.abs(x - old) <= ROUNDED) & (first[r, e] != mine)
            sure[r[near]] = False
            take = ~there | (x > old)
            r, e, mine = r[take], e[take], mine[take]
            score[r, e], first[r, e] = x[take], mine
            count[r, e] = count[r, i] + adds[here][take]
            total[r, e] = total[r, i] + gain[here][take]
        every = np.arange(n)
        rest, own = score[every, size], first[every, size]
        far = np.abs(rest) > REBASE
        sure &= ~((np.abs(np.abs(rest) - REBASE) <= ROUNDED) & (own != base))
        rest[far] = 0
        left = rounding(rest)
        # a sum that moves with the rounding at the start does so by multiples of 64, which only a tie can tell apart;
        # after a line feed nothing is left to round
        open_ = (np.array([c[0] for c in cuts]) == " ") & ~(sure & (far | (own == base) | (np.abs(left) != 32)))
        return [count[every, size], total[every, size], left, open_]

    def make_room(self) -> None:
        """Of more than KEPT cuts, keeps the half most often seen."""
        if len(self.numbers) <= KEPT:
            return
        most = np.sort(np.argsort(-self.kept[4], kind="stable")[: KEPT // 2])
        cuts, again = list(self.numbers), np.full(len(self.numbers), -1)
        again[most] = np.arange(len(most))
        self.numbers = Numbers(zip([cuts[k] for k in most.tolist()], range(len(most))))
        self.kept = [x[most] for x in self.kept]
        self.kept[4] //= 2
        again = again.tolist()
        self.chosen = {again[k >> 7] << 7 | k & 127: x for k, x in self.chosen.items() if again[k >> 7] >= 0}

    def learn(self) -> None:
        """Sees to it that all numbered cuts are known."""
        cuts, self.numbers.new = self.numbers.new, []
        old, size = len(self.kept[0]), np.array([len(c) for c in cuts], np.int64)
        self.kept = [np.concatenate([x, np.zeros(len(cuts), x.dtype)]) for x in self.kept]
        order = np.argsort(size, kind="stable")
        short = order[size[order] <= LONG]
        for k in range(0, len(short), TOGETHER):
            some = short[k : k + TOGETHER]
            for x, found in zip(self.kept, self.outcomes([cuts[i] for i in some.tolist()])):
                x[old + some] = found
        for i in np.flatnonzero(size > LONG).tolist():
            if cuts[i][0] == " ":
                self.kept[3][old + i] = True
            else:
                tokens, score, rest = self.best(cuts[i])
                for x, found in zip(self.kept, (tokens, score, rounding(rest))):
                    x[old + i] = found

    def choose(self, keys: np.ndarray, cuts: list[str]) -> None:
        """Makes these keys of `chosen`, of the cuts given, known."""
        if len(self.chosen) > KEPT:
            self.chosen = {}
        need = [k for k, key in enumerate(keys.tolist()) if key not in self.chosen and len(cuts[k]) <= LONG]
        need.sort(key=lambda k: len(cuts[k]))
        for k in range(0, len(need), TOGETHER):
            some = need[k : k + TOGETHER]
            tokens, score, left, _ = self.outcomes([cuts[i] for i in some], (keys[some] & 127) - 64)
            self.chosen.update(zip(keys[some].tolist(), zip(tokens.tolist(), score.tolist(), left.astype(np.int64).tolist())))

    def counts(self, texts: list[str | None]) -> list[tuple[int, float]]:
        whole = [" " + t.replace("▁", " ") if t else "" for t in texts]
        if not self.cuts:
            return [self.best(t)[:2] if t else (0, 0.0) for t in whole]
        self.make_room()
        parts = [CUTS(t) for t in whole]
        size = np.fromiter(map(len, parts), np.int64, len(parts))
        cuts = list(chain.from_iterable(parts))
        number = np.fromiter(map(self.numbers.__getitem__, cuts), np.int64, len(cuts))
        self.learn()
        self.kept[4] += np.bincount(number, minlength=len(self.kept[4]))
        tokens, score, left, open_ = (x[number] for x in self.kept[:4])
        place = np.flatnonzero(open_)
        begins = np.zeros(len(cuts), bool)
        begins[(np.cumsum(size) - size)[size > 0]] = True
        before = np.where(begins[place], 0, left[place - 1]).astype(np.int64)
        follows = open_[place - 1] & ~begins[place]  # its rounding is that of the open cut before
        key = number[place] * 128 + 64
        keys, where = np.unique((key + before)[~follows], return_index=True)
        self.choose(keys, [cuts[i] for i in place[~follows][where].tolist()])
        found, rest = [], 0
        for i, k, own, after in zip(place.tolist(), key.tolist(), before.tolist(), follows.tolist()):
            rest = rest if after else own
            x = self.chosen.get(k + rest)
            if x is None:
                n, total, end = self.best(cuts[i], float(rest))
                x = self.chosen[k + rest] = (n, total, int(rounding(end)))
            found.append(x)
            rest = x[2]
        if found:
            tokens[place], score[place] = [x[0] for x in found], [x[1] for x in found]
        row = np.repeat(np.arange(len(parts)), size)
        n, total = np.bincount(row, tokens, len(parts)), np.bincount(row, score, len(parts))
        return list(zip(n.astype(np.int64).tolist(), total.tolist()))


def token_counts(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: the id column, n_tokens and score (of the tokenizer's path)."""
    path = path or tokenizer_path("piece_bpe_32k.model")

    def make():
        counter = per_worker(("unigram", path), lambda: UnigramCounter(path))

        def step(ids, texts):
            found = counter.counts(texts.to_pylist())
            return ids, [n for n, _ in found], [s for _, s in found]

        return step

    return map_columns(docs, [id_col, text_col], make, [(id_col, type_of(docs, id_col)), ("n_tokens", "long"), ("score", "double")])
