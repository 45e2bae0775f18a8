"""Operator 6: token ids in Re-Pair compressed files.

write_ids(docs, path) encodes whole texts, ends each document with an end id, and writes them in ascending id order as
a table of shards; read_ids(spark, path) gives the documents back, each with the number of ids before it. The rows are
dealt out by ranges of the id, sorted in each task, and cut into shards of about `shard_ids` ids (texts go in
batches of about `chars` characters, and neither a batch nor a document is cut). In a shard, frequent neighbouring pairs
become nonterminals, round by round, the most frequent first where two overlap, until no pair is found LEAST times; the
ends of documents are never part of a pair, so a document's symbols stay together and can be read alone.

File format: Parquet, a row for each shard: part and shard (the order), part_start (ids before the shard in its part),
n_tokens, doc_ids, doc_at (where each document's symbols begin), doc_tokens (its ids), rules (pairs, in the order of
their nonterminals), rule_tokens (expansion lengths), symbols, n_symbols, base (the first nonterminal) and bits. Numbers in
binary columns are little-endian and unsigned, of 32 bits; those of rules and symbols have `bits` bits: first the low 16
bits of all of them, then each further bit as a plane of one bit a number.

Null texts count as empty: the end id alone. Null document ids come first; repeated ids stay rows of their own, ordered
by text. An empty table gives an empty table. Extra columns are ignored. Only one number for each part (of as many
parts as the shuffle has) is gathered, to find where each part starts.
"""

from __future__ import annotations

from itertools import count

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..shipping import to_workers
from .common import per_worker, picked, slices, tokenizer_path, whole_number
from .hashing import pieces_in

END_ID, SHARD_IDS, LEAST = 1, 1 << 20, 4
GONE = np.uint32(0xFFFFFFFF)
#: Of the hash values by which a worker keeps the ids of pieces.
BITS = 22
DOCS_A_BATCH = 1000
#: A word may have ASCII signs after it. Where it ends in a letter that normalises to itself or its lower case, or in a
#: digit, the tokenizer splits between the two, whatever stands around them.
SIGNS = np.zeros(256, bool)
SIGNS[[b for b in range(33, 127) if not chr(b).isalnum() and chr(b) != "'"]] = True
#: Bytes of such letters: those of ASCII, and the second ones of the letters from U+00C0 to U+00FF.
LETTERS, DIGITS, SECONDS = (np.zeros(256, bool) for _ in range(3))
LETTERS[[b for b in range(128) if chr(b).isalpha()]] = True
DIGITS[[b for b in range(128) if chr(b).isdigit()]] = True
SECONDS[[b for b in range(0x80, 0xC0) if b not in (0x97, 0xB7)]] = True

SHARD_SCHEMA = "part int, shard int, part_start long, n_tokens long, doc_ids array<long>, doc_at binary, doc_tokens binary, rules binary, rule_tokens binary, symbols binary, n_symbols int, base int, bits int"
SHARD_FIELDS = pa.schema(
    [("part", pa.int32()), ("shard", pa.int32()), ("part_start", pa.int64()), ("n_tokens", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("doc_at", pa.binary()), ("doc_tokens", pa.binary()), ("rules", pa.binary()), ("rule_tokens", pa.binary()), ("symbols", pa.binary()), ("n_symbols", pa.int32()), ("base", pa.int32()), ("bits", pa.int32())]
)


#: Where runs end: space and line feed. No piece of the tokenizer goes across either.
BREAKS = np.zeros(256, bool)
BREAKS[[10, 32]] = True


class WordIds:
    """Ids of whole texts by the tokenizers library. Its splitting ends every piece at white space, and between a word
    and the signs behind it, so the ids of a text are those of these pieces, and each is encoded once and kept: in a
    table with one place for each hash value of `bits` bits, where a later piece takes the place of an earlier one. A
    piece is known by a 64-bit hash, its size and its first eight bytes. New words of a batch go to the library in one
    text, where each word's last id tells where it ends."""

    def __init__(self, path: str, bits: int = BITS):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.size, self.bits = self.tokenizer.get_vocab_size(with_added_tokens=True), np.uint64(64 - bits)
        self.ends = np.array([(self.tokenizer.id_to_token(i) or "").endswith("</w>") for i in range(self.size)])
        n = 1 << bits
        # a row is one line of memory: hash, first bytes, place in the pool, and size, safety and number of ids as one
        self.table = np.zeros((n, 4), np.uint64)
        self.pool, self.used = np.zeros(8 * n, np.uint16 if self.size < 1 << 16 else np.uint32), 0

    def library(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def pieces(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Ids of pieces, where each piece's begin, how many they are, and whether the tokenizer splits off signs behind
        it. Words of letters come first among the ids."""
        joined = b" ".join(pieces)
        raw, n = np.frombuffer(joined, np.uint8), np.array([len(p) for p in pieces])
        stop = np.cumsum(n + 1) - 1
        second = SECONDS[raw]
        second[1:] &= raw[:-1] == 0xC3
        letter = LETTERS[raw] | second
        letter[:-1] |= second[1:]
        safe = letter[stop - 1] | DIGITS[raw[stop - 1]]
        letter[stop[:-1]] = True  # the spaces between
        plain = np.logical_and.reduceat(letter, stop - n)
        if plain.all():
            rest, text = [], joined.decode()
        else:
            rest, text = [p.decode() for p, w in zip(pieces, plain) if not w], b" ".join(p for p, w in zip(pieces, plain) if w).decode()
        ids = np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids if text else [], self.pool.dtype)
        counts = np.diff(np.flatnonzero(self.ends[ids]), prepend=-1)
        if len(counts) != plain.sum():
            each = [self.library(w) for w in text.split(" ")]
            ids, counts = np.array([i for x in each for i in x], self.pool.dtype), np.array([len(x) for x in each], np.int64)
        each = [self.library(r) for r in rest]
        size = np.zeros(len(pieces), np.int64)
        size[plain], size[~plain] = counts, [len(x) for x in each]
        at = np.zeros(len(pieces), np.int64)
        at[plain] = np.cumsum(counts) - counts
        at[~plain] = len(ids) + np.cumsum(size[~plain]) - size[~plain]
        return np.concatenate([ids, np.array([i for x in each for i in x], self.pool.dtype)]), at, size, safe

    def room(self, n: int, slot, hashes, heads, size, at, count, safe) -> None:
        """Makes room for n ids. If there is none, ids that no row of the table names are let go; if what is left fills
        half of the pool, all is forgotten but the pieces given. Places move, also those given."""
        if self.used + n <= len(self.pool):
            return
        rows = np.flatnonzero(self.table[:, 3])
        rows = rows[np.argsort(self.table[rows, 2])]
        counts = (self.table[rows, 3] & np.uint64(0xFFFFFF)).astype(np.int64)
        if 2 * (int(counts.sum()) + n) <= len(self.pool):
            self.used = 0
            for k in range(0, len(rows), 1 << 16):  # places only go down, so nothing is overwritten before it is read
                own, many = rows[k : k + (1 << 16)], counts[k : k + (1 << 16)]
                old = self.pool[spread(self.table[own, 2].astype(np.int64), many)]
                self.pool[self.used : self.used + len(old)] = old
                self.table[own, 2] = self.used + np.cumsum(many) - many
                self.used += len(old)
            at[:] = self.table[slot, 2]
            return
        old = self.pool[spread(at, count)]
        self.table[:] = 0
        self.pool = np.zeros(max(len(self.pool), 2 * (len(old) + n)), self.pool.dtype)
        self.pool[: len(old)], self.used = old, len(old)
        at[:] = np.cumsum(count) - count
        self.put(slot, hashes, heads, size, at, count, safe)

    def put(self, slot, hashes, heads, size, at, count, safe) -> None:
        fits = np.flatnonzero(count < 1 << 24)  # a longer piece is encoded anew each time
        slot, hashes, heads, size, at, count, safe = (x[fits] for x in (slot, hashes, heads, size, at, count, safe))
        rest = (size.astype(np.uint64) << np.uint64(25)) | (safe.astype(np.uint64) << np.uint64(24)) | np.asarray(count, np.uint64)
        self.table[slot] = np.column_stack([hashes, heads, at.astype(np.uint64), rest])

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one after another, and how many each has."""
        parts = [t.encode() if t else b"" for t in texts]
        raw = b"\n".join(parts)
        special = b"<|" in raw  # special tokens are looked for in the text as it is
        raw = raw if special else raw.lower()  # A-Z; the tokenizer does so too, later
        hashes, start, size, tail = pieces_in(np.frombuffer(raw, np.uint8), BREAKS, None if special else SIGNS)
        heads = np.ndarray(len(raw) + 1, "<u8", raw + bytes(8), strides=(1,))[start]
        heads &= np.where(size < 8, (np.uint64(1) << (size.astype(np.uint64) * np.uint64(8) & np.uint64(63))) - np.uint64(1), ~np.uint64(0))
        slot = (hashes >> self.bits).astype(np.int64)
        rows = np.take(self.table, slot, axis=0)
        rest = rows[:, 3].astype(np.int64)
        known = (rows[:, 0] == hashes) & (rows[:, 1] == heads) & (rest >> 25 == size)
        at, count, safe = rows[:, 2].astype(np.int64), rest & 0xFFFFFF, (rest >> 24) & 1 == 1
        new = np.flatnonzero(~known)
        if len(new):
            _, first, which = np.unique(hashes[new], return_index=True, return_inverse=True)
            first = new[first]
            ids, places, counts, fine = self.pieces([raw[i : i + n] for i, n in zip(start[first].tolist(), size[first].tolist())])
            keep = np.flatnonzero(known)
            moved = at[keep]
            self.room(len(ids), slot[keep], hashes[keep], heads[keep], size[keep], moved, count[keep], safe[keep])
            at[keep] = moved
            self.pool[self.used : self.used + len(ids)] = ids
            places += self.used
            self.used += len(ids)
            self.put(slot[first], hashes[first], heads[first], size[first], places, counts, fine)
            at[new], count[new], safe[new] = places[which], counts[which], fine[which]
        joined = np.flatnonzero(tail[1:] & ~safe[:-1])  # signs that the tokenizer may not split off: both as one
        more = [self.library(raw[start[k] : start[k + 1] + size[k + 1]].decode()) for k in joined]
        extra = np.array([i for x in more for i in x], self.pool.dtype)
        count[joined + 1], count[joined] = 0, [len(x) for x in more]
        pool = self.pool
        if len(extra):
            if self.used + len(extra) > len(pool):
                pool = np.concatenate([pool[: self.used], extra])
            pool[self.used : self.used + len(extra)] = extra  # for this batch only
            at[joined] = self.used + np.cumsum(count[joined]) - count[joined]
        total = np.concatenate([[0], np.cumsum(count)])
        ends = total[np.searchsorted(start, np.cumsum([len(p) + 1 for p in parts]))]
        return pool[spread(at, count)], np.diff(ends, prepend=0)


def spread(at: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Indices of pieces of `count` items from `at` on, laid one after another."""
    begin = np.cumsum(count, dtype=np.int64) - count
    return np.repeat(at - begin, count) + np.arange(int(count.sum()))


def batches_of(texts: list[str | None], chars: int = 1 << 17):
    """Ranges of texts with about so many characters; a longer text is a range of its own."""
    start = n = 0
    for k, t in enumerate(texts):
        n += len(t or "")
        if n >= chars:
            yield range(start, k + 1)
            start, n = k + 1, 0
    if start < len(texts):
        yield range(start, len(texts))


def maybe(seq: np.ndarray, bar: int) -> np.ndarray:
    """Places whose pair may be found `bar` times: pairs are counted by a hash that some of them share."""
    bits = max(8, min(20, len(seq).bit_length()))
    slot = seq[:-1] * np.uint32(0x9E3779B1)
    slot += seq[1:] * np.uint32(0x85EBCA77)
    slot >>= np.uint32(32 - bits)
    slot = slot.astype(np.intp)
    return np.flatnonzero(np.take(np.bincount(slot, minlength=1 << bits) >= bar, slot))


def frequent(left: np.ndarray, right: np.ndarray, places: np.ndarray, bar: int, top: int, n: int, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the pairs (left, right) at `places`, with symbols below top and places below n, the `most` frequent ones that are
    found `bar` times: their places (ascending), the urgency of the pair at each (the most frequent pair has the highest
    number), and the pairs, that of urgency k at k - 1."""
    wide, deep = np.uint64(int(top).bit_length()), np.uint64(int(n).bit_length())
    pair = (left.astype(np.uint64) << wide) | right
    if 2 * wide + deep <= 64:
        pair = np.sort((pair << deep) | places.astype(np.uint64))
        places = (pair & ((np.uint64(1) << deep) - np.uint64(1))).astype(np.int64)
        pair >>= deep
    else:
        order = np.argsort(pair, kind="stable")
        pair, places = pair[order], places[order]
    first = np.flatnonzero(np.concatenate([[True], pair[1:] != pair[:-1]])) if len(pair) else places
    found = np.diff(first, append=len(pair))
    often = np.flatnonzero(found >= bar)
    often = often[np.argsort(found[often], kind="stable")][max(0, len(often) - most) :]
    urgency = np.zeros(len(found), np.int32)
    urgency[often] = np.arange(1, len(often) + 1)
    urgency = np.repeat(urgency, found)
    mine = np.flatnonzero(urgency)
    places, urgency = places[mine], urgency[mine]
    if len(places) < n >> 6:
        order = np.argsort(places)
        places, urgency = places[order], urgency[order]
    else:
        laid = np.zeros(n, np.int32)
        laid[places] = urgency
        places = np.flatnonzero(laid)
        urgency = laid[places]
    pair = pair[first[often]]
    return places, urgency, np.column_stack([pair >> wide, pair & ((np.uint64(1) << wide) - np.uint64(1))]).astype(np.int64)


def taken(urgency: np.ndarray, touch: np.ndarray) -> np.ndarray:
    """Which of the pairs at ascending places are replaced. touch: whether one overlaps with the next. Of one pair again
    and again (x x x) every second place is taken, else the more urgent one."""
    left, right = np.zeros_like(urgency), np.zeros_like(urgency)
    left[1:], right[:-1] = urgency[:-1] * touch, urgency[1:] * touch
    take = (urgency >= left) & (urgency >= right)
    same = left == urgency
    if same.any():
        place = np.arange(len(urgency))
        take &= (place - np.maximum.accumulate(np.where(same, 0, place))) % 2 == 0
    return take


def named(urgency: np.ndarray, pairs: np.ndarray, first: int) -> tuple[np.ndarray, np.ndarray]:
    """Symbols from `first` on for the pairs replaced (one urgency for each place), and their rules in that order."""
    used = np.zeros(len(pairs) + 1, bool)
    used[urgency] = True
    new = np.flatnonzero(used)
    name = np.zeros(len(used), np.uint32)
    name[new] = np.arange(first, first + len(new))
    return name[urgency], pairs[new - 1]


def compress(ids: np.ndarray, base: int, end_id: int = END_ID) -> tuple[np.ndarray, np.ndarray]:
    """Re-Pair: symbols and rules (pairs; rule k is symbol base + k). Each round counts pairs, gives those found often a
    nonterminal, and replaces them, until no pair is found LEAST times.

    While the bar for "often" falls, all places are counted, and a round makes one rule for 128 symbols at most (the other
    pairs wait for the next one, where those that overlapped with more frequent ones are fewer). After that only places that can matter are: a pair's number
    never grows but for pairs with a symbol just made, so these and the places of pairs that had reached LEAST are all
    there are. From there on symbols stay where they are, and each knows the place of the next and of the one before."""
    seq, rules, made = ids.astype(np.uint32), [np.zeros((0, 2), np.int64)], 0
    for k in count():
        bar = max(LEAST, len(seq) >> (8 + 3 * k))
        at = maybe(seq, bar)
        at = at[(seq[at] != end_id) & (seq[at + 1] != end_id)]
        at, urgency, pairs = frequent(seq[at], seq[at + 1], at, bar, base + made, len(seq), len(seq) if bar == LEAST else 1 + (len(seq) >> 7))
        if bar == LEAST:
            break
        if len(at):
            take = taken(urgency, np.diff(at) == 1)
            spot = at[take]
            seq[spot], new = named(urgency[take], pairs, base + made)
            rules.append(new)
            made += len(new)
            keep = np.ones(len(seq), bool)
            keep[spot + 1] = False
            seq = seq[keep]
    n = len(seq)
    seq = np.append(seq, np.uint32(end_id))  # so that the last symbol has a next one
    after, before = np.arange(1, n + 2, dtype=np.int32), np.arange(-1, n, dtype=np.int32)
    while len(at):
        take = taken(urgency, after[at[:-1]] == at[1:])
        spot = at[take]
        seq[spot], new = named(urgency[take], pairs, base + made)
        rules.append(new)
        made += len(new)
        gone = after[spot]
        seq[gone] = GONE
        after[spot] = after[gone]
        before[after[spot]] = spot
        live = np.zeros(n + 1, bool)
        live[at] = True
        live[before[spot]] = True  # -1, before the first, is the last, which has no pair
        live[n] = False
        at = np.flatnonzero(live)
        left, right = seq[at], seq[after[at]]
        fits = (left != end_id) & (left != GONE) & (right != end_id)
        at, urgency, pairs = frequent(left[fits], right[fits], at[fits], LEAST, base + made, n, n)
    seq = seq[:n]
    return seq[seq != GONE].astype(np.int64), np.concatenate(rules)


def squeezed(symbols: np.ndarray, bits: int) -> bytes:
    """Numbers of `bits` bits: their low 16 bits, then each further bit of all numbers as a plane of its own."""
    planes = [np.packbits((symbols >> k & 1).astype(np.uint8), bitorder="little").tobytes() for k in range(16, bits)]
    return b"".join([(symbols & 0xFFFF).astype("<u2").tobytes(), *planes])


def unsqueezed(raw: bytes, bits: int, n: int) -> np.ndarray:
    out, size = np.frombuffer(raw, "<u2", n).astype(np.int64), (n + 7) // 8
    for k in range(16, bits):
        plane = np.frombuffer(raw, np.uint8, size, 2 * n + (k - 16) * size)
        out |= np.unpackbits(plane, count=n, bitorder="little").astype(np.int64) << k
    return out


def generations(rules: np.ndarray, base: int):
    """Ranges of rules that stand on symbols from before the range."""
    top, start = np.maximum.accumulate(rules.max(axis=1)) if len(rules) else rules, 0
    while start < len(rules):
        stop = int(np.searchsorted(top, base + start))
        yield start, stop
        start = stop


def lengths(rules: np.ndarray, base: int) -> np.ndarray:
    """How many ids each nonterminal stands for."""
    size = np.ones(base + len(rules), np.int64)
    for start, stop in generations(rules, base):
        size[base + start : base + stop] = size[rules[start:stop]].sum(axis=1)
    return size[base:]


class Grammar:
    """Expansions of the symbols of a shard, laid one after another."""

    def __init__(self, rules: np.ndarray, base: int):
        self.base = base
        self.size = np.concatenate([np.ones(base, np.int64), lengths(rules, base)])
        self.offset = np.cumsum(self.size) - self.size
        self.blob = np.arange(int(self.size.sum()), dtype="<u4")  # the first ones stand for themselves
        for start, stop in generations(rules, base):
            made = self.expand(rules[start:stop].ravel())
            at = int(self.offset[base + start])
            self.blob[at : at + len(made)] = made

    def expand(self, symbols: np.ndarray) -> np.ndarray:
        return self.blob[spread(self.offset[symbols], self.size[symbols])]


def pack(part: int, shard: int, part_start: int, doc_ids: list, ids: np.ndarray, counts: np.ndarray, base: int, end_id: int) -> pa.RecordBatch:
    """A shard of documents' ids and how many each has, its end ids not yet among them."""
    # a text may have the end id itself, so documents are parted by a symbol outside the vocabulary while pairs are made
    parting, base = base, base + 1
    ids = np.insert(ids, np.cumsum(counts), parting).astype("<u4")
    symbols, rules = compress(ids, base, parting)
    ends = np.flatnonzero(symbols == parting)
    symbols[ends] = end_id
    tokens = (counts + 1).astype("<u4")
    bits = max(16, int(base + len(rules) - 1).bit_length())
    row = {"part": part, "shard": shard, "part_start": part_start, "n_tokens": len(ids), "doc_ids": doc_ids, "doc_at": np.concatenate([[0], ends[:-1] + 1]).astype("<u4").tobytes(), "doc_tokens": tokens.tobytes(), "rules": squeezed(rules.ravel(), bits), "rule_tokens": lengths(rules, base).astype("<u4").tobytes(), "symbols": squeezed(symbols, bits), "n_symbols": len(symbols), "base": base, "bits": bits}
    return pa.RecordBatch.from_pylist([row], schema=SHARD_FIELDS)


def write_ids(docs: DataFrame, path: str, tokenizer: str | None = None, end_id: int = END_ID, shard_ids: int = SHARD_IDS, chars: int = 1 << 17, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Writes the documents' ids under path (a folder all executors can reach)."""
    to_workers(docs.sparkSession)
    tokenizer = tokenizer or tokenizer_path("word_bpe_49k.json")
    rows = picked(docs, d=id_col, t=text_col).select(whole_number("d").alias("d"), F.col("t").cast("string").alias("t"))
    rows = rows.repartitionByRange("d").sortWithinPartitions("d", "t")

    def run(batches):
        part, shard, start = TaskContext.get().partitionId(), 0, 0
        words, doc_ids, ids, counts, n = None, [], [], [], 0

        def packed():
            nonlocal shard, start, doc_ids, ids, counts, n
            out = pack(part, shard, start, doc_ids, np.concatenate(ids), np.concatenate(counts), words.size, end_id)
            shard, start, doc_ids, ids, counts, n = shard + 1, start + n, [], [], [], 0
            return out

        for batch in (part for whole in batches for part in slices(whole)):
            words = words or per_worker(("words", tokenizer), lambda: WordIds(tokenizer))
            keys, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for span in batches_of(texts, chars):
                got, count = words.encode(texts[span.start : span.stop])
                doc_ids += keys[span.start : span.stop]
                ids.append(got)
                counts.append(count)
                n += len(got) + len(count)
                if n >= shard_ids:
                    yield packed()
        if doc_ids:
            yield packed()

    rows.mapInArrow(run, SHARD_SCHEMA).write.parquet(path)


def unpacked(row: dict) -> tuple[Grammar, np.ndarray, np.ndarray, np.ndarray]:
    rules = unsqueezed(row["rules"], row["bits"], len(row["rule_tokens"]) // 2).reshape(-1, 2)
    return Grammar(rules, row["base"]), unsqueezed(row["symbols"], row["bits"], row["n_symbols"]), np.frombuffer(row["doc_at"], "<u4"), np.frombuffer(row["doc_tokens"], "<u4")


def tokens_of(row: dict, k: int, first: int = 0, last: int | None = None) -> np.ndarray:
    """Random access: ids first..last of document k of a shard. Expansion lengths tell which symbols to expand."""
    grammar, symbols, at, tokens = unpacked(row)
    own = symbols[at[k] : at[k + 1] if k + 1 < len(at) else len(symbols)]
    last = int(tokens[k]) if last is None else min(last, int(tokens[k]))
    if first >= last:
        return np.zeros(0, np.uint32)
    ends = np.cumsum(grammar.size[own])
    i, j = np.searchsorted(ends, first, "right"), np.searchsorted(ends, last, "left") + 1
    before = int(ends[i - 1]) if i else 0
    return grammar.expand(own[i:j])[first - before : last - before]


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens and ids (binary, little-endian unsigned 32-bit) of each document written."""
    to_workers(spark)
    shards = spark.read.schema(SHARD_SCHEMA).parquet(path)
    parts = shards.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    parts = parts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    fields = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())])

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                grammar, symbols, _, tokens = unpacked(row)
                ids = grammar.expand(symbols)
                bounds = np.concatenate([[0], np.cumsum(tokens, dtype=np.int64)])
                for lo in range(0, len(tokens), DOCS_A_BATCH):
                    hi = min(lo + DOCS_A_BATCH, len(tokens))
                    own = ids[bounds[lo] : bounds[hi]]
                    offsets = (4 * (bounds[lo : hi + 1] - bounds[lo])).astype(np.int32)
                    raw = pa.Array.from_buffers(pa.binary(), hi - lo, [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(own, "<u4"))])
                    yield pa.RecordBatch.from_arrays([pa.array(row["doc_ids"][lo:hi], pa.int64()), pa.array(bounds[lo:hi] + (row["part_start"] + row["before"])), pa.array(tokens[lo:hi].astype(np.int64)), raw], schema=fields)

    return shards.join(F.broadcast(parts), "part").mapInArrow(run, "doc_id long, start long, n_tokens long, ids binary")
