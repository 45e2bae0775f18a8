"""Operator 3: byte-level BPE by backtracking.

encode_decode(docs) encodes whole texts and decodes the ids again. Method: an Aho-Corasick automaton over all tokens
lists the matches in a piece; from the left, the longest match at each place is tried, then its shorter prefixes, and
kept only where the pair with the token before it is compatible, meaning that byte-pair merging of the two tokens'
bytes would leave exactly these two. A place from which nothing fits is marked, and the encoder steps back. Every place
is left at most once, so the time is linear, also for pieces of megabytes; the result is that of the merges in order.
Decoding copies the tokens' bytes from one table by offset and length.

Null texts count as empty (no ids); an empty table gives an empty table. Ids pass through as they are: nulls and repeated rows stay rows of their own.
Extra columns of the input are ignored. No shuffle; the vocabulary is read from its file in each worker.
"""

from __future__ import annotations

import hashlib
import json

import ahocorasick
import numpy as np
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import PieceCache, map_columns, numbered, per_worker, tokenizer_path, type_of

#: Fixed value: the published splitting pattern of byte-level BPE.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
NEVER = 1 << 60


def byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in byte-level vocabulary files: printable Latin-1 bytes are themselves, the
    others follow in order from U+0100."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(0x100 + k): b for k, b in enumerate(rest)}


class BacktrackingBpe:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = byte_letters()
        vocab = spec["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        n = max([*vocab.values(), *self.special.values()]) + 1
        self.bytes: list[bytes] = [b""] * n
        for text, i in vocab.items():
            self.bytes[i] = bytes(letters[c] for c in text)
        for text, i in self.special.items():
            self.bytes[i] = text.encode()
        pairs = (m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"])
        self.born, self.parts, self.rank = [-1] * n, [None] * n, {}
        for r, (a, b) in enumerate(pairs):
            a, b, made = vocab[a], vocab[b], vocab[a + b]
            self.rank[a, b] = r
            self.born[made], self.parts[made] = r, (a, b)
        self.pairs = PieceCache(lambda ab: self.stays(*ab), 200_000)
        whole = [self.bytes[i] and i not in self.special.values() for i in range(n)]
        for i in sorted((i for i in range(n) if self.parts[i]), key=self.born.__getitem__):
            a, b = self.parts[i]
            whole[i] = whole[a] and whole[b] and self.stays(a, b, self.born[i])
        ids = {self.bytes[i]: i for i in range(n) if whole[i]}
        self.shorter = [next((ids[x] for k in range(len(b) - 1, 0, -1) if (x := b[:k]) in ids), -1) for b in self.bytes]
        self.automaton = ahocorasick.Automaton()
        for b, i in ids.items():
            self.automaton.add_word(b.decode("latin-1"), (i, len(b)))
        self.automaton.make_automaton()
        self.blob = np.frombuffer(b"".join(self.bytes), np.uint8)
        self.length = np.array([len(b) for b in self.bytes], np.int64)
        self.offset = np.concatenate([[0], np.cumsum(self.length)[:-1]])
        self.split = regex.compile(PIECES).findall
        self.cache = PieceCache(lambda piece: np.array(self.encode_piece(piece.encode()), "<u4").tobytes(), 150_000)
        self.at_special = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")").split if self.special else lambda text: [text]

    def stays(self, left: int, right: int, until: int = NEVER) -> bool:
        """Whether merging the bytes of both tokens keeps the border between them, up to merge number until.
        Goes back in time from the finished tokens: the pieces that touch the border live from their own merge to
        that of the token they became part of; a listed pair of pieces that live at its merge's turn breaks the
        border. Of equal merges the left one comes first."""
        left_end = right_end = until
        while True:
            r = self.rank.get((left, right))
            if r is not None and r < left_end and (r <= right_end if right_end != until else r < until):
                return False
            if self.born[left] > self.born[right]:
                left_end, left = self.born[left], self.parts[left][1]
            elif self.parts[right]:
                right_end, right = self.born[right], self.parts[right][0]
            else:
                return True

    def encode_piece(self, piece: bytes) -> list[int]:
        n = len(piece)
        longest = [-1] * n
        for end, (i, size) in self.automaton.iter(piece.decode("latin-1")):
            if longest[end + 1 - size] < 0 or size > self.length[longest[end + 1 - size]]:
                longest[end + 1 - size] = i
        if n and longest[0] >= 0 and self.length[longest[0]] == n:
            return [longest[0]]
        open_, out, at, token = bytearray(b"\1") * (n + 1), [], 0, longest[0] if n else -1
        size_of, pairs = self.bytes, self.pairs
        while at < n:
            while token >= 0:
                end = at + len(size_of[token])
                if open_[end] and (not out or pairs[out[-1], token]):
                    out.append(token)
                    at = end
                    token = longest[at] if at < n else -1
                    break
                token = self.shorter[token]
            else:
                open_[at] = 0
                token = out.pop()
                at -= len(size_of[token])
                token = self.shorter[token]
        return out

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        piece = self.cache.__getitem__
        return b"".join(np.uint32(self.special[part]).astype("<u4").tobytes() if part in self.special else b"".join(map(piece, self.split(part))) for part in self.at_special(text))

    def decode(self, ids: np.ndarray) -> bytes:
        size = self.length[ids]
        start = np.cumsum(size) - size
        return self.blob[np.repeat(self.offset[ids] - start, size) + np.arange(int(size.sum()))].tobytes()


def _encoder(path: str) -> BacktrackingBpe:
    return per_worker(("bpe", path), lambda: BacktrackingBpe(path))


def encode_decode(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: the id column, n_tokens, ids (binary, little-endian unsigned 32-bit), decoded (string). What isn't
    UTF-8 decodes to U+FFFD, as in the library; texts from Spark always decode to themselves."""
    path = path or tokenizer_path("byte_bpe_50k.json")

    def make():
        bpe = _encoder(path)

        def step(ids, texts):
            coded = [bpe.encode(t) if t else b"" for t in texts.to_pylist()]
            return ids, [len(x) // 4 for x in coded], coded, [bpe.decode(np.frombuffer(x, "<u4")).decode("utf-8", "replace") for x in coded]

        return step

    return map_columns(docs, [id_col, text_col], make, [(id_col, type_of(docs, id_col)), ("n_tokens", "long"), ("ids", "binary"), ("decoded", "string")])


def encode_digest(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """encode_decode with digests in place of ids and text, made in the same tasks."""
    out = numbered(encode_decode(docs, path, id_col, text_col))
    return out.select("c0", "c1", F.sha2("c2", 256), F.sha2("c3", 256)).toDF(id_col, "n_tokens", "ids_sha256", "decoded_sha256")
