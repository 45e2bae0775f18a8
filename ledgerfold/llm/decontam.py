"""Operator 7: benchmark decontamination by Wu-Manber multi-pattern search over words.

contaminated(docs, benchmark) finds every occurrence of every benchmark window in whole document texts. Text is
lower-cased in A-Z only; words are runs of characters other than ASCII non-alphanumerics. A window is `window`
consecutive words of an item; an item of fewer words, but not none, is one window of its own length. For each window
length there is one Wu-Manber search: the block of two words at the window's end looks up how far to move on (most
blocks are in no pattern, so the search leaps nearly a window); a block that ends some pattern leads to a bucket, which
the block at the window's start narrows, and the patterns left there are compared word by word.

Null or empty texts have no words and no hits. An item of null id marks words as hit but has no id to list; repeated
items and ids count once. Null document ids and repeated rows stay rows of their own. An empty benchmark hits nothing.
Extra columns of either table are ignored. Documents are not shuffled. The benchmark travels to the workers in blocks
of at most `block_bytes` of text: one for any usual benchmark, else one pass for each, written to the shared folder in
between, so neither the driver nor a worker holds more than a block.
"""

from __future__ import annotations

import uuid

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import latest, map_batches, numbered, picked, place, written

WINDOW, BLOCK_BYTES = 10, 2 << 20
#: Bytes of UTF-8: A-Z to a-z, digits, a-z and all of 0x80 and up as they are, the rest to spaces.
WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    return text.encode().translate(WORD_BYTES).split() if text else []


class WuManber:
    """Search for word tuples of one length."""

    def __init__(self, patterns: dict[tuple[bytes, ...], list[int]], size: int):
        self.size, self.block = size, min(2, size)
        self.far, self.shift, self.buckets = size - self.block + 1, {}, {}
        for pattern, items in patterns.items():
            for end in range(self.block, size + 1):
                block = pattern[end - self.block : end]
                self.shift[block] = min(self.shift.get(block, self.far), size - end)
            ends, starts = pattern[size - self.block :], pattern[: self.block]
            self.buckets.setdefault(ends, {}).setdefault(starts, []).append((list(pattern), items))

    def find(self, words: list[bytes]):
        """(start, items) of each occurrence, from the left."""
        size, far, shift = self.size, self.far, self.shift.get
        end, n = size, len(words)
        if self.block == 1:
            for k, word in enumerate(words):
                for _, items in self.buckets.get((word,), {}).get((word,), ()):
                    yield k, items
            return
        while end <= n:
            block = (words[end - 2], words[end - 1])
            step = shift(block, far)
            if step:
                end += step
                continue
            start = end - size
            for pattern, items in self.buckets[block].get((words[start], words[start + 1]), ()):
                if words[start:end] == pattern:
                    yield start, items
            end += 1


class Searcher:
    def __init__(self, items: list[tuple[str | None, str | None]], window: int):
        by_size: dict[int, dict] = {}
        self.ids = [i for i, _ in items]
        for k, (_, text) in enumerate(items):
            words = words_of(text)
            size = min(window, len(words))
            for start in range(len(words) - size + 1 if size else 0):
                found = by_size.setdefault(size, {}).setdefault(tuple(words[start : start + size]), [])
                if found[-1:] != [k]:
                    found.append(k)
        self.searches = [WuManber(p, size) for size, p in sorted(by_size.items())]

    def search(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Hit spans [start, end), merged, and the ids of the items found."""
        spans, items = [], set()
        for s in self.searches:
            for start, found in s.find(words):
                spans.append((start, start + s.size))
                items.update(found)
        return merged(spans), {self.ids[k] for k in items} - {None}


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([start, end])
    return [tuple(x) for x in out]


RESULTS = ("n_words", "n_hit", "spans", "items", "contaminated")


def contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", keep: tuple[str, ...] = (), block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Per document row: the id column, the columns of keep (but for those named like a result), n_words, n_hit (words
    within occurrences), spans (array of [start, end) in words, not overlapping), items (ids found as strings, sorted as
    strings) and contaminated (n_hit > 0)."""
    passed = [id_col, *(c for c in keep if c != id_col and c not in RESULTS)]
    found = searched(docs, benchmark, [place(docs, c) for c in passed], window, text_col, item_col, item_text_col, block_bytes)
    return found.select(*(f"c{k}" for k in range(len(passed))), *RESULTS).toDF(*passed, *RESULTS)


def decontaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """docs, all columns, without the documents that hold a benchmark window."""
    found = searched(docs, benchmark, list(range(len(docs.columns))), window, text_col, item_col, item_text_col, block_bytes)
    return found.where("not contaminated").select(*(f"c{k}" for k in range(len(docs.columns)))).toDF(*docs.columns)


def searched(docs: DataFrame, benchmark: DataFrame, passed: list[int], window: int, text_col: str, item_col: str, item_text_col: str, block_bytes: int) -> DataFrame:
    """The columns that stand at the places passed, as c0, c1, ..., and RESULTS."""
    spark = docs.sparkSession
    bench = picked(benchmark, i=item_col, t=item_text_col).select(F.col("i").cast("string"), F.col("t").cast("string")).where(F.length("t") > 0)
    total = bench.agg(F.sum(F.octet_length("t")).alias("n")).first()["n"] or 0
    blocks = max(1, -(-total // block_bytes))
    # names of our own, so that no column of the documents can clash
    rows = numbered(docs)
    state = rows.select(*(F.col(f"c{k}").alias(f"c{n}") for n, k in enumerate(passed)), F.col(f"c{place(docs, text_col)}").cast("string").alias("body"), F.expr("cast(array() as array<struct<start: int, end: int>>)").alias("spans"), F.expr("cast(array() as array<string>)").alias("items"))
    names = [f"c{k}" for k in range(len(passed))]
    schema = ", ".join([*(f"{n} {state.schema[n].dataType.simpleString()}" for n in names), "body string, spans array<struct<start: int, end: int>>, items array<string>, n_words long"])
    pair = pa.struct([("start", pa.int32()), ("end", pa.int32())])
    fields = [*((n, to_arrow_type(state.schema[n].dataType)) for n in names), ("body", pa.string()), ("spans", pa.list_(pair)), ("items", pa.list_(pa.string())), ("n_words", pa.int64())]
    for block in range(blocks):
        part = bench if blocks == 1 else bench.where(F.pmod(F.xxhash64("i", "t"), F.lit(blocks)) == block)
        shared = spark.sparkContext.broadcast([(r["i"], r["t"]) for r in part.toLocalIterator()])

        def make(shared=shared, token=uuid.uuid4().hex):
            searcher = latest("searcher", token, lambda: Searcher(shared.value, window))

            def step(*columns):
                *passing, texts, spans, items = columns
                sizes, hits, found_items = [], [], []
                for text, before, known in zip(texts.to_pylist(), spans.to_pylist(), items.to_pylist(), strict=True):
                    words = words_of(text)
                    found, new = searcher.search(words)
                    sizes.append(len(words))
                    hits.append([{"start": a, "end": b} for a, b in merged(found + [(x["start"], x["end"]) for x in before])])
                    found_items.append(sorted({*known, *new}))
                return *passing, texts, hits, found_items, sizes

            return step

        state = map_batches(state, [*names, "body", "spans", "items"], make, schema, fields)
        if block + 1 < blocks:
            state = written(state, "decontam")
    hit = F.expr("aggregate(spans, 0L, (n, s) -> n + s.end - s.start)")
    return state.withColumn("n_hit", hit).withColumn("contaminated", F.col("n_hit") > 0).select(*names, *RESULTS)


def digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    return found.select(id_col, "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "items").cast("binary"), 256).alias("items_sha256"), "contaminated")


ORACLE = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id,
         coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+'), []) AS w
  FROM documents),
b AS (
  SELECT cast(item_id AS VARCHAR) AS item,
         regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+') AS w
  FROM benchmark),
p AS (
  SELECT DISTINCT item, least(10, len(w)) AS m, array_to_string(w[i : i + least(10, len(w)) - 1], ' ') AS win
  FROM (SELECT item, w, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)),
dw AS (
  SELECT rid, i, m, array_to_string(w[i : i + m - 1], ' ') AS win
  FROM (SELECT rid, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM d, (SELECT DISTINCT m FROM p) WHERE len(w) >= m)),
o AS (SELECT rid, i, m, item FROM dw JOIN p USING (m, win)),
h AS (SELECT rid, count(DISTINCT pos) AS n_hit FROM (SELECT rid, unnest(range(i, i + m)) AS pos FROM o) GROUP BY rid),
t AS (SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT rid, item FROM o) GROUP BY rid)
SELECT doc_id, cast(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (rid) LEFT JOIN t USING (rid)
"""
