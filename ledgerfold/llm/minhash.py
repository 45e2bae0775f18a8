"""Operator 2: near-duplicates by bottom-k sketches.

near_duplicates(docs) links texts whose sets of word shingles have a Jaccard similarity of `threshold` or more, and
gives each document the smallest id it can reach. One hash function orders all shingles; a set's sketch is its `SKETCH`
smallest values. Its keys are the rarest of them: of two sketches that must have `need` values in common, each keeps all
but its need - 1 most frequent ones, so the rarest common value is a key of both. Values that no other sketch has take
their places first, so a text that only shares common phrases with others has no keys at all.

1. Equal sets become one class, represented by its smallest id.
2. Inverted lists: classes by key. The smallest class of a list is compared with all others (a star, linear in the
   list). Sizes, then an estimate from the union of the two sketches, sift the pairs; full sets decide.
3. Links make components. Only where a list still has several of them can a link be missing. In short lists all pairs
   across components are candidates.
4. In longer lists (a common line, a large group of copies) exact bounds say which classes can still have a partner.
   Shingles that no other component has (`own`) are in no intersection with one, so a class of n shingles has no partner
   there if n - own < threshold * n, and else only such of at most (1 + threshold) / threshold * (n - own) - n shingles. The
   class with the least share of own shingles in a list's largest component is compared with all that can have a partner
   and are in other components: of a group of copies this is one with few changes, which links most that any other would.
   What is then still apart is compared by ranges of sizes, where own shingles and those shared with the list's smallest
   class, counted in blocks, leave few pairs of a group of copies: changes in other places fall into other blocks.

What chance may lose, for a pair right at the threshold: the sketches have SLACK (more than six standard deviations) less
in common than the sets (2e-8 at 0.8, 8e-9 at 0.85), which is what keys and estimate ask for. Nothing else is left out,
whatever the sizes of lists. Pairs that no bound excludes still grow with the square of a group whose members are at the
threshold's edge and share their changes with others. Equal sets are known by a 128-bit digest of their 63-bit shingle
hashes, which is not confirmed word by word: two different shingles of one hash would be needed.

Words are runs of non-white-space with A-Z in lower case; a text of fewer words than a shingle is one shingle, one
without words is empty and linked with nothing. Rows are judged by their text: repeated rows are copies of each other,
rows of one id and different texts are linked by their texts. Ids are whole numbers; rows of null ids (or such that are
no whole numbers) take no part: component null, kept. Empty tables give empty tables. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import filtered, map_batches, numbered, picked, place, restored, type_of, whole_number, written
from .components import components
from .hashing import lower_ascii, run_hashes, word_hashes

SHINGLE, THRESHOLD = 5, 0.8
SKETCH, SHORT, SLACK = 64, 64, 0.3
#: Sizes are compared in ranges of this ratio.
STEP = 1.02
#: Blocks that the shingles of a list's smallest class are dealt to, by hash; those shared with it are counted by block.
BLOCKS = 32


def shingle_hashes(text: str | None, size: int) -> np.ndarray:
    """Sorted distinct 63-bit hashes of a text's shingles."""
    words = word_hashes(lower_ascii(text)) if text else np.zeros(0, np.uint64)
    return np.unique(run_hashes(words, min(size, len(words))) >> np.uint64(1)) if len(words) else words


def shingle_set(text: str | None, size: int) -> set:
    words = text.encode().lower().split() if text else []
    return set(zip(*(words[k:] for k in range(size)))) if len(words) >= size else {tuple(words)} if words else set()


def texts_of(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id and text."""
    return picked(docs, id=id_col, text=text_col).select(whole_number("id").alias("id"), F.col("text").cast("string").alias("text"))


def digest(text):
    return F.md5(F.coalesce(text, F.lit("")).cast("binary"))


def sketches(texts: DataFrame, size: int) -> DataFrame:
    """id, digest (of the text), n (distinct shingles), same (a 128-bit digest of the set, null if empty), sketch."""

    def make():
        def step(ids, digests, texts):
            sets = [shingle_hashes(t, size) for t in texts.to_pylist()]
            same = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
            return ids, digests, [len(s) for s in sets], same, [s[:SKETCH].astype(np.int64) for s in sets]

        return step

    rows = texts.select("id", digest(F.col("text")).alias("digest"), "text")
    fields = [("id", pa.int64()), ("digest", pa.string()), ("n", pa.int64()), ("same", pa.binary()), ("sketch", pa.list_(pa.int64()))]
    return map_batches(rows, ["id", "digest", "text"], make, "id long, digest string, n long, same binary, sketch array<long>", fields)


def rare_keys(sets: DataFrame, threshold: float) -> DataFrame:
    """key, id and n: of each class's sketch values that other classes have too, all but the need - 1 most frequent ones,
    where alike() asks for need common values at least."""
    values = sets.select(F.explode("sketch").alias("key"), "id", "n")
    often = values.groupBy("key").agg(F.count("*").alias("often")).where(F.col("often") > 1)
    # sketches of up to SKETCH shingles are whole sets
    need = F.ceil(F.least(threshold * F.col("n"), F.lit((threshold - SLACK) * SKETCH)) - 1e-6).cast("int")
    shared = values.join(often, "key").groupBy("id", "n").agg(F.sort_array(F.collect_list(F.struct("often", "key"))).alias("shared"))
    rare = shared.withColumn("size", F.size("shared") - need + 1).where(F.col("size") > 0)
    return rare.select(F.explode(F.slice("shared", F.lit(1), F.col("size"))["key"]).alias("key"), "id", "n")


def alike(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """Of pairs (a, b) those that the sketches don't rule out: the share of common values among the smallest of both."""
    pairs = written(pairs, "asked")
    sets = filtered(sets.select("id", "sketch"), ends_of(pairs))
    two = pairs.join(sets.select(F.col("id").alias("a"), F.col("sketch").alias("sa")), "a").join(sets.select(F.col("id").alias("b"), F.col("sketch").alias("sb")), "b")
    two = two.withColumn("low", F.slice(F.array_sort(F.array_union("sa", "sb")), 1, SKETCH))
    return two.where(F.size(F.array_intersect(F.array_intersect("sa", "sb"), "low")) >= (threshold - SLACK) * F.size("low")).select("a", "b").distinct()


def overlaps(pairs: DataFrame, texts: DataFrame, size: int) -> DataFrame:
    """a, b and shared (the number of shingles in both full sets), n1, n2 (their sizes) of pairs (a, b). texts: id, text."""
    two = pairs.join(texts.select(F.col("id").alias("a"), F.col("text").alias("ta")), "a").join(texts.select(F.col("id").alias("b"), F.col("text").alias("tb")), "b")

    def make():
        last: list = [None, None]

        def step(a, b, ta, tb):
            shared, sizes = [], ([], [])
            for p, q in zip(ta.to_pylist(), tb.to_pylist(), strict=True):
                if last[0] != p:
                    last[:] = [p, shingle_set(p, size)]
                other = shingle_set(q, size)
                shared.append(len(last[1] & other))
                sizes[0].append(len(last[1]))
                sizes[1].append(len(other))
            return a, b, shared, *sizes

        return step

    return map_batches(two, ["a", "b", "ta", "tb"], make, "a long, b long, shared long, n1 long, n2 long", [(x, pa.int64()) for x in ("a", "b", "shared", "n1", "n2")])


def confirmed(pairs: DataFrame, texts: DataFrame, size: int, threshold: float) -> DataFrame:
    """Of pairs (a, b) those whose full shingle sets reach the threshold."""
    both = overlaps(pairs, texts, size)
    return both.where((F.col("shared") > 0) & (100 * F.col("shared") >= round(100 * threshold) * (F.col("n1") + F.col("n2") - F.col("shared")))).select("a", "b").distinct()


def fitting(n: str, m: str, threshold: float):
    """Sizes that allow the threshold."""
    return F.least(n, m) * 100 >= F.greatest(n, m) * round(100 * threshold)


def ends_of(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).distinct()


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: the id column, n_shingles, component_id and kept (whether the id is the smallest of its component)."""
    found = judged(docs, shingle, threshold, id_col, text_col)
    kind = type_of(docs, id_col)
    if kind.typeName() not in ("byte", "short", "integer", "long"):
        kind = "long"
    return found.select(F.col("id").cast(kind).alias(id_col), F.col("n").alias("n_shingles"), F.col("component").cast(kind).alias("component_id"), "kept")


def judged(docs: DataFrame, shingle: int, threshold: float, id_col: str, text_col: str) -> DataFrame:
    """Per row: id, digest, n, same, component, kept."""
    texts = texts_of(docs, id_col, text_col)
    rows = written(sketches(texts, shingle), "sketches")
    known = rows.where(F.col("id").isNotNull() & (F.col("n") > 0))
    sets = written(known.groupBy("same").agg(F.min("id").alias("id"), F.first("n").alias("n"), F.first("sketch").alias("sketch")), "sets")

    keys = rare_keys(sets, threshold)
    lists = keys.groupBy("key").agg(F.count("*").alias("size"), F.min("id").alias("first"), F.min_by("n", "id").alias("first_n")).where(F.col("size") >= 2)
    members = written(keys.join(lists, "key"), "lists")
    stars = members.where((F.col("id") != F.col("first")) & fitting("n", "first_n", threshold)).select(F.col("first").alias("a"), F.col("id").alias("b")).distinct()
    stars = written(alike(stars, sets, threshold), "stars")

    common = written(members.where(F.col("size") > SHORT).select("id").distinct(), "common")

    firsts = members.where(F.col("size") > SHORT).select(F.col("first").alias("id"))
    chosen = written(filtered(texts, ends_of(stars).unionByName(common).unionByName(firsts).distinct()), "texts")
    links = written(confirmed(stars, chosen, shingle, threshold), "confirmed")
    found = written(components(links), "components")

    def settle(pairs: DataFrame) -> bool:
        """Adds the links among pairs; whether there were any pairs."""
        nonlocal links, found
        pairs = written(alike(pairs, sets, threshold), "pairs")
        if pairs.isEmpty():
            return False
        links = written(links.unionByName(confirmed(pairs, filtered(texts, ends_of(pairs)), shingle, threshold)), "confirmed")
        found = written(components(links), "components")
        return True

    cells = written(long_cells(members, chosen, found, shingle, threshold), "bounds")
    short = across(labelled(members.where(F.col("size") <= SHORT).select("key", "id", "n"), found), threshold)
    if settle(short.unionByName(middles(labelled(cells, found), threshold)).distinct()):
        settle(apart(labelled(cells, found), threshold))

    out = rows.join(sets.select("same", F.col("id").alias("class")), "same", "left").join(found.withColumnRenamed("node", "class"), "class", "left")
    component = F.when(F.col("id").isNotNull(), F.coalesce("component", "class", "id"))
    return out.select("id", "digest", "n", "same", component.alias("component"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))


def deduplicated(docs: DataFrame, shingle: int = SHINGLE, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without those that near_duplicates does not keep. Of rows with the same id and shingles one stays; rows
    without an id and texts without words stay as they are. Other columns stay as they are, whatever their names."""
    found = judged(docs, shingle, threshold, id_col, text_col)
    kept = found.where("kept and id is not null").select(F.col("id").alias("own"), "digest", "same").distinct()
    own, text = whole_number(f"c{place(docs, id_col)}"), F.col(f"c{place(docs, text_col)}").cast("string")
    rows = numbered(docs).withColumns({"own": own, "digest": digest(text)})
    left = rows.where("own is not null").join(kept, ["own", "digest"])
    left = left.where("same is not null").dropDuplicates(["own", "same"]).unionByName(left.where("same is null"))
    return restored(left, docs).union(restored(rows.where("own is null"), docs))


def labelled(rows: DataFrame, found: DataFrame) -> DataFrame:
    """rows with c, the component of their id."""
    return rows.join(found.select(F.col("node").alias("id"), F.col("component").alias("c")), "id", "left").withColumn("c", F.coalesce("c", "id"))


def parted(rows: DataFrame, cell: str) -> DataFrame:
    """rows of cells that hold several components, with main, the largest one."""
    counts = rows.groupBy(cell, "c").agg(F.count("*").alias("k"))
    main = counts.groupBy(cell).agg(F.max_by("c", F.struct("k", "c")).alias("main"), F.count("*").alias("parts")).where(F.col("parts") > 1).select(cell, "main")
    return rows.join(main, cell)


def ordered(x: str, y: str) -> list:
    return [F.least(x, y).alias("a"), F.greatest(x, y).alias("b")]


def across(rows: DataFrame, threshold: float) -> DataFrame:
    """Pairs of a short list's members outside its largest component with all members of other components."""
    rows = parted(rows, "key")
    left = rows.where(F.col("c") != F.col("main")).select("key", F.col("id").alias("id1"), F.col("n").alias("n1"), F.col("c").alias("c1"))
    pairs = left.join(rows, "key").where((F.col("c1") != F.col("c")) & fitting("n", "n1", threshold))
    return pairs.select(*ordered("id", "id1")).distinct()


def long_cells(members: DataFrame, texts: DataFrame, found: DataFrame, shingle: int, threshold: float) -> DataFrame:
    """Of long lists that hold several components, for classes that can have a partner: p (the list's smallest class), id, n,
    own (shingles that no other component has), most (the size a partner can have), alone (own ones that p hasn't) and
    with_p (those shared with p, by block): |x ^ y| >= alone x + alone y + the sum of |with_p x - with_p y|."""
    cells = members.where(F.col("size") > SHORT).select(F.col("first").alias("p"), "id", "n").distinct()
    cells = labelled(cells, found)
    several = cells.groupBy("p").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo <> hi").select("p")
    cells = written(cells.join(several, "p"), "cells")

    def make():
        def step(ids, bodies):
            hashes = [shingle_hashes(t, shingle) for t in bodies.to_pylist()]
            return np.repeat(ids.to_numpy(), [len(h) for h in hashes]), np.concatenate(hashes).astype(np.int64)

        return step

    bodies = texts.join(cells.select("id").distinct(), "id")
    held = written(map_batches(bodies, ["id", "text"], make, "id long, h long", [("id", pa.int64()), ("h", pa.int64())]), "held")
    only = labelled(held, found).groupBy("h").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo = hi").select("h")
    # an id with several texts stands for several classes: nothing is known to be its own
    kind = F.xxhash64("text")
    one = bodies.groupBy("id").agg(F.min(kind).alias("lo"), F.max(kind).alias("hi")).where("lo = hi").select("id")
    own = held.distinct().join(only, "h").groupBy("id").agg(F.collect_list("h").alias("own")).join(one, "id")
    firsts = texts.join(several.select(F.col("p").alias("id")), "id").groupBy(F.col("id").alias("p")).agg(F.min("text").alias("tp"))
    single = bodies.groupBy("id").agg(F.when(F.min(kind) == F.max(kind), F.min("text")).alias("text"))
    both = cells.join(own, "id", "left").join(single, "id").join(firsts, "p")

    def make_bounds():
        last: list = [None, None]

        def step(ps, ids, owns, firsts, texts):
            shared, alone, size = [], [], []
            for o, tp, t in zip(owns, firsts.to_pylist(), texts.to_pylist(), strict=True):
                if last[0] != tp:
                    last[:] = [tp, shingle_hashes(tp, shingle).astype(np.int64)]
                both = np.intersect1d(last[1], shingle_hashes(t, shingle).astype(np.int64), assume_unique=True)
                shared.append(None if t is None else np.bincount(both % BLOCKS, minlength=BLOCKS))
                mine = np.array(o.as_py() or [], np.int64)
                size.append(len(mine))
                alone.append(len(mine) - len(np.intersect1d(last[1], mine, assume_unique=True)))
            return ps, ids, shared, alone, size

        return step

    fields = [(n, pa.list_(pa.int64()) if n == "with_p" else pa.int64()) for n in ("p", "id", "with_p", "alone", "own")]
    bounds = map_batches(both, ["p", "id", "own", "tp", "text"], make_bounds, "p long, id long, with_p array<long>, alone long, own long", fields)
    rows = cells.drop("c").join(bounds, ["p", "id"])
    most = F.floor((1 + threshold) / threshold * (F.col("n") - F.col("own")) - F.col("n") + 1e-6)
    return rows.withColumn("most", most).where(F.col("n") - F.col("own") >= threshold * F.col("n") - 1e-6)


def middles(cells: DataFrame, threshold: float) -> DataFrame:
    """Pairs of the class with the least share of own shingles in a cell's largest component and all classes outside."""
    rows = parted(cells, "p")
    middle = rows.where(F.col("c") == F.col("main")).groupBy("p").agg(F.min_by(F.struct(F.col("id").alias("id1"), F.col("n").alias("n1")), F.struct(F.col("own") / F.col("n"), "id")).alias("m")).select("p", "m.*")
    pairs = rows.where(F.col("c") != F.col("main")).join(middle, "p").where(fitting("n", "n1", threshold))
    return pairs.select(*ordered("id", "id1")).distinct()


def apart(cells: DataFrame, threshold: float) -> DataFrame:
    """Pairs of a cell's classes outside its largest component with all classes of other components that both sizes and
    own shingles allow, met by ranges of sizes."""
    rows = parted(cells, "p")
    size = lambda c: F.floor(F.log(c.cast("double")) / float(np.log(STEP)))
    low, high = F.ceil(threshold * F.col("n") - 1e-6), F.least(F.col("most"), F.floor(F.col("n") / threshold + 1e-6))
    left = rows.where((F.col("c") != F.col("main")) & (low <= high)).withColumn("range", F.explode(F.sequence(size(low), size(high))))
    left = left.select("p", "range", *(F.col(x).alias(f"{x}1") for x in ("id", "n", "c", "most", "alone", "with_p")))
    shared = sum((F.abs(F.col("with_p")[k] - F.col("with_p1")[k]) for k in range(1, BLOCKS)), F.abs(F.col("with_p")[0] - F.col("with_p1")[0]))
    differ = F.col("alone") + F.col("alone1") + F.coalesce(shared, F.lit(0))
    close = differ <= (1 - threshold) / (1 + threshold) * (F.col("n") + F.col("n1")) + 1e-6
    pairs = left.join(rows.withColumn("range", size(F.col("n"))), ["p", "range"]).where((F.col("c1") != F.col("c")) & (F.col("n") <= F.col("most1")) & (F.col("n1") <= F.col("most")) & close & fitting("n", "n1", threshold))
    return pairs.select(*ordered("id", "id1")).distinct()


#: DuckDB SQL for shingles of three words and a threshold of 85 percent.
ORACLE = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), []) AS w
  FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i : i + 2], ' ') AS shingle
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 1, 2))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared
  FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY 1, 2),
e AS (
  SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * shared >= 85 * (x.n + y.n - shared)),
two AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r AS (SELECT doc_id AS id, doc_id AS root FROM d UNION SELECT two.b, r.root FROM r JOIN two ON two.a = r.id)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, min(r.root) AS component_id, d.doc_id = min(r.root) AS kept
FROM d LEFT JOIN n USING (doc_id) JOIN r ON r.id = d.doc_id GROUP BY d.doc_id, n.n
"""
