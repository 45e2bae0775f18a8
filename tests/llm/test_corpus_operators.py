"""Operators over the whole corpus: 1, 2, 6, and the pipeline."""

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from ledgerfold.llm import hashing, minhash, repair, substring
from ledgerfold.llm.common import tokenizer_path
from ledgerfold.llm.components import components

from .corpus import empty_documents, odd_documents, word, words

# --- components ---


def test_components(spark):
    rng = random.Random(0)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(k, k + 1) for k in range(400, 460)] + [(500, k) for k in range(501, 540)] + [(5, 5)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    linked = {x for a, b in links if a != b for x in (a, b)}
    assert got == {x: find(x) for x in linked}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


# --- 2 ---


def slow_components(docs, size, percent):
    sets = {i: minhash.shingle_set(t, size) for i, t in docs}
    label = {i: i for i in sets}

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            common = len(sets[a] & sets[b])
            if common and 100 * common >= percent * (len(sets[a]) + len(sets[b]) - common):
                x, y = find(a), find(b)
                label[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}, {i: len(s) for i, s in sets.items()}


def near_corpus(seed, copies):
    """A common line, a large group of copies with few to many changes, small groups, exact copies, short texts."""
    rng = random.Random(seed)
    line, base = " ".join(words(rng, 9)), words(rng, 120)
    docs = []
    for _ in range(copies):
        w = list(base)
        for _ in range(rng.randint(0, 9)):
            w[rng.randrange(len(w))] = word(rng)
        docs.append(" ".join(w))
    for _ in range(60):
        docs.append("\n".join([line, " ".join(words(rng, rng.randint(0, 80)))]))
    for _ in range(15):
        w = words(rng, rng.randint(3, 60))
        docs += [" ".join(w), " ".join(w).upper(), " ".join([*w[:-1], word(rng)])]
    docs += ["", "a", "a", "a b", "A  b", line, line]
    rng.shuffle(docs)
    return list(enumerate(docs))


@pytest.mark.parametrize(("size", "threshold", "short", "seed", "copies"), [(3, 0.85, 64, 1, 110), (3, 0.85, 8, 1, 110), (5, 0.8, 64, 1, 110), (5, 0.8, 8, 2, 110), (3, 0.85, 4, 3, 700)])
def test_near_duplicates_against_brute_force(spark, monkeypatch, size, threshold, short, seed, copies):
    monkeypatch.setattr(minhash, "SHORT", short)  # at 8 the large group is one of long lists
    docs = near_corpus(seed, copies)
    want, sizes = slow_components(docs, size, round(100 * threshold))
    got = minhash.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"), size, threshold).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == want
    assert {r["doc_id"]: r["n_shingles"] for r in got} == sizes
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)


def test_bounds_leave_no_link_out(spark):
    """A group of near copies of many lengths, most of them at the threshold's edge: all links, and few pairs."""
    rng = random.Random(31)
    base, docs = words(rng, 150), []
    for i in range(260):
        w = list(base)
        for _ in range(rng.choice([0, 3, 5, 6, 7, 8])):
            at = rng.randrange(len(w))
            w[at : at + 1] = rng.choice([[word(rng) + "z"], [], [word(rng) + "z", word(rng)]])
        docs.append((i, " ".join(w[: len(w) - rng.choice([0, 0, 0, 12, 20])])))
    want, _ = slow_components(docs, 3, 85)
    got = minhash.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"), 3, 0.85).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == want


def test_texts_that_share_common_phrases_have_no_keys(spark, monkeypatch):
    """150 texts with a common passage of two fifths, far from any threshold, and a pair: only the pair is looked at."""
    rng = random.Random(5)
    passage = words(rng, 60)
    docs = [(i, " ".join([*passage, *(w + "z" for w in words(rng, 90))])) for i in range(150)]
    docs.append((150, docs[0][1] + " more"))
    rows, write = {}, minhash.written

    def counted(df, label):
        out = write(df, label)
        rows[label] = rows.get(label, 0) + out.count()
        return out

    monkeypatch.setattr(minhash, "written", counted)
    got = minhash.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"), 3, 0.85).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == {i: i % 150 for i in range(151)}
    assert rows["held"] < 10 * 150 and rows["lists"] < 10 * 150


def test_near_duplicates_of_odd_rows(spark):
    docs = odd_documents(spark)
    got = minhash.near_duplicates(docs).collect()
    assert len(got) == docs.count()
    assert {(r["component_id"], r["kept"]) for r in got if r["doc_id"] is None} == {(None, True)}
    assert {r["component_id"] for r in got if r["doc_id"] == 7} == {1, 7}
    left = minhash.deduplicated(docs).collect()
    # the repeated row and the copy under another id go; what has no words or no id stays
    assert sorted(str(r["doc_id"]) for r in left) == ["1", "2", "3", "4", "5", "6", "7", "None"]
    assert left[0]["score"] == "extra score"
    texts = spark.createDataFrame([("1", "a b c d e f"), ("x", "a b c d e f"), ("2", "A b c d e f")], "doc_id string, text string")
    assert {(r["doc_id"], r["component_id"]) for r in minhash.near_duplicates(texts).collect()} == {(1, 1), (2, 1), (None, None)}
    assert sorted(r["doc_id"] for r in minhash.deduplicated(texts).collect()) == ["1", "x"]
    assert minhash.near_duplicates(empty_documents(spark)).count() == 0 and minhash.deduplicated(empty_documents(spark)).count() == 0


# --- 1 ---


def test_passages_are_found_and_cut(spark):
    rng = random.Random(2)
    shared, fuzzy = words(rng, 70), words(rng, 90)
    changed = list(fuzzy)
    for k in (20, 45, 70):
        changed[k] = word(rng) + "x"
    del changed[55]
    docs = [(1, words(rng, 30) + shared + words(rng, 25)), (2, words(rng, 50) + ["".join(c.upper() if c.isascii() else c for c in w) for w in shared] + words(rng, 10)), (3, shared[:40] + words(rng, 100)), (4, fuzzy + words(rng, 20)), (5, words(rng, 20) + changed + words(rng, 5)), (6, words(rng, 200)), (7, list(shared))]
    frame = spark.createDataFrame([(i, " ".join(w)) for i, w in docs], "doc_id long, text string")
    got = {(r["doc_id"], r["source_doc_id"]): r for r in substring.repeated_passages(frame).collect()}
    assert set(got) == {(2, 1), (5, 4), (7, 1)}
    assert abs(got[2, 1]["start"] - 50) <= 1 and abs(got[2, 1]["end"] - 120) <= 1 and got[2, 1]["source_start"] - got[2, 1]["start"] == -20
    assert got[5, 4]["end"] - got[5, 4]["start"] >= 85 and got[5, 4]["matched"] >= 83
    cut = {r["doc_id"]: r["text"] for r in substring.without_passages(frame).collect()}
    assert set(cut) == {1, 2, 3, 4, 5, 6}  # 7 has nothing left
    whole = dict(docs)
    assert all(cut[i] == " ".join(whole[i]) for i in (1, 3, 4, 6))
    assert cut[2].split() == whole[2][: got[2, 1]["start"]] + whole[2][got[2, 1]["end"] :]


def test_every_exact_repeat_of_the_least_length(spark):
    rng = random.Random(3)
    pool = [words(rng, rng.randint(50, 80)) for _ in range(6)]
    docs = []
    for i in range(60):
        w = words(rng, rng.randint(10, 120))
        for p in rng.sample(pool, rng.randint(0, 2)):
            at = rng.randrange(len(w))
            w[at:at] = p
        docs.append((i, w))
    first, want = {}, {}
    for i, w in docs:
        for k in range(len(w) - 49):
            key = tuple(w[k : k + 50])
            if first.setdefault(key, i) != i:
                want.setdefault(i, set()).update(range(k, k + 50))
    got = {}
    for r in substring.repeated_passages(spark.createDataFrame([(i, " ".join(w)) for i, w in docs], "doc_id long, text string")).collect():
        got.setdefault(r["doc_id"], set()).update(range(r["start"], r["end"]))
    assert set(got) == set(want) and all(len(want[i] - got[i]) <= 2 for i in want)  # a word that happens to be equal beside it
    assert sum(len(got[i] - want[i]) for i in got) <= 2 * len(got)


def test_repeats_whose_parts_occur_earlier(spark):
    """Earlier documents have parts of a passage, each less than the least length, and hide its first whole occurrence."""
    rng = random.Random(12)
    docs, want = [], {}
    for k in range(8):
        p = words(rng, 60)
        parts = [(p[:35], p[26:]), (p[:49], p[11:]), (p[5:52], p[:4]), (p[:26], p[26:52])][k % 4]
        docs += [(10 * k + i, words(rng, 20) + w + words(rng, 20)) for i, w in enumerate([*parts, p, words(rng, 7) + p])]
        want[10 * k + 3] = (10 * k + 2, set(range(27, 87)))
    frame = spark.createDataFrame([(i, " ".join(w)) for i, w in docs], "doc_id long, text string")
    got = {}
    for r in substring.repeated_passages(frame).collect():
        got.setdefault(r["doc_id"], []).append(r)
    assert set(got) == set(want)
    for i, (source, places) in want.items():
        assert any(r["source_doc_id"] == source and places <= set(range(r["start"], r["end"])) and r["matched"] >= 60 for r in got[i])
    cut = {r["doc_id"]: r["text"].split() for r in substring.without_passages(frame).collect()}
    assert all(len(cut[i]) <= 47 for i in want)


def test_documents_of_a_million_words(spark):
    """A very long document that holds parts of many earlier ones, and is the source of many later ones."""
    rng = random.Random(14)
    vocabulary = [word(rng) + str(k) for k in range(20_000)]
    long = rng.choices(vocabulary, k=1_000_000)
    early = [rng.choices(vocabulary, k=70) for _ in range(150)]
    for k, w in enumerate(early):
        long[5000 * k : 5000 * k + 60] = w[:60]
    late = [rng.choices(vocabulary, k=10) + long[6000 * k + 100 : 6000 * k + 160] for k in range(150)]
    docs = [(k, w) for k, w in enumerate(early)] + [(1000, long)] + [(2000 + k, w) for k, w in enumerate(late)] + [(3000, long[400_000:700_000])]
    frame = spark.createDataFrame([(i, " ".join(w)) for i, w in docs], "doc_id long, text string").repartition(4)
    covered = {}
    for r in substring.repeated_passages(frame).collect():
        covered.setdefault(r["doc_id"], set()).update(range(r["start"], r["end"]))
    assert set(covered) == {1000, 3000, *(2000 + k for k in range(150))}
    assert all(set(range(5000 * k, 5000 * k + 60)) <= covered[1000] for k in range(150)) and len(covered[1000]) < 150 * 64
    assert all(covered[2000 + k] >= set(range(10, 70)) for k in range(150)) and len(covered[3000]) == 300_000


@pytest.mark.parametrize(("size", "changes", "least"), [(60, 1, 0.9), (90, 2, 0.9), (90, 4, 0.8), (150, 6, 0.9)])
def test_share_of_changed_passages_found(spark, size, changes, least):
    """Passages with random words changed, each in two documents; found where most of it is among the passage's words."""
    rng, docs, n = random.Random(size + changes), [], 80
    for k in range(n):
        p = words(rng, size)
        q = list(p)
        for at in rng.sample(range(size), changes):
            q[at] += "x"
        docs += [(k, words(rng, 20) + p + words(rng, 20)), (n + k, words(rng, 30) + q + words(rng, 10))]
    found = {}
    for r in substring.repeated_passages(spark.createDataFrame([(i, " ".join(w)) for i, w in docs], "doc_id long, text string")).collect():
        found.setdefault((r["doc_id"], r["source_doc_id"]), set()).update(range(r["start"], r["end"]))
    assert all(i - n == source for i, source in found)
    assert sum(len(x & set(range(30, 30 + size))) >= 0.8 * size for x in found.values()) >= least * n


def test_many_short_texts_are_hashed_at_once(monkeypatch):
    """Seeds and windows of many texts are those of each text alone, no run or window goes over two texts, and hashes are
    made for many texts in one call."""
    rng = random.Random(11)
    texts = ["", " ", "a", *(" ".join(rng.choice(["the", "A", "bär", f"w{rng.randint(0, 99)}"]) for _ in range(rng.randint(0, 120))) for _ in range(300))]
    raw, calls, hashes = [t.encode() for t in texts], [], substring.run_hashes
    monkeypatch.setattr(substring, "run_hashes", lambda *x: (calls.append(1), hashes(*x))[1])
    alone = [substring.seeds_of(t) for t in texts]
    for t, (h, at) in zip(texts, alone):
        order = substring.mix(hashes(substring.words_of([t.encode()])[0], substring.RUN)).tolist()
        size = min(substring.WINDOW, len(order))
        assert at.tolist() == sorted({p for k in range(len(order) - size + 1) if order for p in range(k, k + size) if order[p] == min(order[k : k + size])})
    shared = [np.unique(h[::2] if k % 3 else h) for k, (h, _) in enumerate(alone)]
    calls.clear()
    parts = list(substring.together(raw))
    assert [k for a, b in parts for k in range(a, b)] == list(range(len(raw)))
    h, size, at = (np.concatenate(x) for x in zip(*(substring.seeds_of_all(raw[a:b]) for a, b in parts)))
    assert [h.tolist(), size.tolist(), at.tolist()] == [np.concatenate([x for x, _ in alone]).tolist(), [len(x) for x, _ in alone], np.concatenate([x for _, x in alone]).tolist()]
    each = [substring.windows_of_all(raw[a:b], shared[a:b], 50) for a, b in parts]
    assert len(calls) <= 4
    h, size, at = (np.concatenate(x) for x in zip(*each))
    alone = [substring.windows_of(t, s, 50) for t, s in zip(texts, shared)]
    assert [h.tolist(), size.tolist(), at.tolist()] == [np.concatenate([x for x, _ in alone]).tolist(), [len(x) for x, _ in alone], np.concatenate([x for _, x in alone]).tolist()]


def test_seed_rows_of_a_batch(spark, monkeypatch):
    """A slice of many short texts asks for hashes once, not once a text."""
    calls, hashes = [], substring.run_hashes
    monkeypatch.setattr(substring, "run_hashes", lambda *x: (calls.append(1), hashes(*x))[1])
    taken = {}
    monkeypatch.setattr(substring, "map_batches", lambda df, columns, make, schema, fields: taken.setdefault("step", make()))
    substring.seed_table(spark.createDataFrame([(1, "a")], "id long, text string"))
    texts = [" ".join(f"w{k}x{j}" for j in range(30)) for k in range(50)]
    h, own, at = taken["step"](pa.array(range(50), pa.int64()), pa.array(texts))
    assert len(calls) == 1
    assert (h.tolist(), own.tolist(), at.tolist()) == tuple(np.concatenate(x).tolist() for x in zip(*((a, np.full(len(a), k), b) for k, (a, b) in enumerate(map(substring.seeds_of, texts)))))


def test_windows_and_their_runs():
    rng = random.Random(13)
    text = " ".join(words(rng, 90))
    every = np.unique(substring.seeds_of(text)[0])
    h, at = substring.windows_of(text, every, 50)
    assert at.tolist() == list(range(41)) and len(set(h.tolist())) == 41
    inner, places = substring.windows_of(" ".join(text.split()[13:80]), every, 50)
    assert inner.tolist() == h[13:31].tolist() and places.tolist() == list(range(18))
    assert len(substring.windows_of(text, every[:0], 50)[0]) == 0
    assert substring.runs_of([(k, 1, 100 + k) for k in range(5)] + [(7, 2, 0), (8, 2, 1), (9, 3, 9)], 10) == [(0, 14, 1, 100), (9, 19, 3, 9)]
    assert substring.runs_of([(k, 1, 0) for k in range(31)], 10) == [(0, 10, 1, 0), (10, 20, 1, 0), (20, 30, 1, 0), (30, 40, 1, 0)]


def test_chain_scores_by_hand():
    matches = [(0, 100), (10, 110), (20, 120), (15, 300), (30, 130), (200, 400), (210, 410)]
    assert substring.chains(matches) == [[(0, 100), (10, 110), (20, 120), (30, 130)], [(200, 400), (210, 410)], [(15, 300)]]
    assert substring.chains([(0, 5), (0, 5), (8, 5)]) == [[(0, 5)], [(8, 5)]]


def test_fenwick_prefix_maxima():
    rng = random.Random(4)
    tree, values = substring.PrefixMaxima(50), [float("-inf")] * 50
    for i in range(300):
        at, v = rng.randrange(50), rng.random()
        tree.put(at, v, i)
        values[at] = max(values[at], v)
        q = rng.randrange(50)
        assert tree.upto(q)[0] == max(values[: q + 1])


def test_passages_of_odd_rows(spark):
    docs = odd_documents(spark)
    assert substring.repeated_passages(docs).count() == 0
    left = substring.without_passages(docs)
    assert left.columns == docs.columns and left.where("text is null").count() == 1
    assert sorted(str(r["doc_id"]) for r in left.collect()) == ["1", "1", "2", "3", "4", "5", "6", "7", "7", "None"]
    assert substring.repeated_passages(empty_documents(spark)).count() == 0 and substring.without_passages(empty_documents(spark)).count() == 0


# --- 6 ---


def test_repair_round_trip():
    rng = np.random.default_rng(5)
    for n in (0, 1, 2, 3, 50, 3000):
        for kind in (2, 5, 60_000):
            ids = np.where(rng.random(n) < 0.1, 1, rng.integers(0, kind, n)).astype(np.uint32)
            for base in (60_000, 70_000):
                symbols, rules = repair.compress(ids, base)
                assert (repair.Grammar(rules, base).expand(symbols) == ids).all()
                assert not (rules == 1).any() and (symbols == 1).sum() == (ids == 1).sum()
    ids = np.tile(np.arange(2, 40, dtype=np.uint32), 200)
    assert len(repair.compress(ids, 60_000)[0]) < len(ids) / 2


def test_shards_with_the_end_id_in_a_text_are_compressed():
    rng = np.random.default_rng(15)
    for base in (49_152, 70_000):
        phrase = rng.integers(2, 40_000, 64)
        docs = [np.concatenate([phrase, rng.integers(0, 40_000, 20), [repair.END_ID], phrase]) for _ in range(60)] + [np.array([], np.int64), np.array([1, 1, 1])]
        counts = np.array([len(x) for x in docs])
        row = repair.pack(0, 0, 0, list(range(len(docs))), np.concatenate(docs).astype(np.uint32), counts, base, repair.END_ID).to_pylist()[0]
        assert len(row["rules"]) and row["n_symbols"] < len(np.concatenate(docs)) / 3
        for k, d in enumerate(docs):
            assert repair.tokens_of(row, k).tolist() == [*d.tolist(), repair.END_ID]


@pytest.mark.parametrize("base", [60_000, 70_000])
def test_no_frequent_pair_is_left(base):
    rng = np.random.default_rng(16)
    phrases = [rng.integers(2, 50_000, int(rng.integers(2, 300))) for _ in range(30)]
    ids = np.concatenate([phrases[i] for i in rng.integers(0, 30, 300)] + [np.full(37, 7), rng.integers(0, 9, 3000)]).astype(np.uint32)
    symbols, rules = repair.compress(ids, base)
    assert (repair.Grammar(rules, base).expand(symbols) == ids).all()
    places = {}
    for k, pair in enumerate(zip(symbols.tolist(), symbols[1:].tolist())):
        if 1 not in pair and (not places.get(pair) or places[pair][-1] < k - 1 or pair[0] != pair[1]):
            places.setdefault(pair, []).append(k)
    assert max(map(len, places.values())) < repair.LEAST


def test_pairs_are_counted_one_by_one():
    """Each of 8,192 equally frequent pairs is found, also those that shared a place of the former table of hashes."""
    phrases = np.arange(2, 2 + 2 * 8192, dtype=np.uint32).reshape(-1, 2)
    ids = np.insert(np.tile(phrases, (6, 1)), 2, 1, axis=1).ravel()
    left, right, places = ids[:-1], ids[1:], np.arange(len(ids) - 1)
    inner = np.flatnonzero((left != 1) & (right != 1))
    for top in (1 << 15, 1 << 30):  # all in one number, and not
        at, urgency, pairs = repair.frequent(left[inner], right[inner], places[inner], 6, top, len(ids), len(ids))
        assert at.tolist() == inner.tolist() and np.array_equal(np.unique(pairs, axis=0), phrases)
        assert np.array_equal(pairs[urgency - 1], np.column_stack([left, right])[inner])
        at, urgency, pairs = repair.frequent(left[inner], right[inner], places[inner], 6, top, len(ids), 10)
        assert len(at) == 60 and len(pairs) == 10 and urgency.max() == 10
    assert set(inner.tolist()) <= set(repair.maybe(ids, 6).tolist())
    symbols, rules = repair.compress(ids, 60_000)
    assert len(rules) == 8192 and (symbols == 1).sum() * 2 == len(symbols)


def test_a_full_pool_forgets_only_what_nothing_names():
    """Before, all pieces but those of the batch were forgotten, and encoded again."""
    rng, coder = random.Random(26), repair.WordIds(tokenizer_path("word_bpe_49k.json"), bits=8)
    pieces, room, compacted = coder.pieces, coder.room, []
    asked = []
    coder.pieces = lambda found: (asked.extend(found), pieces(found))[1]
    coder.room = lambda n, *rest: (compacted.append(coder.used + n > len(coder.pool)), room(n, *rest))[1]
    while not any(compacted):
        texts = [" ".join(words(rng, 30)), " ".join(words(rng, 10))]
        ids, counts = coder.encode(texts)
        for t, own in zip(texts, np.split(ids, np.cumsum(counts)[:-1])):
            assert own.tolist() == coder.library(t)
    assert np.count_nonzero(coder.table[:, 3]) > 150 and coder.used < len(coder.pool) * 3 // 4
    asked.clear()
    texts = [" ".join(words(random.Random(26), 1000))]
    ids, _ = coder.encode(texts)
    assert ids.tolist() == coder.library(texts[0]) and len(asked) < len(set(texts[0].split())) - 60


def test_pieces_have_the_hashes_of_words(monkeypatch):
    rng = random.Random(27)
    texts = ["".join(rng.choice("ab.,!' \né") for _ in range(rng.randint(0, 40))) for _ in range(500)] + ["", " ", "!", "a!", "!a", "a!b!!"]
    for kept in (hashing.KEPT, 5):
        monkeypatch.setattr(hashing, "KEPT", kept)
        for text in texts:
            raw = np.frombuffer(text.encode(), np.uint8)
            for tail in (None, repair.SIGNS):
                for x, y in zip(hashing.words_in(raw, repair.BREAKS, tail), hashing.pieces_in(raw, repair.BREAKS, tail), strict=True):
                    assert x.tolist() == y.tolist(), text


def test_rules_go_on_beyond_16_bits():
    """A shard of the tables with texts that hold the end id: no frequent pair is left, and it comes back whole."""
    import pyarrow.parquet as pq

    texts = pq.read_table("/root/testdata/sf0.01/documents.parquet", columns=["text"])["text"].to_pylist()
    texts += ['print("$x")', 'href="#a">'] * 3
    coder = repair.WordIds(tokenizer_path("word_bpe_49k.json"))
    ids, counts = coder.encode(texts)
    assert (ids == repair.END_ID).any()
    row = repair.pack(0, 0, 0, list(range(len(texts))), ids, counts, coder.size, repair.END_ID).to_pylist()[0]
    assert row["bits"] == 17 and len(row["rule_tokens"]) // 4 + row["base"] > 1 << 16
    grammar, symbols, at, tokens = repair.unpacked(row)
    assert grammar.size[row["base"] :].tolist() == np.frombuffer(row["rule_tokens"], "<u4").tolist()
    assert grammar.expand(symbols).tolist() == np.insert(ids, np.cumsum(counts), repair.END_ID).tolist() and tokens.tolist() == (counts + 1).tolist()
    ends = set((at[1:] - 1).tolist())
    pairs = [(a, b) for k, (a, b) in enumerate(zip(symbols.tolist(), symbols[1:].tolist())) if k not in ends and k + 1 not in ends and a != b]
    found = np.unique(np.array(pairs[:-1]), axis=0, return_counts=True)[1]
    assert found.max() < repair.LEAST


@pytest.mark.parametrize("bits", [16, 17, 23])
def test_numbers_squeezed(bits):
    rng = np.random.default_rng(bits)
    for n in (0, 1, 7, 8, 9, 1000):
        x = rng.integers(0, 1 << bits, n)
        raw = repair.squeezed(x, bits)
        assert repair.unsqueezed(raw, bits, n).tolist() == x.tolist() and len(raw) == 2 * n + (bits - 16) * ((n + 7) // 8)


def test_words_equal_the_library():
    rng, coder = random.Random(6), repair.WordIds(tokenizer_path("word_bpe_49k.json"), bits=5)
    letters = "aaabceht  \n\t'sr<|endoftext|><|startoftext|>éßñ字١½\x85\x1c 　​0123!?*#İſΣ\u0301"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 14))) + rng.choice(["", "<|endoftext|>", "abc.'s", "it's.", " The end."]) for _ in range(3000)]
    for span in repair.batches_of(texts, 300):
        ids, counts = coder.encode(texts[span.start : span.stop])
        for t, own in zip(texts[span.start : span.stop], np.split(ids, np.cumsum(counts)[:-1])):
            assert own.tolist() == coder.tokenizer.encode(t, add_special_tokens=False).ids, t
    assert [x.tolist() for x in coder.encode([None, "", "\n \n"])] == [[], [0, 0, 0]]


@pytest.mark.parametrize("shard_ids", [1 << 19, 40])
def test_files_read_back(spark, tmp_path, shard_ids):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(tokenizer_path("word_bpe_49k.json"))
    docs = odd_documents(spark)
    path = str(tmp_path / "ids")
    repair.write_ids(docs, path, shard_ids=shard_ids, chars=shard_ids)
    got = repair.read_ids(spark, path).orderBy("start").collect()
    rows = sorted(((r["doc_id"], r["text"] or "") for r in docs.collect()), key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
    start = 0
    for r, (i, text) in zip(got, rows, strict=True):
        ids = lib.encode(text, add_special_tokens=False).ids + [1]
        assert (r["doc_id"], r["start"], r["n_tokens"], np.frombuffer(r["ids"], "<u4").tolist()) == (i, start, len(ids), ids)
        start += len(ids)
    shard = spark.read.parquet(path).orderBy("part", "shard").first().asDict()
    whole = [repair.tokens_of(shard, k) for k in range(len(shard["doc_ids"]))]
    for k, ids in enumerate(whole):
        for a in (0, len(ids) // 2):
            assert repair.tokens_of(shard, k, a, a + 3).tolist() == ids[a : a + 3].tolist()
    repair.write_ids(empty_documents(spark), str(tmp_path / "none"))
    assert repair.read_ids(spark, str(tmp_path / "none")).count() == 0
    assert zlib.crc32(got[0]["ids"]) == repair.read_ids(spark, path).selectExpr("start", "crc32(ids) c").orderBy("start").first()["c"]


def test_a_text_with_the_end_id_stays_whole(spark, tmp_path):
    docs = spark.createDataFrame([(1, 'say "x" twice'), (2, '"')], "doc_id long, text string")
    repair.write_ids(docs, str(tmp_path / "ids"), end_id=1)
    assert repair.read_ids(spark, str(tmp_path / "ids")).count() == 2


# --- pipeline ---


def test_pipeline_by_hand(spark, tmp_path):
    rng = random.Random(7)
    passage, item = words(rng, 60), words(rng, 30)
    rows, labels = [], []
    for i in range(400):
        w = words(rng, 80)
        if i % 5 == 0:
            w[3] = w[40] = "blorgh"
        rows.append([i, " ".join(w)])
        labels.append((i, 1, int(i % 5 == 0)))
    copy = rows[11][1].split()
    rows[12][1] = " ".join(copy[:79] + ["other"])
    rows[21][1] = " ".join(passage) + " " + rows[21][1]
    rows[22][1] = rows[22][1] + " " + " ".join(passage)
    rows[31][1] = rows[31][1] + " " + " ".join(item[5:20])
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows] + [(11, rows[11][1], "en", "s", 1)], "doc_id long, text string, lang string, source string, n_chars long")
    folder = str(tmp_path)
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, " ".join(item))], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    got = {r["doc_id"]: r for r in corpus_pipeline.run(spark, folder).collect()}
    assert set(got) == {i for i in range(400) if i % 5} - {12, 31}
    assert got[22]["text"].split() == rows[22][1].split()[:80] and got[21]["text"] == rows[21][1]
    assert all(len(r["ids"]) == 4 * r["n_tokens"] for r in got.values())
    state = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        state = stage(spark, state, folder)
        assert state.columns == docs.columns and state.dtypes == docs.dtypes


def test_stages_take_odd_rows(spark, tmp_path):
    folder = str(tmp_path)
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, "not in there")], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    for docs in (odd_documents(spark), empty_documents(spark)):
        state = docs
        for _, stage in corpus_pipeline.STAGES[:-1]:
            state = stage(spark, state, folder)
            assert state.columns == docs.columns
        corpus_pipeline.STAGES[-1][1](spark, state, folder).count()


def test_stages_keep_any_column(spark, tmp_path):
    """Columns named like results, with signs in their names, and of all kinds come out with the values that went in."""
    from pyspark.sql import functions as F

    folder = str(tmp_path)
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, "not in there")], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    rng = random.Random(21)
    names = ["Score", "predicted", "a.b", "a`tick", "Toxic_Terms", "c0", "c1", "Same", "own", "digest", "spans", "gone", "body", "items", "N_hit", "with space", "id", "k", "n"]
    docs = spark.createDataFrame([(i, " ".join(words(rng, 70))) for i in range(6)], "doc_id long, text string")
    for k, name in enumerate(names):
        docs = docs.withColumn(name, F.concat(F.lit(f"{k}-"), F.col("doc_id").cast("string")))
    docs = docs.withColumns({"at": F.lit("2024-05-06 07:08:09").cast("timestamp"), "money": F.lit("1.25").cast("decimal(9,2)"), "map": F.create_map(F.lit("x"), F.col("doc_id")), "pair": F.struct(F.lit(1).alias("p"), F.array(F.lit("q")).alias("q"))})
    want = sorted(map(str, docs.collect()))
    state = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        state = stage(spark, state, folder)
        assert state.columns == docs.columns and sorted(map(str, state.collect())) == want


# --- queries against SQL ---


def test_queries_match_their_sql(spark):
    import duckdb

    from ledgerfold.llm import queries

    data = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    for name, sql in queries.ORACLES.items():
        got, want = queries.QUERIES[name](spark, data).toPandas(), con.execute(sql).df()
        rows = lambda df: sorted(map(str, df[sorted(df.columns)].itertuples(index=False, name=None)))
        assert sorted(got.columns) == sorted(want.columns) and rows(got) == rows(want)


def test_every_query_runs_whole(spark):
    from ledgerfold.llm import queries

    data = "/root/testdata/sf0.001"
    docs, pages = (spark.read.parquet(f"{data}/{t}.parquet").count() for t in ("documents", "pages"))
    for name, query in queries.QUERIES.items():
        n = query(spark, data).count()
        assert n == (pages if name in ("op5_urls", "op8_html") else docs) or (name in ("op1_substring", "pipeline") and 0 < n < docs), name
