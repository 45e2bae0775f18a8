"""Operators that judge each row by itself: 3, 4, 5, 7, 8, 9, 10."""

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from ledgerfold.llm import bpe, common, decontam, hashing, html_main, quality, toxicity, unigram, urls
from ledgerfold.llm.common import tokenizer_path

from .corpus import empty_documents, odd_documents, words

# --- 3 ---


def library(name):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_path(name))


@pytest.fixture(scope="module")
def coder():
    return bpe.BacktrackingBpe(tokenizer_path("byte_bpe_50k.json"))


def test_bpe_equals_the_library(coder):
    rng, lib = random.Random(0), library("byte_bpe_50k.json")
    letters = "aaaabbc  eettthhhin \n\t'sr<|endoftext|>éßñ字١½\x85\x1c 　​0123!?*#"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 40))) for _ in range(3000)]
    texts += ["".join(rng.choice(["a", "aa", "ab", "the", "<|endoftext|>", "<|endof", "=" * rng.randint(1, 90)]) for _ in range(rng.randint(0, 9))) for _ in range(500)]
    texts += [chr(rng.choice([rng.randint(0, 0x2FF), rng.randint(0x300, 0xD7FF), rng.randint(0x10000, 0x1FFFF)])) * 3 for _ in range(500)] + ["x" * 30_000, "ab" * 20_000]
    for t in texts:
        ids = np.frombuffer(coder.encode(t), "<u4")
        want = lib.encode(t, add_special_tokens=False).ids
        assert ids.tolist() == want, t
        assert coder.decode(ids).decode("utf-8", "replace") == lib.decode(want, skip_special_tokens=False)


def test_bpe_of_odd_rows(spark):
    docs = odd_documents(spark)
    got = bpe.encode_decode(docs).collect()
    assert sorted(str(r["doc_id"]) + r["decoded"] for r in got) == sorted(str(r["doc_id"]) + (r["text"] or "") for r in docs.collect())
    assert all(len(r["ids"]) == 4 * r["n_tokens"] for r in got)
    digests = {r["doc_id"]: r for r in bpe.encode_digest(docs.where("doc_id = 2")).collect()}
    assert digests[2]["n_tokens"] == 0 and digests[2]["ids_sha256"] == hashlib.sha256(b"").hexdigest() == digests[2]["decoded_sha256"]
    assert bpe.encode_decode(empty_documents(spark)).count() == 0


# --- 4 ---


@pytest.fixture(scope="module")
def counter():
    return unigram.UnigramCounter(tokenizer_path("piece_bpe_32k.model"))


def unigram_library(pieces=None):
    """The tokenizers' own unigram model: of the vocabulary file read as one, or of the pieces given."""
    pb = pytest.importorskip("sentencepiece.sentencepiece_model_pb2")
    from sentencepiece import SentencePieceProcessor

    model = pb.ModelProto()
    if pieces is None:
        with open(tokenizer_path("piece_bpe_32k.model"), "rb") as f:
            model.ParseFromString(f.read())
    else:
        model.normalizer_spec.name, model.normalizer_spec.remove_extra_whitespaces = "identity", False
        for piece, score, kind in [("<unk>", 0, 2), *((p.replace(" ", "▁"), s, 1) for p, s in pieces.items())]:
            model.pieces.add(piece=piece, score=score, type=kind)
    model.trainer_spec.model_type = 1
    return SentencePieceProcessor(model_proto=model.SerializeToString())


def test_token_counts_equal_the_library(counter):
    import pyarrow.parquet as pq

    lib, rng = unigram_library(), random.Random(1)
    texts = [t or "" for t in pq.read_table("/root/testdata/sf0.01/documents.parquet", columns=["text"])["text"].to_pylist()]
    parts = ["the", "one", "re", " ", " ", "  ", "\n", "on", "a", "世", "ly", "ea", ".", "q", "Z", "▁", "😀", "ß", "\0", "\t", "lyeaea", "rechaux"]
    texts += ["".join(rng.choice(parts) for _ in range(rng.randint(1, 60))) for _ in range(3000)]
    texts += [" ", "   ", "x" * 3000, "the" * 200, " the" * 300, "the onere\n\n one onere", " ".join(words(rng, 500))]
    got = counter.counts(texts)
    assert [n for n, _ in got] == [len(lib.encode(t)) for t in texts]
    assert [counter.best(" " + t.replace("▁", " "))[0] for t in texts[:150] + texts[-900:]] == [n for n, _ in got[:150] + got[-900:]]


def test_forgotten_cuts_are_counted_again(monkeypatch):
    monkeypatch.setattr(unigram, "KEPT", 50)
    monkeypatch.setattr(unigram, "TOGETHER", 7)
    monkeypatch.setattr(unigram, "LONG", 6)
    counter, lib, rng = unigram.UnigramCounter(tokenizer_path("piece_bpe_32k.model")), unigram_library(), random.Random(5)
    for _ in range(20):
        texts = [" ".join(words(rng, 30)) for _ in range(5)]
        assert [n for n, _ in counter.counts(texts)] == [len(lib.encode(t)) for t in texts]


def test_frequent_cuts_are_run_once_and_together(monkeypatch):
    """Cuts whose path depends on what is before are run as arrays too, and those seen often outlast the others."""
    monkeypatch.setattr(unigram, "KEPT", 200)
    counter, rng = unigram.UnigramCounter(tokenizer_path("piece_bpe_32k.model")), random.Random(7)
    common, run, alone = [f" {w}" for w in words(rng, 40)], [], []
    together, single = counter.outcomes, counter.best
    monkeypatch.setattr(counter, "outcomes", lambda cuts, *before: (run.extend(() if before else cuts), together(cuts, *before))[1])
    monkeypatch.setattr(counter, "best", lambda cut, *start: (alone.append(cut), single(cut, *start))[1])
    for k in range(20):  # every other time none of the common cuts is there
        counter.counts(["".join(common) * 5 if k % 2 else " ".join(f"{w}{k}" for w in words(rng, 150))])
    assert max(run.count(c) for c in common) == 1
    assert len(alone) < 100


def test_other_vocabularies_equal_the_library():
    """Scores that are no whole numbers: 32-bit sums over whole texts. Without byte fallback an unknown letter is a token."""
    rng = random.Random(6)
    pieces = {a: -rng.random() * 9 for a in " abcd"} | {"".join(rng.choice("abcd ") for _ in range(rng.randint(2, 5))): -rng.random() * 20 for _ in range(120)}
    counter, lib = unigram.UnigramCounter(pieces=pieces), unigram_library(pieces)
    for _ in range(300):
        text = "".join(rng.choice("abcd  ") for _ in range(rng.randint(1, 400)))
        assert counter.counts([text])[0][0] == len(lib.encode(text))


def test_token_counts_of_odd_rows(spark, counter):
    got = {(r["doc_id"], r["n_tokens"]) for r in unigram.token_counts(odd_documents(spark)).collect()}
    assert {(2, 0), (3, 0)} <= got and len([g for g in got if g[0] is None]) == 1
    assert unigram.token_counts(empty_documents(spark)).count() == 0


# --- 5 ---


@pytest.mark.parametrize(
    ("url", "host", "path", "rule", "verdict"),
    [
        (None, "", "", None, "allow"), ("no host", "", "", None, "allow"), ("http://Example.COM", "example.com", "", None, "allow"), ("http://example.com/", "example.com", "/", "com/", "allow"),
        ("http://example.com/en/x?q#f", "example.com", "/en/x", "example.com/en/", "block"), ("https://m.example.com/en/1", "m.example.com", "/en/1", "example.com/en/", "block"),
        ("https://www.example.com/en/1", "www.example.com", "/en/1", "www.example.com/en/", "allow"), ("https://a.www.example.com/en/", "a.www.example.com", "/en/", "www.example.com/en/", "allow"),
        ("ftp://x.net/es/1", "x.net", "/es/1", "net/es/", "block"), ("http://x.net/esp", "x.net", "/esp", None, "allow"), ("http://notexample.com/en/", "notexample.com", "/en/", "com/", "allow"),
        ("http://x.org?a://b/c", "x.org", "", None, "allow"), ("http://cheappills.example.org/de/1", "cheappills.example.org", "/de/1", None, "block"), ("http://free-bets.example.net/de/", "free-bets.example.net", "/de/", None, "block"),
        ("http://freebets.org/", "freebets.org", "/", None, "block"), ("http://therat.example.org/fr/9", "therat.example.org", "/fr/9", None, "allow"), ("http://publiclibrary.org/", "publiclibrary.org", "/", None, "allow"),
    ],
)
def test_urls(spark, url, host, path, rule, verdict):
    r = urls.judge(spark.createDataFrame([(1, url)], "page_id long, url string")).first()
    assert (r["host"], r["path"], r["rule"], r["verdict"]) == (host, path, rule, verdict)


def cheapest_words(name, share, unknown):
    """All ways to cut a name: known words at -log of their share, runs of unknown letters at `unknown` and log(10) a letter."""
    best = None
    for k in range(len(name)):
        for cuts in itertools.combinations(range(1, len(name)), k):
            parts = [name[i:j] for i, j in zip((0, *cuts), (*cuts, len(name)))]
            known = [p in share for p in parts]
            if any(not x and not y for x, y in zip(known, known[1:])):
                continue  # unknown runs are whole
            c = sum(-math.log(share[p]) if ok else unknown + math.log(10) * len(p) for p, ok in zip(parts, known))
            best = min(best or (c, parts), (c, parts), key=lambda x: round(x[0], 9))
    return best


def test_verdicts_against_brute_force(spark):
    blocked, allowed = ["free bets", "pills", "bet s", "wettbüro"], ["news free", "be", "york times"]
    documents = ["New York times, new YORK Times! Büro 42 be2", None, "", "bets news of the new york pills", "free 4 free"]
    hosts = ["freebets", "xfreebets", "freexxbets", "newspills", "zzz", "freenewsbe", "newyorktimes", "wettbüro", "be2bets", "free-bets", "a.newyork", "42pills"]
    rows = [(k, f"http://{h}.org/{p}") for k, h in enumerate(hosts) for p in ("", "bets/x.html", "news%20free?q")] + [(99, "http://freebets.com/"), (99, "http://freebets.com/"), (None, None)]
    pages = spark.createDataFrame([(i, u, 1) for i, u in rows], "page_id long, url string, `Host` int")
    got = urls.judge(pages, spark.createDataFrame([(t,) for t in documents], "text string"), blocked=blocked, allowed=allowed).collect()
    count = Counter(w for t in documents if t for w in re.findall(r"[^\W_]+", t.lower()) if len(w) > 1)
    mine, total = [Counter(" ".join(x).split()) for x in (blocked, allowed)], sum(count.values())
    every = mine[0] + mine[1]
    share = {w: 0.1 * every[w] / sum(every.values()) + 0.9 * count[w] / total for w in every | count}
    odds = {w: math.log((mine[0][w] + 0.5) / (sum(mine[0].values()) + 0.5 * len(every))) - math.log((mine[1][w] + 0.5) / (sum(mine[1].values()) + 0.5 * len(every))) for w in every}
    want = []
    for i, u in rows:
        host, _, path = (u or "://").split("://", 1)[1].partition("/")
        path = path.split("?")[0].replace("%20", " ")
        names = re.findall(r"[^\W_]+", f"{host.removesuffix('.org')} {path}") if ".com" not in host else []
        words = [w for n in names for w in cheapest_words(n, share, math.log(total + sum(every.values())))[1]]
        z = math.log(0.25) + sum(odds.get(w, 0) for w in words)
        want.append((str(i), ".com" in host, None if ".com" in host else words, None if ".com" in host else round(1 / (1 + math.exp(-z)), 9), "allow" if ".com" in host or z <= 0 else "block"))
    assert sorted((str(r[0]), r["rule"] is not None, r["words"], r["block_probability"] and round(r["block_probability"], 9), r["verdict"]) for r in got) == sorted(want)
    assert len({x[4] for x in want}) == 2 and ["new", "york", "times"] in [x[2] for x in want]


def test_hosts_that_are_no_training_rows(spark):
    """Kinds of hosts in the tables, none of which is a row of the lists, and others."""
    bad = ["cheap-pills.example.org", "free-bets.example.net", "ads-track.example.org", "adult-x.example.net", "casino-win.example.org", "spam-farm.example.net", "bestonlinecasinos.info", "xxxvideostube.org", "replicawatchesbuy.net"]
    good = ["newyorktimes.org", "universityofscience.edu", "myfoodblog.net", "weatherforecast.org", "tionsh.example.org", "citylibrary.net"]
    assert not {h.split(".")[0].replace("-", " ") for h in bad} & set(urls.BLOCKED)
    pages = spark.createDataFrame([(k, f"http://{h}/de/1.html") for k, h in enumerate(bad + good)], "page_id long, url string")
    got = {r["page_id"]: r["verdict"] for r in urls.judge(pages, spark.read.parquet("/root/testdata/sf0.001/documents.parquet")).collect()}
    assert [got[k] for k in range(len(bad + good))] == ["block"] * len(bad) + ["allow"] * len(good)


def test_urls_of_odd_rows(spark):
    pages = spark.createDataFrame([("a", "http://x.org/" + "ab" * 50_000, 1), ("a", "http://x.org/" + "ab" * 50_000, 1), (None, "", 2), ("b", None, 3)], "page_id string, url string, verdict int").withColumnRenamed("verdict", "ver.dict")
    got = urls.judge(pages, empty_documents(spark)).collect()
    assert sorted((str(r["page_id"]), r["verdict"]) for r in got) == [("None", "allow"), ("a", "allow"), ("a", "allow"), ("b", "allow")]
    assert urls.judge(pages.where("page_id = 'c'"), empty_documents(spark)).count() == 0


# --- 7 ---


def slow_hits(text, bench, window=10):
    w = decontam.words_of(text)
    hit, items = set(), set()
    for i, t in bench:
        b = decontam.words_of(t)
        m = min(window, len(b))
        for k in range(len(b) - m + 1 if m else 0):
            for at in range(len(w) - m + 1):
                if w[at : at + m] == b[k : k + m]:
                    hit.update(range(at, at + m))
                    items.add(i)
    return len(w), len(hit), sorted(str(i) for i in items if i is not None)


@pytest.mark.parametrize("block_bytes", [1 << 20, 40])
def test_contamination_against_brute_force(spark, block_bytes):
    rng = random.Random(3)
    few = ["a", "b", "c", "d'e", "É"]
    bench = [(i, " ".join(rng.choice(few) for _ in range(rng.randint(0, 14)))) for i in range(8)] + [(None, "q r s"), (20, None), (3, "z"), (11, "A b. C")]
    docs = [(i, " ".join(rng.choice([*few, "q", "r", "s", "z", "Q-R"]) for _ in range(rng.randint(0, 60)))) for i in range(60)] + [(None, "q r s"), (61, None)]
    got = decontam.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(bench, "item_id long, text string"), block_bytes=block_bytes, keep=("text",))
    for r in got.collect():
        n, hit, items = slow_hits(r["text"], bench)
        assert (r["n_words"], r["n_hit"], r["items"], r["contaminated"]) == (n, hit, items, hit > 0)
    assert got.count() == len(docs)


def test_contamination_of_odd_rows(spark):
    bench = spark.createDataFrame([(1, "two three four")], "item_id long, text string")
    docs = odd_documents(spark)
    got = decontam.contaminated(docs, bench, keep=tuple(docs.columns))
    assert got.count() == docs.count() and {r["doc_id"] for r in got.where("contaminated").collect()} == {1, 7}
    assert got.where("contaminated").first()["score"] == "extra score"
    assert decontam.contaminated(empty_documents(spark), bench).count() == 0
    assert decontam.contaminated(docs, spark.createDataFrame([], "item_id long, text string")).where("contaminated").count() == 0


# --- 8 ---

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var x = "<p>no</p>";</script></head><body>
<div class="cookie-notice"><p>We use cookies on this site to make it work for you and for others as well.</p></div>
<header><h2>Site name</h2><ul class="menu"><li><a href="/">Home</a><li><a href="/a">About</a></ul></header><nav><a href="/x">Menu</a></nav>
<main><article><h1>The  title &amp; more</h1><p>First paragraph with <b>bold &lt;text&gt;
 and</b> a line<br>break of some length to read.<p>Second paragraph, unclosed, also with some length to read.
<div class="ad">Buy now cheap things</div><table><tr><td>cell one<td>cell two</table><p>Short.</p></article>
<section id="comments"><h3>Comments</h3><p>I think this is a very long comment by a reader that should not be here at all.</p></section></main>
<aside><p>Related stories that are long enough to look like a paragraph of the article itself.</p></aside>
<form><label>Name</label><input><textarea>typed</textarea></form><!-- <p>hidden</p> --><footer>&copy; nobody</footer></body></html>"""


def test_main_text():
    assert html_main.main_text(PAGE) == "The title & more\n\nFirst paragraph with bold <text> and a line break of some length to read.\n\nSecond paragraph, unclosed, also with some length to read.\n\ncell one\n\ncell two\n\nShort."


@pytest.mark.parametrize("source", [None, "", "   ", "<", "<p", "<!--", "<script>", "</p></p>", "<a href='x>y", "&#0;&bad;", "<div " * 2000, "<p>" * 5000, "<a" * 20_000, "<svg>" * 20_000, "<noscript>x" * 20_000, "<button>" * 20_000, "<a href=x>" * 20_000, "a < b > c"])
def test_broken_html_gives_something(source):
    assert isinstance(html_main.main_text(source), str)


@pytest.mark.parametrize(
    ("source", "text"),
    [
        ("<html><head><title>t</title><p>Article text.", "Article text."), ("<title>t</title><meta charset=x>Bare text", "Bare text"), ("<body><p>Short</p>", "Short"), ("<div>Hello world</div>", "Hello world"),
        ('<article><ul class="social-list-of-facts"><li>one fact</li><li>two facts</li></ul></article>', "one fact\n\ntwo facts"), ("<article><p>Hi</article><footer>by us, with all the words of a whole sentence in it.</footer>", "Hi"),
        ("<body><button>Go<p>After an open button.</p>", "Go\n\nAfter an open button."), ("<button>Go</button><p>After.</p>", "After."), ("<select><option>a<option>b</select><p>After.</p>", "After."), ("<video><p>no video</p></video><p>After.</p>", "After."), ("<map><p>In a map.</p></map>", "In a map."),
        ("<a href=x>open <p>one two.</p><p>three.</p>", "open\n\none two.\n\nthree."), ('<div class="comments"><article class="comment"><p>' + "A reader says this. " * 40 + "</p></article></div><p>The text.</p>", "The text."),
        ("<header><h1>Site</h1></header><p>The text.</p>", "The text."), ("<article><header><h1>Title</h1></header><p>The text.</p></article>", "Title\n\nThe text."), ("<form><p>Your name:</p><p>Subscribe</p></form><p>The text.</p>", "The text."), ('<body class="home page-sidebar nav-open"><p>The text.</p>', "The text."),
    ],
)
def test_what_is_content(source, text):
    assert html_main.main_text(source) == text


LONG_TEXT = "A paragraph of an article that says something at some length, as paragraphs of articles do."


def test_the_cut_overrules_costs():
    """Blocks whose own cost has the wrong sign, put right by what is near them."""
    linked = html_main.Page().read(f'<div><p>{LONG_TEXT}</p><p><a href="x">A line that is a link</a></p><p>{LONG_TEXT}</p></div>')
    assert [b.cost > 0 for b in linked.blocks] == [True, False, True] and html_main.content(linked) == [True] * 3
    advert = html_main.Page().read(f'<div class="ad">{LONG_TEXT}</div><article><p>{LONG_TEXT}</p></article>')
    assert all(b.cost > 0 for b in advert.blocks) and html_main.content(advert) == [False, True]
    whole = html_main.Page().read(f'<form id="aspnetForm">{f"<p>{LONG_TEXT * 4}</p>" * 3}</form>')  # a form around a page
    assert html_main.content(whole) == [True] * 3
    partly = html_main.Page().read(f'<div class="popup-facts"><p>{LONG_TEXT}</p><p>{LONG_TEXT}</p><p>{LONG_TEXT}</p></div>')
    assert partly.elements[0].capacity == -3 and html_main.content(partly) == [True] * 3


def test_cut_is_minimal():
    rng = random.Random(4)
    for _ in range(60):
        n, m = rng.randint(2, 7), rng.randint(0, 3)
        elements = [html_main.Element(rng.uniform(-4, 4), rng.uniform(0, 3), rng.randrange(-1, k)) for k in range(m)]
        blocks = [html_main.Block("t", rng.uniform(-3, 3), rng.randrange(3), rng.randrange(1, 4), rng.randrange(-1, m)) for _ in range(n)]

        def total(labels, kinds):
            cost = sum(abs(b.cost) for b, keep in zip(blocks, labels) if keep != (b.cost > 0))
            cost += sum(abs(e.capacity) for e, keep in zip(elements, kinds) if keep != (e.capacity > 0))
            cost += sum(html_main.AROUND for e, keep in zip(elements, kinds) if e.around >= 0 and kinds[e.around] != keep)
            cost += sum(elements[b.element].edge for b, keep in zip(blocks, labels) if b.element >= 0 and kinds[b.element] != keep)
            last = {}
            for i, b in enumerate(blocks):
                near = last.get(b.container)
                if near is not None and labels[near] != labels[i]:
                    cost += html_main.SAME_CONTAINER
                if i and near != i - 1 and labels[i - 1] != labels[i]:
                    cost += html_main.NEXT / (1 + abs(b.depth - blocks[i - 1].depth))
                last[b.container] = i
            return cost

        kinds = list(itertools.product([False, True], repeat=m))
        least = min(total(x, k) for x in itertools.product([False, True], repeat=n) for k in kinds)
        assert min(total(html_main.content(html_main.Page(blocks, elements)), k) for k in kinds) <= least + 1e-6


def test_pages_of_odd_rows(spark):
    pages = spark.createDataFrame([(1, "u", PAGE), (None, None, None), (2, "v", ""), (2, "v", "")], "page_id long, url string, html string")
    got = sorted((str(r["page_id"]), r["n_chars"]) for r in html_main.extract(pages).collect())
    assert got == [("1", len(html_main.main_text(PAGE))), ("2", 0), ("2", 0), ("None", 0)]
    assert html_main.extract(pages.where("page_id = 5")).count() == 0
    long = f"<article>{'<p>' + LONG_TEXT + '</p>'}" * 1 + f"<p>{LONG_TEXT}</p>" * 20_000 + "</article>"
    extra = spark.createDataFrame([("a", long, 1, 2.0)], "page_id string, html string, text int, `n.chars` double").selectExpr("*", "'u' AS url")
    r = html_main.extract(extra).first()
    assert (r["page_id"], r["url"], r["n_chars"]) == ("a", "u", 20_001 * (len(LONG_TEXT) + 2) - 2)


# --- 9 ---


@pytest.mark.parametrize(("text", "hit"), [("you IDIOT", True), ("you 1d10t!", True), ("іdіоt", True), ("ï\u0064iot", True), ("ＩＤＩＯＴ", True), ("id\u00adiot", True), ("idiots", True), ("what an asshol3.", True), ("mor0n5", True), ("mor0n", True), ("b!tch", True), ("a b1+ch", True), ("i d i o t", True), ("an i.d.i.o.t here", True), ("ịđiøt", True), ("ɪᴅɪᴏᴛ", True), ("ёbc ідіоӊ", False), ("𝐢𝐝𝐢𝐨𝐭", True), ("іԁіот", True), ("ιdιoτ", True), ("a b c d e", False), ("idiosyncratic", False), ("flame retardant", False), ("that! is# fine", False), ("idiots guide", False), ("an idiot proof plan", False), ("10 times 4 is 40", False), ("", False), (None, False)])
def test_lexicon_matches(text, hit):
    scanner = toxicity.Lexicon().scanner()
    score, terms, _ = scanner.score(text)
    assert bool(terms) == hit and (score > toxicity.Lexicon().scanner().score("")[0]) == hit


def slow_score(lexicon, text, threshold):
    """Score and terms by comparing every word with every entry."""
    words = re.findall(r"[^\W\d_]+", toxicity.fold(text or ""))
    phrases, spared = [p.split() for p in lexicon.exceptions], set()
    for k in range(len(words)):
        spared |= {k + j for p in phrases if words[k : k + len(p)] == p for j in range(len(p))}
    total, terms = 0.0, []
    for k, w in enumerate(words):
        forms = {w, toxicity.bare(w)}
        fits = [(x, e) for e, x in lexicon.weights.items() if any(f == e.strip() if e.endswith(" ") else f.startswith(e[1:]) and (f == w or e[1:] in toxicity.STEMS) for f in forms)]
        if fits and k not in spared:
            total += max(fits)[0]
            terms.append(max(fits)[1].strip())
    z = lexicon.curve[0] + lexicon.curve[1] * math.log1p(total) + lexicon.curve[2] * math.log1p(100 * total / max(len(words), 20))
    score = 1 / (1 + math.exp(-max(-30, min(30, z))))
    return round(score, 9), int(score >= threshold), len(words), len(terms)


def test_scores_against_brute_force(spark):
    rng = random.Random(17)
    parts = [*toxicity.SEEDS, *toxicity.EXCEPTIONS, "idi0t", "Bl0rgh", "snar", "snarfles", "snarfled", "ídiot", "b!tch", "m o r o n", "retardant", "10", "a1", "é", *words(rng, 60)]
    rows = [(k, " ".join(rng.choice(parts) for _ in range(rng.randint(0, 40)))) for k in range(400)] + [(500, None), (500, ""), (None, "an idiot"), (501, "idiot " * 20_000), (502, "x" * 100_000)]
    lexicon = toxicity.Lexicon()
    lexicon.weights |= {" blorgh ": 4.25, " snar": 2.5, " snarfles ": 3.5, " the ": 0.25}
    lexicon.curve = (-5.0, 1.5, 0.75)
    got = toxicity.toxic(spark.createDataFrame(rows, "doc_id long, text string"), lexicon, 0.3).collect()
    have = sorted((str(r["doc_id"]), round(r["score"], 9), r["predicted"], r["toxic_words"], len(r["toxic_terms"])) for r in got)
    assert have == sorted((str(i), *slow_score(lexicon, t, 0.3)) for i, t in rows)
    assert 0 < sum(x[2] for x in have) < len(have)


def test_learnt_weights_against_brute_force(spark):
    rng = random.Random(18)
    rows = [(k, " ".join(words(rng, 40) + (["blorgh", "snarfles"] if k % 6 == 0 else []))) for k in range(900)]
    labels = [(k, int(k % 6 == 0)) for k in range(900)]
    lexicon = toxicity.learn(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int"))
    learnt = [k for k in range(900) if zlib.crc32(str(k).encode()) % 4 != 2]
    for entry, weight in lexicon.weights.items():
        if entry.strip() in toxicity.SEEDS:
            continue
        n = [0, 0]
        for k in learnt:
            found = re.findall(r"[^\W\d_]+", toxicity.fold(rows[k][1]))
            n[labels[k][1]] += any(w == entry.strip() if entry.endswith(" ") else w.startswith(entry[1:]) for w in found)
        t = [sum(labels[k][1] == y for k in learnt) for y in (0, 1)]
        assert abs(weight - (math.log((n[1] + 0.5) / (t[1] + 1)) - math.log((n[0] + 0.5) / (t[0] + 1)))) < 1e-4
    assert {" blorgh ", " snarfles "} & set(lexicon.weights)


def test_toxicity_learns(spark):
    rng = random.Random(5)
    rows, labels = [], []
    for i in range(1200):
        w = words(rng, 60)
        toxic = rng.random() < 0.2
        if toxic:
            for _ in range(3):
                w[rng.randrange(60)] = rng.choice(["blorgh", "snarfle", "Bl0rgh"])
        rows.append((i, " ".join(w)))
        labels.append((i, 1, int(toxic)))
    docs, given = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    lexicon = toxicity.learn(docs, given)
    assert " blorgh " in lexicon.weights and " snarfle " in lexicon.weights
    got = toxicity.toxic(docs, lexicon).withColumn("held_out", toxicity.held_out()).join(given, "doc_id").where("held_out").collect()
    assert len(got) > 200 and sum(r["predicted"] == r["toxic"] for r in got) / len(got) > 0.98


def test_toxicity_of_odd_rows(spark):
    docs = odd_documents(spark)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = toxicity.toxic(docs, toxicity.learn(docs, none))
    assert got.count() == docs.count() and got.where("score < 0 or score > 1 or score is null").count() == 0
    odd = spark.createDataFrame([(1, None, None), (None, 1, 1), (1, 0, 1), (7, 0, 0)], "doc_id long, quality int, toxic int")
    assert toxicity.toxic(docs, toxicity.learn(docs, odd)).where("score is null").count() == 0
    assert toxicity.toxic(empty_documents(spark), toxicity.Lexicon()).count() == 0


# --- 10 ---


def slow_counts(text):
    import re

    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    triples = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    covered = {i + k for i, t in enumerate(triples) if triples.count(t) > 1 for k in range(3)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)


def test_base_counts():
    rng = random.Random(6)
    for _ in range(400):
        text = "".join(rng.choice(["a", "b", " ", " ", "\n", "#", "é ", "\x85", "\xa0", "\x1c", "a b a b ", "|x| "]) for _ in range(rng.randint(0, 40)))
        assert quality.counts_of(text) == slow_counts(text), repr(text)


def test_quality_learns(spark):
    rng = random.Random(7)
    rows, labels = [], []
    for i in range(900):
        w = words(rng, rng.randint(60, 120))
        good = rng.random() < 0.7
        rows.append((i, " ".join(w) if good else " ".join(x + rng.choice(["***", "%%%", "$$$"]) for x in w)))
        labels.append((i, int(good), 0))
    docs, given = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = quality.train(docs, given.where("doc_id < 600"))
    got = quality.assess(docs, model).join(given, "doc_id").where("doc_id >= 600").collect()
    assert sum(r["kept"] == (r["quality"] == 1) for r in got) / len(got) > 0.98


def slow_features(text, bits):
    """Shares of hashed n-grams, one by one."""
    raw, out = (text or "").encode(), {}
    wrap = lambda x: x & 0xFFFFFFFF
    two = [wrap(wrap(a * 0x9E3779B1) + wrap(b * 0x85EBCA6B)) for a, b in zip(raw, raw[1:])]
    four = [wrap(wrap(two[k] * 0xC2B2AE35) + wrap(two[k + 2] * 0x27D4EB2F) + 1) for k in range(len(two) - 2)]
    for x in two + four:
        key = x >> (32 - bits)
        out[key] = out.get(key, 0) + quality.SCALE / len(two + four)
    hashes = hashing.word_hashes(np.frombuffer(raw, np.uint8)) if raw else []
    for x in hashes:
        key = (1 << bits) + (int(x) >> (64 - bits))
        out[key] = out.get(key, 0) + quality.SCALE / len(hashes)
    return out


def test_quality_model_against_brute_force(spark):
    """The fit is the minimum of the loss, the calibration that of Platt's, the probability what the features say."""
    rng, bits = random.Random(8), 6
    rows = []
    for i in range(500):
        good = rng.random() < 0.6
        w = [x + ("$$" if rng.random() < (0.1 if good else 0.2) else "") for x in words(rng, 30)]
        rows.append((i, " ".join(w), int(good)))
    docs, given = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(3, "another text of id 3"), (None, "x")], "doc_id long, text string"), spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, quality int")
    model = quality.train(docs, given, sample=400, bits=bits, rounds=100)
    order = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(3, "another text of id 3")], "k long, t string").selectExpr("k", "t", "xxhash64(k) a", "xxhash64(k, t) h").collect()
    chosen = {r["k"] for r in sorted({(r["a"], r["k"]): r for r in order}.values(), key=lambda r: (r["a"], r["k"]))[:400]}
    sampled = {}
    for r in sorted(order, key=lambda r: -r["h"]):
        if r["k"] in chosen:
            sampled[r["k"]] = (r["t"], rows[r["k"]][2], r["h"] % 4 != 3)
    w = np.concatenate([model.chars, model.words]).astype(float)
    z = {k: model.bias + sum(v * w[c] for c, v in slow_features(t, bits).items()) for k, (t, _, _) in sampled.items()}
    fits = [k for k, x in sampled.items() if x[2]]
    gradient = quality.DECAY * w
    slope = 0.0
    for k in fits:
        err = (1 / (1 + math.exp(-z[k])) - sampled[k][1]) / len(fits)
        slope += err
        for c, v in slow_features(sampled[k][0], bits).items():
            gradient[c] += err * v
    assert np.abs(gradient).max() < 2e-3 and abs(slope) < 2e-3 and np.abs(w).max() > 0.1
    rest = [k for k in sampled if k not in fits]
    n1 = sum(sampled[k][1] for k in rest)
    targets = {k: (n1 + 1) / (n1 + 2) if sampled[k][1] else 1 / (len(rest) - n1 + 2) for k in rest}

    def loss(a, b):
        return sum(math.log1p(math.exp(-abs(a * z[k] + b))) + max(a * z[k] + b, 0) - targets[k] * (a * z[k] + b) for k in rest)

    best = loss(model.slope, model.shift)
    assert all(best <= loss(model.slope + da, model.shift + db) + 1e-3 for da in (-0.05, 0, 0.05) for db in (-0.05, 0, 0.05))
    got = {r["doc_id"]: r for r in quality.assess(docs.where("doc_id <> 3"), model).collect()}
    for i, t, _ in rows[:60]:
        p = 1 / (1 + math.exp(-(model.slope * (model.bias + sum(v * w[c] for c, v in slow_features(t, bits).items())) + model.shift)))
        if i != 3:
            assert abs(got[i]["probability"] - p) < 1e-5 and got[i]["kept"] == (not got[i]["base_failed"] and p >= quality.THRESHOLD)


def test_the_sample_does_not_depend_on_order(spark):
    rng = random.Random(9)
    rows = [(k % 90, " ".join(words(rng, 20) + ["$$"] * (k % 90 % 2))) for k in range(300)]
    given = spark.createDataFrame([(k, k % 2) for k in range(90)], "doc_id long, quality int")
    one, two = (quality.train(spark.createDataFrame(x, "doc_id long, text string").repartition(n), given, sample=50, bits=8) for x, n in ((rows, 1), (rows[::-1], 5)))
    assert np.allclose(one.chars, two.chars) and one.bias == pytest.approx(two.bias) and one.slope == pytest.approx(two.slope)


def test_quality_of_odd_rows(spark):
    docs = odd_documents(spark)
    got = quality.assess(docs, quality.neutral())
    assert got.count() == docs.count() and got.where("n_words = 0 and (kept or not base_failed)").count() == 0
    assert quality.train(docs, spark.createDataFrame([(1, 1, 0), (None, 0, 0)], "doc_id long, quality int, toxic int")).margin("x") == 0
    assert quality.assess(empty_documents(spark), quality.neutral()).count() == 0


def test_texts_travel_in_small_batches(spark):
    from pyspark.sql import functions as F

    docs = spark.range(0, 6000, 1, 1).select("id", F.repeat(F.lit("word "), 2000).alias("text"))
    make = lambda: lambda ids, texts: (ids, [max(x.size for x in texts.buffers() if x)] * len(texts))
    sizes = common.map_columns(docs, ["id", "text"], make, [("id", "long"), ("size", "long")])
    n, most = sizes.agg(F.count("*"), F.max("size")).first()
    assert n == 6000 and most <= 2 * common.BYTES  # 60 MB in one batch by Spark's default


def test_a_size_of_batches_that_is_set_stays(spark):
    before = spark.conf.get(common.BATCH_BYTES, None)
    try:
        spark.conf.set(common.BATCH_BYTES, "12345678")
        common.in_small_batches(spark)
        assert spark.conf.get(common.BATCH_BYTES) == "12345678"
    finally:
        spark.conf.set(common.BATCH_BYTES, before) if before else spark.conf.unset(common.BATCH_BYTES)


def test_a_worker_keeps_only_the_tables_of_its_operator(monkeypatch):
    import weakref

    class Table:
        def __init__(self):
            self.cache = common.PieceCache(lambda piece: (self, piece))

    monkeypatch.setattr(common, "_PER_WORKER", {})
    kept = []

    def make():
        kept.append(weakref.ref(common.per_worker("table", Table)))
        return "step"

    assert common.only_own(make) == common.only_own(make) == "step"
    assert kept[0]() is kept[1]() is not None  # the same operator's next task finds it
    common.only_own(lambda: common.latest("kind", "token", lambda: 1))
    assert kept[0]() is None and list(common._PER_WORKER) == ["kind"]
