"""Operator 5: URL filters.

judge(pages, documents) gives each url's host and path, the rule that decides it, if any, and else the verdict of a
classifier: a unigram Viterbi pass splits the names in host and path into words (freebets -> free bets), and multinomial
naive Bayes scores the words.

The host follows the first "://" up to "/", "?", "#" or the end, A-Z in lower case; the path follows it up to "?", "#"
or the end. Null urls and those without "://" have an empty host and path. A rule "host/path" fits its host and all
subdomains where the url's path starts with the rule's (with its slash); of those that fit the longest wins, and of
equally long ones the one given first.

Names are runs of letters and digits, percent escapes decoded. Word costs for splitting come from the words of all
documents, counted whole, mixed with the words of the training rows (OF_ROWS of the probability). No dictionary is
gathered: the parts of each distinct name are joined with the counts, so the words known grow with the corpus. The
classifier's training rows are the fixed lists below, made of words common in each kind of host; there are no url labels in
the tables, and of the tables' own host names none is a row. Words that no row has say nothing, so a host of unknown words
is judged by the prior alone: allowed. Each distinct host and path is judged once; a name that a third of all urls have
is spread over SALTS tasks.

Without documents (or with null and empty texts) the rows' words alone are known. An empty table gives an empty table;
urls may be of any length (a name's parts are at most LONGEST letters). Null ids and repeated rows stay rows of their own;
extra columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from urllib.parse import unquote

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches, map_columns, per_worker, picked, type_of

#: (verdict, rule): fixed by the query's contract.
RULES = [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/")]
#: Training rows, names of hosts and paths as words: fixed values.
BLOCKED = [
    "viagra pills", "buy pills online", "discount pharmacy", "online pharmacy no prescription", "cialis generic", "weight loss pills", "diet pills", "miracle cure", "cheap meds", "cheap steroids",
    "sports bets", "bet bonus", "online casino", "casinos online", "casino bonus", "free spins", "slots jackpot", "poker online", "live casino", "roulette", "lottery winner", "gambling tips", "betting odds", "wetten bonus", "spielautomaten", "paris sportifs", "apuestas",
    "xxx videos", "adult videos", "free porn", "porn tube", "sex cams", "live cams", "nude pics", "hot girls", "adult dating", "escort service", "hookup now", "erotik", "adult chat", "sexe gratuit",
    "ads server", "ad server", "ad click", "click track", "track pixel", "tracking ads", "banner ads", "popup ads", "ads network", "affiliate offers", "spam links", "link farm", "content farm", "spam mail", "adserver", "doorway pages",
    "fast cash", "easy money", "make money fast", "payday loans", "cheap loans", "quick credit", "crypto giveaway", "free bitcoin", "get rich", "fake watches", "replica watches", "replica bags",
    "free download crack", "warez download", "keygen crack", "torrent crack", "free ringtones", "win prize", "claim prize", "free gift cards", "malware", "phishing login", "clickbait", "essay writing cheap", "win big", "winner prizes",
]
ALLOWED = [
    "news", "daily news", "world news", "local news", "blog", "travel blog", "food blog", "tech blog", "science", "science journal", "open science", "university", "library", "public library", "museum", "art museum",
    "history", "history of art", "encyclopedia", "wiki", "dictionary", "docs", "developer docs", "open source", "software", "code forum", "support forum", "help center", "research", "research lab",
    "health", "health service", "hospital", "medicine journal", "weather", "weather forecast", "maps", "city guide", "travel guide", "recipes", "cooking recipes", "garden", "home garden", "music",
    "music school", "film review", "book review", "books", "book shop", "sports news", "football club", "school", "high school", "online courses", "government", "city council", "law review", "bank",
    "finance news", "business review", "energy", "climate", "nature", "wild nature", "photo archive", "archive", "web archive", "archive org", "education", "game review", "chess club", "track and field", "farm life", "family farm", "online shop", "train tracks", "zeitung", "nachrichten", "schule", "bibliothek", "journal", "noticias", "biblioteca", "escuela", "ciencia", "forum", "blog post", "index page",
]
PRIOR = 0.2
ALPHA = 0.5
#: Letters of the longest word; share of the rows' words in word costs; tasks that a name is spread over.
LONGEST, OF_ROWS, SALTS = 24, 0.1, 8
#: Labels of a host that name nothing.
COMMON_LABELS = {"www", "m", "mobile", "blog", "blogs", "shop", "com", "net", "org", "edu", "gov", "info", "biz", "co", "io", "uk", "de", "fr", "es"}
NAMES = re.compile(r"[^\W_]+").findall
URL = re.compile(r"^.*?://([^/?#]*)([^?#]*)", re.S).match
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_path(url: str | None) -> tuple[str, str]:
    m = URL(url) if url else None
    return (m[1].translate(LOWER), m[2]) if m else ("", "")


def names_of(host: str, path: str) -> list[str]:
    """Names in host and path that may hold words."""
    labels = [x for x in host.split(".") if x not in COMMON_LABELS]
    return [n for x in [*labels, unquote(path)] for n in NAMES(x.lower())]


class Rules:
    def __init__(self, rules: list[tuple[str, str]]):
        self.by_host: dict[str, list[tuple[str, str, str]]] = {}
        for verdict, rule in rules:
            host, slash, path = rule.partition("/")
            self.by_host.setdefault(host.translate(LOWER), []).append((slash + path, rule, verdict))

    def find(self, host: str, path: str) -> tuple[str | None, str | None]:
        labels, best = host.split("."), (None, None)
        for k in range(len(labels)):
            for start, rule, verdict in self.by_host.get(".".join(labels[k:]), ()):
                if path.startswith(start) and (best[0] is None or len(rule) > len(best[0])):
                    best = (rule, verdict)
        return best


class NaiveBayes:
    """Log odds of words, and the words' share of the rows, from the training rows."""

    def __init__(self, blocked: list[str], allowed: list[str], prior: float = PRIOR):
        counts = [Counter(w for row in rows for w in row.split()) for rows in (blocked, allowed)]
        words = counts[0] | counts[1]
        self.total = max(1, sum((counts[0] + counts[1]).values()))
        self.share = {w: (counts[0][w] + counts[1][w]) / self.total for w in words}
        sums = [sum(c.values()) + ALPHA * len(words) for c in counts]
        self.odds = {w: math.log((counts[0][w] + ALPHA) / sums[0]) - math.log((counts[1][w] + ALPHA) / sums[1]) for w in words}
        self.prior = math.log(prior / (1 - prior))

    def costs(self, name: str, counts: dict[str, int], total: int) -> dict[str, float]:
        """Costs of the words that are parts of a name. counts: of parts in the documents; total: of all words there."""
        of_rows = OF_ROWS if total else 1.0
        out = {}
        for a in range(len(name)):
            for b in range(a + 1, min(len(name), a + LONGEST) + 1):
                p = of_rows * self.share.get(name[a:b], 0.0) + (1 - of_rows) * counts.get(name[a:b], 0) / max(1, total)
                if p:
                    out[name[a:b]] = -math.log(p)
        return out

    def split(self, name: str, counts: dict[str, int] | None = None, total: int = 0) -> list[str]:
        return split(name, self.costs(name, counts or {}, total), math.log(total + self.total))

    def score(self, words: list[str]) -> float:
        return sum(self.odds.get(w, 0.0) for w in words)


def split(name: str, cost: dict[str, float], unknown: float) -> list[str]:
    """The likeliest words that make up a name; what is no known word stays in runs of its own, each at the cost
    `unknown` and log(10) for each letter."""
    n = len(name)
    best: list[tuple[float, int, bool]] = [(0.0, 0, True)] + [(math.inf, 0, False)] * n
    for end in range(1, n + 1):
        for start in range(max(0, end - LONGEST), end):
            if (c := cost.get(name[start:end])) is not None and best[start][0] + c < best[end][0]:
                best[end] = (best[start][0] + c, start, True)
        more = math.log(10) + (0 if end > 1 and not best[end - 1][2] else unknown)  # one letter more, or a new run
        if best[end - 1][0] + more < best[end][0]:
            best[end] = (best[end - 1][0] + more, end - 1, False)
    out, end, run = [], n, ""
    while end:
        _, start, known = best[end]
        if known:
            out += [run] * bool(run) + [name[start:end]]
            run = ""
        else:
            run = name[start:end] + run
        end = start
    return [*out, *[run] * bool(run)][::-1]


def word_counts(documents: DataFrame, text_col: str = "text") -> DataFrame:
    """word and n: how often each word of 2 to LONGEST letters or digits is in all texts, in lower case."""
    text = F.lower(F.col("t").cast("string"))
    words = picked(documents, t=text_col).select(F.explode(F.regexp_extract_all(text, F.lit(r"[\p{L}\p{N}]+"), F.lit(0))).alias("word"))
    return words.where(F.length("word").between(2, LONGEST)).groupBy("word").agg(F.count("*").alias("n"))


def words_of(names: DataFrame, counts: DataFrame | None, given: tuple) -> DataFrame:
    """name, words and odds (their log odds of a host to block, summed) of each name."""
    total = (counts.agg(F.sum("n").alias("n")).first()["n"] or 0) if counts is not None else 0

    def make_parts():
        def step(names):
            rows = sorted({(n, n[a:b]) for n in names.to_pylist() for a in range(len(n)) for b in range(a + 2, min(len(n), a + LONGEST) + 1)})
            return [n for n, _ in rows], [p for _, p in rows]

        return step

    if counts is None:
        found = names.withColumn("found", F.expr("cast(null as array<struct<word: string, n: bigint>>)"))
    else:
        parts = map_batches(names, ["name"], make_parts, "name string, word string", [("name", pa.string()), ("word", pa.string())])
        known = parts.join(counts, "word").groupBy("name").agg(F.collect_list(F.struct("word", "n")).alias("found"))
        found = names.join(known, "name", "left")

    def make_words():
        bayes = per_worker(("bayes", repr(given)), lambda: NaiveBayes(*given))

        def step(names, founds):
            words = [bayes.split(n, {x["word"]: x["n"] for x in f or ()}, total) for n, f in zip(names.to_pylist(), founds.to_pylist(), strict=True)]
            return names, words, [bayes.score(w) for w in words]

        return step

    return map_batches(found, ["name", "found"], make_words, "name string, words array<string>, odds double", [("name", pa.string()), ("words", pa.list_(pa.string())), ("odds", pa.float64())])


def judge(pages: DataFrame, documents: DataFrame | None = None, rules: list[tuple[str, str]] | None = None, blocked: list[str] | None = None, allowed: list[str] | None = None, threshold: float = 0.5, id_col: str = "page_id", url_col: str = "url", text_col: str = "text") -> DataFrame:
    """Per row: the id column, host, path, rule (null where none fits), verdict (allow or block), block_probability and
    words (those the classifier saw); the last two are null where a rule decides."""
    rules = rules if rules is not None else RULES
    given = (blocked if blocked is not None else BLOCKED, allowed if allowed is not None else ALLOWED)

    def make_rules():
        table = per_worker(("rules", repr(rules)), lambda: Rules(rules))

        def step(ids, urls):
            parts = [host_path(u) for u in urls.to_pylist()]
            found = [table.find(*p) for p in parts]
            return ids, *(list(x) for x in zip(*parts, strict=True)), *(list(x) for x in zip(*found, strict=True))

        return step

    rows = map_columns(pages, [id_col, url_col], make_rules, [("i", type_of(pages, id_col)), ("host", "string"), ("path", "string"), ("rule", "string"), ("ruled", "string")])

    def make_names():
        def step(hosts, paths):
            found = [names_of(h, p) for h, p in zip(hosts.to_pylist(), paths.to_pylist(), strict=True)]
            return hosts, paths, found

        return step

    free = rows.where("rule is null").select("host", "path").distinct()
    free = map_batches(free, ["host", "path"], make_names, "host string, path string, names array<string>", [("host", pa.string()), ("path", pa.string()), ("names", pa.list_(pa.string()))])
    each = free.select("host", "path", F.posexplode("names").alias("at", "name"))
    known = words_of(each.select("name").distinct(), word_counts(documents, text_col) if documents is not None else None, given)
    known = known.withColumn("salt", F.explode(F.array(*map(F.lit, range(SALTS)))))
    each = each.withColumn("salt", F.pmod(F.xxhash64("host", "path"), F.lit(SALTS)).cast("int"))
    scored = each.join(known, ["name", "salt"]).groupBy("host", "path").agg(F.sum("odds").alias("odds"), F.flatten(F.sort_array(F.collect_list(F.struct("at", "words")))["words"]).alias("words"))
    prior = math.log(PRIOR / (1 - PRIOR))
    free_row = F.col("rule").isNull()
    p = F.when(free_row, 1 / (1 + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), F.lit(prior) + F.coalesce("odds", F.lit(0.0)))))))
    out = rows.join(scored, ["host", "path"], "left").withColumn("p", p)
    verdict = F.coalesce("ruled", F.when(F.col("p") > threshold, "block").otherwise("allow"))
    words = F.when(free_row, F.coalesce("words", F.expr("cast(array() as array<string>)")))
    return out.select("i", "host", "path", "rule", verdict.alias("verdict"), "p", words.alias("words")).toDF(id_col, "host", "path", "rule", "verdict", "block_probability", "words")
