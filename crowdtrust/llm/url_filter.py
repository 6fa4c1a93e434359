"""URL filters: allow and block rules, then a vocabulary of strict and soft terms.

A rule names a host and the beginning of a path; it fits that host and all its
subdomains, and the longest fitting rule gives the verdict.  Where no rule
fits, one Aho-Corasick pass over the url lists the terms in it that stand
alone: the characters on both sides are no letters or digits.  A url with one
strict term, or with several different soft ones, is blocked.

Narrow: no shuffle.  What each worker holds are the rules and the terms, which
the caller gives as lists of checked size.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import per_process, small_batches

#: (verdict, host, beginning of the path). Fixed values of the query.
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
#: A url with one of these is blocked.
STRICT = ("casino", "cialis", "escorts", "gambling", "hentai", "malware", "phishing", "porn", "porno", "spam", "viagra", "warez", "xxx")
#: One of these says little; a url with ``SEVERAL`` different ones is blocked.
SOFT = ("ads", "adult", "bet", "bets", "betting", "bonus", "cams", "cheap", "clicks", "crack", "dating", "discount", "farm", "free", "hot",
        "jackpot", "keygen", "loan", "loans", "naked", "nude", "pharmacy", "pills", "poker", "popup", "prize", "sex", "sexy", "slots", "track",
        "tracker", "win", "x")
SEVERAL = 2
#: Most rules, and most characters of all terms together: both lists are copied to every worker.
MAX_RULES, MAX_TERM_CHARS = 1_000_000, 4_000_000

SCHEMA = "page_id long, host string, path string, rule string, verdict string, strict_hits array<string>, soft_hits array<string>"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_FOLD = str.maketrans(_UPPER, _LOWER)
_APART = frozenset(map(chr, range(0x80))) - frozenset(_LOWER + "0123456789")


class Rules:
    """Rules by host; the longest that fits a host and path is found by
    looking up the host and what follows each of its dots."""

    def __init__(self, rules: Iterable[tuple[str, str, str]]):
        self.by_host: dict[str, list[tuple[str, str]]] = {}
        for verdict, host, path in rules:
            self.by_host.setdefault(host, []).append((path, verdict))
        for paths in self.by_host.values():
            paths.sort(key=lambda p: (-len(p[0]), p[1] != "block"))

    def fitting(self, host: str, path: str) -> tuple[str, str] | None:
        """(rule, verdict).  Of equally long ones that with the longer host; of
        equal ones with different verdicts, block."""
        best, size = None, -1
        at = 0
        while True:
            own = host[at:]
            for start, verdict in self.by_host.get(own, ()):
                if path.startswith(start):
                    if len(own) + len(start) > size:
                        best, size = (own + start, verdict), len(own) + len(start)
                    break
            at = host.find(".", at) + 1
            if not at:
                return best


class Vocabulary:
    def __init__(self, strict: Iterable[str], soft: Iterable[str]):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for kind, terms in ((1, soft), (0, strict)):  # a term in both lists is strict
            for t in terms:
                self.automaton.add_word(t, (kind, t))
        if len(self.automaton):
            self.automaton.make_automaton()

    def hits(self, url: str) -> tuple[list[str], list[str]]:
        """The different strict and soft terms that stand alone in the url, sorted."""
        if not len(self.automaton):
            return [], []
        low = url.translate(_FOLD)
        found: tuple[set, set] = set(), set()
        for end, (kind, term) in self.automaton.iter(low):
            start = end - len(term)
            if (start < 0 or low[start] in _APART) and (end + 1 == len(low) or low[end + 1] in _APART):
                found[kind].add(term)
        return sorted(found[0]), sorted(found[1])


def judge(pages: DataFrame, rules=RULES, strict=STRICT, soft=SOFT, several: int = SEVERAL, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """page_id, host, path, rule, verdict, strict_hits, soft_hits, one row per input row.

    host: what follows the first ``://`` up to ``/``, ``?``, ``#`` or the end,
    A-Z lower-cased; path: from there up to ``?``, ``#`` or the end; both are
    empty where the url is null or has no ``://``.  rule: the longest fitting
    rule as host and path, null if none fits.  verdict: the rule's, else block
    where the url holds a strict term or ``several`` different soft ones, else
    allow.  Terms are looked for in the whole url, A-Z as a-z; ASCII letters,
    digits and all characters beyond ASCII are no boundary of a term.

    A null url has no terms and is allowed; a null id stays null; repeated
    rows give repeated rows; urls may be of any length; an empty table gives
    an empty one; other columns are not read.

    ``rules``: (verdict, host, path) with lower-case hosts, at most
    ``MAX_RULES``; ``strict``, ``soft``: lower-case terms of at most
    ``MAX_TERM_CHARS`` characters together.
    """
    rules, strict, soft = tuple(map(tuple, rules)), tuple(strict), tuple(soft)
    if len(rules) > MAX_RULES or sum(map(len, strict + soft)) > MAX_TERM_CHARS:
        raise ValueError("the rules or terms are too many to be copied to every worker")
    if bad := [r for r in rules if r[0] not in ("allow", "block")]:
        raise ValueError(f"verdict must be allow or block: {bad[0]}")
    if "" in strict + soft:
        raise ValueError("an empty term stands nowhere")
    spark = pages.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast((rules, strict, soft))
    kept = ("urls", hashlib.sha256(repr((rules, strict, soft)).encode()).hexdigest())
    url = F.coalesce(F.col(url_col).cast("string"), F.lit(""))
    rows = pages.select(
        F.col(id_col).cast("long").alias("page_id"), url.alias("url"),
        F.translate(F.regexp_extract(url, "(?s)^.*?://([^/?#]*)", 1), _UPPER, _LOWER).alias("host"),
        F.regexp_extract(url, "(?s)^.*?://[^/?#]*([^?#]*)", 1).alias("path"))

    def run(batches):
        import pyarrow as pa

        def build():
            r, hard, mild = shared.value
            return Rules(r), Vocabulary(hard, mild)

        own, words = per_process(kept, build)
        for batch in batches:
            out = []
            for url, host, path in zip(*(batch.column(c).to_pylist() for c in ("url", "host", "path")), strict=True):
                rule, verdict = own.fitting(host, path) or (None, None)
                hard, mild = words.hits(url)
                out.append((rule, verdict or ("block" if hard or len(mild) >= several else "allow"), hard, mild))
            rule, verdict, hard, mild = zip(*out, strict=True) if out else ((), (), (), ())
            yield pa.RecordBatch.from_arrays([
                *(batch.column(c) for c in ("page_id", "host", "path")), pa.array(rule, pa.string()), pa.array(verdict, pa.string()),
                pa.array(hard, pa.list_(pa.string())), pa.array(mild, pa.list_(pa.string()))],
                names=["page_id", "host", "path", "rule", "verdict", "strict_hits", "soft_hits"])

    return rows.mapInArrow(run, SCHEMA)
