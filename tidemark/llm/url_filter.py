"""URL filter: host/path rules, then a weighted vocabulary matched by an Aho-Corasick automaton.

A URL is lower-cased (A-Z) and scanned once by the automaton; a hit counts only where neither neighbour is an ASCII
letter or digit. One strict term rejects, and so do at least ``min_soft`` distinct soft terms whose weights add up to
the threshold. Explicit rules are stronger: the longest rule that fits decides, and the vocabulary judges the rest.

The vocabulary is a parameter: :func:`load_vocabulary` reads one from a table of terms, and :func:`forms` makes the
default one, some thousand terms with weights between 0.25 and 1.5, from stems.

Defined results: a null URL, an empty URL or one without ``://`` has empty host and path, fits no rule, and is judged
by the vocabulary alone (null: nothing to find, so ``allow``). URLs of any length are scanned whole. Of rules that tie
in length the one with the longer host counts, then the blocking one; a term that is both strict and soft is strict.
Repeated rows are judged one by one; an empty table gives no rows; other columns of the input, whatever their names, are
kept out of the way.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from dataclasses import dataclass, field
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
_WORD = frozenset("abcdefghijklmnopqrstuvwxyz0123456789")

#: Terms of a vocabulary at most; it is held by the driver and every task.
MOST_TERMS = 1_000_000

# The stems of the default vocabulary, the weights of soft ones, and what may follow a stem.
STRICT_STEMS = ("porn", "xxx", "casino", "warez", "adult", "escort", "viagra", "malware", "phishing", "spam")
SOFT_STEMS = {"free": 0.75, "bets": 1.25, "bet": 1.25, "cheap": 0.75, "pills": 1.5, "win": 1.0, "ads": 1.25, "track": 0.75, "farm": 0.75, "poker": 1.5, "loan": 1.25, "dating": 1.25, "deal": 0.75, "click": 0.75, "bonus": 1.0, "seo": 1.0}
ENDINGS = ("", "s", "hub", "zone", "club", "site", "online", "world", "shop", "store", "24", "4u")


def forms(stem: str) -> dict[str, float]:
    """A stem with each ending, and with the numbers 0 to 99, which count half."""
    return {stem + e: 1.0 for e in ENDINGS} | {f"{stem}{k}": 0.5 for k in range(100) if str(k) not in ENDINGS}


STRICT = tuple(dict.fromkeys(stem + e for stem in STRICT_STEMS for e in ENDINGS))
SOFT: dict[str, float] = {}
for _stem, _weight in SOFT_STEMS.items():
    for _term, _share in forms(_stem).items():
        SOFT[_term] = max(SOFT.get(_term, 0.0), _weight * _share)


def load_vocabulary(terms: DataFrame, most: int = MOST_TERMS) -> tuple[tuple[str, ...], dict[str, float]]:
    """(strict, soft) from a table with the columns ``term`` and ``weight``, such as a tab-separated file of them; no
    weight is strict. Nulls and empty terms are passed over; of several weights of a term the largest counts, and strict
    is stronger than any."""
    rows = terms.where("term IS NOT NULL AND term != ''").groupBy(F.translate("term", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz").alias("term"))
    rows = rows.agg(F.max(F.col("weight").cast("double")).alias("weight"), F.max(F.col("weight").isNull()).alias("strict")).limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} terms")
    return tuple(sorted(r.term for r in rows if r.strict)), {r.term: r.weight for r in sorted(rows) if not r.strict}


@dataclass(frozen=True)
class UrlRule:
    host: str
    path: str
    allow: bool

    @property
    def text(self) -> str:
        return self.host + self.path


def parse_rules(allow: Iterable[str], block: Iterable[str]) -> tuple[UrlRule, ...]:
    """Rules written as ``host/path``; the host ends at the first slash."""
    made = []
    for texts, ok in ((allow, True), (block, False)):
        for text in texts:
            host, slash, rest = text.partition("/")
            made.append(UrlRule(host.translate(_UPPER), slash + rest, ok))
    return tuple(made)


@dataclass(frozen=True)
class UrlPolicy:
    rules: tuple[UrlRule, ...] = ()
    strict: tuple[str, ...] = STRICT
    soft: Mapping[str, float] = field(default_factory=lambda: dict(SOFT))
    soft_threshold: float = 2.0
    min_soft: int = 2

    def key(self) -> tuple:
        return self.rules, tuple(self.strict), tuple(sorted(self.soft.items())), self.soft_threshold, self.min_soft


def split_url(url: str | None) -> tuple[str, str]:
    """Lower-cased host and path as written."""
    _, mark, rest = (url or "").partition("://")
    if not mark:
        return "", ""
    end = min((i for i in map(rest.find, "?#") if i >= 0), default=len(rest))
    host, slash, path = rest[:end].partition("/")
    return host.translate(_UPPER), slash + path


class _Judge:
    def __init__(self, key: tuple):
        import ahocorasick

        rules, strict, soft, self.threshold, self.min_soft = key
        strict = tuple(dict.fromkeys(t.translate(_UPPER) for t in strict))
        known = set(strict)
        self.by_host: dict[str, list[UrlRule]] = {}
        for rule in sorted(rules, key=lambda r: (-len(r.text), -len(r.host), r.allow)):
            self.by_host.setdefault(rule.host, []).append(rule)
        self.machine = ahocorasick.Automaton()
        for term, weight in [*((t, None) for t in strict), *((t.translate(_UPPER), w) for t, w in soft if t.translate(_UPPER) not in known)]:
            self.machine.add_word(term, (term, weight))
        if len(self.machine):
            self.machine.make_automaton()

    def rule(self, host: str, path: str) -> UrlRule | None:
        fits, suffix = [], host
        while suffix:
            fits += [r for r in self.by_host.get(suffix, ()) if path.startswith(r.path)][:1]
            suffix = suffix.partition(".")[2]
        return min(fits, key=lambda r: (-len(r.text), -len(r.host), r.allow), default=None)

    def hits(self, url: str) -> tuple[list[str], list[str], float]:
        strict, soft = set(), {}
        text = url.translate(_UPPER)
        if len(self.machine):
            for last, (term, weight) in self.machine.iter(text):
                first = last - len(term) + 1
                if (first and text[first - 1] in _WORD) or (last + 1 < len(text) and text[last + 1] in _WORD):
                    continue
                if weight is None:
                    strict.add(term)
                else:
                    soft[term] = weight
        return sorted(strict), sorted(soft), float(sum(soft.values()))

    def __call__(self, url: str | None) -> dict:
        host, path = split_url(url)
        rule = self.rule(host, path)
        strict, soft, weight = self.hits(url or "")
        bad = bool(strict) or (len(soft) >= self.min_soft and weight >= self.threshold)
        return {
            "host": host, "path": path, "rule": rule.text if rule else None,
            "verdict": "allow" if (rule.allow if rule else not bad) else "block",
            "strict_terms": strict, "soft_terms": soft, "soft_weight": weight,
        }


@lru_cache(maxsize=8)
def _judge(key: tuple) -> _Judge:
    return _Judge(key)


_SCHEMA = "host string, path string, rule string, verdict string, strict_terms array<string>, soft_terms array<string>, soft_weight double"
_ARROW = pa.struct([("host", pa.string()), ("path", pa.string()), ("rule", pa.string()), ("verdict", pa.string()), ("strict_terms", pa.list_(pa.string())), ("soft_terms", pa.list_(pa.string())), ("soft_weight", pa.float64())])


def judge_url(url: Column, policy: UrlPolicy) -> Column:
    """A struct column with the judgement of each URL; one automaton for each Python worker."""
    key = policy.key()

    @F.arrow_udf(_SCHEMA)
    def judged(urls: pa.Array) -> pa.Array:
        judge = _judge(key)
        return pa.array([judge(u) for u in urls.to_pylist()], _ARROW)

    return judged(url)


def filter_urls(pages: DataFrame, policy: UrlPolicy, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """One row for each input row: its id and the fields of :func:`judge_url`."""
    return pages.select(F.col(id_col), judge_url(F.col(url_col), policy).alias("__tm_j")).select(id_col, "__tm_j.*")
