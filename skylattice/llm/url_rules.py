"""URL filters: list rules by host suffix and path prefix, and pattern rules indexed by their rarest literal token.

A pattern rule is written with `||` (start of a host label), `|` (start or end of the url), `^` (a separator or the end) and
`*` (anything). Its literal tokens are the alphanumeric runs that any matching url has as whole tokens. The rule is filed
under the one of them that is rarest in the urls at hand. A url's tokens fetch the rules filed under them, and only those
rules' regular expressions run. Rules without a literal token are always tried.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_TOKEN = re.compile(r"[a-z0-9]+")
_RUN = re.compile(r"[a-z0-9]+|\|\||[\^*|]|[^a-z0-9^*|]")

#: (host, path, verdict); the longest that fits decides.
LIST_RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]
#: (pattern, verdict) of urls that no list rule covers; an allow pattern overrides the block patterns.
PATTERN_RULES = [
    ("||ads-track.", "block"), ("||ads.", "block"), ("||doubleclick.", "block"), ("/banner/*/ad^", "block"), ("^popunder^", "block"),
    ("^casino^", "block"), ("^porn^", "block"), ("^xxx^", "block"), ("?utm_source=feed|", "block"), ("^affiliate^id=", "block"),
    ("/tracking/pixel.", "block"), ("||*-track.*/en/", "block"), ("/about/|", "allow"), ("^robots.txt|", "allow"),
]


@dataclass(frozen=True)
class Pattern:
    text: str
    verdict: str

    @property
    def regex(self) -> str:
        """Over the lower-cased url; without back references or look-around, so that SQL engines run it as well."""
        special = {"||": r"^[a-z][a-z0-9+.-]*://([^/?#]*\.)?", "|": "", "^": r"([^a-z0-9_.%-]|$)", "*": ".*"}
        parts = _RUN.findall(self.text.lower())
        out = "".join(special[p] if p in special else re.escape(p) for p in parts)
        return ("^" if parts[0] == "|" else "") + out + ("$" if parts[-1] == "|" and len(parts) > 1 else "")

    @property
    def tokens(self) -> set[str]:
        """Runs that stand between literal separators or anchors on both sides."""
        parts = _RUN.findall(self.text.lower())
        edge = lambda i: 0 <= i < len(parts) and parts[i] != "*"
        return {p for i, p in enumerate(parts) if _TOKEN.fullmatch(p) and edge(i - 1) and edge(i + 1)}


def patterns(rules: Sequence[tuple[str, str]] = PATTERN_RULES) -> list[Pattern]:
    return [Pattern(*r) for r in rules]


def host_and_path(url: str | None) -> tuple[str, str]:
    """Both empty for a null or a text without ://; A-Z of the host are lower-cased."""
    head, sep, rest = (url or "").partition("://")
    if not sep:
        return "", ""
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), path


def _ascii_lower(url: str) -> str:
    return url.lower() if url.isascii() else "".join(c.lower() if "A" <= c <= "Z" else c for c in url)


class ListRules:
    """The list rules by host; a url looks up its host and each parent domain."""

    def __init__(self, rules: Sequence[tuple[str, str, str]]):
        self.by_host: dict[str, list[tuple[str, str]]] = defaultdict(list)
        for host, path, verdict in rules:
            self.by_host[host].append((path, verdict))

    def find(self, host: str, path: str) -> tuple[str, str] | None:
        """The longest fitting rule: by its whole text host + path, a block before an allow of equal text."""
        labels, best = host.split(".") if host else [], None
        for i in range(len(labels)):
            parent = ".".join(labels[i:])
            for prefix, verdict in self.by_host.get(parent, ()):
                if path.startswith(prefix):
                    best = max(best or (0, False, "", ""), (len(parent + prefix), verdict == "block", parent + prefix, verdict))
        return best and best[2:]


def token_counts(urls: DataFrame, wanted: set[str]) -> Counter:
    """How many urls have each of the rules' literal tokens; at most one row for each token of the rules."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for batch in batches:
            for url in batch.column(0).to_pylist():
                seen.update(wanted.intersection(_TOKEN.findall(_ascii_lower(url or ""))))
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], ["token", "n"])

    parts = urls.select(F.col("url").cast("string").alias("url")).mapInArrow(count, "token string, n long")
    return Counter({r[0]: r[1] for r in parts.groupBy("token").agg(F.sum("n")).collect()})


class PatternIndex:
    def __init__(self, rules: Sequence[Pattern], counts: Counter):
        self.rules = [(re.compile(r.regex), r) for r in rules]
        self.filed: dict[str | None, list[int]] = defaultdict(list)
        for i, r in enumerate(rules):
            self.filed[min(r.tokens, key=lambda t: (counts[t], t), default=None)].append(i)

    def find(self, url: str) -> Pattern | None:
        """The first fitting allow pattern, else the first fitting block pattern."""
        url = _ascii_lower(url)
        tried = sorted(i for t in {None, *_TOKEN.findall(url)} for i in self.filed.get(t, ()))
        fits = [self.rules[i][1] for i in tried if self.rules[i][0].search(url)]
        return next((r for r in fits if r.verdict == "allow"), fits[0] if fits else None)


def judge_urls(urls: DataFrame, id_column: str = "page_id", list_rules: Sequence[tuple[str, str, str]] = LIST_RULES,
               pattern_rules: Sequence[tuple[str, str]] = PATTERN_RULES) -> DataFrame:
    """One row per row of `urls` (id, url): id, host, path, rule, pattern, verdict.

    A list rule's verdict comes first, then a pattern's, else allow. Null and malformed urls have an empty host and path,
    no list rule, and are judged by the patterns as an empty or plain text. Repeated rows are judged one by one; other
    columns are ignored. An empty table gives an empty result.
    """
    rules = patterns(pattern_rules)
    index = PatternIndex(rules, token_counts(urls, {t for r in rules for t in r.tokens}))
    listed = ListRules(list_rules)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for url in batch.column(1).to_pylist():
                host, path = host_and_path(url)
                rule = listed.find(host, path)
                pattern = None if rule else index.find(url or "")
                rows.append((host, path, rule and rule[0], pattern and pattern.text, rule[1] if rule else pattern.verdict if pattern else "allow"))
            cols = list(zip(*rows, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.string()) for c in cols)], [id_column, "host", "path", "rule", "pattern", "verdict"])

    source = urls.select(F.col(id_column).cast("long"), F.col("url").cast("string").alias("url"))
    return source.mapInArrow(judge, f"`{id_column}` long, host string, path string, rule string, pattern string, verdict string")
