"""URL filters: pattern rules indexed by their rarest literal token.

Each rule is a regular expression with literal tokens that any URL it matches must contain whole. A rule
is filed under the one of its tokens that is rarest among the URLs. A URL's tokens fetch the candidate
rules; only those run their regular expressions. Rules without a literal token are always candidates.

Nulls and URLs without ``://`` have an empty host and path, match no host rule and get the default
verdict. Rows are judged one by one, so repeated rows, ties in ids and extra columns change nothing; an
empty table gives an empty result with the same columns.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from storyline.llm.common import ascii_lower

#: Rules go to the executors in chunks of at most so many characters of pattern; each chunk is one more pass
#: over the rows within the same stage, without a shuffle.
CHUNK_CHARS = 8_000_000

_TOKEN = re.compile("[a-z0-9]+")


@dataclass(frozen=True)
class Rule:
    """``name`` is what the result shows; of the matching rules the one with the greatest weight wins, then the least name."""

    name: str
    action: str
    pattern: str
    tokens: tuple[str, ...]
    weight: int


def host_rule(rule: str, action: str) -> Rule:
    """A rule ``host/path``: the host and all its subdomains, paths that start with the path."""
    host, slash, rest = rule.partition("/")
    path = slash + rest
    whole = _TOKEN.findall(host.lower()) + [m[0] for m in _TOKEN.finditer(path.lower()) if m.end() < len(path)]
    return Rule(rule, action, rf"\A(?:[^/]*\.)?{re.escape(host)}" + (re.escape(path) or r"(?=/|\Z)"), tuple(whole), len(rule))


def word_rule(word: str, action: str) -> Rule:
    """A rule on one word of the host, between characters that are neither letters nor digits."""
    return Rule(f"~{word}", action, rf"\A(?:[^/]*[^a-z0-9/])?{re.escape(word)}(?![a-z0-9])", (word,), -1)


class RuleIndex:
    """Rules by their rarest token."""

    def __init__(self, rules: list[Rule], frequency: dict[str, int]):
        self.rules = [(re.compile(r.pattern, re.DOTALL), r) for r in rules]
        self.by_token: dict[str, list[int]] = {}
        self.always: list[int] = []
        for i, r in enumerate(rules):
            if r.tokens:
                self.by_token.setdefault(min(r.tokens, key=lambda t: (frequency.get(t, 0), t)), []).append(i)
            else:
                self.always.append(i)

    def best(self, host: str, path: str) -> Rule | None:
        found = list(self.always)
        for t in set(_TOKEN.findall(f"{host} {path.lower()}")):
            found += self.by_token.get(t, ())
        text = host + path  # a host holds no slash, a path is empty or starts with one
        fits = [r for p, r in (self.rules[i] for i in found) if p.match(text)]
        return min(fits, key=lambda r: (-r.weight, r.name), default=None)


def host_of(url: Column) -> Column:
    rest = F.when(F.instr(url, "://") > 0, F.regexp_replace(url, r"(?s)\A.*?://", ""))
    return F.coalesce(ascii_lower(F.regexp_extract(rest, r"\A([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    rest = F.when(F.instr(url, "://") > 0, F.regexp_replace(url, r"(?s)\A.*?://", ""))
    return F.coalesce(F.regexp_extract(rest, r"\A[^/?#]*([^?#]*)", 1), F.lit(""))


def token_frequencies(urls: DataFrame, tokens: set[str]) -> dict[str, int]:
    """How many URLs hold each of the rules' tokens; as many rows as there are tokens in rules at most."""
    words = urls.select(F.explode(F.array_distinct(F.split(F.lower(F.concat_ws(" ", "host", "path")), "[^a-z0-9]+"))).alias("t"))
    return {r["t"]: r["n"] for r in words.where(F.col("t").isin(sorted(tokens))).groupBy("t").agg(F.count("*").alias("n")).collect()}


def _judge(rules: list[Rule], frequency: dict[str, int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = RuleIndex(rules, frequency)
        for b in batches:
            hosts, paths = b.column("host").to_pylist(), b.column("path").to_pylist()
            old = zip(b.column("rule_weight").to_pylist(), b.column("rule_name").to_pylist(), b.column("rule_action").to_pylist(), strict=True)
            out = []
            for host, path, (weight, name, action) in zip(hosts, paths, old, strict=True):
                r = index.best(host, path)
                if r is not None and (weight is None or (-r.weight, r.name) < (-weight, name)):
                    weight, name, action = r.weight, r.name, r.action
                out.append((weight, name, action))
            columns = {n: b.column(n) for n in b.schema.names}
            columns |= {"rule_weight": pa.array([x[0] for x in out], pa.int64()), "rule_name": pa.array([x[1] for x in out], pa.string()), "rule_action": pa.array([x[2] for x in out], pa.string())}
            yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    return run


def filter_urls(pages: DataFrame, rules: list[Rule], id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """One row a page: its id, host, path, the winning rule's name (null: none) and the verdict.

    Rules of negative weight belong to the method: they decide the verdict where no other rule fits but
    are not named in ``rule``.
    """
    urls = pages.select(F.col(id_col).alias("id"), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    tokens = {t for r in rules for t in r.tokens}
    frequency = token_frequencies(urls, tokens) if tokens else {}
    out = urls.select("*", F.lit(None).cast("long").alias("rule_weight"), F.lit(None).cast("string").alias("rule_name"), F.lit(None).cast("string").alias("rule_action"))
    chunk: list[Rule] = []
    for r in [*rules, None]:
        if chunk and (r is None or sum(len(x.pattern) for x in chunk) + len(r.pattern) > CHUNK_CHARS):
            own = {t: frequency.get(t, 0) for x in chunk for t in x.tokens}
            out = out.mapInArrow(_judge(chunk, own), out.schema)
            chunk = []
        if r is not None:
            chunk.append(r)
    return out.select(
        F.col("id").alias(id_col), "host", "path",
        F.when(F.col("rule_weight") >= 0, F.col("rule_name")).alias("rule"),
        F.coalesce("rule_action", F.lit(default)).alias("verdict"),
    )
