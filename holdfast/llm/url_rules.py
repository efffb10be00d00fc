"""URL filtering by host and path rules: a sort-merge range join on reversed-host keys.

A host is turned around (``www.example.org`` becomes ``org.example.www.``), so that a rule's host and
all its subdomains are one interval of keys, nested in the interval of every shorter rule host. In
each batch of pages the distinct keys are sorted and merged with the sorted intervals; a stack keeps
the rule hosts that are open at the current key. The paths below each rule host are swept in the same
way: a path prefix is an interval of paths, and the top of the stack is the longest rule that fits.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

RULES_AT_ONCE = 100_000  # the most rules that go to the executors in one pass

Rule = tuple[str, str, str]  # host, path prefix, verdict

ANSWER = T.StructType([T.StructField("rule", T.StringType()), T.StructField("verdict", T.StringType())])


def url_host(url: str | Column) -> Column:
    """What follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without ``://``."""
    host = F.regexp_extract(F.coalesce(F.col(url) if isinstance(url, str) else url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def url_path(url: str | Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; empty without ``://``."""
    return F.regexp_extract(F.coalesce(F.col(url) if isinstance(url, str) else url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def reversed_host(host: str) -> str:
    return ".".join(reversed(host.split("."))) + "."


def open_prefixes(keys: Sequence[str], prefixes: Sequence[str]) -> list[list[str]]:
    """For each key of a sorted list, the prefixes (sorted too) that it starts with, shortest first.

    One merge of both lists. A prefix opens at its own place and closes at the first key that does not
    start with it; prefixes open at the same time are nested, so they form a stack.
    """
    stack: list[str] = []
    at, out = 0, []
    for key in keys:
        while at < len(prefixes) and prefixes[at] <= key:
            while stack and not prefixes[at].startswith(stack[-1]):
                stack.pop()
            stack.append(prefixes[at])
            at += 1
        while stack and not key.startswith(stack[-1]):
            stack.pop()
        out.append(list(stack))
    return out


def judge(hosts: pd.Series, paths: pd.Series, rules: Sequence[Rule]) -> list[tuple[int, str] | None]:
    """The longest fitting rule of each page: (length, index of the rule) or None."""
    by_host: dict[str, dict[str, int]] = {}
    for i, (host, path, _) in enumerate(rules):
        by_host.setdefault(reversed_host(host), {}).setdefault(path, i)
    keys = hosts.map(reversed_host)
    distinct = sorted(set(keys))
    chains = dict(zip(distinct, open_prefixes(distinct, sorted(by_host)), strict=True))
    below: dict[str, set[str]] = {}
    for key, path in zip(keys, paths, strict=True):
        for rule_host in chains[key]:
            below.setdefault(rule_host, set()).add(path)
    fits: dict[tuple[str, str], str] = {}
    for rule_host, found in below.items():
        ordered = sorted(found)
        for path, stack in zip(ordered, open_prefixes(ordered, sorted(by_host[rule_host])), strict=True):
            if stack:
                fits[rule_host, path] = stack[-1]
    best: list[tuple[int, str] | None] = []
    for key, path in zip(keys, paths, strict=True):
        top = None
        for rule_host in chains[key]:
            if (prefix := fits.get((rule_host, path))) is not None:
                i = by_host[rule_host][prefix]
                length = len(rules[i][0]) + len(rules[i][1])
                if top is None or length >= top[0]:  # at equal length the more specific host
                    top = (length, i)
        best.append(top)
    return best


def url_verdicts(pages: DataFrame, rules: Sequence[Rule], url: str = "url", default: str = "allow") -> DataFrame:
    """``pages`` with ``host``, ``path``, ``rule`` and ``verdict``; columns of these names are replaced.

    A rule (host, path, verdict) fits its host and all subdomains if the page's path starts with the
    rule's; the longest rule wins, at equal length the one with the longer host, and of equal rules
    the first. A page that no rule fits gets a missing rule and the ``default`` verdict. A missing url,
    or one without ``://``, has an empty host and path; an empty host is below no rule. Repeated pages
    are judged alike; an empty table gives an empty result.

    The pages are neither shuffled nor collected, so a host with a third of all pages does no harm.
    Rules go to the executors ``RULES_AT_ONCE`` at a time; longer lists take further passes, of which
    the longest answer is kept.
    """
    out = pages.withColumns({"host": url_host(url), "path": url_path(url)})

    def answer(start: int) -> Column:
        part = list(rules[start : start + RULES_AT_ONCE])

        @F.pandas_udf("length int, host_length int, before long, rule string, verdict string")
        def fitting(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
            for hosts, paths in batches:
                found = []
                for f in judge(hosts, paths, part):
                    host, path, verdict = part[f[1]] if f else ("", "", default)
                    found.append((f[0], len(host), -(start + f[1]), host + path, verdict) if f else (-1, -1, 1, None, default))
                yield pd.DataFrame(found, columns=["length", "host_length", "before", "rule", "verdict"])

        return fitting("host", "path")

    answers = [answer(start) for start in range(0, max(1, len(rules)), RULES_AT_ONCE)]
    best = F.greatest(*answers) if len(answers) > 1 else answers[0]
    return out.withColumn("_found", best).withColumns({"rule": F.col("_found.rule"), "verdict": F.col("_found.verdict")}).drop("_found")
