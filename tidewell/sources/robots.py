"""Robots rules: parsing, and verdicts on many URLs at once."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def parse_robots(text: str, agent: str) -> list[tuple[str, str]]:
    """(allow or disallow, pattern) of the group that names the agent, else of the one for all."""
    groups: dict[str, list[tuple[str, str]]] = {}
    names: list[str] = []
    in_rules = False
    for line in text.splitlines():
        key, _, value = line.split("#", 1)[0].partition(":")
        key, value = key.strip().lower(), value.strip()
        if key == "user-agent":
            if in_rules:
                names, in_rules = [], False
            names.append(value.lower())
            groups.setdefault(value.lower(), [])
        elif key in ("allow", "disallow"):
            in_rules = True
            if value:
                for n in names:
                    groups[n].append((key, value))
    own = [n for n in groups if n != "*" and n in agent.lower()]
    return groups[max(own, key=len)] if own else groups.get("*", [])


def pattern_regex(pattern: str) -> str:
    """A rule's pattern as a regular expression from the start of the path: * is anything, a last $ the end."""
    end = pattern.endswith("$")
    return "^" + ".*".join(map(re.escape, pattern.removesuffix("$").split("*"))) + ("$" if end else "")


def unread_verdict(status: int | None, allow_on_error: bool) -> bool:
    """What holds where there are no rules: 401, 403, 429, 5xx and no answer are unknown, other 4xx allow."""
    return allow_on_error if status is None or status in (401, 403, 429) or status >= 500 else True


def verdicts(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """urls' columns and allowed: the longest matching pattern decides, allow wins ties. urls: origin, path; rules: origin, kind, pattern, regex.

    An origin's rules (one robots file) are one row, so URLs aren't multiplied by rules, and a hot origin's URLs are a side that Spark can split.
    """
    one = F.struct("kind", F.length("pattern").alias("length"), "regex")
    of_origin = rules.groupBy("origin").agg(F.collect_list(one).alias("_rules"))
    longest = lambda kind: F.coalesce(F.array_max(F.transform(F.filter("_rules", lambda r: (r["kind"] == kind) & F.rlike("path", r["regex"])), lambda r: r["length"])), F.lit(-1))
    no, yes = longest("disallow"), longest("allow")
    joined = urls.join(of_origin, "origin", "left")
    return joined.withColumn("allowed", (no < 0) | (yes >= no)).select(*urls.columns, "allowed")
