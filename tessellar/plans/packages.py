"""Deterministic parts around language models: packages of evidence, budgets, numbered answers.

Calls to a model are an adapter's business; nothing here uses a network.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def evidence_package(themes: DataFrame, evidence: DataFrame, most: int = 20) -> DataFrame:
    """One prompt text a theme: name, scores and its best evidence lines, numbered."""
    from pyspark.sql import Window

    order = Window.partitionBy("theme_slug").orderBy(F.desc("confidence"), "doc_id", "context")
    top = evidence.withColumn("__r", F.row_number().over(order)).filter(F.col("__r") <= most)
    lines = top.groupBy("theme_slug").agg(F.array_sort(F.collect_list(F.struct("__r", "context"))).alias("l"))
    text = F.array_join(F.transform("l", lambda x: F.concat(x["__r"].cast("string"), F.lit(". "), x["context"])), "\n")
    rows = themes.join(lines, "theme_slug", "left")
    head = F.concat(F.lit("Theme: "), "theme_slug", F.lit("\nStrength: "), F.format_number("strength", 1), F.lit("\nConviction: "), "conviction", F.lit("\nEvidence:\n"))
    return rows.select("theme_slug", F.concat(head, F.coalesce(text, F.lit("none"))).alias("package"))


def numbered_batches(names: list[str], size: int = 40) -> list[str]:
    """Prompt bodies of at most ``size`` numbered names."""
    return ["\n".join(f"{i}. {n}" for i, n in enumerate(names[at : at + size], 1)) for at in range(0, len(names), size)]


def parse_numbered(answer: str, count: int) -> list[str | None]:
    """The text after each number 1 to ``count``; None where the answer has no such line."""
    found: dict[int, str] = {}
    for m in re.finditer(r"(?m)^\s*(\d+)[.):]\s*(.+?)\s*$", answer):
        found.setdefault(int(m[1]), m[2])
    return [found.get(i) for i in range(1, count + 1)]


class Budget:
    """Daily limit of calls with a response cache; the call itself is passed in."""

    def __init__(self, per_day: int):
        self.per_day, self.used, self.cache = per_day, {}, {}

    def ask(self, prompt: str, day: str, call: Callable[[str], str]) -> str | None:
        """The cached or new answer; None beyond the day's limit."""
        key = hashlib.sha256(prompt.encode()).hexdigest()
        if key in self.cache:
            return self.cache[key]
        if self.used.get(day, 0) >= self.per_day:
            return None
        self.used[day] = self.used.get(day, 0) + 1
        self.cache[key] = call(prompt)
        return self.cache[key]
