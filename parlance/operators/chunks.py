"""Cutting ordered lines to a token budget, with an overlap: sequential within a meeting, so a grouped map."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parlance.functions.text import tokens

#: What one pass may hold, what the prompt takes of it, what a chunk repeats of the one before.
SINGLE_PASS, PROMPT, OVERLAP = 4_000, 300, 100


def cuts(costs: list[int], whole: int, single_pass: int = SINGLE_PASS, overlap: int = OVERLAP) -> list[tuple[int, int]]:
    """(first, end) of each chunk, given the tokens of every line."""
    if whole <= single_pass:
        return [(0, len(costs))]
    budget, out, start = max(single_pass - PROMPT, 1), [], 0
    while start < len(costs):
        end = used = 0
        for end in range(start, len(costs) + 1):
            if end == len(costs) or (used + costs[end] + 1 > budget and end > start):
                break
            used += costs[end] + 1
        out.append((start, end))
        if end == len(costs):
            break
        back, carried = end, 0
        while back > start + 1 and carried < overlap:
            back -= 1
            carried += costs[back] + 1
        start = back
    return out


def chunked(lines: DataFrame, single_pass: int = SINGLE_PASS, overlap: int = OVERLAP) -> DataFrame:
    """(meeting, chunk, first, last, tokens, lines) of (meeting, sequence, line). Only lengths are ordered in Python."""
    costs = lines.select("meeting", "sequence", tokens(F.col("line")).alias("cost"), F.length("line").alias("size"))

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("sequence")
        cost, order = group["cost"].tolist(), group["sequence"].tolist()
        whole = int(np.float32(int(group["size"].sum()) + len(group)) * np.float32(0.35))
        rows = [(group["meeting"].iloc[0], i, order[a], order[b - 1], sum(cost[a:b]) + b - a) for i, (a, b) in enumerate(cuts(cost, whole, single_pass, overlap))]
        return pd.DataFrame(rows, columns=["meeting", "chunk", "first", "last", "tokens"])

    found = costs.groupBy("meeting").applyInPandas(run, "meeting long, chunk int, first long, last long, tokens long")
    inside = found.join(lines, "meeting").where("sequence >= first and sequence <= last")
    return inside.groupBy("meeting", "chunk", "first", "last", "tokens").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("sequence", "line"))), lambda s: s["line"]), "\n").alias("lines"))
