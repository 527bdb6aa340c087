"""Evidence selection under a token budget: an ordered fold per prompt.

Each choice depends on what was taken before, so a prompt's candidates are streamed in order past a
few counters. Only sizes of texts pass there; the texts of what was taken are joined afterwards.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trovespark.functions.text import SNIPPET_MARK
from trovespark.operators.ordered import columns, folded
from trovespark.operators.ranking import first_wins

KNOWLEDGE = ("invariant", "convention")
TAKEN = columns(prompt_id="string", pos="integer", file="string", start_line="integer", end_line="integer", commit_hash="string", chunk_kind="string", is_seed="boolean", score="double", tokens="integer", degraded="boolean")


@dataclass(frozen=True)
class Budget:
    tokens: int = 8000
    overhead: float = 0.10
    bodies: int = 12
    neighbour_reserve: int = 4
    snippet_lines: int = 8
    knowledge_reserve: int = 2

    @property
    def usable(self) -> int:
        return int(self.tokens * (1 - self.overhead))

    @property
    def seed_cap(self) -> int:
        return max(self.bodies - self.neighbour_reserve, 1) if self.bodies > 0 and self.neighbour_reserve > 0 else self.bodies


class Taker:
    """The counters of one prompt; call it with its candidates in order."""

    def __init__(self, budget: Budget) -> None:
        self.budget, self.used, self.seeds, self.taken, self.reserve = budget, 0, 0, 0, budget.knowledge_reserve

    def __call__(self, r: dict) -> dict | None:
        """The candidate (chars, lines, head_chars, is_seed, chunk_kind, commit_hash, ...) with pos, tokens and whether its text is cut to its head; None if it isn't taken."""
        b = self.budget
        if self.taken == b.bodies > 0:
            return None
        knowledge = r["chunk_kind"] in KNOWLEDGE or (r["chunk_kind"] == "doc" and not r["commit_hash"])
        if r["is_seed"] and self.seeds >= b.seed_cap and not (knowledge and self.reserve > 0):
            return None
        if not knowledge and self.reserve > 0 and self.taken >= b.bodies - self.reserve:
            return None
        if not r["chars"]:
            return None
        tokens, degraded = r["chars"] // 4, False
        if self.used + tokens > b.usable:
            tokens, degraded = r["head_chars"] // 4, True
            if r["lines"] <= b.snippet_lines or self.used + tokens > b.usable:
                return None
        self.taken += 1
        self.used += tokens
        self.seeds += bool(r["is_seed"])
        self.reserve -= bool(knowledge and self.reserve > 0)
        return r | {"tokens": tokens, "degraded": degraded, "pos": self.taken}


def head(text: str, lines: int) -> str:
    return "\n".join(text.split("\n")[:lines]) + SNIPPET_MARK


def head_of(text: Column, lines: int) -> Column:
    return F.concat(F.substring_index(text, "\n", lines), F.lit(SNIPPET_MARK))


def choose(rows: list[dict], budget: Budget) -> list[dict]:
    """The candidates (with text) that fit, in order, with their text, tokens and whether the text was cut to its head."""
    out, take = [], Taker(budget)
    for r in rows:
        text = r["text"] or ""
        got = take(r | {"chars": len(text), "lines": text.count("\n") + 1, "head_chars": len(head(text, budget.snippet_lines))})
        if got:
            out.append(got | {"text": head(text, budget.snippet_lines) if got["degraded"] else text})
    return out


def allocate(candidates: DataFrame, bodies: DataFrame, budget: Budget = Budget()) -> DataFrame:
    """candidates (prompt_id, file, start_line, end_line, commit_hash, chunk_kind, is_seed, score) and bodies (file, start_line, end_line, text) to the selected bodies, with text, tokens and degraded."""
    key = ["file", "start_line", "end_line"]
    best = first_wins(candidates, ["prompt_id", *key], [F.desc("score"), F.desc("is_seed")])
    text = F.coalesce(F.col("text"), F.lit(""))
    sizes = bodies.select(*key, F.char_length(text).alias("chars"), (F.size(F.split(text, "\n"))).alias("lines"), F.char_length(head_of(text, budget.snippet_lines)).alias("head_chars"))
    sized = best.join(sizes, key, "left").withColumn("prompt_id", F.col("prompt_id").cast("string"))
    taken = folded(sized, "prompt_id", [F.desc("score"), *map(F.asc, key)], lambda: Taker(budget), TAKEN)
    whole = taken.join(bodies.select(*key, text.alias("text")), key)
    return whole.withColumn("text", F.when(F.col("degraded"), head_of(F.col("text"), budget.snippet_lines)).otherwise(F.col("text")))


def usage(selected: DataFrame, budget: Budget = Budget()) -> DataFrame:
    """(prompt_id, bodies, used_tokens, utilization, degraded) of each prompt."""
    return selected.groupBy("prompt_id").agg(
        F.count("*").alias("bodies"),
        F.sum("tokens").alias("used_tokens"),
        (F.sum("tokens") / F.lit(float(budget.usable))).alias("utilization"),
        F.count_if("degraded").alias("degraded"),
    )
