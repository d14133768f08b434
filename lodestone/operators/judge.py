"""The judge's side of an evaluation: prompts from cases, replies and spans, and verdicts from what it answers."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions.text import case_turns, judge_cut, trimmed


@dataclass(frozen=True)
class Wording:
    """The words around a prompt's parts."""

    opening: str = 'Grade the assistant\'s last reply from 1 to 5 (5 is best). Answer with JSON only: {"score": <1-5>, "reasoning": "<short>"}'
    question: str = "Question: "
    turns: str = "Turns of one conversation, in order:"
    turn: str = "Turn "
    last: str = " (graded)"
    rubric: str = "Rubric: "
    expected: str = "The reply should state:"
    forbidden: str = "The reply should not state:"
    reply: str = "Reply: "
    spans: str = "Steps taken (states only):"


def _bullets(head: str, facts: Column) -> Column:
    lines = F.array_join(F.transform(facts, lambda f: F.concat(F.lit("- "), f, F.lit("\n"))), "")
    return F.when(F.size(facts) > 0, F.concat(F.lit(head + "\n"), lines, F.lit("\n"))).otherwise("")


def prompts(cases: DataFrame, replies: DataFrame, spans: DataFrame, words: Wording = Wording()) -> DataFrame:
    """``name, prompt`` for each case.

    cases: ``name, prompt, turns, rubric, expected_facts, forbidden_facts``; replies: ``name,
    reply``; spans: ``name, started_at, id, kind, label, status, input, output``.  Spans go by
    start and id, their input and output cut for the judge and left out where blank.  A case
    without turns has its prompt as the only one; without a reply or spans these parts are empty.
    """
    turns = case_turns(F.col("prompt"), F.col("turns"))
    n = F.size(turns)
    listed = F.transform(turns, lambda t, i: F.concat(F.lit(words.turn), (i + 1).cast("string"), F.when(i == n - 1, words.last).otherwise(""), F.lit(": "), t, F.lit("\n")))
    asked = F.when(n == 1, F.concat(F.lit(words.question), F.get(turns, F.lit(0)), F.lit("\n\n"))).otherwise(F.concat(F.lit(words.turns + "\n"), F.array_join(listed, ""), F.lit("\n")))
    line = F.concat(F.lit("- ["), F.coalesce("kind", F.lit("")), F.lit("] "), F.coalesce("label", F.lit("")), F.lit(" status="), F.coalesce("status", F.lit("")), F.lit("\n"))
    for field in ("input", "output"):
        short = judge_cut(F.coalesce(field, F.lit("")))
        line = F.concat(line, F.when(short != "", F.concat(F.lit(f"  {field}: "), short, F.lit("\n"))).otherwise(""))
    steps = spans.select("name", F.struct("started_at", "id", line.alias("line")).alias("s")).groupBy("name").agg(F.array_sort(F.collect_list("s")).alias("steps"))
    own = cases.join(replies.select("name", "reply"), "name", "left").join(steps, "name", "left")
    parts = [F.lit(words.opening + "\n\n"), asked, F.lit(words.rubric), F.coalesce("rubric", F.lit("")), F.lit("\n\n"), _bullets(words.expected, F.col("expected_facts")), _bullets(words.forbidden, F.col("forbidden_facts"))]
    parts += [F.lit(words.reply), F.coalesce("reply", F.lit("")), F.lit(f"\n\n{words.spans}\n"), F.coalesce(F.array_join(F.transform("steps", lambda s: s["line"]), ""), F.lit(""))]
    return own.select("name", F.concat(*parts).alias("prompt"))


def bare_json(reply: Column) -> Column:
    """The reply without a fence of three backquotes (and ``json``) around it, trimmed."""
    own = trimmed(reply)
    inside = F.regexp_replace(F.regexp_replace(own, "^```(json)?", ""), "```$", "")
    return trimmed(F.when(own.startswith("```"), inside).otherwise(own))


def verdicts(replies: DataFrame) -> DataFrame:
    """``name, score, reasoning, problem`` of ``name, answer``: a whole score from 1 to 5, or why there is none."""
    v = F.try_parse_json(bare_json(F.coalesce("answer", F.lit(""))))
    given = F.try_variant_get(v, "$.score", "double")
    score = F.when(given.between(1, 5) & (given == F.floor(given)), given.cast("int"))
    kind = F.schema_of_variant(F.coalesce(v, F.parse_json(F.lit("null"))))
    problem = F.when(v.isNull() | ~kind.startswith("OBJECT"), "no JSON object").when(given.isNull() | (given != F.floor(given)), "no whole score").when(score.isNull(), "score out of range")
    reasoning = F.when(score.isNotNull(), F.coalesce(F.try_variant_get(v, "$.reasoning", "string"), F.lit("")))
    return replies.select("name", score.alias("score"), reasoning.alias("reasoning"), problem.alias("problem"))
