"""Context assembly: budgets, history, evidence."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.constants import CHARS_PER_TOKEN, DEFAULT_CONTEXT_TOKENS, OUTPUT_RESERVE, RAG_BUDGET_TOKENS, SCORE_FLOOR, TOOL_TOKENS

OPEN, CLOSE = "<retrieved_sources>\n", "</retrieved_sources>\n"


def total_budget(context_tokens: Column) -> Column:
    """Characters a request may have, by the model's context window (null: 4000 tokens without reserve)."""
    return F.when(context_tokens.isNull(), DEFAULT_CONTEXT_TOKENS).otherwise(F.greatest(F.lit(0), context_tokens - OUTPUT_RESERVE)) * CHARS_PER_TOKEN


def budgets(rows: DataFrame) -> DataFrame:
    """``context_tokens, system_len, tools, latest_len, rules_len, evidence_len`` to fixed, evidence cap and history budgets and a status."""
    fixed = total_budget(F.col("context_tokens")) - (F.col("system_len") + F.col("tools") * TOOL_TOKENS * CHARS_PER_TOKEN + F.col("latest_len"))
    cap = F.greatest(F.lit(0), F.least(F.lit(RAG_BUDGET_TOKENS * CHARS_PER_TOKEN), F.col("fixed")) - (len(OPEN) + len(CLOSE)) - F.col("rules_len"))
    own = rows.withColumn("fixed", fixed).withColumn("status", F.when(F.col("fixed") < 0, "over_budget").otherwise("ok"))
    return own.withColumn("evidence_cap", cap).withColumn("history", F.greatest(F.lit(0), F.col("fixed") - F.col("evidence_len")))


def recent_history(messages: DataFrame, keys: list[str], order: list[Column], length: Column, budget: int, rows: int = 200) -> DataFrame:
    """The newest messages whose lengths sum to at most ``budget``, stopping at the first that does not fit, of the newest ``rows``."""
    newest = Window.partitionBy(*keys).orderBy(*order)
    own = messages.withColumn("__n", F.row_number().over(newest)).where(F.col("__n") <= rows)
    running = F.sum(length).over(newest.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return own.withColumn("running", running).where((F.lit(budget) > 0) & (F.col("running") <= budget)).drop("__n")


_WIDTHS = {"&": 5, "<": 4, ">": 4}


def _escaped(text: str) -> int:
    """Length of the escaped text."""
    return len(text) + sum((w - 1) * text.count(c) for c, w in _WIDTHS.items())


def _attribute(text: str) -> int:
    widths = {"&": 5, "<": 4, ">": 4, '"': 5, "'": 5, "\t": 5, "\n": 5, "\r": 5}
    return sum(widths.get(c, 1) for c in text)


def head_length(ref: str, name: str, section: str | None, page: int | None, truncated: bool) -> int:
    """Length of a rendered source without its body."""
    n = len('<source ref="" document="">\n\n</source>\n') + _attribute(ref) + _attribute(name)
    if section is not None:
        n += len(' section=""') + _attribute(section)
    if page is not None:
        n += len(' page=""') + len(str(page))
    return n + (len(' truncated="true"') if truncated else 0)


def fill(items: Iterable[dict], cap: int) -> list[dict]:
    """Greedy fill in order: items below the floor and repeated ids go, one too large for what is left is skipped,
    and one too large for the whole cap is cut to what is left.  Refs count the items taken."""
    left, taken, seen = cap, [], set()
    for item in items:
        if item["score"] < SCORE_FLOOR or item["id"] in seen:
            continue
        seen.add(item["id"])
        ref, content = f"S{len(taken) + 1}", item["content"] or ""
        head = (ref, item["name"] or str(item["document_id"]), item["section"], item["page"])
        size, cut = head_length(*head, False) + _escaped(content), False
        if size > left:
            if size <= cap:
                continue
            size, n, cut = head_length(*head, True), 0, True
            if size > left:
                continue
            while n < len(content) and size + _WIDTHS.get(content[n], 1) <= left:
                size += _WIDTHS.get(content[n], 1)
                n += 1
            content = content[:n]
        left -= size
        taken.append(item | {"ref": ref, "content": content, "truncated": cut, "rendered": size})
    return taken


def select_evidence(rows: DataFrame, cap: int) -> DataFrame:
    """``turn_id, pos, id, document_id, name, section, page, content, score`` to the evidence taken per turn, by ``fill``.

    Rows below the floor, or without a score, go before they are shuffled; a turn's others are sorted within their
    partition and filled as they come, many turns in one batch.
    """
    names = ["turn_id", "pos", "id", "document_id", "name", "section", "page", "content", "score"]

    def items(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                yield from batch.slice(at, 256).to_pylist()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = []
        for _, turn in groupby(items(batches), key=lambda x: x["turn_id"]):
            out += fill(turn, cap)
            if len(out) >= 4096:
                yield _taken(out)
                out = []
        yield _taken(out)

    own = rows.select(*names).where(F.col("score") >= SCORE_FLOOR)
    types = {"turn_id": "long", "id": "long", "document_id": "long", "page": "int", "score": "double"}
    own = own.select(*(F.col(c).cast(types[c]).alias(c) if c in types else c for c in names))
    return own.repartition("turn_id").sortWithinPartitions("turn_id", F.col("pos").asc_nulls_last()).mapInArrow(run, _TAKEN)


_TAKEN = "turn_id long, ref string, id long, document_id long, content string, score double, truncated boolean, rendered long"


def _taken(items: list[dict]) -> pa.RecordBatch:
    kinds = {"turn_id": pa.int64(), "ref": pa.string(), "id": pa.int64(), "document_id": pa.int64(), "content": pa.string(), "score": pa.float64(), "truncated": pa.bool_(), "rendered": pa.int64()}
    return pa.RecordBatch.from_arrays([pa.array([x[c] for x in items], k) for c, k in kinds.items()], list(kinds))


def cited(evidence: DataFrame, refs: DataFrame) -> DataFrame:
    """Evidence of the valid refs ``turn_id, refs array``, in order of first citation."""
    own = refs.select("turn_id", F.posexplode("refs").alias("pos", "ref"))
    return own.join(evidence, ["turn_id", "ref"])


