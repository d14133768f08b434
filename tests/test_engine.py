"""Golden behaviours: retrieval gate, fusion, chunkers, text, budgets, lifecycle, streams, workflow."""

import math
import random
import re
import time

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lodestone import constants
from lodestone.functions import text
from lodestone.operators import context, fusion, lifecycle, trigram, vector, workflow
from lodestone.plans.retrieve import retrieve, retrieve_in
from lodestone.sources import chunkers, files
from lodestone.streaming import folds, ingest

CHUNK = "id long, document_id long, document_version long, chunk_index int, content string, embedding array<float>, is_published boolean"


def search(spark, chunks, query, k, vector=(1.0, 0.0, 0.0)):
    rows = [(i, doc, 1, index, content, [float(x) for x in vec], True) for i, (doc, index, vec, content) in enumerate(chunks, 1)]
    asked = spark.createDataFrame([(1, query, list(vector))], "query_id long, query string, embedding array<float>")
    found = retrieve(asked, spark.createDataFrame(rows, CHUNK), k, 3).orderBy("pos").collect()
    return [r.id for r in found]


NO = "ZZZQQQ"


def brute_retrieve(chunks, query, vector, k):
    """The whole order of steps in plain Python, from the rules: two searches, fusion, admission, dedup, top-k, neighbours, dedup."""
    rows = {i: c for i, c in enumerate(chunks, 1)}

    def cos(x, y):
        norm = math.sqrt(sum(a * a for a in x)) * math.sqrt(sum(a * a for a in y))
        return sum(a * b for a, b in zip(x, y, strict=True)) / norm if norm else None

    def best(scores):
        return [i for _, i in sorted((-s, i) for i, s in scores.items())[: min(4 * k, 100)]]

    by_vector = {i: cos(vector, [float(np.float32(x)) for x in c[2]]) for i, c in rows.items()}
    by_vector = {i: s for i, s in by_vector.items() if s is not None}
    grams = set(trigram.trigrams(query))
    by_words = {i: trigram.word_similarity(grams, trigram.trigrams(c[3])) for i, c in rows.items()} if grams else {}
    by_words = {i: s for i, s in by_words.items() if s >= constants.TRIGRAM_THRESHOLD}
    v, w = best(by_vector), best(by_words)
    fused = []
    for i in {*v, *w}:
        rank = sum(weight / (constants.RRF_K + found.index(i) + 1) for weight, found in ((constants.VECTOR_WEIGHT, v), (constants.KEYWORD_WEIGHT, w)) if i in found)
        scores = [s[i] for s, found in ((by_vector, v), (by_words, w)) if i in found]
        ok = (i in v and by_vector[i] >= constants.VECTOR_ADMISSION) or (i in w and by_words[i] >= constants.KEYWORD_ADMISSION)
        fused.append((-rank, -max(scores), i, ok))
    kept, seen = [], set()
    for *_, i, ok in sorted(fused):
        key = plain_key(rows[i][3])
        if ok and (not key or key not in seen):
            seen.add(key)
            kept.append(i)
    anchors = kept[:k]
    shown, taken = list(anchors), set(anchors)
    where = {}
    for i, c in rows.items():
        where[c[0], c[1]] = max(i, where.get((c[0], c[1]), 0))
    for i in anchors:
        for step in (-1, 1):
            near = where.get((rows[i][0], rows[i][1] + step))
            if near is not None and near not in taken:
                taken.add(near)
                shown.append(near)
    out, seen = [], set()
    for i in shown:
        key = plain_key(rows[i][3])
        if not key or key not in seen:
            seen.add(key)
            out.append(i)
    return out


def plain_key(text):
    """Line ends made one, blanks at their ends and white space around the whole removed."""
    return re.sub("[ \t]+(?=\n|$)", "", text.replace("\r\n", "\n")).strip()


@pytest.mark.parametrize("seed", range(4))
def test_retrieval_equals_plain_python(spark, seed):
    r = random.Random(seed)
    words = ["".join(r.choices("abcdefgh", k=r.randint(2, 9))) for _ in range(12)]
    chunks = []
    for doc in range(r.randint(5, 12)):
        for index in range(r.randint(1, 6)):
            content = " ".join(r.choices(words, k=r.randint(1, 6))) if r.random() < 0.9 else r.choice(["", "  \n"])
            chunks.append((doc, index, [r.gauss(0, 1) for _ in range(3)] if r.random() < 0.95 else [0.0] * 3, content))
    chunks += [(c[0] + 100, c[1], c[2], c[3] + r.choice([" ", "\n", ""])) for c in r.sample(chunks, 4)]  # the same contents again
    for k in (1, 3, 7):
        query, vector = r.choice([r.choice(words), " ".join(r.choices(words, k=2)), NO]), [r.gauss(0, 1) for _ in range(3)]
        assert search(spark, chunks, query, k, vector) == brute_retrieve(chunks, query, [float(np.float32(x)) for x in vector], k)
    assert search(spark, [], NO, 3) == [] and search(spark, chunks, "", 3) == []


def test_neighbours_follow_anchors(spark):
    rows = [(1, 0, [0, 1, 0], "before"), (1, 1, [1, 0, 0], "hit"), (1, 2, [0, 1, 0], "after"), (2, 0, [0.9, 0.1, 0], "hit two")]
    assert search(spark, rows, NO, 2) == [2, 4, 1, 3]


def test_admission_before_dedup(spark):
    def kept(rows, k=10):
        ranked = spark.createDataFrame([(1, p, i, n, s, c) for n, (p, i, s, c) in enumerate(rows, 1)], "query_id int, path string, id string, pos int, score double, content string")
        fused = fusion.fuse(ranked).join(ranked.select("query_id", "id", "content").distinct(), ["query_id", "id"])
        return [r.id for r in fusion.admit_dedup_top_k(fused, k).orderBy("rank").collect()]

    assert kept([("vector", "a", 0.2, "x"), ("vector", "b", 0.9, "y"), ("vector", "c", 0.5, "z")], 2) == ["b", "c"]
    assert kept([("vector", "a", 0.2, "x"), ("vector", "b", 0.5, "x")]) == ["b"]
    assert kept([("vector", "a", 0.9, "x"), ("vector", "b", 0.5, "x")]) == ["a"]


def test_word_similarity():
    f = lambda q, c: trigram.word_similarity(set(trigram.trigrams(q)), trigram.trigrams(c))
    assert f("word", "two words") == pytest.approx(0.8)
    assert f("abcdefghij", "xx abcd yy") == pytest.approx(4 / 11)
    assert f("abcdefghij", "xx abcde yy") == pytest.approx(5 / 11)
    assert f("深度学习模型", "这里讨论深度学习模型。") >= 0.3 > f("深度学习模型", "今天天气很好")
    r = random.Random(1)
    for _ in range(200):
        a, b = set(trigram.trigrams("".join(r.choices("ab c", k=12)))), trigram.trigrams("".join(r.choices("ab c", k=25)))
        best = max((len(a & set(b[i:j])) / len(a | set(b[i:j])) for i in range(len(b)) for j in range(i + 1, len(b) + 1)), default=0)
        assert trigram.word_similarity(a, b) == pytest.approx(best if a else 0, abs=1e-6)


def test_fixed_chunks(spark):
    def native(s, size, overlap):
        return spark.createDataFrame([(s,)], "t string").select(text.fixed_windows(F.col("t"), size, overlap)).first()[0]

    for s, size, overlap, want in (("天地玄黄宇宙洪", 3, 1, ["天地玄", "玄黄宇", "宇宙洪"]), ("", 2, 0, []), ("   ", 2, 0, []), ("abcd", 2, -1, ["ab", "cd"]), ("  ab  ", 6, 0, ["ab"])):
        assert native(s, size, overlap) == chunkers.windows(s, size, overlap) == want
    assert len(native("a" * 1200, 0, 0)) == len(chunkers.windows("a" * 1200, 0, 0)) == 3
    assert len(native("abcdef", 2, 5)) == 3


def test_structure_chunkers():
    out = chunkers.by_paragraph("A" * 8 + "\n\n" + "B" * 8, 10, 4)
    assert all(len(c) <= 10 for c in out) and "".join(out).count("B") == 8
    assert chunkers.by_paragraph("short one.\n\nshort two.", 100, 0) == ["short one.\n\nshort two."]
    md = "# Top\n\nintro\n\n## Part\n\nbody text\n\n```\n# not a heading\n```\n\n| a | b |\n|---|---|\n| 1 | 2 |\n\n- x\n- y"
    kinds = [k for k, _, _ in chunkers.markdown_blocks(md)]
    assert kinds == ["heading", "paragraph", "heading", "paragraph", "code", "table", "list", "list"]
    mixed = chunkers.markdown_blocks("text\n- one\n  more\n- two\na | b\n---\nc | d\nplain\n```\nx\n\n")
    assert mixed == [("paragraph", 0, "text"), ("list", 0, "- one\n  more"), ("list", 0, "- two"), ("table", 0, "a | b"), ("paragraph", 0, "---\nc | d\nplain"), ("code", 0, "```\nx\n\n")]
    assert chunkers.with_headings(["Outer", "Inner"], "body", 40) == "Outer > Inner\n\nbody"
    assert chunkers.with_headings(["Outer", "Inner"], "body", 12) == "Inner\n\nbody" and chunkers.with_headings(["Outer", "Inner"], "body", 9) == "Inn\n\nbody"
    pieces = chunkers.by_markdown(md, 80, 0)
    assert pieces[0] == ("Top\n\nintro", "Top") and pieces[1][0].startswith("Top > Part\n\n") and all(len(c) <= 80 for c, _ in pieces)
    assert chunkers.by_markdown("# Only\n## Heads", 100, 0) == [("Only > Heads", "Heads")]
    r = random.Random(2)
    for _ in range(100):
        s = "".join(r.choices(["word ", "long.", "\n\n", "# h\n", "x" * 9, " ", "。"], k=30))
        for f in (chunkers.by_sentence, chunkers.by_paragraph):
            assert all(0 < len(c) <= 20 for c in f(s, 20, 5))


def test_dedup_keys_equal_plain_python(spark):
    r = random.Random(9)
    texts = ["".join(r.choices(["a", "B", " ", "\t", "\n", "\r\n", "\r"], k=r.randint(0, 9))) for _ in range(300)]
    got = [x[0] for x in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i").select(text.dedup_key(F.col("t"))).collect()]
    assert got == [plain_key(t) for t in texts]


def test_citations_equal_plain_python(spark):
    """Marks of known sources stay, marks of unknown ones go, and what is no mark is left alone; the numbers go by first mention."""
    r = random.Random(10)
    pieces = [lambda: f"[S{r.randint(1, 14)}]", lambda: r.choice(["[S0]", "[S-3]", "[s2]", "[S 1]", "[S1", "S2]", "[Sx]", "[S01]"]), lambda: r.choice(["word ", "。", "\n", "é"])]
    rows = [("".join(r.choice(pieces)() for _ in range(r.randint(0, 8))), [f"S{n}" for n in r.sample(range(1, 15), r.randint(0, 5))]) for _ in range(200)]
    cleaned, valid, invalid = text.citations(F.col("c"), F.col("a"))
    got = spark.createDataFrame([(i, *x) for i, x in enumerate(rows)], "i int, c string, a array<string>").orderBy("i").select(cleaned, valid, invalid).collect()
    for (content, allowed), found in zip(rows, got, strict=True):
        marks = re.findall(r"\[(S[1-9][0-9]*)\]", content)
        want = re.sub(r"\[(S[1-9][0-9]*)\]", lambda m, a=allowed: m[0] if m[1] in a else "", content)
        assert tuple(found) == (want, list(dict.fromkeys(m for m in marks if m in allowed)), sum(m not in allowed for m in marks))


def test_budgets(spark):
    size = context.head_length("S1", "d", None, None, False) + 10
    item = lambda i, c, s=0.9: {"id": i, "document_id": 1, "name": "d", "section": None, "page": None, "content": c, "score": s}
    assert [x["ref"] for x in context.fill([item(1, "x", 0.85), item(2, "y", 0.05)], 10_000)] == ["S1"]
    assert len(context.fill([item(1, "a" * 10), item(2, "b" * 10)], size)) == 1
    got = context.fill([item(1, "a" * 10), item(2, "b" * 10), item(3, "c" * 5)], size + size - 5)
    assert [(x["id"], x["ref"]) for x in got] == [(1, "S1"), (3, "S2")]
    cut = context.fill([item(1, "&" * 1000)], 100)[0]
    assert cut["truncated"] and cut["rendered"] <= 100 < cut["rendered"] + 5
    tag = text.source_tag(F.lit("S1"), F.lit('a"b'), F.lit("se"), F.lit(3), F.lit("x<y"), F.lit(True))
    shown = spark.range(1).select(tag).first()[0]
    assert len(shown) == context.head_length("S1", 'a"b', "se", 3, True) + len("x&lt;y")


def test_history(spark):
    def kept(parts, budget):
        df = spark.createDataFrame([(1, i, p) for i, p in enumerate(parts)], "c int, t int, s string")
        return sorted(r.t for r in context.recent_history(df, ["c"], [F.col("t").desc()], F.length("s"), budget).collect())

    assert kept(["aaaa", "bbbb", "cccc"], 8) == [1, 2] and kept(["aaaa", "bbbb"], 8) == [0, 1]
    assert kept(["a"], 0) == kept(["a"], -1) == kept(["a" * 10], 3) == [] and kept(["你好世界"], 4) == [0] and kept(["你好世界"], 3) == []
    ctx = spark.createDataFrame([(None,), (3000,), (1100,), (500,), (1000,)], "n int").select(context.total_budget(F.col("n"))).collect()
    assert [r[0] for r in ctx] == [16000, 8000, 400, 0, 0]


def test_tool_calls(spark):
    rows = [(1, 1, 0, "c1", "f", '{"a'), (1, 2, None, "", "", '":1}'), (1, 3, 2, "c3", "g", "{}")]
    got = folds.merge_tool_calls(spark.createDataFrame(rows, "turn int, seq int, index int, id string, name string, args string")).orderBy("index").collect()
    assert [tuple(r)[1:] for r in got] == [(0, "c1", "f", '{"a":1}'), (1, "", "", ""), (2, "c3", "g", "{}")]


def test_publish_is_idempotent(spark):
    own = spark.createDataFrame([(1, 1, True), (1, 2, False), (2, 1, True)], "document_id int, document_version int, is_published boolean")
    want = spark.createDataFrame([(1, 2)], "document_id int, version int")
    once = lifecycle.publish(own, want)
    assert sorted(map(tuple, once.select(*own.columns).collect())) == [(1, 2, True), (2, 1, True)]
    assert sorted(map(tuple, lifecycle.publish(once, want).select(*own.columns).collect())) == [(1, 2, True), (2, 1, True)]


def test_pages(spark):
    rows = [(1, 1, 0, 10.0, 50.0, 5.0, "b"), (1, 1, 1, 0.0, 50.0, 5.0, "a"), (1, 1, 2, 0.0, 40.0, 5.0, "c")]
    assert files.page_text(spark.createDataFrame(rows, "document_id int, page int, seq int, x double, y double, w double, s string")).first().text == "a b\nc"


def test_workflow():
    s = workflow.Step
    end = s("e", "end")
    cases = [
        ([], "empty_definition"), ([s("", "start")], "invalid_step_config"), ([s("a", "start"), s("a", "end")], "duplicate_step_id"), ([end], "missing_start_step"),
        ([s("a", "start", next="x"), end], "dangling_edge"), ([s("a", "start", next="c"), s("c", "conditional", next_if_true="e"), end], "conditional_missing_branch"),
        ([s("a", "start")], "dead_end"), ([s("a", "start", next="e"), s("e", "end", next="a")], "end_has_outgoing"),
        ([s("a", "start", next="b"), s("b", "llm_call", next="a"), end], "cycle_detected"), ([s("a", "start", next="e"), end, s("z", "llm_call", next="e")], "unreachable_step"),
    ]
    for steps, code in cases:
        with pytest.raises(workflow.WorkflowError) as error:
            workflow.validate(steps)
        assert error.value.code == code
    assert workflow.render("{{.Input}}|{{ .Prev }}|{{.Steps.s1}}", "<a>", "b", {"s1": "c"}) == "<a>|b|c"
    ok = lambda t: workflow.condition(t, "yes", "prev-out", {"s1": "42"})
    assert ok('input == "yes"') and ok('prev == "prev-out" and steps.s1 == "42"') and not ok('!(input contains "e")')
    with pytest.raises(workflow.WorkflowError) as error:
        ok("1 + 1")
    assert error.value.code == "condition_not_bool"
    steps = [s("a", "start", next="c"), s("c", "conditional", {"expression": 'input == "go"'}, next_if_true="l", next_if_false="e"), s("l", "llm_call", {"prompt": "{{.Input}}!"}, next="e"), s("e", "end")]
    calls = {"llm_call": lambda c, _: c["prompt"].upper()}
    assert workflow.run(steps, "go", calls)[:2] == ("succeeded", "GO!") and workflow.run(steps, "no", calls)[:2] == ("succeeded", "false")


def test_retrieve_in_selected_bases(spark):
    rows = [(1, "a", [1.0, 0.0], "one"), (2, "a", [0.9, 0.1], "two"), (3, "b", [1.0, 0.0, 0.0], "three"), (4, "off", [1.0, 0.0], "four"), (5, "other", [1.0, 0.0], "five"), (6, "b", [0.1, 1.0, 0.0], "six"), (7, "same", [0.0, 1.0], "seven")]
    chunks = spark.createDataFrame([(i, i * 10, 1, 0, c, v, True, kb) for i, kb, v, c in rows], CHUNK + ", kb string")
    bases = spark.createDataFrame([("a", "m", True), ("b", "n", True), ("off", "m", False), ("other", "m", True), ("same", "o", True)], "kb string, model string, active boolean")
    asked = spark.createDataFrame([(1, NO, "m", [1.0, 0.0]), (1, NO, "n", [1.0, 0.0, 0.0]), (1, NO, "o", [0.0, 1.0]), (2, "seven", "m", None), (2, "seven", "o", None)], "query_id long, query string, model string, embedding array<float>")
    every = retrieve_in(asked, chunks, bases, None, 5, {"m": 2, "n": 3, "o": 2})
    assert {r.id for r in every.where("query_id = 1").collect()} == {1, 2, 3, 5, 7} and [r.id for r in every.where("query_id = 2").collect()] == [7]
    found = lambda selected, k=5: [r.id for r in retrieve_in(asked.where("query_id = 1"), chunks, bases, selected, k, {"m": 2, "n": 3, "o": 2}).orderBy("pos").collect()]
    assert found(["a", "b", "off", "missing"]) == [1, 3, 2] and found(["off", "missing"]) == [] and found(["a", "b"], 2) == [1, 3] and found(["other"]) == [5] and found(["same"]) == [7]


def test_pivot_index_equals_a_scan(spark):
    r = random.Random(6)
    centres = [[r.gauss(0, 1) for _ in range(6)] for _ in range(9)]
    rows = [(i, [float(c + r.gauss(0, 0.1)) for c in centres[i % 9]] if i % 50 else [0.0] * 6, "xy"[i % 2]) for i in range(1500)] + [(5000 + i, [1.0] * 6, "x") for i in range(40)] + [(9000, [1.0] * 5, "x"), (9001, None, "x")]
    chunks = spark.createDataFrame(rows, "id long, embedding array<float>, model string")
    asked = spark.createDataFrame([(i, [c + r.gauss(0, 0.1) for c in centres[i % 9]], "xy"[i % 2]) for i in range(30)] + [(99, [0.0] * 6, "x"), (98, [1.0] * 6, "y")], "query_id long, embedding array<float>, group string")
    plain = lambda df: sorted((x.query_id, x.rank, x.id, round(x.score, 9)) for x in df.collect())
    index = vector.PivotIndex(chunks, 6)
    alone = asked.drop("group")
    want = plain(vector.top_k(alone, chunks, 7, 6))
    assert plain(index.search(alone, 7)) == want and len(want) == 31 * 7 and index.pruned_share(alone, 7) > 0.5
    unit = {i: np.array(v) / np.linalg.norm(v) for i, v, _ in rows if v and len(v) == 6 and any(v)}
    for q in asked.where("query_id < 3").collect():
        x = np.float32(q.embedding).astype(float)
        scores = {i: float(np.float32(v).astype(float) @ x / np.linalg.norm(np.float32(v)) / np.linalg.norm(x)) for i, v in unit.items()}
        assert [i for qid, _, i, _ in want if qid == q.query_id] == [i for _, i in sorted((-round(s, 9), i) for i, s in scores.items())[:7]]
    grouped = vector.PivotIndex(chunks, 6, "model")
    own = lambda df: sorted((x.query_id, x.group, x.rank, x.id) for x in df.collect())
    for queries in (asked, alone):
        assert own(grouped.search(queries, 5)) == own(vector.top_k(queries, chunks, 5, 6, "model"))
    assert index.search(alone.limit(0), 3).count() == 0 and vector.PivotIndex(chunks.limit(0), 6).search(alone, 3).count() == 0


def test_vector_scan_holds_few_scores_at_once(spark, monkeypatch):
    r = np.random.default_rng(3)
    vectors = r.normal(size=(700, 6)).astype(np.float32)
    chunks = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)] + [(900, [0.0] * 6)], "id long, embedding array<float>")
    asked = chunks.where("id < 300 or id = 900").withColumnRenamed("id", "query_id")
    want = sorted((x.query_id, x.id) for x in vector.top_k(asked, chunks, 5, 6).collect())
    assert len(want) == 1500 and {(q, i) for q, i in want if q == 7} == {(7, i) for i in np.argsort(-(vectors @ vectors[7] / np.linalg.norm(vectors, axis=1)))[:5].tolist()}
    held, chosen = [], vector._chosen
    monkeypatch.setattr(vector, "_chosen", lambda score, *a: held.append(score.size) or chosen(score, *a))
    monkeypatch.setattr(vector, "PAIRS", 5000)
    scan = vector._Scan(vector._prepared(asked, 6, False), 5, 6)
    batches = list(scan(iter(vector._rows(chunks, 6, None).toArrow().to_batches())))
    assert max(held) <= 5000 and sum(held) == 301 * 701
    assert sorted((x["query_id"], x["id"]) for x in spark.createDataFrame(pa.Table.from_batches(batches)).groupBy("query_id").agg(F.slice(F.sort_array(F.collect_list(F.struct("score", "id")), False), 1, 5).alias("s")).select("query_id", F.explode("s.id").alias("id")).collect()) == want


def test_chunkers_read_long_texts_once_and_count_across_pages(spark):
    start = time.process_time()
    for kind in ("sentence", "txt"):
        assert len(chunkers.chunk_one(kind, "word " * 60_000, 500, 50)) == math.ceil((300_000 - 50) / 450)
    assert time.process_time() - start < 5
    pages = [(d, "txt", f"page {p} of {d}" if p != 2 else None, p) for d in range(40) for p in (3, 1, 2)]
    docs = spark.createDataFrame(pages, "document_id long, file_type string, text string, page_number int").repartition(5)
    found = chunkers.chunk_documents(docs, 500, 50)
    assert sorted((r.document_id, r.page_number, r.chunk_index, r.content) for r in found.collect()) == [(d, p, i, f"page {p} of {d}") for d in range(40) for i, p in enumerate((1, 3))]
    assert "Window" not in found._jdf.queryExecution().optimizedPlan().toString()
    batch = pa.RecordBatch.from_arrays([pa.array(["x" * 30, None, "", "y" * 80, "z"])], ["text"])
    assert [p.num_rows for p in chunkers.slices(batch, 0, 50)] == [3, 1, 1]


def test_sentences_of_a_long_text_are_split_once(spark):
    start = time.time()
    rows = spark.createDataFrame([("...a?! b。 c",), ("",), ("no mark",)], "t string")
    assert [r[0] for r in rows.select(text.sentences(F.col("t"))).collect()] == [["...", "a?!", "b。", "c"], [], ["no mark"]]
    assert spark.range(1).select(F.size(text.sentences(F.repeat(F.lit("é a. "), 200_000)))).first()[0] == 200_000
    assert time.time() - start < 20


def test_evidence_of_many_turns_in_one_stream(spark):
    r = random.Random(9)
    rows = [(t, p, t * 10 + p % 6, t, r.choice(["n&", None, ""]), None if p % 2 else "s", 3 if p % 3 else None, "<&a" * r.randint(0, 90), r.choice([0.1, 0.2, 0.9])) for t in range(60) for p in range(8)]
    names = ["turn_id", "pos", "id", "document_id", "name", "section", "page", "content", "score"]
    found = context.select_evidence(spark.createDataFrame(r.sample(rows, len(rows)), "turn_id long, pos int, id long, document_id long, name string, section string, page int, content string, score double"), 700)
    want = [x for t in range(60) for x in context.fill([dict(zip(names, y, strict=True)) for y in rows if y[0] == t], 700)]
    assert sorted(tuple(x) for x in found.collect()) == sorted((x["turn_id"], x["ref"], x["id"], x["document_id"], x["content"], x["score"], x["truncated"], x["rendered"]) for x in want)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "FlatMapGroupsInPandas" not in plan and any(x["truncated"] for x in want)  # no call of pandas for each turn


def test_trigram_index_equals_all_pairs(spark, monkeypatch):
    r = random.Random(7)
    words = ["".join(r.choices("abcdeé日", k=r.randint(1, 8))) for _ in range(60)]
    contents = [(i, " ".join(r.choices(words, k=r.randint(0, 12)))) for i in range(300)] + [(900, None), (901, "!!")]
    queries = [(i, " ".join(r.choices(words, k=r.randint(1, 5)))) for i in range(25)] + [(50, ""), (51, "?!")]
    grams = {i: trigram.trigrams(c or "") for i, c in contents}
    pairs, scores = set(), {}
    for q, t in queries:
        own = set(trigram.trigrams(t))
        for i, g in grams.items():
            common = len(own & set(g))
            if common and 10 * common >= 3 * len(own):
                pairs.add((q, i, common, len(own)))
                scores[q, i] = trigram.word_similarity(own, g)
    asked, chunks = spark.createDataFrame(queries, "query_id long, query string"), spark.createDataFrame(contents, "id long, content string")
    for part, together in ((65_536, 256), (50, 3)):
        monkeypatch.setattr(trigram.TrigramIndex, "PART", part)
        monkeypatch.setattr(trigram.TrigramIndex, "TOGETHER", together)
        index = trigram.TrigramIndex(chunks)
        assert {tuple(x) for x in index.overlap(asked).collect()} == pairs
        got = sorted((x.query_id, x.rank, x.id, round(x.score, 6)) for x in index.search(asked, 4).collect())
        want = []
        for q in {q for q, _ in scores}:
            best = sorted((-s, i) for (p, i), s in scores.items() if p == q and s >= constants.TRIGRAM_THRESHOLD)[:4]
            want += [(q, n, i, round(-s, 6)) for n, (s, i) in enumerate(best, 1)]
        assert got == sorted(want) and got


def test_trigram_scan_equals_all_pairs_and_scores_few(spark, monkeypatch):
    r = random.Random(8)
    words = ["".join(r.choices("abcdeé日", k=r.randint(1, 8))) for _ in range(60)]
    contents = [(i, " ".join(r.choices(words, k=r.randint(0, 40)))) for i in range(400)] + [(900, None), (901, "!!"), (902, "İ_x " + words[0])]
    queries = [(i, " ".join(r.choices(words, k=r.randint(1, 9)))) for i in range(25)] + [(50, ""), (51, "?!")]
    grams = {i: trigram.trigrams(c or "") for i, c in contents}
    pairs, scores = set(), {}
    for q, t in queries:
        own = set(trigram.trigrams(t))
        for i, g in grams.items():
            common = len(own & set(g))
            if common and 10 * common >= 3 * len(own):
                pairs.add((q, i, common, len(own)))
                scores[q, i] = trigram.word_similarity(own, g)
    want = []
    for q in {q for q, _ in scores}:
        best = sorted((-s, i) for (p, i), s in scores.items() if p == q and s >= constants.TRIGRAM_THRESHOLD)[:4]
        want += [(q, n, i, -s) for n, (s, i) in enumerate(best, 1)]
    asked, chunks = spark.createDataFrame(queries, "query_id long, query string"), spark.createDataFrame(contents, "id long, content string")
    found = trigram.overlap(asked, chunks)
    assert {tuple(x) for x in found.collect()} == pairs and found.count() == len(pairs)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "Aggregate" not in plan  # contents are dealt out, pairs never
    assert sorted((x.query_id, x.rank, x.id, x.score) for x in trigram.search(asked, chunks, 4).collect()) == sorted(want)
    batches = chunks.toArrow().to_batches()
    code, starts = trigram.coded([c or "" for _, c in contents])
    assert [[tuple(map(ord, g)) for g in grams[i]] for i, _ in contents] == [[(c >> 42, c >> 21 & 0x1FFFFF, c & 0x1FFFFF) for c in code[a:b].tolist()] for a, b in zip(starts, starts[1:])]
    scored, best = [], trigram._best
    monkeypatch.setattr(trigram, "_best", lambda *a: scored.append(1) or best(*a))
    for name, value in (("QUERY_BLOCK", 4), ("ROWS", 30)):  # many blocks, read again for each slice
        monkeypatch.setattr(trigram, name, value)
    got = {}
    for batch in trigram._Search(asked, 4)(iter(batches)):
        for row in batch.to_pylist():
            got.setdefault(row["query_id"], []).append((-row["score"], row["id"]))
    assert sorted((q, n, i, -s) for q, rows in got.items() for n, (s, i) in enumerate(sorted(rows)[:4], 1)) == sorted(want)
    assert len(scored) < len(pairs) / 2


def test_bounds_of_word_similarity_hold_in_lanes(monkeypatch):
    r = random.Random(10)
    words = ["".join(r.choices("abcdeé日", k=r.randint(1, 8))) for _ in range(60)]
    many = ["".join(chr(r.randint(0x4E00, 0x4FFF)) for _ in range(r.randint(1, 4))) for _ in range(120)]  # more letters than the table takes
    for own, longest in ((words, 9), (many, 9), (many, 400)):  # with 400 words, over 255 trigrams in a query
        texts = [" ".join(r.choices(own, k=r.randint(0, 60))) for _ in range(90)] + ["", "!!", own[0], " ".join(own[:1] * 300)]
        asked = [" ".join(r.choices(own, k=r.randint(1, longest))) for _ in range(21)]
        code, starts = trigram.coded(texts)
        owner = np.repeat(np.arange(len(texts)), np.diff(starts))
        grams, number, before = trigram._numbered(code, owner)
        before = before - starts[owner]
        assert grams.tolist() == sorted(set(code.tolist())) and (grams[number] == code).all()
        plain = [trigram.trigrams(t) for t in texts]
        assert [np.maximum(before[a:b], -1).tolist() for a, b in zip(starts, starts[1:])] == [trigram.previous(g).tolist() for g in plain]
        block = trigram._Queries([(q, np.unique(trigram.coded([t])[0]), 0.0) for q, t in enumerate(asked)])
        exact = np.array([[trigram.word_similarity(set(trigram.trigrams(q)), g) for q in asked] for g in plain])
        row, scan = block.rows_of(grams)[number], trigram._First.__new__(trigram._First)
        for cells in (4_000_000, 50):  # all lanes at once, and one word of them at a time
            monkeypatch.setattr(trigram, "CELLS", cells)
            low, most = scan.bounds(block, starts, row, before, low=True), scan.bounds(block, starts, row, before)
            assert (low <= exact + 1e-6).all() and (exact <= most + 1e-6).all()
            monkeypatch.undo()
        assert block.lane == (np.uint8 if longest == 9 else np.uint16) and (most - exact).mean() < 0.1


def test_limits_of_the_first_scan_and_ties(spark, monkeypatch):
    r = random.Random(12)
    words = ["".join(r.choices("abcdef", k=r.randint(2, 8))) for _ in range(40)]
    texts = [(i, " ".join(r.choices(words, k=30)) if i % 3 else " ".join(words[:30])) for i in range(600)]  # every third one a copy
    queries = [(q, " ".join(words[q : q + 6])) for q in range(12)]
    asked, chunks = spark.createDataFrame(queries, "query_id long, query string"), spark.createDataFrame(texts, "id long, content string")
    want = []
    for q, t in queries:
        scores = sorted((-trigram.word_similarity(set(trigram.trigrams(t)), trigram.trigrams(c)), i) for i, c in texts)
        want += [(q, n, i, -s) for n, (s, i) in enumerate(scores[:5], 1) if -s >= constants.TRIGRAM_THRESHOLD]
    for first in (16, 2, 1):
        monkeypatch.setattr(trigram, "FIRST", first)
        assert sorted((x.query_id, x.rank, x.id, x.score) for x in trigram.search(asked, chunks, 5).collect()) == sorted(want)
    copies = [(i, " ".join(words[:30])) for i in range(500)]
    batches = spark.createDataFrame(copies, "id long, content string").toArrow().to_batches()
    # of equal scores the k smallest ids are enough; all 500 copies were passed on before
    assert sum(b.num_rows for b in trigram._Search(asked, 5)(iter(batches))) <= 5 * len(queries)
    least = spark.createDataFrame([(q, 2.0) for q, _ in queries], "query_id long, least double")
    assert sum(b.num_rows for b in trigram._Search(asked, 5, least)(iter(batches))) == 0


def test_windows_of_a_long_text_are_cut_in_stretches(spark):
    rows = spark.createDataFrame([(t,) for t in (None, "", " ", "é😀b " * 400, "a" * 500, "a" * 501, " " * 950 + "x", "日" * 951)], "t string")
    plain = lambda t, size, step: [w for p in range(0, len(t or ""), step) if (p == 0 or p - step + size < len(t)) and (w := t[p : p + size].strip())]
    for size, overlap in ((500, 50), (500, 0), (7, 6), (500, 499), (1, 0)):
        assert [x[1] for x in rows.select("t", text.fixed_windows(F.col("t"), size, overlap)).collect()] == [plain(x.t, size, size - overlap) for x in rows.collect()]
    start = time.time()  # counted from the start for each window, this takes minutes
    assert spark.range(1).select(F.size(text.fixed_windows(F.repeat(F.lit("é a. "), 1_000_000), 500, 50))).first()[0] == math.ceil(4_999_500 / 450) + 1
    assert time.time() - start < 20


def test_embedding_of_a_batch_and_candidates_before_contents(spark):
    import zlib

    r, embed = random.Random(3), ingest.trigram_embedding(16)
    texts = ["".join(r.choices("abcé日😀 İ", k=k)) for k in (0, 1, 2, 3, 4, 50, 0, 300)]
    for t, got in zip(texts, embed(texts), strict=True):
        data, want = t.lower().encode(), np.zeros(16)
        for piece in [data[i : i + 3] for i in range(len(data) - 2)] or [data]:
            h = zlib.crc32(piece)
            want[h % 16] += 1 if h & 0x10000 else -1
        assert got == pytest.approx((want / (np.linalg.norm(want) or 1)).tolist())
    assert embed([]) == []
    rows = [(i, i, 1, 0, f"some words {i}", [1.0, float(i), 0.0], True) for i in range(9)]
    asked = spark.createDataFrame([(1, "some words", [1.0, 0.0, 0.0])], "query_id long, query string, embedding array<float>")
    plan = retrieve(asked, spark.createDataFrame(rows, CHUNK), 3, 3, neighbors=False)._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" not in plan and plan.count("Join") == 1  # candidates of a known size meet the contents; searches are over by then


def test_attributes_cursors_and_judge_texts(spark):
    row = spark.createDataFrame([({"b": "0", "a": "", "q": 'x"y', "n": None}, {"z": 0, "c": 7, "m": None}, "s" * 499 + "éa", " ok \n", [], ["t"])], "s map<string,string>, i map<string,long>, long string, short string, none array<string>, turns array<string>")
    got = row.select(text.clean_attrs(F.col("s"), F.col("i")), text.clean_attrs(F.map_filter("s", lambda k, v: v == ""), F.map_filter("i", lambda k, v: v == 0)), text.judge_cut(F.col("long")), text.judge_cut(F.col("short")), text.case_turns(F.lit("p"), F.col("none")), text.case_turns(F.lit("p"), F.col("turns"))).first()
    assert list(got) == ['{"b":"0","c":7,"q":"x\\"y"}', "{}", "s" * 499 + "...(截断)", "ok", ["p"], ["t"]]
    at, key = text.cursor_parts(F.col("c"))
    read = spark.createDataFrame([("2024-01-02T03:04:05Z_a_b",), ("2024-01-02T03:04:05Z_",), ("x_1",), ("",), (None,)], "c string").select(at.cast("string"), key).collect()
    assert [tuple(r) for r in read] == [("2024-01-02 03:04:05", "a_b")] + [(None, None)] * 4


def test_numbered_batches_and_tools(spark):
    keys = random.Random(4).sample(range(-20_000, 20_000), 3000)
    got = files.keyset_batches(spark.createDataFrame([(k,) for k in keys], "k long"), "k", -5000, 100).collect()
    want = sorted(k for k in keys if k > -5000)
    assert sorted((r.position, r.k, r.batch) for r in got) == [(i + 1, k, i // 100) for i, k in enumerate(want)]
    old = spark.createDataFrame([(1, "s", "t", "old"), (2, "s", "gone", "d")], "id long, server string, tool string, description string")
    remote = spark.createDataFrame([("s", "t", None), ("s", "new", "n")], "server string, tool string, description string")
    assert sorted(tuple(r) for r in lifecycle.upsert_tools(old, remote).collect()) == [("s", "gone", 2, "d", False), ("s", "new", None, "n", True), ("s", "t", 1, None, True)]
    spans = spark.createDataFrame([(1, 9, None, "root"), (2, 9, 1, "llm"), (3, 9, 1, "tool"), (4, 9, 7, "lost")], "id long, trace_id long, parent_id long, name string")
    assert sorted((r.id, r.parent_name, r.children) for r in lifecycle.span_tree(spans).collect()) == [(1, None, 2), (2, "root", 0), (3, "root", 0), (4, None, 0)]
