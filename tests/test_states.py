"""Document states, breakers and limiters as folds and as stateful streams that run; traces, judge, files, graphs."""

import datetime
import json

import pytest
from pyspark.sql import functions as F

from lodestone.operators import judge, traces, workflow
from lodestone.plans import queries
from lodestone.sources import files, formats
from lodestone.streaming import folds

MINUTE = 60 * folds.SECOND


def walk(fold, rows):
    state, out = fold.start(), []
    for row in rows:
        state, given = fold.step(state, row)
        out.append(given)
    return out


def test_document_states():
    own = folds.DocumentStates(3)
    rows = [(0, "publishing", None), (0, "claim", 2), (0, "claim", 1), (MINUTE, "renew_processing", 1), (2 * MINUTE, "reclaim", 1), (4 * MINUTE + 1, "reclaim", 1), (5 * MINUTE, "fail", 1), (5 * MINUTE, "claim", 2)]
    rows += [(6 * MINUTE, "publishing", 2), (9 * MINUTE, "recover", 2), (9 * MINUTE + 1, "recover", 2), (10 * MINUTE, "ready", 2), (11 * MINUTE, "retry", 2), (11 * MINUTE, "unknown", None)]
    assert walk(own, rows) == [
        (False, "pending", 1, None), (False, "pending", 1, None), (True, "processing", 1, 3 * MINUTE), (True, "processing", 1, 4 * MINUTE), (False, "processing", 1, 4 * MINUTE), (True, "pending", 2, None),
        (False, "pending", 2, None), (True, "processing", 2, 8 * MINUTE), (True, "publishing", 2, 9 * MINUTE), (False, "publishing", 2, 9 * MINUTE), (True, "publishing", 2, 12 * MINUTE + 1),
        (True, "ready", 2, None), (False, "ready", 2, None), (False, "ready", 2, None),
    ]
    assert walk(own, [(0, "claim", None), (0, "fail", None), (0, "retry", None), (0, "claim", 1)])[-2:] == [(True, "pending", 2, None), (False, "pending", 2, None)]


def test_breaker():
    own, s = folds.Breaker(3, 30), folds.SECOND
    rows = [(0, True), (1, True), (2, False), (3, True), (4, True), (5, True), (6, False), (5 + 30 * s, False), (6 + 30 * s, True), (7 + 30 * s, False), (7 + 60 * s, False), (8 + 60 * s, True)]
    assert walk(own, rows) == [
        ("closed", True, 1), ("closed", True, 2), ("closed", True, 0), ("closed", True, 1), ("closed", True, 2), ("closed", True, 3), ("open", False, 3), ("open", False, 3),
        ("half-open", True, 4), ("open", False, 4), ("half-open", True, 0), ("closed", True, 1),
    ]


@pytest.fixture()
def stateful(spark):
    name, value = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    spark.conf.set(name, value)
    yield spark
    spark.conf.unset(name)


def stream(spark, tmp_path, batches, schema, make, key, processor, mode="none"):
    """Runs the batches one by one, over restarts, and returns the rows of all."""
    for n, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        read = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        writer = folds.fold_stream(make(read), key, processor, mode).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ck"))
        writer.trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(str(tmp_path / "out")).drop("batch").collect()


@pytest.mark.parametrize("kind", ["breaker", "limiter", "documents"])
def test_folds_over_a_stream_equal_folds_over_a_table(stateful, tmp_path, kind):
    s = 1_700_000_000 * folds.SECOND
    if kind == "documents":
        fold, takes = folds.DocumentStates(3), "at long, event string, version long"
        events = list(folds.DocumentStates.UPDATES)
        rows = [(i % 3, i, s + i * 50 * folds.SECOND, events[i * 5 % 9], 1 if i % 7 == 0 else None) for i in range(90)]
    elif kind == "breaker":
        fold, takes = folds.Breaker(2, 60), "at long, failed boolean"
        rows = [(i % 3, i, s + i * 20 * folds.SECOND, i * 7 % 5 < 3) for i in range(60)]
    else:
        fold, takes = folds.FixedWindow(1, 3), "at long"
        rows = [(i % 3, i, s + i * 5 * folds.SECOND) for i in range(60)]
    schema = f"k long, id long, {takes}"
    got = stream(stateful, tmp_path, [rows[:20], rows[20:21], rows[21:]], schema, lambda df: df, "k", folds.FoldProcessor(fold, "id", ["at", "id"]))
    want = folds.fold_rows(stateful.createDataFrame(rows, schema), "k", ["at", "id"], fold).drop("at").collect()
    assert sorted(map(tuple, got), key=repr) == sorted(map(tuple, want), key=repr) and len(got) == len(rows)


def test_leases_run_out_by_the_stream_s_time(stateful, tmp_path):
    at = datetime.datetime(2024, 1, 1)
    row = lambda k, i, minutes, event: (k, i, at + datetime.timedelta(minutes=minutes), event, None)
    batches = [[row(1, 1, 0, "claim"), row(2, 2, 0, "claim"), row(2, 3, 1, "publishing"), row(3, 4, 0, "claim"), row(3, 5, 2, "fail")], [row(9, 6, 20, "claim")], [row(9, 7, 21, "publishing")]]
    make = lambda df: df.withColumn("at", folds.micros("ts")).withWatermark("ts", "0 seconds")
    got = stream(stateful, tmp_path, batches, "k long, id long, ts timestamp, event string, version long", make, "k", folds.LeaseProcessor(folds.DocumentStates(3), "id", ["at", "id"]), "eventTime")
    mine = [tuple(r)[:5] for r in got if r.id == -1 and r.key in (1, 2, 3)]
    assert (1, -1, True, "pending", 2) in mine and (2, -1, True, "publishing", 1) in mine and not any(k == 3 for k, *_ in mine)


def test_spans(spark):
    rows = [(1, "t", None), (2, "t", 1), (3, "t", 2), (4, "t", 3), (5, "t", 4), (6, "t", 77), (7, "t", 6), (8, "t", 9), (9, "t", 8), (10, "t", 9), (11, "t", 11), (1, "u", 2), (2, "u", None), (2, "u", None), (None, "t", 1)]
    got = {(r.trace_id, r.id): (r.status, r.depth, r.root_id, r.path) for r in traces.span_paths(spark.createDataFrame(rows, "id long, trace_id string, parent_id long")).collect()}
    assert got["t", 5] == ("ok", 4, 1, [1, 2, 3, 4, 5]) and got["t", 1] == ("ok", 0, 1, [1]) and got["t", 7] == ("orphan", 1, 6, [6, 7]) and got["u", 1] == ("ok", 1, 2, [2, 1])
    assert all(got["t", i] == ("cycle", None, None, None) for i in (8, 9, 10, 11)) and len(got) == 13
    deep = [(i, "t", i - 1 if i else None) for i in range(300)]
    found = traces.span_paths(spark.createDataFrame(deep, "id long, trace_id string, parent_id long")).agg(F.sum("depth"), F.count_if(F.col("status") == "ok")).first()
    assert tuple(found) == (300 * 299 // 2, 300)
    assert traces.span_paths(spark.createDataFrame([], "id long, trace_id string, parent_id long")).count() == 0
    log = spark.createDataFrame([(1, "c", 5), (2, "c", 4), (3, "d", 1)], "id long, conversation_id string, started_at long")
    asked = spark.createDataFrame([("c",)], "conversation_id string")
    assert sorted((r.seq, r.id) for r in traces.of_conversation(log, asked).collect()) == [(1, 2), (2, 1)]
    assert [r.id for r in traces.append_spans(log, log.withColumn("id", F.col("id") + 1)).collect()] == [4]


def test_judge(spark):
    cases = [("a", "one?", None, "r", ["f"], []), ("b", "x", ["first", "second"], None, None, ["g", "h"])]
    cases = spark.createDataFrame(cases, "name string, prompt string, turns array<string>, rubric string, expected_facts array<string>, forbidden_facts array<string>")
    spans = spark.createDataFrame([("a", 2, 1, "tool", "t", "ok", " in ", "o" * 600), ("a", 1, 9, "llm", "m", "failed", None, "")], "name string, started_at long, id long, kind string, label string, status string, input string, output string")
    got = {r.name: r.prompt for r in judge.prompts(cases, spark.createDataFrame([("a", "yes")], "name string, reply string"), spans).collect()}
    w = judge.Wording()
    assert got["a"] == f"{w.opening}\n\n{w.question}one?\n\n{w.rubric}r\n\n{w.expected}\n- f\n\n{w.reply}yes\n\n{w.spans}\n- [llm] m status=failed\n- [tool] t status=ok\n  input: in\n  output: {'o' * 500}...(截断)\n"
    assert got["b"] == f"{w.opening}\n\n{w.turns}\n{w.turn}1: first\n{w.turn}2{w.last}: second\n\n{w.rubric}\n\n{w.forbidden}\n- g\n- h\n\n{w.reply}\n\n{w.spans}\n"
    answers = [('{"score": 4, "reasoning": "ok"}', (4, "ok", None)), ('```json\n{"score": 1}\n```', (1, "", None)), ('```{"score":5,"reasoning":"x"}```', (5, "x", None)), ('{"score": 0}', (None, None, "score out of range")), ('{"score": "high"}', (None, None, "no whole score")), ('{"score": 2.5}', (None, None, "no whole score")), ("[1]", (None, None, "no JSON object")), ("4", (None, None, "no JSON object")), ("", (None, None, "no JSON object")), (None, (None, None, "no JSON object"))]
    found = {r.name: tuple(r)[1:] for r in judge.verdicts(spark.createDataFrame([(i, a) for i, (a, _) in enumerate(answers)], "name long, answer string")).collect()}
    assert [found[i] for i in range(len(answers))] == [want for _, want in answers]


def test_files_as_data_sources(spark, tmp_path):
    (tmp_path / "g").mkdir(), (tmp_path / "c").mkdir(), (tmp_path / "r").mkdir()
    (tmp_path / "g/a.jsonl").write_text(json.dumps({"document_id": 1, "page": 1, "glyphs": [[0, 9, 1, "a"], [5, 9, 1, "b"], [0, 1, 1, None]]}) + "\n" + json.dumps({"document_id": 1, "page": 2}))
    (tmp_path / "g/b.jsonl").write_text("{broken")
    rows = formats.read(spark, formats.GlyphSource, str(tmp_path / "g"), 1).collect()
    assert sorted((r.page or 0, r.seq or 0, r.s, r.problem is None) for r in rows) == [(0, 0, None, False), (1, 0, "a", True), (1, 1, "b", True), (1, 2, None, True), (2, 0, None, True)]
    (tmp_path / "c/set.yaml").write_text("cases:\n- name: one\n  prompt: p\n  turns: [x, y]\n  expected_document_ids: [7]\n  require_citation: true\n- name: two\n")
    (tmp_path / "c/bad.yaml").write_text("cases: [unclosed")
    found = formats.read(spark, formats.CaseSource, str(tmp_path / "c")).collect()
    assert sorted((r.name or "", r.turns or [], r.expected_document_ids or [], bool(r.require_citation), r.problem is None) for r in found) == [("", [], [], False, False), ("one", ["x", "y"], ["7"], True, True), ("two", [], [], False, True)]
    (tmp_path / "r/x.json").write_text(json.dumps({"results": [{"name": "one", "score": 4, "metrics": {"hit1": 1, "mrr": 0.5, "note": "text"}}]}))
    assert [(r.name, r.score, r.metrics) for r in formats.read(spark, formats.ReportSource, str(tmp_path / "r")).collect()] == [("one", 4.0, {"hit1": 1.0, "mrr": 0.5})]


def test_glyph_pages_are_rows_of_their_own(spark, tmp_path):
    import gzip

    nan = float("nan")
    pages = [(1, 1, [[0, 9, 1, "a"], [5, 9, 1, "b\u2028\x85"], [0, 1, 1, None]]), (1, 2, []), (None, 3, [[3.5, 5, 1, "y"], [1, 5, 1, "x"], [1, 5, 1, "x2"], [2.5, 8, 0.5, "top"], [3.4, 8, 1, "on"]]), (2, 1, [[0, None, 1, "n"], [0, 2, None, "w"], [None, 2, 1, "v"], [9, nan, 1, "m"], [0, 0.5, 1, "near"], [9, 0.4, 1, "same"]])]
    lines = [json.dumps({"document_id": i, "page": p, "glyphs": g}, ensure_ascii=False) for i, p, g in pages]
    (tmp_path / "a.txt.gz").write_bytes(gzip.compress("\n".join(lines).encode()))
    (tmp_path / "b.jsonl").write_text(lines[0] + "\n{broken")
    rows = formats.read(spark, formats.GlyphPageSource, str(tmp_path), 1)
    assert sorted((r.document_id or 0, r.page or 0, len(r.glyphs), r.problem is None) for r in rows.collect()) == [(0, 0, 0, False), (0, 3, 5, True), (1, 1, 3, True), (1, 2, 0, True), (2, 1, 6, True)]
    own = rows.where("problem is null").select("document_id", "page", files.text_of_glyphs(F.col("glyphs")).alias("text"))
    assert "Exchange" not in own._jdf.queryExecution().executedPlan().toString()
    whole = files.page_text(formats.read(spark, formats.GlyphSource, str(tmp_path), 1).where("problem is null"))
    got = {(r.document_id, r.page): r.text for r in own.collect()}
    assert got == {(r.document_id, r.page): r.text for r in whole.collect()} and got[None, 3] == "topon\nxx2 y" and got[1, 2] == ""


def test_glyph_file_pages_shuffle_no_glyph(spark, tmp_path):
    texts = [(1, "a  b\n\nc"), (2, None), (3, "\n".join(f"w{i} x" for i in range(45))), (4, "sep\u2028a \x85b \t\"q\\"), (None, "no id"), (5, ""), (6, "twice"), (6, "\n\n more")]
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(f"{tmp_path}/some/documents.parquet")
    spark.createDataFrame(texts[:6], "doc_id long, text string").write.parquet(f"{tmp_path}/once/documents.parquet")

    def plain(rows):
        out = {}
        for i, t in rows:
            for n, line in enumerate((t or "").split("\n")):
                out.setdefault((i, n // 20 + 1), []).append((n, " ".join(w for w in line.split(" ") if w)))
        return {k: "\n".join(x for _, x in sorted(v) if x) or None for k, v in out.items()}

    for name, rows in (("once", texts[:6]), ("some", texts)):
        found = queries.QUERIES["glyph_file_pages"](spark, f"{tmp_path}/{name}")
        assert {(r.document_id, r.page): r.text for r in found.collect()} == plain(rows) and found.count() == len(plain(rows))
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "Window" not in plan


def test_graphs_and_runs_over_tables(spark):
    edges = [(str(i), str(i + 1)) for i in range(12)] + [("12", "3"), ("x", "y"), ("5", None)]
    assert sorted(int(r.node) for r in workflow.reachable(spark.createDataFrame(edges, "src string, dst string"), "2").collect()) == list(range(2, 13))
    assert [r.node for r in workflow.reachable(spark.createDataFrame([], "src string, dst string"), "a").collect()] == ["a"]
    good = '{"steps":[{"id":"a","type":"start","next":"b"},{"id":"b","type":"llm_call","config":{"prompt":"{{.Input}}"},"next":"c"},{"id":"c","type":"end"}]}'
    rows = [("1", good, "hi"), ("2", "{}", "hi"), ("3", None, None), ("4", good.replace('"next":"c"', '"next":"z"'), "hi")]
    own = spark.createDataFrame(rows, "run string, definition string, given string")
    got = {r.run: (r.status, r.output, [tuple(x) for x in r.steps]) for r in workflow.runs(own, {"llm_call": lambda config, prev: config["prompt"] + "!"}).collect()}
    assert got["1"] == ("succeeded", "hi!", [("a", "succeeded", "hi"), ("b", "succeeded", "hi!"), ("c", "succeeded", "hi!")])
    assert got["2"] == got["3"] == ("failed", "", [("", "failed", "empty_definition")]) and got["4"][2] == [("", "failed", "dangling_edge")]
    codes = {r.name: r.code for r in workflow.validity(own.withColumnRenamed("run", "name").unionByName(spark.createDataFrame([("5", "[", "")], "name string, definition string, given string"))).collect()}
    assert codes == {"1": "ok", "2": "empty_definition", "3": "empty_definition", "4": "dangling_edge", "5": "invalid_step_config"}
