"""Runs with state: the same as runs without, after any edit."""

import random

import pytest
from pyspark.sql import functions as F

from inkwell.operators import incremental, review
from inkwell.plans.engine import Engine, open_workspace
from inkwell.schema import Settings
from inkwell.streaming import saves

rng = random.Random(11)
LINES = ["A sentence without end", "It is done.", "CNN model works.", "Long name (CNN) works.", "LSTM here", "机器学习GAN模型。", "\\section{One}", "\\subsection{Two}", "\\begin{figure}\nx\n\\end{figure}", "\\begin{table}\n\\caption{c}\n\\end{table}", "本文非常非常好。", ""]


def files(spark, texts):
    return spark.createDataFrame([(f"/w/{k}.tex", i, t) for i, (k, t) in enumerate(sorted(texts.items()))], "file_path string, file_ord long, text string")


def fake(system, user):
    if "非常非常" in user:
        return "issue_count=1\nissue1_severity=error\nissue1_message=【语病】“非常非常”应改为“非常”\nrewrite=本文非常好。"
    return "issue_count=0"


def shown(df):
    return sorted(tuple(str(r[c]) for c in ("file_path", "start_line", "start_char", "message", "severity", "source", "element_key")) for r in df.collect())


@pytest.fixture
def engine(spark, tmp_path):
    return Engine(spark, f"file://{tmp_path}/state", Settings(llm_enabled=True), fake)


def test_incremental_equals_full(spark, engine, tmp_path):
    texts = {k: "\n".join(rng.choices(LINES, k=10)) for k in "abc"}
    engine.full(files(spark, texts))
    for step in range(3):
        for k in rng.sample(sorted(texts), 2):
            lines = texts[k].split("\n")
            lines.insert(rng.randrange(len(lines) + 1), rng.choice(LINES))
            del lines[rng.randrange(len(lines))]
            texts[k] = "\n".join(lines)
        got = shown(engine.refresh(files(spark, texts), [f"/w/{k}.tex" for k in texts]))
        clean = Engine(spark, f"file://{tmp_path}/clean{step}", engine.settings, fake)
        assert got == shown(clean.full(files(spark, texts)))


def test_increments_without_removals_and_with_other_order(spark, tmp_path):
    settings = Settings(density_scope="file")
    engine = Engine(spark, f"file://{tmp_path}/state", settings)
    texts = {k: "\n".join(["\\section{S}", "One here.", f"GAN{k.upper()}X model", "\\begin{figure}\nx\n\\end{figure}", "\\subsection{T}", "CNN works."]) for k in "abc"}
    assert engine.changes() is None
    engine.full(files(spark, texts))
    edits = [("b", lambda x: x + "\nNew one.\nLSTM model"), ("a", lambda x: x.replace("CNN works.", "CNN works.\nGANCX here.")), ("c", lambda x: "\n".join(reversed(x.split("\n\\subsection"))))]
    for step, (k, edit) in enumerate(edits):
        texts[k] = edit(texts[k])
        got = shown(engine.refresh(files(spark, texts), spark.createDataFrame([(f"/w/{k}.tex",)], "file_path string")))
        assert got == shown(Engine(spark, f"file://{tmp_path}/clean{step}", settings).full(files(spark, texts)))
        assert step or tuple(engine.changes().first()) == (2, 0, 0)
    assert engine.state.runs("logic") == [3, 4] and engine.state.facts("logic")["generated_at"]


def test_unchanged_later_sentences_keep_their_diagnostics(spark, engine):
    text = "First one\nSecond one\nThird one"
    engine.full(files(spark, {"a": text}))
    out = engine.refresh(files(spark, {"a": text.replace("First one", "First 1 one")}), ["/w/a.tex"])
    assert out.filter("rule = 'punctuation'").count() == 3


def test_ranges_move_with_their_element(spark, engine):
    engine.full(files(spark, {"a": "No end here"}))
    row = engine.refresh(files(spark, {"a": "\n\nNo end here"}), ["/w/a.tex"]).first()
    assert (row["start_line"], row["end_line"]) == (2, 2)


def test_removed_file_and_force_and_empty(spark, engine):
    engine.full(files(spark, {"a": "No end here", "b": "None here"}))
    assert {r["file_path"] for r in engine.refresh(files(spark, {"b": "None here"}), ["/w/b.tex"]).collect()} == {"/w/b.tex"}
    assert engine.full(files(spark, {"b": ""}), force=True).count() == 0
    assert engine.restore().count() == 0


def test_failed_reviews_are_asked_again(spark, tmp_path):
    def broken(system, user):
        raise review.ProviderError("down")

    state = f"file://{tmp_path}/s"
    data = files(spark, {"a": "本文非常非常好。"})
    assert Engine(spark, state, Settings(llm_enabled=True), broken).full(data).filter("rule = 'llm'").count() == 0
    assert Engine(spark, state, Settings(llm_enabled=False), fake).full(data).filter("rule = 'llm'").count() == 0
    assert Engine(spark, state, Settings(llm_enabled=True), fake).full(data).filter("rule = 'llm'").count() == 1
    other = Engine(spark, state, Settings(llm_enabled=True, openai_model="m"), broken)
    assert other.full(data).filter("rule = 'llm'").count() == 0


def test_reviews_in_parts_are_saved_as_they_come(spark, engine):
    elements = engine.parse(files(spark, {"a": "本文非常非常好。\n模型非常非常好。\n这里没有错。\n数据非常非常多。"}))
    seen = []
    out = engine.llm(elements, parts=3, progress=lambda df: seen.append(df.count()))
    assert len(seen) == 3 and seen == sorted(seen) and seen[-1] == out.count() == 3
    assert engine.state.read("reviews").count() == 4


def test_publish_restore_export(spark, engine, tmp_path):
    out = engine.full(files(spark, {"a": "No end here\n本文非常非常好。", "b": "CNN works."}))
    assert sorted(map(str, engine.publish(out).collect())) == sorted(map(str, engine.restore().collect()))
    engine.export(f"{tmp_path}/out")
    assert spark.read.json(f"{tmp_path}/out").count() == 3
    engine.write_log(f"{tmp_path}/log", engine.state.read("elements"))
    assert spark.read.json(f"{tmp_path}/log").count() == 3


def test_no_change_no_difference(spark):
    from tests.test_checks import frame

    keyed = incremental.keyed(frame(spark, [(1, "sentence", "same"), (1, "sentence", "same"), (2, "figure", "x")]))
    assert sorted(r["occurrence"] for r in keyed.collect()) == [0, 0, 1]
    assert incremental.summary(incremental.difference(keyed, keyed)).first()[:2] == (0, 0)
    assert tuple(incremental.earliest_changed(keyed, keyed).first()) == (None, None)
    fewer = keyed.filter("seq = 0")
    assert tuple(incremental.earliest_changed(fewer, keyed).first()) == (-1, -1)


def test_state_ignores_other_versions(spark, engine):
    engine.state.write("elements", spark.createDataFrame([(1,)], "x int"))
    assert engine.state.read("elements").count() == 1 and engine.state.read("elements", back=1) is None and engine.state.read("none") is None
    spark.createDataFrame([(1, 1, "{}")], "x int, version int, facts string").write.parquet(f"{engine.state.root}/elements/run=2")
    assert engine.state.read("elements") is None


def test_workspace_scan(spark, tmp_path):
    for name, text in {"b.tex": "B two.", "a.tex": "A one.", "node_modules/c.tex": "No.", "n.txt": "No.", "sub/Z.tex": "Z three."}.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(text)
    found = open_workspace(spark, str(tmp_path)).orderBy("file_ord").collect()
    assert [r["file_path"].rsplit("/", 1)[1] for r in found] == ["a.tex", "b.tex", "Z.tex"]


def test_sessions(spark):
    rows = [("w", ms, f) for ms, f in ((0, "a"), (799, "b"), (1599, "a"), (2400, "c"), (9000, "d"))] + [("v", 5, "x")]
    df = spark.createDataFrame(rows, "workspace string, ms long, file_path string").withColumn("ts", F.timestamp_millis("ms")).drop("ms")
    got = {(r["workspace"], r["session"]): (r["saves"], r["last_file"], r["files"]) for r in saves.sessions(df, 800).collect()}
    assert got == {("w", 0): (3, "a", ["a", "b"]), ("w", 1): (1, "c", ["c"]), ("w", 2): (1, "d", ["d"]), ("v", 0): (1, "x", ["x"])}


def test_stream_of_saves_runs_once_for_all_files(spark, tmp_path):
    rows = [("w", 0, "a"), ("w", 300, "b"), ("w", 60_000, "c"), ("w", 600_000, "d")]
    df = spark.createDataFrame(rows, "workspace string, ms long, file_path string").withColumn("ts", F.timestamp_millis("ms")).drop("ms")
    df.coalesce(1).write.parquet(f"{tmp_path}/in")
    stream, ran = spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in"), []
    saves.run_on_saves(stream, ran.append, 800, f"{tmp_path}/ck").awaitTermination()
    assert sorted(sum(ran, []))[:3] == ["a", "b", "c"] and any({"a", "b"} <= set(r) for r in ran)
