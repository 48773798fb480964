"""Readers, writers, jobs, streams and the command line."""

import bz2
import json

import pytest
from pyspark.sql import functions as F

from turnmill import __main__ as cli
from turnmill.operators import posts as P
from turnmill.plans import jobs
from turnmill.sources import readers as R, writers as W
from turnmill.streaming import contexts as CH, ingest as G


def lines(spark, path):
    return [r.value for r in spark.read.text(path).collect()]


def comment(i, body, parent="t3_S", author="al", community="c1"):
    return {"author": author, "id": i, "link_id": "t3_S", "parent_id": parent, "body": body, "created_utc": str(i), "subreddit_id": community, "score": 1, "distinguished": None, "gilded": "0", "controversiality": "0"}


def test_json_lines(spark, tmp_path):
    path = tmp_path / "c.bz2"
    path.write_bytes(bz2.compress("\n".join(json.dumps(comment(str(i), f"text {i}")) for i in range(5)).encode()))
    assert R.json_lines(spark, str(path), P.COMMENT).count() == 5
    (tmp_path / "bad.json").write_text('{"id": "1"}\nnot json\n')
    with pytest.raises(Exception):
        R.json_lines(spark, str(tmp_path / "bad.json"), P.COMMENT).collect()


def test_line_readers(spark, tmp_path):
    (tmp_path / "d.txt").write_text("a b\tc\nx\n\n", encoding="utf-8")
    d = R.dialogue_lines(spark, str(tmp_path / "d.txt")).orderBy("line_no").collect()
    assert [(r.line_no, r.utterances) for r in d] == [(0, ["a b", "c"]), (1, ["x"]), (2, [""])]
    assert R.utterance_rows(R.dialogue_lines(spark, str(tmp_path / "d.txt"))).count() == 4
    (tmp_path / "p.txt").write_text("a|b\n", encoding="utf-8")
    assert R.dialogue_lines(spark, str(tmp_path / "p.txt"), "|").first().utterances == ["a", "b"]
    assert [r.line_no for r in R.text_lines(spark, str(tmp_path / "d.txt"), 2).collect()] == [2]
    assert R.document_lines(spark, str(tmp_path / "d.txt")).count() == 2
    (tmp_path / "docs").mkdir()
    for n, t in (("1.txt", "one\ntwo"), ("2.txt", ""), ("3.md", "no")):
        (tmp_path / "docs" / n).write_text(t)
    assert sorted(r.text for r in R.document_directory(spark, str(tmp_path / "docs")).collect()) == ["", "one\ntwo"]


def test_lists(spark, tmp_path):
    (tmp_path / "bots").write_text("# c\nAutoMod\n\nx\n")
    assert {r.name for r in R.bots(spark, str(tmp_path / "bots")).collect()} == {"automod", "x", "[deleted]"}
    (tmp_path / "rules").write_text("a\ts1\nb\ts2\ttitle,selftext\nc\ts3\ttitle\tstart$TIL,TIL:$Today\n")
    got = {r.id: r for r in R.rules(spark, str(tmp_path / "rules")).collect()}
    assert got["s1"].fields == [] and got["s2"].fields == ["title", "selftext"] and got["s3"].replacements == ["Today", "Today"]
    (tmp_path / "worse").write_text("a\ts1\tbody\n")
    with pytest.raises(ValueError):
        R.rules(spark, str(tmp_path / "worse"))
    (tmp_path / "ng").write_text("of the\t5\n")
    assert R.ngram_counts(spark, str(tmp_path / "ng")).first().freq == 5
    (tmp_path / "v").write_text("a\nb\n")
    assert [(r.id, r.word) for r in R.vocabulary(spark, str(tmp_path / "v"), 4).orderBy("id").collect()] == [(4, "a"), (5, "b")]
    (tmp_path / "vec").write_text("2 3\na 1 2 3\nb 4 5 6\n")
    assert {r.word: r.vec for r in R.vectors(spark, str(tmp_path / "vec")).where("size(vec) = 3").collect()} == {"a": [1, 2, 3], "b": [4, 5, 6]}


def test_config(tmp_path):
    (tmp_path / "c.yml").write_text("type: thr\nvocab_size: 5\ntrain_data: x/y\nmodel_path: /m/a\n")
    c = R.Config.load(str(tmp_path / "c.yml"), vocab_size=7, batch_size=None)
    assert (c.type, c.vocab_size, c.get("batch_size", 9)) == ("thr", 7, 9)
    with pytest.raises(AttributeError):
        c.nothing
    c.save(str(tmp_path / "d.yml"), "/m")
    d = R.Config.load(str(tmp_path / "d.yml"))
    assert d.train_data.startswith("/") and d.model_path == "a"


def test_post_pair(spark, tmp_path):
    raw = spark.createDataFrame([comment("1", "one\nline"), comment("2", "two", author="a,b")], P.COMMENT)
    W.post_pair(P.comment_posts(raw), f"{tmp_path}/csv", f"{tmp_path}/txt")
    back = R.post_pair(spark, f"{tmp_path}/csv", f"{tmp_path}/txt").orderBy("line_no").collect()
    assert [(r.id, r.author, r.text, r.type) for r in back] == [("1", "al", "one line", 0), ("2", "a,b", "two", 0)]


@pytest.fixture(scope="module")
def raw(tmp_path_factory):
    to = tmp_path_factory.mktemp("raw")
    rows = [comment("A", "hello there **my** friend :)"), comment("B", "yes of course my dear", "t1_A"), comment("C", "no way at all", "t1_A"), comment("D", "spam spam spam", "t1_A", author="Bot"), comment("E", "see http://x.com/a now ok", "t1_B"), comment("F", "12 34 56 78")]
    (to / "c.json").write_text("\n".join(map(json.dumps, rows)) + "\n")
    (to / "bots").write_text("bot\n")
    return to


def test_jobs(spark, raw, tmp_path):
    counts = {r.reason: r.n for r in jobs.ingest_posts(spark, f"{tmp_path}/posts", comments=str(raw / "c.json"), bots=str(raw / "bots")).collect()}
    assert counts == {"processed": 4, "deleted_or_bot": 1, "not_en": 1, "total": 6}
    texts = {r.id: r.text for r in spark.read.parquet(f"{tmp_path}/posts").collect()}
    assert texts["A"] == "hello there my friend" and texts["E"] == "see <url> now ok"
    jobs.build_dialogues(spark, f"{tmp_path}/posts", f"{tmp_path}/dialogues")
    assert sorted(lines(spark, f"{tmp_path}/dialogues.ids")) == ["A\tB\tE", "A\tC"]
    to = jobs.prepare_windows(spark, f"{tmp_path}/dialogues", 2)
    assert lines(spark, to) == ["hello there my friend\tyes of course my dear"]
    jobs.thread_documents(spark, f"{tmp_path}/posts", f"{tmp_path}/threads")
    assert len(lines(spark, f"{tmp_path}/threads")) == 1
    (tmp_path / "bad").write_text("dear\nat all\n")
    assert jobs.sanitize(spark, f"{tmp_path}/dialogues", str(tmp_path / "bad"))["kept"] == 0
    report = jobs.analyze(spark, f"{tmp_path}/dialogues", n_frequents=2, n_rares=2, vocab_size=3, save_tf=True)
    assert report["lines"] == 2 and report["utterances"] == 5 and lines(spark, f"{tmp_path}/dialogues.top2")[0] == "my"
    assert jobs.ngrams(spark, f"{tmp_path}/dialogues", [2]).first().distinct_ngrams > 5
    jobs.ngrams(spark, f"{tmp_path}/dialogues", [1], "rank")
    with pytest.raises(ValueError):
        jobs.ngrams(spark, f"{tmp_path}/dialogues", [1], "other")
    jobs.preprocess_lda(spark, f"{tmp_path}/dialogues", f"{tmp_path}/lda", n_frequents_to_drop=1)
    assert len(lines(spark, f"{tmp_path}/lda.lda.t")) == len(lines(spark, f"{tmp_path}/lda.processed")) == 2
    jobs.train_topics(spark, f"{tmp_path}/dialogues", f"{tmp_path}/model", n_topics=2, no_below=1, passes=2)
    assert jobs.topic_arguments(spark, f"{tmp_path}/model")["n_topics"] == 2
    for whole in (True, False):
        jobs.infer_topics(spark, f"{tmp_path}/dialogues", f"{tmp_path}/model", f"{tmp_path}/out{whole}", dialogue_as_doc=whole, n_words=3)
    assert len(lines(spark, f"{tmp_path}/outTrue.topical")) == 2 and len(lines(spark, f"{tmp_path}/outFalse.topical")) == 5


def test_model_of_the_callers(spark, tmp_path):
    import pyarrow as pa

    (tmp_path / "dev.txt").write_text("a b\tc\nd\te f\nalone\n", encoding="utf-8")

    def decode(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("line_no"), pa.array([" ".join(reversed(x)) for x in b.column("src").to_pylist()])], names=["line_no", "responses"])

    def losses(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([0.5] * b.num_rows), pa.array([1] * b.num_rows, pa.int64()), pa.array([1] * b.num_rows, pa.int64())], names=["loss", "batch_size", "predict_count"])

    got = jobs.test_model(spark, str(tmp_path / "dev.txt"), str(tmp_path), decode, losses, beam_width=5, length_penalty=1.0)
    assert got["output"].endswith("output_dev_bw5_lp1.0") and got["result"] == "test ppl 1.65"
    assert lines(spark, got["output"]) == ["b a", "d"]
    assert jobs.test_model(spark, str(tmp_path / "dev.txt"), str(tmp_path), decode, temperature=0.7)["output"].endswith("output_dev_t0.7")


def test_training_batches(spark):
    d = spark.createDataFrame([(i, [f"a b{i}", "c d", "e f g"]) for i in range(10)], "k bigint, utterances array<string>")
    texts = d.select("k", F.explode("utterances").alias("text"))
    vocab = jobs.vocabulary(texts, 30, ["k"])
    flat = jobs.training_batches(d, vocab, key="k", batch_size=4).collect()
    assert len(flat) == 10 and all(r.tgt_in[0] == 1 and r.tgt_out[-1] == 2 and r.src[2] == 3 for r in flat) and max(r.batch for r in flat) == 2
    turns = jobs.training_batches(d, vocab, key="k", kind="turns", batch_size=4).collect()
    assert all(len(r.src_1) == 2 and r.src_len_2 == 2 for r in turns)


def test_stream(spark, raw, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "1.json").write_text((raw / "c.json").read_text())
    args = dict(comments=f"{tmp_path}/in", bots=str(raw / "bots"), stream=True, checkpoint=f"{tmp_path}/check")
    jobs.ingest_posts(spark, f"{tmp_path}/out", **args)
    assert spark.read.parquet(f"{tmp_path}/out").count() == 4
    jobs.ingest_posts(spark, f"{tmp_path}/out", **args)  # nothing new: nothing twice
    assert spark.read.parquet(f"{tmp_path}/out").count() == 4
    (tmp_path / "in" / "2.json").write_text(json.dumps(comment("Z", "one more fine comment")) + "\n")
    jobs.ingest_posts(spark, f"{tmp_path}/out", **args)
    assert spark.read.parquet(f"{tmp_path}/out").count() == 5
    seen = []
    q = G.write_batches(P.comment_posts(G.json_stream(spark, f"{tmp_path}/in", P.COMMENT)), lambda df, n: seen.append(df.count()), f"{tmp_path}/check2")
    q.awaitTermination()
    assert sum(seen) == 7


def test_stream_state(spark, tmp_path):
    rows = [("c1", 0, "hi"), ("c1", 1, "ho"), ("c2", 0, "x"), ("c1", 2, "hey")]
    kind = "conv string, turn bigint, text string, ts timestamp"
    spark.createDataFrame(rows, "conv string, turn bigint, text string").selectExpr("*", "timestamp_seconds(1700000000 + turn) AS ts").coalesce(1).write.json(f"{tmp_path}/in")
    CH.started(CH.chat_contexts(spark.readStream.schema(kind).json(f"{tmp_path}/in"), 3), f"{tmp_path}/out", f"{tmp_path}/c").awaitTermination()
    got = {(r.conv, r.turn): r.context for r in spark.read.schema(CH.CONTEXT).parquet(f"{tmp_path}/out").collect()}
    assert got == {("c1", 0): ["</S>", "hi"], ("c1", 1): ["hi", "ho"], ("c1", 2): ["ho", "hey"], ("c2", 0): ["</S>", "x"]}
    (tmp_path / "t").mkdir()
    times = spark.readStream.schema("ts timestamp, k string").json(f"{tmp_path}/t")
    assert G.windowed_counts(times, "ts", "1 day", "1 hour", ["k"]).isStreaming
    assert G.running_reasons(spark.createDataFrame([(None,), ("x",)], "reason string")).count() == 2


def test_command_line(spark, raw, tmp_path, capsys):
    cli.main(["posts", "--out_dir", str(tmp_path), "--comments_file", str(raw / "c.json"), "--bots", str(raw / "bots")])
    assert json.loads(capsys.readouterr().out.strip().splitlines()[-1])["processed"] == 4
    cli.main(["dialogues", "build", "--posts", f"{tmp_path}/posts", "--output", f"{tmp_path}/d"])
    cli.main(["corpus", "--data", f"{tmp_path}/d", "analyze", "--vocab_size", "5"])
    assert json.loads(capsys.readouterr().out.strip().splitlines()[-1])["lines"] == 2
