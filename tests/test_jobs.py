"""Sources, sinks, hooks, sessions, memory, streams and whole jobs on small fixtures."""

import json
import sys

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from lectern import fixed_values as V
from lectern import schemas
from lectern.cluster import shared_dir
from lectern.operators import hooks as H
from lectern.operators import memory as R
from lectern.operators import metrics
from lectern.operators import lookup as A
from lectern.operators import sessions as S
from lectern.plans import tutoring
from lectern.sources import files, tables
from lectern.streaming import chat_log, dashboard

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # stand-in models travel with the job


def write(folder, **contents):
    for name, content in contents.items():
        path = folder / name.replace("__", ".")
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(content)


def test_listing_and_loading(spark, tmp_path):
    write(tmp_path, a__pdf=b"one", b__PDF=b"two", c__txt=b"three")
    write(tmp_path / "sub", d__pdf=b"four")
    listing = files.list_documents(spark, str(tmp_path))
    assert [(r.file_name, r.length) for r in listing.select("file_name", "length").collect()] == [
        ("a.pdf", 3)
    ]
    wanted = spark.createDataFrame([("a.pdf",), ("gone.pdf",)], "file_name string")
    got = {r.file_name: (r.content, r.loaded)
           for r in files.load_documents(listing, wanted).collect()}
    assert got == {"a.pdf": (bytearray(b"one"), True), "gone.pdf": (None, False)}


@pytest.mark.parametrize("at_once,moving", [(10_000, 500_000), (2, 0)])
def test_only_requested_files_are_opened(spark, tmp_path, monkeypatch, at_once, moving):
    monkeypatch.setattr(files, "FILES_AT_ONCE", at_once)
    monkeypatch.setattr(files, "BROADCAST_REQUESTS", moving)
    lines = spark.createDataFrame(
        [(f"b[{d}]*.txt", i, None if i == 2 else f"{d} line {i}\nmore") for d in range(5) for i in (3, 1, 2)],
        "file_name string, n int, line string",
    )
    folder = str(tmp_path / "library")
    files.write_documents(lines, ["n"], folder)
    listing = files.list_documents(spark, folder, ".txt")
    assert listing.select("file_name").distinct().count() == listing.count() == 5
    # What nobody asks for can't be read any more; a listing doesn't mind.
    for other in tmp_path.glob("library/file_name=b*0*/part*"):
        other.chmod(0)
    asked = spark.createDataFrame(
        [("b[1]*.txt", 1), ("b[1]*.txt", 2), ("b[3]*.txt", 3), ("b1.txt", 4), (None, 5)], "file_name string, who int"
    )
    got = {(r.file_name, r.who): (r.content and bytes(r.content), r.loaded) for r in files.load_documents(listing, asked).collect()}
    text = lambda d: f"{d} line 1\nmore\n\n{d} line 3\nmore\n".encode()
    assert got == {
        ("b[1]*.txt", 1): (text(1), True), ("b[1]*.txt", 2): (text(1), True), ("b[3]*.txt", 3): (text(3), True),
        ("b1.txt", 4): (None, False), (None, 5): (None, False),
    }


def test_extract_pages_streams_long_documents(spark):
    text = "\f".join(f"page {i}" for i in range(12_001))
    documents = spark.createDataFrame(
        [("long.pdf", bytearray(text.encode())), ("short.pdf", bytearray(b"only"))],
        "file_name string, content binary",
    )
    pages = files.extract_pages(documents, lambda: lambda b: iter(b.decode().split("\f")))
    got = {(r.file_name, r.page_number): r.text for r in pages.collect()}
    assert len(got) == 12_002 and got[("short.pdf", 1)] == "only"
    assert all(got[("long.pdf", i + 1)] == f"page {i}" for i in range(12_001))


@pytest.fixture(scope="module")
def database(spark):
    spark.sql("CREATE DATABASE IF NOT EXISTS school")
    tables.create_tables(spark, "school")
    return "school"


def test_ddl_append_and_reset(spark, database):
    tables.create_tables(spark, database)  # nothing happens to existing tables
    for name, schema in schemas.DYNAMIC_TABLES.items():
        assert [f.name for f in spark.table(f"{database}.{name}").schema] == schema.fieldNames()
    prompt = 'it\'s "quoted" \\n \\\\ text'
    rows = spark.createDataFrame([("s", "u", prompt, "r")],
                                 "session_id string, user_id string, prompt string, raw_response string")
    tables.append(rows, database, "raw_chat_history")
    saved = spark.table(f"{database}.raw_chat_history").first()
    assert saved.prompt == prompt and saved.timestamp is not None
    chunk = spark.createDataFrame([("id1", 8, "English", "c", 1, "t")], schemas.CHUNKS)
    tables.append_chunks(chunk, database)
    tables.append_chunks(chunk, database)
    tables.reset_dynamic_tables(spark, database)
    assert spark.table(f"{database}.raw_chat_history").count() == 0
    assert spark.table(f"{database}.corpus_chunks").where("chunk_id = 'id1'").count() == 1


def test_vectors_round_trip(spark, tmp_path):
    path = str(tmp_path / "vectors")
    rows = spark.createDataFrame([("a", [1.0, 2.5])], "chunk_id string, embedding array<double>")
    tables.write_vectors(rows, path)
    assert tables.read_vectors(spark, path).first().embedding == [1.0, 2.5]


def test_encoder_is_built_once_per_task_and_sees_whole_texts(spark):
    text = "x" * 100_000
    rows = spark.createDataFrame([(i, text[i:]) for i in range(20)], "id int, t string").repartition(2)
    out = H.embed_texts(rows, "id", "t", lambda: lambda ts: [[float(len(t)), 1.0] for t in ts])
    assert {r.id: r.embedding for r in out.collect()} == {
        i: [100_000.0 - i, 1.0] for i in range(20)
    }


@pytest.mark.parametrize("stored_in", [1, 5])
def test_encoder_loads_are_even_whatever_the_files(spark, stored_in):
    """Long texts lie together in few partitions; the tasks get the same number of characters."""
    rows = spark.range(4000).repartitionByRange(stored_in, "id").select(
        "id", F.repeat(F.lit("x"), F.when(F.col("id") < 400, 2000 + F.col("id")).otherwise(F.col("id") % 50).cast("int")).alias("t")
    )
    from pyspark import TaskContext

    def factory():
        return lambda texts: [[float(len(t)), float(TaskContext.get().partitionId())] for t in texts]

    out = H.embed_texts(rows, "id", "t", factory, tasks=8).collect()
    assert {r.id: r.embedding[0] for r in out} == {r.id: float(len(r.t)) for r in rows.collect()}
    loads = {}
    for r in out:
        loads[r.embedding[1]] = loads.get(r.embedding[1], 0) + r.embedding[0]
    assert len(loads) == 8 and max(loads.values()) <= 1.05 * sum(loads.values()) / 8


@pytest.mark.parametrize("tasks", [None, 3])
def test_failing_call_spoils_no_other_row(spark, tasks):
    def factory():
        def call(request):
            if request == "bad":
                raise RuntimeError("boom")
            return request.upper()
        return call

    rows = spark.createDataFrame([(1, "a"), (2, "bad"), (3, None), (4, "d")], "id int, p string")
    got = {r.id: (r.response, r.error) for r in H.complete_prompts(rows, "id", "p", factory, 2, tasks).collect()}
    assert got == {1: ("A", None), 2: (None, "RuntimeError: boom"), 4: ("D", None)}


# --- retrieval ----------------------------------------------------------------------------


@pytest.fixture(scope="module")
def found(spark):
    chunks = spark.createDataFrame(
        [("a", 8, "en", "bk101", 1, "A"), ("b", 8, "en", "bk101", 1, "B"),
         ("c", 9, "en", "xx01", 1, "C"), ("d", 8, "en", "bk102", 7, "D"),
         ("e", 8, "en", "bk103", 7, "never hit")],
        schemas.CHUNKS,
    )
    hits = spark.createDataFrame(
        [(1, 1, "b", 0.1), (1, 2, "d", 0.2), (1, 3, "a", 0.3), (1, 4, "c", 0.4), (2, 1, "d", 0.0)],
        "question_id int, rank int, chunk_id string, distance double",
    )
    return A.fetch_chunks(hits, chunks)


def test_context_is_in_rank_order(found):
    got = {r.question_id: r.context for r in A.contexts(found).collect()}
    assert got[1] == (
        "[Source: Class 8 Science, Chapter 01, Page 1]\nTEXT: B\n\n"
        "[Source: Class 8 Science, Chapter 02, Page 7]\nTEXT: D\n\n"
        "[Source: Class 8 Science, Chapter 01, Page 1]\nTEXT: A\n\n"
        "[Source: Class 9 Science, Chapter 01, Page 1]\nTEXT: C"
    )


def test_sources_keep_the_best_of_a_page(found):
    rows = A.sources(found, "bk1", "/books/").where("question_id = 1").orderBy("source_no").collect()
    assert [(r.source_no, r.class_level, r.chapter, r.page_number, r.pdf_path, r.label) for r in rows] == [
        (1, 8, "01", 1, "/books/bk101.pdf", "Class 8 Science — Chapter 01, Page 1"),
        (2, 8, "02", 7, "/books/bk102.pdf", "Class 8 Science — Chapter 02, Page 7"),
    ]
    nested = A.source_lists(A.sources(found, "bk1", "/books")).where("question_id = 1").first()
    assert [s.label for s in nested.sources] == [r.label for r in rows]


def test_hits_are_broadcast_only_below_the_bound(spark, found):
    chunks = spark.range(10).select(F.col("id").cast("string").alias("chunk_id"))
    hits = spark.range(10).select(F.col("id").cast("string").alias("chunk_id"), F.lit(1).alias("rank"))
    def hinted(bound):
        df = A.fetch_chunks(hits, chunks, bound)
        return "ResolvedHint" in df._jdf.queryExecution().analyzed().toString()
    assert hinted(10) and not hinted(None) and not hinted(A.BROADCAST_HITS + 1)


def test_question_without_hit(spark, found):
    questions = spark.createDataFrame([(1, "q1"), (9, "q9")], "question_id int, question string")
    asked = A.with_default_context(questions, A.contexts(found))
    rows = {r.question_id: r for r in A.answer_prompts(asked, "m", "Board").collect()}
    assert rows[9].prompt is None and rows[9].payload is None
    assert rows[9].reply == "Mujhe khed hai, par yeh jankari Class 8 Board mein nahi mili."
    assert rows[1].reply is None and rows[1].prompt.endswith("### STUDENT QUESTION:\nq1\n")
    assert json.loads(rows[1].payload)["temperature"] == 0.2


# --- sessions -----------------------------------------------------------------------------


def at(minute):
    return F.lit("2024-01-01 00:00:00").cast("timestamp") + F.make_dt_interval(mins=minute)


@pytest.fixture(scope="module")
def messages(spark):
    said = [
        ("s1", 0, "system", "rules"), ("s1", 1, "user", "first question " + "x" * 50),
        ("s1", 2, "assistant", "one"), ("s1", 3, "user", "two?"), ("s1", 4, "user", "three?"),
        ("s1", 5, "assistant", "two"), ("s1", 6, "user", "four?"),
        ("s2", 0, "assistant", "hello"), ("s2", 1, "user", "hi"), ("s2", 3, "assistant", "yes"),
        ("s3", 0, "system", "only rules"),
    ]
    return spark.createDataFrame(
        said, "session_id string, turn long, role string, content string"
    ).withColumn("user_id", F.lit("u")).withColumn("timestamp", at(F.col("turn").cast("int")))


@pytest.mark.parametrize("hot_rows", [10**6, 3])
def test_pairs(messages, hot_rows):
    got = {(r.session_id, r.turn, r.prompt[:5], r.raw_response)
           for r in S.chat_pairs(messages, hot_rows).collect()}
    assert got == {("s1", 1, "first", "one"), ("s1", 4, "three", "two"), ("s2", 1, "hi", "yes")}


@pytest.mark.parametrize("hot_rows", [10**6, 1])
def test_session_messages(messages, hot_rows):
    log = S.chat_pairs(messages)
    assert {r.user_id for r in log.collect()} == {"u"}
    rows = S.session_messages(log, "turn", hot_rows).where("session_id = 's1'")
    assert [(r.message_no, r.role, r.content[:5]) for r in rows.orderBy("message_no").collect()] == [
        (1, "user", "first"), (2, "assistant", "one"), (3, "user", "three"), (4, "assistant", "two"),
    ]


def test_topics(messages):
    got = {r.session_id: (r.topics, r.n_messages) for r in S.recent_topics(messages).collect()}
    assert got == {"s1": ("two?, three?, four?", 3), "s2": ("hi", 1)}


def test_session_life(spark, messages):
    opened = S.open_sessions(S.first_prompts(messages))
    log = spark.createDataFrame([("s1", 9), ("s1", 7), ("unknown", 3)], "session_id string, m int")
    touched = S.touch_sessions(opened, log.withColumn("timestamp", at(F.col("m"))))
    changes = spark.createDataFrame(
        [("s2", 1, "old"), ("s2", 2, ""), ("nobody", 1, "x")],
        "session_id string, changed_at int, title string",
    )
    state = S.rename_sessions(touched, changes)
    rows = {r.session_id: r for r in state.collect()}
    assert set(rows) == {"s1", "s2"}
    assert (rows["s1"].created_at.minute, rows["s1"].updated_at.minute) == (1, 9)
    assert rows["s2"].updated_at == rows["s2"].created_at and rows["s2"].title == ""
    assert rows["s1"].title == ("first question " + "x" * 50)[:50] + "…"
    shown = {r.session_id: (r.title, r.display_title) for r in
             S.titles(messages.select("session_id").distinct(), state).collect()}
    assert shown["s2"] == shown["s3"] == ("New Chat", "Untitled Chat")
    ranks = [(r.recency_rank, r.session_id) for r in S.by_recency(state, 1).orderBy("recency_rank").collect()]
    assert ranks == [(1, "s1"), (2, "s2")]
    assert [r.session_id for r in S.of_user(state, "u").collect()] == ["s1", "s2"]
    assert S.of_user(state, "x").count() == 0


def test_single_session_reads_are_ordered_and_pushed_down(spark, tmp_path, messages):
    path = str(tmp_path / "log")
    messages.write.parquet(path)
    saved = spark.read.parquet(path)
    for newest in (False, True):
        df = S.of_session(saved, "s1", "timestamp", newest)
        turns = [r.turn for r in df.collect()]
        assert turns == sorted(turns, reverse=newest) and len(turns) == 7
        assert "PushedFilters: [IsNotNull(session_id), EqualTo(session_id,s1)]" in (
            df._jdf.queryExecution().executedPlan().toString())


# --- memory -------------------------------------------------------------------------------


def test_current_memory(spark):
    rows = spark.createDataFrame(
        [("u1", 1, "g1"), ("u1", 5, "g2"), ("u2", 5, "g3")], "user_id string, changed_at int, id string"
    ).withColumn("class_level", F.lit(8))
    grades = R.memory_changes(rows, F.lit("Low"), F.col("id"), 0, F.col("id"))
    reports = R.memory_changes(
        rows.where("id = 'g2'"), F.lit(V.REPORT_BAND), F.lit("report"), 1, F.lit("s"))
    got = {r.user_id: (r.proficiency, r.strong_points, r.weak_points)
           for r in R.current_memory(grades, reports).collect()}
    assert got == {"u1": ("Evaluated", "report", "report"), "u2": ("Low", "g3", "g3")}
    assert R.current_memory(grades).count() == 2


def test_replaced_memory_table(spark, database):
    columns = "user_id string, class_level int, proficiency string, strong_points string, weak_points string"
    before = spark.createDataFrame(
        [("a", 8, "Low", "x", "x"), ("a", 8, "Low", "copy", "copy"), ("b", 9, "High", "y", "y")], columns)
    tables.append(before, database, "user_memory")
    rows = spark.createDataFrame([("a", 1, 10), ("c", 2, 10)], "user_id string, changed_at int, class_level int")
    changes = R.memory_changes(rows, F.lit("Medium"), F.lit("it's new"), 0, F.col("user_id"))
    state = R.replace_memory(spark.table(f"{database}.user_memory"), changes)
    tables.replace(state, database, "user_memory")
    assert {tuple(r) for r in spark.table(f"{database}.user_memory").collect()} == {
        ("a", 10, "Medium", "it's new", "it's new"), ("b", 9, "High", "y", "y"),
        ("c", 10, "Medium", "it's new", "it's new")}


def test_memory_in_one_pass_equals_two_states(spark):
    graded = spark.range(600).select(
        F.col("id").alias("attempt_id"), F.concat(F.lit("u"), F.col("id") % 40).alias("user_id"),
        F.concat(F.lit("s"), F.col("id") % 90).alias("session_id"), (F.col("id") % 40 % 3 + 8).cast("int").alias("class_level"),
        (F.xxhash64("id") % 7).alias("created_at"), F.abs(F.xxhash64("id") % 5).alias("wrong"),
        F.when(F.col("id") % 2 == 0, "Low").otherwise("High").alias("proficiency"),
        F.concat(F.lit("analysis "), "id").alias("analysis"),
    )
    grades = R.memory_changes(
        graded.withColumn("changed_at", F.col("created_at")), F.col("proficiency"), F.col("analysis"), 0, F.col("attempt_id"))
    per_session = graded.where("wrong = 0").groupBy("user_id", "session_id", "class_level").agg(
        F.count("*").alias("n"), F.max("created_at").alias("changed_at"))
    text = lambda n: F.concat_ws(" ", "session_id", n)
    reports = R.memory_changes(per_session, F.lit(V.REPORT_BAND), text("n"), 1, F.col("session_id"))
    two = R.replace_memory(R.current_memory(grades), reports)
    one = R.replaced_in_one_pass(graded, F.col("wrong") == 0, text("n_quizzes"))
    rows = {tuple(r) for r in one.collect()}
    assert rows == {tuple(r) for r in two.collect()} and one.count() == 40
    assert {r[2] for r in rows} > {V.REPORT_BAND}


# --- streams ------------------------------------------------------------------------------

PAIR = ("session_id string, user_id string, prompt string, raw_response string, "
        "log_id string, timestamp timestamp")


def pairs(spark, ids):
    rows = [(f"s{i % 3}", f"u{i % 2}", f"p{i}", f"r{i}", f"l{i}", i) for i in ids]
    return spark.createDataFrame(rows, PAIR.replace("timestamp timestamp", "m int")).select(
        "session_id", "user_id", "prompt", "raw_response", "log_id", at(F.col("m")).alias("timestamp"))


def test_chat_log_stream_goes_on_and_survives_replay(spark, tmp_path):
    source, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    for number, ids in enumerate([range(5), range(5, 12)]):
        pairs(spark, ids).write.mode("append").parquet(source)
        stream = spark.readStream.schema(PAIR).parquet(source)
        chat_log.start_chat_log(stream, out, state).awaitTermination()
    # The last batch again, as after a crash between the writes and the commit.
    commits = sorted((tmp_path / "state" / "commits").glob("[0-9]*"))
    commits[-1].unlink()
    (commits[-1].parent / f".{commits[-1].name}.crc").unlink(missing_ok=True)
    chat_log.start_chat_log(
        spark.readStream.schema(PAIR).parquet(source), out, state).awaitTermination()
    log = chat_log.read_log(spark, out, "raw_chat_history")
    assert sorted(r.prompt for r in log.collect()) == sorted(f"p{i}" for i in range(12))
    names = chat_log.read_log(spark, out, "business_dashboard").groupBy("metric_name").count()
    assert {r.metric_name: r["count"] for r in names.collect()} == {
        "Query Processed for u0": 6, "Query Processed for u1": 6}
    last = {r.session_id: r.updated_at.minute for r in chat_log.session_activity(spark, out).collect()}
    assert last == {"s0": 9, "s1": 10, "s2": 11}


def test_a_batch_is_seen_whole_or_not_at_all(spark, tmp_path, monkeypatch):
    source, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    run = lambda: chat_log.start_chat_log(
        spark.readStream.schema(PAIR).parquet(source), out, state).awaitTermination()
    seen = lambda: {t: chat_log.read_log(spark, out, t).count()
                    for t in ("raw_chat_history", "business_dashboard", "chat_sessions")}
    pairs(spark, range(4)).write.parquet(source)
    run()
    assert seen() == {"raw_chat_history": 4, "business_dashboard": 4, "chat_sessions": 3}
    pairs(spark, range(4, 9)).write.mode("append").parquet(source)
    tables_of = chat_log.log_rows

    def broken(batch):
        rows = tables_of(batch)
        rows["chat_sessions"] = rows["chat_sessions"].withColumn("x", F.raise_error(F.lit("lost")))
        return rows

    monkeypatch.setattr(chat_log, "log_rows", broken)
    with pytest.raises(Exception, match="lost"):
        run()
    # Two of the three outputs of the second batch are written, and none of it is seen.
    assert spark.read.parquet(f"{out}/raw_chat_history").count() == 9
    assert seen() == {"raw_chat_history": 4, "business_dashboard": 4, "chat_sessions": 3}
    monkeypatch.setattr(chat_log, "log_rows", tables_of)
    run()
    assert seen() == {"raw_chat_history": 9, "business_dashboard": 9, "chat_sessions": 6}
    prompts = [r.prompt for r in chat_log.read_log(spark, out, "raw_chat_history").collect()]
    assert sorted(prompts) == [f"p{i}" for i in range(9)]


def test_sketches_of_days_merge_to_the_year(spark):
    seen = spark.range(60_000).select(
        (F.col("id") % 30).alias("day"), F.concat(F.lit("u"), (F.xxhash64("id") % 20_000)).alias("user_id"))
    days = metrics.student_sketches(seen, ["day"])
    everyone = days.withColumn("year", F.lit(2024))
    estimate = metrics.estimated_students(metrics.merged_sketches(everyone, ["year"])).first().students
    exact = seen.select("user_id").distinct().count()
    assert abs(estimate - exact) <= metrics.SKETCH_ERROR * exact
    for r in metrics.estimated_students(days).collect():
        assert abs(r.students - seen.where(F.col("day") == r.day).select("user_id").distinct().count()) <= 60


def test_sketches_of_batches_merge(spark, tmp_path):
    source, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    schema = "user_id string, changed_at timestamp"
    for batch in range(3):
        rows = spark.range(batch * 1000, batch * 1000 + 2000).select(
            F.concat(F.lit("u"), "id").alias("user_id"), at((F.col("id") % 3 * 1440).cast("int")).alias("changed_at"))
        rows.write.mode("append").parquet(source)
        dashboard.start_student_sketches(
            spark.readStream.schema(schema).parquet(source), out, state).awaitTermination()
    assert abs(dashboard.read_students(spark, out, []).first().students - 4000) <= 4000 * metrics.SKETCH_ERROR
    days = dashboard.read_students(spark, out, ["day"]).collect()
    assert len(days) == 3 and all(abs(r.students - 4000 / 3) <= 4000 / 3 * metrics.SKETCH_ERROR + 1 for r in days)


def test_dashboard_stream_counts_on(spark, tmp_path):
    """It runs on what the chat log stream writes, which names no user column."""
    source, changes, log, out = (str(tmp_path / n) for n in ("in", "changes", "log", "out"))
    for n, (ids, wanted) in enumerate([(range(1), (1, 1)), (range(1, 9), (9, 2))]):
        pairs(spark, ids).write.mode("append").parquet(source)
        pairs(spark, ids).select("user_id").write.mode("append").parquet(changes)
        chat_log.start_chat_log(
            spark.readStream.schema(PAIR).parquet(source), log, str(tmp_path / "log-state")
        ).awaitTermination()
        for running in dashboard.start_dashboard(
            spark.readStream.schema(schemas.DASHBOARD).parquet(f"{log}/business_dashboard"),
            spark.readStream.schema("user_id string").parquet(changes), out, str(tmp_path / "state"),
        ):
            running.awaitTermination()
        got = {r.metric: r.value for r in dashboard.read_dashboard(spark, out).collect()}
        assert got == {"total_queries": wanted[0], "unique_students": wanted[1]}


def test_whole_jobs_spread_their_calls(spark, tmp_path):
    folder = str(tmp_path)

    def factory():
        from pyspark import TaskContext

        task = TaskContext.get().partitionId()

        def call(request):
            open(f"{folder}/{task}", "a").close()
            return envelope("reply")

        return call

    asked = spark.createDataFrame([(i, f"q{i}") for i in range(60)], "question_id long, question string")
    found = asked.select(
        "question_id", F.lit(1).alias("rank"), F.lit(8).alias("class_level"), F.lit("book03").alias("chapter"),
        F.lit(4).alias("page_number"), F.lit("text").alias("text_content"),
    )
    answered = tutoring.answer_questions(asked, found, factory, "m", "s", "book", "/b", calls_at_once=2, tasks=7)
    assert answered.where("error IS NULL").count() == 60 and len(list(tmp_path.iterdir())) == 7


def test_null_values_lose_no_block(spark):
    found = spark.createDataFrame(
        [(1, 1, None, "book03", 4, "text"), (1, 2, 8, None, None, "more"), (1, 3, 8, "book04", 5, None)],
        "question_id long, rank int, class_level int, chapter string, page_number int, text_content string",
    )
    row = A.contexts(found).first()
    assert row.n_chunks == 3 and len(row.context.split("[Source: ")) == 4 and "Page None" in row.context
    quizzes = spark.createDataFrame(
        [("s", "a", None), ("s", "b", "good")], "session_id string, quiz_id string, analysis string"
    ).withColumn("created_at", F.lit("2024-01-01").cast("timestamp"))
    report = R.session_reports(quizzes.select("session_id").distinct(), quizzes, "m").first()
    assert report.n_quizzes == 2 and "Quiz 1" in report.prompt and "Quiz 2" in report.prompt


# --- whole jobs ---------------------------------------------------------------------------


def letters():
    return lambda texts: [[float(t.lower().count(x)) for x in "abcdefghijklmnopqrstuvwxyz"] for t in texts]


def envelope(content):
    return json.dumps({"choices": [{"message": {"content": content}}]})


def test_from_documents_to_answers(spark, database, tmp_path):
    write(tmp_path / "books", bk101__pdf=b"aaaa aaa\fbbbb\nbbb", bk102__pdf=b" \fcccc")
    for _ in range(2):
        tutoring.ingest(spark, str(tmp_path / "books"), database,
                        lambda: lambda b: b.decode().split("\f"))
    chunks = spark.table(f"{database}.corpus_chunks").where("chapter like 'bk%'")
    assert {(r.chapter, r.page_number, r.text_content) for r in chunks.collect()} == {
        ("bk101", 1, "aaaa aaa"), ("bk101", 2, "bbbb bbb"), ("bk102", 2, "cccc")}
    vectors = tutoring.build_vectors(chunks, letters, str(tmp_path / "vectors"))
    questions = spark.createDataFrame(
        [(1, "bbbbbb"), (2, "cccc fails")], "question_id long, question string")

    def client():
        def call(request):
            if "cccc fails" in request:
                raise TimeoutError("late")
            return envelope(" answer ")
        return call

    found = tutoring.find_chunks(questions, vectors, chunks, letters, 2)
    answered = tutoring.answer_questions(
        questions, found, client, "m", "Board", "bk1", "/books")
    rows = {r.question_id: r for r in answered.collect()}
    assert rows[1].answer == "answer"
    assert rows[1].sources[0].label == "Class 8 Science — Chapter 01, Page 2"
    assert (rows[2].answer, rows[2].sources, rows[2].error) == (None, None, "TimeoutError: late")


def test_quiz_to_report(spark, messages):
    quiz = '[{"question": "Q1", "options": ["A. x", "B. y"], "answer": "A"}]'
    quizzes = tutoring.generate_quizzes(
        messages, lambda: lambda r: envelope(quiz) if "hi." in r else "broken", "m")
    assert {(r.session_id, r.question_no) for r in quizzes.collect()} == {("s2", 1)}

    heads = spark.createDataFrame(
        [(1, "s2", "u", 8)], "attempt_id int, session_id string, user_id string, class_level int"
    ).withColumn("created_at", F.lit(3))
    answers = quizzes.select(
        F.lit(1).alias("attempt_id"), "question_no", "quiz", F.col("quiz.question").alias("question"),
        F.col("quiz.answer").alias("answer_key"), F.col("quiz.answer").alias("choice"))
    text = "You understand this topic very well."
    evaluated = tutoring.evaluate_attempts(
        heads, answers, [F.col("question_no")], lambda: lambda r: envelope(f"```x``` {text}"), "m")
    row = evaluated.first()
    assert (row.score, row.total, row.wrong, row.proficiency, row.analysis) == (1, 1, 0, "Low", text)
    done = evaluated.withColumn("quiz_id", F.lit("q"))
    sessions = spark.createDataFrame([("s2",), ("s9",)], "session_id string")
    for client, wanted in [(lambda: lambda r: envelope("Report."), "Report."),
                           (lambda: lambda r: r.missing, V.REPORT_FAILED)]:
        reports = tutoring.report_sessions(sessions, done, client, "m")
        got = {r.session_id: (r.n_quizzes, r.report) for r in reports.collect()}
        assert got == {"s2": (1, wanted), "s9": (0, V.NO_QUIZZES)}
    memory = tutoring.update_memory(
        evaluated,
        reports.where("session_id = 's2'").select(
            "session_id", F.lit("u").alias("user_id"), F.lit(8).alias("class_level"),
            F.lit(3).alias("changed_at"), "report"))
    assert [(r.proficiency, r.strong_points) for r in memory.collect()] == [
        ("Evaluated", V.REPORT_FAILED)]
    assert tutoring.update_memory(evaluated).first().proficiency == "Low"


def test_shared_dir_is_the_configured_one(spark):
    assert shared_dir(spark) == spark.conf.get("spark.checkpoint.dir")
