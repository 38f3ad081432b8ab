"""The registered queries: every operator over the whole test tables."""

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern import fixed_values as V
from lectern import schemas
from lectern.cluster import new_shared_path
from lectern.functions import model_text as M
from lectern.functions import text as X
from lectern.operators import corpus as C
from lectern.operators import grading as G
from lectern.operators import hooks as H
from lectern.operators import memory as R
from lectern.operators import metrics
from lectern.operators import lookup as A
from lectern.operators import sessions as S
from lectern.operators.neighbours import nearest
from lectern.plans import inputs as I
from lectern.plans import tutoring
from lectern.sources import chunk_store, files
from lectern.sources.tables import read
from lectern.streaming import chat_log as stream_log
from lectern.streaming import dashboard as stream_metrics

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(function):
    QUERIES[function.__name__] = function
    return function


# --- corpus -------------------------------------------------------------------------------


@query
def chunk_documents(spark, sf):
    return I.chunks(spark, sf)


@query
def chunk_stats(spark, sf):
    return C.chunk_counts(I.pages(spark, sf))


@query
def chapter_page_keys(spark, sf):
    pages = I.pages(spark, sf).withColumn("requested_page", F.col("n_chars") % 9 - 1)
    return C.citations(pages, I.FILE_PREFIX, I.BASE_DIR).select(
        "document_key", "chapter", "chapter_no", "page_number", "pdf_filename", "pdf_path",
        "page_index",
    )


def _chunk_table(spark):
    """A new stored chunk table in the shared folder."""
    path = new_shared_path(spark, "chunks")
    name = path.rsplit("/", 1)[-1].replace("-", "_")
    chunk_store.create_chunk_table(spark, name, buckets=8, path=path)
    return name


@query
def append_new_chunks(spark, sf):
    """The table after an append: labelled documents were loaded before, all are offered now."""
    labelled = read(spark, sf, "labels").select(F.col("doc_id").alias("document_key"))
    earlier = I.pages(spark, sf).join(labelled, "document_key", "left_semi")
    name = _chunk_table(spark)
    chunk_store.append_chunks(C.chunk_pages(earlier, language=F.col("lang")), name)
    added = chunk_store.append_chunks(I.chunks(spark, sf), name)
    is_new = added.select("chunk_id", F.lit(True).alias("is_new"))
    stored = spark.table(name)
    if is_new.count() <= chunk_store.BROADCAST_IDS:
        marked = stored.join(F.broadcast(is_new), "chunk_id", "left")
    else:
        is_new = is_new.withColumn(chunk_store.BLOCK, C.id_block(F.col("chunk_id")))
        marked = chunk_store.join_by_block(stored, is_new, "left")
    return marked.drop(chunk_store.BLOCK).withColumn("is_new", F.coalesce("is_new", F.lit(False)))


def _library(spark, sf):
    """The documents written out as text files; the folder they are in."""
    folder = new_shared_path(spark, "documents")
    files.write_documents(I.document_lines(spark, sf), ["doc_id"], folder)
    return folder


@query
def binary_listing(spark, sf):
    return files.list_documents(spark, _library(spark, sf), ".txt").select("file_name", "length")


@query
def requested_documents(spark, sf):
    """The files that are asked for, some of them not there; no other file is opened."""
    listing = files.list_documents(spark, _library(spark, sf), ".txt")
    loaded = files.load_documents(listing, I.document_requests(spark, sf))
    return loaded.select(
        "request_id", "file_name", "loaded", F.octet_length("content").cast("long").alias("length"),
        F.md5("content").alias("digest"),
    )


def _line_pages():
    return lambda content: content.decode("utf-8").split("\n")


@query
def extract_pages(spark, sf):
    """Documents as bytes; the extractor passed in takes every line for a page."""
    documents = read(spark, sf, "documents").select(
        F.concat(F.lit("doc"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("file_name"),
        F.encode("text", "UTF-8").alias("content"),
    )
    return files.extract_pages(documents, _line_pages)


# --- retrieval ----------------------------------------------------------------------------


def _letter_counts():
    alphabet = "abcdefghijklmnopqrstuvwxyz"
    return lambda texts: [[float(t.count(x)) for x in alphabet] for t in texts]


@query
def embed_texts(spark, sf):
    """Stand-in encoder: the vector of a chunk is its count of each letter a-z."""
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    chunks = I.chunks(spark, sf)
    vectors = H.embed_texts(chunks, "chunk_id", "text_content", _letter_counts, tasks)
    counts = F.transform("embedding", lambda x: x.cast("int").cast("string"))
    return vectors.select("chunk_id", F.array_join(counts, ",").alias("embedding"))


def _hits(spark, sf):
    return nearest(I.vectors(spark, sf), I.questions(spark, sf), V.ANSWER_TOP_K)


def _found(spark, sf):
    asked = I.questions(spark, sf).where(F.col("embedding").isNotNull()).count()
    return A.fetch_chunks(_hits(spark, sf), I.chunks(spark, sf), asked * V.ANSWER_TOP_K)


@query
def knn_topk(spark, sf):
    return _hits(spark, sf).withColumn("distance", F.round("distance", 6))


@query
def retrieve_chunks(spark, sf):
    return _found(spark, sf).withColumn("distance", F.round("distance", 6))


@query
def retrieve_stored(spark, sf):
    """The same from the stored chunk table, as for any number of hits: no text is shuffled."""
    name = _chunk_table(spark)
    chunk_store.append_chunks(I.chunks(spark, sf), name)
    return A.fetch_chunks(_hits(spark, sf), spark.table(name)).withColumn(
        "distance", F.round("distance", 6)
    )


@query
def retrieve_context(spark, sf):
    return A.contexts(_found(spark, sf))


@query
def retrieve_sources(spark, sf):
    return A.sources(_found(spark, sf), I.FILE_PREFIX, I.BASE_DIR)


def _asked_with_context(spark, sf):
    questions = I.questions(spark, sf).select("question_id", "question")
    return A.with_default_context(questions, A.contexts(_found(spark, sf)))


@query
def retrieve_with_default(spark, sf):
    return _asked_with_context(spark, sf)


@query
def answer_prompts(spark, sf):
    return A.answer_prompts(_asked_with_context(spark, sf), I.MODEL, I.SYLLABUS)


# --- chat and sessions --------------------------------------------------------------------


@query
def chat_pairs(spark, sf):
    return S.chat_pairs(I.messages(spark, sf))


@query
def session_messages(spark, sf):
    return S.session_messages(
        I.chat_log(spark, sf), "turn", counted=I.messages(spark, sf)
    )


@query
def session_state(spark, sf):
    return I.sessions(spark, sf)


@query
def session_titles(spark, sf):
    everyone = I.messages(spark, sf).select("session_id").distinct()
    return S.titles(everyone, I.sessions(spark, sf))


@query
def sessions_by_recency(spark, sf):
    return S.by_recency(I.sessions(spark, sf), counted=I.messages(spark, sf)).select(
        "user_id", "recency_rank", "session_id", "title", "created_at", "updated_at",
        "last_active",
    )


@query
def recent_topics(spark, sf):
    return S.recent_topics(I.messages(spark, sf))


@query
def quiz_prompts(spark, sf):
    return G.quiz_prompts(S.recent_topics(I.messages(spark, sf)), I.MODEL)


@query
def format_activity_time(spark, sf):
    value = F.when(F.col("event_type") == "error", F.col("props")).otherwise(
        F.col("ts").cast("string")
    )
    return read(spark, sf, "events").select("event_id", X.activity_time(value).alias("shown"))


@query
def chat_log_fanout(spark, sf):
    """The three table changes of the logged pairs, one below the other."""
    rows = S.log_rows(I.chat_log(spark, sf))
    return (
        rows["raw_chat_history"].select(
            F.lit("raw_chat_history").alias("table_name"), F.col("session_id").alias("row_key"),
            F.concat_ws("|", "user_id", "prompt", "raw_response").alias("row_value"),
            "timestamp",
        )
        .unionByName(rows["business_dashboard"].select(
            F.lit("business_dashboard").alias("table_name"), F.col("log_id").alias("row_key"),
            F.concat_ws("|", "metric_name", "metric_value").alias("row_value"), "timestamp",
        ))
        .unionByName(rows["chat_sessions"].select(
            F.lit("chat_sessions").alias("table_name"), F.col("session_id").alias("row_key"),
            F.lit("").alias("row_value"), F.col("updated_at").alias("timestamp"),
        ))
    )


@query
def dashboard_totals(spark, sf):
    return metrics.dashboard_totals(I.dashboard_log(spark, sf), _memory(spark, sf))


@query
def queries_by_metric(spark, sf):
    return metrics.queries_by_metric(I.dashboard_log(spark, sf))


@query
def students_by_day(spark, sf):
    """Exact distinct users of each day, beside those estimated from sketches per day and event type."""
    seen = read(spark, sf, "events").select(F.to_date("ts").cast("string").alias("day"), "event_type", "user_id")
    exact = seen.groupBy("day").agg(F.countDistinct("user_id").alias("exact"))
    by_type = metrics.student_sketches(seen, ["day", "event_type"])
    estimated = metrics.estimated_students(metrics.merged_sketches(by_type, ["day"]))
    error = F.abs(F.col("students") - F.col("exact"))
    return exact.join(estimated, "day").select(
        "day", F.col("exact").alias("students"),
        (error <= F.col("exact") * metrics.SKETCH_ERROR + 1).alias("estimate_is_close"),
    )


# --- quizzes and report cards -------------------------------------------------------------


@query
def quiz_extract(spark, sf):
    return _flat(G.quiz_questions(I.quiz_replies(spark, sf), "part_id"))


@query
def quiz_relabel(spark, sf):
    return _flat(G.relabelled(G.quiz_questions(I.quiz_replies(spark, sf), "part_id")))


def _flat(questions, key="part_id"):
    quiz = F.col("quiz")
    return questions.select(
        key, "question_no", quiz["question"].alias("question"),
        F.array_join(quiz["options"], " | ").alias("options"), quiz["answer"].alias("answer"),
    )


@query
def grade_quiz(spark, sf):
    return G.grade(I.answers(spark, sf))


@query
def grade_submitted(spark, sf):
    """Grades from parallel lists of different lengths."""
    return G.grade(G.align_answers(I.submitted(spark, sf)))


def _breakdowns(spark, sf):
    return G.breakdowns(I.answers(spark, sf), I.answer_order())


@query
def quiz_breakdown(spark, sf):
    return _breakdowns(spark, sf)


@query
def evaluation_prompts(spark, sf):
    return G.evaluation_prompts(_breakdowns(spark, sf), I.MODEL)


@query
def quiz_history_rows(spark, sf):
    return R.quiz_history_rows(
        I.attempt_heads(spark, sf), I.answers(spark, sf), I.answer_order(), I.analysis()
    )


@query
def session_quizzes(spark, sf):
    quizzes = I.graded(spark, sf).withColumn("quiz_id", F.col("attempt_id").cast("string"))
    return S.session_quizzes(
        quizzes.select("session_id", "quiz_id", "score", "total", "analysis", "created_at"),
        counted=I.attempt_heads(spark, sf),
    )


def _grade_changes(graded):
    return R.memory_changes(
        graded.withColumn("changed_at", F.col("created_at")),
        F.col("proficiency"), F.col("analysis"), 0, F.col("attempt_id"),
    )


def _session_report(n):
    return F.concat(
        F.lit("Session "), F.col("session_id"), F.lit(": "), F.col(n).cast("string"),
        F.lit(" quizzes"),
    )


def _report_changes(graded):
    per_session = graded.groupBy("user_id", "session_id", "class_level").agg(
        F.count("*").alias("n"), F.max("created_at").alias("changed_at")
    )
    return R.memory_changes(
        per_session, F.lit(V.REPORT_BAND), _session_report("n"), 1, F.col("session_id")
    )


def _memory(spark, sf):
    graded = I.graded(spark, sf)
    return R.current_memory(_grade_changes(graded), _report_changes(graded))


@query
def user_memory_current(spark, sf):
    return _memory(spark, sf)


@query
def memory_replaced(spark, sf):
    """Memory after the grades of all attempts, then replaced by reports on perfect ones."""
    return R.replaced_in_one_pass(
        I.graded(spark, sf), F.col("wrong") == 0, _session_report("n_quizzes")
    )


@query
def session_report_input(spark, sf):
    graded = I.graded(spark, sf).withColumn("quiz_id", F.col("attempt_id").cast("string"))
    heads = I.attempt_heads(spark, sf)
    everyone = heads.select("session_id").distinct()
    return R.session_reports(everyone, graded, I.MODEL, counted=heads)


# --- model replies ------------------------------------------------------------------------


@query
def clean_completions(spark, sf):
    message = F.col("message")
    return (
        I.completions(spark, sf)
        .select("doc_id", M.reply_message(F.col("envelope")).alias("message"))
        .select(
            "doc_id",
            M.completion_text(message, V.EMPTY_RESPONSE).alias("answer"),
            M.without_fences(M.completion_text(message, "")).alias("report"),
            M.reply_body(message).alias("body"),
        )
        .select("doc_id", "answer", "report", M.analysis_text(F.col("body")).alias("analysis"))
    )


def _length_client():
    def call(request):
        if len(request) % 5 == 0:
            raise ValueError("no answer")
        return f"{len(request)} characters"

    return call


@query
def complete_prompts(spark, sf):
    """Offline stand-in client over the quiz requests; failing rows get the empty quiz."""
    requests = G.quiz_prompts(S.recent_topics(I.messages(spark, sf)), I.MODEL)
    done = H.complete_prompts(requests, "session_id", "payload", _length_client)
    return done.select(
        "session_id", F.coalesce("response", F.lit(V.EMPTY_QUIZ)).alias("response"), "error"
    )


# --- whole jobs, with stand-ins for the models ---------------------------------------------


def _stub_client():
    """Replies with a text that holds a small quiz; every fifth request length fails."""

    def call(request):
        n = len(request)
        if n % 5 == 0:
            raise ValueError("no answer")
        quiz = f'[{{"question": "Length?", "options": ["A. {n}", "B) {n + 1}", "C. 0"], "answer": "A"}}]'
        message = {"content": f"The request has {n} characters: {quiz}"}
        return json.dumps({"choices": [{"message": message}]})

    return call


@query
def answer_questions(spark, sf):
    """Benchmark texts as questions against the letter counts of all chunks."""
    chunks = I.chunks(spark, sf)
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    path = new_shared_path(spark, "vectors")
    vectors = tutoring.build_vectors(chunks, _letter_counts, path, tasks)
    questions = read(spark, sf, "benchmark").select(
        F.col("item_id").alias("question_id"), F.col("text").alias("question")
    )
    found = tutoring.find_chunks(questions, vectors, chunks, _letter_counts, V.ANSWER_TOP_K)
    answered = tutoring.answer_questions(
        questions, found, _stub_client, I.MODEL, I.SYLLABUS, I.FILE_PREFIX, I.BASE_DIR
    )
    return answered.select(
        "question_id", "answer", F.coalesce(F.size("sources"), F.lit(0)).alias("n_sources"),
        F.col("sources")[0]["label"].alias("first_source"), "error",
    )


@query
def generate_quizzes(spark, sf):
    quizzes = tutoring.generate_quizzes(I.messages(spark, sf), _stub_client, I.MODEL)
    return _flat(quizzes, "session_id")


@query
def evaluate_attempts(spark, sf):
    evaluated = tutoring.evaluate_attempts(
        I.attempt_heads(spark, sf), I.answers(spark, sf), I.answer_order(), _stub_client, I.MODEL
    )
    return evaluated.select("attempt_id", "user_id", "score", "total", "proficiency", "analysis")


@query
def report_sessions(spark, sf):
    graded = I.graded(spark, sf).withColumn("quiz_id", F.col("attempt_id").cast("string"))
    heads = I.attempt_heads(spark, sf)
    everyone = heads.select("session_id").distinct()
    return tutoring.report_sessions(everyone, graded, _stub_client, I.MODEL, heads)


# --- streams ------------------------------------------------------------------------------


def _streamed_log(spark, sf):
    """Send the logged pairs through the chat log stream; the folder it wrote to."""
    source, out = new_shared_path(spark, "pairs"), new_shared_path(spark, "log")
    I.chat_log(spark, sf).write.parquet(source)
    schema = spark.read.parquet(source).schema
    stream_log.start_chat_log(
        spark.readStream.schema(schema).parquet(source), out, new_shared_path(spark, "state")
    ).awaitTermination()
    return out


@query
def stream_chat_log(spark, sf):
    """The metric rows written by the stream."""
    return stream_log.read_log(spark, _streamed_log(spark, sf), "business_dashboard").select(
        *schemas.DASHBOARD.fieldNames()
    )


@query
def stream_history(spark, sf):
    """The chat history written by the same stream."""
    return stream_log.read_log(spark, _streamed_log(spark, sf), "raw_chat_history").select(
        *schemas.CHAT_HISTORY.fieldNames()
    )


@query
def stream_sessions(spark, sf):
    """Last activity per session after the same stream."""
    return stream_log.session_activity(spark, _streamed_log(spark, sf))


@query
def stream_students(spark, sf):
    """Distinct users of the memory changes, exact and from the sketches of a stream's batches."""
    source, out = new_shared_path(spark, "changes"), new_shared_path(spark, "sketches")
    changes = _grade_changes(I.graded(spark, sf)).select("user_id", "changed_at")
    changes.write.parquet(source)
    stored = spark.read.parquet(source)
    stream_metrics.start_student_sketches(
        spark.readStream.schema(stored.schema).parquet(source), out, new_shared_path(spark, "state")
    ).awaitTermination()
    estimated = stream_metrics.read_students(spark, out, [])
    exact = stored.agg(F.countDistinct("user_id").alias("exact"))
    both = exact.unionByName(estimated, allowMissingColumns=True)
    both = both.agg(F.max("exact").alias("exact"), F.max("students").alias("students"))
    error = F.abs(F.col("students") - F.col("exact"))
    return both.select(
        F.col("exact").alias("students"),
        (error <= F.col("exact") * metrics.SKETCH_ERROR + 1).alias("estimate_is_close"),
    )


@query
def stream_dashboard(spark, sf):
    """Log rows and memory changes as streams; their counters at the end."""
    log, changes = new_shared_path(spark, "log"), new_shared_path(spark, "changes")
    I.dashboard_log(spark, sf).write.parquet(log)
    graded = I.graded(spark, sf)
    _grade_changes(graded).select("user_id").write.parquet(changes)
    streams = [
        spark.readStream.schema(spark.read.parquet(path).schema).parquet(path)
        for path in (log, changes)
    ]
    out = new_shared_path(spark, "metrics")
    for running in stream_metrics.start_dashboard(*streams, out, new_shared_path(spark, "state")):
        running.awaitTermination()
    return stream_metrics.read_dashboard(spark, out)
