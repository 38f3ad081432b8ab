"""Whole jobs: corpus build, answering, quizzes, grading and session reports.

Model calls are slow and do not repeat exactly, so their results are written to the shared
folder once and every later step reads them from there.
"""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern import fixed_values as V
from lectern.cluster import cut_lineage
from lectern.functions import model_text as M
from lectern.functions.quizzes import proficiency
from lectern.operators import corpus, grading, hooks, lookup, memory
from lectern.operators.neighbours import nearest
from lectern.operators.sessions import recent_topics
from lectern.sources import files, tables


def ingest(
    spark: SparkSession, directory: str, database: str, extractor_factory: Callable,
    suffix: str = V.DOCUMENT_SUFFIX, class_level: int = V.CLASS_LEVEL,
    language: str = V.LANGUAGE,
) -> None:
    """Documents of a directory to the chunk table; a second run adds only what is new."""
    listing = files.list_documents(spark, directory, suffix)
    pages = files.extract_pages(listing, extractor_factory).withColumn(
        "document_key", F.col("file_name")
    )
    tables.append_chunks(corpus.chunk_pages(pages, class_level, language), database)


def build_vectors(
    chunks: DataFrame, encoder_factory: Callable, path: str, tasks: int | None = None
) -> DataFrame:
    """Encode every chunk, persist the vectors and return them as read back.

    ``tasks`` here and in ``find_chunks`` as in ``hooks.embed_texts``.
    """
    vectors = hooks.embed_texts(chunks, "chunk_id", "text_content", encoder_factory, tasks)
    tables.write_vectors(vectors, path)
    return tables.read_vectors(chunks.sparkSession, path)


def find_chunks(
    questions: DataFrame, vectors: DataFrame, chunks: DataFrame, encoder_factory: Callable,
    k: int = V.TOP_K, tasks: int | None = None,
) -> DataFrame:
    """Ranked chunks of ``(question_id, question)``, encoded like the corpus.

    At most k rows per question; written once, because contexts and sources both read them.
    """
    encoded = cut_lineage(
        hooks.embed_texts(questions, "question_id", "question", encoder_factory, tasks)
    )
    hits = nearest(vectors, encoded, k)
    return cut_lineage(lookup.fetch_chunks(hits, chunks, encoded.count() * k))


def answer_questions(
    questions: DataFrame, found: DataFrame, client_factory: Callable, model: str,
    syllabus: str, prefix: str, base_dir: str, calls_at_once: int = 8, tasks: int | None = None,
) -> DataFrame:
    """``(question_id, answer, sources, error)`` from the ranked chunks of each question.

    ``calls_at_once`` and ``tasks`` here and below as in ``hooks.complete_prompts``.

    Without a hit the answer is the fixed reply. Failed calls have no answer but an ``error``;
    neither has sources.
    """
    asked = lookup.with_default_context(
        questions.select("question_id", "question"), lookup.contexts(found)
    )
    requests = lookup.answer_prompts(asked, model, syllabus)
    done = cut_lineage(
        hooks.complete_prompts(requests, "question_id", "payload", client_factory, calls_at_once, tasks)
    )
    text = M.completion_text(F.col("message"), V.EMPTY_RESPONSE)
    answered = done.withColumn("message", M.reply_message(F.col("response"))).select(
        "question_id", "error", F.when(F.col("error").isNull(), text).alias("answer")
    )
    cited = lookup.source_lists(lookup.sources(found, prefix, base_dir))
    return (
        requests.select("question_id", "reply")
        .join(answered, "question_id", "left").join(cited, "question_id", "left")
        .select(
            "question_id", F.coalesce("answer", "reply").alias("answer"),
            F.when(F.col("answer").isNotNull(), F.col("sources")).alias("sources"), "error",
        )
    )


def generate_quizzes(
    messages: DataFrame, client_factory: Callable, model: str, calls_at_once: int = 8,
    tasks: int | None = None,
) -> DataFrame:
    """``(session_id, question_no, quiz)`` for every session that asked something.

    A failed call or an unreadable reply leaves its session without questions.
    """
    requests = grading.quiz_prompts(recent_topics(messages), model)
    done = cut_lineage(
        hooks.complete_prompts(requests, "session_id", "payload", client_factory, calls_at_once, tasks)
    )
    replies = done.withColumn("message", M.reply_message(F.col("response"))).withColumn(
        "reply", M.completion_text(F.col("message"), V.EMPTY_QUIZ)
    )
    return grading.relabelled(grading.quiz_questions(replies, "session_id"))


def evaluate_attempts(
    attempts: DataFrame, answers: DataFrame, order, client_factory: Callable, model: str,
    calls_at_once: int = 8, tasks: int | None = None,
) -> DataFrame:
    """Attempts with score, total, wrong count, band and evaluation paragraph.

    Prompts and grades come from the same breakdowns, written once.
    """
    broken_down = cut_lineage(grading.breakdowns(answers, order))
    requests = grading.evaluation_prompts(broken_down, model)
    done = cut_lineage(
        hooks.complete_prompts(requests, "attempt_id", "payload", client_factory, calls_at_once, tasks)
    )
    analysis = (
        done.withColumn("message", M.reply_message(F.col("response")))
        .withColumn("body", M.reply_body(F.col("message")))
        .select("attempt_id", M.analysis_text(F.col("body")).alias("analysis"))
    )
    grades = broken_down.select(
        "attempt_id", "score", "total", "wrong", proficiency(F.col("score")).alias("proficiency")
    )
    return attempts.join(grades, "attempt_id").join(analysis, "attempt_id")


def update_memory(evaluated: DataFrame, reports: DataFrame | None = None) -> DataFrame:
    """Current memory rows after grades and, where given, session reports.

    ``reports`` is ``(session_id, user_id, class_level, changed_at, report)``.
    """
    changes = [
        memory.memory_changes(
            evaluated.withColumn("changed_at", F.col("created_at")), F.col("proficiency"),
            F.col("analysis"), 0, F.col("attempt_id"),
        )
    ]
    if reports is not None:
        changes.append(
            memory.memory_changes(
                reports, F.lit(V.REPORT_BAND), F.col("report"), 1, F.col("session_id")
            )
        )
    return memory.current_memory(*changes)


def report_sessions(
    sessions: DataFrame, quizzes: DataFrame, client_factory: Callable, model: str,
    counted: DataFrame | None = None, calls_at_once: int = 8, tasks: int | None = None,
) -> DataFrame:
    """``(session_id, n_quizzes, report)``; fixed texts for no quiz and for a failed call.

    ``counted`` as in ``ordering.split_hot``.
    """
    requests = memory.session_reports(sessions, quizzes, model, counted=counted)
    done = cut_lineage(
        hooks.complete_prompts(requests, "session_id", "payload", client_factory, calls_at_once, tasks)
    )
    message = F.col("message")
    report = F.when(
        message.isNotNull(), M.without_fences(M.completion_text(message, ""))
    ).otherwise(F.lit(V.REPORT_FAILED))
    reported = done.withColumn("message", M.reply_message(F.col("response"))).select(
        "session_id", report.alias("report")
    )
    return requests.select("session_id", "n_quizzes", "reply").join(
        reported, "session_id", "left"
    ).select("session_id", "n_quizzes", F.coalesce("report", "reply").alias("report"))
