"""Report cards: quiz history rows, one current memory row per user, session reports."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern import fixed_values as V
from lectern import schemas
from lectern.functions import quizzes as Q
from lectern.functions.model_text import request_payload
from lectern.functions.text import fill, shown
from lectern.operators.grading import bytes_of
from lectern.operators.ordering import (
    HOT_GROUP_BYTES, HOT_GROUP_ROWS, latest_per_key, ordered_concat,
)

# An analysis is a model's reply, of at most so many tokens of a few bytes each; a session with more
# quizzes than this may be hot by its bytes.
HOT_SESSION_QUIZZES = HOT_GROUP_BYTES // (4 * V.MAX_TOKENS)


def _json_items(values: Column) -> Column:
    """JSON texts of an array's values: the JSON array without its brackets."""
    text = F.to_json(values, {"ignoreNullFields": "false"})
    return F.regexp_extract(text, r"(?s)^\[(.*)\]$", 1)


def _json_list(joined: str) -> Column:
    return F.concat(F.lit("["), F.col(joined), F.lit("]"))


def quiz_history_rows(
    attempts: DataFrame, answers: DataFrame, order, analysis: Column | None = None,
    hot_rows: int = HOT_GROUP_ROWS, hot_bytes: int = HOT_GROUP_BYTES,
) -> DataFrame:
    """History rows with score, total, and questions, answers and keys as JSON text, in question order.

    ``attempts`` has one row per attempt; ``answers`` one row per question with a ``quiz`` record and
    the ``choice`` made, and one pass over it gives lists and grade alike. ``analysis`` may use
    ``score``, ``total`` and ``proficiency``; without it the attempts have that column. The same
    analysis fills both point columns.
    """
    quiz = F.col("quiz")
    right = Q.is_correct(F.col("choice"), quiz["answer"]).cast("int")
    lists = ordered_concat(
        answers, ["attempt_id"], order, ",",
        {"questions": quiz, "user_answers": F.col("choice"), "correct_answers": quiz["answer"]},
        {"score": right}, hot_rows, hot_bytes, as_text=_json_items,
        text_bytes=bytes_of(
            quiz["question"], F.array_join(quiz["options"], ""), quiz["answer"], F.col("choice")
        ),
    )
    graded = lists.withColumns(
        {"score": F.col("score").cast("int"), "total": F.col("rows").cast("int")}
    ).withColumn("proficiency", Q.proficiency(F.col("score")))
    own = [c for c in attempts.columns if c not in ("score", "total", "proficiency")]
    return (
        attempts.select(*own).join(graded, "attempt_id")
        .withColumn("analysis", F.col("analysis") if analysis is None else analysis)
        .select(
            F.sha2(F.col("attempt_id").cast("string"), 256).alias("quiz_id"),
            "session_id", "user_id",
            _json_list("questions").alias("questions"),
            _json_list("user_answers").alias("user_answers"),
            _json_list("correct_answers").alias("correct_answers"),
            "score", "total",
            F.col("analysis").alias("strong_point"), F.col("analysis").alias("weak_point"),
            "created_at",
        )
    )


def memory_changes(
    rows: DataFrame, proficiency: Column, analysis: Column, change_rank: int, change_id: Column
) -> DataFrame:
    """Memory rows with the order in which they took effect."""
    return rows.select(
        "user_id", "class_level", proficiency.alias("proficiency"),
        analysis.alias("strong_points"), analysis.alias("weak_points"),
        "changed_at", F.lit(change_rank).alias("change_rank"),
        change_id.cast("string").alias("change_id"),
    )


def current_memory(*changes: DataFrame) -> DataFrame:
    """One row per user: the last change wins, a session report before a grade at equal time."""
    every = changes[0]
    for more in changes[1:]:
        every = every.unionByName(more)
    order = [F.col(c).desc() for c in ("changed_at", "change_rank", "change_id")]
    return latest_per_key(every, ["user_id"], order).drop("change_rank", "change_id")


def replace_memory(memory: DataFrame, *changes: DataFrame) -> DataFrame:
    """Memory table after the changes: changed users get their last change, others stay."""
    columns = schemas.USER_MEMORY.fieldNames()
    latest = current_memory(*changes).select(*columns)
    kept = memory.select(*columns).join(latest.select("user_id"), "user_id", "left_anti")
    return kept.unionByName(latest)


def replaced_in_one_pass(
    graded: DataFrame, reported: Column, report: Column, n_quizzes: str = "n_quizzes"
) -> DataFrame:
    """Memory after all grades and then the session reports, from one pass over the graded attempts.

    Equal to ``replace_memory`` of ``current_memory`` of the grades by one report per session: a
    session with attempts that meet ``reported`` reports at its last one. ``report`` may use the
    session's columns and ``n_quizzes``, how many it reports on. Per session the last grade and
    the report come out of one aggregate; per user a report stands before any grade.
    """
    at = F.when(reported, F.col("created_at"))
    sessions = graded.groupBy("user_id", "session_id", "class_level").agg(
        F.max_by(
            F.struct("proficiency", "analysis"),
            F.struct("created_at", F.col("attempt_id").cast("string")),
        ).alias("_grade"),
        F.max(F.struct("created_at", F.col("attempt_id").cast("string").alias("id"))).alias("_last"),
        F.count(at).alias(n_quizzes), F.max(at).alias("_reported_at"),
    )

    def state(phase, proficiency, points, changed_at, change_id):
        return F.struct(
            F.lit(phase).alias("_phase"), changed_at.alias("changed_at"), change_id.alias("change_id"),
            proficiency.alias("proficiency"), points.alias("strong_points"),
        )

    graded_state = state(
        0, F.col("_grade.proficiency"), F.col("_grade.analysis"), F.col("_last.created_at"),
        F.col("_last.id"),
    )
    reported_state = state(
        1, F.lit(V.REPORT_BAND), report, F.col("_reported_at"), F.col("session_id").cast("string")
    )
    states = F.when(F.col(n_quizzes) > 0, F.array(graded_state, reported_state)).otherwise(
        F.array(graded_state)
    )
    rows = sessions.select("user_id", "class_level", F.inline(states)).withColumn(
        "weak_points", F.col("strong_points")
    )
    order = [F.col(c).desc() for c in ("_phase", "changed_at", "change_id")]
    return latest_per_key(rows, ["user_id"], order).select(*schemas.USER_MEMORY.fieldNames())


def session_reports(
    sessions: DataFrame, quizzes: DataFrame, model: str, hot_rows: int = HOT_SESSION_QUIZZES,
    counted: DataFrame | None = None, hot_bytes: int = HOT_GROUP_BYTES,
) -> DataFrame:
    """Report prompt and request per session from its evaluations, oldest first.

    ``quizzes`` is ``(session_id, quiz_id, analysis, created_at)``. Sessions without a quiz get
    the fixed reply instead of a prompt. ``counted`` as in ``ordering.split_hot``; without it the
    bytes of the evaluations are measured too, with it ``hot_rows`` stands for them.
    """
    line = fill(V.QUIZ_OUTPUT, quiz_no=F.col("_n"), analysis=shown(F.col("analysis")))
    evaluations = ordered_concat(
        quizzes, ["session_id"], [F.col("created_at"), F.col("quiz_id")], V.BLOCK_SEPARATOR,
        {"evaluations": line}, None, hot_rows, hot_bytes, counted=counted,
        text_bytes=None if counted is not None else bytes_of(F.col("analysis")),
    )
    prompt = fill(V.REPORT_PROMPT, evaluations=F.col("evaluations"))
    return (
        sessions.join(evaluations, "session_id", "left")
        .withColumn("prompt", prompt)
        .select(
            "session_id",
            F.coalesce("rows", F.lit(0)).alias("n_quizzes"),
            "prompt",
            F.when(F.col("rows").isNull(), F.lit(V.NO_QUIZZES)).alias("reply"),
            request_payload(F.col("prompt"), model, V.REPORT_TEMPERATURE).alias("payload"),
        )
    )
