"""Quiz extraction, grading, breakdowns and evaluation prompts."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern import fixed_values as V
from lectern.functions import quizzes as Q
from lectern.functions import model_text as M
from lectern.functions.model_text import request_payload
from lectern.functions.text import fill
from lectern.operators.ordering import HOT_GROUP_BYTES, HOT_GROUP_ROWS, ordered_concat


def quiz_prompts(topics: DataFrame, model: str) -> DataFrame:
    """Quiz request per session from its ``topics`` text."""
    return topics.withColumn("prompt", fill(V.QUIZ_PROMPT, topics=F.col("topics"))).select(
        "session_id", "prompt",
        request_payload(F.col("prompt"), model, V.QUIZ_TEMPERATURE).alias("payload"),
    )


def quiz_questions(replies: DataFrame, key: str, reply: str = "reply") -> DataFrame:
    """One row per question of each raw reply: ``(key, question_no, quiz)``."""
    return (
        replies.select(key, M.quiz_json(F.col(reply)).alias("_json"))
        .withColumn("_records", M.quiz_records(F.col("_json")))
        .withColumn("_records", M.whole_quiz(F.col("_records")))
        # posexplode_outer: the inferred filter of a plain one would parse the reply again.
        .select(key, F.posexplode_outer("_records").alias("p", "quiz"))
        .where(F.col("p").isNotNull())
        .select(key, (F.col("p") + 1).alias("question_no"), "quiz")
    )


def relabelled(questions: DataFrame) -> DataFrame:
    """Put the options of each ``quiz`` record in a fixed mixed order with new letters.

    The order depends on question and option text only, so every run gives the same quiz, and
    the key follows its option. A record with fewer than two options, without an answer or
    without an option starting with it stays as it is.
    """
    quiz = F.col("quiz")
    relabelled_quiz = F.struct(
        quiz["question"].alias("question"), Q.lettered(F.col("_mixed")).alias("options"),
        Q.letter_of(F.col("_mixed"), F.col("_raw")).alias("answer"),
    )
    return (
        questions.withColumn("_correct", Q.correct_option(quiz))
        .withColumn("_raw", Q.without_prefix(F.col("_correct")))
        .withColumn("_mixed", F.when(F.col("_correct").isNotNull(), Q.mixed_options(quiz)))
        .withColumn("quiz", F.when(F.col("_correct").isNotNull(), relabelled_quiz).otherwise(quiz))
        .drop("_correct", "_raw", "_mixed")
    )


def align_answers(attempts: DataFrame) -> DataFrame:
    """Rows ``(…, question_no, question, choice, answer_key)`` from three parallel arrays.

    The question side leads: a missing answer counts as not given, surplus answers are ignored.
    """
    kept = [c for c in attempts.columns if c not in ("questions", "choices", "answer_keys")]
    return attempts.select(
        *kept, "choices", "answer_keys", F.posexplode("questions").alias("p", "question")
    ).select(
        *kept, (F.col("p") + 1).alias("question_no"), "question",
        F.get("choices", F.col("p")).alias("choice"),
        F.get("answer_keys", F.col("p")).alias("answer_key"),
    )


def grade(answers: DataFrame, attempt: str = "attempt_id") -> DataFrame:
    """Score, total, wrong count and band per attempt.

    Plain counts: combined on the map side, so a hot attempt is one partial row per task.
    """
    right = Q.is_correct(F.col("choice"), F.col("answer_key"))
    return (
        answers.groupBy(attempt)
        .agg(
            F.count_if(right).cast("int").alias("score"),
            F.count("*").cast("int").alias("total"),
        )
        .withColumn("wrong", F.col("total") - F.col("score"))
        .withColumn("proficiency", Q.proficiency(F.col("score")))
    )


def bytes_of(*texts: Column) -> Column:
    """Bytes of some texts of a row; a null has none."""
    sizes = [F.coalesce(F.octet_length(text), F.lit(0)).cast("long") for text in texts]
    return sum(sizes[1:], sizes[0])


def breakdowns(
    answers: DataFrame, order, attempt: str = "attempt_id", hot_rows: int = HOT_GROUP_ROWS,
    hot_bytes: int = HOT_GROUP_BYTES,
) -> DataFrame:
    """Ordered question-by-question text per attempt, with score, total and wrong count.

    Question numbers follow ``order``. Score and text come from one pass over the answers.
    """
    line = Q.breakdown_line(
        F.col("_n"), F.col("_right"), F.col("question"), F.col("choice"), F.col("answer_key")
    )
    marked = answers.withColumn("_right", Q.is_correct(F.col("choice"), F.col("answer_key")))
    return ordered_concat(
        marked, [attempt], order, V.BLOCK_SEPARATOR,
        {"breakdown": line}, {"score": F.col("_right").cast("int")}, hot_rows, hot_bytes,
        text_bytes=bytes_of(F.col("question"), F.col("choice"), F.col("answer_key")),
    ).select(
        attempt, "breakdown", F.col("score").cast("int").alias("score"),
        F.col("rows").cast("int").alias("total"),
        (F.col("rows") - F.col("score")).cast("int").alias("wrong"),
    )


def evaluation_prompts(broken_down: DataFrame, model: str, attempt: str = "attempt_id"):
    values = {c: F.col(c) for c in ("score", "total", "breakdown")}
    prompt = F.when(F.col("wrong") == 0, fill(V.PERFECT_SCORE_PROMPT, **values)).otherwise(
        fill(V.EVALUATION_PROMPT, **values)
    )
    return broken_down.withColumn("prompt", prompt).select(
        attempt, "prompt",
        request_payload(F.col("prompt"), model, V.EVALUATION_TEMPERATURE).alias("payload"),
    )
