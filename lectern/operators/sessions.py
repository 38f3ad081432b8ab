"""Chat logs, sessions and their histories."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern import fixed_values as V
from lectern.functions import text as X
from lectern.functions.quizzes import score_label
from lectern.operators.ordering import (
    HOT_GROUP_ROWS, first_rows, latest_per_key, number_rows, with_next,
)


def chat_pairs(messages: DataFrame, hot_rows: int = HOT_GROUP_ROWS) -> DataFrame:
    """``(session_id, user_id, turn, prompt, raw_response, timestamp)``: a user message, with its
    user and time, and the reply right after it.

    ``messages`` is ``(session_id, user_id, turn, role, content, timestamp)``, unique by session
    and turn.
    """
    following = with_next(
        messages.select("session_id", "user_id", "turn", "role", "content", "timestamp"),
        ["session_id"],
        [F.col("turn")], {"role": "_next_role", "content": "raw_response"}, hot_rows,
    )
    return following.where(
        (F.col("role") == "user") & (F.col("_next_role") == "assistant")
    ).select(
        "session_id", "user_id", "turn", F.col("content").alias("prompt"), "raw_response", "timestamp"
    )


def session_messages(
    chat_log: DataFrame, tie_break: str, hot_rows: int = HOT_GROUP_ROWS,
    counted: DataFrame | None = None,
) -> DataFrame:
    """Two role rows per logged pair, numbered oldest first within the session.

    ``counted`` here and below as in ``ordering.split_hot``.
    """
    numbered = number_rows(
        chat_log, ["session_id"], [F.col("timestamp"), F.col(tie_break)], "_pair", hot_rows,
        counted,
    )
    def message(second: int, role: str, content: str):
        return F.struct(
            F.lit(second).alias("_second"), F.lit(role).alias("role"),
            F.col(content).alias("content"),
        )

    roles = F.inline(
        F.array(message(1, "user", "prompt"), message(2, "assistant", "raw_response"))
    )
    return numbered.select("session_id", "_pair", roles).select(
        "session_id", ((F.col("_pair") - 1) * 2 + F.col("_second")).alias("message_no"),
        "role", "content",
    )


def first_prompts(messages: DataFrame) -> DataFrame:
    """First user message per session: it opens the session and names it."""
    return latest_per_key(
        messages.where(F.col("role") == "user"), ["session_id"], [F.col("turn")]
    )


def open_sessions(firsts: DataFrame) -> DataFrame:
    """Session rows from first prompts ``(session_id, user_id, content, timestamp)``."""
    return firsts.select(
        "session_id", "user_id", X.title_of(F.col("content")).alias("title"),
        F.col("timestamp").alias("created_at"), F.col("timestamp").alias("updated_at"),
    )


def touch_sessions(sessions: DataFrame, chat_log: DataFrame) -> DataFrame:
    """``updated_at`` moves to the last logged pair; log rows of unknown sessions do nothing."""
    last = chat_log.groupBy("session_id").agg(F.max("timestamp").alias("_last"))
    return sessions.join(last, "session_id", "left").withColumn(
        "updated_at", F.greatest("updated_at", "_last")
    ).select(*sessions.columns)


def rename_sessions(sessions: DataFrame, changes: DataFrame) -> DataFrame:
    """Latest title change ``(session_id, changed_at, title)`` wins; ``updated_at`` stays."""
    newest = latest_per_key(
        changes.select("session_id", "changed_at", F.col("title").alias("_title")),
        ["session_id"], [F.col("changed_at").desc(), F.col("_title").desc()],
    )
    return sessions.join(newest, "session_id", "left").withColumn(
        "title", F.coalesce("_title", "title")
    ).select(*sessions.columns)


def titles(session_ids: DataFrame, sessions: DataFrame) -> DataFrame:
    """Heading and list title of every requested session, known or not."""
    known = sessions.select("session_id", "title")
    return session_ids.join(known, "session_id", "left").select(
        "session_id", X.or_if_empty(F.col("title"), V.NEW_CHAT).alias("title"),
        X.display_title(F.col("title")).alias("display_title"),
    )


def by_recency(
    sessions: DataFrame, hot_rows: int = HOT_GROUP_ROWS, counted: DataFrame | None = None
) -> DataFrame:
    """Sessions numbered per user, most recently active first."""
    return number_rows(
        sessions, ["user_id"], [F.col("updated_at").desc(), F.col("session_id")],
        "recency_rank", hot_rows, counted,
    ).withColumn("last_active", X.activity_time(F.col("updated_at")))


def of_user(sessions: DataFrame, user_id: str) -> DataFrame:
    """One user's sessions, most recent first; the filter reaches the scan."""
    return sessions.where(F.col("user_id") == user_id).orderBy(F.col("updated_at").desc())


def recent_topics(messages: DataFrame) -> DataFrame:
    """Last three user messages per session in original order, as one text."""
    last = first_rows(
        messages.where(F.col("role") == "user").select("session_id", "turn", "content"),
        ["session_id"], [F.col("turn").desc()], V.TOPIC_MESSAGES, "_n",
    )
    rows = F.sort_array(F.collect_list(F.struct("turn", "content")))
    return last.groupBy("session_id").agg(
        F.array_join(rows.getField("content"), V.TOPIC_SEPARATOR).alias("topics"),
        F.count("*").cast("int").alias("n_messages"),
    )


def session_quizzes(
    quizzes: DataFrame, hot_rows: int = HOT_GROUP_ROWS, counted: DataFrame | None = None
) -> DataFrame:
    """Quiz attempts numbered per session, newest first, with their ``score/total`` label."""
    return number_rows(
        quizzes, ["session_id"], [F.col("created_at").desc(), F.col("quiz_id")],
        "attempt_rank", hot_rows, counted,
    ).withColumn("score_label", score_label(F.col("score"), F.col("total"))).withColumn(
        "taken", X.activity_time(F.col("created_at"))
    )


def log_rows(pairs: DataFrame) -> dict[str, DataFrame]:
    """One batch of chat pairs as rows for the tables it changes.

    ``pairs`` is ``(session_id, user_id, prompt, raw_response, timestamp, log_id)``. Keys are
    table names: two appends and the last activity per session.
    """
    return {
        "raw_chat_history": pairs.select(
            "session_id", "user_id", "prompt", "raw_response", "timestamp"
        ),
        "business_dashboard": pairs.select(
            "log_id", X.metric_name(F.col("user_id")).alias("metric_name"),
            F.lit(V.METRIC_VALUE).alias("metric_value"), "timestamp",
        ),
        "chat_sessions": pairs.groupBy("session_id").agg(F.max("timestamp").alias("updated_at")),
    }


def of_session(rows: DataFrame, session_id: str, time: str, newest_first: bool) -> DataFrame:
    """One session's log or quiz rows in time order; the filter reaches the scan."""
    order = F.col(time).desc() if newest_first else F.col(time).asc()
    return rows.where(F.col("session_id") == session_id).orderBy(order)
