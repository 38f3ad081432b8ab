"""Column layouts of the persisted tables and of the nested records in them."""

from pyspark.sql import types as T

_S, _I, _TS = T.StringType(), T.IntegerType(), T.TimestampType()


def _table(**columns) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in columns.items()])


CHUNKS = T.StructType(
    [T.StructField("chunk_id", _S, nullable=False)]
    + _table(class_level=_I, language=_S, chapter=_S, page_number=_I, text_content=_S).fields
)
USER_MEMORY = _table(
    user_id=_S, class_level=_I, proficiency=_S, strong_points=_S, weak_points=_S
)
CHAT_HISTORY = _table(session_id=_S, user_id=_S, prompt=_S, raw_response=_S, timestamp=_TS)
DASHBOARD = _table(log_id=_S, metric_name=_S, metric_value=_S, timestamp=_TS)
CHAT_SESSIONS = _table(session_id=_S, user_id=_S, title=_S, created_at=_TS, updated_at=_TS)
QUIZ_HISTORY = _table(
    quiz_id=_S, session_id=_S, user_id=_S, questions=_S, user_answers=_S, correct_answers=_S,
    score=_I, total=_I, strong_point=_S, weak_point=_S, created_at=_TS,
)
VECTORS = _table(chunk_id=_S, embedding=T.ArrayType(T.FloatType()))

# Tables filled by use; a reset empties these and keeps the corpus.
DYNAMIC_TABLES = {
    "user_memory": USER_MEMORY,
    "raw_chat_history": CHAT_HISTORY,
    "business_dashboard": DASHBOARD,
    "chat_sessions": CHAT_SESSIONS,
    "quiz_history": QUIZ_HISTORY,
}

QUIZ = T.ArrayType(_table(question=_S, options=T.ArrayType(_S), answer=_S))
COMPLETION = _table(
    choices=T.ArrayType(_table(message=_table(content=_S, reasoning_content=_S)))
)
