"""Tutoring tables derived from the generic test tables.

Every function reads whole tables with the columns it needs and derives rows by expression
only, so its work grows with the tables. The SQL twins live in ``oracles.py``.
"""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.functions import text as X
from lectern.operators import corpus as C
from lectern.operators import grading as G
from lectern.operators import sessions as S
from lectern.operators.ordering import number_rows
from lectern.sources.tables import read

# Names used by the derived data; a deployment passes its own.
MODEL = "tutor-model"
SYLLABUS = "syllabus"
FILE_PREFIX = "bk1"
BASE_DIR = "/books"

QUIZ_FIELDS = T.StructType(
    [
        T.StructField("question", T.StringType()),
        T.StructField("options", T.ArrayType(T.StringType())),
        T.StructField("answer", T.StringType()),
    ]
)


def _letter(number: Column) -> Column:
    return F.substring(F.lit("ABCD"), (number % 4 + 1).cast("int"), F.lit(1))


def _text(value: str | Column) -> Column:
    return (F.col(value) if isinstance(value, str) else value).cast("string")


# --- corpus -------------------------------------------------------------------------------


def _page_number(doc: Column) -> Column:
    return (F.floor(doc / 13) % 5 + 1).cast("int")


def pages(spark: SparkSession, sf: str) -> DataFrame:
    """Each document is one page; 13 files of five page numbers, so citations repeat."""
    doc = F.col("doc_id")
    number = F.lpad(_text(doc % 13 + 1), 2, "0")
    return read(spark, sf, "documents").select(
        doc.alias("document_key"),
        F.concat(F.lit(FILE_PREFIX), number, F.lit(".pdf")).alias("file_name"),
        _page_number(doc).alias("page_number"),
        "text", "lang", "n_chars",
    )


def _text_file(doc: Column) -> Column:
    return F.concat(F.lit(FILE_PREFIX), F.lit("-"), _text(F.floor(doc / 50)), F.lit(".txt"))


def document_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Text files of fifty documents each, to be written out."""
    doc = F.col("doc_id")
    return read(spark, sf, "documents").select(_text_file(doc).alias("file_name"), "doc_id", F.col("text").alias("line"))


def document_requests(spark: SparkSession, sf: str) -> DataFrame:
    """Every labelled document asks for its file, every benchmark item for one that is not there."""
    there = read(spark, sf, "labels").select(
        F.concat(F.lit("label "), _text("doc_id")).alias("request_id"), _text_file(F.col("doc_id")).alias("file_name")
    )
    gone = read(spark, sf, "benchmark").select(
        F.concat(F.lit("item "), _text("item_id")).alias("request_id"),
        F.concat(F.lit("gone-"), _text("item_id"), F.lit(".txt")).alias("file_name"),
    )
    return there.unionByName(gone)


def chunks(spark: SparkSession, sf: str) -> DataFrame:
    return C.chunk_pages(pages(spark, sf), language=F.col("lang"))


def vectors(spark: SparkSession, sf: str) -> DataFrame:
    """Every vector, as that of the first chunk of the document with its number, there or not."""
    doc = F.col("vec_id")
    return read(spark, sf, "embeddings").select(
        "vec_id", "embedding", C.chunk_id(doc, _page_number(doc), F.lit(0)).alias("chunk_id")
    )


def questions(spark: SparkSession, sf: str) -> DataFrame:
    """Every vector asks; every benchmark text asks without a vector and finds nothing."""
    asked = read(spark, sf, "embeddings").select(
        F.col("vec_id").alias("question_id"),
        F.concat(F.lit("What is topic "), _text("label"), F.lit(" in item "), _text("vec_id"))
        .alias("question"),
        "embedding",
    )
    unplaced = read(spark, sf, "benchmark").select(
        (F.col("item_id") + 100_000_000).alias("question_id"),
        F.col("text").alias("question"),
        F.lit(None).cast("array<float>").alias("embedding"),
    )
    return asked.unionByName(unplaced)


# --- chat ---------------------------------------------------------------------------------


def _chat_time(conv_id: str, turn: str) -> Column:
    start = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")
    return start + F.make_dt_interval(F.lit(0), F.col(conv_id), F.col(turn))


def messages(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "conversations").select(
        F.concat(F.lit("c"), _text("conv_id")).alias("session_id"),
        F.concat(F.lit("u"), _text(F.col("conv_id") % 20)).alias("user_id"),
        "turn", "role", F.col("text").alias("content"),
        _chat_time("conv_id", "turn").alias("timestamp"),
    )


def chat_log(spark: SparkSession, sf: str) -> DataFrame:
    """Logged pairs with a log id."""
    log_id = F.sha2(F.concat_ws("#", "session_id", "turn"), 256)
    return S.chat_pairs(messages(spark, sf)).withColumn("log_id", log_id)


def sessions(spark: SparkSession, sf: str) -> DataFrame:
    """Opened by the first prompt, touched by each pair, renamed by system messages."""
    said = messages(spark, sf)
    renames = said.where(F.col("role") == "system").select(
        "session_id", F.col("timestamp").alias("changed_at"),
        X.title_of(F.col("content")).alias("title"),
    )
    opened = S.open_sessions(S.first_prompts(said))
    return S.rename_sessions(S.touch_sessions(opened, chat_log(spark, sf)), renames)


def dashboard_log(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "events").select(
        _text("event_id").alias("log_id"),
        F.concat(F.lit("Query Processed for "), _text("user_id")).alias("metric_name"),
        F.lit("1").alias("metric_value"), F.col("ts").alias("timestamp"),
    )


# --- quizzes ------------------------------------------------------------------------------

# Total order of the answers of an attempt.
ANSWER_ORDER = [
    "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount",
    "l_tax", "l_returnflag", "l_linestatus", "l_shipdate",
]


def answers(spark: SparkSession, sf: str) -> DataFrame:
    """One row per answered question; small quantities are left unanswered."""
    state = F.concat("l_returnflag", "l_linestatus")
    choice = F.concat(_letter(F.col("l_suppkey")), F.lit(". "), state)
    key = _letter(F.col("l_partkey"))
    question = F.concat(F.lit("Part "), _text("l_partkey"), F.lit(' "line" '), _text("l_linenumber"))
    options = F.array(*[F.concat(F.lit(f"{x}. "), state) for x in "ABCD"])
    return read(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("attempt_id"),
        question.alias("question"),
        F.when(F.col("l_quantity") >= 3, choice).alias("choice"),
        key.alias("answer_key"),
        F.struct(question.alias("question"), options.alias("options"), key.alias("answer"))
        .alias("quiz"),
        *ANSWER_ORDER,
    )


def answer_order() -> list[Column]:
    return [F.col(c) for c in ANSWER_ORDER]


def submitted(spark: SparkSession, sf: str) -> DataFrame:
    """Attempts as a form submits them: three parallel lists, with fewer answers than questions in
    every third attempt and one too many in every other third."""
    asked = F.sort_array(F.collect_list(F.struct(*ANSWER_ORDER, "question", "choice", "answer_key")))
    lists = answers(spark, sf).groupBy("attempt_id").agg(asked.alias("asked"))
    choices, kind = F.col("asked.choice"), F.col("attempt_id") % 3
    return lists.select(
        "attempt_id", F.col("asked.question").alias("questions"),
        F.when(kind == 0, F.slice(choices, F.lit(1), F.size(choices) - 1))
        .when(kind == 1, F.concat(choices, F.array(F.lit("A. more"))))
        .otherwise(choices).alias("choices"),
        F.col("asked.answer_key").alias("answer_keys"),
    )


def attempt_heads(spark: SparkSession, sf: str) -> DataFrame:
    customer, date = F.col("o_custkey"), F.col("o_orderdate")
    return read(spark, sf, "orders").select(
        F.col("o_orderkey").alias("attempt_id"),
        _text(customer).alias("user_id"),
        F.concat_ws("-", _text(customer), _text(F.year(date))).alias("session_id"),
        date.alias("created_at"),
        (customer % 3 + 8).cast("int").alias("class_level"),
    )


def graded(spark: SparkSession, sf: str) -> DataFrame:
    """Attempts with head, score and a one-line evaluation. Answers are counted before the join."""
    scored = G.grade(answers(spark, sf))
    return attempt_heads(spark, sf).join(scored, "attempt_id").withColumn("analysis", analysis())


def analysis() -> Column:
    return F.concat(
        F.lit("Attempt "), _text("attempt_id"), F.lit(": "), _text("score"), F.lit("/"),
        _text("total"), F.lit(", "), F.col("proficiency"),
    )


def quiz_replies(spark: SparkSession, sf: str) -> DataFrame:
    """Raw model replies, some without JSON and some with broken JSON."""
    part = F.col("p_partkey")
    options = F.array(
        F.concat(F.lit("A. "), "p_brand"), F.concat(F.lit("B) "), "p_type"),
        F.concat(F.lit("C. "), _text("p_size")), F.lit("D. other"),
    )
    quiz = F.to_json(
        F.array(F.struct(F.concat(F.lit("Which "), "p_name", F.lit("?")).alias("question"),
                         options.alias("options"), _letter(part).alias("answer")))
    )
    reply = (
        F.when(part % 11 == 0, F.lit("No quiz today."))
        .when(part % 13 == 0, F.concat(F.lit("Sure! "), F.replace(quiz, F.lit('"answer":'), F.lit('"answer"'))))
        .otherwise(F.concat(F.lit("Sure! "), quiz, F.lit(" done")))
    )
    return read(spark, sf, "part").select(part.alias("part_id"), reply.alias("reply"))


def completions(spark: SparkSession, sf: str) -> DataFrame:
    """Completion envelopes over the documents: fenced, short, empty and reasoning-only ones."""
    doc, text = F.col("doc_id"), F.col("text")
    fenced = F.when(doc % 5 == 0, F.concat(F.lit("```json\n{}\n``` "), text)).otherwise(text)
    content = (
        F.when((doc % 3 == 0) | (doc % 7 == 0), F.lit(""))
        .when(doc % 11 == 0, F.lit(" short reply "))
        .otherwise(fenced)
    )
    reasoning = F.when(doc % 7 == 0, F.lit("")).otherwise(F.concat(F.lit("Because "), text))
    message = F.struct(content.alias("content"), reasoning.alias("reasoning_content"))
    envelope = F.struct(F.array(F.struct(message.alias("message"))).alias("choices"))
    return read(spark, sf, "documents").select("doc_id", F.to_json(envelope).alias("envelope"))
