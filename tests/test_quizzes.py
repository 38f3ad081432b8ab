"""Quiz extraction, re-lettering and grading on hand-made edge rows."""

import json

import pytest
from pyspark.sql import functions as F

from lectern import fixed_values as V
from lectern.functions import model_text as M
from lectern.operators import grading as G
from lectern.operators import memory as R


def questions_of(spark, reply):
    df = spark.createDataFrame([(1, reply)], "id int, reply string")
    rows = G.quiz_questions(df, "id").orderBy("question_no").collect()
    return [(r.question_no, r.quiz.question, r.quiz.options, r.quiz.answer) for r in rows]


GOOD = '[{"question": "Q", "options": ["A. x", "B. y"], "answer": "B"}]'


@pytest.mark.parametrize(
    "reply", [GOOD, f"Sure!\n{GOOD}\nbye", f"```json\n{GOOD}\n```", GOOD.replace(", ", ",\n")]
)
def test_quiz_is_found_in_noise(spark, reply):
    assert questions_of(spark, reply) == [(1, "Q", ["A. x", "B. y"], "B")]


@pytest.mark.parametrize(
    "reply",
    ["", "no list", None, "[", GOOD.replace('"answer": "B"', '"answer": "B",'),
     GOOD.replace('"', "'"), f"{GOOD} and {GOOD}", f"{GOOD},{GOOD}",
     f"{GOOD}] []", f"{GOOD}}} {{[]", f'{GOOD}, "x": []', "[1, 2]", "[]"],
)
def test_unreadable_quiz_is_empty(spark, reply):
    assert questions_of(spark, reply) == []


def relabelled(spark, question, options, answer):
    df = spark.createDataFrame(
        [((question, options, answer),)],
        "quiz struct<question: string, options: array<string>, answer: string>",
    )
    return G.relabelled(df).first().quiz


@pytest.mark.parametrize(
    "options,answer,correct",
    [
        (["A. red", "B. green", "C. blue", "D. grey"], "C", "blue"),
        (["A) red", "B)green"], " B ", "green"),
        (["red", "green", "blue"], "green", "green"),
        (["A. a", "B. b", "C. c", "D. d", "E. e", "F. f", "G. g"], "G", "g"),
        (["A. 'q' \"r\"", "B. \\s"], "A", "'q' \"r\""),
    ],
)
def test_relabel_keeps_options_and_key(spark, options, answer, correct):
    import re

    quiz = relabelled(spark, "Why?", options, answer)
    texts = [o[3:] for o in quiz.options]
    assert sorted(texts) == sorted(re.sub(r"^[A-Z][.)]\s*", "", o) for o in options)
    assert [o[:3] for o in quiz.options] == [f"{'ABCDEF'[i % 6]}. " for i in range(len(options))]
    assert texts[[o[0] for o in quiz.options].index(quiz.answer)] == correct or len(options) > 6
    assert quiz == relabelled(spark, "Why?", options, answer)


def test_relabel_last_duplicate_wins(spark):
    quiz = relabelled(spark, "Q", ["A. same", "B. same", "C. other"], "A")
    last = max(i for i, o in enumerate(quiz.options) if o.endswith("same"))
    assert quiz.answer == "ABC"[last]


@pytest.mark.parametrize(
    "options,answer",
    [(["A. x"], "A"), (["A. x", "B. y"], ""), (["A. x", "B. y"], "  "), (["A. x", "B. y"], "Z"),
     (None, "A"), (["A. x", "B. y"], None), ([], "A")],
)
def test_relabel_leaves_unfit_questions(spark, options, answer):
    quiz = relabelled(spark, "Q", options, answer)
    assert (quiz.options, quiz.answer) == (options, answer)


# choice, key, is right
ANSWERS = [
    ("A. x", "A", True), (" B. y ", " B ", True), ("C", "D", False), (None, "N", True),
    (None, "A", False), ("anything", "", True), ("A", "A. x", False), ("A. x", "A. x", True),
]


@pytest.fixture(scope="module")
def graded_rows(spark):
    rows = [(1, i, f"q{i}", c, k) for i, (c, k, _) in enumerate(ANSWERS)]
    rows += [(2, 0, "only", "A", "A")]
    return spark.createDataFrame(
        rows, "attempt_id int, n int, question string, choice string, answer_key string"
    )


def test_grade(graded_rows):
    got = {r.attempt_id: tuple(r)[1:] for r in G.grade(graded_rows).collect()}
    right = sum(ok for _, _, ok in ANSWERS)
    assert got == {1: (right, 8, 8 - right, "High"), 2: (1, 1, 0, "Low")}


@pytest.mark.parametrize("score,band", [(0, "Low"), (1, "Low"), (2, "Medium"), (3, "Medium"),
                                        (4, "High"), (9, "High")])
def test_band(spark, score, band):
    rows = spark.createDataFrame([(1, "A" if i < score else "B", "A") for i in range(10)],
                                 "attempt_id int, choice string, answer_key string")
    assert G.grade(rows).first().proficiency == band


@pytest.mark.parametrize("hot_rows", [10**6, 3])
def test_breakdown_and_prompt(graded_rows, hot_rows):
    rows = G.breakdowns(graded_rows, [F.col("n")], hot_rows=hot_rows)
    got = {r.attempt_id: r for r in rows.collect()}
    blocks = []
    for i, (choice, key, ok) in enumerate(ANSWERS):
        tag = "✓ CORRECT" if ok else "✗ WRONG"
        student = str(choice).strip()
        blocks.append(f"Q{i + 1} [{tag}]\n  Question : q{i}\n  Student  : {student}\n  Correct  : {key}")
    assert got[1].breakdown == "\n\n".join(blocks)
    assert (got[1].score, got[1].total, got[1].wrong) == (5, 8, 3)
    prompts = {r.attempt_id: r for r in G.evaluation_prompts(rows, "m").collect()}
    assert "A student scored 5/8.\n" in prompts[1].prompt and blocks[3] in prompts[1].prompt
    assert "A student scored 1/1 — a PERFECT SCORE." in prompts[2].prompt
    payload = json.loads(prompts[2].payload)
    assert payload == {
        "model": "m", "messages": [{"role": "user", "content": prompts[2].prompt}],
        "max_tokens": 4095, "temperature": 0.2,
    }


def test_align_answers(spark):
    attempts = spark.createDataFrame(
        [(1, ["a", "b", "c"], ["A", None], ["A", "N"]), (2, ["a"], ["A", "B"], ["B", "B"]),
         (3, [], ["A"], ["A"])],
        "attempt_id int, questions array<string>, choices array<string>, answer_keys array<string>",
    )
    rows = G.align_answers(attempts).collect()
    assert sorted((r.attempt_id, r.question_no, r.question, r.choice, r.answer_key) for r in rows) == sorted(
        [(1, 1, "a", "A", "A"), (1, 2, "b", None, "N"), (1, 3, "c", None, None),
         (2, 1, "a", "A", "B")], key=str
    )


def test_history_keeps_quotes_backslashes_and_order(spark):
    tricky = 'it\'s "so" \\ here\nnew ünï'
    answers = spark.createDataFrame(
        [(1, i, (f"{tricky} {i}", ["A. x", "B. y"], "A"), c)
         for i, c in enumerate([tricky, None, "A. x"])],
        "attempt_id int, n int, "
        "quiz struct<question: string, options: array<string>, answer: string>, choice string",
    )
    heads = spark.createDataFrame(
        [(1, "s", "u", 2, 3, tricky)],
        "attempt_id int, session_id string, user_id string, score int, total int, analysis string",
    ).withColumn("created_at", F.current_timestamp())
    for hot_rows in (10**6, 2):
        row = R.quiz_history_rows(heads, answers, [F.col("n")], hot_rows=hot_rows).first()
        assert (row.score, row.total) == (1, 3)
        assert json.loads(row.user_answers) == [tricky, None, "A. x"]
        assert json.loads(row.correct_answers) == ["A"] * 3
        assert [q["question"] for q in json.loads(row.questions)] == [f"{tricky} {i}" for i in range(3)]
        assert row.strong_point == row.weak_point == tricky


def test_history_grades_from_its_own_pass(spark):
    answers = spark.createDataFrame(
        [(a, i, ("q", ["A. x"], "A"), "A. x" if i < a else "B") for a in (5, 9) for i in range(10)],
        "attempt_id int, n int, "
        "quiz struct<question: string, options: array<string>, answer: string>, choice string",
    )
    heads = spark.createDataFrame(
        [(5, "s", "u"), (9, "s", "u")], "attempt_id int, session_id string, user_id string"
    ).withColumn("created_at", F.current_timestamp())
    analysis = F.concat_ws(" ", "score", "total", "proficiency")
    rows = R.quiz_history_rows(heads, answers, [F.col("n")], analysis).collect()
    assert {(r.score, r.total, r.strong_point) for r in rows} == {
        (s, 10, f"{s} 10 {'High' if s >= V.HIGH_SCORE else 'Medium' if s >= V.MEDIUM_SCORE else 'Low'}")
        for s in (5, 9)
    }


def replies(spark, content, reasoning):
    message = {"content": content, "reasoning_content": reasoning}
    envelope = json.dumps({"choices": [{"message": message}]})
    m = M.reply_message(F.col("e"))
    df = spark.createDataFrame([(envelope,)], "e string").withColumn("m", m)
    return df.select(
        M.completion_text(F.col("m"), "F").alias("answer"),
        M.analysis_text(M.reply_body(F.col("m"))).alias("analysis"),
    ).first()


LONG = "This is a long enough analysis."


@pytest.mark.parametrize(
    "content,reasoning,answer,analysis",
    [
        (LONG, "r", LONG, LONG), ("", LONG, LONG, LONG), (None, None, "F", V.DEFAULT_ANALYSIS),
        ("  ", LONG, "", LONG), (f" ```x\ny``` {LONG} ```z```", "", f"```x\ny``` {LONG} ```z```", LONG),
        ("```only\nfenced text that is long```", LONG, "```only\nfenced text that is long```",
         V.DEFAULT_ANALYSIS),
        ("x" * 20, "", "x" * 20, V.DEFAULT_ANALYSIS), ("x" * 21, "", "x" * 21, "x" * 21),
    ],
)
def test_reply_text(spark, content, reasoning, answer, analysis):
    row = replies(spark, content, reasoning)
    assert (row.answer, row.analysis) == (answer, analysis)


@pytest.mark.parametrize("envelope", ["", "oops", "{}", '{"choices": []}', None])
def test_broken_envelope(spark, envelope):
    df = spark.createDataFrame([(envelope,)], "e string")
    assert df.select(M.completion_text(M.reply_message(F.col("e")), "F").alias("r")).first().r == "F"
