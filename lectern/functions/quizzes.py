"""Column expressions over quiz questions and answers."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from lectern import fixed_values as V
from lectern.functions.text import fill, strip, strip_short


def as_answer(value: Column) -> Column:
    return strip_short(F.coalesce(value.cast("string"), F.lit(V.UNANSWERED)))


def is_correct(choice: Column, key: Column) -> Column:
    return F.startswith(as_answer(choice), as_answer(key))


def proficiency(score: Column) -> Column:
    high, medium, low = V.BANDS
    return (
        F.when(score >= V.HIGH_SCORE, high).when(score >= V.MEDIUM_SCORE, medium).otherwise(low)
    )


def score_label(score: Column, total: Column) -> Column:
    return F.concat_ws("/", score.cast("string"), total.cast("string"))


def breakdown_line(question_no, right, question, choice, key) -> Column:
    tag = F.when(right, V.CORRECT_TAG).otherwise(V.WRONG_TAG)
    return fill(
        V.BREAKDOWN_LINE, question_no=question_no, tag=tag,
        question=F.coalesce(question, F.lit(V.UNANSWERED)), choice=as_answer(choice),
        answer_key=F.coalesce(key, F.lit(V.UNANSWERED)),
    )


def without_prefix(option: Column) -> Column:
    return F.regexp_replace(option, V.OPTION_PREFIX, "")


def mixed_options(question: Column) -> Column:
    """Option texts without letters, in the order of ``md5(question || option)``."""

    def entry(option):
        raw = without_prefix(option)
        return F.struct(F.md5(F.concat(question["question"], raw)).alias("h"), raw.alias("raw"))

    entries = F.array_sort(F.transform(question["options"], entry))
    return F.transform(entries, lambda e: e["raw"])


def correct_option(question: Column) -> Column:
    """First option starting with the answer; null unless the question can be re-lettered."""
    answer = strip(question["answer"])
    first = F.get(F.filter(question["options"], lambda o: F.startswith(o, answer)), 0)
    return F.when((F.size(question["options"]) >= 2) & (answer != ""), first)


def _letter(position: Column) -> Column:
    letters = F.array(*[F.lit(x) for x in V.LETTERS])
    return F.get(letters, (position % len(V.LETTERS)).cast("int"))


def lettered(texts: Column) -> Column:
    return F.transform(texts, lambda text, i: F.concat(_letter(i), F.lit(". "), text))


def letter_of(texts: Column, text: Column) -> Column:
    """Letter of the last option equal to ``text``."""
    hits = F.transform(texts, lambda option, i: F.when(option == text, _letter(i)))
    return F.element_at(F.array_compact(hits), -1)
