"""Column expressions over model requests and replies."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from lectern import fixed_values as V
from lectern import schemas
from lectern.functions.text import or_if_empty, strip


def request_payload(prompt: Column, model: str, temperature: float) -> Column:
    message = F.struct(F.lit("user").alias("role"), prompt.alias("content"))
    payload = F.struct(
        F.lit(model).alias("model"),
        F.array(message).alias("messages"),
        F.lit(V.MAX_TOKENS).alias("max_tokens"),
        F.lit(temperature).alias("temperature"),
    )
    return F.when(prompt.isNotNull(), F.to_json(payload))


def reply_message(envelope: Column) -> Column:
    """``struct<content, reasoning_content>`` of the first choice; null if there is none."""
    return F.get(F.from_json(envelope, schemas.COMPLETION)["choices"], 0)["message"]


def completion_text(message: Column, fallback: str) -> Column:
    """Text of a parsed reply: content, else reasoning, else the fallback."""
    reasoning = F.nullif(message["reasoning_content"], F.lit(""))
    return strip(or_if_empty(message["content"], reasoning, fallback))


def without_fences(text: Column) -> Column:
    return strip(F.regexp_replace(text, V.CODE_FENCE, ""))


def reply_body(message: Column) -> Column:
    """Content without fences, or reasoning where the content is blank."""
    return without_fences(
        or_if_empty(strip(message["content"]), strip(message["reasoning_content"]))
    )


def analysis_text(reply: Column) -> Column:
    """Evaluation paragraph: the reply body, or the default when it is missing or a stub."""
    usable = F.length(reply) > V.MIN_ANALYSIS_CHARS
    return F.when(usable, reply).otherwise(F.lit(V.DEFAULT_ANALYSIS))


def quiz_json(reply: Column) -> Column:
    """The JSON array inside a reply, from its first ``[`` to its last ``]``."""
    return F.regexp_extract(reply, V.JSON_ARRAY, 0)


def is_one_json_value(text: Column) -> Column:
    """Whether the text is strict JSON with nothing after its first value.

    Spark's parsers stop after one value. Text that still ends early inside ``{"v": …}`` has to
    close a brace there, which makes ``[…]`` around it unreadable.
    """
    in_object = F.try_parse_json(F.concat(F.lit('{"v":'), text, F.lit("}")))
    in_array = F.json_array_length(F.concat(F.lit("["), text, F.lit("]")))
    return in_object.isNotNull() & F.coalesce(in_array == 1, F.lit(False))


def quiz_records(text: Column) -> Column:
    """Question records of a JSON text; null when it cannot be read."""
    return F.when(is_one_json_value(text), F.from_json(text, schemas.QUIZ))


def whole_quiz(records: Column) -> Column:
    """The records, or no question at all when one of them could not be read."""
    return F.when(~F.exists(records, lambda q: q.isNull()), records)
