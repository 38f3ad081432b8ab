"""Column expressions over titles, citations and page text."""

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from lectern import fixed_values as V


def fill(template: str, **columns) -> Column:
    """Concatenate a ``{name}`` template with columns; other braces stay as they are."""
    pieces = re.split(r"\{(\w+)\}", template)
    parts = []
    for position, piece in enumerate(pieces):
        if position % 2:
            value = columns[piece]
            value = value if isinstance(value, Column) else F.lit(value)
            parts.append(value.cast("string"))
        elif piece:
            parts.append(F.lit(piece))
    return F.concat(*parts)


def or_if_empty(column: Column, *fallbacks) -> Column:
    """First of the values that is neither null nor the empty string."""
    values = [F.nullif(column, F.lit(""))]
    values += [f if isinstance(f, Column) else F.lit(f) for f in fallbacks]
    return F.coalesce(*values)


def strip(column: Column) -> Column:
    return F.btrim(column, F.lit(V.WHITESPACE))


def strip_short(column: Column) -> Column:
    """``strip`` for short plain columns: trims only values that start or end with a space.

    Faster there, but it repeats its argument, so keep it off long or computed text.
    """
    first, last = F.left(column, F.lit(1)), F.right(column, F.lit(1))
    padded = first.isin(*V.WHITESPACE) | last.isin(*V.WHITESPACE)
    return F.when(padded, F.btrim(column, F.lit(V.WHITESPACE))).otherwise(column)


def page_text(column: Column) -> Column:
    return strip(F.replace(column, F.lit("\n"), F.lit(" ")))


def chapter_name(filename: Column) -> Column:
    return F.replace(filename, F.lit(V.DOCUMENT_SUFFIX), F.lit(""))


def chapter_number(chapter: Column) -> Column:
    return F.right(chapter, F.lit(2))


def document_file(chapter_no: Column, prefix: str) -> Column:
    return F.concat(F.lit(prefix), chapter_no, F.lit(V.DOCUMENT_SUFFIX))


def document_path(file: Column, base_dir: str) -> Column:
    return F.concat(F.lit(base_dir.rstrip("/") + "/"), file)


def page_index(page_number: Column, pages: Column) -> Column:
    """Zero-based index of the requested page, clamped to the pages that exist."""
    return F.greatest(F.lit(0), F.least(page_number - 1, pages - 1))


def shown(value: Column) -> Column:
    """A value as text; a missing one is shown as such, so that its block isn't lost."""
    return F.coalesce(value.cast("string"), F.lit(V.UNANSWERED))


def context_block(class_level, chapter_no, page_number, text_content) -> Column:
    return fill(
        V.CONTEXT_BLOCK, class_level=shown(class_level), chapter_no=shown(chapter_no),
        page_number=shown(page_number), text_content=shown(text_content),
    )


def source_label(class_level, chapter_no, page_number) -> Column:
    return fill(
        V.SOURCE_LABEL, class_level=class_level, chapter_no=chapter_no, page_number=page_number
    )


def title_of(prompt: Column) -> Column:
    cut = F.concat(F.left(prompt, F.lit(V.TITLE_CHARS)), F.lit(V.ELLIPSIS))
    return F.when(F.length(prompt) > V.TITLE_CHARS, cut).otherwise(prompt)


def display_title(title: Column) -> Column:
    return F.left(or_if_empty(title, V.UNTITLED), F.lit(V.DISPLAY_TITLE_CHARS))


# Extended or basic date; after any one character hours, minutes, seconds and their fraction; offset.
_ISO_TIME = (
    r"(?s)^(?!0000)(\d{4})(-?)(\d\d)\2(\d\d)"
    r"(?:.([01]\d|2[0-3])(?:(:?)([0-5]\d)(?:\6([0-5]\d)(?:[.,]\d+)?)?)?"
    r"(?:[+-](?:[01]\d|2[0-3])(?:(:?)[0-5]\d(?:\9[0-5]\d(?:[.,]\d+)?)?)?)?)?\z"
)


def activity_time(value: Column) -> Column:
    """``Jan 31, 09:05 PM`` as written in the value; its first 16 characters if not an ISO 8601 time.

    Dates and times may be in the extended or the basic form, with hours only, any number of digits
    after the second, ``Z`` or an offset, which does not move the time.
    """
    value = value.cast("string")
    iso = F.replace(value, F.lit("Z"), F.lit("+00:00"))
    part = lambda n: F.nullif(F.regexp_extract(iso, _ISO_TIME, n), F.lit("")).cast("int")
    year, month, day = part(1), part(3), part(4)
    clock = [F.coalesce(part(n), F.lit(0)) for n in (5, 7, 8)]
    parsed = F.try_make_timestamp_ntz(year, month, day, *clock)
    return F.coalesce(
        F.date_format(parsed, "MMM dd, hh:mm a"), F.left(value, F.lit(V.RAW_TIME_CHARS))
    )


def metric_name(user_id: Column) -> Column:
    return fill(V.METRIC_NAME, user_id=user_id)
