"""Text columns: redaction, line arrays, bounded text."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from corpuslens import fixed_values as fixed

__all__ = [
    "strip", "rstrip", "lstrip", "redact_secrets", "redact_with", "lines_of", "indent_width", "nonblank_line_count", "bounded_text",
    "truncated", "preview", "generated_marker", "failure_summary", "first_noteworthy_line",
]

LINE_BREAK = r"[\n\x0B\f\x1C-\x1E\x{85}\x{2028}\x{2029}]|\r\n?"
LINE_BREAKS = "\n\x0b\f\r\x1c\x1d\x1e\x85\u2028\u2029"

WHITESPACE = " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0"


def strip(text: Column) -> Column:
    """Text without whitespace of any kind on both sides; ``trim`` alone takes blanks only."""
    return F.btrim(text, F.lit(WHITESPACE))


def rstrip(text: Column) -> Column:
    return F.rtrim(text, F.lit(WHITESPACE))


def lstrip(text: Column) -> Column:
    return F.ltrim(text, F.lit(WHITESPACE))


def redact_secrets(text: Column) -> Column:
    """URL credentials, then known token formats, then Bearer/Basic values. Null and '' pass through."""
    out = F.regexp_replace(text, fixed.URL_CREDENTIALS, F.lit(fixed.URL_PLACEHOLDER))
    # The look-aheads name the first letters of all formats and spare the word boundary test elsewhere.
    out = F.regexp_replace(out, "(?=[gs])" + fixed.KNOWN_TOKENS, F.lit(fixed.TOKEN_PLACEHOLDER))
    return F.regexp_replace(out, "(?=[bB])" + fixed.AUTH_HEADER_VALUE, F.lit("$1 " + fixed.TOKEN_PLACEHOLDER))


def redact_with(text: Column, rules: list[tuple[str, str]]) -> Column:
    """Further (pattern, replacement) rules applied in the given order."""
    for pattern, replacement in rules:
        text = F.regexp_replace(text, pattern, replacement)
    return text


def lines_of(content: Column) -> Column:
    """Line array: a final line break starts no extra line, and empty content has no lines."""
    ends = F.contains(F.lit(LINE_BREAKS), F.right(content, F.lit(1)))
    final = F.when(F.endswith(content, F.lit("\r\n")), 2).when(ends, 1).otherwise(0)
    body = F.when(final > 0, F.left(content, F.length(content) - final)).otherwise(content)
    return F.when(content == "", F.array().cast("array<string>")).otherwise(F.split(body, LINE_BREAK))


def indent_width(line: Column) -> Column:
    """Number of leading whitespace characters."""
    return F.length(F.regexp_extract(line, r"^(\s*)", 1))


def nonblank_line_count(content: Column) -> Column:
    """Lines with anything but whitespace."""
    return F.regexp_count(content, F.lit(r"(?m)^.*\S.*$")).cast("int")


def bounded_text(content: Column, limit: int) -> Column:
    """The first ``limit`` characters."""
    return F.substring(content, 1, limit)


def truncated(content: Column, limit: int) -> Column:
    """Whether ``bounded_text`` cut something off."""
    return F.length(content) > limit


def preview(items: Column, shown: int = fixed.PREVIEW_ITEMS, total: Column | None = None) -> Column:
    """First items joined by ', ', with a trailing ', ...' when there are more."""
    size = F.size(items) if total is None else total
    return F.concat(
        F.array_join(F.slice(items, 1, shown), ", "),
        F.when(size > shown, F.lit(", ...")).otherwise(F.lit("")),
    )


def generated_marker(content: Column, marker: str = fixed.GENERATED_MARKER) -> Column:
    """whether the content carries the marker; null content does not."""
    return F.coalesce(F.contains(content, F.lit(marker)), F.lit(False))


def first_noteworthy_line(text: Column, is_noise) -> Column:
    """First non-blank trimmed line that is not noise, else the first non-blank line."""
    lines = F.filter(F.transform(lines_of(text), lambda line: strip(line)), lambda line: line != "")
    useful = F.filter(lines, lambda line: ~is_noise(line))
    return F.coalesce(F.get(useful, F.lit(0)), F.get(lines, F.lit(0)))


def failure_summary(reason: Column, limit: int = fixed.SUMMARY_CHARS) -> Column:
    """Short reason for a failed API documentation build."""
    text = strip(F.coalesce(reason, F.lit("")))
    has_attribute_error = text.rlike(r"AttributeError:\s*[^\n]+")
    attribute = strip(F.regexp_extract(text, r"AttributeError:\s*([^\n]+)", 1))
    first = first_noteworthy_line(text, lambda line: line.startswith("[AutoAPI] Reading files"))
    return (
        F.when(text == "", F.lit("AutoAPI build failure"))
        .when(
            F.contains(text, F.lit("Extension error (autoapi.extension)!")) & has_attribute_error,
            F.concat(F.lit("AutoAPI extension failure: "), attribute),
        )
        .when(has_attribute_error, F.concat(F.lit("AutoAPI failure: "), attribute))
        .otherwise(F.coalesce(F.substring(first, 1, limit), F.lit("AutoAPI build failure")))
    )
