"""JSON text columns: scrubbing and safe reads."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

__all__ = ["scrub_payload", "payload_has_key", "safe_array"]

# A string, one character of structure, or a run of anything else. Possessive, so long strings need no stack.
_TOKEN = r'(?s)"[^"\\]*+(?:\\.[^"\\]*+)*+"|[{}\[\],]|[^"{}\[\],]++'
_BLANK = " \t\r\n"
_STRICT = {"allowSingleQuotes": "false"}


def _key_text(token: Column) -> Column:
    """The text of a JSON string; escapes are read only where there are any."""
    escaped = F.from_json(F.concat(F.lit("["), token, F.lit("]")), "array<string>")[0]
    return F.when(token.contains("\\"), escaped).otherwise(F.substring(token, F.lit(2), F.length(token) - 2))


def _cuts(payload: Column, key: str) -> Column:
    """Character ranges [from, to) of the key's members in a JSON object, each with one comma; null for any other text.

    A fold over tokens with the nesting depth as its state. ``sep`` is the separator before the current top-level member, ``lead`` says
    that no member before it stays, ``hit`` that it has the key, ``blank`` how much white space the last token ends with.
    """
    start = F.struct(
        F.lit(0).alias("at"), F.lit(0).alias("depth"), F.lit(0).alias("sep"), F.lit(True).alias("lead"),
        F.lit(False).alias("named"), F.lit(False).alias("hit"), F.lit(0).alias("blank"), F.lit(False).alias("closed"),
        F.lit(False).alias("junk"), F.array().cast("array<struct<from:int,to:int>>").alias("cuts"),
    )

    def step(s: Column, t: Column) -> Column:
        opens, closes = t.isin("{", "["), t.isin("}", "]")
        comma = (t == ",") & (s["depth"] == 1)
        end = closes & (s["depth"] == 1)
        names = (s["depth"] == 1) & ~s["named"] & t.startswith('"')
        cut = F.struct(
            F.when(s["lead"], s["sep"] + 1).otherwise(s["sep"]).alias("from"),
            F.when(comma & s["lead"], s["at"] + 1).when(end & ~s["lead"], s["at"] - s["blank"]).otherwise(s["at"]).alias("to"),
        )
        separator = comma | (opens & (s["depth"] == 0))
        return F.struct(
            (s["at"] + F.length(t)).alias("at"),
            (s["depth"] + F.when(opens, 1).when(closes, -1).otherwise(0)).alias("depth"),
            F.when(separator, s["at"]).otherwise(s["sep"]).alias("sep"),
            F.when(comma, s["lead"] & s["hit"]).otherwise(s["lead"]).alias("lead"),
            (~separator & (s["named"] | names)).alias("named"),
            F.when(separator, False).when(names, _key_text(t) == key).otherwise(s["hit"]).alias("hit"),
            (F.length(t) - F.length(F.rtrim(t, F.lit(_BLANK)))).alias("blank"),
            (s["closed"] | end).alias("closed"),
            (s["junk"] | (s["closed"] & (F.length(F.trim(t, F.lit(_BLANK))) > 0))).alias("junk"),
            F.when((comma | end) & s["hit"], F.concat(s["cuts"], F.array(cut))).otherwise(s["cuts"]).alias("cuts"),
        )

    tokens = F.regexp_extract_all(payload, F.lit(_TOKEN), F.lit(0))
    folded = F.aggregate(tokens, start, step, lambda s: F.when(~s["junk"], s["cuts"]))
    # The reader says whether the text is a valid object; it does not look behind the closing brace, the fold does.
    return F.when(F.from_json(payload, "map<string,string>", _STRICT).isNotNull(), folded)


def payload_has_key(payload: Column, key: str) -> Column:
    """Whether the text is a JSON object holding the key; false for invalid text and other JSON."""
    return F.coalesce(F.size(_cuts(payload, key)) > 0, F.lit(False))


def scrub_payload(payload: Column, key: str = "token") -> Column:
    """Cut one top-level key out of a JSON object, every member of that name; everything else is returned unchanged.

    Only the member's own characters go, with one comma: digits, order, escapes and white space of the rest stay as they are.
    """

    def without(cuts: Column) -> Column:
        ends = F.concat(F.transform(cuts, lambda c: c["from"]), F.array(F.length(payload)))
        starts = F.concat(F.array(F.lit(0)), F.transform(cuts, lambda c: c["to"]))
        pieces = F.transform(F.arrays_zip(starts.alias("a"), ends.alias("b")), lambda p: F.substring(payload, p["a"] + 1, p["b"] - p["a"]))
        return F.when(F.size(cuts) > 0, F.array_join(pieces, "")).otherwise(payload)

    # The one-element array makes the cuts a variable, computed once.
    return F.transform(F.array(_cuts(payload, key)), without)[0]


def safe_array(payload: Column, element: str, field: str | None = None) -> Column:
    """Array in a JSON text, or in one field of it; an empty array if it cannot be read."""
    empty = F.array().cast(f"array<{element}>")
    if field is None:
        return F.coalesce(F.from_json(payload, f"array<{element}>"), empty)
    parsed = F.from_json(payload, f"`{field}` array<{element}>")
    return F.coalesce(parsed.getField(field), empty)
