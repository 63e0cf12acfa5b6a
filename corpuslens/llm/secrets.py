"""Secret scans with a trigram inverted index.

For each rule the trigrams that any match must contain are derived from its regular expression, as an OR of ANDs over lower-cased text.
The index has a posting (trigram, text hash) for each of these trigrams and each text that contains it. Postings are intersected per AND;
texts that satisfy one are the rule's candidates, and only they are searched with the expression. A rule without mandatory trigrams
searches all texts. The hash of a text stands for its rows, so copies have one posting; a collision only adds a candidate.

Matches are leftmost and do not overlap within a rule; a match whose value is too short is dropped, and its characters stay used.
Spans are in code points, ends exclusive. Everything is DataFrame expressions.

A null text is empty and has no spans. Repeated rows each get their result. Null ids are allowed. An empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass
from re import _constants as kinds, _parser as parser

from pyspark.sql import Column, DataFrame, functions as F

from corpuslens.llm.common import free_name, written

#: Alternatives of one expression that are followed apart; beyond, what is known so far is kept and the rest left open.
MOST_ALTERNATIVES = 64
#: The least number of items in a chunk of a fold.
CHUNK = 64
#: Characters of the blocks that a redacted text is cut into.
BLOCK = 1024
SPAN = "struct<start:int,rank:int,end:int>"
KEPT = "struct<first:int,stop:int>"


@dataclass(frozen=True)
class Rule:
    """What a kind of secret looks like: an expression, and the least characters of one of its groups (0: the match)."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0


BASE_RULES = (
    Rule("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    # The least length is part of these: a run of such characters that is long enough is one match either way.
    Rule("access", r"AKIA[A-Z0-9]{12,}"),
    Rule("hex", r"[0-9a-f]{32,}"),
)
#: What this method adds.
MORE_RULES = (
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abeprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("stripe", r"(sk|rk)_live_[A-Za-z0-9]{16,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+"),
    Rule("private_key", r"-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----"),
)


def trigram_query(pattern: str) -> list[frozenset[str]] | None:
    """Sets of lower-case trigrams: every match contains all of one set. None if a match need not contain any."""

    def grams(run: str) -> frozenset[str]:
        return frozenset(run[i : i + 3] for i in range(len(run) - 2))

    def closed(found: set) -> set:
        return {(done | grams(run), "") for done, run in found}

    def follow(items, found: set) -> set:
        for kind, value in items:
            if kind is kinds.LITERAL and value < 128:
                found = {(done, run + chr(value).lower()) for done, run in found}
            elif kind is kinds.SUBPATTERN:
                found = follow(value[3], found)
            elif kind is kinds.BRANCH:
                found = set().union(*(follow(branch, found) for branch in value[1]))
            elif kind in (kinds.MAX_REPEAT, kinds.MIN_REPEAT):
                low, high, inner = value
                if high == 1:
                    found = found | follow(inner, found) if low == 0 else follow(inner, found)
                elif low:
                    found = closed(follow(inner, found))
                else:
                    found = closed(found)
            elif kind is not kinds.AT:
                found = closed(found)
            if len(found) > MOST_ALTERNATIVES:
                found = closed(found)
        return found

    sets = {done for done, _ in closed(follow(parser.parse(pattern), {(frozenset(), "")}))}
    if frozenset() in sets or len(sets) > MOST_ALTERNATIVES:
        return None
    return sorted((s for s in sets if not any(other < s for other in sets)), key=sorted)


def index(docs: DataFrame, trigrams: list[str], text: str = "text") -> DataFrame:
    """Postings (trigram, text_hash): which texts have which of the trigrams, whatever the case of their letters."""
    rows = docs.select(F.xxhash64(text).alias("text_hash"), F.lower(text).alias("low"))
    present = F.array(*[F.when(F.contains("low", F.lit(t)), F.lit(t)) for t in trigrams])
    # The outer form: from the plain one Spark derives a "not empty" filter, which searches every text once more.
    return rows.select(F.explode_outer(present).alias("trigram"), "text_hash").filter("trigram IS NOT NULL")


def candidates(postings: DataFrame, queries: dict[str, list[frozenset[str]]]) -> DataFrame:
    """(text_hash, kinds): texts that satisfy a rule's query, by intersecting postings."""
    spark = postings.sparkSession
    clauses = [
        (kind, clause, trigram, 1 << bit, (1 << len(wanted)) - 1)
        for kind, sets in queries.items()
        for clause, wanted in enumerate(sets)
        for bit, trigram in enumerate(sorted(wanted))
    ]
    table = spark.createDataFrame(clauses, "kind string, clause int, trigram string, bit long, full long")
    met = postings.join(F.broadcast(table), "trigram").groupBy("text_hash", "kind", "clause", "full").agg(F.bit_or("bit").alias("bits"))
    return met.filter("bits = full").groupBy("text_hash").agg(F.sort_array(F.collect_set("kind")).alias("kinds"))


def _pinned(df: DataFrame, name: str, value: Column) -> DataFrame:
    """The column computed once for each row. A projection may be folded into every use, so that inside a lambda it runs anew for each element."""
    return df.select("*", F.explode_outer(F.array(value)).alias(name))


def _folded(items: Column, start: Column, step, out: str) -> Column:
    """The array that a fold over items makes, item by item. ``step`` gives (place carried on, new elements) from (place, item).

    Spark copies a fold's state at every step. So items are folded in chunks of about the square root of their number, and what finished
    chunks made lies in the state of an outer fold, which is copied once a chunk: copies grow with the power 1.5 of the items.
    """
    empty = F.array().cast(f"array<{out}>")

    def chunk(state: Column, part: Column) -> Column:
        def inner(s: Column, item: Column) -> Column:
            at, new = step(s["at"], item)
            return F.struct(at.alias("at"), F.concat(s["out"], new).alias("out"))

        def close(s: Column) -> Column:
            return F.struct(s["at"].alias("at"), F.concat(state["kept"], F.array(s["out"])).alias("kept"))

        return F.aggregate(part, F.struct(state["at"].alias("at"), empty.alias("out")), inner, close)

    n = F.size(items)
    size = F.greatest(F.lit(CHUNK), F.ceil(F.sqrt(n)).cast("int"))
    chunks = F.when(n > 0, F.transform(F.sequence(F.lit(0), F.floor((n - 1) / size).cast("int")), lambda c: F.slice(items, c * size + 1, size)))
    chunks = chunks.otherwise(F.array(F.slice(items, 1, 0)))
    begin = F.struct(start.alias("at"), F.array().cast(f"array<array<{out}>>").alias("kept"))
    return F.aggregate(chunks, begin, chunk, lambda state: F.flatten(state["kept"]))


def scan(docs: DataFrame, rules: tuple[Rule, ...] = BASE_RULES + MORE_RULES, text: str = "text", column: str = "spans") -> DataFrame:
    """docs with ``column``: sorted structs (start, rank, end), rank being the place of the rule in ``rules``."""
    queries = {rule.kind: trigram_query(rule.pattern) for rule in rules}
    limited = {kind: sets for kind, sets in queries.items() if sets is not None}
    own = free_name(docs, "_s")
    rows = docs.withColumns({f"{own}_text": F.coalesce(F.col(text), F.lit("")), f"{own}_hash": F.xxhash64(text)})
    if limited:
        trigrams = sorted({t for sets in limited.values() for s in sets for t in s})
        found = written(candidates(index(docs, trigrams, text), limited), "candidates")
        found = found.select(F.col("text_hash").alias(f"{own}_key"), F.col("kinds").alias(f"{own}_kinds"))
        rows = rows.join(found, F.col(f"{own}_hash") == F.col(f"{own}_key"), "left")
    body = F.col(f"{own}_text")
    none = F.array().cast("array<string>")

    def matches(rule: Rule) -> Column:
        every = F.regexp_extract_all(body, F.lit(rule.pattern), F.lit(0))
        if rule.kind in limited:
            every = F.when(F.coalesce(F.array_contains(f"{own}_kinds", rule.kind), F.lit(False)), every).otherwise(none)
        return every.alias(rule.kind)

    rows = _pinned(rows, f"{own}_m", F.struct(*[matches(rule) for rule in rules]))

    def pieces(rule: Rule) -> Column:
        """The gap before each match, its length, and whether its value is long enough."""
        found = F.col(f"{own}_m")[rule.kind]
        values = F.regexp_extract_all(body, F.lit(rule.pattern), F.lit(rule.group)) if rule.group else found
        zipped = F.arrays_zip(found.alias("m"), F.slice(F.split(body, rule.pattern, -1), F.lit(1), F.size(found)).alias("g"), values.alias("v"))
        shown = lambda x: F.struct(F.length(x["g"]).alias("gap"), F.length(x["m"]).alias("len"), (F.length(x["v"]) >= rule.least).alias("ok"))
        empty = F.array().cast("array<struct<gap:int,len:int,ok:boolean>>")
        return F.when(F.size(found) > 0, F.transform(zipped, shown)).otherwise(empty).alias(rule.kind)

    rows = _pinned(rows.drop(f"{own}_kinds"), f"{own}_p", F.struct(*[pieces(rule) for rule in rules]))

    def spans(rank: int, rule: Rule) -> Column:
        def step(at: Column, piece: Column) -> tuple[Column, Column]:
            start = at + piece["gap"]
            span = F.struct(start, F.lit(rank), start + piece["len"]).cast(SPAN)
            return start + piece["len"], F.when(piece["ok"], F.array(span)).otherwise(F.array().cast(f"array<{SPAN}>"))

        return _folded(F.col(f"{own}_p")[rule.kind], F.lit(0), step, SPAN)

    rows = _pinned(rows, f"{own}_spans", F.sort_array(F.concat(*[spans(rank, rule) for rank, rule in enumerate(rules)])))
    return rows.select(*[F.col(c) for c in docs.columns if c != column], F.col(f"{own}_spans").alias(column))


def listed(spans: str, rules: tuple[Rule, ...], kinds: tuple[str, ...] | None = None) -> Column:
    """The spans of some kinds as text: kind:start:end, comma-joined."""
    names = F.array(*[F.lit(rule.kind) for rule in rules])
    chosen = F.col(spans) if kinds is None else F.filter(spans, lambda s: F.get(names, s["rank"]).isin(*kinds))
    return F.array_join(F.transform(chosen, lambda s: F.concat_ws(":", F.get(names, s["rank"]), s["start"], s["end"])), ",")


def count(spans: str, rules: tuple[Rule, ...], kind: str) -> Column:
    rank = next(i for i, rule in enumerate(rules) if rule.kind == kind)
    return F.size(F.filter(spans, lambda s: s["rank"] == rank)).cast("long")


def redacted(docs: DataFrame, rules: tuple[Rule, ...] = BASE_RULES + MORE_RULES, text: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """docs with every run of overlapping spans replaced by the mark. Other columns, and texts without spans, stay."""
    spans = free_name(docs, "_spans")
    found = scan(docs, rules, text, spans)
    own = free_name(found, "_r")
    body = F.col(f"`{text}`")

    def step(at: Column, span: Column) -> tuple[Column, Column]:
        """Keep what lies before a span that begins behind all spans so far."""
        apart = span["start"] >= at
        kept = F.when(apart, F.array(F.struct(at, span["start"]).cast(KEPT))).otherwise(F.array().cast(f"array<{KEPT}>"))
        return F.greatest(at, span["end"]), kept

    between = _folded(F.col(spans), F.lit(0), step, KEPT)
    last = F.struct(F.array_max(F.transform(spans, lambda s: s["end"])), F.length(body)).cast(KEPT)
    marked = F.size(spans) > 0
    rows = _pinned(found, f"{own}_kept", F.when(marked, F.concat(between, F.array(last))))
    # A substring counts from the text's start; blocks are cut once, and a piece is taken from its blocks.
    rows = _pinned(rows, f"{own}_blocks", F.when(marked, F.regexp_extract_all(body, F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0))))

    def piece(p: Column) -> Column:
        first = F.floor(p["first"] / BLOCK).cast("int")
        blocks = F.slice(f"{own}_blocks", first + 1, F.floor((p["stop"] - 1) / BLOCK).cast("int") - first + 1)
        cut = F.substring(F.array_join(blocks, ""), p["first"] - first * BLOCK + 1, p["stop"] - p["first"])
        return F.when(p["stop"] > p["first"], cut).otherwise("")

    cleaned = F.when(marked, F.array_join(F.transform(f"{own}_kept", piece), mark)).otherwise(body)
    return rows.select(*[cleaned.alias(c) if c == text else F.col(f"`{c}`") for c in docs.columns])
