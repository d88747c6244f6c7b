r"""Personal data by bootstrapped contextual extraction; DataFrame expressions only.

Regular expressions find the seed entities (email, ip, card, phone). Every mention of an identifier, a
token with a digit or an at sign and the number groups after it, stands in a context: the one and the two
words before it, an earlier mention's among them. Mentions form a bipartite graph of patterns (contexts) and
instances (their strings). Seeds score 1 for their kind; a pattern's score for a kind is the mean of its
distinct instances' scores, an instance's score is the noisy-or of its good patterns, and ROUNDS rounds of
this run as grouped aggregations that combine before they shuffle. Patterns with a high score and enough
support then name mentions that no expression found.

Positions come from splitting a text at its matches: the pieces' and matches' lengths in code points add
up to starts and ends, in chunks (``scanned``), so that very many matches in a text cost little more than in
proportion. The expressions are written so that none backtracks over a run twice or recurses per repetition.

Defined cases: null texts are empty and have no spans; null ids stay; repeated rows each give a row; ties
of start go by kind in the order of KINDS; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.llm import shared as S

KINDS = ("email", "ip", "card", "phone")
#: Fixed by the contract; possessive where nothing that follows could take a character back.
SEEDS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Without one of these characters a text has no match.
NEEDS = {"email": "@", "ip": ".", "phone": "+"}
_SPACE = r"\x20\t\n\x0B\f\r"
MENTION = rf"(?<![^{_SPACE}])[^{_SPACE}0-9@]*+[0-9@][^{_SPACE}]*+(?:\x20[0-9()+.-]++)*+"
ROUNDS = 2
#: A pattern counts in a round from this score on, and names mentions from the last one on.
GOOD, SURE, SUPPORT = 0.5, 0.8, 5
#: The last two words of a text, or the one there is, with the spaces after them.
_LAST_TWO = rf"(?<![^{_SPACE}])(?:[^{_SPACE}]++[{_SPACE}]++)?[^{_SPACE}]++[{_SPACE}]*+$"
#: Items that a scan appends one by one, and code points of a block that texts are cut by.
CHUNK, BLOCK = 64, 1024


def let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once a row, also where lambdas inside refer to it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def scanned(items: Column, zero: Column, advance, emit, kind: str) -> Column:
    """``emit(state, item)`` (of the type ``kind``) for each item, the state running from ``zero`` by ``advance(state, item)``.

    Appending within chunks, whose first states come from a fold of their own, copies CHUNK items for each and not all.
    """
    empty = F.array().cast(f"array<{kind}>")

    def step(state: Column, x: Column) -> Column:
        return F.struct(advance(state["state"], x).alias("state"), F.concat(state["out"], F.array(emit(state["state"], x))).alias("out"))

    def within(chunks: Column) -> Column:
        first = F.aggregate(
            F.slice(chunks, 1, F.size(chunks) - 1), F.array(zero), lambda out, c: F.concat(out, F.array(F.aggregate(c, F.element_at(out, -1), advance)))
        )
        return F.flatten(F.zip_with(chunks, first, lambda c, s: F.aggregate(c, F.struct(s.alias("state"), empty.alias("out")), step)["out"]))

    def cut(every: Column) -> Column:
        numbers = F.sequence(F.lit(0), F.floor((F.size(every) - 1) / CHUNK).cast("int"))
        return F.when(F.size(every) == 0, empty).otherwise(let(F.transform(numbers, lambda k: F.slice(every, k * CHUNK + 1, CHUNK)), within))

    return let(items, cut)


_MATCH = "struct<start:int,end:int,text:string,gap:string>"


def located(text: Column, pattern: str) -> Column:
    """All matches of a pattern as array of start, end (code points), text and the one or two words that stand before."""
    found = F.arrays_zip(F.regexp_extract_all(text, F.lit(pattern), 0).alias("m"), F.split(text, pattern, -1).alias("p"))
    pairs = F.filter(found, lambda x: x["m"].isNotNull())
    before = lambda state, x: F.regexp_extract(F.concat(state["tail"], x["p"]), _LAST_TWO, 0)

    def advance(state: Column, x: Column) -> Column:
        tail = F.regexp_extract(F.concat(before(state, x), x["m"]), _LAST_TWO, 0)
        return F.struct((state["pos"] + F.length(x["p"]) + F.length(x["m"])).alias("pos"), tail.alias("tail"))

    def emit(state: Column, x: Column) -> Column:
        start = state["pos"] + F.length(x["p"])
        return F.struct(start.alias("start"), (start + F.length(x["m"])).alias("end"), x["m"].alias("text"), before(state, x).alias("gap"))

    zero = F.struct(F.lit(0).alias("pos"), F.lit("").alias("tail"))
    # most texts have no match: one cheap test spares them the scan
    return F.when(text.rlike(pattern), scanned(pairs, zero, advance, emit, _MATCH)).otherwise(F.array().cast(f"array<{_MATCH}>"))


def valid(kind: str, text: Column) -> Column:
    """Whether a match counts: parts of an address, digits of a number, the check digit of a card."""
    digits = F.regexp_replace(text, "[^0-9]", "")
    if kind == "ip":
        return text.rlike(r"^(?:0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?:\.|$)){4}")
    if kind == "card":
        return F.length(digits).between(12, 19) & F.coalesce(F.call_function("luhn_check", F.when(F.length(digits).between(12, 19), digits)), F.lit(False))
    if kind == "phone":
        return F.length(digits).between(9, 15)
    return F.lit(True)


def _span(kind: Column, at: Column) -> Column:
    return F.struct(at["start"].alias("start"), kind.alias("kind"), at["end"].alias("end"))


def base_spans(text: Column) -> Column:
    """Sorted array of start, kind (its place in KINDS), end of all seed entities."""
    found = []
    for n, kind in enumerate(KINDS):
        matches = located(text, SEEDS[kind])
        if kind in NEEDS:
            matches = F.when(F.contains(text, F.lit(NEEDS[kind])), matches).otherwise(F.array().cast(f"array<{_MATCH}>"))
        keep = (lambda kind: lambda m: valid(kind, m["text"]))(kind)
        found.append(F.transform(F.filter(matches, keep), (lambda n: lambda m: _span(F.lit(n), m))(n)))
    return F.array_sort(F.concat(*found))


def _patterns(gap: Column) -> Column:
    """The last word of what stands before a mention, and the last two; of fewer words, those there are."""
    last = F.lower(F.regexp_extract(gap, rf"([^{_SPACE}]+)[{_SPACE}]*$", 1))
    before = F.lower(F.regexp_extract(gap, rf"([^{_SPACE}]+)[{_SPACE}]+[^{_SPACE}]+[{_SPACE}]*$", 1))
    one, two = F.when(last != "", F.concat(F.lit("1 "), last)), F.when(before != "", F.concat(F.lit("2 "), before, F.lit(" "), last))
    return F.array_compact(F.array(one, two))


def held_kind(text: Column) -> Column:
    """The first kind of which an identifier's own text holds a seed entity, else -1."""
    kinds = []
    for n, kind in enumerate(KINDS):
        holds = F.exists(F.regexp_extract_all(text, F.lit(SEEDS[kind]), 0), (lambda kind: lambda m: valid(kind, m))(kind))
        kinds.append(F.when(F.contains(text, F.lit(NEEDS[kind])) & holds if kind in NEEDS else holds, F.lit(n)))
    return F.coalesce(*kinds, F.lit(-1))


def mentions(text: Column) -> Column:
    """Identifiers with start, end, digest of the text, kind (of the seed they hold, else -1) and up to two patterns."""

    def made(m: Column) -> Column:
        return F.struct(
            m["start"].alias("start"),
            m["end"].alias("end"),
            F.sha2(m["text"].cast("binary"), 256).alias("instance"),
            held_kind(m["text"]).alias("kind"),
            F.contains(m["text"], F.lit("@")).alias("at"),
            F.length(F.regexp_replace(m["text"], "[^0-9]", "")).alias("digits"),
            _patterns(m["gap"]).alias("patterns"),
        )

    return F.transform(located(text, MENTION), made)


def learned_patterns(found: DataFrame) -> DataFrame:
    """pattern, kind of the patterns that name their mentions; ``found`` has mentions."""
    edges = S.cut(
        found.select(F.explode("mentions").alias("m"))
        .select("m.instance", "m.kind", F.explode("m.patterns").alias("pattern"))
        .groupBy("pattern", "instance")
        .agg(F.max("kind").alias("kind"))
    )
    seeds = edges.where("kind >= 0").groupBy("instance", "kind").agg(F.lit(1.0).alias("score"))
    sizes = edges.groupBy("pattern").agg(F.count("*").alias("instances")).where(F.col("instances") >= SUPPORT)
    scores, patterns = seeds, None
    for _ in range(ROUNDS):
        patterns = S.cut(
            edges.select("pattern", "instance")
            .join(scores, "instance")
            .groupBy("pattern", "kind")
            .agg(F.sum("score").alias("support"))
            .join(sizes, "pattern")
            .select("pattern", "kind", "support", (F.col("support") / F.col("instances")).alias("confidence"))
            .where((F.col("confidence") >= GOOD) & (F.col("support") >= SUPPORT))
        )
        named = (
            edges.where("kind < 0")
            .select("pattern", "instance")
            .join(patterns, "pattern")
            .groupBy("instance", "kind")
            .agg((1 - F.exp(F.sum(F.log(F.greatest(1 - F.col("confidence"), F.lit(1e-6)))))).alias("score"))
        )
        scores = seeds.unionByName(named)
    return patterns.where(F.col("confidence") >= SURE).groupBy("pattern").agg(F.max_by("kind", F.struct("confidence", "support", "kind")).alias("named"))


def find_spans(docs: DataFrame) -> DataFrame:
    """doc_id, other columns, base, spans (arrays of start, kind, end; base spans are among spans) of every row; no text."""
    keep = [c for c in docs.columns if c != "text"]
    given = docs.select(F.coalesce("text", F.lit("")).alias("text"), F.struct(*keep).alias("kept"))
    found = given.select("kept", base_spans(F.col("text")).alias("base"), mentions(F.col("text")).alias("mentions"))
    found = S.written(found.withColumn("row", F.monotonically_increasing_id()), "mentions")
    open_ones = found.select("row", F.explode(F.filter("mentions", lambda m: m["kind"] < 0)).alias("m"))
    named = (
        open_ones.select("row", "m.start", "m.end", "m.at", "m.digits", F.explode("m.patterns").alias("pattern"))
        .join(learned_patterns(found), "pattern")
        .where(F.when(F.col("named") == 0, F.col("at")).otherwise(F.col("digits") >= 4))
        .groupBy("row", "start", "end")
        .agg(F.min("named").alias("kind"))
        .groupBy("row")
        .agg(F.collect_list(F.struct("start", "kind", "end")).alias("more"))
    )
    nothing = F.array().cast("array<struct<start:int,kind:int,end:int>>")
    spans = F.array_sort(F.concat("base", F.coalesce("more", nothing)))
    return found.drop("mentions").join(named, "row", "left").select("kept.*", "base", spans.alias("spans"))


def written_spans(spans: Column | str) -> Column:
    """kind:start:end of each span, comma-joined."""
    kinds = F.array(*[F.lit(k) for k in KINDS])
    one = lambda s: F.concat_ws(":", F.element_at(kinds, s["kind"] + 1), s["start"], s["end"])
    return F.array_join(F.transform(spans, one), ",")


def counted(spans: Column | str, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == KINDS.index(kind))).cast("long")


def redacted(text: Column, spans: Column) -> Column:
    """The text with each of the sorted spans (overlaps merged) replaced by ``[KIND]``."""
    kinds = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])
    def within(blocks: Column) -> Column:
        def cut(start: Column, end: Column) -> Column:
            first = F.floor(start / BLOCK).cast("int")
            joined = F.array_join(F.slice(blocks, first + 1, F.floor((end - 1) / BLOCK).cast("int") - first + 1), "")
            return F.when(end > start, F.substring(joined, start % BLOCK + 1, end - start)).otherwise(F.lit(""))

        def emit(pos: Column, s: Column) -> Column:
            return F.when(s["start"] >= pos, F.concat(cut(pos, s["start"]), F.element_at(kinds, s["kind"] + 1))).otherwise(F.lit(""))

        pieces = scanned(spans, F.lit(0), lambda pos, s: F.greatest(pos, s["end"]), emit, "string")
        return F.concat(F.array_join(pieces, ""), cut(F.array_max(F.transform(spans, lambda s: s["end"])), F.length(text)))

    # by blocks, so that a cut reads no more than the blocks it touches
    return let(F.regexp_extract_all(text, F.lit(rf"(?s).{{1,{BLOCK}}}"), 0), within)


def redact(docs: DataFrame) -> DataFrame:
    """The same rows and columns with each span (overlaps merged) replaced by ``[KIND]``.

    Null texts stay null; repeated rows are redacted alike; extra columns of any name are carried.
    """
    h, i, k, found = S.fresh(docs, "_hash", "_id", "_key", "_spans")
    keyed = docs.withColumn(h, F.xxhash64("text"))
    spans = find_spans(keyed.select("doc_id", F.col(h).alias("hash"), "text")).where(F.size("spans") > 0)
    spans = spans.select(F.col("doc_id").alias(i), F.col("hash").alias(k), F.col("spans").alias(found)).dropDuplicates([i, k])
    joined = keyed.join(spans, F.col("doc_id").eqNullSafe(F.col(i)) & (F.col(h) == F.col(k)), "left")
    text = F.when(F.col(found).isNull(), F.col("text")).otherwise(redacted(F.col("text"), F.col(found)))
    return joined.withColumn("text", text).select(*docs.columns)
