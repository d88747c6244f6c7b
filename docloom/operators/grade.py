"""Integrity measures, quality findings and verdicts of chunked documents, all documents at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions import text as T

#: Fixed thresholds.
MAX_TOKENS, MIN_TOKENS = 1200, 100
GRADED_FROM, FLAT_FROM = 25, 50
OVERSIZED = (0.10, 0.35)
FRAGMENTED = (0.30, 0.60)
ADDRESSABLE = (0.50, 0.35)
FIGURE_TOKENS, FIGURE_RATE = 40, 0.25
LINE_CHARS, LINE_CHUNKS, LINE_SHARE = (20, 120), 8, 0.25
EXTREMES = 10


def percentile(ordered: Column, q: float) -> Column:
    """An index pick: the value at the whole part of n * q, the last at most."""
    n = F.size(ordered)
    return F.element_at(ordered, F.least(n - 1, F.floor(n * q).cast("int")) + 1)


def token_spread(chunks: DataFrame) -> DataFrame:
    """Least, median, 95th percentile, most, whole mean and total of tokens by document."""
    return chunks.groupBy("doc_id").agg(F.array_sort(F.collect_list("tokens")).alias("t"), F.sum("tokens").alias("total"), F.count("*").alias("chunks")).select(
        "doc_id",
        F.element_at("t", 1).alias("token_min"),
        percentile(F.col("t"), 0.5).alias("token_median"),
        percentile(F.col("t"), 0.95).alias("token_p95"),
        F.element_at("t", -1).alias("token_max"),
        F.floor(F.col("total") / F.col("chunks")).cast("long").alias("token_mean"),
        F.col("total").alias("total_tokens"),
    )


def extremes(chunks: DataFrame, most: int = EXTREMES) -> DataFrame:
    """The longest (ties: later first) and shortest (ties: earlier first) chunks of each document."""
    longest = Window.partitionBy("doc_id").orderBy(F.desc("tokens"), F.desc("ordinal"))
    shortest = Window.partitionBy("doc_id").orderBy("tokens", "ordinal")
    pick = lambda w, name: chunks.withColumn("place", F.row_number().over(w)).where(F.col("place") <= most).select("doc_id", F.lit(name).alias("end"), "place", "ordinal", "tokens")
    return pick(longest, "longest").unionByName(pick(shortest, "shortest"))


def ordinal_gaps(chunks: DataFrame) -> DataFrame:
    """Ordinals that are missing right after one that is there."""
    before = F.lag("ordinal").over(Window.partitionBy("doc_id").orderBy("ordinal"))
    return chunks.withColumn("_before", before).where(F.col("ordinal") != F.col("_before") + 1).select("doc_id", (F.col("_before") + 1).alias("missing"))


def scattered_sections(chunks: DataFrame) -> DataFrame:
    """Sections whose ordinals are not one run."""
    runs = chunks.where("section is not null").groupBy("doc_id", "section").agg(F.min("ordinal").alias("a"), F.max("ordinal").alias("b"), F.count("*").alias("n"))
    return runs.where("b - a + 1 <> n").select("doc_id", "section")


def uncovered_pages(chunks: DataFrame, documents: DataFrame) -> DataFrame:
    """Pages of paginated documents that no chunk's range covers."""
    all_pages = documents.where("page_count > 0").select("doc_id", F.explode(F.sequence(F.lit(1), "page_count")).alias("page"))
    held = chunks.where("page_start is not null").select("doc_id", F.explode(F.sequence("page_start", F.greatest("page_start", "page_end"))).alias("page"))
    return all_pages.join(held, ["doc_id", "page"], "left_anti")


def measures(chunks: DataFrame, documents: DataFrame) -> DataFrame:
    """Counts of chunks, with images, without heading, and (paginated documents) without a page."""
    return (
        chunks.join(documents.select("doc_id", "page_count"), "doc_id")
        .groupBy("doc_id")
        .agg(
            F.count("*").alias("chunks"),
            F.count_if(F.col("image_count") > 0).alias("with_images"),
            F.count_if(F.col("heading_path") == "").alias("headless"),
            F.count_if(F.col("page_count").isNotNull() & F.col("page_start").isNull()).alias("missing_locator"),
        )
    )


def section_counts(chunks: DataFrame) -> DataFrame:
    """chunks, headless, distinct paths (a blank one counts), the largest path (first among equals) and its size."""
    paths = chunks.groupBy("doc_id", "heading_path").agg(F.count("*").alias("n"), F.min("ordinal").alias("first"))
    return paths.groupBy("doc_id").agg(
        F.sum("n").alias("chunks"),
        F.sum(F.when(F.trim("heading_path") == "", F.col("n")).otherwise(0)).alias("headless"),
        F.count("*").alias("paths"),
        F.max_by("heading_path", F.struct("n", -F.col("first"))).alias("largest"),
        F.max("n").alias("largest_size"),
    )


LINE_ENDS = r"[\n\r\x0B\f\x1C-\x1E\x{85}\x{2028}\x{2029}]"
LINE_END = rf"\r\n|{LINE_ENDS}"


def line_keys(chunks: DataFrame) -> DataFrame:
    """doc_id, chunk_id, line_key of the lines that may count as repeated; once or more a chunk.

    A line is trimmed behind an inline(), through which no filter is pushed, so once.
    """
    held = F.when(F.col("text").rlike(LINE_ENDS), F.split("text", LINE_END)).otherwise(F.array("text"))
    lines = chunks.where("text is not null").select("doc_id", "chunk_id", F.explode(held).alias("line")).where(F.length("line") >= LINE_CHARS[0])
    lines = lines.select("doc_id", "chunk_id", F.inline(F.array(F.struct(T.bare(F.col("line")).alias("line")))))
    candidates = lines.where(F.length("line").between(*LINE_CHARS) & F.col("line").rlike(r"[\p{L}\p{Nl}\p{No}]"))
    return candidates.select("doc_id", "chunk_id", T.line_key(F.col("line")).alias("line_key"))


def line_times(keys: DataFrame) -> DataFrame:
    """doc_id, line_key, times: lines that stand in eight chunks of a document, or more.

    One shuffle and one sort; ranks count chunks, so that no table of all lines is held.
    """
    place = F.dense_rank().over(Window.partitionBy("doc_id", "line_key").orderBy("chunk_id"))
    often = keys.repartition("doc_id").withColumn("place", place).where(F.col("place") >= LINE_CHUNKS)
    return often.groupBy("doc_id", "line_key").agg(F.max("place").cast("long").alias("times"))


def _many(chunks: Column) -> Column:
    return F.greatest(F.lit(LINE_CHUNKS), F.floor(chunks * LINE_SHARE))


def repeated_lines(chunks: DataFrame) -> DataFrame:
    """doc_id, line_key, times: lines that stand in many chunks of a document, digits and spaces folded."""
    sizes = chunks.groupBy("doc_id").agg(F.count("*").alias("chunks"))
    return line_times(line_keys(chunks)).join(sizes, "doc_id").where(F.col("times") >= _many(F.col("chunks"))).select("doc_id", "line_key", "times", "chunks")


def _severity(rate: Column, limits: tuple[float, float]) -> Column:
    return F.when(rate >= limits[1], "unusable").when(rate >= limits[0], "degraded")


def graded_size(text: Column, images: Column) -> Column:
    """A size on the same side of every threshold of findings() as the text's token estimate.

    A text has no more atoms than characters, so a chunk without images, whose only threshold near is MIN_TOKENS, is
    not cut where its characters are too few to reach that.
    """
    most = T.tokens_of(F.char_length(text))
    return F.when((most < MIN_TOKENS) & (images <= 0), most).otherwise(T.token_estimate(text))


def findings(chunks: DataFrame, marked_up: bool = False, keys: DataFrame | None = None) -> DataFrame:
    """doc_id, code, severity of documents of 25 chunks or more.

    ``chunks`` has doc_id, chunk_id, ordinal, section, heading_path, text, tokens, image_count. One pass, grouped by
    path within a document's partition and then by document, gives the rates; repeated lines are a second, over
    lines, or over ``keys`` (as of line_keys) where those are there already.
    """
    tokens, images = F.col("tokens"), F.col("image_count")
    figure = (images > 0) & (tokens < FIGURE_TOKENS)
    mergeable = ~figure & F.col("section").isNull()
    flags = {"over": tokens > MAX_TOKENS, "population": mergeable, "fragments": mergeable & (tokens < MIN_TOKENS), "figures": figure}
    rows = chunks.where("doc_id is not null").select("doc_id", "heading_path", *[f.alias(name) for name, f in flags.items()])
    paths = rows.repartition("doc_id").groupBy("doc_id", "heading_path").agg(F.count("*").alias("n"), *[F.count_if(name).alias(name) for name in flags])
    facts = (
        paths.groupBy("doc_id")
        .agg(
            F.sum("n").alias("n"),
            F.count("*").alias("paths"),
            F.max("n").alias("largest_size"),
            F.max(T.depth(F.col("heading_path"))).alias("deepest"),
            *[F.sum(name).alias(name) for name in flags],
        )
        .where(F.col("n") >= GRADED_FROM)
        .join(line_times(line_keys(chunks) if keys is None else keys).groupBy("doc_id").agg(F.max("times").alias("times")), "doc_id", "left")
    )
    n = F.col("n")
    ratio, share = F.col("paths") / n, F.col("largest_size") / n
    named = {
        "oversized": _severity(F.col("over") / n, OVERSIZED),
        "fragmented": F.when(F.col("population") >= GRADED_FROM, _severity(F.col("fragments") / F.col("population"), FRAGMENTED)),
        "flat_hierarchy": F.when((n >= FLAT_FROM) & (F.col("deepest") <= 1), "degraded"),
        "figure_dominated": F.when(F.col("figures") / n >= FIGURE_RATE, "degraded"),
        "unaddressable": F.when(
            (share >= ADDRESSABLE[0]) | (~F.lit(marked_up) & (ratio < ADDRESSABLE[0])), F.when(ratio < ADDRESSABLE[1], "unusable").otherwise("degraded")
        ),
        "boilerplate": F.when(F.col("times") >= _many(n), "degraded"),
    }
    return facts.select("doc_id", F.inline(F.array(*[F.struct(F.lit(c).alias("code"), s.alias("severity")) for c, s in named.items()]))).where("severity is not null")


def judged(found: DataFrame, documents: DataFrame) -> DataFrame:
    """doc_id, findings (their number, null without any), verdict: the worst severity, good without findings, unusable without chunks."""
    rank = F.when(F.col("severity") == "unusable", 2).otherwise(1)
    worst = found.groupBy("doc_id").agg(F.max(rank).alias("worst"), F.count("*").alias("findings"))
    level = F.when((F.col("worst") == 2) | (F.col("chunk_count") == 0), "unusable").when(F.col("worst") == 1, "degraded").otherwise("good")
    return documents.select("doc_id", "chunk_count").join(worst, "doc_id", "left").select("doc_id", "findings", level.alias("verdict"))


def verdicts(found: DataFrame, documents: DataFrame) -> DataFrame:
    """doc_id, verdict of judged."""
    return judged(found, documents).select("doc_id", "verdict")
