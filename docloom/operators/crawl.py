"""Crawled sites as tables: URL rules, page sets, link walks, repeated chrome, soft 404s and placements."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions import text as T

#: Fixed values.
CHROME_CHARS, CHROME_PAGES, CHROME_SHARE = 200, 5, 0.5
SOFT_RESEMBLES, SOFT_TOKENS, SOFT_COVERS = 0.7, 8, 0.9
WALK_DEPTH, WALK_BUDGET = 3, 500
#: Word counts of probes that one pass holds, and cells of its table of texts by probes.
PROBE_WORDS, CELLS = 1_000_000, 1 << 18
#: The session's limit of Arrow batches in bytes, and its value where none is set: a batch of long texts stays small.
BATCH, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 4 << 20


def normal_url(url: Column) -> Column:
    """Scheme and host in lower case, default port, user and fragment gone, dot segments resolved; query kept."""
    parts = lambda n: F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*)://(?:[^/?#@]*@)?([^/?#]*)([^?#]*)(\?[^#]*)?", n)
    scheme, host, path, query = F.lower(parts(1)), F.lower(parts(2)), parts(3), parts(4)
    port = F.when(scheme == "http", F.regexp_replace(host, ":(80)?$", "")).when(scheme == "https", F.regexp_replace(host, ":(443)?$", "")).otherwise(host)
    # a slash before each segment, and an empty last one for a path that ends in a slash
    segments = F.split(F.substring(F.when(path == "", "/").otherwise(path), 2, 1 << 30), "/", -1)
    empty = F.array().cast("array<string>")
    step = lambda out, s: F.when(s == ".", out).when(s == "..", F.slice(out, F.lit(1), F.greatest(F.size(out) - 1, F.lit(0)))).otherwise(F.concat(out, F.array(s)))
    kept = F.aggregate(segments, empty, step)
    open_end = F.element_at(segments, -1).isin(".", "..")
    kept = F.when(open_end, F.concat(kept, F.array(F.lit("")))).otherwise(kept)
    return F.when(scheme == "", F.lit(None)).otherwise(F.concat(scheme, F.lit("://"), port, F.lit("/"), F.array_join(kept, "/"), query))


def is_page_link(href: Column) -> Column:
    return F.coalesce(~F.lower(F.trim(href)).rlike(r"^($|#|mailto:|javascript:|tel:)"), F.lit(False))


def in_scope(url: Column, seed: str) -> Column:
    """Same host, and the seed's path or one below it."""
    origin = F.lit(seed)
    path = F.regexp_replace(F.coalesce(F.parse_url(origin, F.lit("PATH")), F.lit("")), "/+$", "")
    mine = F.coalesce(F.parse_url(url, F.lit("PATH")), F.lit(""))
    return F.coalesce((F.parse_url(url, F.lit("HOST")) == F.parse_url(origin, F.lit("HOST"))) & ((mine == path) | F.startswith(mine, F.concat(path, F.lit("/")))), F.lit(False))


def coverage_union(sources: list[DataFrame]) -> DataFrame:
    """url, source (the first that lists it), place (its place there) of page lists in order of trust; each has url, place."""
    every = reduce(DataFrame.unionByName, [s.select("url", F.col("place").cast("long").alias("place"), F.lit(k).alias("source")) for k, s in enumerate(sources)])
    return every.groupBy("url").agg(F.min(F.struct("source", "place")).alias("first")).select("url", "first.source", "first.place")


def missing_from(urls: DataFrame, listed: DataFrame) -> DataFrame:
    return urls.join(listed.select("url"), "url", "left_anti")


def walk(seeds: DataFrame, links: DataFrame, depth: int = WALK_DEPTH) -> DataFrame:
    """url, depth of pages reached by following links (source, target) breadth first, to a bounded depth."""
    seen = seeds.select("url").distinct().withColumn("depth", F.lit(0))
    frontier = seen
    for level in range(1, depth + 1):
        frontier = frontier.select(F.col("url").alias("source")).join(links, "source").select(F.col("target").alias("url")).distinct()
        frontier = frontier.join(seen, "url", "left_anti").withColumn("depth", F.lit(level))
        seen = seen.unionByName(frontier)
    return seen


def normal_text(text: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(text, r"\s+", " ")))


def page_path(base: Column, items: Column, title: Column) -> Column:
    """The headings above a place on a page: a first one that repeats the page's title and empty ones are left out."""
    inner = F.filter(items, lambda x: x != "")
    own = F.coalesce(normal_text(F.get(inner, F.lit(0))) == normal_text(title), F.lit(False))
    return F.concat(base, F.when(own, F.slice(inner, F.lit(2), F.size(inner))).otherwise(inner))


def site_title(given: Column, seed_title: Column, seed: Column) -> Column:
    """The name given, else the seed page's title, else its host, else its address."""
    host = F.regexp_extract(seed, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)
    said = F.when(F.length(given) > 0, F.trim(given))
    return F.coalesce(said, F.when(F.trim(seed_title) != "", F.trim(seed_title)), F.nullif(host, F.lit("")), seed)


def chrome(blocks: DataFrame) -> DataFrame:
    """library_id, block_key, pages of short blocks that stand on half of a site's pages, and five at least."""
    keyed = blocks.select("library_id", "url", normal_text(F.col("text")).alias("block_key")).where((F.length("block_key") > 0) & (F.length("block_key") <= CHROME_CHARS))
    pages = blocks.groupBy("library_id").agg(F.count_distinct("url").alias("all_pages"))
    on = keyed.distinct().groupBy("library_id", "block_key").agg(F.count("*").alias("pages"))
    return on.join(pages, "library_id").where((F.col("all_pages") >= CHROME_PAGES) & (F.col("pages") >= F.greatest(F.lit(CHROME_PAGES), F.floor(F.col("all_pages") * CHROME_SHARE)))).select("library_id", "block_key", "pages")


def without_chrome(blocks: DataFrame) -> DataFrame:
    keyed = blocks.withColumn("block_key", normal_text(F.col("text")))
    return keyed.join(chrome(blocks).select("library_id", "block_key"), ["library_id", "block_key"], "left_anti").drop("block_key")


def bags(texts: DataFrame, key: str) -> DataFrame:
    """key, token, n: word counts of each text."""
    return texts.select(key, F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}\p{N}_]+"), 0)).alias("token")).groupBy(key, "token").agg(F.count("*").alias("n"))


def resemblance(a: DataFrame, b: DataFrame) -> DataFrame:
    """a_key, b_key, shared, resembles: shared words over the larger text, for texts that share a word.

    Both are bags with columns key, token, n. ``b`` is meant to be a site's two probes, ``a`` its pages.
    """
    sizes = lambda x, name: x.groupBy("key").agg(F.sum("n").alias(name)).withColumnRenamed("key", f"{name[0]}_key")
    shared = (
        a.select(F.col("key").alias("a_key"), "token", F.col("n").alias("an"))
        .join(b.select(F.col("key").alias("b_key"), "token", F.col("n").alias("bn")), "token")
        .groupBy("a_key", "b_key")
        .agg(F.sum(F.least("an", "bn")).alias("shared"))
    )
    return (
        shared.join(sizes(a, "a_total"), "a_key")
        .join(sizes(b, "b_total"), "b_key")
        .select("a_key", "b_key", "shared", F.round(F.col("shared") / F.greatest("a_total", "b_total"), 6).alias("resembles"), "a_total", "b_total")
    )


class _Probes:
    """Word counts of some probes as posting lists, and the words that texts share with them."""

    def __init__(self, bag: pa.Table):
        keys, words = bag["key"].combine_chunks().dictionary_encode(), bag["token"].combine_chunks().dictionary_encode()
        self.keys, self.words = keys.dictionary, words.dictionary
        probe, word, n = keys.indices.to_numpy(), words.indices.to_numpy(), bag["n"].to_numpy()
        self.totals = np.bincount(probe, n, len(self.keys)).astype(np.int64)
        order = np.argsort(word, kind="stable")
        self.probe, self.n = probe[order].astype(np.int64), n[order]
        self.sizes = np.bincount(word, minlength=len(self.words))
        self.starts = np.cumsum(self.sizes) - self.sizes

    def shared(self, text: np.ndarray, words: pa.Array, texts: int) -> np.ndarray:
        """texts by probes; ``words`` and the text that each stands in."""
        found = pc.index_in(words, self.words)
        text, word = text[found.is_valid().to_numpy(zero_copy_only=False)], found.drop_null().to_numpy().astype(np.int64)
        at, n = np.unique(text * len(self.words) + word, return_counts=True)
        text, word = np.divmod(at, len(self.words))
        out = np.zeros(texts * len(self.keys), np.int64)
        sizes = self.sizes[word]
        ends = np.cumsum(sizes)
        first = 0
        while first < len(word):  # no more postings at once than cells, one word's at least
            last = max(first + 1, int(np.searchsorted(ends, (ends[first - 1] if first else 0) + CELLS, "right")))
            size = sizes[first:last]
            posting = np.repeat(self.starts[word[first:last]] - (np.cumsum(size) - size), size) + np.arange(size.sum())
            cell = np.repeat(text[first:last] * len(self.keys), size) + self.probe[posting]
            np.add.at(out, cell, np.minimum(np.repeat(n[first:last], size), self.n[posting]))
            first = last
        return out.reshape(texts, len(self.keys))


def text_resemblance(texts: DataFrame, probes: DataFrame) -> DataFrame:
    """The rows of resemblance for texts (key, text) held against probes (key, text); rows of one key are one text.

    Texts go to their key's partition once and their pairs are made there, so no pair is shuffled. Probes of more
    than a million word counts are taken in parts, one pass over the texts each.
    """
    spark = texts.sparkSession
    if spark.conf.get(BATCH, None) is None:
        spark.conf.set(BATCH, str(BATCH_BYTES))
    bag = bags(probes.where("key is not null and text is not null"), "key")
    parts = -(-bag.count() // PROBE_WORDS)
    kinds = texts.schema["key"].dataType.simpleString(), probes.schema["key"].dataType.simpleString()
    schema = f"a_key {kinds[0]}, b_key {kinds[1]}, shared long, a_total long, b_total long"
    placed = texts.where("key is not null and text is not null").select("key", "text").repartition("key").sortWithinPartitions("key")
    worded = placed.select("key", T.words(F.col("text")).alias("words"))

    def passed(part: int) -> DataFrame:
        rows = bag if parts == 1 else bag.where(F.pmod(F.xxhash64("key"), F.lit(parts)) == part)
        held = spark.sparkContext.broadcast(_Probes(rows.select("key", "token", "n").toArrow()))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index = held.value
            rest = None
            for batch in batches:
                if batch.num_rows:
                    table = pa.Table.from_batches([batch]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([batch])])
                    last = pc.index(table["key"], table["key"][-1]).as_py()  # the last key may go on in the next batch
                    rest = table.slice(last)
                    yield from _paired(table.slice(0, last), index)
            if rest is not None:
                yield from _paired(rest, index)

        return worded.mapInArrow(run, schema)

    if parts == 0:
        return spark.createDataFrame([], schema).select("a_key", "b_key", "shared", F.lit(0.0).alias("resembles"), "a_total", "b_total")
    pairs = reduce(DataFrame.unionByName, map(passed, range(parts)))
    return pairs.select("a_key", "b_key", "shared", F.round(F.col("shared") / F.greatest("a_total", "b_total"), 6).alias("resembles"), "a_total", "b_total")


def _paired(table: pa.Table, index: _Probes) -> Iterator[pa.RecordBatch]:
    """Pairs of texts (key, words; rows of a key are neighbours) and probes that share a word."""
    if not table.num_rows or not len(index.keys):
        return
    lists = table["words"].combine_chunks()
    words, parent = pc.list_flatten(lists), pc.list_parent_indices(lists).to_numpy()
    keys = table["key"].combine_chunks()
    new = np.ones(len(keys), bool)
    new[1:] = pc.not_equal(keys[1:], keys[:-1]).to_numpy(zero_copy_only=False)
    text, heads = (np.cumsum(new) - 1)[parent], np.flatnonzero(new)
    totals = np.bincount(text, minlength=len(heads))
    step = max(1, CELLS // len(index.keys))
    for first in range(0, len(heads), step):
        last = min(first + step, len(heads))
        a, b = np.searchsorted(text, [first, last])
        shared = index.shared(text[a:b] - first, words[a:b], last - first)
        row, probe = np.nonzero(shared)
        if len(row):
            columns = [keys.take(pa.array(heads[first + row])), index.keys.take(pa.array(probe)), pa.array(shared[row, probe]), pa.array(totals[first + row]), pa.array(index.totals[probe])]
            yield pa.RecordBatch.from_arrays(columns, ["a_key", "b_key", "shared", "a_total", "b_total"])


def soft_absent(pages: DataFrame, probes: DataFrame) -> DataFrame:
    """key, covers of pages that hold nine tenths of what both probes of missing pages share."""
    keys = probes.select("key").distinct().count()
    both = probes.groupBy("token").agg(F.min("n").alias("n"), F.count("*").alias("k")).where(F.col("k") == keys).select(F.lit("probe").alias("key"), "token", "n")
    total = both.agg(F.sum("n")).first()[0] or 0
    if total < SOFT_TOKENS:
        return resemblance(pages, both).select(F.col("a_key").alias("key"), F.lit(0.0).alias("covers")).limit(0)
    return resemblance(pages, both).select(F.col("a_key").alias("key"), F.round(F.col("shared") / total, 6).alias("covers")).where(F.col("covers") >= SOFT_COVERS)


def url_tree(pages: DataFrame) -> DataFrame:
    """host, url, section: dotted numbers of pages in their host's tree of URL paths, siblings in order of first sight.

    ``pages`` has host, url, place. One window a level numbers siblings under their parent, so no window
    holds more than a parent's children.
    """
    parts = F.filter(F.split(F.coalesce(F.parse_url("url", F.lit("PATH")), F.lit("")), "/"), lambda s: s != "")
    nodes = pages.select("host", "url", "place", parts.alias("parts")).withColumn("level", F.size("parts"))
    steps = nodes.select("host", "url", "place", "level", F.explode(F.sequence(F.lit(1), F.greatest("level", F.lit(1)))).alias("n"), "parts")
    prefix = F.array_join(F.slice("parts", F.lit(1), F.col("n")), "/")
    steps = steps.withColumn("prefix", prefix).withColumn("parent", F.array_join(F.slice("parts", F.lit(1), F.col("n") - 1), "/"))
    first = steps.groupBy("host", "parent", "prefix", "n").agg(F.min("place").alias("first"))
    numbered = first.withColumn("number", F.row_number().over(Window.partitionBy("host", "parent", "n").orderBy("first", "prefix")))
    found = steps.join(numbered.select("host", "prefix", "n", "number"), ["host", "prefix", "n"]).groupBy("host", "url").agg(F.array_sort(F.collect_list(F.struct("n", "number"))).alias("path"))
    return found.select("host", "url", F.array_join(F.transform("path", lambda x: x["number"].cast("string")), ".").alias("section"))
