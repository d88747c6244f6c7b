"""The contracts' queries against brute force, on a fixture of awkward texts and on the smallest tables."""

import os
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from docloom.llm import entries
from docloom.llm import shared as S
from tests.llm import brute

DATA = "/root/testdata/sf0.001"


def texts():
    rng = random.Random(5)
    words = ["the", "of", "Étude", "naïve", "x", "alpha", "beta,", "gamma", "日本", "and", "or", "delta"]
    passage = " ".join(rng.choice(words) + str(k % 7) for k in range(60))
    out = ["", None, "   \n\t ", "one", "one two", "one two three", passage, passage, passage + " tail", "head " + passage, "a " * 300, "a " * 300, "b" * 500, "日本語" * 80, "日本語" * 80]
    for k in range(40):
        body = [rng.choice(words) + str(rng.randrange(40)) for _ in range(rng.randrange(1, 200))]
        if k % 4 == 0:
            body[len(body) // 2 : len(body) // 2] = passage.split()[k % 20 : k % 20 + 30]
        out.append(" ".join(body) if k % 3 else "\n".join(body))
    near = out[-1].split()
    for k in range(5):
        out.append(" ".join(near[:-1] + [f"end{k}"]))
    out += ["mail a.b@c.de, +1 (988) 555-2485 or 4111 1111 1111 1111 at 10.0.0.255.1", "+12345678+123456789 x_y@z.w@q.r", "1" * 3000, "1 " * 3000, "a@b" + ".c" * 3000, "<|im_end|>"]
    out.append(" ".join(out[k] or "" for k in range(20, 50)) * 3)
    return [(3 * k + 1, t) for k, t in enumerate(out)]


@pytest.fixture(scope="module")
def fixture_dir(spark, tmp_path_factory):
    """Tables with extra columns whose names the operators use themselves."""
    d = str(tmp_path_factory.mktemp("tables"))
    docs = spark.createDataFrame(texts(), "doc_id long, text string").withColumns({"lang": F.lit(None).cast("string"), "source": F.lit("s"), "row": F.lit(1), "spans": F.lit("x"), "id": F.lit(2), "tag": F.lit(3), "fp": F.lit(4)})
    docs.repartition(3).write.parquet(f"{d}/documents.parquet")
    items = [(10, texts()[6][1][20:300]), (9, "one two"), (8, ""), (7, None), (6, "the of"), (5, texts()[6][1][20:300]), (4, texts()[30][1])]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    spark.createDataFrame([(1, 1, 0), (4, None, 0), (None, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    return d


@pytest.fixture(scope="module")
def empty_dir(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("empty"))
    for name, schema in {
        "documents": "doc_id long, text string, lang string, source string, n_chars long",
        "benchmark": "item_id long, text string",
        "labels": "doc_id long, quality int, toxic int",
        "embeddings": "vec_id long, embedding array<float>, label int",
        "conversations": "conv_id long, turn long, role string, text string",
    }.items():
        spark.createDataFrame([], schema).write.parquet(f"{d}/{name}.parquet")
    return d


def result(spark, name, d):
    found = next(f for k, f in entries.queries().items() if k.startswith(name + "_"))
    return {r[0]: tuple(r)[1:] for r in found(spark, d).collect()}


def table(spark, d, name):
    return [tuple(r) for r in spark.read.parquet(f"{d}/{name}.parquet").select(*{"documents": ("doc_id", "text"), "benchmark": ("item_id", "text")}[name]).collect()]


dirs = pytest.mark.parametrize("where", ["fixture", pytest.param("small", marks=pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables"))])


def place(where, fixture_dir):
    return fixture_dir if where == "fixture" else DATA


@dirs
def test_op3(spark, fixture_dir, where):
    d = place(where, fixture_dir)
    got = result(spark, "op3", d)
    for doc, text in table(spark, d, "documents"):
        want = brute.pii(text)
        counts = tuple(sum(s.startswith(k + ":") for s in want.split(",")) for k in brute.PII)
        assert got[doc][:5] == (*counts, brute.sha(want.encode())), doc
        assert set(filter(None, want.split(","))) <= set(got[doc][5].split(","))


@dirs
def test_op4(spark, fixture_dir, where):
    d = place(where, fixture_dir)
    assert result(spark, "op4", d) == brute.repeated_words(table(spark, d, "documents"))


@dirs
def test_op5(spark, fixture_dir, where):
    d = place(where, fixture_dir)
    assert result(spark, "op5", d) == brute.contamination(table(spark, d, "documents"), table(spark, d, "benchmark"))


@dirs
def test_op6(spark, fixture_dir, where):
    d = place(where, fixture_dir)
    assert result(spark, "op6", d) == brute.simhash(table(spark, d, "documents"))


@dirs
def test_op7(spark, fixture_dir, where):
    import zlib

    from tokenizers import Tokenizer

    d = place(where, fixture_dir)
    tokenizer = Tokenizer.from_file(entries.tokenizer_path())
    rows = entries.op7_best_fit_packing(spark, d).collect()
    by, bins = {}, {}
    for r in rows:
        by.setdefault(r.doc_id, []).append(r)
        bins.setdefault(r.sequence_id, []).append(r)
    total = 0
    for doc, text in table(spark, d, "documents"):
        ids = np.array(tokenizer.encode(text or "", add_special_tokens=False).ids + [1], "<u4")
        total += len(ids)
        got = [(r.piece, r.start, r.length, r.ids_crc32) for r in sorted(by[doc], key=lambda r: r.piece)]
        assert got == [(k, k * 4096, len(p), zlib.crc32(p.tobytes())) for k, p in enumerate(ids[a : a + 4096] for a in range(0, len(ids), 4096))], doc
    for pieces in bins.values():
        pieces.sort(key=lambda r: r.offset)
        assert [r.offset for r in pieces] == [sum(x.length for x in pieces[:k]) for k in range(len(pieces))] and sum(r.length for r in pieces) <= 4096
    assert len(bins) <= -(-total // 4096) + 2


@dirs
def test_op10(spark, fixture_dir, where):
    d = place(where, fixture_dir)
    assert result(spark, "op10", d) == brute.repeated_bytes(table(spark, d, "documents"))


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")
@pytest.mark.parametrize("name", sorted(entries.oracle_sql()))
def test_sql(spark, name):
    con = duckdb.connect()
    for t in ("conversations", "embeddings"):
        con.sql(f"create view {t} as from '{DATA}/{t}.parquet'")
    got, want = entries.queries()[name](spark, DATA).toArrow(), con.sql(entries.oracle_sql()[name]).to_arrow_table()
    columns = sorted(got.schema.names)
    assert columns == sorted(want.schema.names)
    assert sorted(map(repr, zip(*[got[c].to_pylist() for c in columns], strict=True))) == sorted(map(repr, zip(*[want[c].to_pylist() for c in columns], strict=True)))


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="no tables")
def test_learned_labels_hold_on_held_out_rows(spark):
    d = "/root/testdata/sf0.01"
    docs = {r.doc_id: r.lang for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    got = result(spark, "op2", d)
    assert set(got) == set(docs)
    held = [(docs[k], v[1]) for k, v in got.items() if v[0]]
    assert np.mean([a == b for a, b in held]) > 0.95
    quality = {r.doc_id: r.quality for r in spark.read.parquet(f"{d}/labels.parquet").collect()}
    got = result(spark, "op9", d)
    held = [(quality[k], v[2]) for k, v in got.items() if v[0] and k in quality]
    assert np.mean([a == b for a, b in held]) > 0.9


def test_every_language_is_learned(spark, monkeypatch):
    from docloom.llm import langid

    seen = []
    monkeypatch.setattr(langid.Network, "fit", lambda self, x, used, y: seen.extend(np.unique(y)))
    rows = [(k, f"l{k}", f"word{k} here") for k in range(300)] + [(900, "long", "ab " * 30000), (901, "l0", "cd " * 30000)]
    network = langid.train(spark.createDataFrame(rows, "doc_id long, lang string, text string"))
    assert set(network.langs) == {*(f"l{k}" for k in range(300)), "long"} and len(seen) == 301


def test_texts_without_letters_or_labels(spark, fixture_dir):
    got = result(spark, "op2", fixture_dir)
    assert len(got) == len(texts()) and all(v[1:] == ("und", 0.0) for v in got.values())
    got = result(spark, "op9", fixture_dir)
    assert len(got) == len(texts()) and all(0 <= v[1] <= 1 for v in got.values())


def test_empty_tables(spark, empty_dir):
    for name, query in entries.queries().items():
        rows = query(spark, empty_dir).collect()
        assert len(rows) == (1 if name.startswith("op1_") else 0), name


def test_null_ids_and_repeated_rows(spark, tmp_path):
    text = " ".join(f"w{k}" for k in range(40))
    rows = [(None, text), (5, text), (5, text), (5, "other " + text), (2, text + " more"), (None, None)]
    spark.createDataFrame(rows, "doc_id long, text string").withColumns({"lang": F.lit("en"), "source": F.lit("s")}).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, text)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for name, query in entries.queries().items():
        if name.startswith(("op1_", "op8_")):
            continue
        got = query(spark, str(tmp_path))
        assert got.count() == len(rows), name
    words = {(r.doc_id, r.n_words): r.n_removed for r in entries.op4_substring_dedup(spark, str(tmp_path)).collect()}
    # a null id is before all others: its text is the first, and every later occurrence goes
    assert words == {(None, 40): 0, (5, 40): 40, (5, 41): 40, (2, 41): 40, (None, 0): 0}


def test_hot_anchors_take_the_path_by_windows(spark, monkeypatch, fixture_dir):
    from docloom.llm import repeats

    monkeypatch.setattr(repeats, "HOT", 1)
    docs = table(spark, fixture_dir, "documents")
    assert result(spark, "op4", fixture_dir) == brute.repeated_words(docs)
    assert result(spark, "op10", fixture_dir) == brute.repeated_bytes(docs)


@pytest.mark.parametrize("hot", [1, 10_000])
def test_bodies_are_joined_where_a_bitmap_would_be_too_large(spark, monkeypatch, fixture_dir, hot):
    from docloom.llm import repeats

    monkeypatch.setattr(repeats, "MOST_BITS", 1)
    monkeypatch.setattr(repeats, "HOT", hot)
    docs = table(spark, fixture_dir, "documents")
    assert result(spark, "op4", fixture_dir) == brute.repeated_words(docs)
    assert result(spark, "op10", fixture_dir) == brute.repeated_bytes(docs)


def test_tasks_that_fold_often_change_nothing(spark, monkeypatch, fixture_dir):
    from docloom.llm import repeats

    for name, value in (("BUFFER", 1), ("HOT", 1)):
        monkeypatch.setattr(repeats, name, value)
    docs = table(spark, fixture_dir, "documents")
    assert result(spark, "op4", fixture_dir) == brute.repeated_words(docs)
    assert result(spark, "op10", fixture_dir) == brute.repeated_bytes(docs)


def test_one_document_keeps_its_own_repeats_of_words(spark, tmp_path):
    passage = " ".join(f"p{k}" for k in range(30))
    rows = [(1, f"{passage} x {passage}"), (1, f"{passage} other"), (2, f"{passage} y {passage}"), (None, f"z {passage}")]
    for name, data, kept in (("ids", rows[:3], {(1, 61): 0, (1, 31): 0, (2, 61): 60}), ("null", rows, {(1, 61): 60, (1, 31): 30, (2, 61): 60, (None, 31): 0})):
        spark.createDataFrame(data, "doc_id long, text string").repartition(2).write.parquet(f"{tmp_path}/{name}/documents.parquet")
        got = entries.op4_substring_dedup(spark, f"{tmp_path}/{name}").collect()
        assert {(r.doc_id, r.n_words): r.n_removed for r in got} == kept


def test_long_texts_across_blocks(spark, tmp_path):
    rng = random.Random(3)
    long = " ".join(f"w{rng.randrange(10**6)}" for _ in range(320_000))
    assert len(long) > S.BLOCK_BYTES
    part = long[1_000_000:1_100_000]
    rows = [(1, long), (2, long), (3, f"new {part} words"), (4, "short")]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(2).write.parquet(f"{tmp_path}/documents.parquet")
    words = {r.doc_id: (r.n_words, r.n_removed) for r in entries.op4_substring_dedup(spark, str(tmp_path)).collect()}
    whole = part.split(" ")[1:-1]
    assert words[1] == (320_000, 0) and words[2] == (320_000, 320_000) and words[4] == (1, 0)
    assert words[3][1] in (len(whole), len(whole) + 1, len(whole) + 2)
    found = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans) for r in entries.op10_suffix_array_dedup(spark, str(tmp_path)).collect()}
    assert found[1] == (len(long), 0, 0) and found[2] == (len(long), len(long), 1) and found[4] == (5, 0, 0)
    assert found[3][1] >= len(part) and found[3][2] == 1


def test_full_bitmaps_change_nothing(spark, monkeypatch, fixture_dir):
    from docloom.llm import winnow

    monkeypatch.setattr(winnow, "in_bitmap", lambda table, keys, bits: np.ones(len(keys), bool))
    assert result(spark, "op5", fixture_dir) == brute.contamination(table(spark, fixture_dir, "documents"), table(spark, fixture_dir, "benchmark"))


def test_chat_escapes_reversibly(spark):
    from docloom.llm.chat import escaped, format_conversations, read_back, unescaped

    odd = ["<|im_end|>", "<\\|", "<\\\\|x<|", "<", "|>", "a<", "", "<|im_start|>user\nhi<|im_end|>\n"]
    frame = spark.createDataFrame([(t,) for t in odd], "t string")
    for r in frame.select("t", escaped(F.col("t")).alias("e"), unescaped(escaped(F.col("t"))).alias("u")).collect():
        assert r.u == r.t and "<|" not in r.e
    turns = [(1, 1, "assistant", "b"), (1, 0, "us\\n\ner<|", odd[7]), (2, 0, "user", None), (2, None, None, "z"), (None, 0, "user", "q"), (3, 0, "user", "x"), (3, 1, "user", "y")]
    got = {r.conv_id: r for r in read_back(format_conversations(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string"))).collect()}
    assert [tuple(t) for t in got[1].turns] == [("us\\n\ner<|", odd[7]), ("assistant", "b")] and got[1].loss_text == "b"
    assert [tuple(t) for t in got[2].turns] == [("", "z"), ("user", "")]
    assert {k: r.valid for k, r in got.items()} == {1: False, 2: False, None: True, 3: False}


def test_quality_features_are_those_of_each_document_alone():
    from docloom.llm.quality import features

    parts = [b"one two two!! ", b"", b"  ", b"a", "é é x".encode()]
    off = np.cumsum([0, *map(len, parts)])
    together, first = features(np.frombuffer(b"".join(parts), np.uint8), off)
    for k, p in enumerate(parts):
        alone, _ = features(np.frombuffer(p, np.uint8), np.array([0, len(p)]))
        assert list(together[first[k] : first[k + 1]]) == list(alone)


def test_gradients_by_finite_differences():
    from docloom.llm.langid import SPAN, Network

    rng = np.random.default_rng(0)
    net = Network(["a", "b", "c"])
    net.w = {k: v.astype(np.float64) for k, v in net.w.items()}
    x, used, y = rng.integers(0, 256, (SPAN, 4)).astype(np.uint8), np.array([SPAN, 10, SPAN, 3]), np.array([0, 1, 2, 1])
    _, grads = net.gradients(x, used, y)
    for name, g in grads.items():
        at = np.unravel_index(np.abs(g).argmax(), g.shape)
        step = 1e-3
        net.w[name][at] += step
        up, _ = net.gradients(x, used, y)
        net.w[name][at] -= 2 * step
        down, _ = net.gradients(x, used, y)
        net.w[name][at] += step
        assert abs((up - down) / (2 * step) - g[at]) < 2e-3 + 0.05 * abs(g[at]), name


def test_fm_index_classes_are_equal_windows():
    from docloom.llm.substring import FMIndex

    rng = np.random.default_rng(1)
    for depth, alphabet in ((13, 3), (5, 9), (2, 2)):
        runs = [rng.integers(1, alphabet + 1, n) for n in rng.integers(depth, 60, 20)]
        text = np.concatenate([np.append(r, 0) for r in runs])
        first = np.cumsum([0, *[len(r) + 1 for r in runs[:-1]]])
        count = np.array([len(r) - depth + 1 for r in runs])
        got = FMIndex(text, depth).stream(text, first, count)
        windows = [tuple(r[k : k + depth]) for r in runs for k in range(len(r) - depth + 1)]
        number = {w: k for k, w in enumerate(sorted(set(windows)))}
        seen = {}
        for w, c in zip(windows, got, strict=True):
            assert seen.setdefault(number[w], c) == c
        assert len(set(seen.values())) == len(seen)


def test_suffixes_of_a_bucket_are_in_order():
    from docloom.llm.suffix import bucket_order, cover_ranks, leading

    rng = np.random.default_rng(2)
    data = np.concatenate([rng.integers(97, 99, 400).astype(np.uint8), np.full(150, 97, np.uint8), rng.integers(97, 99, 100).astype(np.uint8)])
    data = np.concatenate([data, data[:300]])
    seven = leading(data, 7)
    at = np.flatnonzero(data == 97)
    at = at[at <= len(data) - 100]
    got = bucket_order(at, seven, cover_ranks(data, seven, 100))
    raw = data.tobytes()
    heads = [raw[k : k + 100] for k in got.tolist()]
    assert heads == sorted(heads) and sorted(got) == sorted(at)


def test_packing_fills_bins():
    from docloom.llm.packing import fill

    rng = np.random.default_rng(3)
    for lengths in (rng.integers(1, 4097, 300), np.full(50, 1366), np.ones(5000, int), np.array([4096] * 3), np.zeros(0, int)):
        bins, offsets = fill(lengths, 4096)
        sums = np.bincount(bins, lengths) if len(bins) else np.zeros(0)
        assert (sums <= 4096).all() and len(sums) >= lengths.sum() / 4096
    assert fill(np.array([4000, 96, 3000, 1000, 96]), 4096)[0].max() == 1


def test_gray_index_links_what_brute_force_links():
    from docloom.llm.simhash import shard_links

    rng = np.random.default_rng(4)
    base = rng.integers(0, 1 << 63, 60, dtype=np.uint64)
    codes = [base]
    for _ in range(8):
        codes.append(base ^ (np.uint64(1) << rng.integers(0, 64, 60, dtype=np.uint64)))
        codes.append(codes[-1] ^ (np.uint64(1) << rng.integers(0, 64, 60, dtype=np.uint64)))
    codes = np.unique(np.concatenate(codes))
    a, b = shard_links(codes, 3, 0)
    root = np.arange(len(codes))
    for _ in range(5):
        root[a] = root[b]
    want = {}
    close = np.bitwise_count(codes[:, None] ^ codes[None]) <= 3
    group = np.arange(len(codes))
    for _ in range(len(codes)):
        new = np.where(close, group[None], len(codes)).min(axis=1)
        if (new == group).all():
            break
        group = new
    for g, r in zip(group, root, strict=True):
        assert want.setdefault(g, r) == r
    assert len(set(want.values())) == len(want)


def test_pivot_search_is_exact_and_breaks_ties_by_id():
    from docloom.llm.topk import choose_pivots, search_block

    rng = np.random.default_rng(5)
    rows = rng.integers(-3, 4, (500, 6))
    ids = rng.permutation(500)
    got = search_block(rows[:20], ids[:20], rows, ids, choose_pivots(rows[:50], 8), 10)
    for q in range(20):
        scores = rows @ rows[q]
        order = [k for k in sorted(range(500), key=lambda k: (-scores[k], ids[k])) if ids[k] != ids[q]][:10]
        assert list(got[q]) == order


def test_top_k_of_repeated_unequal_and_broken_vectors(spark, tmp_path):
    nan, rows = float("nan"), [(0, [1.0, 2.0]), (0, [-1.0, 0.5]), (0, [1.0, 2.0]), (1, [3.0]), (1, [3.0]), (2, [0.0, 0.0, 9.0]), (100, [1.0, -1.0])]
    broken = [(3, None), (4, [1.0, None]), (5, [nan]), (6, [float("inf")]), (None, [50.0, 50.0]), (200, [])]
    table = spark.createDataFrame(rows + broken, "vec_id long, embedding array<double>").withColumns({"tag": F.lit("x"), "p": F.lit(1), "v": F.lit(2)})
    table.write.parquet(f"{tmp_path}/embeddings.parquet")
    got = sorted(tuple(r) for r in entries.op8_exact_top_k(spark, str(tmp_path)).select("query_id", "rank", "vec_id", "score").collect())
    whole = [(i, [int(1024 * x) for x in v]) for i, v in [*rows, (200, [])]]
    want = []
    for query, v in whole:
        if query % 100 == 0:
            scored = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in whole if i != query)
            want += [(query, k + 1, i, -s) for k, (s, i) in enumerate(scored[:10])]
    assert got == sorted(want)


def test_bootstrapped_patterns_find_unseen_identifiers(spark):
    from docloom.llm.pii import find_spans, written_spans

    rows = [(k, f"write to my mail: user{k}@host{k}.org now") for k in range(12)] + [(90, "write to my mail: user90@localhost now"), (91, "see item user91@localhost now")]
    got = {r.doc_id: r.s for r in find_spans(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", written_spans("spans").alias("s")).collect()}
    assert got[90] == "email:18:34" and got[91] == "" and got[3] == "email:18:33"


def test_contexts_of_one_word_and_across_earlier_mentions(spark):
    from docloom.llm.pii import find_spans, written_spans

    rows = [(k, f"mail: user{k}@host{k}.org now") for k in range(12)] + [(90, "mail: user90@localhost now"), (91, "due 12/25 mail: user91@localhost now"), (92, "user92@localhost mail: user93@localhost")]
    rows += [(100 + k, f"id{k} u{k}@h{k}.org") for k in range(3)]
    found = find_spans(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", written_spans("spans").alias("s"))
    got = {r.doc_id: r.s for r in found.collect()}
    assert got[3] == "email:6:21" and got[90] == "email:6:22" and got[91] == "email:16:32" and got[92] == "email:23:39"


def test_mentions_carry_the_words_before_them(spark):
    from docloom.llm.pii import mentions

    texts = {"SSN 123-45-6789": [["1 ssn"]], "on 12/25 passport 99887766": [["1 on"], ["1 passport", "2 12/25 passport"]], "1a": [[]], "a b c 12": [["1 c", "2 b c"]], "x1 y2": [[], ["1 x1"]]}
    frame = spark.createDataFrame([(t,) for t in texts], "text string")
    for r in frame.select("text", mentions(F.col("text")).alias("m")).collect():
        assert [list(m.patterns) for m in r.m] == texts[r.text], r.text


def test_texts_of_very_many_matches(spark):
    from docloom.llm.pii import find_spans, redact, written_spans

    rng = random.Random(9)
    kinds = ["mail u{}@h{}.org", "ip 10.0.{}.{}", "card 4111 1111 1111 1111", "+1 (988) 555-2485 {}", "é {}", "x{}@y"]
    long = " ".join(rng.choice(kinds).format(rng.randrange(300), rng.randrange(255)) for _ in range(6_000))
    texts = [long, long[:3000], long[7:1029], None, "", "word " * 1000 + "a@b.cd" + " word" * 1000]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r.doc_id: r for r in find_spans(docs).select("doc_id", written_spans("base").alias("base"), "spans").collect()}
    for r in redact(docs).collect():
        t = texts[r.doc_id]
        assert found[r.doc_id].base == brute.pii(t)
        out, pos = [], 0
        for s in sorted(found[r.doc_id].spans):
            if s.start >= pos:
                out += [t[pos : s.start], f"[{['EMAIL', 'IP', 'CARD', 'PHONE'][s.kind]}]"]
            pos = max(pos, s.end)
        assert r.text == (t if t is None else "".join([*out, t[pos:]]))


def test_words_by_merges_equal_the_library():
    from docloom.llm.packing import WordIds

    rng = random.Random(6)
    letters = "abcdefghijklmnopqrstuvwxyzABCÀÉßñüÿ×÷0129-_'!.,$%<|>éœšЖ漢😀  "
    docs = [" ".join("".join(rng.choice(letters) for _ in range(rng.randrange(1, 14))) for _ in range(300)) for _ in range(6)]
    docs += ["<|endoftext|> x<|startoftext|>y it's we'LL 'tis", "", "é Å ﬁ İ ΑΣ", "x" * 100]
    words = WordIds(entries.tokenizer_path())
    raw = [t.encode() for t in docs]
    ids, first = words.encode(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))
    for k, t in enumerate(docs):
        assert list(ids[first[k] : first[k + 1]]) == words.tokenizer.encode(t, add_special_tokens=False).ids, t[:80]


def _same_by_library(words, texts):
    """Ids of words of many texts, each against the library's own on the joined text."""
    for lo in range(0, len(texts), 2000):
        part = " ".join(texts[lo : lo + 2000])
        raw = part.encode()
        ids, _ = words.encode(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
        assert list(ids) == words.tokenizer.encode(part, add_special_tokens=False).ids, (lo, part[:80])


def test_every_word_of_the_vocabulary_equals_the_library():
    from docloom.llm.packing import WordIds

    words = WordIds(entries.tokenizer_path())
    vocabulary = sorted(words.tokenizer.get_vocab())
    plain = [v.removesuffix("</w>") for v in vocabulary]
    texts = [v for v in dict.fromkeys([*vocabulary, *plain, *(a + b for a, b in zip(plain, reversed(plain), strict=True))]) if v and not v.isspace()]
    _same_by_library(words, texts)


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.1"), reason="no tables")
def test_every_distinct_word_of_the_documents_equals_the_library():
    from docloom.llm.packing import WordIds

    found = duckdb.sql("SELECT DISTINCT unnest(string_split_regex(text, '[ \\t\\n\\r\\x0B\\f]+')) AS w FROM '/root/testdata/sf0.1/documents.parquet'").fetchall()
    texts = sorted(w for (w,) in found if w)
    assert len(texts) > 10_000
    _same_by_library(WordIds(entries.tokenizer_path()), texts)


def test_repeated_rows_spread_over_groups(spark):
    from docloom.llm.packing import pack

    rows = [(1, k, 0, 0, 10, 7) for k in range(600)]
    cut = spark.createDataFrame(rows, "doc_id long, row long, piece int, start long, length long, ids_crc32 long")
    got = pack(cut, 100, 60).collect()
    assert len(got) == 600 and len({(r.sequence_id, r.offset) for r in got}) == 600
    assert len({r.sequence_id % 10 for r in got}) == 10


def test_special_names_inside_words_equal_the_library():
    from docloom.llm.packing import WordIds

    words = WordIds(entries.tokenizer_path())
    names = ("<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "<|endoftext", "<|", "<")
    docs = [before + name + after for name in names for before in ("", "!", "end.", ")", "a", "9", "é", "x<", ".,<|") for after in ("", ".", "b", "<|endoftext|>")]
    docs.append(" ".join(docs))
    for t in docs:
        raw = t.encode()
        ids, _ = words.encode(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
        assert list(ids) == words.tokenizer.encode(t, add_special_tokens=False).ids, t[:80]


def test_hash_table():
    rng = np.random.default_rng(8)
    table, keys = S.HashTable(12), np.unique(rng.integers(0, 1 << 62, 1500, dtype=np.uint64))
    table.add(keys[:900])
    table.add(keys[900:])
    assert list(table.find(keys)) == list(range(len(keys))) and (table.find(keys + np.uint64(1)) == -1).all()
