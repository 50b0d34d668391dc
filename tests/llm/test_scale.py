"""Cases that small or well-kept tables do not meet."""

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from lakeguard.llm import embeddings, html_text, mixing, quality, simhash, toxicity
from lakeguard.llm.common import connected
from lakeguard.llm.kernels import components


def test_connected_on_a_million_links(spark):
    n = 1_000_000
    got = connected(spark.range(n).select((2 * F.col("id") + 1).alias("u"), (2 * F.col("id")).alias("v")))
    assert got.agg(F.count("*"), F.sum((F.col("root") == F.col("node") - F.col("node") % 2).cast("int"))).first() == (2 * n, 2 * n)


DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def prose(seed, n=60):
    return " ".join(np.random.default_rng(seed).choice([f"w{i}" for i in range(500)], n))


def listed(frame):
    return sorted(((r.doc_id, r.text) for r in frame.collect()), key=str)


def test_stages_keep_rows_of_null_and_repeated_ids(spark, tmp_path):
    a, b, c, d, e = map(prose, range(5))
    bench = prose(9, 15)
    rows = [(3, a), (5, a), (5, b), (None, c), (None, d), (None, d), (None, a), (7, e), (7, e), (None, None)]
    docs = spark.createDataFrame([(k, t, "en", "s", 0) for k, t in rows], DOCS).repartition(3)
    got = listed(corpus_pipeline.near_dedup_stage(spark, docs, ""))
    assert got == sorted([(3, a), (5, b), (None, c), (None, d), (7, e), (None, None)], key=str)
    spark.createDataFrame([(1, bench)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    dirty = [(None, f"{a} {bench}"), (None, b), (None, None), (5, f"{c} {bench}"), (5, d), (6, e)]
    docs = spark.createDataFrame([(k, t, "en", "s", 0) for k, t in dirty], DOCS)
    got = listed(corpus_pipeline.decontaminate_stage(spark, docs, str(tmp_path)))
    assert got == sorted([(None, b), (None, None), (5, d), (6, e)], key=str)


def test_style_tree_judges_branches_inside_articles(spark):
    own = [f"Own text {i} " + prose(i, 5) for i in range(40)]
    pages = [(i, f"http://h.example/{i}", f"<body><article><p>{t}</p><div class=blk><p>Read on every day</p></div></article><div class=more>More {t}</div></body>") for i, t in enumerate(own)]
    # a template on few pages of the host, and one page in many copies
    pages += [(100 + i, f"http://h.example/x{i}", f"<body><main><p>Rare {i}</p><div class=rare>Same line</div></main></body>") for i in range(12)]
    pages += [(200 + i, f"http://copies.example/{i}", "<body><article><p>One page</p></article></body>") for i in range(15)]
    got = {r.page_id: r.text for r in html_text.extract(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert all(got[i] == f"{t} More {t}" for i, t in enumerate(own))
    assert all(got[100 + i] == f"Rare {i}" and got[200 + i] == "One page" for i in range(12))


def test_misspelt_terms_that_stems_cover(spark):
    said = ["you trash", "such trashy things", "trashing it", "a worthless one", "worthlessness of it", "what a moron", "moronic", "total moronism"]
    rows = [(f"{t} {prose(i, 5)}", 1) for i, t in enumerate(said * 12)] + [(f"the clash of mornings {prose(i, 8)}", 0) for i in range(40)]
    matcher = toxicity.lexicon(spark.createDataFrame(rows, "text string, toxic long")).matcher
    assert {"trash", "worthless", "moron"} <= set(matcher.kinds({"trash", "worthless", "moron"}))
    assert any("trash".startswith(s) for s in toxicity.lexicon(spark.createDataFrame(rows, "text string, toxic long")).stems)
    assert {w: matcher.kind(w) for w in ("trash", "tarsh", "trsah", "thrash", "wrothless", "worhtless", "mroon", "maron")} == {"trash": 2, "tarsh": 1, "trsah": 1, "thrash": 1, "wrothless": 1, "worhtless": 1, "mroon": 1, "maron": 1}
    # another word of a stem, and one of a misspelt stem
    assert matcher.kind("trashcan") == 3 and matcher.kind("worhtlessly") == 4
    assert not matcher.kinds({"clash", "mornings", "window"})


def test_two_bunches_within_range_are_one_component(spark):
    rng = np.random.default_rng(4)
    one, other, far = np.zeros((3, 32))
    one[0], other[:2], far[9] = 1, (0.96, np.sqrt(1 - 0.96**2)), 1
    # the third holds the medoid
    x = np.concatenate([c + 1e-4 * rng.normal(size=(n, 32)) for c, n in ((one, 100), (other, 100), (far, 400))])
    data = [(i, v.tolist()) for i, v in enumerate(x)]
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embeddings.near_duplicates(spark.createDataFrame(data, "vec_id long, embedding array<float>")).collect()}
    assert all(got[i] == (199, 0, i == 0) for i in range(200))


def test_walk_that_finds_too_few_is_mended():
    x = embeddings.unit(np.random.default_rng(6).normal(size=(1, 16)) + 0.02 * np.random.default_rng(7).normal(size=(70, 16)))
    a, b = embeddings.range_search(x, np.full((70, 1), -1), within=embeddings.robust_prune(x)[1])
    assert len(a) == 70 * 69 // 2 and (a < b).all()


def test_finer_blocks_and_held_groups_give_the_same_links(spark):
    rng = np.random.default_rng(11)
    base = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    keys = [base]
    for _ in range(30):
        flips = np.bitwise_or.reduce([np.uint64(1) << rng.integers(0, 64, 40, dtype=np.uint64) for _ in range(3)])
        keys.append(keys[rng.integers(0, len(keys))] ^ flips)
    fp = np.unique(np.concatenate(keys))
    a, b = np.nonzero(np.bitwise_count(fp[:, None] ^ fp[None]) <= 4)
    want = components(len(fp), a, b)
    frame = spark.createDataFrame([(int(x),) for x in fp.view(np.int64)], "fp long")
    for kw in ({}, {"blocks": 6}, {"blocks": 7, "held_rows": 50}, {"group_rows": 100, "held_rows": 64}):
        found = simhash.links(frame, **kw).collect()
        u, v = (np.searchsorted(fp, np.array([r[c] for r in found], np.int64).view(np.uint64)) for c in (0, 1))
        assert (components(len(fp), u, v) == want).all(), kw


def test_doubles_beyond_the_range_of_floats(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(6, 8))
    data = [(i, (v * k).tolist()) for i, (v, k) in enumerate(zip(np.repeat(x[:2], 3, 0), (1e300, 1e300, 1.0, 1e-200, 1e-60, 1.0), strict=True))]
    data += [(9, [1e-300] + [0.0] * 7), (10, [5.0] + [0.0] * 7), (11, [1.0] * 8)]
    got = {r.vec_id: (r.n_links, r.component_id) for r in embeddings.near_duplicates(spark.createDataFrame(data, "vec_id long, embedding array<double>")).collect()}
    assert all(got[i] == (2, 0) and got[3 + i] == (2, 3) for i in range(3)) and got[9] == (1, 9) and got[10] == (1, 9) and got[11] == (0, 11)


def test_mix_keeps_columns_of_any_name(spark):
    docs = spark.createDataFrame([(i, f"some words {i}", f"s{i % 2}", 1, 2, 3, 4, "x") for i in range(40)], "doc_id long, text string, source string, tie int, copy int, copies int, _n int, row string")
    got = mixing.apply_mix(docs, mixing.mix(docs))
    assert got.columns == docs.columns and got.filter("tie = 1 and copy = 2 and copies = 3 and _n = 4 and row = 'x'").count() == got.count() > 0


def test_one_row_of_a_repeated_label_id(spark):
    docs = spark.createDataFrame([(7, f"text number {i} {prose(i, 30)}") for i in range(50)] + [(i, prose(i, 40)) for i in range(100, 140)], "doc_id long, text string")
    labels = spark.createDataFrame([(7, 1)] + [(i, i % 2) for i in range(100, 140)], "doc_id long, quality int")
    one, two = (quality.train(docs.repartition(n), labels) for n in (1, 5))
    assert all((a == b).all() for a, b in zip(one.tables, two.tables, strict=True))


def test_equal_rows_share_one_list_of_ranges(spark):
    """5,000 equal rows with an id and as many without: every row loses its words, and no list grows with the rows."""
    from pyspark.sql import functions as F

    from lakeguard.llm import substrings as SS

    text = " ".join(f"w{i * i % 997}" for i in range(120))
    rows = spark.range(10_000).select(F.when(F.col("id") < 5_000, F.lit(7)).cast("long").alias("doc_id"), F.lit(text).alias("text"))
    docs = rows.unionByName(spark.createDataFrame([(8, "quite another text"), (9, None)], "doc_id long, text string"))
    packed = SS._packed(docs)
    lists = SS.repeats(docs, packed).groupBy("d", "t").agg(F.size(F.collect_set("at")).alias("n")).collect()
    assert len(lists) == 2 and all(r.n <= 120 for r in lists)
    found = SS.dedup_substrings(docs).groupBy("doc_id", "n_words", "n_removed").count().collect()
    assert sorted(map(tuple, found), key=repr) == [(7, 120, 120, 5_000), (8, 3, 0, 1), (9, 0, 0, 1), (None, 120, 120, 5_000)]
