"""The llm operators against brute force, with nulls, empty and long texts, ties, repeated rows and clashing columns."""

import zlib

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from lakeguard.llm import decontaminate, embeddings, html_text, mixing, ngram_lm, quality, simhash, substrings, tokens, toxicity
from lakeguard.llm.kernels import components, strings

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, h long, w long, d string, fp string"


def texts():
    """Small corpus with the odd cases."""
    rng = np.random.default_rng(5)
    words = [f"w{i}é" if i % 5 == 0 else f"W{i}" for i in range(300)]
    base = [" ".join(rng.choice(words, rng.integers(1, 120))) for _ in range(30)]
    long = " ".join(rng.choice(words, 20_000))
    passage = " ".join(rng.choice(words, 45))
    rows = list(enumerate(base))
    rows += [(100, None), (101, ""), (102, " \t\n"), (103, long), (104, base[3]), (104, base[3]), (105, base[4]), (None, base[5])]
    rows += [(106, f"{base[6]} {passage} end"), (107, f"start {passage}\n{base[7]}"), (108, "x " * 200), (109, "x"), (110, "one two\x0bthree")]
    return rows


@pytest.fixture(scope="module")
def rows():
    return texts()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([(k, t, "en", f"s{(k or 0) % 3}" if k != 7 else None, 0, 1, 2, "clash", "clash") for k, t in rows], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def key(r):
    return tuple((x is None, str(x)) for x in r)


def test_substrings(docs, rows, empty):
    for group_runs in (4000, 1):
        got = [tuple(r) for r in substrings.dedup_substrings(docs, group_runs=group_runs).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256)).collect()]
        assert sorted(got, key=key) == sorted(substrings.brute_force(rows), key=key)
    assert substrings.dedup_substrings(empty).count() == 0


@pytest.mark.parametrize("cap", [0, 1 << 20])
def test_contamination(spark, docs, rows, empty, cap):
    long = rows[33][1].split()
    items = [(1, " ".join(long[500:530])), (2, "W1"), (3, None), (4, ""), (5, "... !"), (6, rows[6][1]), (6, rows[6][1])]
    bench = spark.createDataFrame([(i, t, "clash") for i, t in items], "item_id long, text string, doc_id string")
    found = decontaminate.contamination(docs, bench, broadcast_bytes=cap)
    got = [(r.doc_id, r.n_words, r.n_hit, len(r["items"])) for r in found.collect()]
    assert sorted(got, key=key) == sorted((w[:4] for w in decontaminate.brute_force(rows, items)), key=key)
    assert decontaminate.contamination(empty, bench, broadcast_bytes=cap).count() == 0
    assert decontaminate.contamination(docs, bench.limit(0), broadcast_bytes=cap).filter("n_hit > 0").count() == 0


def test_simhash(docs, rows, empty):
    def brute(text):
        w = (text or "").encode().lower().split()
        h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + 4]), 42) for i in range(max(1, len(w) - 3))] if w else []
        return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))

    got = [(r.doc_id, r.fp & (2**64 - 1), r.component_id) for r in simhash.near_duplicates(docs).collect()]
    fps = [(k, brute(t)) for k, t in rows]
    v = np.array([f for _, f in fps], np.uint64)
    a, b = np.nonzero(np.bitwise_count(v[:, None] ^ v[None]) <= 4)
    label = components(len(v), a, b)
    least = {}
    for (k, _), g in zip(fps, label, strict=True):
        if k is not None:
            least[g] = min(least.get(g, k), k)
    assert sorted(got, key=key) == sorted(((k, f, least.get(g)) for (k, f), g in zip(fps, label, strict=True)), key=key)
    assert simhash.near_duplicates(empty).count() == 0


def test_trie_links_all_pairs():
    rng = np.random.default_rng(1)
    keys = np.unique(np.concatenate([rng.integers(0, 1 << 63, 300, dtype=np.uint64), *[np.uint64(12345678901234567) ^ (np.uint64(1) << rng.integers(0, 64, 2, dtype=np.uint64)).sum(dtype=np.uint64, keepdims=True) for _ in range(200)]]))
    a, b = simhash.trie_links(keys, np.zeros(len(keys), int), 0, 4, np.arange(len(keys)))
    got = {(min(x, y), max(x, y)) for x, y in zip(a.tolist(), b.tolist(), strict=True)}
    x, y = np.nonzero(np.bitwise_count(keys[:, None] ^ keys[None]) <= 4)
    assert got == {(i, j) for i, j in zip(x.tolist(), y.tolist(), strict=True) if i < j}


def test_token_codec_and_encoder():
    e = tokens._Encoder(tokens.vocabulary(), cache=50)
    odd = ["", " ", "Don't STOP\tme\n now", "日本 é é", "a<|endoftext|>b", "\x01 x", "ΣΑΣ 12,5%", "w\x0bv\x0cu\x1ct\x85s"] * 3
    flat, n = e.ids(*strings(pa.array(odd)))
    assert [x.tolist() for x in np.split(flat, np.cumsum(n)[:-1])] == [[*e.tokenizer.encode(t, add_special_tokens=False).ids, 1] for t in odd]
    for k in (0, 1, 255, 256, 257, 5000):
        ids = np.random.default_rng(k).choice([3, 50, 49407, 2**32 - 1, 0], k).astype(np.uint32)
        payload, index = tokens.encode(ids)
        assert (tokens.decode(payload, index, k) == ids).all()
        if k > 256:
            assert (tokens.decode_block(payload, index, 0) == ids[:256]).all()


def test_tokens(docs, rows, empty, tmp_path):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokens.vocabulary())
    got = sorted(tokens.tokenise(docs, tokens.vocabulary(), str(tmp_path / "a")).collect(), key=lambda r: r.start)
    ids = {(k, x): [*t.encode(x or "", add_special_tokens=False).ids, 1] for k, x in rows}
    assert [r.start for r in got] == [0, *np.cumsum([r.n_tokens for r in got])[:-1].tolist()]
    want = sorted((k is not None, k or 0, zlib.crc32(np.array(ids[k, x], "<u4").tobytes())) for k, x in rows)
    assert sorted((r.doc_id is not None, r.doc_id or 0, r.ids_crc32) for r in got) == want
    assert tokens.tokenise(empty, tokens.vocabulary(), str(tmp_path / "b")).count() == 0


def test_backoff(docs, rows, empty):
    for kw in ({}, {"block_bytes": 5000, "table_grams": 3000}):
        got = sorted(ngram_lm.stupid_backoff(docs, **kw).collect(), key=lambda r: (r.doc_id is None, str(r.doc_id), r.n_words))
        want = sorted(ngram_lm.brute_force(rows), key=lambda r: (r[0] is None, str(r[0]), r[1]))
        for g, w in zip(got, want, strict=True):
            assert (g.doc_id, g.n_words, g.n_known) == (w[0], w[1], w[4])
            assert g.log_score == pytest.approx(w[2], abs=1e-4)
    assert ngram_lm.stupid_backoff(empty).count() == 0


def test_mix(docs, rows, empty):
    got = mixing.mix(docs).collect()
    assert len(got) == len(rows)
    by = {}
    for r in got:
        assert 0 <= r.copies <= 3
        s = by.setdefault(r.source, [r.target, 0, 0])
        s[1] += r["size"] * r.copies
        s[2] = max(s[2], r["size"])
    for target, taken, largest in by.values():
        assert abs(taken - target) <= largest
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix(docs).collect()))
    assert mixing.apply_mix(docs, mixing.mix(docs)).count() == sum(r.copies for r in got)
    assert mixing.mix(empty).count() == 0


def test_flight_keeps_totals():
    rng = np.random.default_rng(3)
    p, x = rng.random(200), rng.integers(1, 50, 200).astype(float)
    q = mixing.flight(p, x, rng)
    assert ((q > 0) & (q < 1)).sum() <= 2
    assert q.sum() == pytest.approx(p.sum()) and (q * x).sum() == pytest.approx((p * x).sum())


def test_targets_share_the_excess():
    got = mixing.targets([("a", 10), ("b", 100), (None, 1)])
    assert [s for s, _, _ in got] == ["a", "b", None]
    assert sum(t for _, _, t in got) == pytest.approx(111) and got[2][2] == 3


def test_embeddings(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(300, 16))
    x[50:90] = x[50] + 0.03 * rng.normal(size=(40, 16))
    data = [(i, v.tolist(), 0) for i, v in enumerate(x)] + [(300, None, 0), (301, [], 0), (302, [0.0] * 16, 0), (303, [float("nan")] + [1.0] * 15, 0), (304, [None] + [1.0] * 15, 0), (305, x[0].tolist(), 0), (None, x[1].tolist(), 0), (306, [1.0, 2.0], 0)]
    df = spark.createDataFrame(data, "vec_id long, embedding array<float>, label int").repartition(3)
    for kw in ({}, {"chunk_rows": 40, "shard_rows": 60, "overlap": 2}):
        got = {r.vec_id: (r.n_links, r.component_id) for r in embeddings.near_duplicates(df, **kw).collect()}
        f = x.astype(np.float32).astype(float)
        u = f / np.linalg.norm(f, axis=1, keepdims=True)
        near = (u @ u.T) >= 0.95
        deg = near.sum(1) - 1
        assert got[305] == (1, 0) and got[0] == (deg[0] + 1, 0) and got[None] == (1, 1)
        assert all(got[i] == (0, i) for i in (300, 301, 302, 303, 304, 306))
        assert sum(got[i][0] for i in range(2, 300)) >= 0.99 * deg[2:].sum()
        assert {got[i][1] for i in range(50, 90)} == {50}
    assert embeddings.audit_recall(df.filter("vec_id IS NOT NULL"), embeddings.near_duplicates(df), every=2) >= 0.9
    assert embeddings.near_duplicates(df.limit(0)).count() == 0


def test_html():
    page = """<!DOCTYPE html><html><head><title>No</title><style>p{}</style><script>var t="</p>";</script></head><body><header>Site</header><nav><ul><li><a href=x>Menu</a></ul></nav>
    <!-- c <p>hidden</p> --><div class="cookie notice">Accept</div><article><h1>A &amp; B</h1><p>One  two<br>three <b>bold
    <p>Four&nbsp;five<form><input value=1>Send</form><div id="comments"><p>First!</div></article><aside>Side</aside><footer>&copy; X</footer>"""
    assert html_text.main_text(page) == "A & B One two three bold Four five"
    assert html_text.main_text("") == "" and html_text.main_text("plain <b>text</b>") == "plain text"
    assert html_text.main_text("<p>a<p>b", {"p"}) == ""


def test_html_keeps_what_belongs_to_the_text():
    page = """<body><header>Site</header><article><header><h1>Own title</h1></header><figure><img src=x><figcaption>Caption</figcaption></figure>
    <p class="comment-on-policy">Policy</p><p class="side-note" data-id="comments" title="hidden gem">Note</p><p>E = <math><mi>m</mi><mo/>c</math></p><svg/><p>After</p><p>Name <label>Label</label></p>
    <div class="share-buttons">Share</div><div class="adBox300x250">Buy</div><p role=navigation>Go</p><div id="postComments"><p>First!</div></article><div class="search">Find</div><div class="comment-on-policy">Outside</div></body>"""
    assert html_text.main_text(page) == "Own title Caption Policy Note E = mc After Name Label Outside"


def test_style_tree_against_brute_force(spark):
    import math
    from collections import Counter

    rng = np.random.default_rng(2)
    pages = []
    for i in range(60):
        fixed = "".join(f"<li>Item {k}</li>" for k in range(3))
        own = "".join(f"<p>{rng.integers(0, 4)} own</p>" for _ in range(rng.integers(1, 5)))
        pages.append((i, f"http://h{i % 2}.example/{i}", f"<body><ul class=list>{fixed}</ul><main><div class=body>{own}</div><div class=note>Page {i % 3}</div></main></body>"))
    frame = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("host", html_text.host(F.col("url")))
    got = {(r.host, r.path): r.importance for r in html_text.style_tree(frame).collect()}
    want = {}
    for h in ("h0.example", "h1.example"):
        different = {}
        for _, url, page in pages:
            if h in url:
                found = html_text.blocks(page)
                different["\n".join(b.text for b in found)] = found
        seen = {}
        for found in different.values():
            for path, (texts, layout) in html_text.nodes(found).items():
                seen.setdefault(path, []).append(("\n".join(texts), "\n".join(layout)))
        for path, styles in seen.items():
            n = len(styles)
            if n > 1:
                entropy = [-sum(k / n * math.log(k / n, n) for k in Counter(x[i] for x in styles).values()) for i in (0, 1)]
                mean = 0.9 * entropy[0] + 0.1 * entropy[1]
                want[h, "/".join(path)] = (n * mean + html_text.PRIOR) / (n + html_text.PRIOR) + (html_text.RAISE if len(path) > 1 and path[1].startswith("main") else 0)
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=1e-9) for k in want)
    assert got["h0.example", "body/ul.list"] < 0.1 and got["h0.example", "body/main/div.body"] > 0.5
    # the contents of a list are alike on all pages, its layout as well
    text = {r.page_id: r.text for r in html_text.extract(frame).collect()}
    assert not any("Item" in t for t in text.values()) and all("own" in t for t in text.values())


def test_html_on_odd_tables(spark):
    schema = "page_id long, url string, html string, host string, low string, text int, n_chars int"
    long = "<article>" + "<p>word &amp; more</p>" * 20_000 + "</article>"
    rows = [(1, "http://a.example/", long, "x", "y", 1, 2), (None, None, None, None, None, None, None), (2, "http://a.example/", "<p>One</p>", "", "", 0, 0), (2, "http://a.example/", "<p>One</p>", "", "", 0, 0), (3, "http://a.example/", "x" * 300_000, "", "", 0, 0)]
    got = html_text.extract(spark.createDataFrame(rows, schema))
    assert got.columns == ["page_id", "url", "text", "n_chars"]
    assert sorted((r.page_id or 0, r.n_chars) for r in got.collect()) == [(0, 0), (1, 12 * 20_000 - 1), (2, 3), (2, 3), (3, 300_000)]
    assert html_text.extract(spark.createDataFrame([], schema)).count() == 0


def test_style_tree_removes_repeated_branches(spark):
    pages = [(i, f"http://h.example/{i}", f"<body><div class=top>Same banner text</div><div class=body>Own text {i}</div></body>") for i in range(20)] + [(99, None, None), (98, "odd", "")]
    got = {r.page_id: r.text for r in html_text.extract(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert got[3] == "Own text 3" and got[99] == "" and got[98] == "" and len(got) == 22


def test_classifiers(spark):
    base = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{base}/documents.parquet"), spark.read.parquet(f"{base}/labels.parquet")
    q = quality.query(spark, base).join(labels.dropDuplicates(["doc_id"]), "doc_id").filter("held_out")
    assert q.filter("predicted = quality").count() >= 0.95 * q.count()
    t = toxicity.score(docs, toxicity.train(docs, labels)).join(labels, "doc_id").filter(toxicity.held_out(F.col("doc_id")))
    assert t.filter((F.col("score") >= 0.5) == (F.col("toxic") == 1)).count() >= 0.9 * t.count()


def test_classifiers_on_odd_tables(spark, docs, empty):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    one = spark.createDataFrame([(1, 1, 1), (1, 1, 1), (None, 0, 0), (3, None, None)], "doc_id long, quality int, toxic int")
    for labels in (none, one):
        for m in (quality, toxicity):
            model = m.train(docs, labels)
            assert all(0 <= r.score <= 1 for r in m.score(docs, model).collect())
            assert m.score(empty, model).count() == 0


def test_automaton_finds_one_edit():
    trie = toxicity.Trie()
    trie.add("scoundrel")
    near = toxicity.Automaton(trie, 1).near
    assert all(near(w) for w in ("scoundrel", "scoundre", "scuondrel", "scoundrrel", "scaundrel"))
    assert not any(near(w) for w in ("scound", "soundtrack", "", "scuodnrel"))
    assert toxicity.Automaton(trie, 2).near("scuodnrel") and not toxicity.Automaton(toxicity.Trie(), 2).near("")


@pytest.mark.parametrize("k", [0, 1, 2])
def test_automaton_against_every_edit(k):
    """Distances by the table of optimal alignments, of words to terms and to beginnings that a stem stands for."""
    letters = "abc"
    rng = np.random.default_rng(3)
    terms = sorted({"".join(rng.choice(list(letters), rng.integers(1, 7))) for _ in range(12)})
    plain, stems = toxicity.Trie(), toxicity.Trie()
    for t in terms:
        plain.add(t)
    for t in (t for t in terms if not any(t != s and t.startswith(s) for s in terms)):
        stems.add(t, stem=True)
    shortest = [t for t in terms if not any(t != s and t.startswith(s) for s in terms)]

    def distance(a, b):
        d = {(i, 0): i for i in range(len(a) + 1)} | {(0, j): j for j in range(len(b) + 1)}
        for i in range(1, len(a) + 1):
            for j in range(1, len(b) + 1):
                d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i - 1] != b[j - 1]))
                if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                    d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
        return d[len(a), len(b)]

    def begins(word, stem):
        """Whether a beginning of the word is the stem within k edits, its last letter by agreement or a swap."""
        for i in range(1, len(word) + 1):
            head = word[:i]
            if head[-1] == stem[-1] and distance(head[:-1], stem[:-1]) <= k:
                return True
            if i > 1 and len(stem) > 1 and head[-2:] == stem[-1] + stem[-2] and distance(head[:-2], stem[:-2]) <= k - 1:
                return True
        return False

    one, other = toxicity.Automaton(plain, k), toxicity.Automaton(stems, k)
    for _ in range(400):
        word = "".join(rng.choice(list(letters), rng.integers(0, 9)))
        assert one.near(word) == any(distance(word, t) <= k for t in terms), word
        assert other.near(word) == any(begins(word, t) for t in shortest), word


def test_pipeline(spark, docs):
    import corpus_pipeline

    frame = spark.read.parquet(f"{SF}/documents.parquet")
    columns = frame.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        frame = stage(spark, frame, SF)
        assert frame.columns == columns, name
    assert corpus_pipeline.run(spark, SF).count() == frame.count() > 0
