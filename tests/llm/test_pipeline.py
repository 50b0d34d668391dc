"""Every stage of the pipeline held against plain Python on its own input, with odd rows among the documents."""

import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from lakeguard.llm import decontaminate, mixing, quality, tokens

SF = "/root/testdata/sf0.001"
SPACES = re.compile(r"[\x20\x09-\x0D]+")


def words(text):
    return [w for w in SPACES.split(text or "") if w]


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """(name, input rows, output rows) of each stage, and the folder that was read."""
    base = tmp_path_factory.mktemp("pipeline")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    good = [r for r in docs.orderBy("doc_id").collect() if 60 < len(words(r.text)) < 400][:6]
    item = spark.read.parquet(f"{SF}/benchmark.parquet").orderBy("item_id").first().text
    odd = [
        (None, None, "en", "src0", 0),
        (None, good[0].text, "en", None, 1),
        (9_001, "", None, "src1", 0),
        (9_002, good[1].text, "en", "src2", 2),
        (9_002, good[2].text, "en", "src2", 2),
        (9_003, good[3].text, "en", "src0", 3),
        (9_003, good[3].text, "en", "src0", 3),
        (9_004, f"{good[4].text} {item}", "en", "src1", 4),
        (None, f"{good[5].text} {item}", "en", "src1", 4),
        (9_005, " ".join([good[0].text] * 200), "en", "src3", 5),
    ]
    docs.unionByName(spark.createDataFrame(odd, docs.schema)).write.parquet(str(base / "documents.parquet"))
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{SF}/{name}.parquet").write.parquet(str(base / f"{name}.parquet"))
    rows = spark.read.parquet(str(base / "documents.parquet"))
    out = []
    for name, stage in corpus_pipeline.STAGES:
        given = rows
        path = str(base / f"after-{name}")
        stage(spark, given, str(base)).write.parquet(path)
        rows = spark.read.parquet(path)
        out.append((given.collect(), rows.collect()))
    return dict(zip([n for n, _ in corpus_pipeline.STAGES], out, strict=True)), str(base)


def test_quality_keeps_what_scores_enough(spark, stages):
    given, kept = stages[0]["quality"]
    frame = spark.read.parquet(f"{stages[1]}/documents.parquet")
    model = quality.train(frame, spark.read.parquet(f"{stages[1]}/labels.parquet"))

    def scored(row):  # one text at a time
        raw = np.frombuffer((row.text or "").encode(), np.uint8)
        return float(model.scores(quality.features(raw, np.array([0, len(raw)])))[0])

    assert Counter(map(tuple, kept)) == Counter(tuple(r) for r in given if scored(r) >= quality.THRESHOLD)
    assert 0 < len(kept) < len(given)


def test_near_dedup_leaves_one_of_each_group(stages):
    given, kept = stages[0]["near_dedup"]

    def mark(text):
        w = words("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
        grams = [" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))] if w else []
        hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
        return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))

    distinct = list(dict.fromkeys(map(tuple, given)))
    marks = [mark(r[given[0].__fields__.index("text")]) for r in distinct]
    group = list(range(len(distinct)))
    changed = True
    while changed:  # the least member of each row's group, by all pairs
        changed = False
        for i in range(len(marks)):
            for j in range(i):
                if (marks[i] ^ marks[j]).bit_count() <= 4 and group[i] != group[j]:
                    group[i] = group[j] = min(group[i], group[j])
                    changed = True
    at = given[0].__fields__.index("doc_id")
    left = Counter(group[distinct.index(tuple(r))] for r in kept)
    assert left == Counter(dict.fromkeys(group, 1))
    for r in kept:
        ids = [distinct[i][at] for i in range(len(distinct)) if group[i] == group[distinct.index(tuple(r))] and distinct[i][at] is not None]
        assert r.doc_id == min(ids, default=None)


def test_decontamination_drops_rows_with_a_window(spark, stages):
    given, kept = stages[0]["decontaminate"]
    items = [tuple(r) for r in spark.read.parquet(f"{stages[1]}/benchmark.parquet").select("item_id", "text").collect()]
    found = decontaminate.brute_force([(i, r.text) for i, r in enumerate(given)], items)
    hit = {row[0] for row in found if row[2] > 0}
    assert hit and Counter(map(tuple, kept)) == Counter(tuple(r) for i, r in enumerate(given) if i not in hit)


def test_mix_takes_whole_documents_near_their_targets(stages):
    given, taken = stages[0]["mix"]
    here, there = Counter(map(tuple, given)), Counter(map(tuple, taken))
    assert set(there) <= set(here) and all(n <= 3 * here[k] for k, n in there.items())
    size = Counter()
    got = Counter()
    largest = Counter()
    for r in given:
        size[r.source] += len(words(r.text))
        largest[r.source] = max(largest[r.source], len(words(r.text)))
    for r in taken:
        got[r.source] += len(words(r.text))
    order = sorted(size, key=lambda s: (s is None, s or ""))
    for source, _, target in mixing.targets([(s, size[s]) for s in order]):
        assert abs(got[source] - target) <= largest[source]


def test_tokens_are_the_tokenizers(stages):
    given, digests = stages[0]["tokens"]
    tokenizer = Tokenizer.from_file(tokens.vocabulary())

    def digest(text):
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 1]
        return len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())

    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in digests) == Counter((r.doc_id, *digest(r.text)) for r in given)
    at = 0
    for r in sorted(digests, key=lambda r: r.start):
        assert r.start == at
        at += r.n_tokens


def test_run_is_all_stages(spark, stages):
    rows = corpus_pipeline.run(spark, stages[1])
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in rows.collect()) == Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in stages[0]["tokens"][1])


def test_empty_table(spark, tmp_path):
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{SF}/{name}.parquet").filter(F.lit(False)).write.parquet(str(tmp_path / f"{name}.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
