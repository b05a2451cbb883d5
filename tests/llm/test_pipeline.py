"""The pipeline's stages against brute force, each on its own input."""

import collections

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from simloom.llm import decontaminate, quality
from simloom.llm.common import materialise
from tests.llm.test_edges import brute_components


@pytest.fixture(scope="module")
def stages(spark, sf_dir):
    docs = [spark.read.parquet(f"{sf_dir}/documents.parquet")]
    for name, stage in corpus_pipeline.STAGES:
        docs.append(materialise(stage(spark, docs[-1], sf_dir), f"test-{name}"))
    return docs


def rows(frame):
    return {r.doc_id: r for r in frame.collect()}


def test_columns(stages):
    assert all(s.columns == stages[0].columns for s in stages[1:-1])
    assert len(corpus_pipeline.STAGES) == 5


def test_classifier_rejects(spark, sf_dir, stages):
    before, after = rows(stages[0]), rows(stages[1])
    model = quality.fit(stages[0], spark.read.parquet(f"{sf_dir}/labels.parquet"))
    rejected = {r.doc_id for r in quality.score(stages[0], model).collect() if r.score < 0.7}
    assert set(after) == set(before) - rejected and rejected
    assert all(after[d] == before[d] for d in after)


def test_lines(stages):
    before, after = rows(stages[1]), rows(stages[2])
    pages, found = collections.Counter(), collections.Counter()
    for r in before.values():
        pages[r.source] += 1
        found.update({(r.source, line.strip(" \t\r")) for line in r.text.split("\n")})
    drop = {k for k, n in found.items() if k[1] and n >= 3 and 10 * n > pages[k[0]]}
    assert set(after) == set(before)
    for d, r in before.items():
        kept = [line for line in r.text.split("\n") if (r.source, line.strip(" \t\r")) not in drop]
        assert after[d].text == "\n".join(kept)
        assert after[d].n_chars == (r.n_chars if len(kept) == r.text.count("\n") + 1 else len(after[d].text))


def test_one_of_alike(stages):
    before, after = rows(stages[2]), rows(stages[3])
    groups = brute_components([(d, r.text) for d, r in before.items()])
    assert set(after) == {d for d, (_, component) in groups.items() if d == component}
    assert all(after[d] == before[d] for d in after)


def test_contaminated(spark, sf_dir, stages):
    before, after = rows(stages[3]), rows(stages[4])
    windows = set()
    for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect():
        w = decontaminate.words_of(r.text)
        windows |= {tuple(w[i : i + min(13, len(w))]) for i in range(max(1, len(w) - 12)) if w}
    lengths = {len(w) for w in windows}
    for d, r in before.items():
        w = decontaminate.words_of(r.text)
        hit = set()
        for m in lengths:
            for i in range(len(w) - m + 1):
                if tuple(w[i : i + m]) in windows:
                    hit |= set(range(i, i + m))
        assert (d in after) == (not hit or 20 * len(hit) < len(w))


def test_mix(stages):
    before = rows(stages[4])
    mixed = stages[5].join(stages[4].select("doc_id", "source"), "doc_id").collect()
    assert len(mixed) == len(before)
    taken, target = collections.Counter(), {}
    for r in mixed:
        assert r.size == len(before[r.doc_id].text.split()) and r.taken <= 3 * r.size
        taken[r.source] += r.taken
        target[r.source] = r.target
    assert all(abs(taken[s] - t) <= 1 for s, t in target.items())
    assert sum(target.values()) == pytest.approx(sum(r.size for r in mixed))


def test_run_is_the_stages(spark, sf_dir, stages):
    ours = sorted(map(tuple, corpus_pipeline.run(spark, sf_dir).collect()))
    assert ours == sorted(map(tuple, stages[5].collect()))


def test_odd_rows_pass(spark, sf_dir):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    odd = spark.createDataFrame([(1, None, None, None, None), (2, "", "en", "a", 0), (3, "same text here", "en", "a", 1), (3, "same text here", "en", "a", 1), (None, "x y z", None, "b", 3)], schema)
    for docs in (odd, odd.filter(F.lit(False))):
        for _, stage in corpus_pipeline.STAGES[1:]:
            docs = materialise(stage(spark, docs, sf_dir), "odd")
        assert docs.count() in (0, 4)


def test_repeated_passages_are_dropped(spark, sf_dir):
    """Of 400 pages of one source: passages on 3 pages go, those on 2 and short lines on 3 stay."""
    passage = {n: " ".join(f"p{n}w{i}" for i in range(60)) for n in range(8)}
    pages = [[f"own line {d}"] for d in range(400)]
    for n, line in passage.items():
        for d in range(3 if n < 6 else 2):
            pages[40 * n + d].append(line)
    for d in range(3):
        pages[d].append("short line")
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    docs = spark.createDataFrame([(d, "\n".join(p), "en", "a", 0) for d, p in enumerate(pages)], schema)
    kept = collections.Counter(line for r in corpus_pipeline.drop_repeated_lines(spark, docs, sf_dir).collect() for line in r.text.split("\n"))
    assert [kept[passage[n]] for n in range(8)] == [0] * 6 + [2, 2]
    assert kept["short line"] == 3 and sum(kept["own line %d" % d] for d in range(400)) == 400
    # The bar follows the source's pages: 3 of 800 are too few.
    more = docs.unionByName(docs.selectExpr("doc_id + 400 as doc_id", "concat('own line ', doc_id + 400) as text", "lang", "source", "n_chars"))
    kept = collections.Counter(line for r in corpus_pipeline.drop_repeated_lines(spark, more, sf_dir).collect() for line in r.text.split("\n"))
    assert [kept[passage[n]] for n in range(8)] == [3] * 6 + [2, 2]


def test_repeated_ids(spark, sf_dir):
    """Equal rows go; rows that share an id stay unless they are alike, and of those the least text hash does."""
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    texts = [" ".join(f"w{i}" for i in range(a, a + 60)) for a in (0, 200, 400)]
    near = [texts[0] + " end", texts[0] + " other"]
    rows = [(1, texts[0]), (1, texts[0]), (1, texts[1]), (2, near[0]), (3, texts[2]), (4, near[1]), (4, near[0]), (5, None), (5, None), (None, texts[0])]
    docs = spark.createDataFrame([(d, t, "en", "a", 0) for d, t in rows], schema)
    for parts in (1, 5):
        got = sorted(map(str, ((r.doc_id, r.text) for r in corpus_pipeline.keep_one_of_alike(spark, docs.repartition(parts), sf_dir).collect())))
        assert got == sorted(map(str, [(1, texts[0]), (1, texts[1]), (3, texts[2]), (5, None), (None, texts[0])]))
