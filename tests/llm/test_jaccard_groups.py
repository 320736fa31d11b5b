"""The near-duplicate stage of the pipeline against brute force and planted pairs."""

import random

import pytest

import corpus_pipeline
from weftgraph.llm import jaccard_groups


def shingles_of(text):
    words = (text or "").lower().split()
    return {" ".join(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()


def similarity(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def groups_of(rows):
    """Lists of the places of rows (id, text) that are one group, by brute force."""
    sets = [shingles_of(t) for _, t in rows]
    label = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if label[i] != label[j] and similarity(sets[i], sets[j]) >= 0.8:
                label = [label[j] if x == label[i] else x for x in label]
    groups = {}
    for place, name in enumerate(label):
        groups.setdefault(name, []).append(place)
    return list(groups.values())


def groups_slowly(rows):
    """(id, least id of the group) of each row."""
    least = lambda group: min((rows[k][0] for k in group if rows[k][0] is not None), default=None)
    return sorted(((rows[k][0], least(group)) for group in groups_of(rows) for k in group), key=str)


def edited(draw, base, wanted):
    """``base`` with single words changed, as many as the wanted similarity allows."""
    own, words = shingles_of(" ".join(base)), base
    while True:
        more = list(words)
        more[draw.randrange(len(more))] = f"new{draw.random()}"
        if similarity(own, shingles_of(" ".join(more))) < wanted:
            return words
        words = more


@pytest.mark.parametrize("wanted", [0.8, 0.85, 0.9])
def test_stage_finds_planted_pairs(spark, wanted):
    draw, rows = random.Random(int(wanted * 100)), []
    for k in range(60):
        base = [f"w{draw.randrange(5000)}" for _ in range(draw.choice([120, 200, 500]))]
        copy = edited(draw, base, wanted)
        rows += [(2 * k, " ".join(base), "en", "s", 0), (2 * k + 1, " ".join(copy), "en", "s", 0)]
        assert copy != base and wanted <= similarity(shingles_of(rows[-2][1]), shingles_of(rows[-1][1])) < 1
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()) == list(range(0, 120, 2))


@pytest.mark.parametrize("stars", [0, 4])
def test_groups_against_brute_force(spark, sf, monkeypatch, stars):
    monkeypatch.setattr(jaccard_groups, "STARS", stars)
    draw, rows = random.Random(5), [(0, None), (1, ""), (2, " \n"), (3, "one"), (4, "ONE "), (5, "one two"), (6, "a b c d e"), (7, "a b c d f")]
    passage = [f"p{k}" for k in range(60)]
    for base in range(8):
        words = [f"w{draw.randrange(300)}" for _ in range(draw.choice([8, 40, 150]))]
        for _ in range(15):
            more = [w if draw.random() > 0.02 else "x" for w in words] + ["end"] * draw.randrange(4)
            rows.append((len(rows), " ".join(more + (passage if base % 2 else []))))
    rows += [(len(rows) + k, r["text"]) for k, r in enumerate(spark.read.parquet(f"{sf}/documents.parquet").collect())]
    out = jaccard_groups.near_groups(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted((r[:2] for r in out.collect()), key=str) == groups_slowly(rows)


def test_stage_keeps_one_row_of_each_group(spark):
    text = " ".join(f"w{k}" for k in range(60))
    rows = [(7, text, "en", "s", 1), (None, text, "en", "s", 1), (9, text + " more", "en", "s", 1), (7, text, "en", "s", 1)]
    rows += [(None, "only null ids here", None, None, None)] * 2 + [(None, "another text", "en", "s", 2), (3, None, "en", "s", 0), (4, "", "en", "s", 0), (5, "short", "en", "s", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    kept = [(r["doc_id"], r["text"]) for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()]
    assert sorted(kept, key=str) == sorted([(7, text), (None, "only null ids here"), (None, "another text"), (3, None), (5, "short")], key=str)


def test_one_python_worker_for_each_task(spark, monkeypatch):
    """No function of the stage reads what another one makes: each would have a worker of its own, with the same sets in memory."""
    frame = type(spark.range(1))
    plain, chained = frame.mapInArrow, []

    def watched(self, func, schema, *rest, **more):
        if func.__module__ == jaccard_groups.__name__ and "MapInArrow" in self._jdf.queryExecution().optimizedPlan().toString():
            chained.append(func.__qualname__)
        return plain(self, func, schema, *rest, **more)

    monkeypatch.setattr(frame, "mapInArrow", watched)
    rows = [(1, "a b c d e f g h"), (2, "a b c d e f g h i"), (3, ""), (4, None)]
    found = jaccard_groups.near_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(tuple(r) for r in found) == [(1, 1), (2, 1), (3, 3), (4, 3)] and not chained


def test_no_batch_holds_the_sets_of_pairs(spark, monkeypatch):
    """Sets of both sides of a pair are as many times larger than the texts as a text has candidates; no Arrow batch may hold thousands of them."""
    frame = type(spark.range(1))
    plain, given = frame.mapInArrow, []

    def watched(self, func, schema, *rest, **more):
        given.append(self.columns)
        return plain(self, func, schema, *rest, **more)

    monkeypatch.setattr(frame, "mapInArrow", watched)
    base = [f"w{k}" for k in range(60)]
    rows = [(k, " ".join([*base, f"end{k}"])) for k in range(20)] + [(20, " ".join(base[:30] + ["x"] * 30)), (21, None), (22, "")]
    found = jaccard_groups.near_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(tuple(r) for r in found) == [(k, 0) for k in range(20)] + [(20, 20), (21, 21), (22, 21)]
    assert given and not [columns for columns in given if any("hashes" in c for c in columns)]


def test_near_duplicates_of_few_texts_take_few_jobs_and_no_broadcast_of_sets(spark):
    """Each small job and each broadcast stays with the driver for long, and there are several rounds of links."""
    word = lambda k: " ".join(f"w{k * 7 + i}" for i in range(30))
    rows = [(n, word(n % 12) + (f" x{n}" if n % 3 else "")) for n in range(40)] + [(40, None), (41, "  ")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    spark.sparkContext.setJobGroup("few-near-jobs", "few-near-jobs")
    kept = sorted(r["doc_id"] for r in jaccard_groups.one_of_each(docs, shingle=5, similarity=(4, 5), most=2).collect())
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert kept == [*range(12), 40]
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("few-near-jobs")) <= 110
