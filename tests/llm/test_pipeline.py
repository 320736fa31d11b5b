"""The weak-label classifier and the stages of the pipeline."""

from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from weftgraph.llm import byte_bpe, edit_lines, queries, suffix_decontam, weak_quality
from weftgraph.llm.common import marked

from .test_jaccard_groups import groups_of, groups_slowly
from .test_operators import AWKWARD

public_tokenizers = pytest.importorskip("public_tokenizers")


@pytest.fixture(scope="module")
def small():
    return "/root/testdata/sf0.01"


def test_em_recovers_rates():
    draw = np.random.default_rng(1)
    truth = draw.random(20_000) < 0.8
    rates = np.array([[0.3, 0.2, 0.4], [0.98, 0.95, 0.97]])
    votes = (draw.random((20_000, 3)) < np.where(truth[:, None], rates[1], rates[0])).astype(int)
    votes[draw.random(votes.shape) < 0.1] = weak_quality.ABSTAIN
    found, posterior = weak_quality.expectation_maximisation(sorted(Counter(map(tuple, votes.tolist())).items()), weak_quality.NO)
    assert np.abs(found - rates).max() < 0.06
    # as good as the best decision that knows the true rates
    cast = votes != weak_quality.ABSTAIN
    says = np.where(votes == 1, np.log(rates[1] / rates[0]), np.log((1 - rates[1]) / (1 - rates[0])))
    best = np.mean((np.log(4) + np.where(cast, says, 0).sum(axis=1) >= 0) == truth)
    assert np.mean([(posterior[tuple(v)] >= 0.5) == t for v, t in zip(votes.tolist(), truth)]) > best - 0.002


def test_classifier_on_labels_held_out(spark, small):
    docs, labels = (spark.read.parquet(f"{small}/{t}.parquet") for t in ("documents", "labels"))
    held = [r for r in labels.collect() if r["doc_id"] % 3 == 0]
    out = {r["doc_id"]: r for r in weak_quality.classify(docs.select("doc_id", "text"), labels.where("doc_id % 3 <> 0")).collect()}
    assert len(out) == docs.count()
    quality = np.mean([(out[r["doc_id"]]["p_quality"] >= 0.3) == bool(r["quality"]) for r in held])
    clean = [out[r["doc_id"]]["keep"] for r in held if r["quality"] and not r["toxic"]]
    assert quality > 0.95 and np.mean(clean) > 0.97


def test_classifier_finds_toxic_documents_held_out(spark):
    tables = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{tables}/{t}.parquet") for t in ("documents", "labels"))
    out = weak_quality.classify(docs.select("doc_id", "text").repartition(4), labels.where("doc_id % 3 <> 0"))
    held = {tuple(r[:2]): r for r in out.join(labels, "doc_id").where("doc_id % 3 = 0").groupBy("quality", "toxic").agg(F.count("*").alias("n"), F.sum(F.col("keep").cast("int")).alias("kept")).collect()}
    toxic = [held[q, 1] for q in (0, 1)]
    assert sum(r["kept"] for r in toxic) < 0.1 * sum(r["n"] for r in toxic)
    assert held[1, 0]["kept"] > 0.98 * held[1, 0]["n"] and held[0, 0]["kept"] < 0.1 * held[0, 0]["n"]


def slice_slowly(text, lexicon_stems=frozenset()):
    """Shares and votes of one text, word by word."""
    words = [w.decode() for w in text.encode().split()]
    n = len(words)
    core = [w[:-1] if len(w) > 1 and w[-1] in weak_quality.ENDS else w for w in words]
    most = max(Counter(words).values(), default=0)
    found = [
        sum(not c.isalnum() for c in core),
        sum(c.isupper() and len(c) > 1 for c in core),
        most,
        sum(a == b for a, b in zip(words, words[1:])),
        sum(w[-1] in ".!?" for w in words),
        sum(c.lower() in weak_quality.FUNCTION_WORDS for c in core),
    ]
    insult = not weak_quality.INSULTS.isdisjoint(weak_quality.WORD.findall(" ".join(words).lower()))
    return [x / max(n, 1) for x in found], n, insult


def test_slices_against_single_texts(spark, sf):
    texts = [r["text"] for r in queries.table(spark, sf, "documents").collect()] + AWKWARD + ["you idiot!", "IDIOTS", ""]
    vocabulary = weak_quality.Vocabulary()
    for start in (0, 100):  # words learned before and new ones
        read = vocabulary.read([None if t is None else t.encode() for t in texts[start:]])
        doc, feature = read.features()
        for k, text in enumerate(texts[start:]):
            shares, n, insult = slice_slowly(text or "")
            assert [read.share[name][k] for name in weak_quality.SIGNALS] == pytest.approx(shares) and read.sizes[k] == n
            assert read.holds(weak_quality.INSULT)[k] == insult
            words = set(weak_quality.WORD.findall(" ".join((w.lower() for w in (text or "").split()))))
            stems = {s for w in words for s in (w, *(w[:j] for j in weak_quality.PREFIXES if len(w) > j))}
            if (text or "").isascii():
                assert len(set(feature[doc == k].tolist())) == len(stems)


def test_classifier_on_awkward_rows(spark):
    rows = [(k, t, "clash", 7) for k, t in enumerate(AWKWARD)] + [(None, "no id", None, 8), (3, AWKWARD[3], "twice", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, keep string, P_Quality int")
    labels = spark.createDataFrame([(1, 1, None), (None, 0, 1), (4, None, 1), (4, 1, 0)], "doc_id long, quality int, toxic int")
    for given in (labels, labels.limit(0), None):
        out = weak_quality.classify(df, given)
        assert out.columns == ["doc_id", "text", "keep_in", "P_Quality_in", "p_quality", "p_toxic", "keep"]
        assert sorted(map(str, (r[:4] for r in out.collect()))) == sorted(map(str, rows))
        assert weak_quality.classify(df.limit(0), given).count() == 0


def test_stages_one_by_one(spark, sf):
    docs = queries.table(spark, sf, "documents")
    # repeated rows, null ids and texts, empty texts
    one = docs.orderBy("doc_id").first()
    rows = [tuple(one), (None, one["text"], None, None, None), (None, one["text"], None, None, None), (10**6, None, "en", "s", 0), (10**6 + 1, "", "en", "s", 0)]
    docs = docs.unionByName(spark.createDataFrame(rows, docs.schema))
    texts = lambda df: Counter((r["doc_id"], r["text"]) for r in df.collect())
    for number, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = texts(docs)
        # a column that clashes is left out
        out = stage(spark, docs.withColumn("row", F.lit("clash")).withColumn("keep", F.lit("clash")), sf)
        last = number + 1 == len(corpus_pipeline.STAGES)
        if last:
            bpe = byte_bpe.coder(queries.tokenizer("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
            assert Counter((r["doc_id"], b"".join(bpe.bytes_of[k] for k in r["ids"]).decode()) for r in out.collect()) == Counter((i, t or "") for i, t in before.elements())
            return
        assert out.columns == docs.columns
        out = spark.createDataFrame(out.collect(), out.schema)
        after = texts(out)
        if name == "quality":
            assert not after - before and 0.7 * before.total() < after.total() < before.total()
        elif name == "lines":
            assert after == texts(edit_lines.deduplicate_lines(docs)) and after.total() == before.total()
        elif name == "near_duplicates":
            groups = groups_slowly(list(before.elements()))
            assert not after - before and after.total() == len(groups_of(list(before.elements())))
            assert {i for i, _ in after if i is not None} == {least for _, least in groups if least is not None}
        elif name == "decontaminate":
            hits = suffix_decontam.benchmark_matches(docs, queries.table(spark, sf, "benchmark")).where(suffix_decontam.is_contaminated())
            assert {i for i, _ in before - after} == {r["doc_id"] for r in hits.collect()}
        docs = out


def test_run(spark, sf):
    out = corpus_pipeline.run(spark, sf)
    rows = out.collect()
    assert out.columns == ["doc_id", "n_tokens", "ids"] and rows and all(r["n_tokens"] == len(r["ids"]) for r in rows)


def test_stages_on_an_empty_table(spark, sf):
    docs = queries.table(spark, sf, "documents").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, sf).count() == 0


def test_features_left_out_before_the_fit_change_no_weight(spark):
    draw = np.random.default_rng(5)
    rows = [np.unique(np.minimum(draw.zipf(1.3, 40), weak_quality.BUCKETS - 1)).astype(np.int32) for _ in range(300)]
    weak = np.where([7 in r for r in rows], 0.9, 0.2)
    pull = weak_quality.row_weights(weak) * (0.5 - weak)
    df = spark.createDataFrame([(k, bytearray(r.tobytes())) for k, r in enumerate(rows)], "id long, features binary").repartition(3)
    kept = dict(weak_quality._useful_features(df, {k: [float(p), 0.0] for k, p in enumerate(pull)}))
    assert sum(map(len, kept.values())) < sum(map(len, rows))
    assert weak_quality.fit_sparse([kept[k] for k in range(len(rows))], weak) == weak_quality.fit_sparse(rows, weak)


def test_marked_rows_hold_all_wanted(spark):
    df = spark.range(3000).withColumn("bits_of", F.lit("x"))
    held = marked(df, spark.range(0, 3000, 7), "id")
    assert held.columns == ["id", "bits_of", "may_"] and held.count() == 3000
    may = {r["id"] for r in held.where("may_").collect()}
    assert may >= set(range(0, 3000, 7)) and len(may) < 600
    assert marked(df, spark.range(0), "id").where("may_").isEmpty()
