"""Suffix-array dedup, conversation repair and target resampling against brute force."""

import hashlib
import heapq
import math
import os
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest

from weftgraph.llm import queries, repair_search, suffix_doubling, target_resampling

SPACES = " \t\n\x0b\x0c\r"


def same(found, wanted):
    key = lambda r: tuple((x is None, str(x)) for x in r)
    assert sorted(map(tuple, found), key=key) == sorted(map(tuple, wanted), key=key)


# suffix-array dedup


def removed(rows, length):
    raws = [(text or "").encode() for _, text in rows]
    counts = Counter(r[k : k + length] for r in raws for k in range(len(r) - length + 1))
    for (i, _), r in zip(rows, raws):
        gone = np.zeros(len(r), dtype=bool)
        for k in range(len(r) - length + 1):
            if counts[r[k : k + length]] > 1:
                gone[k : k + length] = True
        turns = np.flatnonzero(np.diff(np.concatenate([[0], gone.astype(np.int8), [0]])))
        kept = bytes(np.frombuffer(r, dtype=np.uint8)[~gone])
        yield i, len(r), int(gone.sum()), [tuple(x) for x in turns.reshape(-1, 2).tolist()], hashlib.sha256(kept).hexdigest()


def found_bytes(df, length):
    return [(r["doc_id"], r["n_bytes"], r["n_removed"], [(s["start"], s["end"]) for s in r["spans"]], r["kept_sha256"]) for r in suffix_doubling.repeated_bytes(df, length=length).collect()]


def spliced(seed, n, length):
    """Texts of common passages, cut and joined at any byte, with some bytes changed."""
    draw = random.Random(seed)
    pool = ["".join(draw.choice("abcé \n") for _ in range(draw.randint(length // 2, 4 * length))) for _ in range(5)]
    texts = []
    for _ in range(n):
        parts = []
        for _ in range(draw.randint(0, 4)):
            passage = draw.choice(pool)
            start = draw.randint(0, len(passage) // 2)
            parts.append(passage[start : start + draw.randint(1, len(passage))])
            parts.append("".join(draw.choice("xyz") for _ in range(draw.randint(0, 5))))
        texts.append("".join(parts))
    return texts


SHAPE = "doc_id long, text string, n_bytes int, spans string, piece long"


@pytest.mark.parametrize("length", [8, 9, 40, 51, 100])
def test_repeated_bytes_of_spliced_texts(spark, length):
    rows = list(enumerate(spliced(length, 60, length)))
    df = spark.createDataFrame([(i, t, 1, "clash", 2) for i, t in rows], SHAPE).repartition(4)
    same(map(str_spans, found_bytes(df, length)), map(str_spans, removed(rows, length)))


def str_spans(row):
    return (*row[:3], str(row[3]), row[4])


def test_repeated_bytes_of_awkward_rows(spark):
    base = "The quick brown fox jumps over the lazy dog; é and ü. " * 3
    word = hashlib.sha256(b"seed").hexdigest() * 8
    texts = [None, "", "a", "a" * 399, "a" * 400, "b" * 400, "b" * 400, "c" * 5000, "ab" * 700, word[:400], "x" + word[:401], word[1:401] + base, base * 20, None, word * 3]
    rows = list(enumerate(texts)) + [(None, word[:450]), (None, word[:450]), (3, "a" * 399), (7, "q" + "c" * 401 + "q")]
    df = spark.createDataFrame([(i, t, 1, "clash", 2) for i, t in rows], SHAPE).repartition(3)
    same(map(str_spans, found_bytes(df, 400)), map(str_spans, removed(rows, 400)))


def test_repeated_bytes_of_a_passage_in_every_text(spark):
    draw = random.Random(5)
    noise = lambda n: "".join(draw.choice("abcdefghij") for _ in range(n))
    passage = noise(300)
    rows = [(k, noise(draw.randint(0, 200)) + passage + noise(draw.randint(0, 200))) for k in range(300)]
    same(map(str_spans, found_bytes(spark.createDataFrame(rows, "doc_id long, text string").repartition(8), 100)), map(str_spans, removed(rows, 100)))


def test_repeated_bytes_over_chunks(spark, monkeypatch):
    monkeypatch.setattr(suffix_doubling, "CHUNK", 64)
    rows = list(enumerate(spliced(3, 30, 60)))
    shape = suffix_doubling.Shape(60)
    for _, text in rows:
        raw = text.encode()
        _, at, start, n = suffix_doubling.anchored(raw, shape)
        assert n.sum() == max(0, len(raw) - 59) and all(s <= a and a + shape.gram <= s + 60 for a, s in zip(at, start))
    same(map(str_spans, found_bytes(spark.createDataFrame(rows, "doc_id long, text string"), 60)), map(str_spans, removed(rows, 60)))


def test_repeated_bytes_of_nothing(spark):
    assert suffix_doubling.repeated_bytes(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    with pytest.raises(ValueError):
        suffix_doubling.repeated_bytes(spark.createDataFrame([], "doc_id long, text string"), length=4)


def test_ranks_of_hot_and_single_pairs(spark):
    draw = random.Random(2)
    pairs = [(0, 0)] * 500 + [(draw.randint(0, 20), draw.randint(0, 20)) for _ in range(300)] + [(-k, 7) for k in range(50)]
    table = np.array(pairs)
    rows = [r for part in np.array_split(np.arange(len(pairs)), 7) for b in suffix_doubling.pair_rows(table[part, 0].copy(), table[part, 1].copy(), part.astype(np.int64)) for r in b.to_pylist()]
    assert len(rows) < len(pairs) / 2
    df = spark.createDataFrame([(r["r1"], r["r2"], r["place"], r["more"]) for r in rows], suffix_doubling.PAIRS)
    out = {r["place"]: r["rank"] for r in suffix_doubling.ranked(df).collect()}
    often = Counter(pairs)
    assert set(out) == {k for k, p in enumerate(pairs) if often[p] > 1}
    assert len({(pairs[k], rank) for k, rank in out.items()}) == len(set(out.values())) == len({pairs[k] for k in out})


# conversation repair

STEPS = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
NEXT = (("user", 2), ("user", 2), ("assistant", 3), ("user", 2))


def cheapest(rows):
    """(gaps, blank, duplicate, truncated, illegal, cost, audit, digest) by uniform-cost search over whole conversations."""
    rows = sorted(((t is not None, t or 0, " " if r is None else r, " " if x is None else x) for t, r, x in rows))
    turns = [t for known, t, _, _ in rows if known]
    faults, seen = [], set()
    for _, _, role, text in rows:
        bare = text.strip(SPACES)
        faults.append(1 if not bare else 2 if (role, text) in seen else 3 if bare[-1] not in ".!?" else 0)
        seen.add((role, text))
    illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    queue, done = [(0, "", 0, 0, ())], set()
    while True:
        cost, audit, at, state, lines = heapq.heappop(queue)
        if (at, state) in done:
            continue
        if at == len(rows) and state in (0, 3):
            break
        done.add((at, state))
        role, then = NEXT[state]
        heapq.heappush(queue, (cost + 5, audit + "I", at, then, (*lines, role + ":")))
        if at < len(rows):
            own, text = rows[at][2:]
            heapq.heappush(queue, (cost + 2, audit + "D", at + 1, state, lines))
            if faults[at] in (0, 3):
                more = 5 if faults[at] == 3 else 0
                if own[:1] in STEPS[state]:
                    heapq.heappush(queue, (cost + more, audit + "K", at + 1, STEPS[state][own[:1]], (*lines, f"{own}:{text}")))
                heapq.heappush(queue, (cost + 1 + more, audit + "R", at + 1, then, (*lines, f"{role}:{text}")))
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    return gaps, faults.count(1), faults.count(2), faults.count(3), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()


def talk(draw, n):
    roles = ["system", "user", "user", "assistant", "assistant", "tool", "", None]
    texts = ["Yes.", "No!", "cut off", "", " \n", None, "Why? ", "é…", "Fine. Then", "I said:\nyes."]
    text = lambda: draw.choice(texts) if draw.random() < 0.6 else f"Line {draw.randint(0, 99)}."
    return [(draw.choice([None, k, k, k + 1]), draw.choice(roles) if draw.random() < 0.5 else ("user", "assistant")[k % 2], text()) for k in range(n)]


def repaired_as(df, **how):
    summary, rows = repair_search.repair(df, **how)
    hashes = {r["conv_id"]: r["repaired_sha256"] for r in repair_search.digests(rows).collect()}
    nothing = hashlib.sha256(b"").hexdigest()
    return [(r["conv_id"], r["gaps"], r["blank"], r["duplicate"], r["truncated"], r["illegal"], r["cost"], r["audit"], hashes.get(r["conv_id"], nothing)) for r in summary.collect()]


CONVERSATIONS = "conv_id long, turn long, role string, text string, key string, place int, audit string"


@pytest.mark.parametrize("length", [3, 128])
def test_repair(spark, length):
    draw = random.Random(length)
    talks = {k: talk(draw, draw.randint(1, 9)) for k in range(60)} | {None: talk(draw, 4), 100: talk(draw, 80), 101: [(0, "user", "Same.")] * 30, 102: [(k, "system", "Rule.") for k in range(7)]}
    df = spark.createDataFrame([(c, *row, "clash", 1, "x") for c, rows in talks.items() for row in rows], CONVERSATIONS).repartition(4)
    same(repaired_as(df, length=length), [(c, *cheapest(rows)) for c, rows in talks.items()])


def test_repair_of_nothing(spark):
    summary, rows = repair_search.repair(spark.createDataFrame([], CONVERSATIONS))
    assert summary.count() == rows.count() == repair_search.digests(rows).count() == 0


def test_search_is_cheapest_and_least():
    draw = random.Random(1)
    for _ in range(300):
        rows = tuple((draw.choice("suax "), draw.choice([0, 0, 1, 2, 3])) for _ in range(draw.randint(0, 7)))
        queue, done = [(0, "", 0, 0)], set()
        while True:
            cost, audit, at, state = heapq.heappop(queue)
            if at == len(rows) and state in (0, 3):
                break
            if (at, state) in done:
                continue
            done.add((at, state))
            heapq.heappush(queue, (cost + 5, audit + "I", at, NEXT[state][1]))
            if at < len(rows):
                heapq.heappush(queue, (cost + 2, audit + "D", at + 1, state))
                if rows[at][1] in (0, 3):
                    more = 5 if rows[at][1] == 3 else 0
                    heapq.heappush(queue, (cost + 1 + more, audit + "R", at + 1, NEXT[state][1]))
                    if rows[at][0] in STEPS[state]:
                        heapq.heappush(queue, (cost + more, audit + "K", at + 1, STEPS[state][rows[at][0]]))
        assert repair_search.search(rows, 0, (0, 3), True) == (cost, audit)


def damage(rows):
    for c, t, role, text in rows:
        name = lambda v: " " if v is None else v
        kind = zlib.crc32(f"{name(c)}:{name(t)}".encode()) % 20
        role, text = "user" if kind == 4 else name(role), "" if kind == 1 else re.sub("[.!?]", "", name(text)) if kind == 2 else name(text)
        yield from [(c, t, role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)


def test_repair_query(spark, sf):
    given = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    given += [(None, k, "user", "Hm.") for k in range(40)] + [(10**6 + k, 0, None, None) for k in range(40)]
    talks = {c: [] for c, *_ in given}
    for c, *row in damage(given):
        talks[c].append(tuple(row))
    nothing = (0,) * 6 + ("", hashlib.sha256(b"").hexdigest())
    found = queries.repaired(spark.createDataFrame(given, "conv_id long, turn long, role string, text string"))
    assert any(not rows for rows in talks.values())
    same(found.collect(), [(c, *(cheapest(rows) if rows else nothing)) for c, rows in talks.items()])


# target resampling


def test_crc_by_length():
    draw = random.Random(3)
    features = [draw.randbytes(n) for n in [0, 1, 1, 2, 63, 64, 65, 127, 128, 129, 1000, 1000, 70_000] + [draw.randint(1, 300) for _ in range(200)]]
    assert target_resampling.crc_by_length(features).tolist() == [zlib.crc32(f) for f in features]
    assert target_resampling.crc_by_length([]).tolist() == []


def drawn(rows, target, ngrams, buckets, percent, least):
    def features(text):
        words = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        runs = [" ".join(words[k : k + n]) for n in range(ngrams[0], ngrams[1] + 1) for k in range(len(words) - n + 1)]
        return len(words), [zlib.crc32(r.encode()) % buckets for r in runs]

    held = [features(text) for _, text in rows]
    s, t = Counter(b for _, own in held for b in own), Counter(b for text in target for b in features(text)[1])
    gain = [math.floor(1000 * math.log((t[b] + 1) * (s.total() + buckets) / ((s[b] + 1) * (t.total() + buckets)))) for b in range(buckets)]
    out = []
    for (i, _), (n_words, own) in zip(rows, held):
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in own)
        out.append([i, n_words, len(own), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    able = sorted((r for r in out if r[1] >= least), key=lambda r: (-r[4], r[0] is not None, r[0]))
    for k, r in enumerate(able[: percent * len(able) // 100]):
        r[5] = k + 1
    return out


@pytest.mark.parametrize("ngrams", [(1, 1), (1, 3)])
def test_resampling(spark, sf, ngrams):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    rows += [(None, "null id " * 20), (5000, None), (5001, ""), (5002, "  \n"), (5003, "日本語" * 700), (5004, "Ünïcode WORDS 42 " * 30), (5004, "Ünïcode WORDS 42 " * 30)]
    target = [r["text"] for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()] + [None, ""]
    df = spark.createDataFrame([(*r, 1, 2, 3) for r in rows], "doc_id long, text string, weight int, rank int, id int").repartition(3)
    found = target_resampling.resample(df, spark.createDataFrame([(t,) for t in target], "text string"), ngrams=ngrams, buckets=1000)
    same(found.collect(), drawn(rows, target, ngrams, 1000, 10, 20))


def test_resampling_of_nothing(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert target_resampling.resample(none, none).collect() == []
    one = spark.createDataFrame([(1, "word " * 30)], "doc_id long, text string")
    assert [r["rank"] for r in target_resampling.resample(one, none, percent=100).collect()] == [1]


def test_resampling_matches_sql(spark, sf):
    db = duckdb.connect()
    for name in ("documents", "benchmark"):
        db.execute(f"create view {name} as select * from '{os.path.join(sf, name)}.parquet'")
    wanted = db.execute(queries.ORACLE_SQL["op13_target_resampling"])
    columns = [c[0] for c in wanted.description]
    same(queries.op13_target_resampling(spark, sf).select(*columns).collect(), wanted.fetchall())
