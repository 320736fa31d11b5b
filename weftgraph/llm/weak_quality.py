"""Quality and toxicity by weak labels: overlapping heuristics, EM over their votes, a hashed linear scorer.

Every document gets the votes of several heuristic labellers, each yes, no or abstain.  All
documents are counted by their pattern of votes, and expectation-maximisation over these counts
estimates how often each labeller says yes among good and among bad documents; no labels are needed.
The posterior of a pattern is the weak label of its documents.  On a bounded sample the weak labels
train a sparse logistic model over hashed features, which then scores all documents.

The ``labels`` table is one more labeller, for the rows that it covers, and the source of one
lexicon, which is learned from at most ``max_counted`` labelled documents (so many ids and labels
go to all tasks, and no text is shuffled for it).  The scorers are fitted on the weak labels of at most ``max_fitted`` rows: those that ``labels`` covers first, then others, each part in
the order of a hash of the id; the toxic scorer on the covered ones alone, if there are any.

Texts are read in slices: each word becomes a number, what a word says by itself is worked out once
and kept, and the documents of a slice are summed up together.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, long_columns, set_apart, slices, utf8

#: Rows, each with its weak label, that the scorers are fitted on at most.
MAX_FITTED = 8000
#: Labelled rows that the lexicon is learned from at most.
MAX_COUNTED = 30_000
#: A lexicon word: the share of labelled documents that hold it and are toxic is at least this
#: (lower end of the 95 % interval).
LEXICON_SHARE = 0.65
Z2 = 1.96**2
BUCKETS = 1 << 20
SLICE_BYTES = 1 << 20
#: Bytes of the remembered words, about, beyond which they are forgotten before the next slice.
VOCABULARY = 32 << 20
YES, NO, ABSTAIN = 1, 0, 2
#: Posterior of a row whose given label says yes.
TRUST = 0.98
#: A feature takes part in a scorer if as many rows of the sample hold it and its slope at zero is as large.
LEAST_ROWS, LEAST_SLOPE = 5, 4e-3
#: Frequent function words of English, German, French and Spanish, and English insults.
FUNCTION_WORDS = frozenset(
    "the of and to in is that for it with as was on be by at this are from or an der die das und ein eine den von zu mit sich des auf für ist im nicht dem als le la les et des un une du que est pour en dans qui sur pas par au plus el los las y del se por con una para".split()
)
INSULTS = frozenset("idiot idiots moron morons loser losers stupid pathetic scum worthless trash clown disgusting".split())
WORD = re.compile(r"\w+")
ENDS = ".,;:!?)\"'"
SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
BASE = 0x9E3779B97F4A7C15
SIGNALS = ("noisy", "upper", "top", "stutter", "ends", "function")
#: Steps of a signal's feature.
STEPS = (0.01, 0.02, 0.05, 0.1, 0.15, 0.2, 0.3, 0.5)
#: What a word says by itself, as bits.
NOISY, UPPER, ENDING, FUNCTION, INSULT, LISTED = (1 << k for k in range(6))


#: Features are numbers below 2 ** HASH_BITS; the scorers fold them into BUCKETS.
HASH_BITS = 40
PREFIXES = range(3, 8)
_POWERS = np.array([pow(BASE, k + 1, 1 << 64) for k in range(PREFIXES[-1])], dtype=np.uint64)


def stem_hashes(tokens: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(place of the token, hash) of each token and of its beginnings of 3 to 7 letters, which inflected forms share."""
    from xxhash import xxh64_intdigest

    width = PREFIXES[-1]
    sizes = np.fromiter(map(len, tokens), dtype=np.int64, count=len(tokens))
    letters = np.array(tokens, dtype=f"U{width}").view(np.uint32).reshape(len(tokens), width).astype(np.uint64)
    begun = np.cumsum((letters + np.uint64(1)) * _POWERS, axis=1)  # the beginning of k letters is in column k - 1
    own = begun[np.arange(len(tokens)), np.clip(sizes, 1, width) - 1]
    longer = np.flatnonzero(sizes > width)
    own[longer] = np.fromiter((xxh64_intdigest(tokens[k].encode()) for k in longer.tolist()), dtype=np.uint64, count=len(longer))
    places, found = [np.arange(len(tokens))], [own]
    for k in PREFIXES:
        more = np.flatnonzero(sizes > k)
        places.append(more)
        found.append(begun[more, k - 1])
    mixed = np.concatenate(found)
    mixed = (mixed ^ (mixed >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return np.concatenate(places), (mixed >> np.uint64(64 - HASH_BITS)).astype(np.int64)


def _bucket(feature: str) -> int:
    from xxhash import xxh64_intdigest

    return xxh64_intdigest(feature.encode()) % BUCKETS


def powers(base: int, n: int) -> np.ndarray:
    """The powers of ``base`` from 0 to n, modulo 2 ** 64."""
    return np.cumprod(np.concatenate([np.ones(1, dtype=np.uint64), np.full(n, base, dtype=np.uint64)]))


class Vocabulary:
    """Words as numbers.  ``flags`` holds a word's bits and ``values[starts[n]:starts[n + 1]]`` its features.

    A word is known by a 64-bit hash of its bytes; words stand between ASCII white space.
    ``lexicon`` are the hashes of the lexicon's stems, sorted; with ``within``, a mask over the
    buckets, only features of these buckets are kept.
    """

    def __init__(self, lexicon: np.ndarray | None = None, within: np.ndarray | None = None, featured: bool = True):
        self.lexicon, self.within, self.featured = lexicon, within, featured
        self.power, self.inverse = powers(BASE, 0), powers(BASE, 0)
        self.forget()

    def forget(self) -> None:
        self.known, self.number = np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
        self.flags, self.starts, self.values, self.held = np.zeros(0, dtype=np.uint8), np.zeros(1, dtype=np.int64), np.zeros(0, dtype=np.int64), 0

    def learn(self, words: list[str]) -> None:
        cores = [w[:-1] if len(w) > 1 and w[-1] in ENDS else w for w in words]
        plain = np.array(list(map(str.isalnum, cores)), dtype=bool)
        lowered = list(map(str.lower, cores))
        upper = np.array([c.isupper() and len(c) > 1 for c in cores], dtype=bool)
        ending = np.array([w[-1] in ".!?" for w in words], dtype=bool)
        function = np.array(list(map(FUNCTION_WORDS.__contains__, lowered)), dtype=bool)
        tokens, owner = lowered, np.arange(len(words))
        if not plain.all():
            parts = [[low] if whole else WORD.findall(word.lower()) for whole, low, word in zip(plain.tolist(), lowered, words)]
            tokens, owner = list(chain.from_iterable(parts)), np.repeat(owner, list(map(len, parts)))
        any_of = lambda at: np.bincount(at, minlength=len(words)) > 0
        insult = any_of(owner[[k for k, t in enumerate(tokens) if t in INSULTS]])
        place, hashes = stem_hashes(tokens) if tokens and (self.featured or self.lexicon is not None) else (np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64))
        listed = any_of(owner[place[np.isin(hashes, self.lexicon)]]) if self.lexicon is not None else np.zeros(len(words), dtype=bool)
        bits = (NOISY, ~plain), (UPPER, upper), (ENDING, ending), (FUNCTION, function), (INSULT, insult), (LISTED, listed)
        self.flags = np.concatenate([self.flags, sum((bit * held.astype(np.uint8) for bit, held in bits), np.zeros(len(words), dtype=np.uint8))])
        if not self.featured:
            place, hashes = place[:0], hashes[:0]
        elif self.within is not None:
            kept = self.within[hashes % BUCKETS]
            place, hashes = place[kept], hashes[kept]
        word = owner[place]
        order = np.argsort(word, kind="stable")
        self.values = np.concatenate([self.values, hashes[order]])
        self.starts = np.concatenate([self.starts, self.starts[-1] + np.cumsum(np.bincount(word, minlength=len(words)))])
        self.held += 80 * len(words) + 2 * sum(map(len, words)) + 8 * len(hashes)

    def read(self, texts: list[bytes | None]) -> Slice:
        """The texts' words counted; a null text has none."""
        if self.held > VOCABULARY:
            self.forget()
        texts = [text or b"" for text in texts]
        data = b" ".join([*texts, b""])
        raw = np.frombuffer(data, dtype=np.uint8)
        if len(self.power) <= len(raw):
            self.power, self.inverse = powers(BASE, len(raw)), powers(pow(BASE, -1, 1 << 64), len(raw))
        inside = np.concatenate([[False], ~SPACE[raw], [False]])
        turns = np.flatnonzero(inside[1:] != inside[:-1])
        starts, ends = turns[::2], turns[1::2]
        summed = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum((raw + np.uint64(1)) * self.power[: len(raw)])])
        hashes = (summed[ends] - summed[starts]) * self.inverse[starts]
        codes, distinct = pd.factorize(hashes)
        at = np.searchsorted(self.known, distinct)
        new = np.ones(len(distinct), dtype=bool)
        inner = np.flatnonzero(at < len(self.known))
        new[inner] = self.known[at[inner]] != distinct[inner]
        if new.any():
            first = np.full(len(distinct), len(codes), dtype=np.int64)
            first[codes[::-1]] = np.arange(len(codes))[::-1]
            chosen = first[new]
            self.learn([data[a:b].decode("utf-8", "replace") for a, b in zip(starts[chosen].tolist(), ends[chosen].tolist())])
            known, number = np.concatenate([self.known, distinct[new]]), np.arange(len(self.known) + len(chosen))
            number[: len(self.known)] = self.number
            order = np.argsort(known)
            self.known, self.number = known[order], number[order]
            at = np.searchsorted(self.known, distinct)
        sizes = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
        owner = np.searchsorted(np.cumsum(sizes + 1), starts, side="right")
        return Slice(self, len(texts), owner, self.number[at][codes])


class Slice:
    """Documents whose words are numbers of a vocabulary."""

    def __init__(self, vocabulary: Vocabulary, n: int, owner: np.ndarray, numbers: np.ndarray):
        self.vocabulary, self.sizes = vocabulary, np.bincount(owner, minlength=n)
        width = max(len(vocabulary.known), 1)
        codes, pairs = pd.factorize(owner * width + numbers)
        times = np.bincount(codes, minlength=len(pairs))
        #: each document's distinct words
        self.doc, self.word = pairs // width, pairs % width
        self.flags = flags = vocabulary.flags[self.word]
        most = np.zeros(n, dtype=np.int64)
        np.maximum.at(most, self.doc, times)
        share = lambda bit: np.bincount(self.doc, weights=times * (flags & bit > 0), minlength=n)
        again = np.bincount(owner[1:], weights=(numbers[1:] == numbers[:-1]) & (owner[1:] == owner[:-1]), minlength=n)
        counts = (share(NOISY), share(UPPER), most, again, share(ENDING), share(FUNCTION))
        self.share = {name: c / np.maximum(self.sizes, 1) for name, c in zip(SIGNALS, counts)}

    def holds(self, bit: int) -> np.ndarray:
        """Which documents hold a word with this bit."""
        return np.bincount(self.doc, weights=self.flags & bit > 0, minlength=len(self.sizes)) > 0

    def features(self) -> tuple[np.ndarray, np.ndarray]:
        """(document, feature) of the words, distinct and by document; a slice has fewer than 2 ** 23 documents."""
        starts = self.vocabulary.starts
        first, many = starts[self.word], starts[self.word + 1] - starts[self.word]
        at = np.repeat(first - np.cumsum(many) + many, many) + np.arange(int(many.sum()))
        pairs = pd.unique(np.repeat(self.doc, many) << HASH_BITS | self.vocabulary.values[at])
        return pairs >> HASH_BITS, pairs & ((1 << HASH_BITS) - 1)

    def signals(self) -> np.ndarray:
        """A row of hashed features of the signals, each in steps, and of the word lists, per document."""
        table = np.array([[_bucket(f"s:{name}:{step}") for step in range(len(STEPS) + 1)] for name in SIGNALS])
        lengths = np.array([_bucket(f"s:n:{k}") for k in range(14)])
        columns = [table[k][np.searchsorted(STEPS, self.share[name])] for k, name in enumerate(SIGNALS)]
        columns += [np.where(self.holds(bit), _bucket(f"s:{bit}:yes"), _bucket(f"s:{bit}:no")) for bit in (INSULT, LISTED)]
        columns.append(lengths[np.ceil(np.log2(np.minimum(self.sizes, 4096) + 1)).astype(np.int64)])
        return np.stack(columns, axis=1)

    def quality_votes(self) -> np.ndarray:
        """Votes on "this is readable prose", in the order of SIGNALS; a text too short to judge gets none."""
        n, s = self.sizes, self.share
        quiet = lambda raised: np.where(raised, NO, YES)
        votes = [
            quiet(s["noisy"] >= 0.12),
            quiet(s["upper"] >= 0.12),
            np.where(n >= 20, quiet(s["top"] >= 0.25), ABSTAIN),
            np.where(n >= 20, quiet(s["stutter"] >= 0.05), ABSTAIN),
            np.where((s["ends"] >= 0.02) & (s["ends"] <= 0.5), YES, np.where(n >= 60, NO, ABSTAIN)),
            np.where(s["function"] >= 0.08, YES, np.where((s["function"] < 0.02) & (n >= 20), NO, ABSTAIN)),
        ]
        return np.where(n[:, None] >= 8, np.stack(votes, axis=1), ABSTAIN)

    def toxic_votes(self) -> np.ndarray:
        """Votes on "this is toxic": a known insult, a word of the lexicon."""
        n = len(self.sizes)
        listed = np.where(self.holds(LISTED), YES, NO) if self.vocabulary.lexicon is not None else np.full(n, ABSTAIN)
        return np.stack([np.where(self.holds(INSULT), YES, NO), listed], axis=1)


def expectation_maximisation(patterns: list[tuple[tuple[int, ...], int]], alarm: int, rounds: int = 60, trusted: int | None = None) -> tuple[np.ndarray, dict[tuple[int, ...], float]]:
    """(rates, posterior of "true" by pattern) from counted patterns of votes.

    ``rates[side, labeller]`` is how often a labeller that votes says yes among the false (0) and the
    true (1) rows; an abstaining labeller says nothing.  ``alarm`` is the vote that one labeller alone
    casts with reason: patterns that hold it start on its side, all others on the other.  What the
    labeller number ``trusted`` says is taken as known: faults of one kind are found by one labeller
    only, and the labelled rows show how often.
    """
    votes = np.array([p for p, _ in patterns], dtype=np.int64).reshape(len(patterns), -1)
    weight = np.array([n for _, n in patterns], dtype=np.float64)
    cast, yes = votes != ABSTAIN, votes == YES
    posterior = np.where((votes == alarm).any(axis=1) == (alarm == YES), 0.95, 0.05)
    rates = np.full((2, votes.shape[1]), 0.5)
    for _ in range(rounds):
        for side, mass in ((0, weight * (1 - posterior)), (1, weight * posterior)):
            rates[side] = ((mass[:, None] * yes).sum(axis=0) + 0.5) / ((mass[:, None] * cast).sum(axis=0) + 1)
        true = np.clip((weight * posterior).sum() / max(weight.sum(), 1), 1e-3, 1 - 1e-3)
        says = np.where(yes, np.log(rates[1] / rates[0]), np.log((1 - rates[1]) / (1 - rates[0])))
        odds = np.log(true / (1 - true)) + np.where(cast, says, 0).sum(axis=1)
        posterior = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
        if trusted is not None:
            posterior = np.where(cast[:, trusted], np.where(yes[:, trusted], TRUST, 1 - TRUST), posterior)
    return rates, {p: float(x) for (p, _), x in zip(patterns, posterior)}


def row_weights(wanted: np.ndarray) -> np.ndarray:
    """Weights of rows so that either side counts half."""
    positive = min(max(wanted.mean(), 1e-3), 1 - 1e-3) if len(wanted) else 0.5
    return (wanted / positive + (1 - wanted) / (1 - positive)) / (2 * max(len(wanted), 1))


def fit_sparse(rows: list[np.ndarray], wanted: np.ndarray, rounds: int = 300, penalty: float = 1e-4, least_rows: int = LEAST_ROWS, least_slope: float = LEAST_SLOPE) -> dict[int, float]:
    """Weights by bucket (-1: the constant) of a logistic model with an L1 penalty, by accelerated proximal steps.

    Only features of ``least_rows`` rows or more with a slope of ``least_slope`` at zero take part;
    rows are weighted so that either side counts half.
    """
    if not len(rows):
        return {-1: 0.0}
    owner, index = np.repeat(np.arange(len(rows), dtype=np.int32), list(map(len, rows))), np.concatenate(rows).astype(np.int32)
    weight = row_weights(wanted)
    slope = np.bincount(index, weights=(weight * (0.5 - wanted))[owner], minlength=BUCKETS)
    kept = (np.bincount(index, minlength=BUCKETS) >= least_rows) & (np.abs(slope) > least_slope)
    names = np.append(np.flatnonzero(kept), -1)
    place, chosen = np.cumsum(kept, dtype=np.int32) - 1, kept[index]
    owner, index = owner[chosen], place[index[chosen]]
    owner, index = np.concatenate([owner, np.arange(len(rows))]), np.concatenate([index, np.full(len(rows), len(names) - 1)])
    forward = lambda w: np.bincount(owner, weights=w[index], minlength=len(rows))
    back = lambda x: np.bincount(index, weights=x[owner], minlength=len(names))
    # a step for each feature, by its mass; the largest curvature left comes from power iteration
    mass = np.maximum(back(weight), 1e-12)
    v = np.ones(len(names))
    for _ in range(20):
        v = back(weight * forward(v / np.sqrt(mass))) / np.sqrt(mass)
        largest = np.linalg.norm(v)
        v /= largest
    step = 4 / (mass * largest * 1.1)
    shrink = step * penalty * (names >= 0)
    w, ahead, speed = np.zeros(len(names)), np.zeros(len(names)), 1.0
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(forward(ahead), -30, 30)))
        moved = ahead - step * back(weight * (p - wanted))
        moved = np.sign(moved) * np.maximum(np.abs(moved) - shrink, 0)
        faster = (1 + (1 + 4 * speed**2) ** 0.5) / 2
        ahead = moved + (speed - 1) / faster * (moved - w)
        w, speed = moved, faster
    return {-1: float(w[-1]), **{int(names[k]): float(w[k]) for k in np.flatnonzero(w[:-1])}}


def _labelled(docs: DataFrame, labels: DataFrame | None, id_col: str) -> DataFrame:
    """(label_id, quality, toxic) of the labelled documents; of several labels of an id the larger ones."""
    none = F.lit(None).cast("int")
    ids = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("label_id"), none.alias("quality"), none.alias("toxic"), F.lit(1).alias("here"))
    if labels is None:
        return ids.where("false").drop("here")
    given = labels.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("label_id"), F.col("quality").cast("int").alias("quality"), F.col("toxic").cast("int").alias("toxic"), F.lit(0).alias("here"))
    held = ids.unionByName(given).groupBy("label_id").agg(F.max("quality").alias("quality"), F.max("toxic").alias("toxic"), F.max("here").alias("here"))
    return held.where("here = 1 and (quality is not null or toxic is not null)").drop("here")


def _least_toxic() -> int:
    """Toxic documents that a lexicon word needs at least, if it stands in no other."""
    k = 1
    while k / (k + Z2) < LEXICON_SHARE:
        k += 1
    return k


def _stem_counts(labelled: DataFrame, among: np.ndarray | None = None) -> DataFrame:
    """(stem, k, n): documents of (text, toxic) that hold a stem, toxic ones and all; only stems of the sorted ``among``, if given."""

    def stems(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = Vocabulary()
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def summed() -> list[np.ndarray]:
            names, at = np.unique(np.concatenate([h[0] for h in held]), return_inverse=True)
            total = lambda k: np.bincount(at, weights=np.concatenate([h[k] for h in held]), minlength=len(names)).astype(np.int64)
            return [names, total(1), total(2)]

        for part in chain.from_iterable(slices([batch], 0, SLICE_BYTES) for batch in batches):
            doc, stem = vocabulary.read(utf8(part.column(0))).features()
            if among is not None:
                kept = np.isin(stem, among)
                doc, stem = doc[kept], stem[kept]
            toxic = np.array(part.column(1).to_pylist(), dtype=np.int64)
            at, names = pd.factorize(stem)
            held.append((names, np.bincount(at, weights=toxic[doc], minlength=len(names)).astype(np.int64), np.bincount(at, minlength=len(names))))
            if sum(len(h[0]) for h in held) > VOCABULARY // 8:
                held = [tuple(summed())]
                if len(held[0][0]) > VOCABULARY // 16:
                    yield pa.RecordBatch.from_arrays([*map(pa.array, held[0])], names=["stem", "k", "n"])
                    held = []
        if held:
            yield pa.RecordBatch.from_arrays([*map(pa.array, summed())], names=["stem", "k", "n"])

    return labelled.mapInArrow(stems, "stem long, k long, n long").groupBy("stem").agg(F.sum("k").alias("k"), F.sum("n").alias("n"))


def _lexicon(labelled: DataFrame) -> np.ndarray | None:
    """Hashes of the words and stems that mark toxic documents, counted over all rows of (text, toxic); None if there are none.

    Only stems of as many toxic documents as the test needs are counted in the others.
    """
    often = _stem_counts(labelled.where("toxic = 1")).where(F.col("k") >= _least_toxic()).select("stem")
    among = np.array(sorted(r["stem"] for r in often.collect()), dtype=np.int64)
    low = F.expr(f"(k / n + {Z2 / 2} / n - sqrt({Z2} * (k / n * (1 - k / n) + {Z2 / 4} / n) / n)) / (1 + {Z2} / n)")
    found = [r["stem"] for r in _stem_counts(labelled, among).where(low >= LEXICON_SHARE).select("stem").collect()] if len(among) else []
    return np.array(sorted(found), dtype=np.int64) if found else None


def fit(docs: DataFrame, labels: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text", max_fitted: int = MAX_FITTED, max_counted: int = MAX_COUNTED) -> dict:
    """The model: rates of the labellers, weak labels by pattern, and the weights of both scorers.

    Votes and pattern counts cover all documents; the lexicon is learned from at most
    ``max_counted`` labelled rows and the scorers from at most ``max_fitted``.  The driver gets the pattern counts (at most 3 to the number of
    labellers), the lexicon, the votes of the sample, and of its hashed features those that can take part.
    """
    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(text_col, F.lit("")).alias("text"))
    given = cut(_labelled(docs, labels, id_col))
    counted_ids = cut(given.where("toxic is not null").select(F.col("label_id").alias("counted_id"), F.when(F.col("toxic") > 0, 1).otherwise(0).alias("toxic")).orderBy(F.xxhash64("counted_id"), "counted_id").limit(max_counted))
    toxic = texts.join(F.broadcast(counted_ids), F.col("id") == F.col("counted_id")).select("text", "toxic")
    lexicon = _lexicon(toxic)

    def votes(batches: Iterator[pa.RecordBatch], fitted: bool) -> Iterator[pa.RecordBatch]:
        vocabulary = Vocabulary(lexicon, featured=fitted)
        for part in slices(batches, 1, SLICE_BYTES):
            read = vocabulary.read(utf8(part.column(1)))
            # a pattern as the digits of a number
            codes = [pa.array(side @ (10 ** np.arange(side.shape[1], dtype=np.int64))) for side in (read.quality_votes(), read.toxic_votes())]
            columns, names = [part.column(0), *codes], ["id", "good", "bad"]
            if fitted:
                doc, feature = read.features()
                own = read.signals()
                held = [np.unique(np.concatenate([f % BUCKETS, own[k]])).astype(np.int32).tobytes() for k, f in enumerate(np.split(feature, np.searchsorted(doc, np.arange(1, len(own)))))]
                columns, names = [*columns, pa.array(held, pa.binary())], [*names, "features"]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    def pattern(row, side: str) -> tuple[int, ...]:
        """The votes of a counted or sampled row; the given label comes last."""
        code, label, labellers = (row["good"], row["quality"], len(SIGNALS)) if side == "quality" else (row["bad"], row["toxic"], 2)
        return (*(code // 10**k % 10 for k in range(labellers)), ABSTAIN if label is None else int(label > 0))

    id_type = texts.schema[0].dataType.simpleString()
    cast = texts.mapInArrow(lambda b: votes(b, False), f"id {id_type}, good long, bad long")
    counted = cast.join(given, F.col("id") == F.col("label_id"), "left").groupBy("good", "bad", "quality", "toxic").count().collect()
    ids = given.withColumn("turn", F.lit(0)).unionByName(texts.where("id is not null").select(F.col("id").alias("label_id"), F.lit(1).alias("turn")), allowMissingColumns=True)
    turns = ids.groupBy(F.col("label_id").alias("chosen_id")).agg(F.min("turn").alias("turn"), F.max("quality").alias("quality"), F.max("toxic").alias("toxic"))
    chosen = cut(turns.orderBy("turn", F.xxhash64("chosen_id"), "chosen_id").limit(max_fitted).drop("turn"))
    sample = texts.join(F.broadcast(chosen.select("chosen_id")), F.col("id") == F.col("chosen_id")).dropDuplicates(["id"]).select("id", "text")
    hashed = sample.mapInArrow(lambda b: votes(b, True), f"id {id_type}, good long, bad long, features binary")
    sampled = cut(hashed.join(F.broadcast(chosen), F.col("id") == F.col("chosen_id")).drop("chosen_id"))
    rows = sampled.drop("features").orderBy("id").toArrow().to_pylist()
    model: dict = {"lexicon": lexicon, "max_fitted": max_fitted}
    sides: dict = {}
    for name, alarm in (("quality", NO), ("toxic", YES)):
        patterns: Counter = Counter()
        for r in counted:
            patterns[pattern(r, name)] += r["count"]
        rates, posterior = expectation_maximisation(sorted(patterns.items()), alarm, trusted=len(next(iter(patterns))) - 1) if patterns else (np.zeros((2, 0)), {})
        weak = np.array([posterior.get(pattern(r, name), 0.5) for r in rows])
        fitted = np.arange(len(rows))
        if name == "toxic":  # the word lists, all that other rows are judged by, are features of the scorer already
            fitted = np.array([k for k, r in enumerate(rows) if r["toxic"] is not None] or fitted, dtype=np.int64)
        model[name] = {"rates": rates, "posterior": posterior}
        sides[name] = weak, fitted
    # what the scorers can use is found where the features are; only that comes to the driver
    pulls = {r["id"]: [0.0, 0.0] for r in rows}
    for side, (weak, fitted) in enumerate(sides.values()):
        for k, pull in zip(fitted.tolist(), (row_weights(weak[fitted]) * (0.5 - weak[fitted])).tolist()):
            pulls[rows[k]["id"]][side] = pull
    features = dict(_useful_features(sampled.select("id", "features"), pulls))
    for name, (weak, fitted) in sides.items():
        model[name]["weights"] = fit_sparse([features[rows[k]["id"]] for k in fitted], weak[fitted])
    del features
    pa.default_memory_pool().release_unused()
    return model


def _useful_features(sampled: DataFrame, pulls: dict) -> Iterator[tuple[object, np.ndarray]]:
    """Of each row of (id, features) its id and those features that can take part in a scorer.

    ``pulls`` is what a row adds to the slopes of its features, for each scorer.  Slopes are summed
    where the features are; the bound is a little looser than that of ``fit_sparse``, which decides.
    """

    def slopes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, slope = np.zeros(BUCKETS, dtype=np.int64), np.zeros((2, BUCKETS))
        for batch in batches:
            for key, raw in zip(batch.column(0).to_pylist(), batch.column(1)):
                held = np.frombuffer(raw.as_buffer(), dtype=np.int32)  # distinct
                n[held] += 1
                for side, pull in zip(slope, pulls[key]):
                    side[held] += pull
        found = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(n[found]), *(pa.array(side[found]) for side in slope)], names=["feature", "n", "a", "b"])

    summed = sampled.mapInArrow(slopes, "feature long, n long, a double, b double").groupBy("feature").agg(F.sum("n").alias("n"), F.sum("a").alias("a"), F.sum("b").alias("b"))
    used = summed.where((F.col("n") >= LEAST_ROWS) & (F.greatest(F.abs("a"), F.abs("b")) > 0.999 * LEAST_SLOPE)).select("feature")
    kept = np.sort(long_columns(used)[0]).astype(np.int32)  # fewer than BUCKETS

    def narrowed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mask = np.zeros(BUCKETS, dtype=bool)
        mask[kept] = True
        for batch in batches:
            held = (np.frombuffer(raw.as_buffer(), dtype=np.int32) for raw in batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([h[mask[h]].tobytes() for h in held], pa.binary())], names=batch.schema.names)

    found = sampled.mapInArrow(narrowed, sampled.schema).toArrow()
    for key, raw in zip(found.column(0).to_pylist(), found.column(1)):
        yield key, np.frombuffer(raw.as_buffer(), dtype=np.int32)


def score(df: DataFrame, model: dict, text_col: str = "text") -> DataFrame:
    """``df`` with ``p_quality`` and ``p_toxic`` of the two scorers.

    A null or empty text has only the constant and the empty signals.  Columns of ``df`` with these
    names get ``_in`` appended.
    """
    at = df.columns.index(text_col)
    df = set_apart(df, "p_quality", "p_toxic")
    both = [model[name]["weights"] for name in ("quality", "toxic")]
    schema = T.StructType([*df.schema.fields, T.StructField("p_quality", T.DoubleType()), T.StructField("p_toxic", T.DoubleType())])

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = np.zeros((2, BUCKETS))
        for side, own in zip(weights, both):
            side[[b for b in own if b >= 0]] = [w for b, w in own.items() if b >= 0]

        vocabulary = Vocabulary(model["lexicon"], (weights != 0).any(axis=0))
        for part in slices(batches, at, SLICE_BYTES):
            read = vocabulary.read(utf8(part.column(at)))
            doc, feature = read.features()
            own = read.signals()
            # a feature counts once, also where a word and a signal share a bucket
            doc, feature = np.concatenate([doc, np.repeat(np.arange(len(own)), own.shape[1])]), np.concatenate([feature % BUCKETS, own.ravel()])
            pairs = np.unique(doc * BUCKETS + feature)
            p = [1 / (1 + np.exp(-np.clip(w[-1] + np.bincount(pairs // BUCKETS, weights=side[pairs % BUCKETS], minlength=len(own)), -30, 30))) for w, side in zip(both, weights)]
            yield pa.RecordBatch.from_arrays([*part.columns, *map(pa.array, p)], names=schema.names)

    return df.mapInArrow(scored, schema)


def classify(df: DataFrame, labels: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text", max_fitted: int = MAX_FITTED, max_counted: int = MAX_COUNTED) -> DataFrame:
    """All rows and columns of ``df`` with ``p_quality``, ``p_toxic`` and ``keep`` (of good quality and not toxic).

    ``labels`` has ``doc_id``, ``quality`` and ``toxic``; it may be empty, missing, or cover only
    some rows.  Rows with null ids are scored and take part in the counts, but have no label.
    Repeated rows get the same scores; ids that occur more than once share their label.  Texts of
    fewer than 8 words, null ones too, get no quality vote, so the scorer judges them by what it
    learned of short texts.  An empty table gives no rows.  Columns of ``df`` that are named like a
    result get ``_in`` appended, so nothing is overwritten.
    """
    model = fit(df, labels, id_col, text_col, max_fitted, max_counted)
    return score(set_apart(df, "p_quality", "p_toxic", "keep"), model, text_col).withColumn("keep", keep())


def keep(least_quality: float = 0.3, most_toxic: float = 0.5) -> Column:
    """The decision.  The scorers weigh both sides alike, though most documents are good: only clear cases go."""
    return (F.col("p_quality") >= least_quality) & (F.col("p_toxic") < most_toxic)
