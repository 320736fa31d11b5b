"""Token counts at every prefix of a text, by dynamic programming over the pieces of a BPE model.

The last token of a prefix's encoding is the one vocabulary piece that ends there and is
*compatible* with the last token of what stands before it: encoding the two side by side leaves
them as they are.  So ``count[i] = count[i - len(piece)] + 1``, and one pass gives the exact count
of every prefix.  No piece continues past a word into the mark of the next space, so words are
independent and each distinct word is worked out once per worker.  Counts are kept as differences
between neighbouring prefixes; a running sum gives the counts of a whole text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import slices, texts

SPACE = "▁"
#: Distinct words that a worker remembers; beyond it the memory starts anew.
CACHE_WORDS = 500_000
SLICE_BYTES = 4 << 20
#: Texts are worked through in stretches of about so many characters, cut at spaces.
STRETCH = 1 << 20
ONE = [1]


class PiecePrefixCounter:
    """Exact prefix counts for one sentencepiece BPE model with byte fallback."""

    def __init__(self, model_path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=model_path)
        self.score = {
            model.id_to_piece(i): model.get_score(i)
            for i in range(model.get_piece_size())
            if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))
        }
        self.inside = {pair for piece in self.score for pair in zip(piece, piece[1:])}
        lengths: dict[str, set[int]] = {}
        for piece in self.score:
            lengths.setdefault(piece[-2:], {1}).add(len(piece))
        #: Lengths of the pieces that end in these two characters, or are this one.
        self.pieces_at = {ending: sorted(found) for ending, found in lengths.items()}
        self.fits: dict[tuple[str, str], bool] = {}
        self.parts: dict[str, bytes] = {}
        self.words: dict[str, bytes] = {}

    def merged(self, text: str) -> list[str]:
        """The pieces of a short text by the merge rule: best score first, then leftmost."""
        parts, score = list(text), self.score
        while len(parts) > 1:
            best, at = None, -1
            for k in range(len(parts) - 1):
                s = score.get(parts[k] + parts[k + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, k
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def compatible(self, before: str, piece: str) -> bool:
        if len(self.fits) > 1_000_000:
            self.fits.clear()
        fits = self.fits[before, piece] = self.merged(before + piece) == ([before, piece] if before else [piece])
        return fits

    def changes(self, word: str) -> bytes:
        """Signed byte per character: by how much the count grows when the prefix takes it in."""
        score, pieces_at, known, compatible = self.score, self.pieces_at, self.fits.get, self.compatible
        last, count = [""], [0]
        for end in range(1, len(word) + 1):
            lengths = pieces_at.get(word[end - 2 : end] if end > 1 else word[:1], ONE)
            for length in lengths:
                start = end - length
                if start < 0:
                    continue
                piece = word[start:end]
                if length > 1 and piece not in score:
                    continue
                before = last[start]
                fits = known((before, piece))
                if fits or fits is None and compatible(before, piece):
                    last.append(piece)
                    count.append(count[start] + (1 if piece in score else len(piece.encode())))
                    break
            else:  # a run of space marks, whose merges tie: ask for the merged form itself
                parts = self.merged(word[:end])
                last.append(parts[-1])
                count.append(sum(1 if p in score else len(p.encode()) for p in parts))
        return bytes([(b - a) & 255 for a, b in zip(count, count[1:])])

    def __getitem__(self, word: str) -> bytes:
        """Changes over the mark of a space and one word."""
        known = self.words.get(word)
        if known is None:
            parts = []
            marked = SPACE + word
            start = 0
            for end in self.breaks(marked):
                part = marked[start:end]
                found = self.parts.get(part)
                if found is None:
                    if len(self.parts) >= CACHE_WORDS:
                        self.parts.clear()
                    found = self.parts[part] = self.changes(part)
                parts.append(found)
                start = end
            if len(self.words) >= CACHE_WORDS:
                self.words.clear()
            known = self.words[word] = b"".join(parts)
        return known

    def breaks(self, text: str) -> list[int]:
        """Where neighbouring characters stand side by side in no piece, so that no merge crosses."""
        inside = self.inside
        return [k + 1 for k, pair in enumerate(zip(text, text[1:])) if pair not in inside] + [len(text)]

    def prefix_counts(self, text: str) -> np.ndarray:
        """``result[i]`` is the number of tokens of ``text[:i]``."""
        found = [np.zeros(1, dtype=np.int32)]
        total, at = 0, 0
        words, get = self.words, self.__getitem__
        while at < len(text):
            cut = text.find(" ", at + STRETCH)
            stretch = text[at:] if cut < 0 else text[at:cut]
            # a stretch is the text between two single spaces: the space before it is its first mark
            if "  " in stretch or SPACE in stretch or stretch[:1] == " " or stretch[-1:] == " " or text[cut + 1 : cut + 2] in (" ", SPACE):
                stretch, cut = text[at:], -1
                marked = SPACE + stretch.replace(" ", SPACE)
                parts = [self.changes(w) if len(w) > 1 and w[1] == SPACE or w == SPACE else get(w[1:]) for w in re.findall(f"{SPACE}+[^{SPACE}]*", marked)]
            else:
                parts = [words.get(w) or get(w) for w in stretch.split(" ")]
            run = total + np.cumsum(np.frombuffer(b"".join(parts), dtype=np.int8), dtype=np.int32)
            total = int(run[-1])
            found.append(run)
            at = len(text) if cut < 0 else cut + 1
        if len(found) == 1:
            return found[0]
        counts = np.concatenate(found[1:])
        counts[0] = 0  # the mark before the first character is not a token of the empty text
        return counts


@lru_cache(maxsize=2)
def counter(model_path: str) -> PiecePrefixCounter:
    return PiecePrefixCounter(model_path)


def longest_within(counts: np.ndarray, budget: int) -> int:
    """Characters of the longest prefix with at most ``budget`` tokens."""
    return int(np.flatnonzero(counts <= budget)[-1])


def prefix_token_counts(
    df: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", budget: int = 4096, keep_prefixes: bool = False
) -> DataFrame:
    """One row per input row: id, ``n_bytes``, ``n_tokens``, ``fits_chars`` and, if asked for, ``prefix_tokens``.

    ``n_tokens`` is the count at the last prefix, ``fits_chars`` the length of the longest prefix
    within ``budget`` tokens, and ``prefix_tokens[i]`` the count of the first i characters.  A null
    or empty text has no tokens; repeated rows give repeated results; an empty table gives none.
    A narrow pass: no shuffle.
    """
    source = texts(df, id_col, text_col)
    fields = [T.StructField(id_col, source.schema[0].dataType), T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("fits_chars", T.LongType())]
    if keep_prefixes:
        fields.append(T.StructField("prefix_tokens", T.ArrayType(T.IntegerType())))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts_of = counter(model_path).prefix_counts
        for part in slices(batches, 1, SLICE_BYTES):
            sizes, totals, fits, prefixes = pc.binary_length(part.column(1)).cast(pa.int64()), [], [], []
            for text in part.column(1).to_pylist():
                counts = counts_of(text)
                totals.append(int(counts[-1]))
                fits.append(len(text) if totals[-1] <= budget else longest_within(counts, budget))
                if keep_prefixes:
                    prefixes.append(counts)
            columns = [part.column(0), sizes, pa.array(totals, pa.int64()), pa.array(fits, pa.int64())]
            if keep_prefixes:
                columns.append(pa.array(prefixes, pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays(columns, names=[f.name for f in fields])

    return source.mapInArrow(count, T.StructType(fields))
