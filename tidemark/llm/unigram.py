"""A unigram vocabulary over a SentencePiece model file, and the count-only Viterbi over it.

Text is cut as the Metaspace pre-tokenizer cuts it: a space becomes U+2581, one is put in front unless the text begins
with it, and every segment starts at such a mark. No piece crosses a mark but the runs of marks, which that
pre-tokenizer never offers, so segments are independent and their results can be kept.

Fixed values below are those of the unigram model in the tokenizers library, so that counts agree with it.
"""

from __future__ import annotations

import functools

import ahocorasick
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, slices, store, table

MARK = "▁"
#: Fixed value: an unknown character scores this much below the lowest piece.
UNKNOWN_PENALTY = 10.0
MODEL = "piece_bpe_32k.model"
#: Bytes of segments that a Python worker keeps, about; the store is emptied beyond that.
KEPT_BYTES, ENTRY_BYTES = 80 << 20, 200
SLICE_BYTES = 8 << 20


def model_path(name: str = MODEL) -> str:
    return public_tokenizers.path(name)


@functools.cache
def pieces(path: str) -> list[tuple[str, float, int]]:
    """(piece, score, type) in id order; types as in the file: 1 normal, 2 unknown, 3 control, 6 byte."""
    from sentencepiece import sentencepiece_model_pb2 as pb

    model = pb.ModelProto()
    with open(path, "rb") as f:
        model.ParseFromString(f.read())
    return [(p.piece, p.score, p.type) for p in model.pieces]


def segments(text: str) -> list[str]:
    """Without their leading mark."""
    marked = text.replace(" ", MARK)
    if not marked.startswith(MARK):
        marked = MARK + marked
    return marked[1:].split(MARK)


class CountViterbi(dict):
    """segment -> complex(score, count): dynamic programming over the vocabulary matches that Aho-Corasick enumerates.

    Ties are broken as the tokenizer does: candidates come in order of their start, and only a strictly higher score
    replaces an earlier one, so that of equal scores the piece that starts first (the longest last piece) stays.
    A character that no piece covers alone is unknown and counts one piece for each of its UTF-8 bytes.
    """

    def __init__(self, path: str, kept: int = KEPT_BYTES):
        self.kept, self.held = kept, 0
        self.automaton = ahocorasick.Automaton()
        vocabulary = pieces(path)
        for piece, score, _ in vocabulary:
            self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.unknown = min(score for _, score, _ in vocabulary) - UNKNOWN_PENALTY

    def __missing__(self, segment: str) -> complex:
        self.held += ENTRY_BYTES + len(segment)
        if self.held > self.kept:
            self.clear()
            self.held = 0
        out = self[segment] = self.solve(MARK + segment)
        return out

    def solve(self, s: str) -> complex:
        n = len(s)
        ending: list[list[tuple[int, float]]] = [[] for _ in range(n)]
        for end, match in self.automaton.iter(s):
            ending[end].append(match)
        best, count = [0.0] * (n + 1), [0] * (n + 1)
        for end in range(n):
            top = None
            found = ending[end]
            found.sort(reverse=True)  # by length: the earliest start first
            for length, score in found:
                start = end + 1 - length
                total = score + best[start]
                if top is None or total > top:
                    top, pieces_so_far = total, count[start] + 1
            if not found or found[-1][0] != 1:
                total = self.unknown + best[end]
                if top is None or total > top:
                    top, pieces_so_far = total, count[end] + len(s[end].encode("utf-8", "surrogatepass"))
            best[end + 1], count[end + 1] = top, pieces_so_far
        return complex(best[n], count[n])

    def text(self, text: str) -> complex:
        return sum(map(self.__getitem__, segments(text)), 0j) if text else 0j


def counter(path: str) -> CountViterbi:
    return store(("unigram", path), lambda: CountViterbi(path))


def token_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """One row per row: id, n_tokens (long), score (double, of the best segmentation). No shuffle.

    Defined results: a null text counts as empty, and an empty text has no token and score 0. Scores are summed in doubles. Extra columns are ignored. Ids may repeat or be null.
    """
    path = path or model_path()
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))

    def run(batches):
        viterbi = counter(path)
        for batch in batches:
            for part in slices(batch, "text", SLICE_BYTES):
                found = [viterbi.text(t or "") for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [part.column("id"), pa.array([int(x.imag) for x in found], pa.int64()), pa.array([x.real for x in found], pa.float64())],
                    names=[id_col, "n_tokens", "score"],
                )

    return map_arrow(rows, run, f"{id_col} long, n_tokens long, score double")


def query(spark, sf_dir):
    return token_counts(table(spark, sf_dir, "documents"))


SQL = None
