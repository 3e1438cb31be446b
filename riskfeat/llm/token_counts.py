"""Token counts by a count-only Viterbi over a unigram vocabulary.

An Aho-Corasick automaton lists, in one pass, every vocabulary piece that ends at each character.
Dynamic programming keeps the best score and its number of pieces for every end, and nothing else: no
path is stored.  Rules follow the unigram model of the tokenizers library: a character that no piece covers alone costs
the lowest score less ``UNKNOWN`` and counts as its UTF-8 bytes; scores are 64-bit sums; of equal scores
the longer last piece stays.

Vocabulary and scores are read from a public model file; nothing is trained.

Nulls and special cases: a null or empty text has no pieces; rows with the same id are counted one by
one; equal texts get equal counts; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed values of the library: how much an unknown character costs, and its mark for a blank.
UNKNOWN = 10.0
BLANK = "▁"
WORD, INSIDE = re.compile(f"{BLANK}+[^{BLANK}]*"), re.compile(f"[^{BLANK}]{BLANK}")
WORDS_KEPT = 1 << 16


@lru_cache(maxsize=2)
def automaton(model_file: str) -> tuple[ahocorasick.Automaton, float]:
    """The pieces of the vocabulary with their scores, and the score of an unknown character."""
    model = sentencepiece.SentencePieceProcessor(model_file=model_file)
    found, lowest = ahocorasick.Automaton(), 0.0
    for i in range(model.get_piece_size()):
        if model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i):
            continue
        piece, score = model.id_to_piece(i), float(model.get_score(i))
        found.add_word(piece, (len(piece), score))
        lowest = min(lowest, score)
    found.make_automaton()
    return found, lowest - UNKNOWN


def best_count(text: str, found: ahocorasick.Automaton, unknown: float) -> int:
    """Number of pieces of the best path."""
    n = len(text)
    score, pieces = [0.0] * (n + 1), [0] * (n + 1)
    matches = found.iter(text)
    end, match = next(matches, (n, None))
    for k in range(n):
        best, count, alone = None, 0, False
        # Longest pieces come first, so a later one of equal score does not replace an earlier one.
        while end == k:
            length, s = match
            alone |= length == 1
            candidate = score[k + 1 - length] + s
            if best is None or candidate > best:
                best, count = candidate, pieces[k + 1 - length] + 1
            end, match = next(matches, (n, None))
        if not alone:
            candidate = score[k] + unknown
            if best is None or candidate > best:
                best, count = candidate, pieces[k] + len(text[k].encode())
        score[k + 1], pieces[k + 1] = best, count
    return pieces[n]


def token_counts(docs: DataFrame, model_file: str) -> DataFrame:
    """doc_id, n_chars, n_tokens of every whole text of ``docs``.

    Where no piece goes on over the start of a word, best paths of words add up, and each of the last
    WORDS_KEPT distinct words is counted once.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, unknown = automaton(model_file)
        parted = not any(INSIDE.search(p) for p in found.keys())
        of_word = lru_cache(WORDS_KEPT)(lambda w: best_count(w, found, unknown))

        def count_pieces(text: str | None) -> int:
            whole = BLANK + text.replace(" ", BLANK) if text else ""
            return sum(map(of_word, WORD.findall(whole))) if parted else best_count(whole, found, unknown)

        for b in batches:
            texts = b.column("text").to_pylist()
            columns = [b.column("doc_id"), pa.array([len(t or "") for t in texts], pa.int64()), pa.array([count_pieces(t) for t in texts], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_chars", "n_tokens"])

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    return rows.mapInArrow(run, "doc_id bigint, n_chars bigint, n_tokens bigint")
