"""Token counts from pre-token frequencies."""

from __future__ import annotations

from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import ids_and_texts, prepare
from .tokens import broadcast_spec, byte_level, is_byte_level, library_counter

CACHE_WORDS = 400_000


class PieceCounts(dict):
    """Pieces of each distinct pre-token, counted once; emptied when full, so memory is bounded."""

    def __init__(self, vocabulary):
        super().__init__()
        self.vocabulary = vocabulary

    def __missing__(self, word: str) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        n = 1 if word in self.vocabulary.special else len(self.vocabulary.exact(word.encode()))
        self[word] = n
        return n


def count_tokens(docs: DataFrame, vocabulary_path: str, limit: int = 1024) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit (n_tokens > limit) of every row.

    A document's pre-token frequencies meet a table of piece counts that has each distinct pre-token
    once; the products are summed and no document's ids are made. The table lives in the task, as a
    shuffle of (document, pre-token) rows would outweigh the input; nothing is shuffled at all.
    Vocabularies that aren't byte-level BPE are counted by their library.

    Null or empty text: zeros. A null doc_id stays null. Repeated rows give repeated rows. An empty
    table gives an empty table. Other columns are ignored, whatever their names.
    """
    spark = docs.sparkSession
    prepare(spark)
    spec = broadcast_spec(spark, vocabulary_path)

    def run(batches):
        byte_bpe = is_byte_level(spec.value)
        vocabulary = byte_level(spec.value) if byte_bpe else None
        pieces = PieceCounts(vocabulary)
        for b in batches:
            texts = b.column(1).to_pylist()
            if byte_bpe:
                counts = [
                    sum([n * pieces[w] for w, n in Counter(vocabulary.pretokens(t)).items()]) for t in texts
                ]
            else:
                counts = library_counter(spec.value)(texts)
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(0),
                    pa.array([len(t.encode()) for t in texts], pa.int64()),
                    pa.array(counts, pa.int64()),
                    pa.array([n > limit for n in counts], pa.bool_()),
                ],
                ["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    return ids_and_texts(docs).mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
