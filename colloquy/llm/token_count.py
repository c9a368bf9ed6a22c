"""Token counts by byte-pair merging with a heap and a linked list.

The vocabulary is read from a SentencePiece BPE model.  A text is a list of
symbols (characters, the space written as U+2581); the adjacent pair whose
joined piece ranks lowest is merged again and again, the leftmost of equals
first.  The count is the number of initial symbols minus the merges, plus the
extra bytes of characters that the vocabulary does not have.  No identifiers
are made.

No piece of such a vocabulary has U+2581 after another character (checked on
loading), so no merge crosses the start of a run of spaces: the text falls into
independent chunks, whose counts are remembered per Python worker.
"""

from __future__ import annotations

import heapq
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SPACE = "▁"
#: Chunks remembered per worker and their length, which bound the worker's memory.
CACHE_CHUNKS, CACHE_CHARS = 600_000, 40
_CHUNK = re.compile(f"{SPACE}+[^{SPACE}]*")


class PairMerger:
    """Counts the tokens that a SentencePiece BPE model gives a text."""

    def __init__(self, model_path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=model_path)
        # the normaliser must be the identity with a leading space, as in this kind of model
        if model.encode("ﬁ  a", out_type=str)[:2] != [SPACE, "ﬁ"] and model.normalize("ﬁ  a") != f"{SPACE}ﬁ{SPACE}{SPACE}a":
            raise ValueError("only models with an identity normaliser are supported")
        plain = [i for i in range(model.vocab_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
        # equal scores rank alike, so that the leftmost pair goes first
        ranks = {score: rank for rank, score in enumerate(sorted({model.get_score(i) for i in plain}, reverse=True))}
        self.ranks = {model.id_to_piece(i): ranks[model.get_score(i)] for i in plain}
        if any(re.search(f"[^{SPACE}]{SPACE}", piece) for piece in self.ranks):
            raise ValueError("a piece crosses a word's start")
        self.symbols = {piece for piece in self.ranks if len(piece) == 1}
        self.cache: dict[str, int] = {}

    def count(self, text: str) -> int:
        """Tokens of a whole text; an empty text has none."""
        if not text:
            return 0
        words = text.replace(SPACE, " ").split(" ")
        chunks = Counter(words)
        if "" in chunks:
            chunks = Counter(x[1:] for x in _CHUNK.findall(SPACE + text.replace(" ", SPACE)))
        cache, total = self.cache, 0
        for word, n in chunks.items():
            found = cache.get(word)
            if found is None:
                found = self.merge(SPACE + word)
                if len(word) <= CACHE_CHARS:
                    if len(cache) >= CACHE_CHUNKS:
                        cache.clear()
                    cache[word] = found
            total += n * found
        return total

    def merge(self, chunk: str) -> int:
        """Tokens of one chunk: initial symbols minus merges."""
        symbols, ranks = list(chunk), self.ranks
        left = len(symbols)
        count = left if self.symbols.issuperset(symbols) else sum(1 if c in self.symbols else len(c.encode()) for c in symbols)
        # the linked list: the start of the next and of the previous symbol
        after, before = list(range(1, left + 1)), list(range(-1, left - 1))
        heap = []
        for i in range(left - 1):
            rank = ranks.get(symbols[i] + symbols[i + 1])
            if rank is not None:
                heap.append((rank, i, symbols[i], symbols[i + 1]))
        heapq.heapify(heap)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i]
            if symbols[i] != a or j >= left or symbols[j] != b:
                continue  # one of the two was merged meanwhile
            piece = symbols[i] = a + b
            symbols[j] = ""
            count -= 1
            after[i] = k = after[j]
            if k < left:
                before[k] = i
                if (rank := ranks.get(piece + symbols[k])) is not None:
                    heapq.heappush(heap, (rank, i, piece, symbols[k]))
            if (h := before[i]) >= 0 and (rank := ranks.get(symbols[h] + piece)) is not None:
                heapq.heappush(heap, (rank, h, symbols[h], piece))
        return count


def token_counts(docs: DataFrame, model_path: str, limit: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` for every row, in one pass without a shuffle.

    A null text counts as empty: 0 bytes, 0 tokens.  Ids may be null or repeat;
    other columns are not read.  ``model_path`` must exist on every executor.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merger = PairMerger(model_path)
        for batch in batches:
            counts = [merger.count(text or "") for text in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(counts, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), F.octet_length(text).cast("long").alias("n_bytes"))
    return rows.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of all documents under piece_bpe_32k.model."""
    import public_tokenizers

    return token_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("piece_bpe_32k.model"))
