"""Token counts by heap-and-linked-list byte-pair merging.

A word's bytes are the first symbols, in a doubly linked list; a heap holds the merge
rank of every adjacent pair. The lowest rank is popped (the leftmost of equal ones), its
pair becomes one symbol and the two new neighbours enter the heap. A word has as many
tokens as it had bytes, less the merges made; no token id is looked up or written. A
task keeps the counts of the words that it met last (two generations of ``MEMO_WORDS``
each), so a frequent word is merged once; what drops out is merged again, no result
depends on it. Nothing is shuffled and a text is never cut.

Work for a word of n bytes is O(n log n), so a text without any break costs little more
per byte than prose.

Defined results: a null text counts as the empty text (0 bytes, 0 tokens); a special
token written out in a text is one token, as the tokenizers library has it by default;
repeated rows and repeated ids get equal counts, each row its own; an empty table gives
an empty table; other columns pass through, those named like a result are replaced.
"""

from __future__ import annotations

import functools
import heapq
import json

import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from mlqa.llm.bpe_transducer import WORDS, _ship, byte_letters

MEMO_WORDS = 262_144
MEMO_CHARS = 64
#: Bits of a heap entry that hold the place of the pair's left symbol.
PLACE_BITS = 34


class Merges:
    """Pair ranks of a byte-level BPE file: ``pair[left << 20 | right] = rank, merged symbol``."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab = spec["model"]["vocab"]
        self.special = sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True)
        self.special_pattern = regex.compile("|".join(map(regex.escape, self.special))) if self.special else None
        self.symbol = [0] * 256
        for letter, byte in byte_letters().items():
            self.symbol[byte] = vocab[letter]
        self.pair: dict[int, tuple[int, int]] = {}
        for rank, merge in enumerate(spec["model"]["merges"]):
            a, b = merge if isinstance(merge, list) else merge.split(" ")
            self.pair[vocab[a] << 20 | vocab[b]] = (rank << PLACE_BITS, vocab[a + b])

    def count(self, word: bytes) -> int:
        """Tokens of one word: its symbols less the merges."""
        symbols = [self.symbol[b] for b in word]
        n, pair = len(symbols), self.pair.get
        if n < 2:
            return n
        heap = [m[0] | i for i in range(n - 1) if (m := pair(symbols[i] << 20 | symbols[i + 1]))]
        heapq.heapify(heap)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        merged, place = 0, (1 << PLACE_BITS) - 1
        while heap:
            top = heapq.heappop(heap)
            i = top & place
            j = after[i]
            # a symbol that was merged away is -1; one rank belongs to one pair, so another rank tells a stale entry
            if symbols[i] < 0 or j >= n or not (m := pair(symbols[i] << 20 | symbols[j])) or m[0] | i != top:
                continue
            symbols[i], symbols[j] = m[1], -1
            merged += 1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if m := pair(symbols[i] << 20 | symbols[k]):
                    heapq.heappush(heap, m[0] | i)
            h = before[i]
            if h >= 0 and (m := pair(symbols[h] << 20 | symbols[i])):
                heapq.heappush(heap, m[0] | h)
        return n - merged


class Counts(dict):
    """Counts of words by word; computes what it lacks and holds at most two generations."""

    def __init__(self, merges: Merges) -> None:
        super().__init__()
        self.merges, self.older = merges, {}

    def __missing__(self, word: str) -> int:
        n = self.older.get(word)
        if n is None:
            n = self.merges.count(word.encode("utf-8"))
        if len(word) <= MEMO_CHARS:
            if len(self) >= MEMO_WORDS:
                self.older = dict(self)
                self.clear()
            self[word] = n
        return n

    def of_text(self, text: str) -> int:
        special = self.merges.special_pattern
        if special is None or not any(t in text for t in self.merges.special):
            return sum(map(self.__getitem__, WORDS.findall(text)))
        total, at = 0, 0
        for m in special.finditer(text):
            total += 1 + sum(map(self.__getitem__, WORDS.findall(text[at:m.start()])))
            at = m.end()
        return total + sum(map(self.__getitem__, WORDS.findall(text[at:])))


@functools.lru_cache(maxsize=2)
def _counts(vocabulary: str) -> Counts:
    """Per worker process."""
    return Counts(Merges(SparkFiles.get(vocabulary)))


def count_tokens(docs: DataFrame, tokenizer_path: str, text: str = "text") -> DataFrame:
    """``docs`` without the text, with ``n_bytes`` (UTF-8) and ``n_tokens``."""
    vocabulary = _ship(docs, tokenizer_path)
    rest = [c for c in docs.columns if c not in (text, "n_bytes", "n_tokens")]
    d = docs.select(*rest, F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes"), text)
    schema = StructType([*d.schema.fields[:-1], StructField("n_tokens", LongType())])

    def run(batches):
        counts = _counts(vocabulary)
        for batch in batches:
            n = [counts.of_text(t) if t else 0 for t in batch.column(len(rest) + 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(n, pa.int64())], names=schema.names)

    return d.mapInArrow(run, schema)


def token_counts(docs: DataFrame, tokenizer_path: str, limit: int = 512, text: str = "text") -> DataFrame:
    """``count_tokens`` with ``over_limit``: more than ``limit`` tokens."""
    return count_tokens(docs.drop("over_limit"), tokenizer_path, text).withColumn("over_limit", F.col("n_tokens") > limit)
