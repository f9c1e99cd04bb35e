"""Token counts by heap-and-linked-list byte-pair merging."""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed values of byte-level BPE: how it cuts a text, and the printable stand-in of each byte.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def byte_symbols() -> dict[int, str]:
    """Printable bytes stand for themselves, the others for the characters from U+0100 on, in order."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class MergeCounter:
    """Counts the tokens of a text without making them: symbols to begin with, less the merges done."""

    WORDS = 900_000  # units remembered at most; then the memory starts anew

    def __init__(self, path: str):
        spec = json.load(open(path, encoding="utf-8"))
        model = spec["model"]
        vocab = model["vocab"]
        self.start = [vocab[s] for _, s in sorted(byte_symbols().items())]
        self.rank, self.made = {}, []
        for k, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.rank[vocab[a], vocab[b]] = k
            self.made.append(vocab[a + b])
        special = [t["content"] for t in spec["added_tokens"]]
        self.special = regex.compile("|".join(map(regex.escape, sorted(special, key=len, reverse=True)))) if special else None
        self.cut, self.odd = regex.compile(PATTERN), regex.compile(r" \s")
        self.seen: dict[str, int] = {}
        self.parts: dict[str, int] = {}

    def tokens_in(self, part: str) -> int:
        """Of one pre-token: pop the lowest-rank pair (leftmost first), join it, push the pairs that arise."""
        ids = list(map(self.start.__getitem__, part.encode("utf-8")))
        n = left = len(ids)
        get, made = self.rank.get, self.made
        heap = [r * n + i for i, r in enumerate(map(get, zip(ids, ids[1:]))) if r is not None]
        if not heap:
            return n
        heapq.heapify(heap)
        pop, push = heapq.heappop, heapq.heappush
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        while heap:
            r, i = divmod(pop(heap), n)
            j = after[i]
            if j >= n or get((ids[i], ids[j])) != r:
                continue  # one of its symbols has gone into another merge
            new = ids[i] = made[r]
            ids[j] = -1
            k = after[i] = after[j]
            left -= 1
            if k < n:
                before[k] = i
                q = get((new, ids[k]))
                if q is not None:
                    push(heap, q * n + i)
            k = before[i]
            if k >= 0:
                q = get((ids[k], new))
                if q is not None:
                    push(heap, q * n + k)
        return left

    def _part(self, part: str) -> int:
        n = self.parts.get(part)
        if n is None:
            n = self.tokens_in(part)
            if len(part) < 64:
                if len(self.parts) >= self.WORDS:
                    self.parts.clear()
                self.parts[part] = n
        return n

    def _unit(self, unit: str) -> int:
        n = sum(map(self._part, self.cut.findall(unit)))
        if len(unit) < 64:
            if len(self.seen) >= self.WORDS:
                self.seen.clear()
            self.seen[unit] = n
        return n

    def _plain(self, text: str) -> int:
        if self.odd.search(text):  # runs of blanks: units would cut inside a pre-token
            return sum(map(self._part, self.cut.findall(text)))
        head, *rest = text.split(" ")
        total, get = self._unit(head) if head else 0, self.seen.get
        for w in rest:
            n = get(w := " " + w)
            total += self._unit(w) if n is None else n
        return total

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        if self.special is None or not self.special.search(text):
            return self._plain(text)
        marks = len(self.special.findall(text))
        return marks + sum(self._plain(x) for x in self.special.split(text) if x)


def count_tokens(docs: DataFrame, vocabulary: str, limit: int = 512) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` of every whole text.

    A null text counts as empty: 0 bytes, 0 tokens. Any length is counted whole, repeated rows give repeated rows,
    an empty table gives no rows; other columns, whatever their names, are not looked at. ``vocabulary`` is a path
    that executors can read. No shuffle: counting happens where the rows are read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = MergeCounter(vocabulary)
        for b in batches:
            n = [counter.count(t) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("n_bytes"), pa.array(n, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    kind = dict(docs.dtypes)["doc_id"]
    rows = docs.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), "text")
    out = rows.mapInArrow(run, f"doc_id {kind}, n_bytes long, n_tokens long")
    return out.withColumn("over_limit", F.col("n_tokens") > limit)
