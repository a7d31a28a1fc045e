"""Encoding of a corpus with a public byte-level BPE tokenizer by merge replay."""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from versemill.plans.lineage import cut

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: how byte-level BPE of this family parts a text before merging.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Words whose ids a task that counts tokens keeps; beyond that it starts over, which changes nothing but time.
KEPT = 500_000
#: Code points of a chunk of texts, about.
CHUNK = 500_000


class Replay:
    """Applies the merges of a vocabulary to many words at once, in rank order.

    All words lie in one array of tokens with links to the neighbours. An index leads from what a
    pair of neighbours would merge to, to the places where it stands. The lowest merge present is
    applied at all its places, left to right, and only the pairs at the touched neighbours are
    entered anew.
    """

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.names = {i: b for b, i in ranks.items()}
        self.single = [ranks[bytes([b])] for b in range(256)]
        self.merged: dict[int, int] = {}
        self.code: dict[str, int] = {}
        self._clear()

    def _clear(self) -> None:
        self.code.clear()
        self.flat, self.start = np.zeros(0, np.int32), np.zeros(1, np.int64)

    def _pair(self, a: int, b: int) -> int:
        """The id that a and b merge to, or -1."""
        key = a << 20 | b
        found = self.merged.get(key)
        if found is None:
            found = self.merged[key] = self.ranks.get(self.names[a] + self.names[b], -1)
        return found

    def run(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(offsets, ids) of the words."""
        text = b"".join(words)
        ends = np.cumsum([len(w) for w in words], dtype=np.int64) if words else np.zeros(0, np.int64)
        single = self.single
        token = [single[b] for b in text]
        size = len(token)
        after, before = list(range(1, size + 1)), list(range(-1, size - 1))
        for e in ends.tolist():
            if e:
                after[e - 1] = -1
            if e < size:
                before[e] = -1
        index: dict[int, list[int]] = {}
        pair = self._pair
        for p in range(size - 1):
            if after[p] >= 0 and (m := pair(token[p], token[p + 1])) >= 0:
                index.setdefault(m, []).append(p)
        heap = list(index)
        heapq.heapify(heap)
        while heap:
            m = heapq.heappop(heap)
            for p in sorted(index.pop(m, ())):
                q = after[p]
                if token[p] < 0 or q < 0 or pair(token[p], token[q]) != m:
                    continue
                token[p], token[q] = m, -1
                n = after[p] = after[q]
                if n >= 0:
                    before[n] = p
                    if (x := pair(m, token[n])) >= 0:
                        if x not in index:
                            index[x] = []
                            heapq.heappush(heap, x)
                        index[x].append(p)
                if (l := before[p]) >= 0 and (x := pair(token[l], m)) >= 0:
                    if x not in index:
                        index[x] = []
                        heapq.heappush(heap, x)
                    index[x].append(l)
        ids = np.array(token, np.int32)
        alive = ids >= 0
        count = np.concatenate([[0], np.cumsum(alive)])
        return count[np.concatenate([[0], ends])].astype(np.int64), ids[alive]

    def codes(self, words: list[str]) -> np.ndarray:
        """A code for each word, whose ids are flat[start[code]:start[code + 1]]."""
        code = self.code
        new = [w for w in dict.fromkeys(words) if w not in code]
        if new:
            offsets, ids = self.run([w.encode() for w in new])
            for w in new:
                code[w] = len(code)
            self.start = np.concatenate([self.start, self.start[-1] + offsets[1:]])
            self.flat = np.concatenate([self.flat, ids])
        out = np.fromiter(map(code.__getitem__, words), np.int64, len(words))
        return out


_split = regex.compile(PATTERN)
_replays: dict[int, Replay] = {}


def vocabulary(path: str = VOCABULARY) -> bytes:
    """The vocabulary file, as text of base64 tokens and ranks; bounded by its tokenizer, not by data."""
    return Path(path).read_bytes()


def replay(source: bytes) -> Replay:
    """The process's Replay for a vocabulary."""
    key = hash(source)
    if key not in _replays:
        _replays[key] = Replay({base64.b64decode(a): int(b) for a, b in map(bytes.split, source.splitlines())})
    return _replays[key]


def _parts(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    """Begin and end of stretches of about CHUNK code points."""
    begin, size = 0, 0
    for k, t in enumerate(texts):
        size += len(t or "")
        if size >= CHUNK:
            yield begin, k + 1
            begin, size = k + 1, 0
    if begin < len(texts):
        yield begin, len(texts)


def chunks(df: DataFrame, key: str, text: str) -> DataFrame:
    """(chunk, keys, counts, places, words): the rows in chunks of about CHUNK code points.

    `words` are the distinct words of a chunk, `places` the word at each place of its texts one after
    another, `counts` the number of places of each row. The number of a chunk is that of its partition and
    a serial number, so a task that runs again gives the same.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for begin, end in _parts(texts):
                code: dict[str, int] = {}
                counts, places = [], []
                for t in texts[begin:end]:
                    found = _split.findall(t) if t else []
                    counts.append(len(found))
                    places += [code.setdefault(w, len(code)) for w in found]
                one = lambda x, kind: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), pa.array(x, kind))
                keys = batch.column(0).slice(begin, end - begin)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([number], pa.int64()), pa.ListArray.from_arrays(pa.array([0, len(keys)], pa.int32()), keys), one(counts, pa.int32()), one(places, pa.int32()), one(list(code), pa.string())],
                    ["chunk", "keys", "counts", "places", "words"],
                )
                number += 1

    kind = df.schema[key].dataType.simpleString()
    return df.selectExpr(f"`{key}`", f"CAST(`{text}` AS STRING) AS text").mapInArrow(run, f"chunk long, keys array<{kind}>, counts array<int>, places array<int>, words array<string>")


def word_ids(words: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """(word, ids) of a table of distinct words: the replay of all merges over them, partition by partition."""
    source = vocabulary(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = replay(source)
        for batch in batches:
            offsets, ids = bpe.run([w.encode() for w in batch.column(0).to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids))], ["word", "ids"])

    return words.select("word").mapInArrow(run, "word string, ids array<int>")


def encode_corpus(df: DataFrame, key: str = "doc_id", text: str = "text", path: str = VOCABULARY) -> DataFrame:
    """(key, ids) of every row: the token ids of its whole text, without special tokens.

    Null and empty texts have the empty list; strings of special tokens are ordinary text; repeated
    rows give repeated rows. Each distinct word of the corpus is replayed once; its ids are joined to the
    chunks that hold it, so what is shuffled are the distinct words of chunks, not the places.
    """
    parted = cut(chunks(df, key, text), "chunks")
    codes = cut(word_ids(parted.select(F.explode("words").alias("word")).distinct(), path), "codes")
    held = parted.select("chunk", F.posexplode("words").alias("pos", "word")).join(codes, "word").groupBy("chunk").agg(F.collect_list(F.struct("pos", "ids")).alias("coded"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, counts, places, coded = (batch.column(k) for k in range(4))
            for r in range(batch.num_rows):
                entries = coded[r].values
                n = len(entries) if entries is not None else 0
                start, flat, size = np.zeros(n, np.int64), np.zeros(0, np.int32), np.zeros(n, np.int64)
                if n:
                    pos, lists = entries.field(0).to_numpy(), entries.field(1)
                    flat, size[pos] = lists.flatten().to_numpy(), lists.value_lengths().to_numpy()
                    start[pos] = np.cumsum(size[pos]) - size[pos]
                at = places[r].values.to_numpy()
                length = size[at]
                total = np.concatenate([[0], np.cumsum(length)])
                ids = flat[np.repeat(start[at] - total[:-1], length) + np.arange(total[-1])]
                ends = total[np.concatenate([[0], np.cumsum(counts[r].values.to_numpy())]).astype(np.int64)]
                yield pa.RecordBatch.from_arrays([keys[r].values, pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(ids, pa.int32()))], [key, "ids"])

    kind = df.schema[key].dataType.simpleString()
    return parted.drop("words").join(held, "chunk", "left").select("keys", "counts", "places", "coded").mapInArrow(run, f"`{key}` {kind}, ids array<int>")


def token_counts(df: DataFrame, keep: list[str], text: str = "text", path: str = VOCABULARY) -> DataFrame:
    """(*keep, tokens) of every row; null and empty texts have 0 tokens."""
    source = vocabulary(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = replay(source)
        for batch in batches:
            words, counts = [], []
            for t in batch.column(len(keep)).to_pylist():
                found = _split.findall(t) if t else []
                counts.append(len(found))
                words += found
            if len(bpe.code) > KEPT:
                bpe._clear()
            codes = bpe.codes(words)
            total = np.concatenate([[0], np.cumsum(bpe.start[codes + 1] - bpe.start[codes])])
            ends = np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(k) for k in range(len(keep))] + [pa.array(np.diff(total[ends]))], [*keep, "tokens"])

    schema = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keep)
    return df.selectExpr(*[f"`{k}`" for k in keep], f"CAST(`{text}` AS STRING) AS _text").mapInArrow(run, f"{schema}, tokens long")
