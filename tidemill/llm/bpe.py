"""Byte-level BPE of a whole corpus: speculate, verify, merge only what fails.

1. Speculate: every word is cut by greedy longest match against the vocabulary, many words side by side.
2. Verify: a cut is the true encoding exactly if every adjacent pair of its tokens is compatible, that is, if merging the
   bytes of the two tokens by themselves gives the same two tokens back.  All pairs of a batch are looked up at once;
   the verdict of a pair not met before is worked out once and kept.  A word that is a token as a whole has no pair and is
   taken as it is, which is the tokenizer's own rule for words of its vocabulary.
3. Merge: only words with an incompatible pair go through the exact merging of BPE.

Defined results: an empty text and a null text both have the empty list of ids; the strings of special tokens are
ordinary text; a text is never cut off.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

#: Words above this many bytes are cut one at a time, so that one giant word does not hold up its neighbours.
LONG_WORD = 512
#: A worker forgets its words and pairs when it holds this many; a bound on memory, without influence on results.
MEMORY = 400_000
#: Texts are handled in slices of about this many characters.
SLICE = 1_000_000


def default_vocabulary() -> str:
    """Path of the 50k byte-level vocabulary of the installed public tokenizers."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def default_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


class Encoder:
    def __init__(self, vocabulary: str, pattern: str) -> None:
        with open(vocabulary, "rb") as lines:
            self.ranks = {base64.b64decode(t): int(i) for t, i in map(bytes.split, lines)}
        self.split = regex.compile(pattern).findall
        size = max(self.ranks.values()) + 1
        self.bytes_of: list[bytes] = [b""] * size
        for token, number in self.ranks.items():
            self.bytes_of[number] = token
        self.byte_id = np.array([self.ranks[bytes([b])] for b in range(256)], dtype=np.int32)
        self._build_trie(size)
        self.forget()

    def _build_trie(self, size: int) -> None:
        edges: dict[int, int] = {}
        token_at = [-1]
        for token, number in self.ranks.items():
            node = 0
            for byte in token:
                key = node << 8 | byte
                node = edges.get(key, -1)
                if node < 0:
                    node = edges[key] = len(token_at)
                    token_at.append(-1)
            token_at[node] = number
        self.edges, self.token_at = edges, np.array(token_at, dtype=np.int32)
        keys = np.fromiter(edges, dtype=np.int64, count=len(edges))
        order = np.argsort(keys)
        self.edge_keys, self.edge_to = keys[order], np.fromiter(edges.values(), dtype=np.int64, count=len(edges))[order]
        # the first level is a table, as every token starts there
        self.first = np.full(256, -1, dtype=np.int64)
        for byte in range(256):
            self.first[byte] = edges.get(byte, -1)
        self.size = size

    def forget(self) -> None:
        self.code: dict[str, int] = {}
        self.starts = np.zeros(1, dtype=np.int64)
        self.ids = np.zeros(0, dtype=np.int32)
        self.pairs = np.zeros(0, dtype=np.int64)
        self.fits = np.zeros(0, dtype=bool)

    # exact merging

    def merge(self, word: bytes) -> list[int]:
        """The definition of BPE: always merge the adjacent pair whose union has the lowest rank, leftmost first."""
        ranks, n = self.ranks, len(word)
        if n == 1:
            return [ranks[word]]
        right, left = list(range(1, n + 1)), list(range(-1, n - 1))
        end = list(range(1, n + 1))  # where the piece that starts here ends; 0 when swallowed
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(word[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, stop = heapq.heappop(heap)
            j = right[i]
            if not end[i] or j >= n or end[j] != stop or end[i] != j:
                continue
            end[i], end[j] = stop, 0
            right[i] = k = right[j]
            if k < n:
                left[k] = i
                if (r := ranks.get(word[i : end[k]])) is not None:
                    heapq.heappush(heap, (r, i, end[k]))
            if (h := left[i]) >= 0 and (r := ranks.get(word[h:stop])) is not None:
                heapq.heappush(heap, (r, h, stop))
        out, i = [], 0
        while i < n:
            out.append(ranks[word[i : end[i]]])
            i = end[i]
        return out

    # speculation

    def _greedy_one(self, word: bytes) -> list[int]:
        edges, token_at, out, at, n = self.edges, self.token_at, [], 0, len(word)
        while at < n:
            node, best, stop = 0, -1, at
            for i in range(at, n):
                node = edges.get(node << 8 | word[i], -1)
                if node < 0:
                    break
                if token_at[node] >= 0:
                    best, stop = int(token_at[node]), i + 1
            out.append(best)
            at = stop
        return out

    def _greedy(self, data: np.ndarray, start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(word number, token) of every speculated token, in order; all words advance together, a token a round."""
        words, at = np.arange(len(start)), start.copy()
        found: list[tuple[np.ndarray, np.ndarray]] = []
        while len(words):
            node = self.first[data[at]]
            best, best_end = self.token_at[node].copy(), at + 1
            live, pos = np.arange(len(words)), at + 1
            while True:
                ok = pos < stop[words[live]]
                live, node, pos = live[ok], node[ok], pos[ok]
                if not len(live):
                    break
                key = node << 8 | data[pos]
                slot = np.searchsorted(self.edge_keys, key)
                slot[slot == len(self.edge_keys)] = 0
                ok = self.edge_keys[slot] == key
                live, node, pos = live[ok], self.edge_to[slot[ok]], pos[ok] + 1
                if not len(live):
                    break
                token = self.token_at[node]
                hit = token >= 0
                best[live[hit]], best_end[live[hit]] = token[hit], pos[hit]
            found.append((words, best))
            more = best_end < stop[words]
            words, at = words[more], best_end[more]
        who, what = np.concatenate([w for w, _ in found]), np.concatenate([t for _, t in found])
        order = np.argsort(who, kind="stable")
        return who[order], what[order]

    # verification

    def compatible(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Whether each pair of tokens stays as it is when its bytes are merged by themselves."""
        asked, back = np.unique(left.astype(np.int64) * self.size + right, return_inverse=True)
        slot = np.searchsorted(self.pairs, asked)
        known = slot < len(self.pairs)
        known[known] = self.pairs[slot[known]] == asked[known]
        fresh = asked[~known]
        if len(fresh):
            text, size = self.bytes_of, self.size
            fits = np.array([self.merge(text[p // size] + text[p % size]) == [p // size, p % size] for p in fresh.tolist()])
            pairs = np.concatenate([self.pairs, fresh])
            order = np.argsort(pairs)
            self.pairs, self.fits = pairs[order], np.concatenate([self.fits, fits])[order]
            slot = np.searchsorted(self.pairs, asked)
        return self.fits[slot][back]

    def _learn(self, words: list[str]) -> None:
        """Encode words not met before and append them to the memory, in order."""
        raw = [w.encode("utf-8", "surrogatepass") for w in words]
        out: list = [None] * len(raw)
        short = [i for i, w in enumerate(raw) if len(w) <= LONG_WORD]
        who, what = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int32)
        if short:
            lengths = np.array([len(raw[i]) for i in short])
            stop = np.cumsum(lengths)
            who, what = self._greedy(np.frombuffer(b"".join(raw[i] for i in short), dtype=np.uint8).astype(np.int64), stop - lengths, stop)
            who = np.array(short)[who]
        for i, w in enumerate(raw):
            if len(w) > LONG_WORD:
                cut = self._greedy_one(w)
                who, what = np.concatenate([who, np.full(len(cut), i)]), np.concatenate([what, np.array(cut, dtype=np.int32)])
        order = np.argsort(who, kind="stable")
        who, what = who[order], what[order]
        inner = who[1:] == who[:-1]
        bad = np.zeros(len(raw), dtype=bool)
        if inner.any():
            fits = self.compatible(what[:-1][inner], what[1:][inner])
            bad[who[1:][inner][~fits]] = True
        count = np.bincount(who, minlength=len(raw))
        for i in np.nonzero(bad)[0]:
            out[i] = np.array(self.merge(raw[i]), dtype=np.int32)
        pieces = np.split(what, np.cumsum(count)[:-1])
        merged = [piece if out[i] is None else out[i] for i, piece in enumerate(pieces)]
        sizes = np.array([len(m) for m in merged])
        self.ids = np.concatenate([self.ids, *merged]).astype(np.int32)
        self.starts = np.concatenate([self.starts, self.starts[-1] + np.cumsum(sizes)])

    def _codes(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """The word numbers of all texts on end, and how many each text has."""
        if len(self.code) > MEMORY or len(self.pairs) > MEMORY * 4:
            self.forget()
        words: list[str] = []
        counts = np.zeros(len(texts), dtype=np.int64)
        for i, text in enumerate(texts):
            if text:
                before = len(words)
                words += self.split(text)
                counts[i] = len(words) - before
        fresh = [w for w in dict.fromkeys(words) if w not in self.code]
        if fresh:
            base = len(self.code)
            self._learn(fresh)
            self.code.update(zip(fresh, range(base, base + len(fresh))))
        return np.fromiter(map(self.code.__getitem__, words), dtype=np.int64, count=len(words)), counts

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(all ids on end, where each text's ids end)."""
        codes, counts = self._codes(texts)
        sizes = (self.starts[1:] - self.starts[:-1])[codes]
        ends = np.cumsum(sizes)
        total = int(ends[-1]) if len(ends) else 0
        where = np.repeat(self.starts[:-1][codes] - (ends - sizes), sizes) + np.arange(total)
        return self.ids[where], np.concatenate([[0], ends])[np.cumsum(counts)]

    def lengths(self, texts: list[str | None]) -> np.ndarray:
        """Number of ids of each text."""
        codes, counts = self._codes(texts)
        ends = np.concatenate([[0], np.cumsum((self.starts[1:] - self.starts[:-1])[codes])])
        at = np.cumsum(counts)
        return ends[at] - ends[at - counts]


_encoders: dict[tuple[str, str], Encoder] = {}


def encoder(vocabulary: str, pattern: str) -> Encoder:
    """One encoder per worker and vocabulary; it remembers words from batch to batch."""
    key = (vocabulary, pattern)
    if key not in _encoders:
        _encoders[key] = Encoder(vocabulary, pattern)
    return _encoders[key]


def slices(batch: pa.RecordBatch, column: str) -> Iterator[tuple[pa.RecordBatch, list[str | None]]]:
    """A batch in pieces of about SLICE characters, each with its texts."""
    texts, low, size = batch.column(column).to_pylist(), 0, 0
    for i, text in enumerate(texts):
        size += len(text or "")
        if size >= SLICE:
            yield batch.slice(low, i + 1 - low), texts[low : i + 1]
            low, size = i + 1, 0
    if low < len(texts):
        yield batch.slice(low), texts[low:]


def encode_corpus(docs: DataFrame, key: str, text: str, vocabulary: str | None = None, pattern: str | None = None) -> DataFrame:
    """``key`` and ``ids`` of every row of ``docs``, in one pass without a shuffle."""
    vocabulary, pattern = vocabulary or default_vocabulary(), pattern or default_pattern()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine = encoder(vocabulary, pattern)
        for batch in batches:
            for part, texts in slices(batch, text):
                ids, ends = mine.encode(texts)
                offsets = pa.array(np.concatenate([[0], ends]).astype(np.int32))
                yield pa.RecordBatch.from_arrays([part.column(key), pa.ListArray.from_arrays(offsets, pa.array(ids))], names=[key, "ids"])

    return docs.select(key, text).mapInArrow(run, f"{key} {dict(docs.dtypes)[key]}, ids array<int>")


def count_tokens(docs: DataFrame, key: str, text: str, vocabulary: str | None = None, pattern: str | None = None) -> DataFrame:
    """``key`` and ``tokens``, the length of the row's encoding."""
    vocabulary, pattern = vocabulary or default_vocabulary(), pattern or default_pattern()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine = encoder(vocabulary, pattern)
        for batch in batches:
            for part, texts in slices(batch, text):
                yield pa.RecordBatch.from_arrays([part.column(key), pa.array(mine.lengths(texts))], names=[key, "tokens"])

    return docs.select(key, text).mapInArrow(run, f"{key} {dict(docs.dtypes)[key]}, tokens bigint")
