"""Byte-level BPE encoding of a whole corpus by speculation and verification.

Words are split off by the vocabulary's pattern.  For each word not met before, greedy
longest match proposes tokens; a vectorised check then tests every adjacent pair of all
proposals at once: a sequence is the exact encoding if and only if no adjacent pair would have been
merged differently across its border.  Only words with a failing pair are merged exactly.

Lines repeat from revision to revision, so encoded lines and words are kept in bounded
memories; both only save work and never change a result.
"""

from __future__ import annotations

import heapq
import json
import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TOKENIZER_DIR = "/opt/tokenizers"

# Unicode White_Space, and the pattern that splits text before the merges.
WHITE = r"\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

_WHITE_CHARS = frozenset(chr(c) for c in [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000])
#: Bounds of a worker's memories of words and of lines (entries, characters).
WORD_MEMORY, LINE_MEMORY_CHARS = 400_000, 16_000_000


def _byte_of_char() -> dict[str, int]:
    """The printable stand-ins of bytes in the vocabulary file."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    table = {chr(b): b for b in shown}
    table.update({chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(shown))})
    return table


class ByteBPE:
    """A byte-level BPE vocabulary with its merges."""

    def __init__(self, path: str):
        import re

        import regex

        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        plain = _byte_of_char()
        text_id = model["vocab"]
        self.ids = {bytes(plain[c] for c in t): i for t, i in text_id.items() if all(c in plain for c in t)}
        n = max(text_id.values()) + 1
        self.left, self.right = np.arange(n, dtype=np.int64), np.arange(n, dtype=np.int64)
        self.rank = np.full(n, -1, dtype=np.int64)  # of the merge that makes a token; bytes have -1
        self.merge: dict[tuple[int, int], int] = {}
        for r, pair in enumerate(model["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            i, j, k = text_id[a], text_id[b], text_id[a + b]
            self.merge[i, j] = k
            self.left[k], self.right[k], self.rank[k] = i, j, r
        self.byte_id = [self.ids[bytes([b])] for b in range(256)]
        keys = np.fromiter((i * n + j for i, j in self.merge), np.int64, len(self.merge))
        order = np.argsort(keys)
        self.n, self.pair_keys = n, keys[order]
        self.pair_rank = self.rank[np.fromiter(self.merge.values(), np.int64, len(keys))[order]]
        self.longest = max(map(len, self.ids))
        white = f"[{WHITE}]"
        self.find = regex.compile(PATTERN.replace(r"[^\s", f"[^{WHITE}").replace(r"\S", f"[^{WHITE}]").replace(r"\s", white)).findall
        ascii_white = "\t\n\x0b\x0c\r "
        self.find_ascii = re.compile(
            rf"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^{ascii_white}A-Za-z0-9]+|[{ascii_white}]+(?![^{ascii_white}])|[{ascii_white}]+"
        ).findall
        self.words: dict[str, list[int]] = {}
        self.lines: dict[str, np.ndarray] = {}
        self.line_chars = 0
        self.proposed = self.failed = 0

    def propose(self, word: bytes) -> list[int]:
        """Greedy longest match."""
        ids, get, at, n = [], self.ids.get, 0, len(word)
        while at < n:
            for end in range(min(n, at + self.longest), at, -1):
                t = get(word[at:end])
                if t is not None:
                    ids.append(t)
                    at = end
                    break
        return ids

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """For each pair of tokens, whether the exact merging of both tokens' bytes leaves them as they are.

        Both tokens are unmerged step by step, the later merge first; the pair fails when tokens
        that face each other across the border would have merged before the merge just undone.
        """
        a, b = a.astype(np.int64).copy(), b.astype(np.int64).copy()
        before = np.full(len(a), np.iinfo(np.int64).max)
        good, live = np.ones(len(a), bool), np.arange(len(a))
        while len(live):
            x, y = a[live], b[live]
            keys = x * self.n + y
            at = np.minimum(np.searchsorted(self.pair_keys, keys), len(self.pair_keys) - 1)
            bad = (self.pair_keys[at] == keys) & (self.pair_rank[at] < before[live])
            good[live[bad]] = False
            rx, ry = self.rank[x], self.rank[y]
            stop = bad | ((rx < 0) & (ry < 0))
            undo_left = rx > ry  # of equal tokens the right one is undone first: the left one merged earlier
            limit = np.where(undo_left, rx, ry + 1)
            a[live] = np.where(undo_left, self.right[x], x)
            b[live] = np.where(undo_left, y, self.left[y])
            before[live] = limit
            live = live[~stop]
        return good

    def exact(self, word: bytes) -> list[int]:
        """Merges in the order of their ranks, the leftmost first."""
        ids = [self.byte_id[b] for b in word]
        n = len(ids)
        after, prior = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(int(self.rank[k]), i, ids[i], ids[i + 1]) for i in range(n - 1) if (k := self.merge.get((ids[i], ids[i + 1]))) is not None]
        heapq.heapify(heap)
        alive = [True] * n
        while heap:
            _, i, x, y = heapq.heappop(heap)
            j = after[i]
            if not alive[i] or j >= n or ids[i] != x or ids[j] != y:
                continue
            ids[i] = self.merge[x, y]
            alive[j] = False
            after[i] = after[j]
            if after[i] < n:
                prior[after[i]] = i
            for p, q in ((prior[i], i), (i, after[i])):
                if p >= 0 and q < n and (k := self.merge.get((ids[p], ids[q]))) is not None:
                    heapq.heappush(heap, (int(self.rank[k]), p, ids[p], ids[q]))
        return [t for t, a in zip(ids, alive) if a]

    def learn(self, words: set[str]) -> None:
        """Encode new words: propose, verify all adjacent pairs at once, merge the failing words exactly."""
        todo = list(words)
        raw = [w.encode() for w in todo]
        guess = [self.propose(w) for w in raw]
        sizes = np.fromiter(map(len, guess), np.int64, len(guess))
        flat = np.fromiter((t for g in guess for t in g), np.int64, int(sizes.sum()))
        owner = np.repeat(np.arange(len(guess)), sizes)
        inside = owner[1:] == owner[:-1]
        x, y, of = flat[:-1][inside], flat[1:][inside], owner[:-1][inside]
        pairs, back = np.unique(x * self.n + y, return_inverse=True)
        ok = self.compatible(pairs // self.n, pairs % self.n)[back] if len(pairs) else np.zeros(0, bool)
        failing = np.unique(of[~ok])
        self.proposed += len(todo)
        self.failed += len(failing)
        for i in failing.tolist():
            guess[i] = self.exact(raw[i])
        self.words.update(zip(todo, guess))

    @staticmethod
    def split_lines(text: str) -> list[str]:
        """The text cut before line ends that follow a visible character; no word of the pattern crosses such a place."""
        parts = text.split("\n")
        out, cur = [], parts[0]
        for p in parts[1:]:
            if cur and cur[-1] not in _WHITE_CHARS:
                out.append(cur)
                cur = "\n" + p
            else:
                cur = f"{cur}\n{p}"
        out.append(cur)
        return out

    def encode_batch(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of all texts, and the offsets of each text. NULL and empty texts have no ids."""
        if len(self.words) > WORD_MEMORY:
            self.words.clear()
            self.lines.clear()
            self.line_chars = 0
        if self.line_chars > LINE_MEMORY_CHARS:
            self.lines.clear()
            self.line_chars = 0
        lines, words = self.lines, self.words
        split = [self.split_lines(t) if t else () for t in texts]
        fresh = {s for parts in split for s in parts if s not in lines}
        found = {s: (self.find_ascii(s) if s.isascii() else self.find(s)) for s in fresh}
        unknown = {w for ws in found.values() for w in ws if w not in words}
        if unknown:
            self.learn(unknown)
        for s, ws in found.items():
            ids: list[int] = []
            for w in ws:
                ids += words[w]
            lines[s] = np.array(ids, dtype=np.int32)
            self.line_chars += len(s) + 50
        pieces = [lines[s] for parts in split for s in parts]
        flat = np.concatenate(pieces) if pieces else np.zeros(0, np.int32)
        size = np.fromiter((sum(len(lines[s]) for s in parts) for parts in split), np.int64, len(split))
        return flat, np.concatenate([[0], np.cumsum(size)]).astype(np.int32)


class LibraryTokenizer:
    """Any other public tokenizer, encoded by the library that its file belongs to."""

    def __init__(self, path: str):
        if path.endswith(".json"):
            from tokenizers import Tokenizer

            t = Tokenizer.from_file(path)
            t.encode_special_tokens = True  # their strings in a text are ordinary text
            self.run = lambda texts: [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]
        elif path.endswith(".tiktoken"):
            import base64

            import tiktoken

            with open(path, "rb") as f:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            own = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
            self.run = lambda texts: [own.encode_ordinary(t) for t in texts]
        else:
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=path)
            self.run = lambda texts: model.encode(texts, num_threads=1)

    def encode_batch(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of all texts, and the offsets of each text. NULL and empty texts have no ids."""
        full = [t for t in texts if t]
        found = iter(self.run(full) if full else [])
        ids = [next(found) if t else [] for t in texts]
        size = np.fromiter(map(len, ids), np.int64, len(ids))
        flat = np.fromiter((i for x in ids for i in x), np.int32, int(size.sum()))
        return flat, np.concatenate([[0], np.cumsum(size)]).astype(np.int32)


def _is_byte_level(path: str) -> bool:
    with open(path, encoding="utf-8") as f:
        t = json.load(f)
    split = t.get("pre_tokenizer") or {}
    return t["model"].get("type") == "BPE" and not t.get("normalizer") and split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space")


SUFFIXES = (".json", ".tiktoken", ".model")


def ship(spark: SparkSession, name: str, folder: str) -> None:
    """Send a tokenizer's file along to the executors of other machines, which may not have the folder; the file stays where it is."""
    if spark.sparkContext.master.startswith("local"):
        return
    for suffix in SUFFIXES:
        path = os.path.join(folder, name + suffix)
        if os.path.exists(path):
            spark.sparkContext.addFile(path)
            return


@lru_cache(maxsize=4)
def vocabulary(name: str, folder: str = TOKENIZER_DIR) -> ByteBPE | LibraryTokenizer:
    """The tokenizer of that name, once per worker: byte-level BPE by speculation, any other by its library; from the folder, or as it was sent along."""
    for suffix in SUFFIXES:
        for path in (os.path.join(folder, name + suffix), SparkFiles.get(name + suffix) if SparkFiles._is_running_on_worker else None):
            if path and os.path.exists(path):
                return ByteBPE(path) if suffix == ".json" and _is_byte_level(path) else LibraryTokenizer(path)
    raise FileNotFoundError(f"no tokenizer {name} in {folder}")


def _batches(batches: Iterator[pa.RecordBatch], name: str, folder: str, rows: int = 1000):
    bpe = vocabulary(name, folder)
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            part = batch.slice(at, rows)
            yield part.column(0), bpe.encode_batch(part.column(1).to_pylist())


def encode(df: DataFrame, row_id: str, text: str, tokenizer: str = "byte_bpe_50k", folder: str = TOKENIZER_DIR) -> DataFrame:
    """``row_id, ids``: the token ids of every text, without special tokens.

    Empty and NULL texts have the ids ``[]``.  Whole texts of any length are encoded; strings of
    special tokens in a text are ordinary text.  Repeated rows are encoded each.  Other columns are ignored.
    """
    kind = df.schema[row_id].dataType
    ship(df.sparkSession, tokenizer, folder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, (flat, offsets) in _batches(batches, tokenizer, folder):
            ids = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat, pa.int32()))
            yield pa.RecordBatch.from_arrays([key, ids], ["id", "ids"])

    out = df.select(F.col(row_id).alias("id"), F.col(text).cast("string").alias("text")).mapInArrow(run, f"id {kind.simpleString()}, ids array<int>")
    return out.withColumnRenamed("id", row_id)


def token_counts(df: DataFrame, row_id: str, text: str, tokenizer: str = "byte_bpe_50k", folder: str = TOKENIZER_DIR) -> DataFrame:
    """``row_id, n_tokens``: 0 for empty and NULL texts."""
    kind = df.schema[row_id].dataType
    ship(df.sparkSession, tokenizer, folder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, (_, offsets) in _batches(batches, tokenizer, folder):
            yield pa.RecordBatch.from_arrays([key, pa.array(np.diff(offsets), pa.int32())], ["id", "n_tokens"])

    out = df.select(F.col(row_id).alias("id"), F.col(text).cast("string").alias("text")).mapInArrow(run, f"id {kind.simpleString()}, n_tokens int")
    return out.withColumnRenamed("id", row_id)
