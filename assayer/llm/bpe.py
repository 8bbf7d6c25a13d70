"""Byte-level BPE encoding and decoding by a pair occurrence index.

Texts are cut into words by the published pattern of byte-level BPE. All distinct words
of a chunk of documents are laid out in one array of symbols, and an index maps each
rank of the merge list to the positions of its pair in that array. The active ranks are
taken from a heap in ascending order; all positions of a pair are merged at once, and the
pairs that the merge creates are put in the index under their own ranks. As a created
pair always has a higher rank than its maker, each rank is applied once, and the result
is that of merging every word by its lowest rank again and again.

Every document stays in the task that reads it: there is no shuffle, a lost task is just
run again, and memory is bounded by the chunk (CHUNK_BYTES, or one text if longer).

Defined cases: a null text is the empty text, which has no ids; the special token's
string inside a text becomes the special id, as the tokenizers library does by default;
equal rows get equal results, one each; an empty table gives no rows; all other columns
are carried along, but one with a result's name gives way to it.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from .shared import chunks

#: The published pre-tokenisation pattern of byte-level BPE.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
CHUNK_BYTES = 2_000_000
#: A tokenizer file of more bytes is refused, as it is sent to every executor.
MAX_TOKENIZER_BYTES = 64_000_000


def byte_letters() -> dict[int, str]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    shown = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


class Tokenizer:
    """Tables of a byte-level BPE tokenizer file."""

    def __init__(self, file: str):
        spec = json.loads(file)
        vocab = spec["model"]["vocab"]
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in spec["model"]["merges"]]
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.size = max([*vocab.values(), *self.special.values()]) + 1
        letters = byte_letters()
        self.of_byte = np.array([vocab[letters[b]] for b in range(256)], np.int32)
        pairs = np.array([vocab[a] * self.size + vocab[b] for a, b in merges], np.int64)
        order = np.argsort(pairs, kind="stable")
        self.pairs, self.pair_ranks = pairs[order], order.astype(np.int64)
        self.left = np.array([vocab[a] for a, _ in merges], np.int32)
        self.right = np.array([vocab[b] for _, b in merges], np.int32)
        self.made = np.array([vocab[a + b] for a, b in merges], np.int32)
        back = {c: b for b, c in letters.items()}
        content = [b""] * self.size
        for token, i in vocab.items():
            content[i] = bytes(back[c] for c in token)
        for token, i in self.special.items():
            content[i] = token.encode()
        self.lengths = np.array([len(c) for c in content], np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.content = np.frombuffer(b"".join(content), np.uint8)
        self.pattern = regex.compile(PATTERN)
        self.split = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None

    def ranks(self, pairs: np.ndarray) -> np.ndarray:
        """The rank of each pair, -1 where it is none."""
        at = np.minimum(np.searchsorted(self.pairs, pairs), len(self.pairs) - 1)
        return np.where(self.pairs[at] == pairs, self.pair_ranks[at], -1)

    def encode_words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words, one after the other, and the number of ids of each word."""
        sizes = np.array([len(w) for w in words], np.int64)
        symbols = self.of_byte[np.frombuffer(b"".join(words), np.uint8)]
        n = len(symbols)
        if not n or not len(self.pairs):
            return symbols, sizes
        ends = np.cumsum(sizes)
        after = np.arange(1, n + 1, dtype=np.int32)
        after[ends[sizes > 0] - 1] = -1
        before = np.arange(-1, n - 1, dtype=np.int32)
        before[(ends - sizes)[sizes > 0]] = -1
        index: dict[int, list[np.ndarray]] = {}
        heap: list[int] = []

        def put(at: np.ndarray) -> None:
            """Index the pairs that begin at these positions."""
            ranks = self.ranks(symbols[at].astype(np.int64) * self.size + symbols[after[at]])
            at, ranks = at[ranks >= 0], ranks[ranks >= 0]
            if not len(at):
                return
            order = np.argsort(ranks, kind="stable")
            at, ranks = at[order], ranks[order]
            cuts = np.flatnonzero(np.diff(ranks)) + 1
            for rank, part in zip(ranks[np.concatenate(([0], cuts))].tolist(), np.split(at, cuts), strict=True):
                if rank in index:
                    index[rank].append(part)
                else:
                    index[rank] = [part]
                    heapq.heappush(heap, rank)

        put(np.flatnonzero(after >= 0).astype(np.int32))
        while heap:
            rank = heapq.heappop(heap)
            parts = index.pop(rank)
            left, right = self.left[rank], self.right[rank]
            at = np.unique(np.concatenate(parts)) if len(parts) > 1 else parts[0]
            at = at[(symbols[at] == left) & (after[at] >= 0)]
            at = at[symbols[after[at]] == right]
            if left == right and len(at) > 1:
                # Of a run of overlapping pairs every second one is merged, from the left.
                new_run = np.concatenate(([True], after[at[:-1]] != at[1:]))
                place = np.arange(len(at)) - np.maximum.accumulate(np.where(new_run, np.arange(len(at)), 0))
                at = at[place % 2 == 0]
            if not len(at):
                continue
            gone = after[at]
            nxt = after[gone]
            symbols[at], symbols[gone] = self.made[rank], -1
            after[at] = nxt
            before[nxt[nxt >= 0]] = at[nxt >= 0]
            prev = before[at]
            put(np.concatenate((prev[prev >= 0], at[nxt >= 0])))
        alive = symbols >= 0
        word_of = np.repeat(np.arange(len(words)), sizes)
        return symbols[alive], np.bincount(word_of[alive], minlength=len(words))

    def decode(self, ids: np.ndarray) -> bytes:
        """UTF-8 of the decoded text; malformed bytes become U+FFFD."""
        raw = gathered(self.content, self.starts[ids], self.lengths[ids]).tobytes()
        try:
            raw.decode()
        except UnicodeDecodeError:
            return raw.decode(errors="replace").encode()
        return raw


def gathered(flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The slices of flat that begin at starts, one after the other."""
    total = int(lengths.sum())
    return flat[np.repeat(starts - (np.cumsum(lengths) - lengths), lengths) + np.arange(total)]


class _Words(dict):
    """Numbers words in order of first sight."""

    def __missing__(self, word):
        self[word] = n = len(self)
        return n


def encode_texts(tokenizer: Tokenizer, texts: list[str | None]) -> Iterator[np.ndarray]:
    """The ids of each text; the distinct words of all texts are merged together."""
    words = _Words()
    specials = list(tokenizer.special)
    for s in specials:
        words[(s,)] = len(words)
    per_text = []
    for text in texts:
        found: list = []
        pieces = [text or ""] if not specials or not text or not any(s in text for s in specials) else tokenizer.split.split(text)
        for piece in pieces:
            if piece in tokenizer.special:
                found.append((piece,))
            elif piece:
                found += tokenizer.pattern.findall(piece)
        per_text.append(np.fromiter(map(words.__getitem__, found), np.int32, len(found)))
    plain = [w.encode() for w in list(words)[len(specials) :]]
    flat, counts = tokenizer.encode_words(plain)
    flat = np.concatenate((np.array([tokenizer.special[s] for s in specials], np.int32), flat))
    counts = np.concatenate((np.ones(len(specials), np.int64), counts))
    starts = np.cumsum(counts) - counts
    for at in per_text:
        yield gathered(flat, starts[at], counts[at])


def read_tokenizer(path: str) -> str:
    with open(path, encoding="utf-8") as f:
        file = f.read(MAX_TOKENIZER_BYTES + 1)
    if len(file) > MAX_TOKENIZER_BYTES:
        raise ValueError(f"{path} is larger than {MAX_TOKENIZER_BYTES} bytes")
    return file


def _mapped(df: DataFrame, text: str, tokenizer_path: str, added: dict[str, tuple[T.DataType, pa.DataType]], row) -> DataFrame:
    """df with the columns `added`, of which row(tokenizer, ids) gives the values."""
    df = df.select(*[c for c in df.columns if c not in added])
    file = df.sparkSession.sparkContext.broadcast(read_tokenizer(tokenizer_path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = None
        for table in chunks(batches, text, CHUNK_BYTES):
            tokenizer = tokenizer or Tokenizer(file.value)
            rows = [row(tokenizer, ids) for ids in encode_texts(tokenizer, table.column(text).to_pylist())]
            for i, (name, (_, arrow)) in enumerate(added.items()):
                table = table.append_column(name, pa.array([r[i] for r in rows], arrow))
            yield from table.to_batches()

    return df.mapInArrow(run, T.StructType([*df.schema.fields, *(T.StructField(name, kind) for name, (kind, _) in added.items())]))


def encoded(df: DataFrame, text: str, tokenizer_path: str) -> DataFrame:
    """df with `ids`, and `decoded` from them."""
    added = {"ids": (T.ArrayType(T.IntegerType()), pa.list_(pa.int32())), "decoded": (T.StringType(), pa.string())}
    return _mapped(df, text, tokenizer_path, added, lambda t, ids: (ids, t.decode(ids).decode()))


def digested(df: DataFrame, text: str, tokenizer_path: str) -> DataFrame:
    """df with the number of ids, and SHA-256 of the ids and of the text decoded from them."""
    added = {"n_tokens": (T.LongType(), pa.int64()), "ids_sha256": (T.StringType(), pa.string()), "decoded_sha256": (T.StringType(), pa.string())}
    return _mapped(df, text, tokenizer_path, added, lambda t, ids: (len(ids), hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest(), hashlib.sha256(t.decode(ids)).hexdigest()))


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return digested(docs, "text", default_tokenizer()).drop("text")
