"""Bytes that lie in a string of LEAST bytes which starts anywhere else too.

Every text is a string of UTF-8 bytes; a window is one of its strings of LEAST bytes. A byte
goes if some window over it begins at another place as well, of the same text or of another.

A shard is a block of some BLOCK_BYTES of texts. It finds the windows that repeat within it
by a suffix array (Larsson-Sadakane) and common prefixes (Kasai); shards are merged by binary
search: each sends its sorted strings, as digests, in slices to the owners of their ranges,
an owner looks each shard's slice up in the merge of all, and answers with one bit a string.

Neither suffixes nor digests of all bytes are affordable, so two rules settle most windows
beforehand, and lose nothing. Anchors: the least of the REACH grams of GRAM bytes in a window
is its anchor, the same in equal windows. A window whose anchor's gram is seen once in all
texts is seen once. Surroundings: the gram with all bytes that a window over it may have. If
they are seen twice, all windows over the anchor are; if a gram always has the same, nothing
about its windows is open. Of grams with several surroundings, the windows go into the suffix
arrays (of surroundings that are seen often, those of one shard), and one of each class that
these find is sent to be merged.

Anchors and windows go through the same exchange; a string that a shard holds many times is
sent once, with a mark, so a passage that all texts hold costs each owner a row a shard. Texts
that are equal within a block are looked at once. Texts are written to the shared checkpoint
folder once, compressed; no task holds more than a block, or an owner's share.

Windows have digests of 80 bits, surroundings of 112 with their gram: of 10^13 different
windows some 40 pairs would be taken for equal.

Defined cases: a null text is the empty text; texts of fewer than LEAST bytes lose nothing
and cannot repeat; rows are judged one by one, repeated rows (also with a null doc_id) are
different texts that are equal; an empty table gives no rows; a text longer than a block is
a block; columns besides the two named are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import chunks, settled
from .suffixes import common_prefixes, left_in_part, suffix_array

LEAST = 200
GRAM = 64
#: Grams that begin in a window.
REACH = LEAST - GRAM + 1
BLOCK_BYTES = 4_000_000
#: Bytes whose digests are worked out at a time.
STEP_BYTES = 200_000
#: Text for which there is one owner, at least.
OWNER_BYTES = 200_000_000
#: No byte of UTF-8; stands before, between and after texts.
PAD = b"\xff" * LEAST
TEXTS, STRINGS = 0, 1
_PLACE, _AROUND = np.uint64((1 << 31) - 1), np.uint64((1 << 48) - 1)
#: Bytes of the second part of strings: surroundings beside their gram, and more bits of windows.
OF_ANCHORS, OF_WINDOWS = 6, 2
_SCHEMA = "block long, kind int, owner int, payload binary"
_NAMES = ["block", "kind", "owner", "payload"]


def words_of(flat: np.ndarray) -> np.ndarray:
    """The eight bytes from each position on as one whole number that sorts as they do."""
    x = flat.astype(np.uint64)
    for bits in (8, 16, 32):
        x = (x[: -(bits // 8)] << np.uint64(bits)) | x[bits // 8 :]
    return x


def _mixed(a: np.ndarray, b: np.ndarray, salt: int) -> np.ndarray:
    h = a * np.uint64(0x9E3779B97F4A7C15 ^ salt)
    h ^= h >> np.uint64(29)
    h += b
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    return h


def grams_of(words: np.ndarray) -> np.ndarray:
    """Digests of the GRAM bytes from each position on, by doubling."""
    h, size = words, 8
    while size < GRAM:
        h = h[:-size] * np.uint64(0x9E3779B97F4A7C15 ^ size) + h[size:]
        h ^= h >> np.uint64(29)
        size *= 2
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    return h


def digests(grams: np.ndarray, at: np.ndarray, length: int, salt: int = 0) -> np.ndarray:
    """Digests of the `length` bytes from the positions `at` on, put together from their grams."""
    h = grams[at]
    for place in [*range(GRAM, length - GRAM, GRAM), length - GRAM]:
        h = _mixed(h, grams[at + place], salt + place)
    return h


def _sliding(best, values: np.ndarray, width: int) -> np.ndarray:
    """The least (or greatest) of the `width` values from each place on."""
    size = 1
    while size < width:
        step = min(size, width - size)
        values = best(values[:-step], values[step:])
        size += step
    return values


class Anchors(NamedTuple):
    """Positions, digests of grams and of surroundings, and the windows of each: where they begin, and how many."""

    at: np.ndarray
    grams: np.ndarray
    around: np.ndarray
    runs: np.ndarray
    lengths: np.ndarray


class Block:
    """Texts of LEAST bytes or more one after the other, with pads between them."""

    def __init__(self, texts: list[bytes]):
        self.sizes = np.array([len(t) for t in texts], np.int64)
        self.starts = np.cumsum(self.sizes + LEAST) - self.sizes
        self.flat = np.frombuffer(PAD + PAD.join(texts) + PAD, np.uint8)

    def steps(self) -> Iterator[tuple[int, int]]:
        """Ranges of texts of about STEP_BYTES."""
        first = 0
        while first < len(self.sizes):
            last = max(first + 1, int(np.searchsorted(self.starts, self.starts[first] + STEP_BYTES)))
            yield first, last
            first = last

    def anchors(self) -> Anchors:
        """Of each window the least gram, the first of several; one anchor has consecutive windows."""
        found = []
        window = self.windows()
        for a, b in self.steps():
            low, high = self.starts[a] - LEAST, self.starts[b - 1] + self.sizes[b - 1] + LEAST
            grams = grams_of(words_of(self.flat[low:high]))
            # By the upper bits of their digests, then by place.
            placed = (grams & ~_PLACE) | np.arange(len(grams), dtype=np.uint64)
            least = (_sliding(np.minimum, placed, REACH) & _PLACE).astype(np.int64)
            least[~window[low : low + len(least)]] = -1
            runs = np.flatnonzero(np.diff(least, prepend=-1))
            lengths = np.diff(np.append(runs, len(least)))
            runs, lengths = runs[least[runs] >= 0], lengths[least[runs] >= 0]
            at = least[runs]
            found.append((at + low, grams[at], digests(grams, at - (LEAST - GRAM), LEAST + LEAST - GRAM) & _AROUND, runs + low, lengths))
        kinds = (np.int64, np.uint64, np.uint64, np.int64, np.int64)
        return Anchors(*(np.concatenate(x) for x in zip(*found, strict=True))) if found else Anchors(*(np.zeros(0, k) for k in kinds))

    def windows(self) -> np.ndarray:
        """Whether a window begins at each position."""
        edges = np.zeros(len(self.flat) + 1, np.int8)
        edges[self.starts] += 1
        edges[self.starts + self.sizes - LEAST + 1] -= 1
        return np.cumsum(edges[:-1], dtype=np.int8) > 0

    def marked(self, anchors: Anchors, which: np.ndarray) -> np.ndarray:
        """Whether each position begins a window of one of these anchors."""
        edges = np.zeros(len(self.flat) + 1, np.int8)
        np.add.at(edges, anchors.runs[which], 1)
        np.add.at(edges, anchors.runs[which] + anchors.lengths[which], -1)
        return np.cumsum(edges[:-1], dtype=np.int8) > 0

    def over(self, at: np.ndarray) -> np.ndarray:
        """Whether a window that begins at each position has one of the grams at `at`."""
        n = len(self.flat)
        count = np.zeros(n + 1, np.int64)
        count[1:][at] = 1
        count = np.cumsum(count)
        return self.windows() & (count[np.minimum(np.arange(n) + REACH, n)] > count[:-1])


def local_classes(flat: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(positions, classes) of the windows that begin where it is marked; equal windows of the block have one class.

    The suffix array is over the stretches of bytes that these windows cover.
    """
    covered = np.zeros(len(flat) + LEAST, np.int64)
    covered[: len(flat)] += begins
    covered[LEAST:] -= begins
    at = np.flatnonzero(np.cumsum(covered[: len(flat)]) > 0)
    if not len(at):
        return at, at
    ends = np.append(np.flatnonzero(np.diff(at) > 1) + 1, len(at))
    # Each stretch with a pad behind it, so that no word reads into the next.
    part = np.repeat(np.arange(len(ends)), np.diff(ends, prepend=0))
    spread = np.full(len(at) + 8 * len(ends), 0xFF, np.uint8)
    place = np.arange(len(at)) + 8 * part
    spread[place] = flat[at]
    words = words_of(np.append(spread, np.full(8, 0xFF, np.uint8)))[place]
    left = left_in_part(ends, len(at))
    order, _ = suffix_array(words, left, span=8)
    # Words of a position's stretch follow each other in `at`, eight places on.
    same = common_prefixes(order, words, left, span=8, most=LEAST) >= LEAST
    own = np.cumsum(~same)
    wanted = begins[at[order]]
    return at[order][wanted], own[wanted]


def _planes(values: np.ndarray, width: int, size: int = 8) -> bytes:
    """The lower `width` bytes of whole numbers of `size` bytes, all of one place together."""
    return np.ascontiguousarray(values.view(np.uint8).reshape(-1, size)[:, :width].T).tobytes()


def _of_planes(raw: bytes, n: int, width: int, offset: int) -> np.ndarray:
    out = np.zeros((n, 8), np.uint8)
    out[:, :width] = np.frombuffer(raw, np.uint8, width * n, offset).reshape(width, n).T
    return out.reshape(-1).view(np.uint64)


def _pack(keys: np.ndarray, more: np.ndarray, twice: np.ndarray, width: int) -> bytes:
    """Sorted strings: 64 bits (as steps) and `width` bytes more of each, and whether the shard holds it more than once."""
    steps = np.diff(keys, prepend=np.uint64(0))
    return np.array([len(keys)], np.int64).tobytes() + zstandard.compress(_planes(steps, 8) + _planes(more, width) + np.packbits(twice).tobytes(), 1)


def _unpack(data: bytes, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n = int(np.frombuffer(data, np.int64, 1)[0])
    raw = zstandard.decompress(data[8:])
    keys = np.cumsum(_of_planes(raw, n, 8, 0), dtype=np.uint64)
    return keys, _of_planes(raw, n, width, 8 * n), np.unpackbits(np.frombuffer(raw, np.uint8, offset=(8 + width) * n), count=n).astype(bool)


def strings_of(keys: np.ndarray, more: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct strings in order (key, more, twice), and the place of each string among them."""
    order = np.argsort(keys)
    k = keys[order]
    equal = k[1:] == k[:-1]
    tied = np.flatnonzero(np.append(equal, False) | np.append(False, equal))
    order[tied] = order[tied][np.lexsort((more[order[tied]], k[tied]))]
    m = more[order]
    new = np.ones(len(k), bool)
    new[1:] = ~equal | (m[1:] != m[:-1])
    place = np.empty(len(k), np.int64)
    place[order] = np.cumsum(new) - 1
    return k[new], m[new], np.diff(np.append(np.flatnonzero(new), len(k))) > 1, place


def slices(keys: np.ndarray, owners: int) -> Iterator[tuple[int, slice]]:
    """The part of sorted keys that each owner's range holds."""
    bounds = [int(-(-(i << 64) // owners)) for i in range(1, owners)]
    cuts = np.searchsorted(keys, np.array(bounds, np.uint64)) if bounds else np.zeros(0, np.int64)
    for owner, (a, b) in enumerate(zip([0, *cuts.tolist()], [*cuts.tolist(), len(keys)], strict=True)):
        if b > a:
            yield owner, slice(a, b)


def _row(block: int, kind: int, owner: int, payload: bytes) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([kind], pa.int32()), pa.array([owner], pa.int32()), pa.array([payload], pa.binary())], _NAMES)


def _told(batches: Iterator[pa.RecordBatch], *columns: str) -> Iterator[tuple]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield tuple(batch.column(c)[i].as_py() for c in columns)


def windows_answer(keys: np.ndarray, more: np.ndarray, twice: np.ndarray) -> np.ndarray:
    """Of the strings of all shards, one shard after the other: whether each is held twice or more."""
    _, _, often, place = strings_of(keys, more)
    often[place[twice]] = True
    return often[place][None]


def anchors_answer(grams: np.ndarray, around: np.ndarray, twice: np.ndarray) -> np.ndarray:
    """Of the anchors of all shards: whether the gram is held twice or more with these
    surroundings, and whether its windows are to be sent.

    A gram that always has the same surroundings leaves nothing open. Otherwise windows of
    unique surroundings are sent, and of surroundings that are held more often those of the
    first shard, so that every open window meets its equals.
    """
    k, _, often, place = strings_of(grams, around)
    often[place[twice]] = True
    gram = np.cumsum(np.append(True, k[1:] != k[:-1])) - 1
    mixed = (np.bincount(gram) > 1)[gram]
    first = np.zeros(len(place), bool)
    first[np.unique(place, return_index=True)[1]] = True
    return np.stack([often[place], mixed[place] & (first | ~often[place])])


def exchanged(sent: DataFrame, answer, width: int) -> DataFrame:
    """Answers (block, STRINGS, owner, bits) to slices of strings (block, STRINGS, owner, payload)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for owner, rows in groupby(_told(batches, "owner", "block", "payload"), key=lambda r: r[0]):
            shards = [(block, *_unpack(payload, width)) for _, block, payload in rows]
            said = answer(*(np.concatenate([s[i] for s in shards]) for i in (1, 2, 3)))
            first = 0
            for block, own, _, _ in shards:
                yield _row(block, STRINGS, owner, np.packbits(said[:, first : first + len(own)], axis=None).tobytes())
                first += len(own)

    return sent.select("owner", "block", "payload").repartition("owner").sortWithinPartitions("owner", "block").mapInArrow(run, _SCHEMA)


def answered(sizes: np.ndarray, bits: dict[int, bytes], answers: int) -> np.ndarray:
    """What the owners said of a shard's sorted strings, of which each owns so many: a row for each answer."""
    out, first = np.zeros((answers, int(sizes.sum())), bool), 0
    for owner in np.flatnonzero(sizes).tolist():
        n = int(sizes[owner])
        out[:, first : first + n] = np.unpackbits(np.frombuffer(bits[owner], np.uint8), count=answers * n).reshape(answers, n)
        first += n
    return out


def sizes_of(keys: np.ndarray, owners: int) -> np.ndarray:
    out = np.zeros(owners, np.int64)
    for owner, part in slices(keys, owners):
        out[owner] = part.stop - part.start
    return out


class Stored:
    """A block's rows: ids, the distinct text of each, these texts; strings of anchors by owner, anchors by long text, and the string of each anchor."""

    ARRAYS = 5

    def __init__(self, ids: pa.Array, which: np.ndarray, texts: list[bytes]):
        self.ids, self.which, self.texts = ids, which, texts
        self.long = np.array([i for i, t in enumerate(texts) if len(t) >= LEAST], np.int64)
        self.several = np.bincount(which, minlength=len(texts))[self.long] > 1

    def strings(self, owners: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct strings of gram and surroundings (grams, around, twice)."""
        block = Block([self.texts[i] for i in self.long.tolist()])
        anchors = block.anchors()
        grams, around, twice, self.place = strings_of(anchors.grams, anchors.around)
        text = np.searchsorted(block.starts, anchors.at, side="right") - 1
        twice[self.place[self.several[text]]] = True
        self.counts, self.sizes = np.bincount(text, minlength=len(self.long)), sizes_of(grams, owners)
        return grams, around, twice

    def to_bytes(self) -> bytes:
        sink = pa.BufferOutputStream()
        table = pa.RecordBatch.from_arrays([self.ids], ["doc_id"])
        with pa.ipc.new_stream(sink, table.schema) as writer:
            writer.write_batch(table)
        arrays = [a.astype(np.int32) for a in (self.which, np.array([len(t) for t in self.texts]), self.sizes, self.counts, self.place)]
        heads = np.array([sink.tell(), *map(len, arrays)], np.int64)
        return heads.tobytes() + sink.getvalue().to_pybytes() + zstandard.compress(b"".join(_planes(a, 4, 4) for a in arrays) + b"".join(self.texts), 3)

    @staticmethod
    def of_bytes(data: bytes) -> Stored:
        at = 8 * (Stored.ARRAYS + 1)
        meta, *lengths = np.frombuffer(data, np.int64, Stored.ARRAYS + 1).tolist()
        ids = pa.ipc.open_stream(data[at : at + meta]).read_all().column("doc_id").combine_chunks()
        raw, at, arrays = zstandard.decompress(data[at + meta :]), 0, []
        for n in lengths:
            arrays.append(_of_planes(raw, n, 4, at).astype(np.int64))
            at += 4 * n
        which, sizes, *rest = arrays
        ends = (at + np.cumsum(sizes)).tolist()
        out = Stored(ids, which, [raw[a:b] for a, b in zip([at, *ends], ends, strict=False)])
        out.sizes, out.counts, out.place = rest
        return out


def window_strings(block: Block, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(key, more) of the windows at ascending positions."""
    keys, more = np.empty(len(at), np.uint64), np.empty(len(at), np.uint64)
    for a, b in block.steps():
        low, high = block.starts[a] - LEAST, block.starts[b - 1] + block.sizes[b - 1] + LEAST
        first, last = np.searchsorted(at, [low, high])
        if last > first:
            grams, own = grams_of(words_of(block.flat[low:high])), at[first:last] - low
            keys[first:last] = digests(grams, own, LEAST)
            more[first:last] = digests(grams, own, LEAST, 1) >> np.uint64(48)
    return keys, more


class Judged:
    """What a block knows once the owners have answered about its anchors: of the texts that have repeated anchors."""

    def __init__(self, stored: Stored, bits: dict[int, bytes]):
        around, send = answered(stored.sizes, bits, 2)[:, stored.place]
        text = np.repeat(np.arange(len(stored.long)), stored.counts)
        open_ = np.bincount(text[around | send], minlength=len(stored.long)) > 0
        self.long, several = stored.long[open_], stored.several[open_]
        self.block = Block([stored.texts[i] for i in self.long.tolist()])
        anchors = self.block.anchors()
        around, send = around[open_[text]], send[open_[text]]
        #: Windows that repeat as an anchor in them does with its surroundings.
        self.repeated = self.block.over(anchors.at[around])
        #: Windows whose equals, if any, are sent too.
        self.sent = np.flatnonzero(self.block.marked(anchors, np.flatnonzero(send)))
        #: Positions in texts of several rows.
        self.owned = np.append(np.zeros(LEAST, bool), np.repeat(several, self.block.sizes + LEAST)) if len(several) else np.zeros(len(self.block.flat), bool)

    def strings(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        return strings_of(*window_strings(self.block, self.sent))


def sent_windows(judged: Judged) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct windows to send (key, more, twice); by the suffix array, twice if the block holds their class more than once."""
    keys, more, _, place = judged.strings()
    twice = np.zeros(len(keys), bool)
    begins = np.zeros(len(judged.block.flat), bool)
    begins[judged.sent] = True
    at, own = local_classes(judged.block.flat, begins)
    if len(at):
        many = (np.bincount(own)[own] > 1) | judged.owned[at]
        twice[place[np.searchsorted(judged.sent, at[many])]] = True
    return keys, more, twice


def removed_of(judged: Judged, owners: int, bits: dict[int, bytes]) -> np.ndarray:
    """Whether each byte of a block goes."""
    keys, _, _, place = judged.strings()
    repeated = judged.repeated.copy()
    repeated[judged.sent[answered(sizes_of(keys, owners), bits, 1)[0][place]]] = True
    cover = np.zeros(len(repeated) + LEAST, np.int32)
    cover[: len(repeated)] += repeated
    cover[LEAST:] -= repeated
    return np.cumsum(cover[: len(repeated)]) > 0


_RESULT = ["doc_id", "n_bytes", "n_removed", "spans", "kept"]


def repeats(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_removed, spans, kept) of every row: removed runs (start, length) of bytes, and the bytes that stay."""
    spark = docs.sparkSession
    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(docs[key].alias("doc_id"), docs[text].alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    owners = max(int(spark.conf.get("spark.sql.shuffle.partitions")), size // OWNER_BYTES)

    def stored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        for number, table in enumerate(chunks(batches, "text", BLOCK_BYTES)):
            if not table.num_rows:
                continue
            which: dict[bytes, int] = {}
            own = np.array([which.setdefault((t or "").encode(), len(which)) for t in table.column("text").to_pylist()], np.int64)
            held = Stored(table.column("doc_id").combine_chunks(), own, list(which))
            block = (task << 32) + number
            keys, more, twice = held.strings(owners)
            yield _row(block, TEXTS, -1, held.to_bytes())
            for owner, part in slices(keys, owners):
                yield _row(block, STRINGS, owner, _pack(keys[part], more[part], twice[part], OF_ANCHORS))

    def by_block(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, Stored, list[dict[int, bytes]]]]:
        """(block, its texts, answers of each round); a block's texts come first."""
        for block, found in groupby(_told(batches, "block", "round", "owner", "payload"), key=lambda r: r[0]):
            held, answers = None, [{}, {}]
            for _, round_, owner, payload in found:
                if round_ < 0:
                    held = Stored.of_bytes(payload)
                else:
                    answers[round_][owner] = payload
            yield block, held, answers

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, held, answers in by_block(batches):
            keys, more, twice = sent_windows(Judged(held, answers[0]))
            for owner, part in slices(keys, owners):
                yield _row(block, STRINGS, owner, _pack(keys[part], more[part], twice[part], OF_WINDOWS))

    def cleaned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, held, answers in by_block(batches):
            judged = Judged(held, answers[0])
            gone = removed_of(judged, owners, answers[1])
            kept, spans = list(held.texts), [[] for _ in held.texts]
            for i, start, n in zip(judged.long.tolist(), judged.block.starts.tolist(), judged.block.sizes.tolist(), strict=True):
                own = gone[start : start + n]
                edges = np.flatnonzero(np.diff(own.astype(np.int8), prepend=0, append=0))
                if len(edges):
                    spans[i] = [{"start": a, "length": b - a} for a, b in edges.reshape(-1, 2).tolist()]
                    kept[i] = judged.block.flat[start : start + n][~own].tobytes()
            for first in range(0, len(held.which), 512):
                own = held.which[first : first + 512].tolist()
                yield pa.RecordBatch.from_arrays(
                    [
                        held.ids.slice(first, 512), pa.array([len(held.texts[i]) for i in own], pa.int64()), pa.array([len(held.texts[i]) - len(kept[i]) for i in own], pa.int64()),
                        pa.array([spans[i] for i in own], pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())]))), pa.array([kept[i] for i in own], pa.binary()),
                    ],
                    _RESULT,
                )

    first = settled(rows.mapInArrow(stored, _SCHEMA))
    texts = first.filter(F.col("kind") == TEXTS).select("block", F.lit(-1).alias("round"), "owner", "payload")
    answers = lambda sent, n, *how: settled(exchanged(sent.filter(F.col("kind") == STRINGS), *how)).select("block", F.lit(n).alias("round"), "owner", "payload")
    gathered = lambda *parts: _union(texts, *parts).repartition("block").sortWithinPartitions("block", "round")
    anchors = answers(first, 0, anchors_answer, OF_ANCHORS)
    found = answers(gathered(anchors).mapInArrow(windows, _SCHEMA), 1, windows_answer, OF_WINDOWS)
    return gathered(anchors, found).mapInArrow(cleaned, f"doc_id {kind}, n_bytes long, n_removed long, spans array<struct<start: long, length: long>>, kept binary")


def _union(first: DataFrame, *more: DataFrame) -> DataFrame:
    for df in more:
        first = first.union(df)
    return first


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = repeats(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return found.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
