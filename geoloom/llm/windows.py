"""Packing of token pieces into windows by best-fit decreasing.

A document is its token ids (a word-end BPE) followed by one end id. A longer
document is first cut into full windows of ``capacity`` tokens, which are done;
what is left of each document, its tail, is an item. A task takes the items of
its rows in blocks of bounded tokens and items, longest first, and lays each in
the open window with the least room that still holds it. A segment tree whose
leaves are the rooms 0 to ``capacity`` finds that window.

Windows that best fit leaves open are then topped up: the emptiest give their
items, the last one cut, to the fullest. So a block ends in full windows and one
rest of fewer than ``capacity`` tokens, which keeps its ids. The rests are the
items of the next round, over as many tasks as they have blocks, until they are
one block; the rest of that one is cut into sequences of descending powers of
two, which need no padding. Documents are not shuffled, only the rests: at most
a window for each block of ``BLOCK_TOKENS``.

Defined results: a null or empty text is the end id alone; rows with repeated or
null ids are packed each by itself; special-token strings inside texts become
their own ids, as the tokenizer has it; a text of any length is read whole (its
memory is many times its size only where it has no white space); extra
columns are not read; of windows of equal room the one changed last is taken; an empty
table packs into nothing.
"""

from __future__ import annotations

import functools
import re
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import runtime

CAPACITY, END_ID = 4096, 2
TOKENIZER = "word_bpe_49k"
#: A block's bounds; a task holds one at a time (16 MB of ids).
BLOCK_TOKENS, BLOCK_ITEMS = 1 << 22, 50_000
#: Distinct words, each of at most so many bytes, whose ids a worker keeps.
CACHE_WORDS, CACHE_BYTES = 500_000, 64
#: Texts are split into words in groups, and long texts in parts, of about so many bytes.
SEGMENT_BYTES = 1 << 20
#: Lower-case letters that no normal form changes, and marks after them.
_PLAIN = re.compile(rb"((?:[a-z]|\xc3[\x9f-\xb6\xb8-\xbf])+)([.,;:!?%$&#*]*)")
_SPACE = re.compile(rb"[ \t\n\r\x0b\x0c]")
_FIELDS = ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids")
_SCHEMA = ", ".join(f"{c} long" for c in _FIELDS[:-1]) + ", ids binary"


@functools.cache
def _tokenizer(name: str):
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path(f"{name}.json"))


@functools.cache
def _letters_tokenizer(name: str):
    """The tokenizer for words of ``_PLAIN`` letters alone, which its normal form and pattern leave as they are."""
    from tokenizers import normalizers, pre_tokenizers

    made = type(_tokenizer(name)).from_str(_tokenizer(name).to_str())
    made.normalizer = normalizers.Sequence([])
    made.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
    return made


@functools.cache
def _known(name: str) -> tuple[dict[bytes, bytes], dict[bytes, bytes]]:
    """The ids that a worker has learned: of words, and of their letters and of the marks after them."""
    return {}, {}


@functools.cache
def _id_of_nul(coder) -> int:
    (mark,) = coder.encode("\0", add_special_tokens=False).ids
    return mark


def _tokenized(words: list[bytes], coder) -> dict[bytes, bytes]:
    """Little-endian ids of words without NUL: read in one call with a NUL between each
    two, whose id no other word can end in."""
    if not words:
        return {}
    mark = _id_of_nul(coder)
    joined = b" \0 ".join(words).decode("utf-8", "replace")
    ids = np.array(coder.encode_batch_fast([joined], add_special_tokens=False)[0].ids, "<u4")
    ends = np.append(np.flatnonzero(ids == mark), len(ids)).tolist()
    data, out, at = ids.tobytes(), {}, 0
    for word, end in zip(words, ends, strict=True):
        out[word] = data[4 * at : 4 * end]
        at = end + 1
    return out


def _learn(words: set[bytes], name: str) -> None:
    """Adds the ids of the words to what is known.

    Marks after letters are a token run of their own, so the letters of "word" and
    "word," are tokenized once.
    """
    known, parts = _known(name)
    split, whole = [], []
    for word in words:
        found = _PLAIN.fullmatch(word)
        if found:
            split.append((word, *found.groups()))
        else:
            whole.append(word)
    coder = _tokenizer(name)
    parts.update(_tokenized([p for p in {letters for _, letters, _ in split} if p not in parts], _letters_tokenizer(name)))
    parts.update(_tokenized([p for p in {marks for _, _, marks in split} if p and p not in parts], coder))
    parts[b""] = b""
    known.update((w, parts[letters] + parts[marks]) for w, letters, marks in split)
    known.update(_tokenized([w for w in whole if b"\0" not in w], coder))
    for word in whole:
        if b"\0" in word:
            known[word] = np.array(coder.encode(word.decode("utf-8", "replace"), add_special_tokens=False).ids, "<u4").tobytes()


def _forget(known: dict[bytes, bytes], words: set[bytes]) -> None:
    """Keeps a cache in its bounds: no long words, and of too many every second one."""
    for word in words:
        if len(word) > CACHE_BYTES:
            known.pop(word, None)
    if len(known) > CACHE_WORDS:
        for word in list(known)[::2]:
            del known[word]


def _segments(text: bytes) -> Iterator[bytes]:
    """The text in parts of about ``SEGMENT_BYTES`` that end at white space."""
    at = 0
    while len(text) - at > SEGMENT_BYTES and (gap := _SPACE.search(text, at + SEGMENT_BYTES)):
        yield text[at : gap.start()]
        at = gap.end()
    yield text[at:] if at else text


def _words(segment: bytes) -> list[bytes]:
    """What stands between ASCII white space.

    The tokenizer lower-cases. Doing so for ASCII before it composes characters changes
    nothing where no combining mark (U+0300 to U+036F) could join a letter.
    """
    if b"\xcc" not in segment and b"\xcd" not in segment and b"<|" not in segment:
        segment = segment.lower()
    return segment.split()


def _coded(segments: list[list[bytes]], name: str) -> list[bytes]:
    """The little-endian ids of each list of words."""
    known, parts = _known(name)
    new = set(chain.from_iterable(segments)).difference(known)
    if new:
        _learn(new, name)
    out = [b"".join(map(known.__getitem__, words)) for words in segments]
    if new:
        _forget(known, new)
        _forget(parts, {p for w in new if len(w) > CACHE_BYTES and (m := _PLAIN.fullmatch(w)) for p in m.groups()})
    return out


def token_ids(texts: list[bytes], name: str = TOKENIZER, end_id: int = END_ID) -> list[np.ndarray]:
    """For each UTF-8 text the tokenizer's ids, and the end id.

    This tokenizer drops white space and no token crosses it, so a text's ids are
    those of its words between ASCII white space; each distinct word is tokenized once.
    """
    end = np.array([end_id], "<u4").tobytes()
    if len(texts) == 1:
        coded = [b"".join([_coded([_words(s)], name)[0] for s in _segments(texts[0])])]
    else:
        coded = _coded([_words(t) for t in texts], name)
    return [np.frombuffer(ids + end, "<u4") for ids in coded]


class OpenWindows:
    """Windows by the room they have, in a segment tree of how many have it."""

    def __init__(self, capacity: int) -> None:
        self.leaves = 1 << capacity.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.by_room: dict[int, list[int]] = {}

    def _add(self, room: int, change: int) -> None:
        node = self.leaves + room
        while node:
            self.count[node] += change
            node >>= 1

    def put(self, window: int, room: int) -> None:
        self.by_room.setdefault(room, []).append(window)
        self._add(room, 1)

    def tightest(self, need: int) -> tuple[int, int] | None:
        """Takes out (window, room) with the least room of at least ``need``, if there is one."""
        count, node = self.count, self.leaves + need
        if not count[node]:
            while node & 1 or not count[node + 1]:  # up to the first subtree on the right that has a window
                node >>= 1
                if node <= 1:
                    return None
            node += 1
            while node < self.leaves:
                node = 2 * node if count[2 * node] else 2 * node + 1
        room = node - self.leaves
        self._add(room, -1)
        return self.by_room[room].pop(), room


def best_fit_decreasing(sizes: list[int], capacity: int) -> list[list[int]]:
    """Windows as lists of item numbers; no item is larger than ``capacity``."""
    windows: list[list[int]] = []
    still_open = OpenWindows(capacity)
    for item in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        found = still_open.tightest(sizes[item])
        if found is None:
            found = len(windows), capacity
            windows.append([])
        window, room = found
        windows[window].append(item)
        if room > sizes[item]:
            still_open.put(window, room - sizes[item])
    return windows


def top_up(windows: list[list[tuple[int, int, int]]], capacity: int) -> tuple[list, list]:
    """(full windows, the rest) of windows of slices (item, from, to).

    The emptiest windows give their slices to the fullest; a slice that does not
    fit is cut. The rest is one window that is not full, or nothing.
    """
    used = [sum(z - a for _, a, z in w) for w in windows]
    order = sorted(range(len(windows)), key=lambda w: -used[w])
    left, right = 0, len(order) - 1
    while left < right:
        taker, giver = order[left], windows[order[right]]
        room = capacity - used[taker]
        if not room:
            left += 1
        elif not giver:
            right -= 1
        else:
            item, a, z = giver.pop()
            middle = min(z, a + room)
            windows[taker].append((item, a, middle))
            used[taker] += middle - a
            used[order[right]] -= middle - a
            if middle < z:
                giver.append((item, middle, z))
    full = [windows[w] for w in order if used[w] == capacity]
    rest = [s for w in order if 0 < used[w] < capacity for s in windows[w]]
    return full, rest


def powers_of_two(rest: list[tuple[int, int, int]]) -> list[list[tuple[int, int, int]]]:
    """The slices as windows whose lengths are different powers of two."""
    total = sum(z - a for _, a, z in rest)
    slices, windows = list(reversed(rest)), []
    for bit in reversed(range(total.bit_length())):
        room = total & 1 << bit
        if room:
            windows.append([])
        while room:
            item, a, z = slices.pop()
            middle = min(z, a + room)
            windows[-1].append((item, a, middle))
            room -= middle - a
            if middle < z:
                slices.append((item, middle, z))
    return windows


class _Block:
    """The items that a task has gathered, and the numbers of its windows."""

    def __init__(self, capacity: int, first_id: int) -> None:
        self.capacity, self.next_id, self.rows = capacity, first_id, []
        self._clear()

    def _clear(self) -> None:
        self.items: list[tuple[int | None, int, np.ndarray, int]] = []
        self.tokens = 0

    def window(self, slices: list[tuple[int | None, int, np.ndarray, int]]) -> None:
        """A finished window of (document, start, ids, tokens of the document)."""
        at = 0
        for doc, start, ids, doc_tokens in slices:
            self.rows.append((doc, start, len(ids), zlib.crc32(ids.tobytes()), doc_tokens, self.next_id, at, None))
            at += len(ids)
        self.next_id += 1

    def document(self, doc: int | None, ids: np.ndarray) -> None:
        tail = len(ids) - len(ids) % self.capacity
        for a in range(0, tail, self.capacity):
            self.window([(doc, a, ids[a : a + self.capacity], len(ids))])
        if tail < len(ids):
            self.item(doc, tail, ids[tail:], len(ids))

    def item(self, doc: int | None, start: int, ids: np.ndarray, doc_tokens: int) -> None:
        self.items.append((doc, start, ids, doc_tokens))
        self.tokens += len(ids)

    def full(self) -> bool:
        return self.tokens >= BLOCK_TOKENS or len(self.items) + len(self.rows) >= BLOCK_ITEMS

    def _slices(self, window: list[tuple[int, int, int]]) -> list[tuple[int | None, int, np.ndarray, int]]:
        return [(d, start + a, ids[a:z], n) for i, a, z in window for d, start, ids, n in (self.items[i],)]

    def done(self, last: bool) -> pa.RecordBatch:
        """All rows so far: windows, and the rest with its ids (as windows too, if ``last``)."""
        sizes = [len(ids) for _, _, ids, _ in self.items]
        packed = best_fit_decreasing(sizes, self.capacity)
        full, rest = top_up([[(i, 0, sizes[i]) for i in w] for w in packed], self.capacity)
        for w in full + (powers_of_two(rest) if last else []):
            self.window(self._slices(w))
        if not last:
            self.rows += [(d, start, len(ids), None, n, None, None, ids.tobytes()) for d, start, ids, n in self._slices(rest)]
        columns = list(zip(*self.rows)) or [()] * len(_FIELDS)
        self.rows = []
        self._clear()
        kinds = [pa.int64()] * (len(_FIELDS) - 1) + [pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], list(_FIELDS))


def _first_id(turn: int) -> int:
    """Windows are numbered by round, task and place, as ``monotonically_increasing_id`` does."""
    from pyspark import TaskContext

    return (turn << 57) + (TaskContext.get().partitionId() << 33)


def _groups(sizes: list[int]) -> Iterator[tuple[int, int]]:
    """Runs of texts of at most ``SEGMENT_BYTES`` together, or of one text."""
    first, total = 0, 0
    for k, size in enumerate(sizes):
        if k > first and total + size > SEGMENT_BYTES:
            yield first, k
            first, total = k, 0
        total += size
    if sizes:
        yield first, len(sizes)


def _of_documents(name: str, capacity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = _Block(capacity, _first_id(0))
        for batch in batches:
            docs, texts = batch.column(0).to_pylist(), [t or b"" for t in batch.column(1).to_pylist()]
            for a, z in _groups([len(t) for t in texts]):
                for doc, ids in zip(docs[a:z], token_ids(texts[a:z], name)):
                    block.document(doc, ids)
                    if block.full():
                        yield block.done(False)
        yield block.done(False)

    return run


def _of_rests(turn: int, capacity: int, last: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = _Block(capacity, _first_id(turn))
        for batch in batches:
            for doc, start, ids, n in zip(*(c.to_pylist() for c in batch.columns)):
                block.item(doc, start, np.frombuffer(ids, "<u4"), n)
                if block.full() and not last:
                    yield block.done(False)
        yield block.done(last)

    return run


def packed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", name: str = TOKENIZER, capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset) of every piece.

    All sequences hold ``capacity`` tokens but the last ones, of which each has
    another power of two.
    """
    rows = runtime.bounded_batches(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    state = runtime.written(rows.mapInArrow(_of_documents(name, capacity), _SCHEMA), "windows")
    out, turn, last = [], 0, False
    while not last:
        out.append(state.where("sequence_id is not null"))
        rests = state.where("sequence_id is null").select("doc_id", "start", "ids", "doc_tokens", "length")
        tokens, items = rests.agg(F.coalesce(F.sum("length"), F.lit(0)), F.count("*")).first()
        tasks = max(1, -(-tokens // BLOCK_TOKENS), -(-items // BLOCK_ITEMS))
        turn, last = turn + 1, tasks == 1
        step = rests.drop("length").repartition(tasks).mapInArrow(_of_rests(turn, capacity, last), _SCHEMA)
        state = runtime.written(step, "windows")
    every = state
    for done in out:
        every = every.unionByName(done)
    return every.drop("ids")
