"""Byte-pair encoding and decoding with forced boundaries.

A byte pair that occurs inside no vocabulary token can never be merged across, so it marks a
certain cut: the fragments between cuts are encoded independently and their ids concatenated.
"""

from __future__ import annotations

import heapq
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from premia.llm.common import Lexicon, give_back

# The words a byte-level vocabulary is applied to, in this order of preference.
WORDS = r" ?\p{L}+|'s|'t|'re|'ve|'m|'ll|'d| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

# Stretches between cuts, and fragments of them, whose ids a task remembers.
REMEMBERED, FRAGMENTS = 300_000, 150_000
# Sorts after every merge.
NONE = 1 << 62
# Texts are encoded in pieces of about so many characters, and about as many at a time.
PIECE = 1 << 20
# Bytes of fragments that are merged side by side.
MERGED_BYTES = 1 << 18
# Where a word begins with a space: whatever stands before is a word of its own.
SPACE = re.compile(r"(?= \S)")
# Longer fragments are merged one by one, with a queue.
LONG = 48


def printable_bytes() -> dict[str, int]:
    """The character by which a byte-level vocabulary file writes each byte."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Vocabulary:
    """Token bytes by id, merge ranks, and the byte pairs that occur inside a token."""

    def __init__(self, content: str, merges: bool = True):
        file = json.loads(content)
        to_byte = printable_bytes()
        ids = file["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in file["added_tokens"]}
        self.tokens: list[bytes] = [b""] * (max([*ids.values(), *self.special.values()]) + 1)
        for token, i in ids.items():
            if token not in self.special:
                self.tokens[i] = bytes(map(to_byte.__getitem__, token))
        for token, i in self.special.items():
            self.tokens[i] = token.encode()
        self.fragments = Lexicon(self.merge_fragments, FRAGMENTS)
        self.known = Lexicon(self.learn, REMEMBERED)
        if not merges:
            return
        plain = [self.tokens[i] for token, i in ids.items() if token not in self.special]
        # At left * 256 + right: whether the byte pair occurs inside a token.
        self.inside = np.zeros(1 << 16, bool)
        together = np.frombuffer(b"".join(plain), np.uint8).astype(np.int64)
        pairs = np.ones(len(together), bool)
        pairs[np.cumsum([len(token) for token in plain]) - 1] = False
        self.inside[(together[:-1] << 8 | together[1:])[pairs[:-1]]] = True
        self.byte_ids = [ids[c] for c, _ in sorted(to_byte.items(), key=lambda x: x[1])]
        # (left, right) as left << 32 | right -> rank << 32 | merged id, so the smallest value is merged first.
        merge = {}
        for rank, pair in enumerate(file["model"]["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            merge[ids[a] << 32 | ids[b]] = rank << 32 | ids[a + b]
        self.merge = merge
        self.left_right = np.array(sorted(merge), np.int64)
        self.merges_to = np.array([merge[x] for x in self.left_right.tolist()], np.int64)
        self.words = regex.compile(WORDS)
        self.specials = regex.compile("|".join(map(regex.escape, self.special)) or r"(?!)")

    def found(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """What pairs of ids merge to, or NONE; an id of -1 is no id."""
        pair = left << 32 | right
        at = np.minimum(np.searchsorted(self.left_right, pair), len(self.left_right) - 1)
        return np.where((self.left_right[at] == pair) & (right >= 0), self.merges_to[at], NONE)

    def merged(self, fragments: list[bytes]) -> np.ndarray:
        """Ids of fragments of equal length, merged side by side; -1 fills the rows.

        In each the pair of the lowest rank is merged first, the leftmost of equal ones.
        """
        size = len(fragments[0])
        ids = np.array(self.byte_ids, np.int64)[np.frombuffer(b"".join(fragments), np.uint8).reshape(-1, size)]
        pairs = self.found(ids[:, :-1], ids[:, 1:])
        done, which = np.full(ids.shape, -1), np.arange(len(ids))
        while len(ids):
            best = pairs.min(1) if pairs.shape[1] else np.full(len(ids), NONE)
            open_ = best != NONE
            done[which[~open_], : ids.shape[1]] = ids[~open_]
            ids, pairs, which, best = ids[open_], pairs[open_], which[open_], best[open_]
            if not len(ids):
                break
            row, at, columns = np.arange(len(ids)), pairs.argmin(1), np.arange(ids.shape[1] - 1)
            ids[row, at] = best & 0xFFFFFFFF
            # The right one of the two goes; what stands after it moves up.
            ids = np.take_along_axis(ids, columns + (columns > at[:, None]), 1)
            pairs = np.take_along_axis(pairs, columns[:-1] + (columns[:-1] > at[:, None]), 1)
            for k in (at - 1, at):
                ok = (k >= 0) & (k < pairs.shape[1])
                r, c = row[ok], k[ok]
                pairs[r, c] = self.found(ids[r, c], ids[r, c + 1])
        return done

    def merge_fragments(self, fragments: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of fragments, one after another, and how many each has."""
        sizes = np.fromiter(map(len, fragments), np.int64, len(fragments))
        rows, values = [], []
        by_size = np.argsort(sizes, kind="stable")
        for same in np.split(by_size, np.flatnonzero(np.diff(sizes[by_size])) + 1):
            step = max(1, MERGED_BYTES // int(sizes[same[0]]))
            for start in range(0, len(same), step):
                which = same[start : start + step]
                some = [fragments[k] for k in which.tolist()]
                if len(some[0]) > LONG:
                    made = [np.array(self.merged_long([self.byte_ids[b] for b in f]), np.int64) for f in some]
                    rows += [np.full(len(m), k) for k, m in zip(which, made, strict=True)]
                    values += made
                else:
                    done = self.merged(some)
                    at, _ = np.nonzero(done >= 0)
                    rows.append(which[at])
                    values.append(done[done >= 0])
        row, ids = np.concatenate(rows), np.concatenate(values)
        return ids[np.argsort(row, kind="stable")], np.bincount(row, minlength=len(fragments))

    def merged_long(self, ids: list[int]) -> list[int]:
        """The same with a queue of pairs over a linked list, for fragments of any length."""
        find, n = self.merge.get, len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        queue = [(f, i, ids[i], ids[i + 1]) for i in range(n - 1) if (f := find(ids[i] << 32 | ids[i + 1]))]
        heapq.heapify(queue)
        while queue:
            found, i, a, b = heapq.heappop(queue)
            j, new = after[i], found & 0xFFFFFFFF
            if ids[i] != a or j >= n or ids[j] != b:
                continue  # one of the two has been merged since
            ids[i], ids[j], after[i] = new, -1, after[j]
            if after[j] < n:
                before[after[j]] = i
                if f := find(new << 32 | ids[after[j]]):
                    heapq.heappush(queue, (f, i, new, ids[after[j]]))
            if before[i] >= 0 and (f := find(ids[before[i]] << 32 | new)):
                heapq.heappush(queue, (f, before[i], ids[before[i]], new))
        return [x for x in ids if x >= 0]

    def learn(self, stretches: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of stretches not met before: words, cut where a byte pair occurs in no token, merged, concatenated."""
        words, ends, special = [], [], []
        for k, stretch in enumerate(stretches):
            if stretch in self.special:
                special.append(k)
            else:
                words += self.words.findall(stretch)
            ends.append(len(words))
        data = [w.encode() for w in words]
        whole = b"".join(data)
        together = np.frombuffer(whole, np.uint8).astype(np.int64)
        # A fragment ends with its word, and between two bytes that no token holds side by side.
        word_ends = np.cumsum([len(d) for d in data], dtype=np.int64)
        cut = np.zeros(len(together), bool)
        cut[:-1] = ~self.inside[together[:-1] << 8 | together[1:]]
        cut[word_ends - 1] = True
        at = np.flatnonzero(cut) + 1
        bounds = [0, *at.tolist()]
        ids, lengths = self.fragments.of([whole[a:b] for a, b in zip(bounds, bounds[1:], strict=False)])
        # The fragments of a stretch end up to its last byte.
        upto = np.append(0, np.cumsum(lengths))[np.searchsorted(at, np.append(0, word_ends)[ends], "right")]
        counts = np.diff(upto, prepend=0)
        counts[special] = 1
        return np.insert(ids, upto[special], [self.special[stretches[k]] for k in special]), counts

    def stretches(self, text: str) -> Iterator[list[str]]:
        """Stretches of a text that are encoded independently, about a PIECE of it at a time."""
        start = 0
        for m in [*self.specials.finditer(text), None]:
            end = m.start() if m else len(text)
            while start < end:
                near = SPACE.search(text, start + PIECE, end) if end - start > PIECE else None
                stop = near.start() if near else end
                yield SPACE.split(text[start:stop])
                start = stop
            if m:
                yield [m[0]]
                start = m.end()

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids as little-endian unsigned 32-bit integers."""
        out: list[list[bytes]] = [[] for _ in texts]
        waiting: list[str] = []
        # Whose the next of the waiting are, and how many.
        owners: list[tuple[int, int]] = []

        def settle():
            ids, lengths = self.known.of(waiting)
            upto = np.append(0, np.cumsum(lengths))[np.append(0, np.cumsum([n for _, n in owners], dtype=np.int64))] * 4
            flat = ids.astype("<u4").tobytes()
            for (k, _), a, b in zip(owners, upto.tolist(), upto[1:].tolist(), strict=False):
                out[k].append(flat[a:b])
            waiting.clear()
            owners.clear()

        size = 0
        for k, text in enumerate(texts):
            for some in self.stretches(text):
                waiting.extend(some)
                owners.append((k, len(some)))
                size += sum(map(len, some))
                if size >= PIECE:
                    settle()
                    size = 0
        settle()
        return [b"".join(x) for x in out]

    def forget(self) -> None:
        """Give back what was remembered; the tables of the vocabulary stay for later tasks of the worker."""
        self.known.forget()
        self.fragments.forget()

    def decode(self, ids: bytes) -> str:
        token = self.tokens.__getitem__
        return b"".join(map(token, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")


def content_of(path: str) -> str:
    with open(path, encoding="utf-8") as file:
        return file.read()


def _with(df: DataFrame, path: str, take: str, give: dict[str, str], work) -> DataFrame:
    """``df`` without ``take``, with the columns ``give`` (names and types) made from it in tasks."""
    kept = [c for c in df.columns if c != take and c not in give]
    # The vocabulary file has a fixed size; each worker builds its tables from it once.
    sent = df.sparkSession.sparkContext.broadcast({"content": content_of(path)})
    schema = ", ".join([*(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in kept), *(f"`{c}` {k}" for c, k in give.items())])
    large = {"binary": pa.large_binary(), "string": pa.large_string()}
    small = {"binary": pa.binary(), "string": pa.string()}

    def apply(batches):
        try:
            for batch in batches:
                for start in range(0, batch.num_rows, 1024):
                    part = batch.slice(start, 1024)
                    made = work(sent.value, part.column(part.schema.get_field_index(take)).to_pylist())
                    columns = [part.column(part.schema.get_field_index(c)) for c in kept]
                    out = [pa.array(m, large[k]).cast(small[k]) for m, k in zip(made, give.values(), strict=True)]
                    yield pa.RecordBatch.from_arrays([*columns, *out], [*kept, *give])
        finally:
            for vocabulary in [v for v in sent.value.values() if isinstance(v, Vocabulary)]:
                vocabulary.forget()
            give_back()

    return df.select(*(F.col(f"`{c}`") for c in [*kept, take])).mapInArrow(apply, schema)


def encode_texts(documents: DataFrame, path: str, text: str = "text", decoded: str | None = None) -> DataFrame:
    """``documents`` without ``text``, with ``ids``: little-endian unsigned 32-bit token ids.

    Whole texts are encoded, special tokens inside them included. A null text counts as empty and
    gives no ids. Rows are independent: repeated rows and keys stay, an empty table stays empty,
    other columns pass through (one named ``ids`` is replaced). If ``decoded`` is named, that column holds
    what the ids decode to, as ``decode_ids`` gives it; a task then has one worker and one vocabulary for both.
    """

    def work(state, texts):
        vocabulary = state.setdefault("encoder", None)
        if vocabulary is None:
            vocabulary = state["encoder"] = Vocabulary(state["content"])
        ids = vocabulary.encode([t or "" for t in texts])
        return [ids, [vocabulary.decode(x) for x in ids]] if decoded else [ids]

    return _with(documents, path, text, {"ids": "binary"} | ({decoded: "string"} if decoded else {}), work)


def decode_ids(encoded: DataFrame, path: str, ids: str = "ids", text: str = "decoded", keep_ids: bool = True) -> DataFrame:
    """``encoded`` with ``text``, the decoded ids; null ids decode to an empty text.

    Rows are independent: repeated rows stay, an empty table stays empty, other columns pass through
    (one named as ``text`` is replaced).
    """

    def work(state, many):
        vocabulary = state.setdefault("decoder", None)
        if vocabulary is None:
            vocabulary = state["decoder"] = Vocabulary(state["content"], merges=False)
        return [[vocabulary.decode(x or b"") for x in many]]

    taken = "_ids"
    while taken in encoded.columns:
        taken += "_"
    source = encoded.withColumn(taken, F.col(ids))
    return _with(source if keep_ids else source.drop(ids), path, taken, {text: "string"}, work)
