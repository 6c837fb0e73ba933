"""Byte-pair encoding and decoding by batched numpy merge rounds.

The symbols of many words lie in one flat array. In each round every adjacent pair is looked up by
binary search in the sorted pair keys, each word takes its lowest rank, and all occurrences of
that pair merge at once, leftmost first where they overlap; words without a known pair leave the
array. A merge can only create pairs of a later rank, so rounds give the same result as merging
one pair at a time. Words of over ``LONG`` bytes would need a round over the whole word for every
rank that occurs in them; they are merged in rounds over an index from ranks to places instead, in
which a round touches only the places that it merges and their neighbours. Encoded words are
remembered in a bounded table, long ones only while their text is encoded.

Normalisation, splitting and special tokens follow the vocabulary file. Defined results: a null or
blank text has no tokens and decodes to the empty text; special token strings in a text become
their single ids; repeated rows are encoded alike; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import unicodedata
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from strandloom.llm.common import documents

VOCABULARY = "word_bpe_49k.json"
#: Words whose encodings a worker remembers before it forgets all of them.
REMEMBERED = 250_000
#: Bytes over which a word is merged by the index of ranks.
LONG = 512
#: Words that are merged together.
FLAT_WORDS = 20_000

#: White space of Unicode (without the C0 separators that Python's own class has).
_SPACE = "\t-\r \x85\xa0  -     　"
#: Lower-case mappings that are newer than this Python's tables: fixed values of the standard.
_NEW_LOWER = {
    0x1C89: 0x1C8A, 0xA7CB: 0x264, 0xA7CC: 0xA7CD, 0xA7CE: 0xA7CF, 0xA7D2: 0xA7D3, 0xA7D4: 0xA7D5, 0xA7DA: 0xA7DB, 0xA7DC: 0x19B,
    **{c: c + 0x20 for c in range(0x10D50, 0x10D66)},
    **{c: c + 0x1B for c in range(0x16EA0, 0x16EB9)},
}
_NEW_LOWER = {c: chr(low) for c, low in _NEW_LOWER.items()} | {0x3A3: "σ"}  # a capital sigma is lowered without its context


def _byte_symbols() -> list[str]:
    """The printable stand-in of each byte: itself where it prints, else the next free code point from 256."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    free = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(free)) for b in range(256)]


_NONE = np.iinfo(np.int64).max


class Codec:
    """Encoder and decoder of one vocabulary file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, end = spec["model"]["vocab"], spec["model"]["end_of_word_suffix"]
        specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.width = np.int64(max([*vocab.values(), *specials.values()]) + 1)
        self.token = [""] * int(self.width)
        for token, i in [*vocab.items(), *specials.items()]:
            self.token[i] = token
        pairs = np.array([(vocab[a], vocab[b], vocab[a + b]) for a, b in map(tuple, spec["model"]["merges"])], np.int64)
        keys = pairs[:, 0] * self.width + pairs[:, 1]
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks, self.results = keys[order], order.astype(np.int64), pairs[order, 2]
        shown = _byte_symbols()
        self.inner = np.array([vocab[s] for s in shown], np.int64)
        self.final = np.array([vocab[s + end] for s in shown], np.int64)
        self.specials = specials
        self.special = regex.compile("(" + "|".join(map(regex.escape, sorted(specials, key=len, reverse=True))) + ")")
        self.space = regex.compile(f"[{_SPACE}]+")
        self.words = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|\p{{L}}+|\p{{N}}|[^{_SPACE}\p{{L}}\p{{N}}]+")
        self.ids_of: dict[str, bytes] = {}
        self.shown_as: dict[str, str] = {}

    def split(self, text: str | None) -> list[str]:
        """Words of a whole text; special tokens stay as they are, marked by a leading NUL."""
        if not text:
            return []
        if "<|" not in text:
            return self._words_of(text)
        out = []
        for k, part in enumerate(self.special.split(text)):
            out += [f"\0{part}"] if k % 2 else self._words_of(part)
        return out

    def _words_of(self, part: str) -> list[str]:
        if not part.isascii():
            part = unicodedata.normalize("NFC", part).translate(_NEW_LOWER)
        # spaces only separate words, so that collapsing them changes nothing
        return self.words.findall(part.lower())

    def _ranks_of(self, first: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank of each pair (the greatest number if it is none), and its place in the table."""
        pair = first * self.width + second
        at = np.minimum(np.searchsorted(self.keys, pair), len(self.keys) - 1)
        return np.where(self.keys[at] == pair, self.ranks[at], _NONE), at

    def merge_long(self, word: bytes) -> tuple[np.ndarray, int]:
        """Ids of one word, and the number of places that all rounds touched: in proportion to the word."""
        flat = np.frombuffer(word, np.uint8)
        n = len(flat)
        symbols = self.inner[flat]
        symbols[-1] = self.final[flat[-1]]
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)  # n and -1: none
        rank, made, alive = np.full(n, _NONE), np.zeros(n, np.int64), np.ones(n, bool)
        waiting: list[int] = []
        index: dict[int, list[np.ndarray]] = {}

        def look_up(at: np.ndarray) -> None:
            """Set the ranks of the pairs that start at these places, and file them."""
            at = at[after[at] < n]
            found, place = self._ranks_of(symbols[at], symbols[after[at]])
            rank[at], made[at] = found, self.results[place]
            order = np.argsort(found, kind="stable")
            at, found = at[order], found[order]
            for part in np.split(at, np.flatnonzero(np.diff(found)) + 1):
                r = int(rank[part[0]]) if len(part) else _NONE
                if r != _NONE:
                    if r not in index:
                        heapq.heappush(waiting, r)
                    index.setdefault(r, []).append(part)

        look_up(np.arange(n))
        touched = n
        while waiting:
            r = heapq.heappop(waiting)
            at = np.unique(np.concatenate(index.pop(r)))
            touched += len(at)
            at = at[rank[at] == r]
            if not len(at):
                continue
            # of overlapping occurrences every other one merges, from the left
            fresh = np.ones(len(at), bool)
            fresh[1:] = after[at[:-1]] != at[1:]
            place = np.arange(len(at))
            at = at[(place - np.maximum.accumulate(np.where(fresh, place, 0))) % 2 == 0]
            gone = after[at]
            symbols[at] = made[at]
            after[at] = after[gone]
            follows = after[at] < n
            before[after[at][follows]] = at[follows]
            rank[gone], alive[gone] = _NONE, False
            again = np.unique(np.concatenate((at, before[at][before[at] >= 0])))
            rank[again] = _NONE
            touched += len(again)
            look_up(again)
        return symbols[alive], touched

    def merge(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words in a row, and the n+1 bounds of each word's."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        flat = np.frombuffer(b"".join(words), np.uint8)
        bounds = np.concatenate(([0], np.cumsum(sizes)))
        symbols = self.inner[flat]
        symbols[bounds[1:] - 1] = self.final[flat[bounds[1:] - 1]]
        owner = np.repeat(np.arange(len(words)), sizes)
        done_symbols, done_owner = [], []
        while len(symbols):
            pair = symbols[:-1] * self.width + symbols[1:]
            at = np.minimum(np.searchsorted(self.keys, pair), len(self.keys) - 1)
            known = (self.keys[at] == pair) & (owner[:-1] == owner[1:])
            rank = np.where(known, self.ranks[at], np.iinfo(np.int64).max)
            heads = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1])))
            padded = np.concatenate((rank, [np.iinfo(np.int64).max]))
            best = np.minimum.reduceat(padded, heads)
            lengths = np.diff(np.concatenate((heads, [len(symbols)])))
            best = np.repeat(best, lengths)
            active = best != np.iinfo(np.int64).max
            if not active.all():
                done_symbols.append(symbols[~active])
                done_owner.append(owner[~active])
            hit = active & (padded == best)
            # of overlapping occurrences every other one merges, from the left
            place = np.arange(len(hit))
            run = np.maximum.accumulate(np.where(hit & ~np.concatenate(([False], hit[:-1])), place, 0))
            hit &= (place - run) % 2 == 0
            left = np.flatnonzero(hit)
            symbols = symbols.copy()
            symbols[left] = self.results[at[left]]
            keep = active
            keep[left + 1] = False
            symbols, owner = symbols[keep], owner[keep]
        owner = np.concatenate(done_owner) if done_owner else np.zeros(0, np.int64)
        ids = np.concatenate(done_symbols) if done_symbols else np.zeros(0, np.int64)
        order = np.argsort(owner, kind="stable")
        return ids[order], np.concatenate(([0], np.cumsum(np.bincount(owner, minlength=len(words)))))

    def learn(self, wanted: Iterable[str]) -> None:
        """Encode words that are not remembered yet."""
        fresh = []
        for word in wanted:
            if len(word) > LONG and word[0] != "\0":
                own = self.merge_long(word.encode())[0].tolist()
                self.ids_of[word], self.shown_as[word] = " ".join(map(str, own)).encode(), self.decode(own)
                continue
            if word[0] == "\0" and word[1:] in self.specials:
                i = self.specials[word[1:]]
                self.ids_of[word], self.shown_as[word] = b"%d" % i, self.token[i]
            else:
                fresh.append(word)
        for start in range(0, len(fresh), FLAT_WORDS):
            block = fresh[start : start + FLAT_WORDS]
            ids, bounds = self.merge([w.encode() for w in block])
            ids, bounds = ids.tolist(), bounds.tolist()
            for k, word in enumerate(block):
                own = ids[bounds[k] : bounds[k + 1]]
                self.ids_of[word] = " ".join(map(str, own)).encode()
                self.shown_as[word] = self.decode(own)

    def encode_batch(self, texts: list[str | None]) -> list[tuple[bytes, str]]:
        """For each text its decimal ids, joined by one space, and their decoding."""
        out, group, size = [], [], 0
        for text in texts:
            words = self.split(text)
            group.append(words)
            size += len(words)
            if size > REMEMBERED:
                out += self._group(group)
                group, size = [], 0
        return out + self._group(group)

    def _group(self, group: list[list[str]]) -> Iterator[tuple[bytes, str]]:
        wanted = set().union(*group) - self.ids_of.keys()
        if len(wanted) + len(self.ids_of) > REMEMBERED:
            self.ids_of.clear()
            self.shown_as.clear()
            wanted = set().union(*group)
        self.learn(wanted)
        ids_of, shown_as = self.ids_of.__getitem__, self.shown_as.__getitem__
        rows = [(b" ".join(map(ids_of, words)), " ".join(map(shown_as, words))) for words in group]
        for word in [w for w in wanted if len(w) > LONG]:
            del self.ids_of[word], self.shown_as[word]
        return rows

    def encode(self, text: str | None) -> list[int]:
        return [int(i) for i in self.encode_batch([text])[0][0].split()]

    def decode(self, ids: Iterable[int]) -> str:
        """The file names no decoder: token strings joined by one space."""
        return " ".join([self.token[i] for i in ids])


@lru_cache(maxsize=2)
def codec(path: str | None = None) -> Codec:
    """The codec of a vocabulary file, one per worker process."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path(VOCABULARY)
    return Codec(path)


def encode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids, ids_sha256 and decoded_sha256 of every whole text."""
    schema = T.StructType.fromDDL("doc_id bigint, n_tokens bigint, ids array<int>, ids_sha256 string, decoded_sha256 string")

    def run(batches):
        own = codec(path)
        for batch in batches:
            rows = own.encode_batch(batch.column("text").to_pylist())
            ids = [np.fromstring(i, np.int32, sep=" ") if i else np.zeros(0, np.int32) for i, _ in rows]
            bounds = np.concatenate(([0], np.cumsum([len(x) for x in ids]))).astype(np.int32)
            yield _digest_batch(batch, rows, pa.ListArray.from_arrays(bounds, pa.array(np.concatenate([*ids, np.zeros(0, np.int32)]))))

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """As :func:`encode`, without the ids themselves."""
    schema = T.StructType.fromDDL("doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string")

    def run(batches):
        own = codec(path)
        for batch in batches:
            yield _digest_batch(batch, own.encode_batch(batch.column("text").to_pylist()))

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def _digest_batch(batch, rows, ids=None) -> pa.RecordBatch:
    columns = {
        "doc_id": batch.column("doc_id"),
        "n_tokens": pa.array([i.count(b" ") + 1 if i else 0 for i, _ in rows], pa.int64()),
        **({"ids": ids} if ids is not None else {}),
        "ids_sha256": pa.array([hashlib.sha256(i).hexdigest() for i, _ in rows], pa.string()),
        "decoded_sha256": pa.array([hashlib.sha256(t.encode()).hexdigest() for _, t in rows], pa.string()),
    }
    return pa.RecordBatch.from_pydict(columns)


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id and text of every row of ids (null: empty)."""

    def run(batches):
        own = codec(path)
        for batch in batches:
            texts = [own.decode(ids or []) for ids in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "text": pa.array(texts, pa.string())})

    return encoded.select("doc_id", "ids").mapInArrow(run, T.StructType.fromDDL("doc_id bigint, text string"))


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(documents(spark, sf_dir))
