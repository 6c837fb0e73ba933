"""Secret scanning: fixed patterns, and a linear-chain conditional random field over tokens.

Tokens are words of whole texts, labelled outside (0), begin (1) or inside (2) a secret. Features
are codes of a token's shape, its make-up (class changes, consonants in a row, twins, joints), the
word before, the shapes on both sides, the file's share of odd tokens, and whether a key-like word
or a separator stands before or in it. Every token is scored, plain words too. Where the scores
prove that the best labelling has an outside, whatever the neighbours are, the chain is split;
Viterbi decodes the rest exactly, all runs of a block side by side.

The field is trained here, on at most ``TRAIN_DOCS`` documents chosen by hash of doc_id, and at most
``TRAIN_RUNS`` pieces of them. A document counts ``WAYS`` times: as it is, with the matches of the fixed
patterns as labels, and then with drawn secrets of other forms and drawn look-alikes that are none
(:mod:`strandloom.llm.secret_forms`) between its words, so that the field learns shape and
surroundings instead of the patterns. Pieces that hold a doubtful token (long, letters and digits in
many changes) without a label teach nothing: it may be a secret. Of pieces of plain words alone one in ``PLAIN`` is taken and
counts ``PLAIN`` times. Spans of the field are added where no pattern matched; a span of one token
leaves out a name before a separator, quotes, and closing punctuation.

Defined results: a null text is empty and has no spans; very long texts are scanned in whole; labels that tie take the one that
the decoder meets first, spans of one start are listed in the order of kinds; repeated rows are scanned alike; an untrained
field (a table without words) adds nothing; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandloom.llm import secret_forms
from strandloom.llm.common import blocks, documents, utf8_view
from strandloom.llm.shingles import _BREAK, word_hashes

#: The base patterns, in the order of the contract; the last number is the least length of the group.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
LEAST = {"assign": (2, 12), "access": (0, 18), "hex": (0, 16)}
HINTS = ("password", "passwd", "secret", "token", "apikey", "api_key")
KINDS = ("assign", "access", "hex", "crf")

TRAIN_DOCS, TRAIN_RUNS = 1500, 15_000
#: Tokens of a piece of text in training, the share of plain pieces, and how often a document counts.
PIECE, PLAIN, WAYS = 16, 8, 3
#: Words that announce a secret, anywhere in a token.
KEYS = re.compile(rb"pass|pwd|key|secret|token|cred|auth|bearer|priv", re.IGNORECASE)
#: A token's value: without a name and separator before it, quotes, and closing punctuation.
VALUE = re.compile(r"""(?:\S{1,120}["']?[:=]+["']?(?=.{6}))?["'(\[{<]*(.+?)["',;.)\]}>!?]*$""", re.DOTALL)
BLOCK_BYTES = 1_000_000
#: Codes of each feature.
SIZES = (2048, 1024, 2048, 512, 512, 256, 16, 256)

_DIGIT, _UPPER, _LOWER, _SYMBOL, _HEX = 1, 2, 4, 8, 16
_CLASS = np.zeros(256, np.uint8)
_CLASS[ord("0") : ord("9") + 1] = _DIGIT
_CLASS[ord("A") : ord("Z") + 1] = _UPPER
_CLASS[ord("a") : ord("z") + 1] = _LOWER
for _c in b"+/_=-:.\"'@#$%&|<>(){}[]":
    _CLASS[_c] = _SYMBOL
_CONSONANT = np.zeros(256, bool)
for _c in b"bcdfghjklmnpqrstvwxzBCDFGHJKLMNPQRSTVWXZ":
    _CONSONANT[_c] = True
_IS_HEX = np.zeros(256, bool)
for _c in b"0123456789abcdef":
    _IS_HEX[_c] = True


def base_spans(text: str, hex_possible: bool = True) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the fixed patterns in code points, in order."""
    out = []
    low = text.lower()
    if any(h in low for h in HINTS):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST["assign"][1]]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= LEAST["access"][1]]
    if hex_possible:
        out += [(m.start(), 2, m.end()) for m in HEX.finditer(text) if len(m[0]) >= LEAST["hex"][1]]
    return sorted(out)


def _bucket(x: np.ndarray, edges: tuple) -> np.ndarray:
    return np.searchsorted(np.array(edges), x, side="right")


class Tokens:
    """Words of a block of rows with their byte spans, and their features."""

    def __init__(self, data: np.ndarray, bounds: np.ndarray):
        self.words, self.at = word_hashes(data, bounds)
        inside = ~_BREAK[data]
        first, last = np.ones(len(data), bool), np.ones(len(data), bool)
        first[1:], last[:-1] = ~inside[:-1], ~inside[1:]
        full = bounds[1:] > bounds[:-1]
        first[bounds[:-1][full]] = True
        last[bounds[1:][full] - 1] = True
        self.start, self.end = np.flatnonzero(inside & first), np.flatnonzero(inside & last) + 1
        self.row = np.repeat(np.arange(len(bounds) - 1), np.diff(self.at))
        kind = _CLASS[data]
        n = len(self.words)
        count = lambda mask: np.diff(np.concatenate(([0], np.cumsum(mask)))[np.stack((self.start, self.end))], axis=0)[0] if n else np.zeros(0, np.int64)
        self.size = self.end - self.start
        self.digits, self.uppers, self.lowers = count(kind == _DIGIT), count(kind == _UPPER), count(kind == _LOWER)
        self.symbols, self.hexes = count(kind == _SYMBOL), count(_IS_HEX[data])
        change, clash, twin = (np.zeros(len(data), bool) for _ in range(3))
        change[1:] = kind[1:] != kind[:-1]
        clash[1:] = _CONSONANT[data[1:]] & _CONSONANT[data[:-1]]
        twin[1:] = data[1:] == data[:-1]
        self.changes, self.clashes, self.twins = count(change), count(clash), count(twin)
        self.joints, self.dots, self.ats, self.slashes = (count(np.isin(data, list(c))) for c in (b"_-", b".", b"@", b"/"))
        self.filled = (data == ord("="))[self.end - 1] if n else np.zeros(0, bool)
        mixed = (self.uppers > 1) & (self.lowers > 0)
        self.odd = (self.size >= 8) & ((self.digits > 0) | mixed | (self.symbols > 2))
        parts = (data == ord(":")) | (data == ord("="))
        self.parted = parts[self.end - 1] if n else np.zeros(0, bool)
        self.parts = count(parts) > self.parted
        self.keys = np.zeros(n, bool)
        at = np.array([m.start() for m in KEYS.finditer(data.tobytes())], np.int64)
        self.keys[np.searchsorted(self.start, at, side="right") - 1] = True

    def shape(self) -> np.ndarray:
        present = sum((x > 0).astype(np.int64) << k for k, x in enumerate((self.digits, self.uppers, self.lowers, self.symbols)))
        share = _bucket(self.digits / np.maximum(self.size, 1), (0.01, 0.2, 0.4, 0.6, 0.8))
        pure = (self.hexes == self.size - self.symbols).astype(np.int64)
        return ((present * 6 + share) * 2 + pure) * 8 + _bucket(self.size, (4, 8, 12, 16, 20, 32, 64))

    def doubtful(self) -> np.ndarray:
        """Tokens that may be secrets which no pattern knows: long, of letters and digits in many changes."""
        return (self.size >= 16) & (self.digits > 1) & (self.uppers + self.lowers > 3) & (self.changes >= 0.2 * self.size)

    def cue(self) -> np.ndarray:
        """What announces a secret: a separator before the token, a key-like word before that, or both in the token."""
        n = len(self.words)
        back = lambda x, k: np.concatenate((np.zeros(min(k, n), x.dtype), x[: max(n - k, 0)]))
        near, far = (np.concatenate((np.zeros(min(k, n), bool), self.row[k:] == self.row[: max(n - k, 0)])) for k in (1, 2))
        bare = self.size == self.symbols
        key = near & (back(self.keys, 1) | (far & back(bare, 1) & back(self.keys, 2)))
        return ((near.astype(np.int64) + (near & back(self.parted, 1))) * 2 + key) * 4 + self.keys * 2 + self.parts

    def features(self) -> np.ndarray:
        """Codes of all tokens (tokens x features)."""
        n = len(self.words)
        who = np.arange(n)
        shape = self.shape()
        before, after = np.maximum(who - 1, 0), np.minimum(who + 1, n - 1)
        has_before = (who > 0) & (self.row[before] == self.row)
        has_after = (who < n - 1) & (self.row[after] == self.row)
        share = lambda x, edges: _bucket(x / self.size, edges)
        length = _bucket(self.size, (6, 12, 20))
        make = ((share(self.clashes, (0.2, 0.35, 0.5, 0.65)) * 6 + share(self.changes, (0.1, 0.2, 0.3, 0.45, 0.6))) * 2 + share(self.twins, (0.3,))) * 4 + length
        joined = ((np.minimum(self.joints, 3) * 4 + np.minimum(self.dots, 3)) * 2 + (self.ats > 0)) * 3 + np.minimum(self.slashes, 2)
        rows = len(self.at) - 1
        odd = np.bincount(self.row[self.odd], minlength=rows) / np.maximum(np.diff(self.at), 1)
        return np.stack((
            shape, make,
            np.where(has_before, (self.words[before] % np.uint64(SIZES[2] - 1)).astype(np.int64) + 1, 0),
            np.where(has_before, shape[before], 1) % SIZES[3], np.where(has_after, shape[after], 1) % SIZES[4],
            joined * 2 + self.filled, _bucket(odd, (0.01, 0.03, 0.1, 0.3))[self.row], self.cue() * 4 + length,
        ), axis=1)


class Field:
    """Weights of the field: one table a feature, transitions, and both ends of a run (outside)."""

    def __init__(self):
        self.tables = [np.zeros((n, 3)) for n in SIZES]
        self.step = np.zeros((3, 3))
        self.step[0, 2] = -8.0  # an inside follows a begin or an inside

    def scores(self, codes: np.ndarray) -> np.ndarray:
        return sum(t[codes[:, k]] for k, t in enumerate(self.tables))

    def open_tokens(self, scores: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Tokens that are not certainly outside, and the bounds of their runs within a row.

        A token of label y becomes an outside, and an inside after it a begin: if that gains for every y and all
        neighbours, the best labelling has an outside there.
        """
        step, n = self.step, len(scores)
        ahead = np.full(n, np.inf)  # what the token after gains as a begin, not an inside
        next_row = row[1:] == row[:-1]
        ahead[:-1][next_row] = (scores[1:, 1] - scores[1:, 2])[next_row] + (step[1] - step[2]).min()
        sure = np.ones(n, bool)
        for y in (1, 2):
            gain = scores[:, 0] - scores[:, y] + (step[:, 0] - step[:, y]).min()
            sure &= gain + np.minimum((step[0, :2] - step[y, :2]).min(), step[0, 1] - step[y, 2] + ahead) > 1e-6
        who = np.flatnonzero(~sure)
        fresh = np.ones(len(who), bool)
        fresh[1:] = (np.diff(who) != 1) | (row[who[1:]] != row[who[:-1]])
        return who, np.concatenate((np.flatnonzero(fresh), [len(who)]))

    def viterbi(self, scores: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Best labels of every run, all runs step by step together."""
        labels = np.zeros(len(scores), np.int64)
        if not len(scores):
            return labels
        size, begin = np.diff(bounds), bounds[:-1]
        order = np.argsort(-size, kind="stable")
        size, begin = size[order], begin[order]
        back = np.zeros((len(scores), 3), np.int64)
        best = self.step[0] + scores[begin]
        for t in range(1, size[0]):
            live = int(np.searchsorted(-size, -t, side="left"))
            total = best[:live, :, None] + self.step
            at = begin[:live] + t
            back[at] = total.argmax(axis=1)
            best[:live] = total.max(axis=1) + scores[at]
        label = (best + self.step[:, 0]).argmax(axis=1)
        for t in range(size[0] - 1, -1, -1):
            live = int(np.searchsorted(-size, -t, side="left"))
            at = begin[:live] + t
            labels[at] = label[:live]
            label[:live] = back[at, label[:live]]
        return labels

    def fit(self, codes: np.ndarray, labels: np.ndarray, bounds: np.ndarray, rounds: int = 50, rate: float = 0.5, decay: float = 0.02, weights: np.ndarray | None = None) -> Field:
        """Maximum likelihood with a Gaussian prior: exact gradients by scaled forward-backward, AdaGrad steps; a run counts ``weights`` times."""
        size = np.diff(bounds)
        width, runs = int(size.max()), len(size)
        often = np.ones(runs) if weights is None else weights
        at = np.minimum(bounds[:-1, None] + np.arange(width), len(codes) - 1)
        held = np.arange(width) < size[:, None]
        gold = np.where(held, labels[at], 0)
        seen = [np.full_like(t, 1e-8) for t in [*self.tables, self.step]]
        truth, each = np.eye(3)[labels], np.repeat(often, size)[:, None]
        on = held[:, 1:]
        known = np.bincount((gold[:, :-1] * 3 + gold[:, 1:])[on], weights=np.broadcast_to(often[:, None], on.shape)[on], minlength=9).reshape(3, 3)
        for _ in range(rounds):
            score = self.scores(codes)
            emit = np.where(held[..., None], np.exp(score - score.max(axis=1, keepdims=True))[at], np.array([1.0, 0.0, 0.0])).transpose(1, 0, 2)
            jump = np.exp(self.step)
            ahead, behind = np.zeros((width, runs, 3)), np.zeros((width, runs, 3))
            ahead[0] = jump[0] * emit[0]
            for t in range(1, width):
                ahead[t - 1] /= ahead[t - 1].sum(axis=1, keepdims=True)
                ahead[t] = (ahead[t - 1] @ jump) * emit[t]
            behind[-1] = jump[:, 0]
            for t in range(width - 2, -1, -1):
                behind[t] = (emit[t + 1] * behind[t + 1]) @ jump.T
                behind[t] /= behind[t].sum(axis=1, keepdims=True)
            chance = ahead * behind
            chance /= chance.sum(axis=2, keepdims=True)
            flat = np.zeros((len(codes), 3))
            flat[at[held]] = chance.transpose(1, 0, 2)[held]
            coming = emit[1:] * behind[1:]
            share = often * on.T / ((ahead[:-1] @ jump) * coming).sum(axis=2)
            moves = known - jump * ((ahead[:-1] * share[..., None]).reshape(-1, 3).T @ coming.reshape(-1, 3))
            wrong = (truth - flat) * each
            moves[0] += wrong[bounds[:-1]].sum(axis=0)
            slopes = []
            for k, table in enumerate(self.tables):
                slope = np.stack([np.bincount(codes[:, k], weights=wrong[:, y], minlength=len(table)) for y in range(3)], axis=1)
                slopes.append(slope - decay * table)
            slopes.append(moves - decay * self.step)
            for own, slope, past in zip([*self.tables, self.step], slopes, seen, strict=True):
                past += slope**2
                own += rate * slope / np.sqrt(past)
        self.step[0, 2] = -1e9
        return self


def _rows(column: pa.Array):
    """For each block: first and last row, data, bounds, tokens and codes."""
    data, offsets = utf8_view(column)
    for start, end in blocks(offsets, BLOCK_BYTES):
        own = offsets[start : end + 1]
        part, bounds = data[own[0] : own[-1]], own - own[0]
        tokens = Tokens(part, bounds)
        yield start, end, part, bounds, tokens, tokens.features()


def _byte_spans(text: str, raw: bytes, spans) -> list[tuple[int, int]]:
    """Spans of secrets' values in bytes: for assignments the value, without its name."""
    out = []
    for start, kind, end in spans:
        if kind == 0:
            m = ASSIGN.match(text, start)
            start = m.start(2)
        out.append((len(text[:start].encode()), len(text[:end].encode())))
    return out


def _pieces(tokens: Tokens, label: np.ndarray):
    """Bounds of the pieces of every row; none ends within a secret."""
    for a, end in zip(tokens.at.tolist(), tokens.at[1:].tolist(), strict=False):
        while a < end:
            b = min(a + PIECE, end)
            while b < end and label[b] == 2:
                b += 1
            yield a, b
            a = b


def _labels(tokens: Tokens, bounds: np.ndarray, spans: list[list[tuple[int, int]]]) -> np.ndarray:
    """Labels of all tokens from the byte spans of each row."""
    label = np.zeros(len(tokens.words), np.int64)
    for zero, own in zip(bounds.tolist(), spans, strict=False):
        for a, b in own:
            i, j = np.searchsorted(tokens.end, zero + a, side="right"), np.searchsorted(tokens.start, zero + b, side="left")
            label[i:j] = 2
            label[i] = 1
    return label


def _lessons(texts: list[str], draws: list[int], without: frozenset[str] = frozenset()):
    """(draw, piece, codes, labels, plain) of the pieces of each text as it is, and of those that hold drawn forms."""
    natural = [_byte_spans(t, t.encode(), base_spans(t)) for t in texts]
    ways = [(texts, natural, None)]
    for way in range(1, WAYS):
        mixed = [secret_forms.sprinkle(t, random.Random(d * WAYS + way), without) for t, d in zip(texts, draws, strict=True)]
        ways.append(([m[0] for m in mixed], [_byte_spans(t, t.encode(), base_spans(t)) + spans for t, spans, _ in mixed], [m[2] for m in mixed]))
    for kind, (shown, spans, forms) in enumerate(ways):
        for start, end, _, bounds, tokens, codes in _rows(pa.array(shown, pa.string())):
            label = _labels(tokens, bounds, spans[start:end])
            odd = np.concatenate(([0], np.cumsum(tokens.odd | tokens.parts | tokens.parted | tokens.keys | (label > 0))))
            told = _labels(tokens, bounds, forms[start:end]) > 0 if kind else np.zeros(len(label), bool)
            drawn = np.concatenate(([0], np.cumsum(told)))
            doubt = np.concatenate(([0], np.cumsum(tokens.doubtful() & (label == 0) & ~told)))
            for k, (a, b) in enumerate(_pieces(tokens, label)):
                if doubt[a] < doubt[b]:
                    continue
                plain = not kind and bool(odd[a] == odd[b])
                if drawn[a] < drawn[b] if kind else not plain or int(tokens.words[a:b].sum()) % PLAIN == 0:
                    yield draws[start + tokens.row[a]], WAYS * k + kind, codes[a:b].astype(np.int16).tobytes(), label[a:b].astype(np.int8).tobytes(), plain


def train(docs: DataFrame, most: int = TRAIN_DOCS, without: frozenset[str] = frozenset()) -> Field | None:
    """A field fitted to a sample of at most ``most`` unlike rows; None if the sample has no words.

    Rows are drawn by a hash of id and text. Where ids are null or repeat, rows that are equal count as one, so the bound holds
    for any table; the threshold is the ``most``-th draw, found from numbers alone. Families of drawn forms in ``without``
    (:mod:`strandloom.llm.secret_forms`) are held out, to measure what the field makes of forms that it has not met.
    """
    total = docs.count()
    share = min(1 << 62, (1 << 62) * 2 * most // max(total, 1) + 1)
    drawn = docs.select("text", F.shiftright(F.xxhash64("doc_id", "text"), 1).bitwiseAND(F.lit((1 << 62) - 1)).alias("draw")).filter(F.col("draw") < share)
    last = drawn.select("draw").distinct().orderBy("draw").limit(most).agg(F.max("draw")).first()[0]
    sample = drawn.filter(F.col("draw") <= (-1 if last is None else last)).groupBy("draw").agg(F.first("text").alias("text")).select("text", "draw")
    kinds = (pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.bool_())

    def run(batches):
        for batch in batches:
            rows = list(_lessons([t or "" for t in batch.column("text").to_pylist()], batch.column("draw").to_pylist(), without))
            columns = list(zip(*rows, strict=True)) if rows else [(), (), (), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["draw", "k", "codes", "labels", "plain"])

    runs = sample.mapInArrow(run, T.StructType.fromDDL("draw bigint, k bigint, codes binary, labels binary, plain boolean"))
    got = runs.orderBy("draw", "k", "codes").limit(TRAIN_RUNS).collect()
    codes = [np.frombuffer(x["codes"], np.int16).reshape(-1, len(SIZES)) for x in got]
    labels = [np.frombuffer(x["labels"], np.int8) for x in got]
    if not any(x.any() for x in labels):
        return None
    bounds = np.concatenate(([0], np.cumsum([len(x) for x in labels])))
    weights = np.where([x["plain"] for x in got], float(PLAIN), 1.0)
    return Field().fit(np.concatenate(codes).astype(np.int64), np.concatenate(labels).astype(np.int64), bounds, weights=weights)


def _apart(base: list[tuple[int, int, int]], added: list[tuple[int, int]]) -> list[tuple[int, int, int]]:
    """The added spans (in order) that meet no base span."""
    out, at, reach = [], 0, -1
    for s, e in added:
        while at < len(base) and base[at][0] < e:
            reach = max(reach, base[at][2])
            at += 1
        if reach <= s:
            out.append((s, KINDS.index("crf"), e))
    return out


def _found(field: Field, part: np.ndarray, bounds: np.ndarray, tokens: Tokens, codes: np.ndarray) -> dict[int, list[tuple[int, int]]]:
    """Spans of the field in code points, by row of the block."""
    found: dict[int, list[tuple[int, int]]] = {}
    scores = field.scores(codes)
    who, runs = field.open_tokens(scores, tokens.row)
    label = field.viterbi(scores[who], runs)
    opened = np.flatnonzero(label == 1)
    if not len(opened):
        return found
    signs = np.concatenate(([0], np.cumsum((part & 0xC0) != 0x80)))  # code points before each byte
    for i in opened.tolist():
        j = i + 1
        while j < len(label) and label[j] == 2 and who[j] == who[j - 1] + 1:
            j += 1
        first, last = int(who[i]), int(who[j - 1])
        row, a, b = int(tokens.row[first]), int(tokens.start[first]), int(tokens.end[last])
        zero, value = int(signs[bounds[row]]), VALUE.match(part[a:b].tobytes().decode())
        found.setdefault(row, []).append((int(signs[a]) - zero + value.start(1), int(signs[a]) - zero + value.end(1)))
    return found


def scan(docs: DataFrame, field: Field | None) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256 and spans of every whole text."""
    schema = T.StructType.fromDDL("doc_id bigint, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string")

    def run(batches):
        for batch in batches:
            texts, out = batch.column("text").to_pylist(), []
            for start, end, part, bounds, tokens, codes in _rows(batch.column("text")):
                hexes = np.zeros(end - start, bool)
                hexes[tokens.row[tokens.hexes >= LEAST["hex"][1]]] = True
                found = _found(field, part, bounds, tokens, codes) if field is not None and len(codes) else {}
                for r in range(start, end):
                    base = base_spans(texts[r] or "", bool(hexes[r - start]))
                    spans = base + _apart(base, found.get(r - start, []))
                    said = [",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in sorted(x)) for x in (base, spans)]
                    out.append((*(sum(x[1] == k for x in base) for k in range(3)), hashlib.sha256(said[0].encode()).hexdigest(), said[1]))
            columns = list(zip(*out, strict=True)) if out else [()] * 5
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], schema.names)

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    return scan(docs, train(docs))
