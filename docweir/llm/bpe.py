"""Byte-level BPE: encoding by a finite-state transducer that is determinised as texts are read,
decoding by an incremental UTF-8 state machine.

Encoding. A sequence of tokens is what BPE makes of its bytes if and only if every token is what BPE
makes of its own bytes and every two neighbours are what BPE makes of theirs. So the merges compile
into a nondeterministic transducer: it reads bytes along a trie of the vocabulary, and may end a
token where that token may follow the last one. For each prefix of the input just one path ends a
token there. Subsets of its states, each with the tokens that it has still to emit, are the states
of the deterministic transducer; what all paths of a subset share is emitted at once, which is after
as many bytes as the longest token has at most. States are made when they are first met and are all
forgotten when there are too many. Pairs are tested once each, by undoing the merges of both.

Decoding. Bytes go through a state machine for UTF-8; what a token does to each state is worked out
once, when it is first met there, so that texts can be decoded token by token as they come.
"""

from __future__ import annotations

import base64
import gc
import hashlib
import sys
from array import array
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_map, cache

MAX_STATES, MAX_PAIRS, MAX_PIECES = 150_000, 200_000, 80_000
NONE = 1 << 60


def read_ranks(data: bytes) -> dict[bytes, int]:
    """Ranks from a file of lines of a base64 token and its rank."""
    return {base64.b64decode(a): int(b) for a, b in (x.split() for x in data.splitlines() if x.strip())}


class Transducer:
    """Encodes one piece of bytes at a time."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.token = {i: t for t, i in ranks.items()}
        self.made_of: dict[int, tuple[int, int]] = {}
        self.pairs: dict[tuple[int, int], bool] = {}
        # The trie: node * 256 + byte -> (node, or -1 for a leaf; the token that ends there, or -1).
        prefixes = {t[:i] for t in ranks for i in range(1, len(t))}
        number = {b"": 0} | {p: i for i, p in enumerate(sorted(prefixes), 1)}
        self.child = {number[t[:-1]] * 256 + t[-1]: (number.get(t, -1), ranks.get(t, -1)) for t in prefixes | ranks.keys()}
        self._forget()

    def _forget(self) -> None:
        #: A state: its paths (node, last token, tokens to emit), and by byte its steps, and at 256
        #: more what it emits if that byte is the last.
        self.start = (((0, -1, ()),), {})
        self.states = {self.start[0]: self.start}

    def merged(self, piece: bytes) -> list[int]:
        """BPE by its definition: merge the leftmost pair of the least rank until none is left."""
        parts = [piece[i : i + 1] for i in range(len(piece))]
        ranks = self.ranks
        while len(parts) > 1:
            best = min((ranks.get(parts[i] + parts[i + 1], 1 << 60), i) for i in range(len(parts) - 1))
            if best[0] == 1 << 60:
                break
            i = best[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return [ranks[p] for p in parts]

    def _halves(self, t: int) -> tuple[int, int]:
        """The two tokens whose merge makes t from its own bytes; (t, t) for a single byte, (-1, -1)
        if its bytes don't become t."""
        have = self.made_of.get(t)
        if have is None:
            parts = [self.ranks[self.token[t][i : i + 1]] for i in range(len(self.token[t]))]
            have = (t, t) if len(parts) == 1 else (-1, -1)
            while len(parts) > 1:
                best = min((self._merge(parts[i], parts[i + 1]), i) for i in range(len(parts) - 1))
                if best[0] == NONE:
                    have = (-1, -1)
                    break
                i = best[1]
                have = (parts[i], parts[i + 1])
                parts[i : i + 2] = [best[0]]
            self.made_of[t] = have
        return have

    def _merge(self, a: int, b: int) -> int:
        return self.ranks.get(self.token[a] + self.token[b], NONE)

    def _follows(self, a: int, b: int) -> bool:
        """Whether BPE can leave b right after a (-1: at the start)."""
        if self._halves(b)[0] < 0:
            return False
        if a < 0:
            return True
        ok = self.pairs.get((a, b))
        if ok is None:
            if len(self.pairs) >= MAX_PAIRS:
                self.pairs.clear()
            ok = self.pairs[a, b] = self._apart(a, b)
        return ok

    def _apart(self, a: int, b: int) -> bool:
        """Undoes the merges inside a and b, the latest first: the two stay apart unless the tokens at
        the border of the two could merge before the next merge inside one of them took place."""
        before = NONE
        while True:
            if self._merge(a, b) < before:
                return False
            left, right = self._halves(a)[1], self._halves(b)[0]
            # the merge inside a precedes one of the same rank inside b, as it is further left
            if left != a and (a > b or right == b):
                before, a = a, left
            elif right != b:
                before, b = b + 1, right
            else:
                return True

    def _step(self, state: tuple, b: int) -> tuple[tuple, tuple[int, ...]]:
        paths, ended, child, pairs = [], None, self.child, self.pairs
        for node, last, todo in state[0]:
            to = child.get(node * 256 + b)
            if to is None:
                continue
            node, t = to
            if node >= 0:
                paths.append((node, last, todo))
            # just one path ends a token here; the rest need no test
            if t >= 0 and ended is None:
                ok = pairs.get((last, t))
                if ok or ok is None and self._follows(last, t):
                    ended = (0, t, (*todo, t))
        paths.append(ended)
        n = 0
        if paths[0][2]:
            first, short = ended[2], min([len(p[2]) for p in paths])
            while n < short and all([p[2][n] == first[n] for p in paths]):
                n += 1
            if n:
                paths = [(node, last, todo[n:]) for node, last, todo in paths]
        key = tuple(paths)
        after = self.states.get(key)
        if after is None:
            if len(self.states) >= MAX_STATES:
                self._forget()
            after = self.states[key] = (key, {})
        step = state[1][b] = (after, first[:n] if n else ())
        return step

    def _last(self, state: tuple, b: int) -> tuple[int, ...]:
        """What a state emits when b ends the piece: no state is made for what can't go on."""
        for node, last, todo in state[0]:
            to = self.child.get(node * 256 + b)
            if to is not None and to[1] >= 0:
                ok = self.pairs.get((last, to[1]))
                if ok or ok is None and self._follows(last, to[1]):
                    done = state[1][b + 256] = (*todo, to[1])
                    return done
        raise AssertionError("a byte without a token")

    def encode(self, piece: bytes) -> list[int]:
        out: list[int] = []
        state = self.start
        for b in piece[:-1]:
            state, done = state[1].get(b) or self._step(state, b)
            if done:
                out += done
        for b in piece[-1:]:
            out += state[1].get(b + 256) or self._last(state, b)
        return out


class Utf8:
    """What a UTF-8 reader holds is the bytes of a sequence that isn't complete: its state."""

    def __init__(self, token: dict[int, bytes]):
        self.token = token
        self.steps: dict[bytes, dict[int, tuple[bytes, str]]] = {b"": {}}
        self.whole = _Whole(self)

    @staticmethod
    def feed(held: bytes, byte: int) -> tuple[bytes, str]:
        """One byte: what is held then, and the text that is complete. Wrong bytes give U+FFFD."""
        if held:
            lead = held[0]
            need = 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4
            low, high = 0x80, 0xBF
            if len(held) == 1:  # no overlong forms, surrogates or values past U+10FFFF
                low = {0xE0: 0xA0, 0xF0: 0x90}.get(lead, low)
                high = {0xED: 0x9F, 0xF4: 0x8F}.get(lead, high)
            if low <= byte <= high:
                held += bytes([byte])
                return (b"", held.decode()) if len(held) == need else (held, "")
            now, text = Utf8.feed(b"", byte)
            return now, "�" + text
        if byte < 0x80:
            return b"", chr(byte)
        return (bytes([byte]), "") if 0xC2 <= byte <= 0xF4 else (b"", "�")

    def _step(self, held: bytes, t: int) -> tuple[bytes, str]:
        now, text = held, ""
        for b in self.token[t]:
            now, more = self.feed(now, b)
            text += more
        self.steps.setdefault(held, {})[t] = (now, text)
        self.steps.setdefault(now, {})
        return now, text

    def text(self, ids: list[int]) -> str:
        """The text of all ids. Where each token is a run of whole characters the machine is back at
        its start after each, and the tokens' texts are joined at once."""
        try:
            return "".join(map(self.whole.__getitem__, ids))
        except KeyError:
            return "".join(self.stream(ids))

    def stream(self, ids: Iterable[int]) -> Iterator[str]:
        """The text that each id completes, then what remains."""
        held = b""
        for t in ids:
            held, text = self.steps[held].get(t) or self._step(held, t)
            yield text
        if held:
            yield "�"


class _Whole(dict):
    """The texts of tokens that take the machine from its start to its start; others are no keys."""

    def __init__(self, machine: Utf8):
        self.machine = machine

    def __missing__(self, t: int) -> str:
        held, text = self.machine._step(b"", t)
        if held:
            raise KeyError(t)
        self[t] = text
        return text


class _Pieces(dict):
    """Piece of text -> its ids. When there are too many, those not met since the last time go."""

    def __init__(self, machine: Transducer):
        self.machine = machine
        self.older: dict[str, tuple[int, ...]] = {}

    def __missing__(self, piece: str) -> tuple[int, ...]:
        ids = self.older.get(piece)
        if ids is None:
            raw = piece.encode()
            whole = self.machine.ranks.get(raw)
            ids = (whole,) if whole is not None else tuple(self.machine.encode(raw))
            if len(raw) > 64:
                return ids
        if len(self) >= MAX_PIECES:
            self.older = dict(self)
            self.clear()
        self[piece] = ids
        return ids


class Tokenizer:
    """Splits texts by a pattern and encodes each match; no special tokens."""

    def __init__(self, ranks_file: bytes, pattern: str):
        import regex

        ranks = read_ranks(ranks_file)
        self.split = regex.compile(pattern).findall
        self.machine = Transducer(ranks)
        self.pieces = _Pieces(self.machine)
        self.utf8 = Utf8(self.machine.token)

    def encode(self, text: str) -> list[int]:
        return list(chain.from_iterable(map(self.pieces.__getitem__, self.split(text))))

    def decode(self, ids: list[int]) -> str:
        return self.utf8.text(ids)


def tokenizer(ranks_file: bytes, pattern: str) -> Tokenizer:
    """One for each worker and vocabulary."""
    made, key = cache("bpe"), hashlib.sha256(ranks_file + pattern.encode()).hexdigest()
    if key not in made:
        made[key] = Tokenizer(ranks_file, pattern)
        gc.set_threshold(200_000, 20, 100)  # it holds many small tuples and no cycles
    return made[key]


def default_vocabulary() -> tuple[str, str]:
    """Path of the rank file and pattern of the public tokenizers that the machine offers."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def _texts(batch: pa.RecordBatch, name: str) -> Iterator[str]:
    for raw in batch.column(batch.schema.get_field_index(name)).cast(pa.binary()):
        raw = raw.as_py()
        yield raw.decode("utf-8", "replace") if raw else ""


def _little(ids: list[int]) -> bytes:
    """The ids as little-endian unsigned 32-bit integers."""
    a = array("I", ids)
    if sys.byteorder == "big":
        a.byteswap()
    return a.tobytes()


def _vocabulary(spark: SparkSession, path: str | None, pattern: str | None):
    own_path, own_pattern = (path, pattern) if path and pattern else default_vocabulary()
    with open(path or own_path, "rb") as f:  # the vocabulary lies with the driver; a broadcast takes its megabyte along
        return spark.sparkContext.broadcast((f.read(), pattern or own_pattern))


def encoded(docs: DataFrame, path: str | None = None, pattern: str | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and ids (array of int) of each row of docs; a null text counts as empty and has none.

    Rows are independent: repeated rows, null ids and other columns don't matter; no rows give none.
    """
    voc = _vocabulary(docs.sparkSession, path, pattern)

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        t = tokenizer(*voc.value)
        ids = [np.array(t.encode(x), np.int32) for x in _texts(b, "text")]
        offsets = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
        return pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(ids)))], ["doc_id", "ids"])

    return arrow_map(docs, [F.col(doc_id).alias("doc_id"), F.col(text).alias("text")], run, "doc_id long, ids array<int>", "bpe")


def decoded(tokens: DataFrame, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """doc_id and text of each row (doc_id, ids); null ids count as none, unknown ids as U+FFFD."""
    voc = _vocabulary(tokens.sparkSession, path, pattern)

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        t = tokenizer(*voc.value)
        known = t.machine.token
        out = []
        for x in b.column(1).to_pylist():
            x = x or []
            out.append(t.decode(x) if all(i in known for i in x) else "".join(t.decode([i]) if i in known else "�" for i in x))
        return pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.string())], ["doc_id", "text"])

    return arrow_map(tokens, ["doc_id", "ids"], run, "doc_id long, text string", "bpe")


def token_digests(docs: DataFrame, path: str | None = None, pattern: str | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of each row of docs: the ids as little-endian
    unsigned 32-bit integers, and the UTF-8 bytes of the text that they decode to."""
    voc = _vocabulary(docs.sparkSession, path, pattern)

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        t = tokenizer(*voc.value)
        n, ids_hash, text_hash = [], [], []
        for x in _texts(b, "text"):
            ids = t.encode(x)
            n.append(len(ids))
            ids_hash.append(hashlib.sha256(_little(ids)).hexdigest())
            text_hash.append(hashlib.sha256(t.decode(ids).encode()).hexdigest())
        return pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(ids_hash), pa.array(text_hash)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return arrow_map(docs, [F.col(doc_id).alias("doc_id"), F.col(text).alias("text")], run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", "bpe")


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_digests(spark.read.parquet(f"{sf_dir}/documents.parquet"))
