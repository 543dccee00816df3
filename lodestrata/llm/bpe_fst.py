"""Byte-level BPE by a lazily determinised finite-state transducer.

The merges are compiled from the ranks alone. A sequence of tokens is the
encoding of its bytes if and only if each two neighbours are: when both grow
from their bytes by their own merges, no merge across their border ever comes
first. So every prefix of a piece has one last token, whose start is again a
prefix with one last token. Reading bytes, the transducer keeps all starts from
which a token can still reach ahead, each with the last token before it and the
tokens not yet written; that tuple is a state. What the pending tokens of all
starts have in common is written at once, which bounds the lookahead by the
longest token and lets states recur. States and transitions are made when first
met, and dropped together when they grow past a bound (they are a cache).

Decoding feeds the tokens' bytes to an incremental UTF-8 state machine, which gives
text as soon as a character is whole, however the bytes are split. What the machine
does with a token from its initial state, where it mostly is, is kept per token; a
token that leaves it amid a character, or meets it there, goes through byte by byte.

Edge cases: null and empty texts have no tokens, and the digests of no bytes;
text that looks like a special token is ordinary text; repeated rows are encoded
alike; empty tables give empty results; only doc_id and text are read.
"""

from __future__ import annotations

import base64
import gc
import hashlib
from collections.abc import Callable, Iterable, Iterator
from itertools import chain

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from lodestrata.llm.common import in_arrow, steps, text_docs

MAX_TRANSITIONS = 450_000
MAX_PIECES = 250_000
#: A vocabulary file above this isn't broadcast.
MAX_VOCABULARY_BYTES = 64 << 20
RESULT = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
_NONE = 1 << 60
_STARTS = -1


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        data = f.read(MAX_VOCABULARY_BYTES + 1)
    if len(data) > MAX_VOCABULARY_BYTES:
        raise ValueError(f"{path} is larger than {MAX_VOCABULARY_BYTES} bytes")
    return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, data.splitlines()) if token}


class Transducer:
    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.ranks = ranks
        self.bytes_of = {i: t for t, i in ranks.items()}
        # a trie: of each node its children by byte, or None, and its token or -1
        self.child: list[dict[int, int] | None] = [{}]
        self.token: list[int] = [-1]
        for t, i in ranks.items():
            node = 0
            for b in t:
                below = self.child[node]
                if below is None:
                    below = self.child[node] = {}
                node = below.setdefault(b, len(self.token))
                if node == len(self.token):
                    self.token.append(-1)
                    self.child.append(None)
            self.token[node] = i
        self.edges: dict[int, tuple[list[tuple[bytes, int]], list[tuple[bytes, int]]]] = {}
        self.fits: dict[tuple[int, int], bool] = {}
        self._forget()

    def _forget(self) -> None:
        # a state is a dict: byte -> (state, tokens written); its starts stand under _STARTS
        starts = ((0, -1, ()),)
        self.start: dict = {_STARTS: starts}
        self.states = {starts: self.start}
        self.transitions = 0

    def _parts(self, token: int) -> tuple[list[tuple[bytes, int]], list[tuple[bytes, int]]]:
        """What stands at the left and at the right end of a token as it grows from bytes: (bytes, time it appears)."""
        found = self.edges.get(token)
        if found is None:
            whole = self.bytes_of[token]
            parts = [whole[i : i + 1] for i in range(len(whole))]
            left, right = [(parts[0], -1)], [(parts[-1], -1)]
            while len(parts) > 1:
                rank, i = min((self.ranks.get(a + b, _NONE), i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)))
                if rank == _NONE:
                    break
                parts[i : i + 2] = [parts[i] + parts[i + 1]]
                if i == 0:
                    left.append((parts[0], rank))
                if i == len(parts) - 1:
                    right.append((parts[-1], rank))
            found = self.edges[token] = (left, right)
        return found

    def neighbours(self, a: int, b: int) -> bool:
        """Whether the tokens stay apart: no merge over their border is due before their own next merges there."""
        known = self.fits.get((a, b))
        if known is not None:
            return known
        right, left = self._parts(a)[1], self._parts(b)[0]
        i = j = 0
        apart = True
        while True:
            across = self.ranks.get(right[i][0] + left[j][0], _NONE)
            next_a = right[i + 1][1] if i + 1 < len(right) else _NONE
            next_b = left[j + 1][1] if j + 1 < len(left) else _NONE
            # of equal ranks the leftmost goes first: a's own, then across, then b's own
            if across < next_a and across <= next_b and across != _NONE:
                apart = False
                break
            if next_a == next_b == _NONE:
                break
            if next_a <= next_b:
                i += 1
            else:
                j += 1
        if len(self.fits) > MAX_TRANSITIONS:
            self.fits.clear()
        self.fits[a, b] = apart
        return apart

    def _move(self, state: dict, byte: int) -> tuple[dict, tuple[int, ...]]:
        child, tokens, fits = self.child, self.token, self.fits
        starts, end, least = [], None, _NONE
        for node, last, pending in state[_STARTS]:
            to = child[node].get(byte)
            if to is None:
                continue
            if end is None and (token := tokens[to]) >= 0:
                apart = last < 0 or fits.get((last, token))
                if apart or (apart is None and self.neighbours(last, token)):
                    end = (0, token, (*pending, token))
            if child[to]:
                starts.append((to, last, pending))
                least = min(least, len(pending))
        if end is None:
            raise ValueError(f"byte {byte} can't be encoded with this vocabulary")
        starts.append(end)
        written = ()
        if least:  # what all pending tokens have in common
            common, first = 0, end[2]
            least = min(least, len(first))
            while common < least and all(s[2][common] == first[common] for s in starts):
                common += 1
            if common:
                written = first[:common]
                starts = [(node, last, pending[common:]) for node, last, pending in starts]
        key = tuple(starts)
        to = self.states.get(key)
        if to is None:
            to = self.states[key] = {_STARTS: key}
        self.transitions += 1
        found = state[byte] = (to, written)
        return found

    def encode(self, piece: bytes) -> tuple[int, ...]:
        """Ids of one piece of the pattern."""
        whole = self.ranks.get(piece)
        if whole is not None:
            return (whole,)
        if self.transitions > MAX_TRANSITIONS:
            self._forget()
        state, out = self.start, []
        for b in piece:
            found = state.get(b)
            state, written = found if found is not None else self._move(state, b)
            if written:
                out += written
        return (*out, *state[_STARTS][-1][2])  # the last start is the end of what was read


class Utf8Stream:
    """Incremental UTF-8: ``feed`` returns the text that is whole; bytes that can't be part of any become U+FFFD."""

    def __init__(self) -> None:
        self.held = b""
        self.left = 0
        self.low, self.high = 0x80, 0xBF

    def feed(self, data: bytes) -> str:
        if not self.left and data.isascii():
            return data.decode("ascii")
        out = []
        for b in data:
            if self.left:
                if self.low <= b <= self.high:
                    self.held += bytes((b,))
                    self.left -= 1
                    self.low, self.high = 0x80, 0xBF
                    if not self.left:
                        out.append(self._character())
                        self.held = b""
                    continue
                out.append("�")
                self._reset()
            if b < 0x80:
                out.append(chr(b))
            elif 0xC2 <= b <= 0xF4:
                self.held, self.left = bytes((b,)), 1 + (b >= 0xE0) + (b >= 0xF0)
                self.low = 0xA0 if b == 0xE0 else 0x90 if b == 0xF0 else 0x80
                self.high = 0x9F if b == 0xED else 0x8F if b == 0xF4 else 0xBF
            else:
                out.append("�")
        return "".join(out)

    def _character(self) -> str:
        point = self.held[0] & (0x3F >> (len(self.held) - 1))
        for b in self.held[1:]:
            point = point << 6 | b & 0x3F
        return chr(point)

    def _reset(self) -> None:
        self.held, self.left, self.low, self.high = b"", 0, 0x80, 0xBF

    def close(self) -> str:
        cut = bool(self.left)
        self._reset()
        return "�" if cut else ""


class _Pieces(dict):
    """piece -> ids; filled as pieces come. When large, what it holds steps back a generation and what was there goes."""

    def __init__(self, transducer: Transducer) -> None:
        self.transducer = transducer
        self.older: dict[str, tuple[int, ...]] = {}

    def __missing__(self, piece: str) -> tuple[int, ...]:
        if len(self) > MAX_PIECES:
            self.older = dict(self)
            self.clear()
        ids = self.older.get(piece)
        if ids is None:
            ids = self.transducer.encode(piece.encode())
        self[piece] = ids
        return ids


class Codec:
    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        self.transducer = Transducer(ranks)
        self.find: Callable[[str], list[str]] = regex.compile(pattern).findall
        self.pieces = _Pieces(self.transducer)
        self.bytes_of = [self.transducer.bytes_of.get(i) for i in range(max(ranks.values(), default=-1) + 1)]
        #: Of each token, what the machine gives for it from its initial state, if it is there again afterwards.
        self.texts = [None if t is None else self._text(t) for t in self.bytes_of]

    def encode(self, text: str) -> list[int]:
        return list(chain.from_iterable(map(self.pieces.__getitem__, self.find(text))))

    @staticmethod
    def _text(token: bytes) -> str | None:
        stream = Utf8Stream()
        text = stream.feed(token)
        return None if stream.left else text

    def decode(self, ids: Iterable[int]) -> Iterator[str]:
        """Text in pieces, each as soon as it is whole."""
        stream, texts = Utf8Stream(), self.texts
        for i in ids:
            text = texts[i] if not stream.left else None
            if text is None:
                text = stream.feed(self.bytes_of[i])
            if text:
                yield text
        if text := stream.close():
            yield text

    def decoded(self, ids: list[int]) -> str:
        """The whole text; where no token leaves the machine amid a character, all its steps are known."""
        try:
            return "".join(map(self.texts.__getitem__, ids))
        except TypeError:  # None: such a token
            return "".join(self.decode(ids))


def _digests(ranks, pattern: str, keep_ids: bool):
    fields = [("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())]
    schema = pa.schema([*fields, *([("ids", pa.list_(pa.int32()))] if keep_ids else [])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(ranks.value, pattern)  # of this task: a worker that waits holds no caches
        names = [b"%d" % i for i in range(len(codec.bytes_of))]
        gc.disable()  # the caches are many small objects without cycles
        try:
            for doc_ids, texts in steps(batches):
                rows, kept = [], []
                for text in texts:
                    ids = codec.encode(text.decode("utf-8", "replace"))
                    rows.append((len(ids), hashlib.sha256(b" ".join(map(names.__getitem__, ids))).hexdigest(), hashlib.sha256(codec.decoded(ids).encode()).hexdigest()))
                    if keep_ids:
                        kept.append(ids)
                columns = [pa.array(doc_ids, pa.int64()), *(pa.array(list(c), f[1]) for c, f in zip(zip(*rows, strict=True), fields[1:], strict=True))]
                yield pa.RecordBatch.from_arrays([*columns, *([pa.array(kept, pa.list_(pa.int32()))] if keep_ids else [])], schema=schema)
        finally:
            gc.enable()

    return run


def encoded(spark: SparkSession, docs: DataFrame, path: str, pattern: str, keep_ids: bool = False) -> DataFrame:
    """Count and digests of the ids of each text; with ``keep_ids`` the ids too."""
    ranks = spark.sparkContext.broadcast(read_ranks(path))
    return in_arrow(text_docs(docs), _digests(ranks, pattern, keep_ids), RESULT + ", ids array<int>" * keep_ids)
