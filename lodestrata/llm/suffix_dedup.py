"""Suffix-array dedup: removes every byte that a ``SPAN``-byte string covers which
also starts in a document with a smaller doc_id.

A suffix array of every byte isn't needed to find strings of ``SPAN`` bytes: of
the ``WINDOW`` strings of ``GRAM`` bytes in such a string the one with the least
hash is chosen, so two equal strings choose the same place. These places are the
anchors, about one in sixteen bytes.

1. Anchors are reduced in each task to sorted hashes and exchanged as packed
   runs; hashes that at least two different texts have survive.
2. Texts with survivors are written once, dealt by their key. The suffixes that
   start at their anchors (``SPAN`` bytes) are sorted in each task, front coded, and
   exchanged as packed runs, dealt by ranges of their first ``GRAM`` bytes; the
   bounds of the ranges come from a sample, which changes how even they are and
   nothing else. In each range a loser tree that knows the common prefix of each
   head with the last winner merges the runs, so that ranges one after the other
   are one sorted array; suffixes whose common prefix with the one before is at
   least ``GRAM`` bytes are a group. Beyond ``MAX_RANGES`` each range is dealt
   further by a hash of those bytes, so that what a task holds stays bounded.
3. In a group each suffix carries up to ``WINDOW - 1`` bytes before it. Strings of
   ``SPAN`` bytes around the anchor are equal where both sides agree far enough;
   a suffix gets the ranges whose strings a smaller doc_id in the group has too.
   These go back to where the texts were written, so texts move once.

Equal texts are one text throughout, owned by their smallest doc_id; the others
lose all bytes if they have ``SPAN`` or more. Texts are told apart by half of their
SHA-256 (128 bits). Texts with over a ``HOT``-th of all rows (so fewer than ``HOT``
of them) are broadcast with their owners, and their other copies are done with
before anything is dealt by text.

Edge cases: null and short texts keep all bytes; a null doc_id counts as larger
than any other; rows that repeat doc_id and text are the same document, and rows
that repeat a doc_id with other text don't remove each other's bytes; texts of any
length are worked on in windows of ``LONG`` bytes that overlap; an empty table gives
an empty result. Only doc_id and text are read; other columns of any name are
handed through by ``deduplicated_rows`` and ignored by ``deduplicated``.
"""

from __future__ import annotations

import gc
import hashlib
from bisect import bisect_left
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.llm.common import HOT, batch_of, drop_stashes, in_arrow, made, release, stash, steps, text_key
from lodestrata.llm.hashing import _BYTE, _P, _P_INV, _power, mix
from lodestrata.llm.loser_tree import front_coded, merged_front_coded

SPAN, GRAM = 50, 20
WINDOW = SPAN - GRAM + 1
#: Anchors that one packed group should hold; groups grow in number with the input, not in size.
GROUP_ANCHORS = 800_000
GROUP_SUFFIXES = 120_000
#: Ranges of suffixes whose bounds the driver holds, and sampled suffixes for each.
MAX_RANGES, SAMPLES = 4096, 48
#: What a task holds before it sends a run.
RUN_ANCHORS = 900_000
RUN_SUFFIXES = 120_000
#: Bytes of texts, and of one long text, that are worked on at once; a task holds about a hundred times as much meanwhile.
STEP_BYTES = LONG = 512 << 10
_NO_ID = 2**63 - 1
RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
_NOTHING = hashlib.sha256(b"").hexdigest()


def anchors(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, place, hash) of every anchor."""
    if len(texts) != 1 or len(texts[0]) <= LONG:
        return _anchors(texts)
    whole, found = texts[0], []
    for begin in range(0, len(whole), LONG):  # what decides about an anchor is less than SPAN bytes away
        first = max(0, begin - SPAN)
        _, at, h = _anchors([whole[first : begin + LONG + SPAN]])
        own = (at >= begin - first) & (at < begin - first + LONG)
        found.append((at[own] + first, h[own]))
    at, h = (np.concatenate(c) for c in zip(*found, strict=True))
    return np.zeros(len(at), dtype=np.int64), at, h


def _anchors(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    x = np.frombuffer(b"".join(texts), dtype=np.uint8)
    lengths = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
    none = np.zeros(0, dtype=np.int64)
    if len(x) < SPAN:
        return none, none, none.astype(np.uint64)
    sums = np.zeros(len(x) + 1, dtype=np.uint64)
    np.cumsum(_BYTE[x] * _power(_P, len(x)), out=sums[1:])
    n = len(x) - GRAM + 1
    h = mix((sums[GRAM:] - sums[:n]) * _power(_P_INV, len(x))[:n]) | np.uint64(1)
    least, size = h, 1
    while 2 * size < WINDOW:
        least, size = np.minimum(least[:-size], least[size:]), 2 * size
    least = np.minimum(least[: len(x) - SPAN + 1], least[WINDOW - size : WINDOW - size + len(x) - SPAN + 1])
    ends = np.cumsum(lengths)
    text = np.repeat(np.arange(len(texts)), lengths)
    starts = np.arange(len(least))
    least = np.where(starts + SPAN <= ends[text[: len(least)]], least, np.uint64(0))  # strings that end in another text don't count
    most = np.zeros(n, dtype=np.uint64)
    most[: len(least)] = least
    size = 1
    while 2 * size <= WINDOW:
        most[size:] = np.maximum(most[size:], most[:-size].copy())
        size *= 2
    rest = WINDOW - size
    if rest:
        most[rest:] = np.maximum(most[rest:], most[:-rest].copy())
    at = np.flatnonzero(most == h)
    own = text[at]
    return own, at - (ends - lengths)[own], h[at]


def _dealt(h: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(bucket of n, rest) of the hashes of anchors. These are the least of their windows, so most of them are small: they are mixed
    again, else the first bucket has most of all, or thirty times its share."""
    h = mix(h)
    return ((h >> np.uint64(32)) * np.uint64(n)) >> np.uint64(32), (h & np.uint64(0xFFFFFFFF)).astype(np.uint32)


def _keys(joined: bytes) -> np.ndarray:
    """Keys of texts, one after the other, as rows of two numbers."""
    return np.frombuffer(joined, np.uint64).reshape(-1, 2)


def _numbered(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different keys, and the number among them of each."""
    order = np.lexsort((keys[:, 1], keys[:, 0]))
    found = keys[order]
    new = np.concatenate((np.ones(min(1, len(found)), bool), (found[1:] != found[:-1]).any(axis=1)))
    number = np.empty(len(keys), dtype=np.int64)
    number[order] = np.cumsum(new) - 1
    return found[new], number


def _send_hashes(n_buckets: int):
    schema = pa.schema([("bucket", pa.int32()), ("hashes", pa.binary()), ("owners", pa.binary()), ("keys", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        held: list[tuple[np.ndarray, np.ndarray]] = []
        keys: list[bytes] = []
        size = 0

        def send() -> pa.RecordBatch:
            h, owner = (np.concatenate(c) for c in zip(*held, strict=True))
            bucket, low = _dealt(h, n_buckets)
            order = np.argsort(bucket, kind="stable")
            bucket, low, owner = bucket[order], low[order], owner[order]
            edges = np.searchsorted(bucket, np.arange(n_buckets + 1))
            table = _keys(b"".join(keys))
            rows = []
            for b in range(n_buckets):
                x, y = edges[b], edges[b + 1]
                if x < y:
                    used, number = np.unique(owner[x:y], return_inverse=True)
                    number = number.astype(np.uint16 if len(used) < 65536 else np.uint32)
                    rows.append((b, low[x:y].tobytes(), number.tobytes(), table[used].tobytes()))
            held.clear()
            keys.clear()
            return batch_of(schema, [list(c) for c in zip(*rows, strict=True)])

        for ids, texts in steps(batches, STEP_BYTES):
            fresh = [i for i, t in enumerate(ids) if t not in seen and not seen.add(t)]
            own, _, h = anchors([texts[i] for i in fresh])
            held.append((h, own + len(keys)))
            keys += [ids[i] for i in fresh]
            size += len(h)
            if size > RUN_ANCHORS:
                yield send()
                size = 0
        if size:
            yield send()

    return run


_PACKED = pa.schema([("home", pa.int32()), ("keys", pa.binary()), ("counts", pa.binary()), ("items", pa.binary())])
_PACKED_DDL = "home int, keys binary, counts binary, items binary"


def _packed(keys: np.ndarray, number: np.ndarray, items: np.ndarray, n_homes: int) -> pa.Table:
    """A row per home of texts: their keys, how many items each has, and the items (rows of 8-byte numbers).
    ``number`` is the place among ``keys`` of the text that an item belongs to."""
    used, number = np.unique(number, return_inverse=True)
    keys = keys[used]
    home = ((keys[:, 0] >> np.uint64(32)) * np.uint64(n_homes)) >> np.uint64(32)
    by_home = np.argsort(home, kind="stable")
    place = np.empty(len(by_home), dtype=np.int64)
    place[by_home] = np.arange(len(by_home))
    place = place[number]
    items, counts = items[np.argsort(place, kind="stable")], np.bincount(place, minlength=len(by_home))
    ends = np.concatenate(([0], np.cumsum(counts)))
    rows = []
    for h, (a, b) in enumerate(pairwise(np.searchsorted(home[by_home], np.arange(n_homes + 1, dtype=np.uint64)))):
        if a < b:
            rows.append((h, keys[by_home[a:b]].tobytes(), counts[a:b].astype(np.uint32).tobytes(), items[ends[a] : ends[b]].tobytes()))
    columns = [list(c) for c in zip(*rows, strict=True)] or [[], [], [], []]
    return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _PACKED, strict=True)], schema=_PACKED)


def _unpack(width: int):
    """Of one home: per text all its items of ``width`` numbers."""
    schema = pa.schema([("t", pa.binary()), ("items", pa.binary())])

    def run(group: pa.Table) -> pa.Table:
        columns = [group.column(c).to_pylist() for c in ("keys", "counts", "items")]
        keys, number = _numbered(_keys(b"".join(columns[0])))
        of_item = np.repeat(number, np.frombuffer(b"".join(columns[1]), np.uint32))
        items = np.frombuffer(b"".join(columns[2]), np.uint64).reshape(-1, width)[np.argsort(of_item, kind="stable")]
        ends = np.concatenate(([0], np.cumsum(np.bincount(of_item, minlength=len(keys))))).tolist()
        return pa.Table.from_arrays([pa.array([k.tobytes() for k in keys], pa.binary()), pa.array([items[a:b].tobytes() for a, b in pairwise(ends)], pa.binary())], schema=schema)

    return run


def _survivors(n_homes: int):
    """Of one bucket, per text: the hashes (bucket in the upper half) that another text has too."""

    def run(group: pa.Table) -> pa.Table:
        columns = [group.column(c).to_pylist() for c in ("hashes", "owners", "keys")]
        keys, number = _numbered(_keys(b"".join(columns[2])))
        owners, begin = [], 0
        for own, table in zip(columns[1], columns[2], strict=True):
            n = len(table) // 16
            owners.append(number[begin : begin + n][np.frombuffer(own, np.uint16 if n < 65536 else np.uint32)])
            begin += n
        h, t = np.frombuffer(b"".join(columns[0]), np.uint32), np.concatenate(owners)
        order = np.argsort(h, kind="stable")
        h, t = h[order], t[order]
        first = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1])))
        shared = np.minimum.reduceat(t, first) != np.maximum.reduceat(t, first)
        keep = np.repeat(shared, np.diff(np.concatenate((first, [len(h)]))))
        bucket = np.uint64(group.column("bucket")[0].as_py() << 32)
        return _packed(keys, t[keep], (h[keep].astype(np.uint64) | bucket).reshape(-1, 1), n_homes)

    return run


def _shared_anchors(texts: list[bytes], items: list[bytes], n_buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, place, hash) of the anchors whose hash survived for their text."""
    own, at, h = anchors(texts)
    bucket, low = _dealt(h, n_buckets)
    short = low | (bucket << np.uint64(32))
    of_text = lambda n: n.astype(np.uint64) * np.uint64(_P)
    wanted = mix(np.frombuffer(b"".join(items), np.uint64)) + of_text(np.repeat(np.arange(len(items)), [len(x) // 8 for x in items]))
    alive = np.isin(mix(short) + of_text(own), wanted)  # by hash: one anchor too many is one suffix too many
    return own[alive], at[alive], h[alive]


def _work(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list[bytes], list[bytes]]]:
    """(other columns, texts, alive) of steps; the last two columns are text and alive."""
    for batch in batches:
        columns, begin = [c.to_pylist() for c in batch.columns], 0
        texts = [t.encode() for t in columns[-2]]
        while begin < len(texts):
            end, total = begin + 1, len(texts[begin])
            while end < len(texts) and total + len(texts[end]) <= STEP_BYTES:
                total += len(texts[end])
                end += 1
            yield [c[begin:end] for c in columns[:-2]], texts[begin:end], columns[-1][begin:end]
            begin = end


def _sampled(n_buckets: int, most: int):
    """First bytes of suffixes, at even distances, at most ``most`` of a text."""
    schema = pa.schema([("gram", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, texts, items in _work(batches):
            own, at, _ = _shared_anchors(texts, items, n_buckets)
            for n, text in enumerate(texts):
                places = at[own == n]
                yield batch_of(schema, [[text[p : p + GRAM] for p in places[:: -(-len(places) // most) or 1].tolist()]])

    return run


def _bounds(texts: DataFrame, n_suffixes: int, n_ranges: int, n_buckets: int) -> list[bytes]:
    """Where ranges begin after the first: quantiles of a sample of about ``SAMPLES`` suffixes a range."""
    if n_ranges < 2:
        return []
    wanted, n_texts = SAMPLES * n_ranges, texts.count()
    most = max(1, min(256, n_suffixes // max(1, n_texts)))  # of a text
    share = min(1.0, wanted / most / max(1, n_texts))
    some = texts.where(F.pmod(F.xxhash64("t"), F.lit(1 << 20)) < share * (1 << 20)).select("text", "alive")
    grams = sorted(r.gram for r in in_arrow(some, _sampled(n_buckets, most), "gram binary").limit(4 * wanted).collect())
    grams = [bytes(g) for g in grams]
    return sorted({grams[len(grams) * i // n_ranges] for i in range(1, n_ranges)}) if grams else []


def _send_suffixes(n_buckets: int, bounds: list[bytes], deal: int):
    schema = pa.schema([("place", pa.int64()), *((n, pa.binary()) for n in ("lcps", "lengths", "rest", "lefts", "left", "texts", "at", "keys", "owners"))])

    def coded(place: int, records: list[tuple]) -> pa.RecordBatch:
        """A sorted run of one place."""
        front = front_coded((r[0], None) for r in records)
        number: dict[tuple[bytes, int], int] = {}
        of = [number.setdefault((r[2], r[3]), len(number)) for r in records]
        binary = [
            bytes(c[0] for c in front), bytes(len(c[1]) for c in front), b"".join(c[1] for c in front), bytes(len(r[1]) for r in records), b"".join(r[1] for r in records),
            np.array(of, np.uint32).tobytes(), np.array([r[4] for r in records], np.int64).tobytes(), b"".join(k for k, _ in number), np.array([o for _, o in number], np.int64).tobytes(),
        ]
        return batch_of(schema, [[place], *([x] for x in binary)])

    def send(records: list[tuple]) -> Iterator[pa.RecordBatch]:
        records.sort()
        cuts = [0, *(bisect_left(records, (b,)) for b in bounds), len(records)]
        for place, (a, b) in enumerate(pairwise(cuts)):
            if deal == 1 and a < b:
                yield coded(place, records[a:b])
            elif a < b:
                dealt: dict[int, list[tuple]] = {}
                for r in records[a:b]:
                    dealt.setdefault(r[5] % deal, []).append(r)
                for d, found in dealt.items():
                    yield coded(place * deal + d, found)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gc.disable()  # many small objects without cycles
        try:
            held: list[tuple] = []
            for (ts, owners), texts, items in _work(batches):
                for n, p, g in zip(*(x.tolist() for x in _shared_anchors(texts, items, n_buckets)), strict=True):
                    text = texts[n]
                    held.append((text[p : p + SPAN], text[max(0, p - WINDOW + 1) : p], ts[n], owners[n], p, g >> 1))
                if len(held) > RUN_SUFFIXES:
                    yield from send(held)
                    held = []
            yield from send(held)
        finally:
            gc.enable()

    return run


def _runs(group: pa.Table) -> list[list[tuple[int, bytes, tuple]]]:
    out = []
    columns = [group.column(c).to_pylist() for c in ("lcps", "lengths", "rest", "lefts", "left", "texts", "at", "keys", "owners")]
    for lcps, lengths, rest, lefts, left, texts, at, keys, owners in zip(*columns, strict=True):
        keys, owners = [keys[i : i + 16] for i in range(0, len(keys), 16)], np.frombuffer(owners, np.int64).tolist()
        run, i, j = [], 0, 0
        for lcp, n, m, text, p in zip(lcps, lengths, lefts, np.frombuffer(texts, np.uint32).tolist(), np.frombuffer(at, np.int64).tolist(), strict=True):
            run.append((lcp, rest[i : i + n], (left[j : j + m], keys[text], owners[text], p)))
            i += n
            j += m
        out.append(run)
    return out


def _ranges(members: list[tuple[bytes, tuple]], out: dict[bytes, list[tuple[int, int]]]) -> None:
    """members: (suffix, (bytes before, text, owner, place)) of one group."""
    whole: dict[tuple[bytes, bytes], int] = {}
    for suffix, (left, _, owner, _) in members:
        key = (left, suffix)
        if whole.get(key, _NO_ID) >= owner:
            whole[key] = owner
    if len(whole) > 1:  # strings around the anchor; each different context is cut once
        least: dict[tuple[int, bytes], int] = {}
        for (left, suffix), owner in whole.items():
            for o in range(max(0, SPAN - len(suffix)), len(left) + 1):
                key = (o, left[len(left) - o :] + suffix[: SPAN - o])
                if least.get(key, _NO_ID) >= owner:
                    least[key] = owner
    found: dict[tuple[bytes, bytes, int], list[int]] = {}
    for suffix, (left, text, owner, p) in members:
        offsets = range(max(0, SPAN - len(suffix)), len(left) + 1)
        if whole[left, suffix] < owner:
            hit = offsets
        elif len(whole) == 1:
            continue
        else:
            key = (left, suffix, owner)
            hit = found.get(key)
            if hit is None:
                hit = found[key] = [o for o in offsets if least[o, left[len(left) - o :] + suffix[: SPAN - o]] < owner]
        if len(hit):
            own = out.setdefault(text, [])
            if hit[-1] - hit[0] < SPAN:  # strings at these offsets overlap, so their bytes are one range
                own.append((p - hit[-1], p - hit[0] + SPAN))
            else:
                own += [(p - o, p - o + SPAN) for o in hit]


def _merge_group(n_homes: int):
    """Of one range of suffixes, per text: the bytes to remove."""

    def run(group: pa.Table) -> pa.Table:
        gc.disable()
        try:
            out: dict[bytes, list[tuple[int, int]]] = {}
            members: list[tuple[bytes, tuple]] = []
            suffix = b""
            for lcp, rest, payload in merged_front_coded(_runs(group)):
                suffix = suffix[:lcp] + rest
                if lcp < GRAM and members:
                    if len(members) > 1:
                        _ranges(members, out)
                    members = []
                members.append((suffix, payload))
            if len(members) > 1:
                _ranges(members, out)
        finally:
            gc.enable()
        rows = np.array([(n, a, b) for n, r in enumerate(out.values()) for a, b in joined(r)], dtype=np.int64).reshape(-1, 3)
        return _packed(_keys(b"".join(out)), rows[:, 0], np.ascontiguousarray(rows[:, 1:]).view(np.uint64), n_homes)

    return run


def joined(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Union of ranges; those that touch are one."""
    out: list[list[int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(row, doc_id, n_bytes, sha, copy, text, items) to (row, doc_id, n_bytes, n_removed, n_spans, kept_sha256, text)."""
    names = ["row", "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "text"]
    for batch in batches:
        rows = []
        for size, sha, copy, text, items in zip(*(batch.column(c).to_pylist() for c in ("n_bytes", "sha", "copy", "text", "items")), strict=True):
            if copy:
                rows.append((size, 1, _NOTHING, ""))
            elif items is None:
                rows.append((0, 0, sha, text))
            else:
                text, last, kept = text.encode(), 0, []
                ranges = joined([tuple(r) for r in np.frombuffer(items, np.int64).reshape(-1, 2).tolist()])
                for a, b in ranges:
                    kept.append(text[last:a])
                    last = b
                left = b"".join([*kept, text[last:]])
                rows.append((sum(b - a for a, b in ranges), len(ranges), hashlib.sha256(left).hexdigest(), left.decode("utf-8", "ignore")))
        made = [pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.string(), pa.string()), strict=True)] if rows else [pa.array([], t) for t in (pa.int64(), pa.int64(), pa.string(), pa.string())]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names[:3]), *made], names=names)


def _worked(spark: SparkSession, docs: DataFrame, row: Column, row_type: str, keep_text: bool) -> DataFrame:
    """row, doc_id, n_bytes, n_removed, n_spans, kept_sha256 and, if ``keep_text``, what is left as text of every row."""
    before = len(made())
    text = F.coalesce("text", F.lit(""))
    every = docs.select(row.alias("row"), F.col("doc_id").try_cast("long").alias("doc_id"), F.col("text").alias("was"), text.alias("text"))
    every = every.select("*", F.sha2(F.encode("text", "UTF-8"), 256).alias("sha"), text_key("text").alias("t"), F.octet_length("text").cast("long").alias("n_bytes"))
    plain = lambda df, n, spans, sha, left: df.select("row", "doc_id", "n_bytes", n.alias("n_removed"), F.lit(spans).cast("long").alias("n_spans"), sha.alias("kept_sha256"), left.alias("text"))
    short = plain(every.where(F.col("n_bytes") < SPAN), F.lit(0).cast("long"), 0, F.col("sha"), F.col("was"))
    long = every.where(F.col("n_bytes") >= SPAN).drop("was")
    owners = stash(spark, long.groupBy("t").agg(F.min("doc_id").alias("owner"), F.count("*").alias("n"), F.max("n_bytes").alias("size")), "owners")
    sums = owners.agg(F.sum("n").alias("rows"), F.sum(F.col("n") * F.col("size")).alias("bytes")).first()
    n_buckets = max(1, -(-(sums.bytes or 0) // 14 // GROUP_ANCHORS))
    # fewer than HOT texts
    hot = owners.where(f"n * {HOT} > {sums.rows or 0} and n > 1 and owner is not null").select("t", F.col("owner").alias("hot_owner"))
    marked = long.join(F.broadcast(hot), "t", "left")
    away = F.col("hot_owner").isNotNull() & (F.col("doc_id").isNull() | (F.col("doc_id") > F.col("hot_owner")))
    copies = plain(marked.where(away), F.col("n_bytes"), 1, F.lit(_NOTHING), F.lit(""))
    long = marked.where(~away).drop("hot_owner")

    sent = in_arrow(long.select("t", "text"), _send_hashes(n_buckets), "bucket int, hashes binary, owners binary, keys binary")
    alive = sent.groupBy("bucket").applyInArrow(_survivors(n_buckets), _PACKED_DDL).groupBy("home").applyInArrow(_unpack(1), "t binary, items binary")
    alive = stash(spark, alive, "alive")
    release(spark)
    n_suffixes = (alive.agg(F.sum(F.octet_length("items"))).first()[0] or 0) // 8
    of_text = owners.select("t", "owner").join(alive.withColumnRenamed("items", "alive"), "t", "left")
    copy = F.col("owner").isNotNull() & (F.col("doc_id").isNull() | (F.col("doc_id") > F.col("owner")))
    placed = long.join(of_text.hint("shuffle_hash"), "t", "left").withColumn("copy", copy)
    at_work = F.col("alive").isNotNull() & ~F.col("copy")
    needed = ~F.col("copy") if keep_text else at_work
    placed = placed.select("t", "row", "doc_id", "n_bytes", "sha", "copy", F.coalesce("owner", F.lit(_NO_ID)).alias("owner"), F.when(at_work, F.col("alive")).alias("alive"), F.when(needed, F.col("text")).alias("text"))
    placed = stash(spark, placed, "placed", bucket="t")
    drop_stashes(spark, [p for p in made()[before:] if "/alive-" in p])
    release(spark)

    texts = placed.where("alive is not null").select("t", "owner", "text", "alive")  # rows that repeat id and text give equal ranges twice, which joined() unites
    n_groups = max(1, -(-n_suffixes // GROUP_SUFFIXES))
    bounds, deal = _bounds(texts, n_suffixes, min(n_groups, MAX_RANGES), n_buckets), -(-n_groups // MAX_RANGES)
    runs = in_arrow(texts, _send_suffixes(n_buckets, bounds, deal), "place long, lcps binary, lengths binary, rest binary, lefts binary, left binary, texts binary, at binary, keys binary, owners binary")
    ranges = stash(spark, runs.groupBy("place").applyInArrow(_merge_group(n_buckets), _PACKED_DDL).groupBy("home").applyInArrow(_unpack(2), "t binary, items binary"), "ranges")
    release(spark)
    cut = placed.join(ranges.hint("shuffle_hash"), "t", "left").select("row", "doc_id", "n_bytes", "sha", "copy", "text", "items")
    cut = in_arrow(cut, _cut, f"row {row_type}, doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, text string")
    return cut.unionByName(short).unionByName(copies)


def deduplicated(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row."""
    return _worked(spark, docs, F.lit(0), "int", False).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def deduplicated_rows(spark: SparkSession, docs: DataFrame, length: str = "n_chars") -> DataFrame:
    """Every row of ``docs`` with what is left as its text (bytes of characters cut in two are left out of it, though not
    of the digest); a text can become empty. Where bytes went, a column ``length`` gets the new number of characters. Other
    columns, whatever their names, stay as they are."""
    rest = [c for c in docs.columns if c != "text"]
    row = F.struct(*(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(rest)))
    worked = _worked(spark, docs, row, docs.select(row.alias("row")).schema["row"].dataType.simpleString(), True)
    back = {c: F.col(f"row.c{i}") for i, c in enumerate(rest)}
    if length in back:
        back[length] = F.when(F.col("n_removed") > 0, F.length("text").cast(docs.schema[length].dataType)).otherwise(back[length])
    return worked.select(*(back.get(c, F.col("text")).alias(c) for c in docs.columns))
