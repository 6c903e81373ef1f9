"""Exact removal of repeated byte strings by a hash-compared suffix sort.

Every byte covered by a ``LENGTH``-byte string that also starts elsewhere (in any document)
is removed. Strings are judged on the input; they never cross documents.

1. Anchors. In each LENGTH-byte window the GRAM-byte substring with the smallest hash is its
   anchor (leftmost of equals), so equal windows have the same anchor at the same
   offset. About one position in 65 is an anchor; only anchors are shuffled.
2. Anchors that occur once end here: their windows are unique. Where all occurrences of an
   anchor agree on the whole context (every byte of every window around it), or several do,
   those are covered entirely, without any sort. Contexts count as equal by a strong digest of
   their bytes (BLAKE2b, 128 bits), never by a polynomial hash: patterns that collide in
   those can be written down, for BLAKE2b none are known. What is left are different
   contexts of one anchor, one representative each.
3. Suffix sort. Within an anchor, the suffixes that begin at it, and the reversed prefixes
   that end at it, are mergesorted. Two suffixes are compared through their longest
   common extension, found by binary search on prefix polynomial hashes: logarithmically many
   steps, then one byte. Every neighbouring extension is then verified byte by byte; should
   a hash have lied, the sort is repeated modulo the prime 2^61 - 1, and should that lie
   too, by comparing the bytes themselves. From the two orders and their extension lengths,
   windows with L bytes left of the anchor are equal exactly where both orders keep their
   suffixes together down to that length.
4. The covered spans meet their document again by id, and the bytes are cut.

An anchor with more than HOT_ANCHOR different contexts (a line in a third of all documents)
isn't sorted in one task: its windows are compared by their strong digests in an aggregation.
Both ways cover all rows.

Defined results: null and empty texts have no bytes; repeated rows are each other's
repeats (a row is told by doc_id and a hash of its text); a null doc_id is a value like
others; texts of any length are read in pieces that overlap; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from touchline.llm.common import small_batches, written

LENGTH, GRAM = 200, 48
#: The most bytes on either side of an anchor that a window with it can reach.
REACH = LENGTH - GRAM
#: A long text is read in pieces of so many window starts; a block of texts has about BLOCK bytes.
PIECE, BLOCK, POSITIONS = 1 << 16, 1 << 17, 22
#: Rows of a batch that are Python objects at a time.
ROWS = 512
HOT_ANCHOR = 4000


class Hashes:
    """Prefix polynomial hashes modulo 2^64 over random byte values (fixed seeds)."""

    def __init__(self, seed: int):
        rng = np.random.Generator(np.random.PCG64(seed))
        self.values = rng.integers(0, 2**64, 256, dtype=np.uint64)
        self.base = int(rng.integers(0, 2**62)) * 8 + 5  # odd, so that it has an inverse
        self.power, self.inverse = np.ones(1, np.uint64), np.ones(1, np.uint64)

    def prefix(self, buf: np.ndarray) -> np.ndarray:
        if len(self.power) <= len(buf):
            n = 1 << (len(buf) + 1).bit_length()
            self.power, self.inverse = _powers(self.base, n), _powers(pow(self.base, -1, 2**64), n)
        out = np.zeros(len(buf) + 1, np.uint64)
        np.cumsum(self.values[buf] * self.power[: len(buf)], out=out[1:])
        return out

    def of(self, prefix: np.ndarray, at: np.ndarray, size: np.ndarray | int) -> np.ndarray:
        return (prefix[at + size] - prefix[at]) * self.inverse[at]


def _powers(base: int, n: int) -> np.ndarray:
    out = np.ones(n, np.uint64)
    k = 1
    while k < n:
        m = min(k, n - k)
        out[k : k + m] = out[:m] * np.uint64(pow(base, k, 2**64))
        k += m
    return out


PRIME = (1 << 61) - 1


class PrimeHashes:
    """The same modulo the prime 2^61 - 1, where no pattern collides for every base."""

    def __init__(self, seed: int):
        rng = np.random.Generator(np.random.PCG64(seed))
        self.values = rng.integers(0, PRIME, 256, dtype=np.uint64)
        self.base = int(rng.integers(2, PRIME - 1))
        self.power, self.inverse = np.ones(1, np.uint64), np.ones(1, np.uint64)

    def prefix(self, buf: np.ndarray) -> np.ndarray:
        if len(self.power) <= len(buf):
            n = 1 << (len(buf) + 1).bit_length()
            self.power, self.inverse = _prime_powers(self.base, n), _prime_powers(pow(self.base, -1, PRIME), n)
        terms = times(self.values[buf], self.power[: len(buf)])
        # sums of the upper and the lower 30 bits stay within 64 bits
        upper, lower = (np.cumsum(x) % np.uint64(PRIME) for x in (terms >> np.uint64(30), terms & np.uint64((1 << 30) - 1)))
        return np.append(np.uint64(0), (times(upper, np.uint64(1 << 30)) + lower) % np.uint64(PRIME))

    def of(self, prefix: np.ndarray, at: np.ndarray, size: np.ndarray | int) -> np.ndarray:
        return times((prefix[at + size] + np.uint64(PRIME) - prefix[at]) % np.uint64(PRIME), self.inverse[at])


def times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a * b modulo PRIME for a, b below it; 2^61 is 1 there."""
    a1, a0, b1, b0 = a >> np.uint64(31), a & np.uint64((1 << 31) - 1), b >> np.uint64(31), b & np.uint64((1 << 31) - 1)
    middle = a1 * b0 + a0 * b1
    out = ((a1 * b1) << np.uint64(1)) + (middle >> np.uint64(30)) + ((middle & np.uint64((1 << 30) - 1)) << np.uint64(31)) + a0 * b0
    out = (out & np.uint64(PRIME)) + (out >> np.uint64(61))
    return np.where(out >= PRIME, out - np.uint64(PRIME), out)


def _prime_powers(base: int, n: int) -> np.ndarray:
    out = np.ones(n, np.uint64)
    k = 1
    while k < n:
        m = min(k, n - k)
        out[k : k + m] = times(out[:m], np.uint64(pow(base, k, PRIME)))
        k += m
    return out


@cache
def hashes(seed: int) -> Hashes:
    return Hashes(seed)


def strong(data: bytes, first: list[int], last: list[int]) -> np.ndarray:
    """[n, 2]: 128-bit digests of data[first:last]."""
    made = b"".join([hashlib.blake2b(data[a:e], digest_size=16).digest() for a, e in zip(first, last, strict=True)])
    return np.frombuffer(made, np.int64).reshape(-1, 2)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def anchors(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, own: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(piece, position in buf, anchor hash) of the anchors of pieces [starts, ends) of buf.
    An anchor's windows are consecutive; it is given where the first of them is in
    [own, stop). The window before ``own``, if the text has one, must be in buf too."""
    h = hashes(1)
    none = np.empty(0, np.int64)
    if len(buf) < LENGTH:
        return none, none, none.astype(np.uint64)
    n = len(buf) - GRAM + 1
    grams = mix(h.of(h.prefix(buf), np.arange(n), GRAM))
    place = np.uint64((1 << POSITIONS) - 1)
    key = (grams & ~place) | np.arange(n, dtype=np.uint64)
    w = REACH + 1
    blocks = np.concatenate((key, np.full(-n % w, 2**64 - 1, np.uint64))).reshape(-1, w)
    before = np.minimum.accumulate(blocks, axis=1).ravel()
    after = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    windows = len(buf) - LENGTH + 1
    at = (np.minimum(after[:windows], before[w - 1 : w - 1 + windows]) & place).astype(np.int64)
    piece = np.repeat(np.arange(len(starts)), ends - starts)[:windows]
    inside = np.arange(windows) + LENGTH <= ends[piece]
    first = np.ones(windows, bool)
    first[1:] = (at[1:] != at[:-1]) | (piece[1:] != piece[:-1])
    begin = np.arange(windows)
    found = np.flatnonzero(inside & first & (begin >= own[piece]) & (begin < stop[piece]))
    return piece[found], at[found], grams[at[found]]


def _pieces(texts: list[bytes]) -> Iterator[list[tuple[int, int, int, bytes]]]:
    """Blocks of (text, offset of the bytes, first window of its own, bytes)."""
    block, size = [], 0
    for i, t in enumerate(texts):
        for at in range(0, max(len(t) - LENGTH + 1, 0), PIECE):
            low = max(0, at - 1 - REACH)
            part = t[low : at + PIECE + LENGTH + REACH]
            block.append((i, low, at, part))
            size += len(part)
            if size >= BLOCK:
                yield block
                block, size = [], 0
    if block:
        yield block


def slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    for at in range(0, batch.num_rows, ROWS):
        yield batch.slice(at, ROWS)


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in (part for whole in batches for part in slices(whole)):
        texts = b.column("body").to_pylist()
        did, th = (b.column(c).to_numpy(zero_copy_only=False) for c in ("did", "th"))
        for block in _pieces(texts):
            text, low, own, part = (np.array(x) if k < 3 else x for k, x in enumerate(zip(*block, strict=True)))
            sizes = np.fromiter(map(len, part), np.int64, len(part))
            ends = np.cumsum(sizes)
            starts = ends - sizes
            data = b"".join(part)
            buf = np.frombuffer(data, np.uint8)
            begin = starts + own - low
            piece, at, gram = anchors(buf, starts, ends, begin, begin + PIECE)
            pos = at - starts[piece] + low[piece]
            whole = np.fromiter((len(texts[i]) for i in text), np.int64, len(text))[piece]
            left, right = np.minimum(REACH, pos), np.minimum(REACH, whole - pos - GRAM)
            full, rest = strong(data, (at - left).tolist(), (at + GRAM + right).tolist()).T
            full = full ^ (left * 1024 + right) * 0x165667B19E3779F9  # where the anchor stands is part of a context
            head, last, n = runs(text[piece], gram, full, rest, pos)
            owner = text[piece[head]]
            columns = [gram[head].view(np.int64), full[head], rest[head], did[owner], th[owner], pos[head], last, n]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], ["anchor", "full", "rest", "did", "th", "pos", "last", "n"])


def runs(owner: np.ndarray, gram: np.ndarray, full: np.ndarray, rest: np.ndarray, pos: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first row, last position, rows) of runs of one anchor with one context that follow each
    other in a text so closely that their contexts touch. A text that repeats a
    short line thousands of times gives few rows, not thousands of equal ones."""
    same = (owner[1:] == owner[:-1]) & (gram[1:] == gram[:-1]) & (full[1:] == full[:-1]) & (rest[1:] == rest[:-1]) & (pos[1:] - pos[:-1] <= LENGTH + REACH)
    head = np.flatnonzero(np.append(True, ~same)) if len(pos) else np.empty(0, np.int64)
    n = np.diff(np.append(head, len(pos)))
    return head, pos[head + n - 1], n


def suffix_sort(buf: np.ndarray, starts: np.ndarray, sizes: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, extension): the suffixes buf[start : start + size] sorted within each group
    (groups ascending), and each one's common extension with the one before it in the order
    (-1 at the head of a group)."""
    for h in (hashes(11), PrimeHashes(12)):
        order, common = _mergesort(buf, starts, sizes, group, h)
        if _verified(buf, starts, sizes, order, common):
            return order, common
    return _sorted_by_bytes(buf, starts, sizes, group)


def _sorted_by_bytes(buf: np.ndarray, starts: np.ndarray, sizes: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What ``suffix_sort`` returns, without hashes."""
    cut = [buf[a : a + n].tobytes() for a, n in zip(starts.tolist(), sizes.tolist(), strict=True)]
    order = sorted(range(len(cut)), key=lambda i: (group[i], cut[i]))
    common = [-1] * len(order)
    for k in range(1, len(order)):
        x, y = cut[order[k - 1]], cut[order[k]]
        if group[order[k - 1]] == group[order[k]]:
            n = min(len(x), len(y))
            unlike = np.flatnonzero(np.frombuffer(x, np.uint8, n) != np.frombuffer(y, np.uint8, n))
            common[k] = int(unlike[0]) if len(unlike) else n
    return np.array(order, np.int64), np.array(common, np.int64)


def _extension(h: Hashes, prefix, a, b, most) -> np.ndarray:
    low, high = np.zeros_like(most), most.copy()
    while True:
        open_ = low < high
        if not open_.any():
            return low
        mid = (low + high + 1) >> 1
        same = h.of(prefix, a, mid) == h.of(prefix, b, mid)
        low, high = np.where(open_ & same, mid, low), np.where(open_ & ~same, mid - 1, high)


def _mergesort(buf, starts, sizes, group, h: Hashes):
    prefix, padded = h.prefix(buf), np.append(buf, 0).astype(np.int16)

    def less(x, y, equal):
        """Whether suffix x comes before suffix y; equal ones: ``equal``."""
        a, b = starts[x], starts[y]
        k = _extension(h, prefix, a, b, np.minimum(sizes[x], sizes[y]))
        p, q = np.where(k < sizes[x], padded[a + k], -1), np.where(k < sizes[y], padded[b + k], -1)
        return (p < q) | (equal & (p == q))

    order = np.argsort(group, kind="stable")
    head = np.flatnonzero(np.append(True, group[order][1:] != group[order][:-1]))
    count = np.diff(np.append(head, len(order)))
    base, size = np.repeat(head, count), np.repeat(count, count)
    offset = np.arange(len(order)) - base
    run = 1
    while run < count.max(initial=0):
        live = np.flatnonzero(size > run)
        block = offset[live] // (2 * run) * (2 * run)
        in_left = offset[live] - block < run
        other = base[live] + np.where(in_left, block + run, block)
        end = base[live] + np.minimum(np.where(in_left, block + 2 * run, block + run), size[live])
        low, high = np.minimum(other, end), end.copy()
        first = low.copy()
        mine = order[live]
        while (todo := np.flatnonzero(low < high)).size:
            mid = (low[todo] + high[todo]) >> 1
            # of equal suffixes the left run's come first: it counts those below, the right run those not above
            before = less(order[mid], mine[todo], ~in_left[todo])
            low[todo], high[todo] = np.where(before, mid + 1, low[todo]), np.where(before, high[todo], mid)
        at_own = offset[live] - block - np.where(in_left, 0, run)
        target = base[live] + block + at_own + (low - first)
        merged = order.copy()
        merged[target] = mine
        order = merged
        run *= 2
    common = np.full(len(order), -1, np.int64)
    inner = np.flatnonzero(np.append(False, group[order][1:] == group[order][:-1]))
    x, y = order[inner - 1], order[inner]
    common[inner] = _extension(h, prefix, starts[x], starts[y], np.minimum(sizes[x], sizes[y]))
    return order, common


def _verified(buf, starts, sizes, order, common, step: int = 512) -> bool:
    """Every extension byte by byte, and that the order is right at its end."""
    padded = np.append(buf, 0)
    inner = np.flatnonzero(common >= 0)
    for at in range(0, len(inner), step):
        i = inner[at : at + step]
        x, y, k = order[i - 1], order[i], common[i]
        column = np.arange(int(k.max(initial=0)))
        used = column < k[:, None]
        a, b = np.where(used, starts[x][:, None] + column, 0), np.where(used, starts[y][:, None] + column, 0)
        if (padded[a] != padded[b]).any():
            return False
        p = np.where(k < sizes[x], padded[starts[x] + k].astype(np.int16), -1)
        q = np.where(k < sizes[y], padded[starts[y] + k].astype(np.int16), -1)
        if ((p > q) | ((p == q) & (p >= 0))).any():
            return False
    return True


def repeated_windows(buf: np.ndarray, starts: np.ndarray, left: np.ndarray, sizes: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each context buf[start : start + size] with its anchor ``left`` bytes in, the
    smallest and largest L such that its window with L bytes before the anchor is also a
    window of another context of the group (-1, -1: none)."""
    n = len(starts)
    order, common = suffix_sort(buf, starts + left, sizes - left, group)
    back_order, back_common = suffix_sort(buf[::-1], len(buf) - (starts + left), left, group)
    least, most = np.full(n, -1), np.full(n, -1)
    run, back = np.empty(n, np.int64), np.empty(n, np.int64)
    for L in range(REACH + 1):
        run[order] = np.cumsum(common < GRAM + REACH - L)
        back[back_order] = np.cumsum(back_common < L)
        several = np.flatnonzero((np.bincount(run)[run] > 1) & (np.bincount(back)[back] > 1))
        if not len(several):
            continue
        pair = run[several] * (n + 1) + back[several]
        ranked = np.argsort(pair, kind="stable")
        same = pair[ranked][1:] == pair[ranked][:-1]
        dup = several[ranked[np.append(False, same) | np.append(same, False)]]
        fits = dup[(left[dup] >= L) & (sizes[dup] - left[dup] >= LENGTH - L)]
        most[fits] = L
        least[fits] = np.where(least[fits] < 0, L, least[fits])
    return least, most


def _sorted_contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Input sorted by anchor; whole anchors are sorted in blocks of about BLOCK bytes."""
    held: list[pa.RecordBatch] = []

    def work(table: pa.Table) -> Iterator[pa.RecordBatch]:
        anchor = table.column("anchor").to_numpy()
        context = table.column("context").to_pylist()
        sizes = np.fromiter(map(len, context), np.int64, len(context))
        cut = [0]
        edges = np.flatnonzero(np.append(True, anchor[1:] != anchor[:-1]))
        filled = np.cumsum(sizes) - sizes
        for e in edges.tolist():
            if filled[e] - filled[cut[-1]] >= BLOCK:
                cut.append(e)
        for a, e in zip(cut, [*cut[1:], len(context)], strict=True):
            buf = np.frombuffer(b"".join(context[a:e]), np.uint8)
            starts = filled[a:e] - filled[a]
            part = table.slice(a, e - a)
            left, pos = part.column("left").to_numpy(), part.column("pos").to_numpy()
            least, most = repeated_windows(buf, starts, left, sizes[a:e], np.cumsum(np.append(False, anchor[a:e][1:] != anchor[a:e][:-1])))
            hit = np.flatnonzero((most >= 0) & part.column("single").to_numpy(zero_copy_only=False).astype(bool))
            did, th = (part.column(c).to_numpy()[hit] for c in ("did", "th"))
            yield pa.RecordBatch.from_arrays([pa.array(did), pa.array(th), pa.array(pos[hit] - most[hit]), pa.array(pos[hit] - least[hit] + LENGTH)], ["did", "th", "start", "end"])

    for b in batches:
        if not b.num_rows:
            continue
        held.append(b)
        if sum(x.num_rows for x in held) < HOT_ANCHOR:
            continue
        table = pa.Table.from_batches(held)
        anchor = table.column("anchor").to_numpy()
        last = int(np.flatnonzero(np.append(True, anchor[1:] != anchor[:-1]))[-1])
        if last:
            yield from work(table.slice(0, last))
            held = table.slice(last).combine_chunks().to_batches()
    if held:
        yield from work(pa.Table.from_batches(held))


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in (part for whole in batches for part in slices(whole)):
        for body, did, th, marks in zip(*(b.column(c).to_pylist() for c in ("body", "did", "th", "marks")), strict=True):
            for at in range(0, len(marks), 8192):
                part = marks[at : at + 8192]
                lefts = [min(REACH, m["pos"]) for m in part]
                cut = [body[m["pos"] - left : m["pos"] + GRAM + REACH] for m, left in zip(part, lefts, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([m["anchor"] for m in part], pa.int64()), pa.array([m["single"] for m in part], pa.bool_()), pa.array([m["hot"] for m in part], pa.bool_()), pa.array([did] * len(part), pa.int64()), pa.array([th] * len(part), pa.int64()), pa.array([m["pos"] for m in part], pa.int64()), pa.array(lefts, pa.int64()), pa.array(cut, pa.binary())],
                    ["anchor", "single", "hot", "did", "th", "pos", "left", "context"],
                )


def _window_digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for part in slices(b):
            context = part.column("context").to_pylist()
            sizes = np.fromiter(map(len, context), np.int64, len(context))
            starts = np.cumsum(sizes) - sizes
            count = np.maximum(sizes - LENGTH + 1, 0)
            row = np.repeat(np.arange(len(context)), count)
            offset = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
            where = starts[row] + offset
            begin = (part.column("pos").to_numpy() - part.column("left").to_numpy())[row] + offset
            found = strong(b"".join(context), where.tolist(), (where + LENGTH).tolist())
            yield pa.RecordBatch.from_arrays(
                [pa.array(x) for x in found.T] + [pa.array(part.column(c).to_numpy()[row]) for c in ("did", "th")] + [pa.array(begin)],
                ["w", "v", "did", "th", "start"],
            )


def keyed(docs: DataFrame) -> DataFrame:
    """did, th and body: what tells a row from others, and its bytes."""
    small_batches(docs.sparkSession)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))).alias("did"), F.xxhash64(text).alias("th"), text.cast("binary").alias("body"))


def spans(docs: DataFrame) -> DataFrame:
    """did, th, start, end: byte spans of repeated strings. They may overlap, and a row that is
    there several times gives each of its spans as often."""
    bodies = keyed(docs)
    found = bodies.where(F.octet_length("body") >= LENGTH).mapInArrow(_scan, "anchor long, full long, rest long, did long, th long, pos long, last long, n long")
    unlike = lambda *columns: F.expr(" or ".join(f"min({c}) <> max({c})" for c in columns))
    often = found.groupBy("anchor").agg(F.sum("n").alias("n"), unlike("full", "rest").alias("mixed")).where("n > 1")
    # written, so that the joins below have an exchange of their own on both sides and adaptive execution can split a hot anchor's rows
    often = written(often.select("anchor", "mixed"), "often")
    hits = written(found.join(often, "anchor"), "anchors")
    span = lambda df: df.select("did", "th", F.greatest(F.lit(0), F.col("pos") - REACH).alias("start"), (F.col("last") + LENGTH).alias("end"))
    same = ["anchor", "full", "rest"]
    classes = hits.where("mixed").groupBy(*same).agg(F.sum("n").alias("n"), F.min(F.struct("did", "th", "pos")).alias("one"))
    classes = written(classes, "classes")
    sizes = classes.groupBy("anchor").agg((F.count("*") > HOT_ANCHOR).alias("hot"))
    marks = classes.join(sizes, "anchor").select("one.*", F.struct("anchor", "one.pos", (F.col("n") == 1).alias("single"), "hot").alias("mark"))
    marked = marks.groupBy("did", "th").agg(F.collect_list("mark").alias("marks"))
    # repeated rows give the same contexts again, which changes nothing: those are never single
    contexts = bodies.join(marked, ["did", "th"])
    columns = "anchor long, single boolean, hot boolean, did long, th long, pos long, left long, context binary"
    contexts = written(contexts.mapInArrow(_contexts, columns), "contexts")
    sorted_ = contexts.where("not hot").repartition("anchor").sortWithinPartitions("anchor").mapInArrow(_sorted_contexts, "did long, th long, start long, end long")
    digests = contexts.where("hot").mapInArrow(_window_digests, "w long, v long, did long, th long, start long")
    twice = digests.groupBy("w", "v").agg(unlike("did", "th", "start").alias("several")).where("several").select("w", "v")
    windows = salted(digests, twice, ["w", "v"], ["did", "start"]).select("did", "th", "start", (F.col("start") + LENGTH).alias("end"))
    several = salted(hits.where("mixed"), classes.where("n > 1").select(*same), same, ["did", "pos"])
    return span(hits.where("not mixed")).unionByName(span(several)).unionByName(sorted_).unionByName(windows)


#: Tasks that a key's rows are dealt to where only its presence on the other side counts.
SALTS = 8


def salted(rows: DataFrame, keys: DataFrame, on: list[str], by: list[str]) -> DataFrame:
    """The rows whose ``on`` is among ``keys`` (each there once). A key may hold a third of the
    rows, so they are dealt to SALTS tasks and each key is repeated for them."""
    dealt = rows.withColumn("salt", F.pmod(F.xxhash64(*by), F.lit(SALTS)).cast("int"))
    return dealt.join(keys.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), [*on, "salt"], "left_semi").drop("salt")


def merged(starts: np.ndarray, ends: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of covered bytes."""
    if not len(starts):
        return starts, ends
    order = np.argsort(starts, kind="stable")
    starts, ends = starts[order], np.maximum.accumulate(np.minimum(ends[order], size))
    head = np.append(True, starts[1:] > ends[:-1])
    return starts[head], ends[np.append(np.flatnonzero(head)[1:] - 1, len(ends) - 1)]


def with_spans(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` with did, th, body and cover (array of start, end; null: none)."""
    cover = spans(docs).groupBy("did", "th").agg(F.collect_set(F.struct("start", "end")).alias("cover"))
    return keyed(docs).join(cover, ["did", "th"], "left")


def cut(body: bytes, cover: list[dict] | None) -> tuple[bytes, list[tuple[int, int]]]:
    """The remaining bytes, and the maximal removed runs."""
    if not cover:
        return body, []
    pairs = np.array([(c["start"], c["end"]) for c in cover], np.int64)
    first, last = merged(pairs[:, 0], pairs[:, 1], len(body))
    runs = list(zip(first.tolist(), last.tolist(), strict=True))
    kept, at = [], 0
    for a, e in runs:
        kept.append(body[at:a])
        at = e
    return b"".join(kept) + body[at:], runs


def _removed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in (part for whole in batches for part in slices(whole)):
        rows = [(did if did != -(2**63) else None, body, *cut(body, cover)) for did, body, cover in zip(*(b.column(c).to_pylist() for c in ("did", "body", "cover")), strict=True)]
        yield pa.RecordBatch.from_arrays(
            [pa.array([r[0] for r in rows], pa.int64()), pa.array([len(r[1]) for r in rows], pa.int64()), pa.array([len(r[1]) - len(r[2]) for r in rows], pa.int64()), pa.array([len(r[3]) for r in rows], pa.int64()), pa.array([hashlib.sha256(r[2]).hexdigest() for r in rows], pa.string()), pa.array([[{"start": a, "end": e} for a, e in r[3]] for r in rows], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))],
            ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"],
        )


def repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans (the removed byte runs)."""
    return with_spans(docs).mapInArrow(_removed, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<start:long,end:long>>")


def op2_suffix_repeats(spark, sf_dir):
    from touchline.llm.common import table

    return repeats(table(spark, sf_dir, "documents")).drop("spans")


def without_repeats(spark, docs: DataFrame, sf_dir: str | None = None) -> DataFrame:
    """The documents with repeated strings cut out of text and n_chars set anew, other columns
    unchanged. Half a character at the edge of a cut is dropped with it; a document of which
    nothing but white space is left goes, unless it was such before."""
    @F.pandas_udf("string")
    def remaining(body: pd.Series, start: pd.Series, end: pd.Series) -> pd.Series:
        out = []
        for b, s, e in zip(body, start, end, strict=True):
            kept, at = [], 0
            for first, last in zip(*map(np.ndarray.tolist, merged(np.asarray(s, np.int64), np.asarray(e, np.int64), len(b))), strict=True):
                kept.append(b[at:first])
                at = last
            out.append((b"".join(kept) + b[at:]).decode("utf-8", "ignore"))
        return pd.Series(out, dtype=object)

    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    # the row is wrapped, so that its columns can have any names
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))).alias("did"), F.xxhash64(text).alias("th"))
    cover = spans(docs).groupBy("did", "th").agg(F.collect_set(F.struct("start", "end")).alias("cover"))
    joined = rows.join(cover, ["did", "th"], "left")
    touched, old = F.col("cover").isNotNull(), F.col("row.text").cast("string")
    bounds = lambda side: F.coalesce(F.col(f"cover.{side}"), F.array().cast("array<bigint>"))
    # untouched rows don't go through Python
    new = F.when(touched, remaining(F.when(touched, old.cast("binary")).otherwise(F.lit(b"")), bounds("start"), bounds("end"))).otherwise(old)
    out = joined.select("row", touched.alias("touched"), new.alias("new")).where(F.expr(r"not touched or trim(regexp_replace(new, '\\s+', ' ')) <> ''"))
    own = lambda c: F.col("row").getField(c)
    value = lambda c: F.col("new") if c == "text" else F.when(F.col("touched"), F.char_length("new")).otherwise(own(c)) if c == "n_chars" else own(c)
    return out.select(*[value(c).cast(docs.schema[c].dataType).alias(c) for c in docs.columns])
