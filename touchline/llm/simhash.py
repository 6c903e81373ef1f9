"""SimHash near-duplicates through Golay-code fuzzy hashing.

Fingerprint: A-Z lower-cased, words are runs of anything but the ASCII white space
0x20 0x09-0x0D, every run of ``words`` words is a shingle (repeats count; a text with
fewer words is one shingle; none: fingerprint 0). A bit is set where it is set in more than
half of the shingles' XXH64 (seed 42).

Links: two fingerprints with at most 2 differing bits. The 64 bits are cut into three
segments of 22, 21 and 21 bits. The binary Golay code of length 23 is perfect: every
word is within 3 bits of exactly one codeword. A segment (zero-padded to 23 bits) gets as
indices its own codeword and, where that is 3 bits away, the codewords 4 bits away; two
words that differ in one bit then share an index: let v, v' decode to c, c'. If they
differ, v is at most 4 bits from c' and, being no nearer than 4, lists it. Pigeonhole: with
at most 2 errors in three segments in a ring, some segment is free of errors while the
next one has at most one. (Errors 2-0-0, 1-1-0, ...: each leaves such a pair.) So the
keys (exact segment, index of the next) miss no link, and every candidate is verified.

Rows with equal fingerprints are one class before anything is joined. Within a key, no
pairs are written out: members are linked through the words at distance 1 ("midpoints").
Two fingerprints of distance 2 or less share a midpoint and two that share one are at most
2 apart, so naming the smallest member of each midpoint gives the exact links' components.
A key of any size takes 65 rows a member, in blocks; keys above ``HOT_KEY`` members
do the same as a Spark aggregation over midpoints instead of in one task.

Defined results: null and empty texts have fingerprint 0 and are linked like others; a null
doc_id takes part in links but never names a component unless it is alone in it; repeated
rows appear repeatedly with equal results; an empty table gives no rows; other columns are ignored.

The pipeline's stage (``one_of_each``) has a rule of its own: two texts are linked where the sets
of their runs of STAGE_WORDS words have a Jaccard likeness of LIKENESS or more. At 0.8 two
fingerprints differ in about 10 bits, which no Golay key reaches, so candidates also meet in BANDS
keys of BAND_ROWS minima each: a pair at 0.8 shares none with a probability of 7e-5. Candidates
that differ in more than SIEVE_BITS bits (of fingerprints over the distinct shingles) or whose
sizes rule the likeness out are dropped; all others are decided by their whole sets of 64-bit
shingle hashes. Texts with equal sets are one class beforehand.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from touchline.llm.common import checkpointed, small_batches, written

SEED, SHINGLE_WORDS, MAX_BITS = 42, 3, 2
#: Generator polynomial of the binary Golay code (fixed value): x^11+x^10+x^6+x^5+x^4+x^2+1.
GOLAY_POLY = 0b110001110101
SEGMENTS = ((0, 22), (22, 21), (43, 21))
#: Members of one key that a task links in memory; larger keys go through an aggregation.
HOT_KEY = 20_000
#: The stage's shingle width and least likeness (as a fraction).
STAGE_WORDS, LIKENESS = 5, (4, 5)
BANDS, BAND_ROWS, SIEVE_BITS = 24, 5, 26
#: Members of one key that the stage compares all with all at once; in larger keys only those that are still apart.
SMALL_KEY = 8
#: Members of a block of a large key.
KEY_BLOCK = 4096
#: Bits by which members may be farther from a key's middle than the nearest one and still stand for it.
MIDDLE_BITS = 3
#: Shingles whose bits are counted at a time.
BLOCK = 1 << 14
#: Fingerprints whose keys (up to 18 each) are made at a time.
KEYED = 4096


def words_of(text: bytes) -> list[bytes]:
    """bytes.lower touches A-Z only and bytes.split cuts at the ASCII white space."""
    return text.lower().split()


def shingle_hashes(text: str | None, words: int) -> Iterator[np.ndarray]:
    """XXH64 of every run of ``words`` words (all of fewer words is one run), BLOCK at a time."""
    import xxhash

    found = words_of((text or "").encode("utf-8", "surrogatepass"))
    if not found:
        return
    joined = memoryview(b" ".join(found))
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(1, len(found) - words + 1)
    last = ends[min(words, len(found)) - 1 :].tolist()
    first = starts[:n].tolist()
    digest = xxhash.xxh64_intdigest
    for at in range(0, n, BLOCK):
        yield np.array([digest(joined[a:b], SEED) for a, b in zip(first[at : at + BLOCK], last[at : at + BLOCK], strict=True)], np.uint64)


def majority(blocks: Iterable[np.ndarray]) -> int:
    """The bits that are set in more than half of the hashes."""
    ones, n = np.zeros(64, np.int64), 0
    for h in blocks:
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        n += len(h)
    return int.from_bytes(np.packbits(2 * ones > n, bitorder="little").tobytes(), "little")


def simhash(text: str | None, words: int = SHINGLE_WORDS) -> int:
    return majority(shingle_hashes(text, words))


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        found = np.fromiter((simhash(t.as_py()) for t in b.column("text")), np.uint64, b.num_rows)
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(found.view(np.int64))], ["doc_id", "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, fp (the 64 bits as a signed long)."""
    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_fingerprints, "doc_id long, fp long")


def golay_tables() -> tuple[np.ndarray, np.ndarray]:
    """error[syndrome]: the pattern of at most 3 bits with that syndrome. four: the
    patterns of 4 bits with each syndrome (5 where the decoding error has 3 bits), as [2048, 5]."""
    from itertools import combinations

    unit = np.array([remainder(1 << i) for i in range(23)], np.int64)
    error = np.zeros(2048, np.int64)
    for k in (1, 2, 3):
        at = np.array(list(combinations(range(23), k)))
        error[np.bitwise_xor.reduce(unit[at], axis=1)] = (1 << at).sum(axis=1)
    at = np.array(list(combinations(range(23), 4)))
    syndromes, patterns = np.bitwise_xor.reduce(unit[at], axis=1), (1 << at).sum(axis=1)
    three = np.bitwise_count(error) == 3
    keep = three[syndromes]
    order = np.argsort(syndromes[keep], kind="stable")
    four = np.zeros((2048, 5), np.int64)
    four[three] = patterns[keep][order].reshape(-1, 5)
    return error, four


def remainder(word: int) -> int:
    """Of a 23-bit word modulo the generator polynomial."""
    for i in range(22, 10, -1):
        if word >> i & 1:
            word ^= GOLAY_POLY << (i - 11)
    return word


def syndromes(words: np.ndarray) -> np.ndarray:
    unit = [remainder(1 << i) for i in range(23)]
    found = np.zeros(len(words), np.int64)
    for i, u in enumerate(unit):
        found ^= np.where(words >> i & 1, u, 0)
    return found


_tables: tuple[np.ndarray, np.ndarray] | None = None


def indices(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, codeword index of 12 bits) of every index of every word."""
    global _tables
    if _tables is None:
        _tables = golay_tables()
    error, four = _tables
    s = syndromes(words)
    e = error[s]
    three = np.flatnonzero(np.bitwise_count(e) == 3)
    rows = np.concatenate((np.arange(len(words)), np.repeat(three, 5)))
    codewords = np.concatenate((words ^ e, (words[three, None] ^ four[s[three]]).ravel()))
    return rows, codewords >> 11  # systematic: the upper 12 bits name a codeword


def fuzzy_keys(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) of every key of every fingerprint (unsigned 64-bit)."""
    parts = [((fps >> np.uint64(at)) & np.uint64((1 << n) - 1)).astype(np.int64) for at, n in SEGMENTS]
    rows, keys = [], []
    for k in range(3):
        r, index = indices(parts[(k + 1) % 3])
        rows.append(r)
        keys.append((k << 36) | (parts[k][r] << 12) | index)
    return np.concatenate(rows), np.concatenate(keys)


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        fps = b.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)
        for at in range(0, len(fps), KEYED):
            rows, keys = fuzzy_keys(fps[at : at + KEYED])
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(fps[at : at + KEYED][rows].view(np.int64))], ["key", "fp"])


def midpoint_links(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(member, smallest member with which it shares a midpoint), verified, without self-links."""
    fps = np.unique(fps)
    flips = np.concatenate(([np.uint64(0)], np.uint64(1) << np.arange(64, dtype=np.uint64)))
    best, a_all, b_all = None, [], []
    mids = (fps[:, None] ^ flips).ravel()
    who = np.repeat(fps, 65)
    order = np.argsort(mids, kind="stable")  # members are ascending within a midpoint
    mids, who = mids[order], who[order]
    new = np.concatenate(([True], mids[1:] != mids[:-1]))
    best = who[np.flatnonzero(new)][np.cumsum(new) - 1]
    linked = best != who
    a_all, b_all = who[linked], best[linked]
    assert not len(a_all) or int(np.bitwise_count(a_all ^ b_all).max()) <= MAX_BITS
    return a_all, b_all


def links_in(keys: np.ndarray, fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links inside each key; keys ascending, fingerprints different within a key. Keys with
    up to 8 members are compared by shifting the whole column, larger ones by midpoints."""
    new = np.concatenate(([True], keys[1:] != keys[:-1]))
    starts = np.flatnonzero(new)
    sizes = np.diff(np.append(starts, len(keys)))
    size = np.repeat(sizes, sizes)
    out_a, out_b = [], []
    for shift in range(1, min(8, int(sizes.max(initial=1)) - 1) + 1):
        i = np.flatnonzero((keys[:-shift] == keys[shift:]) & (size[:-shift] <= 8)) if len(keys) > shift else np.empty(0, np.int64)
        near = np.bitwise_count(fps[i] ^ fps[i + shift]) <= MAX_BITS
        out_a.append(fps[i + shift][near])
        out_b.append(fps[i][near])
    for k in np.flatnonzero(sizes > 8):
        a, b = midpoint_links(fps[starts[k] : starts[k] + sizes[k]])
        out_a.append(a)
        out_b.append(b)
    none = np.empty(0, np.uint64)
    return np.concatenate([none, *out_a]), np.concatenate([none, *out_b])


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Input sorted by key, keys of at most HOT_KEY members: at most one key is held over
    from a batch to the next."""
    keys, fps = np.empty(0, np.int64), np.empty(0, np.uint64)

    def out(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

    for batch in batches:
        keys = np.concatenate((keys, batch.column("key").to_numpy(zero_copy_only=False)))
        fps = np.concatenate((fps, batch.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)))
        if not len(keys) or keys[0] == keys[-1]:
            continue
        cut = int(np.searchsorted(keys, keys[-1]))
        yield out(*links_in(keys[:cut], fps[:cut]))
        keys, fps = keys[cut:], fps[cut:]
    if len(keys):
        yield out(*links_in(keys, fps))


def near_links(classes: DataFrame) -> DataFrame:
    """a, b: links between different fingerprints (column fp, distinct) that connect exactly
    what all pairs of at most MAX_BITS differing bits connect."""
    keyed = classes.select("fp").mapInArrow(_keys, "key long, fp long")
    sizes = keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    sized = merged(keyed, sizes, "key")
    few = sized.where(F.col("n") <= HOT_KEY).select("key", "fp").repartition("key").sortWithinPartitions("key", "fp").mapInArrow(_links, "a long, b long")
    # midpoints are the same whatever the key, so hot keys' members meet by midpoint alone
    flips = F.array(F.lit(0).cast("long"), *[F.expr(f"shiftleft(1L, {i})") for i in range(64)])
    hot = sized.where(F.col("n") > HOT_KEY).select("fp").distinct()
    mids = hot.select("fp", F.explode(F.transform(flips, lambda f: F.col("fp").bitwiseXOR(f))).alias("mid"))
    best = mids.groupBy("mid").agg(F.min("fp").alias("b"))
    far = merged(mids, best, "mid").where("fp <> b").select(F.col("fp").alias("a"), "b").where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= MAX_BITS)
    return few.unionByName(far).distinct()


def merged(left: DataFrame, right: DataFrame, on, how: str = "inner") -> DataFrame:
    """A join that sorts both sides in tasks: their sizes follow the corpus, and a broadcast table is built whole in the driver."""
    return left.join(right.hint("merge"), on, how)


def components(links: DataFrame) -> DataFrame:
    """node, root (the component's smallest node) of every node in a link. Each round, every
    node tells its neighbours and its root's the smallest root it has heard of, and labels
    are followed one step further, so that long chains take logarithmically many rounds."""
    edges = written(links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    labels = checkpointed(edges.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("root")))
    while True:
        heard = merged(edges, labels, edges.b == labels.node).select(F.col("a").alias("node"), "root")
        own = labels.select("node", "root")
        # what a node hears it also passes to the node that its label names
        nearest = heard.unionByName(own).groupBy("node").agg(F.min("root").alias("seen"))
        passed = merged(labels, nearest, "node").select(F.col("root").alias("node"), F.col("seen").alias("seen"))
        best = nearest.unionByName(passed).groupBy("node").agg(F.min("seen").alias("seen"))
        jumped = merged(best.alias("x"), best.select(F.col("node").alias("k"), F.col("seen").alias("further")), F.col("seen") == F.col("k"), "left")
        fresh = checkpointed(merged(jumped.select("node", F.least("seen", "further").alias("root")), labels.select("node", F.col("root").alias("was")), "node"))
        changed = fresh.where("root <> was").limit(1).count()
        labels = fresh.select("node", "root")
        if not changed:
            return labels


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fp (long), component_id, n_links (the other fingerprints that this one's
    component holds are not expanded; 1 where the fingerprint has any link, else 0)."""
    marked = written(fingerprints(docs), "simhash")
    classes = marked.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count("*").alias("copies"))
    roots = components(near_links(classes))
    grouped = merged(classes, roots, classes.fp == roots.node, "left").withColumn("component", F.coalesce("root", "fp"))
    least = grouped.groupBy("component").agg(F.min("first").alias("component_id"))
    labelled = merged(grouped, least, "component").select("fp", "component_id", F.col("root").isNotNull().cast("int").alias("linked"))
    return merged(marked, labelled, "fp").select("doc_id", "fp", "component_id", "linked")


def op10_simhash_golay(spark, sf_dir):
    from touchline.llm.common import table

    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def shingle_set(text: str | None, words: int = STAGE_WORDS) -> np.ndarray:
    """The distinct shingle hashes, ascending."""
    blocks = list(shingle_hashes(text, words))
    return np.unique(np.concatenate(blocks)) if blocks else np.empty(0, np.uint64)


_spread = np.random.default_rng(7)
FLIPS, FACTORS = (_spread.integers(0, 1 << 64, BANDS * BAND_ROWS, np.uint64) for _ in range(2))
FACTORS |= np.uint64(1)


def band_keys(found: np.ndarray) -> np.ndarray:
    """A key for each band: BAND_ROWS minima of the set under different hash functions."""
    least = np.full(BANDS * BAND_ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(found), 512):
        np.minimum(least, ((found[at : at + 512, None] ^ FLIPS) * FACTORS).min(axis=0), out=least)
    rows = least.reshape(BANDS, BAND_ROWS)
    key = np.arange(1, BANDS + 1, dtype=np.uint64)
    for j in range(BAND_ROWS):
        key = (key ^ rows[:, j]) * np.uint64(0x9E3779B97F4A7C15)
        key ^= key >> np.uint64(32)
    return key


def _shingled(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for b in batches:
            sids, sizes, fps, bands = [], [], [], []
            for t in b.column("text"):
                found = shingle_set(t.as_py(), words)
                sids.append(xxhash.xxh64_intdigest(found.tobytes(), SEED))
                sizes.append(len(found))
                fps.append(majority(found[at : at + BLOCK] for at in range(0, len(found), BLOCK)))
                bands.append(band_keys(found).view(np.int64))
            signed = lambda x: pa.array(np.array(x, np.uint64).view(np.int64))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(bands) + 1, dtype=np.int32) * BANDS), pa.array(np.concatenate([np.empty(0, np.int64), *bands])))
            yield pa.RecordBatch.from_arrays([b.column("row"), b.column("doc_id"), signed(sids), pa.array(sizes, pa.int64()), signed(fps), lists], ["row", "doc_id", "sid", "n", "fp", "bands"])

    return run


def _sets(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, t in zip(b.column("sid").to_pylist(), b.column("text"), strict=True):
                found = shingle_set(t.as_py(), words).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([i], pa.int64()), pa.ListArray.from_arrays(pa.array([0, len(found)], pa.int32()), pa.array(found))], ["sid", "s"])

    return run


def _short_sets(words: int):
    """The sets as 32-bit hashes, ascending."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [np.unique(shingle_set(t.as_py(), words).astype(np.uint32)).tobytes() for t in b.column("text")]
            yield pa.RecordBatch.from_arrays([b.column("sid"), pa.array(found, pa.binary())], ["sid", "s"])

    return run


def _stage_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The Golay keys and the bands of every class."""
    for b in batches:
        for at in range(0, b.num_rows, KEYED):
            part = b.slice(at, KEYED)
            sid, n, fp = (part.column(c).to_numpy(zero_copy_only=False) for c in ("sid", "n", "fp"))
            rows, keys = fuzzy_keys(fp.view(np.uint64))
            bands = part.column("bands").flatten().to_numpy(zero_copy_only=False)
            rows = np.concatenate((rows, np.repeat(np.arange(len(sid)), BANDS)))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate((keys, bands))), pa.array(sid[rows]), pa.array(n[rows]), pa.array(fp[rows])], ["key", "sid", "n", "fp"])


def sieved(fps: np.ndarray, n: np.ndarray, i, j) -> np.ndarray:
    """Whether the pairs (i, j) may be alike."""
    up, down = LIKENESS
    return (np.bitwise_count(fps[i] ^ fps[j]) <= SIEVE_BITS) & (down * np.minimum(n[i], n[j]) >= up * np.maximum(n[i], n[j]))


def key_pairs(keys: np.ndarray, sids: np.ndarray, n: np.ndarray, fps: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """(a, b, 0): candidates inside each key; keys ascending, sids different within a key. A key
    with more than SMALL_KEY members gives its members' pairs with the first one and with the first of
    those in the middle, and itself as (sid, key, 1). Keys of one group have one middle and
    mostly the same first ones, so a member meets few of them in all its keys together."""
    starts = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    sizes = np.diff(np.append(starts, len(keys)))
    size = np.repeat(sizes, sizes)
    for shift in range(1, min(SMALL_KEY, int(sizes.max(initial=1))) if len(keys) else 0):
        i = np.flatnonzero((keys[:-shift] == keys[shift:]) & (size[:-shift] <= SMALL_KEY))
        i = i[sieved(fps, n, i, i + shift)]
        yield sids[i], sids[i + shift], 0
    for k in np.flatnonzero(sizes > SMALL_KEY):
        at = np.arange(starts[k], starts[k] + sizes[k])
        ones = np.unpackbits(fps[at].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        centre = np.packbits(2 * ones > len(at), bitorder="little").view(np.uint64)[0]
        apart = np.bitwise_count(fps[at] ^ centre)
        for pivot in {int(at[0]), int(at[np.argmax(apart <= apart.min() + MIDDLE_BITS)])}:
            near = at[(at != pivot) & sieved(fps, n, at, pivot)]
            yield np.minimum(sids[near], sids[pivot]), np.maximum(sids[near], sids[pivot]), 0
        yield sids[at], keys[at], 1


def apart_pairs(keys: np.ndarray, roots: np.ndarray, sids: np.ndarray, n: np.ndarray, sets: np.ndarray, fps: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """The pairs inside each key that have different roots and whose sets may have LIKENESS, judged by their
    32-bit hashes, which never make less of it; sorted by key and root."""
    up, down = LIKENESS
    starts = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    for start, end in zip(starts, np.append(starts[1:], len(keys))):
        if roots[start] == roots[end - 1]:
            continue
        values = np.frombuffer(b"".join(sets[start:end]), np.uint32)
        size = np.fromiter(map(len, sets[start:end]), np.int64, end - start) // 4
        edge, lost = np.cumsum(size) - size, n[start:end] - size
        place = np.unique(values, return_inverse=True)[1]
        there = np.zeros(int(place.max(initial=-1)) + 1, bool)
        for i in range(start, end):
            near = np.arange(i + 1 + np.searchsorted(roots[i + 1 : end], roots[i], "right"), end)
            near = near[sieved(fps, n, near, i)]
            if not len(near):
                continue
            own = place[edge[i - start] : edge[i - start] + size[i - start]]
            there[own] = True
            from_ = edge[near[0] - start]
            held = np.append(0, np.cumsum(there[place[from_:]]))
            common = held[edge[near - start] + size[near - start] - from_] - held[edge[near - start] - from_] + np.minimum(lost[near - start], lost[i - start])
            there[own] = False
            near = near[down * common >= up * (n[near] + n[i] - common)]
            if len(near):
                yield np.minimum(sids[near], sids[i]), np.maximum(sids[near], sids[i]), 0


def _by_key(columns: list[str], pairs):
    """``pairs`` over whole keys of an input sorted by key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []

        def out() -> Iterator[pa.RecordBatch]:
            found = [np.concatenate(x) for x in zip(*held)]
            found[-1] = found[-1].view(np.uint64)
            for a, b, kind in pairs(*found):
                if len(a):
                    yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(np.full(len(a), kind, np.int32))], ["a", "b", "kind"])

        for batch in batches:
            now = [batch.column(c).to_numpy(zero_copy_only=False) for c in columns]
            if not len(now[0]):
                continue
            cut = int(np.searchsorted(now[0], now[0][-1]))
            if cut or held and held[-1][0][-1] != now[0][0]:
                held.append([x[:cut] for x in now])
                yield from out()
                held = []
            held.append([x[cut:] for x in now])
        if held:
            yield from out()

    return run


def alike(pairs: DataFrame, sources: Callable[[DataFrame], DataFrame], words: int) -> DataFrame:
    """a, b: the pairs (sids) whose shingle sets have at least LIKENESS; sources: sids -> sid, text."""
    pairs = written(pairs.select("a", "b").distinct(), "pairs")
    asked = pairs.select(F.col("a").alias("sid")).union(pairs.select("b")).distinct()
    sets = written(sources(asked).mapInArrow(_sets(words), "sid long, s array<long>"), "sets")
    both = pairs.join(sets.select(F.col("sid").alias("a"), F.col("s").alias("sa")), "a").join(sets.select(F.col("sid").alias("b"), F.col("s").alias("sb")), "b")
    common, (up, down) = F.size(F.array_intersect("sa", "sb")), LIKENESS
    return both.where(down * common >= up * (F.size("sa") + F.size("sb") - common)).select("a", "b")


def alike_roots(classes: DataFrame, sources: Callable[[DataFrame], DataFrame], words: int = STAGE_WORDS) -> DataFrame:
    """node, root of every sid that is linked; classes: sid, n, fp, bands; sources: sids -> sid, text."""
    some = classes.where("n > 0")
    keyed = some.select("sid", "n", "fp", "bands").mapInArrow(_stage_keys, "key long, sid long, n long, fp long")
    columns = ["key", "sid", "n", "fp"]
    met = written(keyed.repartition("key").sortWithinPartitions("key", "sid").mapInArrow(_by_key(columns, key_pairs), "a long, b long, kind int"), "met")
    links = written(alike(met.where("kind = 0"), sources, words), "alike")
    roots = components(links)
    large = met.where("kind = 1").select(F.col("a").alias("sid"), F.col("b").alias("key"))
    if not large.limit(1).count():
        return roots
    short = sources(large.select("sid").distinct()).mapInArrow(_short_sets(words), "sid long, s binary")
    # keys of any size are compared in pairs of blocks of about KEY_BLOCK members
    blocks = large.groupBy("key").agg(F.ceil(F.count("*") / KEY_BLOCK).cast("int").alias("blocks"))
    dealt = large.join(blocks, "key").withColumns({"own": F.pmod(F.xxhash64("sid"), "blocks").cast("int"), "other": F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))})
    dealt = dealt.select("sid", F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other")).alias("key"))
    members = some.select("sid", "n", "fp").join(short, "sid").join(roots.withColumnRenamed("node", "sid"), "sid", "left").withColumn("root", F.coalesce("root", "sid"))
    columns = ["key", "root", "sid", "n", "s", "fp"]
    apart = dealt.join(members, "sid").select(columns).repartition("key").sortWithinPartitions("key", "root", "sid").mapInArrow(_by_key(columns, apart_pairs), "a long, b long, kind int")
    more = written(alike(apart, sources, words), "alike")
    return components(links.unionByName(more)) if more.limit(1).count() else roots


def one_of_each(spark, docs: DataFrame, sf_dir: str | None = None, words: int = STAGE_WORDS) -> DataFrame:
    """Of each group of texts linked at LIKENESS (over ``words``-word shingles) the row with the
    smallest doc_id; ids that are null come last, and of equal ids the smallest row hash decides. Other
    rows of the same id are judged by their own text. A row that is there several times stays once."""
    small_batches(spark)
    columns = docs.columns
    rest = F.to_json(F.struct(F.lit(0).alias("_"), *[F.col(f"`{c}`") for c in columns if c not in ("doc_id", "text")]))
    # the hash skips nulls, so they are told apart by flags
    hash_ = F.xxhash64(F.col("doc_id").isNull(), "doc_id", F.col("text").isNull(), "text", rest).alias("row")
    # the row is wrapped, so that its columns can have any names
    keyed = docs.select(hash_, F.struct(*[F.col(f"`{c}`") for c in columns]).alias("own"))
    slim = docs.select(hash_, F.col("doc_id").cast("long"), F.col("text").cast("string"))
    marked = written(slim.mapInArrow(_shingled(words), "row long, doc_id long, sid long, n long, fp long, bands array<long>"), "shingles")
    classes = written(marked.groupBy("sid").agg(F.first("n").alias("n"), F.first("fp").alias("fp"), F.first("bands").alias("bands"), F.min("row").alias("row")), "classes")

    def sources(sids: DataFrame) -> DataFrame:
        rows = classes.select("sid", "row").join(sids, "sid", "left_semi")
        return slim.select("row", "text").join(rows, "row").select("sid", "text").dropDuplicates(["sid"])

    roots = alike_roots(classes, sources, words)
    placed = marked.select("row", "doc_id", "sid").join(roots, F.col("sid") == F.col("node"), "left")
    first = placed.groupBy(F.coalesce("root", "sid").alias("group")).agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row")).alias("least"))
    keep = first.select("least.row")
    return keyed.join(keep, "row", "left_semi").dropDuplicates(["row"]).select("own.*")
