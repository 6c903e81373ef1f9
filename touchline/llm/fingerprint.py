r"""Document fingerprints: invertible Bloom lookup sketches of paragraph digests. Native Spark
SQL throughout.

A paragraph is cut into pieces by content: at the end of a line, after every third word (by its
hash) that ends in one of ``.!?``, and after words whose hash is divisible by CUT, so that long
sentences and text without any have pieces too and an edit changes the pieces around it only. The pieces' XXH64
digests form a set. A sketch has four rows of cells: each digest goes into one cell of each row; a
cell holds a count, the XOR of its digests and the XOR of their check sums. The fingerprint is a
sketch of 4 x 4 cells in base64, so equal texts have equal fingerprints; a row's counts
add up to the size of the set.

Two fingerprints are subtracted cell by cell; what both versions hold cancels out. Peeling then
takes digests out of cells that hold exactly one (count 1 or -1 and a fitting check sum)
until all cells are empty, which recovers the digests that differ and on which side. Pairs whose
cells stay get larger sketches, a cell a row for every LOAD digests of both: the cells of all such
pairs are rows of one table, subtracted by an aggregation, and peeled row of cells after row of
cells (a digest is in one cell of a row, so it is taken out once) by STEPS more. Pairs that
still fail get twice as many cells. Should TRIES of them fail, the sets themselves are compared.

Likeness is 1 - d / (a + b): d recovered digests, a and b the sizes that the fingerprints
tell (1 if both are 0).

The next document (ascending doc_id, the first follows the last) is found without a global
order of texts: the order is cut into ranges at rows of a sample (SAMPLED rows a range, as
many ranges as RANGES times the shuffle partitions), a text moves once to its range, and
ranges hand their first row to the one before.

Defined results: null text is empty; null doc_id comes first; rows with equal doc_id follow
each other by a hash of the text, then by text; a single row is its own next; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from touchline.llm.common import written

ROWS, SLOTS, ROUNDS = 4, 8, 12
#: Slots a row in the fingerprint itself.
SMALL = 4
CUT, SENTENCES, LOAD, TRIES = 32, 3, 1.0, 6
#: The first words of a text are cut more finely (at every sentence and every eighth word), so that short texts have several pieces.
FINE, FINE_CUT = 40, 8
#: Tasks of an attempt for each shuffle partition: a digest becomes several rows there.
SPREAD = 4
#: Peeling steps of an attempt with larger sketches, a row of cells each.
STEPS = 8
RANGES, SAMPLED = 4, 8
#: Between pieces; a text that holds it is cut there, like any other text with it.
MARK = "\\u001e"


def digests(text: Column) -> Column:
    """The set of digests of the text's pieces."""
    words = F.split(text, r" |(?<=\n)")
    last = lambda w, among: F.instr(F.lit(among), F.right(w, F.lit(1))) > 0
    rarity = lambda w, i: F.when(last(w, "\n"), 1).when(last(w, ".!?"), F.when(i < FINE, 1).otherwise(SENTENCES)).otherwise(F.when(i < FINE, FINE_CUT).otherwise(CUT))
    ends = lambda w, i: F.pmod(F.xxhash64(w), rarity(w, i)) == 0
    pieces = F.split(F.array_join(F.transform(words, lambda w, i: F.concat(w, F.when(ends(w, i), F.lit("\u001e")).otherwise(F.lit(" ")))), ""), MARK)
    return F.array_distinct(F.transform(F.filter(pieces, lambda p: F.trim(p) != ""), lambda p: F.xxhash64(p)))


def let(name: str, value: str, body: str) -> str:
    """``body`` with ``name`` standing for a value that is computed once."""
    return f"transform(array({value}), {name} -> {body})[0]"


def check_of(key: str) -> str:
    return f"(xxhash64({key}) & 4294967295L)"


def slot_of(key: str, row: str, slots: int = SLOTS) -> str:
    return f"(shiftrightunsigned({key}, 3 * ({row})) & {slots - 1}L)"


EMPTY = "named_struct('n', 0, 'k', 0L, 'c', 0L)"


def sketch(keys: str, slots: int = SLOTS) -> str:
    """The cells of one block from an array of digests, row by row."""
    add = f"(s, d) -> named_struct('n', s.n + 1, 'k', s.k ^ d, 'c', s.c ^ {check_of('d')})"
    row = lambda r: f"transform(sequence(0L, {slots - 1}L), i -> aggregate(filter({keys}, d -> {slot_of('d', str(r), slots)} = i), {EMPTY}, {add}))"
    return f"concat({', '.join(map(row, range(ROWS)))})"


def subtract(one: str, two: str) -> str:
    return f"zip_with({one}, {two}, (x, y) -> named_struct('n', x.n - y.n, 'k', x.k ^ y.k, 'c', x.c ^ y.c))"


NONE = "cast(array() as array<struct<n:int,k:bigint>>)"


def peel(cells: str, slots: int = SLOTS) -> str:
    """(ok, found): the digests that a difference holds, n = 1 for the first side's and -1 for the other's;
    not ok if it can't be emptied. What is pure is taken out of all cells at once, until nothing is."""
    pure = f"array_distinct(transform(filter(s.cells, x -> abs(x.n) = 1 and {check_of('x.k')} = x.c), x -> named_struct('n', x.n, 'k', x.k)))"
    fewer = f"transform(s.cells, (x, i) -> aggregate(filter(pure, p -> {slot_of('p.k', f'i div {slots}', slots)} = i % {slots}), x, (y, p) -> named_struct('n', y.n - p.n, 'k', y.k ^ p.k, 'c', y.c ^ {check_of('p.k')})))"
    step = let("pure", pure, f"if(size(pure) = 0, named_struct('cells', s.cells, 'found', s.found, 'on', false), named_struct('cells', {fewer}, 'found', concat(s.found, pure), 'on', true))")
    start = f"named_struct('cells', {cells}, 'found', {NONE}, 'on', true)"
    left = "exists(s.cells, x -> x.n <> 0 or x.k <> 0L or x.c <> 0L)"
    return f"aggregate(sequence(1, {ROUNDS}), {start}, (s, r) -> if(s.on, {step}, s), s -> named_struct('ok', not {left}, 'found', s.found))"


def size_of(cells: str) -> str:
    """The number of digests in a set by its fingerprint."""
    return f"aggregate(slice({cells}, 1, {SMALL}), 0, (t, x) -> t + x.n)"


def check(key: Column) -> Column:
    return F.xxhash64(key).bitwiseAND(F.lit(4294967295))


def cell_of(key: Column, row: Column | int, slots: Column) -> Column:
    row = F.lit(row) if isinstance(row, int) else row
    return row * slots + F.pmod(F.xxhash64(key, row), slots)


def attempt(sets: DataFrame, scale: float, listed: bool = True) -> DataFrame:
    """row, which, ok, found (a list, or the number if not ``listed``): the differing digests of each pair from
    sketches of ROWS x slots cells. sets: row, own, pairs (array of which, two, n: the digests of both). All
    that belongs to a row stays in the partition that it is dealt to."""
    pair = ["row", "which", "slots"]
    sided = lambda c, sign: F.transform(c, lambda d: F.struct(F.lit(sign).alias("n"), d.alias("k")))
    slots = F.ceil(F.col("n") * scale / LOAD) + SMALL
    tasks = SPREAD * int(sets.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    pairs = sets.repartition(tasks, "row").select("row", F.col("own").alias("one"), F.explode("pairs").alias("p")).select("row", "one", "p.*")
    items = pairs.select("row", "which", slots.alias("slots"), F.explode(F.concat(sided("one", 1), sided("two", -1))).alias("d")).select(*pair, "d.n", "d.k")
    cells = items.withColumn("r", F.explode(F.array(*map(F.lit, range(ROWS))))).select(*pair, F.lit(False).alias("found"), cell_of(F.col("k"), F.col("r"), F.col("slots")).alias("cell"), "n", "k", check(F.col("k")).alias("c"))
    held = F.col("found") | (F.col("n") != 0) | (F.col("k") != 0) | (F.col("c") != 0)
    summed = lambda df: df.groupBy(*pair, "found", "cell").agg(F.sum("n").cast("int").alias("n"), F.bit_xor("k").alias("k"), F.bit_xor("c").alias("c")).where(held)
    cells = summed(cells)
    entry = lambda found, cell, n: F.struct(F.lit(found).alias("found") if isinstance(found, bool) else found.alias("found"), cell.alias("cell"), n.alias("n"), F.col("k"), F.col("c"))
    for step in range(STEPS):
        row = step % ROWS
        pure = ~F.col("found") & (F.floor(F.col("cell") / F.col("slots")) == row) & (F.abs("n") == 1) & (F.col("c") == check(F.col("k")))
        # a pure cell becomes a found digest, which is taken out of its cells in the other rows
        others = [entry(False, cell_of(F.col("k"), r, F.col("slots")), -F.col("n")) for r in range(ROWS) if r != row]
        moved = F.when(pure, F.array(entry(True, F.col("k"), F.col("n")), *others)).otherwise(F.array(entry(F.col("found"), F.col("cell"), F.col("n"))))
        cells = summed(cells.select(*pair, F.explode(moved).alias("e")).select(*pair, "e.*"))
    found = F.collect_list(F.when(F.col("found"), F.struct("n", "k"))) if listed else F.count_if("found")
    return cells.groupBy("row", "which").agg(F.min("found").alias("ok"), found.alias("found"))


def recovered(sets: DataFrame, listed: bool = True) -> DataFrame:
    """row, which, found of ``attempt``'s sets by ever larger sketches; pairs of equal sets have no row."""
    done, todo = [], sets
    for k in range(TRIES):
        tried = written(attempt(todo, 2.0**k, listed), "tried")
        done.append(tried.where("ok").select("row", "which", "found"))
        failed = tried.where("not ok").select("row", "which")
        if not failed.limit(1).count():
            break
        again = failed.groupBy("row").agg(F.collect_set("which").alias("again"))
        todo = written(todo.join(again, "row").withColumn("pairs", F.filter("pairs", lambda p: F.array_contains("again", p["which"]))).drop("again"), "failed")
    else:
        by_set = lambda x, y, n: F.transform(F.array_except(x, y), lambda k: F.struct(F.lit(n).alias("n"), k.alias("k")))
        left = todo.select("row", F.col("own").alias("one"), F.explode("pairs").alias("p")).select("row", "one", "p.*")
        exact = F.concat(by_set("one", "two", 1), by_set("two", "one", -1))
        done.append(left.select("row", "which", (exact if listed else F.size(exact).cast("long")).alias("found")))
    return reduce(DataFrame.unionByName, done)


def likeness(found: Column, n: str) -> Column:
    return F.when(F.col(n) == 0, F.lit(1.0)).otherwise(1.0 - found / F.col(n).cast("double"))


def encoded(cells: str) -> Column:
    """The fingerprint: of every cell 4 hex digits of the count, 16 of the digests, 8 of the check sums, as base64."""
    cell = "concat(lpad(hex(x.n), 4, '0'), lpad(hex(x.k), 16, '0'), lpad(hex(x.c), 8, '0'))"
    return F.translate(F.expr(f"base64(unhex(array_join(transform({cells}, x -> {cell}), '')))"), "\r\n", "")


def place_in(bounds: list[tuple[bool, int, int]]) -> Column:
    """How many of the ascending bounds are at most (known, id, th), by binary search."""
    kind = "array<struct<known:boolean,id:long,th:long>>"
    listed = F.from_json(F.lit(json.dumps([{"known": a, "id": b, "th": c} for a, b, c in bounds])), kind)
    steps = [1 << k for k in reversed(range(len(bounds).bit_length()))]
    key = F.struct("known", "id", "th")
    further = lambda at, step: F.when(at + step <= len(bounds), F.element_at(listed, at + step) <= key).otherwise(F.lit(False))
    return F.aggregate(F.array(*map(F.lit, steps or [0])), F.lit(0), lambda at, step: F.when(further(at, step), at + step).otherwise(at)) if bounds else F.lit(0)


def with_next(docs: DataFrame) -> DataFrame:
    """doc_id, text, next_text."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    keys = rows.select(F.col("doc_id").isNotNull().alias("known"), F.coalesce("doc_id", F.lit(0)).alias("id"), F.xxhash64("text").alias("th"))
    first = keys.agg(F.min(F.struct("known", "id", "th"))).first()[0]
    ranges = RANGES * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # a fixed number of short rows for each range
    sample = sorted(map(tuple, keys.orderBy(F.xxhash64("known", "id", "th")).limit(SAMPLED * ranges).collect()))
    bounds = sorted({tuple(first), *sample[SAMPLED // 2 :: SAMPLED]}) if first else []
    order = ["known", "id", "th", "text"]
    placed = rows.withColumns({"known": F.col("doc_id").isNotNull(), "id": F.coalesce("doc_id", F.lit(0)), "th": F.xxhash64("text")}).withColumn("part", place_in(bounds))
    # every bound is a row, so no range is empty
    heads = placed.groupBy("part").agg(F.min(F.struct(*order)).alias("head"))
    guests = heads.select(F.when(F.col("part") == 1, F.lit(len(bounds))).otherwise(F.col("part") - 1).alias("part"), F.lit(None).cast("long").alias("doc_id"), "head.*", F.lit(True).alias("guest"))
    columns = ["part", "doc_id", *order, "guest"]
    dealt = placed.withColumn("guest", F.lit(False)).select(columns).unionByName(guests.select(columns)).repartition("part")
    window = Window.partitionBy("part").orderBy("guest", *order)
    return dealt.withColumn("next_text", F.lead("text").over(window)).where("not guest").select("doc_id", "text", "next_text")


def edited(text: Column, next_text: Column) -> Column:
    """The last half (rounded down) of the code points replaced by the next text's first ones."""
    n = F.char_length(text)
    half = F.floor(n / 2).cast("int")
    return F.concat(F.substring(text, F.lit(1), n - half), F.substring(next_text, F.lit(1), half))


def fingerprints(docs: DataFrame, listed: bool = True) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, and the recovered
    digests of the pieces that differ: differs_edited, differs_next (n: 1 only here, -1 only there; k), or
    how many they are if not ``listed``."""
    both = with_next(docs).withColumn("edited", edited(F.col("text"), F.col("next_text")))
    kept = ["row", "doc_id", "n_chars", "edited_sha256"]
    sets = both.select(F.monotonically_increasing_id().alias("row"), "doc_id", F.char_length("text").cast("long").alias("n_chars"), F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), digests(F.col("text")).alias("own"), digests(F.col("edited")).alias("new"), digests(F.col("next_text")).alias("following"))
    cells = sets.select("*", *[F.expr(sketch(x, SMALL)).alias(f"{x}_cells") for x in ("own", "new", "following")])
    small = lambda x: F.expr(peel(subtract("own_cells", f"{x}_cells"), SMALL))
    tried = cells.select(
        *kept, encoded("own_cells").alias("fingerprint"), encoded("new_cells").alias("edited_fingerprint"), "own",
        *[F.expr(f"{size_of('own_cells')} + {size_of(f'{x}_cells')}").alias(f"n_{x}") for x in ("new", "following")],
        *[c for x in ("new", "following") for c in (small(x).alias(f"small_{x}"), F.col(x))],
    )
    # what the small sketches tell needs no sets any more; written, so that the row numbers stay
    failed = lambda x: ~F.col(f"small_{x}.ok")
    shown = lambda x: F.col(f"small_{x}.found") if listed else F.size(f"small_{x}.found").cast("long")
    pair = lambda x: F.when(failed(x), F.struct(F.lit(x).alias("which"), F.col(x).alias("two"), F.col(f"n_{x}").alias("n")))
    base = tried.select(
        *kept, "fingerprint", "edited_fingerprint", "n_new", "n_following", *[F.when(~failed(x), shown(x)).alias(f"found_{x}") for x in ("new", "following")],
        F.when(failed("new") | failed("following"), F.col("own")).alias("own"), F.array_compact(F.array(pair("new"), pair("following"))).alias("pairs"),
    )
    base = written(base, "sketches")
    larger = recovered(base.where("own is not null").select("row", "own", "pairs"), listed)
    none = F.array().cast("array<struct<n:int,k:bigint>>") if listed else F.lit(0).cast("long")
    for x in ("new", "following"):
        base = base.join(larger.where(F.col("which") == x).select("row", F.col("found").alias(f"larger_{x}")), "row", "left").withColumn(f"differs_{x}", F.coalesce(f"found_{x}", f"larger_{x}", none))
    near = lambda x: likeness(F.size(f"differs_{x}") if listed else F.col(f"differs_{x}"), f"n_{x}")
    return base.select(*kept[1:], "fingerprint", "edited_fingerprint", near("new").alias("near_edited"), near("following").alias("near_next"), F.col("differs_new").alias("differs_edited"), F.col("differs_following").alias("differs_next"))


def op9_iblt_fingerprints(spark, sf_dir):
    from touchline.llm.common import table

    return fingerprints(table(spark, sf_dir, "documents"), listed=False).drop("differs_edited", "differs_next")
