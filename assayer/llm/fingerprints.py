"""Document fingerprints: invertible Bloom lookup sketches of paragraphs. DataFrame and SQL functions only.

A text's paragraphs are its lines, cut after full stops whatever their length
(LONG is 0), so a passage gives the same keys wherever it stands. The set of a text holds a 64-bit key for each different paragraph,
of its hash and how often it occurs. A sketch has CELLS cells in three tables;
a key goes into one cell of each, which keeps how many keys it holds, their xor
and the xor of their check hashes. The fingerprint is the sketch's non-empty
cells, written out.

Two sketches subtract cell by cell: shared keys vanish. Peeling takes a key out
wherever a cell holds just one (plus or minus), and goes on until the cells are
empty; what came out is what differs, to either side, and gives the Jaccard
likeness of the two sets. A sketch holds some 35 differences. A pair with more
fails and is tried again with larger sketches: keys are dealt to as many
sketches as their number asks for, with other hashes, and again twice as many.
There an aggregation by cell subtracts, and only cells that don't come out empty
go on. Only pairs that failed keep their keys and are shuffled, once an attempt.

Defined results: null text is the empty text, with an empty fingerprint. Two
texts without paragraphs are alike (1.0); one with and one without are not
(0.0). The next document is that of the next larger doc_id, null ids last, rows
of one doc_id in the order of their texts; after the last comes the first.
Rows are all kept. Extra columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from assayer.llm.common import discard, released, shuffle_partitions, staged
from assayer.llm.repeats import NO_ID

CELLS = 48
TABLE = CELLS // 3
LONG = 0
ROUNDS = 14
ATTEMPTS = 5
PER_SKETCH = 16


def _let(value: str, name: str, body: str) -> str:
    """body with name for value, which is worked out once."""
    return f"transform(array({value}), {name} -> {body})[0]"


def _keys(text: str) -> str:
    lines = f"filter(flatten(transform(split({text}, '\\n'), l -> if(length(l) > {LONG}, split(l, '(?<=[.]) +'), array(l)))), l -> l <> '')"
    starts = "filter(sequence(0, size(d) - 1), i -> i = 0 or d[i] <> d[i - 1])"
    keys = "transform(starts, (x, j) -> xxhash64(d[x], coalesce(get(starts, j + 1), size(d)) - x))"
    found = _let(f"array_sort(transform({lines}, l -> xxhash64(l)))", "d", f"if(size(d) = 0, cast(array() as array<bigint>), {_let(starts, 'starts', keys)})")
    return found


def _slot(key: str, table: int, attempt: int) -> str:
    """A key's cell in a table: each table reads other bits of it."""
    return f"(shiftright({key}, {12 * attempt + 4 * table}) & {TABLE - 1}L)"


def _cells(keys: str, attempt: int) -> str:
    """A sketch's cells. Keys are dealt to quarters of a table first, then to the cells of a quarter."""
    cell = "named_struct('c', 4 * q + r, 'n', size(own), 'k', aggregate(own, 0L, (a, x) -> a ^ x), 'h', aggregate(own, 0, (a, x) -> a ^ hash(x)))"
    tables = []
    for t in range(3):
        bits = 12 * attempt + 4 * t
        quarter = f"transform(sequence(0L, 3L), r -> {_let(f'filter(part, x -> (shiftright(x, {bits}) & 3L) = r)', 'own', cell)})"
        tables.append(f"flatten(transform(sequence(0L, 3L), q -> {_let(f'filter(keys, x -> (shiftright(x, {bits + 2}) & 3L) = q)', 'part', quarter)}))")
    return _let(keys, "keys", f"concat({', '.join(tables)})")


def _written(cells: str) -> str:
    return f"concat_ws(';', transform(filter(transform({cells}, (x, i) -> named_struct('i', i, 'x', x)), y -> y.x.n > 0), y -> concat(hex(y.i), ':', hex(y.x.n), ':', hex(y.x.k), ':', hex(y.x.h))))"


_TAKEN = "named_struct('c', x.c, 'n', x.n - aggregate(own, 0, (t, y) -> t + y.n), 'k', aggregate(own, x.k, (t, y) -> t ^ y.k), 'h', aggregate(own, x.h, (t, y) -> t ^ y.h))"


def _left(cells: str, t: int) -> str:
    """The cells of a table that aren't empty when the keys `single` are taken out."""
    changed = f"transform({cells}, x -> {_let(f'filter(single, y -> y.s[{t}] = x.c)', 'own', f'if(size(own) = 0, x, {_TAKEN})')})"
    return f"filter({changed}, x -> x.n <> 0 or x.k <> 0 or x.h <> 0)"


def _peeled(tables: list[str], attempt: int) -> str:
    """(p, q, ok): keys only in one, only in the other, and whether all cells came out empty, from the cells of each table that differ."""
    cells = f"named_struct({', '.join(f"'t{t}', {x}" for t, x in enumerate(tables))})"
    slots = ", ".join(_slot("x.k", t, attempt) for t in range(3))
    pure = [f"transform(filter(s.cells.t{t}, x -> abs(x.n) = 1 and hash(x.k) = x.h), x -> named_struct('n', x.n, 'k', x.k, 'h', x.h, 's', array({slots})))" for t in range(3)]
    single = f"array_distinct(concat({', '.join(pure)}))"
    after = f"named_struct({', '.join(f"'t{t}', {_left(f's.cells.t{t}', t)}" for t in range(3))})"
    more = f"named_struct('cells', {after}, 'p', s.p + size(filter(single, y -> y.n = 1)), 'q', s.q + size(filter(single, y -> y.n = -1)), 'done', false)"
    stop = "named_struct('cells', s.cells, 'p', s.p, 'q', s.q, 'done', true)"
    step = f"if(s.done, s, {_let(single, 'single', f'if(size(single) = 0, {stop}, {more})')})"
    start = f"named_struct('cells', {cells}, 'p', 0, 'q', 0, 'done', false)"
    ok = " and ".join(f"size(s.cells.t{t}) = 0" for t in range(3))
    return f"aggregate(sequence(1, {ROUNDS}), {start}, (s, r) -> {step}, s -> named_struct('p', s.p, 'q', s.q, 'ok', {ok}))"


def _difference(a: str, b: str, t: int) -> str:
    """The cells of a table in which two sketches differ."""
    part = f"slice({a}, {TABLE * t + 1}, {TABLE})"
    return f"filter(transform({part}, (x, i) -> named_struct('c', x.c, 'n', x.n - {b}[i + {TABLE * t}].n, 'k', x.k ^ {b}[i + {TABLE * t}].k, 'h', x.h ^ {b}[i + {TABLE * t}].h)), x -> x.n <> 0 or x.k <> 0 or x.h <> 0)"


def _likeness(p, q, a, b):
    """Of sets with a and b keys that differ in p and q."""
    return F.when((a == 0) & (b == 0), F.lit(1.0)).otherwise((a - p) / (a + q))


def with_next(docs: DataFrame) -> DataFrame:
    """(doc_id, text, next_text). Rows are dealt to ranges of doc_id once; each range also gets the first row of the next."""
    from pyspark.ml.feature import Bucketizer

    spark = docs.sparkSession
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(int(NO_ID))).alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    ids = rows.select("doc_id")
    n = 4 * shuffle_partitions(spark)
    cuts = ids.agg(F.percentile_approx("doc_id", [i / n for i in range(1, n)], 10 * n)).first()[0] or []
    splits = [float("-inf"), *sorted({float(c) for c in cuts}), float("inf")]
    ranges = Bucketizer(splits=splits, inputCol="_at", outputCol="_range") if len(splits) > 2 else None

    def ranged(df: DataFrame) -> DataFrame:
        if ranges is None:
            return df.withColumn("_range", F.lit(0))
        return ranges.transform(df.withColumn("_at", F.col("doc_id").cast("double"))).withColumn("_range", F.col("_range").cast("int")).drop("_at")

    heads = sorted((r["_range"], r["first"]) for r in ranged(ids).groupBy("_range").agg(F.min("doc_id").alias("first")).collect())  # a row for each range
    before = [(first, heads[i - 1][0]) for i, (_, first) in enumerate(heads)]
    # each range's first row, for the range before: as many rows as ranges
    first = rows.join(F.broadcast(spark.createDataFrame(before, "doc_id long, _range int")), "doc_id").groupBy("doc_id", "_range").agg(F.min("text").alias("text"))
    base = ranged(rows).withColumn("_head", F.lit(False)).unionByName(first.withColumn("_head", F.lit(True)))
    window = Window.partitionBy("_range").orderBy("_head", "doc_id", "text")
    return base.withColumn("next_text", F.lead("text").over(window)).where(~F.col("_head")).select("doc_id", "text", "next_text")


def compare(pairs: DataFrame) -> DataFrame:
    """(row, likeness) of staged pairs (row, a, b) of arrays of keys, by sketches of growing size. row must be unique."""
    done, now = None, pairs
    n = F.size("a") + F.size("b")
    for attempt in range(1, ATTEMPTS):
        sketches = F.greatest(F.lit(1), F.ceil(n * 2 ** (attempt - 1) / PER_SKETCH))
        signed = lambda side, sign: F.transform(side, lambda x: F.struct(x.alias("key"), F.lit(sign).alias("sign")))
        # all that follows is grouped by row first, so the arrays are shuffled and nothing else
        dealt = now.select("row", "a", "b").repartition(shuffle_partitions(pairs.sparkSession), "row").withColumns({"sketches": sketches, "na": F.size("a"), "nb": F.size("b")})
        keys = dealt.select("row", "na", "nb", "sketches", F.explode(F.concat(signed("a", 1), signed("b", -1))).alias("x")).select("row", "na", "nb", F.pmod(F.xxhash64("x.key", F.lit(attempt)), "sketches").alias("sketch"), F.col("x.key").alias("key"), F.col("x.sign").alias("sign"))
        cell = F.explode(F.expr(f"array({', '.join(f"named_struct('t', {t}, 'c', {_slot('key', t, attempt)})" for t in range(3))})"))
        cells = keys.withColumn("x", cell).groupBy("row", "na", "nb", "sketch", "x.t", "x.c").agg(F.sum("sign").cast("int").alias("n"), F.bit_xor("key").alias("k"), F.bit_xor(F.hash("key")).alias("h"))
        differ = F.expr("n <> 0 or k <> 0 or h <> 0")
        left = [F.collect_list(F.when(differ & (F.col("t") == t), F.struct("c", "n", "k", "h"))).alias(f"t{t}") for t in range(3)]
        one = cells.groupBy("row", "na", "nb", "sketch").agg(*left).select("row", "na", "nb", F.expr(_peeled(["t0", "t1", "t2"], attempt)).alias("o"))
        got = one.groupBy("row", "na", "nb").agg(F.sum("o.p").alias("p"), F.sum("o.q").alias("q"), F.bool_and("o.ok").alias("ok"))
        tried = staged(got.withColumn("ok", F.expr("ok and p - q = na - nb")), f"attempt-{attempt}")
        fine = tried.where("ok").select("row", _likeness(F.col("p"), F.col("q"), F.col("na"), F.col("nb")).alias("likeness"))
        done = fine if done is None else done.unionByName(fine)
        released(pairs.sparkSession)
        failed = tried.where("not ok").select("row")
        if failed.isEmpty():
            return done
        now = staged(now.join(failed, "row", "left_semi"), f"failed-{attempt}")
        released(pairs.sparkSession)
    shared = F.size(F.array_intersect("a", "b"))  # no sketch came out after so many: the sets themselves
    return done.unionByName(now.select("row", (shared / (n - shared)).alias("likeness")))


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next."""
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    pairs = with_next(docs).withColumn("n_chars", n.cast("long")).withColumn("edited", F.concat(F.substring(F.col("text"), F.lit(1), n - half), F.substring(F.col("next_text"), F.lit(1), half)))
    keys = staged(pairs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), F.expr(_keys("text")).alias("own"), F.expr(_keys("edited")).alias("edited"), F.expr(_keys("next_text")).alias("next")), "keys")
    released(docs.sparkSession)
    sketches = f"named_struct('own', {_cells('own', 0)}, 'edited', {_cells('edited', 0)}, 'next', {_cells('next', 0)})"
    peeled = {c: _peeled([_difference("t.own", f"t.{c}", t) for t in range(3)], 0) for c in ("edited", "next")}
    result = f"named_struct('f', {_written('t.own')}, 'e', {_written('t.edited')}, 'edited', {peeled['edited']}, 'next', {peeled['next']})"
    sides = ("edited", "next")
    near = {c: F.when(F.col(f"o.{c}.ok"), _likeness(F.col(f"o.{c}.p"), F.col(f"o.{c}.q"), F.size("own"), F.size(c))).alias(f"near_{c}") for c in sides}
    kept = {c: F.when(~F.col(f"o.{c}.ok"), F.col(c)).alias(c) for c in sides}
    own = F.when(~(F.col("o.edited.ok") & F.col("o.next.ok")), F.col("own")).alias("own")
    names = ["row", "doc_id", "n_chars", "edited_sha256"]
    first = keys.withColumn("o", F.expr(_let(sketches, "t", result)))
    first = staged(first.select(*names, F.col("o.f").alias("fingerprint"), F.col("o.e").alias("edited_fingerprint"), *near.values(), own, *kept.values()), "sketches")
    discard(keys)
    again = [first.where(F.col(c).isNotNull()).select((F.col("row") * 2 + i).alias("row"), F.col("own").alias("a"), F.col(c).alias("b")) for i, c in enumerate(sides)]
    side = F.pmod("row", F.lit(2))
    found = compare(again[0].unionByName(again[1])).groupBy(F.expr("row div 2").alias("row")).agg(*(F.max(F.when(side == i, F.col("likeness"))).alias(f"again_{c}") for i, c in enumerate(sides)))
    whole = first.where("own is null").drop("own", *sides)
    open_ = first.where("own is not null").drop("own", *sides).join(found, "row").withColumns({f"near_{c}": F.coalesce(f"near_{c}", f"again_{c}") for c in sides})
    out = whole.unionByName(open_.select(whole.columns))
    return out.select(F.nullif(F.col("doc_id"), F.lit(int(NO_ID))).alias("doc_id"), "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")


def op7_fingerprints(spark, sf_dir: str) -> DataFrame:
    return fingerprints(spark.read.parquet(f"{sf_dir}/documents.parquet"))
