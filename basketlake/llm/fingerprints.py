"""Document fingerprints: invertible Bloom lookup sketches of paragraph digests, in SQL functions only.

A text's paragraphs (lines, cut further where a sentence ends, and at content-defined places where they
stay long) are a set of 64-bit digests. A sketch has three tables of four cells; each digest enters one cell a table, and a cell keeps the count, the xor of its
digests and the xor of their checks. Two sketches subtract cell by cell, which leaves the digests that
differ: a cell with one digest (count 1 or -1 and a matching check) gives it away, it is taken out of
its other cells, and so on until all cells are empty. If they do not become empty, the same texts are
sketched again larger: the digests are split by their bits into twice as many blocks each time, every
block with a cell, and where that is not enough a sketch, of its own. Work and size grow with the number of paragraphs, not with its square.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from basketlake.llm.common import tasks

BREAK = r"(?<=[.!?])[ \t]+|\n+"
LONG = 120
WORDS_MASK, CHARACTERS_MASK = 7, 31
TABLES, CELLS = 3, 4
ROUNDS = 6
LONE_LOAD = 2.0
BUCKET_ROWS = 2000
MOST_BUCKETS = 1_000_000


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """The body with the value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _chosen(mask: int, *units: Column) -> Column:
    return F.xxhash64(*units).bitwiseAND(F.lit(mask)) == 0


def _after_words(part: Column) -> Column:
    """Cut after words whose hash has no bit of the mask."""
    marked = F.transform(F.split(part, " "), lambda w: F.when(
        _chosen(WORDS_MASK, w), F.concat(w, F.lit("\n"))).otherwise(w))
    return F.split(F.array_join(marked, " "), "\n ?")


def _after_characters(part: Column) -> Column:
    """Cut after characters whose hash with the two before them has no bit of the mask."""
    return let(F.split(part, ""), lambda cs: F.split(F.array_join(F.transform(cs, lambda c, i: F.when(
        _chosen(CHARACTERS_MASK, F.get(cs, i - 2), F.get(cs, i - 1), c),
        F.concat(c, F.lit("\n"))).otherwise(c)), ""), "\n"))


def _evenly(part: Column) -> Column:
    """Cut from its start on; only what repeats with a short period comes here."""
    return F.split(F.regexp_replace(part, f"(?s).{{{LONG}}}", "$0\n"), "\n")


def parts(text: Column) -> Column:
    """Lines and sentences; those over ``LONG`` characters cut at words, then characters, then evenly."""
    def shorter(found: Column, cut: Callable[[Column], Column]) -> Column:
        return F.flatten(F.transform(found, lambda p: F.when(
            F.char_length(p) > LONG, cut(p)).otherwise(F.array(p))))

    found = shorter(shorter(shorter(F.split(text, BREAK), _after_words), _after_characters), _evenly)
    return F.filter(found, lambda p: p != "")


def digests(text: Column) -> Column:
    """Distinct digests of the paragraphs of a text."""
    return F.array_distinct(F.transform(parts(text), lambda p: F.xxhash64(p)))


def _check(key: Column) -> Column:
    """A hash of the digest that is independent of its cells."""
    return F.xxhash64(key, F.lit(1))


def _place(key: Column, table: int) -> Column:
    return F.shiftrightunsigned(key, 2 * table).bitwiseAND(F.lit(CELLS - 1))


def _cell(n: Column, key: Column, check: Column) -> Column:
    return F.struct(n.alias("n"), key.alias("key"), check.alias("check"))


def _signed(keys: Column, sign: int) -> Column:
    return F.transform(keys, lambda k: F.struct(F.lit(sign).alias("n"), k.alias("key"), _check(k).alias("check")))


def _sketch(entries: Column) -> Column:
    """Cells of signed digests, table after table."""
    def one(pairs: Column, table: int) -> Column:
        return F.transform(F.array(*[F.lit(i).cast("bigint") for i in range(CELLS)]), lambda i: F.aggregate(
            F.filter(pairs, lambda p: _place(p["key"], table) == i), _cell(F.lit(0), F.lit(0).cast("bigint"), F.lit(0).cast("bigint")),
            lambda c, p: _cell(c["n"] + p["n"], c["key"].bitwiseXOR(p["key"]), c["check"].bitwiseXOR(p["check"]))))

    return let(entries, lambda pairs: F.concat(*[one(pairs, t) for t in range(TABLES)]))


def cells(keys: Column) -> Column:
    """The sketch of an array of digests."""
    return _sketch(_signed(keys, 1))


def difference(left: Column, right: Column) -> Column:
    """The sketch of one set minus that of another, which is the sketch of both with signs."""
    return _sketch(F.concat(_signed(left, 1), _signed(right, -1)))


def subtract(left: Column, right: Column) -> Column:
    return F.zip_with(left, right, lambda a, b: _cell(
        a["n"] - b["n"], a["key"].bitwiseXOR(b["key"]), a["check"].bitwiseXOR(b["check"])))


def peel(difference: Column) -> Column:
    """(done, left, right): digests recovered that only the one or only the other side has.

    A round takes out every digest that stands alone in a cell; rounds end when there is none. It is
    done when all cells are empty.
    """
    def taken(sketch: Column, table: int, alone: Column) -> Column:
        return F.transform(F.slice(sketch, table * CELLS + 1, CELLS), lambda cell, i: F.aggregate(
            F.filter(alone, lambda p: _place(p["key"], table) == i), cell, lambda c, p: _cell(
                c["n"] - p["n"], c["key"].bitwiseXOR(p["key"]), c["check"].bitwiseXOR(p["check"]))))

    def state(sketch: Column, left: Column, right: Column, stop: Column) -> Column:
        return F.struct(sketch.alias("cells"), left.alias("left"), right.alias("right"), stop.alias("stop"))

    def step(s: Column, _: Column) -> Column:
        alone = F.array_distinct(F.filter(s["cells"], lambda c: (F.abs(c["n"]) == 1) & (_check(c["key"]) == c["check"])))
        return F.when(s["stop"], s).otherwise(let(alone, lambda found: F.when(
            F.size(found) == 0, state(s["cells"], s["left"], s["right"], F.lit(True))).otherwise(state(
                F.concat(*[taken(s["cells"], t, found) for t in range(TABLES)]),
                s["left"] + F.size(F.filter(found, lambda p: p["n"] == 1)),
                s["right"] + F.size(F.filter(found, lambda p: p["n"] == -1)), F.lit(False)))))

    rounds = F.array(*[F.lit(i) for i in range(ROUNDS)])
    return F.aggregate(rounds, state(difference, F.lit(0), F.lit(0), F.lit(False)), step, lambda s: F.struct(
        F.forall(s["cells"], lambda c: (c["n"] == 0) & (c["key"] == 0) & (c["check"] == 0)).alias("done"),
        s["left"].alias("left"), s["right"].alias("right")))


def blocks(keys: Column, level: Column, above: Column) -> Column:
    """The digests in 2 ** level blocks by their bits from ``above`` on, halved level by level."""
    masks = F.slice(F.array(*[F.lit(1 << i).cast("bigint") for i in range(16, 60)]), above + 1, level)
    none = F.lit(0).cast("bigint")

    def halve(groups: Column, mask: Column) -> Column:
        return F.flatten(F.transform(groups, lambda g: F.array(
            F.filter(g, lambda k: k.bitwiseAND(mask) == none), F.filter(g, lambda k: k.bitwiseAND(mask) != none))))

    return F.aggregate(masks, F.array(keys), halve)


def _result(done: Column, left: Column, right: Column) -> Column:
    return F.struct(done.alias("done"), left.alias("left"), right.alias("right"))


def _summed(results: Column) -> Column:
    return F.aggregate(results, _result(F.lit(True), F.lit(0), F.lit(0)), lambda s, x: _result(
        s["done"] & x["done"], s["left"] + x["left"], s["right"] + x["right"]))


def _blockwise(left: Column, right: Column, level: Column, above: Column, retry) -> Column:
    """Recovery with one sketch a block; ``retry(a, b)`` gives the result of a block that fails."""
    def one(a: Column, b: Column) -> Column:
        return F.when((F.size(a) == 0) & (F.size(b) == 0), _result(F.lit(True), F.lit(0), F.lit(0))).otherwise(
            let(peel(difference(a, b)), lambda r: F.when(r["done"], r).otherwise(retry(a, b))))

    return _summed(F.zip_with(blocks(left, level, above), blocks(right, level, above), one))


def _lone(left: Column, right: Column, level: Column, above: Column, retry) -> Column:
    """Recovery with one cell a block, for a digest or none that differs; ``retry(a, b)`` as above.

    A block that has but one digest is its own cell.
    """
    def merged(cell: Column, keys: Column, sign: int) -> Column:
        return F.aggregate(keys, cell, lambda c, k: _cell(
            c["n"] + sign, c["key"].bitwiseXOR(k), c["check"].bitwiseXOR(_check(k))))

    def one(a: Column, b: Column) -> Column:
        empty = _cell(F.lit(0), F.lit(0).cast("bigint"), F.lit(0).cast("bigint"))
        cell = merged(merged(empty, a, 1), b, -1)
        return F.when(F.size(a) + F.size(b) < 2, _result(F.lit(True), F.size(a), F.size(b))).otherwise(let(
            cell, lambda c: F.when((c["n"] == 0) & (c["key"] == 0) & (c["check"] == 0), _result(
                F.lit(True), F.lit(0), F.lit(0))).when(
                (F.abs(c["n"]) == 1) & (_check(c["key"]) == c["check"]), _result(
                    F.lit(True), F.when(c["n"] == 1, 1).otherwise(0), F.when(c["n"] == 1, 0).otherwise(1))).otherwise(retry(a, b))))

    return _summed(F.zip_with(blocks(left, level, above), blocks(right, level, above), one))


def recovered(left: Column, left_cells: Column, right: Column, right_cells: Column) -> Column:
    """Numbers of digests only in one of two texts, from sketches made larger until they peel.

    After the base sketch come blocks of one cell, which most digests have to themselves or share with
    the other text's equal one. A block that keeps more is cut into eight such blocks. What is left gets
    a sketch of the base's size, and a failing one eight. What fails even then (two digests with equal
    cells all through) is compared directly.
    """
    level = F.greatest(F.lit(1), F.ceil(F.log2((F.size(left) + F.size(right)) / F.lit(LONE_LOAD)))).cast("int")

    def direct(a: Column, b: Column) -> Column:
        return _result(F.lit(True), F.size(F.array_except(a, b)), F.size(F.array_except(b, a)))

    def third(a: Column, b: Column) -> Column:
        return let(peel(difference(a, b)), lambda r: F.when(r["done"], r).otherwise(
            _blockwise(a, b, F.lit(3), level + 3, direct)))

    def second(a: Column, b: Column) -> Column:
        return _lone(a, b, F.lit(3), level, third)

    # counts of one table that differ by more than there are cells leave more digests than can peel
    apart = F.aggregate(F.zip_with(F.slice(left_cells, 1, CELLS), F.slice(right_cells, 1, CELLS),
                                   lambda a, b: F.abs(a["n"] - b["n"])), F.lit(0), lambda t, x: t + x)
    base = F.when(apart > TABLES * CELLS, _result(F.lit(False), F.lit(0), F.lit(0))).otherwise(
        peel(subtract(left_cells, right_cells)))
    return let(base, lambda r: F.when(r["done"], r).otherwise(_lone(left, right, level, F.lit(0), second)))


def likeness(left: Column, left_cells: Column, right: Column, right_cells: Column) -> Column:
    """Share of common digests among all of both; texts without paragraphs are alike."""
    def share(r: Column) -> Column:
        union = F.size(left) + r["right"]
        return F.when(union == 0, F.lit(1.0)).otherwise((F.size(left) - r["left"]) / union)

    return let(recovered(left, left_cells, right, right_cells), share).cast("double")


def listed(sketch: Column) -> Column:
    """The sketch as text: count, and hexadecimal xor and check of every cell; empty cells are empty."""
    return F.lower(F.array_join(F.transform(sketch, lambda c: F.when(c["n"] == 0, F.lit("")).otherwise(
        F.concat(c["n"].cast("string"), F.lit("."), F.hex(c["key"]), F.lit("."), F.hex(c["check"])))), ";"))


def in_buckets(rows: DataFrame, bucket_rows: int) -> DataFrame:
    """Adds ``bucket`` and ``tie``, the text's hash; buckets ascend as ids descend and ties ascend.

    Ids are cut at quantiles. An id on which several quantiles fall gets as many buckets, cut by the
    tie, before the smaller ids of its range; only rows equal in id and text then share a bucket.
    """
    spark = rows.sparkSession
    place = F.coalesce(F.col("doc_id"), F.lit(-2 ** 63))
    held = rows.agg(F.count(F.lit(1))).first()[0]
    wanted = int(min(MOST_BUCKETS, max(1, held // bucket_rows, tasks(spark) if held >= bucket_rows else 1)))
    times: Counter = Counter()
    if wanted > 1:
        shares = F.array(*[F.lit(i / wanted) for i in range(1, wanted)])
        times = Counter(rows.agg(F.percentile_approx(place, shares, 20 * wanted)).first()[0] or [])
    cuts = sorted(times)
    tied = rows.withColumn("tie", F.xxhash64("text"))
    if not cuts:
        return tied.withColumn("bucket", F.lit(0).cast("bigint"))
    bounds = F.array(*[F.lit(c).cast("bigint") for c in cuts]).cast("array<bigint>")
    pieces = F.array(*[F.lit(times[c]) for c in cuts])
    halving = F.array(*[F.lit(i) for i in range(max(1, len(cuts).bit_length()))])

    def closer(s: Column, _: Column) -> Column:
        middle = F.floor((s["low"] + s["high"]) / 2).cast("int")
        below = F.get(bounds, middle) < place
        return F.when(s["low"] >= s["high"], s).otherwise(F.struct(
            F.when(below, middle + 1).otherwise(s["low"]).alias("low"),
            F.when(below, s["high"]).otherwise(middle).alias("high")))

    low = F.aggregate(halving, F.struct(F.lit(0).alias("low"), F.lit(len(cuts)).alias("high")), closer,
                      lambda s: s["low"])

    def numbered(low: Column) -> Column:
        n = F.get(pieces, low)
        by_tie = F.least(F.floor((F.col("tie") / F.lit(2.0 ** 64) + 0.5) * n).cast("bigint"), n - 1)
        nulls = F.when(F.col("doc_id").isNull(), n).otherwise(0)  # after an id that is as small as can be
        within = F.when(n > 1, F.when(F.get(bounds, low) == place, by_tie + nulls).otherwise(2 * n)).otherwise(0)
        return F.lit(-2 * (MOST_BUCKETS + 1)).cast("bigint") * low + within

    return tied.withColumn("bucket", let(low, numbered))


def with_next(rows: DataFrame, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Each row (doc_id, text) with its digests and cells beside the next one's, in descending id order.

    The first row follows the last. Rows go to buckets of consecutive ids and text hashes, in one
    shuffle; only each bucket's first row travels further, to the bucket before. Null ids come last,
    and rows of one id are ordered by their texts' hashes.
    """
    dealt = in_buckets(rows, bucket_rows)
    order = Window.partitionBy("bucket").orderBy(F.col("doc_id").desc_nulls_last(), "tie")
    chained = dealt.withColumn("keys", digests(F.col("text"))).withColumn("cells", cells(F.col("keys"))).withColumns(
        {f"after_{c}": F.lead(c).over(order) for c in ("text", "keys", "cells")})
    # the first row of each bucket: ids and ties alone are compared, then its text is looked up
    least = dealt.groupBy("bucket").agg(F.min(F.struct(
        F.col("doc_id").isNull().alias("missing"), F.bitwise_not("doc_id").alias("behind"), "tie")).alias("first"))
    turn = Window.orderBy("bucket")
    whole = turn.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = least.select(  # one small row a bucket
        F.coalesce(F.lag("bucket").over(turn), F.max("bucket").over(whole)).alias("before"),
        F.bitwise_not(F.col("first.behind")).alias("head_id"), F.col("first.tie").alias("head_tie"))
    # a row for each bucket at most, of which there are MOST_BUCKETS at most: the broadcast is bounded
    heads = rows.withColumn("tie", F.xxhash64("text")).join(
        F.broadcast(before), F.col("doc_id").eqNullSafe(F.col("head_id")) & (F.col("tie") == F.col("head_tie"))
    ).dropDuplicates(["before"]).select(F.col("before").alias("bucket"), F.col("text").alias("head_text"))
    joined = chained.join(heads.withColumn("head_keys", digests(F.col("head_text"))).withColumn(
        "head_cells", cells(F.col("head_keys"))), "bucket")
    return joined.select(
        "doc_id", "text", "keys", "cells",
        *[F.coalesce(f"after_{c}", f"head_{c}").alias(f"after_{c}") for c in ("text", "keys", "cells")])


def fingerprint_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprints of every row's whole text and edited text, and how alike they are.

    A null text is empty; an empty text has no paragraphs and is as like to another empty one as can
    be (1). A single row is its own neighbour. Repeated rows stay rows. An empty table gives none.
    """
    rows = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    paired = with_next(rows)
    size = F.char_length("text")
    third = F.floor(size / 3).cast("int")
    edited = F.concat(F.left("text", size - third), F.left("after_text", third))
    out = paired.select("doc_id", size.cast("bigint").alias("n_chars"), "keys", "cells", F.col("after_keys").alias("next_keys"),
                        F.col("after_cells").alias("next_cells"), edited.alias("edited"))
    out = out.withColumn("edited_sha256", F.sha2(F.col("edited").cast("binary"), 256)).withColumn(
        "edited_keys", digests(F.col("edited"))).drop("edited")
    out = out.withColumn("edited_cells", cells(F.col("edited_keys")))
    sides = {n: (F.col(f"{n}keys"), F.col(f"{n}cells")) for n in ("", "edited_", "next_")}
    return out.select(
        "doc_id", "n_chars", "edited_sha256", listed(F.col("cells")).alias("fingerprint"),
        listed(F.col("edited_cells")).alias("edited_fingerprint"),
        likeness(*sides[""], *sides["edited_"]).alias("near_edited"),
        likeness(*sides[""], *sides["next_"]).alias("near_next"))
