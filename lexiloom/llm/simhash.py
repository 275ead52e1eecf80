"""SimHash near-duplicates by ball hashing that meets in the middle, in DataFrame functions only.

Two fingerprints of 64 bits that differ in at most `radius` bits agree, in at least one of `blocks`
disjoint blocks, to within r = radius // blocks bits. In each block, every distinct fingerprint emits
all variants of that block within half of r (rounded up) flipped bits; two fingerprints within r
bits then share a variant. The variants are shuffled, pairs that collide are verified on all 64 bits and
deduplicated. One block is the textbook form; it emits 43,745 variants a fingerprint for a radius of 6, two emit 1,058 and
three 67. All find the same pairs, because the verification is exact, but narrow blocks also bring unlike fingerprints together, in proportion to the square
of their number; `blocks_for` takes the cheapest for the number of distinct fingerprints.

Exact copies are one class before anything is emitted, so a group of copies costs one fingerprint.

Nulls: a null text counts as empty. Texts without words have fingerprint zero and link like any other.
A row with a null id is in its own class as any other; repeated ids count as rows of their own. keep_one
keeps exactly one row of each component: that of the least id, nulls last, and of the least key of id and text.
"""

from __future__ import annotations

from itertools import combinations
from math import comb

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, lower_ascii

LANES = 0x0000000100000001


def shingles(text: Column) -> Column:
    """Array of pairs (a, b) of neighbouring words; one word alone gives (a, null), none an empty array."""
    plain = F.translate(lower_ascii(F.coalesce(text, F.lit(""))), "\t\n\x0b\x0c\r", "     ")
    words = F.array_remove(F.split(plain, " "), "")
    n = F.greatest(F.size(words) - 1, F.lit(1))
    return F.arrays_zip(F.slice(words, F.lit(1), n).alias("a"), F.slice(words, F.lit(2), n).alias("b"))


def row_key(doc_id: Column, text: Column) -> Column:
    """A hash that rows share only if they have the same id and text; it is the same wherever it is computed."""
    own = F.coalesce(doc_id.cast("string"), F.lit(""))
    kinds = F.concat_ws(",", F.length(own), doc_id.isNull().cast("string"), text.isNull().cast("string"))
    return F.unhex(F.sha2(F.concat(kinds, F.lit(":"), own, F.coalesce(text, F.lit(""))), 256))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, fp bigint), and the columns to carry, one row for each row of docs.

    32 sums hold 64 counters of 32 bits each: sum i counts bit i in its low and bit i + 32 in its
    high half. The sums are made on the map side, so 33 numbers a document are shuffled, no shingles.
    """
    rows = docs.select(F.monotonically_increasing_id().alias("_row"), F.col(id_col).alias("doc_id"), *carry, shingles(F.col(text_col)).alias("_s"))
    rows = rows.select("_row", "doc_id", *carry, F.inline_outer("_s").alias("a", "b"))
    rows = rows.select("_row", "doc_id", *carry, F.col("a").isNotNull().cast("int").alias("_one"), F.xxhash64(F.concat_ws(" ", "a", "b")).alias("_h"))
    sums = [F.sum(F.shiftrightunsigned("_h", i).bitwiseAND(F.lit(LANES))).alias(f"_{i}") for i in range(32)]
    counted = rows.groupBy("_row", "doc_id", *carry).agg(F.sum("_one").alias("_n"), *sums)
    fp = F.lit(0).cast("bigint")
    for i in range(32):
        low, high = F.col(f"_{i}").bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned(f"_{i}", 32)
        fp = fp.bitwiseOR(F.when(low * 2 > F.col("_n"), F.lit(1 << i)).otherwise(F.lit(0)).cast("bigint"))
        bit = (1 << (i + 32)) - (1 << 64 if i == 31 else 0)
        fp = fp.bitwiseOR(F.when(high * 2 > F.col("_n"), F.lit(bit)).otherwise(F.lit(0)).cast("bigint"))
    return counted.select("doc_id", *carry, F.when(F.col("_n") > 0, fp).otherwise(F.lit(0).cast("bigint")).alias("fp"))


def ball(radius: int, blocks: int) -> list[tuple[int, int, int, list[int]]]:
    """(tag, shift, mask, flips) of each block: the flips of every variant that a fingerprint emits for it."""
    edges = [round(64 * i / blocks) for i in range(blocks + 1)]
    half = -(-(radius // blocks) // 2)
    out = []
    for tag, (lo, hi) in enumerate(zip(edges, edges[1:])):
        flips = [sum(1 << b for b in bits) for k in range(half + 1) for bits in combinations(range(hi - lo), k)]
        out.append((tag, lo, (1 << (hi - lo)) - 1, flips))
    return out


def cost(n: int, radius: int, blocks: int) -> tuple[float, float]:
    """Variants that n distinct fingerprints emit, and pairs of unlike ones that are expected to meet in them."""
    width, half = 64 / blocks, -(-(radius // blocks) // 2)
    each = sum(comb(round(width), k) for k in range(half + 1))
    return n * blocks * each, n * (n - 1) / 2 * blocks * each * each / 2.0**width


def blocks_for(n: int, radius: int = 6) -> int:
    """The number of blocks, one to three, whose variants and expected candidates are fewest together: three up to some 4 million
    fingerprints, two up to some 600 million, then one."""
    return min((3, 2, 1), key=lambda b: sum(cost(n, radius, b)))


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def linked_pairs(fps: DataFrame, radius: int = 6, blocks: int = 3) -> DataFrame:
    """(a, b) with a < b of distinct fingerprints within radius bits. fps: distinct values in column fp."""
    if not 1 <= blocks <= 8:
        raise ValueError("one to eight blocks, so that the tag fits above the block's bits")
    parts = [
        F.struct(
            F.lit(shift).alias("s"), F.lit(signed(mask)).cast("bigint").alias("m"), F.lit(tag << 56).cast("bigint").alias("t"),
            F.split(F.lit(",".join(str(signed(f)) for f in flips)), ",").cast("array<bigint>").alias("fs"),
        )
        for tag, shift, mask, flips in ball(radius, blocks)
    ]
    emitted = fps.select("fp", F.inline(F.array(*parts))).select("fp", "s", "m", "t", F.explode("fs").alias("f"))
    key = F.expr("shiftrightunsigned(fp, s)").bitwiseAND(F.col("m")).bitwiseXOR(F.col("f")).bitwiseOR(F.col("t"))
    emitted = emitted.select("fp", key.alias("key"))
    # Spark can't foresee how far the variants multiply the rows; without the hint it might broadcast them.
    a, b = emitted.select("key", F.col("fp").alias("a")), emitted.select("key", F.col("fp").alias("b"))
    near = (F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius)
    return a.hint("merge").join(b, "key").where(near).select("a", "b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the least node reachable over edges (a, b). Labels fall to the least neighbour's label,
    then jump to their label's label, so the rounds grow with the logarithm of the longest path."""
    both = cut(edges.select("a", "b").union(edges.select("b", "a")))
    labels = cut(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("root")))
    while True:  # labels only fall, so this ends
        least = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("root").alias("m"))
        hop = labels.join(least, "node").select("node", F.least("root", "m").alias("next"), F.col("root").alias("was"))
        jump = labels.select(F.col("node").alias("next"), F.col("root").alias("far"))
        new = cut(hop.join(jump, "next", "left").select("node", F.least("next", "far").alias("root"), "was"))
        labels, changed = new.select("node", "root"), new.where("root != was").limit(1).count()
        if not changed:
            return labels


def linked(fps: DataFrame, radius: int, blocks: int | None) -> DataFrame:
    """fp, n (rows), first (least id), others (rows linked directly), root (least fingerprint reachable) of the distinct fingerprints of fps."""
    classes = cut(fps.groupBy("fp").agg(F.count("*").alias("n"), F.min("doc_id").alias("first")))
    pairs = cut(linked_pairs(classes.select("fp"), radius, blocks or blocks_for(classes.count(), radius)))
    directed = pairs.union(pairs.select("b", "a"))
    near = directed.join(classes.select(F.col("fp").alias("b"), "n"), "b").groupBy(F.col("a").alias("fp")).agg(F.sum("n").alias("others"))
    roots = components(pairs).withColumnRenamed("node", "fp")
    return classes.join(near, "fp", "left").join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = 6, blocks: int | None = None) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), n_near (other rows linked directly), component_id (least id reachable)."""
    fps = cut(fingerprints(docs, id_col, text_col))
    member = linked(fps, radius, blocks)
    least = member.groupBy("root").agg(F.min("first").alias("component_id"))
    known = member.join(least, "root").select("fp", (F.col("n") - 1 + F.coalesce("others", F.lit(0))).alias("n_near"), "component_id")
    return fps.join(known, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "n_near", "component_id")


def keep_one(docs: DataFrame, radius: int = 6, blocks: int | None = None) -> DataFrame:
    """Exactly one row of docs for each component: the least by id (nulls last), then by the key of id and text."""
    keyed = docs.withColumn("_key", row_key(F.col("doc_id"), F.col("text")))
    fps = cut(fingerprints(keyed, carry=("_key",)))
    root = linked(fps, radius, blocks).select("fp", "root")
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "_key")
    kept = fps.join(root, "fp").groupBy("root").agg(F.min_by("_key", order).alias("_key")).select("_key")
    # Rows of one key have one fingerprint, so each key stands for one component; what else they hold decides between them.
    plain = [c for c, kind in docs.dtypes if "map<" not in kind and "variant" not in kind]
    once = F.row_number().over(Window.partitionBy("_key").orderBy(F.xxhash64(*plain)))
    return keyed.join(kept, "_key", "left_semi").withColumn("_once", once).where("_once = 1").select(docs.columns)
