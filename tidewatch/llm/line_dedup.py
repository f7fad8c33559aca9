"""Line dedup: fuzzy lines by MinHash, in DataFrame functions alone.

A line's shingles are all runs of ``SHINGLE`` characters of the lower-cased line with runs of white space as one space; a shorter
line is one shingle as a whole, so that it is removed only where it repeats exactly.  The signature is the bottom-``BOTTOM`` sketch:
the smallest hashes of the shingles from each word's start (fewer characters at the end) and of all those inside words of ``LONG``
characters or more.  Every pair of sketch values is a band, so two lines meet if any two values agree; at a Jaccard similarity of
0.8 that is 97 of 100 pairs, at 0.9 more than 99.  In a bucket each line is paired with the smallest one.  The lines of buckets that
still lie in different components afterwards get a second signature from all their shingles, ``FINE_BANDS`` bands of ``FINE_ROWS``
MinHash values, and a bucket for each two bands, which separates groups that the first ones mix; lines with equal sets are one there, and each bucket is
paired with one centre, the least changed line (``stars``).  Lines of buckets that are split even then are compared by an exact prefix-filter
join.  Pairs are confirmed by the
exact Jaccard similarity of their full shingle sets, and confirmed pairs are merged by distributed union-find.  The first line of a
component, by document and line number, stays.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .prefix_join import exact_links
from .scratch import Scratch
from .stars import link_buckets, split_buckets

SHINGLE = 10
BOTTOM = 4
#: Words of so many characters are sketched from every start in them.
LONG = 20
PERCENT = 80
#: The second signature.  Lines meet if two of its bands agree: of pairs at 0.8 that is 99.7 in 100; a given two bands agree at 0.6 in 5 of 100.
FINE_BANDS, FINE_ROWS = 12, 3


def normalised(line: Column) -> Column:
    """Lower-cased, trimmed, with each run of white space as one space; the pattern is run only where there is such a run or another space."""
    low = F.lower(line)
    odd = low.contains("  ")
    for space in "\t\n\x0b\f\r":
        odd = odd | low.contains(space)
    return F.trim(F.when(odd, F.regexp_replace(low, r"\s{2,}|[^\S ]", " ")).otherwise(low))


def sketched_hashes(norm: Column) -> Column:
    """Distinct hashes of the shingles that the sketch draws from, smallest first: from each word's start, and all within long words."""
    # A match takes the rest of a word with it, or one character where a long word goes on.
    grams = F.regexp_extract_all(norm, F.lit("(?s)(?=([^ ].{0,%d}))(?:[^ ]{1,%d}+(?![^ ])|[^ ])" % (SHINGLE - 1, LONG - 1)), 1)
    return F.sort_array(F.array_distinct(F.transform(grams, lambda g: F.xxhash64(g))))


def shingle_hashes(norm: Column) -> Column:
    """Hashes of all of a line's character shingles, from every start; repeated ones repeat."""
    grams = F.regexp_extract_all(norm, F.lit("(?s)(?=(.{%d}))" % SHINGLE), 1)
    return F.transform(grams, lambda g: F.xxhash64(g))


def with_set(lines: DataFrame) -> DataFrame:
    """``lines`` with s, the set of a line's shingle hashes, instead of norm."""
    return lines.withColumn("s", F.array_distinct(shingle_hashes(F.col("norm")))).drop("norm")


def band_keys(sketch: Column) -> Column:
    """A key for each pair of sketch values; a line with one shingle has that alone."""
    pairs = [F.xxhash64(F.get(sketch, F.lit(i)), F.get(sketch, F.lit(j))) for i in range(BOTTOM) for j in range(i + 1, BOTTOM)]
    there = F.size(sketch)
    kept = [F.when(there > j, p) for p, j in zip(pairs, [j for i in range(BOTTOM) for j in range(i + 1, BOTTOM)], strict=True)]
    return F.when(there == 1, F.array(F.get(sketch, F.lit(0)))).otherwise(F.array_compact(F.array(*kept)))


def signatures(lines: DataFrame) -> DataFrame:
    """(k, n, s1, s2, v, w) of (k, norm): what is ever asked of a line's shingle set but its elements, from one look at each of them.

    n is its size, s1 and s2 name it.  v is the second signature: one permutation serves all rows, a hash's remainder picks its bin, whose
    least hash counts; a band is some bins, null where they are empty.  w is a bitmap, a word for each band: an element sets one bit.
    """
    bins = FINE_BANDS * FINE_ROWS
    # Dealt out by line before its set is made, so that no shuffle carries shingles.  An inner explode would have the optimizer ask for the
    # size of each set first, in a filter that makes the set once more.
    sets = with_set(lines.where(F.length("norm") > SHINGLE).repartition("k"))
    single = sets.select("k", F.explode_outer("s").alias("h")).select("k", "h", F.pmod("h", F.lit(bins)).alias("bin"))
    bit = F.expr("shiftleft(1L, cast(shiftrightunsigned(h, 58) as int))")
    x1, x2 = F.xxhash64("h"), F.xxhash64(F.lit(1), "h")
    least = single.groupBy("k", "bin").agg(F.min("h").alias("h"), F.count(F.lit(1)).alias("n"), F.bit_xor(x1).alias("s1"), F.bit_xor(x2).alias("s2"), F.bit_or(bit).alias("w"))
    band = least.groupBy("k", F.pmod("bin", F.lit(FINE_BANDS)).alias("band")).agg(
        F.bit_xor(F.xxhash64("bin", "h")).alias("v"), F.sum("n").alias("n"), F.bit_xor("s1").alias("s1"), F.bit_xor("s2").alias("s2"), F.bit_or("w").alias("w")
    )
    of = lambda c: [F.max(F.when(F.col("band") == i, F.col(c))) for i in range(FINE_BANDS)]
    v, w = F.array(*of("v")), F.array(*[F.coalesce(x, F.lit(0).cast("long")) for x in of("w")])
    return band.groupBy("k").agg(F.sum("n").alias("n"), F.bit_xor("s1").alias("s1"), F.bit_xor("s2").alias("s2"), v.alias("v"), w.alias("w"))


def fine_keys(signed: DataFrame) -> DataFrame:
    """(k, key): a key for each two bands of the rows (k, v) of ``signatures``, empty ones left out."""
    bands = signed.select("k", F.array_compact("v").alias("b"))
    pairs = [F.xxhash64(F.get("b", F.lit(i)), F.get("b", F.lit(j))) for i in range(FINE_BANDS) for j in range(i + 1, FINE_BANDS)]
    there = [j for i in range(FINE_BANDS) for j in range(i + 1, FINE_BANDS)]
    kept = F.array_compact(F.array(*[F.when(F.size("b") > j, p) for p, j in zip(pairs, there, strict=True)]))
    return bands.select("k", F.explode_outer(F.when(F.size("b") == 1, F.array(F.xxhash64(F.get("b", F.lit(0))))).otherwise(kept)).alias("key"))


def numbered_lines(documents: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc, no, norm, k, k2): every line that is not blank; k names the normalised line and k2, by another seed, tells lines apart that share a k."""
    lines = documents.select(F.col(id_col).cast("long").alias("doc"), F.posexplode_outer(F.split(text_col, "\n")).alias("no", "line")).where("doc is not null")
    # Asked of the line, as a filter on its normal form would have that made twice.
    lines = lines.where(F.btrim("line", F.lit(" \t\n\x0b\f\r")) != "").select("doc", "no", normalised(F.col("line")).alias("norm"))
    return lines.withColumn("k", F.xxhash64("norm")).withColumn("k2", F.xxhash64(F.lit(1), "norm"))


def possible(pairs: DataFrame, signed: DataFrame) -> DataFrame:
    """The pairs (k, c) that may be alike enough by their sets' sizes and bitmaps; no pair that is alike is left out.

    Two bitmaps differ in no more bits than the sets have elements apart, which bounds what the sets share.
    """
    own = signed.select("k", "n", "w")
    both = pairs.join(own, "k").join(own.toDF("c", "nc", "wc"), "c")
    apart = sum((F.bit_count(F.get("w", F.lit(i)).bitwiseXOR(F.get("wc", F.lit(i)))) for i in range(FINE_BANDS)), F.lit(0))
    total = F.col("n") + F.col("nc")
    return both.where((100 * F.least("n", "nc") >= PERCENT * F.greatest("n", "nc")) & ((100 + PERCENT) * (total - apart) >= 2 * PERCENT * total)).select("k", "c")


def alike(pairs: DataFrame, norms: DataFrame, signed: DataFrame) -> DataFrame:
    """The pairs (k, c) whose shingle sets are alike enough."""
    both = possible(pairs, signed).join(norms.withColumnRenamed("norm", "nk"), "k").join(norms.select(F.col("k").alias("c"), F.col("norm").alias("nc")), "c")
    # Bound to a name by the lambda, each set is made once.
    sets = F.array(F.struct(shingle_hashes(F.col("nk")).alias("k"), shingle_hashes(F.col("nc")).alias("c")))
    enough = F.transform(sets, lambda s: 100 * F.size(F.array_intersect(s["k"], s["c"])) >= PERCENT * F.size(F.array_union(s["k"], s["c"])))
    return both.where(F.get(enough, F.lit(0))).select("k", "c")


def marked(numbers: Column) -> Column:
    """A byte for each line up to the last of the sorted ``numbers``: 1 where it is one of them.  ``at`` reads it in constant time."""
    gaps = F.transform(numbers, lambda x, i: x - F.when(i == 0, F.lit(-1)).otherwise(F.get(numbers, i - 1)) - 1)
    return F.array_join(F.transform(gaps, lambda g: F.concat(F.repeat(F.lit("0"), g), F.lit("1"))), "").cast("binary")


def at(mark: Column, no: Column) -> Column:
    return F.substring(mark, no + 1, F.lit(1)) == F.lit(b"1")


def linked_lines(bucket: DataFrame, norms: DataFrame, scratch: Scratch) -> DataFrame:
    """(k, c): confirmed links between the lines of ``bucket`` (key, k, c), whose first centres are c."""
    signed = scratch.save(signatures(norms))
    confirm = lambda pairs: alike(pairs, norms, signed)
    linked = scratch.save(confirm(bucket.select("k", "c").distinct()))
    coarse = bucket.select("key", "k").unionByName(bucket.select("key", F.col("c").alias("k")).distinct())
    scratch.sweep()
    rest, linked = split_buckets(coarse, linked, scratch)
    # Lines with the same set are one class, for which its smallest line goes on.
    named = scratch.save(rest.select("k").distinct().join(signed.select("k", "s1", "s2"), "k"))
    classes = scratch.save(named.groupBy("s1", "s2").agg(F.min("k").alias("c")))
    linked = scratch.save(linked.unionByName(named.join(classes, ["s1", "s2"]).where("k != c").select("k", "c")))
    fine = scratch.save(fine_keys(signed.select("k", "v").join(classes.select(F.col("c").alias("k")), "k", "left_semi")))
    scratch.sweep(classes, named)
    linked, left = link_buckets(fine, linked, confirm, scratch, rounds=1)
    scratch.sweep(fine)
    # What shares a bucket with lines of other components even then is joined exactly: no pair in a bucket is given up.
    rest, linked = split_buckets(left, linked, scratch)
    rest = rest.select(F.col("k").alias("id"), "label").distinct()
    # A set takes several times the room of its line: it is made where it is wanted and not kept.
    rest = scratch.save(rest.join(norms.withColumnRenamed("k", "id"), "id"))
    scratch.sweep()
    out = scratch.save(linked.unionByName(exact_links(with_set(rest), PERCENT, confirm, scratch)))
    scratch.sweep(rest, signed)
    return out


def duplicate_lines(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc, gone): for each document with lines to remove, their numbers from 0."""
    scratch = Scratch(documents.sparkSession, "lines")
    lines = numbered_lines(documents, id_col, text_col)
    sketch = F.when(F.length("norm") > SHINGLE, F.slice(sketched_hashes(F.col("norm")), 1, BOTTOM))
    sketched = scratch.save(lines.select("k", "k2", "doc", "no", sketch.alias("sketch")))
    first = sketched.groupBy("k", "k2").agg(F.min(F.struct("doc", "no")).alias("first"), F.count(F.lit(1)).alias("n"))

    # Copies of a line share its keys; the smallest and largest k of a bucket differ only where different lines meet.
    member = sketched.where("sketch is not null").select("k", F.explode(band_keys(F.col("sketch"))).alias("key"))
    centre = scratch.save(member.groupBy("key").agg(F.min("k").alias("c"), F.max("k").alias("hi")).where("c < hi").select("key", "c"))
    bucket = scratch.save(member.join(centre, "key").where("k != c").select("key", "k", "c").distinct())
    scratch.sweep(centre)

    # The lines in buckets, one copy of each; of lines that share a k the one with the smallest k2 stands for it.
    need = bucket.select("k").union(bucket.select("c")).distinct().join(first.groupBy("k").agg(F.min(F.struct("k2", "first")).alias("x")), "k")
    need = scratch.save(need.select("k", "x.k2", "x.first"))
    scratch.sweep()
    nos = need.groupBy(F.col("first.doc").alias("doc")).agg(F.sort_array(F.collect_set("first.no")).alias("nos")).select("doc", marked(F.col("nos")).alias("mark"))
    texts = documents.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text")).join(nos, "doc")
    wanted = texts.select("mark", F.posexplode_outer(F.split("text", "\n")).alias("no", "line")).where(at(F.col("mark"), F.col("no")))
    norms = wanted.select(normalised(F.col("line")).alias("norm")).select(F.xxhash64("norm").alias("k"), F.xxhash64(F.lit(1), "norm").alias("k2"), "norm")
    norms = scratch.save(norms.join(need.select("k", "k2"), ["k", "k2"], "left_semi").dropDuplicates(["k"]).select("k", "norm"))
    scratch.sweep()

    linked = linked_lines(bucket, norms, scratch)
    scratch.sweep(bucket, norms)
    component = connected_components(linked, scratch, "k", "c").select(F.col("node").alias("k"), "component")
    company = component.join(need.select("k", "k2"), "k")
    # Lines with company: the component's first occurrence stays.
    known = first.join(company, ["k", "k2"], "left").where("n > 1 or component is not null")
    known = scratch.save(known.select("k", "k2", "first", "component"))
    several = known.where("component is not null")
    keeper = scratch.save(several.groupBy("component").agg(F.min("first").alias("keep")))
    doomed = several.join(keeper, "component").select("k", "k2", "keep").unionByName(known.where("component is null").select("k", "k2", F.col("first").alias("keep")))
    gone = sketched.select("k", "k2", "doc", "no").join(scratch.save(doomed), ["k", "k2"]).where("doc != keep.doc or no != keep.no")
    return gone.groupBy("doc").agg(F.sort_array(F.collect_set("no")).alias("gone"))


def dedup_lines(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``documents`` with ``text_col`` cut to the lines that stay, plus n_lines and n_removed (long).

    A null text stays null with no lines; an empty text has one empty line.  Blank lines stay, and rows with a null id keep all
    their lines.  Rows that share an id are one document at each line number: of repeated rows all keep the same
    lines.  Other columns pass through unread; one that is named like an output gives way to it.
    """
    gone = duplicate_lines(documents, id_col, text_col).select(F.col("doc").alias("__doc"), "gone").select("__doc", F.size("gone").alias("__n"), marked(F.col("gone")).alias("__gone"))
    out = documents.join(gone, F.col(id_col).cast("long") == F.col("__doc"), "left")
    lines = F.split(text_col, "\n")
    left = F.filter(lines, lambda _, i: ~at(F.col("__gone"), i))
    cut = F.when(F.col("__gone").isNull(), F.col(text_col)).otherwise(F.array_join(left, "\n"))
    columns = [cut.alias(c) if c == text_col else F.col(c) for c in documents.columns if c not in ("n_lines", "n_removed")]
    return out.select(*columns, F.coalesce(F.size(lines), F.lit(0)).cast("long").alias("n_lines"), F.coalesce("__n", F.lit(0)).cast("long").alias("n_removed"))


def digest(documents: DataFrame) -> DataFrame:
    """The registered query: each document's counts and the text that is left."""
    out = dedup_lines(documents.select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_removed", F.length("text").cast("long").alias("n_chars"), "text")
