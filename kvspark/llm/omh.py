"""Document fingerprints by Order MinHash (Marçais et al., 2019), in DataFrame expressions only.

The k-mers of a text are runs of ``K`` words, numbered by occurrence, so that a repeat is an element of its own. Each
numbered k-mer gets a 64-bit hash, whose top bits choose one of ``BINS`` sketches and whose rest orders it there (one
permutation for all sketches). A sketch keeps its ``KEEP`` smallest elements, puts them in text order, and hashes the
tuple of k-mers: a moved passage changes it even where the set of k-mers stays. Likeness is the share of sketches,
of those filled in either text, that agree.

Elements are hashes of 64 - POSITION_BITS bits with the position of their k-mer beside them, in one long, at every
length; k-mers of a text that are equal in those bits (about one pair in 2**33) count as occurrences of one.

Scale: everything is per row, on sorted arrays of longs, without exploding texts. A text is sketched once where it is
scanned; sketches travel to neighbours, and the texts move once: the tables of neighbours are joined by id, and both joins
read the same exchange. Ids are ranked by range, so no task sees all ids.

Edge cases: a null text is empty; a text without a word has an empty fingerprint, alike (1.0) to another empty one
and unlike (0.0) any other; fewer words than K make one k-mer of them all; rows with equal doc_ids are fingerprinted
each, and count as one document for their neighbours (the smallest text stands for it); rows without doc_id have no
neighbour: they are fingerprinted, their edited text lacks its second half, and ``near_next`` is null; of a single
document the next is itself; an empty table gives no rows. Every row of the input has a row in the report.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import held_back, shuffle_width, stage, unstage
from .lines import beside, words_of

K = 2
BIN_BITS = 6
KEEP = 2
POSITION_BITS = 31
#: Bits of a sketch's tuple hash that a fingerprint shows.
SHOWN_BITS = 24


def sketches(df: DataFrame, text: str, out: str) -> DataFrame:
    """Append ``out``: an array of integers, sketch number and tuple hash of each filled sketch, in order."""
    held = df.columns
    keep = lambda *cols: [*held, *cols]
    df = df.withColumn("_h", F.transform(words_of(F.coalesce(F.col(text), F.lit(""))), lambda w: F.xxhash64(w)))
    h = F.col("_h")
    n = F.greatest(F.size(h) - 1, F.lit(0))
    pairs = F.zip_with(F.slice(h, F.lit(1), n), F.slice(h, F.lit(2), n), lambda a, b: F.xxhash64(a, b))
    df = df.select(*keep(F.when(F.size(h) >= K, pairs).otherwise(h).alias("_k")))
    k, mask = F.col("_k"), F.lit((1 << POSITION_BITS) - 1).cast("long")
    df = df.withColumn("_s", beside(k, mask))
    s = F.col("_s")
    top = lambda x: x.bitwiseAND(F.bitwise_not(mask))
    # a k-mer's hash and its occurrence number give its element; the element's hash keeps the position beside it
    numbered = lambda x, o: F.xxhash64(top(x), o).bitwiseAND(F.bitwise_not(mask)).bitwiseOR(x.bitwiseAND(mask))
    again = lambda i: (i > 0) & (top(F.get(s, i)) == top(F.get(s, i - 1)))
    df = df.withColumn("_r", F.when(F.size(s) > 0, F.filter(F.sequence(F.lit(0), F.size(s) - 1), again)).otherwise(F.array().cast("array<int>")))
    r = F.col("_r")  # places of second and later occurrences: those of one k-mer are consecutive, those of two are not
    opens_run = lambda j: (j == 0) | (F.get(r, j - 1) != F.get(r, j) - 1)
    df = df.withColumn("_first", F.when(F.size(r) > 0, F.filter(F.sequence(F.lit(0), F.size(r) - 1), opens_run)).otherwise(F.array().cast("array<int>")))
    first = F.col("_first")
    later = F.transform(first, lambda a, j: F.transform(F.slice(r, a + 1, F.coalesce(F.get(first, j + 1), F.size(r)) - a), lambda i, o: numbered(F.coalesce(F.get(s, i), F.lit(0).cast("long")), o + 1)))
    once = F.transform(F.filter(s, lambda x, i: ~again(i)), lambda x: numbered(x, F.lit(0)))
    df = df.select(*keep("_k", F.sort_array(F.concat(once, F.flatten(later))).alias("_g")))
    g = F.col("_g")
    bin_of = lambda x: F.shiftrightunsigned(x, 64 - BIN_BITS)
    df = df.withColumn("_c", F.filter(g, lambda x, i: (i < KEEP) | (bin_of(F.get(g, i - KEEP)) != bin_of(x))))
    c = F.col("_c")
    opens = lambda i: (i == 0) | (bin_of(F.get(c, i - 1)) != bin_of(F.get(c, i)))
    df = df.withColumn("_o", F.when(F.size(c) > 0, F.filter(F.sequence(F.lit(0), F.size(c) - 1), opens)).otherwise(F.array().cast("array<int>")))
    at = lambda x: x.bitwiseAND(mask).cast("int")

    def component(i: Column) -> Column:
        a, b = F.get(c, i), F.get(c, i + 1)
        alone = b.isNull() | (bin_of(a) != bin_of(b))
        pa, pb = at(a), at(b)
        told = F.when(alone, F.xxhash64(F.get(k, pa))).otherwise(F.xxhash64(F.get(k, F.least(pa, pb)), F.get(k, F.greatest(pa, pb))))
        return F.shiftleft(bin_of(a), SHOWN_BITS).bitwiseOR(F.shiftrightunsigned(told, 64 - SHOWN_BITS)).cast("int")

    return df.select(*keep(held_back(F.transform("_o", component)).alias(out)))


def shown(sketch: Column) -> Column:
    """A fingerprint as text: eight hex digits a filled sketch."""
    return F.array_join(F.transform(sketch, lambda x: F.lpad(F.lower(F.hex(x)), 8, "0")), "")


def likeness(a: Column, b: Column) -> Column:
    """0 to 1; ``a`` and ``b`` are sketch arrays."""
    bins = lambda x: F.transform(x, lambda v: F.shiftright(v, SHOWN_BITS))
    either = F.size(F.array_union(bins(a), bins(b)))
    return F.when(either == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / either)


def next_ids(ids: DataFrame) -> DataFrame:
    """(doc_id, next_id) of distinct ids: the next in descending order; after the last, the first."""
    spark = ids.sparkSession
    parts = stage(ids.where("doc_id is not null").distinct().repartitionByRange(shuffle_width(spark), "doc_id").sortWithinPartitions("doc_id").select("doc_id", F.monotonically_increasing_id().alias("at")), "ids")
    parts = parts.select("doc_id", F.shiftright("at", 33).alias("part"), F.col("at").bitwiseAND((1 << 33) - 1).alias("row"))
    sizes = parts.groupBy("part").agg(F.count(F.lit(1)).alias("n"))  # one row a partition
    whole = Window.orderBy("part")
    bases = sizes.select("part", F.coalesce(F.sum("n").over(whole.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"), F.sum("n").over(whole.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("total"))
    ranked = parts.join(F.broadcast(bases), "part").select("doc_id", (F.col("base") + F.col("row")).alias("rank"), "total")
    after = ranked.select("doc_id", F.pmod(F.col("rank") - 1, F.col("total")).alias("rank"))
    return after.join(ranked.select(F.col("doc_id").alias("next_id"), "rank"), "rank").select("doc_id", "next_id")


def neighbour_report(docs: DataFrame) -> DataFrame:
    """Per row: its fingerprint, its edited text's, and how alike it is to that and to the next document."""
    one = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    named = one.where("doc_id is not null")
    chars = F.length("text").cast("long").alias("n_chars")
    repeated = named.groupBy("doc_id").count().where("count > 1").limit(1).count() > 0
    lenders = named.groupBy("doc_id").agg(F.min("text").alias("text")) if repeated else named  # the smallest text stands for an id
    prints = stage(sketches(lenders.select("doc_id", chars, "text"), "text", "sketch").drop("text"), "prints")
    longest = named.groupBy("doc_id").agg(F.max(F.length("text").cast("long")).alias("n_chars")) if repeated else prints.select("doc_id", "n_chars")
    # how many code points each document borrows at most of the next
    loans = longest.join(next_ids(prints.select("doc_id")), "doc_id").select("doc_id", "next_id", F.floor(F.col("n_chars") / 2).cast("int").alias("most"))
    loans = stage(loans, "loans")
    # both sides read one exchange of the texts and one of the sketches, made of tables without lambdas, so that it is reused
    lender, owner, known = lenders.alias("lender"), named.alias("owner"), prints.select("doc_id", "sketch")
    lent = loans.join(lender, F.col("next_id") == F.col("lender.doc_id")).join(known.alias("known"), F.col("next_id") == F.col("known.doc_id"))
    lent = lent.select(loans.doc_id, F.col("known.sketch").alias("next_sketch"), F.substr("lender.text", F.lit(1), F.col("most")).alias("loan"))
    both = lent.alias("lent").join(owner, F.col("lent.doc_id") == F.col("owner.doc_id"))
    if repeated:
        both = sketches(both.select(F.col("owner.doc_id").alias("doc_id"), "next_sketch", "loan", F.col("owner.text").alias("text")), "text", "sketch")
    else:
        both = both.join(known.alias("own"), F.col("lent.doc_id") == F.col("own.doc_id"))
        both = both.select(F.col("owner.doc_id").alias("doc_id"), "next_sketch", "loan", F.col("owner.text").alias("text"), F.col("own.sketch").alias("sketch"))
    nameless = one.where("doc_id is null").select("doc_id", F.lit(None).cast("array<int>").alias("next_sketch"), F.lit("").alias("loan"), "text")
    out = both.unionByName(sketches(nameless, "text", "sketch"))
    half = F.floor(F.col("n_chars") / 2).cast("int")
    edited = F.concat(F.substr("text", F.lit(1), (F.col("n_chars") - half).cast("int")), F.substr("loan", F.lit(1), half))
    out = out.withColumn("n_chars", chars).withColumn("edited", edited).drop("text", "loan")
    out = sketches(out.withColumn("edited_sha256", F.sha2("edited", 256)), "edited", "edited_sketch")
    return out.select(
        "doc_id", "n_chars", "edited_sha256", shown(F.col("sketch")).alias("fingerprint"), shown(F.col("edited_sketch")).alias("edited_fingerprint"),
        likeness(F.col("sketch"), F.col("edited_sketch")).alias("near_edited"), likeness(F.col("sketch"), F.col("next_sketch")).alias("near_next"),
    )
