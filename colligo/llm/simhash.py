"""SimHash fingerprints of whole texts, in DataFrame functions only.

Terms are pairs of neighbouring lower-cased words. A term's weight is the number
of its letters, so pairs of short function words count little; it votes with
its weight, once for each time it occurs, for or against each of 64 bits by the
bits of its hash. Two votes share a 64-bit sum (32 bits each), so a group needs
32 sums; a text can hold 2^31 bytes at most, whose votes still fit.

Near fingerprints are found with permuted block tables: the 64 bits are cut into
BLOCKS blocks, and for every choice of BLOCKS - radius blocks there is a table
keyed on just those blocks; fingerprints within the radius agree on at least
one such choice. Equal fingerprints are one entry; see buckets for how large
buckets are handled without listing their pairs.

Defined results: null and empty texts and texts of white space only have no
term and the fingerprint 0; equal texts have equal fingerprints; rows are
ordered by id, nulls first, and rows that repeat an id by a hash of their text,
so that absent or repeated ids are spread as others are; very long texts vote
whole; an empty table gives an empty table; extra columns are ignored.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from colligo.llm.buckets import bucket_components
from colligo.llm.common import staged, text_or_empty

LANES = 0x0000000100000001
BLOCKS = 6
#: Bytes of texts in a bucket of the id order, about.
BUCKET_BYTES = 8 << 20
_NO_ID = -(2**63)


def terms(text: Column) -> Column:
    """Pairs (word, next word or null) of a text."""
    words = F.filter(F.split(F.lower(text), "[ \\t\\n\\x0B\\f\\r]+"), lambda w: w != "")
    return F.arrays_zip(words.alias("a"), F.slice(words, 2, F.greatest(F.size(words), F.lit(1))).alias("b"))


def vote_sums(term: str = "term") -> list[Column]:
    """total and 32 sums over the rows of a group, each of two bits' weighted votes."""
    a, b = F.col(f"{term}.a"), F.col(f"{term}.b")
    weight = F.coalesce(F.length(a), F.lit(0)) + F.coalesce(F.length(b), F.lit(0))
    h = F.xxhash64(a, b)
    return [F.sum(weight.cast("long")).alias("total")] + [F.sum(F.shiftrightunsigned(h, i).bitwiseAND(F.lit(LANES)) * weight).alias(f"v{i}") for i in range(32)]


def signed_bits() -> Column:
    """The fingerprint of a group from its vote_sums: a bit is set if more than half of the weight votes for it."""
    low = [F.when(2 * F.col(f"v{i}").bitwiseAND(F.lit(0xFFFFFFFF)) > F.col("total"), F.lit(1 << i)).otherwise(F.lit(0)) for i in range(32)]
    high = [F.when(2 * F.shiftrightunsigned(f"v{i}", 32) > F.col("total"), F.shiftleft(F.lit(1).cast("long"), 32 + i)).otherwise(F.lit(0).cast("long")) for i in range(32)]
    return reduce(lambda x, y: x.bitwiseOR(y), high, reduce(lambda x, y: x + y, [c.cast("long") for c in low]))


def in_id_order(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """bucket, rid, next_rid, id, text and the next row's text, by ascending id, the last row's next being the first.

    Rows are dealt to buckets by ranges of id, hash of the text and place in the
    input, as many as the texts' bytes ask for, so that no frequent id (nor absent
    ones) makes a large bucket; they are stored with their place in it. The first row
    of each bucket is also dealt to the bucket before it, so that no window spans
    more than a bucket. Nothing but a number of bytes reaches the driver.
    """
    spark = docs.sparkSession
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(_NO_ID)).alias("key"), text_or_empty(text_col).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // bucket_bytes))
    order = [F.col("key"), F.xxhash64("text"), F.col("place")]
    dealt = rows.withColumn("place", F.monotonically_increasing_id()).repartitionByRange(parts, *order).sortWithinPartitions(*order)
    # An increasing id has the number of the range in its upper bits and the place there in its lower 33.
    numbered = dealt.select("key", "text", F.monotonically_increasing_id().alias("at"))
    stored = staged(numbered.select((F.col("at").bitwiseAND(F.lit((1 << 33) - 1)) + 1).alias("n"), F.shiftright("at", 33).alias("bucket"), "key", "text"), "order")
    stored = stored.withColumn("rid", F.shiftleft("bucket", 34) + F.col("n"))
    # One number a bucket goes through this window; empty ranges have none.
    firsts = stored.where("n = 1")
    before = Window.orderBy("bucket")
    ahead = firsts.select("bucket", F.lag("bucket").over(before).alias("_before"), F.max("bucket").over(before.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("_last"))
    ahead = ahead.select("bucket", F.coalesce("_before", "_last").alias("_to"))
    ghosts = firsts.join(ahead, "bucket").select(F.col("_to").alias("bucket"), F.lit(1).alias("ghost"), "n", "rid", "key", "text")
    both = stored.select("bucket", F.lit(0).alias("ghost"), "n", "rid", "key", "text").unionByName(ghosts).repartition(parts, "bucket")
    w = Window.partitionBy("bucket").orderBy("ghost", "n")
    seen = both.select("*", F.lead("text").over(w).alias("next_text"), F.lead("rid").over(w).alias("next_rid")).where("ghost = 0")
    return seen.select("bucket", "rid", "next_rid", F.when(F.col("key") != _NO_ID, F.col("key")).alias("id"), "text", "next_text")


def likeness(a: Column, b: Column) -> Column:
    return F.lit(1.0) - F.bit_count(a.bitwiseXOR(b)) / F.lit(64.0)


def as_hex(c: Column) -> Column:
    return F.lpad(F.lower(F.hex(c)), 16, "0")


def edited_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """rid, next_rid, doc_id, n_chars, edited_sha256, fp and edited_fp (64-bit integers) of every row.

    The edited text has its last half replaced by as many first code points of the next row's text.
    """
    rows = in_id_order(docs, id_col, text_col).withColumn("n_chars", F.length("text").cast("long"))
    half = F.floor(F.col("n_chars") / 2).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), F.col("n_chars").cast("int") - half), F.substring(F.coalesce("next_text", F.lit("")), F.lit(1), half))
    # Numbers rather than text travel with the terms: each holds 15 hex digits of the sha256.
    rows = rows.withColumn("edited", edited).withColumn("sha", F.sha2("edited", 256))
    rows = rows.select("bucket", "rid", "next_rid", "id", "n_chars", *[F.conv(F.substring("sha", 1 + 15 * i, 15), 16, 10).cast("long").alias(f"s{i}") for i in range(5)], F.explode(F.array(F.struct(F.lit(0).alias("kind"), F.col("text")), F.struct(F.lit(1).alias("kind"), F.col("edited").alias("text")))).alias("t"))
    carried = ["next_rid", "id", "n_chars", "s0", "s1", "s2", "s3", "s4"]
    voted = rows.select("bucket", "rid", *carried, "t.kind", F.explode_outer(terms(F.col("t.text"))).alias("term"))
    sums = voted.groupBy("bucket", "rid", "kind").agg(*[F.max(c).alias(c) for c in carried], *vote_sums())
    prints = sums.select("bucket", "rid", "kind", *carried, signed_bits().alias("print"))
    both = prints.groupBy("bucket", "rid").agg(*[F.max(c).alias(c) for c in carried], F.max(F.when(F.col("kind") == 0, F.col("print"))).alias("fp"), F.max(F.when(F.col("kind") == 1, F.col("print"))).alias("edited_fp"))
    sha = F.concat(*[F.lpad(F.lower(F.hex(f"s{i}")), 15 if i < 4 else 4, "0") for i in range(5)])
    return both.select("rid", "next_rid", F.col("id").alias("doc_id"), "n_chars", sha.alias("edited_sha256"), "fp", "edited_fp")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and fp of every distinct (id, text) of docs."""
    rows = docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("text"))
    voted = rows.select("doc_id", F.xxhash64("text").alias("tie"), F.explode_outer(terms(F.col("text"))).alias("term"))
    return voted.groupBy("doc_id", "tie").agg(*vote_sums()).select("doc_id", signed_bits().alias("fp"))


def near_classes(prints: DataFrame, radius: int = 3, blocks: int = BLOCKS) -> DataFrame:
    """(fp, near_class): the smallest fingerprint reachable from fp by steps of at most radius bits, for all distinct fp."""
    widths = [64 * (i + 1) // blocks - 64 * i // blocks for i in range(blocks)]
    masks, at = [], 0
    for w in widths:
        masks.append(((1 << w) - 1) << at)
        at += w
    signed = lambda m: m - 2**64 if m >= 2**63 else m
    tables = [signed(sum(pick)) for pick in combinations(masks, blocks - radius)]
    distinct = staged(prints.select("fp").where("fp is not null").distinct(), "prints")
    keys = F.explode(F.array(*[F.xxhash64(F.lit(i), F.col("fp").bitwiseAND(F.lit(m).cast("long"))) for i, m in enumerate(tables)]))
    probes = distinct.select(F.col("fp").alias("id"), F.lit(0).alias("n"), keys.alias("key"))
    labels = bucket_components(staged(probes, "blocks"), lambda pairs: pairs, lambda a, b: F.bit_count(F.col(f"id{a}").bitwiseXOR(F.col(f"id{b}"))) <= radius)
    return distinct.join(labels.select(F.col("u").alias("fp"), F.col("v").alias("near_class")), "fp", "left").select("fp", F.coalesce("near_class", "fp").alias("near_class"))


def compare_edited(docs: DataFrame, radius: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every row and of its edited text, their likeness, that to the next row, and the class of near fingerprints."""
    made = staged(edited_fingerprints(docs, id_col, text_col), "prints")
    nexts = made.select(F.col("rid").alias("next_rid"), F.col("fp").alias("next_fp"))
    wide = made.join(nexts, "next_rid", "left").join(near_classes(made, radius), "fp", "left")
    return wide.select("doc_id", "n_chars", "edited_sha256", as_hex(F.col("fp")).alias("fingerprint"), as_hex(F.col("edited_fp")).alias("edited_fingerprint"), likeness(F.col("fp"), F.col("edited_fp")).alias("near_edited"), likeness(F.col("fp"), F.col("next_fp")).alias("near_next"), as_hex(F.col("near_class")).alias("near_class"))
