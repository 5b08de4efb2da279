"""Document fingerprints: one-permutation MinHash with optimal densification, kept as packed low-order bits.

Every shingle of five words is hashed once (as the hashes of its words). The top bits of the hash choose one of ``BINS`` bins, the bin keeps
its smallest hash, an empty bin borrows from another one, and the ``BITS`` low-order bits of each bin's value
are packed into long numbers. Two fingerprints agree in a bin with probability J + (1 - J) / 2^BITS for texts
of Jaccard similarity J; ``likeness`` takes that bias off.

Everything is a column expression. Steps whose value is used per array element are passed on through ``explode``
of a one-element array: a plain alias may be unfolded into its user, and be computed anew for every element.

Densification: an empty bin i tries the bins hash(i, 0), hash(i, 1), ... and takes the first that is not empty;
after ``PROBES`` misses it takes the filled bin j of the least hash(i, j). So the choice depends on i and the set of
filled bins alone, and few bins of a short text search long.

Defined results: a null text is an empty one; a text of one to four words is one shingle; a text without words has
the fingerprint '' and likeness 1 with another such text, 0 with all others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from flowlens.llm.common import with_results
from flowlens.operators.scale import materialize, number_rows

WORDS = 5
BINS_LOG = 8
BINS = 1 << BINS_LOG
BITS = 8
PROBES = 8
BLANK = r"[\x20\x09-\x0D]+"

_SHIFT = 64 - BINS_LOG
_PER_LONG = 64 // BITS
#: The largest value of each bin, in order. It is odd, and hashes are made even: it marks a bin without hash.
_ENDS = [(((i - BINS // 2) << _SHIFT) | ((1 << _SHIFT) - 1)) for i in range(BINS)]


#: The lowest bit of every packed digit.
_ONES = sum(1 << (BITS * i) for i in range(_PER_LONG))


def _fixed(df: DataFrame, **columns: Column) -> DataFrame:
    """Adds columns whose value is computed once, whatever uses or filters follow."""
    for name, value in columns.items():
        df = df.select("*", F.explode(F.array(value)).alias(name))
    return df


def with_fingerprint(df: DataFrame, text: Column, name: str) -> DataFrame:
    """Adds the packed fingerprint of ``text`` as ``array<bigint>``; an empty array for a text without words."""
    t = F.btrim(F.coalesce(text, F.lit("")), F.lit(" \t\n\x0b\f\r"))
    words = F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(t, BLANK))
    df = _fixed(df, __fp_w=F.transform(words, lambda x: F.xxhash64(x)))
    n = F.size("__fp_w")
    even = lambda h: h.bitwiseAND(F.lit(-2))
    after = lambda i: [F.get("__fp_w", i + k) for k in range(1, WORDS)]
    starts = F.slice("__fp_w", F.lit(1), F.greatest(n - (WORDS - 1), F.lit(0)))
    shingles = (
        F.when(n >= WORDS, F.transform(starts, lambda x, i: even(F.xxhash64(x, *after(i)))))
        .when(n > 0, F.array(even(F.xxhash64("__fp_w"))))
        .otherwise(F.array().cast("array<bigint>"))
    )
    # with the ends among them, the first value of each bin in sorted order is its minimum, and no bin is missing
    df = _fixed(df, __fp_s=F.sort_array(F.concat(shingles, F.lit(_ENDS).cast("array<bigint>"))), __fp_n=n).drop("__fp_w")
    bin_of = lambda x: F.shiftright(x, _SHIFT)
    firsts = F.filter("__fp_s", lambda x, i: (i == 0) | (bin_of(F.get("__fp_s", i - 1)) != bin_of(x)))
    # null: an empty bin
    df = _fixed(df, __fp_v=F.transform(firsts, lambda x: F.when(x.bitwiseAND(F.lit(1)) == 0, x))).drop("__fp_s")
    # the filled bins of short texts, whose empty bins would search long
    filled = F.array_compact(F.transform("__fp_v", lambda x, j: F.when(x.isNotNull(), F.struct(j.alias("j"), x.alias("x")))))
    df = _fixed(df, __fp_f=F.when(F.col("__fp_n") < BINS, filled))

    def borrowed(i: Column) -> Column:
        tried = [F.get("__fp_v", F.pmod(F.xxhash64(i, F.lit(t)), F.lit(BINS)).cast("int")) for t in range(PROBES)]
        of = lambda j, x: F.struct(F.xxhash64(i, j, F.lit(-1)).alias("h"), x.alias("x"))
        among_filled = F.array_min(F.transform("__fp_f", lambda p: of(p.getField("j"), p.getField("x"))))
        among_all = F.array_min(F.transform("__fp_v", lambda x, j: F.when(x.isNotNull(), of(j, x))))
        return F.coalesce(*tried, F.coalesce(among_filled, among_all).getField("x"))

    df = _fixed(df, __fp_d=F.when(F.col("__fp_n") > 0, F.transform("__fp_v", lambda x, i: F.coalesce(x, borrowed(i))))).drop("__fp_v", "__fp_f")
    digit = lambda x: F.shiftright(x, 1).bitwiseAND(F.lit((1 << BITS) - 1))
    packed = F.transform(
        F.sequence(F.lit(0), F.lit(BINS // _PER_LONG - 1)),
        lambda k: F.aggregate(F.slice("__fp_d", k * _PER_LONG + 1, _PER_LONG), F.lit(0).cast("bigint"), lambda acc, x: F.shiftleft(acc, BITS).bitwiseOR(digit(x))),
    )
    out = F.when(F.col("__fp_n") == 0, F.array().cast("array<bigint>")).otherwise(packed)
    return _fixed(df, **{name: out}).drop("__fp_n", "__fp_d")


def as_text(packed: Column) -> Column:
    """The packed bits in hexadecimal digits, two per bin."""
    return F.array_join(F.transform(packed, lambda x: F.lpad(F.hex(x), 16, "0")), "")


def likeness(a: Column, b: Column) -> Column:
    """Estimated Jaccard similarity (0 to 1) of two packed fingerprints, freed of chance agreement."""

    def unequal(x: Column) -> Column:
        any_bit, step = x, 1
        while step < BITS:
            any_bit, step = any_bit.bitwiseOR(F.shiftrightunsigned(any_bit, step)), 2 * step
        return F.bit_count(any_bit.bitwiseAND(F.lit(_ONES)))

    differ = F.aggregate(F.zip_with(a, b, lambda x, y: unequal(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
    chance = 2.0**-BITS
    agree = 1 - differ / F.lit(float(BINS))
    known = F.greatest((agree - chance) / F.lit(1 - chance), F.lit(0.0))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0)).when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(known)


def fingerprints(docs: DataFrame, text: str = "text") -> DataFrame:
    """All columns of ``docs`` and ``fingerprint``; nothing is shuffled."""
    df = with_fingerprint(docs, F.col(f"`{text}`").cast("string"), "__fp")
    return with_results(df, {"fingerprint": as_text(F.col("__fp"))}).drop("__fp")


def _numbered(rows: DataFrame) -> DataFrame:
    """(__a, __b, __n, idx): the documents in order of falling id; rows equal in id and text are one."""
    keys = rows.groupBy("__a", "__b", F.col("__k").isNull().alias("__none")).agg(F.max(F.char_length("__t")).cast("long").alias("__n"))
    # the complement reverses the order of ids without overflow
    placed = number_rows(keys.withColumn("__order", F.bitwise_not("__b")), ["__none", "__order", "__a"])
    return materialize(placed.select("__a", "__b", "__n", "idx"))


def edited(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Every row's id with its fingerprint, that of its edited text, and the likenesses.

    The last third (rounded down) of a text's code points gives way to as many, or all, code points from the start
    of the next document, in order of falling id, then of a hash of the text, ids that are null last; after the last
    comes the first. Rows equal in id and text count as one document there, and each of them has a result.
    Texts are shuffled once, by a hash of id and text; what a document is asked for travels back in a second shuffle.
    """
    k = F.col(f"`{key}`").cast("long")
    rows = docs.select(k.alias("__k"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("__t"))
    none = F.col("__k").isNull()
    rows = rows.select(F.xxhash64(none, "__k", "__t").alias("__a"), F.coalesce("__k", F.lit(0).cast("long")).alias("__b"), "__k", "__t")
    order = _numbered(rows)
    total = F.lit(max(order.count(), 1))
    asks = order.select(((F.col("idx") + 1) % total).alias("idx"), F.col("__a").alias("__to_a"), F.col("__b").alias("__to_b"), F.floor(F.col("__n") / 3).cast("int").alias("__ask"))
    asked = materialize(order.select("idx", "__a", "__b").join(asks, "idx").drop("idx"))
    mine = with_fingerprint(rows, F.col("__t"), "__fp")
    # merge joins that need the same columns of the texts, so that both read one shuffled copy
    given = mine.hint("merge").join(asked, ["__a", "__b"]).dropDuplicates(["__a", "__b"])
    given = given.select(F.col("__to_a").alias("__a"), F.col("__to_b").alias("__b"), F.col("__k").alias("next_id"), F.expr("substring(__t, 1, __ask)").alias("__head"), F.col("__fp").alias("__fp_next"))
    both = mine.hint("merge").join(given, ["__a", "__b"]).withColumn("n_chars", F.char_length("__t").cast("long"))
    changed = F.concat(F.expr("substring(__t, 1, int(n_chars - floor(n_chars / 3)))"), F.col("__head"))
    both = with_fingerprint(_fixed(both, __edited=changed).drop("__t", "__head"), F.col("__edited"), "__fp_edited")
    return both.select(
        F.col("__k").alias("doc_id"),
        "n_chars",
        F.sha2(F.col("__edited").cast("binary"), 256).alias("edited_sha256"),
        as_text(F.col("__fp")).alias("fingerprint"),
        as_text(F.col("__fp_edited")).alias("edited_fingerprint"),
        likeness(F.col("__fp"), F.col("__fp_edited")).alias("near_edited"),
        likeness(F.col("__fp"), F.col("__fp_next")).alias("near_next"),
        "next_id",
    )
