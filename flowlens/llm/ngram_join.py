"""N-gram Jaccard join: near-duplicate texts by rare-first prefix filtering, verified once per pair.

A text's set holds its distinct n-word shingles (64-bit hashes). Two sets with a Jaccard
similarity of at least t share one of the first ``n - ceil(t n) + 1`` shingles of each, whatever
the common order is; ordered from rare to frequent, prefixes of unrelated texts hardly ever meet.

1. All shingles of all texts are counted. Tasks send sorted, packed hashes with counts by hash
   range; each range answers with a slice of a bit filter of the hashes that occur twice or more.
   A shingle in every text is one entry per block, so no range grows with a hot shingle.
2. A text whose prefix holds only shingles that the filter does not know has no partner. The
   others go, one per distinct set (exact copies collapse), into a table of sorted sets.
3. Exact frequencies in that table give the rare-first order, the prefixes and their postings.
4. Posting lists are linked as stars first: each member meets one leader. Lists whose members
   are in one component by then are done; all pairs between different components of the rest are
   tried after that. Length, positional and suffix (range histogram) filters come before the
   verification, and no pair is verified twice. A group of m near copies costs m pairs, not m^2.

The filter has a fixed bound (``FILTER_BITS``); where it fills up, more texts pass step 2 and the
result stays the same. Everything else moves through shuffles and tables in the shared folder.

Defined results: null or empty text, no word: empty set, linked with nothing. Repeated rows:
each is a row of the result. Null ids: rows of their own, never the name of a component unless
all its ids are null. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from flowlens.llm.common import SPACED, mixed, words_of
from flowlens.session import scratch_path

FILTER_BITS = 1 << 28
BLOCK = 1_000_000
RANGE_ENTRIES = 1_500_000
SENT_BITS = 40  # of a hash, in the search for repeated ones; a collision lets one more text pass step 2
SPANS = 16
STAR_ROUNDS = 4


def shingle_sets(texts: pa.Array, size: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, sorted distinct shingles of the rows back to back, their offsets) chunk by chunk."""
    for first, last, words in words_of(texts, SPACED):
        h, ptr, counts = words.hashes(), words.ptr, words.counts
        whole = np.zeros(max(0, len(h) - size + 1), np.uint64)
        for i in range(size):
            whole = mixed(whole ^ h[i : len(whole) + i], i + 1)
        parts = []
        for a, n in zip(ptr[:-1].tolist(), counts.tolist(), strict=True):
            if n >= size:
                part = np.sort(whole[a : a + n - size + 1])
            elif n:
                part = np.zeros(1, np.uint64)
                for i in range(n):
                    part = mixed(part ^ h[a + i : a + i + 1], i + 1)
                part = mixed(part, 100 + n)
            else:
                part = whole[:0]
            parts.append(part)
        flat = np.concatenate(parts) if parts else whole[:0]
        at = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64)
        keep = np.ones(len(flat), bool)
        keep[1:] = flat[1:] != flat[:-1]
        keep[at[:-1][np.diff(at) > 0]] = True
        rank = np.concatenate([[0], np.cumsum(keep)])
        yield first, flat[keep], rank[at]


def fingerprints(flat: np.ndarray, at: np.ndarray) -> list[bytes]:
    """128 bits of each set."""
    halves = []
    for salt in (3, 5):
        total = np.zeros(len(flat) + 1, np.uint64)
        np.cumsum(mixed(flat, salt), out=total[1:])
        halves.append(mixed(total[at[1:]] - total[at[:-1]], salt))
    both = np.stack(halves, axis=1).tobytes()
    return [both[i : i + 16] for i in range(0, len(both), 16)]


def _sent(h: np.ndarray) -> np.ndarray:
    return h >> np.uint64(64 - SENT_BITS)


def _range_of(sent: np.ndarray, ranges: int) -> np.ndarray:
    return ((sent >> np.uint64(SENT_BITS - 32)) * np.uint64(ranges)) >> np.uint64(32)


def _packed(h: np.ndarray, n: np.ndarray) -> bytes:
    """Sorted values as 32-bit steps where they fit, and the counts that are not 1."""
    steps = np.diff(h, prepend=h[:1])
    many = np.flatnonzero(n > 1).astype(np.uint32)
    short = int(steps.max()) < 1 << 32
    head = np.array([len(h), len(many), short], np.uint32).tobytes() + h[:1].tobytes()
    return head + (steps.astype(np.uint32) if short else h).tobytes() + many.tobytes() + n[many].astype(np.uint32).tobytes()


def _unpacked(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    size, many, short = np.frombuffer(raw, np.uint32, 3).tolist()
    if short:
        h = np.cumsum(np.frombuffer(raw, np.uint32, size, 20), dtype=np.uint64) + np.frombuffer(raw, np.uint64, 1, 12)
    else:
        h = np.frombuffer(raw, np.uint64, size, 20)
    at = 20 + (4 if short else 8) * size
    n = np.ones(size, np.int64)
    n[np.frombuffer(raw, np.uint32, many, at)] = np.frombuffer(raw, np.uint32, many, at + 4 * many)
    return h, n


def _bits(h: np.ndarray, per_range: int) -> tuple[np.ndarray, np.ndarray]:
    """Two bit places of each value within the slice of its range."""
    m = mixed(h, 11)
    return (m & np.uint64(0xFFFFFFFF)) % np.uint64(per_range), (m >> np.uint64(32)) % np.uint64(per_range)


def repeated_filter(docs: DataFrame, text: str, size: int, ranges: int, per_range: int) -> np.ndarray:
    """The bit filter (ranges x per_range bits as bytes) of shingles that more than one text holds."""

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def block() -> pa.RecordBatch:
            h, n = np.unique(np.concatenate(held), return_counts=True)
            held.clear()
            r = _range_of(h, ranges)
            cuts = np.flatnonzero(np.diff(r)) + 1
            at = [0, *cuts.tolist(), len(h)]
            return pa.RecordBatch.from_arrays(
                [pa.array([int(r[a]) for a in at[:-1]], pa.int32()), pa.array([_packed(h[a:b], n[a:b]) for a, b in zip(at, at[1:], strict=False)], pa.binary())], ["range", "packed"]
            )

        for batch in batches:
            for _, flat, _ in shingle_sets(batch.column(0), size):
                if len(flat):
                    held.append(_sent(flat))
                if sum(map(len, held)) >= BLOCK:
                    yield block()
        if held:
            yield block()

    def counted(table: pa.Table) -> pa.Table:
        parts = [_unpacked(x) for x in table.column("packed").to_pylist()]
        h, n = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
        order = np.argsort(h, kind="stable")
        h, n = h[order], n[order]
        first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
        twice = h[first[np.add.reduceat(n, first) > 1]]
        bits = np.zeros(per_range, np.uint8)
        for at in _bits(twice, per_range):
            bits[at] = 1
        return pa.table({"range": pa.array([table.column("range")[0].as_py()], pa.int32()), "bits": pa.array([np.packbits(bits).tobytes()], pa.binary())})

    sent = docs.select(F.col(text).cast("string")).mapInArrow(packed, "range int, packed binary")
    out = np.zeros((ranges, per_range // 8), np.uint8)
    # As many bytes as FILTER_BITS says at most; no more than that comes to the driver.
    for row in sent.groupBy("range").applyInArrow(counted, "range int, bits binary").collect():
        out[row["range"]] = np.frombuffer(row["bits"], np.uint8)
    return out


def _numbers(docs: DataFrame, key: str, text: str, size: int, keep: tuple[str, ...] = ()) -> DataFrame:
    """(id, keep, fp, n) of each row: fingerprint and size of its set; ``keep`` are columns of long numbers."""

    def sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, flat, at in shingle_sets(batch.column(1), size):
                n = len(at) - 1
                kept = [batch.column(k).slice(first, n) for k in (0, *range(2, batch.num_columns))]
                yield pa.RecordBatch.from_arrays([*kept, pa.array(fingerprints(flat, at), pa.binary()), pa.array(np.diff(at), pa.int64())], ["id", *keep, "fp", "n"])

    kept = "".join(f"{c} long, " for c in keep)
    return docs.select(F.col(key).cast("long"), F.col(text).cast("string"), *keep).mapInArrow(sizes, f"id long, {kept}fp binary, n long")


def _suspects(docs: DataFrame, text: str, size: int, percent: int, bits: np.ndarray, ranges: int, per_range: int) -> DataFrame:
    """(fp, n, spans, tokens) of texts whose rare-first prefix may hold a shared shingle."""
    shared = docs.sparkSession.sparkContext.broadcast(bits)

    def chosen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            for _, flat, at in shingle_sets(batch.column(0), size):
                sent = _sent(flat)
                r = _range_of(sent, ranges).astype(np.int64)
                seen = np.ones(len(flat), bool)
                for place in _bits(sent, per_range):
                    place = place.astype(np.int64)
                    seen &= (known[r, place >> 3] >> (7 - (place & 7)).astype(np.uint8)) & 1 == 1
                total = np.concatenate([[0], np.cumsum(seen)])
                n = np.diff(at)
                rare = n - (total[at[1:]] - total[at[:-1]])
                rows = np.flatnonzero((n > 0) & (rare < n - -(-percent * n // 100) + 1))
                fps = fingerprints(flat, at)
                if len(rows):
                    keep = np.repeat(np.isin(np.arange(len(n)), rows), n)
                    ends = np.concatenate([[0], np.cumsum(n[rows])]).astype(np.int32)
                    own, span = np.repeat(np.arange(len(rows)), n[rows]), (flat[keep] >> np.uint64(60)).astype(np.int64)
                    spans = np.bincount(own * SPANS + span, minlength=len(rows) * SPANS).astype(np.int32)
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([fps[d] for d in rows.tolist()], pa.binary()),
                            pa.array(n[rows], pa.int64()),
                            pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * SPANS), pa.array(spans)),
                            pa.ListArray.from_arrays(pa.array(ends), pa.array(flat[keep].view(np.int64))),
                        ],
                        ["fp", "n", "spans", "tokens"],
                    )

    return docs.select(F.col(text).cast("string")).mapInArrow(chosen, "fp binary, n long, spans array<int>, tokens array<long>")


def _table(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path, compression=compression)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _bucketed(df: DataFrame, name: str, by: str, compression: str = "snappy", sorted_in: bool = False) -> DataFrame:
    """A table in buckets of ``by``: joins on that column move the other side alone.

    ``sorted_in``: each partition holds one bucket already, so the rows stay where they are.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    table = path.rsplit("/", 1)[1].replace("-", "_")
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    if not sorted_in:
        df = df.repartition(buckets, by)
    df.write.bucketBy(buckets, by).sortBy(by).option("path", path).option("compression", compression).saveAsTable(table)
    out = spark.table(table)
    spark.sql(f"DROP TABLE {table}")  # the entry of the catalog; the files stay, and the plan of ``out`` knows them
    return out


def _pairs(left: DataFrame, right: DataFrame, sets: DataFrame, percent: int, every: bool) -> DataFrame:
    """Pairs of different components in both posting lists, after length, positional and suffix filter, each once.

    ``every``: all pairs of the lists, each where its first common shingle is; else those of a leader and a member.
    """
    names = ("node", "n", "rare", "place", "comp", *(("listed",) if every else ()))
    a, b = (df.select("token", *[F.col(c).alias(f"{c}_{side}") for c in names]) for df, side in ((left, "a"), (right, "b")))
    # The least overlap of two linked sets: ceil(t (na + nb) / (1 + t)).
    need = F.expr(f"({percent} * (n_a + n_b) + {percent} + 99) div ({percent} + 100)")
    common = F.aggregate(F.zip_with("spans_a", "spans_b", lambda x, y: F.least(x, y)), F.lit(0), lambda s, x: s + x)
    first = F.element_at(F.array_intersect("listed_a", "listed_b"), 1) == F.col("token") if every else F.lit(True)
    met = a.join(b, "token").where(
        ((F.col("comp_a") < F.col("comp_b")) if every else (F.col("comp_a") != F.col("comp_b")))
        & (100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b"))
        # Shingles that one set alone holds come first and are never common.
        & (F.least(F.col("place_a") - F.col("rare_a"), F.col("place_b") - F.col("rare_b")) + F.least(F.col("n_a") - F.col("place_a"), F.col("n_b") - F.col("place_b")) >= need)
        & first
    )
    pairs = met.select(F.least("node_a", "node_b").alias("a"), F.greatest("node_a", "node_b").alias("b")).distinct()
    for side in ("a", "b"):
        pairs = pairs.join(sets.select(F.col("node").alias(side), F.col("n").alias(f"n_{side}"), F.col("spans").alias(f"spans_{side}")), side)
    return pairs.where(common >= need).select("a", "b")


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(a, b, linked)."""
    one = sets.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("tokens").alias("ta"))
    two = sets.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("tokens").alias("tb"))
    both = F.size(F.array_intersect("ta", "tb"))
    return pairs.join(one, "a").join(two, "b").select("a", "b", (100 * both >= percent * (F.col("na") + F.col("nb") - both)).alias("linked"))


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, comp): the least node that each node of the edges reaches, by hooking and pointer jumping."""
    pairs = edges.select(F.col(a).alias("u"), F.col(b).alias("v"))
    pairs = _table(pairs.union(pairs.select("v", "u")).distinct(), "edges")
    labels = _table(pairs.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("v")).select("node", F.least("node", "v").alias("comp")), "labels")
    while True:
        near = pairs.join(labels.withColumnRenamed("node", "v"), "v").groupBy(F.col("u").alias("node")).agg(F.min("comp").alias("near"))
        jump = labels.select(F.col("node").alias("comp"), F.col("comp").alias("jump"))
        new = labels.join(near, "node").join(jump, "comp", "left")
        new = _table(new.select("node", F.least("comp", "near", "jump").alias("comp"), (F.least("comp", "near", "jump") < F.col("comp")).alias("moved")), "labels")
        moved = new.where("moved").limit(1).count()
        labels = new.select("node", "comp")
        if not moved:
            return labels


def _merged(comps: DataFrame, linked: DataFrame) -> DataFrame:
    """(node, comp) of all sets after more links."""
    of = lambda c: linked.select("a", "b").join(comps.select(F.col("node").alias(c), F.col("comp").alias(f"c{c}")), c)
    ab = of("a").join(comps.select(F.col("node").alias("b"), F.col("comp").alias("cb")), "b").where("ca <> cb").select(F.col("ca").alias("a"), F.col("cb").alias("b"))
    roots = components(ab)
    return _table(comps.join(roots.select(F.col("node").alias("comp"), F.col("comp").alias("root")), "comp", "left").select("node", F.coalesce("root", "comp").alias("comp")), "comps")


def _linked_components(sets: DataFrame, percent: int) -> DataFrame:
    """(node, comp) of the sets of ``sets``."""
    tokens = sets.select("node", F.explode("tokens").alias("token"))
    often = tokens.groupBy("token").agg(F.count("*").alias("df")).where("df > 1")
    ordered = tokens.join(often, "token").groupBy("node").agg(F.sort_array(F.collect_list(F.struct("df", "token"))).alias("known"))
    rare = F.col("n") - F.size("known")
    length = F.expr(f"n - ({percent} * n + 99) div 100 + 1")
    found = ordered.join(sets.select("node", "n"), "node").withColumn("room", (length - rare).cast("int")).where("room > 0")
    found = found.select("node", "n", rare.alias("rare"), F.posexplode(F.slice("known", F.lit(1), F.col("room"))).alias("i", "x"))
    postings = _table(found.select(F.col("x.token").alias("token"), "node", "n", "rare", (F.col("rare") + F.col("i")).alias("place")), "postings")
    comps = _table(postings.select("node", F.col("node").alias("comp")).distinct(), "comps")
    tried: DataFrame | None = None
    stars = True
    for turn in range(STAR_ROUNDS + 1):
        listed = postings.join(comps, "node")
        # The set with the fewest shingles of its own is the likeliest centre of a group.
        leads = F.min_by(F.struct("node", "n", "rare", "place", "comp"), F.struct("rare", F.xxhash64("node", F.lit(turn)))).alias("lead")
        open_ = listed.groupBy("token").agg(F.min("comp").alias("c1"), F.max("comp").alias("c2"), leads).where("c1 <> c2")
        rest = listed.join(open_.select("token"), "token", "left_semi")
        last = not stars or turn == STAR_ROUNDS
        if last:
            # Shingles of a set's open lists, in the common order.
            own = rest.groupBy("node").agg(F.transform(F.sort_array(F.collect_list(F.struct("place", "token"))), lambda x: x.token).alias("listed"))
            rest = rest.join(own, "node")
        pairs = _pairs(rest, rest, sets, percent, True) if last else _pairs(open_.select("token", "lead.*"), rest, sets, percent, False)
        if tried is not None:
            pairs = pairs.join(tried, ["a", "b"], "left_anti")
        done = _table(_verified(pairs, sets, percent), "verified")
        tried = done.select("a", "b") if tried is None else tried.union(done.select("a", "b"))
        linked = done.where("linked")
        stars = linked.limit(1).count() > 0  # a round of stars without a link is the last one
        if stars:
            comps = _merged(comps, linked)
        if last:
            return comps
    raise AssertionError("the last round returns")


def _grouped(docs: DataFrame, key: str, text: str, size: int, percent: int, keep: tuple[str, ...] = ()) -> DataFrame:
    """(id, keep, n, comp) of each row of ``docs``; comp is null where the set is empty or linked with nothing."""
    spark: SparkSession = docs.sparkSession
    rows = _table(_numbers(docs, key, text, size, keep), "rows")
    total = rows.agg(F.sum("n")).first()[0] or 0
    ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // RANGE_ENTRIES))
    per_range = max(64, min(FILTER_BITS, max(1 << 20, total)) // ranges // 8 * 8)
    bits = repeated_filter(docs, text, size, ranges, per_range)
    sets = _suspects(docs, text, size, percent, bits, ranges, per_range).groupBy("fp").agg(F.first("n").alias("n"), F.first("spans").alias("spans"), F.first("tokens").alias("tokens"))
    sets = _bucketed(_table(sets.withColumn("node", F.monotonically_increasing_id()), "numbered"), "sets", "node")
    comps = sets.select("fp", "node").join(_linked_components(sets, percent), "node", "left").select("fp", F.coalesce("comp", "node").alias("comp"))
    # A text whose set is not in that table is linked with nothing.
    return rows.join(comps, "fp", "left").drop("fp")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = 5, percent: int = 80) -> DataFrame:
    """One row per row of ``docs``: key, n_shingles, component_id (the smallest key reachable by links).

    Two rows link when ``100 * |A n B| >= percent * |A u B|`` for their sets of ``size``-word shingles.
    """
    named = _grouped(docs, key, text, size, percent)
    least = named.where("comp is not null").groupBy("comp").agg(F.min("id").alias("least"))
    one = F.when(F.col("comp").isNotNull(), F.col("least")).otherwise(F.col("id"))
    return named.join(least, "comp", "left").select(F.col("id").alias(key), F.col("n").alias("n_shingles"), one.alias("component_id"))


def one_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` that stay when one row of each group of near duplicates is kept.

    That is the one with the smallest key (no key comes last), of equal keys any one. Rows that are
    linked with nothing all stay, whatever their keys are.
    """
    row, part = _unused(docs, "__row"), _unused(docs, "__part")
    numbered = docs.withColumn(row, F.monotonically_increasing_id()).withColumn(part, F.shiftright(row, 33))
    numbered = _bucketed(numbered, "numbered", part, "zstd", True)
    named = _table(_grouped(numbered, key, text, size, percent, (row,)).where("comp is not null").select("id", F.col(row).alias("row"), "comp"), "named")
    first = named.groupBy("comp").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "row"))["row"].alias("stays"))
    gone = named.join(first, "comp").where("row <> stays")
    # what goes of each written part (no more rows than a task read) comes to the part; the texts stay where they are
    lost = _unused(docs, "__gone")
    gone = gone.groupBy(F.shiftright("row", 33).alias(part)).agg(F.collect_list("row").alias(lost))
    stays = ~F.coalesce(F.array_contains(lost, F.col(row)), F.lit(False))
    return numbered.join(gone, part, "left").where(stays).select(*[F.col(f"`{c}`") for c in docs.columns])


def _unused(df: DataFrame, name: str) -> str:
    """``name``, with more underscores where ``df`` has such a column."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name = f"_{name}"
    return name
