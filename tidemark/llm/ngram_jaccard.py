"""N-gram Jaccard join: near-duplicate documents by the Jaccard similarity of their sets of word shingles.

The overlaps are entries of the product of the sparse document-by-shingle matrix with its transpose. The product is
formed in blocks of columns (a shuffle partition holds all rows of its shingles; a large column is cut into tiles), the
overlap counts of a block are added up per pair, then over the blocks, and pairs whose sizes or counts cannot reach the
threshold go. What bounds derived from the sizes rule out is not multiplied at all. Under any one order of shingles, two
linked documents share at least ``common(n)`` shingles of their prefixes, the first n - ceil(0.8 n) + n // 10 + 1 of a
set; the order puts rare shingles first, by a fixed-size table of counts over the whole corpus. The prefixes are then cut
a second time, now by the number of rows of each column: a document keeps its rarest columns but for common(n) - 1, and
most documents, which share fewer, keep none. Each set also has a sketch, the parities of its shingles in SKETCH * 64
buckets: two sketches differ in no more bits than the sets differ in shingles, so pairs whose sketches differ in more
than the sizes allow go before they are counted. Pairs left are verified on the texts, by 64-bit hashes of all shingles.

Equal sets are folded into one class first, and passes before the product link each column's documents to a few hubs and
merge what is similar, so that a large family of near copies costs links in proportion to its size; the product then runs
on the pairs that are still apart, and misses none.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textwords
from .common import components, discard, lookup_join, stage, table

#: Counters of the corpus-wide table of shingle counts (fixed, whatever the input), and the parts they are summed in.
COUNTERS, PARTS = 1 << 22, 64
#: Hubs that each column's documents are linked to, in one pass after the other, until a pass finds no link.
HUBS = (3, 3)
#: Longs of a sketch. Entries of a column in one tile of the product; columns with more rows than FULL count as equally full.
SKETCH, TILE, FULL = 8, 2048, 1 << 17


def least_overlap(n: int, percent: int) -> int:
    """Shingles that a set of n shares with any set it links with, at least."""
    return -(-n * percent // 100)


def common(n: Column, percent: int) -> Column:
    """Prefix shingles that a set of n shares with any set it links with, at least: n // 10 + 1 for the smallest such set."""
    return F.floor(F.ceil(n * percent / 100) / 10) + 1


def shingle_sets(column: pa.Array, n: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text: runs of n words, or all words if there are fewer."""
    for _, _, data, at in textwords.groups(column):
        starts, ends, first = textwords.boundaries(data, at)
        words = textwords.hashes(data, starts, ends)
        runs = textwords.ngram_hashes(words, n)
        for a, b in zip(first[:-1], first[1:], strict=True):
            if b - a >= n:
                yield np.unique(runs[a : b - n + 1])
            elif b > a:
                with np.errstate(over="ignore"):
                    yield textwords.mix(textwords.ngram_hashes(words[a:b], int(b - a)) + np.uint64(b - a))
            else:
                yield np.zeros(0, np.uint64)


def shingle_ranks(docs: DataFrame, n: int) -> np.ndarray:
    """A rank from 0 (rare) to 255 for each value of the first 22 bits of a shingle's hash, from counts over all texts.

    Tasks send compressed counters, which are summed in parts by two rounds of shuffles; the table has COUNTERS bytes
    whatever the input.
    """
    size = COUNTERS // PARTS

    def pack(counts: np.ndarray) -> bytes:
        return pa.compress(counts.astype(np.int64).tobytes(), codec="zstd", asbytes=True)

    def rows(totals: dict[int, np.ndarray], salt: int) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"part": pa.array(list(totals), pa.int32()), "salt": pa.array([salt] * len(totals), pa.int32()), "counts": pa.array([pack(x) for x in totals.values()], pa.binary())})

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        total, some = np.zeros(COUNTERS, np.int64), False
        for batch in batches:
            for _, _, data, at in textwords.groups(batch.column(0)):
                starts, ends, first = textwords.boundaries(data, at)
                runs = textwords.ngram_hashes(textwords.hashes(data, starts, ends), n)
                inside = np.zeros(len(runs) + 1, np.int32)
                np.add.at(inside, np.minimum(first[:-1], len(runs)), 1)
                np.add.at(inside, np.minimum(np.maximum(first[1:] - n + 1, first[:-1]), len(runs)), -1)
                kept = runs[np.cumsum(inside)[:-1] > 0] >> np.uint64(42)
                at_, times = np.unique(kept, return_counts=True)
                total[at_.astype(np.int64)] += times
                some = True
        if some:
            yield rows({k: total[k * size : (k + 1) * size] for k in range(PARTS)}, TaskContext.get().partitionId() % 64)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, packed in zip(batch.column("part").to_pylist(), batch.column("counts"), strict=True):
                got = np.frombuffer(pa.decompress(packed.as_buffer(), decompressed_size=size * 8, codec="zstd"), np.int64)
                totals[part] = totals[part] + got if part in totals else got
        if totals:
            yield rows(totals, 0)

    kind = "part int, salt int, counts binary"
    parts = docs.select("text").mapInArrow(count, kind).repartition(16, "part", "salt").mapInArrow(add, kind).repartition(16, "part").mapInArrow(add, kind)
    total = np.zeros(COUNTERS, np.float32)  # exact enough for ranks, which are eighths of powers of two
    for r in parts.toLocalIterator():
        total[r.part * size : (r.part + 1) * size] = np.frombuffer(pa.decompress(r.counts, decompressed_size=size * 8, codec="zstd", asbytes=True), np.int64)
    usual, ranks = 2 * total.mean(dtype=np.float64) + 2, np.empty(COUNTERS, np.uint8)
    for k in range(0, COUNTERS, size):
        ranks[k : k + size] = np.clip(np.round(8 * np.log2((total[k : k + size] + 1) / usual)), 0, 255)
    return ranks


def signatures(docs: DataFrame, n: int, percent: int) -> DataFrame:
    """(doc_id, n_shingles, h1, h2: a 128-bit hash of the set, prefix: its rarest shingles, sketch) of every row."""
    ranks = docs.sparkSession.sparkContext.broadcast(shingle_ranks(docs, n))

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rank = ranks.value
        for batch in batches:
            sizes, h1, h2, prefixes, sketches = [], [], [], [], []
            with np.errstate(over="ignore"):
                for x in shingle_sets(batch.column("text"), n):
                    sizes.append(len(x))
                    h1.append(int(textwords.mix(x + np.uint64(1)).sum(dtype=np.uint64).view(np.int64)))
                    h2.append(int(textwords.mix(x ^ np.uint64(0xA5A5A5A5A5A5A5A5)).sum(dtype=np.uint64).view(np.int64)))
                    m = len(x) - least_overlap(len(x), percent) + len(x) // 10 + 1 if len(x) else 0
                    order = np.argsort(rank[(x >> np.uint64(42)).astype(np.int64)], kind="stable")[:m]
                    prefixes.append(x[order].view(np.int64))
                    odd = np.bincount((x & np.uint64(64 * SKETCH - 1)).astype(np.int64), minlength=64 * SKETCH) & 1
                    sketches.append(np.packbits(odd.astype(np.uint8)).view(np.int64))
            ends = np.cumsum([0, *map(len, prefixes)])
            prefix = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([np.zeros(0, np.int64), *prefixes])))
            sketch = pa.ListArray.from_arrays(pa.array(np.arange(0, SKETCH * len(sizes) + 1, SKETCH), pa.int32()), pa.array(np.concatenate([np.zeros(0, np.int64), *sketches])))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(h1, pa.int64()), pa.array(h2, pa.int64()), prefix, sketch], ["doc_id", "n_shingles", "h1", "h2", "prefix", "sketch"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(sign, "doc_id long, n_shingles long, h1 long, h2 long, prefix array<long>, sketch array<long>")


def _beside(pairs: DataFrame, of: DataFrame, *columns: str) -> DataFrame:
    """The pairs (a, b) with the columns of their rows in ``of`` (id, ...). An ``a`` in very many pairs is dealt over all partitions; b is the end with few."""
    salted = pairs.select("a", "b", F.pmod(F.xxhash64("b"), F.lit(1009)).alias("salt"))
    needed = salted.select("a", "salt").distinct()
    left = needed.join(of, needed.a == of.id).select("a", "salt", *[F.col(c).alias(f"{c}_a") for c in columns])
    right = salted.join(of, salted.b == of.id).select("a", "b", "salt", *[F.col(c).alias(f"{c}_b") for c in columns])
    return right.join(left, ["a", "salt"]).drop("salt")


def _alike(n1: Column, s1: Column, n2: Column, s2: Column, percent: int) -> Column:
    """Whether the sketches differ in no more bits than two linked sets of these sizes differ in shingles."""
    bits = reduce(lambda a, b: a + b, [F.bit_count(s1[k].bitwiseXOR(s2[k])) for k in range(SKETCH)])
    return bits * (100 + percent) <= (n1 + n2) * (100 - percent)


def verified(pairs: DataFrame, texts: DataFrame, n: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets are similar enough; texts: id, text, n, sketch."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: tuple = (None, None)
        for batch in batches:
            left, keep = batch.column("a").to_pylist(), []
            texts = batch.column("text_a")
            for i, b in enumerate(shingle_sets(batch.column("text_b"), n)):
                if kept[0] != left[i] or kept[2] != texts[i]:
                    kept = (left[i], next(shingle_sets(texts.slice(i, 1), n)), texts[i])
                a = kept[1]
                both = np.intersect1d(a, b, assume_unique=True).size
                keep.append(bool(both) and 100 * both >= percent * (len(a) + len(b) - both))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    near = _beside(pairs, texts, "n", "sketch").filter(_alike(F.col("n_a"), F.col("sketch_a"), F.col("n_b"), F.col("sketch_b"), percent)).select("a", "b")
    return _beside(near, texts, "text").select("a", "b", "text_a", "text_b").mapInArrow(check, "a long, b long").distinct()


def jaccard_classes(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row of docs (doc_id, text; other columns are not read).

    Rows link when 100 * |A & B| >= percent * |A | B| for their sets of distinct n-word shingles; component_id is the
    smallest doc_id reachable by links. A text of fewer than n words has one shingle, all its words; null, empty and blank
    texts have none and link with nothing. A null doc_id links with nothing and has a null component. Rows that repeat a
    doc_id are one node: their links are merged. No rows give no rows.
    """
    made: list[DataFrame] = []

    def kept(df: DataFrame, name: str) -> DataFrame:
        """df as a table that goes at the end."""
        made.append(stage(df, name))
        return made[-1]

    signed = kept(signatures(docs, n, percent), "signatures")
    total = signed.count()
    some = signed.filter("n_shingles > 0 AND doc_id IS NOT NULL")
    keys = ["n_shingles", "h1", "h2"]
    classes = kept(some.groupBy(*keys).agg(F.min("doc_id").alias("rep"), F.count("*").alias("w"), F.first("prefix").alias("prefix"), F.first("sketch").alias("sketch")), "classes")
    rows = stage(signed.select("doc_id", *keys), "rows")
    discard(made.pop(0))
    columns = kept(_indexed(_shared_columns(classes), percent), "columns")
    # Only documents with a column left can link; their texts are all that verification needs, in one shuffle.
    ids = columns.select("rep").distinct()
    sketches = kept(classes.join(ids, "rep", "left_semi").select(F.col("rep").alias("id"), F.col("n_shingles").alias("n"), "sketch"), "sketches")
    of_class = kept(classes.select(*keys, "rep", "w"), "of_class")
    discard(made.pop(0))
    texts = kept(docs.select(F.col("doc_id").cast("long").alias("id"), "text").join(sketches, "id"), "texts")

    links = linked = done = None
    for k in range(len(HUBS)):
        entries = _apart(columns, linked)
        hubs = kept(_mixed(entries, k), "hubs")
        pairs = _hub_pairs(entries, hubs, columns.count(), percent)
        if done is not None:
            pairs = pairs.join(done, ["a", "b"], "left_anti")
        pairs = kept(pairs, "pairs")
        got = kept(verified(pairs, texts, n, percent), "links")
        if not got.take(1):
            break
        done = pairs if done is None else done.union(pairs)
        links = got if links is None else links.union(got)
        linked = kept(components(links, "a", "b"), "linked")
    made.append(rest := _product_pairs(columns, sketches, linked, percent, done))
    if rest.take(1):
        got = kept(verified(rest, texts, n, percent), "links")
        links = got if links is None else links.union(got)
    # Rows that repeat a doc_id may lie in several classes, and link them.
    some = rows.filter("n_shingles > 0 AND doc_id IS NOT NULL")
    repeated = some.groupBy("doc_id").count().filter("count > 1").select("doc_id")
    extra = some.join(repeated, "doc_id", "left_semi").select("doc_id", *keys).distinct().join(of_class.select("rep", *keys), keys).select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    links = extra if links is None else links.select("a", "b").union(extra)
    final = kept(components(links, "a", "b"), "final")
    known = stage(of_class.join(final, F.col("rep") == F.col("node"), "left").select(*keys, "w", F.coalesce("component", "rep").alias("component")), "known")
    for x in made:
        discard(x)
    out = lookup_join(rows, known, keys, "w", total, F.col("doc_id"))
    own = F.when(F.col("n_shingles") == 0, F.col("doc_id")).when(F.col("doc_id").isNotNull(), F.col("component"))
    return out.select("doc_id", "n_shingles", own.alias("component_id"))


def _shared_columns(classes: DataFrame) -> DataFrame:
    """(shingle, n, rep, m): the entries of the prefix columns that hold m classes, two at least; m is FULL at most."""

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def counted(t: pa.Table, m: np.ndarray) -> Iterator[pa.RecordBatch]:
            yield from t.append_column("m", pa.array(m, pa.int32())).filter(pa.array(m > 1)).to_batches()

        def emit(t: pa.Table, new: np.ndarray) -> Iterator[pa.RecordBatch]:
            m = np.diff(np.r_[new, len(t)])
            yield from counted(t, np.minimum(np.repeat(m, m), FULL))

        held, full = None, None  # the last column may go on in the next batch; one that is known to be full is not held
        for batch in batches:
            t = pa.Table.from_batches([batch])
            if full is not None:
                more = int(np.searchsorted(t.column("shingle").to_numpy(), full, "right"))
                yield from counted(t.slice(0, more), np.full(more, FULL))
                t = t.slice(more)
                if not len(t):
                    continue
                full = None
            t = pa.concat_tables([held, t]).combine_chunks() if held is not None else t
            s = t.column("shingle").to_numpy()
            new = np.flatnonzero(np.r_[True, s[1:] != s[:-1]])
            yield from emit(t.slice(0, int(new[-1])), new[:-1])
            held = t.slice(int(new[-1]))
            if len(held) >= FULL:
                yield from counted(held, np.full(len(held), FULL))
                held, full = None, s[-1]
        if held is not None:
            yield from emit(held, np.zeros(1, np.int64))

    entries = classes.select(F.explode("prefix").alias("shingle"), F.col("n_shingles").cast("int").alias("n"), "rep")
    return entries.repartition("shingle").sortWithinPartitions("shingle").mapInArrow(runs, "shingle long, n int, rep long, m int")


def _indexed(columns: DataFrame, percent: int) -> DataFrame:
    """(shingle, n, rep, room): the entries that stay when each class drops its common(n) - 1 fullest columns.

    room counts the class's columns from this one on, in their order of fullness: a pair whose first common column is this
    one shares no more than the smaller room of the two. Columns that only one class has count as kept.
    """
    rows = columns.groupBy("rep", "n").agg(F.sort_array(F.collect_list(F.struct("m", "shingle"))).alias("own"))
    keep = (F.size("own") - common(F.col("n"), percent) + 1).cast("int")
    rows = rows.filter(keep > 0).select(F.posexplode(F.slice("own", F.lit(1), keep)).alias("i", "x"), F.size("own").alias("s"), "n", "rep")
    return rows.select("x.shingle", "n", "rep", (F.col("s") - F.col("i")).alias("room"))


def _beyond(n1: Column, n2: Column, percent: int) -> Column:
    """Shingles that two sets of these sizes share outside of their prefixes, at most."""

    def beyond(n: Column) -> Column:
        return F.ceil(n * percent / 100) - F.floor(n / 10) - 1

    return F.greatest(beyond(n1), beyond(n2))


def _needed(n1: Column, n2: Column, percent: int) -> Column:
    """Shingles that two linked sets of these sizes share, at least."""
    return F.ceil((n1 + n2) * percent / (100 + percent) - 1e-9)


def _sized(n1: Column, n2: Column, percent: int) -> Column:
    return F.least(n1, n2) * 100 >= F.greatest(n1, n2) * percent


def _possible(n1: Column, room1: Column, n2: Column, room2: Column, percent: int) -> Column:
    """Whether two sets of these sizes can link if the prefix columns that they share are no more than either room."""
    return _sized(n1, n2, percent) & (F.least(room1, room2) + _beyond(n1, n2, percent) >= _needed(n1, n2, percent))


def _apart(columns: DataFrame, linked: DataFrame | None) -> DataFrame:
    """The columns' entries with their component so far."""
    if linked is None:
        return columns.withColumn("component", F.col("rep"))
    return columns.join(linked, F.col("rep") == F.col("node"), "left").select(*columns.columns, F.coalesce("component", "rep").alias("component"))


def _mixed(entries: DataFrame, k: int) -> DataFrame:
    """Per column that holds several components: the hubs of pass k and the number of entries.

    One hub is the class with the most shared columns for its size, the likeliest partner; the others are drawn by hash.
    """
    one = F.struct("rep", "n", "component", "room")
    orders = [F.xxhash64("rep", F.lit(k), F.lit(j)) for j in range(1, HUBS[k])]
    hubs = F.array_distinct(F.array(*[F.min_by(one, x) for x in (F.struct(-F.col("room") / F.col("n"), F.col("n"), F.col("rep")), *orders)]))
    return entries.groupBy("shingle").agg(hubs.alias("hubs"), F.count("*").alias("w"), F.min("component").alias("c0"), F.max("component").alias("c1")).filter("c0 != c1").drop("c0", "c1")


def _hub_pairs(entries: DataFrame, hubs: DataFrame, total: int, percent: int) -> DataFrame:
    """The pairs of a hub and a class of its column in another component; total: the number of entries."""
    out = lookup_join(entries, hubs, ["shingle"], "w", total, F.col("rep")).filter("hubs IS NOT NULL")
    out = out.select("rep", "n", "component", "room", F.explode("hubs").alias("hub")).filter("component != hub.component")
    fits = _possible(F.col("n"), F.col("room"), F.col("hub.n"), F.col("hub.room"), percent)
    return out.filter(fits).select(F.col("hub.rep").alias("a"), F.col("rep").alias("b")).distinct()


def _product_pairs(columns: DataFrame, sketches: DataFrame, linked: DataFrame | None, percent: int, done: DataFrame | None) -> DataFrame:
    """The pairs of classes in different components whose overlap counts over the prefix columns allow the threshold.

    A class left common(n) - 1 of its prefix columns out, so that what two classes share of their prefixes is no more
    than the counted columns and those of both that are left out.
    """
    entries = _apart(columns, linked)
    mixed = entries.groupBy("shingle").agg(F.min("component").alias("c0"), F.max("component").alias("c1"), F.count("*").alias("m")).filter("c0 != c1")
    mixed = stage(mixed.select("shingle", "m", F.lit(True).alias("mixed")), "mixed")
    entries = lookup_join(entries, mixed, ["shingle"], "m", columns.count(), F.col("rep")).filter("mixed").drop("mixed")
    entries = entries.join(sketches.select(F.col("id").alias("rep"), "sketch"), "rep")
    entries = stage(entries.select("shingle", "rep", "n", "component", "m", *[F.get("sketch", k).alias(f"s{k}") for k in range(SKETCH)]), "apart")
    pairs = _crossed(entries.filter(F.col("m") <= TILE), ["shingle"], percent)
    if entries.filter(F.col("m") > TILE).take(1):
        tiles = F.ceil(F.col("m") / TILE).cast("int")
        own, every = F.pmod(F.xxhash64("rep"), tiles).cast("int"), F.explode(F.sequence(F.lit(0), tiles - 1))
        large = entries.filter(F.col("m") > TILE)
        pairs = pairs.union(_crossed(large.withColumn("i", own).withColumn("j", every), ["shingle", "i", "j"], percent, large.withColumn("j", own).withColumn("i", every)))
    counts = pairs.groupBy("a", "b", "n1", "n2").agg(F.count("*").alias("shared"))
    n1, n2 = F.col("n1"), F.col("n2")
    most = F.col("shared") + common(n1, percent) + common(n2, percent) - 2 + _beyond(n1, n2, percent)
    out = counts.filter(most >= _needed(n1, n2, percent)).select("a", "b")
    if done is not None:  # these were verified
        out = out.join(done.union(done.select("b", "a")), ["a", "b"], "left_anti")
    out = stage(out, "counted")
    for made in (mixed, entries):
        discard(made)
    return out


def _crossed(left: DataFrame, keys: list[str], percent: int, right: DataFrame | None = None) -> DataFrame:
    """(a, b, n1, n2) for each two entries of a column, of classes in different components whose sizes and sketches allow a link."""
    x, y = left.alias("x"), (left if right is None else right).alias("y")
    n1, n2 = F.col("x.n"), F.col("y.n")
    near = _sized(n1, n2, percent) & _alike(n1, [F.col(f"x.s{k}") for k in range(SKETCH)], n2, [F.col(f"y.s{k}") for k in range(SKETCH)], percent)
    same = reduce(lambda a, b: a & b, [F.col(f"x.{c}") == F.col(f"y.{c}") for c in keys])
    out = x.join(y, same & (F.col("x.rep") < F.col("y.rep")) & (F.col("x.component") != F.col("y.component")) & near)
    return out.select(F.col("x.rep").alias("a"), F.col("y.rep").alias("b"), n1.alias("n1"), n2.alias("n2"))


def op5_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_classes(table(spark, sf_dir, "documents"))


OP5_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
s AS (SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
             ELSE list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))) END AS g FROM w),
e AS (SELECT doc_id, len(g) AS n, unnest(g) AS t FROM s),
p AS MATERIALIZED (SELECT a.doc_id AS a, b.doc_id AS b FROM e a JOIN e b ON a.t = b.t AND a.doc_id < b.doc_id AND least(a.n, b.n) * 100 >= greatest(a.n, b.n) * 80
      GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
l AS MATERIALIZED (SELECT a, b FROM p UNION ALL SELECT b, a FROM p),
r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a)
SELECT s.doc_id, len(s.g) AS n_shingles, c.component_id FROM s JOIN (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY a) c USING (doc_id)
"""
