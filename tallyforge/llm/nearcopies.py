"""Near copies: texts whose sets of five-word shingles have a similarity of 0.8 or more, all of them.

They are searched for by SimHash and multi-index hashing, as operator 8 does it: each set
of shingles has a 64-bit fingerprint, and connected fingerprints within `radius` bits, found
by segments and their balls (see simhash), make groups of candidates. An exact check
follows: the similarity is that of the sets of hashes (64 bits), see setlinks.

Texts at a similarity of 0.8 differ in about 15 % of the bits of their fingerprints, beyond
what balls in segments can reach. The exact way for those is prefix filtering, which misses
no pair at any size of the input; of its candidates only those that the fingerprints haven't
joined are compared. A partner of a text of n
shingles shares at least ceil(4 n / 5) of them; so, in any order that all texts keep, two partners
share at least k of their first n - ceil(4 n / 5) + k shingles each, for any k up to that.

The order puts common shingles last: shingles are counted in a fixed number of slots by their
hashes, and those of slots that hold far more than the mean come after the others, the fullest
last. Counts of slots are small and the same for all tasks; no shingle is shuffled for them.
Only the first shingles of each text are shuffled. Sizes of partners differ by a quarter at
most, so each text stands in the band of its size and in the next, and meets others of the
same band only. Where fewer than k of a text's shingles occur in others, it has no partner
there. The rest are candidates of each other where they meet; connected ones of a band are
compared by their sets too. Groups are connected components of all links.

Texts with no words are one group. Null text counts as empty. Repeated rows are copies. An
empty table gives no rows. Extra columns, whatever their names, are kept by drop_near_copies.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import forget, likely_in, materialize, small_batches, spare_names, sweep
from .components import components
from .setlinks import set_links
from .simhash import BLOCK, fold, linked, shingle_hashes

#: Two texts are near copies if they share so much of the union of their shingles: 4 / 5.
SIMILAR = (4, 5)
SLOTS, PARTS, COUNTERS = 1 << 18, 16, 1024
#: The least sizes of the bands: partners are in one band or in neighbouring ones.
BANDS = [1]
while BANDS[-1] < 1 << 31:
    BANDS.append(BANDS[-1] * SIMILAR[1] // SIMILAR[0] + 1)
STRIDE = 128  # more than there are bands


def shingle_set(text: str | None, width: int = 5) -> np.ndarray:
    """The distinct hashes of a text's shingles in rising order, as signed longs."""
    return np.unique(np.concatenate([np.zeros(0, np.int64), *(h.view(np.int64) for h in shingle_hashes(text or "", width))]))


def set_fingerprint(items: np.ndarray) -> int:
    """The 64-bit SimHash of a set of hashes, as a signed long."""
    return int(np.uint64(fold(items[a : a + BLOCK].view(np.uint64) for a in range(0, len(items), BLOCK))).view(np.int64))


def shingle_sets(docs: DataFrame, width: int = 5) -> DataFrame:
    """doc_id, digest (16 bytes of the set), fp (its fingerprint), items (hashes of the distinct shingles, sorted) of every row."""
    schema = T.StructType([docs.schema["doc_id"], T.StructField("digest", T.BinaryType()), T.StructField("fp", T.LongType()), T.StructField("items", T.ArrayType(T.LongType()))])

    def run(batches):
        for b in batches:
            sets = [shingle_set(t, width) for t in b.column(1).to_pylist()]
            digests = pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], pa.binary())
            fps = pa.array([set_fingerprint(s) for s in sets], pa.int64())
            items = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, sets)]), pa.int32()), pa.array(np.concatenate([np.zeros(0, np.int64), *sets])))
            yield pa.RecordBatch.from_arrays([b.column(0), digests, fps, items], names=schema.fieldNames())

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def slot_counts(sets: DataFrame) -> np.ndarray:
    """How many shingles of all sets (items) fall on each slot; COUNTERS tasks at most add up their own first, so what moves is bounded."""
    each = SLOTS // PARTS

    def count(batches):
        n = np.zeros(SLOTS, np.int64)
        for b in batches:
            values = b.column(0).flatten().to_numpy()
            n += np.bincount(values & (SLOTS - 1), minlength=SLOTS)
        yield pa.RecordBatch.from_arrays([pa.array(range(PARTS), pa.int32()), pa.array([n[i * each : (i + 1) * each].astype(np.uint32).tobytes() for i in range(PARTS)], pa.binary())], names=["part", "counts"])

    def total(batches):
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for part, counts in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                sums[part] = sums.get(part, 0) + np.frombuffer(counts, np.uint32).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([v.tobytes() for v in sums.values()], pa.binary())], names=["part", "counts"])

    schema, out = "part int, counts binary", np.zeros(SLOTS, np.int64)
    for r in sets.select("items").coalesce(COUNTERS).mapInArrow(count, schema).repartition(PARTS, "part").mapInArrow(total, schema).collect():
        out[r["part"] * each : (r["part"] + 1) * each] += np.frombuffer(r["counts"], np.int64)
    return out


def ranks(counts: np.ndarray) -> np.ndarray:
    """0 for slots that hold about the mean or less, else 1 and more by how much more they hold."""
    mean = counts.mean()
    over = np.maximum(counts - mean - 4 * np.sqrt(mean) - 16, 0)
    return np.ceil(np.log2(over + 1)).astype(np.uint8)


def least_shared(n: int) -> int:
    """Shingles that a text of n shares with any partner."""
    return -(-n * SIMILAR[0] // SIMILAR[1])


def needed(share: int = 16) -> np.ndarray:
    """For each band, how many of their first shingles texts of that band share with any partner, at least."""
    return np.array([min(least_shared(n), max(8, n // share)) for n in BANDS], np.int64)


def first_shingles(sets: DataFrame, rank: np.ndarray, need: np.ndarray) -> DataFrame:
    """h, at (node * STRIDE + band): the first shingles of each text (node, items)."""
    shared = sets.sparkSession.sparkContext.broadcast(rank)

    def run(batches):
        table = shared.value
        for b in batches:
            values, sizes = b.column(1).flatten().to_numpy(), b.column(1).value_lengths().to_numpy()
            order, bands = table[values & (SLOTS - 1)], np.searchsorted(BANDS, sizes, "right") - 1
            at, taken = 0, []
            for n, band in zip(sizes.tolist(), bands.tolist()):
                own, kind = values[at : at + n], order[at : at + n]
                m = n - least_shared(n) + need[band] if n else 0
                taken.append(own[:m] if not kind.any() else own[np.argsort(kind, kind="stable")[:m]])
                at += n
            where = np.repeat(b.column(0).to_numpy() * STRIDE + bands, [len(t) for t in taken])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.zeros(0, np.int64), *taken])), pa.array(where)], names=["h", "at"])

    return sets.select("node", "items").mapInArrow(run, "h long, at long")


def candidate_groups(sets: DataFrame, copies: DataFrame, rounds: int = 2) -> DataFrame:
    """node, root, lead: groups of texts (node, items) of a band that may be partners, with the least of them; none of copies (node)."""
    need = needed()
    tokens = first_shingles(sets, ranks(slot_counts(sets)), need)
    repeated = tokens.groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h")
    node = F.expr(f"at div {STRIDE}")
    found = tokens.hint("merge").join(repeated, "h").withColumn("node", node).join(copies, "node", "left_anti")
    met = materialize(found.select("h", F.explode(F.array("at", F.col("at") + 1)).alias("at")), "met")
    band = F.pmod("at", F.lit(STRIDE)).cast("int")
    # A partner may be of the band before, whose texts are sure to share fewer.
    enough = F.get(F.lit([int(need[max(i - 1, 0)]) for i in range(len(need) + 1)]), band)
    for _ in range(rounds):
        # Shingles of one text alone, or met only in texts that have no partner, don't count.
        again = met.groupBy("h", band.alias("band")).agg(F.count("*").alias("n")).where("n > 1").select("h", "band")
        less = materialize(met.withColumn("band", band).hint("merge").join(again, ["h", "band"]).select("h", "at"), "shared")
        able = less.groupBy("at").agg(F.count("*").alias("n")).where(F.col("n") >= enough).select("at")
        some = materialize(less.join(able, "at", "left_semi"), "met")
        forget(met, less)
        met = some
    band = band.alias("band")
    least = met.groupBy("h", band).agg(F.min("at").alias("x"))
    links = met.select("h", "at", band).hint("merge").join(least, ["h", "band"]).where("x <> at").select("x", F.col("at").alias("y")).distinct()
    joined = components(links)
    forget(met)
    groups = joined.unionByName(joined.select(F.col("root").alias("node"), "root").distinct())
    return groups.select(F.expr(f"node div {STRIDE}").alias("node"), "root", F.expr(f"root div {STRIDE}").alias("lead"))


def fingerprint_groups(prints: DataFrame, radius: int, segments: int | None = None) -> DataFrame:
    """node, root, lead: groups of texts (node, fp) whose fingerprints links within radius bits join, with the least of them; none of one text."""
    some = materialize(prints.select("fp").distinct(), "prints")
    found = linked(some, radius, segments).select(F.col("node").alias("fp"), "root")
    named = materialize(prints.join(found, "fp", "left").select("node", F.coalesce("root", "fp").alias("root")), "by-print")
    leads = named.groupBy("root").agg(F.min("node").alias("lead"), F.count("*").alias("n")).where("n > 1").drop("n")
    groups = materialize(named.join(leads, "root").select("node", "root", "lead"), "prints-met")
    forget(some, found, named)
    return groups


def not_joined(groups: DataFrame, found: DataFrame) -> DataFrame:
    """The groups (node, root, lead) whose texts aren't all of one component of found (node, root; without the roots)."""
    own = groups.join(found.select("node", F.col("root").alias("own")), "node", "left").select("root", F.coalesce("own", "node").alias("own"))
    apart = own.groupBy("root").agg(F.min("own").alias("a"), F.max("own").alias("b")).where("a < b").select("root")
    return groups.join(apart, "root", "left_semi")


def near_groups(docs: DataFrame, width: int = 5, dense: int = 128, radius: int = 4) -> DataFrame:
    """doc_id, rid (a number of the row), root (the group), component_id (least doc_id of the group)."""
    with small_batches(docs.sparkSession):
        named = _named_groups(docs, width, dense, radius)
    # Null ids come last, so a group has the id null only if all its rows do.
    least = materialize(named.groupBy("root").agg(F.min("doc_id").alias("component_id")), "least")
    return named.join(least, "root").select("doc_id", "rid", "root", "component_id")


def _named_groups(docs: DataFrame, width: int, dense: int, radius: int) -> DataFrame:
    """doc_id, rid, root of every row, written."""
    rows = materialize(shingle_sets(docs, width).withColumn("rid", F.monotonically_increasing_id()), "shingles")
    names, sets = rows.select("doc_id", "rid", "digest"), rows.select(F.col("rid").alias("node"), "items")
    nodes = materialize(names.groupBy("digest").agg(F.min("rid").alias("node")), "nodes")
    # Of equal sets only the first is compared.
    copies = materialize(names.join(nodes, "digest").where("rid <> node").select(F.col("rid").alias("node")), "copies")
    near = fingerprint_groups(rows.select(F.col("rid").alias("node"), "fp").join(copies, "node", "left_anti"), radius)
    alike = set_links(sets, near, *SIMILAR, dense)
    joined = components(alike)
    candidates = materialize(candidate_groups(sets, copies), "candidates")
    rest = materialize(not_joined(candidates, joined), "rest")
    sweep(docs.sparkSession)
    apart = set_links(sets, rest, *SIMILAR, dense)
    found = components(alike.unionByName(apart))
    roots = nodes.join(found, "node", "left").select("digest", F.coalesce("root", "node").alias("root"))
    named = materialize(names.join(roots, "digest").select("doc_id", "rid", "root"), "named")
    forget(rows, nodes, copies, near, alike, joined, candidates, rest, apart, found)
    return named


def drop_near_copies(docs: DataFrame, **options) -> DataFrame:
    """One row of each group stays, with its columns: one with the least doc_id. Of rows that repeat an id, one stays at most."""
    keep, many, n = spare_names(docs.columns, "keep", "many", "n")
    groups = near_groups(docs, **options)
    kept = groups.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias(keep)).distinct()
    stay = docs.join(kept, F.col("doc_id").eqNullSafe(F.col(keep)), "left_semi")
    repeats = docs.groupBy("doc_id").agg(F.count("*").alias(n)).where(F.col(n) > 1).select(F.col("doc_id").alias(many))
    if repeats.isEmpty():
        return stay
    hit = F.col("doc_id").eqNullSafe(F.col(many))
    return stay.join(repeats, hit, "left_anti").unionByName(stay.join(repeats, hit, "left_semi").dropDuplicates(["doc_id"]))
