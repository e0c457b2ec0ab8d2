"""Operator 8, SimHash near-dedup by multi-index hashing.

Fingerprints have 64 bits; a bit is 1 if it is set in over half the shingle hashes. Equal
fingerprints are one node. Fingerprints within `radius` bits are found so: cut into
segments with a ball for each (see layout), two of them lie within the ball of some segment.
Each fingerprint is filed under its parts, and looks up the small Hamming ball of each part;
of two different parts only the larger looks the smaller up. Candidates are then verified
over all 64 bits.

A list with over `dense` members isn't paired: see denselinks. Its least member is linked
to all within the radius, only the others are compared with the list, in blocks that each
give back a spanning forest: all links are respected, no pairs are made, there is no cap.

Texts with no words have fingerprint zero, linked like others. Null text counts as empty.
Repeated rows share a component. An empty table gives no rows.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import forget, materialize
from .components import components
from .denselinks import dense_links

BLOCK = 1 << 14


def shingle_hashes(text: str, width: int):
    """XXH64 (seed 42) of all word shingles in order, in blocks; a text of fewer words is one shingle, one without words has none."""
    words = text.encode().lower().split()
    if not words:
        return
    joined = b" ".join(words)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    starts = ends - sizes
    n, digest = max(1, len(words) - width + 1), xxhash.xxh64_intdigest
    ends = ends[min(width, len(words)) - 1 :]
    for a in range(0, n, BLOCK):
        spans = zip(starts[a : min(n, a + BLOCK)].tolist(), ends[a : min(n, a + BLOCK)].tolist())
        yield np.array([digest(joined[s:e], 42) for s, e in spans], np.uint64)


def fold(blocks) -> int:
    """The 64-bit SimHash of hashes (unsigned), given in blocks: a bit is 1 if it is set in over half of them."""
    total, n = np.zeros(64, np.int64), 0
    for h in blocks:
        total += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
        n += len(h)
    return int(np.packbits((2 * total > n).astype(np.uint8), bitorder="little").view(np.uint64)[0])


def fingerprint(text: str, width: int) -> int:
    """The 64-bit SimHash of a text's word shingles."""
    return fold(shingle_hashes(text, width))


def fingerprints(docs: DataFrame, width: int = 4) -> DataFrame:
    """doc_id, fp (the 64 bits as a signed long) of every row."""
    schema = T.StructType([docs.schema["doc_id"], T.StructField("fp", T.LongType())])

    def run(batches):
        for b in batches:
            fps = np.array([fingerprint(t or "", width) for t in b.column(1).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps)], names=schema.fieldNames())

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def layout(radius: int, segments: int) -> list[tuple[int, int, int]]:
    """(shift, width, ball) of the segments of 64 bits.

    If each segment i differed in more than ball_i bits, the whole would in at least the sum
    of ball_i + 1; so balls that sum to radius - segments + 1 are enough. Segments with a
    larger ball are made wider, which keeps the lists of all about equally short.
    """
    spare = radius - segments + 1
    if spare < 0:
        raise ValueError("more segments than differing bits")
    balls = [spare // segments + (i < spare % segments) for i in range(segments)]
    if max(balls) > 2:
        raise ValueError("too few segments: balls of over 2 bits")
    widths = [int(64 / segments + 5 * (b - spare / segments)) for b in balls]
    widths[0] += 64 - sum(widths)
    return [(sum(widths[:i]), w, b) for i, (w, b) in enumerate(zip(widths, balls))]


def filed(nodes: DataFrame, radius: int, segments: int) -> DataFrame:
    """key, fp, home: every fingerprint at its own parts (home) and at the parts that it looks up."""
    rows = []
    for s, (shift, width, ball) in enumerate(layout(radius, segments)):
        part = F.shiftrightunsigned("fp", shift).bitwiseAND(F.lit((1 << width) - 1))
        rows.append(nodes.select("fp", F.lit(s).alias("seg"), part.alias("part"), F.lit(True).alias("home")))
        # Of two parts that differ in a few bits, the larger number looks the smaller up.
        flips = [sum(1 << i for i in c) for k in range(1, ball + 1) for c in combinations(range(width), k)]
        if flips:
            near = F.transform(F.filter(F.array(*[F.lit(v).cast("long") for v in flips]), _smaller(part)), _flip(part))
            rows.append(nodes.select("fp", F.lit(s).alias("seg"), F.explode(near).alias("part"), F.lit(False).alias("home")))
    lists = rows[0]
    for more in rows[1:]:
        lists = lists.unionByName(more)
    return lists.select("fp", "home", F.col("part").bitwiseOR(F.shiftleft(F.col("seg").cast("long"), 40)).alias("key"))


def _smaller(part: Column):
    return lambda v: part.bitwiseXOR(v) < part


def _flip(part: Column):
    return lambda v: part.bitwiseXOR(v)


def meetings(nodes: DataFrame, radius: int, segments: int) -> DataFrame:
    """key, fp, home, n (length of the list): the lists in which fingerprints may meet, written."""
    lists = filed(nodes, radius, segments)
    sizes = lists.groupBy("key").agg(F.count("*").alias("n"), F.count_if("home").alias("homes")).where("homes > 0 and n > 1")
    # The lists come from a small table but aren't small: never to be broadcast.
    return materialize(lists.hint("merge").join(sizes, "key").select("key", "fp", "home", "n"), "lists")


def links_of(met: DataFrame, radius: int, dense: int) -> DataFrame:
    """x, y: pairs of distinct fingerprints within radius bits in lists (see meetings), for long lists only those that join them."""
    groups = met.where(F.col("n") <= dense).groupBy("key").agg(F.collect_list(F.struct("fp", "home")).alias("g"))

    def verified(q: Column) -> Column:
        ok = lambda t: t["home"] & (t["fp"] != q["fp"]) & (~q["home"] | (q["fp"] < t["fp"])) & (F.bit_count(t["fp"].bitwiseXOR(q["fp"])) <= radius)
        return F.transform(F.filter("g", ok), lambda t: F.struct(q["fp"].alias("x"), t["fp"].alias("y")))

    near = groups.select(F.explode(F.flatten(F.transform("g", verified))).alias("p")).select("p.x", "p.y")
    hot = materialize(met.where(F.col("n") > dense).select("key", F.col("fp").alias("node"), F.array("fp").alias("fp")).distinct(), "hot")
    return near.unionByName(dense_links(hot, radius, 1)).distinct()


def near_links(nodes: DataFrame, radius: int = 4, segments: int = 3, dense: int = 256) -> DataFrame:
    """x, y: pairs of distinct fingerprints within radius bits, for long lists only those that join them."""
    return links_of(meetings(nodes, radius, segments), radius, dense)


def linked(nodes: DataFrame, radius: int = 4, segments: int | None = None, dense: int = 256) -> DataFrame:
    """node, root (the smallest reachable) of distinct fingerprints (fp) that links within radius bits join, but of the roots."""
    segments = segments or (3 if nodes.count() < 1 << 25 else 2)  # same links either way; wider parts keep lists short
    met = meetings(nodes, radius, segments)
    found = components(links_of(met, radius, dense))
    forget(met)
    return found


def simhash_groups(docs: DataFrame, width: int = 4, radius: int = 4, segments: int | None = None, dense: int = 256) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (the smallest doc_id reachable) of every row."""
    rows = materialize(fingerprints(docs, width), "fingerprints")
    nodes = materialize(rows.select("fp").distinct(), "nodes")
    found = linked(nodes, radius, segments, dense)
    roots = materialize(nodes.join(found, nodes["fp"] == found["node"], "left").select("fp", F.coalesce("root", "fp").alias("root")), "roots")
    named = rows.join(roots, "fp")
    least = materialize(named.groupBy("root").agg(F.min("doc_id").alias("component_id")), "least")
    return named.join(least, "root").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
