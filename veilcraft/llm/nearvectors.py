"""Near-duplicate vectors by Euclidean p-stable hashing and exact cosine checks.

Vectors are scaled to unit length, so cosine c is Euclidean distance sqrt(2 - 2 c). A hash is floor((a . v + b) / width) with
normal a (the 2-stable distribution) and uniform b; a table's key joins ``HASHES`` of them. Two vectors at cosine 0.95 share
one hash with probability 0.83 at width 1.5, a key of 14 with 0.076, and one of 48 tables' keys with 0.977; at cosine 0.98,
where near copies usually are, the chance to miss a pair is about 1 in 70,000.

Equal vectors are one node with a weight. Keys that only one node has are dropped before any vector moves. The nodes of a
key are dealt into blocks of about ``BLOCK``; every two blocks meet in one place, where a matrix product gives all cosines in
double precision, so a bucket that holds a third of all vectors is many bounded tasks. A pair that shares several tables
counts in the first of them only. What leaves a block is a count per vector and a spanning forest of its links, never
the pairs.

Defined results: a vector that is null, empty or zero, or holds a null or non-finite component, links with nothing and is its
own component; vectors of different lengths do not link; repeated rows are different vectors that link with each other; a null
id names a component only if all its members have none.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilcraft.llm.common import mix
from veilcraft.llm.components import components
from veilcraft.session import materialize

THRESHOLD = 0.95
HASHES, TABLES, WIDTH, SEED = 14, 48, 1.5, 11
#: Nodes of a key that are compared in one place at a time.
BLOCK = 1024


def share_probability(distance: float, width: float = WIDTH) -> float:
    """The chance that two vectors at a distance share one hash."""
    r = width / distance
    tail = 0.5 * math.erfc(r / math.sqrt(2))
    return 1 - 2 * tail - 2 / (math.sqrt(2 * math.pi) * r) * (1 - math.exp(-r * r / 2))


def keys_of(units: np.ndarray, tables: int) -> np.ndarray:
    """The key of each unit vector in each table."""
    draw = np.random.Generator(np.random.PCG64([SEED, units.shape[1]]))
    lines = draw.standard_normal((units.shape[1], tables * HASHES))
    shifts = draw.uniform(0, WIDTH, tables * HASHES)
    steps = np.floor((units @ lines + shifts) / WIDTH).astype(np.int64).astype(np.uint64).reshape(len(units), tables, HASHES)
    out = np.broadcast_to(mix(np.arange(tables, dtype=np.uint64) + np.uint64(units.shape[1] << 20)), steps.shape[:2])
    for n in range(HASHES):
        out = mix(out + steps[:, :, n])
    return out.view(np.int64)


def hashed_nodes(nodes: DataFrame, tables: int) -> DataFrame:
    """(node, weight, least, unit, keys) of the vectors that can link; unit and keys are packed numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = batch.column("vector").to_pylist()
            unit: list[bytes | None] = [None] * len(vectors)
            keys: list[bytes | None] = [None] * len(vectors)
            for length in {len(v) for v in vectors}:
                rows = [i for i, v in enumerate(vectors) if len(v) == length and None not in v]
                matrix = np.array([vectors[i] for i in rows], float).reshape(len(rows), length)
                largest = np.abs(matrix).max(axis=1, initial=0)
                good = np.isfinite(largest) & (largest > 0)
                matrix = matrix[good] / largest[good, None]  # so that squares neither overflow nor vanish
                matrix /= np.sqrt((matrix * matrix).sum(axis=1))[:, None]
                for i, vector, key in zip(np.array(rows, int)[good], matrix, keys_of(matrix, tables) if len(matrix) else ()):
                    unit[i], keys[i] = vector.tobytes(), key.tobytes()
            packed = [pa.array(unit, pa.binary()), pa.array(keys, pa.binary()), pa.array([None if k is None else np.frombuffer(k, np.int64) for k in keys], pa.list_(pa.int64()))]
            out = pa.RecordBatch.from_arrays(
                [batch.column("node"), batch.column("weight"), *packed], ["node", "weight", "unit", "packed_keys", "keys"]
            )
            yield out.filter(pa.array([u is not None for u in unit]))

    return nodes.select("node", "weight", "vector").mapInArrow(run, "node long, weight long, unit binary, packed_keys binary, keys array<long>")


def linked(units: np.ndarray, keys: np.ndarray, table: int, left: np.ndarray, right: np.ndarray, threshold: float) -> np.ndarray:
    """Which rows ``left`` link with which rows ``right``, counting pairs whose first common table is this one."""
    near = units[left] @ units[right].T >= threshold
    rows, columns = np.nonzero(near)
    earlier = (keys[left[rows], :table] == keys[right[columns], :table]).any(axis=1)
    near[rows[earlier], columns[earlier]] = False
    return near


def compare(group: pa.Table, tables: int, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(node, links) and forest edges (a, b) among the rows of two blocks, or of one with itself."""
    nodes, weight = group["node"].to_numpy(), group["weight"].to_numpy()
    units = np.frombuffer(b"".join(group["unit"].to_pylist()), float).reshape(len(nodes), -1)
    keys = np.frombuffer(b"".join(group["packed_keys"].to_pylist()), np.int64).reshape(len(nodes), tables)
    table, low, high = group["table"][0].as_py(), group["low"][0].as_py(), group["high"][0].as_py()
    block = group["block"].to_numpy()
    left, right = np.flatnonzero(block == low), np.flatnonzero(block == high)
    near = linked(units, keys, table, left, right, threshold)
    if low == high:
        np.fill_diagonal(near, False)
    links = np.zeros(len(nodes), np.int64)
    links[left] += near @ weight[right]
    if low != high:
        links[right] += near.T @ weight[left]
    # a spanning forest by breadth first search over the link matrix
    a, b, seen = [], [], np.zeros(len(nodes), bool)
    place = np.full(len(nodes), -1)
    place[left] = np.arange(len(left))
    other = np.full(len(nodes), -1)
    other[right] = np.arange(len(right))
    for start in np.flatnonzero(links):
        if seen[start]:
            continue
        seen[start], waiting = True, [start]
        while waiting:
            at = waiting.pop()
            found = right[near[place[at]]] if place[at] >= 0 else left[near[:, other[at]]]
            fresh = found[~seen[found]]
            seen[fresh] = True
            waiting += fresh.tolist()
            a += [nodes[at]] * len(fresh)
            b += nodes[fresh].tolist()
    some = links > 0
    return nodes[some], links[some], np.array(a, np.int64), np.array(b, np.int64)


def compared(members: DataFrame, tables: int, threshold: float) -> DataFrame:
    """Link counts (node, links) and forest edges (a, b) of all blocks, from rows that come block by block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None

        def told(rows: pa.Table, last: bool) -> tuple[list, pa.Table | None]:
            marks = np.column_stack([rows[name].to_numpy() for name in ("key", "low", "high")])
            cuts = np.flatnonzero((marks[1:] != marks[:-1]).any(axis=1)) + 1
            edges = [0, *cuts.tolist(), *([rows.num_rows] if last else [])]
            found = [compare(rows.slice(i, j - i), tables, threshold) for i, j in zip(edges, edges[1:])]
            return found, None if last else rows.slice(edges[-1])

        def packed(found: list) -> Iterator[pa.RecordBatch]:
            nodes, links, a, b = (np.concatenate([f[i] for f in found]) if found else np.zeros(0, np.int64) for i in range(4))
            nulls = pa.nulls(len(a), pa.int64()), pa.nulls(len(nodes), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(links), nulls[1], nulls[1]], ["node", "links", "a", "b"])
            yield pa.RecordBatch.from_arrays([nulls[0], nulls[0], pa.array(a), pa.array(b)], ["node", "links", "a", "b"])

        for batch in batches:
            rows = pa.Table.from_batches([batch])
            found, held = told(rows if held is None else pa.concat_tables([held, rows]).combine_chunks(), False)
            yield from packed(found)
        if held is not None and held.num_rows:
            yield from packed(told(held, True)[0])

    return members.mapInArrow(run, "node long, links long, a long, b long")


def near_vectors(
    vectors: DataFrame, threshold: float = THRESHOLD, tables: int = TABLES, id_column: str = "vec_id", vector_column: str = "embedding"
) -> DataFrame:
    """vec_id, n_links, component_id (the least id reachable by links) and kept (whether that is its own) of every vector."""
    rows = vectors.select(F.col(id_column).alias("vec_id"), F.col(vector_column).cast("array<double>").alias("vector"))
    rows = rows.withColumn("node", F.xxhash64("vector"))
    grouped = rows.where("size(vector) > 0").groupBy("node").agg(F.first("vector").alias("vector"), F.count("*").alias("weight"), F.min("vec_id").alias("least"))
    grouped = materialize(grouped, "vector-nodes")
    hashed = materialize(hashed_nodes(grouped, tables), "vector-keys")
    partitions = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = hashed.select("node", F.posexplode("keys").alias("table", "key"))
    shared = keys.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
    dealt = keys.join(shared, "key").withColumn("block", F.pmod(F.xxhash64("node", "table"), F.col("blocks")).cast("int"))
    met = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    met = met.select("node", "table", "key", "block", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"))
    filled = met.join(hashed.select("node", "weight", "unit", "packed_keys"), "node")
    sorted_blocks = filled.repartition(4 * partitions, "key", "low", "high").sortWithinPartitions("key", "low", "high")
    found = materialize(compared(sorted_blocks, tables, threshold), "vector-links")
    counts = found.where("node is not null").groupBy("node").agg(F.sum("links").alias("links"))
    parts = components(found.where("a is not null").select("a", "b"))
    labelled = hashed.select("node").join(grouped.select("node", "weight", "least"), "node").join(parts, "node", "left")
    labelled = materialize(labelled.withColumn("component", F.coalesce("component", "node")).join(counts, "node", "left"), "vector-classes")
    least = labelled.groupBy("component").agg(F.min("least").alias("component_id"))
    named = labelled.join(least, "component").select("node", (F.col("weight") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), "component_id")
    told = rows.select("vec_id", "node").join(named.withColumn("known", F.lit(True)), "node", "left")
    component = F.when(F.col("known"), F.col("component_id")).otherwise(F.col("vec_id"))
    return told.select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept")
    )
