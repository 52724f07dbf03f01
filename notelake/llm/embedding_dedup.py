"""Operator 6: embedding near-duplicates. Tiles in the order of principal components, compared leading dimensions first."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_table, map_groups
from .components import components, id_of, name_of
from .simhash import spanning

TILE = 512  # vectors on either side of a comparison, at most
SLACK = 1e-9  # rounding of the partial sums; links themselves are decided without it


def principal_axes(vectors: DataFrame) -> dict[int, np.ndarray]:
    """An orthonormal basis, leading component first, for the commonest vector length. Each task sends a row of sums for each dimension; d * (d + 1) sums reach the driver."""
    top = vectors.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").first()
    if top is None or top.d > 2048:
        return {}
    d = top.d

    def partial(batches):
        import pyarrow as pa

        total = np.zeros((d + 1, d))
        for b in batches:
            x = np.array(b.column(0).to_pylist(), float)
            if len(x):
                x /= np.abs(x).max(1, keepdims=True)
                x /= np.sqrt((x * x).sum(1, keepdims=True))
                total[:d] += x.T @ x
                total[d] += x.sum(0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(d + 1, dtype=np.int64)), pa.array([x.tobytes() for x in total], pa.binary())], ["i", "x"])

    def add(batches):
        import pyarrow as pa

        held: dict[int, np.ndarray] = {}
        for b in batches:
            for i, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                held[i] = held.get(i, 0) + np.frombuffer(x)
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int64()), pa.array([x.tobytes() for x in held.values()], pa.binary())], ["i", "x"])

    got = vectors.where(F.size("v") == d).select("v").mapInArrow(partial, "i long, x binary").repartition("i").mapInArrow(add, "i long, x binary").collect()
    total = np.zeros((d + 1, d))
    for r in got:
        total[r.i] = np.frombuffer(r.x)
    mean = total[d] / max(top.n, 1)
    _, axes = np.linalg.eigh(total[:d] / max(top.n, 1) - np.outer(mean, mean))
    return {d: np.ascontiguousarray(axes[:, ::-1])}


def close_pairs(a: np.ndarray, b: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Index arrays of the pairs of unit rows whose product may reach the threshold.

    Products are summed block by block of dimensions; the rest of a product is at most the product of the rows' suffix
    norms. A row or column without any pair left is dropped, and when few pairs are left they go on one by one.
    """
    d = a.shape[1]
    rows, cols = np.arange(len(a)), np.arange(len(b))
    edges = [x for x in (4, 8, 16, 32, 64, 128, 256, 512, 1024) if x < d] + [d]
    suffix = lambda x: np.sqrt(np.maximum(np.cumsum((x * x)[:, ::-1], 1)[:, ::-1], 0))
    sa, sb = suffix(a), suffix(b)
    part, start = np.zeros((len(a), len(b))), 0
    for end in edges:
        part = part + a[np.ix_(rows, range(start, end))] @ b[np.ix_(cols, range(start, end))].T
        rest = 0 if end == d else np.outer(sa[rows, end], sb[cols, end])
        alive = part + rest >= threshold - SLACK
        if end == d or alive.sum() <= 0.02 * alive.size:
            i, j = np.nonzero(alive)
            i, j, sums = rows[i], cols[j], part[i, j]
            while end < d and len(i):
                start, end = end, min(end * 2, d)
                sums = sums + np.einsum("ij,ij->i", a[i, start:end], b[j, start:end])
                ok = sums + (sa[i, end] * sb[j, end] if end < d else 0) >= threshold - SLACK
                i, j, sums = i[ok], j[ok], sums[ok]
            return i, j
        r, c = alive.any(1), alive.any(0)
        rows, cols, part, start = rows[r], cols[c], part[np.ix_(r, c)], end
    return np.zeros(0, int), np.zeros(0, int)


def cosine_duplicates(vectors: DataFrame, threshold: float = 0.95, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """Per row: (id, n_links, component_id, kept).

    Vectors link when their labels are equal and not null, their lengths agree, and their cosine in double precision
    reaches the threshold. Null vectors, those without a norm, and those with a null or non-finite component link with
    nothing, but keep their row. Equal vectors are gathered first and count with their number, so copies are never paired;
    what is left is dealt by label and position along the first principal axis (unit vectors further apart than
    sqrt(2 - 2 * threshold) there cannot link) in tiles of at most TILE vectors. Repeated rows count as vectors of their own;
    null ids are never the smallest; an empty table gives an empty result; other columns are not read.
    """
    v = F.col("v")
    base = vectors.select(F.col(id_col).alias("id"), F.transform(F.col(vec_col).cast("array<double>"), lambda x: x + 0.0).alias("v"), F.col(label_col).alias("label"))  # -0.0 becomes 0.0: they group alike, but not their JSON
    good = F.coalesce(F.col("label").isNotNull() & (F.size("v") > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0), F.lit(False))
    # scaled by the largest component: squares neither overflow nor vanish, and cosines stay the same
    valid = base.where(good).withColumn("k", F.hex(F.md5(F.to_json(F.struct("v")).cast("binary"))))
    distinct = valid.groupBy("label", "v").agg(F.min("id").alias("node"), F.count("*").alias("n"), F.first("k").alias("k"))
    distinct = as_table(distinct.withColumn("named", name_of(F.col("node"), dict(base.dtypes)["id"], F.md5(F.concat_ws("|", F.col("label").cast("string"), "k").cast("binary")))), "distinct")
    axes = principal_axes(distinct.select("v"))
    width = math.sqrt(max(2 - 2 * threshold, 0)) + 1e-6
    label_type, id_type = dict(base.dtypes)["label"], dict(base.dtypes)["id"]

    def place(batches):
        import pyarrow as pa

        for b in batches:
            cols = {n: b.column(i) for i, n in enumerate(b.schema.names)}
            vs = [np.array(x) for x in cols["v"].to_pylist()]
            unit = [x / m / math.sqrt(((x / m) ** 2).sum()) for x in vs for m in [np.abs(x).max()]]
            lead = [float(x @ axes[len(x)][:, 0]) if len(x) in axes else float(x[0]) for x in unit]
            yield pa.RecordBatch.from_arrays([cols["label"], cols["named"], cols["k"], cols["n"], pa.array([len(x) for x in vs], pa.int32()), pa.array([math.floor(x / width) for x in lead], pa.int32()), pa.array([x.tobytes() for x in vs], pa.binary())], ["label", "named", "k", "n", "d", "cell", "raw"])

    placed = as_table(distinct.select("label", "k", "n", "v", "named").mapInArrow(place, f"label {label_type}, named string, k string, n long, d int, cell int, raw binary"), "vectors")
    sizes = placed.groupBy("label", "d", "cell").agg(F.ceil(F.count("*") / TILE).cast("int").alias("tiles"))
    # how many tiles there are in a vector's own cell and in the two beside it
    beside = sizes.select("label", "d", F.explode(F.array(*[F.struct((F.col("cell") + s).alias("cell"), F.lit(s).alias("s"), "tiles") for s in (-1, 0, 1)])).alias("x")).select("label", "d", "x.*")
    beside = beside.groupBy("label", "d", "cell").agg(*[F.coalesce(F.max(F.when(F.col("s") == s, F.col("tiles"))), F.lit(0)).alias(name) for s, name in ((1, "below"), (0, "own"), (-1, "above"))]).where("own > 0")
    dealt = placed.join(beside, ["label", "d", "cell"]).withColumn("tile", F.pmod(F.xxhash64("k"), "own").cast("int"))
    none = F.array().cast("array<struct<c1:int,t1:int,c2:int,t2:int>>")
    pair = lambda c1, t1, c2, t2: F.struct(c1.cast("int").alias("c1"), t1.cast("int").alias("t1"), c2.cast("int").alias("c2"), t2.cast("int").alias("t2"))
    cell, tile = F.col("cell"), F.col("tile")
    to = lambda count, f: F.when(F.col(count) > 0, F.transform(F.sequence(F.lit(0), F.col(count) - 1), f)).otherwise(none)
    dealt = dealt.withColumn("g", F.explode(F.concat(to("own", lambda t: pair(cell, F.least(tile, t), cell, F.greatest(tile, t))), to("above", lambda t: pair(cell, tile, cell + 1, t)), to("below", lambda t: pair(cell - 1, t, cell, tile))))).select("label", "d", "g.*", "k", "named", "n", "raw", "cell", "tile")

    def compare(key, rows):
        label, d, c1, t1, c2, t2 = key
        raw = np.frombuffer(b"".join(rows["raw"]), float).reshape(-1, d)
        scaled = raw / np.abs(raw).max(1, keepdims=True)
        norm = np.sqrt((scaled * scaled).sum(1))
        unit = scaled / norm[:, None]
        if d in axes:
            unit = unit @ axes[d]
        n = np.array(rows["n"])
        k = rows["k"]
        same = (c1, t1) == (c2, t2)
        left = np.array([(c, t) == (c1, t1) for c, t in zip(rows["cell"], rows["tile"], strict=True)])
        a, b = (np.arange(len(k)),) * 2 if same else (np.flatnonzero(left), np.flatnonzero(~left))
        if not len(a) or not len(b):
            return
        i, j = close_pairs(unit[a], unit[b], threshold)
        i, j = a[i], b[j]
        if same:
            i, j = i[i < j], j[i < j]
        exact = np.einsum("ij,ij->i", scaled[i], scaled[j]) / (norm[i] * norm[j]) >= threshold
        i, j = i[exact], j[exact]
        links = np.bincount(i, n[j], len(k)) + np.bincount(j, n[i], len(k))
        root = spanning(len(k), i, j)
        for x in np.flatnonzero(links):
            yield label, k[x], rows["named"][x], rows["named"][root[x]], int(links[x])

    linked = as_table(map_groups(dealt, ["label", "d", "c1", "t1", "c2", "t2"], compare, f"label {label_type}, k string, a string, b string, links long"), "vector-links")
    counts = linked.groupBy("label", "k").agg(F.sum("links").alias("links"))
    roots = components(linked, "a", "b").select(F.col("node").alias("named"), "root")
    nodes = distinct.select("label", "k", "node", "n", "named").join(counts, ["label", "k"], "left").join(roots, "named", "left")
    nodes = nodes.select("label", "k", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.when(F.col("root").isNotNull(), id_of("root", id_type)).otherwise(F.col("node")).alias("component_id"))
    some = valid.select("id", "label", "k").join(nodes, ["label", "k"]).select("id", "n_links", "component_id")
    rest = base.where(~good).select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    out = some.unionByName(rest)
    return out.select(F.col("id").alias(id_col), "n_links", F.col("component_id").cast(id_type).alias("component_id"), F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)).alias("kept"))
