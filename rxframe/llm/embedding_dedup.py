"""Near-duplicate vectors by sorted projection passes.

1. Vectors are compared only inside a label and a dimension. Equal vectors are one class with a count.
2. The number of passes of a label is planned from its rows and from a sample of them (``needed``), so that a pair
   exactly at the threshold is missed with a chance of ``MISS`` or less; ``passes`` is the least number.
3. Labels of every size go this way; one with no more rows than a window holds is compared whole by it. A label for which
   no number of passes up to ``MOST`` can be planned, as in a narrow cone, is compared whole, tile against tile, and so are
   labels of up to ``whole`` rows if the caller asks for that.
4. In each pass a vector gets ``BITS`` signs of random projections, taken from the middle of its label, as one long
   number. Vectors are range-sorted by (label, dimension, pass, number), so close vectors stand close together, and
   each is compared with the next ``window`` in order. Where a partition ends, its last rows meet the first of the next
   one in a second, small step. Confirmed pairs leave a task as a forest, one link a vector, and passes are united.
   The middle only moves the signs; the check is the cosine of the vectors themselves.
5. The number of links of a vector is counted inside its component, tile against tile of bounded size, without
   writing pairs; a component of any size is spread over many tasks.

In a label with passes a pair is missed only if no pass brings it, or a chain of links around it, into a window. The
plan sees crowds of about one in ``SAMPLE`` rows of a label and more. Recall is measured in the tests.

Defined cases: a null label, a null or zero vector and one with null or non-finite components link with nothing; a
vector without id links with nothing; rows that repeat id, label and vector count each.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rxframe.llm.common import column
from rxframe.llm.components import components
from rxframe.session import settle

THRESHOLD = 0.93
PASSES = 16
BITS = 62
WINDOW = 64
BLOCK = 4096
TILE = 1024
BUNDLE_ROWS = 2000
MISS = 0.01
MOST = 4096
SAMPLE = 4096
PROBES = 256
SEED = 77


def unit(rows) -> np.ndarray:
    x = np.array(rows, dtype="f8").reshape(len(rows), -1)
    # Scaling first keeps squares of very large and very small components finite.
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def roots(n: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The smallest position reachable from each of ``n`` positions."""
    up = np.arange(n)
    while len(left):
        low = np.minimum(up[left], up[right])
        np.minimum.at(up, up[left], low)
        np.minimum.at(up, up[right], low)
        while (up[up] != up).any():
            up = up[up]
        apart = up[left] != up[right]
        left, right = left[apart], right[apart]
    return up


def near(x: np.ndarray, group: np.ndarray, window: int, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Positions of pairs at most ``window`` apart, of one group, with a cosine of ``threshold`` or more."""
    left, right = [], []
    for step in range(1, min(window, len(x) - 1) + 1):
        close = np.flatnonzero((np.einsum("ij,ij->i", x[:-step], x[step:]) >= threshold) & (group[:-step] == group[step:]))
        left.append(close)
        right.append(close + step)
    return (np.concatenate(left), np.concatenate(right)) if left else (np.array([], int), np.array([], int))


def _forest(ids: np.ndarray, x: np.ndarray, group: np.ndarray, window: int, threshold: float):
    left, right = near(x, group, window, threshold)
    up = roots(len(x), left, right)
    moved = np.flatnonzero(up != np.arange(len(x)))
    return ids[up[moved]], ids[moved]


def _batches(batch):
    """Runs of one dimension in a batch: id, group (label, dimension, pass) and unit vectors."""
    ids = batch.column("id").to_numpy()
    group = np.array(list(zip(*(batch.column(k).to_pylist() for k in ("label", "dim", "pass")), strict=True)), dtype="i8").reshape(len(ids), 3)
    vectors = batch.column("vector").to_pylist()
    cuts = np.flatnonzero(np.diff(group[:, 1])) + 1
    for part in np.split(np.arange(len(ids)), cuts):
        if len(part):
            yield ids[part], group[part], unit([vectors[i] for i in part])


def classes(vectors: DataFrame, ident: str, vector: str, label: str) -> DataFrame:
    """``id`` (smallest), ``label``, ``vector``, ``dim`` and ``copies`` of the vectors that can link."""
    rows = vectors.select(column(vectors, ident, "long").alias("id"), column(vectors, label, "long").alias("label"), column(vectors, vector, "array<double>").alias("vector"))
    whole = F.forall("vector", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    rows = rows.filter(F.col("id").isNotNull() & F.col("label").isNotNull() & whole & F.exists("vector", lambda v: v != 0))
    return rows.groupBy("label", "vector").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("copies")).select(
        "id", "label", F.size("vector").alias("dim"), "copies", "vector"
    )


def needed(sample: np.ndarray, rows: int, threshold: float, window: int, bits: int = BITS) -> tuple[float, np.ndarray]:
    """Passes after which a pair at ``threshold`` in a label of ``rows`` is missed with a chance of ``MISS``, and the
    middle of the label, from a ``sample`` of its unit vectors.

    A pass finds a pair that agrees in as many leading signs as leave no more than ``window`` rows with the same signs.
    That many rows are expected from the angles between a probe and the sample; rows linked with the probe do not
    count, since reaching any of them is enough. Infinite if ``bits`` signs leave more, or beyond ``MOST`` passes.
    """
    middle = sample.mean(axis=0)
    moved = sample - middle
    norm = np.maximum(np.linalg.norm(moved, axis=1), 1e-12)
    moved = moved / norm[:, None]
    n = min(PROBES, len(sample))
    agree = lambda cosine: 1 - np.arccos(np.clip(cosine, -1, 1)) / np.pi
    apart = sample[:n] @ sample.T < threshold
    same = np.where(apart, agree(moved[:n] @ moved.T), 0.0)
    crowd, signs, left = apart.astype("f8"), np.full(n, np.inf), np.arange(n)
    for k in range(bits + 1):
        few = crowd[left].sum(axis=1) * rows / len(sample) <= window
        signs[left[few]] = k
        left = left[~few]
        crowd[left] *= same[left]
    # Two unit vectors at the threshold keep their distance when both are moved.
    found = agree(1 - (1 - threshold) / norm[:n] ** 2) ** signs
    missed = lambda count: ((1 - found) ** count).mean()
    low, high = 0, 1
    while missed(high) > MISS:
        low, high = high, 2 * high
        if high > MOST:
            return np.inf, middle
    while high - low > 1:
        mid = (low + high) // 2
        low, high = (mid, high) if missed(mid) > MISS else (low, mid)
    return float(high), middle


def planned(known: DataFrame, threshold: float, passes: int, window: int, whole: int = 0) -> DataFrame:
    """``label``, ``dim``, ``tiles``, ``passes`` (null: compare all pairs) and ``middle`` of every label."""
    sizes = settle(known.groupBy("label", "dim").agg(F.count(F.lit(1)).alias("rows")), "sizes")
    large = sizes.filter(F.col("rows") > whole)
    names = {"label": "_label", "dim": "_dim"}
    here = (F.col("label") == F.col("_label")) & (F.col("dim") == F.col("_dim"))
    share = F.pmod(F.xxhash64(F.lit("sample"), "id"), F.lit(1 << 40)) < F.lit(SAMPLE * float(1 << 40)) / F.col("rows")
    sample = known.join(large.withColumnsRenamed(names), here).filter(share).select("label", "dim", "rows", "vector")

    def plan(part: pd.DataFrame) -> pd.DataFrame:
        rows = int(part["rows"].iat[0])
        count, middle = needed(unit(list(part["vector"])), rows, threshold, window)
        count = max(passes, count)
        return pd.DataFrame({"_label": part["label"].iloc[:1], "_dim": part["dim"].iloc[:1], "passes": [int(count) if np.isfinite(count) else None], "middle": [middle.tolist()]})

    plans = sample.groupBy("label", "dim").applyInPandas(plan, "_label long, _dim int, passes int, middle array<double>")
    tiles = F.ceil(F.col("rows") / TILE).cast("int").alias("tiles")
    if large.isEmpty():
        return sizes.select("label", "dim", tiles, F.lit(None).cast("int").alias("passes"), F.lit(None).cast("array<double>").alias("middle"))
    return settle(sizes.join(plans, here, "left").select("label", "dim", tiles, "passes", "middle"), "plans")


def tiled(rows: DataFrame, keys: list[str]):
    """``rows``, with the number of ``tiles`` of their group (``keys``), grouped into pairs of tiles (``i``, ``j``)."""
    tile = F.pmod(F.xxhash64("id"), F.col("tiles")).cast("int")
    # Tile t meets every tile: as the left one those not before it, as the right one those before.
    rows = rows.withColumn("tile", tile).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    rows = rows.withColumn("i", F.least("tile", "other")).withColumn("j", F.greatest("tile", "other"))
    bundles = max(1, -(-rows.filter("other = 0").count() // BUNDLE_ROWS))
    # Groups of one tile share tasks; each larger tile pair has its own group.
    bundle = F.when(F.col("tiles") == 1, F.pmod(F.xxhash64(*keys), F.lit(bundles))).otherwise(F.lit(-1))
    alone = [F.when(F.col("tiles") > 1, F.col(k)).alias(f"alone_{k}") for k in keys]
    return rows.groupBy(bundle.alias("bundle"), *alone, "i", "j")


def all_links(known: DataFrame, threshold: float) -> DataFrame:
    """Links (``a``, ``b``) that connect what all pairs of a label confirm; ``known`` has the ``tiles`` of the label."""

    def compare(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["label", "dim"], kind="stable")
        ids, vectors, tiles = rows["id"].to_numpy("i8"), rows["vector"].tolist(), rows["tile"].to_numpy()
        edges = np.flatnonzero(np.r_[True, (np.diff(rows[["label", "dim"]].to_numpy("i8"), axis=0) != 0).any(axis=1), True])
        i, j = rows["i"].iat[0], rows["j"].iat[0]
        out = []
        for start, stop in zip(edges[:-1], edges[1:], strict=True):
            x, tile = unit(vectors[start:stop]), tiles[start:stop]
            left, right = np.flatnonzero(tile == i), np.flatnonzero(tile == j)
            a, b = np.nonzero(x[left] @ x[right].T >= threshold)
            up = roots(stop - start, left[a], right[b])
            moved = np.flatnonzero(up != np.arange(len(up)))
            out.append(pd.DataFrame({"a": ids[start:stop][up[moved]], "b": ids[start:stop][moved]}))
        return pd.concat(out)

    rows = known.select("id", "label", "dim", "vector", "tiles")
    return tiled(rows, ["label", "dim"]).applyInPandas(compare, "a long, b long")


def pass_links(known: DataFrame, threshold: float, window: int, bits: int = BITS) -> DataFrame:
    """Links (``a``, ``b``) that connect what the windows of all ``passes`` of a label confirm."""
    schema = "label long, dim int, pass int, number long, id long, vector array<double>"

    def project(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            vectors, middles = batch.column("vector").to_pylist(), batch.column("middle").to_pylist()
            dims, counts = batch.column("dim").to_numpy(), batch.column("passes").to_numpy()
            places = [np.flatnonzero(dims == dim) for dim in np.unique(dims)]
            moved = [unit([vectors[i] for i in at]) - np.array([middles[i] for i in at], dtype="f8") for at in places]
            for p in range(counts.max()):
                numbers = np.empty(batch.num_rows, dtype="i8")
                for at, x in zip(places, moved, strict=True):
                    planes = np.random.default_rng([SEED, x.shape[1], p]).standard_normal((x.shape[1], bits))
                    numbers[at] = (x @ planes >= 0) @ (1 << np.arange(bits - 1, -1, -1, dtype="i8"))
                rows = pa.RecordBatch.from_arrays(
                    [batch.column("label"), batch.column("dim"), pa.array([p] * batch.num_rows, pa.int32()), pa.array(numbers), batch.column("id"), batch.column("vector")],
                    ["label", "dim", "pass", "number", "id", "vector"],
                )
                yield rows.filter(pa.array(counts > p))

    def compare(batches):
        """Links of this partition, and its first and last rows for the seams to its neighbours."""
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        kinds = [("a", pa.int64()), ("b", pa.int64()), ("seam", pa.int64()), ("place", pa.int32()), ("label", pa.int64()), ("dim", pa.int32()), ("pass", pa.int32()), ("vector", pa.list_(pa.float64()))]

        def rows(**given):
            n = len(next(iter(given.values())))
            return pa.RecordBatch.from_arrays([pa.array(given[k], t) if k in given else pa.nulls(n, t) for k, t in kinds], [k for k, _ in kinds])

        def seam(number, where, ids, group, x):
            return rows(b=ids, seam=[number] * len(ids), place=np.arange(len(ids)) + where, label=group[:, 0], dim=group[:, 1], **{"pass": group[:, 2]}, vector=list(x))

        kept = None  # the last rows seen, carried into the next run of rows
        first = True
        for batch in batches:
            for ids, group, x in _batches(batch):
                if first and len(ids):
                    yield seam(part - 1, window, ids[:window], group[:window], x[:window])
                    first = False
                if kept is not None and kept[2].shape[1] == x.shape[1]:
                    ids, group, x = (np.concatenate([k, v]) for k, v in zip(kept, (ids, group, x), strict=True))
                for start in range(0, len(ids), BLOCK):
                    stop = start + BLOCK + window
                    code = np.cumsum(np.r_[0, (np.diff(group[start:stop], axis=0) != 0).any(axis=1)])
                    a, b = _forest(ids[start:stop], x[start:stop], code, window, threshold)
                    if len(a):
                        yield rows(a=a, b=b)
                kept = ids[-window:], group[-window:], x[-window:]
        if kept is not None:
            yield seam(part, 0, *kept)

    def join_seam(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("place")
        out = []
        for _, g in rows.groupby(["label", "dim", "pass"]):
            x = unit(list(g["vector"]))
            a, b = _forest(g["b"].to_numpy("i8"), x, np.zeros(len(g), int), window, threshold)
            out.append(pd.DataFrame({"a": a, "b": b}))
        return pd.concat(out) if out else pd.DataFrame({"a": [], "b": []})

    order = ["label", "dim", "pass", "number", "id"]
    slim = known.select("id", "label", "dim", "vector", "passes", "middle")
    sorted_rows = slim.mapInArrow(project, schema).repartitionByRange(*order).sortWithinPartitions(*order)
    found = "a long, b long, seam long, place int, label long, dim int, pass int, vector array<double>"
    found = settle(sorted_rows.select("label", "dim", "pass", "id", "vector").mapInArrow(compare, found), "windows")
    seams = found.filter("seam IS NOT NULL AND seam >= 0").groupBy("seam").applyInPandas(join_seam, "a long, b long")
    return found.filter("a IS NOT NULL").select("a", "b").unionByName(seams)


def link_counts(members: DataFrame, threshold: float) -> DataFrame:
    """``id`` and ``links`` to copies of other classes, for ``members``: ``id``, ``component``, ``copies``, ``vector``."""
    sizes = members.groupBy("component").agg(F.ceil(F.count(F.lit(1)) / TILE).cast("int").alias("tiles")).withColumnRenamed("component", "_c")
    rows = members.join(sizes, F.col("component") == F.col("_c")).drop("_c")

    def count(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("component", kind="stable").reset_index(drop=True)
        out = np.zeros(len(rows), dtype="i8")
        copies, vectors = rows["copies"].to_numpy("i8"), rows["vector"].tolist()
        edges = np.flatnonzero(np.r_[True, np.diff(rows["component"].to_numpy()) != 0, True])
        for start, stop in zip(edges[:-1], edges[1:], strict=True):
            x, w = unit(vectors[start:stop]), copies[start:stop]
            near = x @ x.T >= threshold
            tiles = rows["tile"].to_numpy()[start:stop]
            if rows["i"].iat[start] != rows["j"].iat[start]:
                near &= tiles[:, None] != tiles[None, :]
            np.fill_diagonal(near, False)
            out[start:stop] = near @ w
        return pd.DataFrame({"id": rows["id"], "links": out})

    counted = tiled(rows, ["component"]).applyInPandas(count, "id long, links long")
    return counted.groupBy("id").agg(F.sum("links").alias("links"))


def near_duplicates(
    vectors: DataFrame,
    ident: str = "vec_id",
    vector: str = "embedding",
    label: str = "label",
    threshold: float = THRESHOLD,
    passes: int = PASSES,
    window: int = WINDOW,
    whole: int = 0,
) -> DataFrame:
    """``vec_id``, ``n_links``, ``component_id`` and ``kept`` of every row of ``vectors``.

    ``whole``: labels of up to so many rows are compared all with all, in place of passes.
    """
    known = settle(classes(vectors, ident, vector, label), "classes")
    plans = planned(known, threshold, passes, window, whole).withColumnsRenamed({"label": "_label", "dim": "_dim"})
    ready = known.join(plans, (F.col("label") == F.col("_label")) & (F.col("dim") == F.col("_dim")))
    links = all_links(ready.filter("passes IS NULL"), threshold)
    if not plans.filter("passes IS NOT NULL").isEmpty():
        links = links.unionByName(pass_links(ready.filter("passes IS NOT NULL"), threshold, window))
    groups = components(links)
    groups = settle(groups.select(F.col("id").alias("_id"), "component"), "groups")
    members = known.join(groups, F.col("id") == F.col("_id")).select("id", "component", "copies", "vector")
    counts = link_counts(members, threshold).select(F.col("id").alias("_counted"), "links")
    result = known.join(groups, F.col("id") == F.col("_id"), "left").join(counts, F.col("id") == F.col("_counted"), "left")
    result = result.select(
        F.col("label").alias("_label"), F.col("vector").alias("_vector"),
        (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "id").alias("component_id"),
    )
    rows = vectors.select(
        column(vectors, ident, "long").alias("vec_id"), column(vectors, label, "long").alias("label"), column(vectors, vector, "array<double>").alias("vector")
    )
    # A row without id finds the class of its vector but is no member of it.
    hit = (F.col("label") == F.col("_label")) & (F.col("vector") == F.col("_vector")) & F.col("vec_id").isNotNull()
    return rows.join(result, hit, "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id")
    ).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
