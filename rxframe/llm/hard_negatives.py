"""Hard-negative mining over Hilbert-ordered Parquet blocks with zone maps.

1. Vectors become integers and are sorted along a Hilbert curve through their ``CURVE_DIMS`` most spread dimensions.
   Runs of ``BLOCK`` rows of that order are written as blocks, one Parquet row each, with the least and greatest value of
   every dimension and of the labels: the zone map.
2. Anchors are packed in the same order into groups. For a group and the zone maps of a shelf of blocks, interval
   arithmetic bounds every inner product from both sides: each dimension contributes at most the greater of anchor times
   least and anchor times greatest value.
3. Positives: what the anchor's own block holds gives a floor below its last positive; only blocks of its label whose
   upper bound reaches the floor are read. Negatives: only blocks with another label whose bounds meet one of the
   anchor's score windows are read. Blocks that are read are scored exactly, block by block; at most ``per_anchor``
   rows a block and window leave a task, and ranks are taken over these.

Bounds only skip what cannot count, so the result equals comparing all rows. Anchors meet blocks by an equi-join on the
block number; no join without a key and no row for each pair of vectors exists.

Defined cases: rows without id, label or vector, or with a null or non-finite component take no part; a component beyond
the range of a long is the nearest long, a score likewise; vectors of different lengths never meet; rows that repeat an id
count each, but never as a partner of a row of the same id; an anchor without positives, or a positive without negatives in
its window, gives no rows; an empty table gives an empty result; other columns are not returned.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rxframe.llm.common import column, parts_for
from rxframe.session import settle

BLOCK = 512
GROUP = 2048
SHELF = 256
PER_ANCHOR = 5
CURVE_DIMS = 8
CURVE_BITS = 7
LOW, HIGH = -(2**63), 2**63 - 1
ROWS = "vec_id long, label long, dim int, v array<long>"
BLOCKS = "block long, dim int, low binary, high binary, label_low long, label_high long, ids binary, labels binary, matrix binary"
ANCHORS = "grp long, dim int, n int, ids binary, labels binary, floors binary, matrix binary"
CHOSEN = "grp long, block long, who binary"
FOUND = "grp long, i int, j int, vec_id long, score long"


def hilbert(cells: np.ndarray, bits: int) -> np.ndarray:
    """The place on the Hilbert curve of rows of ``bits``-bit coordinates (the published transform by Gray code)."""
    x = cells.astype("i8").copy()
    dims = x.shape[1]
    for b in range(bits - 1, 0, -1):
        q, p = 1 << b, (1 << b) - 1
        for i in range(dims):
            on = (x[:, i] & q) != 0
            swap = np.where(on, 0, (x[:, 0] ^ x[:, i]) & p)
            x[:, 0] ^= np.where(on, p, swap)
            if i:
                x[:, i] ^= swap
    for i in range(1, dims):
        x[:, i] ^= x[:, i - 1]
    turn = np.zeros(len(x), "i8")
    for b in range(bits - 1, 0, -1):
        turn ^= np.where(x[:, dims - 1] & (1 << b), (1 << b) - 1, 0)
    x ^= turn[:, None]
    place = np.zeros(len(x), "i8")
    for b in range(bits - 1, -1, -1):
        for i in range(dims):
            place = place << 1 | (x[:, i] >> b & 1)
    return place


def dot(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer products of rows of ``a`` and ``b``; what no long can hold is the nearest long."""
    top = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * max(1, a.shape[1])
    if top < 2**53:
        return (a.astype("f8") @ b.astype("f8").T).astype("i8")
    if top < 2**62:
        return a @ b.T
    wide = a.astype(object) @ b.astype(object).T
    return np.clip(wide, LOW, HIGH).astype("i8").reshape(len(a), len(b))


def bounds(anchors: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest possible inner product of each anchor with any vector between ``low`` and ``high``."""
    up, down = np.maximum(anchors, 0), np.minimum(anchors, 0)
    if float(np.abs(anchors).max(initial=0)) * max(float(np.abs(low).max(initial=0)), float(np.abs(high).max(initial=0))) * max(1, anchors.shape[1]) < 2**62:
        return dot(up, low) + dot(down, high), dot(up, high) + dot(down, low)
    wide = (up.astype(object), down.astype(object), low.astype(object).T, high.astype(object).T)
    clip = lambda x: np.clip(x, LOW, HIGH).astype("i8").reshape(len(anchors), len(low))
    return clip(wide[0] @ wide[2] + wide[1] @ wide[3]), clip(wide[0] @ wide[3] + wide[1] @ wide[2])


def _bytes(x: np.ndarray) -> bytes:
    """Four bytes a value where they suffice, else eight."""
    small = not len(x.ravel()) or (x.min() >= -(2**31) and x.max() < 2**31)
    return x.astype("<i4" if small else "<i8").tobytes()


def _matrix(data: bytes, rows: int, dim: int) -> np.ndarray:
    kind = "<i8" if rows * dim and len(data) == 8 * rows * dim else "<i4"
    return np.frombuffer(data, kind).astype("i8").reshape(rows, dim)


def _longs(data: bytes) -> np.ndarray:
    return np.frombuffer(data, "<i8")


def prepared(vectors: DataFrame, scale: int = 256, ident: str = "vec_id", vector: str = "embedding", label: Column | None = None) -> DataFrame:
    """``vec_id``, ``label``, ``dim`` and the integer vector ``v`` of the rows that take part."""
    x = column(vectors, vector, "array<double>")
    mark = column(vectors, "label", "long") if label is None else label
    rows = vectors.select(column(vectors, ident, "long").alias("vec_id"), mark.cast("long").alias("label"), x.alias("x"))
    odd = F.exists("x", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    rows = rows.filter("vec_id IS NOT NULL AND label IS NOT NULL AND x IS NOT NULL").filter(~odd)
    return rows.select("vec_id", "label", F.size("x").alias("dim"), F.transform("x", lambda c: F.floor(c * scale).cast("long")).alias("v"))


def _rows(batch: pa.RecordBatch):
    """Id, label, dim and the matrices of a batch, one a length of vector."""
    ids, labels, dims = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("vec_id", "label", "dim"))
    flat = batch.column("v")
    values, cuts = flat.values.to_numpy(zero_copy_only=False), flat.offsets.to_numpy()
    for dim in np.unique(dims):
        at = np.flatnonzero(dims == dim)
        yield at, int(dim), ids[at], labels[at], values[cuts[at][:, None] + np.arange(dim)]


def spread(rows: DataFrame) -> tuple[list[int], np.ndarray, np.ndarray]:
    """The most spread dimensions, with middle and width of each; only sums by dimension are aggregated."""

    def sums(batches):
        for batch in batches:
            for _, dim, ids, _, x in _rows(batch):
                y = x.astype("f8")
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.arange(dim)), pa.array(np.full(dim, float(len(ids)))), pa.array(y.sum(0)), pa.array((y * y).sum(0))], ["d", "n", "s", "q"]
                )

    parts = rows.mapInArrow(sums, "d long, n double, s double, q double")
    total = parts.groupBy("d").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q"))
    total = total.select("d", (F.col("s") / F.col("n")).alias("m"), F.sqrt(F.greatest(F.lit(0.0), F.col("q") / F.col("n") - (F.col("s") / F.col("n")) ** 2)).alias("w"))
    top = total.orderBy(F.desc_nulls_last("w"), "d").limit(CURVE_DIMS).collect()
    return [r.d for r in top], np.array([r.m for r in top]), np.array([max(r.w, 1e-9) for r in top])


def ordered(rows: DataFrame) -> DataFrame:
    """``rows`` with ``place``, sorted along the curve; rows of one place are told apart by id, so a hot place splits."""
    dims, middle, width = spread(rows)
    cells = 1 << CURVE_BITS

    def place(batches):
        for batch in batches:
            out = np.zeros(batch.num_rows, "i8")
            for at, dim, _, _, x in _rows(batch):
                use = [k for k, d in enumerate(dims) if d < dim]
                if use:
                    z = (x[:, [dims[k] for k in use]] - middle[use]) / width[use]
                    out[at] = hilbert(np.clip((z + 3) * cells / 6, 0, cells - 1).astype("i8"), CURVE_BITS)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out)], [*batch.schema.names, "place"])

    keys = ["dim", "place", "vec_id"]
    return rows.mapInArrow(place, ROWS + ", place long").repartitionByRange(*keys).sortWithinPartitions(*keys, "label")


def _packs(batches, most: int, extra: tuple = ()):
    """Runs of at most ``most`` rows of one length of vector."""
    held: list = []
    for batch in batches:
        for at, dim, ids, labels, x in _rows(batch):
            more = [batch.column(c).to_numpy(zero_copy_only=False)[at] for c in extra]
            start = 0
            while start < len(ids):
                if held and held[0] != dim:
                    yield held
                    held = []
                room = most - (len(held[1]) if held else 0)
                part = [ids[start : start + room], labels[start : start + room], x[start : start + room], *[m[start : start + room] for m in more]]
                held = [dim, *(np.concatenate(p) for p in zip(held[1:], part, strict=True))] if held else [dim, *part]
                start += room
                if len(held[1]) == most:
                    yield held
                    held = []
    if held:
        yield held


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    fields = [f.split() for f in schema.split(", ")]
    columns = list(zip(*rows, strict=True)) or [[]] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(columns, fields, strict=True)], [n for n, _ in fields])


def blocks(sorted_rows: DataFrame, block_rows: int = BLOCK) -> DataFrame:
    """The blocks and their zone maps. Rows inside a block are in order of id, which settles ties of score."""

    def pack(batches):
        first = TaskContext.get().partitionId() << 32
        for number, (dim, ids, labels, x) in enumerate(_packs(batches, block_rows)):
            by_id = np.argsort(ids, kind="stable")
            ids, labels, x = ids[by_id], labels[by_id], x[by_id]
            yield _batch([(first | number, dim, x.min(0).astype("<i8").tobytes(), x.max(0).astype("<i8").tobytes(), int(labels.min()), int(labels.max()), ids.tobytes(), labels.tobytes(), _bytes(x))], BLOCKS)

    return sorted_rows.mapInArrow(pack, BLOCKS)


def anchor_rows(stored: DataFrame, anchor_every: int, per_anchor: int) -> DataFrame:
    """The anchors in order of the curve, each with a floor: the score of the last positive its own block offers."""

    def run(batches):
        for batch in batches:
            for dim, ids, labels, data in zip(*(batch.column(c).to_pylist() for c in ("dim", "ids", "labels", "matrix")), strict=True):
                ids, labels = _longs(ids), _longs(labels)
                x = _matrix(data, len(ids), dim)
                at = np.flatnonzero(ids % anchor_every == 0)
                if not len(at):
                    continue
                score = dot(x[at], x)
                score = np.where((labels == labels[at][:, None]) & (ids != ids[at][:, None]), score, LOW)
                floors = np.partition(score, -per_anchor, axis=1)[:, -per_anchor] if len(ids) >= per_anchor else np.full(len(at), LOW)
                arrays = [pa.array(ids[at]), pa.array(labels[at]), pa.array(np.full(len(at), dim, "i4")), pa.array(list(x[at]), pa.list_(pa.int64())), pa.array(floors)]
                yield pa.RecordBatch.from_arrays(arrays, ["vec_id", "label", "dim", "v", "floor"])

    return stored.mapInArrow(run, ROWS + ", floor long")


def anchor_groups(anchors: DataFrame, group_rows: int = GROUP) -> DataFrame:
    def pack(batches):
        first = TaskContext.get().partitionId() << 32
        for number, (dim, ids, labels, x, floors) in enumerate(_packs(batches, group_rows, ("floor",))):
            yield _batch([(first | number, dim, len(ids), ids.tobytes(), labels.tobytes(), floors.tobytes(), _bytes(x))], ANCHORS)

    return anchors.mapInArrow(pack, ANCHORS)


def with_windows(groups: DataFrame, windows: DataFrame, per_anchor: int) -> DataFrame:
    """The groups with ``lows`` and ``highs``: bounds of each anchor's score windows, (1, 0) where one is empty."""
    met = groups.join(windows, F.col("grp") == F.col("_grp")).drop("_grp")

    def run(batches):
        for batch in batches:
            lows, highs = [], []
            for n, some in zip(batch.column("n").to_pylist(), batch.column("windows"), strict=True):
                low, high = np.ones((n, per_anchor), "<i8"), np.zeros((n, per_anchor), "<i8")
                i, j, lo, hi = (some.values.field(k).to_numpy(zero_copy_only=False) for k in ("i", "j", "lo", "hi"))
                low[i, j], high[i, j] = lo, hi
                lows.append(low.tobytes())
                highs.append(high.tobytes())
            kept = [batch.column(c) for c in batch.schema.names if c != "windows"]
            names = [c for c in batch.schema.names if c != "windows"]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(lows, pa.binary()), pa.array(highs, pa.binary())], [*names, "lows", "highs"])

    return met.mapInArrow(run, ANCHORS + ", lows binary, highs binary")


def _windows(row: dict) -> tuple[np.ndarray, np.ndarray]:
    return _longs(row["lows"]).reshape(row["n"], -1), _longs(row["highs"]).reshape(row["n"], -1)


def choose(groups: DataFrame, stored: DataFrame, per_anchor: int, negatives: bool, shelf_blocks: int = SHELF) -> DataFrame:
    """``grp``, ``block`` and ``who``: the anchors of a group that have to read a block."""
    zones = stored.select("block", "dim", "low", "high", "label_low", "label_high")
    n = parts_for(zones.count(), shelf_blocks)
    shelves = zones.withColumn("shelf", F.pmod(F.xxhash64("block"), F.lit(n))).groupBy("shelf", "dim").agg(
        F.collect_list(F.struct("block", "low", "high", "label_low", "label_high")).alias("zones")
    )
    side = groups.drop("ids").withColumnRenamed("dim", "_dim").withColumn("_shelf", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    met = shelves.join(side, (F.col("shelf") == F.col("_shelf")) & (F.col("dim") == F.col("_dim"))).drop("_shelf", "_dim", "shelf")

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                anchors, labels = _matrix(row["matrix"], row["n"], row["dim"]), _longs(row["labels"])[:, None]
                zone = row["zones"]
                low, high = (np.array([_longs(z[c]) for z in zone], "i8").reshape(len(zone), row["dim"]) for c in ("low", "high"))
                first, last = (np.array([z[c] for z in zone]) for c in ("label_low", "label_high"))
                least, most = bounds(anchors, low, high)
                if negatives:
                    lo, hi = _windows(row)
                    need = np.zeros(least.shape, bool)
                    for j in range(per_anchor):
                        need |= (lo[:, j] <= hi[:, j])[:, None] & (most >= lo[:, j, None]) & (least <= hi[:, j, None])
                    need &= (first != labels) | (last != labels)
                else:
                    need = (most >= _longs(row["floors"])[:, None]) & (first <= labels) & (last >= labels)
                yield _batch([(row["grp"], zone[z]["block"], np.flatnonzero(need[:, z]).astype("<i4").tobytes()) for z in np.flatnonzero(need.any(0))], CHOSEN)

    return met.mapInArrow(run, CHOSEN)


def _best(anchor: np.ndarray, order: list[np.ndarray], most: int) -> np.ndarray:
    """Positions of the first ``most`` of each anchor by ``order``."""
    by = np.lexsort((*reversed(order), anchor))
    sorted_anchor = anchor[by]
    start = np.r_[True, sorted_anchor[1:] != sorted_anchor[:-1]]
    begin = np.maximum.accumulate(np.where(start, np.arange(len(by)), 0))
    return by[np.arange(len(by)) - begin < most]


def read(chosen: DataFrame, groups: DataFrame, stored: DataFrame, per_anchor: int, negatives: bool) -> DataFrame:
    """Exact scores of chosen blocks: the first rows of each anchor (``j`` is 0) or of each of its windows ``j``."""
    blocks_side = stored.select(F.col("block").alias("_block"), "dim", F.col("ids").alias("b_ids"), F.col("labels").alias("b_labels"), F.col("matrix").alias("b_matrix"))
    groups_side = groups.drop("dim").withColumnRenamed("grp", "_grp")
    met = chosen.join(blocks_side, F.col("block") == F.col("_block")).join(groups_side, F.col("grp") == F.col("_grp")).drop("_block", "_grp")

    def run(batches):
        for batch in batches:
            for r in range(batch.num_rows):
                row = batch.slice(r, 1).to_pylist()[0]
                who = np.frombuffer(row["who"], "<i4")
                ids, labels = _longs(row["b_ids"]), _longs(row["b_labels"])
                a_ids, a_labels = _longs(row["ids"])[who], _longs(row["labels"])[who]
                score = dot(_matrix(row["matrix"], row["n"], row["dim"])[who], _matrix(row["b_matrix"], len(ids), row["dim"]))
                same = labels == a_labels[:, None]
                out = []
                if negatives:
                    lo, hi = _windows(row)
                    for j in range(per_anchor):
                        a, b = np.nonzero(~same & (score >= lo[who, j, None]) & (score <= hi[who, j, None]))
                        out.append((j, a, b))
                else:
                    a, b = np.nonzero(same & (ids != a_ids[:, None]) & (score >= _longs(row["floors"])[who][:, None]))
                    out.append((0, a, b))
                for j, a, b in out:
                    s = score[a, b]
                    top = _best(a, [~s, ids[b]], per_anchor)  # ~s falls as s rises and cannot overflow
                    arrays = [np.full(len(top), row["grp"]), who[a[top]], np.full(len(top), j, "i4"), ids[b[top]], s[top]]
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in arrays], ["grp", "i", "j", "vec_id", "score"])

    return met.mapInArrow(run, FOUND)


def ranked(found: DataFrame, most: int) -> DataFrame:
    """The first ``most`` of each anchor and window, with ``rank``; the rank is limited inside each map task first."""
    order = Window.partitionBy("grp", "i", "j").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= most)


def mine(
    rows: DataFrame,
    anchor_every: int = 100,
    per_anchor: int = PER_ANCHOR,
    low_percent: int = 80,
    high_percent: int = 100,
    block_rows: int = BLOCK,
    group_rows: int = GROUP,
) -> DataFrame:
    """``anchor_id``, ``positive_id``, ``rank``, ``negative_id``, ``positive_score`` and ``negative_score`` of ``prepared`` rows."""
    rows = settle(rows, "vectors")
    stored = settle(blocks(settle(ordered(rows), "ordered"), block_rows), "blocks")
    groups = settle(anchor_groups(settle(anchor_rows(stored, anchor_every, per_anchor), "anchors"), group_rows), "groups")
    step = partial(read, groups=groups, stored=stored, per_anchor=per_anchor, negatives=False)
    positives = ranked(step(choose(groups, stored, per_anchor, negatives=False)), per_anchor)
    positives = settle(positives.select("grp", "i", (F.col("rank") - 1).alias("j"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")
    # low * positive <= 100 * negative <= high * positive, as whole numbers.
    p = F.col("positive_score")
    lo = -F.expr(f"floor(-cast(positive_score as decimal(38,0)) * {low_percent} / 100)")
    hi = F.expr(f"floor(cast(positive_score as decimal(38,0)) * {high_percent} / 100)")
    clip = lambda c: F.least(F.greatest(c, F.lit(LOW)), F.lit(HIGH)).cast("long")
    # A group has a bounded number of anchors, and each of these at most ``per_anchor`` positives.
    windows = positives.filter(p.isNotNull()).groupBy(F.col("grp").alias("_grp")).agg(
        F.collect_list(F.struct("i", F.col("j").cast("int").alias("j"), clip(lo).alias("lo"), clip(hi).alias("hi"))).alias("windows")
    )
    wanted = settle(with_windows(groups, windows, per_anchor), "windows")
    found = ranked(read(choose(wanted, stored, per_anchor, negatives=True), wanted, stored, per_anchor, negatives=True), per_anchor)
    names = anchor_names(groups)
    keys = lambda side: (F.col("grp") == F.col(f"{side}_grp")) & (F.col("i") == F.col(f"{side}_i"))
    pos = positives.select(F.col("grp").alias("p_grp"), F.col("i").alias("p_i"), F.col("j").alias("p_j"), "positive_id", "positive_score")
    out = found.join(pos, keys("p") & (F.col("j") == F.col("p_j"))).join(names, keys("n"))
    return out.select("anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def anchor_names(groups: DataFrame) -> DataFrame:
    def run(batches):
        for batch in batches:
            for grp, ids in zip(batch.column("grp").to_pylist(), batch.column("ids").to_pylist(), strict=True):
                ids = _longs(ids)
                arrays = [pa.array(np.full(len(ids), grp)), pa.array(np.arange(len(ids), dtype="i4")), pa.array(ids)]
                yield pa.RecordBatch.from_arrays(arrays, ["n_grp", "n_i", "anchor_id"])

    return groups.select("grp", "ids").mapInArrow(run, "n_grp long, n_i int, anchor_id long")
