"""Near-duplicate documents by an inverted join over MinHash signature coordinates.

1. A document's set holds the 64-bit hashes of its distinct word shingles. Equal sets are one class, whose smallest
   id stands for it, so copies never meet as pairs.
2. Each class is posted under the (coordinate, value) pairs of its signature. Two classes that agree on at least
   ``match`` of ``coordinates`` also share one of the ``coordinates - match + 1`` rarest pairs of each, so only
   these prefixes are posted; pairs that a single class has fill the prefix first and are never posted.
   Postings are split by length class, because sets of too different sizes cannot be similar.
3. Collisions are counted for candidates: each list's most central class (highest sum of list lengths) meets the others
   of the list, equal coordinates are counted on the signatures, and pairs of at least ``match`` are retained.
   Retained pairs are confirmed on full sets, the one with most collisions of each class first; pairs whose classes
   are by then in one component are skipped.
4. Lists whose members still are in several components are few. Their classes are cut into tiles of bounded size,
   collisions are counted tile by tile, and pairs of ``match`` or more whose components are apart are confirmed; only
   links that join components leave a task. While tiles would be sent more often than there are classes (twice), another
   round of the next centres comes first. So no pair is ever a row that a centre or a link does not make, no list is
   expanded into all its pairs, and nothing is lost by skipping.

The only chance involved is a pair at the threshold matching on fewer than ``match`` coordinates; ``match`` is the
greatest number for which that is less likely than ``MISS``, and more similar pairs miss far less often.

Defined cases: null or blank text has an empty set and links with nothing; fewer words than a shingle form one
shingle; sets of so few shingles that only an equal set reaches the similarity are not posted; a row
without id is kept and links with nothing; rows that repeat an id count as one document.
"""

from __future__ import annotations

import itertools
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rxframe.llm import exact_dedup
from rxframe.llm.common import column, packed, running
from rxframe.llm.components import components
from rxframe.session import settle

COORDINATES = 64
MISS = 1e-5
REMEMBERED = 300_000
#: Shingles that a task remembers of one side of its pairs.
HELD_SHINGLES = 1_000_000
#: A tile holds about so many shingles, and at most so many sets.
TILE_SHINGLES = 1 << 18
TILE_SETS = 1024
SEED = 20_240_501
#: Odd multipliers that mix word hashes into shingle hashes.
MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63], dtype="u8")
SIGNED = "doc_id long, n long, digest binary, sig array<int>"
COUNTED = "a long, b long, equal int"
CHECKED = "a long, b long, similar boolean"

_words: dict[bytes, int] = {}


def _word_hashes(words: list[bytes]) -> np.ndarray:
    global _words
    new = [w for w in set(words) if w not in _words]
    if len(_words) + len(new) > REMEMBERED:
        _words = dict(itertools.islice(_words.items(), REMEMBERED // 2))
        new = [w for w in set(words) if w not in _words]
    _words.update((w, xxhash.xxh3_64_intdigest(w)) for w in new)
    return np.fromiter(map(_words.__getitem__, words), "u8", len(words))


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    return h ^ (h >> np.uint64(33))


def shingles(text: str | None, width: int) -> np.ndarray:
    """Sorted distinct hashes of the shingles. Bytes are lower-cased and split as ASCII, like the word pattern."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.array([], dtype="u8")
    h = _word_hashes(words)
    width = min(width, len(h))
    out = np.full(len(h) - width + 1, width, dtype="u8")
    for i in range(width):
        out = _mixed(out * MIX[i % len(MIX)] + h[i : len(h) - width + 1 + i])
    return np.unique(out)


class Signer:
    def __init__(self, coordinates: int):
        seeds = np.random.default_rng(SEED)
        self.factor = seeds.integers(0, 2**64, coordinates, dtype="u8") | np.uint64(1)
        self.shift = seeds.integers(0, 2**64, coordinates, dtype="u8")

    def __call__(self, values: np.ndarray) -> np.ndarray:
        """The least 32-bit hash of each coordinate."""
        least = None
        for start in range(0, len(values), 2048):
            part = ((values[start : start + 2048, None] * self.factor + self.shift) >> np.uint64(32)).min(0)
            least = part if least is None else np.minimum(least, part)
        return least.astype("u4").view("i4")


def signatures(docs: DataFrame, ident: str = "doc_id", text: str = "text", width: int = 5, coordinates: int = COORDINATES) -> DataFrame:
    """``doc_id``, set size ``n``, ``digest`` of the set and ``sig``; the last two are null for empty sets."""

    def sign(batches):
        signer = Signer(coordinates)
        for batch in batches:
            n, digest, sig = [], [], []
            for body in batch.column(1).to_pylist():
                values = shingles(body, width)
                n.append(len(values))
                digest.append(xxhash.xxh3_128_digest(values.tobytes()) if len(values) else None)
                sig.append(signer(values) if len(values) else None)
            arrays = [batch.column(0), pa.array(n, pa.int64()), pa.array(digest, pa.binary()), pa.array(sig, pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "n", "digest", "sig"])

    return docs.select(column(docs, ident, "long").alias("doc_id"), column(docs, text, "string").alias("text")).mapInArrow(sign, SIGNED)


def matches(percent: int, coordinates: int = COORDINATES, miss: float = MISS) -> int:
    """The greatest number of equal coordinates that a pair of ``percent`` falls short of with chance ``miss`` or less."""
    p, below = percent / 100, 0.0
    for m in range(coordinates + 1):
        below += comb(coordinates, m) * p**m * (1 - p) ** (coordinates - m)
        if below > miss:
            return max(1, m)
    return coordinates


def postings(classes: DataFrame, percent: int, coordinates: int = COORDINATES, match: int = 1) -> DataFrame:
    """Prefix postings ``list``, ``id``, ``n`` and ``weight``. ``classes`` has ``id``, ``n`` and ``sig``."""
    # A set of n shingles can only be similar to another of n - 1 or n + 1 if (n - 1) / n is enough.
    least = next(n for n in range(2, 202) if 100 * (n - 1) >= percent * n) - 1 if percent < 100 else 1 << 62
    keys = classes.filter(F.col("n") >= least).select("id", "n", F.posexplode("sig"))
    keys = keys.select("id", "n", (F.shiftleft(F.col("pos").cast("long"), 32) + F.col("col")).alias("key"))
    often = keys.groupBy("key").count().filter("count > 1").withColumnRenamed("key", "_key")
    shared = keys.join(often, F.col("key") == F.col("_key")).groupBy("id", "n").agg(
        F.sort_array(F.collect_set(F.struct("count", "key"))).alias("keys"), F.sum("count").alias("weight")
    )
    # The other coordinates are the class's own and come first in the prefix.
    room = F.size("keys") - F.lit(match - 1)
    prefix = shared.filter(room > 0).select("id", "n", "weight", F.explode(F.slice("keys", F.lit(1), room)).alias("k"))
    step = float(np.log(100 / percent))
    size = F.floor(F.log(F.col("n")) / step + 1e-9)
    # Similar sets are in the same or the next length class.
    return prefix.select(F.col("k.key").alias("x"), F.explode(F.array(size, size + 1)).alias("y"), "id", "n", "weight")


def counted(pairs: DataFrame, classes: DataFrame, match: int) -> DataFrame:
    """``a``, ``b`` and their ``equal`` coordinates, of the pairs that have at least ``match``."""

    def count(batches):
        for batch in batches:
            one, two = (batch.column(c).flatten().to_numpy().reshape(batch.num_rows, -1) for c in ("sa", "sb"))
            equal = (one == two).sum(1).astype("i4")
            kept = np.flatnonzero(equal >= match)
            yield pa.RecordBatch.from_arrays([batch.column("a").take(pa.array(kept)), batch.column("b").take(pa.array(kept)), pa.array(equal[kept])], ["a", "b", "equal"])

    side = lambda c: classes.select(F.col("id").alias(f"_{c}"), F.col("sig").alias(f"s{c}"))
    both = pairs.join(side("a"), F.col("a") == F.col("_a")).join(side("b"), F.col("b") == F.col("_b"))
    return both.select("a", "b", "sa", "sb").mapInArrow(count, COUNTED)


def check(pairs: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """Whether the full sets of each pair are similar."""

    def compare(batches):
        held, size = {}, 0
        for batch in batches:
            out = []
            for a, ta, tb in zip(batch.column("a").to_pylist(), batch.column("ta"), batch.column("tb").to_pylist(), strict=True):
                one = held.get(a)
                if one is None:
                    if size > HELD_SHINGLES:
                        held, size = {}, 0
                    one = held[a] = shingles(ta.as_py(), width)
                    size += len(one)
                two = shingles(tb, width)
                shared = len(np.intersect1d(one, two, assume_unique=True))
                out.append(100 * shared >= percent * (len(one) + len(two) - shared))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(out, pa.bool_())], ["a", "b", "similar"])

    right = texts.select(F.col("id").alias("b"), F.col("text").alias("tb"))
    left = texts.select(F.col("id").alias("a"), F.col("text").alias("ta"))
    return pairs.join(right, "b").select("a", "b", "tb").join(left, "a").select("a", "b", "ta", "tb").mapInArrow(compare, CHECKED)


def texts_of(docs: DataFrame, ids: DataFrame, ident: str, text: str) -> DataFrame:
    """``id`` and ``text`` of the documents in ``ids``; a bounded filter stops most others before the shuffle."""
    rows = docs.select(column(docs, ident, "long").alias("id"), column(docs, text, "string").alias("text"))
    likely = exact_dedup.may_match(rows, ["id"], ids).filter("maybe").select("id", "text")
    return likely.join(ids.select(F.col("id").alias("_id")), F.col("id") == F.col("_id"), "left_semi")


def _apart(pairs: DataFrame, groups: DataFrame | None) -> DataFrame:
    """``pairs`` whose ends are in different components."""
    if groups is None:
        return pairs
    side = lambda c: groups.select(F.col("id").alias(f"_{c}"), F.col("component").alias(f"c{c}"))
    met = pairs.join(side("a"), F.col("a") == F.col("_a"), "left").join(side("b"), F.col("b") == F.col("_b"), "left")
    return met.filter(F.coalesce("ca", "a") != F.coalesce("cb", "b")).select(*pairs.columns)


class Links:
    """Confirmed links and the components they make."""

    def __init__(self, classes: DataFrame, texts: DataFrame, percent: int, width: int, match: int):
        self.classes, self.texts, self.percent, self.width, self.match = classes, texts, percent, width, match
        self.groups: DataFrame | None = None

    def _confirm(self, pairs: DataFrame) -> None:
        checked = check(pairs.select("a", "b"), self.texts, self.width, self.percent)
        self.join(checked.filter("similar").select("a", "b"))

    def join(self, found: DataFrame) -> None:
        """Take confirmed links in."""
        found = settle(found, "found")
        if self.groups is None:
            self.groups = components(found)
            return
        if found.isEmpty():
            return
        # Links inside one component say nothing new, so those found before go in as the components they made.
        known = self.groups.filter("id != component").select(F.col("id").alias("a"), F.col("component").alias("b"))
        self.groups = components(known.unionByName(found))

    def add(self, pairs: DataFrame) -> None:
        """Count collisions of new ``pairs``, confirm the best of each class, then those still between components."""
        kept = settle(counted(_apart(pairs, self.groups).distinct(), self.classes, self.match), "counted")
        best = kept.groupBy("b").agg(F.max(F.struct("equal", "a")).alias("m")).select(F.col("m.a").alias("a"), "b")
        self._confirm(best)
        rest = settle(_apart(kept, self.groups).join(best.select(F.col("a").alias("_a"), F.col("b").alias("_b")), (F.col("a") == F.col("_a")) & (F.col("b") == F.col("_b")), "left_anti"), "rest")
        if not rest.isEmpty():
            self._confirm(rest)

    def component(self, rows: DataFrame) -> DataFrame:
        """``rows`` with the ``component`` of their ``id``."""
        side = self.groups.select(F.col("id").alias("_id"), F.col("component").alias("_component"))
        rows = rows.drop("component").join(side, F.col("id") == F.col("_id"), "left")
        return rows.withColumn("component", F.coalesce("_component", "id")).drop("_id", "_component")


def mixed(post: DataFrame) -> DataFrame:
    """The postings of lists that hold several components."""
    lists = post.groupBy(F.col("x").alias("_x"), F.col("y").alias("_y")).agg(F.min("component").alias("low"), F.max("component").alias("high"))
    lists = lists.filter("low != high").select("_x", "_y")
    return post.join(lists, (F.col("x") == F.col("_x")) & (F.col("y") == F.col("_y"))).drop("_x", "_y")


def tiles(post: DataFrame, classes: DataFrame, tile_shingles: int, tile_sets: int) -> tuple[DataFrame, DataFrame]:
    """``id``, ``component``, ``bundle`` and ``slot`` of the classes in ``post``; and the pairs of slots whose sizes can meet.

    Classes that share a list, directly or through others, are a bundle; inside it they are cut into slots by size.
    """
    low = post.groupBy(F.col("x").alias("_x"), F.col("y").alias("_y")).agg(F.min("id").alias("low"))
    bundles = components(post.join(low, (F.col("x") == F.col("_x")) & (F.col("y") == F.col("_y"))), "low", "id")
    sizes = post.select("id", "component").distinct().join(classes.select(F.col("id").alias("_id"), "n"), F.col("id") == F.col("_id")).drop("_id")
    rows = sizes.join(bundles.select(F.col("id").alias("_id"), F.col("component").alias("bundle")), F.col("id") == F.col("_id")).drop("_id")
    # Every set costs at least its share of the places of a tile.
    rows = rows.withColumn("cost", F.greatest("n", F.lit(tile_shingles // tile_sets))).withColumn("part", F.floor(F.log("n") * 4))
    rows = running(settle(rows, "bundles"), ["bundle"], "part", ["n", "id"], "cost", "upto")
    rows = settle(rows.withColumn("slot", F.expr(f"(upto - cost) div {tile_shingles}")).select("id", "component", "bundle", "slot", "n"), "slots")
    ends = rows.groupBy("bundle", "slot").agg(F.min("n").alias("least"), F.max("n").alias("most"))
    return rows, ends


def tile_pairs(ends: DataFrame, percent: int) -> DataFrame:
    other = ends.select(F.col("bundle").alias("_bundle"), F.col("slot").alias("j"), F.col("least").alias("_least"))
    met = ends.join(other, (F.col("bundle") == F.col("_bundle")) & (F.col("slot") <= F.col("j")) & (100 * F.col("most") >= percent * F.col("_least")))
    return met.select("bundle", F.col("slot").alias("i"), "j")


def compare_tiles(rows: DataFrame, pairs: DataFrame, classes: DataFrame, texts: DataFrame, width: int, percent: int, match: int) -> DataFrame:
    """Links ``a``, ``b`` between the components of the classes in each pair of tiles.

    Collisions are counted for the whole tile at once; of those that reach ``match``, only pairs whose components are
    still apart are compared, and only links that join two components leave the task.
    """
    rows = rows.drop("n").join(classes.select(F.col("id").alias("_id"), "sig"), F.col("id") == F.col("_id")).drop("_id")
    rows = settle(rows.join(texts.withColumnRenamed("id", "_id"), F.col("id") == F.col("_id")).drop("_id"), "tiles")
    sides = pairs.select("bundle", F.col("i").alias("slot"), "i", "j").unionByName(pairs.filter("i < j").select("bundle", F.col("j").alias("slot"), "i", "j"))
    sides = sides.select(F.col("bundle").alias("_bundle"), F.col("slot").alias("_slot"), "i", "j")
    sent = rows.join(sides, (F.col("bundle") == F.col("_bundle")) & (F.col("slot") == F.col("_slot"))).drop("_bundle", "_slot")

    def compare(table: pa.Table) -> pa.Table:
        slot, ids, component = (table.column(c).to_numpy() for c in ("slot", "id", "component"))
        second = np.flatnonzero(slot == table.column("j")[0].as_py())
        first = np.flatnonzero(slot == table.column("i")[0].as_py())
        sig = table.column("sig").combine_chunks().flatten().to_numpy().reshape(table.num_rows, -1)
        sets = [shingles(t, width) for t in table.column("text").to_pylist()]
        n = np.fromiter(map(len, sets), "i8", len(sets))
        vocabulary, code = np.unique(np.concatenate(sets), return_inverse=True)
        ends = np.cumsum(n)
        code, begin = code.astype("i4"), ends - n
        mark = np.zeros(len(vocabulary), "u1")
        root = component.copy()
        out: list[tuple[int, int]] = []
        for a in first:
            others = second[second > a] if len(first) == len(second) and first[0] == second[0] else second
            others = others[root[others] != root[a]]
            if not len(others):
                continue
            equal = (sig[others] == sig[a]).sum(1)
            others = others[equal >= match]
            others = others[100 * np.minimum(n[others], n[a]) >= percent * np.maximum(n[others], n[a])]
            if not len(others):
                continue
            mark[code[begin[a] : ends[a]]] = 1
            for start in range(0, len(others), 256):
                some = others[start : start + 256]
                lengths = n[some]
                upto = np.cumsum(lengths)
                at = np.repeat(begin[some] - (upto - lengths), lengths) + np.arange(upto[-1])
                shared = np.add.reduceat(mark[code[at]].astype("i8"), upto - lengths)
                for b in some[100 * shared >= percent * (n[some] + n[a] - shared)]:
                    if root[a] != root[b]:
                        out.append((int(ids[a]), int(ids[b])))
                        root[root == root[b]] = root[a]
            mark[code[begin[a] : ends[a]]] = 0
        return pa.table([pa.array([x for x, _ in out], pa.int64()), pa.array([y for _, y in out], pa.int64())], ["a", "b"])

    return sent.groupBy("bundle", "i", "j").applyInArrow(compare, "a long, b long")


def linked(post: DataFrame, links: Links, few: int, tile_shingles: int = TILE_SHINGLES, tile_sets: int = TILE_SETS) -> DataFrame:
    """``id`` and ``component`` of everything linked within the lists of ``post``."""
    while True:
        centers = post.groupBy(F.col("x").alias("_x"), F.col("y").alias("_y")).agg(F.max(F.struct("weight", (-F.col("id")).alias("i"))).alias("c"), F.count(F.lit(1)).alias("m"))
        centers = centers.filter("m > 1").select("_x", "_y", (-F.col("c.i")).alias("a"))
        stars = settle(post.join(centers, (F.col("x") == F.col("_x")) & (F.col("y") == F.col("_y"))).drop("_x", "_y"), "stars").filter("a != id")
        links.add(stars.select("a", F.col("id").alias("b")))
        post = settle(mixed(links.component(stars.drop("a"))), "mixed")
        if post.isEmpty():
            return links.groups
        rows, ends = tiles(post, links.classes, tile_shingles, tile_sets)
        pairs = settle(tile_pairs(settle(ends, "ends"), links.percent), "pairs")
        per_tile = rows.groupBy("bundle", "slot").count()
        used = pairs.select("bundle", "i").union(pairs.filter("i < j").select("bundle", "j")).withColumnsRenamed({"bundle": "_bundle", "i": "_slot"})
        sent = per_tile.join(used, (F.col("bundle") == F.col("_bundle")) & (F.col("slot") == F.col("_slot"))).agg(F.sum("count")).first()[0]
        if sent <= 2 * few:
            links.join(compare_tiles(rows, pairs, links.classes, links.texts, links.width, links.percent, links.match))
            return links.groups


def near_duplicates(
    docs: DataFrame,
    ident: str = "doc_id",
    text: str = "text",
    width: int = 5,
    percent: int = 80,
    coordinates: int = COORDINATES,
    miss: float = MISS,
) -> DataFrame:
    """``doc_id``, ``n_shingles``, ``component_id`` and ``kept`` of every row of ``docs``."""
    signed = settle(signatures(docs, ident, text, width, coordinates), "signatures")
    full = signed.filter("digest IS NOT NULL AND doc_id IS NOT NULL")
    classes = full.groupBy("digest").agg(F.min("doc_id").alias("id"), F.first("n").alias("n"), F.first("sig").alias("sig"))
    classes = settle(classes, "classes")
    match = matches(percent, coordinates, miss)
    post = settle(postings(classes, percent, coordinates, match), "postings")
    texts = settle(texts_of(docs, post.select("id").distinct(), ident, text), "texts")
    groups = linked(post, Links(classes, texts, percent, width, match), few=classes.count())
    groups = groups.withColumnRenamed("id", "_id")
    ids = classes.select(F.col("digest").alias("_digest"), "id").join(groups, F.col("id") == F.col("_id"), "left")
    ids = settle(ids.select("_digest", F.coalesce("component", "id").alias("component_id")), "members")
    alone = signed.filter("digest IS NULL OR doc_id IS NULL").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    known = full.join(ids, F.col("digest") == F.col("_digest")).select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    return known.unionByName(alone).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def dedup(docs: DataFrame, ident: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """One document of each component, with the columns of ``docs``; documents of an id that goes are dropped whole."""
    gone = near_duplicates(docs, ident, text, **how).filter("NOT kept").select("doc_id").distinct()
    rows = packed(docs, id=column(docs, ident, "long"))
    return rows.join(gone, F.col("id") == F.col("doc_id"), "left_anti").select(*[F.col(f"row.`{c}`") for c in docs.columns])
