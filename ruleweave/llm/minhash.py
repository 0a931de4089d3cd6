"""Near-duplicate documents by min-max hashing.

A document's set is its distinct word shingles.  Under each permutation both the
least and the greatest value are kept, so that a signature of 2k values costs k
hash evaluations; ROWS values make a band, and documents that agree on a band meet
in a bucket.  Equal sets are made one class first, so copies cost nothing later.

No bucket is expanded into pairs, and of classes that meet in a bucket no link is lost:

1. each bucket names pivots by chance, PIVOTS of them in turn, and its other members
   are compared with each, unless they are in one component by then;
2. a bucket is done once the members that were no pivots are all in one component, as
   in every bucket of at most PIVOTS + 1 members;
3. classes of the other buckets are joined by an exact prefix filter: of two sets
   with the wanted overlap, the rarest few shingles of each must share one, early enough
   in both.  Only shingles that several components have can make a pair.

Compared sets are the full ones, as 64-bit shingle hashes; parity maps, which differ in
no more bits than the sets in members, spare most comparisons.  There are as many bands
as two sets at the wanted similarity need to share a bucket but with a probability of
at most MISSED: 32 of 6 values at 0.85, 38 of 5 at 0.8.  A class is named by 64 bits of
a 128-bit fingerprint, and classes that would share a name are still compared on their
sets.

Defined cases: a text without words has an empty set and no links; fewer words than
a shingle make one shingle; a null text is an empty one; rows with the same id are
linked as rows, by their sets; a null id is a row like others and never the least.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .components import components
from .scratch import cut, small
from .textnp import Words, batches, mix, shingles

WIDTH = 5
#: Percent of the union that two linked sets share at least.
SHARE = 80
#: The most likely miss of a link by the buckets.
MISSED = 3e-7
PIVOTS = 3
#: 64-bit words of the parity map of a set.
MAP = 16
MAPS = [f"m{i}" for i in range(MAP)]
U = np.uint64
MOST = 1024
_rng = np.random.Generator(np.random.PCG64(7919))
_FACTOR = _rng.integers(1, 2**63, MOST, dtype=np.uint64) * U(2) + U(1)
_SHIFT = _rng.integers(0, 2**63, MOST, dtype=np.uint64)
_BAND = _rng.integers(1, 2**63, MOST, dtype=np.uint64) * U(2) + U(1)


def shape(share: int) -> tuple[int, int]:
    """(values of a band, bands) for sets that share `share` percent at least."""
    rows = 6 if share >= 85 else 5 if share >= 80 else 4 if share >= 70 else 3
    bands = int(np.ceil(np.log(MISSED) / np.log1p(-((share / 100) ** rows)))) if share < 100 else 1
    return rows, bands + (rows * bands) % 2


def distinct(values: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct values of each text."""
    sets = [np.unique(values[i:j]) for i, j in zip(bounds[:-1], bounds[1:], strict=True)]
    at = np.zeros(len(sets) + 1, dtype=np.int64)
    np.cumsum([len(s) for s in sets], out=at[1:])
    return (np.concatenate(sets) if sets else values[:0]), at


def min_max(values: np.ndarray, bounds: np.ndarray, permutations: int, chunk: int = 1 << 15) -> np.ndarray:
    """Least and greatest value under each permutation, for texts that all have values."""
    n = len(bounds) - 1
    out = np.empty((n, 2 * permutations), dtype=np.uint64)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(bounds, bounds[i] + chunk, side="right")) - 1)
        part, at = values[bounds[i] : bounds[j]], bounds[i:j] - bounds[i]
        for k in range(permutations):
            y = part * _FACTOR[k] + _SHIFT[k]
            out[i:j, 2 * k] = np.minimum.reduceat(y, at)
            out[i:j, 2 * k + 1] = np.maximum.reduceat(y, at)
        i = j
    return out


def band_keys(signatures: np.ndarray, rows: int, bands: int) -> np.ndarray:
    """One key for each band; keys of different bands differ."""
    grouped = signatures.reshape(len(signatures), bands, rows)
    factors = _BAND[: rows * bands].reshape(bands, rows)
    return mix((grouped * factors).sum(axis=2, dtype=np.uint64) + np.arange(bands, dtype=np.uint64) * U(0x9E3779B97F4A7C15))


def describe(docs: DataFrame, share: int = SHARE) -> DataFrame:
    """doc_id, tie, n, a, b, bands of each row of docs(doc_id, text): set size, fingerprint and band keys."""
    height, width = shape(share)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in batches(it):
            sets, at = distinct(*shingles(Words(texts), WIDTH))
            n = np.diff(at)
            full = n > 0
            starts = at[:-1][full]
            prints = [np.add.reduceat(mix(sets ^ U(k)), starts) if len(starts) else np.zeros(0, U) for k in (0, 0xA5A5A5A5)]
            names = [np.zeros(len(n), dtype=np.int64) for _ in prints]
            for name, p in zip(names, prints, strict=True):
                name[full] = mix(p + n[full].astype(np.uint64)).view(np.int64)
            keys = band_keys(min_max(sets, np.append(starts, at[-1]), height * width // 2), height, width).view(np.int64)
            offsets = np.zeros(len(n) + 1, dtype=np.int32)
            np.cumsum(np.where(full, width, 0), out=offsets[1:])
            bands = pa.ListArray.from_arrays(pa.array(offsets), pa.array(keys.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("tie"), pa.array(n), pa.array(names[0], mask=~full), pa.array(names[1], mask=~full), bands], ["doc_id", "tie", "n", "a", "b", "bands"])

    return docs.mapInArrow(run, "doc_id long, tie long, n long, a long, b long, bands array<bigint>")


def parity_maps(sets: np.ndarray, at: np.ndarray) -> np.ndarray:
    """For each set 64 * MAP bits: whether an odd number of its members falls on the bit.

    Two sets' maps differ in no more bits than the sets differ in members.
    """
    n, width = len(at) - 1, 64 * MAP
    spot = np.repeat(np.arange(n) * width, np.diff(at)) + (sets & U(width - 1)).astype(np.int64)
    odd = (np.bincount(spot, minlength=n * width) & 1).astype(np.uint8)
    return np.packbits(odd.reshape(n, width), axis=1, bitorder="little").view(np.int64)


def full_sets(docs: DataFrame) -> DataFrame:
    """a, n, shingles, m0 ... of each row of docs(a, text): the set and its parity map."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in batches(it, 1 << 20):
            sets, at = distinct(*shingles(Words(texts), WIDTH))
            lists = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(sets.view(np.int64)))
            maps = [pa.array(m) for m in parity_maps(sets, at).T]
            yield pa.RecordBatch.from_arrays([batch.column("a"), pa.array(np.diff(at)), lists, *maps], ["a", "n", "shingles", *MAPS])

    return docs.mapInArrow(run, f"a long, n long, shingles array<bigint>, {', '.join(f'{m} long' for m in MAPS)}")


def sides(pairs: DataFrame, frame: DataFrame, columns: list[str]) -> DataFrame:
    """x, y and both sides' columns of pairs (x, y), a written table of distinct rows; no hot member is joined on alone."""
    pairs = small(pairs)
    left, right = (frame.join(pairs, F.col("a") == F.col(at)).select("x", "y", *(F.col(c).alias(f"{c}_{at}") for c in columns)) for at in "xy")
    return left.join(right, ["x", "y"])


def likely(share: int) -> Column:
    """Whether sizes n_x and n_y, and parity maps, allow the wanted similarity."""
    sized = F.expr(f"100 * least(n_x, n_y) >= {share} * greatest(n_x, n_y)")
    apart = sum((F.bit_count(F.col(f"{m}_x").bitwiseXOR(F.col(f"{m}_y"))) for m in MAPS), F.lit(0))
    return sized & ((100 + share) * apart <= (100 - share) * (F.col("n_x") + F.col("n_y")))


def confirmed(pairs: DataFrame, sets: DataFrame, share: int) -> DataFrame:
    """Of distinct pairs (x, y), those whose full sets are similar enough."""
    some = cut(sides(cut(pairs, "pairs"), sets, ["n", *MAPS]).where(likely(share)).select("x", "y"), "pairs")
    both = sides(some, sets, ["n", "shingles"]).select("x", "y", "n_x", "n_y", F.size(F.array_intersect("shingles_x", "shingles_y")).cast("long").alias("both"))
    return both.where(f"100 * both >= {share} * (n_x + n_y - both)").select("x", "y")


def prefix_pairs(sets: DataFrame, nodes: DataFrame, share: int) -> DataFrame:
    """Pairs of `nodes` (a, comp) of different components that may be similar; no similar pair is missing.

    Shingles of one component come first in the order of all shingles, then the
    rarer before the more frequent.  Similar sets share one within their first
    n - ceil(share n) + 1, and after the first that they share, both must have
    enough left for the overlap that their sizes ask for.  Nor may their parity maps
    differ in more bits than such sets can differ in members.
    """
    nodes = small(nodes)
    terms = sets.join(nodes, "a").select("a", "comp", "n", F.explode("shingles").alias("term"))
    useful = terms.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("term", "df")
    ranked = terms.join(useful, "term").select("a", "comp", "n", "term", F.row_number().over(Window.partitionBy("a").orderBy("df", "term")).alias("rank"), F.count(F.lit(1)).over(Window.partitionBy("a")).alias("useful"))
    kept = ranked.select("a", "comp", "n", "term", F.expr("n - useful + rank - 1").alias("before")).where(f"before <= n - (({share} * n + 99) div 100)")
    kept = cut(kept.join(sets.select("a", *MAPS).join(nodes.select("a"), "a"), "a"), "prefixes")
    left, right = (kept.select("term", *(F.col(c).alias(f"{c}_{at}") for c in ("a", "comp", "n", "before", *MAPS))) for at in "xy")
    early = F.expr(f"{100 + share} * least(n_x - before_x, n_y - before_y) >= {share} * (n_x + n_y)")
    near = left.join(right, "term").where((F.col("a_x") < F.col("a_y")) & (F.col("comp_x") != F.col("comp_y")) & early & likely(share))
    return near.select(F.col("a_x").alias("x"), F.col("a_y").alias("y")).distinct()


def linked(members: DataFrame, sets: DataFrame, share: int) -> DataFrame:
    """node, root of the components that members(bucket, a) of common buckets make by their sets."""
    placed = members.select("bucket", "a", F.col("a").alias("comp"), F.xxhash64("bucket", "a").alias("draw"), F.lit(None).cast("long").alias("last"))
    links = None
    for turn in range(PIVOTS + 1):
        open_ = placed.where("last is null or draw > last")
        least = open_.groupBy("bucket").agg(F.min(F.struct("draw", "a", "comp")).alias("p"), F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("bucket", "p")
        open_ = open_.join(least, "bucket")
        if turn == PIVOTS:
            nodes = cut(open_.select("a", "comp").distinct(), "unsettled")
            more = confirmed(prefix_pairs(sets, nodes, share), sets, share)
        else:
            open_ = cut(open_.select("bucket", "a", "comp", "draw", F.col("p.draw").alias("last"), F.col("p.a").alias("y"), F.col("p.comp").alias("of")), "open")
            more = confirmed(open_.where("draw > last and comp <> of").select(F.col("a").alias("x"), "y").distinct(), sets, share)
        found = cut(more if links is None else links.union(more), "links")
        links = components(found)
        if turn < PIVOTS:
            placed = open_.select("bucket", "a", "draw", "last").join(links, F.col("a") == F.col("node"), "left").select("bucket", "a", F.coalesce("root", "a").alias("comp"), "draw", "last")
            links = links.select(F.col("node").alias("x"), F.col("root").alias("y")).where("x <> y")
    return links


def near_duplicates(docs: DataFrame, share: int = SHARE, text: str = "text", key: str = "doc_id") -> DataFrame:
    """doc_id, tie, n_shingles, component_id, kept for each row; `tie` is the text's hash.

    Documents are linked when they share `share` percent of their shingles at least.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    slim = docs.select(F.col(key).cast("long").alias("doc_id"), F.xxhash64(body).alias("tie"), body.alias("text"))
    rows = cut(describe(slim, share), "sets")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "tie"))
    classes = cut(rows.where("n > 0").groupBy("a", "b").agg(first.alias("at"), F.first("bands").alias("bands")).select("a", "at.doc_id", "at.tie", "bands"), "classes")

    buckets = classes.select("a", F.explode("bands").alias("bucket"))
    shared = buckets.groupBy("bucket").agg(F.min("a").alias("lead"), F.max("a").alias("last")).where("lead < last").select("bucket")
    members = cut(buckets.join(shared, "bucket"), "buckets")

    wanted = cut(members.select("a").distinct().join(classes.select("a", F.col("doc_id").alias("id"), F.col("tie").alias("t")), "a"), "wanted")
    found = slim.join(small(wanted), slim.doc_id.eqNullSafe(F.col("id")) & (slim.tie == F.col("t"))).select("a", "text")
    sets = cut(full_sets(found), "full-sets")
    named = sets.agg(F.count("a"), F.count_distinct("a")).first()
    if named[0] > named[1]:  # rows that repeat id and text
        sets = cut(sets.dropDuplicates(["a"]), "full-sets")
    roots = linked(members, sets, share)

    ids = classes.select("a", F.col("doc_id").alias("least"))
    of = roots.join(ids, roots.node == ids.a)
    least = of.groupBy("root").agg(F.min("least").alias("component"))
    named = cut(of.select("a", "root").join(least, "root").select("a", "component"), "components")
    out = rows.select("doc_id", "tie", "n", "a").join(ids, "a", "left").join(named, "a", "left")
    component = F.coalesce("component", "least", "doc_id")
    return out.select("doc_id", "tie", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(False)).alias("kept"))
