"""MinHash near-dedup: one-permutation hashing, optimal densification, banded buckets, star-shaped candidates, exact confirmation.

Texts with equal shingle sets become one class first, so groups of copies cost one row. Each class throws its distinct shingles once
into BINS bins (one permutation) and keeps the least of each; an empty bin borrows from a bin that a universal hash of (bin, attempt)
finds occupied. Bands of ROWS bins give bucket keys; a pair of similarity 0.75 misses all BANDS keys with probability 3e-7. A bucket
of m classes gives at most 2 (m - 1) candidates: edges to the member whose buckets are fullest, and to one drawn by hash. Candidates
are confirmed on full sets. Rounds of the same kind follow on the buckets that hold several components until none joins. Components
that still meet in a bucket are then searched exactly, by prefixes of their full sets, so the rounds only save work.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm import scan
from quillon.llm.common import Scratch, map_batches, mix64, only, prepared, ragged, written

SHINGLE, ROWS, BANDS = 5, 4, 40
BINS = ROWS * BANDS
#: Draws of an empty bin before it takes the next occupied one.
ATTEMPTS = 256
#: Sizes of sets within this factor share a class, for which prefixes are cut.
CLASS = 1.02

_RANDOM = np.random.default_rng(5)
_PLACE = _RANDOM.integers(0, 2**63, SHINGLE, dtype=np.uint64) | np.uint64(1)
_SHORT = _RANDOM.integers(0, 2**63, SHINGLE, dtype=np.uint64)
_COLUMN = _RANDOM.integers(0, 2**63, BINS, dtype=np.uint64) | np.uint64(1)
_BAND = _RANDOM.integers(0, 2**63, BANDS, dtype=np.uint64)
_PROBE = (mix64(np.arange(BINS, dtype=np.uint64)[:, None] * np.uint64(1 << 20) + np.arange(1, ATTEMPTS + 1, dtype=np.uint64)) % np.uint64(BINS)).astype(np.int16)


def shingles(block: scan.Block) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all shingles, how many each text has): SHINGLE words each; with fewer words the whole sequence is one."""
    starts, ends = scan.words(block)
    h, counts = scan.hashes(block.data, starts, ends), block.per_text(starts)
    at = ragged(counts)
    n = np.where(counts >= SHINGLE, counts - SHINGLE + 1, (counts > 0).astype(np.int64))
    first = np.repeat(at[:-1] - ragged(n)[:-1], n) + np.arange(int(n.sum()))
    h = np.concatenate([h, np.zeros(SHINGLE, np.uint64)])
    out = np.zeros(len(first), np.uint64)
    width = np.minimum(np.repeat(counts, n), SHINGLE)
    for k in range(SHINGLE):
        out += np.where(k < width, h[first + k] * _PLACE[k], np.uint64(0))
    return mix64(out + _SHORT[width % SHINGLE]), n


def distinct(hashed: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ascending distinct hashes of each text, and how many; 56 bits of each hash are kept. At most 256 texts, as a block has."""
    key = hashed >> np.uint64(8) | np.repeat(np.arange(len(n), dtype=np.uint64) << np.uint64(56), n)
    key.sort()
    first = np.ones(len(key), bool)
    first[1:] = key[1:] != key[:-1]
    key = key[first]
    return key & np.uint64(2**56 - 1), np.bincount((key >> np.uint64(56)).astype(np.int64), minlength=len(n))


def signatures(sets: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Least hash of each bin of each set, with empty bins densified; rows of empty sets are zero."""
    row = np.repeat(np.arange(len(n)), n)
    bins = ((sets >> np.uint64(24)) * np.uint64(BINS) >> np.uint64(32)).astype(np.int64)
    place = row * BINS + bins
    first = np.ones(len(place), bool)
    first[1:] = place[1:] != place[:-1]  # ascending within a set, so the first of a bin is its least
    out, held = np.zeros(len(n) * BINS, np.uint64), np.zeros(len(n) * BINS, bool)
    out[place[first]], held[place[first]] = sets[first], True
    out, held = out.reshape(len(n), BINS), held.reshape(len(n), BINS)
    r, c = np.nonzero(~held & (n > 0)[:, None])
    for attempt in range(ATTEMPTS):
        if not len(r):
            break
        source = _PROBE[c, attempt]
        hit = held[r, source]
        out[r[hit], c[hit]] = out[r[hit], source[hit]]
        r, c = r[~hit], c[~hit]
    while len(r):
        c_next = c.copy()
        for step in range(1, BINS):
            source = (c_next + step) % BINS
            hit = held[r, source]
            out[r[hit], c[hit]] = out[r[hit], source[hit]]
            r, c, c_next = r[~hit], c[~hit], c_next[~hit]
            if not len(r):
                break
    return out


def band_keys(signature: np.ndarray) -> np.ndarray:
    rows = (mix64(signature) * _COLUMN).reshape(len(signature), BANDS, ROWS).sum(axis=2, dtype=np.uint64)
    return mix64(rows + _BAND)


def _lists(flat: np.ndarray, n: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(ragged(n), pa.int32()), pa.array(flat.astype(np.int64)))


def _sketch(batch: dict, with_sets: bool) -> dict:
    texts = batch["_text"]
    parts = []
    for _, _, block in scan.blocks(texts, lower=True):
        sets, n = distinct(*shingles(block))
        if with_sets:
            parts.append((sets, n))
            continue
        at = ragged(n)[:-1]
        total = lambda x: np.where(n > 0, np.add.reduceat(np.concatenate([x, [np.uint64(0)]]), np.minimum(at, len(x))), np.uint64(0))  # noqa: E731, B023
        parts.append((n, total(mix64(sets)), total(mix64(sets ^ np.uint64(0x5BF03635F0C4A5D1))), band_keys(signatures(sets, n))))
    joined = [np.concatenate(x) for x in zip(*parts)]
    if with_sets:
        return {"_id": batch["_id"], "_set": _lists(joined[0], joined[1])}
    n, a, b, keys = joined
    return {"_id": batch["_id"], "_n": n, "_d1": a.view(np.int64), "_d2": b.view(np.int64), "_keys": _lists(np.ascontiguousarray(keys).reshape(-1).view(np.int64), np.full(len(n), BANDS))}


def near(n_shared: Column, n_a: Column, n_b: Column) -> Column:
    """100 * |A n B| >= 75 * |A u B|."""
    return 100 * n_shared >= 75 * (n_a + n_b - n_shared)


def components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """(_id, _root) of all nodes of links (_a, _b): _root is the least node that is reachable.

    Contraction: every node takes its least neighbour as parent, edges move to the parents, and loops and repeats go, until no edge
    is left. A round joins and aggregates edges only (partial sums before each shuffle), and its result is a written table.
    """
    edges = links.select(F.least("_a", "_b").alias("_a"), F.greatest("_a", "_b").alias("_b")).filter("_a < _b").distinct()
    edges = scratch.written(edges, "edges")
    nodes = edges.select(F.col("_a").alias("_id")).union(edges.select("_b")).distinct()
    labels = scratch.written(nodes.select("_id", F.col("_id").alias("_root")), "labels")
    while not edges.isEmpty():
        both = edges.select(F.col("_b").alias("_u"), F.col("_a").alias("_v")).union(edges.select("_a", "_b"))
        least = scratch.written(both.groupBy("_u").agg(F.min("_v").alias("_p")).select("_u", F.least("_u", "_p").alias("_p")), "least")
        up = least.select(F.col("_u").alias("_p"), F.col("_p").alias("_q"))  # a parent of many is then split in the join
        parents = scratch.written(least.join(up, "_p", "left").select("_u", F.coalesce("_q", "_p").alias("_p")), "parents")
        a, b = parents.select(F.col("_u").alias("_a"), F.col("_p").alias("_x")), parents.select(F.col("_u").alias("_b"), F.col("_p").alias("_y"))
        moved = edges.join(a, "_a").join(b, "_b").filter("_x <> _y")
        fewer = scratch.written(moved.select(F.least("_x", "_y").alias("_a"), F.greatest("_x", "_y").alias("_b")).distinct(), "edges")
        to = parents.select(F.col("_u").alias("_root"), F.col("_p").alias("_to"))
        higher = scratch.written(labels.join(to, "_root", "left").select("_id", F.coalesce("_to", "_root").alias("_root")), "labels")
        scratch.drop(edges, labels, parents, least)
        edges, labels = fewer, higher
    scratch.drop(edges)
    return labels


def _joined(found: DataFrame | None, new: DataFrame, scratch: Scratch) -> DataFrame:
    """Components of what was found and new links: a component found is its members' edges to its root."""
    links = new if found is None else new.unionByName(found.select(F.col("_id").alias("_a"), F.col("_root").alias("_b")))
    out = components(links, scratch)
    scratch.drop(found, new)
    return out


def _stars(members: DataFrame, round_: int) -> DataFrame:
    """Candidates (_x, _c) of buckets of members (_key, _id, _n, _label, _full): from each member to the centres of its bucket.

    The first round has one centre, the member whose buckets are fullest, which is mostly the same one for all buckets of a group of
    copies, so a group of m gives about m pairs. Later rounds, on one member of each component, have a drawn centre as well.
    """
    one = F.struct("_id", "_n", "_label")
    full = F.xxhash64("_id", F.lit(round_)) if round_ else F.col("_id")
    orders = {"_f": F.struct("_full", full.alias("o"), one.alias("c"))}
    if round_:
        orders["_g"] = F.struct(F.xxhash64("_key", "_id", F.lit(round_)).alias("o"), one.alias("c"))
    centres = members.groupBy("_key").agg(*[F.max(o).alias(c) for c, o in orders.items()]).select("_key", *[F.col(f"{c}.c").alias(c) for c in orders])
    rows = members.join(centres, "_key")
    pairs = None
    for c in orders:
        size = (F.least("_n", F.col(f"{c}._n")) * 4) >= (F.greatest("_n", F.col(f"{c}._n")) * 3)
        part = rows.filter((F.col("_label") != F.col(f"{c}._label")) & size).select(F.col("_id").alias("_x"), F.col(f"{c}._id").alias("_c"))
        pairs = part if pairs is None else pairs.union(part)
    return pairs.distinct()


def _mixed(rows: DataFrame, found: DataFrame | None, round_: int) -> DataFrame:
    """One drawn member of each component of the buckets that hold several: (_key, _label, _full, _id, _n)."""
    labelled = rows.withColumn("_root", F.lit(None).cast("long")) if found is None else rows.join(found, "_id", "left")
    one = labelled.groupBy("_key", F.coalesce("_root", "_id").alias("_label")).agg(F.max_by(F.struct("_full", "_id", "_n"), F.xxhash64("_key", "_id", F.lit(round_))).alias("m"))
    several = one.groupBy("_key").count().filter("count > 1").select("_key")
    return one.join(several, "_key", "left_semi").select("_key", "_label", "m.*")


def _size_class(n: Column) -> Column:
    return F.floor(F.log(n) / float(np.log(CLASS))).cast("int")


def _closing(labels: DataFrame, sets: DataFrame, scratch: Scratch) -> DataFrame:
    """Candidates (_x, _c) among labels (_id, _label): every pair of different labels whose sets are near, and few others.

    Order each set with the shingles of one label first and the others by ascending count. Near sets of a and b shingles share
    3 (a + b) / 7 or more, so their first common one leaves at least as many in both; what is of one label only is never common.
    """
    held = sets.join(labels, "_id").select("_id", "_label", F.size("_set").alias("_n"), F.xxhash64("_set").alias("_h"), "_set")
    flat = held.select("_id", "_label", "_n", "_h", F.explode("_set").alias("_s"))
    common = flat.groupBy("_s").agg(F.min("_label").alias("_lo"), F.max("_label").alias("_hi"), F.count("*").alias("_c")).filter("_lo < _hi").select("_s", "_c")
    common = scratch.written(common, "common")  # a frequent shingle's rows can then be split in the join
    met = flat.join(common, "_s").groupBy("_id", "_label", "_n", "_h").agg(F.sort_array(F.collect_set(F.struct("_c", "_s"))).alias("_m"))
    met = scratch.written(met.filter(4 * F.size("_m") >= 3 * F.col("_n")), "met")
    scratch.drop(common)
    n, own = F.col("_n"), _size_class(F.col("_n"))
    each = met.withColumn("_own", own).withColumn("_other", F.explode(F.sequence(_size_class(F.ceil(n * 3 / 4)), _size_class(F.floor(n * 4 / 3)))))
    least = F.greatest(F.ceil(n * 3 / 4), F.floor(F.pow(F.lit(CLASS), "_other") * (1 - 1e-9)))
    each = each.withColumn("_t", (F.size("_m") - F.ceil((n + least) * 3 / 7) + 1).cast("int")).filter("_t > 0")
    each = each.select("_id", "_label", "_n", "_own", F.least("_own", "_other").alias("_lower"), F.greatest("_own", "_other").alias("_upper"), F.size("_m").alias("_k"), F.posexplode(F.slice("_m", F.lit(1), F.col("_t"))).alias("_i", "_e"))
    each = each.select("_id", "_label", "_n", "_own", "_lower", "_upper", (F.col("_k") - F.col("_i")).alias("_r"), F.col("_e._s").alias("_s"))
    a, b = (each.filter(f"_own = {o}").select("_s", "_lower", "_upper", *[F.col(f"_{c}").alias(f"_{c}{s}") for c in ("id", "label", "n", "r")]) for o, s in (("_lower", "a"), ("_upper", "b")))
    pairs = a.join(b, ["_s", "_lower", "_upper"]).filter("_labela <> _labelb and (_lower < _upper or _ida < _idb) and 7 * least(_ra, _rb) >= 3 * (_na + _nb)")
    return pairs.select(F.col("_ida").alias("_x"), F.col("_idb").alias("_c")).distinct()


def confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(_a, _b) of the pairs (_x, _c) whose full sets are near. A member's set travels to its centre's, which isn't copied before."""
    x, c = sets.select(F.col("_id").alias("_x"), F.col("_set").alias("_sx")), sets.select(F.col("_id").alias("_c"), F.col("_set").alias("_sc"))
    shared = F.size(F.array_intersect("_sx", "_sc"))
    found = pairs.join(x, "_x").join(c, "_c").filter(near(shared, F.size("_sx"), F.size("_sc")))
    return found.select(F.col("_x").alias("_a"), F.col("_c").alias("_b"))


def _links(pairs: DataFrame, sets: DataFrame, scratch: Scratch) -> DataFrame:
    """The confirmed pairs, as a written table; sets that no pair needs stay where they are."""
    pairs = scratch.written(pairs, "pairs")
    needed = scratch.written(pairs.select(F.col("_x").alias("_id")).union(pairs.select("_c")).distinct(), "needed")
    links = scratch.written(confirmed(pairs, only(sets, needed, "_id")), "links")
    scratch.drop(pairs, needed)
    return links


def near_groups(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", most_rounds: int = 12) -> DataFrame:
    """_id, _n (distinct shingles), _root (least id reachable over links) of each row of docs.

    Null texts and texts without words have _n = 0 and are linked with nothing; texts of fewer than five words are linked with equal
    sequences only. Rows that share an id count as one document; rows without an id keep a null _root. Texts of any length are taken
    whole, in blocks of their own if they are long. An empty table gives an empty result; other columns are not read. Equal sets
    meet by a partial minimum and a join that Spark may split, so a group of any size is no single task; a star's candidates grow
    with a bucket's members, not with their square. `most_rounds` only bounds the stars: what they leave apart is searched exactly.
    """
    slim = docs.select(F.col(doc_id).cast("long").alias("_id"), F.col(text).cast("string").alias("_text"))
    with Scratch(docs.sparkSession) as scratch:
        return written(_groups(slim, scratch, most_rounds), "groups")


def _groups(slim: DataFrame, scratch: Scratch, most_rounds: int) -> DataFrame:
    sketches = scratch.written(map_batches(slim, _sketch, "_id bigint, _n bigint, _d1 bigint, _d2 bigint, _keys array<bigint>", False), "sketches")
    known = sketches.filter("_id is not null and _n > 0")
    first = scratch.written(known.groupBy("_d1", "_d2").agg(F.min("_id").alias("_rep")), "classes")
    members = scratch.written(known.select("_id", "_d1", "_d2").join(first, ["_d1", "_d2"]).select("_id", "_rep"), "members")
    reps = known.join(first.select("_d1", "_d2", F.col("_rep").alias("_id")), ["_d1", "_d2", "_id"], "left_semi")
    keyed = reps.select("_id", "_n", F.explode("_keys").alias("_key"))
    full = scratch.written(keyed.groupBy("_key").agg(F.min("_id").alias("_lo"), F.max("_id").alias("_hi"), F.count("*").alias("_c")).filter("_lo < _hi").select("_key", "_c"), "full-buckets")
    counted = scratch.written(keyed.join(full, "_key"), "buckets")
    weight = counted.groupBy("_id").agg(F.sum("_c").alias("_full"))
    rows = scratch.written(counted.join(weight, "_id").select("_key", "_id", "_n", "_full"), "bucket-rows")
    made = scratch.written(sketches.select("_id", "_n"), "sizes")
    scratch.drop(sketches, first, full, counted)
    wanted = scratch.written(rows.select("_id").distinct(), "wanted")
    sets = scratch.written(map_batches(only(slim.filter("_id is not null"), wanted, "_id"), _sketch, "_id bigint, _set array<bigint>", True), "sets")
    found = None
    for round_ in range(most_rounds):
        labelled = scratch.written(_mixed(rows, found, round_), "mixed") if round_ else rows.withColumn("_label", F.col("_id"))
        new = _links(_stars(labelled, round_), sets, scratch)
        scratch.drop(labelled)
        if new.isEmpty():
            break
        found = _joined(found, new, scratch)
    apart = scratch.written(_mixed(rows, found, most_rounds).select("_label").distinct(), "apart")
    if not apart.isEmpty():
        of = rows.select("_id").distinct()
        of = of.withColumn("_label", F.col("_id")) if found is None else of.join(found, "_id", "left").select("_id", F.coalesce("_root", "_id").alias("_label"))
        new = _links(_closing(of.join(apart, "_label", "left_semi"), sets, scratch), sets, scratch)
        if not new.isEmpty():
            found = _joined(found, new, scratch)
    scratch.drop(rows, sets, wanted)
    # classes of one document meet at its id, and components at their least member
    ties = members.groupBy("_id").agg(F.min("_rep").alias("_a"), F.max("_rep").alias("_b")).filter("_a < _b").select("_a", "_b")
    ties = scratch.written(ties, "ties")
    if not ties.isEmpty():
        found = _joined(found, ties, scratch)
    rep = members
    if found is not None:
        rep = rep.join(found.select(F.col("_id").alias("_rep"), "_root"), "_rep", "left").select("_id", F.coalesce("_root", "_rep").alias("_root"))
    else:
        rep = rep.select("_id", F.col("_rep").alias("_root"))
    rep = rep.groupBy("_id").agg(F.min("_root").alias("_root"))
    return made.join(rep, "_id", "left").select("_id", "_n", F.coalesce("_root", "_id").alias("_root"))


def distinct_documents(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs, all columns, that are the smallest id of their group; rows without an id stay, and of equal ids one row does."""
    groups = near_groups(docs, doc_id=doc_id, text=text)
    gone = written(groups.filter("_id is not null and _root < _id").select("_id").distinct(), "gone")
    rows = only(docs, gone, doc_id, but=True)
    twice = written(groups.filter("_id is not null and _root = _id").groupBy("_id").count().filter("count > 1").select("_id"), "repeated-ids")
    if twice.isEmpty():
        return rows
    return only(rows, twice, doc_id, but=True).unionByName(only(rows, twice, doc_id).dropDuplicates([doc_id]))


def op3_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = prepared(spark).read.parquet(f"{sf_dir}/documents.parquet")
    return near_groups(docs).select(F.col("_id").alias("doc_id"), F.col("_n").alias("n_shingles"), F.col("_root").alias("component_id"), (F.col("_id").isNull() | (F.col("_id") == F.col("_root"))).alias("kept"))
