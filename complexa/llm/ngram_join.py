"""N-gram Jaccard join: size-banded tiles of sets with hashed bitmap
signatures, whose bit counts bound the overlap from above before an exact
intersection of sorted arrays.

1. Texts become sets of word n-grams (64-bit hashes).  Equal sets are one node.
2. Candidates.  Sizes fall into bands.  In a band the hash range is cut into k
   equal parts, with k larger than the symmetric difference that a linked pair
   may have plus a slack s; a linked pair then agrees exactly on at least
   s + 1 parts.  Very frequent n-grams (shared lines and passages) are left out
   of the parts, in every set alike, which only makes differences smaller.
   Each set sends a signature of every non-empty part to tiles.  A set with
   more than s + 1 - ``AGREE`` empty parts is sparse; a linked pair that has a
   set that is not agrees on ``AGREE`` non-empty parts, and two sparse sets
   share a hash of their prefixes (the |x| - ceil(t|x|) + 1 first members,
   frequent ones last), which sparse sets send too.  In small buckets all pairs
   are counted and must agree often enough; larger ones are joined by a star.
   Connected components of these edges are clusters of candidates.
3. Verification.  A second scan finds one row of each set of a cluster by a
   bounded Bloom filter of row hashes, so that no other text leaves its task.
   Each set of a cluster of several goes once to the unit of its cluster.  In a unit sets are compared with those of fitting size,
   vectorised over bitmaps of hashed bits: every bit that x has and y lacks is
   a member of x that y lacks, so |x| - popcount(bx & ~by) bounds the overlap.
   Pairs that pass are intersected exactly; pairs already connected are
   skipped.  Clusters above ``UNIT_SETS`` are cut into size bands and blocks;
   blocks are linked as a ring first, and block pairs that are not yet in one
   component are then compared in full, so no link between components is lost.

Defined cases: null, empty or blank text: no n-gram, linked with nothing
(n_shingles 0, its own component); fewer words than n: the whole sequence is
the only n-gram; repeated rows are equal sets; a null doc_id is larger than
every other; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from complexa.llm.common import (Words, fresh_name, inside, list_array, mix, ragged_range, release, row_key, sequence_hashes, text_array, text_chunks,
                                 whole_hash, work_table)
from complexa.llm.components import connected_components
from complexa.llm.tiles import TILE_SCHEMA, Packer, packed_home, tiles_for, unpack

#: Sets compared inside one unit.
UNIT_SETS = 1500
#: Ratio of band borders (at least the inverse of the similarity).
BAND_RATIO = 1.3
CHARS_PER_TILE = 24_000_000
#: Non-empty parts that a pair must agree on; sizes of the buckets in which pairs are counted.
AGREE, SMALL_BUCKET = 3, 32
#: N-grams in this share of the sets are frequent; most of them that are told apart; n-grams counted at a time.
FREQUENT, FREQUENT_MOST, COUNT_GRAMS = 5e-4, 1_000_000, 2_000_000
#: Bits of a ``row_filter`` for each of its rows (at least), and its bits at most (32 MB; 16 million rows, beyond that it passes more others).
FILTER_BITS, FILTER_MOST = 16, 1 << 28
_U = np.uint64


class Sets:
    """Sorted distinct n-gram hashes of each row of a run of texts."""

    def __init__(self, data: np.ndarray, rows: np.ndarray, n: int):
        words = Words(data, rows, lower=True)
        counts = np.diff(words.rows)
        at = inside(words.rows, n)
        grams = sequence_hashes(words.hash, n)[at] if len(at) else np.zeros(0, np.uint64)
        owner = np.repeat(np.arange(len(counts)), np.maximum(counts - n + 1, 0))
        short = np.flatnonzero((counts > 0) & (counts < n))
        if len(short):
            whole = whole_hash(words.hash, words.rows)[short]
            grams, owner = np.concatenate([grams, whole]), np.concatenate([owner, short])
        order = np.lexsort((grams, owner))
        grams, owner = grams[order], owner[order]
        if len(grams):
            fresh = np.append(True, (grams[1:] != grams[:-1]) | (owner[1:] != owner[:-1]))
            grams, owner = grams[fresh], owner[fresh]
        self.grams, self.owner = grams, owner
        self.size = np.bincount(owner, minlength=len(counts)).astype(np.int64)
        self.at = np.append(0, np.cumsum(self.size))
        self.key = whole_hash(grams, self.at, salt=77).view(np.int64)


def sets_of_texts(docs: DataFrame, n: int) -> DataFrame:
    """doc_id, rid, set_id, n_shingles per row, and now and then (``frequent``) the n-grams common among the last sets."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        for batch in batches:
            for a, b, data, rows in text_chunks(text_array(batch)):
                sets, part = Sets(data, rows, n), batch.slice(a, b - a)
                held.append(sets.grams)
                common = [None] * (b - a)
                if sum(map(len, held)) >= COUNT_GRAMS:
                    common[-1], held = _common(held), []
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("rid"), pa.array(sets.key), pa.array(sets.size), pa.array(common, pa.binary())],
                    names=["doc_id", "rid", "set_id", "n_shingles", "frequent"])
        if held:  # what is left is counted too, on a row that is no document
            yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.array([-1]),
                                              pa.array([_common(held)], pa.binary())],
                                             names=["doc_id", "rid", "set_id", "n_shingles", "frequent"])

    return docs.mapInArrow(scan, "doc_id long, rid long, set_id long, n_shingles long, frequent binary")


_COUNTED = np.dtype([("gram", "<i8"), ("n", "<i8")])


def _common(held: list[np.ndarray]) -> bytes:
    grams, n = np.unique(np.concatenate(held), return_counts=True)
    often = n >= 3
    out = np.empty(int(often.sum()), _COUNTED)
    out["gram"], out["n"] = grams[often].view(np.int64), n[often]
    return out.tobytes()


def frequent_grams(sets: DataFrame) -> np.ndarray:
    """Sorted hashes of the n-grams found in ``FREQUENT`` or more of the sets.

    Counted over all texts (counts below three in a run of ``COUNT_GRAMS`` are
    dropped), at most ``FREQUENT_MOST`` of them.  They decide where candidates
    are looked for, never whether a link is found.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [np.frombuffer(x, _COUNTED) for x in batch.column("frequent").to_pylist()]
            if got:
                all_ = np.concatenate(got)
                yield pa.RecordBatch.from_arrays([pa.array(all_["gram"]), pa.array(all_["n"])], names=["gram", "n"])

    total = sets.filter("n_shingles >= 0").count()
    counts = sets.filter("frequent is not null").select("frequent").mapInArrow(rows, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))
    top = counts.filter(F.col("n") >= max(8, FREQUENT * total)).orderBy(F.desc("n"), "gram").limit(FREQUENT_MOST).select("gram").toPandas()
    return np.sort(top["gram"].to_numpy(np.int64).view(np.uint64))


@lru_cache(maxsize=16)
def bands(num: int, den: int, largest: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first size of each band, parts k, slack s) up to the band of ``largest``, for similarity num/den."""
    t, ratio, starts, parts, slacks, b = num / den, max(BAND_RATIO, den / num), [], [], [], 1
    while not starts or b <= largest:
        nxt = max(b + 1, math.ceil(b * ratio))
        differ = (den - num) * 2 * (nxt - 1) // (den + num)  # of two sets of at most nxt - 1 members
        smallest, s = max(1, math.ceil(t * b)), AGREE - 1
        for _ in range(20):
            k = differ + 1 + s
            empty = k * math.exp(-smallest / k)
            want = AGREE - 1 + (math.ceil(empty + 4 * math.sqrt(empty)) if empty > 0.01 else 0)
            if want <= s:
                break
            s = want
        starts.append(b)
        parts.append(differ + 1 + s)
        slacks.append(s)
        b = nxt
    return np.array([*starts, b]), np.array(parts), np.array(slacks)


def signatures(sets: Sets, num: int, den: int, frequent: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, signature, kind) entries, entries of a row adjacent; kind 0 or 1: a part (by the parity of the band), 2: a prefix member."""
    if not len(sets.grams):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    starts, parts, slacks = bands(num, den, int(math.ceil(sets.size.max() * den / num)) + 1)
    band = np.searchsorted(starts, np.maximum(sets.size, 1), "right") - 1
    some = sets.size > 0
    larger = some & (sets.size * den >= num * starts[np.minimum(band + 1, len(starts) - 1)]) & (band + 1 < len(parts))
    heavy = np.isin(sets.grams, frequent)
    light, light_of = sets.grams[~heavy], sets.owner[~heavy]
    light_size = np.bincount(light_of, minlength=len(sets.size))
    light_at = np.append(0, np.cumsum(light_size))
    members = np.concatenate([light, sets.grams[heavy]])  # frequent members last
    heavy_at = len(light) + np.append(0, np.cumsum(sets.size - light_size))
    out = []
    for use, scheme in ((some, band), (larger, band + 1)):
        chosen = np.flatnonzero(use)
        if not len(chosen):
            continue
        size, scheme = light_size[chosen], scheme[chosen]
        row, grams = np.repeat(np.arange(len(chosen)), size), light[ragged_range(light_at[:-1][chosen], size)]
        filled = np.zeros(len(chosen), np.int64)
        if len(grams):
            part = ((grams >> _U(32)) * parts[scheme].astype(np.uint64)[row]) >> _U(32)
            new = np.flatnonzero(np.append(True, (row[1:] != row[:-1]) | (part[1:] != part[:-1])))
            total, who = np.add.reduceat(mix(grams), new), row[new]
            tag = scheme[who].astype(np.uint64) * _U(0x9FB21C651E98DF25) + part[new] * _U(0xD6E8FEB86659FD93)
            out.append((chosen[who], mix(total ^ mix(tag)), (scheme[who] & 1).astype(np.uint64)))
            filled = np.bincount(who, minlength=len(chosen))
        sparse = chosen[parts[scheme] - filled > slacks[scheme] + 1 - AGREE]
        if len(sparse):
            count = sets.size[sparse] - -(-sets.size[sparse] * num // den) + 1
            first = np.minimum(count, light_size[sparse])
            at = np.concatenate([ragged_range(light_at[:-1][sparse], first), ragged_range(heavy_at[:-1][sparse], count - first)])
            who = np.concatenate([np.repeat(sparse, first), np.repeat(sparse, count - first)])
            out.append((who, mix(members[at] ^ _U(0x3C6EF372FE94F82B)), np.full(len(at), 2, np.uint64)))
    rows, sigs, kinds = (np.concatenate(x) for x in zip(*out, strict=True))
    order = np.argsort(rows, kind="stable")
    return rows[order], sigs[order], kinds[order]


def bucket_edges(owner: np.ndarray, key: np.ndarray, kind: np.ndarray) -> pd.DataFrame:
    """(a, b, kind, n): agreements n of pairs a < b in small buckets, and stars (n = ``AGREE``) of large ones."""
    order = np.lexsort((owner, key))
    owner, key, kind = owner[order], key[order], kind[order]
    if len(key):  # a set counts once in a bucket
        once = np.append(True, (key[1:] != key[:-1]) | (owner[1:] != owner[:-1]))
        owner, key, kind = owner[once], key[once], kind[once]
    start = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, int)
    size = np.diff(np.append(start, len(key)))
    rows = [np.zeros((0, 4), np.int64)]
    for m in np.unique(size[(size > 1) & (size <= SMALL_BUCKET)]).tolist():
        at = start[size == m][:, None]
        i, j = np.triu_indices(m, 1)
        k = np.broadcast_to(kind[at], (len(at), len(i))).ravel()
        rows.append(np.stack([owner[at + i].ravel(), owner[at + j].ravel(), k, np.where(k == 2, AGREE, 1)], 1))
    large = np.flatnonzero(size > SMALL_BUCKET)
    if len(large):
        at, center = ragged_range(start[large] + 1, size[large] - 1), np.repeat(owner[start[large]], size[large] - 1)
        rows.append(np.stack([center, owner[at], np.full(len(at), 2), np.full(len(at), AGREE)], 1))
    found = pd.DataFrame(np.concatenate(rows), columns=["a", "b", "kind", "n"])
    return found.groupby(["a", "b", "kind"], as_index=False, sort=False)["n"].sum()


def candidate_edges(docs: DataFrame, n: int, num: int, den: int, frequent: np.ndarray) -> DataFrame:
    """Edges (a, b) between set ids that may be linked, connecting all sets that are."""
    tiles = tiles_for(docs, CHARS_PER_TILE)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = Packer(tiles)
        for batch in batches:
            for _, _, data, rows in text_chunks(text_array(batch)):
                sets = Sets(data, rows, n)
                _, first = np.unique(sets.key, return_index=True)  # equal sets of a run send once
                once = np.zeros(len(sets.size), bool)
                once[first] = True
                row, sig, kind = signatures(sets, num, den, frequent)
                keep = once[row]
                row, sig, kind = row[keep], sig[keep], kind[keep]
                # 14 bits more than the tile's 32, so that unrelated sets hardly ever meet; two bits for the kind
                if packer.add(sets.key[row], sig, (sig >> _U(32) & _U(0x3FFF) | kind << _U(14)).astype("<u2")):
                    yield packer.pack()
        if (last := packer.pack()) is not None:
            yield last

    def meet(part: pd.DataFrame) -> pd.DataFrame:
        owner, low, more = unpack(part, "<u2")
        found = bucket_edges(owner, low.astype(np.uint64) | more.astype(np.uint64) << _U(32), more.astype(np.int64) >> 14)
        values = np.empty(len(found), _PAIR)
        values["b"], values["kind"], values["n"] = found["b"], found["kind"], found["n"]
        return packed_home(found["a"].to_numpy(np.int64), values, tiles)

    def total(part: pd.DataFrame) -> pd.DataFrame:
        owner, values, _ = unpack(part, kind=_PAIR)
        found = pd.DataFrame({"a": owner, "b": values["b"], "kind": values["kind"], "n": values["n"]})
        sums = found.groupby(["a", "b", "kind"], as_index=False, sort=False)["n"].sum()
        return sums.loc[sums["n"] >= AGREE, ["a", "b"]].drop_duplicates()

    sent = docs.select("text").mapInArrow(send, TILE_SCHEMA)
    return sent.groupBy("tile").applyInPandas(meet, TILE_SCHEMA).groupBy("tile").applyInPandas(total, "a long, b long")


_PAIR = np.dtype([("b", "<i8"), ("kind", "<i4"), ("n", "<i4")])


# ------------------------------------------------------------- verification
def bitmaps(grams: list[np.ndarray]) -> np.ndarray:
    """One row of 64-bit words per set; every member sets one hashed bit."""
    largest = max(len(g) for g in grams)
    bits = 1 << max(9, min(16, (2 * largest).bit_length()))
    out, row = np.empty((len(grams), bits // 8), np.uint8), np.zeros(bits, bool)
    for i, g in enumerate(grams):
        at = ((g >> _U(3)) & _U(bits - 1)).astype(np.int64)
        row[at] = True
        out[i] = np.packbits(row)
        row[at] = False
    return out.view(np.uint64)


class Forest:
    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, x: int) -> int:
        up = self.up
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x


def unit_links(ids: np.ndarray, grams: list[np.ndarray], side: np.ndarray, label: np.ndarray, num: int, den: int) -> list[tuple[int, int]]:
    """(label, least label) for the labels that links inside the unit connect.

    ``side``: 0 or 1; with both present only pairs across sides are compared.
    ``label``: component known so far; pairs of one component are skipped.
    """
    size = np.array([len(g) for g in grams])
    order = np.lexsort((ids, size))
    ids, size, side, label = ids[order], size[order], side[order], label[order]
    grams = [grams[i] for i in order]
    maps, forest = bitmaps(grams), Forest(len(ids))
    _, group = np.unique(label, return_inverse=True)
    first: dict[int, int] = {}
    for i, g in enumerate(group.tolist()):
        forest.up[i] = first.setdefault(g, i)
    across = len(np.unique(side)) > 1
    root = np.array([forest.find(i) for i in range(len(ids))])
    for i in range(1, len(ids)):
        lo = int(np.searchsorted(size, -(-int(size[i]) * num // den)))
        near = np.arange(lo, i)
        near = near[root[near] != root[i]]
        if across:
            near = near[side[near] != side[i]]
        if not len(near):
            continue
        mine, other = maps[i], maps[near]
        lack_other = np.bitwise_count(mine & ~other).sum(1, dtype=np.int64)
        lack_mine = np.bitwise_count(other & ~mine).sum(1, dtype=np.int64)
        bound = np.minimum(size[i] - lack_other, size[near] - lack_mine)
        need = -(-num * (size[i] + size[near]) // (num + den))
        for j in near[bound >= need].tolist():
            if root[j] == root[i]:
                continue
            shared = len(np.intersect1d(grams[i], grams[j], assume_unique=True))
            if den * shared >= num * (len(grams[i]) + len(grams[j]) - shared):
                root[root == root[j]] = root[i]
    found = pd.DataFrame({"root": root, "label": label}).drop_duplicates()
    found["least"] = found.groupby("root")["label"].transform("min")
    found = found[found["label"] != found["least"]]
    return list(zip(found["label"].tolist(), found["least"].tolist(), strict=True))


def verified_links(members: DataFrame, num: int, den: int, labels: DataFrame | None = None) -> DataFrame:
    """Stars (a: label, b: least label) of the links inside units.  ``members``: unit, set_id, side, grams (binary of sorted uint64);
    ``labels``: of_unit, of_set, label of the sets whose label is not their own id.  Only the former are large, and are shuffled once."""

    def check(part: pd.DataFrame, named: pd.DataFrame | None = None) -> pd.DataFrame:
        part = part.drop_duplicates(["set_id", "side"])
        if not len(part):
            return pd.DataFrame({"a": [], "b": []}, dtype="int64")
        ids = part["set_id"].to_numpy()
        known = {} if named is None else dict(zip(named["of_set"].tolist(), named["label"].tolist(), strict=True))
        label = np.array([known.get(i, i) for i in ids.tolist()], np.int64)
        grams = [np.frombuffer(g, "<u8") for g in part["grams"]]
        links = unit_links(ids, grams, part["side"].to_numpy(), label, num, den)
        return pd.DataFrame(links, columns=["a", "b"], dtype="int64")

    if labels is None:
        return members.groupBy("unit").applyInPandas(lambda part: check(part), "a long, b long")
    return members.groupBy("unit").cogroup(labels.groupBy("of_unit")).applyInPandas(lambda part, named: check(part, named), "a long, b long")


def row_filter(rids: DataFrame, rows: int) -> np.ndarray:
    """Bloom filter (bytes) of the column ``rid`` of about ``rows`` rows; each sets two bits, chosen by the halves of its hash."""
    bits = min(FILTER_MOST, 1 << max(15, (FILTER_BITS * rows - 1).bit_length()))
    halves = F.array(F.col("rid"), F.shiftrightunsigned("rid", 32))
    at = rids.select(F.explode(halves).alias("at")).select((F.col("at").bitwiseAND(bits - 1) + 1).alias("at"))  # bitmaps count from 1
    found = at.groupBy(F.bitmap_bucket_number("at").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("bits"))
    out = np.zeros((bits >> 15, 1 << 12), np.uint8)
    for r in found.toLocalIterator():
        out[r.bucket - 1] = np.frombuffer(r.bits, np.uint8)
    return out.ravel()


def passes(row_filter: np.ndarray, rids: np.ndarray) -> np.ndarray:
    """True for every row of a ``row_filter``, and for few others."""
    rids, mask = rids.view(np.uint64), _U(8 * len(row_filter) - 1)
    got = np.ones(len(rids), bool)
    for at in (rids & mask, rids >> _U(32) & mask):
        got &= (row_filter[at >> _U(3)] >> (at & _U(7)).astype(np.uint8) & 1).astype(bool)
    return got


def gram_arrays(docs: DataFrame, n: int, wanted: np.ndarray) -> DataFrame:
    """set_id, n_shingles, grams (binary of sorted uint64) of the rows (rid, text) that pass the ``row_filter`` wanted."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(pa.array(passes(wanted, batch.column("rid").to_numpy())))
            for _, _, data, rows in text_chunks(text_array(batch)):
                sets = Sets(data, rows, n)
                raw = sets.grams.astype("<u8").tobytes()
                packed = [raw[8 * a:8 * b] for a, b in zip(sets.at[:-1].tolist(), sets.at[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(sets.key), pa.array(sets.size), pa.array(packed, pa.binary())],
                                                 names=["set_id", "n_shingles", "grams"])

    return docs.select("rid", "text").mapInArrow(scan, "set_id long, n_shingles long, grams binary")


def similar_sets(docs: DataFrame, sets: DataFrame, n: int, num: int, den: int) -> DataFrame:
    """(node, component) of the set ids that are linked with another set.  ``docs`` has doc_id, text, rid."""
    clusters = work_table(connected_components(candidate_edges(docs, n, num, den, frequent_grams(sets))), "clusters")
    if clusters.isEmpty():
        return clusters
    firsts = sets.filter("n_shingles > 0").groupBy("set_id").agg(F.min("rid").alias("rid"))
    wanted = firsts.join(clusters.withColumnRenamed("node", "set_id"), "set_id").select("rid")
    # texts are not shuffled to find those of clusters; the join with the clusters drops what the filter passes besides
    grams = gram_arrays(docs, n, row_filter(wanted, clusters.count())).dropDuplicates(["set_id"])
    counts = clusters.groupBy("component").agg(F.count(F.lit(1)).alias("sets_in"))
    placed = grams.join(clusters.join(counts, "component").select(F.col("node").alias("set_id"), F.col("component").alias("cluster"), "sets_in"),
                        "set_id")
    band = F.when(F.col("sets_in") > UNIT_SETS, F.floor(F.log("n_shingles") / math.log(den / num))).otherwise(0)
    placed = work_table(placed.withColumn("band", band.cast("int")), "grams")
    per_band = placed.groupBy("cluster", "band").agg(F.count(F.lit(1)).alias("in_band"))
    blocks = F.ceil(F.col("in_band") / UNIT_SETS).cast("int")
    units = placed.filter(F.col("sets_in") > UNIT_SETS).join(per_band.withColumn("blocks", blocks), ["cluster", "band"]).select(
        "set_id", "grams", "cluster", "band", F.pmod(F.xxhash64("set_id"), F.col("blocks")).cast("int").alias("block"))
    small = placed.filter(F.col("sets_in") <= UNIT_SETS).select("set_id", "grams", "cluster", "band", F.lit(0).alias("block"))
    unit = F.concat_ws("/", "cluster", "band", "block")
    own = small.unionByName(units).select(unit.alias("unit"), "set_id", F.lit(0).alias("side"), "grams")
    stars = work_table(verified_links(own, num, den), "links")  # a set is in one unit: these are components
    named = stars.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
        stars.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
    if counts.filter(F.col("sets_in") > UNIT_SETS).isEmpty():
        release(placed)
        return named
    units = work_table(units, "units")
    release(placed)
    return _across_units(units, named, num, den)


def _across_units(units: DataFrame, named: DataFrame, num: int, den: int) -> DataFrame:
    """Components after the units of large clusters are compared with each other."""
    ids = units.select("set_id", "cluster", "band", "block")
    for ring in (True, False):
        labelled = ids.join(named.withColumnRenamed("node", "set_id"), "set_id", "left").withColumn(
            "label", F.coalesce("component", "set_id"))
        cut = labelled.groupBy("cluster", "band", "block").agg(F.min("label").alias("lo"), F.max("label").alias("hi"))
        a, b = cut.alias("a"), cut.alias("b")
        order = F.struct("a.band", "a.block") < F.struct("b.band", "b.block")
        fits = F.col("b.band") - F.col("a.band") <= 1
        pairs = a.join(b, (F.col("a.cluster") == F.col("b.cluster")) & order & fits)
        if ring:  # neighbours only: enough where a cluster is one component
            same = (F.col("a.band") == F.col("b.band")) & (F.col("b.block") == F.col("a.block") + 1)
            pairs = pairs.filter(same | ((F.col("a.band") < F.col("b.band")) & (F.col("a.block") == 0) & (F.col("b.block") == 0)))
        one = (F.col("a.lo") == F.col("a.hi")) & (F.col("b.lo") == F.col("b.hi")) & (F.col("a.lo") == F.col("b.lo"))
        pairs = pairs.filter(~one).select(
            F.col("a.cluster").alias("cluster"), F.concat_ws("/", "a.cluster", "a.band", "a.block", "b.band", "b.block").alias("unit"),
            F.explode(F.array(F.struct(F.col("a.band").alias("band"), F.col("a.block").alias("block"), F.lit(0).alias("side")),
                              F.struct(F.col("b.band").alias("band"), F.col("b.block").alias("block"), F.lit(1).alias("side")))).alias("u"))
        pairs = work_table(pairs.select("unit", "cluster", "u.*"), "pairs")  # a few per block: its size is known when the sets are joined
        members = units.join(pairs, ["cluster", "band", "block"]).select("unit", "set_id", "side", "grams")
        renamed = labelled.filter(F.col("label") != F.col("set_id")).join(pairs, ["cluster", "band", "block"]).select(
            F.col("unit").alias("of_unit"), F.col("set_id").alias("of_set"), F.col("label").alias("label"))
        links = work_table(verified_links(members, num, den, renamed), "links")
        if links.isEmpty():
            continue
        merged = work_table(connected_components(links), "merged")  # of components, not of sets
        alone = merged.select("node", F.col("node").alias("component")).join(named, "node", "left_anti")
        moved = merged.select(F.col("node").alias("component"), F.col("component").alias("into"))
        named = work_table(named.unionByName(alone).join(moved, "component", "left").select("node", F.coalesce("into", "component").alias("component")), "named")
    return named


def ngram_groups(docs: DataFrame, n: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """doc_id, rid, n_shingles, component_id (least doc_id), component (a set id) per row: link when Jaccard >= num / den over word n-grams."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), row_key().alias("rid"))
    sets = work_table(sets_of_texts(rows, n), "sets")
    linked = similar_sets(rows, sets, n, num, den)
    nodes = sets.filter("n_shingles > 0").groupBy("set_id").agg(F.min("doc_id").alias("least"))
    named = nodes.join(linked.withColumnRenamed("node", "set_id"), "set_id", "left").withColumn("component", F.coalesce("component", "set_id"))
    least = named.groupBy("component").agg(F.min("least").alias("component_id"))
    member = named.select("set_id", "component").join(least, "component")
    blank = sets.filter("n_shingles = 0").withColumn("component_id", F.col("doc_id")).withColumn("component", F.lit(None).cast("long"))
    full = sets.filter("n_shingles > 0").join(member, "set_id")
    cols = ["doc_id", "rid", "n_shingles", "component_id", "component"]
    return full.select(cols).unionByName(blank.select(cols))


def ngram_dedup(docs: DataFrame, n: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """The rows of ``docs`` that stay: the smallest doc_id of each group, and every text without words (repeated rows once)."""
    rid = fresh_name(docs, "__rid")
    groups = work_table(ngram_groups(docs, n, num, den), "groups")
    order = F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("rid"))
    first = groups.filter("n_shingles > 0").groupBy("component").agg(F.min(order).alias("first")).select(F.col("first.rid").alias(rid))
    stay = first.unionByName(groups.filter("n_shingles = 0").select(F.col("rid").alias(rid)))
    return docs.withColumn(rid, row_key()).join(stay, rid, "left_semi").dropDuplicates([rid]).select(*docs.columns)
