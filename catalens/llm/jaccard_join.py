"""Exact Jaccard join of documents' word n-grams as a metric-space join with pivots.

1 - J is a metric. Documents with equal sets are one class; classes are the points.

*Regions.* A point with n shingles that reaches the threshold with another shares one of its first
n - ceil(t n) + 1 shingles in any fixed order with it. The first shingles of all points meet in Spark; those that
two points or more have, split where sizes leave a gap that no link can bridge, are the regions: every link lies
in one of them. The order puts shingles last that a bounded sample finds in many documents, so a passage that many
documents share makes no region unless they consist of it. (Document pivots alone cannot cut the corpus: nearly all
points lie at distance 1 from any of them.) Sizes say how many first shingles a linked pair has in common; regions are
cut into groups that pairs with as many connect, so passages that only some documents share do not join them.

*Leaves.* Regions that share points are joined together. Where such a union has at most ``leaf_shingles`` shingles,
its points and regions come to one task, which takes them in turn as pivots: a pivot is compared exactly with the
later members of its regions that no link has joined to it yet (the rest of its ball needs no comparison), less
those that the triangle inequality excludes by their distances to earlier pivots.

*Pivots.* Larger unions are cut further: their regions are joined recursively by Spark. Each round takes one, two, four ... points of every region as pivots and
computes each member's exact distance to them. A member within the radius r of a pivot is linked to it, so two
members of a pivot's ball are in one component whatever their own distance. What may still matter goes to the
next round: members outside all balls, and, by the triangle inequality, those members of balls that have, for each
of their pivots and at distance d from it, a member within d + r of that pivot that no link found so far leads to,
be it outside all balls or in another one. A region whose members are in one component is done. Regions of up to
``leaf`` members compare all. Rounds go on until no region is left; no pair within a ball is ever formed.

Words are what lies between space, tab, line feed, vertical tab, form feed and carriage return, A-Z in lower
case. A text of fewer than ``words`` words is one shingle; null texts and texts without a word have an empty set and
link with nothing. Rows with equal or null ids are rows of their own. Shingles are 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.materialize import materialize
from .blocks import from_six_bytes, packed, parted, six_bytes, unpacked
from .common import among, arrow_of, importable, reclaim, two_columns
from .components import components
from .hashing import LOWER, Runs, mix, word_hashes
from .repeats import groups

SAMPLE_ROWS, SAMPLE_HITS, COMMON_LIMIT = 16_384, 3, 1 << 18
BROADCAST_IDS = 1_000_000  # ids of 8 bytes that may be sent to every executor
CHUNK_BYTES = 2 << 20


def chunks(batches: Iterator[pa.RecordBatch], chunk_bytes: int = CHUNK_BYTES):
    """``(keys, texts)`` of about ``chunk_bytes`` each."""
    keys, texts, size = [], [], 0
    for batch in batches:
        for key, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary())):
            text = text.as_py() or b""
            if keys and size + len(text) > chunk_bytes:
                yield keys, texts
                keys, texts, size = [], [], 0
            keys.append(key)
            texts.append(text)
            size += len(text)
    if keys:
        yield keys, texts


def shingle_sets(texts: list[bytes], words: int, common: np.ndarray | None = None):
    """``(hashes, ends)``: the distinct shingles of each text, common ones last, and where each text's end."""
    ends = np.cumsum([len(x) for x in texts], dtype=np.int64)
    data = LOWER[np.frombuffer(b"".join(texts), np.uint8)]
    hashes, starts, _ = word_hashes(data, ends)
    stop = np.searchsorted(starts, ends)
    begin = np.concatenate([[0], stop[:-1]])
    owner = np.repeat(np.arange(len(texts)), stop - begin)
    runs = Runs(hashes)
    shingle = runs.all(words)
    whole = np.arange(words, words + len(shingle)) <= stop[owner[: len(shingle)]]
    short = np.flatnonzero((stop > begin) & (stop - begin < words))
    value = np.concatenate([shingle[whole], runs.at(begin[short], stop[short])])
    owner = np.concatenate([owner[: len(shingle)][whole], short])
    if common is not None and len(common):
        late = common[np.minimum(np.searchsorted(common, value), len(common) - 1)] == value
        order = np.lexsort((value, late, owner))
    else:
        order = np.lexsort((value, owner))
    value, owner = value[order], owner[order]
    new = groups(owner, value)
    value, owner = value[new], owner[new]
    return value, np.searchsorted(owner, np.arange(len(texts)), "right")


def set_names(value: np.ndarray, ends: np.ndarray):
    """Two 64-bit sums over each set that name it."""
    begin = np.concatenate([[0], ends[:-1]]).astype(np.int64)
    out = []
    for salt in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9):
        total = np.concatenate([[np.uint64(0)], np.cumsum(mix(value ^ np.uint64(salt)), dtype=np.uint64)])
        out.append((total[ends] - total[begin]).astype(np.int64))
    return out


def common_shingles(df: DataFrame, words: int) -> np.ndarray:
    """Shingles that several documents of a bounded sample have. They only set the order of shingles."""
    ids = df.select("key").orderBy(F.xxhash64("key"), "key").limit(SAMPLE_ROWS)

    def run(batches):
        for _, texts in chunks(batches):
            value, _ = shingle_sets(texts, words)
            value, n = np.unique(value, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(value.astype(np.int64)), pa.array(n)], names=["h", "n"])

    counted = df.join(F.broadcast(ids.distinct()), "key").mapInArrow(run, "h bigint, n bigint")
    many = counted.groupBy("h").agg(F.sum("n").alias("n")).where(F.col("n") >= SAMPLE_HITS)
    rows = many.orderBy(F.desc("n"), "h").limit(COMMON_LIMIT).toPandas()
    return np.sort(rows["h"].to_numpy(np.int64).astype(np.uint64))


def sketches(df: DataFrame, words: int, percent: int, common: np.ndarray) -> DataFrame:
    """``key, n, a, b, first``: size, name and first shingles of every document's set."""
    schema = "key bigint, n bigint, a bigint, b bigint, first binary"
    target = arrow_of(schema)

    def run(batches):
        for keys, texts in chunks(batches):
            value, ends = shingle_sets(texts, words, common)
            begin = np.concatenate([[0], ends[:-1]])
            n = ends - begin
            prefix = n - (percent * n + 99) // 100 + 1
            short = mix(value + np.uint64(0x632BE59BD9B4E019)) >> np.uint64(16)
            first = [six_bytes(short[s : s + p]) if p > 0 and m else b"" for s, p, m in zip(begin, prefix, n)]
            columns = [keys, n, *set_names(value, ends), first]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, target)], schema=target)

    return df.mapInArrow(run, schema)


def pair_counts(region: np.ndarray, point: np.ndarray, n: np.ndarray, percent: int, most: int):
    """``x, nx, y, ny, count``: pairs of fitting sizes within regions (sorted) of up to ``most`` members, x < y."""
    found = [np.zeros((2, 0), np.int64)]
    for step in range(1, most):
        at = np.flatnonzero(region[step:] == region[:-step])
        to = at + step
        fits = (np.minimum(n[at], n[to]) * 100 >= np.maximum(n[at], n[to]) * percent) & (point[at] != point[to])
        at, to = at[fits], to[fits]
        low = np.where(point[at] < point[to], at, to)
        found.append(np.stack([low, at + to - low]))
    a, b = np.concatenate(found, 1)
    order = np.lexsort((point[b], point[a]))
    a, b = a[order], b[order]
    start = np.flatnonzero(groups(point[a], point[b]))
    return point[a[start]], n[a[start]], point[b[start]], n[b[start]], np.diff(start, append=len(a))


def shared_regions(points: DataFrame, percent: int, parts: int, paired: int) -> DataFrame:
    """The first shingles that several points of fitting sizes have.

    ``region, point, n`` for regions of more than ``paired`` members, ``point, n, other, other_n, shared`` for pairs in
    smaller ones.
    """
    request = "part bigint, keys binary, more binary"
    target = arrow_of(request)
    out_schema = "region bigint, point bigint, n bigint, other bigint, other_n bigint, shared bigint"
    out = arrow_of(out_schema)

    def put(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                some = batch.slice(at, 2000)
                point, n = (some.column(i).to_numpy() for i in (0, 1))
                blobs = some.column(2).to_pylist()
                sizes = [len(x) // 6 for x in blobs]
                keys = from_six_bytes(b"".join(blobs))
                order = np.argsort(keys, kind="stable")
                keys, owner = keys[order], np.repeat(np.arange(len(blobs)), sizes)[order]
                cuts = parted(keys, parts)
                rows = [
                    (i, six_bytes(keys[a:b]), packed(point[owner[a:b]]) + packed(n[owner[a:b]]), len(packed(point[owner[a:b]])))
                    for i, (a, b) in enumerate(zip(cuts, cuts[1:])) if a < b
                ]
                columns = [[r[0] for r in rows], [r[1] for r in rows], [r[3].to_bytes(4, "little") + r[2] for r in rows]]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, target)], schema=target)

    def meet(table: pa.Table) -> pa.Table:
        keys = np.concatenate([from_six_bytes(x) for x in table.column("keys").to_pylist()])
        point, n = [], []
        for blob in table.column("more").to_pylist():
            cut = 4 + int.from_bytes(blob[:4], "little")
            point.append(unpacked(blob[4:cut], np.int64))
            n.append(unpacked(blob[cut:], np.int64))
        point, n = np.concatenate(point), np.concatenate(n)
        order = np.lexsort((point, n, keys))
        keys, point, n = keys[order], point[order], n[order]
        new = groups(keys)
        new[1:] |= percent * n[1:] > 100 * n[:-1]  # no smaller one can link with this or a larger one
        region = np.cumsum(new) - 1
        members = np.bincount(region)[region]
        large, small = members > paired, (members > 1) & (members <= paired)
        name = mix(keys + region.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)).astype(np.int64)
        # chains of one key get names of their own; their numbers start anew in each part, the keys do not
        x, nx, y, ny, shared = pair_counts(region[small], point[small], n[small], percent, paired)
        none = [pa.nulls(int(large.sum()), pa.int64())] * 3
        whole = pa.Table.from_arrays([*(pa.array(c[large]) for c in (name, point, n)), *none], schema=out)
        pairs = [pa.nulls(len(x), pa.int64()), *(pa.array(c, pa.int64()) for c in (x, nx, y, ny, shared))]
        return pa.concat_tables([whole, pa.Table.from_arrays(pairs, schema=out)])

    return points.mapInArrow(put, request).groupBy("part").applyInArrow(meet, out_schema)


def least_shared(n: np.ndarray, other: np.ndarray, percent: int) -> np.ndarray:
    """How many first shingles sets of these sizes have in common if they reach the threshold."""
    behind = -(-percent * np.maximum(n, other) // 100) - 1
    return -(-percent * (n + other) // (100 + percent)) - behind


def candidate_groups(n: np.ndarray, regions: list[np.ndarray], percent: int) -> np.ndarray:
    """For each point (sizes ascending) the least one that pairs with enough regions in common lead to."""
    count = len(n)
    owner = np.repeat(np.arange(count), [len(x) for x in regions])
    number = np.unique(np.concatenate(regions), return_inverse=True)[1]
    by_region = np.lexsort((owner, number))
    members, number_of = owner[by_region], number[by_region]
    region_end = np.searchsorted(number_of, np.arange(number_of[-1] + 1), "right")[number_of]
    place = np.empty(len(owner), np.int64)
    place[by_region] = np.arange(len(owner))
    at = np.cumsum([0] + [len(x) for x in regions])
    most = np.searchsorted(n, n * 100 // percent, "right")
    group = np.arange(count)
    for i in range(count):
        own = place[at[i] : at[i + 1]]
        later = [members[p + 1 : e] for p, e in zip(own.tolist(), region_end[own].tolist()) if p + 1 < e]
        if not later:
            continue
        later = np.concatenate(later)
        later = later[(later < most[i]) & (later > i) & (group[later] != group[i])]
        others, shared = np.unique(later, return_counts=True)
        for j in others[shared >= least_shared(n[i], n[others], percent)].tolist():
            if group[i] != group[j]:
                low, high = sorted((group[i], group[j]))
                group[group == high] = low
    return group


def refined(large: DataFrame, lists: DataFrame, percent: int, widest: int, part_entries: int = 400_000) -> DataFrame:
    """``region, point, n``: the regions cut into groups of points that pairs with enough regions in common connect.

    A passage that some documents share makes many regions of them, yet too few for a link. Each region comes, with those
    that have the same least member in a fixed order, to a task that gets the numbers of all regions of its points: short
    lists in place of the sets. Regions of more than ``widest`` members are left as they are. ``lists`` holds
    ``point, n, numbers`` for the points of ``large``.
    """
    least = F.min(F.struct(F.xxhash64("point").alias("order"), "point"))
    sizes = large.groupBy("region").agg(F.count("*").alias("members"), least["point"].alias("home"))
    sizes = materialize(sizes, "sizes")
    homes = large.join(sizes.where(F.col("members") <= widest), "region").select("home", "point").distinct()
    homes = materialize(homes.join(lists, "point").select("home", "point", "n", "numbers"), "homes")
    total = homes.agg(F.coalesce(F.sum(F.size("numbers")), F.lit(0))).first()[0]
    parts = max(1, -(-total // part_entries))
    schema = "region bigint, point bigint, n bigint"
    target = arrow_of(schema)

    def run(table: pa.Table) -> pa.Table:
        home, point, n = (table.column(c).to_numpy() for c in ("home", "point", "n"))
        numbers = table.column("numbers").combine_chunks()
        ends = numbers.offsets.to_numpy()
        flat = numbers.values.to_numpy()
        order = np.lexsort((point, n, home))
        cuts = [0, *(np.flatnonzero(np.diff(home[order])) + 1).tolist(), len(order)]
        out = [np.zeros((3, 0), np.int64)]
        for a, b in zip(cuts, cuts[1:]):
            some = order[a:b]
            group = candidate_groups(n[some], [flat[ends[k] : ends[k + 1]] for k in some.tolist()], percent)
            total = np.zeros(len(group), np.uint64)
            np.add.at(total, group, mix(point[some].astype(np.uint64)))  # equal groups have one name wherever they are found
            kept = np.bincount(group, minlength=len(group))[group] > 1
            out.append(np.stack([total.astype(np.int64)[group[kept]], point[some[kept]], n[some[kept]]]))
        return pa.Table.from_arrays([pa.array(c) for c in np.concatenate(out, 1)], schema=target)

    dealt = homes.select(F.pmod(F.xxhash64("home"), F.lit(parts)).alias("part"), "home", "point", "n", "numbers")
    groups_of = dealt.groupBy("part").applyInArrow(run, schema).distinct()
    wide = large.join(sizes.where(F.col("members") > widest), "region").select("region", "point", "n")
    return groups_of.unionByName(wide)


def possible_regions(met: DataFrame, percent: int, widest: int = 10_000) -> DataFrame:
    """``region, point, n``: the refined large regions of ``shared_regions`` and, as regions of two, pairs that may link."""
    large = met.where(F.col("region").isNotNull()).select("region", "point", "n")
    # numbers of 32 bits: two regions with one number can only add to what a pair seems to share
    lists = materialize(large.groupBy("point", "n").agg(F.collect_list(F.hash("region")).alias("numbers")), "lists")
    pairs = met.where(F.col("region").isNull()).groupBy("point", "n", "other", "other_n").agg(F.sum("shared").alias("shared"))
    more = lists.select("point", F.size("numbers").alias("more"))
    pairs = pairs.join(more, "point", "left").join(more.toDF("other", "other_more"), "other", "left")
    most = F.col("shared") + F.least(F.coalesce("more", F.lit(0)), F.coalesce("other_more", F.lit(0)))
    both = F.expr(f"({percent} * (n + other_n) + {99 + percent}) div {100 + percent}")  # rounded up
    behind = F.expr(f"({percent} * greatest(n, other_n) + 99) div 100 - 1")
    pairs = pairs.withColumn("least", both - behind).where(most >= F.col("least"))
    pairs = materialize(pairs.select("point", "n", "other", "other_n", "shared", "least"), "pairs")
    ends = F.explode(F.array(F.struct("point", "n"), F.struct(F.col("other").alias("point"), F.col("other_n").alias("n"))))
    unsure = pairs.where(F.col("shared") < F.col("least"))
    unsure = unsure.join(lists.select("point", "numbers"), "point")
    unsure = unsure.join(lists.select(F.col("point").alias("other"), F.col("numbers").alias("other_numbers")), "other")
    repeats = F.size("numbers") - F.size(F.array_distinct("numbers"))
    in_common = F.size(F.array_intersect("numbers", "other_numbers")) + repeats
    unsure = unsure.where(F.col("shared") + in_common >= F.col("least")).select(*pairs.columns)
    pairs = pairs.where(F.col("shared") >= F.col("least")).unionByName(unsure)
    pairs = pairs.select(F.xxhash64("point", "other").alias("region"), ends.alias("end"))
    return refined(large, lists, percent, widest).unionByName(pairs.select("region", "end.point", "end.n"))


def full_sets(df: DataFrame, needed: DataFrame, words: int) -> DataFrame:
    """The rows of ``needed`` (``key, a, b`` and more) with ``shingles``, six bytes of each.

    A point comes twice if rows with equal ids have equal texts.
    """
    count = needed.count()
    schema = "key bigint, a bigint, b bigint, shingles binary"
    target = arrow_of(schema)

    def run(batches):
        for keys, texts in chunks(batches):
            value, ends = shingle_sets(texts, words)
            begin = np.concatenate([[0], ends[:-1]])
            blobs = [six_bytes(value[s:e] >> np.uint64(16)) for s, e in zip(begin, ends)]
            columns = [keys, *set_names(value, ends), blobs]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, target)], schema=target)

    if count <= BROADCAST_IDS:
        some = df.join(F.broadcast(needed), df["key"].eqNullSafe(needed["key"]), "left_semi")
    else:  # bits of hashed ids, so that no text is shuffled; what they let through by chance goes at the join below
        bits = 1 << (32 * count).bit_length()
        some = among(df, F.pmod(F.xxhash64("key"), F.lit(bits)), F.pmod(F.xxhash64("key"), F.lit(bits)), needed)
    sets = some.mapInArrow(run, schema).drop("key")
    return sets.join(needed.drop("key"), ["a", "b"]).drop("a", "b")


def overlaps(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """``x, y, common``: exact intersection sizes of pairs of points."""
    schema = "x bigint, y bigint, common bigint"
    target = arrow_of(schema)

    def run(batches):
        for batch in batches:
            common = [
                len(np.intersect1d(from_six_bytes(a), from_six_bytes(b), assume_unique=True))
                for a, b in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())
            ]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(common, pa.int64())], schema=target)

    left = sets.select(F.col("point").alias("x"), F.col("shingles").alias("sx"))
    right = sets.select(F.col("point").alias("y"), F.col("shingles").alias("sy"))
    return pairs.join(left, "x").join(right, "y").select("x", "y", "sx", "sy").mapInArrow(run, schema)


def joined_regions(regions: DataFrame, sets: DataFrame, percent: int, leaf: int = 4) -> DataFrame:
    """``a, b``: links between points, enough to connect all that are linked (see above). One job set a round."""
    links, known, label, pivots = [], None, None, 1
    radius = 1 - percent / 100
    while True:
        order = Window.partitionBy("region").orderBy(F.xxhash64("point"), "point")
        sizes = regions.groupBy("region").agg(F.count("*").alias("members")).where(F.col("members") > 1)
        some = regions.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= max(leaf, pivots))
        some = some.join(sizes, "region")
        chosen = some.where((F.col("members") <= leaf) | (F.col("nth") <= pivots))
        chosen = chosen.select("region", F.col("point").alias("pivot"), F.col("n").alias("pn"), "members")
        met = regions.join(chosen, "region").where(F.col("point") != F.col("pivot"))
        met = met.withColumns({"lo": F.least("n", "pn"), "hi": F.greatest("n", "pn")})
        met = materialize(met, "met")
        fits = F.col("lo") * 100 >= F.col("hi") * percent
        pairs = met.where(fits).select(F.least("point", "pivot").alias("x"), F.greatest("point", "pivot").alias("y")).distinct()
        if known is not None:
            pairs = pairs.join(known, ["x", "y"], "left_anti")
        found = materialize(overlaps(pairs, sets), "overlaps")
        known = found if known is None else known.unionByName(found)
        share = F.col("common") / (F.col("lo") + F.col("hi") - F.col("common"))
        seen = met.join(
            known.withColumnsRenamed({"x": "kx", "y": "ky"}),
            (F.least("point", "pivot") == F.col("kx")) & (F.greatest("point", "pivot") == F.col("ky")), "left",
        )
        linked = F.coalesce(F.col("common") * 100 >= percent * (F.col("lo") + F.col("hi") - F.col("common")), F.lit(False))
        # sizes that do not fit bound the distance from below
        seen = seen.withColumns({"linked": linked, "d": F.coalesce(1 - share, 1 - F.col("lo") / F.col("hi"))})
        seen = materialize(seen.select("region", "point", "n", "pivot", "members", "linked", "d"), "distances")
        links.append(seen.where("linked").select(F.col("point").alias("a"), F.col("pivot").alias("b")).distinct())
        more = links[-1] if label is None else links[-1].unionByName(label.toDF("a", "b"))
        label = materialize(components(more), "labels")
        going = seen.where(F.col("members") > leaf)
        spots = going.select("region", "pivot").distinct().withColumnRenamed("pivot", "point").withColumn("is_pivot", F.lit(True))
        state = going.groupBy("region", "point", "n").agg(F.max("linked").alias("inside"))
        state = state.join(spots, ["region", "point"], "left").where(F.col("is_pivot").isNull()).drop("is_pivot")
        state = state.join(label.toDF("point", "label"), "point", "left").withColumn("label", F.coalesce("label", "point"))
        state = materialize(state, "state")
        labels = state.groupBy("region").agg(F.min("label").alias("least"), F.max("label").alias("most"))
        state = state.join(labels.where(F.col("least") < F.col("most")).select("region"), "region")
        outside = state.where(~F.col("inside")).select("region", "point", "n")
        own = label.toDF("pivot", "own")
        apart = going.join(state.select("region", "point", "label"), ["region", "point"]).join(own, "pivot", "left")
        apart = apart.where(F.col("label") != F.coalesce("own", "pivot"))
        nearest = apart.groupBy("region", "pivot").agg(F.min("d").alias("least"))
        edge = (
            going.where("linked").join(state.select("region", "point"), ["region", "point"])
            .join(nearest, ["region", "pivot"], "left")
            .groupBy("region", "point", "n")
            .agg(F.min(F.coalesce(F.col("d") + radius >= F.col("least") - 1e-9, F.lit(False))).alias("near"))
            .where("near").select("region", "point", "n")
        )
        regions = materialize(outside.unionByName(edge), "regions")
        reclaim(regions.sparkSession)
        if regions.isEmpty():
            break
        pivots *= 2
    out = links[0]
    for more in links[1:]:
        out = out.unionByName(more)
    return out


def numbered(sets: list[np.ndarray], step: int = 1 << 20) -> np.ndarray:
    """The sets one after the other, every different value replaced by its rank; the list is emptied on the way.

    Values are merged some sets at a time, so that beside the sets there is little more than their different values
    and four bytes for each entry.
    """
    known, waiting, size = np.zeros(0, np.uint64), [], 0
    for i, some in enumerate(sets):
        waiting.append(some)
        size += len(some)
        if size >= step or i + 1 == len(sets):
            known, waiting, size = np.unique(np.concatenate([known, *waiting])), [], 0
    out = np.empty(sum(map(len, sets)), np.int32)
    at = 0
    for i, some in enumerate(sets):
        out[at : at + len(some)] = np.searchsorted(known, some)
        at, sets[i] = at + len(some), known[:0]
    return out


def leaf_links(shingles: list[np.ndarray], regions: list[np.ndarray], percent: int, kept_pivots: int = 16):
    """Links (pairs of positions) that connect all linked points; regions hold the numbers each point lies in."""
    radius, count = 1 - percent / 100, len(shingles)
    n = np.array([len(x) for x in shingles])
    flat = numbered(shingles)
    end = np.cumsum(n)
    begin = end - n
    order = np.lexsort((np.arange(count), n))
    rank = np.empty(count, np.int64)
    rank[order] = np.arange(count)
    owner = np.repeat(np.arange(count), [len(x) for x in regions])
    number = np.unique(np.concatenate(regions), return_inverse=True)[1]
    by_region = np.lexsort((rank[owner], number))
    members, number_of = owner[by_region], number[by_region]
    region_end = np.searchsorted(number_of, np.arange(number_of[-1] + 1), "right")
    place = np.empty(len(owner), np.int64)
    place[by_region] = np.arange(len(owner))
    at = np.cumsum([0] + [len(x) for x in regions])
    group = np.arange(count)  # least position that links found so far lead to
    distance = np.full((kept_pivots, count), np.nan)
    slot, mark, links = 0, np.zeros(flat.max() + 1, bool), []
    for i in order.tolist():
        later = [members[p + 1 : region_end[number_of[p]]] for p in place[at[i] : at[i + 1]].tolist()]
        later = np.unique(np.concatenate(later)) if later else np.zeros(0, np.int64)
        later = later[(n[later] * percent <= n[i] * 100) & (group[later] != group[i])]
        if slot and len(later):
            gap = np.abs(distance[:slot, later] - distance[:slot, i][:, None])
            later = later[~(gap > radius + 1e-9).any(0)]
        if not len(later):
            continue
        sizes = n[later]
        places = np.arange(int(sizes.sum())) + np.repeat(begin[later] - (np.cumsum(sizes) - sizes), sizes)
        own = flat[begin[i] : end[i]]
        mark[own] = True
        common = np.add.reduceat(mark[flat[places]].astype(np.int64), np.cumsum(sizes) - sizes)
        mark[own] = False
        union = sizes + n[i] - common
        if len(later) >= 64 and slot < kept_pivots:
            distance[slot, later], distance[slot, i] = 1 - common / union, 0
            slot += 1
        for j in later[common * 100 >= percent * union].tolist():
            links.append((i, j))
            if group[i] != group[j]:
                low, high = sorted((group[i], group[j]))
                group[group == high] = low
    return links


def leaf_join(entries: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """``a, b``: links within whole unions of regions; a task (``part``) takes several unions and cuts none."""
    schema = "a bigint, b bigint"
    target = arrow_of(schema)

    def run(placed: pa.Table, texts: pa.Table) -> pa.Table:
        point, first = np.unique(texts.column("point").to_numpy(), return_index=True)
        blobs = texts.column("shingles")
        shingles = [from_six_bytes(blobs[i].as_py()) for i in first.tolist()]
        owner, region = placed.column("point").to_numpy(), placed.column("region").to_numpy()
        order = np.argsort(owner, kind="stable")
        cuts = np.searchsorted(owner[order], point)[1:]
        links = np.array(leaf_links(shingles, np.split(region[order], cuts), percent), np.int64).reshape(-1, 2)
        return pa.Table.from_arrays([pa.array(point[links[:, i]]) for i in (0, 1)], schema=target)

    return entries.groupBy("part").cogroup(sets.groupBy("part")).applyInArrow(run, schema)


def all_links(
    docs: DataFrame, rows: DataFrame, regions: DataFrame, words: int, percent: int, leaf_shingles: int, task_shingles: int
) -> DataFrame:
    """Links of all regions: leaves where unions of regions are small enough, rounds of pivots where not."""
    spark = regions.sparkSession
    least = regions.groupBy("region").agg(F.min("point").alias("b"))
    stars = materialize(regions.join(least, "region").select(F.col("point").alias("a"), "b").distinct(), "stars")
    unions = components(stars)
    reclaim(spark)
    sizes = regions.select("point", "n").distinct().join(unions.withColumnsRenamed({"node": "point", "component": "union"}), "point")
    sizes = materialize(sizes, "points")
    weight = materialize(sizes.groupBy("union").agg(F.sum("n").alias("weight")), "weights")
    total, most = weight.agg(F.coalesce(F.sum("weight"), F.lit(0)), F.coalesce(F.max("weight"), F.lit(0))).first()
    parts = max(1, -(-total // task_shingles))
    part = F.when(F.col("weight") <= leaf_shingles, F.pmod(F.xxhash64("union"), F.lit(parts)).cast("int"))
    placed = sizes.join(weight, "union").select("point", part.alias("part"))
    needed = placed.join(rows.select(F.col("row").alias("point"), "key", "a", "b"), "point")
    needed = materialize(needed, "needed")
    reclaim(spark)
    small, own = needed.where(F.col("part").isNotNull()), placed.where(F.col("part").isNotNull())
    entries = regions.join(own, "point").select("part", "point", "region")
    links = materialize(leaf_join(entries, full_sets(docs, small, words), percent), "leaves")
    reclaim(spark)
    if most > leaf_shingles:
        far = needed.where(F.col("part").isNull())
        sets = materialize(full_sets(docs, far.drop("part"), words), "sets")
        far = materialize(regions.join(far.select("point"), "point").select("region", "point", "n"), "large")
        links = links.unionByName(joined_regions(far, sets, percent))
    return links


def jaccard_components(
    df: DataFrame, words: int = 4, percent: int = 85, key: str = "doc_id", text: str = "text", part_keys: int = 400_000,
    leaf_shingles: int = 12_000_000, task_shingles: int = 1_500_000, paired: int = 16,
) -> DataFrame:
    """``key, n_shingles, component_id`` per row: the smallest id that links of J >= percent / 100 lead to."""
    importable(df.sparkSession)
    docs = two_columns(df, key, text)
    common = common_shingles(docs, words)
    rows = sketches(docs, words, percent, common).withColumn("row", F.monotonically_increasing_id())
    rows = materialize(rows, "sketches")
    named = rows.where(F.col("n") > 0)
    classes = named.groupBy("a", "b").agg(F.min("row").alias("point"), F.min("key").alias("least"))
    classes = materialize(classes, "classes")
    points = among(named, F.col("row"), F.col("point"), classes).select(F.col("row").alias("point"), "n", "first")
    total = rows.agg(F.coalesce(F.sum(F.length("first")), F.lit(0))).first()[0] // 6
    met = materialize(shared_regions(points, percent, max(1, -(-total // part_keys)), paired), "met")
    regions = materialize(possible_regions(met, percent), "regions")
    reclaim(df.sparkSession)
    linked = components(all_links(docs, rows, regions, words, percent, leaf_shingles, task_shingles))
    of_point = classes.join(linked.withColumnRenamed("node", "point"), "point", "left")
    of_point = of_point.withColumn("component", F.coalesce("component", "point"))
    least = of_point.groupBy("component").agg(F.min("least").alias("component_id"))
    of_class = of_point.join(least, "component").select("a", "b", "component_id")
    out = named.select("key", "n", "a", "b").join(of_class, ["a", "b"]).select("key", "n", "component_id")
    empty = rows.where(F.col("n") == 0).select("key", "n", F.col("key").alias("component_id"))
    return out.unionByName(empty).toDF(key, "n_shingles", "component_id")
