"""Near-duplicate groups by circulant MinHash, confirmed on full sets.

A document's set holds the hashes of its distinct ``size``-word shingles.
Circulant MinHash uses two permutations of the 32-bit ring: sigma scatters
the shingles, and coordinate k is the least pi((sigma(x) - k) mod 2**32), so
one permutation, circularly shifted, makes all coordinates. ``BANDS`` bands
of ``ROWS`` coordinates propose candidates: a pair of similarity 0.8 is
missed with probability (1 - 0.8**4)**32 < 5e-8.

1. equal sets collapse into classes, the nodes of all that follows;
2. classes that share a band key are joined to the least of the key (a star,
   not all pairs); the components of that graph are families;
3. a family's classes are compared exactly in blocks of ``BLOCK`` classes and
   ``BLOCK_SHINGLES`` shingles on average, each together with the family's
   ``PIVOTS`` pivots (of each hash slot the class with most shared keys): products of 0/1 matrices count the
   intersections, and only a spanning forest of the links leaves the task.
   A family of one block is then settled, and so is one that has become one component;
4. in the others each set is put in one order, by how many pivots have a shingle and then by
   hash, so text common to the family comes last. Two linked sets share one of their first
   n - ceil(0.8 n) + 1 shingles, whatever the order; components that do so form closer families,
   and classes of mere boilerplate fall out;
5. in closer families tiles that hold different components and sizes that can
   still reach the threshold (a fifth apart at most) are compared;
6. the components of all links give the result.

Up to step 4 a class is copied less than twice on average. Step 5 grows with the square of a closer
family: of classes that share rare text, are not linked and do not fall into large components.

Equality of shingles and of sets is equality of 64 and 128-bit hashes.

Defined results: a null text or one without words has an empty set and is
its own component; rows are the documents, so of rows with a repeated id each is
linked by its own text and gives its own output row (all rows of the id that
names a component are kept); rows with a null id are linked with nothing and
come out with a null component, kept; an empty table gives an empty table; extra
columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import runtime, textkit
from .components import EDGES, connected_components
from .textkit import Words, fold, mix, whole

SIZE, THRESHOLD = 4, 80
BANDS, ROWS = 32, 4
BLOCK, BLOCK_SHINGLES, PIVOTS = 64, 400_000, 32
#: Classes of a tile, about.
TILE = 512
_COLUMNS = 2048
V = np.uint32


def _pi(x: np.ndarray) -> np.ndarray:
    """A permutation of 32-bit integers, in place."""
    x *= V(0x85EBCA6B)
    x ^= x >> V(15)
    x *= V(0xC2B2AE35)
    x ^= x >> V(16)
    return x


def signature(shingles: np.ndarray, coordinates: int = BANDS * ROWS) -> np.ndarray:
    """The circulant MinHash of a set of 64-bit hashes."""
    sigma = (shingles >> np.uint64(32)).astype(V)
    out = np.empty(coordinates, V)
    step = max(1, (1 << 15) // max(1, len(sigma)))
    for k in range(0, coordinates, step):
        shift = np.arange(k, min(coordinates, k + step), dtype=V)
        out[k : k + step] = _pi(sigma[None, :] - shift[:, None]).min(axis=1) if len(sigma) <= 1 << 15 else [min(int(_pi(sigma[a : a + (1 << 15)] - s).min()) for a in range(0, len(sigma), 1 << 15)) for s in shift]
    return out


def shingle_sets(column: pa.Array, size: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each row."""
    for _, data, offsets in textkit.chunks(column):
        words = Words(data, offsets, lower=True)
        h = words.hashes()
        all_of = fold(h, size)
        inside = whole(words.counts, size)
        keep = np.flatnonzero(inside)
        first = np.searchsorted(keep, words.first)
        grams = all_of[keep]
        for i, n in enumerate(words.counts.tolist()):
            if n >= size:
                g = np.sort(grams[first[i] : first[i + 1]])
                yield g[np.append(True, g[1:] != g[:-1])]
            elif n:
                own = h[words.first[i] : words.first[i + 1]]
                yield fold(own, n) + np.uint64(n)  # another hash than a full shingle's
            else:
                yield np.zeros(0, np.uint64)


def _profile(size: int, bands: int, rows: int):
    @runtime.releasing
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        salt = np.arange(1, bands + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        for batch in batches:
            n, low, high, keys = [], [], [], []
            for s in shingle_sets(batch.column(1), size):
                n.append(len(s))
                low.append(int(mix(s.copy()).sum(dtype=np.uint64).astype(np.int64)))
                high.append(int(mix(s ^ np.uint64(0xA0761D6478BD642F)).sum(dtype=np.uint64).astype(np.int64)))
                if len(s):
                    sig = signature(s, bands * rows).reshape(bands, rows).astype(np.uint64)
                    keys.append(fold_rows(sig, salt).view(np.int64))
                else:
                    keys.append(np.zeros(0, np.int64))
            lengths = np.cumsum([0, *map(len, keys)]).astype(np.int32)
            flat = np.concatenate(keys) if keys else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(n, pa.int64()), pa.array(low, pa.int64()), pa.array(high, pa.int64()), pa.ListArray.from_arrays(pa.array(lengths), pa.array(flat))], ["doc", "hash", "n", "low", "high", "keys"])

    return run


def fold_rows(sig: np.ndarray, salt: np.ndarray) -> np.ndarray:
    key = salt.copy()
    for r in range(sig.shape[1]):
        key = mix(key * np.uint64(0x9FB21C651E98DF25) + sig[:, r])
    return key


#: What a class's set carries of its place in a family.
_PLACE = ["n", "family", "block", "blocks"]


def _sets(size: int):
    @runtime.releasing
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            grams = pa.array([s.tobytes() for s in shingle_sets(batch.column("text"), size)], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("node"), grams, *(batch.column(c) for c in _PLACE)], ["node", "grams", *_PLACE])

    return run


def links(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, threshold: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i of left, j of right) with 100*|A and B| >= threshold*|A or B|.

    Intersections are counted by products of 0/1 matrices over the shingles
    that two sets share at least, ``_COLUMNS`` at a time.
    """
    sizes = np.array([len(s) for s in sets])
    who = np.repeat(np.arange(len(sets)), sizes)
    values, code, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = np.flatnonzero(count > 1)
    column = np.full(len(values), -1)
    column[shared] = np.arange(len(shared))
    col = column[code]
    who, col = who[col >= 0], col[col >= 0]
    order = np.argsort(col, kind="stable")
    who, col = who[order], col[order]
    inter = np.zeros((len(left), len(right)), np.float32)
    for c in range(0, len(shared), _COLUMNS):
        a, z = np.searchsorted(col, [c, c + _COLUMNS])
        m = np.zeros((len(sets), min(_COLUMNS, len(shared) - c)), np.float32)
        m[who[a:z], col[a:z] - c] = 1
        inter += m[left] @ m[right].T
    inter = inter.astype(np.int64)
    union = sizes[left][:, None] + sizes[right][None, :] - inter
    return np.nonzero((100 * inter >= threshold * union) & (left[:, None] != right[None, :]))


def forest(n: int, pairs: Iterator[tuple[int, int]]) -> list[tuple[int, int]]:
    """The pairs that join parts not yet joined."""
    up = list(range(n))

    def root(x: int) -> int:
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    out = []
    for a, b in pairs:
        ra, rb = root(a), root(b)
        if ra != rb:
            up[max(ra, rb)] = min(ra, rb)
            out.append((a, b))
    return out


def _compare(threshold: int):
    """One unit (a block with its family's pivots, or two tiles) to links (a, b)."""

    @runtime.releasing_group
    def run(table: pa.Table) -> pa.Table:
        nodes = table.column("node").to_numpy()
        side = table.column("side").to_numpy()
        sets = [np.frombuffer(x.as_py(), np.uint64) for x in table.column("grams")]
        left = np.flatnonzero(side == 0)
        right = np.flatnonzero(side == 1) if (side == 1).any() else left
        i, j = links(sets, left, right, threshold)
        kept = forest(len(nodes), zip(left[i].tolist(), right[j].tolist()))
        a, b = (nodes[[p[k] for p in kept]] if kept else np.zeros(0, np.int64) for k in (0, 1))
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return run


def compared(units: DataFrame, threshold: int) -> DataFrame:
    """Links (a, b) of units (family, block, other) of rows (side, node, grams)."""
    return units.groupBy("family", "block", "other").applyInArrow(_compare(threshold), "a long, b long")


def candidate_stars(classes: DataFrame) -> DataFrame:
    """(a, b, shared): classes joined to the least one under a shared band key, and
    how many classes share those keys."""
    bands = classes.select(F.col("node").alias("a"), F.explode("keys").alias("key"))
    heads = bands.groupBy("key").agg(F.min("a").alias("b"), F.max("a").alias("most"), F.count("*").alias("size")).where("b <> most").drop("most")
    return bands.join(heads, "key").where("a <> b").groupBy("a", "b").agg(F.sum("size").alias("shared"))


def _first_shingles(threshold: int):
    """One unit (a block with its family's pivots) to (node, first): the shingles of each class of the
    block of which a linked class must have one among its own."""

    @runtime.releasing_group
    def run(table: pa.Table) -> pa.Table:
        sets = [np.frombuffer(x.as_py(), np.uint64) for x in table.column("grams")]
        is_pivot, own = table.column("pivot").to_pylist(), table.column("own").to_pylist()
        known, count = np.unique(np.concatenate([s for s, p in zip(sets, is_pivot) if p] or [np.zeros(0, np.uint64)]), return_counts=True)
        nodes, first = [], []
        for node, s, mine in zip(table.column("node").to_pylist(), sets, own):
            if not mine:
                continue
            times = np.zeros(len(s), np.int64)
            if len(known):
                at = np.minimum(np.searchsorted(known, s), len(known) - 1)
                times = np.where(known[at] == s, count[at], 0)
            most = len(s) - -(-threshold * len(s) // 100) + 1
            nodes.append(node)
            first.append(s[np.lexsort((s, times))[:most]].view(np.int64))
        return pa.table({"node": pa.array(nodes, pa.int64()), "first": pa.array(first, pa.list_(pa.int64()))})

    return run


def closer_families(state: DataFrame, units: DataFrame, threshold: int) -> DataFrame:
    """``state`` (family, node, n, component) with closer families in place of families: components of which
    some classes share a first shingle. Units are (family, block, node, grams, pivot, own)."""
    first = units.groupBy("family", "block").applyInArrow(_first_shingles(threshold), "node long, first array<long>")
    held = runtime.written(first.join(state.select("family", "node", "component"), "node").select("family", "component", F.explode("first").alias("shingle")), "minhash-first")
    heads = held.groupBy("family", "shingle").agg(F.min("component").alias("b"), F.max("component").alias("top")).where("b <> top").drop("top")
    joined = held.join(heads, ["family", "shingle"]).where("component <> b").select(F.col("component").alias("a"), "b").distinct()
    closer = connected_components(joined).select(F.col("node").alias("component"), F.col("component").alias("closer"))
    return state.join(closer, "component").select(F.col("closer").alias("family"), "node", "n", "component")


def family_links(docs: DataFrame, families: DataFrame, stars: DataFrame, classes: DataFrame, size: int, threshold: int) -> DataFrame:
    """Exact links (a, b) that span every component inside the families (node, component).

    ``docs`` (doc, hash, text); ``classes`` (node, doc, hash, n, ...).
    """
    members = families.join(classes.select("node", "doc", "hash", "n"), "node")
    whole = members.groupBy("component").agg(F.count("*").alias("members"), F.sum("n").alias("shingles"))
    blocks = F.ceil(F.greatest(F.col("members") / BLOCK, F.col("shingles") / BLOCK_SHINGLES)).cast("int")
    whole = whole.select(F.col("component").alias("family"), blocks.alias("blocks"))
    placed = members.withColumnRenamed("component", "family").join(whole, "family").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    few = max(1, -(-families.count() // EDGES))  # files of tables of a row a class or fewer, as in the rounds of components
    placed = runtime.written(placed.coalesce(few), "minhash-families")
    key = F.xxhash64("doc", "hash")
    marked, _ = runtime.split_by_bitmap(docs.withColumn("key", key), "key", runtime.bitmap(placed.select(key.alias("key")), "key"))
    own = placed.select("node", *_PLACE, F.col("doc").alias("own_doc"), F.col("hash").alias("own_hash"))
    texts = marked.join(own, (F.col("doc") == F.col("own_doc")) & (F.col("hash") == F.col("own_hash")))
    texts = texts.dropDuplicates(["own_doc", "own_hash", "node"])  # the join's keys: its texts are not dealt again
    kinds = {f.name: f.dataType.simpleString() for f in placed.schema}
    grams = texts.select("node", "text", *_PLACE).mapInArrow(_sets(size), ", ".join(["node long", "grams binary", *(f"{c} {kinds[c]}" for c in _PLACE)]))
    held = runtime.written(grams, "minhash-sets")
    unit = ["family", "block", "other", "side", "node", "grams"]
    units = held.withColumns({"other": F.lit(-1).cast("long"), "side": F.lit(0).cast("byte"), "block": F.col("block").cast("long")}).select(unit)
    many = held.where("blocks > 1")
    some = not placed.where("blocks > 1").isEmpty()
    if some:
        shared = stars.select(F.explode(F.array("a", "b")).alias("node"), "shared").groupBy("node").agg(F.sum("shared").alias("shared"))
        # the best class of each of PIVOTS slots: a sum that every task begins by itself, so a large family is no large group
        slot = F.pmod(F.xxhash64("node", F.lit(3)), F.lit(PIVOTS))
        best = placed.where("blocks > 1").join(shared, "node").groupBy("family", slot.alias("slot")).agg(F.max_by("node", F.struct("shared", "node")).alias("pivot"))
        pivots = runtime.written(best.select("pivot").coalesce(few), "minhash-pivots")
        copies = many.join(pivots, F.col("node") == F.col("pivot")).select("family", "node", "grams", F.col("block").alias("home"), F.explode(F.expr("sequence(0, blocks - 1)")).alias("block")).where("block <> home")
        units = units.unionByName(copies.withColumns({"other": F.lit(-1).cast("long"), "side": F.lit(0).cast("byte"), "block": F.col("block").cast("long")}).select(unit))
    found = runtime.written(compared(units, threshold), "minhash-links")
    if not some:
        return found
    comp = connected_components(found)
    state = many.select("family", "node", "n").join(comp, "node", "left").withColumn("component", F.coalesce("component", "node"))
    parts = runtime.written(state.groupBy("family", "component").agg(F.count("*").alias("size"), F.sum("n").alias("shingles")).coalesce(few), "minhash-parts")
    open_ = runtime.written(parts.groupBy("family").agg(F.count("*").alias("parts")).where("parts > 1").select("family").coalesce(few), "minhash-open")
    if open_.isEmpty():
        return found
    mine = many.select("family", F.col("block").cast("long").alias("block"), "node", "grams", F.lit(True).alias("own"))
    theirs = copies.select("family", F.col("block").cast("long").alias("block"), "node", "grams", F.lit(False).alias("own"))
    with_pivots = mine.unionByName(theirs).join(open_, "family", "left_semi").join(pivots.select(F.col("pivot").alias("node"), F.lit(True).alias("pivot")), "node", "left").withColumn("pivot", F.coalesce("pivot", F.lit(False)))
    with_pivots = with_pivots.repartition("family", "block")  # else a family's blocks stay together after the join
    state = runtime.written(closer_families(state.join(open_, "family", "left_semi"), with_pivots, threshold), "minhash-closer")
    parts = runtime.written(state.groupBy("family", "component").agg(F.count("*").alias("size"), F.sum("n").alias("shingles")).coalesce(few), "minhash-parts")
    if parts.isEmpty():
        return found
    # a component of many classes has tiles of its own, which need no comparison among each other; sizes
    # n and m can only be linked if their steps of a ratio of the threshold are equal or neighbours
    parts = parts.select("family", "component", F.when(F.col("size") >= TILE, F.col("component")).alias("cell"))
    step = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(100.0 / threshold)))
    cells = state.join(parts, ["family", "component"]).withColumn("step", step)
    sizes = cells.groupBy("family", "cell", "step").agg(F.ceil(F.greatest(F.count("*") / TILE, F.sum("n") / BLOCK_SHINGLES)).alias("tiles"))
    cells = cells.alias("c").join(sizes.alias("s"), (F.col("c.family") == F.col("s.family")) & F.col("c.cell").eqNullSafe(F.col("s.cell")) & (F.col("c.step") == F.col("s.step")))
    tile = F.xxhash64(F.coalesce("c.cell", F.lit(-1)), "c.step", F.pmod(F.xxhash64("c.node"), F.col("tiles")))
    cells = cells.select("c.family", "c.node", "c.cell", "c.step", tile.alias("tile"))
    tiled = runtime.written(many.select("node", "grams").join(cells, "node"), "minhash-tiles")
    tiles = tiled.select("family", "tile", "cell", "step").distinct()
    near = (F.col("x.family") == F.col("y.family")) & (F.col("x.tile") < F.col("y.tile")) & (F.abs(F.col("x.step") - F.col("y.step")) <= 1)
    pairs = tiles.alias("x").join(tiles.alias("y"), near & ~F.coalesce(F.col("x.cell") == F.col("y.cell"), F.lit(False)))
    pairs = runtime.written(pairs.select(F.col("x.family").alias("family"), F.col("x.tile").alias("block"), F.col("y.tile").alias("other")), "minhash-pairs")
    alone = tiles.where("cell is null").select("family", F.col("tile").alias("block"), F.col("tile").alias("other"))
    first = tiled.join(pairs.unionByName(alone).withColumn("tile", F.col("block")), ["family", "tile"]).withColumn("side", F.lit(0).cast("byte"))
    second = tiled.join(pairs.withColumn("tile", F.col("other")), ["family", "tile"]).withColumn("side", F.lit(1).cast("byte"))
    return found.unionByName(compared(first.select(unit).unionByName(second.select(unit)), threshold))


def labelled(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE, threshold: int = THRESHOLD) -> DataFrame:
    """(doc, hash, n, component), a row for each row of ``docs``; ``hash`` is xxhash64 of the text."""
    docs = runtime.bounded_batches(docs)
    docs = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).cast("binary").alias("text"), F.xxhash64(text_col).alias("hash"))
    profiles = runtime.written(docs.mapInArrow(_profile(size, BANDS, ROWS), "doc long, hash long, n long, low long, high long, keys array<long>"), "minhash-profiles")
    linkable = profiles.where("n > 0 and doc is not null")
    equal = linkable.groupBy("n", "low", "high").agg(F.min(F.struct("doc", "hash")).alias("rep"), F.min_by("keys", "doc").alias("keys"))
    classes = runtime.written(equal.select(F.monotonically_increasing_id().alias("node"), "rep.doc", "rep.hash", "n", "low", "high", "keys"), "minhash-classes")
    stars = runtime.written(candidate_stars(classes.select("node", "keys")), "minhash-stars")
    families = connected_components(stars)
    comp = connected_components(family_links(docs, families, stars, classes, size, threshold))
    named = classes.select("node", "doc", "n", "low", "high").join(comp, "node", "left").withColumn("part", F.coalesce("component", "node")).drop("component")
    least = named.groupBy("part").agg(F.min("doc").alias("component"))
    named = named.join(least, "part").select("n", "low", "high", "component")
    rows = profiles.select("doc", "hash", "n", "low", "high").join(named, ["n", "low", "high"], "left")
    return rows.select("doc", "hash", "n", F.when(F.col("doc").isNotNull(), F.coalesce("component", "doc")).alias("component"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE, threshold: int = THRESHOLD) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept), a row for each row of ``docs``."""
    rows = labelled(docs, id_col, text_col, size, threshold)
    return rows.select(F.col("doc").alias("doc_id"), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"), F.coalesce(F.col("doc") == F.col("component"), F.lit(True)).alias("kept"))


def brute_force(rows: list[tuple[int, str | None]], size: int = SIZE, threshold: int = THRESHOLD) -> list[tuple[int, int, int, bool]]:
    """The same rows by comparing every pair that shares a shingle, for tests."""
    sets, holders = {}, {}
    for d, t in rows:
        w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "").encode().split()
        sets[d] = {tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set()
        for s in sets[d]:
            holders.setdefault(s, set()).add(d)
    at = {d: i for i, d in enumerate(sorted(sets))}
    pairs = []
    for d, s in sets.items():
        for e in set().union(*(holders[x] for x in s)) if s else ():
            if e > d and 100 * len(s & sets[e]) >= threshold * len(s | sets[e]):
                pairs.append((at[d], at[e]))
    up = list(range(len(at)))
    for a, b in pairs * 1:
        while up[a] != a:
            a = up[a]
        while up[b] != b:
            b = up[b]
        up[max(a, b)] = min(a, b)
    ids = sorted(sets)

    def root(x: int) -> int:
        while up[x] != x:
            x = up[x]
        return ids[x]

    return [(d, len(sets[d]), root(at[d]), root(at[d]) == d) for d in sets]
