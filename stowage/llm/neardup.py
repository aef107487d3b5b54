"""Near-duplicates by SetSketch registers, confirmed on full shingle sets.

1. Each text becomes its set of distinct 5-word shingles (64-bit hashes).
   Every element sends points of a Poisson process to ``M`` registers, each
   point to a random one; a register keeps the least point, truncated to an
   exponentially spaced scale of base ``BASE`` (SetSketch).  Registers merge
   by maximum and agree more often the more two sets share.
2. Documents of equal sets are one class, stood for by its least id (and a hash
   of id and set where two classes have one least id).
3. Registers are cut into ``M / ROWS`` bands; classes of equal band values are
   candidates.  At a similarity of 0.75 a pair misses every band with a
   probability of (1 - 0.75^4)^40 = 2.5e-7.
4. First each class is compared with the best connected member of its bands
   only (one pair a class), and the links give first components.  Where a band
   still holds several, its members are compared with the one that shares most
   of its shingles with others, ``HUB_ROUNDS`` times over.  Then the
   different components in such bands are searched by prefix, length and
   positional filter over shingles in order of rarity, which no pair of 0.75
   or more fails.  Pairs are listed only for shingles that at most ``LIGHT``
   open classes have in their prefix, so a class lists a bounded number for
   each.  Classes joined by more frequent ones form families; a family is cut
   into blocks of ``FAMILY_BYTES``, every two blocks meet in one task on their
   full sets, and the task gives the links that join components, no pairs.  So
   a group of thousands of copies, or of documents made from one template,
   costs neither a pair for each two of them nor a cap.
5. The listed pairs' similarity is estimated jointly by likelihood from the
   registers; a pair is dropped where a similarity of 0.75 is ``ODDS`` times
   less likely than the best estimate below it.
6. What is left is verified exactly: 100 * intersection >= 75 * union.
7. Components come from stars, all in tables in the shared folder; later links
   are added to the components there are.

Edge cases: null and wordless texts have an empty set, linked with nothing;
1 to 4 words are one shingle; rows of null id stand alone, with a null
component, and are kept; repeated rows (equal id and text) share a component
and are all kept; rows of one id and different sets are documents of their own,
each with its links; of equal least ids the component's id is that id; very
long texts are sketched whole, in blocks of memory of a fixed size; an empty
table gives an empty result; whatever else the table holds, under any name, is
ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, fresh, read
from .graph import components
from .kernels import blocks, mix, shingle_sets, text_bytes
from .packing import release
from .rarity import slot_counts, slot_of

M, ROWS, BASE = 160, 4, 1.001
BANDS = M // ROWS
SHINGLE, NEED = 5, 75
ODDS = math.exp(20)
HUB_ROUNDS = 2
LIGHT, FAMILY_BYTES = 32, 4 << 20
TOP = 2**16 - 2
#: The register scale is anchored so that sets of 1 to 10^12 elements fit.
ANCHOR = 20.0

_U = np.uint64


def registers(sets: list[np.ndarray]) -> np.ndarray:
    """One row of M registers (uint16) a set; 0 where the set is empty."""
    n = np.array([len(s) for s in sets], np.int64)
    least = np.full((len(sets), M), np.inf)
    element = np.concatenate([*sets, np.zeros(0, _U)]).astype(_U)
    owner = np.repeat(np.arange(len(sets)), n)
    point = np.zeros(len(element))
    turn = 0
    while len(element):
        turn += 1
        h = mix(element + _U((0x9E3779B97F4A7C15 * turn) & (2**64 - 1)))
        point = point - np.log(((h >> _U(12)).astype(np.float64) + 0.5) * 2.0**-52) / M
        register = ((mix(h) >> _U(32)) * _U(M) >> _U(32)).astype(np.int64)
        np.minimum.at(least.reshape(-1), owner * M + register, point)
        go = point < least.max(1)[owner]  # no later point of the others can matter
        element, owner, point = element[go], owner[go], point[go]
    with np.errstate(divide="ignore"):
        k = np.floor(1 - np.log(least) / math.log(BASE) + ANCHOR / math.log(BASE) * 0.5)
    k = np.clip(k, 0, TOP + 1)
    k[n == 0] = 0
    return k.astype(np.uint16)


def band_hashes(regs: np.ndarray) -> np.ndarray:
    """One 64-bit value a band, the band's number mixed in."""
    out = np.zeros((len(regs), BANDS), _U)
    for j in range(ROWS):
        out = mix(out ^ regs[:, j::ROWS].astype(_U) + _U(j << 20))
    return mix(out + np.arange(BANDS, dtype=_U)[None, :] * _U(0x9E3779B97F4A7C15))


_SIGNATURE = "h1 long, h2 long, n_shingles long, registers binary"


def text_hash(text_col: str) -> Column:
    return F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))


def sketches(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text_hash, h1, h2 (a 128-bit hash of the set), n_shingles, registers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, offsets = text_bytes(b.column(2))
            for first, part, at in blocks(data, offsets):
                sets = list(shingle_sets(part, at, SHINGLE))
                h1 = np.array([np.bitwise_xor.reduce(mix(s + _U(11))) if len(s) else 0 for s in sets], _U)
                h2 = np.array([np.add.reduce(mix(s ^ _U(0xABCDEF))) if len(s) else 0 for s in sets], _U)
                regs = registers(sets)
                yield pa.RecordBatch.from_arrays(
                    [
                        b.column(0).slice(first, len(sets)),
                        b.column(1).slice(first, len(sets)),
                        pa.array(h1.view(np.int64)),
                        pa.array(h2.view(np.int64)),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array([r.tobytes() for r in regs], pa.binary()),
                    ],
                    names=["doc_id", "text_hash", "h1", "h2", "n_shingles", "registers"],
                )
        release()

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text_hash(text_col).alias("text_hash"), F.col(text_col).alias("text")).mapInArrow(run, f"doc_id long, text_hash long, {_SIGNATURE}")


def bands(classes: DataFrame) -> DataFrame:
    """rep, band for each class and band."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            regs = np.frombuffer(b"".join(b.column(1).to_pylist()), np.uint16).reshape(-1, M)
            hashed = band_hashes(regs).reshape(-1).view(np.int64)
            rep = np.repeat(b.column(0).to_numpy(), BANDS)
            yield pa.RecordBatch.from_arrays([pa.array(rep), pa.array(hashed)], names=["rep", "band"])
        release()

    return classes.select("rep", "registers").mapInArrow(run, "rep long, band long")


def _share(x: np.ndarray) -> np.ndarray:
    """-log_BASE(1 - x (BASE - 1) / BASE)."""
    return -np.log1p(-x * (BASE - 1) / BASE) / math.log(BASE)


def possible(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """Whether a similarity of NEED % isn't ruled out by the registers (rows of a and b)."""
    more, less = (a > b).sum(1), (a < b).sum(1)
    same = M - more - less
    u = na / (na + nb)
    v = 1 - u

    def logl(j: np.ndarray) -> np.ndarray:
        p, q = _share(np.maximum(u - v * j, 0)), _share(np.maximum(v - u * j, 0))
        # a + (a == 0): log of 0 counts only where such registers were seen
        part = lambda n, x: np.where(n > 0, n * np.log(np.maximum(x, 1e-300)), 0.0)
        return part(more, p) + part(less, q) + part(same, 1 - p - q)

    most = np.minimum(na, nb) / np.maximum(na, nb)
    need = np.full(len(na), NEED / 100)
    at_need = logl(need)
    best = at_need
    for step in np.linspace(0, 1, 60):  # below the needed similarity only: above it nothing is dropped
        best = np.maximum(best, logl(step * np.minimum(need, most)))
    return (most >= NEED / 100 - 1e-12) & (best - at_need <= math.log(ODDS))


def plausible(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """The pairs (a, b) whose registers allow the similarity needed."""
    side = lambda x: classes.select(F.col("rep").alias(x), F.col("registers").alias(f"r{x}"), F.col("n_shingles").alias(f"n{x}"))
    joined = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "ra", "rb", "na", "nb")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            regs = [np.frombuffer(b"".join(b.column(k).to_pylist()), np.uint16).reshape(-1, M) for k in (2, 3)]
            ok = possible(*regs, b.column(4).to_numpy().astype(float), b.column(5).to_numpy().astype(float))
            yield b.select(["a", "b"]).filter(pa.array(ok))
        release()

    return joined.mapInArrow(run, "a long, b long")


def full_sets(texts: DataFrame) -> DataFrame:
    """rep, elements (sorted 64-bit hashes) of each row (rep, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, offsets = text_bytes(b.column(1))
            for first, part, at in blocks(data, offsets):
                sets = [s.tobytes() for s in shingle_sets(part, at, SHINGLE)]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(first, len(sets)), pa.array(sets, pa.binary())], names=["rep", "elements"])
        release()

    return texts.select("rep", "text").mapInArrow(run, "rep long, elements binary")


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) that reach the needed similarity on their full sets."""
    side = lambda x: sets.select(F.col("rep").alias(x), F.col("elements").alias(f"e{x}"))
    joined = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "ea", "eb")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ok = []
            for x, y in zip(b.column(2), b.column(3), strict=True):
                x, y = np.frombuffer(x.as_buffer(), _U), np.frombuffer(y.as_buffer(), _U)
                both = np.sort(np.concatenate([x, y]), kind="stable")
                common = int(np.count_nonzero(both[1:] == both[:-1]))
                ok.append(100 * common >= NEED * (len(x) + len(y) - common))
            yield b.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))
        release()

    return joined.mapInArrow(run, "a long, b long")


def labelled(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text_hash, n_shingles, label (of the component's classes), component_id, kept for each row of docs."""
    scratch = Scratch(docs.sparkSession, "neardup")
    marked = scratch.keep(sketches(docs, id_col, text_col))
    usable = marked.where("n_shingles > 0 AND doc_id IS NOT NULL")
    members = usable.groupBy("h1", "h2").agg(F.min(F.struct("doc_id", "text_hash")).alias("least"))
    members = members.select("h1", "h2", F.col("least.doc_id").alias("low"), F.col("least.text_hash").alias("low_text"))
    first = members.groupBy("low").agg(F.min(F.struct("h1", "h2")).alias("first"))
    rep = F.when(F.struct("h1", "h2") == F.col("first"), F.col("low")).otherwise(F.xxhash64("low", "h1", "h2"))
    members = scratch.keep(members.join(first, "low").select("h1", "h2", "low", "low_text", rep.alias("rep")))
    m = members.withColumnsRenamed({"h1": "g1", "h2": "g2"})
    classes = scratch.keep(
        usable.join(m, (F.col("doc_id") == F.col("low")) & (F.col("h1") == F.col("g1")) & (F.col("h2") == F.col("g2")))
        .select("low", "rep", "n_shingles", "registers")
        .dropDuplicates(["low", "rep"])
        .drop("low")
    )
    banded = bands(classes)
    shared = banded.groupBy("band").agg(F.count("*").alias("size")).where("size > 1")
    banded = scratch.keep(banded.join(shared, "band"))

    # the best connected member of each band, and of those the best for each class
    weight = banded.groupBy("rep").agg(F.sum("size").alias("weight"))
    weighed = banded.select("rep", "band").join(weight, "rep")
    hub = weighed.groupBy("band").agg(F.max(F.struct("weight", (-F.col("rep")).alias("rep"))).alias("hub"))
    first = (
        banded.join(hub, "band")
        .groupBy("rep")
        .agg(F.max("hub").alias("hub"))
        .select(F.col("rep").alias("a"), (-F.col("hub.rep")).alias("b"))
        .where("a <> b")
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .distinct()
    )
    candidates = members.join(banded.select("rep").distinct(), "rep").select("low", "low_text", "rep")
    rows = docs.select(F.col(id_col).cast("long").alias("low"), text_hash(text_col).alias("low_text"), F.col(text_col).alias("text"))
    sets = scratch.keep(full_sets(rows.join(candidates, ["low", "low_text"]).dropDuplicates(["low", "low_text"])))
    labels = scratch.keep(components(verified(first, sets), scratch))

    # bands that hold several components still: nearer hubs, then whatever the filters can't rule out
    opened = scratch.keep(open_rows(banded, labels))
    sets = scratch.keep(sets.join(opened.select("rep").distinct(), "rep", "left_semi"))
    counts = docs.sparkSession.sparkContext.broadcast(slot_counts(sets, _elements))
    nearness = scratch.keep(central(sets, counts))
    for _ in range(HUB_ROUNDS):
        hub = opened.join(nearness, "rep").groupBy("band").agg(F.max(F.struct("nearness", (-F.col("rep")).alias("rep"), "label")).alias("hub"))
        tries = (
            opened.join(hub, "band")
            .where(F.col("label") != F.col("hub.label"))
            .groupBy("rep")
            .agg(F.max("hub").alias("hub"))
            .select(F.greatest("rep", -F.col("hub.rep")).alias("a"), F.least("rep", -F.col("hub.rep")).alias("b"))
            .distinct()
        )
        labels = joined(labels, verified(tries, sets), scratch)
        opened = scratch.keep(open_rows(opened.select("rep", "band"), labels))
    labels = joined(labels, last_links(sets, opened.select("rep", "label").distinct(), counts, classes, scratch), scratch)

    found = members.join(labels, members["rep"] == labels["node"], "left").select("h1", "h2", "low", F.coalesce("label", "rep").alias("label"))
    lowest = found.groupBy("label").agg(F.min("low").alias("component_id"))
    found = found.join(lowest, "label").select("h1", "h2", "label", "component_id")
    some = F.col("n_shingles") > 0
    return (
        marked.select("doc_id", "text_hash", "n_shingles", "h1", "h2")
        .join(found, ["h1", "h2"], "left")
        .withColumn("component_id", F.when(F.col("doc_id").isNotNull(), F.when(some, F.coalesce("component_id", "doc_id")).otherwise(F.col("doc_id"))))
        .withColumn("label", F.when(some & F.col("doc_id").isNotNull(), F.col("label")))
        .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
        .select("doc_id", "text_hash", "n_shingles", "label", "component_id", "kept")
    )


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each row of docs."""
    return labelled(docs, id_col, text_col).select("doc_id", "n_shingles", "component_id", "kept")


def distinct_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs without near-duplicates: of each component one row; rows of null id or without words stay, repeated rows once."""
    key, word = fresh(docs, "_id", "_text")
    rows = labelled(docs, id_col, text_col).where("kept AND doc_id IS NOT NULL")
    # texts of one id and one component (equal sets, or linked ones): the one of least hash; without words: each text
    one = rows.groupBy("doc_id", F.coalesce("label", "text_hash").alias("label"), F.col("label").isNull().alias("bare")).agg(F.min("text_hash").alias(word))
    one = one.select(F.col("doc_id").alias(key), word).distinct()
    marked = docs.withColumns({key: F.col(id_col).cast("long"), word: text_hash(text_col)})
    left = marked.where(F.col(key).isNotNull()).join(one, [key, word], "left_semi").dropDuplicates([key, word])
    return left.unionByName(marked.where(F.col(key).isNull())).select(*docs.columns)


def joined(labels: DataFrame, links: DataFrame, scratch: Scratch) -> DataFrame:
    """node, label of the components when links (a, b) are added: components of components, the nodes follow."""
    links = scratch.keep(links)
    named = lambda df, x, y: df.join(labels.select(F.col("node").alias(x), F.col("label").alias("_l")), x, "left").select(F.coalesce("_l", x).alias(x), y)
    edges = scratch.keep(named(named(links, "a", "b"), "b", "a").where("a <> b").distinct())
    if edges.isEmpty():
        return labels
    found = components(edges, scratch).select(F.col("node").alias("label"), F.col("label").alias("_to"))
    # nodes that had no label stand for themselves
    alone = links.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(labels, "node", "left_anti").select("node", F.col("node").alias("label"))
    return scratch.keep(labels.unionAll(alone).join(found, "label", "left").select("node", F.coalesce("_to", "label").alias("label")))


def open_rows(banded: DataFrame, labels: DataFrame) -> DataFrame:
    """rep, band, label of the bands that hold several components."""
    rows = banded.join(labels, banded["rep"] == labels["node"], "left").select("rep", "band", F.coalesce("label", "rep").alias("label"))
    several = rows.groupBy("band").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo < hi").select("band")
    return rows.join(several, "band")


def _elements(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
    for blob in batch.column(1):
        yield np.frombuffer(blob.as_buffer(), _U)


def central(sets: DataFrame, counts) -> DataFrame:
    """rep, nearness: the mean count of a set's elements, highest for what others were copied from."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often = counts.value
        for b in batches:
            mean = [float(often[slot_of(e)].mean()) for e in _elements(b)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(mean, pa.float64())], names=["rep", "nearness"])

    return sets.select("rep", "elements").mapInArrow(run, "rep long, nearness double")


def prefix_rows(sets: DataFrame, labels: DataFrame, counts) -> DataFrame:
    """e, rep, label, n (size), rest (elements from e on) for the elements in each set's prefix that sets of other labels have there too."""

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often = counts.value
        for b in batches:
            for rep, label, e in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), _elements(b), strict=True):
                n = len(e)
                c = often[slot_of(e)]
                first = np.lexsort((e, c))[: n - -(-NEED * n // 100) + 1]
                place = np.flatnonzero(c[first] > 1)
                e = e[first[place]].view(np.int64)
                k = len(e)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(e), pa.array(np.full(k, rep)), pa.array(np.full(k, label)), pa.array(np.full(k, n)), pa.array(n - place)], names=["e", "rep", "label", "n", "rest"]
                )

    rows = sets.join(labels, "rep").select("rep", "elements", "label").mapInArrow(prefixes, "e long, rep long, label long, n long, rest long")
    met = rows.groupBy("e").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.count("*").alias("many")).where("lo < hi").select("e", "many")
    return rows.join(met, "e")


def light_pairs(rows: DataFrame) -> DataFrame:
    """The pairs (a, b) of different labels and families that share an element of at most LIGHT sets and pass the length and positional filter."""
    rows = rows.where(F.col("many") <= LIGHT)
    x, y = rows.alias("x"), rows.alias("y")
    # intersection >= need/(100+need) of both sizes; at the first element shared, that many must be left in each
    return (
        x.join(
            y,
            (F.col("x.e") == F.col("y.e"))
            & (F.col("x.rep") > F.col("y.rep"))
            & (F.col("x.label") != F.col("y.label"))
            & ~F.coalesce(F.col("x.family") == F.col("y.family"), F.lit(False))
            & (F.least("x.rest", "y.rest") * (100 + NEED) >= (F.col("x.n") + F.col("y.n")) * NEED),
        )
        .select(F.col("x.rep").alias("a"), F.col("y.rep").alias("b"))
        .distinct()
    )


def _meet(key: tuple, table: pa.Table) -> pa.Table:
    """Two blocks of a family (or one with itself): links between components, found by counting common elements."""
    lo, hi = key[1].as_py(), key[2].as_py()
    block = table.column("block").to_numpy()
    rep, label = table.column("rep").to_numpy(), table.column("label").to_numpy()
    sets = [np.frombuffer(e.as_buffer(), _U) for e in table.column("elements").combine_chunks()]
    size = np.array([len(e) for e in sets], np.int64)
    _, root = np.unique(label, return_inverse=True)
    left, right = np.flatnonzero(block == lo), np.flatnonzero(block == hi)
    element = np.concatenate([sets[k] for k in right])
    owner = np.repeat(np.arange(len(right)), size[right])
    order = np.argsort(element, kind="stable")
    element, owner = element[order], owner[order]
    out = []
    for x in left.tolist():
        other = root[right] != root[x]
        other &= (100 * size[right] >= NEED * size[x]) & (100 * size[x] >= NEED * size[right])
        if lo == hi:
            other &= right > x
        if not other.any():
            continue
        at, to = np.searchsorted(element, sets[x], "left"), np.searchsorted(element, sets[x], "right")
        n = to - at
        hits = np.repeat(at - (np.cumsum(n) - n), n) + np.arange(n.sum())
        common = np.bincount(owner[hits], minlength=len(right))
        near = right[other & (100 * common >= NEED * (size[x] + size[right] - common))]
        for y in near.tolist():
            if root[y] != root[x]:
                out.append((int(rep[x]), int(rep[y])))
                root[root == root[y]] = root[x]
    a, b = zip(*out, strict=True) if out else ((), ())
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def family_links(sets: DataFrame, labels: DataFrame, family: DataFrame) -> DataFrame:
    """Links (a, b) that join the components of each family, by blocks on full sets: no pairs are sent."""
    rows = sets.join(family, "rep").join(labels, "rep")
    cuts = rows.groupBy("family").agg(F.ceil(F.sum(F.length("elements")) / FAMILY_BYTES).cast("int").alias("cuts"))
    rows = rows.join(cuts, "family").withColumn("block", F.pmod(F.xxhash64("rep"), F.col("cuts")).cast("int"))
    sent = rows.select("rep", "elements", "label", "family", "block", F.explode(F.sequence(F.lit(0), F.col("cuts") - 1)).alias("other"))
    sent = sent.withColumn("lo", F.least("block", "other")).withColumn("hi", F.greatest("block", "other"))
    return sent.groupBy("family", "lo", "hi").applyInArrow(_meet, "a long, b long")


def last_links(sets: DataFrame, labels: DataFrame, counts, classes: DataFrame, scratch: Scratch) -> DataFrame:
    """The links between components that the hubs left: listed pairs, and families by blocks."""
    rows = scratch.keep(prefix_rows(sets, labels, counts))
    heavy = rows.where(F.col("many") > LIGHT).select("e", "rep")
    edges = scratch.keep(heavy.join(heavy.groupBy("e").agg(F.min("rep").alias("b")), "e").where("rep <> b").select(F.col("rep").alias("a"), "b").distinct())
    if edges.isEmpty():
        return verified(plausible(light_pairs(rows.withColumn("family", F.lit(None).cast("long"))), classes), sets)
    family = scratch.keep(components(edges, scratch).select(F.col("node").alias("rep"), F.col("label").alias("family")))
    pairs = light_pairs(scratch.keep(rows.where(F.col("many") <= LIGHT).join(family, "rep", "left")))
    return verified(plausible(pairs, classes), sets).unionAll(family_links(sets, labels, family))


def op4_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "documents"))


ORACLE = """
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^ \\t\\n\\x0B\\f\\r]+') AS w FROM documents),
sets AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))
    WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM words),
elements AS (SELECT doc_id, len(s) AS n, unnest(s) AS e FROM sets),
pairs AS (
  SELECT a.doc_id AS x, b.doc_id AS y, any_value(a.n) AS n, any_value(b.n) AS m, count(*) AS i
  FROM elements a JOIN elements b ON a.e = b.e AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT x, y FROM pairs WHERE 100 * i >= 75 * (n + m - i)),
both_ways AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reached(doc_id, y) AS (
  SELECT DISTINCT x, x FROM both_ways UNION SELECT r.doc_id, b.y FROM reached r JOIN both_ways b ON r.y = b.x),
labels AS (SELECT doc_id, min(y) AS label FROM reached GROUP BY doc_id)
SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, coalesce(label, doc_id) AS component_id, coalesce(label, doc_id) = doc_id AS kept
FROM sets LEFT JOIN labels USING (doc_id)
"""
