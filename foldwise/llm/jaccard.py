"""N-gram Jaccard join by PartEnum signatures, with exact checks and link components.

Texts are sets of hashed word n-grams. Two sets with ``inter / union >= share`` differ in at most
``k = (1 - share) / (1 + share) * (size + size)`` elements, and their sizes lie in one size band or two neighbouring
ones. For a band the feature domain (the hash space) is cut into ``n1`` ranges of ``n2`` parts; by the pigeonhole rule
two sets that differ in at most ``k`` elements differ, in some range, in at most ``K2`` parts, so they agree on some
``n2 - K2`` of its parts. A signature is the hash of all elements in one such choice of parts, and sets that share
none cannot link. A set signs for its own band and for the next one, which covers pairs across neighbouring bands.

From signatures to components, without pairs inside a group:

1. Equal sets form one class. A task signs the distinct sets of a block of texts; signatures that only one set of
   the block carries travel packed, one slice per hash range, and a range keeps those that several blocks sent.
2. Every set is compared with the smallest set id of each signature it carries (its centre), which links large groups
   of near copies at a cost linear in their size.
3. Components of those links are contracted. Signatures whose members now lie in one component are settled. In the
   others only members of different components can bring a new link. A pair of them is ruled out, before it becomes
   a row, by the sizes, by the sets' distances to their common centre (a metric, so a difference above ``k`` rules a
   link out) and by sketches (each field that differs is at least one element); the others are compared. A row carries
   only the sketch for its signature's band.
4. Components of all links give the class of every document.

Defined cases: a null, empty or blank text has an empty set and is linked with nothing; fewer words than the n-gram
make one shingle; equal texts link with distance 0; an id stands for one text, and rows that repeat it give one row;
null ids are left out; an empty table gives an empty result; only the id and text columns are read.
"""

from __future__ import annotations

import itertools
from fractions import Fraction

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .common import _GOLD, WordHashes, batches, id_text, mix, shingles, signed
from .components import components
from .packed import pack, pack_sorted, slices, unpack, unpack_sorted

NEED_ROWS = 500_000  # class ids broadcast to fetch their texts, at most; beyond it that join is a shuffle
SKETCH = 2           # sketch parts for each element in which linked sets may differ
SKETCH_BITS = 2      # of a sketch part
K2 = 1   # parts of a range in which near sets may differ
_SIG_BITS = np.uint64((1 << 64) - (1 << 16))  # equal hashes of unequal parts only bring a pair that the checks drop


def parts_per_range(share: Fraction) -> int:
    """``n2``: signatures per range are ``n2 choose K2``. More parts make a signature hold more elements, which low
    shares need, as their ranges are short (about ``(1 + share) / (2 - 2 share)`` elements a part at ``n2 = 2``)."""
    return 2 if (1 + share) / (2 - 2 * share) >= 8 else 3


class Bands:
    """Size bands for a link share ``share``; band ``i`` is ``[low(i), low(i + 1))``, with ``high <= low / share``."""

    def __init__(self, share: Fraction) -> None:
        self.share = share
        self.lows = [1]
        self.n2 = parts_per_range(share)

    def _grow(self, size: int) -> None:
        while self.lows[-1] <= size:
            self.lows.append(int(self.lows[-1] / self.share) + 1)

    def of(self, size: int) -> int:
        self._grow(size)
        return int(np.searchsorted(self.lows, size, "right")) - 1

    def differ(self, band: int) -> int:
        """Most elements in which two linked sets can differ when the larger lies in ``band``."""
        self._grow(self.lows[-1]) if band + 1 >= len(self.lows) else None
        high = self.lows[band + 1] - 1
        return int(2 * high * (1 - self.share) / (1 + self.share))


def signatures(s: np.ndarray, bands: Bands) -> np.ndarray:
    """The signatures of a sorted set of 64-bit hashes, for its band and the next: 48 bits of hash, and at the low end
    whether the band's number is odd."""
    if not len(s):
        return s
    total = np.concatenate([[np.uint64(0)], np.cumsum(mix(s), dtype=np.uint64)])
    own, out = bands.of(len(s)), []
    for band in (own, own + 1):
        k = bands.differ(band)
        k2, n2 = (K2, bands.n2) if k else (0, 1)
        n1 = -(-(k + 1) // (k2 + 1))
        n = n1 * n2
        width = (1 << 64) // n
        edge = np.searchsorted(s, (np.arange(1, n, dtype=np.uint64) * np.uint64(width % (1 << 64)))) if n > 1 else np.empty(0, np.int64)
        edge = np.concatenate([[0], edge, [len(s)]])
        part = mix(total[edge[1:]] - total[edge[:-1]])  # wraps, so the order of elements does not matter
        grid = part.reshape(n1, n2)
        for choice in itertools.combinations(range(n2), n2 - k2):
            sig = np.arange(n1, dtype=np.uint64) * _GOLD + np.uint64(band)
            for c in choice:
                sig = mix(sig * _GOLD + grid[:, c] + np.uint64(c))
            out.append((sig & _SIG_BITS) | np.uint64(band & 1))
    return np.unique(np.concatenate(out))


def sketch(s: np.ndarray, parts: int, bits: int = 8) -> np.ndarray:
    """``bits`` of hash for each of ``parts`` ranges of the hash space, as many to a long as leave its sign free (bytes:
    seven): ranges whose fields differ hold different elements, so their number never exceeds the number of elements in
    which two sets differ."""
    total = np.concatenate([[np.uint64(0)], np.cumsum(mix(s), dtype=np.uint64)])
    width = (1 << 64) // parts
    edge = np.searchsorted(s, np.arange(1, parts, dtype=np.uint64) * np.uint64(width))
    edge = np.concatenate([[0], edge, [len(s)]])
    field = mix(total[edge[1:]] - total[edge[:-1]]) & np.uint64((1 << bits) - 1)
    n = 63 // bits
    field = np.append(field, np.zeros(-parts % n, np.uint64)).reshape(-1, n)
    return signed((field << (np.arange(n, dtype=np.uint64) * np.uint64(bits))).sum(axis=1, dtype=np.uint64))


def _differing(a, b, bits: int = 8):
    """Fields in which two sketches differ, as a column (the top bits of each long are empty, so nothing overflows)."""
    ones = sum(1 << (k * bits) for k in range(63 // bits))
    low, high = ones * ((1 << (bits - 1)) - 1), ones << (bits - 1)

    def nonzero(x):
        return F.bit_count(x.bitwiseAND(F.lit(low)).__add__(F.lit(low)).bitwiseOR(x).bitwiseAND(F.lit(high))).cast("int")

    return F.aggregate(F.zip_with(a, b, lambda x, y: x.bitwiseXOR(y)), F.lit(0), lambda n, x: n + nonzero(x))


def _key(s: np.ndarray) -> bytes | None:
    """128 bits of a set; None for the empty one."""
    return xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None


BLOCK_SIGNATURES = 1_000_000
RANGE_SIGNATURES = 1_000_000  # signatures of the corpus per hash range
_FIELDS = {"kind": pa.int32(), "doc_id": pa.int64(), "n_shingles": pa.int64(), "set_key": pa.binary(), "sig": pa.int64(),
           "part": pa.int64(), "sigs": pa.binary(), "nodes": pa.binary()}
POSTS = "kind int, doc_id long, n_shingles long, set_key binary, sig long, part long, sigs binary, nodes binary"
DOC, LOCAL, SLICE = 0, 1, 2
CARRIED = 256  # groups below zero: DOC and LOCAL rows, which pass the exchange of the slices as they are


def _rows(kind: int, n: int, **cols) -> pa.RecordBatch:
    arrays = [pa.array(cols[c], t) if c in cols else pa.nulls(n, t) for c, t in _FIELDS.items()]
    arrays[0] = pa.array(np.full(n, kind, np.int32))
    return pa.RecordBatch.from_arrays(arrays, list(_FIELDS))


def _posts(n: int, bands: Bands, bits: int):
    """Texts -> a DOC row each; by block, LOCAL rows ``(sig, doc_id)`` of signatures that several of its sets carry, and
    SLICE rows with each signature once and the first set that carries it."""
    def flush(sigs, nodes):
        sig = np.concatenate(sigs)
        node = np.repeat(np.array(nodes, np.int64), [len(x) for x in sigs])
        order = np.argsort(sig, kind="stable")
        sig, node = sig[order], node[order]
        new = np.concatenate([[True], sig[1:] != sig[:-1]])
        several = ~new
        several[:-1] |= ~new[1:]
        if several.any():
            yield _rows(LOCAL, int(several.sum()), sig=signed(sig[several]), doc_id=node[several],
                        part=-1 - ((sig[several] >> np.uint64(16)) % np.uint64(CARRIED)).astype(np.int64))
        sig, node = sig[new], node[new]
        cut = list(slices(sig, bits))
        yield _rows(SLICE, len(cut), part=[p for p, _, _ in cut], sigs=[pack_sorted(sig[a:b]) for _, a, b in cut],
                    nodes=[pack(node[a:b]) for _, a, b in cut])

    def work(it):
        words = WordHashes()
        seen, sigs, nodes, held = set(), [], [], 0
        for b, texts in batches(it):
            ids, sizes, keys = b.column("doc_id"), [], []
            for d, t in zip(ids.to_pylist(), texts):
                s = shingles(words(t.lower().split()), n)
                sizes.append(len(s))
                keys.append(_key(s))
                if len(s) and keys[-1] not in seen:
                    seen.add(keys[-1])
                    sigs.append(signatures(s, bands))
                    nodes.append(d)
                    held += len(sigs[-1])
                    if held >= BLOCK_SIGNATURES:
                        yield from flush(sigs, nodes)
                        seen, sigs, nodes, held = set(), [], [], 0
            yield _rows(DOC, len(sizes), doc_id=ids, n_shingles=sizes, set_key=keys, part=-1 - ids.to_numpy() % CARRIED)
        if nodes:
            yield from flush(sigs, nodes)
    return work


def _across(t: pa.Table) -> pa.Table:
    """One hash range: LOCAL rows of the signatures that several blocks sent. Other rows stay as they are."""
    if t.column("part")[0].as_py() < 0:
        return t
    sig = np.concatenate([unpack_sorted(x) for x in t.column("sigs").to_pylist()])
    node = np.concatenate([unpack(x, np.int64) for x in t.column("nodes").to_pylist()])
    order = np.argsort(sig, kind="stable")
    sig, node = sig[order], node[order]
    several = np.zeros(len(sig), bool)
    several[1:] = sig[1:] == sig[:-1]
    several[:-1] |= several[1:]
    return pa.Table.from_batches([_rows(LOCAL, int(several.sum()), sig=signed(sig[several]), doc_id=node[several])])


def _of_sets(n: int):
    """Rows ``(doc_id, set_key, text)`` whose text has that set."""
    def work(it):
        words = WordHashes()
        for b, texts in batches(it):
            keys = [_key(shingles(words(t.lower().split()), n)) for t in texts]
            yield b.filter(pa.array([k == bytes(want) for k, want in zip(keys, b.column("set_key").to_pylist())]))
    return work


def _check(n: int):
    """Pairs of texts -> the number of elements in which their sets differ."""
    def work(it):
        words, last, last_set = WordHashes(), None, None
        for b in it:
            out = []
            for a, t in zip(b.column("center_text").to_pylist(), b.column("text").to_pylist()):
                if a != last:
                    last, last_set = a, shingles(words(a.lower().split()), n)
                s = shingles(words(t.lower().split()), n)
                both = np.concatenate([last_set, s])
                both.sort(kind="stable")
                out.append(len(both) - 2 * int((both[1:] == both[:-1]).sum()))
            yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b"), pa.array(out, pa.int64())], ["a", "b", "differ"])
    return work


def _with_sets(ids: DataFrame, docs: DataFrame, classes: DataFrame) -> DataFrame:
    """``(doc_id, set_key, text)`` of the rows of class ids, whose sets may differ if an id repeats."""
    need = materialize(ids.distinct().join(classes.select(F.col("rep").alias("doc_id"), "set_key"), "doc_id"))
    if need.count() <= NEED_ROWS:
        need = F.broadcast(need)
    return docs.join(need, "doc_id").select("doc_id", "set_key", "text")


def _texts(ids: DataFrame, docs: DataFrame, classes: DataFrame, n: int) -> DataFrame:
    """``(doc_id, set_key, text)`` of class ids: only these texts move."""
    return _with_sets(ids, docs, classes).mapInArrow(_of_sets(n), "doc_id long, set_key binary, text binary").dropDuplicates(["doc_id"])


def distances(pairs: DataFrame, docs: DataFrame, classes: DataFrame, n: int) -> DataFrame:
    """``(a, b, differ)`` for pairs of class ids: the size of the sets' symmetric difference, from the whole texts.

    Both joins are on an id and on nothing else, so Spark can split an id that stands in very many pairs.
    """
    ids = pairs.select(F.col("a").alias("doc_id")).union(pairs.select(F.col("b").alias("doc_id")))
    text = _texts(ids, docs, classes, n)
    return pairs.join(text.select(F.col("doc_id").alias("b"), "text"), "b") \
        .join(text.select(F.col("doc_id").alias("a"), F.col("text").alias("center_text")), "a") \
        .select("a", "b", "center_text", "text").mapInArrow(_check(n), "a long, b long, differ long")


def _sketches(n: int, bands: Bands):
    """Rows with sets -> ``(rep, band, own, next)`` of those whose text has that set: sketches for its band and the next."""
    def work(it):
        words = WordHashes()
        for b, texts in batches(it):
            reps, rows = [], []
            for d, want, t in zip(b.column("doc_id").to_pylist(), b.column("set_key").to_pylist(), texts):
                s = shingles(words(t.lower().split()), n)
                if _key(s) != bytes(want):
                    continue
                band = bands.of(len(s))
                reps.append(d)
                rows.append((band, *[sketch(s, SKETCH * (bands.differ(k) + 1), SKETCH_BITS) for k in (band, band + 1)]))
            yield pa.RecordBatch.from_arrays(
                [pa.array(reps, pa.int64()), pa.array([r[0] for r in rows], pa.int32()),
                 *[pa.array([r[k] for r in rows], pa.list_(pa.int64())) for k in (1, 2)]], ["rep", "band", "own", "next"])
    return work


def link_components(df: DataFrame, n: int = 3, share: Fraction = Fraction(9, 10), id_col: str = "doc_id",
                    text_col: str = "text") -> DataFrame:
    """``(doc_id, n_shingles, component_id)``: texts link when their sets' Jaccard similarity is at least ``share``."""
    docs = id_text(df, id_col, text_col).where(F.col("doc_id").isNotNull())
    up, down = share.numerator, share.denominator
    # 2 * inter = x + y - d and 2 * union = x + y + d
    linked = lambda x, y, d: (x + y - d) * F.lit(down) >= (x + y + d) * F.lit(up)
    sizes_fit = lambda x, y: F.least(x, y) * F.lit(down) >= F.greatest(x, y) * F.lit(up)

    size = docs.agg(F.sum(F.length("text"))).first()[0] or 0
    expected = size / 6 * float(2 * (1 - share) / (1 + share)) * 2.3
    bits = max(0, int(np.ceil(np.log2(max(expected / RANGE_SIGNATURES, 1)))))
    # texts are signed once: one exchange carries the slices to their ranges and the other rows beside them
    one = materialize(docs.mapInArrow(_posts(n, Bands(share), bits), POSTS).groupBy("part").applyInArrow(_across, POSTS)
                      .drop("part", "sigs", "nodes"))
    mine = materialize(one.where(F.col("kind") == DOC).groupBy("doc_id").agg(F.max(F.struct("set_key", "n_shingles")).alias("s"))
                       .select("doc_id", "s.set_key", "s.n_shingles"))
    classes = materialize(mine.where(F.col("set_key").isNotNull()).groupBy("set_key").agg(
        F.min("doc_id").alias("rep"), F.first("n_shingles").alias("size")))
    class_of = materialize(mine.select("doc_id", "set_key").join(classes, "set_key").select("doc_id", "rep", "size"))

    # signatures that more than one class carries, and who carries them
    posts = one.where(F.col("kind") == LOCAL).select("sig", "doc_id")
    posts = materialize(posts.join(class_of, "doc_id").select("sig", "rep", "size").distinct())
    shared = materialize(posts.groupBy("sig").agg(F.min(F.struct("rep", "size")).alias("c"), F.max("rep").alias("last"))
                         .where(F.col("c.rep") < F.col("last")).select("sig", F.col("c.rep").alias("center"), F.col("c.size").alias("center_size")))
    members = materialize(posts.join(shared, "sig"))

    # every member against the centre
    pairs = members.where((F.col("rep") != F.col("center")) & sizes_fit(F.col("size"), F.col("center_size"))) \
        .select(F.col("center").alias("a"), F.col("rep").alias("b"), F.col("center_size").alias("x"), F.col("size").alias("y")).distinct()
    pairs = materialize(pairs)
    bands = Bands(share)
    ids = members.select(F.col("rep").alias("doc_id"))
    sketches = materialize(_with_sets(ids, docs, classes)
                           .mapInArrow(_sketches(n, bands), "rep long, band int, own array<long>, next array<long>").dropDuplicates(["rep"]))
    within = lambda d, x, y: d * F.lit(up + down) <= (x + y) * F.lit(down - up)

    def fields_differ(p, q):
        compare = lambda x, y: _differing(F.col(f"{p}.{x}"), F.col(f"{q}.{y}"), SKETCH_BITS)
        return F.when(F.col(f"{p}.band") == F.col(f"{q}.band"), compare("own", "own")) \
            .when(F.col(f"{p}.band") < F.col(f"{q}.band"), compare("next", "own")).otherwise(compare("own", "next"))

    near = pairs.join(sketches.alias("q"), F.col("b") == F.col("q.rep")) \
        .join(sketches.alias("p"), (F.col("a") == F.col("p.rep")) & within(fields_differ("p", "q"), F.col("x"), F.col("y"))) \
        .select("a", "b", "x", "y")
    near = materialize(near)
    to_center = materialize(distances(near.select("a", "b"), docs, classes, n).join(near, ["a", "b"]))
    links = to_center.where(linked(F.col("x"), F.col("y"), F.col("differ"))).select("a", "b")
    parts = components(links)

    # members of shared signatures that are still apart
    label = members.join(parts.select(F.col("id").alias("rep"), "component"), "rep", "left") \
        .withColumn("component", F.coalesce("component", "rep"))
    label = materialize(label)
    open_sigs = label.groupBy("sig").agg(F.min("component").alias("lo"), F.max("component").alias("hi")) \
        .where("lo < hi").select("sig")
    apart = materialize(label.where(F.col("rep") != F.col("center")).join(materialize(open_sigs), "sig", "left_semi")
                        .join(to_center.select(F.col("a").alias("center"), F.col("b").alias("rep"), "differ"), ["center", "rep"], "left"))
    # all members of a signature have a sketch for its band
    own = F.col("sig").bitwiseAND(F.lit(1)) == F.col("band").bitwiseAND(F.lit(1))
    apart = apart.join(sketches, "rep").select("sig", "rep", "size", "component", "differ", F.when(own, F.col("own")).otherwise(F.col("next")).alias("sketch"))
    l, r = apart.alias("l"), apart.alias("r")
    x, y = F.col("l.size"), F.col("r.size")
    gap = F.coalesce(within(F.abs(F.col("l.differ") - F.col("r.differ")), x, y), F.lit(True))
    rest = l.join(r, (F.col("l.sig") == F.col("r.sig")) & (F.col("l.component") < F.col("r.component")) & sizes_fit(x, y)
                  & gap & within(_differing(F.col("l.sketch"), F.col("r.sketch"), SKETCH_BITS), x, y)) \
        .select(F.least("l.rep", "r.rep").alias("a"), F.greatest("l.rep", "r.rep").alias("b"),
                F.when(F.col("l.rep") < F.col("r.rep"), x).otherwise(y).alias("x"),
                F.when(F.col("l.rep") < F.col("r.rep"), y).otherwise(x).alias("y")).distinct()
    rest = materialize(rest)
    more = distances(rest.select("a", "b"), docs, classes, n).join(rest, ["a", "b"]) \
        .where(linked(F.col("x"), F.col("y"), F.col("differ"))).select("a", "b")
    # contracted: old components by their smallest id, and the new links between them
    of = parts.select(F.col("id"), "component")
    more = materialize(more)
    between = more.join(of.select(F.col("id").alias("a"), F.col("component").alias("ca")), "a", "left") \
        .join(of.select(F.col("id").alias("b"), F.col("component").alias("cb")), "b", "left") \
        .select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b"))
    final = components(between).select(F.col("id").alias("component"), F.col("component").alias("final")) \
        if more.limit(1).count() else None
    classed = classes.join(of.withColumnRenamed("id", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    if final is not None:
        classed = classed.join(final, "component", "left").withColumn("component", F.coalesce("final", "component"))
    classed = materialize(classed.select("set_key", "component"))
    some = mine.where(F.col("set_key").isNotNull()).join(classed, "set_key").select("doc_id", "n_shingles", F.col("component").alias("component_id"))
    none = mine.where(F.col("set_key").isNull()).select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return some.unionByName(none)
