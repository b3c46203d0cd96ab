"""MinHash near-dedup (9): DartMinHash signatures over word shingles, banded joining, exact check.

1. Each text becomes the set of its distinct runs of SHINGLE words and K signature values. All shingles weigh the
   same, however often they occur, so signatures estimate what links are defined by and a set has one signature.
   Texts with equal sets are one node from here on, so copies are never paired.
2. BANDS bands of ROWS values are the buckets. In each bucket the node with the most bucket mates in all its
   buckets is the hub (a base that others are copies of meets more mates than any copy); the others are
   linked to it where the exact Jaccard similarity of the two sets is SIMILAR or more.
3. Components of the links. Buckets that still hold nodes of more than one component are gone through in
   full: their nodes' signatures are dealt in blocks, pairs of blocks go to tasks, and pairs across components that agree
   in enough signature values are checked exactly. A pair is looked at in the first bucket that it
   shares. Pairs of blocks with very many such pairs don't write them out: they get the sets, and emit only links that join
   components. So a group of n near copies with a hub costs n checks, and what is not linked yet is compared block by block,
   without a cap.
4. Components again; the class of a document is the least doc_id in its component.

Exact checks read the sets of the nodes in question from their text again. Nothing of this reaches the driver
but counts. Cases: null text counts as empty; a text without words has no set and is a class of its own;
one of fewer than SHINGLE words has one shingle; repeated rows share a class; a null doc_id is no
class id as long as its class has another (null if none has); an empty table gives no rows; other
columns are not read. A set is known by two 64-bit hashes, a document by its id and a hash of its text.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rowloom.llm import dartminhash
from rowloom.llm.common import dropped, small, stored, table, text_or_empty
from rowloom.llm.components import components
from rowloom.llm.textnp import groups, mix, slices, trim, word_hashes

SHINGLE, SIMILAR = 5, 0.8
BANDS, ROWS = 24, 4
K = BANDS * ROWS
#: Pairs that agree in a smaller share of signature values aren't checked: five standard deviations below SIMILAR.
PLAUSIBLE = SIMILAR - 5 * (SIMILAR * (1 - SIMILAR) / K) ** 0.5
BLOCK = 256
#: Plausible pairs for each row of a pair of blocks that are written out; where there are more, they are checked in place.
DENSE = 8
#: Pairs of several groups that are written together.
PAIRS = 1 << 16
#: Characters of the texts that are signed together.
GROUP = 1 << 19
BROADCAST_ROWS = 500_000
_COEFFICIENTS = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3)]


def shingles(texts: list[str], width: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(owner, hash) of the distinct shingles of each text, sorted by owner and hash."""
    doc, w = word_hashes(texts)
    n = np.bincount(doc, minlength=len(texts))
    end = np.cumsum(n)
    at = np.arange(len(w))
    ok = (at + width <= end[doc]) | ((n[doc] < width) & (at == (end - n)[doc]))
    h = np.zeros(len(w), np.uint64)
    for j in range(width):
        k = np.minimum(at + j, len(w) - 1)
        h += np.where(at + j < end[doc], mix(w[k] + _COEFFICIENTS[j]) * _COEFFICIENTS[j], np.uint64(0))
    owner, h = doc[ok], mix(h[ok])
    order = np.lexsort((h, owner))
    owner, h = owner[order], h[order]
    new = np.ones(len(h), bool)
    new[1:] = (np.diff(owner) > 0) | (h[1:] != h[:-1])
    return owner[new], h[new]


def set_hash(owner: np.ndarray, h: np.ndarray, sets: int, salt: np.uint64 = _COEFFICIENTS[1]) -> np.ndarray:
    """A hash of each set, as a signed number; 0 for the empty set."""
    out = np.zeros(sets, np.uint64)
    if len(h):
        first = np.flatnonzero(np.diff(owner, prepend=-1))
        out[owner[first]] = mix(np.add.reduceat(mix(h ^ salt), first)) | np.uint64(1)
    return out.view(np.int64)


def proof(owner: np.ndarray, h: np.ndarray, sets: int) -> np.ndarray:
    """A second hash of each set, independent of the first."""
    return set_hash(owner, h, sets, _COEFFICIENTS[5])


def _texts(column: pa.Array) -> list[str]:
    return ["" if t is None else t for t in column.to_pylist()]


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        for first, part in groups(_texts(batch.column("t")), GROUP):
            owner, h = shingles(part)
            values = dartminhash.signatures(h, np.ones(len(h)), owner, len(part), K)
            banded = values.reshape(len(part), BANDS, ROWS).astype(np.uint64)
            bucket = np.zeros((len(part), BANDS), np.uint64) + np.arange(1, BANDS + 1, dtype=np.uint64) * _COEFFICIENTS[2]
            for j in range(ROWS):
                bucket = mix(bucket + banded[:, :, j] * _COEFFICIENTS[j])
            n = np.bincount(owner, minlength=len(part))
            none = n == 0
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").slice(first, len(part)),
                    batch.column("k").slice(first, len(part)),
                    pa.array(set_hash(owner, h, len(part)), mask=none),
                    pa.array(proof(owner, h, len(part)), mask=none),
                    pa.array(n.astype(np.int32)),
                    pa.ListArray.from_arrays(pa.array(np.arange(len(part) + 1, dtype=np.int32) * BANDS), pa.array(bucket.view(np.int64).ravel())),
                    pa.array([x.tobytes() for x in values], pa.binary()),
                ],
                names=["doc_id", "k", "node", "proof", "n_shingles", "buckets", "signature"],
            )
    trim()


def signed(docs: DataFrame) -> DataFrame:
    """doc_id, k (hash of id and text), node and proof (hashes of the set, null without words), n_shingles, buckets, signature."""
    t = text_or_empty("text")
    rows = docs.select("doc_id", F.xxhash64("doc_id", t).alias("k"), t.alias("t"))
    return rows.mapInArrow(_signed, f"doc_id {dict(docs.dtypes)['doc_id']}, k long, node long, proof long, n_shingles int, buckets array<long>, signature binary")


def apart(signs: DataFrame) -> DataFrame:
    """signs with sets of equal hash and other proof made nodes of their own, and the hash as `hash`."""
    clash = signs.where(F.col("node").isNotNull()).groupBy("node").agg(F.min("proof").alias("lo"), F.max("proof").alias("hi")).where("lo != hi").select("node", F.lit(True).alias("clash"))
    clash = stored(clash, "clashes")
    signs = signs.withColumn("hash", F.col("node"))
    if not clash.limit(1).count():
        return signs
    return signs.join(small(clash)[0], "node", "left").withColumn("node", F.when(F.col("clash"), F.xxhash64("node", "proof")).otherwise(F.col("node"))).drop("clash")


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        for first, part in groups(_texts(batch.column("t")), GROUP):
            owner, h = shingles(part)
            cut = np.searchsorted(owner, np.arange(len(part) + 1)).astype(np.int32)
            columns = [batch.column("k").slice(first, len(part)), pa.array(set_hash(owner, h, len(part))), pa.array(proof(owner, h, len(part)))]
            yield pa.RecordBatch.from_arrays([*columns, pa.ListArray.from_arrays(pa.array(cut), pa.array(h.view(np.int64)))], names=["k", "hash", "proof", "elements"])
    trim()


def sets_of(docs: DataFrame, signs: DataFrame, nodes: DataFrame, name: str) -> DataFrame:
    """node, elements of the wanted nodes, from the text of one document each."""
    # The document of a node is the one with the least k; equal rows are dropped below.
    wanted = signs.select("node", "k", "hash", "proof").join(small(nodes, BROADCAST_ROWS)[0], "node", "left_semi").groupBy("node").agg(F.min(F.struct("k", "hash", "proof")).alias("one"))
    wanted = stored(wanted.select("node", "one.*"), name)
    own, _ = small(wanted, BROADCAST_ROWS)
    t = text_or_empty("text")
    rows = docs.select(F.xxhash64("doc_id", t).alias("k"), t.alias("t")).join(own.select("k"), "k", "left_semi")
    # k alone might be that of another text too; its set is not the one that is wanted.
    found = rows.mapInArrow(_sets, "k long, hash long, proof long, elements array<long>").join(own, ["k", "hash", "proof"]).select("node", "elements")
    repeated = signs.join(own, ["node", "k"], "left_semi").groupBy("k").count().where("count > 1").limit(1).count()
    return found.dropDuplicates(["node"]) if repeated else found


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sets have a Jaccard similarity of SIMILAR or more."""
    own = pairs.join(sets.select(F.col("node").alias("a"), F.col("elements").alias("x")), "a")
    both = own.join(sets.select(F.col("node").alias("b"), F.col("elements").alias("y")), "b")
    common = F.size(F.array_intersect("x", "y"))
    return both.where(common >= SIMILAR * (F.size("x") + F.size("y") - common)).select("a", "b")


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, np.ndarray]]:
    """The rows of each group (bucket, lo, hi) of consecutive rows, one per node, as an array per column. A batch is turned into arrays once,
    as most groups have few rows."""
    held: list[dict[str, np.ndarray]] = []

    def whole() -> dict[str, np.ndarray]:
        rows = held[0] if len(held) == 1 else {c: np.concatenate([part[c] for part in held]) for c in held[0]}
        first = np.unique(rows["node"], return_index=True)[1]
        return rows if len(first) == len(rows["node"]) else {c: x[np.sort(first)] for c, x in rows.items()}

    for batch in batches:
        n = batch.num_rows
        columns = {c: batch.column(c).to_numpy() for c in ("bucket", "lo", "hi", "node", "comp", "block")}
        columns["bands"] = batch.column("buckets").flatten().to_numpy().reshape(n, BANDS)
        columns["values"] = np.frombuffer(b"".join(batch.column("signature").to_pylist()), np.uint32).reshape(n, K)
        if "elements" in batch.schema.names:
            at, flat = batch.column("elements").offsets.to_numpy(), batch.column("elements").values.to_numpy()
            columns["elements"] = np.empty(n, object)
            columns["elements"][:] = [flat[i:j] for i, j in zip(at[:-1], at[1:])]
        key = np.stack([columns[c].astype(np.int64) for c in ("bucket", "lo", "hi")], 1)
        cuts = [0, *(np.flatnonzero((key[1:] != key[:-1]).any(1)) + 1), n] if n else []
        for i, j in pairwise(cuts):
            part = {c: x[i:j] for c, x in columns.items()}
            if held and any(held[-1][c][0] != part[c][0] for c in ("bucket", "lo", "hi")):
                yield whole()
                held = []
            held.append(part)
    if held:
        yield whole()


def _plausible(rows: dict[str, np.ndarray]) -> Iterator[tuple[int, np.ndarray]]:
    """(i, others) of the rows of a group, of other components, whose signatures agree well enough and for which this bucket is the first that
    they share. Of a group of two blocks only pairs across them. Each pair once."""
    bucket, block, comp, bands, n = rows["bucket"][0], rows["block"], rows["comp"], rows["bands"], len(rows["node"])
    within = rows["lo"][0] == rows["hi"][0]
    order = np.arange(n) if within else np.argsort(block, kind="stable")
    # One value of all rows is a line, so lines are compared and added up; the sums are K at most and fit in a byte.
    values = np.ascontiguousarray(rows["values"][order].T)
    split = n - 1 if within else int((block == block[order[0]]).sum())
    for k in range(split):
        after, i = k + 1 if within else split, order[k]
        agree = (values[:, after:] == values[:, k : k + 1]).view(np.uint8).sum(0, dtype=np.uint8)
        rest = order[after + np.flatnonzero(agree >= PLAUSIBLE * K)]
        rest = rest[comp[rest] != comp[i]]
        if len(rest):
            yield i, rest[bands[rest, (bands[rest] == bands[i]).argmax(1)] == bucket]


def _candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Plausible pairs across components of each group; of a group with many of them a row without a pair instead."""
    found: list[tuple[dict[str, np.ndarray], np.ndarray, np.ndarray, bool]] = []
    held = 0

    def written() -> pa.RecordBatch:
        n = [len(a) for _, a, _, _ in found]
        group = [np.repeat([rows[c][0] for rows, _, _, _ in found], n) for c in ("bucket", "lo", "hi")]
        a, b = (np.concatenate([x[k] for x in found]) for k in (1, 2))
        return pa.RecordBatch.from_arrays([*map(pa.array, group), pa.array(a), pa.array(b), pa.array(np.repeat([dense for _, _, _, dense in found], n))], names=["bucket", "lo", "hi", "a", "b", "dense"])

    for rows in _keyed(batches):
        node, n = rows["node"], 0
        a, b = [], []
        for i, rest in _plausible(rows):
            a.append(np.full(len(rest), node[i]))
            b.append(node[rest])
            n += len(rest)
            if n > DENSE * len(node):
                break
        key = {c: rows[c][:1].copy() for c in ("bucket", "lo", "hi")}
        if n > DENSE * len(node):
            found.append((key, np.zeros(1, np.int64), np.zeros(1, np.int64), True))
        elif n:
            found.append((key, np.concatenate(a), np.concatenate(b), False))
        held += n
        if held > PAIRS:
            yield written()
            found, held = [], 0
    if found:
        yield written()


def _across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links across components in each group, whose rows have their sets; only those that join components."""
    for rows in _keyed(batches):
        node, comp, elements = rows["node"], rows["comp"].tolist(), rows["elements"]
        root = {c: c for c in comp}

        def find(c):
            while root[c] != c:
                root[c] = c = root[root[c]]
            return c

        found = []
        for i, rest in _plausible(rows):
            for j in rest:
                a, b = find(comp[i]), find(comp[j])
                if a != b:
                    x, y = elements[i], elements[j]
                    if min(len(x), len(y)) >= SIMILAR * max(len(x), len(y)):
                        common = len(np.intersect1d(x, y, assume_unique=True))
                        if common >= SIMILAR * (len(x) + len(y) - common):
                            root[a] = b
                            found.append((node[i], node[j]))
        if found:
            a, b = np.array(found, np.int64).T
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])


def _blocks(own: DataFrame) -> DataFrame:
    """bucket, node, comp, block, others of the buckets with more than one component. Nodes of a bucket's largest component are done with each
    other, so each of its blocks meets those of the other nodes only, which come first. others: how many blocks a node's block meets."""
    per = own.groupBy("bucket", "comp").agg(F.count(F.lit(1)).alias("n"))
    per = per.groupBy("bucket").agg(F.max(F.struct("n", "comp")).alias("most"), F.sum("n").alias("all"), F.count(F.lit(1)).alias("comps")).where("comps > 1")
    size = lambda n: F.ceil(n / BLOCK).cast("int")
    per = per.select("bucket", F.col("most.comp").alias("large"), size(F.col("most.n")).alias("large_blocks"), size(F.col("all") - F.col("most.n")).alias("small_blocks"))
    rows = own.join(small(stored(per, "open-buckets"), BROADCAST_ROWS)[0], "bucket")
    at, large = F.xxhash64("node", F.lit(3)), F.col("comp") == F.col("large")
    block = F.when(large, F.col("small_blocks") + F.pmod(at, F.col("large_blocks"))).otherwise(F.pmod(at, F.col("small_blocks"))).cast("int")
    others = F.col("small_blocks") + F.when(large, 0).otherwise(F.col("large_blocks"))
    return rows.select("bucket", "node", "comp", block.alias("block"), others.alias("others"))


def _dealt(rows: DataFrame, info: DataFrame, only: DataFrame | None = None) -> DataFrame:
    """The pairs of blocks of a bucket (or only some) as groups (bucket, lo, hi), rows of a group together, with what info has of their nodes."""
    other = F.explode(F.sequence(F.lit(0), F.col("others") - 1))
    dealt = rows.withColumn("other", other).withColumns({"lo": F.least("block", "other"), "hi": F.greatest("block", "other")}).drop("other", "others")
    if only is not None:
        dealt = dealt.join(small(only, BROADCAST_ROWS)[0], ["bucket", "lo", "hi"], "left_semi")
    return dealt.join(info, "node").repartition("bucket", "lo", "hi").sortWithinPartitions("bucket", "lo", "hi")


def links(docs: DataFrame, signs: DataFrame) -> DataFrame:
    """node, comp of all nodes that have a near duplicate among other sets."""
    own = signs.where(F.col("node").isNotNull()).select("node", F.explode("buckets").alias("bucket"))
    # Copies of a set fall together before they are shuffled.
    mates = stored(own.groupBy("bucket", "node").agg(F.lit(1).alias("one")).select("bucket", "node"), "buckets")
    sizes = stored(mates.groupBy("bucket").agg(F.count(F.lit(1)).alias("size")).where("size > 1"), "sizes")
    shared = stored(mates.join(small(sizes, BROADCAST_ROWS)[0], "bucket"), "shared")
    degree = shared.groupBy("node").agg(F.sum("size").alias("degree"))
    ranked = shared.join(degree, "node").select("bucket", "node", (F.col("degree") * (1 << 20) + F.pmod(F.xxhash64("node"), F.lit(1 << 20))).alias("rank"))
    hubs = stored(ranked.groupBy("bucket").agg(F.max_by("node", "rank").alias("hub")), "hubs")
    spokes = shared.join(small(hubs, BROADCAST_ROWS)[0], "bucket").where("node != hub").select(F.col("node").alias("a"), F.col("hub").alias("b")).distinct()
    spokes = stored(spokes, "spokes")
    ends = stored(spokes.select(F.col("a").alias("node")).union(spokes.select(F.col("b").alias("node"))).distinct(), "ends")
    sets = stored(sets_of(docs, signs, ends, "wanted"), "sets")
    good = stored(verified(spokes, sets), "links")
    comps = stored(components(good), "components")
    own = shared.select("bucket", "node").join(small(comps, BROADCAST_ROWS)[0], "node", "left").select("bucket", "node", F.coalesce("comp", "node").alias("comp"))
    own = stored(own, "own")
    rows = _blocks(own)
    rows = stored(rows, "open")
    dropped(mates, sizes, shared, hubs, spokes, ends, own)
    if not rows.limit(1).count():
        return comps
    info = signs.where(F.col("node").isNotNull()).select("node", "buckets", "signature").join(small(stored(rows.select("node").distinct(), "open-nodes"), BROADCAST_ROWS)[0], "node", "left_semi")
    info = info.dropDuplicates(["node"])
    # Signatures alone go to the pairs of blocks; sets only to the few pairs that are left. A group of very many plausible
    # pairs is not written out in pairs: its rows get their sets, and pairs are checked in place.
    found = stored(_dealt(rows, info).mapInArrow(_candidates, "bucket long, lo int, hi int, a long, b long, dense boolean"), "candidates")
    pairs = found.where("not dense").select("a", "b").distinct()
    more = verified(pairs, sets)
    dense = stored(found.where("dense").select("bucket", "lo", "hi").distinct(), "dense")
    if dense.limit(1).count():
        more = more.union(_dealt(rows, info.join(sets, "node"), dense).mapInArrow(_across, "a long, b long"))
    more = stored(more, "more")
    out = components(good.union(more)) if more.limit(1).count() else comps
    dropped(sets, rows, found, dense)
    return out


def classes(docs: DataFrame) -> DataFrame:
    """doc_id, k, node, n_shingles, class_id, comp: one row per document row."""
    signs = apart(stored(signed(docs), "signed"))
    comps = links(docs, signs)
    rows = signs.select("doc_id", "k", "node", "n_shingles")
    per = rows.where(F.col("node").isNotNull()).groupBy("node").agg(F.min("doc_id").alias("least"))
    # Only linked nodes have to be named by another; their components are as many as groups of near duplicates.
    linked = stored(per.join(small(comps, BROADCAST_ROWS)[0], "node", "left"), "nodes")
    ids = stored(linked.where(F.col("comp").isNotNull()).groupBy("comp").agg(F.min("least").alias("class_id")), "classes")
    named = linked.join(small(ids, BROADCAST_ROWS)[0], "comp", "left").select("node", F.coalesce("comp", "node").alias("comp"), F.when(F.col("comp").isNull(), F.col("least")).otherwise(F.col("class_id")).alias("class_id"))
    named = stored(named, "named")
    out = rows.join(named, "node", "left")
    return out.withColumn("class_id", F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("class_id")))


def op9_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, class_id (the least doc_id of its class), n_shingles."""
    return classes(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "n_shingles")


def _identity() -> list[Column]:
    """What tells a document from others: its id, and a hash of id and text."""
    return [F.coalesce(F.concat(F.lit("v"), F.col("doc_id").cast("string")), F.lit("")).alias("d"), F.xxhash64("doc_id", text_or_empty("text")).alias("k")]


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each class: that with the least doc_id, of rows of that id the one with the least hash of its text; equal
    rows count once. Documents without words stay."""
    own = stored(classes(docs).where(F.col("node").isNotNull()).select("doc_id", _identity()[0], "k", "comp", "class_id"), "members")
    first = own.where(F.col("doc_id").eqNullSafe(F.col("class_id"))).groupBy("comp").agg(F.min("k").alias("first"))
    # A member goes if another document of its class stays.
    first = stored(first, "first")
    gone = own.join(small(first, BROADCAST_ROWS)[0], "comp").where((F.col("k") != F.col("first")) | ~F.col("doc_id").eqNullSafe(F.col("class_id"))).select("d", "k").distinct()
    gone = stored(gone, "gone")
    rows = docs.select(F.struct(*docs.columns).alias("row"), *_identity())
    rows = rows.join(small(gone, BROADCAST_ROWS)[0], ["d", "k"], "left_anti")
    # Equal rows, id and all, have one identity: only where there are any, one of each is taken.
    if own.groupBy("d", "k").count().where("count > 1").limit(1).count():
        rows = rows.dropDuplicates(["d", "k"])
    return rows.select("row.*")
