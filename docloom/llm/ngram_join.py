"""Near duplicates: a Jaccard join on word n-grams by MinHash banding.

Words are runs of letters and digits of the lower-cased text (ASCII punctuation and blanks stand
between words; every non-ASCII character counts as a letter). A text's set holds its distinct
five-word grams; one to four words give one gram of all of them. Two texts are linked when the
Jaccard similarity of their sets is at least ``threshold``.

1. One pass gives each text a 128-bit fingerprint of its set, the set's size and its band hashes.
   Texts with equal sets form one class, represented by its smallest ``doc_id``, so copies travel
   once from here on. Rows per band and bands follow from the recall asked for: ``recall`` is the
   probability that a pair *at* the threshold shares a band (more similar pairs miss less).
2. Representatives meet on band hashes. A bucket only links its members to its least member (a
   star, never pairs); connected components of these links hold every pair that shares a band.
3. Members meet in places and are verified on their full sets there, in blocks of bounded size,
   block against block. Where most members of a component share bands (groups of near copies) the
   place is the component. A component with more than ``SPARSE`` times the pairs that a band joins in
   it on average (chains, in which most pairs have little in common) is met bucket by bucket:
   equal buckets once, and each pair in the first band that it shares. Sets whose sizes differ by more
   than the threshold allows lie in size levels that never meet. Every pair that shares a band is
   verified, so the work follows those pairs, not the square of a chain; in a component met as a
   whole the other pairs are verified as well. Blocks give counts and spanning links, not pairs.
4. The components of the verified links are the classes of near duplicates.

Defined cases: a null text is empty; a text without words has no grams, links to nothing and is a
class of its own; rows with equal ``doc_id`` and text are copies of each other; a null ``doc_id``
is smaller than every other; an empty table gives an empty result; columns other than ``doc_id``
and ``text`` are ignored here.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import (
    NULL_ID, batch, byte_column, column_array, doc_id_of, grouped, keyed_texts, list_array, map_arrow,
    shuffle_partitions, slices, stored,
)
from docloom.llm.components import connected_components
from docloom.llm.hashing import grams, mix
from docloom.llm.windows import packed_texts, unpacked
from docloom.llm.words import NOT_ALNUM, word_hashes, word_spans

N = 5
THRESHOLD = 0.8
RECALL = 0.9999
#: Hash functions a text may cost; the most rows per band within it are taken.
MOST_HASHES = 96
#: Pairs of a component for each pair that a band joins in it, from which on it is met by buckets.
SPARSE = 8
#: Members of a place that are verified against as many others at a time, and the grams that
#: such a block of members has about.
BLOCK, BLOCK_GRAMS = 512, 1 << 19

_SIGNED = pa.schema([
    ("doc", pa.int64()), ("tag", pa.int64()), ("f1", pa.int64()), ("f2", pa.int64()),
    ("size", pa.int32()), ("bands", pa.list_(pa.int64())),
])
_SIGNED_TYPE = "doc long, tag long, f1 long, f2 long, size int, bands array<long>"


def bands_and_rows(threshold: float, recall: float, most: int = MOST_HASHES) -> tuple[int, int]:
    """Bands and rows per band: the most rows for which enough bands stay within ``most`` hashes."""
    best = None
    for rows in range(1, most + 1):
        shared = threshold**rows
        bands = 1 if shared >= 1 else math.ceil(math.log(1 - recall) / math.log1p(-shared))
        if best is None or bands * rows <= most:
            best = bands, rows
        else:
            break
    return best


def gram_hashes(raw: np.ndarray, offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The n-gram hashes of a batch of lower-cased texts, repeated ones too, and the offsets of
    the texts' grams."""
    starts, ends, first = word_spans(raw, offsets, NOT_ALNUM)
    words = word_hashes(raw, starts, ends)
    counts = np.diff(first)
    sizes = np.where(counts >= n, counts - n + 1, (counts > 0).astype(np.int64))
    out = np.zeros(len(sizes) + 1, np.int64)
    np.cumsum(sizes, out=out[1:])
    found = np.empty(out[-1], np.uint64)
    whole = grams(words, n)
    row = np.repeat(np.arange(len(sizes)), sizes)
    place = np.arange(out[-1]) - out[:-1][row] + first[:-1][row]
    long = (counts >= n)[row]
    found[long] = whole[place[long]]
    for i in np.flatnonzero((counts > 0) & (counts < n)).tolist():
        found[out[i]] = grams(words[first[i] : first[i + 1]], int(counts[i]))[0]
    return found, out


def _sign(n: int, bands: int, rows: int):
    rng = np.random.default_rng(1)
    seeds = rng.integers(0, 2**63, (bands * rows, 2)).astype(np.uint64)
    seeds[:, 1] |= np.uint64(1)

    def work(docs, tags, raw, offsets) -> pa.RecordBatch:
        found, offs = gram_hashes(raw, offsets, n)
        some = np.flatnonzero(np.diff(offs))
        f1, f2, size = (np.zeros(len(docs), k) for k in (np.uint64, np.uint64, np.int32))
        band_hashes = np.zeros((len(some), bands), np.uint64)
        if len(some):
            heads = offs[:-1][some]
            row = np.repeat(np.arange(len(some), dtype=np.uint64), np.diff(offs)[some])
            place = np.sort(row << np.uint64(52) | found >> np.uint64(12))
            once = np.ones(len(place), bool)
            once[1:] = place[1:] != place[:-1]
            place = place[once]
            of = (place >> np.uint64(52)).astype(np.int64)
            size[some] = np.bincount(of, minlength=len(some))
            first = np.searchsorted(of, np.arange(len(some)))
            gram = place & np.uint64(2**52 - 1)
            f1[some] = np.add.reduceat(mix(gram), first)
            f2[some] = np.add.reduceat(mix(gram ^ np.uint64(0x5851F42D4C957F2D)), first)
            for b in range(bands):
                h = np.full(len(some), b + 1, np.uint64)
                for a, m in seeds[b * rows : (b + 1) * rows]:
                    h = mix(h * m + np.minimum.reduceat((found ^ a) * m, heads))
                band_hashes[:, b] = h
        lengths = np.zeros(len(docs), np.int64)
        lengths[some] = bands
        return batch(
            _SIGNED, docs, tags, f1.view(np.int64), f2.view(np.int64), size,
            list_array(band_hashes.ravel().view(np.int64), lengths, pa.int64()),
        )

    def job(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            raw, offsets = byte_column(pc.utf8_lower(part.column("text")))
            docs, tags = np.asarray(part.column("doc")), np.asarray(part.column("tag"))
            for i, j in slices(offsets):
                for k in range(i, j, 4096):  # a text's place in the slice takes 12 bits
                    m = min(k + 4096, j)
                    cut = offsets[k : m + 1]
                    yield work(docs[k:m], tags[k:m], raw[cut[0] : cut[-1]], cut - cut[0])

    return job


def _sets(n: int):
    schema = pa.schema([("node", pa.int64()), ("grams", pa.binary())])

    def job(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            out = []
            for packed in part.column("packed").to_pylist():
                text = pc.utf8_lower(pa.array([unpacked(packed).decode()]))
                found, _ = gram_hashes(*byte_column(text), n)
                out.append(np.unique(found).tobytes())
            yield batch(schema, part.column("node"), out)

    return job


def jaccard_links(a: list[np.ndarray], b: list[np.ndarray] | None, threshold: float, columns: int = 2048) -> np.ndarray:
    """Which pairs of sets are linked, as a matrix; ``b=None`` compares ``a`` with itself, where a
    set isn't linked to itself. Grams in one set only add nothing and are left out."""
    every = a + (b or [])
    sizes = np.array([len(s) for s in every])
    flat = np.concatenate(every) if every else np.zeros(0, np.uint64)
    owner = np.repeat(np.arange(len(every)), sizes)
    _, gram, df = np.unique(flat, return_inverse=True, return_counts=True)
    shared = df[gram] > 1
    gram, owner = gram[shared], owner[shared]
    _, gram = np.unique(gram, return_inverse=True)
    order = np.argsort(gram, kind="stable")
    gram, owner = gram[order], owner[order]
    na, nb = len(a), len(b) if b is not None else len(a)
    common = np.zeros((na, nb), np.float64)
    total = int(gram[-1]) + 1 if len(gram) else 0
    for c in range(0, total, columns):
        lo, hi = np.searchsorted(gram, [c, c + columns])
        has = np.zeros((len(every), min(columns, total - c)), np.float32)
        has[owner[lo:hi], gram[lo:hi] - c] = 1
        common += has[:na] @ (has if b is None else has[na:]).T
    size_a, size_b = sizes[:na, None], (sizes[None, :na] if b is None else sizes[None, na:])
    linked = common >= threshold * (size_a + size_b - common) - 1e-9
    if b is None:
        np.fill_diagonal(linked, False)
    return linked


def _spanning(reps: np.ndarray, adjacent: np.ndarray) -> np.ndarray:
    """The least representative that each one reaches over the links of a square matrix."""
    label = reps.copy()
    while True:
        least = np.minimum(label, np.where(adjacent, label[None, :], np.iinfo(np.int64).max).min(1))
        if (least == label).all():
            return label
        label = least


def _due(group: pa.Table, first: np.ndarray, other: np.ndarray) -> np.ndarray | None:
    """Which pairs of a bucket share no earlier band; all pairs (None) where a component meets."""
    band = group.column("band")[0].as_py()
    if band == WHOLE:
        return None
    bands = np.array(group.column("bands").to_pylist(), np.int64)[:, :band]
    return ~(bands[first, None] == bands[None, other]).any(2)


def _due_links(a: list[np.ndarray], b: list[np.ndarray] | None, due: np.ndarray | None, threshold: float) -> np.ndarray:
    """``jaccard_links`` of the pairs that are due; sets without any are not compared."""
    if due is None:
        return jaccard_links(a, b, threshold)
    if b is None:
        np.fill_diagonal(due, False)
    rows, columns = np.flatnonzero(due.any(1)), np.flatnonzero(due.any(0))
    linked = np.zeros_like(due)
    if len(rows):
        some = jaccard_links([a[k] for k in rows], None if b is None else [b[k] for k in columns], threshold)
        linked[np.ix_(rows, columns)] = some
    return linked & due


#: The key of a meeting: a bucket of a band, or a component as a whole, two size levels, a block of each.
PLACE = ["place", "band", "lo", "i", "hi", "j"]
WHOLE = -1
_LINKED = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("links", pa.int64())])


def _verify(threshold: float):
    def job(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in grouped(batches, PLACE):
            rep, copies, second = (np.asarray(group.column(c)) for c in ("rep", "copies", "second"))
            sets = [np.frombuffer(g, np.uint64) for g in group.column("grams").to_pylist()]
            own = group.column("lo")[0] == group.column("hi")[0] and group.column("i")[0] == group.column("j")[0]
            first, other = np.flatnonzero(~second), np.flatnonzero(second)
            if len(rep) < 2 or not own and not (len(first) and len(other)):
                continue
            due = _due(group, first, first if own else other)
            if own:
                order, whole = np.arange(len(rep)), _due_links(sets, None, due, threshold)
            else:
                linked = _due_links([sets[k] for k in first], [sets[k] for k in other], due, threshold)
                order = np.concatenate([first, other])
                whole = np.zeros((len(order),) * 2, bool)
                whole[: len(first), len(first) :] = linked
                whole[len(first) :, : len(first)] = linked.T
            some = whole.any(1)
            if some.any():
                reps, weight = rep[order], copies[order]
                links = whole @ weight
                yield batch(_LINKED, reps[some], _spanning(reps, whole)[some], links[some])

    return job


def _meetings(members: DataFrame, threshold: float, block: int) -> DataFrame:
    """``(place, band, bands, node, copies, meets)``: the block meetings each member takes part in."""
    level = F.floor(F.log("size") / math.log(1 / threshold) + 1e-9).cast("int")
    members = members.withColumn("level", level)
    counts = members.groupBy("place", "band", "level").agg(
        F.ceil(F.greatest(F.count(F.lit(1)) / block, F.sum("size") / BLOCK_GRAMS)).cast("int").alias("blocks")
    )
    around = counts
    for name, step in (("above", -1), ("below", 1)):
        next_ = counts.select("place", "band", (F.col("level") + step).alias("level"), F.col("blocks").alias(name))
        around = around.join(next_, ["place", "band", "level"], "left")
    # stored, so that Spark can split the join where one place has very many members
    m = members.join(stored(around, "levels"), ["place", "band", "level"])
    m = m.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))

    def meets(count: str, lo, i, hi, j, second):
        every = F.sequence(F.lit(0), F.col(count) - 1)
        return F.when(F.col(count).isNull(), F.array()).otherwise(
            F.transform(every, lambda k: F.struct(lo.alias("lo"), i(k).alias("i"), hi.alias("hi"), j(k).alias("j"), second(k).alias("second")))
        )

    lev, own = F.col("level"), F.col("block")
    return m.select(
        "place", "band", "bands", "node", "copies",
        F.concat(
            meets("blocks", lev, lambda k: F.least(own, k), lev, lambda k: F.greatest(own, k), lambda k: k < own),
            meets("above", lev, lambda k: own, lev + 1, lambda k: k, lambda k: F.lit(False)),
            meets("below", lev - 1, lambda k: k, lev, lambda k: own, lambda k: F.lit(True)),
        ).alias("meets"),
    )


def _places(members: DataFrame, shared: DataFrame) -> DataFrame:
    """``(place, band, bands, node, copies, size)``: where each member meets others, ``bands`` only in
    buckets. ``members`` has ``(component, node, copies, size, bands)``, ``shared`` the buckets of
    two members and more with two fingerprints of their members."""
    # ``hub`` is a member itself
    owned = shared.join(members.select(F.col("node").alias("hub"), "component"), "hub")
    joined = owned.groupBy("component").agg(F.sum(F.col("n") * (F.col("n") - 1)).alias("joined"))
    size = members.groupBy("component").agg(F.count(F.lit(1)).alias("n"), F.max(F.size("bands")).alias("bands"))
    sparse = size.join(joined, "component").where(F.col("n") * (F.col("n") - 1) * F.col("bands") > SPARSE * F.col("joined"))
    # stored, so that Spark can split the join where one component has very many members
    sparse = stored(sparse.select("component", F.lit(True).alias("sparse")), "sparse")
    marked = stored(members.join(sparse, "component", "left"), "marked")
    whole = marked.where("sparse is null").select(
        F.col("component").alias("place"), F.lit(WHOLE).alias("band"), F.lit(None).cast("array<long>").alias("bands"), "node", "copies", "size"
    )
    once = owned.join(sparse, "component").groupBy("hub", "n", "print", "other_print").agg(F.min(F.struct("band", "hash")).alias("first"))
    once = stored(once.select("first.band", F.col("first.hash").alias("place")), "buckets-once")
    rows = marked.where("sparse").select("*", F.posexplode("bands").alias("band", "place"))
    return whole.unionByName(rows.select(*whole.columns).join(once, ["band", "place"]))


def near_duplicates(
    docs: DataFrame, threshold: float = THRESHOLD, n: int = N, recall: float = RECALL, block: int = BLOCK
) -> DataFrame:
    """One row per row of ``docs``: ``(doc_id, tag, set_id, class_id, class_tag, n_links)``.

    ``set_id`` is the smallest ``doc_id`` with the same set, ``class_id`` the smallest of the
    class of near duplicates, ``n_links`` the number of other rows at the threshold or above,
    copies included. A ``doc_id`` that rows share may be the ``class_id`` of several classes;
    ``(class_id, class_tag)`` is the key of the class's representative and names one class only.
    """
    spark = docs.sparkSession
    texts = keyed_texts(docs)
    parts = shuffle_partitions(spark)
    bands, rows = bands_and_rows(threshold, recall)
    signed = stored(map_arrow(texts, _sign(n, bands, rows), _SIGNED_TYPE), "signatures")
    reps = stored(
        signed.where("size > 0").groupBy("f1", "f2", "size")
        .agg(F.min(F.struct("doc", "tag", "bands")).alias("first"), F.count(F.lit(1)).alias("copies"))
        .select("f1", "f2", "size", "copies", F.col("first.doc").alias("rep"), F.col("first.tag").alias("rep_tag"), "first.bands"),
        "representatives",
    )
    # a representative is named by its key, which may repeat when rows share a doc_id
    named = reps.withColumn("node", F.xxhash64("rep", "rep_tag"))
    buckets = named.select("node", F.posexplode("bands").alias("band", "hash"))
    shared = buckets.groupBy("band", "hash").agg(
        F.min("node").alias("hub"), F.max("node").alias("last"), F.count(F.lit(1)).alias("n"),
        F.bit_xor(F.xxhash64("node")).alias("print"), F.bit_xor(F.xxhash64("node", F.lit(1))).alias("other_print"),
    )
    shared = stored(shared.where("hub < last").drop("last"), "buckets")
    stars = buckets.join(shared.select("band", "hash", "hub"), ["band", "hash"]).where("node <> hub")
    candidates = connected_components(stars.select(F.col("node").alias("a"), F.col("hub").alias("b")))
    members = stored(named.join(candidates, "node"), "members")

    meetings = _meetings(stored(_places(members, shared), "places"), threshold, block)
    wanted = packed_texts(texts.dropDuplicates(["doc", "tag"]) if _repeats_rows(signed) else texts)
    # the same plan at every size: the members of a large table fit in no task's memory
    keys = members.select(F.col("rep").alias("doc"), F.col("rep_tag").alias("tag"), "node")
    wanted = wanted.join(keys.hint("merge"), ["doc", "tag"])
    sets = map_arrow(wanted.select("node", "packed"), _sets(n), "node long, grams binary")
    meetings = meetings.select("place", "band", "bands", "node", "copies", F.explode("meets").alias("m"))
    pairs = meetings.select("place", "band", "bands", "node", "copies", "m.*").join(sets, "node").withColumnRenamed("node", "rep")
    met = pairs.repartition(parts, *PLACE).sortWithinPartitions(*PLACE)
    linked = stored(map_arrow(met, _verify(threshold), "a long, b long, links long"), "verified")

    classes = connected_components(linked.select("a", "b"))
    degrees = linked.groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("links"))
    named = members.select("node", "rep", "rep_tag", "f1", "f2", "size").join(classes, "node").join(degrees, "node")
    least = named.groupBy("component").agg(F.min(F.struct("rep", "rep_tag")).alias("class"))
    named = named.join(least, "component").select("f1", "f2", "size", "class", "links")
    # stored, so that Spark can split the join below where one set has very many copies
    per_set = stored(
        reps.select("f1", "f2", "size", "rep", "rep_tag", "copies").join(named, ["f1", "f2", "size"], "left"), "classes"
    )
    out = signed.drop("bands").join(per_set, ["f1", "f2", "size"], "left")
    return out.select(
        doc_id_of().alias("doc_id"), "tag",
        F.nullif(F.coalesce("rep", "doc"), F.lit(NULL_ID)).alias("set_id"),
        F.nullif(F.coalesce("class.rep", "rep", "doc"), F.lit(NULL_ID)).alias("class_id"),
        F.coalesce("class.rep_tag", "rep_tag", "tag").alias("class_tag"),
        (F.coalesce("links", F.lit(0)) + F.coalesce("copies", F.lit(1)) - 1).alias("n_links"),
    )


def _repeats_rows(signed: DataFrame) -> bool:
    """Whether two rows share ``doc_id`` and text; then only one of them may stand for its set."""
    rows = signed.groupBy("doc", "tag").agg(F.count(F.lit(1)).alias("rows"))
    return bool(rows.where("rows > 1").limit(1).count())
