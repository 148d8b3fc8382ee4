"""Operator 10: near-duplicate documents by bottom-k sketches of one hash function.

A document is its set of distinct word shingles.  Documents with
``100 * |A & B| >= similarity * |A | B|`` are linked; a component is what links
reach.

1. *Sketches.*  One 64-bit hash of each shingle; the ``SKETCH`` smallest are kept.
   Equal sets (by a 128-bit digest and the size) form a class, represented by its
   smallest identifier, so copies never meet each other again.
2. *Inverted lists.*  Each class posts some of its retained values: its smallest
   ones in an order in which values held by more than ``LIST`` classes come last.
   A set of size n that is within the similarity of another shares a value among
   the first ``n - ceil(s n) + 1`` of any common order, so with that many postings
   no link is lost.  Larger classes post ``POSTED``; one of which frequent values
   make up more than 3 / 8 also posts its ``PLAIN`` plainly smallest values.
3. *Short lists* give pairs with their overlaps by a join inside the list.  The
   best pair of each class is verified first; then all pairs that still connect
   different components, after the estimate from the union sketch.
4. *Long lists* (large groups of near copies, text that many share) are never
   joined pairwise: their members are cut into blocks of similar set sizes, and a
   task compares two blocks of sizes that can be linked by a product of incidence
   matrices, verifies only pairs of different components that pass the estimate,
   and returns a spanning forest of the verified links.  A pair that stands in long
   lists is compared in one of them, whatever short lists it shares.
5. Every link is verified on the full sets of 64-bit shingle hashes.

A pair of sets of up to ``SKETCH`` elements is never missed.  Of larger ones two
things can miss a link: the estimate from two sketches (a chance below 8e-8), and
that fewer than ``OVERLAP`` posted values are common (below 1e-9: a pair with a
common value in a long list is compared there; one without has all its common
posted values in short lists, and is verified from ``OVERLAP`` of them on).

The components of verified links are found by label propagation with pointer
jumping over written tables.  Nothing is dropped: the bounds choose between ways,
all of which cover every member.

Defined results: a null or empty text, or one without words, has no shingles and
is linked with nothing; a text of fewer words than a shingle is one shingle; equal
sets are linked whatever their order; rows with equal identifiers are one node; a
row with a null identifier is its own (null) component and kept; an empty table
gives no rows; further columns are ignored.  Texts are taken whole, however long.
Ties do not exist: the smallest identifier names a class and a component.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerfold.llm.common import cut, discard, give_back, python_ready, table, text_of, worker_task

WORDS = 4
SIMILARITY = 80
SKETCH = 128
#: Postings of a class, and further ones of a class with many frequent values.
POSTED, PLAIN = 32, 20
#: Common short lists from which a pair of large sets is verified.
OVERLAP = 4
#: Classes from which a value counts as frequent and a list as long.
LIST = 64
#: Retained values whose frequencies are counted.
COUNTED = SKETCH
#: Most frequent values that are told to the tasks.  More would be treated as rare
#: ones: the order of postings stays common to all classes, and a list is long by
#: its length, so that lists get longer but no pair is lost.
FREQUENT = 1_000_000
BLOCK = 1024
BLOCK_ELEMENTS = 1_000_000
#: Union-sketch estimates below this (in hundredths) are no links: 5.6 standard
#: deviations below the similarity for two sketches of 128.
ESTIMATE = 60
#: Pairs of two blocks from which their full sets are compared by a matrix product.
MANY_PAIRS = 2048
BROADCAST_IDS = 2_000_000

BLANKS = r"[\x20\x09-\x0D]+"


# --- shingles ------------------------------------------------------------------


def mixed(x: np.ndarray) -> np.ndarray:
    """The finaliser of a 64-bit mixing generator; bijective."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_sets(texts: pa.Array, words: int = WORDS) -> list[np.ndarray]:
    """For each text the sorted distinct hashes of its shingles."""
    normal = pc.utf8_trim(pc.replace_substring_regex(pc.ascii_lower(texts), BLANKS, " "), " ")
    lists = pc.split_pattern(normal, " ")
    flat, offsets = lists.flatten(), lists.offsets.to_numpy().astype(np.int64)
    offsets = offsets - offsets[0]
    coded = flat.dictionary_encode()
    hashes = pd.util.hash_array(coded.dictionary.to_numpy(zero_copy_only=False), categorize=False) if len(coded.dictionary) else np.zeros(0, np.uint64)
    word = hashes[coded.indices.to_numpy(zero_copy_only=False)]
    empty = pc.equal(normal, "").to_numpy(zero_copy_only=False)
    # Hash of the shingle that starts at each word; those that would cross into the
    # next text are not used.
    with np.errstate(over="ignore"):
        run = np.zeros(len(word), np.uint64)
        for i in range(words):
            part = word[i:]
            run[: len(part)] = mixed(run[: len(part)] * np.uint64(0x9E3779B97F4A7C15) + part + np.uint64(i + 1))
        out = []
        for i in range(len(texts)):
            a, b = offsets[i], offsets[i + 1]
            if empty[i]:
                out.append(np.zeros(0, np.uint64))
            elif b - a < words:
                h = np.uint64(len(word[a:b]))
                for w in word[a:b]:
                    h = mixed(h * np.uint64(0x9E3779B97F4A7C15) + w + np.uint64(97))
                out.append(np.array([h], np.uint64))
            else:
                out.append(np.unique(run[a : b - words + 1]))
    return out


def linked(common, a, b, similarity: int = SIMILARITY):
    """Whether sets of sizes a and b with so many common elements are linked."""
    return 100 * common >= similarity * (a + b - common)


def prefix(n: int, similarity: int = SIMILARITY) -> int:
    """So many first elements of any common order decide whether a link can exist."""
    return n - -(-n * similarity // 100) + 1


def signed(x: np.ndarray) -> np.ndarray:
    """Order-preserving map of unsigned to signed 64-bit numbers."""
    return (x ^ np.uint64(1 << 63)).view(np.int64)


_DIGEST = 16


def sketches(docs: DataFrame, id_column: str, text_column: str, words: int) -> DataFrame:
    """``doc_id, n, h1, h2, sketch`` of every row."""

    def run(batches):
        for batch in batches:
            sets = shingle_sets(batch.column(1), words)
            digests = [hashlib.blake2b(s.tobytes(), digest_size=_DIGEST).digest() for s in sets]
            h = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
            kept = [signed(s[:SKETCH]) for s in sets]
            ends = np.concatenate([[0], np.cumsum([len(k) for k in kept])]).astype(np.int32)
            flat = np.concatenate(kept) if kept else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([
                batch.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(h[:, 0].copy()), pa.array(h[:, 1].copy()),
                pa.ListArray.from_arrays(pa.array(ends), pa.array(flat)),
            ], names=["doc_id", "n", "h1", "h2", "sketch"])

    rows = docs.select(F.col(id_column).cast("bigint").alias("doc_id"), text_of(text_column).alias("text"))
    return rows.mapInArrow(worker_task(run), "doc_id bigint, n bigint, h1 bigint, h2 bigint, sketch array<bigint>")


def bounded_join(left: DataFrame, ids: DataFrame, how: str) -> DataFrame:
    """Join on the common columns; the right side is broadcast only if its rows
    were counted to be few, else both sides are shuffled."""
    if ids.count() <= BROADCAST_IDS:
        ids = F.broadcast(ids)
    return left.join(ids, [c for c in ids.columns if c in left.columns], how)


def if_small(written: DataFrame) -> DataFrame:
    """A written table, to be broadcast if its rows were counted to be few: the rows
    joined to it need not meet by its key then, of which one may hold a third."""
    return F.broadcast(written) if written.count() <= BROADCAST_IDS else written


def full_sets(docs: DataFrame, ids: DataFrame, id_column: str, text_column: str, words: int) -> DataFrame:
    """``rep, set`` of the documents with these identifiers, read again."""

    def run(batches):
        for batch in batches:
            kept = [signed(s) for s in shingle_sets(batch.column(1), words)]
            ends = np.concatenate([[0], np.cumsum([len(k) for k in kept])]).astype(np.int32)
            flat = np.concatenate(kept) if kept else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], names=["rep", "set"])

    rows = docs.select(F.col(id_column).cast("bigint").alias("rep"), text_of(text_column).alias("text"))
    return bounded_join(rows, ids.select("rep"), "left_semi").mapInArrow(worker_task(run), "rep bigint, set array<bigint>")


# --- postings ------------------------------------------------------------------


def frequent_values(classes: DataFrame) -> np.ndarray:
    """Sorted values retained by more than LIST classes."""
    counted = classes.select(F.explode(F.slice("sketch", 1, COUNTED)).alias("v")).groupBy("v").count().where(F.col("count") > LIST)
    rows = counted.orderBy(F.desc("count"), "v").limit(FREQUENT).select("v").toArrow()
    return np.sort(rows.column("v").to_numpy())


def keys_of(sketch: np.ndarray, n: int, frequent: np.ndarray) -> np.ndarray:
    """The values under which a class is posted."""
    at = np.searchsorted(frequent, sketch)
    common = (at < len(frequent)) & (frequent[np.minimum(at, len(frequent) - 1)] == sketch) if len(frequent) else np.zeros(len(sketch), bool)
    most = min(prefix(n), POSTED)
    keys = np.concatenate([sketch[~common], sketch[common]])[:most]
    if 8 * common.sum() > 3 * len(sketch) and prefix(n) > POSTED:
        keys = np.union1d(keys, sketch[:PLAIN])
    return np.sort(keys)


def posted(classes: DataFrame, frequent: np.ndarray) -> DataFrame:
    """``rep, n, keys`` of every class that can be linked to another."""
    shared = classes.sparkSession.sparkContext.broadcast(frequent)  # at most FREQUENT numbers

    def run(batches):
        for batch in batches:
            values, ends = batch.column("sketch").flatten().to_numpy(), batch.column("sketch").offsets.to_numpy()
            ends = ends - ends[0]
            n = batch.column("n").to_numpy()
            kept = [keys_of(values[ends[i] : ends[i + 1]], int(n[i]), shared.value) for i in range(len(n))]
            stops = np.concatenate([[0], np.cumsum([len(k) for k in kept])]).astype(np.int32)
            flat = np.concatenate(kept) if kept else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column("rep"), batch.column("n"), pa.ListArray.from_arrays(pa.array(stops), pa.array(flat))], names=["rep", "n", "keys"])

    # Three elements or fewer: only an equal set is similar enough.
    return classes.where(F.col("n") > 3).select("rep", "n", "sketch").mapInArrow(worker_task(run), "rep bigint, n bigint, keys array<bigint>")


# --- verification --------------------------------------------------------------


def with_both(pairs: DataFrame, sets: DataFrame, column: str) -> DataFrame:
    left = sets.select(F.col("rep").alias("a"), F.col(column).alias("x"))
    right = sets.select(F.col("rep").alias("b"), F.col(column).alias("y"))
    return pairs.select("a", "b").join(left, "a").join(right, "b").select("a", "b", "x", "y")


def verified(pairs: DataFrame, sets: DataFrame, similarity: int) -> DataFrame:
    """The pairs whose full sets are similar enough."""

    def run(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("x"), batch.column("y"), strict=True):
                x, y = x.values.to_numpy(), y.values.to_numpy()
                keep.append(bool(linked(len(np.intersect1d(x, y, assume_unique=True)), len(x), len(y), similarity)))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return with_both(pairs, sets, "set").mapInArrow(worker_task(run), "a bigint, b bigint").distinct()


def estimated(pairs: DataFrame, classes: DataFrame, estimate: int) -> DataFrame:
    """The pairs whose union sketch makes a link possible."""

    def run(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("x"), batch.column("y"), strict=True):
                x, y = x.values.to_numpy(), y.values.to_numpy()
                upto = min(x[-1] if len(x) == SKETCH else np.iinfo(np.int64).max, y[-1] if len(y) == SKETCH else np.iinfo(np.int64).max)
                x, y = x[: np.searchsorted(x, upto, "right")], y[: np.searchsorted(y, upto, "right")]
                common = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * common >= estimate * (len(x) + len(y) - common))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return with_both(pairs, classes, "sketch").mapInArrow(worker_task(run), "a bigint, b bigint").distinct()


# --- components ----------------------------------------------------------------


def components(links: DataFrame, scratch: list[str]) -> DataFrame:
    """``rep, comp``: the smallest node reachable from each node of a link.

    Every round takes the smallest label around each node and then the label's
    label; rounds are written tables, so lineage stays short."""
    edges = cut(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges", scratch)
    labels = cut(edges.groupBy(F.col("a").alias("rep")).agg(F.least(F.col("rep"), F.min("b")).alias("comp")), "labels", scratch)
    while True:
        around = edges.join(labels.select(F.col("rep").alias("b"), "comp"), "b").groupBy(F.col("a").alias("rep")).agg(F.min("comp").alias("near"))
        lower = labels.join(around, "rep").select("rep", F.col("comp").alias("old"), F.least("comp", "near").alias("mid"))
        jump = labels.select(F.col("rep").alias("mid"), F.col("comp").alias("far"))
        moved = cut(lower.join(jump, "mid", "left").select("rep", "old", F.least("mid", F.coalesce("far", "mid")).alias("comp")), "labels", scratch)
        if moved.where(F.col("comp") != F.col("old")).isEmpty():
            return moved.select("rep", "comp")
        labels = moved.select("rep", "comp")


def across(pairs: DataFrame, comps: DataFrame) -> DataFrame:
    """The pairs between different components, with them."""
    left = comps.select(F.col("rep").alias("a"), F.col("comp").alias("ca"))
    right = comps.select(F.col("rep").alias("b"), F.col("comp").alias("cb"))
    out = pairs.join(left, "a", "left").join(right, "b", "left")
    out = out.withColumn("ca", F.coalesce("ca", "a")).withColumn("cb", F.coalesce("cb", "b"))
    return out.where(F.col("ca") != F.col("cb"))


# --- long lists ----------------------------------------------------------------


#: Blocks of a size band are numbered from ``band * BAND_BLOCKS``.
BAND_BLOCKS = 1 << 40


def size_band(n: str, similarity: int) -> F.Column:
    """Sets of linked classes are in the same or in neighbouring bands of size: a
    band's sizes grow by slightly more than the factor that a link allows at most."""
    return F.floor(F.log(F.col(n).cast("double")) / (math.log(100 / min(similarity, 99)) * (1 + 1e-9))).cast("bigint")


def block_pairs(members: DataFrame, lengths: DataFrame, block: int, elements: int) -> DataFrame:
    """``key, i, j, part`` rows: each member of a long list once for each block it
    is compared with.  Blocks are hash parts of a size band of the list, of about
    ``block`` rows or ``elements`` set elements, whichever is less."""
    parts = F.ceil(F.greatest(F.col("len") / block, F.col("size") / elements)).cast("bigint")
    # One entry for each band of a list; bands grow geometrically, so there are few.
    bands = lengths.groupBy("key").agg(F.map_from_entries(F.collect_list(F.struct("band", parts.alias("parts")))).alias("bands"))
    own = members.join(F.broadcast(bands) if lengths.count() <= BROADCAST_IDS else bands, "key").withColumn("part", F.col("band") * BAND_BLOCKS + F.pmod(F.xxhash64("rep"), F.expr("bands[band]")))
    blocks = "transform(sequence(0L, coalesce(bands[band + {0}], 0L)), x -> if(x < bands[band + {0}], (band + {0}) * {1}L + x, null))"
    others = F.array_compact(F.concat(*[F.expr(blocks.format(d, BAND_BLOCKS)) for d in (-1, 0, 1)]))
    others = own.withColumn("other", F.explode(others)).drop("bands")
    return others.withColumn("i", F.least("part", "other")).withColumn("j", F.greatest("part", "other"))


class Forest:
    """Union-find over the nodes of two blocks."""

    def __init__(self):
        self.up: dict = {}

    def find(self, x):
        while (y := self.up.get(x, x)) != x:
            self.up[x] = self.up.get(y, y)
            x = y
        return x

    def join(self, x, y) -> bool:
        x, y = self.find(x), self.find(y)
        if x != y:
            self.up[max(x, y)] = min(x, y)
        return x != y


def _incidence(lists: list[np.ndarray], universe: np.ndarray) -> np.ndarray:
    out = np.zeros((len(lists), len(universe)), np.float32)
    for i, x in enumerate(lists):
        at = np.searchsorted(universe, x)
        at = np.minimum(at, len(universe) - 1)
        out[i, at[universe[at] == x]] = 1
    return out


def _common(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections between two lists of sorted arrays, over slices
    of the values that stand on both sides."""
    out = np.zeros((len(a), len(b)), np.float32)
    if not a or not b:
        return out
    both = np.intersect1d(np.concatenate(a), np.concatenate(b))
    for at in range(0, len(both), 8192):
        part = both[at : at + 8192]
        out += _incidence(a, part) @ _incidence(b, part).T
    return out


def compare_blocks(key: int, a: dict, b: dict, same: bool, similarity: int, estimate: int) -> list[tuple[int, int]]:
    """A spanning forest of the links between two blocks (or inside one).

    A block holds ``rep, n, comp, keys, sketch, set`` lists, of which ``keys`` are
    the long lists' only: short lists drop pairs by their overlap there, which is
    no reason to pass over a pair here.  A pair is compared in the long list of the
    smallest value under which both are posted, nowhere else."""
    keys = [[k[k < key] for k in x["keys"]] for x in (a, b)]
    skip = _common(*keys) > 0
    n, m = np.array(a["n"], np.float64)[:, None], np.array(b["n"], np.float64)[None, :]
    possible = ~skip & (100 * np.minimum(n, m) >= similarity * np.maximum(n, m))
    possible &= np.array(a["comp"])[:, None] != np.array(b["comp"])[None, :]
    if same:
        possible &= np.triu(np.ones_like(possible), 1)
    if not possible.any():
        return []
    top = np.iinfo(np.int64).max
    last = [np.array([s[-1] if len(s) == SKETCH else top for s in x["sketch"]]) for x in (a, b)]
    upto = np.minimum(last[0][:, None], last[1][None, :])
    held = np.stack([np.searchsorted(s, u, "right") for s, u in zip(a["sketch"], upto, strict=True)])
    held = held + np.stack([np.searchsorted(s, u, "right") for s, u in zip(b["sketch"], upto.T, strict=True)]).T
    common = _common(a["sketch"], b["sketch"])
    share = common / np.maximum(held - common, 1)
    possible &= 100 * share >= estimate
    rows, columns = np.nonzero(possible)
    if len(rows) > MANY_PAIRS:
        full = _common(a["set"], b["set"])[rows, columns]
        enough = linked(full, n[rows, 0], m[0, columns], similarity)
        rows, columns = rows[enough], columns[enough]
    forest, links = Forest(), []
    for i in np.argsort(-share[rows, columns], kind="stable"):
        x, y = rows[i], columns[i]
        ca, cb = a["comp"][x], b["comp"][y]
        if forest.find(ca) == forest.find(cb):
            continue
        s, t = a["set"][x], b["set"][y]
        if linked(len(np.intersect1d(s, t, assume_unique=True)), len(s), len(t), similarity):
            forest.join(ca, cb)
            links.append((int(a["rep"][x]), int(b["rep"][y])))
    return links


def long_links(members: DataFrame, classes: DataFrame, sets: DataFrame, comps: DataFrame, similarity: int, estimate: int, scratch: list[str]) -> DataFrame:
    """Verified links, a forest for each pair of blocks, that long lists add to
    the components known."""
    at = members.join(comps, "rep", "left").select(
        "key", "rep", F.col("n").alias("size"), F.coalesce("comp", "rep").alias("comp"), size_band("n", similarity).alias("band"))
    banded = at.groupBy("key", "band").agg(
        F.count("*").alias("len"), F.sum("size").alias("size"), F.min("comp").alias("lo"), F.max("comp").alias("hi"))
    mixed_up = banded.groupBy("key").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).where(F.col("lo") != F.col("hi"))
    lengths = cut(banded.join(mixed_up.select("key"), "key", "left_semi").select("key", "band", "len", "size"), "long-lists", scratch)
    at = at.drop("size")
    keyed = members.groupBy("rep").agg(F.first("n").alias("n"), F.sort_array(F.collect_set("key")).alias("keys"))  # as many as a class posts at most
    # What a comparison needs is joined before members are dealt to block pairs.
    whole = at.join(if_small(cut(lengths.select("key").distinct(), "long-keys", scratch)), "key", "left_semi").join(keyed, "rep").join(classes.select("rep", "sketch"), "rep").join(sets, "rep")
    dealt = block_pairs(whole, lengths, BLOCK, BLOCK_ELEMENTS)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        key, i, j = (int(pdf[c].iloc[0]) for c in ("key", "i", "j"))
        sides = []
        for part in (i, j):
            own = pdf[pdf["part"] == part].drop_duplicates("rep").sort_values("rep")
            sides.append({c: own[c].tolist() for c in ("rep", "n", "comp", "keys", "sketch", "set")})
        links = compare_blocks(key, *sides, i == j, similarity, estimate)
        del sides
        give_back()
        return pd.DataFrame(links, columns=["a", "b"], dtype="int64")

    columns = ["key", "i", "j", "part", "rep", "n", "comp", "keys", "sketch", "set"]
    return dealt.select(*columns).groupBy("key", "i", "j").applyInPandas(run, "a bigint, b bigint")


# --- the operator --------------------------------------------------------------


def near_duplicates(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", words: int = WORDS,
                    similarity: int = SIMILARITY, log=lambda *_: None, read: list[str] | None = None) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` of every row.  ``read``: gets the
    paths of the tables that the result reads."""
    spark = docs.sparkSession
    python_ready(spark)
    scratch: list[str] = []  # what only this function reads
    sketched = cut(sketches(docs, id_column, text_column, words), "sketches", read)
    by_class = ["h1", "h2", "n"]
    classes = cut(
        sketched.where((F.col("n") > 0) & F.col("doc_id").isNotNull()).groupBy(*by_class)
        .agg(F.min("doc_id").alias("rep"), F.any_value("sketch").alias("sketch")), "classes", read)

    keyed = cut(posted(classes, frequent_values(classes)), "postings", scratch)
    postings = keyed.select("rep", "n", F.explode("keys").alias("key"))
    lengths = postings.groupBy("key").agg(F.count("*").alias("len")).where(F.col("len") > 1)
    # Long lists, few and each with many members, are told apart first, so that no
    # task gets all members of one.
    often = if_small(cut(lengths.where(F.col("len") > LIST), "long-lengths", scratch))
    long = cut(postings.join(often, "key").select("key", "rep", "n"), "long", scratch)
    rare = postings.join(often.select("key"), "key", "left_anti")
    short = cut(rare.join(lengths.where(F.col("len") <= LIST), "key"), "short", scratch)
    left, right = short.select("key", F.col("rep").alias("a"), F.col("n").alias("na")), short.select("key", F.col("rep").alias("b"), F.col("n").alias("nb"))
    near_size = (100 * F.least("na", "nb") >= similarity * F.greatest("na", "nb"))
    pairs = (
        left.join(right, "key").where((F.col("a") < F.col("b")) & near_size)
        .groupBy("a", "b").agg(F.count("*").alias("overlap"), F.min(F.least("na", "nb")).alias("least"))
    )
    # A linked pair of sets this large that meets in short lists only does so in OVERLAP of them.
    longest = next(n for n in range(4, 10_000) if prefix(n, similarity) > POSTED)
    pairs = cut(pairs.where((F.col("least") < longest) | (F.col("overlap") >= OVERLAP)).select("a", "b", "overlap"), "pairs", scratch)
    banded = long.withColumn("band", size_band("n", similarity))
    hubs = cut(banded.groupBy("key", "band").agg(F.min("rep").alias("a"), F.min_by("n", "rep").alias("na")), "hubs", scratch)
    stars = banded.join(if_small(hubs), ["key", "band"]).where((F.col("a") < F.col("rep")) & (100 * F.least("na", "n") >= similarity * F.greatest("na", "n")))
    stars = stars.groupBy(F.col("rep").alias("b")).agg(F.min("a").alias("a")).select("a", "b", F.lit(0).cast("bigint").alias("overlap"))

    nodes = pairs.select(F.explode(F.array("a", "b")).alias("rep")).union(long.select("rep")).distinct()
    sets = cut(full_sets(docs, cut(nodes, "nodes", scratch), id_column, text_column, words), "sets", scratch)

    none = spark.createDataFrame([], "rep bigint, comp bigint")
    best = pairs.groupBy("b").agg(F.max_by("a", "overlap").alias("a")).select("a", "b").union(stars.select("a", "b")).distinct()
    links = cut(verified(best, sets, similarity), "links", scratch)
    comps = components(links, scratch)
    log("pairs", pairs, "long", long, "sets", sets, "first links", links)
    rest = cut(estimated(across(pairs, comps), classes, ESTIMATE), "rest", scratch)
    more = cut(verified(rest, sets, similarity), "links", scratch)
    log("rest", rest, "links", more)
    if not more.isEmpty():
        links = links.union(more)
        comps = components(links, scratch)
    more = cut(long_links(long, classes, sets, comps, similarity, ESTIMATE, scratch), "links", scratch)
    log("long links", more)
    if not more.isEmpty():
        comps = components(links.union(more), scratch)
    comps = cut(comps.unionByName(none), "components", read)
    discard(spark, scratch)

    of_class = classes.select(*by_class, "rep").join(comps, "rep", "left").select(*by_class, F.coalesce("comp", "rep").alias("component"))
    out = sketched.select("doc_id", *by_class).join(of_class, by_class, "left")
    own = F.when(F.col("doc_id").isNull(), None).otherwise(F.coalesce("component", "doc_id"))
    return out.select(
        "doc_id", F.col("n").alias("n_shingles"), own.alias("component_id"),
        F.coalesce(F.col("doc_id") == own, F.lit(True)).alias("kept"))


def one_of_each(docs: DataFrame, id_column: str = "doc_id", **options) -> DataFrame:
    """The documents that represent their components, with their columns; rows
    that repeat an identifier are one document."""
    read: list[str] = []
    found = cut(near_duplicates(docs, id_column=id_column, read=read, **options), "near-duplicates")
    discard(docs.sparkSession, read)
    named = found.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.count("*").alias("rows"), F.bool_and("kept").alias("kept"))
    named = cut(named.where((F.col("rows") > 1) | ~F.col("kept")), "copies").withColumnRenamed("doc_id", id_column)
    kept = bounded_join(docs, named.where(~F.col("kept")).select(id_column), "left_anti")
    again = named.where("kept").select(id_column)
    if again.isEmpty():
        return kept
    single = bounded_join(kept, again, "left_anti")
    return single.unionByName(bounded_join(kept, again, "left_semi").dropDuplicates([id_column]))


def op10_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of near-duplicate documents."""
    return near_duplicates(table(spark, sf_dir, "documents"))


#: All pairs that share a shingle, then reachability; for small tables.
ORACLE_OP10 = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i : i + 3], ' ') AS g
  FROM (SELECT doc_id, w, unnest(generate_series(1, greatest(len(w) - 3, 1))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(node, comp) AS (SELECT doc_id, doc_id FROM documents UNION SELECT e.b, r.comp FROM r JOIN e ON e.a = r.node),
m AS (SELECT node, min(comp) AS comp FROM r GROUP BY 1)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, m.comp AS component_id, d.doc_id = m.comp AS kept
FROM d JOIN m ON m.node = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id
"""

QUERIES = {"op10_near_duplicates": op10_near_duplicates}
ORACLE = {"op10_near_duplicates": ORACLE_OP10}
