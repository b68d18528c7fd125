"""SimHash near-duplicates by a byte-position inverted index with count filtering.

Two 64-bit fingerprints that differ in at most two bits share at least six of their eight positional
bytes.  The index therefore posts every distinct fingerprint under each choice of six positions with
the bytes found there: two fingerprints meet in a posting list exactly if their tally of shared
positional bytes reaches that guaranteed minimum.  Members of a list differ in two bytes at most, so a
list never has more than 65,536 members however many documents are alike.  Lists of every length go one
way: each member is looked up with one or two bits turned, tallies of shared bytes are counted and distances
verified; a list reports a spanning forest of its links, never all pairs.
Links between fingerprints are then joined to components by star contraction.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftglass.llm.common import arrow_map, id_and_text, id_field, written

SHINGLE = 3
SEED = 42
MAX_BITS = 2
#: Shared positional bytes that MAX_BITS differing bits guarantee.
LEAST_SHARED = 8 - MAX_BITS
#: Shingles whose bits are summed at once.
CHUNK = 1 << 16


def fingerprint(text: bytes | None, size: int = SHINGLE) -> int:
    """The SimHash of a text; zero for a text without words."""
    words = text.lower().split() if text else []
    if not words:
        return 0
    plain = b" ".join(words)
    if len(words) <= size:
        return xxhash.xxh64_intdigest(plain, SEED)
    blanks = np.flatnonzero(np.frombuffer(plain, np.uint8) == 0x20)
    starts = [0, *(blanks[: len(words) - size] + 1).tolist()]
    ends = [*blanks[size - 1 :].tolist(), len(plain)]
    digest, seed = xxhash.xxh64_intdigest, SEED
    ones = np.zeros(64, np.int64)
    n = len(starts)
    for at in range(0, n, CHUNK):
        part = [digest(plain[a:b], seed) for a, b in zip(starts[at : at + CHUNK], ends[at : at + CHUNK], strict=True)]
        octets = np.array(part, np.uint64).view(np.uint8).reshape(-1, 8)
        ones += _bit_counts(octets)
    set_bits = np.flatnonzero(2 * ones > n)
    return int(sum(1 << int(b) for b in set_bits))


def _bit_counts(octets: np.ndarray) -> np.ndarray:
    """How often each of 64 bits is set in rows of eight bytes, lowest first."""
    bits = np.unpackbits(octets, axis=1, bitorder="little")
    total = np.zeros(64, np.int64)
    for at in range(0, len(bits), 255):  # sums of at most 255 ones fit into a byte
        total += np.add.reduce(bits[at : at + 255], axis=0, dtype=np.uint8)
    return total


def fingerprints(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE) -> DataFrame:
    """``id_col, fp``: the signed 64-bit fingerprint of every document."""
    schema = T.StructType([T.StructField("id", id_field(documents, id_col)), T.StructField("fp", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(t, size) for t in batch.column(1).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.int64())], names=["id", "fp"])

    return arrow_map(id_and_text(documents, id_col, text_col, binary=True), run, schema).withColumnRenamed("id", id_col)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def postings(distinct: DataFrame, least: int = LEAST_SHARED) -> DataFrame:
    """``positions, octets, fp``: each fingerprint under every choice of ``least`` byte positions."""
    keys: list[Column] = []
    for chosen in combinations(range(8), least):
        mask = sum(0xFF << (8 * p) for p in chosen)
        keys.append(F.col("fp").bitwiseAND(F.lit(_signed(mask)).cast("long")))
    return distinct.select("fp", F.posexplode(F.array(*keys)).alias("positions", "octets"))


def _list_links(lists: np.ndarray, fps: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of the links within posting lists: tally of shared bytes reached, then distance verified.

    ``lists`` holds each fingerprint's list, both arrays being sorted by (list, fingerprint).  Candidates are found by
    looking up every fingerprint with one or two bits turned; members of a list differ in the bits of two bytes at most.
    """
    n = len(fps)
    octets = fps.view(np.uint8).reshape(n, 8)
    first = np.flatnonzero(np.concatenate([[True], lists[1:] != lists[:-1]]))
    differing = np.bitwise_or.reduceat(fps ^ fps[np.repeat(first, np.diff(np.append(first, n)))], first)
    rank = np.unique(fps, return_inverse=True)[1].astype(np.int64)
    values = np.unique(fps)
    number = np.repeat(np.arange(len(first)), np.diff(np.append(first, n)))
    keys = number * np.int64(len(values)) + rank
    free = differing[number]
    ones = [np.uint64(1 << b) for b in range(64) if np.bitwise_or.reduce(differing) >> np.uint64(b) & np.uint64(1)]
    for mask in [*ones, *[a | b for a, b in combinations(ones, 2)]]:
        asked = np.flatnonzero((free & mask) == mask)
        other = fps[asked] ^ mask
        asked, other = asked[fps[asked] < other], other[fps[asked] < other]
        place = np.minimum(np.searchsorted(values, other), len(values) - 1)
        asked, place = asked[values[place] == other], place[values[place] == other]
        wanted = number[asked] * np.int64(len(values)) + place
        at = np.minimum(np.searchsorted(keys, wanted), n - 1)
        left, right = asked[keys[at] == wanted], at[keys[at] == wanted]
        tally = (octets[left] == octets[right]).sum(axis=1)
        near = np.bitwise_count(fps[left] ^ fps[right]) <= MAX_BITS
        yield left[(tally >= LEAST_SHARED) & near], right[(tally >= LEAST_SHARED) & near]


def forest(lists: np.ndarray, fps: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest of the links (at most MAX_BITS differing bits) within each posting list, whatever its length."""
    if not len(fps):
        return []
    order = np.lexsort((fps, lists))
    lists, fps = lists[order], fps[order]
    new = np.ones(len(fps), bool)
    new[1:] = (lists[1:] != lists[:-1]) | (fps[1:] != fps[:-1])
    lists, fps = lists[new], fps[new]
    label = np.arange(len(fps))
    values = fps.view(np.int64)
    kept: list[tuple[int, int]] = []
    for left, right in _list_links(lists, fps):
        apart = label[left] != label[right]
        if not apart.any():
            continue
        parent = label.tolist()

        def root(x: int, parent: list[int] = parent) -> int:
            while parent[x] != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        for a, b in zip(left[apart].tolist(), right[apart].tolist(), strict=True):
            x, y = root(a), root(b)
            if x != y:
                parent[max(x, y)] = min(x, y)
                kept.append((int(values[a]), int(values[b])))
        label = np.array(parent)
        while (label != label[label]).any():
            label = label[label]
    return kept


def links(distinct: DataFrame, least: int = LEAST_SHARED) -> DataFrame:
    """``a, b``: links between distinct fingerprints, enough of them to join every class."""
    lists = (
        postings(distinct, least)
        .groupBy("positions", "octets")
        .agg(F.collect_list("fp").alias("fps"))
        .where(F.size("fps") > 1)
        .select("fps")
    )
    schema = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(0)
            sizes = np.asarray(lists.value_lengths())
            fps = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            pairs = sorted({(min(x), max(x)) for x in forest(np.repeat(np.arange(len(sizes)), sizes), fps)})
            yield pa.RecordBatch.from_arrays(
                [pa.array([p[0] for p in pairs], pa.int64()), pa.array([p[1] for p in pairs], pa.int64())], names=["a", "b"]
            )

    return arrow_map(lists, run, schema).distinct()


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """``node, root``: every node of the edge list ``a, b`` with the smallest node it can reach.

    Large-star and small-star rounds by turns, each written to the shared folder, until nothing moves.
    A hub's edges are joined to one row holding its smallest neighbour, never gathered in one task.
    """
    now = written(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    state = _state(now)
    for _ in range(most_rounds):
        if state[0] == 0:
            break
        both = now.select("a", "b").union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        joined = large.join(low, "a")
        small = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").union(low.select("a", F.col("m").alias("b")))
        now = written(small.distinct(), "edges")
        new = _state(now)
        if new == state:
            break
        state = new
    else:
        raise RuntimeError("components did not settle")
    return now.groupBy("a").agg(F.min("b").alias("root")).withColumnRenamed("a", "node")


def _state(edges: DataFrame) -> tuple[int, int, int]:
    row = edges.agg(
        F.count("*"), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.lit(0)), F.coalesce(F.sum(F.xxhash64("b").cast("decimal(38,0)")), F.lit(0))
    ).first()
    return int(row[0]), int(row[1]), int(row[2])


def simhash_components(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE) -> DataFrame:
    """One row per document: ``id_col, fp, component_id`` (the smallest id reachable over links).

    Null and empty texts have fingerprint zero and link like any other.  Repeated rows stay repeated.  A
    null id stays null and never becomes a component's id unless the component has no other.  An empty
    table gives an empty result.
    """
    marked = written(renamed_id(fingerprints(documents, id_col, text_col, size), id_col), "fingerprints")
    classes = written(marked.groupBy("fp").agg(F.min("id").alias("least")), "classes")
    roots = components(links(classes.select("fp")))
    rooted = classes.join(roots, classes["fp"] == roots["node"], "left").select(
        classes["fp"], "least", F.coalesce("root", classes["fp"]).alias("root")
    )
    named = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    by_fp = rooted.join(named, "root").select("fp", "component_id")
    out = marked.join(by_fp, "fp").select("id", "fp", "component_id")
    return out.withColumnRenamed("id", id_col)


def renamed_id(df: DataFrame, id_col: str) -> DataFrame:
    """The id column under the name ``id``."""
    return df.withColumnRenamed(id_col, "id")


def near_dedup(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE) -> DataFrame:
    """``documents`` with one row of each component left: the one with the smallest id, nulls last.

    Rows are told apart by id and text, so rows that share an id but not their text are documents of their
    own, and of repeated rows one stays.  Null and empty texts are alike (fingerprint zero), so one of them stays.
    Columns may have any names; an empty table stays empty.
    """
    inner = [f"c{i}" for i in range(len(documents.columns))]
    plain = documents.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(documents.columns, inner, strict=True)])
    number, text = (F.col(inner[documents.columns.index(c)]) for c in (id_col, text_col))
    keyed = plain.withColumn("k", F.xxhash64(number, text)).withColumn("l", F.xxhash64(text, F.lit(1), number))
    named = keyed.select(F.struct(number.isNull().alias("none"), number.alias("number"), "k", "l").alias("key"), text.alias("text"))
    found = simhash_components(named, "key", "text", size)
    left = found.where(F.equal_null("key", "component_id")).select(F.col("key.k").alias("k"), F.col("key.l").alias("l"))
    out = keyed.join(left, ["k", "l"], "left_semi").dropDuplicates(["k", "l"])
    return out.select(*[F.col(n).alias(c) for c, n in zip(documents.columns, inner, strict=True)])
