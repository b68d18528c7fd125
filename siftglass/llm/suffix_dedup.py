"""Suffix-array dedup: bytes covered by a long string that starts elsewhere too.

Two equal strings of ``LENGTH`` bytes have the same anchor: the place of the smallest hash of 16 bytes among
all that lie in the string.  So only the suffixes at anchors are sorted, forwards and (the text before the
anchor) backwards, by deep-shallow sorting: a sparse suffix array with about one suffix in two hundred.

1. Anchors are counted by their 16 bytes' hash over all batches; what occurs once can't repeat.
2. For the others, each batch sends the distinct surroundings of its anchors once.
3. In each range of hashes, the surroundings are sorted both ways and common prefixes of neighbours taken.
   A string that starts d bytes before its anchor repeats exactly if another surrounding shares d bytes
   before and LENGTH - d bytes after the anchor: both sort orders cut into classes at these depths, and a
   pair of classes with two members is a repeat.  This takes no pairs of members and compares bytes, not
   hashes, throughout.
4. Each batch marks the bytes of its repeated strings.

A hash with very many distinct surroundings (a passage that a third of all documents embed, each in a text of
its own) would be one task's work in step 3.  Its strings are therefore parted by their distance to the anchor into
as many ranges as the number of surroundings asks for.  Within a range, equal strings share the bytes just before and
behind the anchor, which name the group that is sorted, and surroundings are cut to what the range needs, so that
inside the passage they are all alike and go once for each batch.  Every group is sorted the same way.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftglass.llm.common import id_field, written
from siftglass.llm.deep_shallow import deep_shallow_sort, neighbour_prefixes
from siftglass.llm.packed import pack, squeeze, unsqueeze
from siftglass.llm.substring_dedup import mixed

LENGTH = 400
GRAM = 16
#: Bytes of text whose anchors are looked for at once.
CHUNK = 1 << 20
#: Surroundings that one task sorts, on average.
RANGE_MEMBERS = 15_000
#: Distinct surroundings of one hash that one group should have: a hash with more is cut into more groups.
MOST_MEMBERS = 50_000
_BASE = 0x9E3779B97F4A7C15


def _gram_hashes(text: np.ndarray) -> np.ndarray:
    """The hash of the 16 bytes from each place on (as far as there are 16)."""
    block, width, power = text.astype(np.uint64) + np.uint64(1), 1, np.uint64(_BASE)
    with np.errstate(over="ignore"):
        while width < GRAM:
            block = block[:-width] * power + block[width:] if len(block) > width else block[:0]
            power = power * power
            width *= 2
    return mixed(block)


def _sliding_least(x: np.ndarray, width: int) -> np.ndarray:
    """The least of ``width`` values from each place on."""
    done, block = 1, x
    while done * 2 <= width:
        block = np.minimum(block[:-done], block[done:])
        done *= 2
    rest = width - done
    return np.minimum(block[: len(block) - rest], block[rest:]) if rest else block


def anchors(text: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of one text: anchors, their hashes, and the first and last place whose string has that anchor.

    The anchor is the leftmost of the smallest hashes.  Places are looked at in chunks; an anchor whose
    places reach over a cut stands twice, with the places on either side.
    """
    n = len(text) - length + 1
    found: list[tuple[np.ndarray, ...]] = []
    width = length - GRAM + 1
    for at in range(0, max(0, n), CHUNK):
        stop = min(n, at + CHUNK)
        h = _gram_hashes(text[at : stop + length - 1])
        first, where = _leftmost(h, _sliding_least(h, width), width)
        last = np.append(first[1:], stop - at) - 1
        found.append((where + at, h[where], first + at, last + at))
    if not found:
        none = np.zeros(0, np.int64)
        return none, np.zeros(0, np.uint64), none, none
    return tuple(np.concatenate([f[k] for f in found]) for k in range(4))  # type: ignore[return-value]


def _leftmost(h: np.ndarray, least: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Runs of windows whose least value has the same leftmost place: first window of each run, and that place.

    A place is the least of some window exactly if it equals the largest of their least values.  Where it
    changes, either the least value does or a window has just left such a place; only there is it looked up,
    as the next place with that value.
    """
    edge = np.zeros(width - 1, least.dtype)
    most = ~_sliding_least(~np.concatenate([edge, least, edge]), width)
    places = np.flatnonzero(h == most)
    changes = np.flatnonzero(least[1:] != least[:-1]) + 1
    first = np.unique(np.concatenate([[0], changes, places[places < len(least) - 1] + 1]))
    values, rank = np.unique(h[places], return_inverse=True)
    span = np.int64(len(h) + 1)
    keys = np.sort(rank.astype(np.int64) * span + places)
    wanted = np.searchsorted(values, least[first]).astype(np.int64) * span + first
    where = keys[np.searchsorted(keys, wanted)] % span
    new = np.ones(len(first), bool)
    new[1:] = where[1:] != where[:-1]
    return first[new], where[new]


class Surroundings:
    """The anchors of one packed batch."""

    def __init__(self, row: dict, length: int) -> None:
        self.text = unsqueeze(row["texts"])
        self.stops = np.frombuffer(unsqueeze(row["ends"]), np.int64)
        self.length = length
        octets = np.frombuffer(self.text, np.uint8)
        parts: list[tuple[np.ndarray, ...]] = []
        start = 0
        for stop in self.stops.tolist():
            if stop - start >= length:
                a, h, first, last = anchors(octets[start:stop], length)
                parts.append((a + start, h, first + start, last + start))
            start = stop
        empty = np.zeros(0, np.int64)
        none = (empty, np.zeros(0, np.uint64), empty, empty)
        self.anchor, self.hash, self.first, self.last = (
            tuple(np.concatenate([p[k] for p in parts]) for k in range(4)) if parts else none
        )

    def members(self, parts: dict[int, int]) -> dict[tuple[int, int, bytes, bytes], list[int]]:
        """The distinct surroundings of the anchors whose hash is in ``parts``, and which anchors have them.

        Each is (group, nearest, text before, text from the anchor on).  Strings are told by their distance d
        before the anchor; the distances are cut into as many ranges as ``parts`` says, and a surrounding reaches
        only as far as its range needs.  What all strings of a range must share, the bytes just before and
        behind the anchor, chooses the group: strings that are equal always meet in one.
        """
        out: dict[tuple[int, int, bytes, bytes], list[int]] = {}
        text, length = self.text, self.length
        chosen = np.flatnonzero(np.isin(self.hash, np.array(list(parts), np.uint64)))
        columns = zip(chosen.tolist(), self.hash[chosen].tolist(), self.anchor[chosen].tolist(), self.first[chosen].tolist(), self.last[chosen].tolist(), strict=True)
        for k, h, a, first, last in columns:
            wide = -(-(length - GRAM + 1) // parts[h])
            nearest, farthest = a - last, a - first
            for low in range(nearest // wide * wide, farthest + 1, wide):
                high = min(low + wide - 1, length - GRAM)
                near, far = max(nearest, low), min(farthest, high)
                group = h if parts[h] == 1 else xxhash.xxh3_64_intdigest(text[a - low : a - high + length], h)
                out.setdefault((group, near, text[a - far : a], text[a : a - near + length]), []).append(k)
        return out


def _repeats(hashes: np.ndarray, before: list[bytes], after: list[bytes], nearest: np.ndarray, count: np.ndarray, length: int) -> list[list[tuple[int, int]]]:
    """For each surrounding, the runs (d, d') of repeated strings by their distance before the anchor."""
    n = len(before)
    group = np.unique(hashes, return_inverse=True)[1].astype(np.int64)
    backwards = [b[::-1] for b in before]
    orders = []
    for strings in (backwards, after):
        order = deep_shallow_sort(strings, group)
        orders.append((order, neighbour_prefixes(strings, group, order)))
    (left, left_lcp), (right, right_lcp) = orders
    far = np.array([len(b) for b in before], np.int64)
    runs: list[list[tuple[int, int]]] = [[] for _ in range(n)]
    open_at = np.full(n, -1, np.int64)
    left_class, right_class = np.empty(n, np.int64), np.empty(n, np.int64)
    for d in range(length - GRAM + 2):
        inside = (nearest <= d) & (d <= far) if d <= length - GRAM else np.zeros(n, bool)
        hit = np.zeros(n, bool)
        if inside.any():
            left_class[left] = np.cumsum(left_lcp < d)
            right_class[right] = np.cumsum(right_lcp < length - d)
            some = np.flatnonzero(inside)
            key = left_class[some] * (n + 1) + right_class[some]
            _, at, times = np.unique(key, return_inverse=True, return_counts=True)
            hit[some] = (times[at] > 1) | (count[some] > 1)
        begins = hit & (open_at < 0)
        ends = ~hit & (open_at >= 0)
        for k in np.flatnonzero(ends).tolist():
            runs[k].append((int(open_at[k]), d - 1))
        open_at[ends] = -1
        open_at[begins] = d
    return runs


def suffix_dedup(
    documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, range_members: int = RANGE_MEMBERS, most_members: int = MOST_MEMBERS, digest: bool = False
) -> DataFrame:
    """One row per document: ``id_col, n_bytes, n_removed, removed, kept``.

    ``removed`` are the maximal intervals of removed bytes as (first, last + 1); ``kept`` is the rest, as
    bytes (a cut may fall inside a character), or with ``digest`` the hex SHA-256 of these bytes.

    A byte goes if a string of ``length`` bytes that covers it also starts anywhere else, in the same
    document or another.  Null and empty texts have no bytes; a text shorter than ``length`` loses nothing.  A
    repeated row is a copy of its text, so both lose all repeated strings; null ids stay.  An empty table
    gives an empty result.
    """
    packed = pack(documents, id_col, text_col)
    texts = packed.select("batch", "ids", "ends", "texts")
    hash_schema = T.StructType([T.StructField(n, T.LongType()) for n in ("batch", "hash", "n", "members")])

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            for row in rows.to_pylist():
                s = Surroundings(row, length)
                owners = [which[0] for which in s.members(dict.fromkeys(s.hash.tolist(), 1)).values()]
                values, n = np.unique(s.hash.view(np.int64), return_counts=True)
                distinct = np.bincount(np.searchsorted(values, s.hash[owners].view(np.int64)), minlength=len(values))
                columns = [np.full(len(values), row["batch"]), values, n.astype(np.int64), distinct.astype(np.int64)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=hash_schema.names)

    seen = texts.mapInArrow(hashes, hash_schema)
    repeated = seen.groupBy("hash").agg(F.sum("n").alias("total"), F.sum("members").alias("all")).where(F.col("total") > 1)
    parts = F.least(F.ceil(F.col("all") / most_members), F.lit(length - GRAM + 1)).cast("long")
    wanted = written(seen.join(repeated, "hash").select("batch", "hash", parts.alias("parts")), "anchors")
    size = packed.agg(F.sum("size")).first()
    #: One place in about (length - GRAM) / 2 is an anchor.
    ranges = max(1, int((size[0] or 0) * 2 // (length - GRAM) // range_members)) if size else 1
    member_schema = T.StructType(
        [T.StructField("range", T.LongType()), T.StructField("batch", T.LongType()), T.StructField("members", T.BinaryType())]
    )

    def send(texts: pa.Table, wanted: pa.Table) -> pa.Table:
        parts = dict(zip(wanted.column("hash").to_numpy().view(np.uint64).tolist(), wanted.column("parts").to_pylist(), strict=True))
        out: dict[int, list[tuple[int, int, int, int, bytes, bytes]]] = {}
        batch = 0
        for row in texts.to_pylist():
            batch = row["batch"]
            s = Surroundings(row, length)
            for number, ((group, near, before, after), which) in enumerate(s.members(parts).items()):
                out.setdefault(group % ranges, []).append((number, group, near, len(which), before, after))
        rows = [(r, batch, _bundle(m)) for r, m in out.items()]
        return pa.table([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.binary())], names=member_schema.names)

    members = texts.groupBy("batch").cogroup(wanted.groupBy("batch")).applyInArrow(send, member_schema)
    answer_schema = T.StructType([T.StructField("batch", T.LongType()), T.StructField("runs", T.BinaryType())])

    def sort(table: pa.Table) -> pa.Table:
        rows = table.select(["batch", "members"]).to_pylist()
        owner, numbers, hashed, nearest, count, before, after = [], [], [], [], [], [], []
        for k, row in enumerate(rows):
            fixed, b, a = _unbundle(row["members"])
            owner.append(np.full(len(fixed), k))
            numbers.append(fixed[:, 0])
            hashed.append(fixed[:, 1])
            nearest.append(fixed[:, 2])
            count.append(fixed[:, 3])
            before += b
            after += a
        own, number = np.concatenate(owner), np.concatenate(numbers)
        runs = _repeats(np.concatenate(hashed), before, after, np.concatenate(nearest), np.concatenate(count), length)
        made: list[list[tuple[int, int, int]]] = [[] for _ in rows]
        for k, some in enumerate(runs):
            for d, e in some:
                made[int(own[k])].append((int(number[k]), d, e))
        kept = [(row["batch"], squeeze(np.array(m, np.int32))) for row, m in zip(rows, made, strict=True) if m]
        return pa.table([pa.array([k[0] for k in kept], pa.int64()), pa.array([k[1] for k in kept], pa.binary())], names=answer_schema.names)

    answers = members.groupBy("range").applyInArrow(sort, answer_schema)
    replies = wanted.groupBy("batch").agg(F.collect_list(F.struct("hash", "parts")).alias("wanted")).join(
        answers.groupBy("batch").agg(F.collect_list("runs").alias("runs")), "batch"
    )
    made_schema = T.StructType(
        [
            T.StructField("id", id_field(documents, id_col)),
            T.StructField("n_bytes", T.LongType()),
            T.StructField("n_removed", T.LongType()),
            T.StructField("removed", T.ArrayType(T.ArrayType(T.LongType()))),
            T.StructField("kept", T.StringType() if digest else T.BinaryType()),
        ]
    )

    def cut(texts: pa.Table, replies: pa.Table) -> pa.Table:
        out: list[list[object]] = [[], [], [], [], []]
        said = replies.select(["wanted", "runs"]).to_pylist()
        kind = texts.schema.field("ids").type.value_type
        for row in texts.to_pylist():
            text, stops = unsqueeze(row["texts"]), np.frombuffer(unsqueeze(row["ends"]), np.int64)
            edges = np.zeros(len(text) + 1, np.int32)
            if said:
                s = Surroundings(row, length)
                which = list(s.members({w["hash"] & (1 << 64) - 1: w["parts"] for w in said[0]["wanted"]}).values())
                for runs in said[0]["runs"]:
                    for number, d, e in np.frombuffer(unsqueeze(runs), np.int32).reshape(-1, 3).tolist():
                        a = s.anchor[which[number]]
                        np.add.at(edges, a - e, 1)
                        np.subtract.at(edges, a - d + length, 1)
            gone = np.cumsum(edges)[:-1] > 0
            start = 0
            for i, stop in zip(row["ids"], stops.tolist(), strict=True):
                lost = gone[start:stop]
                out[0].append(i)
                out[1].append(stop - start)
                if lost.any():
                    spans = np.flatnonzero(np.diff(np.concatenate([[0], lost.astype(np.int8), [0]]))).reshape(-1, 2)
                    rest = np.frombuffer(text, np.uint8)[start:stop][~lost].tobytes()
                    out[2].append(int(lost.sum()))
                    out[3].append(spans.tolist())
                else:
                    rest = text[start:stop]
                    out[2].append(0)
                    out[3].append([])
                out[4].append(hashlib.sha256(rest).hexdigest() if digest else rest)
                start = stop
        kinds = (kind, pa.int64(), pa.int64(), pa.list_(pa.list_(pa.int64())), pa.string() if digest else pa.binary())
        return pa.table([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names=made_schema.names)

    done = texts.groupBy("batch").cogroup(replies.groupBy("batch")).applyInArrow(cut, made_schema)
    return done.withColumnRenamed("id", id_col)


def _bundle(members: list[tuple[int, int, int, int, bytes, bytes]]) -> bytes:
    """Surroundings as bytes: four numbers each, two lengths each, the strings."""
    fixed = np.array([(m[0], m[1] - (1 << 64) if m[1] >> 63 else m[1], m[2], m[3]) for m in members], np.int64)
    lengths = np.array([(len(m[4]), len(m[5])) for m in members], np.int32)
    body = b"".join([x for m in members for x in m[4:]])
    return squeeze(len(members).to_bytes(8, "little") + fixed.tobytes() + lengths.tobytes() + body)


def _unbundle(data: bytes) -> tuple[np.ndarray, list[bytes], list[bytes]]:
    raw = unsqueeze(data)
    n = int.from_bytes(raw[:8], "little")
    fixed = np.frombuffer(raw, np.int64, 4 * n, 8).reshape(n, 4)
    lengths = np.frombuffer(raw, np.int32, 2 * n, 8 + 32 * n).reshape(n, 2)
    before, after = [], []
    at = 8 + 40 * n
    for b, a in lengths.tolist():
        before.append(raw[at : at + b])
        after.append(raw[at + b : at + b + a])
        at += b + a
    return fixed, before, after
