"""Operator 3: near-duplicate documents by an inverted join on MinHash signature coordinates.

1. Each text becomes its set of word shingles (64-bit hashes) and a signature of K minima. Texts with equal sets share one
   representative, so copies never meet each other.
2. A representative is posted under every (coordinate, value) of its signature. Values that no other representative has
   cannot collide and go; who keeps fewer than m coordinates cannot reach m collisions and goes too. m is the largest
   count that a pair at the similarity threshold misses with a chance under `miss`.
3. Prefix: of s remaining coordinates, ordered by rarity, a pair with m collisions must share one of the s - m + 1
   rarest, so only these posting lists are merged. Documents that meet in one have their collisions counted over all
   coordinates, and are a match from m on.
4. Skip: in each list the member whose values are commonest is the hub. Members are first checked against hubs alone, and
   linked ones are contracted. Lists within one component are then skipped; in the others, members outside the hub's
   component meet its members, and each other, in cells of bounded size, which give one link per pair of components.
5. Every match is confirmed on the full sets, and components are contracted by alternating large and small stars.

No list is emitted as pairs, and nothing about documents is collected to the driver.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Room, held, map_batches, pieces, texts

COORDINATES, BLOCK, BROADCAST_IDS, MISS = 64, 512, 2_000_000, 1e-9
#: Bytes that words are hashed of at once; a bound of memory only.
PIECE = (1 << 18) - 1
_POWER, _MASK = 0x9E3779B97F4A7C15 | 1, (1 << 64) - 1


def least_collisions(k: int, percent: int, miss: float = MISS) -> int:
    """The largest m for which a pair at the threshold has fewer than m collisions with a chance under `miss`."""
    p, below, m = percent / 100, 0.0, 0
    while True:
        below += comb(k, m) * p**m * (1 - p) ** (k - m)
        if below > miss:
            return max(1, m)
        m += 1


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


@functools.cache
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit value of each byte (A-Z as a-z; 0 for white space), and which bytes part words."""
    lower = np.arange(256, dtype=np.uint64)
    lower[65:91] += np.uint64(32)
    value = _mix(lower + np.uint64(0x1234567))
    space = np.zeros(256, bool)
    space[[9, 10, 11, 12, 13, 32]] = True
    value[space] = 0
    return value, space


@functools.lru_cache(2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    up = np.full(n, _POWER, np.uint64)
    up[0] = 1
    down = np.full(n, pow(_POWER, -1, 1 << 64), np.uint64)
    down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def word_hashes(data: np.ndarray, tables: tuple[np.ndarray, np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First byte, end and 64-bit hash of each word of a byte array. `tables` has a value of each byte and which bytes part
    words; without it words part at white space and A-Z count as a-z. Long arrays are hashed piece by piece, cut between words."""
    value, part = tables or _tables()
    found, at = [], 0
    while True:
        end = min(at + PIECE, len(data))
        while end < len(data):
            gaps = np.flatnonzero(part[data[at if end == at + PIECE else end - PIECE : end]])
            if len(gaps):
                end = (at if end == at + PIECE else end - PIECE) + int(gaps[-1]) + 1
                break
            end = min(end + PIECE, len(data))
        found.append([x + y for x, y in zip(_hash_piece(data[at:end], value, part), (at, at, np.uint64(0)))])
        at = end
        if at >= len(data):
            return tuple(np.concatenate(x) for x in zip(*found)) if len(found) > 1 else tuple(found[0])


def _hash_piece(data: np.ndarray, value: np.ndarray, part: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    up, down = _powers(1 << max(18, len(data).bit_length()))
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(value[data] * up[: len(data)], dtype=np.uint64)])
    gap = np.concatenate([[True], part[data], [True]])
    starts, ends = np.flatnonzero(gap[:-1] & ~gap[1:]), np.flatnonzero(~gap[:-1] & gap[1:])
    return starts, ends, _mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def shingle_sets(raw: list[bytes], words: int) -> list[np.ndarray]:
    """For each text the sorted distinct 64-bit hashes of its shingles of `words` words; A-Z are lower-cased, words are runs
    of bytes other than space, tab, line feed, vertical tab, form feed and carriage return. Fewer words: the whole
    sequence as one shingle; none: an empty set."""
    out: list[np.ndarray] = [np.zeros(0, np.uint64)] * len(raw)
    starts, _, word = word_hashes(np.frombuffer(b" ".join([*raw, b""]), np.uint8))
    if not len(starts):
        return out
    limits = np.searchsorted(starts, np.concatenate([[0], np.cumsum([len(r) + 1 for r in raw])]))
    seq = np.zeros(max(0, len(word) - words + 1), np.uint64)
    for k in range(words):
        seq = _mix(seq * np.uint64(0x9E3779B97F4A7C15) + word[k : k + len(seq)] + np.uint64(k + 1))
    for d in range(len(raw)):
        a, b = int(limits[d]), int(limits[d + 1])
        if b - a >= words:
            out[d] = np.unique(seq[a : b - words + 1])
        elif b > a:
            h = np.zeros(1, np.uint64)
            for k in range(a, b):
                h = _mix(h * np.uint64(0x9E3779B97F4A7C15) + word[k] + np.uint64(k - a + 1))
            out[d] = h + np.uint64(b - a)
    return out


@functools.cache
def _seeds(k: int) -> tuple[np.ndarray, np.ndarray]:
    x = _mix(np.arange(1, 2 * k + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return x[:k], x[k:] | np.uint64(1)


def signatures(sets: list[np.ndarray], k: int) -> np.ndarray:
    """(texts, k) unsigned 32-bit minima; all ones for an empty set."""
    out = np.full((len(sets), k), 0xFFFFFFFF, np.uint32)
    full = [i for i, s in enumerate(sets) if len(s)]
    if full:
        flat = np.concatenate([sets[i] for i in full])
        at = np.cumsum([0, *[len(sets[i]) for i in full[:-1]]])
        xor, odd = _seeds(k)
        v = np.empty_like(flat)
        w = np.empty_like(flat)
        for c in range(k):
            np.bitwise_xor(flat, xor[c], out=v)
            np.multiply(v, odd[c], out=v)
            np.right_shift(v, np.uint64(29), out=w)
            np.bitwise_xor(v, w, out=v)
            np.multiply(v, np.uint64(0xBF58476D1CE4E5B9), out=v)
            out[full, c] = np.minimum.reduceat(v, at) >> np.uint64(32)
    return out


def _set_keys(sets: list[np.ndarray]) -> list[bytes | None]:
    import xxhash

    return [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets]


def _signed(docs: DataFrame, words: int, k: int) -> DataFrame:
    """doc_id, text_hash, n_shingles, set_key (null for an empty set), sig of each document."""
    schema = pa.schema([("doc_id", pa.int64()), ("text_hash", pa.int64()), ("n_shingles", pa.int64()), ("set_key", pa.binary()), ("sig", pa.list_(pa.int32()))])

    def kernel(batch: pa.RecordBatch) -> dict:
        held("neardup", dict)  # lets go of a model that an earlier operator left in this process
        sets = shingle_sets([t.encode() for t in texts(batch)], words)
        sig = signatures(sets, k).view(np.int32)
        return {"doc_id": batch.column("doc_id"), "text_hash": batch.column("text_hash"), "n_shingles": [len(s) for s in sets], "set_key": _set_keys(sets), "sig": pa.ListArray.from_arrays(np.arange(0, sig.size + 1, k, dtype=np.int32), pa.array(sig.ravel()))}

    return map_batches(docs, kernel, "doc_id long, text_hash long, n_shingles long, set_key binary, sig array<int>", schema, 256)


def _sets_of(docs: DataFrame, words: int) -> DataFrame:
    """set_key and the full set as array<long> of each document."""
    schema = pa.schema([("set_key", pa.binary()), ("hashes", pa.list_(pa.int64()))])

    def kernel(batch: pa.RecordBatch) -> dict:
        own = shingle_sets([t.encode() for t in texts(batch)], words)
        sets = [s.view(np.int64) for s in own]
        flat = np.concatenate([*sets, np.zeros(0, np.int64)])
        return {"set_key": _set_keys(own), "hashes": pa.ListArray.from_arrays(np.cumsum([0, *map(len, sets)]).astype(np.int32), pa.array(flat))}

    return map_batches(docs, kernel, "set_key binary, hashes array<long>", schema, 256)


def components(edges: DataFrame, room: Room, name: str) -> DataFrame:
    """(node, root): the smallest node reachable over the edges (a, b), for every node of an edge.

    Alternating large-star and small-star contraction; each round is a written table, and the one before it is deleted."""
    number = 0
    now = room.write(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), f"{name}-{number}")
    state = None
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least("a", F.min("b")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        joined = large.join(least, "a")
        small = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(joined.select("a", F.col("m").alias("b"))).where("a <> b").distinct()
        number += 1
        now = room.write(small, f"{name}-{number}")
        fresh = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        room.drop(f"{name}-{number - 1}")
        if fresh == state:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
        state = fresh


class _Roots(dict):
    def find(self, x: int) -> int:
        while (up := self.setdefault(x, x)) != x:
            self[x] = self[up] if self[up] != up else up
            x = up
        return x


def _similar(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """Whether two sets of distinct values reach the similarity."""
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both * 100 >= (len(x) + len(y) - both) * percent


def _sides(rows: list[tuple], least: int) -> Iterator[tuple[tuple, list[tuple]]]:
    """For each row of the left side the rows of the right side, of other components, that collide in `least` coordinates.
    Rows are (rep, comp, side, signature, ...); side 0 meets side 1, side 2 meets all."""
    left, right = [r for r in rows if r[2] != 1], [r for r in rows if r[2] != 0]
    if left and right:
        signed, comp = np.stack([r[3] for r in right]), np.array([r[1] for r in right], np.int64)
        for row in left:
            found = np.flatnonzero((comp != row[1]) & ((signed == row[3]).sum(1) >= least)).tolist()
            if found:
                yield row, [right[k] for k in found]


def _meeting(rows: list[tuple], least: int) -> set[int]:
    """Who of a cell collides with anyone of another component."""
    return {r[0] for row, others in _sides(rows, least) for r in (row, *others)}


def _cell_links(rows: list[tuple], least: int, percent: int) -> list[tuple[int, int]]:
    """Links between the sides of one cell, at most one per pair of components, exact on the full sets (the last member)."""
    roots, found = _Roots(), []
    for row, others in _sides(rows, least):
        for other in others:
            x, y = roots.find(row[1]), roots.find(other[1])
            if x != y and _similar(row[4], other[4], percent):
                roots[max(x, y)] = min(x, y)
                found.append((max(row[0], other[0]), min(row[0], other[0])))
    return found


def _by_cell(rows: DataFrame, columns: tuple[str, ...], kernel, schema: pa.Schema, sql: str) -> DataFrame:
    """`kernel` (members of a cell -> columns of results, or None) over the cells (g, i, j) of rows (g, i, j, rep, comp, side, *columns)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, members = None, []

        def ended() -> Iterator[pa.RecordBatch]:
            found = kernel(key, members) if members else None
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(found, schema)], schema=schema)

        for piece in pieces(batches, 1024):
            cols = [piece.column(c).to_pylist() for c in ("g", "i", "j", "rep", "comp", "side")]
            for *now, rep, comp, side, rest in zip(*cols, zip(*[piece.column(c) for c in columns])):
                if now != key:
                    yield from ended()
                    key, members = now, []
                members.append((rep, comp, side, *(x.values.to_numpy() for x in rest)))
        yield from ended()

    return rows.repartition("g", "i", "j").sortWithinPartitions("g", "i", "j").select("g", "i", "j", "rep", "comp", "side", *columns).mapInArrow(run, sql)


def _compare(cells: DataFrame, reps: DataFrame, sets: DataFrame, percent: int, least: int, room: Room, name: str) -> DataFrame:
    """Links (a, b) of cells (g, i, j, rep, comp, side): signatures alone say who meets anyone, and only their full sets are fetched."""
    narrow = "g long, i int, j int, rep long, comp long, side int"
    kinds = pa.schema([("g", pa.int64()), ("i", pa.int32()), ("j", pa.int32()), ("rep", pa.int64()), ("comp", pa.int64()), ("side", pa.int32())])

    def meeting(key, members):
        who = _meeting(members, least)
        rows = [(*key, *m[:3]) for m in members if m[0] in who]
        return list(zip(*rows)) if rows else None

    def links(key, members):
        found = _cell_links(members, least, percent)
        return list(zip(*found)) if found else None

    signed = cells.join(reps.select("rep", "sig"), "rep")
    few = room.write(_by_cell(signed, ("sig",), meeting, kinds, narrow), name)
    whole = few.join(reps.select("rep", "sig"), "rep").join(sets, "rep")
    return _by_cell(whole, ("sig", "hashes"), links, pa.schema([("a", pa.int64()), ("b", pa.int64())]), "a long, b long")


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, k: int = COORDINATES, miss: float = MISS, id_col: str = "doc_id", text_col: str = "text", with_hash: bool = False) -> DataFrame:
    """Per document: its id, n_shingles, component_id (smallest id reachable over links, itself included), kept (id =
    component_id), and with `with_hash` text_hash (xxhash64 of the text).

    Two documents are linked if 100 * |intersection| >= percent * |union| of their shingle sets. Null, empty and word-less
    texts have an empty set and are linked with nothing. Rows are judged by their own text: rows that repeat an id with
    other texts may lie in other components, rows that repeat id and text say the same. Rows with a null id have the component
    of their text (null and kept where no row with an id is reachable) and never name one. Other columns are not read, so
    their names cannot clash. An empty table gives no rows.
    """
    m = least_collisions(k, percent, miss)
    room = Room(docs.sparkSession, "neardup")
    source = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))
    base = room.write(_signed(source.withColumn("text_hash", F.xxhash64("text")), words, k), "signatures")
    # Representatives of equal sets are numbered in the order of their smallest id, so the smallest number of a component names it.
    firsts = base.where("set_key is not null").groupBy("set_key").agg(F.min("doc_id").alias("doc_id"), F.min("n_shingles").alias("n"), F.min("sig").alias("sig"))
    reps = room.write(firsts.orderBy(F.asc_nulls_last("doc_id"), "set_key").withColumn("rep", F.monotonically_increasing_id()), "representatives")

    posted = reps.select("rep", F.posexplode("sig").alias("c", "v")).select("rep", F.xxhash64("c", "v").alias("h"))
    shared = posted.groupBy("h").agg(F.count("*").alias("df")).where("df > 1")
    lists = posted.join(shared, "h").groupBy("rep").agg(F.array_sort(F.collect_list(F.struct("df", "h"))).alias("own")).where(F.size("own") >= m)
    prefix = lists.select("rep", F.expr("aggregate(own, 0L, (s, x) -> s + x.df)").alias("weight"), F.explode(F.expr(f"slice(own, 1, size(own) - {m} + 1)")).alias("e")).select("rep", "weight", F.col("e.h").alias("h"))
    prefix = room.write(prefix.join(reps.select("rep", "n"), "rep"), "prefixes")

    wanted = reps.join(prefix.select("rep").distinct(), "rep", "left_semi").select("rep", "set_key", "doc_id")
    sets = room.write(_sets(source, room.write(wanted, "wanted"), words), "sets")

    hubs = prefix.groupBy("h").agg(F.max_by(F.struct("rep", "n"), F.struct("weight", -F.col("rep"))).alias("hub"), F.count("*").alias("members")).where("members > 1")
    fits = F.least("n", "hub.n") * 100 >= F.greatest("n", "hub.n") * percent
    stars = prefix.join(hubs, "h").where(fits & (F.col("rep") != F.col("hub.rep"))).select(F.greatest("rep", "hub.rep").alias("a"), F.least("rep", "hub.rep").alias("b")).distinct()
    first = room.write(_confirmed(_matches(stars, reps, m), sets, percent), "stars")
    roots = components(first, room, "star-components")

    member = prefix.select("rep").distinct().join(roots.withColumnRenamed("node", "rep"), "rep", "left").select("rep", F.coalesce("root", "rep").alias("comp"))
    member = room.write(member, "members")
    placed = prefix.select("h", "rep").join(member, "rep")
    core = hubs.select("h", F.col("hub.rep").alias("rep")).join(member, "rep").select("h", F.col("comp").alias("core"))
    outside = room.write(placed.join(core, "h").where("comp <> core").select("h", "rep", "comp", "core"), "outside")

    # Who is outside the core of one of its lists meets the core's members, once per core ...
    meet = outside.select("rep", "comp", F.col("core").alias("g")).distinct()
    wide = meet.groupBy("g").agg(F.count("*").alias("guests")).join(member.groupBy(F.col("comp").alias("g")).agg(F.count("*").alias("hosts")), "g")
    cells_of = lambda c: F.ceil(F.col(c) / F.lit(BLOCK)).cast("int")
    own = lambda c: F.pmod(F.xxhash64("rep", F.lit(7)), cells_of(c)).cast("int")
    every = lambda c: F.explode(F.sequence(F.lit(0), cells_of(c) - 1))
    guests = _salted(meet, wide).select("g", own("guests").alias("i"), every("hosts").alias("j"), "rep", "comp", F.lit(0).alias("side"))
    hosts = _salted(member.withColumn("g", F.col("comp")), wide).select("g", every("guests").alias("i"), own("hosts").alias("j"), "rep", "comp", F.lit(1).alias("side"))
    near = _compare(guests.unionByName(hosts), reps, sets, percent, m, room, "near-cells")
    # ... and the others outside, list by list, in pairs of blocks.
    lists = outside.groupBy(F.col("h").alias("g")).agg(F.count("*").alias("all"), F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi")
    block = _salted(outside.select(F.col("h").alias("g"), "rep", "comp"), lists).withColumn("own", own("all"))
    cells = block.select("g", "rep", "comp", "own", every("all").alias("k")).select(
        "g", F.least("own", "k").alias("i"), F.greatest("own", "k").alias("j"), "rep", "comp", F.when(F.col("own") == F.col("k"), 2).when(F.col("own") < F.col("k"), 0).otherwise(1).alias("side")
    )
    rest = _compare(cells, reps, sets, percent, m, room, "list-cells")
    second = room.write(near.unionByName(rest).distinct(), "links")
    final = components(first.unionByName(second), room, "components")

    moved = final.where("node <> root").join(reps.select(F.col("rep").alias("node"), "set_key"), "node")
    named = room.write(_named(moved, reps), "names")
    room.drop("prefixes", "wanted", "sets", "stars", "members", "outside", "near-cells", "list-cells", "links")
    out = base.drop("sig").join(reps.select("set_key", F.col("doc_id").alias("first")), "set_key", "left").join(named, "set_key", "left")
    out = out.select("doc_id", *["text_hash"] * with_hash, "n_shingles", F.coalesce("name", "first", "doc_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("component_id").isNull())).withColumnRenamed("doc_id", id_col)


def _named(moved: DataFrame, reps: DataFrame) -> DataFrame:
    """set_key and the id that names the component, of representatives that do not name it themselves. A component's
    representatives all look up one root, so the roots' side is salted."""
    roots = moved.select(F.col("root").alias("rep")).distinct().join(reps.select("rep", "doc_id"), "rep").select(F.col("rep").alias("g"), F.col("doc_id").alias("name"))
    return _salted(moved.select("set_key", F.col("node").alias("rep"), F.col("root").alias("g")), roots).select("set_key", "name")


def _salted(rows: DataFrame, facts: DataFrame, salts: int = 16) -> DataFrame:
    """`rows` (g, rep, ...) with the one row of `facts` for their g; a g that many rows have is dealt to several tasks."""
    many = facts.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return rows.withColumn("salt", F.pmod(F.xxhash64("rep", F.lit(3)), F.lit(salts)).cast("int")).join(many, ["g", "salt"]).drop("salt")


def _sets(source: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    """rep and full set of the representatives `wanted` (rep, set_key, doc_id). Up to `BROADCAST_IDS` ids, counted first, are
    broadcast, so that texts stay where they are; more are joined by a shuffle."""
    few = wanted.count() <= BROADCAST_IDS
    near = lambda df: F.broadcast(df) if few else df
    ids = wanted.select(F.col("doc_id").alias("wanted")).distinct()
    same = source.join(near(ids), F.col("doc_id").eqNullSafe(F.col("wanted")), "left_semi")
    return _sets_of(same.select("text"), words).join(near(wanted.select("rep", "set_key")), "set_key").select("rep", "hashes").dropDuplicates(["rep"])


def _matches(pairs: DataFrame, reps: DataFrame, least: int) -> DataFrame:
    """The pairs whose signatures collide in `least` coordinates or more."""
    left, right = (reps.select(F.col("rep").alias(x), F.col("sig").alias(f"s{x}")) for x in "ab")
    collisions = F.size(F.filter(F.zip_with("sa", "sb", lambda x, y: x == y), lambda same: same))
    return pairs.join(left, "a").join(right, "b").where(collisions >= least).select("a", "b")


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs whose full sets are similar enough."""
    left, right = (sets.select(F.col("rep").alias(x), F.col("hashes").alias(f"s{x}")) for x in "ab")
    both = F.size(F.array_intersect("sa", "sb"))
    checked = pairs.join(left, "a").join(right, "b").select("a", "b", (both * 100 >= (F.size("sa") + F.size("sb") - both) * percent).alias("linked"))
    return checked.where("linked").select("a", "b")
