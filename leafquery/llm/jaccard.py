"""Exact n-gram Jaccard join of documents, and the components of its links.

Documents are sets of word shingles. Most have no partner, and this is seen before any set is moved:
a document that shares fewer than ``share`` of its shingles with all others together links with none.
What is left is joined by prefixes in order of document frequency. Each index list is sorted by set size and
position and read as blocks of one (size, position): two blocks that can't reach the overlap are skipped whole.
A long list is cut into slices of ``CELL`` entries in that order. Pairs of slices, the cells, are groups of their
own in the shuffle, and a cell whose bounds allow no link is never made. A set is first compared with one hub of
each list. Later answers are derived from these: two sets near hubs whose own distance is known need no
comparison unless the distances allow a link.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F, Window

from leafquery.functions.staging import stage
from leafquery.llm.common import hash_words, keyed, mix, slices, text_buffer, window_hashes
from leafquery.llm.components import components, extend

SHINGLE = 5
SHARE = 80  # of 100
_CHUNK = 2_000_000
RANGE_BYTES = 8_000_000
MEETS = 6
CELL = 512  # entries in a slice of an index list


def shingle_sets(column: pa.Array, width: int = SHINGLE) -> list[np.ndarray]:
    """Sorted distinct 64-bit shingle hashes of each text; fewer words than ``width`` are one shingle."""
    buf, offsets = text_buffer(column)
    out = []
    for a, b in slices(offsets, _CHUNK):
        base = offsets[a]
        _, words, first = hash_words(buf[base:offsets[b]], offsets[a:b + 1] - base)
        grams = window_hashes(words, width)
        for i in range(b - a):
            n = first[i + 1] - first[i]
            if n >= width:
                out.append(np.unique(grams[first[i]:first[i + 1] - width + 1]))
            elif n:
                # the words and their number, so that no full shingle is meant
                out.append(mix(np.array([window_hashes(words[first[i]:first[i + 1]], n, int(n))[0]], np.uint64)))
            else:
                out.append(np.zeros(0, np.uint64))
    return out


def _sparse(who: np.ndarray, n: np.ndarray) -> bytes:
    """Numbers and their counts, two bytes each where all fit, else four; the first byte tells which."""
    both = np.stack([who, n])
    kind = "<u2" if not both.size or both.max() <= 65535 else "<u4"
    return kind[-1:].encode() + both.astype(kind).tobytes()


def _unsparse(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    who, n = np.frombuffer(data, "<u" + data[:1].decode(), offset=1).reshape(2, -1).astype(np.int64)
    return who, n


def _shared_counts(docs: DataFrame, ranges: int, width: int) -> DataFrame:
    """(id, hash, n, shared): set size of each row, and how many of its shingles others have too.

    Each chunk of documents sends its shingles, four bytes each, to ``ranges`` ranges of the hash
    space. A shingle that a chunk holds twice is known as shared there and sent once for its chunk, so
    a hot shingle never comes from every document. Beside them go the numbers of only those documents that
    have shingles in the range, so all that is sent grows with the shingles, whatever ``ranges`` is.
    ``shared`` may count a shingle too many (when 32 bits within a range collide), never one too few.
    """
    mid = "chunk bigint, part bigint, counts binary, shingles binary, ids binary"
    kind = docs.schema["key"].dataType["id"].dataType
    out = docs.select("key").schema.add("n", "long").add("shared", "long")

    def send(batches):
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            _, offsets = text_buffer(batch.column(1))
            for a, b in slices(offsets, _CHUNK):
                own = batch.slice(a, b - a)
                sets = shingle_sets(own.column(1), width)
                n = np.array([len(s) for s in sets])
                values = np.concatenate(sets)
                doc = np.repeat(np.arange(len(sets)), n)
                order = np.argsort(values, kind="stable")
                values, doc = values[order], doc[order]
                again = values[1:] == values[:-1]  # equal to the one before
                first = np.concatenate([[True], ~again])[:len(values)]
                twice = ~first | np.concatenate([again, [False]])[:len(values)]
                known = np.bincount(doc[twice], minlength=len(sets))
                doc[twice] = len(sets)  # asked for the chunk as a whole
                values, doc = values[first], doc[first]
                # range and 32 bits within it, both from the top of the hash
                high = values >> np.uint64(32)
                part = (high * np.uint64(ranges)) >> np.uint64(32)
                low = (values * np.uint64(ranges)) >> np.uint64(32)
                bounds = np.searchsorted(part, np.arange(ranges + 1, dtype=np.uint64))
                chunk, parts, counts, shingles, ids = [], [], [], [], []
                for r in np.flatnonzero(np.diff(bounds)):
                    x = slice(bounds[r], bounds[r + 1])
                    by_doc = np.argsort(doc[x], kind="stable")
                    chunk.append(number)
                    parts.append(int(r))
                    counts.append(_sparse(*np.unique(doc[x], return_counts=True)))
                    shingles.append(low[x][by_doc].astype("<u4").tobytes())
                    ids.append(None)
                # the keys travel to the end of the chunk as a group of their own
                sink = pa.BufferOutputStream()
                keys = pa.RecordBatch.from_arrays([own.column(0), pa.array(n), pa.array(known)], ["key", "n", "shared"])
                with pa.ipc.new_stream(sink, keys.schema) as w:
                    w.write_batch(keys)
                chunk.append(number)
                parts.append(-1 - number)
                counts.append(None)
                shingles.append(None)
                ids.append(sink.getvalue().to_pybytes())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(chunk, pa.int64()), pa.array(parts, pa.int64()), pa.array(counts, pa.binary()),
                     pa.array(shingles, pa.binary()), pa.array(ids, pa.binary())],
                    ["chunk", "part", "counts", "shingles", "ids"])
                number += 1

    def answer(key, table):
        if key[0].as_py() < 0:
            return table
        sent = [np.frombuffer(x, "<u4") for x in table["shingles"].to_pylist()]
        values = np.concatenate(sent)
        order = np.argsort(values, kind="stable")
        ordered = values[order]
        same = ordered[1:] == ordered[:-1]
        twice = np.zeros(len(values), bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        at, counts = 0, []
        for have, own in zip(table["counts"].to_pylist(), sent):
            who, n = _unsparse(have)
            total = np.concatenate([[0], np.cumsum(twice[at:at + len(own)])])
            ends = np.cumsum(n)
            got = total[ends] - total[ends - n]
            counts.append(_sparse(who[got > 0], got[got > 0]))
            at += len(own)
        return pa.table([table["chunk"], table["part"], pa.array(counts, pa.binary()),
                         pa.nulls(len(table), pa.binary()), table["ids"]], ["chunk", "part", "counts", "shingles", "ids"])

    def collect(key, table):
        ids = table["ids"].to_pylist()
        keys = pa.ipc.open_stream(next(x for x in ids if x is not None)).read_all()
        # one place more, for what was asked for the chunk as a whole
        shared = np.append(keys["shared"].to_numpy(), 0)
        for x in table["counts"].to_pylist():
            if x is not None:
                who, n = _unsparse(x)
                shared[who] += n
        return pa.table([keys["key"].combine_chunks(), keys["n"], pa.array(shared[:-1], pa.int64())],
                        ["key", "n", "shared"])

    sent = docs.select("key", "text").mapInArrow(send, mid)
    return sent.groupBy("part").applyInArrow(answer, mid).groupBy("chunk").applyInArrow(collect, out)


def _viable(n1, p1, n2, p2, share: int):
    """Whether sets of sizes n1, n2 whose first common prefix shingle may be at p1, p2 can reach the share."""
    most = 1 + np.minimum(n1 - p1 - 1, n2 - p2 - 1)
    return (100 + share) * most >= share * (n1 + n2)


def _lists(batches, columns, keys: int):
    """Index lists, one after the other, from rows sorted by their first ``keys`` columns."""
    rest = None
    for batch in batches:
        cols = [batch.column(c).to_numpy(zero_copy_only=False) for c in columns]
        if rest is not None:
            cols = [np.concatenate([r, c]) for r, c in zip(rest, cols)]
        if not len(cols[0]):
            continue
        cuts = np.flatnonzero(np.any([c[1:] != c[:-1] for c in cols[:keys]], axis=0)) + 1
        last = cuts[-1] if len(cuts) else 0
        for a, b in zip([0, *cuts[:-1]] if len(cuts) else [], cuts):
            if b - a > 1:
                yield [c[a:b] for c in cols]
        rest = [c[last:] for c in cols]
    if rest is not None and len(rest[0]) > 1:
        yield rest


def _pairs_of_list(n, p, part, share):
    """For each entry i of a list sorted by (n, p): (i, later entries j that position and size allow).

    Entries of one (n, p) are a block; whether two blocks can hold a link is asked once for both. A list of two
    slices (``part``) gives pairs across them only, one of a single slice all its pairs.
    """
    starts = np.flatnonzero(np.concatenate([[True], (n[1:] != n[:-1]) | (p[1:] != p[:-1])]))
    ends = np.append(starts[1:], len(n))
    size, place = n[starts], p[starts]
    across = part.min() != part.max()
    for x in range(len(starts)):
        y = np.arange(x, np.searchsorted(size, size[x] * 100 // share, "right"))
        y = y[_viable(size[x], place[x], size[y], place[y], share)]
        if not len(y):
            continue
        reach = np.concatenate([np.arange(starts[k], ends[k]) for k in y])
        for i in range(starts[x], ends[x]):
            j = reach[np.searchsorted(reach, i, "right"):]
            j = j[part[j] != part[i]] if across else j
            if len(j):
                yield i, j


def _meetings(n, p, sid, part, share: int, comp=None):
    """Pairs to compare first: a row of the index gives MEETS + 1 of them at most.

    Each entry of a list meets the first entry before it that it could link with, a hub of many, and MEETS at
    random, which differ from list to list, so that groups of near copies hold together by what they meet in all
    their lists. With ``comp`` only entries of other components are met.
    """
    first, other, seen = np.full(len(n), -1), np.full((MEETS, len(n)), -1), np.zeros(len(n))
    rng = np.random.default_rng(int(sid.sum() & 0x7FFFFFFF))
    for i, j in _pairs_of_list(n, p, part, share):
        j = j if comp is None else j[comp[j] != comp[i]]
        seen[j] += 1
        first[j] = np.where(first[j] < 0, i, first[j])
        turn, taken = np.nonzero(rng.random((MEETS, len(j))) * seen[j] < 1)
        other[turn, j[taken]] = i
    for k in np.flatnonzero(first >= 0).tolist():
        for i in {int(first[k]), *other[:, k].tolist()}:
            yield int(sid[i]), int(sid[k])


def _hub_pairs(n, p, part, comp, hub, d, share: int) -> dict[tuple[int, int], float]:
    """(a, b) of the hubs of entries that may link, with the largest sum of their distances to them.

    Sets near one hub are many and their distances all differ, so a pair of hubs has one row, not one a pair of sets.
    """
    out: dict[tuple[int, int], float] = {}
    for i, j in _pairs_of_list(n, p, part, share):
        j = j[comp[j] != comp[i]]
        own = int(hub[i])
        for h, slack in zip(hub[j].tolist(), (d[j] + d[i]).tolist()):
            key = (own, h) if own < h else (h, own)
            out[key] = max(slack, out.get(key, slack))
    return out


def _sliced(index: DataFrame, cell: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(index with ``part``, the slice of its list; bounds of the slices of long lists; shingles of long lists).

    A list of at most ``cell`` entries is one slice. Longer ones are cut in the order of (n, p), from counts of
    blocks alone; a block that spans slices is dealt over them by a hash of its sets. Bounds (shingle, part,
    n_low, n_high, room) hold for all that a slice may have; with a column ``comp`` also its range.
    """
    long_ = stage(index.groupBy("shingle").agg(F.count("*").alias("_len")).filter(F.col("_len") > cell).select("shingle"))
    comp = [F.min("comp").alias("comp_low"), F.max("comp").alias("comp_high")] if "comp" in index.columns else []
    blocks = index.join(long_, "shingle").groupBy("shingle", "n", "p").agg(F.count("*").alias("_count"), *comp)
    before = Window.partitionBy("shingle").orderBy("n", "p").rowsBetween(Window.unboundedPreceding, -1)
    blocks = stage(blocks.withColumn("_start", F.coalesce(F.sum("_count").over(before), F.lit(0))))
    at = F.col("_start") + F.pmod(F.xxhash64("shingle", "sid"), "_count")
    own = index.join(blocks.select("shingle", "n", "p", "_count", "_start"), ["shingle", "n", "p"], "left").withColumn(
        "part", F.coalesce(F.floor(at / cell), F.lit(0)).cast("bigint")).drop("_count", "_start")
    spans = F.sequence(*[F.floor(x / cell).cast("bigint") for x in (F.col("_start"), F.col("_start") + F.col("_count") - 1)])
    ranges = [F.min("comp_low").alias("comp_low"), F.max("comp_high").alias("comp_high")] if comp else []
    bounds = blocks.withColumn("part", F.explode(spans)).groupBy("shingle", "part").agg(
        F.min("n").alias("n_low"), F.max("n").alias("n_high"), F.max(F.col("n") - F.col("p")).alias("room"), *ranges)
    return own, bounds, long_


def _cells(index: DataFrame, share: int, cell: int) -> DataFrame:
    """Index rows with ``part`` and their cells (x, y): a row for each cell that an entry takes part in.

    Lists of one slice are the cell (0, 0). Of longer ones all pairs of slices whose bounds allow a link are
    cells, so that a list of m entries is read by groups of at most about two slices, m / ``cell`` times.
    """
    own, bounds, long_ = _sliced(index, cell)
    left = bounds.select("shingle", *[F.col(c).alias(f"l_{c}") for c in bounds.columns if c != "shingle"])
    met = left.join(bounds, "shingle").filter("l_part <= part").filter(
        (share * F.col("n_low") <= 100 * F.col("l_n_high")) &
        ((100 + share) * F.least("l_room", "room") >= share * (F.col("l_n_low") + F.col("n_low"))))
    if "comp" in index.columns:
        met = met.filter("least(l_comp_low, comp_low) < greatest(l_comp_high, comp_high)")
    met = met.select("shingle", F.col("l_part").alias("x"), F.col("part").alias("y"))
    # a slice of a long list that is in no cell has nothing to say
    takes = met.withColumn("part", F.explode(F.array_distinct(F.array("x", "y"))))
    short = own.join(long_, "shingle", "left_anti").withColumns({"x": F.lit(0).cast("bigint"), "y": F.lit(0).cast("bigint")})
    return short.unionByName(own.join(takes, ["shingle", "part"]).select(short.columns))


def _scan(index: DataFrame, columns: list[str], schema: str, emit, share: int, cell: int, whole: bool = True) -> DataFrame:
    """Apply ``emit`` to every list, cell by cell; its results are deduplicated within a task, batch by batch.

    With ``whole`` every pair of entries that bounds allow is in one cell; else only pairs of one slice are. Where ``emit``
    gives a dict, its values are numbers of which the largest counts: a key comes out once with that of its batch.
    """
    names = [c.split()[0] for c in schema.split(", ")]
    keys = ["shingle", "x", "y"] if whole else ["shingle", "part"]
    columns = keys + [c for c in ("part", *columns) if c not in keys]

    def run(batches):
        found: set[tuple] = set()
        most: dict[tuple, float] = {}

        def rows():
            return pa.RecordBatch.from_pylist([dict(zip(names, x)) for x in (*found, *((*k, v) for k, v in most.items()))])

        for own in _lists(batches, columns, len(keys)):
            got = emit(**{c: v for c, v in zip(columns, own) if c not in ("shingle", "x", "y")})
            if isinstance(got, dict):
                for k, v in got.items():
                    most[k] = max(v, most.get(k, v))
            else:
                found.update(got)
            if len(found) + len(most) > 200_000:
                yield rows()
                found, most = set(), {}
        if found or most:
            yield rows()

    rows = _cells(index, share, cell) if whole else _sliced(index, cell)[0]
    dealt = rows.select(*columns).repartition(*[F.col(k) for k in keys]).sortWithinPartitions(*keys, "n", "p", "sid")
    return dealt.mapInArrow(run, schema)


def _overlaps(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """pairs (a, b) with n_a, n_b and ``both``, the number of common shingles."""
    def run(x: pa.Array, y: pa.Array) -> pa.Array:
        out = [len(np.intersect1d(np.frombuffer(a, "<u8"), np.frombuffer(b, "<u8"), assume_unique=True))
               for a, b in zip(x.to_pylist(), y.to_pylist())]
        return pa.array(out, pa.int64())

    a = sets.select(F.col("sid").alias("a"), F.col("n").alias("n_a"), F.col("shingles").alias("x"))
    b = sets.select(F.col("sid").alias("b"), F.col("n").alias("n_b"), F.col("shingles").alias("y"))
    return stage(pairs.join(b.hint("merge"), "b").join(a.hint("merge"), "a").select("a", "b", "n_a", "n_b", F.arrow_udf(run, "bigint")("x", "y").alias("both")))


def _linked(o: DataFrame, share: int) -> DataFrame:
    return o.filter((100 + share) * F.col("both") >= share * (F.col("n_a") + F.col("n_b")))


def _distance():
    return 1 - F.col("both") / (F.col("n_a") + F.col("n_b") - F.col("both"))


def _apart(pairs: DataFrame, comps: DataFrame) -> DataFrame:
    """The ``pairs`` (a, b) of different components."""
    for side in ("a", "b"):
        own = comps.select(F.col("id").alias(side), F.col("component").alias(f"_{side}"))
        pairs = pairs.join(own, side, "left").withColumn(f"_{side}", F.coalesce(f"_{side}", side))
    return pairs.filter("_a <> _b").select("a", "b")


def _relabelled(known: DataFrame, comps: DataFrame) -> DataFrame:
    """Index rows with the components of now, of lists that hold more than one."""
    own = stage(known.drop("comp").join(comps.withColumnRenamed("id", "sid"), "sid", "left")
                .withColumn("comp", F.coalesce("component", "sid")).drop("component"))
    mixed = own.groupBy("shingle").agg(F.min("comp").alias("x"), F.max("comp").alias("y")).filter("x <> y").select("shingle")
    return own.join(stage(mixed), "shingle", "left_semi")


def set_links(sets: DataFrame, share: int = SHARE, cell: int = CELL) -> DataFrame:
    """(id, component) of the distinct sets (sid, n, shingles) that have a link."""
    def explode(batches):
        for batch in batches:
            for a in range(0, batch.num_rows, 200):
                own = batch.slice(a, 200)
                arrays = [np.frombuffer(x, "<u8") for x in own.column(2).to_pylist()]
                count = [len(x) for x in arrays]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.repeat(own.column(0).to_numpy(), count)), pa.array(np.repeat(own.column(1).to_numpy(), count)),
                     pa.array(np.concatenate(arrays).view(np.int64))], ["sid", "n", "shingle"])

    rows = sets.select("sid", "n", "shingles").mapInArrow(explode, "sid bigint, n bigint, shingle bigint")
    counts = stage(rows.groupBy("shingle").agg(F.count("*").alias("df")).filter("df > 1"))
    # shingles of one set only stand first in the order; they meet nothing and are only counted
    order = Window.partitionBy("sid").orderBy("df", "shingle")
    held = Window.partitionBy("sid")
    prefix = F.col("n") - F.ceil(F.col("n") * share / 100) + 1
    index = stage(rows.join(counts, "shingle")
                  .withColumn("p", F.col("n") - F.count("*").over(held) + F.row_number().over(order) - 1)
                  .filter(F.col("p") < prefix).select("shingle", "n", F.col("p").cast("bigint").alias("p"), "sid"))

    def hubs(n, p, sid, part):
        return _meetings(n, p, sid, part, share)

    pair = "a bigint, b bigint"
    first = _overlaps(_scan(index, ["n", "p", "sid"], pair, hubs, share, cell, whole=False).distinct(), sets)
    comps = stage(components(_linked(first, share).select("a", "b")))
    # the nearest hub of each set, and how far it is
    near = (_linked(first, share).groupBy(F.col("b").alias("sid"))
            .agg(F.min(F.struct(_distance().alias("d"), F.col("a").alias("hub"))).alias("m")))
    who = stage(near.select("sid", "m.hub", "m.d"))
    known = index.join(who, "sid", "left").select(
        "shingle", "n", "p", "sid", F.coalesce("hub", "sid").alias("hub"), F.coalesce("d", F.lit(0.0)).alias("d"))
    # lists whose sets are all of one component have no more to say
    known = stage(_relabelled(known, comps))
    columns = ["n", "p", "sid", "comp", "hub", "d"]

    def strangers(n, p, sid, part, comp, hub, d):
        return _meetings(n, p, sid, part, share, comp)

    again = _overlaps(_scan(known, columns, pair, strangers, share, cell, whole=False).distinct(), sets)
    comps = stage(extend(comps, _linked(again, share).select("a", "b")))
    known = stage(_relabelled(known, comps))

    def hub_pairs(n, p, sid, part, comp, hub, d):
        return _hub_pairs(n, p, part, comp, hub, d, share)

    apart = stage(_scan(known, columns, "a bigint, b bigint, slack double", hub_pairs, share, cell)
                  .groupBy("a", "b").agg(F.max("slack").alias("slack")))
    second = _overlaps(apart.select("a", "b"), sets)
    comps = stage(extend(comps, _linked(second, share).select("a", "b")))
    known = stage(_relabelled(known, comps))
    # by the triangle inequality, sets near two hubs can link only if the hubs are near enough, and they need no
    # comparison where the hubs' components have met by now
    far = second.join(apart, ["a", "b"]).filter("slack > 0").filter(
        _distance() <= 1 - share / 100 + F.col("slack") + 1e-9).select("a", "b")
    open_ = stage(_apart(far, comps).select(F.col("a").alias("hub_a"), F.col("b").alias("hub_b")))

    def set_pairs(n, p, sid, part, comp, hub, d):
        for i, j in _pairs_of_list(n, p, part, share):
            j = j[(comp[j] != comp[i]) & ((d[j] > 0) | (d[i] > 0))]
            for k in j.tolist():
                a, b = (i, k) if hub[i] < hub[k] else (k, i)
                yield int(sid[a]), int(sid[b]), int(hub[a]), int(hub[b])

    # only lists and sets near a hub of an open pair are read again
    near_open = stage(open_.select(F.col("hub_a").alias("hub")).union(open_.select("hub_b")).distinct())
    third = _scan(stage(known.join(near_open, "hub", "left_semi")), columns,
                  "a bigint, b bigint, hub_a bigint, hub_b bigint", set_pairs, share, cell)
    third = third.join(open_, ["hub_a", "hub_b"], "left_semi").select("a", "b").distinct()
    return extend(comps, _linked(_overlaps(third, sets), share).select("a", "b"))


def jaccard_components(docs: DataFrame, share: int = SHARE, width: int = SHINGLE, *, id_col: str = "doc_id",
                       text_col: str = "text", cell: int = CELL) -> DataFrame:
    """(key, id, n_shingles, component_id, component_key): one row for each row of ``docs``.

    Two documents link when their sets of ``width``-word shingles have ``share`` percent of their
    union in common; ``component_id`` is the smallest id reached by links. Texts of fewer words are
    one shingle; null, empty and blank texts have none and link with nothing. Repeated rows and
    copies are one set each, so they are never compared with each other. A null id takes part and
    yields to any other in the minimum. ``key`` is that of ``common.row_key``; ``component_key`` is a
    number of the component, null for documents that no other comes near. A text of any length is read
    whole, in one task. An empty table gives an empty result. ``cell`` bounds the entries of an index list that
    are held together, about twice as many; it never changes the result.
    """
    rows = keyed(docs, id_col, text_col).select("id", "text", "key")
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    base = stage(_shared_counts(rows, max(16, -(-size // RANGE_BYTES)), width))
    # equal rows are told apart no more: they have one key
    able = base.filter(F.col("n") > 0).filter(100 * F.col("shared") >= share * F.col("n")).select("key").distinct()

    def sets_of(batches):
        for batch in batches:
            for a in range(0, batch.num_rows, 500):
                own = batch.slice(a, 500)
                sets = shingle_sets(own.column(1), width)
                yield pa.RecordBatch.from_arrays(
                    [own.column(0), pa.array([len(s) for s in sets], pa.int64()),
                     pa.array([s.astype("<u8").tobytes() for s in sets], pa.binary())], ["key", "n", "shingles"])

    # dealt by key at every size, so that what is moved grows with the input alone
    texts = rows.select("key", "text").join(stage(able).hint("merge"), "key", "left_semi")
    schema = texts.select("key").schema.add("n", "long").add("shingles", "binary")
    own = stage(texts.mapInArrow(sets_of, schema).withColumn("sig", F.unhex(F.md5("shingles"))))
    sets = stage(own.groupBy("sig").agg(F.first("n").alias("n"), F.first("shingles").alias("shingles"),
                                        F.min("key.id").alias("least"))
                 .withColumn("sid", F.monotonically_increasing_id()))
    comps = set_links(sets, share, cell)
    named = sets.select("sid", "sig", "least").join(comps, F.col("sid") == F.col("id"), "left").select(
        "sig", "least", F.coalesce("component", "sid").alias("component"))
    lowest = named.groupBy("component").agg(F.min("least").alias("low"))
    of_set = stage(named.join(stage(lowest), "component").select("sig", "low", "component"))
    of_row = own.select("key", "sig").distinct().join(of_set, "sig").select("key", "low", "component")
    return base.join(of_row, "key", "left").select(
        "key", F.col("key.id").alias("id"), F.col("n").alias("n_shingles"),
        F.coalesce("low", "key.id").alias("component_id"), F.col("component").alias("component_key"))


def one_of_each(docs: DataFrame, share: int = SHARE, width: int = SHINGLE, *, id_col: str = "doc_id",
                text_col: str = "text") -> DataFrame:
    """``docs`` with one row for each component: that of the smallest id, of equal rows only one.

    Rows without a word link with nothing and all stay. Ties of one id with several texts in a
    component go to the smallest text hash; a component of null ids keeps one row likewise.
    """
    found = jaccard_components(docs, share, width, id_col=id_col, text_col=text_col)
    # one row for each key: how many rows share it, and whether it stands for its component
    keys = stage(found.groupBy("key").agg(F.first("n_shingles").alias("n"), F.first("component_id").alias("low"),
                                          F.first("component_key").alias("component_key"), F.count("*").alias("copies")))
    least = keys.filter("n > 0 and component_key is not null").groupBy("component_key").agg(
        F.min(F.struct(F.col("key.id").isNull().alias("none"), F.col("key").alias("key"))).alias("best"))
    best = stage(least.select(F.col("best.key").alias("key"), F.lit(True).alias("best")))
    keep = stage(keys.join(best, "key", "left")
                 .filter(F.col("component_key").isNull() | (F.col("n") == 0) | F.col("best"))
                 .select("key", ((F.col("n") > 0) & (F.col("copies") > 1)).alias("many")))
    rows = keyed(docs, id_col, text_col).select("row", "key").join(keep, "key")
    single = rows.filter(~F.col("many")).select("row")
    many = rows.filter("many").groupBy("key").agg(F.first("row").alias("row")).select("row")
    return single.union(many).select("row.*")
