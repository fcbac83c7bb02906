"""N-gram Jaccard join: adaptive multi-match prefixes.

Documents are sets of hashed word shingles. Documents with equal sets form a class, and only one of
each class is compared. Shingles are ordered from rare to common by counts over all documents, kept in
a sketch of fixed size. Two sets whose Jaccard similarity reaches the threshold share at least l
shingles of their l-prefixes, the first n - ceil(t n) + l shingles in that order (Wang, Li and Feng
2012); each document picks the l of least estimated cost, so that one made of common passages gets a
longer prefix and asks for more shared shingles. Two prefixes of different l must share the smaller.
For two given sizes the shared shingles stand further in front still: of two sets only the places before
size - needed overlap + l count, and a shingle too far back for that in a set's own size class can only meet
smaller sets. Near copies just below the threshold so share no shingle that counts.

Pairs are not enumerated inside groups: of the documents that share a prefix shingle, each is compared
with one pivot, links found so far give components, and the next rounds compare, with other pivots, only
documents of large groups in different components. What is left are documents of different components that share a
shingle of a group. Small groups (at most MANY rows) are joined. Large groups are cut into tiles of bounded size,
and each tile counts the shared shingles of its pairs in numpy, in bit sets, every pair at the first group that both
stand in. A tile is one row, sent to others of its group SPREAD at a time; the pairs of tiles and of documents are made
within tasks, and those to be compared are lists of partners, a row for each document. So a group of N rows costs
N + N * N / (TILE_ROWS * SPREAD) rows moved, and texts only of documents that have partners left, once for each pair of tiles.
All comparisons are exact, on whole texts; a block of pairs gets each text once and returns the links of a spanning
forest, at most one a document. Groups are of a shingle and a band of set sizes, as linked sets are of like size.

Defined results: null texts and texts without words have no shingle, link with nothing and are their
own component; a null doc_id has a null component; rows that repeat a doc_id count as one document
whose texts are all compared, so that they have one component, and each its own number of shingles. Extra columns are ignored by linked() and kept by one_of_each().
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C
from . import tokens as K
from .components import components

SHINGLE, PERCENT = 4, 85
SKETCH, SLICES = 1 << 18, 32
MOST_L = 4
#: All pairs of rows in different components are compared once the groups of more than MANY rows hold at most so many
#: for each row; else documents of such groups meet PIVOTS more pivots first, in MOST_ROUNDS rounds, or until a round
#: leaves more than half of these pairs.
PAIRS_A_ROW, MOST_ROUNDS, PIVOTS, MANY = 1, 4, 8, 16
#: Components between these rounds only save comparisons, and may be unfinished; the last ones are complete.
LABEL_ROUNDS = 2
#: Rows, and shingles of their sets, of one side of a tile of a large group.
TILE_ROWS, TILE_SHINGLES = 1024, 4_000_000
#: Tiles of a group that one task meets with a tile.
SPREAD = 16
#: A place's name in the first count is its top bits; names that coincide only keep a place that meets none.
NAME_SHIFT, BAND_SHIFT = 19, 24
#: Places counted in one group, and kept by a task before it passes them on.
GROUP_PLACES, TASK_PLACES = 1 << 20, 1 << 22
#: Partners of a pivot that are compared with it in one block.
BLOCK_ROWS = 256


def shingles(column: pa.Array, k: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of every text of a column, one array for each."""
    for chunk in K.chunks(column):
        word = chunk.hashes(lower=True)
        n = chunk.counts
        number = np.where(n >= k, n - k + 1, np.minimum(n, 1))
        first = np.repeat(chunk.bounds[:-1] - (np.cumsum(number) - number), number) + np.arange(number.sum())
        length = np.repeat(np.minimum(n, k), number)
        h = K.spans_hash(word, first, first + length, K._word_powers[0]).view(np.int64)
        at = np.concatenate([[0], np.cumsum(number)])
        for i in range(chunk.n):
            s = np.sort(h[at[i] : at[i + 1]])
            yield s[np.concatenate([[True], s[1:] != s[:-1]])] if len(s) else s


def bucket(h: np.ndarray) -> np.ndarray:
    return (h.view(K.U64) >> K.U64(46)).astype(np.int64)


def _described(k: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(SKETCH, np.int64)
        for batch in batches:
            n, a, b = [], [], []
            for s in shingles(batch.column("text"), k):
                np.add.at(counts, bucket(s), 1)
                u = s.view(K.U64)
                n.append(len(s))
                a.append(int(K.mix(u).sum(dtype=K.U64).view(np.int64)))
                b.append(int(K.mix(u ^ K.U64(0x5851F42D4C957F2D)).sum(dtype=K.U64).view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.nulls(len(n), pa.int32()), pa.nulls(len(n), pa.binary())], names=_NAMES)
        if counts.any():
            part = SKETCH // SLICES
            none = pa.nulls(SLICES, pa.int64())
            yield pa.RecordBatch.from_arrays([none, none, none, none, pa.array(range(SLICES), pa.int32()), pa.array([counts[i * part : (i + 1) * part].astype(np.int32).tobytes() for i in range(SLICES)])], names=_NAMES)

    return run


_NAMES = ["doc_id", "n", "set_a", "set_b", "slice", "counts"]


def _summed(table: pa.Table) -> pa.Table:
    total = np.zeros(SKETCH // SLICES, np.int64)
    for x in table["counts"].to_pylist():
        total += np.frombuffer(x, np.int32 if len(x) == 4 * len(total) else np.int64)
    return pa.table({"slice": table["slice"][:1], "counts": pa.array([total.tobytes()])})


def sketch_of(rows: DataFrame) -> np.ndarray:
    """Sum the tasks' sketches, in two steps so that no group grows with the number of tasks alone."""
    parts = rows.where("slice is not null").select("slice", "counts", F.pmod(F.xxhash64("counts"), F.lit(16)).alias("salt"))
    once = parts.groupBy("slice", "salt").applyInArrow(_summed, "slice int, counts binary")
    total = np.zeros((SLICES, SKETCH // SLICES), np.int64)
    for r in once.groupBy("slice").applyInArrow(_summed, "slice int, counts binary").collect():  # SLICES rows of fixed size
        total[r["slice"]] = np.frombuffer(r["counts"], np.int64)
    return total.reshape(-1)


def prefix(s: np.ndarray, counts: np.ndarray, percent: int, mean: float) -> tuple[np.ndarray, int]:
    """The prefix of a set, and its l: the one of least estimated cost."""
    n = len(s)
    c = counts[bucket(s)]
    order = np.lexsort((s, c))
    base = n - -(-percent * n // 100)  # n - ceil(t n)
    excess = np.cumsum(np.maximum(0.0, c[order] - mean))
    most = min(MOST_L, n - base)
    cost = [base + l + 4.0 * excess[base + l - 1] / l**2 for l in range(1, most + 1)]
    l = 1 + int(np.argmin(cost))
    return s[order[: base + l]], l


def _prefixes(k: int, percent: int, counts: np.ndarray) -> Callable:
    mean = float(counts.mean())
    step = float(np.log(100 / percent) * (1 + 1e-9))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, ls, ns = [], [], []
            for s in shingles(batch.column("text"), k):
                p, l = prefix(s, counts, percent, mean) if len(s) else (s, 0)
                out.append(p)
                ls.append(l)
                ns.append(len(s))
            at = np.concatenate([[0], np.cumsum([len(x) for x in out])]).astype(np.int32)
            flat = np.concatenate(out) if out else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(ns, pa.int32()), pa.array(ls, pa.int32()), pa.array(np.floor(np.log(np.maximum(ns, 1)) / step), pa.int32()), pa.ListArray.from_arrays(pa.array(at), pa.array(flat))], names=["doc", "n", "l", "band", "tokens"])

    return run


def _met(entries: np.ndarray) -> np.ndarray:
    """One entry for each name of sorted places (name << 3 | state); state: 1 for a member, 2 for a short one, 4 when a short one meets another's member."""
    if not len(entries):
        return entries
    name = entries >> 3
    first = np.flatnonzero(np.concatenate([[True], name[1:] != name[:-1]]))
    member, short = (np.add.reduceat((entries >> bit) & 1, first) for bit in (0, 1))
    both = np.add.reduceat((entries & 3) == 3, first, dtype=np.int64)
    met = (np.bitwise_or.reduceat(entries & 4, first) > 0) | (member * short > both)
    return name[first] << 3 | met.astype(np.int64) << 2 | (short > 0).astype(np.int64) << 1 | (member > 0)


def _named(percent: int, groups: int) -> Callable:
    """Prefixes to the places' names and states, merged within the task, sorted and written as differences: (bucket, part)."""
    edges = np.array([(i << (64 - NAME_SHIFT)) // groups << 3 for i in range(1, groups)], np.int64)

    def sent(entries: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        merged = _met(np.sort(np.concatenate(entries)))
        parts = [(i, x) for i, x in enumerate(np.split(merged, np.searchsorted(merged, edges))) if len(x)]
        packed = []
        for _, x in parts:
            gaps = np.diff(x)
            kind = np.uint32 if not len(gaps) or gaps.max() < 1 << 32 else np.int64
            packed.append(x[:1].tobytes() + gaps.astype(kind).tobytes() + (b"\x04" if kind is np.uint32 else b"\x08"))
        yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in parts], pa.int32()), pa.array(packed, pa.binary())], names=["bucket", "part"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, size = [], 0
        for batch in batches:
            lists = batch.column("tokens")
            long = np.diff(lists.offsets.to_numpy())
            token = lists.flatten().to_numpy()
            n, l, band = (np.repeat(batch.column(c).to_numpy().astype(np.int64), long) for c in ("n", "l", "band"))
            pos = np.arange(len(token)) - np.repeat(np.cumsum(long) - long, long)
            short = pos < n - (percent * 2 * n + 99 + percent) // (100 + percent) + l
            for some, up, state in ((slice(None), 0, 1 | short.astype(np.int64) << 1), (short, 1, 2)):
                place = (token ^ (band + up) << BAND_SHIFT)[some]
                kept.append((place.view(K.U64) >> K.U64(NAME_SHIFT)).view(np.int64) << 3 | state)
                size += len(kept[-1])
            if size > TASK_PLACES:
                yield from sent(kept)
                kept, size = [], 0
        if size:
            yield from sent(kept)

    return run


def _meeting(table: pa.Table) -> pa.Table:
    """The names of a bucket where a short place meets another's member."""
    parts = []
    for x in table["part"].to_pylist():
        gaps = np.frombuffer(x[8:-1], np.uint32 if x[-1] == 4 else np.int64).astype(np.int64)
        parts.append(np.cumsum(np.concatenate([np.frombuffer(x[:8], np.int64), gaps])))
    merged = _met(np.sort(np.concatenate(parts)))
    return pa.table({"name": merged[merged & 4 > 0] >> 3})


def _forest(k: int, percent: int) -> Callable:
    """A block's pairs and the texts of its documents to the links of a spanning forest of those that link."""

    def run(pairs: pa.Table, docs: pa.Table) -> pa.Table:
        sets: dict[int, list[np.ndarray]] = {}
        ids = iter(docs["doc"].to_pylist())
        for chunk in docs["text"].chunks:
            for s in shingles(chunk, k):
                sets.setdefault(next(ids), []).append(s)
        up: dict[int, int] = {}

        def top(x: int) -> int:
            while x in up:
                x = up[x]
            return x

        out = []
        for x, ys in zip(pairs["x"].to_pylist(), pairs["ys"].to_pylist(), strict=True):
            for y in ys:
                a, b = top(x), top(y)
                if a != b and any(linking(s, t, percent) for s in sets.get(x, ()) for t in sets.get(y, ())):
                    up[b] = a
                    out.append((x, y))
        return pa.table({"x": pa.array([x for x, _ in out], pa.int64()), "y": pa.array([y for _, y in out], pa.int64())})

    return run


def linking(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether two sorted sets link."""
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return bool(both) and 100 * both >= percent * (len(a) + len(b) - both)


def verify(pairs: DataFrame, held: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """Links (x, y) that connect what the linking pairs of each block connect, by exact comparison of whole texts.

    pairs: (b, x, ys), of a written table: x with each of ys; held: (b, doc_id), the documents of each block.
    """
    held = C.staged(held, "held")
    ids = C.staged(held.select("doc_id").distinct(), "ids")
    some = C.join_sized(texts, ids, "doc_id", "left_semi", F.lit(16))  # so that a large `held` meets these texts alone
    docs = C.join_sized(some, held, "doc_id", "inner", F.lit(24)).select("b", F.col("doc_id").alias("doc"), "text")
    out = C.staged(pairs.groupBy("b").cogroup(docs.groupBy("b")).applyInArrow(_forest(k, percent), "x long, y long"), "verified")
    C.dropped(held, ids)
    return out


def _verified(blocks: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """verify() of blocks of single pairs (b, x, y), a written table."""
    held = blocks.select("b", F.col("x").alias("doc_id")).union(blocks.select("b", "y")).distinct()
    return verify(blocks.select("b", "x", F.array("y").alias("ys")), held, texts, k, percent)


def _blocks(found: DataFrame) -> DataFrame:
    """Pairs (x, y, hub), a written table, dealt to blocks (b, x, y) of one hub and at most some BLOCK_ROWS partners."""
    large = found.groupBy("hub").count().where(f"count > {BLOCK_ROWS}").select("hub", F.ceil(F.col("count") / BLOCK_ROWS).alias("parts"))
    dealt = C.join_sized(found, C.staged(large, "hubs"), "hub", "left", F.lit(16))
    return dealt.select(F.xxhash64("hub", F.pmod(F.xxhash64(F.when(F.col("x") == F.col("hub"), F.col("y")).otherwise(F.col("x"))), F.coalesce("parts", F.lit(1)))).alias("b"), "x", "y")


def _need(percent: int, n: str, m: str) -> str:
    """SQL: how many shingles linked sets of sizes n and m share at least."""
    return f"(({percent}L * ({n} + {m}) + {99 + percent}) div {100 + percent})"


def _places(listed: DataFrame, percent: int) -> DataFrame:
    """(token, doc, n, l, pos, short, up): the places where documents can meet; token is of a shingle and a band of set sizes.

    Linked sets are of one band, or the larger one's is the next. So a place is listed in its own band and, if it
    can match a set that isn't smaller (short), in the next one too (up).
    """
    flat = listed.where("l > 0").select(F.posexplode("tokens").alias("pos", "token"), "doc", "n", "l", "band")
    flat = flat.withColumn("short", F.expr(f"pos < n - {_need(percent, 'n', 'n')} + l"))
    ups = F.when(F.col("short"), F.array(F.lit(False), F.lit(True))).otherwise(F.array(F.lit(False)))
    flat = flat.select("token", "band", "doc", "n", "l", "pos", "short", F.explode(ups).alias("up"))
    place = F.col("token").bitwiseXOR(F.shiftleft((F.col("band") + F.col("up").cast("int")).cast("long"), BAND_SHIFT))
    return flat.select(place.alias("token"), "doc", "n", "l", "pos", "short", "up")


def _labelled(places: DataFrame, label: DataFrame | None) -> DataFrame:
    if label is None:
        return places.withColumn("component", F.col("doc"))
    return C.join_sized(places, label.withColumnRenamed("node", "doc"), "doc", "left", F.lit(16)).withColumn("component", F.coalesce("component", "doc"))


def _open(places: DataFrame) -> DataFrame:
    """(token, rows, size, pairs) of the tokens where documents of different components meet; size: of their sets together."""
    parts = places.groupBy("token", "component").agg(F.count(F.lit(1)).alias("r"), F.sum("n").alias("n"), F.count_if(~F.col("up")).alias("c"), F.count_if("short").alias("s"))
    pairs = F.sum("c") * F.sum("s") - F.sum(F.col("c") * F.col("s"))
    return C.staged(parts.groupBy("token").agg(F.sum("r").alias("rows"), F.sum("n").alias("size"), pairs.alias("pairs")).where("pairs > 0"), "tokens")


def _candidates(met: DataFrame, percent: int) -> DataFrame:
    """The pairs (x, y, hub) among rows (doc, n, l, pos, p) that share as many places as their prefixes ask for; hub: the p of the pair."""
    needed = _need(percent, "n", "p.n")  # the l-th shingle that linked sets share stands before these places
    close = f"pos < n - {needed} + least(l, p.l) and p.pos < p.n - {needed} + least(l, p.l)"
    met = met.where("doc <> p.doc and component <> p.component").where(f"least(n, p.n) * 100L >= {percent} * greatest(n, p.n)").where(close)
    pair = [F.least("doc", "p.doc").alias("x"), F.greatest("doc", "p.doc").alias("y"), F.least("l", "p.l").alias("need"), F.col("p.doc").alias("hub")]
    return met.select(*pair).groupBy("x", "y", "need").agg(F.count(F.lit(1)).alias("count"), F.min("hub").alias("hub")).where("count >= need").select("x", "y", "hub")


def _tile(percent: int) -> Callable:
    """The pairs of each row's two tiles of one group that share as many places as their prefixes ask for, and no group before
    this one: (b, x, ys), and with x null the documents that stand in any pair.

    Tiles list all open places of a document, those of larger groups first: two documents are looked at in the first
    group where both stand. Sets of documents are bit sets, so that pairs met before cost next to nothing.
    """

    def needed(n: np.ndarray | int, m: np.ndarray | int) -> np.ndarray | int:
        return (percent * (n + m) + 99 + percent) // (100 + percent)

    def lists(column: pa.ListArray) -> list[np.ndarray]:
        at = column.offsets.to_numpy()
        return np.split(column.values.to_numpy()[at[0] : at[-1]], at[1:-1] - at[0]) if len(column) else []

    def met_in(token: int, sides: list[tuple[int, pa.StructArray]]) -> list[tuple[int, np.ndarray]]:
        column = lambda name: np.concatenate([s.field(name).to_numpy(zero_copy_only=False) for _, s in sides])
        doc, n, l = (column(c).astype(np.int64) for c in ("doc", "n", "l"))
        component, short, up = (column(c) for c in ("component", "short", "up"))
        part = np.concatenate([np.full(len(s), p) for p, s in sides])
        tokens, places = ([x for _, s in sides for x in lists(s.field(c))] for c in ("tokens", "places"))
        member = np.flatnonzero(~up)
        m_doc, m_n, m_l = doc[member], n[member], l[member]
        of = np.repeat(np.arange(len(member)), [len(tokens[i]) for i in member])
        flat = np.concatenate([tokens[i] for i in member]) if len(member) else np.zeros(0, np.int64)
        at = np.concatenate([places[i] for i in member]) if len(member) else np.zeros(0, np.int64)
        order = np.argsort(flat, kind="stable")
        names, first = np.unique(flat[order], return_index=True)
        where = dict(zip(names.tolist(), zip(first.tolist(), [*first[1:].tolist(), len(flat)], strict=True), strict=True))
        of, at = of[order], at[order]

        def bits(rows: np.ndarray) -> int:
            mask = np.zeros(len(member), bool)
            mask[rows] = True
            return int.from_bytes(np.packbits(mask, bitorder="little").tobytes(), "little")

        holding: dict[int, int] = {}

        def held(z: int) -> int:
            if z not in holding:
                holding[z] = bits(of[slice(*where[z])]) if z in where else 0
            return holding[z]

        same = {c: bits(np.flatnonzero(component[member] == c)) for c in np.unique(component[short]).tolist()}
        tiles = np.unique(part)
        beside = {p: bits(np.flatnonzero(part[member] == p)) for p in tiles.tolist()} if len(tiles) > 1 else {}
        every, out = (1 << len(member)) - 1, []
        for i in np.flatnonzero(short):
            ok = places[i] < n[i] - needed(n[i], n[i]) + l[i]
            mine, my_places = tokens[i][ok], places[i][ok]
            met = same[component[i]] | beside.get(part[i], 0)
            for z in mine.tolist():
                if z == token:
                    break
                met |= held(z)
            left = every & ~met
            if not left:
                continue
            some = np.flatnonzero(np.unpackbits(np.frombuffer(left.to_bytes(-(-len(member) // 8), "little"), np.uint8), bitorder="little")[: len(member)])
            larger = (n[i] < m_n[some]) | (n[i] == m_n[some]) & (doc[i] < m_doc[some])
            some = some[larger & (100 * n[i] >= percent * m_n[some])]
            if not len(some):
                continue
            need, low = needed(n[i], m_n[some]), np.minimum(l[i], m_l[some])
            place = np.full(len(member), -1)
            place[some] = np.arange(len(some))
            runs = [(*where[z], p) for z, p in zip(mine.tolist(), my_places.tolist(), strict=True) if z in where]
            hit = np.concatenate([place[of[a:b]] for a, b, _ in runs])
            theirs = np.concatenate([at[a:b] for a, b, _ in runs])
            own = np.repeat([p for *_, p in runs], [b - a for a, b, _ in runs])
            own, theirs, hit = own[hit >= 0], theirs[hit >= 0], hit[hit >= 0]
            close = (own < (n[i] - need + low)[hit]) & (theirs < (m_n[some] - need + low)[hit])
            good = some[np.bincount(hit[close], minlength=len(some)) >= low]
            if len(good):
                out.append((int(doc[i]), m_doc[good]))
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                token, b, i, j = (batch.column(c)[row].as_py() for c in ("token", "b", "i", "j"))
                sides = [(i, batch.column("rows")[row].values)] + ([(j, batch.column("other")[row].values)] if i != j else [])
                out = met_in(token, sides)
                if out:
                    ys = [y for _, y in out]
                    ys.append(np.unique(np.concatenate([*ys, [x for x, _ in out]])))
                    bounds = np.concatenate([[0], np.cumsum([len(y) for y in ys])]).astype(np.int32)
                    xs = pa.array([x for x, _ in out] + [None], pa.int64())
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ys), b)), xs, pa.ListArray.from_arrays(pa.array(bounds), pa.array(np.concatenate(ys).astype(np.int64)))], names=["b", "x", "ys"])

    return run


def _tiles(now: DataFrame, tokens: DataFrame) -> DataFrame:
    """(token, parts, part, rows): the open places `now` of each large group, in tiles of one row each; tokens: (token, rows, size)."""
    large = tokens.where(f"rows > {MANY}").select("token", "rows", F.greatest(F.ceil(F.col("rows") / TILE_ROWS), F.ceil(F.col("size") / TILE_SHINGLES)).cast("int").alias("parts"))
    rows = C.staged(C.join_sized(now, large, "token", "inner", F.lit(32)), "large")
    asked = C.staged(rows.select("doc", "up").distinct(), "asked")
    lists = C.join_sized(C.join_sized(now, asked, ["doc", "up"], "left_semi", F.lit(16)), tokens.select("token", "rows"), "token", "inner", F.lit(24))
    lists = lists.groupBy("doc", "up").agg(F.sort_array(F.collect_list(F.struct((-F.col("rows")).alias("r"), "token", "pos"))).alias("x"))
    lists = C.staged(lists.select("doc", "up", F.col("x.token").alias("tokens"), F.col("x.pos").alias("places")), "lists")
    part = F.pmod(F.xxhash64(F.lit("part"), "doc"), F.col("parts")).cast("int")
    listed = rows.withColumn("part", part).join(lists, ["doc", "up"]).groupBy("token", "parts", "part")
    out = C.staged(listed.agg(F.collect_list(F.struct("doc", "n", "l", "component", "short", "up", "tokens", "places")).alias("rows")), "tiles")
    C.dropped(rows, asked, lists)
    return out


def _in_tiles(now: DataFrame, tokens: DataFrame, percent: int) -> DataFrame:
    """(b, x, ys), written: what _tile() tells of all pairs of tiles of a group.

    A tile is sent to each SPREAD others of its group once, and its pairs with them are made within the task: what is
    moved are parts / SPREAD copies of a tile's row, and no pair of documents is a row.
    """
    tiles = _tiles(now, tokens)
    salts = F.ceil(F.col("parts") / SPREAD)
    left = tiles.select("token", F.col("part").alias("i"), "rows", F.explode(F.sequence(F.lit(0).cast("long"), salts - 1)).alias("salt"))
    right = tiles.select("token", F.col("part").alias("j"), F.col("rows").alias("other"), F.pmod(F.col("part"), salts).alias("salt"))
    pairs = left.join(right, ["token", "salt"]).where("i <= j")
    found = pairs.select("token", "i", "j", F.xxhash64("token", "i", "j").alias("b"), "rows", F.when(F.col("i") < F.col("j"), F.col("other")).alias("other"))
    out = C.staged(found.mapInArrow(_tile(percent), "b long, x long, ys array<long>"), "tiled")
    C.dropped(tiles)
    return out


def _partner() -> Column:
    return F.struct("doc", "n", "l", "pos", "component")


def _pivot(salt: str) -> Column:
    """The document of a group with the smallest hash."""
    return F.min_by(_partner(), F.struct(F.xxhash64(F.lit(salt), "doc"), "doc"))


#: The column that tells rows apart where ids repeat.
ROW_KEY = "_row_key"


def _one_document(mine: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows (doc_id, n, doc: the smallest id of their set's class) and links (x, y) of the classes that a repeated id stands in.

    A row without shingles whose id has others with some gets the first of their classes.
    """
    again = C.staged(mine.where("doc_id is not null").groupBy("doc_id").agg(F.count(F.lit(1)).alias("rows"), F.min("doc").alias("first")).where("rows > 1 and first is not null").select("doc_id", "first"), "again")
    if again.isEmpty():
        return mine, again.select(F.col("first").alias("x"), F.col("first").alias("y"))
    known = C.join_sized(mine, again, "doc_id", "left", F.lit(24))
    links = known.where("doc <> first").select(F.col("first").alias("x"), F.col("doc").alias("y")).distinct()
    return known.select("doc_id", "n", F.coalesce("doc", "first").alias("doc")), links


def linked(docs: DataFrame, k: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every document."""
    C.arrow_rows(docs.sparkSession)
    texts = C.rows_of(docs, {"doc_id": "long", "text": "string"})
    rows = C.staged(texts.mapInArrow(_described(k), "doc_id long, n long, set_a long, set_b long, slice int, counts binary"), "sets")
    sets = rows.where("slice is null").select("doc_id", "n", "set_a", "set_b")
    classes = C.staged(sets.where("n > 0 and doc_id is not null").groupBy("set_a", "set_b", "n").agg(F.min("doc_id").alias("doc")), "classes")
    mine, same = _one_document(C.staged(sets.join(classes, ["set_a", "set_b", "n"], "left").select("doc_id", "n", "doc"), "mine"))
    first = C.staged(classes.select(F.col("doc").alias("doc_id")).distinct(), "first")
    known = C.join_sized(texts, first, "doc_id", "left_semi", F.lit(16))
    listed = C.staged(known.mapInArrow(_prefixes(k, percent, sketch_of(rows)), "doc long, n int, l int, band int, tokens array<long>"), "prefixes")
    flat = _places(listed, percent)
    size = listed.agg(F.coalesce(F.sum(F.expr(f"n - ({percent}L * n + 99) div 100 + l")), F.lit(0))).first()[0]
    named = listed.select("n", "l", "band", "tokens").mapInArrow(_named(percent, -(-2 * size // GROUP_PLACES) or 1), "bucket int, part binary")
    meeting = C.staged(named.groupBy("bucket").applyInArrow(_meeting, "name long"), "meeting")
    named_flat = flat.withColumn("name", F.shiftrightunsigned("token", NAME_SHIFT))
    shared = C.staged(C.join_sized(named_flat, meeting, "name", "left_semi", F.lit(16)).drop("name"), "shared")
    C.dropped(listed, meeting)

    found = _labelled(shared, None)
    found = found.join(found.groupBy("token").agg(_pivot("0").alias("p")), "token")
    seen = C.staged(_candidates(found, percent), "found")
    links, seen = _verified(C.staged(_blocks(seen), "blocks"), texts, k, percent), seen.select("x", "y")
    label = components(links, LABEL_ROUNDS)

    # groups that are of one component now stay so: later steps leave them out
    opened, most = _open(_labelled(shared, label)), PAIRS_A_ROW * shared.count()
    still = C.staged(C.join_sized(shared, opened.select("token"), "token", "left_semi", F.lit(16)), "still")
    many = C.staged(C.join_sized(still, opened.where(f"rows > {MANY}").select("token"), "token", "left_semi", F.lit(16)), "many")
    C.dropped(shared, opened)
    before = None
    for turn in range(MOST_ROUNDS + 1):
        last = turn == MOST_ROUNDS
        if not last:  # each document with the pivots of its most common open shingle
            now = _labelled(many, label)
            tokens = _open(now)
            left = tokens.agg(F.coalesce(F.sum("pairs"), F.lit(0))).first()[0]
            last, before = left <= most or before is not None and 2 * left > before, left
            if not last:
                own = C.join_sized(now, tokens.select("token", "rows"), "token", "inner", F.lit(24)).groupBy("doc").agg(F.max_by(F.struct("token", "n", "component"), F.struct("rows", "token")).alias("m"))
                own = C.staged(own.select("doc", "m.*", F.lit(0).alias("pos"), F.lit(1).alias("l")), "own")
                best = own.groupBy("token").agg(F.array(*[_pivot(f"{turn}-{i}") for i in range(PIVOTS)]).alias("ps"))
                met = own.join(best.select("token", F.explode("ps").alias("p")), "token")
        if last:  # the first of a pair is the smaller set
            now = _labelled(still, label)
            tokens = _open(now)
            now = C.staged(C.join_sized(now, tokens.select("token"), "token", "left_semi", F.lit(16)), "open")
            few = C.join_sized(now, tokens.where(f"rows <= {MANY}").select("token"), "token", "left_semi", F.lit(16))
            met = few.where("short").join(few.where("not up").select("token", _partner().alias("p")), "token").where("n < p.n or n = p.n and doc < p.doc")
        found = C.staged(_candidates(met, percent).join(seen, ["x", "y"], "left_anti"), "found")
        links, seen = links.union(_verified(C.staged(_blocks(found), "blocks"), texts, k, percent)), seen.union(found.select("x", "y"))
        if last:
            tiled = _in_tiles(now, tokens, percent)
            held = tiled.where("x is null").select("b", F.explode("ys").alias("doc_id"))
            links = links.union(verify(tiled.where("x is not null"), held, texts, k, percent)).union(same)
        label = components(links, None if last else LABEL_ROUNDS)
        if last:
            break
    own = mine.join(label.withColumnsRenamed({"node": "doc"}), "doc", "left")
    return own.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc", "doc_id")).alias("component_id"))


def one_of_each(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """The documents without near copies: of each component the one of smallest doc_id.

    Where ids repeat, rows are told apart by id and text: of rows equal in both any one stays, different texts of
    an id are compared like other documents. Rows without an id all stay.
    """
    known = docs.where("doc_id is not null")
    if known.groupBy("doc_id").count().where("count > 1").isEmpty():
        gone = linked(docs, k, percent).where("doc_id <> component_id").select("doc_id").distinct()
        return C.join_sized(docs, C.staged(gone, "gone"), "doc_id", "left_anti", F.lit(16))
    keyed = known.withColumn(ROW_KEY, F.xxhash64("doc_id", "text"))
    label = linked(keyed.select(F.col(ROW_KEY).alias("doc_id"), "text"), k, percent).select(F.col("doc_id").alias(ROW_KEY), "component_id").distinct()
    ids = keyed.select(ROW_KEY, "doc_id").distinct()
    first = label.join(ids, ROW_KEY).groupBy("component_id").agg(F.min(F.struct("doc_id", ROW_KEY)).alias("first"))
    kept = C.join_sized(keyed, C.staged(first.select(f"first.{ROW_KEY}"), "kept"), ROW_KEY, "left_semi", F.lit(16))
    return kept.dropDuplicates([ROW_KEY]).select(*docs.columns).unionByName(docs.where("doc_id is null"))


def op8_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linked(C.documents(spark, sf_dir))


QUERIES: dict[str, Callable] = {"op8_jaccard": op8_jaccard}
