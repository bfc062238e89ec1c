"""N-gram Jaccard join by a prefix tree over globally ordered n-gram sets.

Sets are five-word shingles (A-Z lower-cased; a text with fewer words is one
shingle, one without words an empty set that links with nothing), held as 64-bit
hashes. Two documents link when |A & B| / |A | B| >= 80/100; the result is each
document's class of equal sets and the component of links it belongs to and, where
asked for (``counted``), its exact number of links, found in step 5.

The global order puts shingles that are frequent anywhere in the corpus last, the
others by hash. Sets that share enough must then share one of their first
n - ceil(0.8 n) + 1 shingles. The steps:

1. Equal sets become one class (so copies never meet), by size and 128-bit hash.
2. Classes of a size class with two equal MinHash values are blocks; a block is cut
   into chunks that all hold its smallest class. A trie join within a chunk links near copies.
   This finds no new kind of link: it spares step 3 the pairs already connected.
3. Prefix shingles that only one component holds need nothing more. The others are
   blocks of (shingle, size class), where sizes a link can't bridge don't meet, and
   sets that share too few prefix shingles with any other to link there are left out;
   blocks with the same smallest and largest class become one. A large block is cut into chunks, each
   pair of which meets, but its largest component never meets itself.
4. In a block the sets are stored in a trie with shared prefixes. Each probing set
   walks it with the overlap so far; a subtree is pruned when the sizes in it, or
   the overlap so far and what remains of both sides, can't reach the threshold.
   Pairs already connected are not tested, and only links that connect are kept:
   never more rows than members.
5. ``counted``: all links lie within components, so the classes of one are joined once more,
   in chunks of a size class and its neighbours: a chunk's sets walk the other's trie together, sharing nodes and pruned as in step 4.
   Links are weighted by copies and counted, not emitted. A component of two classes is one link.

So no link that connects two components is lost, and no block's pairs are emitted.
Steps 1 to 4 alone give connectivity, not the links within a component.
Prefix shingles of frequent ones are salted in the shuffle. The list of frequent
shingles that is broadcast is a bit map of fixed size; where bits collide, shingles
only come later in the order, which costs time, not links.

Null texts are empty. Rows that repeat an id or a text are in one class. A null id
counts as smallest and is null in the result. An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import distinct, hashed_rows, keyed, mapped, mixed, unkeyed, with_text_key, written
from .components import Forest, connected

WORDS, SHARE = 5, (80, 100)
#: Frequent shingles: of at least so many rows, as bits of a map of 2^HOT_BITS (8 MB), whatever their number.
HOT_DF, HOT_RUN, HOT_BITS, HOT_PIECE = 3, 3, 26, 16
SEEDS = 3
#: Members of a chunk that is joined in one go, and of one with a common smallest class.
CHUNK, STAR = 1000, 256
SALTS = 64
#: Shingles of a chunk in which links are counted.
COUNT_SHINGLES = 2_000_000


def signatures(rows: DataFrame) -> DataFrame:
    """Of rows (_id, text, _t): n, h1, h2, mins of each set, and rows (tok, cnt) of shingles that repeat in a batch."""

    def each(batch):
        ids, n, h1, h2, mins, every = [], [], [], [], [], []
        for i, (_, sh) in zip(batch.column(0).to_pylist(), hashed_rows(batch.column(1)), strict=True):
            u = distinct(sh)
            ids.append(i)
            n.append(len(u))
            h1.append(_signed(u.sum()) if len(u) else 0)
            h2.append(_signed(mixed(u ^ np.uint64(77)).sum()) if len(u) else 0)
            mins.append([_signed(mixed(u ^ np.uint64(s)).min()) for s in range(1, SEEDS + 1)] if len(u) else None)
            every.append(u)
        tok, cnt = np.unique(np.concatenate(every), return_counts=True) if every else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
        tok, cnt = tok[cnt > 1], cnt[cnt > 1]
        pad = lambda x: x + [None] * len(tok)
        return {"_id": pad(ids), "n": pad(n), "h1": pad(h1), "h2": pad(h2), "mins": pad(mins), "_t": pad(batch.column(2).to_pylist()), "tok": pa.array([None] * len(ids) + tok.view(np.int64).tolist(), pa.int64()), "cnt": pa.array([None] * len(ids) + cnt.tolist(), pa.int64())}

    return mapped(rows, each, "_id long, _t long, n long, h1 long, h2 long, mins array<long>, tok long, cnt long", rows=10_000)


def _signed(x) -> int:
    return int(np.uint64(x).astype(np.int64))


def marked(u: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """Whether the hashes u have their bit in a map of bit_map()."""
    slot = u >> np.uint64(64 - HOT_BITS)
    return (bits[(slot >> np.uint64(3)).astype(np.int64)] >> (slot & np.uint64(7)).astype(np.uint8) & 1).astype(bool)


def ordered(u: np.ndarray, hot: np.ndarray, first: int | None = None) -> np.ndarray:
    """The first order keys of a sorted set, or all: the top bit says that a shingle is frequent, the others are its hash."""
    out, often = u >> np.uint64(1), marked(u, hot)
    return np.concatenate([out[~often], out[often] | np.uint64(1 << 63)])[:first]


def frequent(counts: DataFrame) -> np.ndarray:
    """The bit map of the frequent shingles of (tok, cnt). A bit that another shingle shares makes it count as
    frequent everywhere alike, so the order stays global; the map's pieces are made where the shingles are."""
    return bit_map(counts.groupBy("tok").agg(F.sum("cnt").alias("cnt")).where(F.col("cnt") >= HOT_DF).select("tok"))


def bit_map(hashes: DataFrame) -> np.ndarray:
    """The bits of a column of 64-bit hashes in a map of 2^HOT_BITS, of one size for any number of them."""
    slot = F.shiftrightunsigned(F.col(hashes.columns[0]), 64 - HOT_BITS)
    often = hashes.select(F.shiftright(slot, HOT_PIECE).cast("int").alias("piece"), (slot % (1 << HOT_PIECE)).cast("int").alias("bit"))

    def pieces(batches):
        maps: dict[int, np.ndarray] = {}
        for batch in batches:
            piece, bit = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for p in np.unique(piece).tolist():
                maps.setdefault(p, np.zeros(1 << HOT_PIECE, bool))[bit[piece == p]] = True
        yield pa.RecordBatch.from_arrays([pa.array(list(maps), pa.int32()), pa.array([np.packbits(x, bitorder="little").tobytes() for x in maps.values()], pa.binary())], names=["piece", "bits"])

    out = np.zeros(1 << (HOT_BITS - 3), np.uint8)
    size = 1 << (HOT_PIECE - 3)
    made = often.repartition("piece").mapInArrow(pieces, "piece int, bits binary").toArrow()
    for p, bits in zip(made["piece"].to_pylist(), made["bits"].to_pylist(), strict=True):
        out[p * size : (p + 1) * size] |= np.frombuffer(bits, np.uint8)
    return out


_MET = "tok long, z int, h1 long, n int, home boolean, least int, most int, counts int"


def _met(batches):
    """Of rows (tok, h1, n) sorted by tok: blocks (tok, z) of a size class with the class below as visitors, where several
    classes meet and one is at home; least and most are the sizes there, and counts is 1 once for each class and shingle.

    Rows of frequent shingles are salted, so theirs are all given, with sizes of a part only, and count twice at most."""
    held = None

    def chosen(tok, h1, n):
        order = np.lexsort((h1, tok))
        tok, h1, n = (x[order] for x in (tok, h1, n))
        one = np.r_[True, (tok[1:] != tok[:-1]) | (h1[1:] != h1[:-1])][: len(tok)]  # copies of a text are one class
        tok, h1, n = (x[one] for x in (tok, h1, n))
        z = _size_class_of(n)
        tok, h1, n, z = (np.r_[x, x] for x in (tok, h1, n, z))
        rows = len(z) // 2
        home = np.arange(2 * rows) < rows
        z = z + ~home
        order = np.lexsort((z, tok))
        start = np.flatnonzero(np.r_[True, (tok[order][1:] != tok[order][:-1]) | (z[order][1:] != z[order][:-1])]) if rows else np.zeros(0, np.int64)
        run = np.diff(np.r_[start, 2 * rows])
        over = lambda f, x: np.repeat(f.reduceat(x[order], start), run) if rows else x
        ok = np.empty(2 * rows, bool)
        least, most = np.empty(2 * rows, np.int64), np.empty(2 * rows, np.int64)
        ok[order] = ((over(np.minimum, h1) != over(np.maximum, h1)) & over(np.maximum, home.astype(np.int8)).astype(bool)) if rows else ok
        least[order], most[order] = over(np.minimum, n), over(np.maximum, n)
        ok |= tok < 0
        counts = home | (tok < 0) | (ok & ~np.r_[np.zeros(rows, bool), ok[:rows]])
        cols = (tok, z.astype(np.int32), h1, n.astype(np.int32), home, least.astype(np.int32), most.astype(np.int32), counts.astype(np.int32))
        return pa.RecordBatch.from_arrays([pa.array(x[ok]) for x in cols], names=["tok", "z", "h1", "n", "home", "least", "most", "counts"])

    for batch in batches:
        cols = [batch.column(k).to_numpy() for k in range(3)]
        if held is not None:
            cols = [np.concatenate(x) for x in zip(held, cols, strict=True)]
        tok = cols[0]
        done = int(np.searchsorted(tok, tok[-1])) if len(tok) and tok[-1] >= 0 else len(tok)
        held = [x[done:] for x in cols]
        yield chosen(*(x[:done] for x in cols))
    if held is not None:
        yield chosen(*held)


def prefix_len(n: int, share: tuple[int, int]) -> int:
    return n - -(-share[0] * n // share[1]) + 1


class _Node:
    __slots__ = ("seg", "kids", "ends", "low", "high")

    def __init__(self, seg, size):
        self.seg, self.kids, self.ends, self.low, self.high = seg, {}, [], size, size


class Trie:
    """A prefix tree of ordered sets; a node holds the run of shingles up to the next branch."""

    def __init__(self, share: tuple[int, int]):
        self.root, self.share = _Node(np.zeros(0, np.uint64), 0), share
        self.root.low = 1 << 60

    def add(self, member: int, s: np.ndarray) -> None:
        node, at, size = self.root, 0, len(s)
        while True:
            node.low, node.high = min(node.low, size), max(node.high, size)
            if at == size:
                node.ends.append(member)
                return
            kid = node.kids.get(int(s[at]))
            if kid is None:
                kid = node.kids[int(s[at])] = _Node(s[at:], size)
                kid.ends.append(member)
                return
            m = min(len(kid.seg), size - at)
            differ = np.flatnonzero(kid.seg[:m] != s[at : at + m])
            same = int(differ[0]) if len(differ) else m
            if same < len(kid.seg):  # branch within the run
                upper = _Node(kid.seg[:same], size)
                upper.low, upper.high = kid.low, kid.high
                upper.kids[int(kid.seg[same])] = kid
                kid.seg = kid.seg[same:]
                node.kids[int(s[at])] = kid = upper
            node, at = kid, at + same

    def probe(self, s: np.ndarray, found) -> None:
        """Calls found(member) for each stored set linked with s, until it says False."""
        num, den = self.share
        size = len(s)
        stack = [(kid, 0, 0) for kid in self.root.kids.values()]
        while stack:
            node, overlap, depth = stack.pop()
            if den * node.high < num * size or num * node.low > den * size:
                continue
            seg = node.seg
            depth += len(seg)
            at = np.searchsorted(s, seg)
            overlap += int((s[np.minimum(at, size - 1)] == seg).sum())
            rest = min(size - int(np.searchsorted(s, seg[-1], "right")), node.high - depth)
            least = -(-num * (size + max(node.low, -(-num * size // den))) // (num + den))
            if overlap + rest < least:
                continue
            if node.ends and (num + den) * overlap >= num * (size + depth):
                for member in node.ends:
                    if not found(member):
                        return
            stack.extend((kid, overlap, depth) for kid in node.kids.values())


def links(sets: list[np.ndarray], labels: list[int], share: tuple[int, int]) -> list[tuple[int, int]]:
    """Links that connect members of different labels; enough of them for all connections there are."""
    groups: dict[int, list[int]] = {}
    for k, label in enumerate(labels):
        groups.setdefault(label, []).append(k)
    forest, out, trie = Forest(len(sets)), [], Trie(share)
    for group in groups.values():
        for k in group[1:]:
            forest.join(group[0], k)
    stored = 0
    for turn, group in enumerate(sorted(groups.values(), key=len, reverse=True)):
        if turn:
            stored += 1  # labels stored before this one
            for k in group:

                def found(other, k=k):
                    if forest.join(k, other):
                        out.append((k, other))
                    return forest.trees > len(groups) - stored

                if forest.trees <= len(groups) - stored:
                    break  # all stored labels are one tree with this one
                trie.probe(sets[k], found)
        for k in group:
            trie.add(k, sets[k])
    return out


def _joined_units(units: DataFrame, share: tuple[int, int]) -> DataFrame:
    """Trie join of each unit; units (u, h1, comp, s) -> links (a, b). A unit's rows stand together in a partition."""
    dealt = units.repartition("u").sortWithinPartitions("u")

    def run(batches):
        held: list = []
        schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

        def done():
            one = {h: (c, s) for h, c, s in held}  # a class may be a member twice
            ids = list(one)
            got = links([np.frombuffer(one[h][1], np.uint64) for h in ids], [one[h][0] for h in ids], share)
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array([ids[x[k]] for x in got], pa.int64()) for k in (0, 1)], schema=schema)

        last = None
        for batch in batches:
            u = batch.column(0).to_numpy()
            for k, (h, c, s) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)):
                if u[k] != last:
                    if len(held) > 1:
                        yield done()
                    held.clear()
                    last = u[k]
                held.append((h, c, s))
        if len(held) > 1:
            yield done()

    return dealt.mapInArrow(run, "a long, b long").where("a <> b").distinct()


def _with_sets(rows: DataFrame, members: DataFrame, hot, sent: list, *cols: str) -> DataFrame:
    """Members (u, h1, rep, rep_t, cols) of units as (u, h1, cols, s), s being the ordered set of row rep's text.
    What is broadcast for it joins sent.

    Only rows that a bit map of the members' ids lets through are shuffled, as text, which is shorter than its set."""
    members = written(members, "members")
    spark = rows.sparkSession
    bits = spark.sparkContext.broadcast(bit_map(members.select(F.xxhash64("rep", "rep_t"))))
    sent.append(bits)

    kinds = ", ".join(f"{c} {members.schema[c].dataType.simpleString()}" for c in cols)

    def those(batches):
        seen: set[tuple[int, int]] = set()  # a row that repeats id and text is one
        for batch in batches:
            at = np.flatnonzero(marked(batch.column(3).to_numpy().view(np.uint64), bits.value))
            pairs = zip(batch.column(0).to_numpy()[at].tolist(), batch.column(2).to_numpy()[at].tolist(), strict=True)
            new = [k for k, pair in zip(at.tolist(), pairs, strict=True) if not (pair in seen or seen.add(pair))]
            yield batch.take(pa.array(new, pa.int64())).select([0, 1, 2])

    some = rows.select("_id", "text", "_t", F.xxhash64("_id", "_t").alias("h")).mapInArrow(those, "_id long, text string, _t long")

    def with_set(batch):
        h1, out = batch.column("h1").to_numpy(), []
        for h, (_, sh) in zip(h1.tolist(), hashed_rows(batch.column("text")), strict=True):
            s = distinct(sh)
            out.append(ordered(s, hot.value).tobytes() if len(s) and _signed(s.sum()) == h else None)
        return {"u": batch.column("u"), "h1": h1, "s": pa.array(out, pa.binary())} | {c: batch.column(c) for c in cols}

    # A class may be a member of many units.
    met = some.join(members.withColumnsRenamed({"rep": "_id", "rep_t": "_t"}).hint("merge"), ["_id", "_t"]).select("text", "u", "h1", *cols)
    return mapped(met, with_set, f"u long, h1 long, {kinds}, s binary").where("s is not null")


#: Sizes in a link are at most 1.25 apart, so they are of one size class or of neighbours.
_RATIO = float(np.log(1.26))


def _size_class(n):
    return F.floor(F.log(n) / F.lit(_RATIO)).cast("int")


def _size_class_of(n: np.ndarray) -> np.ndarray:
    return np.floor(np.log(n) / _RATIO).astype(np.int64)


def _needed(share: tuple[int, int]):
    """How many of its prefix shingles a set of n must share to link with one of the sizes least..most of its block.

    Sets that overlap in c prefix shingles overlap in at most c + max(0.8 n, 0.8 m) and must in (n + m) 4/9.
    What that leaves for c rises with m up to n and falls from there, so the ends of the sizes decide."""
    num, den = (float(x) for x in share)
    n = F.col("n").cast("double")
    at = lambda m: num * (n + m) / (num + den) - num / den * F.greatest(n, m)
    return F.least(at(F.greatest(F.col("least").cast("double"), num / den * n)), at(F.least(F.col("most").cast("double"), den / num * n)))


def _prefixes(rows: DataFrame, hot, share: tuple[int, int], *cols: str) -> DataFrame:
    """(tok, h1, and n if it is asked for): the prefix of each set, dealt by shingle (frequent ones salted) and sorted."""

    def prefixes(batch):
        toks, hs, ns = [], [], []
        for _, sh in hashed_rows(batch.column(0)):
            u = distinct(sh)
            if len(u):
                p = prefix_len(len(u), share)
                toks.append(ordered(u, hot.value, p))
                hs.append(np.full(p, u.sum()))
                ns.append(np.full(p, len(u), np.int32))
        return {"tok": np.concatenate(toks), "h1": np.concatenate(hs), "n": np.concatenate(ns)} if toks else None

    first = mapped(rows.select("text"), prefixes, "tok long, h1 long" + ", n int" * ("n" in cols))
    return first.repartition("tok", F.when(F.col("tok") < 0, F.pmod("h1", F.lit(SALTS))).otherwise(0)).sortWithinPartitions("tok")


def _common(batches):
    """Of rows (tok, h1, n) sorted by tok: (tok, cnt) of shingles not yet known as frequent that HOT_RUN classes hold; tok as a hash again."""
    held = None

    def chosen(tok, h1):
        order = np.lexsort((h1, tok))
        tok, h1 = tok[order], h1[order]
        new = np.r_[True, tok[1:] != tok[:-1]][: len(tok)]
        own = new | np.r_[True, h1[1:] != h1[:-1]][: len(tok)]
        start = np.flatnonzero(new)
        cnt = np.add.reduceat(own.astype(np.int64), start) if len(start) else start
        keep = (cnt >= HOT_RUN) & (tok[start] >= 0)
        return pa.RecordBatch.from_arrays([pa.array(tok[start][keep] << 1), pa.array(cnt[keep])], names=["tok", "cnt"])

    for batch in batches:
        cols = [batch.column(k).to_numpy() for k in range(2)]
        if held is not None:
            cols = [np.concatenate(x) for x in zip(held, cols, strict=True)]
        tok = cols[0]
        done = int(np.searchsorted(tok, tok[-1])) if len(tok) and tok[-1] >= 0 else len(tok)
        held = [x[done:] for x in cols]
        yield chosen(*(x[:done] for x in cols))
    if held is not None:
        yield chosen(*held)


def link_counts(sets: list[np.ndarray], copies: np.ndarray, side: np.ndarray, share: tuple[int, int]) -> np.ndarray:
    """How many rows each set links with: all others where side is 0, those of side 2 and 1 for sides 1 and 2.

    All sets of one side walk the trie of the other's together, each node once with those that can still reach the threshold below it."""
    num, den = share
    size = np.array([len(s) for s in sets])
    asking, stored = (np.flatnonzero(side != x) for x in (2, 1))
    out = np.zeros(len(sets), np.int64)
    if not len(asking) or not len(stored):
        return out
    trie = Trie(share)
    for k in stored.tolist():
        trie.add(k, sets[k])
    # Which asking sets hold a shingle: theirs stand together.
    flat, owner = np.concatenate([sets[k] for k in asking]), np.repeat(asking, size[asking])
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    stack = [(kid, asking, np.zeros(len(asking), np.int64), 0) for kid in trie.root.kids.values()]
    while stack:
        node, who, overlap, depth = stack.pop()
        depth += len(node.seg)
        fit = (den * node.high >= num * size[who]) & (num * node.low <= den * size[who])
        who, overlap = who[fit], overlap[fit]
        lo, hi = np.searchsorted(flat, node.seg), np.searchsorted(flat, node.seg, "right")
        held = np.repeat(lo - np.r_[0, np.cumsum(hi - lo)[:-1]], hi - lo) + np.arange(int((hi - lo).sum()))
        overlap = overlap + np.bincount(owner[held], minlength=len(sets))[who]
        least = -(-num * (size[who] + np.maximum(node.low, -(-num * size[who] // den))) // (num + den))
        fit = overlap + np.minimum(node.high - depth, size[who] - overlap) >= least
        who, overlap = who[fit], overlap[fit]
        if not len(who):
            continue
        if node.ends:
            linked = who[(num + den) * overlap >= num * (size[who] + depth)]
            for member in node.ends:
                others = linked[linked != member]
                out[others] += copies[member]
                if side.any():
                    out[member] += copies[others].sum()
        stack.extend((kid, who, overlap, depth) for kid in node.kids.values())
    return out


def _link_counts(named: DataFrame, rows: DataFrame, hot, sent: list, share: tuple[int, int]) -> DataFrame:
    """(h1, links): of classes (h1, n, copies, comp), how many rows of other classes each links with."""
    size = named.groupBy("comp").agg(F.count("*").alias("c"), F.sum("copies").alias("rows"), F.sum("n").alias("shingles")).where("c > 1")
    own = named.join(size, "comp")
    two = own.where("c = 2").select("h1", (F.col("rows") - F.col("copies")).alias("links"))
    small = (F.col("c") <= CHUNK) & (F.col("shingles") <= COUNT_SHINGLES)
    own = own.where("c > 2").select("comp", "h1", "rep", "rep_t", "copies", "n", F.when(small, -2).otherwise(_size_class("n")).alias("z"))
    parts = F.greatest(F.ceil(F.count("*") / CHUNK), F.ceil(F.sum("n") / COUNT_SHINGLES)).cast("long")
    per = written(own.groupBy("comp", "z").agg(parts.alias("parts")), "link-chunks")
    own = own.join(per, ["comp", "z"]).withColumn("i", F.pmod(F.xxhash64("h1"), F.col("parts")))
    other = per.select("comp", F.col("z").alias("z2"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("i2"))
    met = own.withColumn("z2", F.explode(F.when(F.col("z") == -2, F.array("z")).otherwise(F.array(F.col("z") - 1, "z", F.col("z") + 1)))).join(other, ["comp", "z2"])
    here, there = F.struct(F.col("z").alias("z"), F.col("i").alias("i")), F.struct(F.col("z2").alias("z"), F.col("i2").alias("i"))
    side = F.when(here == there, 0).when(here < there, 1).otherwise(2).cast("int")
    met = met.select(F.xxhash64("comp", F.least(here, there), F.greatest(here, there)).alias("u"), "h1", "rep", "rep_t", "copies", side.alias("side"))
    dealt = _with_sets(rows, met, hot, sent, "copies", "side").repartition("u").sortWithinPartitions("u")

    def run(batches):
        held: list = []

        def done():
            one = {h: (c, k, s) for h, c, k, s in held}
            hs = np.array(list(one), np.int64)
            copies, side = (np.array([x[k] for x in one.values()], np.int64) for k in (0, 1))
            links = link_counts([np.frombuffer(x[2], np.uint64) for x in one.values()], copies, side, share)
            return pa.RecordBatch.from_arrays([pa.array(hs[links > 0]), pa.array(links[links > 0])], names=["h1", "links"])

        last = None
        for batch in batches:
            u = batch.column(0).to_numpy()
            for k, row in enumerate(zip(*(batch.column(c).to_pylist() for c in range(1, 5)), strict=True)):
                if u[k] != last:
                    if len(held) > 1:
                        yield done()
                    held.clear()
                    last = u[k]
                held.append(row)
        if len(held) > 1:
            yield done()

    found = two.unionByName(dealt.mapInArrow(run, "h1 long, links long"))
    return written(found, "link-counts").groupBy("h1").agg(F.sum("links").alias("links"))


def jaccard_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", share: tuple[int, int] = SHARE, counted: bool = False) -> DataFrame:
    """(_id, n_shingles, class_id, component_id): one row a row of docs; ids of the smallest document in each.

    counted: also n_links, with how many other rows of docs the row links, copies included.

    share must be 80% at least: the size classes of step 3 rest on it."""
    assert share[0] * 100 >= 80 * share[1]
    spark = docs.sparkSession
    rows = with_text_key(keyed(docs, id_col, text=text_col))
    sig = written(signatures(rows), "sets")
    hot = frequent(sig.where("tok is not null").select("tok", "cnt"))
    owned = sig.where("tok is null")
    classes = written(owned.where("n > 0").groupBy("h1", "h2", "n").agg(F.min(F.struct("_id", "_t")).alias("rep"), F.count("*").alias("copies"), F.first("mins").alias("mins")).withColumns({"rep_t": F.col("rep._t"), "rep": F.col("rep._id")}), "classes")

    rep = classes.select("h1", "rep", "rep_t")

    # Shingles spread so thinly that no batch holds two show as long runs among the prefixes: they too go last.
    first_hot = spark.sparkContext.broadcast(hot)
    first = _prefixes(rows, first_hot, share)
    hot |= frequent(first.mapInArrow(_common, "tok long, cnt long"))
    first_hot.destroy()
    shared_hot = spark.sparkContext.broadcast(hot)
    sent = [shared_hot]
    first = _prefixes(rows, shared_hot, share, "n")
    met = written(first.mapInArrow(_met, _MET), "prefixes")
    often = met.where("tok < 0").drop("least", "most")
    sizes = often.groupBy("tok", "z").agg(F.min("h1").alias("lo"), F.max("h1").alias("hi"), F.max("home").alias("any"), F.min("n").alias("least"), F.max("n").alias("most")).where("lo <> hi and any")
    met = met.where("tok >= 0").unionByName(often.join(sizes.drop("lo", "hi", "any"), ["tok", "z"]))
    many = met.groupBy("h1").agg(F.sum("counts").alias("many"))
    met = met.join(many, "h1").where(F.col("many") >= _needed(share)).select("tok", "z", "h1").distinct()
    able = met.groupBy("tok", "z").agg(F.min("h1").alias("lo"), F.max("h1").alias("hi")).where("lo <> hi").select("tok", "z")
    met = written(met.join(able, ["tok", "z"]), "prefix-blocks")

    # Blocks of equal MinHash values, chunks of them around the smallest class.
    pairs = F.array(*[F.xxhash64(F.lit(a), F.element_at("mins", a), F.lit(b), F.element_at("mins", b), _size_class("n")) for a in range(1, SEEDS + 1) for b in range(1, a)])
    star = classes.select("h1", F.posexplode(pairs).alias("k", "m")).distinct()
    group = star.groupBy("k", "m").agg(F.min("h1").alias("hub"), F.max("h1").alias("hi"), F.count("*").alias("c")).where("c > 1")
    star = star.join(group, ["k", "m"]).withColumn("chunk", F.pmod(F.xxhash64("h1"), F.ceil(F.col("c") / STAR)))
    u = F.xxhash64("hub", "hi", "chunk").alias("u")  # blocks with the same ends are one
    star = written(star.select(u, "h1").union(star.select(u, F.col("hub").alias("h1"))).distinct(), "star-blocks")

    near = _joined_units(_with_sets(rows, star.join(rep, "h1").withColumn("comp", F.col("h1")), shared_hot, sent, "comp"), share)
    near = written(near, "near-links")
    sent.pop().destroy()
    comp = connected(near)

    met = met.join(comp, met["h1"] == comp["node"], "left").select("tok", "z", "h1", F.coalesce("comp", "h1").alias("comp"))
    block = met.groupBy("tok", "z").agg(F.min("h1").alias("lo"), F.max("h1").alias("hi"), F.min("comp").alias("c0"), F.max("comp").alias("c1")).where("c0 <> c1").select("tok", "z", "lo", "hi")
    member = met.join(block, ["tok", "z"]).select("lo", "hi", "h1", "comp").distinct()  # blocks with the same ends are one
    per = member.groupBy("lo", "hi", "comp").agg(F.count("*").alias("c"))
    per = per.groupBy("lo", "hi").agg(F.sum("c").alias("c"), F.max(F.struct("c", "comp")).alias("top"))
    per = per.select("lo", "hi", F.col("top.comp").alias("top"), F.ceil(F.col("top.c") / CHUNK).alias("nt"), F.ceil((F.col("c") - F.col("top.c")) / CHUNK).alias("nr"))
    member = member.join(per, ["lo", "hi"])
    is_top, h = F.col("comp") == F.col("top"), F.xxhash64("h1")
    # Chunks t of the largest component meet each chunk r of the rest; chunks of the rest meet each other.
    t, r = F.pmod(h, F.col("nt")), F.pmod(h, F.col("nr"))
    others = F.sequence(F.lit(0).cast("long"), F.col("nr") - 1)
    tops = F.sequence(F.lit(0).cast("long"), F.col("nt") - 1)
    pair = lambda kind, a, b: F.struct(F.lit(kind).alias("kind"), a.cast("long").alias("a"), b.cast("long").alias("b"))
    as_top = F.transform(others, lambda x: pair(0, t, x))
    as_rest = F.concat(F.transform(tops, lambda x: pair(0, x, r)), F.when(F.col("nr") > 1, F.transform(others, lambda x: pair(1, F.least(x, r), F.greatest(x, r)))).otherwise(F.array().cast("array<struct<kind:int,a:bigint,b:bigint>>")))
    member = member.withColumn("p", F.explode(F.when(is_top, as_top).otherwise(as_rest)))
    units = written(member.select(F.xxhash64("lo", "hi", "p.kind", "p.a", "p.b").alias("u"), "h1", "comp").distinct(), "trie-blocks")
    far = written(_joined_units(_with_sets(rows, units.join(rep, "h1"), shared_hot, sent, "comp"), share), "far-links")
    sent.pop().destroy()

    comp = connected(near.union(far))
    named = classes.join(comp, classes["h1"] == comp["node"], "left").select("h1", "h2", "n", "rep", "rep_t", "copies", F.coalesce("comp", "h1").alias("comp"))
    links = _link_counts(named := written(named, "components"), rows, shared_hot, sent, share) if counted else None
    for x in sent:  # all that used them is written
        x.destroy()
    least = named.groupBy("comp").agg(F.min("rep").alias("component_id"))
    named = named.join(least, "comp")
    more = []
    if counted:
        named = named.join(links, "h1", "left").withColumn("n_links", F.coalesce("links", F.lit(0)) + F.col("copies") - 1)
        more = [F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links")]
    named = named.select("h1", "h2", "n", F.col("rep").alias("class_id"), "component_id", *(["n_links"] if counted else []))
    out = owned.select("_id", "n", "h1", "h2").join(named, ["h1", "h2", "n"], "left")
    return out.select("_id", F.col("n").alias("n_shingles"), F.coalesce("class_id", "_id").alias("class_id"), F.coalesce("component_id", "_id").alias("component_id"), *more)


def op6_trie_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = jaccard_classes(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select(unkeyed().alias("doc_id"), "n_shingles", unkeyed("component_id").alias("component_id"))


def op6_join_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = jaccard_classes(spark.read.parquet(f"{sf_dir}/documents.parquet"), counted=True)
    return out.select(unkeyed().alias("doc_id"), "n_shingles", "n_links", unkeyed("component_id").alias("component_id"))


from .decontaminate import _SHINGLES, _WORDS  # noqa: E402

ORACLE = f"""
WITH RECURSIVE d AS (SELECT doc_id, {_SHINGLES} AS l FROM (SELECT doc_id, {_WORDS} AS w FROM documents)),
s AS (SELECT doc_id, len(l) AS n, unnest(l) AS s FROM d),
p AS (SELECT a.doc_id AS a, b.doc_id AS b FROM s a JOIN s b USING (s) WHERE a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id, a.n, b.n
  HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
r(doc_id, c) AS (SELECT doc_id, doc_id FROM d UNION SELECT p.b, r.c FROM r JOIN p ON p.a = r.doc_id WHERE r.c < p.b)
SELECT doc_id, len(l) AS n_shingles, c AS component_id FROM d JOIN (SELECT doc_id, min(c) AS c FROM r GROUP BY doc_id) USING (doc_id)
"""

#: The same join with each document's number of links.
LINKS_ORACLE = f"""
WITH d AS (SELECT doc_id, {_SHINGLES} AS l FROM (SELECT doc_id, {_WORDS} AS w FROM documents)),
s AS (SELECT doc_id, len(l) AS n, unnest(l) AS s FROM d),
p AS (SELECT a.doc_id AS doc_id, b.doc_id AS b FROM s a JOIN s b USING (s) WHERE a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id, a.n, b.n
  HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
c AS ({ORACLE})
SELECT doc_id, n_shingles, coalesce(k.n, 0) AS n_links, component_id FROM c LEFT JOIN (SELECT doc_id, count(*) AS n FROM p GROUP BY doc_id) k USING (doc_id)
"""
