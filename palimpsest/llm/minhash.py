"""Near-duplicate groups by a signature-coordinate inverted join, confirmed on full sets.

1. Each text's set of distinct word shingles gets a signature of `coords` minima; equal
   sets collapse to one class, whose representative is its smallest doc_id.
2. Representatives are posted under every coordinate-value pair.  Pairs that occur once
   can match nobody, so a representative with fewer than `least` shared pairs is done.
   Of the others, the rarest (shared - least + 1) pairs are the prefix: two signatures
   that agree in `least` coordinates share a prefix pair, so every match stands in some
   prefix posting list.
3. Posting lists are merged with skipping, in rounds.  A round picks a pivot of each list
   and tries the list's other members against it: collisions of the two signatures are
   counted over all coordinates, those of `least` or more are retained, and what is
   retained is confirmed by exact intersection size on full sets.  Confirmed links join
   cores; a list whose members are all in one core needs nothing more and is skipped, and
   so are pairs inside a core.  A pivot that was tried against its whole list leaves it.
   A round emits at most a row a posting, never the pairs of a list.
4. Lists that stay open while rounds link nothing or hardly shrink them hold texts that
   share much but not enough.  They are finished exactly: cut into blocks of bounded size, pairs
   of blocks are compared inside tasks (blocks of one core are not), and links that join
   two cores, not pairs, leave a task.
5. Components of the confirmed links give the groups.

`least` is set so that a pair of similarity 0.8 is missed with probability under 1e-5
(binomial tail of 64 coordinates at 0.8: P(X < 36) = 4e-6).

Defined results: null and empty texts, and texts without words, have no shingles and are
linked with nothing; rows with fewer words than a shingle have their whole sequence as
the one shingle; ties go to the smallest doc_id; repeated doc_ids give one row each and
fall into the same class if their texts agree; a null doc_id is kept, never leads a
class that has another id, and is its own component if alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.common import as_text, components, dropped, saved, shared_dir
from palimpsest.llm.textkernel import Slab, gram_hash, mix, separators, slabs

COORDS, LEAST = 64, 36
BLOCK = 1024
SETS = "row long, doc_id long, n_shingles long, set_a long, set_b long, sig array<int>"


def shingle_sets(slab: Slab, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct shingle hashes of all rows, bounds by row)."""
    grams = gram_hash(slab.hash, k)
    n = slab.n_words
    whole = np.flatnonzero((n > 0) & (n < k))
    row = slab.row_of_word()
    at = np.arange(len(grams))
    at = at[row[at] == row[at + k - 1]] if len(at) else at
    rows, values = row[at], grams[at]
    if len(whole):
        short = [gram_hash(slab.hash[slab.word_lo[r] : slab.word_lo[r + 1]], int(n[r]))[0] ^ np.uint64(n[r]) for r in whole]
        rows, values = np.concatenate([rows, whole]), np.concatenate([values, np.array(short, np.uint64)])
    order = np.lexsort((values, rows))
    rows, values = rows[order], values[order]
    new = np.ones(len(rows), bool)
    new[1:] = (rows[1:] != rows[:-1]) | (values[1:] != values[:-1])
    rows, values = rows[new], values[new]
    return values, np.searchsorted(rows, np.arange(slab.n_rows + 1))


_A = mix(np.arange(1, COORDS + 1, dtype=np.uint64)) | np.uint64(1)
_B = mix(np.arange(1001, COORDS + 1001, dtype=np.uint64))


def signatures(values: np.ndarray, lo: np.ndarray) -> np.ndarray:
    """Rows x coordinates, 32-bit; rows without shingles are zero."""
    full = np.flatnonzero(np.diff(lo) > 0)
    sig = np.zeros((len(lo) - 1, COORDS), np.uint32)
    if len(full):
        for j in range(COORDS):
            sig[full, j] = np.minimum.reduceat((values ^ _B[j]) * _A[j], lo[full]) >> np.uint64(32)
    return sig


def _sets(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sep = separators("space")
        for batch in batches:
            for slab in slabs(batch.column("text"), sep, True):
                values, lo = shingle_sets(slab, k)
                n = np.diff(lo)
                sums = np.zeros((2, len(values) + 1), np.uint64)
                np.cumsum(values, out=sums[0, 1:])
                np.cumsum(mix(values ^ np.uint64(0x5BD1E995)), out=sums[1, 1:])
                keys = (sums[:, lo[1:]] - sums[:, lo[:-1]]).view(np.int64)
                sig = signatures(values, lo).view(np.int32)
                part = slice(slab.first, slab.first + slab.n_rows)
                offsets = pa.array(np.concatenate([[0], np.cumsum(np.where(n > 0, COORDS, 0))]).astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("row")[part], batch.column("doc_id")[part], pa.array(n.astype(np.int64)), pa.array(keys[0]), pa.array(keys[1]), pa.ListArray.from_arrays(offsets, pa.array(sig[n > 0].reshape(-1)))],
                    ["row", "doc_id", "n_shingles", "set_a", "set_b", "sig"],
                )

    return run


def _full_sets(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sep = separators("space")
        for batch in batches:
            for slab in slabs(batch.column("text"), sep, True):
                values, lo = shingle_sets(slab, k)
                part = slice(slab.first, slab.first + slab.n_rows)
                sets = [values[a:b].tobytes() for a, b in zip(lo[:-1], lo[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column("row")[part], pa.array(sets, pa.binary())], ["row", "shingles"])

    return run


class _Joined:
    """Union-find over the members of a task, to skip what is linked already."""

    def __init__(self) -> None:
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        while (y := self.up.setdefault(x, x)) != x:
            self.up[x] = x = self.up.setdefault(y, y)
        return x

    def join(self, x: int, y: int) -> bool:
        x, y = self.root(x), self.root(y)
        self.up[max(x, y)] = min(x, y)
        return x != y


class _Postings:
    """Sorted posting list of some members' values; counts one member's collisions."""

    def __init__(self, members: list[np.ndarray]) -> None:
        self.n = len(members)
        values = np.concatenate(members)
        owner = np.repeat(np.arange(self.n), [len(m) for m in members])
        order = np.argsort(values, kind="stable")
        self.values, self.owner = values[order], owner[order]

    def collisions(self, own: np.ndarray) -> np.ndarray:
        a, b = np.searchsorted(self.values, own, "left"), np.searchsorted(self.values, own, "right")
        n = b - a
        at = np.arange(int(n.sum())) + np.repeat(a - (np.cumsum(n) - n), n)
        return np.bincount(self.owner[at], minlength=self.n)


def _posted(sets: list[np.ndarray]) -> list[np.ndarray]:
    """Coordinate-value pairs of each set's signature."""
    lo = np.concatenate([[0], np.cumsum([len(x) for x in sets])])
    sig = signatures(np.concatenate(sets), lo).astype(np.int64)
    return list(sig + (np.arange(COORDS, dtype=np.int64) << 32))


Member = tuple[int, np.ndarray]  # core, shingles


def block_links(left: list[Member], right: list[Member] | None, percent: int) -> list[tuple[int, int]]:
    """Links that join cores of two blocks (right None: of one).

    Of each member: count coordinate collisions with the other side's posting lists,
    retain those of LEAST or more, skip those whose cores are joined already, and confirm
    the rest by exact overlap of full sets.
    """
    other = left if right is None else right
    if not left or not other:
        return []
    ids, sizes = [r for r, _ in other], np.array([len(s) for _, s in other])
    theirs = _posted([s for _, s in other])
    mine = theirs if right is None else _posted([s for _, s in left])
    by_pair, by_shingle = _Postings(theirs), _Postings([s for _, s in other])
    joined, links = _Joined(), []
    for i, (core, own) in enumerate(left):
        enough = by_pair.collisions(mine[i]) >= LEAST
        if right is None:
            enough[i:] = False
        open_ = [j for j in np.flatnonzero(enough) if joined.root(ids[j]) != joined.root(core)]
        if not open_:
            continue
        common = by_shingle.collisions(own)
        for j in open_:
            if 100 * common[j] >= percent * (len(own) + sizes[j] - common[j]) and joined.join(core, ids[j]):
                links.append((core, ids[j]))
    return links


def _blocks_linked(percent: int):
    def run(key: tuple, groups: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sides: tuple[list, list] = ([], [])
        alone = False
        for batch in groups:
            for core, side, shingles in zip(*(batch.column(c).to_pylist() for c in ("core", "side", "shingles")), strict=True):
                alone |= side == 2
                sides[side == 1].append((core, np.frombuffer(shingles, np.uint64)))
        links = block_links(sides[0], None if alone else sides[1], percent)
        yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in links], pa.int64()), pa.array([y for _, y in links], pa.int64())], ["a", "b"])

    return run


def _overlap(percent: int):
    """Of rows (a, b, set_a, set_b) those of similarity percent or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("set_a"), batch.column("set_b"), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                at = np.minimum(np.searchsorted(y, x), len(y) - 1)
                common = int((y[at] == x).sum())
                keep.append(100 * common >= percent * (len(x) + len(y) - common))
            keep = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(keep), batch.column("b").filter(keep)], ["a", "b"])

    return run


class _Links:
    """Confirmed links found so far and the cores they make."""

    def __init__(self, docs: DataFrame, sigs: DataFrame, members: DataFrame, percent: int, folder: str) -> None:
        self.sigs, self.percent, self.folder = sigs, percent, folder
        self.sets, self.found, self.n = members, docs.sparkSession.createDataFrame([], "a long, b long"), 0
        self.cores = self.found.select(F.col("a").alias("node"), F.col("b").alias("component"))

    def add(self, links: DataFrame) -> None:
        """Takes links (a, b) in; cores are the components of all so far."""
        self.n += 1
        new = saved(links, self.folder, f"links-{self.n}")
        self.found = self.found.union(new)
        self.grew = new.limit(1).count() > 0
        if self.grew:
            self.cores = components(self.found, self.folder, f"cores-{self.n}")

    def tried(self, pairs: DataFrame) -> DataFrame:
        """Those of distinct pairs (a, b) that are similar: retained by collisions of their
        signatures, confirmed on full sets."""
        sig = lambda side: self.sigs.select(F.col("row").alias(side), F.col("sig").alias(f"sig_{side}"))
        equal = F.size(F.filter(F.zip_with("sig_a", "sig_b", lambda x, y: x == y), lambda x: x))
        retained = pairs.join(sig("a"), "a").join(sig("b"), "b").filter(equal >= LEAST).select("a", "b")
        retained = saved(retained, self.folder, f"retained-{self.n + 1}")
        full = lambda side: self.sets.select(F.col("row").alias(side), F.col("shingles").alias(f"set_{side}"))
        pivots = full("b").join(retained.select("b").distinct(), "b", "left_semi")  # few, so most sets are shuffled once
        return retained.join(pivots, "b").join(full("a"), "a").select("a", "b", "set_a", "set_b").mapInArrow(_overlap(self.percent), "a long, b long")

    def with_core(self, rows: DataFrame) -> DataFrame:
        return rows.join(self.cores.select(F.col("node").alias("row"), "component"), "row", "left").withColumn("core", F.coalesce("component", "row")).drop("component")


ROUNDS = 20  # of pivots; what they leave open goes to blocks


def _merged_lists(lists: DataFrame, links: _Links) -> None:
    """Works through posting lists (token, row) until no list has two cores or only blocks can settle it."""
    spark, folder = lists.sparkSession, links.folder
    # First only the likeliest partner of each row: the least member of most of its lists.
    first = saved(lists.groupBy("token").agg(F.min("row").alias("pivot"), F.count("*").alias("n")).filter("n > 1"), folder, "pivots-0")
    tries = lists.join(first, "token").filter("row != pivot").groupBy("row", "pivot").agg(F.count("*").alias("lists"))
    best = tries.groupBy("row").agg(F.min(F.struct(-F.col("lists"), "pivot")).alias("t"))
    links.add(links.tried(best.select(F.col("row").alias("a"), F.col("t.pivot").alias("b"))))
    rest, before = lists, None
    for i in range(1, ROUNDS + 1):
        rest = saved(links.with_core(rest.select("token", "row")), folder, f"lists-{i}")
        order = F.xxhash64("row", F.lit(i))
        pivots = rest.groupBy("token").agg(F.min("core").alias("least"), F.max("core").alias("most"), F.min(F.struct(order, "row", "core")).alias("p"), F.count("*").alias("n")).filter("least < most")
        pivots = saved(pivots.select("token", F.col("p.row").alias("pivot"), F.col("p.core").alias("pivot_core"), "n"), folder, f"pivots-{i}")
        dropped(spark, folder, f"lists-{i - 1}", f"pivots-{i - 1}")
        postings = pivots.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
        if not postings:
            return
        met = rest.join(pivots, "token").filter("row != pivot")
        if before is not None and (not links.grew or postings > 0.7 * before):
            left = saved(rest.join(pivots.select("token"), "token", "left_semi"), folder, "left")
            links.add(_by_blocks(left, links))
            return
        before = postings
        links.add(links.tried(met.filter("core != pivot_core").select(F.col("row").alias("a"), F.col("pivot").alias("b")).distinct()))
        rest = saved(met.select("token", "row"), folder, f"rest-{i}")
        dropped(spark, folder, f"rest-{i - 1}")
    links.add(_by_blocks(saved(links.with_core(rest), folder, "left"), links))


def _by_blocks(lists: DataFrame, links: _Links) -> DataFrame:
    """Links between the cores of each list (token, row, core).

    A core of more than BLOCK members has blocks of its own, the members of the others
    share some; blocks of the same large core are not compared.
    """
    sized = lists.groupBy("token", "core").agg(F.count("*").alias("n"))
    large = sized.filter(F.col("n") > BLOCK).select("token", F.col("core").alias("part"), "n")
    small = sized.filter(F.col("n") <= BLOCK).groupBy("token").agg(F.sum("n").alias("n")).select("token", F.lit(-1).cast("long").alias("part"), "n")
    parts = saved(large.union(small).select("token", "part", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks")), links.folder, "parts")
    named = large.select("token", F.col("part").alias("core"), F.lit(True).alias("is_large"))
    placed = lists.join(saved(named, links.folder, "large"), ["token", "core"], "left").withColumn("part", F.when(F.col("is_large"), F.col("core")).otherwise(F.lit(-1).cast("long")))
    placed = placed.join(parts, ["token", "part"]).withColumn("block", F.pmod(F.xxhash64("row"), F.col("blocks")).cast("int")).select("token", "part", "block", "row", "core")
    a, b = (parts.select("token", F.col("part").alias(f"part_{x}"), F.col("blocks").alias(f"blocks_{x}")) for x in "ab")
    pairs = a.join(b, "token").filter((F.col("part_a") < F.col("part_b")) | (F.col("part_a") == -1) & (F.col("part_b") == -1))  # parts of a list: cores over BLOCK members and the rest
    upto = lambda c: F.sequence(F.lit(0), F.col(c) - 1)
    pairs = pairs.withColumn("block_a", F.explode(upto("blocks_a"))).withColumn("block_b", F.explode(upto("blocks_b")))
    pairs = saved(pairs.filter("part_a < part_b or block_a <= block_b").drop("blocks_a", "blocks_b"), links.folder, "block-pairs")
    key = ["token", "part_a", "block_a", "part_b", "block_b"]
    same = (F.col("part_a") == F.col("part_b")) & (F.col("block_a") == F.col("block_b"))
    sides = []
    for side, x in enumerate("ab"):
        mine = placed.withColumnsRenamed({"part": f"part_{x}", "block": f"block_{x}"})
        met = pairs.join(mine, ["token", f"part_{x}", f"block_{x}"])
        met = met.withColumn("side", F.when(same, F.lit(2)).otherwise(F.lit(side)))
        sides.append((met if side == 0 else met.filter("side < 2")).select(*key, "side", "row", "core"))
    met = sides[0].union(sides[1]).join(links.sets, "row").select(*key, "side", "core", "shingles")
    return met.groupBy(*key).applyInArrow(_blocks_linked(links.percent), "a long, b long")


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, folder: str | None = None) -> DataFrame:
    """Per row of docs: row, doc_id, n_shingles, component_row, component_id.

    docs: row (long, unique, the same at every reading), doc_id, text.  component_row: the row that leads the group,
    of smallest doc_id; a row without shingles leads itself.
    """
    folder = folder or shared_dir(docs.sparkSession)
    docs = docs.select("row", F.col("doc_id").cast("long").alias("doc_id"), as_text().alias("text"))
    sets = saved(docs.mapInArrow(_sets(k), SETS), folder, "sets")
    full = sets.filter("n_shingles > 0")
    lead = F.min(F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "row"))
    classes = full.groupBy("set_a", "set_b").agg(lead.alias("lead"))
    classes = saved(classes.select("set_a", "set_b", F.col("lead.row").alias("rep"), F.col("lead.doc_id").alias("rep_id")), folder, "classes")
    reps = saved(full.join(classes.select(F.col("rep").alias("row")), "row", "left_semi").select("row", "sig"), folder, "reps")
    posts = reps.select("row", F.posexplode("sig").alias("coord", "value"))
    posts = posts.select("row", (F.shiftleft(F.col("coord").cast("long"), 32) + F.col("value")).alias("token"))
    shared = saved(posts.groupBy("token").agg(F.count("*").alias("df")).filter("df > 1"), folder, "shared")
    live = posts.join(shared, "token").groupBy("row").agg(F.count("*").alias("m"), F.sort_array(F.collect_list(F.struct("df", "token"))).alias("tokens"))  # at most 64 a row
    live = live.filter(F.col("m") >= LEAST)
    lists = saved(live.select("row", F.explode(F.slice("tokens", F.lit(1), F.col("m").cast("int") - LEAST + 1)).alias("t")).select(F.col("t.token").alias("token"), "row"), folder, "lists")
    rows = saved(lists.select("row").distinct(), folder, "rows-in-lists")  # a table whose size is known, so that texts are shuffled only where it is too large to broadcast
    sigs = saved(reps.join(rows, "row", "left_semi"), folder, "sigs")
    dropped(docs.sparkSession, folder, "reps", "shared")
    members = docs.select("row", "text").join(rows, "row").mapInArrow(_full_sets(k), "row long, shingles binary")
    links = _Links(docs, sigs, saved(members, folder, "members"), percent, folder)
    _merged_lists(lists, links)
    by_rep = links.cores.select(F.col("node").alias("rep"), "component")
    named = classes.join(by_rep, "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    named = saved(named, folder, "named")
    first = named.groupBy("component").agg(F.min(F.struct(F.col("rep_id").isNull().alias("n"), F.col("rep_id").alias("doc_id"), F.col("rep").alias("row"))).alias("lead"))
    named = named.join(saved(first, folder, "leads"), "component").select("set_a", "set_b", F.col("lead.row").alias("lead_row"), F.col("lead.doc_id").alias("lead_id"))
    dropped(docs.sparkSession, folder, "sigs", "lists", "rows-in-lists", "members", "left", "parts", "large", "block-pairs")
    out = sets.select("row", "doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("set_a")).alias("set_a"), "set_b").join(named, ["set_a", "set_b"], "left")
    return out.select("row", "doc_id", "n_shingles", F.coalesce("lead_row", "row").alias("component_row"), F.when(F.col("lead_row").isNull(), F.col("doc_id")).otherwise(F.col("lead_id")).alias("component_id"))


def duplicate_report(docs: DataFrame, k: int = 4, percent: int = 80) -> DataFrame:
    """Per document: doc_id, n_shingles, component_id, kept."""
    folder = shared_dir(docs.sparkSession)
    rows = saved(docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text"), folder, "rows")  # numbers that no later step draws anew
    out = near_duplicates(rows, k, percent, folder)
    kept = F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("row") == F.col("component_row"))
    return out.select("doc_id", "n_shingles", "component_id", kept.alias("kept"))


def one_of_each(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """docs with one row of each group of near copies: that of smallest doc_id."""
    folder = shared_dir(docs.sparkSession)
    rows = saved(docs.withColumn("_pq_row", F.monotonically_increasing_id()), folder, "rows")
    groups = near_duplicates(rows.select(F.col("_pq_row").alias("row"), "doc_id", "text"), k, percent, folder)
    gone = groups.filter("row != component_row").select(F.col("row").alias("_pq_row"))
    return rows.join(gone, "_pq_row", "left_anti").drop("_pq_row")

