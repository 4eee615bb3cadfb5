"""Content-addressed store of token ids.

Layout of a store folder:
  packs/*.pack   chunk payloads one after another, each zstd over little-endian ids
                 (two bytes an id if the vocabulary allows, else four)
  index/         Parquet: digest, pack, at, size, width - every unique chunk once
  recipes/       Parquet: row, doc_id, n_tokens, digests (16 bytes each), root, part, in order of doc_id
  manifest/      Parquet: part, n_docs, n_tokens, root - Merkle roots over the recipes of each part
  format/        Parquet, one row: bytes of an id, end id

A rolling hash over the last `ROLL` ids cuts a document's id stream where its low bits
are zero, so equal runs of ids give equal chunks wherever they stand.  Writing makes no
shuffle of payloads: a task appends chunks new to it to a pack of its own, the least
place of each digest becomes its owner, and packs are rewritten with owned chunks only.
Pack names are unique to an attempt and count only if a committed row names them, so a
task that is lost and run again leaves nothing wrong behind.  Reading holds the
recipes against the manifest, fetches chunks by ranges of places, checks digests and Merkle
roots, and needs no shuffle of payloads either.

Defined results: a null or empty text is the end id alone; documents come in ascending
doc_id, nulls first, repeated ids in the order of their rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from palimpsest.llm.common import as_text, saved
from palimpsest.llm.textkernel import gram_hash, mix
from palimpsest.llm.token_count import tokenizer
from palimpsest.llm.units import AT_ONCE, PackedUnits, ascii_set, spans, unit_slabs

ROLL, LEAST, MOST, BITS = 8, 64, 4096, 9
DIGEST = 16
SPOOL = "row long, doc_id long, n_tokens long, digests binary, root binary, chunks array<struct<digest:binary,pack:string,at:long,size:int>>"
#: White space beyond ASCII, and controls on which tools differ: texts with these are encoded whole.
ODD_SPACE = "\x1c\x1d\x1e\x1f\x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def filesystem(folder: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder)


def digest(data: bytes) -> bytes:
    return hashlib.blake2b(data, digest_size=DIGEST).digest()


class Merkle:
    """Root over leaves pushed in order, keeping one digest a level."""

    def __init__(self) -> None:
        self.levels: list[bytes | None] = []

    def push(self, leaf: bytes) -> None:
        for i, there in enumerate(self.levels):
            if there is None:
                self.levels[i] = leaf
                return
            self.levels[i], leaf = None, digest(there + leaf)
        self.levels.append(leaf)

    def root(self) -> bytes:
        out = None
        for x in self.levels:
            if x is not None:
                out = x if out is None else digest(x + out)
        return out or digest(b"")


def merkle_root(digests: bytes) -> bytes:
    tree = Merkle()
    for i in range(0, len(digests), DIGEST):
        tree.push(digests[i : i + DIGEST])
    return tree.root()


def cuts(ids: np.ndarray, lo: np.ndarray) -> list[list[int]]:
    """Chunk ends of each document ids[lo[i]:lo[i + 1]], relative to its start."""
    rolled = gram_hash(mix(ids.astype(np.uint64)), ROLL)
    marks = np.flatnonzero(rolled & np.uint64((1 << BITS) - 1) == 0) + ROLL
    out = []
    for a, b in zip(lo[:-1].tolist(), lo[1:].tolist(), strict=True):
        ends, last = [], 0
        for m in (marks[np.searchsorted(marks, a + LEAST) : np.searchsorted(marks, b)] - a).tolist():
            while m - last > MOST:
                last += MOST
                ends.append(last)
            if m - last >= LEAST:
                ends.append(last := m)
        while b - a - last > MOST:
            last += MOST
            ends.append(last)
        out.append([*ends, b - a])
    return out


def _has_odd_space(text: str) -> bool:
    return any(c in text for c in ODD_SPACE)


def _encoded_slabs(tok, column: pa.Array, cache: PackedUnits, kind: np.dtype, end_id: int) -> Iterator[tuple[int, list[bytes]]]:
    """(first row, packed ids of each row with the end id).

    Units start where ASCII white space follows another character, and where an ASCII mark
    follows an ASCII letter or digit or a Latin-1 letter.  No alternative of the pre-tokeniser's pattern
    matches across such a place, unless the character before it is itself white space that
    ASCII lacks, or a special string stands there; such texts are encoded whole.
    """
    end = np.array([end_id], kind).tobytes()
    odd = np.zeros(256, bool)
    odd[[0xC2, 0xE1, 0xE2, 0xE3, *ODD_SPACE[:4].encode()]] = True
    for slab in unit_slabs(column, ascii_set(" \t\n\v\f\r"), cut_marks=True):
        numbers, at, size, which = cache.of(slab)
        ids = numbers[spans(at[which], size[which])].tobytes()
        ends = (np.concatenate([[0], np.cumsum(size[which])])[slab.lo] * kind.itemsize).tolist()
        multi = np.flatnonzero(odd[slab.data])
        special = np.flatnonzero((slab.data[:-1] == ord("<")) & (slab.data[1:] == ord("|")))
        whole = set(np.searchsorted(slab.offsets, special, side="right").tolist())
        doubtful = set(np.searchsorted(slab.offsets, multi, side="right").tolist()) if len(multi) else set()
        rows = []
        for r in range(slab.n_rows):
            if r + 1 in whole or r + 1 in doubtful and _has_odd_space(slab.row(r).decode()):
                rows.append(np.array(tok.encode(slab.row(r).decode(), add_special_tokens=False).ids, kind).tobytes() + end)
            else:
                rows.append(ids[ends[r] : ends[r + 1]] + end)
        yield slab.first, rows


@lru_cache(1)
def _units(path: str, width: int) -> PackedUnits:
    """Of a Python worker, for all its tasks; payloads are little-endian ids."""
    tok, kind = tokenizer(path), np.dtype(f"<u{width}")

    def encode(units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        values, size = [np.zeros(0, kind)], [np.zeros(0, np.int64)]
        for i in range(0, len(units), AT_ONCE):
            found = [x.ids for x in tok.encode_batch_fast(units[i : i + AT_ONCE], add_special_tokens=False)]
            size.append(np.fromiter(map(len, found), np.int64, len(found)))
            values.append(np.fromiter(chain.from_iterable(found), kind, int(size[-1].sum())))
        return np.concatenate(values), np.concatenate(size)

    return PackedUnits(encode, kind)


def _spool(path: str, folder: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        tok, width = tokenizer(path), id_width(path, end_id)
        kind = np.dtype(f"<u{width}")
        cache, squeeze = _units(path, width), zstandard.ZstdCompressor(level=1).compress
        store, top = filesystem(folder)
        name, sink, at, seen = f"{uuid.uuid4().hex}.pack", None, 0, set()
        for batch in batches:
            rows, ids = batch.column("row"), batch.column("doc_id")
            for first, packed in _encoded_slabs(tok, batch.column("text"), cache, kind, end_id):
                lo = np.concatenate([[0], np.cumsum([len(x) // kind.itemsize for x in packed])])
                out: list[tuple] = []
                for data, ends in zip(packed, cuts(np.frombuffer(b"".join(packed), kind), lo), strict=True):
                    own, chunks, s = [], [], 0
                    for e in ends:
                        piece = data[s * kind.itemsize : e * kind.itemsize]
                        own.append(d := digest(piece))
                        if d not in seen:
                            if len(seen) > 1_000_000:  # what is forgotten is stored again, and dropped with the other copies
                                seen = set()
                            seen.add(d)
                            small = squeeze(piece)
                            if sink is None:
                                store.create_dir(f"{top}/stage", recursive=True)
                                sink = store.open_output_stream(f"{top}/stage/{name}")
                            sink.write(small)
                            chunks.append({"digest": d, "pack": name, "at": at, "size": len(small)})
                            at += len(small)
                        s = e
                    own = b"".join(own)
                    out.append((len(data) // kind.itemsize, own, merkle_root(own), chunks))
                part = slice(first, first + len(packed))
                chunk_kind = pa.list_(pa.struct([("digest", pa.binary()), ("pack", pa.string()), ("at", pa.int64()), ("size", pa.int32())]))
                kinds = (pa.int64(), pa.binary(), pa.binary(), chunk_kind)
                yield pa.RecordBatch.from_arrays([rows[part], ids[part], *(pa.array([x[j] for x in out], k) for j, k in enumerate(kinds))], ["row", "doc_id", "n_tokens", "digests", "root", "chunks"])
        if sink is not None:
            sink.close()

    return run


def _compact(folder: str):
    """Copies owned chunks, which come sorted by (pack, at), to a pack of this attempt."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, top = filesystem(folder)
        name, sink, at, open_name, source = f"{uuid.uuid4().hex}.pack", None, 0, None, None
        for batch in batches:
            places = []
            for pack, start, size in zip(*(batch.column(c).to_pylist() for c in ("pack", "at", "size")), strict=True):
                if pack != open_name:
                    source, open_name = store.open_input_file(f"{top}/stage/{pack}"), pack
                if sink is None:
                    store.create_dir(f"{top}/packs", recursive=True)
                    sink = store.open_output_stream(f"{top}/packs/{name}")
                sink.write(source.read_at(size, start))
                places.append(at)
                at += size
            yield pa.RecordBatch.from_arrays([batch.column("digest"), pa.array([name] * len(places)), pa.array(places, pa.int64()), batch.column("size")], ["digest", "pack", "at", "size"])
        if sink is not None:
            sink.close()

    return run


def _roots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of recipes sorted by part a row a part: its documents, their tokens, their Merkle root."""
    part, tree, docs, tokens = None, Merkle(), 0, 0

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([docs], pa.int64()), pa.array([tokens], pa.int64()), pa.array([tree.root()])], ["part", "n_docs", "n_tokens", "root"])

    for batch in batches:
        for p, n, root in zip(*(batch.column(c).to_pylist() for c in ("part", "n_tokens", "root")), strict=True):
            if p != part:
                if docs:
                    yield out()
                part, tree, docs, tokens = p, Merkle(), 0, 0
            tree.push(root)
            docs, tokens = docs + 1, tokens + n
    if docs:
        yield out()


def _part_roots(recipes: DataFrame) -> DataFrame:
    rows = recipes.select("part", "doc_id", "row", "n_tokens", "root").repartition("part").sortWithinPartitions("part", "doc_id", "row")
    return rows.select("part", "n_tokens", "root").mapInArrow(_roots, "part int, n_docs long, n_tokens long, root binary")


def id_width(path: str, end_id: int) -> int:
    """Bytes of an id of this vocabulary."""
    return 2 if max(tokenizer(path).get_vocab_size(), end_id + 1) <= 1 << 16 else 4


def write_store(docs: DataFrame, path: str, folder: str, end_id: int = 2) -> None:
    """Encodes docs (doc_id, text) with the tokenizers file at path into a new store."""
    docs = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), as_text().alias("text"))
    spool = saved(docs.mapInArrow(_spool(path, folder, end_id), SPOOL), folder, "spool")
    chunks = spool.select(F.inline("chunks"))
    owners = chunks.groupBy("digest").agg(F.min(F.struct("pack", "at", "size")).alias("p")).select("digest", "p.*")
    owners = owners.repartition("pack").sortWithinPartitions("pack", "at")
    saved(owners.mapInArrow(_compact(folder), "digest binary, pack string, at long, size int"), folder, "index")
    recipes = spool.select("row", "doc_id", "n_tokens", "digests", "root").repartitionByRange("doc_id", "row").sortWithinPartitions("doc_id", "row")
    recipes = saved(recipes.withColumn("part", F.spark_partition_id()), folder, "recipes")
    saved(_part_roots(recipes), folder, "manifest")
    saved(docs.sparkSession.createDataFrame([(id_width(path, end_id), end_id)], "width int, end_id long"), folder, "format")
    store, top = filesystem(folder)
    for done in ("stage", "spool"):
        if store.get_file_info(f"{top}/{done}").type.name == "Directory":
            store.delete_dir(f"{top}/{done}")


FETCH_BYTES, GAP = 1 << 22, 1 << 15  # of chunks held at a time; between chunks that one read takes


def _ranges(places: list[tuple[str, int, int]]) -> Iterator[list[tuple[str, int, int]]]:
    """Distinct sorted places (pack, at, size) in runs that one read can fetch."""
    run: list[tuple[str, int, int]] = []
    for x in places:
        if run and (x[0] != run[0][0] or x[1] - run[-1][1] - run[-1][2] > GAP or x[1] + x[2] - run[0][1] > FETCH_BYTES):
            yield run
            run = []
        run.append(x)
    if run:
        yield run


def _fetch(folder: str, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        store, top = filesystem(folder)
        kind, unpack = np.dtype(f"<u{width}"), zstandard.ZstdDecompressor().decompress
        files: dict = {}

        def opened(pack: str):
            if pack not in files:
                if len(files) >= 64:
                    files.clear()
                files[pack] = store.open_input_file(f"{top}/packs/{pack}")
            return files[pack]

        def fetched(wanted: set[tuple[str, int, int]]) -> dict[tuple[str, int, int], bytes]:
            out = {}
            for together in _ranges(sorted(wanted)):
                pack, start, _ = together[0]
                data = opened(pack).read_at(together[-1][1] + together[-1][2] - start, start)
                out |= {x: data[x[1] - start : x[1] - start + x[2]] for x in together}
            return out

        for batch in batches:
            columns = zip(*(batch.column(c).to_pylist() for c in ("digests", "root", "places")), strict=True)
            rows, held, size, n, crc = [], set(), 0, [], []

            def finish() -> None:
                chunks = fetched(held)
                for digests, root, places in rows:
                    try:
                        data = [unpack(chunks[p], max_output_size=MOST * 4) for p in places]
                    except zstandard.ZstdError as bad:
                        raise ValueError("a chunk is damaged: its document can't match its recipe") from bad
                    found = b"".join(map(digest, data))
                    if found != digests or merkle_root(found) != root:
                        raise ValueError("a document does not match its recipe")
                    ids = np.frombuffer(b"".join(data), kind)
                    n.append(len(ids))
                    crc.append(zlib.crc32(ids.astype("<u4").tobytes()))
                rows.clear()
                held.clear()

            for digests, root, places in columns:
                if not places or any(x["pack"] is None for x in places):
                    raise ValueError("a chunk of a recipe is missing from the index")
                places = [(x["pack"], x["at"], x["size"]) for x in places]
                rows.append((digests, root, places))
                held.update(places)
                size += sum(p[2] for p in places)
                if size > FETCH_BYTES:
                    finish()
                    size = 0
            finish()
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(crc, pa.int64())], ["row", "doc_id", "n_tokens", "ids_crc32"])

    return run


def read_store(spark: SparkSession, folder: str, width: int | None = None) -> DataFrame:
    """Per document of a store: doc_id, start, n_tokens, ids_crc32, from its files; in a
    store that is damaged a task fails, and one whose recipes are not those of its manifest
    is a ValueError.  width: bytes of an id, if others than the store's are an error."""
    verify_manifest(spark, folder)
    there = spark.read.parquet(f"{folder}/format").first().width
    if width not in (None, there):
        raise ValueError(f"ids of this store have {there} bytes")
    width = there
    recipes, index = spark.read.parquet(f"{folder}/recipes"), spark.read.parquet(f"{folder}/index")
    each = F.transform(F.sequence(F.lit(0), (F.length("digests") / DIGEST).cast("int") - 1), lambda i: F.substring(F.col("digests"), i * DIGEST + 1, F.lit(DIGEST)))
    refs = recipes.select("row", F.posexplode(each).alias("seq", "digest"))
    places = refs.join(index, "digest", "left").groupBy("row").agg(F.sort_array(F.collect_list(F.struct("seq", "pack", "at", "size"))).alias("places"))  # of one document
    docs = recipes.join(places, "row", "left").repartitionByRange("doc_id", "row").sortWithinPartitions("doc_id", "row")
    out = docs.select("row", "doc_id", "digests", "root", "places").mapInArrow(_fetch(folder, width), "row long, doc_id long, n_tokens long, ids_crc32 long")
    out = saved(out.withColumn("part", F.spark_partition_id()), folder, f"read-{uuid.uuid4().hex}")
    # One total a partition comes to the driver; ranges ascend with the partition's number.
    totals = sorted(out.groupBy("part").agg(F.sum("n_tokens")).collect())
    before = np.cumsum([0, *(t for _, t in totals)]).tolist()
    starts = spark.createDataFrame([(p, b) for (p, _), b in zip(totals, before, strict=False)], "part int, before long")
    w = Window.partitionBy("part").orderBy("doc_id", "row").rowsBetween(Window.unboundedPreceding, -1)
    out = out.join(F.broadcast(starts), "part").withColumn("start", F.col("before") + F.coalesce(F.sum("n_tokens").over(w), F.lit(0)))
    return out.select("doc_id", "start", "n_tokens", "ids_crc32")


def verify_manifest(spark: SparkSession, folder: str) -> bytes:
    """The store's Merkle root over its manifest; ValueError if the roots, documents or
    tokens of a part, counted anew from its recipes, are not the manifest's.  The manifest
    has a row a partition."""
    columns = ["part", "n_docs", "n_tokens", "root"]
    parts = [tuple(r) for r in spark.read.parquet(f"{folder}/manifest").select(*columns).orderBy("part").collect()]
    if parts != [tuple(r) for r in _part_roots(spark.read.parquet(f"{folder}/recipes")).select(*columns).orderBy("part").collect()]:
        raise ValueError("recipes do not match the manifest")
    return merkle_root(b"".join(bytes(p[3]) for p in parts))
