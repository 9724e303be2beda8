"""Substring dedup on a De Bruijn graph of token windows.

A window of `k` consecutive words is an edge from its first k - 1 words to its last k - 1. Edges that occur in two
documents or more are kept, each with its source: the least document that has it, and the place there. In a source
document neighbouring edges make a segment; segments that follow each other without a branch are compacted to paths by
joins (`compact`). In any other document a run of edges whose source places also run on by one is a piece of a segment;
pieces that run on along one path are one repeated span, and spans are what is removed.

Before anything is removed, coordinates are verified. A piece and the segment that it claims to come from are laid on a
grid of the source's places; for each cell the SHA-256 of the document's own words must be that of the source's words
there. Should one differ, two edges had one hash, and everything is looked up again by another hash function.

How rows travel. Documents are dealt into blocks by a hash of their id. A block asks, for each range of hash values, about
its own distinct hashes only (so a passage that millions of documents share is one entry per block) and is told what it
needs to know: first, which 5-word minimizers of its windows occur in two documents or more (all others rule their windows
out), then, for what is left, the source of each edge. Edges are told apart by 96 bits. A block takes about BLOCK bytes,
a range about input / spark.sql.shuffle.partitions; each is worked on by one task, and nothing is collected.
"""

from __future__ import annotations

import hashlib
from itertools import compress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wordloom.llm import kernel
from wordloom.llm.common import Scratch, carried, partitions, table, texts

WINDOW, SEED = 13, 5
#: Blocks for each shuffle partition, so that they fill partitions evenly; bytes of the source that a block has at most, about.
_BLOCKS, BLOCK = 4, 8_000_000
#: Places of a source in a cell of the grid.
CELL = 64
#: Hash functions that are tried until no two edges have one hash.
_TRIES = 5
_NO_ID = (1 << 63) - 1
_SPAN = "struct<start:long,length:long,source:long,source_start:long,path:long,path_start:long>"
_PLACED = "kind string, block long, source long, start long, length long, first long, last long, words string, digest string, data array<binary>"


def _narrow(a: np.ndarray) -> bytes:
    fits = not len(a) or (a.min() >= 0 and a.max() < 1 << 32)
    return a.astype("<u4" if fits else "<i8").tobytes()


def _wide(data: bytes, n: int) -> np.ndarray:
    return np.frombuffer(data, "<u4" if len(data) == 4 * n else "<i8").astype(np.int64) if n else np.zeros(0, np.int64)


def _bits(a: np.ndarray) -> bytes:
    return np.packbits(a).tobytes()


def _bools(data: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(data, np.uint8), count=n).astype(bool)


def _bounds(hashes: np.ndarray, parts: int) -> np.ndarray:
    """Where each of `parts` equal ranges of the 64-bit values begins in a sorted array, and its end."""
    edges = np.array([(i << 64) // parts for i in range(1, parts)], np.uint64)
    return np.concatenate(([0], np.searchsorted(hashes, edges), [len(hashes)]))


class _Block:
    """The windows of a block's documents, in the order of its rows."""

    def __init__(self, rows: pa.Table):
        self.rows = rows.combine_chunks()
        column = self.rows["text"].chunk(0) if self.rows["text"].num_chunks else pa.array([], pa.string())
        self.ids = self.rows["doc_id"].to_numpy()
        self.words = kernel.words(column)
        #: The place of each row's first word in its document: rows of one id follow each other, by their texts.
        self.base = np.zeros(len(self.ids), np.int64)
        same, which, n = np.unique(self.ids, return_inverse=True, return_counts=True)
        if len(same) < len(self.ids):
            lengths, own = np.diff(self.words.first), column.to_pylist()
            for i in np.flatnonzero(n > 1):
                listed = sorted(np.flatnonzero(which == i).tolist(), key=lambda r: own[r])
                self.base[listed] = np.cumsum([0, *lengths[listed][:-1]])

    def windows(self, k: int, seed: int, salt: int, bits: int) -> _Block:
        """Hash all windows, and find their minimizers."""
        self.k, self.salt, self.bits = k, salt, bits
        self.hashes = self.words.hashes(0, salt)
        self.begin = np.flatnonzero(self.words.doc[: max(0, len(self.hashes) - k + 1)] == self.words.doc[k - 1 :]) if len(self.hashes) >= k else np.zeros(0, np.int64)
        value, at = self.words.windows(self.hashes, seed)
        seeds = np.zeros(len(self.hashes), np.uint64)
        seeds[at] = value
        least = seeds[self.begin]
        for j in range(1, k - seed + 1):
            np.minimum(least, seeds[self.begin + j], out=least)
        self.order = np.argsort(least, kind="stable")
        ordered = least[self.order]
        new = np.concatenate(([True], ordered[1:] != ordered[:-1])) if len(ordered) else np.zeros(0, bool)
        self.seeds, self.groups = ordered[new], np.cumsum(new) - 1
        self.starts = np.flatnonzero(new)
        return self

    def shared(self) -> np.ndarray:
        """For each minimizer: do two documents of this block have it?"""
        docs = self.ids[self.words.doc[self.begin]][self.order]
        return np.minimum.reduceat(docs, self.starts) != np.maximum.reduceat(docs, self.starts) if len(self.starts) else np.zeros(0, bool)

    def edges(self, kept: np.ndarray) -> None:
        """The edges of windows whose minimizers are kept; distinct ones in order of their hashes, with the first place."""
        chosen = np.zeros(len(self.begin), bool)
        chosen[self.order[kept[self.groups]]] = True
        self.at = self.begin[chosen]
        n = len(self.hashes)
        high = np.zeros(len(self.at), np.uint64)
        low = np.zeros(len(self.at), np.uint64)
        second = self.words.hashes(1, self.salt) if n else self.hashes
        for i in range(self.k):
            high = high * np.uint64(0xD6E8FEB86659FD93) + self.hashes[self.at + i]
            low = low * np.uint64(0xA0761D6478BD642F) + second[self.at + i]
        high, low = kernel.mix(high), (kernel.mix(low) >> np.uint64(32)).astype(np.uint32)
        if self.bits < 96:
            high, low = high >> np.uint64(64 - min(self.bits, 64)), low >> np.uint32(min(31, 96 - self.bits))
        row = self.words.doc[self.at]
        self.doc, self.place = self.ids[row], self.at - self.words.first[row] + self.base[row]
        order = np.lexsort((self.place, self.doc, low, high))
        h, lo = high[order], low[order]
        new = np.concatenate(([True], (h[1:] != h[:-1]) | (lo[1:] != lo[:-1]))) if len(h) else np.zeros(0, bool)
        starts = np.flatnonzero(new)
        self.high, self.low, self.first_doc, self.first_place = h[new], lo[new], self.doc[order][new], self.place[order][new]
        self.in_two = self.first_doc != np.maximum.reduceat(self.doc[order], starts) if len(starts) else np.zeros(0, bool)
        self.edge = np.empty(len(order), np.int64)
        self.edge[order] = np.cumsum(new) - 1


def _asked(hashes: np.ndarray, parts: int) -> tuple[list[int], list[tuple[int, int]]]:
    """The ranges that a block has hashes in, and where these are."""
    ends = _bounds(hashes, parts).tolist()
    asked = [(i, (a, b)) for i, (a, b) in enumerate(zip(ends, ends[1:], strict=False)) if b > a]
    return [i for i, _ in asked], [x for _, x in asked]


def _ask_seeds(k: int, seed: int, parts: int, salt: int, bits: int):
    def run(key: tuple, rows: pa.Table) -> pa.Table:
        block = _Block(rows).windows(k, seed, salt, bits)
        shared, (which, spans) = block.shared(), _asked(block.seeds, parts)
        return pa.table({"part": pa.array(which, pa.int32()), "block": pa.array([key[0].as_py()] * len(which), pa.int64()), "n": pa.array([b - a for a, b in spans], pa.int64()), "hashes": pa.array([block.seeds[a:b].tobytes() for a, b in spans], pa.binary()), "two": pa.array([_bits(shared[a:b]) for a, b in spans], pa.binary())})

    return run, "part int, block long, n long, hashes binary, two binary"


def _answer_seeds(key: tuple, asked: pa.Table) -> pa.Table:
    counts = asked["n"].to_pylist()
    hashes = np.concatenate([np.frombuffer(x, np.uint64) for x in asked["hashes"].to_pylist()])
    two = np.concatenate([_bools(x, n) for x, n in zip(asked["two"].to_pylist(), counts, strict=True)])
    order = np.argsort(hashes, kind="stable")
    ordered = hashes[order]
    new = np.concatenate(([True], ordered[1:] != ordered[:-1])) if len(ordered) else np.zeros(0, bool)
    groups = np.cumsum(new) - 1
    kept = np.bincount(groups, minlength=int(new.sum())) > 1
    kept[groups[two[order]]] = True
    answer = np.empty(len(hashes), bool)
    answer[order] = kept[groups]
    ends = np.cumsum([0, *counts])
    return pa.table({"block": asked["block"], "part": asked["part"], "n": asked["n"], "kept": pa.array([_bits(answer[a:b]) for a, b in zip(ends, ends[1:], strict=False)], pa.binary())})


def _in_order(told: pa.Table) -> list[dict]:
    return sorted(told.to_pylist(), key=lambda x: x["part"])


def _kept(told: pa.Table, n: int) -> np.ndarray:
    return np.concatenate([np.zeros(0, bool), *[_bools(x["kept"], x["n"]) for x in _in_order(told)]]) if told.num_rows else np.zeros(n, bool)


def _ask_edges(k: int, seed: int, parts: int, salt: int, bits: int):
    def run(key: tuple, rows: pa.Table, told: pa.Table) -> pa.Table:
        block = _Block(rows).windows(k, seed, salt, bits)
        kept = _kept(told, len(block.seeds))
        block.edges(kept)
        which, spans = _asked(block.high, parts)
        binary = lambda of: pa.array([of(a, b) for a, b in spans], pa.binary())
        return pa.table({
            "part": pa.array(which, pa.int32()), "block": pa.array([key[0].as_py()] * len(which), pa.int64()), "n": pa.array([b - a for a, b in spans], pa.int64()),
            "high": binary(lambda a, b: block.high[a:b].tobytes()), "low": binary(lambda a, b: block.low[a:b].tobytes()), "doc": binary(lambda a, b: _narrow(block.first_doc[a:b])), "place": binary(lambda a, b: _narrow(block.first_place[a:b])), "two": binary(lambda a, b: _bits(block.in_two[a:b])),
            "kept": pa.array([_bits(kept) if i == 0 else None for i in range(len(which))], pa.binary()),
        })

    return run, "part int, block long, n long, high binary, low binary, doc binary, place binary, two binary, kept binary"


def _answer_edges(key: tuple, asked: pa.Table) -> pa.Table:
    counts = asked["n"].to_pylist()
    joined = lambda name, read: np.concatenate([read(x, n) for x, n in zip(asked[name].to_pylist(), counts, strict=True)])
    high, low = joined("high", lambda x, n: np.frombuffer(x, np.uint64)), joined("low", lambda x, n: np.frombuffer(x, np.uint32))
    doc, place, two = joined("doc", _wide), joined("place", _wide), joined("two", _bools)
    order = np.lexsort((place, doc, low, high))
    h, lo, d = high[order], low[order], doc[order]
    new = np.concatenate(([True], (h[1:] != h[:-1]) | (lo[1:] != lo[:-1]))) if len(h) else np.zeros(0, bool)
    groups, starts = np.cumsum(new) - 1, np.flatnonzero(new)
    kept = d[starts] != np.maximum.reduceat(d, starts) if len(starts) else new
    kept[groups[two[order]]] = True
    answer, source, source_place = np.empty(len(h), bool), np.empty(len(h), np.int64), np.empty(len(h), np.int64)
    answer[order], source[order], source_place[order] = kept[groups], d[starts][groups], place[order][starts][groups]
    ends = np.cumsum([0, *counts])
    spans = list(zip(ends, ends[1:], strict=False))
    binary = lambda of: pa.array([of(slice(a, b)) for a, b in spans], pa.binary())
    return pa.table({"block": asked["block"], "part": asked["part"], "n": asked["n"], "repeated": binary(lambda s: _bits(answer[s])), "source": binary(lambda s: _narrow(source[s][answer[s]])), "source_place": binary(lambda s: _narrow(source_place[s][answer[s]])), "kept": asked["kept"]})


def _runs(row: np.ndarray, place: np.ndarray, *also: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First index and length of the runs in which row stays and place and the others but the last go on by one; the last stays."""
    if not len(row):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    goes = (row[1:] == row[:-1]) & (place[1:] == place[:-1] + 1)
    if also:
        goes &= (also[0][1:] == also[0][:-1] + 1) & (also[1][1:] == also[1][:-1])
    first = np.flatnonzero(np.concatenate(([True], ~goes)))
    return first, np.diff(np.concatenate((first, [len(row)])))


def _listed(of_row: np.ndarray, rows: int, **columns: np.ndarray) -> pa.Array:
    ends = np.concatenate(([0], np.cumsum(np.bincount(of_row, minlength=rows))))
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays([pa.array(c.astype(np.int64)) for c in columns.values()], list(columns)))


def _texts_of(block: _Block, begin: np.ndarray, end: np.ndarray) -> list[bytes]:
    """The words from begin to end (exclusive, of one row each) joined by one space."""
    w = block.words
    return [b" ".join(w.data[a:b].tobytes().split()) for a, b in zip(w.start[begin].tolist(), w.end[end - 1].tolist(), strict=True)]


def _cells(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Cut ranges of places along the grid: the number of the range, and the first and last (exclusive) place of each cut."""
    first, n = start // CELL, (end - 1) // CELL - start // CELL + 1
    number = np.repeat(np.arange(len(start)), n)
    cell = first[number] + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    return number, np.maximum(start[number], cell * CELL), np.minimum(end[number], (cell + 1) * CELL)


def _place(k: int, seed: int, salt: int, bits: int):
    """The block's pieces (one row with all of them), what to verify for them and which cells of segments they need, and the segments that it is the source of."""

    def run(key: tuple, rows: pa.Table, told: pa.Table) -> pa.Table:
        block = _Block(rows).windows(k, seed, salt, bits)
        w, answers, number = block.words, _in_order(told), key[0].as_py()
        kept = next((x["kept"] for x in answers if x["kept"] is not None), None)
        block.edges(np.zeros(len(block.seeds), bool) if kept is None else _bools(kept, len(block.seeds)))
        repeated = np.concatenate([np.zeros(0, bool), *[_bools(x["repeated"], x["n"]) for x in answers]])
        source, source_place = np.zeros(len(repeated), np.int64), np.zeros(len(repeated), np.int64)
        read = lambda name: np.concatenate([np.zeros(0, np.int64), *[_wide(x[name], int(_bools(x["repeated"], x["n"]).sum())) for x in answers]])
        source[repeated], source_place[repeated] = read("source"), read("source_place")
        known, from_doc, from_place = repeated[block.edge], source[block.edge], source_place[block.edge]
        row = w.doc[block.at]
        made: list[tuple] = []

        later = known & (from_doc < block.doc)
        first, edges = _runs(row[later], block.place[later], from_place[later], from_doc[later])
        at, doc, place, came, came_at = (x[later][first] for x in (block.at, block.doc, block.place, from_doc, from_place))
        if len(first):
            made.append(("pieces", number, None, None, None, None, None, None, None, [x.astype("<i8").tobytes() for x in (doc, place, edges, came, came_at)]))
            made += [("need", number, int(d), int(c), None, None, None, None, None, None) for d, c in np.unique(np.stack((came, came_at // CELL)), axis=1).T]
            of, begin, end = _cells(came_at, came_at + edges + k - 1)
            shift = (at - came_at)[of]
            asked = {(int(d), int(b), int(e), hashlib.sha256(t).hexdigest()) for d, b, e, t in zip(came[of], begin, end, _texts_of(block, begin + shift, end + shift), strict=True)}
            made += [("verify", None, d, b, e - b, None, None, None, digest, None) for d, b, e, digest in asked]

        own = known & (from_doc == block.doc) & (from_place == block.place)
        first, edges = _runs(row[own], block.place[own])
        if len(first):
            at, doc, place = (x[own][first] for x in (block.at, block.doc, block.place))
            nodes = np.zeros(len(block.hashes) + 1, np.uint64)
            value, begin = w.windows(block.hashes, k - 1)
            nodes[begin] = value
            nodes = nodes.view(np.int64)
            made += [("segment", None, int(d), int(p), int(n), int(a), int(z), None, None, None) for d, p, n, a, z in zip(doc, place, edges, nodes[at], nodes[at + edges], strict=True)]
            #: Words of each cell from the first to the last that a segment has there.
            of, begin, end = _cells(place, place + edges + k - 1)
            cell, shift = begin // CELL, (at - place)[of]
            owner = row[own][first][of]
            order = np.lexsort((begin, cell, owner))
            new = np.flatnonzero(np.concatenate(([True], (owner[order][1:] != owner[order][:-1]) | (cell[order][1:] != cell[order][:-1]))))
            low, high, same = begin[order][new], np.maximum.reduceat(end[order], new), order[new]
            label = _texts_of(block, low + shift[same], high + shift[same])
            made += [("cell", None, int(d), int(b), None, None, None, t.decode(), None, None) for d, b, t in zip(doc[of][same], low, label, strict=True)]
        columns = zip(*made, strict=True) if made else [[]] * 10
        types = [pa.string(), *[pa.int64()] * 6, pa.string(), pa.string(), pa.list_(pa.binary())]
        names = [x.split(" ")[0] for x in _PLACED.split(", ")]
        return pa.table({n: pa.array(c, t) for n, c, t in zip(names, columns, types, strict=True)})

    return run, _PLACED


def _remove(k: int, form: str, also: list[str]):
    """Join the pieces that run on along a path to spans, and take these from the texts."""

    def run(key: tuple, rows: pa.Table, told: pa.Table) -> pa.Table:
        block = _Block(rows)
        w, n_rows, n = block.words, rows.num_rows, len(block.words.start)
        own = [x for x in told.filter(pc.equal(told["kind"], "pieces"))["data"].to_pylist()]
        doc, place, edges, came, came_at = (np.frombuffer(x, "<i8") for x in own[0]) if own else [np.zeros(0, np.int64)] * 5
        segments = told.filter(pc.equal(told["kind"], "segment")).sort_by([("source", "ascending"), ("start", "ascending")])
        source, start, path, offset = (segments[c].to_numpy() for c in ("source", "start", "path", "offset"))

        #: The piece's row: of rows of one id, the last that begins at its place or before.
        order = np.lexsort((block.base, block.ids))
        at = _last(block.ids[order], block.base[order], doc, place)
        row = order[at] if len(doc) else at
        begin = w.first[row] + place - block.base[row]
        of = _last(source, start, came, came_at)
        path, path_start = path[of], offset[of] + came_at - start[of]

        goes = (row[1:] == row[:-1]) & (place[1:] == (place + edges)[:-1]) & (path[1:] == path[:-1]) & (path_start[1:] == (path_start + edges)[:-1])
        first = np.flatnonzero(np.concatenate(([True], ~goes))) if len(doc) else np.zeros(0, np.int64)
        total = np.add.reduceat(edges, first) if len(doc) else first
        mark = np.bincount(begin[first], minlength=n + 1)[: n + 1] - np.bincount(begin[first] + total + k - 1, minlength=n + 1)[: n + 1]
        removed = np.cumsum(mark[:n]) > 0
        spans = _listed(row[first], n_rows, start=begin[first] - w.first[row[first]], length=total + k - 1, source=came[first], source_start=came_at[first], path=path[first], path_start=path_start[first])
        n_removed = w.per_doc(removed)
        made, keep = [], ~removed
        for i, text in enumerate(block.rows["text"].to_pylist()):
            a, b = w.first[i], w.first[i + 1]
            if form == "cut":
                if n_removed[i]:
                    edge = np.flatnonzero(np.diff(np.concatenate(([False], removed[a:b], [False])).astype(np.int8)))
                    raw, base, parts, at_byte = text.encode(), w.ends[i], [], 0
                    for x, y in zip(edge[::2], edge[1::2], strict=True):
                        parts.append(raw[at_byte : w.start[a + x] - base])
                        at_byte = w.start[a + y] - base if a + y < b else len(raw)
                    text = b"".join([*parts, raw[at_byte:]]).decode()
                made.append(text)
            else:
                split = text.encode().split()
                joined = b" ".join(compress(split, keep[a:b].tolist()) if n_removed[i] else split)
                made.append(hashlib.sha256(joined).hexdigest() if form == "digest" else joined.decode())
        return pa.table({"doc_id": block.rows["doc_id"], "n_words": pa.array(np.diff(w.first)), "n_removed": pa.array(n_removed.astype(np.int64)), "kept": pa.array(made, pa.string()), "spans": spans} | {c: block.rows[c] for c in (x.split(" ")[0] for x in also)})

    return run, ", ".join(["doc_id long, n_words long, n_removed long, kept string", f"spans array<{_SPAN}>", *also])


def _last(keys: np.ndarray, places: np.ndarray, key: np.ndarray, place: np.ndarray) -> np.ndarray:
    """For each key and place the last entry of the sorted keys and places that has this key and this place or one before."""
    both = np.lexsort((np.repeat([0, 1], [len(keys), len(key)]), np.concatenate((places, place)), np.concatenate((keys, key))))
    seen = np.cumsum(both < len(keys)) - 1
    found = np.empty(len(both), np.int64)
    found[both] = seen
    return found[len(keys) :]


def _blocks(docs: DataFrame, parts: int) -> int:
    """Some for each shuffle partition, and so many that none is large, by the size that the planner knows of the input."""
    size = int(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return max(_BLOCKS * parts, size // BLOCK if size < 1 << 60 else 0)  # an unknown size counts as the largest number


def placed(blocks: DataFrame, scratch: Scratch, k: int, seed: int, salt: int = 0, bits: int = 96) -> DataFrame:
    """blocks (block, doc_id, text) -> rows of five kinds: pieces, need, verify, segment and cell (see _place)."""
    parts = partitions(blocks.sparkSession)
    run, schema = _ask_seeds(k, seed, parts, salt, bits)
    asked = blocks.groupBy("block").applyInArrow(run, schema).repartition(parts, "part")
    told = asked.groupBy("part").applyInArrow(_answer_seeds, "block long, part int, n long, kept binary").repartition(parts, "block")
    run, schema = _ask_edges(k, seed, parts, salt, bits)
    asked = blocks.groupBy("block").cogroup(told.groupBy("block")).applyInArrow(run, schema).repartition(parts, "part")
    told = asked.groupBy("part").applyInArrow(_answer_edges, "block long, part int, n long, repeated binary, source binary, source_place binary, kept binary").repartition(parts, "block")
    run, schema = _place(k, seed, salt, bits)
    return scratch.put(blocks.groupBy("block").cogroup(told.groupBy("block")).applyInArrow(run, schema))


def unverified(found: DataFrame) -> DataFrame:
    """What placed() found to verify and differs: the source's words at the coordinates are not the document's."""
    cells = found.filter("kind = 'cell'").select("source", F.col("start").alias("from"), "words", F.floor(F.col("start") / CELL).alias("cell"))
    asked = found.filter("kind = 'verify'").select("source", "start", "length", "digest").distinct().withColumn("cell", F.floor(F.col("start") / CELL))
    asked, cells = asked.alias("asked"), cells.alias("cells")
    here = (F.col("asked.source") == F.col("cells.source")) & (F.col("asked.cell") == F.col("cells.cell")) & F.col("start").between(F.col("from"), F.col("from") + F.size(F.split("words", " ")) - 1)
    there = F.array_join(F.slice(F.split("words", " "), (F.col("start") - F.col("from") + 1).cast("int"), F.col("length").cast("int")), " ")
    return asked.join(cells, here, "left").filter(~F.coalesce(F.sha2(there, 256) == F.col("digest"), F.lit(False)))


def compact(segments: DataFrame, scratch: Scratch) -> DataFrame:
    """Segments (source, start, length in edges, first and last node) with path, which all segments of a path share, and offset, the edges before it.

    Two segments are joined where the one ends at a node that just one segment leaves and just one reaches. Each round
    joins every segment to the one that its pointer's pointer names, so rounds are few even for long paths; of a path that
    is a circle every segment is one of its own in the end.
    """
    own = scratch.put(segments.withColumn("segment", F.xxhash64("source", "start")))
    into = own.groupBy(F.col("last").alias("node")).agg(F.count("*").alias("n_in"), F.min("segment").alias("before"), F.min("length").alias("offset"))
    out = own.groupBy(F.col("first").alias("node")).agg(F.count("*").alias("n_out"), F.min("segment").alias("segment"))
    pointers = out.filter("n_out = 1").join(into.filter("n_in = 1"), "node").filter("before != segment").select("segment", "before", "offset")
    state = scratch.put(own.select("segment").join(pointers, "segment", "left").select("segment", F.coalesce("before", "segment").alias("path"), F.coalesce("offset", F.lit(0)).alias("offset")))
    steps, total = 1, state.count()
    while steps <= total:
        above = state.select(F.col("segment").alias("path"), F.col("path").alias("above"), F.col("offset").alias("more"))
        after = scratch.put(state.join(above, "path").select("segment", F.col("above").alias("path"), (F.col("offset") + F.col("more")).alias("offset"), (F.col("above") != F.col("path")).alias("moved")))
        scratch.drop(state)
        state = after
        if state.filter("moved").isEmpty():
            break
        steps *= 2
    named = own.join(state, "segment").select("source", "start", "length", "first", "last", *[(F.when(F.col("moved"), other).otherwise(F.col(c)) if steps > total > 0 else F.col(c)).alias(c) for c, other in (("path", F.col("segment")), ("offset", F.lit(0)))])
    made = scratch.put(named)
    scratch.drop(own, state)
    return made


def _named(found: DataFrame, segments: DataFrame) -> DataFrame:
    """The segments that each block's pieces begin in: an interval join on the grid, so that a source's pieces meet those of their own cell only."""
    within = F.sequence(F.floor(F.col("start") / CELL), F.floor((F.col("start") + F.col("length") - 1) / CELL))
    spread = segments.select("source", "start", "path", "offset", F.explode(within).alias("cell"))
    need = found.filter("kind = 'need'").select("block", "source", F.col("start").alias("cell"))
    return need.join(spread, ["source", "cell"]).select("block", "source", "start", "path", "offset").distinct()


def deduplicate(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", k: int = WINDOW, seed: int = SEED, form: str = "words", carry: tuple[str, ...] = (), bits: int = 96) -> DataFrame:
    """Remove each word that a window of k words covers whose words also start in a document of smaller id.

    One row for each row of docs: doc_id, n_words, n_removed, kept and spans (removed passages: start and length in words,
    the source document of the first window and the place there, the compacted path and the place on it). kept is, by `form`: "words", the
    words left, joined by one space; "cut", the text without the removed words and the white space behind them; "digest",
    the SHA-256 of the former. Columns of docs to carry come behind these. bits: of the first hash of edges.

    Windows are judged on the input. A null or empty text has no words, a table without rows gives none. Rows with one id
    are one document, their places counted on in the order of their texts; rows without an id count as having the
    largest. Texts shorter than k words keep all, and no text is too long.
    """
    parts, scratch = partitions(docs.sparkSession), Scratch(docs.sparkSession)
    own = texts(docs, doc_id, text, carry).withColumn("doc_id", F.coalesce("doc_id", F.lit(_NO_ID)))
    number = F.pmod(F.xxhash64("doc_id"), F.lit(_blocks(own, parts))).alias("block")
    blocks = own.select(number, "*").repartition(parts, "block")
    for salt in range(_TRIES):
        found = placed(own.select(number, "doc_id", "text").repartition(parts, "block"), scratch, k, seed, salt, bits if salt == 0 else 96)
        if unverified(found).isEmpty():
            break
        scratch.drop(found)
    else:
        raise RuntimeError("windows of other words have one hash, by every hash function tried")
    segments = compact(found.filter("kind = 'segment'").select("source", "start", "length", "first", "last"), scratch)
    none = lambda t: F.lit(None).cast(t)
    told = found.filter("kind = 'pieces'").select("block", "kind", "data", *[none("long").alias(c) for c in ("source", "start", "path", "offset")])
    told = told.union(_named(found, segments).select("block", F.lit("segment").alias("kind"), none("array<binary>").alias("data"), "source", "start", "path", "offset"))
    run, schema = _remove(k, form, [f.simpleString().replace(":", " ", 1) for f in own.schema[2:]])
    kept = blocks.groupBy("block").cogroup(told.repartition(parts, "block").groupBy("block")).applyInArrow(run, schema)
    return kept.select(F.when(F.col("doc_id") != _NO_ID, F.col("doc_id")).alias("doc_id"), "n_words", "n_removed", "kept", "spans", *carried(carry))


def op10_debruijn_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's words, what is removed of them, a digest of the rest, and the number of compacted paths that it came from."""
    found = deduplicate(table(spark, sf_dir, "documents"), form="digest")
    paths = F.size(F.array_distinct(F.transform("spans", lambda s: s["path"]))).cast("long")
    return found.select("doc_id", "n_words", "n_removed", F.col("kept").alias("kept_sha256"), paths.alias("n_paths"))


QUERIES = {"op10_debruijn_substring_dedup": op10_debruijn_substring_dedup}
