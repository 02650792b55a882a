"""Exact duplicates by Patricia tries.

Every text is normalised and digested once, in the pass that reads it. That pass takes some tens of megabytes of rows at
a time, inserts their texts into a radix trie, and hands on one entry for each terminal: the whole bytes, the smallest
identifier so far and the number of rows. Entries are dealt by length and the leading bits of the content hash, sorted
by length and hash, and inserted into tries again: a subtree holds the texts of one length and hash prefix, its terminal
nodes keep the smallest identifier, and when the next subtree begins (or it holds too many bytes and the hash moves on)
it is written out and forgotten. What does not fit in memory is held by Spark's sort, which spills in that same order.

The terminals give their identifier to every entry, and rows take it from the entry that they made. All rows of an entry
come from one piece of one task, so no key is hot, and a text that makes up a third of all rows reaches its subtree once
a piece instead of once a row.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_type

from leafspark.llm.shared import pick, write_table

#: Bytes of rows that share the first trie of a task, and bytes after which a subtree is written out early.
PIECE_BYTES = 12_000_000
#: Leading bits of the content hash that make a subtree of one length.
PREFIX_BITS = 8


def normalised(text: bytes | None) -> bytes:
    """Each run of the white space bytes 9 to 13 and 32 as one space; null as the empty text."""
    if not text:
        return b""
    words = text.split()
    if not words:
        return b" "
    return b" " * text[:1].isspace() + b" ".join(words) + b" " * text[-1:].isspace()


class Node:
    __slots__ = ("label", "children", "row")

    def __init__(self, label: bytes, row: list | None = None):
        self.label, self.row, self.children = label, row, {}


class Trie:
    """A compressed radix trie over byte strings; a terminal node holds [identifier, count, place of the smallest]."""

    def __init__(self):
        self.root = Node(b"")

    def terminal(self, key: bytes) -> list:
        """The row of the key's terminal node; an empty list if the key is new."""
        node, at = self.root, 0
        while at < len(key):
            child = node.children.get(key[at])
            if child is None:
                child = node.children[key[at]] = Node(key[at:], [])
                return child.row
            label = child.label
            if key.startswith(label, at):
                node, at = child, at + len(label)
                continue
            shared = len(os.path.commonprefix((label, key[at:at + len(label)])))
            fork = Node(label[:shared])
            child.label = label[shared:]
            fork.children[child.label[0]] = child
            node.children[key[at]] = fork
            node, at = fork, at + shared
        if node.row is None:
            node.row = []
        return node.row

    def insert(self, key: bytes, ident, count: int, place) -> list:
        """The terminal's row after this insertion. The smallest identifier stays; null is larger than any."""
        row = self.terminal(key)
        if not row:
            row += [ident, count, place]
            return row
        row[1] += count
        if ident is not None and (row[0] is None or ident < row[0]):
            row[0], row[2] = ident, place
        return row

    def rows(self) -> Iterator[list]:
        todo = [self.root]
        while todo:
            node = todo.pop()
            if node.row:
                yield node.row
            todo += node.children.values()


def _pieces(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.Table]:
    held, total = [], 0
    for batch in batches:
        held.append(batch)
        total += batch.nbytes
        if total >= size:
            yield pa.Table.from_batches(held)
            held, total = [], 0
    if held:
        yield pa.Table.from_batches(held)


def _out(table: pa.Table, rows: int = 2_000) -> Iterator[pa.RecordBatch]:
    for batch in table.to_batches(max_chunksize=rows):
        if batch.num_rows:
            yield batch


def _keys(column: pa.ChunkedArray) -> list[bytes]:
    return [normalised(text) for text in column.cast(pa.large_binary()).to_pylist()]


def _hashes(keys: list[bytes]) -> pa.Array:
    return pa.array([xxhash.xxh64_intdigest(key) - (1 << 63) for key in keys], pa.int64())


def _subtrees(batches: Iterator[pa.RecordBatch], keys, ident: str, place, size: int):
    """Over rows sorted by length and hash: the trie of each subtree, once its last row is in.

    A terminal's row is [identifier, count, place of the smallest, places of all]. At the end of a batch the trie so far
    is yielded with False: what it holds must not lean on the batch any more.
    """
    trie, now, last, total = Trie(), None, None, 0
    for batch in batches:
        ids, counts, hashes = batch.column(ident).to_pylist(), batch.column("copies").to_pylist(), batch.column("h").to_pylist()
        for i, key in enumerate(keys(batch)):
            spot, full = (len(key), hashes[i] >> 64 - PREFIX_BITS), (len(key), hashes[i])
            if now is not None and (spot != now or total > size and full != last):
                yield trie, True
                trie, total = Trie(), 0
            now, last = spot, full
            here = place(batch, i)
            row = trie.insert(key, ids[i], counts[i], here)
            if len(row) == 3:
                row.append([])
                total += len(key)
            row[3].append(here)
        yield trie, False
    if now is not None:
        yield trie, True


def _dealt(entries: DataFrame) -> DataFrame:
    prefix = F.shiftright("h", 64 - PREFIX_BITS)
    return entries.repartition("n_bytes", prefix).sortWithinPartitions("n_bytes", "h")


def survivors(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", piece: int = PIECE_BYTES) -> DataFrame:
    """One row of docs for each text, that of the smallest identifier, with all columns of docs.

    Texts are equal when they are the same after white space runs become one space; null is the empty text. Of rows
    with the same text and identifier any one stays; a null identifier is larger than any other. An empty table gives
    an empty table. docs may have any other columns, names that clash with those used here included.
    """
    names = docs.columns
    ident, text = (f"c{names.index(c)}" for c in (id_col, text_col))
    src = docs.toDF(*[f"c{i}" for i in range(len(names))])
    more = ", n_bytes long, h long, copies long"
    schema = ", ".join(f"c{i} {f.dataType.simpleString()}" for i, f in enumerate(docs.schema)) + more

    def merged(batches):
        for table in _pieces(batches, piece):
            trie, ids, keys = Trie(), table.column(ident).to_pylist(), _keys(table.column(text))
            for i, key in enumerate(keys):
                trie.insert(key, ids[i], 1, i)
            rows = sorted(trie.rows(), key=lambda row: row[2])
            kept = [keys[row[2]] for row in rows]
            out = table.take(pa.array([row[2] for row in rows], pa.int64()))
            out = out.append_column("n_bytes", pa.array(map(len, kept), pa.int64())).append_column("h", _hashes(kept))
            yield from _out(out.append_column("copies", pa.array([row[1] for row in rows], pa.int64())))

    def owners(batches):
        def keys(batch):
            return _keys(batch.column(text))
        for trie, whole in _subtrees(batches, keys, ident, lambda batch, i: batch.slice(i, 1), piece):
            if whole:
                yield from _out(pa.Table.from_batches([row[2] for row in trie.rows()]).combine_chunks())
                continue
            for row in trie.rows():  # what stays open keeps its own copy of one row, not the whole batch
                row[2] = pa.RecordBatch.from_pylist(row[2].to_pylist(), schema=row[2].schema)
                row[3] = [row[2]]
    return _dealt(src.mapInArrow(merged, schema)).mapInArrow(owners, schema).select(*src.columns).toDF(*names)


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", piece: int = PIECE_BYTES) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256) for every row of docs.

    keep_id is the smallest identifier with the row's text (null only if all are null), group_size the rows that have
    the text; null is the empty text. One row of a text is kept: of rows that repeat both text and identifier, any one.
    An empty table gives an empty table.
    """
    src = pick(docs, doc_id=id_col, text=text_col)
    kind, id_type = src.schema["doc_id"].dataType.simpleString(), to_arrow_type(src.schema["doc_id"].dataType)
    schema = f"doc_id {kind}, place long, entry long, sha binary, copies long, n_bytes long, h long, content binary"
    fields = ["doc_id", "place", "entry", "sha", "copies", "n_bytes", "h", "content"]

    def entries(batches):
        task = TaskContext.get().partitionId() << 40
        place = entry = task
        for table in _pieces(batches, piece):
            trie, ids, keys, own = Trie(), table.column("doc_id").to_pylist(), _keys(table.column("text")), []
            shas: list[bytes] = []
            for i, key in enumerate(keys):
                row = trie.insert(key, ids[i], 1, place + i)
                if len(row) == 3:
                    row += [entry, i, hashlib.sha256(key).digest()]
                    entry += 1
                own.append(row[3])
                shas.append(row[5])
            n, many = len(keys), pa.nulls
            yield from _out(pa.table([table.column("doc_id"), pa.array(range(place, place + n), pa.int64()), pa.array(own, pa.int64()), pa.array(shas, pa.binary()),
                                      many(n, pa.int64()), many(n, pa.int64()), many(n, pa.int64()), many(n, pa.binary())], fields))
            rows = list(trie.rows())
            kept, n = [keys[row[4]] for row in rows], len(rows)
            yield from _out(pa.table([pa.array([row[0] for row in rows], table.schema.field("doc_id").type), pa.array([row[2] for row in rows], pa.int64()), pa.array([row[3] for row in rows], pa.int64()),
                                      many(n, pa.binary()), pa.array([row[1] for row in rows], pa.int64()), pa.array(map(len, kept), pa.int64()), _hashes(kept), pa.array(kept, pa.binary())], fields))
            place += len(keys)

    def owners(batches):
        def keys(batch):
            return batch.column("content").to_pylist()
        for trie, whole in _subtrees(batches, keys, "doc_id", lambda batch, i: (batch.column("entry")[i].as_py(), batch.column("place")[i].as_py()), piece):
            if whole:
                out = [(e, row[0], row[2][1], row[1]) for row in trie.rows() for e, _ in row[3]]
                of, ident, first, copies = zip(*out)
                yield from _out(pa.table([pa.array(of, pa.int64()), pa.array(ident, id_type), pa.array(first, pa.int64()), pa.array(copies, pa.int64())], ["own", "keep_id", "first", "group_size"]), 10_000)

    noted = write_table(src.mapInArrow(entries, schema), "exact-entries")
    told = _dealt(noted.where("content is not null").drop("sha")).mapInArrow(owners, f"own long, keep_id {kind}, first long, group_size long")
    rows = noted.where("content is null").select("doc_id", "place", "entry", "sha")
    return rows.join(told, F.col("entry") == F.col("own")).select(
        "doc_id", "keep_id", "group_size", (F.col("place") == F.col("first")).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"))
