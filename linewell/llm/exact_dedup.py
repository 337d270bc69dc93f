"""Exact copies of texts, owned by the terminals of compressed radix tries.

Texts are compared without white space.  Each task inserts the texts of its rows into a
Patricia trie: equal texts meet in one terminal, which counts them and keeps the row that
stays, so a text goes on once a task, however often it stands there (an *entry*).  Entries are dealt by
length and content hash and inserted, byte by byte, into the trie of their partition,
whose terminals own the groups.  A trie over its budget spills a whole subtree: its texts,
and all later ones below it, are stored for another round, in which a subtree is a
partition of its own.  Rows learn their owner by the number of their entry, so that
a text's rows never meet in one task.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linewell.llm._common import BLANKS, map_arrow, stored

#: Bytes that the trie of a scanning task holds before it passes its entries on.
SCAN_BYTES = 64 << 20
#: Bytes that the trie of a partition holds before it spills.
TRIE_BYTES = 192 << 20
#: What a node takes besides its label.
NODE_BYTES = 300
#: Bytes of text in a batch of results.
OUT_BYTES = 4 << 20


class Node:
    __slots__ = ("label", "kids", "item", "cell")

    def __init__(self, label: bytes):
        self.label, self.kids, self.item, self.cell = label, {}, None, None


def _common(a: bytes, b: bytes, at: int) -> int:
    """How many bytes ``a`` and ``b[at:]`` share at their beginning."""
    low, high = 0, min(len(a), len(b) - at)
    step = 32
    while low < high and b.startswith(a[low:min(low + step, high)], at + low):
        low, step = min(low + step, high), step * 4
    high = min(high, low + step)
    while low < high:
        middle = (low + high + 1) // 2
        if b.startswith(a[low:middle], at + low):
            low = middle
        else:
            high = middle - 1
    return low


class Trie:
    """A compressed radix trie of byte strings; a node of a stored text has an ``item``.

    A node with a ``cell`` stands for a subtree that was spilled.
    """

    def __init__(self):
        self.root, self.bytes = Node(b""), NODE_BYTES

    def find(self, text: bytes) -> Node:
        """The node of ``text``, made if need be, or the spilled node above it."""
        node, at, end = self.root, 0, len(text)
        while at < end:
            kid = node.kids.get(text[at])
            if kid is None:
                leaf = node.kids[text[at]] = Node(text[at:])
                self.bytes += NODE_BYTES + len(leaf.label)
                return leaf
            if not text.startswith(kid.label, at):
                shared = _common(kid.label, text, at)
                upper = node.kids[text[at]] = Node(kid.label[:shared])
                kid.label = kid.label[shared:]
                upper.kids[kid.label[0]] = kid
                self.bytes += NODE_BYTES
                kid = upper
            node, at = kid, at + len(kid.label)
            if node.cell is not None:
                return node
        return node

    def texts(self, node: Node | None = None, above: bytes = b"") -> Iterator[tuple[bytes, list]]:
        """Every text at or below a node (whose parents spell ``above``), with its item."""
        waiting = [(node or self.root, above)]
        while waiting:
            node, path = waiting.pop()
            path += node.label
            if node.item is not None:
                yield path, node.item
            waiting += [(kid, path) for kid in node.kids.values()]

    @staticmethod
    def _weight(node: Node) -> int:
        total, waiting = 0, [node]
        while waiting:
            node = waiting.pop()
            total += NODE_BYTES + len(node.label) + (8 * len(node.item[-1]) if node.item else 0)
            waiting += node.kids.values()
        return total

    def spill(self) -> tuple[bytes, list[tuple[bytes, list]], Node] | None:
        """Cut off the largest subtree of the topmost fork: its path, texts and node; None if one text is left."""
        node, path = self.root, b""
        while True:
            live = [kid for kid in node.kids.values() if kid.cell is None]
            if not live:
                return None
            if len(live) > 1:
                break
            node = live[0]
            path += node.label
        weight, largest = max(((self._weight(kid), kid) for kid in live), key=lambda x: x[0])
        texts = list(self.texts(largest, path))
        self.bytes -= weight - NODE_BYTES - len(largest.label)
        largest.kids, largest.item = {}, None
        return path + largest.label, texts, largest


#: An item: rows, (-code points, id is null, id, row mark) of the row that stays, SHA-256, entries.
_ENTRY = "body binary, length long, hash long, sha binary, n long, chars long, best {kind}, mark long, entries array<long>"


class _Rows:
    """Rows on their way out, in batches of bounded size."""

    def __init__(self, names: list[str], kinds: list[pa.DataType]):
        self.schema, self.rows, self.bytes = pa.schema(list(zip(names, kinds, strict=True))), [], 0

    def add(self, body: bytes | None = None, **row) -> Iterator[pa.RecordBatch]:
        self.rows.append({**row, "body": body})
        self.bytes += 200 + len(body or b"") + 8 * len(row.get("entries") or ())
        if self.bytes >= OUT_BYTES:
            yield from self.out()

    def out(self) -> Iterator[pa.RecordBatch]:
        columns = [pa.array([row.get(f.name) for row in self.rows], f.type) for f in self.schema]
        yield pa.RecordBatch.from_arrays(columns, schema=self.schema)
        self.rows, self.bytes = [], 0


def _entry(body: bytes, item: list) -> dict:
    n, (chars, none, best, mark), sha, entries = item
    return {"body": body, "length": len(body), "hash": int.from_bytes(sha[:8], "big", signed=True), "sha": sha, "n": n,
            "chars": -chars, "best": None if none else best, "mark": mark, "entries": entries}


def _rank(chars: int, best, mark: int) -> tuple:
    return -chars, best is None, 0 if best is None else best, mark


def _names(schema: str) -> list[str]:
    return [part.split()[0] for part in schema.split(", ")]


def _enter(batches: Iterator[pa.RecordBatch], budget: int) -> Iterator[pa.RecordBatch]:
    """A row (id, row, entry) for every input row, and an entry for every text of the task."""
    trie, out, blanks = Trie(), None, BLANKS.encode()

    def passed_on():
        for body, item in trie.texts():
            item[2] = hashlib.sha256(body).digest()
            yield from out.add(**_entry(body, item))

    for batch in batches:
        kind = batch.schema.field("id").type
        out = out or _Rows(
            ["id", "row", "entry", "body", "length", "hash", "sha", "n", "chars", "best", "mark", "entries"],
            [kind, pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(),
             kind, pa.int64(), pa.list_(pa.int64())])
        for doc, row, chars, text in zip(*(batch.column(c).to_pylist() for c in ("id", "row", "chars", "text")), strict=True):
            node = trie.find(text.translate(None, blanks))
            rank = _rank(chars, doc, row)
            if node.item is None:
                node.item = [0, rank, b"", [row]]
            item = node.item
            item[0] += 1
            item[1] = min(item[1], rank)
            yield from out.add(id=doc, row=row, entry=item[3][0])
            if trie.bytes > budget:
                yield from passed_on()
                trie = Trie()
    if out:
        yield from passed_on()
        yield from out.out()


def _own(batches: Iterator[pa.RecordBatch], budget: int) -> Iterator[pa.RecordBatch]:
    """(entry, keep, keep_row, size, sha) for every entry; entries of spilled subtrees come out again, with a cell."""
    trie, out = Trie(), None
    for batch in batches:
        kind = batch.schema.field("best").type
        out = out or _Rows(
            ["entry", "keep", "keep_row", "size", "cell", "body", "length", "hash", "sha", "n", "chars", "best", "mark", "entries"],
            [pa.int64(), kind, pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.binary(),
             pa.int64(), pa.int64(), kind, pa.int64(), pa.list_(pa.int64())])
        columns = (batch.column(c).to_pylist() for c in ("body", "sha", "n", "chars", "best", "mark", "entries"))
        for body, sha, n, chars, best, mark, entries in zip(*columns, strict=True):
            rank = _rank(chars, best, mark)
            node = trie.find(body)
            if node.cell is not None:
                yield from out.add(cell=node.cell, **_entry(body, [n, rank, sha, entries]))
                continue
            if node.item is None:
                node.item = [0, rank, sha, array("q")]
            item = node.item
            item[0] += n
            item[1] = min(item[1], rank)
            item[3].extend(entries)
            trie.bytes += 8 * len(entries)
            if trie.bytes > budget:
                while trie.bytes > budget // 2 and (cut := trie.spill()):
                    path, texts, top = cut
                    place = hashlib.sha256(b"%d " % TaskContext.get().partitionId() + path).digest()
                    top.cell = int.from_bytes(place[:8], "big", signed=True)
                    for text, spilled in texts:
                        yield from out.add(cell=top.cell, **_entry(text, [*spilled[:3], spilled[3].tolist()]))
    if out:
        for _, (n, (_, none, best, mark), sha, entries) in trie.texts():
            for entry in entries:
                yield from out.add(entry=entry, keep=None if none else best, keep_row=mark, size=n, sha=sha)
        yield from out.out()


def owners(docs: DataFrame, doc_id: str = "doc_id", text: str = "text",
           scan_bytes: int = SCAN_BYTES, trie_bytes: int = TRIE_BYTES) -> DataFrame:
    """``id, keep_id, group_size, kept, sha256`` for every row of ``docs``.

    Texts are equal when they are the same without U+0020 and U+0009 to U+000D; a null
    text is empty.  The row with the most code points in its original text stays, of those
    the one with the least id (a null id comes last); of rows equal in both, one stays.  ``group_size`` counts
    rows, repeated ones too; ``sha256`` is that of the text without white space, in
    hexadecimal.  Other columns are not read; an empty table gives no rows.
    """
    kind = dict(docs.select(F.col(doc_id).alias("id")).dtypes)["id"]
    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(doc_id).alias("id"), F.monotonically_increasing_id().alias("row"),
                       F.length(body).cast("long").alias("chars"), body.cast("binary").alias("text"))
    schema = _ENTRY.format(kind=kind)
    scanned = stored(map_arrow(rows, lambda it: _enter(it, scan_bytes), f"id {kind}, row long, entry long, {schema}"), "entries")
    waiting, deal, found = scanned.filter("entry IS NULL").select(_names(schema)), ("length", "hash"), None
    while True:
        done = stored(map_arrow(waiting.repartition(*deal), lambda it: _own(it, trie_bytes), (
            f"entry long, keep {kind}, keep_row long, size long, cell long, {schema}")), "owners")
        owned = done.filter("entry IS NOT NULL").select("entry", "keep", "keep_row", "size", "sha")
        found = owned if found is None else found.unionByName(owned)
        waiting, deal = done.filter("cell IS NOT NULL").select("cell", *_names(schema)), ("cell",)
        if not waiting.head(1):
            break
    return scanned.filter("entry IS NOT NULL").select("id", "row", "entry").join(found, "entry").select(
        "id", F.col("keep").alias("keep_id"), F.col("size").alias("group_size"),
        (F.col("row") == F.col("keep_row")).alias("kept"), F.lower(F.hex("sha")).alias("sha256"))
