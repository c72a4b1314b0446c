"""Benchmark decontamination with a generalised suffix automaton.

The automaton of all normalised test items is built once for each block of items and
sent to the tasks; its size is bounded by ``block_words``. Documents are streamed
through it word by word: the state and the length of the longest suffix of what was read
that is also part of an item. A length of ``window`` or more means that the last
``window`` words are a window of an item; the items are those on the state whose strings
include that length. Items shorter than the window count as one window. More items than
one block holds make more passes over the documents, whose spans and items are merged by row before anything is judged or cut, so
the size of a block changes no result. An item longer than a block is cut into parts that overlap by a window less a word.

Defined results: null texts have no words; null items and items without words have no
window; repeated item ids count once; rows with a null item_id still mark words; texts are read whole, however long; repeated rows
are judged each; empty tables of documents give empty tables, without items no word is hit; other columns stay as they are, whatever their names.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, UPPER, free_name, slices, stored

#: ASCII bytes that are not a digit or letter separate words; A-Z become a-z.
NORMAL = bytes(ord(LOWER[UPPER.index(chr(c))]) if chr(c) in UPPER else c if c > 127 or chr(c).isalnum() else 32 for c in range(256))
JAVA_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BLOCK_WORDS = 100_000


def normal_words(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(NORMAL).split()


class Automaton:
    """Suffix automaton of word sequences, with what each state says about items."""

    def __init__(self, items: list[tuple[str | None, list[bytes]]], window: int):
        self.window = window
        self.words: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.len = [-1], [0]
        own: list[set] = [set()]
        whole: list[list[tuple[int, str | None]]] = [[]]
        for item, tokens in items:
            last = 0
            for t in tokens:
                last = self._grow(last, self.words.setdefault(t, len(self.words)), own, whole)
                own[last].add(item)
            if 0 < len(tokens) < window:
                whole[last].append((len(tokens), item))
        # Longest strings first: a state's items are also those of its suffixes.
        for v in sorted(range(1, len(self.len)), key=self.len.__getitem__, reverse=True):
            if self.len[v] > window or self.len[self.link[v]] >= window:
                own[self.link[v]] |= own[v]
        self.at_window = [-1] * len(self.len)
        self.short: list[tuple] = [()] * len(self.len)
        for v in sorted(range(1, len(self.len)), key=self.len.__getitem__):
            up = self.link[v]
            if self.len[v] >= window:
                self.at_window[v] = v if self.len[up] < window else self.at_window[up]
            self.short[v] = self.short[up] + tuple(whole[v])
        self.items = [frozenset(x) if n >= window else frozenset() for x, n in zip(own, self.len)]

    def _grow(self, last: int, c: int, own: list[set], whole: list) -> int:
        """Append word ``c`` after state ``last`` (0 starts an item); returns the state of the grown prefix."""
        nxt, link, length = self.next, self.link, self.len
        to = nxt[last].get(c)
        if to is not None and length[to] == length[last] + 1:
            return to
        if to is None:
            cur = self._state(length[last] + 1, {}, own, whole)
        p = last
        while to is None and p >= 0 and c not in nxt[p]:
            nxt[p][c] = cur
            p = link[p]
        if to is None and p < 0:
            link[cur] = 0
            return cur
        q = nxt[p][c]
        if length[q] == length[p] + 1:
            link[cur] = q
            return cur
        part = self._state(length[p] + 1, dict(nxt[q]), own, whole)
        link[part], link[q] = link[q], part
        while p >= 0 and nxt[p].get(c) == q:
            nxt[p][c] = part
            p = link[p]
        if to is not None:
            return part
        link[cur] = part
        return cur

    def _state(self, length: int, nxt: dict, own: list, whole: list) -> int:
        self.len.append(length)
        self.next.append(nxt)
        self.link.append(0)
        own.append(set())
        whole.append([])
        return len(self.len) - 1

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set]:
        """Hit spans [from, to) in order, merged where they touch, and the items met."""
        spans: list[list[int]] = []
        met: set = set()
        nxt, link, length, window = self.next, self.link, self.len, self.window
        at_window, short, items = self.at_window, self.short, self.items
        state = size = 0
        ids = map(self.words.get, words)
        for i, w in enumerate(ids):
            if w is None:
                state = size = 0
                continue
            to = nxt[state].get(w)
            while to is None and state:
                state = link[state]
                size = length[state]
                to = nxt[state].get(w)
            if to is None:
                continue
            state = to
            size += 1
            reach = 0
            if size >= window:
                reach = window
                met |= items[at_window[state]]
            if short[state]:
                for n, item in short[state]:
                    if n <= size:
                        met.add(item)
                        reach = max(reach, n)
            if reach:
                start = i + 1 - reach
                while spans and spans[-1][0] >= start:
                    spans.pop()
                if spans and spans[-1][1] >= start:
                    spans[-1][1] = i + 1
                else:
                    spans.append([start, i + 1])
        return [tuple(s) for s in spans], met


def item_blocks(items: DataFrame, item_col: str, text_col: str, block_words: int, window: int) -> Iterator[list[tuple[str | None, list[bytes]]]]:
    """Distinct items in blocks of about ``block_words`` words; one block at a time is held by the driver."""
    rows = items.select(F.col(item_col).cast("string").alias("i"), F.col(text_col).cast("string").cast("binary").alias("t")).where("t is not null").distinct()
    block, held = [], 0
    for r in rows.toLocalIterator():
        found = normal_words(bytes(r.t))
        for at in range(0, max(1, len(found) - window + 1) if found else 0, block_words):
            part = found[at:at + block_words + window - 1]
            if block and held + len(part) > block_words:
                yield block
                block, held = [], 0
            block.append((r.i, part))
            held += len(part)
    if block:
        yield block


_built: dict = {}


def automaton_of(block: list, key: str, window: int) -> Automaton:
    """The automaton of a block, built once in each Python worker; the last one is kept."""
    if key not in _built:
        _built.clear()
        _built[key] = Automaton(block, window)
    return _built[key]


def scan_block(rows: DataFrame, block: list, window: int) -> DataFrame:
    """``rows(rid, text)`` streamed through the automaton of one block; the automaton is built once in each Python worker."""
    sent, key = rows.sparkSession.sparkContext.broadcast(block), uuid.uuid4().hex
    rid = rows.schema["rid"].dataType.simpleString()
    kind = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sam = automaton_of(sent.value, key, window)
        for b in slices(batches):
            n, spans, met = [], [], []
            for t in b.column(1).cast(pa.binary()).to_pylist():
                found = normal_words(t)
                s, m = sam.scan(found)
                n.append(len(found))
                spans.append([{"a": x, "b": y} for x, y in s])
                met.append(sorted(x for x in m if x is not None))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(spans, kind), pa.array(met, pa.list_(pa.string()))], ["rid", "n_words", "spans", "items"])

    return rows.mapInArrow(run, f"rid {rid}, n_words long, spans array<struct<a:int,b:int>>, items array<string>")


def merged_scans(named: DataFrame, blocks: Iterator[list], window: int) -> DataFrame:
    """(rid, n_words, spans, items) of every row of ``named(rid, text)``, whose rid are distinct, over all blocks."""
    union = None
    for block in blocks:
        part = scan_block(named, block, window)
        union = part if union is None else union.unionAll(part)
    return union.groupBy("rid").agg(F.max("n_words").alias("n_words"), F.flatten(F.collect_list("spans")).alias("spans"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"))


def contamination(docs: DataFrame, items: DataFrame, window: int = 10, id_col: str = "doc_id", text_col: str = "text",
                  item_col: str = "item_id", item_text_col: str = "text", block_words: int = BLOCK_WORDS) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated, items) of every row of ``docs``.

    With one block of items the documents are read once and nothing is shuffled.
    """
    rows = docs.select(F.col(id_col).alias("rid"), F.col(text_col).cast("string").alias("text"))
    blocks = item_blocks(items, item_col, item_text_col, block_words, window)
    first, second = next(blocks, []), next(blocks, None)
    if second is None:
        out = scan_block(rows, first, window)
    else:  # rows need a stable name of their own: ids may repeat or be null
        kept = stored(rows.withColumn("row", F.monotonically_increasing_id()), "decontam")
        met = merged_scans(kept.select(F.col("row").alias("rid"), "text"), chain([first, second], blocks), window)
        out = kept.select(F.col("row"), F.col("rid").alias("own")).join(met, F.col("row") == F.col("rid")).select(F.col("own").alias("rid"), "n_words", "spans", "items")
    # Spans of several blocks may overlap: walk them by their start and count what is new.
    covered = F.aggregate(F.array_sort("spans"), F.struct(F.lit(0).alias("to"), F.lit(0).cast("long").alias("n")),
                          lambda s, x: F.struct(F.greatest(s["to"], x["b"]).alias("to"), (s["n"] + F.greatest(F.lit(0), x["b"] - F.greatest(s["to"], x["a"])).cast("long")).alias("n")))["n"]
    ids = F.array_sort("items")
    return (out.withColumn("n_hit", covered)
            .select(F.col("rid").alias("doc_id"), "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                    F.sha2(F.array_join(ids, ",").cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"), ids.alias("items")))


def decontaminate(docs: DataFrame, items: DataFrame, window: int = 10, max_share: float = 0.0, text_col: str = "text",
                  item_col: str = "item_id", item_text_col: str = "text", block_words: int = BLOCK_WORDS) -> DataFrame:
    """``docs`` without hit spans; rows whose hit words exceed ``max_share`` of their words go.

    With ``max_share`` 0 every contaminated row goes; with 1 only spans are cut. All columns stay. One block of items takes one pass and no shuffle.
    """
    out = docs.withColumn(text_col, F.col(text_col).cast("string"))
    blocks, at = item_blocks(items, item_col, item_text_col, block_words, window), out.columns.index(text_col)
    first, second = next(blocks, []), next(blocks, None)
    if not first:
        return out
    if second is None:
        return out.mapInArrow(cutter(docs.sparkSession.sparkContext.broadcast(first), uuid.uuid4().hex, window, max_share, at), out.schema)
    row, spans, rid = free_name(out, "__row", "__spans", "__rid")
    kept = stored(out.withColumn(row, F.monotonically_increasing_id()), "decontaminate")
    met = merged_scans(kept.select(F.col(row).alias("rid"), F.col(text_col).alias("text")), chain([first, second], blocks), window)
    joined = kept.join(met.select(F.col("rid").alias(rid), F.col("spans").alias(spans)), F.col(row) == F.col(rid)).select(*out.columns, spans)
    return joined.mapInArrow(cutter(None, "", window, max_share, at), out.schema)


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans of several blocks in order, joined where they touch."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def cutter(sent, key: str, window: int, max_share: float, at: int):
    """Rows whose hit words are no more than ``max_share``, their text in column ``at`` without its hit spans; the spans come from the sent block, or from a last column."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sam = automaton_of(sent.value, key, window) if sent is not None else None
        for b in slices(batches):
            texts, stays, cut = b.column(at).cast(pa.binary()).to_pylist(), [], False
            known = [[(x["a"], x["b"]) for x in s] for s in b.column(b.num_columns - 1).to_pylist()] if sam is None else None
            for i, t in enumerate(texts):
                found = normal_words(t)
                spans = merged(known[i]) if sam is None else sam.scan(found)[0]
                stays.append(sum(y - x for x, y in spans) <= max_share * max(1, len(found)))
                if spans and stays[-1]:
                    texts[i], cut = cut_spans(t, spans), True
            if sam is None:
                b = pa.RecordBatch.from_arrays(b.columns[:-1], b.schema.names[:-1])
            if cut:
                b = b.set_column(at, b.schema.field(at), pa.array(texts, pa.binary()).cast(b.schema.field(at).type))
            yield b.filter(pa.array(stays, pa.bool_()))

    return run


def cut_spans(raw: bytes, spans: list[tuple[int, int]]) -> bytes:
    """The text without the given spans of normalised words; separators before a span stay."""
    places, start = [], None
    for i, c in enumerate(raw.translate(NORMAL) + b" "):
        if c != 32 and start is None:
            start = i
        elif c == 32 and start is not None:
            places.append((start, i))
            start = None
    out, at = [], 0
    for a, b in spans:
        out.append(raw[at:places[a][0]])
        at = places[b - 1][1]
    return b"".join(out) + raw[at:]
