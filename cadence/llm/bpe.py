"""BPE encoding and decoding with content-defined chunk reuse.

A rolling hash over the last 32 bytes cuts each text where its top bits are zero, so equal passages are cut alike wherever they stand.
A chunk's core runs from its first ASCII white space to its last. The tokenizer drops white space and no piece spans it, so the core's ids are
the same in every text, and a cut there is exact. What lies between two cores, the join, holds a chunk's ragged end and the next one's ragged
start: it is encoded anew as one string, and it grows over chunks without white space until both its ends agree with a core.

1. Every task counts the hashes of its cores; a sum by hash finds those that occur twice or more.
2. These go into a Bloom filter of ``FILTER_BITS`` bits, made by bitmap aggregates, which is what is broadcast: its size is fixed. A false positive
   makes a core travel for nothing, and changes no result.
3. Texts without a shared core are encoded where they are, and nothing of them is shuffled.
4. The others send their joins (encoded) and name their shared cores; the text of one goes once for each slice of rows. A core is encoded once where its
   rows meet, and its ids go to the texts, which are put together in order. A core that more than ``HOT`` texts of a slice hold is dealt
   by slice, so no task gets all of a hot passage.

Ids travel as two bytes each where the vocabulary allows. Within a task, words (runs without ASCII white space) are remembered, ``MEMO`` and those of a slice at most.

Defined results: null and empty texts have no ids; very long texts are read whole; rows that are equal in id and text have equal results, a row for
each; rows without an id keep a null id; empty tables give empty tables; other columns are not read, whatever their names. A tokenizer that keeps white
space is refused.
"""

from __future__ import annotations

import os
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices

CHUNK_BITS = 8  #: a cut every 256 bytes in the mean
LEAST = 64  #: bytes of a chunk at least
CORE = 32  #: bytes of a core at least; shorter ones belong to the join
FILTER_BITS = 1 << 27
PROBES = 4
HOT = 4
MEMO = 1 << 18
SPACES = b"\t\n\x0b\x0c\r "
TO_BLANK = bytes.maketrans(SPACES, b" " * len(SPACES))
STRIDES = (1, 2, 4, 8, 16)  #: a window of 32 bytes by doubling
BYTE_HASH = np.array([xxhash.xxh64_intdigest(bytes([b]), seed=7) for b in range(256)], np.uint64)


def path(name: str = "word_bpe_49k.json") -> str:
    """Where the public tokenizer ``name`` is kept."""
    import public_tokenizers

    return public_tokenizers.path(name)


def cuts(data: bytes) -> list[int]:
    """Ends of the chunks of a text."""
    b = np.frombuffer(data, np.uint8)
    h = BYTE_HASH[b]
    for s in STRIDES:
        n = h.copy()
        n[s:] += h[:-s] << np.uint64(s)
        h = n
    ends, last = [], 0
    for c in (np.flatnonzero(h >> np.uint64(64 - CHUNK_BITS) == 0) + 1).tolist():
        if c - last >= LEAST:
            ends.append(c)
            last = c
    if last < len(data):
        ends.append(len(data))
    return ends


def cores(data: bytes) -> list[tuple[int, int, bytes]]:
    """(start, end, 128-bit hash) of the core of every chunk that has one; ``data`` has blanks for all ASCII white space."""
    out, start = [], 0
    for end in cuts(data) if len(data) >= CORE else ():
        a, z = data.find(b" ", start, end), data.rfind(b" ", start, end)
        if z - a >= CORE:
            out.append((a, z, xxhash.xxh3_128_digest(data[a:z])))
        start = end
    return out


def clean(text: str | None) -> bytes:
    return (text or "").encode().translate(TO_BLANK)


def places(h: np.ndarray) -> np.ndarray:
    """The filter's bits of hashes, PROBES a row."""
    m = np.uint64(FILTER_BITS - 1)
    one, two = h & m, ((h >> np.uint64(FILTER_BITS.bit_length() - 1)) & m) | np.uint64(1)
    return (one[:, None] + two[:, None] * np.arange(PROBES, dtype=np.uint64)) & m


def head(hashed: bytes) -> int:
    return int.from_bytes(hashed[:8], "little", signed=True)


class Encoder:
    """A tokenizer in a worker, with the ids of the words it has met as bytes."""

    def __init__(self, spec: str):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark deals the work
        self.tok = Tokenizer.from_str(spec)
        self.tok.no_padding()
        self.tok.no_truncation()
        self.kind = id_kind(self.tok)
        added = self.tok.get_added_tokens_decoder().values()
        self.stop = next((t.content for t in added if t.special and not t.normalized), None)
        self.specials = [t.content.lower().encode() for t in added]
        self.risky = {s[:1] for s in self.specials}
        suffix = getattr(self.tok.model, "end_of_word_suffix", None)
        self.names = np.array([self.tok.id_to_token(i) or "" for i in range(self.tok.get_vocab_size())], object)
        self.ends = np.array([bool(suffix) and t.endswith(suffix) for t in self.names])
        ids = lambda t: self.tok.encode(t, add_special_tokens=False).ids
        self.marks = b"".join(c.encode() for c in ".,;:!?" if ids(f"ab{c}{c}") == ids("ab") + ids(c + c))  # marks after a word that are a piece of their own
        upper = "".join(map(chr, range(65, 91)))
        self.folds = ids(upper) == ids(upper.lower()) and all(ids(c) == ids(c.lower()) for c in upper)
        self.plain = None  # for lower-case letters of ASCII, which a normalizer that folds leaves alone
        if self.folds and self.ends.any():
            self.plain = Tokenizer.from_str(spec)
            self.plain.normalizer = None
            self.plain.no_padding()
            self.plain.no_truncation()
        self.memo: dict[bytes, bytes] = {}

    def keep(self, words: list[bytes], ids: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> None:
        data, size = ids.astype(self.kind).tobytes(), self.kind.itemsize
        self.memo.update(zip(words, map(data.__getitem__, map(slice, (starts * size).tolist(), (ends * size).tolist()))))

    def fill(self, words: list[bytes]) -> None:
        """Ids of new words; one of letters and marks after them is put together from both."""
        stems = {w: w.rstrip(self.marks) for w in words} if self.marks else {}
        whole = {w: t for w, t in stems.items() if len(t) < len(w) and t.isalpha()}
        parts = set(whole.values()).union(w[len(t):] for w, t in whole.items()).union(w for w in words if w not in whole)
        self.encode(list(parts.difference(self.memo)))
        get = self.memo.__getitem__
        self.memo.update((w, get(t) + get(w[len(t):])) for w, t in whole.items())

    def encode(self, words: list[bytes]) -> None:
        """Ids of many words in a call.

        Words of letters are one piece each, so the ends of pieces part them (if there are as many); small letters of ASCII need no normalizer. Others are
        kept apart by a special token between them; those that may hold one are encoded alone.
        """
        small = [w for w in words if w.isalpha() and w.islower()] if self.plain else []
        letters = [w for w in words if not w.isascii() and w.decode().isalpha()] if self.ends.any() else []
        for tok, of in ((self.plain, small), (self.tok, letters)):
            for i in range(0, len(of), 1000):
                some = of[i:i + 1000]
                ids = np.array(tok.encode_batch_fast([b" ".join(some).decode()], add_special_tokens=False)[0].ids)
                ends = np.flatnonzero(self.ends[ids]) + 1
                if len(ends) == len(some):
                    self.keep(some, ids, np.append(0, ends[:-1]), ends)
        rest = [w for w in words if w not in self.memo]
        odd = {w for w in rest if not self.stop or any(c in w for c in self.risky)}
        plain = [w for w in rest if w not in odd]
        for i in range(0, len(plain), 500):
            some = plain[i:i + 500]
            ids = np.array(self.tok.encode_batch_fast([self.stop.join(map(bytes.decode, some))], add_special_tokens=False)[0].ids, np.int64)
            stops = np.flatnonzero(ids == self.tok.token_to_id(self.stop))
            self.keep(some, ids, np.append(0, stops + 1), np.append(stops, len(ids)))
        odd = sorted(odd)
        for w, e in zip(odd, self.tok.encode_batch_fast([w.decode() for w in odd], add_special_tokens=False)):
            self.memo[w] = np.array(e.ids, self.kind).tobytes()

    def folded(self, text: bytes) -> bytes:
        """With small letters of ASCII, which have the ids of capitals; not where that may make the name of a special token."""
        low = text.lower() if self.folds else text
        return text if any(s in low for s in self.specials) else low

    def __call__(self, texts: list[bytes]) -> list[bytes]:
        """Ids of texts that are cut at white space, as bytes."""
        split = [self.folded(t).split(b" ") for t in texts]
        if len(self.memo) > MEMO:
            self.memo.clear()
        new = set().union(*split).difference(self.memo)
        if new:
            self.fill(list(new))
        get = self.memo.__getitem__
        return [b"".join(map(get, ws)) for ws in split]


_encoders: dict[str, Encoder] = {}


def encoder(spec: str) -> Encoder:
    """The worker's encoder, made once; another tokenizer takes its place."""
    if spec not in _encoders:
        _encoders.clear()
        _encoders[spec] = Encoder(spec)
    return _encoders[spec]


def id_kind(tok) -> np.dtype:
    return np.dtype("<u2" if tok.get_vocab_size() <= 1 << 16 else "<u4")


def checked(spec: str) -> None:
    """Refuse a tokenizer whose ids depend on white space."""
    from tokenizers import Tokenizer

    tok = Tokenizer.from_str(spec)
    ids = lambda s: tok.encode(s, add_special_tokens=False).ids
    if any(ids(chr(c)) for c in SPACES) or ids("a b\tab") != ids("a") + ids("b") + ids("ab"):
        raise ValueError("the tokenizer must drop white space")


def counted(batches: Iterable) -> Iterator:
    """(h, n): cores of each slice by the first 64 bits of their hashes."""
    for b in slices(batches):
        n = Counter(head(h) for t in b.column(0).to_pylist() for _, _, h in cores(clean(t)))
        yield pa.RecordBatch.from_arrays([pa.array(list(n), pa.int64()), pa.array(list(n.values()), pa.int64())], ["h", "n"])


def shared_filter(docs: DataFrame, text_col: str) -> bytes | None:
    """Bits of a Bloom filter of the cores that occur twice or more; None if there are none."""
    repeated = docs.select(F.col(text_col).cast("string")).mapInArrow(counted, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).where("n > 1")
    width = FILTER_BITS.bit_length() - 1
    one, two = F.col("h").bitwiseAND(F.lit(FILTER_BITS - 1)), F.shiftrightunsigned("h", width).bitwiseAND(F.lit(FILTER_BITS - 1)).bitwiseOR(F.lit(1))
    spot = F.explode(F.array(*[(one + two * i).bitwiseAND(F.lit(FILTER_BITS - 1)) for i in range(PROBES)])).alias("p")
    rows = repeated.select(spot).groupBy(F.shiftright("p", 15).alias("block")).agg(F.bitmap_construct_agg(F.col("p").bitwiseAND(F.lit(32767))).alias("bits"))
    bits = None
    for r in rows.collect():  # FILTER_BITS / 8 bytes at most
        if bits is None:
            bits = np.zeros(FILTER_BITS // 8, np.uint8)
        bits[r["block"] * 4096:(r["block"] + 1) * 4096] = np.frombuffer(r["bits"], np.uint8)
    return None if bits is None else bits.tobytes()


def held(bits: np.ndarray | None, found: list[tuple[int, int, bytes]]) -> list[tuple[int, int, bytes]]:
    """The cores that the filter holds."""
    if bits is None or not found:
        return []
    p = places(np.array([head(h) for _, _, h in found], np.int64).view(np.uint64))
    yes = ((bits[(p >> np.uint64(3)).astype(np.int64)] >> (p & np.uint64(7)).astype(np.uint8)) & 1).all(axis=1)
    return [c for c, y in zip(found, yes.tolist()) if y]


def lists(ids: list[bytes], kind: np.dtype) -> pa.Array:
    """An Arrow column of lists of ids."""
    ends = np.concatenate([[0], np.cumsum([len(i) // kind.itemsize for i in ids])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(ids), kind).astype(np.int32)))


def in_place(spec, bits):
    """Texts without a shared core, encoded where they are: (id, ids)."""
    def run(batches: Iterable) -> Iterator:
        encode, seen = encoder(spec.value), None if bits is None else np.frombuffer(bits.value, np.uint8)
        for b in slices(batches):
            texts = [clean(t) for t in b.column(1).to_pylist()]
            whole = [i for i, t in enumerate(texts) if seen is None or not held(seen, cores(t))]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(whole, pa.int64())), lists(encode([texts[i] for i in whole]), encode.kind)], ["id", "ids"])

    return run


PARTS = "key long, hash binary, core binary, uid binary, pos int, copies int, id long, ids binary"


def parts(spec, bits):
    """The other texts as rows: joins with their ids, and shared cores by hash; a core's bytes go with its first row of a slice. Equal rows of a slice go once."""
    def run(batches: Iterable) -> Iterator:
        encode, seen = encoder(spec.value), np.frombuffer(bits.value, np.uint8)
        for b in slices(batches):
            rows, joins, met, copies = [], [], Counter(), Counter()
            for doc, text in zip(b.column(0).to_pylist(), map(clean, b.column(1).to_pylist())):
                found = held(seen, cores(text))
                if not found:
                    continue
                uid = xxhash.xxh3_128_digest(f"{doc}\0".encode() + text)
                copies[uid] += 1
                if copies[uid] > 1:
                    continue
                at = 0
                for k, (a, z, h) in enumerate([*found, (len(text), len(text), b"")]):
                    joins.append(text[at:a])
                    rows.append((head(uid), None, None, uid, 2 * k, doc))
                    if h:
                        rows.append((head(h), h, text[a:z], uid, 2 * k + 1, doc))
                        met[h] += 1
                    at = z
            done, sent, salt = iter(encode(joins)), set(), head(rows[0][3]) if rows else 0
            out = []
            for key, h, core, uid, pos, doc in rows:
                if h is None:
                    out.append((key, None, None, uid, pos, copies[uid], doc, next(done)))
                else:
                    out.append((key ^ salt if met[h] > HOT else key, h, None if h in sent else core, uid, pos, copies[uid], doc, None))
                    sent.add(h)
            columns = list(zip(*out)) or [()] * 8
            kinds = (pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.int32(), pa.int32(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["key", "hash", "core", "uid", "pos", "copies", "id", "ids"])

    return run


def encoded_once(spec):
    """Rows sorted by (hash, core first): each core is encoded where its first row stands, and all rows get its ids."""
    def run(batches: Iterable) -> Iterator:
        encode, last, ids = encoder(spec.value), None, b""
        for b in slices(batches, 2000):
            hashes, texts, own = b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(6).to_pylist()
            fresh = {}
            for h, t in zip(hashes, texts):
                if h is not None and h != last and h not in fresh:
                    fresh[h] = t
            known = dict(zip(fresh, encode(list(fresh.values()))))
            if last is not None:
                known[last] = ids
            out = [o if h is None else known[h] for h, o in zip(hashes, own)]
            if hashes and hashes[-1] is not None:
                last, ids = hashes[-1], known[hashes[-1]]
            yield pa.RecordBatch.from_arrays([b.column(2), b.column(3), b.column(4), b.column(5), pa.array(out, pa.binary())], ["uid", "pos", "copies", "id", "ids"])

    return run


def put_together(kind: np.dtype):
    """Rows sorted by (uid, pos) to (id, ids, copies); equal texts of several slices are told by their first row."""
    def run(batches: Iterable) -> Iterator:
        uid, doc, copies, pos, pieces, done = None, None, 0, -1, [], []

        def made() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.int64()), lists([d[1] for d in done], kind), pa.array([d[2] for d in done], pa.int32())], ["id", "ids", "copies"])

        for b in slices(batches, 2000):
            for u, p, n, d, i in zip(*(b.column(k).to_pylist() for k in range(5))):
                if u != uid:
                    if uid is not None:
                        done.append((doc, b"".join(pieces), copies))
                    uid, doc, copies, pos, pieces = u, d, 0, -1, []
                if p == 0:
                    copies += n
                if p != pos:
                    pieces.append(i)
                    pos = p
            if len(done) >= 200:
                yield made()
                done = []
        if uid is not None:
            done.append((doc, b"".join(pieces), copies))
        if done:
            yield made()

    return run


def encode(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids) of every row, as the tokenizer in the file ``tokenizer`` encodes its whole text without adding special tokens."""
    from tokenizers import Tokenizer

    with open(tokenizer, encoding="utf-8") as f:
        text = f.read()
    checked(text)
    sc = docs.sparkSession.sparkContext
    spec, rows = sc.broadcast(text), docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    bits = shared_filter(docs, text_col)
    bits = None if bits is None else sc.broadcast(bits)
    out = rows.mapInArrow(in_place(spec, bits), "id long, ids array<int>")
    if bits is not None:
        sent = rows.mapInArrow(parts(spec, bits), PARTS).repartition("key").sortWithinPartitions("hash", F.col("core").isNull())
        pieces = sent.select("hash", "core", "uid", "pos", "copies", "id", "ids").mapInArrow(encoded_once(spec), "uid binary, pos int, copies int, id long, ids binary")
        whole = pieces.repartition("uid").sortWithinPartitions("uid", "pos").mapInArrow(put_together(id_kind(Tokenizer.from_str(text))), "id long, ids array<int>, copies int")
        out = out.unionAll(whole.select("id", "ids", F.explode(F.sequence(F.lit(1), "copies")).alias("copy")).drop("copy"))
    return out.withColumnRenamed("id", "doc_id")


def decode(encoded: DataFrame, tokenizer: str) -> DataFrame:
    """``encoded(doc_id, ids)`` with ``decoded``, the tokenizer's text of the ids, special tokens included; null ids give null."""
    with open(tokenizer, encoding="utf-8") as f:
        spec = encoded.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterable) -> Iterator:
        tok, names = encoder(spec.value).tok, encoder(spec.value).names
        for b in slices(batches, 200):
            of = b.column(1)
            ids, ends = of.values.to_numpy(zero_copy_only=False), of.offsets.to_pylist()  # a list of numbers a text; Arrow's own way to Python is slow
            # Without a decoder the library joins tokens by blanks.
            text = (lambda part: " ".join(names[part].tolist())) if tok.decoder is None else (lambda part: tok.decode(part.tolist(), skip_special_tokens=False))
            texts = [text(ids[a:z]) if ok else None for a, z, ok in zip(ends, ends[1:], of.is_valid().to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0), of, pa.array(texts, pa.string())], ["doc_id", "ids", "decoded"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, ids array<int>, decoded string")
