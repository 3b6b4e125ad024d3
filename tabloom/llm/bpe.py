"""Byte-level BPE: exact encoding with reuse of content-defined chunks; decoding."""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import HashSet64, hand_back, stage, utf8

#: Between a character that is surely no white space and one that surely is, every
#: byte-level pre-tokenizer of this kind ends a piece, whatever stands around.
_SEAM = re.compile(r"(?<=[^\s\u180e])(?=[ \t-\r])")
_SEAM_BYTES = re.compile(rb"(?<=[!-~])(?=[ \t-\r])")
#: White space other than the space and the line feed.
_RARE_SPACE = re.compile("[\t\r\x0b\x0c\x1c-\x1f\x85\xa0\u1680\u180e\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
#: A run of letters (letters in every Unicode version), then marks: two pre-tokens.
_PLAIN = re.compile("( ?[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]+)([.,;:!?&%$#*|]*)")


def _byte_letters() -> str:
    """The letter that stands for each byte in the vocabulary of a byte-level BPE:
    printable Latin-1 bytes stand for themselves, the others follow from 256 on."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(256, 512))
    return "".join(chr(b if b in printable else next(spare)) for b in range(256))


class Encoder(dict):
    """ids of whole texts, equal to ``Tokenizer.encode(text, add_special_tokens=False)``.

    Texts are cut at seams, where tokens never cross. The dict holds the ids of the
    pieces met so far; a new piece goes to the library. It is emptied when it holds
    ``limit`` pieces, so memory stays flat; pieces over 64 characters aren't kept.
    """

    def __init__(self, path: str, limit: int = 800_000):
        import json

        from tokenizers import Tokenizer
        super().__init__()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        kind = spec.get("pre_tokenizer") or {}
        if kind.get("type") != "ByteLevel" or not kind.get("use_regex", True) or kind.get("add_prefix_space") \
                or spec.get("normalizer") or any(t["lstrip"] or t["rstrip"] or t["single_word"] or re.search(r"\s", t["content"])
                                                 or _PLAIN.fullmatch(t["content"]) for t in spec["added_tokens"]):
            raise ValueError(f"{path}: only plain byte-level BPE is encoded here")
        self.limit = limit
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.tokenize = self.tokenizer.model.tokenize
        self.letters = {b: c for b, c in enumerate(_byte_letters())}

    def _run(self, pre_token: str) -> bytes:
        letters = pre_token.encode().decode("latin-1").translate(self.letters)
        return array("I", [t.id for t in self.tokenize(letters)]).tobytes()

    def __missing__(self, piece: str) -> bytes:
        plain = _PLAIN.fullmatch(piece)
        if plain is None:
            ids = np.array(self.tokenizer.encode(piece, add_special_tokens=False).ids, dtype="<u4").tobytes()
        else:
            word, marks = plain.groups()
            ids = (self.get(word) or self._run(word)) + self[marks] if marks else self._run(word)
        if len(piece) <= 64:
            if len(self) >= self.limit:
                self.clear()
            self[piece] = ids
        return ids

    @staticmethod
    def split(text: str) -> list[str]:
        if "\0" in text or "  " in text or "\n " in text or _RARE_SPACE.search(text):
            return _SEAM.split(text)
        return text.replace(" ", "\0 ").split("\0")    # no white space stands before a space: each is a seam

    def encode(self, texts: list[str]) -> list[bytes]:
        """ids of each text as little-endian unsigned 32-bit integers."""
        look = self.__getitem__
        return [b"".join(map(look, self.split(t))) for t in texts]


@lru_cache(maxsize=1)
def encoder(path: str, limit: int = 800_000) -> Encoder:
    """One encoder for each Python worker, kept from task to task."""
    return Encoder(path, limit)


@lru_cache(maxsize=2)
def _vocabulary(path: str) -> list[bytes | None]:
    from tokenizers import Tokenizer
    tokenizer = Tokenizer.from_file(path)
    special = tokenizer.get_added_tokens_decoder()
    byte = {c: b for b, c in enumerate(_byte_letters())}
    words: list[bytes | None] = [None] * tokenizer.get_vocab_size(with_added_tokens=True)
    for word, i in tokenizer.get_vocab(with_added_tokens=True).items():
        words[i] = word.encode() if i in special else bytes(byte[c] for c in word)
    return words


def decode_ids(ids: bytes, path: str) -> str:
    """Text of little-endian 32-bit ids, special tokens kept, as the library's
    decode: bytes that are no UTF-8 become U+FFFD."""
    words = _vocabulary(path)
    return b"".join([words[i] for i in np.frombuffer(ids, dtype="<u4").tolist()]).decode("utf-8", "replace")


# --- content-defined chunks --------------------------------------------------

_WINDOW_STEPS = (1, 2, 4, 8, 16)           # a rolling window of 32 bytes
_FACTOR = 0x9E3779B1
_TABLE = (np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(31)).astype(np.uint32)


def chunk_ends(text: bytes, bits: int = 9, least: int = 64) -> list[int]:
    """End of every chunk: after a byte whose rolling hash (over 32 bytes) has
    ``bits`` high zero bits, at a character's end, ``least`` bytes or more apart."""
    n = len(text)
    if n <= least:
        return [n] if n else []
    b = np.frombuffer(text, dtype=np.uint8)
    h = _TABLE[b]
    for w in _WINDOW_STEPS:
        if w >= n:
            break
        h = np.concatenate((h[:w], h[w:] + h[:-w] * np.uint32(pow(_FACTOR, w, 1 << 32))))
    at = np.flatnonzero(h >> np.uint32(32 - bits) == 0) + 1
    at = at[at < n]
    at = at[(b[at] & 0xC0) != 0x80]
    ends, last = [], 0
    while True:
        k = int(np.searchsorted(at, last + least))
        if k == len(at):
            return [*ends, n]
        last = int(at[k])
        ends.append(last)


def _chunks(text: bytes) -> list[tuple[int, int, bytes]]:
    """(key, key, chunk) of a text: the key is a 128-bit cryptographic hash."""
    from hashlib import blake2b
    out, start = [], 0
    for end in chunk_ends(text):
        chunk = text[start:end]
        d = blake2b(chunk, digest_size=16).digest()
        out.append((int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True), chunk))
        start = end
    return out


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from collections import Counter
    for batch in batches:
        n = Counter()
        for x in batch.column("text"):
            n.update((a, b) for a, b, _ in _chunks(x.as_py()))
        keys = list(n)
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.int64()), pa.array([k[1] for k in keys], pa.int64()),
                                          pa.array(list(n.values()), pa.int64())], names=["k1", "k2", "n"])


def _with_shared(maybe, wanted: bool, then, path: str):
    """Hand on only the documents that hold (or don't hold) a chunk that may be shared."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, owner = [], []
            for i, x in enumerate(batch.column("text")):
                mine = [a for a, _, _ in _chunks(x.as_py())]
                keys += mine
                owner += [i] * len(mine)
            hit = np.zeros(len(batch), dtype=bool)
            hit[np.array(owner, dtype=np.int64)[maybe.value.maybe(np.array(keys, dtype=np.int64))]] = True
            kept = batch.filter(pa.array(hit == wanted))
            if len(kept):
                yield from then(kept)
        forget(path)
    return run


def forget(path: str) -> None:
    """At a task's end: an idle worker keeps the tokenizer, but no pieces."""
    encoder(path, _MEMO).clear()
    hand_back()


#: Pieces that a worker of ``encode`` remembers: four workers of an executor may each hold so many.
_MEMO = 300_000


def _groups(column, most: int = 4 << 20) -> Iterator[tuple[int, int]]:
    """(first row, rows) of stretches of a binary column with about ``most`` bytes each."""
    sizes = np.array([len(x.as_buffer()) if x.is_valid else 0 for x in column], dtype=np.int64)
    part = np.cumsum(sizes) // most
    starts = np.flatnonzero(np.diff(part, prepend=-1))
    return zip(starts.tolist(), np.diff(starts, append=len(sizes)).tolist())


def _encode_whole(path: str):
    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for at, n in _groups(batch.column("text")):
            some = batch.slice(at, n)
            ids = encoder(path, _MEMO).encode([x.as_py().decode() for x in some.column("text")])
            yield pa.RecordBatch.from_arrays([some.column("doc_id"), pa.array(ids, pa.binary())], names=["doc_id", "ids"])
    return run


def _maybe_shared(maybe, text: bytes) -> list[tuple[int, int, int, bytes]]:
    """(number, key, key, chunk) of the chunks that the bit table can't rule out."""
    chunks = _chunks(text)
    hit = maybe.value.maybe(np.array([a for a, _, _ in chunks], dtype=np.int64)) if chunks else ()
    return [(i, *chunks[i]) for i in np.flatnonzero(hit).tolist()]


def _layout(maybe):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(r, i, a, b) for r, x in zip(batch.column("row").to_pylist(), batch.column("text"))
                    for i, a, b, _ in _maybe_shared(maybe, x.as_py())]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], names=["row", "pos", "k1", "k2"])
    return run


def _chunk_texts(maybe):
    """Every chunk that may be shared, once per batch, however often it stands there."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = {(a, b): c for x in batch.column("text") for _, a, b, c in _maybe_shared(maybe, x.as_py())}
            if found:
                yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in found], pa.int64()), pa.array([k[1] for k in found], pa.int64()),
                                                  pa.array(list(found.values()), pa.binary())], names=["k1", "k2", "chunk"])
    return run


def _encode_chunks(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, probes, cores = [], [], []
            for a, b, x in zip(batch.column("k1").to_pylist(), batch.column("k2").to_pylist(), batch.column("chunk")):
                chunk = x.as_py()
                seams = [m.start() for m in _SEAM_BYTES.finditer(chunk)]
                if len(seams) < 2:
                    continue                       # nothing inside that holds in every context
                rows.append((a, b, seams[0], seams[1], len(chunk) - seams[-1]))
                probes.append(chunk[seams[0]:seams[1]].decode())
                cores.append(chunk[seams[1]:seams[-1]].decode())
            if rows:
                ids = encoder(path, _MEMO).encode(probes + cores)
                yield pa.RecordBatch.from_arrays(
                    [*[pa.array(c, pa.int64()) for c in zip(*rows)], pa.array(ids[:len(rows)], pa.binary()), pa.array(ids[len(rows):], pa.binary())],
                    names=["k1", "k2", "head", "probe_end", "tail", "probe", "core"])
        forget(path)
    return run


def join_chunks(text: bytes, known: dict[int, dict], encode) -> bytes:
    """ids of a text from the chunks whose ids are known, by chunk number.

    Between two reused chunks the text from the last seam of the one to the first
    seam of the other is encoded anew, with the next piece (the probe) behind it.
    Agreement means that the new ids end with the probe's own; then the rest of the
    chunk's ids follow. Without agreement the chunk is encoded with the others
    around it, so the stretch encoded anew grows until the next chunk agrees.
    """
    out, pending, start = [], [], 0
    for number, end in enumerate(chunk_ends(text)):
        chunk, c = text[start:end], known.get(number)
        start = end
        if c is not None:
            ids = encode(b"".join([*pending, chunk[:c["probe_end"]]]))
            if ids.endswith(c["probe"]):
                out += [ids, c["core"]]
                pending = [chunk[len(chunk) - c["tail"]:]]
                continue
        pending.append(chunk)
    return b"".join([*out, encode(b"".join(pending))])


def _assemble(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def encode(piece: bytes) -> bytes:
            return encoder(path, _MEMO).encode([piece.decode()])[0]
        for batch in batches:
            for at, n in _groups(batch.column("text")):
                some = batch.slice(at, n)
                out = [join_chunks(x.as_py(), {c["pos"]: c for c in found.as_py() or []}, encode)
                       for x, found in zip(some.column("text"), some.column("found"))]
                yield pa.RecordBatch.from_arrays([some.column("doc_id"), pa.array(out, pa.binary())], names=["doc_id", "ids"])
        forget(path)
    return run


def encode(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids): ids of every whole text as little-endian unsigned 32-bit
    integers, as the tokenizers library gives them for the byte-level BPE file at
    ``path`` with add_special_tokens=False.

    Texts are cut into chunks by a rolling hash. Chunks met twice or more in the
    table are encoded once, and documents that hold one are put together from them
    (``join_chunks``); text between them, and documents without any, is encoded
    where it stands, so it never moves. A bit table of fixed size (8 MB) sorts
    documents that may hold a shared chunk from those that surely don't; the
    joins that follow are exact. Null and empty texts have no ids, repeated rows
    come back repeated, further columns are ignored, an empty table stays empty.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), utf8().alias("text"))
    shared = stage(texts.select("text").mapInArrow(_keys, "k1 long, k2 long, n long")
                   .groupBy("k1", "k2").agg(F.sum("n").alias("n")).where("n > 1").select("k1", "k2"))
    maybe = spark.sparkContext.broadcast(HashSet64.of(shared, "k1"))
    alone = texts.mapInArrow(_with_shared(maybe, False, _encode_whole(path), path), "doc_id long, ids binary")
    joined = stage(texts.mapInArrow(_with_shared(maybe, True, lambda batch: [batch], path), "doc_id long, text binary")
                   .withColumn("row", F.monotonically_increasing_id()))
    chunks = (joined.select("text").mapInArrow(_chunk_texts(maybe), "k1 long, k2 long, chunk binary")
              .join(shared, ["k1", "k2"], "left_semi").groupBy("k1", "k2").agg(F.first("chunk").alias("chunk")))
    known = stage(chunks.mapInArrow(_encode_chunks(path), "k1 long, k2 long, head long, probe_end long, tail long, "
                                                          "probe binary, core binary"))
    found = (joined.select("row", "text").mapInArrow(_layout(maybe), "row long, pos long, k1 long, k2 long")
             .join(known, ["k1", "k2"])
             .groupBy("row").agg(F.collect_list(F.struct("pos", "head", "probe_end", "tail", "probe", "core")).alias("found")))
    together = (joined.join(found, "row", "left").select("doc_id", "text", "found")
                .mapInArrow(_assemble(path), "doc_id long, ids binary"))
    return alone.unionByName(together)


def _decode(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, n in _groups(batch.column("ids")):
                some = batch.slice(at, n)
                texts = [decode_ids(x.as_py() or b"", path) for x in some.column("ids")]
                yield pa.RecordBatch.from_arrays([*some.columns, pa.array(texts, pa.string())], names=[*batch.schema.names, "decoded"])
        hand_back()
    return run


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """Add ``decoded``, the text of ``ids``; null ids give the empty text."""
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema.fields)
    return encoded.mapInArrow(_decode(path), kinds + ", decoded string")


def counted(encoded: DataFrame) -> DataFrame:
    """Add ``n_tokens``, the number of ids."""
    return encoded.withColumn("n_tokens", F.expr("cast(octet_length(ids) div 4 as long)"))
