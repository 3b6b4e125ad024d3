import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from tabloom.llm import token_store as T
from tabloom.llm.common import shared_filesystem


def test_round_trip(spark, odd_docs, no_docs, bpe_file):
    library = Tokenizer.from_file(bpe_file)
    got = T.read_tokens(T.write_tokens(odd_docs, bpe_file, end_id=0)).collect()
    want = sorted((r.doc_id is not None, r.doc_id or 0, library.encode(r.text or "", add_special_tokens=False).ids + [0]) for r in odd_docs.collect())
    assert sorted((r.doc_id is not None, r.doc_id or 0, np.frombuffer(r.ids, dtype="<u4").tolist()) for r in got) == want
    in_order = sorted(got, key=lambda r: r.start)
    assert [r.doc_id is not None and r.doc_id for r in in_order] == sorted(r.doc_id is not None and r.doc_id for r in got)
    assert [r.start for r in in_order] == (np.cumsum([0] + [r.n_tokens for r in in_order])[:-1]).tolist()
    assert T.write_tokens(no_docs, bpe_file).count() == 0


def test_selection_reads_its_frames_only(spark, bpe_file):
    docs = spark.createDataFrame([(i, f"text number {i} " * 3000) for i in range(40)], "doc_id long, text string")
    index = T.write_tokens(docs, bpe_file, files=1, end_id=50256)
    row = index.where("doc_id = 17").first()
    fs, path = shared_filesystem(row.file)
    reads = []

    class Counting:
        def __init__(self, f):
            self.f = f

        def size(self):
            return self.f.size()

        def read_at(self, n, at):
            reads.append(n)
            return self.f.read_at(n, at)
    reader = T.FrameReader(Counting(fs.open_input_file(path)))
    table = len(reads)
    ids = np.frombuffer(reader.read(4 * row.at, 4 * row.n_tokens), dtype="<u4")
    assert ids[-1] == 50256 and len(reads) - table <= 2 < len(reader.sums)
    one = T.read_tokens(index.where("doc_id = 17")).first()
    assert zlib.crc32(one.ids) == zlib.crc32(ids.tobytes())


def test_damage_is_found(tmp_path):
    import io
    out = io.BytesIO()
    out.close = lambda: None
    w = T.FrameWriter(out, 3)
    w.add(bytes(range(256)) * 5000)
    w.add(b"next")
    w.close()
    data = bytearray(out.getvalue())

    class File:
        def size(self):
            return len(data)

        def read_at(self, n, at):
            return bytes(data[at:at + n])
    assert T.FrameReader(File()).read(256 * 5000 - 2, 6) == b"\xfe\xffnext"
    import zstandard
    assert zstandard.ZstdDecompressor().decompressobj(read_across_frames=True).decompress(bytes(data))[:256] == bytes(range(256))
    data[20] ^= 1
    with pytest.raises(Exception):
        T.FrameReader(File()).read(0, 1000)
