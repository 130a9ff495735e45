"""Token ids as length-delimited binary records, with an offset index for shuffled reads.

Data file: one record per document,
    length of the payload     unsigned 64 bit
    masked CRC-32 of length   unsigned 32 bit
    payload                   flag byte, id (signed 64 bit), token ids
    masked CRC-32 of payload  unsigned 32 bit
all little-endian. The flag's lower bits hold the bytes per token id (two where
the vocabulary allows, else four); its high bit marks a null document id. A
checksum is stored turned right by 15 bits plus a constant, so that a file which
itself contains checksums does not check out by accident.
Index file: "SEQX", the bytes per token id, and per record its offset in the
data file and its token count, so that any record is one seek away.

Documents are dealt out by ranges of their id and sorted, so reading the data
files in manifest order gives ascending ids. Every file ends at ``FILE_BYTES``.

Defined results: null and empty texts hold only the end id; rows that repeat an
id follow each other in any order; a null id comes first. Special tokens written
out in a text are matched as the tokenizer file says.
"""

import itertools
import re
import string
import struct
import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import files
from .common import id_text, ids_of, materialise, partitions, work_path

TOKENIZER = "word_bpe_49k.json"
END_ID = 1
FILE_BYTES = 64 << 20
MEMO = 300_000
MASK_DELTA = 0xA282EAD8
NULL_ID = 0x80
MAGIC = b"SEQX"
#: Letters that the normalizer turns into one letter, whatever stands beside them. Others
#: may turn into a letter and a mark.
LETTERS = frozenset(string.ascii_letters) | {chr(c) for c in range(0xC0, 0x100)} - {"\xd7", "\xf7"}
WORD = re.compile(r"[A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\xff]+")
#: Marks that always form a token of their own after such a letter; they would join a mark.
TAIL = ".,!?;:%&*$#"
#: White space to str.split but not to the tokenizer, and what is to both.
CONTROLS = "\x1c\x1d\x1e\x1f"
BLANK = re.compile(r"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")


def masked(crc):
    return ((((crc >> 15) | (crc << 17)) & 0xFFFFFFFF) + MASK_DELTA) & 0xFFFFFFFF


def frame(payload):
    length = struct.pack("<Q", len(payload))
    return b"".join((length, struct.pack("<I", masked(zlib.crc32(length))),
                     payload, struct.pack("<I", masked(zlib.crc32(payload)))))


class Corrupt(ValueError):
    """A record whose length or payload does not match its checksum."""


def _exactly(stream, n, what):
    data = stream.read(n)
    if len(data) != n:
        raise Corrupt(f"file ends within {what}")
    return data


def read_record(stream):
    """The next payload, or None at the end of the file."""
    head = stream.read(12)
    if not head:
        return None
    if len(head) != 12 or masked(zlib.crc32(head[:8])) != struct.unpack("<I", head[8:])[0]:
        raise Corrupt("bad length")
    payload = _exactly(stream, struct.unpack("<Q", head[:8])[0], "a payload")
    if masked(zlib.crc32(payload)) != struct.unpack("<I", _exactly(stream, 4, "a checksum"))[0]:
        raise Corrupt("bad payload")
    return payload


def pack(doc_id, ids, width):
    """A payload; ids are the little-endian bytes of the token ids at that width."""
    return struct.pack("<Bq", width | (NULL_ID if doc_id is None else 0), doc_id or 0) + ids


def unpack(payload):
    """(doc_id, token ids) of a payload."""
    flag, doc_id = struct.unpack_from("<Bq", payload)
    ids = np.frombuffer(payload, "<u2" if flag & 0x7F == 2 else "<u4", offset=9)
    return None if flag & NULL_ID else doc_id, ids


def pieces(text):
    """A text's pieces between what the tokenizer takes for white space."""
    if any(c in text for c in CONTROLS):
        return filter(None, BLANK.split(text))
    return text.split()


def _spelled(tokenizer):
    """Letter -> what the tokenizer's model is given for it; None where words are more than their letters."""
    if tokenizer.normalizer is None or tokenizer.pre_tokenizer is None or \
            any(token.content[:1].isalpha() for token in tokenizer.get_added_tokens_decoder().values()):
        return None

    def given(word):
        found = tokenizer.pre_tokenizer.pre_tokenize_str(tokenizer.normalizer.normalize_str(word))
        return found[0][0] if len(found) == 1 else None
    table = {ord(c): given(c) for c in LETTERS}
    every = "".join(sorted(LETTERS)) * 2
    return table if None not in table.values() and given(every) == every.translate(table) else None


class Words(dict):
    """White-space delimited piece -> packed token ids, by the tokenizers library.

    The tokenizer drops white space and never joins what it separates, so a text
    is the sequence of its pieces. Pieces are remembered up to a bound.
    """

    def __init__(self, path):
        import os
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        self.width = 2 if self.tokenizer.get_vocab_size() <= 1 << 16 else 4
        self.dtype = np.dtype(f"<u{self.width}")
        self.old = {}
        self.model, self.spelled = self.tokenizer.model, _spelled(self.tokenizer)

    def __missing__(self, piece):
        found = self.old.pop(piece, None)
        if found is None:
            stem = piece.rstrip(TAIL)
            if stem != piece and stem[-1:] in LETTERS:
                found = self[stem] + self[piece[len(stem):]]
            else:
                found = np.array(self._ids(piece), self.dtype).tobytes()
        if len(self) >= MEMO:
            self.old = dict(self)
            self.clear()
        self[piece] = found
        return found

    def _ids(self, piece):
        """The library's ids of a piece; a word of plain letters needs nothing but its model."""
        if self.spelled and WORD.fullmatch(piece):
            return [token.id for token in self.model.tokenize(piece.translate(self.spelled))]
        return self.tokenizer.encode(piece, add_special_tokens=False).ids

    def encode(self, text):
        return b"".join(map(self.__getitem__, pieces(text))) if text else b""


_WORDS = {}


def _words(path):
    if path not in _WORDS:
        _WORDS[path] = Words(path)
    return _WORDS[path]


MANIFEST = "part int, seq int, data string, index string, docs long, ids long"


def write(docs: DataFrame, tokenizer=TOKENIZER, end_id=END_ID, folder=None) -> DataFrame:
    """Encode and write ``docs``; the manifest, one row per data file, in id order by (part, seq)."""
    spark = docs.sparkSession
    folder = folder or work_path(spark, "records")
    ordered = id_text(docs).repartitionByRange(partitions(spark), "doc_id").sortWithinPartitions("doc_id")

    def run(batches):
        import public_tokenizers
        import pyarrow as pa
        from pyspark import TaskContext
        words = _words(public_tokenizers.path(tokenizer))
        end = np.array([end_id], words.dtype).tobytes()
        part, seq = TaskContext.get().partitionId(), 0
        data, offsets, counts, at = None, [], [], 0

        def close():
            data[1].close()
            path, index = files.create(folder, ".idx")
            with index:
                index.write(MAGIC + struct.pack("<I", words.width))
                index.write(np.stack([np.array(offsets, "<u8"), np.array(counts, "<u8")], axis=1).tobytes())
            return pa.RecordBatch.from_pylist(
                [{"part": part, "seq": seq, "data": data[0], "index": path, "docs": len(counts), "ids": sum(counts)}],
                schema=pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("data", pa.string()),
                                  ("index", pa.string()), ("docs", pa.int64()), ("ids", pa.int64())]))
        for batch in batches:
            column = batch.column(batch.schema.get_field_index("text"))
            for doc_id, text in zip(ids_of(batch, "doc_id"), column):
                if data is None:
                    data = files.create(folder, ".rec")
                ids = words.encode(text.as_py()) + end
                record = frame(pack(doc_id, ids, words.width))
                data[1].write(record)
                offsets.append(at)
                counts.append(len(ids) // words.width)
                at += len(record)
                if at >= FILE_BYTES:
                    yield close()
                    data, offsets, counts, at, seq = None, [], [], 0, seq + 1
        if data is not None:
            yield close()
    return materialise(ordered.mapInArrow(run, MANIFEST), "records-manifest")


ROWS = "part int, seq int, pos long, doc_id long, n_tokens long, ids_crc32 long"


def _read_rows(batches):
    """Reads each data file from front to back and holds it against its index."""
    import pyarrow as pa
    names = [c.split()[0] for c in ROWS.split(", ")]
    kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]

    def rows(batch):
        for part, seq, data, index in zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist()
                                            for c in ("part", "seq", "data", "index"))):
            _, counts = read_index(index)
            with files.read(data) as stream:
                at = 0
                for k in itertools.count():
                    payload = read_record(stream)
                    if payload is None:
                        break
                    doc_id, ids = unpack(payload)
                    if k >= len(counts) or counts[k] != len(ids):
                        raise Corrupt(f"index of {data} does not match")
                    yield part, seq, at, doc_id, len(ids), zlib.crc32(ids.astype("<u4").tobytes())
                    at += len(ids)
                if k != len(counts):
                    raise Corrupt(f"{data} is short of records")
    for batch in batches:
        source = rows(batch)
        while block := list(itertools.islice(source, 20_000)):
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*block), kinds)], names=names)


def read_index(path):
    """(offsets, token counts) of an index file."""
    with files.read(path) as stream:
        head = _exactly(stream, 8, "an index")
        if head[:4] != MAGIC:
            raise Corrupt("not an index file")
        table = np.frombuffer(stream.read(), "<u8").reshape(-1, 2)
    return table[:, 0], table[:, 1]


def read_shuffled(data, index, order):
    """(doc_id, ids) of the records at the given places of one file, one seek each."""
    offsets, _ = read_index(index)
    with files.read_at(data) as stream:
        for k in order:
            stream.seek(int(offsets[k]))
            yield unpack(read_record(stream))


def read_back(manifest: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) from the files; start counts all ids before a document."""
    spark = manifest.sparkSession
    read = manifest.repartition(partitions(spark), "data").mapInArrow(_read_rows, ROWS)
    # one manifest row per file of FILE_BYTES or per task: the only ordered pass
    before = W.orderBy("part", "seq").rowsBetween(W.unboundedPreceding, -1)
    base = manifest.select("part", "seq", F.coalesce(F.sum("ids").over(before), F.lit(0)).alias("base"))
    out = read.join(base, ["part", "seq"])
    return out.select("doc_id", (F.col("base") + F.col("pos")).alias("start"), "n_tokens", "ids_crc32")
