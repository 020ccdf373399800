"""``spark.read.format("bam")``: aligned reads of BAM files, with the columns of the SAM reader.

BGZF is a chain of gzip members, so a file is read as one gzip stream; each file is a partition.
"""

from __future__ import annotations

import gzip
import struct

from pyspark.sql import SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader

from covalens.sources.formats import _FastqReader

#: Fixed values of the format.
_OPS = "MIDNSHP=X"
_BASES = "=ACMGRSVTWYHKDBN"
_ON_REFERENCE = "MDN=X"
_NUMBERS = {"c": "<b", "C": "<B", "s": "<h", "S": "<H", "i": "<i", "I": "<I", "f": "<f"}


class BamSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "bam"

    def schema(self) -> str:
        return "qname string, flag int, rname string, pos long, mapq int, cigar string, rnext string, pnext long, tlen long, seq string, qual string, tags map<string,string>, end long"

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return _BamReader(self.options["path"])


class _BamReader(_FastqReader):
    def read(self, partition):
        store, _ = self._store()
        with store.open_input_stream(partition.path, compression=None) as raw, gzip.open(raw) as stream:
            if _take(stream, 4) != b"BAM\1":
                raise ValueError(f"{partition.path} is no BAM file")
            _take(stream, struct.unpack("<i", _take(stream, 4))[0])
            names = []
            for _ in range(struct.unpack("<i", _take(stream, 4))[0]):
                names.append(_take(stream, struct.unpack("<i", _take(stream, 4))[0])[:-1].decode())
                _take(stream, 4)
            while size := stream.read(4):
                yield _record(_take(stream, struct.unpack("<i", size)[0]), names)


def _take(stream, n: int) -> bytes:
    got = stream.read(n)
    if len(got) < n:
        raise ValueError("the file ends within a record")
    return got


def _record(body: bytes, names: list[str]) -> tuple:
    ref, pos, name_len, mapq, _, ops, flag, length, mate, mate_pos, tlen = struct.unpack_from("<iiBBHHHiiii", body)
    at = 32
    qname = body[at : at + name_len - 1].decode()
    at += name_len
    cigar = [(x >> 4, _OPS[x & 15]) for x in struct.unpack_from(f"<{ops}I", body, at)]
    at += 4 * ops
    packed = body[at : at + (length + 1) // 2]
    seq = "".join(_BASES[b >> 4] + _BASES[b & 15] for b in packed)[:length]
    at += len(packed)
    qual = body[at : at + length]
    at += length
    end = pos + sum(n for n, op in cigar if op in _ON_REFERENCE) if cigar else None
    mate_name = None if mate < 0 else "=" if mate == ref else names[mate]
    return (
        qname, flag, names[ref] if ref >= 0 else None, pos + 1, mapq, "".join(f"{n}{op}" for n, op in cigar) or None, mate_name, mate_pos + 1, tlen,
        seq or None, None if not length or qual[:1] == b"\xff" else "".join(chr(q + 33) for q in qual), dict(_tags(body, at)), end,
    )


def _tags(body: bytes, at: int):
    while at < len(body):
        key, kind = body[at : at + 2].decode(), chr(body[at + 2])
        at += 3
        if kind in "ZH":
            stop = body.index(0, at)
            yield key, body[at:stop].decode()
            at = stop + 1
        elif kind == "A":
            yield key, chr(body[at])
            at += 1
        elif kind == "B":
            form, n = _NUMBERS[chr(body[at])], struct.unpack_from("<i", body, at + 1)[0]
            size = struct.calcsize(form)
            yield key, ",".join([chr(body[at]), *(str(struct.unpack_from(form, body, at + 5 + i * size)[0]) for i in range(n))])
            at += 5 + n * size
        else:
            form = _NUMBERS[kind]
            yield key, str(struct.unpack_from(form, body, at)[0])
            at += struct.calcsize(form)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(BamSource)
