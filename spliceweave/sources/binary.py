"""BAM and BCF as Spark data sources, split on their indexes.

Register once per session with ``register(spark)``, then ``spark.read.format("bam")`` or
``format("bcf")`` with a ``path`` (glob) on a file system all executors mount. The ``.bai`` or
``.csi`` index next to a file lists offsets at which a record starts; partitions are runs between
them, so one large file is read by many tasks and nothing is scanned to find a boundary.
"""

from __future__ import annotations

import glob
import gzip
import struct
import zlib
from dataclasses import dataclass

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

# fixed values: CIGAR operation letters, element sizes of tag arrays, BCF integer types
CIGAR_OPS = "MIDNSHP=X"
TAG_SIZES = {"A": 1, "c": 1, "C": 1, "s": 2, "S": 2, "i": 4, "I": 4, "f": 4}
BCF_INTS = {1: ("b", 1), 2: ("h", 2), 3: ("i", 4)}
BCF_WIDTHS = {0: 0, 1: 1, 2: 2, 3: 4, 5: 4, 7: 1}
END_OF_FILE = 1 << 62
ROWS_PER_BATCH = 8192


@dataclass
class FileRange(InputPartition):
    path: str
    start: int
    end: int


class Blocks:
    """Byte stream over BGZF blocks that knows its virtual offset."""

    def __init__(self, handle, start: int = 0):
        self.handle, self.pos = handle, start & 0xFFFF
        self.next = start >> 16
        self._load()

    def _load(self) -> bool:
        self.at = self.next
        self.handle.seek(self.at)
        head = self.handle.read(12)
        if len(head) < 12:
            self.data = b""
            return False
        extra = self.handle.read(struct.unpack_from("<H", head, 10)[0])
        i, size = 0, 0
        while i < len(extra):
            tag, n = extra[i:i + 2], struct.unpack_from("<H", extra, i + 2)[0]
            if tag == b"BC":
                size = struct.unpack_from("<H", extra, i + 4)[0] + 1
            i += 4 + n
        body = self.handle.read(size - 12 - len(extra))
        self.data = zlib.decompress(body[:-8], -15)
        self.next = self.at + size
        return True

    def settle(self) -> bool:
        """Step over exhausted blocks; False at the end of the file."""
        while self.pos >= len(self.data):
            self.pos -= len(self.data)
            if not self._load():
                return False
        return True

    def offset(self) -> int:
        return self.at << 16 | self.pos

    def take(self, n: int) -> bytes:
        out = b""
        while n > 0 and self.settle():
            part = self.data[self.pos:self.pos + n]
            self.pos += len(part)
            n -= len(part)
            out += part
        return out


def _bai_offsets(path: str) -> list[int]:
    with open(path, "rb") as f:
        raw = f.read()
    found, i = set(), 8
    for _ in range(struct.unpack_from("<i", raw, 4)[0]):
        n_bin = struct.unpack_from("<i", raw, i)[0]
        i += 4
        for _ in range(n_bin):
            name, n_chunk = struct.unpack_from("<Ii", raw, i)
            i += 8
            if name != 37450:  # the summary bin holds counts
                found.update(struct.unpack_from(f"<{2 * n_chunk}Q", raw, i)[::2])
            i += 16 * n_chunk
        n_intv = struct.unpack_from("<i", raw, i)[0]
        found.update(struct.unpack_from(f"<{n_intv}Q", raw, i + 4))
        i += 4 + 8 * n_intv
    return sorted(found - {0})


def _csi_offsets(path: str) -> list[int]:
    with gzip.open(path, "rb") as f:
        raw = f.read()
    depth, n_aux = struct.unpack_from("<ii", raw, 8)
    summary = ((1 << 3 * (depth + 1)) - 1) // 7 + 1
    found, i = set(), 16 + n_aux
    n_ref = struct.unpack_from("<i", raw, i)[0]
    i += 4
    for _ in range(n_ref):
        n_bin = struct.unpack_from("<i", raw, i)[0]
        i += 4
        for _ in range(n_bin):
            name, _, n_chunk = struct.unpack_from("<IQi", raw, i)
            i += 16
            if name != summary:
                found.update(struct.unpack_from(f"<{2 * n_chunk}Q", raw, i)[::2])
            i += 16 * n_chunk
    return sorted(found - {0})


def _ranges(paths: list[str], suffix: str, offsets, split_bytes: int) -> list[FileRange]:
    out = []
    for p in paths:
        marks, cuts = offsets(p + suffix), []
        for m in marks:
            if not cuts or (m >> 16) - (cuts[-1] >> 16) >= split_bytes:
                cuts.append(m)
        out += [FileRange(p, a, b) for a, b in zip(cuts, cuts[1:] + [END_OF_FILE])]
    return out


def _batches(rows, schema):
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow, held = to_arrow_schema(schema), []
    for row in rows:
        held.append(row)
        if len(held) == ROWS_PER_BATCH:
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*held), arrow)], schema=arrow)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*held), arrow)], schema=arrow)


def _tags(raw: bytes, i: int, wanted: tuple[bytes, ...]) -> dict[bytes, str]:
    out = {}
    while i + 3 <= len(raw):
        tag, kind = raw[i:i + 2], chr(raw[i + 2])
        i += 3
        if kind in "ZH":
            end = raw.index(b"\0", i)
            if tag in wanted:
                out[tag] = raw[i:end].decode()
            i = end + 1
        elif kind == "B":
            i += 5 + TAG_SIZES[chr(raw[i])] * struct.unpack_from("<i", raw, i + 1)[0]
        else:
            i += TAG_SIZES[kind]
    return out


class _IndexedReader(DataSourceReader):
    suffix, offsets = ".bai", staticmethod(_bai_offsets)

    def __init__(self, options, schema):
        self.paths = sorted(glob.glob(options["path"]))
        self.split_bytes = int(options.get("splitBytes", 64 << 20))
        self.schema = schema

    def partitions(self):
        return _ranges(self.paths, self.suffix, self.offsets, self.split_bytes)

    def read(self, part):
        if part is not None:
            with open(part.path, "rb") as f:
                yield from _batches(self.rows(f, part), self.schema)


class BamReader(_IndexedReader):
    def rows(self, f, part):
        head = Blocks(f)
        head.take(4)
        head.take(struct.unpack("<i", head.take(4))[0])
        names = []
        for _ in range(struct.unpack("<i", head.take(4))[0]):
            names.append(head.take(struct.unpack("<i", head.take(4))[0])[:-1].decode())
            head.take(4)
        b = Blocks(f, part.start)
        while b.settle() and b.offset() < part.end:
            raw = b.take(struct.unpack("<i", b.take(4))[0])
            ref, pos, n_name, mapq, _, n_cigar, flag, n_seq = struct.unpack_from("<iiBBHHHi", raw)
            if ref < 0 or flag & 4:
                continue
            i = 32 + n_name
            ops = struct.unpack_from(f"<{n_cigar}I", raw, i)
            cigar = "".join(f"{o >> 4}{CIGAR_OPS[o & 15]}" for o in ops)
            tags = _tags(raw, i + 4 * n_cigar + (n_seq + 1) // 2 + n_seq, (b"CB", b"UB"))
            yield names[ref], pos, cigar, flag, mapq, tags.get(b"CB"), tags.get(b"UB")


class BamSource(DataSource):
    """Mapped alignments: 0-based ``pos``, CIGAR text, flag, and the CB and UB tags."""

    @classmethod
    def name(cls):
        return "bam"

    def schema(self):
        return "chrom string, pos bigint, cigar string, flag int, mapq int, cb string, umi string"

    def reader(self, schema):
        return BamReader(self.options, schema)


def _typed(raw: bytes, i: int) -> tuple[int, int, int]:
    """(type, count, next position) of a BCF typed value header."""
    kind, n = raw[i] & 15, raw[i] >> 4
    i += 1
    if n == 15:
        code, size = BCF_INTS[raw[i] & 15]
        n = struct.unpack_from("<" + code, raw, i + 1)[0]
        i += 1 + size
    return kind, n, i


def _bcf_header(f) -> tuple[list[str], list[str], int]:
    """(contig names, sample names, dictionary index of GT) from the header text."""
    b = Blocks(f)
    b.take(5)
    text = b.take(struct.unpack("<I", b.take(4))[0]).decode().rstrip("\0")
    contigs, words, samples = [], ["PASS"], []
    for line in text.splitlines():
        if line.startswith("#CHROM"):
            samples = line.split("\t")[9:]
        for kind in ("##contig=<", "##FILTER=<", "##INFO=<", "##FORMAT=<"):
            if line.startswith(kind):
                name = line.split("ID=", 1)[1].split(",")[0].rstrip(">")
                if kind == "##contig=<":
                    contigs.append(name)
                elif name not in words:
                    words.append(name)
    return contigs, samples, words.index("GT") if "GT" in words else -1


class BcfReader(_IndexedReader):
    suffix, offsets = ".csi", staticmethod(_csi_offsets)

    def rows(self, f, part):
        contigs, samples, gt = _bcf_header(f)
        b = Blocks(f, part.start)
        while b.settle() and b.offset() < part.end:
            n_shared, n_indiv = struct.unpack("<II", b.take(8))
            shared, indiv = b.take(n_shared), b.take(n_indiv)
            chrom, pos = struct.unpack_from("<ii", shared)
            n_allele, i, strings = struct.unpack_from("<H", shared, 18)[0], 24, []
            for _ in range(n_allele + 1):
                _, n, i = _typed(shared, i)
                strings.append(shared[i:i + n].decode())
                i += n
            alt = ",".join(strings[2:]) or "."
            yield (":".join([contigs[chrom], str(pos + 1), strings[1], alt]), contigs[chrom], pos + 1,
                   self._dosages(indiv, gt, len(samples)))

    @staticmethod
    def _dosages(indiv, gt, n_samples):
        i = 0
        while i < len(indiv):
            code, size = BCF_INTS[indiv[i] & 15]
            key = struct.unpack_from("<" + code, indiv, i + 1)[0]
            kind, ploidy, i = _typed(indiv, i + 1 + size)
            width = BCF_WIDTHS[kind] * ploidy * n_samples
            if key == gt:
                code, size = BCF_INTS[kind]
                v = struct.unpack_from(f"<{ploidy * n_samples}{code}", indiv, i)
                calls = [v[k:k + ploidy] for k in range(0, len(v), ploidy)]
                # diploid calls of alleles 0 and 1 whose second allele is phased; others are missing
                return [float(sum((a >> 1) - 1 for a in c))
                        if len(c) == 2 and c[1] & 1 and all(a >> 1 in (1, 2) for a in c) else None for c in calls]
            i += width
        return [None] * n_samples


class BcfSource(DataSource):
    """Variants with phased dosages by sample order; ``snp_pos`` is 1-based."""

    @classmethod
    def name(cls):
        return "bcf"

    def schema(self):
        return "snp string, chrom string, snp_pos bigint, dosage array<double>"

    def reader(self, schema):
        return BcfReader(self.options, schema)


def bcf_donors(path: str) -> list[str]:
    """Sample names of one BCF, in dosage order."""
    with open(path, "rb") as f:
        return _bcf_header(f)[1]


def register(spark: SparkSession) -> None:
    spark.dataSource.register(BamSource)
    spark.dataSource.register(BcfSource)
