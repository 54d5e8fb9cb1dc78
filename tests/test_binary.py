import struct
import zlib

from spliceweave.operators import junctions
from spliceweave.sources import binary


class Bgzf:
    """Writes BGZF blocks and remembers where records start."""

    def __init__(self, path):
        self.f = open(path, "wb")

    def block(self, data):
        at = self.f.tell()
        c = zlib.compressobj(6, zlib.DEFLATED, -15)
        body = c.compress(data) + c.flush()
        self.f.write(b"\x1f\x8b\x08\x04" + b"\0" * 4 + b"\0\xff" + struct.pack("<HccHH", 6, b"B", b"C", 2, len(body) + 25))
        self.f.write(body + struct.pack("<II", zlib.crc32(data), len(data)))
        return at

    def close(self):
        self.block(b"")
        self.f.close()


def bam_record(pos, cigar, flag, cb, umi):
    name = b"r\0"
    ops = b"".join(struct.pack("<I", n << 4 | "MIDNSHP=X".index(o)) for n, o in cigar)
    tags = b"NHC\x01" + b"XBBc\x02\0\0\0\x01\x02" + b"CBZ" + cb.encode() + b"\0" + b"UBZ" + umi.encode() + b"\0"
    body = struct.pack("<iiBBHHHiiii", 0, pos, len(name), 60, 0, len(cigar), flag, 4, -1, -1, 0) + name + ops + b"\x11\x11" + b"IIII" + tags
    return struct.pack("<i", len(body)) + body


def test_bam_is_split_by_its_index(spark, tmp_path):
    path = str(tmp_path / "a.bam")
    w = Bgzf(path)
    w.block(b"BAM\1" + struct.pack("<i", 4) + b"@HD\n" + struct.pack("<i", 1) + struct.pack("<i", 5) + b"chr1\0" + struct.pack("<i", 10**6))
    recs = [bam_record(100 + i, [(10, "M"), (100, "N"), (20, "M")], 0, f"CB{i % 3}", f"U{i}") for i in range(30)]
    first = w.block(b"".join(recs[:10]) + recs[10][:7])  # record 10 spans two blocks
    second = w.block(recs[10][7:] + b"".join(recs[11:]))
    w.close()
    marks = [first << 16, first << 16 | len(recs[0]) * 4, second << 16 | (len(recs[10]) - 7)]
    with open(path + ".bai", "wb") as f:
        f.write(b"BAI\1" + struct.pack("<i", 1))
        f.write(struct.pack("<i", 2) + struct.pack("<IiQQ", 4681, 1, marks[0], 1 << 50) + struct.pack("<IiQQQQ", 37450, 2, 1, 2, 30, 0))
        f.write(struct.pack("<i", 3) + struct.pack("<3Q", 0, *marks[1:]))
    binary.register(spark)
    df = spark.read.format("bam").option("path", path).option("splitBytes", 0).load()
    assert df.rdd.getNumPartitions() == 3
    rows = df.collect()
    assert sorted(r.pos for r in rows) == list(range(100, 130))
    assert rows[0].cigar == "10M100N20M" and {r.cb for r in rows} == {"CB0", "CB1", "CB2"} and rows[0].chrom == "chr1"
    assert spark.read.format("bam").option("path", path).load().count() == 30
    found = junctions.extract_junctions(df)
    assert found.count() == 30 and found.first().n_reads == 1


def test_bcf(spark, tmp_path):
    path = str(tmp_path / "a.bcf")
    head = ("##fileformat=VCFv4.2\n##FILTER=<ID=PASS,Description=\"\">\n##contig=<ID=chr1>\n##contig=<ID=chr2>\n"
            "##INFO=<ID=AF,Number=1,Type=Float>\n##FORMAT=<ID=DP,Number=1,Type=Integer>\n##FORMAT=<ID=GT,Number=1,Type=String>\n"
            "#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\tD1\tD2\tD3\tD4\n\0").encode()

    def record(chrom, pos):
        shared = struct.pack("<iiifHHI", chrom, pos - 1, 1, 0.0, 0, 2, 2 << 24 | 4)
        shared += b"\x37rs1" + b"\x17A" + b"\x17G" + b"\x11\x00"
        dp = b"\x11\x02" + b"\x11" + bytes([9, 9, 9, 9])
        gt = b"\x11\x03" + b"\x21" + bytes([2, 3, 2, 5, 4, 5, 2, 4])
        return struct.pack("<II", len(shared), len(dp + gt)) + shared + dp + gt

    w = Bgzf(path)
    w.block(b"BCF\2\2" + struct.pack("<I", len(head)) + head)
    a = w.block(record(0, 10) + record(0, 20))
    b = w.block(record(1, 30))
    w.close()
    index = Bgzf(path + ".csi")
    bins = b"".join(struct.pack("<i", 1) + struct.pack("<IQi", 4681, o, 1) + struct.pack("<QQ", o, 1 << 50) for o in (a << 16, b << 16))
    index.block(b"CSI\1" + struct.pack("<iii", 14, 5, 0) + struct.pack("<i", 2) + bins)
    index.close()
    binary.register(spark)
    df = spark.read.format("bcf").option("path", path).option("splitBytes", 0).load()
    assert df.rdd.getNumPartitions() == 2
    rows = sorted(df.collect(), key=lambda r: r.snp_pos)
    assert [(r.snp, r.chrom, r.snp_pos) for r in rows] == [("chr1:10:A:G", "chr1", 10), ("chr1:20:A:G", "chr1", 20), ("chr2:30:A:G", "chr2", 30)]
    assert list(rows[0].dosage) == [0.0, 1.0, 2.0, None]  # the last call is unphased
    assert binary.bcf_donors(path) == ["D1", "D2", "D3", "D4"]
