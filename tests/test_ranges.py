"""Files read in byte ranges against whole reads."""

from __future__ import annotations

import gzip
import random
import zlib

import numpy as np
import pytest

from lociweave.sources import beagle, haplike, plink, ranges, text, vcf


def member(content: bytes, extra: bytes = b"") -> bytes:
    c = zlib.compressobj(6, zlib.DEFLATED, -15)
    body = c.compress(content) + c.flush()
    field = extra + b"BC" + (2).to_bytes(2, "little")
    size = 12 + len(field) + 2 + len(body) + 8
    return b"\x1f\x8b\x08\x04" + bytes(4) + b"\x00\xff" + (len(field) + 2).to_bytes(2, "little") + field + (size - 1).to_bytes(2, "little") + body + zlib.crc32(content).to_bytes(4, "little") + len(content).to_bytes(4, "little")


def block_gzip(content: bytes, cuts: list[int], extra: bytes = b"") -> bytes:
    """Members of the content between cuts, and the empty one that ends a file."""
    at = [0, *sorted(cuts), len(content)]
    return b"".join(member(content[a:b], extra) for a, b in zip(at, at[1:])) + member(b"")


@pytest.mark.parametrize("part", [1 << 30, 5000, 300, 37])
def test_lines_of_block_gzip(spark, tmp_path, part):
    """Members cut anywhere, lines longer than members and ranges, blank lines, ends of lines at ends of members."""
    rng = random.Random(part)
    rows = ["x" * rng.choice([0, 1, 5, 40, 300, 2000]) + f" {i} é" for i in range(150)] + ["", "", "end"]
    content = "\n".join(rows).encode() + b"\n"
    breaks = [i + 1 for i, b in enumerate(content) if b == 10]
    for name, cuts in (("a", rng.sample(range(len(content)), 60)), ("b", breaks[::3]), ("c", [b - 1 for b in breaks[::2]] + [7, 7, 7])):
        (tmp_path / f"{name}.gz").write_bytes(block_gzip(content, cuts, b"XX\x03\x00abc"))
    (tmp_path / "d.gz").write_bytes(block_gzip(content[:-1].replace(b"\n", b"\r\n"), [100, 900]))
    held = ranges.files(spark, str(tmp_path))
    assert ranges.block_gzip(held) and [uri[-4:] for uri, _ in held] == ["a.gz", "b.gz", "c.gz", "d.gz"]
    got = ranges.lines(spark, held, part).orderBy("path", "start", "at").collect()
    assert [r["value"] for r in got] == rows * 4
    assert part > 1000 or ranges.lines(spark, held, part).rdd.getNumPartitions() > 8


def test_numbered_lines_of_block_gzip(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(ranges.lines, "__defaults__", (64,))
    (tmp_path / "x.gz").write_bytes(block_gzip("".join(f"{i}\n\n" for i in range(500)).encode(), list(range(0, 2000, 31))))
    assert [r["value"] for r in text.numbered(spark, str(tmp_path / "x.gz")).orderBy("row").collect()] == [str(i) for i in range(500)]


def test_formats_read_block_gzip_as_plain(spark, tmp_path):
    body = "marker\ta\tb\tx\tx\tx\n" + "".join(f"c_{i}\tA\tG\t0.5\t0.25\t0.25\n" for i in range(300))
    (tmp_path / "gl.gz").write_bytes(block_gzip(body.encode(), list(range(0, len(body), 700))))
    (tmp_path / "gl").write_text(body)
    one, two = ([beagle.header(spark, str(tmp_path / n)), sorted(map(str, beagle.lines(spark, str(tmp_path / n)).drop("line").collect()))] for n in ("gl.gz", "gl"))
    assert one == two and len(one[1]) == 300
    record = "##fileformat=VCFv4.2\n##contig=<ID=c>\n#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\ts\n" + "".join(f"c\t{i}\t.\tA\tC\t.\t.\tDP={i}\tGT\t0/1\n" for i in range(300))
    (tmp_path / "v.vcf.gz").write_bytes(block_gzip(record.encode(), list(range(0, len(record), 900))))
    with gzip.open(tmp_path / "p.vcf.gz", "wt") as f:
        f.write(record)
    one, two = ([vcf.samples(spark, str(tmp_path / n)), vcf.header(spark, str(tmp_path / n)).count(), sorted(map(str, vcf.read(spark, str(tmp_path / n)).collect()))] for n in ("v.vcf.gz", "p.vcf.gz"))
    assert one == two and len(one[2]) == 300


def test_member_that_is_cut_off(spark, tmp_path):
    whole = block_gzip(b"".join(b"%d\n" % i for i in range(5000)), list(range(0, 20000, 500)))
    for cut in (len(whole) - 200, len(whole) - 90):
        (tmp_path / "x.gz").write_bytes(whole[:cut])
        with pytest.raises(Exception):
            ranges.lines(spark, ranges.files(spark, str(tmp_path / "x.gz")), 256).count()


@pytest.mark.parametrize("part", [1, 100, 1 << 20])
def test_bed_in_ranges(spark, tmp_path, part):
    rng = np.random.default_rng(0)
    want = []
    for name, sites in (("a", 40), ("b", 0), ("c", 7)):
        own = rng.integers(0, 256, (sites, 5), dtype=np.uint8)
        (tmp_path / f"{name}.bed").write_bytes(plink.MAGIC + own.tobytes())
        want += own.tolist()
    got = plink.sites(spark, str(tmp_path / "*.bed"), 18, part).orderBy("site").collect()
    assert [list(r["row"]) for r in got] == want and [r["site"] for r in got] == list(range(47))
    cells = plink.bed(spark, str(tmp_path), 18).collect()
    assert sorted((r["site"], r["block"], r["byte"]) for r in cells) == [(i, j, x) for i, row in enumerate(want) for j, x in enumerate(row)]
    with pytest.raises(ValueError, match="whole sites"):
        plink.sites(spark, str(tmp_path / "c.bed"), 21)


def test_bed_over_two_gigabytes(spark, tmp_path):
    """A sparse file, whose few calls lie at both ends and around 2 GB."""
    width, n = 1 << 20, 2100
    path = tmp_path / "large.bed"
    with open(path, "wb") as f:
        f.write(plink.MAGIC)
        f.truncate(3 + n * width)
        for site in (0, 2046, 2047, 2048, n - 1):
            f.seek(3 + site * width + site)
            f.write(bytes([1 + site % 255]))
    found = plink.sites(spark, str(path), 4 * width)
    assert found.rdd.getNumPartitions() > 60

    def sums(batches):
        import pyarrow as pa

        for b in batches:
            x = [np.frombuffer(r.as_buffer(), np.uint8) for r in b.column("row")]
            yield pa.RecordBatch.from_arrays([b.column("site"), pa.array([int(v.argmax()) for v in x]), pa.array([int(v.sum()) for v in x]), pa.array([len(v) for v in x])], ["site", "at", "sum", "n"])

    got = {r["site"]: (r["at"], r["sum"], r["n"]) for r in found.mapInArrow(sums, "site long, at long, sum long, n long").collect()}
    assert len(got) == n and got == {i: (i, 1 + i % 255, width) if i in (0, 2046, 2047, 2048, n - 1) else (0, 0, width) for i in range(n)}


def test_haplike_in_ranges(spark, tmp_path):
    values = np.random.default_rng(2).random((5, 7, 9))
    (tmp_path / "x.bin").write_bytes(np.array([5, 3, 7], "<i4").tobytes() + values.astype("<f8").tobytes())
    got = haplike.read(spark, str(tmp_path / "x.bin"), 200).orderBy("sample_idx", "site").collect()
    assert [r["likely"] for r in got] == values.reshape(35, 9).tolist() and got[34]["sample_idx"] == 4
    (tmp_path / "x.bin").write_bytes(b"abc")
    with pytest.raises(ValueError):
        haplike.read(spark, str(tmp_path / "x.bin"))
