"""FASTA ranges: pieces equal the whole, wherever a range begins."""

import gzip

import pytest
from conftest import dna, grams

from sketchloom.sources import ranges


def fasta(records, width, end="\n", last=True):
    out = []
    for header, seq in records:
        lines = [seq[i : i + width] for i in range(0, len(seq), width)]
        out.append(end.join([f">{header}", *lines]))
    return end.join(out) + (end if last else "")


def records_of(rng):
    return [("first one", dna(rng, 130)), ("é>x", "é" * 9 + dna(rng, 40) + "ñß"), ("none", ""), ("empty", ""), ("long", dna(rng, 700)), ("z", dna(rng, 3))]


@pytest.mark.parametrize(("width", "end", "last"), [(60, "\n", True), (10_000, "\n", False), (7, "\r\n", True)])
def test_ranges_equal_the_whole(spark, rng, tmp_path, width, end, last):
    records = records_of(rng)
    body = fasta(records, width, end, last).encode()
    (tmp_path / "a.fa").write_bytes(body)
    (tmp_path / "b.fa.gz").write_bytes(gzip.compress(body))
    (tmp_path / "_skip").write_text("no")
    for step, piece, overlap in ((1, 50, 4), (2, 9, 1), (5, 20, 4), (13, 20, 4), (100, 1000, 0), (1 << 20, 64, 9)):
        # The ranges one after the other; a piece without a header goes on in the record before it.
        whole, found, going, k = {}, {}, None, overlap + 1
        source = ranges.Bytes(str(tmp_path / "a.fa"))
        for start in range(0, len(body), step):
            for _, _, header, _, _, _, own, seq in ranges.range_rows(source, "a.fa", start, min(start + step, len(body)), piece, overlap):
                going = going if header is None else header
                whole[going] = whole.get(going, "") + seq[:own]
                found.setdefault(going, []).extend(grams(seq, k) if own else [])
        assert whole == dict(records)
        assert {h: sorted(g) for h, g in found.items()} == {h: sorted(grams(s, k)) for h, s in records}
    rows = ranges.read_ranges(spark, str(tmp_path), 4, 97, 20)
    whole = {(r["name"], r["record"]): r["seq"] for r in ranges.whole_records(rows).collect()}
    assert whole == {(n, h): s for n in ("a.fa", "b.fa.gz") for h, s in records}
    plain = ranges.read_ranges(spark, str(tmp_path / "a.fa"), 0, 64)
    assert plain.rdd.getNumPartitions() == -(-len(body) // 64)


def test_odd_files(spark, tmp_path):
    (tmp_path / "empty.fa").write_text("")
    assert ranges.read_ranges(spark, str(tmp_path / "empty.fa")).count() == 0
    with pytest.raises(Exception, match="missing"):
        ranges.read_ranges(spark, str(tmp_path / "missing")).count()
    (tmp_path / "loose.fa").write_text("ACG\nT\n>x\nGG")
    rows = ranges.whole_records(ranges.read_ranges(spark, str(tmp_path / "loose.fa"), step=2)).collect()
    assert {(r["record"], r["seq"]) for r in rows} == {(None, "ACGT"), ("x", "GG")}
    (tmp_path / "header.fa").write_text(">" + "h" * (2 * ranges.HEADER) + "\nACGT")
    with pytest.raises(Exception, match="64 KB"):
        ranges.read_ranges(spark, str(tmp_path / "header.fa"), step=1000).count()
