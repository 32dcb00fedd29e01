from test_decode import ANSWER, ASK, C, S, pcap, pcapng, tcp

from flowloom.decode import capture
from flowloom.sources import split
from flowloom.sources.capture import read_segments


def frames(n):
    return [tcp(C, S, 100 + k, ASK + b"x" * k) if k % 2 else tcp(S, C, 500 + k, ANSWER) for k in range(n)]


def test_parts_are_exact_in_both_formats(tmp_path):
    two = pcapng([(f, k % 3 if k % 4 else None) for k, f in enumerate(frames(20))], [7, 8, 9]) + pcapng([(f, 0) for f in frames(9)], [5])
    for name, data in {"a": pcap(frames(30)), "b": pcap(frames(30), ">"), "c": two, "cut": two[:-7], "bad": pcap(frames(3)) + b"\xff" * 40, "head": pcap([])}.items():
        path = tmp_path / name
        path.write_bytes(data)
        whole = [(s.number, s.src, s.payload, s.pid) for s in capture.segments(data)]
        for size in (1, 300, 10**9):
            got = []
            for p in split.parts_of(str(path), size):
                got += [(s.number + p.number, s.src, s.payload, s.pid) for s in capture.segments(p.prefix + data[p.start : p.end])]
            assert got == whole, (name, size)
    assert len(split.parts_of(str(tmp_path / "a"), 300)) > 5
    for junk in (b"", b"junk" * 9, b"\xd4\xc3\xb2\xa1" + b"\0" * 9):
        (tmp_path / "junk").write_bytes(junk)
        assert split.parts_of(str(tmp_path / "junk")) == []


def test_same_rows_as_whole_files(spark, tmp_path):
    (tmp_path / "one.pcap").write_bytes(pcap(frames(40)))
    (tmp_path / "two.pcapng").write_bytes(pcapng([(f, 0) for f in frames(25)], [7]))
    (tmp_path / "none.txt").write_bytes(b"no capture at all")
    parts, whole = split.read_parts(spark, str(tmp_path), 500), read_segments(spark, str(tmp_path))
    assert parts.schema == whole.schema and parts.rdd.getNumPartitions() > 5
    assert sorted(map(str, parts.collect())) == sorted(map(str, whole.collect())) and parts.count() == 65
    empty = tmp_path / "empty"
    empty.mkdir()
    assert split.read_parts(spark, str(empty)).count() == 0
