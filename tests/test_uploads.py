import pytest
from pyspark.sql import functions as F
from test_decode import ANSWER, ASK, C, S, pcap, tcp

from flowloom.decode.protocols import FramedSession, Registry
from flowloom.sources.capture import decode_capture, read_captures, read_segments, redecode
from flowloom.sources.uploads import SessionState, UploadRefused, batches_of, decode_landing, joined, land_part, landed_flows


def test_parts_in_any_order():
    data = bytes(range(200))
    parts = list(batches_of(data, 60))
    assert joined([parts[2], parts[0], parts[0], parts[1], parts[3]]) == data
    assert joined([parts[0], parts[2]]) == data[:60] and joined(parts[1:]) == b""


def test_live_decoding(spark, tmp_path):
    folder, out = tmp_path / "in", tmp_path / "out"
    folder.mkdir()
    data = pcap([tcp(C, S, 100, ASK), tcp(S, C, 500, ANSWER)])
    seen = []
    for at, part in batches_of(data, 130):
        land_part(str(folder), "s1", "pcap", at, part)
        decode_landing(spark, str(folder), str(out), str(tmp_path / "state"), available_now=True).awaitTermination()
        seen.append([(r.method, r.status) for r in landed_flows(spark, str(out)).collect()])
    assert seen[-1] == [("GET", 302)]
    with pytest.raises(UploadRefused):
        land_part(str(folder), "../s", "pcap", 0, b"x")
    with pytest.raises(UploadRefused):
        land_part(str(folder), "s", "pcap", 0, b"xx", ceiling=1)


def test_session_course():
    s = SessionState()
    assert s.to("decoding") and s.to("closed") and not s.to("error")
    with pytest.raises(ValueError):
        SessionState("decoding").to("open")
    assert SessionState("open").to("error", force=True)


def test_custom_decoder_in_a_capture(spark, tmp_path):
    frame = b"\1\2\0\7\0\5\0\0\0\4\x81\xa1a\x01"
    (tmp_path / "one.pcap").write_bytes(pcap([tcp(C, S, 1, frame[:7]), tcp(C, S, 8, frame[7:]), tcp(S, C, 9, frame)]))
    r = Registry()
    r.register("framed", lambda m: m.port == 80, FramedSession)
    row = decode_capture(read_segments(spark, str(tmp_path)), registry=r).first()
    assert row.protocol == "framed" and [(m.from_client, m.opcode) for m in row.messages] == [(True, "Push(2)"), (False, "Push(2)")]


def test_redecode_replaces_the_registrys_protocols_alone(spark, tmp_path):
    frame = b"\1\2\0\7\0\5\0\0\0\4\x81\xa1a\x01"
    (tmp_path / "one.pcap").write_bytes(pcap([tcp(C, S, 1, frame), tcp(S, C, 9, frame)]))
    r = Registry()
    r.register("framed", lambda m: m.port == 80, FramedSession)
    captures = read_captures(spark, str(tmp_path))
    first = decode_capture(read_segments(spark, str(tmp_path)), registry=r).filter("reason IS NULL")
    kept = first.withColumn("protocol", F.lit("HTTP/1.1")).withColumn("id", F.lit("kept"))
    again = redecode(first.withColumn("error", F.lit("old")).unionByName(kept), captures, r, ["framed"]).collect()
    assert sorted((x.protocol, x.error) for x in again) == [("HTTP/1.1", ""), ("framed", "")]
