import pytest

from logweave.operators import commands as C
from logweave.sources import logfiles as S

RECORDS = [(1, bytes([i]) * (i * 7 % 23)) for i in range(10)]


def write(folder, segments):
    for seq, tag, body in segments:
        (folder / S.segment_name(seq, tag)).write_bytes(body)
    return f"file://{folder}"


def body(records):
    return b"".join(S.frame(k, d) for k, d in records)


def read(spark, folder, **a):
    return [(r.type, bytes(r.data)) for r in S.read_wal(spark, folder, **a).orderBy("seq", "offset").collect()]


def test_checksum():
    assert S.crc32c(b"123456789") == 0xE3069283 and S.crc32c(b"") == 0


def test_replay(spark, tmp_path):
    assert read(spark, write(tmp_path, [(1, 1, body(RECORDS))])) == RECORDS


@pytest.mark.parametrize("cut", [1, 5, 9, 12])
def test_torn_tail_of_the_last_segment(spark, tmp_path, cut):
    assert read(spark, write(tmp_path, [(1, 1, body(RECORDS[:9]) + S.frame(1, b"x" * 20)[:-cut])])) == RECORDS[:9]


def test_flipped_bit(spark, tmp_path):
    bad = bytearray(body(RECORDS))
    bad[-1] ^= 1
    assert read(spark, write(tmp_path, [(1, 1, bytes(bad))])) == RECORDS[:9]
    with pytest.raises(Exception, match="does not match its checksum"):
        read(spark, write(tmp_path, [(2, 5, body(RECORDS))]))


def test_segments(spark, tmp_path):
    folder = write(tmp_path, [(2, 6, body(RECORDS[5:])), (1, 1, body(RECORDS[:5])), (10, 11, b"")])
    assert read(spark, folder) == RECORDS and read(spark, folder, min_seq=2) == RECORDS[5:]
    assert [(r.seq, r.tag) for r in S.list_segments(spark, folder).orderBy("seq").collect()] == [(1, 1), (2, 6), (10, 11)]
    (tmp_path / "foreign.wal").write_bytes(b"")
    with pytest.raises(ValueError, match="not named like a segment"):
        S.list_segments(spark, folder)


def test_damage_before_an_empty_segment_is_fatal(spark, tmp_path):
    folder = write(tmp_path, [(1, 1, body(RECORDS)[:-3]), (2, 11, b"")])
    with pytest.raises(Exception, match="does not match its checksum"):
        read(spark, folder)
    assert read(spark, folder, min_seq=2) == []


def entry(idx, term, data=b"", noop=False):
    return (S.ENTRY, S.encode_message([(1, idx), (2, term), (3, int(noop)), (4, data)]))


def test_load_log(spark, tmp_path):
    vote = lambda t, v: (S.HARD_STATE, S.encode_message([(1, t), (2, v)]))
    first = [vote(1, "a"), *[entry(i, 1) for i in range(1, 11)]]
    folder = write(tmp_path, [(1, 1, body(first)), (2, 11, body([vote(2, "b"), entry(6, 2), entry(7, 2)]))])
    entries, hard = S.load_log(spark, folder)
    assert [(r.idx, r.term) for r in entries.orderBy("idx").collect()] == [*[(i, 1) for i in range(1, 6)], (6, 2), (7, 2)]
    assert tuple(hard.first()) == (2, "b")
    assert [r.idx for r in S.load_log(spark, folder, snapshot_index=5)[0].orderBy("idx").collect()] == [6, 7]
    with pytest.raises(ValueError, match="entries are missing"):
        S.load_log(spark, folder, min_seq=2)


def test_snapshots(spark, tmp_path):
    meta = lambda i: S.encode_message([(1, i), (2, 3), (3, 4)])
    for i in (5, 16):
        (tmp_path / f"snap-{i:016x}-{3:016x}.snap").write_bytes(S.snapshot_bytes(meta(i), b"state %d" % i))
    r = S.read_snapshots(spark, f"file://{tmp_path}").first()
    assert (r.last_index, r.last_term, r.min_segment, bytes(r.data)) == (16, 3, 4, b"state 16")
    p = tmp_path / f"snap-{32:016x}-{3:016x}.snap"
    p.write_bytes(S.snapshot_bytes(meta(32), b"new")[:-1] + b"?")
    with pytest.raises(Exception, match="damaged snapshot"):
        S.read_snapshots(spark, f"file://{tmp_path}").collect()


def test_commands_from_files(spark, tmp_path):
    rows = [S.encode_command("PUT", "k", b"v", request_id="r"), S.encode_command("DELETE", "k", expected=1), S.encode_command("DELETE", "k")]
    folder = write(tmp_path, [(1, 1, body([entry(1, 1, noop=True), *[entry(i + 2, 1, d) for i, d in enumerate(rows)]]))])
    made = S.commands(S.load_log(spark, folder)[0])
    got = C.apply(made).orderBy("log_index").collect()
    assert [(r.log_index, r.status, r.version) for r in got] == [(2, "OK", 1), (3, "OK", 2), (4, "NOT_FOUND", 0)]


def test_wire_form():
    body = S.encode_message([(1, 300), (2, "é"), (3, b""), (9, -1)])
    assert S.decode_message(body) == {1: [300], 2: ["é".encode()], 9: [(1 << 64) - 1]}
