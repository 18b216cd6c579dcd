"""Operators 1, 4 and 10 against the tokenizers library."""

import zlib

import numpy as np
from tokenizers import Tokenizer

from ledgerloom.llm import common, packing, token_count, token_files
from tests.llm.conftest import rows_of


def _ids(path, rows):
    t = Tokenizer.from_file(path)
    return [(k, t.encode(x or "", add_special_tokens=False).ids) for k, x in rows]


def _key(row):
    return tuple((x is not None, x) for x in row)


def test_counts_equal_the_library(docs, odd_rows, byte_bpe):
    got = rows_of(token_count.token_counts(docs(odd_rows), byte_bpe), "doc_id", "n_bytes", "n_tokens", "over_limit")
    want = sorted(((k, len((x or "").encode()), len(ids), len(ids) > 512) for (k, x), (_, ids) in zip(odd_rows, _ids(byte_bpe, odd_rows))), key=_key)
    assert got == want


def test_empty_tables(docs, byte_bpe, spark):
    none = docs([])
    assert token_count.token_counts(none, byte_bpe).count() == 0
    assert packing.pack(none, byte_bpe).count() == 0
    assert token_files.read_index(token_files.write_tokens(none, byte_bpe, common.fresh_dir(spark, "t"))).count() == 0


def test_files_round_trip(docs, odd_rows, byte_bpe, spark):
    manifest = token_files.write_tokens(docs(odd_rows), byte_bpe, common.fresh_dir(spark, "t"))
    got = token_files.read_index(manifest).collect()
    order = sorted(zip(odd_rows, _ids(byte_bpe, odd_rows)), key=lambda p: (p[0][0] is not None, p[0][0], p[0][1] or ""))
    start, want = 0, []
    for (k, _), (_, ids) in order:
        full = np.array(ids + [0], "<u4")
        want.append((k, start, len(full), zlib.crc32(full.tobytes())))
        start += len(full)
    assert sorted(map(tuple, got), key=_key) == sorted(want, key=_key)


def test_reader_takes_single_documents(tmp_path):
    docs = [(5, np.arange(9, dtype="<u4").tobytes()), (None, b""), (7, np.array([1, 2], "<u4").tobytes())]
    uri = f"file://{tmp_path}/a.zst"
    assert token_files.write_file(uri, docs) == (3, 11)
    f = token_files.TokenFile(uri)
    assert f.doc_ids == [5, None, 7] and f.read(7).tolist() == [1, 2] and f.raw(1) == b""
    raw = bytearray((tmp_path / "a.zst").read_bytes())
    raw[10] ^= 1
    (tmp_path / "b.zst").write_bytes(raw)
    try:
        token_files.TokenFile(f"file://{tmp_path}/b.zst").raw(0)
        raise AssertionError("a damaged frame was read")
    except Exception as e:  # noqa: BLE001  zstandard's own error, or the checksum's
        assert not isinstance(e, AssertionError)


def test_packing(docs, odd_rows, byte_bpe):
    got = packing.pack(docs(odd_rows), byte_bpe, capacity=256, piece=64, block=4).toPandas()
    want = sorted(zlib.crc32(np.array(ids + [1], "<u4").tobytes()) for _, ids in _ids(byte_bpe, odd_rows))
    assert sorted(got.groupby("sequence_id")["length"].sum())[-1] <= 256
    for _, s in got.sort_values("offset").groupby("sequence_id"):
        assert (s["offset"].to_numpy() == np.cumsum(s["length"]) - s["length"]).all()
    by_start = got[got["length"] == got["doc_tokens"]]
    assert set(by_start["ids_crc32"]) <= set(want)
    assert got["length"].sum() == sum(len(ids) + 1 for _, ids in _ids(byte_bpe, odd_rows))
    # pieces of a document follow each other
    one = got[got["doc_id"] == 8].sort_values("start")
    ids = np.array(_ids(byte_bpe, [odd_rows[10]])[0][1] + [1], "<u4")
    assert [zlib.crc32(ids[r.start : r.start + r.length].tobytes()) for r in one.itertuples()] == one["ids_crc32"].tolist()


def test_one_id_fills_several_files(docs, spark, byte_bpe):
    """Files follow the size of the texts, and rows of one id, or of none, are split like others."""
    rows = [(7, f"text {i} " * 50) for i in range(60)] + [(None, f"other {i} " * 50) for i in range(60)]
    manifest = token_files.write_tokens(docs(rows), byte_bpe, common.fresh_dir(spark, "t"), file_bytes=4096)
    assert manifest.count() > 6 and max(r["docs"] for r in manifest.collect()) < 60
    got = sorted((r["start"], r["doc_id"], r["n_tokens"]) for r in token_files.read_index(manifest).collect())
    assert [r[1] for r in got] == [None] * 60 + [7] * 60 and all(a[0] + a[2] == b[0] for a, b in zip(got, got[1:]))


def test_partition_of_pieces_follows_the_plain_rule():
    """The same sums and members as a merge that sorts all sets anew each time."""
    import random

    from ledgerloom.llm import differencing

    def plain(sizes, ways):
        parts = [(-s, i, [(s, [i])]) for i, s in enumerate(sizes)]
        serial = len(parts)
        while len(parts) > 1:
            parts.sort(key=lambda p: p[:2])
            (_, _, a), (_, _, b) = parts[:2]
            a, b = a + [(0, [])] * (ways - len(a)), b + [(0, [])] * (ways - len(b))
            met = sorted(((x + y, p + q) for (x, p), (y, q) in zip(a, reversed(b), strict=True)), key=lambda m: -m[0])
            met = [m for m in met if m[1]]
            parts = parts[2:] + [((met[-1][0] if len(met) == ways else 0) - met[0][0], serial, met)]
            serial += 1
        return parts[0][2]

    rng = random.Random(5)
    for n, most in ((1, 9), (7, 3), (40, 50), (120, 512)):
        sizes = [rng.randint(1, most) for _ in range(n)]
        for ways in {1, 2, n // 4 + 1, n // 2 + 1, n + 2}:
            sums, sets = differencing.partition(sizes, ways)
            assert list(sums) == [s for s, _ in plain(sizes, ways)]
            members = []
            for total, tree in zip(sums, sets, strict=True):
                held = []
                differencing._leaves(tree, held)
                assert sum(sizes[i] for i in held) == total
                members += held
            assert sorted(members) == list(range(n))
