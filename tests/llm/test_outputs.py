"""Packing, mixing, sharding, the token store: exact round trips and invariants."""

import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from veilspark.llm import bpe, mixing, packing, sharding, tokenstore
from veilspark.llm import textvec as tv

from .fixtures import documents, table

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(name):
    t = Tokenizer.from_file(public_tokenizers.path(name))
    return lambda x: t.encode(x or "", add_special_tokens=False).ids


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=" \n\t\r\x0b\x1c'sSaX1.,é́  　日😀<|>"), min_size=1, max_size=6))
def test_memoised_ids_are_the_tokenizers(name, texts):
    enc, want = bpe.encoder(public_tokenizers.path(name)), plain(name)
    for c in tv.chunks(pa.array(texts), 20):
        ids, docs = enc.encode(c)
        for i in range(c.n):
            assert ids[docs[i] : docs[i + 1]].tolist() == want(texts[c.lo + i])


def test_packing(spark):
    rows, want = documents(), plain("byte_bpe_50k.json")
    got = packing.pack(table(spark), keep_ids=True).collect()
    by_seq = defaultdict(list)
    for r in got:
        assert r.length * 4 == len(r.ids) and zlib.crc32(r.ids) == r.ids_crc32
        by_seq[r.sequence_id].append((r.offset, r.length))
    for parts in by_seq.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= packing.SIZE
    assert len(by_seq) <= -(-sum(r.length for r in got) // packing.SIZE) + 1
    pieces = Counter((r.doc_id, r.piece, r.start, r.length, bytes(r.ids)) for r in got)
    expect = Counter()
    for r in rows:
        ids = np.array([*want(r[1]), 2], "<u4")
        k = -(-len(ids) // 1024)
        head = len(ids) - (k - 1) * 1024
        cut = [0, *range(head, len(ids) + 1, 1024)]
        for p, (a, b) in enumerate(zip(cut, cut[1:])):
            expect[(r[0], p, a, b - a, ids[a:b].tobytes())] += 1
    assert pieces == expect
    seq = packing.sequences(packing.pack(table(spark), keep_ids=True))
    assert all(len(r.ids) == 4 * r.length for r in seq.collect())


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 40), min_size=1, max_size=20))
def test_bin_plan_places_every_piece_once(histogram):
    fill = defaultdict(list)
    for n, lo, hi, seq, off in packing.bin_plan(histogram, 64):
        for i in range(hi - lo):
            fill[seq + i].append((off, n))
    assert Counter(n for parts in fill.values() for _, n in parts) == Counter(histogram)
    for parts in fill.values():
        at = 0
        for off, n in sorted(parts):
            assert off == at
            at += n
        assert at <= 64


def fewest_bins(pieces, size):
    """By trying every way to put each piece into an open bin or a new one."""
    best = len(pieces)

    def place(i, rooms):
        nonlocal best
        if len(rooms) >= best:
            return
        if i == len(pieces):
            best = len(rooms)
            return
        for k in {r: k for k, r in enumerate(rooms) if r >= pieces[i]}.values():
            place(i + 1, [*rooms[:k], rooms[k] - pieces[i], *rooms[k + 1 :]])
        place(i + 1, [*rooms, size - pieces[i]])

    place(0, [])
    return best


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(1, 20), min_size=1, max_size=8))
def test_bin_plan_against_the_optimum(pieces):
    used = {seq + i for _, lo, hi, seq, _ in packing.bin_plan(Counter(pieces), 20) for i in range(hi - lo)}
    assert fewest_bins(sorted(pieces, reverse=True), 20) <= len(used) <= fewest_bins(sorted(pieces, reverse=True), 20) + 1


def test_fullest_is_fullest():
    counts = [0] * 21
    for n in (13, 6, 5, 4, 4):
        counts[n] += 1
    assert packing.fullest(counts, 20) == {13: 1, 6: 1} or sum(n * k for n, k in packing.fullest(counts, 20).items()) == 19
    counts[7] += 1
    assert sum(n * k for n, k in packing.fullest(counts, 20).items()) == 20


def test_pivot_keeps_totals_and_expectation():
    rng = np.random.default_rng(0)
    part, size = rng.random(300), rng.integers(1, 500, 300)
    mean = np.zeros(300)
    for k in range(300):
        out, left, p = mixing.pivot(part, size, np.random.default_rng(k))
        total = (out * size).sum() + (p * size[left] if left >= 0 else 0)
        assert abs(total - (part * size).sum()) < 1e-6
        mean += out / 300
    assert abs((mean - part).mean()) < 0.01 and np.abs(mean - part).max() < 0.15


def test_mixing(spark):
    df = table(spark)
    got = mixing.mix(df).collect()
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, mixing.mix(df).collect()), key=str)
    assert Counter((r.doc_id, r.size) for r in got) == Counter((r[0], len(WORD.findall(r[1] or ""))) for r in documents())
    total = sum(r.size for r in got)
    by = defaultdict(list)
    for r in got:
        assert r.taken <= 3 * r.size and r.taken % max(1, r.size) == 0
        by[(r.source_size, r.target)].append(r)
    assert abs(sum(t for _, t in by) - total) < 1e-6
    for (size, target), rows in by.items():
        assert target <= 3 * size + 1e-9 and abs(sum(r.taken for r in rows) - target) <= max(r.size for r in rows)
    mixed = mixing.mixed_documents(df)
    assert mixed.columns == df.columns and mixed.count() == sum(r.copies for r in got)


def test_targets_share_the_excess(spark):
    src = spark.createDataFrame([("a", 10, 1), ("b", 1000, 1), ("c", 10, 1), (None, 1000, 1)], "source string, source_size long, n long")
    got = {r.source: r.target for r in mixing.source_targets(src).collect()}
    assert got["a"] == 30 and got["c"] == 30 and abs(got["b"] - 1960 * 2 / 3) < 1e-6 and abs(got[None] - 1960 / 3) < 1e-6


def brute_targets(sizes, weights):
    """Words by weight, again and again what is above the cap goes to the others by weight."""
    got, closed = {k: 0.0 for k in sizes}, set()
    left = float(sum(sizes.values()))
    while left > 1e-9 and len(closed) < len(sizes):
        w = sum(weights[k] for k in sizes if k not in closed)
        share = {k: left * weights[k] / w for k in sizes if k not in closed}
        left = 0.0
        for k, x in share.items():
            got[k] += x
            if got[k] >= 3 * sizes[k]:
                left += got[k] - 3 * sizes[k]
                got[k] = 3.0 * sizes[k]
                closed.add(k)
    return got


@pytest.mark.parametrize("sizes", [[10, 1000, 10, 1000], [1, 1, 1, 1], [5, 0, 700, 3, 40], [0, 0], [900, 2, 2, 2, 2, 2, 2]])
def test_targets_against_brute_force(spark, sizes):
    names = [f"s{i}" for i in range(len(sizes) - 1)] + [None]
    want = brute_targets(dict(zip(names, sizes)), {n: i % 3 + 1 for i, n in enumerate(names)})
    got = {r.source: r.target for r in mixing.source_targets(spark.createDataFrame([(n, s, 1) for n, s in zip(names, sizes)], "source string, source_size long, n long")).collect()}
    assert all(abs(got[k] - want[k]) < 1e-6 for k in want)


def test_mixing_tree_over_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK", 8)
    monkeypatch.setattr(mixing, "FAN_IN", 4)
    rows = [(i, " ".join(["w"] * (1 + i % 13)), "abc"[i % 3]) for i in range(900)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    by = defaultdict(int)
    for r in got:
        by[(r.source_size, r.target)] += r.taken
    assert all(abs(t - x[1]) <= 13 for x, t in by.items()) and len(got) == 900


def test_sharding(spark, tmp_path):
    df = table(spark)
    from veilspark.llm.workspace import pick

    got = sharding.assign(pick(df, "doc_id", "text"), "doc_id", []).collect()
    n = Counter(r["shard"] for r in got)
    assert len(got) == len(documents()) and max(n.values()) - min(n[s] for s in range(16)) <= 1
    for s in n:
        assert sorted(r.slot for r in got if r["shard"] == s) == list(range(n[s]))
    sharding.write_shards(df, "doc_id", str(tmp_path / "out"), 4)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == len(documents()) and set(df.columns) <= set(back.columns)


def owners(counts, shards):
    return {(s["pos"], i): s["shard"] for s in sharding.ring_plan(counts, shards) for i in range(s["lo"], s["hi"])}


def brute_owners(counts, shards):
    """Row by row: its own shard if that has room, else, after all others, the next one clockwise that has."""
    nodes = sharding.ring_nodes(shards)
    total = sum(counts.values())
    room = {s: total // shards + (s < total % shards) for s in range(shards)}
    out, over = {}, []
    for pos in sorted(counts):
        at = next((i for i, (p, _) in enumerate(nodes) if p >= pos), 0)
        for i in range(counts[pos]):
            s = nodes[at][1]
            if room[s]:
                out[pos, i] = s
                room[s] -= 1
            else:
                over.append((pos, i, at))
    for pos, i, at in over:
        while not room[nodes[at][1]]:
            at = (at + 1) % len(nodes)
        out[pos, i] = nodes[at][1]
        room[nodes[at][1]] -= 1
    return out


@settings(max_examples=30, deadline=None)
@given(st.dictionaries(st.integers(0, sharding.RING - 1), st.integers(1, 30), min_size=1, max_size=60), st.integers(1, 9))
def test_ring_against_brute_force(counts, shards):
    assert owners(counts, shards) == brute_owners(counts, shards)


@pytest.mark.parametrize("counts,most", [({p: 3 for p in range(sharding.RING)}, 0.10), ({p: 1 + p * 7919 % 13 for p in range(sharding.RING)}, 0.13), ({p: 40 if p % 97 == 0 else 1 for p in range(sharding.RING)}, 0.17)])
def test_ring_moves_little(counts, most):
    """One more shard of 16 must take 1/17 of the rows; the rest of what moves makes room for the new shares."""
    a, b = owners(counts, 16), owners(counts, 17)
    moved = sum(a[k] != b[k] for k in a) / len(a)
    assert 1 / 17 - 0.001 <= moved < most


def test_hot_keys_are_ranked_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(sharding, "HOT_ROWS", 20)
    rows = [(None if i % 3 else i, str(i % 50)) for i in range(600)]
    got = sharding.assign(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", ["text"]).collect()
    n = Counter(r["shard"] for r in got)
    assert Counter((r.doc_id, r.text) for r in got) == Counter(rows) and max(n.values()) - min(n[s] for s in range(16)) <= 1
    assert all(sorted(r.slot for r in got if r["shard"] == s) == list(range(n[s])) for s in n)


def test_token_store(spark, tmp_path):
    path, df = str(tmp_path / "s"), table(spark)
    tokenstore.write_store(df, path, shard_bytes=2000, range_bytes=9000)
    got = tokenstore.lookup(spark, path, df, keep_ids=True).collect()
    want, expect, at = plain("word_bpe_49k.json"), Counter(), 0
    assert tokenstore.open_store(spark, path).count() > 3
    for r in documents():
        expect[(r[0], np.array([*want(r[1]), 1], "<u4").tobytes())] += 1
    assert Counter((r.doc_id, bytes(r.ids)) for r in got) == expect
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == at and r.n_tokens * 4 == len(r.ids) and r.ids_crc32 == zlib.crc32(r.ids)
        at += r.n_tokens
    ids = [r.doc_id for r in sorted(got, key=lambda r: r.start)]
    assert ids == sorted(ids, key=lambda x: -(1 << 62) if x is None else x)
    assert tokenstore.lookup(spark, path, spark.createDataFrame([(1,), (10**9,)], "doc_id long")).count() == 0
    few = tokenstore.lookup(spark, path, spark.createDataFrame([(6,), (None,), (9,)], "doc_id long"), keep_ids=True).collect()
    assert Counter((r.doc_id, bytes(r.ids)) for r in few) == Counter({k: n for k, n in expect.items() if k[0] in (6, None, 9)})


def test_perfect_hash_is_minimal():
    keys = np.unique(np.random.default_rng(1).integers(-(1 << 60), 1 << 60, 5000))
    _, number, prints = tokenstore.build_index(keys)
    assert sorted(number) == list(range(len(keys))) and len(prints) == len(keys)


def test_empty_tables(spark, tmp_path):
    none = table(spark, [])
    assert packing.pack(none).count() == mixing.mix(none).count() == mixing.mixed_documents(none).count() == sharding.assign(none.select("doc_id"), "doc_id", []).count() == 0
    tokenstore.write_store(none, str(tmp_path / "e"))
    assert tokenstore.lookup(spark, str(tmp_path / "e"), none).count() == 0
