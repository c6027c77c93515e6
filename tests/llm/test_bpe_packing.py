"""Encoding against the tokenizers library; packing against its rules and a plain packer."""

from __future__ import annotations

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from contest_analytics.llm import bpe, packing

PATH = public_tokenizers.path("word_bpe_49k.json")
LETTERS = "abcdeétÉßİΣσςǰJ̌ŁñÑ0123½²Ⅷªº '’.,!?\n\t\x1c\x85\xa0 ​-_#<|>🙂中文字アé"


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def texts():
    rng = random.Random(4)
    made = ["".join(rng.choice(LETTERS) for _ in range(rng.randint(0, 60))) for _ in range(3000)]
    made += ["".join(rng.choice("aeinrst") for _ in range(rng.randint(1, 30))) for _ in range(3000)]
    made += ["a<|endoftext|>b <|startoftext|>", "<|ENDOFTEXT|>", "a" * 700, "ha" * 2000, "abab" * 300]
    return [*made, "I'll we've they're can't DON'T 'S", "\x00", ""]


def test_ids_equal_the_library(library):
    words, names = bpe.load(PATH)
    for text in texts():
        want = library.encode(text, add_special_tokens=False).ids
        got = np.frombuffer(words.ids(text), "<u4")
        assert got.tolist() == want, ascii(text)
        assert bpe.decode(got, names) == library.decode(want, skip_special_tokens=False)


def test_every_token_encodes_to_itself(library):
    model = __import__("json").load(open(PATH, encoding="utf-8"))["model"]
    encode = bpe.PrefixEncoder(model)
    whole = [t for t in model["vocab"] if t.endswith("</w>")]
    assert all(encode(t.removesuffix("</w>")) == [model["vocab"][t]] for t in whole)


def test_small_caches_change_nothing(monkeypatch):
    words, _ = bpe.load(PATH)
    want = [words.ids(t) for t in texts()[:400]]
    monkeypatch.setattr(bpe, "CACHE", 3)
    assert [words.ids(t) for t in texts()[:400]] == want


def test_round_trip_rows(spark, odd, library):
    rows = bpe.round_trip(odd, PATH).collect()
    assert len(rows) == odd.count()
    by_id = {r.doc_id: r for r in rows}
    for r in odd.filter("doc_id is not null").collect():
        ids = library.encode(r.text or "", add_special_tokens=False).ids
        got = by_id[r.doc_id]
        assert got.n_tokens == len(ids)
        assert got.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        back = library.decode(ids, skip_special_tokens=False)
        assert got.decoded_sha256 == hashlib.sha256(back.encode()).hexdigest()
    encoded = bpe.encode(odd, PATH)
    back = bpe.decoded(encoded, PATH)
    assert back.count() == odd.count()
    assert bpe.round_trip(odd.limit(0), PATH).count() == 0


def check_packing(rows, docs, library, size):
    """Every id is in one piece, pieces fill sequences without gap or overlap."""
    for r in rows:
        assert 0 < r.length <= size
    bins = {}
    for r in rows:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= size
    want = []
    for i, text in docs:
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 0]
        for n, at in enumerate(range(0, len(ids), size)):
            part = np.array(ids[at : at + size], "<u4")
            want.append((-1 if i is None else i, n, at, len(part), zlib.crc32(part.tobytes())))
    got = [(-1 if r.doc_id is None else r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows]
    assert sorted(got) == sorted(want)
    return len(bins)


@pytest.mark.parametrize("size", [64, 2048])
def test_pack_a_table(spark, sf_dir, library, size):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").repartition(5)
    rows = packing.pack(docs, PATH, size).collect()
    n = check_packing(rows, [(r.doc_id, r.text) for r in docs.collect()], library, size)
    assert n <= sum(r.length for r in rows) / size * 1.01 + 1


def test_pack_odd_rows(odd, library):
    rows = packing.pack(odd, PATH, 32, keep_ids=True).collect()
    check_packing(rows, [(r.doc_id, r.text) for r in odd.collect()], library, 32)
    assert all(len(r.ids) == r.length for r in rows)
    assert packing.pack(odd.limit(0), PATH).count() == 0


def plain_two_fit(lengths, room):
    """Piece by piece: greedy, then the smallest for the two that fill its gap best."""
    left, bins = sorted(lengths, reverse=True), 0
    while left:
        gap, own = room, []
        while fits := [x for x in left if x <= gap]:
            own.append(fits[0])
            left.remove(fits[0])
            gap -= fits[0]
        if gap and len(own) > 1:
            wide = gap + min(own)
            pairs = [(a + b, a, b) for i, a in enumerate(left) for b in left[i + 1 :] if min(own) < a + b <= wide]
            if pairs:
                _, a, b = max(pairs)
                left.append(min(own))
                left.remove(a)
                left.remove(b)
                left.sort(reverse=True)
        bins += 1
    return bins


def test_plan_holds_all_pieces_and_is_as_good_as_piece_by_piece():
    rng = random.Random(6)
    for _ in range(30):
        room = rng.randint(5, 60)
        lengths = [rng.randint(1, room) for _ in range(rng.randint(0, 80))] + [room // 2 + 1] * rng.randint(0, 20)
        counts = np.bincount(lengths, minlength=room + 1) if lengths else np.zeros(room + 1, int)
        plan = packing.best_two_fit(counts)
        held = np.zeros(room + 1, int)
        for often, parts in plan:
            assert often > 0 and sum(n * m for n, m in parts) <= room
            for n, m in parts:
                held[n] += often * m
        assert held.tolist() == counts.tolist()
        assert sum(often for often, _ in plan) <= plain_two_fit(lengths, room) + 1


def test_smallest_piece_makes_room_for_two():
    counts = np.bincount([6, 3, 2, 2], minlength=11)
    # Greedy takes 6 and 3 with a gap of 1; 2 and 2 fill it.
    assert packing.best_two_fit(counts) == [(1, [(6, 1), (2, 2)]), (1, [(3, 1)])]
