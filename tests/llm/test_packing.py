import random
import struct
import zlib

import public_tokenizers
import pytest
from helpers import DOCS, ODD, clashing, prose
from tokenizers import Tokenizer

from siftline.llm import packing, wordwise

PATH = public_tokenizers.path("word_bpe_49k.json")


def test_words_give_the_texts_ids():
    model = Tokenizer.from_file(PATH)
    rng = random.Random(3)
    signs = "aAeE'’s.,;<|>1²é́ß İΣ \n\t \x1c日"
    texts = ["It's <|endoftext|> HERE don't. x<|STARTOFTEXT|>y", "caf́e H̱", "a.,b.. c»., d'S 'RE we'll", "Σίσυφος ΣΑΣ.", "", "  x\x1fy\x85z"]
    texts += ["".join(rng.choice(signs) for _ in range(rng.randint(1, 25))) for _ in range(5000)]
    want = [struct.pack(f"<{len(e.ids)}I", *e.ids) for e in model.encode_batch(texts, add_special_tokens=False)]
    assert wordwise.encode_texts(texts, PATH) == want
    assert [wordwise.encode_texts([t], PATH)[0] for t in texts[:400]] == want[:400]


def test_long_texts_are_encoded_in_parts(monkeypatch):
    monkeypatch.setattr(wordwise, "STEP", 64)
    monkeypatch.setattr(wordwise, "KEEP", 5)
    model, rng = Tokenizer.from_file(PATH), random.Random(4)
    texts = [" ".join(rng.choice(["it's", "x=1,", "Größe.", "e\u0301", "<|endoftext|>", "(日本)", "a" * 90, "..."]) for _ in range(rng.choice([0, 1, 3, 200]))) for _ in range(60)]
    assert wordwise.encode_texts(texts, PATH) == [struct.pack(f"<{len(e.ids)}I", *e.ids) for e in model.encode_batch(texts, add_special_tokens=False)]


@pytest.mark.parametrize("max_len", [64, 2048])
def test_round_trip(spark, max_len):
    rng = random.Random(1)
    docs = [(i, prose(rng, rng.choice([0, 1, 5, 30, 200, 900]), 500)) for i in range(300)] + ODD
    df = clashing(spark.createDataFrame(docs, DOCS))
    pieces = packing.token_pieces(df, PATH, max_len=max_len, by_word=True, with_ids=True)
    packed = packing.pack(pieces, max_len, rows_per_group=20).collect()
    model = Tokenizer.from_file(PATH)
    lengths = 0
    for d, t in docs:
        ids = [*model.encode(t or "", add_special_tokens=False).ids, 0]
        lengths += len(ids)
        own = sorted((r for r in packed if r.doc_id == d), key=lambda r: r.piece)
        own = own[:: sum(x == (d, t) for x in docs)]
        assert [r.start for r in own] == list(range(0, len(ids), max_len))
        assert b"".join(r.ids for r in own) == struct.pack(f"<{len(ids)}I", *ids)
        assert all(zlib.crc32(r.ids) == r.ids_crc32 and r.length == len(r.ids) // 4 for r in own)
    assert sum(r.length for r in packed) == lengths
    bins = {}
    for r in packed:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for held in bins.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= max_len
    assert len(bins) <= len(first_fit([r.length for r in packed], max_len))


def first_fit(lengths, max_len):
    """Bins of the plain way: from the longest, into the first bin with room."""
    gaps = []
    for x in sorted(lengths, reverse=True):
        at = next((i for i, g in enumerate(gaps) if g >= x), None)
        if at is None:
            gaps.append(max_len - x)
        else:
            gaps[at] -= x
    return gaps


def plan_is_sound(counts, max_len):
    plan = packing.best_two_fit(counts, max_len)
    used = {}
    for n, held in plan:
        assert sum(held) <= max_len and n > 0
        for x in held:
            used[x] = used.get(x, 0) + n
    assert used == {k: v for k, v in counts.items() if v}
    return sum(n for n, _ in plan)


def test_plan_is_tight():
    rng = random.Random(7)
    for _ in range(20):
        counts = {}
        for _ in range(2000):
            x = min(100, max(1, int(rng.lognormvariate(3, 1))))
            counts[x] = counts.get(x, 0) + rng.choice([1, 1, 50])
        bins = plan_is_sound(counts, 100)
        least = -(-sum(k * v for k, v in counts.items()) // 100)
        assert bins <= 1.01 * least + 1


def test_swap_of_the_smallest_for_two():
    # greedily 6 + 3 leaves 1; the 3 goes and 2 + 2 fill its place
    assert packing.best_two_fit({6: 1, 3: 1, 2: 2}, 10)[0] == (1, [6, 2, 2])


def test_plan_does_not_grow_with_the_corpus():
    counts = {x: 1 + x * 7919 % 1000 for x in range(1, 2049)}
    small, large = packing.best_two_fit(counts, 2048), packing.best_two_fit({k: 1000 * v for k, v in counts.items()}, 2048)
    assert len(large) < 3 * len(small) < 60_000
    assert plan_is_sound({}, 5) == 0 and plan_is_sound({5: 3}, 5) == 3 and plan_is_sound({3: 3}, 5) == 3


def plain_best_two_fit(lengths, max_len):
    """Bins one by one over the pieces themselves."""
    left, bins = sorted(lengths, reverse=True), []
    while left:
        held = []
        while True:
            fits = [x for x in left if x <= max_len - sum(held)]
            if not fits:
                break
            held.append(fits[0])
            left.remove(fits[0])
        while sum(held) < max_len and held:
            low = min(held)
            room = max_len - sum(held) + low
            best = max((left[i] + left[j] for i in range(len(left)) for j in range(i) if left[i] + left[j] <= room), default=0)
            if best <= low:
                break
            a, b = max((left[i], left[j]) for i in range(len(left)) for j in range(len(left)) if i != j and left[i] + left[j] == best and left[i] <= left[j])
            held.remove(low)
            for x in (a, b):
                held.append(x)
                left.remove(x)
            left = sorted([*left, low], reverse=True)
        bins.append(sorted(held, reverse=True))
    return bins


def test_plan_equals_the_plain_way():
    rng = random.Random(9)
    for _ in range(60):
        max_len = rng.choice([10, 25, 60])
        lengths = [rng.randint(1, max_len) for _ in range(rng.randint(0, 45))]
        counts = {x: lengths.count(x) for x in lengths}
        bins = [held for n, held in packing.best_two_fit(counts, max_len) for _ in range(n)]
        want = plain_best_two_fit(lengths, max_len)
        assert sorted(x for held in bins for x in held) == sorted(lengths)
        assert all(sum(held) <= max_len for held in bins) and len(bins) <= len(want) + 1
        if len(set(lengths)) == len(lengths):  # without equal bins both take the same steps, up to ties of equal sums
            assert sorted(map(sum, bins))[-1:] == sorted(map(sum, want))[-1:]


def test_empty(spark):
    pieces = packing.token_pieces(spark.createDataFrame([], DOCS), PATH, by_word=True)
    assert packing.pack(pieces).count() == 0
