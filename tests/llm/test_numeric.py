"""Driver-side parts against brute force."""

import random
import tracemalloc
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
import tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st

from folio.llm import language
from folio.llm import shingles as shingles_module
from folio.llm.ann import BlockIndex, fit_tree
from folio.llm.bagminhash import signatures
from folio.llm.bwt_merge import repeats
from folio.llm.decontaminate import Matcher, edit_search
from folio.llm.exact_repeats import later
from folio.llm.language import Bundler, letter_codes, letter_vectors
from folio.llm.near_dup import block_links
from folio.llm.pieces import Decoder, Encoder, compile_pieces
from folio.llm.runs import anchored_runs
from folio.llm.sharding import Shard, plan_merges
from folio.llm.shingles import multisets, normalised, shingles, similarity, word_hashes
from folio.llm.token_counts import Counter as TokenCounter
from folio.llm.token_counts import ChunkMap, compile_tokenizer, compose, cut, joint

WORD, PIECE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("piece_bpe_32k.model")
ODD = "abcdefgh'stredlvm 01!?.,<|>\n\té²½ⅧΣσİ漢字😀\x1c\x85　"


@pytest.fixture(scope="module")
def counter():
    return TokenCounter(compile_tokenizer(WORD)), tokenizers.Tokenizer.from_file(WORD)


@pytest.fixture(scope="module")
def encoder():
    model = compile_pieces(PIECE)
    return Encoder(model), Decoder(model), sentencepiece.SentencePieceProcessor(model_file=PIECE)


@settings(max_examples=150, deadline=None)
@given(texts=st.lists(st.text(st.sampled_from(ODD), max_size=60), max_size=5))
def test_token_counts_equal_the_library(counter, texts):
    mine, library = counter
    assert mine.count(texts) == [len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]


def test_token_counts_of_long_words_and_special_strings(counter):
    mine, library = counter
    texts = ["a" * 5000, "ab" * 40_000 + " x y" * 40_000, "<|endoftext|>it's<|startoftext|>", "", "<|ENDOFTEXT|>"]
    assert mine.count(texts) == [len(library.encode(t, add_special_tokens=False).ids) for t in texts]


@settings(max_examples=100, deadline=None)
@given(texts=st.lists(st.text(st.sampled_from("ab 'st1!\n"), max_size=40) | st.just("<|endoftext|>a b<|startoftext|>"), max_size=4), chunk=st.integers(1, 9))
def test_chunks_of_any_size_give_the_librarys_count(counter, texts, chunk):
    mine, library = counter
    assert mine.count(texts, chunk) == [len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]


@settings(max_examples=100, deadline=None)
@given(chunks=st.tuples(*[st.text(st.sampled_from("ab 'st1!\n"), max_size=9)] * 3))
def test_chunk_maps_compose_associatively(counter, chunks):
    mine, _ = counter

    def chunk_map(chunk):
        head, middle, tail = cut(chunk)
        return ChunkMap(head, mine.emitted([middle])[0] if middle else None, tail)

    then = lambda a, b: compose(a, b, mine.emitted([joint(a, b)])[0])
    a, b, c = map(chunk_map, chunks)
    assert then(then(a, b), c) == then(a, then(b, c)) and (a.count is None) == (not any(x in chunks[0] for x in " \n"))


@settings(max_examples=150, deadline=None)
@given(texts=st.lists(st.text(st.sampled_from("abcdefghstredlvm  01!?.,\n\té²ΣσİЖиы漢字😀▁"), max_size=60), max_size=5))
def test_pieces_equal_the_library(encoder, texts):
    mine, decoder, library = encoder
    got = mine.encode(texts)
    assert [np.frombuffer(x, np.int32).tolist() for x in got] == library.encode(texts)
    assert [decoder.decode(x) for x in got] == [library.decode(np.frombuffer(x, np.int32).tolist()) for x in got]


def test_pieces_of_long_words(encoder):
    mine, _, library = encoder
    texts = ["a" * 5000, "ab" * 20_000, "hello " * 500, "é日😀" * 3000, "x" * 250_000, " a" * 700_000 + "\n" * 5000]
    assert [np.frombuffer(x, np.int32).tolist() for x in mine.encode(texts)] == library.encode(texts)


@settings(max_examples=200, deadline=None)
@given(texts=st.lists(st.binary(min_size=1, max_size=25).map(lambda b: bytes(x % 3 for x in b)), min_size=1, max_size=9), depth=st.integers(1, 12), shards=st.integers(1, 4))
def test_merged_transforms_find_all_repeats(texts, depth, shards):
    want, at = defaultdict(list), 0
    for t in texts:
        for i in range(len(t) - depth + 1):
            want[t[i : i + depth]].append(at + i)
        at += len(t)
    got = defaultdict(list)
    for place, kind in zip(*(x.tolist() for x in repeats(texts, depth, shards)), strict=True):
        got[kind].append(place)
    assert sorted(map(sorted, got.values())) == sorted(v for v in want.values() if len(v) > 1)


def test_signatures_estimate_weighted_jaccard():
    rng, gaps = np.random.default_rng(1), []
    for _ in range(150):
        n = int(rng.integers(3, 300))
        el, wa = rng.integers(0, 2**63, n).astype(np.uint64), rng.integers(1, 6, n)
        wb = np.where(rng.random(n) < 0.7, wa, rng.integers(1, 9, n))
        s = signatures(np.repeat([0, 1], n), np.concatenate([el, el]), np.concatenate([wa, wb]), 2, 512)
        gaps.append((s[0] == s[1]).mean() - np.minimum(wa, wb).sum() / np.maximum(wa, wb).sum())
    assert abs(np.mean(gaps)) < 0.005 and np.max(np.abs(gaps)) < 0.1


def _bag(text):
    w = normalised(text).split()
    return Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else Counter()


@settings(max_examples=100, deadline=None)
@given(texts=st.lists(st.text(st.sampled_from("ab .,A"), max_size=60), min_size=2, max_size=6))
def test_block_overlaps_equal_brute_force(texts):
    bags = [_bag(t) for t in texts]
    doc, h, n = multisets(*shingles([normalised(t) for t in texts]))
    for i, bag in enumerate(bags):
        assert sorted(n[doc == i]) == sorted(bag.values())
    parent = list(range(len(texts)))

    def top(x):
        return x if parent[x] == x else top(parent[x])

    for i in range(len(texts)):
        for j in range(i):
            inter, union = sum((bags[i] & bags[j]).values()), sum((bags[i] | bags[j]).values())
            part = lambda k: tuple(x[np.argsort(h[doc == k])] for x in (h[doc == k], n[doc == k]))
            assert similarity(part(i), part(j)) == (inter / union if union else 0.0)
            if union and inter / union >= 0.8:
                parent[top(i)] = top(j)
    links = block_links(texts, np.arange(len(texts)), np.arange(len(texts)), 0.8)
    mine = list(range(len(texts)))

    def find(x):
        return x if mine[x] == x else find(mine[x])

    for a, b in links:
        mine[find(a)] = find(b)
    assert all((top(i) == top(j)) == (find(i) == find(j)) for i in range(len(texts)) for j in range(i))


def _distance(p, t):
    row = [0] * (len(t) + 1)
    for i, c in enumerate(p, 1):
        new = [i]
        for j, d in enumerate(t, 1):
            new.append(min(new[-1] + 1, row[j] + 1, row[j - 1] + (c != d)))
        row = new
    return min(row)


@settings(max_examples=200, deadline=None)
@given(p=st.text(st.sampled_from("abc"), min_size=1, max_size=20), t=st.text(st.sampled_from("abc"), max_size=40))
def test_bit_parallel_distance(p, t):
    masks = {}
    for i, c in enumerate(p):
        masks[c] = masks.get(c, 0) | 1 << i
    assert edit_search(masks, len(p), t)[0] == _distance(p, t)


def test_pigeonhole_matching_equals_a_full_search():
    rnd = random.Random(3)
    items = [(i, "".join(rnd.choice("abcd ") for _ in range(40))) for i in range(6)]
    matcher = Matcher(items, 0.1, 10)
    for _ in range(60):
        base = list(items[rnd.randrange(6)][1])
        for _ in range(rnd.randint(0, 6)):
            base[rnd.randrange(len(base))] = rnd.choice("abcd ")
        text = "".join(rnd.choice("abcd ") for _ in range(50)) + "".join(base) + "".join(rnd.choice("abcd ") for _ in range(50))
        from folio.llm.decontaminate import normalised as plain

        want = [(i, d) for i, item in items if (p := plain(item)) and len(p) >= 10 and (d := _distance(p, plain(text))) <= int(0.1 * len(p))]
        assert matcher.hits(text) == want


def test_collision_counting_recall():
    rng = np.random.default_rng(0)
    x = rng.standard_normal((3000, 64))
    got = BlockIndex(np.arange(3000), np.arange(3000), x).search(np.arange(0, 3000, 100), x[::100], 10)
    got = [(q, v, d) for q, best in zip(range(0, 3000, 100), got, strict=True) for d, v in best]
    hits = 0
    for q in range(0, 3000, 100):
        d = np.sqrt(((x - x[q]) ** 2).sum(axis=1))
        d[q] = np.inf
        hits += len(set(np.argsort(d)[:10]) & {v for a, v, _ in got if a == q})
    assert hits / 300 >= 0.9


def test_search_returns_all_candidates_when_few():
    x = np.ones((4, 3))
    (got,) = BlockIndex(np.arange(4), np.array([7, 3, 5, 100]), x).search(np.array([3]), x[:1], 10)
    assert got == [(0.0, 3), (0.0, 5), (0.0, 7)]


def test_tree_places_every_vector_and_bounds_hold():
    x = np.random.default_rng(2).standard_normal((500, 20)) * np.linspace(3, 0.1, 20)
    tree = fit_tree(x[:200], 7)
    at, leaf = tree.place(x)
    assert tree.depth == 3 and set(leaf.tolist()) == set(range(8)) and np.bincount(leaf).min() > 20
    own = at[leaf == leaf[0]]
    gap = np.maximum(np.maximum(own.min(axis=0) - at, at - own.max(axis=0)), 0)
    least = np.sqrt(((x[:, None, :] - x[leaf == leaf[0]][None, :, :]) ** 2).sum(axis=2)).min(axis=1)
    assert (np.sqrt((gap * gap).sum(axis=1)) <= least + 1e-9).all()


def test_merge_plans_take_similar_sizes():
    mb = 1 << 20
    shards = [Shard(f"s{i}", 2 * mb) for i in range(9)] + [Shard("big", 200 * mb), Shard("mid", 40 * mb)]
    groups = plan_merges(shards, target=128 * mb, fanout=4)
    assert [len(g) for g in groups] == [9]
    assert plan_merges(shards[:3], target=128 * mb, fanout=4) == []


def _language_vector(text):
    """The definition, n-gram by n-gram."""
    letters, codes = letter_vectors(), letter_codes()
    line = "".join(c if c.isalpha() else " " for c in text)
    line = f" {' '.join(line.split())} "
    place = [0 if c == " " else int(codes[ord(c)]) for c in line]
    total = np.zeros(letters.shape[2])
    for k in range(len(place) - 2):
        total += letters[0, place[k]].astype(float) * letters[1, place[k + 1]] * letters[2, place[k + 2]]
    return total if any(place) else total * 0


@settings(max_examples=60, deadline=None)
@given(texts=st.lists(st.none() | st.text(st.sampled_from("abcdé 1!😀Жи漢字\n𐐀𝟙ǅ"), max_size=50), max_size=6), part=st.sampled_from([5, 1000]), block=st.sampled_from([3, 1 << 13]))
def test_bundled_vectors_equal_the_definition(texts, part, block):
    was = language.SLICE_CHARS, language.GRAM_BLOCK
    language.SLICE_CHARS, language.GRAM_BLOCK = part, block
    try:
        got = Bundler().bundle(texts)
    finally:
        language.SLICE_CHARS, language.GRAM_BLOCK = was
    assert np.array_equal(got, np.array([_language_vector(t or "") for t in texts], np.float32).reshape(got.shape))


def test_bundling_a_million_han_letters_takes_little_memory():
    points = np.random.default_rng(3).integers(0x4E00, 0x9FFF, 1_000_000)
    text = "".join(map(chr, points))
    letter_vectors(), letter_codes()
    tracemalloc.start()
    assert Bundler().bundle([text]).any()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 300_000_000


@settings(max_examples=60, deadline=None)
@given(raw=st.binary(max_size=400).map(lambda b: bytes(b"ab "[x % 3] for x in b)), block=st.sampled_from([7, 64]))
def test_word_hashes_do_not_depend_on_blocks(raw, block):
    raw = np.frombuffer(raw + b" ", np.uint8)
    whole = word_hashes(raw)
    shingles_module.block_powers.cache_clear()
    was, shingles_module.BLOCK = shingles_module.BLOCK, block
    try:
        parts = word_hashes(raw)
    finally:
        shingles_module.BLOCK = was
        shingles_module.block_powers.cache_clear()
    words = raw.tobytes().split()
    assert all(np.array_equal(a, b) for a, b in zip(whole, parts, strict=True)) and len(whole[1]) == len(words)
    assert len(set(whole[1].tolist())) == len(set(words))


def test_runs_of_long_texts_cover_the_same_windows_with_the_same_anchors():
    rng = np.random.default_rng(8)
    texts = [bytes(rng.integers(97, 101, n).astype(np.uint8)) for n in (50, 3000, 120, 700, 100)]
    spread = lambda r: {(t, i, a, f) for t, lo, hi, a, f in zip(*(r[k].tolist() for k in ("text", "lo", "hi", "anchor", "fp")), strict=True) for i in range(lo, hi + 1)}
    assert spread(anchored_runs(texts)) == spread(anchored_runs(texts, part=256))


def test_equal_groups_need_both_numbers():
    group, second = np.array([1, 1, 1, 1, 2]), np.array([5, 6, 5, 6, 5])
    gone, first = later(group, np.arange(5), np.zeros(5, np.int64), second)
    assert sorted(gone.tolist()) == [2, 3] and sorted(first.tolist()) == [0, 1, 4]
