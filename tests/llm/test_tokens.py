import hashlib
import random
import sys

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from tokenizers import Tokenizer

from timberline.llm import bpe, pieces, token_counts

JSON = P.path("byte_bpe_50k.json")
RANKS = P.path("byte_bpe_multi_50k.tiktoken")
ALPHABET = [*"abstdrevl'''   \n\t\r 　é中1२!?-😀", "'s", "'re", "'ll", "  ", "\n\n", "<|endoftext|>", " the", "x" * 70, " " * 40]


def texts(n, most, seed=3):
    rnd = random.Random(seed)
    return ["".join(rnd.choice(ALPHABET) for _ in range(rnd.randrange(most))) for _ in range(n)]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(JSON)


@pytest.fixture(scope="module")
def ranks():
    return tiktoken.Encoding("t", pat_str=P.PATTERN, mergeable_ranks=pieces.rank_encoding(RANKS)._mergeable_ranks,
                             special_tokens={})


def test_pieces_are_those_of_the_library(library):
    for k in range(60):
        some = texts(5, 40, k)
        ids, n = pieces.encode_texts(some, pieces.library_cache(JSON), token_counts.SPECIAL)
        want = [library.encode(t, add_special_tokens=False).ids for t in some]
        assert ids.tolist() == sum(want, []) and n.tolist() == [len(w) for w in want]


def thue_morse(bits):
    """Two words of 2^bits letters whose sums of letters times powers of an odd number agree modulo 2^64."""
    word = "".join("ab"[k.bit_count() % 2] for k in range(1 << bits))
    return word, word.translate(str.maketrans("ab", "ba"))


@pytest.mark.parametrize("bits", [8, 10, 11, 12])
def test_pieces_of_equal_hash_keep_their_own_ids(library, ranks, bits):
    one, two = thue_morse(bits)
    if bits > 9:
        h = pieces.Pieces([one, two]).hashes()
        assert h[0] == h[1]
    for cache, special, want in ((pieces.library_cache(JSON), token_counts.SPECIAL, lambda t: library.encode(t, add_special_tokens=False).ids),
                                 (bpe.rank_cache(RANKS), None, ranks.encode_ordinary)):
        cache.clear()
        for batch in ([one, two, one], [two], [one, "x"], [two, one]):
            ids, n = pieces.encode_texts(batch, cache, special)
            assert ids.tolist() == sum(map(want, batch), []) and n.tolist() == [len(want(t)) for t in batch]
            assert pieces.count_texts(batch, cache, special).tolist() == n.tolist()


def test_other_kinds_of_tokenizers_are_refused():
    with pytest.raises(ValueError):
        pieces.library_cache(P.path("word_bpe_49k.json"))


def test_pieces_of_equal_hash_decode(ranks):
    one, two = thue_morse(11)
    _, _, ids = bpe.encode_batch([two, f"{one} {two}"], bpe.rank_cache(RANKS), 1 << 13)
    assert [i.tolist() for i in ids] == [ranks.encode_ordinary(two), ranks.encode_ordinary(f"{one} {two}")]


def test_steps_cut_only_between_pieces(library):
    text = "".join(texts(40, 60))
    parts = list(pieces.steps(text, token_counts.SPECIAL, 100))
    assert "".join(parts) == text and len(parts) > 5
    want = library.encode(text, add_special_tokens=False).ids
    assert sum((library.encode(p, add_special_tokens=False).ids for p in parts), []) == want


def test_long_pieces_join_token_by_token(ranks):
    tree = bpe.TokenTree(RANKS)
    rnd = random.Random(5)
    for alphabet in ("ab", "the", "aé中", "aaaaab", "=-", " "):
        for _ in range(25):
            piece = "".join(rnd.choice(alphabet) for _ in range(rnd.randrange(60, 700)))
            data = piece.encode()
            assert tree.tree(data) == ranks._encode_single_piece(data), piece


@pytest.mark.parametrize("leaf", [40, 100, 1 << 13])
def test_tree_of_leaves_equals_one_pass(ranks, leaf):
    some = ["", *texts(60, 80), "a" * 500, " " * 333, "x'" * 200, "\n" * 90 + "end"]
    _, _, ids = bpe.encode_batch(some, bpe.rank_cache(RANKS), leaf)
    assert [i.tolist() for i in ids] == [ranks.encode_ordinary(t) for t in some]


CASES = [(1, ""), (None, "a b"), (2, None), (3, "tie"), (3, "tie"), (4, "word " * 900 + "z" * 700 + " 'tis 'll  \n" * 60),
         (5, "".join(texts(80, 60, 9))), (6, "中文" * 600), (7, " " * 1000 + "x"), (8, "<|endoftext|>" * 90)]


@pytest.fixture(scope="module")
def frame(spark):
    # Extra columns whose names the operators use inside.
    rows = [(a, b, 1, "k", 2) for a, b in CASES]
    return spark.createDataFrame(rows, "doc_id long, text string, n_tokens int, key string, ids int")


def by_row(rows):
    return sorted(rows, key=lambda r: (r[0] is None, r[0] or 0))


def test_encode_over_segments_round_trip(spark, frame, ranks):
    for size in (128, 1 << 16):
        got = bpe.decode(bpe.encode(frame, RANKS, segment_chars=size), RANKS).collect()
        want = by_row([(a, ranks.encode_ordinary(b or ""), (b or "").encode()) for a, b in CASES])
        assert by_row([(r.id, r.ids, bytes(r.decoded)) for r in got]) == want
        got = bpe.encode(frame, RANKS, segment_chars=size, decoded=True).collect()
        assert by_row([(r.id, r.ids, bytes(r.decoded)) for r in got]) == want
    assert bpe.encode(frame.limit(0), RANKS).count() == 0


def test_counts_resynchronise(spark, frame, library):
    want = by_row([(a, len((b or "").encode()), len(library.encode(b or "", add_special_tokens=False).ids)) for a, b in CASES])
    for size, overlap in ((140, 70), (1 << 16, 512)):
        got = token_counts.count_tokens(frame, JSON, chunk_chars=size, overlap=overlap).collect()
        assert by_row([tuple(r) for r in got]) == want
    assert token_counts.count_tokens(frame.limit(0), JSON).count() == 0


def test_sha_of_ids(spark, frame, ranks):
    from timberline.llm.queries import op2_columns

    got = op2_columns(bpe.decode(bpe.encode(frame, RANKS), RANKS)).collect()
    want = by_row([(a, len(i), hashlib.sha256(",".join(map(str, i)).encode()).hexdigest(),
                    hashlib.sha256((b or "").encode()).hexdigest())
                   for a, b in CASES for i in [ranks.encode_ordinary(b or "")]])
    assert by_row([tuple(r)[:4] for r in got]) == want


@pytest.mark.parametrize("slots", [2, 1 << 12])
def test_known_pieces_are_not_sorted_again(monkeypatch, slots):
    monkeypatch.setattr(pieces, "SLOTS", slots)
    cache = pieces.PieceIds(lambda strings: (np.array([ord(s[-1]) for s in strings], np.int32), np.ones(len(strings), np.int32)))
    texts = ["one two three", "two  two\nnine", "", "four one"]
    asked, entries = [], cache._entries
    monkeypatch.setattr(cache, "_entries", lambda p, h, which: asked.append(len(which)) or entries(p, h, which))
    want = [ord(s[-1]) for text in texts if text for s in pieces.Pieces([text]).strings(slice(None))]
    for _ in range(3):
        ids, count = pieces.encode_texts(texts, cache)
        assert ids.tolist() == want and count.sum() == len(want)
    assert slots == 2 or sum(asked) == len(want)


def test_pieces_held_by_a_worker_stay_small(ranks):
    rnd = random.Random(4)
    words = ["".join(rnd.choices("abcdefghijklmnopqrstuvwxyz", k=6)) for _ in range(350_000)]
    many = [" ".join(words[k : k + 5_000]) for k in range(0, len(words), 5_000)]
    cache, most = bpe.rank_cache.__wrapped__(RANKS), 0
    for low, high in bpe._runs(many):
        _, _, ids = bpe.encode_batch(many[low:high], cache)
        assert ids[0].tolist() == ranks.encode_ordinary(many[low])
        most = max(most, sum(x.nbytes for x in vars(cache).values() if isinstance(x, np.ndarray)))
    assert most < 28 << 20


def test_new_pieces_are_spelled_together(library):
    encode = pieces.library_cache(JSON).encode
    some = ["<|endoftext|>", "\0", " \0\x7f", "\xa0", " é中", "😀", "ÿþ", " the", "x" * 70, *(f" w{k}q" for k in range(2000))]
    calls = []
    sys.setprofile(lambda frame, event, arg: calls.append(event) if event.endswith("call") else None)
    try:
        ids, n = encode(some)
    finally:
        sys.setprofile(None)
    want = [library.encode(s, add_special_tokens=False).ids for s in some]
    assert ids.tolist() == sum(want, []) and n.tolist() == list(map(len, want))
    assert len(calls) < 4 * len(some)
