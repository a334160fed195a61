"""SentencePiece coding and cross-tokenizer alignment against the libraries and brute force."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest

from rushes.llm.alignment import Coders, align, align_tokens, diagonals
from rushes.llm.piece_bpe import PieceBpe, code_pieces, read_model
from rushes.llm.queries import model_file, tokenizer_file

SCHEMA = "doc_id long, text string, _n_tokens string, `a.b` int, `x``y` int, _whole int, own0 int"


def sha(x: bytes) -> str:
    return hashlib.sha256(x).hexdigest()


def make_texts():
    draw = random.Random(5)
    some = ["the ", "of", " ", "  ", "Éa", "tion", "straße", "日本", "😀", "\n", "\t", "é̂", "<s>", "</s>", "<0x0A>", "<unk>", "<|endoftext|>", "\x00", "2024", "мир ", "한국", "ing", "aaaa", " " * 17, "​"]
    texts = [None, "", " ", "   ", "a▁b", "▁", "<s>", "<|endoftext|>", "a" * 9000, "word " * 4000, " " * 3001, "日本" * 2000]
    texts += ["".join(draw.choice(some) for _ in range(draw.randint(1, 60))) for _ in range(120)]
    return texts + [texts[-1]] * 3


TEXTS = make_texts()


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(None if i == 20 else i, t, "clash", 1, 2, 3, 4) for i, t in enumerate(TEXTS)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def library():
    import public_tokenizers
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))


def test_pieces(docs, library):
    out = code_pieces(docs, model_file("piece_bpe_32k.model"), ids=True)
    assert out.columns == ["doc_id", "a.b", "x`y", "_whole", "own0", "_n_tokens", "_ids_sha256", "_decoded_sha256", "_ids", "_decoded"]
    got = {r.doc_id: r for r in out.collect()}
    assert len(got) == len(TEXTS)
    for i, t in enumerate(TEXTS):
        r = got[None if i == 20 else i]
        ids = library.encode(t or "", add_bos=True, add_eos=True)
        assert r._ids == ids and r._n_tokens == len(ids)
        assert r._ids_sha256 == sha(np.array(ids, "<u4").tobytes())
        assert r._decoded == library.decode(ids) and r._decoded_sha256 == sha(r._decoded.encode())
        assert r.own0 == 4


def test_pieces_of_nothing(spark):
    assert code_pieces(spark.createDataFrame([], SCHEMA), model_file("piece_bpe_32k.model")).collect() == []


def test_other_models_are_refused():
    with pytest.raises(ValueError):
        read_model(b"\x0a\x05\x0a\x03abc\x12\x02\x18\x01")


def own_model(pieces):
    """A small merge-type model file: pieces with scores, no byte fallback."""
    import struct

    out = b""
    for text, score, kind in pieces:
        body = b"\x0a" + bytes([len(text.encode())]) + text.encode() + b"\x15" + struct.pack("<f", score) + b"\x18" + bytes([kind])
        out += b"\x0a" + bytes([len(body)]) + body
    return out + b"\x12\x02\x18\x02" + b"\x1a\x04\x18\x01\x20\x00"


def plain_merges(text, scores):
    parts = list(text)
    while True:
        found = [(-scores[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in scores]
        if not found:
            return parts
        i = min(found)[1]
        parts[i : i + 2] = [parts[i] + parts[i + 1]]


@pytest.mark.parametrize("seed", range(6))
def test_random_vocabularies(seed):
    """Equal scores, pieces that no merge reaches, spaces inside pieces, letters that are no piece."""
    draw = random.Random(seed)
    letters = "ab▁" if seed % 2 else "abc▁"
    texts = sorted({"".join(draw.choice(letters) for _ in range(draw.randint(2, 5))) for _ in range(25)})
    pieces = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3)] + [(c, -100.0, 1) for c in letters if c != "b" or seed % 3] + [(t, -float(draw.randint(1, 12)), 1) for t in texts]
    coder = PieceBpe(own_model(pieces))
    scores = {t: s for t, s, kind in pieces if kind == 1}
    number = {t: i for i, (t, _, kind) in enumerate(pieces) if kind == 1}
    for _ in range(400):
        text = "".join(draw.choice("ab cz"[: 4 + seed % 2]) for _ in range(draw.randint(1, 25)))
        want = [number.get(p, 0) for p in plain_merges("▁" + text.replace(" ", "▁"), scores)]
        assert np.frombuffer(coder.encode(text), "<u4").tolist() == want


def brute_links(a_bytes, b_bytes):
    ends = lambda parts: np.cumsum([len(p) for p in parts]).tolist()
    ea, eb = ends(a_bytes), ends(b_bytes)
    links = [(i, j) for i, e in enumerate(ea) for j, f in enumerate(eb) if max(e - len(a_bytes[i]), f - len(b_bytes[j])) < min(e, f)]
    cuts = sorted(set(ea) & set(eb))
    groups = []
    for lo, hi in zip([0, *cuts], cuts):
        groups.append(([i for i, e in enumerate(ea) if lo < e <= hi], [j for j, f in enumerate(eb) if lo < f <= hi]))
    return links, groups


@pytest.mark.parametrize("work", [1, 2, 3, 7, 64, 1000])
def test_merge_path_pieces(work):
    draw = np.random.default_rng(work)
    for _ in range(40):
        total = int(draw.integers(1, 200))
        a, b = (np.append(np.sort(draw.choice(np.arange(1, total), int(draw.integers(0, total)), replace=False)), total) for _ in range(2))
        at, bt = diagonals(a, b, work)
        assert (np.diff(at + bt)[:-1] == work).all() and at[-1] == len(a) and bt[-1] == len(b)
        i, j, ga, gb = align(a, b, work)
        parts = lambda e: [b"x" * n for n in np.diff(e, prepend=0)]
        links, groups = brute_links(parts(a), parts(b))
        assert list(zip(i.tolist(), j.tolist())) == links
        assert [np.flatnonzero(ga == g).tolist() for g in range(len(groups))] == [g[0] for g in groups]
        assert [np.flatnonzero(gb == g).tolist() for g in range(len(groups))] == [g[1] for g in groups]


def brute_alignment(texts, library):
    import public_tokenizers
    from tokenizers import Tokenizer

    from rushes.llm.bpe import byte_letters

    letters = byte_letters()
    first = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    first.encode_special_tokens = True
    spelled = {i: bytes(letters[c] for c in t) for t, i in first.get_vocab(with_added_tokens=False).items() if all(c in letters for c in t)}
    found, counts = [], Counter()
    for t in texts:
        a = first.encode(" " + t, add_special_tokens=False).ids if t else []
        b = library.encode(t) if t else []
        piece = lambda i: bytes([int(library.id_to_piece(i)[3:5], 16)]) if library.is_byte(i) else library.id_to_piece(i).replace("▁", " ").encode()
        ab, bb = [spelled[i] for i in a], [piece(i) for i in b]
        if t and {b"".join(ab), b"".join(bb)} != {(" " + t).encode()}:
            a, b, ab, bb = [], [], [], []
        links, groups = brute_links(ab, bb)
        links = [(a[i], b[j]) for i, j in links]
        counts.update(links)
        found.append((a, b, links, ";".join(",".join(str(a[i]) for i in g) + "|" + ",".join(str(b[j]) for j in h) for g, h in groups), len(groups)))
    best = {}
    for (_, b), n in counts.items():
        best[b] = max(n, best.get(b, 0))
    return [(len(a), len(b), n, len(links), sum(counts[x] == best[x[1]] for x in links), sum(counts[x] for x in links), sha(text.encode()) if text else "", text) for a, b, links, text, n in found]


SHORT = [t if t is None or len(t) < 500 else t[:400] for t in TEXTS]


@pytest.mark.parametrize("frequent", [1 << 17, 40, 1])
def test_alignment(spark, library, monkeypatch, frequent):
    """All pairs told to all tasks, some of them, and hardly any."""
    from rushes.llm import alignment

    monkeypatch.setattr(alignment, "FREQUENT", frequent)
    monkeypatch.setattr(alignment, "UNIT_BYTES", 3000)
    docs = spark.createDataFrame([(i, t, "clash", 1, 2, 3, 4) for i, t in enumerate(SHORT)], SCHEMA).repartition(3)
    out = align_tokens(docs, tokenizer_file("byte_bpe_50k.json"), model_file("piece_bpe_32k.model"), groups=True)
    assert out.columns[:6] == ["doc_id", "_n_tokens", "a.b", "x`y", "_whole", "own0"]
    got = {r.doc_id: r for r in out.collect()}
    assert len(got) == len(SHORT)
    for i, want in enumerate(brute_alignment(SHORT, library)):
        r = got[i]
        assert (r._n_a, r._n_b, r._n_groups, r._n_links, r._n_best, r._count_sum, r._groups_sha256, r._groups) == want
        assert (r._n_tokens, r._whole, r["a.b"]) == ("clash", 3, 1)


def test_alignment_of_nothing(spark):
    a, b = tokenizer_file("byte_bpe_50k.json"), model_file("piece_bpe_32k.model")
    assert align_tokens(spark.createDataFrame([], SCHEMA), a, b).collect() == []
    rows = align_tokens(spark.createDataFrame([(None, None, "", 0, 0, 0, 0), (None, "", "", 0, 0, 0, 0), (1, "a▁", "", 0, 0, 0, 0)], SCHEMA), a, b).collect()
    assert [tuple(r)[6:] for r in rows] == [(0, 0, 0, 0, "", 0, 0)] * 3 and rows[0]._groups_sha256 == ""


def test_alignment_of_a_long_text(spark):
    """A text over many pieces of the merge path: groups spell the whole text, links follow from their number."""
    text = " ".join(random.Random(1).choice(["alpha", "straße", "日本", "x", "tionen"]) for _ in range(60000))
    r = align_tokens(spark.createDataFrame([(1, text)], "doc_id long, text string"), tokenizer_file("byte_bpe_50k.json"), model_file("piece_bpe_32k.model"), groups=True).first()
    assert r._n_links == r._n_a + r._n_b - r._n_groups
    assert len(re.findall(";", r._groups)) + 1 == r._n_groups
    assert r._n_a + r._n_b == len(re.findall(r"\d+", r._groups))


def test_alignment_keeps_the_words_of_many_units():
    coders = Coders(tokenizer_file("byte_bpe_50k.json"), model_file("piece_bpe_32k.model"))
    for known in (coders.a.known, coders.b.known):
        for first in range(0, 300_000, 10_000):
            known.update(dict.fromkeys(known.refresh([str(k) for k in range(first, first + 10_000)]), b""))
        assert known.refresh([str(k) for k in range(10_000)]) == []


class Counting:
    """A pattern that counts the characters it goes through."""

    def __init__(self, pattern):
        self.pattern, self.seen = pattern, 0

    def findall(self, text):
        self.seen += len(text)
        return self.pattern.findall(text)


def test_alignment_parts_each_word_once():
    """Words that occur again, in one unit or in later ones, are not parted by either tokenizer's pattern again."""
    coders = Coders(tokenizer_file("byte_bpe_50k.json"), model_file("piece_bpe_32k.model"))
    coders.a.split, coders.b.words = Counting(coders.a.split), Counting(coders.b.words)
    words = [f"tion{k}straße." for k in range(50)]
    for _ in range(3):
        coders.encode_many([" ".join(words * 20), " ".join(reversed(words))])
    size = sum(len(" " + w) for w in words)
    assert (coders.a.split.seen, coders.b.words.seen) == (size, size)


def ids_of(coders, texts):
    i, n_a, j, n_b = coders.encode_many(texts)
    cut = lambda ids, n: [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])]
    return list(zip(cut(i, n_a), cut(j, n_b)))


def test_alignment_cuts_at_white_space_as_the_libraries_do(library):
    import public_tokenizers
    from tokenizers import Tokenizer

    first = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    first.encode_special_tokens = True
    coders = Coders(tokenizer_file("byte_bpe_50k.json"), model_file("piece_bpe_32k.model"))
    draw = random.Random(11)
    some = [" ", " ", "  ", "\n", "\t", "\u00a0", "\u3000", "\u2003", "\x1c", "\x85", "the", "straße", "'s", "x.", "日本", "7", "<s>", "\u200b", "e\u0302", "y" * 60]
    texts = [" ", "  ", "the ", "the  ", " the", "the\n ", "the\n  the", "the \n the", "the\u00a0 \u00a0the"]
    texts += ["".join(draw.choice(some) for _ in range(draw.randint(1, 25))) for _ in range(1500)]
    for first_time in (True, False):
        for t, (a, b) in zip(texts, ids_of(coders, texts)):
            assert (a, b) == (first.encode(" " + t, add_special_tokens=False).ids, library.encode(t)), (t, first_time)


def test_alignment_without_byte_fallback():
    """A text with a letter that B has no id for has no tokens; its neighbours keep theirs."""
    pieces = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3), ("▁", -9.0, 1), ("a", -9.0, 1), ("b", -9.0, 1), ("▁a", -1.0, 1)]
    coders = Coders(tokenizer_file("byte_bpe_50k.json"), own_model(pieces))
    got = ids_of(coders, ["a b", "a c", "", None, "ab"])
    assert [b for _, b in got] == [[6, 3, 5], [], [], [], [6, 5]]
    assert [len(a) > 0 for a, _ in got] == [True, False, False, False, True]


@pytest.mark.parametrize("paired", [0, 1024])
def test_short_units_by_tables(monkeypatch, paired):
    """The longest unit at each place, with units of two in the table and in the automaton, also without longer ones."""
    from rushes.llm import _backtrack

    monkeypatch.setattr(_backtrack, "PAIRED", paired)
    draw = random.Random(3)
    for longest in (1, 2, 5):
        units = ["", *sorted({"".join(draw.choice("ab日😀") for _ in range(draw.randint(1, longest))) for _ in range(30)})]
        tracker = _backtrack.Backtracker(units, lambda a, b: True, 10, "|")
        for _ in range(50):
            text = "".join(draw.choice("ab日😀|\U0010ffff") for _ in range(draw.randint(0, 30)))
            want = [max((u for u in units if u and text.startswith(u, k)), key=len, default="") for k in range(len(text))]
            assert [units[u] if u >= 0 else "" for u in tracker.longest(text).tolist()] == [*want, ""]
