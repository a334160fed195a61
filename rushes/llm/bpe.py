"""BPE encoding and decoding: a backtracking encoder with exact merges.

A token may follow another only if merging their bytes would not have crossed the
border between them; a table of pairs says so. The encoder goes through a piece of
text with the longest token at each place (from one Aho-Corasick pass) and takes
the next shorter one, or goes back, where the pair does not fit. A place that was
left never is entered again, so time is linear in the piece. Decoding gathers each
token's bytes by an offset table.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ._spark import map_texts
from .packing import Recent, worker_cache

#: How byte-level tokenizers split text before merging, with the white space of Unicode.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"""
CODED = "_n_tokens long, _ids_sha256 string, _decoded_sha256 string"


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in byte-level vocabularies: printable Latin-1 stands for itself."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Bpe:
    """Encoder and decoder of a byte-level BPE file's content. Token ids must follow merge order."""

    def __init__(self, content: str, most: int = 400_000):
        import json

        import ahocorasick
        import regex

        model = json.loads(content)
        letters = byte_letters()
        as_text = lambda token: "".join(chr(letters[c]) for c in token)  # noqa: E731  bytes as Latin-1
        self.vocabulary = {as_text(t): i for t, i in model["model"]["vocab"].items()}
        special = {t["content"]: t["id"] for t in model.get("added_tokens", [])}
        size = max([*self.vocabulary.values(), *special.values()]) + 1
        self.strings = [""] * size
        for t, i in self.vocabulary.items():
            self.strings[i] = t
        self.halves = {}
        self.merged = {}
        for merge in model["model"]["merges"]:
            a, b = merge.split(" ") if isinstance(merge, str) else merge
            a, b = as_text(a), as_text(b)
            i, x, y = self.vocabulary[a + b], self.vocabulary[a], self.vocabulary[b]
            self.halves.setdefault(i, (x, y))
            self.merged[x, y] = i
        self.shorter = {}
        for t, i in self.vocabulary.items():
            for n in range(len(t) - 1, 0, -1):
                if (j := self.vocabulary.get(t[:n])) is not None:
                    self.shorter[i] = j
                    break
        self.machine = ahocorasick.Automaton()
        for t, i in self.vocabulary.items():
            self.machine.add_word(t, (len(t), i))
        self.machine.make_automaton()
        self.special = special
        self.cut = regex.compile("(" + "|".join(regex.escape(t) for t in sorted(special, key=len, reverse=True)) + ")") if special else None
        self.split = regex.compile(SPLIT)
        self.lengths = [len(t) for t in self.strings]
        whole = [t.encode("latin-1") for t in self.strings]
        for t, i in special.items():
            whole[i] = t.encode()
        self.sizes = np.array([len(t) for t in whole])
        self.offsets = np.cumsum(self.sizes) - self.sizes
        self.bytes = np.frombuffer(b"".join(whole), np.uint8)
        self.fits: dict[int, bool] = {}
        self.known, self.most = Recent(most), most

    def compatible(self, left: int, right: int) -> bool:
        """Whether the two tokens stay apart when their bytes stand side by side."""
        # walk the tokens at the border back through their merges, latest first; a
        # merge across the border that came earlier would have taken place instead
        limit = len(self.strings)
        while True:
            across = self.merged.get((left, right))
            if across is not None and across < limit:
                return False
            if left > right:
                half, limit = self.halves.get(left), left
                if half is not None:
                    left = half[1]
                    continue
                half, limit = self.halves.get(right), right + 1
                if half is None:
                    return True
                right = half[0]
            else:
                half, limit = self.halves.get(right), right + 1
                if half is not None:
                    right = half[0]
                    continue
                half, limit = self.halves.get(left), left
                if half is None:
                    return True
                left = half[1]

    def encode_piece(self, piece: str) -> list[int]:
        """Ids of a piece that the splitting pattern left whole, given as Latin-1 of its bytes."""
        whole = self.vocabulary.get(piece)
        if whole is not None:
            return [whole]
        n = len(piece)
        longest = [-1] * n
        span = [0] * n
        for end, (size, token) in self.machine.iter(piece):
            at = end - size + 1
            if size > span[at]:
                span[at], longest[at] = size, token
        sizes, shorter, fits = self.lengths, self.shorter, self.fits
        open_ = bytearray(b"\x01") * (n + 1)
        tokens: list[int] = []
        at, token = 0, longest[0]
        while at < n:
            last = tokens[-1] if tokens else -1
            while True:
                end = at + sizes[token]
                fit = open_[end]
                if fit and last >= 0:
                    pair = last << 32 | token
                    fit = fits.get(pair)
                    if fit is None:
                        fit = fits[pair] = self.compatible(last, token)
                if fit:
                    tokens.append(token)
                    at = end
                    token = longest[at] if at < n else -1
                    break
                less = shorter.get(token)
                if less is None:  # nothing fits here: this place is closed
                    open_[at] = 0
                    tokens.pop()
                    at -= sizes[last]
                    token = last
                    break
                token = less
        return tokens

    def encode(self, text: str) -> tuple[str, bytes]:
        """(decimal ids joined by commas, ids as little-endian 32-bit) of a text."""
        if len(self.fits) > 4 * self.most:
            self.fits.clear()
        known = self.known
        found = []
        for part in self.cut.split(text) if self.cut and "<" in text else (text,):
            if part in self.special:
                i = self.special[part]
                found.append((str(i), np.array([i], "<u4").tobytes()))
                continue
            pieces = self.split.findall(part)
            for piece in known.refresh(set(pieces)):
                ids = self.encode_piece(piece.encode().decode("latin-1"))
                known[piece] = ",".join(map(str, ids)), np.array(ids, "<u4").tobytes()
            found += map(known.__getitem__, pieces)
        return ",".join([f[0] for f in found]), b"".join([f[1] for f in found])

    def decode(self, ids: bytes) -> bytes:
        """Bytes of the tokens one after the other, as valid UTF-8."""
        i = np.frombuffer(ids, "<u4")
        size = self.sizes[i]
        at = np.arange(int(size.sum())) + np.repeat(self.offsets[i] - (np.cumsum(size) - size), size)
        return self.bytes[at].tobytes().decode(errors="replace").encode()


def bpe_of(content: str) -> Bpe:
    cache, key = worker_cache("bpe"), ("bpe", hash(content))
    if key not in cache:
        cache[key] = Bpe(content)
    return cache[key]


def code_texts(docs: DataFrame, content: str, text_column: str = "text", ids: bool = False) -> DataFrame:
    """docs with `_n_tokens`, `_ids_sha256`, `_decoded_sha256` and, if asked, `_ids` and `_decoded` in place of the text.

    content is the content of a byte-level BPE tokenizer file. Special tokens in a
    text become their ids; nothing is truncated, padded or added.

    Null or empty text: no tokens; decoded it is empty. Long texts, ties and repeated
    rows need nothing special: each row is coded by itself. An empty table gives an
    empty one. Own columns stay, whatever their names; one named as a new column gives way to it.
    """
    outputs = CODED + ", _ids array<int>, _decoded string" * ids

    def run(rows):
        import hashlib

        coder = bpe_of(content)
        sha = lambda x: hashlib.sha256(x).hexdigest()
        for batch in rows:
            names = batch.schema.names
            out = {f: batch.column(i) for i, f in enumerate(names) if f != "_whole"}
            coded = [(a, b, coder.decode(b)) for a, b in (coder.encode(t) if t else ("", b"") for t in batch.column(names.index("_whole")).to_pylist())]
            out |= {"_n_tokens": pa.array([len(b) // 4 for _, b, _ in coded], pa.int64()), "_ids_sha256": pa.array([sha(a.encode()) for a, _, _ in coded], pa.string()), "_decoded_sha256": pa.array([sha(c) for _, _, c in coded], pa.string())}
            if ids:
                out |= {"_ids": pa.array([np.frombuffer(b, "<i4") for _, b, _ in coded], pa.list_(pa.int32())), "_decoded": pa.array([c.decode() for _, _, c in coded], pa.string())}
            yield pa.RecordBatch.from_pydict(out)

    return map_texts(docs, text_column, run, outputs)
