"""SentencePiece encoding and decoding of merge-type (BPE) models, exactly, by backtracking.

The library starts from single characters and merges, again and again, the adjacent
pair whose joined piece has the best score, the leftmost of equals. A sequence of
pieces is the one it ends with exactly if each piece is what its own characters
merge to, and each two neighbours, merged anew from their characters, never merge
across the border between them: regions without a merge across their borders do not
see each other, whatever the order of scores.

So an encoder that takes the longest piece at each place (from one Aho-Corasick
pass), asks a table of pairs, filled by merging anew, whether it may follow, and takes
the next shorter one or goes back where it may not, is exact (_backtrack.py).
Texts part into words where no piece has the two characters side by side.
Decoding gathers each piece's bytes by an offset table.
"""

import struct
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ._backtrack import Backtracker, packed_words
from ._spark import map_texts
from ._text import parts as text_parts
from .packing import Recent, worker_cache

SPACE = "▁"
NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6
CODED = "_n_tokens long, _ids_sha256 string, _decoded_sha256 string"
#: Words of more characters than this are encoded each time they occur, so that the cache of words stays small.
CACHED_CHARS = 48


def _fields(data: bytes):
    """(number, value) of each field of a protocol-buffer message; value is an int, or bytes."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            if byte < 128:
                return value
            shift += 7

    while at < len(data):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
            continue
        size = {1: 8, 5: 4}.get(kind) or varint()
        yield key >> 3, data[at : at + size]
        at += size


def read_model(content: bytes) -> dict:
    """The pieces (text, score, type) and settings of a model file's content.

    Raises ValueError for what the encoder does not say exactly: other types than
    BPE, normalisation rules, white space that is removed, user-defined or unused pieces.
    """
    pieces, trainer, rules = [], {}, {}
    for number, value in _fields(content):
        if number == 1:
            f = dict(_fields(value))
            pieces.append((f[1].decode(), struct.unpack("<f", f[2])[0] if 2 in f else 0.0, f.get(3, NORMAL)))
        elif number == 2:
            trainer = dict(_fields(value))
        elif number == 3:
            rules = dict(_fields(value))
    if trainer.get(3, 1) != 2:
        raise ValueError("the model is not of the merge type")
    if rules.get(2) or rules.get(4, 1) or not rules.get(5, 1) or trainer.get(24, 0):
        raise ValueError("the model's normalisation is not supported")
    if any(kind not in (NORMAL, UNKNOWN, CONTROL, BYTE) for _, _, kind in pieces):
        raise ValueError("user-defined and unused pieces are not supported")
    return {"pieces": pieces, "prefix": bool(rules.get(3, 1)), "bytes": bool(trainer.get(35, 0)), "unknown": trainer.get(40, 0), "begin": trainer.get(41, 1), "end": trainer.get(42, 2), "unknown_text": trainer.get(44, " ⁇ ".encode())}


class PieceBpe:
    """Encoder and decoder of a model file's content."""

    def __init__(self, content: bytes, most: int = 150_000):
        import regex

        model = read_model(content)
        self.model = model
        pieces = model["pieces"]
        self.scores = {t: s for t, s, kind in pieces if kind == NORMAL}
        ids = {t: i for i, (t, _, kind) in enumerate(pieces) if kind == NORMAL}
        in_bytes = {int(t[3:5], 16): i for i, (t, _, kind) in enumerate(pieces) if kind == BYTE}
        self.letters = {c for t in ids for c in t}
        #: ids of each unit: a reachable piece, or a character that is no piece
        units: dict[str, list[int]] = {t: [i] for t, i in ids.items() if len(self.merge(t)) == 1}
        self.fallback = lambda c: [in_bytes[b] for b in c.encode()] if model["bytes"] else [model["unknown"]]
        for c in self.letters - units.keys():
            units[c] = self.fallback(c)
        self.texts = list(units)
        self.codes = np.array([i for k in units.values() for i in k], np.int64)
        self.bounds = np.r_[0, np.cumsum([len(k) for k in units.values()])].astype(np.int64)
        apart = next(chr(c) for c in range(0x10FFFF) if chr(c) not in self.letters)
        self.tracker = Backtracker(self.texts, self.compatible, max(500_000, 2 * most), apart)
        self.words = self.splitter(ids, regex)
        self.known = Recent(most)

        surface = {NORMAL: lambda t: t.replace(SPACE, " ").encode(), CONTROL: lambda t: b"", UNKNOWN: lambda t: model["unknown_text"], BYTE: lambda t: bytes([int(t[3:5], 16)])}
        whole = [surface[kind](t) for t, _, kind in pieces]
        self.piece_sizes = np.array([len(t) for t in whole], np.int64)
        self.offsets = np.cumsum(self.piece_sizes) - self.piece_sizes
        self.bytes = np.frombuffer(b"".join(whole), np.uint8)

    def splitter(self, pieces, regex):
        """A pattern that parts texts only between characters which no piece has side by side, so where no merge takes place; None if a piece has a space after another character.

        It parts before spaces, after letters where a sign follows that follows a letter
        in no piece, and between signs and letters likewise.
        """
        if any(SPACE in t.lstrip(SPACE) for t in pieces):
            return None
        letter = {c for c in self.letters if regex.match(r"\p{L}", c)}
        sides = {(a, b) for t in pieces for a, b in zip(t, t[1:])} - {(SPACE, c) for c in self.letters}
        # signs that some piece has behind a letter, and before one
        behind, before = {b for a, b in sides if a in letter} - letter, {a for a, b in sides if b in letter} - letter
        some = lambda chars: "".join(regex.escape(c) for c in sorted(chars - {SPACE}))
        return regex.compile(rf"{SPACE}*\p{{L}}++(?![\p{{L}}{some(behind)}])|{SPACE}*[^{SPACE}\p{{L}}]*[^{SPACE}\p{{L}}{some(before)}](?=\p{{L}})|{SPACE}*[^{SPACE}]+|{SPACE}+")

    def merge(self, text: str, border: int = -1) -> list[str]:
        """What the characters of a short text merge to; [] as soon as a merge goes across the border, a number of characters."""
        parts = list(text)
        get = self.scores.get
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                score = get(parts[i] + parts[i + 1])
                if score is not None and (best is None or score > best):
                    best, at = score, i
            if at < 0:
                break
            if border >= 0:
                left = sum(map(len, parts[: at + 1]))
                if left == border:
                    return []
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def compatible(self, left: int, right: int) -> bool:
        """Whether the two units stay apart when the characters of both are merged anew."""
        a, b = self.texts[left], self.texts[right]
        return bool(self.merge(a + b, len(a)))

    def encode_words(self, words: list[str]) -> list[bytes]:
        """Ids, little-endian 32-bit, of each word. Letters that no piece has stand alone."""
        letters = self.letters
        strange = {k: w for k, w in enumerate(words) if not letters.issuperset(w)}
        if not strange:
            return packed_words(*self.tracker.many(words), self.codes, self.bounds)
        runs: list[str] = []
        of: list[list] = []
        for w in words if len(strange) == len(words) else strange.values():
            parts: list = []
            for inside, run in groupby(w, letters.__contains__):
                run = "".join(run)
                if inside:
                    parts.append(len(runs))
                    runs.append(run)
                else:
                    ids = [i for c in run for i in self.fallback(c)]
                    parts.append(np.array(ids, "<u4").tobytes())
            of.append(parts)
        plain = [w for k, w in enumerate(words) if k not in strange]
        done = self.encode_words(runs + plain) if runs or plain else []
        joined = iter([b"".join([p if isinstance(p, bytes) else done[p] for p in parts]) for parts in of])
        rest = iter(done[len(runs) :])
        return [next(joined) if k in strange else next(rest) for k in range(len(words))]

    def encode_many(self, texts: list[str]) -> list[bytes]:
        """Ids, little-endian 32-bit, of each text, without begin and end. New words of all texts are encoded together."""
        prefix = SPACE if self.model["prefix"] else ""
        return self.encode_marked([prefix + t.replace(" ", SPACE) if t else "" for t in texts])

    def encode_marked(self, texts: list[str]) -> list[bytes]:
        """As encode_many, of texts that have the sign for a space already, also in front."""
        if self.words is None:
            return self.encode_words(texts)
        words = [self.words.findall(t) for t in texts]
        known = self.known
        new = known.refresh(set().union(*words))
        long = {w for w in new if len(w) > CACHED_CHARS}
        coded = dict(zip(new, self.encode_words(new)))
        once = {w: coded.pop(w) for w in long}
        known.update(coded)
        if not once:
            return [b"".join(map(known.__getitem__, w)) for w in words]
        return [b"".join([once[x] if x in once else known[x] for x in w]) for w in words]

    def encode(self, text: str) -> bytes:
        return self.encode_many([text])[0]

    def decode(self, ids: bytes) -> bytes:
        """The text of ids that encode() made, with or without begin and end, in UTF-8."""
        i = np.frombuffer(ids, "<u4")
        size = self.piece_sizes[i]
        at = np.arange(int(size.sum())) + np.repeat(self.offsets[i] - (np.cumsum(size) - size), size)
        return self.bytes[at].tobytes().removeprefix(b" " if self.model["prefix"] else b"")


def piece_bpe_of(content: bytes, owner: str = "pieces") -> PieceBpe:
    cache, key = worker_cache(owner), ("pieces", hash(content))
    if key not in cache:
        cache[key] = PieceBpe(content)
    return cache[key]


def code_pieces(docs: DataFrame, content: bytes, text_column: str = "text", ids: bool = False) -> DataFrame:
    """docs with `_n_tokens`, `_ids_sha256`, `_decoded_sha256` and, if asked, `_ids` and `_decoded` in place of the text.

    content is the content of a SentencePiece model file of the merge type; others
    raise ValueError. Each text gets the ids of begin and end, which count as
    tokens; control pieces that stand in a text as words are plain text. The
    digest of ids is over little-endian unsigned 32-bit integers.

    Null or empty text: begin and end alone; decoded it is empty. Long texts take
    linear time. Ties and repeated rows need nothing special: each row is coded by
    itself. U+2581 in a text is the sign for a space and decodes to one. An empty
    table gives an empty one. Own columns stay, whatever their names; one named
    as a new column gives way to it.
    """
    read_model(content)
    outputs = CODED + ", _ids array<int>, _decoded string" * ids

    def run(rows):
        import hashlib

        coder = piece_bpe_of(content)
        begin, end = (np.array([coder.model[k]], "<u4").tobytes() for k in ("begin", "end"))
        sha = lambda x: hashlib.sha256(x).hexdigest()
        for batch in (part for batch in rows for part in text_parts(batch, "_whole")):
            names = batch.schema.names
            out = {f: batch.column(i) for i, f in enumerate(names) if f != "_whole"}
            counts, digests, texts, lists = [], [], [], []
            for ids_of in coder.encode_many([t or "" for t in batch.column(names.index("_whole")).to_pylist()]):
                coded = begin + ids_of + end
                decoded = coder.decode(coded)
                counts.append(len(coded) // 4)
                digests.append((sha(coded), sha(decoded)))
                if ids:
                    lists.append(np.frombuffer(coded, "<i4"))
                    texts.append(decoded.decode())
            out |= {"_n_tokens": pa.array(counts, pa.int64()), "_ids_sha256": pa.array([a for a, _ in digests], pa.string()), "_decoded_sha256": pa.array([b for _, b in digests], pa.string())}
            if ids:
                out |= {"_ids": pa.array(lists, pa.list_(pa.int32())), "_decoded": pa.array(texts, pa.string())}
            yield pa.RecordBatch.from_pydict(out)

    return map_texts(docs, text_column, run, outputs)
