"""SentencePiece encoding and decoding with forward passes shared over a trie of words.

A text is marked (spaces become U+2581, one more in front) and cut into words that no piece crosses.  The
distinct words of a batch are sorted, which lays them out as a depth-first walk of their trie: each word
keeps the forward states of the prefix it shares with the one before it and only extends them.

A forward state is the best score of a prefix and the last piece of that best path (Viterbi).  The model file
decides which paths there are.  In a unigram model any piece may follow any other.  In a BPE model a piece may
follow another only if merging the two by rank gives back exactly these two; then exactly one piece can end at
each place, so the best path is the merge order's own result.  Characters outside the vocabulary become byte
pieces.  What a task remembers (ids of words, pairs of pieces) is bounded in bytes and begun anew when full.

The model is read by the driver from a path that is a parameter (by default the installed public
tokenizers' folder) and sent to the tasks: its size is the vocabulary's.  Nothing is trained.

Defined cases: null texts give null ids, empty texts no ids; texts of any length are read whole; repeated
rows give repeated results; decoding gives back the text itself (no normalisation is applied).
"""

from __future__ import annotations

import functools
import hashlib
import re
import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bundleloom.llm.common import give_back, text_slices

MODEL_PATH = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
UNIGRAM, BPE = 1, 2
#: Lengths of pieces to look at where no longer piece ends.
PAIR = (2,)
#: Bytes, about, of words and their ids that a task keeps for reuse; and pairs of pieces (some 100 bytes each).
WORD_BYTES = 60_000_000
PAIRS = 300_000
#: Bytes of text that are cut into words at a time.
SLICE = 4_000_000


class Pieces:
    """Vocabulary of a model file: pieces with ids and scores, byte pieces, and what may follow what."""

    def __init__(self, blob: bytes):
        from sentencepiece import sentencepiece_model_pb2 as pb

        proto = pb.ModelProto()
        proto.ParseFromString(blob)
        spec = proto.normalizer_spec
        if proto.trainer_spec.model_type not in (UNIGRAM, BPE):
            raise ValueError("unigram and BPE models only")
        if spec.precompiled_charsmap or spec.remove_extra_whitespaces or not spec.escape_whitespaces or not spec.add_dummy_prefix:
            raise ValueError("a model that normalises its input can't be decoded to the same text")
        self.kind = proto.trainer_spec.model_type
        self.score: dict[str, float] = {}
        self.id: dict[str, int] = {}
        self.byte = [0] * 256
        self.unk = 0
        self.text: list[str] = []
        for i, p in enumerate(proto.pieces):
            text = p.piece.replace(MARK, " ")  # a mark and a space are the same here
            self.text.append(text)
            if p.type == 6:
                self.byte[int(p.piece[3:5], 16)] = i
            elif p.type == 2:
                self.unk = i
            elif p.type in (1, 4):
                self.id[text], self.score[text] = i, p.score
        self.has_bytes = any(self.byte)
        self._ready()

    def _ready(self) -> None:
        self.byte_of = {i: b for b, i in enumerate(self.byte)} if self.has_bytes else {}
        self.longest = max(map(len, self.id), default=1)
        self.lowest = min(self.score.values(), default=0.0) - 10
        # lengths of the pieces that end in three given characters, longest first: few of all lengths are worth a look
        ends: dict[str, set[int]] = {}
        for piece in self.id:
            if len(piece) > 2:
                ends.setdefault(piece[-3:], set()).add(len(piece))
        self.sizes = {k: (*sorted(v, reverse=True), 2) for k, v in ends.items()}
        self.whole: dict[str, bool] = {}
        self.parts: dict[str, tuple[str, str] | None] = {}
        self.fits: dict[int, bool] = {}
        # characters that stand in no longer piece are words of their own; a mark starts a word
        joined = {c for p in self.id if len(p) > 1 for c in p}
        alone = {c for c in "\n\r\t\f\v" if c not in joined}
        odd = f"[{re.escape(''.join(alone))}]|" if alone else ""
        inside = re.escape("".join(alone) + " ")
        if any(" " in p.lstrip(" ") for p in self.id):
            raise ValueError("a piece goes on after a mark inside it")
        self.cut = re.compile(f"{odd} *[^{inside}]+| +")

    def words(self, text: str) -> list[str]:
        """The marked words of a text."""
        return self.cut.findall(" " + text.replace(MARK, " ")) if text else []

    def single(self, c: str) -> int:
        """A number for a character, in the vocabulary or not."""
        i = self.id.get(c)
        return i if i is not None else len(self.text) + ord(c)

    # ---- BPE: what the merge order makes of two neighbouring pieces

    def halves(self, piece: str) -> tuple[str, str] | None:
        """The last merge that makes a piece from its characters; None for a single character."""
        if piece not in self.parts:
            self.parts[piece] = self._merge(list(piece), whole=True) if len(piece) > 1 else None
        return self.parts[piece]

    def _merge(self, s: list[str], whole: bool = False):
        """Merge by score, leftmost first; the pieces, or the last two halves of a whole."""
        while len(s) > 1:
            best, at = None, -1
            for i in range(len(s) - 1):
                v = self.score.get(s[i] + s[i + 1])
                if v is not None and (best is None or v > best):
                    best, at = v, i
            if at < 0:
                break
            if whole and len(s) == 2:
                return s[0], s[1]
            s[at : at + 2] = [s[at] + s[at + 1]]
        return None if whole else s

    def is_whole(self, t: str) -> bool:
        """True if t is a piece that its own characters merge to."""
        known = self.whole.get(t)
        if known is None:
            known = t in self.score and self.halves(t) is not None
            if t in self.score:  # so never more entries than pieces
                self.whole[t] = known
        return known

    def follows(self, a: str, b: str, key: int) -> bool:
        """True if the characters of a and b, merged by rank, end as exactly a and b; key stands for the two."""
        if len(self.fits) >= PAIRS:
            self.fits.clear()
        known = self.fits[key] = self._apart(a, b)
        return known

    def _apart(self, x: str, y: str) -> bool:
        """True if nothing merges across x|y, by undoing their merges from the last to the first.

        A state (x, y) lasts until a further merge takes x or y in; a piece across it forms if its score
        comes before that merge's, the leftmost first among equals.
        """
        score, whole = self.score, (x, y)
        until, equal = float("-inf"), True  # score that ends the state; whether an equal score still gets in
        while True:
            cross = score.get(x + y)
            if cross is not None and (cross > until or equal and cross == until):
                return False
            left, right = self.halves(x), self.halves(y)
            if left is None and right is None:
                return True
            if right is None or left is not None and score[x] < score[y]:
                if any(score.get(part, 0.0) <= score[x] for part in left if len(part) > 1):
                    break  # parts that merge after their whole: not undone so simply
                until, equal, x = score[x], False, left[1]
            else:
                if any(score.get(part, 0.0) <= score[y] for part in right if len(part) > 1):
                    break
                until, equal, y = score[y], True, right[0]
        return self._merge(list("".join(whole))) == list(whole)


class Walk:
    """Forward states along the current word; kept for the prefix that the next word shares."""

    def __init__(self, pieces: Pieces):
        self.p = pieces
        self.word = ""
        self.last: list[str] = [""]  # last piece of the best path of each prefix
        self.best: list[float] = [0.0]  # its score
        self.mark: list[int] = [0]  # its number

    def encode(self, word: str) -> list[str]:
        """Pieces of a word; words in sorted order share the most."""
        same, old = 0, self.word
        for x, y in zip(word, old):
            if x != y:
                break
            same += 1
        del self.last[same + 1 :], self.best[same + 1 :], self.mark[same + 1 :]
        (self._bpe if self.p.kind == BPE else self._unigram)(word, same + 1)
        self.word = word
        out, at = [], len(word)
        while at:
            out.append(self.last[at])
            at -= len(self.last[at])
        return out[::-1]

    def _bpe(self, word: str, begin: int) -> None:
        p, last, best, mark = self.p, self.last, self.best, self.mark
        score, number, sizes, whole, fits, follows, single = p.score, p.id, p.sizes.get, p.is_whole, p.fits.get, p.follows, p.single
        for end in range(begin, len(word) + 1):
            # longer pieces that end here, then a pair of characters, else the character by itself; one of them fits
            for size in sizes(word[end - 3 : end], PAIR) if end > 2 else PAIR:
                if size > end:
                    continue
                t = word[end - size : end]
                i = number.get(t)
                if i is not None and whole(t):
                    if size == end:
                        break
                    key = mark[end - size] << 24 | i
                    ok = fits(key)
                    if follows(last[end - size], t, key) if ok is None else ok:
                        break
            else:
                size, t = 1, word[end - 1]
                i = single(t)
            last.append(t)
            mark.append(i)
            best.append(best[end - size] + score.get(t, p.lowest))

    def _unigram(self, word: str, begin: int) -> None:
        score, best, last = self.p.score, self.best, self.last
        for end in range(begin, len(word) + 1):
            top, piece = None, ""
            for size in range(min(self.p.longest, end), 0, -1):
                t = word[end - size : end]
                v = score.get(t)
                if v is None:
                    if size > 1:
                        continue
                    v = self.p.lowest
                v += best[end - size]
                if top is None or v > top:
                    top, piece = v, t
            best.append(top)
            last.append(piece)


def unpacked(x: bytes) -> np.ndarray:
    return np.frombuffer(x, dtype="<i4")


class Coder:
    """Encodes and decodes whole texts; keeps the ids of words it has met."""

    def __init__(self, pieces: Pieces):
        self.p = pieces
        self.known: dict[str, bytes] = {}
        self.size = 0

    def ids_of(self, pieces: list[str]) -> bytes:
        """Ids of some pieces, packed as little-endian 32-bit numbers."""
        out, ids = [], self.p.id.get
        for t in pieces:
            i = ids(t)
            if i is not None:
                out.append(i)
            elif self.p.has_bytes:
                out += [self.p.byte[b] for b in t.encode("utf-8", "surrogatepass")]
            elif not out or out[-1] != self.p.unk:
                out.append(self.p.unk)
        return struct.pack(f"<{len(out)}i", *out)

    def learn(self, words: set) -> None:
        """Encode the words not met yet, in sorted order."""
        if self.size > WORD_BYTES:
            self.known, self.size = {}, 0
        fresh = sorted(w for w in words if w not in self.known)
        walk = Walk(self.p)
        for w in fresh:
            ids = self.known[w] = self.ids_of(walk.encode(w))
            self.size += len(w) * 2 + len(ids) + 150

    def packed(self, texts: list) -> list:
        """Packed ids of each text, None for None.  Only distinct words are held; texts are cut twice."""
        cut, new = self.p.words, set()
        for t in texts:
            if t:
                new.update(cut(t))
        self.learn(new)
        known = self.known.__getitem__
        return [None if t is None else b"".join(map(known, cut(t))) for t in texts]

    def encode_all(self, texts: list) -> list:
        """Ids of each text as a list."""
        return [None if x is None else unpacked(x).tolist() for x in self.packed(texts)]

    def decode(self, ids) -> str:
        """The text of some ids."""
        out, raw = [], bytearray()
        for i in ids:
            b = self.p.byte_of.get(i)
            if b is None:
                if raw:
                    out.append(raw.decode("utf-8", "replace"))
                    raw.clear()
                out.append(self.p.text[i])
            else:
                raw.append(b)
        if raw:
            out.append(raw.decode("utf-8", "replace"))
        return "".join(out)[1:]


@functools.lru_cache(2)
def pieces_of(blob: bytes) -> Pieces:
    """Tables of a model file, made once in each Python worker."""
    return Pieces(blob)


def load(path: str = MODEL_PATH) -> bytes:
    """The model file's bytes, read by the driver."""
    with open(path, "rb") as f:
        return f.read()


def encode(docs: DataFrame, model: bytes, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, ids)``: the piece ids of every whole text."""

    def run(batches):
        coder = Coder(pieces_of(model))
        for b in batches:
            for part, texts in text_slices(b, SLICE):
                out = coder.packed(texts)
                ends = np.cumsum([0] + [len(x or b"") // 4 for x in out]).astype(np.int32)
                flat = pa.array(unpacked(b"".join(x for x in out if x)))
                lists = pa.ListArray.from_arrays(pa.array(ends), flat, mask=pa.array([x is None for x in out]))
                yield pa.RecordBatch.from_arrays([part.column(0), lists], ["id", "ids"])
        give_back()

    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(run, "id long, ids array<int>")


def decode(encoded: DataFrame, model: bytes) -> DataFrame:
    """``(id, text)`` from ``(id, ids)``."""

    def run(batches):
        coder = Coder(pieces_of(model))
        for b in batches:
            texts = [None if x is None else coder.decode(x) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], ["id", "text"])

    return encoded.select("id", "ids").mapInArrow(run, "id long, text string")


def digest(docs: DataFrame, model: bytes | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (of the ids as little-endian 32-bit numbers), decoded_same."""
    blob = model if model is not None else load()

    def run(batches):
        coder = Coder(pieces_of(blob))
        for b in batches:
            for part, texts in text_slices(b, SLICE):
                out = coder.packed(texts)
                n = [None if x is None else len(x) // 4 for x in out]
                sha = [None if x is None else hashlib.sha256(x).hexdigest() for x in out]
                same = [None if x is None else coder.decode(unpacked(x).tolist()) == t for x, t in zip(out, texts)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64()), pa.array(sha, pa.string()), pa.array(same, pa.bool_())], ["doc_id", "n_tokens", "ids_sha256", "decoded_same"])
        give_back()

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_same boolean")
