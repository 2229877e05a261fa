"""SentencePiece encoding and decoding by a streaming Viterbi pass.

The vocabulary is a merge (BPE) model. Of all ways to cut a text into pieces, the
library's result is the one in which every two neighbours, encoded alone, give
themselves: a merge across a boundary would happen in the two pieces alone as it
does in the text. So each position has one surviving backpointer, the piece its
prefix ends with, and a left-to-right pass finds it among the at most
``longest`` pieces that end there. Ids are committed as soon as the backpointer
paths of all positions in the last ``longest`` characters run through one boundary;
only what follows it is held.

Boundaries no piece of the vocabulary spans - before a run of word marks, and
between neighbours that stand together in no piece - are such a point for all paths at
once. What lies between two of them is encoded once per distinct string and
Python worker, as long as a bounded memo holds it.

Defined results: null text is the empty text, no ids; a character outside the
vocabulary becomes its bytes' pieces; a word mark in the text decodes to a space,
which is the library's own loss (``round_trip`` is then false); repeated rows give
repeated rows; an empty table gives an empty one.
"""

from __future__ import annotations

import hashlib
import re
from collections import defaultdict
from collections.abc import Callable, Iterator
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultline.llm.common import query, table, texts, tokenizer_file

MODEL = "piece_bpe_32k.model"
MARK = "▁"
MEMO_ENTRIES = 400_000
# Strings over this length go through the stream without being remembered.
MEMO_LENGTH = 64
_WHOLE, _MORE = 1, 2


class Pieces:
    """The vocabulary: ids and scores of ordinary pieces, ids of bytes."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.surface = [model.id_to_piece(i) for i in range(model.get_piece_size())]
        byte = [i for i in range(len(self.surface)) if model.is_byte(i)]
        self.byte_ids = {int(self.surface[i][3:-1], 16): i for i in byte}
        self.bytes_of = {i: b for b, i in self.byte_ids.items()}
        skipped = {i for i in range(len(self.surface)) if model.is_control(i) or model.is_unknown(i)}
        ordinary = [i for i in range(len(self.surface)) if i not in skipped and i not in self.bytes_of]
        self.ids = {self.surface[i]: i for i in ordinary}
        self.scores = {self.surface[i]: model.get_score(i) for i in ordinary}
        self.controls = skipped
        self.longest = max(map(len, self.ids))
        self.letters = set("".join(self.ids))
        # Neighbouring characters that stand in some piece; no piece spans any others.
        self.joined = {p[k : k + 2] for p in self.ids for k in range(len(p) - 1)}
        # What a string is to the vocabulary: a piece, the start of a longer one, or both.
        self.kinds = dict.fromkeys(self.ids, _WHOLE)
        for p in self.ids:
            for k in range(1, len(p)):
                self.kinds[p[:k]] = self.kinds.get(p[:k], 0) | _MORE
        # The same as a tree of characters; "" leads to the piece that ends at a node.
        self.tree: dict = {}
        for p in self.ids:
            node = self.tree
            for c in p:
                node = node.setdefault(c, {})
            node[""] = p
        self.followers: dict[str | None, dict[str, bool]] = defaultdict(dict)
        self._n_pairs = 0

    def merged(self, text: str) -> list[str]:
        """The merges of the vocabulary run over a short string: best score first, then leftmost."""
        parts = list(text)
        while True:
            best, at = None, -1
            for i in range(len(parts) - 1):
                score = self.scores.get(parts[i] + parts[i + 1])
                if score is not None and (best is None or score > best):
                    best, at = score, i
            if best is None:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def stands(self, left: str | None, piece: str) -> bool:
        """Whether ``piece`` may follow ``left`` (None: the start); remembered in ``followers``."""
        if left is None:
            answer = self.merged(piece) == [piece]
        else:
            answer = self.merged(left + piece) == [left, piece]
        if self._n_pairs >= MEMO_ENTRIES:
            for known in self.followers.values():
                known.clear()
            self._n_pairs = 0
        self.followers[left][piece] = answer
        self._n_pairs += 1
        return answer


def stream_pieces(pieces: Pieces, text: str) -> Iterator[str]:
    """The pieces of a text, left to right, each as soon as it is certain.

    ``back`` holds the one piece that ends at each position a path has reached,
    from the last committed boundary to ``longest`` characters ahead.
    """
    kinds, stands, longest = pieces.kinds, pieces.stands, pieces.longest
    followers = pieces.followers
    back: dict[int, str | None] = {0: None}
    base, n = 0, len(text)
    next_look = 4 * longest
    for start in range(n):
        left = back[start]
        follow = followers[left]
        end = start + 1
        piece = text[start]
        kind = kinds.get(piece, 0) | _WHOLE  # a character is always allowed
        while True:
            if kind & _WHOLE and end not in back:
                known = follow.get(piece)
                if known or known is None and stands(left, piece):
                    back[end] = piece
            if not kind & _MORE or end == n:
                break
            end += 1
            piece = text[start:end]
            kind = kinds.get(piece, 0)
        if start >= next_look:
            # Take the farthest path back piece by piece until all run through one boundary.
            live = {end for end in range(start + 1, min(n, start + longest) + 1) if end in back}
            while len(live) > 1:
                far = max(live)
                live.discard(far)
                live.add(far - len(back[far]))
            (cut,) = live
            yield from _walk(back, base, cut)
            for done in range(base, cut):
                back.pop(done, None)
            base, next_look = cut, start + longest
    yield from _walk(back, base, n)


def window_pieces(pieces: Pieces, text: str) -> list[str]:
    """The pieces of a text that fits the window: the same pass, nothing to commit before its end."""
    root, stands, followers, n = pieces.tree.get, pieces.stands, pieces.followers, len(text)
    back: list[str | None] = [None] * (n + 1)
    for start, char in enumerate(text):
        left = back[start]
        follow = followers[left].get
        end = start + 1
        if back[end] is None:  # a character is always allowed
            known = follow(char)
            if known or known is None and stands(left, char):
                back[end] = char
        node = root(char)
        while node is not None and end < n:
            node = node.get(text[end])
            end += 1
            if node is not None and back[end] is None:
                piece = node.get("")
                if piece is not None:
                    known = follow(piece)
                    if known or known is None and stands(left, piece):
                        back[end] = piece
    out = []
    while n:
        out.append(back[n])
        n -= len(back[n])
    return out[::-1]


def _walk(back: dict[int, str | None], base: int, end: int) -> list[str]:
    out = []
    while end > base:
        out.append(back[end])
        end -= len(back[end])
    return out[::-1]


class _Memo(dict):
    """Ids of strings met before, bounded; long ones are made anew each time."""

    def __init__(self, ids_of: Callable[[str], tuple[int, ...]]):
        self.ids_of = ids_of

    def __missing__(self, part: str) -> tuple[int, ...]:
        ids = self.ids_of(part)
        if len(part) <= MEMO_LENGTH:
            if len(self) >= MEMO_ENTRIES:
                self.clear()
            self[part] = ids
        return ids


class Codec:
    """Encodes and decodes whole texts with one vocabulary."""

    def __init__(self, path: str):
        self.pieces = Pieces(path)
        single = "".join(c for c in map(chr, range(0x100)) if c not in self.pieces.letters)
        cls = re.escape(single)
        # Pieces hold word marks at their start only; otherwise only the ends of a text are sure.
        inside = all(MARK not in p.lstrip(MARK) for p in self.pieces.ids)
        self._split = re.compile(f"{MARK}+[^{MARK}{cls}]*|[^{MARK}{cls}]+|[{cls}]" if inside else r"[\s\S]+")
        # What each id decodes to; controls to nothing.
        self._bytes = [
            bytes([self.pieces.bytes_of[i]]) if i in self.pieces.bytes_of else b"" if i in self.pieces.controls else piece.encode()
            for i, piece in enumerate(self.pieces.surface)
        ]
        self._memo = _Memo(self._cut_ids)
        self._cuts = _Memo(self._piece_ids)

    def _piece_ids(self, part: str) -> tuple[int, ...]:
        out: list[int] = []
        ids, byte_ids = self.pieces.ids, self.pieces.byte_ids
        fits = len(part) <= 4 * self.pieces.longest
        for piece in window_pieces(self.pieces, part) if fits else stream_pieces(self.pieces, part):
            known = ids.get(piece)
            if known is None:
                out.extend(byte_ids[b] for b in piece.encode())
            else:
                out.append(known)
        return tuple(out)

    def _cut_ids(self, part: str) -> tuple[int, ...]:
        """Ids of a part, cut once more wherever no piece holds both neighbours."""
        joined = self.pieces.joined
        out: list[int] = []
        begin = 0
        for at in range(1, len(part) + 1):
            if part[at - 1 : at + 1] not in joined:
                out += self._cuts[part[begin:at]]
                begin = at
        return tuple(out)

    def encode(self, text: str) -> list[int]:
        if not text:
            return []
        parts = self._split.findall(MARK + text.replace(" ", MARK))
        return list(chain.from_iterable(map(self._memo.__getitem__, parts)))

    def decode(self, ids: list[int]) -> str:
        # A piece begins with no continuation byte, so it never completes the bytes before it.
        text = b"".join(map(self._bytes.__getitem__, ids)).decode("utf-8", "replace").replace(MARK, " ")
        return text[1:] if text.startswith(" ") else text


class CodecOnce:
    """A codec made where it is first used; as a broadcast value it lives as long as its worker."""

    def __init__(self, model: str):
        self.model = model
        self._codec: Codec | None = None

    def get(self) -> Codec:
        if self._codec is None:
            self._codec = Codec(tokenizer_file(self.model))
        return self._codec


def encode_documents(docs: DataFrame, model: str = MODEL) -> DataFrame:
    """One row per document: its ids, and what they decode to, checked against the text."""
    shared = docs.sparkSession.sparkContext.broadcast(CodecOnce(model))

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = shared.value.get()
        for batch in batches:
            ids, digests, same = [], [], []
            for value in batch.column(1):
                text = value.as_py()
                got = codec.encode(text)
                back = codec.decode(got)
                ids.append(got)
                digests.append(hashlib.sha256(back.encode()).hexdigest())
                same.append(back == text)
            columns = [
                batch.column(0), batch.column(2), pa.array([len(x) for x in ids], pa.int64()),
                pa.array(ids, pa.list_(pa.int32())), pa.array(digests, pa.string()), pa.array(same, pa.bool_()),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_bytes", "n_ids", "ids", "decoded_sha256", "round_trip"])

    rows = texts(docs).withColumn("n_bytes", F.octet_length("text").cast("long"))
    id_type = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(
        encoded, f"doc_id {id_type}, n_bytes long, n_ids long, ids array<int>, decoded_sha256 string, round_trip boolean")


@query("op10_sentence_piece")
def op10_sentence_piece(spark, sf_dir: str) -> DataFrame:
    return encode_documents(table(spark, sf_dir, "documents"))
